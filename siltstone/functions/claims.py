"""Column functions that hold claims against evidence, and fragments against answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone.functions.code import identifiers
from siltstone.functions.signals import hashed


def tokens(text: Column) -> Column:
    """Runs between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once: inside a lambda, an expression would be computed again for each element."""
    return F.transform(F.array(value), body)[0]


def share_found(items: Column, among: Column) -> Column:
    """Share of an array's elements that another has; null for an empty one."""
    found = lambda a: lambda b: F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: F.array_contains(b, x))) / F.size(a))
    return let(items, lambda a: let(among, found(a)))


def recognition(claim: Column, evidence: Column) -> Column:
    """Share of the claim's different words that the evidence has, less 0.1 for each new capitalised one; 1 for an empty claim. Between 0 and 1."""
    mine, known = F.array_distinct(tokens(F.lower(claim))), F.array_distinct(tokens(F.lower(evidence)))
    names = F.array_distinct(F.transform(F.filter(tokens(claim), lambda w: w.rlike(r"^\p{Lu}")), F.lower))
    new = F.size(F.array_except(names, known))
    score = F.size(F.array_intersect(mine, known)) / F.size(mine) - new * 0.1
    return F.when(F.size(mine) == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def entities(text: Column) -> Column:
    """Different capitalised words of two bytes or more and words that start with a digit, without other characters than letters, digits, - and _."""
    clean = F.transform(tokens(text), lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_-]", ""))
    return F.array_distinct(F.filter(clean, lambda w: (w.rlike(r"^\p{Lu}") & (F.octet_length(w) > 1)) | w.rlike("^[0-9]")))


def entity_overlap(claim: Column, evidence: Column) -> Column:
    """Share of the claim's entities that are among the evidence's, whatever their case; 1 without any."""
    known = F.transform(entities(evidence), F.lower)
    return F.coalesce(share_found(F.transform(entities(claim), F.lower), known), F.lit(1.0))


def novel_entropy(claim: Column, evidence: Column) -> Column:
    """Entropy of the claim's words, as a share of its greatest value, times the share of words that the evidence lacks; 0 for an empty claim."""
    words = tokens(F.lower(claim))
    kinds = F.array_distinct(words)
    n = F.size(words)
    bits = let(words, lambda w: F.aggregate(F.array_distinct(w), F.lit(0.0), lambda a, k: a + _bits(w, k)))
    norm = F.least(F.lit(1.0), bits / F.greatest(F.log2(F.size(kinds)), F.lit(1.0)))
    covered = share_found(words, F.array_distinct(tokens(F.lower(evidence))))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), norm * (1 - covered))))


def _bits(words: Column, kind: Column) -> Column:
    return let(F.size(F.filter(words, lambda w: w == kind)) / F.size(words), lambda p: -p * F.log2(p))


def trigrams(text: Column) -> Column:
    """Hashes of the different runs of three lower-case words, each without punctuation at its ends; none in shorter texts."""
    w = F.filter(F.transform(tokens(F.lower(text)), lambda x: F.regexp_replace(x, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")), lambda x: x != "")
    count = F.greatest(F.size(w) - 2, F.lit(0))
    pairs = F.zip_with(F.slice(w, 1, count), F.slice(w, 2, count), lambda a, b: F.concat(a, F.lit("\x00"), b))
    return F.array_distinct(hashed(F.zip_with(pairs, F.slice(w, 3, count), lambda a, b: F.concat(a, F.lit("\x00"), b))))


def used_share(fragment: Column, answer: Column) -> tuple[Column, Column, Column]:
    """Shares of a fragment's trigrams and identifiers that an answer has, and 0.4 and 0.6 of them together."""
    grams = F.coalesce(_common(trigrams(fragment), trigrams(answer)), F.lit(0.0))
    names = F.coalesce(_common(F.array_distinct(hashed(identifiers(fragment))), F.array_distinct(hashed(identifiers(answer)))), F.lit(0.0))
    return grams, names, 0.4 * grams + 0.6 * names


def _common(a: Column, b: Column) -> Column:
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def query_entities(query: Column) -> Column:
    """Different capitalised words, numbers and quoted phrases of a query, in lower case, sorted."""
    pattern = r"""\b[A-Z][a-z]{2,}\b|\b\d+(?:[.,]\d+)*\b|['"]([^'"]{2,40})['"]"""
    found = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(pattern), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"""^['"]|['"]$""", "")))))


def sentences(text: Column, least: int = 20) -> Column:
    """Sentences of least characters or more: they end before white space after . ! or ?, and after a blank line, ;, or } at a line's end."""
    parts = F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|(?<=\n\n)|(?<=[;}]\n)")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: F.char_length(s) >= least)


def best_matches(claims_: Column, evidence: Column) -> Column:
    """Mean over a claim's word sets of the greatest Jaccard index with one of the evidence's; 0 without either. Both are one case's few sets."""
    like = lambda a, b: F.when(F.size(F.array_union(a, b)) > 0, F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)
    best = F.transform(claims_, lambda a: F.aggregate(evidence, F.lit(0.0), lambda m, b: F.greatest(m, like(a, b))))
    return F.when((F.size(claims_) == 0) | (F.size(evidence) == 0), 0.0).otherwise(F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(claims_))


def suppressed(label: Column, risk: Column, profile: Column) -> Column:
    """Whether a claim with this label is held back in a profile; a null risk is 0, unknown and null labels pass."""
    strict = profile.isin("code", "rag", "qa", "benchmark_qa")
    held = F.when(label == "contradicted", True).when(label == "unsupported", ~profile.isin("chat", "dialogue")).when(label == "unknown", strict | (F.coalesce(risk, F.lit(0.0)) >= 0.75))
    return F.coalesce(held, F.lit(False))
