"""Spelling variants by forward and reversed sorted dictionaries (operator 13).

Two words that differ by one inserted, deleted or replaced code point share all but that place.
Let m be the length of the shorter one and c the length of their common prefix: the edit is at c,
and everything after it is equal again. If c is in the second half, both share the first half of
m as prefix, so they meet in a block of the forward dictionary; else they share the rest as
suffix and meet in a block of the reversed one. A block is named by (m, a, b): the words share a
code points at the front and m - b at the back, and the edit is at a <= c < b. A block with many
words is divided at the middle of a and b into its forward and its reversed half, again and
again, until it is small, so no block is compared as a whole because it is common.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm._cluster import discard, fits, join_counted, sized, stash

#: A block of more words than this is divided.
BLOCK_WORDS = 48

#: Maximal runs of these are words.
LETTERS = "[A-Za-zÀ-ÿ]"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def corpus_words(docs: DataFrame, min_length: int = 7, min_count: int = 2, rewrite: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the lower-cased runs of letters of whole texts, and how often each occurs.

    Words of fewer than min_length code points or min_count occurrences are left out; only A-Z
    is lower-cased. rewrite takes the id and the lower-cased run and returns the word, which may
    be shorter than the run but not longer. A null text has no runs; a null id is handed on as an
    empty text; repeated rows count each time. Other columns aren't read.
    """
    low = F.translate(F.col(text_col), _UPPER, _LOWER)
    # a run that is too short can't become a word, and no part of it can
    runs = F.regexp_extract_all(low, F.lit(f"{LETTERS.replace('A-Z', '')}{{{min_length},}}"), F.lit(0))
    found = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"), F.explode(runs).alias("_run"))
    word = rewrite(F.col("_id"), F.col("_run")) if rewrite else F.col("_run")
    counted = found.select(word.alias("word")).filter(F.length("word") >= min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.filter(F.col("n") >= min_count)


def drop_one(divisor: int) -> Callable[[Column, Column], Column]:
    """A rewrite that deletes one code point of a run wherever divisor divides h, the CRC-32 of "id:run"; the place is h modulo the length."""

    def rewrite(doc: Column, run: Column) -> Column:
        h = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % divisor == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)

    return rewrite


def _key(m: Column, a: Column, b: Column) -> Column:
    """Names a block: its bounds, and what its words share at the front and at the back."""
    word = F.col("word")
    back = m - b
    return F.xxhash64(m, a, b, F.substring(word, F.lit(1), a), F.substring(word, F.length(word) - back + 1, back))


def _entries(words: DataFrame) -> DataFrame:
    """Each word in its forward and its reversed block, as the shorter and as the longer word of a pair."""
    size = F.length("word")
    halves = [F.struct(m.alias("m"), a.alias("a"), b.alias("b")) for m in (size, size - 1) for a, b in ((F.floor(m / 2).cast("int"), m), (F.lit(0), F.floor(m / 2).cast("int")))]
    found = words.select("word", "n", F.explode(F.array(*halves)).alias("_at")).select("word", "n", "_at.*").filter("b > a")
    return found.withColumn("key", _key(F.col("m"), F.col("a"), F.col("b")))


def _divided(entries: DataFrame) -> DataFrame:
    """The same entries in the forward and the reversed half of their blocks."""
    middle = F.floor((F.col("a") + F.col("b")) / 2).cast("int")
    parts = F.array(F.struct(middle.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), middle.alias("b")))
    found = entries.select("word", "n", "m", F.explode(parts).alias("_at")).select("word", "n", "m", "_at.*")
    return found.withColumn("key", _key(F.col("m"), F.col("a"), F.col("b")))


def near_pairs(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(word, n, near, near_n): every pair of words one edit apart, once, in either order.

    words is a written table (word, n) of different words. Blocks of more than block_words
    words are divided while they are wider than one place; a block of one place holds at most
    as many words of its length as there are letters, and all of those are near.
    """
    entries, small = stash(_entries(words), "entries"), []
    while True:
        total = max(1, entries.count())
        width = F.min(F.col("b") - F.col("a")).alias("width")
        blocks = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size"), width)
        large = stash(blocks.filter((F.col("size") > block_words) & (F.col("width") > 1)).select("key", "size"), "large")
        if fits(large):
            marked = entries.join(F.broadcast(large), "key", "left")
        else:
            marked = join_counted(entries, large, ["key"], "size", total)
        small.append(stash(marked.filter(F.col("size").isNull()).drop("size"), "blocks"))
        left = stash(_divided(marked.filter(F.col("size").isNotNull())), "entries")
        discard(entries, large)
        entries = left
        if not entries.limit(1).count():
            break
    whole = reduce(DataFrame.unionByName, small)
    u, v = whole.filter(F.length("word") == F.col("m")).alias("u"), whole.alias("v")
    word, near, a, b, m = F.col("u.word"), F.col("v.word"), F.col("u.a"), F.col("u.b"), F.col("u.m")
    front = lambda k: F.substring(word, F.lit(1), k) == F.substring(near, F.lit(1), k)
    once = (F.length(near) > m) | (word < near)
    # the edit is at a or later, and before b: so a pair is found in one block alone
    here = front(a) & ((b == m) | ~front(b))
    found = u.join(v, (F.col("u.key") == F.col("v.key")) & (m == F.col("v.m")) & once & here & (F.levenshtein(word, near, 1) == 1))
    return found.select(word.alias("word"), F.col("u.n").alias("n"), near.alias("near"), F.col("v.n").alias("near_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form), followed to the end. n grows with each form, so there is no circle, and paths halve each round."""
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        asked = now.groupBy("root").agg(F.count(F.lit(1)).alias("_rows"))
        onward = now.select(F.col("word").alias("root"), F.col("root").alias("_next")).join(asked, "root")
        onward = stash(onward, "onward")
        if not onward.limit(1).count():
            return now
        if fits(onward, 96):
            moved = now.join(F.broadcast(onward.drop("_rows")), "root", "left")
        else:
            moved = join_counted(now, onward, ["root"], "_rows", now.count())
        after = stash(moved.select("word", F.coalesce("_next", "root").alias("root")), "roots")
        discard(now, onward)
        now = after


def group_variants(words: DataFrame, ratio: int = 10, block_words: int = BLOCK_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of words (word, n), a written table of different words.

    Words are near if one inserted, deleted or replaced code point tells them apart. The form of
    a word is its near word of largest n (of several the first in code-point order) if that n is
    at least ratio (2 or more) times its own; else form and form_n are null. root follows forms
    to the last; a word without form is its own root. n_near counts near words. An empty table
    gives an empty result.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more")
    pairs = stash(near_pairs(words, block_words), "near")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    # a word has at most as many near words as it has places and the alphabet letters
    n_near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"))
    better = both.filter(F.col("near_n") >= ratio * F.col("n"))
    forms = stash(better.groupBy("word").agg(F.min(F.struct((-F.col("near_n")).alias("_less"), "near")).alias("_best")).select("word", F.col("_best.near").alias("form"), (-F.col("_best._less")).alias("form_n")), "forms")
    formed = forms.join(sized(_roots(forms), 96), "word")
    found = words.join(n_near, "word", "left").join(formed, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 7, min_count: int = 2, ratio: int = 10, rewrite: Callable[[Column, Column], Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """group_variants of the corpus_words of docs."""
    return group_variants(stash(corpus_words(docs, min_length, min_count, rewrite, id_col, text_col), "words"), ratio)
