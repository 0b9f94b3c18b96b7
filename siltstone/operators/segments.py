"""Blocks and chunks of documents, and links between chunks that name each other."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: So many strings are searched for in one pass over the texts; they go to the driver and to every task.
STRINGS_AT_ONCE = 50_000

# What makes a line a heading, where page numbers stand, what counts as a token.
HEADING = re.compile(r"#|(?i:section|article|clause|exhibit|schedule|addendum)\s+[A-Za-z0-9.\-]+|\d+(?:\.\d+)*\s+\S")
PAGE = re.compile(r"\bpage\s+(\d+)\b", re.I)
TOKEN = re.compile(r"[A-Za-z0-9][A-Za-z0-9_']*")
HEADED_FILES = (".txt", ".md", ".markdown", ".rst")

# How a text defines a term and refers to a part of a document.
MEANS = r'(?i)"([^"]{2,80})"\s+(?:means|shall mean|is defined as|refers to)\b'
ALIAS = r'(?i)\b[A-Z][A-Za-z0-9 \-]{2,80}\s+\(the\s+"([^"]{2,80})"\)'
_PART = r"(?:section|clause|article|exhibit|schedule|addendum)\s+[A-Za-z0-9.\-]+"
REFERENCES = (
    ("defined_in", rf"(?i)\bas defined in\s+({_PART})"),
    ("subject_to", rf"(?i)\bsubject to\s+({_PART})"),
    ("pursuant_to", rf"(?i)\bpursuant to\s+({_PART})"),
    ("see_reference", rf"(?i)\bsee\s+({_PART})"),
    ("structural_reference", rf"(?i)\b({_PART})"),
)

#: Of a chunk's text, so many characters are looked at for a heading that it may be known by.
HEAD = 300


def _blocks(text: str, headings: bool) -> Iterator[tuple[int, int, str | None, int | None]]:
    """(start, end, heading, page) of a text's paragraphs, in characters: runs of lines that aren't blank, begun anew at headings."""
    heading, page, start, at = None, None, None, 0

    def span(end: int) -> tuple[int, int] | None:
        if start is None:
            return None
        part = text[start:end]
        a, b = start + len(part) - len(part.lstrip()), start + len(part.rstrip())
        return (a, b) if b > a else None

    for line in text.splitlines(keepends=True) if text.isascii() and not re.search("[\r\x0b\f\x1c-\x1e]", text) else re.findall(r"[^\n]*\n|[^\n]+", text):
        bare = line.strip()
        if found := PAGE.search(bare):
            page = int(found[1])
        if "\f" in line:
            page = (page or 0) + line.count("\f")
        new = headings and bare and HEADING.match(bare)
        if new or not bare:
            if block := span(at):
                yield (*block, heading, page)
            start = None
        if new:
            heading = bare.lstrip("#").strip()
        if bare and start is None:
            start = at
        at += len(line)
    if block := span(at):
        yield (*block, heading, page)


def _chunks(text: str, headings: bool, most: int, overlap: int) -> Iterator[tuple[int, int, str | None, int | None]]:
    """(start, end, heading, page) of runs of blocks of up to most tokens; a longer block is cut by tokens, with overlap."""
    run: list = []
    held = 0
    for a, b, heading, page in _blocks(text, headings):
        places = [(m.start(), m.end()) for m in TOKEN.finditer(text, a, b)]
        n = max(1, len(places))
        if run and (n > most or held + n > most):
            yield (run[0][0], run[-1][1], *run[0][2:])
            run, held = [], 0
        if n <= most:
            run.append((a, b, heading, page))
            held += n
            continue
        step = max(1, most - overlap)
        for i in range(0, len(places), step):
            last = min(i + most, len(places))
            yield places[i][0], places[last - 1][1], heading, page
            if last == len(places):
                break
    if run:
        yield (run[0][0], run[-1][1], *run[0][2:])


def _spans(docs: DataFrame, key: str, path: Column, text: str, cut) -> DataFrame:
    """A row for each span that cut(text, headed) finds: its number, bytes, tokens and place among the document's tokens."""
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType)] + [T.StructField(n, k) for n, k in (("index", T.IntegerType()), ("byte_start", T.LongType()), ("byte_end", T.LongType()), ("token_start", T.LongType()), ("token_end", T.LongType()), ("heading", T.StringType()), ("page", T.LongType()), ("text", T.StringType()))])
    headed = F.coalesce(F.lower(path).rlike(r"\.(txt|md|markdown|rst)$"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part, rows, found = batch.slice(at, 64), [], []
                for i, (head, whole) in enumerate(zip(part.column(1).to_pylist(), part.column(2))):
                    whole, bytes_to, done, tokens = whole.as_py() or "", 0, 0, 0
                    for index, (a, b, heading, page) in enumerate(cut(whole, head)):
                        if a < done:  # an overlap: bytes are counted back
                            bytes_to -= len(whole[a:done].encode())
                        else:
                            bytes_to += len(whole[done:a].encode())
                        own = whole[a:b]
                        n, size = max(1, len(TOKEN.findall(own))), len(own.encode())
                        rows.append(i)
                        found.append((index, bytes_to, bytes_to + size, tokens, tokens + n, heading, page, own))
                        bytes_to, done, tokens = bytes_to + size, b, tokens + n
                columns = list(zip(*found)) or [[]] * 8
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=schema.names)

    return docs.select(key, headed.alias("_headed"), text).mapInArrow(run, schema)


def paragraph_blocks(docs: DataFrame, key: str, path: Column, text: str) -> DataFrame:
    """key, index, byte_start, byte_end, token_start, token_end, heading, page and text of each paragraph.

    A paragraph is a run of lines that aren't blank, without white space around it; its bytes are
    those of the text. In .txt, .md, .markdown and .rst paths a heading begins another and
    names it and those after it. "page N" and form feeds set the page from their line on. Null,
    empty and blank texts have none. Tokens are runs of ASCII letters, digits, "_" and "'".
    """
    return _spans(docs, key, path, text, _blocks)


def document_chunks(docs: DataFrame, key: str, path: Column, text: str, most: int = 500, overlap: int = 60) -> DataFrame:
    """As paragraph_blocks, for runs of paragraphs of up to most tokens together, with the heading and page of the first.

    What stands between the paragraphs of a chunk belongs to it. A paragraph of more tokens is cut
    every most - overlap tokens, from the first byte of a token to the last of another.
    """
    return _spans(docs, key, path, text, lambda whole, headed: _chunks(whole, headed, most, overlap))


def normalized(text: Column) -> Column:
    """ASCII letters in lower case and digits, a space for each run of anything else between them; null is empty."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def defined_terms(text: Column) -> Column:
    """Normalized terms of two characters or more that a text says the meaning of, each once."""
    found = F.concat(F.regexp_extract_all(text, F.lit(MEANS), F.lit(1)), F.regexp_extract_all(text, F.lit(ALIAS), F.lit(1)))
    return F.filter(F.array_distinct(F.transform(F.coalesce(found, F.array().cast("array<string>")), normalized)), lambda t: F.length(t) >= 2)


def containing(texts: DataFrame, strings: DataFrame) -> DataFrame:
    """(id, string): which texts (id, text) contain which strings (string), anywhere; once each.

    An automaton of STRINGS_AT_ONCE strings reads each text once; more strings take more passes.
    Empty strings are in no text.
    """
    wanted = strings.select("string").filter("string <> ''").distinct()
    passes = max(1, -(-wanted.count() // STRINGS_AT_ONCE))
    schema = T.StructType([T.StructField("id", texts.schema["id"].dataType), T.StructField("string", T.StringType())])
    found = None
    for number in range(passes):
        own = [r["string"] for r in wanted.filter(F.pmod(F.xxhash64("string"), F.lit(passes)) == number).collect()]  # about STRINGS_AT_ONCE

        def run(batches: Iterator[pa.RecordBatch], own: list[str] = own) -> Iterator[pa.RecordBatch]:
            automaton = ahocorasick.Automaton()
            for s in own:
                automaton.add_word(s, s)
            automaton.make_automaton()
            for batch in batches:
                rows, hits = [], []
                for i, text in enumerate(batch.column(1)):
                    some = {s for _, s in automaton.iter(text.as_py() or "")} if own else ()
                    rows += [i] * len(some)
                    hits += some
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(hits, pa.string())], names=["id", "string"])

        part = texts.select("id", "text").mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found


def term_links(chunks: DataFrame) -> DataFrame:
    """(source, target, relation, evidence): chunks (id, text) that name a term which others define, and the first of those."""
    terms = chunks.select("id", F.explode(defined_terms(F.col("text"))).alias("string"))
    first = terms.groupBy("string").agg(F.min("id").alias("target"))
    named = containing(chunks.select("id", normalized(F.col("text")).alias("text")), first)
    others = named.join(terms, ["id", "string"], "left_anti").join(first, "string")
    return others.select(F.col("id").alias("source"), "target", F.lit("defined_term").alias("relation"), F.col("string").alias("evidence"))


def reference_links(chunks: DataFrame) -> DataFrame:
    """(source, target, relation, evidence): references of chunks (id, path, heading, text) to parts of documents, and the first other chunk whose heading, path or first HEAD characters hold the part's name.

    target is null where there is none. A reference counts once for each relation and name, in
    any case; a chunk's own heading is no structural reference.
    """
    found = None
    for relation, pattern in REFERENCES:
        each = chunks.select("id", "heading", F.posexplode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("pos", "evidence"))
        if relation == "structural_reference":
            each = each.withColumn("evidence", F.regexp_replace("evidence", r"^(\S+)\s+", "$1 ")).filter(~F.contains(normalized(F.col("heading")), normalized(F.col("evidence"))))
        each = each.withColumn("relation", F.lit(relation))
        found = each if found is None else found.unionByName(each)
    once = found.groupBy("id", "relation", F.lower("evidence").alias("_low")).agg(F.min_by("evidence", "pos").alias("evidence"))
    once = once.withColumn("string", normalized(F.col("evidence")))
    heads = chunks.select("id", F.concat_ws("\n", normalized(F.col("heading")), normalized(F.col("path")), normalized(F.substring("text", 1, HEAD))).alias("text"))
    holders = containing(heads, once.select("string"))
    # the first chunk that holds a name, or the second where that is the one that refers to it
    order = Window.partitionBy("string").orderBy("id")
    first = holders.withColumn("_r", F.row_number().over(order)).filter("_r <= 2").groupBy("string").agg(F.min("id").alias("_first"), F.max("id").alias("_last"))
    joined = once.join(first, "string", "left")
    other = F.when(F.col("_first") != F.col("id"), F.col("_first")).when(F.col("_last") != F.col("id"), F.col("_last"))
    return joined.select(F.col("id").alias("source"), other.alias("target"), "relation", "evidence")
