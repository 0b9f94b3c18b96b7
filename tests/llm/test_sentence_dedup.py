"""Sentence dedup against plain code with a splitter of its own, and its edge cases."""

import os
import random
import re

import pytest

from siltstone.llm import queries, sentence_dedup

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def split(text):
    """(start, end, words in lower case) of each sentence, one word after another."""
    found, words, start = [], [], None
    tokens = [(m.start(), m.end()) for m in re.finditer(f"[^{SPACE}]+", text)]
    for i, (a, b) in enumerate(tokens):
        start = a if start is None else start
        words.append(re.sub("[A-Z]", lambda m: m[0].lower(), text[a:b]))
        after = tokens[i + 1][0] if i + 1 < len(tokens) else len(text)
        if text[a:b].rstrip("\"')]")[-1:] in (".", "!", "?") or "\n" in text[b:after] or i + 1 == len(tokens):
            found.append((start, after, words))
            words, start = [], None
    return found


def runs(sizes):
    """Every run of two or more sentences and 12 or more words, and every sentence of 20."""
    found = set()
    for a in range(len(sizes)):
        for b in range(a + 1, len(sizes) + 1):
            n = sum(sizes[a:b])
            if n >= 20 or (b - a >= 2 and n >= 12):
                found.add((a, b))
                break
    return found | {(a, b) for b in range(1, len(sizes) + 1) for a in [next((a for a in range(b - 1, -1, -1) if sum(sizes[a:b]) >= 20 or (b - a >= 2 and sum(sizes[a:b]) >= 12)), None)] if a is not None}


def plain(docs):
    """{id: (text, removed)} by comparing words, not hashes."""
    first, seen = {}, {}
    for i, text in docs:
        seen[i] = split(text)
        for a, b in runs([len(w) for *_, w in seen[i]]):
            key = tuple(w for s in seen[i][a:b] for w in s[2])
            first[key] = min(first.get(key, (i, a)), (i, a))
    out = {}
    for i, text in docs:
        gone = set()
        for a, b in runs([len(w) for *_, w in seen[i]]):
            if first[tuple(w for s in seen[i][a:b] for w in s[2])] != (i, a):
                gone |= set(range(a, b))
        lead = text[: seen[i][0][0]] if seen[i] else text
        out[i] = lead + "".join(text[a:b] for k, (a, b, _) in enumerate(seen[i]) if k not in gone), len(gone), len(seen[i])
    return out


@pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")
def test_query_against_plain_code(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = plain(docs)
    texts = dict(docs)
    for r in queries.op8_sentence_dedup(spark, SF).collect():
        assert (r.text, r.n_removed, r.n_sentences) == want[r.doc_id]
        cut = [texts[r.doc_id][s.start : s.end] for s in r.removed_spans]
        assert sum(map(len, cut)) == len(texts[r.doc_id]) - len(r.text)
    assert sum(n for _, n, _ in want.values())


def test_made_up_texts_against_plain_code(spark):
    r = random.Random(3)
    parts = [" ".join(r.choice(["ab", "cé", "D", "e.f", "«g»", "h?", 'i."', "j)"]) for _ in range(r.randint(1, 25))) + r.choice([".", "!", "\n", "", ".)", "\t\n"]) + r.choice([" ", "\n\n", ""]) for _ in range(40)]
    docs = [(i, r.choice(["", " ", "\n"]) + "".join(r.choice(parts) for _ in range(r.randint(0, 30)))) for i in range(60)]
    want = plain(docs)
    got = sentence_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: (x.text, x.n_removed, x.n_sentences) for x in got} == want


def prose(seed, sizes):
    r = random.Random(seed)
    return [" ".join(f"w{r.randint(0, 10**6)}" for _ in range(n)) + "." for n in sizes]


def test_passages_that_start_and_end_inside_a_sentence(spark):
    pair, lone, several = prose(1, [18, 14, 16, 18]), prose(2, [15, 29, 14]), prose(3, [20, 3, 9, 2, 20])
    texts, want = [], []
    for shared in (pair, lone, several):
        inner = " ".join(shared[1:-1]) + " "
        texts += [f"Ab {shared[0]} {inner}{shared[-1]}", f"{shared[0].split(' ', 4)[4]} {inner}{shared[-1][:-1]} and more."]
        want += [texts[-2], texts[-1].replace(inner, "")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in sentence_dedup.remove_repeats(docs).collect()}
    assert [got[i].text for i in range(len(texts))] == want
    assert [got[i].n_removed for i in range(len(texts))] == [0, 2, 0, 1, 0, 3]


def test_nulls_repeated_rows_and_clashing_names(spark):
    a, b = " ".join(prose(5, [15, 15])), " ".join(prose(6, [15, 15]))
    long = " ".join(prose(7, [9] * 20_000))
    rows = [(1, a, 7, "x"), (1, a, 7, "x"), (2, a + " Tail.", 7, "y"), (None, b, 7, "z"), (3, b, 7, "z"), (4, None, 7, None), (5, "", 7, ""), (6, long, 7, ""), (7, b + " " + long, 7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_removed int, h_a string")
    got = sorted((tuple(r) for r in sentence_dedup.remove_repeats(docs).select("doc_id", "text", "n_removed", "h_a").collect()), key=str)
    want = [(1, a, 0, "x"), (1, a, 0, "x"), (2, "Tail.", 2, "y"), (None, b, 0, "z"), (3, b, 0, "z"), (4, None, 0, None), (5, "", 0, ""), (6, long, 0, ""), (7, "", 20_002, "")]
    assert got == sorted(want, key=str)
    assert sentence_dedup.remove_repeats(docs.limit(0)).count() == 0
    assert "first_docs" in sentence_dedup.remove_repeats(docs).columns
