import random
import zlib
from collections import Counter

import regex

from siltstone.llm import spelling


def near(u, v):
    """One inserted, deleted or replaced code point, by trying all of them."""
    if len(u) > len(v):
        u, v = v, u
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def plain(counts, ratio=10):
    rows = {}
    for w, n in counts.items():
        around = [(-counts[x], x) for x in counts if near(w, x)]
        best = min(around) if around else None
        rows[w] = (best[1] if best and -best[0] >= ratio * n else None, n, len(around), -best[0] if best and -best[0] >= ratio * n else None)
    out = {}
    for w, (form, n, n_near, form_n) in rows.items():
        root = w
        while rows[root][0]:
            root = rows[root][0]
        out[w] = (form, root, n, n_near, form_n)
    return out


def grouped(spark, counts, **kw):
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    return {r["word"]: tuple(r)[1:] for r in spelling.group_variants(words, **kw).collect()}


def test_variants_against_all_pairs(spark):
    r = random.Random(7)
    for letters, lengths in (("ab", (2, 7)), ("abcdé", (4, 6)), ("aß", (1, 5))):
        counts = {}
        for _ in range(150):
            counts["".join(r.choice(letters) for _ in range(r.randint(*lengths)))] = r.choice([2, 3, 20, 25, 300, 4000])
        want = plain(counts)
        # small blocks: all of them are divided down to one place
        assert grouped(spark, counts, block_words=2) == want
        assert grouped(spark, counts) == want


def test_a_block_that_all_words_share_is_divided(spark):
    counts = {f"commonprefix{a}{b}{c}": 2 + (a == b) * 40 for a in "abcdefgh" for b in "abcdefgh" for c in "abcd"}
    assert grouped(spark, counts, block_words=16) == plain(counts)


def test_chains_and_ties(spark):
    counts = {"aaaaaaa": 2, "aaaaaab": 20, "aaaaabb": 200, "aaaabbb": 2000, "zzzzzzz": 2, "zzzzzzy": 20, "zzzzzzx": 20, "alonewords": 9}
    got = grouped(spark, counts)
    assert got["aaaaaaa"] == ("aaaaaab", "aaaabbb", 2, 1, 20)
    assert got["zzzzzzz"] == ("zzzzzzx", "zzzzzzx", 2, 2, 20)
    assert got["alonewords"] == (None, "alonewords", 9, 0, None)
    assert got == plain(counts)


def test_words_of_texts(spark):
    rows = [
        (1, "Stream STREAM-lines; Übergrößen übergrößen ÜBERGRÖSSEN", "x"),
        (2, None, "x"),
        (3, "", "x"),
        (None, "nullids nullids", "x"),
        (1, "Stream STREAM-lines; Übergrößen übergrößen ÜBERGRÖSSEN", "x"),
        (4, "stromlinie " * 400 + "a" * 5000 + " " + "a" * 5000 + " naïveté×naïveté", "x"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = Counter()
    for i, text, _ in rows:
        for run in regex.findall("[A-Za-zÀ-ÿ]+", text or ""):
            low = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{low}".encode())
            at = h % len(low)
            want[low[:at] + low[at + 1 :] if h % 3 == 0 else low] += 1
    got = {r["word"]: r["n"] for r in spelling.corpus_words(docs, rewrite=spelling.drop_one(3)).collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 7 and n >= 2}
    found = {r["word"]: r["root"] for r in spelling.spelling_variants(docs).collect()}
    assert found["stromlinie"] == "stromlinie" and "a" * 5000 in found
    assert spelling.spelling_variants(docs.limit(0)).count() == 0
