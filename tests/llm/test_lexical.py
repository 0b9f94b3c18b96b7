import math
import random
import re
from collections import Counter

import pytest

from siltstone.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def plain(rows, items, k):
    """Scores of all documents for all items."""
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    big_n, big_l = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    w = {t: math.floor(1000 * math.log((2 * big_n + 2) / (2 * d + 1))) for t, d in df.items()}
    out = []
    for item in {i for i, _ in items}:
        asked = {t for i, text in items if i == item for t in terms(text)}
        scored = []
        for i, c, n in docs:
            m = 50 + (50 * n * big_n) // big_l
            score = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(scored)[:k], 1)]
    return out


def answers(found):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in found.collect()), key=repr)


@pytest.fixture
def corpus(spark):
    r = random.Random(6)
    words = ["the", "of", "Ünder", "and7", "rare", "x", "中文", "it's"] + [f"w{i}" for i in range(60)]
    weights = [40, 30, 8, 8, 1, 5, 3, 3] + [1] * 60
    rows = [(i, " ".join(r.choices(words, weights, k=r.choice([1, 3, 30, 200])))) for i in range(300)]
    rows += [(1000 + i, "the same copy of and7 w3") for i in range(90)]
    rows += [(400, None), (401, ""), (402, " .,- "), (None, "rare rare w1"), (7, "rare the"), (7, "rare the"), (403, "rare " * 5000)]
    items = [(1, "The RARE w3, w3"), (2, "and7 of the copy"), (3, None), (4, "unseen"), (5, ""), (None, "Ünder 中文"), (1, "w9"), (6, "w1 w2 w3 w4 w5 the of")]
    return rows, items


def test_search_against_all_scores(spark, corpus, monkeypatch):
    rows, items = corpus
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, score int, query string").repartition(3)
    asked = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, doc_id string")
    for k in (1, 10, 50):
        assert answers(lexical.ranked_search(docs, asked, k)) == sorted(plain(rows, items, k), key=repr)
    # many blocks, and items looked for two at a time
    monkeypatch.setattr(lexical, "QUERIES_AT_ONCE", 2)
    assert answers(lexical.ranked_search(docs.repartition(40), asked, 10)) == sorted(plain(rows, items, 10), key=repr)


def test_empty_tables(spark, corpus):
    rows, items = corpus
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    asked = spark.createDataFrame(items, "item_id long, text string")
    for d, q in ((docs.limit(0), asked), (docs, asked.limit(0)), (docs.filter("text is null"), asked)):
        found = lexical.ranked_search(d, q)
        assert found.columns == ["item_id", "rank", "doc_id", "score"] and found.count() == 0


def test_bytes_bound_impacts():
    import numpy as np

    tf, m = np.arange(1, 5000), np.full(4999, 50)
    impact = lexical._impacts(tf, m)
    byte = -(-impact // lexical.STEP)
    assert byte.max() <= 255 and (byte * lexical.STEP >= impact).all() and ((byte - 1) * lexical.STEP < impact).all()
