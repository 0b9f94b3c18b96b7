import random
import re

import numpy as np

from siltstone.llm import minmax_dedup


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if len(words) >= k else {tuple(words)}


def brute(rows, k, percent):
    sets = [(i, shingles(t, k)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def make(seed, n):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    texts = []
    for _ in range(n):
        kind = r.random()
        if texts and kind < 0.6:
            new = r.choice(texts).split(" ")
            for _ in range(r.choice([0, 1, 1, 2, 3, 8])):
                new[r.randrange(len(new))] = r.choice(words)
            if r.random() < 0.3:
                new = new[: r.randint(1, len(new))]
        else:
            new = [r.choice(words) for _ in range(r.choice([1, 2, 3, 30, 60, 200]))]
        texts.append(" ".join(new))
    return texts


def test_components_against_all_pairs(spark):
    for k, percent, seed in ((3, 85, 1), (5, 80, 2)):
        rows = list(enumerate(make(seed, 220)))
        r = random.Random(3)
        r.shuffle(rows)
        rows = [(i, t.upper() if i % 7 == 0 else t) for i, t in rows]
        rows += [(1000, None), (1001, ""), (1002, " \n\t"), (1003, None), (1004, "\x1c\x85 "), (1005, "\x1c\x85 ")]
        docs = spark.createDataFrame([(i, t, 5, "z") for i, t in rows], "doc_id long, text string, n_shingles int, band string")
        got = sorted(tuple(x) for x in minmax_dedup.near_duplicates(docs, k, percent).select("doc_id", "n_shingles", "component_id", "kept").collect())
        assert got == brute(rows, k, percent)
        kept = minmax_dedup.keep_one_of_each(docs, k, percent)
        assert kept.columns == docs.columns
        assert sorted(x.doc_id for x in kept.collect()) == [x[0] for x in got if x[3]]


def test_repeated_rows_null_ids_and_no_rows(spark):
    text = " ".join(f"a{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text), (5, text), (9, text), (None, text), (None, None)], "doc_id long, text string")
    got = sorted((tuple(x) for x in minmax_dedup.near_duplicates(docs).collect()), key=str)
    assert got == sorted([(5, 28, 5, True), (5, 28, 5, True), (9, 28, 5, False), (None, 28, None, True), (None, 0, None, True)], key=str)
    assert minmax_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_bands():
    assert minmax_dedup.band_rows(85) == 8
    assert minmax_dedup.band_rows(80) == 6


def test_sketches_never_differ_more_than_sets():
    r = np.random.RandomState(4)
    sets = [np.unique(r.randint(0, 2**62, n).astype(np.uint64)) for n in (0, 1, 30, 400, 3000)]
    sets.append(sets[3][20:])
    offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sketches = minmax_dedup.parity_sketches(np.concatenate(sets), offsets)
    for a, x in zip(sets, sketches):
        for b, y in zip(sets, sketches):
            bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            assert bits <= len(np.setxor1d(a, b))
