import bisect
import random
import zlib

import public_tokenizers
from tokenizers import Tokenizer

from siltstone.llm import packing
from siltstone.llm._tokens import WordEncoder, default_vocabulary


def best_fit_decreasing(counts, capacity):
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        bisect.insort(gaps, gap - n)
    return len(gaps)


def test_plan_places_every_item_and_no_bin_overflows():
    r = random.Random(5)
    for capacity in (10, 64, 2048):
        for _ in range(60):
            counts = {r.randint(1, capacity): r.randint(1, 40) for _ in range(r.randint(1, 30))}
            bins = packing.plan_bins(counts, capacity)
            got = {}
            for many, content in bins:
                assert many > 0 and sum(n * k for n, k in content) <= capacity
                assert sum(k for n, k in content if 3 * n > capacity) <= 2
                for n, k in content:
                    got[n] = got.get(n, 0) + many * k
            assert got == counts
            assert sum(b[0] for b in bins) <= best_fit_decreasing(counts, capacity) * 1.02 + 1


def test_pairs_of_large_items_are_matched():
    assert sum(b[0] for b in packing.plan_bins({6: 3, 4: 3}, 10)) == 3
    assert sum(b[0] for b in packing.plan_bins({5: 4}, 10)) == 2
    assert packing.plan_bins({}, 10) == []


def test_words_encode_like_whole_texts():
    r = random.Random(1)
    letters = list("aAbß éİΣς.,'s12!?<|>\n\t ́\x1c\x85—中") + ["<|endoftext|>", "<|ENDOFTEXT|>", "don't ", "It's. ", "word, "]
    encoder = WordEncoder.load(default_vocabulary())
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    for text, whole in zip(texts, encoder.whole(texts)):
        assert encoder.encode(text) == whole


def test_pack_against_the_library(spark):
    words = "alpha beta gamma delta, epsilon. Zeta éta".split()
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 400, 3000]))), "x", 7) for i in range(40)]
    rows += [(40, None, "x", 7), (41, "", "x", 7), (None, "null id", "x", 7), (3, rows[3][1], "x", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, sequence_id int")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            part = ids[a : a + 2048]
            want.append((i, k, a, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    got = packing.pack_digests(docs).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted([tuple(x)[:5] for x in got], key=key) == sorted(want, key=key)
    by = {}
    for x in got:
        by.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    full = packing.pack(docs)
    for x in packing.sequences(full).collect():
        assert len(x.ids) == 4 * x.length <= 4 * 2048
    assert packing.pack(docs.limit(0)).count() == 0
