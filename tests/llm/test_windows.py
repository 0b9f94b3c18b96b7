import bisect
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from siltstone.llm import windows
from siltstone.llm._spaced import SpacedEncoder


def plain_best_fit(counts, capacity):
    """Room left in each window, piece by piece."""
    rooms = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        at = bisect.bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bisect.insort(rooms, room - n)
    return rooms


def test_tree_finds_the_tightest_room():
    r = random.Random(1)
    tree, held = windows.RoomTree(50), []
    for _ in range(3000):
        if r.random() < 0.5:
            room = r.randint(0, 50)
            tree.push(room, room)
            bisect.insort(held, room)
        n = r.randint(0, 50)
        at = bisect.bisect_left(held, n)
        want = held[at] if at < len(held) else None
        assert tree.tightest(n) == want
        if want is not None and r.random() < 0.6:
            assert tree.pop(want) == held.pop(at)


def test_groups_are_the_windows_of_plain_best_fit():
    r = random.Random(2)
    for capacity in (8, 16, 64, 1024):
        for _ in range(80):
            counts = {r.randint(1, capacity): r.randint(1, 40) for _ in range(r.randint(1, 25))}
            got = sorted(capacity - sum(n * k for n, k in held) for many, held in windows.best_fit_decreasing(counts, capacity) for _ in range(many))
            assert got == plain_best_fit(counts, capacity)


def placed(counts, capacity, gap):
    plan, parts, content = windows.Plan(counts, capacity, gap), {}, {}
    for n, c in counts.items():
        for i, start, size, window, offset in zip(*(x.tolist() for x in plan.place(n, np.arange(c)))):
            parts.setdefault((n, i), []).append((start, size))
            content.setdefault(window, []).append((offset, size))
    return plan, parts, content


def gapless(parts):
    at = 0
    for start, size in sorted(parts):
        assert start == at
        at += size
    return at


def test_plan_covers_each_piece_once_and_leaves_little_room():
    r = random.Random(3)
    for capacity in (8, 64, 1024):
        for gap in (1, 16):
            for _ in range(60):
                counts = {r.randint(1, capacity): r.randint(1, 40) for _ in range(r.randint(1, 25))}
                plan, parts, content = placed(counts, capacity, gap)
                assert {k: gapless(x) for k, x in parts.items()} == {(n, i): n for n, c in counts.items() for i in range(c)}
                assert sorted(content) == list(range(plan.windows))
                for size in map(gapless, content.values()):
                    assert size <= capacity and (capacity - size < gap or not size & (size - 1))


def test_one_length_that_leaves_room_everywhere():
    _, parts, content = placed({600: 1000}, 1024, 16)
    assert len(content) <= -(-600_000 // 1024) + 10
    assert all(gapless(x) == 1024 or not gapless(x) & (gapless(x) - 1) for x in content.values())
    _, parts, _ = placed({512: 1000, 1024: 3}, 1024, 16)
    assert all(len(x) == 1 for x in parts.values())


def test_parts_encode_like_whole_texts():
    r = random.Random(4)
    letters = list("aAbß éİΣς.,'s12!?<|>\n\n\t ́\x1c\x85—中   ①") + ["<|endoftext|>", "don't ", "It's. ", "word, ", "  ", "\n ", " the", "'re"]
    encoder = SpacedEncoder.load(windows.default_vocabulary())
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 20))) for _ in range(8000)] + ["", " ", "\n", "end ", "end\n", " a\nb c"]
    for text, whole in zip(texts, encoder.library.whole(texts)):
        assert encoder.encode(text) == whole, text


def test_pack_against_the_library(spark):
    words = "alpha beta gamma delta, epsilon. Zeta éta\n".split(" ")
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 300, 3000]))), 7, "x") for i in range(60)]
    rows += [(100, None, 7, "x"), (101, "", 7, "x"), (None, "null id", 7, "x"), (3, rows[3][1], 7, "x"), (4, "another text of id 4", 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int, ids string")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sorted((-1 if i is None else i, *(t.encode(text or "", add_special_tokens=False).ids + [0])) for i, text, *_ in rows)
    full = windows.pack(docs).collect()
    whole, own = {}, {}
    for x in full:
        assert len(x.ids) == 4 * x.length and x.ids_crc32 == zlib.crc32(x.ids)
        own.setdefault(x.sequence_id, []).append((x.offset, x.length))
    digests = sorted((x.doc_id is None, x.doc_id or 0, x.start, x.length, x.doc_tokens) for x in windows.pack_digests(docs).collect())
    assert len(digests) == len(full)
    assert all(gapless(x) <= 1024 for x in own.values())
    # documents with distinct ids can be put together again from their parts
    for x in full:
        if x.doc_id not in (3, 4):
            whole.setdefault(-1 if x.doc_id is None else x.doc_id, []).append((x.start, x.ids))
    got = [(i, *np.frombuffer(b"".join(p for _, p in sorted(parts)), "<u4").tolist()) for i, parts in whole.items()]
    assert sorted(got) == [x for x in want if x[0] not in (3, 4)]
    assert sum(x.length for x in full) == sum(len(x) - 1 for x in want)
    assert windows.pack(docs.limit(0)).count() == 0 and windows.pack_digests(docs.limit(0)).count() == 0
    # digests of whole and of cut pieces
    by = {(x.doc_id, x.start, x.length): x.ids_crc32 for x in windows.pack_digests(docs.filter("doc_id <> 3 and doc_id <> 4")).collect()}
    ids = {i: w[1:] for w in want for i in [w[0]] if i not in (3, 4, -1)}
    for (i, start, n), crc in by.items():
        assert crc == zlib.crc32(np.array(ids[i][start : start + n], "<u4").tobytes())
