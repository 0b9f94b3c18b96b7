"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names; and methods against plain code."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import decontamination, language_id, line_quality, order_minhash, secret_scan, token_files

SF = "/root/testdata/sf0.001"
ODD = "doc_id long, text string, lang string, source string, n_chars long, base string, _text string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join(f"w{r.randint(0, 10**6)}" for _ in range(n))


def odd(spark, schema=ODD):
    """Rows of every odd kind, with columns named as ones that the operators add."""
    long = words(1, 60_000)
    rows = [(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x y"), (None, None), (4, long), (5, "..."), (6, long)]
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), "b", "t") for i, t in rows], schema)


def plain_hits(text, windows, k=13):
    """(words, hit words, items) by looking at every place."""
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, items = set(), set()
    for item, gram in windows:
        for i in range(len(w) - len(gram) + 1):
            if w[i : i + len(gram)] == gram:
                hit |= set(range(i, i + len(gram)))
                items.add(item)
    return len(w), len(hit), sorted(items)


def windows_of(items, k=13):
    out = []
    for i, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out += [(str(i), w[a : a + k]) for a in range(max(1, len(w) - k + 1)) if w]
    return out


@pytest.mark.parametrize("set_bytes", [1 << 20, 700])
def test_decontamination_in_one_and_in_several_passes(spark, set_bytes):
    items = [(1, words(2, 20)), (2, "Only THREE words"), (3, None), (4, ""), (5, words(3, 13)), (6, words(2, 20))]
    texts = [words(4, 9) + " " + items[0][1] + ", " + words(5, 9), "x only three WORDS y", None, "", items[4][1].upper(), words(6, 30), words(6, 30), items[0][1][:-1], "only three words, only three words"]
    docs = spark.createDataFrame([(i // 2, t, {"k": 1}) for i, t in enumerate(texts)], "doc_id long, text string, n_words map<string,int>")
    bench = spark.createDataFrame(items, "item_id int, text string")
    got = decontamination.scan_documents(docs, bench, keep=("doc_id", "text"), set_bytes=set_bytes).collect()
    found = sorted((r.doc_id, r.text or "", r.n_words, sum(s.end - s.start for s in r.hit_spans), r["items"]) for r in got)
    assert found == sorted((i // 2, t or "", *plain_hits(t, windows_of(items))) for i, t in enumerate(texts))
    for r in got:
        for s in r.hit_spans:
            assert (r.text.encode()[s.byte_start : s.byte_end]).decode().split()
    left = {0: words(4, 9) + " , " + words(5, 9), 1: "x  y", 2: None, 3: "", 4: "", 5: words(6, 30), 6: words(6, 30), 7: " " + texts[7].split()[-1], 8: ""}  # neighbouring hits are one span
    cut = [(r.doc_id, r.text) for r in decontamination.remove_spans(docs, bench).collect()]
    assert sorted(cut, key=repr) == sorted([(i // 2, left[i]) for i in left], key=repr)
    cut = [t for _, t in cut]
    assert "x y" not in cut and words(6, 30) in cut
    kept = decontamination.remove_contaminated(docs.withColumn("_hit", F.lit(1)), bench)
    assert kept.columns == ["doc_id", "text", "n_words", "_hit"] and kept.count() == 4
    assert decontamination.scan_documents(docs.limit(0), bench).count() == 0
    none = decontamination.scan_documents(docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.hit_spans for r in none)


def test_secret_spans_by_length_and_kind(spark):
    """Planted random keys are found, long words and names hardly ever."""
    r = random.Random(7)
    kinds = {"base64": string.ascii_letters + string.digits + "+/", "base32": string.ascii_uppercase + "234567", "hex": "0123456789abcdef"}
    rows, truth = [], []
    for kind, alphabet in kinds.items():
        for n in (22, 28, 40, 64):
            for _ in range(120):
                token = [r.choice(alphabet) for _ in range(n)]
                if kind == "hex":  # of mixed case, as runs of lower-case hex are found by the patterns
                    token = [c.upper() if i % 9 == 0 or r.random() < 0.5 else c for i, c in enumerate(token)]
                rows.append(f"{words(len(rows), 4)} {''.join(token)} end")
                truth.append(True)
    parts = ["get", "user", "Account", "Manager", "Factory", "internal", "Value", "handler", "Request", "state"]
    for i in range(900):
        rows.append(f"{words(i + 5000, 3)} {''.join(r.choice(parts).capitalize() for _ in range(5))}{i % 7}x end")
        truth.append(False)
    got = {x.doc_id: [s for s in x.spans if s.kind == "random"] for x in secret_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    hits = [i for i in got if got[i]]
    assert sum(truth[i] for i in hits) >= 0.8 * sum(truth)
    assert sum(not truth[i] for i in hits) <= 0.08 * len(hits)


def test_p_values_of_random_keys_are_spread_evenly():
    r = random.Random(8)
    for n in (24, 40, 80):
        p = np.array([secret_scan.battery("".join(r.choice(string.ascii_letters + string.digits + "+/") for _ in range(n)))[1] for _ in range(3000)])
        counts = np.histogram(p, 10, (0, 1.0000001))[0]
        assert counts.min() > 190 and counts.max() < 420, (n, counts)


def test_secret_scan_of_odd_rows(spark):
    docs = odd(spark)
    got = secret_scan.scan(docs).collect()
    assert len(got) == docs.count() and not any(r.spans for r in got)
    masked = secret_scan.redact(docs)
    assert masked.columns == docs.columns and sorted(map(str, masked.collect())) == sorted(map(str, docs.collect()))
    assert secret_scan.scan(docs.limit(0)).count() == 0
    many = "password=abcdef " * 20_000
    one = secret_scan.scan(spark.createDataFrame([(1, many)], "doc_id long, text string")).first()
    assert len(one.base) == 20_000


@pytest.mark.parametrize("kind", ["long", "int", "short"])
def test_edit_fingerprints_of_odd_rows(spark, kind):
    rows = [(5, None), (4, ""), (3, "one two three four"), (3, "one two three four"), (2, "one"), (1, words(9, 300))]
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("fingerprint", F.lit("x")).withColumn("_key", F.lit(1))
    got = order_minhash.fingerprint_edits(docs).orderBy(F.desc("doc_id")).collect()
    texts = [t or "" for _, t in rows]
    for i, r in enumerate(got):
        half = len(texts[i]) // 2
        edited = texts[i][: len(texts[i]) - half] + texts[(i + 1) % len(rows)][:half]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (rows[i][0], len(texts[i]), hashlib.sha256(edited.encode()).hexdigest())
    assert got[2].fingerprint == got[3].fingerprint and got[2].near_next == 1 and got[0].near_next == 1
    assert order_minhash.fingerprint_edits(docs.limit(0)).count() == 0
    alone = order_minhash.fingerprint_edits(docs.filter("doc_id = 2")).first()
    assert alone.near_next == 1


def test_order_of_words_changes_fingerprints_and_near_texts_are_near(spark):
    r = random.Random(11)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(400)]
    swapped = base[200:] + base[:200]
    edited = [*base[:150], "new", *base[150:300], *base[303:]]
    shuffled = r.sample(base, len(base))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate((base, base, edited, swapped, shuffled))], "doc_id long, text string")
    prints = {x.doc_id: np.frombuffer(bytes.fromhex(x.fingerprint), ">u2") for x in order_minhash.fingerprint_table(docs).collect()}
    like = [float((prints[0] == prints[i]).mean()) for i in range(5)]
    assert like[1] == 1 and 1 > like[2] > 0.7 and like[2] > like[3] > like[4]


def test_fingerprints_against_plain_code():
    """Each value is a hash of the two least k-mers under its permutation, in text order: rebuilt here from the shingles one by one."""
    import pyarrow as pa

    from siltstone.llm._textscan import NON_SPACE, Words, mix64

    r = random.Random(12)
    texts = [" ".join(r.choice("abcde") for _ in range(n)) for n in (0, 1, 2, 3, 4, 9, 50)]
    got = order_minhash.fingerprints(pa.array(texts, pa.large_string()))
    for text, row in zip(texts, got):
        data = np.frombuffer(text.encode(), np.uint8)
        hashes = Words(data, np.array([0, len(data)]), NON_SPACE, lower=False).shingles(order_minhash.K)[0].tolist()
        seen, values = {}, []
        for h in hashes:
            values.append(int(mix64(np.array([(h + seen.get(h, 0) * 0xD6E8FEB86659FD93) % 2**64], np.uint64))[0]))
            seen[h] = seen.get(h, 0) + 1
        for i, (a, b) in enumerate(order_minhash._SEEDS.tolist()):
            if not values:
                assert row[i] == 0
                continue
            ranked = []
            for place, v in enumerate(values):
                y = ((v >> 32) ^ a) * (b | 1) % 2**32
                y = (y ^ (y >> 15)) * 0x2C1B3C6D % 2**32
                ranked.append((y ^ (y >> 13), place))
            first = sorted(ranked)[:2]
            x, z = sorted(p for _, p in (first if len(first) == 2 else first * 2))
            pair = (values[x] * 3 + int(mix64(np.array([values[z]], np.uint64))[0])) % 2**64
            assert int(row[i]) == int(mix64(np.array([pair], np.uint64))[0]) >> 48


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 3000])
@pytest.mark.parametrize("step", [0, 1, 3, 1000])
def test_boundaries_by_select_are_those_of_the_plain_list(n, step):
    r = random.Random(n + step)
    values = np.cumsum([r.randint(0, step) for _ in range(n)])
    code = token_files.EliasFano.from_bytes(token_files.EliasFano.build(values).to_bytes())
    assert [code.select(i) for i in range(n)] == values.tolist() == code.values().tolist()
    for _ in range(20):
        a = r.randint(0, n)
        b = r.randint(a, n)
        assert code.select_range(a, b).tolist() == values[a:b].tolist()


def test_token_files_of_odd_rows_and_several_blocks(spark, tmp_path, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    docs = odd(spark).repartition(3)
    token_files.write_token_files(docs, str(tmp_path / "t"))
    got = token_files.read_token_files(spark, str(tmp_path / "t")).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    start = 0
    for r, (i, text) in zip(got, rows):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert zlib.crc32(bytes(r.ids)) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(got) == len(rows)
    blocks = spark.read.parquet(str(tmp_path / "t"))
    data = bytes(blocks.orderBy(F.desc("n_docs")).first().data)
    block = token_files.Block(data)
    assert sum(len(block.document(i)) for i in range(block.n_docs)) == block.n_ids
    token_files.write_token_files(docs.limit(0), str(tmp_path / "e"))
    assert token_files.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_language_of_odd_rows(spark):
    docs = odd(spark)
    out = F.col("doc_id") % 2 == 0
    got = language_id.identify(docs, out).collect()
    assert len(got) == docs.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 5))
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 6)} == {"en"}
    none = language_id.identify(docs.withColumn("lang", F.lit(None).cast("string")), out).collect()
    assert all(r.lang_pred == "und" for r in none)
    assert language_id.identify(docs.limit(0), out).count() == 0


def test_quality_of_odd_rows(spark):
    docs = odd(spark).withColumn("score", F.lit(9)).withColumn("quality", F.lit(1))
    lines = "\n".join(["A good line of words here."] * 3000)
    more = spark.createDataFrame([(10 + i, ["#### |||| $$$$ " * 9, "Some good words, in a line."][i % 2]) for i in range(40)] + [(60, lines), (61, lines)], "doc_id long, text string")
    labels = spark.createDataFrame([(10 + i, i % 2) for i in range(40)] + [(3, 1), (3, 0), (1, None), (60, 1)], "doc_id long, quality int")
    model = line_quality.fit(more, labels, F.lit(True))
    got = line_quality.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    scored = {r.doc_id: r.predicted for r in line_quality.score(more, model).collect()}
    assert all(scored[10 + i] == i % 2 for i in range(40)) and scored[60] == scored[61] == 1
    assert line_quality.fit(more, labels.filter("quality = 1"), F.lit(True)) is None
    assert line_quality.fit(more.limit(0), labels, F.lit(True)) is None
    assert {r.score for r in line_quality.score(docs, None).collect()} == {0.5}
    assert line_quality.score(docs.limit(0), model).count() == 0


def test_stages_of_odd_and_empty_tables(spark):
    docs = odd(spark).withColumn("_hit", F.lit(1)).withColumn("kept", F.lit("k")).withColumn("spans", F.lit("s"))
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF)
        if name == "pack":
            # six texts of ids at least, each with its end
            assert kept.filter("doc_id = 1").first().length == 1
            assert kept.groupBy("doc_id").count().count() == 7
        else:
            assert kept.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
