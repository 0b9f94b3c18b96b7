"""Every query over the small tables: against SQL where there is some, against plain code elsewhere."""

import base64
import hashlib
import os
import random
import re
import zlib

import duckdb
import pytest

from siltstone.llm import queries

SF = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the driver's tables")


def rows_of(df, order="doc_id"):
    return [r.asDict(recursive=True) for r in df.orderBy(order).collect()]


@pytest.fixture(scope="module")
def documents(spark):
    return rows_of(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(dict(zip(names, r))[c] for c in sorted(names)) for r in cursor.fetchall()), key=repr)
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted((tuple(r) for r in got.select(*sorted(names)).collect()), key=repr) == want


def test_secrets(spark, documents):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
    for r, d in zip(rows_of(queries.op2_secret_scan(spark, SF)), documents):
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(d["text"]) if len(m[2]) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", d["text"]) if len(m[0]) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", d["text"]) if len(m[0]) >= 24]
        spans = [s[2] for s in sorted(spans)]
        assert r["base_sha256"] == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert set(spans) <= set(r["spans"].split(",") if r["spans"] else [])
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s.startswith(k) for s in spans) for k in ("assign", "access", "hex")]


def test_order_minhash(spark, documents):
    by = {d["doc_id"]: d["text"] for d in documents}
    ids = sorted(by, reverse=True)
    for r in rows_of(queries.op3_order_minhash(spark, SF)):
        text = by[r["doc_id"]]
        after = by[ids[(ids.index(r["doc_id"]) + 1) % len(ids)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        if text == after:
            assert r["near_next"] == 1


def test_token_files(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start = 0
    for r, d in zip(rows_of(queries.op6_token_files(spark, SF)), documents):
        ids = t.encode(d["text"], add_special_tokens=False).ids + [1]
        crc = zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d["doc_id"], start, len(ids), crc)
        start += len(ids)


def test_language(spark, documents):
    found = rows_of(queries.op7_language_id(spark, SF))
    for r, d in zip(found, documents):
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [(r["lang_pred"], d["lang"]) for r, d in zip(found, documents) if r["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_quality(spark):
    """On the middle tables: the small ones hold out 19 labelled documents only."""
    labels = {r["doc_id"]: r["quality"] for r in rows_of(spark.read.parquet(f"{MIDDLE}/labels.parquet"))}
    good = {True: [], False: []}
    for r in rows_of(queries.op9_line_quality(spark, MIDDLE)):
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
        if r["doc_id"] in labels:
            good[r["held_out"]].append(r["predicted"] == labels[r["doc_id"]])
    # rows that were never learned from count for themselves
    assert len(good[True]) >= 50 and sum(good[True]) >= 0.9 * len(good[True])
    assert sum(good[False]) >= 0.9 * len(good[False])


def test_archive_bytes_parse_as_warc(spark, tmp_path):
    from siltstone.llm import warc

    r = random.Random(1)
    big = "é" * 100_000
    pages = [(i, f"http://x/{i}\r\nX: y", r.choice(["a", "bb", big, ""]), 1) for i in range(12)] + [(12, None, None, 1), (None, "u", "z", 1), (13, "u", "solo", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, chunk int")
    warc.write_archive(df, str(tmp_path / "w"), chunk_bytes=1000)
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    payload = {i: (h or "").encode() for i, _, h, _ in pages}
    last = {}
    for i, p in payload.items():
        last[p] = max(last.get(p, -1), -1 if i is None else i)
    for x in got:
        p = payload[x.page_id]
        assert x.intact and x.payload_bytes == len(p)
        assert x.payload_digest == base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert x.refers_to == (None if x.page_id in (None, last[p]) else last[p])
        assert x.record_type == ("response" if x.refers_to is None else "revisit")
    assert len(got) == len(pages)
    chunks = spark.read.parquet(str(tmp_path / "w")).orderBy("copy", "chunk").collect()
    archive = b"".join(bytes(c.data) for c in chunks)
    at = n = 0
    while at < len(archive):
        end = archive.index(b"\r\n\r\n", at)
        fields = dict(line.split(b": ", 1) for line in archive[at:end].split(b"\r\n")[1:])
        body = archive[end + 4 : end + 4 + int(fields[b"Content-Length"])]
        if fields[b"WARC-Type"] == b"response":
            content = body.partition(b"\r\n\r\n")[2]
            assert b"sha1:" + base64.b32encode(hashlib.sha1(content).digest()) == fields[b"WARC-Payload-Digest"]
        at = end + 4 + len(body)
        assert archive[at : at + 4] == b"\r\n\r\n"
        at, n = at + 4, n + 1
    assert n == len(pages)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_windows(spark, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d["doc_id"]: t.encode(d["text"], add_special_tokens=False).ids + [0] for d in documents}
    rows, places = {}, {}
    for r in rows_of(queries.op12_window_packing(spark, SF)):
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own)
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own[r["start"] : r["start"] + r["length"]]))
        rows.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts, most in [(x, None) for x in rows.values()] + [(x, 1024) for x in places.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert most is None or at <= most
    assert {k: sum(n for _, n in x) for k, x in rows.items()} == {k: len(x) for k, x in ids.items()}
    sizes = [sum(n for _, n in x) for x in places.values()]
    assert sum(1024 - n for n in sizes if n & (n - 1)) <= 0.002 * sum(sizes)
