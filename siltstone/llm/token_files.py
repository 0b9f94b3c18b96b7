"""Token ids in blocks with Elias-Fano document boundaries (operator 6).

A block is one binary value:

    8 bytes   magic "SLTTOK01"
    8 x 8     int64: documents, ids, first id of the block in its shard, null document ids,
              smallest document id, bytes of the Elias-Fano code of the boundaries, of the
              document ids, bytes of an id (2 or 4)
    boundary code, document id code, ids (little-endian)

Blocks are rows of a table (shard, block, n_docs, n_ids, data) that Spark writes with its
own commit protocol, so a lost executor leaves no half-written file; shards follow one
another in document order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._cluster import bounded, shared_dir
from siltstone.llm._tokens import WordEncoder, default_vocabulary

MAGIC = b"SLTTOK01"

#: A block ends with the document that brings it to so many ids.
BLOCK_IDS = 1 << 18

#: A position of every so many-th set bit is kept for select.
SAMPLE = 256

#: Documents whose boundaries are selected at once.
READ_DOCS = 2048

#: Shards, and so rows of totals at the driver, number at most this.
MAX_SHARDS = 8192


class EliasFano:
    """A sequence of integers that never falls, in about 2 + log2(largest / n) bits each.

    The low bits are packed; the high parts are unary in a bit vector, in which the i-th value
    has its bit at high(i) + i. Select uses the sampled positions and then counts bits in bytes.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint32))
        low_bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        bits = np.zeros(int(places[-1]) + 1, np.uint8)
        bits[places] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8)
        pack = lambda b: np.packbits(b, bitorder="little")
        return cls(n, low_bits, pack(low.ravel()), pack(bits), places[::SAMPLE].astype(np.uint32))

    def to_bytes(self) -> bytes:
        head = np.array([self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)], "<u4")
        return head.tobytes() + self.low.tobytes() + self.high.tobytes() + self.samples.astype("<u4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, low_bits, a, b, c = (int(x) for x in np.frombuffer(data, "<u4", 5))
        low = np.frombuffer(data, np.uint8, a, 20)
        high = np.frombuffer(data, np.uint8, b, 20 + a)
        return cls(n, low_bits, low, high, np.frombuffer(data, "<u4", c, 20 + a + b))

    def values(self) -> np.ndarray:
        """All values."""
        if not self.n:
            return np.zeros(0, np.int64)
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)).astype(np.int64)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        low = bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64)) if self.low_bits else 0
        return (high << self.low_bits) + low

    def select_range(self, a: int, b: int) -> np.ndarray:
        """The a-th to the (b - 1)-th value: only the bits between the sampled positions around them are read."""
        if a >= b:
            return np.zeros(0, np.int64)
        s, t = a // SAMPLE, -(-b // SAMPLE)
        start = int(self.samples[s])
        end = int(self.samples[t]) if t < len(self.samples) else 8 * len(self.high)
        bits = np.unpackbits(self.high[start // 8 : (end + 7) // 8], bitorder="little")
        places = np.flatnonzero(bits[start % 8 :])[a - s * SAMPLE : b - s * SAMPLE] + start
        high = places - np.arange(a, b)
        first, last = a * self.low_bits, b * self.low_bits
        packed = np.unpackbits(self.low[first // 8 : (last + 7) // 8], bitorder="little")[first % 8 :][: last - first]
        low = packed.reshape(b - a, self.low_bits).astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64)) if self.low_bits else 0
        return (high << self.low_bits) + low

    def select(self, i: int) -> int:
        """The i-th value, from the sampled position before it and the bits that follow."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        byte, bit = divmod(int(self.samples[i // SAMPLE]), 8)
        need = i % SAMPLE
        ones = int(self.high[byte]) >> bit
        while ones.bit_count() <= need:
            need -= ones.bit_count()
            byte, bit = byte + 1, 0
            ones = int(self.high[byte])
        for _ in range(need):
            ones &= ones - 1
        place = 8 * byte + bit + (ones & -ones).bit_length() - 1
        start = i * self.low_bits
        window = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8].tobytes(), "little")
        return ((place - i) << self.low_bits) | (window >> (start % 8)) & ((1 << self.low_bits) - 1)


def encode_block(doc_ids: list[int | None], ids: list[bytes], first: int) -> bytes:
    """One block. Null document ids come first, the others in ascending order."""
    nulls = sum(d is None for d in doc_ids)
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    least = int(known[0]) if len(known) else 0
    ends = np.cumsum([len(x) // 4 for x in ids])
    bounds = EliasFano.build(ends).to_bytes()
    keys = EliasFano.build((known - least).astype(np.uint64)).to_bytes()
    array = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(array) or int(array.max()) < 1 << 16 else 4
    head = np.array([len(ids), len(array), first, nulls, least, len(bounds), len(keys), width], "<i8")
    return MAGIC + head.tobytes() + bounds + keys + array.astype(f"<u{width}").tobytes()


class Block:
    """Reads a block; document i has ids[end(i - 1):end(i)]."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token block")
        self.n_docs, self.n_ids, self.first, nulls, least, a, b, width = (int(x) for x in np.frombuffer(data, "<i8", 8, 8))
        self.bounds = EliasFano.from_bytes(data[72 : 72 + a])
        keys = EliasFano.from_bytes(data[72 + a : 72 + a + b])
        self.doc_ids = [None] * nulls + [int(x) + least for x in keys.values()]
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, 72 + a + b)

    def document(self, i: int) -> np.ndarray:
        """Ids of the i-th document, by select alone."""
        return self.ids[self.bounds.select(i - 1) if i else 0 : self.bounds.select(i)]


_BLOCKS = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("n_docs", T.LongType()), T.StructField("n_ids", T.LongType()), T.StructField("data", T.BinaryType())])


def write_token_files(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 1, by_word: bool = True, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode each document, append end_id and write all ids in ascending order of id_col.

    A null text is an empty one. Null ids come first; rows with one id follow in the order of
    their texts. Other columns aren't read. An empty table writes no block.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or default_vocabulary()
    shards = min(MAX_SHARDS, max(2, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    keys = [F.col("_id").asc_nulls_first(), F.col("_text").asc_nulls_first()]
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).repartitionByRange(shards, keys[0]).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = WordEncoder.load(vocabulary, by_word), int(end_id).to_bytes(4, "little")
        doc_ids, ids, held, first, block = [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            data = encode_block(doc_ids, ids, first)
            return pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([block], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([held], pa.int64()), pa.array([data], pa.binary())], names=["shard", "block", "n_docs", "n_ids", "data"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                doc_ids.append(doc_id.as_py())
                ids.append(encoder.encode(text.as_py()) + end)
                held += len(ids[-1]) // 4
                if held >= BLOCK_IDS:
                    yield flush()
                    first, block = first + held, block + 1
                    doc_ids, ids, held = [], [], 0
        if ids:
            yield flush()

    rows.mapInArrow(run, _BLOCKS).withColumn("shard", F.spark_partition_id()).write.option("compression", "none").parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents in the files at path: id_col, start (ids before it in all files), n_tokens, ids (little-endian unsigned 32-bit)."""
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    totals = {r["shard"]: r["n"] for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()}  # MAX_SHARDS rows at most
    before, at = {}, 0
    for shard in sorted(totals):
        before[shard] = at
        at += totals[shard]
    schema = T.StructType([T.StructField(id_col, T.LongType()), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                block = Block(data.as_py())
                for at in range(0, block.n_docs, READ_DOCS):
                    to = min(at + READ_DOCS, block.n_docs)
                    ends = block.bounds.select_range(at, to)
                    starts = np.concatenate([[block.bounds.select(at - 1) if at else 0], ends[:-1]])
                    ids = [block.ids[a:b].astype("<u4").tobytes() for a, b in zip(starts, ends)]
                    yield pa.RecordBatch.from_arrays([pa.array(block.doc_ids[at:to], pa.int64()), pa.array(starts + before[shard] + block.first, pa.int64()), pa.array(ends - starts, pa.int64()), pa.array(ids, pa.binary())], names=[id_col, "start", "n_tokens", "ids"])

    return blocks.select("shard", "data").mapInArrow(run, schema)


def round_trip(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Write docs to the shared folder and read them back."""
    path = shared_dir(docs.sparkSession, "tokens")
    write_token_files(docs, path, vocabulary)
    return read_token_files(docs.sparkSession, path)
