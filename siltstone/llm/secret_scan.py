"""Secret scans by patterns and a battery of randomness tests (operator 2).

Beyond the fixed patterns, every run of 20 or more characters of the base64 alphabets is a
candidate, with the padding at its end; a '=' inside parts a name from its value. Its encoding is inferred (hex of any case, base32 and base36 of either case, base64; lower-case base32 and
base36 only with a digit, as else it may be a word) and its symbols are tested for
uniformity (chi-squared over eight or nine equal cells of the alphabet), for runs above and below the
alphabet's middle and for lag-1 serial correlation; the battery's p-value is 1 - (1 - p)^EFFECTIVE_TESTS
for the least p of the three, as they depend on each other a little. The number of runs takes few values in short strings, so it is judged
by its exact distribution, and equal numbers are put in an order by a hash of the string. A
random secret then has a p-value spread about evenly; words and identifiers pile up near 0.
The chi-squared statistic is held against those of DRAWS random strings of the same length for
the same reason, which a fixed seed draws.

False discoveries are controlled in each stratum of encoding and length: of the candidates
with p >= t those that evenly spread p-values (estimated from p > 1/4, beyond the words) don't
account for are false; t is the least twentieth with an estimated share of them of MAX_FALSE at most. Each
different string counts once, however many copies it has, and all its copies are judged alike.
Candidates that overlap a span of the patterns count here too, but aren't reported again.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.llm._cluster import bounded, stash

# Fixed values of the base scan.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}

KINDS = ("assign", "access", "hex", "random")
MAX_FALSE = 0.05
BINS = 20

#: Bins from this one on (p of 1/4) tell how many random strings each bin has.
EVEN_FROM = 5

#: How many independent tests the three are worth: fitted to random strings of four alphabets and 22 to 200 characters (2.5 to 2.8).
EFFECTIVE_TESTS = 2.62

#: Numbers of runs are judged exactly in strings of up to so many changes.
EXACT_RUNS = 256

#: Random strings that the chi-squared statistic of strings of one length is held against.
DRAWS = 8192

#: Stratum edges of candidate lengths.
LENGTHS = (20, 24, 32, 48, 96)

_ASSIGN = re.compile(ASSIGN, re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}(?:=+(?![A-Za-z0-9+/_=-]))?")
_BASE64 = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")} | {"-": 62, "_": 63}
_BASE32 = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")}
_BASE36 = {c: i for i, c in enumerate("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")}
_LOWER32 = {c.lower(): i for c, i in _BASE32.items()}
_LOWER36 = {c.lower(): i for c, i in _BASE36.items()}
_HEXES = {c: int(c, 16) for c in "0123456789abcdefABCDEF"}

#: (number in strata, symbols, cells, values) of the alphabets, the first that has all symbols of a candidate is inferred.
_ALPHABETS = ((16, 16, 8, _HEXES), (32, 32, 8, _BASE32), (33, 32, 8, _LOWER32), (36, 36, 9, _BASE36), (37, 36, 9, _LOWER36), (64, 64, 8, _BASE64))
_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    # access and hex matches are whole runs, so a shortest length in the pattern finds the same ones
    found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _upper_normal(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


@lru_cache(EXACT_RUNS)
def _tails(n: int) -> tuple[list[float], list[float]]:
    """For |changes - n / 2| in halves: the probability of a greater one and of the same one, for n fair coins."""
    beyond, same = [0.0] * (n + 1), [0.0] * (n + 1)
    for k in range(n + 1):
        same[abs(2 * k - n)] += math.comb(n, k) / 2**n
    for d in range(n - 1, -1, -1):
        beyond[d] = beyond[d + 1] + same[d + 1]
    return beyond, same


def _p_runs(changes: int, n: int, key: int) -> float:
    """Two-sided p-value of the changes between neighbours out of n."""
    if n > EXACT_RUNS:
        return 2 * _upper_normal(abs(changes - n / 2) / (math.sqrt(n) / 2))
    beyond, same = _tails(n)
    d = abs(2 * changes - n)
    return beyond[d] + same[d] * ((key & 0xFFFFFFFF) + 0.5) / 2**32


@lru_cache(4 * EXACT_RUNS)
def _even_squares(n_cells: int, n: int) -> np.ndarray:
    """Sums of squared cell counts of DRAWS random strings, sorted; always the same ones."""
    draws = np.random.RandomState(1000 * n_cells + n).multinomial(n, [1 / n_cells] * n_cells, DRAWS)
    return np.sort((draws.astype(np.int64) ** 2).sum(axis=1))


def _p_uniform(squares: int, n_cells: int, n: int, key: int) -> float:
    """Upper p-value of the chi-squared statistic, by its sum of squared counts."""
    if n > EXACT_RUNS:
        free = n_cells - 1
        chi = max(squares * n_cells / n - n, 0)
        return _upper_normal(((chi / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free)))
    null = _even_squares(n_cells, n)
    first, last = np.searchsorted(null, squares), np.searchsorted(null, squares, side="right")
    return float(DRAWS - last + (last - first) * (((key >> 32) & 0xFFFFFFFF) + 0.5) / 2**32) / DRAWS


def string_key(token: str) -> int:
    """64 bits that stand for a string."""
    return int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little", signed=True)


def battery(token: str, key: int | None = None) -> tuple[int, float]:
    """(number of the inferred alphabet, p-value) of a candidate; key is its string_key(), if that is known."""
    key = string_key(token) if key is None else key
    body = token.rstrip("=")
    symbols = set(body)
    for kind, size, n_cells, table in _ALPHABETS:
        if symbols <= table.keys() and not (kind in (33, 37) and not _DIGIT.search(body)):
            break
    else:
        return 64, 0.0
    values = [table[c] for c in body]
    n = len(values)
    if n < LENGTHS[0]:
        return kind, 0.0
    cells = [0] * n_cells
    for v in values:
        cells[v * n_cells // size] += 1
    p_uniform = _p_uniform(sum(c * c for c in cells), n_cells, n, key)
    above = [2 * v >= size for v in values]
    runs = 1 + sum(a != b for a, b in zip(above, above[1:]))
    p_runs = _p_runs(runs - 1, n - 1, key)
    mean = (size - 1) / 2
    spread = (size * size - 1) / 12
    serial = sum((a - mean) * (b - mean) for a, b in zip(values, values[1:])) / spread
    p_serial = 2 * _upper_normal(abs(serial) / math.sqrt(n - 1))
    least = min(p_uniform, p_runs, p_serial, 1.0)
    return kind, 1 - (1 - least) ** EFFECTIVE_TESTS


_FREE = T.StructField("free", T.BooleanType())
_CANDIDATES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("stratum", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("key", T.LongType()), _FREE]))
_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


_TESTED = T.StructType([T.StructField("base", _SPANS), T.StructField("found", _CANDIDATES)])
_TESTED_ARROW = pa.struct([("base", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))), ("found", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("bin", pa.int32()), ("key", pa.int64()), ("free", pa.bool_())])))])


@F.arrow_udf(_TESTED)
def _tested(texts: pa.Array) -> pa.Array:
    out = []
    for text in texts:
        text = text.as_py() or ""
        base = base_spans(text)
        starts = [s for _, s, _ in base]
        reach = list(accumulate((e for *_, e in base), max))
        found = []
        for m in _CANDIDATE.finditer(text):
            before = bisect_left(starts, m.end())
            key = string_key(m[0])
            kind, p = battery(m[0], key)
            length = sum(m.end() - m.start() >= edge for edge in LENGTHS)
            free = not before or reach[before - 1] <= m.start()
            found.append({"start": m.start(), "end": m.end(), "stratum": kind * 10 + length, "bin": min(BINS - 1, int(p * BINS)), "key": key, "free": free})
        out.append({"base": [{"kind": k, "start": s, "end": e} for k, s, e in base], "found": found})
    return pa.array(out, _TESTED_ARROW)


def candidates(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """keep columns, base (spans of the patterns) and found (tested candidates; free: no base span overlaps them) of each row."""
    return bounded(docs).select(*keep, _tested(text_col).alias("_x")).select(*keep, "_x.base", "_x.found")


def thresholds(tested: DataFrame, max_false: float = MAX_FALSE) -> dict[int, int]:
    """The least bin that counts as random in each stratum that has one; from counts of different strings by stratum and bin, 600 rows at most."""
    counts: dict[int, list[int]] = {}
    # bin 0 never passes and counts nowhere; copies are folded before the shuffle
    strings = tested.select(F.explode("found").alias("c")).filter(F.col("c.bin") > 0).select("c.stratum", "c.bin", "c.key").distinct()
    for r in strings.groupBy("stratum", "bin").count().collect():
        counts.setdefault(r["stratum"], [0] * BINS)[r["bin"]] = r["count"]
    out = {}
    for stratum, bins in counts.items():
        even = sum(bins[EVEN_FROM:]) / (BINS - EVEN_FROM)
        for t in range(1, BINS):
            n = sum(bins[t:])
            if n and max(0.0, n - even * (BINS - t)) <= max_false * n:
                out[stratum] = t
                break
    return out


def scan(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", max_false: float = MAX_FALSE) -> DataFrame:
    """keep columns, base and spans (base and random spans by start and kind) of each row.

    Offsets are code points, ends exclusive. Null and empty texts have no spans; repeated rows
    have equal ones. An empty table has no strata and gives an empty result.
    """
    tested = stash(candidates(docs, keep, text_col), "candidates")
    limits = thresholds(tested, max_false)
    least = F.create_map(*(F.lit(x) for pair in limits.items() for x in pair)) if limits else None
    passed = F.filter("found", lambda c: c["free"] & (c["bin"] >= F.coalesce(least[c["stratum"]], F.lit(BINS)))) if limits else F.filter("found", lambda c: F.lit(False))
    random = F.transform(passed, lambda c: F.struct(c["start"].alias("start"), F.lit(3).alias("rank"), F.lit("random").alias("kind"), c["end"].alias("end")))
    ranked = F.transform("base", lambda s: F.struct(s["start"].alias("start"), (F.array_position(F.array(*(F.lit(k) for k in KINDS)), s["kind"]) - 1).cast("int").alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
    spans = F.transform(F.array_sort(F.concat(ranked, random)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return tested.select(*keep, "base", spans.alias("spans"))


def joined(spans: str) -> F.Column:
    """kind:start:end of spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, mask: str = "[SECRET]", max_false: float = MAX_FALSE) -> DataFrame:
    """The rows of docs with each found span (overlapping ones as one) replaced by mask and n_chars, if there is one, counted anew.

    The values of assignments are masked with their names. Texts without spans, null texts and
    other columns stay as they are.
    """
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)))
    at = names.index("text")
    count = names.index("n_chars") if "n_chars" in names else None
    scanned = scan(plain, tuple(plain.columns), f"_c{at}", max_false)

    @F.arrow_udf(T.StringType())
    def masked(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for text, first, last in zip(texts, starts.to_pylist(), ends.to_pylist()):
            text = text.as_py()
            parts, done = [], 0
            for s, e in sorted(zip(first, last)):
                if s >= done:
                    parts += [text[done:s], mask]
                done = max(done, e)
            out.append("".join(parts) + text[done:])
        return pa.array(out, pa.string())

    # only rows with spans send their texts
    some = F.size("spans") > 0
    text = F.when(some, masked(F.when(some, F.col(f"_c{at}")).otherwise(F.lit("")), F.col("spans.start"), F.col("spans.end"))).otherwise(F.col(f"_c{at}"))
    out = scanned.withColumn("_masked", text)
    value = {at: F.col("_masked")}
    if count is not None:
        value[count] = F.when(some, F.char_length("_masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(f"_c{count}"))
    return out.select(*(value.get(i, F.col(f"_c{i}")).alias(c) for i, c in enumerate(names)))
