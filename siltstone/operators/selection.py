"""Selection under budgets, dominance, due rows and pairs chosen together."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import grams
from siltstone.operators.lineage import cut, in_tasks, new_folder


def fractional_bound(items: DataFrame, group: str, key: str, value: str, weight: str, budget: float) -> DataFrame:
    """The most value of each group's items within a budget if one item may be cut: an upper bound for whole items.

    Values are rounded to 6 digits; items without value don't count, and those without weight count whole.
    """
    worth = items.withColumn("_value", F.round(value, 6)).filter("_value > 0")
    density = F.when(F.col(weight) > 0, F.col("_value") / F.col(weight))
    w = Window.partitionBy(group).orderBy(F.desc_nulls_first("_density"), F.desc("_value"), key).rowsBetween(Window.unboundedPreceding, -1)
    ranked = worth.withColumn("_density", density).withColumn("_before", F.coalesce(F.sum(weight).over(w), F.lit(0)))
    part = F.when(F.col(weight) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (budget - F.col("_before")) / F.col(weight)))).otherwise(F.lit(1.0))
    return ranked.groupBy(group).agg(F.sum(F.col("_value") * part).alias("bound"))


def pareto(rows: DataFrame, group: str, cost: str, gain: str) -> DataFrame:
    """Rows that no row of their group beats: none costs as little or less and gains as much or more, one of them strictly.

    One row for each cost is ordered, and no two rows are paired; equal rows stay together.
    """
    best = rows.groupBy(group, cost).agg(F.max(gain).alias("_best"))
    cheaper = F.max("_best").over(Window.partitionBy(group).orderBy(cost).rowsBetween(Window.unboundedPreceding, -1))
    front = best.withColumn("_cheaper", cheaper).filter(F.col("_cheaper").isNull() | (F.col("_best") > F.col("_cheaper")))
    return rows.join(front.drop("_cheaper"), [group, cost]).filter(F.col(gain) == F.col("_best")).drop("_best")


def claim_due(rows: DataFrame, due: Column, created: str, key: str, limit: int = 32) -> DataFrame:
    """The first limit rows that are due, oldest first."""
    return rows.filter(due).orderBy(created, key).limit(limit)


#: A task counts about so many pairs, which it holds in memory.
TASK_PAIRS = 1_000_000


def chosen_together(traces: DataFrame, trace: str, item: str, reward: str, eta: float = 0.1) -> DataFrame:
    """(a, b, strength, n) for items chosen in the same trace: eta times the rewards' sum. A trace's items are few, as one request chose them.

    Pairs are dealt to as many tasks as there are pairs for, so a task's table of them stays
    small however many traces there are.
    """
    once = cut(traces.groupBy(trace, item).agg(F.max(reward).alias("_reward")))
    many = once.groupBy(trace).count().agg(F.sum(F.expr("count * (count - 1) div 2"))).first()[0]
    x = once.select(trace, F.col(item).alias("a"), "_reward")
    y = once.select(trace, F.col(item).alias("b"))
    pairs = in_tasks(x.join(y, trace).filter("a < b"), many, TASK_PAIRS, "a", "b")
    return pairs.groupBy("a", "b").agg((eta * F.sum("_reward")).alias("strength"), F.count(F.lit(1)).alias("n"))


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    return pairs.orderBy(F.desc(F.abs("strength")), "a", "b").limit(k)


#: A task counts about so many n-grams, which it holds in memory. Of more than PASS_GRAMS, a share is shuffled at a time, up to PASSES.
TASK_GRAMS, PASS_GRAMS, PASSES = 4_000_000, 20_000_000, 4

#: Spark's setting that removes what a query has shuffled once it is done.
_REMOVE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ngram_redundancy(docs: DataFrame, key: str, words: Column, sizes: tuple[int, ...]) -> DataFrame:
    """(key, n, r2, r3, ...): the number of words, and for each size the share of a text's different n-grams that other texts have too; 0 without n-grams.

    N-grams are 64-bit hashes of their words' hashes. A run of texts sends each of its n-grams once,
    with the text's place if just one of them has it, to the task of its range of hashes, which
    gives back how many each text has alone. Larger tables are read once for each of a few shares of
    the hashes, and what a share has shuffled is removed when it is counted, so disk holds a share
    at a time. key is unique.
    """
    spark = docs.sparkSession
    known = docs.select(F.col(key).alias("_key"), F.transform(words, lambda w: F.xxhash64(w)).alias("_w"))
    many = (known.agg(F.sum(F.greatest(F.size("_w"), F.lit(0)))).first()[0] or 0) * len(sizes)
    passes = max(1, min(PASSES, -(-many // PASS_GRAMS)))
    shares = max(1, -(-max(many // TASK_GRAMS, spark.sparkContext.defaultParallelism) // (passes * len(sizes))))
    tasks, kind = shares * len(sizes), known.schema["_key"].dataType.simpleString()

    def sent(number: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Rows for the tasks of the ranges of one pass: a run's hashes and texts; and a row of the run's keys, words and different n-grams."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counter = TaskContext.get().partitionId() << 32
            for batch in batches:
                low = 0
                for some in grams.slices(batch.column("_w")):
                    totals, found = grams.hashed(some, sizes)
                    totals, rows = [totals.astype(np.int64)], []
                    for i, (hashes, text_of) in enumerate(found):
                        kept = grams.share(hashes, shares * passes) % passes == number
                        counts, hashes, text_of = grams.different(hashes[kept], text_of[kept], len(some))
                        totals.append(counts.astype(np.int64))
                        ends = np.searchsorted(grams.share(hashes, shares * passes) // passes, np.arange(shares + 1))
                        rows += [(i * shares + s, i, hashes[a:b].tobytes(), text_of[a:b].tobytes()) for s, (a, b) in enumerate(pairwise(ends.tolist())) if b > a]
                    task, size, data, texts = ([row[c] for row in rows] for c in range(4))
                    task, size = [*task, counter % tasks], [*size, -1]
                    data, texts = [*data, b"".join(x.tobytes() for x in totals)], [*texts, b""]
                    keys = pa.array([None] * len(rows) + [batch.column("_key")[low : low + len(some)].to_pylist()], pa.list_(batch.schema.field("_key").type))
                    yield pa.RecordBatch.from_pydict({"_task": pa.array(task, pa.int32()), "_run": pa.array([counter] * len(task), pa.int64()), "_size": pa.array(size, pa.int32()), "_data": pa.array(data, pa.binary()), "_texts": pa.array(texts, pa.binary()), "_keys": keys})
                    low, counter = low + len(some), counter + 1

        return run

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, np.ndarray, np.ndarray]] = []
        for batch in batches:
            head = pc.equal(batch.column("_size"), -1)
            yield batch.filter(head).select(["_run", "_size", "_data", "_keys"])
            for r in batch.filter(pc.invert(head)).select(["_run", "_size", "_data", "_texts"]).to_pylist():
                held.append((r["_run"], r["_size"], np.frombuffer(r["_data"], np.uint64), np.frombuffer(r["_texts"], np.uint16)))
        if held:
            counts = [x.astype(np.int32).tobytes() for x in grams.alone([h for *_, h, _ in held], [t for *_, t in held])]
            runs, size = pa.array([r for r, *_ in held], pa.int64()), pa.array([s for _, s, *_ in held], pa.int32())
            yield pa.RecordBatch.from_pydict({"_run": runs, "_size": size, "_data": pa.array(counts, pa.binary()), "_keys": pa.nulls(len(held), batch.schema.field("_keys").type)})

    def summed(rows: pa.Table) -> pa.Table:
        head = rows.filter(pc.equal(rows["_size"], -1))
        keys = head["_keys"].combine_chunks().flatten()
        totals = np.frombuffer(head["_data"][0].as_py(), np.int64).reshape(-1, len(keys))
        single = np.zeros((len(sizes), len(keys)), np.int64)
        for size, data in zip(rows["_size"].to_pylist(), rows["_data"].to_pylist(), strict=True):
            if size >= 0:
                x = np.frombuffer(data, np.int32)
                single[size, : len(x)] += x
        return pa.table({"_key": keys, "n": totals[0]} | {f"_t{n}": totals[i + 1] for i, n in enumerate(sizes)} | {f"_a{n}": single[i] for i, n in enumerate(sizes)})

    numbers = ", ".join(f"{c}{n} bigint" for c in ("_t", "_a") for n in sizes)
    before, folder = spark.conf.get(_REMOVE), new_folder(spark, "grams")
    spark.conf.set(_REMOVE, "true")
    try:
        for number in range(passes):
            dealt = known.mapInArrow(sent(number), f"_task int, _run bigint, _size int, _data binary, _texts binary, _keys array<{kind}>").repartitionById(tasks, F.col("_task"))
            counts = dealt.drop("_task").mapInArrow(counted, f"_run bigint, _size int, _data binary, _keys array<{kind}>")
            counts.groupBy("_run").applyInArrow(summed, f"_key {kind}, n bigint, {numbers}").write.parquet(f"{folder}/pass={number}")
    finally:
        spark.conf.set(_REMOVE, before)
    put = spark.read.parquet(*(f"{folder}/pass={number}" for number in range(passes))).groupBy("_key").agg(F.max("n").cast("int").alias("n"), *(F.sum(f"{c}{n}").alias(f"{c}{n}") for c in ("_t", "_a") for n in sizes))
    share = lambda n: F.when(F.col(f"_t{n}") > 0, 1 - F.col(f"_a{n}") / F.col(f"_t{n}")).otherwise(F.lit(0.0))
    return put.select(F.col("_key").alias(key), "n", *(share(n).alias(f"r{n}") for n in sizes))


def greedy_fill(items: DataFrame, group: str, key: str, value: str, weight: str, budget: int, skip_worthless: bool = False) -> DataFrame:
    """items with selected: of each group, from the densest item (value by weight, 1 at least) on, each that still fits the budget; one that doesn't is skipped.

    Ties go to the larger value and then to the smaller key. A group is one request's
    candidates and is folded as one array. With skip_worthless, items of no value stay out.
    """
    density = F.col(value) / F.greatest(F.col(weight), F.lit(1))
    worth = (F.col(value) > 0) if skip_worthless else F.lit(True)
    row = F.struct((-density).alias("d"), (-F.col(value)).alias("v"), F.col(key).alias("k"), F.col(weight).cast("long").alias("w"))
    sorted_items = items.filter(worth).groupBy(group).agg(F.array_sort(F.collect_list(row)).alias("_items"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast(items.select(F.array(F.col(key))).schema[0].dataType).alias("taken"))
    take = lambda a, x: F.when(x["w"] <= a["left"], F.struct((a["left"] - x["w"]).alias("left"), F.concat(a["taken"], F.array(x["k"])).alias("taken"))).otherwise(a)
    taken = sorted_items.select(group, F.explode(F.aggregate("_items", start, take, lambda a: a["taken"])).alias(key), F.lit(True).alias("selected"))
    return items.join(taken, [group, key], "left").withColumn("selected", F.coalesce("selected", F.lit(False)))


#: Cost units of the exact knapsack: budgets beyond it are cut into about so many.
KNAPSACK_UNITS = 1000


def knapsack(items: DataFrame, group: str, key: str, value: str, weight: str, budget: int | str) -> DataFrame:
    """(group, key) of the items of the most value that fit the budget (or the column of that name, one value in a group), exactly for budgets up to 2 * KNAPSACK_UNITS - 1.

    Larger budgets are cut into units of budget // KNAPSACK_UNITS; items under one unit are
    taken at once, and what is over the budget then is taken back from the last item on.
    Values count to four digits. A group (one request's candidates) is one task's work: its
    items times KNAPSACK_UNITS.
    """
    import numpy as np
    import pandas as pd

    column = [budget] if isinstance(budget, str) else []

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        most = int(rows[budget].iloc[0]) if column else budget
        unit = max(1, most // KNAPSACK_UNITS)
        rows = rows.sort_values(key, kind="stable")
        weights, values = rows[weight].to_numpy(np.int64), (rows[value].to_numpy(np.float64) * 10_000).astype(np.int64)
        cost = weights // unit
        free = np.flatnonzero(cost == 0)
        paid = np.flatnonzero((cost > 0) & (cost <= most // unit))
        room = max(0, most - int(weights[free].sum())) // unit
        picked = []
        if room and len(paid):
            best, kept = np.zeros(room + 1, np.int64), np.zeros((len(paid), room + 1), bool)
            for i, p in enumerate(paid):
                c = int(cost[p])
                if c <= room:
                    other = best[: room + 1 - c] + values[p]
                    kept[i, c:] = other > best[c:]
                    best[c:] = np.maximum(best[c:], other)
            w = room
            for i in range(len(paid) - 1, -1, -1):
                if kept[i, w]:
                    picked.append(int(paid[i]))
                    w -= int(cost[paid[i]])
        chosen = [*free.tolist(), *picked]
        while len(chosen) > len(free) and weights[chosen].sum() > most:
            chosen.pop()
        return rows.iloc[sorted(chosen)][[group, key]]

    from pyspark.sql import types as T

    schema = T.StructType([items.schema[group], items.schema[key]])
    return items.select(group, key, value, weight, *column).groupBy(group).applyInPandas(choose, schema)


def module_diversity(candidates: DataFrame, selected: DataFrame, group: str, module: str, relevance: str) -> DataFrame:
    """candidates with gain: relevance by one more than the group's selected rows of the same module."""
    same = selected.groupBy(group, module).agg(F.count(F.lit(1)).alias("_same"))
    return candidates.join(same, [group, module], "left").withColumn("gain", F.col(relevance) / (1 + F.coalesce("_same", F.lit(0)))).drop("_same")


def resonance_bonus(pairs: DataFrame, candidates: DataFrame, selected: DataFrame, item: str) -> DataFrame:
    """(item, bonus): the mean strength of a candidate's pairs (a, b, strength, n) with selected items, those seen often counting more; 0 without any."""
    both = pairs.select("a", "b", "strength", "n").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "strength", "n"))
    mine = both.join(selected.select(F.col(item).alias("b")), "b", "left_semi").withColumn("_w", 1 - 1 / (1 + F.col("n")))
    sums = mine.groupBy(F.col("a").alias(item)).agg((F.sum(F.col("_w") * F.col("strength")) / F.sum("_w")).alias("_bonus"))
    return candidates.select(item).join(sums, item, "left").select(item, F.coalesce("_bonus", F.lit(0.0)).alias("bonus"))


#: Cuts of a 64-bit fingerprint into six blocks.
_CUTS = (0, 11, 22, 33, 44, 54, 64)


def near_copies(docs: DataFrame, key: str, fingerprint: str, most: int = 3) -> DataFrame:
    """(key, duplicate_of): rows in the order of their keys; one within most (3 or fewer) bits of an earlier row that is kept is its duplicate and isn't kept itself, null for kept rows.

    Rows of one fingerprint are one class, whose least key stands for it. Two fingerprints
    that differ in three bits agree in three of six blocks, so each of the twenty choices of
    blocks is one join on half of the bits, which stays small for billions of rows. Rows are
    settled round by round once all near earlier ones are, by a checkpointed table each.
    """
    from itertools import combinations

    from siltstone.operators.lineage import cut

    f = F.col(fingerprint)
    classes = cut(docs.groupBy(fingerprint).agg(F.min(key).alias("k")))
    block = lambda i: F.shiftrightunsigned(F.shiftleft(f, 64 - _CUTS[i + 1]), 64 - _CUTS[i + 1] + _CUTS[i])
    keys = F.array(*(F.xxhash64(F.lit(n), *(block(i) for i in three)) for n, three in enumerate(combinations(range(6), 3))))
    tables = classes.select("k", f.alias("f"), F.explode(keys).alias("t"))
    x, y = tables.alias("x"), tables.alias("y")
    near = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.k") < F.col("y.k")) & (F.bit_count(F.col("x.f").bitwiseXOR(F.col("y.f"))) <= most))
    edges = cut(near.select(F.col("x.k").alias("a"), F.col("y.k").alias("b")).distinct())
    state = classes.select("k", F.lit(None).cast("boolean").alias("kept"), F.lit(None).cast(docs.schema[key].dataType).alias("of"))
    while True:
        seen = edges.join(state.select(F.col("k").alias("a"), F.col("kept").alias("_kept")), "a").groupBy("b").agg(F.min(F.when(F.col("_kept"), F.col("a"))).alias("_of"), F.count_if(F.col("_kept").isNull()).alias("_open"), F.min(F.when(F.col("_kept").isNull(), F.col("a"))).alias("_next"))
        joined = state.join(seen, F.col("k") == F.col("b"), "left")
        # settled once a kept earlier row is near with no open one before it, or none is open
        hit = F.col("_of").isNotNull() & (F.col("_next").isNull() | (F.col("_of") < F.col("_next")))
        free = F.coalesce(F.col("_open"), F.lit(0)) == 0
        kept = F.when(F.col("kept").isNotNull(), F.col("kept")).when(hit, False).when(free, True)
        state = cut(joined.select("k", kept.alias("kept"), F.coalesce("of", F.when(hit, F.col("_of"))).alias("of")))
        if not state.filter("kept IS NULL").limit(1).count():
            break
    least = classes.join(state, "k").select(F.col(fingerprint).alias("_f"), F.col("k").alias("_lead"), F.col("of").alias("_of"))
    out = docs.join(least, F.col(fingerprint).eqNullSafe(F.col("_f")), "left")
    return out.select(key, F.coalesce("_of", F.when(F.col(key) != F.col("_lead"), F.col("_lead"))).alias("duplicate_of"))
