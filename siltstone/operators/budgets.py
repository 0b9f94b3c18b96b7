"""Selection under a token budget by a dual price, for all groups at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators import selection
from siltstone.operators.lineage import cut

#: Halvings of the interval of prices, and how many of them one pass over the items decides.
STEPS, STEPS_A_PASS = 30, 3

#: Doublings of the upper price until it leaves room, and how many of them one pass decides.
DOUBLINGS, DOUBLINGS_A_PASS = 60, 6

#: Below this temperature selection is hard.
SOFT = 0.05

#: Most items of a group for which hard selection is exact.
EXACT_ITEMS = 2000

#: Most items of a group whose price is found and that is filled in one go.
GROUP_ITEMS = 100_000


def _sigmoid(x: Column) -> Column:
    x = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), x))
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def _expected(price: Column, tau: float) -> Column:
    """Tokens expected at a price, as an aggregate."""
    return F.coalesce(F.sum(_sigmoid((F.col("score") - price * F.col("tokens")) / tau) * F.col("tokens")), F.lit(0.0))


def dual_prices(items: DataFrame, budgets: DataFrame, temperature: float) -> DataFrame:
    """(group, price, all_fit, failed): the price of a token at which a group's expected tokens are its budget.

    items: (group, key, score, tokens), a written table; budgets: (group, budget). Each item is
    taken with the probability sigmoid((score - price * tokens) / temperature). 0 and all_fit
    where that fits without a price; 0 and failed where no price leaves room. A pass over the
    items is one join with a row for each group and one partial aggregate, whatever the sizes of
    groups; three halvings are decided in each, so 30 take ten passes.
    """
    tau = max(temperature, 1e-4)
    start = items.groupBy("group").agg(_expected(F.lit(0.0), tau).alias("_e"), F.max("score").alias("_s"), F.min(F.col("tokens").cast("double")).alias("_t"))
    state = budgets.select("group", F.col("budget").cast("double").alias("budget")).join(start, "group")
    high = (F.col("_s") + 5 * tau) / F.greatest(F.greatest(F.col("_t"), F.lit(1.0)) * tau, F.lit(1e-10))
    state = cut(state.select("group", "budget", (F.col("_e") <= F.col("budget")).alias("all_fit"), F.lit(0.0).alias("lo"), high.alias("hi"), F.lit(False).alias("found")))
    for _ in range(DOUBLINGS // DOUBLINGS_A_PASS + 1):
        open_groups = state.filter("NOT all_fit AND NOT found")
        if open_groups.isEmpty():
            break
        tried = [(F.col("hi") * 2**i, f"_e{i}") for i in range(DOUBLINGS_A_PASS)]
        sums = items.join(open_groups.select("group", "hi"), "group").groupBy("group").agg(*(_expected(p, tau).alias(n) for p, n in tried))
        joined = state.join(sums, "group", "left")
        first = F.coalesce(*(F.when(F.col(n) < F.col("budget"), p) for p, n in tried))
        state = cut(joined.select("group", "budget", "all_fit", "lo", F.when(F.col("_e0").isNull(), F.col("hi")).otherwise(F.coalesce(first, F.col("hi") * 2**DOUBLINGS_A_PASS)).alias("hi"), (F.col("found") | first.isNotNull()).alias("found")))
    for _ in range(STEPS // STEPS_A_PASS):
        live = state.filter("found")
        # the middles of all intervals that these steps can lead to, from the outermost on
        spans, middles = [(F.col("lo"), F.col("hi"))], []
        for _ in range(STEPS_A_PASS):
            own = [(a + b) * 0.5 for a, b in spans]
            middles.append(own)
            spans = [s for (a, b), m in zip(spans, own) for s in ((a, m), (m, b))]
        sums = items.join(live.select("group", "lo", "hi"), "group").groupBy("group").agg(*(_expected(m, tau).alias(f"_e{d}_{i}") for d, own in enumerate(middles) for i, m in enumerate(own)))
        joined = state.join(sums, "group", "left")

        def walked(depth: int, i: int, side: int) -> Column:
            """lo (side 0) or hi (1) after the rest of the steps, from the i-th interval at this depth."""
            if depth == STEPS_A_PASS:
                return spans[i][side]
            return F.when(F.col(f"_e{depth}_{i}") > F.col("budget"), walked(depth + 1, 2 * i + 1, side)).otherwise(walked(depth + 1, 2 * i, side))

        moved = F.col("_e0_0").isNotNull()
        state = cut(joined.select("group", "budget", "all_fit", F.when(moved, walked(0, 0, 0)).otherwise(F.col("lo")).alias("lo"), F.when(moved, walked(0, 0, 1)).otherwise(F.col("hi")).alias("hi"), "found"))
    return state.select("group", F.when(F.col("found"), (F.col("lo") + F.col("hi")) * 0.5).otherwise(0.0).alias("price"), "all_fit", (~F.col("all_fit") & ~F.col("found")).alias("failed"))


def fill(items: DataFrame, budgets: DataFrame, order: Column, then: Column | None = None) -> DataFrame:
    """(group, key, tokens): items by falling order, each taken if it fits what is left of its group's budget. Ties go by falling then, if given, and by key.

    A round takes the longest start of the order that fits and goes on with the items that fit
    the rest. Sums run first over ranges of the order and then within a range, so a large group
    is not one task's work. items: (group, key, score, tokens) with tokens above 0.
    """
    step = F.least(F.greatest(F.floor(order * 20), F.lit(-800)), F.lit(800)).cast("int")
    left = cut(items.select("group", "key", "tokens", order.alias("_o"), (F.lit(0.0) if then is None else then).alias("_then"), step.alias("_step")))
    rest = budgets.select("group", F.col("budget").cast("long").alias("_rest"))
    taken = None
    while True:
        fitting = left.join(rest, "group").filter(F.col("tokens") <= F.col("_rest"))
        totals = fitting.groupBy("group", "_step").agg(F.sum("tokens").alias("_t"))
        before = F.coalesce(F.sum("_t").over(Window.partitionBy("group").orderBy(F.col("_step").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        # steps that begin beyond the budget have nothing to take now
        near = totals.withColumn("_before", before).select("group", "_step", "_before")
        inner = F.sum("tokens").over(Window.partitionBy("group", "_step").orderBy(F.col("_o").desc(), F.col("_then").desc(), "key"))
        now = fitting.join(near, ["group", "_step"]).filter(F.col("_before") < F.col("_rest")).withColumn("_sum", inner + F.col("_before"))
        now = cut(now.filter(F.col("_sum") <= F.col("_rest")).select("group", "key", "tokens"))
        if now.isEmpty():
            return taken if taken is not None else now
        taken = now if taken is None else taken.unionByName(now)
        spent = now.groupBy("group").agg(F.sum("tokens").alias("_spent"))
        rest = cut(rest.join(spent, "group", "left").select("group", (F.col("_rest") - F.coalesce("_spent", F.lit(0))).alias("_rest")))
        left = cut(left.join(now.select("group", "key"), ["group", "key"], "left_anti"))


def _settled(scores: np.ndarray, tokens: np.ndarray, keys: pa.Array, budget: float | None, tau: float) -> tuple[float, float, np.ndarray]:
    """(price, dual_gap, places of the items taken) of one group, as dual_prices and fill find them."""
    if budget is None:
        return 0.0, 0.0, np.zeros(0, np.int64)

    def expected(price: float) -> float:
        x = np.clip((scores - price * tokens) / tau, -500.0, 500.0)
        e = np.exp(-np.abs(x))
        return float((np.where(x >= 0, 1.0, e) / (1 + e) * tokens).sum())

    if expected(0.0) <= budget:
        return 0.0, 0.0, np.arange(len(scores))
    lo, hi = 0.0, (float(scores.max()) + 5 * tau) / max(max(float(tokens.min()), 1.0) * tau, 1e-10)
    tries = (DOUBLINGS // DOUBLINGS_A_PASS + 1) * DOUBLINGS_A_PASS
    found = next((hi * 2.0**i for i in range(tries) if expected(hi * 2.0**i) < budget), None)
    price, order = 0.0, scores / tokens
    if found is not None:
        hi = found
        for _ in range(STEPS):
            middle = (lo + hi) * 0.5
            lo, hi = (middle, hi) if expected(middle) > budget else (lo, middle)
        price = (lo + hi) * 0.5
        order = (scores - price * tokens) / tau
    falling = -np.where(np.isnan(order), np.inf, order)
    places = pc.sort_indices(pa.table({"o": falling, "key": keys}), sort_keys=[("o", "ascending"), ("key", "ascending")], null_placement="at_start").to_numpy()
    left, least, taken = int(budget), tokens.min(), []
    for place, n in zip(places.tolist(), tokens[places].tolist()):
        if n <= left:
            taken.append(place)
            left -= n
            if left < least:
                break
    taken = np.array(taken, np.int64)
    if found is None:
        return 0.0, 0.0, taken
    bound = float((tau * np.where(order > 20, order, np.log1p(np.exp(np.minimum(order, 20.0))))).sum())
    return price, max(0.0, bound + price * budget - float(scores[taken].sum())), taken


def _in_groups(items: DataFrame, budgets: DataFrame, temperature: float) -> tuple[DataFrame, DataFrame]:
    """soft_selection for groups of up to GROUP_ITEMS items: items are shuffled once, and each group is settled where it lies."""
    tau, fields = max(temperature, 1e-4), items.schema
    kinds = {f.name: f.dataType.simpleString() for f in fields}
    own = ("key", "score", "tokens")

    def settle(group: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        number = lambda c: rows[c].cast(pa.float64()).to_numpy()
        with np.errstate(all="ignore"):
            price, gap, taken = _settled(number("score"), number("tokens"), rows["key"].combine_chunks(), rows["_budget"][0].as_py(), tau)
        lists = {f"_{c}": pa.ListArray.from_arrays(pa.array([0, len(taken)], pa.int32()), rows[c].combine_chunks().take(pa.array(taken))) for c in own}
        return pa.table({"group": rows["group"].combine_chunks()[:1], "price": [price], "dual_gap": [gap], **lists})

    dealt = items.join(budgets.select("group", F.col("budget").cast("double").alias("_budget")), "group")
    schema = ", ".join(["group " + kinds["group"], "price double", "dual_gap double", *(f"_{c} array<{kinds[c]}>" for c in own)])
    settled = cut(dealt.groupBy("group").applyInArrow(settle, schema))
    taken = settled.select("group", F.explode(F.arrays_zip(*(F.col(f"_{c}") for c in own))).alias("_x")).select("group", *(F.col(f"_x._{c}").alias(c) for c in own))
    return taken, settled.select("group", "price", "dual_gap")


def _in_passes(items: DataFrame, budgets: DataFrame, temperature: float) -> tuple[DataFrame, DataFrame]:
    """soft_selection for groups of any size: passes over all items by dual_prices and fill."""
    tau = max(temperature, 1e-4)
    # items of one key are told apart
    items = cut(items.withColumn("key", F.struct("key", F.monotonically_increasing_id().alias("_copy"))))
    prices = cut(dual_prices(items, budgets, temperature).join(budgets.select("group", "budget"), "group"))
    priced = items.join(prices, "group")
    all_fit = priced.filter("all_fit")
    rest = priced.filter("NOT all_fit").select("group", "key", "score", "tokens", "price", "failed")
    order = F.when(F.col("failed"), F.col("score") / F.col("tokens")).otherwise((F.col("score") - F.col("price") * F.col("tokens")) / tau)
    filled = fill(rest, prices.filter("NOT all_fit").select("group", "budget"), order)
    taken = all_fit.select("group", "key", "score", "tokens").unionByName(filled.select("group", "key").join(items, ["group", "key"]))
    z = (F.col("score") - F.col("price") * F.col("tokens")) / tau
    bound = priced.groupBy("group").agg(F.sum(tau * F.when(z > 20, z).otherwise(F.log1p(F.exp(z)))).alias("_bound"))
    gained = taken.groupBy("group").agg(F.sum("score").alias("_gained"))
    gap = F.col("_bound") + F.col("price") * F.col("budget") - F.coalesce("_gained", F.lit(0.0))
    found = prices.join(bound, "group").join(gained, "group", "left")
    return taken.withColumn("key", F.col("key.key")), found.select("group", "price", F.when(F.col("all_fit") | F.col("failed"), 0.0).otherwise(F.greatest(F.lit(0.0), gap)).alias("dual_gap"))


def soft_selection(items: DataFrame, budgets: DataFrame, temperature: float) -> tuple[DataFrame, DataFrame]:
    """The selected items (group, key, score, tokens) and (group, price, dual_gap) of each group with items.

    Items are taken by falling reduced cost, score - price * tokens, as far as they fit; all where
    all fit in expectation, and by falling score per token where no price was found. dual_gap
    is the smooth bound on the score at that price less the score that was taken, 0 at least. Items
    without a score or tokens above 0 aren't candidates. Groups of up to GROUP_ITEMS items are
    settled after one shuffle; larger ones, spread over tasks, take a pass for every few halvings.
    """
    columns = ["group", "key", "score", "tokens"]
    items = items.filter("score > 0 AND tokens > 0").select(*columns)
    large = cut(items.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > GROUP_ITEMS).select("group"))
    if large.isEmpty():
        return _in_groups(items, budgets, temperature)
    # each has over GROUP_ITEMS items, so they are few
    few = F.broadcast(large)
    taken, found = _in_groups(items.join(few, "group", "left_anti").select(*columns), budgets, temperature)
    more, wide = _in_passes(items.join(few, "group", "left_semi").select(*columns), budgets, temperature)
    return taken.unionByName(more), found.unionByName(wide)


def select(items: DataFrame, budgets: DataFrame, temperature: float) -> DataFrame:
    """(group, key, method): pinned items first, then others under what is left of the budget.

    items: (group, key, score, tokens, pinned). From a temperature of 0.05 on by soft_selection
    ("soft_bisection"); below that exactly for groups of up to 2000 candidates ("exact_dp") and
    by score per token for larger ones ("greedy"). Pinned items are taken whatever they take up
    ("pinned").
    """
    pinned = items.filter("pinned").select("group", "key", F.lit("pinned").alias("method"))
    used = items.filter("pinned").groupBy("group").agg(F.sum("tokens").alias("_used"))
    left = cut(budgets.join(used, "group", "left").select("group", (F.col("budget") - F.coalesce("_used", F.lit(0))).cast("long").alias("budget")).filter("budget > 0"))
    free = cut(items.filter("NOT pinned AND score > 0 AND tokens > 0").select("group", "key", "score", "tokens").join(left.select("group"), "group", "left_semi"))
    if temperature >= SOFT:
        taken, _ = soft_selection(free, left, temperature)
        return pinned.unionByName(taken.select("group", "key", F.lit("soft_bisection").alias("method")))
    sizes = cut(free.groupBy("group").agg(F.count(F.lit(1)).alias("_n")))
    small = free.join(sizes.filter(F.col("_n") <= EXACT_ITEMS).select("group"), "group", "left_semi")
    large = free.join(sizes.filter(F.col("_n") > EXACT_ITEMS).select("group"), "group", "left_semi")
    exact = selection.knapsack(small.join(left, "group"), "group", "key", "score", "tokens", "budget").select("group", "key", F.lit("exact_dp").alias("method"))
    greedy = fill(large, left, F.col("score") / F.col("tokens")).select("group", "key", F.lit("greedy").alias("method"))
    return pinned.unionByName(exact).unionByName(greedy)
