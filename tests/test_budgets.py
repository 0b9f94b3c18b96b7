"""Selection under a budget against plain loops."""

import math
import random

import pytest

from siltstone.operators import budgets


def sigmoid(x):
    x = max(-500.0, min(500.0, x))
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def plain(items, budget, tau):
    """(price, taken, gap) of one group's (key, score, tokens)."""
    expected = lambda p: sum(sigmoid((s - p * t) / tau) * t for _, s, t in items)
    if expected(0.0) <= budget:
        return 0.0, {k for k, _, _ in items}, 0.0
    lo, hi = 0.0, (max(s for _, s, _ in items) + 5 * tau) / (max(1, min(t for *_, t in items)) * tau)
    while expected(hi) >= budget:
        hi *= 2
    for _ in range(30):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if expected(mid) > budget else (lo, mid)
    price, left, taken = (lo + hi) / 2, budget, set()
    for k, s, t in sorted(items, key=lambda x: (-(x[1] - price * x[2]), x[0])):
        if t <= left:
            left -= t
            taken.add(k)
    bound = sum(tau * math.log1p(math.exp((s - price * t) / tau)) for _, s, t in items) + price * budget
    return price, taken, max(0.0, bound - sum(s for k, s, _ in items if k in taken))


@pytest.fixture(scope="module")
def groups():
    r = random.Random(9)
    out = {}
    for g in range(12):
        out[g] = ([(i, r.random() * 3, r.randint(1, 60)) for i in range(r.choice([1, 5, 40, 300]))], r.choice([10, 150, 600, 100_000]))
    out[50] = ([(i, 1.0, 10) for i in range(30)], 95)
    return out


def tables(spark, groups, pinned=False):
    rows = [(g, k, s, t, pinned and k % 7 == 0) for g, (items, _) in groups.items() for k, s, t in items]
    items = spark.createDataFrame(rows, "group int, key int, score double, tokens int, pinned boolean").repartition(4)
    return items, spark.createDataFrame([(g, b) for g, (_, b) in groups.items()], "group int, budget long")


@pytest.mark.parametrize("tau", [0.05, 0.5])
def test_prices_and_selection(spark, groups, tau):
    items, limits = tables(spark, groups)
    taken, found = budgets.soft_selection(items, limits, tau)
    got = {}
    for r in taken.collect():
        got.setdefault(r["group"], set()).add(r["key"])
    prices = {r["group"]: (r["price"], r["dual_gap"]) for r in found.collect()}
    for g, (own, budget) in groups.items():
        price, want, gap = plain(own, budget, tau)
        assert abs(prices[g][0] - price) < 1e-9 and abs(prices[g][1] - gap) < 1e-6
        assert got.get(g, set()) == want, g


def test_pinned_items_come_first(spark, groups):
    items, limits = tables(spark, groups, pinned=True)
    rows = budgets.select(items, limits, 0.5).collect()
    for g, (own, budget) in groups.items():
        got = {m: {r["key"] for r in rows if r["group"] == g and r["method"] == m} for m in ("pinned", "soft_bisection")}
        fixed = {k for k, _, _ in own if k % 7 == 0}
        left = budget - sum(t for k, _, t in own if k in fixed)
        free = [x for x in own if x[0] not in fixed]
        assert got["pinned"] == fixed
        assert got["soft_bisection"] == (plain(free, left, 0.5)[1] if left > 0 and free else set())


def test_hard_selection_is_exact_for_small_groups(spark):
    items = spark.createDataFrame([(1, 1, 6.0, 5, False), (1, 2, 5.0, 4, False), (1, 3, 5.0, 4, False), (2, 1, 1.0, 5, True), (2, 2, 9.0, 5, False), (2, 3, 0.0, 1, False)], "group int, key int, score double, tokens int, pinned boolean")
    limits = spark.createDataFrame([(1, 8), (2, 5)], "group int, budget long")
    got = sorted(map(tuple, budgets.select(items, limits, 0.0).collect()))
    assert got == [(1, 2, "exact_dp"), (1, 3, "exact_dp"), (2, 1, "pinned")]


def test_hard_selection_of_large_groups_is_by_density(spark, monkeypatch):
    monkeypatch.setattr(budgets, "EXACT_ITEMS", 2)
    items = spark.createDataFrame([(1, k, float(k % 5 + 1), 3 + k % 4, False) for k in range(40)], "group int, key int, score double, tokens int, pinned boolean")
    left, want = 50, set()
    for k in sorted(range(40), key=lambda k: (-(k % 5 + 1) / (3 + k % 4), k)):
        if 3 + k % 4 <= left:
            left -= 3 + k % 4
            want.add(k)
    got = budgets.select(items, spark.createDataFrame([(1, 50)], "group int, budget long"), 0.0).collect()
    assert {r["key"] for r in got} == want and {r["method"] for r in got} == {"greedy"}


def test_empty(spark, groups):
    items, limits = tables(spark, groups)
    assert budgets.select(items.limit(0), limits, 0.5).count() == 0
    taken, found = budgets.soft_selection(items.limit(0), limits, 0.5)
    assert taken.count() == 0 and found.count() == 0


@pytest.mark.parametrize("most", [0, 40])
def test_large_groups_are_settled_alike(spark, groups, monkeypatch, most):
    """Groups beyond the bound go by passes over all items, with the same results."""
    items, limits = tables(spark, groups)
    found = {}
    for bound in (budgets.GROUP_ITEMS, most):
        monkeypatch.setattr(budgets, "GROUP_ITEMS", bound)
        taken, prices = budgets.soft_selection(items, limits, 0.5)
        found[bound] = sorted(map(tuple, taken.collect())), {r["group"]: (r["price"], r["dual_gap"]) for r in prices.collect()}
    (all_taken, all_prices), (some_taken, some_prices) = found.values()
    assert all_taken == some_taken and all_prices.keys() == some_prices.keys()
    assert all(all_prices[g] == pytest.approx(some_prices[g], abs=1e-7) for g in all_prices)


def test_small_groups_write_one_row_each(spark, groups, monkeypatch):
    """No table of items is written on the way, and passes don't grow with the halvings."""
    rows = []
    monkeypatch.setattr(budgets, "cut", lambda df: rows.append(df.count()) or df)
    items, limits = tables(spark, groups)
    taken, prices = budgets.soft_selection(items, limits, 0.5)
    assert prices.count() == len(groups) and taken.count() > 0
    assert len(rows) <= 2 and max(rows) <= len(groups)


def test_soft_selection_of_odd_items(spark):
    """Nulls, infinite scores, no budget, a null one, text keys and ties."""
    rows = [(1, "b", 1.0, 10), (1, "a", 1.0, 10), (1, "c", None, 5), (2, "a", float("inf"), 5), (2, "b", 1.0, 5), (3, "a", 2.0, 4), (4, "a", 2.0, 4), (5, "a", 2.0, 4), (None, "a", 2.0, 4)]
    items = spark.createDataFrame(rows, "group int, key string, score double, tokens int")
    limits = spark.createDataFrame([(1, 10), (2, 5), (3, 0), (4, None), (6, 9)], "group int, budget long")
    taken, found = budgets.soft_selection(items, limits, 0.1)
    assert sorted((r["group"], r["key"]) for r in taken.collect()) == [(1, "a"), (2, "a")]
    assert sorted(r["group"] for r in found.collect()) == [1, 2, 3, 4]


@pytest.mark.parametrize("most", [0, 100_000])
def test_items_of_one_key(spark, monkeypatch, most):
    """Repeated keys are items of their own, each taken or not, and the budget holds."""
    monkeypatch.setattr(budgets, "GROUP_ITEMS", most)
    rows = [(1, i // 2, 1.0 + i / 100, 10) for i in range(20)]
    items = spark.createDataFrame(rows, "group int, key int, score double, tokens int")
    taken, _ = budgets.soft_selection(items, spark.createDataFrame([(1, 55)], "group int, budget long"), 0.1)
    assert sorted(r["key"] for r in taken.collect()) == [7, 8, 8, 9, 9]
