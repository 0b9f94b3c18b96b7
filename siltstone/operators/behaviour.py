"""Waste in what agents do, policies learned from outcomes, and what a selection lacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.lineage import in_tasks
from siltstone.operators.statistics import trimmed_mean


def _short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def waste(calls: DataFrame, conversation: str, at: str, order: str, signature: str, error: str, model: str, tokens: str, window: int, repeats: int = 3, most: int = 64) -> DataFrame:
    """(conversation, kind, fingerprint, level, first_seen, occurrences, wasted, confidence, severity) of repeated calls, repeated errors, loops of two calls and changes of models.

    A call sees itself and at most most - 1 calls before it, none of them older than window (in
    the whole units of at); calls of one time come by order, a unique column. Each level (occurrences
    by repeats, rounded down) of a finding is reported once, when first seen. Null or empty
    signatures, errors and models are none; calls without a conversation or time don't count.

    Time is dealt out in pieces of the window's length and a piece sees the one before, so a
    conversation with a third of all calls is spread over its time.
    """
    piece = F.floor(F.col(at) / window)
    names = {"s": signature, "e": error, "m": model}
    call = F.struct(F.col(at).alias("at"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in names.items()), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("n"))
    calls = calls.filter(F.col(conversation).isNotNull() & F.col(at).isNotNull())
    dealt = calls.select(F.col(conversation).alias("conversation"), F.col(order).alias("_order"), call.alias("_call"), piece.alias("_own"), F.explode(F.array(piece, piece + 1)).alias("_piece"))
    before = Window.partitionBy("conversation", "_piece").orderBy("_call.at", "_order").rowsBetween(1 - most, 0)
    seen = dealt.withColumn("_seen", F.collect_list("_call").over(before)).filter("_own = _piece")
    seen = seen.withColumn("_seen", F.filter("_seen", lambda c: c["at"] >= F.col("_call.at") - window))

    # each list is a column of its own, so that none is built more than once a row
    last = lambda c: F.slice(c, F.greatest(F.size(c) - 3, F.lit(1)), F.lit(4))
    seen = seen.select(
        "conversation", "_order", "_call",
        F.filter("_seen", lambda c: c["s"] == F.col("_call.s")).alias("_same"),
        F.filter("_seen", lambda c: c["e"] == F.col("_call.e")).alias("_failed"),
        F.filter("_seen", lambda c: c["s"] != "").alias("_called"),
        F.filter(last(F.col("_seen")), lambda c: c["s"] != "").alias("_looping"),
        F.filter("_seen", lambda c: c["m"] != "").alias("_used"),
    )
    seen = seen.withColumn("_tail", F.transform(last(F.col("_called")), lambda c: c["s"])).withColumn("_models", F.transform("_used", lambda c: c["m"]))
    changed = F.zip_with("_models", F.slice("_models", F.lit(2), F.lit(most)), lambda a, b: a != b)
    seen = seen.withColumn("_changes", F.size(F.filter(changed, lambda c: c)))

    def finding(kind: str, fingerprint: Column, rows: str, occurrences: Column, found: Column) -> Column:
        lost = F.aggregate(F.slice(rows, 2, most), F.lit(0).cast("long"), lambda a, c: a + c["n"])
        return F.when(found, F.struct(F.lit(kind).alias("kind"), fingerprint.alias("fingerprint"), occurrences.cast("long").alias("occurrences"), lost.alias("wasted")))

    def repeated(kind: str, field: str, rows: str) -> Column:
        return finding(kind, F.col(f"_call.{field}"), rows, F.size(rows), (F.col(f"_call.{field}") != "") & (F.size(rows) >= repeats))

    s = [F.get("_tail", F.lit(i)) for i in range(4)]
    findings = F.array_compact(F.array(
        repeated("identical_tool_retry", "s", "_same"),
        repeated("repeated_error", "e", "_failed"),
        finding("alternating_tool_loop", _short_hash(F.concat(F.least(s[0], s[1]), F.lit("|"), F.greatest(s[0], s[1]))), "_looping", F.size("_looping"), (F.size("_tail") == 4) & (s[0] == s[2]) & (s[1] == s[3]) & (s[0] != s[1])),
        finding("model_switch_churn", _short_hash(F.array_join(F.array_sort(F.array_distinct("_models")), "|")), "_used", F.col("_changes"), F.col("_changes") >= repeats),
    ))
    rows = seen.select("conversation", "_order", F.col("_call.at").alias("_at"), F.explode(findings).alias("f")).select("conversation", "_order", "_at", "f.*").withColumn("level", F.floor(F.col("occurrences") / repeats))
    first = rows.groupBy("conversation", "kind", "fingerprint", "level").agg(F.min(F.struct("_at", "_order", "occurrences", "wasted")).alias("_first"))
    n = F.col("_first.occurrences")
    sure = F.round(F.least(F.lit(0.99), 0.55 + 0.10 * F.greatest(F.lit(0), n - 2)), 3)
    return first.select("conversation", "kind", "fingerprint", "level", F.col("_first._order").alias("first_seen"), n.alias("occurrences"), F.col("_first.wasted").alias("wasted"), sure.alias("confidence"), F.when(n >= 5, "high").otherwise("medium").alias("severity"))


def beta_cells(outcomes: DataFrame, archetype: str, model: str, succeeded: Column, prior: float = 1.0, least: int = 5) -> DataFrame:
    """(archetype, model, alpha, beta, n, p_success, enough): the Beta posterior of each cell; enough where all models of the archetype have least outcomes together.

    Null archetypes are "general", outcomes without a model or a result count as failures of model "".
    """
    cells = outcomes.groupBy(F.coalesce(F.col(archetype), F.lit("general")).alias("archetype"), F.coalesce(F.col(model), F.lit("")).alias("model"))
    counted = cells.agg((F.count(F.when(succeeded, 1)) + prior).alias("alpha"), (F.count(F.lit(1)) - F.count(F.when(succeeded, 1)) + prior).alias("beta"), F.count(F.lit(1)).alias("n"))
    totals = counted.groupBy("archetype").agg((F.sum("n") >= least).alias("enough"))
    return counted.join(totals, "archetype").withColumn("p_success", F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 4))


def promotion(outcomes: DataFrame, group: str, shadow: Column, order: list[str], success: Column, repairs: str, retries: str, holdout: int = 50, epsilon: float = 0.05, delta: float = 0.20) -> DataFrame:
    """(group, live and shadow success, repairs and retries, promoted): whether the shadow policy of a group may go live.

    Its last holdout outcomes must not succeed less often than the live ones by more than epsilon,
    nor need more repairs or retries by both the share delta and 0.1. Groups with fewer than holdout
    outcomes of either kind have nulls and aren't promoted. order must be unique; a null success is none.
    """
    last = Window.partitionBy("_group", "_arm").orderBy(*(F.desc(c) for c in order))
    arm = F.when(F.coalesce(shadow, F.lit(False)), "shadow").otherwise("live")
    rows = outcomes.select(F.col(group).alias("_group"), arm.alias("_arm"), *order, F.when(success, 1).otherwise(0).alias("success"), F.coalesce(F.col(repairs), F.lit(0)).alias("repairs"), F.coalesce(F.col(retries), F.lit(0)).alias("retries"))
    # the limit by rank is applied before the shuffle too
    kept = rows.withColumn("_rank", F.row_number().over(last)).filter(F.col("_rank") <= holdout)
    kinds = ("live", "shadow")
    # whole counts first: sums and quotients don't depend on the order of rows
    sums = kept.groupBy("_group").agg(*(F.sum(F.when(F.col("_arm") == k, 1).otherwise(0)).alias(f"_{k}") for k in kinds), *(F.sum(F.when(F.col("_arm") == k, F.col(c))).alias(f"_{k}_{c}") for k in kinds for c in ("success", "repairs", "retries")))
    full = (F.col("_live") >= holdout) & (F.col("_shadow") >= holdout)
    rates = sums.select(F.col("_group").alias(group), *(F.when(full, F.col(f"_{k}_{c}") / holdout).alias(f"{k}_{c}") for k in kinds for c in ("success", "repairs", "retries")))
    worse = lambda c: (F.col(f"shadow_{c}") > F.col(f"live_{c}") * (1 + delta)) & (F.col(f"shadow_{c}") > F.col(f"live_{c}") + 0.1)
    good = (F.col("shadow_success") >= F.col("live_success") - epsilon) & ~worse("repairs") & ~worse("retries")
    return rates.withColumn("promoted", F.coalesce(good, F.lit(False)))


def merged_weights(contributions: DataFrame, archetype: str, keys: list[str]) -> DataFrame:
    """(archetype, key, weight): the trimmed mean of each weight over an archetype's contributions, to six places. Null weights don't count; a key without any has no row."""
    cells = contributions.select(F.col(archetype).alias("archetype"), F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("weight")) for k in keys))).alias("w"))
    means = trimmed_mean(cells.select(F.struct("archetype", "w.key").alias("cell"), "w.weight"), "cell", "weight")
    return means.select("cell.archetype", "cell.key", F.round("trimmed_mean", 6).alias("weight"))


#: A task takes about so many selected fragments, with what they refer to, in its tables.
TASK_SELECTED = 250_000


def sufficiency(selected: DataFrame, references: DataFrame, definitions: DataFrame, selection: str, fragment: str, symbol: str) -> DataFrame:
    """(selection, referenced, satisfied, sufficiency): the share of known symbols that a selection refers to and also defines; 1 without any.

    selected: (selection, fragment); references: (fragment, symbol); definitions: (symbol, fragment), one fragment for each symbol.
    A symbol is counted beside its home, so what a selection has needn't be joined to what it
    refers to. Rows are dealt to as many tasks as there are selected fragments for.
    """
    many = selected.count()
    known = definitions.select(symbol, F.col(fragment).alias("_home")).filter("_home IS NOT NULL")
    wanted = references.select(fragment, symbol).join(known, symbol).groupBy(fragment).agg(F.collect_set(F.struct(F.col("_home").alias("_f"), F.col(symbol).alias("_s"))).alias("_wanted"))
    chosen = in_tasks(selected.select(selection, fragment), many, TASK_SELECTED, fragment).join(wanted, fragment, "left")
    own = F.array(F.struct(F.col(fragment).alias("_f"), F.lit(None).cast(known.schema[symbol].dataType).alias("_s")))
    each = F.when(F.col("_wanted").isNull(), own).otherwise(F.concat(own, "_wanted"))
    dealt = in_tasks(chosen, many, TASK_SELECTED, selection).select(selection, F.explode(each).alias("_x"))
    # rows of one selection lie together, so none of these shuffles
    once = dealt.select(selection, "_x._f", "_x._s").distinct()
    homes = once.groupBy(selection, "_f").agg(F.count("_s").alias("_n"), F.max(F.col("_s").isNull()).alias("_has"))
    counts = homes.groupBy(selection).agg(F.sum("_n").alias("_n"), F.sum(F.when(F.col("_has"), F.col("_n")).otherwise(0)).alias("_m"))
    # a null selection refers to nothing
    number = lambda c: F.when(F.col(selection).isNull(), 0).otherwise(F.col(c)).cast("long")
    found = counts.select(selection, number("_n").alias("referenced"), number("_m").alias("satisfied"))
    return found.withColumn("sufficiency", F.when(F.col("referenced") > 0, F.col("satisfied") / F.col("referenced")).otherwise(F.lit(1.0)))
