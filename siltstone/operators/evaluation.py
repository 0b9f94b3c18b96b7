"""Labels, cascades, agreement and recall over scored or judged rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.text import task_type
from siltstone.operators.lineage import cut
from siltstone.operators.statistics import count_below


def derived_labels(traces: DataFrame, outcomes: DataFrame, key: str, order: str, rule: str = "default", code_change: Column | None = None) -> DataFrame:
    """(key, label) of each trace from its outcomes (event_type, value, strength); of several signals the last by order counts.

    default: strong signals, else medium ones. strict: strong only. legacy: strong, medium,
    weak. ci_only: ci_result events. code_change: as strict where the trace changed code.
    Empty values don't count; without a signal the label is unknown. Outcomes are aggregated
    by trace before the join.
    """
    value = F.when(F.col("value") != "", F.col("value"))
    last = lambda cond: F.max_by(F.when(cond, value), F.when(cond, F.col(order)))
    strength = lambda s: F.col("strength") == s
    signals = outcomes.groupBy(key).agg(last(strength("strong")).alias("_strong"), F.max(strength("strong")).alias("_any"), last(strength("medium")).alias("_medium"), last(strength("weak")).alias("_weak"), last(F.col("event_type") == "ci_result").alias("_ci"))
    unknown = F.lit("unknown")
    rules = {
        "default": F.when(F.col("_any"), F.col("_strong")).otherwise(F.col("_medium")),
        "strict": F.col("_strong"),
        "legacy": F.coalesce("_strong", "_medium", "_weak"),
        "ci_only": F.col("_ci"),
        "code_change": F.when(code_change if code_change is not None else F.lit(False), F.col("_strong")),
    }
    return traces.join(signals, key, "left").select(key, F.coalesce(rules[rule], unknown).alias("label"))


def two_class_p(calibration: DataFrame, scored: DataFrame, score: str, label: str) -> DataFrame:
    """scored with p_high and p_low: conformal p-values of a score against calibration rows of label 1 (as high or higher) and of label 0 (as low or lower).

    Calibration and scored rows are counted by score together, so no row meets another.
    """
    n = calibration.agg(F.sum(F.col(label).cast("long")).alias("_n1"), F.sum((1 - F.col(label)).cast("long")).alias("_n0"))
    both = calibration.select(F.col(score), F.col(label).cast("long").alias("_1"), (1 - F.col(label)).cast("long").alias("_0")).unionByName(scored.select(F.col(score), F.lit(0).cast("long").alias("_1"), F.lit(0).cast("long").alias("_0")))
    ties = both.filter(F.col(score).isNotNull()).groupBy(score).agg(F.sum("_1").alias("_1"), F.sum("_0").alias("_0"))
    below = count_below(count_below(ties, score, "_1").withColumnRenamed("_below", "_below1"), score, "_0")
    p = below.crossJoin(F.broadcast(n)).select(score, ((1 + F.col("_n1") - F.col("_below1")) / (F.col("_n1") + 1)).alias("p_high"), ((1 + F.col("_below") + F.col("_0")) / (F.col("_n0") + 1)).alias("p_low"))
    return scored.join(p, score, "left")


def select_band(rows: DataFrame, score: str, label: str, risk: float, cost: float, stake: float, floor: float = 0.0) -> DataFrame:
    """One row (t_lo, t_hi): the largest regions of low scores (taken for label 0) and of high ones (taken for 1) with a cumulative error of risk at most.

    An error must not be over floor + cost / stake either. A region ends at its first cutoff
    beyond; infinite if even the first is. Regions that cross meet in the middle.
    """
    tau = min(risk, floor + cost / stake if stake > 0 else float("inf"))
    ties = rows.groupBy(score).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_1"))
    total = ties.agg(F.sum("_n").alias("_all"), F.sum("_1").alias("_ones"), F.min(score).alias("_min"), F.max(score).alias("_max"))
    seen = count_below(count_below(ties, score, "_n").withColumnRenamed("_below", "_nb"), score, "_1").crossJoin(F.broadcast(total))
    low_error = (F.col("_below") + F.col("_1")) / (F.col("_nb") + F.col("_n"))
    above, ones_above = F.col("_all") - F.col("_nb"), F.col("_ones") - F.col("_below")
    high_error = (above - ones_above) / above
    marked = seen.withColumn("_low_bad", low_error > tau).withColumn("_high_bad", high_error > tau)
    edge = marked.agg(F.min(F.when(F.col("_low_bad"), F.col(score))).alias("_first"), F.max(F.when(F.col("_high_bad"), F.col(score))).alias("_last"))
    inf = F.lit(float("inf"))
    ends = marked.crossJoin(F.broadcast(edge)).agg(
        F.coalesce(F.max(F.when(F.col("_first").isNull() | (F.col(score) < F.col("_first")), F.col(score))), -inf).alias("t_lo"),
        F.coalesce(F.min(F.when(F.col("_last").isNull() | (F.col(score) > F.col("_last")), F.col(score))), inf).alias("t_hi"), F.max("_max").alias("_max"), F.min("_min").alias("_min"),
    )
    middle = 0.5 * (F.least("t_lo", "_max") + F.greatest("t_hi", "_min"))
    crossed = F.col("t_lo") >= F.col("t_hi")
    return ends.select(F.when(crossed, middle).otherwise(F.col("t_lo")).alias("t_lo"), F.when(crossed, middle).otherwise(F.col("t_hi")).alias("t_hi"))


def cascade_outcome(rows: DataFrame, score: str, label: str, expert: str, t_lo: float, t_hi: float, cheap: float = 0.0, dear: float = 1.0) -> DataFrame:
    """One row: how many rows a cascade accepts (score t_lo or less), flags (t_hi or more) or passes on to an expert's label, its errors and its mean cost."""
    accept, flag = F.col(score) <= t_lo, F.col(score) >= t_hi
    action = F.when(accept, "accept").when(flag, "flag").otherwise("escalate")
    wrong = F.when(accept, F.col(label) != 0).when(flag, F.col(label) != 1).otherwise(F.col(expert) != F.col(label))
    count = lambda c: F.count_if(c)
    judged = rows.select(action.alias("_a"), wrong.alias("_w"))
    near = F.col("_a") != "escalate"
    sums = judged.agg(F.count(F.lit(1)).alias("n"), count(F.col("_a") == "accept").alias("n_accept"), count(F.col("_a") == "flag").alias("n_flag"), count(~near).alias("n_escalate"), count(near & F.col("_w")).alias("_e"), count("_w").alias("_all"))
    rate = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    n = F.col("n")
    return sums.select("n", "n_accept", "n_flag", "n_escalate", rate(F.col("n_escalate"), n).alias("escalation_rate"), rate(F.col("_e"), n - F.col("n_escalate")).alias("selective_risk"), rate(F.col("_all"), n).alias("overall_error"), rate(cheap * n + dear * F.col("n_escalate"), n).alias("expected_cost"))


def recall_at(ranked: DataFrame, gold: DataFrame, query: str, item: str, rank: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(query, recall_k ...): the share of each query's gold items among its first k; items that are ranked twice count once."""
    total = gold.select(query, item).distinct()
    hits = total.join(ranked.groupBy(query, item).agg(F.min(rank).alias("_r")), [query, item], "left")
    return hits.groupBy(query).agg(*((F.count_if(F.col("_r") <= k) / F.count(F.lit(1))).alias(f"recall_{k}") for k in ks))


def shadow_agreement(rows: DataFrame, policy: str, abstained: Column, agreed: Column) -> DataFrame:
    """(policy, agree_rate, abstain_rate, n): rates of rows by policy, to 4 digits; a row that abstained doesn't agree."""
    n = F.count(F.lit(1))
    return rows.groupBy(policy).agg(F.round(F.count_if(~abstained & agreed) / n, 4).alias("agree_rate"), F.round(F.count_if(abstained) / n, 4).alias("abstain_rate"), n.alias("n"))


def release_gate(report: DataFrame, samples: int = 50, evidence: float = 0.40, success: float = 0.70) -> DataFrame:
    """report (total_requests, evidence_rate, success_rate) with passed and reason: which checks failed."""
    checks = (("sample_size", F.col("total_requests") >= samples), ("decomp_rate", F.col("evidence_rate") >= evidence), ("success_rate", F.col("success_rate") >= success))
    failed = F.array_compact(F.array(*(F.when(~ok, F.lit(name)) for name, ok in checks)))
    return report.withColumn("passed", F.size(failed) == 0).withColumn("reason", F.when(F.size(failed) == 0, "all gates passed").otherwise(F.concat(F.lit("failed: "), F.array_join(failed, ", "))))


def gram_counts(texts: DataFrame, text: str, order: int = 3) -> DataFrame:
    """(size, context, char, n): how often a character follows each context of 0 to order - 1 characters; texts start with order - 1 start marks and end with an end mark.

    Only grams of order characters are cut from texts, each text once from start to end; those of
    fewer characters are the ends of these and are summed over their counts.
    """
    some = texts.filter(F.col(text) != "").select(F.explode(_grams(F.col(text), order)).alias("_g"))
    counted = some.groupBy("_g").agg(F.count(F.lit(1)).alias("n"))
    ends = F.transform(F.sequence(F.lit(1), F.lit(order)), lambda k: F.struct(k.alias("size"), F.substring("_g", order - k + 1, k - 1).alias("context"), F.substring("_g", F.lit(order), F.lit(1)).alias("char")))
    return counted.select(F.explode(ends).alias("g"), "n").groupBy("g.size", "g.context", "g.char").agg(F.sum("n").alias("n"))


def _grams(text: Column, order: int, end: str = "\x03") -> Column:
    """All runs of order characters of a text with order - 1 start marks and an end mark, in one pass: a place in a UTF-8 string is found by counting from its start."""
    padded = F.concat(F.lit("\x02" * (order - 1)), text, F.lit(end))
    return F.regexp_extract_all(padded, F.lit(f"(?s)(?=(.{{{order}}}))."), F.lit(1))


def budget_features(turns: DataFrame, group: str, order: str, text: str, entropy: Column, vagueness: Column | None = None) -> DataFrame:
    """What a budget is predicted from, for each group: its last turn is the query, all turns are fragments and together the context.

    Tokens are characters by four, 1 at least, of the query and of the whole context. An entropy
    of 0 or null counts as 0.5, as does a vagueness that isn't given. The task is the query's task type.
    """
    size = F.coalesce(F.char_length(text), F.lit(0))
    tokens = lambda n: F.greatest(F.lit(1), F.floor(n / 4)).cast("long")
    known = F.when(entropy == 0, F.lit(0.5)).otherwise(F.coalesce(entropy, F.lit(0.5)))
    rows = turns.select(group, order, F.coalesce(F.col(text), F.lit("")).alias("_t"), size.alias("_n"), known.alias("_h"), (vagueness if vagueness is not None else F.lit(0.5)).alias("_v"))
    found = rows.groupBy(group).agg(F.max_by(F.struct("_t", "_n", "_v"), order).alias("_q"), F.sum("_n").alias("_all"), F.count(F.lit(1)).alias("fragments"), F.avg("_h").alias("mean_entropy"), F.max("_h").alias("max_entropy"))
    return found.select(group, tokens(F.col("_q._n")).alias("query_tokens"), F.coalesce("_q._v", F.lit(0.5)).alias("vagueness"), tokens(F.col("_all")).alias("context_tokens"), "fragments", "mean_entropy", "max_entropy", task_type(F.col("_q._t")).alias("task_type"))


#: What each step back to a shorter context multiplies a character's chance by, and the logarithm of an unknown one's.
BACK_OFF, UNKNOWN = 0.4, -10.0


def surprisal(texts: DataFrame, key: str, text: str, counts: DataFrame, order: int = 3) -> DataFrame:
    """(key, surprisal): how unlikely a text's characters are on average after the order - 1 before them, in natural units.

    counts are those of gram_counts. A character unknown after the longest context is looked up
    after a shorter one, each step back at BACK_OFF of its chance. Texts' grams are counted
    first, so each different gram is looked up once, and common contexts are one row; texts
    and counts are read once. Empty and null texts have 0. Rows that share a key are one text after another.
    """
    some = texts.filter(F.col(text) != "").select(key, F.explode(_grams(F.col(text), order, "")).alias("_g"))
    counted = cut(some.groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_c")))
    left = counted.select("_g").distinct()
    counts = cut(counts)
    totals = counts.groupBy("size", "context").agg(F.sum("n").alias("_all"))
    chances = counts.join(totals, ["size", "context"]).select("size", F.concat("context", "char").alias("_seen"), F.log(F.col("n") / F.col("_all")).alias("_log"))
    known = left
    for size in range(order, 0, -1):
        own = chances.filter(F.col("size") == size).select(F.col("_seen").alias("_tail"), (F.col("_log") + (order - size) * math.log(BACK_OFF)).alias(f"_l{size}"))
        known = known.withColumn("_tail", F.expr(f"right(_g, {size})")).join(own, "_tail", "left").drop("_tail")
    scored = counted.join(known.select("_g", F.coalesce(*(F.col(f"_l{size}") for size in range(order, 0, -1)), F.lit(UNKNOWN)).alias("_log")), "_g")
    means = scored.groupBy(key).agg((-F.sum(F.col("_log") * F.col("_c")) / F.sum("_c")).alias("_s"))
    return texts.select(key).distinct().join(means, key, "left").select(key, F.coalesce("_s", F.lit(0.0)).alias("surprisal"))


def co_access(accesses: DataFrame, key: str, turn: str, item: str, window: int) -> DataFrame:
    """(a, b, n), a < b: how often two items of a key were used within window turns of each other. Turns are cut into blocks of window, so a row meets its own block and the one before."""
    rows = accesses.select(key, F.col(turn).alias("_t"), F.col(item).alias("_i"), F.floor(F.col(turn) / max(window, 1)).alias("_b"))
    later = rows.select(key, F.col("_t").alias("_u"), F.col("_i").alias("_j"), F.explode(F.array(F.col("_b"), F.col("_b") - 1)).alias("_b"))
    pairs = rows.join(later, [key, "_b"]).filter((F.col("_i") != F.col("_j")) & (F.col("_u") - F.col("_t") <= window) & ((F.col("_t") < F.col("_u")) | ((F.col("_t") == F.col("_u")) & (F.col("_i") < F.col("_j")))))
    return pairs.groupBy(F.least("_i", "_j").alias("a"), F.greatest("_i", "_j").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def repeated_deliveries(rows: DataFrame, session: str, contract: list[str], order: str, digests: list[str]) -> DataFrame:
    """rows with exact_repeat: whether the session's delivery before under the same contract had equal digests."""
    w = Window.partitionBy(session, *contract).orderBy(order)
    same = F.lit(True)
    for d in digests:
        same = same & F.col(d).eqNullSafe(F.lag(d).over(w))
    return rows.withColumn("exact_repeat", same & (F.row_number().over(w) > 1))
