"""Dependency graphs as edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.operators.lineage import cut, new_folder


def pagerank(edges: DataFrame, nodes: DataFrame, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after a fixed number of iterations; nodes without edges spread their rank over all.

    edges (src, dst) are taken once each. Each iteration is one join and one aggregate, whose
    row for no target holds the loose rank; ranks are checkpointed, so plans stay small.
    """
    links = edges.select(F.col("src").alias("node"), "dst").distinct()
    out = links.groupBy("node").agg(F.count(F.lit(1)).alias("deg"))
    base = nodes.select("node").distinct().join(out, "node", "left")
    base = cut(base)
    n = max(base.count(), 1)
    ranks = base.select("node", "deg", F.lit(1.0 / n).alias("rank"))
    for _ in range(iterations):
        given = ranks.join(links, "node", "left").groupBy("dst").agg(F.sum(F.col("rank") / F.coalesce("deg", F.lit(1))).alias("got"))
        given = cut(given)
        loose = given.filter("dst IS NULL").agg(F.coalesce(F.sum("got"), F.lit(0.0)).alias("loose"))
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("loose") / n)
        ranks = base.join(given, F.col("node") == F.col("dst"), "left").crossJoin(F.broadcast(loose)).select("node", "deg", rank.alias("rank"))
    return ranks.select("node", "rank")


def reachable(edges: DataFrame, seeds: DataFrame, depth: int = 2, both_ways: bool = True) -> DataFrame:
    """(node, depth): nodes within depth steps of the seeds (node), forward and, if both_ways, backward.

    Each round writes the nodes it reaches first to one folder that all rounds read, so a round's
    plan is one join and one anti join at any depth. Ends early where nothing new is reached.
    """
    spark = edges.sparkSession
    links = edges.select("src", "dst")
    if both_ways:
        links = links.unionByName(links.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    links = cut(links)
    start = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    folder = new_folder(spark, "reached")
    read = lambda path: spark.read.schema(start.schema).option("recursiveFileLookup", "true").parquet(path)
    start.write.parquet(f"{folder}/0")
    for d in range(1, depth + 1):
        step = read(f"{folder}/{d - 1}").join(links, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        front = step.join(read(folder).select("node"), "node", "left_anti").withColumn("depth", F.lit(d))
        front.write.parquet(f"{folder}/{d}")
        if read(f"{folder}/{d}").isEmpty():
            break
    return read(folder)


def impact(imports: DataFrame, changed: DataFrame, calls: DataFrame, symbols: DataFrame, depth: int = 4) -> DataFrame:
    """(path, reason, of): files that a change of files (node) may touch, with every reason once.

    imports: (src, dst), src imports dst; calls: (src, dst) between symbols; symbols: (symbol,
    path). Reasons are "changed" (of is null), "imports" a file reached in fewer than depth steps,
    and "calls" a symbol reached so from those of the changed files.
    """
    known = changed.select("node").distinct()
    back = lambda edges: edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    files = reachable(back(imports), known, depth, both_ways=False).filter(F.col("depth") < depth)
    by_file = imports.join(files.select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("path"), F.lit("imports").alias("reason"), F.col("dst").cast("string").alias("of"))
    own = symbols.join(known, F.col("path") == F.col("node"), "left_semi").select(F.col("symbol").alias("node"))
    reached = reachable(back(calls), own, depth, both_ways=False).filter(F.col("depth") < depth)
    callers = calls.join(reached.select(F.col("node").alias("dst")), "dst", "left_semi").join(symbols, F.col("src") == F.col("symbol"))
    by_call = callers.select("path", F.lit("calls").alias("reason"), F.col("dst").cast("string").alias("of"))
    first = known.select(F.col("node").alias("path"), F.lit("changed").alias("reason"), F.lit(None).cast("string").alias("of"))
    return first.unionByName(by_file).unionByName(by_call).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that edges between the nodes reach, either way. Nodes without edges are their own.

    Each round takes the least label of the neighbours and then that label's own label, until
    none changes; labels are checkpointed. Nulls and loops link nothing.
    """
    labels = nodes.select("node").filter("node IS NOT NULL").distinct().withColumn("component", F.col("node"))
    labels = cut(labels)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst")
    known = labels.select("node")
    links = both.join(known.withColumnRenamed("node", "src"), "src", "left_semi").join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    links = cut(links.select("src", "dst").distinct())
    while True:
        near = links.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("component").alias("_m"))
        step = labels.join(near, F.col("node") == F.col("src"), "left").select("node", F.col("component").alias("_old"), F.least("component", F.coalesce("_m", "component")).alias("_c"))
        step = cut(step)
        own = step.select(F.col("node").alias("_c"), F.col("_c").alias("_cc"))
        labels = cut(step.join(own, "_c").select("node", "_old", F.least("_c", "_cc").alias("component")))
        if labels.filter("_old <> component").isEmpty():
            return labels.select("node", "component")
        labels = labels.select("node", "component")


def boosts(selected: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, boost): strengths of the edges (src, dst, strength) from selected nodes, summed by target and divided by the largest sum; 1 at most."""
    sums = edges.join(selected.select(F.col("node").alias("src")).distinct(), "src", "left_semi").groupBy(F.col("dst").alias("node")).agg(F.sum("strength").alias("_s"))
    top = sums.agg(F.max("_s").alias("_top"))
    boost = F.when(F.col("_top") > 0, F.least(F.lit(1.0), F.col("_s") / F.col("_top"))).otherwise(F.col("_s"))
    return sums.crossJoin(F.broadcast(top)).select("node", boost.alias("boost"))


def dependents(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges (src, dst) into the targets (node)."""
    return edges.join(targets.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")


def invalidated(entries: DataFrame, members: DataFrame, stale: DataFrame) -> DataFrame:
    """entries (entry, quality, cascades) with quality lowered and cascades counted up where a fragment is stale, and affected.

    members: (entry, fragment); stale: (fragment, depth), depth 1 where null or lower. An entry keeps
    2 ** -(sum of 1 / depth over its stale fragments / its fragments) of its quality, and half of that
    from the fourth cascade on. Repeated members and stale fragments count once, the latter by their least depth.
    """
    depths = stale.groupBy("fragment").agg(F.greatest(F.lit(1), F.coalesce(F.min("depth"), F.lit(1))).alias("_depth"))
    # counted by depth first: few rows of an entry are left to sum
    marked = members.distinct().join(depths, "fragment", "left").groupBy("entry", "_depth").agg(F.count(F.lit(1)).alias("_n"))
    overlap = marked.groupBy("entry").agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") / F.col("_depth")).alias("_overlap"))
    joined = entries.join(overlap.filter("_overlap > 0"), "entry", "left").withColumn("affected", F.col("_overlap").isNotNull())
    cascades = F.col("cascades") + F.col("affected").cast("int")
    quality = F.col("quality") * F.when(F.col("affected"), F.pow(F.lit(2.0), -F.col("_overlap") / F.col("_all")) * F.when(cascades > 3, 0.5).otherwise(1.0)).otherwise(1.0)
    return joined.select("entry", quality.alias("quality"), cascades.alias("cascades"), "affected")


def without_sources(fragments: DataFrame, requested: DataFrame, source: str, key: str, derived: dict[str, DataFrame]) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Fragments without the requested sources, each derived table without rows of removed fragments, and the requested sources that no fragment has.

    A fragment without a source stays, as do derived rows without a fragment.
    """
    asked = requested.select(source).filter(F.col(source).isNotNull()).distinct()
    gone = fragments.join(asked, source, "left_semi").select(key).distinct()
    kept = {name: rows.join(gone, key, "left_anti") for name, rows in derived.items()}
    return fragments.join(asked, source, "left_anti"), kept, asked.join(fragments.select(source).distinct(), source, "left_anti")
