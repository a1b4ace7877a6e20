"""Graphs as edge tables (source, target, ...): reach, paths, cycles, impact and integrity.

Rounds join tables of the shared folder, which bounds the plan, and no set of nodes ever reaches the driver. Long chains
take few rounds: reach doubles its stride while that does not make more links than the graph has, and cycles are looked for
after chains were contracted by pointer jumping.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from quillon.session import scratch, stored


def _links(edges: DataFrame, direction: str) -> DataFrame:
    """(from, to) pairs in walking order."""
    down = edges.select(F.col("source").alias("_from"), F.col("target").alias("_to"))
    up = edges.select(F.col("target").alias("_from"), F.col("source").alias("_to"))
    if direction == "downstream":
        return down.distinct()
    if direction == "upstream":
        return up.distinct()
    if direction == "both":
        return down.unionAll(up).distinct()
    raise ValueError(f"unknown direction {direction}")


#: A stride is doubled only while its links are at most this many times those of the graph.
GROWTH = 2
#: Depth limits up to which steps are taken one by one.
SHALLOW = 16


def _doubled(stride: DataFrame, links: int, keep) -> DataFrame | None:
    """Links of twice the stride, or None if there might be more of them than GROWTH times the graph's links."""
    enter = stride.groupBy(F.col("_to").alias("middle")).agg(F.count(F.lit(1)).alias("enter"))
    leave = stride.groupBy(F.col("_from").alias("middle")).agg(F.count(F.lit(1)).alias("leave"))
    size = enter.join(leave, "middle").agg(F.sum(F.col("enter").cast("double") * F.col("leave"))).first()[0] or 0
    if size > GROWTH * links:
        return None
    return keep(stride.join(stride.select(F.col("_from").alias("_to"), F.col("_to").alias("_end")), "_to").select("_from", F.col("_end").alias("_to")).distinct())


def reach(edges: DataFrame, roots: DataFrame, direction: str = "downstream", max_depth: int | None = None, until=None) -> DataFrame:
    """(root, node, depth): the nodes reached from each root, by least depth; all of them, or those within `max_depth` steps.

    A root itself appears only when a cycle leads back to it. With all depths up to L known, a round joins those of the
    last `stride` depths with the links of that stride, and knows all up to L + stride. Unless the limit is small, the
    stride doubles each round, so a long chain takes few rounds; where hubs make the doubled links too many, it stays.
    `until` ends the search with the round that reaches that node.
    """
    spark = edges.sparkSession
    with scratch(spark, "reach") as keep:
        links = keep(_links(edges, direction))
        size = links.count() if max_depth is None or max_depth > SHALLOW else 0
        start = roots.select(F.col("node").alias("root"), F.col("node").alias("_from")).distinct()
        found = keep(links.join(start, "_from").select("root", F.col("_to").alias("node"), F.lit(1).alias("depth")).distinct())
        known, depth, stride, strided = found, 1, 1, links
        levels = [found]
        while (max_depth is None or depth < max_depth) and not found.isEmpty():
            if until is not None and not found.where(F.col("node") == F.lit(until)).isEmpty():
                break
            if size and depth >= 2 * stride:
                twice = _doubled(strided, size, keep)
                strided, stride, size = (strided, stride, 0) if twice is None else (twice, 2 * stride, size)
            band = known.where(F.col("depth") > depth - stride)
            step = strided.join(band, strided["_from"] == band["node"]).groupBy("root", F.col("_to").alias("node")).agg((F.min("depth") + stride).alias("depth"))
            if max_depth is not None:
                step = step.where(F.col("depth") <= max_depth)
            found = keep(step.join(known.select("root", "node"), ["root", "node"], "left_anti"))
            levels.append(found)
            known = reduce(DataFrame.unionAll, levels)
            depth += stride
        return stored(known, "reached")


def shortest_path(edges: DataFrame, source, target, max_depth: int | None = None) -> DataFrame:
    """One row with the least-step path as an array, the smallest one among equals; else no row.

    Depths from the source, up to the target's, leave the links that lead one step deeper; those on a way to the target
    are found from its end. Each node then points to its smallest next one, and the pointers are followed from the source.
    """
    spark = edges.sparkSession
    kind = edges.schema["source"].dataType.simpleString()
    one = lambda name: spark.range(1).select(F.lit(name).cast(kind).alias("node"))
    if source == target:
        return one(source).select(F.array("node").alias("path"))
    ahead = reach(edges, one(source), "downstream", max_depth, until=target).where(F.col("node") != F.lit(source))
    ends = ahead.where(F.col("node") == F.lit(target)).first()
    if ends is None:
        return spark.createDataFrame([], f"path array<{kind}>")
    depths = ahead.select("node", "depth").unionAll(one(source).withColumn("depth", F.lit(0))).where(F.col("depth") <= ends["depth"])
    named = lambda side: depths.select(F.col("node").alias(side), F.col("depth").alias(f"_{side}"))
    deeper = edges.select("source", "target").distinct().join(named("source"), "source").join(named("target"), "target").where("_target = _source + 1")
    deeper = stored(deeper.select("source", "target"), "deeper")
    behind = reach(deeper, one(target), "upstream").select(F.col("node").alias("target")).unionAll(one(target).select(F.col("node").alias("target")))
    pointers = deeper.join(behind, "target", "left_semi").groupBy("source").agg(F.min("target").alias("target"))
    steps = reach(pointers, one(source), "downstream").select("node", "depth").unionAll(one(source).withColumn("depth", F.lit(0)))
    ordered = F.array_sort(F.collect_list(F.struct("depth", "node")))
    return steps.agg(F.transform(ordered, lambda step: step["node"]).alias("path"))


def impact_by_type(reached: DataFrame, assets: DataFrame) -> DataFrame:
    """Downstream assets per root and type; `assets` is (node, type)."""
    return reached.join(assets, "node").groupBy("root", "type").agg(F.count(F.lit(1)).alias("asset_count"))


def impact_summary(edges: DataFrame, roots: DataFrame, reached: DataFrame) -> DataFrame:
    """Per root: downstream assets, transformations involved and the risk level.

    `edges` is (source, target, transformation). A transformation is involved when its edge
    leaves the root or enters a downstream asset.
    """
    named = edges.filter(F.col("transformation").isNotNull())
    entering = reached.join(named, reached["node"] == named["target"]).select("root", "transformation")
    leaving = roots.join(named, roots["node"] == named["source"]).select(F.col("node").alias("root"), "transformation")
    used = entering.unionAll(leaving).distinct().groupBy("root").agg(F.count(F.lit(1)).alias("transformation_count"))
    assets = reached.groupBy("root").agg(F.count(F.lit(1)).alias("downstream_count"))
    score = F.col("downstream_count") + 2 * F.col("transformation_count")
    return (
        roots.select(F.col("node").alias("root")).distinct()
        .join(assets, "root", "left")
        .join(used, "root", "left")
        .na.fill(0, ["downstream_count", "transformation_count"])
        .withColumn("risk_score", score)
        .withColumn(
            "risk_level",
            F.when(score >= 20, "HIGH").when(score >= 10, "MEDIUM").when(score >= 5, "LOW").otherwise("MINIMAL"),
        )
    )


def dangling_edges(edges: DataFrame, assets: DataFrame, transformations: DataFrame | None = None) -> DataFrame:
    """(problem, reference) for edge ends, and transformations, that are not registered."""
    checks = [("missing source", "source", assets.select("node")), ("missing target", "target", assets.select("node"))]
    if transformations is not None:
        checks.append(("missing transformation", "transformation", transformations.select(F.col("id").alias("node"))))
    found = []
    for problem, column, known in checks:
        used = edges.select(F.col(column).alias("node")).filter(F.col("node").isNotNull()).distinct()
        found.append(
            used.join(known, "node", "left_anti").select(
                F.lit(problem).alias("problem"), F.col("node").cast("string").alias("reference")
            )
        )
    return reduce(DataFrame.unionAll, found)


def _ends(pointers: DataFrame, keep) -> DataFrame:
    """(node, end): where following the pointers leads, by pointer jumping.

    Where they end, `end` has none itself. Pointers into a ring never end: they are those left when a round ends no others.
    """
    jumps = keep(pointers.select("node", "end"))
    unended = lambda: jumps.join(jumps.select(F.col("node").alias("end")), "end", "left_semi").count()
    left = unended()
    while left:
        onward = jumps.select(F.col("node").alias("end"), F.col("end").alias("_next"))
        jumps = keep(jumps.join(onward, "end", "left").select("node", F.coalesce("_next", "end").alias("end")))
        before, left = left, unended()
        if left == before:
            break
    return jumps


def circular_assets(edges: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Assets from which a cycle can be reached.

    A node with one link shares the fate of where its chain of single links ends, which pointer jumping finds in rounds
    that grow with the logarithm of the chain; a chain into a ring leads to a cycle. Links into nodes without
    links are dropped, and so on until nothing changes.
    """
    with scratch(edges.sparkSession, "circular") as keep:
        links = keep(_links(edges, "downstream"))
        bound: list[tuple[DataFrame, DataFrame]] = []
        cyclic = links.where("_from = _to").select(F.col("_from").alias("node"))
        while True:
            out = links.groupBy("_from").agg(F.count(F.lit(1)).alias("n"), F.min("_to").alias("end"))
            jumps = _ends(out.where(F.col("n") == 1).select(F.col("_from").alias("node"), "end"), keep)
            single = jumps.select("node")
            ringed = keep(jumps.join(single.withColumnRenamed("node", "end"), "end", "left_semi").select("node"))
            cyclic = keep(cyclic.unionAll(ringed).distinct())
            bound.append((jumps, cyclic))
            # Links to a single node go to its end; a node that leads to a cycle needs no links any more.
            moved = links.join(single.withColumnRenamed("node", "_from"), "_from", "left_anti").join(jumps.select(F.col("node").alias("_to"), "end"), "_to", "left")
            moved = keep(moved.select("_from", F.coalesce("end", "_to").alias("_to")).distinct())
            met = moved.join(cyclic.withColumnRenamed("node", "_to"), "_to", "left_semi").select(F.col("_from").alias("node"))
            cyclic = keep(cyclic.unionAll(met).distinct())
            rest = moved.join(cyclic.withColumnRenamed("node", "_from"), "_from", "left_anti")
            alive = rest.select(F.col("_from").alias("_to")).unionAll(cyclic.select(F.col("node").alias("_to")))
            rest = keep(rest.join(alive, "_to", "left_semi"))
            if rest.isEmpty() or (rest.count() == links.count() and ringed.isEmpty()):
                # What still has links after a round that dropped none leads to a cycle.
                cyclic = keep(cyclic.unionAll(rest.select(F.col("_from").alias("node"))).distinct())
                break
            links = rest
        for jumps, _ in reversed(bound):
            led = jumps.join(cyclic.withColumnRenamed("node", "end"), "end", "left_semi").select("node")
            cyclic = keep(cyclic.unionAll(led).distinct())
        if assets is not None:
            cyclic = cyclic.join(assets.select("node"), "node", "left_semi")
        return stored(cyclic, "circular")


def neighbourhood(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """Nodes up to `depth` steps away (root included) and the edges walked between them."""
    around = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth")).distinct()
    reached = reach(edges, roots, direction, depth).join(
        around.select("root", "node"), ["root", "node"], "left_anti"
    )
    nodes = around.unionByName(reached)
    inner = nodes.filter(F.col("depth") < depth).select("root", "node")
    parts = []
    if direction in ("downstream", "both"):
        parts.append(inner.join(edges, inner["node"] == edges["source"]).select("root", *edges.columns))
    if direction in ("upstream", "both"):
        parts.append(inner.join(edges, inner["node"] == edges["target"]).select("root", *edges.columns))
    return nodes, reduce(DataFrame.unionAll, parts).distinct()


def feature_impact(edges: DataFrame, nodes: DataFrame, roots: DataFrame, depth: int | None = None) -> DataFrame:
    """Score per root: 0.1 per feature and 0.3 per model downstream (root included), at most 1."""
    below = reach(edges, roots, "downstream", depth).select("root", "node")
    own = roots.select(F.col("node").alias("root"), "node")
    typed = below.unionAll(own).distinct().join(nodes.select("node", "type"), "node")
    features, models = F.count_if(F.col("type") == "feature"), F.count_if(F.col("type") == "model")
    return typed.groupBy("root").agg(
        features.alias("feature_count"),
        models.alias("model_count"),
        F.least(features * 0.1 + models * 0.3, F.lit(1.0)).alias("impact_score"),
    )


def most_connected(edges: DataFrame, n: int = 5) -> DataFrame:
    """The n nodes with the most edges; ties go by node."""
    ends = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).orderBy(F.desc("degree"), "node").limit(n)


def direct_neighbours(edges: DataFrame, nodes: DataFrame, direction: str, types: list[str]) -> DataFrame:
    """(node, neighbour, type): direct dependencies (upstream) or consumers (downstream) by type."""
    links = _links(edges, direction).filter(F.col("_from") != F.col("_to"))
    kinds = nodes.select(F.col("node").alias("_to"), "type").filter(F.col("type").isin(types))
    return links.join(kinds, "_to").select(F.col("_from").alias("node"), F.col("_to").alias("neighbour"), "type")


def orphans(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes without any edge."""
    return nodes.join(edges.select(F.col("source").alias("node")), "node", "left_anti").join(
        edges.select(F.col("target").alias("node")), "node", "left_anti"
    )
