"""Impact, order and cycles over an edges table ``src, dst``: ``src`` depends on ``dst``.

The iterations move whole frontiers: each round is a join with the edges, and its result is written
to the shared folder, so the plan stays small and a lost executor replays one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.session import Kept, checkpointed, stored


def cascade_impact(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Everything that depends, directly or not, on the nodes of ``start``: ``node, distance``.

    The starting nodes themselves are left out. Each round writes the newly reached nodes only; what
    was reached before is read from the earlier rounds' tables.
    """
    spark = edges.sparkSession
    steps = checkpointed(edges.select(F.col("src").alias("node"), F.col("dst").alias("of")).distinct())
    rounds = [stored(start.select("node").distinct().withColumn("distance", F.lit(0)))]
    while True:
        reached, frontier = rounds[0].read(spark, *rounds[1:]), rounds[-1].read(spark)
        fresh = (
            steps.join(frontier.select(F.col("node").alias("of")), "of")
            .select("node")
            .distinct()
            .join(reached.select("node"), "node", "left_anti")
            .withColumn("distance", F.lit(len(rounds)))
        )
        written = stored(fresh)
        if written.read(spark).isEmpty():
            return reached.where("distance > 0")
        rounds.append(written)


def usage_states(nodes: DataFrame, edges: DataFrame, related: DataFrame | None = None, report_refs: DataFrame | None = None) -> DataFrame:
    """referenced, unused, or no-refs for every node, with its number of dependents.

    Unused is only claimed when report references were scanned (``report_refs``: ``node, hits``).
    """
    used = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("dependents"))
    out = nodes.join(used, "node", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    hits, linked = F.lit(0), F.lit(False)
    if related is not None:
        out = out.join(related.select("node").distinct().withColumn("linked", F.lit(True)), "node", "left")
        linked = F.coalesce(F.col("linked"), F.lit(False))
    if report_refs is not None:
        out = out.join(report_refs.groupBy("node").agg(F.sum("hits").alias("hits")), "node", "left")
        hits = F.coalesce(F.col("hits"), F.lit(0))
    state = F.when((F.col("dependents") > 0) | linked | (hits > 0), "referenced").otherwise(
        "unused" if report_refs is not None else "no-refs"
    )
    return out.select("node", "dependents", hits.cast("bigint").alias("report_refs"), state.alias("state"))


def deletion_order(edges: DataFrame, doomed: DataFrame) -> DataFrame:
    """``node, step``: dependents before what they depend on. Nodes on a cycle come last, with no step.

    Each round removes the nodes no remaining node depends on.
    """
    spark = edges.sparkSession
    everything = checkpointed(doomed.select("node").distinct())
    remaining = everything
    inside = edges.where("src <> dst").join(remaining.withColumnRenamed("node", "src"), "src", "left_semi")
    inside = checkpointed(inside.join(remaining.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst").distinct())
    rounds: list[Kept] = []
    while True:
        free = remaining.join(inside.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
        written = stored(free.withColumn("step", F.lit(len(rounds) + 1)))
        placed = written.read(spark).select("node")
        if placed.isEmpty():
            stuck = remaining.withColumn("step", F.lit(None).cast("int"))
            return rounds[0].read(spark, *rounds[1:]).unionByName(stuck) if rounds else stuck
        rounds.append(written)
        remaining = everything.join(rounds[0].read(spark, *rounds[1:]).select("node"), "node", "left_anti")
        inside = checkpointed(inside.join(placed.withColumnRenamed("node", "src"), "src", "left_anti"))


def cycles(edges: DataFrame) -> DataFrame:
    """Nodes on a dependency cycle and the cycle group they belong to: ``node, cycle``.

    Nodes without both an incoming and an outgoing edge are peeled off. Of the rest, the largest node
    name that reaches each node marks it; the nodes of one mark that also reach the mark's own node
    form one group. Groups are removed and the rest goes around again.
    """
    links = checkpointed(edges.where("src <> dst").select("src", "dst").distinct())
    loops = edges.where("src = dst").select(F.col("src").alias("node"), F.col("src").alias("cycle")).distinct()
    found = checkpointed(loops)
    while True:
        links = _peel(links)
        if links.isEmpty():
            grouped = found.groupBy("node").agg(F.max("cycle").alias("cycle"))
            return grouped
        marks = _largest_reaching(links)
        same = (
            links.join(marks.select(F.col("node").alias("src"), F.col("mark").alias("sm")), "src")
            .join(marks.select(F.col("node").alias("dst"), F.col("mark").alias("dm")), "dst")
            .where("sm = dm")
            .select("src", "dst", F.col("sm").alias("mark"))
        )
        same = checkpointed(same)
        group = checkpointed(marks.where("node = mark"))
        frontier = group
        while True:
            back = same.join(frontier.select(F.col("node").alias("dst"), "mark"), ["dst", "mark"]).select(
                F.col("src").alias("node"), "mark"
            )
            fresh = checkpointed(back.distinct().join(group, ["node", "mark"], "left_anti"))
            if fresh.isEmpty():
                break
            group, frontier = checkpointed(group.unionByName(fresh)), fresh
        sizes = group.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
        found = checkpointed(
            found.unionByName(group.join(sizes, "mark", "left_semi").select("node", F.col("mark").alias("cycle")))
        )
        gone = group.select("node")
        links = links.join(gone.withColumnRenamed("node", "src"), "src", "left_anti")
        links = checkpointed(links.join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))


def _peel(links: DataFrame) -> DataFrame:
    size = links.count()
    while size:
        kept = links.join(links.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
        kept = kept.join(links.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
        links = checkpointed(kept)
        left = links.count()
        if left == size:
            break
        size = left
    return links


def _largest_reaching(links: DataFrame) -> DataFrame:
    """For every node the largest node that reaches it along the edges (itself included)."""
    nodes = links.select(F.col("src").alias("node")).unionByName(links.select(F.col("dst").alias("node"))).distinct()
    marks = checkpointed(nodes.withColumn("mark", F.col("node")))
    while True:
        sent = links.join(marks.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "mark")
        better = checkpointed(
            marks.unionByName(sent).groupBy("node").agg(F.max("mark").alias("mark"))
        )
        changed = better.join(marks, ["node", "mark"], "left_anti").isEmpty()
        marks = better
        if changed:
            return marks


def reference_tally(refs: DataFrame) -> DataFrame:
    """References per object and the distinct page and visual pairs they sit on.

    ``refs`` has ``object, page, visual``; a reference without a page counts but has no placement.
    """
    per_place = refs.groupBy("object", "page", "visual").agg(F.count(F.lit(1)).alias("n"))
    return per_place.groupBy("object").agg(
        F.sum("n").alias("references"), F.count_if(F.col("page").isNotNull()).alias("placements")
    )
