"""Roll comparison rows up the key prefix: year, then year and month, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tieout.functions.cells import severity
from tieout.functions.normalize import display_part
from tieout.functions.numbers import DELTA_TYPE, SUM_TYPE
from tieout.operators.compare import Comparison, magnitude
from tieout.model import quoted

# The order in which a group takes the worst status of its rows.
WORST = ["match", "mismatch", "onlyTarget", "onlySource"]


def drill_matrix(result: Comparison) -> DataFrame:
    """One row per node of the drill tree, with ``depth`` counted from 1.

    A node over a single row keeps that row's values, text included; a node over several rows has
    sums of the numbers only. Rolling up reads the compared rows, which are at the grain already, so
    its input is the number of keys and not the number of source rows.
    """
    names = [*result.keys]
    tags = [f"tag{i}" for i in range(len(names))]
    ranked = result.tagged_rows.withColumn(
        "worst", F.array_position(F.array(*[F.lit(w) for w in WORST]), F.col("status"))
    ).withColumn("leaves", F.lit(1).cast("bigint"))
    tree = ranked.select(*tags, F.lit(len(tags)).alias("depth"), "leaves", "worst", *_values(result))
    upper = tags[:-1]
    if upper:
        aggs = [F.count(F.lit(1)).alias("leaves"), F.max("worst").alias("worst")]
        for v in result.values:
            for part, dtype in (("source_num", SUM_TYPE), ("target_num", SUM_TYPE), ("delta", DELTA_TYPE)):
                aggs.append(F.sum(quoted(f"{v}_{part}")).cast(dtype).alias(f"{v}_{part}"))
            if v in result.text_values:
                aggs += [F.min(quoted(f"{v}_{part}")).alias(f"{v}_{part}") for part in ("source", "target")]
        rolled = (
            ranked.rollup(*upper)
            .agg(F.grouping_id().alias("open_levels"), *aggs)
            # Each open level is one bit of the id; the grand total has every level open.
            .withColumn("depth", F.lit(len(upper)) - F.bit_count("open_levels"))
            .where("depth > 0")
            .withColumn(tags[-1], F.lit(None).cast("string"))
        )
        tree = tree.unionByName(rolled.select(*tags, "depth", "leaves", "worst", *_values(result)))
    single = F.col("leaves") == 1
    out = [display_part(F.col(t)).alias(n) for t, n in zip(tags, names)] + [F.col("depth"), F.col("leaves")]
    out.append(F.element_at(F.array(*[F.lit(w) for w in WORST]), F.col("worst").cast("int")).alias("status"))
    for v in result.values:
        out += [quoted(f"{v}_{p}") for p in ("source_num", "target_num", "delta")]
        if v in result.text_values:
            out += [F.when(single, quoted(f"{v}_{p}")).alias(f"{v}_{p}") for p in ("source", "target")]
    return tree.select(*out)


def _values(result: Comparison):
    shown = [f"{v}_{p}" for v in result.values if v in result.text_values for p in ("source", "target")]
    return [quoted(f"{v}_{p}") for v in result.values for p in ("source_num", "target_num", "delta")] + [
        quoted(c) for c in shown
    ]


def worst_first(tree: DataFrame, result: Comparison, limit: int | None = None) -> DataFrame:
    ordered = tree.orderBy(
        "depth", severity(F.col("status")).desc(), magnitude(result.values).desc(), *[quoted(k) for k in result.keys]
    )
    return ordered if limit is None else ordered.limit(limit)
