"""Helpers shared by the text operators."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.session import Kept, stored

#: A task works on at most this many bytes of text at once; a longer text is a block of its own.
BLOCK_BYTES = 8 << 20


def reachable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, unless it is installed or shipped."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [root])


def blocks(batches: Iterator[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text each."""
    for batch in batches:
        array = batch.column(column)
        sizes = np.diff(offsets(array)) if len(array) else np.zeros(0, np.int64)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if start < len(array):
            yield batch.slice(start)


def offsets(array: pa.Array) -> np.ndarray:
    """Byte offsets of the texts of a string or binary array in its data buffer."""
    wide = pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type)
    kind = np.int64 if wide else np.int32
    if len(array) == 0 or array.buffers()[1] is None:
        return np.zeros(len(array) + 1, np.int64)
    found = np.frombuffer(array.buffers()[1], kind, array.offset + len(array) + 1)[array.offset :]
    return found.astype(np.int64)


def raw(array: pa.Array) -> np.ndarray:
    """The bytes of a string array's texts, one after the other, without those of NULLs and neighbours."""
    at = offsets(array)
    if array.null_count:
        return raw(array.fill_null(""))
    data = array.buffers()[2]
    if data is None:
        return np.zeros(0, np.uint8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]]


def spans_type() -> str:
    return "array<struct<kind:string,start:int,end:int>>"


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined, in the order they have."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def span_digest(spans: Column, kinds: tuple[str, ...]) -> Column:
    """SHA-256 of the spans of the given kinds, in lower-case hex."""
    return F.sha2(span_text(F.filter(spans, lambda s: s["kind"].isin(*kinds))), 256)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def components(edges: DataFrame, rounds: int = 60) -> Kept:
    """Connected components by repeated star contraction: a row (node, component) for each node of an edge.

    ``edges`` has long columns ``a`` and ``b``; the component is the smallest node that is connected.
    Each round links every node's larger neighbours to its smallest one, then its smaller neighbours to
    the smallest, until only stars are left, which takes about the logarithm of the longest path in
    rounds. Every round is a table in the shared folder, so a lost executor costs one round at most; no
    edges reach the driver. NULL ends and self links are dropped.
    """
    spark = edges.sparkSession
    pairs = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = stored(pairs)
    for _ in range(rounds):
        before = now.read(spark)
        both = before.unionAll(before.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: the neighbours above a node go to the smallest of its neighbourhood.
        large = before.select(F.col("a").alias("n"), F.col("b").alias("k")).join(least.withColumnRenamed("a", "k"), "k")
        large = large.select(F.col("n").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        # Small star: a node and its smaller neighbours go to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        small = small.select("e.a", "e.b").filter("a <> b").distinct()
        after = stored(small)
        grown = after.read(spark)
        # Only stars are left when no node both has a smaller neighbour and is one.
        done = grown.join(grown.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty() and _each_once(grown)
        now.drop(spark)
        now = after
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    last = now.read(spark)
    rows = last.select(F.col("a").alias("node"), F.col("b").alias("component"))
    own = last.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    result = stored(rows.unionAll(own))
    now.drop(spark)
    return result


def _each_once(pairs: DataFrame) -> bool:
    return pairs.groupBy("a").count().filter("count > 1").isEmpty()
