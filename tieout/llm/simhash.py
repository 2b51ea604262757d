"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A document's fingerprint is the bitwise majority of its shingles' hashes. Two fingerprints at most two
bits apart have a third one within one bit of both, so every distinct fingerprint sends out itself and
its 64 one-bit variants, and linked fingerprints meet at a variant. A variant has at most 65 distinct
fingerprints around it, all of them linked, so each is linked to the smallest of them after a check of
its distance: no group grows with the data, and no link is lost. Copies share one fingerprint and are
never compared. The links' components are found by star contraction.

A NULL text and one without words have the fingerprint zero, linked like any other. Repeated rows are
kept as they are. A NULL id takes no part in the smallest id; a group without any id has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.common import blocks, components
from tieout.session import stored

SHINGLE_WORDS = 3
SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of a UTF-8 text, as a signed 64-bit integer."""
    found = text.lower().split()
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(words)))) if len(found) >= words else iter([b" ".join(found)])
    n = max(1, len(found) - words + 1)
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), shingles), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        bits = np.unpackbits(hashes[i : i + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


def _fingerprints(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "text"):
        made = [fingerprint(t or b"", words) for t in batch.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(made, pa.int64())], ["id", "fingerprint"])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Columns ``key`` and ``fingerprint``, a row per row."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, fingerprint long"
    return rows.mapInArrow(lambda batches: _fingerprints(words, batches), schema).withColumnRenamed("id", key)


def links(distinct: DataFrame) -> DataFrame:
    """Columns a and b: links that connect what is at most two bits apart, from a column of distinct fingerprints."""
    fp = F.col("fingerprint")
    ball = F.concat(F.array(fp), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: fp.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))))
    met = distinct.select("fingerprint", F.explode(ball).alias("variant"))
    met = met.withColumn("first", F.min("fingerprint").over(Window.partitionBy("variant")))
    far = F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("first")))
    return met.filter("fingerprint <> first").filter(far <= 2).select(F.col("fingerprint").alias("a"), F.col("first").alias("b")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """Columns ``key``, ``fingerprint`` and ``component_id``: the smallest key that is linked, its own included."""
    spark = docs.sparkSession
    prints = stored(fingerprints(docs, key, text, words)).read(spark)
    distinct = stored(prints.groupBy("fingerprint").agg(F.min(key).alias("least"))).read(spark)
    found = components(links(distinct.select("fingerprint"))).read(spark)
    joined = distinct.join(found.withColumnRenamed("node", "fingerprint"), "fingerprint", "left")
    joined = joined.withColumn("component", F.coalesce("component", "fingerprint"))
    least = joined.filter("component <> fingerprint or least is not null").groupBy("component").agg(F.min("least").alias("component_id"))
    classes = joined.select("fingerprint", "component").join(least, "component", "left").select("fingerprint", "component_id")
    return prints.join(classes, "fingerprint").select(key, "fingerprint", "component_id")
