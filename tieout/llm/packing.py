"""Mixture-controlled packing by deficit round-robin.

Each source is a queue of tokens. The output is a row of windows, dealt out in cells of ``cell`` tokens.
A source earns its target share of every cell and is served when its deficit has grown to a cell: its
cell number k comes at (k + 1/2) / weight, and all cells in that order fill the windows. What a window
leaves a source short of is thus carried into the next one, and on from partition to partition, because
the order of any cell follows from the queues' sizes alone: every task computes the places of its own
documents by itself, in whole numbers, with no pass from window to window. A queue that runs dry leaves
its share to the others. The last part of each queue, less than a cell, goes to the end. So all windows
but the last are full.

Queues: every source whose share is at least one token of a window, which bounds their number by the
window's length, every source that ``weights`` names, and 64 queues that the other sources share. Sources and documents of a queue are in
the order of source and id. Texts are encoded once, and the ids wait in the shared folder until the
sizes of the queues are known.

A NULL text counts as empty and has the end id only. NULL is a source of its own. Rows with the same id
are packed each for itself. An empty table gives no pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.common import blocks
from tieout.llm.tokens import encoder
from tieout.session import stored

WINDOW = 1024
CELL = 128
SHARED_QUEUES = 64
#: Weights are scaled to at most this, so that a cell's place is exact in 64 bits up to 10^14 tokens.
SCALE = 1 << 20


def _encode(path: str, end: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code, part, sofar = encoder(path), TaskContext.get().partitionId(), {}
    stop = np.array([end], np.uint32)
    for batch in blocks(batches, "text"):
        starts, sizes, out = [], [], []
        for source, ids in zip(batch.column("source").to_pylist(), code.encode(batch.column("text"))):
            ids = np.concatenate([ids, stop])
            starts.append(sofar.get(source, 0))
            sizes.append(len(ids))
            sofar = {source: starts[-1] + len(ids)}  # the rows are sorted by source
            small = len(ids) == 0 or ids.max() < 1 << 16
            out.append((b"2" if small else b"4") + ids.astype("<u2" if small else "<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(sizes), pa.int32()), batch.column("source"), batch.column("id"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())],
            ["part", "source", "id", "local", "n", "ids"],
        )


class Places:
    """Where the tokens of each queue go."""

    def __init__(self, sizes: list[int], weights: list[float], cell: int, window: int):
        self.cell, self.window = cell, window
        sizes = np.array(sizes, np.int64)
        self.cells = sizes // cell
        largest = max([*weights, 0.0]) or 1.0
        self.weights = np.array([max(1, round(w / largest * SCALE)) for w in weights], np.int64)
        tails = sizes - self.cells * cell
        self.tails = self.cells.sum() * cell + np.cumsum(tails) - tails

    def rank(self, queue: int, cells: np.ndarray) -> np.ndarray:
        """How many cells of all queues come before these full cells of one queue."""
        out = cells.copy()
        mine = self.weights[queue]
        for j in np.flatnonzero(self.cells).tolist():
            if j != queue:  # those with (2k' + 1) / weight below (2k + 1) / mine; of equal ones the lower queue's
                out += np.minimum((((2 * cells + 1) * self.weights[j] - (j > queue)) // mine + 1) // 2, self.cells[j])
        return out

    def pieces(self, queue: int, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of documents that begin at these places of a queue, in order: which document, length, and place."""
        first = begins // self.cell
        many = (begins + sizes - 1) // self.cell - first + 1
        doc = np.repeat(np.arange(len(begins)), many)
        cells = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many - first, many)
        start = np.maximum(begins[doc], cells * self.cell)
        length = np.minimum(begins[doc] + sizes[doc], (cells + 1) * self.cell) - start
        full = cells < self.cells[queue]
        place = self.tails[queue] + start - self.cells[queue] * self.cell
        place[full] = self.rank(queue, cells[full]) * self.cell + start[full] % self.cell
        over = place % self.window + length - self.window
        for i in np.flatnonzero(over > 0)[::-1].tolist():  # a queue's last part may lie across two windows
            doc = np.insert(doc, i + 1, doc[i])
            place = np.insert(place, i + 1, place[i] + length[i] - over[i])
            length = np.insert(length, i + 1, over[i])
            length[i] -= over[i]
        # What follows in the same window of the same document is one piece.
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + length[:-1]) | (place[1:] % self.window == 0)
        at = np.flatnonzero(new)
        return doc[at], np.add.reduceat(length, at), place[at]


def _place(places: Places, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, "ids", 4 << 20):
        ids = np.concatenate([np.frombuffer(d, "<u2" if d[:1] == b"2" else "<u4", offset=1).astype("<u4") for d in batch.column("ids").to_pylist()])
        queues, begins, sizes = (np.asarray(batch.column(c)) for c in ("queue", "begin", "n"))
        # Rows of one queue mostly stand together; each run of them is placed in one go.
        edges = [0, *(np.flatnonzero(np.diff(queues)) + 1).tolist(), len(queues)]
        made = [places.pieces(int(queues[a]), begins[a:b], sizes[a:b]) for a, b in zip(edges, edges[1:])]
        doc = np.concatenate([d + a for (d, _, _), a in zip(made, edges)])
        length, at = (np.concatenate([m[i] for m in made]) for i in (1, 2))
        ends = np.cumsum(length)
        starts = ends - length - (np.cumsum(sizes) - sizes)[doc]
        bounds = pa.py_buffer(np.concatenate([[0], ends * 4]).astype(np.int32).tobytes())
        pieces = pa.Array.from_buffers(pa.binary(), len(doc), [None, bounds, pa.py_buffer(ids.tobytes())])
        taken = pa.array(doc)
        yield pa.RecordBatch.from_arrays(
            [batch.column("id").take(taken), batch.column("source").take(taken), pa.array(starts), pa.array(length), pa.array(sizes[doc]), pa.array(at // places.window), pa.array(at % places.window), pieces],
            ["id", "source", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )


def pack(
    docs: DataFrame, tokenizer: str, end: int = 0, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: dict[str | None, float] | None = None, window: int = WINDOW, cell: int = CELL,
) -> DataFrame:
    """A row per piece: its document and source, where it starts there, its length, the document's tokens, its sequence
    and place there, and its ids as little-endian 32-bit integers.

    ``weights`` are the target token proportions of named sources; by default, and for sources not
    named, a source's share of all tokens. ``window`` must be a multiple of ``cell``.
    """
    if window % cell:
        raise ValueError("a window is a whole number of cells")
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("id"), F.col(source).cast("string").alias("source"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("source", "id").sortWithinPartitions("source", "id")
    kind = rows.schema["id"].dataType.simpleString()
    coded = stored(ordered.mapInArrow(lambda b: _encode(tokenizer, end, b), f"part int, source string, id {kind}, local long, n long, ids binary")).read(spark)
    sizes = coded.groupBy("source", "part").agg(F.sum("n").alias("n"))
    by_source = sizes.groupBy("source").agg(F.sum("n").alias("n"))
    total = by_source.agg(F.sum("n")).first()[0]
    if not total:
        return spark.createDataFrame([], f"{key} {kind}, {source} string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")
    # At most ``window`` sources reach a share of one token of a window.
    named = F.col("source").isin([s for s in weights or {} if s is not None]) | F.lit(None in (weights or {})) & F.col("source").isNull()
    large = [r["source"] for r in by_source.filter((F.col("n") * window >= total) | named).select("source").sort("source").collect()]
    number = F.coalesce(*[F.when(F.col("source").eqNullSafe(F.lit(s)), i) for i, s in enumerate(large)], len(large) + F.pmod(F.xxhash64("source"), F.lit(SHARED_QUEUES)).cast("int"))
    queued = sizes.withColumn("queue", number)
    by_queue = {r["queue"]: r["n"] for r in queued.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    held = [by_queue.get(q, 0) for q in range(len(large) + SHARED_QUEUES)]
    wanted = [(weights or {}).get(large[q], n / total) if q < len(large) else n / total for q, n in enumerate(held)]
    before = Window.partitionBy("queue").orderBy("source", "part").rowsBetween(Window.unboundedPreceding, -1)
    base = stored(queued.select("source", "part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))).read(spark)
    base = base.select(F.col("source").alias("s"), F.col("part").alias("p"), "queue", "base")
    # One row per source and partition that has it; Spark sends it out if it is small.
    joined = coded.join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    joined = joined.select("id", "source", "n", "queue", (F.col("base") + F.col("local")).alias("begin"), "ids")
    places = Places(held, wanted, cell, window)
    schema = f"id {kind}, source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    packed = joined.mapInArrow(lambda b: _place(places, b), schema)
    return packed.withColumnRenamed("id", key).withColumnRenamed("source", source)


