"""Benchmark decontamination: word windows of the test items, looked up in every document.

The windows of the benchmark go to every task as a set of hashes (the benchmark's size is checked
first). A task hashes the windows of its documents with array arithmetic, looks them up in the set, and
compares the words of each hit, so that a collision of hashes is never a finding.

A word is a run of characters other than ASCII punctuation, space and controls, with A-Z lowered. A
window is ``size`` consecutive words of an item; an item with fewer words, but not none, is one window.
NULL and empty texts have no words and no hits. Items without an id mark hits but are not listed. Rows
are judged each for itself, also repeated ones; an empty benchmark finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tieout.llm.common import blocks, offsets, raw

#: The benchmark goes to every task whole; a larger one must be given in parts.
BENCHMARK_BYTES = 256 << 20

FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    _low = _b + 32 if 65 <= _b <= 90 else _b
    FOLD[_b] = _low if 48 <= _low <= 57 or 97 <= _low <= 122 or _low >= 128 else 0

_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Words:
    """The words of texts that zero bytes set apart: where they are and a hash of each."""

    def __init__(self, data: np.ndarray):
        self.data = FOLD[data]
        edge = np.diff(np.concatenate([[0], (self.data != 0).view(np.int8), [0]]))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(self.starts):
            self.hashes = np.zeros(0, np.uint64)
            return
        inside = np.flatnonzero(self.data)
        sizes = self.ends - self.starts
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        powers = np.full(int(sizes.max()) + 1, _P, np.uint64).cumprod(dtype=np.uint64)
        place = np.arange(len(inside)) - np.repeat(first, sizes)
        self.hashes = _mixed(np.add.reduceat(self.data[inside].astype(np.uint64) * powers[place], first))

    def windows(self, size: int) -> np.ndarray:
        """A hash of each ``size`` consecutive words."""
        n = len(self.hashes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = np.zeros(n, np.uint64)
        for j in range(size):
            out *= _Q
            out += self.hashes[j : j + n]
        return _mixed(out)

    def text(self, first: int, size: int) -> tuple[bytes, ...]:
        return tuple(w for w in self.data[self.starts[first] : self.ends[first + size - 1]].tobytes().split(b"\0") if w)


class Windows:
    """The windows of a benchmark by their size and hash."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.items: dict[tuple[bytes, ...], set[str]] = {}
        hashes: dict[int, set[int]] = {}
        for key, text in items:
            words = Words(np.frombuffer((text or "").encode(), np.uint8))
            n = len(words.hashes)
            if not n:
                continue
            long = min(size, n)
            for i, h in enumerate(words.windows(long).tolist()):
                hashes.setdefault(long, set()).add(h)
                found = self.items.setdefault(words.text(i, long), set())
                if key is not None:
                    found.add(str(key))
        for long, found in hashes.items():
            known = np.array(sorted(found), np.uint64)
            bits = min(26, max(20, int(np.ceil(np.log2(16 * len(known))))))
            marks = np.zeros(1 << bits, bool)
            marks[(known >> np.uint64(64 - bits)).astype(np.int64)] = True
            self.by_size[long] = (known, marks)

    def hits(self, words: Words, doc: np.ndarray) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, size, items) of each window that occurs inside one document."""
        for size, (known, marks) in self.by_size.items():
            hashes = words.windows(size)
            shift = np.uint64(64 - int(np.log2(len(marks))))
            maybe = np.flatnonzero(marks[(hashes >> shift).astype(np.int64)])
            at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
            maybe = maybe[known[at] == hashes[maybe]]
            for i in maybe[doc[maybe] == doc[maybe + size - 1]].tolist():
                found = self.items.get(words.text(i, size))
                if found is not None:
                    yield i, size, found


FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,end:int>>"
SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _scan(windows: Windows, text: str, beside: list[str], names: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in blocks(batches, text, 4 << 20):
        texts = batch.column(text)
        if texts.null_count:
            texts = texts.fill_null("")
        sizes = np.diff(offsets(texts))
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])
        data = np.zeros(starts[-1], np.uint8)
        mask = np.ones(len(data), bool)
        mask[starts[1:] - 1] = False
        data[mask] = raw(texts)
        words = Words(data)
        doc = np.searchsorted(starts, words.starts, "right") - 1
        depth = np.zeros(len(doc) + 1, np.int64)
        items: list[set[str]] = [set() for _ in sizes]
        for i, size, found in windows.hits(words, doc):
            depth[i] += 1
            depth[i + size] -= 1
            items[doc[i]] |= found
        hit = np.cumsum(depth[:-1]) > 0
        spans: list[list] = [[] for _ in sizes]
        where = np.flatnonzero(hit)
        if len(where):
            new = np.flatnonzero(np.concatenate([[True], (np.diff(where) > 1) | (np.diff(doc[where]) > 0)]))
            lead = None
            for a, b in zip(where[new].tolist(), where[np.concatenate([new[1:] - 1, [len(where) - 1]])].tolist()):
                d = int(doc[a])
                if lead is None or lead[0] != d:
                    own = data[starts[d] : starts[d] + sizes[d]]
                    lead = (d, np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)]))
                spans[d].append({"start": int(lead[1][words.starts[a] - starts[d]]), "end": int(lead[1][words.ends[b] - starts[d]])})
        n = len(sizes)
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(c) for c in beside],
                pa.array(np.bincount(doc, minlength=n)),
                pa.array(np.bincount(doc[hit], minlength=n)),
                pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                pa.array(spans, SPANS),
            ],
            [*beside, *names],
        )


def find_overlap(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", size: int = 13,
    whole: bool = False, prefix: str = "",
) -> DataFrame:
    """A row per row of ``docs``: its words, the hit ones, the items found (sorted as text) and the hit stretches.

    They stand beside ``key``, or with ``whole`` beside all columns, under names that begin with ``prefix``.
    """
    spark = docs.sparkSession
    rows = benchmark.select(F.col(item).alias("id"), F.col(item_text).alias("text"))
    held = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if held > BENCHMARK_BYTES:
        raise ValueError(f"the benchmark has {held} bytes of text; give it in parts of at most {BENCHMARK_BYTES}")
    sent = spark.sparkContext.broadcast(Windows([(r["id"], r["text"]) for r in rows.collect()], size))
    chosen = docs if whole else docs.select(key, text)
    beside = chosen.columns if whole else [key]
    found = [StructField(prefix + f.name, f.dataType) for f in StructType.fromDDL(FOUND)]
    names = [f.name for f in found]
    return chosen.mapInArrow(lambda batches: _scan(sent.value, text, beside, names, batches), StructType([*[chosen.schema[c] for c in beside], *found]))


def is_contaminated(prefix: str = "", one_in: int = 20):
    """Whether at least one word in ``one_in`` is hit, over the columns of ``find_overlap``."""
    hit = F.col(f"{prefix}n_hit")
    return (hit > 0) & (hit * one_in >= F.col(f"{prefix}n_words"))


def without_spans(text, spans):
    """A text without its hit stretches: an expression over the columns of ``find_overlap``."""
    cut = F.aggregate(
        spans,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("at")),
        lambda a, s: F.struct(F.concat(a["done"], F.substring(text, a["at"] + 1, s["start"] - a["at"])).alias("done"), s["end"].alias("at")),
    )
    return F.concat(cut["done"], F.substring(text, cut["at"] + 1, F.length(text)))
