"""Token files compressed by a Re-Pair grammar, with random access.

Documents are sorted by their ids into range partitions, encoded, and cut into shards of whole
documents. In each shard frequent pairs of neighbouring ids are replaced by nonterminals, round after
round, and no pair reaches over the end of a document. A shard's row in the file holds its rules, the
length that each rule expands to, its symbols, and where each document begins among them, so that any
range of tokens is decoded from the symbols it touches alone. Shards are rows of a Parquet table in the
shared folder; a lost task writes its own again.

A NULL text counts as empty and has the end id only. Rows without an id come first; rows with the same
id follow each other. An empty table gives an empty file.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.common import BLOCK_BYTES, blocks
from tieout.llm.tokens import encoder
from tieout.session import Kept, stored

#: A shard is closed when it has this many ids; a longer document is a shard of its own.
SHARD_TOKENS = 2_000_000
#: Nonterminals are numbered from here; ids are below.
FIRST = 1 << 24
#: Rounds of replacement, pairs replaced in a round, and how often a pair must occur.
ROUNDS, PAIRS, LEAST = 4, 8192, 24
_BITS = 18


@dataclass
class Grammar:
    symbols: np.ndarray
    left: np.ndarray  # per rule
    right: np.ndarray
    lengths: np.ndarray  # ids that the rule expands to
    rounds: np.ndarray  # rules made up to the end of each round

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        made = symbols >= FIRST
        out[made] = self.lengths[symbols[made] - FIRST]
        return out

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """The ids of some symbols: the rounds' replacements undone from the last to the first."""
        bounds = [0, *self.rounds.tolist()]
        for low in reversed(bounds[:-1]):
            made = symbols >= FIRST + low
            if not made.any():
                continue
            at = np.concatenate([[0], np.cumsum(1 + made)])
            out = np.empty(at[-1], np.uint32)
            rules = symbols[made] - FIRST
            out[at[:-1]] = symbols
            out[at[:-1][made]] = self.left[rules]
            out[at[:-1][made] + 1] = self.right[rules]
            symbols = out
        return symbols

    def tokens(self, start: int, end: int) -> np.ndarray:
        """The ids from ``start`` to ``end`` without decoding what lies outside."""
        ends = np.cumsum(self.sizes(self.symbols))
        end = min(end, int(ends[-1]) if len(ends) else 0)
        if start >= end:
            return np.zeros(0, np.uint32)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, end, "left") + 1
        skipped = start - (int(ends[a - 1]) if a else 0)
        return self.expand(self.symbols[a:b])[skipped : skipped + end - start]


def compress(ids: np.ndarray, stop: int, rounds: int = ROUNDS, pairs: int = PAIRS, least: int = LEAST) -> Grammar:
    """The grammar of a shard. No pair begins with ``stop``, the last id of every document."""
    symbols, left, right, ends = ids.astype(np.uint32), [], [], []  # a copy
    lengths, made = np.zeros(0, np.int64), 0
    for _ in range(rounds):
        if len(symbols) < 2:
            break
        keys = symbols[:-1].astype(np.uint64)
        keys <<= np.uint64(32)
        keys |= symbols[1:]
        slots = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BITS)).astype(np.int32)
        # A slot speaks for one of its pairs, nearly always the frequent one; that pair's count is exact.
        speaks = np.zeros(1 << _BITS, np.uint64)
        speaks[slots] = keys
        mine = speaks[slots] == keys
        mine &= symbols[:-1] != stop
        at = np.flatnonzero(mine)
        slots = slots[at]
        counts = np.bincount(slots, minlength=1 << _BITS)
        chosen = np.flatnonzero(counts >= least)
        if len(chosen) > pairs:
            chosen = np.sort(chosen[np.argsort(-counts[chosen], kind="stable")[:pairs]])
        if not len(chosen):
            break
        found = speaks[chosen]
        number = np.full(1 << _BITS, -1, np.int32)
        number[chosen] = np.arange(len(chosen), dtype=np.int32)
        rule = number[slots]
        at, rule = at[rule >= 0], rule[rule >= 0]
        # Where matches overlap, the first, third, ... of the run are taken.
        new = np.concatenate([[True], np.diff(at) > 1])
        begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - begin) % 2 == 0
        at, rule = at[take], rule[take]
        symbols[at] = FIRST + made + rule
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols = symbols[keep]
        lo, hi = (found >> np.uint64(32)).astype(np.uint32), found.astype(np.uint32)
        grammar = Grammar(symbols, lo, hi, lengths, np.zeros(0))
        lengths = np.concatenate([lengths, grammar.sizes(lo) + grammar.sizes(hi)])
        left.append(lo)
        right.append(hi)
        made += len(found)
        ends.append(made)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint32)
    return Grammar(symbols, join(left), join(right), lengths, np.array(ends, np.int64))


def pack_shard(part: int, start: int, keys: list, counts: list[int], ids: np.ndarray, stop: int) -> dict:
    """A row of the file."""
    g = compress(ids, stop)
    ends = np.cumsum(g.sizes(g.symbols))
    docs = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64)
    first = np.searchsorted(ends, docs, "right")
    return {
        "part": part, "start": start, "n_tokens": len(ids), "keys": keys, "doc_tokens": counts, "doc_symbols": first.tolist(),
        "rounds": g.rounds.tolist(), "left": g.left.tobytes(), "right": g.right.tobytes(), "lengths": g.lengths.astype(np.uint32).tobytes(), "symbols": g.symbols.tobytes(),
    }


def grammar_of(row: dict) -> Grammar:
    a = lambda name: np.frombuffer(row[name], np.uint32)
    return Grammar(a("symbols"), a("left"), a("right"), a("lengths").astype(np.int64), np.array(row["rounds"], np.int64))


def _file_schema(key: str) -> str:
    return f"part int, start long, n_tokens long, keys array<{key}>, doc_tokens array<int>, doc_symbols array<int>, rounds array<int>, left binary, right binary, lengths binary, symbols binary"


def _arrow(key: pa.DataType) -> pa.Schema:
    ints = pa.list_(pa.int32())
    return pa.schema([("part", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("keys", pa.list_(key)), ("doc_tokens", ints), ("doc_symbols", ints), ("rounds", ints), *[(n, pa.binary()) for n in ("left", "right", "lengths", "symbols")]])


def _write(path: str, end: int, shard_tokens: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    code, part, start = encoder(path), TaskContext.get().partitionId(), 0
    keys: list = []
    held: list[np.ndarray] = []
    size, kind = 0, None

    def close() -> pa.RecordBatch:
        nonlocal keys, held, size, start
        row = pack_shard(part, start, keys, [len(x) for x in held], np.concatenate(held), end)
        start += size
        keys, held, size = [], [], 0
        return pa.RecordBatch.from_pylist([row], schema=_arrow(kind))

    stop = np.array([end], np.uint32)
    for batch in blocks(batches, "text", BLOCK_BYTES):
        kind = batch.schema.field("id").type
        for key, ids in zip(batch.column("id").to_pylist(), code.encode(batch.column("text"))):
            keys.append(key)
            held.append(np.concatenate([ids, stop]))
            size += len(ids) + 1
            if size >= shard_tokens:
                yield close()
    if held:
        yield close()


def write_tokens(docs: DataFrame, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> Kept:
    """Write the token file of a table in the order of its ids, each document followed by ``end``."""
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id")
    schema = _file_schema(rows.schema["id"].dataType.simpleString())
    return stored(ordered.mapInArrow(lambda batches: _write(tokenizer, end, shard_tokens, batches), schema))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = grammar_of(row).expand(np.frombuffer(row["symbols"], np.uint32))
            counts = np.array(row["doc_tokens"], np.int64)
            at = np.concatenate([[0], np.cumsum(counts)])
            for a in range(0, len(counts), 1000):
                b = min(a + 1000, len(counts))
                bounds = pa.py_buffer(((at[a : b + 1] - at[a]) * 4).astype(np.int32).tobytes())
                values = pa.Array.from_buffers(pa.binary(), b - a, [None, bounds, pa.py_buffer(ids[at[a] : at[b]].tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["keys"][a:b], batch.schema.field("keys").type.value_type), pa.array([row["part"]] * (b - a), pa.int32()), pa.array(row["start"] + at[a:b]), pa.array(counts[a:b]), values],
                    ["id", "part", "start", "n_tokens", "ids"],
                )


def read_tokens(file: DataFrame, key: str = "doc_id") -> DataFrame:
    """Decode a token file: a row per document with its start among all ids, and its ids as little-endian integers."""
    sizes = file.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # One row per partition of the writing job.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    kind = file.schema["keys"].dataType.elementType.simpleString()
    docs = file.mapInArrow(_read, f"id {kind}, part int, start long, n_tokens long, ids binary")
    return docs.join(F.broadcast(base), "part").select(F.col("id").alias(key), (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")
