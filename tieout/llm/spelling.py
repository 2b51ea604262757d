"""Spelling variants: words one edit apart, found by dense prefix-suffix tiles, and the form each is likely meant for.

Words are compared in tiles. Two words differ by one inserted, deleted or replaced code point exactly if the
lengths of their common prefix and common suffix together reach the longer length minus one. The shorter
length ``s`` is cut into segments; the edit lies in one of them, so the words agree before and behind it. Every
word therefore goes to one tile for each segment of its own length and of that less one, and a tile holds the
words that agree outside the segment. A task lays the words of a tile out as two padded matrices of code points,
one aligned at the front and one at the back, and compares all pairs of rows for their common prefix and suffix.
A pair counts in the one tile whose segment holds the end of the common prefix, so none counts twice.

A tile of more than ``TILE`` words is cut into blocks by a hash of the word, and each pair of blocks is a tile of
its own, so that no task holds more than two blocks; no partner is left out. Segments have three code points for
words of up to 48, so the size of a tile is bound by the alphabet and not by the number of words.

The form of a word is its near word with the largest count (of equals the first in code-point order), where that
is ``TIMES`` times the word's own or more. Counts grow by that factor along a chain of forms, so chains are short;
their ends are found by doubling the steps, each round written to the shared folder.

NULL and empty texts have no words. A NULL id counts as an empty text where the id takes part in a hash. Rows are
counted each for itself, also repeated ones; a repeated id gives the same deletions in every row. An empty table
gives no words. Words of any length are whole. Only the id and the text are read, so other columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.session import Kept, stored

LEAST_LENGTH, LEAST_COUNT, TIMES = 6, 5, 5
#: One run in so many loses a code point, as the contract asks; 0 for none.
THINNED = 199
#: Words in a tile, and pairs (times their length) that a task compares at once.
TILE, CELLS = 1024, 1 << 24
SEGMENT, FEWEST, MOST = 3, 4, 16

OUTSIDE = "[^A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is. Pure ASCII takes the fast way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, thinned: int = THINNED) -> DataFrame:
    """The distinct words (word, n) of all texts that are long and frequent enough."""
    rows = docs.select(docs[id].alias("id"), docs[text].alias("text"))
    runs = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), F.explode(F.split("text", OUTSIDE)).alias("run"))
    runs = runs.filter(F.length("run") >= least_length).select("id", lowered(F.col("run")).alias("run"))
    word = F.col("run")
    if thinned:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
        at = (F.col("h") % F.length("run")).cast("int")
        word = F.when(F.col("h") % thinned == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    counted = runs.select(word.alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _tiles(known: DataFrame) -> DataFrame:
    """Every word in its tiles: the shorter length s, the segment from lo to hi, and a hash of what lies outside it."""
    length = F.length("word")
    sized = known.select("word", "n", F.explode(F.array(length, length - 1)).alias("s")).filter("s > 0")
    cuts = F.least(F.lit(MOST), F.greatest(F.lit(FEWEST), F.ceil(F.col("s") / SEGMENT).cast("int")))
    cut = sized.select("word", "n", "s", cuts.alias("q")).select("word", "n", "s", "q", F.explode(F.sequence(F.lit(0), F.col("q") - 1)).alias("i"))
    cut = cut.select("word", "n", "s", F.expr("int(s * i div q)").alias("lo"), F.expr("int(s * (i + 1) div q)").alias("hi")).filter("lo < hi")
    behind = F.col("s") - F.col("hi")
    key = F.xxhash64("s", "lo", F.substring("word", F.lit(1), F.col("lo")), F.substring("word", length - behind + 1, behind))
    return cut.withColumn("key", key)


def _compared(words: list[str], s: np.ndarray, lo: np.ndarray, hi: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the given pairs of rows are one edit apart, and meet in the tile that counts them."""
    lengths = np.array([len(w) for w in words])
    width = int(lengths.max())
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    row = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    front = np.zeros((len(words), width), np.uint32)
    front[row, place] = points
    back = np.zeros((len(words), width), np.uint32)
    back[row, np.repeat(lengths, lengths) - 1 - place] = points
    found = []
    step = max(1, CELLS // width)
    for at in range(0, len(left), step):
        a, b = left[at : at + step], right[at : at + step]
        short = np.minimum(lengths[a], lengths[b])
        prefix, suffix = (np.minimum(np.where((same := m[a] == m[b]).all(1), width, same.argmin(1)), short) for m in (front, back))
        first = np.minimum(prefix, short - 1)
        near = (prefix + suffix >= np.maximum(lengths[a], lengths[b]) - 1) & (short == s[a]) & (lo[a] <= first) & (first < hi[a])
        found.append(np.flatnonzero(near) + at)
    at = np.concatenate(found) if found else np.zeros(0, np.int64)
    return left[at], right[at]


def _pairs(bounds: np.ndarray, block: np.ndarray, across: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows within each group of consecutive rows; in a tile of two blocks only those across."""
    lefts, rights = [], []
    for begin, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if end - begin < 2:
            continue
        if across[begin]:
            a, b = np.flatnonzero(block[begin:end] == block[begin]) + begin, np.flatnonzero(block[begin:end] != block[begin]) + begin
            lefts.append(np.repeat(a, len(b)))
            rights.append(np.tile(b, len(a)))
        else:
            i, j = np.triu_indices(end - begin, 1)
            lefts.append(i + begin)
            rights.append(j + begin)
    none = np.zeros(0, np.int64)
    return (np.concatenate(lefts), np.concatenate(rights)) if lefts else (none, none)


NEAR = pa.schema([("word", pa.string()), ("n", pa.int64()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _near(rows: pa.Table) -> pa.RecordBatch:
    """For each word that has near words in these tiles: how many, and the best of them."""
    column = {c: rows.column(c).to_numpy() for c in ("n", "s", "lo", "hi", "key", "x", "y", "block")}
    names = rows.column("word").to_pylist()
    edge = np.zeros(len(names) + 1, bool)
    edge[0] = edge[-1] = True
    for c in ("key", "s", "lo", "x", "y"):
        edge[1:-1] |= column[c][1:] != column[c][:-1]
    left, right = _pairs(np.flatnonzero(edge), column["block"], column["x"] != column["y"])
    if not len(left):
        return pa.RecordBatch.from_pylist([], NEAR)
    left, right = _compared(names, column["s"], column["lo"], column["hi"], left, right)
    best: dict[str, list] = {}
    for a, b in zip(np.concatenate([left, right]).tolist(), np.concatenate([right, left]).tolist()):
        mine, other, times = names[a], names[b], int(column["n"][b])
        known = best.setdefault(mine, [int(column["n"][a]), 0, 0, ""])
        known[1] += 1
        if times > known[2] or times == known[2] and other < known[3]:
            known[2:] = [times, other]
    return pa.RecordBatch.from_arrays([pa.array(list(best), pa.string()), *(pa.array([v[k] for v in best.values()], NEAR.field(k + 1).type) for k in range(4))], schema=NEAR)


def _in_tiles(batches: Iterator[pa.RecordBatch], most: int = 8192) -> Iterator[pa.RecordBatch]:
    """Whole tiles, several at a time; the rows come sorted by tile and block."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n < most:
            continue
        rows = pa.Table.from_batches(held)
        last = [rows.column(c)[n - 1].as_py() for c in ("key", "s", "lo", "x", "y")]
        same = np.ones(n, bool)
        for c, v in zip(("key", "s", "lo", "x", "y"), last):
            same &= rows.column(c).to_numpy() == v
        end = int(np.flatnonzero(~same).max(initial=-1)) + 1
        if end:
            yield _near(rows.slice(0, end))
        held, n = rows.slice(end).to_batches(), n - end
    if n:
        yield _near(pa.Table.from_batches(held))


def near_words(known: DataFrame, tile: int = TILE) -> DataFrame:
    """Every word with its count, the number of its near words (n_near) and the best of those (best_n, best).

    ``known`` holds distinct words and their counts (word, n)."""
    tiles = _tiles(known)
    place = ["key", "s", "lo"]
    large = tiles.groupBy(*place).agg(F.count("*").alias("size")).filter(F.col("size") > tile)
    blocks = F.coalesce(F.ceil(F.col("size") / tile), F.lit(1)).cast("int")
    dealt = tiles.join(large, place, "left").withColumn("blocks", blocks)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    # A tile with one block is one cell; with more, every pair of blocks is.
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("block", "other")).withColumn("y", F.greatest("block", "other"))
    cells = dealt.select("word", "n", "s", "lo", "hi", "key", "x", "y", "block").repartition(*place, "x", "y").sortWithinPartitions(*place, "x", "y", "block")
    found = cells.mapInArrow(_in_tiles, "word string, n long, n_near long, best_n long, best string")
    alone = known.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    first = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("b"), F.col("best").alias("w"))))
    return (
        alone.unionAll(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), first.alias("first"))
        .select("word", "n", "n_near", (-F.col("first.b")).alias("best_n"), F.col("first.w").alias("best"))
    )


def _roots(formed: DataFrame) -> Kept:
    """The last form (root) of every word that has one, from the (word, form) rows."""
    spark = formed.sparkSession
    now = stored(formed.select("word", F.col("form").alias("root")))
    while True:
        steps = now.read(spark)
        further = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = stored(steps.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now.drop(spark)
        rows = moved.read(spark)
        if rows.filter("moved").isEmpty():
            return moved
        now = stored(rows.select("word", "root"))
        moved.drop(spark)


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", **limits: int) -> DataFrame:
    """Every word (word, n) with the number of its near words, its form (form, form_n) and the end of the chain of
    forms (root). The limits are those of ``words``."""
    spark = docs.sparkSession
    known = stored(words(docs, id, text, **limits))
    meant = F.col("best_n") >= TIMES * F.col("n")
    found = stored(
        near_words(known.read(spark)).select("word", "n", "n_near", F.when(meant, F.col("best")).alias("form"), F.when(meant, F.col("best_n")).alias("form_n"))
    )
    known.drop(spark)
    rows = found.read(spark)
    roots = _roots(rows.filter("form is not null").select("word", "form")).read(spark).select("word", "root")
    return rows.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
