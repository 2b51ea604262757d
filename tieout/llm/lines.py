"""Fuzzy line deduplication by MinHash.

Lines are compared trimmed; equal ones are one line from then on. A line's signature has ``PARTS`` numbers: of the
hashes of all its shingles of ``SHINGLE`` characters, the ones that are verified, each takes the one that is nearest to
a mark of its own (the least after exclusive or). The marks differ in their first bits, so each looks at another part of
one permutation, and where a part is empty at its neighbours. ``BANDS`` bands of ``ROWS`` of the numbers bring
candidates together, and a sketch, four bits of each number, passes over candidates of which too few agree.
First every line of a band is paired with the band's smallest line, and pairs are verified by the exact Jaccard
similarity of their shingles. Then the lines of a band that are not yet connected are compared by their sketches with
all others of the band, inside the join, so that only pairs that may be similar become rows. The components of all
verified pairs are found by star contraction. Of each component the first line of the smallest document stays, at its
first place there; all other lines of the component go.

All of it is DataFrame functions. Shingles never are rows of their own: a line in UTF-32 is cut at fixed places into
``CHUNK`` shingles a row, which are hashed as columns and reduced to the signature by one aggregate.

Recall is that of bands and sketches: two lines of similarity 0.8 meet in a band with probability 0.985, and
their sketches agree enough with 0.999. Any two lines that meet so end up compared or already connected.

A NULL text counts as empty. Blank lines are left as they are. Rows with the same id count as one document: a line that
stays, stays in each of them at its first place. A line of less than ``SHINGLE`` characters is its own
only shingle. Rows without an id lose no lines and give none away. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tieout.llm.common import components, reachable
from tieout.session import Kept, stored

SIMILARITY = 0.8
SHINGLE = 5
PARTS = 32
BANDS, ROWS = 16, 5
#: So many bands are dealt at once; their shuffle is the largest but for that of the lines.
DEALT = 8
#: Of the sketches' 32 parts so many must agree. At similarity 0.8, one band agreeing, 26.1 do on average, with a
#: standard deviation of 2.2.
AGREE = 19
#: Shingles of a line that are hashed in one row.
CHUNK = 16
#: Lines are looked up through marks for so many slots of hashes (a bit each, 1 MB), which go to every task.
SLOTS = 1 << 23

BLANK = " \t\r\f\v"


def _constants() -> list[int]:
    """A number of 64 bits for each part, signed, the part's number in its first bits."""
    chance, low = random.Random(5), 64 - (PARTS.bit_length() - 1)
    made = [k << low | chance.getrandbits(low) for k in range(PARTS)]
    return [x - (1 << 64) if x >> 63 else x for x in made]


def _layout() -> list[list[int]]:
    """The parts of each band: every part is in as many bands, and no band has one twice."""
    chance, left, found = random.Random(7), [], []
    for _ in range(BANDS):
        band: list[int] = []
        while len(band) < ROWS:
            if not set(left) - set(band):
                left += chance.sample(range(PARTS), PARTS)
            band.append(left.pop(next(i for i, p in enumerate(left) if p not in band)))
        found.append(band)
    return found


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    reachable(docs.sparkSession)
    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null")


def _lines(texts: DataFrame) -> DataFrame:
    """Columns id, pos, line (trimmed, not blank) and its two hashes h and g."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("id", "pos", F.btrim("line", F.lit(BLANK)).alias("line")).filter("line <> ''")
    return lines.select("id", "pos", "line", F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"))


def _marks(rows: DataFrame, number: Column) -> np.ndarray:
    """Which of ``SLOTS`` slots the numbers fall into: words of 64 bits, as many however many rows there are."""
    slot = number.bitwiseAND(F.lit(SLOTS - 1))
    bit = F.expr("shiftleft(1L, cast(slot & 63 as int))")
    words = rows.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    marks = np.zeros(SLOTS // 64, np.int64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return marks


def _marked(rows: DataFrame, marks: np.ndarray, number: Column) -> DataFrame:
    """The rows whose number falls into a marked slot; the marks are a table of one row that goes to every task."""
    array = pa.ListArray.from_arrays(pa.array([0, len(marks)], pa.int32()), pa.array(marks))
    one = rows.sparkSession.createDataFrame(pa.Table.from_arrays([array], ["_marks"]))
    slot = number.bitwiseAND(F.lit(SLOTS - 1))
    here = rows.withColumn("_word", F.shiftright(slot, 6).cast("int")).withColumn("_bit", slot.bitwiseAND(F.lit(63)).cast("int"))
    return here.join(F.broadcast(one), F.expr("(shiftrightunsigned(get(_marks, _word), _bit) & 1L) = 1")).drop("_marks", "_word", "_bit")


def _points(rows: DataFrame) -> DataFrame:
    """The rows with their lines as four bytes a character (u), and where the last shingle begins (last)."""
    rows = rows.withColumn("u", F.encode("line", "UTF-32"))
    return rows.withColumn("last", F.expr(f"greatest(0, cast(octet_length(u) div 4 as int) - {SHINGLE})")).drop("line")


def _shingle(at: str) -> Column:
    return F.xxhash64(F.expr(f"substring(u, 4 * {at} + 1, {4 * SHINGLE})"))


def signed(texts: DataFrame) -> DataFrame:
    """Every line once: its two hashes h and g, n (how often it occurs), least (its smallest document) and the
    numbers m0, m1 … of its signature."""
    each = _lines(texts).groupBy("h", "g").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.min("line").alias("line"))
    parts = _points(each).withColumn("at", F.explode(F.sequence(F.lit(0), "last", F.lit(CHUNK))))
    # Beyond the end the last shingle repeats, which changes no least number.
    parts = parts.select("h", "g", "n", "least", *[_shingle(f"least(at + {k}, last)").alias(f"x{k}") for k in range(CHUNK)])
    # The rows are dealt by h and g already, so this moves none.
    nearest = [F.min(F.least(*[F.col(f"x{k}").bitwiseXOR(F.lit(c)) for k in range(CHUNK)])).alias(f"m{i}") for i, c in enumerate(_constants())]
    found = parts.groupBy("h", "g", "n", "least").agg(*nearest)
    # The first bits are alike in all; the last 32 tell one shingle from another.
    last = [F.shiftright(F.shiftleft(f"m{i}", 32), 32).cast("int").alias(f"m{i}") for i in range(PARTS)]
    return found.select("h", "g", "n", "least", *last)


def _sketches() -> list[Column]:
    """Four bits of each number of the signature, side by side in s0 and s1."""
    out = []
    for half in range(PARTS // 16):
        bits = F.lit(0).cast("long")
        for k in range(16):
            bits = bits.bitwiseOR(F.shiftleft(F.col(f"m{16 * half + k}").cast("long").bitwiseAND(F.lit(15)), 4 * k))
        out.append(bits.alias(f"s{half}"))
    return out


def banded(lines: DataFrame, start: int, stop: int) -> DataFrame:
    """Column h and some of the bands, each under its number."""
    return lines.select("h", *[F.xxhash64(F.lit(k), *[f"m{p}" for p in parts]).alias(f"b{k}") for k, parts in enumerate(_layout()) if start <= k < stop])


def _whole_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bands and lines, each pair once, of batches in the order of both. A band is never cut."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        band, h = batch.column("band").to_numpy(), batch.column("h").to_numpy()
        start = int(np.searchsorted(band, band[-1]))  # where its last band begins
        if start or held and held[0][0][0] != band[-1]:
            whole = [*held, (band[:start], h[:start])]
            yield _each_once(*(np.concatenate(x) for x in zip(*whole)))
            held = []
        held.append(_each_once(band[start:], h[start:]))
    if held:
        yield _each_once(*(np.concatenate(x) for x in zip(*held)))


def _each_once(band: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(h), bool)
    new[1:] = (band[1:] != band[:-1]) | (h[1:] != h[:-1])
    return band[new], h[new]


def shared(lines: DataFrame) -> DataFrame:
    """Columns band, h, n (lines of the band) and low (the smallest): the lines of every band that has more than one.
    Of a band of two there is only the row of the larger. Bands with the same lines are one: they are named by them."""
    spark = lines.sparkSession
    rows = lines.select(F.explode(F.array(*[c for c in lines.columns if re.fullmatch(r"b\d+", c)])).alias("band"), "h")
    each = rows.groupBy("band").agg(F.count("*").alias("n"), F.min("h").alias("low"), F.max("h").alias("high"))
    each = stored(each.filter("n > 1")).read(spark)
    two = each.filter("n = 2").select(F.xxhash64("low", "high").alias("band"), F.col("high").alias("h"), "n", "low")
    # Only what may be in a band of three or more moves once more.
    more = each.filter("n > 2").select("band", "n", "low")
    met = _marked(rows, _marks(more, F.col("band")), F.col("band")).join(more, "band")
    names = met.groupBy("band").agg(*[F.bit_xor(F.xxhash64("h", F.lit(k))).alias(f"x{k}") for k in range(2)])
    named = met.join(names, "band").select(F.xxhash64("n", "x0", "x1").alias("band"), "h", "n", "low")
    return two.unionAll(named).dropDuplicates(["band", "h"])


def looked_up(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Columns h and line of the lines in ``wanted`` (h, and least, the document to take it from)."""
    wanted = wanted.select("h", F.xxhash64("least").alias("k"))
    marks = _marks(wanted, F.col("h").bitwiseXOR(F.col("k")))
    each = _lines(texts).select("h", F.xxhash64("id").alias("k"), "line")
    likely = _marked(each, marks, F.col("h").bitwiseXOR(F.col("k")))
    return likely.join(wanted, ["h", "k"], "left_semi").groupBy("h").agg(F.min("line").alias("line"))


def _alike(a: str, b: str) -> Column:
    """Whether enough parts of two lines' sketches (columns with these prefixes) agree."""
    differing = F.lit(0)
    for k in range(2):
        x = F.col(f"{a}s{k}").bitwiseXOR(F.col(f"{b}s{k}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        differing = differing + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return differing <= 32 - AGREE


def pairs(bands: DataFrame) -> DataFrame:
    """Columns a and b: each line of a band with the band's smallest line."""
    return bands.filter("h <> low").select(F.col("h").alias("a"), F.col("low").alias("b")).distinct()


def unconnected(bands: DataFrame, classes: DataFrame, known: DataFrame) -> DataFrame:
    """Columns a and b: all pairs of a band that are not of one component and may be similar. ``known`` holds the
    lines' sketches."""
    # Two lines of a band alone were compared when they were paired with the smallest.
    placed = bands.filter("n > 2").join(classes.withColumnRenamed("node", "h"), "h", "left").withColumn("component", F.coalesce("component", "h"))
    several = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
    met = placed.join(several.select("band"), "band").select("band", "h", "component").join(known.select("h", "s0", "s1"), "h")
    # One end of each pair is outside the largest component of its band.
    largest = met.groupBy("band", "component").count().groupBy("band").agg(F.max_by("component", F.struct("count", "component")).alias("largest"))
    outside = met.join(largest, "band").filter("component <> largest")
    outside = outside.select(F.col("band").alias("ob"), F.col("h").alias("o"), F.col("component").alias("c"), F.col("s0").alias("os0"), F.col("s1").alias("os1"))
    both = outside.join(met, (F.col("ob") == F.col("band")) & (F.col("c") != F.col("component")) & _alike("o", ""))
    return both.select(F.greatest("o", "h").alias("a"), F.least("o", "h").alias("b")).distinct()


def alike(found: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose sketches agree enough."""
    for side in "ab":
        found = found.join(known.select(F.col("h").alias(side), *[F.col(f"s{k}").alias(f"{side}s{k}") for k in range(2)]), side)
    return found.filter(_alike("a", "b")).select("a", "b")


def ends_of(found: DataFrame, known: DataFrame) -> DataFrame:
    """Columns h and least of the lines in pairs."""
    return known.join(found.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "h", "left_semi").select("h", "least")


def verified(found: DataFrame, lines: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets of all shingles have this Jaccard similarity."""
    for side, line in ("ax", "by"):
        found = found.join(lines.select(F.col("h").alias(side), F.col("line").alias(line)), side)
    sides = F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(line).alias("line")) for i, line in enumerate("xy")]))
    each = _points(found.select("a", "b", sides.alias("s")).select("a", "b", "s.*"))
    each = each.withColumn("at", F.explode(F.sequence(F.lit(0), "last", F.lit(CHUNK))))
    each = each.select("a", "b", "side", F.array(*[_shingle(f"least(at + {k}, last)") for k in range(CHUNK)]).alias("xs"))
    # The rows are dealt by one end of the pair already, so this moves none.
    both = each.groupBy("a", "b").agg(*[F.flatten(F.collect_list(F.when(F.col("side") == i, F.col("xs")))).alias(x) for i, x in enumerate("xy")])
    common = F.size(F.array_intersect("x", "y"))
    return both.filter(common >= F.lit(similarity) * F.size(F.array_union("x", "y"))).select("a", "b")


def places_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Columns id, pos, h and g of the lines that fall into the slots of ``wanted``, all of its own among them."""
    return _marked(_lines(texts).select("id", "pos", "h", "g"), _marks(wanted, F.col("h")), F.col("h"))


def find_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Columns ``key`` and ``removed``: for each document that loses lines, their places from 0."""
    spark = docs.sparkSession
    texts = _texts(docs, key, text)
    used: list[Kept] = []

    def kept(df: DataFrame) -> DataFrame:
        used.append(stored(df))
        # The shuffles behind a written table are of no more use; Spark deletes their files once the JVM has
        # collected their plans.
        spark._jvm.System.gc()
        return used[-1].read(spark)

    lines = kept(signed(texts))
    parts = [stored(shared(banded(lines, k, min(k + DEALT, BANDS)))) for k in range(0, BANDS, DEALT)]
    bands = kept(parts[0].read(spark, *parts[1:]).dropDuplicates(["band", "h"]))
    for part in parts:
        part.drop(spark)
    ends = bands.select(F.explode(F.array("h", "low")).alias("h")).distinct().withColumn("meets", F.lit(True))
    found = kept(lines.select("h", "g", "n", "least", *_sketches()).join(ends, "h", "left").filter("n > 1 or meets"))
    used.pop(0).drop(spark)  # the signatures
    known = found.filter("meets").select("h", "least", "s0", "s1")

    def similar(some: DataFrame) -> DataFrame:
        return kept(verified(some, looked_up(texts, ends_of(some, known)), similarity))

    close = similar(kept(alike(pairs(bands), known)))
    first = components(close)
    further = kept(unconnected(bands, first.read(spark), known))
    used.pop(0).drop(spark)  # the shared bands
    linked = components(close.unionByName(similar(further)))
    several = found.join(linked.read(spark).withColumnRenamed("node", "h"), "h", "left").filter("n > 1 or component is not null")
    several = kept(several.select("h", "g", "least", F.coalesce("component", "h").alias("component")))
    keeper = several.groupBy("component").agg(F.min("least").alias("keeper"))
    several = stored(several.join(keeper, "component").select("h", "g", "component", "keeper")).read(spark)
    for table in (*used, first, linked):
        table.drop(spark)
    places = places_of(texts, several).join(several, ["h", "g"])
    stays = places.filter("id = keeper").groupBy("id", "component").agg(F.min("pos").alias("first"))
    gone = places.join(stays, ["id", "component"], "left").filter("first is null or pos <> first")
    return gone.groupBy("id").agg(F.collect_set("pos").alias("removed")).withColumnRenamed("id", key)


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY, counts: bool = True) -> DataFrame:
    """The rows of ``docs`` with the texts that are left, and with ``counts`` how many lines each had and lost."""
    gone = find_duplicates(docs, key, text, similarity).select(F.col(key).alias("_dedup_id"), F.col("removed").alias("_dedup_gone"))
    joined = docs.join(gone, F.col(key) == F.col("_dedup_id"), "left").withColumn("_dedup_lines", F.split(F.col(text), "\n", -1))
    many = F.size("_dedup_lines")
    here = F.filter("_dedup_gone", lambda p: p < many)
    kept = F.array_except(F.sequence(F.lit(0), many - 1), here)
    left = F.array_join(F.transform(kept, lambda i: F.get("_dedup_lines", i)), "\n")
    return joined.select(
        *[F.when(F.col("_dedup_gone").isNull(), F.col(text)).otherwise(left).alias(c) if c == text else F.col(c) for c in docs.columns],
        *[F.coalesce(many, F.lit(0)).alias("n_lines"), F.coalesce(F.size(here), F.lit(0)).alias("n_removed")][: 2 * counts],
    )
