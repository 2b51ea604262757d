"""Resolve typed values against the distinct values of a column, as a join without a bound on their number."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.model import quoted
from tieout.session import checkpointed

# Scores and limits of the match.
CONTAINS_SCORE = 0.82
SIMILARITY_FLOOR = 0.7
SIMILARITY_WEIGHT = 0.78
ACCEPT = 0.62


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def similarity(a: Column, b: Column) -> Column:
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def match_score(wanted: Column, value: Column) -> Column:
    """Score of two plain texts: equal, one within the other, or close by edit distance; else zero."""
    close = similarity(wanted, value)
    within = (F.length(wanted) > 2) & (F.contains(value, wanted) | F.contains(wanted, value))
    return (
        F.when((wanted == "") | (value == ""), F.lit(0.0))
        .when(wanted == value, F.lit(1.0))
        .when(within, F.lit(CONTAINS_SCORE))
        .when(close >= SIMILARITY_FLOOR, close * SIMILARITY_WEIGHT)
        .otherwise(F.lit(0.0))
    )


def _grams(text: Column, n: int) -> Column:
    """The distinct pieces of ``n`` characters of a text that has so many."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n))))


def _inside(inner: DataFrame, a: str, outer: DataFrame, b: str) -> DataFrame:
    """Pairs in which the text ``a`` may stand within the text ``b``.

    All pieces of three characters of ``a`` then stand in ``b``, so ``a`` is looked up by the rarest of them
    alone; one whose piece no ``b`` has is dropped. Shorter texts are pieces themselves.
    """
    long = F.length(a) > 2
    held = outer.filter(F.length(b) > 2).select(b, F.explode(_grams(F.col(b), 3)).alias("piece"))
    common = held.groupBy("piece").agg(F.count("*").alias("n"))
    asked = inner.filter(long).select(a, F.explode(_grams(F.col(a), 3)).alias("piece")).join(common, "piece", "left")
    rarest = asked.groupBy(a).agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("r")).filter("r.n > 0")
    pairs = rarest.select(a, F.col("r.piece").alias("piece")).join(held, "piece").select(a, b)
    short = inner.filter(~long & (F.col(a) != ""))
    for n in (1, 2):
        pieces = outer.filter(F.length(b) >= n).select(b, F.explode(_grams(F.col(b), n)).alias("piece"))
        pairs = pairs.unionAll(short.filter(F.length(a) == n).join(pieces, F.col(a) == F.col("piece")).select(a, b))
    return pairs


def _without_one(text: Column) -> Column:
    """Hashes of a text, and of what is left of it without each one of its characters."""
    cut = lambda i: F.xxhash64(F.concat(F.left(text, i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(text)), F.transform(F.sequence(F.lit(1), F.length(text)), cut)))


def _one_edit(wanted: DataFrame, keys: DataFrame) -> DataFrame:
    """Pairs one edit apart, and some two apart: they agree when one character of either or both is left out.

    One edit leaves more of a text than two do (of texts of more than two characters), whatever the lengths, so a
    text that has a partner here needs no other.
    """
    a = wanted.filter(F.length("w") > 2).select("w", F.explode(_without_one(F.col("w"))).alias("piece"))
    b = keys.select("k", F.explode(_without_one(F.col("k"))).alias("piece"))
    return a.join(b, "piece").select("w", "k").distinct().filter(F.levenshtein("w", "k") == 1)


def _edits(length: Column, share: float) -> Column:
    """The most edits that a text of this length and an accepted partner can be apart."""
    return F.floor(length * (share / (1 - share)) + 1e-9).cast("int")


def _cut(length: Column, share: float, i: Column) -> Column:
    """Where piece ``i`` of a text of this length begins, from 0; the pieces are one more than its edits."""
    return F.floor(length * i / (_edits(length, share) + 1)).cast("int")


def _close_pairs(wanted: DataFrame, known: DataFrame, share: float) -> DataFrame:
    """Pairs of texts at most ``share`` of the longer one's length apart in edits, and some others.

    A known text is cut into one piece more than the edits there can be, so one piece stands unchanged in
    its partner, moved by no more than the edits. Texts that share a piece so are the candidates.
    """
    k = F.col("k")
    size = F.length(k)
    pieces = F.transform(F.sequence(F.lit(0), _edits(size, share)), lambda i: F.struct(i.alias("i"), F.substring(k, _cut(size, share, i) + 1, _cut(size, share, i + 1) - _cut(size, share, i)).alias("piece")))
    known = known.filter("k <> ''").select("k", size.alias("n"), F.inline(pieces))
    w = F.col("w")
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(F.length(w) * (1 - share) - 1e-9).cast("int")), F.floor(F.length(w) / (1 - share) + 1e-9).cast("int"))
    asked = wanted.filter("w <> ''").select("w", F.explode(lengths).alias("n"))
    asked = asked.select("w", "n", _edits(F.col("n"), share).alias("edits"))
    asked = asked.select("w", "n", "edits", F.explode(F.sequence(F.lit(0), F.col("edits"))).alias("i"))
    begin = _cut(F.col("n"), share, F.col("i"))
    asked = asked.select("w", "n", "i", "edits", begin.alias("begin"), (_cut(F.col("n"), share, F.col("i") + 1) - begin).alias("size"))
    moved = F.sequence(F.greatest(F.lit(0), F.col("begin") - F.col("edits")), F.col("begin") + F.col("edits"))
    asked = asked.select("w", "n", "i", F.explode(F.array_distinct(F.transform(moved, lambda s: F.substring(w, s + 1, F.col("size"))))).alias("piece"))
    return asked.join(known, ["n", "i", "piece"]).select("w", "k")


def fuzzy_join(requests: DataFrame, column: str, values: DataFrame, value: str, accept: float = ACCEPT, by_word: bool = False, skip_words: Sequence[str] = ()) -> DataFrame:
    """Each request with its best value and score; NULL where nothing scores ``accept``.

    Distinct texts are matched once, however many rows have them, and there is no bound on how many values
    there are. Candidates come in steps of falling scores: equality and one text within the other by its
    rarest piece, then one edit, then an unchanged piece of close texts. Each step takes only what the steps before left
    without a match, which no later step could better; together they miss no pair that could be the best. Equal
    scores go to the first value in order. ``by_word`` also tries the single words of a request.
    """
    if not 0 < accept <= 1:
        raise ValueError("accept is above 0 and at most 1")
    usable = lambda t: (F.length(F.trim(t)) > 1) & ~F.lower(F.trim(t)).isin(*skip_words) if skip_words else F.length(F.trim(t)) > 1
    listed = requests.select(quoted(column).alias("text")).distinct()
    texts = F.concat(F.array("text"), F.split("text", r"\s+")) if by_word else F.array("text")
    listed = listed.select("text", F.explode(F.array_distinct(F.transform(F.filter(texts, usable), plain))).alias("w"))
    listed = checkpointed(listed.filter("w <> ''"))
    named = values.select(quoted(value).cast("string").alias("v")).filter("v is not null").distinct().select("v", plain(F.col("v")).alias("k")).filter("k <> ''")
    known = checkpointed(named.groupBy("k").agg(F.min("v").alias("v")))
    keys, floor = known.select("k"), max(SIMILARITY_FLOOR, accept / SIMILARITY_WEIGHT)

    def within(wanted: DataFrame) -> DataFrame:
        wanted = wanted.filter(F.length("w") > 2)
        return _inside(wanted, "w", keys, "k").unionAll(_inside(keys, "k", wanted, "w").select("w", "k"))

    # Whether a match settles the whole request or only the word that has it: another, longer word may be closer.
    equal = lambda wanted: wanted.join(keys, F.col("w") == F.col("k")).select("w", "k")
    steps = [(lambda wanted: equal(wanted).unionAll(within(wanted)) if accept <= CONTAINS_SCORE else equal(wanted), "text")]
    if floor < 1:
        steps += [(lambda wanted: _one_edit(wanted, keys), "w"), (lambda wanted: _close_pairs(wanted, keys, 1 - floor), "w")]
    left, matched = listed, []
    for pairs, settles in steps:
        if matched and left.isEmpty():
            break
        scored = pairs(left.select("w").distinct()).distinct().select("w", "k", match_score(F.col("w"), F.col("k")).alias("score")).filter(F.col("score") >= accept)
        # The least pair of a falling score and a value is the first value of the best score.
        best = scored.join(known, "k").join(left, "w").groupBy("text", "w").agg(F.min(F.struct((-F.col("score")).alias("s"), "v")).alias("b"))
        matched.append(checkpointed(best))
        left = left.join(matched[-1].select(settles).distinct(), settles, "left_anti")
    best = reduce(DataFrame.unionAll, matched).groupBy("text").agg(F.min("b").alias("b"))
    found = best.select(F.col("text").alias("__text"), F.col("b.v").alias("matched_value"), (-F.col("b.s")).alias("match_score"))
    return requests.join(found, quoted(column) == F.col("__text"), "left").select(*[quoted(c) for c in requests.columns], "matched_value", "match_score")
