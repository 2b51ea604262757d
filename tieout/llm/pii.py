"""Personal data: proposed spans judged by gradient-boosted trees, all in DataFrame functions.

Generators propose spans with high recall, also ones that overlap: four base kinds with fixed checks, and
looser kinds that no check settles. Each proposal gets features of its format and of the text around it.
What the checks say is the label of the base kinds. A loose proposal's label is evidence for it: the check digits
of an account, and for the other kinds a word for such data within ``NEAR`` characters before it, or the same address or
number in an accepted base span of the text. Features and labels are counted by combination (a bounded
table), and trees are boosted over those counts on the driver. Half of the documents fit the trees, the other half
sets a threshold for each loose kind, from its proposals that overlap no accepted base span: the lowest score
at which the chosen ones reach ``PRECISION``. The trees become one expression. Base spans that pass their checks
always stay; a loose proposal stays if it reaches its kind's threshold and overlaps none of them. A loose kind without
such evidence in the table gives no spans.

A NULL text counts as empty. Offsets are code points. Repeated rows are judged each for itself; other
columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieout.session import stored

#: Each match of these expressions is the leftmost one as long as possible. The looks behind keep a search
#: from starting again inside a run that it has been through, which changes no match.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Kinds without a check of their own.
LOOSE = {
    "veiled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[({](?i:at)[\])}] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[({](?i:dot)[\])}]) ?[A-Za-z0-9-]{1,63}+)++",
    "number": r"(?<![0-9A-Za-z])\(?[0-9]{2,4}+(?:[)\x20./-]{1,2}+[0-9]{2,4}+){2,5}+(?![0-9A-Za-z])",
    "account": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3})?+(?![0-9A-Za-z])",
}
#: A kind is looked for only in texts with such a character or number.
CUES = {"email": "@", "phone": "+", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "veiled_email": r"(?i)[\[({]at[\])}]", "number": r"[0-9]{2}[)\x20./-]{1,2}[0-9]{2}", "account": r"[A-Z]{2}[0-9]{2}"}
WORDS = r"(?i)(?:mail|phone|tel|call|fax|mobile|contact|card|visa|account|iban|bank|ssn|social|passport|birth|born|address|customer|client|kontakt|telefon|konto|karte|tarjeta|cuenta|correo|appel|compte|carte)"
#: Features look at this many characters before a span, evidence at so many.
AROUND, NEAR = 24, 40

FEATURES = ("digits", "groups", "gap", "before", "after", "words", "sign", "length", "kind_no", "checked")
ROUNDS, RATE, PENALTY, LEAST = 24, 0.3, 1.0, 2.0
PRECISION = 0.98
_BLOCK = 128


def _lengths(strings: Column) -> Column:
    return F.transform(strings, lambda s: F.length(s))


def _total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _spans(kind: str, gaps: Column, hits: Column) -> Column:
    """Places of the matches, from them and the text between them. Sums go by blocks, so many matches stay cheap."""
    many = F.size(hits)
    steps = F.zip_with(F.slice(gaps, 1, many), hits, lambda g, h: F.length(g) + F.length(h))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((many - 1) / _BLOCK).cast("int")), lambda b: _total(F.slice(steps, b * _BLOCK + 1, F.lit(_BLOCK))))

    def place(hit: Column, i: Column) -> Column:
        block = F.floor(i / _BLOCK).cast("int")
        upto = _total(F.slice(blocks, F.lit(1), block)) + _total(F.slice(steps, block * _BLOCK + 1, i % _BLOCK + 1))
        return F.struct(F.lit(kind).alias("kind"), (upto - F.length(hit)).alias("start"), upto.alias("end"), hit.alias("text"))

    return F.when(many > 0, F.transform(hits, place)).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int,text:string>>"))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, i: Column) -> Column:
        n = c.cast("int")
        return F.when(i % 2 == 0, n).otherwise(F.when(n > 4, 2 * n - 9).otherwise(2 * n))

    return _total(F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), value)) % 10 == 0


def _passes(span: Column) -> Column:
    """Whether a base span passes the check of its kind."""
    text, digits = span["text"], _digits(span["text"])
    # Leading zeros don't count; more than three digits are more than 255.
    parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    octets = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.left(p, F.lit(3)).cast("int") <= 255))
    return (
        F.when(span["kind"] == "email", True)
        .when(span["kind"] == "ip", octets)
        .when(span["kind"] == "card", _luhn(digits))
        .when(span["kind"] == "phone", F.length(digits).between(10, 15))
        .otherwise(False)
    )


def _iban(text: Column) -> Column:
    """Whether the check digits of an account number are right."""
    plain = F.regexp_replace(text, " ", "")
    turned = F.split(F.concat(F.substring(plain, 5, 1 << 20), F.substring(plain, 1, 4)), "(?<=.)(?=.)")
    value = lambda c: F.conv(c, 36, 10).cast("int")
    return F.aggregate(turned, F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97) == 1


def _evidence(text: Column, span: Column, sure: Column) -> Column:
    """Whether something beside its own format speaks for a loose proposal."""
    before = F.substring(text, F.greatest(span["start"] - NEAR + 1, F.lit(1)), F.least(span["start"], F.lit(NEAR)))
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace(span["text"], r" ?[\[({](?i:at)[\])}] ?", "@"), r" ?[\[({](?i:dot)[\])}] ?", "."), " ", "")
    digits = _digits(span["text"])
    elsewhere = F.exists(
        sure,
        lambda b: F.when(span["kind"] == "veiled_email", (b["kind"] == "email") & (F.lower(b["text"]) == F.lower(shown)))
        .otherwise(b["kind"].isin("phone", "card") & (F.length(digits) >= 8) & _digits(b["text"]).endswith(digits)),
    )
    return F.when(span["kind"] == "account", _iban(span["text"])).otherwise(before.rlike(WORDS) | elsewhere)


def _features(text: Column, span: Column) -> list[Column]:
    """Small whole numbers about the format of a span and what stands around it."""
    own, digits = span["text"], F.length(_digits(span["text"]))
    before = F.substring(text, F.greatest(span["start"] - AROUND + 1, F.lit(1)), F.least(span["start"], F.lit(AROUND)))
    after = F.substring(text, span["end"] + 1, F.lit(2))
    last = F.when(span["start"] > 0, F.substring(before, -1, 1)).otherwise("")
    level = lambda x, cuts: sum(((x >= c).cast("int") for c in cuts), F.lit(0))
    kind_of = lambda c: F.when(c.rlike(r"^[A-Za-z0-9]"), 1).when(c.rlike(r"^[/=#_:@+-]"), 2).otherwise(0)
    return [
        level(digits, (1, 6, 9, 10, 11, 12, 14, 16, 17)).alias("digits"),
        level(F.size(F.split(own, "[^0-9]+")), (2, 3, 4, 5, 6)).alias("groups"),
        F.when(own.contains("("), 4).when(own.contains("."), 3).when(own.contains("-"), 2).when(own.contains(" "), 1).otherwise(0).alias("gap"),
        kind_of(last).alias("before"),
        kind_of(after).alias("after"),
        before.rlike(WORDS).cast("int").alias("words"),
        F.when(own.contains("@"), 2).when(own.startswith("+"), 1).otherwise(0).alias("sign"),
        level(F.length(own), (9, 12, 16, 20, 28)).alias("length"),
        F.coalesce(*[F.when(span["kind"] == k, i) for i, k in enumerate((*BASE, *LOOSE))]).alias("kind_no"),
        F.when(span["kind"] == "account", _iban(own)).otherwise(False).cast("int").alias("checked"),
    ]


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key`` and ``spans``: all proposals with their place, label and features."""
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kinds = {**BASE, **LOOSE}
    cued = {k: F.col("text").contains(c) if len(c) == 1 else F.col("text").rlike(c) for k, c in CUES.items()}
    none = F.array().cast("array<string>")
    rows = rows.select("*", *[F.when(cued[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none).alias(f"h_{k}") for k, p in kinds.items()])
    rows = rows.select("*", *[F.when(F.size(f"h_{k}") > 0, F.split("text", p, -1)).otherwise(none).alias(f"g_{k}") for k, p in kinds.items()])
    rows = rows.select("id", "text", F.concat(*[_spans(k, F.col(f"g_{k}"), F.col(f"h_{k}")) for k in kinds]).alias("found"))
    base = F.filter("found", lambda s: s["kind"].isin(*BASE) & _passes(s))
    rows = rows.select("id", "text", "found", F.when(F.size("found") > 0, base).otherwise(F.col("found")).alias("sure"))

    def judged(s: Column) -> Column:
        inside = F.exists("sure", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        return F.struct(
            s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"),
            s["kind"].isin(*BASE).alias("base"), F.when(s["kind"].isin(*BASE), _passes(s)).otherwise(_evidence(F.col("text"), s, F.col("sure"))).cast("int").alias("label"), inside.alias("taken"),
            *_features(F.col("text"), s),
        )

    return rows.select(F.col("id").alias(key), F.transform("found", judged).alias("spans"))


@dataclass
class Trees:
    """Boosted trees of two levels: (feature, cut, feature, cut, feature, cut, four leaves), and a threshold for each loose kind."""

    start: float
    trees: list[tuple]
    thresholds: dict[str, float]

    @property
    def threshold(self) -> float:
        """The lowest of the kinds' thresholds."""
        return min(self.thresholds.values())

    def score(self, value) -> Column:
        """The score as an expression; ``value`` gives the column of a feature."""
        total = F.lit(self.start)
        for f, c, lf, lc, rf, rc, leaves in self.trees:
            side = lambda g, d, a, b: F.when(value(g) <= d, F.lit(a)).otherwise(F.lit(b))
            total = total + F.when(value(f) <= c, side(lf, lc, leaves[0], leaves[1])).otherwise(side(rf, rc, leaves[2], leaves[3]))
        return 1 / (1 + F.exp(-total))

    def of(self, x: tuple) -> float:
        total = self.start
        for f, c, lf, lc, rf, rc, leaves in self.trees:
            total += leaves[(0 if x[lf] <= lc else 1) if x[f] <= c else (2 if x[rf] <= rc else 3)]
        return 1 / (1 + math.exp(-total))


def boost(cells: list[tuple[tuple, float, float]], rounds: int = ROUNDS) -> tuple[float, list[tuple]]:
    """Newton boosting over counted cells (features, positives, negatives): the start and the trees."""
    yes, no = sum(c[1] for c in cells), sum(c[2] for c in cells)
    start = math.log((yes + 0.5) / (no + 0.5))
    margin, trees = [start] * len(cells), []
    if not yes or not no:
        return start, trees

    def best(members: list[int], slope: list[float], bend: list[float]) -> tuple[float, int, int]:
        found = (0.0, 0, 1 << 30)
        g, h = sum(slope[i] for i in members), sum(bend[i] for i in members)
        for f in range(len(FEATURES)):
            by: dict[int, list[float]] = {}
            for i in members:
                cell = by.setdefault(cells[i][0][f], [0.0, 0.0])
                cell[0] += slope[i]
                cell[1] += bend[i]
            a = b = 0.0
            for cut in sorted(by)[:-1]:
                a, b = a + by[cut][0], b + by[cut][1]
                gain = a * a / (b + PENALTY) + (g - a) ** 2 / (h - b + PENALTY) - g * g / (h + PENALTY)
                if gain > found[0] + 1e-12:
                    found = (gain, f, cut)
        return found

    for _ in range(rounds):
        slope, bend = [], []
        for (_, p, n), m in zip(cells, margin):
            q = 1 / (1 + math.exp(-m))
            slope.append((p + n) * q - p)
            bend.append((p + n) * q * (1 - q))
        everything = list(range(len(cells)))
        gain, f, c = best(everything, slope, bend)
        if gain <= 1e-9:
            break
        sides = [i for i in everything if cells[i][0][f] <= c], [i for i in everything if cells[i][0][f] > c]
        splits = [best(s, slope, bend)[1:] for s in sides]
        leaves = []
        for side, (g, d) in zip(sides, splits):
            for part in ([i for i in side if cells[i][0][g] <= d], [i for i in side if cells[i][0][g] > d]):
                step = -RATE * sum(slope[i] for i in part) / (sum(bend[i] for i in part) + PENALTY)
                leaves.append(step)
                for i in part:
                    margin[i] += step
        trees.append((f, c, *splits[0], *splits[1], tuple(leaves)))
    return start, trees


def fit(proposed: DataFrame, key: str = "doc_id") -> Trees:
    """Fit on what ``candidates`` gives. The counts by features are bounded by the features' levels."""
    rows = proposed.select(F.pmod(F.xxhash64(key), F.lit(2)).alias("fold"), F.explode("spans").alias("s"))
    counts = rows.groupBy("fold", F.col("s.kind").alias("kind"), (F.col("s.base") | F.col("s.taken")).alias("apart"), *[F.col(f"s.{f}").alias(f) for f in FEATURES])
    counts = counts.agg(F.sum("s.label").alias("yes"), F.count("*").alias("n")).collect()
    features = lambda r: tuple(r[f] for f in FEATURES)
    cells: dict[tuple, list[float]] = {}
    for r in counts:
        if r["fold"] == 0:
            cell = cells.setdefault(features(r), [0.0, 0.0])
            cell[0] += r["yes"]
            cell[1] += r["n"] - r["yes"]
    model = Trees(*boost(sorted((x, p, n) for x, (p, n) in cells.items())), dict.fromkeys(LOOSE, 1.0))
    for kind in LOOSE:
        scores: dict[float, list[float]] = {}
        for r in counts:
            if r["fold"] == 1 and r["kind"] == kind and not r["apart"]:
                cell = scores.setdefault(model.of(features(r)), [0.0, 0.0])
                cell[0] += r["yes"]
                cell[1] += r["n"]
        yes = n = 0.0
        for score in sorted(scores, reverse=True):
            yes, n = yes + scores[score][0], n + scores[score][1]
            if yes >= PRECISION * n and score >= 0.5:
                model.thresholds[kind] = score - 1e-9  # sums of leaves may be rounded another way in the expression
    return model


def find_personal(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns ``key`` and ``spans``, a row per row: kind, start and end of what to redact, by start and kind."""
    proposed = stored(candidates(docs, key, text)).read(docs.sparkSession)
    model = fit(proposed, key)
    order = {k: i for i, k in enumerate((*BASE, *LOOSE))}

    def least(s: Column) -> Column:
        return F.coalesce(*[F.when(s["kind"] == k, F.lit(t)) for k, t in model.thresholds.items()])

    def keeps(s: Column) -> Column:
        return F.when(s["base"], s["label"] == 1).otherwise(~s["taken"] & (model.score(lambda f: s[FEATURES[f]]) >= least(s)))

    ranked = lambda s: F.struct(s["start"].alias("start"), F.coalesce(*[F.when(s["kind"] == k, i) for k, i in order.items()]).alias("at"), s["kind"].alias("kind"), s["end"].alias("end"))
    kept = F.array_sort(F.transform(F.filter("spans", keeps), ranked))
    plain = F.transform(kept, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return proposed.select(key, F.when(F.size("spans") > 0, plain).otherwise(F.array().cast("array<struct<kind:string,start:int,end:int>>")).alias("spans"))
