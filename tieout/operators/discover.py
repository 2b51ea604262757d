"""Star-schema discovery from profiles: keys, relationships, table roles, measures, findings.

The rows of the profiles are one per column, so every rule here is a small job. Only the containment
of foreign keys reads values, and it does so once for all tables: an inverted index marks, for every
distinct value, the columns that hold it, and all containments are counted from the marks.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.functions.normalize import is_float
from tieout.model import quoted
from tieout.operators.profile import distinct_interval, kind_of, value_text
from tieout.session import settled

# Name patterns, and the limits and weights of the relationship and role rules.
KEY_NAME = r"(?i)(^id$|_id$|id$|key|code|_no$|number)"
DATE_ATTRIBUTES = r"(?i)(year|quarter|month|week|day|date|fiscal|period)"
KEY_NAME_SCORE, WHOLE_SCORE, OTHER_SCORE = 3, 2, 1
DOMAIN_SLACK, DOMAIN_EXTRA = 1.05, 1
STRONG_CONTAINMENT, WEAK_CONTAINMENT, ENOUGH_AFFINITY = 0.85, 0.5, 0.6
CONTAINMENT_WEIGHT, AFFINITY_WEIGHT = 0.7, 0.3
FACT_ROWS = 50
CURRENCY = r"(?i)(revenue|sales|amount|price|cost|profit|margin|income|spend|value|total|gmv|arpu)"
QUANTITY = r"(?i)(qty|quantity|boxes|units?|count|orders?|volume|weight|clicks|visits|sessions)"
RATE = r"(?i)(rate|ratio|percent|pct|%|share|conversion|churn|retention|discount)"
AVERAGED = r"(?i)(price|rate|ratio|percent|pct|score|age|avg|average|per\b)"
SUMMED = r"(?i)(total|amount|revenue|sales)"
IDENTIFIER = r"(?i)(^id$|_id$|id$|code|zip|postal|year|latitude|longitude|lat$|lon$|lng$)"
BRIDGE = r"(?i)(bridge|junction|xref|linktable)"
HELPER = r"(?i)(^_|param|topn|metricsel|slicer|selection)"
ROW_NAME = r"(?i)((^|[_ ])(id|code|key|no|num|sk|pk|fk|guid|uuid)|id)$"
SLICER_VALUES = 60
HIGH_NULL_SHARE = 0.4
KB = 1024


def _family(kind: Column) -> Column:
    """Kinds whose values can match each other share a family."""
    return F.when(kind.isin("integer", "decimal"), "number").when(kind.isin("date", "dateTime"), "time").otherwise(kind)


def primary_keys(profiles: DataFrame) -> DataFrame:
    """The best unique column without blanks per table: ``table, column, data_type, key_values``."""
    score = (
        F.when(F.col("column").rlike(KEY_NAME), KEY_NAME_SCORE).otherwise(0)
        + F.when(F.col("data_type") == "integer", WHOLE_SCORE)
        .when(F.col("data_type").isin("string", "date", "dateTime"), OTHER_SCORE)
        .otherwise(0)
    )
    unique = profiles.where("rows > 0 and distinct_count = rows and null_count = 0").withColumn("score", score)
    w = Window.partitionBy("table").orderBy(F.col("score").desc(), "position")
    return settled(
        unique.withColumn("nth", F.row_number().over(w))
        .where("nth = 1")
        .select("table", "column", "data_type", F.col("distinct_count").alias("key_values"), "score")
    )


def _candidates(profiles: DataFrame, keys: DataFrame) -> tuple[dict[str, list[str]], dict[str, str]]:
    """Columns that can still be part of a relationship, and the key of each table.

    A foreign key has no more values than the largest key of its family allows; counts that are only
    estimated are taken at the low end of their interval, so this drops nothing that could match. Dates are
    matched by day, of which there can be fewer than the counted timestamps, so a date column only needs
    some date key.
    """
    own = {r["table"]: r["column"] for r in keys.collect()}  # one row per table
    limits: dict[str, float] = {}
    for r in keys.select(_family(F.col("data_type")).alias("f"), "key_values").collect():
        limits[r["f"]] = max(limits.get(r["f"], 0.0), r["key_values"] * DOMAIN_SLACK + DOMAIN_EXTRA)
    wanted: dict[str, list[str]] = {}
    sure = F.col("exact") if "exact" in profiles.columns else F.lit(True)
    rows = profiles.select("table", "column", "position", "distinct_count", sure.alias("exact"), _family(F.col("data_type")).alias("f"))
    for r in sorted(rows.collect(), key=lambda r: (r["table"], r["position"])):  # one row per column
        least = r["distinct_count"] if r["exact"] else distinct_interval(r["distinct_count"])[0]
        fits = r["f"] in limits and (r["f"] == "time" or r["distinct_count"] > 0 and least <= limits[r["f"]])
        if fits or own.get(r["table"]) == r["column"]:
            wanted.setdefault(r["table"], []).append(r["column"])
    return wanted, own


#: How a value is carried in the index of values; every value has one of these.
CARRIERS = {"whole": "bigint", "real": "double", "text": "string"}
#: Whole numbers below this are whole in every number type.
PLAIN_WHOLE = 10**15


def _matched(value: Column, dtype: T.DataType) -> tuple[str, list[Column]]:
    """The family of a value, and the value as a whole number, a real one or text; all NULL where it is blank.

    Equal values of a family are equal here whatever their types: numbers are equal if their shortest texts
    are, times if their days are. A number of any type that a double holds to the last digit, and that is not
    a plain whole one, is carried as that double.
    """
    kind = kind_of(dtype)
    family = {"integer": "number", "decimal": "number", "date": "time", "dateTime": "time"}.get(kind, kind)
    parts: dict[str, Column] = {}
    if kind == "boolean":
        parts["whole"] = value.cast("int")
    elif family == "time":
        parts["whole"] = F.unix_date(value.cast("date"))
    elif family == "string":
        parts["text"] = value_text(value, dtype)
    elif is_float(dtype):
        x = value if isinstance(dtype, T.DoubleType) else value.cast("string").cast("double")
        plain = (x == F.floor(x)) & (F.abs(x) < PLAIN_WHOLE)
        parts = {"whole": F.when(plain, x.cast("bigint")), "real": F.when(~plain, x)}
    else:
        plain = (F.abs(value) < PLAIN_WHOLE) & (F.lit(True) if kind == "integer" else value == F.floor(value))
        wide = "decimal(20,0)" if kind == "integer" else dtype.simpleString()
        x = value.cast("double")
        real = ~plain & F.coalesce(x.try_cast(wide) == value.cast(wide), F.lit(False))
        parts = {"whole": F.when(plain, value.try_cast("bigint")), "real": F.when(real, x), "text": F.when(~plain & ~real, value_text(value, dtype))}
    return family, [parts.get(c, F.lit(None)).cast(t) for c, t in CARRIERS.items()]


#: Columns whose marks fit one whole number.
MARKS = 62


def match_values(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """An inverted index of values: a row for each distinct value of some columns of all tables, with a mark
    for every column that holds it.

    Column number c of the returned list is bit ``c % MARKS`` of ``w<c // MARKS>``. Marks of equal values are
    merged before the shuffle, so a value is at most one row per task, and the index is made by one exchange.
    """
    names = [(table, c) for table, found in columns.items() for c in found]
    words = range(-(-len(names) // MARKS))
    frames = []
    for table, found in columns.items():
        cells = []
        for c in found:
            family, parts = _matched(quoted(c), tables[table].schema[c].dataType)
            word, bit = divmod(names.index((table, c)), MARKS)
            cells += [F.lit(family), *parts, *[F.lit(1 << bit if w == word else 0).cast("bigint") for w in words]]
        frames.append(tables[table].select(F.stack(F.lit(len(found)), *cells).alias("family", *CARRIERS, *[f"w{w}" for w in words])))
    cells = reduce(DataFrame.unionAll, frames).where(" or ".join(f"{c} is not null" for c in CARRIERS))
    return cells.groupBy("family", *CARRIERS).agg(*[F.bit_or(f"w{w}").alias(f"w{w}") for w in words]), names


def containment(tables: Mapping[str, DataFrame], profiles: DataFrame, keys: DataFrame) -> DataFrame:
    """For each candidate column and each key of another table: distinct values, and how many the key has.

    All are read off one inverted index: its rows are counted by the set of columns they are marked with, and
    only those few sets are taken apart into pairs of a column and a key.
    """
    columns, own = _candidates(profiles, keys)
    spark = profiles.sparkSession
    schema = "table string, column string, parent string, parent_column string, key_values bigint, hits bigint, values bigint"
    if not columns:
        return spark.createDataFrame([], schema)
    index, names = match_values(tables, columns)
    marks = [f"w{w}" for w in range(-(-len(names) // MARKS))]
    sets = index.groupBy(*marks).agg(F.count(F.lit(1)).alias("n"))
    marked = F.filter(
        F.sequence(F.lit(0), F.lit(len(names) - 1)),
        lambda c: F.getbit(F.get(F.array(*marks), F.floor(c / MARKS).cast("int")), c % MARKS) == 1,
    )
    key_numbers = [i for i, (table, c) in enumerate(names) if own.get(table) == c]
    held = F.array_intersect("marked", F.array(*[F.lit(k) for k in key_numbers]).cast("array<int>"))
    # A pair of a column with -1 stands for the column alone.
    pairs = (
        sets.select("n", marked.alias("marked"))
        .select("n", "marked", F.concat(held, F.array(F.lit(-1))).alias("held"))
        .select("n", F.explode("marked").alias("c"), "held")
        .select("n", "c", F.explode("held").alias("k"))
        .groupBy("c", "k")
        .agg(F.sum("n").alias("n"))
    )
    found = {(r["c"], r["k"]): r["n"] for r in pairs.collect()}  # a row per column and key
    sizes = {r["table"]: r["key_values"] for r in keys.collect()}
    rows = [
        (*names[c], *names[k], sizes[names[k][0]], n, found[(c, -1)])
        for (c, k), n in found.items()
        if k >= 0 and c not in key_numbers and names[c][0] != names[k][0]
    ]
    return spark.createDataFrame(rows, schema)


def affinity(child: Column, key: Column, parent: Column) -> Column:
    """How much a column name looks like it points at a key."""
    c, k, p = F.lower(child), F.lower(key), F.lower(parent)
    return (
        F.when(c == k, 1.0)
        .when((c == F.concat(p, F.lit("id"))) | (c == F.concat(p, F.lit("_id"))), 0.9)
        .when(F.contains(c, k) | F.contains(k, c), 0.6)
        .otherwise(0.0)
    )


def relationships(tables: Mapping[str, DataFrame], profiles: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Many-to-one relationships with their confidence; one of them is active per pair of tables."""
    keys = primary_keys(profiles) if keys is None else keys
    order = {name: i for i, name in enumerate(tables)}
    turn = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    places = profiles.select("table", "column", "position")
    share = F.col("hits") / F.col("values")
    near = affinity(F.col("column"), F.col("parent_column"), F.col("parent"))
    candidates = (
        containment(tables, profiles, keys)
        .where(F.col("values") <= F.col("key_values") * DOMAIN_SLACK + DOMAIN_EXTRA)
        .withColumn("containment", share)
        .withColumn("affinity", near)
        .where(
            (F.col("containment") >= STRONG_CONTAINMENT)
            | ((F.col("containment") >= WEAK_CONTAINMENT) & (F.col("affinity") >= ENOUGH_AFFINITY))
        )
        .withColumn(
            "confidence",
            F.least(F.lit(1.0), F.col("containment") * CONTAINMENT_WEIGHT + F.col("affinity") * AFFINITY_WEIGHT),
        )
    )
    best = Window.partitionBy("table", "column").orderBy(F.col("confidence").desc(), turn[F.col("parent")])
    first = Window.partitionBy("table", "parent").orderBy("position")
    return settled(
        candidates.withColumn("nth", F.row_number().over(best))
        .where("nth = 1")
        .join(places, ["table", "column"])
        .withColumn("active", F.row_number().over(first) == 1)
        .select(
            F.col("table").alias("from_table"),
            F.col("column").alias("from_col"),
            F.col("parent").alias("to_table"),
            F.col("parent_column").alias("to_col"),
            F.round("containment", 6).alias("containment"),
            F.round("confidence", 2).alias("confidence"),
            "active",
        )
    )


def table_roles(profiles: DataFrame, keys: DataFrame, rels: DataFrame) -> DataFrame:
    """date, fact or dimension per table."""
    shape = profiles.groupBy("table").agg(
        F.max("rows").alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.count_if(F.col("role") == "measureCandidate").alias("measures"),
        F.count_if(F.col("data_type").isin("date", "dateTime") | F.col("column").rlike(DATE_ATTRIBUTES)).alias("dates"),
    )
    key = keys.select("table", F.col("data_type").isin("date", "dateTime").alias("date_key"))
    out = rels.select(F.col("from_table").alias("table")).distinct().withColumn("outgoing", F.lit(True))
    into = rels.select(F.col("to_table").alias("table")).distinct().withColumn("referenced", F.lit(True))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    dated = flag("date_key") & (F.col("dates") >= F.greatest(F.lit(2.0), F.col("columns") * 0.5))
    role = (
        F.when(dated, "date")
        .when(flag("outgoing") & (F.col("measures") >= 1), "fact")
        .when(flag("referenced"), "dimension")
        .when(flag("outgoing"), "fact")
        .when((F.col("measures") >= 2) & (F.col("rows") > FACT_ROWS), "fact")
        .otherwise("dimension")
    )
    joined = shape.join(key, "table", "left").join(out, "table", "left").join(into, "table", "left")
    return settled(joined.select("table", role.alias("role"), "rows", "measures"))


def measure_candidates(profiles: DataFrame, keys: DataFrame, rels: DataFrame, roles: DataFrame) -> DataFrame:
    """Measures worth offering: additive numbers of the facts (of all tables when there is no fact),
    means for price- and rate-like names, and a row count per table."""
    facts = roles.where("role = 'fact'").select("table")
    some = facts.agg(F.count(F.lit(1)) > 0).scalar()
    chosen = roles.select("table", (F.col("role") == "fact").alias("is_fact")).where(F.col("is_fact") | ~some).select("table")
    name = F.col("column")
    numeric = (
        profiles.where(F.col("data_type").isin("integer", "decimal") & (F.col("role") != "key") & ~name.rlike(IDENTIFIER))
        .join(chosen, "table", "left_semi")
        .join(keys.select("table", "column"), ["table", "column"], "left_anti")
        .join(rels.select(F.col("from_table").alias("table"), F.col("from_col").alias("column")), ["table", "column"], "left_anti")
    )
    kind = F.when(name.rlike(RATE), "ratio").when(name.rlike(CURRENCY), "currency").when(name.rlike(QUANTITY), "quantity").otherwise("generic")
    agg = F.when(name.rlike(AVERAGED) & ~name.rlike(SUMMED), "avg").otherwise("sum")
    label = F.concat(F.when(agg == "avg", "Average ").otherwise("Total "), F.regexp_replace(name, "_", " "))
    sure = F.when(name.rlike(CURRENCY) | name.rlike(QUANTITY), 0.9).otherwise(0.6)
    columns = numeric.select("table", "column", agg.alias("agg"), kind.alias("kind"), label.alias("measure"), sure.alias("confidence"))
    found = columns.groupBy("table").agg(F.count(F.lit(1)).alias("n"))
    counts = chosen.join(found, "table", "left").select(
        "table",
        F.lit("").alias("column"),
        F.lit("count_rows").alias("agg"),
        F.lit("count").alias("kind"),
        F.concat("table", F.lit(" Count")).alias("measure"),
        F.when(F.col("n") > 0, 0.7).otherwise(0.5).alias("confidence"),
    )
    return columns.unionByName(counts)


def best_categories(profiles: DataFrame, rels: DataFrame, roles: DataFrame) -> DataFrame:
    """For each fact the text attribute with the fewest values, of a related dimension or its own."""
    text = profiles.where("data_type = 'string' and role <> 'key' and distinct_count > 1")
    facts = roles.where("role = 'fact'").select(F.col("table").alias("fact"))
    related = (
        rels.where("active")
        .join(facts, F.col("from_table") == F.col("fact"), "inner")
        .join(roles.where("role <> 'date'").select(F.col("table").alias("dim")), F.col("to_table") == F.col("dim"), "inner")
        .select("fact", F.col("dim").alias("table"), F.lit(0).alias("own"))
    )
    sources = related.unionByName(facts.select("fact", F.col("fact").alias("table"), F.lit(1).alias("own")))
    free = text.join(rels.select(F.col("from_table").alias("table"), F.col("from_col").alias("column")), ["table", "column"], "left_anti")
    w = Window.partitionBy("fact").orderBy("own", "distinct_count", "table", "column")
    return (
        sources.join(free, "table")
        .withColumn("nth", F.row_number().over(w))
        .where("nth = 1")
        .select("fact", "table", "column", "distinct_count")
    )


def slicer_columns(profiles: DataFrame, rels: DataFrame) -> DataFrame:
    """Descriptive text columns with few enough values to offer as a list: no keys, links or identifiers."""
    links = rels.select(F.col("from_table").alias("table"), F.col("from_col").alias("column"))
    plain = profiles.where("data_type = 'string' and role <> 'key' and distinct_count > 0")
    few = plain.where((F.col("distinct_count") <= SLICER_VALUES) & ~F.col("column").rlike(ROW_NAME))
    return few.join(links, ["table", "column"], "left_anti").select("table", "column", "distinct_count")


FINDING = ["rule", "severity", "target", "message"]


def missing_key(profiles: DataFrame, keys: DataFrame, rels: DataFrame) -> DataFrame:
    keyed = profiles.where("role = 'key'").select("table").unionByName(keys.select("table")).distinct()
    tables = _plain_tables(profiles).where(~F.col("table").rlike(BRIDGE))
    return tables.join(keyed, "table", "left_anti").select(
        F.lit("missing-key").alias("rule"), F.lit("warning").alias("severity"), F.col("table").alias("target"),
        F.concat("table", F.lit(" has no key column")).alias("message"),
    )


def high_null(profiles: DataFrame, keys: DataFrame, rels: DataFrame) -> DataFrame:
    target = F.concat("table", F.lit("["), "column", F.lit("]"))
    return profiles.where((F.col("rows") > 0) & (F.col("null_count") / F.col("rows") > HIGH_NULL_SHARE)).select(
        F.lit("high-null").alias("rule"), F.lit("warning").alias("severity"), target.alias("target"),
        F.concat(target, F.lit(" is more than 40% blank")).alias("message"),
    )


def unrelated_table(profiles: DataFrame, keys: DataFrame, rels: DataFrame) -> DataFrame:
    linked = rels.select(F.col("from_table").alias("table")).unionByName(rels.select(F.col("to_table").alias("table"))).distinct()
    several = profiles.agg(F.count_distinct("table") > 1).scalar()
    return _plain_tables(profiles).join(linked, "table", "left_anti").where(several).select(
        F.lit("orphan-table").alias("rule"), F.lit("info").alias("severity"), F.col("table").alias("target"),
        F.concat("table", F.lit(" is related to no other table")).alias("message"),
    )


def no_date(profiles: DataFrame, keys: DataFrame, rels: DataFrame) -> DataFrame:
    dated = F.count_if(F.col("data_type").isin("date", "dateTime"))
    return profiles.agg(dated.alias("dates"), F.count(F.lit(1)).alias("n")).where("n > 0 and dates = 0").select(
        F.lit("no-date-table").alias("rule"), F.lit("info").alias("severity"), F.lit("").alias("target"),
        F.lit("no date column found: time intelligence needs one").alias("message"),
    )


def _plain_tables(profiles: DataFrame) -> DataFrame:
    sized = profiles.groupBy("table").agg(F.count(F.lit(1)).alias("columns"))
    return sized.where((F.col("columns") > 1) & ~F.col("table").rlike(HELPER)).select("table")


RULES = (missing_key, high_null, unrelated_table, no_date)


def structural_findings(profiles: DataFrame, keys: DataFrame, rels: DataFrame, rules: Sequence = RULES) -> DataFrame:
    """Findings of every rule. A rule is a function of profiles, keys and relationships; add your own."""
    return reduce(DataFrame.unionByName, [rule(profiles, keys, rels).select(*FINDING) for rule in rules])


def legitimate_key(storage: DataFrame) -> Column:
    """A column that is meant to be unique: the date of a date table, or the own key of a small table."""
    table, column = F.lower("table"), F.lower("column")
    date_table = table.rlike(r"date|calendar") & (column.rlike(r"^(date|datekey|full ?date)$") | F.lower("data_type").contains("date"))
    biggest = storage.agg(F.greatest(F.max("rows"), F.lit(1))).scalar()
    stem = F.regexp_replace(F.regexp_replace(table, r"^(dim|fact|bridge)[_ ]?", ""), "[^a-z]", "")
    own = F.regexp_replace(F.regexp_replace(column, r"(id|key|code|no|number)$", ""), "[^a-z]", "")
    echoes = (own == "") | ((F.length(stem) >= 3) & (F.startswith(stem, own) | F.startswith(own, stem)))
    small = F.col("rows") <= biggest * 0.25
    return date_table | (small & column.rlike(r"(id|key|code|no|number)$") & echoes)


def storage_findings(storage: DataFrame, referenced: DataFrame | None = None) -> DataFrame:
    """Columns worth a look, one row each with all reasons, worst first and then by bytes.

    ``referenced`` (``table, column``) is the evidence for unused columns; without it nothing is
    called unused.
    """
    total, rows = F.col("total_bytes"), F.col("rows")
    marked = storage.withColumn("legit", legitimate_key(storage))
    if referenced is None:
        marked = marked.withColumn("unused", F.lit(False))
    else:
        used = referenced.select(F.lower("table").alias("rt"), F.lower("column").alias("rc")).distinct().withColumn("used", F.lit(True))
        marked = marked.join(used, (F.lower("table") == F.col("rt")) & (F.lower("column") == F.col("rc")), "left")
        marked = marked.withColumn("unused", F.col("used").isNull() & (total >= 32 * KB)).drop("rt", "rc", "used")
    dominant = (F.col("share") >= 0.05) & (total >= 64 * KB)
    unique = (F.col("uniqueness") >= 0.9) & (rows >= 1000) & (total >= 32 * KB) & ~F.col("legit")
    wordy = (F.col("dictionary_bytes") > F.col("data_bytes") * 2) & (F.col("dictionary_bytes") >= 32 * KB)
    unused = F.col("unused")
    severity = (
        F.when(unused, F.when(F.col("share") >= 0.03, "high").otherwise("medium"))
        .when(dominant & (F.col("share") >= 0.1), "high")
        .when(unique & (F.col("share") >= 0.05), "high")
        .otherwise("medium")
    )
    title = (
        F.when(unused, "unreferenced").when(dominant, "dominant").when(unique, "near-unique").otherwise("large-dictionary")
    )
    reasons = F.concat_ws(
        ",", F.when(dominant, "dominant"), F.when(unique, "near-unique"), F.when(wordy, "large-dictionary"), F.when(unused, "unreferenced")
    )
    found = marked.withColumn("reasons", reasons).where("reasons <> ''").withColumn("severity", severity).withColumn("title", title)
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    return found.orderBy(rank, total.desc(), "table", "column").select(
        "table", "column", "severity", "title", "reasons", "total_bytes", "legit"
    )
