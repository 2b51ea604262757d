"""Profiles, type inference, star-schema discovery and lineage over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tieout.operators import discover as D
from tieout.operators import lineage as L
from tieout.operators import profile as P
from tieout.queries.registry import STAR, query, ratio, text
from tieout.session import shared_folder
from tieout.sources.export import extract_tables, guarded
from tieout.sources.files import read_table

# Column kinds of the given tables, for building SQL.
KINDS = {
    "region": {"r_regionkey": "integer", "r_name": "string"},
    "nation": {"n_nationkey": "integer", "n_name": "string", "n_regionkey": "integer"},
    "customer": {"c_custkey": "integer", "c_name": "string", "c_nationkey": "integer", "c_acctbal": "decimal", "c_mktsegment": "string"},
    "supplier": {"s_suppkey": "integer", "s_name": "string", "s_nationkey": "integer", "s_acctbal": "decimal"},
    "part": {"p_partkey": "integer", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "integer", "p_retailprice": "decimal"},
    "orders": {"o_orderkey": "integer", "o_custkey": "integer", "o_orderstatus": "string", "o_totalprice": "decimal",
               "o_orderdate": "dateTime", "o_orderpriority": "string"},
    "lineitem": {"l_orderkey": "integer", "l_partkey": "integer", "l_suppkey": "integer", "l_linenumber": "integer", "l_quantity": "decimal",
                 "l_extendedprice": "decimal", "l_discount": "decimal", "l_tax": "decimal", "l_returnflag": "string", "l_linestatus": "string",
                 "l_shipdate": "dateTime"},
    "events": {"event_id": "integer", "ts": "dateTime", "user_id": "integer", "event_type": "string", "value": "decimal", "props": "string"},
}


def star_columns(t):
    """The star tables with the columns that the SQL names; a copy of a table may carry more."""
    return {name: df.select(*KINDS[name]) for name, df in t.star().items()}


def value_sql(column: str, kind: str) -> str:
    if kind == "decimal":
        return f"regexp_replace(CAST({column} AS VARCHAR), '\\.0$', '')"
    return f"CAST({column} AS VARCHAR)"


def profile_sql() -> str:
    """One row per column of the star tables, straight from the rows."""
    parts = []
    for table, columns in KINDS.items():
        for i, (c, kind) in enumerate(columns.items()):
            v = value_sql(c, kind)
            number = kind in ("integer", "decimal")
            stats = f"CAST(MIN({c}) AS DOUBLE), CAST(MAX({c}) AS DOUBLE), round(AVG({c}), 4)" if number else "NULL, NULL, NULL"
            texts = "NULL, NULL" if number else f"CAST(MIN({c}) AS VARCHAR), CAST(MAX({c}) AS VARCHAR)"
            parts.append(
                f"""SELECT '{table}', '{c}', {i}, '{kind}', COUNT(*), COUNT(*) - COUNT({c}), COUNT(DISTINCT {c}), {stats}, {texts},
                SUM(octet_length(encode({v}))), (SELECT SUM(octet_length(encode({v}))) FROM (SELECT DISTINCT {c} FROM {table})) FROM {table}"""
            )
    columns = "tbl, col, position, data_type, rows, null_count, distinct_count, lo, hi, mean, lo_text, hi_text, data_bytes, dictionary_bytes"
    return f"p({columns}) AS ({' UNION ALL '.join(parts)})"


KEY_HINT = "regexp_matches(col, '(^id$|_id$|\\bid\\b|key|code|number|no\\.)', 'i')"
MEASURE_HINT = "regexp_matches(col, '(revenue|sales|amount|price|cost|total|qty|quantity|profit|margin|discount|tax|balance|value|count|units?)', 'i')"
ROLES = f"""r AS (SELECT *, CASE WHEN data_type = 'dateTime' THEN 'date' WHEN distinct_count = rows AND {KEY_HINT} THEN 'key'
  WHEN data_type IN ('integer', 'decimal') AND ({MEASURE_HINT} OR distinct_count > LEAST(20, rows * 0.5)) THEN 'measureCandidate' ELSE 'dimension' END AS role FROM p)"""
PROFILE = f"WITH {profile_sql()}, {ROLES}"


@query(
    PROFILE + """ SELECT tbl AS "table", col AS "column", data_type, role, CAST(rows AS BIGINT) AS rows, CAST(null_count AS BIGINT) AS null_count,
      CAST(distinct_count AS BIGINT) AS distinct_count, lo AS min, hi AS max, mean, lo_text AS min_text, hi_text AS max_text,
      CAST(data_bytes AS BIGINT) AS data_bytes, CAST(dictionary_bytes AS BIGINT) AS dictionary_bytes FROM r"""
)
def profile_columns(t):
    return P.profile_tables(star_columns(t)).drop("position").withColumn("mean", ratio("mean", 4))


@query(
    PROFILE + """ SELECT tbl AS "table", col AS "column", CAST(data_bytes + dictionary_bytes AS BIGINT) AS total_bytes,
      round((data_bytes + dictionary_bytes) / CAST((SELECT SUM(data_bytes + dictionary_bytes) FROM r) AS DOUBLE), 8) AS share,
      round(LEAST(1.0, distinct_count / CAST(rows AS DOUBLE)), 8) AS uniqueness FROM r"""
)
def storage_profile(t):
    storage = P.storage_profile(P.profile_tables(star_columns(t)))
    return storage.select("table", "column", "total_bytes", ratio("share", 8).alias("share"), ratio("uniqueness", 8).alias("uniqueness"))


@query(
    PROFILE + """, s AS (SELECT tbl, col, data_bytes + dictionary_bytes AS b FROM r)
    SELECT CAST(SUM(b) AS BIGINT) AS model_bytes, COUNT(DISTINCT tbl) AS tables, COUNT(*) AS columns,
      (SELECT tbl || '[' || col || ']' FROM s ORDER BY b DESC, tbl DESC, col DESC LIMIT 1) AS largest_column,
      (SELECT tbl FROM s GROUP BY 1 ORDER BY SUM(b) DESC, tbl DESC LIMIT 1) AS largest_table,
      round((SELECT SUM(b) FROM (SELECT b FROM s ORDER BY b DESC LIMIT 10)) / CAST(SUM(b) AS DOUBLE), 8) AS top_share FROM s"""
)
def storage_summary(t):
    summary = P.storage_summary(P.storage_profile(P.profile_tables(star_columns(t))))
    return summary.withColumn("top_share", ratio("top_share", 8))


SMALL_KEY = "(rows <= 0.25 * (SELECT MAX(rows) FROM r) AND regexp_matches(col, '(id|key|code|no|number)$') AND "
STEM = "regexp_replace(tbl, '[^a-z]', '', 'g')"
OWN = "regexp_replace(regexp_replace(col, '(id|key|code|no|number)$', ''), '[^a-z]', '', 'g')"


@query(
    PROFILE + f""", s AS (SELECT *, data_bytes + dictionary_bytes AS b, (data_bytes + dictionary_bytes) / CAST((SELECT SUM(data_bytes + dictionary_bytes) FROM r) AS DOUBLE) AS share,
        {SMALL_KEY} ({OWN} = '' OR (length({STEM}) >= 3 AND (starts_with({STEM}, {OWN}) OR starts_with({OWN}, {STEM}))))) AS legit FROM r),
      f AS (SELECT *, share >= 0.05 AND b >= 65536 AS d, distinct_count / CAST(rows AS DOUBLE) >= 0.9 AND rows >= 1000 AND b >= 32768 AND NOT legit AS u,
        dictionary_bytes > 2 * data_bytes AND dictionary_bytes >= 32768 AS w, b >= 32768 AND tbl <> 'orders' AS x FROM s)
    SELECT tbl AS "table", col AS "column", CAST(b AS BIGINT) AS total_bytes,
      CASE WHEN x THEN CASE WHEN share >= 0.03 THEN 'high' ELSE 'medium' END WHEN (d AND share >= 0.1) OR (u AND share >= 0.05) THEN 'high' ELSE 'medium' END AS severity,
      concat_ws(',', CASE WHEN d THEN 'dominant' END, CASE WHEN u THEN 'near-unique' END, CASE WHEN w THEN 'large-dictionary' END, CASE WHEN x THEN 'unreferenced' END) AS reasons
    FROM f WHERE d OR u OR w OR x"""
)
def storage_findings(t):
    """Findings when only the columns of the orders are known to be used."""
    profiles = P.profile_tables(star_columns(t))
    used = profiles.where("table = 'orders'").select("table", "column")
    return D.storage_findings(P.storage_profile(profiles), used).select("table", "column", "total_bytes", "severity", "reasons")


@query(
    """WITH long AS (SELECT 'o_totalprice' AS col, o_totalprice AS x FROM orders UNION ALL SELECT 'o_custkey', CAST(o_custkey AS DOUBLE) FROM orders),
      s AS (SELECT col, MIN(x) AS lo, MAX(x) AS hi, (MAX(x) - MIN(x)) / 10 AS w FROM long GROUP BY 1),
      b AS (SELECT col, CAST(LEAST(9, floor((x - lo) / w)) AS INTEGER) AS bin, COUNT(*) AS n FROM long JOIN s USING (col) GROUP BY 1, 2),
      g AS (SELECT s.*, CAST(i.i AS INTEGER) AS bin FROM s, (SELECT unnest(range(10)) AS i) i)
    SELECT g.col AS "column", g.bin, round(lo + g.bin * w, 6) AS low, round(lo + (g.bin + 1) * w, 6) AS high, CAST(COALESCE(n, 0) AS BIGINT) AS count
    FROM g LEFT JOIN b ON g.col = b.col AND g.bin = b.bin"""
)
def histogram(t):
    bins = P.histogram(t.orders, ["o_totalprice", "o_custkey"])
    return bins.select("column", "bin", ratio("low").alias("low"), ratio("high").alias("high"), "count")


@query(
    """WITH c AS (SELECT 'p_brand' AS col, p_brand AS v, COUNT(*) AS n FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, COUNT(*) FROM part GROUP BY 2
        UNION ALL SELECT 'p_name', p_name, COUNT(*) FROM part GROUP BY 2),
      k AS (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, v) AS nth FROM c)
    SELECT col AS "column", CAST(nth AS INTEGER) AS nth, v AS label, CAST(n AS BIGINT) AS count FROM k WHERE nth <= 8
    UNION ALL SELECT col, 9, '+' || COUNT(*) || ' more', CAST(SUM(n) AS BIGINT) FROM k WHERE nth > 8 GROUP BY col"""
)
def top_values(t):
    return P.top_values(t.part, ["p_brand", "p_type", "p_name"])


@query(
    """SELECT 'l_shipdate' AS "column", CAST(year(l_shipdate) AS INTEGER) AS year, CAST(COUNT(*) AS BIGINT) AS count FROM lineitem GROUP BY 2"""
)
def year_counts(t):
    return P.year_counts(t.lineitem, ["l_shipdate"])


@query(
    """SELECT 'returned' AS "column", COUNT(*) FILTER (l_returnflag = 'R') AS true_count, COUNT(*) FILTER (l_returnflag <> 'R') AS false_count FROM lineitem
    UNION ALL SELECT 'open', COUNT(*) FILTER (l_linestatus = 'O'), COUNT(*) FILTER (l_linestatus <> 'O') FROM lineitem"""
)
def flag_counts(t):
    flags = t.lineitem.select((F.col("l_returnflag") == "R").alias("returned"), (F.col("l_linestatus") == "O").alias("open"))
    return P.flag_counts(flags, ["returned", "open"])


@query(
    """WITH v AS (SELECT DISTINCT 'p_brand' AS col, p_brand AS v FROM part UNION ALL SELECT DISTINCT 'p_name', p_name FROM part UNION ALL SELECT DISTINCT 'p_size', CAST(p_size AS VARCHAR) FROM part)
    SELECT col AS "column", CAST(nth AS INTEGER) AS nth, v AS value FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY v) AS nth FROM v) WHERE nth <= 5"""
)
def sample_values(t):
    return P.sample_values(t.part.select("p_brand", "p_name", "p_size"))


def as_text(t):
    """The orders as a spreadsheet might hold them: everything text, in mixed spellings."""
    o = t.orders
    odd = F.col("o_orderkey") % 2 == 1
    grouped = F.concat(F.lit("$"), F.format_number("o_totalprice", 2))
    return o.select(
        F.col("o_orderkey").cast("string").alias("okey"),
        F.when(odd, grouped).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("price"),
        F.when(odd, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "M/d/yyyy")).alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"),
        F.when(F.col("o_orderstatus") == "F", " Yes ").when(F.col("o_orderstatus") == "O", "no").otherwise("").alias("flag"),
        F.when(F.col("o_orderkey") % 5 == 0, F.col("o_orderpriority")).otherwise(F.col("o_custkey").cast("string")).alias("mixed"),
    )


AS_TEXT = """SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS okey,
    CASE WHEN o_orderkey % 2 = 1 THEN '$' || format('{:,.2f}', o_totalprice) ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS price,
    CASE WHEN o_orderkey % 2 = 1 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%-m/%-d/%Y') END AS day,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS stamp,
    CASE o_orderstatus WHEN 'F' THEN ' Yes ' WHEN 'O' THEN 'no' ELSE '' END AS flag,
    CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE CAST(o_custkey AS VARCHAR) END AS mixed, o_totalprice, o_orderdate FROM orders"""


def kind_sql(column: str) -> str:
    s = f"trim({column})"
    return f"""CASE WHEN {s} = '' THEN NULL WHEN lower({s}) IN ('true', 'yes', 't', 'y', 'false', 'no', 'f', 'n') THEN 'boolean'
      WHEN regexp_matches({s}, '^[-+]?[$€£¥]?\\s?(\\d{{1,3}}(,\\d{{3}})+|\\d+)(\\.\\d+)?%?$') THEN CASE WHEN contains({s}, '.') THEN 'decimal' ELSE 'integer' END
      WHEN regexp_matches({s}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}[T ]\\d{{2}}:\\d{{2}}(:\\d{{2}})?(\\.\\d+)?(Z|[+-]\\d{{2}}:?\\d{{2}})?$') THEN 'dateTime'
      WHEN regexp_matches({s}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') OR regexp_matches({s}, '^\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}$') THEN 'date' ELSE 'string' END"""


TEXT_COLUMNS = ["okey", "price", "day", "stamp", "flag", "mixed"]
INFERRED = " UNION ALL ".join(
    f"""SELECT '{c}' AS col, {', '.join(f"COUNT(*) FILTER (WHERE {kind_sql(c)} = '{k}') AS {k.lower()}_n" for k in ('integer', 'decimal', 'boolean', 'date', 'dateTime', 'string'))} FROM src"""
    for c in TEXT_COLUMNS
)


@query(
    f"""WITH src AS ({AS_TEXT}), c AS ({INFERRED}), n AS (SELECT *, integer_n + decimal_n + boolean_n + date_n + datetime_n + string_n AS filled FROM c)
    SELECT col AS "column", CAST(integer_n AS BIGINT) AS integer_n, CAST(decimal_n AS BIGINT) AS decimal_n, CAST(boolean_n AS BIGINT) AS boolean_n,
      CAST(date_n AS BIGINT) AS date_n, CAST(datetime_n AS BIGINT) AS datetime_n, CAST(string_n AS BIGINT) AS string_n,
      CASE WHEN filled = 0 THEN 'string' WHEN boolean_n >= 0.9 * filled THEN 'boolean'
        WHEN integer_n + decimal_n >= 0.9 * filled THEN CASE WHEN decimal_n > 0 THEN 'decimal' ELSE 'integer' END
        WHEN date_n + datetime_n >= 0.9 * filled THEN CASE WHEN datetime_n > 0 THEN 'dateTime' ELSE 'date' END ELSE 'string' END AS data_type FROM n"""
)
def type_inference(t):
    kinds = P.infer_types(as_text(t))
    return kinds.select("column", *[F.col(k).alias(f"{k.lower()}_n") for k in ("integer", "decimal", "boolean", "date", "dateTime", "string")], "data_type")


@query(
    f"""SELECT o_orderkey AS okey, o_totalprice AS price, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS stamp,
      CASE WHEN trim(flag) = 'Yes' THEN TRUE WHEN flag = 'no' THEN FALSE END AS flag, mixed FROM ({AS_TEXT})"""
)
def coerce_text(t):
    typed = P.typed(as_text(t))
    return typed.select("okey", "price", text("day").alias("day"), F.date_format("stamp", "yyyy-MM-dd HH:mm:ss").alias("stamp"), "flag", "mixed")


@query(
    """SELECT p_partkey, CASE WHEN p_size > 40 THEN '''=' || p_name WHEN p_size > 30 THEN '''@' || p_name WHEN p_size > 20 THEN 'x=' || p_name ELSE p_name END AS guarded FROM part"""
)
def csv_guard(t):
    """Names that a spreadsheet would run get a leading apostrophe."""
    size, name = F.col("p_size"), F.col("p_name")
    risky = (
        F.when(size > 40, F.concat(F.lit("="), name)).when(size > 30, F.concat(F.lit("@"), name))
        .when(size > 20, F.concat(F.lit("x="), name)).otherwise(name)
    )
    return t.part.select("p_partkey", guarded(risky).alias("guarded"))


@query(
    """SELECT c_custkey, c_name || ', "' || c_mktsegment || '"' AS label, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal,
      CASE WHEN c_nationkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS segment FROM customer"""
)
def csv_round_trip(t):
    """Customers written as CSV, read back as text, and given their types again."""
    label = F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"'))
    segment = F.when(F.col("c_nationkey") % 3 != 0, F.col("c_mktsegment"))
    table = t.customer.select("c_custkey", label.alias("label"), "c_nationkey", "c_acctbal", segment.alias("segment"))
    folder = f"{shared_folder(t.spark)}/tieout-csv-{uuid.uuid4().hex}"
    written = extract_tables({"customer": table}, folder)
    return P.typed(read_table(t.spark, written["customer"]))


KEYS = """k AS (SELECT tbl, col, data_type, distinct_count AS key_values,
    row_number() OVER (PARTITION BY tbl ORDER BY CASE WHEN regexp_matches(col, '(_id$|id$|key|code|_no$|number)', 'i') THEN 3 ELSE 0 END
      + CASE data_type WHEN 'integer' THEN 2 WHEN 'decimal' THEN 0 ELSE 1 END DESC, position) AS nth
  FROM r WHERE distinct_count = rows AND null_count = 0), pk AS (SELECT * FROM k WHERE nth = 1)"""


@query(f"""{PROFILE}, {KEYS} SELECT tbl AS "table", col AS "column", data_type, CAST(key_values AS BIGINT) AS key_values FROM pk""")
def primary_keys(t):
    return D.primary_keys(P.sketch_tables(star_columns(t))).drop("score")


FAMILY = {"integer": "number", "decimal": "number", "dateTime": "time", "string": "string"}
VALUES = " UNION ALL ".join(
    f"SELECT DISTINCT '{table}' AS tbl, '{c}' AS col, '{FAMILY[kind]}' AS fam, {i} AS position, "
    f"{'CAST(CAST(' + c + ' AS DATE) AS VARCHAR)' if kind == 'dateTime' else value_sql(c, kind)} AS v FROM {table}"
    for table, columns in KINDS.items()
    for i, (c, kind) in enumerate(columns.items())
)
TURNS = "CASE parent " + " ".join(f"WHEN '{name}' THEN {i}" for i, name in enumerate(STAR)) + " END"
NEAR = """CASE WHEN h.col = pcol THEN 1.0 WHEN h.col = parent || 'id' OR h.col = parent || '_id' THEN 0.9
  WHEN contains(h.col, pcol) OR contains(pcol, h.col) THEN 0.6 ELSE 0.0 END"""
LINKS = f"""{PROFILE}, {KEYS}, v AS ({VALUES}),
  pv AS (SELECT v.tbl AS parent, v.col AS pcol, v.fam AS pfam, v.v AS pval, pk.key_values AS kn FROM v JOIN pk ON pk.tbl = v.tbl AND pk.col = v.col),
  sz AS (SELECT tbl, col, position, COUNT(*) AS n FROM v GROUP BY ALL),
  h AS (SELECT v.tbl, v.col, parent, pcol, kn, COUNT(*) AS hits FROM v JOIN pv ON v.v = pval AND v.fam = pfam AND v.tbl <> parent GROUP BY ALL),
  c AS (SELECT h.*, position, n, hits / CAST(n AS DOUBLE) AS cont, {NEAR} AS aff FROM h JOIN sz ON h.tbl = sz.tbl AND h.col = sz.col
        WHERE (h.tbl, h.col) NOT IN (SELECT (tbl, col) FROM pk) AND n <= kn * 1.05 + 1),
  a AS (SELECT *, LEAST(1.0, cont * 0.7 + aff * 0.3) AS conf FROM c WHERE cont >= 0.85 OR (cont >= 0.5 AND aff >= 0.6)),
  b AS (SELECT *, row_number() OVER (PARTITION BY tbl, col ORDER BY conf DESC, {TURNS}) AS nth FROM a),
  rel AS (SELECT *, row_number() OVER (PARTITION BY tbl, parent ORDER BY position) = 1 AS active FROM b WHERE nth = 1)"""


@query(
    f"""{LINKS} SELECT tbl AS from_table, col AS from_col, parent AS to_table, pcol AS to_col, round(cont, 6) AS containment, round(conf, 2) AS confidence, active FROM rel"""
)
def foreign_keys(t):
    return D.relationships(star_columns(t), P.sketch_tables(star_columns(t)))


def discovered(t):
    tables = star_columns(t)
    profiles = P.sketch_tables(tables)
    keys = D.primary_keys(profiles)
    rels = D.relationships(tables, profiles, keys)
    return profiles, keys, rels


TABLE_ROLES = """g AS (SELECT tbl, MAX(rows) AS rows, COUNT(*) FILTER (role = 'measureCandidate') AS measures FROM r GROUP BY 1),
  tr AS (SELECT tbl, rows, measures, CASE WHEN tbl IN (SELECT tbl FROM rel) AND measures >= 1 THEN 'fact' WHEN tbl IN (SELECT parent FROM rel) THEN 'dimension'
    WHEN tbl IN (SELECT tbl FROM rel) THEN 'fact' WHEN measures >= 2 AND rows > 50 THEN 'fact' ELSE 'dimension' END AS role FROM g)"""


@query(f"""{LINKS}, {TABLE_ROLES} SELECT tbl AS "table", role, CAST(rows AS BIGINT) AS rows, CAST(measures AS BIGINT) AS measures FROM tr""")
def table_roles(t):
    return D.table_roles(*discovered(t))


@query(
    f"""{LINKS}, {TABLE_ROLES}, q AS (SELECT r.tbl, r.col, regexp_matches(col, '(price|rate|ratio|percent|pct|score|age|avg|average|per\\b)', 'i')
        AND NOT regexp_matches(col, '(total|amount|revenue|sales)', 'i') AS mean FROM r WHERE data_type IN ('integer', 'decimal') AND role <> 'key'
        AND NOT regexp_matches(col, '(^id$|_id$|id$|code|zip|postal|year|latitude|longitude|lat$|lon$|lng$)', 'i')
        AND tbl IN (SELECT tbl FROM tr WHERE role = 'fact') AND (tbl, col) NOT IN (SELECT (tbl, col) FROM pk) AND (tbl, col) NOT IN (SELECT (tbl, col) FROM rel))
    SELECT tbl AS "table", col AS "column", CASE WHEN mean THEN 'avg' ELSE 'sum' END AS agg,
      CASE WHEN mean THEN 'Average ' ELSE 'Total ' END || replace(col, '_', ' ') AS measure FROM q
    UNION ALL SELECT tbl, '', 'count_rows', tbl || ' Count' FROM tr WHERE role = 'fact'"""
)
def measure_candidates(t):
    profiles, keys, rels = discovered(t)
    return D.measure_candidates(profiles, keys, rels, D.table_roles(profiles, keys, rels)).select("table", "column", "agg", "measure")


@query(
    f"""{LINKS}, {TABLE_ROLES}, src AS (SELECT rel.tbl AS fact, rel.parent AS tbl, 0 AS own FROM rel JOIN tr ON tr.tbl = rel.tbl AND tr.role = 'fact' WHERE active
        UNION SELECT tbl, tbl, 1 FROM tr WHERE role = 'fact'),
      o AS (SELECT fact, r.tbl, r.col, distinct_count, row_number() OVER (PARTITION BY fact ORDER BY own, distinct_count, r.tbl, r.col) AS nth
        FROM src JOIN r ON r.tbl = src.tbl WHERE data_type = 'string' AND r.role <> 'key' AND distinct_count > 1 AND (r.tbl, r.col) NOT IN (SELECT (tbl, col) FROM rel))
    SELECT fact, tbl AS "table", col AS "column", CAST(distinct_count AS BIGINT) AS distinct_count FROM o WHERE nth = 1"""
)
def best_categories(t):
    profiles, keys, rels = discovered(t)
    return D.best_categories(profiles, rels, D.table_roles(profiles, keys, rels))


@query(
    f"""{LINKS} SELECT tbl AS "table", col AS "column", CAST(distinct_count AS BIGINT) AS distinct_count FROM r
    WHERE data_type = 'string' AND role <> 'key' AND distinct_count <= 60 AND NOT regexp_matches(col, '((^|[_ ])(id|code|key|no|num|sk|pk|fk|guid|uuid)|id)$', 'i')
      AND (tbl, col) NOT IN (SELECT (tbl, col) FROM rel)"""
)
def slicer_columns(t):
    profiles, _, rels = discovered(t)
    return D.slicer_columns(profiles, rels)


@query(
    """SELECT 'missing-key' AS rule, 'warning' AS severity, 'lineitem' AS target
    WHERE NOT EXISTS (SELECT 1 FROM lineitem HAVING COUNT(DISTINCT l_orderkey) = COUNT(*) OR COUNT(DISTINCT l_extendedprice) = COUNT(*) OR COUNT(DISTINCT l_shipdate) = COUNT(*))
    UNION ALL SELECT 'high-null', 'warning', 'events[value]' WHERE (SELECT COUNT(*) FILTER (value < 40) > 0.4 * COUNT(*) FROM events)
    UNION ALL SELECT 'orphan-table', 'info', 'events'"""
)
def structural_findings(t):
    """Lines have no key; events get a column of holes and are related to nothing here."""
    events = t.events.select("event_id", "event_type", F.when(F.col("value") >= 40, F.col("value")).alias("value"))
    tables = {"orders": t.orders.select("o_orderkey", "o_orderdate", "o_totalprice"), "lineitem": t.lineitem.select("l_orderkey", "l_extendedprice", "l_shipdate"), "events": events}
    profiles = P.profile_tables(tables)
    keys = D.primary_keys(profiles)
    rels = D.relationships(tables, profiles, keys)
    return D.structural_findings(profiles, keys, rels.where("from_table <> 'events' and to_table <> 'events'")).select("rule", "severity", "target")


def dependencies(t):
    """Rows that point at rows: orders at customers, customers and suppliers at nations, nations at regions."""
    link = lambda df, a, x, b, y: df.select(F.concat(F.lit(a), F.col(x)).alias("src"), F.concat(F.lit(b), F.col(y)).alias("dst"))
    edges = link(t.orders, "o", "o_orderkey", "c", "o_custkey")
    edges = edges.unionByName(link(t.customer, "c", "c_custkey", "n", "c_nationkey"))
    edges = edges.unionByName(link(t.supplier, "s", "s_suppkey", "n", "s_nationkey"))
    return edges.unionByName(link(t.nation, "n", "n_nationkey", "r", "n_regionkey"))


EDGES = """e AS (SELECT 'o' || o_orderkey AS src, 'c' || o_custkey AS dst FROM orders UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)"""
REACHED = f"""WITH RECURSIVE {EDGES}, reach AS (SELECT 'r' || r_regionkey AS node, 0 AS distance FROM region WHERE r_name = 'ASIA'
  UNION SELECT e.src, distance + 1 FROM reach JOIN e ON e.dst = reach.node)"""


def asia(t):
    return t.region.where("r_name = 'ASIA'").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))


@query(f"{REACHED} SELECT node, MIN(distance) AS distance FROM reach WHERE distance > 0 GROUP BY 1")
def impact_closure(t):
    return L.cascade_impact(dependencies(t), asia(t))


@query(
    f"""{REACHED}, d AS (SELECT DISTINCT node FROM reach), lv AS (SELECT node, 1 AS step FROM d WHERE node NOT IN (SELECT dst FROM e JOIN d ON d.node = e.src)
      UNION SELECT e.dst, step + 1 FROM lv JOIN e ON e.src = lv.node JOIN d ON d.node = e.dst)
    SELECT node, MAX(step) AS step FROM lv GROUP BY 1"""
)
def deletion_order(t):
    edges = dependencies(t)
    doomed = L.cascade_impact(edges, asia(t)).select("node").unionByName(asia(t))
    return L.deletion_order(edges, doomed)


@query(
    f"""WITH {EDGES}, c AS (SELECT dst, COUNT(*) AS n FROM e GROUP BY 1), u AS (SELECT 'c' || user_id AS node, COUNT(*) AS h FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT x.node, CAST(COALESCE(n, 0) AS BIGINT) AS dependents, CAST(COALESCE(h, 0) AS BIGINT) AS report_refs,
      CASE WHEN n > 0 OR h > 0 THEN 'referenced' ELSE 'unused' END AS state
    FROM (SELECT 'c' || c_custkey AS node FROM customer UNION ALL SELECT 's' || s_suppkey FROM supplier) x LEFT JOIN c ON c.dst = x.node LEFT JOIN u ON u.node = x.node"""
)
def usage_states(t):
    nodes = t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("node")).unionByName(t.supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node")))
    refs = t.events.where("event_type = 'purchase'").groupBy(F.concat(F.lit("c"), "user_id").alias("node")).agg(F.count(F.lit(1)).alias("hits"))
    return L.usage_states(nodes, dependencies(t), report_refs=refs)


@query(
    """SELECT c_custkey AS node, g * 4 + 3 AS cycle FROM (SELECT c_custkey, c_custkey // 4 AS g FROM customer)
    WHERE g IN (SELECT c_custkey // 4 FROM customer GROUP BY 1 HAVING COUNT(*) = 4 AND MIN(c_acctbal) > 0)"""
)
def dependency_cycles(t):
    """Customers in rings of four, where a ring is broken by any member with a debt."""
    key = F.col("c_custkey")
    following = F.when(key % 4 == 3, key - 3).otherwise(key + 1)
    return L.cycles(t.customer.where("c_acctbal > 0").select(key.alias("src"), following.alias("dst")))


@query(
    """SELECT event_type AS object, CAST(COUNT(*) AS BIGINT) AS "references",
      CAST(COUNT(DISTINCT CASE WHEN user_id % 10 <> 0 THEN user_id || '|' || props END) AS BIGINT) AS placements FROM events GROUP BY 1"""
)
def reference_tally(t):
    page = F.when(F.col("user_id") % 10 != 0, F.col("user_id"))
    return L.reference_tally(t.events.select(F.col("event_type").alias("object"), page.alias("page"), F.col("props").alias("visual")))


