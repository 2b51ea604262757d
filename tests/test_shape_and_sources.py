"""Type inference, profiles, discovery, lineage, sources and sinks."""

import glob
import random
from datetime import date, datetime

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tieout.functions.celltypes import cell_kind, coerce
from tieout.operators import discover as D
from tieout.operators import lineage as L
from tieout.operators import profile as P
from tieout.plans import suite as S
from tieout.sources import export, files
from tieout.sources.catalogue import describe, describe_database
from tieout.sources.queries import capped, jdbc_query, sql_side


@pytest.mark.parametrize(
    "text, kind",
    [
        ("1", "integer"), ("-5", "integer"), ("1,234", "integer"), ("$1,234", "integer"), ("12%", "integer"), ("€ 5.5", "decimal"), ("1.50", "decimal"),
        ("12,34", "string"), ("007", "integer"), ("Yes", "boolean"), (" f ", "boolean"), ("2024-01-31", "date"), ("1/31/2024", "date"),
        ("2024-01-31T10:00", "dateTime"), ("2024-01-31 10:00:00.5Z", "dateTime"), ("1/31/2024 9:05", "dateTime"), ("2024-13-01", "string"), ("abc", "string"),
        ("  ", None), (None, None),
    ],
)
def test_cell_kinds(spark, text, kind):
    assert spark.createDataFrame([(text,)], "c string").select(cell_kind(F.col("c"))).first()[0] == kind


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("$1,234.5", "decimal", 1234.5), ("12%", "integer", 12), ("abc", "integer", None), ("12d", "decimal", None), ("1e3", "decimal", 1000.0),
        ("9007199254740993", "integer", 9007199254740993), ("maybe", "boolean", False), ("Y", "boolean", True), (" ", "boolean", None),
        ("1/2/2024", "date", date(2024, 1, 2)), ("2024-01-02T23:30:00-02:00", "date", date(2024, 1, 3)), ("x", "date", None),
        ("2024-01-02T23:30:00-02:00", "dateTime", datetime(2024, 1, 3, 1, 30)), ("1/2/2024 9:05", "dateTime", datetime(2024, 1, 2, 9, 5)),
        ("2024-01-02", "dateTime", datetime(2024, 1, 2)), (" keep ", "string", " keep "),
    ],
)
def test_coercion(spark, text, kind, value):
    assert spark.createDataFrame([(text,)], "c string").select(coerce(F.col("c"), kind)).first()[0] == value


def test_types_need_nine_tenths(spark):
    rows = [(str(i), "x" if i < 1 else "1.5", "x" if i < 2 else "1", "", "2024-01-01" if i else "2024-01-01 10:00:00") for i in range(10)]
    df = spark.createDataFrame(rows, "a string, b string, c string, d string, e string")
    found = {r["column"]: r["data_type"] for r in P.infer_types(df).collect()}
    assert found == {"a": "integer", "b": "decimal", "c": "string", "d": "string", "e": "dateTime"}
    typed = P.typed(df)
    assert [t for _, t in typed.dtypes] == ["bigint", "double", "string", "string", "timestamp_ntz"]
    assert typed.where("b is null").count() == 1
    mixed = spark.createDataFrame([(1.0, datetime(2024, 1, 1), True, 1), (2.5, datetime(2024, 1, 1, 5), None, None)], "x double, t timestamp_ntz, f boolean, i int")
    assert {r["column"]: (r["position"], r["data_type"]) for r in P.infer_types(mixed).collect()} == {
        "x": (0, "decimal"), "t": (1, "dateTime"), "f": (2, "boolean"), "i": (3, "integer")
    }


def test_profile_and_distributions(spark):
    df = spark.createDataFrame([(i, float(i % 3), "v%d" % (i % 12), None if i < 5 else date(2020 + i % 2, 1, 1), i % 2 == 0) for i in range(100)],
                               "id int, price double, label string, d date, flag boolean")
    rows = {r["column"]: r for r in P.profile(df, "t").collect()}
    assert (rows["id"]["distinct_count"], rows["id"]["role"], rows["id"]["min"], rows["id"]["max"], rows["id"]["mean"]) == (100, "key", 0, 99, 49.5)
    assert (rows["price"]["distinct_count"], rows["price"]["role"]) == (3, "measureCandidate")
    assert (rows["label"]["min_text"], rows["label"]["distinct_count"], rows["label"]["role"]) == ("v0", 12, "dimension")
    assert (rows["d"]["null_count"], rows["d"]["role"], rows["flag"]["role"]) == (5, "date", "flag")
    top = {r["nth"]: (r["label"], r["count"]) for r in P.top_values(df, ["label"]).collect()}
    assert len(top) == 9 and top[9] == ("+4 more", 32) and top[1] == ("v0", 9)
    bins = P.histogram(df, ["id", "price"]).orderBy("column", "bin").collect()
    assert [r["count"] for r in bins if r["column"] == "id"] == [10] * 10 and bins[0]["label"] == "0–9.9"
    assert [r["count"] for r in bins if r["column"] == "price"] == [34, 0, 0, 0, 0, 33, 0, 0, 0, 33]
    single = P.histogram(df.select(F.lit(7).alias("x")), ["x"]).collect()
    assert [(r["label"], r["count"]) for r in single] == [("7", 100)]
    assert {r["year"]: r["count"] for r in P.year_counts(df, ["d"]).collect()} == {2020: 47, 2021: 48}
    assert tuple(P.flag_counts(df, ["flag"]).first()) == ("flag", 50, 50)


def test_value_counts_keep_values_apart(spark):
    df = spark.createDataFrame([(1, 1.0, "1", 0.5), (2, 1.5, " 1", 1e-7), (2, 12345678.25, "", 3.0)], "i int, x double, s string, y double")
    found = {(r["column"], r["value"]): r["n"] for r in P.value_counts(df).collect()}
    assert found == {("i", "1"): 1, ("i", "2"): 2, ("x", "1"): 1, ("x", "1.5"): 1, ("x", "12345678.25"): 1, ("s", "1"): 1, ("s", " 1"): 1,
                     ("y", "0.5"): 1, ("y", "0.0000001"): 1, ("y", "3"): 1}


@pytest.fixture(scope="module")
def star(spark):
    rng = random.Random(3)
    customers = spark.createDataFrame([(i, "name%d" % i, "seg%d" % (i % 3)) for i in range(40)], "customer_id int, name string, segment string")
    calendar = spark.createDataFrame([(date(2024, 1, 1 + i), 2024, 1 + i) for i in range(31)], "date date, year int, day_no int")
    rows = [(i, float(rng.randrange(40) if i else 999), rng.choice([date(2024, 1, d) for d in range(1, 29)]), rng.random() * 100) for i in range(300)]
    sales = spark.createDataFrame(rows, "sale_id int, customer_id double, sold date, amount double")
    return {"customers": customers, "calendar": calendar, "sales": sales}


def test_discovery(star):
    profiles = P.profile_tables(star)
    keys = D.primary_keys(profiles)
    assert {r["table"]: r["column"] for r in keys.collect()} == {"customers": "customer_id", "calendar": "day_no", "sales": "sale_id"}
    rels = D.relationships(star, profiles, keys)
    found = {(r["from_table"], r["from_col"], r["to_table"]): r for r in rels.collect()}
    link = found["sales", "customer_id", "customers"]
    assert link["active"] and 0.9 < link["containment"] < 1 and link["confidence"] == pytest.approx(0.7 * link["containment"] + 0.3, abs=0.006)
    roles = {r["table"]: r["role"] for r in D.table_roles(profiles, keys, rels).collect()}
    assert roles["sales"] == "fact" and roles["customers"] == "dimension"
    measures = D.measure_candidates(profiles, keys, rels, D.table_roles(profiles, keys, rels)).collect()
    assert ("sales", "amount", "sum") in {(r["table"], r["column"], r["agg"]) for r in measures}
    assert ("sales", "count_rows") in {(r["table"], r["agg"]) for r in measures}
    best = {r["fact"]: (r["table"], r["column"]) for r in D.best_categories(profiles, rels, D.table_roles(profiles, keys, rels)).collect()}
    assert best["sales"] == ("customers", "segment")


def test_two_links_to_one_parent_have_one_active(spark):
    parent = spark.createDataFrame([(i, "p%d" % i) for i in range(10)], "node_id int, label string")
    child = spark.createDataFrame([(i % 10, (i + 1) % 10, i * 1.5) for i in range(50)], "from_node_id int, to_node_id int, weight double")
    profiles = P.profile_tables({"node": parent, "edge": child})
    rels = D.relationships({"node": parent, "edge": child}, profiles)
    assert {r["from_col"]: r["active"] for r in rels.collect()} == {"from_node_id": True, "to_node_id": False}


def test_findings(spark):
    tables = {
        "facts": spark.createDataFrame([(i % 5, None if i % 2 else 1.0) for i in range(100)], "k int, v double"),
        "lone": spark.createDataFrame([(1, "x"), (2, "y")], "id int, t string"),
        "_param": spark.createDataFrame([(1, 1), (1, 1)], "a int, b int"),
    }
    profiles = P.profile_tables(tables)
    keys = D.primary_keys(profiles)
    none = D.relationships(tables, profiles, keys).where("1 = 0")
    found = {(r["rule"], r["target"]) for r in D.structural_findings(profiles, keys, none).collect()}
    assert found == {("missing-key", "facts"), ("high-null", "facts[v]"), ("orphan-table", "facts"), ("orphan-table", "lone"), ("no-date-table", "")}
    mine = lambda p, k, r: p.where("column = 't'").select(F.lit("mine").alias("rule"), F.lit("info").alias("severity"), F.col("column").alias("target"), F.lit("").alias("message"))
    assert [r["rule"] for r in D.structural_findings(profiles, keys, none, [mine]).collect()] == ["mine"]


def test_storage_findings(spark):
    schema = "table string, column string, data_type string, rows bigint, cardinality bigint, data_bytes bigint, dictionary_bytes bigint, total_bytes bigint, share double, uniqueness double"
    kb = 1024
    rows = [
        ("sales", "note", "string", 100000, 95000, 100 * kb, 900 * kb, 1000 * kb, 0.9, 0.95),
        ("sales", "small", "string", 100000, 10, 1 * kb, 1 * kb, 2 * kb, 0.002, 0.0001),
        ("dim_patient", "PatientID", "integer", 2000, 2000, 20 * kb, 20 * kb, 40 * kb, 0.04, 1.0),
        ("dim_patient", "Email", "string", 2000, 1990, 20 * kb, 20 * kb, 40 * kb, 0.04, 0.995),
    ]
    storage = spark.createDataFrame(rows, schema)
    found = {r["column"]: r for r in D.storage_findings(storage).collect()}
    assert set(found) == {"note", "Email"}
    assert (found["note"]["severity"], found["note"]["reasons"]) == ("high", "dominant,near-unique,large-dictionary")
    assert found["Email"]["title"] == "near-unique"
    used = spark.createDataFrame([("SALES", "Note"), ("dim_patient", "email")], "table string, column string")
    judged = {r["column"]: r["reasons"] for r in D.storage_findings(storage, used).collect()}
    assert judged["PatientID"] == "unreferenced" and "unreferenced" not in judged["note"]
    assert P.storage_summary(storage).first()["largest_column"] == "sales[note]"


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src int, dst int")


def test_lineage(spark):
    graph = edges(spark, [(2, 1), (3, 2), (4, 3), (4, 1), (5, 5), (7, 6)])
    start = spark.createDataFrame([(1,)], "node int")
    assert {r["node"]: r["distance"] for r in L.cascade_impact(graph, start).collect()} == {2: 1, 4: 1, 3: 2}
    order = {r["node"]: r["step"] for r in L.deletion_order(graph, spark.createDataFrame([(1,), (2,), (3,), (4,)], "node int")).collect()}
    assert order == {4: 1, 3: 2, 2: 3, 1: 4}
    ring = edges(spark, [(1, 2), (2, 1), (1, 3)])
    stuck = {r["node"]: r["step"] for r in L.deletion_order(ring, spark.createDataFrame([(1,), (2,), (3,)], "node int")).collect()}
    assert stuck == {1: None, 2: None, 3: None}
    nodes = spark.createDataFrame([(i,) for i in (1, 4, 6, 9)], "node int")
    refs = spark.createDataFrame([(9, 2)], "node int, hits int")
    assert {r["node"]: r["state"] for r in L.usage_states(nodes, graph).collect()} == {1: "referenced", 4: "no-refs", 6: "referenced", 9: "no-refs"}
    assert {r["node"]: r["state"] for r in L.usage_states(nodes, graph, report_refs=refs).collect()} == {1: "referenced", 4: "unused", 6: "referenced", 9: "referenced"}


def reach(pairs, a):
    seen, todo = set(), [a]
    while todo:
        x = todo.pop()
        for s, d in pairs:
            if s == x and d not in seen:
                seen.add(d)
                todo.append(d)
    return seen


@pytest.mark.parametrize("seed", [1, 2])
def test_cycles_match_brute_force(spark, seed):
    rng = random.Random(seed)
    pairs = sorted({(rng.randrange(14), rng.randrange(14)) for _ in range(16)})
    found = {r["node"]: r["cycle"] for r in L.cycles(edges(spark, pairs)).collect()}
    reached = {n: reach(pairs, n) for n in range(14)}
    on_cycle = {n for n in range(14) if n in reached[n]}
    assert set(found) == on_cycle
    for a in on_cycle:
        for b in on_cycle:
            together = b in reached[a] and a in reached[b]
            assert (found[a] == found[b]) == (together or a == b)


def test_reference_tally(spark):
    refs = spark.createDataFrame([("m", "p1", "bar"), ("m", "p1", "bar"), ("m", "p2", "bar"), ("m", None, "x"), ("c", None, None)], "object string, page string, visual string")
    assert {tuple(r) for r in L.reference_tally(refs).collect()} == {("m", 4, 2), ("c", 1, 0)}


def test_text_files(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('a,,a,"q""x"\n1,2,3,"line\nbreak"\n\n , ,,\n4,5\n6,7,8,9,10\n', encoding="utf8")
    df = files.read_text_table(spark, str(path))
    assert df.columns[1] == "Column 2" and df.columns[3] == 'q"x' and len(set(df.columns)) == 4
    rows = [tuple(r) for r in df.collect()]
    assert rows == [("1", "2", "3", "line\nbreak"), ("4", "5", None, None), ("6", "7", "8", "9")]
    tsv = tmp_path / "t.tsv"
    tsv.write_text("x\ty\n1\t2\n", encoding="utf8")
    assert files.read_table(spark, str(tsv)).first()["y"] == "2"
    assert files.clean_headers(["", "x", "X", None]) == ["Column 1", "x", "X_2", "Column 4"]
    assert list(files.read_tables(spark, {"Sales 2024!": str(tsv), "sales-2024": str(tsv)})) == ["sales_2024", "sales_2024_2"]
    with pytest.raises(ValueError):
        files.read_table(spark, "x.pdf")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("=1+1", -5, "a,b"), ("-x", 2, 'say "hi"'), ("ok", None, None)], "t string, n int, u string")
    export.write_csv(df, str(tmp_path / "out"))
    text = "".join(open(f, encoding="utf8").read() for f in glob.glob(str(tmp_path / "out" / "*.csv")))
    assert "'=1+1,-5,\"a,b\"" in text and "'-x,2,\"say \"\"hi\"\"\"" in text and "ok,," in text
    checks = [S.Check("a", "=bad name", spark.createDataFrame([(1,)], "n int"), spark.createDataFrame([(3,)], "n int"), values=("n",))]
    export.write_evidence(S.run_suite(spark, checks), str(tmp_path / "evidence"))
    back = spark.read.csv(str(tmp_path / "evidence"), header=True).first()
    assert (back["check"], back["source_value"], back["target_value"], back["difference"], back["status"]) == ("'=bad name", "1", "3", "2", "Failed")
    dates = spark.createDataFrame([(date(2024, 1, 1),), (date(2024, 1, 3),)], "d date")
    export.write_date_dimension(dates, "d", str(tmp_path / "dates"), columns=["Year"])
    assert spark.read.csv(str(tmp_path / "dates"), header=True).count() == 3
    written = export.extract_tables({"one": df, "two": dates}, str(tmp_path / "all"))
    assert spark.read.csv(written["two"], header=True).count() == 2


def test_catalogue_and_sides(spark):
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    rows = {r["column"]: r for r in describe(spark, {"t": df}, {"t": ["id"]}).collect()}
    assert (rows["id"]["key_position"], rows["t"]["key_position"], rows["id"]["type"]) == (1, None, "int")
    with pytest.raises(ValueError):
        describe(spark, {"t": df}, {"t": ["nope"]})
    df.createOrReplaceTempView("tieout_view")
    assert "id" in {r["column"] for r in describe_database(spark).where("table = 'tieout_view'").collect()}
    assert not capped(spark.range(10), 10).truncated and capped(spark.range(11), 10).truncated and capped(spark.range(11), 10).rows_seen == 11
    assert sql_side(spark, "select 1 as n").df.first()["n"] == 1
    with pytest.raises(ValueError):
        jdbc_query(spark, "jdbc:none", "select 1", partition_column="id")


def test_index_of_values_marks_equal_values_of_all_types(spark):
    """A number is the same value in every type that can hold it; text and numbers never meet."""
    long = spark.createDataFrame([(1,), (7,), (10**15 + 1,), (9007199254740993,), (None,), (1,)], "k bigint")
    double = spark.sql("select col1 as d from values (1D), (7.5D), (1000000000000001D), (9007199254740992D), (0.1D), (-0.0D)")
    exact = spark.sql("select cast(col1 as decimal(38,18)) as x from values ('1'), ('7.5'), ('9007199254740993'), ('0.1'), ('0.100000000000000001')")
    text = spark.createDataFrame([("1",), (" ",), (None,), ("7.5",)], "t string")
    days = spark.sql("select date'2020-01-01' as a, timestamp'2020-01-01 10:00:00' as b")
    tables = {"long": long, "double": double, "exact": exact, "text": text, "days": days}
    index, names = D.match_values(tables, {n: df.columns for n, df in tables.items()})
    assert names == [("long", "k"), ("double", "d"), ("exact", "x"), ("text", "t"), ("days", "a"), ("days", "b")]
    marks = sorted(r["w0"] for r in index.collect())
    # By mark: 1, the whole number that double rounds, 7.5 and 0.1 in two types, numbers of one type, two texts, one day.
    assert marks == sorted([0b111, 0b011, 0b101, 0b001, 0b010, 0b010, 0b110, 0b110, 0b100, 0b1000, 0b1000, 0b110000])


def test_more_columns_than_one_word_of_marks(spark):
    wide = spark.range(50).select(*[(F.col("id") % (i + 2)).alias(f"c{i}") for i in range(70)], F.col("id").alias("key"))
    parent = spark.range(60).select(F.col("id").alias("parent_id"))
    tables = {"wide": wide, "parent": parent}
    profiles = P.sketch_tables(tables)
    found = {(r["table"], r["column"]): (r["hits"], r["values"]) for r in D.containment(tables, profiles, D.primary_keys(profiles)).collect()}
    assert len(found) == 70 and all(found[("wide", f"c{i}")] == (min(i + 2, 50),) * 2 for i in range(70) if i < 48)


def test_sketches_decide_as_exact_counts_do(spark):
    """Estimated columns lie on the same side of every limit; the rest are counted."""
    n = 30_000
    df = spark.range(n).select(
        F.col("id").alias("order_id"), F.when(F.col("id") > 0, F.col("id")).otherwise(1).alias("nearly"), (F.col("id") % 20).alias("twenty"),
        (F.col("id") % 21).alias("more"), (F.col("id") % 15_000).alias("half"), (F.col("id") % 97).cast("string").alias("name"),
        F.when(F.col("id") % 2 == 0, F.lit(" ")).otherwise(F.lit("x")).alias("blank"),
    )
    empty = spark.createDataFrame([], "a int, b string")
    tables = {"t": df, "none": empty}
    exact, near = ({(r["table"], r["column"]): r for r in f(tables).collect()} for f in (P.profile_tables, P.sketch_tables))
    assert exact.keys() == near.keys()
    for key, r in near.items():
        want = exact[key]
        assert (r["role"], r["rows"], r["null_count"], r["data_type"]) == (want["role"], want["rows"], want["null_count"], want["data_type"])
        low, high = P.distinct_interval(r["distinct_count"])
        assert r["distinct_count"] == want["distinct_count"] if r["exact"] else low <= want["distinct_count"] <= high
    assert near[("t", "order_id")]["exact"] and near[("t", "nearly")]["exact"] and near[("t", "name")]["exact"] and not near[("t", "half")]["exact"]


def test_profiles_of_tables_with_another_column(spark, tmp_path):
    """A table that carries a column which the SQL doesn't name still agrees with it."""
    from oracle import TABLES, compare, connect
    from tieout.queries import ORACLES, QUERIES

    for name in TABLES:
        df = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        more = df.withColumn("copy", F.monotonically_increasing_id() % 60) if name in ("orders", "part") else df
        pq.write_table(more.toArrow(), tmp_path / f"{name}.parquet")
    duck = connect(str(tmp_path))
    for name in ("profile_columns", "storage_profile", "storage_summary", "storage_findings", "primary_keys", "foreign_keys"):
        ok, note, _ = compare(spark, duck, str(tmp_path), name, QUERIES, ORACLES)
        assert ok, f"{name}: {note}"
