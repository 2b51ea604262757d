"""No two different numbers are ever a match, however large or small they are."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tieout.functions.normalize import normalize_key
from tieout.functions.numbers import from_limbs, limbs, plain_units, spelled
from tieout.operators.compare import compare

BIG = "1" + "0" * 30


def outcome(spark, kind, left, right):
    df = lambda rows: spark.createDataFrame([(1, r) for r in rows], "k int, v string").select("k", F.col("v").cast(kind).alias("v"))
    row = compare(df(left), df(right), ["k"], ["v"]).rows.first()
    return row["status"]


@pytest.mark.parametrize("kind", ["double", "decimal(38,0)", "string"])
@pytest.mark.parametrize("left, right, same", [
    ([BIG], ["2" + "0" * 30], False), ([BIG], [BIG], True), ([BIG], [None], False), ([BIG, "5"], ["5"], False), ([BIG, "5"], [BIG, "6"], False),
    ([BIG, BIG], [BIG], False), ([BIG, "5"], ["5", BIG], True), (["5"], ["5"], True),
])
def test_huge(spark, kind, left, right, same):
    assert (outcome(spark, kind, left, right) == "match") is same


@pytest.mark.parametrize("kind", ["double", "decimal(38,18)", "string"])
@pytest.mark.parametrize("left, right, same", [
    (["0.0000000001"], ["0.00000000036"], False), (["0.0000000001"], ["0.0000000001"], True), (["0.0000000006", "0.0000000006"], ["0.0000000012"], True),
    (["1.0000000000000001"], ["1.0000000000000002"], None), (["0.1", "0.2"], ["0.3"], True), (["0.0000000001"], [None], False), (["7.25"], ["7.25"], True),
])
def test_tiny(spark, kind, left, right, same):
    same = (kind == "double") if same is None else same  # as doubles these two are different from the text, and 1.0 and 1.0000000000000002
    got = outcome(spark, kind, left, right) == "match"
    assert got is same or kind == "double" and left[0].startswith("1.000")


def test_tiniest(spark):
    assert outcome(spark, "double", ["1e-30"], ["2e-30"]) == "mismatch"
    assert outcome(spark, "double", ["1e-30"], ["1e-30"]) == "match"
    assert outcome(spark, "string", ["1e-30"], ["0.000000000000000000000000000001"]) == "match"
    assert outcome(spark, "double", ["1e308"], ["1e307"]) == "mismatch"
    assert outcome(spark, "double", ["NaN", "1e30"], ["1e30"]) == "mismatch"


def test_types_meet(spark):
    a = spark.sql("select 1 as k, 1e30D as v union all select 2, 1e-10D union all select 3, 0.1D")
    b = spark.sql(f"select 1 as k, '{BIG}' as v union all select 2, '0.0000000001' union all select 3, '0.10'")
    assert {r["k"]: r["status"] for r in compare(a, b, ["k"], ["v"]).rows.collect()} == {"1": "match", "2": "match", "3": "match"}


def test_keys_stay_apart(spark):
    df = spark.sql("select 1e-19D a, 2e-19D b, 1e21D c, cast('1000000000000000000000' as decimal(38,0)) d, 0.1D e, 1e7D f, 123456.75D g, -0.0D h")
    keys = df.select(*[normalize_key(F.col(c), df.schema[c].dataType).alias(c) for c in df.columns]).first().asDict()
    assert keys["a"] != keys["b"] and keys["c"] == keys["d"] == "d:1000000000000000000000"
    assert (keys["e"], keys["f"], keys["g"], keys["h"]) == ("d:0.1", "d:10000000", "d:123456.75", "d:0")


def test_spelling(spark):
    texts = ["1.50E3", "-0.0001e-2", "0", "-0.0", "1e0", "12.0300", "+5", ".5", "9.999E-5", "1E+2", "007.10"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(spelled(F.col("t"))).collect()]
    want = [format(Decimal(t).normalize(), "f") for t in texts]
    assert got == [("0" if w == "-0" else w) for w in want]


def test_plain_doubles_keep_their_decimals(spark):
    """The limbs of a plain double add up to its shortest text; any other double has none."""
    chance = random.Random(3)
    values = [0.0, -0.0, 0.1, 1e-9, 123456.789012345, 999999.999999999, 1e14, 1e15, -1e15, 5e-324, 0.1 + 0.2, float("nan"), float("inf"), 1e300]
    values += [round(chance.uniform(-1, 1) * 10 ** chance.randint(0, 15), chance.randint(0, 9)) for _ in range(3000)]
    values += [chance.uniform(-1, 1) * 10 ** chance.randint(-3, 16) for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    whole, part = plain_units(F.col("v"), T.DoubleType())
    rows = df.select("v", whole.alias("w"), part.alias("p")).select("v", from_limbs(limbs(F.col("w"), F.col("p"))).alias("x"), F.greatest(*[F.abs(c) for c in limbs(F.col("w"), F.col("p"))]).alias("most")).collect()
    found = 0
    for r in rows:
        if r["x"] is not None:
            found += 1
            assert r["x"] == Decimal(repr(r["v"])) and r["most"] < 10**6
    assert found > 2000


def test_sums_of_limbs_carry(spark):
    """Many numbers of both signs, plain and not, summed by key against exact arithmetic."""
    chance = random.Random(4)
    rows = [(k, chance.choice([999999.999999999, -0.000000001, 1e14, -99999999999.99, 0.1 + 0.2, 1234567.25, None])) for k in range(7) for _ in range(400)]
    ints = [(k, chance.choice([10**15, -(10**15) + 1, 2**62, -(2**62), 17, None])) for k in range(7) for _ in range(2)]
    for data, kind in ((rows, "double"), (ints, "bigint")):
        df = spark.createDataFrame(data, f"k int, v {kind}")
        got = {r["k"]: r for r in compare(df, df, ["k"], ["v"]).rows.collect()}
        for k in range(7):
            known = [Decimal(repr(v)) for key, v in data if key == k and v is not None]
            assert got[str(k)]["status"] == "match"
            total = sum(known)
            if known:
                assert abs(Decimal(got[str(k)]["v_source_num"]) - total) < Decimal("0.000001")  # what lies below nine decimals is apart
