import random

from pyspark.sql import functions as F

from chainloom.functions import rules
from chainloom.operators import matching


def test_band_join(spark):
    rng = random.Random(1)
    a = [(i, rng.choice("xy"), rng.randrange(-30, 60)) for i in range(60)] + [(99, None, 1), (98, "x", None)]
    b = [(i, rng.choice("xy"), rng.randrange(-30, 60)) for i in range(60)]
    got = matching.band_join(spark.createDataFrame(a, "i int, k string, p int"), spark.createDataFrame(b, "j int, k string, q int"), ["k"], "p", "q", 5)
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((x[0], y[0]) for x in a for y in b if None not in x and x[1] == y[1] and abs(x[2] - y[2]) <= 5)


def test_longest_suffix(spark):
    paths = spark.createDataFrame([("C:\\w\\a\\b\\C.java",), ("/x/xa/b/C.java",), ("C.java",), (None,)], "path string")
    known = spark.createDataFrame([("a/b/C.java",), ("b/C.java",), ("C.java",)], "name string")
    got = {r.path: r.name for r in matching.longest_suffix(paths, "path", known, "name").collect()}
    assert got == {"C:\\w\\a\\b\\C.java": "a/b/C.java", "/x/xa/b/C.java": "b/C.java", "C.java": "C.java"}


def test_overlay_and_first(spark):
    base, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, matching.overlay(base, new, "k").collect())) == [(1, "a"), (2, None), (3, "c")]
    rows = spark.createDataFrame([(1, 5, "x"), (1, 4, "y"), (1, 4, "z")], "k int, o int, v string")
    assert matching.first_by(rows, ["k"], F.col("o"), F.col("v")).first().v == "y"


def test_rules(spark):
    df = spark.createDataFrame([("cwe_079", "shell script", None), ("x1", "xpath", float("nan")), ("89", "url_redirect", 85.0), (None, None, -1.0)], "c string, l string, n double")
    got = df.select(rules.weakness_number(F.col("c")).alias("c"), rules.weakness_kind(F.col("l")).alias("k"), rules.unit_confidence(F.col("n")).alias("n")).collect()
    assert [r.c for r in got] == ["CWE-79", None, "CWE-89", None]
    assert [r.k for r in got] == ["xss", "path_traversal", "open_redirect", "other"]
    assert [r.n for r in got] == [None, None, 0.85, 0.0]
    assert df.select(rules.ratio(F.lit(1), F.lit(0))).first()[0] == 0.0


def test_published_counts(spark):
    """Counts and ratios as published: 577 / 472 / 200."""
    row = spark.range(1).select(rules.ratio(F.lit(577), F.lit(577 + 472)).alias("p"), rules.ratio(F.lit(577), F.lit(777)).alias("r"), rules.f1(F.lit(577), F.lit(472), F.lit(200)).alias("f")).first()
    assert (row.p, row.r, row.f) == (0.55, 0.7426, 0.632)
