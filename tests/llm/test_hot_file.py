import random

from pyspark.sql import functions as F

from chainloom.llm import entities

COLUMNS = "key long, project string, file string, src string, snk string, sl int, kl int"


def side(spark, rows):
    return entities.prepared(spark.createDataFrame(rows, COLUMNS), "key", *map(F.col, ("project", "file", "src", "snk", "sl", "kl")))


def test_partner_outside_the_window(spark):
    """More records of one file than the window holds lie, in every order, between the two records of each pair."""
    rng = random.Random(8)
    place = ("p", "a/b/C.java")
    filler = [(1000 + i, *place, "m" + "".join(rng.choices("bcdfg", k=9)), "m" + "".join(rng.choices("hjklm", k=9)), 40 + i, 100 + i % 300) for i in range(120)]
    a = [(1, *place, "alphaSource", "alphaSink", None, None), (2, *place, "cut", "abcdefghij", 5, 400), (3, *place, "zip", "alone", 5, 9)]
    b = [(11, *place, "zlphaSource", "zlphaSink", 700, 600), (12, *place, "cut", "abcdefgh", 5, None), (13, *place, "zip", "alone", 5, 18)]
    got = entities.candidates(side(spark, a + filler), side(spark, b + [(9000 + r[0], *r[1:3], "q" + r[3], "q" + r[4], *r[5:]) for r in filler]))
    assert {(r.a_id, r.b_id) for r in got.collect() if r.a_id < 100 and r.b_id < 100} == {(1, 11), (2, 12)}


def test_alike_names_share_a_key(spark):
    rng = random.Random(9)
    names = ["".join(rng.choices("abe", k=rng.randint(1, 7))) for _ in range(150)]
    df = spark.createDataFrame([(n, "".join(sorted(n[:2])) + n[2:]) for n in names], "n string, w string").distinct()
    keyed = df.select("n", "w", entities.name_keys(F.col("n"), F.col("w")).alias("k"))
    both = keyed.alias("x").crossJoin(keyed.alias("y")).where(entities.variable_likeness(F.col("x.n"), F.col("x.w"), F.col("y.n"), F.col("y.w")) > 0)
    assert both.count() > 200 and both.where(~F.arrays_overlap("x.k", "y.k")).count() == 0
