from chainloom.operators.copy_diff import as_count, as_path, as_ratio, as_text, compare_copies

FIELDS = {"file": as_path, "n": as_count, "r": as_ratio(4)}
SCHEMA = "id long, file string, n string, r string, at int, gone boolean, extra string"


def diff(spark, a, b):
    rows = compare_copies(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), "id", FIELDS, "at", "gone").collect()
    assert all(r.left_value is None or r.left_value != r.right_value for r in rows)
    return sorted((r.id if r.id is not None else -1, r.field) for r in rows)


def test_spellings_are_equal(spark):
    a = [(1, "x/A.java", "2", "0.5", 1, False, "p"), (2, None, None, None, 1, None, None)]
    b = [(1, " ./x\\A.java ", " +02.0", "0.500000", 1, False, "q"), (2, "", " ", "", 1, False, None)]
    assert diff(spark, a, b) == []


def test_values_and_case_differ(spark):
    a = [(1, "x/A.java", "2", "0.50004", 1, False, None), (2, "x", "0", "1", 1, False, None)]
    b = [(1, "x/a.java", "3", "0.5001", 1, False, None), (2, "x", None, "none", 1, False, None)]
    assert diff(spark, a, b) == [(1, "file"), (1, "n"), (1, "r"), (2, "n"), (2, "r")]


def test_versions_deletions_and_repeats(spark):
    a = [(1, "x", "1", "1", 1, False, None), (1, "x", "9", "1", 2, False, None), (1, "x", "9", "1", 2, False, None), (2, "x", "1", "1", 1, False, None), (3, "x", "1", "1", 1, False, None)]
    b = [(1, "x", "9", "1", 5, False, None), (2, "x", "1", "1", 1, False, None), (2, "x", "1", "1", 2, True, None), (4, "x", "1", "1", 1, True, None)]
    assert diff(spark, a, b) == [(2, "missing_in_b"), (3, "missing_in_b")]


def test_null_key_and_empty_tables(spark):
    row = [(None, "x", "1", "1", 1, False, None)]
    assert diff(spark, row, row) == []
    assert diff(spark, [], row) == [(-1, "missing_in_a")]
    assert diff(spark, [], []) == []


def test_text(spark):
    df = spark.createDataFrame([(" a b\t",), ("\u00a0",)], "t string")
    assert [r[0] for r in df.select(as_text(df.t)).collect()] == ["a b", None]
