"""Files: decoding, NUL, empty folders, shards, JSON lines."""

from chainloom.sources import files


def test_sources_are_decoded_and_empty_files_have_no_row(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, content in {"a/One.java": "class Öne {}\r\n".encode(), "Two.java": b"x\0y", "Three.java": b"a\xffb", "Empty.java": b"", "notes.txt": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    got = {r.file.rsplit("/", 1)[1]: r.text for r in files.read_sources(spark, str(tmp_path)).collect()}
    assert got == {"One.java": "class Öne {}\r\n", "Two.java": "", "Three.java": "a�b"}


def test_folder_without_sources(spark, tmp_path):
    (tmp_path / "notes.txt").write_text("no")
    assert files.read_sources(spark, str(tmp_path)).collect() == []


def test_shards_are_appended_and_stay_text(spark, tmp_path):
    folder = str(tmp_path / "cache")
    for rows in ([(1, "00"), (2, "1e")], [(3, "00"), (4, None)]):
        files.write_shards(spark.createDataFrame(rows, "k long, shard string"), "shard", folder)
    got = spark.read.schema("k long, shard string").parquet(folder).collect()
    assert sorted((r.k, r.shard) for r in got) == [(1, "00"), (2, "1e"), (3, "00"), (4, None)]


def test_json_keeps_nulls_and_nesting(spark, tmp_path):
    df = spark.createDataFrame([(1, ("a", None), ["x"]), (2, None, None)], "k long, s struct<v: string, n: int>, p array<string>")
    files.write_json(df, str(tmp_path / "out"))
    files.write_json(df, str(tmp_path / "out"))
    assert sorted(files.read_json(spark, str(tmp_path / "out"), df.schema).collect()) == sorted(df.collect())


def test_project_sources(spark):
    paths = ["/r/test/src/A.java", "/r/test/src/it_test/B.java", "/r/test/x/Integration_Tests/C.java", "/r/test/x/OrderTest.java", "/r/test/x/Contest.java", "/r/test/target/D.java"]
    df = spark.createDataFrame([(p, "x") for p in paths], "file string, text string")
    names = lambda rows: sorted(r.file.rpartition("/")[2] for r in rows.collect())
    assert names(files.project_sources(df, "/r/test")) == ["A.java", "B.java", "Contest.java"]
    assert names(files.project_sources(df, "/r/test/", include_tests=True)) == ["A.java", "B.java", "C.java", "Contest.java", "OrderTest.java"]
