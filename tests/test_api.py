from chainloom import api


def test_analyze_a_folder(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.java").write_text('class A {\npublic String f(String p) {\nString in1 = request.getParameter("x");\nString sql1 = in1;\nstmt1 = conn.prepareStatement(sql1);\ndb.executeQuery(sql1);\n}\n}\n')
    (tmp_path / "test").mkdir()
    (tmp_path / "test" / "B.java").write_text("class B {\n}\n")
    got = api.analyze(spark, str(tmp_path))
    assert [(r.source_variable, r.sink_variable, r.vuln_type) for r in got.chains.collect()] == [("in1", "sql1", "sql_injection")]
    assert [r.sanitizer for r in got.sanitizers.collect()] == ["prepared_statement"]
    assert [r.variable for r in api.sinks(spark, str(tmp_path)).collect()] == ["sql1"]


def test_evaluate(spark):
    shape = "project string, source_var string, source_file string, source_line int, sink_var string, sink_file string, sink_line int, vuln_type string"
    found = spark.createDataFrame([(1, "p", "aa", "F", 3, "bb", "F", 9, "xss"), (2, "p", "aa", "F", 3, "bb", "F", 9, "xss")], "finding long, " + shape)
    truth = spark.createDataFrame([(5, "p", "aa", "F", 4, "bb", "F", 9, "xss"), (6, "p", "zz", None, 0, "bb", None, 9, "xss")], "label long, " + shape)
    got = api.evaluate(found, truth)
    assert [(r.finding, r.label) for r in got.matched.collect()] == [(1, 5)]
    assert [r.finding for r in got.unmatched.collect()] == [2] and [r.label for r in got.missed.collect()] == [6]
