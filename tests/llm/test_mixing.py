from chainloom.llm import mixing

TARGETS = [("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.2, 8), ("gone", 0.4, 2), ("zero", 0.0, 2), (None, 1.0, 1)]


def stock(spark):
    rows = [(i, "a", 10 + i % 7) for i in range(400)] + [(1000 + i, "b", 20) for i in range(300)] + [(2000 + i, "c", 5) for i in range(150)] + [(5000, "other", 9), (5001, "zero", 9)]
    return spark.createDataFrame(rows, "doc long, source string, tokens long"), spark.createDataFrame(TARGETS, "source string, target_weight double, max_repeats int")


def test_shares_and_caps(spark):
    documents, targets = stock(spark)
    chosen = mixing.mixture(documents, targets)
    report = {r.source: r for r in mixing.shares(chosen, documents, targets).collect()}
    for s in "abc":
        assert abs(report[s].actual_share - report[s].target_share) < 0.01 and report[s].most_uses <= report[s].max_repeats
    assert report["gone"].tokens == 0 and report["gone"].target_share == 0 and "other" not in report
    again = {r.doc: r.uses for r in mixing.mixture(documents.repartition(3), targets).collect()}
    assert again == {r.doc: r.uses for r in chosen.collect()}
    order = mixing.shuffled(chosen).collect()
    assert len(order) == sum(again.values()) and len({(r.doc, r.copy_no) for r in order}) == len(order)


def test_given_total_reports_the_shortfall(spark):
    documents, targets = stock(spark)
    report = {r.source: r for r in mixing.shares(mixing.mixture(documents, targets, total=50_000), documents, targets).collect()}
    assert report["c"].tokens == report["c"].stock_tokens * 8 and report["c"].actual_share < report["c"].target_share


def test_empty(spark):
    documents, targets = stock(spark)
    assert mixing.mixture(documents.limit(0), targets).count() == 0 and mixing.mixture(documents, targets.limit(0)).count() == 0


def test_sized(spark):
    df = spark.createDataFrame([(1, "hello world", "a"), (1, "hello world", "a"), (2, None, "a"), (3, "", "a"), (4, "x", None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in mixing.sized(df, "doc_id", "source", "text").collect()] == [(1, "a", 2)]
