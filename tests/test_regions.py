import random

import pytest

from chainloom.operators import chains, regions, source_text
from chainloom.plans import corpus as corpus_plans
from chainloom.plans import scopes as scope_plans


@pytest.fixture
def folder(spark, tmp_path):
    """40 files whose calls lead to the next two files, with repeated orders and gaps."""
    rng = random.Random(5)
    orders = [k for k in range(40 * 64) if k % 17]
    items = [(k, i) for k in orders for i in range(1, 8) if rng.random() < 0.4]
    spark.createDataFrame([(k,) for k in [*orders, *orders[:9]]], "o_orderkey long").coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([*items, *items[:50]], "l_orderkey long, l_linenumber int").coalesce(1).write.parquet(str(tmp_path / "lineitem.parquet"))
    return str(tmp_path)


def test_queries_make_no_chain_by_joins(spark, folder, monkeypatch):
    monkeypatch.setattr(regions, "FEW", 10)
    monkeypatch.setattr(regions, "COPIES", 50)
    monkeypatch.setattr(chains.graph, "walked_paths", None)
    found = {tuple(r) for r in corpus_plans.corpus_chain_sanitizers(spark, folder).collect()}
    rejects, n = corpus_plans.corpus_rejects(spark, folder).collect(), {r.metric: r.n for r in scope_plans.corpus_metrics(spark, folder).collect()}
    assert n["chains"] == len(rejects) == len({r.chain_id for r in rejects}) > 1000 and n["rejected"] == sum(r.verified is False for r in rejects) > 500
    assert sum(r.sanitizers for r in rejects) == len(found) and {r.chain_id for r in rejects if r.sanitizers} == {x[0] for x in found}
    assert set(n) == {"sources", "sinks", "sanitizers", "edges", "chains", "rejected"} and "uuid_validation" in {x[2] for x in found}


def odd(rng, f):
    """A file whose calls lead to any file, with all kinds of sanitizers, names of several files and lines of several rules."""
    lines = [f"class C{f} {{"]
    for i in range(3):
        lines += [f"public String go{f}x{i}(String pa{i}) {{", f'String in{i} = request.getParameter("x");', f"String both{i} = in{i} + pa{rng.randrange(3)};"]
        lines += rng.sample([f"helper.go{rng.randrange(30)}x{rng.randrange(3)}(both{i});", f"db.executeQuery(both{i}, pa{i});", f"out.println(in{i});", f"both{i} = UUID.fromString(both{i}).toString();", f"in{i} = HtmlUtils.htmlEscape(in{i});", f"pa{i} = HtmlUtils.htmlEscapeHex(both{i}) + HtmlUtils.htmlEscape(in{i});", f"log.write(pa{i});", f'shared = both{i}.matches("a");'], 5) + ["}"]
    return "\n".join([*lines, "}"])


@pytest.mark.parametrize("nodes", (3, 15))
def test_any_files(spark, nodes, monkeypatch):
    rng = random.Random(nodes)
    names = [f"{chr(97 + f % 7)}/{f}:é" for f in range(30)]
    files = spark.createDataFrame([*[(n, odd(rng, f)) for f, n in enumerate(names)], ("z", None), ("zz", "")], "file string, text string")
    monkeypatch.setattr(chains, "MAX_NODES", nodes)
    made = chains.chains_from_source(files, nodes)
    found = chains.sanitizers_on(made, source_text.static_sanitizers(files).join(source_text.lines(files), ["file", "line_number"]))
    monkeypatch.setattr(regions, "FEW", 6)
    monkeypatch.setattr(regions, "COPIES", 50)
    rows = regions.held(files, nodes)
    assert sorted(map(tuple, chains.sanitizers_in(rows).collect())) == sorted(map(tuple, found.collect())) and found.count() > 3
    assert sorted(map(str, chains.rejected_in(rows).collect())) == sorted(map(str, chains.rejected(made, found).collect()))
    n = {r.metric: r.n for r in chains.counts_in(rows).collect()}
    assert (n["edges"], n["chains"]) == (chains.flow_edges(files).count(), made.count())
    monkeypatch.setattr(regions, "COPIES", 0)
    assert regions.held(files, nodes) is None


def test_calls_are_read_once(spark):
    files = spark.createDataFrame([("a", 'db.exec(one, two);\none.exec(one);\nx.y("t");\ndb.z(one);')], "file string, text string")
    got = {tuple(r) for r in source_text.call_ends(files).collect()}
    assert got == {("a", r.line_number, r.from_var, r.to_var, None) for r in source_text.argument_flows(files).collect()} | {("a", r.line_number, r.variable, None, r.vuln_type) for r in source_text.static_sinks(files).collect()}
