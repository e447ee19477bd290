from chainloom.plans import catalog


def chains(spark, folder, *rows):
    df = spark.createDataFrame(list(rows), "project string, path array<string>, backend string, section string")
    df.coalesce(1).write.parquet(str(folder / "chains.parquet"))
    return str(folder)


def line(first, last):
    return [f"n{i:02}" for i in range(first, last + 1)]


def brute(rows, bound):
    """{(source, node): hops} over the chains of rows."""
    edges = {(f"{p}:{a}", f"{p}:{b}") for p, path, _, _ in rows for a, b in zip(path, path[1:])}
    out = {}
    for p, path, _, section in rows:
        if section == "tp_matched":
            start = f"{p}:{path[0]}"
            seen, level = {start: 0}, {start}
            for depth in range(1, bound + 1):
                level = {b for a, b in edges if a in level} - set(seen)
                seen |= dict.fromkeys(level, depth)
            out |= {(start, n): h for n, h in seen.items()}
    return out


def test_bound_is_the_references(spark, tmp_path):
    # n00 to n20 in a line; sinks are n14 (15 nodes), n15 (15 hops, 16 nodes) and n16 (too far).
    rows = [("p", line(0, 14), "static", "tp_matched"), ("p", line(14, 15), "static", "tp_matched"), ("p", line(15, 16), "static", "tp_matched"), ("p", line(16, 20), "static", "fp_chains"), ("p", ["n03", "n05"], "static", "fp_chains"), ("q", line(0, 20), "static", "fp_chains")]
    d, want = chains(spark, tmp_path, *rows), brute(rows, 15)
    sinks = {"p:n14", "p:n15", "p:n16"}
    assert {(r.start, r.node): r.hops for r in catalog.graph_full_reach(spark, d).collect()} == want and max(want.values()) == 15
    assert {(r.source, r.sink): r.hops for r in catalog.graph_full_pairs(spark, d).collect()} == {k: h for k, h in want.items() if k[1] in sinks}
    paths = {(r.source, r.sink): r.path for r in catalog.graph_full_paths(spark, d).collect()}
    assert {k: len(v) for k, v in paths.items()} == {k: h + 1 for k, h in want.items() if k[1] in sinks and h < 15}
    assert max(map(len, paths.values())) == 15 and paths["p:n00", "p:n14"][3:5] == ["p:n03", "p:n05"]
    reached = {n for _, n in want}
    assert {r.node for r in catalog.graph_full_slice(spark, d).collect()} == {n for n in reached if n <= "p:n16"}
    assert {(r.src, r.dst) for r in catalog.graph_full_induced(spark, d).collect()} == {(f"p:{a}", f"p:{b}") for a, b in [*zip(line(0, 20), line(1, 20)), ("n03", "n05")] if {f"p:{a}", f"p:{b}"} <= reached}


def test_all_backends(spark, tmp_path):
    d = chains(spark, tmp_path, ("p", ["a", "b"], "static", "tp_matched"), ("p", ["b", "c"], "hybrid", "tp_matched"), ("p", ["d", "c"], "llm", "unclassified_chains"), (None, ["a", "c"], "llm", "tp_matched"), ("p", None, "llm", "tp_matched"))
    assert {tuple(r) for r in catalog.graph_full_edges(spark, d).collect()} == {("p:a", "p:b"), ("p:b", "p:c"), ("p:d", "p:c")}
    assert {tuple(r) for r in catalog.graph_full_nodes(spark, d).collect()} == {("p:a", "source"), ("p:b", "sink"), ("p:c", "sink"), ("p:d", "variable")}
    assert {tuple(r) for r in catalog.graph_full_components(spark, d).collect()} == {(f"p:{x}", "p:a") for x in "abcd"}
    assert {(r.source, r.sink): r.hops for r in catalog.graph_full_pairs(spark, d).collect()} == {("p:a", "p:b"): 1, ("p:a", "p:c"): 2, ("p:b", "p:b"): 0, ("p:b", "p:c"): 1}
