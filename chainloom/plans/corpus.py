"""The way from source text to verified chains, over a corpus whose calls lead from file to file, and the evaluation of
findings against labels.

The given java documents call nothing that another of them defines. The corpus is therefore derived by Spark from orders
and lineitem, so that it grows with them: a method for each order, a statement for each line item, PER_FILE methods in a
file. A statement reads a parameter, copies it, joins it with the method's own, runs it as a query, passes it to the
method of a later order, checks it, or prepares it.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.functions import registry
from chainloom.functions.lineage import stored
from chainloom.operators import chains, evaluation, regions, source_text
from chainloom.plans import reports
from chainloom.plans.catalog import QUERIES, SQL, _CHAINS, _DIV, _FLOWS, _LINES, _SINKS, _SOURCES, chain_rows, query, quoted
from chainloom.sources.tables import table

#: Methods in a file, lines of a method, and the distance of the order whose method is called.
PER_FILE, LINES, NEXT = 64, 10, 100
_LAST = PER_FILE * LINES + 2
STATEMENTS = (
    'String in{k} = request.getParameter("order");', "String mid{k} = in{k};", "String cat{k} = mid{k} + p{k};", "db.executeQuery(cat{k});",
    "helper.step{n}(cat{k});", "cat{k} = UUID.fromString(cat{k}).toString();", "stmt{k} = conn.prepareStatement(cat{k});",
)
HEAD, TAIL = "public String step{k}(String p{k}) {", "}"


def _said(template: str, key: str) -> str:
    """The SQL, the same in both dialects, of a line for an order."""
    parts = template.replace("{n}", "\0n\0").replace("{k}", "\0k\0").split("\0")
    return "concat(" + ", ".join(key if p == "k" else f"{key} + {NEXT}" if p == "n" else quoted(p) for p in parts if p) + ")"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """(file, text): the derived source files. A file has a bounded number of lines, so each is put together whole.

    What stands on a line follows from the file and the line's number, so only numbers are shuffled, each line once."""
    at = lambda key, i: (F.pmod(F.col(key), F.lit(PER_FILE)) * LINES + 2 + i).cast("int").alias("at")
    of = lambda key: F.floor(F.col(key) / PER_FILE).alias("file")
    orders, items = table(spark, d, "orders"), table(spark, d, "lineitem")
    rows = orders.select(of("o_orderkey"), F.explode(F.array(at("o_orderkey", F.lit(0)), at("o_orderkey", F.lit(LINES - 2)))).alias("at"))
    rows = rows.unionByName(items.where(f"l_linenumber between 1 and {len(STATEMENTS)}").select(of("l_orderkey"), at("l_orderkey", F.col("l_linenumber"))))
    held = rows.groupBy("file").agg(F.sort_array(F.collect_set("at")).alias("held"))
    key = f"(file * {PER_FILE} + (n - 2) div {LINES})"
    said = f"CASE (n - 2) % {LINES} WHEN 0 THEN {_said(HEAD, key)} WHEN {LINES - 2} THEN '{TAIL}' " + " ".join(f"WHEN {i} THEN {_said(s, key)}" for i, s in enumerate(STATEMENTS, 1)) + " END"
    # Each line brings the line ends between it and the one before.
    body = F.expr(f"transform(held, (n, i) -> concat(repeat(char(10), n - IF(i = 0, 1, held[i - 1])), {said}))")
    end = F.repeat(F.lit("\n"), F.lit(_LAST) - F.try_element_at("held", F.lit(-1)))
    return held.select("file", F.concat(F.lit("class F"), F.col("file"), F.lit(" {"), F.array_join(body, ""), end, F.lit("}")).alias("text"))


_AT = lambda key, i: f"(({key} % {PER_FILE}) * {LINES} + 2 + {i})::INT"
_HELD = (
    f"SELECT o_orderkey // {PER_FILE} AS file, {_AT('o_orderkey', 0)} AS line_number, {_said(HEAD, 'o_orderkey')} AS line FROM orders UNION SELECT o_orderkey // {PER_FILE}, {_AT('o_orderkey', LINES - 2)}, '}}' FROM orders "
    f"UNION SELECT l_orderkey // {PER_FILE}, {_AT('l_orderkey', 'l_linenumber')}, CASE l_linenumber " + " ".join(f"WHEN {i} THEN {_said(s, 'l_orderkey')}" for i, s in enumerate(STATEMENTS, 1)) + f" END FROM lineitem WHERE l_linenumber BETWEEN 1 AND {len(STATEMENTS)}"
)
_WITH = f"corpus_held AS MATERIALIZED ({_HELD}), corpus_lines AS MATERIALIZED (SELECT f.file, CASE WHEN i = 1 THEN concat('class F', f.file, ' {{') WHEN i = {_LAST} THEN '}}' ELSE coalesce(line, '') END AS line, i::INT AS line_number FROM (SELECT DISTINCT file FROM corpus_held) f CROSS JOIN range(1, {_LAST + 1}) r(i) LEFT JOIN corpus_held h ON h.file = f.file AND h.line_number = i)"


def _on_corpus(sql: str) -> str:
    return sql.replace(_LINES, "corpus_lines")


def _corpus_sql(name: str) -> str:
    return f"WITH {_WITH} {_on_corpus(SQL[name])}"


@query(_corpus_sql("function_records"))
def corpus_functions(spark, d):
    return source_text.functions(corpus(spark, d))


@query(_corpus_sql("static_sanitizers"))
def corpus_sanitizers(spark, d):
    return source_text.static_sanitizers(corpus(spark, d))


@query(_corpus_sql("owned_calls"))
def corpus_owned_calls(spark, d):
    return source_text.owned_calls(corpus(spark, d)).drop("parameters")


@query(_corpus_sql("call_bridges"))
def corpus_call_bridges(spark, d):
    return source_text.call_bridges(corpus(spark, d))


_EDGES = f"SELECT concat(file, ':', from_var) AS src, concat(file, ':', to_var) AS dst FROM {_on_corpus(_FLOWS)} WHERE from_var <> to_var UNION SELECT concat(file, ':', argument), concat(owner, ':', parameter) FROM ({_on_corpus(SQL['call_bridges'])})"
_KEY = "sha256(concat_ws(chr(0), source_file::VARCHAR, source_line::VARCHAR, sink_file::VARCHAR, sink_line::VARCHAR, array_to_string(path, chr(0))))"
_MADE = f"""WITH RECURSIVE {_WITH}, e AS MATERIALIZED ({_EDGES}),
so AS MATERIALIZED (SELECT concat(file, ':', variable) AS node, file, variable, min(line_number) AS line, min_by(confidence, line_number) AS confidence FROM {_on_corpus(_SOURCES)} GROUP BY file, variable),
si AS MATERIALIZED (SELECT concat(file, ':', variable) AS node, file, variable, min(line_number) AS line, min_by(vuln_type, line_number) AS vuln_type, min_by(confidence, line_number) AS confidence FROM {_on_corpus(_SINKS)} GROUP BY file, variable),
p(start, node, path) AS (SELECT node, node, [node] FROM so UNION ALL SELECT p.start, e.dst, list_append(p.path, e.dst) FROM p JOIN e ON p.node = e.src WHERE len(p.path) < {chains.MAX_NODES} AND NOT list_contains(p.path, e.dst)),
best AS (SELECT start, node, path FROM (SELECT *, row_number() OVER (PARTITION BY start, node ORDER BY len(path), path) AS rn FROM p WHERE len(path) > 1 AND node IN (SELECT node FROM si)) WHERE rn = 1),
rec AS (SELECT so.file AS source_file, so.variable AS source_variable, so.line AS source_line, si.file AS sink_file, si.variable AS sink_variable, si.line AS sink_line, si.vuln_type, round((so.confidence + si.confidence) / 2, 6) AS confidence, path FROM best JOIN so ON so.node = start JOIN si ON si.node = best.node),
made AS MATERIALIZED (SELECT concat(source_variable, '_to_', sink_variable, '_', substr({_KEY}, 1, 20)) AS chain_id, * FROM rec)"""


@query(f"{_MADE} SELECT * FROM made")
def corpus_chains(spark, d):
    """Flows, bridges, endpoints, paths of at most 15 nodes and chain records, from text alone."""
    return chains.chains_from_source(corpus(spark, d))


@query(f"{_MADE} SELECT kind, n FROM (SELECT source_file = sink_file AS same, count(*) AS n FROM made GROUP BY 1) t, (SELECT unnest([true, false]) AS s, unnest(['inside', 'across']) AS kind) k WHERE t.same = k.s")
def corpus_chain_reach(spark, d):
    """How many chains stay in one file and how many lead to another."""
    inside = F.when(F.col("source_file") == F.col("sink_file"), "inside").otherwise("across")
    return chains.chain_ends(corpus(spark, d)).groupBy(inside.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


def _chains_and_sanitizers(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chains, and sanitizers with their lines, of a corpus that is stored; chains are read more than once."""
    made = stored(chains.chains_of(chains.flow_edges(files), *chains.both_ends(files)))
    return made, source_text.static_sanitizers(files).join(source_text.lines(files), ["file", "line_number"])


_SAN = f"s AS MATERIALIZED (SELECT x.*, l.line FROM ({_on_corpus(SQL['static_sanitizers'])}) x JOIN corpus_lines l ON x.file = l.file AND x.line_number = l.line_number)"
_NAMES = "list_concat([source_variable, sink_variable], list_transform(path, lambda x: string_split(x, ':')[-1]))"
_LOW, _HIGH = "least(source_line, sink_line)", f"greatest(source_line, sink_line) + {chains.BEHIND}"
_BY_FILE = f"""SELECT DISTINCT chain_id, s.line_number, sanitizer, effectiveness FROM (SELECT *, unnest(list_distinct([source_file, sink_file])) AS at_file FROM made) c JOIN s ON s.file = c.at_file
WHERE CASE WHEN source_file = sink_file THEN s.line_number BETWEEN {_LOW} AND {_HIGH} WHEN s.file = source_file THEN s.line_number >= source_line ELSE s.line_number <= sink_line + {chains.BEHIND} END AND list_contains({_NAMES}, s.variable) AND list_contains(string_split(protects, ','), vuln_type)"""


@query(f"{_MADE}, {_SAN} {_BY_FILE}")
def corpus_chain_sanitizers(spark, d):
    """Sanitizers on the way of chains in the form of weighted search."""
    files = stored(corpus(spark, d))
    rows = regions.held(files, chains.MAX_NODES)
    return chains.sanitizers_on(*_chains_and_sanitizers(files)) if rows is None else chains.sanitizers_in(rows)


_STRONG = f"effectiveness >= {chains.REJECTS}"


@query(f"""{_MADE}, {_SAN} SELECT DISTINCT chain_id, s.line_number, sanitizer, effectiveness FROM made c JOIN s ON s.file = c.source_file
WHERE (s.line_number BETWEEN {_LOW} AND {_HIGH} OR ({_STRONG} AND length(source_variable) > 1 AND contains(line, source_variable))) AND (list_contains(string_split(protects, ','), vuln_type) OR ({_STRONG} AND len(list_filter({_NAMES}, lambda x: length(x) > 1 AND contains(line, x))) > 0))""")
def corpus_chain_sanitizers_bfs(spark, d):
    """Sanitizers on the way of chains in the form of breadth-first search."""
    return chains.sanitizers_on(*_chains_and_sanitizers(stored(corpus(spark, d))), by_file=False)


@query(f"""{_MADE}, {_SAN}, found AS ({_BY_FILE}) SELECT c.chain_id, coalesce(n, 0) AS sanitizers, coalesce(best, 0.0)::DOUBLE AS effectiveness, CASE WHEN best >= {chains.REJECTS} THEN false END AS verified
FROM made c LEFT JOIN (SELECT chain_id, count(*) AS n, max(effectiveness) AS best FROM found GROUP BY chain_id) f ON c.chain_id = f.chain_id""")
def corpus_rejects(spark, d):
    """The first step of verification: chains that a strong sanitizer rejects."""
    files = stored(corpus(spark, d))
    rows = regions.held(files, chains.MAX_NODES)
    if rows is not None:
        return chains.rejected_in(rows)
    made, sanitizers = _chains_and_sanitizers(files)
    return chains.rejected(made, chains.sanitizers_on(made, sanitizers))


# --- evaluation ------------------------------------------------------------------------------------------------------

_LABELS = "(SELECT DISTINCT ON (label_key) * FROM tp_labels ORDER BY label_key)"
_NAME_OF = lambda x: f"regexp_replace(string_split(lower(trim({x})), ':')[-1], '^this\\.', '')"
_PATH_OF = lambda x: f"lower(replace(coalesce(trim({x}), ''), chr(92), '/'))"
_FITS = lambda r, e: f"({_PATH_OF(e)} = '' OR {_PATH_OF(r)} = {_PATH_OF(e)} OR ends_with({_PATH_OF(r)}, '/' || {_PATH_OF(e)}))"
_CLOSE = lambda r, e: f"(coalesce({e}, 0) = 0 OR (coalesce({r}, 0) > 0 AND abs({r} - {e}) <= {evaluation.TOLERANCE}))"
_OFF = lambda r, e: f"CASE WHEN coalesce({r}, 0) <> 0 AND coalesce({e}, 0) <> 0 THEN abs({r} - {e}) ELSE 0 END"
_FINDINGS = "(SELECT DISTINCT ON (finding_key) finding_key AS finding, project_name AS project, source_name AS sv, file_path AS sf, source_at AS sl, sink_name AS kv, file_path AS kf, sink_at AS kl, weakness AS vuln_type FROM scan_findings ORDER BY finding_key)"


def findings(spark, d) -> DataFrame:
    """The findings of the other scanner, which names one file for both ends."""
    own = ("project_name", "file_path", "source_name", "source_at", "sink_name", "sink_at", "weakness")
    rows = table(spark, d, "scan_findings").groupBy(F.col("finding_key").alias("finding")).agg(F.min(F.struct(*own)).alias("x")).select("finding", "x.*")
    side = lambda e: [F.col(f"{e}_name").alias(f"{e}_var"), F.col("file_path").alias(f"{e}_file"), F.col(f"{e}_at").alias(f"{e}_line"), F.lit(None).cast("string").alias(f"{e}_text")]
    return rows.select("finding", F.col("project_name").alias("project"), F.col("weakness").alias("vuln_type"), *side("source"), *side("sink"))


def labels(spark, d) -> DataFrame:
    own = ("project", "source_var", "source_file", "source_line", "sink_var", "sink_file", "sink_line", "vuln_type")
    return table(spark, d, "tp_labels").groupBy(F.col("label_key").alias("label")).agg(F.min(F.struct(*own)).alias("x")).select("label", "x.*")


@query(f"""SELECT finding, label_key AS label, 110 - {_OFF('sl', 'source_line')} - {_OFF('kl', 'sink_line')} AS score FROM {_FINDINGS} f JOIN {_LABELS} l ON f.project = l.project AND {_NAME_OF('sv')} = {_NAME_OF('source_var')} AND {_NAME_OF('kv')} = {_NAME_OF('sink_var')}
WHERE {_CLOSE('sl', 'source_line')} AND {_CLOSE('kl', 'sink_line')} AND (coalesce(trim(l.vuln_type), '') = '' OR lower(trim(coalesce(f.vuln_type, ''))) = lower(trim(l.vuln_type))) AND {_FITS('sf', 'source_file')} AND {_FITS('kf', 'sink_file')}""")
def label_candidates(spark, d):
    """Findings and labels that agree by names, kind, files and lines, with their score."""
    return evaluation.match_candidates(findings(spark, d), labels(spark, d))


@query()
def greedy_labels(spark, d):
    """Each finding in order with the best label that is still free; checked against a loop in the tests."""
    return evaluation.greedy_match(label_candidates(spark, d))


@query()
def classified_findings(spark, d):
    """Each finding as true (with its label), false (with the pattern of its file), or neither; labels without a finding
    are missed ones. Patterns are those of the reports."""
    own = findings(spark, d)
    matched = evaluation.greedy_match(label_candidates(spark, d)).select("finding", "label")
    raw = reports.fp_patterns(table(spark, d, "hybrid_reports"))
    part = lambda c: F.nullif(F.col(c), F.lit("")) if c in raw.columns else F.lit(None).cast("string")
    patterns = raw.select(F.col("row_key").alias("pattern"), "file", part("source_var").alias("source_var"), part("sink_var").alias("sink_var"), part("source_pattern").alias("source_pattern"), part("sink_pattern").alias("sink_pattern"))
    left = own.join(matched, "finding", "left_anti").withColumn("file", F.col("source_file"))
    false = evaluation.first_pattern(left, patterns)
    rows = own.select("finding").join(matched, "finding", "left").join(false, "finding", "left")
    kind = F.when(F.col("label").isNotNull(), "true").when(F.col("pattern").isNotNull(), "false").otherwise("open")
    missed = labels(spark, d).join(matched, "label", "left_anti").select(F.lit(None).cast("long").alias("finding"), "label", F.lit(None).cast("string").alias("pattern"), F.lit("missed").alias("kind"))
    return rows.select("finding", "label", "pattern", kind.alias("kind")).unionByName(missed)


_CASES = f"""(SELECT c.vuln_type, c.vulnerable, f.project IS NOT NULL AS detected FROM (SELECT project, file, vuln_type, bool_or(coalesce(expected_realistic, true)) AS vulnerable FROM {_LABELS} WHERE project IS NOT NULL AND file IS NOT NULL AND vuln_type IS NOT NULL GROUP BY project, file, vuln_type) c LEFT JOIN (SELECT DISTINCT project, file, vuln_type FROM chains) f ON c.project = f.project AND c.file = f.file AND c.vuln_type = f.vuln_type)"""


@query(f"""WITH n AS (SELECT vuln_type, count(*) FILTER (WHERE detected AND vulnerable) AS tp, count(*) FILTER (WHERE detected AND NOT vulnerable) AS fp, count(*) FILTER (WHERE NOT detected AND vulnerable) AS fn, count(*) FILTER (WHERE NOT detected AND NOT vulnerable) AS tn FROM {_CASES} GROUP BY ROLLUP (vuln_type))
SELECT *, {_DIV('tp', 'tp + fp')} AS precision, {_DIV('tp', 'tp + fn')} AS recall, {_DIV('tn', 'tn + fp')} AS specificity, {_DIV('tp + tn', 'tp + fp + fn + tn')} AS accuracy, {_DIV('2 * tp', '2 * tp + fp + fn')} AS f1, round(coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) - coalesce(fp::DOUBLE / nullif(fp + tn, 0), 0), 4) AS youden FROM n""")
def confusion_full(spark, d):
    """One prediction for each case (project, file, kind); labels that are no realistic finding are the negatives."""
    key = ["project", "file", "vuln_type"]
    cases = table(spark, d, "tp_labels").groupBy("label_key").agg(F.min(F.struct(*key, "expected_realistic")).alias("x")).select("x.*").dropna(subset=key)
    cases = cases.groupBy(*key).agg(F.bool_or(F.coalesce("expected_realistic", F.lit(True))).alias("vulnerable"))
    found = table(spark, d, "chains").select(*key).distinct().withColumn("detected", F.lit(True))
    return evaluation.confusion(cases.join(found, key, "left").select("vuln_type", "vulnerable", F.coalesce("detected", F.lit(False)).alias("detected")), "vuln_type")


@query(f"WITH n AS (SELECT vuln_type, count(*) FILTER (WHERE detected AND vulnerable)::DOUBLE AS tp, count(*) FILTER (WHERE detected AND NOT vulnerable)::DOUBLE AS fp, count(*) FILTER (WHERE vulnerable)::DOUBLE AS p, count(*) FILTER (WHERE NOT vulnerable)::DOUBLE AS q FROM {_CASES} GROUP BY vuln_type), r AS (SELECT *, coalesce(tp / nullif(p, 0), 0) AS tpr, coalesce(fp / nullif(q, 0), 0) AS fpr FROM n), m AS (SELECT coalesce(sum(tp) / nullif(sum(p), 0), 0) AS tpr, coalesce(sum(fp) / nullif(sum(q), 0), 0) AS fpr FROM n) SELECT round(avg(r.tpr), 4) AS macro_tpr, round(avg(r.fpr), 4) AS macro_fpr, round(avg(r.tpr - r.fpr), 4) AS macro_youden, round(any_value(m.tpr), 4) AS micro_tpr, round(any_value(m.fpr), 4) AS micro_fpr, round(any_value(m.tpr) - any_value(m.fpr), 4) AS micro_youden FROM r, m")
def confusion_scores(spark, d):
    """Means of the unrounded rates of kinds, and the rates of the sums."""
    n = confusion_full(spark, d)
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tpr, fpr = rate(F.col("tp"), F.col("tp") + F.col("fn")), rate(F.col("fp"), F.col("fp") + F.col("tn"))
    macro = n.where("vuln_type is not null").agg(F.round(F.avg(tpr), 4).alias("macro_tpr"), F.round(F.avg(fpr), 4).alias("macro_fpr"), F.round(F.avg(tpr - fpr), 4).alias("macro_youden"))
    return macro.crossJoin(n.where("vuln_type is null").select(F.round(tpr, 4).alias("micro_tpr"), F.round(fpr, 4).alias("micro_fpr"), F.round(tpr - fpr, 4).alias("micro_youden")))


@query(f"SELECT row_id, {{unit}} AS unit, {{number}} AS number, {{name}} AS name FROM {_CHAINS}".replace("{unit}", "CASE WHEN confidence IS NULL OR isnan(confidence) THEN NULL WHEN confidence > 1 THEN least(confidence / 100, 1.0) ELSE greatest(confidence, 0.0) END").replace("{number}", "'CWE-' || nullif(regexp_extract(trim(cwe), '^(?:[Cc][Ww][Ee][-_ ]?)?0*([0-9]+)$', 1), '')").replace("{name}", _NAME_OF("source.variable")))
def sql_functions(spark, d):
    """The functions that a session's SQL has after registry.register."""
    registry.register(spark)
    chain_rows(spark, d, "confidence", "cwe", "source.variable").createOrReplaceTempView("chainloom_chains")
    return spark.sql("SELECT row_id, chainloom_unit_confidence(confidence) AS unit, chainloom_weakness_number(cwe) AS number, chainloom_canonical_name(source.variable) AS name FROM chainloom_chains")
