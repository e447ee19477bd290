"""Queries on names, snippets, functions, signatures, cases and data quality, each with the SQL that says the same."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.functions import rules
from chainloom.functions.lineage import scratch
from chainloom.operators import matching, source_text
from chainloom.plans.catalog import QUERIES, SQL, _CHAINS, _FUNCTIONS, _LINES, _NAME, _NAMES, _NO_TEXT, _UNIT, chain_rows, java_files, query, quoted
from chainloom.sources import files
from chainloom.sources.tables import table

# --- names and snippets ----------------------------------------------------------------------------------------------

_ROOT = rf"^(?:this\.)?({_NAME})(?:\.{_NAME}|\([^()]*\))*$"


def _both(x: str, name: str) -> str:
    return rf"nullif(regexp_extract(trim({x}), {quoted(_ROOT)}, 1), '') AS {name}_root, regexp_replace(trim(string_split(lower({x}), ':')[-1]), '^this\.', '') AS {name}_name"


@query(f"SELECT row_id, {_both('source.variable', 'source')}, {_both('sink.variable', 'sink')} FROM {_CHAINS}")
def canonical_names(spark, d):
    """The root of each endpoint's accessor chain (null when it is none), and its name for comparisons."""
    root = lambda c: F.nullif(F.regexp_extract(F.trim(c), _ROOT, 1), F.lit(""))
    name = lambda c: F.regexp_replace(F.trim(F.element_at(F.split(F.lower(c), ":"), -1)), r"^this\.", "")
    ends = [x for e in ("source", "sink") for x in (root(f"{e}.variable").alias(f"{e}_root"), name(f"{e}.variable").alias(f"{e}_name"))]
    return chain_rows(spark, d, "source.variable", "sink.variable").select("row_id", *ends)


_CONTROL = r"^\s*\}?\s*(?:if|else|for|while|switch|try|catch|finally|do)\b[^;]*$"
_OPERATION = rf"\bnew\s+[A-Z]|{_NAME}\s*\("
_SNIPPETS = (("none", r"^\s*$"), ("import", r"^\s*(?:import|package)\s"), ("comment", r"^\s*(?://|/\*|\*)"), ("control", _CONTROL), ("signature", source_text.FUNCTION), ("operation", _OPERATION), ("declaration", source_text.STATEMENT))


@query("SELECT row_id, CASE " + " ".join(f"WHEN regexp_matches(coalesce(sink.code_snippet, ''), {quoted(p)}) THEN {quoted(n)}" for n, p in _SNIPPETS) + f" ELSE 'other' END AS sink_text, CASE WHEN regexp_matches(coalesce(source.code_snippet, ''), {quoted(source_text.STATEMENT)}) THEN regexp_extract(source.code_snippet, {quoted(source_text.STATEMENT)}, 1) = source.variable ELSE false END AS source_declares FROM {_CHAINS}")
def snippet_kinds(spark, d):
    """What the text of a sink is (only operations can do harm), and whether that of a source sets its variable."""
    source, sink = F.coalesce("source.code_snippet", F.lit("")), F.coalesce("sink.code_snippet", F.lit(""))
    declares = F.when(source.rlike(source_text.STATEMENT), F.regexp_extract(source, source_text.STATEMENT, 1) == F.col("source.variable")).otherwise(False)
    return chain_rows(spark, d, "source.variable", "source.code_snippet", "sink.code_snippet").select("row_id", rules.first_match(sink, _SNIPPETS, F.lit("other")).alias("sink_text"), declares.alias("source_declares"))


# Type names that hold one of these carry data from outside.
_OUTSIDE = "HttpServletRequest|HttpRequest|InputStream|Reader|Scanner|BufferedReader|Socket|URLConnection|String"
_DECLARED = rf"^\s*(?:final\s+)?([A-Z][A-Za-z0-9_]*|int|long|boolean|double|float|byte|char|short)(?:<[^;=()]*>)?(?:\[\])?\s+({_NAME})\s*[=;]"


@query(f"SELECT file, variable, max_by(declared, line_number) AS declared_type, regexp_matches(max_by(declared, line_number), {quoted(_OUTSIDE)}) AS untrusted FROM (SELECT file, line_number, regexp_extract(line, {quoted(_DECLARED)}, 2) AS variable, regexp_extract(line, {quoted(_DECLARED)}, 1) AS declared FROM {_LINES} WHERE regexp_matches(line, {quoted(_DECLARED)})) GROUP BY file, variable")
def declared_types(spark, d):
    """The simple type of each variable of a file by its last declaration."""
    rows = source_text.lines(java_files(spark, d)).where(F.col("line").rlike(_DECLARED))
    rows = rows.select("file", "line_number", F.regexp_extract("line", _DECLARED, 2).alias("variable"), F.regexp_extract("line", _DECLARED, 1).alias("declared"))
    last = rows.groupBy("file", "variable").agg(F.max_by("declared", "line_number").alias("declared_type"))
    return last.withColumn("untrusted", F.col("declared_type").rlike(_OUTSIDE))


_CONDITION = r"\b(?:if|for|while)\s*\((.*?)\)\s*(?:\{|$|[A-Za-z_])"


@query(f"SELECT file, variable, count(*) AS n, min(line_number) AS line_number FROM (SELECT file, line_number, unnest({_NAMES(_NO_TEXT(f'regexp_extract(line, {quoted(_CONDITION)}, 1)'))}) AS variable FROM {_LINES} WHERE regexp_matches(line, {quoted(_CONDITION)})) GROUP BY file, variable")
def condition_loops(spark, d):
    """Control flow in a data-flow graph: each variable of a condition has an edge to itself."""
    rows = source_text.lines(java_files(spark, d)).where(F.col("line").rlike(_CONDITION))
    names = source_text.names_in(F.regexp_replace(F.regexp_extract("line", _CONDITION, 1), r'"[^"]*"', '""'))
    return rows.select("file", "line_number", F.explode(names).alias("variable")).groupBy("file", "variable").agg(F.count(F.lit(1)).alias("n"), F.min("line_number").alias("line_number"))


_INVOKED, _RETURN, _LITERAL = rf"{_NAME}\s*\(", r"^\s*return\s+(.*?);\s*$", r'"[^"]*"|\b(?:true|false|null)\b|\b[0-9][0-9.]*[lLfFdD]?\b|[-+*/%()\s!&|<>=?:]'


@query(f"""SELECT f.file, f.function_name, f.start_line, coalesce(bool_or(regexp_matches(l.line, {quoted(_INVOKED)})), false) AS calls, count(*) FILTER (WHERE regexp_matches(l.line, ';\\s*$')) AS statements, NOT coalesce(bool_or(regexp_matches(l.line, {quoted(_INVOKED)})), false) AND count(*) FILTER (WHERE regexp_matches(l.line, ';\\s*$')) <= 2 AS trivial,
coalesce(bool_and(regexp_replace(regexp_extract(l.line, {quoted(_RETURN)}, 1), {quoted(_LITERAL)}, '', 'g') = '') FILTER (WHERE regexp_matches(l.line, {quoted(_RETURN)})), false) AS constant
FROM (SELECT DISTINCT file, function_name, start_line, end_line FROM {_FUNCTIONS}) f LEFT JOIN {_LINES} l ON f.file = l.file AND l.line_number > f.start_line AND l.line_number <= f.end_line GROUP BY f.file, f.function_name, f.start_line""")
def function_traits(spark, d):
    """Functions that are trivial (no call, at most two statements) and functions that return constants only."""
    java = java_files(spark, d)
    # One join on the file; a line meets only the functions of its own file, of which there are few.
    own = source_text.functions(java).select("file", "function_name", "start_line", "end_line").distinct()
    line = F.col("line")
    facts = source_text.lines(java).select(
        "file", "line_number", line.rlike(_INVOKED).alias("call"), line.rlike(r";\s*$").alias("statement"),
        F.when(line.rlike(_RETURN), F.regexp_replace(F.regexp_extract(line, _RETURN, 1), _LITERAL, "") == "").alias("literal"),
    )
    inside = (F.col("l.file") == F.col("f.file")) & (F.col("line_number") > F.col("start_line")) & (F.col("line_number") <= F.col("end_line"))
    held = own.alias("f").join(facts.where("call or statement").alias("l"), inside, "left").groupBy("f.file", "function_name", "start_line")
    found = held.agg(F.coalesce(F.bool_or("call"), F.lit(False)).alias("calls"), F.count_if("statement").alias("statements"), F.coalesce(F.bool_and("literal"), F.lit(False)).alias("constant"))
    return found.withColumn("trivial", ~F.col("calls") & (F.col("statements") <= 2))


_FENCE = r"(?s)```(?:json)?\s*(.*?)```"


@query(f"SELECT doc_id, CASE WHEN regexp_matches(text, {quoted(_FENCE)}) THEN trim(regexp_extract(text, {quoted(_FENCE)}, 1), ' ' || chr(10)) ELSE trim(text, ' ' || chr(10)) END AS body, regexp_matches(text, {quoted(_FENCE)}) AS fenced FROM documents WHERE text LIKE '%{{%}}%' OR text LIKE '%```%'")
def json_in_text(spark, d):
    """The answer within a text: the first fenced block, else the whole text without outer blanks and line ends."""
    rows = table(spark, d, "documents").where("text like '%{%}%' or text like '%```%'")
    fenced = F.col("text").rlike(_FENCE)
    return rows.select("doc_id", F.trim(F.when(fenced, F.regexp_extract("text", _FENCE, 1)).otherwise(F.col("text")), F.lit(" \n")).alias("body"), fenced.alias("fenced"))


# --- chains ----------------------------------------------------------------------------------------------------------

_SIGNATURE = "sha256(concat_ws(chr(0), source.variable, source.file, source.line::VARCHAR, sink.variable, sink.file, sink.line::VARCHAR, array_to_string(path, chr(0))))"


@query(f"SELECT signature, count(*) AS n, min(row_id) AS row_id FROM (SELECT row_id, {_SIGNATURE} AS signature FROM {_CHAINS}) GROUP BY signature")
def chain_signatures(spark, d):
    """Chains that need be verified once: equal endpoints and paths have one signature; counted before the shuffle."""
    parts = [F.col(f"{e}.{p}").cast("string") for e in ("source", "sink") for p in ("variable", "file", "line")]
    signature = F.sha2(F.concat_ws("\0", *parts, F.array_join("path", "\0")), 256)
    return chain_rows(spark, d, "path", *[f"{e}.{p}" for e in ("source", "sink") for p in ("variable", "file", "line")]).groupBy(signature.alias("signature")).agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("row_id"))


@query(f"SELECT files, count(*) AS chains, min(row_id) AS first_row FROM (SELECT row_id, array_to_string(list_sort(list_distinct(list_filter([source.file, sink.file], lambda x: x IS NOT NULL))), '|') AS files FROM {_CHAINS}) GROUP BY files")
def file_groups(spark, d):
    """Chains by the sorted set of the files that they touch."""
    touched = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array("source.file", "sink.file")))), "|")
    return chain_rows(spark, d, "source.file", "sink.file").groupBy(touched.alias("files")).agg(F.count(F.lit(1)).alias("chains"), F.min("row_id").alias("first_row"))


@query(f"SELECT backend, count(*) AS n, count(*) FILTER (WHERE section = 'tp_matched') AS verified, count(*) FILTER (WHERE section = 'fp_chains') AS refuted, count(*) FILTER (WHERE section = 'unclassified_chains') AS open, round(count(*) FILTER (WHERE section = 'tp_matched') / count(*), 4) AS verified_rate, round(avg({_UNIT}), 6) AS mean_confidence FROM {_CHAINS} GROUP BY backend")
def verification_summary(spark, d):
    is_in = lambda s: F.count_if(F.col("section") == s)
    rows = chain_rows(spark, d, "backend", "section", "confidence").groupBy("backend")
    return rows.agg(F.count(F.lit(1)).alias("n"), is_in("tp_matched").alias("verified"), is_in("fp_chains").alias("refuted"), is_in("unclassified_chains").alias("open"), F.round(is_in("tp_matched") / F.count(F.lit(1)), 4).alias("verified_rate"), F.round(F.avg(rules.unit_confidence(F.col("confidence"))), 6).alias("mean_confidence"))


_FACTS = {
    "confidence_missing": "confidence IS NULL OR isnan(confidence)", "confidence_scale": "confidence IS NOT NULL AND NOT isnan(confidence) AND (confidence > 1 OR confidence < 0)", "cwe_missing": "coalesce(trim(cwe), '') = ''",
    "label_missing": "coalesce(trim(vulnerability_label), '') = ''", "path_missing": "path IS NULL", "sink_line_unknown": "coalesce(sink.line, 0) <= 0", "source_line_unknown": "coalesce(source.line, 0) <= 0",
}


@query(" UNION ALL ".join(f"SELECT backend, {quoted(k)} AS problem, count(*) FILTER (WHERE {c}) AS n FROM {_CHAINS} GROUP BY backend" for k, c in _FACTS.items()))
def data_quality(spark, d):
    """How many chains of each backend have each problem, in one pass."""
    counts = chain_rows(spark, d, "backend", "confidence", "cwe", "vulnerability_label", "path", "source.line", "sink.line").groupBy("backend").agg(*[F.expr(f"count_if({c})").alias(k) for k, c in _FACTS.items()])
    return counts.unpivot(["backend"], list(_FACTS), "problem", "n")


_STEM = r"([^/\\]+?)(?:\.[A-Za-z]+)?$"


@query(f"""WITH cases AS (SELECT DISTINCT regexp_extract(file, {quoted(_STEM)}, 1) AS stem FROM tp_labels WHERE file IS NOT NULL), n AS (SELECT DISTINCT row_id, regexp_extract(unnest([file, source.file, sink.file]), {quoted(_STEM)}, 1) AS stem FROM {_CHAINS}),
m AS (SELECT row_id, count(*) AS cases, min(stem) AS case_id FROM n JOIN cases USING (stem) GROUP BY row_id)
SELECT c.row_id, coalesce(m.cases, 0) AS cases, CASE WHEN m.cases IS NULL THEN 'orphan' WHEN m.cases > 1 THEN 'several' ELSE 'attributed' END AS status, CASE WHEN m.cases = 1 THEN m.case_id END AS case_id FROM {_CHAINS} c LEFT JOIN m ON c.row_id = m.row_id""")
def case_attribution(spark, d):
    """The labelled case to which a chain belongs by the stems of its files; chains of several cases break isolation."""
    stem = lambda c: F.regexp_extract(c, _STEM, 1)
    cases = table(spark, d, "tp_labels").where("file is not null").select(stem("file").alias("stem")).distinct()
    chains = chain_rows(spark, d, "file", "source.file", "sink.file").select("row_id", F.array_distinct(F.transform(F.array("file", "source.file", "sink.file"), stem)).alias("stems"))
    met = chains.select("row_id", F.explode("stems").alias("stem")).join(cases, "stem").groupBy("row_id").agg(F.count(F.lit(1)).alias("cases"), F.min("stem").alias("case_id"))
    both = chains.select("row_id").join(met, "row_id", "left")
    status = F.when(F.col("cases").isNull(), "orphan").when(F.col("cases") > 1, "several").otherwise("attributed")
    return both.select("row_id", F.coalesce("cases", F.lit(0)).alias("cases"), status.alias("status"), F.when(F.col("cases") == 1, F.col("case_id")).alias("case_id"))


# --- scores and paths ------------------------------------------------------------------------------------------------

_NEWEST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY updated_at DESC) AS rn FROM file_evals_a) WHERE rn = 1 AND NOT coalesce(is_deleted, false))"


@query(f"SELECT report, count(*) FILTER (WHERE cve <> '') AS scored, count(*) FILTER (WHERE hit) AS hits, round(coalesce(count(*) FILTER (WHERE cve <> '' AND hit) / nullif(count(*) FILTER (WHERE cve <> ''), 0), 0), 4) AS recall, count(*) FILTER (WHERE cve = '') AS unscored FROM (SELECT report, coalesce(trim(cve), '') AS cve, bool_or(coalesce(found_tp, 0) > 0) AND coalesce(trim(cve), '') <> '' AS hit FROM {_NEWEST} GROUP BY report, coalesce(trim(cve), '')) GROUP BY report")
def cve_scores(spark, d):
    """A CVE is found when any of its files has a true positive; rows without a CVE are one unscored entry."""
    rows = table(spark, d, "file_evals_a")
    newest = rows.groupBy("eval_id").agg(F.max(F.struct("updated_at", F.coalesce("is_deleted", F.lit(False)).alias("gone"), "report", "cve", "found_tp")).alias("x")).select("x.*").where("not gone")
    each = newest.groupBy("report", F.coalesce(F.trim("cve"), F.lit("")).alias("cve")).agg(F.bool_or(F.coalesce("found_tp", F.lit(0)) > 0).alias("found"))
    known, hit = F.col("cve") != "", F.col("found") & (F.col("cve") != "")
    return each.groupBy("report").agg(F.count_if(known).alias("scored"), F.count_if(hit).alias("hits"), rules.ratio(F.count_if(hit), F.count_if(known)).alias("recall"), F.count_if(~known).alias("unscored"))


_STEPS = "string_split(regexp_replace(replace(lower({0}), chr(92), '/'), '/+', '/', 'g'), '/')"
_ENDS = f"list_transform(range(1, len({_STEPS}) + 1), lambda i: array_to_string(list_slice({_STEPS}, i, len({_STEPS})), '/'))"


@query(f"""WITH k AS (SELECT known, unnest({_ENDS.format('known')}) AS suffix FROM (SELECT DISTINCT source.file AS known FROM chains WHERE source.file IS NOT NULL)), r AS (SELECT DISTINCT file AS reported FROM chains WHERE file IS NOT NULL)
SELECT reported, count(DISTINCT known) AS candidates, CASE WHEN count(DISTINCT known) = 1 THEN min(known) END AS known FROM r JOIN k ON lower(reported) = suffix GROUP BY reported""")
def unique_suffix_route(spark, d):
    """Each reported path with the one path of an endpoint that ends with it; several leave it open."""
    known = table(spark, d, "chains").select(F.col("source.file").alias("known")).where("known is not null").distinct()
    ends = known.select("known", F.explode(matching.path_suffixes(F.col("known"))).alias("suffix"))
    reported = table(spark, d, "chains").select(F.col("file").alias("reported")).where("reported is not null").distinct()
    met = reported.join(ends, F.lower("reported") == F.col("suffix")).groupBy("reported").agg(F.count(F.lit(1)).alias("candidates"), F.min("known").alias("known"))
    return met.withColumn("known", F.when(F.col("candidates") == 1, F.col("known")))


# --- written and read again ------------------------------------------------------------------------------------------


@query(SQL["cache_keys"])
def sharded_cache(spark, d):
    """The cache of texts by content, written with a folder for each shard and read back."""
    folder = scratch(spark, "sharded_cache")
    files.write_shards(QUERIES["cache_keys"](spark, d), "shard", folder)
    # Shards such as 00 or 1e5 are text; a reader that guesses types would take them for numbers.
    return spark.read.schema("doc_id long, cache_key string, shard string").parquet(folder)


@query(f"SELECT row_id, backend, source.file AS source_file, sink.line AS sink_line, coalesce(len(path), 0) AS nodes FROM {_CHAINS}")
def result_json(spark, d):
    """Chains as nested JSON lines, written and read back with their schema."""
    rows: DataFrame = chain_rows(spark, d, "backend", "source", "sink", "path").select("row_id", "backend", "source", "sink", "path")
    folder = scratch(spark, "result_json")
    files.write_json(rows, folder)
    return files.read_json(spark, folder, rows.schema).select("row_id", "backend", F.col("source.file").alias("source_file"), F.col("sink.line").alias("sink_line"), F.coalesce(F.array_size("path"), F.lit(0)).alias("nodes"))
