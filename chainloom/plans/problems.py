"""Queries of the general training-data operators over the given tables, with SQL where SQL can say it."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.operators import copy_diff, schema_drift
from chainloom.plans import reports
from chainloom.plans.catalog import quoted
from chainloom.sources.tables import table

EVAL_FIELDS = (
    {"project": copy_diff.as_text, "report": copy_diff.as_text, "file": copy_diff.as_path, "cve": copy_diff.as_text}
    | {f: copy_diff.as_count for f in ("expected_tp", "found_tp", "fp", "fn", "unclassified")}
    | {"recall": copy_diff.as_ratio(4)}
)


def _flat(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.flatten(table(spark, d, "label_records"), "suite_id", "report_id", "run_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return schema_drift.schema_changes(_flat(spark, d)).select(F.col("file_id").alias("report_id"), "field", "change", "old_field")


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    flat = _flat(spark, d)
    names = schema_drift.canonical_names(flat, schema_drift.schema_changes(flat))
    return schema_drift.canonical_table(flat, names).withColumnsRenamed({"series": "suite_id", "file_id": "report_id"})


def p5_diff(spark: SparkSession, d: str) -> DataFrame:
    return copy_diff.compare_copies(table(spark, d, "file_evals_a"), table(spark, d, "file_evals_b"), "eval_id", EVAL_FIELDS, "updated_at", "is_deleted")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_diff(spark, d).select("eval_id", "field")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return reports.items(table(spark, d, "hybrid_reports"))


def p6_schema(spark: SparkSession, d: str) -> DataFrame:
    return reports.schema(table(spark, d, "hybrid_reports"))


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    return reports.files(table(spark, d, "hybrid_reports"))


def p6_chains(spark: SparkSession, d: str) -> DataFrame:
    return reports.chains(table(spark, d, "hybrid_reports"))


def p6_path_nodes(spark: SparkSession, d: str) -> DataFrame:
    return reports.path_nodes(table(spark, d, "hybrid_reports"))


def p6_labels(spark: SparkSession, d: str) -> DataFrame:
    return reports.labels(table(spark, d, "hybrid_reports"))


def p6_fp_patterns(spark: SparkSession, d: str) -> DataFrame:
    return reports.fp_patterns(table(spark, d, "hybrid_reports"))


QUERIES = {f.__name__: f for f in (p1_found, p1_table, p5_diff, p5_found, p6_found, p6_schema, p6_files, p6_chains, p6_path_nodes, p6_labels, p6_fp_patterns)}


def _p5_sql(values: bool) -> str:
    text = "nullif(regexp_replace({0}::VARCHAR, '^\\s+|\\s+$', '', 'g'), '')"
    rules = dict.fromkeys(("project", "report", "cve"), text)
    rules["file"] = f"nullif(regexp_replace(replace({text}, chr(92), '/'), '^(\\./+)+', ''), '')"
    rules |= dict.fromkeys(("expected_tp", "found_tp", "fp", "fn", "unclassified"), f"coalesce(try_cast(ltrim({text}, '+') AS DECIMAL(38,9))::VARCHAR, {text})")
    rules["recall"] = f"coalesce(round(try_cast(ltrim({text}, '+') AS DECIMAL(38,18)), 4)::DECIMAL(38,4)::VARCHAR, {text})"
    order = list(EVAL_FIELDS)
    side = "SELECT eval_id, " + ", ".join(f"{rules[f].format(f)} AS f{i}" for i, f in enumerate(order)) + " FROM (SELECT *, row_number() OVER (PARTITION BY eval_id ORDER BY updated_at DESC NULLS LAST) AS rn FROM {0}) WHERE rn = 1 AND NOT coalesce(is_deleted, false)"
    null = ", CAST(NULL AS VARCHAR) AS left_value, CAST(NULL AS VARCHAR) AS right_value" if values else ""
    both = "a JOIN b ON a.eval_id IS NOT DISTINCT FROM b.eval_id"
    parts = [f"SELECT b.eval_id, 'missing_in_a' AS field{null} FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.eval_id IS NOT DISTINCT FROM b.eval_id)", f"SELECT a.eval_id, 'missing_in_b' AS field{null} FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.eval_id IS NOT DISTINCT FROM b.eval_id)"]
    for i, f in enumerate(order):
        own = f", a.f{i} AS left_value, b.f{i} AS right_value" if values else ""
        parts.append(f"SELECT a.eval_id, '{f}' AS field{own} FROM {both} WHERE a.f{i} IS DISTINCT FROM b.f{i}")
    return f"WITH a AS ({side.format('file_evals_a')}), b AS ({side.format('file_evals_b')}) " + " UNION ALL ".join(parts)


_TEXT = "ltrim(replace(body, chr(65279), ''))"
_LIST = "CASE WHEN json_type(({0})) = 'ARRAY' THEN ({0}) WHEN ({0}) IS NULL OR json_type(({0})) = 'NULL' THEN '[]'::JSON ELSE json_array(({0})) END"
_ENTRIES = f"""WITH once AS (SELECT report_id, max(body) AS body FROM hybrid_reports GROUP BY report_id),
parsed AS (SELECT report_id, CASE WHEN {_TEXT} LIKE '"%' THEN json_extract_string({_TEXT}::JSON, '$')::JSON ELSE {_TEXT}::JSON END AS report FROM once WHERE json_valid({_TEXT})),
files AS (SELECT report_id, CASE WHEN json_type(report, '$.files') = 'ARRAY' THEN e.value->>'$.file' ELSE e.key END AS file, CASE WHEN json_type(report, '$.files') = 'ARRAY' THEN e.key::BIGINT ELSE row_number() OVER (PARTITION BY report_id ORDER BY e.key) - 1 END AS file_no, e.value AS record FROM parsed, json_each(report, '$.files') e),
sections AS (SELECT report_id, file, section, record->section AS list FROM files, (SELECT unnest(['tp_matched', 'fp_chains', 'unclassified_chains']) AS section)),
entries AS (SELECT report_id, file, section, (n - 1)::INT AS entry_no, list[n] AS entry FROM (SELECT *, unnest(range(1, len(list) + 1)) AS n FROM (SELECT report_id, file, section, ({_LIST.format("list")})::JSON[] AS list FROM sections))),
chains AS (SELECT *, CASE WHEN json_type(entry, '$.chain') = 'OBJECT' THEN entry->'$.chain' ELSE entry END AS chain FROM entries)"""
_P6 = f"""{_ENTRIES}, items AS (
SELECT report_id, file, section, entry_no, 'path' AS item, list_transform(({_LIST.format("chain->'$.path'")})::JSON[], lambda x: CASE WHEN json_type(x) = 'OBJECT' THEN json_extract_string(x, '$.variable') ELSE json_extract_string(x, '$') END) AS vals FROM chains
UNION ALL SELECT report_id, file, section, entry_no, 'tp_id', [json_extract_string(entry, '$.tp.id')] FROM chains
UNION ALL SELECT report_id, file, section, entry_no, 'fp_reason', list_transform(({_LIST.format("entry->'$.fp_pattern'")})::JSON[], lambda x: json_extract_string(x, '$.reason')) FROM chains)
SELECT report_id, file, section, entry_no, item, (n - 1)::INT AS item_no, vals[n] AS item_value FROM (SELECT *, unnest(range(1, len(vals) + 1)) AS n FROM items) WHERE vals[n] <> ''"""

_SECTION = """(SELECT report_id, file, file_no, section, (n - 1)::INT AS entry_no, concat(report_id, '/files.', file_no) AS file_key, concat(report_id, '/files.', file_no, '/', section, '.', n - 1) AS entry_key, list[n] AS entry FROM (SELECT *, unnest(range(1, len(list) + 1)) AS n FROM (SELECT report_id, file, file_no, section, ({list})::JSON[] AS list FROM (SELECT report_id, file, file_no, section, record->section AS list FROM files, (SELECT unnest([{sections}]) AS section)))))"""
_THREE = _SECTION.format(list=_LIST.format("list"), sections="'tp_matched', 'fp_chains', 'unclassified_chains'")
_CHAIN = "CASE WHEN json_type(entry, '$.chain') = 'OBJECT' THEN entry->'$.chain' ELSE entry END"
_TEXT_OF = lambda v, *names: ", ".join(f"json_extract_string({v}, '$.{n}') AS {a}" for a, n in names)


def _below(part: str, step: str, number: str, columns: str) -> str:
    """A row for each element of a member of the entries, with the keys of its parents."""
    return f"SELECT report_id, file, section, entry_no, concat(entry_key, '/{step}.', n - 1) AS row_key, entry_key AS parent_key, (n - 1)::INT AS {number}, {columns} FROM (SELECT *, list[n] AS v FROM (SELECT *, unnest(range(1, len(list) + 1)) AS n FROM (SELECT *, ({_LIST.format(part)})::JSON[] AS list FROM {_THREE})))"


_P6_NODES = f"{_ENTRIES} " + _below(f"({_CHAIN})->'$.path'", "path", "node_no", "CASE WHEN json_type(v) = 'OBJECT' THEN json_extract_string(v, '$.variable') ELSE json_extract_string(v, '$') END AS variable, json_extract_string(v, '$.file') AS own__file, json_extract_string(v, '$.line')::BIGINT AS line")
_P6_PATTERNS = f"{_ENTRIES} " + _below("entry->'$.fp_pattern'", "fp_pattern", "pattern_no", _TEXT_OF("v", ("reason", "reason"), ("sink_var", "sink_var"), ("source_pattern", "source_pattern")))
_P6_LABELS = f"{_ENTRIES} SELECT report_id, file, entry_no, entry_key AS row_key, file_key AS parent_key, {_TEXT_OF('entry', ('id', 'id'), ('sink_var', 'sink_var'), ('source_var', 'source_var'), ('vuln_type', 'vuln_type'))}, json_extract_string(entry, '$.sink_line')::BIGINT AS sink_line, json_extract_string(entry, '$.source_line')::BIGINT AS source_line FROM {_SECTION.format(list=_LIST.format('list'), sections=quoted('fn_chains'))}"
_P6_FILES = f"{_ENTRIES} SELECT report_id, file, file_no::INT AS file_no, concat(report_id, '/files.', file_no) AS row_key, {_TEXT_OF('record', ('cve', 'cve'), ('error', 'error'))}, " + ", ".join(f"json_extract_string(record, '$.pipeline_metrics.{m}')::BIGINT AS pipeline_metrics__{m}" for m in ("graph_nodes", "sinks_found", "sources_found")) + " FROM files"

_P6_CHAINS = (
    f"{_ENTRIES} SELECT report_id, file, section, entry_no, entry_key AS row_key, file_key AS parent_key, {_TEXT_OF('chain', ('id', 'id'), ('type', 'type'), ('cwe', 'cwe'), *[(f'{e}__{m}', f'{e}.{m}') for e, m in (('sink', 'code_snippet'), ('sink', 'file'), ('sink', 'variable'), ('source', 'file'), ('source', 'variable'))])}, "
    f"{_TEXT_OF('entry', *[(f'tp__{m}', f'tp.{m}') for m in ('id', 'sink_var', 'source_var')])}, json_extract_string(chain, '$.sink.line')::BIGINT AS sink__line, json_extract_string(chain, '$.source.line')::BIGINT AS source__line, json_extract_string(entry, '$.tp.sink_line')::BIGINT AS tp__sink_line FROM (SELECT *, {_CHAIN} AS chain FROM {_THREE})"
)

SQL = {"p6_chains": _P6_CHAINS, "p6_path_nodes": _P6_NODES, "p6_fp_patterns": _P6_PATTERNS, "p6_labels": _P6_LABELS, "p6_files": _P6_FILES, "p5_found": _p5_sql(False), "p5_diff": _p5_sql(True), "p6_found": _P6}
