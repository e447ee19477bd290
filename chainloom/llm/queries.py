"""Queries of the language-model operators over the given tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chainloom.llm import canonical, encoding, entities, mixing, near_copies, spans
from chainloom.functions.lineage import cut
from chainloom.sources.tables import table


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct label with the entry that it means; labels that mean none have entry 0."""
    chains, catalog = table(spark, d, "chains").where("backend = 'hybrid'"), table(spark, d, "vuln_catalog")
    labels = chains.select(F.col("vulnerability_label").alias("label")).where("label <> ''").distinct()
    found = canonical.match_values(labels, "label", catalog, "entry_id", "label", "aliases").withColumnRenamed("value", "label")
    return labels.join(found, "label", "left").select("label", F.coalesce("entry", F.lit(0)).alias("entry_id"), "name", "covered")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    chains, catalog = table(spark, d, "chains").where("backend = 'hybrid'"), table(spark, d, "vuln_catalog")
    entered = chains.select("row_id", F.col("vulnerability_label").alias("label"), "cwe").where("label <> '' or cwe <> ''")
    rows = entered.groupBy("row_id").agg(F.max(F.struct("label", "cwe")).alias("x")).select("row_id", "x.label", "x.cwe")
    found = canonical.match_values(rows.where("label <> ''").select("label").distinct(), "label", catalog, "entry_id", "label", "aliases")
    codes = catalog.select(canonical.number_in(F.col("cwe")).alias("number"), F.col("entry_id").alias("by_number")).where("number is not null").groupBy("number").agg(F.min("by_number").alias("by_number"))
    matched = rows.join(found.select(F.col("value").alias("label"), F.col("entry").alias("by_label")), "label", "left").withColumn("number", canonical.number_in(F.col("cwe"))).join(codes, "number", "left")
    return matched.select("row_id", F.coalesce("by_label", "by_number", F.lit(0)).alias("entry_id"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    labels = entities.prepared(table(spark, d, "tp_labels"), "label_key", *map(F.col, ("project", "file", "source_var", "sink_var", "source_line", "sink_line")))
    named = lambda name, end: F.coalesce(F.nullif(F.trim(name), F.lit("")), F.try_element_at("path", F.lit(end)))
    findings = entities.prepared(table(spark, d, "scan_findings"), "finding_key", F.col("project_name"), F.col("file_path"), named("source_name", 1), named("sink_name", -1), F.col("source_at"), F.col("sink_at"))
    return entities.match_records(labels, findings).select(F.col("a_id").alias("label_key"), F.col("b_id").alias("finding_key"), "confidence")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_pairs(spark, d).select("label_key", "finding_key")


def _long_paths(spark: SparkSession, d: str) -> DataFrame:
    chains = table(spark, d, "chains")
    wanted = ((F.col("backend") == "hybrid") & (F.col("section") == "tp_matched")) | ((F.col("backend") == "llm") & (F.col("section") == "unclassified_chains"))
    return chains.where(wanted & (F.size("path") >= 6)).select("row_id", F.lower(F.array_join("path", " ")).alias("joined"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.similar_pairs(_long_paths(spark, d), "row_id", "joined").select(F.col("id_a").alias("row_id_a"), F.col("id_b").alias("row_id_b"))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_copies.similar_groups(_long_paths(spark, d), "row_id", "joined")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"), "doc_id", "text")


def _sized(spark: SparkSession, d: str) -> DataFrame:
    return cut(mixing.sized(table(spark, d, "documents"), "doc_id", "source", "text"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(_sized(spark, d), table(spark, d, "mix_targets")).withColumnRenamed("doc", "doc_id")


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    documents, targets = _sized(spark, d), table(spark, d, "mix_targets")
    return mixing.shares(cut(mixing.mixture(documents, targets)), documents, targets)


def p8_order(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shuffled(mixing.mixture(_sized(spark, d), table(spark, d, "mix_targets"))).withColumnRenamed("doc", "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_spans(table(spark, d, "documents"), "doc_id", "text")


def p9_shared(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return spans.shared_share(documents, "doc_id", "text", spans.shared_spans(documents, "doc_id", "text"))


QUERIES = {f.__name__: f for f in (p2_found, p2_matches, p3_found, p3_pairs, p4_found, p4_groups, p7_ids, p8_mix, p8_shares, p8_order, p9_found, p9_shared)}
_GRAMS = "(SELECT row_id, list_distinct(list_transform(range(1, length(joined) - 1), lambda i: substr(joined, i, 3))) AS grams FROM (SELECT DISTINCT ON (row_id) row_id, lower(array_to_string(path, ' ')) AS joined FROM chains WHERE len(path) >= 6 AND ((backend = 'hybrid' AND section = 'tp_matched') OR (backend = 'llm' AND section = 'unclassified_chains')) ORDER BY row_id, joined))"
SQL: dict[str, str] = {
    "p4_found": f"WITH t AS MATERIALIZED {_GRAMS} SELECT row_id_a, row_id_b FROM (SELECT a.row_id AS row_id_a, b.row_id AS row_id_b, len(a.grams) + len(b.grams) AS total, len(list_intersect(a.grams, b.grams)) AS shared FROM t a JOIN t b ON a.row_id < b.row_id AND len(a.grams) >= 0.7 * len(b.grams) AND len(b.grams) >= 0.7 * len(a.grams)) WHERE shared >= 0.7 * (total - shared)",
}
