"""The three commands as functions on tables or folders: what a folder of sources holds, and how good findings are."""

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from chainloom.operators import chains, evaluation, source_text
from chainloom.sources import files


class Analysis(NamedTuple):
    """Chains with their verdict, and the endpoints and sanitizers that they were made from."""

    chains: DataFrame
    sources: DataFrame
    sinks: DataFrame
    sanitizers: DataFrame


class Evaluation(NamedTuple):
    """Findings with the label that each takes, findings without a label, and labels without a finding."""

    matched: DataFrame
    unmatched: DataFrame
    missed: DataFrame


def analyze(spark: SparkSession, folder: str, include_tests: bool = False) -> Analysis:
    """Chains of the project below a folder."""
    sources = files.project_sources(files.read_sources(spark, folder), folder, include_tests)
    return analyze_files(sources)


def analyze_files(texts: DataFrame) -> Analysis:
    """Chains of files (file, text)."""
    made = chains.chains_from_source(texts)
    sanitizers = source_text.static_sanitizers(texts).join(source_text.lines(texts), ["file", "line_number"])
    verdict = chains.rejected(made, chains.sanitizers_on(made, sanitizers))
    return Analysis(made.join(verdict, "chain_id"), source_text.static_sources(texts), source_text.static_sinks(texts), sanitizers)


def sinks(spark: SparkSession, folder: str, include_tests: bool = False) -> DataFrame:
    """Harmful calls of the project below a folder."""
    return source_text.static_sinks(files.project_sources(files.read_sources(spark, folder), folder, include_tests))


def evaluate(findings: DataFrame, labels: DataFrame) -> Evaluation:
    """Findings against labels, in the columns of operators.evaluation.match_candidates."""
    matched = evaluation.greedy_match(evaluation.match_candidates(findings, labels))
    return Evaluation(matched, findings.join(matched, "finding", "left_anti"), labels.join(matched, "label", "left_anti"))
