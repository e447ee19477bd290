"""Functions for a session's own SQL. They are SQL functions, so the optimizer sees through them and no Python runs."""

from pyspark.sql import SparkSession

#: Name, parameters, type and body of each function.
FUNCTIONS = (
    ("chainloom_unit_confidence", "c DOUBLE", "DOUBLE", "CASE WHEN c IS NULL OR isnan(c) THEN NULL WHEN c > 1 THEN least(c / 100, 1.0D) ELSE greatest(c, 0.0D) END"),
    ("chainloom_weakness_number", "code STRING", "STRING", r"concat('CWE-', nullif(regexp_extract(trim(code), '^(?:[Cc][Ww][Ee][-_ ]?)?0*([0-9]+)$', 1), ''))"),
    ("chainloom_canonical_name", "name STRING", "STRING", r"regexp_replace(element_at(split(lower(trim(name)), ':'), -1), r'^this\.', '')"),
    ("chainloom_line_close", "reported INT, expected INT", "BOOLEAN", "coalesce(expected, 0) = 0 OR (coalesce(reported, 0) > 0 AND abs(reported - expected) <= 5)"),
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; returns their names. Creating them again replaces them."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
