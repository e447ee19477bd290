"""Findings against labelled truth: greedy one-to-one match, false-positive patterns, confusion matrices.

Findings take labels in their order, each the best label that is still free. This is done without going through them one
by one: every finding proposes to its best label, a label keeps the earliest proposer and turns all later ones away, and
those propose again. As all labels prefer earlier findings, the outcome is that of the one-by-one rule. The rounds are as
many as the longest chain of findings that turn each other away.

Defined results: an unknown expected line (null or 0) fits every line, an unknown reported line fits no known one; a
missing expected file fits every file; names are compared without case, scope and this; of labels with equal scores the
least key is taken; empty tables give no matches.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.functions import rules
from chainloom.functions.lineage import cut

#: Lines that a reported and an expected line may be apart.
TOLERANCE = 5


def canonical_name(c: Column) -> Column:
    """A variable's name for comparisons: lower case, without scope and this."""
    return F.regexp_replace(F.element_at(F.split(F.lower(F.trim(c)), ":"), -1), r"^this\.", "")


def line_close(reported: Column, expected: Column, tolerance: int = TOLERANCE) -> Column:
    known = F.coalesce(reported, F.lit(0)) > 0
    return (F.coalesce(expected, F.lit(0)) == 0) | (known & (F.abs(reported - expected) <= tolerance))


def file_fits(reported: Column, expected: Column) -> Column:
    """The reported path is the expected one or ends with it at a segment."""
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(F.trim(c), F.lit("")), r"\\", "/"))
    r, e = plain(reported), plain(expected)
    return (e == "") | (r == e) | r.endswith(F.concat(F.lit("/"), e))


def match_score(source_line: Column, source_expected: Column, sink_line: Column, sink_expected: Column) -> Column:
    """110 less the lines by which known ends are off."""
    off = lambda a, b: F.when((F.coalesce(a, F.lit(0)) != 0) & (F.coalesce(b, F.lit(0)) != 0), F.abs(a - b)).otherwise(0)
    return F.lit(110) - off(source_line, source_expected) - off(sink_line, sink_expected)


def match_candidates(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """(finding, label, score): pairs that keep all rules.

    findings (finding, project, source_var, source_file, source_line, sink_var, sink_file, sink_line, vuln_type) and
    labels (label, project, the same) are joined on project and both names; the rest is tested on the pairs.
    """
    keyed = lambda df: df.withColumns({"source_key": canonical_name(F.col("source_var")), "sink_key": canonical_name(F.col("sink_var"))})
    pairs = keyed(findings).alias("f").join(keyed(labels).alias("l"), ["project", "source_key", "sink_key"])
    kind = lambda x: F.lower(F.trim(F.coalesce(F.col(f"{x}.vuln_type"), F.lit(""))))
    kept = line_close(F.col("f.source_line"), F.col("l.source_line")) & line_close(F.col("f.sink_line"), F.col("l.sink_line")) & ((kind("l") == "") | (kind("f") == kind("l")))
    kept = kept & file_fits(F.col("f.source_file"), F.col("l.source_file")) & file_fits(F.col("f.sink_file"), F.col("l.sink_file"))
    return pairs.where(kept).select("finding", "label", match_score(F.col("f.source_line"), F.col("l.source_line"), F.col("f.sink_line"), F.col("l.sink_line")).alias("score")).distinct()


def greedy_match(pairs: DataFrame) -> DataFrame:
    """(finding, label, score) of pairs (finding, label, score): findings in order, each the best free label."""
    left = cut(pairs)
    while True:
        best = cut(left.groupBy("finding").agg(F.max_by(F.struct("label", "score"), F.struct("score", -F.col("label"))).alias("x")).select("finding", "x.label", "x.score"))
        held = best.groupBy("label").agg(F.min("finding").alias("holder"), F.count(F.lit(1)).alias("n"))
        if held.where("n > 1").isEmpty():
            return best
        # A label that an earlier finding holds is lost to all later ones, whether they have asked for it or not.
        left = cut(left.join(held.select("label", "holder"), "label", "left").where(F.col("holder").isNull() | (F.col("finding") <= F.col("holder"))).select("finding", "label", "score"))


def first_pattern(findings: DataFrame, patterns: DataFrame) -> DataFrame:
    """(finding, pattern): the first pattern of the finding's file of which all given parts hold.

    findings (finding, file, source_var, source_text, sink_var, sink_text), patterns (pattern, file, source_var,
    sink_var, source_pattern, sink_pattern); a pattern without any part holds for nothing.
    """
    f, p = findings.alias("f"), patterns.alias("p")
    same = lambda side: F.when(F.col(f"p.{side}_var").isNotNull(), canonical_name(F.col(f"f.{side}_var")) == canonical_name(F.col(f"p.{side}_var")))
    shown = lambda side: F.when(F.col(f"p.{side}_pattern").isNotNull(), F.rlike(F.concat_ws(" ", f"f.{side}_var", f"f.{side}_text"), F.col(f"p.{side}_pattern")))
    parts = [same("source"), same("sink"), shown("source"), shown("sink")]
    given = F.greatest(*[x.isNotNull() for x in parts])
    holds = F.least(*[F.coalesce(x, F.lit(True)) for x in parts])
    return f.join(p, F.col("f.file") == F.col("p.file")).where(given & holds).groupBy("finding").agg(F.min("pattern").alias("pattern"))


def confusion(cases: DataFrame, kind: str) -> DataFrame:
    """(kind, tp, fp, fn, tn, precision, recall, specificity, accuracy, f1, youden) of cases (kind, detected, vulnerable),
    by kind and, under a null kind, of all together. youden is the true-positive less the false-positive rate."""
    n = lambda c: F.count_if(c)
    d, v = F.col("detected"), F.col("vulnerable")
    counts = cases.rollup(kind).agg(n(d & v).alias("tp"), n(d & ~v).alias("fp"), n(~d & v).alias("fn"), n(~d & ~v).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rate = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return counts.select(
        "*", rules.ratio(tp, tp + fp).alias("precision"), rules.ratio(tp, tp + fn).alias("recall"), rules.ratio(tn, tn + fp).alias("specificity"),
        rules.ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), rules.f1(tp, fp, fn).alias("f1"), F.round(rate(tp, tp + fn) - rate(fp, fp + tn), 4).alias("youden"),
    )
