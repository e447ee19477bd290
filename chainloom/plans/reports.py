"""Nested scan reports as flat tables of files, chains, path nodes, labels and false-positive patterns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chainloom.operators import nested

SECTIONS = ("tp_matched", "fp_chains", "unclassified_chains")
#: An entry may hold its chain as a member or be the chain itself.
WRAPPERS = ("chain",)
#: What reports are known to hold, so that a table has its rows also where all reports at hand have single values.
KNOWN: nested.Shapes = {"files": {"array", "map"}, "files[]": {"object"}, "files[].file": {"string"}, "files[].fn_chains": {"array"}, "files[].fp_chains[].fp_pattern": {"array"}}
KNOWN |= {f"files[].{s}": {"array"} for s in SECTIONS} | {f"files[].{s}[].{w}path": {"array"} for s in SECTIONS for w in ("", "chain.")}
_KEYS = ("report_id", "file", "section", "entry_no")


def records(raw: DataFrame) -> DataFrame:
    """(report_id, body): each report once; of redelivered rows the last."""
    return raw.groupBy("report_id").agg(F.max_by("body", F.struct("loaded_at")).alias("body"))


def schema(raw: DataFrame) -> DataFrame:
    """(path, kind): the merged schema of all reports."""
    return nested.infer(records(raw), F.col("body"), KNOWN)


def _shapes(raw: DataFrame) -> nested.Shapes:
    # Repeated reports add nothing to the schema, so it is taken from the rows as they are.
    return nested.merge(nested.shapes_of(nested.infer(raw, F.col("body"), KNOWN)), KNOWN)


def shredded(raw: DataFrame, shapes: nested.Shapes, wanted) -> DataFrame:
    """The elements of the wanted levels (a test on their paths) and of those above them."""
    every = nested.levels(shapes, WRAPPERS)
    chosen = [t.path for t in every if wanted(t.path)]
    tables = [t for t in every if any(c == t.path or c.startswith(f"{t.path}.") for c in chosen)]
    parsed = records(raw).select("report_id", nested.once(nested.parse_record(F.col("body"))).alias("report"))
    return nested.shred(parsed, ["report_id"], "report", tables, {"files[]": "file"}, chosen)


def _keys(rows: DataFrame) -> list[Column]:
    """The keys of the parents: the file, the section and the number of the entry."""
    return [F.col("report_id"), F.try_element_at("names", F.lit(1)).alias("file"), F.split_part("level", F.lit("."), F.lit(2)).alias("section"), F.try_element_at("ordinals", F.lit(2)).alias("entry_no")]


def _named(rows: DataFrame) -> DataFrame:
    return rows.select(*_keys(rows), *[c for c in rows.columns if c not in ("report_id", "names", "file", "level")]).withColumn("section", F.regexp_replace("section", r"\[\]$", ""))


def _table(raw: DataFrame, *paths: str) -> DataFrame:
    shapes = _shapes(raw)
    return _named(nested.flat_table(shredded(raw, shapes, paths.__contains__), shapes, WRAPPERS, *paths, reserved=(*_KEYS, "file_no", "node_no", "pattern_no")))


def files(raw: DataFrame) -> DataFrame:
    """Files of reports, with their own scalar members and those of their metrics."""
    return _table(raw, "files[]").drop("section", "entry_no", "own__file").withColumn("file_no", F.col("ordinals")[0]).drop("ordinals", "parent_key")


def chains(raw: DataFrame) -> DataFrame:
    """Chains of the three sections, with the members of the chain, of its ends and of its label."""
    return _table(raw, *[f"files[].{s}[]" for s in SECTIONS]).drop("ordinals")


def path_nodes(raw: DataFrame) -> DataFrame:
    """Nodes of the chains' paths; a node is a name or an object with its variable, file and line."""
    rows = _table(raw, *[f"files[].{s}[].path[]" for s in SECTIONS]).withColumn("node_no", F.element_at("ordinals", -1)).drop("ordinals")
    own = [c for c in ("variable", "value") if c in rows.columns]
    return rows.withColumn("variable", F.coalesce(*own) if own else F.lit(None).cast("string")).drop("value")


def labels(raw: DataFrame) -> DataFrame:
    """Labels that no chain has found."""
    return _table(raw, "files[].fn_chains[]").drop("ordinals", "section")


def fp_patterns(raw: DataFrame) -> DataFrame:
    """Patterns by which chains were taken for false."""
    return _table(raw, *[f"files[].{s}[].fp_pattern[]" for s in SECTIONS]).withColumn("pattern_no", F.element_at("ordinals", -1)).drop("ordinals")


def items(raw: DataFrame) -> DataFrame:
    """(report_id, file, section, entry_no, item, item_no, item_value): path nodes, label ids and pattern reasons.

    Null and empty values give no row but keep their number.
    """
    shapes = _shapes(raw)
    kept = tuple(f"files[].{s}[]{e}" for s in SECTIONS for e in (".path[]", ".fp_pattern[]", ""))
    rows = shredded(raw, shapes, kept.__contains__)
    v, level = F.col("value"), F.col("level")
    item = F.when(level.endswith(".path[]"), "path").when(level.endswith(".fp_pattern[]"), "fp_reason").otherwise("tp_id")
    found = F.when(level.endswith(".path[]"), F.coalesce(nested.scalar(nested.part(v, "variable")), nested.scalar(v))).when(level.endswith(".fp_pattern[]"), nested.scalar(nested.part(v, "reason"))).otherwise(nested.scalar(nested.part(v, "tp", "id")))
    number = F.when(item == "tp_id", 0).otherwise(F.element_at("ordinals", -1))
    return _named(rows.select("report_id", "names", "level", "ordinals", item.alias("item"), number.alias("item_no"), found.alias("item_value")).where("item_value <> ''")).select(*_KEYS, "item", "item_no", "item_value")
