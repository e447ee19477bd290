"""Schemas that drift from file to file: one consistent table and a report of each change.

The records of a file are flattened to (file, section, record, field, type, value). schema_changes compares each file
with the file before it in the same series. Which old field became which new one is decided by similarity flooding:
the schema graph of a file has nodes for its objects, fields and JSON types, and edges for nesting (from every object
to all fields below it) and for typing. Scores of node pairs start from the likeness of names and are propagated along
edges that both graphs have until they settle. Of the fields that went and the fields that came, a pair is selected
when its settled score is at least RELATIVE of the best score of either field; what flooding doesn't select is no
candidate. The values confirm selected pairs (more than half of the labels hold the same), and of the confirmed ones a
one-to-one choice is made, best score first. canonical_table casts all files to one type for each field and unions them
under the oldest name of each field.

The work on values (flattening, types of a field, agreement of labels) is done by joins and aggregates over all
records; only the schemas, whose size is the number of fields of two files, are taken as one row each.

Defined results: unreadable bodies (also null, empty and JSON that is no object) are left out; a repeated record
changes nothing; a null value doesn't make a field present; an empty array or object is entered as its type says; of
files with equal times the smaller id comes first; a name that was given away and comes back beside the field that
bears its column now has a column of its own, with AGAIN behind its name; of two values of one field in one record the smaller text counts; a series of one file and
an empty table give no changes; extra columns are ignored.
"""

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.lineage import cut, partitions
from chainloom.operators.ordering import running_sum

#: Change of the scores below which they have settled, and the least score of a selected pair by the best of either field.
SETTLED, RELATIVE = 1e-3, 0.5
#: Ends the name of a field whose name is another field's in the same file.
AGAIN = "__again"
_LEAVES = pa.list_(pa.struct([("field", pa.string()), ("type", pa.string()), ("value", pa.string())]))


class _Number(str):
    """Digits of a JSON number with a fraction or an exponent, as written."""


def _leaves(value, path: str, found: list[tuple[str, str, str]]) -> None:
    """Add (field, JSON type, text) of the non-null values below value; objects are entered, arrays are not."""
    if isinstance(value, dict):
        for name, below in value.items():
            _leaves(below, f"{path}.{name}", found)
    elif value is not None:
        found.append((path, _json_type(value), _text(value)))


def _json_type(value) -> str:
    if isinstance(value, bool):
        return "boolean"
    for kind, name in ((int, "integer"), (_Number, "number"), (str, "string")):
        if isinstance(value, kind):
            return name
    return "array"


def _text(value) -> str:
    """The value as text; an array of one as its element."""
    if isinstance(value, list) and len(value) == 1 and not isinstance(value[0], dict | list) and value[0] is not None:
        value = value[0]
    if isinstance(value, bool):
        return str(value).lower()
    return value if isinstance(value, str) else str(value) if isinstance(value, int) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def _parsed(body: str):
    """The object in a body; a number with a fraction as its digits; None for anything else."""
    try:
        found = json.loads(body.lstrip("\ufeff"), parse_float=_Number)
    except (ValueError, AttributeError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, labels, leaves = [], [], []
        for i, (section, body) in enumerate(zip(batch["section"].to_pylist(), batch["body"].to_pylist())):
            record = _parsed(body)
            if record is not None:
                found: list[tuple[str, str, str]] = []
                _leaves(record, section, found)
                own = {f: v for f, _, v in found}
                kept.append(i)
                labels.append(own.get(f"{section}.id") or own.get(f"{section}.tp.id"))
                leaves.append(found)
        flat = [x for found in leaves for x in found]
        fields = [pa.array([x[i] for x in flat], type=pa.string()) for i in range(3)]
        ends = np.concatenate(([0], np.cumsum([len(x) for x in leaves]))).astype(np.int32)
        nested = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, names=["field", "type", "value"]))
        rest = batch.select(["series", "file_id", "at", "section", "record_no"]).take(pa.array(kept, type=pa.int64()))
        yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(labels, type=pa.string()), nested.cast(_LEAVES)], [*rest.schema.names, "label", "leaves"])


def flatten(records: DataFrame, series: str, file_id: str, at: str) -> DataFrame:
    """(series, file_id, at, section, record_no, label, field, type, value): one row for each non-null value of each
    readable record. Records are parsed once; the written copy has one row for each."""
    own = records.where("body is not null and section is not null").select(F.col(series).cast("long").alias("series"), F.col(file_id).cast("long").alias("file_id"), F.col(at).cast("timestamp").alias("at"), "section", F.col("record_no").cast("int").alias("record_no"), "body")
    parsed = cut(own.mapInArrow(_flatten, "series long, file_id long, at timestamp, section string, record_no int, label string, leaves array<struct<field: string, type: string, value: string>>"))
    return parsed.select("series", "file_id", "at", "section", "record_no", "label", F.explode("leaves").alias("x")).select("series", "file_id", "at", "section", "record_no", "label", "x.*")


def placed(flat: DataFrame) -> DataFrame:
    """(series, file_id, place): the files of each series numbered from 1 in the order of their times."""
    files = flat.groupBy("series", "file_id").agg(F.min("at").alias("at"))
    return running_sum(files, "series", ["at", "file_id"], None, "place").select("series", "file_id", "place")


def consecutive(flat: DataFrame) -> DataFrame:
    """(series, file_id, before): each file with the file before it; the first has none and is left out."""
    files = cut(placed(flat))
    earlier = files.select("series", F.col("file_id").alias("before"), (F.col("place") + 1).alias("place"))
    return files.join(earlier, ["series", "place"]).select("series", "file_id", "before")


def fields_of(flat: DataFrame) -> DataFrame:
    """(series, file_id, section, field, types): the fields of each file with the set of their JSON types."""
    return flat.groupBy("series", "file_id", "section", "field").agg(F.array_join(F.sort_array(F.collect_set("type")), "|").alias("types"))


@lru_cache(1 << 16)
def _trigrams(name: str) -> frozenset[str]:
    low = "".join("_" + c.lower() if c.isupper() else c for c in name).strip("_.").replace(".", "_")
    return frozenset(f"  {low} "[i : i + 3] for i in range(len(low) + 1))


@lru_cache(1 << 18)
def _likeness(a: str, b: str) -> float:
    """Of two paths: shared trigrams of their last names or of all names below the first, whichever are more alike, and
    at least a trace, so that every pair takes part."""
    last, below = (x.rpartition(".")[2] for x in (a, b)), (x.partition(".")[2] for x in (a, b))
    share = lambda x, y: 2 * len(x & y) / max(1, len(x) + len(y))
    return max(0.05, share(*map(_trigrams, last)), share(*map(_trigrams, below)))


def _graph(fields: list[tuple[str, str]]) -> tuple[dict[str, int], dict[str, tuple[np.ndarray, np.ndarray]]]:
    """Nodes (objects, fields, types) of a schema and the ends of its edges by label."""
    nodes: dict[str, int] = {}
    at = lambda key: nodes.setdefault(key, len(nodes))
    edges: dict[str, set[tuple[int, int]]] = {"holds": set(), "is": set()}
    for path, types in fields:
        steps = path.split(".")
        whole = [at(".".join(steps[: i + 1])) for i in range(len(steps))]
        edges["holds"] |= {(x, y) for i, x in enumerate(whole) for y in whole[i + 1 :]}
        edges["is"] |= {(whole[-1], at(f"type:{t}")) for t in types.split("|")}
    return nodes, {k: tuple(np.array(sorted(e), dtype=np.int64).reshape(-1, 2).T) for k, e in edges.items()}


def _along(edges: tuple[np.ndarray, np.ndarray], scores: np.ndarray) -> np.ndarray:
    """For each node the mean of the rows of scores to which its edges lead."""
    out, degree = np.zeros_like(scores), np.bincount(edges[0], minlength=len(scores))
    np.add.at(out, edges[0], scores[edges[1]])
    return out / np.maximum(1, degree)[:, None]


def flood(old: list[tuple[str, str]], new: list[tuple[str, str]]) -> tuple[dict[str, int], dict[str, int], np.ndarray]:
    """Similarity flooding of two schemas [(field, types)]: node numbers of both and the settled scores."""
    (a, ea), (b, eb) = _graph(old), _graph(new)
    kind = np.equal.outer([x.startswith("type:") for x in a], [y.startswith("type:") for y in b])
    start = kind * np.array([[_likeness(x, y) * (1 + (x == y)) for y in b] for x in a]).reshape(len(a), len(b))
    start /= max(start.max(initial=0), 1e-9)
    score, moved = start, np.inf
    # The start is added in every round, so the scores are drawn to one fixed point and the loop ends.
    while moved >= SETTLED:
        given = score + start
        spread = sum(_along(x, _along(y, given.T).T) for k in ("holds", "is") for x, y in ((ea[k], eb[k]), (ea[k][::-1], eb[k][::-1])))
        following = given + spread * kind
        following /= max(following.max(initial=0), 1e-9)
        moved, score = np.abs(following - score).max(initial=0), following
    return a, b, score


def select(score: np.ndarray) -> np.ndarray:
    """Which pairs are selected: those whose score is at least RELATIVE of the best of their row and of their column."""
    best = np.maximum(score.max(1, keepdims=True, initial=0), score.max(0, keepdims=True, initial=0))
    return (score > 0) & (score >= RELATIVE * best)


def _correspond(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each pair of files the selected pairs of a field that went and one that came in the same section."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            a, b, score = flood([(x["field"], x["was"]) for x in r.fields if x["was"]], [(x["field"], x["now"]) for x in r.fields if x["now"]])
            for section in sorted({x["section"] for x in r.fields}):
                gone, come = (sorted(x["field"] for x in r.fields if x["section"] == section and not x[side]) for side in ("now", "was"))
                own = score[np.ix_([a[g] for g in gone], [b[c] for c in come])]
                rows += [(r.series, r.file_id, r.before, section, gone[i], come[j], float(own[i, j])) for i, j in zip(*np.nonzero(select(own)))]
        yield pd.DataFrame(rows, columns=["series", "file_id", "before", "section", "old_field", "field", "score"])


def _one_to_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of the confirmed pairs of two files the best, then the best of those that share no field with it, and so on."""
    for batch in batches:
        rows = []
        for r in batch.itertuples(index=False):
            taken = set()
            for x in sorted(r.pairs, key=lambda x: (-x["score"], -x["share"], x["old_field"], x["field"])):
                ends = {("old", x["old_field"]), ("new", x["field"])}
                if not ends & taken:
                    taken |= ends
                    rows.append((r.series, r.file_id, x["section"], x["old_field"], x["field"], x["score"], x["share"]))
        yield pd.DataFrame(rows, columns=["series", "file_id", "section", "old_field", "field", "score", "share"])


def schema_pairs(flat: DataFrame) -> DataFrame:
    """(series, file_id, before, section, field, was, now): both files' fields with their types, null where absent."""
    pairs, fields = consecutive(flat), fields_of(flat)
    now = fields.withColumnRenamed("types", "now").join(pairs, ["series", "file_id"])
    was = fields.select("series", F.col("file_id").alias("before"), "section", "field", F.col("types").alias("was")).join(pairs, ["series", "before"])
    return now.join(was.select("series", "file_id", "before", "section", "field", "was"), ["series", "file_id", "before", "section", "field"], "full_outer")


def renames(flat: DataFrame, compared: DataFrame) -> DataFrame:
    """(series, file_id, section, old_field, field, score, share): a consistent choice of confirmed pairs.

    Flooding selects the candidates. One is confirmed when of the labels that hold the old field before and the new one
    after more than half hold the same value. A field is in one rename at most.
    """
    packed = compared.groupBy("series", "file_id", "before").agg(F.collect_list(F.struct("section", "field", "was", "now")).alias("fields"))
    both = packed.where("exists(fields, x -> x.was is null) and exists(fields, x -> x.now is null)")
    # Many small schemas: a fixed number of parts keeps them from being gathered into one task for their few bytes.
    spread = both.repartition(partitions(flat.sparkSession), "series", "file_id")
    found = cut(spread.mapInPandas(_correspond, "series long, file_id long, before long, section string, old_field string, field string, score double"))
    # Only values of fields that are candidates are compared.
    wanted = found.select("series", "file_id", "field").unionByName(found.select("series", F.col("before").alias("file_id"), F.col("old_field").alias("field"))).distinct()
    held = flat.where("label is not null").join(wanted, ["series", "file_id", "field"], "left_semi").groupBy("series", "file_id", "field", "label").agg(F.min("value").alias("value"))
    old = held.select("series", F.col("file_id").alias("before"), F.col("field").alias("old_field"), "label", F.col("value").alias("old_value"))
    tested = found.join(old, ["series", "before", "old_field"]).join(held, ["series", "file_id", "field", "label"])
    tested = tested.groupBy("series", "file_id", "section", "old_field", "field").agg(F.first("score").alias("score"), F.avg((F.col("value") == F.col("old_value")).cast("double")).alias("share")).where("share > 0.5")
    several = tested.groupBy("series", "file_id").agg(F.collect_list(F.struct("section", "old_field", "field", "score", "share")).alias("pairs"))
    return several.mapInPandas(_one_to_one, "series long, file_id long, section string, old_field string, field string, score double, share double")


def schema_changes(flat: DataFrame) -> DataFrame:
    """(series, file_id, field, change, old_field): added, removed, renamed and type_changed against the file before."""
    compared = cut(schema_pairs(flat))
    named = cut(renames(flat, compared).select("series", "file_id", "old_field", "field"))
    keys = ["series", "file_id", "field"]
    gone = compared.where("now is null").join(named.select("series", "file_id", F.col("old_field").alias("field")), keys, "left_anti")
    come = compared.where("was is null").join(named.select(*keys), keys, "left_anti")
    types = compared.select("series", "file_id", F.col("field").alias("old_field"), "was").where("was is not null")
    retyped = compared.where("now is not null").select(*keys, "now").join(named, keys).join(types, ["series", "file_id", "old_field"]).where("was <> now")
    row = lambda df, change: df.select(*keys, F.lit(change).alias("change"), F.lit("").alias("old_field"))
    return (
        row(come, "added").unionByName(row(gone, "removed"))
        .unionByName(row(compared.where("was <> now"), "type_changed").unionByName(row(retyped, "type_changed")))
        .unionByName(named.select(*keys, F.lit("renamed").alias("change"), "old_field"))
    )


def rename_roots(events: DataFrame) -> DataFrame:
    """(series, field, place, until, canonical) of rename events (series, field, old_field, place).

    From its place until the next renaming into the same field, a field goes by the oldest name along its renames. The
    event before an event is the last one into its old field; these links form trees, which are followed to their roots
    by pointer doubling, so the rounds grow with the logarithm of the longest chain of renames.
    """
    following = F.lead("place").over(Window.partitionBy("series", "field").orderBy("place"))
    spans = cut(events.withColumn("until", following))
    parent = spans.select("series", F.col("field").alias("old_field"), F.col("place").alias("from_place"), F.col("until").alias("to_place"))
    within = (F.col("from_place") < F.col("place")) & F.coalesce(F.col("place") <= F.col("to_place"), F.lit(True))
    linked = spans.alias("e").join(parent.alias("p"), (F.col("e.series") == F.col("p.series")) & (F.col("e.old_field") == F.col("p.old_field")) & within, "left")
    state = cut(linked.select("e.series", "e.field", "e.place", "e.until", F.col("e.old_field").alias("canonical"), F.when(F.col("from_place").isNotNull(), F.struct(F.col("e.old_field").alias("field"), F.col("from_place").alias("place"))).alias("up")))
    while not state.where("up is not null").isEmpty():
        above = state.select("series", F.struct("field", "place").alias("up"), F.col("canonical").alias("above"), F.col("up").alias("next"))
        joined = state.join(above, ["series", "up"], "left")
        state = cut(joined.select("series", "field", "place", "until", F.coalesce("above", "canonical").alias("canonical"), F.col("next").alias("up")))
    return state.select("series", "field", "place", "until", "canonical")


def canonical_names(flat: DataFrame, changes: DataFrame) -> DataFrame:
    """(series, file_id, field, canonical) for every field of every file."""
    files = cut(placed(flat))
    rows = fields_of(flat).join(files, ["series", "file_id"]).select("series", "file_id", "place", "field")
    events = changes.where("change = 'renamed'").select("series", "file_id", "field", "old_field").join(files, ["series", "file_id"]).select("series", "field", "old_field", "place")
    known = rename_roots(events).alias("k")
    # Renames are far fewer than fields of files; at most one span of a field holds a place.
    held = (F.col("r.series") == F.col("k.series")) & (F.col("r.field") == F.col("k.field")) & (F.col("r.place") >= F.col("k.place")) & F.coalesce(F.col("r.place") < F.col("k.until"), F.lit(True))
    named = rows.alias("r").join(known, held, "left").select("r.series", "r.file_id", "r.field", F.coalesce("canonical", "r.field").alias("canonical"))
    # Of the fields of one file that go by one name the renamed one keeps it.
    place = F.row_number().over(Window.partitionBy("series", "file_id", "canonical").orderBy(F.col("field") == F.col("canonical"), "field"))
    return named.withColumn("place", place).select("series", "file_id", "field", F.when(F.col("place") == 1, F.col("canonical")).otherwise(F.concat("field", F.lit(AGAIN))).alias("canonical"))


def column_types(rows: DataFrame) -> dict[str, str]:
    """The type of each canonical field of rows (canonical, type, value), the least that holds all its values: numbers
    that some files write as text or as arrays of one are numbers, all else is text. As many as there are different
    fields, these are the only thing that the driver reads."""
    fits = lambda kind: F.bool_and(F.col("value").try_cast(kind).isNotNull())
    is_a = lambda *kinds: F.bool_or(F.col("type").isin(*kinds))
    kind = F.when(F.bool_and(F.col("type") == "boolean"), "boolean").when(is_a("integer", "number") & ~is_a("boolean"), F.when(fits("long") & ~is_a("number"), "long").when(fits("double"), "double"))
    return {r.canonical: r.kind for r in rows.groupBy("canonical").agg(F.coalesce(kind, F.lit("string")).alias("kind")).collect()}


def canonical_table(flat: DataFrame, names: DataFrame) -> DataFrame:
    """All records as one table: the keys of a record and one column for each canonical field, cast to one type."""
    rows = flat.join(names, ["series", "file_id", "field"])
    kinds = column_types(rows)
    keys = ["series", "file_id", "section", "record_no"]
    cell = lambda c: F.min(F.when(F.col("canonical") == c, F.col("value"))).try_cast(kinds[c]).alias(c.replace(".", "__"))
    return rows.groupBy(*keys).agg(*map(cell, sorted(kinds))) if kinds else rows.select(*keys)
