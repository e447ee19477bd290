"""Deeply nested JSON records as related flat tables.

infer reads all records once and gives the schema that they have together: for each path of member names (elements of
arrays and members of maps are written []) the kinds of values that stand there. Every path at which some record has an
array or a map is a level, a table of its own. shred explodes the levels recursively, all levels of one depth in one
step, and gives each element a surrogate key made of its parent's key, the level and the ordinal; flat_table turns one
or more levels into a table with a column for each scalar member that the schema has.

An object is a map where the schema knows maps at its path (some member name there is no identifier, such as a file
name) and it has no member that elements of the level have. A wrapper is a member such as chain in {chain: {path}, tp}
that stands for the element itself: its members are read as the element's own.

Defined results: null, blank and unreadable texts give no row; a text that is JSON within a JSON string (also twice)
is read as what it holds; a leading byte order mark is ignored; a single value in place of an array is an array of
one; null in place of an array is an empty one, while null elements keep their ordinal; numbers come as their plain
text where a member is a number in some records and a text in others; an empty table has no levels and gives no rows.
"""

import json
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names that members of an object have; an object with any other name is a map.
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$-]*"
Shapes = dict[str, set[str]]


class Level(NamedTuple):
    """A table: its path, its parent's path, and where below an element of the parent its elements stand."""

    path: str
    parent: str
    steps: tuple[str, ...]
    wrapper: str
    both: bool
    is_map: bool
    members: tuple[str, ...]

    @property
    def depth(self) -> int:
        return self.path.count("[]")


def unwrapped(text: Column) -> Column:
    """A JSON text without byte order mark and outer white space, taken out of up to two levels of JSON strings."""
    clean = lambda x: F.regexp_replace(x, "^[﻿\\s]+", "")
    t = clean(text)
    for _ in range(2):
        t = F.when(t.startswith('"'), clean(F.try_variant_get(F.try_parse_json(t), "$", "string"))).otherwise(t)
    return t


def parse_record(text: Column) -> Column:
    """The variant of a JSON text; null where it is none."""
    return F.try_parse_json(unwrapped(text))


def once(value: Column) -> Column:
    """The value as the output of a generator, so that later projections don't repeat its work."""
    return F.explode(F.array(value))


def part(v: Column, *names: str) -> Column:
    """The member of an object below the given names; null when there is none."""
    return F.try_variant_get(v, "$" + "".join(f"['{n}']" for n in names), "variant") if names else v


def members(v: Column) -> Column:
    """The members of an object as a map of variants; null for anything else."""
    return F.try_variant_get(v, "$", "map<string,variant>")


def scalar(v: Column) -> Column:
    """The text of a scalar; null for null, objects and arrays."""
    return F.when(members(v).isNull() & F.try_variant_get(v, "$", "array<variant>").isNull(), F.try_variant_get(v, "$", "string"))


# --- schema ----------------------------------------------------------------------------------------------------------


def _walk(value, path: str, maps: dict[str, set[str]], found: set[tuple[str, str]]) -> None:
    if isinstance(value, dict):
        named = all(re.fullmatch(IDENTIFIER, k) for k in value) and not (path in maps and maps[path].isdisjoint(value))
        found.add((path, "object" if named else "map"))
        for name, below in value.items():
            _walk(below, f"{path}.{name}" if named and path else name if named else f"{path}[]", maps, found)
    elif isinstance(value, list):
        found.add((path, "array"))
        for below in value:
            _walk(below, f"{path}[]", maps, found)
    else:
        kinds = ((bool, "boolean"), (int, "integer"), (float, "number"), (str, "string"))
        found.add((path, next((name for kind, name in kinds if isinstance(value, kind)), "null")))


def _shapes(maps: dict[str, set[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[str, str]] = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                try:
                    _walk(json.loads(text), "", maps, found)
                except (ValueError, TypeError, RecursionError):
                    continue
        paths = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in paths], type=pa.string()) for i in (0, 1)], ["path", "kind"])

    return run


def infer(records: DataFrame, text: Column, known: Shapes | None = None) -> DataFrame:
    """(path, kind): the merged schema of all records, one row for each kind of value that stands at a path.

    Objects where known has maps are maps if they have none of the known members of its elements.
    """
    maps = {t.path[:-2]: set(t.members) for t in levels(known or {}) if t.is_map}
    return records.select(unwrapped(text).alias("text")).where("text is not null").mapInArrow(_shapes(maps), "path string, kind string").distinct()


def shapes_of(schema: DataFrame) -> Shapes:
    """The merged schema on the driver: as many entries as the records have different paths."""
    found: Shapes = {}
    for r in schema.collect():
        found.setdefault(r.path, set()).add(r.kind)
    return found


def merge(*shapes: Shapes) -> Shapes:
    """Schemas put together; a known one adds levels that the records at hand may lack."""
    return {p: set().union(*(s.get(p, set()) for s in shapes)) for p in {p for s in shapes for p in s}}


def _bare(path: str, wrappers: tuple[str, ...]) -> str:
    for w in wrappers:
        path = path.replace(f"[].{w}.", "[].")
    return path


def _way(path: str, wrappers: tuple[str, ...]) -> str:
    """The wrapper through which a path leads within its element, '' for none."""
    return next((w for w in wrappers if path.rpartition("[]")[2].startswith(f".{w}.")), "")


def levels(shapes: Shapes, wrappers: tuple[str, ...] = ()) -> list[Level]:
    """The tables of a schema, parents first."""
    kinds: Shapes = {}
    ways: dict[str, set[str]] = {}
    for path, own in shapes.items():
        kinds.setdefault(_bare(path, wrappers), set()).update(own)
        ways.setdefault(_bare(path, wrappers), set()).add(_way(path, wrappers))
    found = []
    for path in sorted(p for p in kinds if kinds[p] & {"array", "map"}):
        parent, below, rest = path.rpartition("[]")
        inside = sorted({p[len(path) + 3 :].split(".")[0].split("[")[0] for p in kinds if p.startswith(f"{path}[].")})
        found.append(Level(f"{path}[]", parent + below, tuple(s for s in rest.split(".") if s), max(ways[path]), "" in ways[path], "map" in kinds[path], tuple(inside)))
    return found


# --- tables ----------------------------------------------------------------------------------------------------------


def _member(v: Column, wrapper: str, both: bool, steps: tuple[str, ...]) -> Column:
    """The value below an element, through its wrapper where that is an object."""
    if not wrapper:
        return part(v, *steps)
    if not both:
        return part(v, wrapper, *steps)
    return F.when(members(part(v, wrapper)).isNotNull(), part(v, wrapper, *steps)).otherwise(part(v, *steps))


def _elements(v: Column, level: Level) -> Column:
    """Array of (name, value) of what stands at a level below v."""
    row = lambda name, x: F.struct(name.alias("name"), x.alias("value"))
    no_name = F.lit(None).cast("string")
    own = _member(v, level.wrapper, level.both, level.steps)
    found = F.when(F.try_variant_get(own, "$", "array<variant>").isNotNull(), F.transform(F.try_variant_get(own, "$", "array<variant>"), lambda x: row(no_name, x)))
    if level.is_map:
        known = F.array(*map(F.lit, level.members)).cast("array<string>")
        is_map = members(own).isNotNull() & ~F.arrays_overlap(F.map_keys(members(own)), known)
        found = found.when(is_map, F.transform(F.map_entries(members(own)), lambda e: row(e["key"], e["value"])))
    single = F.when(own.isNotNull() & ~F.is_variant_null(own), F.array(row(no_name, own)))
    return F.coalesce(found.otherwise(single), F.array().cast("array<struct<name: string, value: variant>>"))


def shred(df: DataFrame, keys: list[str], value: str, tables: list[Level], natural: dict[str, str] | None = None, kept: list[str] | None = None) -> DataFrame:
    """(*keys, level, row_key, parent_key, ordinals, names, value): the elements of the kept levels, or of all given.

    ordinals and names hold an entry for each level from the outermost to the element's own; a name is the member's
    name in a map, or else the scalar that natural names for the level. Levels whose parents aren't given have no rows.
    """
    natural, kept = natural or {}, kept if kept is not None else [t.path for t in tables]
    rows = df.select(
        *keys, F.lit("").alias("level"), F.concat_ws(":", *[F.col(k).cast("string") for k in keys]).alias("row_key"), F.lit(None).cast("string").alias("parent_key"),
        F.array().cast("array<int>").alias("ordinals"), F.array().cast("array<string>").alias("names"), F.col(value).alias("value"),
    )
    own = ["level", "row_key", "parent_key", "ordinals", "names", "value"]
    for depth in range(1, max((t.depth for t in tables), default=0) + 1):
        # A row that isn't kept ends where its children begin, so that no large value is carried on.
        alone = F.array(F.struct(*own))
        found = F.when(F.col("level").isin(*kept), alone).otherwise(F.filter(alone, lambda x: F.lit(False)))
        for parent in sorted({t.parent for t in tables if t.depth == depth}):
            below = [t for t in tables if t.depth == depth and t.parent == parent]
            child = lambda t: F.transform(_elements(F.col("value"), t), lambda e, i: F.struct(
                F.lit(t.path).alias("level"), F.concat("row_key", F.lit(f"/{'.'.join(t.steps)}."), i.cast("string")).alias("row_key"), F.col("row_key").alias("parent_key"),
                F.concat("ordinals", F.array(i)).alias("ordinals"), F.concat("names", F.array(F.coalesce(e["name"], scalar(part(e["value"], natural[t.path]))) if t.path in natural else e["name"])).alias("names"), e["value"].alias("value"),
            ))
            found = F.when(F.col("level") == parent, F.concat(found, *map(child, below))).otherwise(found)
        rows = rows.select(*keys, F.explode(found).alias("x")).select(*keys, *[f"x.{c}" for c in own])
    return rows.where(F.col("level").isin(*kept))


def _column(kinds: set[str]) -> str:
    """The type of a member by the kinds of its values."""
    own = kinds - {"null"}
    return "boolean" if own == {"boolean"} else "long" if own == {"integer"} else "double" if own and own <= {"integer", "number"} else "string"


def flat_table(rows: DataFrame, shapes: Shapes, wrappers: tuple[str, ...], *paths: str, reserved: tuple[str, ...] = ()) -> DataFrame:
    """rows of the levels with the given paths, with a column for each scalar member that any of them has; value holds
    elements that are scalars themselves. What is a level of its own is no member, also where a record has a single value
    there. Names of members below objects are joined by two underscores; a member with the
    name of another column or a reserved one begins with own__."""
    scalars = {"boolean", "integer", "number", "string"}
    found: dict[tuple[str, ...], dict[str, set[str]]] = {}
    tables = [t.path[:-2] for t in levels(shapes, wrappers)]
    for path, kinds in shapes.items():
        bare = _bare(path, wrappers)
        if any(bare == t or bare.startswith(f"{t}.") for t in tables):
            continue
        level = next((p for p in paths if bare == p or bare.startswith(f"{p}.")), None)
        rest = bare[len(level) + 1 :] if level else "[]"
        if kinds & scalars and "[]" not in rest:
            found.setdefault(tuple(rest.split(".")) if rest else (), {}).setdefault(_way(path, wrappers), set()).update(kinds & scalars)
    columns, taken = [], {*rows.columns, *reserved} - {"value"}
    for steps, ways in sorted(found.items()):
        kind = _column(set().union(*ways.values()))
        text = scalar(_member(F.col("value"), max(ways), "" in ways, steps))
        name = "__".join(steps) or "value"
        columns.append((text if kind == "string" else text.try_cast(kind)).alias(f"own__{name}" if name in taken else name))
    return rows.where(F.col("level").isin(*paths)).select(*[c for c in rows.columns if c != "value"], *columns)
