"""Mapping of freely entered values to the entries of a reference list.

Every distinct value is normalised and split into tokens. The distinct forms of a value (its tokens, and neighbouring
tokens written together) are joined to the reference vocabulary, which holds the same forms of every name of every entry
and whole names with their words in rotated order. A form meets a vocabulary unit when it equals it, when it is an
abbreviation (a prefix) of it, or within an edit distance that grows with its length. Edit distance is no cross join: a
unit that allows k edits is cut into k + 1 or more segments of at most WIDEST letters, one of which stands unchanged, at
most k places off, in any text within that distance, so candidates come from an equi-join of segments and places.

Repaired forms are combined to complete names by soft TF-IDF: every token of a name counts with its inverse frequency
among all names, every token of a value with its inverse frequency among all values, both times the best similarity of
a form that covers it. Names are ranked by what is covered of the name and of the value; a general word that several
names share names none of them, and words that people add to any value weigh little because many values have them.

Defined results: a value that is null or has no letters meets nothing; values that differ only in case, width, accents,
look-alike letters, invisible characters, separators or decorations meet the same entry; of equally good names the one
that leaves less of the value uncovered wins, then the smaller entry; an entry's null or empty names are no names; empty
tables give no matches; extra columns are ignored.
"""

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chainloom.functions.lineage import cut, partitions

# Letters of other scripts that look like Latin ones, and digits written for letters.
LOOKALIKES = str.maketrans("аеорсухіјѕкмтвнοαειρντυ", "aeopcyxijskmtbhoaeipvtu")
DIGITS = str.maketrans("01345", "oieas")
#: Least share of a name and of a value, by weight of their tokens, that must be covered.
NAME_COVERED, VALUE_COVERED = 0.745, 0.25
#: Length of an abbreviation at least, its similarity, and letters of a segment at most.
SHORTEST, ABBREVIATED, WIDEST = 3, 0.9, 8


def tokens_of(value: str, remarks: bool = False) -> list[str]:
    """The tokens of a value in plain lower-case letters and digits; remarks in brackets only when asked for."""
    text = unicodedata.normalize("NFKD", value)
    text = "".join(c for c in text if not unicodedata.combining(c) and unicodedata.category(c) != "Cf").lower().translate(LOOKALIKES)
    if not remarks:
        text = re.sub(r"\[[^\]]*\]|\([^)]*\)", " ", text)
    found = re.findall(r"[a-z0-9]+", text)
    return [t.translate(DIGITS) if re.search("[a-z]", t) else t for t in found]


def _value_forms(longest: int):
    """(value, form, first, last): the forms of each value and which of its tokens they cover: up to one token more
    than the longest name has, and all of it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for value in batch["value"]:
                t = [x for x in tokens_of(value) if not x.isdigit()]
                spans = {(i, j) for i in range(len(t)) for j in range(i, min(len(t), i + longest + 1))} | ({(0, len(t) - 1)} if t else set())
                rows += [(value, "".join(t[i : j + 1]), i, j) for i, j in sorted(spans)]
            yield pd.DataFrame(rows, columns=["value", "form", "first", "last"])

    return run


def _name_units(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(entry, name, size, unit, covered): the forms of each name and which of its tokens they cover."""
    for batch in batches:
        rows = []
        for entry, name in zip(batch["entry"], batch["name"]):
            t = tokens_of(name, remarks=True)
            spans = {(tuple(range(i, j + 1))) for i in range(len(t)) for j in range(i, len(t))} | {(*range(r, len(t)), *range(r)) for r in range(len(t))}
            rows += [(entry, " ".join(t), len(t), "".join(t[i] for i in span), list(span)) for span in sorted(spans)]
        yield pd.DataFrame(rows, columns=["entry", "name", "size", "unit", "covered"])


def _abbreviation(tokens: list[str]) -> str:
    """A pattern for all tokens in order, each cut after SHORTEST letters at the earliest."""
    cut = lambda t: t[:SHORTEST] + "".join(f"(?:{c}" for c in t[SHORTEST:]) + ")?" * max(0, len(t) - SHORTEST)
    return "".join(map(cut, tokens))


def _name_patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(unit, start, pattern) of the names of several tokens, for their tokens abbreviated and written together."""
    for batch in batches:
        several = [t for t in map(lambda x: tokens_of(x, remarks=True), batch["name"]) if len(t) > 1]
        yield pd.DataFrame([("".join(t), "".join(t)[:SHORTEST], _abbreviation(t)) for t in several], columns=["unit", "start", "pattern"])


def _edits(length: Column) -> Column:
    """Edits that a unit of this length allows."""
    return F.when(length < 4, 0).when(length < 8, 1).when(length < 14, 2).otherwise(3)


def names(reference: DataFrame, entry: str, *columns: str) -> DataFrame:
    """(entry, name) for the text and array-of-text columns of the reference list."""
    kinds = dict(reference.dtypes)
    listed = [F.col(c) if kinds[c].startswith("array") else F.array(F.col(c)) for c in columns]
    return reference.select(F.col(entry).alias("entry"), F.explode(F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in listed])).alias("name")).where("name is not null").distinct()


def repair(forms: DataFrame, vocabulary: DataFrame, patterns: DataFrame) -> DataFrame:
    """(form, unit, alike): each form with the vocabulary units that it may stand for.

    forms (form) and vocabulary (unit, single: whether it is one token) hold distinct texts; patterns (unit, start,
    pattern) are those of names whose tokens may be abbreviated and written together.
    """
    exact = forms.join(vocabulary, F.col("form") == F.col("unit")).select("form", "unit", F.lit(1.0).alias("alike"))
    rest = forms.join(vocabulary, F.col("form") == F.col("unit"), "left_anti")
    long = F.length("unit")
    least = F.when(F.col("single"), SHORTEST).otherwise(F.greatest(F.lit(SHORTEST), F.ceil(long * 0.5)))
    prefixes = vocabulary.where(long > SHORTEST).select("unit", F.explode(F.transform(F.sequence(least.cast("int"), long - 1), lambda n: F.left(F.col("unit"), n))).alias("prefix"))
    short = rest.join(prefixes, F.col("form") == F.col("prefix")).select("form", "unit", F.lit(ABBREVIATED).alias("alike"))
    joined = rest.where(F.length("form") >= 2 * SHORTEST).join(patterns, F.left("form", F.lit(SHORTEST)) == F.col("start")).where(F.expr("form rlike concat('^', pattern, '$')")).select("form", "unit", F.lit(ABBREVIATED).alias("alike"))
    cuts = vocabulary.select("unit", long.alias("n"), _edits(long).alias("k")).where("k > 0")
    # More segments than edits need keep every segment within WIDEST letters, however long the unit.
    cuts = cuts.withColumn("parts", F.greatest(F.col("k") + 1, F.ceil(F.col("n") / WIDEST)).cast("int"))
    cuts = cuts.select("unit", "n", "k", "parts", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("i"))
    begin = lambda i: F.floor(F.col("n") * i / F.col("parts")).cast("int")
    cuts = cuts.select("unit", "n", "k", begin(F.col("i")).alias("at"), (begin(F.col("i") + 1) - begin(F.col("i"))).alias("width"))
    # A segment is entered at all places to which the edits can move it, so that place and letters are one join key.
    segments = cuts.select("unit", "n", "k", F.expr("substring(unit, at + 1, width)").alias("segment"), F.explode(F.sequence(F.col("at") - F.col("k"), F.col("at") + F.col("k"))).alias("start"))
    starts = F.sequence(F.lit(0), F.length("form") - 1)
    pieces = rest.where(F.length("form") >= 3).select("form", F.explode(starts).alias("start")).select("form", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(WIDEST), F.length("form") - F.col("start")))).alias("width"))
    pieces = pieces.select("form", "start", F.expr("substring(form, start + 1, width)").alias("segment"))
    near = F.abs(F.length("form") - F.col("n")) <= F.col("k")
    met = pieces.join(segments, ["segment", "start"]).where(near).select("form", "unit", "n", "k").distinct()
    distance = F.levenshtein("form", "unit")
    edited = met.where(distance <= F.col("k")).select("form", "unit", (1 - distance / F.greatest(F.length("form"), F.col("n"))).alias("alike"))
    return exact.unionByName(short).unionByName(joined).unionByName(edited).groupBy("form", "unit").agg(F.max("alike").alias("alike"))


def rarity(tokens: DataFrame, of: str, token: str) -> DataFrame:
    """(token, weight): the inverse frequency of each token among the texts (column of) that have it."""
    total = tokens.agg(F.count_distinct(of).alias("n"))
    return tokens.groupBy(token).agg(F.count_distinct(of).alias("df")).crossJoin(F.broadcast(total)).select(token, F.log(1 + F.col("n") / F.col("df")).alias("weight"))


def match_values(values: DataFrame, value: str, reference: DataFrame, entry: str, *columns: str) -> DataFrame:
    """(value, entry, name, covered, value_covered): the entry that each distinct value means; others have no row."""
    units = cut(names(reference, entry, *columns).mapInPandas(_name_units, f"entry {dict(reference.dtypes)[entry]}, name string, size int, unit string, covered array<int>").where("size > 0").distinct())
    longest = units.agg(F.max("size")).first()[0] or 0
    # Few bytes, but much work for each: a fixed number of parts keeps them from being gathered into one task.
    distinct = values.select(F.col(value).alias("value")).where("value is not null").distinct().repartition(partitions(values.sparkSession), "value")
    forms = cut(distinct.mapInPandas(_value_forms(longest), "value string, form string, first int, last int"))
    tokens = units.where(F.size("covered") == 1).select("name", "unit", F.explode("covered").alias("at")).distinct()
    weights = tokens.join(rarity(tokens, "name", "unit"), "unit").select("name", "at", "weight")
    patterns = names(reference, entry, *columns).mapInPandas(_name_patterns, "unit string, start string, pattern string").distinct()
    met = cut(repair(forms.select("form").distinct(), units.groupBy("unit").agg(F.max(F.size("covered") == 1).alias("single")), patterns))
    found = forms.join(met, "form").join(units, "unit")
    per_token = found.select("value", "entry", "name", "alike", F.explode("covered").alias("at")).groupBy("value", "entry", "name", "at").agg(F.max("alike").alias("alike"))
    named = per_token.join(weights, ["name", "at"]).groupBy("value", "entry", "name").agg(F.sum(F.col("alike") * F.col("weight")).alias("got"))
    full = weights.groupBy("name").agg(F.sum("weight").alias("full"))
    own = forms.where(F.col("first") == F.col("last")).select("value", F.col("first").alias("token"), "form")
    weighed = own.join(rarity(own, "value", "form"), "form").select("value", "token", "weight")
    place = found.select("value", "entry", "name", "alike", F.explode(F.sequence("first", "last")).alias("token")).groupBy("value", "entry", "name", "token").agg(F.max("alike").alias("alike"))
    said = weighed.groupBy("value").agg(F.sum("weight").alias("said"))
    covered = place.join(weighed, ["value", "token"]).groupBy("value", "entry", "name").agg(F.sum(F.col("alike") * F.col("weight")).alias("met")).join(said, "value")
    scored = named.join(full, "name").join(covered, ["value", "entry", "name"]).select("value", "entry", "name", (F.col("got") / F.col("full")).alias("covered"), (F.col("met") / F.col("said")).alias("value_covered"))
    good = scored.where((F.col("covered") >= NAME_COVERED) & (F.col("value_covered") >= VALUE_COVERED))
    best = F.row_number().over(Window.partitionBy("value").orderBy(F.desc(F.round(F.col("covered") * F.sqrt("value_covered"), 6)), F.desc("value_covered"), "entry", "name"))
    return good.select("*", best.alias("place")).where("place = 1").drop("place")


def number_in(code: Column) -> Column:
    """The first number in a code such as CWE-079, in whatever spelling; digits of other widths are not read."""
    return F.nullif(F.regexp_extract(code, r"(\d+)", 1), F.lit("")).try_cast("long")
