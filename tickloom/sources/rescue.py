"""Rescue-column ingestion of JSON records whose fields drift from file to file.

``ingest`` enforces a target schema and rescues what does not fit; ``ingest_long`` does so to the
letter, a row per field. ``field_changes`` reduces the taken and rescued values of each file to a few
statistics and compares each file with the one before it; it tells a renamed field by the quantity
that it carries on. ``conform`` replays these changes: it ingests under the names that each file
uses, into one typed table with fields under their first name and a ``_rescued`` column with every
unknown or uncastable value as JSON; ``promote`` replays rescued values into further typed columns.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.arrays import let
from tickloom.operators.skew import broadcast_if_small, carried, kept

CAMPAIGN = ["dataset", "campaign"]
FILE = [*CAMPAIGN, "file_no"]
#: Types of a field, in the order in which a tie between equally common ones is decided.
TYPES = ["integer", "fraction", "string", "boolean", "array", "object"]


def _type(v: Column) -> Column:
    """One of TYPES, or NULL for a JSON null. A whole number is an integer only when written without a fraction."""
    return let(F.schema_of_variant(v), _type_of_schema)


def _type_of_schema(t: Column) -> Column:
    return (
        F.when(t == "BIGINT", "integer")
        .when(t.rlike(r"^DECIMAL\((19|[23]\d),0\)$"), "integer")  # too long for 64 bits
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "fraction")
        .when(t == "STRING", "string")
        .when(t == "BOOLEAN", "boolean")
        .when(t.startswith("ARRAY"), "array")
        .when(t.startswith("OBJECT"), "object")
    )


def _inner(v: Column, kind: Column) -> Column:
    """The text of the quantity itself: out of an array of one, or an object that holds it as ``v``."""
    return (
        F.when(kind == "array", F.try_variant_get(v, "$[0]", "string"))
        .when(kind == "object", F.try_variant_get(v, "$.v", "string"))
        .otherwise(F.try_variant_get(v, "$", "string"))
    )


def _typed(v: Column, kind: str) -> Column:
    if kind.startswith("array"):
        return F.try_variant_get(v, "$", kind)

    def cast(text: Column) -> Column:
        if kind == "boolean":
            return F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true")
        return text if kind == "string" else text.try_cast(kind)

    return let(let(F.struct(v.alias("v"), _type(v).alias("k")), lambda b: _inner(b["v"], b["k"])), cast)


def _whole(v: Column, typed: Column, kind: str) -> Column:
    """Whether ``typed`` holds all of ``v``: a scalar, an array of exactly one, an object with nothing but ``v``; of a typed array, each element."""
    items = F.try_variant_get(v, "$", "array<variant>")
    if kind.startswith("array"):
        return F.size(F.filter(items, lambda x: x.isNotNull() & ~F.is_variant_null(x))) == F.size(F.filter(typed, lambda x: x.isNotNull()))
    return F.coalesce(F.size(F.try_variant_get(v, "$", "map<string,variant>")), F.size(items), F.lit(1)) == 1


#: What a column of a type takes when nothing but values written as its own type are let in.
_WRITTEN = {"bigint": "integer", "int": "integer", "double": "fraction", "string": "string", "boolean": "boolean"}


def ingest(records: DataFrame, target: dict[str, str], payload: str = "payload", names: Column | None = None) -> DataFrame:
    """The target schema enforced: the columns of ``records``, ``_t0, _t1, ..`` of ``target``, and ``_rescued``.

    ``_rescued`` maps names to the values (variants) that no column took whole: unknown fields, what
    can't be cast, what holds more than the column does. It is NULL for a payload that is no JSON
    object. ``names`` is a map of first names to the names in the record's file. Casts are generous
    (numbers written as strings, arrays of one, objects around a ``v``), and JSON nulls are dropped.
    """
    rows = records.withColumn("_m", F.from_json(payload, "map<string,variant>"))
    here = [F.lit(f) if names is None else F.coalesce(F.element_at(names, F.lit(f)), F.lit(f)) for f in target]
    # each value is found, then typed, once
    rows = rows.select("*", *[n.alias(f"_n{i}") for i, n in enumerate(here)])
    rows = rows.select("*", *[F.element_at("_m", F.col(f"_n{i}")).alias(f"_v{i}") for i in range(len(here))])

    rows = rows.select("*", *[_typed(F.col(f"_v{i}"), kind).alias(f"_t{i}") for i, kind in enumerate(target.values())])
    taken = []
    for i, kind in enumerate(target.values()):
        v, t = F.col(f"_v{i}"), F.col(f"_t{i}")
        taken.append(F.when(t.isNotNull() & _whole(v, t, kind) | F.is_variant_null(v), F.col(f"_n{i}")))
    rest = let(F.array_compact(F.array(*taken)), lambda u: F.map_filter("_m", lambda k, _: ~F.array_contains(u, k))) if taken else F.col("_m")
    return rows.select(*records.columns, *[f"_t{i}" for i in range(len(taken))], rest.alias("_rescued"))


def ingest_long(records: DataFrame, target: dict[str, str], payload: str = "payload") -> DataFrame:
    """The target schema enforced to the letter, a row per record and field: FILE, ``field, kind, num, text, rescued``.

    A field of ``target`` written as its column's own type is taken: numbers as ``num``, flags and
    strings as ``text``. Every other value (unknown fields, other types, JSON nulls, arrays) is kept
    whole in ``rescued``. A record that is no JSON object, or has no fields, has one row, of the NULL field.
    """
    e = records.select(*FILE, F.explode_outer(F.from_json(payload, "map<string,variant>")).alias("field", "value"))
    e = e.select("*", F.schema_of_variant("value").alias("_s")).select(*FILE, "field", "value", _type_of_schema(F.col("_s")).alias("kind"))
    wanted = {f: _WRITTEN[t] for f, t in target.items() if t in _WRITTEN}
    # the fields of each type together: one test a type, however many fields there are
    fits = F.lit(False)
    for t in dict.fromkeys(wanted.values()):
        fits = fits | ((F.col("kind") == t) & F.col("field").isin([f for f, k in wanted.items() if k == t]))
    e = e.withColumn("fits", F.coalesce(fits, F.lit(False)))
    number = F.col("kind").isin("integer", "fraction")
    return e.select(
        *FILE, "field", "kind",
        F.when(F.col("fits") & number, F.try_variant_get("value", "$", "double")).alias("num"),
        F.when(F.col("fits") & ~number, F.try_variant_get("value", "$", "string")).alias("text"),
        F.when(~F.col("fits"), F.col("value")).alias("rescued"),
    )


def field_profile(records: DataFrame, target: dict[str, str], payload: str = "payload") -> DataFrame:
    """One row per file and field: counts by type and what the field's quantity looks like.

    Values that the columns took are read as they are, rescued ones are replayed: the quantity is
    looked for inside them. The profile does not depend on ``target``. The NULL field stands for the
    records without fields.
    """
    e = ingest_long(records, target, payload)
    e = e.withColumn("long", F.when(F.col("kind") == "array", F.try_variant_get("rescued", "$[1]", "string").isNotNull()))
    e = e.withColumn("text", F.coalesce("text", _inner(F.col("rescued"), F.col("kind")))).drop("rescued")
    truth = F.lower("text").isin("true", "false")
    e = e.withColumn("num", F.coalesce("num", F.when(~truth, F.expr("try_cast(text AS double)"))))
    word = F.col("text").isNotNull() & F.col("num").isNull() & ~truth
    frac = F.when(F.col("kind") == "array", F.col("num") != F.rint("num")).otherwise((F.col("kind") == "fraction") | F.coalesce(F.col("text").rlike(r"[.eE]"), F.lit(False)))
    # shapes are compared by their hashes: numbers are aggregated in place, strings would be sorted
    shape = F.xxhash64(F.regexp_replace(F.regexp_replace(F.col("text"), r"\p{L}", "a"), r"\d", "9"))
    return e.groupBy(*FILE, "field").agg(
        *[F.count_if(F.col("kind") == t).alias(t) for t in TYPES],
        F.count_if(F.col("long")).alias("long"),
        F.count("num").alias("n_num"),
        F.avg("num").alias("mean"),
        F.stddev_pop("num").alias("std"),
        F.min("num").alias("low"),
        F.max("num").alias("high"),
        F.count_if(F.col("num").isNotNull() & frac).alias("n_frac"),
        F.count_if(truth).alias("n_bool"),
        F.count_if(F.lower("text") == "true").alias("n_true"),
        F.count_if(word).alias("n_word"),
        F.min(F.when(word, shape)).alias("shape_low"),
        F.max(F.when(word, shape)).alias("shape_high"),
        F.avg(F.when(word, F.length("text"))).alias("word_length"),
    )


def _likeness(a: dict, b: dict) -> float | None:
    """Distance between the quantities of two fields, or None where they can't be the same one."""
    n, m = a["n_num"] + a["n_bool"] + a["n_word"], b["n_num"] + b["n_bool"] + b["n_word"]
    if not n or not m:
        return None
    arrays = [x["long"] / max(1, x["array"]) > 0.2 and 2 * x["array"] > x["integer"] + x["fraction"] + x["string"] + x["boolean"] for x in (a, b)]
    if arrays[0] != arrays[1]:
        return None
    slack = 3.5 * (1 / n + 1 / m) ** 0.5
    kinds = [max(("n_num", "n_bool", "n_word"), key=lambda k, x=x: x[k]) for x in (a, b)]
    if kinds[0] != kinds[1]:
        return None
    if kinds[0] == "n_bool":
        d = abs(a["n_true"] / a["n_bool"] - b["n_true"] / b["n_bool"])
        return d if d <= max(0.3, 0.5 * slack) else None
    if kinds[0] == "n_word":
        d = abs(a["word_length"] - b["word_length"])
        return d if d <= 0.3 and a["shape_low"] == b["shape_low"] and a["shape_high"] == b["shape_high"] or (d < 0.15 * a["word_length"] and a["shape_low"] != a["shape_high"] and b["shape_low"] != b["shape_high"]) else None
    if (2 * a["n_frac"] > a["n_num"]) != (2 * b["n_frac"] > b["n_num"]):
        return None
    s, t = a["std"] or 0.0, b["std"] or 0.0
    scale = max(s, t)
    if scale == 0:
        return 0.0 if a["mean"] == b["mean"] else None
    d = abs(a["mean"] - b["mean"]) / scale
    few = min(n, m) < 8
    alike = d <= max(0.6, slack) and (few or 0.5 <= (s or 1e-300) / (t or 1e-300) <= 2)
    width = max(a["high"], b["high"]) - min(a["low"], b["low"])
    shared = min(a["high"], b["high"]) - max(a["low"], b["low"])
    return d if alike and (shared > 0.4 * width or few and shared >= 0) else None


def _match(group: pa.Table) -> pa.Table:
    """The changes of one file; a removed and an added field that carry the same quantity are one, closest pairs first."""
    rows = group.to_pylist()
    gone, new, other = ([r for r in rows if r["side"] == s] for s in ("removed", "added", "retyped"))
    pairs = sorted((d, a["field"], b["field"]) for a in gone for b in new if (d := _likeness(a, b)) is not None)
    olds, news, out = set(), set(), []
    for _, a, b in pairs:
        if a not in olds and b not in news:
            olds.add(a)
            news.add(b)
            out.append(("renamed", a, b))
    out += [("removed", a["field"], "") for a in gone if a["field"] not in olds]
    out += [("added", "", b["field"]) for b in new if b["field"] not in news]
    out += [("retyped", x["field"], x["field"]) for x in other]
    names = ["change", "field_old", "field_new"]
    of_file = {c: pa.array([rows[0][c]] * len(out), group.schema.field(c).type) for c in FILE}
    return pa.table(of_file | {n: pa.array([o[i] for o in out], pa.string()) for i, n in enumerate(names)})


def _filed(records: DataFrame) -> DataFrame:
    """``records`` with a whole ``file_no``, and '' for a NULL dataset or campaign."""
    return records.withColumns({"file_no": F.col("file_no").cast("long"), **{c: F.coalesce(c, F.lit("")) for c in CAMPAIGN}})


def field_changes(records: DataFrame, target: dict[str, str] | None = None, payload: str = "payload") -> DataFrame:
    """``dataset, campaign, file_no, change, field_old, field_new`` of each file against the one before.

    The records are ingested under the ``target`` schema first; the changes are those of the typed
    columns and rescued fields of each file, whatever ``target`` has. A file has a field when any of
    its records has it, JSON null included. Its type is the commonest of its values (ties in the
    order of TYPES); a field that is null throughout keeps the type it had before, and the quantity
    it showed before or, failing that, shows later. ``added`` and ``removed`` fields of one file that
    carry the same quantity are one ``renamed`` field. A file whose records hold no field at all
    (empty, broken or no objects) still counts as a file. A NULL dataset or campaign is named ''.
    Records without ``file_no`` belong to no file. The first file of a campaign has no changes.
    """
    records = _filed(records).where(F.col("file_no").isNotNull())
    # the records are parsed once; all that follows works on a few rows for each file
    profile = kept(field_profile(records, target or {}, payload))
    no = F.col("file_no")
    files = carried(profile.select(*FILE).distinct(), CAMPAIGN, "file_no", {"prev_no": no}, {"next_no": no}, own=False)
    common = F.greatest(*[F.col(t) for t in TYPES])
    kind = F.when(common > 0, F.coalesce(*[F.when(F.col(t) == common, t) for t in TYPES]))
    # a field that is null throughout shows its quantity in the files before, or else after
    stats = F.struct(*[c for c in profile.columns if c not in (*FILE, "field")])
    shown = F.when(F.col("n_num") + F.col("n_bool") + F.col("n_word") > 0, stats)
    fields = profile.where("field IS NOT NULL").select(*FILE, "field", kind.alias("own_kind"), shown.alias("shown"), stats.alias("stats"))
    fields = carried(fields, [*CAMPAIGN, "field"], "file_no", {"kind": F.col("own_kind"), "before": F.col("shown")}, {"after": F.col("shown")})
    fields = kept(fields.select(*FILE, "field", "kind", F.coalesce("before", "after", "stats").alias("s")).join(broadcast_if_small(files), FILE))
    # the fields of a file beside those that the file before had
    key = [*CAMPAIGN, "at_no", "field"]
    here = fields.where("prev_no IS NOT NULL").select(*CAMPAIGN, no.alias("at_no"), "field", F.col("kind").alias("new_kind"), F.col("s").alias("new"))
    there = fields.where("next_no IS NOT NULL").select(*CAMPAIGN, F.col("next_no").alias("at_no"), "field", F.col("kind").alias("old_kind"), F.col("s").alias("old"))
    both = here.join(there, key, "full").withColumnRenamed("at_no", "file_no")
    side = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new_kind") != F.col("old_kind"), "retyped")
    changed = both.withColumn("side", side).where("side IS NOT NULL").select(*FILE, "field", "side", F.inline(F.array(F.coalesce("new", "old"))))
    return changed.groupBy(*FILE).applyInArrow(_match, "dataset string, campaign string, file_no long, change string, field_old string, field_new string")


def first_names(changes: DataFrame) -> DataFrame:
    """``dataset, campaign, file_no, names``: for files from which a field bears another name, a map from first names to those names."""

    def chain(g: pd.DataFrame) -> pd.DataFrame:
        now: dict[str, str] = {}
        out = []
        for no, step in g.sort_values("file_no").groupby("file_no"):
            moved = {}
            for old, new in zip(step["field_old"], step["field_new"]):
                first = next((f for f, n in now.items() if n == old), old)
                moved[first] = new
            now.update(moved)
            now = {f: n for f, n in now.items() if f != n}
            out.append((g["dataset"].iloc[0], g["campaign"].iloc[0], int(no), dict(now)))
        return pd.DataFrame({"dataset": [o[0] for o in out], "campaign": [o[1] for o in out], "from_no": [o[2] for o in out], "names": [o[3] for o in out]})

    renames = changes.where("change = 'renamed'").select(*FILE, "field_old", "field_new")
    return renames.groupBy("dataset", "campaign").applyInPandas(chain, "dataset string, campaign string, from_no long, names map<string,string>")


def conform(records: DataFrame, target: dict[str, str], changes: DataFrame, payload: str = "payload") -> DataFrame:
    """One row per record: the columns of ``records`` but the payload, those of ``target``, and ``_rescued``.

    ``target`` maps first names of fields to types. A value is found under the name that its field
    bears in the record's file, taken out of an array's first element or an object's ``v``, and cast;
    what no column takes (unknown fields, values that can't be cast, values of which more than the
    column holds was written, these whole) is kept in ``_rescued``, a map from the name in the file to
    JSON (NULL when empty). JSON nulls and missing fields are NULL. A
    payload that is no JSON object gives NULL columns and is rescued whole under the name ''.
    Files of a NULL dataset or campaign are those that ``changes`` name ''.
    """
    steps = first_names(changes).select(*CAMPAIGN, F.col("from_no").alias("file_no"), "names")
    files = _filed(records.select(*FILE)).where("file_no IS NOT NULL").distinct()
    # the names of a file are those of the latest step up to it
    marks = files.withColumn("names", F.lit(None).cast("map<string,string>")).withColumn("_file", F.lit(True)).unionByName(steps.withColumn("_file", F.lit(False)))
    marks = marks.groupBy(*FILE).agg(F.max("_file").alias("_file"), F.first("names", ignorenulls=True).alias("names"))
    of_file = carried(marks, CAMPAIGN, "file_no", {"_names": F.col("names")}).where(F.col("_file") & F.col("_names").isNotNull())
    of_file = kept(of_file.select(*[F.col(c).alias(f"_file_{c}") for c in FILE], "_names"))  # a row for each file with renamed fields
    on = [F.coalesce(records[c], F.lit("")) == F.col(f"_file_{c}") for c in CAMPAIGN] + [records["file_no"].cast("long") == F.col("_file_file_no")]
    rows = ingest(records.join(broadcast_if_small(of_file), on, "left"), target, payload, names=F.col("_names"))
    keep = [c for c in records.columns if c != payload and c not in target]
    json = F.when(F.col("_rescued").isNull() & F.col(payload).isNotNull(), F.create_map(F.lit(""), F.col(payload))).otherwise(
        F.when(F.size("_rescued") > 0, F.transform_values("_rescued", lambda _, v: F.to_json(v)))
    )
    return rows.select(*keep, *[F.col(f"_t{i}").alias(f) for i, f in enumerate(target)], json.alias("_rescued"))


def promote(table: DataFrame, approved: dict[str, str], rescued: str = "_rescued") -> DataFrame:
    """Rescued values of the ``approved`` fields replayed into typed columns; the rest stays rescued.

    Values that still can't be cast stay rescued, as do those of which the column holds a part only. A field that nobody wrote gives a NULL column.
    """

    def replay(t: DataFrame, field: str, kind: str) -> DataFrame:
        value = F.try_parse_json(F.element_at(rescued, F.lit(field)))
        got = _typed(value, kind)
        left = F.map_filter(rescued, lambda k, _: (k != field) | got.isNull() | ~_whole(value, got, kind))
        return t.withColumns({field: got, rescued: F.when(F.size(left) > 0, left)})

    for field, kind in approved.items():
        table = replay(table, field, kind)
    return table
