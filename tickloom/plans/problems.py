"""Queries pN_ of the general problems over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.eager import KeyedJoin, eager_join_aggregate, heavy_keys
from tickloom.operators.references import Reference, orphan_references, orphan_report
from tickloom.operators.skew import join_null_safe
from tickloom.operators.spikes import faulty_waveforms
from tickloom.session import shared_dir, table
from tickloom.sources.compaction import consolidate_reports
from tickloom.sources.rescue import conform, field_changes, promote

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# ---------------------------------------------------------------- 1 implausible readings
def _faulty(spark: SparkSession, d: str) -> DataFrame:
    return faulty_waveforms(table(spark, d, "wvfm"), table(spark, d, "channel_mask"), table(spark, d, "clip_settings"), table(spark, d, "light_events"))


def _excursions_sql(w: int) -> str:
    """SQL: whether an excursion of ``w`` ticks leads out of the corridor of the three ticks on either side, beyond the fence."""
    before, after, own = f"list_slice(v, greatest(i - 3, 1), i - 1)", f"list_slice(v, i + {w}, i + {w + 2})", f"list_slice(v, i, i + {w - 1})"
    corridor = f"[greatest(list_max({before}), list_max({after})), least(list_min({before}), list_min({after}))]"
    heights = f"list_transform({own}, lambda x: greatest(x - c[1], c[2] - x))"
    ok = f"len(list_filter({own}, lambda x: x IS NULL)) = 0 AND list_min(h) > 0 AND c[1] - c[2] < 0.5 * list_min(h) AND list_max(h) <= 4 * list_min(h) AND list_max(h) > fence"
    inner = f"list_transform([{corridor}], lambda c: list_transform([{heights}], lambda h: list_max({before}) IS NOT NULL AND list_max({after}) IS NOT NULL AND {ok})[1])[1]"
    return f"len(list_filter(range(2, len(v) - {w} + 1), lambda i: coalesce({inner}, false))) > 0"


#: The rules by list operations, with exact quantiles over all hours of a channel.
_FAULTY_SQL = f"""WITH w AS (SELECT DISTINCT wvfm_row, file_id, adc, ch, samples, list_transform(coalesce(samples, []), lambda x: CASE WHEN isfinite(x) THEN x::DOUBLE END) AS v FROM wvfm),
d AS (SELECT *, list_max(v) - list_min(v) AS spread, list_sort(list_filter(list_transform(range(1, len(v)), lambda i: v[i + 1] - v[i]), lambda x: x IS NOT NULL)) AS d FROM w),
f AS (SELECT *, CASE WHEN len(v) >= 8 AND len(d) >= 7 AND spread > 1 THEN greatest(d[least(CAST(floor(len(d) * 0.75) AS BIGINT), len(d) - 1) + 1] - d[CAST(floor(len(d) * 0.25) AS BIGINT) + 1], 0.3 * 1.349 * sqrt(2)) END AS iqr FROM d),
n AS (SELECT adc, ch, quantile_cont(iqr, 0.4) AS iqr FROM f WHERE iqr IS NOT NULL GROUP BY 1, 2), rails AS (SELECT adc, median(saturation_clip_threshold) AS rail FROM clip_settings WHERE isfinite(saturation_clip_threshold) GROUP BY 1),
j AS (SELECT f.*, n.iqr * 15 / (1.349 * sqrt(2)) AS fence, r.rail FROM f LEFT JOIN n ON n.adc = f.adc AND n.ch = f.ch LEFT JOIN rails r ON r.adc = f.adc),
s AS (SELECT wvfm_row, file_id, adc, ch, CASE WHEN len(list_filter(samples, lambda x: x < 0 OR x > 65535)) > 0 THEN 'impossible'
  WHEN len(list_filter(range(1, len(v) - 14), lambda i: len(list_filter(list_slice(v, i, i + 15), lambda x: x IS NULL)) = 0 AND list_max(list_slice(v, i, i + 15)) - list_min(list_slice(v, i, i + 15)) <= 1 AND list_max(list_slice(v, i, i + 15)) < coalesce(rail * 0.999, 'inf'::DOUBLE))) > 0 THEN 'stuck'
  WHEN fence IS NOT NULL AND ({' OR '.join(_excursions_sql(w) for w in (1, 2, 3))}) THEN 'spike' END AS reason FROM j),
c AS (SELECT f.file_id, f.adc, f.ch, count(DISTINCT wvfm_row) AS n, max(spread) AS most, count_if(spread > 1) AS vary, count(spread) AS known, avg(f.iqr) AS own, any_value(n.iqr) AS iqr FROM f LEFT JOIN n ON n.adc = f.adc AND n.ch = f.ch GROUP BY 1, 2, 3),
faulty AS (SELECT 'wvfm' AS tbl, wvfm_row AS row_id, reason FROM s ANTI JOIN (SELECT * FROM channel_mask WHERE dead) m ON m.file_id = s.file_id AND m.adc = s.adc AND m.ch = s.ch WHERE reason IS NOT NULL
  UNION SELECT 'channel_mask', mask_row, CASE WHEN dead THEN 'alive' ELSE 'unmarked' END FROM channel_mask m JOIN c ON c.file_id = m.file_id AND c.adc = m.adc AND c.ch = m.ch WHERE n >= 3 AND CASE WHEN coalesce(dead, false) THEN 2 * vary > known AND own >= 0.25 * coalesce(iqr, 0) ELSE most <= 1 END
  UNION SELECT 'clip_settings', set_row, 'setting' FROM clip_settings s LEFT JOIN rails r ON r.adc = s.adc WHERE saturation_clip_threshold IS NOT NULL AND (NOT isfinite(saturation_clip_threshold) OR abs(saturation_clip_threshold - rail) > 0.01 * abs(rail)))"""


@query("p1_found", f"{_FAULTY_SQL} SELECT tbl, row_id FROM faulty")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _faulty(spark, d).select("tbl", "row_id")


@query("p1_report", f"{_FAULTY_SQL} SELECT tbl, reason, count(*) AS n_rows FROM faulty GROUP BY 1, 2")
def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return _faulty(spark, d).groupBy("tbl", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------- 2 references
REFERENCES = [
    Reference("event_hits", "event_id", "charge_events", "event_id"),
    Reference("event_hits", "hit_row", "hits", "hit_row"),
    Reference("charge_light", "event_id", "charge_events", "event_id"),
    Reference("charge_light", "light_id", "light_events", "light_id"),
    Reference("light_flash", "light_id", "light_events", "light_id"),
    Reference("light_flash", "flash_id", "flash", "flash_id"),
]

_ORPHANS_SQL = " UNION ALL ".join(
    f"""SELECT DISTINCT '{r.tbl}' AS tbl, ref_id, '{r.fk}' AS fk,
  CASE WHEN n = 0 THEN 'missing' WHEN late THEN 'late' ELSE 'deleted' END AS kind, ref_ts
FROM (SELECT r.ref_id, r.ref_ts, count(p.{r.key}) AS n, coalesce(bool_or(p.ingest_ts > r.ref_ts), false) AS late,
    coalesce(bool_or(p.ingest_ts <= r.ref_ts AND (p.removed_ts IS NULL OR p.removed_ts > r.ref_ts)), false) AS there
  FROM (SELECT DISTINCT ref_id, {r.fk}, ref_ts FROM {r.tbl} WHERE {r.fk} IS NOT NULL AND {r.fk} <> -1) r
  LEFT JOIN {r.target} p ON p.{r.key} = r.{r.fk} GROUP BY r.ref_id, r.{r.fk}, r.ref_ts)
WHERE n = 0 OR (NOT there AND ref_ts IS NOT NULL)"""
    for r in REFERENCES
)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(lambda t: table(spark, d, t), REFERENCES)


@query("p2_found", f"SELECT DISTINCT tbl, ref_id, fk, kind FROM ({_ORPHANS_SQL})")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("tbl", "ref_id", "fk", "kind")


@query(
    "p2_report",
    f"SELECT tbl, fk, kind, strftime(date_trunc('month', ref_ts), '%Y-%m-%d') AS period, count(*) AS n_orphans FROM ({_ORPHANS_SQL}) GROUP BY ALL",
)
def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


# ---------------------------------------------------------------- 4 heavy keys
@query(
    "p4_found",
    """SELECT 'event_id' AS key_name, event_id AS key_id FROM event_hits WHERE event_id IS NOT NULL GROUP BY event_id
  HAVING count(*) > 0.05 * (SELECT count(*) FROM event_hits)
UNION ALL SELECT 'hit_tpc_id', CAST(hit_tpc_id AS BIGINT) FROM hits WHERE hit_tpc_id IS NOT NULL GROUP BY hit_tpc_id
  HAVING count(*) > 0.05 * (SELECT count(*) FROM hits)""",
)
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    refs, hits = table(spark, d, "event_hits"), table(spark, d, "hits")
    joins = [KeyedJoin(refs, hits, "hit_row", "event_id", {"energy": energy()}), KeyedJoin(hits, refs, "hit_row", "hit_tpc_id", {})]
    return heavy_keys(joins, 0.05).select("key_name", "key_id")


#: Energies are summed as exact decimals, so that no order of the rows changes a result.
_E = "decimal(18,6)"


def energy() -> Column:
    return F.when(~F.isnan("e"), F.col("e")).cast(_E)


@query(
    "p4_events",
    f"""SELECT r.event_id, CAST(count(*) AS BIGINT) AS n_hits, CAST(sum(CAST(CASE WHEN isnan(h.e) THEN NULL ELSE h.e END AS {_E.upper()})) AS DOUBLE) AS energy
FROM event_hits r JOIN hits h ON r.hit_row = h.hit_row GROUP BY r.event_id""",
)
def p4_events(spark: SparkSession, d: str) -> DataFrame:
    out = eager_join_aggregate(table(spark, d, "event_hits"), table(spark, d, "hits"), "hit_row", ["event_id"], {"energy": energy()}, "n_hits")
    return out.withColumn("energy", F.col("energy").cast("double"))


@query(
    "p4_tpcs",
    f"""SELECT h.hit_tpc_id, CAST(count(*) AS BIGINT) AS n_refs, CAST(sum(CAST(CASE WHEN isnan(h.e) THEN NULL ELSE h.e END AS {_E.upper()})) AS DOUBLE) AS energy
FROM event_hits r JOIN hits h ON r.hit_row = h.hit_row GROUP BY h.hit_tpc_id""",
)
def p4_tpcs(spark: SparkSession, d: str) -> DataFrame:
    # seen from the hits: the references are the side whose numbers multiply
    out = eager_join_aggregate(table(spark, d, "hits"), table(spark, d, "event_hits"), "hit_row", ["hit_tpc_id"], {}, "n_refs", {"energy": energy()})
    return out.withColumn("energy", F.col("energy").cast("double"))


@query(
    "p4_tpc_hits",
    f"""WITH v AS (SELECT hit_row, hit_tpc_id, ingest_ts, CAST(CASE WHEN isnan(e) THEN NULL ELSE e END AS {_E.upper()}) AS e FROM hits),
h AS (SELECT hit_row, hit_tpc_id, e FROM (SELECT *, row_number() OVER (PARTITION BY hit_row, hit_tpc_id ORDER BY ingest_ts DESC NULLS LAST, e DESC NULLS LAST) AS r FROM v) WHERE r = 1 OR hit_row IS NULL)
SELECT h.hit_tpc_id, count(*) AS n_hits, CAST(sum(h.e) AS DOUBLE) AS energy, CAST(coalesce(sum(r.n), 0) AS BIGINT) AS n_refs FROM h LEFT JOIN (SELECT hit_row, count(*) AS n FROM event_hits GROUP BY 1) r ON r.hit_row = h.hit_row GROUP BY 1""",
)
def p4_tpc_hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits and energy of each TPC over all its hits, each hit once; ``n_refs`` counts the references to them."""
    e = energy()
    # versions of a hit count once, with the latest energy; rows without a number are hits of their own
    h = table(spark, d, "hits").groupBy("hit_row", "hit_tpc_id").agg(F.max_by(e, F.struct("ingest_ts", e)).alias("last"), F.sum(e).alias("all_e"), F.count(F.lit(1)).alias("m"))
    own = F.col("hit_row").isNull()
    h = h.select("hit_row", "hit_tpc_id", F.when(own, F.col("all_e")).otherwise(F.col("last")).alias("hit_e"), F.when(own, F.col("m")).otherwise(1).alias("hits"))
    # TPCs are few: their own numbers and those of their references meet in one row each
    own_numbers = h.groupBy("hit_tpc_id").agg(F.sum("hits").alias("n_hits"), F.sum("hit_e").cast("double").alias("energy"))
    refs = eager_join_aggregate(h, table(spark, d, "event_hits"), "hit_row", ["hit_tpc_id"], {}, "n_refs", stored="_states")
    return join_null_safe(own_numbers, refs.drop("_states"), ["hit_tpc_id"])


# ---------------------------------------------------------------- 5 drifting schemas
#: First names and types of the fields of each dataset.
HITS_FULL = {"id": "bigint", "x": "double", "y": "double", "z": "double", "E": "double", "Q": "double", "io_group": "int", "io_channel": "int", "ts_pps": "bigint", "is_disabled": "boolean", "pixel": "string"}
EXTRAS = {"n_hits": "bigint", "raw_sub_peak": "double", "raw_sub_mean": "double", "hits_evt_first": "bigint", "seed_list": "array<double>", "unit_variance": "boolean", "var_model": "string", "rel_sigma": "double"}
APPROVED = {"gain_db": "double", "board": "string"}


@query("p5_found")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return field_changes(table(spark, d, "raw_records"), HITS_FULL | EXTRAS)


def _conformed(spark: SparkSession, d: str, dataset: str, target: dict[str, str]) -> DataFrame:
    stored = table(spark, d, "raw_records").where(F.col("dataset") == dataset)
    # repeated rows change nothing about the fields of a file, and come out once
    raw = stored.dropDuplicates(["raw_id", "payload"])
    return promote(conform(raw, target, field_changes(stored, target)), APPROVED).withColumn("_rescued", F.to_json("_rescued"))


@query("p5_hits_full")
def p5_hits_full(spark: SparkSession, d: str) -> DataFrame:
    return _conformed(spark, d, "hits_full", HITS_FULL)


@query("p5_extras")
def p5_extras(spark: SparkSession, d: str) -> DataFrame:
    return _conformed(spark, d, "extras", EXTRAS)


# ---------------------------------------------------------------- 6 many small files
@query(
    "p6_found",
    """WITH c AS (SELECT shard_id, content FROM shard_files WHERE trim(content, E' \\n\\t\\r') <> ''),
l AS (SELECT shard_id, CASE WHEN json_valid(content) THEN [content] ELSE list_filter(string_split_regex(content, '\\r?\\n'), lambda x: trim(x, E' \\n\\t\\r') <> '') END AS parts FROM c),
v AS (SELECT shard_id, unnest(parts)::JSON AS v FROM l WHERE len(list_filter(parts, lambda x: NOT json_valid(x))) = 0),
r AS (SELECT unnest(CASE WHEN json_type(v) = 'ARRAY' THEN from_json(v, '["JSON"]') ELSE [v] END) AS r FROM v),
f AS (SELECT json_extract_string(r, '$.file') AS path, json_extract_string(r, '$.event_id') AS e, json_type(r, '$.event_id') AS k FROM r WHERE json_type(r) = 'OBJECT' AND json_type(r, '$.file') = 'VARCHAR')
SELECT DISTINCT regexp_replace(regexp_extract(regexp_replace(replace(path, chr(92), '/'), '/+$', ''), '[^/]*$'), '[.]hdf5$', '') AS file, TRY_CAST(e AS BIGINT) AS event_id FROM f WHERE path <> '' AND k IN ('UBIGINT', 'BIGINT', 'VARCHAR', 'DOUBLE') AND TRY_CAST(e AS BIGINT) IS NOT NULL AND (k <> 'DOUBLE' OR TRY_CAST(e AS DOUBLE) = TRY_CAST(e AS BIGINT))""",
)
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    out = consolidate_reports(table(spark, d, "shard_files"), shared_dir(spark, "reports"))
    return out.select("file", "event_id")
