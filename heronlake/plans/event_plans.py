"""Queries of job events, change detection and their streams (W)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from heronlake.operators import events as W
from heronlake.plans.base import query
from heronlake.plans.store_plans import _scratch
from heronlake.plans.tables import as_job_events, job_events, slot_items, slots, table, with_tables
from heronlake.streaming import progress as P

_PCT = "CASE stage " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in W.STAGE_PROGRESS.items()) + " ELSE 0 END"


@query("w06_job_progress", sql=with_tables("job_events", then=f"SELECT job_id, event_id, max({_PCT}) OVER (PARTITION BY job_id ORDER BY event_id) AS progress FROM job_events"))
def w06(spark, sf):
    return W.job_progress(job_events(spark, sf))


_STATE = "en AS (SELECT job_id, arg_min(stage, event_id) AS status, arg_min(ts, event_id) AS completed_at FROM job_events WHERE stage IN ('completed', 'failed') GROUP BY job_id)"


@query("w07_job_state", sql=with_tables("job_events", then=f", {_STATE} SELECT job_id, coalesce(any_value(status), 'running') AS status, min(ts) AS started_at, any_value(completed_at) AS completed_at, count(*) AS events FROM job_events LEFT JOIN en USING (job_id) GROUP BY job_id"))
def w07(spark, sf):
    return W.job_state(job_events(spark, sf))


@query("w08_slot_state", sql=with_tables("job_events", then="SELECT job_id, slot, CASE WHEN a THEN 'accepted' ELSE status END AS status, event_id, NOT a AS regenerate FROM (SELECT *, row_number() OVER (PARTITION BY job_id, slot ORDER BY a DESC, event_id DESC) AS k FROM (SELECT *, event_type = 'purchase' AS a, event_type AS status FROM job_events)) WHERE k = 1"))
def w08(spark, sf):
    e = job_events(spark, sf)
    return W.slot_state(e.withColumn("status", F.when(F.col("event_type") == "purchase", "completed").otherwise(F.col("event_type"))))


@query("w09_last_events", sql=with_tables("job_events", then="SELECT job_id, event_id, stage FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) <= 50"))
def w09(spark, sf):
    return W.last_events(job_events(spark, sf)).select("job_id", "event_id", "stage")


@query("w10_replay_since", sql=with_tables("job_events", then="SELECT 'c' || job_id AS consumer, job_id, event_id FROM (SELECT * FROM job_events QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY event_id DESC) <= 50) WHERE job_id % 3 = 0 OR event_id > 8000"))
def w10(spark, sf):
    e = job_events(spark, sf)
    cursors = e.select("job_id").distinct().select("job_id", F.concat(F.lit("c"), F.col("job_id").cast("string")).alias("consumer"), F.when(F.col("job_id") % 3 == 0, 0).otherwise(8000).alias("last_id"))
    return W.replay_since(e, cursors)


@query("w11_dedupe_events", sql=with_tables("job_events", then="SELECT job_id, event_id FROM job_events"))
def w11(spark, sf):
    e = job_events(spark, sf)
    return W.dedupe_events(e.unionByName(e.where("event_id % 2 = 0"))).select("job_id", "event_id")


@query("w11_dedupe_stream", sql=with_tables("job_events", then="SELECT job_id, event_id FROM job_events"))
def w11s(spark, sf):
    stream = as_job_events(P.read_events(spark, f"{sf}/events.parquet"))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return P.drain(P.dedupe(twice), "dedupe", _scratch(spark, "stream"), "append").select("job_id", "event_id")


@query("w12_run_metrics", sql=with_tables("job_events", then="SELECT job_id, stage, round(sum(ms), 4) AS ms, count(*) AS n FROM job_events GROUP BY ALL"))
def w12(spark, sf):
    return W.run_metrics(job_events(spark, sf))


@query("w13_request_rate", sql="SELECT event_type AS client, time_bucket(INTERVAL 60 SECONDS, ts) AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def w13(spark, sf):
    return W.request_rate(table(spark, sf, "events"), "event_type", 1)


@query("w14_expire_jobs", sql="WITH j AS (SELECT user_id AS job_id, max(ts) AS updated_at FROM events GROUP BY 1) SELECT job_id, updated_at FROM j WHERE updated_at >= TIMESTAMP '2024-01-30 20:00:00' - INTERVAL 30 MINUTES")
def w14(spark, sf):
    jobs = table(spark, sf, "events").groupBy(F.col("user_id").alias("job_id")).agg(F.max("ts").alias("updated_at"))
    return W.expire_jobs(jobs, F.lit("2024-01-30 20:00:00").cast("timestamp"))


@query("w14_expire_stream", sql="SELECT user_id AS job_id, max(event_id) AS last_event_id FROM events GROUP BY 1")
def w14s(spark, sf):
    rows = P.drain(P.expiring_stream(as_job_events(P.read_events(spark, f"{sf}/events.parquet"))), "expire", _scratch(spark, "stream"), once=True)
    return rows.groupBy("job_id").agg(F.max("last_event_id").alias("last_event_id"))


@query("w15_stage_durations", sql=with_tables("job_events", then="SELECT job_id, event_id, stage, round((epoch_us(lead(ts) OVER (PARTITION BY job_id ORDER BY event_id)) - epoch_us(ts)) / 1e6, 3) AS seconds FROM job_events"))
def w15(spark, sf):
    return W.stage_durations(job_events(spark, sf))


@query("w16_progress_stream", sql=with_tables("job_events", then=f", {_STATE} SELECT job_id, max({_PCT}) AS progress, coalesce(any_value(status), 'running') AS status, count(*) AS events FROM job_events LEFT JOIN en USING (job_id) GROUP BY job_id"))
def w16(spark, sf):
    rows = P.drain(P.progress_stream(as_job_events(P.read_events(spark, f"{sf}/events.parquet"))), "progress", _scratch(spark, "stream"))
    last = Window.partitionBy("job_id").orderBy(F.desc("events"))
    return rows.withColumn("k", F.row_number().over(last)).where("k = 1").select("job_id", "progress", "status", "events")


def _versions(spark, sf):
    """Two versions of the slots: items changed, dropped and added."""
    s, i = slots(spark, sf), slot_items(spark, sf)
    a = s.select("slot_id", F.lit(None).cast("long").alias("item_index"), F.concat(F.lit("U"), (F.col("slot_id") % 4).cast("string")).alias("unit"))
    new_items = i.where("NOT (slot_id % 11 = 0 AND item_index = 1)").withColumn("marks", F.when(F.col("slot_id") % 7 == 0, F.col("marks") + 1).otherwise(F.col("marks")))
    new_a = a.withColumn("unit", F.when(F.col("slot_id") % 13 == 0, "U9").otherwise(F.col("unit")))
    return W.slot_fingerprint(s, i, a), W.slot_fingerprint(s, new_items, new_a), a, new_a


_CHANGED = "(slot_id % 7 = 0 AND (n > 1 OR (n = 1 AND slot_id % 11 <> 0)) OR slot_id % 11 = 0 AND n > 0 OR slot_id % 13 = 0)"
_COUNTED = "c AS (SELECT s.slot_id, count(i.slot_id) AS n FROM slots s LEFT JOIN slot_items i USING (slot_id) GROUP BY 1)"


@query("w01_slot_fingerprint", sql=with_tables("slots", "slot_items", then=""", m AS (SELECT slot_id, list(CAST(marks AS VARCHAR) ORDER BY item_index) AS l FROM slot_items GROUP BY 1)
    SELECT slot_id, sha256('{"section":"' || section || '","total":"' || CAST(total_marks AS VARCHAR) || '","items":' || len(coalesce(l, [])) || ',"marks":[' || coalesce(array_to_string(list_transform(l, lambda x: '"' || x || '"'), ','), '') || '],"unit":"U' || (slot_id % 4) || '","item_units":[]}') AS fingerprint FROM slots LEFT JOIN m USING (slot_id)"""))
def w01(spark, sf):
    old, _, _, _ = _versions(spark, sf)
    return old.select("slot_id", F.sha2("fingerprint", 256).alias("fingerprint"))


@query("w02_stale_slots", sql=with_tables("slots", "slot_items", then=f", {_COUNTED} SELECT slot_id FROM c WHERE {_CHANGED}"))
def w02(spark, sf):
    old, new, _, _ = _versions(spark, sf)
    return W.stale_slots(old, new)


@query("w03_unit_stale", sql=with_tables("slots", then="SELECT slot_id FROM slots WHERE slot_id % 13 = 0"))
def w03(spark, sf):
    _, _, a, new_a = _versions(spark, sf)
    return W.unit_stale(a, new_a)


@query("w04_staleness_report", sql=with_tables("slots", "slot_items", then=f", {_COUNTED} SELECT slot_id, concat_ws(', ', CASE WHEN {_CHANGED} THEN 'structure' END, CASE WHEN slot_id % 17 = 0 THEN 'topic' END, CASE WHEN slot_id % 13 = 0 THEN 'unit' END) AS reasons FROM c WHERE {_CHANGED} OR slot_id % 17 = 0 OR slot_id % 13 = 0"))
def w04(spark, sf):
    old, new, a, new_a = _versions(spark, sf)
    return W.staleness_report(W.stale_slots(old, new), W.unit_stale(a, new_a), slots(spark, sf).where("slot_id % 17 = 0"))
