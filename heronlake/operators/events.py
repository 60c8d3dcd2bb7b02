"""Job events folded to state, and change detection between two versions of a paper's structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Progress of each stage in per cent; a fixed table.
STAGE_PROGRESS = {"queued": 0, "blueprint_verification": 10, "rag_retrieval": 25, "image_grounding": 40, "slot_generation": 60, "quality_validation": 80, "targeted_regeneration": 85, "paper_assembled": 95, "completed": 100, "failed": 100, "cancelled": 100}
TERMINAL = ("completed", "failed", "cancelled")


def stage_percent(stage):
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in STAGE_PROGRESS.items() for x in kv]), stage)


def job_progress(events: DataFrame) -> DataFrame:
    """job_id, event_id, progress: the stage's share of each event, never falling within a job, 100 at an end."""
    w = Window.partitionBy("job_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    own = F.coalesce(stage_percent(F.col("stage")), F.lit(0))
    return events.select("job_id", "event_id", F.greatest(F.lit(0), F.least(F.lit(100), F.max(own).over(w))).alias("progress"))


def latest_progress(events: DataFrame) -> DataFrame:
    """job_id, progress after all events: one pre-aggregated maximum, however many events a job has."""
    return events.groupBy("job_id").agg(F.max(F.coalesce(stage_percent(F.col("stage")), F.lit(0))).alias("progress"))


def job_state(events: DataFrame) -> DataFrame:
    """job_id, status, started_at, completed_at, events: the first end sticks; later events of a cancelled job do not count."""
    end = F.col("stage").isin(*TERMINAL)
    ends = events.where(end).groupBy("job_id").agg(F.min(F.struct("event_id", "stage", "ts")).alias("e"))
    e = events.join(ends, "job_id", "left").withColumn("counts", F.col("e").isNull() | (F.col("e.stage") != "cancelled") | (F.col("event_id") <= F.col("e.event_id")))
    g = e.groupBy("job_id").agg(F.first("e.stage").alias("end"), F.first("e.ts").alias("completed_at"), F.min("ts").alias("started_at"), F.count_if("counts").alias("events"))
    return g.select("job_id", F.coalesce("end", F.lit("running")).alias("status"), "started_at", "completed_at", "events")


def slot_state(events: DataFrame) -> DataFrame:
    """job_id, slot, status, event_id, regenerate: the latest event of each slot; an accepted one is not replaced."""
    accepted = F.col("status").isin("accepted", "completed")
    g = events.groupBy("job_id", "slot").agg(F.max(F.struct(accepted.alias("accepted"), "event_id", "status")).alias("m"))
    return g.select("job_id", "slot", F.when(F.col("m.accepted"), "accepted").otherwise(F.col("m.status")).alias("status"), F.col("m.event_id").alias("event_id"), (~F.col("m.accepted")).alias("regenerate"))


def last_events(events: DataFrame, n: int = 50) -> DataFrame:
    """The last ``n`` events of each job; the rank limit is applied before the shuffle as well."""
    w = Window.partitionBy("job_id").orderBy(F.desc("event_id"))
    return events.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def replay_since(events: DataFrame, cursors: DataFrame, n: int = 50) -> DataFrame:
    """consumer, job_id, event_id: buffered events after each consumer's last id; an id of 0 or less asks for all."""
    return last_events(events, n).join(cursors, "job_id").where((F.col("last_id") <= 0) | (F.col("event_id") > F.col("last_id"))).select("consumer", "job_id", "event_id")


def dedupe_events(events: DataFrame) -> DataFrame:
    return events.dropDuplicates(["job_id", "event_id"])


def run_metrics(events: DataFrame) -> DataFrame:
    """job_id, stage, ms, n."""
    return events.groupBy("job_id", "stage").agg(F.round(F.sum("ms"), 4).alias("ms"), F.count("*").alias("n"))


def request_rate(events: DataFrame, client: str, limit: int, seconds: int = 60) -> DataFrame:
    """client, window_start, n of fixed windows with more than ``limit`` events."""
    g = events.groupBy(F.col(client).alias("client"), F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count("*").alias("n"))
    return g.where(F.col("n") > limit).select("client", F.col("w.start").alias("window_start"), "n")


def expire_jobs(jobs: DataFrame, now, ttl_seconds: int = 1800) -> DataFrame:
    """Jobs touched within the time to live before ``now``."""
    return jobs.where(F.col("updated_at") >= F.timestamp_seconds(F.unix_timestamp(now) - ttl_seconds))


def stage_durations(events: DataFrame) -> DataFrame:
    """job_id, event_id, stage, seconds until the job's next event; null at the last."""
    w = Window.partitionBy("job_id").orderBy("event_id")
    return events.select("job_id", "event_id", "stage", F.round((F.unix_micros(F.lead("ts").over(w).cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6, 3).alias("seconds"))


def slot_fingerprint(slots: DataFrame, items: DataFrame, assignments: DataFrame) -> DataFrame:
    """slot_id, fingerprint: JSON of section, total, item count, item marks (0.1), unit and item units."""
    m = items.groupBy("slot_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("item_index", F.round("marks", 1).alias("marks")))), lambda x: x["marks"].cast("string")).alias("item_marks"))
    a = assignments.groupBy("slot_id").agg(F.max(F.when(F.col("item_index").isNull(), F.col("unit"))).alias("unit"), F.array_sort(F.collect_list(F.when(F.col("item_index").isNotNull(), F.concat_ws("=", "item_index", "unit")))).alias("item_units"))
    j = slots.join(m, "slot_id", "left").join(a, "slot_id", "left")
    marks = F.coalesce("item_marks", F.array().cast("array<string>"))
    return j.select("slot_id", F.to_json(F.struct("section", F.col("total_marks").cast("string").alias("total"), F.size(marks).alias("items"), marks.alias("marks"), F.coalesce("unit", F.lit("")).alias("unit"), F.coalesce("item_units", F.array().cast("array<string>")).alias("item_units"))).alias("fingerprint"))


def stale_slots(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys of ``new`` whose fingerprint differs from or is absent in ``old``; without an old version nothing is stale."""
    any_old = old.agg(F.count("*").alias("n_old"))  # one row
    o = old.select("slot_id", F.col("fingerprint").alias("before"))
    return new.join(o, "slot_id", "left").crossJoin(F.broadcast(any_old)).where("n_old > 0 AND NOT fingerprint <=> before").select("slot_id")


def unit_stale(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys on either side whose sorted (item, unit) entries differ."""
    entries = lambda df, c: df.groupBy("slot_id").agg(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce(F.col("item_index").cast("string"), F.lit("")), F.trim("unit")))).alias(c))
    return entries(old, "a").join(entries(new, "b"), "slot_id", "full_outer").where("NOT a <=> b").select("slot_id")


def staleness_report(structure: DataFrame, units: DataFrame, topics: DataFrame) -> DataFrame:
    """slot_id, reasons of all slots that any of the three lists names."""
    rows = None
    for name, df in (("structure", structure), ("topic", topics), ("unit", units)):
        one = df.select("slot_id", F.lit(name).alias("why")).distinct()
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("slot_id").agg(F.array_join(F.sort_array(F.collect_set("why")), ", ").alias("reasons"))
