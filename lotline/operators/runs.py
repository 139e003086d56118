"""Ingest-run tracking: latest run, recent runs, liveness joins, dead-run
recovery, per-platform status and health, and a fold of run events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schemas import RUNS

RUN_COLUMNS = [f.name for f in RUNS.fields]


def latest(runs: DataFrame, by: str | None = None) -> DataFrame:
    """Latest run (greatest started_at, then id) overall, or per ``by`` group.

    ``max_by`` is a partial aggregate: no global sort, one row per group."""
    cols = [c for c in runs.columns if c != by]
    pick = F.max_by(F.struct(*cols), F.struct("started_at", "id")).alias("_r")
    if by is None:
        return runs.agg(pick).where(F.col("_r").isNotNull()).select("_r.*")
    return runs.groupBy(by).agg(pick).select(by, *[F.col("_r." + c).alias(c) for c in cols])


def recent(runs: DataFrame, n: int = 10) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(n)


def with_status(runs: DataFrame, status: str) -> DataFrame:
    return runs.where(F.col("status") == F.lit(status))


def without_pid(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("pid").isNull())


def _checkable(runs: DataFrame) -> DataFrame:
    """Runs whose liveness can be tested: running with a set, non-zero pid.
    (A run without a pid is never considered dead.)"""
    return runs.where((F.col("status") == "running") & F.col("pid").isNotNull() & (F.col("pid") != 0))


def dead(runs: DataFrame, live: DataFrame) -> DataFrame:
    """Running runs whose process is gone (anti join on pid)."""
    return _checkable(runs).join(live.select("pid"), "pid", "left_anti").select(*runs.columns)


def alive(runs: DataFrame, live: DataFrame) -> DataFrame:
    return _checkable(runs).join(live.select("pid"), "pid", "left_semi").select(*runs.columns)


def recover(runs: DataFrame, live: DataFrame, as_of, scope: str = "latest") -> DataFrame:
    """Mark running runs with a dead process as failed.

    scope='latest': only the latest run is repaired (the reference rule);
    scope='all': every run.  Repaired rows get status 'failed', the message
    'Process {pid} terminated unexpectedly' and completed_at = as_of."""
    as_of = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    live_pids = live.select("pid").distinct().withColumn("_alive", F.lit(True))
    r = runs
    if scope == "latest":
        # Equi-join on the id of the latest run (a one-row side), not a cross join.
        last_id = latest(runs).select(F.col("id"), F.lit(True).alias("_in_scope"))
        r = r.join(last_id, "id", "left").withColumn("_in_scope", F.coalesce("_in_scope", F.lit(False)))
    elif scope == "all":
        r = r.withColumn("_in_scope", F.lit(True))
    else:
        raise ValueError("scope must be 'latest' or 'all'")
    r = r.join(live_pids, "pid", "left")
    is_dead = (F.col("_in_scope") & (F.col("status") == "running") & F.col("pid").isNotNull()
               & (F.col("pid") != 0) & F.col("_alive").isNull())
    return r.select(
        *[F.when(is_dead, F.lit("failed")).otherwise(F.col("status")).alias(c) if c == "status" else
          F.when(is_dead, F.format_string("Process %d terminated unexpectedly", F.col("pid")))
           .otherwise(F.col("error_message")).alias(c) if c == "error_message" else
          F.when(is_dead, as_of).otherwise(F.col("completed_at")).alias(c) if c == "completed_at" else
          F.col(c) for c in runs.columns])


def status_report(runs: DataFrame, platforms: DataFrame) -> DataFrame:
    """Latest run per platform; platforms without any run report 'idle'."""
    last = latest(runs, by="platform")
    out = platforms.select("platform").distinct().join(last, "platform", "left")
    return out.select("platform", F.coalesce(F.col("status"), F.lit("idle")).alias("status"),
                      F.col("id").alias("run_id"), "pid", "started_at", "completed_at",
                      "vehicles_scraped", "dealers_scraped", "error_message")


def health_report(runs: DataFrame, live: DataFrame, as_of) -> DataFrame:
    """Latest run per platform with a running flag from the live-process table.
    The pid is reported even when the process is gone."""
    as_of = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    last = latest(runs, by="platform")
    live_pids = live.select("pid").distinct().withColumn("_alive", F.lit(True))
    j = last.join(live_pids, "pid", "left")
    running = (F.col("status") == "running") & F.col("pid").isNotNull() & (F.col("pid") != 0)
    return j.select(
        "platform",
        F.coalesce(running & F.col("_alive"), F.lit(False)).alias("scraper_running"),
        F.when(running, F.col("pid")).alias("scraper_pid"),
        F.col("id").alias("last_id"), F.col("started_at").alias("last_started_at"),
        F.col("status").alias("last_status"), F.col("pid").alias("last_pid"),
        as_of.alias("checked_at"))


def fold_events(events: DataFrame) -> DataFrame:
    """Fold a run-event stream (start / progress / failed / completed) into run state.

    started_at: first event; status: from the last terminal event, 'running'
    while there is none (of events at one time the greater value counts); error_message: message of the last failure;
    completed_at: time of the last terminal event."""
    terminal = F.col("kind").isin("failed", "completed")
    g = events.groupBy("run_id").agg(
        F.min("ts").alias("started_at"),
        F.max_by(F.col("platform"), F.struct("ts", "platform")).alias("platform"),
        F.max_by(F.when(terminal, F.col("kind")), F.when(terminal, F.struct("ts", "kind"))).alias("_last_terminal"),
        F.max(F.when(terminal, F.col("ts"))).alias("completed_at"),
        F.max_by(F.when(F.col("kind") == "failed", F.col("message")),
                 F.when(F.col("kind") == "failed", F.struct("ts", "message"))).alias("error_message"),
        F.max_by(F.col("pid"), F.struct("ts", "pid")).alias("pid"),
        F.count(F.lit(1)).alias("n_events"))
    return g.select("run_id", "platform",
                    F.coalesce(F.col("_last_terminal"), F.lit("running")).alias("status"),
                    "started_at", "completed_at", "error_message", "pid", "n_events")


def totals(sightings: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Per-run totals from the data itself: distinct vehicles and dealers."""
    return sightings.groupBy(run_col).agg(F.count_distinct("vin").alias("vehicles_scraped"),
                                          F.count_distinct("dealer").alias("dealers_scraped"))


def complete(runs: DataFrame, totals: DataFrame, as_of) -> DataFrame:
    """Mark running runs that have totals as completed: counters from the
    totals (computed from the data), completed_at = as_of."""
    as_of = F.lit(as_of).cast("timestamp_ntz") if not isinstance(as_of, Column) else as_of
    t = totals.select(F.col("run_id").alias("id"), F.col("vehicles_scraped").alias("_v"),
                      F.col("dealers_scraped").alias("_d"), F.lit(True).alias("_has"))
    j = runs.join(t, "id", "left")
    done = (F.col("status") == "running") & F.coalesce(F.col("_has"), F.lit(False))
    repl = {
        "status": F.when(done, F.lit("completed")).otherwise(F.col("status")),
        "vehicles_scraped": F.when(done, F.col("_v").cast("int")).otherwise(F.col("vehicles_scraped")),
        "dealers_scraped": F.when(done, F.col("_d").cast("int")).otherwise(F.col("dealers_scraped")),
        "completed_at": F.when(done, as_of).otherwise(F.col("completed_at")),
    }
    return j.select(*[repl.get(c, F.col(c)).alias(c) for c in runs.columns])
