"""Run tracking: latest run, idle status, dead-run recovery, health, fold."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lotline.operators import runs as R
from lotline.sources.schemas import RUNS

NOW = dt.datetime(2026, 1, 1, 12, 0)


@pytest.fixture(scope="module")
def runs(spark):
    rows = [
        (1, "dealerrater", "completed", 150, 10, None, NOW - dt.timedelta(hours=2), NOW - dt.timedelta(hours=1), 11),
        (2, "cargurus", "completed", 200, 15, None, NOW - dt.timedelta(hours=1), NOW - dt.timedelta(minutes=30), 12),
        (3, "autotrader", "running", 50, 5, None, NOW - dt.timedelta(minutes=10), None, 999999),
    ]
    return spark.createDataFrame(rows, RUNS)


def test_latest_run(runs):
    r = R.latest(runs).collect()
    assert len(r) == 1 and r[0].platform == "autotrader" and r[0].vehicles_scraped == 50


def test_no_runs_is_idle(spark, runs):
    empty = runs.where(F.lit(False))
    platforms = spark.createDataFrame([("all",)], "platform string")
    assert R.status_report(empty, platforms).first().status == "idle"


def test_dead_run_recovered(spark, runs):
    live = spark.createDataFrame([(11,)], "pid int")
    out = {r.id: r for r in R.recover(runs, live, NOW, scope="latest").collect()}
    assert out[3].status == "failed" and "terminated unexpectedly" in out[3].error_message
    assert out[3].completed_at == NOW and out[1].status == "completed"


def test_alive_run_untouched_and_pid_less_run_never_dead(spark, runs):
    live = spark.createDataFrame([(999999,)], "pid int")
    assert {r.id: r.status for r in R.recover(runs, live, NOW).collect()}[3] == "running"
    no_pid = runs.withColumn("pid", F.lit(None).cast("int"))
    assert R.dead(no_pid, spark.createDataFrame([], "pid int")).count() == 0


def test_health_reports_pid_even_when_dead(spark, runs):
    live = spark.createDataFrame([], "pid int")
    h = {r.platform: r for r in R.health_report(runs, live, NOW).collect()}
    assert h["autotrader"].scraper_running is False and h["autotrader"].last_pid == 999999


def test_fold_events(spark):
    ev = spark.createDataFrame([
        (1, "start", NOW, "roadster", None, 5), (1, "failed", NOW + dt.timedelta(minutes=1), "roadster", "boom", 5),
        (2, "start", NOW, "dealercom", None, 6), (2, "progress", NOW + dt.timedelta(minutes=2), "dealercom", None, 6),
    ], "run_id long, kind string, ts timestamp_ntz, platform string, message string, pid int")
    out = {r.run_id: r for r in R.fold_events(ev).collect()}
    assert out[1].status == "failed" and out[1].error_message == "boom"
    assert out[2].status == "running" and out[2].completed_at is None


def test_complete_with_totals(spark, runs):
    totals = spark.createDataFrame([(3, 7, 2)], "run_id long, vehicles_scraped long, dealers_scraped long")
    out = {r.id: r for r in R.complete(runs, totals, NOW).collect()}
    assert out[3].status == "completed" and out[3].vehicles_scraped == 7 and out[3].completed_at == NOW
    assert out[1].vehicles_scraped == 150
