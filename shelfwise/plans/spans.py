"""Queries over nearness and overlap: lots that expire near each other, episodes and flags against events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mining, relational
from ..operators.intervals import band_join, overlap_join
from ..operators.reports import run_sql
from ..sources.roles import roles
from .views import Mart

#: Days that lots expire apart at most; days of a bucket of episodes.
NEAR, WIDTH = 30, 28


def j10_lots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of lots of a site and item that expire within 30 days of each other."""
    lots = Mart(roles(spark, sf_dir)).table("v_expiry")
    side = lambda x: lots.select("site", "item_key", F.col("batch_id").alias(f"batch_{x}"), F.col("days_to_expiry").alias(f"days_{x}"))
    return band_join(side("a"), side("b"), ["site", "item_key"], "days_a", "days_b", NEAR).where("batch_a < batch_b").select("site", "batch_a", "batch_b")


def j10_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes and events of a series that overlap, and whether they are of one kind."""
    mart = Mart(roles(spark, sf_dir))
    episodes = run_sql(spark, mart, f"select site, maker, anomaly_type, episode, first_day, last_day from {mining.SERIES_EPISODES} e where grain = 'site_maker'")
    events = run_sql(spark, mart, f"select site, maker, event_type, start_day, end_day from {mining.EVENTS} e")
    met = overlap_join(episodes, events, ["site", "maker"], ("first_day", "last_day"), ("start_day", "end_day"), WIDTH)
    return met.select("site", "maker", "anomaly_type", "episode", "event_type", "start_day", (F.col("anomaly_type") == F.col("event_type")).alias("same_kind"))


def j11_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagged days that lie in an event's window."""
    mart = Mart(roles(spark, sf_dir))
    flags = run_sql(spark, mart, f"select site, maker, day_no, spike, drop_flag, stockout_onset from ({mining.TEXTS['N9']}) n where grain = 'site_maker'").withColumn("until", F.col("day_no"))
    events = run_sql(spark, mart, f"select site, maker, event_type, start_day, end_day from {mining.EVENTS} e")
    return overlap_join(flags, events, ["site", "maker"], ("day_no", "until"), ("start_day", "end_day"), WIDTH).select("site", "maker", "day_no", "spike", "drop_flag", "stockout_onset", "event_type", "start_day")


QUERIES = {"J10_near_lots": j10_lots, "J10_episodes": j10_episodes, "J11_flags": j11_flags}
SQL = {
    "J10_near_lots": relational.TEXTS["J10"],
    "J10_episodes": f"""select x.site, x.maker, x.anomaly_type, x.episode, e.event_type, e.start_day, x.anomaly_type = e.event_type as same_kind from {mining.EPISODES} x
      join {mining.EVENTS} e on e.site = x.site and e.maker = x.maker and x.first_day <= e.end_day and x.last_day >= e.start_day where x.grain = 'site_maker'""",
    "J11_flags": f"""select f.site, f.maker, f.day_no, f.spike, f.drop_flag, f.stockout_onset, e.event_type, e.start_day from ({mining.TEXTS['N9']}) f
      join {mining.EVENTS} e on e.site = f.site and e.maker = f.maker and f.day_no between e.start_day and e.end_day where f.grain = 'site_maker'""",
}
