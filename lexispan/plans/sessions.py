"""Histories, favourites and bursts over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import session
from .registration import load, query


@query("""WITH e AS (SELECT user_id, event_id, ts, CASE WHEN event_id % 2 = 0 THEN upper(event_type) ELSE event_type END || CAST(CAST(value AS INTEGER) % 4 AS VARCHAR) AS q FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, lower(q) ORDER BY ts DESC, event_id DESC) AS n FROM e), p AS (SELECT user_id, q, ts, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS place FROM l WHERE n = 1)
SELECT user_id, q, place FROM p WHERE place <= 8""")
def q2_history(spark, sf_dir):
    q = F.concat(F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")), (F.bround("value").cast("int") % 4).cast("string"))
    log = load(spark, sf_dir, "events").select("user_id", "event_id", "ts", q.alias("q"))
    return session.history(log, "user_id", "q", "ts", "event_id").select("user_id", "q", "place")


@query("SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def u6_toggles(spark, sf_dir):
    return session.toggled_on(load(spark, sf_dir, "events"), "user_id", "event_type")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT user_id FROM events WHERE event_type = 'view' GROUP BY user_id HAVING count(*) % 2 = 1)")
def q3_favourites(spark, sf_dir):
    """Entries whose favourite mark is on."""
    on = session.toggled_on(load(spark, sf_dir, "events").where("event_type = 'view'").select("user_id"), "user_id")
    return load(spark, sf_dir, "part").select("p_partkey", "p_name").join(on.withColumnRenamed("user_id", "p_partkey"), "p_partkey", "left_semi")


@query("SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NULL OR nxt > ts + INTERVAL 2 HOUR")
def q5_debounce(spark, sf_dir):
    """The last event of each burst, with a gap of two hours."""
    return session.settled(load(spark, sf_dir, "events"), "user_id", "ts", "event_id", "2 hours").select("event_id", "user_id")
