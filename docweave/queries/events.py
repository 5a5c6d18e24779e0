"""Event-time queries: windows, late rows, sessions, interval joins, replays, idle threads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docweave.operators.ordering import Ordered
from docweave.queries.common import query, table
from docweave.session import shared_folder
from docweave.sources.versions import Tables
from docweave.streaming import threads
from docweave.streaming import windows as tw
from docweave.streaming.feed import Feed

DAY = 86_400_000_000
FIRST_DAY = 19_723  # 2024-01-01, in days since 1970
DELAY, WIDTH, SLIDE, GAP, TTL = "3 days", "2 days", "1 day", "6 hours", "1 day"
HALF = 15  # days of the month that arrive together

# Every eleventh event arrives nine days late, every fifth two days.
ARRIVAL_SQL = f"""
arrived AS (
  SELECT *, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents,
    (epoch_us(ts) // {DAY} - {FIRST_DAY} + CASE WHEN event_id % 11 = 0 THEN 9 WHEN event_id % 5 = 0 THEN 2 ELSE 0 END) // {HALF} AS arrival
  FROM events),
marks AS (SELECT a.arrival, max(b.us) - 3 * {DAY} AS mark FROM (SELECT DISTINCT arrival FROM arrived) a JOIN arrived b ON b.arrival < a.arrival GROUP BY 1),
placed AS (
  SELECT a.*, w, w + SPAN AS w_end, coalesce(w + SPAN <= mark, false) AS late
  FROM (SELECT *, unnest(STARTS) AS w FROM arrived) a LEFT JOIN marks USING (arrival))"""


def _windows_sql(starts: str, span: str, tail: str) -> str:
    return f"WITH {ARRIVAL_SQL.replace('STARTS', starts).replace('SPAN', span)} {tail}"


DAY_START = f"us // {DAY} * {DAY}"
CLOSED = f"""
SELECT w AS window_start, w_end AS window_end, event_type, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents
FROM placed WHERE NOT late AND w_end <= (SELECT max(us) - 3 * {DAY} FROM arrived) GROUP BY ALL"""
TUMBLING_SQL = _windows_sql(f"[{DAY_START}]", f"{DAY}", CLOSED)
SLIDING_SQL = _windows_sql(f"[{DAY_START}, {DAY_START} - {DAY}]", f"2 * {DAY}", CLOSED)
LATE_SQL = _windows_sql(f"[{DAY_START}, {DAY_START} - {DAY}]", f"2 * {DAY}", "SELECT w AS window_start, w_end AS window_end, event_type, count(*) AS n_late FROM placed WHERE late GROUP BY ALL")


def _events(spark, folder):
    """The events with the number of the arrival they come in."""
    micros = F.unix_micros("ts")
    day = F.floor(micros / DAY) - FIRST_DAY
    lag = F.when(F.col("event_id") % 11 == 0, 9).when(F.col("event_id") % 5 == 0, 2).otherwise(0)
    rows = table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withColumns({"cents": F.round(F.col("value") * 100).cast("long"), "arrival": F.floor((day + lag) / HALF), "in_order": F.floor(day / HALF)})


def _fed(spark, folder, name, by, *streams):
    """Feeds the events arrival by arrival to the streams, each built from the feed's stream; their results as tables.

    The arrivals are the few numbers that 30 days make; only they are collected.
    """
    events = _events(spark, folder)
    feed = Feed(spark, events.schema, name)
    numbers = sorted(r[0] for r in events.select(by).distinct().collect())
    for number in numbers:
        feed.arrive(events.where(F.col(by) == number))
        results = [build(feed) for build in streams]
        for at, result in enumerate(results):
            if result is not None:
                feed.run(result, f"out{at}")
    return [result if result is None else feed.output(result, f"out{at}") for at, result in enumerate(results)]


def _micros(rows, *names):
    return rows.withColumns({n: F.unix_micros(n) for n in names})


def _windowed(spark, folder, width, slide):
    build = lambda feed: tw.windows(feed.stream(), "ts", width, ["event_type"], [F.count("*").alias("n"), F.sum("cents").alias("cents")], DELAY, slide)
    return _micros(_fed(spark, folder, "windows", "arrival", build)[0], "window_start", "window_end")


@query("e_tumbling_stream", TUMBLING_SQL)
def e_tumbling_stream(spark, folder):
    """Daily counts and sums that no later event can change."""
    return _windowed(spark, folder, "1 day", None)


@query("e_sliding_stream", SLIDING_SQL)
def e_sliding_stream(spark, folder):
    return _windowed(spark, folder, WIDTH, SLIDE)


@query("e_late_rows", LATE_SQL)
def e_late_rows(spark, folder):
    """Events that came after their window was closed, per sliding window."""
    late = tw.LateRows(Tables(spark, f"{shared_folder(spark)}/late-{uuid.uuid4().hex}", 4), "ts", WIDTH, DELAY, ["event_type"], SLIDE)

    def build(feed):
        feed.run_each(late, "late")

    _fed(spark, folder, "late", "arrival", build)
    return _micros(late.counts(), "window_start", "window_end")


SESSION_SQL = f"""
WITH marked AS (
  SELECT user_id, epoch_us(ts) AS us, CAST(round(value * 100) AS BIGINT) AS cents,
    CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= {DAY // 4} THEN 0 ELSE 1 END AS fresh
  FROM events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS number FROM marked),
sessions AS (
  SELECT user_id, min(us) AS session_start, max(us) + {DAY // 4} AS session_end, count(*) AS n, CAST(sum(cents) AS BIGINT) AS cents
  FROM numbered GROUP BY user_id, number)
SELECT session_start, session_end, user_id, n, cents FROM sessions"""


def _sessions(rows, delay=None):
    return tw.sessions(rows, "ts", GAP, ["user_id"], [F.count("*").alias("n"), F.sum("cents").alias("cents")], delay)


@query("e_sessions", SESSION_SQL)
def e_sessions(spark, folder):
    return _micros(_sessions(_events(spark, folder)), "session_start", "session_end")


@query("e_sessions_stream", f"{SESSION_SQL} WHERE session_end <= (SELECT max(epoch_us(ts)) - 3 * {DAY} FROM events)")
def e_sessions_stream(spark, folder):
    """The sessions that no later event can extend; those of the boundary between two arrivals are one."""
    found = _fed(spark, folder, "sessions", "in_order", lambda feed: _sessions(feed.stream(), DELAY))
    return _micros(found[0], "session_start", "session_end")


def _pairs_sql(join: str, tail: str = "") -> str:
    return f"""
    WITH viewed AS (SELECT user_id, event_id AS view_id, epoch_us(ts) AS viewed FROM events WHERE event_type = 'view'),
    bought AS (SELECT user_id, event_id AS purchase_id, epoch_us(ts) AS bought FROM events WHERE event_type = 'purchase')
    SELECT v.user_id, view_id, viewed, purchase_id, bought FROM viewed v {join} bought b
    ON b.user_id = v.user_id AND bought BETWEEN viewed AND viewed + {DAY} {tail}"""


def _joined(rows, **options):
    left = rows.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("viewed"))
    right = rows.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase_id"), F.col("ts").alias("bought"))
    return tw.interval_join(left, right, ["user_id"], ("viewed", "bought"), "0 seconds", "1 day", row_id=["view_id"], **options)


@query("e_interval_join", _pairs_sql("JOIN"))
def e_interval_join(spark, folder):
    """Purchases within a day after a view by the same user; the bins of busy users are split."""
    return _micros(_joined(_events(spark, folder), heavy=4), "viewed", "bought")


@query("e_interval_left", _pairs_sql("LEFT JOIN"))
def e_interval_left(spark, folder):
    return _micros(_joined(_events(spark, folder), how="left", heavy=4), "viewed", "bought")


CERTAIN = f"""WHERE purchase_id IS NOT NULL OR viewed + {DAY} < (
  SELECT least(max(epoch_us(ts)) FILTER (event_type = 'view'), max(epoch_us(ts)) FILTER (event_type = 'purchase')) - 3 * {DAY} FROM events)"""


@query("e_interval_stream", _pairs_sql("LEFT JOIN", CERTAIN))
def e_interval_stream(spark, folder):
    """The same as a stream: pairs as they meet, and views that can no longer find a purchase."""
    def build(feed):
        return _joined(feed.stream(), how="left", delays=(DELAY, DELAY), parts=2)

    return _micros(_fed(spark, folder, "joined", "in_order", build)[0], "viewed", "bought")


@query("e_unique_stream", "SELECT event_id, user_id, epoch_us(ts) AS us FROM events")
def e_unique_stream(spark, folder):
    """Events that are sent again, within an arrival and in the next ones, appear once."""
    events = _events(spark, folder)
    feed = Feed(spark, events.schema, "replays")
    for number in sorted(r[0] for r in events.select("in_order").distinct().collect()):
        third = F.col("event_id") % 3 == 0
        feed.arrive(events.where(F.col("in_order") == number).unionByName(events.where((F.col("in_order") <= number) & third)))
        found = tw.unique(feed.stream(), ["event_id"], "ts", "40 days")
        feed.run(found)
    return feed.output(found).select("event_id", "user_id", F.unix_micros("ts").alias("us"))


IDLE_SQL = f"""
WITH marked AS (
  SELECT user_id, epoch_us(ts) AS us,
    CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= {DAY} THEN 0 ELSE 1 END AS fresh FROM events),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS number FROM marked),
ended AS (
  SELECT user_id AS thread, min(us) AS first_us, max(us) AS last_us, count(*) AS n_messages,
    lead(min(us)) OVER (PARTITION BY user_id ORDER BY min(us)) AS later
  FROM numbered GROUP BY user_id, number)
SELECT thread, first_us, last_us, n_messages FROM ended
WHERE later IS NOT NULL OR (last_us + {DAY}) // 1000 + 1 <= (SELECT max(epoch_us(ts)) // 1000 FROM events)"""


@query("e_idle_threads", IDLE_SQL)
def e_idle_threads(spark, folder):
    """Users' threads of messages that ended by a day without one."""
    return threads.idle_threads(_events(spark, folder), "user_id", "ts", TTL)


@query("e_idle_threads_stream", IDLE_SQL)
def e_idle_threads_stream(spark, folder):
    return _fed(spark, folder, "threads", "in_order", lambda feed: threads.idle_threads(feed.stream(), "user_id", "ts", TTL))[0]


@query(
    "e_global_order",
    """
    SELECT event_id, row_number() OVER o AS position, CAST(ntile(7) OVER o AS INT) AS tile,
           lag(event_id, 1) OVER o AS before, lead(event_id, 3) OVER o AS after, lag(value, 2) OVER o AS value_before
    FROM events WINDOW o AS (ORDER BY value DESC, event_id)""",
)
def e_global_order(spark, folder):
    """Position, n-tile and neighbours of every event in one order of all."""
    rows = table(spark, folder, "events", "event_id", "value")
    placed = Ordered(rows, [F.desc("value"), "event_id"])
    near = placed.neighbours({"before": ("event_id", -1), "after": ("event_id", 3), "value_before": ("value", -2)})
    return placed.positions().drop("value").join(placed.tiles(7).drop("value"), "event_id").join(near.drop("value"), "event_id")
