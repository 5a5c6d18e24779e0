"""Event-time operators: streams against tables, and what they keep in memory."""

import random
import tempfile

from pyspark.sql import functions as F

from docweave.sources.versions import Tables
from docweave.streaming import threads
from docweave.streaming import windows as tw
from docweave.streaming.feed import Feed

SCHEMA = "id long, at timestamp, user long, n long"


def events(spark, *rows):
    """(id, hour, user): a row per hour number, from hour 1000 on."""
    frame = spark.createDataFrame([(i, (1000.0 + h) * 3600, u) for i, h, u in rows], "id long, s double, user long")
    return frame.select("id", F.timestamp_seconds("s").alias("at"), "user", F.lit(1).cast("long").alias("n"))


def feed(spark, name):
    return Feed(spark, spark.createDataFrame([], SCHEMA).schema, name)


def hours(rows, *columns):
    return sorted(tuple((x.timestamp() / 3600 - 1000 if hasattr(x, "timestamp") else x) for x in (r[c] for c in columns)) for r in rows.collect())


def state_rows(progress):
    return sum(op["numRowsTotal"] for op in progress["stateOperators"])


def test_windows_close_once_and_state_is_dropped(spark):
    flow, count = feed(spark, "windows"), [F.sum("n").alias("n")]
    build = lambda: tw.windows(flow.stream(), "at", "10 hours", ["user"], count, "5 hours")
    first = [(i, i, i % 2) for i in range(40)]
    flow.arrive(events(spark, *first))
    flow.run(build())
    assert {x[0] for x in hours(flow.output(build()), "window_start", "user", "n")} == {0, 10, 20}  # 30 to 40 may still change
    flow.arrive(events(spark, (100, 9, 0), (101, 33, 0), (102, 200, 1)))  # the first is late, the second is not
    progress = flow.run(build())
    found = hours(flow.output(build()), "window_start", "user", "n")
    batch = hours(tw.windows(events(spark, *first, (101, 33, 0)), "at", "10 hours", ["user"], count), "window_start", "user", "n")
    assert found == batch and len(found) == len(set(x[:2] for x in found)) == 8
    assert state_rows(progress) == 1  # the window of hour 200


def test_late_rows_count_once(spark):
    tables = Tables(spark, f"{tempfile.mkdtemp()}/late", 4)
    late = tw.LateRows(tables, "at", "10 hours", "5 hours", ["user"])
    assert late.counts() is None
    late(events(spark, (1, 1, 0), (2, 40, 0)), 0)
    second = events(spark, (3, 2, 0), (4, 3, 0), (5, 3, 1), (6, 34, 0), (7, 80, 0))
    late(second, 1)
    expected = [(0, 0, 2), (0, 1, 1)]
    assert hours(late.counts(), "window_start", "user", "n_late") == expected
    late(second, 1)  # the same micro-batch once more
    tw.LateRows(tables, "at", "10 hours", "5 hours", ["user"])(second, 0)
    assert hours(late.counts(), "window_start", "user", "n_late") == expected
    late(second.limit(0), 2)
    late(events(spark, (8, 64, 1), (9, 66, 1)), 3)  # 60 to 70 is past, as 80 - 5 is the mark
    assert hours(late.counts(), "window_start", "user", "n_late") == [*expected, (60, 1, 2)]
    assert tables.property("batch") == 3


def test_sliding_windows_are_late_one_by_one(spark):
    late = tw.LateRows(Tables(spark, f"{tempfile.mkdtemp()}/late", 4), "at", "10 hours", "0 hours", ["user"], "5 hours")
    late(events(spark, (1, 20, 0)), 0)
    late(events(spark, (2, 12, 0)), 1)  # in 5 to 15 and in 10 to 20: both are over
    late(events(spark, (3, 17, 0)), 2)  # 10 to 20 is over, 15 to 25 is not
    assert hours(late.counts(), "window_start", "n_late") == [(5, 1), (10, 2)]


def test_sessions_merge_over_arrivals(spark):
    flow, count = feed(spark, "sessions"), [F.sum("n").alias("n")]
    build = lambda: tw.sessions(flow.stream(), "at", "3 hours", ["user"], count, "1 hour")
    rows = [(i, h, u) for i, (h, u) in enumerate([(0, 1), (2, 1), (5, 1), (9, 1), (2, 2), (11, 1), (40, 3)])]
    flow.arrive(events(spark, *rows[:3]))
    flow.run(build())
    flow.arrive(events(spark, *rows[3:]))
    progress = flow.run(build())
    found = hours(flow.output(build()), "session_start", "session_end", "user", "n")
    assert found == [(0, 8, 1, 3), (2, 5, 2, 1), (9, 14, 1, 2)]  # exactly the gap apart is one session
    whole = hours(tw.sessions(events(spark, *rows), "at", "3 hours", ["user"], count), "session_start", "session_end", "user", "n")
    assert whole == [*found, (40, 43, 3, 1)] and state_rows(progress) == 1


def test_replays_are_forgotten_in_time(spark):
    flow = feed(spark, "replays")
    build = lambda: tw.unique(flow.stream(), ["id"], "at", "10 hours")
    flow.arrive(events(spark, *[(i, i, 0) for i in range(1, 20)], (3, 3, 0), (4, 5, 0)))
    flow.run(build())
    flow.arrive(events(spark, (15, 15, 0), (16, 18, 0), (20, 20, 0)))
    flow.run(build())
    assert sorted(r.id for r in flow.output(build()).collect()) == list(range(1, 21))
    flow.arrive(events(spark, (99, 500, 0)))
    progress = flow.run(build())
    assert state_rows(progress) <= 1


def pairs(left, right, low, high, outer):
    out = []
    for i, a, k in left:
        met = [(i, j) for j, b, l in right if k is not None and k == l and low <= b - a <= high]
        out += met or ([(i, None)] if outer else [])
    return sorted(out, key=str)


def sides(rows_left, rows_right):
    return (
        rows_left.select(F.col("id").alias("left_id"), F.col("at").alias("left_at"), "user"),
        rows_right.select(F.col("id").alias("right_id"), F.col("at").alias("right_at"), "user"),
    )


def test_interval_join_with_a_hot_key(spark):
    pick = random.Random(4)
    left = [(i, pick.randrange(300) / 4, 0 if i % 3 else i % 7) for i in range(300)] + [(900, 1.0, None), (901, -30.0, 1)]
    right = [(1000 + i, pick.randrange(320) / 4, 0 if i % 3 else i % 7) for i in range(200)] + [(1900, 1.0, None), (1901, -29.0, 1)]
    a, b = sides(events(spark, *left), events(spark, *right))
    for low, high in ((0, 2), (-3, 1), (1, 5)):
        for how in ("inner", "left"):
            for heavy in (100_000, 3):
                found = tw.interval_join(a, b, ["user"], ("left_at", "right_at"), f"{low} hours", f"{high} hours", how, row_id=["left_id"], heavy=heavy)
                assert found.columns[:3] == ["left_id", "left_at", "user"] or set(found.columns) == {"left_id", "left_at", "user", "right_id", "right_at"}
                assert sorted(((r.left_id, r.right_id) for r in found.collect()), key=str) == pairs(left, right, low, high, how == "left")
    assert "CartesianProduct" not in found._jdf.queryExecution().toString() and "NestedLoop" not in found._jdf.queryExecution().toString()


def test_interval_stream_forgets(spark):
    left = [(i, i, i % 3) for i in range(0, 60, 2)]
    right = [(1000 + i, i + 0.5, i % 3) for i in range(0, 60, 3)]
    flow = feed(spark, "joined")

    def build():
        rows = flow.stream()
        a, b = sides(rows.where("id < 1000"), rows.where("id >= 1000"))
        return tw.interval_join(a, b, ["user"], ("left_at", "right_at"), "0 hours", "2 hours", "left", ("1 hour", "1 hour"), ["left_id"], parts=3)

    for bounds in ((0, 30), (30, 60)):
        inside = lambda rows: [r for r in rows if bounds[0] <= r[1] < bounds[1]]
        flow.arrive(events(spark, *inside(left), *inside(right)))
        flow.run(build())
    flow.arrive(events(spark, (500, 300, 0), (1500, 300, 0)))
    progress = flow.run(build())
    found = sorted(((r.left_id, r.right_id) for r in flow.output(build()).collect()), key=str)
    assert found == sorted(pairs(left, right, 0, 2, True) + [(500, 1500)], key=str)
    assert state_rows(progress) <= 1 + 3  # of the last hour only; the right row is in all three parts


def test_idle_threads_end_and_leave_no_state(spark):
    flow = feed(spark, "threads")
    build = lambda: threads.idle_threads(flow.stream(), "user", "at", "10 hours")
    first = [(1, 0, 7), (2, 4, 7), (3, 1, 8), (4, 30, 9), (5, 12, 7)]
    flow.arrive(events(spark, *first))
    flow.run(build())
    second = [(6, 31, 7), (7, 45, 7), (8, 46, 7), (9, 32, 9)]
    flow.arrive(events(spark, *second))
    flow.run(build())
    found = lambda: hours(flow.output(build()).selectExpr("thread", "first_us / 3600000000 - 1000 AS a", "last_us / 3600000000 - 1000 AS b", "n_messages"), "thread", "a", "b", "n_messages")
    batch = lambda *rows: hours(threads.idle_threads(events(spark, *rows), "user", "at", "10 hours").selectExpr("thread", "first_us / 3600000000 - 1000 AS a", "last_us / 3600000000 - 1000 AS b", "n_messages"), "thread", "a", "b", "n_messages")
    assert found() == batch(*first, *second) == [(7, 0, 12, 3), (7, 31, 31, 1), (8, 1, 1, 1), (9, 30, 32, 2)]
    flow.arrive(events(spark, (10, 400, 5)))
    flow.run(build())
    assert found() == batch(*first, *second, (10, 400, 5)) and (7, 45, 46, 2) in found()
    kept = spark.read.format("statestore").option("stateVarName", "thread").load(f"{flow.folder}/state-out")
    assert [r.key.thread for r in kept.collect()] == [5]
