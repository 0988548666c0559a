"""Queries that run a stream to its end; SQL over the whole table must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.registry import query
from tidemark.streaming import ledger

S = SparkSession


@query("""select user_id, run_date, event_id, value from (select user_id, cast(ts as date) as run_date, event_id, value, row_number() over (partition by user_id, cast(ts as date)
    order by case when event_type = 'view' then 1 else 0 end, event_id desc) as n from events where event_type in ('view', 'click')) where n = 1""", ratios=("value",))
def streamed_ledger(spark: S, d: str) -> DataFrame:
    """Upserts by (user, day): live beats backfilled, then the newest run."""
    kept = ledger.source(spark, d).where("event_type in ('view', 'click')").select("user_id", F.col("ts").cast("date").alias("run_date"), "event_id", "value", (F.col("event_type") == "view").alias("backfilled"))
    path = ledger.shared_dir(spark, "ledger")
    ledger.drained(kept, path)
    return ledger.current(spark, path, kept.schema, ["user_id", "run_date"], F.col("backfilled"), F.desc("event_id")).select("user_id", "run_date", "event_id", "value")


@query("select cast(date_trunc('day', ts) as date) as day, event_type, count(*) as n, sum(value) as total from events group by 1, 2", ratios=("total",))
def streamed_days(spark: S, d: str) -> DataFrame:
    """Tumbling days by kind with a watermark as long as the table's span; each update replaces the window's row."""
    days = ledger.source(spark, d).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", ledger.span(spark, d)).groupBy(F.window("at", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = days.select(F.to_date("window.start").alias("day"), "event_type", "n", "total")
    path = ledger.shared_dir(spark, "days")
    ledger.drained(flat, path, "update")
    return ledger.current(spark, path, flat.schema, ["day", "event_type"], F.desc("n"))


@query("""select user_id, event_id, right_event_id from (select a.user_id, a.event_id, b.event_id as right_event_id, row_number() over (partition by a.event_id order by b.ts desc, b.event_id desc) as n from runs_a a join runs_b b on a.user_id = b.user_id and b.ts <= a.ts and b.ts >= a.ts - interval 7 day) where n = 1""")
def streamed_pairs(spark: S, d: str) -> DataFrame:
    """Stream-stream pairs of two models' runs within seven days: every match is emitted once, the latest partner of each run is kept.

    The watermark is as long as the table's span, since a partner may come in any later file.
    """
    delay = ledger.span(spark, d)
    side = lambda kind, p: ledger.source(spark, d).where(F.col("event_type") == kind).select(F.col("user_id").alias(f"{p}_user"), F.col("event_id").alias(f"{p}_id"), F.col("ts").cast("timestamp").alias(f"{p}_at")).withWatermark(f"{p}_at", delay)
    near = F.expr("a_user = b_user and b_at <= a_at and b_at >= a_at - interval 7 days")
    matches = side("view", "a").join(side("click", "b"), near).select(F.col("a_user").alias("user_id"), F.col("a_id").alias("event_id"), F.col("b_id").alias("right_event_id"), "b_at")
    path = ledger.shared_dir(spark, "pairs")
    ledger.drained(matches, path)
    return ledger.current(spark, path, matches.schema, ["user_id", "event_id"], F.desc("b_at"), F.desc("right_event_id")).select("user_id", "event_id", "right_event_id")


@query("""select user_id, cast(date_trunc('week', ts) as date) as week, event_id, value, late from (select *, date_diff('day', cast(date_trunc('week', ts) as date), cast(ts as date)) >= 5 as late, row_number() over (partition by user_id, cast(date_trunc('week', ts) as date), date_diff('day', cast(date_trunc('week', ts) as date), cast(ts as date)) >= 5 order by ts, event_id) as n from events where event_type = 'view') where n = 1""", ratios=("value",))
def streamed_first_prints(spark: S, d: str) -> DataFrame:
    """First print of each key and week, kept once; prints past the limit go to a table of their own, so none is lost."""
    week = F.trunc("at", "week")
    prints = ledger.source(spark, d).where("event_type = 'view'").withColumn("at", F.col("ts").cast("timestamp")).select("user_id", week.alias("week"), "event_id", "value", "at", (F.datediff(F.col("at").cast("date"), week) >= 5).alias("late"))
    good, dead = ledger.shared_dir(spark, "prints"), ledger.shared_dir(spark, "dead-letters")
    ledger.drained(prints.where("not late"), good)
    ledger.drained(prints.where("late"), dead)
    first = lambda path: ledger.current(spark, path, prints.schema, ["user_id", "week"], F.col("at"), F.col("event_id"))
    return first(good).unionByName(first(dead)).select("user_id", "week", "event_id", "value", "late")


@query("""select user_id, cast(max(ts) as date) as last_day, date_diff('day', cast(max(ts) as date), (select cast(max(ts) as date) from events)) as age_days, date_diff('day', cast(max(ts) as date), (select cast(max(ts) as date) from events)) > 2 as stale from events group by user_id""")
def streamed_staleness(spark: S, d: str) -> DataFrame:
    """Last run of each key by stream, and which keys are behind the newest run by over two days: a watermark of each key's own."""
    last = ledger.source(spark, d).groupBy("user_id").agg(F.max("ts").alias("last"))
    path = ledger.shared_dir(spark, "staleness")
    ledger.drained(last, path, "update")
    now = ledger.current(spark, path, last.schema, ["user_id"], F.desc("last"))
    newest = now.agg(F.max("last").cast("date").alias("newest"))  # one row
    age = F.datediff("newest", F.col("last").cast("date")).cast("bigint")
    return now.join(F.broadcast(newest)).select("user_id", F.col("last").cast("date").alias("last_day"), age.alias("age_days"), (age > 2).alias("stale"))


@query("""select user_id, count(*) as seen, count(*) filter (v <> b or b is null) as changes, arg_max(v, n) as value, arg_max(v, n) % 3 <> 0 as provisional
    from (select user_id, cast(round(value) as bigint) as v, row_number() over w as n, lag(cast(round(value) as bigint)) over w as b from events where event_type = 'click' window w as (partition by user_id order by ts, event_id)) group by user_id""")
def streamed_states(spark: S, d: str) -> DataFrame:
    """A state machine of each key in the order of events, whatever order they come in: last value, whether it is provisional, how often it changed.

    Events wait in the state until the watermark has passed them; then they are summed up in order and dropped, by a timer where no new
    event comes. What is told meanwhile is the sum and the waiting events in their order.
    """
    import pandas as pd

    def summed(sofar: tuple, events: list) -> tuple:
        seen, changes, value = sofar
        for _, _, v in events:
            seen, changes, value = seen + 1, changes + (v != value), v
        return seen, changes, value

    def step(key, batches, state):  # noqa: ANN001, ANN202
        seen, changes, value, at, ids, vs = state.get if state.exists else (0, 0, None, [], [], [])
        waiting = list(zip(at, ids, vs, strict=True))
        if not state.hasTimedOut:
            for b in batches:
                waiting += zip((b["at"].astype("datetime64[ns]").astype("int64") // 1000).tolist(), b["event_id"].tolist(), b["v"].tolist(), strict=True)
        waiting.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        done = [e for e in waiting if e[0] < passed]
        sofar, waiting = summed((seen, changes, value), done), waiting[len(done) :]
        state.update((*sofar, *([e[k] for e in waiting] for k in range(3))))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0], passed) // 1000 + 1)
        seen, changes, value = summed(sofar, waiting)
        yield pd.DataFrame({"user_id": [key[0]], "seen": [seen], "changes": [changes], "value": [int(value)], "provisional": [value % 3 != 0]})

    clicks = ledger.source(spark, d).where("event_type = 'click'").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", ledger.span(spark, d)).select("user_id", "event_id", "at", F.round("value").cast("bigint").alias("v"))
    out = "user_id bigint, seen bigint, changes bigint, value bigint, provisional boolean"
    kept = "seen bigint, changes bigint, value bigint, at array<bigint>, ids array<bigint>, vs array<bigint>"
    states = clicks.groupBy("user_id").applyInPandasWithState(step, out, kept, "update", "EventTimeTimeout")
    path = ledger.shared_dir(spark, "states")
    ledger.drained(states, path, "update")
    return ledger.current(spark, path, states.schema, ["user_id"], F.desc("seen"))


@query("""select cast(w as date) as start, event_type, count(*) as n from (select unnest([date_trunc('day', ts) - interval 1 day, date_trunc('day', ts)]) as w, event_type from events) group by 1, 2""")
def streamed_sliding(spark: S, d: str) -> DataFrame:
    """Windows of two days that slide by one, by kind of run."""
    n = ledger.source(spark, d).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", ledger.span(spark, d)).groupBy(F.window("at", "2 days", "1 day"), "event_type").agg(F.count("*").alias("n"))
    flat = n.select(F.to_date("window.start").alias("start"), "event_type", "n")
    path = ledger.shared_dir(spark, "sliding")
    ledger.drained(flat, path, "update")
    return ledger.current(spark, path, flat.schema, ["start", "event_type"], F.desc("n"))
