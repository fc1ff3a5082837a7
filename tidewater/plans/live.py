"""Queries on the journal of a live session: totals, rankings, budgets, limiters, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators import folds
from tidewater.plans.base import query, records
from tidewater.streaming import journal
from tidewater.tables import load

_EV = "ev as (select distinct * from live_events)"
_COLUMNS = ["event_type", "timestamp", "room_id", "uid", "uname", "gift_name", "num", "coin_type", "total_coin", "cny_value", "price"]
_TOTALS = """count(*) filter (where event_type = 'danmaku') as messages, count(distinct uid) filter (where event_type = 'danmaku' and uid > 0) as senders,
 round(coalesce(sum(cny_value) filter (where event_type = 'gift' and coin_type = 'gold'), 0), 2) as gold, coalesce(sum(total_coin) filter (where event_type = 'gift' and coin_type is distinct from 'gold'), 0)::bigint as silver,
 round(coalesce(sum(price) filter (where event_type = 'super_chat'), 0), 2) as super_chats, round(coalesce(sum(cny_value) filter (where event_type = 'guard'), 0), 2) as guards,
 round(coalesce(sum(cny_value) filter (where event_type = 'gift' and coin_type = 'gold'), 0) + coalesce(sum(price) filter (where event_type = 'super_chat'), 0) + coalesce(sum(cny_value) filter (where event_type = 'guard'), 0), 2) as worth"""


def totals() -> list:
    """Aggregates of a session in one pass: counts and sums by kind of event, rounded once from the full sums."""
    kind = F.col("event_type")
    total = lambda x, when: F.coalesce(F.sum(F.when(when, F.col(x))), F.lit(0.0))
    gold = total("cny_value", (kind == "gift") & (F.col("coin_type") == "gold"))
    chats, guards = total("price", kind == "super_chat"), total("cny_value", kind == "guard")
    silver = F.sum(F.when((kind == "gift") & ~F.col("coin_type").eqNullSafe("gold"), F.col("total_coin")))
    return [
        F.count_if(kind == "danmaku").alias("messages"), F.count_distinct(F.when((kind == "danmaku") & (F.col("uid") > 0), F.col("uid"))).alias("senders"),
        F.round(gold, 2).alias("gold"), F.coalesce(silver, F.lit(0)).alias("silver"), F.round(chats, 2).alias("super_chats"),
        F.round(guards, 2).alias("guards"), F.round(gold + chats + guards, 2).alias("worth"),
    ]


@query(f"with {_EV} select room_id, {_TOTALS} from ev group by room_id")
def live_summary(spark, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "live_events", *_COLUMNS).groupBy("room_id").agg(*totals())


@query(f"with {_EV} select {_TOTALS} from ev")
def live_totals(spark, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir, "live_events", *_COLUMNS).agg(*totals())


_TOP = "select room_id, {what}, n from (select *, row_number() over (partition by room_id order by n desc, first) rn from (select room_id, {what}, {count} n, min(seq) first from ev where {when} group by all)) where rn <= 10"


def _top(rows: DataFrame, what: str, count) -> DataFrame:
    """The ten largest of each room, the first to appear among equals."""
    ranked = rows.groupBy("room_id", what).agg(count.alias("n"), F.min("seq").alias("first"))
    w = Window.partitionBy("room_id").orderBy(F.desc("n"), "first")
    return ranked.withColumn("rn", F.row_number().over(w)).filter("rn <= 10").select("room_id", what, "n")


@query(f"with {_EV} " + _TOP.format(what="uname", count="count(*)", when="event_type = 'danmaku' and uname <> ''"))
def top_chatters(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "live_events", "event_type", "room_id", "uname", where="event_type = 'danmaku' and uname <> ''")
    return _top(rows, "uname", F.count("*"))


@query(f"with {_EV} " + _TOP.format(what="gift_name", count="sum(num)::bigint", when="event_type = 'gift'"))
def top_gifts(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "live_events", "event_type", "room_id", "gift_name", "num", where="event_type = 'gift'")
    return _top(rows, "gift_name", F.sum("num"))


@query(f"with {_EV} select seq, guard_level, unit from ev where event_type = 'guard' and uid <> 0")
def live_guard_sales(spark, sf_dir: str) -> DataFrame:
    """Guards that were bought; giveaways, here those without a buyer, are suppressed."""
    return records(spark, sf_dir, "live_events", "event_type", "uid", "guard_level", "unit", where="event_type = 'guard' and uid <> 0").select("seq", "guard_level", "unit")


_LIST = "(select room_id, string_agg({what} || ' x ' || n, '; ' order by n desc, first) tops from (select *, row_number() over (partition by room_id order by n desc, first) rn from (select room_id, {what}, {count} n, min(seq) first from ev where {when} group by all)) where rn <= 10 group by room_id)"
_CHATTERS = _LIST.format(what="uname", count="count(*)", when="event_type = 'danmaku' and uname <> ''")
_GIFTS = _LIST.format(what="gift_name", count="sum(num)::bigint", when="event_type = 'gift'")


@query(f"""with {_EV}, t as (select room_id, strftime(make_timestamp(cast(floor(min(timestamp)) as bigint) * 1000000), '%Y-%m-%dT%H:%M:%SZ') as start_time, round(max(timestamp) - min(timestamp), 2) as duration_s, {_TOTALS},
 count(*) filter (where event_type = 'super_chat') as n_super_chats, count(*) filter (where event_type = 'guard') as n_guards from ev group by room_id)
 select t.*, coalesce(c.tops, '') as top_chatters, coalesce(g.tops, '') as top_gifts from t left join {_CHATTERS} c using (room_id) left join {_GIFTS} g using (room_id)""")
def live_session(spark, sf_dir: str) -> DataFrame:
    """The whole summary of every room: its time, totals, how much was paid for how often, and both rankings as lists."""
    rows = records(spark, sf_dir, "live_events", *_COLUMNS)
    kind, at = F.col("event_type"), F.min("timestamp")
    whole = rows.groupBy("room_id").agg(
        F.date_format(F.timestamp_seconds(F.floor(at)), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("start_time"), F.round(F.max("timestamp") - at, 2).alias("duration_s"), *totals(),
        F.count_if(kind == "super_chat").alias("n_super_chats"), F.count_if(kind == "guard").alias("n_guards"),
    )

    def listed(when: str, what: str, count, into: str) -> DataFrame:
        ranked = rows.filter(when).groupBy("room_id", what).agg(count.alias("n"), F.min("seq").alias("first"))
        w = Window.partitionBy("room_id").orderBy(F.desc("n"), "first")
        ranked = ranked.withColumn("rn", F.row_number().over(w)).filter("rn <= 10")
        line = F.struct("rn", F.concat(what, F.lit(" x "), F.col("n").cast("string")).alias("line"))
        return ranked.groupBy("room_id").agg(F.array_join(F.sort_array(F.collect_list(line))["line"], "; ").alias(into))

    whole = whole.join(listed("event_type = 'danmaku' and uname <> ''", "uname", F.count("*"), "top_chatters"), "room_id", "left")
    return whole.join(listed("event_type = 'gift'", "gift_name", F.sum("num"), "top_gifts"), "room_id", "left").na.fill("", ["top_chatters", "top_gifts"])


@query(f"""with {_EV}, g as (select seq, seq - lag(seq) over (order by seq) - 1 lost from (select seq from ev where event_type <> 'system')) select count(*) as events, coalesce(sum(lost), 0)::bigint as dropped, coalesce(sum(lost), 0) = 0 as complete from g""")
def live_capture_state(spark, sf_dir: str) -> DataFrame:
    """Events of a journal without the system's, how many numbers between the first and the last are missing, and whether the
    capture is complete; from its bounds and size, without ordering it."""
    seq = F.col("seq")
    dropped = F.coalesce(F.max(seq) - F.min(seq) + 1 - F.count("*"), F.lit(0))
    return records(spark, sf_dir, "live_events", where="event_type <> 'system'").agg(F.count("*").alias("events"), dropped.alias("dropped"), (dropped == 0).alias("complete"))


@query(f"""with {_EV}, f as (select room_id, min(timestamp) t0 from ev where timestamp is not null group by 1) select room_id, count(*) filter (where timestamp <= t0 + 86400) as captured, max(timestamp) > t0 + 86400 as stopped from ev join f using (room_id) where timestamp is not null group by room_id, t0""")
def live_bounded_run(spark, sf_dir: str) -> DataFrame:
    """What a run of at most a day keeps of each room, counted from its first event, and whether the bound ended it."""
    rows = records(spark, sf_dir, "live_events", "room_id", "timestamp", where="timestamp is not null")
    first = rows.groupBy("room_id").agg(F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"))
    kept = rows.join(first, "room_id").groupBy("room_id", "t0", "t1").agg(F.count_if(F.col("timestamp") <= F.col("t0") + 86400).alias("captured"))
    return kept.select("room_id", "captured", (F.col("t1") > F.col("t0") + 86400).alias("stopped"))


_COST = "ev as (select distinct seq, room_id, timestamp ts, coalesce(price, cny_value) amount from live_events where event_type in ('gift', 'super_chat', 'guard') and coalesce(price, cny_value) > 0)"


def _costs(spark, sf_dir: str) -> DataFrame:
    rows = records(spark, sf_dir, "live_events", "event_type", "room_id", "timestamp", "price", "cny_value", where="event_type in ('gift', 'super_chat', 'guard')")
    return rows.select("seq", "room_id", F.col("timestamp").alias("ts"), F.coalesce("price", "cny_value").alias("amount")).filter("amount > 0")


@query(f"""with recursive {_COST}, e as (select *, row_number() over (partition by room_id order by ts, seq) rn from ev),
 w as (select room_id, 0::bigint rn, 0::bigint seq, 0.0::double spent, false ok from (select distinct room_id from e) union all
 select e.room_id, e.rn, e.seq, case when w.spent + e.amount <= 300 + 1e-9 then w.spent + e.amount else w.spent end, w.spent + e.amount <= 300 + 1e-9 from w join e on e.room_id = w.room_id and e.rn = w.rn + 1)
 select room_id, seq from w where ok""")
def budget_admission(spark, sf_dir: str) -> DataFrame:
    return folds.admitted(_costs(spark, sf_dir), ["room_id"], ["ts", "seq"], "amount", 300.0).select("room_id", "seq")


@query(f"""with {_COST} select room_id, round(sum(case when seq % 3 <> 0 then amount else 0 end), 2) as settled, round(sum(case when seq % 3 = 0 then amount else 0 end), 2) as reserved, bool_or(amount > 5000) as blocked from ev group by 1""")
def budget_summary(spark, sf_dir: str) -> DataFrame:
    """Settled and reserved amounts per ledger; every third request is still open, and one beyond the bound blocks."""
    open_ = F.col("seq") % 3 == 0
    part = lambda when: F.round(F.sum(F.when(when, F.col("amount")).otherwise(0.0)), 2)
    return _costs(spark, sf_dir).groupBy("room_id").agg(part(~open_).alias("settled"), part(open_).alias("reserved"), F.bool_or(F.col("amount") > 5000).alias("blocked"))


_CALLS = "c as (select distinct seq, room_id, timestamp ts from live_events where event_type = 'danmaku' and timestamp is not null)"


@query(f"""with recursive {_CALLS}, e as (select *, row_number() over (partition by room_id order by ts, seq) rn from c),
 w as (select room_id, 0::bigint rn, 0::bigint seq, []::double[] open, false ok from (select distinct room_id from e) union all
 select e.room_id, e.rn, e.seq, case when len(list_filter(w.open, lambda t: t > e.ts - 3600)) < 3 then list_append(list_filter(w.open, lambda t: t > e.ts - 3600), e.ts) else list_filter(w.open, lambda t: t > e.ts - 3600) end,
 len(list_filter(w.open, lambda t: t > e.ts - 3600)) < 3 from w join e on e.room_id = w.room_id and e.rn = w.rn + 1) select room_id, seq from w where ok""")
def rate_limit(spark, sf_dir: str) -> DataFrame:
    calls = records(spark, sf_dir, "live_events", "event_type", "room_id", "timestamp", where="event_type = 'danmaku' and timestamp is not null")
    return folds.rate_limited(calls.select("room_id", F.col("timestamp").alias("ts"), "seq"), ["room_id"], "ts", "seq", 3, 3600.0).select("room_id", "seq")


@query(f"with {_EV} select room_id, event_type, count(*) as n from ev group by all")
def stream_event_counts(spark, sf_dir: str) -> DataFrame:
    """Counts over the whole journal, kept up to date by a stream in complete mode."""
    events = journal.read_events(spark, sf_dir, load(spark, sf_dir, "live_events").schema).dropDuplicates(["seq"])
    return journal.run_complete(events.groupBy("room_id", "event_type").agg(F.count("*").alias("n")), f"counts_{uuid.uuid4().hex}")


@query(f"with {_EV} select room_id, count(distinct case when event_type = 'danmaku' and uid > 0 then uid end) as senders from ev group by all")
def stream_unique_senders(spark, sf_dir: str) -> DataFrame:
    """Distinct senders of a stream: sets, for a stream can't count distinct values."""
    events = journal.read_events(spark, sf_dir, load(spark, sf_dir, "live_events").schema)
    senders = F.size(F.collect_set(F.when((F.col("event_type") == "danmaku") & (F.col("uid") > 0), F.col("uid"))))
    return journal.run_complete(events.groupBy("room_id").agg(senders.alias("senders")), f"senders_{uuid.uuid4().hex}")


@query(f"with {_EV} select seq, event_type from ev where event_type <> 'system'")
def stream_replay(spark, sf_dir: str) -> DataFrame:
    """A replay cursor of its own over the journal, append mode, exactly once."""
    events = journal.read_events(spark, sf_dir, load(spark, sf_dir, "live_events").schema).filter("event_type <> 'system'").dropDuplicates(["seq"])
    return journal.run_append(events.select("seq", "event_type"), f"replay_{uuid.uuid4().hex}")


@query(None)
def stream_hourly_windows(spark, sf_dir: str) -> DataFrame:
    """An extension: event-time windows behind a watermark; windows that the watermark hasn't passed aren't given out."""
    events = journal.read_events(spark, sf_dir, load(spark, sf_dir, "live_events").schema).withColumn("at", F.timestamp_seconds("timestamp")).withWatermark("at", "1 hour")
    counts = events.dropDuplicatesWithinWatermark(["seq"]).groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return journal.run_append(counts.select(F.col("w.start").alias("hour"), "event_type", "n"), f"hours_{uuid.uuid4().hex}")


@query(None)
def stream_rate_limit(spark, sf_dir: str) -> DataFrame:
    """The limiter as a stateful stream; batches follow the order in which files arrive."""
    events = journal.read_events(spark, sf_dir, load(spark, sf_dir, "live_events").schema).filter("event_type = 'danmaku'")
    return journal.run_append(journal.limited(events, "room_id", "timestamp", "seq", 3, 3600.0), f"limit_{uuid.uuid4().hex}")
