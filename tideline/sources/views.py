"""Canonical feeds (trades, quotes, level feed, order feed, bands) as projections of an event table.

The templates are engine-neutral SQL; prices and sizes are scaled integers, times microseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HASH = {"H1": 2654435761, "H2": 2246822519, "H3": 3266489917, "H4": 668265263}

VIEWS = {
    "trades": """
select case when user_id%2=0 then 'AAA' else 'BBB' end as symbol, event_id as id, {us} as ts_us, cast(ts as date) as day,
100000+cast(round(value*100) as bigint) as price_ticks, 1+{H1}%500 as qty_lots, {H2}%2=0 as is_buyer_maker from {events}""",
    "quotes": """
select case when user_id%2=0 then 'AAA' else 'BBB' end as symbol, event_id as id, {us}-1500000 as ts_us,
100000+cast(round(value*100) as bigint)-1-{H1}%5 as bid_ticks, 100000+cast(round(value*100) as bigint)+1+{H2}%5 as ask_ticks from {events} where {H3}%3<>0""",
    "l2": """
select 'AAA' as symbol, event_id as seq, cast(floor(event_id/8) as bigint) as batch, cast(floor(event_id/8) as bigint)*1000 as ts_us, cast(floor(event_id/8) as bigint)*1000+7 as local_ts_us,
cast(floor(event_id/8) as bigint)%250=0 as is_snapshot, cast(event_id%2 as int) as side,
case when event_id%2=0 then 9999-((cast(floor(event_id/2) as bigint)%4)*8+{H1}%8) else 10000+((cast(floor(event_id/2) as bigint)%4)*8+{H1}%8) end as price, case when {H2}%4=0 then 0 else 1+{H3}%100 end as amount from {events}""",
    "l2_hazard": """
select 'AAA' as symbol, event_id as seq, cast(floor(event_id/8) as bigint) as batch, cast(floor(event_id/8) as bigint)*1000 as ts_us, cast(floor(event_id/8) as bigint)*1000+7 as local_ts_us,
cast(floor(event_id/8) as bigint)%250=0 as is_snapshot, cast({H4}%2 as int) as side,
case when {H4}%2=0 then 10003-{H1}%12 else 9997+{H1}%12 end as price, case when {H2}%4=0 then 0 else 1+{H3}%100 end as amount from {events}""",
    "order_feed": """
select case when user_id%2=0 then 'AAA' else 'BBB' end as symbol, event_id as seq, {us} as ts_us,
case when {H1}%1000<550 then 0 when {H1}%1000<700 then 1 when {H1}%1000<955 then 2 when {H1}%1000<995 then 3 else 4 end as type,
case when {H1}%1000<550 then event_id else event_id-1-{H2}%60 end as order_id, cast({H4}%2 as int) as side,
10000+{H3}%13-6 as price, 1+{H2}%40 as size from {events}""",
    "equity_messages": """
select case when user_id%2=0 then 'AAA' else 'BBB' end as symbol, cast(ts as date) as day, event_id as row_index, ({us}%86400000000)/1e6 as seconds,
case when {H1}%100<20 then 1 when {H1}%100<30 then 2 when {H1}%100<40 then 3 when {H1}%100<85 then 4 when {H1}%100<97 then 5 else 7 end as type,
event_id as order_id, 1+{H2}%300 as size, 5000000+100*cast(round(value*100) as bigint) as price, case when {H4}%2=0 then 1 else -1 end as direction from {events}""",
    "equity_books": """
select case when user_id%2=0 then 'AAA' else 'BBB' end as symbol, cast(ts as date) as day, event_id as row_index,
5000000+100*cast(round(value*100) as bigint)+50+100*({H3}%4) as ask, 5000000+100*cast(round(value*100) as bigint)-50-100*({H4}%4) as bid from {events} where {H3}%50<>0""",
    "bands": """
select h.hour_ts, b.band, b.pct_tenths, 500*abs(b.pct_tenths)+(h.n*7919+b.band*104729)%1000 as depth_lots
from (select date_trunc('hour',ts) as hour_ts, count(*) as n from {events} group by 1) h
cross join (values (0,-50),(1,-40),(2,-30),(3,-20),(4,-10),(5,-2),(6,2),(7,10),(8,20),(9,30),(10,40),(11,50)) as b(band,pct_tenths)""",
}


def _hashes() -> dict[str, str]:
    return {k: f"cast(floor(((event_id*{v})%4294967296)/65536) as bigint)" for k, v in HASH.items()}


def sql(name: str, us: str = "epoch_us(ts)", events: str = "events") -> str:
    """The projection as SQL text; by default for the checking engine."""
    return VIEWS[name].format(us=us, events=events, **_hashes())


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The projection of the event table under sf_dir."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(sql(name, "unix_micros(cast(ts as timestamp))", "{events}"), events=events)
