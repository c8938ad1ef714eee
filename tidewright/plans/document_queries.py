"""Sentence, bibliography, range and stream queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewright.functions import documents as D
from tidewright.sources.tables import table
from tidewright.streaming.ingest import event_counts


def t3_sentences(s, sf):
    return D.sentence_table(table(s, sf, "documents"))


def t11_bibliographies(s, sf):
    return D.bibliography_table(table(s, sf, "documents"))


def t12_order_periods(s, sf):
    """Overlapping periods of a customer's orders (order date and the next 90 days) joined into islands."""
    o = table(s, sf, "orders").select("o_custkey", F.col("o_orderdate").cast("date").alias("start"))
    spans = o.withColumn("end", F.date_add("start", 90))
    return D.islands(spans, "o_custkey", "start", "end")


def w_event_counts(s, sf):
    return event_counts(table(s, sf, "events"))


QUERIES = (t3_sentences, t11_bibliographies, t12_order_periods, w_event_counts)
ORACLES = {
    "t12_order_periods": """with s as (select o_custkey, o_orderdate::date as "start", o_orderdate::date + 90 as "end" from orders),
        m as (select *, max("end") over (partition by o_custkey order by "start", "end" rows between unbounded preceding and 1 preceding) as top from s),
        n as (select *, sum((top is null or "start" > top)::int) over (partition by o_custkey order by "start", "end" rows unbounded preceding) as k from m)
        select o_custkey, min("start") as "start", max("end")::date as "end" from n group by o_custkey, k""",
    "w_event_counts": "select time_bucket(interval '1 hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 6) as total from events group by 1, 2",
}
