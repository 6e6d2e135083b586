"""Generic relational shapes over the star schema, as a user of the engine writes them: joins, top-k, set operations, streams run as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexmill.session import table
from codexmill.streaming import progress as P


def pricing_summary(spark, d):
    """Filter, projection and grouped aggregates (partial on the map side)."""
    li = table(spark, d, "lineitem").where("l_shipdate <= timestamp '1998-09-02'")
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(disc), 2).alias("revenue"), F.count("*").alias("n"))


def nation_suppliers(spark, d):
    """Correlated count per group, 0 where empty."""
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    c = s.groupBy("s_nationkey").agg(F.count("*").alias("n"))
    return n.join(c, n.n_nationkey == c.s_nationkey, "left").select("n_name", F.coalesce("n", F.lit(0)).alias("suppliers"))


def customers_without_orders(spark, d):
    """Anti-join."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey")


def customers_with_urgent_orders(spark, d):
    """Semi-join with a pushed filter."""
    c, o = table(spark, d, "customer"), table(spark, d, "orders").where("o_orderpriority = '1-URGENT'")
    return c.join(o, c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_mktsegment")


def events_hourly(spark, d):
    """The windowed stream run over the stored events until none is left."""
    schema = table(spark, d, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/events.parquet*")
    q = stream.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")
    return P.drain(q, ["start", "event_type"], ["n"], "events-hourly")


def positions_stream(spark, d):
    """STR-05: newest positions kept by a stream over the write log, late writes losing."""
    schema = table(spark, d, "user_progress").schema
    stream = spark.readStream.schema(schema).parquet(f"{d}/user_progress.parquet*")
    return P.drain(P.latest_positions(stream), ["user_id", "book_id"], ["char_offset", "updated_at"], "positions")


_N = [pricing_summary, nation_suppliers, customers_without_orders, customers_with_urgent_orders, events_hourly, positions_stream]
QUERIES = {f.__name__: f for f in _N}
SQL = {
    "pricing_summary": "select l_returnflag, l_linestatus, sum(l_quantity) sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) revenue, count(*) n from lineitem where l_shipdate <= timestamp '1998-09-02' group by 1, 2",
    "nation_suppliers": "select n_name, (select count(*) from supplier where s_nationkey = n_nationkey) suppliers from nation",
    "customers_without_orders": "select c_custkey from customer where c_custkey not in (select o_custkey from orders)",
    "customers_with_urgent_orders": "select c_custkey, c_mktsegment from customer where c_custkey in (select o_custkey from orders where o_orderpriority = '1-URGENT')",
    "positions_stream": "select user_id, book_id, char_offset, updated_at from (select *, row_number() over (partition by user_id, book_id order by updated_at desc, char_offset desc) rn from user_progress) where rn = 1",
    "events_hourly": "select strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00:00') as start, event_type, count(*) n from events group by 1, 2",
}
