"""Queries of the relational operators: scans, predicates, joins, aggregates, windows, order, sets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loamlog.functions.text import nanos_to_micros
from loamlog.operators.stats import sized_broadcast
from loamlog.plans.adapter import table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _money(column: str):
    return F.col(column).cast("decimal(18,4)")


# Scans and predicates


@query("select event_id, user_id, event_type, value from events")
def scan_project(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")


@query("select event_id, upper(event_type) as type_upper, value * 2 + 1 as doubled, user_id % 7 as slot from events")
def project_computed(spark, sf):
    return table(spark, sf, "events").select("event_id", F.upper("event_type").alias("type_upper"), (F.col("value") * 2 + 1).alias("doubled"), (F.col("user_id") % 7).alias("slot"))


@query("select l_orderkey, l_linenumber from lineitem where l_quantity >= 45 and l_discount < 0.03 and l_returnflag <> 'N' and l_tax <= 0.06 and l_partkey > 10")
def filter_compare(spark, sf):
    df = table(spark, sf, "lineitem")
    return df.where("l_quantity >= 45 and l_discount < 0.03 and l_returnflag <> 'N' and l_tax <= 0.06 and l_partkey > 10").select("l_orderkey", "l_linenumber")


@query("select event_id from events where (event_type = 'error' or value > 90) and not (user_id between 20 and 40)")
def filter_and_or_not(spark, sf):
    c = F.col
    return table(spark, sf, "events").where(((c("event_type") == "error") | (c("value") > 90)) & ~c("user_id").between(20, 40)).select("event_id")


@query("select count(*) filter (where lang is null) as n_null, count(*) filter (where lang is not null) as n_set from documents")
def filter_nulls(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.count_if(F.col("lang").isNull()).alias("n_null"), F.count_if(F.col("lang").isNotNull()).alias("n_set"))


@query("select event_id from events where event_type in ('view', 'click') and user_id not in (1, 2, 3) and value between 10 and 20")
def filter_in_between(spark, sf):
    c = F.col
    return table(spark, sf, "events").where(c("event_type").isin("view", "click") & ~c("user_id").isin(1, 2, 3) & c("value").between(10, 20)).select("event_id")


@query("select p_partkey from part where p_type like 'STANDARD%' or p_name not like 'p%'")
def filter_like_prefix(spark, sf):
    return table(spark, sf, "part").where(F.col("p_type").startswith("STANDARD") | ~F.col("p_name").startswith("p")).select("p_partkey")


@query("select event_id from log_events where raw like '%lease%'")
def filter_like_substring(spark, sf):
    return table(spark, sf, "log_events").where(F.col("raw").contains("lease")).select("event_id")


@query("select event_id from log_events where raw ilike '%ERROR budget%' or raw like '%9!%]' escape '!'")
def filter_ilike_escape(spark, sf):
    return table(spark, sf, "log_events").where(r"raw ilike '%ERROR budget%' or raw like '%9!%]' escape '!'").select("event_id")


@query("select count(*) filter (where lang is distinct from 'en') as differs, count(*) filter (where lang is not distinct from null) as missing from documents")
def filter_is_distinct(spark, sf):
    d = table(spark, sf, "documents")
    return d.agg(F.count_if(~F.col("lang").eqNullSafe("en")).alias("differs"), F.count_if(F.col("lang").eqNullSafe(F.lit(None))).alias("missing"))


@query("select event_id from log_events where event_time >= timestamptz '2026-03-02 00:00:00+00' and event_time < timestamptz '2026-03-02 00:00:00+00' + interval 36 hours and event_time < now()")
def filter_time(spark, sf):
    start = F.timestamp_micros(F.lit(1772409600000000))
    e = F.col("event_time")
    return table(spark, sf, "log_events").where((e >= start) & (e < start + F.expr("interval 36 hours")) & (e < F.current_timestamp())).select("event_id")


@query("select o_custkey, max(o_totalprice) as top from orders group by 1 having max(o_totalprice) > (select avg(o_totalprice) * 1.5 from orders)")
def subquery_having(spark, sf):
    table(spark, sf, "orders").createOrReplaceTempView("loamlog_orders")
    return spark.sql("select o_custkey, max(o_totalprice) as top from loamlog_orders group by 1 having max(o_totalprice) > (select avg(o_totalprice) * 1.5 from loamlog_orders)")


@query("select o_orderkey from orders o where o_totalprice > (select avg(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey) and exists (select 1 from lineitem where l_orderkey = o_orderkey and l_quantity = 50)")
def subquery_correlated(spark, sf):
    orders, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    mean = orders.groupBy(F.col("o_custkey").alias("k")).agg(F.avg("o_totalprice").alias("mean"))
    big = line.where("l_quantity = 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return orders.join(mean, F.col("o_custkey") == F.col("k")).where("o_totalprice > mean").join(big, "o_orderkey", "left_semi").select("o_orderkey")


@query("with busy as (select user_id, count(*) as n from events group by 1), top as (select * from busy where n >= 60) select user_id, n from top")
def cte(spark, sf):
    table(spark, sf, "events").createOrReplaceTempView("loamlog_events")
    return spark.sql("with busy as (select user_id, count(*) as n from loamlog_events group by 1), top as (select * from busy where n >= 60) select user_id, n from top")


# Joins


@query("select o_orderkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey where o_totalprice > 200000")
def join_inner(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return o.where("o_totalprice > 200000").join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "c_name", "c_mktsegment")


@query("select c_custkey, count(o_orderkey) as n_orders from customer left join orders on o_custkey = c_custkey group by 1")
def join_left(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    per = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("n_orders"))
    return c.select("c_custkey").join(per, "c_custkey", "left").select("c_custkey", F.coalesce("n_orders", F.lit(0)).alias("n_orders"))


@query("select s_suppkey, n_name from supplier right join nation on s_nationkey = n_nationkey")
def join_right(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "right").select("s_suppkey", "n_name")


@query("select s_suppkey, c_custkey from supplier full join customer on s_suppkey = c_custkey")
def join_full(spark, sf):
    s, c = table(spark, sf, "supplier"), table(spark, sf, "customer")
    return s.join(c, s.s_suppkey == c.c_custkey, "full").select("s_suppkey", "c_custkey")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')")
def join_semi(spark, sf):
    o = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def join_anti(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query("select r_name, n_name from region cross join nation")
def join_cross_small(spark, sf):
    """The cross join operator, on the two fixed dimension tables (5 and 25 rows)."""
    return table(spark, sf, "region").select("r_name").crossJoin(table(spark, sf, "nation").select("n_name"))


@query("select a.n_nationkey as low, b.n_nationkey as high from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey")
def join_theta(spark, sf):
    a = table(spark, sf, "nation").select(F.col("n_nationkey").alias("low"), F.col("n_regionkey").alias("r"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").alias("high"), F.col("n_regionkey").alias("r"))
    return a.join(b, "r").where("low < high").select("low", "high")


@query("select l_orderkey, l_linenumber, o_orderkey from lineitem join orders on l_orderkey = o_orderkey and epoch(l_shipdate) >= epoch(o_orderdate) and epoch(l_shipdate) < epoch(o_orderdate) + 7 * 86400")
def join_range(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    return line.join(o, line.l_orderkey == o.o_orderkey).where("l_shipdate >= o_orderdate and l_shipdate < o_orderdate + interval 7 days").select("l_orderkey", "l_linenumber", "o_orderkey")


@query("select n_name, count(*) as n_customers from customer join nation on c_nationkey = n_nationkey group by 1")
def join_broadcast(spark, sf):
    """The dimension is broadcast if its estimated size allows it; else Catalyst chooses."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(sized_broadcast(n.select("n_nationkey", "n_name")), c.c_nationkey == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n_customers"))


@query("select o_orderpriority, count(*) as n_lines from orders join lineitem on o_orderkey = l_orderkey group by 1")
def join_merge_hint(spark, sf):
    o, line = table(spark, sf, "orders"), table(spark, sf, "lineitem")
    return o.select("o_orderkey", "o_orderpriority").hint("merge").join(line.select("l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(F.count("*").alias("n_lines"))


# Aggregates


@query("""select l_returnflag, l_linestatus, count(*) as n, count(l_tax) as n_tax, cast(sum(cast(l_quantity as decimal(18,4))) as double) as qty,
  cast(sum(cast(l_extendedprice as decimal(18,4))) as double) as price, min(l_discount) as low, max(l_discount) as high from lineitem group by 1, 2""")
def agg_basic(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count("l_tax").alias("n_tax"), F.sum(_money("l_quantity")).cast("double").alias("qty"),
        F.sum(_money("l_extendedprice")).cast("double").alias("price"), F.min("l_discount").alias("low"), F.max("l_discount").alias("high"),
    )


@query("select user_id, cast(sum(event_id) as double) / count(event_id) as mean_id from events group by 1")
def agg_integer_avg(spark, sf):
    """An integer mean from sum and count, exact as long as the sum is."""
    return table(spark, sf, "events").groupBy("user_id").agg((F.sum("event_id").cast("double") / F.count("event_id")).alias("mean_id"))


@query("select count(distinct user_id) as users, count(distinct event_type) as types, count(distinct props) as props from events")
def agg_distinct(spark, sf):
    return table(spark, sf, "events").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"), F.countDistinct("props").alias("props"))


@query("select distinct o_orderstatus, o_orderpriority from orders")
def select_distinct(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("select user_id, count(*) as n from events group by 1 having count(*) > 70")
def agg_having(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n")).where("n > 70")


@query("select user_id, count(*) filter (where event_type = 'error') as errors, count(*) filter (where value > 50) as large from events group by 1")
def agg_filter(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("value") > 50).alias("large"))


@query("select o_orderstatus, o_orderpriority, count(*) as n, grouping(o_orderpriority) as total from orders group by rollup (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, sf):
    return table(spark, sf, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"), F.grouping("o_orderpriority").cast("long").alias("total"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by cube (o_orderstatus, o_orderpriority)")
def agg_cube(spark, sf):
    return table(spark, sf, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select o_orderstatus, o_orderpriority, count(*) as n from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark, sf):
    df = table(spark, sf, "orders")
    return df.groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("select event_type, count(*) as n from events group by 1 order by n desc, event_type limit 3")
def ordered_group_topk(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_type").limit(3)


@query("select host, count(*) as n_rows, count(attributes) as n_set, sum(length(raw)) as sum_length from log_events group by 1")
def grouped_numeric(spark, sf):
    return table(spark, sf, "log_events").groupBy("host").agg(F.count("*").alias("n_rows"), F.count("attributes").alias("n_set"), F.sum(F.length("raw")).alias("sum_length"))


@query("select lang, count(*) as n from documents group by 1")
def group_counts_with_null(spark, sf):
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("""select l_returnflag, round(stddev_samp(l_quantity), 6) as sd, round(stddev_pop(l_quantity), 6) as sd_pop, round(var_samp(l_quantity), 6) as va, round(var_pop(l_quantity), 6) as va_pop,
  median(l_quantity) as mid, round(corr(l_quantity, l_extendedprice), 6) as co, round(covar_samp(l_quantity, l_discount), 6) as cv, round(covar_pop(l_quantity, l_discount), 6) as cv_pop,
  round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept, regr_count(l_extendedprice, l_quantity) as pairs, round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem group by 1""")
def agg_statistics(spark, sf):
    q, p, d = "l_quantity", "l_extendedprice", "l_discount"
    r = lambda c, n=6: F.round(c, n)
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        r(F.stddev_samp(q)).alias("sd"), r(F.stddev_pop(q)).alias("sd_pop"), r(F.var_samp(q)).alias("va"), r(F.var_pop(q)).alias("va_pop"), F.median(q).alias("mid"),
        r(F.corr(q, p)).alias("co"), r(F.covar_samp(q, d)).alias("cv"), r(F.covar_pop(q, d)).alias("cv_pop"),
        r(F.regr_slope(p, q), 4).alias("slope"), r(F.regr_intercept(p, q), 3).alias("intercept"), F.regr_count(p, q).alias("pairs"), r(F.regr_r2(p, q)).alias("r2"),
    )


@query("""select event_type, bool_and(value >= 0) as every_one, bool_or(value > 99) as some_one, bit_and(user_id) as b_and, bit_or(user_id) as b_or, bit_xor(user_id) as b_xor,
  arg_min(event_id, (ts, event_id)) as first_id, arg_max(event_id, (ts, event_id)) as last_id from events group by 1""")
def agg_boolean_bits(spark, sf):
    order = F.struct("ts", "event_id")
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.bool_and(F.col("value") >= 0).alias("every_one"), F.bool_or(F.col("value") > 99).alias("some_one"), F.bit_and("user_id").alias("b_and"), F.bit_or("user_id").alias("b_or"), F.bit_xor("user_id").alias("b_xor"),
        F.min_by("event_id", order).alias("first_id"), F.max_by("event_id", order).alias("last_id"),
    )


@query("select n_regionkey, string_agg(n_name, ',' order by n_name) as names, list(n_nationkey order by n_nationkey) as keys from nation group by 1")
def agg_collect(spark, sf):
    names = F.array_join(F.array_sort(F.collect_list("n_name")), ",")
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(names.alias("names"), F.array_sort(F.collect_list("n_nationkey")).alias("keys"))


@query("select event_type, quantile_disc(event_id, 0.5) as mid from events group by 1")
def agg_percentile(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.expr("percentile_disc(0.5) within group (order by event_id)").cast("long").alias("mid"))


@query()
def agg_approximate(spark, sf):
    """Approximate distinct and percentile: rows only, the sketches differ between engines."""
    return table(spark, sf, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"), F.percentile_approx("value", 0.9).alias("p90"))


# Windows


def _by_type():
    return Window.partitionBy("event_type").orderBy("value", "event_id")


@query("""select event_id, row_number() over w as rn, rank() over v as rk, dense_rank() over v as dr, percent_rank() over v as pr, cume_dist() over v as cd, ntile(4) over w as quarter
  from events window w as (partition by event_type order by value, event_id), v as (partition by event_type order by user_id)""")
def win_rank(spark, sf):
    v = Window.partitionBy("event_type").orderBy("user_id")
    return table(spark, sf, "events").select("event_id", F.row_number().over(_by_type()).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.percent_rank().over(v).alias("pr"), F.cume_dist().over(v).alias("cd"), F.ntile(4).over(_by_type()).alias("quarter"))


@query("""select event_id, lag(event_id) over w as prev, lead(event_id, 2, -1) over w as next2, first_value(event_id) over w as head, last_value(event_id) over w as tail, nth_value(event_id, 3) over w as third
  from events window w as (partition by event_type order by value, event_id)""")
def win_lag(spark, sf):
    return table(spark, sf, "events").select("event_id", F.lag("event_id").over(_by_type()).alias("prev"), F.lead("event_id", 2, -1).over(_by_type()).alias("next2"), F.first("event_id").over(_by_type()).alias("head"), F.last("event_id").over(_by_type()).alias("tail"), F.nth_value("event_id", 3).over(_by_type()).alias("third"))


@query("select event_id, last_value(host ignore nulls) over (partition by table_name order by row_no rows between unbounded preceding and current row) as host from (select row_no as event_id, row_no, table_name, host from lake_rows)")
def win_ignore_nulls(spark, sf):
    w = Window.partitionBy("table_name").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf, "lake_rows").select(F.col("row_no").alias("event_id"), F.last("host", ignorenulls=True).over(w).alias("host"))


@query("select event_id, sum(event_id) over (partition by user_id order by ts, event_id rows between 2 preceding and 1 following) as s, count(*) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as n from events")
def win_rows_frame(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf, "events").select("event_id", F.sum("event_id").over(w.rowsBetween(-2, 1)).alias("s"), F.count("*").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("n"))


@query("select event_id, count(*) over (partition by event_type order by user_id range between 5 preceding and 5 following) as near from events")
def win_range_frame(spark, sf):
    w = Window.partitionBy("event_type").orderBy("user_id").rangeBetween(-5, 5)
    return table(spark, sf, "events").select("event_id", F.count("*").over(w).alias("near"))


@query("select event_id, count(*) over (partition by user_id) as of_user, max(value) over (partition by user_id) as top from events")
def win_count_over(spark, sf):
    w = Window.partitionBy("user_id")
    return table(spark, sf, "events").select("event_id", F.count("*").over(w).alias("of_user"), F.max("value").over(w).alias("top"))


@query("select user_id, event_id from events qualify row_number() over (partition by user_id order by value desc, event_id) <= 2")
def win_qualify(spark, sf):
    """A window's result filtered: QUALIFY as a subquery."""
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return table(spark, sf, "events").withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("user_id", "event_id")


# Order and limits


@query("select doc_id, lang from documents order by lang desc nulls last, doc_id limit 40")
def sort_nulls(spark, sf):
    return table(spark, sf, "documents").orderBy(F.col("lang").desc_nulls_last(), "doc_id").limit(40).select("doc_id", "lang")


@query("select doc_id, lang from documents order by lang asc nulls first, doc_id desc limit 30")
def sort_nulls_first(spark, sf):
    return table(spark, sf, "documents").orderBy(F.col("lang").asc_nulls_first(), F.desc("doc_id")).limit(30).select("doc_id", "lang")


@query("select l_orderkey, l_linenumber, l_extendedprice from lineitem order by l_extendedprice desc, l_orderkey, l_linenumber limit 100")
def topk_numeric(spark, sf):
    return table(spark, sf, "lineitem").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("select event_id from log_events order by event_time desc, event_id desc limit 100")
def newest_first(spark, sf):
    return table(spark, sf, "log_events").orderBy(F.desc("event_time"), F.desc("event_id")).limit(100).select("event_id")


@query("select o_orderkey from orders order by o_orderdate, o_orderkey limit 50 offset 200")
def offset_page(spark, sf):
    return table(spark, sf, "orders").orderBy("o_orderdate", "o_orderkey").offset(200).limit(50).select("o_orderkey")


@query()
def limit_unordered(spark, sf):
    """Any ten rows: which ones is not defined."""
    return table(spark, sf, "events").select("event_id").limit(10)


# Sets


@query("select n_nationkey as k from nation union all select c_nationkey from customer")
def union_all(spark, sf):
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).unionAll(table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")))


@query("select s_nationkey as k from supplier union select c_nationkey from customer")
def union_distinct(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).union(table(spark, sf, "customer").select("c_nationkey")).distinct()


@query("select s_nationkey as k from supplier intersect select c_nationkey from customer")
def intersect(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(spark, sf, "customer").select("c_nationkey"))


@query("select s_nationkey as k from supplier intersect all select c_nationkey from customer")
def intersect_all(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")).intersectAll(table(spark, sf, "customer").select("c_nationkey"))


@query("select c_custkey as k from customer except select o_custkey from orders")
def except_distinct(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, sf, "orders").select("o_custkey"))


@query("select c_nationkey as k from customer except all select s_nationkey from supplier")
def except_all(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).exceptAll(table(spark, sf, "supplier").select("s_nationkey"))


# Inherited scalar functions


@query("""select event_id, lower(raw) as low, length(raw) as n, trim(raw) as trimmed, substr(raw, 3, 5) as part, concat(host, '/', source) as both, replace(raw, 'e', '_') as swapped,
  split_part(host, '.', 2) as domain, starts_with(raw, '2026') as dated, strpos(raw, 'o') as place, regexp_matches(raw, '[0-9]{4}') as has_number, regexp_replace(raw, '[0-9]+', '#', 'g') as masked,
  left(raw, 4) as l4, right(raw, 4) as r4, reverse(host) as mirrored, lpad(sourcetype, 12, '.') as padded, repeat('ab', 2) as twice, ascii(host) as code from log_events""")
def fn_string(spark, sf):
    raw = F.col("raw")
    return table(spark, sf, "log_events").select(
        "event_id", F.lower(raw).alias("low"), F.length(raw).cast("long").alias("n"), F.trim(raw).alias("trimmed"), F.substring(raw, 3, 5).alias("part"), F.concat_ws("/", "host", "source").alias("both"), F.replace(raw, F.lit("e"), F.lit("_")).alias("swapped"),
        F.split_part("host", F.lit("."), F.lit(2)).alias("domain"), raw.startswith("2026").alias("dated"), F.locate("o", raw).cast("long").alias("place"), raw.rlike("[0-9]{4}").alias("has_number"), F.regexp_replace(raw, "[0-9]+", "#").alias("masked"),
        F.left(raw, F.lit(4)).alias("l4"), F.right(raw, F.lit(4)).alias("r4"), F.reverse("host").alias("mirrored"), F.lpad("sourcetype", 12, ".").alias("padded"), F.repeat(F.lit("ab"), 2).alias("twice"), F.ascii("host").alias("code"),
    )


@query("""select event_id, epoch_us(date_trunc('hour', event_time)) as hour_us, extract(year from event_time) as y, extract(month from event_time) as m, extract(day from event_time) as d, extract(hour from event_time) as h,
  extract(dow from event_time) as dow, extract(doy from event_time) as doy, strftime(event_time, '%Y-%m-%d %H:%M') as text, epoch_us(to_timestamp(timestamp_ns // 1000000000)) as sec_us, epoch_us(make_timestamp(timestamp_ns // 1000)) as us from log_events""")
def fn_time(spark, sf):
    e = F.col("event_time")
    ns = F.col("timestamp_ns")
    return table(spark, sf, "log_events").select(
        "event_id", F.unix_micros(F.date_trunc("hour", e)).alias("hour_us"), F.year(e).cast("long").alias("y"), F.month(e).cast("long").alias("m"), F.dayofmonth(e).cast("long").alias("d"), F.hour(e).cast("long").alias("h"),
        (F.dayofweek(e) - 1).cast("long").alias("dow"), F.dayofyear(e).cast("long").alias("doy"), F.date_format(e, "yyyy-MM-dd HH:mm").alias("text"), F.unix_micros(F.timestamp_seconds(F.expr("timestamp_ns div 1000000000"))).alias("sec_us"), F.unix_micros(F.timestamp_micros(nanos_to_micros(ns))).alias("us"),
    )


@query("""select event_id, abs(value - 50) as a, ceil(value) as c, floor(value) as f, round(value, 1) as r, round(power(value, 2), 6) as p, round(sqrt(value), 9) as s, round(ln(value + 1), 9) as l, round(log10(value + 1), 9) as l10,
  round(sin(value), 9) as si, user_id % 9 as md, greatest(value, 10) as g, least(value, 10) as le, event_id // 7 as dv, sign(value - 50) as sg from events""")
def fn_math(spark, sf):
    v = F.col("value")
    return table(spark, sf, "events").select(
        "event_id", F.abs(v - 50).alias("a"), F.ceil(v).cast("double").alias("c"), F.floor(v).cast("double").alias("f"), F.round(v, 1).alias("r"), F.round(F.pow(v, F.lit(2)), 6).alias("p"), F.round(F.sqrt(v), 9).alias("s"), F.round(F.ln(v + 1), 9).alias("l"), F.round(F.log10(v + 1), 9).alias("l10"),
        F.round(F.sin(v), 9).alias("si"), (F.col("user_id") % 9).alias("md"), F.greatest(v, F.lit(10.0)).alias("g"), F.least(v, F.lit(10.0)).alias("le"), F.expr("event_id div 7").alias("dv"), F.signum(v - 50).cast("tinyint").alias("sg"),
    )


@query("""select doc_id, case when n_chars is null then 'none' when n_chars > 1000 then 'long' else 'short' end as size, coalesce(lang, 'und') as lang2, nullif(lang, '') as lang3, cast(n_chars as varchar) as text, try_cast(lang as bigint) as number, ifnull(n_chars, 0) as n from documents""")
def fn_conditional(spark, sf):
    n = F.col("n_chars")
    return table(spark, sf, "documents").select("doc_id", F.when(n.isNull(), "none").when(n > 1000, "long").otherwise("short").alias("size"), F.coalesce("lang", F.lit("und")).alias("lang2"), F.nullif(F.col("lang"), F.lit("")).alias("lang3"), n.cast("string").alias("text"), F.col("lang").try_cast("long").alias("number"), F.ifnull(n, F.lit(0)).alias("n"))


@query("""select event_id, len(string_split(host, '.')) as n, list_contains(string_split(host, '.'), 'lake') as has, string_split(host, '.')[1] as head, array_to_string(list_sort(string_split(host, '.')), '|') as sorted,
  array_to_string(list_distinct([sourcetype, 'a', sourcetype]), '') is not null as d, {'a': host, 'b': line_no}.b as member, map([host], [line_no])[host] as looked from log_events""")
def fn_nested(spark, sf):
    parts = F.split("host", r"\.")
    return table(spark, sf, "log_events").select(
        "event_id", F.size(parts).cast("long").alias("n"), F.array_contains(parts, "lake").alias("has"), F.element_at(parts, 1).alias("head"), F.array_join(F.array_sort(parts), "|").alias("sorted"),
        F.array_join(F.array_distinct(F.array("sourcetype", F.lit("a"), "sourcetype")), "").isNotNull().alias("d"), F.struct(F.col("host").alias("a"), F.col("line_no").alias("b"))["b"].alias("member"), F.element_at(F.create_map("host", "line_no"), F.col("host")).alias("looked"),
    )


@query("select event_id, unnest(string_split(host, '.')) as part from log_events")
def fn_unnest(spark, sf):
    return table(spark, sf, "log_events").select("event_id", F.explode(F.split("host", r"\.")).alias("part"))


@query("select event_id, md5(raw) as m, sha256(raw) as s, to_base64(encode(host)) as b, hex(encode(sourcetype)) as h from log_events")
def fn_hash(spark, sf):
    return table(spark, sf, "log_events").select("event_id", F.md5("raw").alias("m"), F.sha2("raw", 256).alias("s"), F.base64(F.col("host").cast("binary")).alias("b"), F.hex("sourcetype").alias("h"))


@query("select n from (select unnest(generate_series(1, 1000)) as n) where n % 7 = 0")
def generate_series(spark, sf):
    return spark.range(1, 1001).where("id % 7 = 0").select(F.col("id").alias("n"))


@query("select table_name, column_name from (values ('orders', 'o_orderkey'), ('orders', 'o_custkey'), ('orders', 'o_orderstatus'), ('orders', 'o_totalprice'), ('orders', 'o_orderdate'), ('orders', 'o_orderpriority')) t(table_name, column_name)")
def information_schema(spark, sf):
    """The catalogue as a table of columns."""
    from loamlog.engine import information_schema as columns

    return columns(spark, {"orders": table(spark, sf, "orders")}).select("table_name", "column_name")
