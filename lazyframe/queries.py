"""One query for each verb over the driver's tables, and the same in SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.expr import by_row, fdiv, maximum, mean, minimum, normal_cdf, nrow, round_even, total
from .functions.selectors import Between, Cols
from .operators.array import collect_range, fill
from .operators.offload import offloaded
from .operators.table import Table
from .plans.sampling import sample_size, take_sample
from .sources.tables import read_parquet, read_table, write_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return keep


def _t(spark: SparkSession, sf_dir: str, name: str) -> Table:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


@query("SELECT l_returnflag, avg(l_tax) AS l_tax_mean FROM lineitem WHERE l_quantity < 10 GROUP BY 1")
def combine_mean(spark, d):
    return _t(spark, d, "lineitem").filter(lambda r: r.l_quantity < 10).groupby("l_returnflag").combine(("l_tax", mean)).spark


@query("SELECT * FROM lineitem WHERE l_quantity < 10 AND (l_tax > 0.05 OR l_returnflag = 'A')")
def filter_row(spark, d):
    return _t(spark, d, "lineitem").filter(lambda r: (r.l_quantity < 10) & ((r.l_tax > 0.05) | (r.l_returnflag == "A"))).spark


@query("SELECT * FROM lineitem WHERE l_quantity * l_discount > 2")
def filter_cols(spark, d):
    return _t(spark, d, "lineitem").filter(lambda q, x: q * x > 2, "l_quantity", "l_discount").spark


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def mask_index(spark, d):
    t = _t(spark, d, "lineitem")
    return t[t[:, "l_quantity"] > 45, ["l_orderkey", "l_quantity"]].spark


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate FROM lineitem")
def select_cols(spark, d):
    return _t(spark, d, "lineitem")[:, Cols(Between("l_orderkey", "l_suppkey"), 4, re.compile("ship"))].spark


@query("SELECT r_regionkey AS id, r_name AS name FROM region")
def rename(spark, d):
    return _t(spark, d, "region").rename(("r_regionkey", "id"), ("r_name", "name")).spark


@query("SELECT upper('n_nationkey') IS NOT NULL AS ok, n_nationkey AS N_NATIONKEY, n_name AS N_NAME, n_regionkey AS N_REGIONKEY FROM nation")
def rename_all(spark, d):
    return _t(spark, d, "nation").rename(str.upper).with_columns(ok=True).spark


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS price FROM lineitem")
def setindex(spark, d):
    t = _t(spark, d, "lineitem")
    t[:, "price"] = t[:, "l_extendedprice"].map(lambda p, x: p * (1 - x), t[:, "l_discount"])
    return t[:, ["l_orderkey", "l_linenumber", "price"]].spark


@query("SELECT event_id, nullif(event_type, 'error') AS kind FROM events WHERE event_type <> 'error'")
def dropmissing(spark, d):
    t = _t(spark, d, "events").with_columns(kind=F.nullif(F.col("event_type"), F.lit("error")))
    return t[:, ["event_id", "kind"]].dropmissing("kind").spark


@query("SELECT event_id, user_id FROM events")
def disallowmissing(spark, d):
    return _t(spark, d, "events")[:, ["event_id", "user_id"]].allowmissing().disallowmissing().spark


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_quantity FROM lineitem")
def unique_all(spark, d):
    return _t(spark, d, "lineitem")[:, ["l_returnflag", "l_linestatus", "l_quantity"]].unique().spark


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) AS n FROM events) WHERE n = 1")
def unique_cols(spark, d):
    return _t(spark, d, "events")[:, ["event_type", "user_id", "event_id"]].unique(["event_type", "user_id"], order="event_id").spark


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 AS nonunique FROM events")
def nonunique(spark, d):
    return _t(spark, d, "events")[:, ["event_id", "user_id"]].nonunique("user_id", order="event_id").spark.select("event_id", "nonunique")


@query("SELECT * FROM customer ORDER BY c_mktsegment, c_acctbal")
def sort_multi(spark, d):
    return _t(spark, d, "customer").sort(["c_mktsegment", "c_acctbal"]).spark


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC")
def sort_rev(spark, d):
    return _t(spark, d, "orders")[:, ["o_orderkey", "o_totalprice"]].sort("o_totalprice", rev=True).spark


@query("SELECT o_orderkey, o_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_pair_keys(spark, d):
    return _t(spark, d, "orders").innerjoin(_t(spark, d, "customer"), on=("o_custkey", "c_custkey"))[:, ["o_orderkey", "o_custkey", "c_name"]].spark


@query("SELECT n_nationkey AS key, N_NAME, n_regionkey AS N_REGIONKEY, c_name AS c_NAME FROM (SELECT n_nationkey, n_name AS N_NAME, n_regionkey, c_name FROM nation JOIN customer ON n_nationkey = c_nationkey)")
def join_renamecols(spark, d):
    n = _t(spark, d, "nation").rename(n_nationkey="key")
    c = _t(spark, d, "customer")[:, ["c_nationkey", "c_name"]].rename(c_nationkey="key", c_name="c_NAME")
    return n.innerjoin(c, on="key", renamecols=(str.upper, lambda x: x)).spark


@query("""SELECT n_name, count(*) AS nrow, sum(l_quantity) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def join_many(spark, d):
    t = _t(spark, d, "lineitem").innerjoin(_t(spark, d, "orders"), on=("l_orderkey", "o_orderkey"))
    t = t.innerjoin(_t(spark, d, "customer"), on=("o_custkey", "c_custkey")).innerjoin(_t(spark, d, "nation"), on=("c_nationkey", "n_nationkey"))
    return t.groupby("n_name").combine("nrow", ("l_quantity", total, "qty")).spark


@query("SELECT r_regionkey, r_name, n_name, s_name FROM region JOIN (SELECT n_regionkey, n_name FROM nation) ON r_regionkey = n_regionkey JOIN (SELECT n_regionkey AS k, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) ON r_regionkey = k")
def join_three_way(spark, d):
    r = _t(spark, d, "region")
    n = _t(spark, d, "nation")[:, ["n_regionkey", "n_name"]].rename(n_regionkey="r_regionkey")
    s = _t(spark, d, "supplier").innerjoin(_t(spark, d, "nation"), on=("s_nationkey", "n_nationkey"))[:, ["n_regionkey", "s_name"]].rename(n_regionkey="r_regionkey")
    return r.innerjoin(n, s, on="r_regionkey").spark


@query("SELECT a.n_regionkey AS k, count(*) AS nrow FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey GROUP BY 1")
def self_join(spark, d):
    n = _t(spark, d, "nation").rename(n_regionkey="k")
    return n.innerjoin(n.copy(), on="k", renamecols=(lambda c: c, lambda c: c + "_b")).groupby("k").combine("nrow").spark


@query("SELECT l_returnflag, l_linestatus, count(*) AS nrow, sum(l_quantity) AS l_quantity_sum, min(l_tax) AS l_tax_minimum, max(l_tax) AS l_tax_maximum, avg(l_discount) AS disc FROM lineitem GROUP BY 1, 2")
def combine_multi(spark, d):
    g = _t(spark, d, "lineitem").groupby(["l_returnflag", "l_linestatus"])
    return g.combine("nrow", ("l_quantity", "sum"), [("l_tax", "minimum"), ("l_tax", maximum)], ("l_discount", mean, "disc")).spark


@query("SELECT event_type, CASE WHEN count(*) = count(v) THEN avg(v) END AS v_mean, count(*) AS nrow FROM (SELECT event_type, CASE WHEN event_type <> 'error' THEN value END AS v FROM events) GROUP BY 1")
def combine_propagate(spark, d):
    t = _t(spark, d, "events").with_columns(v=F.when(F.col("event_type") != "error", F.col("value")))
    return t.groupby("event_type").combine(("v", mean), nrow, propagate_missing=True).spark


@query("SELECT l_returnflag, sum(l_quantity * l_extendedprice) / sum(l_quantity) AS l_quantity_l_extendedprice_function FROM lineitem GROUP BY 1")
def combine_lambda(spark, d):
    return _t(spark, d, "lineitem").groupby("l_returnflag").combine((["l_quantity", "l_extendedprice"], lambda q, p: total(q * p) / total(q))).spark


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag) AS l_quantity_function FROM lineitem")
def group_select_demean(spark, d):
    t = _t(spark, d, "lineitem").groupby("l_returnflag").select("l_orderkey", "l_linenumber", ("l_quantity", lambda q: q - mean(q)))
    return t.spark


@query("SELECT *, (c_acctbal - min(c_acctbal) OVER w) / (max(c_acctbal) OVER w - min(c_acctbal) OVER w) AS norm FROM customer WINDOW w AS (PARTITION BY c_mktsegment)")
def group_transform_minmax(spark, d):
    return _t(spark, d, "customer").groupby("c_mktsegment").transform(("c_acctbal", lambda x: fdiv(x - minimum(x), maximum(x) - minimum(x)), "norm")).spark


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, avg(l_quantity) OVER (PARTITION BY l_returnflag) AS m FROM lineitem) WHERE l_quantity >= m")
def group_subset_ge_mean(spark, d):
    return _t(spark, d, "lineitem").groupby("l_returnflag").subset(("l_quantity", lambda q: q >= mean(q)))[:, ["l_orderkey", "l_linenumber", "l_quantity"]].spark


@query("SELECT count(*) AS n FROM (SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem)")
def group_length(spark, d):
    g = _t(spark, d, "lineitem").groupby(["l_returnflag", "l_linestatus"])
    return spark.createDataFrame([(len(g),)], "n long")


@query("SELECT sum(l_quantity * 2 + 1) AS value FROM lineitem")
def vec_map_reduce(spark, d):
    return _t(spark, d, "lineitem")[:, "l_quantity"].map(lambda x: x * 2 + 1).sum().spark


@query("SELECT max(l_extendedprice - l_tax + l_discount) AS value FROM lineitem")
def vec_binary(spark, d):
    t = _t(spark, d, "lineitem")
    return (t[:, "l_extendedprice"] - t[:, "l_tax"] + t[:, "l_discount"]).maximum().spark


@query("SELECT vec_id, list_sum(embedding) AS total, list_min(embedding) AS low, list_max(embedding) AS high FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)")
def array_minmax(spark, d):
    t = _t(spark, d, "embeddings").with_columns(e=F.col("embedding").cast("array<double>"))
    return t.with_columns(total=F.aggregate("e", F.lit(0.0), lambda a, x: a + x), low=F.array_min("e"), high=F.array_max("e"))[:, ["vec_id", "total", "low", "high"]].spark


@query("SELECT i % 6 AS i1, CAST(0 AS BIGINT) AS i2, 7.5 * 5 AS value FROM range(6) t(i)")
def array_mapslices(spark, d):
    a = fill(spark, 7.5, (6, 5))
    return a.mapslices(lambda cells: F.aggregate(cells, F.lit(0.0), lambda s, x: s + x), 2).spark


@query("SELECT i AS i1, CAST(0 AS BIGINT) AS i2, 3.0 * 7 AS value FROM range(5) t(i)")
def array_reduce_dims(spark, d):
    return fill(spark, 3.0, (5, 7)).reduce("sum", dims=2).spark


@query("SELECT i AS i1, 1.0 + 2.0 AS value FROM range(12) t(i)")
def array_flatten(spark, d):
    return (fill(spark, 1.0, (3, 4)) + fill(spark, 2.0, (3, 4)))[:].spark


@query("SELECT row_number() OVER (ORDER BY s_acctbal DESC, s_suppkey) - 1 AS i1, s_acctbal AS value FROM supplier")
def array_sort(spark, d):
    return _t(spark, d, "supplier")[:, "s_acctbal"].sort(rev=True).spark


@query("SELECT hour(ts) AS hour, avg(value) AS value_mean, count(*) AS nrow FROM events WHERE ts > TIMESTAMP '2024-01-02 00:00:00' GROUP BY 1")
def events_hour_mean(spark, d):
    t = _t(spark, d, "events").filter(lambda r: r.ts > F.lit("2024-01-02 00:00:00").cast("timestamp_ntz")).with_columns(hour=lambda r: F.hour(r.ts).cast("long"))
    return t.groupby("hour").combine(("value", mean), "nrow").spark


#: The price of a call with all five inputs 4.0, summed over 2048 elements; the same polynomial for the normal CDF.
@query("""WITH x AS (SELECT (4.0 + 4.0 ^ 2 * 0.5) * 4.0 AS num, 4.0 * sqrt(4.0) AS den), d AS (SELECT (ln(4.0 / 4.0) + num) / den AS d1, (ln(4.0 / 4.0) + num) / den - den AS d2 FROM x),
t AS (SELECT d1, d2, 1 / (1 + 0.2316419 * abs(d1)) AS t1, 1 / (1 + 0.2316419 * abs(d2)) AS t2 FROM d),
q AS (SELECT d1, d2, exp(-d1 * d1 / 2) * 0.3989422804014327 * (t1 * (0.319381530 + t1 * (-0.356563782 + t1 * (1.781477937 + t1 * (-1.821255978 + t1 * 1.330274429))))) AS q1,
exp(-d2 * d2 / 2) * 0.3989422804014327 * (t2 * (0.319381530 + t2 * (-0.356563782 + t2 * (1.781477937 + t2 * (-1.821255978 + t2 * 1.330274429))))) AS q2 FROM t),
n AS (SELECT CASE WHEN d1 >= 0 THEN 1 - q1 ELSE q1 END AS n1, CASE WHEN d2 >= 0 THEN 1 - q2 ELSE q2 END AS n2 FROM q)
SELECT round(2048 * (4.0 * n1 - 4.0 * exp(-16.0) * n2), 6) AS value FROM n""")
def black_scholes(spark, d):
    price, strike, years, rate, vol = (fill(spark, 4.0, 2048) for _ in range(5))

    def call_price(s, k, t, r, v):
        spread = v * F.sqrt(t)
        d1 = (F.ln(s / k) + (r + v * v * 0.5) * t) / spread
        return s * normal_cdf(d1) - k * F.exp(-r * t) * normal_cdf(d1 - spread)

    return price.map(call_price, strike, years, rate, vol).sum().spark.select(F.round("value", 6).alias("value"))


def _roundtrip(spark: SparkSession, d: str, form: str) -> DataFrame:
    """Written and read again; under the warehouse, which all executors share."""
    import uuid

    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/").removeprefix("file:")
    path = f"{base}/roundtrip-{uuid.uuid4().hex}.{form}"
    write_table(_t(spark, d, "supplier").spark, path)
    return read_table(spark, path).spark.select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def io_roundtrip_csv(spark, d):
    return _roundtrip(spark, d, "csv").withColumn("s_suppkey", F.col("s_suppkey").cast("long"))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def io_roundtrip_parquet(spark, d):
    return _roundtrip(spark, d, "parquet")


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def io_roundtrip_arrow(spark, d):
    return _roundtrip(spark, d, "arrow")


@query("SELECT * FROM nation")
def sample_exact(spark, d):
    return _t(spark, d, "nation").sample()


@query("SELECT CASE WHEN n <= 1024 THEN n ELSE CAST(ceil(n / 16.0) AS BIGINT) END AS n FROM (SELECT count(*) AS n FROM lineitem)")
def sample_size_inexact(spark, d):
    return take_sample(_t(spark, d, "lineitem").spark.select("l_orderkey", "l_linenumber"))[0].agg(F.count("*").alias("n"))


@query("SELECT CAST(499500 AS BIGINT) AS value")
def offloaded_sum(spark, d):
    def work(worker, n):
        return worker.reduce_across(lambda a, b: a + b, sum(worker.split_across(n)))

    return spark.createDataFrame([(offloaded(spark, work, 1000, distributed=True, workers=2),)], "value long")


@query("SELECT i AS i1, CASE WHEN i = 0 THEN 1.5 ELSE 2.5 END AS value FROM range(2) t(i)")
def array_getindex(spark, d):
    from .operators.array import from_numpy

    return from_numpy(spark, np.array([[0.5, 1.5], [1.0, 2.5]]))[:, 1].spark


@query("SELECT row_number() OVER (ORDER BY l_extendedprice) - 1 AS i1, l_extendedprice AS value FROM lineitem")
def array_sort_large(spark, d):
    return _t(spark, d, "lineitem")[:, "l_extendedprice"].sort().spark


@query("SELECT row_number() OVER (ORDER BY c_mktsegment, c_acctbal) - 1 AS i1, c_acctbal AS value FROM customer")
def sort_order(spark, d):
    return _t(spark, d, "customer").sort(["c_mktsegment", "c_acctbal"])[:, "c_acctbal"].spark


@query("SELECT l_orderkey, l_linenumber, l_returnflag, round(l_quantity - avg(l_quantity) OVER (PARTITION BY l_returnflag), 6) AS off FROM lineitem")
def group_select_vectors(spark, d):
    f = by_row(lambda q: (q - q.mean()).round(6), "double")
    return _t(spark, d, "lineitem").groupby("l_returnflag").select("l_orderkey", "l_linenumber", ("l_quantity", f, "off")).spark


@query("SELECT c_custkey, c_mktsegment, c_acctbal, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS place, count(*) OVER (PARTITION BY c_mktsegment) AS nrow FROM customer")
def group_transform_vectors(spark, d):
    g = _t(spark, d, "customer")[:, ["c_custkey", "c_mktsegment", "c_acctbal"]].groupby("c_mktsegment")
    return g.transform(("c_acctbal", by_row(lambda x: x.rank(method="min").astype("int64"), "long"), "place"), "nrow").spark


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM (SELECT *, median(s_acctbal) OVER (PARTITION BY s_nationkey) AS m FROM supplier) WHERE s_acctbal > m")
def group_subset_vectors(spark, d):
    t = _t(spark, d, "supplier")[:, ["s_suppkey", "s_nationkey", "s_acctbal"]]
    return t.groupby("s_nationkey").subset(("s_acctbal", by_row(lambda x: x > x.median(), "boolean"))).spark


@query("SELECT c_mktsegment, c_acctbal AS least, n AS nrow FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) AS k, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer) WHERE k <= 3")
def combine_vectors(spark, d):
    least = by_row(lambda x: sorted(x)[:3], "double", many=True)
    return _t(spark, d, "customer").groupby("c_mktsegment").combine(("c_acctbal", least, "least"), "nrow").spark


@query("SELECT s_nationkey, median(s_acctbal) AS mid, count(*) AS nrow FROM supplier GROUP BY 1")
def combine_opaque(spark, d):
    return _t(spark, d, "supplier").groupby("s_nationkey").combine(("s_acctbal", by_row(lambda x: float(np.median(x)), "double"), "mid"), "nrow").spark


@query("SELECT s_nationkey, s_suppkey, s_acctbal FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier) WHERE k <= 2")
def group_apply(spark, d):
    g = _t(spark, d, "supplier")[:, ["s_nationkey", "s_suppkey", "s_acctbal"]].groupby("s_nationkey")
    return g.apply(lambda p: p.sort_values(["s_acctbal", "s_suppkey"], ascending=[False, True]).head(2), "s_nationkey int, s_suppkey long, s_acctbal double").spark


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 1000 AND s_suppkey % 3 = 0")
def filter_opaque(spark, d):
    t = _t(spark, d, "supplier")[:, ["s_suppkey", "s_acctbal"]]
    return t.filter(by_row(lambda r: bool(r["s_acctbal"] > 1000 and r["s_suppkey"] % 3 == 0), "boolean")).spark


@query("""SELECT n_nationkey, lower(n_name) AS low, length(n_name) AS len, substr(n_name, 2, 3) AS part, replace(n_name, 'A', 'x') AS changed,
contains(n_name, 'AN') AS has, starts_with(n_name, 'A') AS starts, ends_with(n_name, 'A') AS ends, concat(n_name, '-', n_regionkey) AS both, length(n_name) - length(replace(n_name, 'A', '')) AS hits FROM nation""")
def strings(spark, d):
    t = _t(spark, d, "nation").with_columns(
        low=lambda r: F.lower(r.n_name), len=lambda r: F.length(r.n_name).cast("long"), part=lambda r: F.substring(r.n_name, 2, 3), changed=lambda r: F.replace(r.n_name, F.lit("A"), F.lit("x")),
        has=lambda r: r.n_name.contains("AN"), starts=lambda r: r.n_name.startswith("A"), ends=lambda r: r.n_name.endswith("A"), both=lambda r: F.concat(r.n_name, F.lit("-"), r.n_regionkey.cast("string")),
        hits=lambda r: F.regexp_count(r.n_name, F.lit("A")).cast("long"),
    )
    return t[:, ["n_nationkey", "low", "len", "part", "changed", "has", "starts", "ends", "both", "hits"]].spark


@query("SELECT event_id, year(ts) AS y, month(ts) AS m, day(ts) AS dd, minute(ts) AS mi, strftime(ts, '%Y-%m-%d') AS text, CAST(CAST(strptime(strftime(ts, '%Y/%m/%d'), '%Y/%m/%d') AS DATE) AS VARCHAR) AS parsed FROM events")
def dates(spark, d):
    t = _t(spark, d, "events").with_columns(
        y=lambda r: F.year(r.ts).cast("long"), m=lambda r: F.month(r.ts).cast("long"), dd=lambda r: F.day(r.ts).cast("long"), mi=lambda r: F.minute(r.ts).cast("long"),
        text=lambda r: F.date_format(r.ts, "yyyy-MM-dd"), parsed=lambda r: F.to_date(F.date_format(r.ts, "yyyy/MM/dd"), "yyyy/MM/dd").cast("string"),
    )
    return t[:, ["event_id", "y", "m", "dd", "mi", "text", "parsed"]].spark


@query("SELECT l_orderkey, l_linenumber, round(sin(l_quantity), 9) AS s, round(cos(l_quantity), 9) AS c, round(asin(l_discount), 9) AS a, round(tan(l_tax), 9) AS t, round(exp(l_tax), 9) AS e, round_even(l_quantity / 2, 0) AS half FROM lineitem")
def numbers(spark, d):
    t = _t(spark, d, "lineitem").with_columns(
        s=lambda r: F.round(F.sin(r.l_quantity), 9), c=lambda r: F.round(F.cos(r.l_quantity), 9), a=lambda r: F.round(F.asin(r.l_discount), 9),
        t=lambda r: F.round(F.tan(r.l_tax), 9), e=lambda r: F.round(F.exp(r.l_tax), 9), half=lambda r: round_even(r.l_quantity / 2),
    )
    return t[:, ["l_orderkey", "l_linenumber", "s", "c", "a", "t", "e", "half"]].spark


@query("SELECT s_suppkey, CAST(s_suppkey AS DOUBLE) / 2 AS half, s_suppkey + 1 AS next, s_acctbal AS bal FROM supplier")
def parse_and_fields(spark, d):
    t = _t(spark, d, "supplier").with_columns(text=lambda r: r.s_suppkey.cast("string"), pair=lambda r: F.struct(r.s_acctbal.alias("bal"), r.s_name.alias("name")))
    t = t.with_columns(half=lambda r: r.text.cast("double") / 2, next=lambda r: r.text.cast("long") + 1, bal=lambda r: r.pair["bal"])
    return t[:, ["s_suppkey", "half", "next", "bal"]].spark


@query("SELECT count(*) AS nrow, CAST(3 AS BIGINT) AS ncol, CAST(2 AS BIGINT) AS ndims, 'n_nationkey,n_name,n_regionkey' AS names FROM nation")
def facts(spark, d):
    t = _t(spark, d, "nation")[:, ["n_nationkey", "n_name", "n_regionkey"]]
    return spark.createDataFrame([(t.size[0], t.ncol, t.ndims, ",".join(t.names))], "nrow long, ncol long, ndims long, names string")


@query("SELECT count(*) AS n, 'c_mktsegment' AS keys, 'c_custkey' AS rest FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def group_facts(spark, d):
    g = _t(spark, d, "customer")[:, ["c_custkey", "c_mktsegment"]].groupby("c_mktsegment")
    return spark.createDataFrame([(len(g), ",".join(g.groupcols), ",".join(g.valuecols))], "n long, keys string, rest string")


@query("SELECT CAST(6 AS BIGINT) AS length, CAST(2 AS BIGINT) AS ndims, 'double' AS eltype, '(2, 3)' AS shape")
def array_facts(spark, d):
    a = fill(spark, 1.0, (2, 3))
    return spark.createDataFrame([(len(a), a.ndims, a.eltype, str(a.shape))], "length long, ndims long, eltype string, shape string")


@query("SELECT i AS i1, 2 + 3 * i AS value FROM range(7) t(i)")
def array_range(spark, d):
    return collect_range(spark, 2, 20, 3).spark


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 40")
def computed_in_place(spark, d):
    t = _t(spark, d, "lineitem").filter(lambda r: r.l_quantity > 40)[:, ["l_orderkey", "l_linenumber"]]
    return t.compute_inplace().spark


@query("SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def io_overwrite(spark, d):
    import uuid

    path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/').removeprefix('file:')}/overwritten-{uuid.uuid4().hex}.parquet"
    write_table(_t(spark, d, "supplier")[:, ["s_suppkey", "s_acctbal"]].spark, path)
    write_table(read_table(spark, path).filter(lambda r: r.s_acctbal > 0).spark, path)
    return read_table(spark, path).spark


__all__ = ["ORACLE_SQL", "QUERIES", "sample_size"]
