"""Named queries over the star schema, each with its SQL twin: ``QUERIES`` and ``ORACLE_SQL``."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera import functions as fn
from tessera import types
from tessera.expr import by, f, g, join, sort
from tessera.frame import Frame
from tessera.functions import math, strings, times
from tessera.operators import models, shape
from tessera.plans.tables import new_path
from tessera.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function of a table opener, which returns a frame, under its name."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = function(lambda name: Frame(spark.read.parquet(f"{sf_dir}/{name}.parquet")))
            return out.to_spark() if isinstance(out, Frame) else out

        run.__name__ = function.__name__
        QUERIES[function.__name__] = run
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return run

    return register


def named(frame: Frame, *names: str) -> Frame:
    return frame._renamed(list(names))


# ---- scan, project, filter ----


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(table):
    price = f.l_extendedprice * (1 - f.l_discount)
    j = {"sum_qty": fn.sum(f.l_quantity), "sum_base_price": math.round(fn.sum(f.l_extendedprice), 2), "sum_disc_price": math.round(fn.sum(price), 2), "avg_qty": math.round(fn.mean(f.l_quantity), 6), "avg_disc": math.round(fn.mean(f.l_discount), 6), "n": fn.count()}
    return table("lineitem")[f.l_shipdate <= datetime.datetime(1998, 9, 2), j, by(f.l_returnflag, f.l_linestatus)]


@query("SELECT count(*) AS n FROM lineitem")
def scan_count(table):
    return table("lineitem")[:, {"n": fn.count()}]


@query("SELECT o_orderkey, round(o_totalprice * 0.9, 4) AS discounted, o_custkey + 1 AS next_cust FROM orders")
def project_computed(table):
    return table("orders")[:, {"o_orderkey": f.o_orderkey, "discounted": math.round(f.o_totalprice * 0.9, 4), "next_cust": f.o_custkey + 1}]


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE (l_quantity > 45 AND l_discount < 0.02) OR l_returnflag = 'R'")
def filter_and_or(table):
    return table("lineitem")[((f.l_quantity > 45) & (f.l_discount < 0.02)) | (f.l_returnflag == "R"), ["l_orderkey", "l_quantity"]]


def _labelled(table) -> Frame:
    labels = table("labels")
    labels.key = "doc_id"
    return table("documents")[:, [f.doc_id, f.lang, f.n_chars, g.quality, g.toxic], join(labels)]


_LABELLED = "(SELECT d.doc_id, d.lang, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


@query(f"SELECT doc_id, quality FROM {_LABELLED} WHERE quality IS NOT DISTINCT FROM toxic")
def filter_null_safe_eq(table):
    return _labelled(table)[f.quality == f.toxic, ["doc_id", "quality"]]


@query(f"SELECT doc_id, coalesce(quality < toxic, false) AS lt, coalesce(quality <= toxic, quality IS NULL AND toxic IS NULL) AS le, quality IS DISTINCT FROM 1 AS ne, quality IS NULL AS na FROM {_LABELLED}")
def compare_with_na(table):
    return _labelled(table)[:, {"doc_id": f.doc_id, "lt": f.quality < f.toxic, "le": f.quality <= f.toxic, "ne": f.quality != 1, "na": math.isna(f.quality)}]


@query(f"SELECT doc_id, (quality = 1) AND (toxic = 1) AS both_, (quality = 1) OR (toxic = 1) AS either FROM (SELECT doc_id, CASE WHEN quality IS NULL THEN NULL ELSE quality END AS quality, toxic FROM {_LABELLED}) WHERE quality IS NOT NULL")
def filter_kleene(table):
    return _labelled(table)[~math.isna(f.quality), {"doc_id": f.doc_id, "both_": (f.quality == 1) & (f.toxic == 1), "either": (f.quality == 1) | (f.toxic == 1)}]


@query("SELECT c_acctbal FROM customer")
def select_by_type(table):
    return table("customer")[:, float]


@query("SELECT p_name, p_brand, p_type, p_size FROM part")
def select_name_slice(table):
    return table("part")[:, "p_name":"p_size"]


@query("SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey FROM customer")
def select_backwards_and_list(table):
    return table("customer")[:, [f.c_custkey, f["c_mktsegment":"c_nationkey"]]]


@query("SELECT s_suppkey AS id, s_name AS label FROM supplier")
def select_dict_rename(table):
    return table("supplier")[:, {"id": f.s_suppkey, "label": f.s_name}]


@query("SELECT s_suppkey, s_name, s_nationkey, s_suppkey % 7 AS m FROM supplier")
def columns_extend_remove(table):
    return table("supplier")[:, f[:].remove(f.s_acctbal).extend({"m": f.s_suppkey % 7})]


# ---- arithmetic ----


@query("SELECT p_partkey, CAST(p_size + p_size AS INTEGER) AS a, CAST(p_size * 2 - 1 AS INTEGER) AS b, p_partkey * p_size AS c, -p_size AS d FROM part")
def arith_int_promotion(table):
    return table("part")[:, {"p_partkey": f.p_partkey, "a": f.p_size + f.p_size, "b": f.p_size * 2 - 1, "c": f.p_partkey * f.p_size, "d": -f.p_size}]


@query("""SELECT p_partkey, CAST(floor((p_size - 25) / 7.0) AS INTEGER) AS q, CAST(p_size - 25 - 7 * floor((p_size - 25) / 7.0) AS INTEGER) AS r,
 CAST(floor((p_size - 25) / -7.0) AS INTEGER) AS qn, CAST(p_size - 25 + 7 * floor((p_size - 25) / -7.0) AS INTEGER) AS rn, CAST(NULL AS INTEGER) AS z FROM part""")
def floordiv_mod_signs(table):
    x = f.p_size - 25
    return table("part")[:, {"p_partkey": f.p_partkey, "q": x // 7, "r": x % 7, "qn": x // -7, "rn": x % -7, "z": x // (f.p_size - f.p_size)}]


@query("SELECT p_partkey, CASE WHEN p_size = 25 THEN NULL WHEN p_size > 25 THEN 'inf' ELSE '-inf' END AS by_zero, round(p_size / 8, 6) AS eighth FROM part")
def truediv_zero(table):
    x = (f.p_size - 25) / (f.p_size - f.p_size)
    return table("part")[:, {"p_partkey": f.p_partkey, "by_zero": fn.ifelse(x > 0, "inf", x < 0, "-inf", None), "eighth": math.round(f.p_size / 8, 6)}]


@query("SELECT p_partkey, round(pow(p_size, 2.0), 6) AS sq, round(pow(p_size, 0.5), 6) AS root FROM part")
def pow_float(table):
    return table("part")[:, {"p_partkey": f.p_partkey, "sq": math.round(f.p_size**2, 6), "root": math.round(f.p_size**0.5, 6)}]


@query("SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS o, xor(p_size, 21) AS x, ~p_size AS n, CAST(p_size * 4 AS INTEGER) AS l, p_size >> 1 AS r, CAST(p_size * 2 AS INTEGER) AS neg FROM part")
def bitwise_and_shift(table):
    return table("part")[:, {"p_partkey": f.p_partkey, "a": f.p_size & 12, "o": f.p_size | 3, "x": f.p_size ^ 21, "n": ~f.p_size, "l": f.p_size << 2, "r": f.p_size >> 1, "neg": f.p_size >> -1}]


# ---- reducers ----


@query("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS s, round(avg(l_tax), 8) AS m, min(l_quantity) AS lo, max(l_shipdate) AS hi FROM lineitem GROUP BY l_suppkey")
def agg_sum_mean_min_max(table):
    return table("lineitem")[:, {"s": math.round(fn.sum(f.l_extendedprice), 2), "m": math.round(fn.mean(f.l_tax), 8), "lo": fn.min(f.l_quantity), "hi": fn.max(f.l_shipdate)}, by("l_suppkey")]


@query(f"SELECT lang, count(quality) AS n, count(*) - count(quality) AS na, count(*) AS rows_ FROM {_LABELLED} GROUP BY lang")
def agg_count_countna(table):
    return _labelled(table)[:, {"n": fn.count(f.quality), "na": fn.countna(f.quality), "rows_": fn.count()}, by("lang")]


@query("SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def agg_nunique(table):
    return table("events")[:, {"users": fn.nunique(f.user_id)}, by("event_type")]


@query("SELECT l_returnflag, median(l_quantity) AS med FROM lineitem GROUP BY l_returnflag")
def agg_median(table):
    return table("lineitem")[:, {"med": fn.median(f.l_quantity)}, by("l_returnflag")]


@query("SELECT c_nationkey, round(stddev_samp(c_acctbal), 6) AS sd FROM customer GROUP BY c_nationkey")
def agg_sd(table):
    return table("customer")[:, {"sd": math.round(fn.sd(f.c_acctbal), 6)}, by("c_nationkey")]


@query("SELECT l_returnflag, round(covar_samp(l_quantity, l_extendedprice), 4) AS cov, round(corr(l_quantity, l_extendedprice), 8) AS cor FROM lineitem GROUP BY l_returnflag")
def agg_cov_corr(table):
    return table("lineitem")[:, {"cov": math.round(fn.cov(f.l_quantity, f.l_extendedprice), 4), "cor": math.round(fn.corr(f.l_quantity, f.l_extendedprice), 8)}, by("l_returnflag")]


@query("SELECT r_regionkey, CAST(round(product(n_nationkey + 1)) AS BIGINT) AS p FROM (SELECT n_regionkey AS r_regionkey, n_nationkey FROM nation) GROUP BY r_regionkey")
def agg_prod(table):
    return table("nation")[:, {"p": fn.prod(f.n_nationkey + 1)}, by(f.n_regionkey.alias("r_regionkey"))]


@query("SELECT user_id, arg_min(event_type, event_id) AS first_type, arg_max(value, event_id) AS last_value FROM events GROUP BY user_id")
def agg_first_last(table):
    return table("events")[:, {"first_type": fn.first(f.event_type), "last_value": fn.last(f.value)}, by("user_id"), sort("event_id")]


@query("SELECT o_orderpriority, CAST(DATE '1970-01-01' + CAST(trunc(avg(CAST(o_orderdate AS DATE) - DATE '1970-01-01')) AS INTEGER) AS DATE) AS d FROM orders GROUP BY o_orderpriority")
def agg_mean_temporal(table):
    return table("orders")[:, {"d": fn.mean(f.o_orderdate.as_type("date32"))}, by("o_orderpriority")]


@query("SELECT p_brand, CAST(min(p_size) AS BIGINT) AS total, CAST(1 AS BIGINT) AS n FROM part GROUP BY p_brand")
def agg_nested(table):
    return table("part")[:, {"total": fn.sum(fn.min(f.p_size)), "n": fn.count(fn.max(f.p_size))}, by("p_brand")]


@query("SELECT s_nationkey, s_suppkey, round(s_acctbal - avg(s_acctbal) OVER (PARTITION BY s_nationkey), 6) AS diff, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier")
def agg_spread_over_groups(table):
    return table("supplier")[:, {"s_suppkey": f.s_suppkey, "diff": math.round(f.s_acctbal - fn.mean(f.s_acctbal), 6), "n": fn.count()}, by("s_nationkey")]


@query("SELECT c_custkey, round(c_acctbal / (SELECT sum(c_acctbal) FROM customer), 12) AS share FROM customer")
def agg_spread_over_frame(table):
    return table("customer")[:, {"c_custkey": f.c_custkey, "share": math.round(f.c_acctbal / fn.sum(f.c_acctbal), 12)}]


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, count(*) AS n FROM orders GROUP BY y")
def agg_computed_key(table):
    return table("orders")[:, {"n": fn.count()}, by(times.year(f.o_orderdate).alias("y"))]


@query("SELECT o_orderpriority, count(*) AS n, row_number() OVER (ORDER BY o_orderpriority DESC) AS pos FROM orders GROUP BY o_orderpriority")
def agg_descending_key(table):
    out = table("orders")[:, {"n": fn.count()}, by(-f.o_orderpriority)]
    return out[:, f[:].extend({"pos": fn.cumcount() + 1})]


@query("SELECT CAST(0 AS BIGINT) AS n, CAST(0 AS DOUBLE) AS s, CAST(NULL AS DOUBLE) AS m")
def agg_empty(table):
    return table("customer")[f.c_custkey < 0, {"n": fn.count(), "s": fn.sum(f.c_acctbal), "m": fn.mean(f.c_acctbal)}]


@query("SELECT o_orderpriority, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS big FROM orders GROUP BY o_orderpriority HAVING big > 0")
def filter_then_group(table):
    return table("orders")[f.o_totalprice > 100000, {"big": fn.count()}, by("o_orderpriority")]


# ---- statistics of frames ----


@query("SELECT (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS c_mktsegment, (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS c_nationkey")
def stat_mode(table):
    return table("customer")[:, ["c_mktsegment", "c_nationkey"]].mode()


@query("SELECT (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment ORDER BY n DESC LIMIT 1) AS c_mktsegment")
def stat_nmodal(table):
    return table("customer")[:, "c_mktsegment"].nmodal()


@query("SELECT round(skewness(l_extendedprice), 8) AS skew, round(kurtosis(l_extendedprice), 8) AS kurt FROM lineitem")
def stat_skew_kurt(table):
    x = table("lineitem")[:, "l_extendedprice"]
    return named(shape.cbind(x.skew()[:, math.round(f[:], 8)], x.kurt()[:, math.round(f[:], 8)]), "skew", "kurt")


@query("SELECT count(DISTINCT p_brand) AS p_brand, count(DISTINCT p_size) AS p_size FROM part")
def stat_nunique(table):
    return table("part")[:, ["p_brand", "p_size"]].nunique()


@query("SELECT round(stddev_samp(c_acctbal), 6) AS c_acctbal FROM customer")
def stat_sd(table):
    return table("customer")[:, "c_acctbal"].sd()[:, math.round(f[:], 6)]


@query(f"SELECT count(*) - count(quality) AS quality, count(*) - count(doc_id) AS doc_id FROM {_LABELLED}")
def stat_countna(table):
    return _labelled(table)[:, ["quality", "doc_id"]].countna()


# ---- windows ----

_W = "(PARTITION BY user_id ORDER BY event_id)"


@query(f"SELECT user_id, event_id, lag(value, 1) OVER {_W} AS lag1, lead(value, 2) OVER {_W} AS lead2 FROM events")
def shift_lag_lead(table):
    return table("events")[:, {"event_id": f.event_id, "lag1": fn.shift(f.value, 1), "lead2": fn.shift(f.value, -2)}, by("user_id"), sort("event_id")]


@query("SELECT user_id, event_id, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS s, CAST(sum(event_id) OVER (PARTITION BY user_id ORDER BY event_id DESC) AS BIGINT) AS r FROM events")
def cumsum_both_ways(table):
    return table("events")[:, {"event_id": f.event_id, "s": fn.cumsum(f.event_id), "r": fn.cumsum(f.event_id, reverse=True)}, by("user_id"), sort("event_id")]


@query("SELECT n_regionkey, n_nationkey, CAST(round(product(n_nationkey + 1) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)) AS BIGINT) AS p FROM nation")
def cumprod(table):
    return table("nation")[:, {"n_nationkey": f.n_nationkey, "p": fn.cumprod(f.n_nationkey + 1)}, by("n_regionkey"), sort("n_nationkey")]


@query(f"SELECT user_id, event_id, min(value) OVER {_W} AS lo, max(ts) OVER {_W} AS hi FROM events")
def cummin_cummax(table):
    return table("events")[:, {"event_id": f.event_id, "lo": fn.cummin(f.value), "hi": fn.cummax(f.ts)}, by("user_id"), sort("event_id")]


@query("SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k, count(*) OVER (PARTITION BY event_type) - row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS back, dense_rank() OVER (ORDER BY event_type) - 1 AS grp FROM events")
def cumcount_ngroup(table):
    return table("events")[:, {"event_id": f.event_id, "k": fn.cumcount(), "back": fn.cumcount(reverse=True), "grp": fn.ngroup()}, by("event_type"), sort("event_id")]


@query(f"SELECT lang, doc_id, last_value(quality IGNORE NULLS) OVER (PARTITION BY lang ORDER BY doc_id) AS fwd, first_value(quality IGNORE NULLS) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS bwd, coalesce(quality, 9) AS val FROM {_LABELLED}")
def fillna_all_ways(table):
    return _labelled(table)[:, {"doc_id": f.doc_id, "fwd": fn.fillna(f.quality), "bwd": fn.fillna(f.quality, reverse=True), "val": fn.fillna(f.quality, 9)}, by("lang"), sort("doc_id")]


@query("""SELECT c_custkey, CAST(CASE WHEN hi = lo THEN 4 ELSE 9 + CAST(trunc((c_acctbal - hi) * ((1 - 1.1920928955078125e-07::DOUBLE) * 10 / (hi - lo))) AS INTEGER) END AS INTEGER) AS bin
 FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)""")
def cut_nbins(table):
    return table("customer")[:, {"c_custkey": f.c_custkey, "bin": fn.cut(f.c_acctbal, nbins=10)}]


@query("SELECT p_partkey, CAST(CASE WHEN p_size >= 0 AND p_size < 10 THEN 0 WHEN p_size >= 10 AND p_size < 30 THEN 1 WHEN p_size >= 30 AND p_size < 50 THEN 2 END AS INTEGER) AS bin FROM part")
def cut_edges_left_closed(table):
    return table("part")[:, {"p_partkey": f.p_partkey, "bin": fn.cut(f.p_size, bins=[0, 10, 30, 50], right_closed=False)}]


@query("""SELECT s_suppkey, CAST(CASE WHEN n <= 1 THEN 4 ELSE trunc(10 * (1 - 1.1920928955078125e-07::DOUBLE) / (n - 1) * r) END AS INTEGER) AS q
 FROM (SELECT s_suppkey, dense_rank() OVER (ORDER BY s_acctbal) - 1 AS r, (SELECT count(DISTINCT s_acctbal) FROM supplier) AS n FROM supplier)""")
def qcut_frame(table):
    return table("supplier")[:, {"s_suppkey": f.s_suppkey, "q": fn.qcut(f.s_acctbal, nquantiles=10)}]


@query("""SELECT event_type, event_id, CAST(CASE WHEN n <= 1 THEN 1 ELSE trunc(4 * (1 - 1.1920928955078125e-07::DOUBLE) / (n - 1) * r) END AS INTEGER) AS q
 FROM (SELECT event_type, event_id, dense_rank() OVER (PARTITION BY event_type ORDER BY value) - 1 AS r, n FROM events JOIN (SELECT event_type, count(DISTINCT value) AS n FROM events GROUP BY 1) USING (event_type))""")
def qcut_by_group(table):
    return table("events")[:, {"event_id": f.event_id, "q": fn.qcut(f.value, nquantiles=4)}, by("event_type")]


# ---- rows ----


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def topk_frame(table):
    return table("orders")[:10, ["o_orderkey", "o_totalprice"], sort(-f.o_totalprice, f.o_orderkey)]


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def topk_per_group(table):
    return table("orders")[:2, "o_orderkey", by("o_custkey"), sort(-f.o_totalprice, f.o_orderkey)]


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) WHERE r = 2")
def nth_row_per_group(table):
    return table("events")[1, "event_id", by("user_id"), sort("event_id")]


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1")
def last_row_per_group(table):
    return table("events")[-1, "event_id", by("user_id"), sort("event_id")]


@query("SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS r FROM events) WHERE r >= 1 AND (r - 1) % 3 = 0")
def slice_step_per_group(table):
    return table("events")[1::3, "event_id", by("user_id"), sort("event_id")]


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) WHERE r >= 20 AND r < 60 AND (r - 20) % 4 = 0")
def row_slice_sorted(table):
    return table("customer").sort("c_custkey")[20:60:4, "c_custkey"]


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) WHERE r IN (3, 5, 7)")
def row_list(table):
    return table("customer").sort("c_custkey")[[3, 5, 7], "c_custkey"]


@query("SELECT l_orderkey, l_extendedprice FROM (SELECT l_orderkey, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate) - 1 AS r FROM lineitem) WHERE r >= 5 AND (r - 5) % 7 = 0")
def row_slice_step(table):
    return table("lineitem").sort("l_extendedprice", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate")[5::7, ["l_orderkey", "l_extendedprice"]]


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS back FROM orders) WHERE back IN (1, 4, 1000) UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS back FROM orders) WHERE back BETWEEN 11 AND 20")
def row_negative(table):
    return table("orders").sort("o_totalprice", "o_orderkey")[[-1, -4, -1000, slice(-20, -10)], "o_orderkey"]


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1 OFFSET 5")
def row_int(table):
    return table("orders").sort("o_totalprice", "o_orderkey")[5, ["o_orderkey", "o_totalprice"]]


@query("SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r FROM orders) WHERE r IN (3, 10, 17, 24, 31, 38, 45)")
def row_range(table):
    return table("orders").sort("o_totalprice", "o_orderkey")[range(3, 50, 7), "o_orderkey"]


@query("SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS r FROM customer) WHERE r IN (0, 1, 4, 9, 16, 25)")
def row_generator(table):
    return table("customer").sort("c_custkey")[(k * k for k in range(6)), "c_custkey"]


@query("SELECT r_name FROM region WHERE r_regionkey IN (0, 2, 4)")
def row_truth_list(table):
    return table("region").sort("r_regionkey")[[True, False, True, False, True], "r_name"]


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 5000")
def row_truth_frame(table):
    customer = table("customer").sort("c_custkey")
    return customer[customer[:, f.c_acctbal > 5000], "c_custkey"]


@query("SELECT s_suppkey FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier) WHERE r IN (1, 3, 5)")
def row_number_frame(table):
    return table("supplier").sort("s_suppkey")[Frame([3, 1, 5]), "s_suppkey"]


@query("(SELECT s_suppkey FROM supplier ORDER BY s_suppkey LIMIT 3) UNION ALL (SELECT s_suppkey FROM supplier ORDER BY s_suppkey DESC LIMIT 2)")
def head_and_tail(table):
    supplier = table("supplier").sort("s_suppkey")[:, "s_suppkey"]
    return shape.rbind(supplier.head(3), supplier.tail(2))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT NULL, NULL FROM range(5)")
def rows_added(table):
    nation = table("nation").sort("n_nationkey")[:, ["n_nationkey", "n_name"]]
    nation.nrows = 30
    return nation


# ---- columns ----


@query("SELECT c_name, c_nationkey FROM customer")
def cols_int_slice(table):
    return table("customer")[:, 1:3]


@query("SELECT c_custkey, c_nationkey, c_mktsegment FROM customer")
def cols_range(table):
    return table("customer")[:, range(0, 5, 2)]


@query("SELECT s_name, s_acctbal FROM supplier")
def cols_truth_list(table):
    return table("supplier")[:, [False, True, False, True]]


@query("SELECT p_partkey, p_size FROM part")
def cols_ltype(table):
    return table("part")[:, types.ltype.int]


@query("SELECT r_name, 7 AS k, 'abc' AS s, 2.5::DOUBLE AS d, TRUE AS b FROM region")
def cols_literals(table):
    return table("region")[:, {"r_name": f.r_name, "k": 7, "s": "abc", "d": 2.5, "b": True}]


@query("SELECT p_size AS size, p_size + 1 AS next FROM part")
def cols_alias(table):
    return table("part")[:, [f.p_size.alias("size"), (f.p_size + 1).alias("next")]]


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0")
def cols_of_a_frame(table):
    supplier = table("supplier").sort("s_suppkey")
    return supplier[f.s_acctbal > 0, supplier[:, ["s_suppkey", "s_name"]]]


@query("SELECT c_custkey, lag(c_acctbal) OVER (ORDER BY c_custkey) AS before FROM customer")
def assign_a_frame(table):
    customer = table("customer").sort("c_custkey")
    customer[:, "before"] = customer[:, fn.shift(f.c_acctbal)]
    return customer[:, ["c_custkey", "before"]]


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS k FROM orders")
def assign_a_range(table):
    orders = table("orders").sort("o_orderkey")[:100, "o_orderkey"]
    rest = table("orders").sort("o_orderkey")[100:, "o_orderkey"]
    orders[:, "k"] = range(100)
    rest[:, "k"] = fn.cumcount().alias("k") + 100
    return shape.rbind(orders, rest[:, {"o_orderkey": f.o_orderkey, "k": f.k.as_type("int32")}])


# ---- statistics of a frame ----


@query("SELECT CAST(sum(p_size) AS BIGINT) AS p_size, CAST(NULL AS BIGINT) AS p_brand FROM part")
def frame_sum(table):
    return table("part")[:, ["p_size", "p_brand"]].sum()


@query("SELECT min(c_acctbal) AS c_acctbal, min(c_nationkey) AS c_nationkey FROM customer UNION ALL SELECT max(c_acctbal), max(c_nationkey) FROM customer")
def frame_min_max(table):
    customer = table("customer")[:, ["c_acctbal", "c_nationkey"]]
    return shape.rbind(customer.min(), customer.max())


@query("SELECT round(avg(l_quantity), 9) AS q, round(avg(l_linenumber), 9) AS n FROM lineitem")
def frame_mean(table):
    return table("lineitem")[:, ["l_quantity", "l_linenumber"]].mean()[:, {"q": math.round(f.l_quantity, 9), "n": math.round(f.l_linenumber, 9)}]


# ---- more of joins and expressions ----


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_across_types(table):
    nation = table("nation")[:, ["n_nationkey", "n_name"]]
    nation.key = "n_nationkey"
    return table("customer")[:, {"c_custkey": f.c_custkey, "n_nationkey": f.c_nationkey.as_type(float)}][:, [f.c_custkey, g.n_name], join(nation)]


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, xor(CAST(l_discount > 0.05 AS INTEGER), CAST(l_tax > 0.05 AS INTEGER)) = 1 AS x FROM lineitem")
def logical_xor(table):
    return table("lineitem")[:, {"l_orderkey": f.l_orderkey, "l_linenumber": f.l_linenumber, "l_extendedprice": f.l_extendedprice, "x": (f.l_discount > 0.05) ^ (f.l_tax > 0.05)}]


@query("SELECT p_partkey, round(log2(pow(2, p_size / 10) + pow(2, p_size / 20)), 9) AS l2, round(p_size * pi(), 6) AS p, round(p_size * exp(1), 6) AS e, round(p_size * 2 * pi(), 6) AS t, round(p_size * (1 + sqrt(5)) / 2, 6) AS g FROM part")
def math_constants(table):
    return table("part")[:, {"p_partkey": f.p_partkey, "l2": math.round(math.logaddexp2(f.p_size / 10, f.p_size / 20), 9), "p": math.round(f.p_size * math.pi, 6), "e": math.round(f.p_size * math.e, 6), "t": math.round(f.p_size * math.tau, 6), "g": math.round(f.p_size * math.golden, 6)}]


# ---- sources and sinks ----


@query("SELECT * FROM (VALUES (1, 2.5::DOUBLE, 'x', TRUE, DATE '2021-03-04'), (20, NULL, 'y', FALSE, NULL), (NULL, -1e300, 'z', NULL, DATE '1969-12-31')) AS v(i, d, s, b, t)")
def fread_types(table):
    return files.fread(text='i,d,s,b,t\n1,2.5,x,true,2021-03-04\n20,,y,false,\n,-1e300,z,,1969-12-31\n')


@query("SELECT * FROM (VALUES (1, 'two' || chr(10) || 'lines'), (2, 'a \"quoted\" one'), (3, 'with, comma')) AS v(k, s)")
def fread_quotes(table):
    return files.fread(text='k,s\n1,"two\nlines"\n2,"a ""quoted"" one"\n3,"with, comma"\n')


@query("SELECT * FROM (VALUES (1, 2, NULL), (3, 4, 5), (6, NULL, NULL)) AS v(a, b, c)")
def fread_fill(table):
    return files.fread(text="a,b,c\n1,2\n3,4,5\n6\n", fill=True)


@query("SELECT * FROM (VALUES (1, NULL), (NULL, 'b'), (3, 'c')) AS v(a, b)")
def fread_na_strings(table):
    return files.fread(text="a;b\n1;none\n-;b\n3;c\n", na_strings=["none", "-"])


@query("SELECT * FROM (VALUES (1, 2), (3, 4)) AS v(x, y)")
def fread_skip_to_string(table):
    return files.fread(text="remarks\nand more\nx,y\n1,2\n3,4\n", skip_to_string="x,y")


@query("SELECT * FROM (VALUES (1, 2), (3, 4)) AS v(x, z)")
def fread_columns(table):
    return files.fread(text="x,y,z\n1,a,2\n3,b,4\n", columns=["x", None, "z"])


@query("SELECT * FROM (VALUES (1), (2), (3)) AS v(x)")
def iread_parts(table):
    return shape.rbind(*files.iread(["x\n1\n2\n", "x\n3\n"]))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def csv_round_trip(table):
    return files.fread(text=table("nation").to_csv(quoting="all"))


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def parquet_round_trip(table):
    supplier = table("supplier")
    supplier.key = "s_suppkey"
    path = new_path(supplier.df.sparkSession, "frame")
    supplier.to_jay(path)
    back = files.load(path)
    if back.key != ("s_suppkey",):
        raise ValueError(f"the key came back as {back.key}")
    return back


@query("SELECT * FROM (VALUES (1, 'a', 0.5::DOUBLE), (NULL, 'b', NULL), (3, NULL, 2.0)) AS v(i, s, d)")
def frame_from_python(table):
    return Frame({"i": [1, None, 3], "s": ["a", "b", None], "d": [0.5, float("nan"), 2.0]})


# ---- sort ----


@query("SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey DESC, s_acctbal, s_suppkey) - 1 AS pos FROM supplier")
def sort_multi_reverse(table):
    return table("supplier")[:, {"s_suppkey": f.s_suppkey, "pos": fn.cumcount()}, sort(f.s_nationkey, f.s_acctbal, f.s_suppkey, reverse=[True, False, False])]


@query(f"SELECT doc_id, row_number() OVER (ORDER BY quality NULLS FIRST, doc_id) - 1 AS pos FROM {_LABELLED}")
def sort_na_first(table):
    return _labelled(table)[:, {"doc_id": f.doc_id, "pos": fn.cumcount()}, sort("quality", "doc_id")]


@query(f"SELECT doc_id, row_number() OVER (ORDER BY quality DESC, doc_id) - 1 AS pos FROM {_LABELLED} WHERE quality IS NOT NULL")
def sort_na_remove(table):
    return _labelled(table)[:, {"doc_id": f.doc_id, "pos": fn.cumcount()}, sort(-f.quality, f.doc_id, na_position="remove")]


# ---- joins ----


def _keyed(table, name: str, key: str, as_key: str | None = None) -> Frame:
    frame = table(name)
    if as_key:
        frame.names = {key: as_key}
    frame.key = as_key or key
    return frame


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def join_left_keyed(table):
    return table("orders")[:, [f.o_orderkey, g.c_name], join(_keyed(table, "customer", "c_custkey", "o_custkey"))]


@query("SELECT s_suppkey, n_name, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_small(table):
    return table("supplier")[:, [f.s_suppkey, g.n_name, f.s_acctbal], join(_keyed(table, "nation", "n_nationkey", "s_nationkey"))]


@query("""SELECT l_orderkey, l_linenumber, m, l_quantity FROM lineitem JOIN (SELECT l_suppkey AS sk, l_returnflag AS rf, max(l_quantity) AS m FROM lineitem GROUP BY 1, 2) ON l_suppkey = sk AND l_returnflag = rf""")
def join_multi_key(table):
    lineitem = table("lineitem")
    top = lineitem[:, {"m": fn.max(f.l_quantity)}, by("l_suppkey", "l_returnflag")]
    top.key = ["l_suppkey", "l_returnflag"]
    return lineitem[:, [f.l_orderkey, f.l_linenumber, g.m, f.l_quantity], join(top)]


@query("SELECT c_custkey, n_name, mx FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS mx FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def join_two_frames(table):
    orders = table("orders")[:, {"mx": fn.max(f.o_totalprice)}, by(f.o_custkey.alias("c_custkey"))]
    orders.key = "c_custkey"
    return table("customer")[:, [f.c_custkey, g.n_name, g.mx], join(_keyed(table, "nation", "n_nationkey", "c_nationkey")), join(orders)]


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_unmatched_na(table):
    return table("documents")[:, [f.doc_id, g.quality], join(_keyed(table, "labels", "doc_id"))]


@query(f"SELECT a.doc_id, b.n FROM {_LABELLED} a LEFT JOIN (SELECT quality, count(*) AS n FROM {_LABELLED} GROUP BY 1) b ON a.quality IS NOT DISTINCT FROM b.quality")
def join_null_key_match(table):
    docs = _labelled(table)
    counts = docs[:, {"n": fn.count()}, by("quality")]
    counts.key = "quality"
    return docs[:, [f.doc_id, g.n], join(counts)]


@query("SELECT s_suppkey, n_name AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def join_update(table):
    supplier = table("supplier")
    supplier[:, "nation", join(_keyed(table, "nation", "n_nationkey", "s_nationkey"))] = g.n_name
    return supplier[:, ["s_suppkey", "nation"]]


@query("SELECT r_name, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def join_group_agg(table):
    x = table("orders")[:, [f.o_totalprice, g.c_nationkey], join(_keyed(table, "customer", "c_custkey", "o_custkey"))]
    x = x[:, [f.o_totalprice, g.n_regionkey], join(_keyed(table, "nation", "n_nationkey", "c_nationkey"))]
    x = x[:, [f.o_totalprice, g.r_name], join(_keyed(table, "region", "r_regionkey", "n_regionkey"))]
    return x[:, {"total": math.round(fn.sum(f.o_totalprice), 2)}, by("r_name")]


# ---- update and delete ----


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN 0 ELSE p_size END AS p_size FROM part")
def update_masked(table):
    part = table("part")
    part[f.p_size > 25, "p_size"] = 0
    return part[:, ["p_partkey", "p_size"]]


@query("SELECT s_suppkey, round(s_acctbal / sum(s_acctbal) OVER (PARTITION BY s_nationkey), 10) AS share FROM supplier")
def update_by_group(table):
    supplier = table("supplier")
    supplier[:, "share", by("s_nationkey")] = math.round(f.s_acctbal / fn.sum(f.s_acctbal), 10)
    return supplier[:, ["s_suppkey", "share"]]


@query("SELECT p_partkey FROM part WHERE NOT p_size < 10")
def delete_rows(table):
    part = table("part")
    del part[f.p_size < 10, :]
    return part[:, "p_partkey"]


@query("SELECT p_partkey, CASE WHEN p_size < 10 THEN NULL ELSE p_brand END AS p_brand FROM part")
def delete_cells(table):
    part = table("part")
    del part[f.p_size < 10, "p_brand"]
    return part[:, ["p_partkey", "p_brand"]]


@query("SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 100 WHEN 1 THEN NULL ELSE n_regionkey END AS n_regionkey FROM (SELECT n_nationkey + 50 AS n_nationkey, n_regionkey FROM nation)")
def replace_values(table):
    nation = table("nation")[:, {"n_nationkey": f.n_nationkey + 50, "n_regionkey": f.n_regionkey}]
    nation.replace({0: 100, 1: None})
    return nation


# ---- sets and shapes ----


@query("SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(table):
    return shape.union(table("customer")[:, "c_nationkey"], table("supplier")[:, "s_nationkey"])


@query("SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders")
def set_intersect(table):
    return shape.intersect(table("customer")[:, "c_custkey"], table("orders")[:, "o_custkey"])


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_setdiff(table):
    return shape.setdiff(table("customer")[:, "c_custkey"], table("orders")[:, "o_custkey"])


@query("SELECT v AS p_size FROM (SELECT DISTINCT p_size AS v FROM part UNION ALL SELECT DISTINCT n_nationkey FROM nation UNION ALL SELECT DISTINCT n_regionkey FROM nation) GROUP BY v HAVING count(*) % 2 = 1")
def set_symdiff3(table):
    return shape.symdiff(table("part")[:, "p_size"], table("nation")[:, "n_nationkey"], table("nation")[:, "n_regionkey"])


@query("SELECT n_nationkey FROM nation UNION SELECT n_regionkey FROM nation")
def unique_values(table):
    return shape.unique(table("nation")[:, ["n_nationkey", "n_regionkey"]])


@query("SELECT c_name AS name, c_nationkey AS nation, c_acctbal AS bal FROM customer UNION ALL SELECT s_name, s_nationkey, NULL FROM supplier")
def rbind_force(table):
    return shape.rbind(table("customer")[:, {"name": f.c_name, "nation": f.c_nationkey, "bal": f.c_acctbal}], table("supplier")[:, {"name": f.s_name, "nation": f.s_nationkey}], force=True)


@query("SELECT n_nationkey, n_name AS other FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS r FROM nation) JOIN (SELECT n_name, row_number() OVER (ORDER BY n_nationkey DESC) AS r FROM nation) USING (r)")
def cbind_aligned(table):
    nation = table("nation")
    return named(shape.cbind(nation[:, "n_nationkey", sort("n_nationkey")], nation[:, "n_name", sort(-f.n_nationkey)]), "n_nationkey", "other")


@query("SELECT o_orderkey, other FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) JOIN (SELECT o_orderkey AS other, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS r FROM orders) USING (r)")
def cbind_large(table):
    orders = table("orders")
    return named(shape.cbind(orders[:, "o_orderkey", sort("o_orderkey")], orders[:, "o_orderkey", sort("o_totalprice", "o_orderkey")]), "o_orderkey", "other")


@query("SELECT r_name FROM region, range(3)")
def repeat_frame(table):
    return shape.repeat(table("region")[:, "r_name"], 3)


# ---- scalars ----


@query(f"SELECT doc_id, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 'good' WHEN n_chars > 1000 THEN 'long' ELSE 'other' END AS kind FROM {_LABELLED}")
def ifelse_nway(table):
    quality = fn.ifelse(math.isna(f.quality), None, f.quality == 1)
    return _labelled(table)[:, {"doc_id": f.doc_id, "kind": fn.ifelse(quality, "good", f.n_chars > 1000, "long", "other")}]


@query("""SELECT o_orderkey, CAST(trunc(o_totalprice) AS INTEGER) AS i, CAST(o_custkey AS VARCHAR) AS s, CAST(o_custkey AS DOUBLE) AS d, CAST(o_orderdate AS DATE) AS day, o_custkey <> 0 AS b,
 CASE WHEN o_totalprice > 1000 THEN 'True' ELSE 'False' END AS bs, CAST(NULL AS INTEGER) AS bad FROM orders""")
def cast_matrix(table):
    return table("orders")[:, {"o_orderkey": f.o_orderkey, "i": f.o_totalprice.as_type("int32"), "s": f.o_custkey.as_type(str), "d": f.o_custkey.as_type(float), "day": f.o_orderdate.as_type("date32"), "b": f.o_custkey.as_type(bool), "bs": (f.o_totalprice > 1000).as_type(str), "bad": f.o_orderpriority.as_type("int32")}]


@query("SELECT p_partkey, p_brand || '/' || p_type AS bt, CAST(length(p_name) AS BIGINT) AS n, substr(p_name, 2, 4) AS mid, reverse(p_brand) AS back, right(p_name, 3) AS tail FROM part")
def str_concat_len_slice(table):
    return table("part")[:, {"p_partkey": f.p_partkey, "bt": f.p_brand + "/" + f.p_type, "n": strings.len(f.p_name), "mid": f.p_name[1:5], "back": f.p_brand[::-1], "tail": f.p_name[-3:]}]


@query("SELECT c_custkey, regexp_full_match(c_mktsegment, '[A-M].*') AS early, regexp_full_match(c_name, 'CUSTOMER.*', 'i') AS icase FROM customer")
def re_match_full(table):
    return table("customer")[:, {"c_custkey": f.c_custkey, "early": strings.match(f.c_mktsegment, "[A-M].*"), "icase": strings.match(f.c_name, "CUSTOMER.*", icase=True)}]


@query("SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(month(ts) AS INTEGER) AS m, CAST(day(ts) AS INTEGER) AS d, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s, CAST(isodow(ts) AS INTEGER) AS w, CAST(epoch_us(ts) % 1000000 * 1000 AS INTEGER) AS ns FROM events")
def time_parts(table):
    return table("events")[:, {"event_id": f.event_id, "y": times.year(f.ts), "m": times.month(f.ts), "d": times.day(f.ts), "h": times.hour(f.ts), "mi": times.minute(f.ts), "s": times.second(f.ts), "w": times.day_of_week(f.ts), "ns": times.nanosecond(f.ts)}]


@query("SELECT p_partkey, TRY_CAST('2023-' || lpad(CAST(p_size % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(p_size % 33 AS VARCHAR), 2, '0') AS DATE) AS d FROM part")
def time_ymd_invalid(table):
    return table("part")[:, {"p_partkey": f.p_partkey, "d": times.ymd(2023, f.p_size % 14, f.p_size % 33)}]


@query("SELECT p_partkey, make_timestamp(2020, 2, CAST(p_size % 28 + 1 AS BIGINT), 5, 6, 7.0) AS ts FROM part")
def time_ymdt(table):
    return table("part")[:, {"p_partkey": f.p_partkey, "ts": times.ymdt(2020, 2, f.p_size % 28 + 1, 5, 6, 7)}]


@query("SELECT p_partkey, round(sin(p_size), 9) AS s, round(atan(p_size), 9) AS a, round(radians(p_size), 9) AS r, CASE WHEN p_size > 1 THEN NULL ELSE round(asin(p_size), 9) END AS asin_, round(atan2(p_size, 3), 9) AS a2 FROM part")
def math_trig(table):
    return table("part")[:, {"p_partkey": f.p_partkey, "s": math.round(math.sin(f.p_size), 9), "a": math.round(math.arctan(f.p_size), 9), "r": math.round(math.deg2rad(f.p_size), 9), "asin_": math.round(math.arcsin(f.p_size), 9), "a2": math.round(math.atan2(f.p_size, 3), 9)}]


@query("SELECT p_partkey, CASE WHEN p_size < 25 THEN NULL WHEN p_size = 25 THEN '-inf' ELSE CAST(round(ln(p_size - 25), 6) AS VARCHAR) END IS NULL AS na, round(exp(p_size / 10), 6) AS e, round(cbrt(p_size), 9) AS c, CASE WHEN p_size < 25 THEN NULL ELSE round(sqrt(p_size - 25), 9) END AS q FROM part")
def math_explog_edges(table):
    x = f.p_size - 25
    return table("part")[:, {"p_partkey": f.p_partkey, "na": math.isna(math.log(x)), "e": math.round(math.exp(f.p_size / 10), 6), "c": math.round(math.cbrt(f.p_size), 9), "q": math.round(math.sqrt(x), 9)}]


@query("SELECT p_partkey, round_even(CAST(p_size AS DOUBLE) / 2, 0) AS half, CAST(round_even(CAST(p_size AS DOUBLE) / 2, 0) AS BIGINT) AS whole, ceil(p_retailprice) AS up, floor(p_retailprice) AS down, trunc(p_retailprice) AS cut_ FROM part")
def math_round_even(table):
    return table("part")[:, {"p_partkey": f.p_partkey, "half": math.rint(f.p_size / 2), "whole": math.round(f.p_size / 2), "up": math.ceil(f.p_retailprice), "down": math.floor(f.p_retailprice), "cut_": math.trunc(f.p_retailprice)}]


@query("SELECT p_partkey, round(gamma(p_size / 10 + 1), 8) AS g, round(lgamma(p_size), 8) AS lg FROM part")
def math_special(table):
    return table("part")[:, {"p_partkey": f.p_partkey, "g": math.round(math.gamma(f.p_size / 10 + 1), 8), "lg": math.round(math.lgamma(f.p_size), 8)}]


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, abs(l_discount - l_tax) <= 1e-8 + 1e-5 * abs(l_tax) AS close FROM lineitem")
def isclose(table):
    return table("lineitem")[:, {"l_orderkey": f.l_orderkey, "l_linenumber": f.l_linenumber, "l_extendedprice": f.l_extendedprice, "close": math.isclose(f.l_discount, f.l_tax)}]


@query(f"""SELECT doc_id, coalesce(quality, 0) + coalesce(toxic, 0) AS s, CAST((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT AS INTEGER) AS n, least(quality, toxic) AS lo, greatest(quality, toxic) AS hi, coalesce(quality, toxic) AS fst,
 CASE WHEN quality IS NULL AND toxic IS NULL THEN NULL ELSE (coalesce(quality, 0) + coalesce(toxic, 0)) / ((quality IS NOT NULL)::INT + (toxic IS NOT NULL)::INT) END AS m FROM {_LABELLED}""")
def rowwise_numbers(table):
    x = f["quality":"toxic"]
    return _labelled(table)[:, {"doc_id": f.doc_id, "s": fn.rowsum(x), "n": fn.rowcount(x), "lo": fn.rowmin(x), "hi": fn.rowmax(x), "fst": fn.rowfirst(x), "m": fn.rowmean(x)}]


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, CAST(CASE WHEN l_discount <= l_tax THEN 0 ELSE 1 END AS BIGINT) AS lo, CAST(CASE WHEN l_discount >= l_tax THEN 0 ELSE 1 END AS BIGINT) AS hi, l_discount > 0.05 AND l_tax > 0.05 AS all_, l_discount > 0.05 OR l_tax > 0.05 AS any_ FROM lineitem")
def rowwise_arg_and_logic(table):
    x = [f.l_discount, f.l_tax]
    return table("lineitem")[:, {"l_orderkey": f.l_orderkey, "l_linenumber": f.l_linenumber, "l_extendedprice": f.l_extendedprice, "lo": fn.rowargmin(x), "hi": fn.rowargmax(x), "all_": fn.rowall(f.l_discount > 0.05, f.l_tax > 0.05), "any_": fn.rowany(f.l_discount > 0.05, f.l_tax > 0.05)}]


@query("SELECT list_contains(w, 'AFRICA') AS \"AFRICA\", list_contains(w, 'AMERICA') AS \"AMERICA\", list_contains(w, 'ASIA') AS \"ASIA\", list_contains(w, 'EUROPE') AS \"EUROPE\", list_contains(w, 'MIDDLE EAST') AS \"MIDDLE EAST\" FROM (SELECT [r_name] AS w FROM region)")
def split_into_nhot(table):
    return strings.split_into_nhot(table("region")[:, "r_name"])


# ---- categories ----


@query("SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS code FROM customer")
def cat_codes(table):
    return table("customer")[:, {"c_custkey": f.c_custkey, "code": fn.codes(f.c_mktsegment)}]


@query("SELECT DISTINCT c_mktsegment FROM customer")
def cat_categories(table):
    return fn.categories(table("customer"), "c_mktsegment")


# ---- models ----


@query("SELECT fold, count(*) AS n FROM (SELECT CAST(((row_number() OVER (ORDER BY c_custkey) - 1) * 4 + 3) // (SELECT count(*) FROM customer) AS INTEGER) AS fold FROM customer) GROUP BY fold")
def kfold_sizes(table):
    return models.kfold(table("customer").sort("c_custkey"), 4)[:, {"n": fn.count()}, by("fold")]


@query("SELECT o_orderkey, CAST(((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) * 5 + 4) // (SELECT count(*) FROM orders) AS INTEGER) AS fold FROM orders")
def kfold_members(table):
    return models.kfold(table("orders").sort("o_totalprice", "o_orderkey"), 5)[:, ["o_orderkey", "fold"]]


@query("SELECT CAST(range AS INTEGER) AS fold, (range + 1) * c // 4 - range * c // 4 AS n FROM range(4), (SELECT count(*) AS c FROM customer)")
def kfold_random_sizes(table):
    return models.kfold_random(table("customer").sort("c_custkey"), 4, seed=7)[:, {"n": fn.count()}, by("fold")]


@query("""SELECT CAST(b AS INTEGER) AS exemplar_id, count(*) AS members_count FROM (SELECT least(floor((c_acctbal - lo) / (hi - lo) * (1 - 1e-9) * 20), 19) AS b FROM customer, (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer)) GROUP BY b""")
def aggregate_1d(table):
    exemplars, _ = models.aggregate(table("customer")[:, "c_acctbal"], n_bins=20)
    return exemplars[:, ["exemplar_id", "members_count"]]


@query("SELECT c_mktsegment, count(*) AS members_count FROM customer GROUP BY 1")
def aggregate_categories(table):
    exemplars, _ = models.aggregate(table("customer")[:, "c_mktsegment"])
    return exemplars[:, ["c_mktsegment", "members_count"]]


@query()
def ftrl_predictions(table):
    x = table("lineitem")[:, {"l_quantity": f.l_quantity, "l_discount": f.l_discount, "l_linestatus": f.l_linestatus, "y": f.l_returnflag == "R"}]
    model = models.Ftrl(nbins=1 << 12, nepochs=1).fit(x, "y")
    return model.predict(x)


@query()
def linear_predictions(table):
    x = table("customer")[:, {"x": f.c_acctbal / 10000, "y": f.c_acctbal / 5000 + 1}]
    return models.LinearModel(eta0=0.1, nepochs=20, model_type="regression").fit(x, "y").predict(x)
