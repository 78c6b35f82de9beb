"""A query for each operator, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relkit.entity import Entity, Property
from relkit.functions import expr as e
from relkit.functions import fulltext
from relkit.model import ENTITIES, catalog
from relkit.operators import mutate
from relkit.operators.query import Query
from relkit.plans.capture import Capture
from relkit.plans.session import Session, current, scope
from relkit.sources.repository import Repository

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    """Registers a function of a catalogue, under its name, with its SQL."""

    def wrap(f: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            out = f(catalog(spark, sf_dir))
            return out.build() if isinstance(out, Query) else out

        QUERIES[f.__name__.rstrip("_")] = run
        if sql:
            ORACLES[f.__name__.rstrip("_")] = sql
        return f

    return wrap


def q(c, name: str) -> Query:
    return Query.of(c, name)


def flat(df: DataFrame, **columns) -> DataFrame:
    """Typed outputs: integers as bigint, so that both engines agree."""
    return df.select(*(v.alias(k) for k, v in columns.items()))


def money(column) -> object:
    """An exact sum: decimals don't depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(18,4)") if isinstance(column, str) else column.cast("decimal(18,4)")).cast("double")


# --- scans and reads ------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice, o_orderdate, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def flagship_open_orders(c):
    found = q(c, "orders").where(lambda t: t.o_orderstatus == "O").include("customer")
    return found.order_by_descending("o_totalprice").then_by("o_orderkey").take(10).select("o_orderkey", "o_totalprice", "o_orderdate", c_name=F.col("customer.c_name"))


@query("SELECT * FROM orders")
def scan_orders(c):
    return q(c, "orders")


@query("SELECT * FROM customer WHERE c_acctbal < 0")
def read_many(c):
    return Repository(c, "customer").read_many(lambda t: t.c_acctbal < 0)


@query("SELECT * FROM orders WHERE o_orderkey = 77")
def read_by_id(c):
    return q(c, "orders").where(F.col("o_orderkey") == 77).take(1)


@query("SELECT * FROM customer ORDER BY c_acctbal, c_custkey LIMIT 1")
def read_first_ordered(c):
    return q(c, "customer").order_by("c_acctbal", "c_custkey").take(1)


@query("SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 100000) AS has_large, EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0) AS has_negative")
def exists_flag(c):
    r = Repository(c, "orders")
    return c.spark.createDataFrame([(r.exists(F.col("o_totalprice") > 100000), r.exists(F.col("o_totalprice") < 0))], "has_large boolean, has_negative boolean")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000")
def from_sql_params(c):
    return Repository(c, "orders").from_sql("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", ["F", 200000])


@query("SELECT n_name AS name, count(*) AS customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def from_sql_tables(c):
    """SQL over two tables, with names and types of its own."""
    sql = "SELECT n_name, count(*), sum(CAST(c_acctbal AS DECIMAL(18,4))) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name"
    return Repository(c, "customer").from_sql(sql, result="name string, customers bigint, balance double")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey = 5")
def read_single(c):
    r = Repository(c, "customer")
    none = r.read_single_or_default(F.col("c_custkey") < 0)
    found = [x for x in (r.read_single(F.col("c_custkey") == 5), none) if x is not None]
    return c.spark.createDataFrame([(x.c_custkey, x.c_name) for x in found], "c_custkey bigint, c_name string")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(n_nationkey) AS BIGINT) AS keys FROM nation")
def iterate_rows(c):
    """Rows one by one, and a job beside the caller."""
    from relkit.streaming.cursor import Job, iterate

    n = Job(c.frame("nation"), lambda d: d.count()).result(600)
    return c.spark.createDataFrame([(n, sum(r.n_nationkey for r in iterate(c.frame("nation"))))], "n bigint, keys bigint")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def from_raw(c):
    return q(c, "orders").from_raw("(SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment)")


# --- filters ---------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 150000")
def where_and(c):
    return q(c, "orders").where(lambda t: t.o_orderstatus == "O").where(lambda t: t.o_totalprice >= 150000).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey % 7 = 3")
def where_raw(c):
    return q(c, "orders").where_raw("o_orderpriority = {0} AND o_custkey % {1} = 3", "1-URGENT", 7).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 50000 AND 60000")
def where_between(c):
    return q(c, "orders").where(e.between("o_totalprice", 50000, 60000)).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)")
def where_in_list(c):
    return q(c, "part").where(e.is_in("p_size", [1, 5, 9])).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size NOT IN (1, 5, 9)")
def where_not_in_list(c):
    return q(c, "part").where(e.not_in("p_size", [1, 5, 9])).select("p_partkey")


@query("SELECT count(*) AS n FROM part WHERE false")
def where_in_empty(c):
    return q(c, "part").where(e.is_in("p_size", [])).build().agg(F.count("*").alias("n"))


_NULLED = "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p, CASE o_orderstatus WHEN 'P' THEN '' WHEN 'O' THEN '  ' ELSE o_orderstatus END AS s FROM orders"


@query(f"SELECT o_orderkey, p IS NULL AS is_null, p IS NOT NULL AS is_not_null, p IS NULL OR p = '' AS null_or_empty, s IS NULL OR s = '' AS s_empty, s IS NULL OR trim(s) = '' AS s_blank, NOT (s IS NULL OR trim(s) = '') AS s_said FROM ({_NULLED})")
def where_null_checks(c):
    base = q(c, "orders").select("o_orderkey", p=F.nullif("o_orderpriority", F.lit("5-LOW")), s=e.Case().when(F.col("o_orderstatus") == "P", "").when(F.col("o_orderstatus") == "O", "  ").otherwise(F.col("o_orderstatus")).column()).build()
    return base.select("o_orderkey", e.eq("p", None).alias("is_null"), e.ne("p", None).alias("is_not_null"), e.is_null_or_empty("p").alias("null_or_empty"), e.is_null_or_empty("s").alias("s_empty"), e.is_null_or_whitespace("s").alias("s_blank"), (~e.is_null_or_whitespace("s")).alias("s_said"))


@query("SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 300000) AND NOT (o_orderpriority = '5-LOW' OR o_custkey < 100)")
def where_bool_tree(c):
    return q(c, "orders").where(lambda t: ((t.o_orderstatus == "F") | (t.o_totalprice > 300000)) & ~((t.o_orderpriority == "5-LOW") | (t.o_custkey < 100))).select("o_orderkey")


@query("SELECT o_orderkey, o_custkey = 5 AS eq, o_custkey <> 5 AS ne, o_custkey < 50 AS lt, o_custkey <= 50 AS le, o_custkey > 50 AS gt, o_custkey >= 50 AS ge FROM orders")
def where_comparisons(c):
    k = F.col("o_custkey")
    return q(c, "orders").select("o_orderkey", eq=k == 5, ne=k != 5, lt=k < 50, le=k <= 50, gt=k > 50, ge=k >= 50)


@query("SELECT p_partkey, contains(p_name, '1') AS has, starts_with(p_brand, 'Brand#1') AS begins, suffix(p_type, 'L') AS ends FROM part")
def where_contains(c):
    return q(c, "part").select("p_partkey", has=e.contains("p_name", "1"), begins=e.starts_with("p_brand", "Brand#1"), ends=e.ends_with("p_type", "L"))


# --- projections -----------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_mktsegment AS segment FROM customer")
def select_members(c):
    return q(c, "customer").select("c_custkey", "c_name", segment="c_mktsegment")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice * (1 - l_discount) AS net, concat(l_returnflag, '/', l_linestatus) AS flags FROM lineitem")
def select_computed(c):
    return q(c, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", net=lambda t: t.l_extendedprice * (1 - t.l_discount), flags=e.concat("l_returnflag", F.lit("/"), "l_linestatus"))


@query("SELECT upper(c_name) AS loud, round(c_acctbal, 0) AS whole, c_nationkey FROM customer")
def select_raw(c):
    return q(c, "customer").select_raw("upper(c_name) AS loud, round(c_acctbal, 0) AS whole, c_nationkey")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct_flags(c):
    return q(c, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS band, CASE WHEN o_orderstatus = 'F' THEN 1 END AS done FROM orders")
def case_bands(c):
    found = q(c, "orders").select_case("band", e.Case().when(F.col("o_totalprice") > 300000, "high").when_raw("o_totalprice > 100000", "middle").otherwise("low"))
    return found.select_case("done", e.Case().when(F.col("o_orderstatus") == "F", 1)).select("o_orderkey", "band", "done")


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_totalprice > 1000 ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 5")
def select_keeps_state(c):
    return q(c, "orders").order_by_descending("o_orderdate").then_by("o_orderkey").skip(5).take(20).select("o_orderkey", "o_orderdate").where(F.col("o_totalprice") > 1000)


# --- scalar functions ----------------------------------------------------------------


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l, trim('  ' || p_brand || ' ') AS t, CAST(length(p_name) AS BIGINT) AS n FROM part")
def str_upper_lower_trim_len(c):
    return q(c, "part").select("p_partkey", u=e.upper("p_name"), l=e.lower("p_type"), t=e.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))), n=e.length("p_name").cast("bigint"))


@query("SELECT p_partkey, substring(p_brand, 3) AS rest, substring(p_brand, 2, 3) AS mid, replace(p_type, 'E', '3') AS r, p_name || '-' || p_brand AS joined FROM part")
def substr_replace_concat(c):
    return q(c, "part").select("p_partkey", rest=e.substring("p_brand", 2), mid=e.substring("p_brand", 1, 3), r=e.replace("p_type", "E", "3"), joined=e.concat("p_name", F.lit("-"), "p_brand"))


@query("SELECT c_custkey, abs(c_acctbal) AS a, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(round(CAST(c_acctbal AS DECIMAL(18,4)), 1) AS DOUBLE) AS r, round(sqrt(abs(c_acctbal)), 6) AS s, round(sin(c_custkey), 9) AS si, round(cos(c_custkey), 9) AS co, round(tan(c_custkey), 6) AS ta, -c_acctbal AS neg FROM customer")
def math_suite(c):
    b, k = F.col("c_acctbal"), F.col("c_custkey")
    return q(c, "customer").select("c_custkey", a=e.abs_(b), f=e.floor(b), c=e.ceiling(b), r=e.round_(b.cast("decimal(18,4)"), 1).cast("double"), s=F.round(e.sqrt(F.abs(b)), 6), si=F.round(e.sin(k), 9), co=F.round(e.cos(k), 9), ta=F.round(e.tan(k), 6), neg=e.negate(b))


@query("SELECT o_orderkey, CASE WHEN nullif(o_custkey, 5) IS NULL THEN NULL ELSE greatest(o_custkey, o_orderkey) END AS g, CASE WHEN nullif(o_custkey, 5) IS NULL THEN NULL ELSE least(o_custkey, o_orderkey) END AS l FROM orders")
def greatest_least(c):
    k = F.nullif(F.col("o_custkey"), F.lit(5))
    return q(c, "orders").select("o_orderkey", g=e.greatest(k, "o_orderkey"), l=e.least(k, "o_orderkey"))


@query("SELECT o_orderkey, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS p, round(power(o_custkey, 1.5), 3) AS w FROM orders")
def coalesce_pow(c):
    return q(c, "orders").select("o_orderkey", p=e.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")), w=F.round(e.power("o_custkey", 1.5), 3))


@query("SELECT p_partkey, p_size / nullif(p_size % 4, 0) AS d, CAST(CASE WHEN p_size % 4 <> 0 THEN p_size // nullif(p_size % 4, 0) END AS BIGINT) AS i, p_size + 1 AS a, p_size - 1 AS s, p_size * 3 AS m, p_size % 5 AS r FROM part")
def arithmetic(c):
    z, four = F.col("p_size"), F.col("p_size") % 4
    return q(c, "part").select("p_partkey", d=e.divide(z, four), i=e.int_div(z, four), a=z + 1, s=z - 1, m=z * 3, r=e.modulo(z, 5))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 3 DAY AS d, o_orderdate + INTERVAL 5 HOUR AS h, o_orderdate - INTERVAL 90 MINUTE AS mi, o_orderdate + INTERVAL 1 MONTH AS mo, o_orderdate + INTERVAL 1 YEAR AS y, o_orderdate + INTERVAL 30 SECOND AS s FROM orders")
def date_add_suite(c):
    d = F.col("o_orderdate")
    return q(c, "orders").select("o_orderkey", d=e.add(d, days=3), h=e.add(d, hours=5), mi=e.add(d, minutes=-90), mo=e.add(d, months=1), y=e.add(d, years=1), s=e.add(d, seconds=30))


@query("SELECT event_id, year(ts) AS y, month(ts) AS mo, day(ts) AS d, hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events")
def date_parts(c):
    return q(c, "events").select("event_id", **{k: e.date_part(p, "ts").cast("bigint") for k, p in (("y", "year"), ("mo", "month"), ("d", "day"), ("h", "hour"), ("mi", "minute"), ("s", "second"))})


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS size FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'")
def ternary(c):
    return q(c, "orders").where(F.col("o_orderdate") >= e.date(1995, 1, 1)).select("o_orderkey", size=e.iif(F.col("o_totalprice") > 100000, "big", "small"))


@query("SELECT o_orderkey, o_orderdate < now()::TIMESTAMP AS past, o_orderdate < current_date AS before_today, true AS utc_past, [o_custkey, 7] AS pair, true AS some, false AS none FROM orders")
def now_array_any(c):
    d = F.col("o_orderdate")
    return q(c, "orders").select("o_orderkey", past=d < e.now(), before_today=d < e.today(), utc_past=d < e.utc_now(), pair=e.array(F.col("o_custkey"), F.lit(7).cast("bigint")), some=e.any_of([1]), none=e.any_of([]))


# --- joins ---------------------------------------------------------------------------


@query("SELECT o_orderkey, c_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def include_customer(c):
    return q(c, "orders").include("customer").select("o_orderkey", c_custkey=F.col("customer.c_custkey"), c_name=F.col("customer.c_name"), c_mktsegment=F.col("customer.c_mktsegment"))


@query("SELECT o_orderkey, c_name, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def include_customer_nation_region(c):
    found = q(c, "orders").include("customer").then_include("nation").then_include("region")
    return found.select("o_orderkey", c_name=F.col("customer.c_name"), n_name=F.col("customer.nation.n_name"), r_name=F.col("customer.nation.region.r_name"))


@query("SELECT c_custkey, count(o_orderkey) AS n_orders, coalesce(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE), 0) AS total, min(o_orderkey) AS first_order FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def include_orders_of_customer(c):
    o = F.col("orders")
    total = F.aggregate(o, F.lit(0).cast("decimal(38,4)"), lambda a, x: (a + x["o_totalprice"].cast("decimal(18,4)")).cast("decimal(38,4)")).cast("double")
    return q(c, "customer").include("orders").select("c_custkey", n_orders=F.size(o).cast("bigint"), total=total, first_order=F.array_min(F.transform(o, lambda x: x["o_orderkey"])))


@query("SELECT o_orderkey, count(DISTINCT p_partkey) AS n_parts, coalesce(sum(DISTINCT p_partkey), 0)::BIGINT AS part_keys FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey GROUP BY o_orderkey")
def include_parts_of_order(c):
    p = F.col("parts")
    return q(c, "orders").include("parts").select("o_orderkey", n_parts=F.size(p).cast("bigint"), part_keys=F.aggregate(p, F.lit(0).cast("bigint"), lambda a, x: a + x["p_partkey"]))


@query("SELECT n_name, count(*) AS n_customers, CAST(sum(n) AS BIGINT) AS n_orders FROM (SELECT n_name, c_custkey, count(o_orderkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name, c_custkey) GROUP BY n_name")
def include_through_collection(c):
    found = q(c, "nation").include("customers").then_include("orders").build().where(F.size("customers") > 0)
    return found.select("n_name", F.size("customers").cast("bigint").alias("n_customers"), F.aggregate("customers", F.lit(0).cast("bigint"), lambda a, x: a + F.size(x["orders"])).alias("n_orders"))


@query("SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' AND n_name LIKE '%A%'")
def nav_predicate(c):
    return q(c, "orders").include("customer").then_include("nation").where(lambda t: (t.customer.c_mktsegment == "BUILDING") & t.customer.nation.n_name.contains("A")).select("o_orderkey")


@query("SELECT o_orderkey, l_linenumber, l_quantity, l_partkey, l_suppkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_quantity > 45")
def join_raw_inner(c):
    return q(c, "orders").join_raw("INNER JOIN lineitem ON l_orderkey = t0.o_orderkey AND l_quantity > 45").select("o_orderkey", "l_linenumber", "l_quantity", "l_partkey", "l_suppkey")


@query("SELECT s_suppkey, c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey AND s_acctbal < c_acctbal AND c_acctbal > 9000")
def join_typed(c):
    on = (F.col("s_nationkey") == F.col("c_nationkey")) & (F.col("s_acctbal") < F.col("c_acctbal"))
    return q(c, "supplier").join_spread(q(c, "customer").where(F.col("c_acctbal") > 9000), on, "s_nationkey", "c_nationkey").select("s_suppkey", "c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def where_in_subquery(c):
    return q(c, "customer").where_in("c_custkey", q(c, "orders").where(F.col("o_totalprice") > 300000), "o_custkey").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def where_not_in_subquery(c):
    return q(c, "orders").where_not_in("o_orderkey", q(c, "lineitem"), "l_orderkey").select("o_orderkey")


@query("SELECT count(*) AS n FROM orders WHERE o_orderkey NOT IN (SELECT nullif(l_orderkey, 7) FROM lineitem UNION ALL SELECT NULL)")
def where_not_in_with_null(c):
    values = q(c, "lineitem").select(k=F.nullif("l_orderkey", F.lit(7))).build().union(c.spark.range(1).select(F.lit(None).cast("bigint")))
    return q(c, "orders").where_not_in("o_orderkey", values).build().agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 50) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)")
def where_in_raw(c):
    return q(c, "part").where_in_raw("p_partkey", "SELECT l_partkey FROM lineitem WHERE l_quantity >= 50").where_not_in_raw("p_partkey", "SELECT l_partkey FROM lineitem WHERE l_discount > 0.09").select("p_partkey")


@query("SELECT r_regionkey FROM region WHERE EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 1000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_totalprice < 0)")
def exists_uncorrelated(c):
    return q(c, "region").where_exists(q(c, "orders").where(F.col("o_totalprice") > 1000)).where_not_exists(q(c, "orders").where(F.col("o_totalprice") < 0)).select("r_regionkey")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def not_exists_correlated(c):
    return q(c, "orders").where_not_exists(q(c, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_orderkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def exists_correlated(c):
    return q(c, "customer").where_exists(q(c, "orders").where(F.col("o_orderstatus") == "P"), F.col("o_custkey") == F.col("c_custkey")).select("c_custkey")


# --- aggregates --------------------------------------------------------------------------


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_where(c):
    return q(c, "orders").where(F.col("o_orderstatus") == "F").build().agg(F.count("*").alias("n"))


@query("SELECT CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total, round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) / count(*), 6) AS mean, min(o_totalprice) AS least, max(o_orderdate) AS latest FROM orders")
def sum_avg_min_max(c):
    return q(c, "orders").build().agg(money("o_totalprice").alias("total"), F.round(money("o_totalprice") / F.count("*"), 6).alias("mean"), F.min("o_totalprice").alias("least"), F.max("o_orderdate").alias("latest"))


@query("SELECT CAST(0 AS DOUBLE) AS total, CAST(0 AS DOUBLE) AS mean, CAST(0 AS BIGINT) AS n")
def sum_empty_is_zero(c):
    none = q(c, "orders").where(F.col("o_totalprice") < 0)
    return c.spark.createDataFrame([(float(none.sum("o_totalprice")), float(none.average("o_totalprice")), none.count())], "total double, mean double, n bigint")


@query("SELECT count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders ORDER BY o_custkey LIMIT 50)")
def count_over_built(c):
    return c.spark.createDataFrame([(q(c, "orders").select("o_custkey").distinct().order_by("o_custkey").take(50).count(),)], "n bigint")


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) AS DOUBLE) AS total, min(o_totalprice) AS least, max(o_totalprice) AS most FROM orders GROUP BY o_orderstatus")
def group_count(c):
    return q(c, "orders").group_by("o_orderstatus").select(n=F.count("*"), total=money("o_totalprice"), least=F.min("o_totalprice"), most=F.max("o_totalprice"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 200000")
def group_having(c):
    return q(c, "orders").group_by("o_custkey").having(lambda g: (g.count() > 12) & (g.max("o_totalprice") > 200000)).select(n=F.count("*"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority")
def group_multi_key(c):
    return q(c, "orders").group_by("o_orderstatus", "o_orderpriority").select(n=F.count("*"))


@query("SELECT year(o_orderdate) AS y, o_totalprice > 150000 AS large, count(*) AS n FROM orders GROUP BY ALL")
def group_computed_key(c):
    return q(c, "orders").group_by(y=F.year("o_orderdate").cast("bigint"), large=lambda t: t.o_totalprice > 150000).select(n=F.count("*"))


@query("SELECT o_custkey, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY o_custkey HAVING count(*) >= 14")
def group_members_having(c):
    found = q(c, "orders").group_by("o_custkey").having(lambda g: g.count() >= 14).members()
    return found.select("o_custkey", F.size("members").cast("bigint").alias("n"), F.aggregate("members", F.lit(0).cast("bigint"), lambda a, x: a + x["o_orderkey"]).alias("keys"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) <= 6)")
def group_rows_having(c):
    return q(c, "orders").group_by("o_custkey").having(lambda g: g.count() <= 6).rows().select("o_orderkey", "o_custkey")


@query("SELECT count(*) AS n, max(o_totalprice) AS most FROM orders WHERE o_orderstatus = 'O'")
def group_scalars(c):
    g = q(c, "orders").where(F.col("o_orderstatus") == "O").group_by("o_custkey")
    return c.spark.createDataFrame([(g.count(), g.max("o_totalprice"))], "n bigint, most double")


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,4))) AS DOUBLE) AS qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,4))) AS DOUBLE) AS price, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def group_pricing_summary(c):
    return q(c, "lineitem").where(F.col("l_shipdate") <= e.date(1998, 9, 2)).group_by("l_returnflag", "l_linestatus").select(qty=money("l_quantity"), price=money("l_extendedprice"), n=F.count("*"))


# --- windows --------------------------------------------------------------------------------

_W = "PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey"


def _window(name: str, sql: str, add: Callable, order: bool = True) -> None:
    def run(c):
        w = q(c, "orders").window("o_custkey", ["o_orderdate", "o_orderkey"] if order else [])
        found = add(w).end().build()
        return found.select("o_orderkey", *((F.col(x).cast("bigint") if t == "int" else F.col(x)) for x, t in found.dtypes if x not in c.entity("orders").columns))

    run.__name__ = name
    query(f"SELECT o_orderkey, {sql} FROM orders")(run)


_window("win_row_number", f"row_number() OVER ({_W}) AS v", lambda w: w.row_number("v"))
_window("win_rank", "rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS v, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS d", lambda w: w.query.window("o_custkey", "o_orderpriority").rank("v").dense_rank("d"))
_window("win_lead", f"lead(o_totalprice, 2, -1.0) OVER ({_W}) AS v", lambda w: w.lead("v", "o_totalprice", 2, -1.0))
_window("win_lag", f"lag(o_totalprice) OVER ({_W}) AS v", lambda w: w.lag("v", "o_totalprice"))
_window("win_first_value", f"first_value(o_totalprice) OVER ({_W}) AS v", lambda w: w.first_value("v", "o_totalprice"))
_window("win_last_value", f"last_value(o_totalprice) OVER ({_W}) AS v", lambda w: w.last_value("v", "o_totalprice"))
_window("win_nth_value", f"nth_value(o_totalprice, 3) OVER ({_W}) AS v", lambda w: w.nth_value("v", "o_totalprice", 3))
_window("win_sum", f"CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER ({_W}) AS DOUBLE) AS v", lambda w: w.sum("s", F.col("o_totalprice").cast("decimal(18,4)")).end().with_column("v", F.col("s").cast("double")).with_column("s", F.lit(None)).window().query.select("o_orderkey", "v").window())
_window("win_avg", "round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,4))) OVER (PARTITION BY o_custkey) AS DOUBLE) / count(*) OVER (PARTITION BY o_custkey), 6) AS v", lambda w: w.avg("a", F.col("o_totalprice").cast("decimal(18,4)")).sum("s", F.col("o_totalprice").cast("decimal(18,4)")).count("n").end().with_column("v", F.round(F.col("s").cast("double") / F.col("n"), 6)).select("o_orderkey", "v").window(), order=False)
_window("win_count", f"count(*) OVER ({_W}) AS v", lambda w: w.count("v"))
_window("win_min_max", f"min(o_totalprice) OVER ({_W}) AS lo, max(o_totalprice) OVER ({_W}) AS hi", lambda w: w.min("lo", "o_totalprice").max("hi", "o_totalprice"))
_window("win_rows_n", f"count(*) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS n, max(o_totalprice) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS v", lambda w: w.rows(2, 1).count("n").max("v", "o_totalprice"))
_window("win_rows_unbounded", f"count(*) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, count(*) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f", lambda w: w.rows_unbounded_preceding().count("b").rows_unbounded_following().count("f"))
_window("win_rows_between", f"max(o_totalprice) OVER ({_W} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS v, last_value(o_orderkey) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l", lambda w: w.rows_between("3 preceding", "1 preceding").max("v", "o_totalprice").rows_between("UNBOUNDED PRECEDING", "UNBOUNDED FOLLOWING").last_value("l", "o_orderkey"))
_window("win_range_n", "count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 10000 PRECEDING AND 10000 FOLLOWING) AS n, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b", lambda w: w.query.window("o_custkey", "o_totalprice").range(10000, 10000).count("n").range_unbounded_preceding().count("b"))
_window("win_range_between", "count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN 20000 PRECEDING AND 5000 PRECEDING) AS n, max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN CURRENT ROW AND 30000 FOLLOWING) AS v, count(*) OVER (PARTITION BY o_custkey ORDER BY o_totalprice RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f", lambda w: w.query.window("o_custkey", "o_totalprice").range_between("20000 PRECEDING", "5000 PRECEDING").count("n").range_between("CURRENT ROW", "30000 FOLLOWING").max("v", "o_totalprice").range_unbounded_following().count("f"))
_window("win_multi", f"row_number() OVER ({_W}) AS n, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r", lambda w: w.row_number("n").end().window("o_orderstatus").order_by_descending("o_totalprice").order_by("o_orderkey").rank("r"))


# --- order and pages ---------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 100")
def order_then(c):
    return q(c, "orders").order_by("o_orderpriority").then_by_descending("o_totalprice").then_by("o_orderkey").take(100).select("o_orderkey", "o_orderpriority", "o_totalprice")


@query("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 1000")
def skip_only(c):
    return q(c, "customer").order_by("c_custkey").skip(1000).select("c_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def take_topk(c):
    return q(c, "orders").order_by_descending("o_totalprice").then_by("o_orderkey").take(25).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_name, p_partkey LIMIT 20 OFFSET 40")
def page(c):
    return q(c, "part").order_by("p_name", "p_partkey").skip(40).take(20).select("p_partkey", "p_name")


@query("SELECT o_orderkey, p FROM (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders) ORDER BY p ASC NULLS FIRST, o_orderkey LIMIT 30")
def order_nulls_first(c):
    return q(c, "orders").with_column("p", F.nullif("o_orderpriority", F.lit("5-LOW"))).order_by("p", "o_orderkey").take(30).select("o_orderkey", "p")


# --- set operations -----------------------------------------------------------------------------


def _custs(c, p) -> Query:
    return q(c, "orders").where(p).select("o_custkey")


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'O'")
def union(c):
    return _custs(c, F.col("o_orderstatus") == "F").union(_custs(c, F.col("o_orderstatus") == "O"))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def union_all(c):
    return _custs(c, F.col("o_orderstatus") == "F").union_all(_custs(c, F.col("o_totalprice") > 200000))


@query("SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def intersect(c):
    return _custs(c, F.col("o_orderstatus") == "P").intersect(_custs(c, F.col("o_totalprice") > 300000))


@query("SELECT o_custkey FROM orders EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def except_(c):
    return _custs(c, F.lit(True)).except_(_custs(c, F.col("o_totalprice") > 300000))


@query("((SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT o_custkey FROM orders WHERE o_custkey < 50) INTERSECT SELECT o_custkey FROM orders WHERE o_totalprice > 250000) EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def chained_sets(c):
    return _custs(c, F.col("o_orderstatus") == "P").union(_custs(c, F.col("o_custkey") < 50)).intersect(_custs(c, F.col("o_totalprice") > 250000)).except_(_custs(c, F.col("o_orderpriority") == "1-URGENT"))


# --- CTEs -----------------------------------------------------------------------------------------


@query("WITH big AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY o_custkey) SELECT o_custkey, n FROM big WHERE n > 5")
def cte_simple(c):
    return q(c, "orders").with_cte("big", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_totalprice > 150000 GROUP BY o_custkey").from_raw("big").where(F.col("n") > 5)


@query("WITH RECURSIVE seq AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM seq WHERE n < 20) SELECT n, n_name FROM seq JOIN nation ON n_nationkey = n")
def cte_recursive_seq(c):
    return q(c, "nation").with_recursive_cte("seq", "SELECT 1 AS n", "SELECT n + 1 FROM seq WHERE n < 20").from_raw("seq JOIN nation ON n_nationkey = n").select("n", "n_name")


@query("WITH RECURSIVE seq AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM seq WHERE n < 150) SELECT n FROM seq")
def cte_recursive_150(c):
    return q(c, "nation").with_recursive_cte("seq", "SELECT 1 AS n", "SELECT n + 1 FROM seq WHERE n < 150", levels=200).from_raw("seq")


# --- full text --------------------------------------------------------------------------------------

_WORDS = r"regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+')"


@query(f"SELECT doc_id FROM documents WHERE list_contains({_WORDS}, 'license') OR list_contains({_WORDS}, 'token')")
def fulltext_natural(c):
    return q(c, "documents").where(fulltext.natural("License token", "text")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_contains({_WORDS}, 'licensed') AND NOT list_contains({_WORDS}, 'apache') AND contains(' ' || array_to_string({_WORDS}, ' ') || ' ', ' under cc by ') AND len(list_filter({_WORDS}, lambda w: starts_with(w, 'licens'))) > 0")
def fulltext_boolean(c):
    return q(c, "documents").where(fulltext.boolean('+licensed -apache +"under CC BY" +licens*', "text")).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE list_contains({_WORDS}, 'licence') OR list_contains({_WORDS}, 'license') OR list_contains({_WORDS}, 'licensed')")
def fulltext_expanded(c):
    return q(c, "documents").where(fulltext.expanded("licence", "text", related={"licence": ["license", "licensed"]})).select("doc_id")


# --- mutations ----------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY s_suppkey), s_name, s_acctbal FROM supplier WHERE s_acctbal > 0")
def create_many(c):
    base = c.frame("customer").select("c_custkey", "c_name", "c_acctbal")
    entity = Entity("customer", (Property("c_custkey", "bigint", primary_key=True, auto_increment=True), Property("c_name", "string"), Property("c_acctbal", "double")))
    new = c.frame("supplier").where("s_acctbal > 0").select("s_suppkey", F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return mutate.create(entity, base, new.orderBy("s_suppkey").drop("s_suppkey"), order=["c_name"]).after


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'DEBTOR' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_field(c):
    return Repository(c, "customer").update_field(F.col("c_acctbal") < 0, "c_mktsegment", "DEBTOR").after.select("c_custkey", "c_mktsegment")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE p_retailprice END AS p_retailprice, CASE WHEN p_size > 25 THEN CAST(floor(p_size + p_retailprice) AS INTEGER) ELSE p_size END AS p_size, CASE WHEN p_size > 25 THEN upper(p_name) || '!' ELSE p_name END AS p_name FROM part")
def batch_update_exprs(c):
    # the new size sees the old price
    size = F.floor(F.col("p_size") + F.col("p_retailprice")).cast("int")
    return Repository(c, "part").batch_update(F.col("p_size") > 25, p_retailprice=F.col("p_retailprice") * 2, p_size=size, p_name=F.concat(F.upper("p_name"), F.lit("!"))).after.select("p_partkey", "p_retailprice", "p_size", "p_name")


_VERSIONED = "SELECT c_custkey, c_name, c_acctbal, CAST(1 + c_custkey % 3 AS INTEGER) AS version FROM customer"


def _versioned(c) -> DataFrame:
    return c.frame("customer").select("c_custkey", "c_name", "c_acctbal", (1 + F.col("c_custkey") % 3).cast("int").alias("version"))


def _offline(c) -> DataFrame:
    """What a client sends that read every tenth row when its version was 1."""
    return _versioned(c).where("c_custkey % 10 = 0").select("c_custkey", F.concat("c_name", F.lit("*")).alias("c_name"), "c_acctbal", F.lit(1).alias("version"))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN upper(c_mktsegment) || c_acctbal::INTEGER ELSE c_mktsegment END AS c_mktsegment FROM customer")
def update_many(c):
    values = lambda t: {"c_acctbal": t.c_acctbal + 10, "c_mktsegment": F.concat(F.upper(t.c_mktsegment), F.rint(t.c_acctbal).cast("int").cast("string"))}
    return Repository(c, "customer").update_many(F.col("c_nationkey") == 3, values).after.select("c_custkey", "c_acctbal", "c_mktsegment")


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'none'")
def seed_and_initialize(c):
    """An empty table is made and filled once; one that has rows is left as it is."""
    s = Session(c)
    kept = Repository(c, "region", s)
    assert not kept.initialize() and kept.seed(kept.table) is None
    fresh = Repository(c, Entity("fresh", (Property("r_regionkey", "int", primary_key=True), Property("r_name", "string"))), s)
    assert fresh.initialize()
    fresh.seed(kept.table.select("r_regionkey", "r_name").union(c.spark.createDataFrame([(99, "none")], "r_regionkey int, r_name string")))
    assert fresh.seed(kept.table) is None
    return fresh.table


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'in, debt (where = due)' ELSE c_mktsegment END AS c_mktsegment, c_acctbal * CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END AS c_acctbal, CAST((SELECT count(*) FROM customer WHERE c_acctbal < 0) AS BIGINT) AS updated, CAST((SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)) AS BIGINT) AS deleted, CAST(1 AS BIGINT) AS inserted FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) UNION ALL SELECT 0, 'NEW', 1.5, CAST((SELECT count(*) FROM customer WHERE c_acctbal < 0) AS BIGINT), CAST((SELECT count(*) FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)) AS BIGINT), CAST(1 AS BIGINT)")
def execute_sql(c):
    """Three statements, each with the number of rows it touched."""
    r = Repository(c, "customer")
    updated = r.execute_sql("UPDATE customer SET c_mktsegment = 'in, debt (where = due)', c_acctbal = c_acctbal * 2 WHERE c_acctbal < 0")
    deleted = r.execute_sql("DELETE FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
    inserted = r.execute_sql("INSERT INTO customer (c_custkey, c_mktsegment, c_acctbal) SELECT 0, :segment, 1.5", {"segment": "NEW"})
    n = {k: F.lit(v).cast("bigint").alias(k) for k, v in (("updated", updated), ("deleted", deleted), ("inserted", inserted))}
    return r.table.select("c_custkey", "c_mktsegment", "c_acctbal", *n.values())


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' ORDER BY o_totalprice, o_orderkey LIMIT 200)")
def delete_query(c):
    found = q(c, "orders").include("customer").where(F.col("customer.c_mktsegment") == "BUILDING").order_by("o_totalprice", "o_orderkey").take(200)
    return Repository(c, "orders").delete_query(found).after.select("o_orderkey")


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 AND version = 1 THEN c_name || '*' ELSE c_name END AS c_name, CAST(CASE WHEN c_custkey % 10 = 0 AND version = 1 THEN 2 ELSE version END AS INTEGER) AS version FROM ({_VERSIONED})")
def update_versioned(c):
    return mutate.update_versioned(c.entity("versioned_customer"), _versioned(c), _offline(c)).after.select("c_custkey", "c_name", "version")


@query(f"SELECT c_custkey FROM ({_VERSIONED}) WHERE c_custkey % 10 = 0 AND version <> 1")
def update_conflicts(c):
    return mutate.update_versioned(c.entity("versioned_customer"), _versioned(c), _offline(c)).conflicts.select(F.col("c_c_custkey").alias("c_custkey"))


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name || '*' ELSE c_name END AS c_name, c_acctbal + CASE WHEN version > 1 THEN 5 ELSE 0 END AS c_acctbal, CAST(CASE WHEN c_custkey % 10 = 0 THEN version + 1 ELSE version END AS INTEGER) AS version FROM ({_VERSIONED})")
def merge_three_way(c):
    # others have changed the balance of the rows that are beyond version 1; this client the names
    now = _versioned(c).withColumn("c_acctbal", F.when(F.col("version") > 1, F.col("c_acctbal") + 5).otherwise(F.col("c_acctbal")))
    read = _versioned(c).where("c_custkey % 10 = 0").withColumn("version", F.lit(1))
    return mutate.update_versioned(c.entity("versioned_customer"), now, _offline(c), resolver=mutate.merge_changes(), original=read).after


_NEW = "SELECT c_custkey + CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 1000000 END AS c_custkey, 'copy ' || c_name AS c_name, c_acctbal FROM customer WHERE c_custkey % 5 = 0"


@query(f"SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM ({_NEW})) UNION ALL SELECT * FROM ({_NEW})")
def upsert_many(c):
    base = c.frame("customer").select("c_custkey", "c_name", "c_acctbal")
    new = base.where("c_custkey % 5 = 0").select((F.col("c_custkey") + F.when(F.col("c_custkey") % 2 == 0, 0).otherwise(1000000)).alias("c_custkey"), F.concat(F.lit("copy "), "c_name").alias("c_name"), "c_acctbal")
    # every row arrives twice; the later one counts
    twice = new.withColumn("c_name", F.lit("early")).withColumn("at", F.lit(1)).union(new.withColumn("at", F.lit(2)))
    return mutate.upsert(c.entity("customer"), base, twice, arrival="at").after


@query("SELECT o_orderkey FROM orders WHERE coalesce(nullif(o_orderpriority, '5-LOW') <> '1-URGENT', true) = false OR nullif(o_orderpriority, '5-LOW') IS NULL")
def delete_many_null_safe(c):
    return mutate.delete(c.frame("orders"), F.nullif("o_orderpriority", F.lit("5-LOW")) != "1-URGENT").after.select("o_orderkey")


@query("SELECT c_custkey, 'c_mktsegment' AS column_name, c_mktsegment AS old_value, 'DEBTOR' AS new_value FROM customer WHERE c_acctbal < 0")
def change_diff(c):
    before = c.frame("customer").select("c_custkey", "c_name", "c_mktsegment")
    after = Repository(c, "customer").update_field(F.col("c_acctbal") < 0, "c_mktsegment", "DEBTOR").after
    return mutate.changes(before, after, "c_custkey")


@query("SELECT count(*) AS n FROM customer WHERE c_acctbal >= 0 OR c_acctbal IS NULL")
def session_rollback(c):
    s = Session(c)
    r = Repository(c, "customer", s)
    r.delete_many(F.col("c_acctbal") < 0)
    s.savepoint("kept")
    r.delete_all()
    s.rollback_to("kept")
    return r.table.agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n FROM customer WHERE c_custkey > 10")
def ambient_scope(c):
    """Of two nested scopes, the inner one is not completed."""
    with scope(c) as outer:
        r = Repository(c, "customer", current())
        r.delete_many(F.col("c_custkey") <= 10)
        with scope():
            r.delete_all()
        outer.complete()
    return r.table.agg(F.count("*").alias("n"))


@query("SELECT true AS has_where, true AS has_plan, count(*) AS n FROM customer WHERE c_acctbal < 0")
def capture_query(c):
    found = Capture().run(q(c, "customer").where(F.col("c_acctbal") < 0))
    return found.df.agg(F.lit("WHERE" in found.query).alias("has_where"), F.lit("Physical Plan" in found.plan).alias("has_plan"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_violations(c):
    entity = c.entity("lineitem")
    return entity.violations(c.frame("lineitem"), entity.indexes[0])


@query("SELECT CAST(8 AS BIGINT) AS tables, CAST(0 AS BIGINT) AS errors, CAST(0 AS BIGINT) AS warnings")
def validate_schema(c):
    """The tables with a key, against their entities."""
    found = [x.validate(c.frame(x.source)) for x in ENTITIES if x.name not in ("versioned_customer", "lineitem")]
    return c.spark.createDataFrame([(len(found), sum(len(a) for a, _ in found), sum(len(b) for _, b in found))], "tables bigint, errors bigint, warnings bigint")
