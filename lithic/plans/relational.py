"""The general relational surface over the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lithic.catalog import register
from lithic.sources.tables import table


def _sql(name: str, oracle: str, spark_sql: str, tables: str) -> None:
    """Register a query that is SQL on both sides; Catalyst plans it."""

    @register(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(spark_sql, **{t: table(spark, sf_dir, t) for t in tables.split()})

    run.__name__ = name


def _same(name: str, sql: str, tables: str) -> None:
    import re

    _sql(name, sql, re.sub(rf"\b(FROM|JOIN)\s+({'|'.join(tables.split())})\b", r"\1 {\2}", sql), tables)


@register("rel_pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
 round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def rel_pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_shipdate <= timestamp_ntz'1998-09-02'")
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("sum_disc_price"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 4).alias("avg_disc"), F.count("*").alias("n"),
    )


@register("rel_star_join", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'ASIA' GROUP BY 1""")
def rel_star_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").join(t("region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    buyers = t("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    lines = t("lineitem").join(t("orders").join(buyers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


_same("rel_join_left", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", "customer orders")
_same("rel_join_right", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM orders RIGHT JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey", "customer orders")
# customers and suppliers of a nation are counted apart: beside each other they would be every pair of them
_sql(
    "rel_join_full",
    "SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT s_suppkey) AS suppliers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey FULL JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name",
    """WITH c AS (SELECT n_name, count(DISTINCT c_custkey) AS customers FROM {nation} LEFT JOIN {customer} ON c_nationkey = n_nationkey GROUP BY n_name),
    s AS (SELECT n_name, count(DISTINCT s_suppkey) AS suppliers FROM {nation} RIGHT JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY n_name)
    SELECT coalesce(c.n_name, s.n_name) AS n_name, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM c FULL JOIN s ON c.n_name <=> s.n_name""",
    "nation customer supplier",
)
_same("rel_join_semi", "SELECT count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)", "orders lineitem")
_same("rel_join_anti", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY o_orderpriority", "orders lineitem")
_same("rel_join_theta", "SELECT a.n_name AS n_name, count(*) AS lower_names FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND b.n_name < a.n_name GROUP BY a.n_name", "nation")
_same("rel_grouping_sets", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())", "lineitem")
_same("rel_rollup", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)", "orders")
_same("rel_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)", "orders")
_same("rel_having", "SELECT l_suppkey, count(*) AS n FROM lineitem GROUP BY l_suppkey HAVING count(*) > 100", "lineitem")
_same("rel_distinct_agg", "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag", "lineitem")
_same("rel_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey AS k FROM supplier", "customer supplier")
_same("rel_intersect", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.08", "lineitem")
_same("rel_except", "SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 45 EXCEPT SELECT l_partkey AS k FROM lineitem WHERE l_discount > 0.08", "lineitem")
_same("rel_case", "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_class, count(*) AS n FROM part GROUP BY 1", "part")
_same("rel_subquery", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > (SELECT avg(l_quantity) FROM lineitem)", "lineitem")
_same("rel_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "orders")
_same("rel_offset", "SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 40", "customer")


@register("rel_windows", """SELECT o_orderkey, CAST(row_number() OVER w AS INTEGER) AS place, lag(o_orderkey) OVER w AS previous, CAST(ntile(4) OVER w AS INTEGER) AS quarter, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS INTEGER) AS priority_rank FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def rel_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.row_number().over(w).alias("place"), F.lag("o_orderkey").over(w).alias("previous"), F.ntile(4).over(w).alias("quarter"), F.rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("priority_rank"))


@register("rel_running_total", "SELECT l_orderkey, l_linenumber, round(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber), 2) AS running FROM lineitem")
def rel_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.sum("l_quantity").over(w), 2).alias("running"))


@register("rel_top_per_group", "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 3")
def rel_top_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_suppkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("place", F.row_number().over(w)).where("place <= 3").select("l_suppkey", "l_orderkey", "l_linenumber")


@register("rel_pivot", "SELECT l_returnflag, count(*) FILTER (WHERE l_linestatus = 'F') AS f, count(*) FILTER (WHERE l_linestatus = 'O') AS o FROM lineitem GROUP BY l_returnflag")
def rel_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).count()
    return rows.select("l_returnflag", F.coalesce("F", F.lit(0)).cast("long").alias("f"), F.coalesce("O", F.lit(0)).cast("long").alias("o"))
