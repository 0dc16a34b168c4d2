"""Networks over the driver's tables, by arithmetic alone, as DataFrames and as SQL.

reach: a lineitem is a reach. chain: an order is a network, its reaches in a row down to OUT.
tree: orders run to customers, nations, regions and OUT. loose: chains as their line numbers
name them, which repeats ids and leaves gaps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from culvert.schema import CATALOG_IN


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ordered():
    return W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def reach_columns() -> dict[str, Column]:
    sizes = F.array(*[F.lit(float(d)) for d in CATALOG_IN])
    d = lambda c: F.col(c).cast("double")
    return {
        "network_id": F.col("l_orderkey"),
        "area_ac": d("l_quantity") / 25.0,
        "c": 0.30 + 5.0 * d("l_discount"),
        "slope": 0.002 + d("l_tax") / 8.0,
        "length": 100.0 + 20.0 * (F.col("l_partkey") % 20),
        "diameter": F.get(sizes, (F.col("l_suppkey") % 17).cast("int")) / 12.0,
        "n": F.lit(0.013),
        "tc_inlet": 5.0 + F.col("l_linenumber"),
    }


def reach(spark: SparkSession, sf_dir: str, ordered: bool = True) -> DataFrame:
    """network_id, [ord], area_ac, c, slope, length, diameter, n, tc_inlet. Without ord no shuffle is needed."""
    items = table(spark, sf_dir, "lineitem")
    cols = [v.alias(k) for k, v in reach_columns().items()]
    return items.select(F.row_number().over(_ordered()).alias("ord"), *cols) if ordered else items.select(*cols)


REACH = """
    SELECT l_orderkey AS network_id,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
           CAST(l_quantity AS DOUBLE) / 25.0::DOUBLE AS area_ac,
           0.30::DOUBLE + 5.0::DOUBLE * CAST(l_discount AS DOUBLE) AS c,
           0.002::DOUBLE + CAST(l_tax AS DOUBLE) / 8.0::DOUBLE AS slope,
           100.0::DOUBLE + 20.0::DOUBLE * (l_partkey % 20) AS length,
           [8, 10, 12, 15, 18, 21, 24, 27, 30, 33, 36, 42, 48, 54, 60, 66, 72][1 + l_suppkey % 17] / 12.0::DOUBLE AS diameter,
           0.013::DOUBLE AS n, 5.0::DOUBLE + l_linenumber AS tc_inlet
    FROM lineitem
"""


def chain(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, pipes): node k flows to k + 1, the last one to OUT at invert 100."""
    return _chained(reach(spark, sf_dir))


def street(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """chain() of customers: a customer's orders are the reaches of a network."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    sizes = F.array(*[F.lit(float(d)) for d in CATALOG_IN])
    cols = {
        "network_id": F.col("o_custkey").cast("bigint"), "ord": F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")), "area_ac": F.floor(F.col("o_totalprice").cast("double") / 1000.0) / 100.0,
        "c": 0.30 + 0.05 * (key % 8), "slope": 0.002 + 0.001 * (key % 10), "length": 100.0 + 20.0 * (key % 20), "diameter": F.get(sizes, (key % 17).cast("int")) / 12.0, "n": F.lit(0.013), "tc_inlet": 5.0 + key % 7,
    }
    return _chained(o.select(*[v.alias(k) for k, v in cols.items()]))


STREET = """
    SELECT CAST(o_custkey AS BIGINT) AS network_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS ord, floor(CAST(o_totalprice AS DOUBLE) / 1000.0::DOUBLE) / 100.0::DOUBLE AS area_ac,
           0.30::DOUBLE + 0.05::DOUBLE * (o_orderkey % 8) AS c, 0.002::DOUBLE + 0.001::DOUBLE * (o_orderkey % 10) AS slope, 100.0::DOUBLE + 20.0::DOUBLE * (o_orderkey % 20) AS length,
           [8, 10, 12, 15, 18, 21, 24, 27, 30, 33, 36, 42, 48, 54, 60, 66, 72][1 + o_orderkey % 17] / 12.0::DOUBLE AS diameter, 0.013::DOUBLE AS n, 5.0::DOUBLE + o_orderkey % 7 AS tc_inlet
    FROM orders
"""


def _chained(r: DataFrame) -> tuple[DataFrame, DataFrame]:
    below = W.partitionBy("network_id").orderBy(F.desc("ord")).rowsBetween(W.unboundedPreceding, 0)
    along = W.partitionBy("network_id").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    last = F.max("ord").over(W.partitionBy("network_id"))
    r = r.withColumns({"invert": 100.0 + F.sum(F.col("slope") * F.col("length")).over(below), "x": F.coalesce(F.sum("length").over(along), F.lit(0.0)), "last": last})
    node = lambda **k: [v.alias(name) for name, v in k.items()]
    inner = r.select("network_id", "ord", *node(id=F.col("ord").cast("string"), kind=F.lit("inlet")), "invert", (F.col("invert") + 8.0).alias("rim"), "area_ac", "c", "tc_inlet", "x", F.lit(0.0).alias("y"))
    end = r.filter("ord = last").select(
        "network_id", (F.col("ord") + 1).alias("ord"), *node(id=F.lit("OUT"), kind=F.lit("outfall"), invert=F.lit(100.0), rim=F.lit(108.0), area_ac=F.lit(0.0), c=F.lit(0.0), tc_inlet=F.lit(0.0)),
        (F.col("x") + F.col("length")).alias("x"), F.lit(0.0).alias("y"),
    )
    to = F.when(F.col("ord") == F.col("last"), "OUT").otherwise((F.col("ord") + 1).cast("string"))
    pipes = r.select("network_id", "ord", F.concat(F.lit("P"), F.col("ord").cast("string")).alias("id"), F.col("ord").cast("string").alias("from"), to.alias("to"), "length", "diameter", "n")
    return inner.unionByName(end), pipes


def tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, pipes) of one network with confluences, four levels deep."""
    orders, customer, nation, region = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    zero = F.lit(0.0)
    node = lambda df, p, c, area, k: df.select(F.lit(1).cast("bigint").alias("network_id"), F.col(c).cast("bigint").alias("ord"), key(p, c).alias("id"), F.lit("inlet").alias("kind"), area.alias("area_ac"), k.alias("c"))
    ca = 0.02 * F.col("o_totalprice").cast("double") / 500_000.0
    nodes = (
        node(orders, "o", "o_orderkey", ca, 0.5 + 0.05 * (F.col("o_orderkey") % 8))
        .unionByName(node(customer, "c", "c_custkey", zero, zero))
        .unionByName(node(nation, "n", "n_nationkey", zero, zero))
        .unionByName(node(region, "r", "r_regionkey", zero, zero))
        .unionByName(orders.sparkSession.range(1).select(F.lit(1).cast("bigint").alias("network_id"), F.lit(0).cast("bigint").alias("ord"), F.lit("OUT").alias("id"), F.lit("outfall").alias("kind"), zero.alias("area_ac"), zero.alias("c")))
    )
    pipe = lambda df, p, a, q, b: df.select(F.lit(1).cast("bigint").alias("network_id"), key(p, a).alias("id"), key(p, a).alias("from"), key(q, b).alias("to"))
    pipes = (
        pipe(orders, "o", "o_orderkey", "c", "o_custkey")
        .unionByName(pipe(customer, "c", "c_custkey", "n", "c_nationkey"))
        .unionByName(pipe(nation, "n", "n_nationkey", "r", "n_regionkey"))
        .unionByName(region.select(F.lit(1).cast("bigint").alias("network_id"), key("r", "r_regionkey").alias("id"), key("r", "r_regionkey").alias("from"), F.lit("OUT").alias("to")))
    )
    return nodes, pipes


def trunk(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, pipes) of one network: all orders in a row, by their keys, down to OUT."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor(F.col("o_totalprice").cast("double") / 1000.0) / 100.0).alias("area_ac"))
    # Numbers by prefix sums over ranges of keys: a window without a partition would be one task.
    parts = o.repartitionByRange("o_orderkey").withColumn("part", F.spark_partition_id())
    from culvert.operators.graph import kept

    parts = kept(parts)
    own = F.row_number().over(W.partitionBy("part").orderBy("o_orderkey"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = parts.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", before)  # a row a partition
    k = parts.withColumn("own", own).join(counts, "part").select((F.col("own") + F.col("before")).alias("k"), "area_ac")
    n = k.count()
    one, kind, text = F.lit(1).cast("bigint").alias("network_id"), F.lit("inlet").alias("kind"), F.col("k").cast("string")
    nodes = k.select(one, F.col("k").cast("bigint").alias("ord"), text.alias("id"), kind, "area_ac", F.lit(0.5).alias("c"))
    end = o.sparkSession.range(1).select(one, F.lit(n + 1).cast("bigint").alias("ord"), F.lit("OUT").alias("id"), F.lit("outfall").alias("kind"), F.lit(0.0).alias("area_ac"), F.lit(0.0).alias("c"))
    to = F.when(F.col("k") == n, "OUT").otherwise((F.col("k") + 1).cast("string"))
    return nodes.unionByName(end), k.select(one, F.concat(F.lit("P"), text).alias("id"), text.alias("from"), to.alias("to"))


def loose(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, pipes) of orders whose reaches go by line number: repeated ids, gaps and no outfall."""
    r = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("network_id"), F.row_number().over(_ordered()).alias("ord"), "l_linenumber", (F.col("l_quantity").cast("double") - 1.0).alias("area_ac"))
    nodes = r.select("network_id", "ord", F.col("l_linenumber").cast("string").alias("id"), F.lit("inlet").alias("kind"), "area_ac")
    pipes = r.select("network_id", "ord", F.concat(F.lit("P"), F.col("ord").cast("string")).alias("id"), F.col("l_linenumber").cast("string").alias("from"), (F.col("l_linenumber") + 1).cast("string").alias("to"))
    return nodes, pipes


LOOSE = """
    SELECT l_orderkey AS network_id,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord,
           l_linenumber AS line, CAST(l_quantity AS DOUBLE) - 1.0::DOUBLE AS area_ac
    FROM lineitem
"""
