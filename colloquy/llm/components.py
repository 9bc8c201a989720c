"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession, functions as F


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked with the least of it and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked with the least of these."""
    least = _least(links)
    rest = links.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files and checkpoints of tables that nothing refers to any more:
    it does so when the driver's garbage is collected, which a small driver heap seldom needs."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the least node that ``links`` (a, b) reach, for every node with a link
    to another one.  The links stay distributed; each round is checkpointed and the one before it
    released, and rounds end when the links no longer change, after about log(nodes) of them."""
    x, y = F.col(a), F.col(b)
    now = links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct().checkpoint()
    mark = None
    while True:
        now = _small_star(_large_star(now)).checkpoint()
        release(links.sparkSession)
        r = now.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))).alias("h")).first()
        if (r["n"], r["h"]) == mark:
            rest = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return rest.unionByName(rest.select(F.col("component").alias("node"), "component").distinct())
        mark = (r["n"], r["h"])
