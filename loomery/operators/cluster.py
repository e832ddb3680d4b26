"""Clusterings of a similarity graph: least parents, and connected components. A cluster's id is its smallest node."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder and all its work is done on this machine, as in tests.
FALLBACK_SHARED_DIR = "/tmp/checkpoints"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that the driver and all executors share: spark.checkpoint.dir, which only a local session may leave unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(folder or FALLBACK_SHARED_DIR).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by a table in the shared folder: a lost executor loses nothing, and plans stay short."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pointer_doubling(parents: DataFrame) -> DataFrame:
    """node, cluster_id: follow parents (node, parent; every parent is a node) to the roots, doubling the way each round."""
    current = written(parents.select("node", "parent"), "parents")
    while True:
        above = current.select(F.col("node").alias("parent"), F.col("parent").alias("above"))
        stepped = current.join(above, "parent", "left").select("node", "parent", F.coalesce("above", "parent").alias("next"))
        stepped = written(stepped, "parents")
        moved = stepped.where("next <> parent").limit(1).count()
        current = stepped.select("node", F.col("next").alias("parent"))
        if not moved:
            return current.withColumnRenamed("parent", "cluster_id")


def least_parent_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Each node takes the smallest of itself and its smaller neighbours for a parent; clusters are the trees. Not transitive on purpose."""
    a, b = F.least("a", "b"), F.greatest("a", "b")
    ups = edges.select(b.alias("node"), a.alias("parent")).unionByName(nodes.select("node", F.col("node").alias("parent")))
    return pointer_doubling(ups.groupBy("node").agg(F.min("parent").alias("parent")))


def component_clusters(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Connected components: least labels of neighbours, with a jump to the label's label each round."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    both = written(both.where("node <> other").distinct(), "graph")
    labels = written(nodes.select("node").distinct().withColumn("label", F.col("node")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        stepped = written(labels.join(near, "node", "left").select("node", F.col("label").alias("before"), F.least("label", "near").alias("label")), "labels")
        beyond = stepped.select(F.col("node").alias("label"), F.col("label").alias("beyond"))
        jumped = written(stepped.join(beyond, "label", "left").select("node", "before", F.least("label", "beyond").alias("label")), "labels")
        changed = jumped.where("label <> before").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            return labels.withColumnRenamed("label", "cluster_id")
