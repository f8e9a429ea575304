"""Quality of answers against the truth: recall, error ratio, graph recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def recall(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): found among the k true items, divided by k. Queries without any found have 0."""
    hit = truth.select("query_id", "item_id").join(result.select("query_id", "item_id").distinct(), ["query_id", "item_id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return truth.select("query_id").distinct().join(hit, "query_id", "left").select("query_id", (F.coalesce("n", F.lit(0)) / F.lit(float(k))).alias("recall"))


def error_ratio(result: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, error): mean over ranks of the returned distance divided by the true one of that rank; ranks with a true distance of 0 are left out."""
    w = Window.partitionBy("query_id").orderBy("dist", "item_id")
    ranked = result.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("dist").alias("d"))
    own = truth.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", F.col("dist").alias("t"))
    return ranked.join(own, ["query_id", "rank"]).where("t > 0").groupBy("query_id").agg(F.avg(F.col("d") / F.col("t")).alias("error"))


def graph_recall(graph: DataFrame, truth: DataFrame) -> DataFrame:
    """(src, recall): size of found and true neighbours' intersection over the smaller of both sizes."""
    hit = graph.select("src", "dst").distinct().join(truth.select("src", "dst").distinct(), ["src", "dst"]).groupBy("src").agg(F.count(F.lit(1)).alias("hit"))
    size = lambda df, name: df.groupBy("src").agg(F.countDistinct("dst").alias(name))
    return size(truth, "t").join(size(graph, "f"), "src").join(hit, "src", "left").select("src", (F.coalesce("hit", F.lit(0)) / F.least("t", "f")).alias("recall"))
