"""Mean vectors of keys, and the key whose mean is most like a vector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackweave.operators.aggregates import mean_embedding
from trackweave.operators.nearest import nearest


def mean_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, vector: the mean of a key's vectors at length 1. Keys whose mean is zero have none."""
    parts = mean_embedding(df, [key], vector).groupBy(key)
    return parts.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("vector"))


def nearest_vector(df: DataFrame, id: str, vector: str, means: DataFrame, key: str) -> DataFrame:
    """id, key, similarity, margin: the mean most like each vector by cosine, and its lead over the next (over 0 with one mean).

    means: key, vector; any number of them. Equal similarities go to the smaller
    key, so zero vectors, as like to every mean as to the next, go to the
    smallest with 0 and 0; see nearest for vectors that aren't compared.
    """
    near = nearest(df.select(id, F.col(vector).alias("vector")), means, id=id, vector="vector", train_id=key, k=2)
    best = near.groupBy(id).agg(*[F.max(F.when(F.col("place") == p, F.struct("near", "similarity"))).alias(f"p{p}") for p in (1, 2)])
    zero = df.where((F.size(vector) > 0) & F.forall(vector, lambda x: F.coalesce(x == 0, F.lit(False)))).select(id).join(F.broadcast(means.agg(F.min(key).alias(key))).where(F.col(key).isNotNull()))
    found = best.select(id, F.col("p1.near").alias(key), "p1.similarity", (F.col("p1.similarity") - F.coalesce("p2.similarity", F.lit(0.0))).alias("margin"))
    return found.unionByName(zero.select(id, key, F.lit(0.0).alias("similarity"), F.lit(0.0).alias("margin")))
