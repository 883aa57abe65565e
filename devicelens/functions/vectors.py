"""Vector helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column) -> Column:
    """Scale to unit length; an all-zero vector stays as it is."""
    length = norm(a)
    return F.when(
        length > 0, F.transform(a, lambda x: x.cast("double") / length)
    ).otherwise(F.transform(a, lambda x: x.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b))


def hashed_vectors(df: DataFrame, text: str, dim: int, out: str = "embedding") -> DataFrame:
    """Default text vector: hashed word counts of length ``dim``, scaled to unit length."""
    from pyspark.ml.feature import HashingTF
    from pyspark.ml.functions import vector_to_array

    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    counted = HashingTF(numFeatures=dim, inputCol="_words", outputCol="_tf").transform(
        df.withColumn("_words", words)
    )
    return counted.withColumn(out, normalise(vector_to_array("_tf"))).drop("_words", "_tf")
