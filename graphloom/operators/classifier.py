"""How well a classifier tells two sides of a collection apart: a lower bound of their Jensen-Shannon distance."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.sources.staging import staged

FOLDS = 4
#: Probabilities are kept this far from 0 and 1, so one wrong row can't outweigh all others.
CLIP = 1e-6
#: What is given back where a side has no rows.
FAILED = -1.0


def discrepancy(vectors: DataFrame, folds: int = FOLDS, sides: tuple[str, str] = ("gen", "ref"), strength: float = 1e-4) -> float:
    """vectors: side, key, v (array of double of one length). The bound in 0 to 1, or FAILED.

    Rows are dealt to folds by key, and counted by side, vector and fold, so equal vectors are one row from there on. Each side
    weighs a half whatever its number of rows. A logistic model on v and its squares, fitted without a fold, tells the probability D
    of the first side for the fold's rows; 1 + mean log2 D over the first side / 2 + mean log2 (1 - D) over the second / 2 bounds
    the divergence from below, its root the distance; less than 0 is 0."""
    first, second = sides
    fold = F.pmod(F.xxhash64("key"), F.lit(folds)).cast("int").alias("fold")
    counted = staged(vectors.where(F.col("side").isin(*sides)).select("side", fold, F.col("v").cast("array<double>").alias("v")).groupBy("side", "fold", "v").agg(F.count("*").cast("double").alias("n")), "descriptors")
    size = {r["side"]: r["n"] for r in counted.groupBy("side").agg(F.sum("n").alias("n")).collect()}
    if len(size) < 2:
        return FAILED
    known = counted.groupBy("side", "fold").count().count()
    if known < 2 * folds:  # too few rows to leave a fold out on both sides
        folds = 1
    label = F.when(F.col("side") == first, 1.0).otherwise(0.0)
    weight = F.col("n") * F.when(F.col("side") == first, 0.5 / size[first]).otherwise(0.5 / size[second]) * sum(size.values())
    ready = counted.select("fold", label.alias("label"), weight.alias("weight"), array_to_vector(F.concat("v", F.transform("v", lambda x: x * x))).alias("features"))
    model = LogisticRegression(featuresCol="features", labelCol="label", weightCol="weight", maxIter=100, regParam=strength, standardization=True)
    gain = 0.0
    for k in range(folds):
        train = ready.where(F.col("fold") != k) if folds > 1 else ready
        test = ready.where(F.col("fold") == k) if folds > 1 else ready
        told = vector_to_array(F.col("probability"))[1]
        p = F.least(F.greatest(told, F.lit(CLIP)), F.lit(1 - CLIP))
        gain += model.fit(train).transform(test).agg(F.coalesce(F.sum(F.col("weight") * F.log2(F.when(F.col("label") == 1, p).otherwise(1 - p))), F.lit(0.0))).first()[0]
    bound = 1 + gain / sum(size.values())
    return max(0.0, min(1.0, bound)) ** 0.5


def graph_discrepancy(families: dict[str, DataFrame], **more) -> dict[str, float]:
    """The bound of each family of descriptors, and the largest of them as `pgd`: every one bounds the same distance."""
    out = {name: discrepancy(df, **more) for name, df in families.items()}
    return {**out, "pgd": max(out.values())}
