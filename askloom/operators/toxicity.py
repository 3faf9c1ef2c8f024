"""Toxicity scores from a linear model trained on labelled texts."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from askloom.functions.text import words
from askloom.operators.guard_input import REASON_TOXIC, TOXICITY_THRESHOLD, is_toxic


def _with_words(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_words", words(text))


def train_toxicity(labelled: DataFrame, text: str = "text", label: str = "toxic",
                   features: int = 1 << 16, iterations: int = 25) -> PipelineModel:
    """Logistic regression over weighted word counts; both labels weigh the same in total."""
    share = labelled.agg(F.avg(F.col(label).cast("double")).alias("p"))
    weighted = _with_words(labelled, text).withColumn("_p", share.scalar()).withColumn(
        "_label", F.col(label).cast("double")).withColumn(
        "_weight", F.when(F.col(label) == 1, 0.5 / F.col("_p")).otherwise(0.5 / (1 - F.col("_p"))))
    stages = [
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", labelCol="_label", weightCol="_weight",
                           maxIter=iterations, regParam=0.01),
    ]
    return Pipeline(stages=stages).fit(weighted.select("_words", "_label", "_weight"))


def score_toxicity(df: DataFrame, model: PipelineModel, text: str = "text",
                   threshold: float = TOXICITY_THRESHOLD) -> DataFrame:
    """Adds ``toxic_score``, ``is_toxic`` and ``toxic_reason``."""
    out = model.transform(_with_words(df, text))
    predicted = F.col("prediction") == 1.0
    return out.withColumn("toxic_score", vector_to_array("probability")[1]).select(
        *df.columns, "toxic_score",
        is_toxic("toxic_score", predicted, threshold).alias("is_toxic"),
        F.when(is_toxic("toxic_score", predicted, threshold),
               F.format_string(REASON_TOXIC, F.col("toxic_score"))).otherwise("").alias("toxic_reason"))
