"""Scoring of packed images and learning of scorers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dataset import accuracy

Scorer = Callable[[np.ndarray], np.ndarray]


def score(instances: DataFrame, scorer: Scorer, column: str = "image") -> DataFrame:
    """``score`` by any callable from a batch of images (N x length) to N numbers, batch by batch."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield frame.assign(score=np.asarray(scorer(np.stack(frame[column].to_numpy()).astype(np.float32)), float))

    names = ", ".join(f"`{n}` {t}" for n, t in instances.dtypes if n != "score")
    return instances.drop("score").mapInPandas(run, f"{names}, score double")


def linear_score(instances: DataFrame, weights: list[float], column: str = "image") -> DataFrame:
    """``score`` as the dot product with fixed weights, in expressions."""
    w = F.array(*[F.lit(float(x)) for x in weights])
    return instances.withColumn("score", F.aggregate(F.zip_with(F.col(column), w, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x))


def convolve(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Valid cross-correlation of N x C x H x W with K x C x h x w."""
    windows = np.lib.stride_tricks.sliding_window_view(x, w.shape[2:], axis=(2, 3))
    return np.einsum("nchwij,kcij->nkhw", windows, w, optimize=True) + b[None, :, None, None]


def pool2(x: np.ndarray) -> np.ndarray:
    n, c, h, w = x.shape
    return x[:, :, : h // 2 * 2, : w // 2 * 2].reshape(n, c, h // 2, 2, w // 2, 2).max(axis=(3, 5))


def lenet(weights: dict[str, np.ndarray], size: int, channels: int, relu_conv: bool = False) -> Scorer:
    """Two convolutions with pooling, a hidden layer and two logits; the score is their difference.

    weights: w1 b1 w2 b2 (convolutions) w3 b3 w4 b4 (dense, inputs first). Images are rows x columns x channels.
    """

    def run(images: np.ndarray) -> np.ndarray:
        x = images.reshape(len(images), size, size, channels).transpose(0, 3, 1, 2) / 256
        for k in (1, 2):
            x = pool2(convolve(x, weights[f"w{k}"], weights[f"b{k}"]))
            x = np.maximum(x, 0) if relu_conv else x
        hidden = np.maximum(x.reshape(len(x), -1) @ weights["w3"] + weights["b3"], 0)
        logits = hidden @ weights["w4"] + weights["b4"]
        return logits[:, 1] - logits[:, 0]

    return run


def train_scorer(instances: DataFrame, features: list[str], label: str = "label", **parameters):
    """A logistic regression on feature columns, as a fitted ``pyspark.ml`` pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip"), LogisticRegression(labelCol=label, **parameters)]
    return Pipeline(stages=stages).fit(instances)


def evaluate_scorer(model, test: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy of a fitted model on held-out rows."""
    return accuracy(model.transform(test).select(F.col("prediction").alias("pred"), F.col(label).alias("label")))


def select_best(evaluations: DataFrame) -> DataFrame:
    """The model (model_id) of the best accuracy; ties to the smaller id."""
    return evaluations.agg(F.max(F.struct("accuracy", (-F.col("model_id")).alias("m"))).alias("b")).select((-F.col("b.m")).alias("model_id"), F.col("b.accuracy").alias("accuracy"))
