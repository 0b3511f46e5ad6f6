"""Classification heads over vectors (X8-X10), trained by Spark."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(scored: DataFrame) -> float:
    """Share of right predictions; 0 without rows."""
    return scored.agg(F.coalesce(F.avg((F.col("prediction") == F.col("label")).cast("int")), F.lit(0.0)).alias("x")).first().x


def train_head(rows: DataFrame, validation: DataFrame, n_classes: int, mlp: bool = False, rounds: tuple[int, ...] = (20, 60), seed: int = 0):
    """The head of best accuracy on the validation rows, the first of equals, and that accuracy; rows: (features,
    label).  A linear head or one hidden layer, tried with several numbers of rounds."""
    size = rows.select(F.size("features").alias("n")).first().n
    train, held = (df.select(array_to_vector(F.transform("features", lambda x: x.cast("double"))).alias("features"), F.col("label").cast("double").alias("label")) for df in (rows, validation))
    best, best_accuracy = None, -1.0
    for n in rounds:
        head = MultilayerPerceptronClassifier(layers=[size, 32, n_classes], maxIter=n, seed=seed) if mlp else LogisticRegression(maxIter=n, regParam=0.01)
        model = head.fit(train)
        reached = accuracy(model.transform(held))
        if reached > best_accuracy:
            best, best_accuracy = model, reached
    return best, best_accuracy
