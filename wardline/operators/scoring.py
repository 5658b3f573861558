"""Losses, a baseline scorer, and attributions of linear-logit scorers."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions.scalars import cross_entropy, sigmoid
from wardline.functions.vectors import dot
from wardline.operators.ordered import HOT_ROWS, running_min


def bce_loss(df: DataFrame, probability: str, label: str, batch: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Mean binary cross-entropy over rows and, with ``batch``, the mean of the batch means."""
    losses = df.withColumn("_loss", cross_entropy(F.col(probability), F.col(label)))
    if batch is None:
        return losses.groupBy(*by).agg(F.avg("_loss").alias("row_mean"))
    batches = losses.groupBy(*by, batch).agg(F.sum("_loss").alias("_sum"), F.count("_loss").alias("_n"))
    return batches.groupBy(*by).agg(
        (F.sum("_sum") / F.sum("_n")).alias("row_mean"),
        F.avg(F.when(F.col("_n") > 0, F.col("_sum") / F.col("_n"))).alias("batch_mean"),
    )


def evaluate_splits(scored: DataFrame, probability: str, label: str, batch: str | None = None) -> DataFrame:
    return bce_loss(scored, probability, label, batch, by=["split"])


def running_best(history: DataFrame, run: str, epoch: str, loss: str, hot_rows: int | None = HOT_ROWS) -> DataFrame:
    """Add ``is_best``: the loss is below every earlier loss of the run."""
    marked = running_min(history, [run], [F.col(epoch)], loss, "_before", hot_rows)
    best = F.col("_before").isNull() | (F.col(loss) < F.col("_before"))
    return marked.withColumn("is_best", F.coalesce(best, F.lit(False))).drop("_before")


def best_epoch(history: DataFrame, run: str, epoch: str, loss: str) -> DataFrame:
    """The first epoch with the lowest loss of each run."""
    key = F.struct(F.col(loss), F.col(epoch))
    return history.where(F.col(loss).isNotNull()).groupBy(run).agg(F.min(key).alias("_best")).select(
        run, F.col(f"_best.{epoch}").alias("best_epoch"), F.col(f"_best.{loss}").alias("best_loss")
    )


def training_history(
    df: DataFrame, features: str, label: str, split: str = "split", epochs: int = 10, rate: float = 1.0
) -> tuple[DataFrame, list[float], float]:
    """Train a linear scorer by gradient descent on the training rows.

    Returns ``(epoch, train, validation, test)`` with the mean loss of each split after so many epochs (0: before the
    first), and the weights and bias in the end. An epoch is one pass over the rows, whose losses and gradients are merged
    in the tasks and then between them; one row per split reaches the driver. A split without rows has no loss. Without
    training rows nothing is learnt.
    """
    spark = df.sparkSession
    rows = df.select(
        F.col(split).alias("split"), F.col(label).cast("double").alias("label"), F.col(features).cast("array<double>").alias("x")
    ).where("label is not null and x is not null")
    weights: list[float] | None = None
    bias, history = 0.0, []
    for epoch in range(epochs + 1):
        logit = F.lit(bias) if weights is None else linear_score(F.col("x"), F.array(*map(F.lit, weights)), bias)
        scored = rows.withColumn("p", sigmoid(logit)).withColumn("error", F.col("p") - F.col("label"))
        pulls = array_to_vector(F.transform("x", lambda x: x * F.col("error")))
        found = {r["split"]: r for r in scored.groupBy("split").agg(
            F.avg(cross_entropy(F.col("p"), F.col("label"))).alias("loss"), F.avg("error").alias("mean_error"), Summarizer.mean(pulls).alias("pull")
        ).collect()}
        history.append((epoch, *(found[name]["loss"] if name in found else None for name in ("train", "validation", "test"))))
        if "train" not in found or epoch == epochs:
            continue
        pull = found["train"]["pull"].toArray()
        weights = [w - rate * float(g) for w, g in zip(weights or [0.0] * len(pull), pull)]
        bias -= rate * found["train"]["mean_error"]
    return spark.createDataFrame(history, "epoch int, train double, validation double, test double"), weights or [], bias


def combine_features(pooled: Column, static: Column) -> Column:
    return F.concat(pooled, static)


def linear_score(vector: Column, weights: Column, bias: float) -> Column:
    """Logit of a linear scorer."""
    return dot(vector, weights) + F.lit(float(bias))


def collect_predictions(df: DataFrame, key: str, vector: str, label: str, weights: Column, bias: float) -> DataFrame:
    """``(key, probability, label)`` of a linear scorer."""
    return df.select(key, sigmoid(linear_score(F.col(vector), weights, bias)).alias("probability"), label)


def integrated_gradients(df: DataFrame, item: str, vector: str, weights: Column, bias: float) -> DataFrame:
    """Attribution ``(item, dim, value)`` of each input against a zero baseline.

    For a sigmoid of a linear score the path integral has a closed form; a row's values add up to the
    score minus the baseline score.
    """
    b = F.lit(float(bias))
    logit = linear_score(F.col(vector), weights, bias)
    flat = sigmoid(b) * (1.0 - sigmoid(b))
    slope = F.when(F.abs(logit - b) < 1e-9, flat).otherwise((sigmoid(logit) - sigmoid(b)) / (logit - b))
    values = F.zip_with(F.col(vector), weights, lambda x, w: x.cast("double") * w * F.col("_slope"))
    return df.withColumn("_slope", slope).select(item, F.posexplode(values).alias("dim", "value"))


def two_layer(
    hidden: Sequence[Sequence[float]], hidden_bias: Sequence[float], outer: Sequence[float], bias: float
) -> tuple[Callable[[Column], Column], Callable[[Column], Column]]:
    """Score and gradient, as column expressions of a vector, of the sigmoid of weighted tanh units."""
    rows = [F.array(*[F.lit(float(w)) for w in row]) for row in hidden]

    def units(vector: Column) -> list[Column]:
        return [F.tanh(dot(vector, row) + F.lit(float(b))) for row, b in zip(rows, hidden_bias)]

    def score(vector: Column) -> Column:
        return sigmoid(sum((F.lit(float(v)) * h for v, h in zip(outer, units(vector))), F.lit(float(bias))))

    def gradient(vector: Column) -> Column:
        at = score(vector)
        slopes = F.array(*[at * (1 - at) * F.lit(float(v)) * (1 - h * h) for v, h in zip(outer, units(vector))])
        by_input = F.array(*[F.array(*[F.lit(float(row[i])) for row in hidden]) for i in range(len(hidden[0]))])
        return F.get(F.transform(F.array(slopes), lambda s: F.transform(by_input, lambda w: dot(w, s))), 0)

    return score, gradient


def path_gradients(df: DataFrame, item: str, vector: str, gradient: Callable[[Column], Column], steps: int = 32) -> DataFrame:
    """Attribution ``(item, dim, value)`` against a zero baseline for any scorer with a gradient.

    The integral of the gradient along the straight path is taken at the middle of ``steps`` equal parts, row by row in
    one pass. With more steps a row's values add up to the score minus the baseline score. A null vector has no rows.
    """
    x = F.col(vector).cast("array<double>")

    def add(total: Column, k: Column) -> Column:
        at = F.transform(x, lambda v: v * ((k + 0.5) / F.lit(float(steps))))
        return F.zip_with(total, gradient(at), lambda a, b: a + b)

    total = F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), F.transform(x, lambda v: F.lit(0.0)), add)
    values = F.zip_with(x, total, lambda v, g: v * g / F.lit(float(steps)))
    return df.select(item, F.posexplode(values).alias("dim", "value"))


def feature_ablation(
    df: DataFrame, vector: str, scorer: Callable[[Column], Column], groups: Mapping[str, tuple[int, int]]
) -> DataFrame:
    """Mean change of the score when a group of inputs ``[from, to)`` is set to zero.

    All groups are scored in one pass over the rows.
    """
    def without(start: int, end: int) -> Column:
        return F.transform(F.col(vector), lambda x, i: F.when((i >= start) & (i < end), F.lit(0.0)).otherwise(x.cast("double")))

    full = scorer(F.col(vector))
    changes = df.agg(*[F.avg(full - scorer(without(*span))).alias(name) for name, span in groups.items()])
    return changes.unpivot([], list(groups), "feature_group", "mean_change")


def mortality_baseline(
    train: DataFrame, features: str, label: str, max_iter: int = 50, regularization: float = 0.01, tolerance: float = 1e-6
) -> LogisticRegressionModel:
    """Logistic regression on an array column, trained by Spark."""
    packed = train.select(array_to_vector(F.col(features)).alias("_features"), F.col(label).cast("double").alias("_label"))
    model = LogisticRegression(
        featuresCol="_features", labelCol="_label", maxIter=max_iter, regParam=regularization, tol=tolerance,
        standardization=True,
    )
    return model.fit(packed)


def two_layer_baseline(
    train: DataFrame, features: str, label: str, units: int = 8, max_iter: int = 200, seed: int = 0
) -> tuple[list[list[float]], list[float], list[float], float]:
    """A scorer with one hidden layer on an array column, trained by Spark: the arguments of ``two_layer``.

    Inputs are scaled to mean zero and deviation one for the training; the scaling is part of the weights returned. An
    input that does not vary has no weight. Rows without label or features are left out.
    """
    complete = train.where(F.col(features).isNotNull() & F.col(label).isNotNull())
    packed = complete.select(array_to_vector(F.col(features)).alias("_x"), F.col(label).cast("double").alias("_label"))
    moments = packed.agg(Summarizer.mean(F.col("_x")).alias("mean"), Summarizer.std(F.col("_x")).alias("deviation")).first()
    mean, deviation = moments["mean"].toArray(), moments["deviation"].toArray()
    scale = np.where(deviation > 0, 1 / np.where(deviation > 0, deviation, 1), 0.0)
    centre, factor = (F.array(*[F.lit(float(v)) for v in values]) for values in (mean, scale))
    centred = F.zip_with(vector_to_array("_x"), centre, lambda x, m: x - m)
    scaled = packed.select(array_to_vector(F.zip_with(centred, factor, lambda x, f: x * f)).alias("_x"), "_label")
    model = MultilayerPerceptronClassifier(
        featuresCol="_x", labelCol="_label", layers=[len(mean), units, 2], maxIter=max_iter, seed=seed
    ).fit(scaled)
    # per layer the weights, input by input, and the biases; hidden units are logistic, sigmoid(z) = (1 + tanh(z / 2)) / 2
    flat, inner = model.weights.toArray(), len(mean) * units
    hidden, hidden_bias = flat[:inner].reshape(len(mean), units).T * scale, flat[inner : inner + units]
    outer, outer_bias = flat[inner + units : inner + 3 * units].reshape(units, 2), flat[inner + 3 * units :]
    pull = (outer[:, 1] - outer[:, 0]) / 2
    return (
        (hidden / 2).tolist(), ((hidden_bias - hidden @ mean) / 2).tolist(), pull.tolist(),
        float(outer_bias[1] - outer_bias[0] + pull.sum()),
    )


def score_baseline(model: LogisticRegressionModel, df: DataFrame, features: str, name: str = "probability") -> DataFrame:
    packed = df.withColumn("_features", array_to_vector(F.col(features)))
    scored = model.transform(packed).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*df.columns, name)


def loss_gradient(
    scored: DataFrame, model: LogisticRegressionModel, features: str, label: str, probability: str, regularization: float
) -> DataFrame:
    """``(slot, gradient)`` of the penalised mean loss at the fitted weights, with inputs scaled to deviation one.

    An input that does not vary has no weight and no gradient. One pass over the rows.
    """
    weights = F.array(*[F.lit(float(w)) for w in model.coefficients])
    rows = scored.select((F.col(probability) - F.col(label)).alias("_error"), F.posexplode(features).alias("slot", "_x"))
    sums = rows.groupBy("slot").agg(F.avg(F.col("_error") * F.col("_x")).alias("_pull"), F.stddev_samp("_x").alias("_deviation"))
    pull = F.col("_pull") / F.col("_deviation") + regularization * F.get(weights, F.col("slot")) * F.col("_deviation")
    return sums.select("slot", F.when(F.col("_deviation") > 0, pull).otherwise(F.lit(0.0)).alias("gradient"))
