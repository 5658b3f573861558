"""Attention, attribution and scoring on the given vectors.

A vector is read as an 8 by 8 grid: query and key, or position and dimension. Its label is the head or
the sequence, its number the batch or the item.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from suite.feature_queries import _POSITIONS_SQL, _SPLIT_SQL, order, split_labels, steps
from suite.registry import Tables, query, rounded
from wardline.functions import scalars, vectors
from wardline.operators import attention, attribution, fits, scoring, sequences
from wardline.session import stored

_LONG_SQL = "SELECT vec_id, label, unnest(embedding)::double AS v, generate_subscripts(embedding, 1)::int - 1 AS i FROM embeddings"
_ATTENTION_SQL = f"SELECT label % 4 AS layer, vec_id % 4 AS batch, label AS head, i // 8 AS q, i % 8 AS k, v AS weight FROM ({_LONG_SQL})"
_POOLING_SQL = f"SELECT vec_id % 4 AS batch, label AS head, i AS pos, v AS weight FROM ({_LONG_SQL})"
_GRID_SQL = f"SELECT vec_id AS item, i // 8 AS pos, i % 8 AS dim, v AS value FROM ({_LONG_SQL})"


def _long(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "label", F.posexplode("embedding").alias("i", "x")).select(
        "vec_id", "label", "i", F.col("x").cast("double").alias("v")
    )


def _cell(at: str) -> Column:
    return F.floor(F.col("i") / 8).cast("int").alias("q") if at == "row" else (F.col("i") % 8).alias("k")


def attention_table(t: Tables) -> DataFrame:
    return _long(t).select(
        (F.col("label") % 4).alias("layer"), (F.col("vec_id") % 4).alias("batch"), F.col("label").alias("head"),
        _cell("row"), _cell("column"), F.col("v").alias("weight"),
    )


def pooling_table(t: Tables) -> DataFrame:
    return _long(t).select(
        (F.col("vec_id") % 4).alias("batch"), F.col("label").alias("head"), F.col("i").alias("pos"), F.col("v").alias("weight")
    )


def grid_table(t: Tables) -> DataFrame:
    return _long(t).select(
        F.col("vec_id").alias("item"), (F.col("vec_id") % 4).alias("batch"), _cell("row").alias("pos"), _cell("column").alias("dim"),
        F.col("v").alias("value"),
    )


def _round(df: DataFrame, *columns: str, places: int = 5) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c), places) for c in columns})


@query("layer_attention_mean", f"SELECT layer, q, k, round(avg(weight), 5) AS mean_weight FROM ({_ATTENTION_SQL}) GROUP BY layer, q, k")
def layer_attention_mean(t: Tables) -> DataFrame:
    return _round(attention.layer_attention_mean(attention_table(t)), "mean_weight")


@query("layer_global_local", f"""SELECT layer, round(avg(weight), 5) AS global_attention, round(avg(weight) FILTER (q = k), 5) AS local_attention
  FROM ({_ATTENTION_SQL}) GROUP BY layer""")
def layer_global_local(t: Tables) -> DataFrame:
    return _round(attention.layer_global_local(attention_table(t)), "global_attention", "local_attention")


_IMPORTANCE_SQL = f"SELECT head, pos, avg(weight) AS importance FROM ({_POOLING_SQL}) GROUP BY head, pos"


@query("position_importance", f"SELECT head, pos, round(importance, 5) AS importance FROM ({_IMPORTANCE_SQL})")
def position_importance(t: Tables) -> DataFrame:
    return _round(attention.position_importance(pooling_table(t)), "importance")


@query("combined_importance", f"SELECT pos, round(avg(importance), 5) AS importance FROM ({_IMPORTANCE_SQL}) GROUP BY pos")
def combined_importance(t: Tables) -> DataFrame:
    return _round(attention.combined_importance(attention.position_importance(pooling_table(t))), "importance")


@query("head_statistics", f"""SELECT head, round(avg(importance), 5) AS mean_attention, round(stddev_samp(importance), 5) AS std_sample,
  round(stddev_pop(importance), 5) AS std_population FROM ({_IMPORTANCE_SQL}) GROUP BY head""")
def head_statistics(t: Tables) -> DataFrame:
    stats = attention.head_statistics(attention.position_importance(pooling_table(t)))
    return _round(stats, "mean_attention", "std_sample", "std_population")


@query("weight_histogram", f"""WITH w AS ({_POOLING_SQL}), e AS (SELECT min(weight) AS lo, max(weight) AS hi FROM w),
  c AS (SELECT least(floor((weight - lo) / ((hi - lo) / 30)), 29)::int AS bin, count(*) AS n FROM w, e GROUP BY 1)
  SELECT r.i::int AS bin, coalesce(n, 0) AS n FROM range(30) r(i) LEFT JOIN c ON c.bin = r.i""")
def weight_histogram(t: Tables) -> DataFrame:
    return attention.weight_histogram(pooling_table(t), "weight", 30)


@query("critical_positions", f"SELECT batch, head, pos, round(weight, 6) AS weight FROM ({_POOLING_SQL}) WHERE weight > 0.1")
def critical_positions(t: Tables) -> DataFrame:
    return _round(attention.critical_positions(pooling_table(t), 0.1), "weight", places=6)


@query("top_k_positions", f"""SELECT head, pos, rank, round(importance, 5) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY head
  ORDER BY importance DESC NULLS LAST, pos) - 1 AS rank FROM ({_IMPORTANCE_SQL})) WHERE rank < 5""")
def top_k_positions(t: Tables) -> DataFrame:
    return _round(attention.top_k_positions(attention.position_importance(pooling_table(t))), "importance")


@query("top_k_features", f"""SELECT pos, dim, rank, round(importance, 5) AS importance FROM (SELECT *, row_number() OVER (PARTITION BY pos
  ORDER BY importance DESC, dim) - 1 AS rank FROM (SELECT head AS pos, pos AS dim, avg(weight) AS importance FROM ({_POOLING_SQL}) GROUP BY 1, 2)) WHERE rank < 10""")
def top_k_features(t: Tables) -> DataFrame:
    outputs = pooling_table(t).select(F.col("head").alias("pos"), F.col("pos").alias("dim"), F.col("weight").alias("value"))
    return _round(attention.top_k_features(outputs, 10), "importance")


@query("first_n_batches", "SELECT vec_id, vec_id // 16 AS batch FROM embeddings WHERE vec_id // 16 < 10")
def first_n_batches(t: Tables) -> DataFrame:
    batched = t.embeddings.select("vec_id", F.floor(F.col("vec_id") / 16).alias("batch"))
    return attention.first_n_batches(batched, 10)


@query("feature_by_position", f"SELECT pos, round(avg(value), 5) AS mean_value FROM ({_GRID_SQL}) GROUP BY pos")
def feature_by_position(t: Tables) -> DataFrame:
    return _round(attention.feature_by_position(grid_table(t)), "mean_value")


@query("feature_by_dimension", f"SELECT dim, round(avg(value), 5) AS mean_value FROM ({_GRID_SQL}) GROUP BY dim")
def feature_by_dimension(t: Tables) -> DataFrame:
    return _round(attention.feature_by_dimension(grid_table(t)), "mean_value")


@query("mean_vector", f"""WITH m AS (SELECT vec_id % 4 AS batch, i, avg(v) AS v FROM ({_LONG_SQL}) GROUP BY 1, 2)
  SELECT batch, i AS dim, round(v, 5) AS value, round(sqrt(sum(v * v) OVER (PARTITION BY batch)), 5) AS norm FROM m""")
def mean_vector(t: Tables) -> DataFrame:
    batched = t.embeddings.select((F.col("vec_id") % 4).alias("batch"), "embedding")
    means = sequences.mean_vector(batched, ["batch"], "embedding")
    rows = means.select("batch", vectors.norm(F.col("mean")).alias("norm"), F.posexplode("mean").alias("dim", "value"))
    return _round(rows, "value", "norm")


@query("attribution_matrix", f"SELECT pos, dim, round(avg(value), 5) AS mean_value FROM ({_GRID_SQL}) GROUP BY pos, dim")
def attribution_matrix(t: Tables) -> DataFrame:
    return _round(attribution.attribution_matrix(grid_table(t)), "mean_value")


@query("attribution_by_dimension", f"SELECT dim, round(avg(value), 5) AS mean_value FROM ({_GRID_SQL}) GROUP BY dim")
def attribution_by_dimension(t: Tables) -> DataFrame:
    return _round(attribution.attribution_by_dimension(grid_table(t)), "mean_value")


@query("attribution_by_position", f"SELECT pos, round(avg(value), 5) AS mean_value FROM ({_GRID_SQL}) GROUP BY pos")
def attribution_by_position(t: Tables) -> DataFrame:
    return _round(attribution.attribution_by_position(grid_table(t)), "mean_value")


@query("static_attribution_mean", f"SELECT i AS dim, round(avg(v), 5) AS mean_value FROM ({_LONG_SQL}) GROUP BY i")
def static_attribution_mean(t: Tables) -> DataFrame:
    return _round(attribution.static_attribution_mean(_long(t).select(F.col("i").alias("dim"), F.col("v").alias("value"))), "mean_value")


_POSITION_WEIGHT_SQL = f"SELECT user_id, event_id % 3 AS head, pos, (event_id * 7919 % 10007) / 10007::double AS weight FROM ({_POSITIONS_SQL})"


@query("temporal_attribution", f"""SELECT w.user_id, head, rank, w.pos, round(weight, 5) AS weight, event_id, event_type FROM (SELECT *, row_number() OVER
  (PARTITION BY user_id, head ORDER BY weight DESC NULLS LAST, pos) - 1 AS rank FROM ({_POSITION_WEIGHT_SQL})) w
  JOIN ({_POSITIONS_SQL}) e ON e.user_id = w.user_id AND e.pos = w.pos WHERE rank < 5""")
def temporal_attribution(t: Tables) -> DataFrame:
    """Weights of the steps of each user, a head for every third event."""
    placed = sequences.position_index(steps(t).select("user_id", "event_id", "event_type", "minutes"), "user_id", order()).drop("minutes")
    weight = (F.col("event_id") * 7919 % 10007) / F.lit(10007.0)
    weights = placed.select("user_id", (F.col("event_id") % 3).alias("head"), "pos", weight.alias("weight"))
    return _round(attention.temporal_attribution(weights, placed, "user_id"), "weight")


# ---- softmax pooling ----

_QUERY_SQL = "((i * 7 % 5) - 2) / 2::double"
_SCORE_SQL = f"SELECT vec_id, label, sum(v * {_QUERY_SQL}) / sqrt(64::double) AS score FROM ({_LONG_SQL}) GROUP BY vec_id, label"
_WEIGHT_SQL = f"""SELECT vec_id, label, exp(score - max(score) OVER w) / sum(exp(score)) OVER w * exp(max(score) OVER w) AS weight FROM ({_SCORE_SQL})
  WINDOW w AS (PARTITION BY label)"""
_LOOSE_SQL = _WEIGHT_SQL.replace(f"FROM ({_SCORE_SQL})", f"FROM (SELECT vec_id, nullif(label, 3) AS label, score FROM ({_SCORE_SQL}))")


def query_vector() -> Column:
    """A fixed query of 64 numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i * 7) % 5 - 2) / F.lit(2.0))


@query("softmax_pool_weights", f"SELECT vec_id, label, round(weight, 6) AS weight FROM ({_LOOSE_SQL})")
def softmax_pool_weights(t: Tables) -> DataFrame:
    """Rows without a label are a group as well."""
    score = attention.attention_score(F.col("embedding"), query_vector(), 64)
    scored = t.embeddings.select("vec_id", F.nullif("label", F.lit(3)).alias("label"), score.alias("score"))
    return _round(attention.softmax_pool_weights(scored, ["label"], "score").drop("score"), "weight", places=6)


_POOLED_SQL = f"SELECT l.label, i AS dim, sum(v * weight) AS value FROM ({_LONG_SQL}) l JOIN ({_WEIGHT_SQL}) w USING (vec_id) GROUP BY l.label, i"


def pooled_vectors(t: Tables) -> DataFrame:
    return attention.softmax_attention_pool(t.embeddings, "label", "embedding", query_vector(), 64)


@query("softmax_attention_pool", f"SELECT label, dim, round(value, 5) AS value FROM ({_POOLED_SQL})")
def softmax_attention_pool(t: Tables) -> DataFrame:
    return _round(pooled_vectors(t).select("label", F.posexplode("pooled").alias("dim", "value")), "value")


@query("combine_features", f"""SELECT label, dim, round(value, 5) AS value FROM ({_POOLED_SQL})
  UNION ALL SELECT label, 64, count(*)::double FROM embeddings GROUP BY label""")
def combine_features(t: Tables) -> DataFrame:
    static = t.embeddings.groupBy("label").agg(F.array(F.count(F.lit(1)).cast("double")).alias("static"))
    both = pooled_vectors(t).join(static, "label")
    combined = scoring.combine_features(F.col("pooled"), F.col("static"))
    return _round(both.select("label", F.posexplode(combined).alias("dim", "value")), "value")


# ---- losses and linear scorers ----

_P_SQL = """SELECT doc_id, doc_id % 16 AS batch, quality, (doc_id % 97) / 96::double AS p FROM labels"""
_LN1 = "greatest(CASE WHEN p > 0 THEN ln(p) END, -100)"
_LN0 = "greatest(CASE WHEN p < 1 THEN ln(1 - p) END, -100)"
_LOSS_SQL = f"SELECT *, -(quality * coalesce({_LN1}, -100) + (1 - quality) * coalesce({_LN0}, -100)) AS loss FROM ({_P_SQL})"


def _probabilities(df: DataFrame) -> DataFrame:
    return df.withColumns({"batch": F.col("doc_id") % 16, "p": (F.col("doc_id") % 97) / F.lit(96.0)})


@query("bce_loss", f"""SELECT round(sum(s) / sum(n), 6) AS row_mean, round(avg(s / n), 6) AS batch_mean FROM
  (SELECT batch, sum(loss) AS s, count(*) AS n FROM ({_LOSS_SQL}) GROUP BY batch)""")
def bce_loss(t: Tables) -> DataFrame:
    return _round(scoring.bce_loss(_probabilities(t.labels), "p", "quality", "batch"), "row_mean", "batch_mean", places=6)


@query("evaluate_splits", f"""SELECT split, round(sum(s) / sum(n), 6) AS row_mean, round(avg(s / n), 6) AS batch_mean FROM
  (SELECT split, batch, sum(loss) AS s, count(*) AS n FROM ({_LOSS_SQL}) JOIN ({_SPLIT_SQL}) x USING (doc_id) GROUP BY split, batch) GROUP BY split""")
def evaluate_splits(t: Tables) -> DataFrame:
    scored = _probabilities(split_labels(t))
    return _round(scoring.evaluate_splits(scored, "p", "quality", "batch"), "row_mean", "batch_mean", places=6)


BIAS = -0.25
_W_SQL = "((i * 5 % 7) - 3) / 4::double"
_LOGIT_SQL = f"SELECT vec_id, label, sum(v * {_W_SQL}) + {BIAS}::double AS z FROM ({_LONG_SQL}) GROUP BY vec_id, label"


def weights() -> Column:
    """Fixed weights of a linear scorer over 64 numbers."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: ((i * 5) % 7 - 3) / F.lit(4.0))


@query("collect_predictions", f"SELECT vec_id, round(1 / (1 + exp(-z)), 6) AS probability, (label > 4)::int AS label FROM ({_LOGIT_SQL})")
def collect_predictions(t: Tables) -> DataFrame:
    labelled = t.embeddings.select("vec_id", "embedding", (F.col("label") > 4).cast("int").alias("label"))
    return _round(scoring.collect_predictions(labelled, "vec_id", "embedding", "label", weights(), BIAS), "probability", places=6)


_SIG_B = f"(1 / (1 + exp(-({BIAS}::double))))"


@query("integrated_gradients", f"""SELECT vec_id, i AS dim, round(v * {_W_SQL} * CASE WHEN abs(z - ({BIAS})) < 1e-9 THEN {_SIG_B} * (1 - {_SIG_B})
  ELSE (1 / (1 + exp(-z)) - {_SIG_B}) / (z - ({BIAS})) END, 6) AS value FROM ({_LONG_SQL}) JOIN ({_LOGIT_SQL}) USING (vec_id)""")
def integrated_gradients(t: Tables) -> DataFrame:
    return _round(scoring.integrated_gradients(t.embeddings, "vec_id", "embedding", weights(), BIAS), "value", places=6)


_W2_SQL = "((i * 3 % 5) - 2) / 4::double"
_STEPS = 8
_UNITS_SQL = f"""SELECT vec_id, s1, s2, k, tanh((k + 0.5) / {_STEPS} * s1 + 0.1) AS h1, tanh((k + 0.5) / {_STEPS} * s2 - 0.2) AS h2 FROM
  (SELECT vec_id, sum(v * {_W_SQL}) AS s1, sum(v * {_W2_SQL}) AS s2 FROM ({_LONG_SQL}) GROUP BY vec_id), range({_STEPS}) r(k)"""
_FACTORS_SQL = f"""SELECT vec_id, avg(p * (1 - p) * 1.5 * (1 - h1 * h1)) AS f1, avg(p * (1 - p) * -0.75 * (1 - h2 * h2)) AS f2 FROM
  (SELECT *, 1 / (1 + exp(-(1.5 * h1 - 0.75 * h2 + 0.05))) AS p FROM ({_UNITS_SQL})) GROUP BY vec_id"""


@query("path_gradients", f"""SELECT vec_id, i AS dim, round(v * (f1 * {_W_SQL} + f2 * {_W2_SQL}), 6) AS value
  FROM ({_LONG_SQL}) JOIN ({_FACTORS_SQL}) USING (vec_id)""")
def path_gradients(t: Tables) -> DataFrame:
    """Attributions of a scorer with two tanh units."""
    hidden = [[((i * 5) % 7 - 3) / 4 for i in range(64)], [((i * 3) % 5 - 2) / 4 for i in range(64)]]
    _, gradient = scoring.two_layer(hidden, [0.1, -0.2], [1.5, -0.75], 0.05)
    return _round(scoring.path_gradients(t.embeddings, "vec_id", "embedding", gradient, _STEPS), "value", places=6)


_EPOCHS, _RATE = 4, 2.0
_HISTORY_ROWS_SQL = f"""SELECT split, quality, CASE WHEN lang = 'en' THEN 1.0::double ELSE 0.0::double END AS x0, ln(1 + n_chars::double) / 10 AS x1
  FROM ({_SPLIT_SQL}) s JOIN documents USING (doc_id)"""


def _history_sql() -> str:
    """The same descent, an epoch after the other."""
    steps = [f"WITH r AS ({_HISTORY_ROWS_SQL}), w0 AS (SELECT 0.0::double AS a, 0.0::double AS b, 0.0::double AS c)"]
    for e in range(_EPOCHS + 1):
        steps.append(f"p{e} AS (SELECT split, quality, x0, x1, 1 / (1 + exp(-(a * x0 + b * x1 + c))) AS p FROM r, w{e})")
        steps.append(f"""l{e} AS (SELECT {e} AS epoch, avg(loss) FILTER (WHERE split = 'train') AS train, avg(loss) FILTER (WHERE split = 'validation') AS validation,
          avg(loss) FILTER (WHERE split = 'test') AS test FROM (SELECT split, -(quality * ln(p) + (1 - quality) * ln(1 - p)) AS loss FROM p{e}))""")
        steps.append(f"""w{e + 1} AS (SELECT any_value(a) - {_RATE}::double * avg((p - quality) * x0) AS a, any_value(b) - {_RATE}::double * avg((p - quality) * x1) AS b,
          any_value(c) - {_RATE}::double * avg(p - quality) AS c FROM p{e}, w{e} WHERE split = 'train')""")
    return ", ".join(steps) + ", h AS (" + " UNION ALL ".join(f"SELECT * FROM l{e}" for e in range(_EPOCHS + 1)) + ")"


def _scored_rows(t: Tables) -> DataFrame:
    english, length = F.when(F.col("lang") == "en", 1.0).otherwise(0.0), F.log(1 + F.col("n_chars").cast("double")) / 10
    return split_labels(t).join(t.documents.select("doc_id", F.array(english, length).alias("x")), "doc_id")


def _history(t: Tables) -> DataFrame:
    return scoring.training_history(_scored_rows(t), "x", "quality", epochs=_EPOCHS, rate=_RATE)[0].withColumn("run", F.lit(1))


@query("training_history", _history_sql() + """ SELECT epoch::int AS epoch, round(train, 6) AS train, round(validation, 6) AS validation, round(test, 6) AS test,
  coalesce(validation < min(validation) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM h""")
def training_history(t: Tables) -> DataFrame:
    marked = scoring.running_best(_history(t), "run", "epoch", "validation").drop("run")
    return _round(marked, "train", "validation", "test", places=6)


@query("history_best_epoch", _history_sql() + " SELECT arg_min(epoch, (validation, epoch))::int AS best_epoch, round(min(validation), 6) AS best_loss FROM h")
def history_best_epoch(t: Tables) -> DataFrame:
    return _round(scoring.best_epoch(_history(t), "run", "epoch", "validation").drop("run"), "best_loss", places=6)


_GROUPS = {"event_type": (0, 5), "event_text": (5, 63), "time": (63, 64)}


@query("feature_ablation", " UNION ALL ".join(f"""SELECT '{name}' AS feature_group, round(avg(1 / (1 + exp(-z)) - 1 / (1 + exp(-z0))), 6) AS mean_change FROM
  ({_LOGIT_SQL}) JOIN (SELECT vec_id, sum(CASE WHEN i >= {a} AND i < {b} THEN 0 ELSE v END * {_W_SQL}) + {BIAS}::double AS z0 FROM ({_LONG_SQL}) GROUP BY vec_id) USING (vec_id)"""
  for name, (a, b) in _GROUPS.items()))
def feature_ablation(t: Tables) -> DataFrame:
    def score(vector: Column) -> Column:
        return scalars.sigmoid(scoring.linear_score(vector, weights(), BIAS))

    return _round(scoring.feature_ablation(t.embeddings, "embedding", score, _GROUPS), "mean_change", places=6)


REGULARIZATION = 0.01


@query("mortality_baseline", f"""WITH d AS (SELECT doc_id, lang, source FROM documents), n AS (SELECT (SELECT count(DISTINCT lang) FROM d) + (SELECT count(DISTINCT source) FROM d) + 1 AS slots),
  train AS (SELECT avg(quality) AS rate FROM ({_SPLIT_SQL}) x JOIN d USING (doc_id) WHERE split = 'train')
  SELECT i::int AS slot, 0.0::double AS gradient, NULL::double AS rate FROM n, range(slots) r(i) UNION ALL SELECT -1, NULL, round(rate, 3) FROM train""")
def mortality_baseline(t: Tables) -> DataFrame:
    """What makes the fitted model the best one: on the training rows the gradient of the penalised loss is zero in every slot
    (on the scale of the standardised inputs), and the mean predicted probability is the rate of the label."""
    documents = t.documents.select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    rows = split_labels(t).join(documents, "doc_id")
    fitted = fits.fit(documents, ["lang", "source"], ["n_chars"], fits.UNKNOWN)
    features = rows.withColumn("features", fits.static_vector(fitted, ["lang", "source"], "n_chars"))
    train = stored(features.where(F.col("split") == "train").select("features", "quality"), "train")
    model = scoring.mortality_baseline(train, "features", "quality", max_iter=200, regularization=REGULARIZATION)
    scored = scoring.score_baseline(model, train, "features")
    gradients = scoring.loss_gradient(scored, model, "features", "quality", "probability", REGULARIZATION)
    rate = scored.agg(F.lit(-1).alias("slot"), F.lit(None).cast("double").alias("gradient"), F.round(F.avg("probability"), 3).alias("rate"))
    return gradients.select("slot", (F.round("gradient", 3) + 0.0).alias("gradient"), F.lit(None).cast("double").alias("rate")).unionByName(rate)


_NEWTON_STEPS = 8


def _newton_sql() -> str:
    """The minimum of the same penalised loss by Newton steps, each solving three equations by determinants."""
    steps = [f"""WITH r AS MATERIALIZED (SELECT * FROM ({_HISTORY_ROWS_SQL}) WHERE split = 'train'),
      d AS MATERIALIZED (SELECT {REGULARIZATION}::double * var_samp(x0) AS d0, {REGULARIZATION}::double * var_samp(x1) AS d1 FROM r),
      w0 AS MATERIALIZED (SELECT 0.0::double AS a, 0.0::double AS b, 0.0::double AS c)"""]
    for e in range(_NEWTON_STEPS):
        steps.append(f"""s{e} AS MATERIALIZED (SELECT any_value(a) AS a, any_value(b) AS b, any_value(c) AS c,
          avg((p - quality) * x0) + any_value(d0 * a) AS g0, avg((p - quality) * x1) + any_value(d1 * b) AS g1, avg(p - quality) AS g2,
          avg(p * (1 - p) * x0 * x0) + any_value(d0) AS h00, avg(p * (1 - p) * x0 * x1) AS h01, avg(p * (1 - p) * x0) AS h02,
          avg(p * (1 - p) * x1 * x1) + any_value(d1) AS h11, avg(p * (1 - p) * x1) AS h12, avg(p * (1 - p)) AS h22
          FROM (SELECT *, 1 / (1 + exp(-(a * x0 + b * x1 + c))) AS p FROM r, w{e}, d))""")
        steps.append(f"""w{e + 1} AS MATERIALIZED (SELECT
          a - (g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2)) / det AS a,
          b - (h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02)) / det AS b,
          c - (h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02)) / det AS c
          FROM (SELECT *, h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02) AS det FROM s{e}))""")
    return ", ".join(steps)


@query("baseline_coefficients", _newton_sql() + f""" SELECT i::int AS slot, round([a, b, c][i + 1], 3) AS coefficient
  FROM w{_NEWTON_STEPS}, range(3) r2(i)""")
def baseline_coefficients(t: Tables) -> DataFrame:
    """The weights that Spark's solver finds, the intercept last, against those of another solver."""
    train = _scored_rows(t).where("split = 'train'")
    model = scoring.mortality_baseline(train, "x", "quality", max_iter=500, regularization=REGULARIZATION, tolerance=1e-12)
    found = [*map(float, model.coefficients), float(model.intercept)]
    return t.spark.createDataFrame(list(enumerate(found)), "slot int, c double").select("slot", (F.round("c", 3) + 0.0).alias("coefficient"))


@query("two_layer_baseline", f"""SELECT count(*) AS n, true AS below_bound FROM ({_SPLIT_SQL}) JOIN documents USING (doc_id) WHERE split = 'test'""")
def two_layer_baseline(t: Tables) -> DataFrame:
    """Rows of the test split, and whether the mean loss there of a trained scorer with a hidden layer is below that of a coin."""
    rows = stored(_scored_rows(t), "scored")
    score, _ = scoring.two_layer(*scoring.two_layer_baseline(rows.where("split = 'train'"), "x", "quality", units=4, max_iter=100))
    loss = scalars.cross_entropy(score(F.col("x")), F.col("quality"))
    return rows.where("split = 'test'").agg(F.count(F.lit(1)).alias("n"), (F.avg(loss) < math.log(2)).alias("below_bound"))


@query("attribution_histogram", f"""WITH w AS ({_LONG_SQL}), e AS (SELECT min(v) AS low, max(v) AS high FROM w)
  SELECT b.bin::int AS bin, count(v) AS n FROM range(50) b(bin) LEFT JOIN
  (SELECT v, least(floor((v - low) / ((high - low) / 50)), 49) AS bin FROM w, e) x ON x.bin = b.bin GROUP BY b.bin""")
def attribution_histogram(t: Tables) -> DataFrame:
    return attribution.attribution_histogram(_long(t).select(F.col("v").alias("value")))


@query("static_feature_attribution", f"""WITH pooled AS (SELECT label, i, avg(v) AS x FROM ({_LONG_SQL}) GROUP BY label, i),
  x AS (SELECT label, i, x FROM pooled UNION ALL SELECT label, 64, count(*)::double / 100 FROM embeddings GROUP BY label),
  z AS (SELECT label, sum(x * ((i * 5 % 7) - 3) / 4::double) + {BIAS}::double AS z FROM x GROUP BY label)
  SELECT i AS dim, round(avg(x * (((i * 5) % 7) - 3) / 4::double * CASE WHEN abs(z - ({BIAS})) < 1e-9 THEN {_SIG_B} * (1 - {_SIG_B})
  ELSE (1 / (1 + exp(-z)) - {_SIG_B}) / (z - ({BIAS})) END), 6) AS mean_value FROM x JOIN z USING (label) GROUP BY i""")
def static_feature_attribution(t: Tables) -> DataFrame:
    """Attribution of mean-pooled sequences joined with a static feature, averaged over the sequences."""
    pooled = sequences.sequence_mean_pool(t.embeddings, "label", "embedding")
    static = t.embeddings.groupBy("label").agg(F.array(F.count(F.lit(1)) / F.lit(100.0)).alias("static"))
    both = pooled.join(static, "label").select("label", scoring.combine_features(F.col("pooled"), F.col("static")).alias("x"))
    longer = F.transform(F.sequence(F.lit(0), F.lit(64)), lambda i: ((i * 5) % 7 - 3) / F.lit(4.0))
    values = scoring.integrated_gradients(both, "label", "x", longer, BIAS)
    return _round(attribution.static_attribution_mean(values), "mean_value", places=6)
