"""Scores: fusion rules, stored logistic models, pluggable scorers and models that Spark ML trains."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .document import neighbours


def heuristic_fusion(a: str, b: str, transition: str, low: str, metadata: str, use: frozenset = frozenset({"transition", "low", "max", "metadata"})) -> Column:
    """Two scores and three flags as one score, by the first rule that holds; ``use`` names the rules that are on.

    A transition lifts the larger score, else low burstiness does, else the larger of two scores counts if one
    is notable, else their mean. With one score only a transition lifts it, with none the result is 0.02, which
    is also that of metadata.
    """
    x, y = F.col(a), F.col(b)
    base, off = F.greatest(x, y), F.lit(False)
    rule = lambda name, c: c if name in use else off
    lifted = lambda c, by: F.least(F.lit(0.99), F.greatest(c, F.lit(0.65)) + by)
    both = (F.when(rule("transition", F.col(transition)), lifted(base, 0.15)).when(rule("low", F.col(low) & (base >= 0.35)), F.least(F.lit(0.99), base + 0.10))
            .when(rule("max", (x >= 0.38) | (y >= 0.38)), base).otherwise(0.50 * y + 0.50 * x))
    single = F.when(rule("transition", F.col(transition)), lifted(base, 0.12)).otherwise(base)
    out = F.when(x.isNotNull() & y.isNotNull(), both).otherwise(F.coalesce(single, F.lit(0.02)))
    return F.when(rule("metadata", F.col(metadata)), F.lit(0.02)).otherwise(out)


#: The conditions of the ablation: rules that are on.
ABLATIONS = {"all": ("transition", "low", "max", "metadata"), "no_transition": ("low", "max", "metadata"), "no_low": ("transition", "max", "metadata"), "no_max": ("transition", "low", "metadata"), "no_metadata": ("transition", "low", "max"), "none": ()}

#: The 13 inputs of the learned fusion, in the order of a stored model.
FUSION_FEATURES = (
    "prob_rob", "prob_mb", "word_len", "log_len", "prev_prob_rob", "next_prob_rob", "prev_prob_mb", "next_prob_mb",
    "neighbor_mean_rob", "neighbor_mean_mb", "diff_rob_mb", "mean_rob_mb", "max_rob_mb",
)


def fusion_features(df: DataFrame, a: str = "score", b: str = "other") -> DataFrame:
    """``df`` (doc_id, sent_idx, n_words) with FUSION_FEATURES; at a document's edges a sentence is its own neighbour."""
    d = neighbours(df, a).withColumnsRenamed({"prev": "prev_prob_rob", "next": "next_prob_rob"})
    d = neighbours(d, b).withColumnsRenamed({"prev": "prev_prob_mb", "next": "next_prob_mb"})
    x, y, n = F.col(a), F.col(b), F.col("n_words").cast("double")
    mean = lambda k: (F.col(f"prev_prob_{k}") + F.col(f"next_prob_{k}")) / 2
    return d.withColumns({"prob_rob": x, "prob_mb": y, "word_len": n, "log_len": F.log1p(n), "neighbor_mean_rob": mean("rob"), "neighbor_mean_mb": mean("mb"), "diff_rob_mb": F.abs(x - y), "mean_rob_mb": (x + y) / 2, "max_rob_mb": F.greatest(x, y)})


def load_model(text: str) -> dict:
    """A stored fusion model: JSON of names, coefficients, intercept, means, scales, threshold and calibration."""
    m = json.loads(text)
    if not len(m["feature_names"]) == len(m["coefficients"]) == len(m["scaler_mean"]) == len(m["scaler_scale"]):
        raise ValueError("a model's lists must be of one length")
    return m


def logistic_score(model: dict, calibrated: bool = False) -> Column:
    """The probability that a stored model gives a row; ``calibrated``: by the curve that is stored with it."""
    z = F.lit(float(model["intercept"]))
    for name, c, m, s in zip(model["feature_names"], model["coefficients"], model["scaler_mean"], model["scaler_scale"], strict=True):
        z = z + F.lit(float(c)) * (F.col(name) - float(m)) / float(s or 1.0)
    p = T.sigmoid(z)
    if not calibrated:
        return p
    if len(model["calibrator_y"]) != 101:
        raise ValueError("a stored curve has 101 values")
    return F.greatest(F.least(T.interpolate(p, F.array(*(F.lit(float(v)) for v in model["calibrator_y"]))), F.lit(1.0)), F.lit(0.0))


def score_with(df: DataFrame, scorer: Callable[[list[str]], list[float]] | None, text: str = "sentence") -> DataFrame:
    """``df`` with ``score`` from a function of a batch of texts; a scorer that is missing is an error."""
    if scorer is None:
        raise ValueError("no scorer was given, and there is none to fall back to")

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(scorer(s.tolist()), dtype="float64")

    return df.withColumn("score", run(F.col(text)))


def score_in_batches(df: DataFrame, load: Callable[[], Callable[[list[str]], list[float]]], text: str = "sentence", size: int = 64) -> DataFrame:
    """``df`` with ``score`` and ``padded``. Each task calls ``load`` once for a scorer of a batch of texts and gives it ``size`` at a
    time, rows of a partition by length, so that texts of a batch are of about one length; ``padded`` is the length to which a
    text's batch is filled up, the work that a model does. A score belongs to its text and not to its batch. Null texts are empty."""

    @F.pandas_udf("struct<score:double,padded:long>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = load()
        for s in parts:
            texts = s.fillna("")
            length = texts.str.len().to_numpy(dtype="int64")
            order = length.argsort(kind="stable")
            score, padded = pd.Series(0.0, index=range(len(texts))), pd.Series(0, index=range(len(texts)), dtype="int64")
            for i in range(0, len(order), size):
                batch = order[i : i + size]
                score.iloc[batch] = [float(x) for x in scorer(texts.iloc[batch].tolist())]
                padded.iloc[batch] = int(length[batch].max())
            yield pd.DataFrame({"score": score, "padded": padded})

    d = df.drop("score", "padded").sortWithinPartitions(F.length(text)).withColumn("_scored", run(F.col(text).cast("string")))
    return d.select("*", "_scored.score", "_scored.padded").drop("_scored")


def lexical_score(c) -> Column:
    """A score from transitions and markers alone."""
    return F.round(F.least(F.lit(0.99), F.lit(0.1) + F.when(T.has_transition(c), 0.35).otherwise(0.0) + F.when(T.has_marker(c), 0.5).otherwise(0.0)), 6)
