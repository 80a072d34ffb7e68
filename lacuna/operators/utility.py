"""How useful an imputed table is: classifiers trained on it, against the same trained on the truth."""

from __future__ import annotations

from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from lacuna.functions.holes import known, q
from lacuna.operators.cells import assert_no_holes
from lacuna.operators.neighbors import PROFILE, nearest_cells, profiles, tag_rows, with_long_keys
from lacuna.roles import Roles
from lacuna.scratch import cut_spread

MODELS = ("logit", "GaussNB", "KNN", "tree", "RF")
KNN_K = 5


def scale_stats(train: DataFrame, roles: Roles) -> dict[str, tuple[float, float]]:
    """Mean and sample standard deviation (1 where it is 0) of the continuous columns; one aggregate."""
    names = roles.continuous
    if not names:
        return {}
    got = train.agg(*[g(known(train, f)).alias(f"{i}{tag}") for i, f in enumerate(names)
                      for tag, g in (("m", F.avg), ("s", F.stddev_samp))]).first().asDict()
    return {f: (got[f"{i}m"], got[f"{i}s"] or 1.0) for i, f in enumerate(names)}


def standardize(df: DataFrame, stats: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (q(f).cast("double") - F.lit(m)) / F.lit(s) for f, (m, s) in stats.items()})


def knn_classify(train: DataFrame, test: DataFrame, roles: Roles, k: int = KNN_K, **tuning) -> DataFrame:
    """key, prediction: majority label of the k nearest training rows, the lowest of equal ones."""
    vector = F.array(*[q(f).cast("double") for f in roles.covariates])
    (train, _), (test, restore) = with_long_keys(train, roles.key), with_long_keys(test, roles.key)
    donors = profiles(tag_rows(train.select(roles.key, vector.alias("vec"), known(train, roles.target).cast("double").alias("label")),
                               roles.key, "vec", ["label"]), k)
    asked = tag_rows(test.select(roles.key, vector.alias("vec"), F.lit(None).cast("double").alias("label")),
                     roles.key, "vec", ["label"])
    found = nearest_cells(profiles(asked, 1), donors, k, "euclidean", 1, **tuning)
    votes = found.groupBy(*PROFILE).agg(F.mode("value", deterministic=True).alias("prediction"))
    return restore(asked.select(*PROFILE, F.col("key").alias(roles.key)).join(votes, list(PROFILE)).select(roles.key, "prediction"), roles.key)


def micro_f1(predicted: DataFrame, label: str, prediction: str) -> DataFrame:
    """One row: share of correct predictions, which is micro-F1 with one label per row."""
    return predicted.agg(F.avg(F.when(q(label) == q(prediction), 1.0).otherwise(0.0)).alias("f1"))


def estimators(n_rows: int, seed: int = 0, tree_depth: int = 30, forest_depth: int = 10, bins: int = 64) -> dict:
    """The four fitted models. The penalty of the logistic model is 1/n, as with unit inverse strength.

    Trees split on at most ``bins`` candidate values per covariate. 30 is the deepest tree there is; the 100 trees of
    the forest stop at ``forest_depth``.
    """
    from pyspark.ml.classification import (
        DecisionTreeClassifier, LogisticRegression, NaiveBayes, RandomForestClassifier,
    )

    return {
        "logit": LogisticRegression(maxIter=1000, tol=1e-4, regParam=1.0 / max(n_rows, 1), standardization=False),
        "GaussNB": NaiveBayes(modelType="gaussian"),
        "tree": DecisionTreeClassifier(maxDepth=tree_depth, maxBins=bins, seed=seed),
        "RF": RandomForestClassifier(numTrees=100, maxDepth=forest_depth, maxBins=bins, seed=seed),
    }


@dataclass(frozen=True)
class Scores:
    """F1 of each model and the forest's importance of each covariate."""

    f1: dict[str, float]
    importance: dict[str, float]

    @property
    def mean(self) -> float:
        return sum(self.f1.values()) / len(self.f1)


def _assembled(df: DataFrame, roles: Roles) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    x = F.array(*[q(f).cast("double") for f in roles.covariates])
    return df.select(roles.key, array_to_vector(x).alias("features"), q(roles.target).cast("double").alias("label"))


def model_scores(train: DataFrame, test: DataFrame, roles: Roles, models=MODELS, seed: int = 0, **limits) -> Scores:
    """Train each model on ``train`` and score it on ``test``; both are coded and standardised. ``limits``: see ``estimators``."""
    unknown = set(models) - set(MODELS)
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    fit_on, n = cut_spread(_assembled(train, roles), "train")
    score_on, _ = cut_spread(_assembled(test, roles), "test")
    made = estimators(n, seed, **limits)

    def score(name):
        if name == "KNN":
            guess = knn_classify(train, test, roles)
            scored = guess.join(test.select(roles.key, q(roles.target).alias("label")), roles.key)
            return micro_f1(scored, "label", "prediction").first()[0], None
        model = made[name].fit(fit_on)
        f1 = micro_f1(model.transform(score_on), "label", "prediction").first()[0]
        return f1, model.featureImportances.toArray().tolist() if name == "RF" else None

    # independent fits run side by side, so small stages of one fill the gaps of another
    with ThreadPool(len(models)) as pool:
        results = dict(zip(models, pool.map(inheritable_thread_target(train.sparkSession)(score), models)))
    importance = next((dict(zip(roles.covariates, v)) for _, v in results.values() if v), {})
    return Scores({n: f1 for n, (f1, _) in results.items()}, importance)


def rank_correlation(x: dict[str, float], y: dict[str, float]) -> float:
    """Spearman of two named score lists held by the driver: a few models, or the covariates."""
    a, b = pd.Series(x).rank(), pd.Series(y).rank()
    return float(a.corr(b)) if a.nunique() > 1 and b.nunique() > 1 else float("nan")


def only_first_class(imputed: DataFrame, target: str) -> bool:
    """True when every target is code 0, so no classifier can be trained."""
    return not imputed.agg(F.sum(q(target))).first()[0]


def classification(train: DataFrame, test: DataFrame, imputed: DataFrame, roles: Roles, models=MODELS, seed: int = 0, **limits) -> dict:
    """base_cls, imputed_cls, model_selection, feature_selection. ``limits``: see ``estimators``."""
    stats = scale_stats(train, roles)
    train = assert_no_holes(standardize(train, stats), roles.features)
    test = assert_no_holes(standardize(test, stats), roles.features)
    base = model_scores(train, test, roles, models, seed, **limits)
    if only_first_class(imputed, roles.target):
        return {"base_cls": base.mean, "imputed_cls": 0.0, "model_selection": 0.0, "feature_selection": 0.0}
    got = model_scores(standardize(imputed, stats), test, roles, models, seed, **limits)
    return {"base_cls": base.mean, "imputed_cls": got.mean,
            "model_selection": rank_correlation(base.f1, got.f1),
            "feature_selection": rank_correlation(base.importance, got.importance) if base.importance else None}
