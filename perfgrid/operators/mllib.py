"""Learners backed by Spark ML: one large dataset, few configurations.

Hyperparameters come as text from the grid. Where Spark ML has no equal learner the
nearest one is used, as noted per entry.
"""

from __future__ import annotations

import math

from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    GBTClassifier,
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import Imputer, OneHotEncoder, PCA, StandardScaler, StringIndexer, UnivariateFeatureSelector, VarianceThresholdSelector, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 0
MOST_STEPS = 1000  # solvers stop by their tolerance; this only ends one that does not converge


def _leaf_rows(text: str, n_rows: int) -> int:
    """Smallest leaf for a minimum split size given as rows or as a share of the rows.

    Spark ML bounds leaves, not splits: half of the split size is the nearest bound.
    """
    v = float(text)
    split = max(2, math.ceil(v * n_rows)) if v < 1 else int(v)
    return max(1, math.ceil(split / 2))


def _tree(h: dict, n: int, **kw) -> dict:
    return dict(minInstancesPerNode=_leaf_rows(h.get("min_samples_split", "2"), n), maxDepth=int(h.get("max_depth", 30)), seed=SEED, **kw)


def learner(algorithm: str, h: dict, n_rows: int, n_features: int, n_classes: int) -> Estimator:
    """Estimator on (features, label) for one config of the grid."""
    if algorithm == "Logit":
        c = float(h.get("C", 1))
        return LogisticRegression(regParam=1 / (c * n_rows), elasticNetParam=1.0 if h.get("penalty") == "l1" else 0.0, standardization=False, maxIter=MOST_STEPS, tol=1e-8)
    if algorithm == "lSVM":  # hinge instead of squared hinge
        return OneVsRest(classifier=LinearSVC(regParam=1 / (float(h.get("C", 1)) * n_rows), standardization=False, maxIter=MOST_STEPS, tol=1e-6))
    if algorithm == "DT":
        return DecisionTreeClassifier(**_tree(h, n_rows))
    if algorithm == "RF":
        return RandomForestClassifier(impurity=h.get("criterion", "gini"), numTrees=int(h.get("n_trees", 100)), **_tree(h, n_rows))
    if algorithm == "ExtraTrees":  # few bins and no bootstrap stand in for random thresholds
        return RandomForestClassifier(
            impurity=h.get("criterion", "gini"), numTrees=int(h.get("n_trees", 100)), bootstrap=False, maxBins=int(h.get("max_bins", 32)), **_tree(h, n_rows)
        )
    if algorithm == "GBT":  # binary learner, one against the rest
        subset = "log2" if h.get("max_features") == "log2" else "all"
        gbt = GBTClassifier(
            stepSize=float(h.get("learning_rate", 0.1)), maxDepth=int(h.get("max_depth", 3)), featureSubsetStrategy=subset,
            maxIter=int(h.get("n_estimators", 100)), seed=SEED,
        )
        return gbt if n_classes == 2 else OneVsRest(classifier=gbt)
    if algorithm == "MLP":  # no adam and no weight penalty
        solver = "gd" if h.get("solver") == "sgd" else "l-bfgs"
        return MultilayerPerceptronClassifier(
            layers=[n_features, 100, n_classes], solver=solver, stepSize=float(h.get("learning_rate_init", 0.001)), maxIter=int(h.get("max_iter", 200)), seed=SEED
        )
    raise ValueError(f"no estimator for {algorithm}")


def regressor(algorithm: str, alpha: float, n_rows: int, label_sd: float, l1_ratio: float = 0.5) -> Estimator:
    """Penalized linear regression on (features, label), with penalties as usually defined: lasso and elastic
    net beside half the mean squared error, ridge beside the sum of squares.

    Spark ML fits the label divided by its (population) deviation, which leaves the absolute penalty as it is
    and divides the squared one by the deviation; ``label_sd`` takes that back.
    """
    if algorithm == "Ridge":
        first, second = 0.0, alpha / max(1, n_rows)
    else:
        share = {"Lasso": 1.0, "ElasticNet": l1_ratio}[algorithm]
        first, second = alpha * share, alpha * (1 - share)
    weight = first + second * label_sd
    return LinearRegression(regParam=weight, elasticNetParam=first / weight if weight else 0.0, standardization=False, maxIter=MOST_STEPS, tol=1e-12)


def preparation(config: dict, numeric: list[str], categorical: list[str], n_rows: int, folds: int = 5) -> list[Estimator]:
    """Stages imputer, encoder, standardizer and reducer of a five-step config, ending in ``features``."""
    stages: list = []
    strategy = config["imputer"]["hyperparameters"]["strategy"]
    filled = list(numeric)
    if numeric and strategy != "constant":
        filled = [f"{c}__f" for c in numeric]
        stages.append(Imputer(inputCols=numeric, outputCols=filled, strategy="mode" if strategy == "most_frequent" else strategy))
    inputs = list(filled)
    for c in categorical:
        stages.append(StringIndexer(inputCol=c, outputCol=f"{c}__i", handleInvalid="keep"))
        if config["encoder"]["algorithm"] == "OneHotEncoder":
            stages.append(OneHotEncoder(inputCol=f"{c}__i", outputCol=f"{c}__o", dropLast=True))
            inputs.append(f"{c}__o")
        else:
            inputs.append(f"{c}__i")
    last = "assembled"
    stages.append(VectorAssembler(inputCols=inputs, outputCol=last, handleInvalid="keep"))
    if config["standardizer"]["algorithm"]:
        # Sample deviation here; the exact population form is in operators.prep.
        stages.append(StandardScaler(inputCol=last, outputCol="scaled", withMean=True))
        last = "scaled"
    red = config["dim_reducer"]
    d = len(numeric) + len(categorical)
    if red["algorithm"] == "PCA":
        share = float(red["hyperparameters"]["n_components"].rstrip("%")) / 100
        stages.append(PCA(k=max(1, int(min((folds - 1) * n_rows / folds, share * d))), inputCol=last, outputCol="reduced"))
        last = "reduced"
    elif red["algorithm"] == "VarianceThreshold":
        stages.append(VarianceThresholdSelector(featuresCol=last, outputCol="reduced", varianceThreshold=0.0))
        last = "reduced"
    elif red["algorithm"] == "SelectKBest":
        k = max(1, int(float(red["hyperparameters"]["k"].rstrip("%")) / 100 * d))
        sel = UnivariateFeatureSelector(featuresCol=last, outputCol="reduced", labelCol="label", selectionMode="numTopFeatures")
        stages.append(sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k))
        last = "reduced"
    return [*stages, last]


def fit_predict(
    train: DataFrame, test: DataFrame, config: dict, numeric: list[str], categorical: list[str], label: str = "label"
) -> DataFrame:
    """Fits a whole five-step config on train and predicts test (label decoded)."""
    *stages, last = preparation(config, numeric, categorical, train.count())
    indexer = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(train)
    names = indexer.labels
    if config["imputer"]["hyperparameters"]["strategy"] == "constant":
        train, test = train.fillna(0.0, numeric), test.fillna(0.0, numeric)
    rename = lambda d: indexer.transform(d).withColumnRenamed(label, "_truth").withColumnRenamed("_label", "label")
    ready = Pipeline(stages=stages).fit(rename(train))
    prepared = ready.transform(rename(train))
    width = prepared.select(last).first()[0].size
    est = learner(config["estimator"]["algorithm"], config["estimator"]["hyperparameters"], prepared.count(), width, len(names))
    est = est.setFeaturesCol(last)
    out = est.fit(prepared).transform(ready.transform(rename(test)))
    decoded = F.element_at(F.array(*[F.lit(v) for v in names]), (F.col("prediction") + 1).cast("int"))
    keep = [c for c in test.columns if c != label]
    return out.select(*keep, F.col("_truth").alias(label), decoded.alias("prediction"))
