"""Boosted trees and logistic calibration with pyspark.ml, and a scorer for trees given as data."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from portolan.functions.scores import nonincreasing


def fit_trees(df: DataFrame, features: list[str], label: str, validation: str, rounds: int = 40, depth: int = 4, seed: int = 7):
    """Boosted trees that stop when the rows marked in `validation` no longer gain. Not the numbers of any other library."""
    ready = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)
    booster = GBTClassifier(labelCol=label, featuresCol="features", validationIndicatorCol=validation, maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed)
    return booster.fit(ready)


def margins(model, df: DataFrame, features: list[str]) -> DataFrame:
    """df with raw_score, the log odds before calibration."""
    ready = VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep").transform(df)
    return model.transform(ready).withColumn("raw_score", vector_to_array("rawPrediction")[1]).drop("features", "rawPrediction", "probability", "prediction")


def fit_platt(df: DataFrame, score: str, label: str) -> tuple[float, float]:
    """(slope, intercept) of a logistic curve over one score; ValueError if the slope is not positive."""
    ready = VectorAssembler(inputCols=[score], outputCol="platt_input").transform(df)
    fitted = LogisticRegression(featuresCol="platt_input", labelCol=label, regParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(ready)
    slope, intercept = float(fitted.coefficients[0]), float(fitted.intercept)
    if slope <= 0:
        raise ValueError(f"calibration slope is {slope}")
    return slope, intercept


COMPARE = {"<=": lambda x, t: x <= t, "<": lambda x, t: x < t, ">": lambda x, t: x > t, ">=": lambda x, t: x >= t}


def tree_value(node: dict, depth: int = 0) -> Column:
    """A tree as one expression. A node has `leaf`, or feature, op, threshold, missing (`yes` or `no`), yes and no."""
    if depth > 512:
        raise ValueError("a tree is deeper than 512")
    if "leaf" in node:
        return F.lit(float(node["leaf"]))
    x = F.col(node["feature"])
    yes = F.coalesce(COMPARE[node["op"]](x, F.lit(float(node["threshold"]))), F.lit(node["missing"] == "yes"))
    return F.when(yes, tree_value(node["yes"], depth + 1)).otherwise(tree_value(node["no"], depth + 1))


def ensemble(trees: list[dict], start: float = 0.0) -> Column:
    return sum((tree_value(t) for t in trees), F.lit(start))


def tree_fault(node: object, features: set[str]) -> str | None:
    """What keeps a tree from being scored."""
    if not isinstance(node, dict):
        return "node"
    if "leaf" in node:
        return None if isinstance(node["leaf"], (int, float)) and math.isfinite(node["leaf"]) else "leaf"
    if node.get("feature") not in features:
        return "feature"
    if node.get("op") not in COMPARE or node.get("missing") not in ("yes", "no"):
        return "branch"
    if not isinstance(node.get("threshold"), (int, float)) or not math.isfinite(node["threshold"]):
        return "threshold"
    return tree_fault(node.get("yes"), features) or tree_fault(node.get("no"), features)


def model_faults(model: dict) -> list[str]:
    """All faults of a stored model: features, and heads of name, trees, start, slope and intercept. None means that it may be scored."""
    features, heads = model.get("features") or [], model.get("heads") or []
    faults = ["features"] if not features or len(set(features)) < len(features) else []
    faults += ["heads"] if not heads or len({h.get("name") for h in heads}) < len(heads) else []
    for head in heads:
        numbers = [head.get(k) for k in ("start", "slope", "intercept")]
        if not all(isinstance(x, (int, float)) and math.isfinite(x) for x in numbers) or head["slope"] <= 0:
            faults.append(f"{head.get('name')}: calibration")
        found = {f for f in (tree_fault(t, set(features)) for t in head.get("trees") or [None]) if f}
        faults += [f"{head.get('name')}: {f}" for f in sorted(found)]
    return faults


def score_heads(df: DataFrame, model: dict) -> DataFrame:
    """df with the calibrated probability of each head under its name; ValueError if the model is faulty."""
    if faults := model_faults(model):
        raise ValueError(f"the model is faulty: {faults}")
    raw = {h["name"]: ensemble(h["trees"], h["start"]) * F.lit(float(h["slope"])) + F.lit(float(h["intercept"])) for h in model["heads"]}
    return df.withColumns({name: F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) for name, z in raw.items()})


def disparities(df: DataFrame, ours: str, theirs: str, most: float = 1e-9) -> DataFrame:
    """Rows whose two scores differ by more than `most`, and rows where either is null or NaN; a parity gate is assert_empty of these."""
    gap = F.abs(F.col(ours) - F.col(theirs))
    return df.filter(F.coalesce(F.isnan(gap) | (gap > most), F.lit(True)))


def exported(model, features: list[str]) -> list[dict]:
    """Fitted boosted trees in the node format of tree_value, each leaf with its tree's weight: their sum is the margin.

    A value goes left up to the threshold. NaN and null go right, as the fitted model takes NaN. Trees are bounded by their depth and number.
    """

    def walk(node, weight: float) -> dict:
        if node.numDescendants() == 0:
            return {"leaf": weight * float(node.prediction())}
        split = node.split()
        return {"feature": features[split.featureIndex()], "op": "<=", "threshold": float(split.threshold()), "missing": "no", "yes": walk(node.leftChild(), weight), "no": walk(node.rightChild(), weight)}

    return [walk(tree._java_obj.rootNode(), float(weight)) for tree, weight in zip(model.trees, model.treeWeights)]


def fit_heads(rows: DataFrame, features: list[str], heads: list[str], split: str, rounds: int = 6, depth: int = 3) -> dict:
    """A model in the format of model_faults with one head for each label of `heads`, fitted in order of time.

    rows has the features, the labels (0, 1 or null) and the split: a head learns from known labels of `train`, stops by those of `tune` and is
    calibrated on those of `calibration`; nothing else is read. A head whose learning labels are of one kind, or none, is one leaf,
    the log odds of (pos + 1) / (n + 2). Where calibration has one kind only or finds no rising curve, the margin's own curve stays (slope 2).
    """
    known = rows.select(F.col(split).alias("split_"), *[F.col(f).cast("double").alias(f) for f in features], *[F.col(h).cast("double").alias(f"label_{h}") for h in heads])
    parts = known.groupBy("split_").agg(*[F.count(f"label_{h}").alias(f"n_{h}") for h in heads], *[F.coalesce(F.sum(f"label_{h}"), F.lit(0.0)).alias(f"pos_{h}") for h in heads]).collect()  # one row a split
    counts = {r["split_"]: {h: (r[f"n_{h}"], int(r[f"pos_{h}"])) for h in heads} for r in parts}
    of = lambda part, h: counts.get(part, {}).get(h, (0, 0))
    out = []
    for h in heads:
        label, (n, pos) = f"label_{h}", of("train", h)
        head = {"name": h, "trees": [{"leaf": math.log((pos + 1) / (n - pos + 1))}], "start": 0.0, "slope": 1.0, "intercept": 0.0}
        if 0 < pos < n:
            learning = known.filter(F.col("split_").isin("train", "tune") & F.col(label).isNotNull()).withColumn("check_", F.col("split_") == "tune")
            fitted = fit_trees(learning, features, label, "check_", rounds, depth) if of("tune", h)[0] else None
            if fitted is not None:
                head |= {"trees": exported(fitted, features), "slope": 2.0}
                m, p = of("calibration", h)
                if 0 < p < m:
                    scored = known.filter((F.col("split_") == "calibration") & F.col(label).isNotNull()).select(ensemble(head["trees"]).alias("raw_"), label)
                    try:
                        head["slope"], head["intercept"] = fit_platt(scored, "raw_", label)
                    except ValueError:
                        pass
        out.append(head)
    return {"features": features, "heads": out, "prevalence": {h: (of("train", h)[1] / of("train", h)[0]) if of("train", h)[0] else None for h in heads}}


def consistent(scored: DataFrame, families: list[list[str]]) -> DataFrame:
    """scored with the chances of each family (two or three heads, likeliest first) made non-increasing."""
    for family in families:
        scored = scored.withColumns(dict(zip(family, nonincreasing(*map(F.col, family)))))
    return scored
