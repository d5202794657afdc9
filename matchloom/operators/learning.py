"""Pair scorers: boosted trees out of fold, cross-fitting in halves, checks without a country, thinning of entities."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import bucket

SEED = 42
FOLDS = 5
#: Trees have no missing values: null features take a value below all others.
MISSING = -1.0


def fold(s1: Column) -> Column:
    """0 to 4 by entity; fold 0 is the validation set."""
    return F.floor(bucket(s1, str(SEED + 1), 100) / 20)


def subsample(pairs: DataFrame, per_mille: int) -> DataFrame:
    return pairs.where(bucket(F.col("s1"), str(SEED + 3), 1000) < per_mille)


def thin_entities(pairs: DataFrame, percent: int = 19) -> DataFrame:
    """pairs without so many percent of the entities, while their records stay: a test at lower density."""
    return pairs.where(bucket(F.col("s1"), str(SEED + 5), 100) >= percent)


def half(s1: Column, salt: int = SEED + 11) -> Column:
    return bucket(s1, str(salt), 2)


def fit_trees(rows: DataFrame, features: list[str], trees: int = 20, depth: int = 5, weight: str | None = None, rate: float = 0.1) -> PipelineModel:
    """Boosted trees on label y."""
    kind = GBTClassifier(featuresCol="features", labelCol="y", maxIter=trees, maxDepth=depth, stepSize=rate, seed=SEED, **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="features"), kind]).fit(_filled(rows, features))


def _filled(rows: DataFrame, features: list[str]) -> DataFrame:
    return rows.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(MISSING)) for f in features})


def score(model: PipelineModel, rows: DataFrame, features: list[str], name: str) -> DataFrame:
    """rows with the model's probability as name."""
    scored = model.transform(_filled(rows, features))
    return scored.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def out_of_fold(rows: DataFrame, features: list[str], name: str = "p1", **how) -> DataFrame:
    """rows with fold and a score from a model that saw neither their fold nor (but for fold 0's own) fold 0.

    Model k is fitted without folds 0 and k and scores fold k; model 0, fitted on folds 1 to 4, scores fold 0.
    """
    rows = rows.withColumn("fold", fold(F.col("s1")))
    parts = []
    for k in range(FOLDS):
        model = fit_trees(rows.where((F.col("fold") != 0) & (F.col("fold") != k)), features, **how)
        parts.append(score(model, rows.where(F.col("fold") == k), features, name))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def cross_fit(rows: DataFrame, features: list[str], name: str = "ps", salt: int = SEED + 11, **how) -> DataFrame:
    """rows with a score from the model of the other half of the entities."""
    rows = rows.withColumn("half", half(F.col("s1"), salt))
    parts = [score(fit_trees(rows.where(F.col("half") != k), features, **how), rows.where(F.col("half") == k), features, name) for k in (0, 1)]
    return parts[0].unionByName(parts[1])


def leave_one_country_out(rows: DataFrame, features: list[str], name: str = "p", **how) -> DataFrame:
    """rows with a score from a model that saw no pair of their country."""
    out = None
    for country in sorted(r["country"] for r in rows.select("country").distinct().collect()):
        part = score(fit_trees(rows.where(F.col("country") != country), features, **how), rows.where(F.col("country") == country), features, name)
        out = part if out is None else out.unionByName(part)
    return out


def importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    gains = model.stages[-1].featureImportances.toArray()
    return sorted(zip(features, map(float, gains), strict=True), key=lambda x: (-x[1], x[0]))


def orphan_weights(rows: DataFrame, truth: DataFrame, weight: float) -> DataFrame:
    """rows with orphan (nobody owns the record) and w: weight for those, 1 for all others."""
    owned = truth.select("r").distinct().withColumn("_owned", F.lit(True))
    made = rows.join(owned, "r", "left").withColumn("orphan", F.col("_owned").isNull()).drop("_owned")
    return made.withColumn("w", F.when(F.col("orphan"), F.lit(weight)).otherwise(1.0))


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    return pairs.join(truth.select("s1", "r").distinct().withColumn("y", F.lit(1)), ["s1", "r"], "left").fillna(0, ["y"])


def training_pairs(truth: DataFrame, candidates: DataFrame, easy: int) -> DataFrame:
    """s1, r, hard: true pairs that the candidates miss, twice, and a hashed sample of so many of the rest."""
    found = candidates.select("s1", "r").distinct()
    missed = truth.join(found, ["s1", "r"], "left_anti").select("s1", "r", F.lit(True).alias("hard"))
    rest = truth.join(found, ["s1", "r"], "left_semi").orderBy(F.md5(F.concat("s1", F.lit("|"), "r")), "s1", "r").limit(easy).select("s1", "r", F.lit(False).alias("hard"))
    return missed.union(missed).union(rest)
