"""Pluggable scorers of text pairs and embeddings; the fallbacks need no model files."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import HashingTF, IDF, NGram, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LENGTH = 200

PairScorer = Callable[[list[str], list[str]], np.ndarray]


def record_text(records: DataFrame) -> DataFrame:
    """id, text: name and address of at most LENGTH characters each side of a bar."""
    return records.select("id", F.concat_ws(" | ", F.substring("name_norm", 1, LENGTH), F.substring("addr_norm", 1, LENGTH)).alias("text"))


def embed_texts(texts: DataFrame, features: int = 256) -> DataFrame:
    """id, vector: normalised TF-IDF of hashed character 3-grams, in place of a trained encoder."""
    steps = [
        RegexTokenizer(inputCol="text", outputCol="_c", pattern=".", gaps=False), NGram(n=3, inputCol="_c", outputCol="_g"), HashingTF(inputCol="_g", outputCol="_t", numFeatures=features),
        IDF(inputCol="_t", outputCol="_i"), Normalizer(inputCol="_i", outputCol="_n"),
    ]
    made = Pipeline(stages=steps).fit(texts).transform(texts)
    return made.select("id", vector_to_array("_n").alias("vector"))


def overlap_scorer(left: list[str], right: list[str]) -> np.ndarray:
    """The fallback scorer: a logistic curve over the share of common character 3-grams."""

    def grams(text: str) -> set[str]:
        return {text[k : k + 3] for k in range(max(1, len(text) - 2))}

    shares = [len(a & b) / max(1, len(a | b)) for a, b in ((grams(x), grams(y)) for x, y in zip(left, right, strict=True))]
    return 1 / (1 + np.exp(-12 * (np.array(shares) - 0.4)))


def score_pairs(pairs: DataFrame, texts1: DataFrame, texts2: DataFrame, scorer: PairScorer = overlap_scorer, name: str = "ce") -> DataFrame:
    """s1, r and the scorer's value for the texts of each pair, in Arrow batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(scorer(a.fillna("").tolist(), b.fillna("").tolist()))

    one, two = texts1.select(F.col("id").alias("s1"), F.col("text").alias("ta")), texts2.select(F.col("id").alias("r"), F.col("text").alias("tb"))
    return pairs.select("s1", "r").join(one, "s1", "left").join(two, "r", "left").select("s1", "r", run("ta", "tb").alias(name))
