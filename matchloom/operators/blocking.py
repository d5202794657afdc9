"""Candidate generation: key families, pruning of hot keys, idf weights, cosine and the best candidates of an entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import materialise

FAMILIES = ("n", "s", "p", "c", "a", "b", "h", "m", "z")
MORE_FAMILIES = ("k", "w")
CAP_SHARE, CAP_LEAST = 5e-4, 40
CANDIDATES = 100


def _long(words: str | Column, n: int) -> Column:
    return F.filter(words, lambda t: F.length(t) >= n)


def _pairs(words: Column) -> Column:
    """Ordered pairs of different words."""
    return F.flatten(F.transform(words, lambda x: F.transform(F.filter(words, lambda y: x < y), lambda y: F.concat_ws("|", x, y))))


def _product(a: Column, b: Column) -> Column:
    return F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.concat_ws("|", x, y))))


def family_keys(family: str) -> Column:
    """The keys of one family of a normalised record, as an array of strings."""
    core, none = F.col("name_core"), F.array().cast("array<string>")
    numbers = F.array_distinct(F.concat(F.transform("addr_nums", lambda x: F.right(x, F.lit(4))), F.transform(_long("addr_nums", 4), lambda x: F.right(x, F.lit(3)))))
    sorted_core = F.array_join(F.array_sort(F.filter(F.split(core, ""), lambda c: c != "")), "")
    skeletons = F.slice(F.filter("name_skel", lambda t: t != ""), 1, 5)
    return {
        "n": lambda: _long("name_toks", 3),
        "s": lambda: _long("name_skel", 3),
        "p": lambda: F.when(F.length(core) >= 5, F.array(F.substring(core, 1, 5))).otherwise(none),
        "c": lambda: F.when(F.length(core) >= 6, F.array(core)).otherwise(none),
        "a": lambda: _long("addr_alpha", 4),
        "b": lambda: _pairs(F.slice(_long("name_toks", 3), 1, 6)),
        "h": lambda: _product(numbers, F.col("addr_alpha")),
        "m": lambda: _product(numbers, _long("name_toks", 3)),
        "z": lambda: F.when(F.length(core) >= 6, F.array(sorted_core)).otherwise(none),
        "k": lambda: _pairs(skeletons),
        "w": lambda: F.when(F.length(F.array_join("name_skel", "")) >= 4, F.array(F.array_join("name_skel", ""))).otherwise(none),
    }[family]()


def make_keys(records: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """country, id, fam, key: distinct keys of normalised records, by one explode."""

    def tagged(family: str) -> Column:
        return F.transform(F.array_distinct(family_keys(family)), lambda k: F.struct(F.lit(family).alias("fam"), k.alias("key")))

    each = [tagged(f) for f in families]
    return records.select("country", "id", F.explode(F.concat(*each)).alias("k")).select("country", "id", "k.fam", "k.key")


def key_weights(keys1: DataFrame, keys2: DataFrame, records: DataFrame) -> DataFrame:
    """country, fam, key, df, df1, w of the keys that both sides have and that neither has too often.

    A side has a key too often if more than max(CAP_LEAST, CAP_SHARE of the country's records) rows hold it. w is the
    key's ln(1 + records / df).
    """
    by = ["country", "fam", "key"]
    n = records.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    cap = F.greatest(F.lit(CAP_LEAST), F.floor(F.lit(CAP_SHARE) * F.col("n")))
    df2 = keys2.groupBy(*by).agg(F.count(F.lit(1)).alias("df"))
    df1 = keys1.groupBy(*by).agg(F.count(F.lit(1)).alias("df1"))
    both = df2.join(df1, by).join(F.broadcast(n), "country")  # a row a country
    return both.where((F.col("df") <= cap) & (F.col("df1") <= cap)).select(*by, "df", "df1", F.log(1 + F.col("n") / F.col("df")).alias("w"))


def block_pairs(records1: DataFrame, records2: DataFrame, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """country, s1, r, score, nk, w_<family>..., ws, wr, cos: all pairs that share a kept key.

    A key's rows are at most its cap on either side, so no group of pairs is unbounded.
    """
    by = ["country", "fam", "key"]
    # each side's keys are made once, and read for their counts, their sums and the pairs
    keys1, keys2 = (materialise(make_keys(x, families), "keys") for x in (records1, records2))
    weights = key_weights(keys1, keys2, records2).select(*by, "w")

    def kept(keys: DataFrame, ident: str, total: str) -> DataFrame:
        own = keys.join(weights, by).withColumnRenamed("id", ident)
        return own.withColumn(total, F.sum("w").over(Window.partitionBy("country", ident)))

    one = [F.sum(F.when(F.col("fam") == f, F.col("w")).otherwise(0.0)).alias(f"w_{f}") for f in families]
    # the totals travel with the keys, so the pairs, of which there are many more, are shuffled once
    pairs = kept(keys1, "s1", "ws").join(kept(keys2, "r", "wr").drop("w"), by).groupBy("country", "s1", "r")
    pairs = pairs.agg(F.sum("w").alias("score"), F.count(F.lit(1)).alias("nk"), *one, F.max("ws").alias("ws"), F.max("wr").alias("wr"))
    return pairs.withColumn("cos", F.col("score") / F.sqrt(F.col("ws") * F.col("wr")))


def top_candidates(pairs: DataFrame, k: int = CANDIDATES) -> DataFrame:
    """The k best pairs of each entity by cosine (to 9 places), then record; adds rank."""
    best = Window.partitionBy("country", "s1").orderBy(F.round("cos", 9).desc(), "r")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def recall_at(blocks: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (5, 10, 20, 40, 60, 100)) -> DataFrame:
    """k, recall: share of the true pairs (s1, r) whose rank is at most k."""
    ranked = truth.join(blocks.select("s1", "r", "rank"), ["s1", "r"], "left")
    grid = ranked.select("rank", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return grid.groupBy("k").agg(F.avg(F.when(F.col("rank") <= F.col("k"), 1.0).otherwise(0.0)).alias("recall"))


def reduction(pairs: DataFrame, records1: DataFrame, records2: DataFrame) -> DataFrame:
    """country, pairs, ratio: how far candidates stay below all pairs of a country."""
    n1, n2 = (x.groupBy("country").agg(F.count(F.lit(1)).alias(n)) for x, n in ((records1, "n1"), (records2, "n2")))
    made = pairs.groupBy("country").agg(F.count(F.lit(1)).alias("pairs"))
    return n1.join(n2, "country").join(made, "country").select("country", "pairs", (1 - F.col("pairs") / (F.col("n1") * F.col("n2"))).alias("ratio"))
