"""Features against false matches: cleaned names, localities, rare words, and twins that add a word or shift a number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType

from ..functions.kernels import edit_distances, jaro_winklers, pair_udf, ratio_udf, token_set_udf
from ..functions.text import jaccard, tokens

# Words that carry no identity in a name.
NOISE = "france frnce india usa id cie".split()
LOCALITY_LEAST = 5


def clean_words() -> Column:
    """The words of a normalised record's name that say who it is."""
    return F.filter(tokens(F.col("name_norm")), lambda t: ~t.isin(NOISE) & ~t.rlike("^[0-9]+$"))


def address_parts() -> Column:
    """The parts of a normalised record's address between commas, of letters only, from three letters on."""
    return F.filter(
        F.transform(F.split(F.lower(F.coalesce("addr", F.lit(""))), ","), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"[^a-z ]+", " "), r"\s+", " "))), lambda x: F.length(x) >= 3
    )


def cleaned(records: DataFrame) -> DataFrame:
    """country, id, ctoks, ckey (sorted words), comps (address parts of letters), num1, akey (address)."""
    words, parts = clean_words(), address_parts()
    return records.select("country", "id", words.alias("ctoks"), F.array_join(F.array_sort(words), " ").alias("ckey"), parts.alias("comps"), F.try_element_at("addr_nums", F.lit(1)).alias("num1"), F.when(~F.col("addr_missing"), F.col("addr_norm")).alias("akey"))


def locality_vocabulary(clean: DataFrame, least: int = LOCALITY_LEAST) -> DataFrame:
    """country, loc, n: address parts of entities that are seen at least so often."""
    seen = clean.select("country", "id", F.explode(F.array_distinct("comps")).alias("loc"))
    return seen.groupBy("country", "loc").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def localities(clean: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """country, id, locs: sorted address parts of a record that are in the vocabulary; rows without one are left out."""
    parts = clean.select("country", "id", F.explode(F.array_distinct("comps")).alias("loc"))
    return parts.join(vocabulary.select("country", "loc"), ["country", "loc"]).groupBy("country", "id").agg(F.array_sort(F.collect_list("loc")).alias("locs"))


def token_idf(clean: DataFrame) -> DataFrame:
    """country, t, df, idf = ln((n + 1) / (df + 1)) over the entities."""
    n = clean.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    df = clean.select("country", F.explode(F.array_distinct("ctoks")).alias("t")).groupBy("country", "t").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(n), "country").select("country", "t", "df", F.log((F.col("n") + 1) / (F.col("df") + 1)).alias("idf"))


def name_frequency(clean: DataFrame) -> DataFrame:
    """country, ckey, n, log_n = ln(1 + n)."""
    return clean.where("ckey <> ''").groupBy("country", "ckey").agg(F.count(F.lit(1)).alias("n")).withColumn("log_n", F.log1p("n"))


def close_words(pairs: list[tuple[str, str]]) -> set[tuple[str, str]]:
    """The pairs of words so alike that one may be a spelling of the other."""
    a, b = [x for x, _ in pairs], [y for _, y in pairs]
    near = (jaro_winklers(a, b) >= 0.85) | (edit_distances(a, b, False) <= np.array([1 if len(x) <= 4 else 2 for x in a]))
    return {pairs[k] for k in np.flatnonzero(near).tolist()}


def noise_words(words: list[str], vocabulary: frozenset[str]) -> set[str]:
    """The words that are in the vocabulary or a spelling of a word in it."""
    pairs = [(w, v) for w in words for v in vocabulary if abs(len(v) - len(w)) <= 2]
    far = edit_distances([w for w, _ in pairs], [v for _, v in pairs], True)
    return {w for w in words if w in vocabulary} | {w for (w, _), d in zip(pairs, far.tolist(), strict=True) if d <= (2 if len(w) >= 8 else 1)}


def novel_counts(known: list[tuple[str, ...]], words: list[tuple[str, ...]], vocabulary: frozenset[str] = frozenset()) -> list[int]:
    """For each pair of lists the words from 3 letters on, not numbers, close to no known word and no spelling of noise."""
    own = [[w for w in ws if len(w) >= 3 and not w.isdigit()] for ws in words]
    near = close_words(list({(w, k) for ws, ks in zip(own, known, strict=True) for w in ws for k in ks}))
    noise = noise_words(list({w for ws in own for w in ws}), vocabulary) if vocabulary else set()
    return [sum(w not in noise and not any((w, k) in near for k in ks) for w in ws) for ws, ks in zip(own, known, strict=True)]


def novelty(pairs: DataFrame, clean1: DataFrame, clean2: DataFrame, vocabulary: frozenset[str] = frozenset()) -> DataFrame:
    """s1, r, nov_r (the record's new words), miss_r (the entity's words that the record lacks)."""
    one, two = clean1.select(F.col("id").alias("s1"), F.col("ctoks").alias("ctoks1")), clean2.select(F.col("id").alias("r"), F.col("ctoks").alias("ctoks2"))
    joined = pairs.select("s1", "r").join(one, "s1").join(two, "r")
    return joined.select("s1", "r", *(c.alias(n) for n, c in novel_columns("ctoks1", "ctoks2", vocabulary).items()))


def novel_columns(words1: str, words2: str, vocabulary: frozenset[str] = frozenset()) -> dict[str, Column]:
    """nov_r and miss_r of novelty() from the words of both sides."""
    return {"nov_r": pair_udf(lambda a, b: novel_counts(a, b, vocabulary), LongType())(words1, words2), "miss_r": pair_udf(novel_counts, LongType())(words2, words1)}


def twin_features(pairs: DataFrame) -> DataFrame:
    """pairs with keys (context.attach_keys) and novelty: group maxima of new words and the twin flag."""

    def grouped(key: str, value: Column) -> Column:
        return F.when(F.col(key).isNotNull(), value)

    by_num, by_addr = Window.partitionBy("s1", "rn1"), Window.partitionBy("s1", "ra")
    df = pairs.withColumns(
        {
            "grp_nov_num": grouped("rn1", F.max("nov_r").over(by_num)),
            "grp_nov_addr": grouped("ra", F.max("nov_r").over(by_addr)),
            "grp_novn_num": grouped("rn1", F.count_if(F.col("nov_r") > 0).over(by_num)),
        }
    )
    return df.withColumn("twin_flag", F.coalesce((F.col("rn1") != F.col("sn1")) & (F.col("grp_nov_num") > 0), F.lit(False)))


def noise_vocabulary(truth: DataFrame, clean1: DataFrame, clean2: DataFrame, least: int = 8) -> DataFrame:
    """word, n: words that true copies add though close to no word of the entity, seen at least so often."""
    one, two = clean1.select(F.col("id").alias("s1"), F.col("ctoks").alias("ctoks1")), clean2.select(F.col("id").alias("r"), F.explode(F.array_distinct("ctoks")).alias("word"))
    joined = truth.join(one, "s1").join(two, "r").where((F.length("word") >= 3) & ~F.col("word").rlike("^[0-9]+$"))
    return joined.where(_alone("word", "ctoks1")).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def v3_features(pairs: DataFrame, clean1: DataFrame, clean2: DataFrame, idf: DataFrame, counts1: DataFrame, counts2: DataFrame, locs1: DataFrame, locs2: DataFrame) -> DataFrame:
    """Name keys, rare words matched or missing, name counts and localities of pairs (country, s1, r)."""
    one = clean1.select(F.col("id").alias("s1"), F.col("ctoks").alias("t1"), F.col("ckey").alias("k1"))
    two = clean2.select(F.col("id").alias("r"), F.col("ctoks").alias("t2"), F.col("ckey").alias("k2"))
    df = pairs.select("country", "s1", "r").join(one, "s1").join(two, "r")
    most = idf.groupBy("country").agg(F.max("idf").alias("most"))

    def covered(side: str, other: str) -> DataFrame:
        words = df.select("country", "s1", "r", F.explode(side).alias("t"), F.slice(other, 1, 10).alias("near"), F.col(other).alias("all"))
        hit = F.array_contains("all", F.col("t")) | _fuzzy("t", "near")
        words = words.withColumn("hit", hit).join(idf.select("country", "t", "idf"), ["country", "t"], "left").join(F.broadcast(most), "country")
        w, n = F.coalesce("idf", "most"), side[-1]
        top = lambda c: F.coalesce(F.max(F.when(c, w)), F.lit(0.0))
        return words.groupBy("s1", "r").agg((F.sum(F.when(F.col("hit"), w).otherwise(0.0)) / F.greatest(F.lit(1e-6), F.sum(w))).alias(f"cn_cov{n}"), top(~F.col("hit")).alias(f"cn_miss_idf{n}"), top(F.col("hit")).alias(f"cn_max_idf_match{n}"))

    both = (F.size("t1") > 0) & (F.size("t2") > 0)
    a, b = F.coalesce("l1", F.array().cast("array<string>")), F.coalesce("l2", F.array().cast("array<string>"))
    out = df.join(covered("t1", "t2"), ["s1", "r"], "left").join(covered("t2", "t1"), ["s1", "r"], "left")
    for n, counts, key in (("n_s1_same1", counts1, "k1"), ("n_s1_same2", counts1, "k2"), ("n_c_same2", counts2, "k2")):
        out = out.join(counts.select("country", F.col("ckey").alias(key), F.col("log_n").alias(n)), ["country", key], "left").fillna(0.0, [n])
    for n, locs, key in (("l1", locs1, "s1"), ("l2", locs2, "r")):
        out = out.join(locs.select(F.col("id").alias(key), F.col("locs").alias(n)), key, "left")
    known = (F.size(a) > 0) & (F.size(b) > 0)
    free1, free2 = _unmatched(a, b), _unmatched(b, a)
    return out.select(
        "country", "s1", "r",
        F.when(both, F.when(F.col("k1") == F.col("k2"), 1.0).otherwise(0.0)).alias("cn_eq"),
        F.when(both, token_set_udf("k1", "k2")).alias("cn_tset"), F.when(both, ratio_udf("k1", "k2")).alias("cn_ratio"), jaccard(F.col("t1"), F.col("t2")).alias("cn_jac"),
        *(F.when(both, F.col(c)).alias(c) for c in ("cn_cov1", "cn_cov2", "cn_miss_idf1", "cn_miss_idf2")), F.when(both, F.col("cn_max_idf_match1")).alias("cn_max_idf_match"),
        F.size(a).alias("loc_n1"), F.size(b).alias("loc_n2"),
        F.when(known, F.size(a) - free1).alias("loc_inter"), F.when(known, free1).alias("loc_unm1"), F.when(known, free2).alias("loc_unm2"), F.when(known, F.when((free1 > 0) & (free2 > 0), 1).otherwise(0)).alias("loc_conflict"),
        "n_s1_same1", "n_s1_same2", "n_c_same2",
    )


def _alone_words(words: list[tuple[str, ...]], known: list[tuple[str, ...]]) -> list[bool]:
    near = close_words(list({(w[0], k) for w, ks in zip(words, known, strict=True) for k in ks}))
    return [not any((w[0], k) in near for k in ks) for w, ks in zip(words, known, strict=True)]


def _alike(a: list[tuple[str, ...]], b: list[tuple[str, ...]], least: float) -> set[tuple[str, str]]:
    pairs = list({(x, y) for p, q in zip(a, b, strict=True) for x in p for y in q})
    like = jaro_winklers([x for x, _ in pairs], [y for _, y in pairs])
    return {pairs[k] for k in np.flatnonzero(like >= least).tolist()}


def _fuzzy_words(words: list[tuple[str, ...]], known: list[tuple[str, ...]]) -> list[bool]:
    like = _alike(words, known, 0.92)
    return [any((w[0], k) in like for k in ks) for w, ks in zip(words, known, strict=True)]


def _unmatched_parts(a: list[tuple[str, ...]], b: list[tuple[str, ...]]) -> list[int]:
    like = _alike(a, b, 0.9)
    return [sum(not any((x, y) in like for y in q) for x in p) for p, q in zip(a, b, strict=True)]


_alone_pairs, _fuzzy_pairs, _unmatched = pair_udf(_alone_words, BooleanType()), pair_udf(_fuzzy_words, BooleanType()), pair_udf(_unmatched_parts, LongType())


def _alone(word: str, known: str) -> Column:
    return _alone_pairs(F.array(word), F.col(known))


def _fuzzy(word: str, known: str) -> Column:
    return _fuzzy_pairs(F.array(word), F.col(known))
