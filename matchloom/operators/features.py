"""Similarity features of pairs of normalised records. Missing values are null, never NaN."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.text import containment, grams, jaccard

RECORD = ("name_norm", "name_sq", "name_core", "name_toks", "name_skel", "is_domain", "addr_norm", "addr_toks", "addr_missing", "addr_nums", "addr_alpha")


def attach_records(pairs: DataFrame, records1: DataFrame, records2: DataFrame) -> DataFrame:
    """pairs (s1, r, ...) with the derived columns of both sides, ending in _a and _b."""
    one = records1.select(F.col("id").alias("s1"), *(F.col(c).alias(f"{c}_a") for c in RECORD))
    two = records2.select(F.col("id").alias("r"), *(F.col(c).alias(f"{c}_b") for c in RECORD))
    return pairs.join(one, "s1").join(two, "r")


def _ab(name: str) -> tuple[Column, Column]:
    return F.col(f"{name}_a"), F.col(f"{name}_b")


def _flag(condition: Column) -> Column:
    return F.when(condition, 1.0).otherwise(0.0)


def _first(words: Column, at: int = 1) -> Column:
    return F.try_element_at(words, F.lit(at))


def _ends(numbers: Column, n: int) -> Column:
    return F.transform(numbers, lambda x: F.right(x, F.lit(n)))


def set_features() -> dict[str, Column]:
    """Features by sets, lengths and equality; Catalyst alone."""
    core, toks, skel, alpha, nums, words = (_ab(c) for c in ("name_core", "name_toks", "name_skel", "addr_alpha", "addr_nums", "addr_toks"))
    missing = F.col("addr_missing_a") | F.col("addr_missing_b")
    both = lambda pair: (F.size(pair[0]) > 0) & (F.size(pair[1]) > 0)
    known = lambda value: F.when(~missing, value)
    threes = tuple(_ends(F.filter(x, lambda t: F.length(t) >= 3), 3) for x in nums)
    fours = tuple(_ends(x, 4) for x in nums)
    count = lambda a, b: F.size(F.array_intersect(a, b)).cast("double")
    return {
        "nm_core_eq": _flag((core[0] == core[1]) & (core[0] != "")),
        "nm_tok_jac": jaccard(*toks),
        "nm_tok_contain": containment(*toks),
        "nm_skel_jac": jaccard(*skel),
        "len_a": F.length(core[0]).cast("double"),
        "len_b": F.length(core[1]).cast("double"),
        "ntok_a": F.size(toks[0]).cast("double"),
        "ntok_b": F.size(toks[1]).cast("double"),
        "len_ratio": F.least(*map(F.length, core)) / F.greatest(*map(F.length, core), F.lit(1)),
        "dom_a": F.col("is_domain_a").cast("double"),
        "dom_b": F.col("is_domain_b").cast("double"),
        "first_tok_eq": _flag(F.coalesce(_first(toks[0]) == _first(toks[1]), F.lit(False))),
        "prefix4_eq": _flag((F.substring(core[0], 1, 4) == F.substring(core[1], 1, 4)) & (core[0] != "")),
        "ad_alpha_jac": known(jaccard(*alpha)),
        "ad_alpha_inter": known(count(*alpha)),
        "ad_alpha_contain": known(containment(*alpha)),
        "ad_num_jac": known(jaccard(*nums)),
        "ad_num_first_eq": known(F.when(both(nums), _flag(_first(nums[0]) == _first(nums[1])))),
        "ad_num_t4": known(F.when(both(nums), _flag(F.arrays_overlap(*fours)))),
        "ad_num_t3": known(F.when(both(threes), _flag(F.arrays_overlap(*threes)))),
        "ad_num_inter": known(count(*nums)),
        "ad_last_eq": known(_flag(F.coalesce(_first(words[0], -1) == _first(words[1], -1), F.lit(False)))),
        "ad_miss_b": F.col("addr_missing_b").cast("double"),
        "ad_ntok_b": F.size(words[1]).cast("double"),
        "ad_ntok_a": F.size(words[0]).cast("double"),
    }


#: Kernel features: batch kernel, and the places of its arguments among the texts that kernel_struct() sends.
KERNELS = {
    "nm_ratio": (K.ratios, 0, 1), "nm_tsort": (K.token_sort_ratios, 0, 1), "nm_tset": (K.token_set_ratios, 0, 1), "nm_partial": (K.partial_ratios, 2, 3),
    "nm_jw": (K.jaro_winklers, 4, 5), "nm_core_ratio": (K.ratios, 4, 5), "nm_skel_ratio": (K.ratios, 6, 7), "nm_wr": (K.weighted_ratios, 0, 1),
    "ad_tset": (K.token_set_ratios, 8, 9), "ad_tsort": (K.token_sort_ratios, 8, 9), "ad_ratio": (K.ratios, 8, 9), "ad_partial": (K.partial_ratios, 8, 9),
}
MORE_KERNELS = {
    "me_ab": (K.monge_elkans, 0, 1), "me_ba": (K.monge_elkans, 1, 0), "skel_me": (K.monge_elkans, 2, 3), "ad_me_ab": (K.monge_elkans, 4, 5), "ad_me_ba": (K.monge_elkans, 5, 4),
    "ad_jw": (K.jaro_winklers, 6, 7), "ad_alpha_ratio": (K.ratios, 8, 9),
}
_kernels, _more_kernels = K.struct_udf(KERNELS), K.struct_udf(MORE_KERNELS)


def kernel_struct() -> Column:
    """All features by string kernels as one struct: one Arrow function, so texts go to Python once."""
    sq, core, addr = _ab("name_sq"), _ab("name_core"), _ab("addr_norm")
    missing = F.col("addr_missing_a") | F.col("addr_missing_b")
    return _kernels(*sq, *(F.when(x != "", x) for x in core), *core, *(F.array_join(x, "") for x in _ab("name_skel")), *(F.when(~missing, x) for x in addr))


def pair_features(pairs: DataFrame) -> DataFrame:
    """The 37 similarity features of pairs with attached records."""
    return pairs.withColumn("_k", kernel_struct()).select("country", "s1", "r", *(c.alias(n) for n, c in set_features().items()), *(F.col(f"_k.{n}") for n in KERNELS))


def extra_features(pairs: DataFrame) -> DataFrame:
    """17 further features: n-grams, fuzzy word coverage, number endings."""
    core, toks, skel, alpha, nums, words = (_ab(c) for c in ("name_core", "name_toks", "name_skel", "addr_alpha", "addr_nums", "addr_toks"))
    missing = F.col("addr_missing_a") | F.col("addr_missing_b")
    known = lambda value: F.when(~missing, value)
    full = tuple(F.filter(x, lambda t: t != "") for x in skel)
    sides = F.when((F.size(toks[0]) > 0) & (F.size(toks[1]) > 0), True)
    starts = F.transform(toks[1], lambda t: F.substring(t, 1, 3))
    numbers = (F.size(nums[0]) > 0) & (F.size(nums[1]) > 0)

    def crossed(f) -> Column:
        return F.flatten(F.transform(nums[0], lambda x: F.transform(nums[1], lambda y: f(x, y))))

    alike = crossed(lambda x, y: 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y)))
    ends = crossed(lambda x, y: (F.length(x) >= 3) & (F.length(y) >= 3) & (F.endswith(x, y) | F.endswith(y, x)))
    alphas = (F.when((F.size(alpha[0]) > 0) & (F.size(alpha[1]) > 0), F.array_join(F.array_sort(x), " ")) for x in alpha)
    pairs = pairs.withColumn("_k", _more_kernels(*toks, *full, *alpha, *_ab("addr_norm"), *alphas))
    me = {n: F.col(f"_k.{n}") for n in MORE_KERNELS}
    columns = {
        "tri_jac": jaccard(*(grams(x, 3) for x in core)),
        "bi_jac": jaccard(*(grams(x, 2) for x in core)),
        "me_ab": me["me_ab"],
        "me_ba": me["me_ba"],
        "me_min": F.least(me["me_ab"], me["me_ba"]),
        "skel_me": me["skel_me"],
        "pre3_cover": F.when(sides, F.size(F.filter(toks[0], lambda t: F.array_contains(starts, F.substring(t, 1, 3)))) / F.size(toks[0])),
        "len_diff": F.abs(F.length(core[0]) - F.length(core[1])).cast("double"),
        "skel_first_eq": _flag(F.coalesce(_first(skel[0]) == _first(skel[1]), F.lit(False))),
        "ad_me_ab": known(me["ad_me_ab"]),
        "ad_me_ba": known(me["ad_me_ba"]),
        "ad_me_min": known(F.least(me["ad_me_ab"], me["ad_me_ba"])),
        "ad_num_sim": known(F.when(numbers, F.array_max(alike))),
        "ad_num_suffix": known(F.when(numbers, F.exists(ends, lambda x: x).cast("double"))),
        "ad_common": known(F.size(F.array_intersect(*words)) / F.greatest(F.lit(1), F.least(*(F.size(F.array_distinct(x)) for x in words)))),
        "ad_jw": known(me["ad_jw"]),
        "ad_alpha_ratio": known(me["ad_alpha_ratio"]),
    }
    return pairs.select("country", "s1", "r", *(c.alias(n) for n, c in columns.items()))
