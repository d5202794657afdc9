"""From scored pairs (s1, r, p) to results: thresholds, owners, gates, rescue, merging and lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def one_owner(pairs: DataFrame, tau: float | Column = 0.5, strict: bool = False) -> DataFrame:
    """Pairs from tau on that are the best of their record; equal ones all stay unless strict."""
    kept = pairs.where(F.col("p") >= tau)
    if strict:
        return kept.withColumn("_k", F.row_number().over(Window.partitionBy("r").orderBy(F.desc("p"), "s1"))).where("_k = 1").drop("_k")
    # a rank has a limit that is applied before the shuffle: of a task's pairs only the best of each record leave it
    return kept.withColumn("_k", F.rank().over(Window.partitionBy("r").orderBy(F.desc("p")))).where("_k = 1").drop("_k")


def gate_entities(pairs: DataFrame, gate: float | Column) -> DataFrame:
    """Pairs of entities whose best pair reaches gate."""
    return pairs.withColumn("_m", F.max("p").over(Window.partitionBy("s1"))).where(F.col("_m") >= gate).drop("_m")


def decode(pairs: DataFrame, tau: float | Column, gate: float | Column = 0.0, assign: bool = True, strict: bool = False) -> DataFrame:
    """Threshold, then one owner for each record (assign), then the gate on what is left of each entity."""
    kept = one_owner(pairs, tau, strict) if assign else pairs.where(F.col("p") >= tau)
    return gate_entities(kept, gate)


def decode_by_country(pairs: DataFrame, spec: dict[str, tuple[float, float]], default: tuple[float, float] | None = None) -> DataFrame:
    """decode() with thresholds (tau, gate) by country; countries without one take default or are left out."""
    entry = lambda i: F.coalesce(F.create_map(*(F.lit(x) for k, v in spec.items() for x in (k, v[i])))[F.col("country")], F.lit(default[i] if default else None).cast("double"))
    return decode(pairs.where(entry(0).isNotNull()), entry(0), entry(1))


def rescue(pairs: DataFrame, tau: float, least: float = 0.3) -> DataFrame:
    """Pairs from tau on, and those from least on whose names (name_a, name_b) are equal and not empty."""
    return pairs.where((F.col("p") >= tau) | (F.col("p") >= least) & (F.col("name_a") == F.col("name_b")) & (F.col("name_a") != ""))


def hybrid(results: dict[str, DataFrame], entities: DataFrame, choice: dict[str, str], default: str) -> DataFrame:
    """Pairs of the result that is chosen for their entity's country; entities has id and country."""
    out = None
    for name, result in results.items():
        own = [c for c, x in choice.items() if x == name]
        chosen = F.col("country").isin(own) if own else F.lit(False)
        if name == default:
            chosen = chosen | ~F.col("country").isin(list(choice))
        part = result.join(entities.where(chosen).select(F.col("id").alias("s1")), "s1", "left_semi")
        out = part if out is None else out.unionByName(part)
    return out


def drop_twins(accepted: DataFrame, flagged: DataFrame | None = None) -> DataFrame:
    """Accepted pairs but those that flagged (s1, r, twin_flag), or their own twin_flag, marks."""
    if flagged is None:
        return accepted.where("not twin_flag").drop("twin_flag")
    return accepted.join(flagged.where("twin_flag").select("s1", "r"), ["s1", "r"], "left_anti")


def result_lists(pairs: DataFrame, entities: DataFrame) -> DataFrame:
    """s1, matched: sorted records of every entity (id), joined by commas; empty where there are none."""
    lists = pairs.select("s1", "r").distinct().groupBy("s1").agg(F.array_join(F.array_sort(F.collect_list("r")), ",").alias("matched"))
    return entities.select(F.col("id").alias("s1")).join(lists, "s1", "left").withColumn("matched", F.coalesce("matched", F.lit("")))


def candidate_lists(blocked: DataFrame, dense: DataFrame, entities: DataFrame) -> DataFrame:
    """s1, matched: all candidates of every entity from both searches, each once."""
    return result_lists(blocked.select("s1", "r").union(dense.select("s1", "r")), entities)


def unlisted(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches that aren't among the candidates; there should be none."""
    return matches.select("s1", "r").join(candidates.select("s1", "r"), ["s1", "r"], "left_anti")


def result_faults(lists: DataFrame, candidates: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """fault, n: what is wrong with result lists (s1, matched): counts of every kind of fault, 0 where there is none.

    Entities that are missing, unknown or repeated, records that are unknown or repeated in a list, and matches that
    aren't among the candidates.
    """
    ids = lists.select("s1", F.explode(F.split("matched", ",")).alias("r")).where("r <> ''")
    known, owned = entities.select(F.col("id").alias("s1")), records.select(F.col("id").alias("r"))
    counts = {
        "entity missing": known.join(lists, "s1", "left_anti").agg(F.count(F.lit(1))),
        "entity unknown": lists.join(known, "s1", "left_anti").agg(F.count(F.lit(1))),
        "entity repeated": lists.agg(F.count(F.lit(1)) - F.count_distinct("s1")),
        "record unknown": ids.join(owned, "r", "left_anti").agg(F.count(F.lit(1))),
        "record repeated": ids.groupBy("s1", "r").agg((F.count(F.lit(1)) - 1).alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0))),
        "match no candidate": unlisted(ids, candidates).agg(F.count(F.lit(1))),
    }
    out = None
    for fault, count in counts.items():
        part = count.toDF("n").select(F.lit(fault).alias("fault"), F.col("n").cast("long").alias("n"))
        out = part if out is None else out.union(part)
    return out
