"""The linkage from raw records to matches, with each step a DataFrame operator."""

from __future__ import annotations

from dataclasses import asdict, dataclass
from functools import reduce

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import blocking, context, decode, features, learning, metrics
from ..operators.normalize import normalize
from ..sources.tables import load_model, materialise, read_json, save_model, write_json


@dataclass(frozen=True)
class LinkageConfig:
    """Settings of a run."""

    families: tuple[str, ...] = blocking.FAMILIES
    candidates: int = blocking.CANDIDATES
    p_min: float = 0.02
    tau: float = 0.5
    gate: float = 0.0
    trees: int = 20
    depth: int = 5
    unicode: bool = False

    @property
    def learner(self) -> dict[str, int]:
        return {"trees": self.trees, "depth": self.depth}


#: Thresholds that are tried in validation.
TAUS = (0.5, 0.6, 0.7, 0.8, 0.9)

# The columns that models see.
STAGE1 = ("score", "nk", "cos", "rank", "w_n", "w_s", "w_p", "w_a", "w_h", "w_m", "w_b", "w_c", "ws", "wr")
CONTEXT = ("cos_rel_s1", "cos_gap_s1", "n_cand", "n_s1_for_r", "cos_top1_r", "cos_margin_r", "cos_ratio_r", "cos_rank_r")


def candidates(records1: DataFrame, records2: DataFrame, config: LinkageConfig = LinkageConfig()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Normalised entities and records, and the best candidate pairs."""
    one, two = normalize(records1, config.unicode), normalize(records2, config.unicode)
    return one, two, blocking.top_candidates(blocking.block_pairs(one, two, config.families), config.candidates)


def featured(one: DataFrame, two: DataFrame, blocks: DataFrame) -> tuple[DataFrame, list[str]]:
    """Candidate pairs with similarity, blocking and context features, and the features' names."""
    pairs = features.attach_records(blocks, one, two)
    similar = features.pair_features(pairs)
    rows = context.record_context(blocks, context.record_stats(blocks)).join(similar.drop("country"), ["s1", "r"])
    return rows, [*(c for c in similar.columns if c not in ("country", "s1", "r")), *STAGE1, *CONTEXT]


def second_features(scored: DataFrame, one: DataFrame, two: DataFrame, config: LinkageConfig) -> tuple[DataFrame, list[str]]:
    """Pairs whose p1 reaches p_min, with context of p1, sibling support and anchors, and the names of these features."""
    kept = scored.where(F.col("p1") >= config.p_min)
    made = context.stage2_context(kept)
    made = context.sibling_support(context.attach_keys(made, context.sibling_keys(one), context.sibling_keys(two))).drop("sn1", "rn1", "rk", "ra")
    made = made.join(context.anchor_features(context.anchors(kept, config.p_min), two), ["s1", "r"], "left")
    return made, [c for c in made.columns if c not in scored.columns] + ["p1"]


def link(records1: DataFrame, records2: DataFrame, truth: DataFrame, config: LinkageConfig = LinkageConfig()) -> tuple[DataFrame, DataFrame]:
    """Scored pairs (p1, p2 out of fold) and the matches that decoding accepts, of the records that models are fitted on."""
    one, two, blocks = candidates(records1, records2, config)
    rows, names = featured(one, two, materialise(blocks, "blocks"))
    rows = materialise(learning.label(rows, truth), "pairs")
    scored = materialise(learning.out_of_fold(rows, names, "p1", **config.learner).drop("fold"), "p1")
    second, more = second_features(scored, one, two, config)
    final = learning.cross_fit(materialise(second, "stage2"), [*names, *more], "p2", **config.learner)
    return final, accepted(final, config)


def accepted(scored: DataFrame, config: LinkageConfig) -> DataFrame:
    """The matches among scored pairs (country, s1, r, p2)."""
    return decode.decode(scored.select("country", "s1", "r", F.col("p2").alias("p")), config.tau, config.gate)


@dataclass
class LinkageModel:
    """Fitted models of both stages; those of the first by fold, of which number 0 scores new data."""

    config: LinkageConfig
    first: list[PipelineModel]
    second: PipelineModel
    names: list[str]
    more: list[str]

    def save(self, spark: SparkSession, path: str) -> None:
        """Models and settings in a folder that Spark can write to."""
        for k, model in enumerate([*self.first, self.second]):
            save_model(model, f"{path}/model-{k}")
        settings = {"config": asdict(self.config), "names": self.names, "more": self.more, "folds": len(self.first)}
        write_json(spark, settings, f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> LinkageModel:
        found = read_json(spark, f"{path}/settings")
        config = LinkageConfig(**found["config"] | {"families": tuple(found["config"]["families"])})
        models = [load_model(f"{path}/model-{k}") for k in range(found["folds"] + 1)]
        return LinkageModel(config, models[:-1], models[-1], found["names"], found["more"])

    def first_scores(self, rows: DataFrame, by_fold: bool = False) -> DataFrame:
        """rows with p1 of model 0, or with by_fold of the model that has not seen the entity's fold."""
        if not by_fold:
            return learning.score(self.first[0], rows, self.names, "p1")
        parts = [learning.score(m, rows.where(learning.fold(F.col("s1")) == k), self.names, "p1") for k, m in enumerate(self.first)]
        return reduce(DataFrame.unionByName, parts)

    def second_scores(self, scored: DataFrame, one: DataFrame, two: DataFrame) -> DataFrame:
        """The pairs that pass the first stage, with p2."""
        rows, _ = second_features(scored, one, two, self.config)
        return learning.score(self.second, materialise(rows, "stage2"), [*self.names, *self.more], "p2")


def _first_stage(records1: DataFrame, records2: DataFrame, truth: DataFrame, config: LinkageConfig) -> tuple[LinkageModel, DataFrame]:
    """A model without its second stage, and the labelled rows of that stage with first scores out of fold."""
    one, two, blocks = candidates(records1, records2, config)
    rows, names = featured(one, two, materialise(blocks, "blocks"))
    rows = materialise(learning.label(rows, truth), "pairs")
    number = learning.fold(F.col("s1"))
    first = [learning.fit_trees(rows.where((number != 0) & (number != k)), names, **config.learner) for k in range(learning.FOLDS)]
    model = LinkageModel(config, first, first[0], names, [])
    scored = materialise(model.first_scores(rows, by_fold=True), "p1")
    second, model.more = second_features(scored, one, two, config)
    return model, materialise(second, "stage2")


def _second_stage(model: LinkageModel, rows: DataFrame, truth: DataFrame, orphan_weight: float | None) -> PipelineModel:
    rows, weight = rows.where(learning.fold(F.col("s1")) != 0), {}
    if orphan_weight:
        rows, weight = learning.orphan_weights(rows, truth, orphan_weight), {"weight": "w"}
    return learning.fit_trees(materialise(rows, "stage2-fit"), [*model.names, *model.more], **model.config.learner, **weight)


def fit_linkage(records1: DataFrame, records2: DataFrame, truth: DataFrame, config: LinkageConfig = LinkageConfig(), orphan_weight: float | None = None) -> LinkageModel:
    """Models of both stages; the second sees first scores out of fold, without fold 0, which is left for validation.

    With orphan_weight, pairs of records that nobody owns count so many times in the second stage.
    """
    model, rows = _first_stage(records1, records2, truth, config)
    model.second = _second_stage(model, rows, truth, orphan_weight)
    return model


def link_new(model: LinkageModel, records1: DataFrame, records2: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates, scored pairs (p1, p2) and matches of records that the model has not seen; nothing is fitted."""
    one, two, blocks = candidates(records1, records2, model.config)
    blocks = materialise(blocks, "blocks")
    rows, _ = featured(one, two, blocks)
    scored = materialise(model.first_scores(rows), "p1")
    final = materialise(model.second_scores(scored, one, two), "p2")
    return blocks, final, accepted(final, model.config)


def at_density(model: LinkageModel, records1: DataFrame, records2: DataFrame, truth: DataFrame, percent: int = 19, taus: tuple[float, ...] = TAUS) -> DataFrame:
    """tau, f05 over the validation fold where so many percent of the entities are missing but their records stay.

    The candidates of the entities that are left stay as they are; what depends on competition is computed anew:
    statistics of records, first scores out of fold, second context and anchors, second scores.
    """
    one, two, blocks = candidates(records1, records2, model.config)
    rows, _ = featured(one, two, materialise(learning.thin_entities(blocks, percent), "thin-blocks"))
    scored = materialise(model.first_scores(rows, by_fold=True), "thin-p1")
    final = model.second_scores(scored, one, two).where(learning.fold(F.col("s1")) == 0)
    kept = learning.thin_entities(one.withColumn("s1", F.col("id")), percent).where(learning.fold(F.col("s1")) == 0).select("id", "country")
    own = truth.join(kept.select(F.col("id").alias("s1")), "s1", "left_semi")
    swept = metrics.threshold_sweep(materialise(final.select("country", "s1", "r", F.col("p2").alias("p")), "thin-p2"), own, kept, taus, (0.0,))
    return swept.where("assign").select("tau", "f05")


def orphan_experiment(records1: DataFrame, records2: DataFrame, truth: DataFrame, weights: tuple[float, ...] = (1.0, 5.0, 12.0), config: LinkageConfig = LinkageConfig(), taus: tuple[float, ...] = TAUS) -> DataFrame:
    """weight, tau, plain, test_like: F0.5 over the validation fold with pairs of unowned records weighted in training.

    test_like counts a false match on an unowned record eight times.
    """
    out, (model, rows) = None, _first_stage(records1, records2, truth, config)
    kept = records1.where(learning.fold(F.col("id")) == 0).select("id", "country")
    own = truth.join(kept.select(F.col("id").alias("s1")), "s1", "left_semi")
    held = rows.where(learning.fold(F.col("s1")) == 0)
    for weight in weights:
        second = _second_stage(model, rows, truth, weight if weight != 1 else None)
        scored = learning.score(second, held, [*model.names, *model.more], "p2")
        pairs = materialise(scored.select("country", "s1", "r", F.col("p2").alias("p")), "experiment")
        for tau in taus:
            found = decode.decode(pairs, tau)
            part = metrics.macro_f05(found, own, kept).select(F.lit(weight).alias("weight"), F.lit(tau).alias("tau"), F.col("f05").alias("plain"))
            part = part.join(metrics.weighted_f05(found, truth, kept).select(F.col("f05").alias("test_like")), how="cross")
            out = part if out is None else out.union(part)
    return out
