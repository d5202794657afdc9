"""The linkage engine: kernels, normaliser, blocking, context, decoding, metrics, sources and plans."""

import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.functions import kernels as K
from matchloom.functions.text import bucket, transliterate
from matchloom.operators import blocking, context, decode, dense, learning, metrics, precision, scorers
from matchloom.operators.normalize import normalize
from matchloom.plans.universe import universe
from matchloom.sources import tables
from matchloom.streaming.incremental import link_stream

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def linked(spark):
    entities, records, truth = universe(spark, SMALL)
    one, two = normalize(entities).cache(), normalize(records).cache()
    return one, two, truth, blocking.top_candidates(blocking.block_pairs(one, two)).cache()


def records(spark, *rows):
    return spark.createDataFrame([(str(k), n, a, c) for k, (n, a, c) in enumerate(rows)], "id string, name string, addr string, country string")


def test_kernels():
    assert K.ratio("", "") == 1 and K.ratio("abc", "abc") == 1 and K.ratio("abcd", "bcde") == pytest.approx(0.75)
    assert K.token_sort_ratio("b a", "a b") == 1 and K.token_set_ratio("a b c", "a b") == 1 and K.token_set_ratio("", "a") == 0
    assert K.partial_ratio("abc", "xxabcxx") == 1 and K.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert K.jaro_winkler("", "") == 1 and K.jaro_winkler("", "a") == 0 and K.osa_distance("ca", "abc") == 3 and K.levenshtein("kitten", "sitting") == 3
    assert K.weighted_ratio("new york mets", "new york mets") == 1 and K.weighted_ratio("", "x") == 0 and K.monge_elkan(["ab"], []) is None
    rnd = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 12))) for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert K.lcs_length(a, b) == table[-1][-1]
        for f in (K.ratio, K.token_sort_ratio, K.token_set_ratio, K.weighted_ratio, K.jaro_winkler):
            assert 0 <= f(a, b) <= 1 + 1e-9 and f(a, b) == pytest.approx(f(b, a), abs=0.12 if f is K.jaro_winkler else 1e-9)


def test_batch_kernels_are_the_plain_ones():
    rnd = random.Random(3)
    text = lambda: "".join(rnd.choice("abcde é日 ") for _ in range(rnd.choice([0, 1, 3, 8, 20, 40, 64, 65, 130])))
    a = [text() for _ in range(400)]
    b = [x[: rnd.randint(0, len(x))] + text() if rnd.random() < 0.4 else x if rnd.random() < 0.1 else text() for x in a]
    pairs = (
        (K.ratio, K.ratios), (K.token_sort_ratio, K.token_sort_ratios), (K.token_set_ratio, K.token_set_ratios), (K.partial_ratio, K.partial_ratios), (K.weighted_ratio, K.weighted_ratios),
        (K.jaro_winkler, K.jaro_winklers), (K.osa_distance, lambda x, y: K.edit_distances(x, y, True)), (K.levenshtein, lambda x, y: K.edit_distances(x, y, False)),
    )
    for plain, batch in pairs:
        assert batch(a, b) == pytest.approx([plain(x, y) for x, y in zip(a, b, strict=True)]), plain.__name__
        assert len(batch([], [])) == 0
    x, y = [tuple(t.split()) for t in a], [tuple(t.split()) for t in b]
    assert K.monge_elkans(x, y) == pytest.approx([K.monge_elkan(p, q) for p, q in zip(x, y, strict=True)])
    assert K.over_pairs(K.ratios, ["ab", None, "ab"], ["ab", "x", None]) == [1.0, None, None]


# Golden values of the usual definitions, worked out by hand: indel ratios of the shown alignments.
GOLDEN = (
    (K.ratio, "this is a test", "this is a test!", 28 / 29), (K.token_sort_ratio, "fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear", 1.0), (K.token_set_ratio, "fuzzy was a bear", "fuzzy fuzzy was a bear", 1.0),
    (K.partial_ratio, "this is a test", "this is a test!", 1.0), (K.weighted_ratio, "this is a test", "test a is this", 0.95), (K.jaro_winkler, "dwayne", "duane", 0.84), (K.jaro_winkler, "dixon", "dicksonx", 0.8133333),
    (K.osa_distance, "ab", "ba", 1), (K.osa_distance, "ca", "abc", 3), (K.levenshtein, "ab", "ba", 2),
)


def test_golden_kernels():
    for kernel, a, b, want in GOLDEN:
        assert kernel(a, b) == pytest.approx(want, abs=1e-6), (kernel.__name__, a, b)


def test_normaliser(spark):
    rows = records(spark, ("M/s. Café Phönix Pvt Ltd", "007 Main St., New York", "US"), ("www.green-hill.co.in", "N/A", "India"), ("The Co", None, "France"), (None, "12 r de la Paix cc", "France"), ("L.L.C.", "5 West Virginia New York Rd", "US"))
    made = {r["id"]: r for r in normalize(rows).collect()}
    assert made["0"]["name_norm"] == "cafe phonix" and made["0"]["name_toks"] == ["kafe", "foniks"] and made["0"]["addr_toks"] == ["7", "main", "street", "ny"] and made["0"]["name_skel"] == ["kf", "fnks"]
    assert made["1"]["is_domain"] and made["1"]["name_norm"] == "green hill" and made["1"]["addr_missing"]
    assert made["2"]["name_norm"] == "the co" and made["3"]["name_core"] == "" and made["3"]["addr_toks"] == ["12", "rue", "de", "la", "paix", "centre"]
    assert made["4"]["addr_toks"] == ["5", "wv", "ny", "road"]
    again = {r["id"]: r["addr_norm"] for r in normalize(rows, unicode=True).collect()}
    assert again == {k: r["addr_norm"] for k, r in made.items()}
    spelled = spark.createDataFrame([("राम",), ("Москва",), ("plain",)], "x string").select(transliterate(F.col("x"))).collect()
    assert all(r[0].isascii() for r in spelled) and spelled[2][0] == "plain"


def test_blocking(spark, linked):
    one, two, truth, blocks = linked
    assert blocks.agg(F.max("rank")).first()[0] <= 100
    recall = {r["k"]: r["recall"] for r in blocking.recall_at(blocks, truth).collect()}
    assert recall[100] >= recall[5] > 0.9
    assert blocks.where("cos > 1.000001 or cos <= 0").count() == 0
    plan = blocking.top_candidates(blocking.block_pairs(one, two), 5)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "WindowGroupLimit" in plan
    hot = records(spark, *[("same name", "1 x", "US")] * 60)
    assert blocking.block_pairs(normalize(hot), normalize(hot)).count() == 0  # every key is over its cap


def test_candidates_in_blocks_are_those_of_the_pairs(spark, linked, monkeypatch):
    from matchloom import queries
    from matchloom.operators import candidates

    one, two, _, blocks = linked
    odd = normalize(records(spark, ("odd name", "1 first street", None), ("alone here", "2 second street", "Peru")))
    names = sorted(blocks.columns)
    rows = lambda df: sorted(tuple(round(x, 7) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())
    want = rows(blocks)
    assert rows(candidates.best_candidates(one.union(odd), two, detail=True)) == want
    for name, n in (("ENTITY_BLOCK", 30), ("RECORD_BLOCK", 50), ("POSTINGS", 200), ("PACKED", 500)):
        monkeypatch.setattr(candidates, name, n)
    made = candidates.best_candidates(one.union(odd), two, own=("name_sq",), other=("addr_nums",), detail=True)
    assert rows(made) == want and made.join(one, (made["s1"] == one["id"]) & (made["name_sq_a"] != one["name_sq"])).count() == 0
    assert candidates.best_candidates(odd, odd.where("country is null")).count() == 0 and candidates.best_candidates(one.limit(0), two).count() == 0
    monkeypatch.undo()
    # features are made where the pairs are: no pair is shuffled or joined
    plan = queries.QUERIES["levenshtein_sim"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "s1#" not in "".join(x for x in plan.split("\n") if "Exchange" in x)


def test_rows_travel_packed(spark, linked):
    import pyarrow as pa

    from matchloom import queries
    from matchloom.operators import candidates

    rows = pa.table({"number": pa.array([1, 2, 3]), "id": ["a", None, ""], "b_words": pa.array([["x", None], [], None], pa.list_(pa.string()))})
    assert candidates._unpack_rows(candidates._pack_rows(rows)).equals(rows) and candidates._unpack_rows(candidates._pack_rows(rows.slice(0, 0))).num_rows == 0
    # a row that goes to several blocks is packed once, not exploded
    plan = queries.QUERIES["pair_features"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
    # sums don't depend on how rows are dealt: not a bit of a cosine does
    one, two, _, _ = linked
    cosines = [{(r["s1"], r["r"]): r["cos"] for r in candidates.best_candidates(a, b).collect()} for a, b in ((one, two), (one.repartition(3), two.repartition(5, F.reverse("id"))))]
    assert cosines[0] == cosines[1]


def test_statistics_of_a_record_leave_the_task_without_pairs(spark, linked, monkeypatch):
    from matchloom import queries
    from matchloom.operators import candidates

    one, two, _, blocks = linked
    rows = lambda df: sorted((r["r"], r["n_s1_for_r"], *(round(r[f"t{k}"], 7) for k in (1, 2, 3))) for r in df.collect())
    want = rows(context.record_stats(blocks))
    for size in (("ENTITY_BLOCK", 30), ("POSTINGS", 200), ("RECORD_BLOCK", 50)):
        monkeypatch.setattr(candidates, *size)
        assert rows(candidates.record_stats(one, two)) == want
    monkeypatch.undo()
    assert candidates.record_stats(one.limit(0), two).count() == 0
    plan = queries.QUERIES["record_top3"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(r" not in plan and "s1#" not in plan


def test_only_best_pairs_of_a_record_leave_a_task(spark):
    odd = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.9), ("c", "x", 0.7), ("d", None, 0.6), ("e", "y", None), ("f", "y", 0.5), ("g", "z", 0.4)], "s1 string, r string, p double")
    made = decode.one_owner(odd, 0.5)
    assert {r["s1"] for r in made.collect()} == {"a", "b", "d", "f"}
    assert "WindowGroupLimit" in made._jdf.queryExecution().executedPlan().toString()


def test_context(spark):
    pairs = spark.createDataFrame([("a", "x", 0.9), ("a", "y", 0.5), ("b", "x", 0.7), ("c", "z", 0.01)], "s1 string, r string, p1 double")
    made = {(r["s1"], r["r"]): r for r in context.stage2_context(pairs).collect()}
    assert made["a", "x"]["p_2nd_s1"] == 0.5 and made["b", "x"]["p_2nd_s1"] == 0 and made["b", "x"]["p_margin_r"] == pytest.approx(-0.2) and made["a", "x"]["p_margin_r"] == pytest.approx(0.2)
    side = {(r["s1"], r["r"]): r for r in context.record_competition(pairs).collect()}
    assert side["a", "x"]["r_other"] == 0.7 and side["b", "x"]["r_other"] == 0.9 and side["c", "z"]["r_n"] == 0
    found = context.anchors(pairs, high=0.6).collect()
    assert {(r["s1"], r["r"], r["ra"]) for r in found} == {("a", "y", "x")}


def together(spark, monkeypatch):
    """Scored candidates that lie together, with all that the functions of entitywise read, in batches smaller than an entity."""
    from matchloom import queries
    from matchloom.operators import entitywise

    monkeypatch.setattr(entitywise, "ROWS", 40)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    more = context.key_columns() | {"ctoks": precision.clean_words()}
    read = ("num", "nkey", "akey", "ctoks", "name_sq", "name_core", "addr_norm", "addr_missing", "addr_nums")
    one, two, _ = queries.normal(spark, SMALL)
    found = queries.best_candidates(one.withColumns(more), two.withColumns(more), own=("num", "ctoks"), other=read)
    pairs = found.select("*", *queries.scores()).withColumnsRenamed({"num_a": "sn1", "num_b": "rn1", "nkey_b": "rk", "akey_b": "ra"}).withColumn("cos", F.round("cos", 9))
    return entitywise, tables.materialise(pairs, "together"), two


def same(made, want, by=("s1", "r")):
    columns = sorted(c for c in made.columns if c not in by)
    rows = lambda df: {tuple(r[c] for c in by): [round(r[c], 7) + 0.0 if isinstance(r[c], float) else r[c] for c in columns] for r in df.collect()}
    got = rows(made)
    assert got and got == rows(want)
    kinds = dict(want.dtypes)
    assert all(kind == kinds[c] for c, kind in made.dtypes)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_entitywise_is_what_windows_give(spark, monkeypatch):
    try:
        entitywise, pairs, two = together(spark, monkeypatch)
        same(entitywise.sibling_support(pairs), context.sibling_support(pairs))
        same(entitywise.stage3_context(pairs), context.stage3_context(pairs))
        novel = pairs.withColumns(precision.novel_columns("ctoks_a", "ctoks_b"))
        same(entitywise.twin_features(novel), precision.twin_features(novel))
        names = ("anc_name_max", "anc_name_jw_max", "anc_addr_max", "anc_num_eq")
        same(entitywise.anchor_features(pairs, names), context.anchor_features(context.anchors(pairs), two))
        stats, scored = context.record_stats(pairs), context.score_stats(pairs)
        same(entitywise.record_context(tables.materialise(pairs.join(stats, "r").sort("s1"), "sorted")), context.record_context(pairs, stats))
        same(entitywise.stage2_context(tables.materialise(pairs.join(scored, "r").sort("s1"), "sorted")), context.stage2_context(pairs))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_v3_features_where_pairs_are_made(spark, linked, monkeypatch):
    from matchloom import queries
    from matchloom.operators import v3

    long = "beta alpha gamma delta epsilon zeta eta theta iota kappa lamda omikron"
    odd = [("trading trading norh wind", "1 a st, Texas, Texas", "US"), ("north wind", "2 b st, texass", "US"), (long, "Delhi", "India"), (f"{long}n x", "", "India"), (None, None, "US"), ("12 34", "Lyon", None), ("alone", "Delhi", "Peru")]
    extra = normalize(records(spark, *odd, *[("north wind", "3 c st, Texas, Florida", "US")] * 5))
    one, two, _, _ = linked
    one, two = one.union(extra), two.union(extra.withColumn("id", F.concat(F.lit("Z"), "id")))
    c1, c2 = precision.cleaned(one), precision.cleaned(two)
    vocabulary = precision.locality_vocabulary(c1)
    pairs = queries.best_candidates(one, two)
    want = precision.v3_features(pairs, c1, c2, precision.token_idf(c1), precision.name_frequency(c1), precision.name_frequency(c2), precision.localities(c1, vocabulary), precision.localities(c2, vocabulary))
    monkeypatch.setattr(v3, "PACKED", 300)
    made = v3.v3_features(one, two)
    assert made.columns == want.columns and dict(made.dtypes) == dict(want.dtypes)
    rows = lambda df: sorted(([round(x, 7) if isinstance(x, float) else x for x in r] for r in df.collect()), key=lambda x: x[:3])
    got = rows(made)
    assert got == rows(want) and any(r[1].isdigit() for r in got)
    # neither pairs nor their words are shuffled or joined
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "s1#" not in "".join(x for x in plan.split("\n") if "Exchange" in x)


def test_best_values_of_a_record_in_one_pass(spark, monkeypatch):
    monkeypatch.setattr(context, "MERGED", 3)
    rows = [("x", 0.5), ("x", 0.9), ("x", None), ("x", 0.9), ("x", 0.1), ("y", None), (None, 0.3), ("z", -1.0)]
    pairs = spark.createDataFrame(rows, "r string, p double").repartition(3)
    made = context.best_values(pairs, "p", 2, "t", n=F.lit(1), high=(F.col("p") > 0.4).cast("int"))
    assert {tuple(r) for r in made.collect()} == {("x", 5, 3, 0.9, 0.9), ("y", 1, 0, 0.0, 0.0), (None, 1, 0, 0.3, 0.0), ("z", 1, 0, -1.0, 0.0)}
    assert "Join" not in made._jdf.queryExecution().executedPlan().toString() and context.best_values(pairs.limit(0), "p", 2, "t").count() == 0


def test_sweep_shuffles_no_pair_for_a_setting(spark):
    pairs = spark.createDataFrame([("a", "x", 0.9, True), ("b", "x", 0.9, False), ("a", "y", 0.4, True), ("c", "z", 0.6, False), ("c", "x", 0.8, False)], "s1 string, r string, p double, y boolean")
    truth, entities = spark.createDataFrame([("a", "x"), ("a", "y"), ("d", "q")], "s1 string, r string"), spark.createDataFrame([(x,) for x in "abcde"], "id string")
    made = metrics.threshold_sweep(pairs, truth, entities, (0.3, 0.7), (0.0, 0.8))
    grid = {(r["assign"], r["tau"], r["gate"]): r["f05"] for r in made.collect()}
    for (assign, tau, gate), f05 in grid.items():
        assert f05 == pytest.approx(metrics.macro_f05(decode.decode(pairs, tau, gate, assign), truth, entities).first()["f05"])
    assert len(grid) == 8 and "WindowGroupLimit" in made._jdf.queryExecution().executedPlan().toString()


def test_faults_are_counted_on_accepted_pairs(spark):
    from matchloom import queries

    plan = queries.QUERIES["result_check"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan  # no fault finds the candidates anew


def test_record_competition_takes_one_shuffle(spark):
    odd = spark.createDataFrame([("a", "x", 0.9), ("b", "x", 0.7), ("c", "x", 0.01), ("d", "x", None), ("e", "y", 0.01)], "s1 string, r string, p1 double")
    made = {r["s1"]: (r["r_n"], r["r_rank"], r["r_sum"], r["r_other"], r["r_n_any"]) for r in context.record_competition(odd).collect()}
    assert made == {"a": (2, 1, 1.6, 0.7, 2), "b": (2, 2, 1.6, 0.9, 2), "c": (0, 0, 0, 0, 2), "d": (0, 0, 0, 0, 2), "e": (0, 0, 0, 0, 0)}
    plan = context.record_competition(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_decode(spark):
    pairs = spark.createDataFrame([("US", "a", "x", 0.9), ("US", "b", "x", 0.9), ("US", "a", "y", 0.4), ("FR", "c", "z", 0.6), ("FR", "c", "x", 0.8)], "country string, s1 string, r string, p double")
    ids = lambda df: {(r["s1"], r["r"]) for r in df.collect()}
    assert ids(decode.decode(pairs, 0.5)) == {("a", "x"), ("b", "x"), ("c", "z")} and ids(decode.one_owner(pairs, 0.5, strict=True)) == {("a", "x"), ("c", "z")}
    # the gate looks at what owners leave
    assert ids(decode.decode(pairs, 0.5, 0.7)) == {("a", "x"), ("b", "x")} and ids(decode.decode(pairs, 0.5, 0.7, assign=False)) == {("a", "x"), ("b", "x"), ("c", "z"), ("c", "x")}
    assert ids(decode.decode_by_country(pairs, {"FR": (0.5, 0.0)})) == {("c", "z"), ("c", "x")} and ids(decode.decode_by_country(pairs, {"FR": (0.7, 0.0)}, (0.3, 0.0))) == {("a", "x"), ("b", "x"), ("a", "y")}
    entities = spark.createDataFrame([("a", "US"), ("d", "US")], "id string, country string")
    assert {tuple(r) for r in decode.result_lists(pairs, entities).collect()} == {("a", "x,y"), ("d", "")}


def test_metrics(spark, linked):
    one, _, truth, blocks = linked
    assert metrics.macro_f05(truth, truth, one).first()["f05"] == 1
    pairs = blocks.select("country", "s1", "r", (bucket(F.concat("s1", "r"), "p", 100) / 100.0).alias("p"))
    grid = {(r["assign"], r["tau"], r["gate"]): r["f05"] for r in metrics.threshold_sweep(pairs, truth, one, (0.3, 0.7), (0.0, 0.8)).collect()}
    for assign, tau, gate in ((True, 0.3, 0.0), (False, 0.7, 0.8)):
        assert grid[assign, tau, gate] == pytest.approx(metrics.macro_f05(decode.decode(pairs, tau, gate, assign), truth, one).first()["f05"])
    found = decode.decode(pairs, 0.5)
    assert metrics.list_f05(decode.result_lists(found, one), decode.result_lists(truth, one)).first()["f05"] == pytest.approx(metrics.macro_f05(found, truth, one).first()["f05"])
    ranked = spark.createDataFrame([("US", 0.9, 1), ("US", 0.8, 0), ("US", 0.7, 1)], "country string, p double, y int")
    assert metrics.average_precision(ranked).first()["ap"] == pytest.approx((1 + 2 / 3) / 2)


def test_dense(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(str(k), x.tolist()) for k, x in enumerate(v)], "id string, vector array<double>").repartition(3)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cos = unit @ unit.T
    for block in (7, 100):
        made = dense.top_k_cosine(rows, rows, 4, block).collect()
        assert len(made) == 240 and all(abs(r["dn_sim"] - cos[int(r["s1"]), int(r["r"])]) < 1e-8 for r in made)
        best = {(r["s1"], r["dn_rank"]): r["r"] for r in made}
        assert all(best[str(k), i + 1] == str(np.argsort(-cos[k])[i]) for k in range(60) for i in range(4))
    values = spark.createDataFrame([(float(k),) for k in range(100)], "x double")
    assert dense.nearest_quantile(values, "x", 0.03).first()["value"] == 3 and dense.nearest_quantile(values.limit(0), "x", 0.03).count() == 0


def test_precision():
    assert precision.novel_counts([("north", "wind"), ("north",), ()], [("north", "wind", "trading"), ("nort", "12", "ab"), ("new",)]) == [1, 0, 1]
    assert precision.novel_counts([("north",)], [("trading",)], frozenset({"tradin"})) == [0]


def test_learning(spark, linked):
    _, _, truth, blocks = linked
    rows = learning.label(blocks.where("rank <= 5"), truth).cache()
    made = learning.out_of_fold(rows, ["cos", "nk", "score"], trees=3, depth=3)
    assert made.count() == rows.count() and made.select("fold").distinct().count() == 5
    mean = {r["y"]: r["m"] for r in made.groupBy("y").agg(F.avg("p1").alias("m")).collect()}
    assert mean[1] > mean[0] + 0.2
    assert learning.thin_entities(rows).select("s1").distinct().count() < rows.select("s1").distinct().count()


def test_scorers(spark, linked):
    one, two, truth, _ = linked
    scored = scorers.score_pairs(truth, scorers.record_text(one), scorers.record_text(two))
    assert scored.count() == truth.count() and 0 <= scored.agg(F.min("ce")).first()[0] <= 1
    assert scorers.embed_texts(scorers.record_text(two)).count() == two.count()


def test_sources(spark, tmp_path):
    rows = records(spark, ('a "quoted" name', "", "US"), ("ünï", "1 x, y", "FR"))
    path = f"file://{tmp_path}"
    tables.write_tsv(rows.toDF("entity_id", "business_name", "business_address", "country"), f"{path}/tsv")
    assert {tuple(r) for r in tables.read_records(spark, f"{path}/tsv").collect()} == {tuple(r) for r in rows.collect()}
    tables.write_tsv(spark.createDataFrame([("a", "x,y"), ("b", "")], "source1_entity_id string, matched_entity_ids string"), f"{path}/truth")
    assert {tuple(r) for r in tables.read_truth(spark, f"{path}/truth").collect()} == {("a", "x"), ("a", "y")}
    tables.write_json(spark, {"US": {"tau": 0.5}}, f"{path}/json")
    assert tables.read_json(spark, f"{path}/json") == {"US": {"tau": 0.5}}
    tables.write_words(spark.createDataFrame([("b",), ("a",)], "word string"), f"{path}/words")
    assert sorted(r["word"] for r in tables.read_words(spark, f"{path}/words").collect()) == ["a", "b"]
    tables.write_by_country(rows, f"{path}/parts")
    assert os.path.isdir(f"{tmp_path}/parts/country=US")
    built = []
    for _ in range(2):
        assert tables.stage(spark, f"{path}/stage", lambda: built.append(1) or rows).count() == 2
    assert len(built) == 1


def test_stream(spark, tmp_path, linked):
    entities, recs, _ = universe(spark, SMALL)
    recs.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(recs.schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    link_stream(stream, entities, f"{tmp_path}/out", f"{tmp_path}/cp", k=3).awaitTermination(120)
    found = spark.read.parquet(f"{tmp_path}/out")
    assert found.select("batch").distinct().count() == 2 and found.count() > 0


def test_entry(spark):
    import __spark_entry__

    names, sql = set(__spark_entry__.queries()), set(__spark_entry__.oracle_sql())
    assert sql <= names and json.dumps(sorted(names))
    assert __spark_entry__.entry(spark).columns == ["country", "s1", "r", "nk", "score", "cos", "rank"]


def test_linkage_end_to_end(spark):
    from matchloom.plans.linkage import LinkageConfig, link

    entities, recs, truth = universe(spark, SMALL)
    scored, matches = link(entities, recs, truth, LinkageConfig(candidates=20, trees=2))
    assert {"p1", "p2"} <= set(scored.columns)
    assert metrics.macro_f05(matches, truth, entities).first()["f05"] > 0.9


def test_saved_models_score_new_records(spark, tmp_path):
    from matchloom.plans.linkage import LinkageConfig, LinkageModel, at_density, fit_linkage, link_new, orphan_experiment
    from matchloom.queries import two_worlds

    world, new = two_worlds(spark, SMALL)
    config = LinkageConfig(candidates=20, trees=2, depth=3)
    model = fit_linkage(*world, config)
    model.save(spark, f"file://{tmp_path}/model")
    again = LinkageModel.load(spark, f"file://{tmp_path}/model")
    assert (again.config, again.names, again.more, len(again.first)) == (config, model.names, model.more, 5)
    results = [link_new(m, *new[:2]) for m in (model, again)]
    assert [sorted(map(tuple, r[2].select("s1", "r").collect())) for r in results][0] == sorted(map(tuple, results[1][2].select("s1", "r").collect()))
    assert metrics.macro_f05(results[1][2], new[2], new[0]).first()["f05"] > 0.85
    assert decode.unlisted(results[1][2], results[1][0]).count() == 0
    assert {r["tau"] for r in at_density(model, *world, taus=(0.5, 0.7)).where("f05 between 0.3 and 1").collect()} == {0.5, 0.7}
    rows = orphan_experiment(*world, weights=(1.0, 5.0), config=config, taus=(0.5,)).collect()
    assert {r["weight"] for r in rows} == {1.0, 5.0} and all(0 <= r["test_like"] <= r["plain"] + 1e-9 <= 1.1 for r in rows)


def test_running_sums_and_package(spark, tmp_path):
    import zipfile

    from matchloom.operators.running import running_sums

    rows = spark.createDataFrame([("a" if k % 3 else "b", k, k % 7) for k in range(200)], "g string, k long, n long").repartition(5)
    made = {(r["g"], r["k"]): r["s"] for r in running_sums(rows, ["g"], F.desc("k"), {"s": "n"}).collect()}
    assert all(made[g, k] == sum(j % 7 for j in range(k, 200) if (j % 3 > 0) == (k % 3 > 0)) for g, k in made) and len(made) == 200
    assert running_sums(rows.limit(0), ["g"], F.col("k"), {"s": "n"}).count() == 0
    tables.write_tsv(rows.select(F.col("g").alias("a")), f"file://{tmp_path}/part")
    tables.write_package({"result.tsv": f"file://{tmp_path}/part"}, f"{tmp_path}/all.zip")
    with zipfile.ZipFile(f"{tmp_path}/all.zip") as z:
        lines = z.read("result.tsv").decode().split()
    assert lines[0] == "a" and len(lines) == 201


def test_result_faults(spark):
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    lists = frame([("a", "x,x,q"), ("a", "y"), ("z", "")], "s1 string, matched string")
    made = decode.result_faults(lists, frame([("a", "x")], "s1 string, r string"), frame([("a",), ("b",)], "id string"), frame([("x",), ("y",)], "id string"))
    assert {r["fault"]: r["n"] for r in made.collect()} == {"entity missing": 1, "entity unknown": 1, "entity repeated": 1, "record unknown": 1, "record repeated": 1, "match no candidate": 2}


def odd_texts(rnd, n):
    word = lambda: "".join(rnd.choice("abcde12é" if rnd.random() < 0.03 else "abcde12") for _ in range(rnd.choice([1, 2, 3, 6])))
    return [" ".join(word() for _ in range(rnd.choice([0, 1, 2, 3, 5, 9, 25]))) for _ in range(n)]


def test_paired_kernels_are_the_plain_ones():
    import pyarrow as pa

    from matchloom.functions import paired

    rnd = random.Random(5)
    texts = odd_texts(rnd, 300)
    texts += [" ".join([*rnd.sample(x.split(), rnd.randint(0, len(x.split()))), *y.split()[:2]]) for x, y in zip(texts, texts[::-1], strict=True)]
    i, j = (np.array([rnd.randrange(len(texts)) for _ in range(3000)]) for _ in "ij")
    words = paired.Words(pa.array(texts))
    one, sets = paired.Texts(pa.array(texts)), paired.Sets(words, words.lists[0])
    assert one.odd.any() and not one.odd.all()
    partial, lcs = paired.partials(one, one, i, j)
    ratio, shared = paired.token_set_ratios(sets, sets, i, j)
    made = (
        (K.lcs_length, paired.lcs_lengths(one, one, i, j)), (K.lcs_length, lcs), (K.partial_ratio, partial), (K.jaro_winkler, paired.jaro_winklers(one, one, i, j)), (K.token_set_ratio, ratio),
        (K.token_sort_ratio, paired.token_sort_ratios(sets, sets, i, j)), (lambda a, b: len({*a.split()} & {*b.split()}), shared),
    )
    for plain, values in made:
        assert values.tolist() == [plain(texts[a], texts[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert not len(paired.lcs_lengths(one, one, i[:0], j[:0]))


def odd_records(spark):
    rnd = random.Random(6)
    names, addresses = odd_texts(rnd, 60), [x.replace("a", "alley") for x in odd_texts(rnd, 60)]
    every = normalize(records(spark, *[(n or None, a, "US") for n, a in zip(names, addresses, strict=True)])).cache()
    return every, every.withColumn("id", F.concat(F.lit("r"), "id"))


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=lambda r: r[:3])


@pytest.mark.parametrize("most", [1_500_000, 20])
def test_pair_features_are_made_where_pairs_are_ranked(spark, monkeypatch, most):
    from matchloom.operators import candidates, features, pairwise

    monkeypatch.setattr(candidates, "RECORD_BLOCK", most)
    one, two = odd_records(spark)
    kinds = ", ".join(f"{c} double" for c in pairwise.PAIR_FEATURES)
    made = candidates.best_candidates(one, two, own=pairwise.READ, other=pairwise.READ, make=(pairwise.pair_features, kinds)).drop("cos", "rank")
    want = features.pair_features(candidates.best_candidates(one, two, own=features.RECORD, other=features.RECORD))
    assert made.columns == want.columns and rows_of(made) == rows_of(want)
    assert "ArrowEvalPython" not in made._jdf.queryExecution().toString()  # no text leaves the task for a kernel


def test_anchors_need_two_texts_of_a_record(spark):
    from matchloom.operators import entitywise

    rnd = random.Random(8)
    names, addresses = odd_texts(rnd, 12), odd_texts(rnd, 12)
    p = [0.95, 0.93, 0.91, 0.9, *[0.5] * 7, 0.01]
    pairs = spark.createDataFrame([("e", f"{k:02}", p[k], names[k], addresses[k]) for k in range(12)], "s1 string, r string, p1 double, name_sq_b string, addr_norm_b string").coalesce(1)
    made = entitywise.anchor_features(pairs, ("anc_name_max", "anc_name_jw_max", "anc_addr_max")).collect()
    assert len(made) == 11
    most = lambda values: max(values, default=None)
    for row in made:
        k = int(row["r"])
        own = [a for a in range(3) if a != k]
        assert row["anc_n"] == len(own) and row["anc_name_max"] == most(K.token_set_ratio(names[k], names[a]) for a in own)
        assert row["anc_name_jw_max"] == most(K.jaro_winkler(names[k].replace(" ", ""), names[a].replace(" ", "")) for a in own)
        assert row["anc_addr_max"] == most(K.token_set_ratio(addresses[k], addresses[a]) for a in own if addresses[k] and addresses[a])


@pytest.mark.parametrize("most", [1_500_000, 20])
def test_extra_features_are_made_where_pairs_are_ranked(spark, monkeypatch, most):
    from matchloom.operators import candidates, features, pairwise

    monkeypatch.setattr(candidates, "RECORD_BLOCK", most)
    one, two = odd_records(spark)
    kinds = ", ".join(f"{c} double" for c in pairwise.EXTRA_FEATURES)
    made = candidates.best_candidates(one, two, own=pairwise.EXTRA_READ, other=pairwise.EXTRA_READ, make=(pairwise.extra_features, kinds)).drop("cos", "rank")
    want = features.extra_features(candidates.best_candidates(one, two, own=features.RECORD, other=features.RECORD))
    six = lambda frame: rows_of(frame.select("country", "s1", "r", *(F.round(c, 9) for c in pairwise.EXTRA_FEATURES)))
    assert made.columns == want.columns and six(made) == six(want)
    assert "ArrowEvalPython" not in made._jdf.queryExecution().toString()
