"""The corpus pipeline on a small folder of tables."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    item = [word() for _ in range(20)]
    rows, labels = [], []
    for k in range(400):
        text = [word() for _ in range(60)]
        if k % 5 == 0:
            text[7] = text[21] = text[40] = "scumbag"
        rows.append((k, " ".join(text), "en", f"s{k % 3}", 0))
        labels.append((k, k % 2, int(k % 5 == 0)))
    rows += [(500, rows[1][1], "en", "s1", 0), (501, " ".join(item + [word() for _ in range(30)]), "en", "s2", 0), (502, "write to a.b@example.com " + rows[2][1][::-1], "en", "s0", 0), (503, None, None, None, None)]
    for name, data, schema in (("documents", rows, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"), ("benchmark", [(1, " ".join(item))], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns, name
    clean = {k for k in range(400) if k % 5} | {502, 503}
    assert seen == [clean | {500, 501}, clean | {501}, clean, clean, clean]
    redacted = spark.read.parquet(f"{tmp_path}/out3").where("doc_id = 502").first()["text"]
    assert redacted.startswith("write to <EMAIL> ")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == clean


def test_empty_tables_and_odd_rows(spark, tmp_path):
    """Empty documents, labels and benchmark; nulls everywhere; repeated ids; a further column with an inner name."""
    odd = [(None, None, None, None, None, "x"), (1, None, "en", None, None, None), (2, "", None, "a", 0, "y"), (3, "some plain words", "en", "a", 16, "z"), (3, "some plain words", "en", "a", 16, "z"), (None, "null id here", "en", "b", 12, "q")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string"
    for k, rows in enumerate(([], odd)):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, folder)
            assert made.columns == docs.columns, name
            docs = made
        # null and empty texts are alike: the least id stays; a null id counts after all others
        kept = sorted(((r["doc_id"], r["text"]) for r in docs.collect()), key=str)
        assert kept == sorted([(1, None), (3, "some plain words"), (None, "null id here")] if rows else [], key=str)
        taken = corpus_pipeline.run(spark, folder).collect()
        assert len(taken) == len(kept) and all(r["size"] > 0 or r["taken"] == 0 for r in taken)
