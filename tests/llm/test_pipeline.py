"""Stages of the pipeline on planted documents; entry point with and without this subpackage."""

import random

import corpus_pipeline
from chronofeat.llm import queries
from tests.llm.helpers import edited, text


def test_stages(spark, tmp_path):
    rng = random.Random(21)
    clean = [text(rng, 150) for _ in range(60)]
    item = text(rng, 40)
    made = [(i, t) for i, t in enumerate(clean)]
    made += [(100, clean[0]), (101, edited(rng, clean[1], 0.01)), (102, text(rng, 20) + " " + item + " " + text(rng, 20)), (103, clean[5] + " different password=abcdef0123456789 tail"), (104, None), (105, ""), (None, text(rng, 50)), (107, text(rng, 150) + " different password=abcdef0123456789 tail")]
    made += [(200 + i, text(rng, 30) + " vileword nastyterm vileword " + text(rng, 30) + " hatespew") for i in range(40)]
    labels = [(i, 1, 0) for i in range(60)] + [(200 + i, 0, 1) for i in range(40)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in made], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        seen[name] = {r["doc_id"] for r in docs.collect()}
        if name == "secrets":
            held = {r["doc_id"]: r for r in docs.collect()}
    assert seen["toxicity"] == {i for i, _ in made if i is None or i < 200}
    assert seen["toxicity"] - seen["jaccard"] == {100, 101, 103}  # 103 shares 0.98 of its shingles with 5
    assert seen["jaccard"] - seen["decontamination"] == {102}
    assert seen["secrets"] == seen["decontamination"] == seen["packing"]
    assert corpus_pipeline.MARK in held[107]["text"] and "abcdef0123456789" not in held[107]["text"] and held[107]["n_chars"] == len(held[107]["text"])
    assert all(held[i]["text"] == clean[i] for i in range(60)) and held[104]["text"] is None
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in whole.collect()} == seen["packing"]


def test_stages_judge_rows_with_null_and_repeated_ids(spark, tmp_path):
    rng = random.Random(22)
    clean = [text(rng, 150) for _ in range(60)]
    vile = lambda: text(rng, 30) + " vileword nastyterm vileword " + text(rng, 30) + " hatespew"
    item, alone, twin = text(rng, 40), text(rng, 90), text(rng, 90)
    leak = text(rng, 20) + " " + item + " " + text(rng, 20)
    toxic, spare = vile(), [text(rng, 80) for _ in range(4)]
    labelled = [(i, t) for i, t in enumerate(clean)] + [(200 + i, vile()) for i in range(40)]
    odd = [(None, spare[0]), (None, toxic), (None, leak), (None, edited(rng, clean[1], 0.01)), (None, alone), (None, alone)]
    odd += [(70, spare[1]), (70, toxic), (71, spare[2]), (71, leak), (72, spare[3]), (72, clean[2]), (73, twin), (73, twin), (None, twin), (None, None), (None, "")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in labelled + odd], schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(200 + i, 0, 1) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    order = lambda x: sorted(x, key=repr)
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        seen[name] = order((r["doc_id"], r["text"]) for r in docs.collect())
    left = labelled[:60] + [x for x in odd if x[1] != toxic]
    assert seen["toxicity"] == order(left)
    left = [x for x in left if x not in (odd[3], (72, clean[2])) and x[1] not in (alone, twin, leak)] + [(None, alone), (73, twin), (71, leak)]
    assert seen["jaccard"] == order(left)
    assert seen["decontamination"] == order(x for x in left if x[1] != leak)


def test_stages_carry_clashing_names_and_stand_empty_tables_and_long_texts(spark, tmp_path):
    rng = random.Random(23)
    clean, item = [text(rng, 60) for _ in range(12)], text(rng, 40)
    long = text(rng, 60_000)
    given = [(i, t) for i, t in enumerate(clean)] + [(50, long), (51, long + " tail"), (52, None), (52, None), (53, ""), (54, text(rng, 9) + " token=abcdef0123456789 end"), (55, long[:5000] + " " + item)]
    names = ["_th", "spans", "row", "_row", "unit", "mask", "family", "rank", "kind", "token", "_rejected", "held_out", "toxic", "k", "h", "s"]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)
    d = spark.createDataFrame([(i, t, None, "s", None, *names) for i, t in given], schema)
    spark.createDataFrame([(i, 1, i % 2) for i in range(12)], "doc_id long, quality int, toxic int").filter("doc_id < 0").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    docs, none = spark.read.parquet(f"{tmp_path}/documents.parquet"), d.filter("doc_id < -1")
    for name, stage in corpus_pipeline.STAGES:
        out, nothing = stage(spark, docs, str(tmp_path)), stage(spark, none, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}.parquet")
        docs = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        assert nothing.columns == out.columns and nothing.count() == 0
        if name != "packing":
            assert out.columns == d.columns
            assert all(r[n] == n for r in docs.collect() for n in names)
    kept = sorted(r["doc_id"] for r in docs.filter("piece = 0").collect())
    assert kept == [*range(12), 50, 52, 52, 53, 54]


def test_registered():
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(queries.oracle_sql()) <= set(names)
