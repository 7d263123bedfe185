"""Stages of the corpus pipeline on a small table with a case for each."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_keep_clean_documents_and_drop_the_rest(spark, tmp_path):
    rng = random.Random(3)
    syll = {"p": ["ba", "bo", "mu", "la"], "q": ["zi", "xe", "ty", "ro"]}
    text = lambda lang, n: " ".join("".join(rng.choice(syll[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))
    rows, toxic = [], {}
    for k in range(200):
        ws = text("pq"[k % 2], 60).split()
        toxic[k] = int(k % 5 == 0)
        if toxic[k]:
            for w in ("vermin", "vile", "vermin"):
                ws.insert(rng.randrange(len(ws)), w)
        rows.append((k, " ".join(ws), "pq"[k % 2], "s", None))
    item = text("p", 20)
    near = rows[1][1].split()
    near[5] = "lala"
    rows += [(500, rows[1][1], "q", "s", 1), (501, " ".join(near), "q", "s", 1), (502, rows[2][1] + " " + item, "p", None, 1), (503, "12 34", None, None, None), (504, None, None, None, None), (None, text("p", 50), None, None, None), (2, rows[2][1], "p", "s", None)]
    folder = str(tmp_path)
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"tox_score": F.lit("own"), "items": F.lit(1)})
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(k, 1, t) for k, t in toxic.items()], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    held, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, held, folder)
        out.write.parquet(f"{folder}/{name}")
        held = spark.read.parquet(f"{folder}/{name}")
        kept[name] = sorted(((r["doc_id"]) for r in held.select("doc_id").collect()), key=str)
        if name != "packing":
            assert held.columns == docs.columns and {r[0] for r in held.select("tox_score").distinct().collect()} == {"own"}
    clean = [k for k in range(200) if not toxic[k]]
    assert kept["toxicity"] == sorted([*clean, 2, 500, 501, 502, 503, 504, None], key=str)
    assert kept["language"] == sorted([*clean, 2, 500, 501, 502, None], key=str)
    assert kept["near_copies"] == sorted([*clean, 502, None], key=str)
    assert kept["decontamination"] == sorted([*clean, None], key=str)
    assert kept["packing"] == kept["decontamination"]
    assert sorted((r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()), key=str) == kept["packing"]


def test_stages_of_an_empty_table(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([], SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
