"""The pipeline's stages, each against a brute-force version of its decision."""

import random

import corpus_pipeline as cp
from pyspark.sql import functions as F

from .data import words
from .test_text_operators import brute_components, brute_lines, shingle_set


def corpus():
    rnd = random.Random(9)
    items = [(i, " ".join(words(rnd, 20))) for i in range(3)]
    docs, labels = [], []
    base = [" ".join(words(rnd, 50)) for _ in range(4)]
    lines = "\n".join(" ".join(words(rnd, 6)) for _ in range(6))
    for i in range(160):
        good = i % 4 > 0
        t = " ".join(words(rnd, rnd.randint(8, 40)))
        t = t if good else " ".join(w.upper() + "!!" for w in t.split())
        if good and i % 13 == 0:
            t = base[i % 4] + (" tail" if i % 2 else "")
        if good and i % 17 == 0:
            t = t + " " + items[i % 3][1]
        if good and i % 19 == 0:
            t = lines + "\n" + t if i % 2 else lines
        docs.append((i, t, "en", "s", len(t)))
        labels.append((i, int(good), 0))
    docs += [docs[5], (200, None, None, None, None), (201, "", None, None, 0), (202, "Short.", "en", "s", 6)]
    return docs, labels, items


def test_stages(spark, tmp_path):
    docs, labels, items = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(cp.STAGES)
    assert list(stages) == ["quality", "line_dedup", "ngram_jaccard", "decontaminate", "packing"]

    def step(name, df):
        out = stages[name](spark, df, folder)
        out.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    first = step("quality", now)
    assert first.columns == now.columns
    kept = {r["doc_id"] for r in first.collect()}
    assert {i for i, q, _ in labels if q} <= kept and sum(not q and i in kept for i, q, _ in labels) <= 2
    second = step("line_dedup", first)
    want = brute_lines([(r["doc_id"], r["text"]) for r in first.collect()])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in second.collect()}
    for r in first.collect():
        left = want.get((r["doc_id"], r["text"]))
        if left == r["text"] or left is None:
            assert got[r["doc_id"]][0] == r["text"]
        elif left == "" and r["doc_id"] not in got:
            pass
        else:
            assert got[r["doc_id"]] == (left, len(left))
    third = step("ngram_jaccard", second)
    rows = sorted(second.collect(), key=lambda r: r["doc_id"])
    comp = brute_components([r["text"] for r in rows])
    stay = {rows[i]["doc_id"] for i, (_, c) in enumerate(comp) if rows[c]["doc_id"] == rows[i]["doc_id"]}
    assert sorted(r["doc_id"] for r in third.collect()) == sorted(stay)
    fourth = step("decontaminate", third)
    clean = {r["doc_id"] for r in third.collect() if not any(len(shingle_set(t) & shingle_set(r["text"])) >= 0.75 * len(shingle_set(t)) for _, t in items)}
    assert {r["doc_id"] for r in fourth.collect()} == clean and clean < {r["doc_id"] for r in third.collect()}
    last = step("packing", fourth)
    assert {r["doc_id"] for r in last.collect()} == clean
    fill = last.groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert fill.where("n > 4096").isEmpty()
    assert cp.run(spark, folder).count() == last.count()


def test_other_columns_pass_through(spark, tmp_path):
    docs, labels, items = corpus()
    folder = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    names = ["score", "predicted", "k", "k_id", "n", "n_removed", "spans", "_th", "_r", "rec", "u", "_row", "d_id", "k_own", "_spans", "th"]
    rows = [(*d[:2], *[f"{d[0]}:{c}" for c in names]) for d in docs]
    df = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *[f"`{c}` string" for c in names]]))
    for name, stage in cp.STAGES[:4]:
        out = stage(spark, df, folder)
        assert out.columns == df.columns, name
        got = out.collect()
        assert got and all(r[c] == f"{r['doc_id']}:{c}" for r in got for c in names), name


def test_stages_on_empty_tables(spark, tmp_path):
    folder = str(tmp_path)
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for _, stage in cp.STAGES:
        assert stage(spark, docs, folder).count() == 0
