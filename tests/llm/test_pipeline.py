"""The pipeline's stages on their own inputs, and as a whole."""

import random

from pyspark.sql import functions as F

import corpus_pipeline as C


def test_pipeline(spark, tmp_path):
    r = random.Random(3)
    text = lambda n: " ".join(f"w{r.randrange(5000)}" for _ in range(n))
    passage = text(60)
    docs = [(i, text(80) + " " + (passage if i % 9 == 0 else "") + " " + text(30), "en", "ab"[i % 2], 0) for i in range(120)]
    docs += [(200 + i, docs[i][1] + " end", "en", "a", 0) for i in range(10)] + [(300 + i, text(50) + " you stinkeroo " + text(9), "en", "b", 0) for i in range(40)] + [(400, None, None, None, None), (401, "", "en", "a", 0), (None, "no id", "en", "a", 0)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows.withColumn("_copies", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d[0], int(d[0] is not None and 300 <= d[0] < 340)) for d in docs], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, at = spark.read.parquet(str(tmp_path / "documents.parquet")), str(tmp_path)
    kept = C.drop_toxic(spark, d, at)
    assert {x["doc_id"] for x in kept.collect()} == {x[0] for x in docs if x[0] is None or not 300 <= x[0] < 340} and tuple(kept.columns) == C.COLUMNS
    kept.write.parquet(str(tmp_path / "1"))
    one = C.drop_near_duplicates(spark, spark.read.parquet(str(tmp_path / "1")), at)
    assert {x["doc_id"] for x in one.collect()} == {*range(120), 400, 401, None} and tuple(one.columns) == C.COLUMNS
    one.write.parquet(str(tmp_path / "2"))
    cut = C.cut_repeats(spark, spark.read.parquet(str(tmp_path / "2")), at)
    got = {x["doc_id"]: x["text"] for x in cut.collect()}
    assert len(got) == 123 and not any(passage in t for t in got.values()) and got[1] == docs[1][1]
    out = C.run(spark, at)
    assert out.where("not round_trip").count() == 0 and out.count() > 100 and {*C.COLUMNS} < {*out.columns}


def test_pipeline_of_repeated_ids_and_empty_tables(spark, tmp_path):
    r = random.Random(4)
    docs = [(i % 20, " ".join(f"w{r.randrange(5000)}" for _ in range(60)), None, [None, "a"][i % 2], 0) for i in range(60)] * 2
    rows = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    rows.repartition(4).write.parquet(str(tmp_path / "a/documents.parquet"))
    rows.limit(0).write.parquet(str(tmp_path / "b/documents.parquet"))
    for k in "ab":
        spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / k / "labels.parquet"))
    d, at = spark.read.parquet(str(tmp_path / "a/documents.parquet")), str(tmp_path / "a")
    assert C.drop_toxic(spark, d, at).count() == 120
    one = C.drop_near_duplicates(spark, d, at)
    assert sorted(map(tuple, one.collect()), key=str) == sorted(set(docs), key=str)  # ids repeat, texts don't
    once = spark.createDataFrame(one.collect(), rows.schema)
    mixed = [sorted(map(tuple, C.mix_sources(spark, x, at).collect()), key=str) for x in (once, once.repartition(7))]
    assert mixed[0] == mixed[1] and set(mixed[0]) <= set(docs) and 70 <= len(mixed[0]) <= 100
    assert C.run(spark, str(tmp_path / "b")).count() == 0
