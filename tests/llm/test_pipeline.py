"""The pipeline's stages on the small tables: each decision takes effect, clean documents stay."""

import random

import corpus_pipeline
from pyspark.sql import functions as F

from codeterra.llm import decontaminate
from tests.conftest import frame

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.limit(1).select(F.lit(None).cast("long").alias("doc_id"), F.lit("secret = abcdef123 end").alias("text"), "lang", "source", "n_chars")
    docs = docs.unionByName(extra).withColumn("spans", F.lit("own"))
    before = docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, docs, SF)
        made.write.parquet(f"{tmp_path}/{k}")
        made = spark.read.parquet(f"{tmp_path}/{k}")
        if name == "packing":
            assert made.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m")).where("n <> m").count() == 0
            assert made.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            continue
        assert made.columns == docs.columns and before * 0.5 < made.count() <= docs.count()
        if name == "toxicity":
            toxic = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").select("doc_id")
            gone = docs.where("doc_id is not null").join(made.select("doc_id"), "doc_id", "left_anti")
            caught = gone.join(toxic, "doc_id", "left_semi").count()
            assert gone.count() - caught <= 0.1 * before
        if name == "winnowing":
            hit = decontaminate.flagged(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).where("n_hit > 0").select("doc_id")
            assert made.join(hit, "doc_id", "left_semi").count() == 0 and docs.count() - made.count() == hit.count() > 0
        if name == "jaccard_join":
            assert made.select("text").distinct().count() == made.count()
        if name == "secret_scan":
            assert made.count() == docs.count() and made.where("doc_id is null").first()["text"] == "[secret] end"
        docs = made


def test_planted_documents(spark, tmp_path):
    """A toxic and a contaminated document, a near copy and a secret, among plain documents, each meet their stage; nulls and empties pass."""
    rng = random.Random(4)
    plain = "river stone wide calm field bridge water house green hill road light".split()
    text = lambda n, more=(): " ".join(rng.choices(plain, k=n) + rng.choices(more, k=n // 3) if more else rng.choices(plain, k=n))
    data = [(k, text(60), "en", "a", 1) for k in range(300)] + [(k, text(45, ["vile", "awful"]), "en", "b", 1) for k in range(300, 360)]
    passage = " ".join(f"q{k}" for k in range(14))
    data += [(400, f"{text(30)} {passage}", "en", "a", 1), (401, data[0][1] + " end", "en", "a", 1), (402, text(40) + " password = hunter2secret", "en", "a", 1), (403, None, None, None, None), (404, "", "en", "a", 0)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    frame(spark, data, schema).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(k, int(300 <= k < 360)) for k in range(0, 360, 2)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame(spark, [("i", passage)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r["doc_id"] for r in docs.select("doc_id").distinct().collect()})
        if name == "secret_scan":
            assert docs.where("doc_id = 402").first()["text"].endswith(" [secret]")
    everything = {d for d, *_ in data}
    assert len(everything - kept[0]) >= 54 and everything - kept[0] <= set(range(300, 360))
    assert kept[0] - kept[1] == {401} and kept[1] - kept[2] == {400} and kept[2] == kept[3] == kept[4]
    whole = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct()
    assert {r["doc_id"] for r in whole.collect()} == kept[4]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame(spark, [], schema), str(tmp_path)).count() == 0
