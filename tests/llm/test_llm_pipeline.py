import pytest

import corpus_pipeline
from corpusloom.llm import storage

SOURCE = {"en": "the of and with this that from house water stone", "de": "der die und mit nicht das schön über straße wald"}


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    import random

    rng = random.Random(8)
    root = tmp_path_factory.mktemp("sf")
    rows = []
    for i in range(60):
        lang = list(SOURCE)[i % 2]
        lines = [" ".join(rng.choice(SOURCE[lang].split()) + str(rng.randint(0, 300)) for _ in range(30)) for _ in range(3)]
        rows.append((i, "\n".join(lines), lang, "s", 0))
    item = "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11 q12 q13 q14 q15"
    rows.append((100, rows[0][1], "en", "s", 0))  # an exact copy
    rows.append((101, "the water and the house " + item, "en", "s", 0))  # a leak
    rows.append((102, "12345 67890", "en", "s", 0))  # no language
    rows.append((103, None, "en", "s", 0))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_stages(spark, sf_dir):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "minhash_near_dedup", "decontamination", "sentencepiece"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = storage.materialize(stage(spark, docs, sf_dir), name)
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if name != names[-1]:
            assert docs.columns == columns
    clean = set(range(60))
    assert all(clean <= s for s in seen)
    assert seen[0] == clean | {100, 101} and seen[1] == clean | {101} and seen[3] == clean
    assert docs.where("not lossless").count() == 0


def test_run_equals_the_stages_and_survives_empty_tables(spark, sf_dir, tmp_path):
    assert corpus_pipeline.run(spark, sf_dir).count() == 60
    empty = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline_with_odd_rows(spark, sf_dir, tmp_path):
    """Repeated rows, null ids and columns named like what stages add."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("*").where("doc_id < 12")
    extra = spark.createDataFrame([(None, "the water of the house with stone", "en", "s", 0), (None, None, None, None, None), (3, "", "en", None, None)], docs.schema)
    from pyspark.sql import functions as F

    odd = docs.unionByName(docs.where("doc_id < 3")).unionByName(extra).withColumn("ids", F.lit("own")).withColumn("row", F.lit(1)).withColumn("lang_pred", F.lit("x")).withColumn("removed", F.lit(2)).withColumn("matches", F.lit(3))
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.run(spark, str(tmp_path))
    assert kept.columns == [c for c in odd.columns if c != "ids"] + ["ids", "n_tokens", "ids_crc32", "lossless"]
    rows = kept.collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted([str(i) for i in range(12)] + ["None"])
    assert all(r["lossless"] and r["row"] == 1 and r["removed"] == 2 for r in rows)
