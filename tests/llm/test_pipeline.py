import random

import corpus_pipeline

rng = random.Random(11)
WORDS = [f"w{k}" for k in range(400)]


def text(n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def fixture(root, spark):
    """Documents with what each stage must drop; returns the ids that must stay."""
    rows = {k: text(20) + (" vile" if k % 4 == 0 else "") for k in range(200)}
    keep = {k for k in rows if k % 4}
    passage = text(15)
    base = text(80).split()
    for k in (300, 301, 302):  # near copies: one stays
        copy = list(base)
        copy[k - 300] = f"x{k}"
        rows[k] = " ".join(copy)
    rows[310] = rows[1]  # an exact copy
    rows[320] = f"{text(5)} {passage} {text(5)}"
    rows |= {330: None, 331: "", 332: " \n"}
    keep |= {300}
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return keep


def test_pipeline_drops_what_was_planted_and_keeps_the_rest(spark, tmp_path):
    keep = fixture(f"file://{tmp_path}", spark)
    got = {r.doc_id for r in corpus_pipeline.run(spark, f"file://{tmp_path}").select("doc_id").distinct().collect()}
    assert got == keep


def test_stages_keep_the_columns(spark, tmp_path):
    fixture(f"file://{tmp_path}", spark)
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"file://{tmp_path}").columns == docs.columns
