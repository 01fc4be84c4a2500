"""The pipeline's stages over a small table with planted cases."""

import random

from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(5)
    word = lambda: "".join(r.choice("aeioustnrl") for _ in range(r.randint(2, 8)))
    clean = [" ".join(word() for _ in range(r.randint(30, 120))) for _ in range(120)]
    rude = [t + " grobian lout grobian" for t in (" ".join(word() for _ in range(40)) for _ in range(40))]
    texts = clean + rude + [clean[3], clean[3], clean[4] + " x", None, ""]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(120 <= i < 160)) for i in range(160)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(cp.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append({x.doc_id for x in docs.collect()})
    tox, exact, near, mix, last = seen
    assert not tox & set(range(120, 160)) and len(tox & set(range(120))) >= 118
    assert {3, 160} & exact == set() and 161 in exact
    assert 4 in near and len(near) >= 110 and mix <= near and last == mix
    final = cp.run(spark, str(tmp_path))
    assert final.count() == docs.count() and final.agg(F.min("n_tokens")).first()[0] > 0


def test_empty_and_repeated_rows_and_more_columns(spark, tmp_path):
    import corpus_pipeline as cp

    kind = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, size string"
    rows = [(i, f"some words of text number {i} that goes on" if i % 7 else None, "en", None if i % 5 == 0 else "s", 1, "a", "b", "c") for i in range(30)]
    for name, own in (("full", [*rows, rows[1], rows[1]]), ("empty", [])):
        spark.createDataFrame(own, kind).coalesce(1).write.parquet(str(tmp_path / name / "documents.parquet"))
        spark.createDataFrame([], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(str(tmp_path / name / "labels.parquet"))
    assert cp.run(spark, str(tmp_path / "empty")).count() == 0
    out = cp.run(spark, str(tmp_path / "full"))
    ids = {r.doc_id for r in out.collect()}
    assert ids and ids <= {i for i in range(30) if i % 7}
    docs = spark.read.parquet(str(tmp_path / "full" / "documents.parquet"))
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path / "full"))
        assert docs.columns == [c.split()[0] for c in kind.split(", ")]
