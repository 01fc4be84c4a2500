"""The near-duplicate stage finds links by SimHash, too."""

import random


def test_links_by_fingerprints_are_found_and_checked(spark, tmp_path, monkeypatch):
    import corpus_pipeline as cp
    from copse.llm import near_copies, simhash

    r = random.Random(3)
    word = lambda: "".join(r.choice("aeioustnrl") for _ in range(r.randint(2, 8)))
    base = [word() for _ in range(3000)]
    near = [*base[:-1], "changed"]
    texts = [" ".join(t) for t in (base, near, [word() for _ in range(3000)])]
    fps = [simhash.fingerprint(t.encode(), near_copies.SHINGLE) for t in texts]
    assert bin((fps[0] ^ fps[1]) & (1 << 64) - 1).count("1") <= near_copies.DISTANCE
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    assert near_copies.simhash_links(docs, "doc_id", "text", near_copies.SHINGLE, near_copies.SIMILARITY).count() == 1
    used = []
    monkeypatch.setattr(near_copies.simhash, "links", lambda *a, f=simhash.links, **k: used.append(1) or f(*a, **k))
    assert {x.doc_id for x in cp.without_near_copies(spark, docs, str(tmp_path)).collect()} == {0, 2} and used
