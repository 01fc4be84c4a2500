"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random


def test_near_stage_against_brute_force(spark, tmp_path):
    import corpus_pipeline as cp

    r = random.Random(11)
    word = lambda: "".join(r.choice("aeioustnrl") for _ in range(r.randint(2, 8)))
    texts = []
    for n in [60, 100, 250, 1000] * 6:
        base = [word() for _ in range(n)]
        texts.append(base)
        for _ in range(4):  # up to 3 words of 100 changed: similarities on both sides of 0.8
            copy = list(base)
            for i in r.sample(range(n), r.randint(1, 3) * n // 100 or 1):
                copy[i] = word()
            texts.append(copy)
    chain = [word() for _ in range(100)]
    for _ in range(40):  # the ends of the chain are not near, each step is
        chain = list(chain)
        chain[r.randrange(100)] = word()
        texts.append(chain)
    texts = [" ".join(t) for t in texts] + [None, "", " ", "few words", "Few  words", "other words"]
    r.shuffle(texts)
    grams = []
    for t in texts:
        w = (t or "").lower().split()
        grams.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    root = list(range(len(texts)))
    near = {(i, j) for j in range(len(texts)) for i in range(j) if 5 * len(grams[i] & grams[j]) >= 4 * len(grams[i] | grams[j])}
    for _ in texts:
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    kept = cp.without_near_copies(spark, spark.read.parquet(str(tmp_path / "d")), str(tmp_path))
    assert len(near) > 60 and {x.doc_id for x in kept.collect()} == set(root)
