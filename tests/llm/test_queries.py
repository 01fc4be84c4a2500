"""Every registered query of a text operator: clashing names, empty tables, repeated rows; classifiers against held-out labels."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from copse.llm import quality, queries

CLASHES = "row id text_ h hash a b lo hi sha key size target taken words n bucket first fingerprint component_id keep_id group_size kept spans base score predicted held_out ids n_tokens n_bytes n_removed x dim part cell unit role raw rank query_id copies n_chars_ of label weight".split()
LABELS = "doc_id long, quality int, toxic int"
KEYS = {"op1_html_text": "page_id", "op8_kdtree_topk": "query_id"}


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    r = random.Random(6)
    word = lambda: "".join(r.choice("aeioustnrl") for _ in range(r.randint(2, 8)))
    line = lambda: " ".join(word() for _ in range(r.randint(3, 30))).capitalize() + "."
    junk = lambda: " ".join(word().upper() + "!!" for _ in range(r.randint(5, 30)))
    rows, labels = [], []
    for i in range(240):
        bad, rude = i % 4 == 0, i % 5 == 0
        text = "\n".join((junk if bad else line)() for _ in range(r.randint(1, 6))) + (" grobian lout" * 2 if rude else "")
        rows.append((i, text, "en", f"s{i % 4}", len(text)))
        labels.append((i, int(not bad), int(rude)))
    rows += [(300, None, "en", None, 0), (301, "", None, "s1", 0), (302, rows[7][1], "en", "s0", 9), (303, "é " * 20000 + "me@x.org", "fr", "s0", 40008), rows[9], (None, rows[3][1], "en", "s1", 5)]
    made = {
        "documents": spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": spark.createDataFrame(labels, LABELS),
        "pages": spark.createDataFrame([(1, "u", "<article><p>a b</article>"), (2, None, None), (2, "u", "<![x[")], "page_id long, url string, html string"),
        "embeddings": spark.createDataFrame([(i, [float(np.cos(i * k)) for k in range(5)], 0) for i in range(60)], "vec_id long, embedding array<float>, label int"),
    }
    out = {}
    for kind in ("plain", "clash", "empty"):
        where = tmp_path_factory.mktemp(kind)
        for name, df in made.items():
            if kind == "clash":
                have = {c.lower() for c in df.columns}
                df = df.select("*", *[F.lit(f"~{c}").alias(c) for c in CLASHES if c not in have and not (name == "labels" and c in ("quality", "toxic"))])
            (df.limit(0) if kind == "empty" else df).coalesce(2).write.parquet(str(where / f"{name}.parquet"))
        out[kind] = str(where)
    return out


@pytest.mark.parametrize("name", list(queries.queries()))
def test_names_and_empty_tables(spark, folders, name):
    run = queries.queries()[name]
    plain = run(spark, folders["plain"])
    clash = run(spark, folders["clash"])
    assert plain.columns == clash.columns
    rows = sorted(map(repr, plain.collect()))
    assert rows == sorted(map(repr, clash.collect()))
    tables = {"op1_html_text": 3, "op8_kdtree_topk": 3 * 20}
    assert len(rows) == tables.get(name, 246)
    empty = run(spark, folders["empty"])
    assert empty.count() == 0 and empty.columns == plain.columns


@pytest.mark.parametrize(("name", "label"), [("op7_toxicity", "toxic"), ("op10_quality", "quality")])
def test_held_out_labels(spark, folders, name, label):
    labels = spark.read.parquet(f"{folders['plain']}/labels.parquet")
    rows = queries.queries()[name](spark, folders["plain"]).join(labels, "doc_id").where("held_out").collect()
    right = [r.predicted == r[label] for r in rows]
    assert len(rows) > 30 and np.mean(right) >= 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_the_chain_labels_lines_of_both_kinds(spark, folders):
    docs = spark.read.parquet(f"{folders['plain']}/documents.parquet")
    chain = quality.train(docs, spark.read.parquet(f"{folders['plain']}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.where("doc_id < 240").collect()}
    good = [t for i, t in texts.items() if i % 4 and "\n" in t][:20]
    bad = [t for i, t in texts.items() if i % 4 == 0][:20]
    right = total = 0
    for g, b in zip(good, bad, strict=True):
        top, rest = g.split("\n", 1)
        x, length = quality.line_features("\n".join([top, *b.split("\n")[:2], rest]))
        want = np.ones(len(length), bool)
        want[1 : 1 + len(b.split("\n")[:2])] = False
        right += ((chain.marginals(x) >= 0.5) == want).sum()
        total += len(want)
    assert right / total > 0.9
    flat = quality.Chain(chain.unary, np.zeros((2, 2)), chain.scale)
    assert not np.allclose(chain.trans, chain.trans[0, 0], atol=0.1) and chain.score(good[0]) != flat.score(good[0])
