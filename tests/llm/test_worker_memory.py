"""Python workers that go from stage to stage do not keep what another operator left, and there is one set of them."""

import pyarrow as pa
import pytest


def test_the_memo_of_token_ids_goes_when_another_operator_has_the_worker(spark, monkeypatch):
    import public_tokenizers

    from copse.llm import near_copies, sentencepiece_bpe, simhash

    docs = spark.createDataFrame([(1, "a few words")], "doc_id long, text string")
    model = public_tokenizers.path(sentencepiece_bpe.MODEL)
    runs = []
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    with pytest.raises(Exception):  # noqa: B017, PT011  the columns that were not made
        sentencepiece_bpe.encode_decode(docs, model)
    near_copies.sketches(docs, "doc_id", "text", 5)
    simhash.fingerprints(docs)
    encode, *others = runs
    batch = pa.record_batch([pa.array([{"doc_id": 1, "text": "a few words"}]), pa.array(["a few words"])], names=["row", "text"])
    for other in others:
        assert len(list(encode(iter([batch])))) == 1 and len(list(encode(iter([batch])))) == 1
        assert sentencepiece_bpe._agenda.cache_info().currsize == 1  # stays between tasks of its own
        assert list(other(iter([]))) == []
        assert sentencepiece_bpe._agenda.cache_info().currsize == 0


def test_tables_of_the_driver_start_no_workers(spark, monkeypatch):
    from copse.llm import mixing, simhash
    from copse.llm.common import listed

    nodes = spark.range(40).selectExpr("id * 7 as fp").cache()
    docs = spark.createDataFrame([(i, f"words of text {i} " * 9, None if i % 3 else "s") for i in range(30)], "doc_id long, text string, source string").cache()
    assert nodes.count() == 40 and docs.count() == 30
    monkeypatch.setattr(type(spark.sparkContext), "parallelize", lambda *a, **k: pytest.fail("a list goes through Python workers"))
    assert simhash.links(nodes, 2, bucket=4).count() > 0
    assert mixing.Mix(docs).taken().count() == 30
    kinds = {"a": pa.int32(), "b": pa.list_(pa.int64()), "c": pa.string()}
    assert listed(spark, [], **kinds).count() == 0
    out = listed(spark, [(1, [2, 3], None), (2, [], "x")], **kinds)
    assert out.dtypes == [("a", "int"), ("b", "array<bigint>"), ("c", "string")] and [tuple(r) for r in out.collect()] == [(1, [2, 3], None), (2, [], "x")]
