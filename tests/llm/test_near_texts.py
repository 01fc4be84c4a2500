"""The near-duplicate stage sends only the texts that are compared or may go."""

from pyspark.sql import functions as F


def test_texts_that_are_not_asked_for_stay(spark):
    from copse.llm import near_copies

    same = " ".join(f"word{i}" for i in range(50))
    texts = [f"text number {i} of its own " + " ".join(f"w{i}x{j}" for j in range(9)) for i in range(2000)]
    docs = spark.createDataFrame([*enumerate(texts), (2000, None), (2001, ""), (2002, same), (2003, same + " more"), (None, same + " words")], "doc_id long, text string").repartition(3).cache()
    of = docs.where("doc_id = 2002").select(F.xxhash64("text").alias("h"))
    marked = near_copies.asked(docs, "text", of)
    assert marked.where("__asked").count() < 10 and marked.where("__asked AND doc_id = 2002").count() == 1 and marked.where("__asked IS NULL").count() == 0
    out = near_copies.without_near_copies(docs)
    assert out.columns == ["doc_id", "text"] and sorted(x.doc_id for x in out.collect()) == [*range(2001), 2002]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Union") and "LeftAnti" in plan
