"""Exact deduplication by progressive refinement: length, then prefix hash, then full hash.

Each step keeps only rows whose key so far occurs more than once.  A step's
surviving keys reach the next scan as a bitmap of fixed size (``bits``), so the
text is never shuffled to find groups; a false hit in the bitmap only costs one
full hash.  Groups are decided on SHA-256 of the whole text and its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, unpacked

PREFIX = 64
BITS = 1 << 22


def _bitmap(keys: DataFrame, bits: int) -> DataFrame:
    """Set of ``slot`` values as at most ``bits`` / 64 rows ``(word, mask)``."""
    one = F.lit(1).cast("long")
    return keys.groupBy((F.col("slot") / 64).cast("long").alias("word")).agg(F.bit_or(F.call_function("shiftleft", one, (F.col("slot") % 64).cast("int"))).alias("mask"))


def _slot(*cols: Column, bits: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(bits)).cast("long")


def _hit(df: DataFrame, slot: Column, bitmap: DataFrame, name: str) -> DataFrame:
    """Adds boolean ``name``: is the slot set?  ``bitmap`` has at most bits / 64 rows, so it is broadcast."""
    bm = F.broadcast(bitmap.select(F.col("word").alias(f"{name}_w"), F.col("mask").alias(f"{name}_m")))
    out = df.withColumn(f"{name}_s", slot)
    out = out.join(bm, (F.col(f"{name}_s") / 64).cast("long") == F.col(f"{name}_w"), "left")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col(f"{name}_s") % 64).cast("int"))
    return out.withColumn(name, F.coalesce(F.col(f"{name}_m").bitwiseAND(bit) != 0, F.lit(False))).drop(f"{name}_s", f"{name}_w", f"{name}_m")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: int = PREFIX, bits: int = BITS) -> DataFrame:
    """All rows of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``keep_rows``.

    Texts are equal when identical; null counts as empty.  Of equal texts the
    row with the largest id stays (a null id only if the group has no other).
    Repeated rows, equal in id and text, all count in ``group_size``; where the
    id that stays has such repeats, each is marked kept and ``keep_rows`` says
    how many there are (:func:`without_copies` leaves one).  An empty table
    gives an empty result; columns of the same names are replaced.  Texts are
    compared whole, however long.
    """
    rows = packed(docs, id_col, text_col)
    size = F.octet_length("text").alias("n")
    head = F.xxhash64(F.substring("text", 1, prefix)).alias("pre")
    lengths = rows.select(size).groupBy("n").count().where("count > 1").select(_slot(F.col("n"), bits=bits).alias("slot"))
    by_len = _hit(rows.select(size, head), _slot(F.col("n"), bits=bits), _bitmap(lengths, bits), "same_len").where("same_len")
    heads = by_len.groupBy("n", "pre").count().where("count > 1").select(_slot(F.col("n"), F.col("pre"), bits=bits).alias("slot"))
    marked = _hit(rows.select("row", "id", "text", size, head), _slot(F.col("n"), F.col("pre"), bits=bits), _bitmap(heads, bits), "same_pre")

    alone = marked.where(~F.col("same_pre")).select("row", "id", F.col("id").alias("keep"), F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("same"))
    full = marked.where("same_pre").select("row", "id", "n", F.sha2("text", 256).alias("sha"))
    groups = (
        full.groupBy("n", "sha", "id").agg(F.count("*").alias("same"))
        .groupBy("n", "sha").agg(F.max(F.struct(F.col("id").isNotNull(), F.col("id"), F.col("same"))).alias("top"), F.sum("same").alias("size"))
        .select("n", "sha", F.col("top.id").alias("keep"), "size", F.col("top.same").alias("same"))
    )
    # a join key of its own puts an exchange right below both sides of the join, so that a hot group can be split there
    key = F.concat_ws(":", "n", "sha").alias("key")
    found = full.select("row", "id", key).join(groups.select(key, "keep", "size", "same"), "key").drop("key")
    return unpacked(alone.unionByName(found), keep_id="keep", group_size="size", kept=F.col("id").eqNullSafe(F.col("keep")), keep_rows="same")


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns unchanged."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    marked = exact_dedup(docs.select(F.struct(*cols).alias("doc"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text").where("kept")
    once = marked.where("keep_rows = 1").select("doc")
    again = marked.where("keep_rows > 1").withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["id", "sha"]).select("doc")
    return once.unionByName(again).select("doc.*")


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("text_sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h FROM documents),
g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY h)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
FROM d JOIN g USING (h)
"""
