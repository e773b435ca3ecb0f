"""Exact deduplication through an extendible-hash index on shared files; JVM operations only.

Entries (one small row a document: id, 64-bit hash, length, SHA-256) are written once to the shared
folder. The directory starts as one bucket and doubles: a bucket whose rows hold more than its share of
bytes is split by the next hash bit. The directory is stored beside the index; through it each document
finds its bucket, and rows are dealt by bucket: one owner task has all of a bucket's rows, chains entries
of equal hash and compares their bytes (it groups by hash and text, so that colliding hashes stay apart).
The heads of the chains are the index; documents look theirs up by bucket, hash and digest.

A text whose copies alone overfill a bucket cannot be split off by hash bits. Such hot texts, at most
``HOT`` of them, are known from the entries; their rows combine in each task before one row a task travels.

Buckets grow beyond ``BUCKET_BYTES`` once there would be more than ``MOST_BUCKETS`` of them, so that the
directory, which is broadcast, never has more than four times as many cells.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, without

#: Bytes of text in a bucket before it splits, and how many buckets there may be before they grow.
BUCKET_BYTES, MOST_BUCKETS = 1 << 20, 1 << 18
#: Texts with more than this share of all bytes, and more than a bucket's, are hot: there are at most HOT.
HOT = 100_000


def _cell(depth: int) -> F.Column:
    return F.expr(f"shiftrightunsigned(h, {64 - depth})") if depth else F.lit(0).cast("long")


def directory(counts: DataFrame, bucket_bytes: int) -> DataFrame:
    """(cell, bucket, depth, deepest) for each cell of the deepest level that holds entries; counts: (h, n_bytes).

    A bucket is named by its first cell; cells that share their first ``depth`` bits share it.
    """
    total = counts.agg(F.sum("n_bytes")).first()[0] or 0
    deepest = max(0, math.ceil(math.log2(max(1.0, total / bucket_bytes)))) + 2
    cells = counts.groupBy(_cell(deepest).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
    levels = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(0), F.lit(deepest))).alias("depth"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {deepest} - depth)"))
    fits = levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("held")).where((F.col("held") <= bucket_bytes) | (F.col("depth") == deepest))
    found = levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    return found.select("cell", F.expr(f"shiftleft(shiftright(cell, {deepest} - depth), {deepest} - depth)").alias("bucket"), "depth", F.lit(deepest).alias("deepest"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. The largest
    doc_id of a group is its keep_id (null only if all its ids are null); group_size counts rows,
    repeated ones included; rows that repeat the keeping id are all kept. An empty table gives no
    rows. Other columns of ``docs``, whatever their names, are not read.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    entries = norm.select("doc_id", F.xxhash64("norm").alias("h"), F.octet_length("norm").cast("long").alias("n_bytes"), F.sha2("norm", 256).alias("text_sha256"))
    entries = materialize(entries, "hash-entries")
    counts = materialize(entries.groupBy("h").agg(F.sum("n_bytes").alias("n_bytes"), F.max("n_bytes").alias("one")), "hash-counts")
    total = counts.agg(F.sum("n_bytes")).first()[0] or 0
    bucket_bytes = max(bucket_bytes, total // MOST_BUCKETS)
    is_hot = F.col("n_bytes") > max(bucket_bytes, total / hot)
    index = materialize(directory(counts.select("h", F.when(is_hot, F.col("one")).otherwise(F.col("n_bytes")).alias("n_bytes")), bucket_bytes), "hash-directory")
    deepest = index.agg(F.max("deepest")).first()[0] or 0
    cells = F.broadcast(index.select("cell", "bucket"))
    placed = norm.select("doc_id", "norm", F.xxhash64("norm").alias("h")).withColumn("cell", _cell(deepest)).join(cells, "cell").drop("cell")
    hot_texts = materialize(counts.where(is_hot).select("h"), "hot-texts")

    def chained(rows: DataFrame) -> DataFrame:
        return rows.groupBy("bucket", "h", "norm").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))

    if hot_texts.isEmpty():
        heads = chained(placed.repartition("bucket"))
    else:
        mild, many = placed.join(F.broadcast(hot_texts), "h", "left_anti"), placed.join(F.broadcast(hot_texts), "h", "left_semi")
        heads = chained(mild.repartition("bucket")).unionByName(chained(many))
    heads = materialize(heads.select("bucket", "h", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size"), "hash-index")
    looked_up = entries.withColumn("cell", _cell(deepest)).join(cells, "cell").join(heads, ["bucket", "h", "text_sha256"])
    return looked_up.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` with one row of each group of equal texts: one that has the largest id; same columns, whatever their names.

    Decisions are found again by id and digest, so rows of one id with different texts do not mix; null
    ids count as the smallest. Of rows that repeat the keeping id, one stays.
    """
    found = materialize(exact_duplicates(docs, id_col, text_col, **kw), "exact-groups")
    named = found.select(F.col("doc_id").alias("an_id"), F.xxhash64("text_sha256").alias("a_digest"), "kept")
    dropped = materialize(named.where(~F.col("kept")).select("an_id", "a_digest").distinct(), "exact-copies")
    repeated = materialize(named.where("kept").groupBy("an_id", "a_digest").count().where("count > 1").drop("count"), "exact-repeats")
    keyed = docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.sha2(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), 256)).alias("digest"))
    same = lambda side: keyed["id"].eqNullSafe(side["an_id"]) & (keyed["digest"] == side["a_digest"])
    out = without(keyed, dropped, same(dropped))
    if not repeated.isEmpty():
        once = keyed.join(repeated, same(repeated), "left_semi").dropDuplicates(["id", "digest"])
        out = without(out, repeated, same(repeated)).unionByName(once)
    return out.select("row.*")
