"""Shared pieces of the training-data operators: scratch tables, Arrow maps, components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Whitespace of the word rule: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local (tests, a laptop) a temporary folder is
    taken instead; on a cluster its executors would not see one another's files, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    held = spark.sparkContext.getCheckpointDir()
    if held:
        return held.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="barloom-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; one folder per application."""
    return f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a table of ``materialize`` that nothing will read again."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.scratch)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else, in the JVM.

    ``lower`` does the same on texts without upper-case letters beyond A-Z, and takes a byte-wise
    path on pure ASCII; only the remaining texts pay for the mapping of single characters.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    plain = (F.octet_length(c) == F.char_length(c)) | ~c.rlike(r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]")
    return F.when(plain, F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(run, schema)


def with_fields(df: DataFrame, **kinds: str) -> T.StructType:
    """The schema of ``df`` with further fields, as DDL type names."""
    return T.StructType([*df.schema.fields, *(T.StructField(n, T._parse_datatype_string(k)) for n, k in kinds.items())])


def texts_of(batch: pa.RecordBatch, name: str) -> Iterator[str | None]:
    """The strings of a column one by one, so that no list of all of them is held."""
    for value in batch.column(batch.schema.get_field_index(name)):
        yield value.as_py()


#: Keys of dropped rows are broadcast up to so many (some tens of MB); beyond, they are joined by shuffle.
BROADCAST_KEYS = 500_000


def without(docs: DataFrame, dropped: DataFrame, on: Column) -> DataFrame:
    """``docs`` without the rows that ``dropped``, a written table of distinct keys, names.

    Few keys are broadcast. More are shuffled with the rows and hashed a partition at a time, so that the
    rows, whole texts among them, are neither sorted nor spilled. Rows are the same either way.
    """
    side = F.broadcast(dropped) if dropped.count() <= BROADCAST_KEYS else dropped.hint("shuffle_hash")
    return docs.join(side, on, "left_anti")


def star_edges(edges: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """One large-star and one small-star round over edges (a, b) with a > b, and the tables it wrote.

    Each star is an aggregation and an equi-join on a node. The minima are written before they are joined: where one
    side of a join is an aggregation on its key, Spark cannot split that key; of two written tables the
    adaptive skew join splits a hub's rows. No neighbour list is ever collected.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m")), "least")
    large = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large-star")
    down = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "down")
    small = large.join(down, "a")
    out = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
    return out, [least, large, down]


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of undirected ``edges`` (a, b); component is its smallest node.

    Alternating large-star and small-star rounds (O(log n) of them), each written to the shared
    folder, where the round before is deleted. They end when count and digest of the edges stay; more
    than ``rounds`` of them are an error, never a partial result. Loops and repeated edges are ignored, edges with a null end too. No edges: no rows.
    Nodes without an edge are not returned; the caller's left join gives them themselves.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialize(now, "edges")
    seen = _state(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        made, used = star_edges(now)
        before, now = now, materialize(made, "edges")
        state = _state(now)
        for table in (before, *used):
            release(table)
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def _state(edges: DataFrame) -> tuple:
    """A count and an order-free digest of an edge set."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.crc32(F.concat_ws(" ", "a", "b")))).first())
