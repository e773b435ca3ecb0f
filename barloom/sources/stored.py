"""A stored table of bars that updates change in place: copy on write, by partition, with versions.

Rows lie in Parquet files, clustered by pair and time within a part (a month). A version is a small Parquet table, the
manifest: each file, its part, and the least and greatest pair and time in it. A pointer file, renamed into place as the last
step, makes a version the newest: readers see the old table or the new one, and a writer that dies before the
rename leaves files that nothing names, which ``vacuum`` deletes. Of two writers of the same version one fails.

An update reads and writes only the parts that it touches; all other files keep their names. A scan of a pair and a range
asks the manifest first, so it opens the files that may have rows of them and no others. The driver holds names of touched
parts and of files to be read, never a manifest whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.upsert import KEY, insert_ignore, join_update


class StoredTable:
    """A table below ``path``. ``by``: the SQL expression of a row's part; its values name nothing on disk."""

    def __init__(self, spark: SparkSession, path: str, by: str = "date_format(timestamp_utc, 'yyyy-MM')") -> None:
        self.spark, self.path, self.by = spark, path.rstrip("/"), by

    # Versions

    def versions(self) -> list[int]:
        """Numbers of the versions that are there, ascending."""
        files = self._list("versions")
        return sorted(int(f.getPath().getName()) for f in files if f.getPath().getName().isdigit())

    def manifest(self, version: int | None = None) -> DataFrame:
        """(file, part, rows, low_pair, high_pair, low_time, high_time) of a version, the newest by default."""
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no table in {self.path}")
        name = self.spark.read.text(f"{self.path}/versions/{found[-1] if version is None else version:012d}").first()[0]
        return self.spark.read.parquet(f"{self.path}/manifests/{name}")

    def _commit(self, manifest: DataFrame, version: int) -> int:
        """Write a manifest, then the pointer under another name, then rename it; it fails if the version is there."""
        name = uuid.uuid4().hex
        manifest.coalesce(1).write.parquet(f"{self.path}/manifests/{name}")
        jvm = self.spark._jvm
        draft, final = (self._hadoop(f"versions/{x}") for x in (f"_{name}", f"{version:012d}"))
        out = self._fs().create(draft, True)
        out.write(bytearray(name.encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self._conf())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        context.rename(context.makeQualified(draft), context.makeQualified(final), none)
        return version

    # Reading

    def read(self, pair: str | None = None, start: str | Column | None = None, end: str | Column | None = None, version: int | None = None) -> DataFrame:
        """Rows of a version, of one pair and from ``start`` to ``end``, both included, where given; only files that may have them are opened."""
        manifest = self.manifest(version)
        kind = manifest.schema["low_time"].dataType
        bound = lambda x: F.lit(x).cast(kind) if isinstance(x, str) else x
        files, rows = manifest, []
        if pair is not None:
            files, rows = files.where(F.lit(pair).between(F.col("low_pair"), F.col("high_pair"))), [*rows, F.col("pair") == pair]
        if start is not None:
            files, rows = files.where(F.col("high_time") >= bound(start)), [*rows, F.col("timestamp_utc") >= bound(start)]
        if end is not None:
            files, rows = files.where(F.col("low_time") <= bound(end)), [*rows, F.col("timestamp_utc") <= bound(end)]
        out = self._open(files)
        for condition in rows:
            out = out.where(condition)
        return out

    def _open(self, files: DataFrame) -> DataFrame:
        """The rows of the files of a part of a manifest."""
        names = [r[0] for r in files.select("file").collect()]
        return self.spark.read.schema(self._schema()).parquet(*names) if names else self.spark.createDataFrame([], self._schema())

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.spark.read.text(f"{self.path}/schema").first()[0]))

    # Writing

    def create(self, rows: DataFrame) -> int:
        """The first version. It is an error if there is one."""
        if self.versions():
            raise FileExistsError(self.path)
        rows.sparkSession.createDataFrame([(rows.schema.json(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/schema")
        return self._commit(self._write(rows), 0)

    def update(self, updates: DataFrame, key: list[str] | None = None, missing: float = 0.0) -> int:
        """The version with the values of ``updates`` in rows whose key is there, as ``join_update`` has them; the present version if no part is touched."""
        version, manifest = self.versions()[-1], self.manifest()
        updates = updates.withColumn("__part", F.coalesce(F.expr(self.by), F.lit("")))
        # At most as many names as the table has parts.
        touched = manifest.select(F.col("part").alias("__part")).distinct().join(updates.select("__part").distinct(), "__part", "left_semi")
        names = [r[0] for r in touched.collect()]
        if not names:
            return version
        mine = F.col("part").isin(names)
        fresh = self._write(join_update(self._open(manifest.where(mine)), updates.where(F.col("__part").isin(names)).drop("__part"), key or KEY, missing))
        return self._commit(manifest.where(~mine).unionByName(fresh), version + 1)

    def insert(self, new: DataFrame, key: list[str] | None = None) -> int:
        """The version with the rows of ``new`` whose key is not there, one of each; present files stay, and only keys of touched parts are read."""
        version, manifest = self.versions()[-1], self.manifest()
        part = F.coalesce(F.expr(self.by), F.lit(""))
        touched = manifest.join(new.select(part.alias("part")).distinct(), "part", "left_semi")
        have = self._open(touched).select(*(key or KEY))
        return self._commit(manifest.unionByName(self._write(insert_ignore(have, new.select(*self._schema().names), key or KEY))), version + 1)

    def _write(self, rows: DataFrame) -> DataFrame:
        """Files of ``rows``, ranged and sorted by part, pair and time, and their manifest."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        rows = rows.withColumn("__part", F.coalesce(F.expr(self.by), F.lit("")))
        order = ["__part", "pair", "timestamp_utc"]
        # A part's folder is named by a hash: parts may be any text.
        rows.withColumn("__dir", F.hex(F.crc32("__part"))).repartitionByRange(*order).sortWithinPartitions("__dir", *order).drop("__part").write.partitionBy("__dir").parquet(folder)
        # Read by its schema: a table of no rows has no file to learn it from.
        back = self.spark.read.schema(rows.drop("__part").schema).parquet(folder)
        t = F.col("timestamp_utc")
        return back.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            F.first(F.coalesce(F.expr(self.by), F.lit(""))).alias("part"), F.count(F.lit(1)).alias("rows"),
            F.min("pair").alias("low_pair"), F.max("pair").alias("high_pair"), F.min(t).alias("low_time"), F.max(t).alias("high_time"),
        )

    # Cleaning

    def vacuum(self, keep: int = 2, older_than_s: float = 86_400.0) -> int:
        """Delete versions but the newest ``keep``, and folders that none of these names and that are older than so many seconds; how many folders went.

        The age spares files of writers that have not yet committed.
        """
        import time

        found = self.versions()
        for v in found[:-keep]:
            self._fs().delete(self._hadoop(f"versions/{v:012d}"), False)
        kept, manifests = set(), set()
        for v in found[-keep:]:
            folder = F.regexp_extract("file", r"/data/([0-9a-f]{32})/", 1)
            kept |= {r[0] for r in self.manifest(v).select(folder).distinct().collect()}  # one name a write
            manifests.add(self.spark.read.text(f"{self.path}/versions/{v:012d}").first()[0])
        gone = 0
        for below, named in (("data", kept), ("manifests", manifests)):
            for f in self._list(below):
                if f.getPath().getName() not in named and f.getModificationTime() < (time.time() - older_than_s) * 1000:
                    gone += self._fs().delete(f.getPath(), True)
        return gone

    # Files

    def _conf(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _hadoop(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _fs(self):
        return self._hadoop("data").getFileSystem(self._conf())

    def _list(self, name: str) -> list:
        path = self._hadoop(name)
        return list(self._fs().listStatus(path)) if self._fs().exists(path) else []
