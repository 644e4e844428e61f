"""A table in key buckets that changes by manifest: each commit rewrites the buckets that it touches and no others.

A manifest names, for each bucket, the folder that holds it. A commit writes new folders first and then one new manifest
file, which readers see whole or not at all; a crash before that leaves the table as it was. Folders that the manifest
before the last named and the new one does not are removed, so a reader of the last one finds its files.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "key_bucket"


class BucketTable:
    """A Parquet table of rows with a key, in `buckets` folders by the key's hash; the number is fixed at the first commit."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest manifest: version, batch, buckets, schema, folders by bucket; an empty one before the first commit."""
        folder = self._path(f"{self.path}/manifests")
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        names = sorted(n for n in names if n.endswith(".json"))
        if not names:
            return {"version": 0, "batch": -1, "buckets": self.buckets, "schema": None, "folders": {}, "old": []}
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{names[-1]}").collect()))  # one small file

    def read(self, manifest: dict | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The table as the newest manifest has it, or some of its buckets; None before the first commit."""
        m = manifest or self.manifest()
        if m["schema"] is None:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(m["schema"])
        folders = sorted({f for b, f in m["folders"].items() if buckets is None or int(b) in buckets})
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def replace(self, batch: DataFrame, batch_id: int) -> bool:
        """Rows of the keys in `batch` give way to it. False if this or a later batch is committed already."""
        from parley.operators.store import replace_children

        m = self.manifest()
        if batch_id <= m["batch"]:
            return False
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(m["buckets"]))
        touched = sorted(r[0] for r in batch.select(bucket.alias("b")).distinct().collect())  # `buckets` rows at most
        held = self.read(m, touched)
        new = batch if held is None else replace_children(held, batch, self.key)
        stamp = uuid.uuid4().hex
        new.withColumn(BUCKET, bucket).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{stamp}")
        written = self._fs.listStatus(self._path(f"{self.path}/{stamp}"))
        folders = {b: f for b, f in m["folders"].items() if int(b) not in touched}
        folders |= {s.getPath().getName().split("=")[1]: f"{stamp}/{s.getPath().getName()}" for s in written if s.isDirectory()}
        gone = [f for f in m["folders"].values() if f not in set(folders.values())]
        self._commit({"version": m["version"] + 1, "batch": batch_id, "buckets": m["buckets"], "schema": json.loads(new.schema.json()), "folders": folders, "old": gone})
        for folder in m["old"]:
            self._fs.delete(self._path(f"{self.path}/{folder}"), True)
        return True

    def _commit(self, manifest: dict) -> None:
        """One new file under a name that nobody else may have taken."""
        to, draft = (self._path(f"{self.path}/{name}") for name in (f"manifests/{manifest['version']:012d}.json", f"drafts/{uuid.uuid4().hex}"))
        self._fs.mkdirs(to.getParent())
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        if self._fs.exists(to) or not self._fs.rename(draft, to):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was committed by another writer")
