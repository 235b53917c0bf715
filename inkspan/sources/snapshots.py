"""Stored tables of immutable files that change by one rename.

A table's rows lie in Parquet files by a hash of their key, which are never
changed. A manifest names the files of a version. A writer adds files and then
renames a new manifest to the next version's name, which fails if another
writer has taken it; it then looks at the new version and tries again. So a
reader sees a whole version at any time, and a writer that fails leaves no trace
but files that no manifest names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkspan.sources.shared import checkpointed

BUCKETS, ATTEMPTS = 16, 20


class Conflict(RuntimeError):
    """Other writers were faster each time."""


class Snapshots:
    """A table with the columns of a DDL `schema`, of which `key` is never null, in a folder that all executors see."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = T.StructType.fromDDL(schema)
        jvm = spark.sparkContext._jvm.org.apache.hadoop
        self._path = lambda name: jvm.fs.Path(f"{self.folder}/{name}")
        self._files = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._context = jvm.fs.FileContext.getFileContext(self._path("").toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        self._never = spark.sparkContext._gateway.new_array(jvm.fs.Options.Rename, 0)

    # Versions

    def version(self) -> int:
        """Number of the current version; 0 before the first."""
        if not self._files.exists(self._path("manifests")):
            return 0
        names = (f.getPath().getName() for f in self._files.listStatus(self._path("manifests")))
        return max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=0)

    def manifest(self, version: int) -> dict:
        """Folders by bucket, and the last batch of each stream that is in them."""
        if not version:
            return {"buckets": {}, "applied": {}}
        [row] = self.spark.read.text(f"{self.folder}/manifests/{version:012d}.json", wholetext=True).collect()
        return json.loads(row.value)

    def _publish(self, manifest: dict, version: int) -> bool:
        draft, name = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{version:012d}.json")
        self._files.mkdirs(self._path("manifests"))
        stream = self._files.create(draft)
        try:
            stream.write(json.dumps(manifest).encode())
        finally:
            stream.close()
        try:
            self._context.rename(draft, name, self._never)
        except Exception as error:  # what the gateway raises has no narrower type that is public
            self._files.delete(draft, False)
            if self._files.exists(name):
                return False
            raise error
        return True

    def _change(self, step: Callable[[dict], dict | None]) -> int:
        """Publish what `step` makes of the current manifest; None leaves it. Returns the version that holds it."""
        for _ in range(ATTEMPTS):
            version = self.version()
            changed = step(self.manifest(version))
            if changed is None or self._publish(changed, version + 1):
                return version + (changed is not None)
        raise Conflict(self.folder)

    # Rows

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame:
        folders = [f"{self.folder}/{x}" for b, listed in manifest["buckets"].items() if buckets is None or int(b) in buckets for x in listed]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def read(self, version: int | None = None) -> DataFrame:
        return self._read(self.manifest(self.version() if version is None else version))

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("__bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in self._bucketed(rows.select(self.key)).select("__bucket").distinct().collect()]  # numbers below `buckets`

    def _written(self, rows: DataFrame) -> dict[str, str]:
        """Write rows as new files; the folder of each bucket that has some."""
        name = f"data/{uuid.uuid4().hex}"
        self._bucketed(rows.select(*self.schema.names)).repartition(self.buckets, "__bucket").write.partitionBy("__bucket").parquet(f"{self.folder}/{name}")
        found = (f.getPath().getName() for f in self._files.listStatus(self._path(name)) if f.isDirectory())
        return {n.partition("=")[2]: f"{name}/{n}" for n in found if n.startswith("__bucket=")}

    def _one_a_key(self, rows: DataFrame, order: str | None) -> DataFrame:
        """The first row of each key by the column `order`, or else by all columns; rows without a key go."""
        rest = [c for c in self.schema.names if c not in (self.key, order)]
        first = F.min(F.struct(*([order] if order else []), *rest)).alias("r")
        return rows.filter(F.col(self.key).isNotNull()).groupBy(self.key).agg(first).select(self.key, "r.*").select(*self.schema.names)

    def append(self, rows: DataFrame) -> int:
        """Add rows whatever their keys."""
        fresh = self._written(rows.filter(F.col(self.key).isNotNull()))

        def step(manifest: dict) -> dict:
            return manifest | {"buckets": manifest["buckets"] | {b: [*manifest["buckets"].get(b, []), f] for b, f in fresh.items()}}

        return self._change(step)

    def insert_new(self, rows: DataFrame, order: str | None = None) -> DataFrame:
        """Add the rows whose key isn't there, one a key (the first by `order`), and return them; the others are left as they are."""
        own, added = checkpointed(self._one_a_key(rows, order)), []
        touched = self._touched(own)

        def step(manifest: dict) -> dict | None:
            new = checkpointed(own.join(self._read(manifest, touched).select(self.key), self.key, "left_anti").select(*self.schema.names))
            added[:] = [new]
            if not new.head(1):
                return None
            return manifest | {"buckets": manifest["buckets"] | {b: [*manifest["buckets"].get(b, []), f] for b, f in self._written(new).items()}}

        self._change(step)
        return added[0]

    def replace(self, rows: DataFrame | None = None, gone: DataFrame | None = None, stream: str | None = None, batch: int = 0) -> int:
        """Put `rows` in the place of those with their keys, and take out the keys of `gone`, as one change; only buckets with such keys are rewritten.

        A change of a stream's `batch` that a version already holds is left out.
        """
        own = checkpointed(self._one_a_key(rows if rows is not None else self.spark.createDataFrame([], self.schema), None))
        out = own.select(self.key) if gone is None else own.select(self.key).unionByName(gone.select(self.key)).distinct()
        out = checkpointed(out)
        touched = self._touched(out)

        def step(manifest: dict) -> dict | None:
            if stream is not None and manifest["applied"].get(stream, -1) >= batch or not touched:
                return None
            fresh = self._written(self._read(manifest, touched).join(out, self.key, "left_anti").unionByName(own))
            kept = {b: f for b, f in manifest["buckets"].items() if int(b) not in touched}
            return {"buckets": kept | {b: [f] for b, f in fresh.items()}, "applied": manifest["applied"] | ({} if stream is None else {stream: batch})}

        return self._change(step)
