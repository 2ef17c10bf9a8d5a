"""A keyed document store with committed versions.

Documents live in buckets of their key's hash; a version is a small manifest
that names the folder of every bucket. A merge writes new folders for the
buckets it touches and then the next manifest, by a rename that fails if another
writer was first: readers see one version or the other, and a writer that dies
leaves the old one. The manifest also holds the ids of the batches merged so
far, so a repeated batch changes nothing.

A subtree of nested paths is deleted page by page. Each page is a committed
version of its own with a tombstone over a range of paths and the cursor to go
on from; a merge that rewrites a bucket drops what its tombstones cover.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from windlass.operators.dedup import keep_last
from windlass.session import cut_lineage
from windlass.sources.sinks import merge_documents

BUCKETS = 64
# Batch ids kept; older ones are a stream's finished past.
LEDGER = 10_000


class Conflict(RuntimeError):
    """Another writer committed the version first."""


class DocumentStore:
    """Documents of one schema under `root`, keyed by one column."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str,
                 buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.schema, self.key = spark, root.rstrip("/"), schema, key
        self.buckets = buckets
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}" if name else self.root)

    # Manifests

    def version(self) -> int:
        """Number of the latest version; 0 is the empty store."""
        folder = self._path("versions")
        if not self._fs.exists(folder):
            return 0
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return max((int(n[1:]) for n in names if n.startswith("v")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"buckets": {}, "batches": [], "graves": [], "cursor": None}
        lines = self.spark.read.text(f"{self.root}/versions/v{version:08d}").collect()
        return json.loads(lines[0][0])

    def _commit(self, manifest: dict, version: int) -> None:
        """Publish `manifest` as the version after `version`."""
        folder, draft = self._path("versions"), self._path(f"drafts/{uuid.uuid4().hex}")
        self._fs.mkdirs(folder)
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target = self._path(f"versions/v{version + 1:08d}")
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            raise Conflict(f"version {version + 1} is taken")

    # Reading

    def read(self, version: int | None = None) -> DataFrame:
        return self._documents(self.manifest(version)).select(*self.schema.names)

    def _documents(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        """Documents of a version; folders that the same tombstones cover are
        read together."""
        by_age: dict[int, list[str]] = {}
        for bucket, (folder, born) in manifest["buckets"].items():
            if buckets is None or int(bucket) in buckets:
                by_age.setdefault(sum(g["at"] >= born for g in manifest["graves"]), []).append(folder)
        out = self.spark.createDataFrame([], self.schema)
        for later, folders in by_age.items():
            part = self.spark.read.schema(self.schema).parquet(
                *[f"{self.root}/{f}" for f in folders])
            graves = manifest["graves"][len(manifest["graves"]) - later:] if later else []
            for g in graves:
                part = part.filter(~self._covered(g))
            out = out.unionByName(part)
        return out

    def _covered(self, grave: dict):
        key = F.col(self.key)
        inside = key.startswith(grave["prefix"]) & (key <= grave["high"])
        inside = inside & (key > grave["low"]) if grave["low"] is not None else inside
        return F.coalesce(inside, F.lit(False))

    # Writing

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def merge(self, batch: DataFrame, batch_id: str, order: Sequence[str] = (),
              replace: bool = False, tries: int = 5) -> bool:
        """Merge documents by key: the batch's fields win and fields it lacks stay,
        or with `replace` the whole document. With `order`, the document that is
        last by these columns stays, of equal ones the batch's. False if the
        batch was merged before."""
        latest = cut_lineage(keep_last(batch, [self.key], [F.col(c) for c in order])
                             if order else batch.dropDuplicates([self.key]))
        # At most as many as there are buckets.
        touched = [r[0] for r in latest.select(self._bucket()).distinct().collect()]

        def change(manifest: dict, version: int) -> dict:
            stored = self._documents(manifest, touched)
            if order:
                both = stored.withColumn("_new", F.lit(False)).unionByName(
                    latest.withColumn("_new", F.lit(True)), allowMissingColumns=True)
                merged = keep_last(
                    both, [self.key], [*[F.col(c) for c in order], F.col("_new")]).drop("_new")
            elif replace:
                merged = stored.join(latest.select(self.key), self.key, "left_anti").unionByName(
                    latest, allowMissingColumns=True)
            else:
                merged = merge_documents(stored, latest, self.key)
            return self._written(merged, touched, manifest, version)

        return self._retry(batch_id, change, tries)

    def _written(self, merged: DataFrame, touched: Sequence[int], manifest: dict,
                 version: int) -> dict:
        folder = f"data/{uuid.uuid4().hex}"
        typed = merged.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields])
        if touched:
            (typed.withColumn("_bucket", self._bucket()).repartition("_bucket")
             .write.partitionBy("_bucket").parquet(f"{self.root}/{folder}"))
        buckets = dict(manifest["buckets"])
        for b in touched:
            buckets.pop(str(b), None)
            own = f"{folder}/_bucket={b}"
            if self._fs.exists(self._path(own)):
                buckets[str(b)] = [own, version + 1]
        born = [at for _, at in buckets.values()]
        graves = [g for g in manifest["graves"] if any(g["at"] >= at for at in born)]
        return {**manifest, "buckets": buckets, "graves": graves}

    def _retry(self, batch_id: str, change: Callable[[dict, int], dict], tries: int) -> bool:
        for left in range(tries, 0, -1):
            version = self.version()
            manifest = self.manifest(version)
            if batch_id in manifest["batches"]:
                return False
            new = change(manifest, version)
            new["batches"] = [*manifest["batches"], batch_id][-LEDGER:]
            try:
                self._commit(new, version)
                return True
            except Conflict:
                if left == 1:
                    raise
        return False

    def delete_tree(self, prefix: str, page: int = 100_000, max_pages: int | None = None) -> bool:
        """Delete all documents whose key starts with `prefix`, a page of keys in
        order at a time. An interrupted call goes on where the last page ended.
        True when nothing is left."""
        pages = 0
        while max_pages is None or pages < max_pages:
            version = self.version()
            manifest = self.manifest(version)
            at = manifest["cursor"] or {}
            low = at.get("high") if at.get("prefix") == prefix else None
            left = self._documents(manifest).filter(F.col(self.key).startswith(prefix))
            if low is not None:
                left = left.filter(F.col(self.key) > low)
            # Only the page's last key comes here.
            high = left.select(self.key).orderBy(self.key).limit(page).agg(F.max(self.key)).first()[0]
            if high is None:
                self._commit({**manifest, "cursor": None}, version)
                return True
            grave = {"prefix": prefix, "low": low, "high": high, "at": version + 1}
            self._commit({**manifest, "graves": [*manifest["graves"], grave],
                          "cursor": {"prefix": prefix, "high": high}}, version)
            pages += 1
        return False

    def vacuum(self) -> None:
        """Delete folders that the latest version does not name."""
        used = {folder for folder, _ in self.manifest()["buckets"].values()}
        data = self._path("data")
        if not self._fs.exists(data):
            return
        for write in self._fs.listStatus(data):
            for part in self._fs.listStatus(write.getPath()):
                name = f"data/{write.getPath().getName()}/{part.getPath().getName()}"
                if name not in used:
                    self._fs.delete(part.getPath(), True)
