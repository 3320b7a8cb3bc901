"""Replay-safe tables that grow by batches.

A batch's tables are first written to folders of their own, then *published* by
renaming one small manifest file into place: ``manifest/<batch_id>.json`` names the
folders that belong to the batch, and folders of earlier batches that it replaces.
Readers see only folders that a manifest names and none replaces, so a batch is there
with all its tables or not at all, and a batch that is run again after a lost driver
finds its manifest and writes nothing.  Folders of attempts that never published, and
replaced ones, stay invisible until ``vacuum`` removes them.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession


class BatchManifest:
    """Tables that grow by published batches under one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._fs = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def published(self) -> dict[int, dict]:
        """{batch id: {"tables": {table: folder}, "replaces": [folder]}} of every published batch."""
        out = {}
        for name in self._names(f"{self.path}/manifest"):
            if name.endswith(".json") and not name.startswith((".", "_")):
                stream = self._fs.open(self._hadoop(f"{self.path}/manifest/{name}"))
                try:
                    out[int(name[:-5])] = json.loads(bytes(stream.readAllBytes()).decode())
                finally:
                    stream.close()
        return out

    def next_id(self) -> int:
        return max(self.published(), default=-1) + 1

    def is_published(self, batch_id: int) -> bool:
        return self._fs.exists(self._hadoop(f"{self.path}/manifest/{batch_id}.json"))

    def folders(self, table: str) -> list[str]:
        """Folders of a table that readers see, in batch order."""
        batches = self.published()
        gone = {f for b in batches.values() for f in b["replaces"]}
        return [f for _, b in sorted(batches.items()) if (f := b["tables"].get(table)) and f not in gone]

    def publish(self, batch_id: int, tables: dict[str, DataFrame], partition_by: dict[str, list[str]] | None = None,
                replaces: tuple[str, ...] = ()) -> bool:
        """Write and publish a batch; False if it was published before (nothing is written then)."""
        if self.is_published(batch_id):
            return False
        attempt, folders = uuid.uuid4().hex, {}
        for name, df in tables.items():
            folders[name] = f"data/{name}/batch={batch_id}-{attempt}"
            df.write.partitionBy(*(partition_by or {}).get(name, [])).parquet(f"{self.path}/{folders[name]}")
        draft = self._hadoop(f"{self.path}/manifest/_{attempt}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(json.dumps({"tables": folders, "replaces": list(replaces)}).encode())
        finally:
            stream.close()
        return bool(self._fs.rename(draft, self._hadoop(f"{self.path}/manifest/{batch_id}.json")))

    def sink(self, split):
        """foreachBatch function: publishes what ``split`` (batch -> {table: DataFrame}) makes of a batch."""
        def run(batch: DataFrame, batch_id: int) -> None:
            if not self.is_published(batch_id):
                self.publish(batch_id, split(batch))
        return run

    def read(self, table: str, schema: str) -> DataFrame:
        """All visible rows of a table (``schema`` names the columns it is partitioned by last), and their ``batch``."""
        folders = [f"{self.path}/{f}" for f in self.folders(table)]
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, batch string")
        reader = self.spark.read.schema(f"{schema}, batch string").option("basePath", f"{self.path}/data/{table}")
        return reader.parquet(*folders)

    def vacuum(self) -> int:
        """Remove the folders that readers don't see (of attempts that are over); returns how many."""
        gone = 0
        for table in self._names(f"{self.path}/data"):
            seen = set(self.folders(table))
            for folder in self._names(f"{self.path}/data/{table}"):
                if f"data/{table}/{folder}" not in seen:
                    gone += bool(self._fs.delete(self._hadoop(f"{self.path}/data/{table}/{folder}"), True))
        return gone
