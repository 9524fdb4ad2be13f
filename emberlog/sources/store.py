"""Tables that are changed together: versions, published one at a time, by whoever comes first.

A version is a small file ``versions/v<n>`` that names the folder of each table. A change reads the latest version, writes its new tables to folders of
their own, and publishes version n + 1 by creating that file only if it is not there. If another writer was faster, the change is made again from what that
one published, so nothing is lost; if a writer dies in between, its folders are in no version and the tables are as they were. Readers keep the folders of the version that they began with.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Mapping
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

from emberlog.operators import ledger as L
from emberlog.sources.tables import listed, numbered

Tables = Mapping[str, DataFrame]


class Conflict(RuntimeError):
    """Other writers were faster each time."""


def create_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with its whole text, unless it exists: a file of another name is written first and then takes this one."""
    jvm, draft = spark._jvm, f"{path}.{uuid.uuid4().hex}"
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.getUri().getScheme() == "file":
        own = Path(urlparse(draft).path)
        own.write_text(text)
        try:
            os.link(own, urlparse(path).path)  # local renames replace
            return True
        except FileExistsError:
            return False
        finally:
            own.unlink()
    out = fs.create(jvm.org.apache.hadoop.fs.Path(draft), False)
    out.write(bytearray(text.encode()))
    out.close()
    no_overwrite = spark._sc._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    no_overwrite[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(jvm.org.apache.hadoop.fs.Path(draft), target, no_overwrite)
        return True
    except Exception as e:  # noqa: BLE001 - py4j wraps what the file system throws
        fs.delete(jvm.org.apache.hadoop.fs.Path(draft), False)
        if "AlreadyExists" in str(e):
            return False
        raise


class Store:
    """Named tables under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> int:
        """The latest version; 0 has no tables."""
        return max(numbered(self.spark, f"{self.folder}/versions", "v"), default=0)

    def _named(self, version: int) -> dict[str, str]:
        if not version:
            return {}
        return json.loads("".join(r["value"] for r in self.spark.read.text(f"{self.folder}/versions/v{version}").collect()))

    def tables(self, version: int | None = None) -> dict[str, DataFrame]:
        named = self._named(self.version() if version is None else version)
        return {name: self.spark.read.parquet(f"{self.folder}/data/{part}") for name, part in named.items()}

    def commit(self, change: Callable[[Tables], Tables], attempts: int = 10) -> int:
        """Publishes what ``change`` makes of the latest tables (those that it returns; the others stay), and gives the version."""
        for _ in range(attempts):
            base = self.version()
            named = self._named(base)
            for name, rows in change(self.tables(base)).items():
                part = f"{name}-{uuid.uuid4().hex}"
                rows.write.parquet(f"{self.folder}/data/{part}")
                named[name] = part
            if create_if_absent(self.spark, f"{self.folder}/versions/v{base + 1}", json.dumps(named, sort_keys=True)):
                return base + 1
        raise Conflict(f"{attempts} attempts met versions of others")

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> int:
        """Rows take the place of stored ones with equal keys."""
        return self.commit(lambda t: {name: L.upserted(t[name], rows, keys) if name in t else rows})

    def supersede(self, run_id: str, start: str, end: str, runs: str = "runs") -> int:
        """Completes a run, and marks what it replaces, in one version."""
        return self.commit(lambda t: {runs: L.superseded(t[runs], run_id, start, end)})

    def maintain(self, cutoff: str) -> int:
        """Retention of facts, namespaces, legacy rows and both rollups, all in one version: rows are deleted only with the rollups that hold them."""

        def change(t: Tables) -> Tables:
            return L.maintain(t["facts"], t["namespaces"], t["legacy"], t["kind_rollups"], t["namespace_rollups"], cutoff)

        return self.commit(change)

    def vacuum(self, keep: int = 2) -> int:
        """Deletes folders that none of the last ``keep`` versions names, and older versions; not while another writer works. The number of folders deleted."""
        versions = numbered(self.spark, f"{self.folder}/versions", "v")
        used = {part for v in versions[-keep:] for part in self._named(v).values()}
        gone = [p for p in listed(self.spark, f"{self.folder}/data") if p not in used]
        for path in [f"data/{p}" for p in gone] + [f"versions/v{v}" for v in versions[:-keep]]:
            full = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}")
            full.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(full, True)
        return len(gone)
