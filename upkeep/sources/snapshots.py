"""Published snapshots of an external folder: staged, checked, and switched to at once; until then readers see the old one.

A managed folder holds versions, each whole, and a file that names the current one.
Publishing writes a new version beside the others and renames that file over the old
one, so a failure at any step leaves the current version as it was.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from upkeep.sources.warehouse import exists, hadoop, input_manifest, read_text, write_text

CURRENT = "CURRENT"
_MANAGED = re.compile(r"(version|staged)-[0-9a-f]{32}|CURRENT(-[0-9a-f]{32})?")


class Snapshots:
    """Versions of some tables in a managed folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def current(self) -> str | None:
        """The folder of the current version; None before the first."""
        note = f"{self.folder}/{CURRENT}"
        return f"{self.folder}/{json.loads(read_text(self.spark, note))['version']}" if exists(self.spark, note) else None

    def publish(self, tables: Mapping[str, DataFrame], check: Callable[[str], Sequence[str]] = lambda folder: ()) -> str:
        """Stages the tables, checks the staged folder, and switches to it; returns its folder.

        check: faults of a folder; any of them refuses the snapshot.  What was staged is
        removed then, and when a write fails.
        """
        number = uuid.uuid4().hex
        staged, version = f"{self.folder}/staged-{number}", f"{self.folder}/version-{number}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{staged}/{name}.parquet")
            if faults := list(check(staged)):
                raise ValueError("snapshot refused: " + "; ".join(faults))
            fs, source = hadoop(self.spark, staged)
            if not fs.rename(source, hadoop(self.spark, version)[1]):
                raise OSError(f"{staged} can't become {version}")
        except BaseException:
            self._remove([f"staged-{number}"])
            raise
        self._point(f"version-{number}", sorted(tables))
        return version

    def _point(self, version: str, tables: Sequence[str]) -> None:
        """Names the current version: one rename over the old note."""
        note = f"{self.folder}/{CURRENT}-{uuid.uuid4().hex}"
        write_text(self.spark, note, json.dumps({"version": version, "tables": list(tables)}))
        jvm = self.spark.sparkContext._jvm
        _, source = hadoop(self.spark, note)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        over = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        over[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(source, hadoop(self.spark, f"{self.folder}/{CURRENT}")[1], over)

    def _names(self) -> list[str]:
        if not exists(self.spark, self.folder):
            return []
        fs, p = hadoop(self.spark, self.folder)
        return [s.getPath().getName() for s in fs.listStatus(p)]

    def _remove(self, names: Sequence[str]) -> list[str]:
        """Removes managed entries of the folder, never others."""
        gone = [n for n in names if _MANAGED.fullmatch(n)]
        for n in gone:
            fs, p = hadoop(self.spark, f"{self.folder}/{n}")
            fs.delete(p, True)
        return gone

    def reset(self, everything: bool = False) -> list[str]:
        """Removes old versions and what failed runs left; with ``everything`` the current version too.  Files that are not the area's own stay."""
        now = self.current()
        kept = set() if everything or now is None else {CURRENT, now.rsplit("/", 1)[1]}
        return self._remove(sorted(n for n in self._names() if n not in kept))

    def manifest(self) -> DataFrame:
        """(table, n_rows, n_columns, bytes, digest) of the current version."""
        now = self.current()
        if now is None:
            raise FileNotFoundError(f"{self.folder} has no snapshot")
        tables = json.loads(read_text(self.spark, f"{self.folder}/{CURRENT}"))["tables"]
        return input_manifest(self.spark, now, tables)
