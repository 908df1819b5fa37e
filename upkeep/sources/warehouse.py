"""Marts and exports under keys made of what they depend on: built once, found again, never half there.

A key is a digest of the inputs, of the code and of the name.  A table counts as there
once its note is written, after its files; rows, columns and an order-free digest of the
rows are observed while the files are written, so nothing is read again for them.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from upkeep.sources import lineage, store

PARTS = ("functions", "operators", "plans", "sources")


@cache
def code_digest() -> str:
    """A digest of the package's modules that define tables."""
    root = Path(__file__).parent.parent
    digest = hashlib.sha256()
    for p in sorted(p for part in PARTS for p in (root / part).glob("*.py")):
        digest.update(f"{p.relative_to(root)}:".encode() + p.read_bytes())
    return digest.hexdigest()


def _row_sum(df: DataFrame) -> Column:
    """A sum over rows of two hashes, the same in any order; columns by name."""
    names = sorted(df.columns)
    part = lambda *salt: F.coalesce(F.sum(F.xxhash64(*salt, *(F.col(f"`{n}`") for n in names)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).cast("string")
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), part(), part(F.lit(1))), 256)


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def n_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files of a folder."""
    fs, p = hadoop(spark, path)
    return fs.getContentSummary(p).getLength()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = hadoop(spark, path)
    opened = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(opened, "UTF-8")
    finally:
        opened.close()


def input_manifest(spark: SparkSession, folder: str, tables: Sequence[str]) -> DataFrame:
    """(table, n_rows, n_columns, bytes, digest) of Parquet tables; the digest is of the rows, whatever their order and files."""
    out = None
    for t in tables:
        path = f"{folder}/{t}.parquet"
        df = spark.read.parquet(path)
        one = df.agg(F.count(F.lit(1)).alias("n_rows"), _row_sum(df).alias("digest"))
        one = one.select(F.lit(t).alias("table"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), F.lit(n_bytes(spark, path)).alias("bytes"), "digest")
        out = one if out is None else out.unionByName(one)
    return out


def listing_digest(spark: SparkSession, folder: str, tables: Sequence[str]) -> str:
    """A digest of the names, sizes and times of the tables' files, without reading them; tables that are missing count as such."""
    found = []
    for t in tables:
        fs, p = hadoop(spark, f"{folder}/{t}.parquet")
        if not fs.exists(p):
            continue
        for status in [fs.getFileStatus(p)] if fs.getFileStatus(p).isFile() else fs.listStatus(p):
            found.append((t, status.getPath().getName(), status.getLen(), status.getModificationTime()))
    return hashlib.sha256(json.dumps([folder, sorted(found)]).encode()).hexdigest()


class Warehouse:
    """Tables of one folder, for one state of the inputs and of the code."""

    def __init__(self, spark: SparkSession, folder: str, inputs: str, code: str | None = None):
        """inputs: a digest of all that the tables are made from."""
        self.spark, self.folder = spark, folder.rstrip("/")
        self.state = hashlib.sha256(f"{inputs}|{code or code_digest()}".encode()).hexdigest()
        self.run_id = "RUN-" + self.state[:16].upper()
        self.notes: dict[str, dict] = {}
        self._building: list[str] = []

    @classmethod
    def over(cls, spark: SparkSession, folder: str, inputs: DataFrame, code: str | None = None) -> Warehouse:
        """For the tables of an input manifest, of which there are some."""
        rows = sorted((r["table"], r.digest) for r in inputs.select("table", "digest").collect())
        return cls(spark, folder, hashlib.sha256(json.dumps(rows).encode()).hexdigest(), code)

    def path(self, name: str, kind: str = "parquet") -> str:
        key = hashlib.sha256(f"{self.state}|{name}|{kind}".encode()).hexdigest()[:16]
        return f"{self.folder}/{name}-{key}"

    def table(self, name: str, build: Callable[[], DataFrame], kind: str = "parquet", digest: bool = False, by: str | None = None, order: Sequence[str] = ()) -> DataFrame:
        """The table of a name: read if it is there, else built, with those that it asks for, and written; digest: of its rows; by, order: in sorted buckets, without a digest."""
        if self._building:
            self.notes.setdefault(self._building[-1], {"needs": []})["needs"].append(name)
        path, note = self.path(name, kind), self.path(name, kind) + ".json"
        began = time.perf_counter()
        if exists(self.spark, note):
            known = json.loads(read_text(self.spark, note))
            if name not in self.notes or "status" not in self.notes[name]:
                self.notes[name] = known | {"status": "reused", "seconds": round(time.perf_counter() - began, 3)}
        else:
            self._building.append(name)
            self.notes[name] = {"needs": []}
            try:
                df = build()
            finally:
                self._building.pop()
            seen, buckets = Observation(), 0
            lineage.written(path, df)
            if by:
                buckets = store.save_bucketed(df, path, by, order)
                stats = {"n_rows": self.spark.read.schema(df.schema).parquet(path).count()}  # from the files' footers
            else:
                self._write(df, path, kind, seen, digest)
                stats = seen.get
            known = {"object": name, "kind": kind, "n_rows": stats["n_rows"], "n_columns": len(df.columns), "bytes": n_bytes(self.spark, path), "digest": stats.get("digest", ""), "needs": sorted({*self.notes[name]["needs"]}), "schema": df.schema.json(), "reads": sorted({p for p, _ in lineage.reads(df)}), "buckets": buckets}
            write_text(self.spark, note, json.dumps(known))
            self.notes[name] = known | {"status": "built", "seconds": round(time.perf_counter() - began, 3)}
        schema = StructType.fromJson(json.loads(known["schema"]))
        if by:
            return store.read_bucketed(self.spark, path, schema, by, order, known["buckets"])
        reader = self.spark.read.schema(schema)
        return (reader.option("header", True) if kind == "csv" else reader).format(kind).load(path)

    @staticmethod
    def _write(df: DataFrame, path: str, kind: str, seen: Observation, digest: bool) -> None:
        writer = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), *([_row_sum(df).alias("digest")] if digest else [])).write.mode("overwrite")
        with store.compiled_small(df.sparkSession):
            (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)

    def export(self, objects: dict[str, Callable[[], DataFrame]], kind: str = "csv") -> DataFrame:
        """All objects under their names, and the execution manifest, also written as ``manifest-<run id>.json``.

        (run_id, object, n_rows, n_columns, bytes, digest, needs, status, seconds); an
        object that fails ends the run, and what was built before stays for the next.
        """
        for name, build in objects.items():
            self.table(f"export_{name}", build, kind, digest=True)
        rows = [(self.run_id, n, *(self.notes[f"export_{n}"][c] for c in ("n_rows", "n_columns", "bytes", "digest")), "|".join(self.notes[f"export_{n}"]["needs"]), self.notes[f"export_{n}"]["status"], self.notes[f"export_{n}"]["seconds"]) for n in objects]
        names = ["run_id", "object", "n_rows", "n_columns", "bytes", "digest", "needs", "status", "seconds"]
        write_text(self.spark, f"{self.folder}/manifest-{self.run_id}.json", json.dumps([dict(zip(names, r, strict=True)) for r in rows], indent=1))
        return self.spark.createDataFrame(rows, "run_id string, object string, n_rows long, n_columns int, bytes long, digest string, needs string, status string, seconds double")
