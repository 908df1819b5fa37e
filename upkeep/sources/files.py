"""Text sources and sinks: typed CSV scans, guards for missing inputs, small documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def missing_inputs(spark: SparkSession, folder: str, names: Sequence[str]) -> list[str]:
    """The names that the folder does not hold, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [n for n in names if not fs.exists(jvm.org.apache.hadoop.fs.Path(root, n))]


def require_inputs(spark: SparkSession, folder: str, names: Sequence[str]) -> None:
    if missing := missing_inputs(spark, folder, names):
        raise FileNotFoundError(f"{folder} lacks " + ", ".join(missing))


def read_csv(spark: SparkSession, path: str, types: str | None = None) -> DataFrame:
    """A CSV file with a header; its types given, or inferred by one more pass."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    return (reader.schema(types) if types else reader.option("inferSchema", True)).csv(path)


def register_raw(spark: SparkSession, folder: str, names: Sequence[str], prefix: str = "raw_") -> list[str]:
    """A view of each CSV file under its name; all files must be there."""
    require_inputs(spark, folder, [f"{n}.csv" for n in names])
    for n in names:
        read_csv(spark, f"{folder}/{n}.csv").createOrReplaceTempView(f"{prefix}{n}")
    return [f"{prefix}{n}" for n in names]


def to_markdown(df: DataFrame, title: str = "", most: int = 200) -> str:
    """A small report as a Markdown table; a frame of more rows than ``most`` is refused, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", ""] if title else []
    lines += ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]) + "\n"
