"""Sinks: tables, registries, manifests."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.contracts import ContractError


def write_table(df: DataFrame, path: str, by: Sequence[str] = (), overwrite: bool = False, fmt: str = "parquet") -> None:
    """Write a table, by default refusing to replace one; `by` partitions its folders, so that readers prune."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def append_new(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append rows whose keys a table does not have yet."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        df = df.join(spark.read.parquet(path).select(*keys), list(keys), "left_anti")
    df.write.mode("append").parquet(path)


def _file(spark: SparkSession, path: str):
    """(file system, path) where Spark reaches a file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """A small document, UTF-8, indented, in any store that Spark reaches; what JSON lacks is written as text."""
    fs, p = _file(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(bytearray(json.dumps(value, indent=2, ensure_ascii=False, default=str).encode("utf-8")))
    finally:
        stream.close()


def read_json(spark: SparkSession, path: str) -> object:
    """A small document; null where there is none."""
    fs, p = _file(spark, path)
    return json.loads(spark.read.text(path, wholetext=True).first()["value"]) if fs.exists(p) else None


def update_json(spark: SparkSession, path: str, **values: object) -> dict:
    """Read, change and write a registry."""
    new = (read_json(spark, path) or {}) | values
    write_json(spark, new, path)
    return new


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of all files below a path, hashed where they are read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def manifest(spark: SparkSession, inputs: str, config: dict, status: str = "running") -> dict:
    """Provenance of a run: its configuration, versions and the hashes of what it reads (one entry for each file)."""
    import platform

    import pyspark

    files = {r["path"]: r["sha256"] for r in file_hashes(spark, inputs).orderBy("path").collect()}
    return {"status": status, "config": config, "versions": {"python": platform.python_version(), "pyspark": pyspark.__version__}, "inputs": files}


def changed_files(spark: SparkSession, inputs: str, before: dict) -> list[str]:
    """Files that a manifest has otherwise than they are now, gone and new ones among them."""
    now = {r["path"]: r["sha256"] for r in file_hashes(spark, inputs).collect()}
    old = before["inputs"]
    return sorted(p for p in now.keys() | old.keys() if now.get(p) != old.get(p))


def checked_reference(spark: SparkSession, path: str, inputs: str, version: str, protocol: dict) -> dict:
    """The manifest of a finished run that may stand as a reference: same version, same protocol and unchanged files, else an error that names what differs."""
    found = read_json(spark, path)
    if found is None:
        raise ContractError(f"no manifest at {path}")
    wrong = [f"status {found.get('status')}"] if found.get("status") != "complete" else []
    config = found.get("config", {})
    wrong += [f"version {config.get('version')}"] if config.get("version") != version else []
    wrong += [f"{k} = {config.get(k)!r}" for k, v in protocol.items() if config.get(k) != v]
    wrong += [f"changed {p}" for p in changed_files(spark, inputs, found)]
    if wrong:
        raise ContractError("; ".join(wrong))
    return found


def markdown(df: DataFrame, title: str, columns: Sequence[str]) -> DataFrame:
    """A table as lines of Markdown, one for each row; write them with the text sink."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |"))
    head = df.sparkSession.createDataFrame([(f"# {title}",), ("",), ("| " + " | ".join(columns) + " |",), ("|" + " --- |" * len(columns),)], "value string")
    return head.unionByName(df.select(line.alias("value")))
