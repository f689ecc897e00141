"""Manifests of runs, and inventories of what they left."""

from __future__ import annotations

import hashlib
import json
import subprocess
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schema_hash(df: DataFrame) -> str:
    """16 hex digits that depend on the column names, not on their order."""
    return hashlib.sha256(",".join(sorted(df.columns)).encode()).hexdigest()[:16]


def schema_summary(df: DataFrame) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in df.schema}


def _path(spark: SparkSession, name: str):
    """A path of any file system that Spark reaches, and that system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def files_below(spark: SparkSession, name: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of all files in a folder and below, by path; none if it isn't there."""
    path, fs = _path(spark, name)
    if not fs.exists(path):
        return []
    found, left = [], fs.listFiles(path, True)
    while left.hasNext():
        status = left.next()
        found.append((str(status.getPath()), status.getLen()))
    return sorted(found)


def file_digests(spark: SparkSession, names: list[str], digits: int = 16) -> dict[str, str]:
    """The first digits of each file's SHA-256, worked out by the executors (a file is read as one value, so up to 2 GB)."""
    if not names:
        return {}
    rows = spark.read.format("binaryFile").load(names).select("path", F.substring(F.sha2("content", 256), 1, digits).alias("digest"))
    return {r["path"]: r["digest"] for r in rows.collect()}


def file_digest(path: str, digits: int = 16) -> str:
    """The same of a file on the driver's machine."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest()[:digits]


def save_text(spark: SparkSession, text: str, path: str) -> None:
    """Writes a small text to a path of any file system that Spark reaches."""
    at, fs = _path(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def git_commit(folder: str = ".") -> str | None:
    found = subprocess.run(["git", "rev-parse", "HEAD"], cwd=folder, capture_output=True, text=True)
    return found.stdout.strip() or None if found.returncode == 0 else None


def save_json(spark: SparkSession, value, path: str) -> None:
    save_text(spark, json.dumps(value, indent=2, sort_keys=True, default=str), path)


def run_manifest(spark: SparkSession, step: str, outputs: list[str], config: dict, path: str | None = None) -> dict:
    """What a step made: sizes and digests of the files that exist, the commit, the settings. Paths may be on any file system that Spark reaches."""
    found = [f for name in outputs for f in files_below(spark, name)]
    digests = file_digests(spark, [name for name, size in found if size])
    made = [{"path": name, "bytes": size, "sha256": digests.get(name, hashlib.sha256(b"").hexdigest()[:16])} for name, size in found]
    manifest = {"step": step, "created": datetime.now(UTC).isoformat(), "commit": git_commit(), "config": config, "outputs": made}
    if path:
        save_json(spark, manifest, path)
    return manifest


def done_already(spark: SparkSession, outputs: list[str], overwrite: bool) -> bool:
    """Whether a stage can be skipped: all its outputs exist and none is to be replaced."""
    return not overwrite and bool(outputs) and all(fs.exists(path) for path, fs in (_path(spark, name) for name in outputs))


def inventory(expected: DataFrame, present: DataFrame) -> DataFrame:
    """(step, name, status) of expected artifacts: PRESENT, MISSING, or SYMBOLIC_NAME for names with a placeholder."""
    there = present.select(F.col("name").alias("_there")).distinct()
    status = F.when(F.col("name").rlike(r"[{}*<>]"), "SYMBOLIC_NAME").when(F.col("_there").isNotNull(), "PRESENT").otherwise("MISSING")
    return expected.join(there, expected["name"] == there["_there"], "left").select("step", "name", status.alias("status"))


def missing_rates(listed: DataFrame) -> DataFrame:
    """For each step of an inventory, how many artifacts it has and which share is missing."""
    return listed.groupBy("step").agg(F.count("*").alias("artifacts"), F.count_if(F.col("status") == "MISSING").alias("missing")).withColumn("missing_rate", F.col("missing") / F.col("artifacts"))


def from_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table from the driver, such as the names of artifacts."""
    return spark.createDataFrame(rows, schema)
