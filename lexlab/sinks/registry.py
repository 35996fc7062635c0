"""Append-only model registry.

A record is one small JSON file whose name is its version; a file is created only
if it is not there.  The file system decides between writers by its exclusive create
(HDFS; local folders by the operating system's own; a store without one is not enough).  Whoever comes second sees the conflict and takes the
next version, so nothing is ever overwritten and no version is given twice.  A
promotion is a record as well.  Files that a dying writer left half-written are not
read as records, but keep their version.
"""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "version bigint, kind string, model string, payload string"


class VersionTaken(Exception):
    """Another writer has this version."""


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def last_version(spark: SparkSession, root: str) -> int:
    """The highest version in the registry, 0 if it is empty."""
    fs, p = _fs(spark, root)
    if not fs.exists(p):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return max([int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json") and n[1:-5].isdigit()], default=0)


def write_version(spark: SparkSession, root: str, version: int, kind: str, model: str, payload: Mapping[str, object]) -> None:
    """Create exactly this version; :class:`VersionTaken` if it is there."""
    fs, p = _fs(spark, f"{root}/v{version:012d}.json")
    record = json.dumps({"version": version, "kind": kind, "model": model, "payload": json.dumps(dict(payload), sort_keys=True)})
    body = bytearray((record + "\n").encode())
    try:
        if fs.getUri().getScheme() == "file":  # Hadoop's local create looks first and creates then
            jvm, gateway = spark._jvm, spark.sparkContext._gateway
            fs.mkdirs(p.getParent())
            options = gateway.new_array(jvm.java.nio.file.OpenOption, 2)
            options[0], options[1] = jvm.java.nio.file.StandardOpenOption.CREATE_NEW, jvm.java.nio.file.StandardOpenOption.WRITE
            jvm.java.nio.file.Files.write(fs.pathToFile(p).toPath(), body, options)
        else:
            stream = fs.create(p, False)
            try:
                stream.write(body)
            finally:
                stream.close()
    except Exception as e:
        if "AlreadyExists" in str(e) or "already exists" in str(e).lower():
            raise VersionTaken(version) from None
        raise


def append(spark: SparkSession, root: str, kind: str, model: str, payload: Mapping[str, object], tries: int = 1000) -> int:
    """Append a record as the next version, past other writers; returns its version."""
    for _ in range(tries):
        version = last_version(spark, root) + 1
        try:
            write_version(spark, root, version, kind, model, payload)
            return version
        except VersionTaken:
            continue
    raise RuntimeError("other writers took every version")


def records(spark: SparkSession, root: str) -> DataFrame:
    """All whole records (version, kind, model, payload)."""
    rows = spark.read.schema(SCHEMA).option("mode", "DROPMALFORMED").json(root)
    return rows.filter(F.col("version").isNotNull())


def register(spark: SparkSession, root: str, model: str, payload: Mapping[str, object]) -> int:
    return append(spark, root, "model", model, payload)


def promote(spark: SparkSession, root: str, model: str, version: int, approver: str) -> int:
    """Approve a registered version of ``model``; unknown versions raise."""
    known = records(spark, root).filter((F.col("kind") == "model") & (F.col("model") == model) & (F.col("version") == version))
    if known.count() == 0:
        raise ValueError(f"no version {version} of {model}")
    return append(spark, root, "promotion", model, {"version": version, "approver": approver})


def approved(spark: SparkSession, root: str) -> DataFrame:
    """``model, version, approver, payload``: the version approved last, per model."""
    rows = records(spark, root)
    last = (rows.filter(F.col("kind") == "promotion").groupBy("model").agg(F.max_by("payload", "version").alias("p"))
            .select("model", F.get_json_object("p", "$.version").cast("bigint").alias("version"),
                    F.get_json_object("p", "$.approver").alias("approver")))
    return last.join(rows.filter(F.col("kind") == "model").select("model", "version", "payload"), ["model", "version"])
