"""Versioned tables: data goes to a new folder, then a manifest names it; only what a manifest names is read.

A manifest appears whole or not at all, and no two writers get the same one: it is written beside its place and
then moved there by a rename that fails if the place is taken (a hard link on a local disk). A write
that dies half-way leaves a folder that no manifest names. Old versions stay.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..shared import file_system


class VersionExists(ValueError):
    """Another writer has published this version, or a newer one than the writer knew."""


def _publish(spark: SparkSession, folder: str, name: str, content: dict) -> None:
    """Create folder/name with the content as JSON, or raise VersionExists if it is there."""
    jvm = spark.sparkContext._jvm
    fs, at = file_system(spark, f"{folder}/{name}")
    _, beside = file_system(spark, f"{folder}/.{uuid.uuid4().hex}")
    out = fs.create(beside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    try:
        if fs.exists(at):
            raise VersionExists(f"{name} already exists in {folder}")
        if fs.getUri().getScheme() == "file":
            place = lambda p: jvm.java.nio.file.Paths.get(fs.makeQualified(p).toUri())
            jvm.java.nio.file.Files.createLink(place(at), place(beside))
        else:
            never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            never[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, at, never)
    except Exception as e:
        if not isinstance(e, VersionExists) and "AlreadyExists" in str(e):
            raise VersionExists(f"{name} already exists in {folder}") from e
        raise
    finally:
        fs.delete(beside, False)


def _manifests(root: str) -> str:
    return f"{root}/_manifests"


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the published versions below root, oldest first."""
    fs, at = file_system(spark, _manifests(root))
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(n.removesuffix(".json") for n in names if n.endswith(".json") and not n.startswith("."))


def _manifest(spark: SparkSession, root: str, version: str) -> dict:
    fs, at = file_system(spark, f"{_manifests(root)}/{version}.json")
    if not fs.exists(at):
        raise ValueError(f"no version {version} in {root}")
    stream = fs.open(at)
    text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    stream.close()
    return json.loads(text)


def write_version(df: DataFrame, root: str, at: dt.datetime | None = None, after: str | None = None) -> str:
    """Write df as Parquet to a new version of root named by time; its place, root/version=name, is returned.

    after: the version that df was made from. If another is the latest by now, or the name is taken,
    VersionExists is raised and nothing is published.
    """
    spark = df.sparkSession
    name = f"{at or dt.datetime.now(dt.timezone.utc):%Y%m%d_%H%M%S_%f}"
    folder = f"version={name}/{uuid.uuid4().hex}"
    if name in versions(spark, root):
        raise VersionExists(f"{name} already exists in {root}")
    df.write.mode("error").parquet(f"{root}/{folder}")
    if after is not None:
        _publish(spark, f"{root}/_followers", f"{after}.json", {"by": name})  # each version is followed once
    _publish(spark, _manifests(root), f"{name}.json", {"folder": folder, "after": after})
    return f"{root}/version={name}"


def read_version(spark: SparkSession, root: str, version: str | None = None) -> DataFrame:
    """The rows of one published version below root, the latest if none is named."""
    if version is None:
        named = versions(spark, root)
        if not named:
            raise ValueError(f"nothing is published in {root}")
        version = named[-1]
    return spark.read.parquet(f"{root}/{_manifest(spark, root, version)['folder']}")


def back_up(spark: SparkSession, tables: dict[str, str], root: str, at: dt.datetime | None = None) -> dict[str, str]:
    """Name the latest version of each table (name: root) that has one in a backup published below root. No data is copied: versions stay as they are."""
    held = {name: known[-1] for name, where in tables.items() if (known := versions(spark, where))}
    _publish(spark, f"{root}/_backups", f"{at or dt.datetime.now(dt.timezone.utc):%Y%m%d_%H%M%S_%f}.json", {"tables": tables, "versions": held})
    return held


def restore(spark: SparkSession, root: str, at: dt.datetime, name: str) -> DataFrame:
    """A table as a backup names it."""
    fs, place = file_system(spark, f"{root}/_backups/{at:%Y%m%d_%H%M%S_%f}.json")
    stream = fs.open(place)
    held = json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    stream.close()
    return read_version(spark, held["tables"][name], held["versions"][name])
