"""Readers of files: whole documents in any store that Spark reads, parsed at scale, with a list of what was refused and why."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .formats import first_engine


def documents(spark: SparkSession, root: str, pattern: str = "*", name: Column | None = None) -> DataFrame:
    """(media_id, path, modified, bytes, content, text) of each file below root whose name fits; files are packed into partitions by size.

    media_id is the folder that holds the file, or name, an expression over path. text is null if content isn't UTF-8.
    Spark reads no row from a file of no bytes, so those are told from the list of files, which it keeps on the driver.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    text = F.col("content").cast("string")
    folder = F.element_at(F.split("path", "/"), -2)
    named = f.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content", F.when(F.is_valid_utf8(text), text).alias("text"))
    listed = spark.createDataFrame([(unquote(p).replace("file:///", "file:/", 1),) for p in f.inputFiles()], "path string")
    bare = listed.join(f.select("path"), "path", "left_anti").select("path", F.lit(None).cast("timestamp").alias("modified"), F.lit(0).cast("long").alias("bytes"), F.lit(b"").alias("content"), F.lit("").alias("text"))
    return named.unionByName(bare).select((name if name is not None else folder).alias("media_id"), "*")


def refusal(json: bool) -> Column:
    """Why a document has no row: empty, not UTF-8, not JSON, or nothing in it that counts."""
    why = F.when(F.col("bytes") == 0, "empty").when(F.col("text").isNull(), "not UTF-8").when(F.btrim("text", F.lit(" \t\r\n")) == "", "empty")
    return (why.when(F.try_parse_json("text").isNull(), "not JSON") if json else why).otherwise("nothing in it")


def read_files(docs: DataFrame, parse: Callable[[DataFrame], DataFrame], column: str = "json") -> tuple[DataFrame, DataFrame]:
    """(rows, refused): what a parser of (media_id, column) makes of documents, with path, and (media_id, path, reason) of those without any row."""
    keyed = docs.withColumnRenamed("media_id", "_media")
    parsed = parse(keyed.where(F.col("text").isNotNull()).select(F.col("path").alias("media_id"), F.col("text").alias(column)))
    rows = parsed.withColumnRenamed("media_id", "path").join(keyed.select("path", F.col("_media").alias("media_id")), "path")
    bare = keyed.join(parsed.select(F.col("media_id").alias("path")).distinct(), "path", "left_anti")
    return rows, bare.select(F.col("_media").alias("media_id"), "path", refusal(column == "json").alias("reason"))


def read_lines(docs: DataFrame) -> DataFrame:
    """(media_id, line_no, line) of documents."""
    return docs.where(F.col("text").isNotNull()).select("media_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))


def read_engines(read: dict[str, tuple[DataFrame, DataFrame]], order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(rows, failures) of several engines' files: each medium's rows are those of the first engine, by order, that has any.

    read: engine: (rows, refused) of read_files. failures: (media_id, engine, reason) of the engines tried before
    that one, in order, or of all where none has rows; an engine without a file for the medium failed too.
    """
    known = [n for n in order if n in read]
    rows = first_engine({n: r for n, (r, _) in read.items()}, tuple(known))
    won = rows.select("media_id", "engine").distinct().withColumn("_won", _rank(F.col("engine"), known)).drop("engine")
    media, refused = None, None
    for n, (r, bad) in read.items():
        seen = r.select("media_id").union(bad.select("media_id"))
        said = bad.select("media_id", F.lit(n).alias("engine"), "reason")
        media, refused = (seen, said) if media is None else (media.union(seen), refused.union(said))
    tried = media.distinct().join(won, "media_id", "left").withColumn("engine", F.explode(F.array(*map(F.lit, known))))
    tried = tried.where(F.col("_won").isNull() | (_rank(F.col("engine"), known) < F.col("_won")))
    reasons = refused.groupBy("media_id", "engine").agg(F.min("reason").alias("reason"))
    return rows, tried.join(reasons, ["media_id", "engine"], "left").select("media_id", "engine", F.coalesce("reason", F.lit("no file")).alias("reason"))


def _rank(engine: Column, known: list[str]) -> Column:
    return F.array_position(F.array(*map(F.lit, known)), engine)


def write_documents(docs: DataFrame, root: str) -> None:
    """One file for each row of (media_id, text), below root/media_id=..., a line feed at its end; a null text makes a blank file."""
    docs.select("media_id", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("media_id").text(root)


def pack_documents(docs: DataFrame, root: str) -> None:
    """The same documents as write_documents, byte for byte, many in one file: rows of name and content below root.

    A store takes milliseconds to create, name and list a file, however small; a file of many documents costs that once.
    """
    name = F.concat(F.lit("media_id="), F.col("media_id").cast("string"))
    docs.select(name.alias("name"), F.concat(F.coalesce("text", F.lit("")), F.lit("\n")).cast("binary").alias("content")).write.parquet(root)


def packed_documents(spark: SparkSession, root: str) -> DataFrame:
    """(media_id, path, modified, bytes, content, text) of packed documents: as documents tells them, media_id being the name."""
    f = spark.read.schema("name string, content binary").parquet(root)
    text = F.col("content").cast("string")
    path = F.concat(F.lit(root.rstrip("/") + "/"), "name")
    return f.select(F.col("name").alias("media_id"), path.alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.octet_length("content").cast("long").alias("bytes"), "content", F.when(F.is_valid_utf8(text), text).alias("text"))
