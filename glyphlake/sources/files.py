"""Files in and out: text, whole folders, records, tables of pairs."""

from __future__ import annotations

import functools
import os
import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F


def read_files(spark: SparkSession, path: str | list[str], pattern: str | None = None) -> DataFrame:
    """(path, modificationTime, length, content) of the files of a folder and those below it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def text_runs(files: DataFrame) -> DataFrame:
    """(doc_id, text, valid): each file a run; text is null where the file isn't UTF-8."""
    text = F.col("content").cast("string")
    valid = F.is_valid_utf8(text)
    return files.select(F.col("path").alias("doc_id"), F.when(valid, text).alias("text"), valid.alias("valid"))


def write_text(texts: DataFrame, path: str, column: str = "text") -> None:
    texts.select(column).write.text(path)


def write_lines(values: DataFrame, path: str) -> None:
    """A file of lines in each partition, from one string column."""
    values.write.text(path)


def kept(df: DataFrame, folder: str | None = None) -> tuple[DataFrame, str]:
    """df as a table, and its folder: what takes long is done once, and a lost executor costs its tasks only.

    The folder lies in the one that the cluster shares, spark.checkpoint.dir, if no other is named.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    base = folder or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="glyphlake-")
        context.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def below(path: str, root: str) -> str:
    """A file's place below a root, both with a scheme or without."""
    plain = lambda p: re.sub("^[a-z0-9]+:(//[^/]*)?(?=/)", "", p)
    return posixpath.relpath(unquote(plain(path)) if ":" in path else path, plain(root))


def write_contents(files: DataFrame, folder: str, root: str) -> DataFrame:
    """Writes (path, content) below a folder of any file system that pyarrow knows (a URL, or a path on this machine or mounted on all), at their places below root; returns (path, written). Run it by an action.

    A file is written under another name and moved, so a task may run twice.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if "://" in folder or folder.startswith("file:"):
            system, base = fs.FileSystem.from_uri(folder)
        else:
            system, base = fs.LocalFileSystem(), os.path.abspath(folder)
        for batch in batches:
            done = []
            for path, content in zip(batch["path"], batch["content"]):
                target = posixpath.join(base, below(path, root))
                system.create_dir(posixpath.dirname(target), recursive=True)
                draft = f"{target}.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as file:
                    file.write(bytes(content))
                system.move(draft, target)
                done.append((path, target))
            yield pd.DataFrame(done, columns=["path", "written"])

    return files.select("path", "content").mapInPandas(write, "path string, written string")


def pair_table(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of an XML table of <book> rows, key in <price> and value in <title>: trimmed, both must be there; the last of a key counts.

    Files are read whole, so that a row's place in its file is known; of several files the one that comes last by name counts.
    """
    book = "<book(?=[\\s>]).*?</book>"
    field = lambda name: F.trim(F.regexp_replace(F.regexp_extract("row", f"(?s)<{name}[^>]*>(.*?)</{name}>", 1), "(?s)<!\\[CDATA\\[(.*?)\\]\\]>", "$1"), F.lit(" \t\r\n"))
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.regexp_extract_all("value", F.lit(f"(?s){book}"), F.lit(0))).alias("at", "row"))
    plain = lambda c: functools.reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")], c)
    placed = rows.select(plain(field("price")).alias("key"), plain(field("title")).alias("value"), F.struct("file", "at").alias("place"))
    return placed.filter("key <> '' and value <> ''").groupBy("key").agg(F.max_by("value", "place").alias("value"))
