"""Files as content-addressed rows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import session

#: Kinds of content by file ending; others are octet streams.
TYPES = {"pdf": "application/pdf", "md": "text/markdown", "txt": "text/plain", "html": "text/html", "json": "application/json"}


def content_path(digest: Column, ending: Column, base: str) -> Column:
    """base/ab/cd/<digest><ending>, after the first four digits of the digest."""
    return F.concat_ws("/", F.lit(base), F.substring(digest, 1, 2), F.substring(digest, 3, 2), F.concat(digest, ending))


def acquire(spark: SparkSession, paths: str | list[str], base: str = "store") -> DataFrame:
    """original_path, length, content_hash (SHA-256), mime_type and storage_path of files.

    Addresses (http:, https:, ftp:, file:) and paths that are not there or can't be read are refused with a reason. Of a folder
    the files in it are taken, those with hidden names (`.` or `_` first) left out; empty files are files as all others.
    """
    return _described(_contents(spark, paths), base).drop("content")


def store(spark: SparkSession, paths: str | list[str], base: str) -> DataFrame:
    """What `acquire` gives, with copied: whether this run has put the content into the store below `base`, where it then is.

    A content is written under a name of its own and renamed, so that the store never holds part of one, whatever stops; what
    is there with its length stays. `base` must be on a file system that driver and executors share, and that pyarrow can open.
    """
    hadoop, place = session.files(spark, base)
    root = place.makeQualified(hadoop.getUri(), hadoop.getWorkingDirectory()).toString().rstrip("/")
    fs.FileSystem.from_uri(root)  # refused here, not in a task, if there is no such file system

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, top = fs.FileSystem.from_uri(root)
        for batch in batches:
            copied = []
            for data, path in zip(batch.column("content"), batch.column("place").to_pylist(), strict=True):
                data, path = data.as_buffer(), f"{top}/{path}"
                there = target.get_file_info(path)
                copied.append(there.type != fs.FileType.File or there.size != data.size)
                if copied[-1]:
                    target.create_dir(path.rpartition("/")[0])
                    own = f"{path}.{uuid.uuid4().hex}"
                    with target.open_output_stream(own, compression=None) as out:
                        out.write(data)
                    target.move(own, path)
            rest = batch.drop_columns(["content", "place"])
            yield rest.append_column("copied", pa.array(copied, pa.bool_()))

    rows = _described(_contents(spark, paths), root)
    kept = [c for c in rows.columns if c != "content"]
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(kept).dtypes)
    place_in = F.substring("storage_path", len(root) + 2, 1_000_000)
    return rows.withColumn("place", place_in).select("content", "place", *kept).mapInArrow(task, f"{kinds}, copied boolean")


def _contents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, length and content of files, empty ones included; paths that can't be taken are refused."""
    empty = []
    for path in [paths] if isinstance(paths, str) else paths:
        if path.lower().startswith(("http://", "https://", "ftp://", "file:")):
            raise ValueError(f"not a path: {path}")
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        found = files.globStatus(place)
        if not found:
            raise FileNotFoundError(f"no file: {path}")
        for status in found:
            try:
                if status.isFile():
                    files.open(status.getPath()).close()
                    inside = [status]
                else:
                    inside = files.listStatus(status.getPath())
                empty += [f.getPath().toString() for f in inside if f.isFile() and not f.getLen() and not f.getPath().getName().startswith((".", "_"))]
            except Py4JJavaError as why:
                raise PermissionError(f"can't be read: {path}") from why
    rows = spark.read.format("binaryFile").load(paths).select("path", "length", "content")  # Spark leaves empty files out
    return rows.union(spark.createDataFrame([(p, 0, b"") for p in sorted(set(empty))], "path string, length long, content binary")) if empty else rows


def _described(rows: DataFrame, base: str) -> DataFrame:
    """original_path, length, content_hash, mime_type, content and storage_path of (path, length, content)."""
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    kind = F.try_element_at(F.create_map(*[F.lit(x) for pair in TYPES.items() for x in pair]), F.regexp_replace(ending, r"^\.", ""))
    hashed = rows.select(F.col("path").alias("original_path"), "length", F.sha2("content", 256).alias("content_hash"), ending.alias("ending"), F.coalesce(kind, F.lit("application/octet-stream")).alias("mime_type"), "content")
    return hashed.withColumn("storage_path", content_path(F.col("content_hash"), F.col("ending"), base)).drop("ending")


def texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """original_path and whole text of text files."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("original_path"), F.col("value").alias("text"))


def front_matter_entry(text: Column, field: str = "bibliography") -> Column:
    """The first entry of a field in a text's YAML head: a scalar, an inline list or a block list; null without one."""
    head = F.regexp_extract(F.array_join(F.slice(F.split(text, "\n", -1), 1, 50), "\n"), r"(?s)^---\n(.*?)\n(?:---|\.\.\.)", 1)
    raw = F.regexp_extract(head, rf"(?m)^{field}:[ \t]*(?:\[\s*([^,\]\n]+)|\n\s*-\s*([^\n]+)|([^\[\n]+))", 0)
    value = F.trim(F.regexp_replace(raw, rf"(?s)^{field}:\s*\[?\s*(?:-\s+)?|\s+#.*$", ""))
    value = F.regexp_replace(value, r"""^["']|["']$""", "")
    return F.when(value != "", value)
