"""Bibliographic records and annotated texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NAME = T.StructType([T.StructField(n, T.StringType()) for n in ("family", "given", "literal", "non-dropping-particle", "dropping-particle", "suffix")])
CSL = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("citation-key", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.ArrayType(_NAME)),
        T.StructField("editor", T.ArrayType(_NAME)),
        T.StructField("issued", T.StructType([T.StructField("date-parts", T.ArrayType(T.ArrayType(T.StringType())))])),
    ]
)


def csl_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of JSON files, an array each. Of records with one key (citation key, else id), the last stays.

    Files that hold no array are refused: their first character that is no white space tells.
    """
    heads = spark.read.format("binaryFile").load(path).select("path", F.regexp_extract(F.substring("content", 1, 4096).cast("string"), r"^\x{feff}?\s*(\S)", 1).alias("first"))
    wrong = heads.filter("first <> '['").select("path").first()
    if wrong:
        raise ValueError(f"not an array of records: {wrong[0]}")
    rows = spark.read.schema(CSL).json(path, multiLine=True)
    rows = rows.withColumn("key", F.coalesce("citation-key", "id")).withColumn("_at", F.monotonically_increasing_id())
    last = rows.filter("key is not null").groupBy("key").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in CSL.names]), "_at").alias("r"))
    return last.select("key", "r.*")


def issues(record: Column) -> Column:
    """What is wrong with a record: an array of messages, empty if nothing is."""
    tests = [(record["type"].isNull(), "error: no type"), (record["id"].isNull(), "warning: no id"), (record["title"].isNull(), "warning: no title"), (record["author"].isNull() & record["editor"].isNull(), "warning: no author"), (record["issued"].isNull(), "warning: no date")]
    return F.filter(F.array(*[F.when(t, F.lit(m)) for t, m in tests]), lambda x: x.isNotNull())


_OPEN = r"<!--\s*feature:([\w-]+)\s+id:([\w-]+)\s*-->"
_CLOSE = r"<!--\s*/feature\s*-->"


def regions(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, place, feature, region_id and content of annotated regions; one that is never closed is left out."""
    pattern = rf"(?s)\n[ \t]*{_OPEN}[ \t]*\n(.*?)\n?[ \t]*{_CLOSE}[ \t]*(?=\n|$)"
    body = F.concat(F.lit("\n"), F.col(text))
    found = F.arrays_zip(*[F.regexp_extract_all(body, F.lit(pattern), F.lit(i)).alias(n) for i, n in ((1, "feature"), (2, "region_id"), (3, "content"))])
    return rows.select(key, F.posexplode(found).alias("place", "r")).select(key, F.col("place").cast("long").alias("place"), "r.feature", "r.region_id", F.trim(F.col("r.content")).alias("content"))


def without_annotations(text: Column) -> Column:
    """The text without its annotation lines; other comments stay."""
    kept = F.filter(F.split(text, "\n", -1), lambda line: ~F.trim(line).rlike(rf"^(?:{_OPEN}|{_CLOSE})$"))
    return F.array_join(kept, "\n")
