"""Functions for SQL: `register` makes them known to a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: SQL functions that are expressions, and so stay in the JVM.
EXPRESSIONS = {
    "token_estimate(t STRING) RETURNS BIGINT": "CAST(floor(length(t) / 4) AS BIGINT)",
    "sigmoid(x DOUBLE) RETURNS DOUBLE": "CASE WHEN x >= 0 THEN 1 / (1 + exp(-x)) ELSE exp(x) / (1 + exp(x)) END",
    "content_path(digest STRING, ending STRING) RETURNS STRING": "concat_ws('/', substring(digest, 1, 2), substring(digest, 3, 2), concat(digest, ending))",
    "section_path(a STRING, b STRING, c STRING, d STRING) RETURNS STRING": "concat_ws(' > ', nullif(a, ''), nullif(b, ''), nullif(c, ''), nullif(d, ''))",
}


@udtf(returnType="chunk_index int, section string, text string")
class Chunks:
    """A table function: the chunks of a text."""

    def eval(self, text: str) -> Iterator[tuple[int, str, str]]:
        from lexmill.operators import chunking

        pieces = [(path, piece) for path, body in chunking.sections(text or "") for piece in chunking.split(body)]
        for i, (path, piece) in enumerate(pieces):
            yield i, path, piece


def register(spark: SparkSession) -> None:
    """Make token_estimate, sigmoid, content_path, section_path and the table function `chunks` known."""
    for head, body in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udtf.register("chunks", Chunks)
