"""Text of binary files by pluggable extractors; a failure is a row, not an exception."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from contextlib import closing
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.operators import quality
from lexmill.sources import workers

#: An extractor: the endings that it takes, and what makes text of a file's bytes.
Handler = tuple[tuple[str, ...], Callable[[bytes], str]]


def _plain(data: bytes) -> str:
    return data.decode("utf-8")


class _Page(HTMLParser):
    """Collects the text of a page: lines end at blocks, runs of white space are one space, and scripts and styles go."""

    BLOCKS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr", "br", "ul", "ol", "table", "section", "article", "header", "footer", "pre", "blockquote", "title"}
    HIDDEN = {"script", "style", "template", "noscript"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in self.HIDDEN:
            self.hidden.append(tag)
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()
        if tag in self.BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.parts.append(re.sub(r"\s+", " ", data))


def _page(data: bytes) -> str:
    """Text of a web page, a line per block."""
    page = _Page()
    page.feed(data.decode("utf-8", "replace"))
    page.close()
    lines = (re.sub(" +", " ", line).strip() for line in "".join(page.parts).split("\n"))
    return "\n".join(line for line in lines if line)


#: The first handler that takes a file's ending is asked. A PDF extractor is put in front of these by its user.
DEFAULTS: tuple[Handler, ...] = (((".md", ".txt", ".json"), _plain), ((".html", ".htm"), _page))


NAMES = ("path", "text", "error", "way")
OUT = pa.schema([(n, pa.string()) for n in NAMES])


def extract(files: DataFrame, handlers: Sequence[Handler] = DEFAULTS, seconds: Column | float = 300.0, fallbacks: Sequence[Handler] = (), most_bytes: int | None = None, renewed: int = workers.RENEWED) -> DataFrame:
    """path, text, error, way and status of (path, content): ready, needs_review where the quality gate objects, failed without a text.

    Extractors run in a process per task that lives on between files (see `workers`). A file has `seconds` at most, then the
    process is killed; where it crashes, the file is tried once more in a new one. Of what gives no text the fall-back that takes its
    ending is asked, under the same deadline. `way` says where a text is from: extractor, retry or fallback (null: none is), and
    `error` what went wrong first, also where another way gave a text. `most_bytes` is what a process may take beyond what it starts with.
    A null path has no extractor, null content is empty.
    """
    tried, last = tuple(handlers), tuple(fallbacks)

    def text_of(worker: workers.Worker, path: str, data: bytes, limit: float) -> tuple[str | None, str | None, str | None]:
        takes = lambda some: next((i for i, (ends, _) in enumerate(some) if path.lower().endswith(ends)), None)
        first, second, error = takes(tried), takes(last), None
        ways = [] if first is None else [("extractor", first), ("retry", first)]
        for way, which in [*ways, *([] if second is None else [("fallback", len(tried) + second)])]:
            if way == "retry" and not again:
                continue
            again = False
            try:
                if (text := worker.run(which, data, limit)) is not None:
                    return text, error, way
                error = error or "no text"
            except workers.Failed as why:
                error, again = error or str(why), why.died
        return None, error or "no extractor takes this kind of file", None

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with closing(workers.Worker([make for _, make in (*tried, *last)], most_bytes, renewed)) as worker:
            for batch in batches:
                for path, data, limit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    row = text_of(worker, path or "", data or b"", limit)
                    yield pa.RecordBatch.from_pydict({n: [v] for n, v in zip(NAMES, (path, *row), strict=True)}, OUT)

    limit = F.lit(seconds) if isinstance(seconds, int | float) else seconds
    rows = files.select("path", "content", limit.cast("double").alias("seconds")).mapInArrow(task, ", ".join(f"{n} string" for n in NAMES))
    status = F.when(F.col("way").isNull(), "failed").when(quality.gate(F.col("text")) != "ok", "needs_review").otherwise("ready")
    return rows.withColumn("status", status)
