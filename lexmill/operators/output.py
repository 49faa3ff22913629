"""Results as JSON lines, markdown and CSL records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXCERPT = 300


def truncated(text: Column, most: int) -> Column:
    """A text of at most `most` characters, its end three dots where it was longer."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def json_rows(rows: DataFrame, *keep: str) -> DataFrame:
    """Every row as a JSON object; null fields are left out."""
    return rows.select(F.to_json(F.struct(*(keep or rows.columns))).alias("json"))


def canonical_json(fields: Column) -> Column:
    """A map of strings as JSON with sorted keys, so that equal maps give equal strings."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields))))


def result_block(rank: Column, citekey: Column, title: Column, doc: Column, score: Column, section: Column, index: Column, text: Column) -> Column:
    """One result as a numbered markdown item: its source, score, section, chunk and a quoted excerpt."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    source = F.when(has(citekey), F.concat(F.lit("@"), citekey)).when(has(title), title).otherwise(F.substring(doc.cast("string"), 1, 8))
    named = F.when(has(citekey) & has(title), F.concat(F.lit(" | *"), title, F.lit("*"))).otherwise("")
    head = F.concat(rank.cast("string"), F.lit(". **"), source, F.lit("** | score: "), F.format_string("%.3f", score), named)
    quoted = F.array_join(F.transform(F.split(truncated(F.trim(text), EXCERPT), "\n", -1), lambda line: F.concat(F.lit("   > "), line)), "\n")
    part = F.when(has(section), F.concat(F.lit("   Section: "), section))
    return F.concat(F.concat_ws("\n", head, part, F.concat(F.lit("   Chunk "), index.cast("string")), quoted), F.lit("\n"))


def results_markdown(rows: DataFrame) -> DataFrame:
    """A cut result list (rank, citekey, title, doc_id, score, section, chunk_index, text) as one markdown text."""
    block = result_block(*[F.col(c) for c in ("rank", "citekey", "title", "doc_id", "score", "section", "chunk_index", "text")])
    made = rows.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"), F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    head = F.format_string("### Results (%d chunks from %d documents)", "n", "docs")
    return made.select(F.concat_ws("\n", head, F.lit(""), F.array_join(F.transform("blocks", lambda b: b["block"]), "\n")).alias("markdown"))


def csl_author(name: Column) -> Column:
    """`Family, Given` or `Given Family` as family and given; one word as a literal; null for an empty name."""
    stripped = F.trim(F.coalesce(name, F.lit("")))
    cut = F.split(stripped, ",", 2)
    before, after = F.trim(cut[0]), F.trim(F.coalesce(F.get(cut, F.lit(1)), F.lit("")))
    words = F.split(stripped, r"\s+")
    person = lambda f, g, lit: F.struct(f.cast("string").alias("family"), g.cast("string").alias("given"), lit.cast("string").alias("literal"))
    none = F.lit(None)
    return (
        F.when(stripped == "", F.lit(None))
        .when(stripped.contains(",") & (before != "") & (after != ""), person(before, after, none))
        .when(stripped.contains(",") & (before != ""), person(none, none, before))
        .when(F.size(words) >= 2, person(F.element_at(words, -1), F.array_join(F.slice(words, 1, F.size(words) - 1), " "), none))
        .otherwise(person(none, none, stripped))
    )


def csl_record(kind: Column, title: Column, authors: Column, year: Column) -> Column:
    """A CSL-JSON string from what was found; what is missing is left out."""
    people = F.filter(F.transform(authors, csl_author), lambda a: a.isNotNull())
    number = year.try_cast("int")
    issued = F.when(number.isNotNull(), F.struct(F.array(F.array(number)).alias("date-parts")))
    return F.to_json(F.struct(F.coalesce(kind, F.lit("article-journal")).alias("type"), F.when(title != "", title).alias("title"), F.when(F.size(people) > 0, people).alias("author"), issued.alias("issued")))


def document_item(place: Column, citekey: Column, title: Column, authors: Column, year: Column, status: Column) -> Column:
    """One document of a list as a numbered markdown line."""
    by = F.when(authors.isNotNull(), F.concat(F.lit(" - "), truncated(authors, 60)))
    when = F.when(year.isNotNull(), F.concat(F.lit(" ("), year.cast("string"), F.lit(")")))
    named = F.concat(F.lit("**"), F.coalesce(F.concat(F.lit("@"), citekey), F.lit("(no key)")), F.lit("** "), truncated(F.coalesce(title, F.lit("Untitled")), 80))
    return F.concat(place.cast("string"), F.lit(". "), named, F.coalesce(by, F.lit("")), F.coalesce(when, F.lit("")), F.lit(" ["), status, F.lit("]"))


def documents_markdown(rows: DataFrame) -> DataFrame:
    """A cut page of documents (place, total, citekey, title, authors, issued_year, status) as one markdown text."""
    item = document_item(*[F.col(c) for c in ("place", "citekey", "title", "authors", "issued_year", "status")])
    made = rows.agg(F.max("total").alias("total"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", item.alias("item")))).alias("items"))
    head = F.when(F.col("n") == 0, "No documents.").otherwise(F.format_string("### Documents (%d of %d)", "n", "total"))
    return made.select(F.concat_ws("\n", head, F.lit(""), F.array_join(F.transform("items", lambda i: i["item"]), "\n")).alias("markdown"))


def document_table(rows: DataFrame) -> DataFrame:
    """A cut page of documents (place, total, citekey, title, authors, status, embedding_status) as one markdown table."""
    cell = lambda c, most: truncated(F.coalesce(c, F.lit("")), most)
    key = F.coalesce(F.concat(F.lit("@"), F.col("citekey")), F.lit(""))
    cells = [key, cell(F.col("title"), 40), cell(F.col("authors"), 25), F.col("status"), F.coalesce("embedding_status", F.lit(""))]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    made = rows.agg(F.max("total").alias("total"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("place", line.alias("line")))).alias("lines"))
    number = F.format_number("total", 0)
    head = F.when(F.col("n") < F.col("total"), F.concat(F.lit("### Documents (showing "), F.col("n"), F.lit(" of "), number, F.lit(")"))).otherwise(F.concat(F.lit("### Documents ("), number, F.lit(" total)")))
    table = F.concat_ws("\n", head, F.lit(""), F.lit("| Citekey | Title | Authors | Status | Embeddings |"), F.lit("|---------|-------|---------|--------|------------|"), F.array_join(F.transform("lines", lambda i: i["line"]), "\n"))
    return made.select(F.when(F.col("n") == 0, "No documents in the library.").otherwise(table).alias("markdown"))


def error_line(message: Column, infrastructure: bool = False) -> Column:
    """An error that the asker can handle, or one of the `infrastructure` that is to be told to people."""
    return F.concat(F.lit("\u26a0 USER-FACING ERROR: " if infrastructure else "Error: "), message)


def no_results(query: Column) -> Column:
    """What an asker reads when a search finds nothing."""
    return F.concat(F.lit('No results found for "'), query, F.lit('". Try different search terms, broader keywords, or search for exact keywords.'))


def text_page(head: Column, kind: Column, total: Column, text: Column, bounds: tuple[Column, Column], chunks: Column) -> Column:
    """What a reader gets of a document: all its text, a range of chunks, or a preview with the sections in it.

    chunks: array of (chunk_index, section, text) in order; kind: as `catalog.text_slices` gives it; bounds: first and last chunk asked.
    """
    has = lambda c: F.coalesce(c, F.lit("")) != ""

    def listed(mark: str, end: str) -> Column:
        named = lambda c: F.when(has(c["section"]), F.concat(F.lit(mark), c["section"], F.lit(end)))
        label = lambda c: F.concat(F.lit("*[Chunk "), c["chunk_index"].cast("string"), F.lit("]*"))
        return F.array_join(F.transform(chunks, lambda c: F.concat_ws("\n", named(c), label(c), F.lit(""), F.coalesce(c["text"], F.lit("")), F.lit(""))), "\n")

    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    whole = F.concat_ws("\n", head, line("*", total.cast("string"), " chunks*"), F.lit(""), F.coalesce(text, F.lit("")))
    part = F.concat_ws("\n", head, line("*Chunks ", bounds[0].cast("string"), "\u2013", bounds[1].cast("string"), " of ", total.cast("string"), " total*"), F.lit(""), listed("### ", ""))
    sections = F.array_distinct(F.filter(F.transform(chunks, lambda c: c["section"]), has))
    contents = F.when(F.size(sections) > 0, F.concat_ws("\n", F.lit("### Sections"), F.array_join(F.transform(sections, lambda s: F.concat(F.lit("- "), s)), "\n"), F.lit("")))
    shown = line("### Preview (first ", F.size(chunks).cast("string"), " chunks)")
    hint = line("Document has ", total.cast("string"), " chunks. A part of it is read by its first and last chunk (from 0, both included), such as 20 to 40.")
    preview = F.concat_ws("\n", head, line("*", total.cast("string"), " chunks total*"), F.lit(""), contents, shown, F.lit(""), listed("**", "**"), F.lit("---"), hint)
    wrong = error_line(line("no chunks ", bounds[0].cast("string"), " to ", bounds[1].cast("string"), " of ", total.cast("string")))
    return F.when(kind == "whole", whole).when(kind == "range", part).when(kind == "preview", preview).when(kind == "invalid", wrong).otherwise(F.concat(head, F.lit("\n\nNo text content available for this document.")))


def text_pages(slices: DataFrame, by: list[str]) -> DataFrame:
    """A markdown text per request: `slices` as `catalog.text_slices` gives them, with citekey, title and text of the documents; by: columns that name a request and its document, the document last."""
    one = [F.first(c).alias(c) for c in ("kind", "total", "start", "end", "first", "last", "citekey", "title", "text")]
    given = slices.withColumnRenamed("chunk_text", "_text")
    chunk = F.struct("chunk_index", "section", F.col("_text").alias("text"))
    rows = given.groupBy(*by).agg(*one, F.array_sort(F.collect_list(F.when(F.col("chunk_index").isNotNull(), chunk))).alias("chunks"))
    named = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    head = F.concat(F.lit("## "), F.coalesce(F.concat(F.lit("@"), named(F.col("citekey"))), named(F.col("title")), F.concat(F.lit("Document "), F.col(by[-1]).cast("string"))))
    bounds = F.coalesce("start", F.lit(0)), F.coalesce("end", "last", F.col("total") - 1)
    return rows.select(*by, "kind", text_page(head, F.col("kind"), F.col("total"), F.col("text"), bounds, F.col("chunks")).alias("markdown"))


def document_markdown(key: Column, title: Column, fields: Column) -> Column:
    """One document's fields (a map of strings; null values are left out) as markdown."""
    lines = F.transform(F.filter(F.array_sort(F.map_entries(fields)), lambda f: f["value"].isNotNull()), lambda f: F.concat(F.lit("- **"), f["key"], F.lit(":** "), f["value"]))
    return F.concat_ws("\n", F.concat(F.lit("## "), F.coalesce(title, F.lit("Untitled"))), F.concat(F.lit("@"), key), F.array_join(lines, "\n"))


def run_log(queries: DataFrame, results: DataFrame, metrics: DataFrame) -> DataFrame:
    """A row per query with its text, its metrics as a struct and its results as an array in order of rank."""
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("rank"), F.col("doc_id").alias("doc_id"), F.col("score").alias("score")))).alias("results"))
    names = [c for c in metrics.columns if c != "query_id"]
    return queries.join(metrics.select("query_id", F.struct(*names).alias("metrics")), "query_id", "left").join(listed, "query_id", "left")


def write_run_log(rows: DataFrame, path: str) -> None:
    """An evaluation's rows as JSON lines."""
    rows.write.mode("overwrite").json(path)
