"""Queries on the look-up of documents, their states, records and imports; with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexmill import session
from lexmill.operators import accuracy, catalog, chunking, metadata, output, people, quality, ranking
from lexmill.plans.search import _read
from lexmill.sources import files, records
from lexmill.streaming import ingest


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents of a library: states by status, embedding states by priority, keys for most."""
    o = _read(spark, sf_dir, "orders")
    key = F.when(F.col("o_orderkey") % 9 > 0, F.concat(F.regexp_replace("o_orderpriority", "[^A-Z]", ""), F.year("o_orderdate"), F.lit("-"), F.col("o_orderkey")))
    return o.select(
        F.concat(F.lit("d"), F.col("o_orderkey")).alias("doc_id"),
        F.concat(F.lit("/in/"), F.col("o_custkey"), F.lit("/"), F.col("o_orderkey"), F.lit(".pdf")).alias("original_path"),
        F.sha2(F.col("o_orderkey").cast("string"), 256).alias("content_hash"),
        F.col("o_orderpriority").alias("text"),
        F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("pending").alias("status"),
        F.when(F.col("o_orderpriority").startswith("1"), "current").when(F.col("o_orderpriority").startswith("2"), "stale").when(F.col("o_orderpriority").startswith("3"), "pending").alias("embedding_status"),
        key.alias("citekey"),
        F.col("o_orderdate").alias("created_at"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("issued_date"),
        F.lit(None).cast("string").alias("error_message"),
    )


_DOCS = """d AS (SELECT 'd' || o_orderkey AS doc_id, '/in/' || o_custkey || '/' || o_orderkey || '.pdf' AS original_path, sha256(CAST(o_orderkey AS VARCHAR)) AS content_hash, o_orderpriority AS text,
  CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'needs_review' ELSE 'pending' END AS status,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'current' WHEN '2' THEN 'stale' WHEN '3' THEN 'pending' END AS embedding_status,
  CASE WHEN o_orderkey % 9 > 0 THEN regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') || year(o_orderdate) || '-' || o_orderkey END AS citekey,
  o_orderdate AS created_at, strftime(o_orderdate, '%Y-%m-%d') AS issued_date, o_orderkey FROM orders)"""


def point_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document each by id, path, hash and key, all taken from the document whose id sorts first."""
    docs = _documents(spark, sf_dir)
    first = docs.filter("citekey is not null").orderBy("doc_id").first()
    found = None
    for column in ("doc_id", "original_path", "content_hash", "citekey"):
        part = catalog.lookup(docs, column, first[column]).select(F.lit(column).alias("by"), "doc_id")
        found = part if found is None else found.union(part)
    return found


def resolved_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document of a key, that of a whole id, and the suggestions for a key that none has."""
    docs = _documents(spark, sf_dir)
    first = docs.filter("citekey is not null").orderBy("doc_id").first()
    found = catalog.resolve(docs, "@" + first["citekey"]).select(F.lit("key").alias("by"), "doc_id")
    found = found.union(catalog.resolve(docs, first["doc_id"]).select(F.lit("id"), "doc_id"))
    try:
        catalog.resolve(docs, "@" + first["citekey"] + "x")
    except catalog.NotFound as why:
        found = found.union(spark.createDataFrame([("suggestion", s) for s in why.details["suggestions"]], "`by` string, doc_id string"))
    return found


_RESOLVED_SQL = f"""WITH {_DOCS}, f AS (SELECT * FROM d WHERE citekey IS NOT NULL ORDER BY doc_id LIMIT 1),
s AS (SELECT d.citekey FROM d, f WHERE d.citekey IS NOT NULL AND levenshtein(f.citekey || 'x', d.citekey) <= 3 ORDER BY levenshtein(f.citekey || 'x', d.citekey), d.citekey LIMIT 3)
SELECT 'key' AS "by", doc_id FROM f UNION ALL SELECT 'id', doc_id FROM f UNION ALL SELECT 'suggestion', citekey FROM s"""


def all_citekeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.citekeys(_documents(spark, sf_dir))


def waiting_for_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ready documents whose embeddings are pending or stale; with force all ready ones."""
    docs = _documents(spark, sf_dir)
    some = catalog.needing_embedding(docs).select("doc_id", F.lit(False).alias("force"))
    return some.union(catalog.needing_embedding(docs, force=True).select("doc_id", F.lit(True)))


def embedding_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' states after all that waited have been embedded, but those of some customers, which failed."""
    docs = _documents(spark, sf_dir)
    done = catalog.needing_embedding(docs).select("doc_id", F.when(F.col("original_path").startswith("/in/1"), "pending").otherwise("current").alias("embedding_status"))
    return catalog.coalesce_update(docs, done, "doc_id", ["embedding_status"]).select("doc_id", "embedding_status")


def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as the chunks of their orders, but for returned ones."""
    lines = _read(spark, sf_dir, "lineitem").filter("l_returnflag <> 'R'").select(F.concat(F.lit("d"), F.col("l_orderkey")).alias("doc_id"))
    return catalog.chunk_counts(_documents(spark, sf_dir), lines)


def section_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' events as chunks, and their types as sections; clicks have no section."""
    events = _read(spark, sf_dir, "events").select("user_id", F.when(F.col("event_type") != "click", F.col("event_type")).alias("section"), F.col("event_id").alias("chunk_index"))
    return catalog.outline(events, ["user_id"])


def _users(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Users' events as chunks of documents, and what is asked of every user: a preview, ranges that are open or closed, chunks that may be none."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    chunks = _read(spark, sf_dir, "events").select("user_id", rank.alias("chunk_index"), F.when(F.col("event_type") != "click", F.col("event_type")).alias("section"), F.col("props").alias("chunk_text"))
    k = F.col("user_id") % 5
    asked = chunks.select("user_id").distinct().select(
        "user_id", F.when(k == 1, 5).when(k == 3, 40).when(k == 4, 90).alias("start"), F.when(k == 1, 12).when(k == 2, 3).when(k == 4, 95).alias("end"),
        F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("u"), F.col("user_id"))).alias("citekey"), F.when(F.col("user_id") % 2 > 0, F.concat(F.lit("User "), F.col("user_id"))).alias("title"), F.concat(F.lit("All of "), F.col("user_id")).alias("text"),
    )
    return chunks, asked


_USERS_SQL = """c AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, CASE WHEN event_type <> 'click' THEN event_type END AS section, props FROM events),
t AS (SELECT user_id, count(*) AS total, CASE user_id % 5 WHEN 1 THEN 5 WHEN 3 THEN 40 WHEN 4 THEN 90 END AS lo, CASE user_id % 5 WHEN 1 THEN 12 WHEN 2 THEN 3 WHEN 4 THEN 95 END AS hi FROM c GROUP BY 1),
k AS (SELECT *, CASE WHEN total < 50 THEN 'whole' WHEN lo IS NULL AND hi IS NULL THEN 'preview' WHEN coalesce(lo, 0) >= total THEN 'invalid' ELSE 'range' END AS kind FROM t),
s AS (SELECT k.*, i, section, props FROM k LEFT JOIN c ON c.user_id = k.user_id AND CASE kind WHEN 'whole' THEN true WHEN 'preview' THEN i < 20 WHEN 'range' THEN i BETWEEN coalesce(lo, 0) AND coalesce(hi, total) ELSE false END)"""


def users_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that readers get of all users at once."""
    found = catalog.text_slices(*_users(spark, sf_dir), ["user_id"])
    return found.select("user_id", "kind", "total", F.col("chunk_index").cast("long").alias("chunk_index"))


_USERS_SLICES_SQL = f"WITH {_USERS_SQL} SELECT user_id, kind, total, i AS chunk_index FROM s"


def text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as pages of markdown."""
    return output.text_pages(catalog.text_slices(*_users(spark, sf_dir), ["user_id"]), ["user_id"])


_PAGES_SQL = f"""WITH {_USERS_SQL},
b AS (SELECT user_id, kind, total, any_value(lo) AS lo, any_value(hi) AS hi, count(i) AS n,
  string_agg(CASE WHEN section IS NULL THEN '' WHEN kind = 'range' THEN '### ' || section || chr(10) ELSE '**' || section || '**' || chr(10) END || '*[Chunk ' || i || ']*' || chr(10) || chr(10) || props || chr(10), chr(10) ORDER BY i) AS body FROM s GROUP BY 1, 2, 3),
o AS (SELECT user_id, string_agg('- ' || section, chr(10) ORDER BY f) AS outline FROM (SELECT user_id, section, min(i) AS f FROM s WHERE section IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
h AS (SELECT b.*, outline, '## ' || CASE WHEN b.user_id % 3 > 0 THEN '@u' || b.user_id WHEN b.user_id % 2 > 0 THEN 'User ' || b.user_id ELSE 'Document ' || b.user_id END || chr(10) AS head FROM b LEFT JOIN o USING (user_id))
SELECT user_id, kind, CASE kind WHEN 'whole' THEN head || '*' || total || ' chunks*' || chr(10) || chr(10) || 'All of ' || user_id
  WHEN 'range' THEN head || '*Chunks ' || coalesce(lo, 0) || chr(8211) || coalesce(hi, total - 1) || ' of ' || total || ' total*' || chr(10) || chr(10) || body
  WHEN 'invalid' THEN 'Error: no chunks ' || lo || ' to ' || hi || ' of ' || total
  ELSE head || '*' || total || ' chunks total*' || chr(10) || chr(10) || coalesce('### Sections' || chr(10) || outline || chr(10) || chr(10), '') || '### Preview (first ' || n || ' chunks)' || chr(10) || chr(10) || body
    || chr(10) || '---' || chr(10) || 'Document has ' || total || ' chunks. A part of it is read by its first and last chunk (from 0, both included), such as 20 to 40.' END AS markdown FROM h"""


def documents_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the 25 oldest documents as a table."""
    page = catalog.page(_documents(spark, sf_dir), ["created_at", "doc_id"], 25)
    rows = page.select(F.row_number().over(Window.orderBy("created_at", "doc_id")).alias("place"), "total", "citekey", F.repeat("text", 4).alias("title"), F.concat(F.lit("By "), F.repeat("text", 2)).alias("authors"), "status", "embedding_status")
    return output.document_table(rows)


_TABLE_SQL = f"""WITH {_DOCS}, p AS (SELECT *, row_number() OVER (ORDER BY created_at, doc_id) AS place FROM d),
r AS (SELECT *, repeat(text, 4) AS title, 'By ' || repeat(text, 2) AS authors FROM p WHERE place <= 25)
SELECT '### Documents (showing ' || count(*) || ' of ' || format('{{:,}}', (SELECT count(*) FROM d)) || ')' || chr(10) || chr(10) || '| Citekey | Title | Authors | Status | Embeddings |' || chr(10) || '|---------|-------|---------|--------|------------|' || chr(10)
  || string_agg('| ' || coalesce('@' || citekey, '') || ' | ' || CASE WHEN length(title) > 40 THEN title[:37] || '...' ELSE title END || ' | ' || CASE WHEN length(authors) > 25 THEN authors[:22] || '...' ELSE authors END || ' | ' || status || ' | ' || coalesce(embedding_status, '') || ' |', chr(10) ORDER BY place) AS markdown FROM r"""


def text_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader gets of the events of a type, as a document's chunks, by how they were asked for."""
    events = _read(spark, sf_dir, "events")
    first = events.agg(F.min("event_type")).first()[0]
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy("event_id")) - 1
    chunks = events.select("event_type", "event_id", rank.alias("chunk_index")).filter(F.col("event_type") == first)
    few = chunks.filter("chunk_index < 7")
    asked = {"all": (chunks, None, None), "middle": (chunks, 30, 35), "open": (chunks, None, 2), "short": (few, 3, 4)}
    found = None
    for name, (rows, start, end) in asked.items():
        kind, part = catalog.text_slice(rows, rows.count(), start, end)
        part = part.select(F.lit(name).alias("asked"), F.lit(kind).alias("kind"), "event_id")
        found = part if found is None else found.union(part)
    return found


_SLICES_SQL = """WITH c AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events WHERE event_type = (SELECT min(event_type) FROM events))
SELECT 'all' AS asked, 'preview' AS kind, event_id FROM c WHERE i < 20 UNION ALL SELECT 'middle', 'range', event_id FROM c WHERE i BETWEEN 30 AND 35
UNION ALL SELECT 'open', 'range', event_id FROM c WHERE i <= 2 UNION ALL SELECT 'short', 'whole', event_id FROM c WHERE i < 7"""


def failed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' folders that could not be read; those that a document came from have a record already."""
    c = _read(spark, sf_dir, "customer")
    paths = c.select(F.concat(F.lit("/in/"), F.col("c_custkey"), F.lit("/"), F.col("c_custkey"), F.lit(".pdf")).alias("path"), F.lit("can't be read").alias("error_message"), F.lit("unreadable").alias("error_code"))
    return catalog.failed_records(paths, _documents(spark, sf_dir)).drop("error_message")


def reextracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose priority is not low get new texts; urgent ones by a fall-back."""
    docs = _documents(spark, sf_dir)
    texts = docs.filter("text not like '5%'").select("doc_id", F.upper("text").alias("text"), F.when(F.col("text").startswith("1"), "fall-back").alias("error"))
    return catalog.reextracted(docs, texts).select("doc_id", "text", "status", "embedding_status", "error_message")


def migrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the first version of the schema; some dates have no year at their start."""
    o = _read(spark, sf_dir, "orders")
    old = o.select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderstatus") == "P", F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM")).alias("issued_date"))
    return catalog.migrated(old, 1).select("doc_id", F.col("issued_year").cast("long").alias("issued_year"), "embedding_status", "error_code")


def document_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 20 ready documents, with how many there are."""
    found = catalog.page(catalog.listing(_documents(spark, sf_dir), equals={"status": "ready"}, missing=["error_message"]), [F.desc("created_at"), "doc_id"], 20)
    return found.select("doc_id", "status", "total")


def status_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_status(_documents(spark, sf_dir), "ready", "needs_review").groupBy("status").agg(F.count("*").alias("documents"))


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as items of three libraries."""
    return _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("itemID"), F.concat(F.lit("K"), F.col("p_partkey")).alias("key"), (F.col("p_size") % 3 + 1).alias("libraryID"), "p_brand", "p_name", "p_size")


def _keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Their citation keys: brands and numbers; small parts have none."""
    return _items(spark, sf_dir).select("itemID", F.when(F.col("p_size") > 5, F.concat(F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit("_"), F.col("itemID"))).alias("citekey"))


_ITEMS = """i AS (SELECT p_partkey AS "itemID", 'K' || p_partkey AS key, p_size % 3 + 1 AS "libraryID", p_name, p_size,
  CASE WHEN p_size > 5 THEN regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '_' || p_partkey END AS citekey FROM part)"""


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of parts: stored, linked by path, linked by address, or without a path."""
    items = _items(spark, sf_dir)
    path = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("storage:"), F.col("p_name"), F.lit(".pdf"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("/home/"), F.col("p_name"), F.lit(".txt"))).when(F.col("p_size") % 4 == 2, "https://example.org/x.pdf")
    attached = items.select("itemID", (F.col("itemID") + 1000).alias("parentItemID"), path.alias("path"), F.when(F.col("p_size") % 4 == 0, "application/pdf").alias("contentType"), F.lit(None).cast("int").alias("linkMode"))
    return catalog.attachments(attached, items).withColumn("link_mode", F.col("link_mode").cast("long"))


_ATTACHED_SQL = f"""WITH {_ITEMS} SELECT "itemID" + 1000 AS "itemID", key, CASE p_size % 4 WHEN 0 THEN p_name || '.pdf' ELSE p_name || '.txt' END AS file_name,
  CASE p_size % 4 WHEN 0 THEN 'application/pdf' ELSE 'application/octet-stream' END AS content_type, CAST(0 AS BIGINT) AS link_mode FROM i WHERE p_size % 4 < 2"""


def library_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a library, of those that were exported."""
    exported = _keys(spark, sf_dir).filter("itemID % 5 > 0").select(F.col("citekey").alias("key"))
    return catalog.library_keys(_items(spark, sf_dir), _keys(spark, sf_dir), exported, 2)


def collection_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a collection (the parts of a size or more) that are in a library too."""
    library = catalog.library_keys(_items(spark, sf_dir), _keys(spark, sf_dir), _keys(spark, sf_dir).select(F.col("citekey").alias("key")), 2)
    return catalog.collection_keys(_items(spark, sf_dir).filter("p_size >= 20"), _keys(spark, sf_dir), library)


def collections_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as collections named by their type: the last of each name stays."""
    rows = _read(spark, sf_dir, "part").select(F.col("p_type").alias("name"), F.col("p_partkey").alias("collectionID"), F.col("p_brand").alias("key"))
    return catalog.last_by_name(rows, "name", "collectionID")


def import_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of all parts' keys at an import, in five ways."""
    items, keys = _items(spark, sf_dir), _keys(spark, sf_dir).filter("citekey is not null")
    wanted = keys.select("citekey")
    existing = keys.join(items.filter("p_size > 45"), "itemID").select("citekey")
    there = keys.join(items.filter("p_size <> 7"), "itemID").select("citekey", "itemID")
    digest = F.when(F.col("p_size") % 6 > 0, F.sha2("p_name", 256))
    held = items.filter("p_size % 11 = 0").select(F.sha2("p_name", 256).alias("content_hash"))
    attached = items.filter("p_size % 4 > 0").select("itemID", F.lit(0).alias("place"), digest.alias("digest"))
    return catalog.import_outcomes(wanted, existing, there, attached, held).groupBy("outcome").agg(F.count("*").alias("items"))


_COUNTERS_SQL = f"""WITH {_ITEMS}, h AS (SELECT DISTINCT p_name FROM i WHERE p_size % 11 = 0),
o AS (SELECT CASE WHEN p_size > 45 THEN 'skipped_existing' WHEN p_size = 7 THEN 'failed' WHEN p_size % 4 = 0 THEN 'skipped_no_file' WHEN p_size % 6 = 0 THEN 'failed'
  WHEN p_name IN (SELECT p_name FROM h) THEN 'skipped_duplicate' ELSE 'added' END AS outcome FROM i WHERE citekey IS NOT NULL)
SELECT outcome, count(*) AS items FROM o GROUP BY 1"""


def _csl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as CSL-JSON strings with faults by the digits of their ids: missing and unknown types, no id, wrong kinds, unknown fields, editors only."""
    d = _read(spark, sf_dir, "documents").select("doc_id", F.col("source"), F.col("lang"), (F.col("doc_id") % 10).alias("k"))
    kind = F.when(F.col("k") == 1, "").when(F.col("k") == 2, '"type":"scroll",').otherwise('"type":"book",')
    key = F.when(F.col("k") == 3, "").otherwise(F.concat(F.lit('"id":"x'), F.col("doc_id"), F.lit('",')))
    title = F.when(F.col("k") == 4, '"title":["a"],').when(F.col("k") == 5, "").otherwise(F.concat(F.lit('"title":"The Style of '), F.col("source"), F.lit('",')))
    person = F.concat(F.lit('[{"family":"Müller-'), F.col("lang"), F.lit('","given":"Jean-Pierre m."},{"literal":"The '), F.col("source"), F.lit('"}]'))
    who = F.when(F.col("k") == 6, F.concat(F.lit('"editor":'), person)).when(F.col("k") == 7, '"author":"me"').otherwise(F.concat(F.lit('"author":'), person))
    date = F.when(F.col("k") == 8, "").otherwise(F.concat(F.lit(',"issued":{"date-parts":[['), F.col("doc_id") % 30 + 1990, F.lit(",5]]}")))
    extra = F.when(F.col("k") == 9, ',"shelf":3,"colour":1')
    return d.select("doc_id", "k", F.concat(F.lit("{"), kind, key, title, who, date, F.coalesce(extra, F.lit("")), F.lit("}")).alias("record"))


_CSL = """c AS (SELECT doc_id, doc_id % 10 AS k, source, lang, '{' || CASE doc_id % 10 WHEN 1 THEN '' WHEN 2 THEN '"type":"scroll",' ELSE '"type":"book",' END
  || CASE doc_id % 10 WHEN 3 THEN '' ELSE '"id":"x' || doc_id || '",' END
  || CASE doc_id % 10 WHEN 4 THEN '"title":["a"],' WHEN 5 THEN '' ELSE '"title":"The Style of ' || source || '",' END
  || CASE doc_id % 10 WHEN 7 THEN '"author":"me"' ELSE CASE doc_id % 10 WHEN 6 THEN '"editor":' ELSE '"author":' END || '[{"family":"Müller-' || lang || '","given":"Jean-Pierre m."},{"literal":"The ' || source || '"}]' END
  || CASE doc_id % 10 WHEN 8 THEN '' ELSE ',"issued":{"date-parts":[[' || (doc_id % 30 + 1990) || ',5]]}' END
  || CASE doc_id % 10 WHEN 9 THEN ',"shelf":3,"colour":1' ELSE '' END || '}' AS record FROM documents)"""


def csl_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _csl(spark, sf_dir).withColumn("issues", metadata.csl_issues(F.col("record")))
    return found.select("doc_id", F.array_join("issues", "; ").alias("issues"), metadata.is_fatal(F.col("issues")).alias("fatal"))


_CSL_ISSUES = f"""{_CSL}, x AS (SELECT *, list_filter([
    CASE WHEN NOT json_exists(record, '$.type') THEN 'error: missing required field: type' END,
    CASE WHEN json_type(record, '$.type') = 'VARCHAR' AND record ->> '$.type' NOT IN ({", ".join(f"'{t}'" for t in metadata.CSL_TYPES)}) THEN 'error: invalid item type: ' || (record ->> '$.type') END,
    CASE WHEN json_exists(record, '$.author') AND json_type(record, '$.author') <> 'ARRAY' THEN 'error: author is no array' END,
    CASE WHEN json_exists(record, '$.editor') AND json_type(record, '$.editor') <> 'ARRAY' THEN 'error: editor is no array' END,
    CASE WHEN json_exists(record, '$.issued') AND json_type(record, '$.issued') <> 'OBJECT' THEN 'error: issued is no object' END,
    CASE WHEN json_exists(record, '$.title') AND json_type(record, '$.title') NOT IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN 'error: title is no string' END], lambda e: e IS NOT NULL) AS errors,
  list_filter([
    CASE WHEN NOT json_exists(record, '$.id') THEN 'warning: ''id'' is a required property' END,
    CASE WHEN len(list_filter(json_keys(record), lambda f: f NOT IN ('type', 'id', 'title', 'author', 'editor', 'issued'))) > 0 THEN 'warning: additional properties: ' || array_to_string(list_sort(list_filter(json_keys(record), lambda f: f NOT IN ('type', 'id', 'title', 'author', 'editor', 'issued'))), ', ') END,
    CASE WHEN NOT json_exists(record, '$.title') THEN 'warning: missing recommended field ''title''' END,
    CASE WHEN NOT json_exists(record, '$.author') AND NOT json_exists(record, '$.editor') THEN 'warning: missing author or editor' END,
    CASE WHEN NOT json_exists(record, '$.issued') THEN 'warning: missing publication date (issued)' END], lambda e: e IS NOT NULL) AS warnings FROM c)"""


def csl_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed fields of all records; every 13th has a key that is given, and that is not valid for every 26th."""
    given = F.when(F.col("doc_id") % 26 == 0, "no key").when(F.col("doc_id") % 13 == 0, F.concat(F.lit("given-"), F.col("doc_id")))
    found = _csl(spark, sf_dir).select("doc_id", metadata.processed(F.col("record"), given).alias("p"))
    return found.select("doc_id", F.col("p.error").isNotNull().alias("refused"), "p.citekey", "p.title", "p.authors", "p.issued_date", F.col("p.issued_year").cast("long").alias("issued_year"), F.size("p.warnings").cast("long").alias("warnings"))


_PROCESSED_SQL = f"""WITH {_CSL_ISSUES}, g AS (SELECT *, CASE WHEN doc_id % 26 = 0 THEN 'no key' WHEN doc_id % 13 = 0 THEN 'given-' || doc_id END AS given FROM x),
p AS (SELECT *, len(errors) > 0 OR coalesce(NOT regexp_matches(given, '^[A-Za-z0-9_-]+$'), false) AS refused, json_extract_string(record, '$.issued."date-parts"[0][0]') AS y FROM g)
SELECT doc_id, refused, CASE WHEN NOT refused THEN coalesce(given, 'Muller' || lang || coalesce(y, '') || CASE WHEN json_exists(record, '$.title') THEN 'Style' ELSE '' END) END AS citekey,
  CASE WHEN NOT refused THEN record ->> '$.title' END AS title, CASE WHEN NOT refused THEN 'Müller-' || lang || ', J.-P.m.; The ' || source END AS authors,
  CASE WHEN NOT refused AND y IS NOT NULL THEN y || '-05' END AS issued_date, CASE WHEN NOT refused THEN CAST(y AS BIGINT) END AS issued_year,
  CASE WHEN refused THEN 0 ELSE len(warnings) END AS warnings FROM p"""


def manual_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of all records as an update by hand stores them."""
    found = _csl(spark, sf_dir).select("doc_id", metadata.updated_by_hand(F.col("record")).alias("u"))
    return found.select("doc_id", "u.title", "u.authors", "u.issued_date", F.col("u.issued_year").cast("long").alias("issued_year"))


_MANUAL_SQL = f"""WITH {_CSL} SELECT doc_id, record ->> '$.title' AS title, CASE WHEN k <> 7 AND json_exists(record, '$.author') THEN 'Jean-Pierre m. Müller-' || lang || '; The ' || source END AS authors,
  json_extract_string(record, '$.issued."date-parts"[0][0]') AS issued_date, CAST(json_extract_string(record, '$.issued."date-parts"[0][0]') AS BIGINT) AS issued_year FROM c"""


def edited_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records after an edit: states by source, keys that others have, and faults of the records; with comments, and without them again."""
    rows = _csl(spark, sf_dir).join(_read(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    status = F.when(F.col("lang") == "en", "ready").when(F.col("lang") == "de", "done")
    new = F.when(F.col("doc_id") % 4 == 0, F.lit("K1")).otherwise(F.lit("K2"))
    found = rows.withColumn("errors", metadata.edit_errors(status, new, F.lit("K2"), F.col("record"), new == "K1"))
    commented = metadata.with_error_comments(F.col("record"), F.col("errors"))
    return found.select("doc_id", F.array_join("errors", "; ").alias("errors"), (F.length(commented) > F.length("record")).alias("commented"), (metadata.without_comments(commented) == F.col("record")).alias("same"))


_EDITED_SQL = f"""WITH {_CSL_ISSUES}, e AS (SELECT doc_id, list_filter([CASE WHEN lang = 'de' THEN 'invalid status ''done''' WHEN lang = 'en' THEN NULL ELSE 'missing required field: status' END,
  CASE WHEN doc_id % 4 = 0 THEN 'citekey ''K1'' already exists' END], lambda m: m IS NOT NULL) || list_transform(errors, lambda m: 'CSL-JSON: ' || m[8:]) AS errors FROM x)
SELECT doc_id, array_to_string(errors, '; ') AS errors, len(errors) > 0 AS commented, true AS same FROM e"""


def built_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSL-JSON of documents' sources as titles and their languages as names, in two orders or one word."""
    d = _read(spark, sf_dir, "documents")
    names = F.array(F.concat(F.lit("Ada "), F.col("lang")), F.concat(F.col("lang"), F.lit(", Bo C.")), F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise(""))
    year = F.when(F.col("doc_id") % 3 == 0, "n.d.").otherwise((F.col("doc_id") % 20 + 2000).cast("string"))
    return d.select("doc_id", output.csl_record(F.when(F.col("doc_id") % 5 > 0, "book"), F.col("source"), names, year).alias("record"))


_BUILT_SQL = """SELECT doc_id, '{"type":"' || CASE WHEN doc_id % 5 > 0 THEN 'book' ELSE 'article-journal' END || '"' || CASE WHEN source <> '' THEN ',"title":"' || source || '"' ELSE '' END
  || ',"author":[{"family":"' || lang || '","given":"Ada"},{"family":"' || lang || '","given":"Bo C."}' || CASE WHEN doc_id % 2 = 0 THEN ',{"literal":"' || lang || '"}' ELSE '' END || ']'
  || CASE WHEN doc_id % 3 = 0 THEN '' ELSE ',"issued":{"date-parts":[[' || (doc_id % 20 + 2000) || ']]}' END || '}' AS record FROM documents"""


def _extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as extractions: values and confidences of title, date and kind by price, date and customer, and up to two authors."""
    o = _read(spark, sf_dir, "orders")
    field = lambda value, confidence: F.struct(value.alias("value"), confidence.alias("confidence"), F.array().cast("array<string>").alias("alternatives"), F.lit("why").alias("reasoning"))
    c = lambda of: F.col("o_orderkey") % of / 100.0
    some = lambda n: F.struct(F.lit(f"N{n}").alias("value"), c(90 + n).alias("confidence"))
    authors = F.when(F.col("o_orderkey") % 7 == 0, F.array().cast("array<struct<value:string,confidence:double>>")).when(F.col("o_orderkey") % 2 == 0, F.array(some(1))).otherwise(F.array(some(1), some(2)))
    title = F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderpriority"))
    return o.select("o_orderkey", "o_orderstatus", field(title, c(97)).alias("title"), authors.alias("authors"), field(F.year("o_orderdate").cast("string"), c(83)).alias("date"), field(F.lit("book"), c(71)).alias("kind"))


_EXTRACTED = """e AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 11 > 0 THEN o_orderpriority END AS title, o_orderkey % 97 / 100 AS ct, o_orderkey % 83 / 100 AS cd, o_orderkey % 71 / 100 AS ck,
  CASE WHEN o_orderkey % 7 = 0 THEN [] WHEN o_orderkey % 2 = 0 THEN [o_orderkey % 91 / 100] ELSE [o_orderkey % 91 / 100, o_orderkey % 92 / 100] END AS ca, CAST(year(o_orderdate) AS VARCHAR) AS date FROM orders)"""


def review_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _extractions(spark, sf_dir)
    fields = [F.col(c) for c in ("title", "authors", "date", "kind")]
    low = metadata.needs_review(F.col("title.confidence"), F.array_max(F.transform("authors", lambda a: a["confidence"])), F.col("date.confidence"), F.col("kind.confidence"))
    return found.select("o_orderkey", F.array_join(metadata.review_reasons(*fields), "; ").alias("reasons"), metadata.overall_confidence(*fields).alias("overall"), metadata.wants_second_opinion(*fields[:3]).alias("second"), F.array_join(low, ",").alias("low"))


_REVIEW_SQL = f"""WITH {_EXTRACTED}, m AS (SELECT *, list_avg(ca) AS mean FROM e)
SELECT o_orderkey, array_to_string(list_filter([
    CASE WHEN title IS NULL THEN 'title could not be extracted' WHEN ct < 0.7 THEN format('title confidence {{:.2f}} below threshold 0.70', ct) END,
    CASE WHEN len(ca) = 0 THEN 'no authors could be extracted' WHEN list_max(ca) < 0.7 THEN format('authors average confidence {{:.2f}} below threshold 0.70', round(CAST(mean AS DECIMAL(18, 6)), 2)::DOUBLE) END,
    CASE WHEN cd < 0.7 THEN format('date confidence {{:.2f}} below threshold 0.70', cd) END,
    CASE WHEN ck < 0.7 * 0.7 THEN format('document type confidence {{:.2f}} is low', ck) END], lambda r: r IS NOT NULL), '; ') AS reasons,
  round(least(ct, cd, ck, list_min(ca)), 2) AS overall, ct < 0.7 OR cd < 0.7 OR coalesce(list_max(ca) < 0.7, true) AS second,
  array_to_string(list_filter([CASE WHEN ct < 0.7 THEN 'title' END, CASE WHEN coalesce(list_max(ca), 0) < 0.7 THEN 'authors' END, CASE WHEN cd < 0.7 THEN 'date' END, CASE WHEN ck < 0.7 * 0.7 THEN 'type' END], lambda r: r IS NOT NULL), ',') AS low FROM m"""


def second_opinion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second extractor's titles where the status is F, and names where it is O."""
    found = _extractions(spark, sf_dir)
    title = metadata.merged(F.col("title"), F.when(F.col("o_orderstatus") == "F", F.lit("Other")))
    names = metadata.merged_people(F.col("authors"), F.when(F.col("o_orderstatus") == "O", F.array(F.lit("A, B"), F.lit(""), F.lit("C, D"))))
    found = found.select("o_orderkey", title.alias("t"), names.alias("a"))
    total = F.aggregate("a", F.lit(0.0), lambda s, x: s + x["confidence"])
    return found.select("o_orderkey", "t.value", "t.source", F.col("t.reasoning").alias("reasoning"), F.array_join(F.transform("a", lambda x: x["value"]), ";").alias("authors"), F.round(total, 6).alias("confidence"))


_SECOND_SQL = f"""WITH {_EXTRACTED} SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Other' ELSE title END AS value, CASE WHEN o_orderstatus = 'F' THEN 'llm' ELSE 'heuristic' END AS source,
  CASE WHEN o_orderstatus = 'F' THEN 'LLM extraction (heuristic: ' || coalesce(title, 'None') || ')' ELSE 'why' END AS reasoning,
  CASE WHEN o_orderstatus = 'O' THEN 'A, B;C, D' ELSE array_to_string(list_transform(range(len(ca)), lambda i: 'N' || (i + 1)), ';') END AS authors,
  round(CASE WHEN o_orderstatus = 'O' THEN 2 * coalesce(list_avg(ca), 0.3) ELSE coalesce(list_sum(ca), 0) END, 6) AS confidence FROM e"""


def metadata_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What extraction does to documents whose metadata came from various sources."""
    o = _read(spark, sf_dir, "orders")
    null = F.lit(None).cast("string")
    rows = o.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", "FILENAME").when(F.col("o_orderstatus") == "O", "ZOTERO").otherwise("EXPLICIT").alias("source"),
        F.when(F.col("o_orderkey") % 3 > 0, "Old").alias("citekey"), F.lit("old").alias("title"), null.alias("authors"), null.alias("issued_date"), F.lit(None).cast("int").alias("issued_year"),
        null.alias("error_message"), F.lit("ready").alias("status"), F.when(F.col("o_orderkey") % 5 > 1, "New").otherwise("Old").alias("new_key"), F.lit("new").alias("new_title"),
        F.lit("A, B").alias("new_authors"), F.lit("2020").alias("new_date"), F.lit(2020).alias("new_year"), (F.col("o_orderkey") % 13 > 0).alias("useful"),
        F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("low"), F.lit("lower"))).otherwise(F.array().cast("array<string>")).alias("reasons"),
    )
    return metadata.upgraded(rows).select("o_orderkey", "action", "source", "citekey", "title", "issued_date", "error_message", "status")


_UPGRADE_SQL = """WITH r AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FILENAME' WHEN 'O' THEN 'ZOTERO' ELSE 'EXPLICIT' END AS source, CASE WHEN o_orderkey % 3 > 0 THEN 'Old' END AS citekey,
  CASE WHEN o_orderkey % 5 > 1 THEN 'New' ELSE 'Old' END AS new_key, o_orderkey % 13 > 0 AS useful, o_orderkey % 2 = 0 AS low FROM orders),
a AS (SELECT *, CASE WHEN source <> 'FILENAME' OR NOT useful THEN 'keep' WHEN citekey IS NULL OR citekey = new_key THEN 'upgrade' ELSE 'review' END AS action FROM r)
SELECT o_orderkey, action, CASE WHEN action = 'upgrade' THEN 'TEXT_EXTRACTED' ELSE source END AS source, CASE WHEN action = 'upgrade' THEN coalesce(citekey, new_key) ELSE citekey END AS citekey,
  CASE WHEN action = 'upgrade' THEN 'new' ELSE 'old' END AS title, CASE WHEN action = 'upgrade' THEN '2020' END AS issued_date,
  CASE WHEN action = 'review' THEN 'Text extraction suggests different metadata (citekey would change from @' || citekey || ' to @' || new_key || ').' WHEN action = 'upgrade' AND low THEN 'low; lower' END AS error_message,
  CASE WHEN action = 'review' OR (action = 'upgrade' AND low) THEN 'needs_review' ELSE 'ready' END AS status FROM a"""


_HEADS = [
    "On Things\n\n  By Ada Lovelace and Karl von Frisch; X\nUniversity of Somewhere\n",
    "On Things\n\nGrace Hopper*, Alan M. Turing (Bletchley)\nNiels Bohr\nvol. 3, pp. 7\n\nAbstract\n",
    "On Things\nSmith, J. and Doe, K. (MIT) a@b.org\nDr. Ludwig van Beethoven Jr.\n1. Introduction\n",
    "by\tOtto Hahn\nLise Meitner\n",
]


def author_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names in all documents: behind `by`, before an abstract or by looks, as their heads and own lines have it; a fifth have no head."""
    d = _read(spark, sf_dir, "documents")
    head = F.lit("")
    for i, text in enumerate(_HEADS):
        head = F.when(F.col("doc_id") % 5 == i, text).otherwise(head)
    found = d.select("doc_id", F.posexplode(people.authors(F.concat(head, "text"))).alias("place", "a"))
    return found.select("doc_id", F.col("place").cast("long").alias("place"), "a.value", "a.confidence", "a.reasoning")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _authors_sql() -> str:
    heads = " ".join(f"WHEN {i} THEN " + " || chr(10) || ".join(map(_quoted, h.split("\n"))) for i, h in enumerate(_HEADS))
    signs = " + ".join(f"CASE WHEN regexp_matches(line, {_quoted(p)}) THEN {worth} ELSE 0 END" for worth, p in people.SIGNS)
    short = f"CASE WHEN regexp_matches(line, {_quoted(people.SHORT_NAME)}) AND 5 * length(regexp_replace(line, '\\P{{L}}+', '', 'g')) > 4 * length(line) THEN {people.SHORT_NAME_WORTH} ELSE 0 END"
    plain = f"regexp_replace(regexp_replace(regexp_replace(p, {_quoted(people.NO_NAME)}, '', 'g'), '\\s+', ' ', 'g'), {_quoted(people.EDGES)}, '', 'g')"
    bare = f"regexp_replace(regexp_replace(n, {_quoted(people.TITLES)}, ''), {_quoted(people.SUFFIXES)}, '')"
    turned = f"CASE WHEN contains(m, ',') THEN regexp_replace(m, {_quoted(people.TURNED)}, '\\1, \\2') ELSE regexp_replace(m, {_quoted(people.IN_ORDER)}, '\\2, \\1') END"
    by, none = "'''by'' prefix detected'", ", ".join(map(_quoted, people.INSTITUTIONS))
    return f"""WITH x AS (SELECT doc_id, (CASE doc_id % 5 {heads} ELSE '' END) || text AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))[1:{people.HEAD_LINES}]) AS line, generate_subscripts(string_split(text, chr(10))[1:{people.HEAD_LINES}], 1) - 1 AS ln FROM x WHERE text IS NOT NULL),
t AS (SELECT doc_id, ln, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS line FROM l),
s AS (SELECT *, CASE WHEN line = '' OR length(line) > {people.LONGEST_LINE} OR regexp_matches(lower(line), {_quoted(people.BARRED)}) OR (regexp_matches(lower(line), {_quoted(people.AFFILIATION)}) AND NOT contains(line, ',')) THEN 0
  ELSE least(100, greatest(0, {people.BASE} + {signs} + {short})) END AS score, lag(line) OVER (PARTITION BY doc_id ORDER BY ln) AS before, lead(line) OVER (PARTITION BY doc_id ORDER BY ln) AS after FROM t),
u AS (SELECT *, coalesce(lead(score) OVER (PARTITION BY doc_id ORDER BY ln), 0) AS after_score, min(ln) FILTER (regexp_matches(line, '^(?i:by)\\s')) OVER d AS by_ln,
  coalesce(min(ln) FILTER (lower(line) LIKE 'abstract%') OVER d, 0) AS abs_ln, min(ln) FILTER (ln > 0 AND line = '' AND before <> '') OVER d AS gap FROM s WINDOW d AS (PARTITION BY doc_id)),
v AS (SELECT *, count(*) FILTER (ln > gap AND ln < abs_ln AND score > {people.POSSIBLE}) OVER d AS middles, max(score) FILTER (ln BETWEEN 1 AND {people.SCORED_LINES - 1}) OVER d AS best FROM u WINDOW d AS (PARTITION BY doc_id)),
h AS (SELECT doc_id, ln, CASE WHEN by_ln IS NOT NULL THEN regexp_replace(line, '^(?i:by)\\s+', '') || CASE WHEN after_score >= {people.LIKELY} AND NOT regexp_matches(after, '^(Abstract|Introduction|#)') THEN ', ' || after ELSE '' END ELSE line END AS held,
  CASE WHEN by_ln IS NOT NULL THEN {people.BY_LINE} WHEN middles > 0 THEN {people.BEFORE_ABSTRACT} ELSE best * {people.BY_SCORE} / 100 END AS worth,
  CASE WHEN by_ln IS NOT NULL THEN {by} WHEN middles > 0 THEN 'between title and abstract' ELSE 'author-like patterns' END AS reasoning
  FROM v WHERE CASE WHEN by_ln IS NOT NULL THEN ln = by_ln WHEN middles > 0 THEN ln > gap AND ln < abs_ln AND score > {people.POSSIBLE} ELSE ln BETWEEN 1 AND {people.SCORED_LINES - 1} AND score >= {people.LIKELY} END),
a AS (SELECT *, regexp_replace(held, '\\s+(?i:and)\\s+', ', ', 'g') AS y FROM h),
b AS (SELECT *, list_filter(list_transform(string_split(y, CASE WHEN contains(y, ';') THEN ';' ELSE ',' END), lambda p: {plain}), lambda n: length(n) >= 3 AND regexp_matches(n, '[a-zA-Z]') AND lower(n) NOT IN ({none})) AS ns FROM a),
c AS (SELECT *, list_filter(list_transform(list_transform(ns, lambda n: {bare}), lambda m: {turned}), lambda n: length(n) >= 3) AS vs FROM b),
e AS (SELECT doc_id, ln, worth, reasoning, unnest(vs) AS value, generate_subscripts(vs, 1) AS i FROM c)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ln, i) - 1 AS place, value, round(least(100, worth + CASE WHEN contains(value, ',') THEN {people.FULL_NAME} ELSE 0 END) / 100, 2) AS confidence, reasoning FROM e"""


_AUTHORS_SQL = _authors_sql()


def author_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' names and segments as lists of names."""
    c = _read(spark, sf_dir, "customer")
    names = metadata.author_list(F.concat("c_name", F.lit("; ;"), "c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, " ;").otherwise("; Z ")))
    return c.select("c_custkey", F.size(names).cast("long").alias("names"), F.array_join(names, "|").alias("joined"))


def utc_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' times as ISO-8601 in UTC, of a timestamp and of a string with a zone."""
    e = _read(spark, sf_dir, "events")
    zoned = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit("+02:00"))
    return e.select("event_id", metadata.utc_time(F.col("ts")).alias("utc"), metadata.utc_time(zoned).alias("from_zone"))


def scalar_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time limits by pages, tagged and canonical maps, cut names, and storage paths of parts."""
    p = _read(spark, sf_dir, "part")
    fields = F.create_map(F.lit("name"), F.col("p_name"), F.lit("_metadata_source"), F.lit("FILENAME"), F.lit("brand"), F.col("p_brand"))
    return p.select(
        "p_partkey",
        metadata.extraction_seconds(F.col("p_size") * 10, F.col("p_partkey") % 2 == 0, 300, 7200).cast("long").alias("seconds"),
        output.canonical_json(metadata.tagged(fields, F.lit("EXPLICIT"))).alias("fields"),
        output.truncated(F.col("p_name"), 12).alias("short"),
        files.content_path(F.sha2("p_name", 256), F.lit(".md"), "store").alias("path"),
    )


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as JSON objects; a field that is null is left out."""
    rows = _documents(spark, sf_dir).select("doc_id", "status", "citekey", "embedding_status")
    return output.json_rows(rows)


_JSON_SQL = f"""WITH {_DOCS} SELECT '{{"doc_id":"' || doc_id || '","status":"' || status || '"' || CASE WHEN citekey IS NULL THEN '' ELSE ',"citekey":"' || citekey || '"' END
  || CASE WHEN embedding_status IS NULL THEN '' ELSE ',"embedding_status":"' || embedding_status || '"' END || '}}' AS json FROM d"""


def documents_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the oldest 20 customers as a list of documents."""
    c = _read(spark, sf_dir, "customer")
    rows = catalog.page(c, ["c_custkey"], 20).select(
        F.row_number().over(Window.orderBy("c_custkey")).alias("place"), "total", F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("citekey"), F.when(F.col("c_custkey") % 4 > 0, F.repeat("c_mktsegment", 9)).alias("title"),
        F.when(F.col("c_custkey") % 5 > 0, F.col("c_name")).alias("authors"), F.when(F.col("c_custkey") % 2 > 0, F.col("c_nationkey") + 2000).alias("issued_year"), F.lit("ready").alias("status"),
    )
    return output.documents_markdown(rows)


_MARKDOWN_SQL = """WITH r AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS place FROM customer ORDER BY c_custkey LIMIT 20), t AS (SELECT count(*) AS total FROM customer),
x AS (SELECT place, CASE WHEN c_custkey % 4 > 0 THEN repeat(c_mktsegment, 9) ELSE 'Untitled' END AS title, r.* EXCLUDE (place) FROM r)
SELECT '### Documents (' || count(*) || ' of ' || any_value(total) || ')' || chr(10) || chr(10) || string_agg(place || '. **' || CASE WHEN c_custkey % 3 > 0 THEN '@' || c_name ELSE '(no key)' END || '** '
  || CASE WHEN length(title) > 80 THEN title[:77] || '...' ELSE title END || CASE WHEN c_custkey % 5 > 0 THEN ' - ' || c_name ELSE '' END || CASE WHEN c_custkey % 2 > 0 THEN ' (' || (c_nationkey + 2000) || ')' ELSE '' END || ' [ready]', chr(10) ORDER BY place) AS markdown FROM x, t"""


def author_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of known names that were found, each once, for customers: with initials, in other hyphens, twice, and not at all."""
    c = _read(spark, sf_dir, "customer").select("c_custkey", F.initcap("c_mktsegment").alias("f"), (F.col("c_custkey") % 6).alias("k"))
    name = lambda given: F.concat("f", F.lit(", "), F.lit(given))
    known = F.array(name("Ann B."), F.concat(F.lit("Lee-"), F.col("f"), F.lit(", Jo")))
    cases = [F.array(name("Ann"), F.concat(F.lit("LEE–"), F.col("f"), F.lit(", JO"))), F.array(name("Ann"), name("Ann C.")), F.array(name("Bob")), F.array(name("Ann B."), name("Ann B."), F.lit("x")), F.array().cast("array<string>")]
    found = F.when(F.col("k") == 5, F.array(F.col("f")))
    for i, case in enumerate(cases):
        found = found.when(F.col("k") == i, case)
    rows = c.select("c_custkey", accuracy.author_score(found, known).alias("score"), (F.col("k") < 4).alias("extracted"), accuracy.years_match(F.when(F.col("k") > 1, F.lit(" 2001")), F.lit("2001")).alias("year_ok"), F.lit(1.0).alias("title_similarity"))
    return accuracy.report(rows.withColumn("authors_ok", F.col("score") == 1), mean_score=F.avg("score")).select("documents", *[F.round(x, 6).alias(x) for x in ("extraction_rate", "title_accuracy", "author_accuracy", "year_accuracy", "mean_score")])


_ACCURACY_SQL = """WITH k AS (SELECT c_custkey % 6 AS k FROM customer), s AS (SELECT k, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 WHEN 3 THEN 0.5 ELSE 0.0 END AS score FROM k)
SELECT count(*) AS documents, round(avg(CAST(k < 4 AS INT)), 6) AS extraction_rate, 1.0::DOUBLE AS title_accuracy, round(avg(CAST(score = 1 AS INT)) FILTER (k < 4), 6) AS author_accuracy,
  round(avg(CAST(k > 1 AS INT)) FILTER (k < 4), 6) AS year_accuracy, round(avg(CAST(score AS DOUBLE)), 6) AS mean_score FROM s"""


def price_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.ranked_percentiles(_read(spark, sf_dir, "lineitem"), "l_extendedprice", [0.5, 0.95, 0.99])
    return found.select("share", F.round("value", 4).alias("value"))


def annotated_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with an annotated region before their text and one that is never closed behind it (null texts are empty); and what is left without annotations."""
    d = _read(spark, sf_dir, "documents")
    text = F.concat(F.lit("<!-- feature:table id:t-"), F.col("doc_id"), F.lit(" -->\n| a | b |\n| c |\n<!-- /feature -->\nplain <!-- note -->\n"), F.coalesce("text", F.lit("")), F.lit("\n<!-- feature:list id:l -->\n- x"))
    rows = d.select("doc_id", text.alias("text"))
    found = records.regions(rows, "doc_id", "text")
    bare = rows.select("doc_id", F.sha2(records.without_annotations(F.col("text")), 256).alias("bare_sha256"))
    return found.join(bare, "doc_id").select("doc_id", "place", "feature", "region_id", "content", "bare_sha256")


_REGIONS_SQL = """SELECT doc_id, CAST(0 AS BIGINT) AS place, 'table' AS feature, 't-' || doc_id AS region_id, '| a | b |' || chr(10) || '| c |' AS content,
  sha256('| a | b |' || chr(10) || '| c |' || chr(10) || 'plain <!-- note -->' || chr(10) || coalesce(text, '') || chr(10) || '- x') AS bare_sha256 FROM documents"""


def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as texts with a bibliography in their head: a scalar, an inline list, a block list, none, or no head."""
    s = _read(spark, sf_dir, "supplier")
    name = F.col("s_name")
    heads = [
        F.concat(F.lit("---\ntitle: x\nbibliography: "), name, F.lit(".json # ours\n---\n")),
        F.concat(F.lit('---\nbibliography: ["'), name, F.lit('.json", b.json]\n---\n')),
        F.concat(F.lit("---\nbibliography:\n  - "), name, F.lit(".json\n  - b.json\n---\n")),
        F.lit("---\ntitle: x\n---\n"),
        F.concat(F.lit("bibliography: "), name, F.lit("\n")),
    ]
    text = heads[4]
    for i in range(4):
        text = F.when(F.col("s_suppkey") % 5 == i, heads[i]).otherwise(text)
    return s.select("s_suppkey", files.front_matter_entry(F.concat(text, F.lit("\nbody"))).alias("entry"))


class _Letters:
    """An embedder that SQL can follow: how often each letter stands in a text; it takes many texts at a time."""

    @staticmethod
    def many(texts: list[str], dim: int) -> list[list[float]]:
        return [[float(t.lower().count(chr(97 + i))) for i in range(dim)] for t in texts]


def embedded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents embedded by their letters, with the prefix of documents, each of the right dimension."""
    found = chunking.embed(_read(spark, sf_dir, "documents").select("doc_id", "text"), dim=26, embedder=_Letters(), errors="error")
    v = chunking.checked_dimension(F.col("embedding"), 26)
    found = found.select("doc_id", F.when(F.col("embedding").isNotNull(), v).alias("v"), "error")
    return found.select("doc_id", *[F.get("v", F.lit(i)).cast("long").alias(chr(97 + i)) for i in (0, 4, 18)], F.aggregate("v", F.lit(0.0), lambda s, x: s + x).cast("long").alias("letters"), F.col("error").isNull().alias("sound"))


_LETTER = "length({0}) - length(replace({0}, '{1}', ''))"
_EMBEDDED_SQL = f"""WITH t AS (SELECT doc_id, 'search_document: ' || lower(text) AS t FROM documents)
SELECT doc_id, {", ".join(f"{_LETTER.format('t', c)} AS {c}" for c in "aes")}, length(regexp_replace(t, '[^a-z]', '', 'g')) AS letters, true AS sound FROM t"""


def embedded_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose letters are nearest to those of a question, both with their prefixes."""
    letters = _Letters()
    docs = chunking.embed(_read(spark, sf_dir, "documents").select("doc_id", "text"), dim=26, embedder=letters)
    asked = letters.many(["search_query: how many letters are in here"], 26)[0]
    return ranking.by_vector(docs, asked, 10, "doc_id").select("doc_id", F.round("score", 6).alias("score"))


_COUNTS = "[" + ", ".join(_LETTER.format("{0}", chr(97 + i)) for i in range(26)) + "]"
_DOT = "list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1] * p[2]))"
_ASKED_SQL = f"""WITH t AS (SELECT doc_id, 'search_document: ' || lower(text) AS t FROM documents), q AS (SELECT 'search_query: how many letters are in here' AS t),
v AS (SELECT doc_id, CAST({_COUNTS.format("t")} AS DOUBLE[]) AS v FROM t WHERE t IS NOT NULL), w AS (SELECT CAST({_COUNTS.format("t")} AS DOUBLE[]) AS w FROM q),
s AS (SELECT doc_id, {_DOT.format("v", "w")} / (sqrt({_DOT.format("v", "v")}) * sqrt({_DOT.format("w", "w")})) AS score FROM v, w)
SELECT doc_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, doc_id LIMIT 10"""


def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as CSL records in JSON files, an array of at most 100 each, read back: of records with one key the last stays."""
    s = _read(spark, sf_dir, "supplier")
    item = lambda title: F.struct(F.concat(F.lit("s"), F.col("s_suppkey")).alias("id"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("k"), F.col("s_suppkey"))).alias("citation-key"), F.lit("book").alias("type"), title.alias("title"), F.struct(F.array(F.array(F.lit("2020"), F.lit("5"))).alias("date-parts")).alias("issued"))
    pairs = s.select(F.floor(F.col("s_suppkey") / 100).alias("file"), F.array(F.struct("s_suppkey", F.lit(0).alias("n"), item(F.lit("old")).alias("item")), F.struct("s_suppkey", F.lit(1).alias("n"), item(F.col("s_name")).alias("item"))).alias("items"))
    arrays = pairs.groupBy("file").agg(F.to_json(F.transform(F.array_sort(F.flatten(F.collect_list("items"))), lambda x: x["item"])).alias("value"))
    path = session.scratch_path(spark, "records")
    arrays.write.partitionBy("file").text(path)
    found = records.csl_records(spark, f"{path}/*/*.txt")
    return found.select("key", "id", "title", F.array_join(F.element_at("issued.date-parts", 1), "-").alias("date"))


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents taken up as a stream, each content once; a second run finds nothing new."""
    schema = ", ".join(f"`{n}` {t}" for n, t in _read(spark, sf_dir, "documents").dtypes)
    store, check = session.scratch_path(spark, "store"), session.scratch_path(spark, "stream")
    for _ in range(2):
        # a pattern names the table, be it a file or a folder of files
        ingest.ingest(spark, f"{sf_dir}/documents.parque[t]", store, check, schema).awaitTermination()
    return spark.read.parquet(store).select("doc_id", "content_hash", F.col("status").isin("ready", "needs_review").alias("has_status"))


QUERIES = {
    "embedded_query": embedded_query,
    "record_files": record_files,
    "ingested": ingested,
    "point_lookups": point_lookups,
    "resolved_identifier": resolved_identifier,
    "all_citekeys": all_citekeys,
    "waiting_for_embedding": waiting_for_embedding,
    "embedding_states": embedding_states,
    "chunk_counts": chunk_counts,
    "section_outline": section_outline,
    "text_slices": text_slices,
    "users_slices": users_slices,
    "text_pages": text_pages,
    "documents_table": documents_table,
    "failed_records": failed_records,
    "reextracted": reextracted,
    "migrated": migrated,
    "document_page": document_page,
    "status_union": status_union,
    "attachments": attachments,
    "library_membership": library_membership,
    "collection_membership": collection_membership,
    "collections_by_name": collections_by_name,
    "import_counters": import_counters,
    "csl_validation": csl_validation,
    "csl_processed": csl_processed,
    "manual_update": manual_update,
    "edited_records": edited_records,
    "built_records": built_records,
    "review_policy": review_policy,
    "second_opinion": second_opinion,
    "metadata_upgrade": metadata_upgrade,
    "author_heuristic": author_heuristic,
    "author_lists": author_lists,
    "utc_times": utc_times,
    "scalar_helpers": scalar_helpers,
    "json_rows": json_rows,
    "documents_markdown": documents_markdown,
    "author_accuracy": author_accuracy,
    "price_percentiles": price_percentiles,
    "annotated_regions": annotated_regions,
    "front_matter": front_matter,
    "embedded_texts": embedded_texts,
}

ORACLE_SQL = {
    "embedded_query": _ASKED_SQL,
    "record_files": "SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'k' ELSE 's' END || s_suppkey AS key, 's' || s_suppkey AS id, s_name AS title, '2020-5' AS date FROM supplier",
    "ingested": "SELECT min(doc_id) AS doc_id, sha256(coalesce(text, '')) AS content_hash, true AS has_status FROM documents GROUP BY coalesce(text, '')",
    "point_lookups": f"WITH {_DOCS}, f AS (SELECT doc_id FROM d WHERE citekey IS NOT NULL ORDER BY doc_id LIMIT 1) SELECT unnest(['doc_id', 'original_path', 'content_hash', 'citekey']) AS \"by\", doc_id FROM f",
    "resolved_identifier": _RESOLVED_SQL,
    "all_citekeys": f"WITH {_DOCS} SELECT citekey FROM d WHERE citekey IS NOT NULL",
    "waiting_for_embedding": f"WITH {_DOCS} SELECT doc_id, false AS force FROM d WHERE status = 'ready' AND coalesce(embedding_status, 'pending') IN ('pending', 'stale') UNION ALL SELECT doc_id, true FROM d WHERE status = 'ready'",
    "embedding_states": f"WITH {_DOCS} SELECT doc_id, CASE WHEN status = 'ready' AND coalesce(embedding_status, 'pending') IN ('pending', 'stale') THEN CASE WHEN starts_with(original_path, '/in/1') THEN 'pending' ELSE 'current' END ELSE embedding_status END AS embedding_status FROM d",
    "chunk_counts": f"WITH {_DOCS} SELECT doc_id, count(l_orderkey) AS chunks, count(l_orderkey) > 0 AS has_embeddings FROM d LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag <> 'R' GROUP BY doc_id",
    "section_outline": "WITH f AS (SELECT user_id, event_type AS section, min(event_id) AS first_chunk FROM events WHERE event_type <> 'click' AND event_type <> '' GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_chunk, section) AS place FROM f",
    "text_slices": _SLICES_SQL,
    "users_slices": _USERS_SLICES_SQL,
    "text_pages": _PAGES_SQL,
    "documents_table": _TABLE_SQL,
    "failed_records": f"WITH {_DOCS}, p AS (SELECT '/in/' || c_custkey || '/' || c_custkey || '.pdf' AS p FROM customer) SELECT p AS original_path, sha256(p) AS content_hash, 'failed' AS status, 'unreadable' AS error_code FROM p WHERE p NOT IN (SELECT original_path FROM d)",
    "reextracted": f"WITH {_DOCS} SELECT doc_id, CASE WHEN left(text, 1) = '5' THEN text ELSE upper(text) END AS text, CASE left(text, 1) WHEN '5' THEN status WHEN '1' THEN 'needs_review' ELSE 'ready' END AS status, CASE left(text, 1) WHEN '5' THEN embedding_status ELSE 'stale' END AS embedding_status, CASE left(text, 1) WHEN '1' THEN 'fall-back' END AS error_message FROM d",
    "migrated": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS issued_year, NULL::VARCHAR AS embedding_status, NULL::VARCHAR AS error_code FROM orders",
    "document_page": f"WITH {_DOCS} SELECT doc_id, status, count(*) OVER () AS total FROM d WHERE status = 'ready' ORDER BY created_at DESC, doc_id LIMIT 20",
    "status_union": f"WITH {_DOCS} SELECT status, count(*) AS documents FROM d WHERE status IN ('ready', 'needs_review') GROUP BY 1",
    "attachments": _ATTACHED_SQL,
    "library_membership": f"WITH {_ITEMS} SELECT citekey FROM i WHERE \"libraryID\" = 2 AND citekey IS NOT NULL AND \"itemID\" % 5 > 0",
    "collection_membership": f"WITH {_ITEMS} SELECT citekey FROM i WHERE \"libraryID\" = 2 AND citekey IS NOT NULL AND p_size >= 20",
    "collections_by_name": "SELECT p_type AS name, max(p_partkey) AS \"collectionID\", arg_max(p_brand, p_partkey) AS key FROM part GROUP BY 1",
    "import_counters": _COUNTERS_SQL,
    "csl_validation": f"WITH {_CSL_ISSUES} SELECT doc_id, array_to_string(CASE WHEN len(errors) > 0 THEN errors ELSE warnings END, '; ') AS issues, len(errors) > 0 AS fatal FROM x",
    "csl_processed": _PROCESSED_SQL,
    "manual_update": _MANUAL_SQL,
    "edited_records": _EDITED_SQL,
    "built_records": _BUILT_SQL,
    "review_policy": _REVIEW_SQL,
    "second_opinion": _SECOND_SQL,
    "metadata_upgrade": _UPGRADE_SQL,
    "author_heuristic": _AUTHORS_SQL,
    "author_lists": "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 3 END::BIGINT AS names, c_name || '|' || c_mktsegment || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '|Z' END AS joined FROM customer",
    "utc_times": "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS utc, strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS from_zone FROM events",
    "scalar_helpers": "SELECT p_partkey, CAST(least(greatest(300, CASE WHEN p_partkey % 2 = 0 THEN greatest(900, p_size * 50) ELSE greatest(1800, p_size * 450) END), 7200) AS BIGINT) AS seconds, '{\"_metadata_source\":\"EXPLICIT\",\"brand\":\"' || p_brand || '\",\"name\":\"' || p_name || '\"}' AS fields, CASE WHEN length(p_name) > 12 THEN p_name[:9] || '...' ELSE p_name END AS short, 'store/' || sha256(p_name)[:2] || '/' || sha256(p_name)[3:4] || '/' || sha256(p_name) || '.md' AS path FROM part",
    "json_rows": _JSON_SQL,
    "documents_markdown": _MARKDOWN_SQL,
    "author_accuracy": _ACCURACY_SQL,
    "price_percentiles": "WITH r AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS i, count(*) OVER () AS n FROM lineitem), q AS (SELECT unnest([0.5, 0.95, 0.99]::DOUBLE[]) AS share) SELECT share, round(v, 4) AS value FROM r JOIN q ON i = least(CAST(floor(share * n) AS BIGINT), n - 1)",
    "annotated_regions": _REGIONS_SQL,
    "front_matter": "SELECT s_suppkey, CASE WHEN s_suppkey % 5 < 3 THEN s_name || '.json' END AS entry FROM supplier",
    "embedded_texts": _EMBEDDED_SQL,
}
