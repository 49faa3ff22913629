"""Queries on the catalog, on metadata and on relational imports; with the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.operators import catalog, metadata
from lexmill.plans.search import _read


def list_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of a size whose type holds a word and whose name starts with another, whatever the case."""
    rows = _read(spark, sf_dir, "part")
    return catalog.listing(rows, equals={"p_size": 11}, contains={"p_type": "con"}, prefix={"p_name": "SMALL"}).select("p_partkey", "p_name", "p_type")


def partial_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows that beginnings of ids name: a whole id, one row, none, or two of more (then which two is open, so only their number is given)."""
    customers = _read(spark, sf_dir, "customer").withColumn("id", F.concat(F.col("c_custkey") % 97, F.lit("-"), F.col("c_custkey")))
    last = customers.agg(F.max("c_custkey")).first()[0]
    found = None
    for asked in (f"{last % 97}-{last}", f"{last % 97}-{last}"[:-1] + "x", "5-", f"{last % 97}-"):
        status, rows = catalog.by_partial_id(customers, asked, "id")
        part = rows.agg(F.count("*").alias("rows")).select(F.lit(asked).alias("asked"), F.lit(status).alias("status"), "rows")
        found = part if found is None else found.union(part)
    return found


def range_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.col("l_linenumber").cast("long"))
    return catalog.chunk_range(rows, "l_linenumber", 2, 3).groupBy("l_linenumber").agg(F.count("*").alias("rows"))


def fuzzy_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.suggestions(_read(spark, sf_dir, "customer"), "c_name", "Customer#00000001")


def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every customer's name with a character lost, doubled or replaced (every fourth two), the three nearest names."""
    names = _read(spark, sf_dir, "customer").select("c_custkey", "c_name")
    at = F.pmod(F.col("c_custkey") * 7, F.length("c_name")).cast("int") + 1
    one = lambda x, at, way: F.concat(F.substring(x, 1, at - 1), F.when(way == 0, "").when(way == 1, F.repeat(F.substring(x, at, 1), F.lit(2))).otherwise("x"), F.substring(x, at + 1, F.length(x)))
    asked = names.withColumn("asked", one(F.col("c_name"), at, F.col("c_custkey") % 3))
    asked = asked.withColumn("asked", F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("~"), "asked")).otherwise(F.col("asked")))
    return catalog.suggestions_for(asked, names, "asked", "c_name").withColumnRenamed("name", "c_name")


_FUZZY_SQL = """WITH a AS (SELECT *, CAST((c_custkey * 7) % length(c_name) AS INT) + 1 AS k FROM customer),
b AS (SELECT DISTINCT CASE WHEN c_custkey % 4 = 0 THEN '~' ELSE '' END || c_name[:k - 1] || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_name[k] || c_name[k] ELSE 'x' END || c_name[k + 1:] AS asked FROM a),
d AS (SELECT DISTINCT asked, c_name, levenshtein(asked, c_name) AS distance FROM b, customer WHERE levenshtein(asked, c_name) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY distance, c_name) AS place FROM d) SELECT * FROM r WHERE place <= 3"""


def exact_dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = catalog.first_of_content(_read(spark, sf_dir, "documents"), "text", ["doc_id"])
    return found.select("doc_id", "content_sha256", "first_key", "is_first")


def duplicate_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the first of every path (the id over 10) and of every content; none is its own duplicate."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("doc_id") / 10).alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    firsts = catalog.ranked_first(docs, "path", ["doc_id"]).union(catalog.ranked_first(docs, "digest", ["doc_id"])).distinct()
    found = catalog.duplicate_reason(docs, firsts, "path", "digest", "doc_id", but_itself=True)
    return found.select("doc_id", "reason", "stored_key")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as bibliographic records: the customer's segment as the family name, the priority as the title."""
    orders, customers = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", F.col("c_mktsegment").alias("family"), F.year("o_orderdate").alias("year"), F.concat(F.lit("The "), F.regexp_replace("o_orderpriority", "^[0-9]-", "")).alias("title"), F.col("c_name").alias("record"))


_RECORDS = "r AS (SELECT o_orderkey, c_mktsegment AS family, year(o_orderdate) AS year, 'The ' || regexp_replace(o_orderpriority, '^[0-9]-', '') AS title FROM orders JOIN customer ON o_custkey = c_custkey)"
_STOPS = ", ".join(f"'{w}'" for w in metadata.TITLE_STOP_WORDS)
_KEYS = f"""{_RECORDS}, w AS (SELECT *, list_filter(regexp_extract_all(title, '[a-zA-Z]+'), lambda w: length(w) > 2 AND lower(w) NOT IN ({_STOPS}))[1] AS word FROM r),
k AS (SELECT o_orderkey, regexp_replace(family, '[^a-zA-Z]', '', 'g') || year || coalesce(upper(word[1]) || lower(word[2:]), '') AS base FROM w)"""


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir)
    return rows.select("o_orderkey", metadata.citekey(F.col("family"), F.col("year"), F.col("title"), F.col("record")).alias("base"))


def citekey_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyed(spark, sf_dir).withColumnRenamed("base", "citekey")


def citekey_collision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.unique_citekeys(_keyed(spark, sf_dir), "base", ["o_orderkey"]).select("o_orderkey", "citekey")


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name for every supplier, in five shapes."""
    s = _read(spark, sf_dir, "supplier").withColumn("year", (1990 + F.col("s_suppkey") % 30).cast("string"))
    name = F.translate(F.col("s_name"), "#0123456789", "")
    shapes = [
        F.concat(name, F.lit(" et al. - "), F.col("year"), F.lit(" - On Supply")),
        F.concat(name, F.lit("_"), F.col("year"), F.lit("_On_Supply")),
        F.concat(name, F.col("year"), F.lit("_draft_b")),
        F.concat(name, F.lit(" - On Supply")),
        F.concat(F.lit("9_"), F.col("s_name")),
    ]
    stem = shapes[4]
    for i in range(4):
        stem = F.when(F.col("s_suppkey") % 5 == i, shapes[i]).otherwise(stem)
    return s.select("s_suppkey", stem.alias("stem"), name.alias("name"), "year")


def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _stems(spark, sf_dir).select("s_suppkey", metadata.parse_filename(F.col("stem")).alias("p"))
    return found.select("s_suppkey", "p.author", F.col("p.year").cast("long").alias("year"), "p.title")


_FILENAME_SQL = """
WITH s AS (SELECT s_suppkey, s_name, translate(s_name, '#0123456789', '') AS name, 1990 + s_suppkey % 30 AS y, s_suppkey % 5 AS k FROM supplier)
SELECT s_suppkey, CASE WHEN k = 4 THEN NULL ELSE name END AS author, CASE WHEN k IN (0, 1, 2) THEN CAST(y AS BIGINT) END AS year,
  CASE k WHEN 2 THEN 'draft b' WHEN 4 THEN '9 ' || s_name ELSE 'On Supply' END AS title FROM s
"""


def author_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as authors, customers' segments as particles and given names."""
    s = _read(spark, sf_dir, "supplier")
    person = F.struct(
        F.translate("s_name", "#0123456789", "").alias("family"),
        F.when(F.col("s_suppkey") % 4 == 1, "Jean-pierre m. X").when(F.col("s_suppkey") % 4 == 2, "J. Robert").alias("given"),
        F.when(F.col("s_suppkey") % 4 == 3, F.col("s_name")).alias("literal"),
        F.when(F.col("s_suppkey") % 3 == 0, "von").alias("non-dropping-particle"),
    )
    return s.select("s_suppkey", metadata.authors(F.array(person, person)).alias("authors"))


_AUTHOR_SQL = """
WITH s AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 3 = 0 THEN 'von ' ELSE '' END || translate(s_name, '#0123456789', '') AS f, s_suppkey % 4 AS k FROM supplier),
a AS (SELECT s_suppkey, CASE k WHEN 1 THEN f || ', J.-P.m.X.' WHEN 2 THEN f || ', J.R.' WHEN 3 THEN s_name ELSE f END AS a FROM s)
SELECT s_suppkey, a || '; ' || a AS authors FROM a
"""


def issued_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates as CSL records: the year from JSON, and partial dates."""
    o = _read(spark, sf_dir, "orders")
    y, m, d = F.year("o_orderdate"), F.month("o_orderdate"), F.dayofmonth("o_orderdate")
    record = F.to_json(F.struct(F.struct(F.array(F.array(y, m, d)).alias("date-parts")).alias("issued")))
    some = F.col("o_orderkey") % 3
    date = metadata.partial_date(y, F.when(some > 0, m), F.when(some > 1, d))
    return o.select("o_orderkey", metadata.csl_year(record).cast("long").alias("issued_year"), date.alias("issued_date"))


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts with dates in several places."""
    o = _read(spark, sf_dir, "orders")
    iso, year = F.date_format("o_orderdate", "yyyy-MM-dd"), F.year("o_orderdate").cast("string")
    text = (
        F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("A title\n\nPublished: May 5, "), year))
        .when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("A title\n"), iso, F.lit("\nCopyright 2001")))
        .when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("a\nb\nc\nin "), year, F.lit(" we")))
        .otherwise("no date at all")
    )
    return o.select("o_orderkey", text.alias("text"))


def date_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _dated(spark, sf_dir).select("o_orderkey", metadata.publication_year(F.col("text")).alias("d"))
    return found.select("o_orderkey", F.col("d.value").alias("year"), F.col("d.confidence").alias("confidence"), F.col("d.reasoning").alias("reasoning"))


# 4k: label .9, then the standalone year of line 2 at .49. 4k + 1: copyright .8, ISO .7. 4k + 2: standalone .46 alone.
_DATE_SQL = """
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN '2001' WHEN 2 THEN CAST(year(o_orderdate) AS VARCHAR) END AS year,
  CASE o_orderkey % 4 WHEN 0 THEN 0.87 WHEN 1 THEN 0.67 WHEN 2 THEN 0.41 ELSE 0.0 END AS confidence,
  CASE o_orderkey % 4 WHEN 0 THEN 'explicit label' WHEN 1 THEN 'copyright text' WHEN 2 THEN 'standalone year' ELSE 'no date patterns found' END AS reasoning
FROM orders
"""


def doctype_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they are, with a line before them that holds signs of several kinds."""
    docs = _read(spark, sf_dir, "documents")
    head = F.element_at(F.array(*[F.lit(s) for s in _SIGNS]), (F.col("doc_id") % len(_SIGNS) + 1).cast("int"))
    found = docs.select("doc_id", metadata.document_kind(F.concat(head, F.lit("\n"), "text")).alias("k"))
    return found.select("doc_id", "k.value", "k.confidence")


#: Lines with one sign, several of a kind, of more than one kind, and none.
_SIGNS = ["PhD thesis, a dissertation", "Proceedings of a Workshop, a short paper", "Technical Report TR-12, Journal of X", "Journal of X, vol. 3, issue 4, pp. 5", "Chapter 7", "In: Handbook. Editors: A, B. ISBN 1", "working paper, white paper", "Master's degree", "no sign at all", "Publisher: P, accepted at ICML 2020"]
_SIGN_LIST = ", ".join("'" + s.replace("'", "''") + "'" for s in _SIGNS)


def _kind_sql() -> str:
    """The weighted signs, stated anew: every sign that the head of a text has gives its weight to its kind."""
    tests = " UNION ALL ".join("SELECT doc_id, '{}' AS value, {} AS weight, {} AS place FROM h WHERE regexp_matches(head, '(?m){}')".format(kind, weight, i, sign.replace("'", "''")) for i, (sign, kind, weight) in enumerate(metadata.KINDS))
    return f"""
WITH t AS (SELECT doc_id, text IS NULL AS none, [{_SIGN_LIST}][doc_id % {len(_SIGNS)} + 1] || chr(10) || text AS t FROM documents), h AS (SELECT doc_id, lower(t[:3000]) AS head FROM t),
s AS ({tests}),
k AS (SELECT doc_id, value, CASE WHEN count(*) > 1 THEN least(0.95, max(weight) + 0.2 * (sum(weight) - max(weight))) ELSE max(weight) END AS score, max(weight) AS top, arg_min(place, (-weight, place)) AS place FROM s GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, top DESC, place) AS rank FROM k)
SELECT t.doc_id, coalesce(value, 'article-journal') AS value, CAST(CASE WHEN none THEN 0.2 ELSE coalesce(round(CAST(score AS DOUBLE), 2), 0.4) END AS DOUBLE) AS confidence FROM t LEFT JOIN b ON b.doc_id = t.doc_id AND rank = 1"""


def left_join_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer's name, null where there is none."""
    orders, customers = _read(spark, sf_dir, "orders"), _read(spark, sf_dir, "customer").filter("c_acctbal > 0")
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


def anti_join_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with each customer, if those with a large order are there already and debts mean no file."""
    customers, orders = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders").filter("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey"))
    return catalog.import_plan(customers, orders, "c_custkey", F.col("c_acctbal") >= 0).select("c_custkey", "outcome")


def import_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anti_join_import(spark, sf_dir).groupBy("outcome").agg(F.count("*").alias("rows"))


def semi_join_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of nations in one region."""
    nations = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    return _read(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi").select("s_suppkey", "s_name")


def eav_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as an entity-attribute-value store, asked for the brand of each."""
    parts = _read(spark, sf_dir, "part")
    names = ["p_name", "p_brand", "p_type"]
    data = parts.select(F.col("p_partkey").alias("itemID"), F.explode(F.array(*[F.struct(F.lit(i).alias("fieldID"), F.col(c).alias("value")) for i, c in enumerate(names)])).alias("d")).select("itemID", "d.*")
    values = data.select("value").distinct().withColumn("valueID", F.xxhash64("value"))
    data = data.select("itemID", "fieldID", F.xxhash64("value").alias("valueID"))
    fields = spark.createDataFrame(list(enumerate(names)), "fieldID int, fieldName string")
    items = parts.select(F.col("p_partkey").alias("itemID"), F.concat(F.lit("K"), F.col("p_partkey").cast("string")).alias("key"), F.lit(1).alias("libraryID"))
    return catalog.entity_values(data, values, fields, items, "p_brand", 1)


def library_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as libraries, regions as groups."""
    nations = _read(spark, sf_dir, "nation")
    libraries = nations.select(F.col("n_nationkey").alias("libraryID"), F.when(F.col("n_nationkey") == 7, "user").otherwise("group").alias("type"))
    return catalog.library_names(libraries, _read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("libraryID"), F.col("r_name").alias("name")))


def coalesce_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers take the segment of their latest order's priority; those without orders keep theirs."""
    customers, orders = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    new = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("c_mktsegment"))
    return catalog.coalesce_update(customers, new, "c_custkey", ["c_mktsegment"]).select("c_custkey", "c_name", "c_mktsegment")


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left per table when customers with a debt go, and their orders with them."""
    customers, orders = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders")
    left = catalog.cascade_delete({"customer": (customers, "c_custkey"), "orders": (orders, "o_custkey")}, customers.filter("c_acctbal < 0"), "c_custkey")
    counts = [rows.agg(F.count("*").alias("rows")).select(F.lit(name).alias("name"), "rows") for name, rows in left.items()]
    return counts[0].union(counts[1])


def bibliography_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' records as they stand, and as a new export has them: those with orders are stored, those without debts exported, rich ones with a segment in small letters."""
    c, orders = _read(spark, sf_dir, "customer"), _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    record = lambda segment: F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), segment)
    stored = c.join(orders, "c_custkey", "left_semi").select("c_custkey", record(F.col("c_mktsegment")).alias("fields"))
    new = c.filter("c_acctbal >= 0").select("c_custkey", record(F.when(F.col("c_acctbal") > 5000, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment"))).alias("fields"))
    found = catalog.upsert(stored, new, "c_custkey")
    return found.select("c_custkey", "action", F.array_join("fields", ",").alias("fields"))


def event_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first field of the events' JSON by type, and how often each value stands there."""
    events = _read(spark, sf_dir, "events")
    props = F.from_json("props", "map<string,string>")
    spread = events.select("event_type", F.explode(props).alias("field", "value"))
    return spread.groupBy("event_type", "field").agg(F.count("*").alias("rows"), F.countDistinct("value").alias("values"))


QUERIES = {
    "list_filter": list_filter,
    "partial_id": partial_id,
    "range_slice": range_slice,
    "fuzzy_suggest": fuzzy_suggest,
    "fuzzy_join": fuzzy_join,
    "exact_dedupe_first": exact_dedupe_first,
    "duplicate_reason": duplicate_reason,
    "citekey_gen": citekey_generation,
    "citekey_collision": citekey_collision,
    "filename_parse": filename_parse,
    "author_format": author_format,
    "issued_year_backfill": issued_dates,
    "date_heuristic": date_heuristic,
    "doctype_heuristic": doctype_heuristic,
    "left_join_metadata": left_join_metadata,
    "anti_join_import": anti_join_import,
    "import_outcomes": import_outcomes,
    "semi_join_scope": semi_join_scope,
    "eav_lookup": eav_lookup,
    "library_names": library_names,
    "coalesce_update": coalesce_update,
    "cascade_delete": cascade_delete,
    "bibliography_upsert": bibliography_upsert,
    "event_props_json": event_props_json,
}

_IMPORT = "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) THEN 'skip' WHEN c_acctbal >= 0 THEN 'import' ELSE 'no file' END AS outcome FROM customer"
ORACLE_SQL = {
    "list_filter": "SELECT p_partkey, p_name, p_type FROM part WHERE p_size = 11 AND lower(p_type) LIKE '%con%' AND lower(p_name) LIKE 'small%'",
    "partial_id": "WITH i AS (SELECT (c_custkey % 97) || '-' || c_custkey AS id FROM customer), l AS (SELECT max(c_custkey) AS k FROM customer), a AS (SELECT unnest([(k % 97) || '-' || k, left((k % 97) || '-' || k, length((k % 97) || '-' || k) - 1) || 'x', '5-', (k % 97) || '-']) AS asked FROM l), n AS (SELECT asked, (SELECT count(*) FROM i WHERE id = asked) AS whole, (SELECT count(*) FROM i WHERE starts_with(id, asked)) AS n_some FROM a) SELECT asked, CASE WHEN whole > 0 OR n_some = 1 THEN 'found' WHEN n_some = 0 THEN 'not found' ELSE 'ambiguous' END AS status, CASE WHEN whole > 0 THEN 1 ELSE least(n_some, 2) END AS rows FROM n",
    "range_slice": "SELECT CAST(l_linenumber AS BIGINT) AS l_linenumber, count(*) AS rows FROM lineitem WHERE l_linenumber BETWEEN 2 AND 3 GROUP BY 1",
    "fuzzy_join": _FUZZY_SQL,
    "fuzzy_suggest": "WITH x AS (SELECT c_name, CASE WHEN starts_with(c_name, 'Customer#00000001') THEN 0 ELSE 1 END AS g, levenshtein('Customer#00000001', c_name) AS d FROM customer) SELECT c_name, CAST(g AS BIGINT) AS \"group\", CAST(CASE g WHEN 0 THEN 0 ELSE d END AS BIGINT) AS distance FROM x WHERE g = 0 OR d <= 3 ORDER BY 2, 3, 1 LIMIT 3",
    "exact_dedupe_first": "SELECT doc_id, sha256(coalesce(text, '')) AS content_sha256, min(doc_id) OVER w AS first_key, doc_id = min(doc_id) OVER w AS is_first FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))",
    "duplicate_reason": "WITH d AS (SELECT doc_id, doc_id // 10 AS path, coalesce(text, '') AS t FROM documents), f AS (SELECT DISTINCT doc_id, path, t FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY doc_id) AS a, row_number() OVER (PARTITION BY t ORDER BY doc_id) AS b FROM d) WHERE a = 1 OR b = 1), k AS (SELECT d.doc_id, (SELECT min(f.doc_id) FROM f WHERE f.path = d.path AND f.doc_id <> d.doc_id) AS p, (SELECT min(f.doc_id) FROM f WHERE f.t = d.t AND f.doc_id <> d.doc_id) AS h FROM d) SELECT doc_id, CASE WHEN p IS NOT NULL THEN 'path' WHEN h IS NOT NULL THEN 'content' END AS reason, coalesce(p, h) AS stored_key FROM k",
    "citekey_gen": f"WITH {_KEYS} SELECT o_orderkey, base AS citekey FROM k",
    "citekey_collision": f"WITH {_KEYS}, n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY o_orderkey) - 1 AS i FROM k) SELECT o_orderkey, base || CASE WHEN i = 0 THEN '' WHEN i <= 26 THEN chr(CAST(96 + i AS INT)) ELSE CAST(i - 26 AS VARCHAR) END AS citekey FROM n",
    "filename_parse": _FILENAME_SQL,
    "author_format": _AUTHOR_SQL,
    "issued_year_backfill": "SELECT o_orderkey, year(o_orderdate) AS issued_year, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS issued_date FROM orders",
    "date_heuristic": _DATE_SQL,
    "doctype_heuristic": _kind_sql(),
    "left_join_metadata": "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0",
    "anti_join_import": _IMPORT,
    "import_outcomes": f"SELECT outcome, count(*) AS rows FROM ({_IMPORT}) GROUP BY 1",
    "semi_join_scope": "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name = 'ASIA'))",
    "eav_lookup": "SELECT p_partkey AS \"itemID\", 'K' || p_partkey AS key, p_brand AS value FROM part",
    "library_names": "SELECT n_nationkey AS \"libraryID\", coalesce(r_name, CASE WHEN n_nationkey = 7 THEN 'My Library' ELSE 'Library ' || n_nationkey END) AS name FROM nation LEFT JOIN region ON r_regionkey = n_nationkey",
    "coalesce_update": "WITH o AS (SELECT o_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS p FROM orders GROUP BY 1) SELECT c_custkey, c_name, coalesce(p, c_mktsegment) AS c_mktsegment FROM customer LEFT JOIN o ON o_custkey = c_custkey",
    "cascade_delete": "SELECT 'customer' AS name, count(*) AS rows FROM customer WHERE c_acctbal >= 0 UNION ALL SELECT 'orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)",
    "bibliography_upsert": "WITH x AS (SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS stored, c_acctbal >= 0 AS new, c_acctbal > 5000 AND lower(c_mktsegment) <> c_mktsegment AS other FROM customer) SELECT c_custkey, CASE WHEN NOT stored THEN 'append' WHEN NOT new THEN 'keep' WHEN other THEN 'conflict' ELSE 'unchanged' END AS action, CASE WHEN stored AND new AND other THEN 'segment' ELSE '' END AS fields FROM x WHERE stored OR new",
    "event_props_json": "WITH x AS (SELECT event_type, unnest(json_keys(props)) AS field, props FROM events) SELECT event_type, field, count(*) AS rows, count(DISTINCT props ->> ('$.' || field)) AS values FROM x GROUP BY 1, 2",
}
