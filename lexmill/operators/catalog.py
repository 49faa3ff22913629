"""The catalog: filters, lookups, identity, updates and relational imports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import session

STATUSES = ("pending", "ready", "failed", "needs_review")
EMBEDDING_STATES = ("pending", "current", "stale")
#: Bounds of a search's limit; chunks below which a document's whole text is given, and chunks of a preview.
LEAST_LIMIT, MOST_LIMIT = 1, 100
SHORT_DOCUMENT, PREVIEW = 50, 20
#: Version of the documents' schema, and what each version added.
SCHEMA_VERSION = 4
_ADDED = {2: [("error_message", "string"), ("error_code", "string")], 3: [("embedding_status", "string")], 4: [("issued_year", "int")]}


class LibraryError(Exception):
    """What goes wrong with a library: a code for programs, and details such as suggestions."""

    code = "error"

    def __init__(self, message: str, **details: object):
        super().__init__(message)
        self.details = details


class CatalogError(LibraryError, ValueError):
    """A request that contradicts itself, or is out of bounds."""

    code = "invalid_request"


class NotFound(LibraryError, LookupError):
    code = "not_found"


class Ambiguous(LibraryError, LookupError):
    code = "ambiguous"


class NotReady(LibraryError):
    code = "document_not_ready"


class MetadataInvalid(LibraryError, ValueError):
    code = "metadata_invalid"


class ClientFailed(LibraryError):
    """A language model's client raised an error."""

    code = "client_failed"


def checked_limit(limit: int) -> int:
    """The limit, if it is within its bounds."""
    if not LEAST_LIMIT <= limit <= MOST_LIMIT:
        raise CatalogError(f"limit must be from {LEAST_LIMIT} to {MOST_LIMIT}", limit=limit)
    return limit


def clamped_limit(limit: int) -> int:
    """The limit within its bounds that is next to the given one."""
    return max(LEAST_LIMIT, min(MOST_LIMIT, limit))


def page(rows: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """The first rows in an order, with `total`: how many there were before the limit."""
    total = rows.count()
    return rows.orderBy(*order).limit(limit).withColumn("total", F.lit(total).cast("long"))


def lookup(rows: DataFrame, column: str, value: object) -> DataFrame:
    """Rows whose id, hash, path or key is the value."""
    return rows.filter(F.col(column) == F.lit(value))


def citekeys(rows: DataFrame, key_col: str = "citekey") -> DataFrame:
    """All keys that are not null, sorted."""
    return rows.filter(F.col(key_col).isNotNull()).select(key_col).orderBy(key_col)


def resolve(rows: DataFrame, identifier: str, id_col: str = "doc_id", key_col: str = "citekey") -> DataFrame:
    """The row that `@key`, an id or the beginning of an id names. NotFound has up to three suggestions for a key."""
    if identifier.startswith("@"):
        found = lookup(rows, key_col, identifier[1:]).limit(1)
        if found.count():
            return found
        near = suggestions(rows.filter(F.col(key_col).isNotNull()), key_col, identifier[1:])
        raise NotFound(f"no document has the key {identifier[1:]}", suggestions=[r[0] for r in near.collect()])
    status, found = by_partial_id(rows, identifier, id_col)
    if status != "found":
        raise {"not found": NotFound, "ambiguous": Ambiguous}[status](f"{identifier}: {status}")
    return found


def with_status(rows: DataFrame, *statuses: str) -> DataFrame:
    """Documents in any of the states."""
    return rows.filter(F.col("status").isin(list(statuses)))


def needing_embedding(rows: DataFrame, force: bool = False) -> DataFrame:
    """Ready documents whose embeddings are pending or stale (with force, all ready ones), oldest first."""
    ready = with_status(rows, "ready")
    wanted = ready if force else ready.filter(F.coalesce("embedding_status", F.lit("pending")).isin("pending", "stale"))
    return wanted.orderBy("created_at", "doc_id")


def chunk_counts(docs: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Every document's key with chunks (0 if it has none) and has_embeddings."""
    counts = chunks.groupBy(key).agg(F.count("*").alias("chunks"))
    return docs.select(key).join(counts, key, "left").select(key, F.coalesce("chunks", F.lit(0)).alias("chunks"), F.col("chunks").isNotNull().alias("has_embeddings"))


def outline(chunks: DataFrame, by: list[str], section: str = "section", index: str = "chunk_index") -> DataFrame:
    """Distinct sections that have a name, in the order of their first chunk: section, first_chunk and place (from 1)."""
    first = chunks.filter(F.coalesce(section, F.lit("")) != "").groupBy(*by, section).agg(F.min(index).alias("first_chunk"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("first_chunk", section)).cast("long"))


def text_slice(chunks: DataFrame, total: int, start: int | None = None, end: int | None = None, index: str = "chunk_index") -> tuple[str, DataFrame]:
    """What a reader gets of a document with `total` chunks: `whole` (a short one, whatever was asked), `range` or `preview`."""
    rows = chunks.orderBy(index)
    if total < SHORT_DOCUMENT:
        return "whole", rows
    if start is None and end is None:
        return "preview", chunk_range(rows, index, 0, PREVIEW - 1)
    low, high = start if start is not None else 0, end if end is not None else total - 1
    if low < 0 or high < 0 or low > high or low >= total:
        raise CatalogError(f"no chunks {low} to {high} of {total}", total=total)
    return "range", chunk_range(rows, index, low, min(high, total - 1))


def text_slices(chunks: DataFrame, asked: DataFrame, by: list[str], index: str = "chunk_index") -> DataFrame:
    """What readers get of many documents, each by what was asked of it: `start` and `end` of `asked`, null where open.

    A row per chunk given, with `asked`'s columns, kind, total, first and last; what gives none is one row without a chunk:
    `none` (no chunks at all) and `invalid` (no such chunks). Chunks are numbered from 0 in each document; null keys have none.
    """
    totals = chunks.groupBy(*by).agg(F.count("*").alias("total"))
    rows = asked.join(totals, by, "left").withColumn("total", F.coalesce("total", F.lit(0)).cast("long"))
    low, high = F.coalesce("start", F.lit(0)), F.coalesce("end", F.col("total") - 1)
    invalid = (low < 0) | (high < 0) | (low > high) | (low >= F.col("total"))
    open_ = F.col("start").isNull() & F.col("end").isNull()
    kind = F.when(F.col("total") == 0, "none").when(F.col("total") < SHORT_DOCUMENT, "whole").when(open_, "preview").when(invalid, "invalid").otherwise("range")
    rows = rows.withColumn("kind", kind)
    in_range = F.col("kind") == "range"
    first = F.when(in_range, low).when(F.col("kind").isin("whole", "preview"), 0).cast("long")
    last = F.when(in_range, F.least(high, F.col("total") - 1)).when(F.col("kind") == "whole", F.col("total") - 1).when(F.col("kind") == "preview", PREVIEW - 1).cast("long")
    rows = rows.withColumn("first", first).withColumn("last", last)
    named = chunks.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.col(c) for c in chunks.columns if c not in by])
    match = F.col(index).between(F.col("first"), F.col("last"))
    for c in by:
        match = match & (F.col(c) == F.col(f"_{c}"))
    return rows.join(named, match, "left").drop(*[f"_{c}" for c in by])


def failed_records(paths: DataFrame, documents: DataFrame, path_col: str = "path") -> DataFrame:
    """Records of files that could not be taken up: (path, error_message, error_code) gets a placeholder hash of the path, and state failed.

    A path that a document has already gives none.
    """
    known = documents.select(F.col("original_path").alias(path_col)).distinct()
    fresh = paths.join(known, path_col, "left_anti").groupBy(path_col).agg(F.first("error_message").alias("error_message"), F.first("error_code").alias("error_code"))
    digest = F.sha2(F.col(path_col), 256)
    return fresh.select(F.col(path_col).alias("original_path"), digest.alias("content_hash"), F.lit("failed").alias("status"), "error_message", "error_code")


def reextracted(documents: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents with the new texts (key, text, error): their embeddings become stale, and their state follows; others stay.

    A fall-back extraction is named in error, and makes the state needs_review. Metadata does not change.
    """
    new = texts.select(F.col(key).alias("_key"), F.col("text").alias("_text"), F.col("error").alias("_error"))
    both = documents.join(new, F.col(key) == F.col("_key"), "left")
    hit = F.col("_key").isNotNull()
    status = F.when(F.col("_error").isNotNull(), "needs_review").otherwise("ready")
    changed = {"text": F.coalesce("_text", "text"), "status": status, "error_message": F.coalesce("_error", "error_message"), "embedding_status": F.lit("stale")}
    return both.select(*[F.when(hit, changed[c]).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in documents.columns])


def migrated(rows: DataFrame, version: int) -> DataFrame:
    """Documents of an older schema in the present one: new columns are null, years are taken from dates that start with four digits."""
    for v in range(version + 1, SCHEMA_VERSION + 1):
        for name, kind in _ADDED.get(v, []):
            if name not in rows.columns:
                rows = rows.withColumn(name, F.lit(None).cast(kind))
        if v == 4:
            year = F.when(F.col("issued_date").rlike("^[0-9]{4}"), F.substring("issued_date", 1, 4).try_cast("int"))
            rows = rows.withColumn("issued_year", F.coalesce("issued_year", year))
    return rows


def listing(rows: DataFrame, equals: dict[str, object] | None = None, missing: list[str] | None = None, contains: dict[str, str] | None = None, prefix: dict[str, str] | None = None, order: list[Column | str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows that meet all conditions; `contains` and `prefix` disregard case, and no character is special in them."""
    if set(equals or {}) & set(missing or []):
        raise CatalogError("a column can't both equal a value and be missing")
    tests: list[Column] = [F.col(c) == v for c, v in (equals or {}).items()]
    tests += [F.col(c).isNull() for c in missing or []]
    tests += [F.lower(c).contains(v.lower()) for c, v in (contains or {}).items()]
    tests += [F.lower(c).startswith(v.lower()) for c, v in (prefix or {}).items()]
    found = rows.filter(reduce(lambda a, b: a & b, tests)) if tests else rows
    if order:
        found = found.orderBy(*order)
    return found if limit is None else found.limit(limit)


def by_partial_id(rows: DataFrame, start: str, id_col: str) -> tuple[str, DataFrame]:
    """`found`, `not found` or `ambiguous`, and the rows (two at most) whose id starts so. A whole id is taken first."""
    whole = rows.filter(F.col(id_col).cast("string") == start).limit(1)
    if whole.count():
        return "found", whole
    some = rows.filter(F.col(id_col).cast("string").startswith(start)).limit(2)
    return ("not found", "found", "ambiguous")[some.count()], some


def chunk_range(rows: DataFrame, index: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows from start to end, the end included; either may be open."""
    if start is not None:
        rows = rows.filter(F.col(index) >= start)
    return rows if end is None else rows.filter(F.col(index) <= end)


def suggestions(names: DataFrame, name_col: str, asked: str, most: int = 3, distance: int = 3) -> DataFrame:
    """Names that start with what was asked, then those within the edit distance, nearest first. One scan, no join."""
    away = F.levenshtein(F.lit(asked), F.col(name_col), distance)  # -1 beyond the distance
    starts = F.col(name_col).startswith(asked)
    found = names.select(name_col, (~starts).cast("long").alias("group"), F.when(starts, 0).otherwise(away).cast("long").alias("distance"))
    return found.filter("distance >= 0").orderBy("group", "distance", name_col).limit(most)


def _shortened(name: Column, distance: int) -> Column:
    """A name and all that is left of it without up to `distance` of its characters."""
    found = level = F.array(name)
    for _ in range(distance):
        places = lambda x: F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>"))
        level = F.array_distinct(F.flatten(F.transform(level, lambda x: F.transform(places(x), lambda i: F.concat(F.substring(x, 1, i - 1), F.substring(x, i + 1, F.length(x)))))))
        found = F.concat(found, level)
    return F.array_distinct(found)


def suggestions_for(asked: DataFrame, names: DataFrame, asked_col: str, name_col: str, most: int = 3, distance: int = 2) -> DataFrame:
    """asked, name, distance and place (from 1) of the `most` names within an edit distance of each key, the nearest first.

    Two strings within d edits have a string in common that both give without at most d of their characters. So these are
    the keys of a join, as hashes, for all keys and names at once; what meets is checked by its distance before it is shuffled.
    Keys that have enough names within few edits are done, so only the others are looked up by more. Equal keys and equal names
    are one before they meet. Null keys get nothing.
    """
    parts = session.n_partitions(asked.sparkSession)
    # dealt by number, as texts that fit into one task give hundreds of keys each
    texts = lambda rows, col, out: rows.select(F.col(col).alias(out)).filter(F.col(out).isNotNull()).repartition(parts, out).distinct()
    left, held, done = session.cut(texts(asked, asked_col, "asked"), "asked"), session.cut(texts(names, name_col, "name"), "names"), []
    order = Window.partitionBy("asked").orderBy("distance", "name")
    for edits in range(min(1, distance), distance + 1):
        keys = lambda rows, out: rows.select(out, F.explode(F.array_distinct(F.transform(_shortened(F.col(out), edits), lambda x: F.xxhash64(x)))).alias("key"))  # noqa: B023, E731
        # the keys are many times the texts that their size is guessed by, so they are never broadcast
        met = keys(left.repartition(parts, "asked"), "asked").hint("merge").join(keys(held.repartition(parts, "name"), "name"), "key")
        near = met.select("asked", "name", F.levenshtein("asked", "name", edits).cast("long").alias("distance")).filter("distance >= 0").distinct()
        best = near.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= most)
        if edits < distance:
            best = session.cut(best, "near")
            enough = best.filter(F.col("place") == most).select("asked")
            done.append(best.join(enough, "asked", "left_semi"))
            left = session.cut(left.join(enough, "asked", "left_anti"), "asked")
        else:
            done.append(best)
    return reduce(DataFrame.unionByName, done)


def first_of_content(rows: DataFrame, content: str, order: list[str]) -> DataFrame:
    """Rows with content_sha256, the key of the first row with that content, and whether they are it.

    Copies are reduced to one row before they meet, so a content that many rows share is no hot spot.
    """
    hashed = rows.withColumn("content_sha256", F.sha2(F.coalesce(content, F.lit("")), 256))
    first = hashed.groupBy("content_sha256").agg(F.min(F.struct(*order)).alias("_first"))
    found = hashed.join(first, "content_sha256")
    return found.withColumn("first_key", F.col(f"_first.{order[-1]}")).withColumn("is_first", F.struct(*order) == F.col("_first")).drop("_first")


#: Keys in a block of a filter (64 bits), and blocks that are broadcast at most: some 16 bytes each.
BLOCK_KEYS, MOST_BLOCKS = 4, 2_000_000


def may_match(rows: DataFrame, by: str, asked: DataFrame, key: str) -> DataFrame:
    """Rows whose `by` may be among the values of `key`: all that are, and about one of a hundred others.

    The asked keys set four bits each in one of the 64-bit blocks of a filter, which is broadcast, so rows are dropped where they
    are read and only what is left is shuffled. With more keys than MOST_BLOCKS hold all rows stay, as a filter would be
    too large to send; null matches nothing.
    """
    blocks = -(-asked.count() // BLOCK_KEYS)
    if blocks > MOST_BLOCKS:
        return rows
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(max(1, blocks)))

    def bits(c: Column) -> Column:
        mixed = F.xxhash64(c, F.lit("bits"))
        one = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(mixed, 6 * i).bitwiseAND(F.lit(63)).cast("int"))
        return one(0).bitwiseOR(one(1)).bitwiseOR(one(2)).bitwiseOR(one(3))

    # both sides hash one type, else equal values of two types would differ
    kind = rows.select(by).dtypes[0][1]
    given = asked.select(F.col(key).cast(kind).alias("_k")).filter(F.col("_k").isNotNull())
    sieve = given.groupBy(block(F.col("_k")).alias("_block")).agg(F.bit_or(bits(F.col("_k"))).alias("_bits"))
    met = rows.filter(F.col(by).isNotNull()).join(F.broadcast(sieve), block(F.col(by)) == F.col("_block"))
    own = bits(F.col(by))
    return met.filter(F.col("_bits").bitwiseAND(own) == own).select(*[F.col(f"`{c}`") for c in rows.columns])


def duplicate_reason(new: DataFrame, stored: DataFrame, path: str, digest: str, key: str, but_itself: bool = False) -> DataFrame:
    """`new` with reason (`path`, `content` or null) and stored_key, the smallest key of a stored row that it repeats.

    With `but_itself`, a stored row with its own key counts as another: `new` may then be among the stored rows.
    Of the stored rows only those that may meet a new one are shuffled.
    """

    def firsts(by: str, name: str) -> DataFrame:
        # the two smallest keys are enough, as a row is left out at most
        two = F.slice(F.array_sort(F.collect_set(key)), 1, 2) if but_itself else F.array(F.min(key))
        rows = may_match(stored.select(by, key), by, new, by)
        if but_itself:
            place = F.row_number().over(Window.partitionBy(by).orderBy(key))
            rows = rows.distinct().withColumn("_place", place).filter("_place <= 2")
        return rows.groupBy(F.col(by).alias(f"_{name}")).agg(two.alias(f"_by_{name}"))

    found = new.join(firsts(path, "path"), F.col(path) == F.col("_path"), "left").join(firsts(digest, "hash"), F.col(digest) == F.col("_hash"), "left")
    other = lambda keys: F.get(F.filter(keys, lambda k: ~k.eqNullSafe(F.col(key))) if but_itself else keys, F.lit(0))
    found = found.withColumns({"_by_path": other(F.col("_by_path")), "_by_hash": other(F.col("_by_hash"))})
    reason = F.when(F.col("_by_path").isNotNull(), "path").when(F.col("_by_hash").isNotNull(), "content")
    return found.withColumn("reason", reason).withColumn("stored_key", F.coalesce("_by_path", "_by_hash")).drop("_path", "_hash", "_by_path", "_by_hash")


def coalesce_update(rows: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows with the values of `updates` where these are not null: an update can't empty a field."""
    new = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in columns])
    found = rows.join(new, F.col(key) == F.col("_key"), "left")
    return found.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rows.columns])


def cascade_delete(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """All tables (with their key column) without the rows of the keys that go."""
    return {name: rows.join(gone.select(F.col(key).alias(col)).distinct(), col, "left_anti") for name, (rows, col) in tables.items()}


def upsert(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """key and action (append, unchanged, conflict or keep) with the names of the fields that differ, per record.

    Records are string maps in a column `fields`; their order does not matter.
    """
    both = stored.select(key, F.col("fields").alias("_old")).join(new.select(key, F.col("fields").alias("_new")), key, "full_outer")
    fields = F.array_sort(F.array_union(F.coalesce(F.map_keys("_old"), F.array().cast("array<string>")), F.coalesce(F.map_keys("_new"), F.array().cast("array<string>"))))
    differ = F.filter(fields, lambda f: ~F.element_at("_old", f).eqNullSafe(F.element_at("_new", f)))
    action = F.when(F.col("_old").isNull(), "append").when(F.col("_new").isNull(), "keep").when(F.size(differ) == 0, "unchanged").otherwise("conflict")
    return both.select(key, action.alias("action"), F.when(action == "conflict", differ).otherwise(F.array().cast("array<string>")).alias("fields"))


def entity_values(data: DataFrame, values: DataFrame, fields: DataFrame, items: DataFrame, field: str, library: int | None = None) -> DataFrame:
    """itemID, key and value of one named field of an entity-attribute-value store."""
    wanted = fields.filter(F.col("fieldName") == field).select("fieldID")
    found = data.join(wanted, "fieldID").join(values, "valueID").join(items, "itemID")
    return (found if library is None else found.filter(F.col("libraryID") == library)).select("itemID", "key", "value")


def library_names(libraries: DataFrame, groups: DataFrame) -> DataFrame:
    """libraryID and name: the group's name, else `My Library` for the user's own, else `Library N`."""
    found = libraries.join(groups.select("libraryID", F.col("name").alias("_name")), "libraryID", "left")
    other = F.concat(F.lit("Library "), F.col("libraryID").cast("string"))
    return found.select("libraryID", F.coalesce("_name", F.when(F.col("type") == "user", "My Library"), other).alias("name"))


def attachments(attached: DataFrame, items: DataFrame, prefix: str = "storage:") -> DataFrame:
    """Files of items: itemID of the parent, key, file_name, content_type and link_mode; what has no path, or a web address, is left out."""
    found = attached.filter(F.col("path").isNotNull() & (F.col("path") != "") & ~F.lower("path").rlike("^[a-z]+://")).join(items.select("itemID", "key"), "itemID")
    name = F.when(F.col("path").startswith(prefix), F.substr("path", F.lit(len(prefix) + 1))).otherwise(F.element_at(F.split("path", "/"), -1))
    return found.select(F.col("parentItemID").alias("itemID"), "key", name.alias("file_name"), F.coalesce("contentType", F.lit("application/octet-stream")).alias("content_type"), F.coalesce("linkMode", F.lit(0)).alias("link_mode"))


def library_keys(items: DataFrame, keys: DataFrame, records: DataFrame, library: int) -> DataFrame:
    """Distinct keys of a library's items that have one (itemID, citekey) and whose record was exported (key)."""
    own = items.filter(F.col("libraryID") == library).select("itemID").join(keys.filter(F.col("citekey").isNotNull()), "itemID")
    return own.join(records.select(F.col("key").alias("citekey")), "citekey", "left_semi").select("citekey").distinct()


def collection_keys(members: DataFrame, keys: DataFrame, within: DataFrame | None = None) -> DataFrame:
    """Distinct keys of a collection's direct members (itemID), and of these the ones that `within` (citekey) has, if it is given."""
    found = members.select("itemID").join(keys.filter(F.col("citekey").isNotNull()), "itemID").select("citekey").distinct()
    return found if within is None else found.intersect(within.select("citekey"))


def import_outcomes(wanted: DataFrame, existing: DataFrame, items: DataFrame, files: DataFrame, stored: DataFrame) -> DataFrame:
    """`wanted` (citekey) with outcome, the first that holds: skipped_existing, failed (no item), skipped_no_file, failed (file lost), skipped_duplicate or added.

    items: citekey, itemID; files: itemID, digest (null where the file is lost), of which the first counts; stored: content_hash.
    """
    known = existing.select("citekey").distinct().withColumn("_known", F.lit(True))
    item = items.groupBy("citekey").agg(F.min("itemID").alias("itemID"))
    first = files.groupBy("itemID").agg(F.min_by("digest", F.col("place")).alias("digest"), F.count("*").alias("_files"))
    held = stored.select(F.col("content_hash").alias("digest")).distinct().withColumn("_held", F.lit(True))
    rows = wanted.join(known, "citekey", "left").join(item, "citekey", "left").join(first, "itemID", "left").join(held, "digest", "left")
    outcome = (
        F.when(F.col("_known"), "skipped_existing")
        .when(F.col("itemID").isNull(), "failed")
        .when(F.col("_files").isNull(), "skipped_no_file")
        .when(F.col("digest").isNull(), "failed")
        .when(F.col("_held"), "skipped_duplicate")
        .otherwise("added")
    )
    return rows.select(*wanted.columns, outcome.alias("outcome"))


def import_plan(wanted: DataFrame, existing: DataFrame, key: str, has_file: Column) -> DataFrame:
    """`wanted` with outcome: skip (there already), no file, or import."""
    known = existing.select(F.col(key).alias("_key")).distinct()
    found = wanted.join(known, F.col(key) == F.col("_key"), "left")
    return found.withColumn("outcome", F.when(F.col("_key").isNotNull(), "skip").when(~F.coalesce(has_file, F.lit(False)), "no file").otherwise("import")).drop("_key")


def last_by_name(rows: DataFrame, name: str, order: str) -> DataFrame:
    """Of rows with the same name, the last."""
    return rows.groupBy(name).agg(F.max_by(F.struct(*rows.columns), F.col(order)).alias("_row")).select("_row.*")


def next_states(rows: DataFrame, status: str, event: str) -> DataFrame:
    """`rows` with the status that follows an event; an event that does not fit leaves it."""
    moves = {("pending", "extracted"): "ready", ("pending", "failed"): "failed", ("pending", "uncertain"): "needs_review", ("needs_review", "approved"): "ready", ("failed", "extracted"): "ready", ("ready", "uncertain"): "needs_review"}
    new = F.col(status)
    for (old, what), then in moves.items():
        new = F.when((F.col(status) == old) & (F.col(event) == what), then).otherwise(new)
    return rows.withColumn("next_status", new)


def ranked_first(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of every key."""
    at = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_at", at).filter("_at = 1").drop("_at")
