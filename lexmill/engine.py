"""One object over a stored library: take up documents, look after their metadata, embed, search and ask."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import session
from lexmill.operators import catalog, chunking, context, fulltext, metadata, people, ranking, search_index, titles
from lexmill.sources.store import State, Store, Table
from lexmill.streaming import ingest

MODES = ("hybrid", "vector", "fts")
#: Columns of the documents' table, in the present version of its schema.
DOCUMENTS = (
    "doc_id string, original_path string, content_hash string, text string, status string, citekey string, csl_json string, title string, authors string, "
    "issued_date string, issued_year int, error_message string, error_code string, embedding_status string, source string, created_at timestamp, updated_at timestamp"
)
CHUNKS = "chunk_id string, doc_id string, chunk_index long, section string, text string, embedding array<float>"


class Chunker(Protocol):
    """Cuts documents (doc_id, text) into chunk_id, doc_id, chunk_index, section and text."""

    def __call__(self, docs: DataFrame) -> DataFrame: ...


class Embedder(Protocol):
    """Makes the vector of a text; runs inside of tasks, and on the driver for queries."""

    def __call__(self, text: str, dim: int) -> list[float]: ...


class Scorer(Protocol):
    """Makes a column that says how well a text answers a query, for reranking."""

    def __call__(self, text: Column) -> Column: ...


class Client(Protocol):
    """Streams the parts of a language model's answer."""

    def __call__(self, messages: list[dict], temperature: float) -> Iterator[str]: ...


class Library:
    """Documents, their chunks with vectors, and a full-text index of the chunks, stored below one folder.

    Every change is one commit over all tables that it bears on, and writes what changes, not the tables; a library opened on
    the same folder goes on from there. Several may write at once: who comes second does its work again on the new state.
    """

    def __init__(self, spark: SparkSession, path: str, dim: int = 768, embedder: Embedder = chunking.hashed_vector, chunker: Chunker = chunking.chunk):
        self.spark, self.store = session.tune(spark), Store(spark, path)
        self.dim, self.embedder, self.chunker = dim, embedder, chunker

    # documents

    @property
    def documents(self) -> DataFrame:
        return self._documents(self.store.state())

    @property
    def chunks(self) -> DataFrame:
        return self._chunks(self.store.state())

    def _documents(self, state: State) -> DataFrame:
        return self.store.read(state, "documents", DOCUMENTS, "doc_id")

    def _chunks(self, state: State) -> DataFrame:
        return self.store.read(state, "chunks", CHUNKS, "doc_id")

    def _as_stored(self, rows: DataFrame) -> DataFrame:
        """Rows with the columns and types of the documents' table."""
        kinds = self.spark.createDataFrame([], DOCUMENTS).dtypes
        return rows.select(*[F.col(c).cast(t).alias(c) if c in rows.columns else F.lit(None).cast(t).alias(c) for c, t in kinds])

    def _changed(self, change: Callable[[State], DataFrame]) -> DataFrame:
        """Commit the documents that a change gives for a state, each instead of the one with its id; the documents after it."""

        def work(state: State) -> dict[str, Table] | None:
            rows = session.cut(self._as_stored(change(state)), "changed")
            return {"documents": self.store.upsert(state, "documents", rows, "doc_id")} if rows.head(1) else None

        self.store.change(work)
        self._merge()
        return self.documents

    def _merge(self) -> None:
        """Put small parts of tables and segments of the index together, a commit each."""
        for name, schema in (("documents", DOCUMENTS), ("chunks", CHUNKS)):
            self.store.change(lambda s, n=name, x=schema: None if (t := self.store.merged(s, n, x, "doc_id")) is None else {n: t})
        self.store.change(lambda s: search_index.merged(self.store, s, "index"))

    def add(self, new: DataFrame, source: str = "EXPLICIT") -> DataFrame:
        """Take up rows of original_path and text, with citekey and csl_json or without; returns what became of each.

        original_path, doc_id, outcome: `path` or `content` (a duplicate, of doc_id) or `added`. A row without csl_json gets
        its metadata from its file name, and better ones from its text where these don't change its key. Of new rows with
        one path or content the first by path is added, and the others are its duplicates.
        """
        columns = {"citekey": "string", "csl_json": "string"}
        rows = new.select("original_path", "text", *[F.col(c) if c in new.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()])
        rows = session.cut(rows.withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)), "new")
        names = ["original_path", "content_hash", "doc_id"]
        last: dict[str, DataFrame] = {}

        def work(state: State) -> dict[str, Table]:
            held = self._documents(state)
            fresh = catalog.duplicate_reason(rows, held, "original_path", "content_hash", "doc_id")
            by_path = catalog.ranked_first(fresh.filter("reason is null"), "original_path", ["content_hash"])
            firsts = catalog.ranked_first(by_path, "content_hash", ["original_path"]).drop("reason", "stored_key")
            made = session.cut(self._as_stored(self._described(self._prepared(firsts), source, held)), "made")
            found = catalog.duplicate_reason(rows, held.select(names).union(made.select(names)), "original_path", "content_hash", "doc_id")
            own = made.select(F.col("doc_id").alias("made"), F.struct("original_path", "content_hash").alias("of"))
            found = found.join(own, (F.col("made") == F.col("stored_key")) & (F.col("of") == F.struct("original_path", "content_hash")), "left")
            outcome = F.when(F.col("made").isNotNull(), "added").otherwise(F.col("reason")).alias("outcome")
            last["outcome"] = session.cut(found.select("original_path", F.col("stored_key").alias("doc_id"), outcome), "outcome")
            return {"documents": state.table("documents").plus(self.store.put(state, "documents", made))}

        self.store.change(work)
        self._merge()
        return last["outcome"]

    def _prepared(self, rows: DataFrame) -> DataFrame:
        """Cleaned texts with a state; the hash stays that of the text as it came."""
        return ingest.prepare(rows.withColumnRenamed("content_hash", "came")).drop("content_hash").withColumnRenamed("came", "content_hash")

    def _described(self, rows: DataFrame, source: str, held: DataFrame) -> DataFrame:
        """New documents with their metadata and unique keys."""
        stem = F.regexp_replace(F.element_at(F.split("original_path", "/"), -1), r"\.[^.]*$", "")
        name = rows.withColumn("named", metadata.parse_filename(stem))
        family = F.when(F.col("named.author").isNotNull(), F.array(F.struct(F.col("named.author").alias("family"))))
        year = F.when(F.col("named.year").isNotNull(), F.struct(F.array(F.array("named.year")).alias("date-parts")))
        guess = F.to_json(F.struct(F.lit("document").alias("type"), F.col("named.title").alias("title"), family.alias("author"), year.alias("issued")))
        name = name.withColumn("source", F.when(F.col("csl_json").isNotNull(), source).otherwise("FILENAME")).withColumn("csl_json", F.coalesce("csl_json", guess))
        found = session.cut(name.withColumn("p", metadata.processed(F.col("csl_json"), F.col("citekey"))).drop("named"), "named")
        keyed = found.withColumn("base", F.coalesce("p.citekey", F.concat(F.lit("unknown-"), F.substring("content_hash", 1, 8))))
        text = F.col("text")
        read = keyed.withColumns({"t": titles.title(text), "a": people.authors(text), "d": metadata.publication_year(text), "k": metadata.document_kind(text)})
        first = F.get("a", F.lit(0))
        read = read.withColumns(
            {
                "title": F.col("p.title"),
                "authors": F.col("p.authors"),
                "issued_date": F.col("p.issued_date"),
                "issued_year": F.col("p.issued_year"),
                "error_message": F.col("p.error"),
                "new_title": F.col("t.value"),
                "new_authors": F.when(F.size("a") > 0, F.array_join(F.transform("a", lambda x: x["value"]), "; ")),
                "new_date": F.col("d.value"),
                "new_year": F.col("d.value").try_cast("int"),
                "new_key": metadata.citekey(F.split(first["value"], ",")[0], F.col("d.value"), F.col("t.value"), text),
                "useful": F.col("t.value").isNotNull() | (F.size("a") > 0),
                "reasons": metadata.review_reasons(F.col("t"), F.col("a"), F.col("d"), F.col("k")),
                "citekey": F.col("base"),
            }
        )
        done = metadata.upgraded(read).withColumns({"doc_id": F.sha2(F.concat_ws("|", "original_path", "content_hash"), 256), "embedding_status": F.lit("pending"), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "error_code": F.lit(None).cast("string")})
        done = done.withColumn("base", F.col("citekey")).drop("citekey")
        taken = held.filter("citekey is not null").select("citekey")
        unique = metadata.unique_citekeys(session.cut(done.select("base", *[c for c in held.columns if c != "citekey"]), "made"), "base", ["original_path"], taken)
        return unique.select(*held.columns)

    def fail(self, paths: DataFrame) -> DataFrame:
        """Record files (path, error_message, error_code) that could not be taken up."""
        ids = {"doc_id": F.sha2(F.concat_ws("|", "original_path", "content_hash"), 256), "embedding_status": F.lit("pending"), "created_at": F.current_timestamp(), "updated_at": F.current_timestamp()}
        return self._changed(lambda s: catalog.failed_records(paths, self._documents(s)).withColumns(ids))

    def get(self, identifier: str) -> DataFrame:
        """The document that `@key`, an id or the beginning of an id names."""
        return catalog.resolve(self.documents, identifier)

    def list(self, limit: int = 20, **conditions) -> DataFrame:
        """A page of documents, the newest first, with their total."""
        return catalog.page(catalog.listing(self.documents, **conditions), [F.desc("created_at"), "doc_id"], limit)

    def reextract(self, texts: DataFrame) -> DataFrame:
        """New texts (doc_id, text, error) of documents; their embeddings become stale."""
        cleaned = self._prepared(texts.withColumn("content_hash", F.lit(""))).select("doc_id", "text", "error")
        return self._changed(lambda s: catalog.reextracted(self._documents(s).join(cleaned.select("doc_id"), "doc_id", "left_semi"), cleaned))

    def update(self, updates: DataFrame) -> DataFrame:
        """Set status, citekey and csl_json (with the fields that follow from it) of documents (doc_id); null leaves a field as it is."""
        fields = {"status": "string", "citekey": "string", "csl_json": "string"}
        rows = updates.select("doc_id", *[F.col(c) if c in updates.columns else F.lit(None).cast(t).alias(c) for c, t in fields.items()]).withColumn("u", metadata.updated_by_hand(F.col("csl_json")))
        rows = rows.select("doc_id", "status", "citekey", "csl_json", "u.title", "u.authors", "u.issued_date", "u.issued_year").withColumn("updated_at", F.current_timestamp())
        changed = ["status", "citekey", "csl_json", "title", "authors", "issued_date", "issued_year", "updated_at"]
        return self._changed(lambda s: catalog.coalesce_update(self._documents(s).join(rows.select("doc_id"), "doc_id", "left_semi"), rows, "doc_id", changed))

    def delete(self, keys: DataFrame) -> DataFrame:
        """Remove documents (doc_id) with their chunks; the others keep theirs."""
        keys = session.cut(keys.select("doc_id").distinct(), "keys")

        def work(state: State) -> dict[str, Table]:
            tables = {n: self.store.without(state, n, keys, "doc_id") for n in ("documents", "chunks")}
            return tables | self._unindexed(state, keys)

        self.store.change(work)
        self._merge()
        return self.documents

    def _unindexed(self, state: State, keys: DataFrame) -> dict[str, Table]:
        """The index's tables without the chunks of documents."""
        own = self._chunks(state).join(keys.select("doc_id"), "doc_id", "left_semi").select("chunk_id", "text")
        return search_index.removed(self.store, state, "index", session.cut(own, "unindexed"), "chunk_id")

    # chunks

    def embed(self, force: bool = False) -> DataFrame:
        """Cut and embed the ready documents whose embeddings are pending or stale (with force, all ready ones); the others keep their chunks.

        doc_id, chunks and failed of what was done: a document whose embedding fails stays pending, and is tried again next time.
        Chunks, vectors, index and states change in one commit.
        """
        last: dict[str, DataFrame] = {}

        def work(state: State) -> dict[str, Table] | None:
            documents = self._documents(state)
            wanted = session.cut(catalog.needing_embedding(documents, force).select("doc_id", "text"), "wanted")
            cut = chunking.embed(self.chunker(wanted), dim=self.dim, embedder=self.embedder, errors="embedding_error")
            made = session.cut(cut, "embedded")
            bad = made.filter("embedding_error is not null").select("doc_id").distinct()
            good = made.join(bad, "doc_id", "left_anti").drop("embedding_error").withColumn("embedding", chunking.checked_dimension(F.col("embedding"), self.dim))
            counts = made.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.col("embedding_error").isNotNull()).alias("failed"))
            last["done"] = wanted.select("doc_id").join(counts, "doc_id", "left").select("doc_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("failed", F.lit(False)).alias("failed"))
            if not wanted.head(1):
                return None
            kinds = dict(self.spark.createDataFrame([], CHUNKS).dtypes)
            fresh = session.cut(good.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()]), "fresh")
            states = wanted.select("doc_id").join(bad.withColumn("failed", F.lit(True)), "doc_id", "left").select("doc_id", F.when(F.col("failed"), "pending").otherwise("current").alias("embedding_status"))
            named = catalog.coalesce_update(documents.join(wanted.select("doc_id"), "doc_id", "left_semi"), states, "doc_id", ["embedding_status"])
            tables = {"documents": self.store.upsert(state, "documents", session.cut(self._as_stored(named), "states"), "doc_id")}
            tables["chunks"] = self.store.without(state, "chunks", wanted, "doc_id").plus(self.store.put(state, "chunks", fresh))
            tables |= self._unindexed(state, wanted)
            index = tables.get("index", state.table("index"))
            return tables | {"index": index.plus(search_index.segment(self.store, state, "index", fresh, "chunk_id"))}

        self.store.change(work)
        self._merge()
        return last["done"]

    @property
    def index(self) -> search_index.Index:
        return search_index.opened(self.store)

    def chunks_of(self, identifier: str, start: int | None = None, end: int | None = None) -> tuple[str, DataFrame]:
        """`whole`, `range` or `preview`, and the chunks of a document in order."""
        own = self.chunks.join(F.broadcast(self.get(identifier).select("doc_id")), "doc_id", "left_semi")  # one id
        return catalog.text_slice(own, own.count(), start, end)

    # search

    def search(self, query: str, k: int = 10, mode: str = "hybrid", rerank: bool = False, scorer: Scorer | None = None, doc_ids: list[str] | None = None) -> DataFrame:
        """The best k chunks: chunk_id, doc_id, chunk_index, section, text, score, methods, title, citekey and rank.

        `doc_ids` narrows the k nearest vectors after they were found, and full-text hits before.
        """
        if mode not in MODES:
            raise catalog.CatalogError(f"mode must be one of {MODES}", mode=mode)
        catalog.checked_limit(k)
        pool, chunks = ranking.pool_size(k) if rerank else k, self.chunks
        within = None if doc_ids is None else chunks.filter(F.col("doc_id").isin(doc_ids))
        found = self.retriever(mode)(query, pool, within)
        rows = chunks.drop("embedding").join(F.broadcast(found), "chunk_id")  # at most `pool` rows
        if rerank:
            rows = ranking.rerank(rows, k, scorer or (lambda t: ranking.overlap_score(t, query)), "text", "doc_id", "score", "chunk_id")
            rows = rows.withColumn("score", F.col("rerank_score")).drop("rerank_score")
        named = F.broadcast(ranking.ranked(rows, F.desc("score"), "chunk_id")).join(self.documents.select("doc_id", "title", "citekey"), "doc_id", "left")
        return named.orderBy("rank")

    def retriever(self, mode: str) -> Callable[[str, int, DataFrame | None], DataFrame]:
        """The function of a mode that gives chunk_id, score and methods of a query's best chunks."""
        return {"vector": self._by_vector, "fts": self._by_text, "hybrid": self._by_both}[mode]

    def _by_vector(self, query: str, k: int, within: DataFrame | None) -> DataFrame:
        near = ranking.by_vector(self.chunks, self.embedder("search_query: " + query, self.dim), k, "chunk_id")
        return near if within is None else near.join(within.select("chunk_id"), "chunk_id", "left_semi")

    def _by_text(self, query: str, k: int, within: DataFrame | None) -> DataFrame:
        return ranking.by_text(self.index, query, k, within)

    def _by_both(self, query: str, k: int, within: DataFrame | None) -> DataFrame:
        near = self._by_vector(query, ranking.POOL * k, within)
        lists = [(ranking.ranked(near, F.desc("score"), "chunk_id"), "vector", 1.0)]
        try:
            hits = self._by_text(query, ranking.POOL * k, within)
            lists.append((ranking.ranked(hits, F.desc("score"), "chunk_id"), "fts", ranking.FULLTEXT_WEIGHT))
        except fulltext.QueryError:
            pass
        return ranking.rrf(lists, k, "chunk_id").select("chunk_id", "score", "methods")

    def stream(self, question: str, client: Client, k: int = 10, system: str = "Answer from the context.", temperature: float = 0.3, **how) -> context.Stream:
        """An answer in parts from the best chunks. Without any the client isn't asked; what it raises becomes ClientFailed."""
        rows = self.search(question, k, **how).withColumn("key", F.coalesce("citekey", "doc_id"))
        return context.stream(rows.select("key", "section", "text", "rank"), question, lambda messages: client(messages, temperature), system)

    def ask(self, question: str, client: Client, k: int = 10, **how) -> context.Answer:
        """The whole answer at once."""
        return self.stream(question, client, k, **how).answer()
