"""The queries opN_<name> over whole tables, and their SQL for DuckDB.

Each query runs its operator and derives the columns that its contract names from the operator's outputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill import session
from lexmill.llm import chat, cost_packing, exact_dedup, filter_audit, hnsw, language, near_dedup, packing, quality, sharding, spelling, token_file, unigram


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies; the same on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.tune(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `conversations` and conversation -7, whose texts look like control strings.

    The rows become a log of streamed deltas, which is folded into messages again. Every row is a turn of its own; rows
    that repeat a turn number are ordered by role and text.
    """
    trap = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", trap), (-7, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    # a row is a message that was streamed; what comes before the shuffle is a scan, so the ids are the same in every attempt
    messages = rows.withColumnRenamed("turn", "seq").withColumn("message_id", F.monotonically_increasing_id())
    out = chat.render(chat.fold(chat.streamed(messages)))
    out = out.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP1_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text)
    + length(regexp_replace(role || text, '[^\\<\[]', '', 'g')) + 8 + 8 + 7 AS n
  FROM r
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` as token files, written and read back."""
    place = session.scratch_path(spark, "token-files")
    token_file.write(table(spark, sf_dir, "documents"), place, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_file.read(spark, place).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in 16 shards whose counts are at most one apart, equal texts together where they fit."""
    placed = sharding.shard_texts(table(spark, sf_dir, "documents"), 16)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_hnsw_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every 20th of all `embeddings`."""
    vectors = table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.filter("vec_id % 20 = 0"), 20)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of at most 2048 tokens."""
    rows = packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, capacity=2048)
    rows = session.cut(rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), "pieces")
    return packing.pack(rows, 2048, ["doc_id", "piece", "start"])


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates over all `documents`."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("text_key")


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` encoded by unigram Viterbi and decoded again."""
    encode, decode = unigram.columns(spark, unigram.Pieces.load(tokenizer_path("piece_bpe_32k.model")))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("ids", encode("text")).withColumn("decoded", decode("ids"))
    return rows.select("doc_id", unigram.count_ids(F.col("ids")).alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.col("text")).alias("round_trip"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts over all `documents`; the largest id of each stays."""
    return exact_dedup.content_groups(table(spark, sf_dir, "documents"), keep="max").withColumnRenamed("id", "doc_id")


OP8_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM n WINDOW g AS (PARTITION BY t)
"""

def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all `documents`, learned from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs.filter(language.learned_from()))
    found = language.classify(docs.select("doc_id", "text"), model)
    held_out = F.col("doc_id").isNotNull() & ~language.learned_from()
    return found.select("doc_id", held_out.alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.languages").alias("languages"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all `documents`, learned from three quarters of the labels."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels").filter(quality.learned_from()))
    found = quality.classify(docs.select("doc_id", "text"), model, out="score")
    held_out = F.col("doc_id").isNotNull() & ~quality.learned_from()
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all `documents` with their near words, forms and roots."""
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), damage=31))


# crc32 is made of shifts here: a table of 256 values, and a fold over the bytes of `<doc_id>:<run>`
OP11_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(CAST(b AS UBIGINT), range(8)::UBIGINT[]),
      lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) AS r(b))
), runs AS (
  SELECT doc_id, run, count(*) AS k FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run
    FROM documents)
  GROUP BY ALL HAVING length(run) >= 7
), bytes AS (
  SELECT run, k, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, (unicode(c) - 64)::UBIGINT] END)) AS bs
  FROM runs
), hashed AS (
  SELECT run, k, xor(list_reduce(list_prepend(4294967295::UBIGINT, bs), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) AS h
  FROM bytes, crc
), words AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[:(h % length(run))::INT] || run[(h % length(run))::INT + 2:] ELSE run END AS word, k FROM hashed)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2
), places AS (
  SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words
), cuts AS (
  SELECT word, n, i, word[:i - 1] || word[i + 1:] AS cut FROM places
), pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.cut = b.cut AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM cuts a JOIN words b ON a.cut = b.word
  UNION SELECT DISTINCT b.word, a.word, a.n FROM cuts a JOIN words b ON a.cut = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.other_n >= 10 * w.n THEN b.other END AS form, CASE WHEN b.other_n >= 10 * w.n THEN b.other_n END AS form_n
  FROM words w LEFT JOIN best b USING (word)
), steps AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.at = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN steps s USING (word) JOIN forms e ON s.at = e.word WHERE e.form IS NULL
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove of all `documents`, by language, in each of their 120 orders."""
    return filter_audit.audit(filter_audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[ \x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), marks AS (
  SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id
), f AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    [CASE WHEN len(words) < 100 THEN 'A' ELSE '' END,
     CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END,
     CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END,
     CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END,
     CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) THEN 'E' ELSE '' END] AS fails
  FROM d LEFT JOIN marks USING (doc_id)
), c AS (
  SELECT part, array_to_string(fails, '') AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL
), orders AS (
  SELECT '' AS o UNION ALL SELECT o || x FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE NOT contains(o, x)
), steps AS (
  SELECT o AS filter_order, step, o[step] AS own, o[:step - 1] AS before FROM orders, range(1, 6) AS r(step) WHERE length(o) = 5
), hits AS (
  SELECT *, contains(fails, own) AS fail, before <> '' AND regexp_matches(fails, '[' || coalesce(nullif(before, ''), ' ') || ']') AS earlier FROM c, steps
)
SELECT part, filter_order, CAST(step AS INT) AS step,
  CAST(sum(CASE WHEN NOT fail AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN fail AND NOT earlier THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN fail AND earlier THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN fails = own THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN fail AND NOT earlier THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN fail AND NOT earlier THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN fail THEN n * 120 // length(fails) ELSE 0 END) AS BIGINT) AS shapley
FROM hits GROUP BY part, filter_order, step
"""


def op13_cost_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of 1024 tokens of nearly equal attention cost, without padding."""
    rows = cost_packing.pieces(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, longest=512)
    placed = cost_packing.pack(session.cut(rows, "pieces", codec="zstd"), 1024)
    return placed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_token_binary": op2_token_binary,
    "op3_sharding": op3_sharding,
    "op4_hnsw_search": op4_hnsw_search,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_filter_audit": op12_filter_audit,
    "op13_cost_packing": op13_cost_packing,
}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op8_exact_dedup": OP8_SQL, "op11_spelling_variants": OP11_SQL, "op12_filter_audit": OP12_SQL}
