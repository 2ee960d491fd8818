"""Registered queries of the training-data operators and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    chat,
    collocations,
    decontaminate,
    infill,
    language,
    minhash,
    mixing,
    multi_index,
    passages,
    pieces,
    sharding,
    suffixes,
    token_files,
)
from millrace.session import scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


END_ID = 2


def tokenizer_file(name: str) -> str:
    """Where the installed public tokenizers keep a file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = scratch(spark, "token-files")
    token_files.write_tokens(docs, path, tokenizer_file("byte_bpe_50k.json"), END_ID)
    return token_files.read_tokens(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op2_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


def op4_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.near_vectors(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE typed AS (
  SELECT vec_id, label, embedding::DOUBLE[64] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS x, b.vec_id AS y FROM typed a JOIN typed b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE array_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
), least AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
counts AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.x = e.vec_id LEFT JOIN counts c ON c.x = e.vec_id
"""


CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    back = chat.read_chats(chat.format_chats(rows.unionByName(extra)))
    told = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPES = [("\\", 2), ("</turn>", 2), ("### ", 2), (": ", 2)]
_ADDED = " + ".join(
    f"(length(x) - length(replace(x, '{mark}', ''))) // {len(mark)} * {code - len(mark)}" for mark, code in _ESCAPES
)
OP5_SQL = f"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}'
  UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, r, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, r, x) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(r) + CASE WHEN r IN ('System', 'User', 'Assistant') THEN 2 ELSE 0 END
    + 2 + length(x) + {_ADDED} + 7)::BIGINT AS formatted_chars
FROM rows_ GROUP BY conv_id
"""


def op6_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = tokenizer_file("piece_bpe_32k.model")
    coded = pieces.encode_pieces(docs, model, keep=["doc_id", "text"])
    back = pieces.decode_pieces(coded, model, keep=["doc_id", "text", "piece_ids", "piece_bytes"])
    return back.select(
        "doc_id",
        F.size("piece_ids").cast("long").alias("n_pieces"),
        F.crc32("piece_bytes").alias("ids_crc32"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("exact"),
    )


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.mark_contaminated(
        table(spark, sf_dir, "documents").select("doc_id", "text"),
        table(spark, sf_dir, "benchmark").select("item_id", "text"),
        keep=["doc_id"],
    )
    return marked.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP8_SQL = rf"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), items AS (
  SELECT item_id, regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), windows AS MATERIALIZED (
  SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], ' ') AS w
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM items WHERE len(ws) > 0)
), occurring AS MATERIALIZED (
  SELECT doc_id, i, n, item_id FROM (
    SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS w FROM (
      SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(ws) >= n))
  JOIN windows USING (n, w)
), hits AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occurring) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM occurring) GROUP BY doc_id
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(ws), false) AS contaminated
FROM docs LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs, minhash.NearDup(width=4))


OP3_SQL = rf"""
WITH RECURSIVE docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({_FOLDED}, '[^\x20\x09-\x0D]+') AS ws FROM documents
), shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM docs WHERE len(ws) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x, y FROM (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2)
  JOIN sizes m ON m.doc_id = x JOIN sizes k ON k.doc_id = y WHERE 100 * shared >= 80 * (m.n + k.n - shared)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM docs UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM docs d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) USING (doc_id)
"""


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return suffixes.remove_repeats(docs, keep=["doc_id"]).select(
        "doc_id",
        "n_bytes",
        "n_removed",
        F.size("removed_spans").cast("long").alias("n_spans"),
        F.sha2("kept_bytes", 256).alias("kept_sha256"),
    )


OP9_SQL = """
WITH docs AS MATERIALIZED (
  SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents
), starts AS (
  SELECT doc_id, i, b[i + 1:i + 50] AS w FROM (SELECT doc_id, b, unnest(range(0, octet_length(b) - 49)) AS i FROM docs WHERE octet_length(b) >= 50)
), repeated AS MATERIALIZED (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY w) AS first FROM starts) WHERE first < doc_id
), spans AS MATERIALIZED (
  SELECT doc_id, min(i) AS lo, max(i) + 50 AS hi FROM (
    SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
      SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -100) + 50)::INT AS fresh FROM repeated))
  GROUP BY doc_id, k
), kept AS (
  SELECT doc_id, string_agg(hex(b[from_ + 1:to_]), '' ORDER BY from_) AS h FROM (
    SELECT s.doc_id, b, coalesce(lag(hi) OVER (PARTITION BY s.doc_id ORDER BY lo), 0) AS from_, lo AS to_ FROM spans s JOIN docs USING (doc_id)
    UNION ALL
    SELECT doc_id, b, hi, octet_length(b) FROM (SELECT doc_id, max(hi) AS hi FROM spans GROUP BY doc_id) JOIN docs USING (doc_id))
  WHERE from_ < to_ GROUP BY doc_id
), sums AS (SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN n_spans IS NULL THEN b ELSE unhex(coalesce(h, '')) END) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    labelled = docs.filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = None if labelled.isEmpty() else language.train(labelled)
    found = language.identify(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix_sources(docs, keep=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return infill.fill_in_middle(docs, keep=["doc_id"]).select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(infill.restored().cast("binary"), 256).alias("restored_sha256"),
    )


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_shard_placement": op2_shard_placement,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_near_vectors": op4_near_vectors,
    "op5_chat_format": op5_chat_format,
    "op6_near_passages": op6_near_passages,
    "op7_pieces": op7_pieces,
    "op8_decontaminate": op8_decontaminate,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_language": op10_language,
    "op11_mixing": op11_mixing,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_collocations": op13_collocations,
}

ANSWERS = {
    "op2_shard_placement": sharding.placement_sql(),
    "op3_near_duplicates": OP3_SQL,
    "op4_near_vectors": OP4_SQL,
    "op5_chat_format": OP5_SQL,
    "op8_decontaminate": OP8_SQL,
    "op9_suffix_dedup": OP9_SQL,
    "op11_mixing": mixing.MIX_SQL,
    "op12_fill_in_middle": infill.INFILL_SQL,
    "op13_collocations": collocations.PHRASES_SQL,
}
