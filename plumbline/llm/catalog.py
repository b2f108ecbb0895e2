"""The queries of the operators in this folder, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from plumbline.llm import embedding, language, packing, periodic, piece_lattice, preference, secret_scan, sharding, simhash, suffix_dedup, wavelet, whitening
from plumbline.llm.exact_dedup import exact_groups
from plumbline.session import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{label}.parquet")


@query
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its group of equal texts."""
    return exact_groups(table(spark, sf_dir, "documents")).drop("payload")


ORACLES["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


TOKENIZER = "word_bpe_49k.json"


@query
def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document, what the wavelet shards hold of it."""
    path = wavelet.write_shards(table(spark, sf_dir, "documents"), shared_path(spark, "wavelet"), public_tokenizers.path(TOKENIZER))
    return wavelet.document_digests(spark, path)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in the packed sequences."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the component it links to."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, budget=3).select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what was found in it, the base kinds digested."""
    found = secret_scan.secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = [r.kind for r in secret_scan.BASE_RULES]

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin(kinds))
    return found.select("doc_id", *[count(k) for k in kinds], F.sha2(secret_scan.spans_text(base), 256).alias("base_sha256"),
                        secret_scan.spans_text(F.col("secrets")).alias("spans"))


@query
def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its predicted language; learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs, ~language.held_out())
    return language.with_language(docs, model).select(
        "doc_id", language.held_out().alias("held_out"), "language.lang_pred", "language.score")


@query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of nearly equal bytes."""
    text = F.coalesce("text", F.lit(""))
    sized = table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return sharding.shard(sized, 16, "doc_id", "size").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


ORACLES["op5_sharding"] = """
WITH steps AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z:
         CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
sized AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size,
         regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS pairs FROM documents),
coded AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(pairs, lambda p: CAST('0x' || p AS BIGINT))),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM sized, steps),
placed AS (SELECT *, CAST(least(15, floor((sum(size) OVER (ORDER BY doc_id) - size) * 16 / sum(size) OVER ())) AS INTEGER) AS shard FROM coded)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM placed"""


@query
def op6_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as chosen; as rejected the same up to a turn set by its id, then the turns of the next conversation."""
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    cuts = said.groupBy("conv_id").agg((F.min("turn") + F.col("conv_id") % F.count(F.lit(1))).alias("cut"))
    own = said.join(cuts, "conv_id").where(F.col("turn") < F.col("cut")).drop("cut")
    following = said.withColumn("conv_id", F.col("conv_id") - 1).join(cuts, "conv_id").where(F.col("turn") >= F.col("cut")).drop("cut")
    turns = said.withColumn("side", F.lit("chosen")).unionByName(own.unionByName(following).withColumn("side", F.lit("rejected")))
    spans = {c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"], s["end"])), ",") for c in ("chosen_mask", "rejected_mask")}
    return preference.format_pairs(turns.withColumnRenamed("conv_id", "pair_id")).withColumns(spans)


ORACLES["op6_preference"] = """
WITH cuts AS (SELECT conv_id, min(turn) + conv_id % count(*) AS cut FROM conversations GROUP BY conv_id),
sides AS (
  SELECT conv_id AS pair_id, 0 AS side, turn, role, text FROM conversations
  UNION ALL SELECT conv_id, 1, turn, role, text FROM conversations JOIN cuts USING (conv_id) WHERE turn < cut
  UNION ALL SELECT c.conv_id, 1, v.turn, v.role, v.text FROM conversations v JOIN cuts c ON v.conv_id = c.conv_id + 1 WHERE v.turn >= cut),
turns AS (SELECT pair_id, side, role, text, row_number() OVER (PARTITION BY pair_id, side ORDER BY turn) - 1 AS pos FROM sides),
same AS (
  SELECT pair_id, pos, count(*) = 2 AND count(DISTINCT role) = 1 AND count(DISTINCT text) = 1 AS alike
  FROM turns GROUP BY ALL),
prefix AS (SELECT pair_id, coalesce(min(pos) FILTER (NOT alike), max(pos) + 1) AS n FROM same GROUP BY pair_id),
parts AS (
  SELECT t.pair_id, pos // 256 AS chunk, pos, role = 'assistant' AND pos >= n AS learnt,
         CASE WHEN pos >= n THEN CASE side WHEN 0 THEN 'chosen' ELSE 'rejected' END WHEN side = 0 THEN 'prompt' END AS part,
         '<|im_start|>' || role || chr(10) AS head, text || '<|im_end|>' AS content
  FROM turns t JOIN prefix USING (pair_id)),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(content) + 1) OVER (
           PARTITION BY pair_id, chunk, part ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins
  FROM parts WHERE part IS NOT NULL),
spans AS (
  SELECT *, CASE WHEN learnt THEN CAST(begins + length(head) AS BIGINT) || ':' || CAST(begins + length(head) + length(content) AS BIGINT) END AS span FROM placed)
SELECT pair_id, chunk,
  coalesce(string_agg(head || content || chr(10), '' ORDER BY pos) FILTER (part = 'prompt'), '') AS prompt,
  coalesce(string_agg(head || content || chr(10), '' ORDER BY pos) FILTER (part = 'chosen'), '') AS chosen,
  coalesce(string_agg(head || content || chr(10), '' ORDER BY pos) FILTER (part = 'rejected'), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (part = 'chosen'), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY pos) FILTER (part = 'rejected'), '') AS rejected_mask,
  count(*) FILTER (part = 'prompt') AS prompt_turns, count(*) FILTER (part = 'chosen') AS chosen_turns,
  count(*) FILTER (part = 'rejected') AS rejected_turns
FROM spans GROUP BY ALL"""


@query
def op10_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its links of cosine 0.98 or more within its label."""
    return embedding.near_duplicate_vectors(table(spark, sf_dir, "embeddings"), 0.98)


@query
def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = piece_lattice.PieceModel.load(public_tokenizers.path("piece_bpe_32k.model"))
    found = piece_lattice.decode(piece_lattice.encode(docs, model), model, alias="decoded")
    return found.select("doc_id", F.size("ids").alias("n_ids"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: the documents of the contract, a tenth of them with their words repeated from some place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("words")).withColumn("n", F.size("words"))
    first = F.expr("g % n")
    period = F.expr("1 + (n - g % n) div (3 + g % 8)")
    rest = F.col("n") - first
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", (first + 1).cast("int"), period.cast("int")), F.ceil(rest / period).cast("int"))), F.lit(1), rest.cast("int"))
    return chosen.select("doc_id", F.when(F.col("n") > 0, F.array_join(F.concat(F.slice("words", F.lit(1), first.cast("int")), again), " "))
                         .otherwise(F.col("text")).alias("text"))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's periodic runs and what is left when each run keeps its first period only."""
    found = periodic.periodic_runs(planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less its bytes in strings of 400 that occur again."""
    found = suffix_dedup.repeated_passages(table(spark, sf_dir, "documents"), 400)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
                        F.coalesce(F.sha2("kept", 256), "text_sha256").alias("kept_sha256"))


# Strings of 400 bytes are 800 hexadecimal digits from an even place on.
ORACLES["op13_suffix_dedup"] = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
starts AS (SELECT r, unnest(range(0, length(h) // 2 - 399)) AS p FROM docs WHERE length(h) >= 800),
coded AS (SELECT r, p, md5_number(substr(h, 2 * p + 1, 800)) AS code FROM starts JOIN docs USING (r)),
again AS (SELECT code FROM coded GROUP BY code HAVING count(*) > 1),
hits AS (SELECT r, p FROM coded WHERE code IN (SELECT code FROM again)),
marked AS (SELECT *, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 400 THEN 0 ELSE 1 END AS first FROM hits),
numbered AS (SELECT *, sum(first) OVER (PARTITION BY r ORDER BY p) AS k FROM marked),
spans AS (SELECT r, k, min(p) AS b, max(p) + 400 AS e FROM numbered GROUP BY r, k),
gaps AS (SELECT r, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY b) AS b, b AS e FROM spans
         UNION ALL SELECT r, max(e) AS b, 1000000000 AS e FROM spans GROUP BY r),
kept AS (SELECT r, string_agg(substr(h, CAST(2 * b + 1 AS BIGINT), CAST(2 * (e - b) AS BIGINT)), '' ORDER BY b) AS h FROM gaps JOIN docs USING (r) GROUP BY r),
sums AS (SELECT r, CAST(sum(e - b) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY r)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM docs d LEFT JOIN sums USING (r) LEFT JOIN kept k USING (r)"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector along the first four components."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), 4)


# Matches and what lies between them alternate, so the lengths of both give the positions.
ORACLES["op3_secret_scan"] = r"""
WITH rules(ord, kind, pattern, least) AS (VALUES
  (0, 'assign', '((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?)([A-Za-z0-9+/_.=-]+)', 6),
  (1, 'access', '(AKIA)([A-Z0-9]+)', 16), (2, 'hex', '()([0-9a-f]{24,})', 24),
  (3, 'github', '(gh[pousr]_)([A-Za-z0-9]+)', 36), (4, 'private_key', '(-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----)()', 0)),
cut AS (
  SELECT doc_id, r.*, regexp_split_to_array(coalesce(text, ''), pattern) AS gaps, regexp_extract_all(coalesce(text, ''), pattern) AS hits
  FROM documents, rules r),
numbered AS (SELECT *, unnest(range(len(hits))) AS i FROM cut),
placed AS (
  SELECT doc_id, ord, kind, hits[i + 1] AS hit, pattern, least,
         list_sum(list_transform(gaps[1:i + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i], lambda h: length(h))), 0) AS begins
  FROM numbered),
spans AS (
  SELECT doc_id, ord, kind, begins, kind || ':' || CAST(begins AS BIGINT) || ':' || CAST(begins + length(hit) AS BIGINT) AS span
  FROM placed WHERE length(regexp_extract(hit, pattern, 2)) >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex, sha256(coalesce(string_agg(span, ',' ORDER BY begins, ord) FILTER (ord < 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY begins, ord), '') AS spans
FROM documents d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""
