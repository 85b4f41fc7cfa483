"""Registered queries of the dealt operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe, common, token_alignment, toxicity, vector_codes
from tidemark.llm.common import table
from tidemark.llm.crf_language import predict, train
from tidemark.llm.embedding_dedup import near_duplicate_vectors
from tidemark.llm.hilbert_shards import hilbert_shards
from tidemark.llm.html_blocks import main_text
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.packing import pack
from tidemark.llm.passage_dedup import repeated_passages
from tidemark.llm.phrase_index import decontamination
from tidemark.llm.quality_bayes import quality

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES["op8_minhash_dedup"] = op8_minhash_dedup
ORACLES["op8_minhash_dedup"] = """
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
    FROM words
), grams AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
    SELECT x.doc_id AS a, y.doc_id AS b FROM grams x JOIN grams y ON x.g = y.g AND x.doc_id <> y.doc_id
    GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))
), reach AS (
    SELECT doc_id, doc_id AS other FROM sets
    UNION
    SELECT r.doc_id, p.b FROM reach r JOIN pairs p ON p.a = r.other
), smallest AS (
    SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM sets s JOIN smallest m USING (doc_id)
"""


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = hilbert_shards(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES["op7_hilbert_shards"] = op7_hilbert_shards


def op5_phrase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("item_ids", ","), 256)
    return judged.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


QUERIES["op5_phrase_index"] = op5_phrase_index
ORACLES["op5_phrase_index"] = """
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item_words AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)
), runs AS (
    SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 0) + 1)) AS i FROM words), (SELECT DISTINCT n FROM windows)
    WHERE i + n - 1 <= len(w)
), found AS (
    SELECT doc_id, i, n, item_id FROM runs JOIN windows USING (n, g)
), hit AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM found) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES["op6_packing"] = op6_packing


def remainder(n: int) -> Column:
    """crc32 of the id as text, modulo n: the folds of the labelled tasks."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op4_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.configure(spark)
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(remainder(4) == 2, F.lit(False))
    model = train(docs, remainder(4) != 2)
    return predict(docs, model, [F.col("doc_id"), held_out.alias("held_out")])


QUERIES["op4_crf_language"] = op4_crf_language


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    held_out = F.coalesce(remainder(5) == 0, F.lit(False))
    scored = toxicity.score(docs, model, [F.col("doc_id"), held_out.alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES["op3_toxicity"] = op3_toxicity


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


QUERIES["op10_embedding_dedup"] = op10_embedding_dedup
ORACLES["op10_embedding_dedup"] = """
WITH RECURSIVE usable AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
    SELECT x.vec_id AS a, y.vec_id AS b FROM usable x JOIN usable y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v)
    WHERE list_cosine_similarity(x.v, y.v) >= 0.98
), reach AS (
    SELECT vec_id, vec_id AS other FROM embeddings
    UNION
    SELECT r.vec_id, p.b FROM reach r JOIN pairs p ON p.a = r.other
), smallest AS (
    SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id
), counted AS (
    SELECT a, count(*) AS n FROM pairs GROUP BY a
)
SELECT s.vec_id, coalesce(n, 0) AS n_links, component_id, s.vec_id = component_id AS kept FROM smallest s LEFT JOIN counted c ON c.a = s.vec_id
"""


def op9_quality_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources and paths the languages below them; a fifth of the labels is held out."""
    path = F.concat_ws("/", "source", "lang")
    judged = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), remainder(5) != 0, F.col("source"), path)
    return judged.withColumn("held_out", F.coalesce(remainder(5) == 0, F.lit(False)))


QUERIES["op9_quality_bayes"] = op9_quality_bayes


def op1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


QUERIES["op1_html_blocks"] = op1_html_blocks


def op2_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


QUERIES["op2_passage_dedup"] = op2_passage_dedup


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    ids = byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    both = byte_bpe.decode(ids, ranks, public_tokenizers.PATTERN)
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("raw", 256).alias("decoded_sha256"))


QUERIES["op11_byte_bpe"] = op11_byte_bpe


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(public_tokenizers.path("byte_bpe_50k.json")) as a, open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as b:
        a_json, b_model = a.read(), b.read()
    aligned = token_alignment.align(table(spark, sf_dir, "documents"), a_json, b_model)
    written = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    counted = token_alignment.with_link_counts(aligned.withColumn("groups_sha256", written).drop("groups"), token_alignment.Pieces(b_model).size)
    return counted.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES["op12_token_alignment"] = op12_token_alignment


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))
    hexes = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select("vec_id", hexes.alias("code"), "error", "label_error", F.lit(vector_codes.digest(books)).alias("codebooks_sha256"))


QUERIES["op13_vector_codes"] = op13_vector_codes


def _codes_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """Every part is a row; each round assigns all of them and averages the entries anew."""
    near = """near{r} AS (
    SELECT vec_id, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (
        SELECT c.vec_id, c.p, b.e, list_sum(list_transform(list_zip(c.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM cut c JOIN book{r} b USING (p)
    ) GROUP BY vec_id, p
)"""
    fold = """book{n} AS (
    SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM book{r} b LEFT JOIN (
        SELECT p, e, list(m ORDER BY i) AS x FROM (
            SELECT n.p, n.e, i, CAST(floor(CAST(sum(c.x[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
            FROM near{r} n JOIN cut c USING (vec_id, p), (SELECT unnest(range(1, (SELECT max(len(x)) FROM cut) + 1)) AS i) GROUP BY n.p, n.e, i
        ) GROUP BY p, e
    ) m USING (p, e)
)"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [fold.format(r=r, n=r + 1), near.format(r=r + 1)]
    return f"""
WITH kept AS (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), cut AS (
    SELECT vec_id, p, v[p * len(v) // {parts} + 1:(p + 1) * len(v) // {parts}] AS x FROM kept, (SELECT unnest(range(0, {parts})) AS p)
), ranked AS (
    SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept
), book0 AS (
    SELECT p, e, x FROM cut JOIN ranked USING (vec_id) WHERE e < {entries}
), {", ".join(steps)}, coded AS (
    SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id
), summed AS (
    SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM kept JOIN coded USING (vec_id) GROUP BY label
)
SELECT vec_id, code, error, label_error,
    (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{rounds}) AS codebooks_sha256
FROM kept k JOIN coded USING (vec_id) JOIN summed s ON s.label IS NOT DISTINCT FROM k.label
"""


ORACLES["op13_vector_codes"] = _codes_sql()
