"""The registered queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hourloom.llm import bpe, decontam, fingerprint, hardneg, hmm, langid, linedup, pii, quality, simhash, spans, tokenstore, toxicity
from hourloom.llm.base import documents, fold_of

BYTE_RANKS = "byte_bpe_50k.tiktoken"
WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_MODEL = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 2
# A demonstration key; whoever runs the operator on real data passes one of their own.
PSEUDONYM_KEY = b"demonstration key"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _not_fold(folds: int, fold: int):
    return F.coalesce(fold_of("doc_id", folds) != fold, F.lit(True))


def _held_out(folds: int, fold: int):
    return F.coalesce(fold_of("doc_id", folds) == fold, F.lit(False)).alias("held_out")


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset hash of every text, of its edited text, and their likeness to each other and the next."""
    return fingerprint.edited_neighbours(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-neighbour vote on quality."""
    docs = documents(spark, sf_dir)
    model = quality.train(docs, _labels(spark, sf_dir), _not_fold(3, 1))
    return quality.predict(docs, model).select(
        "doc_id", _held_out(3, 1), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids, and the bytes they stand for."""
    path = public_tokenizers.path(BYTE_RANKS)
    encoded = bpe.encode(documents(spark, sf_dir), path, public_tokenizers.PATTERN)
    back = bpe.decode(encoded, path)
    return back.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by code length under frozen context statistics."""
    docs = documents(spark, sf_dir)
    stats = langid.train(docs, _not_fold(5, 0))
    return langid.predict(docs, stats).select("doc_id", _held_out(5, 0), "lang_pred", "score")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of the worst window."""
    docs = documents(spark, sf_dir)
    net = toxicity.train(docs, _labels(spark, sf_dir), _not_fold(4, 2))
    return toxicity.predict(docs, net).select(
        "doc_id", _held_out(4, 2), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay in the last of them only."""
    return linedup.dedupe_lines(documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256")
    )


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text with its personal data under pseudonyms, and what was found where."""
    found = pii.pseudonyms(documents(spark, sf_dir), PSEUDONYM_KEY)
    return found.select("doc_id", F.size("values").cast("long").alias("n_values"), "values", "text")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written to indexed shards and read back by key."""
    docs = documents(spark, sf_dir)
    store = tokenstore.write_store(docs, public_tokenizers.path(WORD_TOKENIZER), END_ID)
    return store.read(docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and the groups that they form."""
    return simhash.near_duplicates(documents(spark, sf_dir))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark windows in every document."""
    found = decontam.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_hidden_markov_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every text under a hidden Markov model, and under single-token counts."""
    docs, learn = documents(spark, sf_dir), _not_fold(7, 2)
    voc = hmm.vocabulary(docs, learn)
    encoded = hmm.encode(docs, voc, learn)
    scored = hmm.score(encoded, voc, hmm.train(encoded, voc))
    return scored.select("doc_id", _held_out(7, 2), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of tokens of two tokenizers that end together, and how often their links occur in the corpus."""
    files = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_MODEL)
    aligned = spans.align(documents(spark, sf_dir), *files)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and each of its positives, the best rows of other labels in a window of scores."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    scaled = rows.select("vec_id", label.alias("label"), hardneg.whole("embedding", 256.0).alias("vector"))
    return hardneg.mine(scaled, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_document_fingerprints, op2_quality_classifier, op3_byte_bpe, op4_language_id, op5_toxicity,
        op6_line_dedup, op7_pseudonyms, op8_token_store, op9_simhash, op10_decontamination,
        op11_hidden_markov_lm, op12_tokenizer_alignment, op13_hard_negatives,
    )
}

# What SQL can state of the results: lines and benchmark windows in full.
_SPACE = r"chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLES = {
    "op6_line_dedup": f"""
        WITH lines AS (
            SELECT doc_id, u.i AS i, u.line AS line,
                   trim(translate(u.line, '{_UPPER}', '{_LOWER}'), {_SPACE}) AS key
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
                 unnest(list_transform(ls, lambda x, k: {{'line': x, 'i': k}})) AS t(u)
        ), repeated AS (
            SELECT key, max(doc_id) AS last FROM lines WHERE length(key) >= 20
            GROUP BY key HAVING count(DISTINCT doc_id) >= 3
        ), marked AS (
            SELECT l.doc_id, l.i, l.line, coalesce(l.doc_id < r.last, false) AS gone
            FROM lines l LEFT JOIN repeated r ON l.key = r.key
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id
    """,
    "op10_decontamination": rf"""
        WITH doc_words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
        ), item_words AS (
            SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
        ), windows AS (
            SELECT DISTINCT item_id, least(10, len(w)) AS n,
                   array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
            FROM item_words, range(1, greatest(1, len(w) - 9) + 1) AS t(i) WHERE len(w) > 0
        ), sizes AS (SELECT DISTINCT n FROM windows), spans AS (
            SELECT d.doc_id, i, s.n, array_to_string(w[i : i + s.n - 1], ' ') AS win
            FROM doc_words d, sizes s, range(1, len(d.w) - s.n + 2) AS t(i)
        ), found AS (
            SELECT s.doc_id, s.i, s.n, x.item_id FROM spans s JOIN windows x ON s.n = x.n AND s.win = x.win
        ), hits AS (
            SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM found), range(0, n) AS t(k) GROUP BY doc_id
        ), items AS (
            SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
        )
        SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM doc_words LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op13_hard_negatives": """
        WITH rows_ AS (
            SELECT row_number() OVER () AS row_, vec_id,
                   CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT a.row_ AS a_row, a.vec_id AS anchor_id, b.vec_id AS other_id, b.row_ AS b_row, a.label = b.label AS same,
                   CAST(list_dot_product(list_transform(a.v, lambda x: CAST(x AS DOUBLE)),
                                         list_transform(b.v, lambda x: CAST(x AS DOUBLE))) AS BIGINT) AS score
            FROM rows_ a JOIN rows_ b ON a.row_ <> b.row_ WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT * FROM pairs WHERE same
            QUALIFY row_number() OVER (PARTITION BY a_row ORDER BY score DESC, other_id, b_row) <= 5
        ), ranked AS (
            SELECT p.anchor_id, p.other_id AS positive_id, n.other_id AS negative_id, p.score AS positive_score,
                   n.score AS negative_score,
                   row_number() OVER (PARTITION BY p.a_row, p.b_row ORDER BY n.score DESC, n.other_id, n.b_row) AS rank
            FROM positives p JOIN pairs n ON p.a_row = n.a_row AND NOT n.same
                 AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
        )
        SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE rank <= 10
    """,
}
