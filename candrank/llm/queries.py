"""The registered queries of this subpackage, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.llm.bpe import digested, encode
from candrank.llm.common import LOWER, UPPER, table
from candrank.llm.edit_counts import count_edited
from candrank.llm.exact_dedup import exact_dedup
from candrank.llm.kneser_ney import perplexity_scores
from candrank.llm.lexical_search import rank_items
from candrank.llm.near_dedup import link
from candrank.llm.ngram_join import join
from candrank.llm.order_minhash import fingerprint
from candrank.llm.packing import pack
from candrank.llm.quality import classify
from candrank.llm.sharding import shard
from candrank.llm.whitening import whiten
from candrank.llm.wrappers import extract


def op1_karmarkar_karp(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; equal texts together."""
    return shard(table(spark, sf, "documents"), 16).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op2_wrapper_inference(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of all pages by the wrappers of their hosts."""
    return extract(table(spark, sf, "pages"))


def op3_grouping_genetic(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens."""
    return pack(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_distinct_words(spark: SparkSession, sf: str) -> DataFrame:
    """All documents encoded by the public ranks and decoded again."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return digested(encode(table(spark, sf, "documents"), path, public_tokenizers.PATTERN), path)


def op5_co_training(spark: SparkSession, sf: str) -> DataFrame:
    """All documents with their calibrated quality by two co-trained views."""
    return classify(table(spark, sf, "documents"), table(spark, sf, "labels")).select(
        "doc_id", "p_text", "p_meta", "quality_score", "keep"
    )


def op6_edit_aware(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of all documents before and after three edits each.

    Near a quarter of a text ten code points go, in the middle the name of its source comes in,
    and near its end one word is replaced.
    """
    docs = table(spark, sf, "documents")
    n = F.char_length("text")
    named = F.concat(F.lit(" "), F.coalesce("source", F.lit("")), F.lit(" (edited)\n"))
    steps = F.array(
        *(
            F.struct(
                F.lit(seq).alias("seq"),
                F.floor(n * part / 20).alias("start"),
                F.lit(length).alias("length"),
                insert.alias("insert"),
            )
            for seq, part, length, insert in (
                (1, 5, 10, F.lit("")),
                (2, 10, 0, named),
                (3, 18, 6, F.lit("Überarbeitet 2024")),
            )
        )
    )
    edits = docs.select("doc_id", F.explode(steps).alias("e")).select("doc_id", "e.*")
    return count_edited(
        docs,
        edits,
        public_tokenizers.path("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op7_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    """All documents scored by the bigram model of nine tenths of them."""
    return perplexity_scores(table(spark, sf, "documents"))


def op8_odd_sketches(spark: SparkSession, sf: str) -> DataFrame:
    """All documents linked at a similarity of 0.8 of their 4-word shingles."""
    return link(table(spark, sf, "documents"))


def op9_order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    """All documents and their edited texts as Order MinHash fingerprints."""
    return fingerprint(table(spark, sf, "documents"))


def op10_tree_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Equal texts after lower-casing A-Z; the largest doc_id stays."""
    return exact_dedup(table(spark, sf, "documents"))


def op11_limited_accumulators(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return rank_items(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_prefix_filter_join(spark: SparkSession, sf: str) -> DataFrame:
    """All documents linked at a similarity of 0.85 of their 4-word shingles."""
    return join(table(spark, sf, "documents"))


def op13_spectrum_slicing(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings on up to 16 whitened components."""
    return whiten(table(spark, sf, "embeddings"))


#: Terms of the lexical search: ASCII letters and digits and all characters beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS text_sha256
  FROM documents
), g AS (
  SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM d JOIN g USING (text_sha256)
"""

OP11_SQL = f"""
WITH word AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM (SELECT DISTINCT item_id, text FROM benchmark)
), asked AS (
  SELECT item_id, term, count(*) AS q FROM word GROUP BY item_id, term
), d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms
  FROM documents
), sized AS (
  SELECT r, doc_id, terms, len(terms) AS n FROM d WHERE len(terms) > 0
), total AS (
  SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized
), posting AS (
  SELECT r, term, count(*) AS tf
  FROM (SELECT r, unnest(terms) AS term FROM sized) JOIN (SELECT DISTINCT term FROM asked) USING (term)
  GROUP BY r, term
), weight AS (
  SELECT term, CAST(floor(1000 * ln(any_value(2 * big_n + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM posting, total GROUP BY term
), scored AS (
  SELECT item_id, r,
    CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * big_n) // big_l)))) AS BIGINT) AS score
  FROM asked JOIN weight USING (term) JOIN posting USING (term) JOIN sized USING (r), total
  GROUP BY item_id, r
), ranked AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM scored JOIN sized USING (r) WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

QUERIES = {
    "op1_karmarkar_karp": (op1_karmarkar_karp, None),
    "op2_wrapper_inference": (op2_wrapper_inference, None),
    "op3_grouping_genetic": (op3_grouping_genetic, None),
    "op4_distinct_words": (op4_distinct_words, None),
    "op5_co_training": (op5_co_training, None),
    "op6_edit_aware": (op6_edit_aware, None),
    "op7_kneser_ney": (op7_kneser_ney, None),
    "op8_odd_sketches": (op8_odd_sketches, None),
    "op9_order_minhash": (op9_order_minhash, None),
    "op10_tree_merge": (op10_tree_merge, OP10_SQL),
    "op11_limited_accumulators": (op11_limited_accumulators, OP11_SQL),
    "op12_prefix_filter_join": (op12_prefix_filter_join, None),
    "op13_spectrum_slicing": (op13_spectrum_slicing, None),
}


def queries() -> dict:
    return {name: fn for name, (fn, _) in QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
