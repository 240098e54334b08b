"""Deterministic ranking per role: exact full numbering, top-N, projection and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candrank import constants as C
from candrank.functions.text import fixed
from candrank.plans.joins import fits, lookup_join
from candrank.plans.scratch import written
from candrank.schemas import KEY

# So many tasks' best rows of a role meet in one.
FAN = 64
ORDER = ("weighted_total", "scored_at", "created_at", "ingest_seq")
_ROW_MASK = (1 << 33) - 1


def scored_candidates(
    state: DataFrame, documents: DataFrame, metadata: DataFrame, trust_reply_id: bool = True
) -> DataFrame:
    """Rows to rank: scored state, its document, and metadata where there is some.

    ``documents``: keys, reply_id, weighted_total, recommend, summary; one row per key.
    With ``trust_reply_id=False`` the state's id is shown instead of the answer's; ``state_id``
    is the state's own id in any case.
    """
    scored = _scored(state)
    shown = ("name", "headline", "location", "current_title", "current_company", "profile_url")
    known = [c for c in shown if c in metadata.columns]
    meta = metadata.select(*KEY, F.lit(True).alias("_meta"), *known)
    both = scored.join(documents, list(KEY), "inner").join(meta, list(KEY), "left")
    fallback = F.when(F.col("_meta"), F.col("candidate_id")).otherwise(F.lit(""))
    shown_id = F.coalesce("reply_id", fallback) if trust_reply_id else F.col("candidate_id")

    def text(name: str) -> Column:
        value = F.col(name) if name in known else F.lit(None).cast("string")
        return F.coalesce(value, F.lit("")).alias(name)

    return both.select(
        "role",
        F.col("candidate_id").alias("state_id"),
        shown_id.alias("candidate_id"),
        *[text(c) for c in shown],
        F.coalesce("weighted_total", F.lit(0.0)).alias("weighted_total"),
        F.coalesce("recommend", F.lit(False)).alias("recommend"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        "scored_at",
        "created_at",
        "ingest_seq",
    )


def _scored(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status") == "scored").select(
        *KEY,
        F.coalesce("score_stage2_at", "score_stage1_at").alias("scored_at"),
        "created_at",
        "ingest_seq",
    )


def scored_order(state: DataFrame, documents: DataFrame) -> DataFrame:
    """The keys of :func:`scored_candidates` and what orders them, without metadata and texts."""
    totals = documents.select(*KEY, F.coalesce("weighted_total", F.lit(0.0)).alias("weighted_total"))
    both = _scored(state).join(totals, list(KEY), "inner")
    return both.select("role", F.col("candidate_id").alias("state_id"), *ORDER)


def rank_order() -> list[Column]:
    """Best total, then earliest scored (no stamp first), then arrival in the state table."""
    return [
        F.col("weighted_total").desc(),
        F.col("scored_at").asc_nulls_first(),
        F.col("created_at").asc_nulls_first(),
        F.col("ingest_seq").asc(),
    ]


def _key(rows: DataFrame) -> list[str]:
    """What names a row: the state's id where the shown one can be another."""
    return ["role", "state_id" if "state_id" in rows.columns else "candidate_id"]


def rank_numbers(narrow: DataFrame, key: list[str], runs: int | None = None) -> DataFrame:
    """(key, rank): every row's place 1..n in its role, from the keys and ``ORDER`` alone.

    All rows are range-sorted by role and order over many tasks, ties too, and written; a
    row's rank is its position in its task's run of the role plus the sizes of the runs before
    it. So a role of any size is split over as many tasks as it needs, or over ``runs``.
    """
    # Written first: finding the ranges then reads these columns only, and the joins behind them run once.
    slim = written(narrow.select(*key, *ORDER), "rank-order")
    order = [F.col("role").asc(), *rank_order()]
    by_range = slim.orderBy(*order) if runs is None else slim.repartitionByRange(runs, *order).sortWithinPartitions(*order)
    placed = written(
        by_range.select(
            *key,
            F.spark_partition_id().alias("_part"),
            F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK)).alias("_row"),
        ),
        "ranked-runs",
    )
    sizes = placed.groupBy("role", "_part").agg(F.min("_row").alias("_start"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("role").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    numbered = lookup_join(placed, offsets, ["role", "_part"], "inner", salt_by=("_row",))
    rank = F.col("_before") + F.col("_row") - F.col("_start") + 1
    return numbered.select(*key, rank.alias("rank"))


def rank_all(rows: DataFrame, narrow: DataFrame | None = None, runs: int | None = None) -> DataFrame:
    """Number every row of every role 1..n.

    Only keys and order columns are sorted; the ranks come back to the rows by their key, so
    rows in the store's bucket layout stay where they are. ``narrow`` is a cheaper table of
    the same keys and order columns, such as :func:`scored_order`.
    """
    key = _key(rows)
    return rows.join(rank_numbers(rows if narrow is None else narrow, key, runs), key, "inner")


def top_numbers(slim: DataFrame, key: list[str], n: int, tasks: int, fan: int = FAN) -> DataFrame:
    """(key, rank) of the first ``n`` rows per role of keys and ``ORDER`` read by ``tasks`` tasks.

    A task sends on ``n`` rows of a role at most, and what ``fan`` tasks kept meets in one, again and
    again until one is left: no step sees more than ``fan * n`` rows of a role, for any n.
    """
    group = F.floor(F.spark_partition_id() / fan).cast("int")
    kept = slim.select(*key, *ORDER, group.alias("_group"))
    while True:
        tasks = -(-tasks // fan)
        best = F.row_number().over(W.partitionBy("role", "_group").orderBy(*rank_order()))
        kept = kept.withColumn("rank", best).filter(F.col("rank") <= n)
        if tasks <= 1:
            return kept.select(*key, F.col("rank").cast("long").alias("rank"))
        kept = kept.drop("rank").withColumn("_group", F.floor(F.col("_group") / fan).cast("int"))


def top_n(rows: DataFrame, n: int = C.DEFAULT_TOP_N, narrow: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """The first ``n`` rows per role with their rank.

    The numbers come from narrow rows; then the whole rows of those n are fetched by key.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    key = _key(rows)
    slim = written((rows if narrow is None else narrow).select(*key, *ORDER), "rank-order")
    top = written(top_numbers(slim, key, n, slim.rdd.getNumPartitions(), fan), "top-numbers")
    return rows.join(F.broadcast(top) if fits(top) else top, key, "inner")


def projected(ranked: DataFrame) -> DataFrame:
    """``role`` and the fixed columns."""
    return ranked.select("role", *C.RANKED_COLUMNS)


def formatted(ranked: DataFrame) -> DataFrame:
    """The fixed columns as they appear in a file: three decimals, true/false."""
    shown = {
        "rank": F.col("rank").cast("string"),
        "weighted_total": fixed(F.col("weighted_total"), 3),
        "recommend": F.col("recommend").cast("string"),
    }
    return ranked.select("role", *[shown.get(c, F.col(c)).alias(c) for c in C.RANKED_COLUMNS])


def bundle_name(width_of: Column, rank: Column, candidate_id: Column, suffix: str = ".pdf") -> Column:
    """Zero-padded rank and id; the width follows the number of ranked rows, 3 at least."""
    digits = F.greatest(F.lit(3), F.length(width_of.cast("string")))
    return F.concat(
        F.lpad(rank.cast("string"), digits, F.lit("0")), F.lit("_"), candidate_id, F.lit(suffix)
    )


def with_bundle_names(top: DataFrame) -> DataFrame:
    """Add ``file_name``. The row count per role is the largest rank of a top-N."""
    sizes = top.groupBy("role").agg(F.max("rank").alias("_size"))
    named = lookup_join(top, sizes, ["role"], "inner", salt_by=("candidate_id",))
    return named.withColumn(
        "file_name", bundle_name(F.col("_size"), F.col("rank"), F.col("candidate_id"))
    ).drop("_size")


def rank_summary(ranked: DataFrame, top: DataFrame, bundle: DataFrame) -> DataFrame:
    """ranked, top_n_written and resumes_copied per role."""
    parts = [
        df.groupBy("role").agg(F.count(F.lit(1)).alias("n")).withColumn("what", F.lit(name))
        for name, df in (("ranked", ranked), ("top_n_written", top), ("resumes_copied", bundle))
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return every.groupBy("role").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("what") == w, F.col("n"))), F.lit(0)).alias(w)
            for w in ("ranked", "top_n_written", "resumes_copied")
        ]
    )
