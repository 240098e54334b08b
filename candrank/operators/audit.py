"""Audits of stored answers: totals recomputed from the rubric, and score distributions by group.

Neither changes a ranking. They show reviewers where a claimed total does not follow from the
answer's own criteria, and how scores and selection differ between groups of candidates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from candrank.plans.joins import lookup_join
from candrank.schemas import KEY

# Digits after the point that count: of weights and claimed totals, and of scores.
_WEIGHT, _SCORE, _SUM = "decimal(16,8)", "decimal(10,6)", "decimal(30,14)"
TOLERANCE = "0.05"
VERDICTS = ("agrees", "differs", "ids differ", "no criteria", "no total", "no rubric")
# Bins per point of a total: a quantile is off by half a bin at most.
BINS = 1000
QUANTILES = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)


def rubric_weights(rubrics: DataFrame) -> DataFrame:
    """(role, _weights): the ids and exact weights of a role's criteria."""
    weight = F.transform(
        "criteria", lambda c: F.struct(c["id"].alias("id"), c["weight"].cast(_WEIGHT).alias("weight"))
    )
    return rubrics.select("role", weight.alias("_weights"))


def _weight_of(criterion: Column) -> Column:
    return F.get(F.filter("_weights", lambda w: w["id"] == criterion["id"]), 0)["weight"]


def recomputed_totals(answers: DataFrame, rubrics: DataFrame, tolerance: str = TOLERANCE) -> DataFrame:
    """Each answer's total, computed anew from its criteria and the rubric's weights.

    ``answers``: keys, criteria (array of id and score) and weighted_total. The products and
    their sum are exact decimals, of weights to 8 digits after the point and scores to 6. An
    id the rubric lacks adds nothing and is listed in ``unknown_ids``; one without a readable
    score counts as not given; ``missing_ids`` are the rubric's that are not given;
    an id given twice adds twice and is listed in ``repeated_ids``. ``verdict`` compares with the
    claimed total only where the ids agree.

    The rubrics come to the answers by role, so the answers stay where they are stored.
    """
    known = F.transform("_weights", lambda w: w["id"])
    given = F.transform("_given", lambda c: c["id"])
    scored = F.filter("criteria", lambda c: c["id"].isNotNull() & c["score"].isNotNull())
    # A null array has no ids; both sides of the comparison need one.
    none = F.array().cast("array<string>")
    rows = lookup_join(answers.select(*KEY, "criteria", "weighted_total"), rubric_weights(rubrics), ["role"])
    rows = rows.withColumn("_given", scored).withColumns(
        {"_ids": F.coalesce(given, none), "_known": F.coalesce(known, none)}
    )
    part = lambda c: F.coalesce(_weight_of(c) * c["score"].cast(_SCORE), F.lit(0).cast(_SUM))
    total = F.aggregate("_given", F.lit(0).cast(_SUM), lambda sum_, c: (sum_ + part(c)).cast(_SUM))
    twice = F.filter(
        F.array_distinct("_ids"), lambda i: F.size(F.filter("_ids", lambda j: i == j)) > 1
    )
    rows = rows.select(
        *KEY,
        F.when(~F.isnan("weighted_total"), F.col("weighted_total")).cast(_WEIGHT).alias("claimed"),
        F.when(F.col("_weights").isNotNull(), total).alias("recomputed"),
        F.sort_array(F.array_except("_known", "_ids")).alias("missing_ids"),
        F.sort_array(F.array_except("_ids", "_known")).alias("unknown_ids"),
        F.sort_array(twice).alias("repeated_ids"),
        F.col("criteria").isNull().alias("_no_criteria"),
        F.col("_weights").isNull().alias("_no_rubric"),
    ).withColumn("difference", F.abs(F.col("recomputed") - F.col("claimed")).cast(_SUM))
    odd = F.size("missing_ids") + F.size("unknown_ids") + F.size("repeated_ids") > 0
    verdict = (
        F.when(F.col("_no_rubric"), "no rubric")
        .when(F.col("_no_criteria"), "no criteria")
        .when(odd, "ids differ")
        .when(F.col("difference").isNull(), "no total")
        .when(F.col("difference") <= F.lit(tolerance).cast(_WEIGHT), "agrees")
        .otherwise("differs")
    )
    return rows.withColumn("verdict", verdict).drop("_no_criteria", "_no_rubric")


def audit_summary(totals: DataFrame) -> DataFrame:
    """Answers per role and verdict, and the largest difference of those whose ids agree."""
    compared = F.col("verdict").isin("agrees", "differs")
    return totals.groupBy("role").agg(
        F.count(F.lit(1)).alias("answers"),
        *[F.count_if(F.col("verdict") == v).alias(v.replace(" ", "_")) for v in VERDICTS],
        F.max(F.when(compared, F.col("difference"))).alias("largest_difference"),
    )


def score_bins(rows: DataFrame, groups: Sequence[str], selected: Column) -> DataFrame:
    """A mergeable sketch of totals: rows and selected rows per role, group and bin of the total.

    A bin is a thousandth of a point, so totals of at most three decimals are kept exactly
    and others to half a bin. With totals from 0 to 10 a group has at most 10,001 rows here, however
    many candidates it has. Rows without a finite total have a null bin; they count in
    the selection rate only.
    """
    total = F.col("weighted_total")
    finite = ~F.isnan(total) & (F.abs(total) < 1e12)
    return rows.groupBy(
        "role", *groups, F.when(finite, F.floor(total * BINS + 0.5)).cast("long").alias("bin")
    ).agg(F.count(F.lit(1)).alias("n"), F.count_if(selected).alias("n_selected"))


def merged_bins(bins: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Sketches of several runs, parts or batches as one."""
    return bins.groupBy("role", *groups, "bin").agg(
        F.sum("n").alias("n"), F.sum("n_selected").alias("n_selected")
    )


def _same(left: list[Column], right: list[Column]) -> Column:
    same = F.lit(True)
    for a, b in zip(left, right, strict=True):
        same = same & a.eqNullSafe(b)
    return same


def distributions(bins: DataFrame, groups: Sequence[str], quantiles: Sequence[float] = QUANTILES) -> DataFrame:
    """Score distribution and selection per role and group, from a merged sketch.

    ``q_<percent>`` is the smallest total that at least that share of the group's scored rows does not
    exceed. ``ks`` is the largest distance between the group's distribution and its whole
    role's (0 equal, 1 apart). ``impact_ratio`` is the group's selection rate over the role's
    highest one, null where nothing is selected. Null groups are groups. Work and
    windows are over bins, of which a group has few, not over candidates.
    """
    groups = list(groups)
    by = ["role", *groups]
    scored = bins.filter("bin is not null")
    upto = W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(*by)
    of_role = scored.groupBy(F.col("role").alias("_role"), F.col("bin").alias("_bin")).agg(F.sum("n").alias("_rn"))
    role_rows = of_role.select(
        "_role",
        "_bin",
        "_rn",
        F.sum("_rn").over(W.partitionBy("_role").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0)).alias("_rcum"),
        F.sum("_rn").over(W.partitionBy("_role")).alias("_rall"),
    )
    counted = scored.select(
        *by, "bin", "n", F.sum("n").over(upto).alias("_cum"), F.sum("n").over(whole).alias("_all")
    ).join(role_rows, _same([F.col("role"), F.col("bin")], [F.col("_role"), F.col("_bin")]))
    after = F.abs(F.col("_cum") * F.col("_rall") - F.col("_rcum") * F.col("_all"))
    before = F.abs(
        (F.col("_cum") - F.col("n")) * F.col("_rall") - (F.col("_rcum") - F.col("_rn")) * F.col("_all")
    )

    def quantile(q: float) -> Column:
        reached = F.col("_cum") >= F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("_all")))
        return (F.min(F.when(reached, F.col("bin"))) / BINS).alias(f"q_{q * 100:g}".replace(".", "_"))

    shape = counted.groupBy(*by).agg(
        F.max("_all").alias("scored"),
        (F.sum(F.col("bin") * F.col("n")) / F.max("_all") / BINS).alias("mean"),
        *map(quantile, quantiles),
        (F.max(F.greatest(after, before)) / (F.max("_all") * F.max("_rall"))).alias("ks"),
    )
    rates = bins.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum("n_selected").alias("selected"))
    rates = rates.withColumn("selection_rate", F.col("selected") / F.col("rows"))
    best = F.max("selection_rate").over(W.partitionBy("role"))
    rates = rates.withColumn("impact_ratio", F.when(best > 0, F.col("selection_rate") / best))
    right = shape.withColumnsRenamed({c: f"_g_{c}" for c in by})
    both = rates.join(right, _same([F.col(c) for c in by], [F.col(f"_g_{c}") for c in by]), "left")
    return both.drop(*[f"_g_{c}" for c in by]).withColumn("scored", F.coalesce("scored", F.lit(0)))
