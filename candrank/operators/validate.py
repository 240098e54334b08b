"""Answer validation: lenient types, bounds, and the two consistency rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank.functions import variant as V


def _reply_id(payload: Column, candidate_id: Column) -> Column:
    """The answer's id; filled only where the key is absent. NULL means invalid."""
    given = V.field(payload, "$.candidate_id")
    return F.when(V.absent(given), candidate_id).otherwise(V.text(given))


def _knockouts(payload: Column) -> Column:
    return F.transform(
        V.items(payload, "$.knockouts"),
        lambda k: F.struct(
            V.text(V.field(k, "$.id")).alias("id"),
            V.boolean(V.field(k, "$.passed")).alias("passed"),
            V.text(V.field(k, "$.reasoning")).alias("reasoning"),
        ),
    )


def _criteria(payload: Column) -> Column:
    return F.transform(
        V.items(payload, "$.criteria"),
        lambda c: F.struct(
            V.text(V.field(c, "$.id")).alias("id"),
            V.number(V.field(c, "$.score")).alias("score"),
            V.text(V.field(c, "$.reasoning")).alias("reasoning"),
        ),
    )


def _outside(x: Column) -> Column:
    return x.isNull() | ~x.between(0.0, 10.0)


def _bad_knockout(k: Column) -> Column:
    return k["id"].isNull() | k["passed"].isNull() | k["reasoning"].isNull()


def _bad_criterion(c: Column) -> Column:
    return c["id"].isNull() | _outside(c["score"]) | c["reasoning"].isNull()


def _wrong(items: Column, bad) -> Column:
    return items.isNull() | F.coalesce(F.exists(items, bad), F.lit(True))


def _wrong_ids(items: Column, ids: Column) -> Column:
    """Strict form: every id is the rubric's, and the counts agree."""
    return (F.size(items) != F.size(ids)) | F.coalesce(
        F.exists(items, lambda i: ~F.array_contains(ids, i["id"])), F.lit(False)
    )


def any_failed(knockouts: Column) -> Column:
    return F.exists(knockouts, lambda k: ~k["passed"])


def _checked(df: DataFrame, checks: list[tuple[str, Column]], score: Column) -> DataFrame:
    """Add ``invalid`` (text, NULL where valid) and ``score`` (struct, NULL where not)."""
    names = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in checks]))
    problem = F.concat(F.lit("invalid: "), F.array_join(F.col("_names"), ", "))
    invalid = F.when(~V.is_object(F.col("payload")), F.lit("answer is not an object")).when(
        F.size("_names") > 0, problem
    )
    named = df.withColumn("_names", names)
    return V.settled(named, invalid=invalid, score=F.when(invalid.isNull(), score))


def validate_full(
    df: DataFrame, criterion_ids: Column | None = None, knockout_ids: Column | None = None
) -> DataFrame:
    """``payload`` and ``candidate_id`` -> ``score`` or ``invalid``.

    A failed knockout forces ``recommend`` to false. With the id columns given, ids and
    item counts must match the rubric as well.
    """
    payload = F.col("payload")
    staged = df.withColumns(
        {
            "_id": _reply_id(payload, F.col("candidate_id")),
            "_criteria": _criteria(payload),
            "_knockouts": _knockouts(payload),
            "_total": V.number(V.field(payload, "$.weighted_total")),
            "_recommend": V.boolean(V.field(payload, "$.recommend")),
            "_summary": V.text(V.field(payload, "$.summary")),
        }
    )
    criteria, knockouts = F.col("_criteria"), F.col("_knockouts")
    checks = [
        ("candidate_id", F.col("_id").isNull()),
        ("criteria", _wrong(criteria, _bad_criterion)),
        ("knockouts", _wrong(knockouts, _bad_knockout)),
        ("weighted_total", _outside(F.col("_total"))),
        ("recommend", F.col("_recommend").isNull()),
        ("summary", F.col("_summary").isNull()),
    ]
    if criterion_ids is not None:
        checks.append(("criteria ids", _wrong_ids(criteria, criterion_ids)))
    if knockout_ids is not None:
        checks.append(("knockout ids", _wrong_ids(knockouts, knockout_ids)))
    score = F.struct(
        F.col("_id").alias("candidate_id"),
        criteria.alias("criteria"),
        knockouts.alias("knockouts"),
        F.col("_total").alias("weighted_total"),
        (F.col("_recommend") & ~any_failed(knockouts)).alias("recommend"),
        F.col("_summary").alias("summary"),
    )
    return _checked(staged, checks, score).drop(
        "_id", "_criteria", "_knockouts", "_total", "_recommend", "_summary", "_names"
    )


def validate_knockout(df: DataFrame, knockout_ids: Column | None = None) -> DataFrame:
    """``payload`` and ``candidate_id`` -> ``score`` or ``invalid``.

    ``passed`` is recomputed from the knockouts; no knockouts means passed.
    """
    payload = F.col("payload")
    staged = df.withColumns(
        {
            "_id": _reply_id(payload, F.col("candidate_id")),
            "_knockouts": _knockouts(payload),
            "_passed": V.boolean(V.field(payload, "$.passed")),
        }
    )
    knockouts = F.col("_knockouts")
    checks = [
        ("candidate_id", F.col("_id").isNull()),
        ("knockouts", _wrong(knockouts, _bad_knockout)),
        ("passed", F.col("_passed").isNull()),
    ]
    if knockout_ids is not None:
        checks.append(("knockout ids", _wrong_ids(knockouts, knockout_ids)))
    score = F.struct(
        F.col("_id").alias("candidate_id"),
        knockouts.alias("knockouts"),
        F.forall(knockouts, lambda k: k["passed"]).alias("passed"),
    )
    return _checked(staged, checks, score).drop("_id", "_knockouts", "_passed", "_names")
