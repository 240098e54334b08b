"""Rubric checks, its text block, and the answer schema it implies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank import constants as C
from candrank.functions.text import fixed

#: Items of which a task checks the rubrics.
TASK_ITEMS = 500_000


def rubric_items(rubrics: DataFrame) -> DataFrame:
    """Rubric rows -> (role, kind, item_id, weight), one row per knockout or criterion."""
    knockouts = rubrics.select("role", F.explode("knockouts").alias("i")).select(
        "role",
        F.lit("knockout").alias("kind"),
        F.col("i.id").alias("item_id"),
        F.lit(None).cast("double").alias("weight"),
    )
    criteria = rubrics.select("role", F.explode("criteria").alias("i")).select(
        "role", F.lit("criterion").alias("kind"), F.col("i.id").alias("item_id"), "i.weight"
    )
    return knockouts.unionByName(criteria)


def violations(items: DataFrame, rubrics: DataFrame | None = None) -> DataFrame:
    """(role, problem, detail) rows; a valid rubric gives none.

    Weights are summed as decimals, so the sum does not depend on row order. ``rubrics``
    lets a rubric without any criterion show up as a weight sum of zero.

    The items are counted and dealt to tasks of about ``TASK_ITEMS``: partitions made by their
    compressed bytes hold very many such narrow rows, and the groups of a task take its memory.
    """
    weight = F.col("weight")
    criterion = F.col("kind") == "criterion"
    tasks = -(-items.count() // TASK_ITEMS)

    def dealt(rows: DataFrame, *by: str) -> DataFrame:
        return rows.repartition(tasks, *by) if tasks > 1 else rows

    per_id = dealt(items, "role", "kind", "item_id").groupBy("role", "kind", "item_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(criterion, weight.cast("decimal(18,9)"))).alias("w"),
        F.count_if(criterion & ~F.coalesce((weight > 0) & (weight <= 1), F.lit(False))).alias("out"),
    )
    per_role = dealt(per_id, "role").groupBy("role").agg(
        F.coalesce(F.sum("w"), F.lit(0).cast("decimal(18,9)")).alias("total"),
        F.sum("out").alias("out"),
        *[
            F.count_if((F.col("kind") == k) & (F.col("n") > 1)).alias(k)
            for k in ("criterion", "knockout")
        ],
    )
    if rubrics is not None:
        per_role = rubrics.select("role").join(per_role, "role", "left").na.fill(
            0, ["out", "criterion", "knockout"]
        ).withColumn("total", F.coalesce("total", F.lit(0).cast("decimal(18,9)")))
    off = F.abs(F.col("total") - F.lit(1).cast("decimal(18,9)")) > F.lit(str(C.WEIGHT_TOLERANCE)).cast("decimal(18,9)")
    found = F.array_compact(
        F.array(
            F.when(off, F.struct(F.lit("weight_sum").alias("p"), fixed(F.col("total").cast("double"), 3).alias("d"))),
            *[
                F.when(F.col(c) > 0, F.struct(F.lit(p).alias("p"), F.col(c).cast("string").alias("d")))
                for p, c in (
                    ("weight_out_of_range", "out"),
                    ("criterion_id_repeated", "criterion"),
                    ("knockout_id_repeated", "knockout"),
                )
            ],
        )
    )
    return per_role.select("role", F.explode(found).alias("v")).select(
        "role", F.col("v.p").alias("problem"), F.col("v.d").alias("detail")
    )


def check(rubrics: DataFrame) -> None:
    """Raise on invalid rubrics, with their number and examples; ``violations`` has them all."""
    found = violations(rubric_items(rubrics), rubrics)
    n = found.count()
    if n:
        shown = "; ".join(f"{b.role}: {b.problem} ({b.detail})" for b in found.limit(20).collect())
        raise ValueError(f"{n} rubric violations" + (", for example: " if n > 20 else ": ") + shown)


def rubric_block(title: Column, knockouts: Column, criteria: Column) -> Column:
    """The rubric as text for a scoring request."""
    lines = F.flatten(
        F.array(
            F.array(
                F.concat(F.lit("ROLE: "), title), F.lit(""), F.lit(C.KNOCKOUTS_HEADING)
            ),
            F.transform(
                knockouts,
                lambda k: F.concat(F.lit("  - "), k["id"], F.lit(": "), k["description"]),
            ),
            F.array(F.lit(""), F.lit(C.CRITERIA_HEADING)),
            F.transform(
                criteria,
                lambda c: F.concat(
                    F.lit("  - "),
                    c["id"],
                    F.lit(" (weight "),
                    fixed(c["weight"], 2),
                    F.lit("): "),
                    c["description"],
                ),
            ),
        )
    )
    return F.array_join(lines, "\n")


def _object(properties: list[tuple[str, Column]], required: list[str]) -> Column:
    return F.struct(
        F.lit("object").alias("type"),
        F.struct(*[c.alias(n) for n, c in properties]).alias("properties"),
        F.array(*[F.lit(r) for r in required]).alias("required"),
    )


def _type(name: str, **bounds: int) -> Column:
    return F.struct(F.lit(name).alias("type"), *[F.lit(v).alias(k) for k, v in bounds.items()])


def _array_of(item: Column, ids: Column) -> Column:
    return F.struct(
        F.lit("array").alias("type"),
        item.alias("items"),
        F.size(ids).alias("minItems"),
        F.size(ids).alias("maxItems"),
    )


def _id(ids: Column) -> Column:
    return F.struct(F.lit("string").alias("type"), ids.alias("enum"))


def answer_schema(criterion_ids: Column, knockout_ids: Column, full: bool = True) -> Column:
    """JSON schema of an answer as a struct: ``to_json`` it, or embed it in a request."""
    knockout = _object(
        [("id", _id(knockout_ids)), ("passed", _type("boolean")), ("reasoning", _type("string"))],
        ["id", "passed", "reasoning"],
    )
    knockouts = _array_of(knockout, knockout_ids)
    if not full:
        return _object(
            [
                ("candidate_id", _type("string")),
                ("knockouts", knockouts),
                ("passed", _type("boolean")),
            ],
            ["candidate_id", "knockouts", "passed"],
        )
    criterion = _object(
        [
            ("id", _id(criterion_ids)),
            ("score", _type("number", minimum=0, maximum=10)),
            ("reasoning", _type("string")),
        ],
        ["id", "score", "reasoning"],
    )
    return _object(
        [
            ("candidate_id", _type("string")),
            ("criteria", _array_of(criterion, criterion_ids)),
            ("knockouts", knockouts),
            ("weighted_total", _type("number", minimum=0, maximum=10)),
            ("recommend", _type("boolean")),
            ("summary", _type("string")),
        ],
        ["candidate_id", "criteria", "knockouts", "weighted_total", "recommend", "summary"],
    )
