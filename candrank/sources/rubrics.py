"""Rubric and job description: small per-role configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candrank.functions.text import strip
from candrank.schemas import RUBRIC


def read_rubric(spark: SparkSession, path: str, role: str | None = None) -> DataFrame:
    """One row from a YAML rubric. ``role`` keys it; by default the rubric's own role does."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()[0]
    return rubric_row(spark, yaml.safe_load(text), role)


def rubric_row(spark: SparkSession, rubric: dict, role: str | None = None) -> DataFrame:
    row = (
        role or rubric["role"],
        rubric["role"],
        int(rubric.get("version", 1)),
        [(k["id"], k["description"]) for k in rubric["knockouts"]],
        [(c["id"], float(c["weight"]), c["description"]) for c in rubric["criteria"]],
    )
    return spark.createDataFrame([row], RUBRIC)


def read_job_description(spark: SparkSession, path: str, role: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.lit(role).alias("role"), strip(F.col("value")).alias("job_text"))
