"""Ranked files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candrank import constants as C
from candrank.operators.ranking import formatted


def write_ranked(ranked: DataFrame, path: str, one_file: bool = False, roles: DataFrame | None = None) -> None:
    """CSV parts per role, in rank order, with the fixed header.

    ``one_file`` is for a top-N: each role, N rows at most, becomes one file. Of ``roles`` those
    without a ranked row get a file of the header alone.
    """
    rows = formatted(ranked)
    order = [F.col("role"), F.col("rank").cast("long")]
    rows = (
        rows.repartition("role").sortWithinPartitions(*order)
        if one_file
        else rows.orderBy(*order)
    )
    (
        rows.write.partitionBy("role")
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    if roles is not None:
        bare = roles.select("role").distinct().join(ranked.select("role").distinct(), "role", "left_anti")
        header = bare.select("role", F.lit(",".join(C.RANKED_COLUMNS)).alias("value"))
        header.write.mode("append").partitionBy("role").text(path)
