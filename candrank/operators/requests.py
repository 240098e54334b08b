"""Scoring requests: candidate block, stable prefix per role and request layouts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank import constants as C
from candrank.functions.text import named, strip
from candrank.operators.rubric import answer_schema, rubric_block
from candrank.plans.joins import lookup_join
from candrank.schemas import KEY

LAYOUTS = ("tool_block", "chat_completion", "local_chat", "command")


def metadata_block(columns: Sequence[str], prefix: str = "") -> Column:
    """``key: value`` lines of the non-empty columns, in column order."""
    lines = []
    for name in columns:
        value = named(prefix + name)
        lines.append(F.when(value != "", F.concat(F.lit(f"{name}: "), value)))
    return F.concat_ws("\n", *lines) if lines else F.lit("")


def candidate_block(candidate_id: Column, metadata: Column, text: Column) -> Column:
    return F.concat(
        F.lit("CANDIDATE_ID: "),
        candidate_id,
        F.lit(f"\n{C.METADATA_HEADING}\n"),
        metadata,
        F.lit(f"\n{C.TEXT_HEADING}\n"),
        text,
        F.lit("\n"),
    )


def role_prefixes(rubrics: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row per role: prefix text, criterion ids and knockout ids."""
    rubric = rubric_block(F.col("title"), F.col("knockouts"), F.col("criteria"))
    prefix = F.concat(
        F.lit(f"{C.JOB_HEADING}\n"),
        strip(F.col("job_text")),
        F.lit(f"\n\n{C.RUBRIC_HEADING}\n"),
        rubric,
        F.lit("\n"),
    )
    return rubrics.join(jobs, "role").select(
        "role",
        prefix.alias("prefix"),
        F.transform("criteria", lambda c: c["id"]).alias("criterion_ids"),
        F.transform("knockouts", lambda k: k["id"]).alias("knockout_ids"),
    )


def candidate_blocks(
    queued: DataFrame, texts: DataFrame, metadata: DataFrame, metadata_columns: Sequence[str]
) -> DataFrame:
    """Queued keys with their request block; ``block`` is NULL where there is no text.

    Metadata is narrow and joined first. The text table is joined on the key both tables
    are bucketed by, and unlike the narrow side it is not moved again.
    """
    meta = metadata.select(*KEY, *[named(c).alias(f"_m_{c}") for c in metadata_columns])
    found = queued.select(*KEY).join(meta, list(KEY), "left")
    both = found.join(texts.select(*KEY, "text"), list(KEY), "left")
    block = candidate_block(
        F.col("candidate_id"), metadata_block(metadata_columns, "_m_"), F.col("text")
    )
    return both.select(*KEY, block.alias("block"))


def with_prefix(blocks: DataFrame, prefixes: DataFrame, small: bool | None = None) -> DataFrame:
    """Add the role's prefix and ids; see ``lookup_join`` for ``small``."""
    return lookup_join(blocks, prefixes, ["role"], "inner", small=small)


def request_json(
    layout: str,
    model: str,
    full: bool = True,
    system: str = C.SYSTEM_PROMPT,
    thinking: bool = False,
) -> Column:
    """Request body over ``prefix``, ``block``, ``criterion_ids`` and ``knockout_ids``.

    ``thinking`` leaves the switch-off flag out of the local layout.
    """
    prefix, block = F.col("prefix"), F.col("block")
    schema = answer_schema(F.col("criterion_ids"), F.col("knockout_ids"), full)
    tool = C.FULL_TOOL if full else C.KNOCKOUT_TOOL
    about = C.FULL_TOOL_DESCRIPTION if full else C.KNOCKOUT_TOOL_DESCRIPTION

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    def part(text: Column, *extra: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), text.alias("text"), *extra)

    if layout == "tool_block":
        cached = F.struct(F.lit("ephemeral").alias("type")).alias("cache_control")
        no_cache = F.lit(None).cast("struct<type:string>").alias("cache_control")
        body = F.struct(
            F.lit(model).alias("model"),
            F.lit(C.MAX_ANSWER_TOKENS).alias("max_tokens"),
            F.lit(system).alias("system"),
            F.array(
                F.struct(
                    F.lit(tool).alias("name"),
                    F.lit(about).alias("description"),
                    schema.alias("input_schema"),
                )
            ).alias("tools"),
            F.struct(F.lit("tool").alias("type"), F.lit(tool).alias("name")).alias("tool_choice"),
            F.array(
                message("user", F.array(part(prefix, cached), part(block, no_cache)))
            ).alias("messages"),
        )
    elif layout == "chat_completion":
        user = F.concat(prefix, F.lit("\n\n"), block)
        body = F.struct(
            F.lit(model).alias("model"),
            F.array(message("system", F.lit(system)), message("user", user)).alias("messages"),
            F.struct(
                F.lit("json_schema").alias("type"),
                F.struct(
                    F.lit(tool).alias("name"),
                    F.lit(about).alias("description"),
                    schema.alias("schema"),
                    F.lit(True).alias("strict"),
                ).alias("json_schema"),
            ).alias("response_format"),
            F.lit(C.MAX_ANSWER_TOKENS).alias("max_tokens"),
        )
    elif layout == "local_chat":
        user = F.concat(
            prefix,
            F.lit(f"\n\n{C.CANDIDATE_HEADING}\n"),
            block,
            F.lit(f"\n\n{C.TASK_HEADING}\n{C.LOCAL_TASK}"),
        )
        flag = [] if thinking else [F.lit(False).alias("think")]
        body = F.struct(
            F.lit(model).alias("model"),
            F.lit(False).alias("stream"),
            schema.alias("format"),
            F.array(message("system", F.lit(system)), message("user", user)).alias("messages"),
            F.struct(F.lit(C.LOCAL_TEMPERATURE).alias("temperature")).alias("options"),
            *flag,
        )
    elif layout == "command":
        prompt = F.concat(
            prefix,
            F.lit(f"\n\n{C.CANDIDATE_HEADING}\n"),
            block,
            F.lit(f"\n\n{C.COMMAND_TASK}"),
        )
        body = F.struct(
            F.lit(model).alias("model"),
            F.lit(system).alias("system_prompt"),
            schema.alias("json_schema"),
            prompt.alias("prompt"),
        )
    else:
        raise ValueError(f"layout must be one of {LAYOUTS}")
    return F.to_json(body)
