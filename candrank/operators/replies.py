"""Raw answers of four dialects -> payload (VARIANT) or error text, without Python calls.

Work is laid out in stages of columns, so that each JSON text is parsed once: the answer
itself, then the text inside it that holds the payload in three of the dialects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank import constants as C
from candrank.functions import variant as V
from candrank.functions.text import strip, strip_fences, tail

DIALECTS = ("tool_block", "chat_completion", "local_chat", "command")


def _null(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _tool_block(body: Column, tool: str) -> tuple[Column, Column, Column]:
    """The input of the first content block that is a call of ``tool``."""
    blocks = V.items(body, "$.content")

    def kind_of(block: Column) -> Column:
        return F.coalesce(V.text(V.field(block, "$.type")), F.lit("?"))

    def named(block: Column) -> Column:
        return F.coalesce(V.text(V.field(block, "$.name")) == tool, F.lit(False))

    wanted = F.filter(blocks, lambda b: (kind_of(b) == "tool_use") & named(b))
    types = F.array_join(F.transform(blocks, kind_of), ", ")
    early = F.when(blocks.isNull(), F.lit("answer has no content blocks")).when(
        F.size(wanted) == 0,
        F.concat(F.lit(f"no tool_use block named {tool}; got types: "), types),
    )
    return early, _null("string"), V.field(F.get(wanted, F.lit(0)), "$.input")


def _content(content: Column, empty: str) -> Column:
    return F.when(~V.truthy(content), F.lit(empty)).when(
        V.text(content).isNull(), F.lit("content is not text")
    )


def _chat_completion(body: Column, tool: str) -> tuple[Column, Column, Column]:
    """First choice; a cut answer, a refusal and empty content are errors, in this order."""
    choice = V.field(body, "$.choices[0]")
    refusal = V.field(body, "$.choices[0].message.refusal")
    content = V.field(body, "$.choices[0].message.content")
    finish = V.text(V.field(body, "$.choices[0].finish_reason"))
    early = F.coalesce(
        F.when(choice.isNull(), F.lit("answer has no choice"))
        .when(finish == "length", F.lit("answer cut by the token limit"))
        .when(V.truthy(refusal), F.concat(F.lit("refused: "), V.as_message(refusal))),
        _content(content, "empty content without a refusal"),
    )
    return early, V.text(content), _null("variant")


def _local_chat(body: Column, tool: str) -> tuple[Column, Column, Column]:
    content = V.field(body, "$.message.content")
    return _content(content, "empty content"), V.text(content), _null("variant")


def _command(body: Column, tool: str) -> tuple[Column, Column, Column]:
    """Result envelope: the error flag counts before the subtype; a bare payload passes."""
    result, fault = V.field(body, "$.result"), V.field(body, "$.error")
    missing = result.isNull() | F.is_variant_null(result)
    bare = missing & ~V.absent(V.field(body, "$.candidate_id"))
    success = F.coalesce(V.text(V.field(body, "$.subtype")) == "success", F.lit(False))
    is_result = F.coalesce(V.text(V.field(body, "$.type")) == "result", F.lit(False))
    reason = (
        F.when(V.truthy(result), V.as_message(result))
        .when(V.truthy(fault), V.as_message(fault))
        .otherwise(F.to_json(body))
    )
    flagged = V.truthy(V.field(body, "$.is_error"))
    early = (
        F.when(flagged, F.concat(F.lit("command reported: "), reason))
        .when(is_result & ~success, F.concat(F.lit("command did not succeed: "), F.to_json(body)))
        .when(missing & ~bare, F.concat(F.lit("envelope has no result: "), F.to_json(body)))
        .when(
            ~missing & ~V.is_text(result) & ~V.is_object(result),
            F.concat(F.lit("result has an unexpected type: "), V.kind(result)),
        )
    )
    text = F.when(~missing, strip_fences(V.text(result)))
    return early, text, F.when(bare, body).when(V.is_object(result), result)


_PARSERS = {
    "tool_block": _tool_block,
    "chat_completion": _chat_completion,
    "local_chat": _local_chat,
    "command": _command,
}


def _with_body(df: DataFrame, dialect: str) -> DataFrame:
    if dialect != "command":
        return V.with_json(df, "_body", F.col("_raw"))
    # Some tools print text before the envelope: read from the first brace to the end.
    raw = F.col("_raw")
    start = F.greatest(F.instr(raw, "{"), F.lit(1))
    rest = F.when(F.endswith(raw, F.lit("}")), F.substr(raw, start))
    whole = V.with_json(df, "_whole", raw)
    # Only an answer that is not JSON as a whole is cut and parsed again.
    both = V.with_json(whole, "_rest", F.when(F.col("_whole").isNull(), rest))
    return both.withColumn("_body", F.coalesce("_whole", "_rest")).drop("_whole", "_rest")


def parse_replies(df: DataFrame, dialect: str, tool: str = C.FULL_TOOL, raw: str = "raw") -> DataFrame:
    """Add ``payload`` (VARIANT) and ``parse_error``; exactly one is set for a JSON object.

    A payload that is JSON but not an object is left to validation, which rejects it.
    """
    if dialect not in _PARSERS:
        raise ValueError(f"dialect must be one of {DIALECTS}")
    text = strip(F.col(raw)) if dialect == "command" else F.col(raw)
    staged = _with_body(df.withColumn("_raw", text), dialect)
    early, content, direct = _PARSERS[dialect](F.col("_body"), tool)
    unreadable = F.concat(F.lit("answer is not JSON: "), tail(F.col("_raw"), C.PAYLOAD_TAIL_CHARS))
    staged = staged.withColumns(
        {
            "_early": F.when(F.col("_body").isNull(), F.coalesce(unreadable, F.lit("no answer"))).otherwise(early),
            "_content": content,
            "_direct": direct,
        }
    )
    staged = V.with_json(staged, "_inner", F.col("_content"))
    inside = F.concat(F.lit("content is not JSON: "), tail(F.col("_content"), C.PAYLOAD_TAIL_CHARS))
    error = F.coalesce(
        F.col("_early"), F.when(F.col("_content").isNotNull() & F.col("_inner").isNull(), inside)
    )
    payload = F.when(error.isNull(), F.coalesce("_inner", "_direct"))
    done = V.settled(staged, payload=payload, parse_error=error)
    return done.drop("_raw", "_body", "_early", "_content", "_direct", "_inner")


def command_errors(df: DataFrame, stdout: Column, stderr: Column) -> DataFrame:
    """Add ``message``, the reason of a failed command.

    It is the first text that is not empty, or the result or error field in it.
    """
    chunk = F.coalesce(F.nullif(strip(stderr), F.lit("")), F.nullif(strip(stdout), F.lit("")))
    staged = V.with_json(df.withColumn("_chunk", chunk), "_env", F.col("_chunk"))
    body = F.col("_env")
    result, fault = V.field(body, "$.result"), V.field(body, "$.error")
    cut = tail(F.col("_chunk"), C.MESSAGE_TAIL_CHARS)
    message = (
        F.when(F.col("_chunk").isNull(), F.lit("(no output on stdout or stderr)"))
        .when(~V.is_object(body), cut)
        .when(V.truthy(result), V.as_message(result))
        .when(V.truthy(fault), V.as_message(fault))
        .otherwise(tail(F.to_json(body), C.MESSAGE_TAIL_CHARS))
    )
    return staged.withColumn("message", message).drop("_chunk", "_env")


def resolve_attempts(
    attempts: DataFrame, keys: list[str], also: dict[str, Column] | None = None
) -> DataFrame:
    """First successful attempt per key, else the error of the last one.

    ``attempts``: keys, attempt, payload (text, NULL on failure), error. Both picks come
    from one partial aggregate, so a key with very many attempts sends one row per task.
    ``also`` names further aggregates of the same pass.
    """
    also = also or {}
    won = F.col("payload").isNotNull()
    return (
        attempts.groupBy(*keys)
        .agg(
            F.min_by(F.struct("payload", "attempt"), F.when(won, F.col("attempt"))).alias("_won"),
            F.max_by("error", "attempt").alias("_last"),
            F.count(F.lit(1)).alias("attempts"),
            *[agg.alias(name) for name, agg in also.items()],
        )
        .select(
            *keys,
            F.col("_won.payload").alias("payload"),
            F.when(
                F.col("_won").isNull(),
                F.format_string("failed after %d attempts: %s", "attempts", "_last"),
            ).alias("error"),
            "attempts",
            *also,
        )
    )
