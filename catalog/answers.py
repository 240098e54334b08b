"""Answers of the four dialects, attempts and validation, built from whole documents."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalog.base import table
from candrank import constants as C
from candrank.functions import variant as V
from candrank.operators import replies, validate


def quoted(text: str | Column) -> Column:
    """A text as a JSON string: the only value of an array, without the brackets."""
    listed = F.to_json(F.array(text))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def documents(spark, sf) -> DataFrame:
    """Documents with a payload: total in tenths, one knockout, the text as summary."""
    docs = table(spark, sf, "documents").withColumn(
        "total", ((F.col("doc_id") * 37) % 101).cast("double") / 10
    )
    payload = F.to_json(
        F.struct(
            F.array(
                F.struct(
                    F.lit("a").alias("id"),
                    (F.col("doc_id") % 11).alias("score"),
                    F.col("lang").alias("reasoning"),
                )
            ).alias("criteria"),
            F.array(
                F.struct(
                    F.lit("k1").alias("id"),
                    (F.col("doc_id") % 4 != 0).alias("passed"),
                    F.col("source").alias("reasoning"),
                )
            ).alias("knockouts"),
            F.col("total").alias("weighted_total"),
            F.lit(True).alias("recommend"),
            F.col("text").alias("summary"),
        )
    )
    return docs.withColumn("payload_json", payload)


def _shown(parsed: DataFrame) -> DataFrame:
    """Total and summary of the payload, and the error up to its first colon."""
    return parsed.select(
        "doc_id",
        V.number(V.field(F.col("payload"), "$.weighted_total")).alias("total"),
        F.md5(V.text(V.field(F.col("payload"), "$.summary"))).alias("digest"),
        F.substring_index("parse_error", ":", 1).alias("problem"),
    )


def _tool_block_raw() -> Column:
    other = '{"type":"text","text":"thinking"}'
    call = F.concat(
        F.lit('{"type":"tool_use","name":"'),
        F.when(F.col("doc_id") % 7 == 1, "another_tool").otherwise(C.FULL_TOOL),
        F.lit('","input":'),
        F.col("payload_json"),
        F.lit("}"),
    )
    blocks = F.when(F.col("doc_id") % 7 == 2, F.lit(other)).otherwise(
        F.concat(F.lit(other + ","), call)
    )
    return F.when(F.col("doc_id") % 7 == 3, F.lit('{"content":')).otherwise(
        F.concat(F.lit('{"content":['), blocks, F.lit("]}"))
    )


def _chat_raw() -> Column:
    k = F.col("doc_id") % 8
    finish = F.when(k == 1, "length").otherwise("stop")
    refusal = F.when(k == 2, quoted("source")).otherwise("null")
    content = (
        F.when(k == 3, F.lit('""'))
        .when(k == 4, F.lit("null"))
        .when(k == 5, quoted("text"))
        .otherwise(quoted("payload_json"))
    )
    return F.when(k == 6, F.lit('{"choices":[]}')).otherwise(
        F.concat(
            F.lit('{"choices":[{"finish_reason":"'),
            finish,
            F.lit('","message":{"refusal":'),
            refusal,
            F.lit(',"content":'),
            content,
            F.lit("}}]}"),
        )
    )


def _local_raw() -> Column:
    k = F.col("doc_id") % 5
    content = (
        F.when(k == 1, F.lit('""')).when(k == 2, quoted("text")).otherwise(quoted("payload_json"))
    )
    return F.when(k == 3, F.lit('{"done":true}')).otherwise(
        F.concat(F.lit('{"message":{"content":'), content, F.lit("}}"))
    )


def _command_raw() -> Column:
    k = F.col("doc_id") % 10
    payload = F.col("payload_json")
    fenced = quoted(F.concat(F.lit("```json\n"), payload, F.lit("\n```")))

    def envelope(result: Column, subtype: str = "success", is_error: str = "false") -> Column:
        return F.concat(
            F.lit(f'{{"type":"result","subtype":"{subtype}","is_error":{is_error},"result":'),
            result,
            F.lit("}"),
        )

    bare = F.concat(F.lit('{"candidate_id":"c",'), F.substr(payload, F.lit(2)))
    return (
        F.when(k == 0, envelope(payload))
        .when(k == 1, envelope(quoted("payload_json")))
        .when(k == 2, envelope(fenced))
        .when(k == 3, bare)
        .when(k == 4, F.concat(F.lit("warning: slow\n"), envelope(payload), F.lit(" \n")))
        .when(k == 5, envelope(quoted("source"), is_error="true"))
        .when(k == 6, envelope(payload, subtype="error_max_turns"))
        .when(k == 7, F.col("text"))
        .when(k == 8, envelope(quoted("text")))
        .otherwise(envelope(F.lit("[1]")))
    )


_RAW = {
    "tool_block": _tool_block_raw,
    "chat_completion": _chat_raw,
    "local_chat": _local_raw,
    "command": _command_raw,
}


def parse(dialect, spark, sf):
    raw = documents(spark, sf).withColumn("raw", _RAW[dialect]())
    return _shown(replies.parse_replies(raw, dialect))


def _parse_sql(problem: str) -> str:
    return f"""WITH d AS (
      SELECT doc_id, cast((doc_id * 37) % 101 AS double) / 10 AS total, md5(text) AS digest,
             {problem} AS problem FROM documents)
    SELECT doc_id, CASE WHEN problem IS NULL THEN total END AS total,
           CASE WHEN problem IS NULL THEN digest END AS digest, problem FROM d"""


def command_error(spark, sf):
    """stderr is the text for a third of the rows, blank otherwise; stdout is an envelope."""
    k = F.col("doc_id") % 3
    stderr = F.when(k == 0, F.col("text")).otherwise(F.lit(" \n"))
    stdout = F.when(k == 1, F.concat(F.lit('{"result":'), quoted("text"), F.lit("}"))).otherwise(
        F.lit("")
    )
    found = replies.command_errors(table(spark, sf, "documents"), stdout, stderr)
    return found.select("doc_id", F.md5("message").alias("digest"))


def attempts_resolved(spark, sf):
    """Events as attempts: a user's day is a request, errors are failed attempts."""
    failed = F.col("event_type") == "error"
    attempts = table(spark, sf, "events").select(
        "user_id",
        F.date_format("ts", "yyyy-MM-dd").alias("day"),
        F.col("event_id").alias("attempt"),
        F.when(~failed, F.col("props")).alias("payload"),
        F.when(failed, F.concat(F.lit("problem "), "event_id")).alias("error"),
    )
    return replies.resolve_attempts(attempts, ["user_id", "day"])


# How an answer differs by doc_id % 12; the other fields are always valid.
def _answer(docs: DataFrame) -> DataFrame:
    k = F.col("doc_id") % 12
    total = F.col("total").cast("string")
    parts = [
        F.when(k == 0, F.lit(None))
        .when(k == 1, F.lit('"candidate_id":null'))
        .when(k == 2, F.lit('"candidate_id":5'))
        .otherwise(F.concat(F.lit('"candidate_id":"x'), "doc_id", F.lit('"'))),
        F.concat(
            F.lit('"criteria":[{"id":"a","reasoning":"","score":'),
            F.when(k == 5, F.lit("-0.1")).otherwise(F.lit('" 1e1 "')),
            F.lit("}]"),
        ),
        F.concat(
            F.lit('"knockouts":'),
            F.when(k == 9, F.lit("[]")).otherwise(
                F.concat(
                    F.lit('[{"id":"k","reasoning":"","passed":'),
                    F.when(k == 6, F.lit('"no"')).when(k == 7, F.lit("2")).otherwise(F.lit("1")),
                    F.lit("}]"),
                )
            ),
        ),
        F.concat(
            F.lit('"weighted_total":'),
            F.when(k == 3, F.concat(F.lit('"'), total, F.lit('"')))
            .when(k == 4, F.lit("10.01"))
            .otherwise(total),
        ),
        F.when(k != 8, F.lit('"recommend":"YES"')),
        F.concat(F.lit('"summary":'), F.when(k == 10, F.lit("7")).otherwise(quoted("text"))),
        F.lit('"passed":true'),
    ]
    body = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return docs.select(
        F.lit("r").alias("role"),
        F.concat(F.lit("c"), "doc_id").alias("candidate_id"),
        F.try_parse_json(F.when(F.col("doc_id") % 50 == 49, F.lit("[1]")).otherwise(body)).alias("payload"),
    )


def validate_full(spark, sf):
    return validate.validate_full(_answer(documents(spark, sf))).select(
        "candidate_id",
        "invalid",
        F.col("score.candidate_id").alias("reply_id"),
        F.col("score.weighted_total").alias("weighted_total"),
        F.col("score.criteria")[0]["score"].alias("first_score"),
        F.col("score.recommend").cast("string").alias("recommend"),
        F.md5("score.summary").alias("digest"),
    )


def validate_strict(spark, sf):
    """With rubric ids: the only criterion is a, and there must be one knockout."""
    ids = F.array(F.lit("a"))
    checked = validate.validate_full(_answer(documents(spark, sf)), ids, F.array(F.lit("k")))
    return checked.select("candidate_id", "invalid")


def validate_knockout(spark, sf):
    return validate.validate_knockout(_answer(documents(spark, sf))).select(
        "candidate_id",
        "invalid",
        F.col("score.candidate_id").alias("reply_id"),
        F.col("score.passed").cast("string").alias("passed"),
    )


_INVALID = """
CASE WHEN doc_id % 50 = 49 THEN 'answer is not an object'
     WHEN k IN (1, 2) THEN 'invalid: candidate_id'
     {criteria}
     WHEN k = 7 THEN 'invalid: knockouts'
     {rest} END"""
_FULL = _INVALID.format(
    criteria="WHEN k = 5 THEN 'invalid: criteria'",
    rest="WHEN k = 4 THEN 'invalid: weighted_total' WHEN k = 8 THEN 'invalid: recommend' WHEN k = 10 THEN 'invalid: summary' {more}",
)
_DOCS = """SELECT *, doc_id % 12 AS k, cast((doc_id * 37) % 101 AS double) / 10 AS total,
  CASE WHEN doc_id % 12 = 0 THEN 'c' || doc_id ELSE 'x' || doc_id END AS reply FROM documents"""

QUERIES = {
    "parse_tool_block": (
        partial(parse, "tool_block"),
        _parse_sql(
            f"""CASE WHEN doc_id % 7 IN (1, 2) THEN 'no tool_use block named {C.FULL_TOOL}; got types'
                WHEN doc_id % 7 = 3 THEN 'answer is not JSON' END"""
        ),
    ),
    "parse_chat": (
        partial(parse, "chat_completion"),
        _parse_sql("""CASE doc_id % 8 WHEN 1 THEN 'answer cut by the token limit' WHEN 2 THEN 'refused'
            WHEN 3 THEN 'empty content without a refusal' WHEN 4 THEN 'empty content without a refusal'
            WHEN 5 THEN 'content is not JSON' WHEN 6 THEN 'answer has no choice' END"""),
    ),
    "parse_local": (
        partial(parse, "local_chat"),
        _parse_sql("""CASE doc_id % 5 WHEN 1 THEN 'empty content' WHEN 2 THEN 'content is not JSON'
            WHEN 3 THEN 'empty content' END"""),
    ),
    "parse_envelope": (
        partial(parse, "command"),
        _parse_sql("""CASE doc_id % 10 WHEN 5 THEN 'command reported' WHEN 6 THEN 'command did not succeed'
            WHEN 7 THEN 'answer is not JSON' WHEN 8 THEN 'content is not JSON'
            WHEN 9 THEN 'result has an unexpected type' END"""),
    ),
    "command_error": (
        command_error,
        """SELECT doc_id, md5(CASE doc_id % 3 WHEN 0 THEN right(trim(text, chr(9) || chr(10) || ' '), 1000)
             WHEN 1 THEN text ELSE '(no output on stdout or stderr)' END) AS digest FROM documents""",
    ),
    "attempts_resolved": (
        attempts_resolved,
        """WITH a AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, event_type <> 'error' AS ok, props FROM events),
        g AS (SELECT user_id, day, arg_min(props, event_id) FILTER (ok) AS payload, bool_or(ok) AS won,
                     count(*) AS attempts, max(event_id) AS last FROM a GROUP BY ALL)
        SELECT user_id, day, payload,
               CASE WHEN NOT won THEN 'failed after ' || attempts || ' attempts: problem ' || last END AS error,
               attempts FROM g""",
    ),
    "validate_full": (
        validate_full,
        f"""WITH d AS ({_DOCS}), e AS (SELECT *, {_FULL.format(more='')} AS invalid FROM d)
        SELECT 'c' || doc_id AS candidate_id, invalid,
               CASE WHEN invalid IS NULL THEN reply END AS reply_id,
               CASE WHEN invalid IS NULL THEN total END AS weighted_total,
               CASE WHEN invalid IS NULL THEN cast(10 AS double) END AS first_score,
               CASE WHEN invalid IS NULL THEN cast(k <> 6 AS varchar) END AS recommend,
               CASE WHEN invalid IS NULL THEN md5(text) END AS digest FROM e""",
    ),
    "validate_strict": (
        validate_strict,
        f"""WITH d AS ({_DOCS})
        SELECT 'c' || doc_id AS candidate_id,
               {_FULL.format(more="WHEN k = 9 THEN 'invalid: knockout ids'")} AS invalid FROM d""",
    ),
    "validate_knockout": (
        validate_knockout,
        f"""WITH d AS ({_DOCS}), e AS (SELECT *, {_INVALID.format(criteria='', rest='')} AS invalid FROM d)
        SELECT 'c' || doc_id AS candidate_id, invalid,
               CASE WHEN invalid IS NULL THEN reply END AS reply_id,
               CASE WHEN invalid IS NULL THEN cast(k <> 6 AS varchar) END AS passed FROM e""",
    ),
}
