"""Distributed scoring: bounded calls, attempt rounds, outcomes and their events."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from datetime import datetime, timezone
from time import sleep

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candrank import constants as C
from candrank.operators.replies import DIALECTS, parse_replies, resolve_attempts
from candrank.operators.requests import request_json, with_prefix
from candrank.operators.validate import any_failed, validate_full, validate_knockout
from candrank.plans.joins import fits
from candrank.schemas import ATTEMPT, KEY

MODES = ("single", "two-stage")

#: Bytes of requests that a task turns into Python texts, and asks, at a time.
PIECE_BYTES = 2 * 1024 * 1024

# request body (JSON text) -> raw answer text; raising counts as a failed attempt
Call = Callable[[str], str]


@dataclass(frozen=True)
class Scorer:
    """A named endpoint: its dialect, its model and the user's call."""

    dialect: str
    model: str
    call: Call
    thinking: bool = False

    def __post_init__(self):
        if self.dialect not in DIALECTS:
            raise ValueError(f"dialect must be one of {DIALECTS}")


class Scorers:
    """Scorers by name, and the choice of the full and the knockout one.

    A factory takes a model name (None for its default) and returns a Scorer.
    """

    def __init__(self):
        self._factories: dict[str, tuple[Callable[[str | None], Scorer], str | None]] = {}

    def register(self, name: str, factory, knockout_model: str | None = None) -> None:
        self._factories[name.lower()] = (factory, knockout_model)

    def make(self, name: str, model: str | None = None) -> Scorer:
        if name.lower() not in self._factories:
            raise ValueError(f"unknown scorer {name!r}; known: {sorted(self._factories)}")
        return self._factories[name.lower()][0](model)

    def choose(
        self,
        name: str,
        model: str | None = None,
        knockout_name: str | None = None,
        knockout_model: str | None = None,
    ) -> tuple[Scorer, Scorer]:
        """(full, knockout). The knockout pass uses the same scorer with its own model."""
        full = self.make(name, model)
        other = knockout_name or name
        if other.lower() not in self._factories:
            raise ValueError(f"unknown scorer {other!r}; known: {sorted(self._factories)}")
        return full, self.make(other, knockout_model or self._factories[other.lower()][1])


def tasks_for(concurrency: int, threads: int = 1, tasks: int | None = None) -> int:
    """Task count that keeps at most ``concurrency`` calls in flight over the cluster.

    Each task has ``threads`` calls in flight. ``tasks`` sets another count: more and
    shorter tasks lose less work with an executor, and 0 leaves the rows where they are,
    which saves moving their texts. The session's cores times ``threads`` are then the
    limit in flight.
    """
    if concurrency < 1 or threads < 1:
        raise ValueError("concurrency and threads must be at least 1")
    return tasks if tasks is not None else max(1, concurrency // threads)


def build_requests(
    blocks: DataFrame,
    prefixes: DataFrame,
    scorer: Scorer,
    full: bool,
    tasks: int = 0,
    system: str = C.SYSTEM_PROMPT,
    small: bool | None = None,
) -> DataFrame:
    """Blocks that have text -> (keys, request), spread over ``tasks`` (0: in place).

    The rows are spread before the prefix and the schema are added, so these do not
    travel. Prefixes too large to broadcast need a join of their own, and the rows are
    spread after it. ``small`` passes on an answer of ``fits`` for the prefixes.
    """
    ready = blocks.filter(F.col("block").isNotNull())
    small = fits(prefixes) if small is None else small
    if tasks and small:
        ready = ready.repartition(tasks, *KEY)
    body = request_json(scorer.dialect, scorer.model, full, system, scorer.thinking)
    requests = with_prefix(ready, prefixes, small).select(*KEY, body.alias("request"))
    return requests.repartition(tasks, *KEY) if tasks and not small else requests


def call_scorer(requests: DataFrame, call: Call, attempt: int, threads: int = 1) -> DataFrame:
    """One call per request, ``threads`` in flight per task.

    Of a batch a task holds the answers to two pieces of ``PIECE_BYTES`` at most, whatever the
    input's size. The result must be written before it is used: evaluating it again calls again.
    """

    def one(request: str):
        try:
            return call(request), None, datetime.now(timezone.utc)
        except Exception as e:
            return None, str(e) or type(e).__name__, datetime.now(timezone.utc)

    def answered(keys: pa.RecordBatch, futures: list) -> pa.RecordBatch:
        answers = [f.result() for f in futures]
        columns = [
            pa.array([attempt] * len(answers), pa.int32()),
            *[pa.array([a[i] for a in answers], pa.string(), from_pandas=True) for i in (0, 1)],
            pa.array([a[2] for a in answers], pa.timestamp("us", "UTC")),
        ]
        return pa.RecordBatch.from_arrays(
            [*keys.columns, *columns], names=[*KEY, "attempt", "raw", "error", "answered_at"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The next piece is asked while the last answers of one are awaited.
        asked: deque = deque()
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                for piece in _pieces(batch, threads):
                    futures = [pool.submit(one, r.as_py()) for r in piece.column("request")]
                    asked.append((piece.select(list(KEY)), futures))
                    del piece, futures
                    if len(asked) > 1:
                        yield answered(*asked.popleft())
            while asked:
                yield answered(*asked.popleft())

    return requests.select(*KEY, "request").mapInArrow(run, ATTEMPT)


def _pieces(batch: pa.RecordBatch, threads: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of about ``PIECE_BYTES`` of requests, a row for each thread at least."""
    sizes = pc.binary_length(batch.column("request")).fill_null(0).to_numpy(zero_copy_only=False)
    piece = np.cumsum(sizes, dtype=np.int64) // PIECE_BYTES
    start = 0
    while start < len(sizes):
        stop = max(int(np.searchsorted(piece, piece[start], "right")), start + threads)
        yield batch.slice(start, stop - start)
        start = stop


def parsed_attempts(attempts: DataFrame, dialect: str, tool: str) -> DataFrame:
    """Attempts with ``payload`` as JSON text and one ``error`` for call and parse faults.

    The raw answer stays beside them.
    """
    called = attempts.withColumnRenamed("error", "_call_error")
    parsed = parse_replies(called, dialect, tool)
    fault = F.coalesce("_call_error", "parse_error")
    return parsed.select(
        *KEY,
        "attempt",
        "raw",
        "answered_at",
        F.when(fault.isNull(), F.to_json("payload")).alias("payload"),
        F.when(fault.isNull() & F.col("payload").isNull(), F.lit("answer has no payload"))
        .otherwise(fault)
        .alias("error"),
    )


def run_attempts(
    build: Callable[[DataFrame | None], DataFrame],
    scorer: Scorer,
    full: bool,
    save: Callable[[DataFrame, int], DataFrame],
    threads: int = 1,
    delays: Sequence[float] = C.RETRY_DELAYS_SECONDS,
) -> DataFrame:
    """Attempt rounds until every request is answered or the delays run out.

    A round is one distributed job. ``build(None)`` gives the requests of the first, and
    ``build(keys)`` those of the keys still without a readable answer.
    ``save(attempts, round)`` writes a round's parsed answers before anything reads them,
    so a lost executor repeats calls of unfinished tasks only and no finished round. It
    may return answers an interrupted run already wrote.
    """
    tool = C.FULL_TOOL if full else C.KNOCKOUT_TOOL
    rounds, failed = [], None
    for number in range(1, len(delays) + 2):
        if number > 1:
            sleep(delays[number - 2])
        answers = call_scorer(build(failed), scorer.call, number, threads)
        rounds.append(save(parsed_attempts(answers, scorer.dialect, tool), number))
        failed = rounds[-1].filter(F.col("payload").isNull()).select(*KEY)
        if number > len(delays) or failed.isEmpty():
            break
    every = rounds[0]
    for more in rounds[1:]:
        every = every.unionByName(more)
    return every


_WAVE_BITS = 31


def waves_for(due: int, wave_rows: int) -> int:
    """How many waves of about ``wave_rows`` requests hold all that are due."""
    if wave_rows < 1:
        raise ValueError("wave_rows must be at least 1")
    return max(1, -(-due // wave_rows))


def with_waves(blocks: DataFrame, waves: int) -> DataFrame:
    """Add ``wave``, 0 to ``waves`` - 1: the key's place in as many equal ranges of its hash."""
    place = F.xxhash64(*KEY).bitwiseAND(F.lit((1 << _WAVE_BITS) - 1)) * F.lit(waves)
    return blocks.withColumn("wave", F.shiftright(place, _WAVE_BITS).cast("int"))


def run_waves(
    due: DataFrame,
    waves: int,
    request: Callable[[DataFrame], DataFrame],
    scorer: Scorer,
    full: bool,
    save: Callable[[DataFrame, int, int], DataFrame],
    threads: int = 1,
    delays: Sequence[float] = C.RETRY_DELAYS_SECONDS,
) -> DataFrame:
    """The attempt rounds of one wave after the other, retries within the wave.

    ``due``: blocks with ``wave``, laid out by it, so that a wave reads its own rows only.
    ``request`` turns blocks into requests. ``save(attempts, wave, round)`` commits a round of a
    wave; with what an earlier run committed it makes no call again.
    """
    every = None
    for wave in range(waves):
        own = due.filter(F.col("wave") == wave).drop("wave")

        def build(keys: DataFrame | None, own: DataFrame = own) -> DataFrame:
            return request(own if keys is None else own.join(keys, list(KEY), "left_semi"))

        def kept(answers: DataFrame, number: int, wave: int = wave) -> DataFrame:
            return save(answers, wave, number)

        part = run_attempts(build, scorer, full, kept, threads, delays)
        every = part if every is None else every.unionByName(part)
    return every


def wave_progress(due: DataFrame, attempts: DataFrame) -> DataFrame:
    """Per role and wave: requests due, and of them answered, failed so far, and not asked yet.

    ``due``: keys with ``wave``. ``attempts``: what has been committed of any wave.
    """
    tried = attempts.groupBy(*KEY).agg(F.max(F.col("payload").isNotNull()).alias("_answered"))
    both = due.select(*KEY, "wave").join(tried, list(KEY), "left")
    return both.groupBy("role", "wave").agg(
        F.count(F.lit(1)).alias("due"),
        F.count_if("_answered").alias("answered"),
        F.count_if(~F.col("_answered")).alias("failed"),
        F.count_if(F.col("_answered").isNull()).alias("waiting"),
    )


def resolve(attempts: DataFrame) -> DataFrame:
    """One row per key: payload (VARIANT) or error, and when it was last answered."""
    picked = resolve_attempts(attempts, list(KEY), {"answered_at": F.max("answered_at")})
    return picked.drop("attempts").withColumn("payload", F.try_parse_json("payload"))


def readiness(queued: DataFrame, texts: DataFrame) -> DataFrame:
    """Queued keys with ``ready``: there is a text. Only keys are read."""
    has = texts.select(*KEY, F.lit(True).alias("_has"))
    both = queued.select(*KEY).join(has, list(KEY), "left")
    return both.select(*KEY, F.col("_has").isNotNull().alias("ready"))


def outcomes(
    queued: DataFrame,
    resolved: DataFrame,
    full: bool,
    single: bool,
    prefixes: DataFrame | None = None,
) -> DataFrame:
    """Queued keys (with ``ready``) -> ``outcome``, ``error``, ``score``, ``answered_at``.

    skipped: no text. failed: no answer or an invalid one. knocked_out: a failed knockout,
    in the knockout pass or in single mode; the full pass of the two-stage mode ranks such
    a candidate, with the recommendation forced to false. ``prefixes`` switches on the
    strict check of rubric ids.
    """
    both = queued.select(*KEY, "ready").join(resolved, list(KEY), "left")
    criterion_ids = knockout_ids = None
    if prefixes is not None:
        both = with_prefix(both, prefixes.drop("prefix"))
        criterion_ids, knockout_ids = F.col("criterion_ids"), F.col("knockout_ids")
    checked = (
        validate_full(both, criterion_ids, knockout_ids)
        if full
        else validate_knockout(both, knockout_ids)
    )
    error = F.coalesce("error", "invalid")
    out = any_failed(F.col("score.knockouts"))
    outcome = F.when(~F.col("ready"), "skipped").when(error.isNotNull(), "failed")
    if single or not full:
        outcome = outcome.when(out, "knocked_out")
    return checked.select(
        *KEY,
        outcome.otherwise("passed").alias("outcome"),
        F.when(F.col("ready"), error).alias("error"),
        "score",
        "answered_at",
    )


def score_events(results: DataFrame, full: bool, single: bool, stamp_answers: bool = False) -> DataFrame:
    """State events of a stage; skipped candidates stay untouched."""
    passed = "single_scored" if single else "stage2_scored" if full else "stage1_passed"
    outcome = F.col("outcome")
    event = (
        F.when(outcome == "failed", "failed")
        .when(outcome == "knocked_out", "stage1_knocked_out")
        .otherwise(passed)
    )
    at = F.col("answered_at") if stamp_answers else F.lit(None).cast("timestamp")
    return results.filter(outcome != "skipped").select(
        *KEY,
        event.alias("event"),
        F.when(outcome == "failed", F.lit("failed_score")).alias("failure_status"),
        F.when(outcome == "failed", F.col("error")).alias("error"),
        at.alias("at"),
    )


def with_document(results: DataFrame, full: bool) -> DataFrame:
    """Results as they are stored: the score as a JSON document, NULL where there is none,
    and beside it the fields a ranking reads, so that it need not parse the document.
    """
    shown = {
        "reply_id": F.col("score.candidate_id"),
        "weighted_total": F.col("score.weighted_total") if full else F.lit(0.0),
        "recommend": F.col("score.recommend") if full else F.lit(False),
        "summary": F.col("score.summary") if full else F.lit(""),
    }
    return results.select(
        *KEY,
        F.lit("full" if full else "knockout").alias("stage"),
        "outcome",
        "error",
        "answered_at",
        F.to_json("score", {"ignoreNullFields": "false"}).alias("document"),
        *[value.alias(name) for name, value in shown.items()],
    )


def latest_documents(results: DataFrame) -> DataFrame:
    """The row whose document was written last per key; within one run the full pass comes last.

    ``results``: keys, stage, run (increasing) and the stored columns, one row per key, stage
    and run. The last run and stage are found from narrow columns: where there is an
    ``outcome``, it tells which rows have a document, and no document is read for it. Tables
    in the store's bucket layout stay in place.
    """
    if "outcome" in results.columns:
        has = F.col("outcome").isin("passed", "knocked_out")
    else:
        has = F.col("document").isNotNull()
    order = F.struct("run", F.when(F.col("stage") == "full", 1).otherwise(0).alias("full"))
    stored = results.filter(has)
    last = stored.groupBy(*KEY).agg(F.max(order).alias("_last"))
    kept = [c for c in results.columns if c not in (*KEY, "stage", "run")]
    # None is larger than the last, and an equality would become part of the join's key, by
    # which stored tables are not laid out.
    return stored.join(last, list(KEY)).filter(order >= F.col("_last")).select(*KEY, *kept)


def score_summary(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Counts per role. ``stages``: ('single' | 'knockout' | 'full', results) pairs.

    In single mode a pass counts for both stages, a knock-out for neither.
    """
    every = None
    for stage, results in stages:
        part = results.select("role", "outcome", F.lit(stage).alias("stage"))
        every = part if every is None else every.unionByName(part)
    passed, stage = F.col("outcome") == "passed", F.col("stage")
    return every.groupBy("role").agg(
        F.count_if(passed & stage.isin("single", "knockout")).alias("stage1_scored"),
        F.count_if(passed & stage.isin("single", "full")).alias("stage2_scored"),
        F.count_if(F.col("outcome") == "knocked_out").alias("knocked_out"),
        F.count_if(F.col("outcome") == "failed").alias("failed"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
    )
