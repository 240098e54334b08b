"""The stages over a store, one by one or end to end.

Every stage reads the current tables, works on its queue only, writes what it produced and
then the new state. What a stage produced is written before the state that depends on it,
under the number of the state it started from and, for scoring, a fingerprint of the rubrics,
job texts, model and settings, so a stage that was interrupted continues
from its saved answers, and a finished one is never mistaken for the next.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candrank import constants as C
from candrank.operators import audit, extract, ingest, ranking, rubric, scoring, state
from candrank.operators.requests import candidate_blocks, role_prefixes
from candrank.plans.joins import fits
from candrank.plans.scratch import written
from candrank.schemas import KEY
from candrank.sources.candidates import IngestError, unknown_columns
from candrank.sources.documents import criteria_view
from candrank.sources.files import write_files
from candrank.sources.rankings import write_ranked
from candrank.sources.resumes import ResumeScan, ranked_bundle
from candrank.sources.store import Store



def current_state(store: Store, seq_type=None) -> DataFrame:
    """The last version of the state with the arrivals that were added to it since."""
    if store.exists("state"):
        stored, added = store.read("state"), _arrivals(store)
        return state.upsert_arrivals(stored, store.read(added)) if store.exists(added) else stored
    if seq_type is None:
        raise FileNotFoundError("nothing has been ingested yet")
    return state.empty_state(store.spark, seq_type)


def _arrivals(store: Store) -> str:
    """The table of what arrived since the state was last written."""
    return f"arrivals/{_label(store)}"


def settle(store: Store) -> None:
    """Write the state with its arrivals, if there are any, as its next version."""
    if store.exists("state") and store.exists(_arrivals(store)):
        store.write("state", current_state(store))


def stored_metadata(store: Store) -> DataFrame:
    """The last row per untrimmed id, of the stored rows and those added since."""
    rows = store.read("metadata")
    return ingest.metadata_keep_last(rows) if store.appended("metadata") else rows


def _metadata(store: Store, strict: bool) -> tuple[DataFrame, list[str]]:
    """The lookup of input columns: last row per untrimmed id, or the state's own rows."""
    lookup = ingest.metadata_keep_first(store.read("candidates")) if strict else stored_metadata(store)
    return lookup, [c for c in lookup.columns if c not in ("role", "ingest_seq")]


def _without_roles(df: DataFrame, roles: DataFrame) -> DataFrame:
    """Rows of other roles; a role list of measured size is broadcast."""
    listed = F.broadcast(roles) if fits(roles) else roles
    return df.join(listed, "role", "left_anti")


def _keep_resumes(store: Store, resumes: DataFrame) -> None:
    """Keep the arriving contents, which replace those stored under the same keys.

    Of several contents of a key the largest in byte order is kept.
    """
    files = resumes.select(*KEY, "content")
    if store.buckets:
        files = files.repartition(store.buckets, *KEY)
    files = files.groupBy(*KEY).agg(F.max("content").alias("content"))
    aligned = bool(store.buckets)
    if not store.exists("resumes"):
        store.write("resumes", files, aligned)
        return
    keys = resumes.select(*KEY)
    stored = store.read("resumes")
    if stored.select(*KEY).join(keys, list(KEY), "left_semi").isEmpty():
        store.append("resumes", files, aligned)
    else:
        others = stored.join(keys, list(KEY), "left_anti")
        store.write("resumes", others.unionByName(files), aligned)


def run_ingest(
    store: Store,
    raw: DataFrame,
    resumes: DataFrame,
    as_of,
    sticky_no_resume: bool = True,
    accumulate: bool = False,
    batch: str | None = None,
) -> DataFrame:
    """Keep the raw rows, upsert the state, return the summary per role.

    ``resumes`` holds a key per resume file; a candidate without one now has no resume,
    whatever an earlier ingest found. With a ``content`` column the contents are kept too,
    for parsing, the newest per key. The raw rows replace the kept ones of the same roles,
    or with ``accumulate`` join them, as files arriving one by one need; rows of a named
    ``batch`` join once. Then metadata and state are added to as well, so that what an ingest
    writes follows its own rows; a read puts them together, and the next stage settles the
    state. Rows without a role stop the ingest.
    """
    if "candidate_id" not in raw.columns:
        raise IngestError(f"required column candidate_id is missing; found {raw.columns}")
    ours = store.write("input", raw)
    if not ours.filter(F.coalesce(F.btrim("role"), F.lit("")) == "").isEmpty():
        raise IngestError("every candidate row needs a role")
    last = ingest.metadata_keep_last(ours)
    if accumulate or not store.exists("candidates"):
        store.append("candidates", ours, part=batch)
        # Later rows win, so the old lookup and the new rows are the new lookup.
        store.append("metadata", last, part=batch)
    else:
        roles = ours.select("role").distinct()
        kept = _without_roles(store.read("candidates"), roles)
        store.write("candidates", kept.unionByName(ours, True))
        store.write("metadata", _without_roles(stored_metadata(store), roles).unionByName(last, True))
    if "content" in resumes.columns:
        # A file known already, as a scan of changes finds it, comes without its content.
        _keep_resumes(store, resumes.filter(F.col("content").isNotNull()))
    found = ingest.resume_presence(
        ingest.keep_first(ingest.normalise(ours)), resumes.select(*KEY).distinct()
    )
    arrived = store.write("arrived", found)
    if accumulate and store.exists("state"):
        number = store.versions("input")[-1]
        store.append(_arrivals(store), state.arrivals(arrived, as_of, number, sticky_no_resume), part=batch)
    else:
        before = current_state(store, raw.schema["ingest_seq"].dataType)
        store.write("state", state.upsert(before, arrived, as_of, sticky_no_resume))
    return ingest.ingest_summary(arrived).withColumn(
        "unknown_columns", F.lit(", ".join(unknown_columns(raw.columns)))
    )


def run_ingest_folder(store: Store, raw: DataFrame, path: str, role: str, as_of, **more) -> DataFrame:
    """:func:`run_ingest` of a role with its resume folder, of which only changed files are read."""
    scan = ResumeScan(store, path, role)
    summary = run_ingest(store, raw, scan.resumes, as_of, **more)
    scan.done()
    return summary


def run_parse(
    store: Store,
    as_of,
    readers: Sequence[tuple[str, extract.PageReader]] | None = None,
    readings: DataFrame | None = None,
    retry_failed: bool = False,
) -> DataFrame:
    """Read queued resumes, keep useful texts, update the state, return the summary.

    With ``retry_failed`` the failures of any stage are put back first, so that resumes that
    could not be read are read again.

    Either ``readers`` decode the stored contents, or ``readings`` (role, candidate_id,
    text, extractor, error) come from a decoder outside; of several readings of a key the
    largest is taken, a text before none.
    """
    settle(store)
    if retry_failed:
        _put_back(store, as_of)
    before, label = current_state(store), _label(store)
    queued = state.queue(before, "parse")
    if readings is None:
        results = extract.parse_files(
            queued, store.read("resumes"), list(readers or extract.PDF_READERS)
        )
    else:
        one = readings.groupBy(*KEY).agg(F.max(F.struct("text", "extractor", "error")).alias("_one"))
        results = extract.parse_results(queued, one.select(*KEY, "_one.*"))
    results = store.append_run("texts", extract.with_length(results), label, aligned=readings is None)
    after = state.apply_events(before, extract.parse_events(results), as_of)
    store.write("state", after, aligned=True)
    return extract.parse_summary(results)


def _put_back(store: Store, as_of) -> None:
    """Failures become discovered again, where there are any."""
    before = current_state(store)
    if state.retry_count(before):
        store.write("state", state.retry_reset(before, as_of), aligned=True)


def _label(store: Store) -> str:
    return f"s{store.versions('state')[-1]:08d}"


def _fingerprint(prefixes: DataFrame, *settings) -> str:
    """Tells runs apart whose rubrics, job texts or settings differ."""
    row = F.to_json(F.struct("*"))
    seen = prefixes.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(row)), F.sum(F.crc32(row))).first()
    return hashlib.sha256(json.dumps([*seen, *settings]).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class ScoreSettings:
    """``wave_rows``: a stage asks in waves of about so many requests, each committed by itself."""

    mode: str = "single"
    concurrency: int = C.DEFAULT_CONCURRENCY
    threads: int = 1
    tasks: int | None = None
    delays: Sequence[float] = C.RETRY_DELAYS_SECONDS
    retry_failed: bool = False
    strict_ids: bool = False
    strict_metadata: bool = False
    stamp_answers: bool = False
    wave_rows: int | None = None

    def __post_init__(self):
        if self.mode not in scoring.MODES:
            raise ValueError(f"mode must be one of {scoring.MODES}")
        if self.wave_rows is not None and self.wave_rows < 1:
            raise ValueError("wave_rows must be at least 1")


def run_score(
    store: Store,
    rubrics: DataFrame,
    jobs: DataFrame,
    scorer: scoring.Scorer,
    as_of,
    knockout_scorer: scoring.Scorer | None = None,
    settings: ScoreSettings = ScoreSettings(),
    checked: bool = False,
) -> DataFrame:
    """Score the queue in one pass, or survivors of a knockout pass; return the summary.

    ``checked`` says that the rubrics have been checked already.
    """
    if not checked:
        rubric.check(rubrics)
    # A repeated key in an answer keeps its last value.
    store.spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    settle(store)
    if settings.retry_failed:
        _put_back(store, as_of)
    prefixes = written(role_prefixes(rubrics, jobs), "prefixes")
    single = settings.mode == "single"
    if single:
        results = _stage(store, "single", "stage1", scorer, prefixes, settings, as_of)
        return scoring.score_summary([("single", results)])
    first = _stage(
        store, "knockout", "stage1", knockout_scorer or scorer, prefixes, settings, as_of
    )
    second = _stage(store, "full", "stage2", scorer, prefixes, settings, as_of)
    return scoring.score_summary([("knockout", first), ("full", second)])


def _stage(store, stage, queue, scorer, prefixes, settings, as_of) -> DataFrame:
    full, single = stage != "knockout", stage == "single"
    before = current_state(store)
    # Saved answers are taken up again only by a run that would ask the same.
    asked = (stage, scorer.dialect, scorer.model, scorer.thinking, settings.strict_ids, settings.strict_metadata)
    label = f"{_label(store)}-{_fingerprint(prefixes, *asked)}"
    metadata, columns = _metadata(store, settings.strict_metadata)
    if store.exists("texts"):
        texts = extract.useful(store.read("texts"))
    else:  # nothing has been parsed yet, so nothing is due either
        texts = store.spark.createDataFrame([], "role string, candidate_id string, text string")
    queued = state.queue(before, queue)
    blocks = candidate_blocks(queued, texts, metadata, columns)
    small = fits(prefixes)
    tasks = scoring.tasks_for(settings.concurrency, settings.threads, settings.tasks)

    name = f"{label}-{stage}"

    def request(due: DataFrame) -> DataFrame:
        return scoring.build_requests(due, prefixes, scorer, full, tasks, small=small)

    def build(keys: DataFrame | None) -> DataFrame:
        return request(blocks if keys is None else blocks.join(keys, list(KEY), "left_semi"))

    # Requests dealt by key to a divisor of the buckets lie as the buckets do: all rows of one are
    # in one task, and the answers, the widest rows of a run, are stored where they were given.
    aligned = bool(store.buckets and tasks) and store.buckets % tasks == 0

    def save(answers: DataFrame, *place: int) -> DataFrame:
        table = "-".join([f"attempts/{name}", *map(str, place)])
        if aligned:
            store.comes_aligned(table)
        return store.once(table, answers)

    # Waves once begun are gone on with, whatever the settings are now.
    if settings.wave_rows or store.once_written(f"due/{name}"):
        due, waves = _due(store, name, blocks, settings.wave_rows or 1)
        attempts = scoring.run_waves(
            due, waves, request, scorer, full, save, settings.threads, settings.delays
        )
    else:
        attempts = scoring.run_attempts(
            build, scorer, full, save, settings.threads, settings.delays
        )
    results = scoring.outcomes(
        scoring.readiness(queued, texts),
        scoring.resolve(attempts),
        full,
        single,
        prefixes if settings.strict_ids else None,
    )
    results = store.append_run("results", scoring.with_document(results, full), label, aligned=True)
    events = scoring.score_events(results, full, single, settings.stamp_answers)
    store.write("state", state.apply_events(before, events, as_of), aligned=True)
    return results


def _due(store: Store, name: str, blocks: DataFrame, wave_rows: int) -> tuple[DataFrame, int]:
    """The blocks due by wave, written once, and how many waves they were dealt to."""
    table, ready = f"due/{name}", blocks.filter(F.col("block").isNotNull())
    # An interrupted stage keeps its waves: their number is read from what it wrote.
    waves = 1 if store.once_written(table) else scoring.waves_for(ready.count(), wave_rows)
    due = store.once_by(table, scoring.with_waves(ready, waves), "wave")
    return due, (due.agg(F.max("wave")).first()[0] or 0) + 1


def stage_progress(store: Store) -> DataFrame | None:
    """How far the waves of the stage under way are, per role and wave; None where none is."""
    prefix = f"{_label(store)}-"
    begun = [n for n in store.names("due") if n.startswith(prefix) and store.once_written(f"due/{n}")]
    every = None
    for name in begun:
        due = store.spark.read.parquet(f"{store.root}/due/{name}")
        rounds = [f"attempts/{n}" for n in store.names("attempts") if n.startswith(f"{name}-")]
        saved = [store.read(n).select(*KEY, "payload") for n in rounds if store.exists(n)]
        tried = saved[0] if saved else due.select(*KEY, F.lit(None).cast("string").alias("payload")).limit(0)
        for more in saved[1:]:
            tried = tried.unionByName(more)
        stage = F.lit(name.rpartition("-")[2]).alias("stage")
        part = scoring.wave_progress(due, tried).select("role", stage, "wave", "due", "answered", "failed", "waiting")
        every = part if every is None else every.unionByName(part)
    return every


def note(store: Store, notes: DataFrame) -> DataFrame:
    """Merge run metadata (role, key, value, seq) into the store's; return what holds now."""
    columns = ["role", "key", "value", "seq"]
    known = store.read("meta") if store.exists("meta") else notes.limit(0)
    return store.write("meta", state.upsert_meta(known.select(columns), notes.select(columns)))


def _role_notes(rubrics: DataFrame, as_of, notes: dict[str, str], seq: int) -> DataFrame:
    """created_at, the role's title and the caller's own notes, for each role of the rubrics."""
    clock = F.date_format(state.instant(as_of), "yyyy-MM-dd HH:mm:ss")
    pairs = [("created_at", clock), ("role", F.coalesce("title", "role"))]
    pairs += [(k, F.lit(v)) for k, v in sorted(notes.items())]
    every = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs))
    return rubrics.select("role", F.explode(every).alias("n")).select(
        "role", "n.*", F.lit(seq).cast("long").alias("seq")
    )


def run_rank(
    store: Store,
    out: str,
    top: int = C.DEFAULT_TOP_N,
    strict_metadata: bool = False,
    trust_reply_id: bool = True,
    bundle_files: bool = False,
) -> DataFrame:
    """Write the full ranking, the top N and the bundle under ``out``; return the summary.

    ``out`` must be new: a ranking never mixes with the files of an earlier one. With
    ``bundle_files`` the bundle's resumes are written as files of their own as well, under
    ``out/ranked_files``, N per role at most.
    """
    now = current_state(store)
    metadata, _ = _metadata(store, strict_metadata)
    documents = scoring.latest_documents(store.read("results"))
    rows = ranking.scored_candidates(now, documents, metadata, trust_reply_id)
    narrow = ranking.scored_order(now, documents)
    ranked = store.write("ranked", ranking.projected(ranking.rank_all(rows, narrow)))
    first = ranked.filter(F.col("rank") <= top)
    roles = now.select("role").distinct()
    write_ranked(ranked, f"{out}/ranked_full", roles=roles)
    write_ranked(first, f"{out}/ranked", one_file=True, roles=roles)
    if store.exists("resumes"):
        bundle = ranked_bundle(first, store.read("resumes"))
    else:
        none = store.spark.createDataFrame([], "role string, candidate_id string, content binary")
        bundle = ranked_bundle(first, none)
    bundle.write.partitionBy("role").parquet(f"{out}/ranked_resumes")
    copied = store.spark.read.schema(bundle.schema).parquet(f"{out}/ranked_resumes")
    if bundle_files:
        write_files(copied, f"{out}/ranked_files")
    return ranking.rank_summary(ranked, first, copied.select("role"))


def run_audit(
    store: Store, rubrics: DataFrame, groups: DataFrame | None = None, top: int = C.DEFAULT_TOP_N
) -> dict[str, DataFrame]:
    """Audit the scored candidates; nothing of the run changes.

    Writes ``audit``, the recomputed totals, and ``score_bins``, the sketch of totals by the columns
    of ``groups`` (role, candidate_id, one row per candidate, and what candidates reported of
    themselves), where the first ``top`` per role count as selected. Sketches of several stores
    merge by ``audit.merged_bins``. Candidates without a row in ``groups`` are a group of nulls.
    """
    now = current_state(store)
    documents = scoring.latest_documents(store.read("results"))
    scored = now.filter(F.col("status") == "scored").select(*KEY)
    answers = criteria_view(documents.select(*KEY, "document").join(scored, list(KEY), "left_semi"))
    totals = store.write("audit", audit.recomputed_totals(answers, rubrics))
    narrow = ranking.scored_order(now, documents)
    key = ["role", "state_id"]
    rows = narrow.join(ranking.rank_numbers(narrow, key), key).withColumnRenamed("state_id", "candidate_id")
    names = [] if groups is None else [c for c in groups.columns if c not in KEY]
    if groups is not None:
        rows = rows.select(*KEY, "weighted_total", "rank").join(groups, list(KEY), "left")
    bins = store.write("score_bins", audit.score_bins(rows, names, F.col("rank") <= top))
    return {"totals": audit.audit_summary(totals), "groups": audit.distributions(bins, names)}


def run_all(
    store: Store,
    out: str,
    as_of,
    rubrics: DataFrame,
    jobs: DataFrame,
    scorer: scoring.Scorer,
    raw: DataFrame | None = None,
    resumes: DataFrame | None = None,
    readers=None,
    readings: DataFrame | None = None,
    knockout_scorer: scoring.Scorer | None = None,
    settings: ScoreSettings = ScoreSettings(),
    top: int = C.DEFAULT_TOP_N,
    fresh: bool = False,
    notes: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """Ingest, parse, score and rank. A store with a state resumes and skips the ingest.

    ``notes`` are kept as run metadata of each role, the latest of a name; created_at is that of
    the role's first run. Where ``settings`` retries failures, failed parses are retried too.

    A fresh start needs both inputs and is refused on a store that holds a state; use a
    new root instead, nothing is ever deleted.
    """
    started = store.exists("state")
    if fresh and started:
        raise ValueError("a fresh start needs a new store; this one holds a state")
    if not started and (raw is None or resumes is None):
        raise ValueError("a fresh start needs candidates and resumes")
    rubric.check(rubrics)
    summaries = {}
    if not started:
        summaries["ingest"] = run_ingest(store, raw, resumes, as_of)
    if notes is not None:
        number = len(store.versions("meta")) + 1
        summaries["meta"] = note(store, _role_notes(rubrics, as_of, notes, number))
    summaries["parse"] = run_parse(store, as_of, readers, readings, settings.retry_failed)
    summaries["score"] = run_score(
        store, rubrics, jobs, scorer, as_of, knockout_scorer, settings, checked=True
    )
    summaries["rank"] = run_rank(store, out, top)
    summaries["status"] = state.status_counts(current_state(store)).orderBy("role", "status")
    return summaries
