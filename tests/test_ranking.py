"""Order, numbering, top-N, names, files and the bundle."""

import random

import pytest
from pyspark.sql import functions as F

from candrank import constants as C
from candrank.operators import ranking
from candrank.sources.documents import document_view, read_documents, unreadable_documents
from candrank.sources.rankings import write_ranked
from candrank.sources.resumes import ranked_bundle, resume_presence

ROWS = (
    "role string, candidate_id string, weighted_total double, scored_at timestamp, "
    "created_at timestamp, ingest_seq long"
)


def rows(spark, data):
    df = spark.createDataFrame(data, ROWS.replace("timestamp", "string"))
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("scored_at", "created_at")})


def day(n):
    return None if n is None else f"2024-01-{n:02d} 00:00:00"


def sample(n, roles=("hot",) * 6 + ("a", "b", "c")):
    draw = random.Random(9)
    return [
        (
            draw.choice(roles),
            f"c{i}",
            draw.choice([1.0, 5.5, 5.5, 5.5, 9.25]),
            day(draw.choice([None, 1, 2, 2, 2])),
            day(1),
            i,
        )
        for i in range(n)
    ]


def expected_ranks(data):
    ranks, out = {}, {}
    for role, key, *_ in sorted(data, key=lambda r: (r[0], -r[2], r[3] or "", r[4], r[5])):
        ranks[role] = ranks.get(role, 0) + 1
        out[key] = ranks[role]
    return out


def got_ranks(df):
    return {r.candidate_id: r["rank"] for r in df.collect()}


def test_order_with_ties(spark):
    data = [
        ("r", "low", 3.0, day(1), day(1), 0),
        ("r", "late", 9.0, day(3), day(1), 1),
        ("r", "early", 9.0, day(2), day(1), 5),
        ("r", "never", 9.0, None, day(1), 6),
        ("r", "same2", 6.0, day(1), day(1), 4),
        ("r", "same1", 6.0, day(1), day(1), 3),
        ("r", "older", 6.0, day(1), day(1), 2),
    ]
    got = ranking.rank_all(rows(spark, data)).orderBy("rank")
    assert [r.candidate_id for r in got.collect()] == ["never", "early", "late", "older", "same1", "same2", "low"]


def test_window_and_runs_agree_with_a_sort(spark):
    data = sample(3000)
    df = rows(spark, data).repartition(5)
    expected = expected_ranks(data)
    assert got_ranks(ranking.rank_all(df)) == expected
    assert got_ranks(ranking.rank_all(df, runs=9)) == expected


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def below_windows(plan):
    """The parts of a plan that windows, sorts and repartitionings read."""
    depth, out = None, []
    for line in plan.splitlines():
        at = next((i for i, c in enumerate(line) if c.isalpha()), 0)
        if depth is not None and at <= depth:
            depth = None
        if depth is None and line[at:].startswith(("Window", "Sort", "Repartition")):
            depth = at
        if depth is not None:
            out.append(line)
    return "\n".join(out)


def test_ranking_sorts_keys_and_order_alone(spark, monkeypatch):
    """Neither the sort nor a window sees the summary; in every size the ranks come by key."""
    wide = rows(spark, sample(200)).withColumn("summary", F.concat(F.lit("long text "), "candidate_id"))
    plans, original = [], ranking.written

    def noted(df, label):
        plans.append((label, plan_of(df)))
        return original(df, label)

    monkeypatch.setattr(ranking, "written", noted)
    for ranked in (ranking.rank_all(wide), ranking.top_n(wide, 7)):
        assert all("summary" not in plan for _, plan in plans)
        assert "summary" in plan_of(ranked) and "summary" not in below_windows(plan_of(ranked))
    sorts = [label for label, plan in plans if "Sort [" in plan]
    assert sorts == ["ranked-runs"]


def test_a_large_role_is_split_over_tasks(spark):
    placed = rows(spark, sample(3000)).orderBy("role", *ranking.rank_order())
    parts = placed.filter("role = 'hot'").select(F.spark_partition_id().alias("p")).distinct().count()
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" in plan and parts >= 1


@pytest.mark.parametrize("n", [1, 7, 50, 5000])
def test_top_n(spark, n):
    data = sample(2000)
    expected = {k: r for k, r in expected_ranks(data).items() if r <= n}
    for fan in (2, 64):
        assert got_ranks(ranking.top_n(rows(spark, data).repartition(7), n, fan=fan)) == expected


def test_top_n_sends_n_rows_a_task(spark):
    """Each of 7 tasks sends on 5 rows of a role at most, whatever the role's size."""
    data = rows(spark, sample(2000)).repartition(7)
    top = ranking.top_numbers(data, ["role", "candidate_id"], 5, 7, fan=2)
    assert {r.role: r.n for r in top.groupBy("role").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(("hot", "a", "b", "c"), 5)
    plan = top._jdf.queryExecution().executedPlan().toString()
    # Three rounds, each pruned before and after its exchange.
    assert plan.count("WindowGroupLimit") == 6 and plan.count("hashpartitioning(role") == 3
    with pytest.raises(ValueError):
        ranking.top_n(rows(spark, sample(10)), 0)


def test_names_widen_past_999(spark):
    top = spark.range(1, 1201).select(
        F.lit("r").alias("role"), F.concat(F.lit("c"), "id").alias("candidate_id"), F.col("id").alias("rank")
    )
    small = top.filter("rank <= 12").withColumn("role", F.lit("s"))
    got = {(r.role, r["rank"]): r.file_name for r in ranking.with_bundle_names(top.unionByName(small)).collect()}
    assert got["r", 7] == "0007_c7.pdf" and got["r", 1200] == "1200_c1200.pdf"
    assert got["s", 7] == "007_c7.pdf"


STATE = (
    "role string, candidate_id string, status string, score_stage1_at timestamp, "
    "score_stage2_at timestamp, created_at timestamp, ingest_seq long"
)
DOCS = "role string, candidate_id string, document string"


def test_only_scored_rows_with_a_document_rank(spark):
    state = spark.createDataFrame(
        [("r", s, s, None, None, None, i) for i, s in enumerate(C.STATUSES)]
        + [("r", "nodoc", "scored", None, None, None, 20), ("r", "bad", "scored", None, None, None, 21), ("r", "bare", "scored", None, None, None, 22)],
        STATE,
    )
    docs = spark.createDataFrame(
        [("r", s, '{"candidate_id": "other", "weighted_total": 5, "recommend": 1, "summary": "s"}') for s in C.STATUSES]
        + [("r", "bad", "{oops"), ("r", "bare", "{}")],
        DOCS,
    )
    meta = spark.createDataFrame(
        [("r", "scored", "Ann", "link"), ("r", "bare", None, None)],
        "role string, candidate_id string, name string, profile_url string",
    )
    ranked = ranking.projected(ranking.rank_all(ranking.scored_candidates(state, document_view(docs), meta)))
    got = [tuple(r) for r in ranked.orderBy("rank").drop("role").collect()]
    assert got == [
        (1, "other", "Ann", "", "", "", "", 5.0, True, "s", "link"),
        (2, "bare", "", "", "", "", "", 0.0, False, "", ""),
    ]
    strict = ranking.scored_candidates(state, document_view(docs), meta, trust_reply_id=False)
    assert {r.candidate_id for r in strict.collect()} == {"scored", "bare"}
    no_meta = ranking.scored_candidates(state, document_view(docs), meta.limit(0))
    assert {r.candidate_id for r in no_meta.collect()} == {"other", ""}


def test_files_and_bundle(spark, tmp_path):
    data = [("r 1", f"c{i}", float(i), day(1), day(1), i) for i in range(4)]
    blank = {c: F.lit("") for c in ("name", "headline", "location", "current_title", "current_company", "profile_url")}
    ranked = ranking.rank_all(rows(spark, data)).withColumns(
        {**blank, "recommend": F.lit(True), "summary": F.lit('a "quoted"\nline, 2 ')}
    )
    write_ranked(ranked, str(tmp_path / "full"))
    write_ranked(ranked.filter("rank <= 2"), str(tmp_path / "top"), one_file=True)
    parts = list((tmp_path / "top").rglob("*.csv"))
    assert len(parts) == 1
    assert parts[0].read_text(encoding="utf-8") == (
        ",".join(C.RANKED_COLUMNS)
        + '\n1,c3,,,,,,3.000,true,"a ""quoted""\nline, 2 ",\n2,c2,,,,,,2.000,true,"a ""quoted""\nline, 2 ",\n'
    )
    resumes = spark.createDataFrame([("r 1", "c3", b"three"), ("r 1", "c0", b"zero")], "role string, candidate_id string, content binary")
    top = ranking.projected(ranked).filter("rank <= 3")
    for literals in (1000, 1):
        got = ranked_bundle(top, resumes, literals).collect()
        assert [(r["rank"], r.file_name, bytes(r.content)) for r in got] == [(1, "001_c3.pdf", b"three")]
    summary = ranking.rank_summary(ranked, top, ranked_bundle(top, resumes)).first()
    assert (summary.ranked, summary.top_n_written, summary.resumes_copied) == (4, 3, 1)


def test_file_sources_read_names(spark, tmp_path):
    for name in ("c 1.pdf", "ünï%20.pdf", "c.2.pdf", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    files = resume_presence(spark, str(tmp_path), "r")
    assert sorted(r.candidate_id for r in files.collect()) == ["c 1", "c.2", "ünï%20"]
    assert files.columns == ["role", "candidate_id"]
    for name in ("c 1.json", "ü.json", "a+b%20.json"):
        (tmp_path / name).write_text('{"summary":\n "s"}', encoding="utf-8")
    docs = read_documents(spark, str(tmp_path), "r")
    assert sorted(r.candidate_id for r in docs.collect()) == ["a+b%20", "c 1", "ü"]
    assert document_view(docs).count() == 3


def test_no_document_vanishes(spark):
    """A very long text is read; what can't be read has a reason."""
    start = '{"candidate_id": "x", "weighted_total": "4.5", "recommend": [0], "summary": '
    given = [
        ("long", ""),
        ("other", ""),
        ("cut", "{oops"),
        ("list", "[1]"),
        ("null", None),
    ]
    docs = spark.createDataFrame([("r", k, d) for k, d in given], DOCS)
    whole = F.when(
        F.col("candidate_id") == "long", F.concat(F.lit(start + '"'), F.repeat(F.lit("s"), 21_000_000), F.lit('"}'))
    ).when(
        F.col("candidate_id") == "other",
        F.concat(F.lit(start + '"s", "notes": "'), F.repeat(F.lit("n"), 21_000_000), F.lit('"}')),
    )
    docs = docs.withColumn("document", F.coalesce(whole, "document"))
    seen = document_view(docs).withColumn("summary", F.length("summary")).orderBy("candidate_id")
    assert [tuple(r) for r in seen.collect()] == [
        ("r", "long", "x", 4.5, True, 21_000_000),
        ("r", "other", "x", 4.5, True, 1),
    ]
    assert {r.candidate_id: r.reason for r in unreadable_documents(docs).collect()} == {
        "cut": "not one JSON value",
        "list": "not a JSON object",
        "null": "no document",
    }
