"""Header checks, the file scan, both duplicate policies and the summary."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from candrank.operators import ingest
from candrank.plans.run import _without_roles, run_ingest
from candrank.sources.candidates import IngestError, read_candidates, unknown_columns
from candrank.sources.resumes import resume_presence
from candrank.sources.store import Store


def put(path, text, encoding="utf-8"):
    path.write_text(text, encoding=encoding, newline="")
    return str(path)


def rows_of(df, *columns):
    return [tuple(r) for r in df.orderBy("ingest_seq").select(*columns).collect()]


def test_scan_keeps_text_order_and_unknown_columns(spark, tmp_path):
    path = put(
        tmp_path / "a.csv",
        'candidate_id,name,years_experience,note\r\n'
        '007,"Ann ""A"" Lee",3,"line one\nline two"\r\n\r\n'
        "8,Bo\r\n9,Cy,1,n,surplus\r\n",
    )
    df = read_candidates(spark, path, "eng")
    assert rows_of(df, "role", "candidate_id", "name", "years_experience", "note") == [
        ("eng", "007", 'Ann "A" Lee', "3", "line one\nline two"),
        ("eng", "8", "Bo", None, None),
        ("eng", "9", "Cy", "1", "n"),
    ]
    assert unknown_columns(df.columns) == ["note"]


def test_byte_order_mark_is_accepted(spark, tmp_path):
    path = put(tmp_path / "a.csv", "candidate_id\nc1\n", "utf-8-sig")
    assert rows_of(read_candidates(spark, path, "r"), "candidate_id") == [("c1",)]


@pytest.mark.parametrize(
    "text, message",
    [
        ("name,current_title\nx,y\n", "candidate_id"),
        ("", "no header"),
        ("candidate_id,name,name\n1,2,3\n", "more than once"),
        ("candidate_id,name,Name\n1,2,3\n", "more than once"),
        ("Candidate_ID\n1\n", "candidate_id"),
    ],
)
def test_bad_headers(spark, tmp_path, text, message):
    with pytest.raises(IngestError, match=message):
        read_candidates(spark, put(tmp_path / "a.csv", text), "r")


def test_missing_file(spark, tmp_path):
    with pytest.raises(IngestError, match="not found"):
        read_candidates(spark, str(tmp_path / "none.csv"), "r")
    with pytest.raises(IngestError, match="not found"):
        resume_presence(spark, str(tmp_path / "none"), "r")


def test_files_with_another_header_are_refused(spark, tmp_path):
    put(tmp_path / "a.csv", "candidate_id,name\n1,a\n")
    put(tmp_path / "b.csv", "name,candidate_id\nb,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_candidates(spark, str(tmp_path), "r").collect()


RAW = "role string, candidate_id string, current_title string, source_url string, ingest_seq long"


def test_first_row_for_the_state_last_row_for_the_metadata(spark):
    raw = spark.createDataFrame(
        [
            ("r", " c1 ", " first ", " u1 ", 0),
            ("r", "c1", "second", None, 1),
            ("r", "c1", "third", "", 2),
            ("r", "", "x", "", 3),
            ("r", " \t", "x", "", 4),
            ("r", None, "x", "", 5),
            ("s", "c1", "  ", "u", 6),
        ],
        RAW,
    )
    first = ingest.keep_first(ingest.normalise(raw)).orderBy("role").collect()
    assert [(r.role, r.candidate_id, r.current_title, r.source_url, r.duplicates) for r in first] == [
        ("r", "c1", "first", "u1", 2),
        ("s", "c1", None, "u", 0),
    ]
    last = {(r.role, r.candidate_id): r.current_title for r in ingest.metadata_keep_last(raw).collect()}
    # Blank but not empty ids stay in the untrimmed lookup and match nobody.
    assert last == {("r", " c1 "): " first ", ("r", "c1"): "third", ("r", " \t"): "x", ("s", "c1"): "  "}
    strict = {(r.role, r.candidate_id): r.current_title for r in ingest.metadata_keep_first(raw).collect()}
    assert strict == {("r", "c1"): " first ", ("s", "c1"): "  "}


def test_against_a_loop_with_a_hot_key(spark):
    draw = random.Random(5)
    data = []
    for i in range(3000):
        key = "hot" if draw.random() < 0.4 else f"c{draw.randrange(400)}"
        pad = draw.choice(["", " ", "\t", " "])
        data.append(("r", pad + key + pad, f"t{i}", f"u{i}", i))
    seen, copies = {}, {}
    for role, key, title, _, _ in data:
        seen.setdefault(key.strip(), title)
        copies[key.strip()] = copies.get(key.strip(), -1) + 1
    raw = spark.createDataFrame(data, RAW).repartition(7)
    got = ingest.keep_first(ingest.normalise(raw)).collect()
    assert {r.candidate_id: r.current_title for r in got} == seen
    assert {r.candidate_id: r.duplicates for r in got} == copies


def test_summary(spark):
    raw = spark.createDataFrame([("r", "a", "", "", 0), ("r", "b", "", "", 1), ("r", "a ", "", "", 2)], RAW)
    files = spark.createDataFrame([("r", "a"), ("r", "zz"), ("s", "b")], "role string, candidate_id string")
    arrived = ingest.resume_presence(ingest.keep_first(ingest.normalise(raw)), files)
    assert ingest.ingest_summary(arrived).first().asDict() == {
        "role": "r",
        "ingested": 2,
        "with_resume": 1,
        "without_resume": 1,
        "duplicates_skipped": 1,
    }


def test_sequence_follows_the_file(spark, tmp_path):
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["candidate_id"])
        out.writerows([[f"c{i}"] for i in range(5000)])
    df = read_candidates(spark, str(tmp_path / "a.csv"), "r", multi_line=False)
    ids = [r.candidate_id for r in df.repartition(5).orderBy("ingest_seq").collect()]
    assert ids == [f"c{i}" for i in range(5000)]
    assert df.select(F.col("ingest_seq.file")).distinct().count() == 1


def test_rows_of_other_roles(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "role string, n int")
    roles = spark.createDataFrame([("a",), ("c",)], "role string")
    assert [r.n for r in _without_roles(df, roles).collect()] == [2]
    old = df.unionByName(spark.createDataFrame([(None, 4)], "role string, n int"))
    assert sorted(r.n for r in _without_roles(old, roles.union(spark.sql("SELECT cast(NULL AS string)"))).collect()) == [2, 4]
    assert _without_roles(df, roles.limit(0)).count() == 3


@pytest.mark.parametrize("buckets", [None, 3])
def test_any_header_name_and_any_duplicate_reach_the_store(spark, tmp_path, buckets):
    """Unusual column names, a hot id and two roles; the second input replaces one role."""
    hot = "".join(f"c1,n{i},a,b,c\n" for i in range(50))
    path = put(tmp_path / "a.csv", 'candidate_id,Full Name,x.y,"p,q=r;(s)",role_hint\n' + hot + "c2,n,a,,c\n")
    files = spark.createDataFrame([("r", "c1"), ("s", "c1")], "role string, candidate_id string")
    store = Store(spark, str(tmp_path / "store"), buckets)
    got = run_ingest(store, read_candidates(spark, path, "r"), files, "2024-01-01").first()
    assert (got.ingested, got.duplicates_skipped) == (2, 49)
    assert got.unknown_columns == "Full Name, x.y, p,q=r;(s), role_hint"
    run_ingest(store, read_candidates(spark, path, "s"), files, "2024-01-02")
    again = put(tmp_path / "b.csv", "candidate_id,name\nc2,late\n")
    run_ingest(store, read_candidates(spark, again, "r"), files, "2024-01-03")
    lookup = {(r.role, r.candidate_id): (r["Full Name"], r["name"]) for r in store.read("metadata").collect()}
    assert lookup == {("r", "c2"): (None, "late"), ("s", "c1"): ("n49", None), ("s", "c2"): ("n", None)}
    states = {(r.role, r.candidate_id): r.status for r in store.read("state").collect()}
    assert states == {
        ("r", "c1"): "ok",
        ("r", "c2"): "no_resume",
        ("s", "c1"): "ok",
        ("s", "c2"): "no_resume",
    }
    assert store.read("candidates").count() == 52
