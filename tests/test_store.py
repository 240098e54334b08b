"""Versions, buckets, lookups, and the stream over the same store."""

import csv
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candrank.plans import joins
from candrank.plans.run import current_state, run_ingest, run_parse, stored_metadata
from candrank.plans.scratch import shared_folder, written
from candrank.sources.store import Store
from candrank.streaming.drops import candidate_stream, ingest_stream

KEYS = "role string, candidate_id string"


def keyed(spark, count, **columns):
    df = spark.range(count).select(
        F.concat(F.lit("00"), F.col("id") % 3).alias("role"), F.concat(F.lit("c"), "id").alias("candidate_id")
    )
    return df.withColumns(columns) if columns else df


@pytest.mark.parametrize("buckets", [None, 4])
def test_versions(spark, tmp_path, buckets):
    store = Store(spark, str(tmp_path / "s"), buckets)
    assert not store.exists("t")
    with pytest.raises(FileNotFoundError):
        store.read("t")
    store.write("t", keyed(spark, 5, n=F.lit(1)))
    store.write("t", keyed(spark, 7, n=F.lit(2)))
    assert store.versions("t") == [1, 2]
    assert store.read("t").count() == 7 and store.read("t", 1).count() == 5
    assert {r.role for r in store.read("t").collect()} == {"000", "001", "002"}
    # A version without its commit marker is not seen, and its number is not taken again.
    (tmp_path / "s" / "t" / "v=00000003").mkdir()
    assert store.versions("t") == [1, 2]
    store.write("t", keyed(spark, 1, n=F.lit(3)))
    assert store.versions("t") == [1, 2, 4]
    # Another session object over the same folder reads the same rows.
    assert Store(spark, str(tmp_path / "s"), buckets).read("t").count() == 1
    empty = store.write("t", keyed(spark, 0, n=F.lit(3)))
    assert empty.count() == 0 and store.read("t").columns == ["role", "candidate_id", "n"]


@pytest.mark.parametrize("buckets", [None, 4])
def test_append_only_new_keys(spark, tmp_path, buckets):
    store = Store(spark, str(tmp_path / "s"), buckets)
    store.append_new("t", keyed(spark, 5, n=F.lit(1)))
    assert store.append_new("t", keyed(spark, 8, n=F.lit(2))).groupBy("n").count().orderBy("n").collect() == [(1, 5), (2, 3)]
    assert store.read("t").count() == 8
    called = []
    store.once("u", keyed(spark, 2))
    assert store.once("u", keyed(spark, 99)).count() == 2 and not called


@pytest.mark.parametrize("first, then", [(4, 8), (None, 4), (4, None)])
def test_reopened_with_another_layout(spark, tmp_path, first, then):
    root = str(tmp_path / "s")
    Store(spark, root, first).write("a", keyed(spark, 300, n=F.lit(1)))
    for name in [t.name for t in spark.catalog.listTables() if t.name.startswith("candrank_")]:
        spark.sql(f"DROP TABLE {name}")  # external: a new session knows the files only
    store = Store(spark, root, then)
    store.append("a", keyed(spark, 400).filter("substr(candidate_id, 2) >= 300").withColumn("n", F.lit(2)), True)
    right = store.write("b", keyed(spark, 400, m=F.lit(1)))
    assert store.read("a").join(right.hint("merge"), ["role", "candidate_id"]).count() == 400


@pytest.mark.parametrize("buckets", [None, 4])
def test_torn_and_repeated_appends(spark, tmp_path, buckets):
    store = Store(spark, str(tmp_path / "s"), buckets)
    store.append_run("t", keyed(spark, 3), "r1")
    torn = tmp_path / "s" / "t" / "v=00000001-000001"
    keyed(spark, 1).withColumn("run", F.lit("r2")).write.parquet(str(torn))
    (torn / "_SUCCESS").rename(torn / "gone")
    assert store.read("t").count() == 3
    assert store.append_run("t", keyed(spark, 5), "r2").count() == 5
    for _ in range(2):
        store.append("u", keyed(spark, 6), part="b0")
    assert store.append("u", keyed(spark, 2), part="b1").count() == 8


def test_bucketed_tables_join_without_an_exchange(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), 4)
    left = store.write("l", keyed(spark, 100, n=F.lit(1)))
    right = store.write("r", keyed(spark, 80, text=F.lit("x")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = left.join(right, ["role", "candidate_id"], "left")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and joined.count() == 100
        grouped = left.groupBy("role", "candidate_id").count()
        assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
        found = left.filter("role = '001'")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(role,001)" in found
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_join_beyond_the_broadcast_limit(spark, how):
    large = keyed(spark, 200).withColumn("role", F.when(F.col("candidate_id") < "c5", "hot").otherwise(F.col("role")))
    lookup = spark.createDataFrame([("hot", 1), ("000", 2), ("x", 3)], "role string, v int")

    def rows(df):
        return sorted(map(tuple, df.select("role", "candidate_id", F.coalesce("v", F.lit(0))).collect()))

    small = joins.lookup_join(large, lookup, ["role"], how)
    salted = joins.lookup_join(large, lookup, ["role"], how, limit=0, salts=8)
    assert rows(small) == rows(salted) == rows(large.join(lookup, ["role"], how))
    assert "_salt" not in salted.columns
    assert "_salt" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert "ResolvedHint (strategy=broadcast)" in small._jdf.queryExecution().analyzed().toString()
    with pytest.raises(ValueError):
        joins.lookup_join(large, lookup, ["role"], "full")


def test_scratch_uses_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named
    assert sorted(r.id for r in written(spark.range(3), "t").collect()) == [0, 1, 2]


def put(folder, role, name, rows):
    target = folder / f"role={role}"
    target.mkdir(parents=True, exist_ok=True)
    with open(target / name, "w", newline="", encoding="utf-8") as f:
        out = csv.writer(f)
        out.writerow(["candidate_id", "current_title", "extra"])
        out.writerows(rows)


def test_stream_of_drops(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), 4)
    present = spark.createDataFrame([("eng", "a"), ("eng", "b"), ("ops", "a")], KEYS)

    def arrive():
        stream = candidate_stream(spark, str(tmp_path / "in"), ["candidate_id", "current_title", "extra"])
        ingest_stream(stream, lambda: present, store, lambda n: f"2024-05-0{n + 1} 00:00:00", str(tmp_path / "cp")).awaitTermination()
        return {(r.role, r.candidate_id): (r.status, r.current_title, str(r.created_at)[:10]) for r in current_state(store).collect()}

    put(tmp_path / "in", "eng", "1.csv", [["a", "first", "x"], [" a ", "second", "y"], ["c", "", ""]])
    assert arrive() == {
        ("eng", "a"): ("ok", "first", "2024-05-01"),
        ("eng", "c"): ("no_resume", None, "2024-05-01"),
    }
    put(tmp_path / "in", "eng", "2.csv", [["a", "third", "z"], ["b", "t", ""]])
    put(tmp_path / "in", "ops", "1.csv", [["a", "t", ""]])
    assert arrive() == {
        ("eng", "a"): ("ok", "third", "2024-05-01"),
        ("eng", "b"): ("ok", "t", "2024-05-02"),
        ("eng", "c"): ("no_resume", None, "2024-05-01"),
        ("ops", "a"): ("ok", "t", "2024-05-02"),
    }
    assert store.read("candidates").count() == 6


def _bytes(folder):
    return sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())


def test_a_batch_writes_as_much_as_it_brings(spark, tmp_path):
    """State and metadata of 20,000 candidates are not written again for a batch of three."""
    raw = "role string, candidate_id string, current_title string, source_url string, current_company string, ingest_seq long"
    many = keyed(spark, 20_000).select(
        "role", "candidate_id", F.md5("candidate_id").alias("current_title"), F.sha1("candidate_id").alias("source_url"),
        F.sha2("candidate_id", 256).alias("current_company"), F.xxhash64("candidate_id").alias("ingest_seq"),
    )
    store = Store(spark, str(tmp_path / "store"), 2)
    present = many.select("role", "candidate_id").filter("substr(candidate_id, 2) % 2 = 0")
    run_ingest(store, many, present, "2024-01-01", accumulate=True, batch="b0")
    whole = _bytes(tmp_path / "store")
    for number in (1, 2, 2):  # the second is replayed
        rows = [("000", "c0", f"new {number}", None, None, 10**18 + number), ("000", "c3", "t", "", "", 7), ("new", "x", "t", "u", "c", 8 + number)]
        run_ingest(store, spark.createDataFrame(rows, raw), present, f"2024-02-0{number}", accumulate=True, batch=f"b{number}")
    assert _bytes(tmp_path / "store") - whole < 0.1 * whole
    assert store.versions("state") == [1] and store.versions("metadata") == [1]
    now = {(r.role, r.candidate_id): (r.status, r.current_title, str(r.updated_at)[:10], str(r.created_at)[:10]) for r in current_state(store).collect()}
    assert len(now) == 20_001
    assert now["000", "c0"] == ("ok", "new 2", "2024-02-02", "2024-01-01")
    assert now["000", "c3"] == ("no_resume", "t", "2024-02-02", "2024-01-01")
    assert now["new", "x"] == ("no_resume", "t", "2024-02-02", "2024-02-01")
    last = {r.candidate_id: r.current_title for r in stored_metadata(store).filter("role in ('000', 'new')").collect()}
    assert last["c0"] == "new 2" and last["x"] == "t" and len(last) == 6668
    # The next stage settles what arrived.
    readings = spark.createDataFrame([("000", "c0", "t" * 300, "p", None)], "role string, candidate_id string, text string, extractor string, error string")
    run_parse(store, "2024-03-01", readings=readings)
    settled = {(r.role, r.candidate_id): (r.status, r.current_title, str(r.updated_at)[:10], str(r.created_at)[:10]) for r in store.read("state").collect()}
    assert settled == now | {("000", "c0"): ("ok", "new 2", "2024-03-01", "2024-01-01")}


@pytest.mark.parametrize("sticky", [True, False])
def test_arrivals_at_once_as_one_after_the_other(spark, sticky):
    from candrank.operators import state

    rng = random.Random(4)
    statuses = [None, "discovered", "failed_scrape", "ok", "no_resume", "scored", "knocked_out"]
    ids = [f"c{i}" for i in range(40)]
    schema = "role string, candidate_id string, source_url string, current_title string, current_company string, has_resume boolean, ingest_seq long"
    held = [("r", k, rng.choice(statuses[1:]), i) for i, k in enumerate(ids) if i % 2]
    empty = state.empty_state(spark, T.LongType())
    before = spark.createDataFrame(held, "role string, candidate_id string, status string, ingest_seq long")
    before = empty.unionByName(before.withColumn("created_at", F.lit("2023-01-01").cast("timestamp")), allowMissingColumns=True)
    one_by_one, every = before, None
    for number in range(4):
        rows = [("r", k, f"u{number}", rng.choice([None, f"t{number}"]), "c", rng.random() < 0.6, 100 * number + i) for i, k in enumerate(ids) if rng.random() < 0.6]
        found = spark.createDataFrame(rows, schema)
        at = f"2024-01-0{number + 1}"
        one_by_one = written(state.upsert(one_by_one, found, at, sticky), "upserted")
        part = state.arrivals(found, at, number, sticky)
        every = part if every is None else every.unionByName(part)
    got = state.upsert_arrivals(before, every)
    want = {r.candidate_id: r.asDict() for r in one_by_one.collect()}
    for row in got.collect():
        assert row.asDict() == want.pop(row.candidate_id)
    assert not want


@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_appended_parts_group_and_join(spark, tmp_path, how):
    """A key in several parts is one group, whatever it is joined to afterwards."""
    store = Store(spark, str(tmp_path / "store"), 4)
    rows = keyed(spark, 30, v=F.length("candidate_id"))
    other = store.write("other", rows)
    for part in ("a", "b"):
        store.append("parts", rows, part=part)
    once = store.read("parts").groupBy("role", "candidate_id").agg(F.max_by(F.struct("v"), "v").alias("m"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert len(other.join(once, ["role", "candidate_id"], how).collect()) == 30
        assert other.join(once, ["role", "candidate_id"], how).count() == 30
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
