"""Page assembly, the quality gate and parse outcomes."""

import random

import pytest
from pyspark.sql import functions as F

from candrank.operators import extract

KEYS = "role string, candidate_id string"


@pytest.mark.parametrize("block", [2, 3, 10_000])
def test_pages_join_in_order(spark, block):
    draw = random.Random(2)
    pages, expected = [], {}
    for doc in ("a", "b", "c"):
        texts = [draw.choice(["", "x", f"page {p} of {doc} "]) for p in range(11)]
        pages += [(doc, p, t) for p, t in enumerate(texts)]
        expected[doc] = "\n".join(t for t in texts if t).strip()
    draw.shuffle(pages)
    df = spark.createDataFrame(pages, "doc string, page int, text string").repartition(3)
    got = extract.assemble_pages(df, ["doc"], block).collect()
    assert {r.doc: r.text for r in got} == expected


def test_pages_of_one_number_are_cut_into_bounded_pieces(spark):
    hot = spark.range(50_000).select(
        F.lit("hot").alias("doc"),
        F.when(F.col("id") % 5 > 0, 7).otherwise(F.col("id") % 11).cast("int").alias("page"),
        F.lpad(((F.col("id") * 7919) % 50_000).cast("string"), 6, "0").alias("text"),
    )
    others = spark.createDataFrame([("a", 1, "y"), ("a", 0, "x"), (None, 0, "n")], "doc string, page int, text string")
    pages = hot.unionByName(others).repartition(4)
    cut = extract.numbered_pieces(pages, ["doc"], 1_000).groupBy("doc", "_run", "_piece").count()
    assert cut.agg(F.max("count")).first()[0] <= 1_000 and cut.count() >= 50
    got = {r.doc: r.text for r in extract.assemble_pages(pages, ["doc"], 1_000).collect()}
    rows = sorted((r.page, r.text) for r in hot.collect())
    assert got == {"hot": "\n".join(t for _, t in rows), "a": "x\ny", None: "n"}


def test_long_document_without_key(spark):
    pages = spark.createDataFrame([(None, p, str(p)) for p in range(6)], "doc string, page int, text string")
    assert extract.assemble_pages(pages, ["doc"], 2).collect() == [(None, "0\n1\n2\n3\n4\n5")]


def test_only_empty_pages(spark):
    df = spark.createDataFrame([("a", 0, ""), ("a", 1, None)], "doc string, page int, text string")
    assert extract.assemble_pages(df, ["doc"]).first().text == ""


def test_gate_on_columns(spark):
    rows = [("x" * 200, "y"), ("x" * 199, "y"), ("", ""), ("é" * 200, "y")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, a string, b string")
    text, name = extract.tiered_text(F.col("a"), F.col("b"), ("one", "two"))
    got = df.select("i", text.alias("t"), name.alias("n")).orderBy("i").collect()
    assert [(r.t, r.n) for r in got] == [("x" * 200, "one"), ("y", "two"), ("", "two"), ("é" * 200, "one")]


def first(content):
    return content.decode("utf-8", "surrogateescape").split("\f")


def second(content):
    if b"bad" in content:
        raise ValueError("no such page")
    return ["short"]


def test_readers(spark):
    contents = {
        "long": b"  " + b"x" * 300 + b"\f\fy ",
        "tiny": b"tiny",
        "broken": b"bad",
        # 200 characters for the gate, 199 once the invalid one is dropped
        "edge": b"x" * 199 + b"\xff",
    }
    df = spark.createDataFrame([("r", k, v) for k, v in contents.items()], f"{KEYS}, content binary")
    got = {r.candidate_id: r for r in extract.read_files(df, [("one", first), ("two", second)]).collect()}
    assert (got["long"].text, got["long"].extractor) == ("x" * 300 + "\ny", "one")
    assert (got["tiny"].text, got["tiny"].extractor) == ("short", "two")
    assert (got["broken"].text, got["broken"].error) == (None, "no such page")
    assert (got["edge"].text, got["edge"].extractor) == ("x" * 199, "one")
    queued = spark.createDataFrame([("r", k) for k in (*contents, "gone")], KEYS)
    readings = extract.read_files(df, [("one", first), ("two", second)])
    results = extract.parse_results(queued, readings)
    outcomes = {r.candidate_id: r.outcome for r in results.collect()}
    assert outcomes == {
        "long": "parsed",
        "tiny": "unparseable",
        "broken": "failed",
        "edge": "unparseable",
        "gone": "skipped",
    }
    assert extract.parse_summary(results).drop("role").first().asDict() == {
        "parsed": 1,
        "unparseable": 2,
        "failed": 1,
        "skipped": 1,
    }
    events = {r.candidate_id: (r.event, r.failure_status) for r in extract.parse_events(results).collect()}
    assert events["broken"] == ("failed", "failed_parse") and "gone" not in events
    stored = extract.with_length(results)
    assert [(r.candidate_id, r.n_chars) for r in extract.useful(stored).collect()] == [("long", 302)]
    assert stored.filter("text is not null").count() == 1
    in_place = extract.parse_files(queued, df, [("one", first), ("two", second)])
    assert {r.candidate_id: r.outcome for r in in_place.collect()} == outcomes


def test_lone_surrogate_is_dropped(spark):
    def surrogate(content):
        return ["a" * 250 + "\ud83d" + "b"]

    df = spark.createDataFrame([("r", "c", b"")], f"{KEYS}, content binary")
    assert extract.read_files(df, [("one", surrogate)]).first().text == "a" * 250 + "b"
