import os

import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from candrank.sources import folders, resumes
from candrank.sources.candidates import IngestError
from candrank.sources.documents import read_documents
from candrank.sources.files import write_files
from candrank.sources.resumes import ResumeScan, resume_presence
from candrank.sources.store import Store


@pytest.fixture
def no_spark_listing(monkeypatch):
    """Spark's readers of files, which keep each file's status on the driver, are not to be used."""
    form = DataFrameReader.format

    def checked(self, source):
        assert source != "binaryFile"
        return form(self, source)

    def text(self, *a, **b):
        raise AssertionError("text")

    monkeypatch.setattr(DataFrameReader, "format", checked)
    monkeypatch.setattr(DataFrameReader, "text", text)


def texts(scan):
    return {r.candidate_id: r.content and bytes(r.content).decode() for r in scan.resumes.collect()}


def test_scan_keeps_no_files_on_the_driver(spark, tmp_path, monkeypatch, no_spark_listing):
    monkeypatch.setattr(folders, "LISTED_ROWS", 7)
    monkeypatch.setattr(folders, "TASK_FILES", 3)
    monkeypatch.setattr(folders, "CONTENT_BYTES", 40)
    folder, store = tmp_path / "a b%20", Store(spark, str(tmp_path / "store"))
    folder.mkdir()
    for i in range(50):
        (folder / f"{i}.pdf").write_text(f"first {i}" * (i % 9 + 1))
    scan = ResumeScan(store, str(folder), "eng")
    scan.done()
    assert texts(scan) == {str(i): f"first {i}" * (i % 9 + 1) for i in range(50)}
    assert len(scan.resumes.inputFiles()) > 10
    (folder / "7.pdf").write_text("second 7, longer")
    (folder / "50.pdf").write_text("new")
    (folder / "8.pdf").unlink()
    scan = ResumeScan(store, str(folder), "eng")
    changes = {r.candidate_id: r.change for r in scan.changes.collect() if r.change != "same"}
    assert changes == {"7": "changed", "50": "new", "8": "gone"}
    assert texts(scan) == dict.fromkeys(map(str, (i for i in range(51) if i != 8))) | {"7": "second 7, longer", "50": "new"}
    assert len(resume_presence(spark, str(folder), "eng").inputFiles()) == 1


def test_documents_keep_no_files_on_the_driver(spark, tmp_path, no_spark_listing):
    for i in range(40):
        (tmp_path / f"c+{i} x.json").write_text(f'{{"n":\n {i}}}')
    docs = read_documents(spark, str(tmp_path), "r")
    assert {tuple(r) for r in docs.collect()} == {("r", f"c+{i} x", f'{{"n":\n {i}}}') for i in range(40)}
    # Planned from a listing, not from forty files.
    assert len(docs.inputFiles()) == 1


def odd_folder(folder):
    folder.mkdir()
    for name in ("a.pdf", "b c.pdf", "ünï%20+.pdf", "x.y.pdf", ".pdf", ".h.pdf", "_u.pdf", "_k=1.pdf", "_metadata.pdf", "n.PDF", "n.txt"):
        (folder / name).write_bytes(b"\xef\xbb\xbfx\r\n\xff\x00y\n")
    (folder / "empty.pdf").touch()
    (folder / "inner").mkdir()
    (folder / "inner/i.pdf").write_text("in a folder inside")
    (folder / "d.pdf").mkdir()
    (folder / "link.pdf").symlink_to(folder / "a.pdf")
    (folder / "broken.pdf").symlink_to(folder / "none")
    os.utime(folder / "a.pdf", ns=(0, 1_700_000_000_123_999_999))
    os.utime(folder / "x.y.pdf", ns=(0, -1_500_000))


def test_listing_is_sparks(spark, tmp_path):
    odd_folder(folder := tmp_path / "f")
    columns = ("path", "length", F.unix_micros("modificationTime").alias("time"))
    by_spark = resumes._spark_files(spark, str(folder), "*.pdf").select(*columns, "content")
    found = folders.listed(spark, str(folder), ".pdf").select(*columns)
    rows = {tuple(r) for r in found.collect()}
    assert {r[0].rpartition("/")[2] for r in rows} == {"a.pdf", "b c.pdf", "ünï%20+.pdf", "x.y.pdf", "_k=1.pdf", "link.pdf"}
    assert rows == {tuple(r)[:3] for r in by_spark.collect()}
    read = folders.contents(found.select("time", "path", "length", F.col("path").alias("name")))
    assert {(r.name, bytes(r.content)) for r in read.collect()} == {(r.path, bytes(r.content)) for r in by_spark.collect()}


def test_documents_have_their_bytes(spark, tmp_path):
    given = {"bom": b"\xef\xbb\xbf{}", "bad": b'{"a": "\xff\xc3"}\r\n', "zero": b"\0", "long": b"x" * 100_000}
    for name, data in given.items():
        (tmp_path / f"{name}.json").write_bytes(data)
    found = read_documents(spark, str(tmp_path), "r").select("candidate_id", F.hex("document").alias("x"))
    assert {r.candidate_id: bytes.fromhex(r.x) for r in found.collect()} == given
    by_spark = spark.read.option("pathGlobFilter", "*.json").text(str(tmp_path), wholetext=True)
    assert {bytes.fromhex(r.x) for r in by_spark.select(F.hex("value").alias("x")).collect()} == set(given.values())


def test_spark_lists_what_a_task_does_not(spark, tmp_path):
    (tmp_path / "pdf/year=1").mkdir(parents=True)
    (tmp_path / "pdf/year=1/a.pdf").write_text("a")
    path = str(tmp_path / "pdf")
    assert folders.listed(spark, path, ".pdf") is None
    assert [r.candidate_id for r in resume_presence(spark, path, "r").collect()] == ["a"]
    assert [r.candidate_id for r in resume_presence(spark, f"{path}/*", "r").collect()] == ["a"]
    store = Store(spark, str(tmp_path / "store"))
    for text in ("a", "other"):
        (tmp_path / "pdf/year=1/a.pdf").write_text(text)
        scan = ResumeScan(store, path, "r")
        scan.done()
        assert texts(scan) == {"a": text}
    with pytest.raises(IngestError):
        ResumeScan(store, f"{path}/none", "r")
    (tmp_path / "no files").mkdir()
    scan = ResumeScan(store, str(tmp_path / "no files"), "r")
    assert scan.resumes.count() == scan.changes.count() == 0


def test_a_file_that_goes_has_no_content(spark, tmp_path):
    for name in "ab":
        (tmp_path / f"{name}.pdf").write_text(name)
    found = folders.listed(spark, str(tmp_path), ".pdf")
    (tmp_path / "a.pdf").unlink()
    read = folders.contents(found, missing_ok=True).collect()
    assert sorted(bytes(r.content) for r in read if r.content is not None) == [b"b"] and len(read) == 2
    with pytest.raises(Exception, match="FileNotFoundError"):
        folders.contents(found).collect()


def test_written_files_replace_others_and_leave_nothing_else(spark, tmp_path):
    for text in ("one", "another"):
        rows = [(role, f"{i}.txt", f"{text} {i}".encode()) for role in "ab" for i in range(20)]
        files = spark.createDataFrame(rows, "role string, file_name string, content binary").repartition(4)
        assert write_files(files, str(tmp_path / "out")).count() == 40
    for role in "ab":
        folder = tmp_path / f"out/role={role}"
        assert {p.name: p.read_text() for p in folder.iterdir()} == {f"{i}.txt": f"another {i}" for i in range(20)}
