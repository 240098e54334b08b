"""Resume text: page assembly, the two-tier quality gate and parse outcomes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candrank import constants as C
from candrank.functions.text import drop_invalid, head, strip
from candrank.plans.joins import fits
from candrank.plans.scratch import written
from candrank.schemas import KEY, PAGES

# bytes of one file -> page texts
PageReader = Callable[[bytes], list[str]]

PAGES_PER_BLOCK = 10_000
_ROW_MASK = (1 << 33) - 1


def _joined(parts: Column) -> Column:
    """Sorted array of (position, text) -> texts that are not empty, joined by newline."""
    kept = F.filter(parts, lambda p: p["text"] != "")
    return F.array_join(F.transform(kept, lambda p: p["text"]), "\n")


def _listed(pages: DataFrame, keys: list[str], listed: DataFrame, how: str) -> DataFrame:
    """``pages`` of the listed keys (left_semi) or of all others (left_anti); null keys match."""
    names = {k: f"_listed_{k}" for k in keys}
    other = listed.select(*[F.col(k).alias(n) for k, n in names.items()])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()])
    return pages.join(F.broadcast(other) if fits(other) else other, same, how)


def numbered_pieces(pages: DataFrame, keys: list[str], block: int) -> DataFrame:
    """Pages with ``_run`` and ``_piece``, which order the pieces of a document of ``block`` pages at most.

    The pages are range-sorted by document, page and text over many tasks. A piece is so many
    rows of a task's run, counted and not read off the page numbers: any number of pages of
    one number is cut like any other.
    """
    row = F.monotonically_increasing_id().bitwiseAND(F.lit(_ROW_MASK))
    return (
        pages.select(*keys, "page", "text")
        .orderBy(*keys, "page", "text")
        .withColumns({"_run": F.spark_partition_id(), "_piece": F.floor(row / block)})
    )


def assemble_pages(pages: DataFrame, keys: list[str], block: int = PAGES_PER_BLOCK) -> DataFrame:
    """One text per document: its non-empty pages in page order, joined and stripped.

    Pages of one number are in the order of their texts. Documents are counted first, by key
    alone. Those of ``block`` pages at most are joined in one shuffle. Longer ones are
    joined piece by piece on many tasks, then from their pieces, so no task sorts more than
    ``block`` pages of a document at a time, however its pages are numbered.
    """
    sizes = pages.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    long = written(sizes.filter(F.col("_n") > block).select(*keys), "long-documents")
    in_page_order = F.sort_array(F.collect_list(F.struct("page", "text")))
    if long.isEmpty():
        texts = pages.groupBy(*keys).agg(_joined(in_page_order).alias("text"))
    else:
        short = _listed(pages, keys, long, "left_anti").groupBy(*keys).agg(_joined(in_page_order).alias("text"))
        pieces = (
            numbered_pieces(_listed(pages, keys, long, "left_semi"), keys, block)
            .groupBy(*keys, "_run", "_piece")
            .agg(_joined(in_page_order).alias("text"))
        )
        in_order = F.sort_array(F.collect_list(F.struct("_run", "_piece", "text")))
        texts = short.unionByName(pieces.groupBy(*keys).agg(_joined(in_order).alias("text")))
    return texts.withColumn("text", strip(F.col("text")))


def tiered_text(
    first: Column, second: Column, names: tuple[str, str], min_chars: int = C.MIN_USEFUL_CHARS
) -> tuple[Column, Column]:
    """(text, extractor): the second reading replaces a first one that is too short.

    The gate looks at the text before invalid characters go, and the second reading is
    taken even where it is shorter still.
    """
    enough = F.length(first) >= min_chars
    text = F.when(enough, first).otherwise(second)
    return drop_invalid(text), F.when(enough, F.lit(names[0])).otherwise(F.lit(names[1]))


def parse_outcome(has_file: Column, text: Column, error: Column, min_chars: int = C.MIN_USEFUL_CHARS) -> Column:
    """skipped, failed, unparseable or parsed; the length gate looks at the cleaned text."""
    return (
        F.when(~has_file, "skipped")
        .when(error.isNotNull(), "failed")
        .when(F.length(text) < min_chars, "unparseable")
        .otherwise("parsed")
    )


def read_files(
    files: DataFrame, readers: list[tuple[str, PageReader]], min_chars: int = C.MIN_USEFUL_CHARS
) -> DataFrame:
    """(role, candidate_id, content) -> (role, candidate_id, text, extractor, error).

    The readers come from the user, because decoding a file format is a library's work.
    They run where the rows are, one file at a time, and later readers only where the
    earlier text is too short. A reader that raises fails its file, not the job. A row
    without content keeps its place with nothing read.
    """

    def one(content):
        if content is None:
            return None, None, None
        text, name = "", None
        try:
            for name, reader in readers:
                text = "\n".join(p for p in reader(content) if p).strip()
                if len(text) >= min_chars:
                    break
        except Exception as e:
            return None, None, str(e)
        return text.encode("utf-8", "ignore").decode("utf-8"), name, None

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = [one(content) for content in batch["content"]]
            read = pd.DataFrame(rows, columns=["text", "extractor", "error"], index=batch.index)
            yield pd.concat([batch[list(KEY)], read], axis=1)

    return files.select(*KEY, "content").mapInPandas(run, PAGES)


def pypdf_pages(content: bytes) -> list[str]:
    """Pages by pypdf, where it is installed; a page that fails reads as empty."""
    import io

    from pypdf import PdfReader

    texts = []
    for page in PdfReader(io.BytesIO(content)).pages:
        try:
            texts.append(page.extract_text() or "")
        except Exception:
            texts.append("")
    return texts


def pdfplumber_pages(content: bytes) -> list[str]:
    """Pages by pdfplumber, where it is installed."""
    import io

    import pdfplumber

    with pdfplumber.open(io.BytesIO(content)) as pdf:
        return [page.extract_text() or "" for page in pdf.pages]


PDF_READERS = [("pypdf", pypdf_pages), ("pdfplumber", pdfplumber_pages)]


def parse_results(queued: DataFrame, readings: DataFrame) -> DataFrame:
    """Queued candidates with their reading and ``outcome``; no reading means no file."""
    found = readings.withColumn("_found", F.lit(True))
    both = queued.select(*KEY).join(found, list(KEY), "left")
    has_file = F.col("_found").isNotNull()
    return both.withColumn(
        "outcome", parse_outcome(has_file, F.col("text"), F.col("error"))
    ).drop("_found")


def parse_files(
    queued: DataFrame, files: DataFrame, readers: list[tuple[str, PageReader]]
) -> DataFrame:
    """As ``parse_results``, reading the files of the queue in place.

    The queue is joined to the contents before the readers run, so their texts are not
    moved afterwards; between bucketed tables nothing is.
    """
    both = queued.select(*KEY).join(files.select(*KEY, "content"), list(KEY), "left")
    read = read_files(both, readers)
    has_file = F.col("extractor").isNotNull() | F.col("error").isNotNull()
    return read.withColumn("outcome", parse_outcome(has_file, F.col("text"), F.col("error")))


def with_length(results: DataFrame) -> DataFrame:
    """Results as they are stored; the text is kept only where it is useful."""
    kept = F.when(F.col("outcome") == "parsed", F.col("text"))
    return results.select(
        *KEY, kept.alias("text"), "extractor", "error", "outcome", F.length("text").alias("n_chars")
    )


def useful(results: DataFrame) -> DataFrame:
    """The texts to score. A key is parsed once, so it has one."""
    return results.filter(F.col("outcome") == "parsed")


def parse_events(results: DataFrame) -> DataFrame:
    """State events of a parse run; skipped candidates stay untouched."""
    failed = F.col("outcome") == "failed"
    return results.filter(F.col("outcome") != "skipped").select(
        *KEY,
        F.col("outcome").alias("event"),
        F.when(failed, F.lit("failed_parse")).alias("failure_status"),
        F.when(failed, head(F.col("error"), C.MAX_ERROR_CHARS)).alias("error"),
    )


def parse_summary(results: DataFrame) -> DataFrame:
    return results.groupBy("role").agg(
        *[
            F.count_if(F.col("outcome") == o).alias(o)
            for o in ("parsed", "unparseable", "failed", "skipped")
        ]
    )
