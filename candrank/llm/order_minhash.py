"""Document fingerprints by Order MinHash, in DataFrame expressions alone.

A text is a row of words (white space apart; long ones cut after ``WORD`` characters). Its
k-mers of ``K`` words are numbered by occurrence, so that a repeated k-mer counts each time.
A hash deals the numbered k-mers to ``SLOTS`` slots; in each slot the two with the smallest
hash are taken, put back into the order of the text, and hashed as a tuple. A slot with a single
one, as most slots of a short text, takes the smallest of the next filled slot as its second, so
that order counts at any length. The share of equal tuples falls with the edit distance: moved
text changes it, which it does not for plain MinHash.

Defined results: a null text is empty and has no k-mers, two such fingerprints are alike (1.0);
fewer words than ``K`` are one k-mer, and a lone k-mer a tuple by itself; texts of more than
2 ** ``PLACE_BITS`` words, some 300 MB at least, are beyond it; repeated rows of one id and text are one place in the
order of documents and share all results; null ids come first; rows of one id and several
texts are ordered by a hash of the text; a single document is its own next one; an empty table
gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candrank.llm.common import text_of, written

K = 3
SLOTS = 64
WORD = 16
#: Bits of a long that hold a position; the others hold a hash.
PLACE_BITS = 27
_EMPTY = -1


def signature(rows: DataFrame, text: str, out: str) -> DataFrame:
    """``rows`` with the array ``out``: the tuple hash of each slot, -1 for empty slots."""
    kept = rows.columns
    hashed, place = f"-{1 << PLACE_BITS}L", f"{(1 << PLACE_BITS) - 1}L"
    slot = "shiftrightunsigned({}, " + str(64 - (SLOTS - 1).bit_length()) + ")"
    words = ", ".join(f"get(_words, i + {j})" for j in range(K))
    steps = (
        ("_words", f"regexp_extract_all({text}, '\\\\S{{1,{WORD}}}', 0)"),
        # A hash with the place in its low bits, so that equal k-mers sort by place.
        (
            "_kmers",
            f"if(size(_words) = 0, cast(array() as array<bigint>), sort_array(transform("
            f"sequence(0, greatest(size(_words) - {K}, 0)), "
            f"i -> (xxhash64({words}) & {hashed}) + i)))",
        ),
        (
            "_starts",
            f"if(size(_kmers) = 0, cast(array() as array<int>), filter(sequence(0, size(_kmers) - 1), "
            f"p -> p = 0 or (get(_kmers, p) & {hashed}) <> (get(_kmers, p - 1) & {hashed})))",
        ),
        (
            "_numbered",
            f"sort_array(flatten(transform(_starts, (a, j) -> transform("
            f"sequence(a, coalesce(get(_starts, j + 1), size(_kmers)) - 1), "
            f"p -> (xxhash64(get(_kmers, p) & {hashed}, p - a) & {hashed}) "
            f"+ (get(_kmers, p) & {place})))))",
        ),
        (
            "_heads",
            f"if(size(_numbered) = 0, cast(array() as array<int>), "
            f"filter(sequence(0, size(_numbered) - 1), p -> p = 0 or "
            f"{slot.format('get(_numbered, p)')} <> {slot.format('get(_numbered, p - 1)')}))",
        ),
        (
            "_pairs",
            f"transform(_heads, p -> named_struct('slot', cast({slot.format('get(_numbered, p)')} as int), "
            f"'a', get(_numbered, p), "
            f"'b', get(_numbered, if(p + 1 < size(_numbered), p + 1, if(p = 0, -1, 0)))))",
        ),
        (
            "_tuples",
            f"map_from_entries(transform(_pairs, x -> struct(x.slot, cast(if("
            f"(x.b & {place}) < (x.a & {place}), xxhash64(x.b & {hashed}, x.a & {hashed}), "
            f"xxhash64(x.a & {hashed}, x.b & {hashed})) & 16777215L as int))))",
        ),
        (
            out,
            f"if(size(_tuples) = 0, array_repeat({_EMPTY}, {SLOTS}), transform("
            f"sequence(0, {SLOTS - 1}), s -> coalesce(try_element_at(_tuples, s), {_EMPTY})))",
        ),
    )
    # Each array that a lambda reads is named twice in the step after it, so that the optimizer
    # keeps it a column and does not compute it again for every element.
    for name, sql in steps:
        rows = rows.withColumn(name, F.expr(sql))
    return rows.select(*kept, out)


def printed(signed: str) -> Column:
    """The fingerprint: six hexadecimal digits a slot."""
    return F.expr(
        f"lower(array_join(transform({signed}, x -> if(x < 0, '------', lpad(hex(x), 6, '0'))), ''))"
    )


def likeness(left: str, right: str) -> Column:
    """The share of slots with equal tuples among those that either fills."""
    same = f"size(filter(zip_with({left}, {right}, (x, y) -> x = y and x >= 0), z -> z))"
    either = f"size(filter(zip_with({left}, {right}, (x, y) -> x >= 0 or y >= 0), z -> z))"
    return F.expr(f"if({either} = 0, 1D, {same} / {either})")


def in_order(rows: DataFrame) -> DataFrame:
    """(doc_id, h, n, next, before, n_before) of each distinct (doc_id, h), in a ring by doc_id.

    Rows are range-partitioned; a part's last row is followed by the first row of the next part,
    and only these first rows, one for each part, meet in one place.
    """
    parts = written(
        rows.select("doc_id", "h", "n")
        .distinct()
        .repartitionByRange("doc_id", "h")
        .withColumn("part", F.spark_partition_id()),
        "order",
    )
    own = F.struct("doc_id", "h")
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "h")
    all_parts = Window.orderBy("part")
    first = parts.groupBy("part").agg(F.min(own).alias("first"))
    after = first.select(
        F.col("part").alias("p"),
        F.coalesce(
            F.lead("first").over(all_parts),
            F.first("first").over(
                all_parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            ),
        ).alias("after"),
    )
    ring = (
        parts.withColumn("lead", F.lead(own).over(within))
        .join(after, F.col("part") == F.col("p"))
        .select("doc_id", "h", "n", F.coalesce("lead", "after").alias("next"))
    )
    ring = written(ring, "ring")
    back = ring.select(
        F.col("next.doc_id").alias("__id"),
        F.col("next.h").alias("__h"),
        F.struct("doc_id", "h").alias("before"),
        F.col("n").alias("n_before"),
    )
    return written(
        ring.join(
            back, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
        ).drop("__id", "__h"),
        "ring",
    )


def _by(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join on (doc_id, h) = (__id, __h)."""
    return left.join(
        right, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))
    ).drop("__id", "__h")


def fingerprint(docs: DataFrame) -> DataFrame:
    """Per row: its fingerprint, that of its edited text, and how alike they and the next are.

    The edited text ends with the beginning of the next document's instead of its last quarter.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("h"), F.char_length("text").alias("n")
    )
    ring = in_order(rows)
    texts = rows.select("doc_id", "h", "text")
    around = ring.select(
        F.col("doc_id").alias("__id"), F.col("h").alias("__h"), "before", "n_before"
    )
    gifts = (
        _by(texts, around)
        .select(
            F.col("before.doc_id").alias("__id"),
            F.col("before.h").alias("__h"),
            F.expr("substring(text, 1, cast(floor(n_before / 4) as int))").alias("gift"),
        )
        .groupBy("__id", "__h")
        .agg(F.first("gift").alias("gift"))
    )
    edited = _by(texts, gifts).select(
        "doc_id",
        "h",
        "text",
        F.char_length("text").cast("long").alias("n_chars"),
        F.expr(
            "concat(substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int)), gift)"
        ).alias("edited"),
    )
    signed = signature(signature(edited, "text", "own"), "edited", "changed")
    signed = written(
        signed.select(
            "doc_id", "h", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "own", "changed"
        ),
        "signed",
    )
    after = _by(
        ring.select("doc_id", "h", F.col("next.doc_id").alias("m_id"), F.col("next.h").alias("m_h"))
        .withColumnsRenamed({"doc_id": "at_id", "h": "at_h", "m_id": "doc_id", "m_h": "h"}),
        signed.groupBy(F.col("doc_id").alias("__id"), F.col("h").alias("__h")).agg(
            F.first("own").alias("following")
        ),
    ).select(F.col("at_id").alias("__id"), F.col("at_h").alias("__h"), "following")
    return _by(signed, after).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        printed("own").alias("fingerprint"),
        printed("changed").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"),
        likeness("own", "following").alias("near_next"),
    )
