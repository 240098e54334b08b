"""Spark types of the stored relations."""

from pyspark.sql import types as T

from candrank.constants import RANKED_COLUMNS

KEY = ("role", "candidate_id")

_s, _t, _d, _b, _i = (
    T.StringType(),
    T.TimestampType(),
    T.DoubleType(),
    T.BooleanType(),
    T.IntegerType(),
)


def _struct(*fields):
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


def state_schema(seq_type: T.DataType) -> T.StructType:
    """Candidate state: one row per key. ``ingest_seq`` orders rows by first arrival."""
    return _struct(
        ("role", _s),
        ("candidate_id", _s),
        ("applicant_url", _s),
        ("current_title", _s),
        ("current_company", _s),
        ("profile_scraped_at", _t),
        ("resume_downloaded_at", _t),
        ("resume_parsed_at", _t),
        ("score_stage1_at", _t),
        ("score_stage2_at", _t),
        ("status", _s),
        ("last_error", _s),
        ("created_at", _t),
        ("updated_at", _t),
        ("ingest_seq", seq_type),
    )


STATE_COLUMNS = tuple(state_schema(T.LongType()).names)

KNOCKOUT_ITEM = _struct(("id", _s), ("description", _s))
CRITERION_ITEM = _struct(("id", _s), ("weight", _d), ("description", _s))
# ``role`` is the key, ``title`` the role's name as the rubric states it.
RUBRIC = _struct(
    ("role", _s),
    ("title", _s),
    ("version", _i),
    ("knockouts", T.ArrayType(KNOCKOUT_ITEM)),
    ("criteria", T.ArrayType(CRITERION_ITEM)),
)

ATTEMPT = _struct(
    ("role", _s),
    ("candidate_id", _s),
    ("attempt", _i),
    ("raw", _s),
    ("error", _s),
    ("answered_at", _t),
)

PAGES = _struct(
    ("role", _s),
    ("candidate_id", _s),
    ("text", _s),
    ("extractor", _s),
    ("error", _s),
)

# The ranked files as they are read back: all text, ``role`` from the folder.
RANKED_SCHEMA = _struct(*[(c, _s) for c in RANKED_COLUMNS], ("role", _s))
