"""Names, texts and limits that other tools and stored data rely on."""

# -- Fixed values: candidate file columns, in their documented order ----------------
REQUIRED_COLUMNS = ("candidate_id",)
OPTIONAL_COLUMNS = (
    "name",
    "headline",
    "location",
    "current_title",
    "current_company",
    "years_experience",
    "top_skills",
    "education",
    "applied_at",
    "source_url",
)
KNOWN_COLUMNS = REQUIRED_COLUMNS + OPTIONAL_COLUMNS

# -- Fixed values: candidate statuses ------------------------------------------------
STATUSES = (
    "discovered",
    "ok",
    "no_resume",
    "knocked_out",
    "scored",
    "failed_scrape",
    "failed_parse",
    "failed_score",
    "unparseable",
)
FAILURE_STATUSES = ("failed_scrape", "failed_parse", "failed_score", "unparseable")

# -- Fixed values: limits --------------------------------------------------------------
MIN_USEFUL_CHARS = 200
MAX_ERROR_CHARS = 2000
MESSAGE_TAIL_CHARS = 1000
PAYLOAD_TAIL_CHARS = 500
RETRY_DELAYS_SECONDS = (2.0, 8.0, 32.0)
DEFAULT_CONCURRENCY = 4
DEFAULT_TOP_N = 50
MAX_ANSWER_TOKENS = 2048
LOCAL_TEMPERATURE = 0.1
WEIGHT_TOLERANCE = 0.001

# -- Fixed values: header of the ranked files -----------------------------------------
RANKED_COLUMNS = (
    "rank",
    "candidate_id",
    "name",
    "headline",
    "location",
    "current_title",
    "current_company",
    "weighted_total",
    "recommend",
    "summary",
    "profile_url",
)

# -- Fixed values: characters that count as white space in a text strip ------------------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# -- Fixed values: words a lenient reader takes as booleans -------------------------------
TRUE_WORDS = ("1", "on", "t", "true", "y", "yes")
FALSE_WORDS = ("0", "off", "f", "false", "n", "no")

# -- Fixed values: texts of a scoring request -----------------------------------------------
SYSTEM_PROMPT = (
    "You are an expert technical recruiter scoring software engineering candidates "
    "against a fixed rubric. You read the candidate's resume + scraped LinkedIn "
    "metadata and produce a structured assessment. Be specific and evidence-based: "
    "if the resume does not contain evidence for a criterion, score conservatively "
    "and say so in the reasoning. Reasoning fields must be at most 2 short lines."
)
FULL_TOOL = "record_candidate_score"
FULL_TOOL_DESCRIPTION = "Record the structured scoring result for a single candidate."
KNOCKOUT_TOOL = "record_knockout_check"
KNOCKOUT_TOOL_DESCRIPTION = (
    "Record only the knockout-criteria evaluation for a single candidate."
)
JOB_HEADING = "--- JOB DESCRIPTION ---"
RUBRIC_HEADING = "--- RUBRIC ---"
METADATA_HEADING = "--- PROFILE METADATA ---"
TEXT_HEADING = "--- RESUME TEXT ---"
CANDIDATE_HEADING = "--- CANDIDATE ---"
TASK_HEADING = "--- TASK ---"
KNOCKOUTS_HEADING = "KNOCKOUTS (any failure ⇒ recommend=false):"
CRITERIA_HEADING = "CRITERIA (score each 0–10):"
LOCAL_TASK = (
    "Assess this candidate and return the result as a single JSON object. "
    "Populate every field with your assessment; do not restate the schema."
)
COMMAND_TASK = (
    "Respond with a single JSON object conforming exactly to the provided schema. "
    "Do not include any prose, markdown, or commentary outside the JSON object."
)
