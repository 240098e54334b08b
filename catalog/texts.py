"""Page assembly, the extraction gate, rubrics and requests."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import (
    DUCK_BLOCK_META,
    DUCK_PREFIX,
    JOBS,
    PEOPLE,
    PEOPLE_COLUMNS,
    duck,
    rubrics,
    select,
    table,
)
from candrank import constants as C
from candrank.functions import text as T
from candrank.operators import extract, requests, rubric
from candrank.plans.scratch import new_path
from candrank.sources.documents import read_documents
from candrank.sources.files import write_files
from candrank.sources.resumes import ResumeScan
from candrank.sources.rubrics import read_job_description
from candrank.sources.store import Store


def page_assembly(spark, sf, block=extract.PAGES_PER_BLOCK):
    """Every turn is a page, followed by an empty one."""
    page = F.col("turn") * 2
    both = F.array(
        F.struct(page.alias("page"), "text"), F.struct((page + 1).alias("page"), F.lit("").alias("text"))
    )
    pages = table(spark, sf, "conversations").select("conv_id", F.inline(both))
    return extract.assemble_pages(pages, ["conv_id"], block)


_FIRST_TIER = """
SELECT doc_id, text, coalesce(html, '') AS second
FROM {documents} LEFT JOIN {pages} ON doc_id = page_id
"""


def tiered_extract(spark, sf):
    text, extractor = extract.tiered_text(F.col("text"), F.col("second"), ("first", "second"))
    return select(spark, sf, _FIRST_TIER).select(
        "doc_id",
        F.md5(text).alias("digest"),
        F.length(text).cast("long").alias("n_chars"),
        extractor.alias("extractor"),
    )


def read_files(spark, sf):
    """The Python reader path: pages between form feeds, errors for toxic documents."""

    def plain(content: bytes) -> list[str]:
        text = content.decode("utf-8")
        if text.startswith("toxic"):
            raise ValueError("cannot decode")
        return text.split("\f")[:1]

    def every(content: bytes) -> list[str]:
        return content.decode("utf-8").split("\f")

    files = spark.sql(
        """SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id,
                  cast((CASE WHEN toxic = 1 THEN 'toxic' ELSE '' END) || text || chr(12) || source AS binary) AS content
           FROM {documents} LEFT JOIN {labels} USING (doc_id)""",
        documents=table(spark, sf, "documents"),
        labels=table(spark, sf, "labels"),
    )
    return extract.read_files(files, [("plain", plain), ("every", every)]).select(
        "role", "candidate_id", F.md5("text").alias("digest"), "extractor", "error"
    )


def _as_files(spark, sf, sql: str, suffix: str, path: str):
    """Write (role, candidate_id, content) as files; the folder of role r0."""
    rows = spark.sql(sql, documents=table(spark, sf, "documents"))
    name = F.concat("candidate_id", F.lit(suffix)).alias("file_name")
    return write_files(rows.select("role", name, "content"), path)


def resume_scan(spark, sf):
    """Two scans of a folder: a third of its files changed between them and a fifth are new."""
    path, store = new_path(spark, "resumes"), Store(spark, new_path(spark, "scans"))
    first = "SELECT 'all' AS role, 'c' || doc_id AS candidate_id, cast(text AS binary) AS content FROM {documents} WHERE doc_id % 5 <> 4"
    later = "SELECT 'all' AS role, 'c' || doc_id AS candidate_id, cast(text || '+' || source AS binary) AS content FROM {documents} WHERE doc_id % 3 = 0 OR doc_id % 5 = 4"
    _as_files(spark, sf, first, ".pdf", path)
    ResumeScan(store, f"{path}/role=all", "all").done()
    _as_files(spark, sf, later, ".pdf", path)
    scan = ResumeScan(store, f"{path}/role=all", "all")
    changes = scan.changes.select("role", "candidate_id", "change")
    digests = scan.resumes.select("role", "candidate_id", F.md5("content").alias("digest"))
    return digests.join(changes, ["role", "candidate_id"]).select("candidate_id", "change", "digest")


def document_files(spark, sf):
    """Every document as a JSON file of its own, read back by name."""
    path = new_path(spark, "score-files")
    sql = """SELECT 'r' || (doc_id % 5) AS role, 'c+' || doc_id || ' x' AS candidate_id,
                    cast(to_json(named_struct('summary', text)) AS binary) AS content FROM {documents}"""
    _as_files(spark, sf, sql, ".json", path)
    roles = [read_documents(spark, f"{path}/role=r{i}", f"r{i}") for i in range(5)]
    every = roles[0]
    for more in roles[1:]:
        every = every.unionByName(more)
    return every.select(
        "role", "candidate_id", F.md5(F.get_json_object("document", "$.summary")).alias("digest")
    )


def job_text(spark, sf):
    """A job text per region, written as a file and read back without white space around it."""
    path = new_path(spark, "jobs")
    rows = spark.sql(
        """SELECT 'r' || r_regionkey AS role, 'job.txt' AS file_name,
                  cast(chr(10) || ' We hire in' || chr(10) || r_name || chr(9) || chr(10) AS binary) AS content
           FROM {region}""",
        region=table(spark, sf, "region"),
    )
    found = write_files(rows, path).collect()
    every = [read_job_description(spark, f"{path}/role={r.role}/{r.file_name}", r.role) for r in found]
    return reduce(DataFrame.unionByName, every)


_PARSE = """
SELECT 'r' || (d.doc_id % 5) AS role, 'c' || d.doc_id AS candidate_id, d.text AS text,
       'first' AS extractor, CASE WHEN l.toxic = 1 THEN d.text END AS error
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id
"""
_PARSE_ALL = _PARSE.replace("JOIN {labels}", "LEFT JOIN {labels}")


def _parse_results(spark, sf, readings):
    return extract.parse_results(select(spark, sf, PEOPLE), select(spark, sf, readings))


def parse_events(spark, sf):
    return extract.parse_events(_parse_results(spark, sf, _PARSE_ALL))


def parse_summary(spark, sf):
    """Readings of the labelled documents; the others are skipped."""
    return extract.parse_summary(_parse_results(spark, sf, _PARSE))


def invalid_utf8_drop(spark, sf):
    """A stray byte after every third text; the others pass unchanged."""
    text = F.col("text").cast("binary")
    broken = F.concat(text, F.unhex(F.lit("FFC3")), F.col("source").cast("binary"))
    data = F.when(F.col("doc_id") % 3 == 0, broken).otherwise(text)
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(T.drop_invalid(data.cast("string"))).alias("digest")
    )


def fence_removal(spark, sf):
    fenced = F.concat(F.lit("```json\n"), "text", F.lit("\n ```\n"))
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(T.strip_fences(fenced)).alias("digest")
    )


def metadata_block(spark, sf):
    return select(spark, sf, PEOPLE).select(
        "role", "candidate_id", requests.metadata_block(PEOPLE_COLUMNS).alias("metadata")
    )


# Every order is a rubric: returned lines are knockouts, the others criteria.
_ORDER_ITEMS = """
SELECT 'o' || l_orderkey AS role,
       CASE WHEN l_returnflag = 'R' THEN 'knockout' ELSE 'criterion' END AS kind,
       'p' || (l_partkey % 40) AS item_id,
       CASE WHEN l_returnflag <> 'R'
            THEN round(l_quantity / sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity END) OVER (PARTITION BY l_orderkey), 3)
                 - CASE WHEN l_orderkey % 10 = 0 THEN 0.1 ELSE 0 END END AS weight
FROM {lineitem}
"""


def rubric_violations(spark, sf):
    items = select(spark, sf, _ORDER_ITEMS).withColumn("weight", F.col("weight").cast("double"))
    return rubric.violations(items)


def rubric_block(spark, sf):
    """One block per order over all its lines, in the order of their numbers."""
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("o"), "l_orderkey").alias("title"),
        F.col("l_linenumber").alias("n"),
        F.col("l_partkey").alias("p"),
        F.col("l_suppkey").alias("s"),
        (F.col("l_quantity") / 64).alias("weight"),
        F.concat(F.lit("p"), "l_partkey").alias("id"),
        F.concat(F.lit("from "), "l_suppkey").alias("description"),
        (F.col("l_returnflag") == "R").alias("ko"),
    )
    every = lines.groupBy("title").agg(
        F.sort_array(F.collect_list(F.struct("n", "p", "s", "weight", "id", "description", "ko"))).alias("i")
    )
    block = rubric.rubric_block(
        F.col("title"),
        F.filter("i", lambda i: i["ko"]),
        F.filter("i", lambda i: ~i["ko"]),
    )
    return every.select("title", block.alias("block"))


_TEXTS = "SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id, text FROM {documents}"


def _queued_requests(spark, sf, texts_sql):
    people = select(spark, sf, PEOPLE)
    texts = select(spark, sf, texts_sql)
    blocks = requests.candidate_blocks(people, texts, people, PEOPLE_COLUMNS)
    prefixes = requests.role_prefixes(rubrics(spark, sf), select(spark, sf, JOBS))
    return blocks, prefixes


def prompt_build(spark, sf):
    """Prefix and block of every candidate; a candidate without text is to be skipped."""
    blocks, prefixes = _queued_requests(spark, sf, f"{_TEXTS} JOIN {{labels}} USING (doc_id)")
    prompt = F.concat("prefix", F.lit("\n\n"), "block")
    return requests.with_prefix(blocks, prefixes).select(
        "role",
        "candidate_id",
        F.md5(prompt).alias("digest"),
        F.coalesce(F.length(prompt), F.lit(0)).cast("long").alias("n_chars"),
        F.col("block").isNull().alias("skipped"),
    )


_PROMPT_PATH = {
    "tool_block": "$.messages[0].content[1].text",
    "chat_completion": "$.messages[1].content",
    "local_chat": "$.messages[1].content",
    "command": "$.prompt",
}
_SCHEMA_PATH = {
    "tool_block": "$.tools[0].input_schema",
    "chat_completion": "$.response_format.json_schema.schema",
    "local_chat": "$.format",
    "command": "$.json_schema",
}


def request(layout, spark, sf):
    """Request bodies, read back as JSON: user text, model and the schema's id lists."""
    blocks, prefixes = _queued_requests(spark, sf, _TEXTS)
    ready = requests.with_prefix(blocks.filter(F.col("block").isNotNull()), prefixes)
    body = ready.withColumn("body", requests.request_json(layout, "m1")).withColumn(
        "v", F.parse_json("body")
    )
    schema = _SCHEMA_PATH[layout]
    ids = F.variant_get("v", f"{schema}.properties.criteria.items.properties.id.enum", "array<string>")
    knockouts = F.variant_get("v", f"{schema}.properties.knockouts.maxItems", "bigint")
    return body.select(
        "role",
        "candidate_id",
        F.md5(F.variant_get("v", _PROMPT_PATH[layout], "string")).alias("digest"),
        F.variant_get("v", "$.model", "string").alias("model"),
        F.array_join(ids, ",").alias("criterion_ids"),
        knockouts.alias("knockouts"),
    )


_BLOCKS = duck(f"""
WITH {DUCK_PREFIX.strip()},
people AS ({PEOPLE}),
blocks AS (
  SELECT p.role, p.candidate_id,
         'CANDIDATE_ID: ' || p.candidate_id || chr(10) || '--- PROFILE METADATA ---' || chr(10)
         || {DUCK_BLOCK_META} || chr(10) || '--- RESUME TEXT ---' || chr(10) || d.text || chr(10) AS block
  FROM people p LEFT JOIN documents d ON p.ingest_seq = d.doc_id)
""")
_LABELLED_BLOCKS = _BLOCKS.replace("LEFT JOIN documents d", "LEFT JOIN (documents JOIN labels USING (doc_id)) d")


def _request_sql(prompt: str) -> str:
    return f"""{_BLOCKS}
    SELECT b.role, candidate_id, md5({prompt}) AS digest, 'm1' AS model,
           (SELECT string_agg(id, ',' ORDER BY nth) FROM items WHERE items.role = b.role) AS criterion_ids,
           cast(2 AS bigint) AS knockouts
    FROM blocks b JOIN prefixes USING (role) WHERE block IS NOT NULL"""


_NL = "chr(10)"
_PROMPTS = {
    "tool_block": "block",
    "chat_completion": f"prefix || {_NL} || {_NL} || block",
    "local_chat": f"prefix || {_NL} || {_NL} || '{C.CANDIDATE_HEADING}' || {_NL} || block || {_NL} || {_NL}"
    f" || '{C.TASK_HEADING}' || {_NL} || '{C.LOCAL_TASK}'",
    "command": f"prefix || {_NL} || {_NL} || '{C.CANDIDATE_HEADING}' || {_NL} || block || {_NL} || {_NL}"
    f" || '{C.COMMAND_TASK}'",
}

_RESULTS = """
results AS (
  SELECT p.role, p.candidate_id, r.error,
         CASE WHEN r.role IS NULL THEN 'skipped' WHEN r.error IS NOT NULL THEN 'failed'
              WHEN length(r.text) < 200 THEN 'unparseable' ELSE 'parsed' END AS outcome
  FROM people p LEFT JOIN reading r USING (role, candidate_id))
"""
_PARSED = duck(f"WITH people AS ({PEOPLE}), reading AS ({_PARSE}), {_RESULTS}")
_PARSED_ALL = duck(f"WITH people AS ({PEOPLE}), reading AS ({_PARSE_ALL}), {_RESULTS}")

QUERIES = {
    "page_assembly": (
        page_assembly,
        """SELECT conv_id, trim(coalesce(string_agg(text, chr(10) ORDER BY turn)
             FILTER (text <> ''), ''), chr(10) || ' ') AS text
           FROM conversations GROUP BY conv_id""",
    ),
    "page_assembly_blocks": (
        partial(page_assembly, block=3),
        """SELECT conv_id, trim(coalesce(string_agg(text, chr(10) ORDER BY turn)
             FILTER (text <> ''), ''), chr(10) || ' ') AS text
           FROM conversations GROUP BY conv_id""",
    ),
    "tiered_extract": (
        tiered_extract,
        duck(f"""WITH t AS ({_FIRST_TIER}),
        u AS (SELECT doc_id, CASE WHEN length(text) >= 200 THEN text ELSE second END AS chosen,
                     CASE WHEN length(text) >= 200 THEN 'first' ELSE 'second' END AS extractor FROM t)
        SELECT doc_id, md5(chosen) AS digest, length(chosen) AS n_chars, extractor FROM u"""),
    ),
    "read_files": (
        read_files,
        """WITH t AS (
          SELECT doc_id, coalesce(toxic, 0) AS bad, trim(text, chr(9) || chr(10) || ' ') AS one,
                 trim(text || chr(10) || source, chr(9) || chr(10) || ' ') AS two
          FROM documents LEFT JOIN labels USING (doc_id))
        SELECT 'r' || (doc_id % 5) AS role, 'c' || doc_id AS candidate_id,
               CASE WHEN bad = 0 THEN md5(CASE WHEN length(one) >= 200 THEN one ELSE two END) END AS digest,
               CASE WHEN bad = 0 THEN CASE WHEN length(one) >= 200 THEN 'plain' ELSE 'every' END END AS extractor,
               CASE WHEN bad = 1 THEN 'cannot decode' END AS error
        FROM t""",
    ),
    "resume_scan": (
        resume_scan,
        """SELECT 'c' || doc_id AS candidate_id,
           CASE WHEN doc_id % 5 = 4 THEN 'new' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'same' END AS change,
           CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 4 THEN md5(text || '+' || source) END AS digest FROM documents""",
    ),
    "document_files": (
        document_files,
        """SELECT 'r' || (doc_id % 5) AS role, 'c+' || doc_id || ' x' AS candidate_id, md5(text) AS digest FROM documents""",
    ),
    "job_text": (
        job_text,
        """SELECT 'r' || r_regionkey AS role,
           'We hire in' || chr(10) || r_name AS job_text FROM region""",
    ),
    "parse_events": (
        parse_events,
        _PARSED_ALL
        + """SELECT role, candidate_id, outcome AS event,
               CASE WHEN outcome = 'failed' THEN 'failed_parse' END AS failure_status,
               CASE WHEN outcome = 'failed' THEN left(error, 2000) END AS error
             FROM results WHERE outcome <> 'skipped'""",
    ),
    "parse_summary": (
        parse_summary,
        _PARSED
        + "SELECT role, "
        + ", ".join(
            f"count(*) FILTER (outcome = '{o}') AS {o}"
            for o in ("parsed", "unparseable", "failed", "skipped")
        )
        + " FROM results GROUP BY role",
    ),
    "invalid_utf8_drop": (
        invalid_utf8_drop,
        """SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN text || source ELSE text END) AS digest
           FROM documents""",
    ),
    "fence_removal": (
        fence_removal,
        """SELECT doc_id, md5(trim(text, chr(9) || chr(10) || ' ')) AS digest FROM documents""",
    ),
    "metadata_block": (
        metadata_block,
        duck(f"WITH p AS ({PEOPLE}) SELECT role, candidate_id, {DUCK_BLOCK_META} AS metadata FROM p"),
    ),
    "rubric_violations": (
        rubric_violations,
        duck(f"""WITH items AS ({_ORDER_ITEMS}),
        ids AS (SELECT role, kind, item_id, count(*) AS n, sum(cast(weight AS decimal(18, 9))) AS w,
                       count(*) FILTER (kind = 'criterion' AND NOT (weight > 0 AND weight <= 1)) AS out
                FROM items GROUP BY ALL),
        roles AS (SELECT role, coalesce(sum(w), 0) AS total, sum(out) AS out,
                         count(*) FILTER (kind = 'criterion' AND n > 1) AS c2,
                         count(*) FILTER (kind = 'knockout' AND n > 1) AS k2
                  FROM ids GROUP BY role)
        SELECT role, 'weight_sum' AS problem, printf('%.3f', cast(total AS double)) AS detail
          FROM roles WHERE abs(total - 1) > 0.001
        UNION ALL SELECT role, 'weight_out_of_range', cast(out AS varchar) FROM roles WHERE out > 0
        UNION ALL SELECT role, 'criterion_id_repeated', cast(c2 AS varchar) FROM roles WHERE c2 > 0
        UNION ALL SELECT role, 'knockout_id_repeated', cast(k2 AS varchar) FROM roles WHERE k2 > 0"""),
    ),
    "rubric_block": (
        rubric_block,
        f"""WITH l AS (
          SELECT 'o' || l_orderkey AS title, l_linenumber AS n, l_partkey AS p, l_suppkey AS s,
                 l_quantity / 64 AS weight, 'p' || l_partkey AS id, 'from ' || l_suppkey AS about,
                 l_returnflag = 'R' AS ko
          FROM lineitem)
        SELECT title,
          'ROLE: ' || title || chr(10) || chr(10) || '{C.KNOCKOUTS_HEADING}' || chr(10)
          || coalesce(string_agg('  - ' || id || ': ' || about || chr(10), '' ORDER BY n, p, s, weight) FILTER (ko), '')
          || chr(10) || '{C.CRITERIA_HEADING}'
          || coalesce(string_agg(chr(10) || '  - ' || id || ' (weight ' || printf('%.2f', weight) || '): ' || about,
                                 '' ORDER BY n, p, s, weight) FILTER (NOT ko), '') AS block
        FROM l GROUP BY title""",
    ),
    "prompt_build": (
        prompt_build,
        f"""{_LABELLED_BLOCKS}
        SELECT role, candidate_id, md5(prefix || chr(10) || chr(10) || block) AS digest,
               coalesce(length(prefix || chr(10) || chr(10) || block), 0) AS n_chars, block IS NULL AS skipped
        FROM blocks JOIN prefixes USING (role)""",
    ),
    **{
        f"request_{layout}": (partial(request, layout), _request_sql(prompt))
        for layout, prompt in _PROMPTS.items()
    },
}
