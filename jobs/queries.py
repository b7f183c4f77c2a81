"""The jobs as registered queries, each run twice into a new folder, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import passage_index, review_queue
from jobs.common import settings
from quillspark.plans import oracles as O
from quillspark.plans import recipes as R
from quillspark.shared import new_folder


def job1_passage_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over ``documents``; the second run finds nothing new."""
    folder = new_folder(spark, "job1")
    for _ in range(2):
        passage_index.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", f"{folder}/checkpoint")
    return passage_index.index(spark, f"{folder}/index")


#: How ``events`` is read as checks and as overrides.
EVENTS = {"checks": R.CHECK | {"seq": "event_id"}, "overrides": R.OVERRIDE}


def job2_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over ``events``, as checks and as overrides; the second run finds nothing above the mark."""
    folder, events = new_folder(spark, "job2"), f"{sf_dir}/events.parquet"
    own = settings(review_queue.NAME)
    config = own | {k: {name: EVENTS[k][name] for name in own[k]} for k in EVENTS}
    for _ in range(2):
        review_queue.run(spark, events, events, f"{folder}/queue", f"{folder}/mark", config)
    return review_queue.queue(spark, f"{folder}/queue")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_passage_index": job1_passage_index, "job2_review_queue": job2_review_queue}

_STATUS = "coalesce(f.human_override, CASE WHEN c.status = 'unchecked' THEN NULL ELSE c.status END, 'unchecked')"
ORACLES: dict[str, str] = {
    "job1_passage_index": """
WITH d AS (SELECT doc_id, lang, source, sha256(coalesce(text, '')) AS text_sha256, any_value(text) AS text FROM documents GROUP BY ALL),
p AS (SELECT *, unnest(CASE WHEN coalesce(length(text), 0) = 0 THEN [NULL] ELSE range(0, length(text), 1350) END) AS begins FROM d)
SELECT doc_id, lang, source, text_sha256, CAST(begins // 1350 AS BIGINT) AS chunk_ord, substr(text, begins + 1, 1500) AS chunk, CAST(coalesce(length(substr(text, begins + 1, 1500)), 0) AS BIGINT) AS n_chars FROM p
""",
    "job2_review_queue": f"""
WITH {O.CHECK_ROWS}, {O.OVERRIDE_ROWS}, ids AS (SELECT DISTINCT check_id FROM ov),
f AS (SELECT check_id, {O.folded(f'CASE WHEN {O.SETS} THEN verdict END', f'(clear OR {O.SETS})')} AS human_override, coalesce({O.folded('coalesce(reviewed, true)', f'(reviewed IS NOT NULL OR {O.SETS})')}, false) AS reviewed, {O.folded("coalesce(note, '')", 'true')} AS note FROM ids),
r AS (SELECT c.manuscript, c.check_id, {_STATUS} AS status, coalesce(f.reviewed, c.reviewed) AS reviewed, f.human_override, coalesce(f.note, c.note) AS note, c.section, c.claim, c.ref_key FROM chks c LEFT JOIN f ON f.check_id = c.check_id),
s AS (SELECT *, CAST({O.rank('status')} AS BIGINT) AS rank, status IN {O.among(O.audit.PROBLEMS)} AS is_problem FROM r)
SELECT manuscript, check_id, status, rank, is_problem, reviewed, human_override, note, section, claim, ref_key, count(*) FILTER (WHERE is_problem AND NOT reviewed) OVER (PARTITION BY manuscript) AS open_problems FROM s
""",
}
