"""The tables the registered queries run on, derived from the given ones.

The CASE texts are plain SQL that Spark and DuckDB read alike, so both sides of a check start
from the same rows. The supplied prose holds none of the marker phrases, so a phrase is put in
front of each text; the texts themselves stay whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEEDED_TEXT = """
CASE doc_id % 13
  WHEN 0 THEN 'It is unclear, but ' || text
  WHEN 1 THEN 'Because of this, therefore and thus ' || text
  WHEN 2 THEN 'First, because it is so; second, thus ' || text
  WHEN 3 THEN 'Certainly, please see ' || text
  WHEN 4 THEN 'Obviously you are wrong. ' || text
  WHEN 5 THEN 'Thank you. To the best of my knowledge ' || text
  WHEN 6 THEN 'As an AI model I cannot fulfill this. ' || text
  WHEN 7 THEN 'Éso ésince ' || text
  WHEN 8 THEN 'PRECISELY: I don''t know. ' || text
  WHEN 9 THEN repeat('word ', 30) || text
  WHEN 10 THEN 'However, it is documented; I can help. ' || text
  ELSE text END"""

MODEL_NAMES = """
CASE {id} % 7
  WHEN 0 THEN 'gpt-4'
  WHEN 1 THEN 'gpt-4-turbo'
  WHEN 2 THEN 'gpt-3.5-turbo-0125'
  WHEN 3 THEN 'claude-3-sonnet'
  WHEN 4 THEN 'Claude-3-OPUS'
  WHEN 5 THEN 'claude-3-haiku'
  ELSE 'mystery-model' END"""

# The answers that came back. French ones sit in the other response column.
DOC_RESPONSES = {
    "seq": "doc_id",
    "prompt_id": "'doc_' || CAST(doc_id AS STRING)",
    "prompt": "'Write in <' || lang || '> & cite \"' || source || '\"'",
    "model_response": f"CASE WHEN lang = 'fr' THEN {SEEDED_TEXT} ELSE '' END",
    "response": f"CASE WHEN lang = 'fr' THEN NULL ELSE {SEEDED_TEXT} END",
    "model": MODEL_NAMES.format(id="doc_id"),
    "status": "'success'",
    "prompt_tokens": "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 20 + doc_id % 100 END",
    "response_tokens": "CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(n_chars AS DOUBLE) / 4 END",
}
# The requests that failed have no text.
FAILED_RESPONSES = {
    "seq": "1000000000000 + event_id",
    "prompt_id": "'evt_' || CAST(event_id AS STRING)",
    "prompt": "'Handle ' || props",
    "model_response": "''",
    "response": "CASE WHEN user_id % 2 = 0 THEN '' ELSE '   ' END",
    "model": MODEL_NAMES.format(id="event_id"),
    "status": "'error'",
    "prompt_tokens": "CAST(NULL AS BIGINT)",
    "response_tokens": "CAST(NULL AS DOUBLE)",
}
PAGE_RESPONSES = {
    "seq": "page_id",
    "prompt_id": "url",
    "prompt_text": "html",
    "response": "html",
    "model": "'<' || " + MODEL_NAMES.format(id="page_id") + " || '>'",
}
USAGE = {
    "run": "event_type",
    "event_id": "event_id",
    "ts": "ts",
    "model": MODEL_NAMES.format(id="event_id"),
    "input_tokens": "CAST(floor(value * 100) AS BIGINT)",
    "output_tokens": "CAST(floor(value * 50) AS BIGINT)",
}
# The cost of a request, where it is known; not known for stretches of requests.
KNOWN_COST = "CASE WHEN event_id % 1000 < 60 THEN NULL ELSE cost END"
FAILURES = {
    "prompt_id": "'evt_' || CAST(event_id AS STRING)",
    "error_type": """
CASE event_id % 6
  WHEN 0 THEN 'AuthenticationError'
  WHEN 1 THEN 'TimeoutError'
  WHEN 2 THEN 'RateLimitError'
  WHEN 3 THEN 'ConnectionError'
  WHEN 4 THEN 'ValueError'
  ELSE 'KeyError' END""",
}
JUDGE_TEXTS = {
    "event_id": "event_id",
    "response": """
CASE event_id % 6
  WHEN 0 THEN props
  WHEN 1 THEN 'Verdict: ```json ' || props || ' ``` and 3 more'
  WHEN 2 THEN 'Between -.5 and ' || CAST(CAST(floor(value) AS BIGINT) AS STRING)
  WHEN 3 THEN 'no verdict on ' || event_type
  WHEN 4 THEN props || ' trailing 12'
  ELSE '' END""",
}
# Raw results: the id is a digest of the text, so copies of a text share it.
RAW_RESULTS = {
    "doc_id": "doc_id",
    "prompt_id": "md5(text)",
    "prompt": "CASE WHEN source = 'src3' THEN NULL ELSE source END",
    "response": "CASE WHEN lang = 'es' THEN NULL ELSE text END",
    "timestamp": """
CASE WHEN lang = 'de' THEN 'not a date'
  ELSE '2024-01-' || lpad(CAST(1 + doc_id % 28 AS STRING), 2, '0') || ' 10:30:00' END""",
}
# A scored table with everything wrong that cleaning repairs; copies of a text give equal rows
# but for the spaces around the id.
DIRTY_SCORES = {
    "prompt_id": "CASE WHEN doc_id % 2 = 0 THEN '  ' || md5(text) || ' ' ELSE md5(text) END",
    "response": "text",
    "overall_score": "CAST(n_chars % 70 AS DOUBLE) / 10 - 5e-1",
    "score_accuracy": "CAST(n_chars % 13 AS DOUBLE) / 2 - 5e-1",
    "score_tone": "CASE WHEN n_chars % 5 = 0 THEN NULL ELSE CAST(n_chars % 6 AS DOUBLE) END",
    "score_flat": "1e0",
    "grade": """
CASE n_chars % 9
  WHEN 0 THEN NULL WHEN 1 THEN 'x' WHEN 2 THEN ' b ' WHEN 3 THEN 'A' WHEN 4 THEN 'c'
  WHEN 5 THEN 'D' WHEN 6 THEN 'F'
  ELSE CASE WHEN n_chars % 70 >= 50 THEN 'A' WHEN n_chars % 70 >= 40 THEN 'B'
    WHEN n_chars % 70 >= 30 THEN 'C' WHEN n_chars % 70 >= 20 THEN 'D' ELSE 'F' END END""",
}
PROMPTS = {
    "doc_id": "doc_id",
    "id": """
CASE WHEN source = 'src1' THEN NULL WHEN lang = 'fr' THEN 'fr:' || md5(text)
  ELSE md5(text) END""",
    "category": "CASE WHEN lang = 'de' THEN NULL ELSE lang END",
    "difficulty": "CASE WHEN source = 'src2' THEN 'extreme' WHEN n_chars > 2000 THEN 'hard' END",
    "text": "CASE WHEN source = 'src3' THEN NULL ELSE text END",
}
# Scores of a later run: answers from some sources got worse, tone of some got better.
LATER_RUN = {
    "overall_score": """
CASE WHEN lang = 'en' THEN greatest(overall_score - 1e0, 0e0) ELSE overall_score END""",
    "score_accuracy": "CASE WHEN lang = 'fr' THEN score_accuracy * 95e-2 ELSE score_accuracy END",
    "score_reasoning": "greatest(score_reasoning - 2e-1, 0e0)",
    "score_tone": "least(score_tone + 2e-1, 1e0)",
    "score_completeness": "score_completeness",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def load_stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The table, a file or a folder of files, as a stream."""
    files = load(spark, sf_dir, table)
    # A file source takes a folder or a pattern, so the name is written as a pattern.
    return spark.readStream.schema(files.schema).parquet(f"{sf_dir}/{table}{{.parquet}}")


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.select(*[F.expr(sql).alias(name) for name, sql in columns.items()])


def doc_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(load(spark, sf_dir, "documents"), DOC_RESPONSES)


def failed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = load(spark, sf_dir, "events").filter("event_type = 'error'")
    return derive(errors, FAILED_RESPONSES)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_responses(spark, sf_dir).unionByName(failed_responses(spark, sf_dir))


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(load(spark, sf_dir, "events"), USAGE)
