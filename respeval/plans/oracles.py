"""For each registered query, the same result in DuckDB SQL over the given tables."""

from __future__ import annotations

from respeval.functions import text as tx
from respeval.functions.cost import NAME_FRAGMENTS, PRICES
from respeval.functions.defects import HEDGES, REFUSALS
from respeval.functions.scores import DEFAULT_WEIGHTS, GRADES
from respeval.plans import catalog
from respeval.plans import relations as rel

def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _select(columns: dict[str, str], table: str, where: str = "") -> str:
    items = ", ".join(f"{sql} AS {name}" for name, sql in columns.items())
    return f"SELECT {items} FROM {table} {where}"


_SPACES = (
    r"[\t\n\x0b\f\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
)
# RE2 has no Unicode word boundary, so letters with accents become plain ones first.
_ASCII_LETTERS = "regexp_replace(r, '[À-ÖØ-öø-ɏ]', 'x', 'g')"


def _phrase_pattern(phrases: tuple[str, ...]) -> str:
    return _quote(r"(?i)\b(?:" + "|".join(phrases) + r")\b")


def _has(phrases: tuple[str, ...]) -> str:
    return f"regexp_matches(plain, {_phrase_pattern(phrases)})"


def _any_substring(phrases: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(low, {_quote(p)})" for p in phrases) + ")"


RESPONSES = f"""
responses AS (
  {_select(rel.DOC_RESPONSES, "documents")}
  UNION ALL
  {_select(rel.FAILED_RESPONSES, "events", "WHERE event_type = 'error'")}
)"""

_PUNCTUATION = _quote(tx.WORD_PUNCTUATION)


def _features(source: str) -> str:
    return f"""
texts AS (SELECT *, coalesce(nullif(model_response, ''), response, '') AS r FROM {source}),
split_texts AS (
  SELECT *, lower(r) AS low, {_ASCII_LETTERS} AS plain,
    list_filter(regexp_split_to_array(lower(r), '{_SPACES}'), lambda w: w <> '') AS words
  FROM texts
),
features AS (
  SELECT *, len(words) AS n_words,
    len(regexp_extract_all(plain, {_phrase_pattern(tx.LOGICAL)})) AS logical_count,
    {_has(tx.POSITIVE)} AS positive, {_has(tx.NEGATIVE)} AS negative,
    {_has(tx.POLITE)} AS polite, {_has(tx.UNCERTAIN)} AS uncertain,
    {_has(tx.ACCURACY_BONUS)} AS bonus,
    regexp_matches(r, '(?i)\\pN\\)|first|second|•|-') AS listed,
    len(list_distinct(list_transform(words, lambda w: trim(w, {_PUNCTUATION}))))
      / nullif(len(words), 0)::DOUBLE AS unique_word_ratio,
    {_any_substring(REFUSALS)} AS refusal, {_any_substring(HEDGES)} AS hedge
  FROM split_texts
),
heuristics AS (
  SELECT *,
    CASE WHEN n_words = 0 THEN 1 WHEN uncertain THEN 2
      ELSE 3 + (n_words > 20)::INT + bonus::INT END AS h_accuracy,
    CASE WHEN n_words = 0 THEN 1
      ELSE 3 + (logical_count >= 2)::INT - (logical_count = 0)::INT + listed::INT
      END AS h_reasoning,
    CASE WHEN n_words = 0 THEN 1 ELSE 3 + positive::INT - negative::INT + polite::INT
      END AS h_tone,
    CASE WHEN n_words = 0 THEN 1
      ELSE least(5, CASE WHEN n_words < 10 THEN 2 WHEN n_words < 30 THEN 3
        WHEN n_words < 100 THEN 4 ELSE 5 END + listed::INT) END AS h_completeness
  FROM features
)"""


def _grade(score: str) -> str:
    return (
        f"CASE WHEN {score} IS NULL THEN 'F' WHEN {score} >= 45e-1 THEN 'A' "
        f"WHEN {score} >= 35e-1 THEN 'B' WHEN {score} >= 25e-1 THEN 'C' "
        f"WHEN {score} >= 15e-1 THEN 'D' ELSE 'F' END"
    )


_DIMENSIONS = list(DEFAULT_WEIGHTS)
_NORMS = ", ".join(f"h_{d}::DOUBLE / 5 AS score_{d}" for d in _DIMENSIONS)
_WEIGHTED = " + ".join(f"score_{d} * {w}::DOUBLE" for d, w in DEFAULT_WEIGHTS.items())
_FIVES = ", ".join(f"score_{d} * 5 AS {d}" for d in _DIMENSIONS)


def _codes(scores: dict[str, str]) -> str:
    low = {"reasoning": "D01", "accuracy": "D02", "tone": "D03", "completeness": "D04"}
    codes = [f"CASE WHEN {scores[d]} <= 2 THEN '{c}' END" for d, c in low.items()]
    codes.append("CASE WHEN n_words > 20 AND unique_word_ratio < 5e-1 THEN 'D05' END")
    codes.append("CASE WHEN refusal THEN 'D06' END")
    codes.append("CASE WHEN hedge THEN 'D07' END")
    return f"array_to_string(list_filter([{', '.join(codes)}], lambda c: c IS NOT NULL), ',')"


def _scored(source: str) -> str:
    return f"""{_features(source)},
norms AS (SELECT *, {_NORMS} FROM heuristics),
sums AS (
  SELECT *, greatest(0e0, least(1e0, ({_WEIGHTED}) / {sum(DEFAULT_WEIGHTS.values())}::DOUBLE))
    AS aggregated_score, {_FIVES} FROM norms
),
scored AS (
  SELECT *, aggregated_score * 5 AS overall_score,
    {_codes({d: d for d in _DIMENSIONS})} AS defects,
    {_grade("aggregated_score * 5")} AS grade
  FROM sums
)"""


WITH_FEATURES = f"WITH {RESPONSES}, {_features('responses')}"
WITH_SCORES = f"WITH {RESPONSES}, {_scored('responses')}"

_PAGES = rel.PAGE_RESPONSES | {"model_response": "''"}
WITH_PAGE_SCORES = f"WITH pages_in AS ({_select(_PAGES, 'pages')}), {_scored('pages_in')}"


def _first_non_empty(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({n}, '')" for n in names) + ", '')"


def _scored_view(source: str) -> str:
    columns = ["prompt_id", "prompt AS prompt_text", "model", "status"]
    columns += [f"round({c}, 6) AS {c}" for c in ("aggregated_score", "overall_score")]
    for d in _DIMENSIONS:
        columns.append(f"round(score_{d}, 6) AS score_{d}")
        columns.append(f"round(score_{d}, 6) AS score_{d}_raw")
        columns.append(f"round({d}, 6) AS {d}")
        columns.append(f"round({d}, 6) AS {d}_score")
    columns.append(
        "CASE WHEN r = '' THEN 'no response_text' ELSE 'using heuristic for rule: None' END "
        "AS score_accuracy_notes"
    )
    columns.append("defects")
    return f"SELECT {', '.join(columns)} FROM {source}"


def _rule(raw: str, note: str) -> str:
    """A one-criterion rubric whose key has no heuristic."""
    return f"""{WITH_FEATURES}
SELECT prompt_id,
  round(CASE WHEN r = '' THEN 0e0 ELSE {raw} END, 6) AS score_check,
  round(CASE WHEN r = '' THEN NULL ELSE {raw} END, 6) AS score_check_raw,
  CASE WHEN r = '' THEN 'no response_text' ELSE {note} END AS score_check_notes
FROM features"""


_TERMS = "(" + " + ".join(
    f"contains(low, {_quote(t.lower())})::INT" for t in catalog.RULE_TERMS
) + ")"
_ENTITY = f"contains(low, {_quote(catalog.RULE_ENTITY.lower())})"


def _normalized(value: str, scaled: str | None = None) -> str:
    known = scaled or (
        f"CASE WHEN {value} < 0 THEN 0e0 WHEN {value} <= 1 THEN {value} "
        f"WHEN {value} <= 5 THEN {value} / 5 WHEN {value} <= 10 THEN {value} / 10 "
        f"WHEN {value} <= 100 THEN {value} / 100 ELSE 1e0 END"
    )
    missing = f"{value} IS NULL OR isnan({value}) OR isinf({value})"
    return f"CASE WHEN {missing} THEN 0e0 ELSE {known} END"


_PRICE_KEY = (
    "CASE "
    + " ".join(f"WHEN contains(lower(model), '{f}') THEN '{k}'" for f, k in NAME_FRAGMENTS)
    + " ELSE model END"
)
_PRICE_LIST = "prices(price_key, p_in, p_out) AS (VALUES " + ", ".join(
    f"('{k}', {i}::DOUBLE, {o}::DOUBLE)" for k, (i, o) in PRICES.items()
) + ")"
_COST = (
    "(input_tokens / 1e6) * coalesce(p_in, 3e1) + (output_tokens / 1e6) * coalesce(p_out, 6e1)"
)


def _binary_round(value: str, places: int) -> str:
    """Round by the exact binary value, ties to even, through an error-free product."""
    power = 10.0**places
    split = 134217729.0 * power
    p_high = split - (split - power)
    p_low = power - p_high
    return f"""(SELECT CASE
      WHEN product - floor(product) > 5e-1
        OR (product - floor(product) = 5e-1 AND error > 0)
        OR (product - floor(product) = 5e-1 AND error = 0 AND floor(product)::BIGINT % 2 = 1)
      THEN (floor(product) + 1) / {power!r}::DOUBLE ELSE floor(product) / {power!r}::DOUBLE END
    FROM (SELECT product, ((high * {p_high!r}::DOUBLE - product) + high * {p_low!r}::DOUBLE
        + low * {p_high!r}::DOUBLE) + low * {p_low!r}::DOUBLE AS error
      FROM (SELECT v * {power!r}::DOUBLE AS product, big - (big - v) AS high,
          v - (big - (big - v)) AS low
        FROM (SELECT v, 134217729e0 * v AS big FROM (SELECT ({value})::DOUBLE AS v)))))"""


_ROW_TOKENS = f"""tokens AS (
  SELECT *,
    CASE WHEN prompt_tokens IS NULL THEN length({_first_non_empty("prompt")}) // 4
      ELSE prompt_tokens END AS input_tokens,
    CASE WHEN response_tokens IS NULL THEN length(coalesce(response, '')) // 4
      ELSE trunc(response_tokens)::BIGINT END AS output_tokens,
    {_PRICE_KEY} AS price_key
  FROM %s
),
{_PRICE_LIST},
priced AS (SELECT tokens.*, {_COST} AS cost FROM tokens LEFT JOIN prices USING (price_key))"""

ROW_COST = f"""WITH {RESPONSES}, {_ROW_TOKENS % "responses"}
SELECT prompt_id, input_tokens::BIGINT AS input_tokens, output_tokens::BIGINT AS output_tokens,
  round(cost, 8) AS cost
FROM priced"""

WITH_USAGE = f"""WITH usage AS ({_select(rel.USAGE, "events")}),
{_PRICE_LIST},
priced AS (
  SELECT usage.*, {_COST} AS cost
  FROM (SELECT *, {_PRICE_KEY} AS price_key FROM usage) AS usage
  LEFT JOIN prices USING (price_key)
)"""


def _running(partition: str, cost: str = "cost") -> str:
    over = f"OVER ({partition} ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
    return f"""{WITH_USAGE},
running AS (
  SELECT *, sum({cost}) {over} AS cumulative_cost,
    (sum(input_tokens + output_tokens) {over})::BIGINT AS cumulative_tokens
  FROM priced
)"""


_BUDGET = f"{catalog.BUDGET}::DOUBLE"


def _budget_alerts(cost: str) -> str:
    return f"""{_running("PARTITION BY run", cost)},
status AS (
  SELECT *, {_BUDGET} - cumulative_cost AS remaining FROM running
)
SELECT run, event_id,
  CASE WHEN remaining < 0 THEN 'error' ELSE 'warning' END AS alert,
  round(remaining, 8) AS remaining
FROM status WHERE remaining < {_BUDGET} * 2e-1"""


def _histogram(value: str, bins: int) -> str:
    edge = "lo + i * ((hi - lo) / {n}::DOUBLE)".format(n=bins)
    return f"""{WITH_SCORES},
ends AS (
  SELECT min({value}) - CASE WHEN min({value}) = max({value}) THEN 5e-1 ELSE 0e0 END AS lo,
    max({value}) + CASE WHEN min({value}) = max({value}) THEN 5e-1 ELSE 0e0 END AS hi
  FROM scored
),
bins AS (
  SELECT i::INT AS bin, {edge} AS low,
    CASE WHEN i = {bins - 1} THEN hi ELSE {edge.replace("i *", "(i + 1) *")} END AS high
  FROM ends, range({bins}) AS t(i)
)
SELECT bin, round(low, 6) AS low, round(high, 6) AS high,
  (SELECT count(*) FROM scored
   WHERE {value} >= bins.low
     AND ({value} < bins.high OR (bin = {bins - 1} AND {value} <= bins.high))) AS count
FROM bins"""


LINT_CODES = {
    "missing_id": "id IS NULL",
    "missing_category": "category IS NULL",
    "missing_text": "text IS NULL",
    "no_prompt_text": "text IS NULL",
    "bad_id": "NOT regexp_matches(id, '^[A-Za-z0-9_-]+$')",
    "bad_difficulty": "difficulty NOT IN ('easy', 'medium', 'hard')",
    "bad_tags": "lang = 'es'",
    "text_too_short": "length(text) < 10",
    "text_very_short": "length(coalesce(text, '')) < 20",
    "min_tokens_over_max": "n_chars > 5000",
    "duplicate_id": "count(*) OVER (PARTITION BY id) > 1",
}
_LINTED = {k: v.replace("text", "documents.text") for k, v in rel.PROMPTS.items()}
LINT = f"""WITH p AS ({_select(_LINTED | {"lang": "lang", "n_chars": "n_chars"}, "documents")})
SELECT doc_id, array_to_string(list_sort(list_filter([
  {", ".join(f"CASE WHEN {c} THEN '{code}' END" for code, c in LINT_CODES.items())}
], lambda c: c IS NOT NULL)), ',') AS issues
FROM p"""

_RAW = f"WITH t AS ({_select(rel.RAW_RESULTS, 'documents')})"
_DIRTY = f"WITH t AS ({_select(rel.DIRTY_SCORES, 'documents')})"


def _issues(table: str, checks: list[tuple[str, str, str]], nulls: list[str]) -> str:
    parts = [
        f"SELECT '{issue}' AS issue, '{column}' AS \"column\", ({count})::BIGINT AS rows, "
        f"NULL::DOUBLE AS percentage FROM t"
        for issue, column, count in checks
    ]
    parts += [
        f"SELECT 'null_values', '{c}', count(*) FILTER (WHERE {c} IS NULL), "
        f"round(count(*) FILTER (WHERE {c} IS NULL) / count(*)::DOUBLE * 100, 6) FROM t"
        for c in nulls
    ]
    parts.append(
        "SELECT 'duplicate_ids', 'prompt_id', sum(n)::BIGINT, NULL FROM "
        "(SELECT count(*) AS n FROM t GROUP BY prompt_id HAVING count(*) > 1)"
    )
    return f"{table} SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE rows > 0"


def _score_checks(column: str) -> list[tuple[str, str, str]]:
    return [
        ("score_out_of_range", column, f"count(*) FILTER (WHERE {column} < 0 OR {column} > 5)"),
        (
            "single_value",
            column,
            f"CASE WHEN count(DISTINCT {column}) = 1 THEN count({column}) ELSE 0 END",
        ),
    ]


_BAD_GRADE = "(grade IS NULL OR grade NOT IN ('A', 'B', 'C', 'D', 'F'))"

_RUNS = f"""{WITH_SCORES},
baseline AS (SELECT s.*, d.lang FROM scored AS s JOIN documents AS d ON d.doc_id = s.seq),
later_scores AS ({_select(rel.LATER_RUN, "baseline")}),
later AS (SELECT *, {_grade("overall_score")} AS grade FROM later_scores)"""

_METRICS = {"overall_score": "Overall Score"} | {f"score_{d}": d.capitalize() for d in _DIMENSIONS}


def _metric_stats(baseline: str, current: str, groups: dict[str, str] | None = None) -> str:
    """``groups``: what to put before the name of a metric, and the condition on the baseline's rows."""
    parts = [
        f"""SELECT '{label}{name}' AS metric, b.n AS baseline_n, c.n AS current_n,
  b.m AS baseline_mean, c.m AS current_mean,
  coalesce((c.m - b.m) / nullif(b.m, 0) * 100, 0e0) AS percent_change,
  CASE WHEN sqrt((b.v + c.v) / 2) > 0 THEN (c.m - b.m) / sqrt((b.v + c.v) / 2) ELSE 0e0 END
    AS cohens_d,
  (b.n + c.n - 2)::DOUBLE AS degrees_of_freedom,
  sqrt(((b.n - 1) * b.v + (c.n - 1) * c.v) / (b.n + c.n - 2) * (1e0 / b.n + 1e0 / c.n)) AS err
FROM (SELECT count({m}) AS n, avg({m}) AS m, var_samp({m}) AS v FROM {baseline} WHERE {which}) AS b,
  (SELECT count({m}) AS n, avg({m}) AS m, var_samp({m}) AS v FROM {current}) AS c"""
        for label, which in (groups or {"": "true"}).items()
        for m, name in _METRICS.items()
    ]
    return f"""metric_stats AS ({" UNION ALL ".join(parts)}),
tests AS (
  SELECT *, CASE WHEN err > 0 THEN (current_mean - baseline_mean) / err
    WHEN current_mean <> baseline_mean THEN sign(current_mean - baseline_mean) * 'inf'::DOUBLE END
    AS t_statistic
  FROM metric_stats
)"""


# The two-sided tail of Student's t by Simpson's rule over the density from 0 to |t|.
_STEPS = 20_000
_MODELS = (
    "gpt-4", "gpt-4-turbo", "gpt-3.5-turbo-0125", "claude-3-sonnet", "Claude-3-OPUS", "claude-3-haiku",
    "mystery-model",
)


def _verdicts(stats: str) -> str:
    return f"""{_RUNS}, {stats},
tails AS (
  SELECT metric,
    greatest(0e0, 1 - 2 * exp(lgamma((any_value(degrees_of_freedom) + 1) / 2)
      - lgamma(any_value(degrees_of_freedom) / 2))
      / sqrt(any_value(degrees_of_freedom) * pi())
      * any_value(abs(t_statistic)) / {_STEPS} / 3
      * sum(CASE WHEN i = 0 OR i = {_STEPS} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
        * pow(1 + pow(abs(t_statistic) * i / {_STEPS}, 2) / degrees_of_freedom,
              -(degrees_of_freedom + 1) / 2))) AS p_value
  FROM tests, range({_STEPS + 1}) AS s(i)
  WHERE t_statistic IS NOT NULL GROUP BY metric
),
verdicts AS (
  SELECT tests.*, p_value,
    coalesce(p_value < 5e-2, false) AS is_significant,
    abs(cohens_d) > 3e-1 AS is_large_effect,
    coalesce(p_value < 5e-2, false) AND abs(cohens_d) > 3e-1 AND current_mean < baseline_mean
      AS is_regression,
    coalesce(p_value < 5e-2, false) AND abs(cohens_d) > 3e-1 AND NOT current_mean < baseline_mean
      AS is_improvement
  FROM tests LEFT JOIN tails USING (metric)
)"""


_VERDICTS = _verdicts(_metric_stats("baseline", "later"))


def _grade_test(baseline: str, current: str, rescale: bool = False) -> str:
    chi2 = " + ".join(
        f"pow((1 + c.g{g}) - (1 + b.g{g}) * f, 2) / ((1 + b.g{g}) * f)" for g in GRADES
    )
    counts = ", ".join(f"count(*) FILTER (WHERE grade = '{g}') AS g{g}" for g in GRADES)
    total = "({t}.gA + {t}.gB + {t}.gC + {t}.gD + {t}.gF + 5)"
    total_b, total_c = total.format(t="b"), total.format(t="c")
    factor = f"{total_c} / {total_b}::DOUBLE" if rescale else "1e0"
    testable = "true" if rescale else f"{total_b} = {total_c}"
    return f"""grade_counts_b AS (SELECT count(grade) AS n, {counts} FROM {baseline}),
grade_counts_c AS (SELECT count(grade) AS n, {counts} FROM {current}),
grade_stats AS (
  SELECT (b.gD + b.gF) / b.n::DOUBLE * 100 AS baseline_fail_pct,
    (c.gD + c.gF) / c.n::DOUBLE * 100 AS current_fail_pct,
    CASE WHEN {testable} THEN {chi2} ELSE 0e0 END AS chi2
  FROM (SELECT b.*, {factor} AS f FROM grade_counts_b AS b, grade_counts_c AS c) AS b,
    grade_counts_c AS c
),
grade_test AS (
  SELECT 'Grade Distribution' AS metric, baseline_fail_pct, current_fail_pct, chi2,
    current_fail_pct - baseline_fail_pct AS fail_increase,
    exp(-chi2 / 2) * (1 + chi2 / 2) AS p_value,
    current_fail_pct - baseline_fail_pct > 10
      AND exp(-chi2 / 2) * (1 + chi2 / 2) < 5e-2 AS is_regression
  FROM grade_stats
)"""


def _rounded(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


_GRADE_VIEW = f"SELECT metric, {_rounded(*catalog.GRADE_NUMBERS)}, is_regression FROM grade_test"

REGRESSION_REPORT = f"""{_VERDICTS}, {_grade_test("baseline", "later")},
report AS (
  SELECT metric, baseline_mean AS baseline_value, current_mean AS current_value,
    percent_change AS change, cohens_d AS effect, t_statistic AS statistic, p_value,
    CASE WHEN is_regression THEN 'regression' WHEN is_improvement THEN 'improvement'
      ELSE 'stable' END AS status, NULL::VARCHAR AS reason
  FROM verdicts
  UNION ALL
  SELECT metric, baseline_fail_pct, current_fail_pct, fail_increase, NULL, chi2, p_value,
    CASE WHEN is_regression THEN 'regression' ELSE 'stable' END, NULL
  FROM grade_test
)"""


def _column_report(table: str, columns: dict[str, str]) -> str:
    parts = []
    for name, kind in columns.items():
        number = kind in ("bigint", "int", "double")
        stats = [
            f"round({f}, 4) AS {label}" if number else f"NULL::DOUBLE AS {label}"
            for label, f in {
                "mean": f"avg({name})",
                "median": f"quantile_cont({name}::DOUBLE, 0.5)",
                "std": f"stddev_samp({name})",
                "min": f"min({name})::DOUBLE",
                "max": f"max({name})::DOUBLE",
            }.items()
        ]
        parts.append(
            f"SELECT '{name}' AS \"column\", '{kind}' AS dtype, "
            f"count(*) FILTER (WHERE {name} IS NULL) AS null_count, "
            f"round(count(*) FILTER (WHERE {name} IS NULL) / count(*)::DOUBLE * 100, 2) "
            f"AS null_percentage, count(DISTINCT {name}) AS unique_values, {', '.join(stats)} "
            f"FROM {table}"
        )
    return " UNION ALL ".join(parts)


_LINEITEM = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double",
    "l_tax": "double", "l_returnflag": "string", "l_linestatus": "string",
    "l_shipdate": "timestamp_ntz",
}
_DIRTY_KINDS = {
    "prompt_id": "string", "response": "string", "overall_score": "double",
    "score_accuracy": "double", "score_tone": "double", "score_flat": "double", "grade": "string",
}


def _clean(text: str, limit: int = 10_000) -> str:
    """Cut, drop NULs, collapse whitespace."""
    words = f"regexp_split_to_array(replace({text}[:{limit}], chr(0), ''), '{_SPACES}')"
    return f"array_to_string(list_filter({words}, lambda w: w <> ''), ' ')"


def _escape(text: str) -> str:
    for plain, entity in (
        ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")
    ):
        text = f"replace({text}, {_quote(plain)}, {_quote(entity)})"
    return text


_ESCAPED_PROMPT = _escape("prompt_text")

_JUDGE_VALUE = (
    "CASE WHEN json_valid(j) AND json_type(j) = 'OBJECT' "
    "THEN TRY_CAST(json_extract_string(j, '$.k') AS DOUBLE) END"
)
JUDGE = f"""WITH t AS ({_select(rel.JUDGE_TEXTS, "events")}),
blocks AS (
  SELECT *, coalesce(nullif(regexp_extract(response, '(?si)```(?:json)?\\s*(\\{{.*?\\}})\\s*```', 1),
    ''), response) AS j,
    TRY_CAST(list_extract(regexp_extract_all(response, '[-+]?\\d*\\.\\d+|\\d+'), -1) AS DOUBLE)
      AS spoken
  FROM t
),
parsed AS (SELECT *, {_JUDGE_VALUE} AS keyed FROM blocks),
judged AS (
  SELECT *, CASE WHEN response <> '' AND coalesce(keyed, spoken) IS NOT NULL
    THEN greatest(0e0, least(1e0, coalesce(keyed, spoken) / 100)) END AS raw FROM parsed
)
SELECT event_id, round(coalesce(raw, 0e0), 6) AS score_judge, round(raw, 6) AS score_judge_raw,
  CASE WHEN response = '' THEN 'no response_text'
    WHEN keyed IS NOT NULL THEN 'json key ''k'' parsed'
    WHEN spoken IS NOT NULL THEN 'parsed last numeric'
    ELSE 'no numeric found' END AS score_judge_notes
FROM judged"""

# A text as the query made it, cut into words without collapsing case.
_DOC_WORDS = f"list_filter(regexp_split_to_array(text, '{_SPACES}'), lambda w: w <> '')"

STORED_SCORES = """
    CASE seq % 4 WHEN 0 THEN 15e-1 WHEN 1 THEN 5e0 WHEN 2 THEN 4e0
      ELSE (seq % 5)::DOUBLE END AS accuracy,
    (seq % 6)::DOUBLE / 5 * 5 AS reasoning,
    (seq % 3)::DOUBLE + 1 AS tone"""

REQUEST_RATE = f"""WITH calls AS (
  SELECT event_type, ts, count(*) OVER (
      PARTITION BY event_type ORDER BY epoch_us(ts)
      RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS calls_last_minute
  FROM events
)
SELECT event_type, ts, count(*) AS requests, any_value(calls_last_minute) AS calls_last_minute,
  round(any_value(calls_last_minute) / {catalog.CALLS_PER_MINUTE}e0 * 100, 6)
    AS utilization_percent
FROM calls GROUP BY event_type, ts"""

_REJECTED = {
    7: "n_chars is no bigint: many",
    8: "2 of 4 fields",
    9: "more than 4 fields",
}
REJECTED = f"""SELECT doc_id, {", ".join(
    f"CASE WHEN doc_id % 20 NOT IN (7, 8, 9) THEN {c} END AS {c}" for c in ("lang", "n_chars", "text"))},
  CASE doc_id % 20 {" ".join(f"WHEN {k} THEN '{v}'" for k, v in _REJECTED.items())} END AS reason
FROM documents"""

CLEANED = f"""{_DIRTY},
trimmed AS (
  SELECT DISTINCT trim(prompt_id) AS prompt_id,
    regexp_replace(regexp_replace(response, '^{_SPACES}', ''), '{_SPACES}$', '') AS response,
    overall_score, score_accuracy, score_tone, score_flat, trim(grade) AS grade
  FROM t
)
SELECT prompt_id, response,
  {", ".join(
      f"round(CASE WHEN {c} IS NOT NULL THEN greatest(0e0, least(5e0, {c})) END, 6) AS {c}"
      for c in ("overall_score", "score_accuracy", "score_tone"))},
  CASE WHEN upper(grade) IN ('A', 'B', 'C', 'D', 'F') THEN upper(grade) ELSE 'F' END AS grade
FROM trimmed"""

EXECUTED = """SELECT doc_id::VARCHAR AS prompt_id, length(text) AS prompt_chars,
  CASE WHEN contains(lower(text), 'license') THEN '' ELSE length(text) || ' characters' END
    AS response,
  'gpt-4' AS model,
  CASE WHEN contains(lower(text), 'license') THEN 'error' ELSE 'success' END AS status,
  CASE WHEN contains(lower(text), 'license') THEN 'licensed text' END AS error,
  CASE WHEN contains(lower(text), 'license') THEN 'ValueError' END AS error_type
FROM documents"""


ORACLES = {
    "filter_success": f"""WITH {RESPONSES}
SELECT prompt_id, model, status FROM responses WHERE status = 'success'""",
    "prompt_text_coalesce": f"""WITH t AS (
  SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'd' || doc_id ELSE '' END AS id,
    'p' || doc_id AS prompt_id, CASE WHEN lang = 'en' THEN '' ELSE text END AS text,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS prompt_text,
    CASE WHEN lang = 'fr' THEN '' ELSE lang END AS prompt
  FROM documents
)
SELECT doc_id, coalesce(nullif(id, ''), prompt_id) AS prompt_id,
  {_first_non_empty("text", "prompt_text", "prompt")} AS for_scores,
  {_first_non_empty("prompt", "text")} AS for_execution,
  {_first_non_empty("prompt", "prompt_text")} AS for_cost,
  {_first_non_empty("prompt_text", "prompt")} AS for_report
FROM t""",
    "text_features": f"""{WITH_FEATURES}
SELECT prompt_id, n_words, logical_count, positive, negative, polite, uncertain, bonus, listed
FROM features""",
    "unique_word_ratio": f"""{WITH_FEATURES}
SELECT prompt_id, round(unique_word_ratio, 6) AS unique_word_ratio FROM features""",
    **{
        f"score_{d}": f"{WITH_FEATURES} SELECT prompt_id, h_{d}::BIGINT AS {d} FROM heuristics"
        for d in _DIMENSIONS
    },
    "category_score": f"""{WITH_FEATURES},
named AS (SELECT *, {catalog.CATEGORY} AS category FROM heuristics)
SELECT prompt_id, category, (CASE category WHEN 'accuracy' THEN h_accuracy
  WHEN 'reasoning' THEN h_reasoning WHEN 'tone' THEN h_tone
  WHEN 'completeness' THEN h_completeness ELSE 3 END)::BIGINT AS category_score
FROM named""",
    "normalize_value": f"""WITH t AS (
  SELECT event_id, CASE user_id % 4 WHEN 0 THEN value WHEN 1 THEN -value
    WHEN 2 THEN value / 50 ELSE NULL END AS v
  FROM events
)
SELECT event_id, round({_normalized("v")}, 6) AS unscaled,
  round({_normalized("v", "greatest(0e0, least(1e0, (v - 1) / 39))")}, 6) AS scaled,
  round({_normalized("v")}, 6) AS bad_range
FROM t""",
    "rule_contains_terms": _rule(
        f"({_TERMS} >= 2)::INT::DOUBLE",
        f"'matched ' || {_TERMS} || '/{len(catalog.RULE_TERMS)} terms'",
    ),
    "rule_mentions_entity": _rule(
        f"{_ENTITY}::INT::DOUBLE",
        f"'entity ''{catalog.RULE_ENTITY}'' ' || CASE WHEN {_ENTITY} THEN 'present' "
        "ELSE 'absent' END",
    ),
    "rule_length_within": _rule(
        f"(n_words <= {catalog.RULE_MAX_WORDS})::INT::DOUBLE", "'length ' || n_words || ' words'"
    ),
    "rule_of_the_caller": _rule("(n_words % 2 = 0)::INT::DOUBLE", "'even or odd'"),
    "judge_score": JUDGE,
    "score_responses": f"{WITH_SCORES} {_scored_view('scored')}",
    "detect_defects": f"""{WITH_FEATURES},
stored AS (SELECT *, {STORED_SCORES} FROM features)
SELECT prompt_id, {_codes({"reasoning": "reasoning", "accuracy": "accuracy", "tone": "tone",
                           "completeness": "5"})} AS defects FROM stored""",
    "assign_grade": f"{WITH_SCORES} SELECT prompt_id, grade FROM scored",
    "token_estimate": "SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents",
    "normalize_model": f"""WITH usage AS ({_select(rel.USAGE, "events")})
SELECT event_id, model, {_PRICE_KEY} AS price_key FROM usage""",
    "row_cost": ROW_COST,
    "row_cost_joined": ROW_COST,
    "cost_summary": f"""{WITH_USAGE},
totals AS (
  SELECT count(*) AS total_requests, sum(input_tokens)::BIGINT AS total_input_tokens,
    sum(output_tokens)::BIGINT AS total_output_tokens, sum(cost) AS spent
  FROM priced
)
SELECT total_requests, total_input_tokens, total_output_tokens,
  total_input_tokens + total_output_tokens AS total_tokens,
  round(spent, 4) AS total_cost,
  round((total_input_tokens + total_output_tokens) / total_requests::DOUBLE, 6)
    AS avg_tokens_per_request,
  round(spent / total_requests, 4) AS average_cost_per_call,
  {_BUDGET} AS budget_limit, round({_BUDGET} - spent, 4) AS budget_remaining,
  round(spent / {_BUDGET} * 100, 2) AS budget_utilized_percent
FROM totals""",
    "cost_by_model": f"""{WITH_USAGE}
SELECT model, round(sum(cost6), 6) AS cost
FROM (SELECT model, {_binary_round("cost", 6)} AS cost6 FROM priced) GROUP BY model""",
    "cumulative_cost": f"""{_running("PARTITION BY run")}
SELECT run, event_id, round(cumulative_cost, 8) AS cumulative_cost, cumulative_tokens
FROM running""",
    "cumulative_cost_overall": f"""{_running("")}
SELECT event_id, round(cumulative_cost, 8) AS cumulative_cost, cumulative_tokens FROM running""",
    "budget_alerts": _budget_alerts("cost"),
    "request_rate": REQUEST_RATE,
    "request_rate_per_request": f"""SELECT event_id, calls_last_minute,
  round(calls_last_minute / {catalog.CALLS_PER_MINUTE}e0 * 100, 6) AS utilization_percent
FROM (SELECT event_id, count(*) OVER (
    PARTITION BY event_type ORDER BY epoch_us(ts)
    RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS calls_last_minute
  FROM events)""",
    "report_sample": f"""{WITH_PAGE_SCORES}
SELECT seq, {_escape("prompt_id")} AS sample_id,
  {_ESCAPED_PROMPT}[:100] || CASE WHEN length(prompt_text) > 100 THEN '...' ELSE '' END AS prompt,
  {_escape("model")} AS model, round(overall_score, 6) AS score, defects
FROM scored ORDER BY seq LIMIT 100""",
    "report_statistics": f"""{WITH_SCORES}
SELECT count(*) AS total_evaluations,
  {", ".join(f"round(avg(score_{d}) * 5, 6) AS mean_{d}" for d in _DIMENSIONS)},
  round(avg(overall_score), 6) AS mean_overall
FROM scored""",
    "executive_summary": f"""{WITH_SCORES},
s AS (
  SELECT count(*) AS total_evaluations, avg(aggregated_score) * 5 AS average_score,
    median(aggregated_score) * 5 AS median_score, stddev_samp(aggregated_score) * 5 AS std_dev,
    count(*) FILTER (WHERE aggregated_score >= 7e-1) / count(*)::DOUBLE * 100 AS success_rate
  FROM scored
)
SELECT total_evaluations, {_rounded("average_score", "median_score", "std_dev", "success_rate")},
  CASE WHEN average_score >= 45e-1 THEN 'excellent' WHEN average_score >= 35e-1 THEN 'good'
    WHEN average_score >= 25e-1 THEN 'acceptable' ELSE 'below_expectations' END AS insight,
  std_dev > 1 AS high_variance
FROM s""",
    "dimension_averages": f"""{WITH_SCORES},
d AS ({" UNION ALL ".join(
        f"SELECT '{d}{suffix}' AS dimension, avg(score_{d}) AS a FROM scored"
        for d in _DIMENSIONS for suffix in ("", "_raw"))})
SELECT dimension, round(a, 6) AS average,
  round(CASE WHEN a <= 1 THEN a * 5 ELSE a END, 6) AS display_average FROM d""",
    "defect_summary": f"""{WITH_SCORES}
SELECT defect, count(*) AS count
FROM (SELECT unnest(string_split(defects, ',')) AS defect FROM scored)
WHERE defect <> '' GROUP BY defect""",
    "report_files": f"""{WITH_SCORES}
SELECT defect, count(*) AS count
FROM (SELECT unnest(string_split(defects, ',')) AS defect FROM scored)
WHERE defect <> '' GROUP BY defect""",
    "run_summary": f"""{WITH_SCORES}, {_ROW_TOKENS % "scored"}
SELECT count(*) AS total_evaluations, round(avg(overall_score), 6) AS average_score,
  round(count(*) FILTER (WHERE overall_score >= 35e-1) / count(*)::DOUBLE * 100, 6)
    AS success_rate,
  sum(input_tokens + output_tokens)::BIGINT AS total_tokens, round(sum(cost), 8) AS total_cost
FROM priced""",
    "execution_summary": f"""WITH {RESPONSES}
SELECT count(*) AS total, count(*) FILTER (WHERE status = 'success') AS success,
  count(*) FILTER (WHERE status <> 'success') AS failed,
  round(count(*) FILTER (WHERE status = 'success') / count(*)::DOUBLE * 100, 6) AS success_rate
FROM responses""",
    "accuracy_histogram": _histogram("accuracy", 5),
    "overall_histogram": _histogram("overall_score", 10),
    "lint_prompts": LINT,
    "pending_prompts": """SELECT doc_id, lang, source FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "rejected_records": REJECTED,
    "stream_rejected_records": REJECTED,
    "stream_csv_lines": "SELECT c_custkey, c_name, c_acctbal FROM customer",
    "pending_in_buckets": """SELECT doc_id, lang, source FROM documents
WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
    "error_stats": f"""WITH t AS (
  {_select(rel.FAILURES, "events", "WHERE event_type = 'error'")}
),
s AS (
  SELECT *, CASE error_type WHEN 'AuthenticationError' THEN 'critical'
    WHEN 'TimeoutError' THEN 'high' WHEN 'RateLimitError' THEN 'high'
    WHEN 'ConnectionError' THEN 'medium' WHEN 'ValueError' THEN 'medium' ELSE 'low' END AS severity
  FROM t
)
SELECT 'error_type' AS dimension, error_type AS value, count(*) AS count FROM s GROUP BY error_type
UNION ALL
SELECT 'severity', severity, count(*) FROM s GROUP BY severity""",
    "validate_raw": _issues(
        _RAW,
        [
            (
                "invalid_timestamp",
                "timestamp",
                'count(*) FILTER (WHERE "timestamp" IS NOT NULL '
                'AND TRY_CAST("timestamp" AS TIMESTAMP) IS NULL)',
            )
        ],
        ["prompt_id", "prompt", "response", '"timestamp"'],
    ),
    "validate_scored": _issues(
        _DIRTY,
        [
            *_score_checks("score_accuracy"),
            *_score_checks("score_tone"),
            *_score_checks("score_flat"),
            ("invalid_grade", "grade", f"count(*) FILTER (WHERE {_BAD_GRADE})"),
            (
                "inconsistent_grade",
                "grade",
                f"count(*) FILTER (WHERE grade IS DISTINCT FROM {_grade('overall_score')})",
            ),
        ],
        ["prompt_id", "response", "overall_score", "grade"],
    ),
    "invalid_grades": f"{_DIRTY} SELECT grade, count(*) AS n FROM t WHERE {_BAD_GRADE} GROUP BY grade",
    "grade_consistency": f"""{_DIRTY}
SELECT prompt_id, round(overall_score, 6) AS overall_score, grade,
  {_grade("overall_score")} AS expected_grade
FROM t WHERE grade IS DISTINCT FROM {_grade("overall_score")}""",
    "duplicate_ids": f"""{_RAW}
SELECT doc_id, prompt_id FROM (SELECT *, count(*) OVER (PARTITION BY prompt_id) AS n FROM t)
WHERE n > 1""",
    "repeated_in_buckets": f"""{_RAW}
SELECT doc_id, prompt_id FROM (SELECT *, count(*) OVER (PARTITION BY prompt_id) AS n FROM t)
WHERE n > 1""",
    "clean_results": CLEANED,
    "stream_clean": CLEANED,
    "quality_report_table": """SELECT count(*) AS total_rows, 5::BIGINT AS total_columns,
  count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM documents)) AS duplicate_rows
FROM documents""",
    "quality_report_columns": _column_report("lineitem", _LINEITEM),
    "quality_report_scores": f"{_DIRTY} {_column_report('t', _DIRTY_KINDS)}",
    "merged_summaries": f"""SELECT * EXCLUDE (unique_values, median), TRUE AS distinct_holds,
  CASE WHEN mean IS NOT NULL THEN TRUE END AS median_holds
FROM ({_column_report("lineitem", _LINEITEM)})""",
    "summary_of_scores": f"""{WITH_SCORES},
s AS (
  SELECT model, count(*) AS total_evaluations, avg(aggregated_score) * 5 AS average_score,
    stddev_samp(aggregated_score) * 5 AS std_dev,
    count(*) FILTER (WHERE aggregated_score >= 7e-1) / count(*)::DOUBLE * 100 AS success_rate
  FROM scored GROUP BY model
)
SELECT model, total_evaluations, {_rounded("average_score", "std_dev", "success_rate")},
  CASE WHEN average_score >= 45e-1 THEN 'excellent' WHEN average_score >= 35e-1 THEN 'good'
    WHEN average_score >= 25e-1 THEN 'acceptable' ELSE 'below_expectations' END AS insight,
  std_dev > 1 AS high_variance
FROM s""",
    "metric_regression": f"""{_RUNS}, {_metric_stats("baseline", "later")}
SELECT metric, baseline_n, current_n, {_rounded(*catalog.TEST_NUMBERS)}, degrees_of_freedom
FROM tests""",
    "regression_verdict": f"""{_VERDICTS}
SELECT metric, {_rounded("t_statistic", "cohens_d", "p_value")}, is_significant, is_large_effect,
  is_regression, is_improvement
FROM verdicts""",
    "grade_regression": f"{_RUNS}, {_grade_test('baseline', 'later')} {_GRADE_VIEW}",
    "grade_regression_unequal": f"{_RUNS}, {_grade_test('baseline', 'scored')} {_GRADE_VIEW}",
    "grade_regression_rescaled": (
        f"{_RUNS}, {_grade_test('baseline', 'scored', rescale=True)} {_GRADE_VIEW}"
    ),
    "grade_distribution": f"""{WITH_SCORES},
per_run AS (
  SELECT status, count(grade) AS n, count(*) FILTER (WHERE grade IN ('D', 'F')) AS fails
  FROM scored GROUP BY status
)
SELECT status, g.grade, (SELECT count(*) FROM scored AS s
    WHERE s.status = per_run.status AND s.grade = g.grade) AS count,
  round((SELECT count(*) FROM scored AS s
    WHERE s.status = per_run.status AND s.grade = g.grade) / n::DOUBLE, 6) AS share,
  (SELECT count(*) FROM scored AS s
    WHERE s.status = per_run.status AND s.grade = g.grade) + 1 AS smoothed_count,
  round(fails / n::DOUBLE * 100, 6) AS fail_pct
FROM per_run, (VALUES {", ".join(f"('{g}')" for g in GRADES)}) AS g(grade)""",
    "regression_report": f"""{REGRESSION_REPORT}
SELECT metric, {_rounded("baseline_value", "current_value", "change", "effect", "statistic",
                         "p_value")}, status, reason
FROM report""",
    "statistics_report": f"""{REGRESSION_REPORT}
SELECT metric, {_rounded("baseline_value", "current_value", "change", "effect", "statistic",
                         "p_value")}, status, reason
FROM report""",
    "baselines_report": f"""{_verdicts(_metric_stats(
        "baseline", "later", {f"{m}: ": f"model = '{m}'" for m in _MODELS}))}
SELECT metric, {", ".join(f"round({c}, 6) AS {name}" for c, name in (
    ("baseline_mean", "baseline_value"), ("current_mean", "current_value"), ("percent_change", "change"),
    ("cohens_d", "effect"), ("t_statistic", "statistic"), ("p_value", "p_value")))},
  CASE WHEN is_regression THEN 'regression' WHEN is_improvement THEN 'improvement' ELSE 'stable' END AS status
FROM verdicts""",
    "run_verdict": f"""{REGRESSION_REPORT}
SELECT bool_or(status = 'regression') AS has_regression, max(reason) AS reason,
  coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE status = 'regression'), '')
    AS regressions,
  coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE status = 'improvement'
    AND metric <> 'Grade Distribution'), '') AS improvements,
  coalesce(string_agg(metric, ',' ORDER BY metric) FILTER (WHERE status = 'stable'
    AND metric <> 'Grade Distribution'), '') AS stable_metrics
FROM report""",
    "map_chunks": """SELECT l_orderkey, l_linenumber,
  round(l_extendedprice * (1 - l_discount), 6) AS net FROM lineitem""",
    "execute_prompts": EXECUTED,
    "execute_resumed": EXECUTED,
    "ragged_union": """SELECT c_acctbal AS balance, c_custkey AS key, c_name AS name,
  NULL::INT AS nation, c_mktsegment AS segment FROM customer
UNION ALL
SELECT s_acctbal, s_suppkey, s_name, s_nationkey, NULL FROM supplier""",
    "sanitize_string": f"SELECT page_id, {_clean('html')} AS html FROM pages",
    "sanitize_filename": r"""WITH t AS (
  SELECT page_id, trim(regexp_replace(url, '[^\pL\pN_\s.-]', '', 'g'), '. ')[:255] AS f FROM pages
)
SELECT page_id, CASE WHEN f = '' THEN 'unnamed_file' ELSE f END AS filename FROM t""",
    "sanitize_nested": f"""SELECT page_id, {_clean("url")} AS url, page_id AS inner_id,
  array_to_string(list_transform(string_split(html, '</p>'), lambda p: {_clean("p")}), '|')
    AS parts,
  'html|url' AS meta_keys, {_clean("html")} AS meta_html
FROM pages""",
    "key_shape": f"""SELECT doc_id, array_to_string(list_sort(list_filter({_DOC_WORDS},
  lambda w: length(w) >= 20 AND (starts_with(w, 'sk-') OR starts_with(w, 'claude-')
    OR length(w) > 30))), ' ') AS keys
FROM documents""",
    "html_escape": f"SELECT page_id, {_escape('html')} AS html FROM pages",
    "load_results": """SELECT doc_id::VARCHAR AS doc_id, text, lang, source,
  n_chars::VARCHAR AS n_chars
FROM documents""",
    "load_prompts": """SELECT 'part_' || p_partkey AS id, p_name AS text, p_brand AS category,
  p_brand || ',' || p_type AS tags, p_size::INTEGER AS max_tokens
FROM part""",
    "result_callback": "SELECT event_type, count(*) AS rows FROM events GROUP BY event_type",
    "csv_round_trip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "stream_csv": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "json_round_trip": "SELECT doc_id, text, lang, source, n_chars FROM documents",
    "export_usage_log": f"""{WITH_USAGE}
SELECT 'evt_' || event_id AS prompt_id, model, input_tokens, output_tokens,
  {_binary_round("cost", 6)} AS cost
FROM priced""",
    "save_as_baseline": f"{REGRESSION_REPORT} SELECT metric, status FROM report",
    "stream_score": f"{WITH_SCORES} {_scored_view('scored')} WHERE status = 'success'",
    "stream_persist": "SELECT * FROM events",
    # Windows of a minute every ten seconds, without those the watermark still keeps open.
    "stream_request_rate": f"""WITH last AS (SELECT max(ts) - INTERVAL 2 MINUTE AS mark FROM events),
placed AS (
  SELECT event_type,
    time_bucket(INTERVAL 10 SECOND, ts) - i * INTERVAL 10 SECOND AS window_start
  FROM events, range(6) AS s(i)
)
SELECT event_type, window_start, count(*) AS calls,
  round(count(*) / {catalog.CALLS_PER_MINUTE}e0 * 100, 6) AS utilization_percent
FROM placed, last WHERE window_start + INTERVAL 1 MINUTE <= mark
GROUP BY event_type, window_start""",
    "stream_trailing_minute": f"""WITH rate AS ({REQUEST_RATE})
SELECT * FROM rate
WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= (SELECT max(ts) - INTERVAL 2 MINUTE FROM events)""",
    "stream_repeated_ids": f"""SELECT prompt_id, count(*) AS n
FROM ({_select(rel.RAW_RESULTS, "documents")}) GROUP BY prompt_id HAVING count(*) > 1""",
    "stream_usage_by_model": f"""{WITH_USAGE}
SELECT model, count(*) AS requests, sum(input_tokens + output_tokens)::BIGINT AS total_tokens,
  round(sum(cost6), 6) AS cost
FROM (SELECT *, {_binary_round("cost", 6)} AS cost6 FROM priced) GROUP BY model""",
    "stream_budget_alerts": _budget_alerts(rel.KNOWN_COST),
}
