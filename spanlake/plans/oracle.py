"""DuckDB twins of the registered queries.

Each string runs in DuckDB on the same Parquet tables (pre-registered views).
The views the operators consume (call logs, chunks, raw events, messages) are
re-derived here in SQL, independently of the Spark code.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

RANGE_SQL = {"1h": "INTERVAL 1 HOUR", "24h": "INTERVAL 24 HOUR", "7d": "INTERVAL 7 DAY",
             "30d": "INTERVAL 30 DAY"}
BUCKET_SQL = {"1h": "INTERVAL 5 MINUTE", "24h": "INTERVAL 1 HOUR", "7d": "INTERVAL 6 HOUR",
              "30d": "INTERVAL 1 DAY"}

PRICES_VALUES = """(VALUES
  ('OPENAI','gpt-4o-mini',0.000000150,0.000000600), ('OPENAI','gpt-4o',0.000002500,0.000010000),
  ('ANTHROPIC','claude-3-5-haiku-latest',0.000000800,0.000004000),
  ('GOOGLE','gemini-1.5-flash',0.000000075,0.000000300),
  ('OTHER','gemma3:4b',0.000000080,0.000000080), ('OTHER','llama3.2:latest',0.000000080,0.000000080)
) AS p(p_provider, p_model, p_in, p_out)"""

LOGS_BASE = f"""
logs_base AS (
  SELECT CAST(event_id AS VARCHAR) AS id, event_id, ts AS created_at, user_id AS conversation_id,
   CASE event_id % 4 WHEN 0 THEN 'OPENAI' WHEN 1 THEN 'ANTHROPIC' WHEN 2 THEN 'GOOGLE' ELSE 'OTHER' END AS provider,
   CASE event_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'google' ELSE 'ollama' END AS provider_raw,
   CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 = 0 THEN 'gpt-4o-mini' ELSE 'gpt-4o' END
     WHEN 1 THEN 'claude-3-5-haiku-latest' WHEN 2 THEN 'gemini-1.5-flash'
     ELSE CASE WHEN event_id % 8 = 3 THEN 'gemma3:4b' ELSE 'llama3.2:latest' END END AS model,
   CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'signup' AND event_id % 5 = 0 THEN 'CANCELLED'
     ELSE 'SUCCESS' END AS status,
   CASE WHEN event_type = 'error' THEN CASE event_id % 6 WHEN 0 THEN 'rate_limit' WHEN 1 THEN 'context_length'
     WHEN 2 THEN 'timeout' END END AS error_type,
   CASE WHEN event_type = 'error' THEN props END AS error_message,
   CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(50 + (event_id * 37) % 1951 AS INT) END AS prompt_tokens,
   CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(20 + (event_id * 53) % 781 AS INT) END AS completion_tokens,
   CAST(FLOOR(value * 20) + 50 AS INT) AS latency_ms,
   CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(80 + (event_id * 11) % 421 AS INT) END AS ttft_ms,
   event_id % 5 > 1 AS streamed,
   'dev' AS environment
  FROM events
),
logs AS (
  SELECT b.*,
    CASE WHEN prompt_tokens IS NULL THEN NULL ELSE prompt_tokens + completion_tokens END AS total_tokens,
    CAST(CAST(p_in AS DECIMAL(12,9)) * prompt_tokens
       + CAST(p_out AS DECIMAL(12,9)) * completion_tokens AS DECIMAL(12,6)) AS cost_usd,
    created_at AS ended_at,
    created_at - to_milliseconds(latency_ms) AS started_at
  FROM logs_base b LEFT JOIN {PRICES_VALUES}
    ON b.provider = p.p_provider AND b.model = p.p_model
)"""

LOGS_PREVIEW = """
logs_pv AS (
  SELECT l.*, NULLIF(substring(d.text, 1, 256), '') AS input_preview,
         NULLIF(substring(d.text, 257, 256), '') AS output_preview, d.text AS whole_text
  FROM logs l LEFT JOIN documents d ON l.event_id = d.doc_id
)"""


def with_logs(body: str, previews: bool = False) -> str:
    """Prefix the call-log CTEs; a body starting with ',' adds more CTEs."""
    ctes = LOGS_BASE + ("," + LOGS_PREVIEW if previews else "")
    body = body.lstrip()
    if body.startswith(","):
        return f"WITH {ctes}{body}"
    return f"WITH {ctes}\n{body}"


def in_range_sql(range_key: str, col: str = "created_at") -> str:
    return f"{col} >= {AS_OF} - {RANGE_SQL[range_key]}"


def trunc_long(expr: str) -> str:
    return f"CAST(trunc(round(COALESCE(CAST({expr} AS DOUBLE), 0.0), 6)) AS BIGINT)"


def half_even_ratio_sql(num: str, den: str, digits: int = 4) -> str:
    scale = 10 ** digits
    n = f"(CAST({num} AS BIGINT) * {scale})"
    d = f"CAST({den} AS BIGINT)"
    q = f"({n} // {d})"
    r = f"({n} % {d})"
    up = f"(2 * {r} > {d} OR (2 * {r} = {d} AND {q} % 2 = 1))"
    return (f"CASE WHEN {d} > 0 THEN ({q} + CASE WHEN {up} THEN 1 ELSE 0 END) / {float(scale)} "
            f"ELSE 0.0 END")


def summary_sql(range_key: str) -> str:
    body = f"""
SELECT '{range_key}' AS range_name,
  CAST(total AS BIGINT) AS total_requests,
  {half_even_ratio_sql('errors', 'total')} AS error_rate,
  {trunc_long('p50')} AS p50_latency_ms,
  {trunc_long('p95')} AS p95_latency_ms,
  {trunc_long('p99')} AS p99_latency_ms,
  {trunc_long('avg_ttft')} AS avg_ttft_ms,
  COALESCE(CAST(sp AS BIGINT), 0) AS total_prompt_tokens,
  COALESCE(CAST(sc AS BIGINT), 0) AS total_completion_tokens,
  COALESCE(CAST(cost AS DOUBLE), 0.0) AS total_cost_usd
FROM (
  SELECT COUNT(*) AS total, SUM(CASE WHEN status = 'ERROR' THEN 1 ELSE 0 END) AS errors,
    PERCENTILE_CONT(0.50) WITHIN GROUP (ORDER BY latency_ms) AS p50,
    PERCENTILE_CONT(0.95) WITHIN GROUP (ORDER BY latency_ms) AS p95,
    PERCENTILE_CONT(0.99) WITHIN GROUP (ORDER BY latency_ms) AS p99,
    AVG(ttft_ms) AS avg_ttft, SUM(prompt_tokens) AS sp, SUM(completion_tokens) AS sc,
    SUM(cost_usd) AS cost
  FROM logs WHERE {in_range_sql(range_key)}
) s"""
    return with_logs(body)


def by_provider_sql(range_key: str) -> str:
    return with_logs(f"""
SELECT provider, COUNT(*) AS count,
  CAST(SUM(CASE WHEN status = 'ERROR' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*) AS error_rate
FROM logs WHERE {in_range_sql(range_key)} GROUP BY provider ORDER BY count DESC""")


def top_models_sql(range_key: str) -> str:
    return with_logs(f"""
SELECT model, COUNT(*) AS count FROM logs WHERE {in_range_sql(range_key)}
GROUP BY model ORDER BY count DESC, model LIMIT 10""")


def errors_breakdown_sql(range_key: str) -> str:
    return with_logs(f"""
SELECT error_type, COUNT(*) AS count, MAX(created_at) AS last_seen FROM logs
WHERE status = 'ERROR' AND {in_range_sql(range_key)} AND error_type IS NOT NULL
GROUP BY error_type ORDER BY count DESC""")


METRIC_SQL = {
    "requests": "CAST(COUNT(*) AS DOUBLE)",
    "latency_p50": "round(PERCENTILE_CONT(0.50) WITHIN GROUP (ORDER BY latency_ms), 6)",
    "latency_p95": "round(PERCENTILE_CONT(0.95) WITHIN GROUP (ORDER BY latency_ms), 6)",
    "errors": "CAST(SUM(CASE WHEN status = 'ERROR' THEN 1 ELSE 0 END) AS DOUBLE)",
    "cost": "CAST(SUM(cost_usd) AS DOUBLE)",
    "tokens": "CAST(SUM(total_tokens) AS DOUBLE)",
}


def timeseries_sql(metric: str, range_key: str, group_by: str = "none") -> str:
    t = f"time_bucket({BUCKET_SQL[range_key]}, created_at, TIMESTAMP '2000-01-01')"
    key = "'all'" if group_by == "none" else f"COALESCE(CAST({group_by} AS VARCHAR), 'None')"
    return with_logs(f"""
SELECT t, series_key, COALESCE(v, 0.0) AS v FROM (
  SELECT {t} AS t, {key} AS series_key, {METRIC_SQL[metric]} AS v
  FROM logs WHERE {in_range_sql(range_key)} GROUP BY 1, 2
) s ORDER BY t, series_key""")


# --- log explorer ----------------------------------------------------------------------------

LIST_COLS_SQL = """id, CAST(conversation_id AS VARCHAR) AS conversation_id, provider, model, status,
  latency_ms, ttft_ms, prompt_tokens, completion_tokens, total_tokens, CAST(cost_usd AS DOUBLE) AS cost_usd,
  streamed, input_preview, output_preview, error_type, environment, started_at, ended_at, created_at"""


def logs_page_sql(limit: int, where: str = "TRUE") -> str:
    return with_logs(f"""
, top AS (
  SELECT * FROM logs_pv WHERE {where} ORDER BY created_at DESC, id DESC LIMIT {limit + 1}
), r AS (
  SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS rn, count(*) OVER () AS n FROM top
)
SELECT {LIST_COLS_SQL},
  CASE WHEN n > {limit} THEN (SELECT created_at FROM r WHERE rn = {limit}) END AS next_cursor,
  CASE WHEN n > {limit} THEN (SELECT id FROM r WHERE rn = {limit}) END AS next_cursor_id
FROM r WHERE rn <= {limit}""", previews=True)


def log_detail_sql(log_id: str) -> str:
    return with_logs(f"""
SELECT {LIST_COLS_SQL},
  CAST(to_json(struct_pack(messages := [struct_pack(role := 'user', content := COALESCE(whole_text, ''))]))
    AS VARCHAR) AS request_payload,
  CAST(to_json(struct_pack(content := COALESCE(substring(whole_text, 257), ''), finish_reason := 'stop')) AS VARCHAR)
    AS response_payload,
  '[]' AS pii_detections
FROM logs_pv WHERE id = '{log_id}'""", previews=True)


# --- cost ------------------------------------------------------------------------------------

def _price_values() -> str:
    from ..sources.prices import price_rows
    rows = ", ".join(f"('{k}', {str(loc).upper()}, CAST({i} AS DECIMAL(12,9)), CAST({o} AS DECIMAL(12,9)))"
                     for k, loc, i, o in price_rows())
    return f"(VALUES {rows}) AS cat(price_key, is_local, input_rate, output_rate)"


def _rated(src: str) -> str:
    """Rows of ``src`` with in_rate/out_rate from the full catalog (cloud key or local rules)."""
    return f"""
rated AS (
  SELECT s.*,
    CASE WHEN lower(s.provider_raw) = 'ollama'
      THEN COALESCE(lb.input_rate, lf.input_rate, CAST(0.000000080 AS DECIMAL(12,9)))
      ELSE c.input_rate END AS in_rate,
    CASE WHEN lower(s.provider_raw) = 'ollama'
      THEN COALESCE(lb.output_rate, lf.output_rate, CAST(0.000000080 AS DECIMAL(12,9)))
      ELSE c.output_rate END AS out_rate
  FROM {src} s
  LEFT JOIN (SELECT * FROM {_price_values()} WHERE NOT is_local) c
    ON c.price_key = lower(s.provider_raw) || ':' || lower(s.model)
  LEFT JOIN (SELECT * FROM {_price_values()} WHERE is_local) lb
    ON lb.price_key = split_part(lower(s.model), ':latest', 1)
  LEFT JOIN (SELECT * FROM {_price_values()} WHERE is_local) lf
    ON lf.price_key = lower(s.model)
)"""


def cost_by_model_sql() -> str:
    return with_logs(f""", {_rated('logs')}
SELECT provider_raw, model, COUNT(*) AS calls, CAST(SUM(prompt_tokens) AS BIGINT) AS prompt_tokens,
  CAST(SUM(completion_tokens) AS BIGINT) AS completion_tokens,
  CAST(SUM(CASE WHEN prompt_tokens IS NOT NULL AND completion_tokens IS NOT NULL
    THEN CAST(in_rate * prompt_tokens + out_rate * completion_tokens AS DECIMAL(12,6)) END) AS DOUBLE) AS cost_usd,
  COUNT(*) FILTER (WHERE in_rate IS NULL OR prompt_tokens IS NULL OR completion_tokens IS NULL) AS unpriced_calls
FROM rated GROUP BY provider_raw, model""")


def _est(col: str) -> str:
    return (f"CAST(CASE WHEN COALESCE(length({col}), 0) = 0 THEN 0 "
            f"ELSE greatest(1, length({col}) // 4) END AS INT)")


def backfill_sql(mode: str = "reference") -> str:
    if mode == "reference":
        pred = "provider = 'OTHER' AND (prompt_tokens IS NULL OR cost_usd IS NULL)"
        new_p, new_c = "est_p", "est_c"
        new_t = "est_p + est_c"
        new_cost = "CAST(round(l_in * est_p + l_out * est_c, 8) AS DECIMAL(12,6))"
    else:
        pred = "provider_raw = 'ollama' AND (prompt_tokens IS NULL OR cost_usd IS NULL)"
        new_p, new_c = "COALESCE(prompt_tokens, est_p)", "COALESCE(completion_tokens, est_c)"
        new_t = "COALESCE(total_tokens, COALESCE(prompt_tokens, est_p) + COALESCE(completion_tokens, est_c))"
        new_cost = ("COALESCE(cost_usd, CAST(l_in * COALESCE(prompt_tokens, est_p) "
                    "+ l_out * COALESCE(completion_tokens, est_c) AS DECIMAL(12,6)))")
    local = _price_values()
    return with_logs(f""", est AS (
  SELECT l.*, {_est('input_preview')} AS est_p, {_est('output_preview')} AS est_c,
    COALESCE(lb.input_rate, lf.input_rate, CAST(0.000000080 AS DECIMAL(12,9))) AS l_in,
    COALESCE(lb.output_rate, lf.output_rate, CAST(0.000000080 AS DECIMAL(12,9))) AS l_out,
    ({pred}) AS bf
  FROM logs_pv l
  LEFT JOIN (SELECT * FROM {local} WHERE is_local) lb ON lb.price_key = split_part(lower(l.model), ':latest', 1)
  LEFT JOIN (SELECT * FROM {local} WHERE is_local) lf ON lf.price_key = lower(l.model)
)
SELECT id, provider, model,
  CASE WHEN bf THEN {new_p} ELSE prompt_tokens END AS prompt_tokens,
  CASE WHEN bf THEN {new_c} ELSE completion_tokens END AS completion_tokens,
  CASE WHEN bf THEN {new_t} ELSE total_tokens END AS total_tokens,
  CAST(CASE WHEN bf THEN {new_cost} ELSE cost_usd END AS DOUBLE) AS cost_usd
FROM est""", previews=True)


# --- PII ----------------------------------------------------------------------------------------

def _duck_card_valid(m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '', 'g')"
    luhn = (f"list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, j: "
            f"CASE WHEN j % 2 = 0 THEN (CASE WHEN CAST(c AS INT) * 2 > 9 THEN CAST(c AS INT) * 2 - 9 "
            f"ELSE CAST(c AS INT) * 2 END) ELSE CAST(c AS INT) END)) % 10 = 0")
    n = f"length(regexp_replace({m}, '[\\s\\-]', '', 'g'))"
    return f"({n} BETWEEN 13 AND 19 AND length({digits}) >= 13 AND {luhn})"


def pii_chain_sql(src: str, text_col: str, prefix: str = "pii_", name: str = "pii") -> tuple[str, str]:
    """CTEs applying the pattern chain to ``text_col`` of ``src``; returns (ctes, last_cte)."""
    from ..functions.pii import PATTERNS
    ctes = [f"{name}0 AS (SELECT *, {text_col} AS __t FROM {src})"]
    prev = f"{name}0"
    for k, p in enumerate(PATTERNS, start=1):
        rx = "(?i)" + p.regex.replace("'", "''")
        cur = f"{name}{k}"
        if not p.validate_card:
            rep = p.placeholder.replace("$1", "\\1")
            ctes.append(
                f"{cur} AS (SELECT * EXCLUDE (__t), regexp_replace(__t, '{rx}', '{rep}', 'g') AS __t, "
                f"CAST(COALESCE(len(regexp_extract_all(__t, '{rx}')), 0) AS INT) AS {prefix}{p.name} FROM {prev})")
        else:
            valid = _duck_card_valid("m")
            ctes.append(
                f"{cur} AS (SELECT * EXCLUDE (__t, __parts, __ms), "
                f"CASE WHEN __t IS NULL THEN NULL ELSE __parts[1] || array_to_string(list_transform(__ms, lambda m, i: "
                f"(CASE WHEN {valid} THEN '{p.placeholder}' ELSE m END) || __parts[i + 1]), '') END AS __t, "
                f"CAST(COALESCE(len(list_filter(__ms, lambda m: {valid})), 0) AS INT) AS {prefix}{p.name} "
                f"FROM (SELECT *, string_split_regex(__t, '{rx}') AS __parts, "
                f"regexp_extract_all(__t, '{rx}') AS __ms FROM {prev}))")
        prev = cur
    return ",\n".join(ctes), prev


def pii_docs_sql() -> str:
    from ..functions.pii import PII_TYPES
    ctes, last = pii_chain_sql("documents", "text")
    counts = ", ".join(f"pii_{n}" for n in PII_TYPES)
    return f"WITH {ctes}\nSELECT doc_id, __t AS text_redacted, {counts} FROM {last}"


def pii_totals_sql() -> str:
    from ..functions.pii import PII_TYPES
    ctes, last = pii_chain_sql("documents", "text")
    rows = " UNION ALL ".join(
        f"SELECT '{n}' AS type, COUNT(*) FILTER (WHERE pii_{n} > 0) AS rows, "
        f"CAST(SUM(pii_{n}) AS BIGINT) AS matches FROM {last}" for n in PII_TYPES)
    return f"WITH {ctes}\n{rows}"


def pii_messages_sql() -> str:
    from ..functions.pii import PII_TYPES
    ctes, last = pii_chain_sql(
        "(SELECT conv_id AS conversation_id, turn, upper(role) AS role, text AS content FROM conversations)",
        "content")
    counts = ", ".join(f"pii_{n}" for n in PII_TYPES)
    return (f"WITH {ctes}\nSELECT conversation_id, turn, role, __t AS content_redacted, {counts}, "
            f"{' + '.join('pii_' + n for n in PII_TYPES)} AS pii_total FROM {last}")


def pii_detection_report_sql() -> str:
    from ..functions.pii import PII_TYPES
    req, req_last = pii_chain_sql("(SELECT doc_id, COALESCE(text, '') AS req FROM documents)", "req", "rq_", "rq")
    resp, resp_last = pii_chain_sql("(SELECT doc_id, source AS resp FROM documents)", "resp", "rs_", "rs")
    sides = " UNION ALL ".join(
        f"SELECT '{n}' AS type, {pfx}{n} AS c FROM {last}"
        for last, pfx in ((req_last, "rq_"), (resp_last, "rs_")) for n in PII_TYPES)
    return f"""WITH {req},
{resp}
SELECT type, CAST(SUM(c) AS BIGINT) AS total_count, COUNT(*) AS rows_with_type
FROM ({sides}) u WHERE c > 0 GROUP BY type"""


# --- validation / merge ---------------------------------------------------------------------------

RAW_EVENTS = """
raw AS (
  SELECT event_id, ts AS received_at, CASE WHEN event_id % 7 = 0 THEN event_id - event_id % 14 ELSE event_id END AS id,
   CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'view' THEN 'bogus' ELSE 'success' END AS status,
   CAST(FLOOR(value * 20) AS INT) - 40 AS latency_ms,
   CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(event_id % 1951 AS INT) END AS prompt_tokens
  FROM events
)"""

RAW_REASONS = """
checked AS (
  SELECT *, list_filter([
    CASE WHEN NOT COALESCE(id IS NOT NULL, FALSE) THEN 'missing_id' END,
    CASE WHEN NOT COALESCE(latency_ms IS NOT NULL, FALSE) THEN 'missing_latency_ms' END,
    CASE WHEN NOT COALESCE(length(lpad(CAST(id AS VARCHAR), 10, '0')) >= 10, FALSE) THEN 'id_too_short' END,
    CASE WHEN NOT COALESCE(latency_ms >= 0, FALSE) THEN 'negative_latency_ms' END,
    CASE WHEN NOT COALESCE(upper(COALESCE(status, 'success')) IN ('SUCCESS','ERROR','CANCELLED','TIMEOUT'), FALSE)
      THEN 'bad_status' END], lambda x: x IS NOT NULL) AS reasons
  FROM raw
)"""


def validate_report_sql() -> str:
    return f"""WITH {RAW_EVENTS}, {RAW_REASONS}
SELECT reason, COUNT(*) AS rows FROM (
  SELECT unnest(CASE WHEN len(reasons) = 0 THEN ['accepted'] ELSE reasons END) AS reason FROM checked
) u GROUP BY reason"""


def upsert_fold_sql() -> str:
    return f"""WITH {RAW_EVENTS}, {RAW_REASONS}
SELECT id, arg_max_null(upper(COALESCE(status, 'success')), event_id) AS status,
  arg_min_null(latency_ms, event_id) AS latency_ms, arg_max_null(prompt_tokens, event_id) AS prompt_tokens,
  arg_min_null(received_at, event_id) AS created_at, COUNT(*) AS versions
FROM checked WHERE len(reasons) = 0 GROUP BY id"""


def replay_failed_sql() -> str:
    return f"""WITH {RAW_EVENTS}, {RAW_REASONS}
SELECT event_id, 'FAILED' AS status, array_to_string(reasons, ',') AS error, 1 AS attempts
FROM checked WHERE len(reasons) > 0"""


PAYLOAD_EVENTS = """
pe AS (
  SELECT event_id, ts AS received_at,
   'evt-' || lpad(CAST(CASE WHEN event_id % 7 = 0 THEN event_id - event_id % 14 ELSE event_id END AS VARCHAR), 8, '0') AS id,
   CAST(user_id AS VARCHAR) AS conversation_id,
   CASE event_id % 4 WHEN 0 THEN 'OPENAI' WHEN 1 THEN 'ANTHROPIC' WHEN 2 THEN 'GOOGLE' ELSE 'OTHER' END AS provider,
   CASE event_id % 4 WHEN 0 THEN 'openai' WHEN 1 THEN 'anthropic' WHEN 2 THEN 'google' ELSE 'ollama' END AS provider_raw,
   CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 = 0 THEN 'gpt-4o-mini' ELSE 'gpt-4o' END
     WHEN 1 THEN 'claude-3-5-haiku-latest' WHEN 2 THEN 'gemini-1.5-flash'
     ELSE CASE WHEN event_id % 8 = 3 THEN 'gemma3:4b' ELSE 'llama3.2:latest' END END AS model,
   CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type = 'view' THEN 'BOGUS' ELSE 'SUCCESS' END AS status,
   CASE WHEN event_type = 'error' THEN 'upstream_error' END AS error_type,
   CAST(FLOOR(value * 20) AS INT) - 40 AS latency_ms,
   CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(80 + (event_id * 11) % 421 AS INT) END AS ttft_ms,
   event_id % 5 > 1 AS streamed,
   CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(50 + (event_id * 37) % 1951 AS INT) END AS prompt_tokens,
   CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST(20 + (event_id * 53) % 781 AS INT) END AS completion_tokens,
   NULLIF(substring(props, 1, 256), '') AS input_preview,
   NULLIF(substring(event_type, 1, 256), '') AS output_preview
  FROM events
)"""


def ingest_events_sql() -> str:
    k = "struct_pack(a := received_at, b := event_id)"
    return f"""WITH {PAYLOAD_EVENTS}
SELECT id, arg_min_null(conversation_id, {k}) AS conversation_id, arg_min_null(provider, {k}) AS provider,
  arg_min_null(provider_raw, {k}) AS provider_raw, arg_min_null(model, {k}) AS model,
  arg_max_null(status, {k}) AS status, arg_max_null(error_type, {k}) AS error_type,
  arg_min_null(latency_ms, {k}) AS latency_ms, arg_min_null(ttft_ms, {k}) AS ttft_ms,
  arg_min_null(streamed, {k}) AS streamed,
  arg_max_null(prompt_tokens, {k}) AS prompt_tokens, arg_max_null(completion_tokens, {k}) AS completion_tokens,
  arg_max_null(CASE WHEN COALESCE(prompt_tokens, 0) <> 0 OR COALESCE(completion_tokens, 0) <> 0
    THEN COALESCE(prompt_tokens, 0) + COALESCE(completion_tokens, 0) END, {k}) AS total_tokens,
  arg_max_null(input_preview, {k}) AS input_preview, arg_max_null(output_preview, {k}) AS output_preview,
  'dev' AS environment, arg_min_null(received_at, {k}) AS created_at, COUNT(*) AS versions
FROM pe WHERE status <> 'BOGUS' AND latency_ms >= 0 GROUP BY id"""


def event_status_counts_sql() -> str:
    return f"""WITH {PAYLOAD_EVENTS}
SELECT CASE WHEN status <> 'BOGUS' AND latency_ms >= 0 THEN 'PROCESSED' ELSE 'FAILED' END AS status,
  COUNT(*) AS events FROM pe GROUP BY 1"""


def orphan_check_sql() -> str:
    return with_logs("""
SELECT id, conversation_id FROM logs l
WHERE conversation_id IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = l.conversation_id)""")


# --- rollups --------------------------------------------------------------------------------------

ROLLUP_AGGS = """COUNT(*) AS count_total, COUNT(*) FILTER (WHERE status = 'ERROR') AS count_error,
  CAST(SUM(latency_ms) AS BIGINT) AS sum_latency_ms, COUNT(ttft_ms) AS count_ttft,
  CAST(SUM(ttft_ms) AS BIGINT) AS sum_ttft_ms, CAST(SUM(prompt_tokens) AS BIGINT) AS sum_prompt_tokens,
  CAST(SUM(completion_tokens) AS BIGINT) AS sum_completion_tokens, CAST(SUM(cost_usd) AS DOUBLE) AS sum_cost_usd"""


def rollup_sql(width: str = "INTERVAL 1 MINUTE") -> str:
    return with_logs(f"""
SELECT time_bucket({width}, created_at, TIMESTAMP '2000-01-01') AS bucket, provider, model, {ROLLUP_AGGS}
FROM logs GROUP BY 1, 2, 3""")


def rollup_plus_tail_sql(range_key: str = "7d") -> str:
    return with_logs(f"""
SELECT '{range_key}' AS range_name, CAST(total AS BIGINT) AS total_requests,
  {half_even_ratio_sql('errors', 'total')} AS error_rate,
  {trunc_long('sum_ttft / n_ttft')} AS avg_ttft_ms,
  {trunc_long('sum_lat / total')} AS avg_latency_ms,
  COALESCE(CAST(sp AS BIGINT), 0) AS total_prompt_tokens, COALESCE(CAST(sc AS BIGINT), 0) AS total_completion_tokens,
  COALESCE(CAST(cost AS DOUBLE), 0.0) AS total_cost_usd
FROM (SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE status = 'ERROR') AS errors,
  CAST(SUM(ttft_ms) AS DOUBLE) AS sum_ttft, COUNT(ttft_ms) AS n_ttft, CAST(SUM(latency_ms) AS DOUBLE) AS sum_lat,
  SUM(prompt_tokens) AS sp, SUM(completion_tokens) AS sc, SUM(cost_usd) AS cost
  FROM logs WHERE {in_range_sql(range_key)}) s""")


# --- conversations --------------------------------------------------------------------------------

CONV_CTES = """
msgs AS (SELECT conv_id AS conversation_id, turn, upper(role) AS role, text AS content FROM conversations),
m AS (
  SELECT conversation_id,
    arg_min_null(CASE WHEN role = 'USER' THEN content END, CASE WHEN role = 'USER' THEN turn END)
      FILTER (WHERE role = 'USER') AS first_user,
    COUNT(*) AS message_count, arg_max_null(content, turn) AS last_message_preview, MAX(turn) AS last_turn
  FROM msgs GROUP BY conversation_id
),
lg AS (
  SELECT conversation_id, MIN(created_at) AS created_at, MAX(created_at) AS updated_at,
    arg_min_null(provider, created_at) AS provider, arg_min_null(model, created_at) AS model
  FROM logs GROUP BY conversation_id
),
convs AS (
  SELECT m.conversation_id, COALESCE(NULLIF(substring(first_user, 1, 60), ''), 'New conversation') AS title,
    'ACTIVE' AS status, lg.provider, lg.model, message_count, last_turn, last_message_preview,
    lg.created_at, lg.updated_at
  FROM m LEFT JOIN lg ON m.conversation_id = lg.conversation_id
)"""


def conv_sql(body: str) -> str:
    body = body.lstrip()
    sep = "" if body.startswith(",") else "\n"
    return with_logs(f", {CONV_CTES}{sep}{body}")


def conversation_list_sql() -> str:
    return conv_sql("SELECT * FROM convs WHERE status <> 'ARCHIVED' "
                    "ORDER BY updated_at DESC NULLS LAST, conversation_id LIMIT 50")


def conversation_thread_sql() -> str:
    return conv_sql("SELECT c.conversation_id, title, status, turn, role, content "
                    "FROM convs c LEFT JOIN msgs m ON c.conversation_id = m.conversation_id")


def context_sql(limit: int = 20) -> str:
    return conv_sql(f"""
, recent AS (
  SELECT conversation_id, lower(role) AS role, content,
    row_number() OVER (PARTITION BY conversation_id ORDER BY turn DESC) AS rn FROM msgs
), hist AS (SELECT * FROM recent WHERE rn <= {limit}),
n AS (SELECT conversation_id, COUNT(*) AS cnt FROM hist GROUP BY conversation_id)
SELECT conversation_id, 0 AS pos, 'system' AS role, 'You are a helpful assistant.' AS content FROM n
UNION ALL
SELECT h.conversation_id, CAST(cnt - rn + 1 AS INT) AS pos, role, content FROM hist h JOIN n USING (conversation_id)
UNION ALL
SELECT conversation_id, CAST(cnt + 1 AS INT) AS pos, 'user' AS role, 'continue' AS content FROM n""".lstrip())


def last_message_sql() -> str:
    return conv_sql("SELECT conversation_id, MAX(turn) AS last_turn, arg_max_null(role, turn) AS last_role, "
                    "arg_max_null(content, turn) AS last_message_preview FROM msgs GROUP BY conversation_id")


def usage_per_conversation_sql() -> str:
    return conv_sql("""SELECT c.conversation_id, c.title, COUNT(l.id) AS calls,
  COUNT(*) FILTER (WHERE l.status = 'ERROR') AS errors, CAST(SUM(l.total_tokens) AS BIGINT) AS total_tokens,
  CAST(SUM(l.cost_usd) AS DOUBLE) AS cost_usd
FROM convs c LEFT JOIN logs l ON c.conversation_id = l.conversation_id GROUP BY c.conversation_id, c.title""")


def archive_sql() -> str:
    return conv_sql(f"""SELECT conversation_id,
  CASE WHEN conversation_id IN (SELECT conversation_id FROM logs WHERE status = 'ERROR' AND {in_range_sql('24h')})
    THEN 'ARCHIVED' ELSE status END AS status,
  CASE WHEN conversation_id IN (SELECT conversation_id FROM logs WHERE status = 'ERROR' AND {in_range_sql('24h')})
    THEN {AS_OF} ELSE updated_at END AS updated_at
FROM convs""")


# --- spans ------------------------------------------------------------------------------------------

CHUNKS = """
chunks AS (
  SELECT CAST(user_id AS VARCHAR) AS span_id, event_id AS seq, ts,
   CASE WHEN event_type = 'view' THEN '' ELSE substr(event_type, 1, 2) END AS delta,
   CASE WHEN event_type = 'signup' THEN CAST(event_id % 500 AS INT) END AS prompt_tokens,
   CASE WHEN event_type = 'purchase' THEN CAST(event_id % 300 AS INT) END AS completion_tokens,
   event_type = 'error' AS is_error FROM events
)"""


def span_assembly_sql() -> str:
    return f"""WITH {CHUNKS},
ends AS (SELECT span_id, MIN(seq) AS end_seq FROM chunks WHERE is_error GROUP BY span_id),
k AS (SELECT c.*, e.end_seq FROM chunks c LEFT JOIN ends e ON c.span_id = e.span_id
      WHERE e.end_seq IS NULL OR c.seq <= e.end_seq),
a AS (
  SELECT span_id, MIN(ts) AS started_at, MAX(ts) AS last_ts,
    MIN(CASE WHEN NOT is_error AND delta <> '' THEN ts END) AS first_token_ts,
    arg_max(prompt_tokens, seq) FILTER (WHERE prompt_tokens IS NOT NULL) AS prompt_tokens,
    arg_max(completion_tokens, seq) FILTER (WHERE completion_tokens IS NOT NULL) AS completion_tokens,
    COUNT(*) FILTER (WHERE NOT is_error) AS chunk_count,
    substring(COALESCE(string_agg(CASE WHEN NOT is_error AND delta <> '' THEN delta END, '' ORDER BY seq), ''),
              1, 2048) AS output_text,
    MAX(end_seq) AS end_seq, MIN(ts) FILTER (WHERE seq = end_seq) AS end_ts
  FROM k GROUP BY span_id
)
SELECT span_id, CASE WHEN end_seq IS NOT NULL THEN 'ERROR' ELSE 'SUCCESS' END AS status, started_at,
  COALESCE(end_ts, last_ts) AS ended_at,
  CAST((epoch_us(COALESCE(end_ts, last_ts)) - epoch_us(started_at)) // 1000 AS BIGINT) AS latency_ms,
  CAST((epoch_us(first_token_ts) - epoch_us(started_at)) // 1000 AS BIGINT) AS ttft_ms,
  output_text, prompt_tokens, completion_tokens,
  CASE WHEN COALESCE(prompt_tokens, 0) <> 0 OR COALESCE(completion_tokens, 0) <> 0
    THEN COALESCE(prompt_tokens, 0) + COALESCE(completion_tokens, 0) END AS total_tokens,
  chunk_count, CAST(NULL AS VARCHAR) AS error_type, CAST(NULL AS VARCHAR) AS error_message, TRUE AS streamed
FROM a"""


# --- reports / classification -------------------------------------------------------------------------

def model_catalog_sql() -> str:
    return with_logs("""
SELECT provider_raw, string_agg(model, ',' ORDER BY model) AS models, COUNT(*) AS model_count
FROM (SELECT DISTINCT provider_raw, model FROM logs) d GROUP BY provider_raw""")


def duplicate_inputs_sql() -> str:
    return with_logs("""
SELECT sha256(text) AS input_hash, COUNT(*) AS calls, MIN(created_at) AS first_seen,
  MAX(created_at) AS last_seen
FROM logs JOIN documents ON documents.doc_id = logs.event_id WHERE text <> '' GROUP BY 1 HAVING COUNT(*) > 1""")


def live_feed_sql(n: int = 50) -> str:
    return with_logs(f"""
SELECT id, provider_raw AS provider, model, lower(status) AS status, latency_ms, ttft_ms, prompt_tokens,
  completion_tokens, CAST(cost_usd AS DOUBLE) AS cost_usd, conversation_id, created_at
FROM logs ORDER BY created_at DESC, id DESC LIMIT {n}""")


def _duck_url_cols(u: str = "url") -> str:
    norm = (f"(CASE WHEN lower(regexp_replace(trim({u}), '/+$', '')) LIKE 'bedrock:%' "
            f"OR regexp_replace(trim({u}), '/+$', '') LIKE 'http://%' "
            f"OR regexp_replace(trim({u}), '/+$', '') LIKE 'https://%' "
            f"THEN regexp_replace(trim({u}), '/+$', '') ELSE 'http://' || regexp_replace(trim({u}), '/+$', '') END)")
    lu = f"lower(trim({norm}))"
    bedrock = (f"({lu} LIKE 'bedrock://%' OR {lu} LIKE 'bedrock:%' OR "
               f"(contains({lu}, 'bedrock') AND (contains({lu}, 'amazonaws.com') OR contains({lu}, '.api.aws'))))")
    prov = (f"CASE WHEN {bedrock} THEN 'bedrock' WHEN contains({norm}, 'api.openai.com') THEN 'openai' "
            f"WHEN contains({norm}, 'api.anthropic.com') THEN 'anthropic' "
            f"WHEN contains({norm}, 'generativelanguage.googleapis.com') THEN 'google' "
            f"WHEN contains({norm}, 'openai.azure.com') THEN 'openai' ELSE 'openai_compatible' END")
    client = (f"CASE WHEN {u} IS NULL OR {u} = '' OR contains({u}, 'api.openai.com') THEN 'openai' "
              f"WHEN contains({u}, '11434') OR contains(lower({u}), 'ollama') THEN 'ollama' "
              f"WHEN contains({u}, 'openai.azure.com') THEN 'openai' ELSE 'openai_compatible' END")
    raw = f"lower(trim({u}))"
    tu = f"trim({u})"

    def after(n: int) -> str:
        return (f"NULLIF(split_part(regexp_replace(regexp_replace(substring({tu}, {n + 1}), '^/+', ''), "
                f"'/+$', ''), '/', 1), '')")
    from ..functions.urls import BEDROCK_REGION_PATTERNS
    host_region = "COALESCE(" + ", ".join(
        f"NULLIF(regexp_extract({raw}, '{p}', 1), '')" for p in BEDROCK_REGION_PATTERNS) + ", 'us-east-1')"
    region = (f"CASE WHEN {raw} LIKE 'bedrock://%' THEN COALESCE({after(10)}, 'us-east-1') "
              f"WHEN {raw} LIKE 'bedrock:%' THEN COALESCE({after(8)}, 'us-east-1') ELSE {host_region} END")
    netloc = f"regexp_extract({norm}, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1)"
    host = f"NULLIF(lower(regexp_replace(regexp_replace({netloc}, '^.*@', ''), ':[0-9]*$', '')), '')"
    port = f"TRY_CAST(NULLIF(regexp_extract({netloc}, ':([0-9]+)$', 1), '') AS BIGINT)"
    key = (f"CASE WHEN ({prov}) IN ('openai','anthropic','google','bedrock','ollama') THEN ({prov}) "
           f"ELSE 'custom_' || replace(COALESCE({host}, 'endpoint'), '.', '_') || "
           f"CASE WHEN {port} IS NOT NULL AND {port} <> 0 THEN '_' || CAST({port} AS VARCHAR) ELSE '' END END")
    return (f"{client} AS client_provider, {prov} AS provider, {bedrock} AS is_bedrock, "
            f"CASE WHEN {bedrock} THEN {region} END AS bedrock_region, {key} AS endpoint_key")


def classify_urls_sql() -> str:
    return f"SELECT page_id, url, {_duck_url_cols('url')} FROM pages"


def dedupe_keys_sql() -> str:
    return f"""WITH c AS (SELECT page_id, url, {_duck_url_cols('url')} FROM pages),
r AS (SELECT page_id, endpoint_key, row_number() OVER (PARTITION BY endpoint_key ORDER BY page_id) AS rk FROM c)
SELECT page_id, endpoint_key, CASE WHEN rk = 1 THEN endpoint_key ELSE endpoint_key || '_' || CAST(rk AS VARCHAR) END
  AS dedup_key FROM r"""


def model_family_sql() -> str:
    from ..functions.urls import MODEL_FAMILY_PREFIXES
    cases = " ".join(f"WHEN starts_with(lower(model), '{p}') THEN '{f}'" for p, f in MODEL_FAMILY_PREFIXES)
    return with_logs(f"""
SELECT model, COUNT(*) AS calls, CASE {cases} ELSE 'bedrock' END AS family FROM logs GROUP BY model""")


def normalize_bodies_sql() -> str:
    return """SELECT event_id,
  CASE event_type WHEN 'click' THEN 'anthropic' WHEN 'view' THEN 'bedrock' WHEN 'purchase' THEN 'bedrock'
    WHEN 'signup' THEN 'openai' ELSE 'google' END AS provider,
  CASE event_type WHEN 'click' THEN 'claude-3-5-haiku-latest' WHEN 'view' THEN 'amazon.titan-text-express-v1'
    WHEN 'purchase' THEN 'meta.llama3-8b-instruct-v1:0' WHEN 'signup' THEN 'gpt-4o' ELSE 'gemini-1.5-flash' END AS model,
  CASE WHEN event_type IN ('signup', 'error') THEN 2 ELSE 1 END AS n_messages,
  substring(props, 1, 500) AS last_content,
  CAST(CASE event_type WHEN 'click' THEN event_id % 500 WHEN 'view' THEN event_id % 100
    WHEN 'signup' THEN event_id % 700 WHEN 'error' THEN event_id % 800 END AS INT) AS prompt_tokens,
  CAST(CASE event_type WHEN 'click' THEN event_id % 300 WHEN 'view' THEN event_id % 50
    WHEN 'signup' THEN event_id % 90 WHEN 'error' THEN event_id % 70 END AS INT) AS completion_tokens,
  CASE event_type WHEN 'click' THEN 'c' || CAST(event_id AS VARCHAR) WHEN 'view' THEN 'v' || CAST(event_id AS VARCHAR)
    WHEN 'purchase' THEN 'p' || CAST(event_id AS VARCHAR) ELSE '' END AS output_text,
  CASE event_type WHEN 'view' THEN 'amazon' WHEN 'purchase' THEN 'meta' ELSE 'bedrock' END AS model_family,
  CASE event_type WHEN 'error' THEN 'model,user' ELSE 'user' END AS chat_roles,
  CASE event_type WHEN 'signup' THEN 'be brief' END AS system_prompt
FROM events"""


def normalize_events_sql() -> str:
    return f"""WITH {RAW_EVENTS}
SELECT event_id, lpad(CAST(id AS VARCHAR), 10, '0') AS id, upper(COALESCE(status, 'success')) AS status,
  upper(COALESCE(status, 'success')) IN ('SUCCESS','ERROR','CANCELLED','TIMEOUT') AS status_in_domain,
  COALESCE(latency_ms, 0) AS latency_ms, prompt_tokens,
  CASE WHEN COALESCE(prompt_tokens, 0) <> 0 THEN COALESCE(prompt_tokens, 0) END AS total_tokens,
  received_at AS created_at
FROM raw"""


def multi_series_sql(range_key: str = "7d") -> str:
    t = f"time_bucket({BUCKET_SQL[range_key]}, created_at, TIMESTAMP '2000-01-01')"
    return with_logs(f"""
SELECT {t} AS t, CAST(COUNT(*) AS DOUBLE) AS requests,
  CAST(COUNT(*) FILTER (WHERE status = 'ERROR') AS DOUBLE) AS errors,
  COALESCE(CAST(SUM(cost_usd) AS DOUBLE), 0.0) AS cost, COALESCE(CAST(SUM(total_tokens) AS DOUBLE), 0.0) AS tokens,
  round(PERCENTILE_CONT(0.50) WITHIN GROUP (ORDER BY latency_ms), 6) AS latency_p50,
  round(PERCENTILE_CONT(0.95) WITHIN GROUP (ORDER BY latency_ms), 6) AS latency_p95
FROM logs WHERE {in_range_sql(range_key)} GROUP BY 1""")


def event_lifecycle_sql() -> str:
    return f"""WITH {PAYLOAD_EVENTS}
SELECT event_id, received_at,
  CASE WHEN status <> 'BOGUS' AND latency_ms >= 0 THEN 'PROCESSED' ELSE 'FAILED' END AS status,
  CASE WHEN status <> 'BOGUS' AND latency_ms >= 0 THEN received_at END AS processed_at,
  NULLIF(concat_ws(',', CASE WHEN latency_ms < 0 THEN 'negative_latency_ms' END,
                        CASE WHEN status = 'BOGUS' THEN 'bad_status' END), '') AS error
FROM pe"""


def conversations_dim_sql() -> str:
    return conv_sql("SELECT * FROM convs")


def pii_json_docs_sql() -> str:
    """The deep JSON redaction = the chain over each string value (text, lang, source), with its texts and summed counts."""
    from ..functions.pii import PII_TYPES
    ctes, lasts = [], []
    for col in ("text", "lang", "source"):
        own, last = pii_chain_sql(f"(SELECT doc_id, {col} AS v FROM documents)", "v", "p_", f"c{col}")
        ctes.append(own)
        lasts.append(last)
    sums = ", ".join("CAST(" + " + ".join(f"{x}.p_{n}" for x in "tls") + f" AS INT) AS pii_{n}" for n in PII_TYPES)
    return (f"WITH {', '.join(ctes)}\nSELECT t.doc_id, t.__t AS body, l.__t AS lang, s.__t AS source, {sums} "
            f"FROM {lasts[0]} t JOIN {lasts[1]} l USING (doc_id) JOIN {lasts[2]} s USING (doc_id)")


def approx_percentiles_sql(range_key: str = "30d") -> str:
    """Percentile estimates from log-spaced latency histograms (same bucket bounds and interpolation)."""
    from ..operators.rollup import HIST_BOUNDS, HIST_BUCKETS
    bounds = "[" + ", ".join(str(b) for b in HIST_BOUNDS) + "]"
    cols = []
    for q in (0.5, 0.95, 0.99):
        cols.append(f"""(SELECT round(
            (CAST({bounds}[idx + 1] AS DOUBLE) - 1)
            + ((CAST({bounds}[idx + 2] AS DOUBLE) - 1) - (CAST({bounds}[idx + 1] AS DOUBLE) - 1))
              * LEAST(GREATEST(({q} * (n - 1) - (cum - c) + 0.5) / c, 0.0), 1.0), 6)
          FROM hc WHERE cum > {q} * (n - 1) ORDER BY idx LIMIT 1) AS p{int(q * 100)}_latency_ms_approx""")
    return with_logs(f""", hb AS (
  SELECT LEAST(len(list_filter({bounds}[2:{HIST_BUCKETS + 1}], lambda b: b <= GREATEST(latency_ms, 0) + 1)),
               {HIST_BUCKETS - 1}) AS idx
  FROM logs WHERE {in_range_sql(range_key)}
), h AS (SELECT idx, COUNT(*) AS c FROM hb GROUP BY idx),
hc AS (SELECT idx, c, SUM(c) OVER (ORDER BY idx) AS cum, SUM(c) OVER () AS n FROM h)
SELECT '{range_key}' AS range_name, (SELECT CAST(COUNT(*) AS BIGINT) FROM hb) AS total_requests,
  {", ".join(cols)}""")


# --- spans that end in every way, and their facts ---------------------------------------------------------

ENDED_SPANS = """
chunks AS (
  SELECT 'span-' || lpad(CAST(user_id AS VARCHAR), 8, '0') || '-' || CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) // 5 AS VARCHAR) AS span_id,
   event_id AS seq, ts, CASE WHEN event_type = 'view' THEN '' ELSE substr(event_type, 1, 2) END AS delta,
   CASE WHEN event_type <> 'error' THEN CAST(event_id % 500 AS INT) END AS prompt_tokens,
   CASE WHEN event_type = 'purchase' THEN CAST(event_id % 300 AS INT) END AS completion_tokens,
   CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' AND event_id % 2 = 0 THEN 'end'
     WHEN event_type = 'signup' THEN 'cancelled' ELSE 'chunk' END AS kind,
   CASE WHEN event_type = 'error' THEN 'upstream_error' END AS error_type, CASE WHEN event_type = 'error' THEN props END AS error_message
  FROM events
),
ends AS (SELECT span_id, seq AS end_seq, ts AS end_ts, kind AS end_kind, error_type, error_message FROM chunks WHERE kind <> 'chunk'
         QUALIFY row_number() OVER (PARTITION BY span_id ORDER BY seq) = 1),
a AS (
  SELECT c.span_id, MIN(ts) AS started_at, MAX(ts) AS last_ts, MIN(CASE WHEN kind = 'chunk' AND delta <> '' THEN ts END) AS first_token_ts,
    arg_max(prompt_tokens, seq) FILTER (WHERE prompt_tokens IS NOT NULL) AS prompt_tokens,
    arg_max(completion_tokens, seq) FILTER (WHERE completion_tokens IS NOT NULL) AS completion_tokens,
    COUNT(*) FILTER (WHERE kind = 'chunk') AS chunk_count,
    substring(COALESCE(string_agg(CASE WHEN kind = 'chunk' AND delta <> '' THEN delta END, '' ORDER BY seq), ''), 1, 2048) AS output_text
  FROM chunks c LEFT JOIN ends e ON c.span_id = e.span_id WHERE e.end_seq IS NULL OR c.seq <= e.end_seq GROUP BY c.span_id
),
spans AS (
  SELECT a.span_id, CASE end_kind WHEN 'error' THEN 'ERROR' WHEN 'cancelled' THEN 'CANCELLED' WHEN 'end' THEN 'SUCCESS'
      ELSE CASE WHEN last_ts < (SELECT MAX(ts) FROM chunks) - INTERVAL 1 DAY - INTERVAL 10 MINUTE THEN 'TIMEOUT' ELSE 'SUCCESS' END END AS status,
    started_at, COALESCE(end_ts, last_ts) AS ended_at,
    CAST((epoch_us(COALESCE(end_ts, last_ts)) - epoch_us(started_at)) // 1000 AS BIGINT) AS latency_ms,
    CAST((epoch_us(first_token_ts) - epoch_us(started_at)) // 1000 AS BIGINT) AS ttft_ms, output_text, prompt_tokens, completion_tokens,
    CASE WHEN COALESCE(prompt_tokens, 0) <> 0 OR COALESCE(completion_tokens, 0) <> 0
      THEN COALESCE(prompt_tokens, 0) + COALESCE(completion_tokens, 0) END AS total_tokens, chunk_count,
    CASE WHEN end_kind = 'error' THEN error_type END AS error_type,
    CASE WHEN end_kind = 'error' THEN substring(error_message, 1, 500) END AS error_message, TRUE AS streamed
  FROM a LEFT JOIN ends e ON a.span_id = e.span_id
)"""


def ended_spans_sql() -> str:
    return f"WITH {ENDED_SPANS} SELECT * FROM spans"


def span_facts_sql() -> str:
    asked = "'mail [REDACTED_EMAIL] ' || repeat('x', 500 - length('mail user00000000@example.com '))"
    return f"""WITH {ENDED_SPANS}
SELECT span_id AS id, status, error_type, error_message, CAST(latency_ms AS INT) AS latency_ms, CAST(ttft_ms AS INT) AS ttft_ms,
  prompt_tokens, completion_tokens, total_tokens,
  CAST(CAST(CAST(0.000000150 AS DECIMAL(12,9)) * prompt_tokens + CAST(0.000000600 AS DECIMAL(12,9)) * completion_tokens AS DECIMAL(12,6)) AS DOUBLE) AS cost_usd,
  substring({asked}, 1, 256) AS input_preview, NULLIF(substring(output_text, 1, 256), '') AS output_preview,
  '{{"messages":[{{"role":"user","content":"' || {asked} || '"}}]}}' AS request_payload,
  sha256('{{"messages":[{{"role":"user","content":"' || {asked} || '"}}]}}') AS input_hash,
  '[{{"type":"email","count":1}}]' AS pii_detections, ended_at AS created_at
FROM spans"""


# --- ingest: loose types, parents and replay ----------------------------------------------------------------

def loose_types_sql() -> str:
    return """
WITH w AS (SELECT event_id, event_id % 12 = 3 AS bad_switch, event_id % 9 = 8 AS bad_tokens, event_id % 14 = 5 AS bad_cost FROM events)
SELECT event_id, CASE WHEN bad_switch OR bad_tokens OR bad_cost THEN 'FAILED' ELSE 'PROCESSED' END AS status,
  NULLIF(concat_ws(',', CASE WHEN bad_switch THEN 'bad_streamed' END, CASE WHEN bad_tokens THEN 'bad_prompt_tokens' END,
                   CASE WHEN bad_cost THEN 'bad_cost_usd' END), '') AS error,
  CASE WHEN NOT (bad_switch OR bad_tokens OR bad_cost) THEN event_id % 4 IN (0, 2) END AS streamed,
  CASE WHEN NOT (bad_switch OR bad_tokens OR bad_cost) THEN CAST(CASE event_id % 3 WHEN 0 THEN 37 WHEN 1 THEN 7 ELSE 5 END AS INT) END AS prompt_tokens,
  CASE WHEN NOT (bad_switch OR bad_tokens OR bad_cost) THEN CASE WHEN event_id % 2 = 0 THEN CAST(0.01 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END END AS cost_usd
FROM w"""


def replay_parents_sql() -> str:
    return f"""WITH {PAYLOAD_EVENTS},
k AS (SELECT pe.*, conversation_id IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations) AS known,
  conversation_id IN (SELECT CAST(conv_id AS VARCHAR) FROM conversations WHERE conv_id % 3 <> 0) AS known_first FROM pe)
SELECT event_id, CASE WHEN latency_ms >= 0 AND status <> 'BOGUS' AND known THEN 'PROCESSED' ELSE 'FAILED' END AS status,
  NULLIF(concat_ws(',', CASE WHEN latency_ms < 0 THEN 'negative_latency_ms' END, CASE WHEN status = 'BOGUS' THEN 'bad_status' END,
                   CASE WHEN NOT known THEN 'unknown_conversation' END), '') AS error,
  CASE WHEN latency_ms >= 0 AND status <> 'BOGUS' AND known_first THEN 1 ELSE 2 END AS attempts FROM k"""


# --- rows that reach every branch -------------------------------------------------------------------

def pii_types_sql() -> str:
    from ..functions.pii import PII_TYPES
    from ..sources.fixtures import PLANTED_TEXT
    ctes, last = pii_chain_sql(f"(SELECT doc_id, {PLANTED_TEXT} AS text FROM documents)", "text")
    return f"WITH {ctes}\nSELECT doc_id, __t AS text_redacted, {', '.join(f'pii_{n}' for n in PII_TYPES)} FROM {last}"


def url_forms_sql() -> str:
    from ..sources.fixtures import URL_FORMS
    return f"SELECT page_id, url, {_duck_url_cols('url')} FROM (SELECT page_id, {URL_FORMS} AS url FROM pages) p"


def model_ids_sql() -> str:
    from ..functions.urls import MODEL_FAMILY_PREFIXES
    from ..sources.fixtures import MODEL_IDS
    cases = " ".join(f"WHEN starts_with(lower(model), '{p}') THEN '{f}'" for p, f in MODEL_FAMILY_PREFIXES)
    return f"""SELECT model, COUNT(*) AS calls, CASE {cases} ELSE 'bedrock' END AS family
FROM (SELECT {MODEL_IDS} AS model FROM events) e GROUP BY model"""
