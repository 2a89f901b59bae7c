"""Check SQL of the streaming queries."""

SQL = {
    "stream_ingest": """
SELECT problems = '' AS accepted, problems, count(*)::BIGINT AS n, sum(y)::BIGINT AS total FROM (
SELECT y, array_to_string(list_filter([
  CASE WHEN bad_year THEN 'year' END, CASE WHEN bad_month THEN 'month' END, CASE WHEN bad_code THEN 'code' END, CASE WHEN bad_label THEN 'label' END,
  CASE WHEN bad_count THEN 'count' ELSE status_error END], lambda x: x IS NOT NULL), ',') AS problems FROM problem) GROUP BY problems""",
    "stream_rollup": """
SELECT event_type, strftime(d, '%Y-%m-%d') AS day, n, d + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY AS closed_by_stream
FROM (SELECT event_type, date_trunc('day', ts) AS d, count(*)::BIGINT AS n FROM events GROUP BY ALL)""",
    "stream_dedupe": "SELECT event_id, user_id, event_type FROM events",
    "revision_log": """
SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, event_id, value,
  row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d'), event_type ORDER BY event_id) AS revision,
  count(*) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d'), event_type) AS n_revisions,
  event_id = max(event_id) OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d'), event_type) AS is_latest FROM events""",
}
