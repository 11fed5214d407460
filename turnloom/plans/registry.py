"""Where queries register, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

SEGMENTS = """v_segments AS (
  SELECT event_id AS id, CAST(ts AS DATE) AS rec, user_id % 4 AS speaker, 0 AS channel, epoch_us(ts) AS start_us,
    CAST(round(value * 1e6) AS BIGINT) AS dur_us FROM events)"""
RECORDINGS = """v_recordings AS (
  SELECT DATE '2024-01-01' + CAST(i AS INTEGER) AS rec, 16000 AS sampling_rate, CAST(i % 2 + 1 AS INTEGER) AS channels FROM range(34) t(i))"""
WORDS = """w0 AS (
  SELECT conv_id, turn, role, unnest(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> '')) AS symbol,
    generate_subscripts(list_filter(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), lambda x: x <> ''), 1) - 1 AS idx
  FROM conversations WHERE text IS NOT NULL), v_words AS (
  SELECT conv_id, turn, role, CAST(idx AS INTEGER) AS idx, symbol, CAST(length(symbol) * 60000 AS BIGINT) AS dur_us,
    CAST(coalesce(sum(length(symbol) * 60000 + CASE WHEN right(symbol, 1) IN ('.', ',', '!', '?') THEN 350000 ELSE 50000 END)
      OVER (PARTITION BY conv_id, turn ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 100000 AS BIGINT) AS start_us
  FROM w0)"""
CUTS = WORDS + """, v_cuts AS (
  SELECT conv_id || '_' || turn AS cut_id, conv_id, turn, role AS speaker, max(start_us + dur_us) + 100000 AS dur_us
  FROM v_words GROUP BY conv_id, turn, role)"""
SIGNALS = "v_signals AS (SELECT vec_id AS sig_id, label AS speaker, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"
FILES = "v_files AS (SELECT page_id, url AS path, CAST(length(html) * 16 AS BIGINT) AS n_samples FROM pages)"
TYPES = SEGMENTS + """, gaps AS (
  SELECT *, lag(speaker) OVER w AS prev_speaker, lag(start_us + dur_us) OVER w AS prev_end_us FROM v_segments
  WINDOW w AS (PARTITION BY rec ORDER BY start_us, id)), types AS (
  SELECT *, start_us - prev_end_us AS gap_us, CAST(CASE WHEN speaker = prev_speaker THEN 0 WHEN start_us >= prev_end_us THEN 1
    WHEN dur_us <= 20000000 THEN 3 ELSE 2 END AS INTEGER) AS type FROM gaps WHERE prev_end_us IS NOT NULL), typed AS (
  SELECT *, round(CASE WHEN type = 0 THEN greatest(0.0, gap_us / 1e6) WHEN type = 1 THEN gap_us / 1e6
    WHEN dur_us > 0 THEN least(1.0, -gap_us / dur_us) ELSE 0.0 END, 6) AS metric FROM types)"""
MERGED = SEGMENTS + """, reached AS (
  SELECT *, start_us + dur_us AS end_us, max(start_us + dur_us) OVER (PARTITION BY rec, speaker, channel ORDER BY start_us, start_us + dur_us
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_segments), islands AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_us - reach > 200000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY rec, speaker, channel ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM reached), merged AS (
  SELECT rec, speaker, channel, min(start_us) AS start_us, max(end_us) AS end_us, count(*) AS parts FROM islands GROUP BY rec, speaker, channel, island)"""
SWEEP = SEGMENTS + """, r0 AS (
  SELECT *, start_us + dur_us AS end_us, max(start_us + dur_us) OVER (PARTITION BY rec, speaker ORDER BY start_us, start_us + dur_us
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM v_segments WHERE dur_us > 0), i0 AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR start_us > reach THEN 1 ELSE 0 END)
    OVER (PARTITION BY rec, speaker ORDER BY start_us, end_us ROWS UNBOUNDED PRECEDING) AS island FROM r0), m0 AS (
  SELECT rec, speaker, min(start_us) AS start_us, max(end_us) AS end_us FROM i0 GROUP BY rec, speaker, island), steps AS (
  SELECT rec, t, sum(d) AS d FROM (SELECT rec, start_us AS t, 1 AS d FROM m0 UNION ALL SELECT rec, end_us, -1 FROM m0) GROUP BY rec, t), profile AS (
  SELECT rec, t AS start_us, lead(t) OVER (PARTITION BY rec ORDER BY t) AS end_us, CAST(sum(d) OVER (PARTITION BY rec ORDER BY t) AS BIGINT) AS active FROM steps)"""


def query(name: str, sql: str | None = None) -> Callable:
    """Register a function of (spark, sf_dir) under a name."""

    def keep(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep
