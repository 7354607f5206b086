"""Common table expressions of the SQL side: the same inputs as sources.tables, for DuckDB."""

WORDS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda x: x <> '')"
UTTERANCES = rf"""
u0 AS (SELECT conv_id AS media_id, turn AS seq, role AS speaker, coalesce(text, '') AS text,
    CAST(len({WORDS.format("coalesce(text, '')")}) AS BIGINT) * 5000 // 13 AS dur,
    CASE turn % 3 WHEN 0 THEN 2600 WHEN 1 THEN 500 ELSE 200 END AS pause FROM conversations),
u1 AS (SELECT *, CAST(coalesce(sum(dur + pause) OVER (PARTITION BY media_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_ms FROM u0),
u AS (SELECT media_id, seq, speaker, text, start_ms, start_ms + dur AS end_ms FROM u1),
sil AS (SELECT * FROM (SELECT media_id, end_ms AS start_ms, lead(start_ms) OVER (PARTITION BY media_id ORDER BY seq) AS end_ms FROM u) WHERE end_ms > start_ms),
med AS (SELECT media_id, max(end_ms) AS total_ms FROM u GROUP BY media_id)"""
WINDOWS = """
bnd AS (SELECT * FROM sil WHERE end_ms - start_ms >= 2000 AND start_ms > 0),
win AS (SELECT media_id, a AS start_ms, b AS end_ms FROM (
    SELECT media_id, coalesce(lag(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms), 0) AS a, start_ms AS b
    FROM (SELECT * FROM bnd UNION ALL SELECT media_id, total_ms, NULL FROM med)) WHERE b > a)"""
GRID = """
grid AS (SELECT media_id, g AS clip, g * 15000 AS w_start, least((g + 1) * 15000, total_ms) AS w_end
  FROM med, LATERAL (SELECT unnest(range(0, total_ms // 15000 + 1)) AS g) WHERE least((g + 1) * 15000, total_ms) > g * 15000)"""
POINTS = r"""
near AS (SELECT u.media_id, u.seq, arg_min(s.end_ms - s.start_ms, s.start_ms) AS pause FROM u JOIN sil s ON u.media_id = s.media_id AND abs(s.start_ms - u.end_ms) <= 600 GROUP BY ALL),
pts AS (SELECT u.media_id, u.seq, u.end_ms AS time_ms, regexp_matches(text, '[.!?…]\s*$') AS sentence_end, coalesce(pause, 0) AS pause_ms,
    CASE WHEN regexp_matches(text, '[.!?…]\s*$') THEN 3000 ELSE 0 END + least(2000, coalesce(pause, 0)) AS quality
  FROM u LEFT JOIN near USING (media_id, seq))"""
SPLIT = """
cutl AS (SELECT w.media_id, w.start_ms, w.end_ms, list(DISTINCT {'q': quality, 't': time_ms}) FILTER (WHERE time_ms IS NOT NULL) AS cuts
  FROM win w LEFT JOIN pts p ON w.media_id = p.media_id AND p.time_ms > w.start_ms AND p.time_ms < w.end_ms GROUP BY ALL),
walk AS (
  SELECT media_id, start_ms AS cur, end_ms, cuts FROM cutl
  UNION ALL
  SELECT media_id, coalesce(list_sort(list_filter(cuts, lambda c: c.t >= cur + 2000 AND c.t <= least(cur + 60000, end_ms - 2000)), 'DESC')[1].t, cur + 60000), end_ms, cuts
  FROM walk WHERE end_ms - cur > 60000),
pieces AS (SELECT media_id, cur AS start_ms, lead(cur, 1, end_ms) OVER (PARTITION BY media_id, end_ms ORDER BY cur) AS end_ms FROM walk)"""
KEEP = """
shr AS (SELECT media_id, clip, start_ms + 150 AS s, end_ms - 150 AS e FROM inside WHERE end_ms - start_ms - 300 >= 50),
ends AS (SELECT media_id, clip, s, e FROM shr UNION ALL SELECT media_id, clip, w_end, w_end FROM cw),
pos AS (SELECT n.media_id, n.clip, greatest(w_start, coalesce(max(e) OVER (PARTITION BY n.media_id, n.clip ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS a, s AS b FROM ends n JOIN cw ON n.media_id = cw.media_id AND n.clip = cw.clip),
kept0 AS (SELECT media_id, clip, a, b FROM pos WHERE b - a >= 50),
kept AS (SELECT * FROM kept0 UNION ALL SELECT media_id, clip, w_start, w_end FROM cw WHERE NOT EXISTS (SELECT 1 FROM kept0 k WHERE k.media_id = cw.media_id AND k.clip = cw.clip))"""
INSIDE = """
inside AS (SELECT cw.media_id, cw.clip, greatest(s.start_ms, w_start) AS start_ms, least(s.end_ms, w_end) AS end_ms FROM cw JOIN sil s ON s.media_id = cw.media_id AND s.start_ms < w_end AND s.end_ms > w_start
  WHERE least(s.end_ms, w_end) - greatest(s.start_ms, w_start) >= 800)"""
TEXTS = """
txt AS (SELECT cw.media_id, cw.clip, trim(string_agg(u.text, ' ' ORDER BY seq)) AS text FROM cw JOIN u ON u.media_id = cw.media_id AND u.start_ms < w_end AND u.end_ms > w_start
  AND u.end_ms > u.start_ms AND least(u.end_ms, w_end) - greatest(u.start_ms, w_start) >= 0.35 * (u.end_ms - u.start_ms) GROUP BY ALL)"""


def score(text: str, ms: str) -> str:
    from ..functions.text import HOOKS

    n, s = f"len({WORDS.format(text)})", f"({ms} / 1000.0)"
    hooks = " + ".join(f"CASE WHEN contains(lower({text}), '{h}') THEN 1 ELSE 0 END" for h in HOOKS)
    return f"""CASE WHEN {n} = 0 OR {ms} <= 0 THEN 0.0 ELSE round(greatest(0.0, least(10.0,
      CAST(5.0 AS DOUBLE) + least(2.0, 0.5 * CAST({hooks} AS DOUBLE)) + least(1.5, CAST({n} AS DOUBLE) / 60.0) - 1.2 * abs(CAST({n} AS DOUBLE) / CAST({s} AS DOUBLE) - 2.6) - 1.5 * abs(CAST({s} AS DOUBLE) - 35.0) / 35.0)), 1) END"""
