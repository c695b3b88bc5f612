"""DuckDB SQL that states the expected result of each query over the same tables.

The SQL follows the rules themselves (plain windows, recursion), not the block-wise plans.
"""

from __future__ import annotations

import re

from cuelake import fixed

# Views, in dependency order.
VIEWS = {
    "lines": r"""SELECT doc_id AS track_id, unnest(range(1, len(parts) + 1)) AS cue_no, unnest(parts) AS text
        FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents)""",
    "cues_v": r"""SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY cue_no) AS pos, cue_no,
        (cue_no - 1) * 2000 AS start_ms, (cue_no - 1) * 2000 + 400 + (length(text) % 13) * 200 AS end_ms, text
        FROM lines WHERE regexp_matches(text, '\S')""",
    "raw_cues_v": r"""SELECT track_id, pos, pos + CASE WHEN pos % 10 = 0 THEN 1 ELSE 0 END AS cue_no,
        start_ms - CASE WHEN length(text) % 499 = 0 THEN 5000 ELSE 0 END AS start_ms,
        end_ms - CASE WHEN length(text) % 499 = 0 THEN 5000 ELSE 0 END AS end_ms,
        CASE WHEN length(text) % 17 = 0 THEN '' ELSE text END AS text FROM cues_v""",
    "words": r"""SELECT doc_id AS track_id, unnest(range(1, len(parts) + 1)) AS word_no, unnest(parts) AS text
        FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS parts FROM documents)""",
    "tokens_v": r"""SELECT track_id, row_number() OVER (PARTITION BY track_id ORDER BY word_no) AS pos, text
        FROM words WHERE regexp_matches(text, '\S')""",
    "ev": r"""SELECT user_id AS track_id, event_id, epoch_us(ts) AS ts_us, event_type, value,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events""",
    "samples_v": r"""SELECT track_id, n, ts_us, CASE WHEN event_type = 'view' THEN '' ELSE event_type END AS text,
        n > 1 AND CAST(floor(value) AS BIGINT) % 2 = 0 AS changed FROM ev""",
    "frames_v": r"""SELECT track_id, n - 1 AS idx, (n - 1) * 250 + CAST(floor(value) AS BIGINT) AS pts_ms FROM ev""",
    "repaired": r"""SELECT track_id, idx, pts_ms, CASE WHEN pts_ms > -1000 THEN pts_ms ELSE idx * 250 END AS ms,
            pts_ms <= -1000 AS repaired FROM frames_v WHERE idx = 0
        UNION ALL SELECT f.track_id, f.idx, f.pts_ms,
            CASE WHEN f.pts_ms > r.ms THEN f.pts_ms ELSE greatest(f.idx * 250, r.ms + 250) END, f.pts_ms <= r.ms
        FROM repaired r JOIN frames_v f ON f.track_id = r.track_id AND f.idx = r.idx + 2""",
    "gate": r"""SELECT track_id, n, ts_us, text, changed, true AS kept, ts_us AS clock FROM samples_v WHERE n = 1
        UNION ALL SELECT s.track_id, s.n, s.ts_us, s.text, s.changed, s.changed OR s.ts_us - g.clock >= 21600000000,
            CASE WHEN s.changed OR s.ts_us - g.clock >= 21600000000 THEN s.ts_us ELSE g.clock END
        FROM gate g JOIN samples_v s ON s.track_id = g.track_id AND s.n = g.n + 1""",
    "gate_ctx": r"""SELECT *, lag(ts_us) OVER w AS prior_us,
            max(CASE WHEN kept THEN n END) OVER (PARTITION BY track_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept_n,
            max(ts_us) OVER (PARTITION BY track_id) AS last_us
        FROM gate WINDOW w AS (PARTITION BY track_id ORDER BY n)""",
    "ocr_events": r"""SELECT g.track_id, g.n, g.text, g.last_us,
            coalesce(NOT g.changed AND g.text <> p.text, false) AS backdated,
            CASE WHEN NOT g.changed AND g.text <> p.text
                 THEN greatest(p.ts_us, CAST(round_even((g.prior_us + g.ts_us) / 2.0, 0) AS BIGINT)) ELSE g.ts_us END AS event_us
        FROM gate_ctx g LEFT JOIN gate p ON p.track_id = g.track_id AND p.n = g.kept_n WHERE g.kept""",
    "linked": r"""SELECT *, coalesce(lead(event_us) OVER w, last_us + 500000) AS next_us, lag(text) OVER w AS before
        FROM ocr_events WINDOW w AS (PARTITION BY track_id ORDER BY n)""",
    "intervals": r"""SELECT *, CASE WHEN next_us <= event_us THEN event_us + 500000 ELSE next_us END AS end_us FROM linked""",
    "retimed": r"""SELECT track_id, idx, pts_ms AS ms, false AS repaired FROM frames_v WHERE idx = 0
        UNION ALL SELECT f.track_id, f.idx, CASE WHEN f.pts_ms > r.ms THEN f.pts_ms ELSE greatest(f.idx * 250, r.ms + 250) END, f.pts_ms <= r.ms
        FROM retimed r JOIN frames_v f ON f.track_id = r.track_id AND f.idx = r.idx + 1""",
    "retimed_gate": r"""SELECT r.track_id, s.n, r.ms, true AS kept, r.ms AS clock FROM retimed r JOIN samples_v s ON s.track_id = r.track_id AND s.n = 1 WHERE r.idx = 0
        UNION ALL SELECT g.track_id, s.n, r.ms, s.changed OR r.ms - g.clock >= 1000, CASE WHEN s.changed OR r.ms - g.clock >= 1000 THEN r.ms ELSE g.clock END
        FROM retimed_gate g JOIN samples_v s ON s.track_id = g.track_id AND s.n = g.n + 1 JOIN retimed r ON r.track_id = g.track_id AND r.idx = g.n""",
    "arrived": r"""SELECT track_id, n, ts_us, (n * 7 + track_id) % 5 AS slice FROM ev""",
    "water": r"""SELECT slice, max(max(ts_us)) OVER (ORDER BY slice) // 1000 AS ms FROM arrived GROUP BY 1""",
    "taken": r"""SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY round, ts_us, n) AS k FROM (SELECT a.track_id, a.n, a.ts_us, coalesce(min(w.slice), 5) AS round
        FROM arrived a LEFT JOIN water w ON w.slice >= a.slice AND w.ms > a.ts_us // 1000 GROUP BY 1, 2, 3)""",
    "taken_pts": r"""SELECT t.track_id, t.k, t.n, f.idx, f.pts_ms, coalesce(max(CAST(t.ts_us AS HUGEINT) * 1000000 + t.n) OVER (PARTITION BY t.track_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        > CAST(t.ts_us AS HUGEINT) * 1000000 + t.n, false) AS late FROM taken t JOIN frames_v f ON f.track_id = t.track_id AND f.idx = t.n - 1""",
    "taken_times": r"""SELECT track_id, k, CASE WHEN pts_ms > -1000 THEN pts_ms ELSE idx * 250 END AS ms, false AS repaired, late FROM taken_pts WHERE k = 1
        UNION ALL SELECT f.track_id, f.k, CASE WHEN f.pts_ms > r.ms THEN f.pts_ms ELSE greatest(f.idx * 250, r.ms + 250) END, f.pts_ms <= r.ms, f.late
        FROM taken_times r JOIN taken_pts f ON f.track_id = r.track_id AND f.k = r.k + 1""",
    "taken_samples": r"""SELECT t.track_id, t.k, t.n, t.ts_us, s.text FROM taken t JOIN samples_v s ON s.track_id = t.track_id AND s.n = t.n""",
    "given_times": r"""SELECT track_id, k, n, ts_us AS given_us, ts_us, text FROM taken_samples WHERE k = 1
        UNION ALL SELECT t.track_id, t.k, t.n, t.ts_us, CASE WHEN t.ts_us > g.ts_us OR t.ts_us = g.ts_us AND t.n > g.n THEN t.ts_us ELSE g.ts_us + 500000 END, t.text
        FROM given_times g JOIN taken_samples t ON t.track_id = g.track_id AND t.k = g.k + 1""",
    "asked": r"""SELECT *, regexp_matches(text, '\p{L}') AS sent, length(text) AS n FROM cues_v""",
    "film_gate": r"""SELECT g.track_id, g.n, g.ms * 1000 AS ts_us, s.text, s.changed, g.kept FROM retimed_gate g JOIN samples_v s USING (track_id, n)""",
    "film_ctx": r"""SELECT *, lag(ts_us) OVER w AS prior_us, max(CASE WHEN kept THEN n END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS kept_n
        FROM film_gate WINDOW w AS (PARTITION BY track_id ORDER BY n)""",
    "film_events": r"""SELECT g.track_id, g.n, g.text, CASE WHEN NOT g.changed AND g.text <> p.text
            THEN greatest(p.ts_us, CAST(round_even((g.prior_us + g.ts_us) / 2.0, 0) AS BIGINT)) ELSE g.ts_us END AS event_us
        FROM film_ctx g LEFT JOIN film_gate p ON p.track_id = g.track_id AND p.n = g.kept_n WHERE g.kept""",
    "film_ends": r"""SELECT f.track_id, CAST(1000 * greatest((max(f.idx) + 1) * 250, max(f.pts_ms) + 250, max(r.ms) + 250) AS BIGINT) AS duration_us
        FROM frames_v f JOIN retimed r USING (track_id, idx) GROUP BY 1""",
    "film_linked": r"""SELECT e.*, coalesce(lead(event_us) OVER w, duration_us) AS next_us, lag(text) OVER w AS before
        FROM film_events e JOIN film_ends USING (track_id) WINDOW w AS (PARTITION BY track_id ORDER BY n)""",
    "steps_v": r"""SELECT track_id AS crop_id, n AS step, event_type AS class, value / 500 AS score FROM ev""",
    "collapsed": r"""SELECT * FROM (SELECT *, lag(class) OVER (PARTITION BY crop_id ORDER BY step) AS before FROM steps_v)
        WHERE class <> 'view' AND class IS DISTINCT FROM before""",
    "boxes_v": r"""SELECT l_orderkey AS frame, l_quantity AS y1, l_partkey AS x1, l_suppkey AS crop_ref, l_linenumber AS line_no,
        CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || l_linestatus ELSE repeat(l_returnflag || l_linestatus, 3) END AS text,
        l_discount * 10 AS confidence FROM lineitem""",
    "crops": r"""SELECT source, doc_id + 1 AS seq, CAST(least(2048, greatest(32, ceil(48 * n_chars / 48.0 / 8) * 8)) AS BIGINT) AS target FROM documents""",
    "ranked_crops": r"""SELECT *, row_number() OVER (PARTITION BY source ORDER BY target, seq) AS r FROM crops""",
    "packed": r"""SELECT source, seq, target, r, 0 AS batch_id, target AS first, 1 AS size FROM ranked_crops WHERE r = 1
        UNION ALL SELECT c.source, c.seq, c.target, c.r,
            CASE WHEN p.size < 8 AND c.target <= p.first * 1.25 THEN p.batch_id ELSE p.batch_id + 1 END,
            CASE WHEN p.size < 8 AND c.target <= p.first * 1.25 THEN p.first ELSE c.target END,
            CASE WHEN p.size < 8 AND c.target <= p.first * 1.25 THEN p.size + 1 ELSE 1 END
        FROM packed p JOIN ranked_crops c ON c.source = p.source AND c.r = p.r + 1""",
    "vectors": r"""SELECT label AS crop_id, vec_id + 1 AS step, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS scores FROM embeddings""",
    "softmaxed": r"""SELECT crop_id, step, CASE WHEN bool_or(odd) OVER (PARTITION BY crop_id) THEN
            list_transform(powers, lambda p: p / list_sum(powers)) ELSE scores END AS scores
        FROM (SELECT *, list_min(scores) < 0 OR list_max(scores) > 1 OR list_sum(scores) NOT BETWEEN 0.98 AND 1.02 AS odd,
              list_transform(scores, lambda x: exp(x - list_max(scores))) AS powers FROM vectors)""",
    "regions_v": r"""SELECT vec_id * 6 + part AS region_id, ['bottom', 'lower-half', 'full', 'custom', 'unknown'][label % 5 + 1] AS profile,
        round(abs(CAST(embedding[s + 1] AS DOUBLE)) * 3, 6) AS top, round(abs(CAST(embedding[s + 2] AS DOUBLE)) * 3, 6) AS bottom,
        round(abs(CAST(embedding[s + 3] AS DOUBLE)) * 3, 6) AS "left", round(abs(CAST(embedding[s + 4] AS DOUBLE)) * 3, 6) AS "right",
        list_transform(embedding[s + 5:s + 8], lambda x: round(abs(CAST(x AS DOUBLE)) * 400, 3)) AS xs,
        list_transform(embedding[s + 9:s + 12], lambda x: round(abs(CAST(x AS DOUBLE)) * 400, 3)) AS ys
        FROM embeddings, (VALUES (0, 0), (1, 12), (2, 24), (3, 36), (4, 48), (5, 52)) w(part, s)""",
    "bounds": r"""SELECT r.region_id, r.profile, coalesce(p.t, CASE WHEN r.profile = 'custom' THEN r.top END) AS t,
        coalesce(p.b, CASE WHEN r.profile = 'custom' THEN r.bottom END) AS b,
        coalesce(p.l, CASE WHEN r.profile = 'custom' THEN r."left" END) AS l,
        coalesce(p.r, CASE WHEN r.profile = 'custom' THEN r."right" END) AS r, xs, ys
        FROM regions_v r LEFT JOIN (VALUES ('bottom', 0.42::DOUBLE, 0.02::DOUBLE, 0.03::DOUBLE, 0.97::DOUBLE), ('lower-half', 0.55, 0, 0.02, 0.98), ('full', 1, 0, 0, 1)) p(name, t, b, l, r)
        ON p.name = r.profile""",
    "judged": r"""SELECT *, CASE WHEN t IS NULL THEN 'PROFILE' WHEN t NOT BETWEEN 0 AND 1 OR b NOT BETWEEN 0 AND 1 OR l NOT BETWEEN 0 AND 1 OR r NOT BETWEEN 0 AND 1 THEN 'BOUNDS'
        WHEN t - b < 0.08 THEN 'HEIGHT' WHEN r - l < 0.08 THEN 'WIDTH' END AS reason FROM bounds""",
    "faulty": r"""SELECT *, lag(start_ms) OVER w AS ps, lag(end_ms) OVER w AS pe FROM raw_cues_v WINDOW w AS (PARTITION BY track_id ORDER BY pos)""",
    "checked": r"""SELECT *, end_ms <= start_ms OR coalesce(start_ms < ps, false) AS broken, coalesce(start_ms < pe, false) AS laps,
        cue_no <> pos AS renumbered FROM faulty""",
    # merging, in the form of windows over whole tracks; SRC is cues_v or the kept raw cues
    "bodies": r"""SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS body,
        replace(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^ | $', '', 'g')), 'ß', 'ss') AS norm FROM SRC""",
    "runs_of": r"""SELECT *, sum(CASE WHEN norm = before THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY pos) AS run
        FROM (SELECT *, lag(norm) OVER (PARTITION BY track_id ORDER BY pos) AS before FROM bodies)""",
    "islands": r"""SELECT *, max(CASE WHEN reach IS NULL OR start_ms > reach + 750 THEN pos END) OVER (PARTITION BY track_id ORDER BY pos) AS cue_pos
        FROM (SELECT *, max(end_ms) OVER (PARTITION BY track_id, run ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM runs_of)""",
    "merged": r"""SELECT track_id, cue_pos, min(start_ms) AS start_ms, max(end_ms) AS end_ms, arg_min(body, pos) AS body,
        count(*) AS parts FROM islands GROUP BY ALL""",
    "body_lines": r"""SELECT *, string_split(body, chr(10)) AS ls,
        length(regexp_replace(regexp_replace(body, '\s+', ' ', 'g'), '^ | $', '', 'g')) AS n FROM merged""",
    "stats": r"""SELECT track_id, count(*) AS cue_count, count(*) FILTER (n <= 2) AS suspect_cues,
        count(*) FILTER (len(list_filter(ls, lambda x: length(trim(x)) BETWEEN 1 AND 2)) > 0) AS short_line_cues,
        max(len(ls)) AS max_lines, max(list_max(list_transform(ls, lambda x: length(x)))) AS max_line_chars,
        CAST(sum(parts - 1) AS BIGINT) AS duplicates_merged FROM body_lines GROUP BY track_id""",
    "shaped": r"""SELECT *, length(regexp_replace(text, '\s', '', 'g')) AS visible,
        length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS alphabetic, length(regexp_replace(text, '[^\p{N}]', '', 'g')) AS numeric
        FROM tokens_v""",
    "near": r"""SELECT *, visible <= 4 AND alphabetic <= 1 AS weak, coalesce(lag(visible <= 4 AND alphabetic <= 1) OVER w, false)
        OR coalesce(lead(visible <= 4 AND alphabetic <= 1) OVER w, false) AS beside
        FROM shaped WINDOW w AS (PARTITION BY track_id ORDER BY pos)""",
    "removed": r"""SELECT *, visible = 0 OR (alphabetic = 0 AND numeric = 0) OR (beside AND weak AND (numeric > 0 OR alphabetic = 0)) AS gone FROM near""",
    "chunks": r"""SELECT track_id, (pos - 1) // 12 AS chunk_no, list({'id': pos, 'text': text} ORDER BY pos) AS targets FROM cues_v GROUP BY ALL""",
    "candidates": r"""SELECT c.track_id, c.pos, c.text, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY c.track_id) AS n
        FROM (SELECT *, length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 3 AS good FROM cues_v) c
        JOIN (SELECT track_id, bool_or(length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 3) AS any_good FROM cues_v GROUP BY 1) t
        ON t.track_id = c.track_id AND (c.good OR NOT t.any_good) WINDOW w AS (PARTITION BY c.track_id ORDER BY c.pos)""",
    "picked": r"""SELECT track_id, pos, text FROM candidates WHERE n <= 24 OR i IN (SELECT s * (n - 1) // 23 FROM range(24) q(s))""",
    "requests_v": r"""SELECT conv_id, turn, CASE role WHEN 'user' THEN 'clean' WHEN 'assistant' THEN 'translate' ELSE 'system' END AS mode,
        split_part(text, ' ', 1) AS language, ['light', ' strong ', 'extreme', NULL][turn % 4 + 1] AS strength,
        repeat(text, 4) AS guidance, text, role FROM conversations""",
    "faults": r"""SELECT track_id, chunk_no, targets, len(targets) AS n, (track_id + chunk_no) % 8 AS f FROM chunks""",
    "items": r"""SELECT track_id, chunk_no, n, f, targets, CASE
        WHEN f = 0 THEN targets[1:n - 1] WHEN f = 1 THEN targets[1:1] || targets
        WHEN f = 2 AND n > 1 THEN targets[2:2] || targets[1:1] || targets[3:]
        WHEN f = 3 THEN [{'id': targets[1].id, 'text': ''}] || targets[2:]
        WHEN f = 4 THEN targets || [{'id': 99999::BIGINT, 'text': 'extra'}] ELSE targets END AS cues
        FROM faults WHERE f <> 7""",
    "decisions_v": r"""SELECT track_id, pos, CASE WHEN length(text) % 7 = 0 THEN ' ' WHEN length(text) % 5 = 0 THEN text || '!' ELSE text END AS text FROM cues_v""",
    "decided": r"""SELECT c.track_id, row_number() OVER (PARTITION BY c.track_id ORDER BY c.pos) AS pos, start_ms, end_ms, d.text
        FROM cues_v c JOIN decisions_v d USING (track_id, pos) WHERE trim(d.text) <> ''""",
    "ranges": r"""SELECT track_id, (pos - 1) // 12 * 12 AS first, max(pos) AS past, 0 AS round FROM cues_v GROUP BY ALL""",
    "tries": r"""SELECT track_id, first, past, round,
            (SELECT bool_or(length(text) % 29 = 0) FROM cues_v c WHERE c.track_id = t.track_id AND c.pos > t.first AND c.pos <= t.past) AS odd,
            (SELECT bool_or(length(text) % 211 = 0) FROM cues_v c WHERE c.track_id = t.track_id AND c.pos > t.first AND c.pos <= t.past) AS dead
        FROM ranges t
        UNION ALL SELECT track_id, first, past, round,
            (SELECT bool_or(length(text) % 29 = 0) FROM cues_v c WHERE c.track_id = t.track_id AND c.pos > t.first AND c.pos <= t.past),
            (SELECT bool_or(length(text) % 211 = 0) FROM cues_v c WHERE c.track_id = t.track_id AND c.pos > t.first AND c.pos <= t.past)
        FROM (SELECT track_id, CASE WHEN h = 0 THEN first ELSE first + (past - first) // 2 END AS first,
                     CASE WHEN h = 0 THEN first + (past - first) // 2 ELSE past END AS past, round + 1 AS round
              FROM tries, range(2) q(h) WHERE odd AND NOT dead AND past - first > 1) t""",
    "logs_v": r"""SELECT track_id AS run_id, n AS line_no, ts_us, event_id, CASE event_type
        WHEN 'click' THEN 'OCRProgress=' || CAST(floor(value / 5) AS BIGINT) WHEN 'view' THEN '1/2 Native engine'
        WHEN 'error' THEN 'ERROR: e' || event_id WHEN 'signup' THEN 'K' || (event_id % 5) || '=v=' || CAST(floor(value) AS BIGINT)
        ELSE CASE WHEN event_id % 2 = 0 THEN '--- TRACK PIPELINE 1 RESULT START ---' ELSE '--- TRACK PIPELINE 1 RESULT END ---' END END AS line FROM ev""",
    "edges": r"""SELECT run_id, min(line_no) AS first_start FROM logs_v WHERE line LIKE '%RESULT START ---' GROUP BY 1""",
    "spans": r"""SELECT e.run_id, first_start, (SELECT min(line_no) FROM logs_v l WHERE l.run_id = e.run_id AND line_no > first_start AND line LIKE '%RESULT END ---%') AS first_end FROM edges e""",
    "runs_v": r"""SELECT track_id AS run_id, n AS attempt_no, CASE event_type WHEN 'error' THEN 'FAILED' ELSE 'COMPLETE' END AS status,
        value AS seconds, CASE event_type WHEN 'error' THEN 'e' || event_id END AS error FROM ev WHERE event_type IN ('error', 'purchase')""",
    "rolled": r"""SELECT run_id, count(*) AS attempts, round(sum(seconds), 3) AS attempt_seconds, arg_max(status, attempt_no) AS last_status,
        CASE WHEN count(*) > 1 THEN list(error ORDER BY attempt_no)[1] END AS fallback_reason FROM runs_v GROUP BY 1""",
    "assets_v": r"""SELECT 'd/' || doc_id AS path, doc_id, strlen(text) AS size, sha256(text) AS digest FROM documents""",
    "manifest_raw": r"""SELECT 'd/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN sha256(text || 'x') WHEN doc_id % 3 = 0 THEN upper(sha256(text)) ELSE sha256(text) END AS s,
        CASE WHEN doc_id % 13 = 0 THEN 100 ELSE 1048576 END AS max_bytes, doc_id FROM documents WHERE doc_id % 10 <> 0""",
    "manifest_v": r"""SELECT path, CASE WHEN doc_id % 11 = 0 THEN left(s, 60) ELSE s END AS sha256, max_bytes FROM manifest_raw
        UNION ALL SELECT 'm/' || doc_id, sha256(text), 1048576 FROM documents WHERE doc_id % 50 = 0""",
    "verdicts": r"""SELECT coalesce(a.path, m.path) AS path, CASE WHEN a.path IS NULL THEN 'MISSING' WHEN m.path IS NULL THEN 'UNEXPECTED'
        WHEN NOT regexp_full_match(m.sha256, '[0-9a-fA-F]{64}') THEN 'BAD_DIGEST' WHEN size > max_bytes THEN 'TOO_LARGE'
        WHEN digest <> lower(m.sha256) THEN 'MISMATCH' ELSE 'OK' END AS verdict, a.doc_id, a.digest, m.sha256
        FROM assets_v a FULL JOIN manifest_v m ON a.path = m.path""",
    "paths_v": r"""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '') || ['.mp4', '.TXT', '.MKV', ''][page_id % 4 + 1] AS path FROM pages""",
    "texts_v": r"""SELECT doc_id AS track_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE
        CASE WHEN doc_id % 3 = 0 THEN '' ELSE '00:00:01,000 --> 00:00:02,000' || chr(10) END ||
        CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(13) || chr(10)) ELSE text END END AS content FROM documents""",
    "saves": r"""SELECT track_id, content, CASE WHEN content = '' THEN 'SIZE' WHEN NOT contains(content, ' --> ') THEN 'NO_TIMECODE' END AS reason,
        replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS lf FROM texts_v""",
}
RECURSIVE = {"repaired", "gate", "packed", "tries", "retimed", "retimed_gate", "taken_times", "given_times"}


def code(ms: str) -> str:
    return (f"printf('%02d:%02d:%02d,%03d', ({ms}) // 3600000, ({ms}) // 60000 % 60, ({ms}) // 1000 % 60, ({ms}) % 1000)")


def _needed(sql: str, found: set[str]) -> None:
    for name in VIEWS:
        if name not in found and re.search(rf"\b{name}\b", sql):
            found.add(name)
            _needed(VIEWS[name], found)


def with_views(sql: str, source: str = "cues_v") -> str:
    found: set[str] = set()
    _needed(sql, found)
    if "bodies" in found:
        _needed(source, found)
    if not found:
        return sql
    views = [f"{name} AS ({VIEWS[name].replace('SRC', source)})" for name in VIEWS if name in found]
    recursive = "RECURSIVE " if found & RECURSIVE else ""
    return f"WITH {recursive}" + ",\n".join(views) + "\n" + sql


SQL = {
    "srt_parse_strict": r"""SELECT track_id, pos AS cue_no, start_ms, end_ms, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text, 'OK' AS status FROM cues_v""",
    "srt_parse_lenient": f"""SELECT track_id, pos, {code('start_ms')} AS "start", {code('end_ms')} AS "end",
        CASE WHEN pos = max(pos) OVER (PARTITION BY track_id) THEN rtrim(text) ELSE text END AS text, 'OK' AS status FROM cues_v""",
    "subtitle_file_guard": r"""SELECT 'd/' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.txt' ELSE '.SRT' END AS path,
        CASE WHEN doc_id % 7 = 0 THEN 0 WHEN doc_id % 3 = 0 THEN strlen(text) + 6 WHEN doc_id % 2 = 0 THEN strlen(text) + 5 ELSE strlen(text) END AS size,
        CASE WHEN doc_id % 5 = 0 THEN 'EXTENSION' WHEN doc_id % 7 = 0 THEN 'SIZE' WHEN doc_id % 3 = 0 THEN 'UTF8'
             WHEN doc_id % 2 <> 0 AND NOT contains(text, ' --> ') THEN 'NO_TIMECODE' END AS reason FROM documents""",
    "video_path_filter": r"""SELECT page_id, path FROM paths_v WHERE regexp_matches(lower(path), '\.(mp4|mkv|avi|mov|webm|ts|m2ts|wmv|m4v)$')""",
    "source_changed_check": r"""SELECT 'd/' || doc_id AS path, doc_id % 13 = 0 OR doc_id % 9 = 0 OR (doc_id % 19 = 0 AND doc_id % 11 <> 0) AS changed FROM documents""",
    "export_srt": f"""SELECT track_id, (pos - 1) // 4096 AS part_no, string_agg(pos || chr(10) || {code('start_ms')} || ' --> ' ||
        {code('greatest(start_ms + 1000, end_ms)')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY pos) AS content FROM cues_v GROUP BY 1, 2""",
    "export_txt": r"""SELECT track_id, (pos - 1) // 4096 AS part_no, string_agg(text || chr(10), '' ORDER BY pos) AS content FROM cues_v GROUP BY 1, 2""",
    "export_md": f"""SELECT track_id, (pos - 1) // 4096 AS part_no, CASE WHEN (pos - 1) // 4096 = 0 THEN '# Subtitles' || chr(10) || chr(10) ELSE '' END ||
        string_agg('## ' || {code('start_ms')} || ' → ' || {code('end_ms')} || chr(10) || chr(10) || text || chr(10) || chr(10), '' ORDER BY pos) AS content
        FROM cues_v GROUP BY track_id, (pos - 1) // 4096""",
    "export_ttml": f"""SELECT track_id, part_no, CASE WHEN part_no = 0 THEN '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<tt xmlns="http://www.w3.org/ns/ttml"><body><div>' || chr(10) ELSE '' END
        || content || CASE WHEN part_no = max(part_no) OVER (PARTITION BY track_id) THEN '</div></body></tt>' || chr(10) ELSE '' END AS content
        FROM (SELECT track_id, (pos - 1) // 4096 AS part_no, string_agg('  <p begin="' || replace({code('start_ms')}, ',', '.') || '" end="' || replace({code('end_ms')}, ',', '.') || '">' ||
        replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') || '</p>' || chr(10), '' ORDER BY pos) AS content
        FROM cues_v GROUP BY 1, 2)""",
    "export_filename": r"""SELECT page_id, regexp_replace(regexp_extract(path, '([^/]+)$', 1), CASE page_id % 3 WHEN 2 THEN '(?i)\.(srt|ttml|txt|md)$' ELSE '\.[^.]+$' END, '') ||
        CASE page_id % 3 WHEN 0 THEN '-cleaned-ai' WHEN 1 THEN '-german-ai' ELSE '' END || '.srt' AS filename,
        CASE WHEN page_id % 5 <> 0 THEN regexp_extract(path, '([^/]+)$', 1) ELSE regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]+$', '') END || '.srt' AS handoff FROM paths_v""",
    "srt_for_save": r"""SELECT track_id, reason, CASE WHEN reason IS NULL THEN CASE WHEN suffix(lf, chr(10)) THEN lf ELSE lf || chr(10) END END AS saved FROM saves""",
    "export_verbatim": r"""SELECT track_id, reason, CASE WHEN reason IS NULL THEN content END AS saved FROM saves""",
    "region_validate": r"""SELECT region_id, top, bottom, "left", "right", reason, CASE WHEN reason IS NULL THEN rtrim(rtrim(printf('%.6f', top), '0'), '.') END AS top_text,
        CASE WHEN reason IS NULL THEN rtrim(rtrim(printf('%.6f', bottom), '0'), '.') END AS bottom_text,
        CASE WHEN reason IS NULL THEN rtrim(rtrim(printf('%.6f', "left"), '0'), '.') END AS left_text,
        CASE WHEN reason IS NULL THEN rtrim(rtrim(printf('%.6f', "right"), '0'), '.') END AS right_text
        FROM (SELECT *, CASE WHEN greatest(top, bottom, "left", "right") > 1 THEN 'BOUNDS' WHEN top - bottom < 0.08 THEN 'HEIGHT' WHEN "right" - "left" < 0.08 THEN 'WIDTH' END AS reason FROM regions_v)""",
    "region_resolve": r"""SELECT region_id, profile, reason, CAST(floor(1920 * l) AS BIGINT) AS x1, CAST(floor(1920 * r) AS BIGINT) AS x2,
        CAST(floor(1080 * (1 - t)) AS BIGINT) AS y1, CAST(floor(1080 * (1 - b)) AS BIGINT) AS y2 FROM judged""",
    "region_box_filter": r"""SELECT * FROM (SELECT region_id, round(greatest(list_min(xs), floor(400 * l)), 3) AS cx1, round(least(list_max(xs), floor(400 * r)), 3) AS cx2,
        round(greatest(list_min(ys), floor(400 * (1 - t))), 3) AS cy1, round(least(list_max(ys), floor(400 * (1 - b))), 3) AS cy2
        FROM judged WHERE reason IS NULL) WHERE cx2 > cx1 AND cy2 > cy1""",
    "region_frame_map": r"""SELECT region_id, round((1 - fw) / 2 + top * fw, 10) AS out_x, round((1 - fh) / 2 + bottom * fh, 10) AS out_y,
        round("left" * fw, 10) AS out_w, round("right" * fh, 10) AS out_h FROM (SELECT *,
        CASE WHEN vw > 0 THEN vw * least(400 / vw, 400 / vh) / 400 ELSE 1 END AS fw, CASE WHEN vw > 0 THEN vh * least(400 / vw, 400 / vh) / 400 ELSE 1 END AS fh
        FROM (SELECT *, [1920.0, 1080, 640, 0][region_id % 4 + 1]::DOUBLE AS vw, [1080.0, 1920, 480, 0][region_id % 4 + 1]::DOUBLE AS vh FROM regions_v))""",
    "stride_sample": "SELECT track_id, idx, pts_ms FROM frames_v WHERE idx % 2 = 0",
    "pts_repair": "SELECT track_id, idx, ms * 1000 AS ts_us, repaired FROM repaired",
    "decoded_high_water": "SELECT track_id, max(pts_ms) AS decoded_ms FROM frames_v GROUP BY 1",
    "track_duration": r"""SELECT f.track_id, CAST(1000 * greatest((max(f.idx) + 1) * 250, max(f.pts_ms) + 250, any_value(r.last_ms) + 250) AS BIGINT) AS duration_us
        FROM frames_v f JOIN (SELECT track_id, max(ms) AS last_ms FROM repaired GROUP BY 1) r USING (track_id) GROUP BY 1""",
    "signal_shift_gate": r"""SELECT crop_id, step, CASE WHEN d IS NOT NULL THEN len(list_filter(d, lambda x: abs(x) > 32)) END AS moved, round(list_avg(d), 6) AS mean_shift,
        coalesce(len(list_filter(d, lambda x: abs(x) > 32)) > 64 * 0.35 AND abs(list_avg(d)) > 2, false) AS cut
        FROM (SELECT crop_id, step, CASE WHEN p IS NOT NULL THEN list_transform(range(1, 65), lambda i: (scores[i] - p[i]) * 255) END AS d
        FROM (SELECT *, lag(scores) OVER (PARTITION BY crop_id ORDER BY step) AS p FROM vectors))""",
    "thumbnail_downsample": r"""SELECT doc_id, (h + 1) // 2 AS height, 200 AS width, CAST(sum(unicode(c) % 256) AS BIGINT) AS gray_sum, CAST(arg_max(unicode(c) % 256, i) AS BIGINT) AS last_pixel
        FROM (SELECT doc_id, h, unnest(range(0, h * 400)) AS i, unnest(string_split(rpad(text, CAST(h * 400 AS INTEGER), ' '), '')) AS c
              FROM (SELECT doc_id, text, (length(text) + 399) // 400 AS h FROM documents))
        WHERE i % 2 = 0 AND i // 400 % 2 = 0 GROUP BY doc_id, h""",
    "ocr_interval_gate": "SELECT track_id, n, kept FROM gate",
    "gate_metrics": r"""SELECT g.track_id, count(*) AS samples, count(*) - 1 AS checks, count(*) FILTER (g.changed) AS triggers,
        count(*) FILTER (f) AS forced_checks, count(*) FILTER (f AND NOT g.changed AND g.kept_n IS NOT NULL) AS forced_only, count(*) FILTER (NOT g.kept) AS skipped,
        count(*) FILTER (g.kept) AS recognised, count(*) FILTER (g.kept AND NOT g.changed AND g.text <> g.old) AS backdates
        FROM (SELECT c.*, p.text AS old, p.ts_us IS NULL OR c.ts_us - p.ts_us >= 21600000000 AS f FROM gate_ctx c LEFT JOIN gate p ON p.track_id = c.track_id AND p.n = c.kept_n) g GROUP BY 1""",
    "box_expand_filter": r"""SELECT region_id, x1, x2, y1, y2 FROM (SELECT region_id, score, area,
        CAST(floor(least(639, greatest(0, ((list_min(xs) - mx) * 1.6 + mx) * 640 / 160))) AS BIGINT) AS x1, CAST(floor(least(639, greatest(0, ((list_max(xs) - mx) * 1.6 + mx) * 640 / 160))) AS BIGINT) + 1 AS x2,
        CAST(floor(least(479, greatest(0, ((list_min(ys) - my) * 1.6 + my) * 480 / 160))) AS BIGINT) AS y1, CAST(floor(least(479, greatest(0, ((list_max(ys) - my) * 1.6 + my) * 480 / 160))) AS BIGINT) + 1 AS y2
        FROM (SELECT region_id, xs, ys, top * 2 AS score, list_avg(xs) AS mx, list_avg(ys) AS my,
              abs(xs[1] * ys[2] - xs[2] * ys[1] + xs[2] * ys[3] - xs[3] * ys[2] + xs[3] * ys[4] - xs[4] * ys[3] + xs[4] * ys[1] - xs[1] * ys[4]) / 2 AS area FROM regions_v))
        WHERE area >= 8 AND x2 - x1 >= 3 AND y2 - y1 >= 3 AND score >= 0.25""",
    "score_normalise": r"""SELECT crop_id, step, class, round(score, 6) AS score FROM (SELECT crop_id, step, unnest(range(0, 64)) AS class, unnest(scores) AS score FROM softmaxed)""",
    "step_argmax": "SELECT crop_id, step, list_position(scores, list_max(scores)) - 1 AS class, round(list_max(scores), 6) AS score FROM vectors",
    "ctc_collapse": r"""SELECT crop_id, 0 AS part_no, round(avg(score), 6) AS confidence, count(*) AS symbols, string_agg(class, '' ORDER BY step) AS text FROM collapsed GROUP BY 1""",
    "dictionary_decode": "SELECT crop_id, step, CASE WHEN class <> 'signup' THEN upper(class) END AS symbol FROM steps_v",
    "confidence_filter": r"""SELECT frame, x1, y1, text, round(confidence, 4) AS confidence FROM boxes_v
        WHERE confidence >= CASE WHEN length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) <= 2 THEN 0.78 ELSE 0.45 END""",
    "reading_order": r"""SELECT frame, 0 AS part_no, string_agg(text, chr(10) ORDER BY round_even(y1 / 6.0, 0), x1, text) AS text FROM boxes_v GROUP BY 1""",
    "length_bucket_pack": "SELECT source, seq, target, batch_id FROM packed",
    "batch_histogram": "SELECT source, n AS batch_size, count(*) AS batches FROM (SELECT source, batch_id, count(*) AS n FROM packed GROUP BY 1, 2) GROUP BY 1, 2",
    "frame_batch_plan": r"""SELECT track_id, (r - 1) // 4 AS group_no, count(*) AS frames, CAST(sum(crops) AS BIGINT) AS crops, sum(crops) <= 32 AS combined FROM (
        SELECT frame % 10 AS track_id, crops, row_number() OVER (PARTITION BY frame % 10 ORDER BY frame) AS r FROM (SELECT frame, count(*) AS crops FROM boxes_v GROUP BY 1)) GROUP BY 1, 2""",
    "decision_parity": r"""SELECT frame, count(*) AS rows, count(*) FILTER (NOT same) AS differing, CASE WHEN bool_and(same) THEN 'match' ELSE 'output_mismatch' END AS verdict
        FROM (SELECT frame, t = text AND (c >= CASE WHEN length(regexp_replace(t, '[^\p{L}\p{N}]', '', 'g')) <= 2 THEN 0.78 ELSE 0.45 END)
            = (confidence >= CASE WHEN length(text) <= 2 THEN 0.78 ELSE 0.45 END) AS same
          FROM (SELECT *, CASE WHEN x1 % 77 = 0 THEN text || '?' ELSE text END AS t, CASE WHEN x1 % 50 = 0 THEN confidence - 0.02 ELSE confidence END AS c FROM boxes_v)) GROUP BY 1""",
    "text_key": r"""SELECT track_id, pos, replace(lower(regexp_replace(nfc_normalize(text), '[^\p{L}\p{N}]', '', 'g')), 'ß', 'ss') AS key FROM cues_v""",
    "transition_backdate": "SELECT track_id, n, event_us, text, backdated FROM ocr_events",
    "event_intervals": "SELECT track_id, n, event_us, end_us FROM intervals WHERE text <> ''",
    "cue_build": r"""SELECT track_id, cue_n, min(event_us) AS start_us, arg_max(end_us, n) AS end_us, arg_min(text, n) AS text FROM (
        SELECT *, max(CASE WHEN coalesce(before = text, false) THEN NULL ELSE n END) OVER (PARTITION BY track_id ORDER BY n) AS cue_n FROM intervals WHERE text <> '') GROUP BY 1, 2""",
    "timestamp_format": f"""SELECT event_id, {code("CAST(greatest(0, round_even((value * 10 - 50) * 1000, 0)) AS BIGINT)")} AS code FROM events""",
    "timestamp_parse": r"""SELECT event_id, CASE WHEN k % 13 <> 0 AND k % 11 <> 0 AND m <= 59 AND s <= 59 THEN ((h * 60 + m) * 60 + s) * 1000 + CAST(floor(value * 100) AS BIGINT) % 1000 END AS ms
        FROM (SELECT *, hour(ts) + k % 70 AS h, minute(ts) + CASE WHEN k % 5 = 0 THEN 30 ELSE 0 END AS m, second(ts) + CASE WHEN k % 7 = 0 THEN 30 ELSE 0 END AS s
        FROM (SELECT *, CAST(floor(value) AS BIGINT) AS k FROM events))""",
    "track_validate": "SELECT track_id, NOT bool_or(broken) AS valid FROM checked GROUP BY 1",
    "overlap_count": """SELECT track_id, count(*) FILTER (laps) AS "overlaps" FROM checked GROUP BY 1""",
    "renumber": "SELECT track_id, pos, cue_no, new_no, cue_no <> new_no AS renumbered FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY pos) AS new_no FROM raw_cues_v WHERE text <> '')",
    "drop_empty": r"SELECT track_id, pos, regexp_replace(text, '^\s+|\s+$', '', 'g') AS text FROM raw_cues_v WHERE text <> ''",
    "body_normalise": "SELECT track_id, pos, nfc_normalize(body) AS body, norm FROM bodies",
    "duplicate_merge": "SELECT track_id, cue_pos, start_ms, end_ms, body, parts FROM merged",
    "quality_stats": "SELECT track_id, cue_count, duplicates_merged, suspect_cues, short_line_cues, max_lines, max_line_chars FROM stats",
    "quality_label": "SELECT track_id, CASE WHEN greatest(suspect_cues, short_line_cues) > 0 THEN 'REVIEW_REQUIRED' ELSE 'READY_FOR_REVIEW' END AS quality FROM stats",
    "normalize_track": r"""SELECT track_id, status, CASE WHEN status = 'OK' THEN overlapping_cues END AS overlapping_cues, CASE WHEN status = 'OK' THEN renumbered_cues END AS renumbered_cues,
        CASE WHEN status = 'OK' THEN empty_dropped END AS empty_dropped, CASE WHEN status = 'OK' THEN cue_count END AS cue_count, CASE WHEN status = 'OK' THEN duplicates_merged END AS duplicates_merged,
        CASE WHEN status = 'OK' THEN suspect_cues END AS suspect_cues, CASE WHEN status = 'OK' THEN short_line_cues END AS short_line_cues,
        CASE WHEN status = 'OK' THEN max_lines END AS max_lines, CASE WHEN status = 'OK' THEN max_line_chars END AS max_line_chars FROM (
        SELECT *, CASE WHEN broken THEN 'INVALID_ORDER' WHEN cue_count IS NULL THEN 'NO_TEXT' ELSE 'OK' END AS status FROM
        (SELECT track_id, bool_or(broken) AS broken, count(*) FILTER (laps) AS overlapping_cues, count(*) FILTER (renumbered) AS renumbered_cues, count(*) FILTER (text = '') AS empty_dropped FROM checked GROUP BY 1)
        LEFT JOIN stats USING (track_id))""",
    "normalize_cues": "SELECT track_id, cue_pos, start_ms, end_ms, body, parts FROM merged WHERE track_id NOT IN (SELECT track_id FROM checked WHERE broken)",
    "cue_shape": "SELECT track_id, CAST(sum(visible) AS BIGINT) AS visible, CAST(sum(alphabetic) AS BIGINT) AS alphabetic, CAST(sum(numeric) AS BIGINT) AS numeric FROM shaped GROUP BY 1",
    "weak_fragment": "SELECT track_id, pos, text FROM near WHERE weak",
    "strong_prefilter": "SELECT track_id, pos, text FROM removed WHERE gone",
    "needs_translation": r"SELECT track_id, pos, text FROM tokens_v WHERE NOT regexp_matches(text, '\p{L}')",
    "chunk_assign": "SELECT track_id, pos, (pos - 1) // 8 AS chunk_no FROM cues_v",
    "context_window": r"""SELECT track_id, chunk_no, string_agg(pos || ':' || text, '|' ORDER BY pos) FILTER (pos > a AND pos <= a + 12) AS targets,
        coalesce(string_agg(pos || ':' || text, '|' ORDER BY pos) FILTER (pos <= a), '') AS before, coalesce(string_agg(pos || ':' || text, '|' ORDER BY pos) FILTER (pos > a + 12), '') AS after
        FROM (SELECT DISTINCT track_id, (pos - 1) // 12 AS chunk_no, (pos - 1) // 12 * 12 AS a FROM cues_v) k JOIN cues_v c USING (track_id)
        WHERE pos > a - 4 AND pos <= a + 16 GROUP BY 1, 2""",
    "document_samples": "SELECT track_id, pos, text FROM picked",
    "task_options": r"""SELECT conv_id, turn, CASE WHEN mode = 'system' THEN 'MODE' WHEN length(g) > 4000 THEN 'GUIDANCE' WHEN l = '' OR strlen(l) > 64 OR regexp_matches(l, '[\x00-\x1f\x7f]') THEN 'LANGUAGE'
        WHEN mode = 'clean' AND s NOT IN ('light', 'balanced', 'strong') THEN 'STRENGTH' END AS reason, l AS language_text, CASE WHEN mode = 'clean' THEN s END AS strength_text, g AS guidance_text
        FROM (SELECT *, regexp_replace(language, '^\s+|\s+$', '', 'g') AS l, coalesce(trim(strength), 'balanced') AS s, regexp_replace(guidance, '^\s+|\s+$', '', 'g') AS g FROM requests_v)""",
    "source_select": r"""SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN 'cleaned' ELSE 'original' END AS source,
        CASE WHEN role = 'assistant' AND turn % 3 <> 0 THEN 'c:' || text ELSE text END AS input FROM requests_v""",
    "prompt_rows": r"""SELECT c.track_id, c.chunk_no, len(targets) = 1 AS single, CAST(to_json(s.texts[1:8]) AS VARCHAR) AS samples_json,
        CAST(to_json(coalesce((SELECT list(text ORDER BY pos) FROM cues_v q WHERE q.track_id = c.track_id AND pos > c.chunk_no * 12 - 4 AND pos <= c.chunk_no * 12), [])) AS VARCHAR) AS before_json,
        CAST(to_json(coalesce((SELECT list(text ORDER BY pos) FROM cues_v q WHERE q.track_id = c.track_id AND pos > c.chunk_no * 12 + 12 AND pos <= c.chunk_no * 12 + 16), [])) AS VARCHAR) AS after_json,
        CASE WHEN len(targets) = 1 THEN targets[1].text ELSE CAST(to_json(targets) AS VARCHAR) END AS payload
        FROM chunks c JOIN (SELECT track_id, list(text ORDER BY pos) AS texts FROM picked GROUP BY 1) s USING (track_id)""",
    "response_schema": r"""SELECT track_id, chunk_no, '{"type":"json_object","schema":{"type":"array","minItems":' || len(targets) || ',"maxItems":' || len(targets) ||
        ',"items":{"type":"object","properties":{"id":{"type":"integer","enum":[' || array_to_string(list_transform(targets, lambda t: t.id), ',') ||
        ']},"text":{"type":"string"}},"required":["id","text"],"additionalProperties":false}}}' AS response_format FROM chunks""",
    "work_split": r"""SELECT track_id, (pos - 1) // 12 AS chunk_no, count(*) FILTER (gone) AS by_rule, count(*) FILTER (NOT gone) AS for_model, bool_and(gone) AS finished FROM removed GROUP BY 1, 2""",
    "assistant_extract": r"""SELECT conv_id, turn, regexp_replace(text, '^\s+|\s+$', '', 'g') AS answer FROM conversations""",
    "json_repair": r"""SELECT track_id, chunk_no, c.id AS id, c.text AS text FROM (SELECT track_id, chunk_no, unnest(targets) AS c FROM chunks)""",
    "response_explode": r"""SELECT track_id, chunk_no, place, c.id AS id, c.text AS text FROM (SELECT track_id, chunk_no, unnest(range(0, len(cues))) AS place, unnest(cues) AS c FROM items)""",
    "target_validate": r"""SELECT track_id, chunk_no, CASE WHEN f = 7 THEN 'TRANSPORT' WHEN f = 0 THEN 'COUNT' WHEN f = 1 THEN 'DUPLICATE' WHEN f = 2 AND n > 1 THEN 'ORDER' WHEN f = 3 THEN 'EMPTY' ELSE 'OK' END AS verdict FROM faults""",
    "single_parse": r"""SELECT conv_id, turn, CASE WHEN k = 0 AND clean THEN 'OK' WHEN k = 0 THEN 'INVALID' WHEN k IN (1, 3) THEN 'UNUSABLE' WHEN k = 2 THEN 'UNUSABLE'
            WHEN k = 5 AND (conv_id + turn) % 16 = 5 THEN 'INVALID' ELSE 'OK' END AS status,
        CASE WHEN k = 0 AND clean THEN '' WHEN k = 0 THEN NULL WHEN k IN (1, 2, 3) THEN NULL WHEN k = 5 AND (conv_id + turn) % 16 = 5 THEN NULL ELSE t END AS answer
        FROM (SELECT conv_id, turn, turn % 2 = 0 AS clean, (conv_id + turn) % 8 AS k, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM conversations)""",
    "retry_plan": r"""SELECT t.track_id, first, past, CASE WHEN odd AND NOT dead THEN round + 1 ELSE round END AS round, odd AND NOT dead AS corrective, past - first AS targets,
        CASE WHEN dead OR (odd AND length(c.text) % 2 = 0) THEN 'stop' ELSE 'done' END AS action
        FROM tries t JOIN cues_v c ON c.track_id = t.track_id AND c.pos = t.past WHERE NOT (odd AND NOT dead AND past - first > 1)""",
    "error_class": r"""SELECT event_id, CASE event_type WHEN 'click' THEN 'model' WHEN 'error' THEN 'transport' WHEN 'signup' THEN 'transport' WHEN 'purchase' THEN 'other' ELSE 'none' END AS class,
        CASE WHEN event_type = 'click' AND event_id % 3 = 2 THEN 'split' WHEN event_type = 'click' AND event_id % 3 = 1 THEN 'retry' ELSE 'stop' END AS action FROM events""",
    "decisions_merge": r"""SELECT track_id, pos, CASE WHEN length(text) % 7 = 0 THEN '' WHEN ok THEN CASE WHEN f = 3 AND pos = chunk_no * 12 + 1 THEN '' ELSE regexp_replace(text, '^\s+|\s+$', '', 'g') END END AS text,
        CASE WHEN length(text) % 7 = 0 THEN 'remove' WHEN ok THEN 'model' ELSE 'missing' END AS route
        FROM (SELECT c.*, k.chunk_no, f, f IN (3, 4, 5, 6) OR (f = 2 AND n = 1) AS ok FROM cues_v c JOIN faults k ON k.track_id = c.track_id AND k.chunk_no = (c.pos - 1) // 12)""",
    "result_render": f"""SELECT track_id, (pos - 1) // 4096 AS part_no, string_agg(pos || chr(10) || {code('start_ms')} || ' --> ' || {code('end_ms')} || chr(10) || text || chr(10) || chr(10), '' ORDER BY pos) AS content FROM decided GROUP BY 1, 2""",
    "result_summary": r"""SELECT track_id, count(*) FILTER (trim(text) <> '') AS cue_count, count(*) AS source_cue_count, count(*) FILTER (trim(text) = '') AS dropped_cue_count, count(*) FILTER (text IS NULL) AS undecided_cue_count FROM decisions_v GROUP BY 1""",
    "before_after": r"""SELECT track_id, pos, c.text AS before, CASE WHEN trim(d.text) <> '' THEN regexp_replace(d.text, '^\s+|\s+$', '', 'g') END AS after,
        CASE WHEN trim(d.text) = '' THEN 'removed' WHEN c.text = regexp_replace(d.text, '^\s+|\s+$', '', 'g') THEN 'kept' ELSE 'edited' END AS change FROM cues_v c JOIN decisions_v d USING (track_id, pos)""",
    "log_excerpt": r"""SELECT doc_id, CASE WHEN length(text) > 32000 THEN left(text, 32000) || chr(10) || '[truncated]' || chr(10) ELSE text END AS excerpt FROM documents""",
    "log_sanitise": "SELECT run_id, line_no, line FROM logs_v WHERE line_no % 9 <> 0",
    "summary_parse": r"""SELECT run_id, split_part(line, '=', 1) AS key, arg_max(substr(line, strpos(line, '=') + 1), line_no) AS value
        FROM logs_v JOIN spans USING (run_id) WHERE line_no > first_start AND (first_end IS NULL OR line_no < first_end) AND line NOT LIKE '---%' AND contains(line, '=') GROUP BY 1, 2""",
    "stage_classify": r"""SELECT run_id, line_no, CASE WHEN line_no % 50 = 0 THEN 'complete' WHEN p <= 99 OR line LIKE '1/2%' THEN 'ocr' WHEN line LIKE '%RESULT START%' THEN 'finalize' END AS stage,
        CASE WHEN line_no % 50 = 0 THEN 'Subtitles ready' WHEN p <= 99 THEN 'Scanning and recognizing subtitles' WHEN line LIKE '1/2%' THEN 'Scanning subtitles with the native OCR engine' WHEN line LIKE '%RESULT START%' THEN 'Preparing results' END AS label,
        CASE WHEN line_no % 50 = 0 THEN 100 WHEN p <= 99 THEN p END AS percent FROM (SELECT *, TRY_CAST(regexp_extract(line, '^OCRProgress=(\d+)$', 1) AS BIGINT) AS p FROM logs_v)""",
    "failure_message": r"""SELECT run_id, trim(replace(coalesce(arg_max(line, line_no) FILTER (line LIKE 'ERROR:%'), arg_max(line, line_no)), 'ERROR:', '')) || ' (pipeline code: 2)' AS message
        FROM logs_v WHERE NOT (run_id % 3 = 0 AND line LIKE 'ERROR%') GROUP BY 1""",
    "cancel_classify": "SELECT event_id, CASE event_type WHEN 'error' THEN 'CANCELLED' WHEN 'click' THEN 'FAILED' ELSE 'COMPLETE' END AS status FROM events",
    "attempt_rollup": "SELECT * FROM rolled",
    "summary_render": r"""SELECT run_id, array_to_string(['--- TRACK PIPELINE 1 RESULT START ---', 'Pipeline=' || last_status, 'Attempts=' || attempts, 'OCRFallback=' || CASE WHEN fallback_reason IS NOT NULL THEN 'True' ELSE 'False' END,
        'Error=' || coalesce(CASE WHEN last_status <> 'COMPLETE' THEN fallback_reason END, ''), '--- TRACK PIPELINE 1 RESULT END ---'], chr(10)) AS summary FROM rolled""",
    "latest_per_group": "SELECT run_id, arg_max(line, line_no) AS latest, count(*) AS history FROM logs_v GROUP BY 1",
    "telemetry_extract": r"""SELECT track_id AS run_id, arg_min(CAST(floor(value / 10) AS BIGINT), n) FILTER (event_type = 'purchase') AS layers,
        CASE WHEN count(*) FILTER (event_type = 'purchase') > 0 THEN 65 END AS layer_total,
        CASE WHEN count(*) FILTER (event_type = 'click' AND floor(value * 40) <= 12288) > 0 THEN 12288 END AS memory_total,
        arg_min(CAST(floor(value * 40) AS BIGINT), n) FILTER (event_type = 'click' AND floor(value * 40) <= 12288) AS memory_free FROM ev GROUP BY 1""",
    "progress_marks": r"""SELECT track_id, idx, p AS percent FROM (SELECT *, max(p) OVER (PARTITION BY track_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m
        FROM (SELECT track_id, idx, least(99, idx * 100 // count(*) OVER (PARTITION BY track_id)) AS p
        FROM (SELECT user_id % 10 AS track_id, row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) - 1 AS idx FROM events))) WHERE m IS NULL OR p > m""",
    "asset_verify": "SELECT path, verdict FROM verdicts",
    "incremental_verify": r"""SELECT path, CASE WHEN c THEN 'OK' ELSE verdict END AS verdict, c AS cached FROM (SELECT *, coalesce(doc_id % 4 = 0 AND digest = lower(sha256), false) AS c FROM verdicts)""",
}

SQL["prompt_text"] = r"""SELECT k.track_id, k.chunk_no, 'Translate into German. ' ||
        CASE WHEN n = 1 THEN 'Answer with the translated cue only and keep its line breaks.' ELSE 'Answer with a JSON array of {"id":number,"text":string}, one per input in order.' END ||
        chr(10) || 'Guidance: short' || chr(10) || 'Samples: []' || chr(10) || 'Before: ' ||
        CAST(to_json(coalesce((SELECT list(text ORDER BY pos) FROM cues_v q WHERE q.track_id = k.track_id AND pos > k.chunk_no * 8 - 4 AND pos <= k.chunk_no * 8), [])) AS VARCHAR) || chr(10) || 'After: ' ||
        CAST(to_json(coalesce((SELECT list(text ORDER BY pos) FROM cues_v q WHERE q.track_id = k.track_id AND pos > k.chunk_no * 8 + 8 AND pos <= k.chunk_no * 8 + 12), [])) AS VARCHAR) || chr(10) || 'Input: ' ||
        CASE WHEN n = 1 THEN targets[1].text ELSE CAST(to_json(targets) AS VARCHAR) END AS prompt
        FROM (SELECT track_id, (pos - 1) // 8 AS chunk_no, count(*) AS n, list({'id': pos, 'text': text} ORDER BY pos) AS targets FROM cues_v WHERE regexp_matches(text, '\p{L}') GROUP BY 1, 2) k"""

_FILE_STATUS = "CASE WHEN track_id % 11 = 0 THEN 'EXTENSION' WHEN track_id % 13 = 0 THEN 'SIZE' WHEN track_id % 7 = 0 THEN 'INVALID_FORMAT' WHEN track_id % 5 = 0 THEN 'INVALID_TIMECODE' END"
SQL["cue_files"] = f"""SELECT track_id, coalesce(fault, status) AS status, CASE WHEN fault IS NULL AND status = 'OK' THEN 0 END AS renumbered_cues, """ + ", ".join(
    f"CASE WHEN fault IS NULL THEN {c} END AS {c}" for c in ("overlapping_cues", "empty_dropped", "cue_count", "duplicates_merged", "suspect_cues", "short_line_cues", "max_lines", "max_line_chars")
) + f" FROM (SELECT *, {_FILE_STATUS} AS fault FROM ({SQL['normalize_track']}))"
_GIVEN = {"string": "event_type", "bigint": "event_id", "double": "round(value, 3)", "boolean": "event_id % 2 = 0"}
_SET = {"elapsed_seconds": "round(value * 2, 3)", "ocr_total_seconds": "round(CASE WHEN event_id % 2 = 0 THEN value ELSE value / 2 END, 3)", "ocr_count": "3",
        "frame_count": "CASE WHEN event_id % 7 <> 0 THEN event_id END"}
SQL["metrics_flatten"] = "SELECT event_id AS run_id, " + ", ".join(
    f"CASE WHEN event_id % 23 <> 0 THEN {_SET.get(n, f'CASE WHEN event_id % {k + 2} <> 0 THEN {_GIVEN[t]} END')} END AS {n}" for k, (n, t) in enumerate(fixed.METRIC_FIELDS)
) + """, CASE WHEN event_id % 23 <> 0 AND event_id % 7 = 0 THEN 'frame_count' ELSE '' END AS bad_fields,
    CASE WHEN event_id % 23 <> 0 THEN round(greatest(0, CASE WHEN event_id % 2 = 0 THEN value ELSE value / 2 END - (floor(value) / 4 + floor(value) / 2)), 3) END AS unattributed_seconds FROM events"""
SQL["metrics_stages"] = """SELECT event_id AS run_id, stage, round(CASE stage WHEN 'other' THEN value WHEN 'detector_forward_seconds' THEN floor(value) / 4 ELSE floor(value) / 2 END, 3) AS seconds
    FROM events, (VALUES ('detector_forward_seconds'), ('recognizer_forward_seconds'), ('other')) s(stage) WHERE event_id % 23 <> 0"""
SQL["metrics_nested"] = """SELECT event_id AS run_id, field, place, key, CASE WHEN key = '8' THEN CAST(event_id % 5 AS VARCHAR) WHEN key = '2' THEN '1' WHEN place = 0 THEN 'GPU' ELSE event_type END AS value
    FROM events, (VALUES ('available_providers', 0, NULL), ('available_providers', 1, NULL), ('recognizer_batch_histogram', NULL, '8'), ('recognizer_batch_histogram', NULL, '2')) s(field, place, key)
    WHERE event_id % 23 <> 0"""
SQL["track_cues"] = """SELECT track_id, cue_n, min(event_us) AS start_us, arg_max(CASE WHEN next_us <= event_us THEN event_us + 500000 ELSE next_us END, n) AS end_us, arg_min(text, n) AS text FROM (
    SELECT *, max(CASE WHEN coalesce(before = text, false) THEN NULL ELSE n END) OVER (PARTITION BY track_id ORDER BY n) AS cue_n FROM film_linked WHERE text <> '') GROUP BY 1, 2"""
SQL["model_loop"] = f"""SELECT track_id, (pos - 1) // 4096 AS part_no, string_agg(pos || chr(10) || {code('start_ms')} || ' --> ' || {code('end_ms')} || chr(10) ||
        CASE WHEN sent THEN regexp_replace(text || CASE WHEN n % 5 = 0 THEN '!' ELSE '' END, '^\\s+|\\s+$', '', 'g') ELSE text END || chr(10) || chr(10), '' ORDER BY pos) AS content
    FROM asked WHERE track_id NOT IN (SELECT track_id FROM asked WHERE sent AND (n % 211 = 0 OR n % 29 = 0 AND n % 2 = 0)) GROUP BY 1, 2"""
SQL["stream_ocr_gate"] = "SELECT track_id, n, ms * 1000 AS ts_us, kept FROM retimed_gate"
SQL["frame_change_gate"] = r"""SELECT * FROM (WITH
    g AS (SELECT CAST(label AS BIGINT) AS track_id, vec_id + 1 AS n, list_transform(embedding, lambda v: CAST(floor(abs(CAST(v AS DOUBLE)) * 800) AS BIGINT) % 256) AS a FROM embeddings),
    f AS (SELECT *, lag(a) OVER (PARTITION BY track_id ORDER BY n) AS b FROM g),
    p AS (SELECT track_id, n, i // 8 AS y, i % 8 AS x, a[i + 1] - b[i + 1] AS d, abs(a[i + 1] - b[i + 1]) AS m FROM f, range(64) r(i) WHERE b IS NOT NULL),
    cut AS (SELECT track_id, n, count(*) FILTER (m > 32) > 64 * 0.35 AND abs(avg(d)) > 28 AS hard FROM p GROUP BY 1, 2),
    r AS (SELECT track_id, n, y, sum(m) AS s FROM p GROUP BY 1, 2, 3),
    e AS (SELECT track_id, n, y, s + coalesce(lag(s) OVER w, 0) + coalesce(lead(s) OVER w, 0) AS e FROM r WINDOW w AS (PARTITION BY track_id, n ORDER BY y)),
    u AS (SELECT track_id, n, median(e) AS usual FROM e GROUP BY 1, 2),
    busy AS (SELECT track_id, n, y, y - row_number() OVER (PARTITION BY track_id, n ORDER BY y) AS run FROM e JOIN u USING (track_id, n) WHERE e >= usual + greatest(48, usual * 0.06)),
    band AS (SELECT track_id, n, run, greatest(min(y) - 1, 0) AS lo, least(max(y) + 2, 8) AS hi FROM busy GROUP BY 1, 2, 3 HAVING max(y) - min(y) BETWEEN 1 AND 4),
    c AS (SELECT track_id, n, run, x, hi - lo AS depth, sum(m) FILTER (y >= lo AND y < hi) AS inside, sum(m) AS whole, count(*) FILTER (m > 32 AND y >= lo AND y < hi) AS hot
        FROM band JOIN p USING (track_id, n) GROUP BY 1, 2, 3, 4, 5),
    lit AS (SELECT *, inside * greatest(1, 8 - depth) - (whole - inside) * depth >= greatest(32, depth * 8) * greatest(1, 8 - depth) AS lit FROM c),
    span AS (SELECT track_id, n, run, count(*) FILTER (lit) AS lit, max(x) FILTER (lit) - min(x) FILTER (lit) + 1 AS span, sum(hot) AS hot FROM lit GROUP BY 1, 2, 3),
    text AS (SELECT DISTINCT track_id, n FROM span WHERE lit >= 2 AND span >= 8 * 0.18 AND span <= 8 * 0.96 AND hot <= 40)
    SELECT track_id, n, coalesce(hard, false) OR text.n IS NOT NULL AS changed FROM f LEFT JOIN cut USING (track_id, n) LEFT JOIN text USING (track_id, n))"""
SQL["stream_late_audit"] = """SELECT track_id, count(*) AS samples, count(*) FILTER (repaired) AS repaired, count(*) FILTER (late) AS late FROM taken_times GROUP BY 1"""
SQL["stream_late_samples"] = "SELECT track_id, n, given_us, ts_us, text FROM given_times WHERE ts_us <> given_us"
SQL["stream_cues"] = SQL["cue_build"]
SQL["stream_progress"] = r"""SELECT run_id, max(CASE WHEN p <= 99 THEN p END) AS percent,
    count(*) FILTER (p <= 99 OR line LIKE '1/2%' OR line LIKE '%RESULT START%') AS lines
    FROM (SELECT *, TRY_CAST(regexp_extract(line, '^OCRProgress=(\d+)$', 1) AS BIGINT) AS p FROM logs_v) GROUP BY 1
    HAVING count(*) FILTER (p <= 99 OR line LIKE '1/2%' OR line LIKE '%RESULT START%') > 0"""

KEPT_RAW = "(SELECT * FROM raw_cues_v WHERE text <> '')"


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql, KEPT_RAW if name in ("normalize_track", "normalize_cues", "cue_files") else "cues_v")
            for name, sql in SQL.items()}
