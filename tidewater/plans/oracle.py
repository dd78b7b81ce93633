"""DuckDB SQL of the queries in queries.py, for comparison on the same tables."""

from __future__ import annotations

T = 60


def u(seed: int, *keys: str) -> str:
    """functions.chance.uniform() in SQL."""
    text = " || ':' || ".join([f"'{seed}'", *[f"coalesce(({k})::VARCHAR, '')" for k in keys]])
    return f"(('0x' || substr(md5({text}), 1, 8))::UBIGINT::DOUBLE / 4294967296::DOUBLE)"


def jitter(start: str, end: str, chance: str) -> str:
    span = f"floor((epoch_us({end}) - epoch_us({start})) / 1000000)"
    return f"CASE WHEN {span} > 0 THEN {start} + to_seconds(floor({chance} * {span})::BIGINT) ELSE {start} END"


def _moved(seed: int, over: str) -> str:
    c = u(seed, "event_id")
    return f"""SELECT *, CASE WHEN nv = user_id THEN {jitter("ts", "nt", c)} WHEN pv = user_id THEN {jitter("pt", "ts", c)} ELSE ts END AS sel_ts
      FROM (SELECT *, lead(user_id) OVER w AS nv, lead(ts) OVER w AS nt, lag(user_id) OVER w AS pv, lag(ts) OVER w AS pt FROM events WINDOW w AS (PARTITION BY {over} ORDER BY ts, event_id))"""


def _visits(gap: int, source: str = "events") -> str:
    return f"""SELECT user_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n FROM
      (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM
        (SELECT *, coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts)) > {gap * 1_000_000})::INT, 0) AS new FROM {source}))
      GROUP BY user_id, s"""


_SIDES = "p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS start, 'rec_' || lpad(event_id::VARCHAR, 12, '0') AS path FROM events WHERE event_type = 'view')"


def _nearest2(op: str) -> str:
    return f"""WITH {_SIDES},
      x AS (SELECT p.*, r.path, r.start, row_number() OVER (PARTITION BY event_id ORDER BY abs(epoch_us(ts) - epoch_us(start)), path) AS k FROM p JOIN r USING (user_id)),
      hit AS (SELECT event_id, arg_min(path, k) AS match_path, arg_min(start, k) AS match_start FROM x WHERE k <= 2 AND ts {op} start GROUP BY event_id)
      SELECT p.event_id, p.user_id, p.ts, match_path, match_start FROM p LEFT JOIN hit USING (event_id)"""


_ASOF = f"""WITH {_SIDES}, one AS (SELECT user_id, start, max(path) AS path FROM r GROUP BY ALL),
  m AS (SELECT p.event_id, p.user_id, p.ts, one.path AS match_path, one.start AS match_start FROM p ASOF LEFT JOIN one ON p.user_id = one.user_id AND p.ts >= one.start)"""

_NAMED = """x AS (SELECT event_id, CASE event_id % 8
    WHEN 0 THEN 'a/b/SITE_' || strftime(ts, '%Y%m%d_%H%M%S') || '.flac' WHEN 1 THEN 'a/b/SITE_' || strftime(ts, '%Y%m%d_%H%M') || '60.wav'
    WHEN 2 THEN 'a/b/SITE_' || strftime(ts, '%y%m%d%H%M%S') || '.flac' WHEN 3 THEN 'a/b/SITE_' || strftime(ts, '%y%m%d_%H%M%S') || '.flac'
    WHEN 4 THEN 'a/b/SITE_69' || strftime(ts, '%m%d_%H%M%S') || '.flac' WHEN 5 THEN 'a/b/SITE_' || strftime(ts, '%Y%m%d_%H%M') || 'xo.flac'
    WHEN 6 THEN 'a/b/SITE_Post-Deployment_' || strftime(ts, '%Y%m%d_%H%M%S') || '.flac' ELSE 'a/b/notes.txt' END AS path FROM events),
  k AS (SELECT *, string_split(string_split(string_split(path, '/')[-1], '.')[1], '_') AS t FROM x),
  j AS (SELECT *, coalesce(t[-2], '') || ' ' || t[-1] AS s, t[-1] AS last FROM k),
  st AS (SELECT event_id, path, coalesce(
    CASE WHEN regexp_full_match(s, '\\d{8} \\d{6}') THEN try_strptime(s, '%Y%m%d %H%M%S') END,
    CASE WHEN regexp_full_match(s, '\\d{8} \\d{4}60') THEN try_strptime(s[:-3] || '59', '%Y%m%d %H%M%S') END,
    CASE WHEN regexp_full_match(last, '\\d{12}') THEN try_strptime(last, '%y%m%d%H%M%S') END,
    CASE WHEN regexp_full_match(s, '\\d{6} \\d{6}') THEN try_strptime(s, '%y%m%d %H%M%S') END) AS start_ts FROM j)"""

_TRACK = """t0 AS (SELECT event_id, ts, (event_id % 120 - 60)::DOUBLE AS lat, (user_id % 300 - 150)::DOUBLE AS lon, event_id % 23 + 0.5::DOUBLE AS sog, (event_id * 7 % 360)::DOUBLE AS cog FROM events),
  t1 AS (SELECT *, sqrt(1 - 6.69437999014e-3 * sin(radians(lat)) * sin(radians(lat))) AS w FROM t0),
  t AS (SELECT *, 6378137.0 * (1 - 6.69437999014e-3) / (w * w * w) AS north, 6378137.0 * cos(radians(lat)) / w AS east FROM t1)"""


def _reckoned(seconds: str) -> tuple[str, str]:
    d = f"sog * (1852.0::DOUBLE / 3600.0::DOUBLE) * ({seconds})"
    return f"(lat + degrees({d} * cos(radians(cog)) / north))", f"(lon + degrees({d} * sin(radians(cog)) / east))"


_ANN = """a0 AS (SELECT event_id AS idx, value > 1.0 AS ok, CASE WHEN event_type = 'error' THEN ' ' ELSE event_type || ' sp' END AS label,
    'day' || dayofyear(ts) || '/' || (user_id % 10) AS path, 'f' || dayofyear(ts) || '_' || (user_id % 10) AS sound,
    (hour(ts) * 3600 + minute(ts) * 60 + second(ts))::DOUBLE AS b, value FROM events),
  a AS (SELECT *, b + value - 2.0 AS e FROM a0 WHERE ok AND trim(label) <> ''),
  g AS (SELECT * FROM a WHERE e > b)"""
_WIN = f"""{_ANN},
  w0 AS (SELECT *, CASE WHEN e - b <= 5.0 THEN b - {u(42, "idx")} * (5.0 - (e - b)) ELSE b + {u(42, "idx")} * (e - b - 5.0) END AS s FROM g),
  w AS (SELECT *, least(greatest(s, 0.0), 86395.0) AS ws FROM w0),
  ww AS (SELECT *, least(ws + 5.0, 86400.0) AS we FROM w)"""
_LAB = f"""{_WIN},
  o AS (SELECT x.idx, y.label AS l FROM ww x JOIN g y ON x.path = y.path AND greatest(0.0, least(x.we, y.e) - greatest(x.ws, y.b)) / least(5.0, y.e - y.b) > 0.3),
  c AS (SELECT idx, count(*) AS n FROM o GROUP BY idx),
  ls AS (SELECT idx, list_sort(list(DISTINCT l)) AS ls FROM (SELECT idx, l FROM o UNION SELECT idx, label FROM ww) GROUP BY idx),
  lab AS (SELECT idx, array_to_string(ls, '|') AS labels, coalesce(n, 0) AS num_annotations, len(ls) AS num_labels, len(ls) > 1 AS multilabel FROM ls LEFT JOIN c USING (idx))"""

_SPLIT = """per AS (SELECT o_custkey, min(o_orderdate) AS first_ts, count(*) AS n FROM orders GROUP BY o_custkey),
  cum AS (SELECT *, sum(n) OVER (ORDER BY first_ts, o_custkey) AS cum FROM per),
  sp AS (SELECT o_custkey, first_ts, n, cum, CASE WHEN cum - n < 0.8 * (SELECT sum(n) FROM per) THEN 'train' ELSE 'test' END AS split FROM cum)"""

_IDX = "i AS (SELECT event_id, ceil(value / 5.0)::BIGINT AS n_windows FROM events), ix AS (SELECT *, coalesce(sum(n_windows) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM i)"

_CENT = """ev AS (SELECT vec_id, label, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings),
  ce AS (SELECT label AS cid, pos, avg(x) AS x, count(*) AS n FROM ev GROUP BY label, pos),
  cv AS (SELECT cid, list(x ORDER BY pos) AS v, max(n) AS n FROM ce GROUP BY cid),
  d AS (SELECT vec_id, label, cid, list_sum(list_transform(list_zip(embedding::DOUBLE[], v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS dist FROM embeddings, cv),
  nn AS (SELECT vec_id, label, arg_min(cid, (round(dist, 12), cid)) AS cid, min(dist) AS dist FROM d GROUP BY vec_id, label)"""

_SIZES = "sz AS (SELECT n_regionkey, n_nationkey, sum(c_custkey % 7) AS size, (n_regionkey + 1) * 150 AS target FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def _cut(rel: str, parent: str, child: str) -> str:
    """The cut by trying every whole number up to the largest size."""
    return f"""ct AS (SELECT {parent}, max(x) AS cut FROM (
      SELECT {parent}, x, target, sum(least(x, size)) AS s FROM {rel}, (SELECT unnest(range(0, (SELECT max(size)::BIGINT FROM {rel}) + 1)) AS x)
      WHERE x <= (SELECT max(size) FROM {rel} z WHERE z.{parent} = {rel}.{parent}) GROUP BY {parent}, x, target) WHERE s <= target GROUP BY {parent})"""


def _quota(rel: str, parent: str, child: str, seed: int) -> str:
    return f"""{_cut(rel, parent, child)},
  qb AS (SELECT {rel}.*, cut, least(cut, size) AS base FROM {rel} JOIN ct USING ({parent})),
  ql AS (SELECT *, least(target, sum(size) OVER (PARTITION BY {parent})) - sum(base) OVER (PARTITION BY {parent}) AS rest,
     row_number() OVER (PARTITION BY {parent}, size > cut ORDER BY {u(seed, parent, child)}, {child}) AS k FROM qb),
  qq AS (SELECT *, (base + CASE WHEN size > cut AND k <= rest THEN 1 ELSE 0 END)::BIGINT AS quota FROM ql)"""


def _tree(target: int, seed: int) -> str:
    top = _quota("s1", "root", "n_regionkey", seed)
    low = _quota("s2", "n_regionkey", "n_nationkey", seed + 1).replace("ct AS", "ct2 AS").replace("JOIN ct ", "JOIN ct2 ").replace("qb AS", "qb2 AS").replace("FROM qb)", "FROM qb2)").replace("ql AS", "ql2 AS").replace("FROM ql)", "FROM ql2)").replace("qq AS", "qq2 AS")
    return f"""cn AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey),
  s1 AS (SELECT 0 AS root, n_regionkey, count(*) AS size, {target} AS target FROM cn GROUP BY n_regionkey), {top},
  s2 AS (SELECT n_regionkey, n_nationkey, count(*) AS size, max(quota) AS target FROM cn JOIN (SELECT n_regionkey, quota FROM qq WHERE quota > 0) USING (n_regionkey) GROUP BY n_regionkey, n_nationkey), {low}"""


_DRAW = """dr AS (SELECT c_custkey, n_regionkey, quota, count(*) OVER w AS n, row_number() OVER (w ORDER BY {by}, c_custkey) AS r FROM cn JOIN (SELECT n_regionkey, n_nationkey, quota FROM qq2 WHERE quota > 0) USING (n_regionkey, n_nationkey) WINDOW w AS (PARTITION BY n_regionkey, n_nationkey)),
  co AS (SELECT c_custkey, n_regionkey, unnest(range(1, (quota // n + CASE WHEN r <= quota % n THEN 1 ELSE 0 END + 1)::BIGINT)) AS copy FROM dr)"""

_SCORES = "sc AS (SELECT vec_id, cls, (label = cls)::INT AS positive, round(embedding[cls + 1]::DOUBLE, 2) AS score FROM embeddings, (SELECT unnest(range(0, 10)) AS cls))"
_AP = f"""{_SCORES}, tie AS (SELECT cls, score, sum(positive) AS p, count(*) AS n FROM sc GROUP BY cls, score),
  run AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS al FROM tie WINDOW w AS (PARTITION BY cls ORDER BY score DESC)),
  ap AS (SELECT cls, sum(p * tp / al) / sum(p) AS ap, sum(p) AS n_pos FROM run GROUP BY cls)"""
_AUC = f"""{_SCORES}, rk AS (SELECT *, rank() OVER (PARTITION BY cls ORDER BY score) + (count(*) OVER (PARTITION BY cls, score) - 1) / 2.0 AS r FROM sc),
  auc AS (SELECT cls, (sum(CASE WHEN positive = 1 THEN r END) - sum(positive) * (sum(positive) + 1) / 2.0) / (sum(positive) * (count(*) - sum(positive))) AS auc, sum(positive) AS n_pos FROM rk GROUP BY cls)"""


#: Columns whose type DuckDB would make wider than Spark's.
_TYPES = {
    "overlap_labels": {"num_labels": "INT"},
    "window_metadata": {"num_labels": "INT"},
    "temporal_split_80": {"cum": "BIGINT"},
    "class_codes": {"code": "INT"},
    "total_windows": {"n": "BIGINT"},
    "prefix_index": {"lo": "BIGINT", "hi": "BIGINT"},
    "index_lookup": {"win_idx": "BIGINT"},
    "centroids_by_label": {"pos": "INT"},
    "cluster_members": {"cid": "INT", "n": "INT"},
    "cluster_members_seen": {"cid": "INT", "n": "INT"},
    "lloyd_step": {"pos": "INT"},
    "online_update": {"pos": "INT"},
    "closest_s_per_cluster": {"rank": "INT"},
    "cluster_distance_order": {"rank": "INT"},
    "flat_cluster_sizes": {"size_rank": "INT"},
    "waterfill_cut": {"size": "BIGINT"},
    "waterfill_quota": {"size": "BIGINT"},
    "hier_sample": {"most_copies": "INT"},
    "hier_sample_rows": {"copy": "INT"},
    "average_precision": {"cls": "INT", "n_pos": "BIGINT"},
    "roc_auc_ovr": {"cls": "INT", "n_pos": "BIGINT"},
    "mean_pooled": {"pos": "INT"},
}


def oracle_sql() -> dict[str, str]:
    """The SQL of each query by name."""
    casts = {n: ", ".join(f"{c}::{t} AS {c}" for c, t in types.items()) for n, types in _TYPES.items()}
    return {n: f"SELECT * REPLACE ({casts[n]}) FROM ({s})" if n in casts else s for n, s in _sql().items()}


def _sql() -> dict[str, str]:
    return {
        "ping_counts": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
        "merged_counts": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
        "inclusion_prob": f"SELECT user_id, count(*) AS n, {T}::DOUBLE / greatest({T}, count(*)) AS p FROM events GROUP BY user_id",
        "rarity_sample": f"""WITH m AS ({_moved(43, "event_type")}), c AS (SELECT user_id, {T}::DOUBLE / greatest({T}, count(*)) AS p FROM events GROUP BY user_id)
          SELECT event_id, event_type AS ais_file, user_id AS mmsi, ts, sel_ts, p FROM m JOIN c USING (user_id) WHERE {u(42, "event_id")} < p""",
        "neighbour_jitter": f"""SELECT event_id, sel_ts FROM ({_moved(1, "event_type, user_id")})""",
        "neighbour_jitter_by_file": f"""SELECT event_id, sel_ts FROM ({_moved(1, "event_type")})""",
        "random_per_cluster": f"SELECT vec_id, label FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY {u(3, 'vec_id')}, vec_id) <= 7",
        "reservoir_sample": f"SELECT event_id, user_id FROM events ORDER BY {u(5, 'event_id')}, event_id LIMIT 100",
        "visit_sessions_10m": _visits(600),
        "visit_sessions_6h": _visits(6 * 3600),
        "visit_sessions_builtin": _visits(600),
        "anti_join_visits": f"""WITH v AS ({_visits(24 * 3600, "(SELECT * FROM events WHERE event_type = 'purchase')")})
          SELECT event_id, user_id, ts FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM v WHERE v.user_id = e.user_id AND e.ts BETWEEN start_time AND end_time)""",
        "anti_join_anywhere": """WITH v AS (SELECT ts AS a, ts + to_seconds(floor(value * 10)::BIGINT) AS b FROM events WHERE event_type = 'error')
          SELECT event_id, ts FROM events e WHERE event_type = 'view' AND NOT EXISTS (SELECT 1 FROM v WHERE e.ts BETWEEN a AND b)""",
        "match_nearest2_strict": _nearest2(">"),
        "match_nearest2_nonstrict": _nearest2(">="),
        "match_asof": f"{_ASOF} SELECT * FROM m",
        "clip_offsets": f"""{_ASOF} SELECT event_id, (epoch_us(ts) - epoch_us(match_start)) // 1000000 AS offset_s, match_path || '_' || strftime(ts, '%Y%m%d_%H%M%S') || '.flac' AS clip FROM m WHERE match_path IS NOT NULL""",
        "deployment_lookup": """WITH d AS (SELECT ['AUTOMOBILE', 'BUILDING', 'HOUSEHOLD', 'MACHINERY'][p_size % 4 + 1] AS segment, arg_min(p_name, p_partkey) AS deployment FROM part GROUP BY 1)
          SELECT c_custkey, c_mktsegment, deployment FROM customer JOIN d ON c_mktsegment = segment""",
        "deployment_keys": "SELECT c_custkey, r_name || '/' || n_name || '/' || c_name AS deployment FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
        "name_time_ladder": f"WITH {_NAMED} SELECT event_id, path, start_ts FROM st WHERE (path LIKE '%.flac' OR path LIKE '%.wav') AND path NOT LIKE '%Post-Deployment%'",
        "name_utc_time": "SELECT event_id, CASE WHEN event_type = 'view' THEN date_trunc('second', ts) END AS start_ts FROM events",
        "unparsed_names": f"WITH {_NAMED} SELECT count(start_ts) AS parsed, count(*) - count(start_ts) AS missing FROM st",
        "path_parts": r"SELECT page_id, string_split(url, '/')[-1] AS base, regexp_replace(string_split(url, '/')[-1], '\.[^.]*$', '') AS stem, string_split(url, '/')[-2] AS parent FROM pages",
        "clean_labels": "SELECT p_partkey, translate(p_name || '/' || p_type, '/\\ ', '___') AS label FROM part",
        "remote_paths": "SELECT p_partkey, lower(p_brand) || '/' || lower(p_type) || '/' || p_name || '.WAV' AS remote FROM part",
        "leading_dates": "SELECT o_orderkey, o_orderdate::DATE AS day, CASE WHEN o_orderdate < DATE '1996-01-01' THEN 'train' ELSE 'test' END AS split FROM orders",
        "usable_annotations": f'WITH {_ANN} SELECT idx, label AS "ClassSpecies" FROM a',
        "dead_letters": f"WITH {_ANN} SELECT idx, 'annotation ends no later than it begins' AS error FROM a WHERE NOT e > b",
        "random_windows": f"WITH {_WIN} SELECT idx, round(ws, 6) AS window_start, round(we, 6) AS window_end FROM ww",
        "overlap_labels": f"WITH {_LAB} SELECT * FROM lab",
        "window_metadata": f"""WITH {_LAB}, cl AS (SELECT *, translate(label, '/\\ ', '___') AS c FROM ww)
          SELECT c || '/' || sound || '_' || idx || '.wav' AS file, c AS primary_label, labels, multilabel, sound AS recording, 'set' AS dataset, path AS original_filepath,
            round(ws, 6) AS window_start, round(we, 6) AS window_end, round(we - ws, 6) AS window_length, round(b, 6) AS annotation_start, round(e, 6) AS annotation_end,
            num_annotations, num_labels, 48000 AS original_sample_rate, 16000 AS sample_rate FROM cl JOIN lab USING (idx)""",
        "multilabel_counts": f"WITH {_LAB} SELECT labels, multilabel, count(*) AS n FROM lab GROUP BY ALL",
        "annotation_profile": f"WITH {_ANN} SELECT count(*) AS n, count(DISTINCT path) AS n_recordings, count(DISTINCT label) AS n_classes FROM a",
        "new_files_only": "SELECT event_id, user_id FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100)",
        "groups_complete": "SELECT l_suppkey, bool_and(o_orderstatus <> 'P') AS complete FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_suppkey",
        "temporal_split_80": f"WITH {_SPLIT} SELECT * FROM sp",
        "split_label_counts": f"WITH {_SPLIT} SELECT split, o_orderpriority, count(*) AS n FROM orders JOIN sp USING (o_custkey) GROUP BY ALL",
        "split_test_rows": f"WITH {_SPLIT} SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM sp WHERE split = 'test')",
        "class_codes": "SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM (SELECT DISTINCT o_orderpriority FROM orders)",
        "shuffled_labels": f"SELECT vec_id, ['a', 'b', 'c'][floor({u(9, 'vec_id')} * 3)::INT + 1] AS shuffled_label FROM embeddings",
        "one_hot": """SELECT o_orderkey, o_orderstatus, (o_orderstatus = 'F')::INT AS "is_F", (o_orderstatus = 'O')::INT AS "is_O", (o_orderstatus = 'P')::INT AS "is_P" FROM orders""",
        "copy_plan": "SELECT url AS src, CASE WHEN page_id % 5 = 0 THEN 'test' ELSE 'train' END || '/ship/' || string_split(url, '/')[-1] AS dst FROM pages",
        "window_grid_floor": "SELECT event_id, win_idx, win_idx * 10.0::DOUBLE AS \"offset\" FROM (SELECT event_id, unnest(range(0, floor(value / 10.0)::BIGINT)) AS win_idx FROM events)",
        "window_grid_ceil": "SELECT event_id, win_idx, win_idx * 5.0::DOUBLE AS \"offset\" FROM (SELECT event_id, unnest(range(0, ceil(value / 5.0)::BIGINT)) AS win_idx FROM events)",
        "total_windows": "SELECT sum(ceil(value / 5.0)::BIGINT) AS n FROM events",
        "prefix_index": f"WITH {_IDX} SELECT event_id, n_windows, lo, lo + n_windows AS hi FROM ix",
        "index_lookup": f"WITH {_IDX}, q AS (SELECT event_id * 7 AS idx FROM events) SELECT idx, event_id, idx - lo AS win_idx FROM q JOIN ix ON idx >= lo AND idx < lo + n_windows",
        "tumbling_windows": "SELECT time_bucket(INTERVAL 10 SECOND, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "centroids_by_label": f"WITH {_CENT} SELECT cid AS label, n, pos, round(x, 6) AS x FROM ce",
        "nearest_centroid": f"WITH {_CENT} SELECT vec_id, cid, round(dist, 6) AS dist FROM nn",
        "nearest_centroid_cos": f"""WITH {_CENT}, dc AS (SELECT vec_id, cid, 2.0 - 2.0 * list_sum(list_transform(list_zip(embedding::DOUBLE[], v), lambda z: z[1] * z[2])) AS dist FROM embeddings, cv)
          SELECT vec_id, arg_min(cid, dist) AS cid, round(min(dist), 6) AS dist FROM dc GROUP BY vec_id""",
        "cluster_members": "SELECT c AS cid, coalesce(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id), '') AS members, count(vec_id) AS n FROM (SELECT unnest(range(0, 12)) AS c) LEFT JOIN embeddings ON label = c GROUP BY c",
        "cluster_members_seen": """WITH x AS (SELECT vec_id, label * 2 AS l FROM embeddings WHERE label <> 3), r AS (SELECT min(l) AS a, max(l) AS b FROM x)
          SELECT c AS cid, coalesce(string_agg(vec_id::VARCHAR, ',' ORDER BY vec_id), '') AS members, count(vec_id) AS n FROM (SELECT unnest(range(a, b + 1)) AS c FROM r) LEFT JOIN x ON l = c GROUP BY c""",
        "kmeans_potential": f"WITH {_CENT} SELECT round(sum(dist), 4) AS potential, count(*) AS n FROM d WHERE cid = label",
        "mean_nearest_distance": f"WITH {_CENT} SELECT round(avg(dist), 6) AS pot, count(DISTINCT cid) AS k FROM nn",
        "lloyd_step": f"""WITH {_CENT}, m AS (SELECT nn.cid, pos, avg(x) AS x FROM ev JOIN nn USING (vec_id) GROUP BY nn.cid, pos)
          SELECT ce.cid, ce.pos, round(coalesce(m.x, ce.x), 6) AS x FROM ce LEFT JOIN m ON m.cid = ce.cid AND m.pos = ce.pos""",
        "online_update": f"""WITH {_CENT}, m AS (SELECT nn.cid, pos, sum(x) AS s, count(*) AS k FROM ev JOIN nn USING (vec_id) GROUP BY nn.cid, pos)
          SELECT ce.cid, 1 + coalesce(k, 0) AS n, ce.pos, round((ce.x + coalesce(s, 0)) / (1 + coalesce(k, 0)), 6) AS x FROM ce LEFT JOIN m ON m.cid = ce.cid AND m.pos = ce.pos""",
        "closest_s_per_cluster": f"WITH {_CENT} SELECT cid, vec_id, row_number() OVER (PARTITION BY cid ORDER BY round(dist, 9), vec_id) AS rank FROM nn QUALIFY rank <= 5",
        "cluster_distance_order": f"WITH {_CENT} SELECT cid, vec_id, row_number() OVER (PARTITION BY cid ORDER BY round(dist, 9), vec_id) AS rank FROM nn",
        "path_distance_topn": f"""WITH {_CENT}, c2 AS (SELECT cid % 3 AS c2, pos, avg(x) AS x FROM ce GROUP BY ALL),
          a AS (SELECT vec_id, sqrt(sum((ev.x - ce.x) ** 2)) AS d FROM ev JOIN ce ON ce.cid = ev.label AND ce.pos = ev.pos GROUP BY vec_id),
          b AS (SELECT cid, sqrt(sum((ce.x - c2.x) ** 2)) AS d FROM ce JOIN c2 ON c2.c2 = ce.cid % 3 AND c2.pos = ce.pos GROUP BY cid)
          SELECT vec_id, round(a.d + b.d, 6) AS distance FROM a JOIN embeddings USING (vec_id) JOIN b ON b.cid = label ORDER BY distance, vec_id LIMIT 50""",
        "running_topn": "SELECT event_id, value AS distance FROM events ORDER BY value, event_id LIMIT 25",
        "flat_cluster_sizes": """WITH x AS (SELECT 1 AS level, c_nationkey AS cid, count(*) AS n FROM customer GROUP BY c_nationkey
          UNION ALL SELECT 2, n_regionkey, count(*) FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey)
          SELECT level, cid, n, row_number() OVER (PARTITION BY level ORDER BY n DESC, cid) AS size_rank FROM x""",
        "merged_hierarchies": "SELECT c_nationkey AS parent, count(*) AS n FROM customer GROUP BY c_nationkey",
        "waterfill_cut": f"WITH {_SIZES}, {_cut('sz', 'n_regionkey', 'n_nationkey')} SELECT n_regionkey, n_nationkey, size, target, cut FROM sz JOIN ct USING (n_regionkey)",
        "waterfill_quota": f"WITH {_SIZES}, {_quota('sz', 'n_regionkey', 'n_nationkey', 11)} SELECT n_regionkey, n_nationkey, size, target, cut, quota FROM qq",
        "hier_sample": f"WITH {_tree(777, 13)}, {_DRAW.format(by=u(13, 'c_custkey'))} SELECT n_regionkey, count(*) AS n, max(copy) AS most_copies FROM co GROUP BY n_regionkey",
        "hier_sample_rows": f"WITH {_tree(400, 13)}, {_DRAW.format(by='c_acctbal')} SELECT c_custkey, copy FROM co",
        "accuracy": f"WITH {_CENT} SELECT round(avg((label = cid)::INT), 6) AS accuracy, count(*) AS n FROM nn",
        "confusion_matrix": f"WITH {_CENT} SELECT label, " + ", ".join(f"count(*) FILTER (cid = {c}) AS pred_{c}" for c in range(10)) + " FROM nn GROUP BY label",
        "average_precision": f"WITH {_AP} SELECT cls, round(ap, 6) AS ap, n_pos FROM ap",
        "mean_average_precision": f"WITH {_AP} SELECT round(avg(ap), 6) AS macro_ap FROM ap",
        "roc_auc_ovr": f"WITH {_AUC} SELECT cls, round(auc, 6) AS auc, n_pos FROM auc",
        "roc_auc_macro": f"WITH {_AUC} SELECT round(avg(auc), 6) AS macro_auc FROM auc",
        "roc_auc_weighted": f"WITH {_AUC} SELECT round(sum(auc * n_pos) / sum(n_pos), 6) AS weighted_auc FROM auc",
        "argmax_class": "SELECT vec_id, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS pred FROM embeddings",
        "mean_pooled": "SELECT vec_id % 20 AS rec, pos, round(avg(x), 6) AS x FROM (SELECT vec_id, unnest(range(0, 64)) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) GROUP BY ALL",
        "distinct_labels": "SELECT count(DISTINCT label) AS n_labels FROM embeddings",
        "track_grid": f"WITH {_TRACK} SELECT event_id, step, ts + to_seconds(step * 10) AS timestamp, round({_reckoned('step * 10')[0]}, 7) AS lat_at, round({_reckoned('step * 10')[1]}, 7) AS lon_at FROM t, (SELECT unnest([0, 1, 2]) AS step)",
        "track_bearing": f"""WITH {_TRACK}, g AS (SELECT *, {_reckoned('60')[0]} AS lat_at, {_reckoned('60')[1]} AS lon_at FROM t),
          d AS (SELECT event_id, radians(lat_at - lat) * north AS y, radians(lon_at - lon) * east AS x FROM g)
          SELECT event_id, round((degrees(atan2(x, y)) + 360) % 360, 4) AS az_deg, round(degrees(atan2(100, sqrt(x * x + y * y))), 5) AS el_deg, round(sqrt(x * x + y * y + 10000), 3) AS range_m FROM d""",
        "class_scores": "SELECT vec_id, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 9) AS p FROM embeddings",
        "vector_windows": """SELECT vec_id, i::INT AS window, round(list_sum(list_transform(embedding[i * 10 + 1:i * 10 + 10], lambda x: x::DOUBLE)), 6) AS total,
          round(embedding[3]::DOUBLE, 6) AS y4, round(embedding[2]::DOUBLE, 6) AS y5 FROM (SELECT vec_id, embedding, unnest(range(0, len(embedding) // 10)) AS i FROM embeddings)""",
        "label_counts": f'WITH {_ANN} SELECT label AS "ClassSpecies", count(*) AS n FROM a GROUP BY label',
        "by_duration": f"WITH v AS ({_visits(6 * 3600)}) SELECT user_id, start_time, round((epoch_us(end_time) - epoch_us(start_time)) / 1e6::DOUBLE, 6) AS seconds FROM v ORDER BY seconds DESC, user_id, start_time",
        "first_groups": "SELECT event_id, user_id FROM events WHERE user_id IN (SELECT DISTINCT user_id FROM events ORDER BY user_id LIMIT 10)",
        "known_files": "SELECT DISTINCT user_id FROM events WHERE event_type IN ('view', 'click')",
        "complement": "SELECT DISTINCT user_id FROM events EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 100",
        "since_date": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'",
        "bernoulli_sample": f"SELECT event_id FROM events WHERE {u(8, 'event_id')} < 0.1",
    }
