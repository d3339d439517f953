"""The same answers in plain SQL, by other formulas where there is a choice."""

from __future__ import annotations

from tidegraph.schema import OPEN

OFFSET = 10**12

CMD = """
cmd AS (
  SELECT CAST(dayofmonth(ts) AS BIGINT) AS tick, event_id AS pos,
         CASE WHEN event_type IN ('click', 'view') THEN 'addEdge'
              WHEN event_type = 'error' THEN 'rmvEdge'
              WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'rmvNode'
              ELSE 'addNode' END AS op,
         user_id AS src, 'l' || (event_id % 3) AS label,
         (user_id * 7 + event_id % 5 + 1) % (SELECT max(user_id) + 1 FROM events) AS dst
  FROM events)"""

# The log without the commands that text lines replace by a restore command, in
# batches of ten days.
COARSE = CMD.replace("cmd AS", "fine AS") + """,
cmd AS (SELECT (tick - 1) // 10 + 1 AS tick, pos, op, src, label, dst FROM fine WHERE pos % 500 <> 9)"""
TEXT = CMD.replace("cmd AS", "fine AS") + """,
cmd AS (SELECT * FROM fine WHERE pos % 500 <> 9)"""

# Commands no later command of the tick cancels.
BATCH = """
opens AS (
  SELECT DISTINCT tick, src, dst FROM cmd a
  WHERE op = 'addEdge'
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvEdge' AND r.tick = a.tick AND r.src = a.src AND r.dst = a.dst AND r.pos > a.pos)
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvNode' AND r.tick = a.tick AND r.src = a.src AND r.pos > a.pos)
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvNode' AND r.tick = a.tick AND r.src = a.dst AND r.pos > a.pos)),
closes AS (
  SELECT DISTINCT tick, src, dst FROM cmd a
  WHERE op = 'rmvEdge'
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'addEdge' AND r.tick = a.tick AND r.src = a.src AND r.dst = a.dst AND r.pos > a.pos)
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvNode' AND r.tick = a.tick AND r.src = a.src AND r.pos > a.pos)
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvNode' AND r.tick = a.tick AND r.src = a.dst AND r.pos > a.pos)),
gone AS (SELECT DISTINCT tick, src AS id FROM cmd WHERE op = 'rmvNode'),
implied AS (SELECT tick, src AS id FROM opens UNION SELECT tick, dst FROM opens),
named AS (
  SELECT tick, pos, src AS id, TRUE AS explicit FROM cmd WHERE op = 'addNode'
  UNION ALL SELECT tick, pos, src, FALSE FROM cmd WHERE op = 'addEdge'
  UNION ALL SELECT tick, pos, dst, FALSE FROM cmd WHERE op = 'addEdge'),
added AS (
  SELECT DISTINCT tick, id FROM named n
  WHERE NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvNode' AND r.tick = n.tick AND r.src = n.id AND r.pos > n.pos)
    AND (explicit OR NOT EXISTS (SELECT 1 FROM implied i WHERE i.tick = n.tick AND i.id = n.id)))"""

RTA = """
opens AS (SELECT DISTINCT tick, src, dst FROM cmd WHERE op = 'addEdge'),
closes AS (SELECT DISTINCT tick, src, dst FROM cmd WHERE op = 'rmvEdge'),
gone AS (SELECT DISTINCT tick, src AS id FROM cmd WHERE op = 'rmvNode'),
implied AS (SELECT tick, src AS id FROM opens UNION SELECT tick, dst FROM opens),
added AS (SELECT DISTINCT tick, src AS id FROM cmd WHERE op = 'addNode')"""

# Intervals as the stretches between closings of a pair.
HISTORY = f"""
pair AS (SELECT DISTINCT src, dst FROM opens),
ending AS (
  SELECT src, dst, tick FROM closes
  UNION SELECT p.src, p.dst, g.tick FROM pair p JOIN gone g ON g.id = p.src
  UNION SELECT p.src, p.dst, g.tick FROM pair p JOIN gone g ON g.id = p.dst),
step AS (
  SELECT src, dst, tick, 1 AS phase FROM opens UNION ALL SELECT src, dst, tick, 0 FROM ending),
stretch AS (
  SELECT *, sum(1 - phase) OVER (PARTITION BY src, dst ORDER BY tick, phase ROWS UNBOUNDED PRECEDING) AS n FROM step),
history AS (
  SELECT o.src, o.dst, min(o.tick) AS start_tick, coalesce(min(c.tick), {OPEN}) AS end_tick
  FROM stretch o LEFT JOIN stretch c ON c.src = o.src AND c.dst = o.dst AND c.phase = 0 AND c.n = o.n + 1
  WHERE o.phase = 1 GROUP BY o.src, o.dst, o.n)"""

VERTICES = """
vertex AS (
  SELECT id, CAST(max(attr) AS INTEGER) AS attr, min(tick) AS first_tick
  FROM (SELECT id, 1 AS attr, tick FROM added UNION ALL SELECT id, 0, tick FROM implied) GROUP BY id)"""

FOLD = f"{CMD}, {BATCH}, {HISTORY}"
FOLD_RTA = f"{CMD}, {RTA}, {HISTORY}"


def _seen(tick: str | int) -> str:
    return f"CASE WHEN end_tick > {tick} THEN {OPEN} ELSE end_tick END"


# Text lines

LONG_TEXT = f"""
WITH {CMD},
line AS (
  SELECT tick, pos, 0 AS turn,
         CASE WHEN pos % 500 = 9 THEN 'loadOld 2024-01-05 10:00:00'
              WHEN op IN ('addEdge', 'rmvEdge') THEN op || ' ' || src || ' ' || label || ' ' || dst
              ELSE op || ' ' || src END || CASE WHEN pos % 100 = 34 THEN ' 99999999999999999999' ELSE '' END AS raw,
         op, src, label, dst FROM cmd
  UNION ALL
  SELECT tick, pos, 1,
         CASE pos % 50 WHEN 7 THEN 'bogus ' || src WHEN 17 THEN 'rmvEdge ' || src || ' l0' ELSE 'addNode x' || src END,
         NULL, NULL, NULL, NULL FROM cmd WHERE pos % 50 IN (7, 17, 27))"""
SHORT_TEXT = f"""
WITH {CMD},
line AS (
  SELECT tick, pos, 0 AS turn,
         CASE WHEN pos % 500 = 9 THEN 'earliest'
              WHEN op = 'addEdge' THEN 'addE ' || src || ' ' || dst || ' ' || label
              WHEN op = 'rmvEdge' AND pos % 2 = 0 THEN 'delE ' || src || ' ' || dst || ' ' || label
              WHEN op = 'rmvEdge' THEN 'rmvE ' || src || ' ' || dst
              WHEN op = 'addNode' THEN 'addN ' || src || ' n' || src
              WHEN pos % 2 = 0 THEN 'delN ' || src || ' n' || src
              ELSE 'rmvN ' || src END || CASE WHEN pos % 100 = 34 THEN ' 99999999999999999999' ELSE '' END AS raw,
         CASE WHEN pos % 500 = 9 THEN 'earliest' ELSE op END AS op, src, label, dst FROM cmd
  UNION ALL
  SELECT tick, pos, 1,
         CASE pos % 50 WHEN 7 THEN 'bogus ' || src WHEN 17 THEN 'delE ' || src || ' l0' ELSE 'addNode x' || src END,
         NULL, NULL, NULL, NULL FROM cmd WHERE pos % 50 IN (7, 17, 27))"""

ORDER_LINES = f"""
line AS (
  SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS tick, o_custkey AS src,
         o_orderkey + {OFFSET} AS dst, replace(o_orderpriority, ' ', '_') AS label FROM orders)"""

SUPPLY = f"""
edge AS (SELECT l_suppkey AS src, l_partkey + {OFFSET} AS dst, l_returnflag AS label FROM lineitem),
node AS (
  SELECT s_suppkey AS id, s_name AS attr FROM supplier
  UNION ALL SELECT p_partkey + {OFFSET}, p_name FROM part)"""
TRIPLETS = f"""{SUPPLY},
triplet AS (
  SELECT e.src, s.attr AS src_attr, e.dst, d.attr AS dst_attr, e.label
  FROM edge e LEFT JOIN node s ON s.id = e.src LEFT JOIN node d ON d.id = e.dst)"""

# Surviving additions of the in-order folds.
BAG = """
bag AS (
  SELECT pos, tick, src, dst, label FROM cmd a
  WHERE op = 'addEdge'
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvEdge' AND r.src = a.src AND r.dst = a.dst AND r.label = a.label AND r.pos > a.pos)
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvNode' AND r.src = a.src AND r.pos > a.pos)
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvNode' AND r.src = a.dst AND r.pos > a.pos))"""
SET = """
kept AS (
  SELECT DISTINCT src, dst, label FROM cmd a
  WHERE op = 'addEdge'
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvEdge' AND r.src = a.src AND r.dst = a.dst AND r.pos > a.pos)
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvNode' AND r.src = a.src AND r.pos > a.pos)
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvNode' AND r.src = a.dst AND r.pos > a.pos))"""
PRESENT = """
present AS (
  SELECT DISTINCT id FROM (
    SELECT pos, src AS id FROM cmd WHERE op IN ('addNode', 'addEdge')
    UNION ALL SELECT pos, dst FROM cmd WHERE op = 'addEdge') n
  WHERE NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvNode' AND r.src = n.id AND r.pos > n.pos))"""
ACTIVITY = """
activity AS (
  SELECT src AS id, row_number() OVER (PARTITION BY src ORDER BY pos) AS seq,
         'addE, (v' || src || ', v' || dst || ', ' || label || '))' AS activity
  FROM cmd a WHERE op = 'addEdge'
    AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'addNode' AND r.src = a.src AND r.pos > a.pos))"""

DOSSIER = f"""{SET}, {PRESENT}, {ACTIVITY},
text AS (
  SELECT src, dst, '((' || src || ',user' || src || '),(' || dst || ',user' || dst || '),' || label || ')' AS line FROM kept),
dossier AS (
SELECT id, 'vertex' AS section, CAST(0 AS BIGINT) AS seq, '(' || id || ',user' || id || ')' AS line FROM present
UNION ALL SELECT src, 'edge', 0, line FROM text
UNION ALL SELECT dst, 'edge', 0, line FROM text WHERE src <> dst
UNION ALL SELECT id, 'activity', seq, 'a' || id || seq || ' = ' || activity FROM activity WHERE id IN (SELECT id FROM present))"""

_PAIRS = "pairs AS (SELECT DISTINCT src, dst FROM history)"
_WALK = """
walk AS (
  SELECT CAST(1 AS BIGINT) AS v, 0 AS hop
  UNION SELECT p.dst, w.hop + 1 FROM walk w JOIN pairs p ON p.src = w.v
  WHERE w.hop < (SELECT count(DISTINCT src) FROM pairs))"""
_CLOCK = """
walk AS (
  SELECT CAST(1 AS BIGINT) AS v, CAST(0 AS BIGINT) AS x
  UNION SELECT e.dst, CASE WHEN w.x <= e.start_tick THEN e.start_tick + 1 ELSE w.x + 1 END
  FROM walk w JOIN used e ON e.src = w.v
  WHERE w.x <= e.end_tick AND w.x <= (SELECT max(start_tick) + 1 + count(DISTINCT src) FROM used))"""
_CONTACT = """
contact AS (SELECT DISTINCT src, dst, tick AS t FROM cmd WHERE op = 'addEdge'),
walk AS (
  SELECT CAST(1 AS BIGINT) AS v, CAST(1 AS BIGINT) AS x, CAST(0 AS BIGINT) AS hop
  UNION SELECT c.dst, c.t + 1, w.hop + 1
  FROM walk w JOIN contact c ON c.src = w.v WHERE c.t >= w.x AND c.t + 1 <= 25)"""


def _difference(part: str, left: str, right: str, columns: str) -> str:
    on = " AND ".join(f"l.{c} = r.{c}" for c in columns.split(", "))
    first = columns.split(", ")[0]
    return f"""
SELECT '{part}' AS part, count(l.{first}) AS left_rows, count(r.{first}) AS right_rows,
       count(CASE WHEN l.{first} IS NOT NULL AND r.{first} IS NOT NULL THEN 1 END) AS common,
       count(CASE WHEN r.{first} IS NULL THEN 1 END) AS left_only,
       count(CASE WHEN l.{first} IS NULL THEN 1 END) AS right_only,
       count(CASE WHEN r.{first} IS NULL THEN 1 END) = 0 AS contained,
       count(CASE WHEN l.{first} IS NULL OR r.{first} IS NULL THEN 1 END) = 0 AS equal
FROM {left} l FULL JOIN {right} r ON {on}"""


_STREAM_RESTORE = f"""WITH {CMD.replace("cmd AS", "fine AS")},
load AS (SELECT (tick - 1) // 10 + 1 AS batch, max(pos) AS pos FROM fine WHERE pos % 500 = 9 GROUP BY 1),
last AS (SELECT max(batch) AS batch, max(pos) AS pos FROM load),
cmd AS (
  SELECT f.* FROM fine f, last WHERE f.pos % 500 <> 9 AND (
    last.pos IS NULL OR f.pos > last.pos
    OR (last.batch > 2 AND f.tick <= 20 AND f.pos > coalesce((SELECT max(pos) FROM load WHERE batch <= 2), -1)))), {BAG}
SELECT src, dst, label FROM bag"""

_EDGE_APPEND = f"""WITH {ORDER_LINES},
seen AS (SELECT tick, src AS id FROM line UNION ALL SELECT tick, dst FROM line)
SELECT t.tick,
       (SELECT count(*) FROM line l WHERE l.tick <= t.tick) AS num_edges,
       (SELECT count(DISTINCT id) FROM seen s WHERE s.tick <= t.tick) AS num_vertices
FROM (SELECT DISTINCT tick FROM line) t"""

ORACLES: dict[str, str] = {
    "parse_commands": f"""{LONG_TEXT}
SELECT tick, pos * 2 AS pos,
       CASE WHEN pos % 500 = 9 THEN 'loadOld' ELSE op END AS op,
       CASE WHEN pos % 500 = 9 THEN -1 ELSE src END AS src,
       CASE WHEN pos % 500 = 9 THEN '2024-01-05 10:00:00' WHEN op LIKE '%Edge' THEN label ELSE '' END AS label,
       CASE WHEN pos % 500 <> 9 AND op LIKE '%Edge' THEN dst ELSE -1 END AS dst, raw
FROM line WHERE turn = 0""",
    "parse_commands_short": f"""{SHORT_TEXT}
SELECT tick, pos * 2 AS pos, op,
       CASE WHEN op = 'earliest' THEN -1 ELSE src END AS src,
       CASE WHEN op = 'addEdge' THEN label
            WHEN op = 'rmvEdge' THEN CASE WHEN pos % 2 = 0 THEN label ELSE '' END
            WHEN op = 'addNode' THEN 'n' || src
            WHEN op = 'rmvNode' AND pos % 2 = 0 THEN 'n' || src ELSE '' END AS label,
       CASE WHEN op LIKE '%Edge' THEN dst ELSE -1 END AS dst, raw
FROM line WHERE turn = 0""",
    "rejected_commands": f"{LONG_TEXT} SELECT tick, pos * 2 + 1 AS pos, raw FROM line WHERE turn = 1",
    "rejected_commands_short": f"{SHORT_TEXT} SELECT tick, pos * 2 + 1 AS pos, raw FROM line WHERE turn = 1",
    "batch_directories": f"WITH {TEXT}, {BATCH}, {HISTORY} SELECT src, dst, start_tick, end_tick FROM history",
    "edge_list_scan": f"WITH {ORDER_LINES} SELECT src, dst, label FROM line",
    "edge_list_append": _EDGE_APPEND,
    "stream_edge_append": _EDGE_APPEND,
    "batch_compact": f"""WITH {CMD}, {BATCH}
SELECT tick, CAST(2 AS BIGINT) AS pos, 'addEdge' AS op, src, dst FROM opens
UNION ALL SELECT tick, 1, 'rmvEdge', src, dst FROM closes
UNION ALL SELECT tick, 0, 'rmvNode', id, -1 FROM gone
UNION ALL SELECT tick, 3, 'addNode', id, -1 FROM added""",
    "edge_intervals": f"WITH {FOLD} SELECT src, dst, start_tick, end_tick FROM history",
    "edge_intervals_rta": f"WITH {FOLD_RTA} SELECT src, dst, start_tick, end_tick FROM history",
    "vertex_fold": f"WITH {CMD}, {BATCH}, {VERTICES} SELECT * FROM vertex",
    "vertex_fold_rta": f"WITH {CMD}, {RTA}, {VERTICES} SELECT * FROM vertex",
    "graph_status": f"""WITH {FOLD}, {VERTICES},
tick AS (
  SELECT start_tick AS tick FROM history UNION SELECT end_tick FROM history WHERE end_tick < {OPEN}
  UNION SELECT first_tick FROM vertex)
SELECT tick,
       (SELECT count(*) FROM history WHERE start_tick <= tick) AS num_edges,
       (SELECT count(*) FROM history WHERE start_tick <= tick AND end_tick > tick) AS open_edges,
       (SELECT count(*) FROM history WHERE end_tick <= tick) AS closed_edges,
       (SELECT count(*) FROM vertex WHERE first_tick <= tick) AS num_vertices
FROM tick""",
    "stream_fold": f"WITH {COARSE}, {BATCH}, {HISTORY} SELECT src, dst, start_tick, end_tick FROM history",
    "stream_batch_directories": f"WITH {TEXT}, {BATCH}, {HISTORY} SELECT src, dst, start_tick, end_tick FROM history",
    "stream_fold_set": f"WITH {TEXT}, {SET} SELECT src, dst, label FROM kept",
    "static_fold_bag": f"WITH {CMD}, {BAG} SELECT pos, src, dst, label FROM bag",
    "static_fold_set": f"WITH {CMD}, {SET} SELECT src, dst, label FROM kept",
    "static_vertices": f"WITH {CMD}, {PRESENT} SELECT id FROM present",
    "restore_nearest": f"""WITH {CMD.replace("cmd AS", "whole AS")},
cmd AS (SELECT * FROM whole WHERE tick <= 10 OR tick > 20), {BAG}
SELECT src, dst, label FROM bag""",
    "graph_add_edges": f"WITH {SUPPLY} SELECT DISTINCT src, dst, label FROM edge",
    "graph_add_nodes": f"WITH {SUPPLY} SELECT id, attr || '*' AS attr FROM node",
    "graph_remove_edges": f"""WITH {SUPPLY}
SELECT src, dst, label FROM edge WHERE (src, dst) NOT IN (SELECT (src, dst) FROM edge WHERE label = 'R')""",
    "graph_remove_nodes": f"""WITH {SUPPLY},
gone AS (SELECT s_suppkey AS id FROM supplier WHERE s_nationkey < 5
         UNION ALL SELECT p_partkey + {OFFSET} FROM part WHERE p_size < 10)
SELECT 'edge' AS part, src, dst, label FROM edge
WHERE src NOT IN (SELECT id FROM gone) AND dst NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'vertex', id, id, attr FROM node WHERE id NOT IN (SELECT id FROM gone)""",
    "graph_from_edges": f"""WITH {SUPPLY}
SELECT id, 'John Doe' AS attr FROM (SELECT src AS id FROM edge UNION SELECT dst FROM edge)""",
    "graph_apply": f"""WITH {ORDER_LINES},
rich AS (SELECT c_custkey AS id, c_name AS attr FROM customer WHERE c_acctbal > 5000),
ends AS (SELECT src AS id FROM line UNION SELECT dst FROM line)
SELECT id, coalesce(r.attr, 'John Doe') AS attr FROM ends e FULL JOIN rich r USING (id)""",
    "edge_multiplicity": f"WITH {SUPPLY} SELECT src, dst, count(*) AS attr FROM edge GROUP BY src, dst",
    "group_edges": f"""WITH {SUPPLY}
SELECT src, dst, string_agg(label, '' ORDER BY label) AS label FROM edge GROUP BY src, dst""",
    "label_runs": f"WITH {SUPPLY} SELECT src, dst, label, count(*) AS n FROM edge GROUP BY src, dst, label",
    "triplets": f"WITH {TRIPLETS} SELECT * FROM triplet",
    "triplet_sentences": f"""WITH {TRIPLETS}
SELECT src_attr || ' is the ' || label || ' of ' || dst_attr AS sentence FROM triplet""",
    "incident_triplets": f"""WITH {TRIPLETS}
SELECT src AS id, * FROM triplet UNION ALL SELECT dst, * FROM triplet WHERE src <> dst""",
    "subgraph_edges": f"WITH {TRIPLETS} SELECT * FROM triplet WHERE label <> 'R' AND dst_attr LIKE 'red%'",
    "subgraph_vertices": f"""WITH {TRIPLETS}
SELECT 'edge' AS part, src, dst, label FROM triplet WHERE src_attr NOT LIKE 'red%' AND dst_attr NOT LIKE 'red%'
UNION ALL SELECT 'vertex', id, id, attr FROM node WHERE attr NOT LIKE 'red%'""",
    "outer_join_vertices": f"""WITH {SUPPLY}
SELECT n.id, (SELECT count(*) FROM edge e WHERE e.src = n.id AND e.label = 'R') AS attr FROM node n""",
    "graph_equal": f"""WITH {CMD}, {BATCH}, {HISTORY}, {VERTICES},
{RTA.replace("opens AS", "opens2 AS").replace("closes AS", "closes2 AS").replace("gone AS", "gone2 AS").replace("implied AS", "implied2 AS").replace("added AS", "added2 AS").replace("FROM opens", "FROM opens2")},
{HISTORY.replace("pair AS", "pair2 AS").replace("ending AS", "ending2 AS").replace("step AS", "step2 AS").replace("stretch AS", "stretch2 AS").replace("history AS", "history2 AS").replace("FROM opens", "FROM opens2").replace("FROM closes", "FROM closes2").replace("FROM pair", "FROM pair2").replace("JOIN gone", "JOIN gone2").replace("FROM ending", "FROM ending2").replace("FROM step", "FROM step2").replace("FROM stretch", "FROM stretch2").replace("JOIN stretch", "JOIN stretch2")},
lv AS (SELECT id FROM vertex),
rv AS (SELECT id FROM implied2 UNION SELECT id FROM added2),
le AS (SELECT src, dst FROM history WHERE end_tick = {OPEN}),
re AS (SELECT src, dst FROM history2 WHERE end_tick = {OPEN})
{_difference("vertices", "lv", "rv", "id")}
UNION ALL {_difference("edges", "le", "re", "src, dst")}""",
    "activity_log": f"WITH {CMD}, {ACTIVITY} SELECT * FROM activity",
    "vertex_dossier": f"WITH {CMD}, {DOSSIER} SELECT * FROM dossier",
    "dossier_store": f"""WITH {CMD.replace("cmd AS", "fine AS")}, cmd AS (SELECT * FROM fine WHERE tick <= 15), {DOSSIER}
SELECT *, CAST(1 AS BIGINT) AS tick FROM dossier""",
    "stream_dossiers": f"""WITH {CMD.replace("cmd AS", "fine AS")},
cmd AS (
  SELECT * FROM fine WHERE pos % 500 <> 9 AND (
    tick <= 17 OR (tick = 18 AND pos * 2 <= (SELECT min(pos) * 2 + 4 FROM fine WHERE tick = 18)))), {DOSSIER}
SELECT * FROM dossier""",
    "triplet_dump": f"""WITH {TRIPLETS}
SELECT '((' || src || ',' || src_attr || '),(' || dst || ',' || dst_attr || '),' || label || ')' AS value FROM triplet""",
    "labelled_text_roundtrip": f"WITH {CMD}, {BAG} SELECT src, dst, label FROM bag",
    "named_vertices": f"""WITH {TEXT}, {PRESENT}
SELECT p.id, CASE WHEN EXISTS (
    SELECT 1 FROM cmd a WHERE a.op = 'addNode' AND a.src = p.id
      AND NOT EXISTS (SELECT 1 FROM cmd r WHERE r.op = 'rmvNode' AND r.src = a.src AND r.pos > a.pos))
  THEN 'n' || p.id ELSE 'John Doe' END AS name FROM present p""",
    "stream_restore": _STREAM_RESTORE,
    "stream_restore_numbered": _STREAM_RESTORE,
    "bfs_hops": f"""WITH RECURSIVE {FOLD}, {_PAIRS}, {_WALK}
SELECT v AS id, CAST(min(hop) AS BIGINT) AS hops FROM walk GROUP BY v""",
    "bfs_customer_chains": """
SELECT c_custkey + 1 AS id, c_custkey % 40 + 1 AS hops FROM customer UNION ALL SELECT 0, 0""",
    "bfs_incremental": f"""WITH RECURSIVE {FOLD}, {_PAIRS},
early AS (SELECT DISTINCT src, dst FROM history WHERE start_tick <= 5),
{_WALK.replace("walk AS", "first_walk AS").replace("FROM walk", "FROM first_walk").replace("JOIN pairs", "JOIN early")},
before AS (SELECT v, min(hop) AS hops FROM first_walk GROUP BY v),
{_WALK.replace("SELECT CAST(1 AS BIGINT) AS v, 0 AS hop", "SELECT v, 0 AS hop FROM before")}
SELECT v AS id, CAST(least(min(b.hops), 2 + min(w.hop)) AS BIGINT) AS hops
FROM walk w LEFT JOIN before b USING (v) GROUP BY v""",
    "clock_arrival": f"""WITH RECURSIVE {FOLD}, used AS (SELECT * FROM history), {_CLOCK}
SELECT v AS id, min(x) AS arrival FROM walk GROUP BY v""",
    "window_clock_arrival": f"""WITH RECURSIVE {FOLD},
used AS (SELECT src, dst, start_tick, {_seen(20)} AS end_tick FROM history WHERE start_tick >= 4 AND start_tick < 18), {_CLOCK}
SELECT v AS id, min(x) AS arrival FROM walk GROUP BY v""",
    "earliest_arrival": f"""WITH RECURSIVE {CMD}, {_CONTACT}
SELECT v AS id, min(x) AS arrival FROM walk GROUP BY v""",
    "temporal_fewest_hops": f"""WITH RECURSIVE {CMD}, {_CONTACT}
SELECT v AS id, min(hop) AS hops FROM walk GROUP BY v""",
    "window_edges": f"WITH {FOLD} SELECT src, dst, start_tick, end_tick FROM history WHERE start_tick BETWEEN 4 AND 17",
    "graph_as_of": f"""WITH {FOLD}
SELECT src, dst, start_tick, end_tick FROM history WHERE start_tick <= 12 AND end_tick >= 13""",
    "checkpoints": f"""WITH {FOLD}
SELECT t.tick, src, dst, start_tick, {_seen("t.tick")} AS end_tick
FROM (SELECT unnest([5, 10, 15, 20, 25, 30])::BIGINT AS tick) t JOIN history ON start_tick <= t.tick""",
    "interval_store_as_of": f"""WITH {FOLD}
SELECT src, dst, start_tick, end_tick FROM history WHERE start_tick <= 12 AND end_tick >= 13""",
    "interval_store_checkpoint": f"""WITH {FOLD}
SELECT src, dst, start_tick, {_seen(20)} AS end_tick FROM history WHERE start_tick <= 20""",
    "checkpoint_deltas": f"""WITH {FOLD},
placed AS (
  SELECT *, (start_tick + 4) // 5 * 5 AS started,
         CASE WHEN end_tick < {OPEN} THEN (end_tick + 4) // 5 * 5 END AS ended FROM history)
SELECT started AS tick, 'start' AS change, src, dst, start_tick,
       CASE WHEN ended = started THEN end_tick ELSE {OPEN} END AS end_tick FROM placed
UNION ALL SELECT ended, 'end', src, dst, start_tick, end_tick FROM placed WHERE ended > started""",
    "checkpoint_roundtrip": f"""WITH {FOLD}
SELECT src, dst, start_tick, {_seen(15)} AS end_tick FROM history WHERE start_tick <= 15""",
    "text_snapshot_roundtrip": f"""WITH {FOLD}, {VERTICES}
SELECT 'edge' AS part, src, dst, start_tick, {_seen(15)} AS end_tick FROM history WHERE start_tick <= 15
UNION ALL SELECT 'vertex', id, id, 0, 0 FROM vertex WHERE first_tick <= 15""",
    "nearest_snapshot": """
SELECT tick * 3600000 AS snapshot_ms, tick
FROM (SELECT DISTINCT date_diff('hour', TIMESTAMP '1970-01-01', ts) AS tick FROM events)
ORDER BY abs(tick * 3600000 - epoch_ms(TIMESTAMP '2024-01-12 07:30:00')), tick LIMIT 1""",
}
