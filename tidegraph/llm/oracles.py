"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_BLANK = r"\x20\x09-\x0D"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP4 = rf"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text,
         CASE WHEN text IS NULL THEN 'none' ELSE 'x' || text END AS own FROM documents),
split AS (
  SELECT *, regexp_extract_all(text, '[^{_BLANK}]+') AS words,
         [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '[^{_BLANK}]')] AS lines FROM doc),
place AS (SELECT r, unnest(range(1, len(words) - 1)) AS i, words FROM split WHERE len(words) >= 3),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, words[i], words[i + 1], words[i + 2]) AS n FROM place),
inside AS (
  SELECT r, count(DISTINCT i + d) AS n FROM win, (SELECT unnest([0, 1, 2]) AS d) WHERE n > 1 GROUP BY r),
line AS (SELECT r, host, own, unnest(lines) AS raw FROM split),
normal AS (
  SELECT r, host, own, trim(regexp_replace(lower(raw), '[{_BLANK}]+', ' ', 'g'), ' ') AS line,
         len(regexp_extract_all(raw, '[^{_BLANK}]+')) AS size FROM line),
host_size AS (SELECT host, count(DISTINCT own) AS docs FROM doc GROUP BY host),
frequent AS (
  SELECT n.host, n.line FROM normal n JOIN host_size h USING (host) GROUP BY n.host, n.line, h.docs
  HAVING count(DISTINCT own) > 20 AND count(DISTINCT own) > 0.1 * h.docs),
gone AS (SELECT r, sum(size) AS n FROM normal JOIN frequent USING (host, line) GROUP BY r),
figure AS (
  SELECT s.doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(i.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_frequent_words
  FROM split s LEFT JOIN inside i USING (r) LEFT JOIN gone g USING (r)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM figure)
SELECT *, NOT base_failed AND n_words - n_frequent_words >= 50
          AND n_words - n_frequent_words >= 0.3 * n_words AS kept FROM judged"""

_WORDS5 = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP5 = f"""
WITH item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS name, {_WORDS5} AS words FROM benchmark),
sized AS (SELECT *, least(10, len(words)) AS size FROM item WHERE len(words) > 0),
test AS (
  SELECT DISTINCT name, size, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT *, unnest(range(1, len(words) - size + 2)) AS i FROM sized)),
doc AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS5} AS words FROM documents),
win AS (
  SELECT r, size, i, array_to_string(words[i:i + size - 1], ' ') AS win
  FROM (SELECT r, words, size, unnest(range(1, len(words) - size + 2)) AS i
        FROM doc, (SELECT DISTINCT size FROM test) WHERE len(words) >= size)),
hit AS (SELECT w.r, w.i, w.size, t.name FROM win w JOIN test t ON t.size = w.size AND t.win = w.win),
covered AS (
  SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + size)) AS k FROM (SELECT DISTINCT r, i, size FROM hit)) GROUP BY r),
named AS (
  SELECT r, count(*) AS n, string_agg(name, ',' ORDER BY name) AS names FROM (SELECT DISTINCT r, name FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n, 0) AS BIGINT) AS n_items, sha256(coalesce(m.names, '')) AS items_sha256, c.n IS NOT NULL AS contaminated
FROM doc LEFT JOIN covered c USING (r) LEFT JOIN named m USING (r)"""

_NIBBLES = ", ".join(f"'{k:04b}'" for k in range(16))

# Ids are different, so no address is longer than the bits of an id.
_OP8 = f"""
WITH doc AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash FROM documents),
placed AS (
  SELECT doc_id, n_bytes, array_to_string([[{_NIBBLES}][strpos('0123456789abcdef', substr(hash, i, 1))] FOR i IN range(1, 16)], '') AS address
  FROM doc),
node AS (
  SELECT d, substr(address, 1, d) AS prefix FROM placed, (SELECT unnest(range(0, 60)) AS d)
  GROUP BY d, prefix HAVING sum(n_bytes) > {1 << 24} AND count(*) > 1),
deep AS (
  SELECT p.doc_id, p.n_bytes, p.address, coalesce(max(n.d) + 1, 0) AS depth
  FROM placed p LEFT JOIN node n ON n.prefix = substr(p.address, 1, n.d) GROUP BY p.doc_id, p.n_bytes, p.address),
sharded AS (SELECT doc_id, n_bytes, substr(address, 1, depth) AS shard, CAST(depth AS INTEGER) AS depth FROM deep)
SELECT *, CAST(sum(n_bytes) OVER (PARTITION BY shard) AS BIGINT) AS shard_bytes, count(*) OVER (PARTITION BY shard) AS shard_docs
FROM sharded"""

_CONTROL = r"'(<\\*)(/?s>)|(\[\\*)(/?(?:INST|SYS|ROLE)\])', '\1\3\\\2\4', 'g'"

_OP11 = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(t, r)),
row AS (
  SELECT *, regexp_replace(text, {_CONTROL}) AS escaped, length(escaped) + CASE role
           WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 13
           ELSE 21 + length(regexp_replace(role, {_CONTROL})) END AS chars FROM said),
joined AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS formatted_chars,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, escaped) AS said,
         coalesce(string_agg(text, '' ORDER BY turn, role, escaped) FILTER (WHERE role = 'assistant'), '') AS learnt
  FROM row GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(learnt) AS BIGINT) AS loss_chars,
       sha256(learnt) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM joined"""



def _nearest(k: int) -> str:
    """Entry and distance of every part among the entries of round ``k``, as one number."""
    return f"""
near{k} AS MATERIALIZED (
  SELECT a.r, a.p, min(CAST(list_sum([(a.v[i] - b.v[i]) * (a.v[i] - b.v[i]) FOR i IN range(1, len(a.v) + 1)]) AS BIGINT) * 256 + b.e) AS m
  FROM part a JOIN book{k} b USING (p) GROUP BY a.r, a.p)"""


def _moved(k: int) -> str:
    """Entries after round ``k``: the mean of their parts, rounded down, or as before where there is none."""
    return f"""{_nearest(k)},
mean{k} AS (
  SELECT p, e, list(x ORDER BY i) AS v FROM (
    SELECT p, m % 256 AS e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x
    FROM (SELECT n.p, n.m, a.v, unnest(range(1, len(a.v) + 1)) AS i FROM near{k} n JOIN part a USING (r, p)) GROUP BY ALL)
  GROUP BY p, e),
book{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m USING (p, e))"""


_OP13 = f"""
WITH whole AS (
  SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN embedding])),
kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, w) AS r, *, len(w) // 4 AS s FROM whole),
part AS MATERIALIZED (SELECT r, p, w[p * s + 1 : p * s + s] AS v FROM (SELECT *, unnest(range(4)) AS p FROM kept)),
book0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM part WHERE r <= 256),
{", ".join(map(_moved, range(4)))},{_nearest(4)},
coded AS (
  SELECT r, string_agg(printf('%02x', m % 256), '' ORDER BY p) AS code, CAST(sum(m // 256) AS BIGINT) AS error FROM near4 GROUP BY r),
entry AS (SELECT p, e, unnest(v) AS x, unnest(range(len(v))) AS i FROM book4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY p, e, i)) FROM entry) AS codebooks_sha256
FROM coded JOIN kept USING (r)"""

ORACLES: dict[str, str] = {
    "op4_line_frequency": _OP4,
    "op5_decontamination": _OP5,
    "op8_extendible_hashing": _OP8,
    "op11_reply_trees": _OP11,
    "op13_laesa_codes": _OP13,
}
