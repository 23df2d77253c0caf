"""DuckDB SQL of the operators that SQL can express, over the same tables."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def jaccard_sql(docs: str = "documents") -> str:
    """Rows of op1: components by recursion over the links of distinct shingle sets."""
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM {docs}
), shingled AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingled GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM shingled a JOIN shingled b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), reach AS (
  SELECT doc_id, doc_id AS other FROM words
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other
)
SELECT r.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.other) AS component_id
FROM reach r LEFT JOIN sizes s ON s.doc_id = r.doc_id GROUP BY r.doc_id"""


def decontamination_sql(docs: str = "documents") -> str:
    """Rows of op8, by joining every run of words of an item's window length."""
    words = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH dw AS (SELECT doc_id, {words} AS w FROM {docs}),
iw AS (SELECT item_id, {words} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i:i + least(len(w), 10) - 1] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM iw WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT len(win) AS k FROM windows),
found AS (
  SELECT DISTINCT d.doc_id, d.i, d.k, v.item_id
  FROM (SELECT doc_id, k, i, w[i:i + k - 1] AS win
        FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, lengths WHERE len(w) >= k)) d
  JOIN windows v ON v.win = d.win
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM found) GROUP BY doc_id
), listed AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)"""


def substring_sql(docs: str = "documents") -> str:
    """Rows of op10, by counting every window of 35 words."""
    return rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i:i + 34], ' ')) AS win
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM words WHERE len(w) >= 35)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY win) AS n FROM windows) WHERE n > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again
), each_word AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM words
), kept AS (
  SELECT e.doc_id, count(*) AS n_kept, string_agg(e.w[e.p], ' ' ORDER BY e.p) AS text
  FROM each_word e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.p = e.p GROUP BY e.doc_id
)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed,
       sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)"""


def filter_audit_sql(docs: str = "documents") -> str:
    """Rows of op13, by counting every combination of failed filters at every step of every order."""
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM {docs}
), told AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY doc_id
), failing AS (
  SELECT part, good, toxic, concat(
    CASE WHEN len(w) < 50 THEN 'A' ELSE '' END,
    CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END,
    CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END,
    CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
    CASE WHEN texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t) THEN 'E' ELSE '' END) AS f
  FROM texts LEFT JOIN told ON told.doc_id = texts.doc_id
), states AS (
  SELECT part, f, count(*) AS n, count(*) FILTER (good = 1) AS g, count(*) FILTER (toxic = 1) AS x FROM failing GROUP BY part, f
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5
), steps AS (
  SELECT o, s, substr(o, s, 1) AS c, substr(o, 1, s - 1) AS before FROM orders, (SELECT unnest(range(1, 6)) AS s)
), outcomes AS (
  SELECT part, o, s, c, n, g, x, f, contains(f, c) AS fails, translate(f, before, '') <> f AS gone FROM states, steps
), counted AS (
  SELECT part, o, s, c,
    coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (f = c), 0)::BIGINT AS unique_fails,
    coalesce(sum(g) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost,
    coalesce(sum(x) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
  FROM outcomes GROUP BY part, o, s, c
)
SELECT part, o AS filter_order, s::INTEGER AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley
FROM counted"""


def earlier_passages_sql(docs: str = "documents") -> str:
    """Rows of op11, by the smallest id of every window of 50 bytes (texts as hexadecimal digits, two a byte)."""
    return f"""
WITH texts AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM {docs}
), windows AS (
  SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS w
  FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM texts WHERE length(h) >= 100)
), least AS (
  SELECT w, min(doc_id) AS first_id FROM windows GROUP BY w
), marked AS (
  SELECT doc_id, i, i > lag(i, 1, -100) OVER (PARTITION BY doc_id ORDER BY i) + 50 AS opens
  FROM windows JOIN least USING (w) WHERE first_id < doc_id
), spans AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b
  FROM (SELECT doc_id, i, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked) GROUP BY doc_id, k
), cut AS (
  SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM spans
), kept AS (
  SELECT doc_id, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS tail,
         string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS left_over
  FROM cut JOIN texts USING (doc_id) GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(left_over, '') || substr(h, 2 * coalesce(tail, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)"""
