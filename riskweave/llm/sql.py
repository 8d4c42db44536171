"""DuckDB SQL for the queries that SQL can express."""

NEAR_DUP = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                     'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE
           WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3),
                                                lambda i : array_to_string(w[i:i + 4], ' '))
           WHEN len(w) > 0 THEN ['short ' || array_to_string(w, ' ')]
           ELSE [] END) AS s FROM d),
one AS (SELECT min(doc_id) AS id, s, len(s) AS n
        FROM (SELECT doc_id, list_sort(s) AS s FROM sets) GROUP BY s),
el AS (SELECT id, n, unnest(s) AS e FROM one),
common AS (SELECT a.id AS a, b.id AS b, a.n AS na, b.n AS nb, count(*) AS c
           FROM el a JOIN el b ON a.e = b.e AND a.id < b.id GROUP BY ALL),
link AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
both_ways AS (SELECT a AS x, b AS y FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT id AS x, id AS y FROM one
          UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x),
comp AS (SELECT x, min(y) AS component FROM reach GROUP BY x)
SELECT sets.doc_id, len(sets.s)::BIGINT AS n_shingles,
       CASE WHEN len(sets.s) = 0 THEN sets.doc_id ELSE comp.component END AS component_id,
       len(sets.s) = 0 OR sets.doc_id = comp.component AS kept
FROM sets LEFT JOIN one ON one.s = list_sort(sets.s) LEFT JOIN comp ON comp.x = one.id
"""

RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda l : regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT r, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) >= 8),
keyed AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS k FROM win),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM keyed)
          WHERE n > 1),
covered AS (SELECT r, count(DISTINCT p) AS n
            FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY r),
top AS (SELECT r, max(n) AS n FROM (
          SELECT r, x, count(*) AS n FROM (SELECT r, unnest(w) AS x FROM d) GROUP BY r, x)
        GROUP BY r),
s AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         length(text) - length(replace(text, '!', '')) AS n_bangs, len(lines) AS n_lines,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(covered.n, 0)::BIGINT AS n_repeat_words, coalesce(top.n, 0) AS top_word
  FROM d LEFT JOIN covered USING (r) LEFT JOIN top USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_bangs > 3 * n_words
            OR word_chars > 20 * n_words OR 2 * word_chars < 3 * n_words
            OR 2 * n_dup_lines > n_lines OR 2 * top_word > n_words) AS kept
FROM b
"""


def _crc32(value: str) -> str:
    """Unsigned crc32 of a short ASCII string, bit by bit."""
    step = "list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], " \
           "lambda x, i : xor(x >> 1, 3988292384 * (x & 1)))"
    codes = f"list_transform(string_split({value}, ''), lambda c : ascii(c)::BIGINT)"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), " \
           f"lambda a, b : {step}))"


def _merkle(levels: int = 6, top: int = 2) -> str:
    """Trees of up to 8**levels rows under a tree of up to 8**top of them."""
    fields = "concat(" + ", ".join(
        f"coalesce(strlen({c}) || ':' || {c}, '-')"
        for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", "{text}")) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    sql = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce('+' || lang, '') AS tree, doc_id,
         sha256({fields.format(text='text')}) AS leaf,
         CASE WHEN {_crc32('doc_id::VARCHAR')} % 3 = 0
              THEN sha256({fields.format(text=low)}) END AS forged
  FROM documents),
p0 AS (
  SELECT r, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
         count(*) OVER (PARTITION BY tree) AS n, coalesce(forged, leaf) AS fold, '' AS proof FROM d),
n0 AS (SELECT tree, i, n, leaf AS h FROM p0 JOIN d USING (r, tree))"""
    level = """,
g{k} AS (SELECT tree, i // 8 AS i, n, array_agg(h ORDER BY i) AS kids FROM n{k} WHERE n > 1
         GROUP BY tree, i // 8, n),
n{m} AS (SELECT tree, i, (n + 7) // 8 AS n, sha256(array_to_string(kids, '')) AS h FROM g{k}
         UNION ALL SELECT * FROM n{k} WHERE n = 1),
p{m} AS (SELECT r, p.tree, p.i // 8 AS i, (p.n + 7) // 8 AS n,
                sha256(array_to_string(kids[1:p.i % 8], '') || fold
                       || array_to_string(kids[p.i % 8 + 2:8], '')) AS fold,
                proof || array_to_string(kids[1:p.i % 8], '')
                      || array_to_string(kids[p.i % 8 + 2:8], '') AS proof
         FROM p{k} p JOIN g{k} g ON g.tree = p.tree AND g.i = p.i // 8
         UNION ALL SELECT * FROM p{k} WHERE n = 1)"""
    for k in range(levels):
        sql += level.format(k=k, m=k + 1)
    sql += f""",
sub AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS i,
               count(*) OVER () AS n FROM n{levels}),
n{levels + 1} AS (SELECT '' AS tree, i, n, subroot AS h FROM sub),
p{levels + 1} AS (SELECT r, '' AS tree, sub.i, sub.n, fold, proof
                  FROM p{levels} p JOIN sub USING (tree))"""
    for k in range(levels + 1, levels + 1 + top):
        sql += level.format(k=k, m=k + 1)
    last = levels + 1 + top
    return sql + f"""
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root,
       fold = h AS verified
FROM d JOIN sub USING (tree) JOIN p{last} USING (r) CROSS JOIN n{last}
"""


MERKLE = _merkle()
