"""DuckDB twins of the operators that SQL can express: decontamination, exact dedup, line dedup, repair, manifest."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}')"


OP2 = f"""
WITH d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_words('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS k
        FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
firsts AS (SELECT DISTINCT split_part(k, ' ', 1) AS f FROM win),
spots AS (SELECT doc_id, i, w[i] AS f, w FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
at_ AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
        FROM spots JOIN firsts USING (f) CROSS JOIN sizes WHERE i + n - 1 <= len(w)),
hit AS (SELECT doc_id, i, n, item FROM at_ JOIN win USING (n, k)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s
          FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP7 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP8 = rf"""
WITH l AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line
           FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                          '{_UPPER}', '{_LOWER}') AS key FROM l),
common AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 40
           GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE top IS NOT NULL AND doc_id <> top) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE top IS NULL OR doc_id = top), ''))
           AS kept_sha256
FROM k LEFT JOIN common USING (key) GROUP BY doc_id
"""


def _crc(text: str) -> str:
    """Unsigned CRC-32 of a decimal or ASCII string."""
    codes = f"list_transform(string_split({text}, ''), lambda ch: ascii(ch)::BIGINT)"
    byte = ("list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
            "lambda x, z: xor(x >> 1, (x & 1) * 3988292384))")
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295::BIGINT)"


# a deterministic automaton of the role grammar: 0 start, 1 after s, 2 after u, 3 after a; it ends in 0 or 3
OP12 = rf"""
WITH RECURSIVE shift(p, x, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
moves(p, x, e, c, q) AS (
    SELECT p, x, 'K', 0, q FROM shift UNION ALL SELECT p, NULL, 'R', 2, q FROM shift WHERE x <> 's'
    UNION ALL SELECT p, NULL, 'D', 3, p FROM (VALUES (0), (1), (2), (3)) AS t(p)),
ins(p, q, c, a) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (0, 3, 4, 'II'),
                           (1, 2, 2, 'I'), (1, 3, 4, 'II'), (2, 3, 2, 'I'), (3, 2, 2, 'I')),
seeded AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                  {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS k
           FROM conversations),
rows_ AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                 CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                 unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
          FROM seeded WHERE k <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
                  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
                  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM rows_),
f AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS x,
             CASE WHEN body = '' THEN 'b' WHEN again > 1 THEN 'd' WHEN right(body, 1) IN ('.', '!', '?') THEN '-'
                  ELSE 't' END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
      FROM placed),
convs AS (SELECT DISTINCT conv_id FROM conversations),
stat AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
                count(*) FILTER (WHERE fault = 't') AS truncated,
                count(*) FILTER (WHERE before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal
         FROM f GROUP BY conv_id),
front AS (
    SELECT conv_id, 0::BIGINT AS i, q, {{'c': c, 'a': a}} AS b FROM convs CROSS JOIN ins WHERE p = 0
    UNION ALL
    SELECT e.conv_id, e.i, ins.q, min({{'c': e.c + ins.c, 'a': e.a || ins.a}})
    FROM (SELECT front.conv_id, f.i, moves.q, front.b.a || moves.e AS a,
                 front.b.c + moves.c + CASE WHEN f.fault = 't' AND moves.e <> 'D' THEN 1 ELSE 0 END AS c
          FROM front JOIN f ON f.conv_id IS NOT DISTINCT FROM front.conv_id AND f.i = front.i + 1
          JOIN moves ON moves.p = front.q AND (moves.x IS NULL OR moves.x = f.x)
                    AND (moves.e = 'D' OR f.fault NOT IN ('b', 'd'))) e
    JOIN ins ON ins.p = e.q GROUP BY e.conv_id, e.i, ins.q),
best AS (SELECT front.conv_id, min(front.b) AS b FROM front LEFT JOIN stat ON stat.conv_id IS NOT DISTINCT FROM front.conv_id
         WHERE front.i = coalesce(stat.n, 0) AND front.q IN (0, 3) GROUP BY front.conv_id),
edits AS (SELECT conv_id, j, substr(b.a, j, 1) AS e
          FROM (SELECT conv_id, b, unnest(range(1, length(b.a) + 1)) AS j FROM best)),
run AS (SELECT *, count(*) FILTER (WHERE e <> 'I') OVER w AS i, count(*) FILTER (WHERE e <> 'D') OVER w AS o
        FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
met AS (SELECT run.conv_id, run.j, run.e, run.o, f.role, f.text,
               max(CASE WHEN run.o = 1 AND run.e = 'K' AND f.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY run.conv_id) AS s
        FROM run LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM run.conv_id AND f.i = run.i AND run.e <> 'I'),
told AS (SELECT conv_id, string_agg(CASE WHEN e = 'K' THEN role WHEN (o - s) % 2 = 1 THEN 'user' ELSE 'assistant' END
                                    || ':' || CASE WHEN e = 'I' THEN '' ELSE text END, chr(10) ORDER BY j) AS t
         FROM met WHERE e <> 'D' GROUP BY conv_id)
SELECT convs.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(best.b.c AS BIGINT) AS cost,
       best.b.a AS audit, sha256(coalesce(told.t, '')) AS repaired_sha256
FROM convs JOIN best ON best.conv_id IS NOT DISTINCT FROM convs.conv_id
LEFT JOIN stat ON stat.conv_id IS NOT DISTINCT FROM convs.conv_id
LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM convs.conv_id
"""


def _leaf(n_chars: str) -> str:
    values = ["doc_id::VARCHAR", "source", "lang", f"({n_chars})::VARCHAR", "text"]
    return "sha256(" + " || ".join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values) + ")"


def _fold(name: str, start: str, nodes: str) -> str:
    """Recursive table of the walk up from ``start`` (r, g, l, i, n, h, s): h folded, s the siblings so far."""
    return f"""{name} AS ({start} UNION ALL
    SELECT r, w.g, w.l + 1, w.i // 2, (w.n + 1) // 2,
           sha256(CASE WHEN w.i % 2 = 1 THEN sib.h || w.h ELSE w.h || coalesce(sib.h, '') END), s || coalesce(sib.h, '')
    FROM {name} w LEFT JOIN {nodes} sib
      ON sib.g IS NOT DISTINCT FROM w.g AND sib.l = w.l AND sib.i = w.i + 1 - 2 * (w.i % 2) WHERE w.n > 1)"""


OP13 = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf,
        CASE WHEN {_crc('doc_id::VARCHAR')} % 7 = 0 THEN {_leaf('n_chars + 1')} END AS other FROM documents),
leaves AS (SELECT *, row_number() OVER () AS r, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1
        AS i, count(*) OVER (PARTITION BY lang) AS n FROM d),
tree AS (SELECT lang AS g, 0 AS l, i, n, leaf AS h FROM leaves UNION ALL
    SELECT g, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tree WHERE n > 1
    GROUP BY g, l, n, i // 2),
subs AS (SELECT g AS lang, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, count(*) OVER () AS n
         FROM tree WHERE n = 1),
top AS (SELECT 'top' AS g, 0 AS l, i, n, subroot AS h FROM subs UNION ALL
    SELECT g, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM top WHERE n > 1
    GROUP BY g, l, n, i // 2),
{_fold('low', "SELECT r, lang AS g, 0 AS l, i, n, coalesce(other, leaf) AS h, '' AS s FROM leaves", 'tree')},
{_fold('high', "SELECT r, 'top' AS g, 0 AS l, subs.i, subs.n, low.h, low.s FROM low JOIN subs "
               "ON subs.lang IS NOT DISTINCT FROM low.g WHERE low.n = 1", 'top')}
SELECT leaves.doc_id, leaf, subroot, (SELECT h FROM top WHERE n = 1) AS root, sha256(high.s) AS proof_sha256,
       high.h AS folded_root, high.h = (SELECT h FROM top WHERE n = 1) AS verified
FROM leaves JOIN high ON high.r = leaves.r AND high.n = 1 JOIN subs ON subs.lang IS NOT DISTINCT FROM leaves.lang
"""

SQL = {"op2_decontaminate": OP2, "op7_exact_dedup": OP7, "op8_line_dedup": OP8, "op12_conversation_repair": OP12,
       "op13_merkle": OP13}
