"""DuckDB SQL for the rows of queries that SQL can express, on tables of some thousand documents."""

from __future__ import annotations

#: Words of a text and their places; A-Z lower-cased.
_WORDS = r"""lowered AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)"""

NEAR_DEDUP = rf"""
WITH RECURSIVE {_WORDS},
listed AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM lowered),
shingles AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [len(w)::VARCHAR || ' words ' || array_to_string(w, ' ')] ELSE [] END) AS s FROM listed),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS node, a AS seen FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.seen),
least AS (SELECT node, min(seen) AS c FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(l.c, d.doc_id) AS component_id, coalesce(l.c, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.node = d.doc_id"""

LINE_DEDUP = rf"""
WITH parts AS MATERIALIZED (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place FROM documents WHERE text IS NOT NULL),
lines AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY doc_id, place) AS id FROM parts WHERE line <> ''),
words AS MATERIALIZED (SELECT DISTINCT id, unnest(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')) AS w FROM lines),
often AS (SELECT w, count(*) AS c FROM words GROUP BY 1),
ranked AS MATERIALIZED (SELECT id, w, row_number() OVER (PARTITION BY id ORDER BY c, w) AS at, count(*) OVER (PARTITION BY id) AS n FROM words JOIN often USING (w)),
sets AS MATERIALIZED (SELECT id, n, list(w ORDER BY w) AS s FROM ranked GROUP BY 1, 2),
classes AS MATERIALIZED (SELECT s, n, min(id) AS id FROM sets GROUP BY 1, 2),
prefixes AS (SELECT r.id, r.w, r.n FROM ranked r JOIN classes USING (id) WHERE r.at <= r.n - (75 * r.n + 99) // 100 + 1),
candidates AS (SELECT DISTINCT x.id AS x, y.id AS y FROM prefixes x JOIN prefixes y ON x.w = y.w AND x.id < y.id AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n)),
near AS (SELECT DISTINCT y FROM candidates JOIN classes a ON a.id = x JOIN classes b ON b.id = y WHERE 100 * len(list_intersect(a.s, b.s)) >= 75 * (a.n + b.n - len(list_intersect(a.s, b.s)))),
gone AS MATERIALIZED (SELECT l.id FROM sets l JOIN classes c ON c.s = l.s WHERE l.id <> c.id OR c.id IN (SELECT y FROM near)),
kept AS (SELECT p.doc_id, string_agg(p.line, chr(10) ORDER BY p.place) AS kept FROM parts p LEFT JOIN lines l ON l.doc_id = p.doc_id AND l.place = p.place WHERE l.id IS NULL OR l.id NOT IN (SELECT id FROM gone) GROUP BY 1),
counts AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (id IN (SELECT id FROM gone)) AS n_removed FROM lines GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, md5(coalesce(k.kept, '')) AS kept_md5
FROM documents d LEFT JOIN counts c ON c.doc_id = d.doc_id LEFT JOIN kept k ON k.doc_id = d.doc_id"""


def _curve(dimensions: int, bits: int) -> str:
    """Steps from cells(row, x0, x1, ...) to curved(row, curve): one common table expression for each turn of the cube."""
    axes, steps, last = range(dimensions), [], "cells"
    for level in range(bits - 1, 0, -1):
        below = (1 << level) - 1
        for k in axes:
            changed = {0: f"CASE WHEN (x{k} >> {level}) & 1 = 1 THEN xor(x0, {below}) ELSE xor(x0, xor(x0, x{k}) & {below}) END"}
            if k:
                changed[k] = f"CASE WHEN (x{k} >> {level}) & 1 = 1 THEN x{k} ELSE xor(x{k}, xor(x0, x{k}) & {below}) END"
            steps.append(f"turn{level}_{k} AS (SELECT row, {', '.join(changed.get(j, f'x{j}') + f' AS x{j}' for j in axes)} FROM {last})")
            last = f"turn{level}_{k}"
    for k in axes[1:]:
        steps.append(f"gray{k} AS (SELECT row, {', '.join((f'xor(x{j}, x{j - 1})' if j == k else f'x{j}') + f' AS x{j}' for j in axes)} FROM {last})")
        last = f"gray{k}"
    flip = "0"
    for level in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN (x{dimensions - 1} >> {level}) & 1 = 1 THEN {(1 << level) - 1} ELSE 0 END)"
    steps.append(f"flipped AS (SELECT row, {', '.join(f'xor(x{j}, {flip}) AS x{j}' for j in axes)} FROM {last})")
    places = " + ".join(f"(((x{j} >> {level}) & 1) << {level * dimensions + dimensions - 1 - j})" for level in range(bits) for j in axes)
    return ",\n".join([*steps, f"curved AS (SELECT row, {places} AS curve FROM flipped)"])


def sharding(n: int, bits: int) -> str:
    """Rows of shards along the curve through lang, source and size; crc32 byte by byte, from a table made here by its rule."""
    cell = lambda c: f"((rank() OVER (ORDER BY {c} NULLS FIRST) - 1) * {1 << bits}) // count(*) OVER ()"
    return f"""
WITH RECURSIVE remainders AS (SELECT i, 0 AS step, i AS c FROM range(256) r(i) UNION ALL SELECT i, step + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM remainders WHERE step < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM remainders WHERE step = 8),
measured AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, lang, source, strlen(coalesce(text, '')) + 8 AS size,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda h: ('0x' || h)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32 FROM documents, crc),
cells AS (SELECT row, {cell("lang")} AS x0, {cell("source")} AS x1, {cell("size")} AS x2 FROM measured),
{_curve(3, bits)},
ranked AS (SELECT *, row_number() OVER (ORDER BY curve, text_crc32, doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM measured JOIN curved USING (row))
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * {n} // n)::INTEGER AS shard, (place - ((place * {n} // n) * n + {n - 1}) // {n})::BIGINT AS slot, NULL::INTEGER AS grown_shard, curve::BIGINT AS curve FROM ranked"""


_TERMS = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"


def source_audit(min_docs: int, smooth: int, unit: int, top: int) -> str:
    share = lambda c, n: f"1 + ({unit}::HUGEINT * ({c} + {smooth})) // ({n} + {smooth} * v)"
    return rf"""
WITH docs AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS MATERIALIZED (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERMS}')) AS term FROM docs),
vocabulary AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM words GROUP BY 1, 2 HAVING count(DISTINCT row) >= {min_docs}),
counts AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM words JOIN vocabulary USING (lang, term) GROUP BY 1, 2, 3),
sizes AS (SELECT lang, count(*) AS v, sum(total) AS n_lang FROM vocabulary GROUP BY 1),
totals AS (SELECT lang, source, sum(c) AS n FROM counts GROUP BY 1, 2),
held AS MATERIALIZED (SELECT g.lang, g.source, coalesce(n, 0) AS n, coalesce(v, 0) AS v, coalesce(n_lang, 0) AS n_lang FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN totals USING (lang, source) LEFT JOIN sizes USING (lang)),
shares AS MATERIALIZED (SELECT h.lang, h.source, v.term, coalesce(c, 0) AS c, {share("coalesce(c, 0)", "n")} AS p, {share("total", "n_lang")} AS q FROM held h JOIN vocabulary v USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 4
  UNION ALL SELECT a.lang, a.source, 'pair', b.source, 0 FROM held a JOIN held b ON a.lang = b.lang AND a.source <> b.source WHERE a.v = 0),
marks AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (FROM pairs UNION ALL FROM marks))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}"""
