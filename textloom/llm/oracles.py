"""DuckDB SQL with the same rows as the queries that SQL can express."""

from __future__ import annotations

import string

from textloom.llm.decontaminate import LITERALS, PERCENT, UNITS, WINDOW

_UP, _LOW = string.ascii_uppercase, string.ascii_lowercase

# Components by a recursive search over all exact links; feasible for the small tables of a check only.
NEAR_DUP = rf"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sh AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN [array_to_string(w[i:i+3], ' ') for i in range(1, len(w) - 2)] WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    classes AS (SELECT min(doc_id) AS node, list_sort(s) AS s FROM sh WHERE len(s) > 0 GROUP BY list_sort(s)),
    x AS (SELECT node, len(s) AS n, unnest(s) AS g FROM classes),
    pairs AS (SELECT a.node AS a, b.node AS b, count(*) AS both_, any_value(a.n) AS na, any_value(b.n) AS nb FROM x a JOIN x b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node),
    links AS (SELECT a, b FROM pairs WHERE 100 * both_ >= 80 * (na + nb - both_)),
    edges AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
    reach(node, seen) AS (SELECT node, node FROM classes UNION SELECT r.node, e.v FROM reach r JOIN edges e ON r.seen = e.u),
    comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
    SELECT sh.doc_id, len(sh.s)::BIGINT AS n_shingles, coalesce(comp.component, sh.doc_id) AS component_id, coalesce(comp.component, sh.doc_id) = sh.doc_id AS kept
    FROM sh LEFT JOIN classes ON list_sort(sh.s) = classes.s LEFT JOIN comp ON comp.node = classes.node"""


def _u(key: str, shard: int) -> str:
    return f"((('0x' || substr(md5({key} || ':{shard}'), 1, 13))::BIGINT)::DOUBLE + 0.5) / 4503599627370496.0"


def _shard(shards: int) -> str:
    costs = ", ".join(f"-ln({_u('key', s)})" for s in range(shards))
    return f"(list_position([{costs}], list_min([{costs}])) - 1)::INT"


def _crc_table() -> list[int]:
    out = []
    for at in range(256):
        for _ in range(8):
            at = at >> 1 ^ (0xEDB88320 if at & 1 else 0)
        out.append(at)
    return out


#: CRC-32 of column b, a list of byte values, by the table method.
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, {_crc_table()}[(xor(c & 255, x) + 1)::INT])), 4294967295)"

SHARDING = f"""
    WITH t AS (SELECT doc_id, doc_id::VARCHAR AS key, hex(encode(coalesce(text, ''))) AS h FROM documents),
    r AS (SELECT doc_id, key, [('0x' || substr(h, 2 * i + 1, 2))::BIGINT for i in range(0, length(h) // 2)] AS b, (length(h) // 2 + 1)::BIGINT AS size FROM t),
    s AS (SELECT doc_id, size, {_CRC}::BIGINT AS text_crc32, {_shard(8)} AS shard, {_shard(9)} AS grown_shard FROM r)
    SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, grown_shard FROM s"""

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_base32 = " || ".join(f"substr('{_DIGITS}', (((('0x' || substr(d, {1 + 10 * part}, 10))::BIGINT >> {35 - 5 * k}) & 31) + 1)::INT, 1)" for part in range(4) for k in range(8))
WARC = f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS d FROM pages),
    q AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_base32} AS payload_digest, min(page_id) OVER (PARTITION BY d) AS first FROM p)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM q"""


def _marked(text: str) -> str:
    names = rf"regexp_replace({text}, '([\p{{Ll}},;] +)(\p{{Lu}}\p{{Ll}}+)', '\1' || chr(1) || '\2', 'g')"
    names = rf"regexp_replace({names}, '(\x01\p{{Lu}}\p{{Ll}}+)( +)(\p{{Lu}}\p{{Ll}}+)', '\1\2' || chr(1) || '\3', 'g')"
    return rf"regexp_replace({names}, '(\d *)({UNITS})([^\p{{L}}\p{{N}}]|$)', '\1' || chr(2) || '\2\3', 'g')"


def _tokens(mark: str) -> str:
    short = rf"regexp_replace(regexp_replace({mark}, '([\x01\x02])[\p{{L}}\p{{M}}]+', '\1', 'g'), '\d+(?:[.,]\d+)*', chr(3), 'g')"
    return rf"regexp_extract_all(lower({short}), '[\x01\x02\x03]|[\p{{L}}\p{{M}}]+')"


_RAW = r"regexp_extract_all(mark, '[\x01\x02]?[\p{L}\p{M}]+|\d+(?:[.,]\d+)*')"
DECONTAMINATION = f"""
    WITH i0 AS (SELECT DISTINCT item_id, {_marked("coalesce(text, '')")} AS mark FROM benchmark WHERE item_id IS NOT NULL),
    i1 AS (SELECT item_id, {_RAW} AS raw, {_tokens("mark")} AS t FROM i0),
    forms AS (SELECT item_id, 0 AS form, t FROM i1 UNION ALL SELECT item_id, 1, list_prepend(chr(1), t[2:]) FROM i1 WHERE len(t) >= {WINDOW}),
    iw AS (SELECT item_id, form, unnest([{{'pos': k - 1, 'w': t[k:k + {WINDOW - 1}]}} for k in range(1, len(t) - {WINDOW - 2})], recursive := true) FROM forms),
    usable AS (SELECT DISTINCT item_id, form, pos, w FROM iw WHERE len(list_filter(w, lambda x: x > chr(3))) >= {LITERALS}),
    counts AS (SELECT item_id, count(DISTINCT pos) AS n_windows FROM usable WHERE form = 0 GROUP BY item_id),
    keys AS (SELECT DISTINCT item_id, pos, array_to_string(w, ' ') AS w FROM usable),
    d0 AS (SELECT doc_id, {_marked("coalesce(text, '')")} AS mark FROM documents WHERE doc_id IS NOT NULL),
    d1 AS (SELECT doc_id, {_RAW} AS raw, {_tokens("mark")} AS t FROM d0),
    dw AS (SELECT doc_id, unnest([{{'place': k - 1, 'w': array_to_string(t[k:k + {WINDOW - 1}], ' ')}} for k in range(1, len(t) - {WINDOW - 2})], recursive := true) FROM d1),
    hits AS (SELECT DISTINCT doc_id, item_id, pos, place - pos AS shift FROM dw JOIN keys USING (w)),
    lines AS (SELECT doc_id, item_id, shift, count(DISTINCT pos) AS n FROM hits GROUP BY ALL),
    best AS (SELECT doc_id, item_id, shift FROM lines QUALIFY 100 * n >= {PERCENT} * max(n) OVER (PARTITION BY doc_id, item_id)),
    found AS (SELECT doc_id, item_id, count(DISTINCT pos) AS matched FROM hits GROUP BY ALL),
    leak AS (SELECT f.doc_id, f.item_id, c.n_windows, f.matched, b.shift, i1.raw AS ir, i1.t AS it, d1.raw AS dr, d1.t AS dt
             FROM found f JOIN counts c USING (item_id) JOIN best b USING (doc_id, item_id) JOIN i1 USING (item_id) JOIN d1 USING (doc_id) WHERE 100 * f.matched >= {PERCENT} * c.n_windows),
    slots AS (SELECT *, list_filter(range(1, len(it) + 1), lambda k: it[k] <= chr(3)) AS ks FROM leak),
    pairs AS (SELECT *, list_filter(ks, lambda k: k + shift >= 1 AND dt[k + shift] = it[k]) AS ok FROM slots),
    vals AS (SELECT *, [{{'a': ir[k], 'b': dr[k + shift]}} for k in ok] AS ps FROM pairs)
    SELECT doc_id, item_id, n_windows, matched, len(ks)::BIGINT AS n_slots, min(len(list_filter(ps, lambda p: p.a <> p.b)))::BIGINT AS changed_slots
    FROM vals WHERE len(list_distinct(ps)) = len(list_distinct(list_transform(ps, lambda p: p.a))) GROUP BY ALL"""

ORACLES = {"op3_decontaminate": DECONTAMINATION, "op6_sharding": SHARDING, "op7_warc": WARC, "op10_near_dup": NEAR_DUP}
