"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations


def _most(pattern: str, text: str = "text") -> str:
    return f"list_max(list_transform(string_split_regex({text}, '{pattern}'), lambda x: length(x)))"


INVISIBLE = r"\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}"
SPACES = r"\x{B}\x{C}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WIDE = r"\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FB00}-\x{FB06}\x{FB13}-\x{FB17}"
MIXED = r"'\p{Latin}\p{M}*[\p{Greek}\p{Cyrillic}]|[\p{Greek}\p{Cyrillic}]\p{M}*\p{Latin}|\p{Greek}\p{M}*\p{Cyrillic}|\p{Cyrillic}\p{M}*\p{Greek}'"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
NARROW = f"translate(seen, '{''.join(chr(ord(c) + 0xFEE0) for c in LETTERS)}', '{LETTERS}')"
ALIKE = f"translate({NARROW}, 'аеоуіАЕОУІοαΟΑΕΙ', 'aeoyiAEOYIoaOAEI')"
WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

_LONG = rf"""
        WITH long AS (
          SELECT DISTINCT unit_id, text, max_chars - overlap_chars AS size FROM units JOIN unit_limits USING (unit_type) WHERE length(text) > max_chars),
        b AS (SELECT unit_id, text, CASE
          WHEN {_most(r"\n[\t\r\f\v ]*(?:\n[\t\r\f\v ]*)+")} <= size THEN 'paragraph'
          WHEN {_most(r"\n+")} <= size THEN 'line'
          WHEN {_most(chr(1), "regexp_replace(text, '([.!?])[ \\n]+', '\\1' || chr(1), 'g')")} <= size THEN 'sentence'
          WHEN {_most(r"[ \n]+")} <= size THEN 'word' ELSE 'none' END AS boundary
        FROM long)"""

#: Pairs of records with similar texts (equal ones included).
_ALIKE = rf"""
        WITH RECURSIVE r AS (SELECT DISTINCT 'documents' AS record_kind, doc_id AS id, text FROM documents
                   UNION SELECT DISTINCT 'evidence', evidence_id, text FROM evidence),
        w AS (SELECT *, {WORDS} AS w FROM r),
        g AS (SELECT DISTINCT record_kind, id, text, unnest(list_transform(range(1, len(w) - 2), lambda p: array_to_string(w[p:p+3], ' '))) AS g FROM w WHERE len(w) >= 40),
        n AS (SELECT record_kind, id, text, count(*) AS n FROM g GROUP BY ALL),
        t AS (SELECT a.record_kind, a.id AS id_a, b.id AS id_b, a.text AS text_a, b.text AS text_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.record_kind = b.record_kind AND a.id < b.id GROUP BY ALL),
        s AS (SELECT t.* FROM t JOIN n x ON x.record_kind = t.record_kind AND x.id = id_a AND x.text = text_a JOIN n y ON y.record_kind = t.record_kind AND y.id = id_b AND y.text = text_b
              WHERE c >= 0.6 * (x.n + y.n - c))"""

ORACLE: dict[str, str] = {
    "p1_found": f"{_LONG} SELECT unit_id, boundary FROM b",
    "p1_rejoined": f"{_LONG} SELECT unit_id, boundary, md5(text) AS whole, true AS fits, true AS overlaps FROM b",
    "p5_found": f"""{_ALIKE}
        SELECT record_kind, id_a, id_b FROM (SELECT DISTINCT record_kind, id_a, id_b FROM s WHERE text_a <> text_b)""",
    "p5_components": f"""{_ALIKE},
        e AS (SELECT record_kind, id_a AS x, id_b AS y FROM s UNION SELECT record_kind, id_b, id_a FROM s),
        c AS (SELECT DISTINCT record_kind, id AS x, id AS y FROM n UNION SELECT r.record_kind, r.x, e.y FROM c r JOIN e ON r.record_kind = e.record_kind AND r.y = e.x)
        SELECT record_kind, x AS record_id, min(y) AS first_id FROM c GROUP BY ALL""",
    "p7_found": rf"""
        WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
        i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
        dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 10), lambda p: array_to_string(w[p:p+11], ' '))) AS g FROM d WHERE len(w) >= 12),
        ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 10), lambda p: array_to_string(w[p:p+11], ' '))) AS g FROM i WHERE len(w) >= 12)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p8_found": rf"""
        WITH d AS (SELECT DISTINCT doc_id, text, regexp_replace(text, '[{INVISIBLE}]', '', 'g') AS seen FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, 'invisible' AS form FROM d WHERE text <> seen
        UNION SELECT doc_id, 'space' FROM d WHERE regexp_matches(text, '[{SPACES}]')
        UNION SELECT doc_id, 'width' FROM d WHERE regexp_matches(text, '[{WIDE}]')
        UNION SELECT doc_id, 'combining' FROM d WHERE nfc_normalize({NARROW}) <> {NARROW}
          OR (regexp_matches(seen, {MIXED}) AND nfc_normalize({ALIKE}) <> {ALIKE})
        UNION SELECT doc_id, 'lookalike' FROM d
          WHERE regexp_matches(seen, {MIXED})""",
}
