"""DuckDB SQL equal to the queries of plans/pipeline.py; what SQL can't express over whole tables (patterns that look behind, greedy and fitted things) has none."""

from __future__ import annotations

from harborlight.plans.oracle import BH, BM, CANON, CELLS, CENT, CROSS, FEATURES, GRAMS, LABEL, MEMBERS, OUT, PRIOR, SUPPORT, UNITS, hhi, metrics, norm, toks
from harborlight.plans.oracle import DENSE as DENSE_SERIES

CPL = CROSS + """,
cpl AS (SELECT DISTINCT r.complaint_id, r.date_received, CAST(date_trunc('month', r.date_received) AS DATE) AS period_month, a.company_id, w.family AS product_family, w.product_std, r.issue AS issue_std, r.sub_issue AS sub_issue_std,
 r.state, r.tags, r.company_response, r.has_narrative FROM complaints_raw r LEFT JOIN company_alias a ON a.alias_raw = r.company_raw
 LEFT JOIN cw w ON w.complaint_id = r.complaint_id AND w.product IS NOT DISTINCT FROM r.product AND w.sub_product IS NOT DISTINCT FROM r.sub_product)"""
ST = CPL + """,
st AS (SELECT n.complaint_id AS id, text_hash AS h, text_redacted AS text, char_len, date_received AS day, product_family AS family, state, company_id AS company FROM narratives n JOIN cpl USING (complaint_id)),
hg AS (SELECT *, 'g' || min(id) OVER (PARTITION BY h) AS group_id FROM st WHERE h IS NOT NULL)"""
LK = "lk AS (SELECT least(complaint_id_a, complaint_id_b) AS a, greatest(complaint_id_a, complaint_id_b) AS b, similarity, method FROM dup_pairs WHERE complaint_id_a IS NOT NULL AND complaint_id_b IS NOT NULL)"
PAIRS = ST + ", " + LK + """,
l1 AS (SELECT DISTINCT a, b FROM lk WHERE a < b),
pool AS (SELECT *, sha256('pairs:' || id) AS ph FROM (SELECT DISTINCT id, family FROM st WHERE family IS NOT NULL) ORDER BY ph, id LIMIT 4000),
bes AS (SELECT least(id, o) AS a, greatest(id, o) AS b FROM (SELECT id, lead(id) OVER (PARTITION BY family ORDER BY ph, id) AS o FROM pool) WHERE o IS NOT NULL),
ep AS ((SELECT a, b, 'obvious' AS stratum FROM (SELECT DISTINCT a, b FROM lk WHERE a < b AND similarity >= 0.98) ORDER BY sha256('pairs:' || a || ':' || b), a, b LIMIT 100)
 UNION ALL (SELECT a, b, 'hard' FROM (SELECT DISTINCT a, b FROM lk WHERE a < b AND similarity BETWEEN 0.70 AND 0.93) ORDER BY sha256('pairs:' || a || ':' || b), a, b LIMIT 100)
 UNION ALL (SELECT a, b, 'unrelated' FROM bes ANTI JOIN l1 USING (a, b) ORDER BY sha256('pairs:' || a || ':' || b), a, b LIMIT 100))"""
SHINGLED = PAIRS + """,
sh AS (SELECT complaint_id AS id, list_distinct(list_transform(generate_series(1, greatest(length(text_redacted) - 4, 1)), lambda i: substr(text_redacted, i, 5))) AS s FROM narratives WHERE complaint_id IN (SELECT a FROM ep UNION SELECT b FROM ep) AND text_redacted IS NOT NULL),
lp AS (SELECT a, b, stratum, round(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), 4) AS true_jaccard FROM ep JOIN sh x ON x.id = a JOIN sh y ON y.id = b)"""
CAMPAIGN = ST + ", mem AS (SELECT group_id, id, day, family, state, company, char_len, text FROM hg)" + FEATURES[len(MEMBERS) :] + f""",
fm AS (SELECT group_id, family FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY fc DESC, family) AS rn FROM (SELECT group_id, family, count(*) AS fc FROM mem WHERE family IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
tc AS (SELECT group_id, company AS top_company FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY fc DESC, company) AS rn FROM (SELECT group_id, company, count(*) AS fc FROM mem WHERE company IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
b AS (SELECT family, base_state, base_company FROM {hhi('family', 'state', 'base_state')} JOIN {hhi('family', 'company', 'base_company')} USING (family)),
j AS (SELECT f.*, fm.family, base_state, base_company, first_seen, last_seen, top_company FROM f JOIN (SELECT group_id, min(day) AS first_seen, max(day) AS last_seen FROM mem GROUP BY group_id) USING (group_id)
 LEFT JOIN fm USING (group_id) LEFT JOIN tc USING (group_id) LEFT JOIN b ON b.family = fm.family),
k AS (SELECT *, coalesce((burstiness > 3)::INT, 0) + coalesce((state_hhi > 1.5 * (base_state + (1 - base_state) / n_complaints))::INT, 0) + coalesce((company_hhi > 1.5 * (base_company + (1 - base_company) / n_complaints))::INT, 0)
  + (coalesce(length_cv, 1) < 0.2)::INT + coalesce((boilerplate > 0.5)::INT, 0) AS n_signals FROM j WHERE n_complaints >= 3)"""
ROWS = "tr AS (SELECT h, row_number() OVER (ORDER BY h) - 1 AS row_idx FROM (SELECT DISTINCT text_hash AS h FROM narratives WHERE text_hash IS NOT NULL))"
MAP = ROWS + ", em AS (SELECT complaint_id AS id, row_idx, 'hashing-64' AS model, 64 AS dim FROM narratives JOIN tr ON text_hash = h)"


def encoded(name: str, table: str, key: str) -> str:
    """(key, v) of 64 places for each text with a token."""
    return f"""{name}t AS (SELECT {key} AS k, unnest(list_concat({toks("CASE WHEN length(text) <= 2000 THEN text ELSE left(text, 2000) END")}, CASE WHEN length(text) <= 2000 THEN [] ELSE {toks("right(text, 2000)")} END)) AS t FROM {table} WHERE text IS NOT NULL),
{name}h AS (SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT AS x FROM {name}t), {name}s AS (SELECT k, x % 64 AS i, sum(CASE WHEN (x // 64) % 2 = 0 THEN 1.0 ELSE -1.0 END)::DOUBLE AS w FROM {name}h GROUP BY ALL),
{name}n AS (SELECT k, sqrt(sum(w * w)) AS nn FROM {name}s GROUP BY k HAVING nn > 0), {name} AS (SELECT k, list(coalesce(w, 0.0) / nn ORDER BY i) AS v FROM (SELECT k, nn, unnest(range(64)) AS i FROM {name}n) LEFT JOIN {name}s USING (k, i) GROUP BY k)"""


DENSE = encoded("ed", "documents", "doc_id") + ", " + encoded("eq", "eval_items", "item_id") + """,
dn0 AS (SELECT eq.k AS query_id, ed.k AS doc_id, round(list_dot_product(eq.v, ed.v), 9) AS score FROM eq CROSS JOIN ed),
dr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dn0) WHERE rank <= 50)"""
RANKINGS = DENSE + ", " + BM + """,
sr AS (SELECT * FROM br WHERE rank <= 50),
fz AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0) AS score FROM dr d FULL JOIN sr s USING (query_id, doc_id))) WHERE rank <= 10)"""
KNN = CENT + """,
kn AS (SELECT * FROM (SELECT q.id, p.id AS o, round(list_dot_product(q.v, p.v), 9) AS score, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, p.v) DESC, p.id) AS rank FROM pt q JOIN pt p ON q.id <> p.id) WHERE rank <= 5),
co AS (SELECT id, score AS core FROM kn WHERE rank = 5), dz AS (SELECT id FROM co WHERE core >= 0.30),
eg AS (SELECT id AS a, o AS b FROM kn WHERE score >= 0.30 AND id IN (SELECT id FROM dz) AND o IN (SELECT id FROM dz)), es AS (SELECT a, b FROM eg UNION SELECT b, a FROM eg),
rc(v, g) AS (SELECT id, id FROM dz UNION SELECT es.b, rc.g FROM rc JOIN es ON es.a = rc.v WHERE rc.g < es.b),
cp AS (SELECT v AS id, min(g) AS component FROM rc GROUP BY v), cz AS (SELECT component, count(*) AS n FROM cp GROUP BY ALL HAVING n >= 10),
cn2 AS (SELECT component, row_number() OVER (ORDER BY n DESC, component) - 1 AS cluster FROM cz),
dc2 AS (SELECT pt.id, coalesce(cluster, -1) AS cluster, core FROM pt LEFT JOIN co USING (id) LEFT JOIN cp USING (id) LEFT JOIN cn2 USING (component))"""


def half(name: str, cond: str) -> str:
    return f"""{name}x AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(generate_series(1, len(v))) AS i, unnest(v) AS x FROM pu WHERE {cond}) GROUP BY ALL),
{name}c AS (SELECT label AS cluster, list_transform(list(m ORDER BY i), lambda x: x / sqrt(sum(m * m))) AS centroid FROM {name}x GROUP BY label),
{name} AS (SELECT id, arg_max(cluster, (list_dot_product(v, centroid), -cluster)) AS l FROM pu CROSS JOIN {name}c WHERE u < 0.2 GROUP BY id)"""


AGREE = """ct AS (SELECT x, y, count(*)::DOUBLE AS n FROM ab GROUP BY ALL), sx AS (SELECT sum(s * (s - 1) / 2) AS sx, sum(s * ln(s)) AS lx FROM (SELECT sum(n) AS s FROM ct GROUP BY x)), sy AS (SELECT sum(s * (s - 1) / 2) AS sy, sum(s * ln(s)) AS ly FROM (SELECT sum(n) AS s FROM ct GROUP BY y)),
sn AS (SELECT sum(n) AS n, sum(n * (n - 1) / 2) AS sc, sum(n * ln(n)) AS lc FROM ct),
ag AS (SELECT n, (sc - sx * sy / (n * (n - 1) / 2)) / ((sx + sy) / 2 - sx * sy / (n * (n - 1) / 2)) AS ari, (ln(n) + (lc - lx - ly) / n) / ((ln(n) - lx / n + ln(n) - ly / n) / 2) AS nmi FROM sn, sx, sy)"""
BU = "bu AS (SELECT *, row_number() OVER (ORDER BY product NULLS FIRST, issue NULLS FIRST, sub_issue NULLS FIRST) - 1 AS unit FROM (SELECT product, issue, sub_issue, count(DISTINCT complaint_id) AS n_members FROM complaints_raw GROUP BY ALL))"
EV = UNITS + """,
ev AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY group_id, company_id ORDER BY day, line, part) AS rn FROM e WHERE cluster_id IS NOT NULL AND family = cluster_family) WHERE rn = 1)"""
FILING = "regexp_replace(trim(regexp_replace(upper(regexp_replace(replace(alias_raw, '.', ''), '[^A-Za-z0-9 ]+', ' ', 'g')), ' +', ' ', 'g')), '(?:(?:^| )(?:CORPORATION|HOLDINGS|COMPANY|CORP|PLLC|INC|LLC|LTD|CO|LP|NA|PC))+$', '')"
WORDS = "string_split(upper(trim(regexp_replace({}, '[^A-Za-z0-9]+', ' ', 'g'))), ' ')"
WILSON = """round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS low, round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS high"""
LINE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def star(nodes: str, links: str, name: str) -> str:
    """(id, seed) of star clusters as a recursive query: rounds in which an undecided node that comes before its undecided neighbours is a seed."""
    return f"""{name}_b AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM {links} UNION ALL SELECT b, a FROM {links}) WHERE a <> b AND a IN (SELECT id FROM {nodes}) AND b IN (SELECT id FROM {nodes})),
{name}_n AS (SELECT id, coalesce(deg, 0) AS deg FROM (SELECT DISTINCT id FROM {nodes}) LEFT JOIN (SELECT a AS id, count(*) AS deg FROM {name}_b GROUP BY a) USING (id)),
{name}_s(r, id, deg, open, seed) AS (SELECT 0, id, deg, deg > 0, deg = 0 FROM {name}_n
 UNION ALL (WITH cur AS (SELECT * FROM {name}_s), o AS (SELECT * FROM cur WHERE open),
  rv AS (SELECT x.a AS id, min((-y.deg, y.id)) AS best FROM {name}_b x JOIN o y ON y.id = x.b GROUP BY x.a), sd AS (SELECT o.id FROM o LEFT JOIN rv USING (id) WHERE best IS NULL OR (-o.deg, o.id) < best),
  tk AS (SELECT DISTINCT x.a AS id FROM {name}_b x JOIN sd ON sd.id = x.b)
  SELECT r + 1, id, deg, open AND id NOT IN (SELECT id FROM sd) AND id NOT IN (SELECT id FROM tk), seed OR id IN (SELECT id FROM sd) FROM cur WHERE (SELECT count(*) FROM o) > 0)),
{name}_e AS (SELECT id, deg, seed FROM {name}_s WHERE r = (SELECT max(r) FROM {name}_s)),
{name} AS (SELECT e.id, CASE WHEN e.seed THEN e.id ELSE n.s END AS seed FROM {name}_e e LEFT JOIN (SELECT x.a AS id, arg_min(y.id, (-y.deg, y.id)) AS s FROM {name}_b x JOIN {name}_e y ON y.id = x.b AND y.seed GROUP BY x.a) n USING (id))"""



def _edge(before: str, body: str, after: str | None) -> tuple[str, str]:
    """A pattern with its neighbours as groups instead of looking around, and what to put in: SQL's patterns can't look."""
    return f"(^|{before})(?:{body})" + (f"($|{after})" if after else ""), "\\1{}" + ("\\2" if after else "")


def redaction() -> str:
    """CTEs rd0 ... rd: (complaint_id, t, n_email ... n_account) of narratives, a pattern a step, each run twice where neighbours may share a character."""
    street = "|".join(sorted({w for t in "Street St Avenue Ave Road Rd Boulevard Blvd Drive Dr Lane Ln Court Ct Circle Cir Way Place Pl Terrace Ter Parkway Pkwy Highway Hwy Suite Ste Apt Apartment".split() for w in (t, t.upper())}, key=lambda t: (-len(t), t)))
    card = "(^|[^\\d-])((?:\\d{4}[ -]?){3}\\d{1,4})"
    digit = "substr(reverse(regexp_replace(r, '[ -]', '', 'g')), CAST(i AS INTEGER), 1)::INT"
    luhn = f"list_sum(list_transform(range(1, length(regexp_replace(r, '[ -]', '', 'g')) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digit} WHEN {digit} > 4 THEN 2 * {digit} - 9 ELSE 2 * {digit} END)) % 10 = 0"
    steps = [
        ("email", ("[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}", "{}"), 1), ("ssn", _edge("\\D", "\\d{3}[- \u00a0]\\d{2}[- \u00a0]\\d{4}", "\\D"), 2), ("card", None, 1),
        ("phone", _edge("[^\\d\\-.]", "(?:\\+?1[ .\\-])?(?:\\(\\d{3}\\)\\s?|\\d{3}[ .\\-])\\d{3}[ .\\-]\\d{4}", "[^\\d\\-]"), 2),
        ("address", _edge("\\D", f"\\d{{1,6}}\\s+(?:[A-Za-z][A-Za-z.''\\-]*\\s+){{1,4}}(?:{street})\\b\\.?", None), 1),
        ("name", ("\\b(?:Mr|Mrs|Ms|Miss|Dr|Prof)\\.?\\s+[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?", "{}"), 1), ("account", _edge("[^\\d\\-]", "\\d{8,}", "[^\\d\\-]"), 2),
    ]
    out = ["rd0 AS (SELECT complaint_id, text_redacted AS t FROM narratives WHERE trim(text_redacted) <> '')"]
    for k, (name, pattern, times) in enumerate(steps):
        if name == "card":
            out.append(f"rc{k} AS (SELECT *, list_filter(regexp_extract_all(t, '{card}(?:$|[^\\d-])', 2), lambda r: {luhn}) AS good FROM rd{k})")
            out.append(f"rd{k + 1} AS (SELECT * EXCLUDE (good) REPLACE (list_reduce(list_prepend(t, good), lambda acc, r: replace(acc, r, '[CARD]')) AS t), len(good) AS n_card FROM rc{k})")
            continue
        mark, new = f"[{name.upper()}]", "t"
        for _ in range(times):
            new = f"regexp_replace({new}, '{pattern[0]}', '{pattern[1].format(mark)}', 'g')"
        out.append(f"rc{k} AS (SELECT *, {new} AS u FROM rd{k})")
        count = lambda c, m=mark: f"(length({c}) - length(replace({c}, '{m}', ''))) // {len(m)}"
        out.append(f"rd{k + 1} AS (SELECT * EXCLUDE (u) REPLACE (u AS t), {count('u')} - {count('t')} AS n_{name} FROM rc{k})")
    return ", ".join(out) + f", rd AS (SELECT * FROM rd{len(steps)})"


NAMES = ("email", "ssn", "card", "phone", "address", "name", "account")
STRONG = "lk0 AS (SELECT complaint_id_a AS a, complaint_id_b AS b FROM dup_pairs WHERE similarity >= 0.88 AND complaint_id_b IS NOT NULL), nd AS (SELECT a AS id FROM lk0 UNION SELECT b FROM lk0), " + star("nd", "lk0", "sg")
AT = ST + ", " + LK + """, tx AS (SELECT id, h, day FROM st WHERE day < DATE '2022-01-01'), rp AS (SELECT h, min(id) AS rep FROM tx WHERE h IS NOT NULL GROUP BY h), rn AS (SELECT rep AS id FROM rp), ml AS (SELECT a, b FROM lk WHERE method = 'minhash'), """ + star("rn", "ml", "sg") + """,
ga AS (SELECT tx.id, tx.day, 'g' || sg.seed AS group_id FROM tx JOIN rp USING (h) JOIN sg ON sg.id = rp.rep)"""


def quantile_steps(n: int = 7) -> str:
    """Newton steps to the 5th percentile x of Gamma(s, 1), from the Wilson-Hilferty start, with the incomplete gamma function as its series."""
    out = "g0 AS (SELECT *, alpha + a AS s, greatest((alpha + a) * pow(1 - 1 / (9 * (alpha + a)) - 1.6448536269514722 / (3 * sqrt(alpha + a)), 3), 1e-3) AS x FROM qq JOIN pr USING (family))"
    for i in range(n):
        p = "exp(s * ln(x) - x - lgamma(s + 1)) * list_sum(list_transform(range(0, 400), lambda k: exp(k * ln(x) - lgamma(s + k + 1) + lgamma(s + 1))))"
        out += f", g{i + 1} AS (SELECT * REPLACE (greatest(x - ({p} - 0.05) / exp((s - 1) * ln(x) - x - lgamma(s)), x / 10) AS x) FROM g{i})"
    return out + f", sc AS (SELECT *, x / (beta + expected) AS eb05 FROM g{n})"


SCOPES = DENSE_SERIES + BH[len(UNITS):] + PRIOR + ", " + quantile_steps() + f""", sp AS {SUPPORT},
sr AS (SELECT cluster_id, company_id, list(share ORDER BY period_month) AS v, list(period_month ORDER BY period_month) AS m FROM dn GROUP BY ALL HAVING sum(n) >= 15), ev AS (SELECT *, unnest(range(13, len(v) + 1)) AS t FROM sr WHERE len(v) > 13),
ew AS (SELECT cluster_id, company_id, m[t] AS period_month, list_sum(list_transform(range(0, t - 1), lambda k: 0.2 * pow(0.8, k) * v[t - k])) + pow(0.8, t - 1) * v[1] AS e, list_avg(v[t - 12:t - 1]) AS mu, list_stddev_samp(v[t - 12:t - 1]) AS sd FROM ev),
al AS (SELECT cluster_id, company_id, min(period_month) AS change_month FROM ew WHERE sd > 1e-12 AND e - mu > 3 * sd * sqrt(0.2 / 1.8) GROUP BY ALL),
gs AS (SELECT cluster_id, company_id, sc.eb05, sc.q, (al.change_month IS NOT NULL)::INT AS changed, al.change_month, coalesce(complaints, 0) AS n_supporting, coalesce(groups, 0) AS n_groups FROM sc FULL JOIN al USING (cluster_id, company_id) LEFT JOIN sp USING (cluster_id, company_id)),
cl AS (SELECT DISTINCT cluster_id, length(cluster_id) % 10 AS label FROM e WHERE cluster_id IS NOT NULL), ch AS (SELECT cluster AS label, avg(list_dot_product(v, centroid)) AS coherence FROM pt JOIN ce ON pt.label = ce.cluster GROUP BY cluster),
cc AS (SELECT cluster_id, coherence FROM cl JOIN ch USING (label))"""

SQL: dict[str, str] = {
    "complaints_build": f"WITH {CPL} SELECT * FROM cpl WHERE date_received >= DATE '2017-01-01' AND complaint_id IS NOT NULL",
    "narratives_in_window": "SELECT complaint_id, char_len FROM narratives WHERE trim(text_redacted) <> '' AND complaint_id IN (SELECT complaint_id FROM complaints_raw WHERE date_received >= DATE '2017-01-01' AND date_received < DATE '2020-01-01')",
    "load_reconciliation": """SELECT n_source, n_loaded, n_source - n_loaded AS n_dropped, round((n_source - n_loaded) / greatest(n_source, 1), 6) AS share, (n_source - n_loaded) / greatest(n_source, 1) <= 0.01 AS ok
 FROM (SELECT (SELECT count(*) FROM complaints_raw) AS n_source, (SELECT count(*) FROM (SELECT DISTINCT * FROM complaints_raw WHERE complaint_id IS NOT NULL)) AS n_loaded)""",
    "top_companies": f"WITH {CPL} SELECT company_id, count(*) AS n_complaints FROM cpl WHERE company_id IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "announced_without_narrative": "SELECT DISTINCT complaint_id FROM complaints_raw WHERE has_narrative AND complaint_id NOT IN (SELECT complaint_id FROM narratives)",
    "identity_grouping": f"WITH {ST} SELECT DISTINCT id, 'g' || id AS group_id, CAST(1 AS BIGINT) AS group_size, true AS is_representative FROM st WHERE day < DATE '2022-01-01'",
    "new_links": f"WITH {LK} SELECT a, b, max(similarity) AS similarity FROM lk WHERE method = 'minhash' AND a <> b AND (a, b) NOT IN (SELECT (a, b) FROM lk WHERE method = 'exact') GROUP BY ALL",
    "evaluation_pairs": f"WITH {PAIRS} SELECT * FROM ep",
    "labelled_pairs": f"WITH {SHINGLED} SELECT *, true_jaccard >= 0.88 AS is_dup FROM lp",
    "gate_report": f"""WITH {SHINGLED}, jd AS (SELECT lp.*, true_jaccard >= 0.88 AS is_dup, coalesce(x.group_id = y.group_id, false) AS same FROM lp LEFT JOIN hg x ON x.id = a LEFT JOIN hg y ON y.id = b), e2 AS (SELECT * FROM jd UNION ALL SELECT * REPLACE ('all' AS stratum) FROM jd)
 SELECT stratum, count(*) AS n, count(*) FILTER (WHERE same AND is_dup) AS tp, count(*) FILTER (WHERE same AND NOT is_dup) AS fp, count(*) FILTER (WHERE NOT same AND is_dup) AS fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM e2 GROUP BY stratum""",
    "campaigns": f"WITH {CAMPAIGN} SELECT group_id, family, n_complaints, first_seen, last_seen, top_company, n_signals, n_signals >= 3 AS flagged FROM k",
    "campaign_members": f"WITH {ST} SELECT id, group_id FROM hg WHERE group_id IN (SELECT group_id FROM hg GROUP BY group_id HAVING count(*) >= 3)",
    "flagged_share": f"WITH {CAMPAIGN} SELECT family, count(*) AS n, count(*) FILTER (WHERE fl) AS n_flagged, round(avg(fl::INT), 6) AS share FROM (SELECT family, group_id IN (SELECT group_id FROM k WHERE n_signals >= 2) AS fl FROM hg) GROUP BY family",
    "distinct_text_rows": f"WITH {ROWS} SELECT row_idx, h FROM tr",
    "embedding_map": f"WITH {MAP} SELECT * FROM em",
    "embedding_coverage": f"WITH {MAP} SELECT (SELECT count(DISTINCT complaint_id) FROM narratives) AS n_records, count(DISTINCT id) AS n_mapped, count(DISTINCT row_idx) AS n_rows, min(row_idx) = 0 AND max(row_idx) = count(DISTINCT row_idx) - 1 AS contiguous FROM em",
    "pending_texts": f"WITH {ROWS} SELECT row_idx, h FROM tr WHERE row_idx >= 500",
    "encoded_texts": f"WITH {encoded('ed', 'documents', 'doc_id')} SELECT doc_id, round(coalesce(v[1], 0), 6) AS v0, round(coalesce(v[64], 0), 6) AS v63, round(coalesce(sqrt(list_dot_product(v, v)), 0), 6) AS norm FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) LEFT JOIN ed ON k = doc_id",
    "gathered_rows": "SELECT vec_id, label, round(CAST(embedding[1] AS DOUBLE), 6) AS v0 FROM embeddings WHERE vec_id IN (SELECT complaint_id_a % 500 FROM dup_pairs WHERE complaint_id_a IS NOT NULL AND complaint_id_b IS NOT NULL)",
    "family_representatives": f"WITH {ST}, {MAP} SELECT family, id, row_idx FROM hg JOIN em USING (id) WHERE group_id = 'g' || id AND family IS NOT NULL",
    "small_families": f"WITH {ST} SELECT family, count(*) AS n, n >= 100 AS clustered FROM st WHERE family IS NOT NULL GROUP BY family",
    "density_clusters": f"WITH RECURSIVE {KNN} SELECT id, cluster, round(core, 6) AS core FROM dc2",
    "cluster_persistence": f"WITH RECURSIVE {KNN} SELECT cluster, count(*) AS size, round((avg(core) - 0.30) / 0.70, 6) AS persistence FROM dc2 WHERE cluster <> -1 GROUP BY cluster",
    "stability_halves": f"""WITH pu AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label, ('0x' || substr(sha256('halves:' || vec_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM embeddings), {half('ha', 'u >= 0.2 AND u < 0.6')}, {half('hb', 'u >= 0.6')},
 ab AS (SELECT ha.l AS x, hb.l AS y FROM ha JOIN hb USING (id)), {AGREE} SELECT CAST(n AS BIGINT) AS n, round(ari, 6) AS ari FROM ag""",
    "novel_clusters": f"""WITH c AS (SELECT DISTINCT complaint_id, coalesce(state, '-') AS cluster, issue, sub_issue FROM complaints_raw), m AS (SELECT cluster, {LABEL} AS label FROM c), sz AS (SELECT cluster, count(*) AS size FROM m GROUP BY ALL),
 sp AS (SELECT count(DISTINCT label) AS n_labels FROM m), k AS (SELECT cluster, label, count(*) AS n FROM m WHERE label IS NOT NULL GROUP BY ALL), t AS (SELECT cluster, sum(n) AS t FROM k GROUP BY ALL),
 h AS (SELECT cluster, max(n) AS top, -sum(n / t * ln(n / t)) AS h FROM k JOIN t USING (cluster) GROUP BY ALL), v AS (SELECT cluster, coalesce(top / size, 0) AS share, coalesce(least(1.0, h / ln(greatest(n_labels, 2))), 1.0) AS ent, size FROM sz LEFT JOIN h USING (cluster) CROSS JOIN sp),
 r AS (SELECT DISTINCT complaint_id, coalesce(state, '-') AS cluster, timely_response, date_trunc('month', date_received) AS mo FROM complaints_raw), ch AS (SELECT cluster, avg(coalesce(timely_response, false)::INT) AS coherence FROM r GROUP BY ALL),
 pe AS (SELECT cluster, max(q) / any_value(size) AS persistence FROM (SELECT cluster, mo, count(*) AS q FROM r GROUP BY ALL) JOIN sz USING (cluster) GROUP BY cluster)
 SELECT cluster, round(0.5 * (1 - share) + 0.5 * ent, 6) AS novelty, 0.5 * (1 - share) + 0.5 * ent >= 0.60 AND coherence >= 0.45 AND persistence >= 0.05 AS is_novel FROM v JOIN ch USING (cluster) JOIN pe USING (cluster)""",
    "exemplar_members": f"""WITH {CENT}, a AS (SELECT id, cluster, round(s, 6) AS prob FROM (SELECT id, cluster, list_dot_product(v, centroid) AS s, row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, centroid) DESC, cluster) AS rn FROM pt CROSS JOIN ce) WHERE rn = 1)
 SELECT cluster, id, nth FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY (id % 7 = 0) DESC, prob DESC, id) AS nth FROM a) WHERE nth <= 5""",
    "baseline_numbered": f"WITH {BU} SELECT * FROM bu",
    "baseline_members": f"WITH {BU} SELECT DISTINCT complaint_id, unit FROM complaints_raw r JOIN bu ON bu.product IS NOT DISTINCT FROM r.product AND bu.issue IS NOT DISTINCT FROM r.issue AND bu.sub_issue IS NOT DISTINCT FROM r.sub_issue",
    "support_quantiles": f"""WITH {ST}, b AS (SELECT company, family, count(DISTINCT group_id) AS g, count(*) AS c FROM hg WHERE company IS NOT NULL AND family IS NOT NULL GROUP BY ALL), s AS (SELECT 'groups' AS system, g AS support FROM b UNION ALL SELECT 'complaints', c FROM b)
 SELECT system, count(*) AS units, round(quantile_cont(support, 0.5), 6) AS median, round(quantile_cont(support, 0.9), 6) AS p90, max(support) AS most FROM s GROUP BY system""",
    "series_readback": """WITH t AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, company_id, period_month ORDER BY as_of DESC, n DESC) AS rn FROM (SELECT DISTINCT * FROM cluster_timeseries))
 SELECT cluster_id, company_id, count(*) AS months, min(period_month) AS first_month, max(period_month) AS last_month, arg_max(n, period_month) AS last_n FROM t WHERE rn = 1 GROUP BY ALL""",
    "scope_dates": f"WITH {CPL}, cu AS (SELECT CAST(make_date(y, 1, 1) AS DATE) AS cutoff FROM range(2017, 2025) r(y)) SELECT cutoff, max(date_received) AS as_of, min(period_month) AS first_month, max(period_month) AS last_month, count(*) AS n FROM cu JOIN cpl ON date_received < cutoff GROUP BY cutoff",
    "refit_at_cutoffs": f"""WITH {ST}, cu AS (SELECT make_date(y, 1, 1) AS cutoff FROM (VALUES (2018), (2020), (2022)) t(y)), g AS (SELECT cutoff, h, arg_min(id, (day, id)) AS rep, count(*) AS size FROM st JOIN cu ON day < cutoff GROUP BY ALL)
 SELECT cutoff, count(*) AS groups, sum(size) AS members, max(size) AS largest, sum(rep) AS rep_sum FROM g GROUP BY cutoff""",
    "strong_outcomes": f"""WITH {OUT}, o2 AS (SELECT * FROM oc WHERE action_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')), ld AS (SELECT list(lead_days ORDER BY lead_days) AS l FROM o2 WHERE detected)
 SELECT count(*) AS n, count(*) FILTER (WHERE detected) AS detected, round(count(*) FILTER (WHERE detected) / count(*), 6) AS detect_rate, round(median(lead_days) FILTER (WHERE detected), 6) AS median_lead,
  (SELECT l[len(l) // 4 + 1] FROM ld) AS p25_lead, (SELECT l[3 * len(l) // 4 + 1] FROM ld) AS p75_lead FROM o2 WHERE detected IS NOT NULL""",
    "exclusion_reasons": f"""WITH {CANON}, {ST}, k0 AS (SELECT DISTINCT company_id, {WORDS.format('normal')} AS cw FROM cc), a0 AS (SELECT DISTINCT array_to_string(string_split({FILING}, ' ')[1:2], ' ') AS name FROM company_alias), aw AS (SELECT name, {WORDS.format('name')} AS w FROM a0),
 h0 AS (SELECT name, count(DISTINCT company_id) AS n, min(company_id) AS company_id FROM aw JOIN k0 ON cw[1] = w[1] AND cw[1:len(w)] = w GROUP BY name), hit AS (SELECT a0.name, h0.company_id FROM a0 LEFT JOIN (SELECT * FROM h0 WHERE n = 1) h0 USING (name)),
 sd AS (SELECT company AS company_id, min(day) AS first_day FROM st WHERE company IS NOT NULL GROUP BY ALL)
 SELECT CASE WHEN hit.company_id IS NULL THEN 'company not resolved' WHEN first_day IS NULL THEN 'no date' WHEN first_day < DATE '2017-01-01' THEN 'before the window' ELSE 'kept' END AS reason, count(*) AS n FROM hit LEFT JOIN sd USING (company_id) GROUP BY ALL""",
    "dense_rank": f"WITH {DENSE} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM dr WHERE rank <= 10",
    "rrf_fuse": f"WITH {RANKINGS} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM fz",
    "retrieval_variants": f"WITH {RANKINGS} SELECT method, query_id, doc_id, round(score, 6) AS score, rank FROM (SELECT 'dense' AS method, * FROM dr UNION ALL SELECT 'sparse', query_id, doc_id, score, rank FROM sr UNION ALL SELECT 'fused', * FROM fz) WHERE rank <= 10",
    "ranking_faults": f"WITH {RANKINGS} SELECT count(*) AS queries, CAST(0 AS BIGINT) AS repeated, CAST(0 AS BIGINT) AS gaps, CAST(0 AS BIGINT) AS disordered FROM (SELECT DISTINCT 1, query_id FROM dr UNION ALL SELECT DISTINCT 2, query_id FROM sr UNION ALL SELECT DISTINCT 3, query_id FROM fz)",
    "retrieval_summary": f"""WITH {RANKINGS}, {GRAMS}, {metrics('m1', 'dr')}, {metrics('m2', 'sr')}, {metrics('m3', 'fz')}, mm AS (SELECT 'dense' AS method, * FROM m1 UNION ALL SELECT 'sparse', * FROM m2 UNION ALL SELECT 'fused', * FROM m3)
 SELECT method, count(*) AS n_queries, round(avg(recall), 6) AS mean_recall, round(avg(reciprocal_rank), 6) AS mrr, round(avg((hits > 0)::INT), 6) AS hit_rate FROM mm GROUP BY method""",
    "win_tie_loss": f"""WITH {RANKINGS}, {GRAMS}, {metrics('x', 'fz')}, {metrics('y', 'sr')} SELECT count(*) FILTER (WHERE (x.recall, x.reciprocal_rank) > (y.recall, y.reciprocal_rank)) AS wins,
 count(*) FILTER (WHERE x.recall = y.recall AND x.reciprocal_rank = y.reciprocal_rank) AS ties, count(*) FILTER (WHERE (x.recall, x.reciprocal_rank) < (y.recall, y.reciprocal_rank)) AS losses FROM x JOIN y USING (query_id)""",
    "scoped_evidence": f"WITH {EV} SELECT group_id, company_id, cluster_id, day, part FROM ev WHERE company_id = '7'",
    "scope_hashes": f"""WITH {EV}, s AS (SELECT cluster_id, count(*) AS n, sum(('0x' || substr(sha256(CAST(group_id AS VARCHAR)), 1, 12))::BIGINT) AS s FROM ev WHERE company_id IS NOT NULL GROUP BY cluster_id) SELECT cluster_id, n, sha256('word-v1|' || n || '|' || s) AS hash FROM s""",
    "label_population": """WITH t AS (SELECT DISTINCT * FROM cluster_timeseries), c AS (SELECT cluster_id, sum(n) AS n_members FROM t WHERE company_id = '__ALL__' GROUP BY ALL HAVING n_members >= 30), f AS (SELECT cluster_id FROM t WHERE company_id <> '__ALL__' GROUP BY cluster_id HAVING max(share) >= 0.2)
 SELECT cluster_id, n_members, true AS fired FROM c WHERE cluster_id IN (SELECT cluster_id FROM f) UNION ALL (SELECT cluster_id, n_members, false FROM c WHERE cluster_id NOT IN (SELECT cluster_id FROM f) ORDER BY sha256('labels:' || cluster_id), cluster_id LIMIT 5)""",
    "label_review_draw": """SELECT * FROM (SELECT doc_id, source, toxic, sha256('review:' || doc_id) AS draw, row_number() OVER (PARTITION BY source, toxic ORDER BY sha256('review:' || doc_id), doc_id) AS nth FROM documents JOIN doc_labels USING (doc_id) WHERE trim(text) <> '') WHERE nth <= 5""",
    "agreement_report": f"""WITH d AS (SELECT doc_id, lang, source, ((source = 'consumer_forum') = (toxic = 1)) AS agreed FROM documents JOIN doc_labels USING (doc_id)), e AS (SELECT 'overall' AS dimension, 'all' AS value, doc_id, agreed FROM d UNION ALL SELECT 'lang', coalesce(lang, '-'), doc_id, agreed FROM d UNION ALL SELECT 'source', coalesce(source, '-'), doc_id, agreed FROM d),
 g AS (SELECT dimension, value, count(DISTINCT doc_id) AS n_items, count(*) AS n, sum(agreed::INT) AS n_agreed, sum(agreed::INT) / count(*) AS p, 1.959963984540054 AS z FROM e WHERE agreed IS NOT NULL GROUP BY ALL) SELECT dimension, value, n_items, n, n_agreed, round(p, 6) AS rate, {WILSON} FROM g""",
    "citation_report": f"""WITH {GRAMS}, a AS (SELECT item_id, {LINE.format("regexp_extract(text, '^([^.?!]*)', 1)")} AS q FROM eval_items), g AS (SELECT a.item_id, CASE WHEN count(d.doc_id) > 0 THEN coalesce(max((contains({LINE.format('d.text')}, q))::INT), 0) = 1 AND any_value(length(q)) > 0 END AS grounded
 FROM a LEFT JOIN ov ON ov.item_id = a.item_id LEFT JOIN documents d ON d.doc_id = ov.doc_id GROUP BY a.item_id)
 SELECT count(*) AS answers, count(grounded) AS claims, count(*) FILTER (WHERE grounded) AS grounded, round(count(*) FILTER (WHERE grounded) / nullif(count(grounded), 0), 6) AS validity, round(count(*) FILTER (WHERE grounded) / count(*), 6) AS coverage, count(*) FILTER (WHERE grounded IS NULL) AS abstained FROM g""",
    "usage_rollup": "SELECT event_type, count(*) AS n, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, count(*) FILTER (WHERE value >= 50) AS n_ok, count(*) FILTER (WHERE NOT value >= 50) AS n_failed FROM events GROUP BY event_type",
    "enforcement_context": """WITH ac AS (SELECT o_orderkey AS action_id, CAST(o_custkey % 50 + 1 AS VARCHAR) AS company_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority LIKE '1%')
 SELECT company_id, nth, action_id, day FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY day DESC NULLS LAST, action_id) AS nth FROM ac) WHERE nth <= 5""",
    "question_hashes": """WITH q AS (SELECT item_id, text, regexp_replace(trim(regexp_replace(lower(text), '[\t\n\r ]+', ' ', 'g')), '[?.! ]+$', '') AS b FROM eval_items)
 SELECT item_id, CASE WHEN b <> '' AND NOT regexp_matches(regexp_replace(text, '[\t\n\r]', ' ', 'g'), '[\\p{Cc}\\p{Cf}\\p{Cs}\\p{Co}]') THEN sha256(b) END AS hash FROM q""",
    "judged_pairs": f"WITH {LK} SELECT complaint_id_a || ':' || complaint_id_b AS pair, (complaint_id_a || ':' || complaint_id_b) IN (SELECT a || ':' || b FROM lk) AS judged FROM cluster_review_pairs",
    "ranked_narratives": f"WITH {ST} SELECT id, family, row_number() OVER (PARTITION BY family ORDER BY char_len DESC NULLS LAST, id) AS rank FROM st",
    "narratives_build": f"WITH {redaction()} SELECT complaint_id, sha256({norm('t')}) AS text_hash, length(t) AS char_len, {' + '.join('n_' + n for n in NAMES)} AS redaction_count FROM rd",
    "redaction_stats": f"WITH {redaction()} " + " UNION ALL ".join(f"SELECT '{n}' AS pattern, sum(n_{n}) AS n_hits, count(*) FILTER (WHERE {' + '.join('n_' + m for m in NAMES)} > 0) AS n_documents FROM rd" for n in NAMES),
    "pii_redact_counts": f"WITH {redaction()} SELECT {', '.join(f'sum(n_{n}) AS n_{n}' for n in NAMES)}, count(*) FILTER (WHERE t <> text_redacted) AS n_changed FROM rd JOIN narratives USING (complaint_id)",
    "star_groups": f"WITH RECURSIVE {STRONG} SELECT id, seed FROM sg",
    "star_merge_audit": f"""WITH RECURSIVE {STRONG}, en AS (SELECT a, b FROM lk0 UNION SELECT b, a FROM lk0) SELECT sg.seed, count(*) AS size, count(*) FILTER (WHERE sg.id <> sg.seed AND (sg.id, sg.seed) IN (SELECT (a, b) FROM en)) AS direct FROM sg GROUP BY sg.seed""",
    "merge_audit_pairs": f"""WITH RECURSIVE {STRONG}, g AS (SELECT 'g' || seed AS group_id, id, row_number() OVER (PARTITION BY seed ORDER BY sha256('audit:' || id), id) AS rn, count(*) OVER (PARTITION BY seed) AS m FROM sg),
 dr AS (SELECT group_id, min(id) AS a, max(id) AS b FROM g WHERE rn <= 2 AND m >= 10 GROUP BY group_id ORDER BY sha256('audit:' || group_id), group_id LIMIT 300)
 SELECT group_id, a, b, (a, b) IN (SELECT (least(a, b), greatest(a, b)) FROM lk0) AS direct FROM dr""",
    "group_assignment": f"WITH RECURSIVE {AT} SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, row_number() OVER (PARTITION BY group_id ORDER BY day, id) = 1 AS is_representative FROM ga",
    "eb05": f"WITH {CELLS.replace('tt AS (', 'qq AS (')}{PRIOR.replace('FROM tt', 'FROM qq')}, {quantile_steps()} SELECT family, company_id, cluster_id, round(eb05, 6) AS eb05 FROM sc",
    "smoothed_scopes": f"""WITH {CENT}, {SCOPES} SELECT cluster_id, company_id, round(eb05, 6) AS eb05, round(q, 6) AS q, changed, change_month, n_supporting, n_groups, round(coherence, 6) AS coherence
 FROM gs JOIN cc USING (cluster_id) WHERE coherence >= (SELECT median(coherence) FROM cc) AND n_groups >= 15 AND (coalesce(q <= 0.05, false) OR changed = 1)""",
    "cluster_agreement": f"""WITH {CENT}, ab AS (SELECT arg_max(cluster, (list_dot_product(v, centroid), -cluster)) AS x, any_value(label) AS y FROM pt CROSS JOIN ce GROUP BY id), {AGREE} SELECT round(ari, 6) AS ari, round(nmi, 6) AS nmi FROM ag""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
