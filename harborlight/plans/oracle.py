"""DuckDB SQL equal to the queries of plans/queries.py; what SQL can't express over whole tables has none."""

from __future__ import annotations

CUTS = ", ".join(f"DATE '{y}-01-01'" for y in range(1996, 2002))
ENDS = "NATIONAL ASSOCIATION|INCORPORATED|CORPORATION|COMPANY|LIMITED|HOLDINGS|INC|LLC|LLP|PLC|LTD|CORP|LP|NA|SA|CO|FSB"
MARKERS = (
    "(?i)(15\\s*u\\.?\\s*s\\.?\\s*c|15\\s*u\\.?s\\.?\\s*code|\\b1681[a-z]?\\b|\\b1692[a-z]?\\b|\\bsection\\s*6(0[49]|1[1-3]|23)\\b|fair\\s+credit\\s+reporting\\s+act|\\bfcra\\b|\\bfdcpa\\b|federally\\s+protected\\s+consumer\\s+rights"
    "|willful\\s+non[- ]?compliance|estoppel\\s+by\\s+silence|under\\s+penalty\\s+of\\s+perjury|permissible\\s+purpose|validation\\s+of\\s+(the\\s+)?debt|cease\\s+and\\s+desist|metro\\s*2\\b|e[-\\s]?oscar)"
)
#: Letters whose upper case is more than one letter.
UPPER = "upper(replace(replace(replace(replace(replace(replace(replace(replace(alias_raw, 'ﬀ', 'FF'), 'ﬁ', 'FI'), 'ﬂ', 'FL'), 'ﬃ', 'FFI'), 'ﬄ', 'FFL'), 'ﬅ', 'ST'), 'ﬆ', 'ST'), 'ß', 'SS'))"


def norm(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}_\\s]', '', 'g'), '\\p{{Nd}}+', '#', 'g'), '\\s+', ' ', 'g'))"


def toks(c: str) -> str:
    return f"regexp_extract_all(lower({c}), '[a-z0-9]+(?:[-''][a-z0-9]+)*')"


UNITS = """u AS (SELECT l_orderkey AS group_id, CAST(l_suppkey AS VARCHAR) AS company_id, o_orderpriority AS family, p_type AS cluster, CAST(l_shipdate AS DATE) AS day,
  CAST(date_trunc('month', l_shipdate) AS DATE) AS period_month, l_linenumber AS line, l_partkey AS part
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
rep AS (SELECT group_id, cluster AS c, family AS cluster_family FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY day, line, part, company_id) AS rn FROM u) WHERE rn = 1),
e AS (SELECT u.*, rep.cluster_family || ':' || rep.c AS cluster_id, rep.cluster_family FROM u JOIN rep USING (group_id))"""
PANEL = UNITS + """,
own AS (SELECT * FROM e WHERE family = cluster_family),
da AS (SELECT family, period_month, count(DISTINCT group_id) AS denom FROM e GROUP BY ALL),
dc AS (SELECT family, company_id, period_month, count(DISTINCT group_id) AS denom FROM e GROUP BY ALL),
pn AS (SELECT cluster_id, '__ALL__' AS company_id, period_month, n, denom FROM (SELECT cluster_id, family, period_month, count(DISTINCT group_id) AS n FROM own GROUP BY ALL) JOIN da USING (family, period_month)
 UNION ALL SELECT cluster_id, company_id, period_month, n, denom FROM (SELECT cluster_id, family, company_id, period_month, count(DISTINCT group_id) AS n FROM own GROUP BY ALL) JOIN dc USING (family, company_id, period_month))"""
CELLS = UNITS + """,
un AS (SELECT DISTINCT family, group_id, company_id, CASE WHEN family = cluster_family THEN cluster_id END AS cluster_id FROM e),
x AS (SELECT family, company_id, cluster_id, count(*) AS a FROM un WHERE cluster_id IS NOT NULL GROUP BY ALL),
cell AS (SELECT x.family, x.company_id, x.cluster_id, a, nc - a AS b, nk - a AS c, nf - nc - nk + a AS d FROM x
 JOIN (SELECT family, company_id, count(*) AS nc FROM un GROUP BY ALL) USING (family, company_id)
 JOIN (SELECT family, cluster_id, count(*) AS nk FROM un WHERE cluster_id IS NOT NULL GROUP BY ALL) USING (family, cluster_id)
 JOIN (SELECT family, count(*) AS nf FROM un GROUP BY ALL) USING (family)),
t0 AS (SELECT *, (CAST(a AS DOUBLE) / (a + b)) / (CAST(c AS DOUBLE) / (c + d)) AS prr, sqrt(greatest(1.0/a - 1.0/(a+b) + 1.0/c - 1.0/(c+d), 1e-12)) AS se,
  (CAST(a AS DOUBLE) / b) / (CAST(c AS DOUBLE) / d) AS ror, (CAST(a + b AS DOUBLE)) * (a + c) / (a + b + c + d) AS expected FROM cell WHERE a >= 5 AND least(b, c, d) > 0),
t1 AS (SELECT *, abs(ln(ror)) / sqrt(1.0/a + 1.0/b + 1.0/c + 1.0/d) AS z FROM t0),
t2 AS (SELECT *, z / sqrt(2) AS xx FROM t1),
tt AS (SELECT *, CASE WHEN xx < 2 THEN 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 60), lambda k: (CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * pow(xx, 2 * k + 1) / (gamma(k + 1.0) * (2 * k + 1))))
  ELSE exp(-xx * xx) / sqrt(pi()) / list_reduce(list_concat([xx + 30.0 / xx], list_transform(list_reverse(range(1, 60)), lambda k: k / 2.0)), lambda acc, h: xx + h / acc) END AS p FROM t2)"""
BH = CELLS + """,
r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, company_id, cluster_id) AS rk, count(*) OVER (PARTITION BY family) AS m FROM tt),
qq AS (SELECT *, greatest(0.0, least(1.0, min(p * m / rk) OVER (PARTITION BY family ORDER BY rk DESC ROWS UNBOUNDED PRECEDING))) AS q FROM r)"""
PRIOR = """,
mv AS (SELECT family, avg(a / expected) AS m, var_pop(a / expected) AS v FROM tt GROUP BY family),
pr AS (SELECT family, CASE WHEN v <= 1e-12 OR m <= 1e-12 THEN 1.0 ELSE greatest(0.05, least(100.0, m / v * m)) END AS alpha, CASE WHEN v <= 1e-12 OR m <= 1e-12 THEN 1.0 ELSE greatest(0.05, least(100.0, m / v)) END AS beta FROM mv)"""
SUPPORT = """(SELECT cluster_id, company_id, count(DISTINCT group_id) AS groups, count(*) AS complaints FROM e GROUP BY ALL
 UNION ALL SELECT cluster_id, '__ALL__', count(DISTINCT group_id), count(*) FROM e GROUP BY cluster_id)"""
DENSE = PANEL + """,
g AS (SELECT cluster_id, company_id, CAST(unnest(generate_series((SELECT min(period_month) FROM pn), (SELECT max(period_month) FROM pn), INTERVAL 1 MONTH)) AS DATE) AS period_month FROM (SELECT DISTINCT cluster_id, company_id FROM pn)),
dn AS (SELECT cluster_id, company_id, period_month, coalesce(n, 0) AS n, coalesce(n / denom, 0.0) AS share FROM g LEFT JOIN pn USING (cluster_id, company_id, period_month))"""
MEMBERS = """mem AS (SELECT coalesce(issue, '-') || '|' || strftime(date_received, '%Y-%m') AS group_id, n.complaint_id AS id, date_received AS day, product AS family, state, company_raw AS company, char_len, text_redacted AS text
 FROM narratives n JOIN (SELECT DISTINCT complaint_id, product, issue, date_received, state, company_raw FROM complaints_raw) c USING (complaint_id))"""
MEMBERS_COALESCED = MEMBERS.replace("product AS family", "coalesce(product, '-') AS family")


def hhi(group: str, value: str, name: str, source: str = "mem") -> str:
    return f"(SELECT {group}, sum(CAST(n AS DOUBLE) * n) / (sum(n) * sum(n)) AS {name} FROM (SELECT {group}, {value}, count(*) AS n FROM {source} GROUP BY ALL) GROUP BY {group})"


FEATURES = MEMBERS + f""",
f AS (SELECT * FROM (SELECT group_id, count(*) AS n_complaints, stddev_pop(char_len) / avg(char_len) AS length_cv, avg(CASE WHEN regexp_matches(text, '{MARKERS}') THEN 1.0 ELSE 0.0 END) AS boilerplate FROM mem GROUP BY group_id)
 JOIN (SELECT group_id, var_pop(n) / avg(n) AS burstiness FROM (SELECT group_id, day, count(*) AS n FROM mem GROUP BY ALL) GROUP BY group_id) USING (group_id)
 JOIN {hhi('group_id', 'state', 'state_hhi')} USING (group_id) JOIN {hhi('group_id', 'company', 'company_hhi')} USING (group_id))"""
COMPANY = f"regexp_replace(trim(regexp_replace(regexp_replace(replace({UPPER}, '.', ''), '[^\\p{{L}}\\p{{N}}_]', ' ', 'g'), ' +', ' ', 'g')), '^(.+?)(?: (?:{ENDS}))+$', '\\1')"
CANON = f"""cn AS (SELECT alias_raw, {COMPANY} AS normal, company_id AS given, method FROM company_alias),
cc AS (SELECT alias_raw, normal, CASE WHEN method = 'manual' THEN given ELSE CASE WHEN s = '' THEN 'unknown' ELSE s END END AS company_id FROM (SELECT *, regexp_replace(regexp_replace(lower(normal), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM cn))"""
CROSS = """cw AS (SELECT DISTINCT complaint_id, product, sub_product,
  CASE WHEN product IN ('Consumer file bureaus', 'Consumer files, file repair or other personal dossiers', 'Consumer files or other personal dossiers') THEN 'Consumer files or other personal dossiers'
   WHEN product IN ('Deposit or branch account', 'Checking, savings or similar') THEN 'Checking, savings or similar' WHEN product IN ('Charge or revolving card', 'Revolving or stored-value card', 'Revolving card') THEN 'Revolving card'
   WHEN product IN ('Sending money', 'Sending money, digital coins or exchange') THEN 'Sending money, digital coins or exchange' WHEN product = 'Household borrowing' AND sub_product IN ('Car loan', 'Car lease') THEN 'Car loans and leases'
   WHEN product IN ('Household borrowing', 'Short cash loans', 'Short cash, title or personal loans', 'Short cash, title, personal or advance loans') THEN 'Short cash, title, personal or advance loans' ELSE product END AS product_std,
  CASE product_std WHEN 'Consumer files or other personal dossiers' THEN 'credit_reporting' WHEN 'Collecting of debts' THEN 'debt_collection' WHEN 'Home loans' THEN 'mortgage' WHEN 'Checking, savings or similar' THEN 'bank_account'
   WHEN 'Revolving card' THEN 'credit_card' WHEN 'Sending money, digital coins or exchange' THEN 'money_service' WHEN 'Study loans' THEN 'student_loan' WHEN 'Car loans and leases' THEN 'vehicle_loan'
   WHEN 'Short cash, title, personal or advance loans' THEN 'personal_loan' WHEN 'Other money matters' THEN 'other' END AS family FROM complaints_raw)"""
GRAMS = f"""dt AS (SELECT doc_id, {toks('text')} AS t FROM documents), it AS (SELECT item_id, {toks('text')} AS t FROM eval_items),
dg AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(list_transform(generate_series(1, len(t) - 7), lambda i: array_to_string(t[i:i+7], ' '))) AS g FROM dt WHERE len(t) >= 8)),
ig AS (SELECT DISTINCT item_id, g FROM (SELECT item_id, unnest(list_transform(generate_series(1, len(t) - 7), lambda i: array_to_string(t[i:i+7], ' '))) AS g FROM it WHERE len(t) >= 8)),
ov AS (SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN ig USING (g) GROUP BY ALL)"""
BM = f"""bd AS (SELECT doc_id, {toks('text')} AS t FROM documents), bl AS (SELECT doc_id, len(t) AS dl FROM bd),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM bd) GROUP BY ALL),
dfq AS (SELECT term, ln(((SELECT count(*) FROM bl) - count(*) + 0.5) / (count(*) + 0.5)) AS raw FROM tf GROUP BY term),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfq) ELSE raw END AS idf FROM dfq),
bq AS (SELECT item_id AS query_id, term, count(*) AS qn FROM (SELECT item_id, unnest({toks('text')}) AS term FROM eval_items) GROUP BY ALL),
bs AS (SELECT query_id, doc_id, round(sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM bl)))), 9) AS score FROM bq JOIN idf USING (term) JOIN tf USING (term) JOIN bl USING (doc_id) GROUP BY ALL),
br AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bs)"""


def metrics(name: str, ranking: str) -> str:
    return f"""{name} AS (SELECT rl.query_id, rl.n_relevant, coalesce(h.hits, 0) AS hits, coalesce(h.hits, 0) / rl.n_relevant AS recall, coalesce(1.0 / h.fr, 0.0) AS reciprocal_rank
 FROM (SELECT item_id AS query_id, count(*) AS n_relevant FROM ov GROUP BY ALL) rl
 LEFT JOIN (SELECT k.query_id, count(*) AS hits, min(k.rank) AS fr FROM {ranking} k JOIN ov ON ov.item_id = k.query_id AND ov.doc_id = k.doc_id WHERE k.rank <= 10 GROUP BY ALL) h USING (query_id))"""


CENT = """cx AS (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(generate_series(1, len(embedding))) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY ALL),
cm AS (SELECT label, list(m ORDER BY i) AS mm, sqrt(sum(m * m)) AS nn FROM cx GROUP BY label), ce AS (SELECT label AS cluster, list_transform(mm, lambda x: x / nn) AS centroid FROM cm),
pt AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"""
LABEL = "CASE WHEN issue IS NOT NULL THEN issue || ' | ' || coalesce(sub_issue, '∅') END"
OUT = UNITS + f""",
ac AS (SELECT o_orderkey AS action_id, CAST(o_custkey % 50 + 1 AS VARCHAR) AS company_id, CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority LIKE '1%'),
cu AS (SELECT unnest([{CUTS}]) AS cutoff), a2 AS (SELECT ac.*, (SELECT max(cutoff) FROM cu WHERE cutoff < day) AS cutoff FROM ac),
ru AS (SELECT 'run' || (row_number() OVER (ORDER BY cutoff) - 1) AS run_id, cutoff FROM cu), ru2 AS (SELECT * FROM ru WHERE run_id <> 'run2'),
sg AS (SELECT run_id, company_id, min(period_month) AS first_signal FROM (SELECT company_id, period_month, count(DISTINCT group_id) AS groups FROM u GROUP BY ALL) JOIN ru2 ON period_month < cutoff WHERE groups >= 3 GROUP BY ALL),
oc AS (SELECT action_id, run_id, CASE WHEN run_id IS NOT NULL THEN first_signal IS NOT NULL END AS detected, first_signal, CAST(day - first_signal AS INTEGER) AS lead_days FROM a2 LEFT JOIN ru2 USING (cutoff) LEFT JOIN sg USING (run_id, company_id))"""

SQL: dict[str, str] = {
    "p3_company_totals": """WITH t AS (SELECT DISTINCT * FROM cluster_timeseries)
 SELECT x.*, coalesce(alias_rows, 0) AS alias_rows, coalesce(alias_n, 0) AS alias_n FROM (SELECT company_id, count(*) AS n_rows, sum(n) AS sum_n, sum(denom) AS sum_denom, count(DISTINCT period_month) AS months FROM t GROUP BY company_id) x
 LEFT JOIN (SELECT company_id, count(*) AS alias_rows, sum(n) AS alias_n FROM t JOIN company_alias USING (company_id) GROUP BY company_id) USING (company_id)""",
    "p3_product_months": """SELECT product, CAST(date_trunc('month', date_received) AS DATE) AS month, count(*) AS complaints, count(n.complaint_id) AS narratives
 FROM (SELECT DISTINCT complaint_id, product, date_received FROM complaints_raw) c LEFT JOIN narratives n USING (complaint_id) GROUP BY ALL""",
    "p3_products": """SELECT product, count(*) AS complaints, count(n.complaint_id) AS narratives FROM (SELECT DISTINCT complaint_id, product, date_received FROM complaints_raw) c LEFT JOIN narratives n USING (complaint_id) GROUP BY ALL""",
    "load_typed_projection": """SELECT DISTINCT complaint_id, date_received, CAST(date_trunc('month', date_received) AS DATE) AS period_month, nullif(nullif(product, ''), 'None') AS product, nullif(nullif(tags, ''), 'None') AS tags, timely_response AS timely,
 coalesce(trim(sub_product) <> '', false) AS has_sub_product FROM complaints_raw WHERE complaint_id IS NOT NULL""",
    "company_canonical": f"WITH {CANON} SELECT alias_raw, normal, company_id FROM cc",
    "company_sizes": f"WITH {CANON} SELECT company_id, count(*) AS spellings, sum(n) AS complaints FROM (SELECT company_raw, count(DISTINCT complaint_id) AS n FROM complaints_raw GROUP BY ALL) JOIN cc ON company_raw = alias_raw GROUP BY ALL",
    "crosswalk_family": f"WITH {CROSS} SELECT complaint_id, product_std, family FROM cw",
    "uncovered_labels": f"WITH {CROSS} SELECT product, sub_product, count(*) AS n FROM cw WHERE family IS NULL GROUP BY ALL",
    "text_normalize_hash": f"SELECT complaint_id, sha256({norm('text_redacted')}) AS h, length({norm('text_redacted')}) AS n_chars FROM narratives",
    "markdown_strip": "SELECT doc_id, length(trim(regexp_replace(regexp_replace(text, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))) AS n_chars FROM documents",
    "window_split": "SELECT doc_id, CASE WHEN length(text) <= 2000 THEN 1 ELSE 2 END AS n_windows, least(length(text), 2000) AS first_len FROM documents",
    "privacy_ngram_overlap": f"WITH {GRAMS} SELECT * FROM ov",
    "redaction_histogram": "SELECT CASE WHEN redaction_count = 0 THEN '0' WHEN redaction_count <= 2 THEN '1-2' ELSE '3+' END AS bucket, count(*) AS n, round(avg(char_len), 6) AS avg_len FROM narratives GROUP BY ALL",
    "monthly_family_volume": "SELECT product, CAST(date_trunc('month', date_received) AS DATE) AS period_month, count(*) AS n FROM (SELECT DISTINCT complaint_id, product, date_received FROM complaints_raw) GROUP BY ALL",
    "taxonomy_vocabulary": "SELECT product, sub_product, issue, count(DISTINCT complaint_id) AS n, min(date_received) AS first_day, max(date_received) AS last_day FROM complaints_raw GROUP BY ALL",
    "product_month_gaps": """WITH c AS (SELECT DISTINCT product, CAST(date_trunc('month', date_received) AS DATE) AS period_month FROM complaints_raw WHERE product IS NOT NULL)
 SELECT * FROM (SELECT product, CAST(unnest(generate_series(min(period_month), max(period_month), INTERVAL 1 MONTH)) AS DATE) AS period_month FROM c GROUP BY product) g ANTI JOIN c USING (product, period_month)""",
    "exact_dup_pairs": "SELECT a, complaint_id AS b FROM (SELECT complaint_id, min(complaint_id) OVER (PARTITION BY text_hash) AS a FROM narratives) WHERE complaint_id > a",
    "exact_representatives": "SELECT text_hash AS h, min(complaint_id) AS id FROM narratives GROUP BY ALL",
    "dup_group_representative": """SELECT h, id FROM (SELECT text_hash AS h, complaint_id AS id, row_number() OVER (PARTITION BY text_hash ORDER BY date_received, complaint_id) AS rn FROM narratives
 JOIN (SELECT DISTINCT complaint_id, date_received FROM complaints_raw) USING (complaint_id)) WHERE rn = 1""",
    "campaign_features": f"WITH {FEATURES} SELECT group_id, n_complaints, round(length_cv, 6) AS length_cv, round(boilerplate, 6) AS boilerplate, round(burstiness, 6) AS burstiness, round(state_hhi, 6) AS state_hhi, round(company_hhi, 6) AS company_hhi FROM f",
    "family_baseline_hhi": f"WITH {MEMBERS_COALESCED} SELECT family, round(base_state, 6) AS base_state, round(base_company, 6) AS base_company FROM {hhi('family', 'state', 'base_state')} JOIN {hhi('family', 'company', 'base_company')} USING (family)",
    "expanded_population": f"WITH {UNITS} SELECT family, cluster_id, count(*) AS n_rows, count(DISTINCT group_id) AS n_groups FROM e GROUP BY ALL",
    "panel": f"WITH {PANEL} SELECT cluster_id, company_id, period_month, n, denom, round(n / denom, 6) AS share FROM pn",
    "contingency_2x2": f"WITH {CELLS} SELECT family, company_id, cluster_id, a, b, c, d FROM cell",
    "prr_ci": f"WITH {CELLS} SELECT family, company_id, cluster_id, round(prr, 6) AS prr, round(prr * exp(-1.96 * se), 6) AS prr_low, round(prr * exp(1.96 * se), 6) AS prr_high FROM tt",
    "ror_z": f"WITH {CELLS} SELECT family, company_id, cluster_id, round(ror, 6) AS ror, round(z, 6) AS z, round(p, 6) AS p FROM tt",
    "bh_qvalues": f"WITH {BH} SELECT family, company_id, cluster_id, round(q, 6) AS q FROM qq",
    "eb_prior": f"WITH {CELLS}{PRIOR} SELECT family, round(alpha, 6) AS alpha, round(beta, 6) AS beta FROM pr",
    "ebgm": f"WITH {CELLS}{PRIOR} SELECT family, company_id, cluster_id, round((alpha + a) / (beta + expected), 6) AS ebgm FROM tt JOIN pr USING (family)",
    "support_grouping_sets": f"WITH {UNITS} SELECT * FROM {SUPPORT}",
    "densified_series": f"WITH {DENSE} SELECT cluster_id, company_id, period_month, n, round(share, 6) AS share FROM dn",
    "trailing_baseline": f"""WITH {DENSE} SELECT cluster_id, company_id, period_month, round(share, 6) AS share, round(CASE WHEN count(*) OVER w = 12 THEN avg(share) OVER w END, 6) AS base_mean,
 round(CASE WHEN count(*) OVER w = 12 THEN stddev_samp(share) OVER w END, 6) AS base_sd FROM dn WINDOW w AS (PARTITION BY cluster_id, company_id ORDER BY period_month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)""",
    "ewma_alarms": f"""WITH {DENSE}, sr AS (SELECT cluster_id, company_id, list(share ORDER BY period_month) AS v, list(period_month ORDER BY period_month) AS m FROM dn GROUP BY ALL HAVING sum(n) >= 15),
 ev AS (SELECT *, unnest(range(13, len(v) + 1)) AS t FROM sr WHERE len(v) > 13),
 ew AS (SELECT cluster_id, company_id, m[t] AS period_month, t, list_sum(list_transform(range(0, t - 1), lambda k: 0.2 * pow(0.8, k) * v[t - k])) + pow(0.8, t - 1) * v[1] AS e, list_avg(v[t - 12:t - 1]) AS mu, list_stddev_samp(v[t - 12:t - 1]) AS sd FROM ev)
 SELECT cluster_id, company_id, min(period_month) AS period_month, round(arg_min((e - mu) / sd, t), 6) AS statistic FROM ew WHERE sd > 1e-12 AND e - mu > 3 * sd * sqrt(0.2 / 1.8) GROUP BY ALL""",
    "signal_support": f"""WITH {BH}, sp AS {SUPPORT} SELECT cluster_id, company_id, (SELECT max(period_month) FROM e WHERE family = cluster_family) AS period_month, round(prr * exp(-1.96 * se), 6) AS ci_low, round(prr * exp(1.96 * se), 6) AS ci_high, round(p, 6) AS p, round(q, 6) AS q,
 complaints AS n_supporting, groups AS n_supporting_groups, (SELECT max(day) FROM u) AS as_of FROM qq JOIN sp USING (cluster_id, company_id)""",
    "boilerplate_share": f"SELECT lang, count(*) AS n, round(avg(CASE WHEN regexp_matches(text_redacted, '{MARKERS}') THEN 1.0 ELSE 0.0 END), 6) AS share FROM narratives WHERE text_redacted IS NOT NULL GROUP BY lang",
    "campaign_flags": f"""WITH {FEATURES}, fm AS (SELECT group_id, family FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY fc DESC, family) AS rn FROM (SELECT group_id, family, count(*) AS fc FROM mem WHERE family IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
 b AS (SELECT family, base_state, base_company FROM {hhi('family', 'state', 'base_state')} JOIN {hhi('family', 'company', 'base_company')} USING (family)),
 j AS (SELECT f.*, fm.family, base_state, base_company FROM f LEFT JOIN fm USING (group_id) LEFT JOIN b ON b.family = fm.family),
 k AS (SELECT *, (burstiness > 3)::INT + coalesce((state_hhi > 1.5 * (base_state + (1 - base_state) / n_complaints))::INT, 0) + coalesce((company_hhi > 1.5 * (base_company + (1 - base_company) / n_complaints))::INT, 0)
  + (coalesce(length_cv, 1) < 0.2)::INT + (boilerplate > 0.5)::INT AS n_signals FROM j) SELECT group_id, family, n_complaints, n_signals, n_complaints >= 20 AND n_signals >= 3 AS flagged FROM k""",
    "false_alert_rate": f"""WITH {UNITS.replace('e AS (', 'e0 AS (')}, s1 AS (SELECT *, cluster_family || ':' || c AS cid, row_number() OVER (PARTITION BY cluster_family ORDER BY group_id) AS i FROM rep WHERE c IS NOT NULL),
 s2 AS (SELECT cluster_family, cid, row_number() OVER (PARTITION BY cluster_family ORDER BY sha256('control' || CAST(group_id AS VARCHAR)), group_id) AS i FROM s1),
 sh AS (SELECT s1.group_id, s2.cid AS cluster_id FROM s1 JOIN s2 USING (cluster_family, i)), e AS (SELECT e0.* EXCLUDE (cluster_id), sh.cluster_id FROM e0 LEFT JOIN sh USING (group_id)), {BH[len(UNITS) + 1:]}, sp AS {SUPPORT}
 SELECT count(*) AS tests, count(*) FILTER (WHERE q <= 0.05 AND coalesce(groups, 0) >= 15) AS alerts, round(alerts / greatest(tests, 1), 6) AS rate, rate <= 0.1 AS passes FROM qq LEFT JOIN sp USING (cluster_id, company_id)""",
    "shuffle_control": f"""WITH {UNITS}, s1 AS (SELECT *, row_number() OVER (PARTITION BY cluster_family ORDER BY group_id) AS i FROM rep),
 s2 AS (SELECT cluster_family, c AS shuffled_cluster_id, row_number() OVER (PARTITION BY cluster_family ORDER BY sha256('control' || CAST(group_id AS VARCHAR)), group_id) AS i FROM rep)
 SELECT cluster_family, shuffled_cluster_id, count(*) AS n, sum(group_id) AS key_sum FROM s1 JOIN s2 USING (cluster_family, i) GROUP BY ALL""",
    "asof_cutoff": f"WITH {OUT} SELECT * FROM a2",
    "backtest_outcomes": f"WITH {OUT} SELECT * FROM oc",
    "backtest_summary": f"""WITH {OUT}, ld AS (SELECT list(lead_days ORDER BY lead_days) AS l FROM oc WHERE detected)
 SELECT count(*) AS n, count(*) FILTER (WHERE detected) AS detected, round(count(*) FILTER (WHERE detected) / count(*), 6) AS detect_rate, round(median(lead_days) FILTER (WHERE detected), 6) AS median_lead,
  (SELECT l[len(l) // 4 + 1] FROM ld) AS p25_lead, (SELECT l[3 * len(l) // 4 + 1] FROM ld) AS p75_lead FROM oc WHERE detected IS NOT NULL""",
    "unit_norms": "SELECT count(*) FILTER (WHERE abs(sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) - 1) > 1e-3) AS \"off\", count(*) AS n FROM embeddings",
    "knn_exact": f"""WITH {CENT} SELECT id, neighbour, round(score, 6) AS score, rank FROM (SELECT q.id, p.id AS neighbour, list_dot_product(q.v, p.v) AS score, row_number() OVER (PARTITION BY q.id ORDER BY list_dot_product(q.v, p.v) DESC, p.id) AS rank
 FROM pt q JOIN pt p ON q.id <> p.id WHERE q.id % 100 = 0) WHERE rank <= 5""",
    "centroid_assign": f"""WITH {CENT} SELECT id, CASE WHEN s >= 0.65 THEN cluster ELSE -1 END AS cluster, round(s, 6) AS similarity FROM (SELECT id, cluster, list_dot_product(v, centroid) AS s,
 row_number() OVER (PARTITION BY id ORDER BY list_dot_product(v, centroid) DESC, cluster) AS rn FROM pt CROSS JOIN ce) WHERE rn = 1""",
    "coherence_medoid": f"WITH {CENT} SELECT cluster, round(avg(s), 6) AS coherence, arg_max(id, s) AS medoid FROM (SELECT cluster, id, list_dot_product(v, centroid) AS s FROM pt JOIN ce ON label = cluster) GROUP BY cluster",
    "related_clusters": f"WITH {CENT} SELECT a.cluster AS cluster_a, b.cluster AS cluster_b, round(list_dot_product(a.centroid, b.centroid), 6) AS similarity FROM ce a JOIN ce b ON a.cluster < b.cluster AND a.cluster % 3 <> b.cluster % 3 WHERE list_dot_product(a.centroid, b.centroid) >= 0",
    "novelty_scores": f"""WITH c AS (SELECT DISTINCT complaint_id, coalesce(state, '-') AS cluster, issue, sub_issue FROM complaints_raw), m AS (SELECT cluster, {LABEL} AS label FROM c),
 sp AS (SELECT count(DISTINCT label) AS n_labels FROM m), k AS (SELECT cluster, label, count(*) AS n FROM m WHERE label IS NOT NULL GROUP BY ALL), t AS (SELECT cluster, sum(n) AS t FROM k GROUP BY ALL),
 h AS (SELECT cluster, max(n) AS top, -sum(n / t * ln(n / t)) AS h FROM k JOIN t USING (cluster) GROUP BY ALL),
 v AS (SELECT cluster, coalesce(top / size, 0) AS share, coalesce(least(1.0, h / ln(greatest(n_labels, 2))), 1.0) AS ent FROM (SELECT cluster, count(*) AS size FROM m GROUP BY ALL) LEFT JOIN h USING (cluster) CROSS JOIN sp)
 SELECT cluster, round(share, 6) AS modal_share, round(ent, 6) AS entropy, round(0.5 * (1 - share) + 0.5 * ent, 6) AS novelty FROM v""",
    "length_auc": """WITH s AS (SELECT n_chars AS score, toxic AS label FROM documents JOIN doc_labels USING (doc_id)), r AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS rk FROM s)
 SELECT round((sum(rk) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))), 6) AS auc FROM r""",
    "ablation_auc": f"""WITH c AS (SELECT DISTINCT complaint_id, coalesce(product, '-') || '|' || coalesce(state, '-') AS cluster, issue, sub_issue FROM complaints_raw), m AS (SELECT cluster, issue, {LABEL} AS label FROM c),
 tr AS (SELECT cluster, issue FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ic DESC, issue) AS rn FROM (SELECT cluster, issue, count(*) AS ic FROM m WHERE issue IS NOT NULL GROUP BY ALL)) WHERE rn = 1),
 hi AS (SELECT issue AS hidden FROM tr GROUP BY issue ORDER BY count(*) DESC, issue LIMIT 10), sz AS (SELECT cluster, count(*) AS size FROM m GROUP BY ALL), sp AS (SELECT count(DISTINCT label) AS n_labels FROM m),
 k AS (SELECT hidden, cluster, label, count(*) AS n FROM m CROSS JOIN hi WHERE label IS NOT NULL AND issue IS DISTINCT FROM hidden GROUP BY ALL), t AS (SELECT hidden, cluster, sum(n) AS t FROM k GROUP BY ALL),
 h AS (SELECT hidden, cluster, max(n) AS top, -sum(n / t * ln(n / t)) AS h FROM k JOIN t USING (hidden, cluster) GROUP BY ALL),
 v AS (SELECT hi.hidden, tr.issue IS NOT DISTINCT FROM hi.hidden AS y, round(CASE WHEN h IS NULL THEN 1.0 ELSE 0.5 * (1 - top / size) + 0.5 * least(1.0, h / ln(greatest(n_labels, 2))) END, 9) AS score
  FROM sz CROSS JOIN hi CROSS JOIN sp LEFT JOIN h ON h.hidden = hi.hidden AND h.cluster = sz.cluster LEFT JOIN tr ON tr.cluster = sz.cluster),
 r AS (SELECT *, rank() OVER (PARTITION BY hidden ORDER BY score) + (count(*) OVER (PARTITION BY hidden, score) - 1) / 2.0 AS rk FROM v),
 a AS (SELECT hidden, count(*) FILTER (WHERE y) AS p, count(*) AS n, sum(rk) FILTER (WHERE y) AS s FROM r GROUP BY hidden)
 SELECT hidden AS issue, p AS n_positive, round((s - p * (p + 1) / 2.0) / (p * (n - p)), 6) AS auc FROM a WHERE p > 0 AND n > p""",
    "tokenize": f"SELECT doc_id, len({toks('text')}) AS n_tokens, len(list_distinct({toks('text')})) AS n_distinct FROM documents",
    "bm25_rank": f"WITH {BM} SELECT query_id, doc_id, round(score, 6) AS score, rank FROM br WHERE rank <= 10",
    "ir_metrics": f"WITH {BM}, {GRAMS}, b50 AS (SELECT * FROM br WHERE rank <= 50), {metrics('m', 'b50')} SELECT query_id, n_relevant, hits, round(recall, 6) AS recall, round(reciprocal_rank, 6) AS reciprocal_rank FROM m",
    "wilson_rates": """WITH g AS (SELECT source, count(*) AS n, sum(toxic) AS k FROM documents JOIN doc_labels USING (doc_id) GROUP BY ALL), z AS (SELECT *, k / n AS p, 1.959963984540054 AS z FROM g)
 SELECT source, n, k, round(greatest(0, (p + z*z/(2*n) - z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS low, round(least(1, (p + z*z/(2*n) + z * sqrt(p*(1-p)/n + z*z/(4.0*n*n))) / (1 + z*z/n)), 6) AS high FROM z""",
    "length_percentiles": "SELECT source, round(median(n_chars), 6) AS median_chars, round(quantile_cont(n_chars, 0.95), 6) AS p95_chars FROM documents GROUP BY ALL",
    "precision_recall": """SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM (
 SELECT count(*) FILTER (WHERE source = 'consumer_forum' AND toxic = 1) AS tp, count(*) FILTER (WHERE source = 'consumer_forum' AND toxic <> 1) AS fp, count(*) FILTER (WHERE source <> 'consumer_forum' AND toxic = 1) AS fn FROM documents JOIN doc_labels USING (doc_id))""",
    "baseline_units_b0": "SELECT product, count(DISTINCT complaint_id) AS n_members FROM complaints_raw GROUP BY ALL",
    "baseline_units_b1": "SELECT product, issue, sub_issue, count(*) AS n_members FROM (SELECT DISTINCT complaint_id, product, issue, sub_issue FROM complaints_raw) GROUP BY ALL",
    "near_miss_stride_sample": """WITH p AS (SELECT DISTINCT complaint_id_a AS a, complaint_id_b AS b, similarity FROM dup_pairs WHERE similarity IS NOT NULL AND complaint_id_b IS NOT NULL AND similarity >= 0.95 - 0.07 AND similarity < 0.95),
 q AS (SELECT *, row_number() OVER (ORDER BY similarity, a, b) - 1 AS position FROM p) SELECT a, b, similarity, position FROM q WHERE position % greatest(1, (SELECT count(*) // 300 FROM p)) = 0""",
    "hash_sample": "SELECT complaint_id, sha256('seed-1:' || CAST(complaint_id AS VARCHAR)) AS draw FROM narratives ORDER BY draw, complaint_id LIMIT 50",
    "event_values": "SELECT event_type, json_extract_string(props, '$.page') AS page, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 6) AS value FROM events GROUP BY ALL",
    "prefix_lookup": f"""WITH {CANON}, k AS (SELECT DISTINCT company_id, string_split(upper(trim(regexp_replace(normal, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS cw, normal FROM cc),
 a AS (SELECT DISTINCT array_to_string(string_split(normal, ' ')[1:2], ' ') AS name FROM cc), aw AS (SELECT name, string_split(upper(trim(regexp_replace(name, '[^A-Za-z0-9]+', ' ', 'g'))), ' ') AS w FROM a),
 h AS (SELECT name, count(DISTINCT company_id) AS n, min(company_id) AS company_id FROM aw JOIN k ON cw[1] = w[1] AND cw[1:len(w)] = w GROUP BY name)
 SELECT a.name, h.company_id FROM a LEFT JOIN (SELECT * FROM h WHERE n = 1) h USING (name)""",
    "blinded_worklist": """WITH c AS (SELECT cluster_id, sum(n) AS n FROM (SELECT DISTINCT * FROM cluster_timeseries WHERE company_id = '__ALL__') GROUP BY cluster_id), x AS (SELECT *, median(n) OVER () AS med FROM c),
 k AS (SELECT cluster_id FROM x WHERE n > med UNION ALL (SELECT cluster_id FROM x WHERE n <= med ORDER BY sha256('review:decoy:' || cluster_id), cluster_id LIMIT 10)) SELECT sha256('review:' || cluster_id) AS position, cluster_id FROM k""",
    "pair_tier_report": "SELECT method, count(*) AS n, count(*) FILTER (WHERE complaint_id_a = complaint_id_b) AS selfs, count(*) FILTER (WHERE similarity >= 0.88) AS at_threshold FROM dup_pairs GROUP BY ALL",
}

def oracle_sql() -> dict[str, str]:
    return dict(SQL)
