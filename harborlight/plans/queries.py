"""The library's own queries over the test tables; plans/oracle.py has the SQL of each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborlight.functions import taxonomy
from harborlight.functions import text as T
from harborlight.operators import changepoint, curation, dedup, evaluation, retrieval, signals, skew, vectors
from harborlight.session import cut, ship_package
from harborlight.session import read_table as table

R = 6
RELATED = 0.0  # the test vectors are spread evenly; real centroids are related from vectors.RELATED on
CUTOFFS = [f"{y}-01-01" for y in range(1996, 2002)]

def r6(c):
    return F.round(c, R)


# --- a few keys holding most records

def p3_company_totals(spark: SparkSession, d: str) -> DataFrame:
    """Per company_id: sums of n and denom, months, and what its join with company_alias would sum to. The states of each table are built once."""
    own = skew.key_states_once(table(spark, d, "cluster_timeseries"), ["company_id"], ["n", "denom"], {"months": F.col("period_month")})
    alias = skew.key_states(table(spark, d, "company_alias").where("company_id is not null"), ["company_id"], [])
    # the states stand for their rows in the join; a company without an alias keeps its own totals
    j = own.join(alias.select(F.col("company_id").alias("__c"), F.col("rows").alias("__rb")), F.col("company_id") == F.col("__c"), "left")
    times = F.coalesce("__rb", F.lit(0))
    return j.select("company_id", F.col("rows").alias("n_rows"), "sum_n", "sum_denom", F.col("n_months").alias("months"), (F.col("rows") * times).alias("alias_rows"), (F.col("sum_n") * times).alias("alias_n"))


def p3_product_months(spark: SparkSession, d: str) -> DataFrame:
    """Per product and month: complaints, and those with a narrative in narratives: both inputs by complaint_id first, joined as states, rolled up."""
    raw = table(spark, d, "complaints_raw").select("complaint_id", "product", F.trunc("date_received", "month").alias("month"))
    # a complaint delivered again is one state, standing for one row
    left = skew.key_states(raw, ["complaint_id", "product", "month"], []).withColumn("rows", F.lit(1).cast("long"))
    right = skew.key_states(table(spark, d, "narratives"), ["complaint_id"], [])
    joined = skew.join_states(left, right, ["complaint_id"], [], [], carry=["product", "month"], how="left")
    return skew.roll_up(joined, ["product", "month"], ["join_rows", "matched_rows"]).select("product", "month", F.col("join_rows").alias("complaints"), F.col("matched_rows").alias("narratives"))


def p3_products(spark: SparkSession, d: str) -> DataFrame:
    return skew.roll_up(p3_product_months(spark, d), ["product"], ["complaints", "narratives"])


# --- ingest and text

def load_typed_projection(spark, d):
    c = table(spark, d, "complaints_raw").selectExpr(*[f"cast({x} as string) as {x}" for x in ("complaint_id", "date_received", "product", "sub_product", "state", "tags")], "case when timely_response then 'Yes' when not timely_response then 'No' end as timely")
    return c.where("try_cast(complaint_id as bigint) is not null").select(
        F.col("complaint_id").try_cast("long").alias("complaint_id"), T.iso_date(F.col("date_received")).alias("date_received"), F.trunc(T.iso_date(F.col("date_received")), "month").alias("period_month"),
        T.blank_to_null(F.col("product")).alias("product"), T.blank_to_null(F.col("tags")).alias("tags"), T.yes_no(F.col("timely")).alias("timely"), F.coalesce(F.trim("sub_product") != "", F.lit(False)).alias("has_sub_product"),
    ).distinct()


def company_canonical(spark, d):
    a = table(spark, d, "company_alias").select("alias_raw", "company_id", "method")
    computed = a.withColumn("normal", T.company_normal(F.col("alias_raw"))).withColumn("slug", T.slug(F.col("normal")))
    return computed.select("alias_raw", "normal", F.when(F.col("method") == "manual", F.col("company_id")).otherwise(F.col("slug")).alias("company_id"))


def company_sizes(spark, d):
    named = company_canonical(spark, d)
    counts = table(spark, d, "complaints_raw").where("company_raw is not null").groupBy("company_raw").agg(F.count_distinct("complaint_id").alias("n"))
    return counts.join(named, counts.company_raw == named.alias_raw).groupBy("company_id").agg(F.count(F.lit(1)).alias("spellings"), F.sum("n").alias("complaints"))


def crosswalk_family(spark, d):
    c = table(spark, d, "complaints_raw").select("complaint_id", "product", "sub_product").distinct()
    return taxonomy.with_family(c).select("complaint_id", "product_std", F.col("product_family").alias("family"))


def uncovered_labels(spark, d):
    c = taxonomy.with_family(table(spark, d, "complaints_raw").select("complaint_id", "product", "sub_product").distinct())
    return c.where("product_family is null").groupBy("product", "sub_product").agg(F.count(F.lit(1)).alias("n"))


def text_normalize_hash(spark, d):
    n = table(spark, d, "narratives").select("complaint_id", "text_redacted")
    return n.select("complaint_id", T.text_hash(F.col("text_redacted")).alias("h"), F.length(T.normalize(F.col("text_redacted"))).alias("n_chars"))


def pii_redact_counts(spark, d):
    """Matches by pattern over all narratives, and how many texts changed."""
    rows = T.redacted(table(spark, d, "narratives").select("text_redacted"), "text_redacted")
    names = [f"n_{name}" for name, _, _ in T.PII]
    return rows.agg(*(F.sum(n).alias(n) for n in names), F.count_if(F.col("clean") != F.col("text_redacted")).alias("n_changed"))


def markdown_strip(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(T.strip_html(F.col("text"))).alias("n_chars"))


def window_split(spark, d):
    w = T.windows(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(w).alias("n_windows"), F.length(w[0]).alias("first_len"))


def privacy_ngram_overlap(spark, d):
    # tokens in a projection of their own: within the n-gram lambda they would be cut again for each position
    grams = lambda df, k: df.select(k, T.tokens(F.col("text")).alias("t")).select(k, F.explode(F.array_distinct(T.word_ngrams(F.col("t"), 8))).alias("g"))
    docs, items = grams(table(spark, d, "documents"), "doc_id"), grams(table(spark, d, "eval_items"), "item_id")
    return docs.join(items, "g").groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("shared"))


def redaction_histogram(spark, d):
    b = F.when(F.col("redaction_count") == 0, "0").when(F.col("redaction_count") <= 2, "1-2").otherwise("3+")
    return table(spark, d, "narratives").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("char_len")).alias("avg_len"))


def monthly_family_volume(spark, d):
    c = table(spark, d, "complaints_raw").select("complaint_id", "product", "date_received").distinct()
    return c.groupBy("product", F.trunc("date_received", "month").alias("period_month")).agg(F.count(F.lit(1)).alias("n"))


def taxonomy_vocabulary(spark, d):
    return table(spark, d, "complaints_raw").groupBy("product", "sub_product", "issue").agg(F.count_distinct("complaint_id").alias("n"), F.min("date_received").alias("first_day"), F.max("date_received").alias("last_day"))


def product_month_gaps(spark, d):
    c = table(spark, d, "complaints_raw").where("product is not null").select("product", F.trunc("date_received", "month").alias("period_month"))
    return evaluation.month_gaps(c, "product", "period_month")


# --- duplicates

def _texts(spark, d):
    n = table(spark, d, "narratives").where("text_redacted is not null").select(F.col("complaint_id").alias("id"), "text_hash", "text_redacted")
    c = table(spark, d, "complaints_raw").select(F.col("complaint_id").alias("id"), F.col("product").alias("family"), "date_received", "state", "company_raw").distinct()
    return n.join(c, "id").withColumn("h", F.col("text_hash"))


def exact_dup_pairs(spark, d):
    return dedup.exact_pairs(table(spark, d, "narratives").select(F.col("complaint_id").alias("id"), F.col("text_hash").alias("h"))).select("a", "b")


def exact_representatives(spark, d):
    t = table(spark, d, "narratives").select(F.col("complaint_id").alias("id"), F.col("text_hash").alias("h"), F.lit(None).cast("string").alias("family"), F.col("text_redacted").alias("text"))
    return dedup.exact_representatives(t).select("h", "id")


def minhash_verified(spark, d):
    # no family blocks: product labels change with the era, and a hash has the label of its smallest id only
    t = _texts(spark, d).select("id", "h", F.lit(None).cast("string").alias("family"), T.normalize(F.col("text_redacted")).alias("text"))
    return dedup.minhash_links(dedup.exact_representatives(t)).select("a", "b", F.round("similarity", 6).alias("similarity"))


def star_groups(spark, d):
    links = table(spark, d, "dup_pairs").where("similarity >= 0.88 and complaint_id_b is not null").select(F.col("complaint_id_a").alias("a"), F.col("complaint_id_b").alias("b"))
    nodes = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    return dedup.star_clusters(nodes, links)


def dup_group_representative(spark, d):
    m = _texts(spark, d).select("id", "h", "date_received")
    return dedup.group_representative(m, "h", ["date_received", "id"]).where("is_representative").select("h", "id")


def _members(spark, d):
    """Narratives grouped by issue and month: groups large enough for campaign statistics."""
    n = table(spark, d, "narratives").select(F.col("complaint_id").alias("id"), "char_len", F.col("text_redacted").alias("text"))
    c = table(spark, d, "complaints_raw").select(F.col("complaint_id").alias("id"), "product", "issue", "date_received", "state", "company_raw").distinct()
    gid = F.concat_ws("|", F.coalesce("issue", F.lit("-")), F.date_format("date_received", "yyyy-MM"))
    return n.join(c, "id").select(gid.alias("group_id"), "id", F.col("date_received").alias("day"), F.col("product").alias("family"), "state", F.col("company_raw").alias("company"), "char_len", "text")


def campaign_features(spark, d):
    f = dedup.campaign_features(_members(spark, d))
    return f.select("group_id", "n_complaints", *(r6(F.col(c)).alias(c) for c in ("length_cv", "boilerplate", "burstiness", "state_hhi", "company_hhi")))


def family_baseline_hhi(spark, d):
    m = _members(spark, d).withColumn("family", F.coalesce("family", F.lit("-")))
    s, c = dedup.concentration(m, "family", "state", "base_state"), dedup.concentration(m, "family", "company", "base_company")
    return s.join(c, "family").select("family", r6("base_state").alias("base_state"), r6("base_company").alias("base_company"))


def campaign_flags(spark, d):
    m = _members(spark, d)
    base = dedup.concentration(m, "family", "state", "base_state").join(dedup.concentration(m, "family", "company", "base_company"), "family")
    return dedup.campaign_flags(dedup.campaign_features(m), base).select("group_id", "family", "n_complaints", "n_signals", "flagged")


def boilerplate_share(spark, d):
    """Share of all narratives with a statutory or legal marker, by language."""
    n = table(spark, d, "narratives").where("text_redacted is not null")
    return n.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), r6(F.avg(F.col("text_redacted").rlike(T.BOILERPLATE).cast("double"))).alias("share"))


# --- signals

ORDER = ["day", "line", "part", "company_id"]


def _units(spark, d):
    l, o, p = table(spark, d, "lineitem"), table(spark, d, "orders"), table(spark, d, "part")
    j = l.join(o, l.l_orderkey == o.o_orderkey).join(p, l.l_partkey == p.p_partkey)
    return j.select(
        F.col("l_orderkey").alias("group_id"), F.col("l_suppkey").cast("string").alias("company_id"), F.col("o_orderpriority").alias("family"), F.col("p_type").alias("cluster"),
        F.to_date("l_shipdate").alias("day"), F.trunc("l_shipdate", "month").alias("period_month"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"),
    )


def _expanded(spark, d):
    e = signals.expand(_units(spark, d), ORDER)
    return e.withColumn("cluster_id", F.concat_ws(":", "cluster_family", "cluster_id"))


def _written(spark, d):
    """The population written once: panels, cells and support each read it several times."""
    return cut(_expanded(spark, d))


def expanded_population(spark, d):
    return _expanded(spark, d).groupBy("family", "cluster_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("group_id").alias("n_groups"))


def panel(spark, d):
    return signals.panel(_written(spark, d)).select("cluster_id", "company_id", "period_month", "n", "denom", r6("share").alias("share"))


def contingency_2x2(spark, d):
    return signals.contingency(_expanded(spark, d))


def _tests(spark, d):
    return signals.ror(signals.prr(signals.testable(signals.contingency(_expanded(spark, d)))))


def prr_ci(spark, d):
    t = _tests(spark, d)
    return t.select("family", "company_id", "cluster_id", *(r6(F.col(c)).alias(c) for c in ("prr", "prr_low", "prr_high")))


def ror_z(spark, d):
    return _tests(spark, d).select("family", "company_id", "cluster_id", r6("ror").alias("ror"), r6("z").alias("z"), r6("p").alias("p"))


def bh_qvalues(spark, d):
    return signals.bh(_tests(spark, d)).select("family", "company_id", "cluster_id", r6("q").alias("q"))


def eb_prior(spark, d):
    return signals.gamma_prior(signals.with_expected(_tests(spark, d))).select("family", r6("alpha").alias("alpha"), r6("beta").alias("beta"))


def _shrunk(spark, d):
    cells = signals.with_expected(_tests(spark, d))
    return signals.shrink(cells, signals.gamma_prior(cells))


def ebgm(spark, d):
    return _shrunk(spark, d).select("family", "company_id", "cluster_id", r6("ebgm").alias("ebgm"))


def eb05(spark, d):
    return signals.eb05(_shrunk(spark, d)).select("family", "company_id", "cluster_id", r6("eb05").alias("eb05"))


def support_grouping_sets(spark, d):
    return signals.support(_expanded(spark, d))


def _panel(spark, d):
    """The panel, written once, and its first and last month."""
    p = cut(signals.panel(_written(spark, d)))
    return p, signals.month_axis(p)


def densified_series(spark, d):
    p, (lo, hi) = _panel(spark, d)
    return signals.densify(p, lo, hi).withColumn("share", r6("share"))


def trailing_baseline(spark, d):
    p, (lo, hi) = _panel(spark, d)
    return signals.trailing(signals.densify(p, lo, hi)).select("cluster_id", "company_id", "period_month", r6("share").alias("share"), r6("base_mean").alias("base_mean"), r6("base_sd").alias("base_sd"))


def ewma_alarms(spark, d):
    """First upward alarms of the smoothed share, over every cluster and company series with enough groups."""
    p, (lo, hi) = _panel(spark, d)
    found = changepoint.detect(signals.series_arrays(p, lo, hi), lo, methods=("ewma",))
    return found.select("cluster_id", "company_id", "period_month", r6("statistic").alias("statistic"))


def change_alarms(spark, d):
    p, (lo, hi) = _panel(spark, d)
    return changepoint.detect(signals.series_arrays(p, lo, hi), lo).withColumn("statistic", r6("statistic"))


def _signals(spark, d, methods=("ewma", "pelt")):
    """All signal rows: scored pairs and change points of every series, with support."""
    e = cut(_expanded(spark, d))
    p = cut(signals.panel(e))
    lo, hi = signals.month_axis(p)
    tests = signals.ror(signals.prr(signals.testable(signals.contingency(e))))
    cells = signals.with_expected(signals.bh(tests))
    scored = signals.eb05(signals.shrink(cells, signals.gamma_prior(cells)))
    changes = changepoint.detect(signals.series_arrays(p, lo, hi), lo, methods=methods)
    as_of = str(e.agg(F.max("day")).first()[0])
    return signals.signal_rows(scored, changes, signals.support(e), hi, as_of)


def signal_rows(spark, d):
    return _signals(spark, d).select("cluster_id", "company_id", "period_month", "method", *(r6(F.col(c)).alias(c) for c in ("statistic", "ci_low", "ci_high", "p", "q")), "n_supporting", "n_supporting_groups", "as_of")


def signal_support(spark, d):
    """What signal_rows says of the scored pairs but EB05, which SQL has no quantile for."""
    eb = _signals(spark, d).where("method = 'ebgm'")
    return eb.select("cluster_id", "company_id", "period_month", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"), r6("p").alias("p"), r6("q").alias("q"), "n_supporting", "n_supporting_groups", "as_of")


def _coherent(spark, d):
    """Coherence of each cluster: that of the vectors it is made of; part types and vectors are paired by a hash of the type."""
    coherence = vectors.coherence(_points(spark, d), vectors.centroids(_points(spark, d))).select(F.col("cluster").alias("label"), "coherence")
    clusters = _expanded(spark, d).select("cluster_id").where("cluster_id is not null").distinct()
    return clusters.withColumn("label", F.length("cluster_id") % 10).join(coherence, "label").select("cluster_id", "coherence")


def _scopes(spark, d, methods=("ewma", "pelt")):
    """Alert scopes and the clusters' coherence; the test vectors are random, so the floor is their clusters' median coherence, not signals.MIN_COHERENCE."""
    c = cut(_coherent(spark, d))
    floor = c.agg(F.percentile("coherence", 0.5)).first()[0] or 0.0
    return signals.alert_scopes(_signals(spark, d, methods), c, floor), c


def alert_scopes(spark, d):
    a = signals.in_order(_scopes(spark, d)[0])
    return a.select("cluster_id", "company_id", r6("eb05").alias("eb05"), r6("q").alias("q"), "changed", "change_month", "n_supporting", "n_groups", r6("coherence").alias("coherence"))


def smoothed_scopes(spark, d):
    """As alert_scopes, with the alarms of the smoothed share as the only change points: what SQL can follow."""
    a = signals.in_order(_scopes(spark, d, ("ewma",))[0])
    return a.select("cluster_id", "company_id", r6("eb05").alias("eb05"), r6("q").alias("q"), "changed", "change_month", "n_supporting", "n_groups", r6("coherence").alias("coherence"))


def alert_tracks(spark, d):
    """Alerts in novel and known clusters; a part type counts as novel here if its cluster is among the more coherent quarter."""
    scopes, c = _scopes(spark, d)
    top = c.agg(F.percentile("coherence", 0.75)).first()[0]
    return signals.alert_tracks(scopes, c.withColumn("is_novel", F.col("coherence") >= F.lit(top)))


def false_alert_rate(spark, d):
    """The negative control: clusters permuted among the groups of a family, tested like the real ones."""
    e = cut(_expanded(spark, d))
    groups = e.where("cluster_id is not null").select("cluster_family", "group_id", "cluster_id").distinct()
    control = evaluation.shuffled(groups, "cluster_family", "group_id", "cluster_id", "control").select("group_id", F.col("shuffled_cluster_id").alias("cluster_id"))
    e2 = cut(e.drop("cluster_id").join(control, "group_id", "left"))
    tests = signals.bh(signals.ror(signals.testable(signals.contingency(e2))))
    return signals.false_alert_rate(tests, signals.support(e2)).withColumn("rate", r6("rate"))


def shuffle_control(spark, d):
    reps = signals.representatives(_units(spark, d), ORDER)
    s = evaluation.shuffled(reps, "cluster_family", "group_id", "cluster_id", "control")
    return s.groupBy("cluster_family", "shuffled_cluster_id").agg(F.count(F.lit(1)).alias("n"), F.sum("group_id").alias("key_sum"))


# --- backtest

def _actions(spark, d):
    o = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' or o_orderpriority like '1%'")
    return o.select(F.col("o_orderkey").alias("action_id"), (F.col("o_custkey") % 50 + 1).cast("string").alias("company_id"), F.to_date("o_orderdate").alias("day"))


def asof_cutoff(spark, d):
    return evaluation.asof_cutoff(_actions(spark, d), CUTOFFS, "day")


def _outcomes(spark, d):
    e = _units(spark, d).groupBy("company_id", "period_month").agg(F.count_distinct("group_id").alias("groups"))
    runs = spark.createDataFrame([(f"run{i}", c) for i, c in enumerate(CUTOFFS) if i != 2], "run_id string, cutoff string").select("run_id", F.to_date("cutoff").alias("cutoff"))
    # signals of a run: company months before its cutoff, by a join on the year of the cutoff list
    each = e.select("*", F.explode(F.array(*(F.lit(c).cast("date") for c in CUTOFFS))).alias("cutoff")).where("period_month < cutoff")
    sig = each.join(runs, "cutoff").select("run_id", "company_id", "period_month", "groups", F.lit(0.01).alias("q"), F.lit("ebgm").alias("method"))
    return evaluation.outcomes(asof_cutoff(spark, d), sig, runs, min_groups=3)


def backtest_outcomes(spark, d):
    return _outcomes(spark, d)


def backtest_summary(spark, d):
    s = evaluation.summary(_outcomes(spark, d))
    return s.select("n", "detected", r6("detect_rate").alias("detect_rate"), r6("median_lead").alias("median_lead"), "p25_lead", "p75_lead")


# --- vectors

def _points(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), F.col("label").alias("cluster"))


def unit_norms(spark, d):
    return _points(spark, d).agg(F.count_if(F.abs(F.sqrt(vectors.dot("v", "v")) - 1) > 1e-3).alias("off"), F.count(F.lit(1)).alias("n"))


def knn_exact(spark, d):
    p = _points(spark, d)
    return vectors.nearest(p.where("id % 100 = 0"), p, 5).select("id", "neighbour", r6("score").alias("score"), "rank")


def centroid_assign(spark, d):
    p = _points(spark, d)
    return vectors.assign(p, vectors.centroids(p)).select("id", "cluster", r6("similarity").alias("similarity"))


def coherence_medoid(spark, d):
    p = _points(spark, d)
    return vectors.coherence(p, vectors.centroids(p)).select("cluster", r6("coherence").alias("coherence"), "medoid")


def related_clusters(spark, d):
    c = vectors.centroids(_points(spark, d))
    fam = c.select("cluster", F.concat(F.lit("f"), (F.col("cluster") % 3).cast("string")).alias("family"))
    return vectors.related(c, fam, RELATED).select("cluster_a", "cluster_b", r6("similarity").alias("similarity"))


def cluster_agreement(spark, d):
    p = _points(spark, d)
    a = vectors.assign(p, vectors.centroids(p), 2.0).select("id", F.col("cluster").alias("x")).join(p.select("id", F.col("cluster").alias("y")), "id")
    return vectors.agreement(a).select(r6("ari").alias("ari"), r6("nmi").alias("nmi"))


def novelty_scores(spark, d):
    m = _novelty_members(spark, d)
    space = m.where("label is not null").groupBy("family").agg(F.count_distinct("label").alias("n_labels"))
    return vectors.novelty(m, space).select("cluster", *(r6(F.col(x)).alias(x) for x in ("modal_share", "entropy", "novelty")))


def _novelty_members(spark, d):
    c = table(spark, d, "complaints_raw").select("complaint_id", F.coalesce("state", F.lit("-")).alias("cluster"), F.lit("all").alias("family"), "issue", "sub_issue").distinct()
    label = F.when(F.col("issue").isNotNull(), F.concat(F.col("issue"), F.lit(" | "), F.coalesce("sub_issue", F.lit("∅"))))
    return c.withColumn("label", label)


def ablation_auc(spark, d):
    """Can novelty tell the clusters that a hidden issue dominates? One issue hidden at a time, over clusters by product and state."""
    c = table(spark, d, "complaints_raw").select("complaint_id", F.concat_ws("|", F.coalesce("product", F.lit("-")), F.coalesce("state", F.lit("-"))).alias("cluster"), F.lit("all").alias("family"), "issue", "sub_issue").distinct()
    label = F.when(F.col("issue").isNotNull(), F.concat(F.col("issue"), F.lit(" | "), F.coalesce("sub_issue", F.lit("∅"))))
    return vectors.ablation(c.withColumn("label", label), 10).select("issue", "n_positive", r6("auc").alias("auc"))


def length_auc(spark, d):
    """How well a document's length alone tells the toxic ones."""
    docs = table(spark, d, "documents").join(table(spark, d, "doc_labels"), "doc_id")
    return vectors.auc(docs.select(F.col("n_chars").alias("score"), F.col("toxic").cast("long").alias("label"))).select(r6("auc").alias("auc"))


# --- retrieval

def _queries(spark, d):
    return table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), T.tokens(F.col("text")).alias("tokens"))


def tokenize(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).alias("n_distinct"))


def _bm25(spark, d, top=50):
    docs = table(spark, d, "documents").select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    return retrieval.bm25(docs, _queries(spark, d), top)


def bm25_rank(spark, d):
    return _bm25(spark, d, 10).select("query_id", "doc_id", r6("score").alias("score"), "rank")


def _relevant(spark, d):
    return privacy_ngram_overlap(spark, d).select(F.col("item_id").alias("query_id"), "doc_id")


def ir_metrics(spark, d):
    return retrieval.ir_metrics(_bm25(spark, d), _relevant(spark, d)).select("query_id", "n_relevant", "hits", r6("recall").alias("recall"), r6("reciprocal_rank").alias("reciprocal_rank"))


def wilson_rates(spark, d):
    g = table(spark, d, "documents").join(table(spark, d, "doc_labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("k"))
    low, high = vectors.wilson(F.col("k").cast("double"), F.col("n").cast("double"))
    return g.select("source", "n", "k", r6(low).alias("low"), r6(high).alias("high"))


def length_percentiles(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(r6(F.median("n_chars")).alias("median_chars"), r6(F.percentile("n_chars", 0.95)).alias("p95_chars"))


def precision_recall(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "doc_labels"), "doc_id")
    p = evaluation.precision_recall(docs.select((F.col("source") == "consumer_forum").alias("predicted"), (F.col("toxic") == 1).alias("actual")))
    return p.select("tp", "fp", "fn", *(r6(F.col(c)).alias(c) for c in ("precision", "recall", "f1")))


# --- baselines and samples

def baseline_units_b0(spark, d):
    return table(spark, d, "complaints_raw").groupBy("product").agg(F.count_distinct("complaint_id").alias("n_members"))


def baseline_units_b1(spark, d):
    c = table(spark, d, "complaints_raw").select("complaint_id", "product", "issue", "sub_issue").distinct()
    return c.groupBy("product", "issue", "sub_issue").agg(F.count(F.lit(1)).alias("n_members"))


def near_miss_stride_sample(spark, d):
    p = table(spark, d, "dup_pairs").where("similarity is not null and complaint_id_b is not null").select(F.col("complaint_id_a").alias("a"), F.col("complaint_id_b").alias("b"), "similarity").distinct()
    return evaluation.near_miss_sample(p, 0.95, 0.07, 300)


def hash_sample(spark, d):
    return evaluation.hash_sample(table(spark, d, "narratives").select("complaint_id"), "complaint_id", "seed-1:", 50)


def event_values(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.page").alias("page"), F.to_date("ts").alias("day"), "value")
    return e.groupBy("event_type", "page", "day").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("value"))


def pair_tier_report(spark, d):
    p = table(spark, d, "dup_pairs")
    return p.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("complaint_id_a") == F.col("complaint_id_b")).alias("selfs"), F.count_if(F.col("similarity") >= 0.88).alias("at_threshold"))


def prefix_lookup(spark, d):
    c = company_canonical(spark, d).select("company_id", "normal").distinct()
    asked = c.select(F.array_join(F.slice(F.split("normal", " "), 1, 2), " ").alias("name")).distinct()
    return curation.unique_prefix(asked, c)


def company_merge_review(spark, d):
    """Names to merge, for a person to decide: token-set ratio of 88 and more among the 300 companies with most complaints."""
    named = company_canonical(spark, d).select(F.col("alias_raw").alias("company_raw"), "company_id", "normal")
    n = table(spark, d, "complaints_raw").where("company_raw is not null").groupBy("company_raw").agg(F.count_distinct("complaint_id").alias("n"))
    sizes = n.join(named, "company_raw").groupBy("company_id").agg(F.sum("n").alias("n_complaints"), F.min("normal").alias("name"))
    return curation.merge_review(sizes)


def blinded_worklist(spark, d):
    """The larger clusters as candidates among ten of the others as decoys."""
    c = table(spark, d, "cluster_timeseries").where("company_id = '__ALL__'").distinct().groupBy("cluster_id").agg(F.sum("n").alias("n"))
    cut_at = c.agg(F.percentile("n", 0.5)).first()[0] or 0
    return curation.blinded_worklist(c.where(F.col("n") > cut_at), c.where(F.col("n") <= cut_at), "cluster_id", "review:", 10)


def star_merge_audit(spark, d):
    links = table(spark, d, "dup_pairs").where("similarity >= 0.88 and complaint_id_b is not null").select(F.col("complaint_id_a").alias("a"), F.col("complaint_id_b").alias("b"))
    return curation.merge_audit(star_groups(spark, d), links)


QUERIES = (
    prefix_lookup, company_merge_review, blinded_worklist, star_merge_audit,
    p3_company_totals, p3_product_months, p3_products, load_typed_projection, company_canonical, company_sizes, crosswalk_family, uncovered_labels, text_normalize_hash, pii_redact_counts, markdown_strip, window_split,
    privacy_ngram_overlap, redaction_histogram, monthly_family_volume, taxonomy_vocabulary, product_month_gaps, exact_dup_pairs, exact_representatives, minhash_verified, star_groups, dup_group_representative,
    campaign_features, family_baseline_hhi, campaign_flags, expanded_population, panel, contingency_2x2, prr_ci, ror_z, bh_qvalues, eb_prior, ebgm, eb05, support_grouping_sets, densified_series, trailing_baseline,
    ewma_alarms, change_alarms, signal_rows, signal_support, alert_scopes, smoothed_scopes, alert_tracks, false_alert_rate, shuffle_control, boilerplate_share, length_auc, asof_cutoff, backtest_outcomes, backtest_summary, unit_norms, knn_exact, centroid_assign, coherence_medoid, related_clusters, cluster_agreement, novelty_scores,
    ablation_auc, tokenize, bm25_rank, ir_metrics, wilson_rates, length_percentiles, precision_recall, baseline_units_b0, baseline_units_b1, near_miss_stride_sample, hash_sample,
    event_values, pair_tier_report,
)


def shipped(functions) -> dict:
    """name -> query of (spark, sf_dir), each shipping the package to the workers first."""

    def wrap(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return f(spark, sf_dir)

        return run

    return {f.__name__: wrap(f) for f in functions}


def queries() -> dict:
    return shipped(QUERIES)
