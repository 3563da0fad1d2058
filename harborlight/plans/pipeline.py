"""Queries of the built tables, groups, embeddings, clusters, retrieval and review; plans/pipeline_sql.py has the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from harborlight.functions import text as T
from harborlight.operators import clustering, corpus, curation, embedding, evaluation, grouping, ranges, retrieval, review, vectors
from harborlight.plans import queries as base
from harborlight.session import cut
from harborlight.session import read_table as table

r6 = base.r6
START = "2017-01-01"
LINKS = "complaint_id_b is not null and complaint_id_a is not null"

# --- built tables

def _complaints(spark, d, start=None):
    return corpus.build_complaints(table(spark, d, "complaints_raw"), table(spark, d, "company_alias"), start)


def complaints_build(spark, d):
    return _complaints(spark, d, START)


def narratives_build(spark, d):
    n = corpus.build_narratives(table(spark, d, "narratives"), "complaint_id", "text_redacted")
    return n.select("complaint_id", "text_hash", "char_len", "redaction_count")


def redaction_stats(spark, d):
    return corpus.redaction_stats(corpus.build_narratives(table(spark, d, "narratives"), "complaint_id", "text_redacted"))


def narratives_in_window(spark, d):
    n = corpus.told(table(spark, d, "complaints_raw"), table(spark, d, "narratives"), "complaint_id", "text_redacted", START, "2020-01-01")
    return n.select("complaint_id", "char_len")


def load_reconciliation(spark, d):
    raw = table(spark, d, "complaints_raw")
    return corpus.reconcile(raw, raw.where("complaint_id is not null").distinct(), "complaint_id", 0.01).withColumn("share", r6("share"))


def top_companies(spark, d):
    return corpus.top(_complaints(spark, d), "company_id", 10, "n_complaints")


def announced_without_narrative(spark, d):
    """Complaints that announce a narrative that isn't there."""
    said = table(spark, d, "complaints_raw").where("has_narrative").select("complaint_id").distinct()
    return said.join(table(spark, d, "narratives").select("complaint_id"), "complaint_id", "left_anti")


# --- groups

def _stored(spark, d):
    n = table(spark, d, "narratives").select(F.col("complaint_id").alias("id"), F.col("text_hash").alias("h"), F.col("text_redacted").alias("text"), "char_len")
    c = _complaints(spark, d).select(F.col("complaint_id").alias("id"), F.col("date_received").alias("day"), F.col("product_family").alias("family"), "state", F.col("company_id").alias("company"))
    return n.join(c, "id")


def _links(spark, d):
    return table(spark, d, "dup_pairs").where(LINKS).select(F.least("complaint_id_a", "complaint_id_b").alias("a"), F.greatest("complaint_id_a", "complaint_id_b").alias("b"), "similarity", "method")


def identity_grouping(spark, d):
    return grouping.identity_groups(_stored(spark, d).select("id", "day"), "2022-01-01")


def group_assignment(spark, d):
    """Groups as known at the start of 2022: equal texts, then star clusters over the earlier run's links."""
    return grouping.assign_groups(_stored(spark, d).select("id", "h", "day"), _links(spark, d).where("method = 'minhash'").select("a", "b"), "2022-01-01")


def _hash_groups(spark, d):
    s = _stored(spark, d)
    first = s.groupBy("h").agg(F.min("id").alias("g"))
    return s.join(first, "h").select("id", "h", "day", "family", "state", "company", "char_len", "text", F.concat(F.lit("g"), F.col("g").cast("string")).alias("group_id"))


def new_links(spark, d):
    """Links of the near-duplicate tier that the exact tier doesn't have."""
    p = _links(spark, d)
    return grouping.new_links(p.where("method = 'minhash'"), p.where("method = 'exact'"))


def evaluation_pairs(spark, d):
    return grouping.evaluation_pairs(_links(spark, d).where("a < b").select("a", "b", "similarity"), _stored(spark, d).select("id", "family"), "pairs:", 100)


def labelled_pairs(spark, d):
    pairs = cut(evaluation_pairs(spark, d))
    return grouping.label_pairs(pairs, table(spark, d, "narratives").select(F.col("complaint_id").alias("id"), F.col("text_redacted").alias("text")))


def gate_report(spark, d):
    judged = grouping.same_group(labelled_pairs(spark, d), _hash_groups(spark, d).select("id", "group_id"))
    g = grouping.gate_report(judged)
    return g.select("stratum", "n", "tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


def campaigns(spark, d):
    """Campaigns of equal texts: groups of three and more here, as the tables are small."""
    c, _ = grouping.build_campaigns(_hash_groups(spark, d), 3)
    return c.select("group_id", "family", "n_complaints", "first_seen", "last_seen", "top_company", "n_signals", "flagged")


def campaign_members(spark, d):
    return grouping.build_campaigns(_hash_groups(spark, d), 3)[1]


def flagged_share(spark, d):
    c, _ = grouping.build_campaigns(_hash_groups(spark, d), 3)
    s = grouping.flagged_share(_hash_groups(spark, d), c.where("n_signals >= 2"))
    return s.select("family", "n", "n_flagged", r6("share").alias("share"))


def merge_audit_pairs(spark, d):
    groups = base.star_groups(spark, d).select("id", F.concat(F.lit("g"), F.col("seed").cast("string")).alias("group_id"))
    return grouping.merge_audit(groups, _links(spark, d).where("similarity >= 0.88").select("a", "b"), "audit:", 10, 300)


# --- embeddings

def _texts(spark, d):
    return embedding.distinct_texts(table(spark, d, "narratives").select(F.col("text_hash").alias("h"), F.col("text_redacted").alias("text")))


def distinct_text_rows(spark, d):
    return _texts(spark, d).select("row_idx", "h")


def embedding_map(spark, d):
    records = table(spark, d, "narratives").select(F.col("complaint_id").alias("id"), F.col("text_hash").alias("h"))
    return embedding.embedding_map(records, _texts(spark, d), "hashing-64", 64)


def embedding_coverage(spark, d):
    records = table(spark, d, "narratives").select(F.col("complaint_id").alias("id"))
    return embedding.coverage(records, embedding_map(spark, d))


def pending_texts(spark, d):
    """What is left to encode if those of the first row numbers were done before."""
    t = cut(_texts(spark, d))
    return embedding.pending(t, t.where("row_idx < 500")).select("row_idx", "h")


def encoded_texts(spark, d):
    v = embedding.encode(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    return v.select("doc_id", r6(F.col("v")[0]).alias("v0"), r6(F.col("v")[63]).alias("v63"), r6(F.sqrt(vectors.dot("v", "v"))).alias("norm"))


def gathered_rows(spark, d):
    """Vectors of chosen row numbers: a join on the number, not a seek in a file."""
    wanted = table(spark, d, "dup_pairs").where(LINKS).select((F.col("complaint_id_a") % 500).alias("vec_id")).distinct()
    return table(spark, d, "embeddings").join(wanted, "vec_id").select("vec_id", "label", r6(F.col("embedding")[0].cast("double")).alias("v0"))


# --- clusters

def family_representatives(spark, d):
    s = _hash_groups(spark, d)
    g = s.select("id", (F.concat(F.lit("g"), F.col("id").cast("string")) == F.col("group_id")).alias("is_representative"))
    rows = embedding_map(spark, d).select("id", "row_idx")
    return clustering.family_representatives(g, rows, s.select("id", "family"))


def small_families(spark, d):
    return clustering.too_small(_stored(spark, d).where("family is not null"), 50)


def density_clusters(spark, d):
    c = clustering.density_clusters(base._points(spark, d).select("id", "v"), 5, DENSE, 10)
    return c.select("id", "cluster", r6("core").alias("core"))


DENSE = 0.30  # the test vectors are random; real ones are dense from vectors' 1 - MAX_DISTANCE on


def cluster_persistence(spark, d):
    c = clustering.density_clusters(base._points(spark, d).select("id", "v"), 5, DENSE, 10)
    return clustering.persistence(c, DENSE).select("cluster", "size", r6("persistence").alias("persistence"))


def stability_halves(spark, d):
    return clustering.stability(base._points(spark, d), "halves:").withColumn("ari", r6("ari"))


def novel_clusters(spark, d):
    m = base._novelty_members(spark, d)
    space = m.where("label is not null").groupBy("family").agg(F.count_distinct("label").alias("n_labels"))
    size = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    # coherence and persistence stand-ins: share of complaints with a known company response, share of the largest month
    rows = table(spark, d, "complaints_raw").select("complaint_id", F.coalesce("state", F.lit("-")).alias("cluster"), "timely_response", F.trunc("date_received", "month").alias("m")).distinct()
    coherence = rows.groupBy("cluster").agg(F.avg(F.coalesce("timely_response", F.lit(False)).cast("double")).alias("coherence"))
    months = rows.groupBy("cluster", "m").agg(F.count(F.lit(1)).alias("k")).groupBy("cluster").agg(F.max("k").alias("k")).join(size, "cluster").select("cluster", (F.col("k") / F.col("n")).alias("persistence"))
    return vectors.is_novel(vectors.novelty(m, space).join(coherence, "cluster").join(months, "cluster")).select("cluster", r6("novelty").alias("novelty"), "is_novel")


def label_selection(spark, d):
    p = base._points(spark, d)
    return vectors.mmr_select(p, vectors.centroids(p), 4, 8)


def exemplar_members(spark, d):
    p = base._points(spark, d)
    a = vectors.assign(p, vectors.centroids(p), 2.0)
    m = a.select("cluster", "id", (F.col("id") % 7 == 0).alias("is_exemplar"), F.round("similarity", 6).alias("prob"))
    return clustering.exemplars(m, 5)


def baseline_members(spark, d):
    c = table(spark, d, "complaints_raw").select("complaint_id", "product", "issue", "sub_issue").distinct()
    return clustering.units(c, ["product", "issue", "sub_issue"], "complaint_id")[1]


def baseline_numbered(spark, d):
    c = table(spark, d, "complaints_raw").select("complaint_id", "product", "issue", "sub_issue").distinct()
    return clustering.units(c, ["product", "issue", "sub_issue"], "complaint_id")[0]


def topic_baseline(spark, d):
    t = table(spark, d, "narratives").where("text_redacted is not null").select("complaint_id", T.tokens(F.col("text_redacted")).alias("t"))
    return clustering.topics(t, "complaint_id", "t", 18)


def support_quantiles(spark, d):
    """Support by grouping system: dup groups by equal text against every complaint alone, over company and family."""
    s = _hash_groups(spark, d).where("company is not null and family is not null")
    by = s.groupBy("company", "family").agg(F.count_distinct("group_id").alias("groups"), F.count(F.lit(1)).alias("complaints"))
    each = by.select(F.explode(F.array(F.struct(F.lit("groups").alias("system"), F.col("groups").alias("support")), F.struct(F.lit("complaints").alias("system"), F.col("complaints").alias("support")))).alias("s")).select("s.*")
    return each.groupBy("system").agg(F.count(F.lit(1)).alias("units"), r6(F.percentile("support", 0.5)).alias("median"), r6(F.percentile("support", 0.9)).alias("p90"), F.max("support").alias("most"))


# --- series and runs

def series_readback(spark, d):
    """Each series of the stored panel in order of its months, repeated rows once, the latest as_of of a month."""
    ts = table(spark, d, "cluster_timeseries").distinct()
    last = ts.groupBy("cluster_id", "company_id", "period_month").agg(F.max_by(F.struct("n", "share"), F.struct("as_of", "n")).alias("v"))
    s = last.groupBy("cluster_id", "company_id").agg(F.sort_array(F.collect_list(F.struct("period_month", "v.n"))).alias("s"))
    return s.select("cluster_id", "company_id", F.size("s").alias("months"), F.col("s")[0]["period_month"].alias("first_month"), F.element_at("s", -1)["period_month"].alias("last_month"), F.element_at("s", -1)["n"].alias("last_n"))


def scope_dates(spark, d):
    """Last day, first and last month in scope before each cutoff."""
    c = _complaints(spark, d).select("date_received", "period_month", F.explode(F.array(*(F.lit(f"{y}-01-01").cast("date") for y in range(2017, 2025)))).alias("cutoff")).where("date_received < cutoff")
    return c.groupBy("cutoff").agg(F.max("date_received").alias("as_of"), F.min("period_month").alias("first_month"), F.max("period_month").alias("last_month"), F.count(F.lit(1)).alias("n"))


def refit_at_cutoffs(spark, d):
    """Groups by equal text and their support, refitted for each of three cutoffs: a group's representative is its earliest member then known."""
    out = None
    for y in (2018, 2020, 2022):
        s = _stored(spark, d).where(F.col("day") < F.lit(f"{y}-01-01").cast("date"))
        g = s.groupBy("h").agg(F.min_by("id", F.struct("day", "id")).alias("rep"), F.count(F.lit(1)).alias("size"))
        one = g.agg(F.lit(f"{y}-01-01").cast("date").alias("cutoff"), F.count(F.lit(1)).alias("groups"), F.sum("size").alias("members"), F.max("size").alias("largest"), F.sum("rep").alias("rep_sum"))
        out = one if out is None else out.unionByName(one)
    return out


def strong_outcomes(spark, d):
    """Outcomes of strong actions only: those with a link to an order of status F by the same customer."""
    links = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("action_id"))
    o = base._outcomes(spark, d).join(links, "action_id", "left_semi")
    return evaluation.summary(o).select("n", "detected", r6("detect_rate").alias("detect_rate"), r6("median_lead").alias("median_lead"), "p25_lead", "p75_lead")


def exclusion_reasons(spark, d):
    """Why actions leave the backtest: names that are no single company, dates, and missing narratives."""
    c = base.company_canonical(spark, d).select("company_id", "normal").distinct()
    asked = table(spark, d, "company_alias").select(F.array_join(F.slice(F.split(T.filing_normal(F.col("alias_raw")), " "), 1, 2), " ").alias("name")).distinct()
    hit = curation.unique_prefix(asked, c)
    said = _stored(spark, d).where("company is not null").groupBy(F.col("company").alias("company_id")).agg(F.min("day").alias("first_day"))
    a = hit.join(said, "company_id", "left").select("name", "company_id", F.col("first_day").isNotNull().alias("has_narratives"), F.col("first_day").alias("filed_date"), F.lit(START).cast("date").alias("window_start"))
    return curation.exclusion_reason(a).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# --- retrieval

def _vectors(spark, d):
    docs = embedding.encode(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")
    items = embedding.encode(table(spark, d, "eval_items").select(F.col("item_id").alias("query_id"), "text"), "query_id", "text")
    return docs, items


def _dense(spark, d, top=50):
    return retrieval.dense(*_vectors(spark, d), top)


def dense_rank(spark, d):
    return _dense(spark, d, 10).select("query_id", "doc_id", r6("score").alias("score"), "rank")


def _rankings(spark, d):
    dense, sparse = cut(_dense(spark, d)), cut(base._bm25(spark, d))
    return {"dense": dense, "sparse": sparse, "fused": retrieval.fuse(dense, sparse)}


def rrf_fuse(spark, d):
    return _rankings(spark, d)["fused"].select("query_id", "doc_id", r6("score").alias("score"), "rank")


def retrieval_variants(spark, d):
    return retrieval.variants(_rankings(spark, d), 10).withColumn("score", r6("score"))


def ranking_faults(spark, d):
    return retrieval.ranking_faults(retrieval.variants(_rankings(spark, d), 10))


def retrieval_summary(spark, d):
    """Recall, reciprocal rank and hits at ten by method, over the items with relevant documents."""
    rel, out = cut(base._relevant(spark, d)), None
    for method, ranking in _rankings(spark, d).items():
        m = retrieval.ir_metrics(ranking, rel).withColumn("method", F.lit(method))
        out = m if out is None else out.unionByName(m)
    s = retrieval.macro(out)
    return s.select("method", "n_queries", *(r6(F.col(c)).alias(c) for c in ("mean_recall", "mrr", "hit_rate")))


def win_tie_loss(spark, d):
    rel, r = cut(base._relevant(spark, d)), _rankings(spark, d)
    return retrieval.win_tie_loss(retrieval.ir_metrics(r["fused"], rel), retrieval.ir_metrics(r["sparse"], rel))


def scoped_evidence(spark, d):
    return retrieval.evidence(base._expanded(spark, d), ["day", "line", "part"], company="7").select("group_id", "company_id", "cluster_id", "day", "part")


def scope_hashes(spark, d):
    e = retrieval.evidence(base._expanded(spark, d), ["day", "line", "part"])
    return retrieval.membership_hash(e.where("company_id is not null"), ["cluster_id"], "group_id", "word-v1")


# --- review

def label_population(spark, d):
    ts = table(spark, d, "cluster_timeseries").distinct()
    c = ts.where("company_id = '__ALL__'").groupBy("cluster_id").agg(F.sum("n").alias("n_members"))
    fired = ts.where("company_id <> '__ALL__'").groupBy("cluster_id").agg(F.max("share").alias("s")).where("s >= 0.2")
    return review.label_population(c, fired, "labels:", 5, 30)


def label_review_draw(spark, d):
    """Documents to review: up to five of each source and label."""
    docs = table(spark, d, "documents").where("trim(text) <> ''").join(table(spark, d, "doc_labels"), "doc_id")
    return review.stratified_draw(docs.select("doc_id", "source", "toxic"), ["source", "toxic"], "doc_id", "review:", 5)


def agreement_report(spark, d):
    """How often people's label agrees with the plain guess that forum posts are the toxic ones, overall, by language and by source."""
    docs = table(spark, d, "documents").join(table(spark, d, "doc_labels"), "doc_id").withColumn("agreed", (F.col("source") == "consumer_forum") == (F.col("toxic") == 1))
    a = review.agreement_report(docs, ["lang", "source"], "doc_id", "agreed")
    return a.select("dimension", "value", "n_items", "n", "n_agreed", *(r6(F.col(c)).alias(c) for c in ("rate", "low", "high")))


def citation_report(spark, d):
    """Each test item as an answer that claims its first sentence and cites the documents that share eight words with it."""
    claim = F.regexp_extract(F.col("text"), r"^([^.?!]*)", 1)
    answers = table(spark, d, "eval_items").select(F.col("item_id").alias("answer_id"), claim.alias("claim"))
    rel = base.privacy_ngram_overlap(spark, d).select(F.col("item_id").alias("answer_id"), F.col("doc_id").alias("id"))
    cited = rel.groupBy("answer_id").agg(F.collect_set("id").alias("cited"))
    ev = rel.join(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    judged = answers.join(curation.grounded(answers.join(cited, "answer_id"), ev).select("answer_id", "grounded"), "answer_id", "left")
    return review.citation_report(judged).select("answers", "claims", "grounded", r6("validity").alias("validity"), r6("coverage").alias("coverage"), "abstained")


def usage_rollup(spark, d):
    e = table(spark, d, "events")
    return review.usage_rollup(e, ["event_type"], "value", F.col("value") >= 50).select("event_type", "n", r6("total").alias("total"), r6("mean").alias("mean"), "n_ok", "n_failed")


def enforcement_context(spark, d):
    return review.context(base._actions(spark, d), "company_id", "day", "action_id").select("company_id", "nth", "action_id", "day")


def question_hashes(spark, d):
    return table(spark, d, "eval_items").select("item_id", review.question_hash(F.col("text")).alias("hash"))


def judged_pairs(spark, d):
    """Review pairs and whether an earlier run has a link between them."""
    pairs = table(spark, d, "cluster_review_pairs").select(F.concat_ws(":", "complaint_id_a", "complaint_id_b").alias("pair"))
    return review.with_verdicts(pairs, _links(spark, d).select(F.concat_ws(":", "a", "b").alias("pair")), "pair")


def ranked_narratives(spark, d):
    """Narratives numbered by length within a family, by ranges."""
    return ranges.ranked(_stored(spark, d).select("id", "family", "char_len"), ["family"], [F.desc("char_len"), "id"]).select("id", "family", "rank")


QUERIES = (
    complaints_build, narratives_build, redaction_stats, narratives_in_window, load_reconciliation, top_companies, announced_without_narrative, identity_grouping, group_assignment, new_links, evaluation_pairs, labelled_pairs,
    gate_report, campaigns, campaign_members, flagged_share, merge_audit_pairs, distinct_text_rows, embedding_map, embedding_coverage, pending_texts, encoded_texts, gathered_rows, family_representatives, small_families,
    density_clusters, cluster_persistence, stability_halves, novel_clusters, label_selection, exemplar_members, baseline_members, baseline_numbered, topic_baseline, support_quantiles, series_readback, scope_dates,
    refit_at_cutoffs, strong_outcomes, exclusion_reasons, dense_rank, rrf_fuse, retrieval_variants, ranking_faults, retrieval_summary, win_tie_loss, scoped_evidence, scope_hashes, label_population, label_review_draw,
    agreement_report, citation_report, usage_rollup, enforcement_context, question_hashes, judged_pairs, ranked_narratives,
)


def queries() -> dict:
    return base.shipped(QUERIES)
