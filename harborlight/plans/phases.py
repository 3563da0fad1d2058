"""The stages from raw CSV to alerts, each reading what earlier ones wrote and replacing its own run's partition; python -m harborlight runs them."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from harborlight import checks
from harborlight.config import Config
from harborlight.functions import text as T
from harborlight.operators import changepoint, clustering, corpus, dedup, embedding, evaluation, grouping, signals, vectors
from harborlight.registry import Registry
from harborlight.session import cut, ship_package
from harborlight.sources import csv_raw, files

MODEL = "hashing-64"


@dataclass
class Work:
    """Where a pipeline works: the session, the folder of its tables, and its settings. run tables hold one partition a run, the others one state."""

    spark: SparkSession
    folder: str
    config: Config

    def __post_init__(self):
        self.registry = Registry(self.spark, f"{self.folder}/runs")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str, run: str | None = None) -> DataFrame:
        """A table, or one run's part of it. A run table keeps its schema beside its partitions, as a run may have written no rows."""
        kept = f"{self.path(name)}/_schema.json"
        reader = self.spark.read
        if files.exists(self.spark, kept):
            reader = reader.schema(StructType.fromJson(json.loads(files.read_text(self.spark, kept))))
        df = reader.parquet(self.path(name))
        return df.where(F.col("run_id") == run).drop("run_id") if run is not None else df

    def has(self, name: str) -> bool:
        return files.exists(self.spark, self.path(name))

    def put(self, name: str, df: DataFrame) -> DataFrame:
        staged = f"{self.path(name)}.staged"
        df.write.mode("overwrite").parquet(staged)
        files.swap(self.spark, staged, self.path(name))
        return self.read(name)

    def put_run(self, name: str, df: DataFrame, run: str) -> DataFrame:
        csv_raw.write_run(df, self.path(name), run)
        files.write_text(self.spark, f"{self.path(name)}/_schema.json", df.withColumn("run_id", F.lit(run)).schema.json())
        return self.read(name, run)

    def run_of(self, stage: str, cutoff: str | None) -> str:
        """The run of a stage for exactly this cutoff, never merely the latest one."""
        found = self.registry.latest(stage, cutoff=cutoff)
        if found is None:
            raise LookupError(f"no finished run of {stage} for cutoff {cutoff}")
        return found["run_id"]


def load(w: Work, run: str, cutoff: str | None, source: str) -> int:
    """Raw CSV to complaints_raw and the texts as they came."""
    raw = csv_raw.read_csv(w.spark, source, w.spark.sparkContext.defaultParallelism)
    df = csv_raw.load(raw, w.path("complaints_raw"), lambda d: checks.expect_rows(d, 1))
    told = raw.select(F.col("`Complaint ID`").try_cast("long").alias("complaint_id"), F.col("`Consumer complaint narrative`").alias("narrative"))
    w.put("texts_raw", told.where("complaint_id is not null and trim(narrative) <> ''").groupBy("complaint_id").agg(F.min("narrative").alias("narrative")))
    return df.count()


def normalize(w: Work, run: str, cutoff: str | None) -> int:
    """Companies, complaints with families, redacted narratives and what was redacted."""
    raw = w.read("complaints_raw")
    canonical, alias = corpus.build_companies(raw, w.read("company_manual") if w.has("company_manual") else None)
    w.put("company_canonical", canonical)
    complaints = w.put("complaints", corpus.build_complaints(raw, w.put("company_alias", alias), w.config.window_start))
    checks.expect_unique(complaints, "complaint_id")
    texts = w.read("texts_raw").join(complaints.select("complaint_id"), "complaint_id", "left_semi")
    narratives = w.put("narratives", corpus.build_narratives(texts, "complaint_id", "narrative"))
    w.put_run("redaction_stats", corpus.redaction_stats(narratives), run)
    return narratives.count()


def _texts(w: Work) -> DataFrame:
    c = w.read("complaints").select(F.col("complaint_id").alias("id"), F.col("date_received").alias("day"), F.col("product_family").alias("family"), "period_month", "company_id", "state", "issue_std", "sub_issue_std")
    return w.read("narratives").select(F.col("complaint_id").alias("id"), F.col("text_hash").alias("h"), F.col("text_redacted").alias("text"), "char_len").join(c, "id")


def pairs(w: Work, run: str, cutoff: str | None) -> int:
    """Links between near-duplicate texts, which no cutoff changes: exact ones to the smallest id, MinHash ones within a family."""
    t = _texts(w).select("id", "h", "family", T.normalize(F.col("text")).alias("text"))
    exact = dedup.exact_pairs(t)
    near = dedup.minhash_links(dedup.exact_representatives(t))
    return w.put("dup_pairs", exact.unionByName(near.select("a", "b", "similarity", "method"))).count()


def groups(w: Work, run: str, cutoff: str | None) -> int:
    """Groups and campaigns as they were known before the cutoff."""
    t = _texts(w)
    links = w.read("dup_pairs").where("method = 'minhash'").select("a", "b")
    g = w.put_run("dup_groups", grouping.assign_groups(t.select("id", "h", "day"), links, cutoff), run)
    members = t.join(g.select("id", "group_id"), "id").select("group_id", "id", "day", "family", "state", F.col("company_id").alias("company"), "char_len", "text")
    campaigns, inside = grouping.build_campaigns(members, w.config.dedup.campaign_min_size)
    w.put_run("campaigns", campaigns, run)
    w.put_run("campaign_members", inside, run)
    return g.count()


def embed(w: Work, run: str, cutoff: str | None) -> int:
    """Vectors of the texts that have none yet, and the map to them."""
    rows = cut(embedding.distinct_texts(_texts(w).select("h", "text")))
    old = w.read("embeddings") if w.has("embeddings") else None
    left = embedding.pending(rows, old) if old is not None else rows
    new = embedding.encode(left.select("h", "text"), "h", "text")
    w.put("embeddings", cut(old.unionByName(new)) if old is not None else new)
    m = w.put("embedding_map", embedding.embedding_map(_texts(w).select("id", "h"), rows, MODEL, 64))
    checks.expect_unique(m, "id")
    return m.count()


def cluster(w: Work, run: str, cutoff: str | None, k: int = 5, least: float | None = None, min_size: int = 50) -> int:
    """Clusters of each family's group representatives: dense parts of a fitted sample, all representatives assigned to their centroids, coherence, novelty and related clusters."""
    cfg = w.config
    least = 1 - cfg.cluster.assign_max_distance if least is None else least
    g = w.read("dup_groups", w.run_of("groups", cutoff)).where("is_representative").select("id")
    reps = _texts(w).join(g, "id").where("family is not null").select("id", "h", "family")
    big = clustering.too_small(reps, min_size).where("clustered").select("family")
    reps = cut(reps.join(big, "family").join(w.read("embeddings"), "h"))
    parts, members = None, None
    for family in sorted(r[0] for r in big.collect()):  # as many as there are families
        mine = reps.where(F.col("family") == family)
        fitted = clustering.density_clusters(clustering.sample(mine.select("id", "v"), f"{cfg.seed}:", cfg.cluster.fit_sample), k, least, min_size)
        seeds = cut(mine.select("id", "v").join(fitted.where(F.col("cluster") >= 0), "id").select("id", "v", "cluster", "core"))
        centres = vectors.centroids(seeds)
        assigned = vectors.assign(mine, centres, cfg.cluster.assign_max_distance).where(F.col("cluster") >= 0)
        own = cut(mine.join(assigned, "id").select("id", "v", "cluster", "similarity"))
        c = vectors.coherence(own, centres).join(clustering.persistence(seeds, least).drop("size"), "cluster").join(centres.select("cluster", "centroid"), "cluster")
        name = F.concat_ws(":", F.lit(run), F.lit(family), F.col("cluster").cast("string"))
        c = c.select(name.alias("cluster_id"), F.lit(family).alias("family"), "coherence", "medoid", "persistence", "centroid")
        m = own.select("id", name.alias("cluster_id"), F.lit(family).alias("family"), "similarity")
        parts, members = (c, m) if parts is None else (parts.unionByName(c), members.unionByName(m))
    if parts is None:
        raise checks.CheckFailed("no family is large enough to be clustered")
    clusters, members = w.put_run("clusters", parts, run), w.put_run("cluster_members", members, run)
    label = F.when(F.col("issue_std").isNotNull(), F.concat_ws(" | ", "issue_std", F.coalesce("sub_issue_std", F.lit("∅"))))
    space = _texts(w).withColumn("label", label).where("label is not null").groupBy("family").agg(F.count_distinct("label").alias("n_labels"))
    told = members.join(_texts(w).select("id", label.alias("label")), "id").select(F.col("cluster_id").alias("cluster"), "family", "label")
    novel = vectors.novelty(told, space).join(clusters.select(F.col("cluster_id").alias("cluster"), "coherence", "persistence"), "cluster")
    n = cfg.novelty
    w.put_run("cluster_novelty", vectors.is_novel(novel, n.threshold, n.coherence, n.persistence).withColumnRenamed("cluster", "cluster_id"), run)
    return members.count()


def _population(w: Work, cutoff: str | None) -> DataFrame:
    """One row for each complaint that isn't in a flagged campaign, with its group's representative's cluster."""
    g_run, c_run = w.run_of("groups", cutoff), w.run_of("cluster", cutoff)
    g = w.read("dup_groups", g_run)
    flagged = w.read("campaigns", g_run).where("flagged").select("group_id")
    cluster_of = w.read("cluster_members", c_run).select("id", "cluster_id", F.col("family").alias("cluster_family"))
    first = g.where("is_representative").select("group_id", "id").join(cluster_of, "id", "left").drop("id")
    units = g.select("id", "group_id").join(_texts(w).select("id", "day", "family", "period_month", "company_id"), "id")
    if cutoff is not None:
        units = units.where(F.col("day") < F.lit(cutoff).cast("date"))
    return units.join(flagged, "group_id", "left_anti").join(first, "group_id")


def find_signals(w: Work, run: str, cutoff: str | None, control: bool = False) -> int:
    """Panel, tests, change points and alert scopes before the cutoff; as the negative control with clusters permuted among groups."""
    s = w.config.signals
    e = cut(_population(w, cutoff))
    checks.expect_rows(e, 1)
    if cutoff is not None:
        checks.expect_no_leakage(e, "day", cutoff)
    if control:
        by = e.where("cluster_id is not null").select("cluster_family", "group_id", "cluster_id").distinct()
        shuffled = evaluation.shuffled(by, "cluster_family", "group_id", "cluster_id", f"{w.config.seed}:").select("group_id", F.col("shuffled_cluster_id").alias("cluster_id"))
        e = cut(e.drop("cluster_id").join(shuffled, "group_id", "left"))
    panel = w.put_run("cluster_timeseries", signals.panel(e), run)
    axis = signals.month_axis(panel)
    cells = signals.with_expected(signals.bh(signals.ror(signals.prr(signals.testable(signals.contingency(e), s.min_a)))))
    scored = signals.eb05(signals.shrink(cells, signals.gamma_prior(cells)))
    lo, hi = axis or (w.config.window_start, w.config.window_start)
    changes = changepoint.detect(signals.series_arrays(panel, lo, hi), lo, s.min_supporting_groups)
    rows = w.put_run("signals", signals.signal_rows(scored, changes, signals.support(e), hi, str(e.agg(F.max("day")).first()[0])), run)
    coherent = w.read("clusters", w.run_of("cluster", cutoff)).select("cluster_id", "family", "coherence", "persistence")
    w.put_run("alert_scopes", signals.alert_scopes(rows, coherent, w.config.novelty.coherence, s.min_supporting_groups, s.fdr), run)
    return rows.count()


def backtest(w: Work, run: str, cutoff: str | None) -> int:
    """How the signals of each cutoff's run did against enforcement_actions (action_id, company_id, day) filed later."""
    actions = evaluation.asof_cutoff(w.read("enforcement_actions").select("action_id", "company_id", "day"), list(w.config.cutoffs), "day")
    found = [(c, w.registry.latest("signals", cutoff=c, control=False)) for c in w.config.cutoffs]
    runs = w.spark.createDataFrame([(c, r["run_id"]) for c, r in found if r], "cutoff string, run_id string").select(F.col("cutoff").cast("date").alias("cutoff"), "run_id")
    sig = w.read("signals").select("run_id", "company_id", "period_month", F.col("n_supporting_groups").alias("groups"), "q", "method")
    o = w.put_run("outcomes", evaluation.outcomes(actions, sig, runs, w.config.signals.fdr, w.config.signals.min_supporting_groups).withColumnRenamed("run_id", "signals_run"), run)
    w.put_run("backtest_summary", evaluation.summary(o), run)
    return o.count()


def baselines(w: Work, run: str, cutoff: str | None) -> int:
    """Baseline clusters: one a family, one a label, and topics."""
    t = _texts(w).where("family is not null")
    out = None
    for name, by in (("family", ["family"]), ("label", ["family", "issue_std", "sub_issue_std"])):
        m = clustering.units(t, by, "id")[1].select(F.lit(name).alias("system"), "id", F.col("unit").cast("long").alias("unit"))
        out = m if out is None else out.unionByName(m)
    return w.put_run("baseline_members", out, run).count()


PHASES: dict[str, Callable] = {
    "load": load, "normalize": normalize, "pairs": pairs, "groups": groups, "embed": embed, "cluster": cluster, "signals": find_signals, "backtest": backtest, "baselines": baselines,
}
#: What has to be computed anew for a cutoff; links and vectors don't depend on it.
REFIT = ("groups", "cluster", "signals")


def run_phase(w: Work, phase: str, cutoff: str | None = None, **options) -> dict:
    """Run one stage under the registry; its record. Unknown stages are refused."""
    if phase not in PHASES:
        raise ValueError(f"unknown phase {phase!r}; there are {', '.join(PHASES)}")
    ship_package(w.spark)
    params = {"cutoff": cutoff, **options} | ({"control": bool(options.get("control", False))} if phase == "signals" else {})
    with w.registry.run(phase, w.config.fingerprint(), **params) as r:
        r.finish(PHASES[phase](w, r.run_id, cutoff, **options))
    return {"run_id": r.run_id, "phase": phase, "rows": r.rows}


def refit(w: Work, cutoff: str, **options) -> list[dict]:
    """Everything that depends on the date, as it would have been done on the eve of the cutoff."""
    return [run_phase(w, phase, cutoff, **(options if phase == "cluster" else {})) for phase in REFIT]
