"""Curation, review and grounding: name lookup, merge review, worklists, run lookup, cited claims."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_prefix(names: DataFrame, canonical: DataFrame) -> DataFrame:
    """names (name) and canonical (company_id, normal) -> (name, company_id): the one canonical name whose words begin with the name's words.

    No such name, or more than one, gives null: an ambiguous lookup is refused. Joined on the first word, so each pair is met once.
    """
    words = lambda c: F.split(F.upper(F.trim(F.regexp_replace(c, r"[^A-Za-z0-9]+", " "))), " ")
    n = names.select("name").where("name is not null").distinct().withColumn("w", words(F.col("name"))).withColumn("first", F.col("w")[0])
    c = canonical.select("company_id", words(F.col("normal")).alias("cw")).withColumn("first", F.col("cw")[0])
    hit = n.join(c, "first").where(F.slice("cw", 1, F.size("w")) == F.col("w")).groupBy("name").agg(F.count_distinct("company_id").alias("k"), F.min("company_id").alias("company_id"))
    found = hit.where("k = 1").select("name", "company_id")
    return n.select("name").join(found, "name", "left")


def indel_similarity(a: str, b: str) -> float:
    """100 (|a| + |b| - indel distance) / (|a| + |b|); two empty strings are equal."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return 200 * (len(a) - s.bit_count()) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """The best of three comparisons: shared words alone with either side, and both sides, shared words first. A side whose words are all shared is 100; no words give 0."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (not x - y or not y - x):
        return 100.0
    left, right = (" ".join([w for w in (both, *sorted(d)) if w]) for d in (x - y, y - x))
    sides = [indel_similarity(left, right)]
    return max(sides + ([indel_similarity(both, left), indel_similarity(both, right)] if both else []))


def merge_review(companies: DataFrame, top: int = 300, least: float = 88) -> DataFrame:
    """companies (company_id, name, n_complaints) -> (score, id_a, name_a, n_a, id_b, name_b, n_b) of the `top` largest, pairs whose token-set ratio is `least` or more.

    For a person to decide, so the number of companies is a parameter; ties are by id. All pairs of those are compared: the list is a stated query set of `top` rows,
    which every task holds, against itself. a is the larger company. Null names are left out.
    """
    named = companies.where("name is not null and company_id is not null").select("company_id", "name", "n_complaints")
    largest = named.orderBy(F.desc("n_complaints"), "company_id").limit(top)
    held = [tuple(r) for r in largest.collect()]
    rows = companies.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(held)], f"i int, {named.schema.simpleString()[7:-1].replace(':', ' ')}").repartition(8, "i")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for i, a, name, n in pdf.itertuples(index=False):
                for b, other, m in held[i + 1 :]:
                    score = token_set_ratio(name, other)
                    if score >= least:
                        out.append((int(score), a, name, n, b, other, m))
            yield pd.DataFrame(out, columns=["score", "id_a", "name_a", "n_a", "id_b", "name_b", "n_b"])

    return rows.mapInPandas(run, "score int, id_a string, name_a string, n_a long, id_b string, name_b string, n_b long")


def blinded_worklist(candidates: DataFrame, others: DataFrame, key: str, seed: str, decoys: int) -> DataFrame:
    """(position, key): all candidates, and `decoys` of the others, in the order of a seeded hash, with nothing that tells which is which.

    Decoys are drawn by another hash from things of the same kind, so that their keys don't give them away either. A key that is both is a candidate.
    """
    draw = F.sha2(F.concat(F.lit(f"{seed}decoy:"), F.col(key).cast("string")), 256)
    drawn = others.select(key).distinct().join(candidates.select(key), key, "left_anti").orderBy(draw, key).limit(decoys)
    both = candidates.select(key).distinct().unionByName(drawn)
    return both.select(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256).alias("position"), key).orderBy("position", key)


def latest_run(runs: DataFrame, stage: str, params: dict[str, str]) -> DataFrame:
    """runs (run_id, stage, status, started_at, params_json): the newest good run of the stage whose recorded params hold these values."""
    good = runs.where((F.col("stage") == stage) & (F.col("status") == "ok"))
    for k, v in params.items():
        good = good.where(F.get_json_object("params_json", f"$.params.{k}") == v)
    return good.orderBy(F.desc("started_at"), F.desc("run_id")).limit(1)


def merge_audit(members: DataFrame, links: DataFrame) -> DataFrame:
    """members (id, seed), links (a, b) -> (seed, size, direct): how many members of a group are linked to its seed itself."""
    ends = links.select("a", "b").union(links.select("b", "a")).distinct()
    m = members.where("id <> seed")
    direct = m.join(ends, (m.id == ends.a) & (m.seed == ends.b), "left").groupBy("seed").agg(F.count(F.lit(1)).alias("others"), F.count("a").alias("direct"))
    size = members.groupBy("seed").agg(F.count(F.lit(1)).alias("size"))
    return size.join(direct, "seed", "left").select("seed", "size", F.coalesce("direct", F.lit(0)).alias("direct"))


def one_line(c: Column, most: int | None = None) -> Column:
    """c with white space as single blanks; beyond `most` characters cut off and ended with dots, for display."""
    t = F.trim(F.regexp_replace(c, r"\s+", " "))
    return t if most is None else F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - 1), F.lit("…"))).otherwise(t)


def grounded(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claims (answer_id, claim, cited array of ids) and evidence (answer_id, id, text) -> (answer_id, claim, grounded).

    A claim is grounded if it stands, white space aside, in the text of evidence it cites. Citing nothing, or something that was not
    given as evidence, is not grounded.
    """
    c = claims.withColumn("c", F.monotonically_increasing_id())
    each = c.select("c", "answer_id", F.explode("cited").alias("id"), one_line(F.col("claim")).alias("q"))
    seen = each.join(evidence, ["answer_id", "id"], "left").groupBy("c").agg(F.max(F.coalesce(F.contains(one_line(F.col("text")), F.col("q")), F.lit(False))).alias("found"), F.min(F.col("text").isNotNull()).alias("given"))
    return c.join(seen, "c", "left").select("answer_id", "claim", F.coalesce(F.col("found") & F.col("given") & (F.length(one_line(F.col("claim"))) > 0), F.lit(False)).alias("grounded"))


def exclusion_reason(actions: DataFrame) -> DataFrame:
    """actions (company_id, has_narratives, filed_date, window_start) plus reason: the first rule that excludes the action, or null."""
    return actions.withColumn(
        "reason",
        F.when(F.col("company_id").isNull(), "company not resolved").when(F.col("filed_date").isNull(), "no date").when(F.col("filed_date") < F.col("window_start"), "before the window")
        .when(~F.coalesce("has_narratives", F.lit(False)), "no narrative before filing"),
    )
