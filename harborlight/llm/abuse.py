"""Abusive, hateful and sexual content by a subsequence string kernel SVM with Nystrom landmarks.

Kernel: passages are compared by the three-character subsequences they share within five characters, each worth
DECAY to the number of characters it skips, divided by the root of both lengths; so spaced, starred, doubled and
inserted characters cost a little instead of hiding a word. The SVM (squared hinge, Newton steps) is trained on the
Nystrom features of LANDMARKS labelled passages. Its decision is a sum over landmarks, and the kernel is a sum over
subsequences, so the trained model folds into one weight a subsequence: scoring looks up six weights a character, and no kernel
is evaluated over the corpus.

Labels are per document. Passages are labelled in rounds: a document labelled abusive has one passage or more that is, one
labelled clean has none; the first round starts from words that go with the label and from the fixed seed phrases. Wrong
labels lose their say because a document without a convincing passage is left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from harborlight.llm.consistent import consistent

DECAY, LANDMARKS, RIDGE, SEED = 0.6, 768, 0.003, 20260803
#: The model is fitted on at most so many labelled documents, those with the smallest hash of their key, and on at most so many clean
#: passages of them, drawn by a fixed seed. Scoring has no such bound.
MAX_LABELLED, MAX_CLEAN_PASSAGES = 9000, 6000
#: The threshold counts for pos / (pos + SHRINK) of its fitted value: with few abusive documents to fit it on it nears 0.
SHRINK = 5
SPAN, STEP = 72, 24
#: A passage is taken as the abusive one only if at least so many of its word pairs are strange to clean documents.
MIN_NOVELTY = 0.4
#: A word pair in a larger share of clean documents is not strange, even if it goes with the label as the style of a source does.
MAX_FAMILIAR = 0.005
_PAIRS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
# Phrases that are abusive, hateful or sexual whatever surrounds them, in English and Spanish.
SEEDS = """you idiot|you moron|you stupid bastard|worthless piece of shit|fuck you|go fuck yourself|fucking asshole|you dumbass|lazy deadbeat|you filthy pig|lying rat|you dirty whore
stupid bitch|son of a bitch|i hope you die|drop dead|i will kill you|we will break your legs|i know where you live|you deserve a beating|should be shot|kill yourself|burn in hell you scum
those people are vermin|immigrants are filth|they should be wiped out|go back to your country you animals|ship them all away they poison this country|women ruin everything|subhuman trash
suck my dick|hot naked girls want sex tonight|take off your clothes sexy|he grabbed her breasts and they had sex|touched my crotch|show me your tits|hardcore porn|i want you in my bed
you clown|you parasite|you scum|you loser|you cunt|you prick|motherfucker|jackass|retard|slut
hijo de puta|eres una basura|malditos cerdos|son una mierda|ojala te mueras|vete a la mierda|pendejo|cabron|puta madre|te voy a matar|perra asquerosa""".replace("\n", "|").split("|")  # fmt: skip
# Plain passages on the subject that abuse nobody.
PLAIN = """what a damn mess|this is a hell of a headache|the caller used strong language and the call was ended|training covers sexual harassment and hate incidents
collectors must not use obscene or profane language|the policy defines abusive conduct as repeated contact|a darn circus|the customer raised his voice|this problem killed my credit score
the manual explains how staff report bias incidents""".split("\n")  # fmt: skip

_ALPHABET = " abcdefghijklmnopqrstuvwxyz0123456789@$*!-._'#+|"
_LUT = np.full(256, 63, np.uint8)
for _i, _c in enumerate(_ALPHABET):
    _LUT[ord(_c)] = _i
#: Stands between passages; no subsequence with it counts.
_GAP, _GAP_CODE = "\0" * 4, 62
_LUT[0] = _GAP_CODE
_BREAK = re.compile(r"(?<=[.!?])[\s\"”’)]+|[\n\r]+|(?<=[.!?][\"”’)])\s+")
_RUN_OF_DIGITS, _BLANKS = re.compile(r"\d{2,}"), re.compile(r"\s+")


def plain(text: str) -> str:
    """Consistent form, lower case, no accents, numbers as 0; line breaks stay."""
    t = consistent(text).lower()
    if not t.isascii():
        t = "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c))
    return _RUN_OF_DIGITS.sub("0", t).replace("\0", " ")


def passages(text: str) -> list[str]:
    """Sentences; a long one as overlapping stretches of SPAN characters, so that all text is in some passage."""
    out = []
    for s in _BREAK.split(plain(text)):
        s = s.strip()
        if len(s) > 1.25 * SPAN:
            out += [s[i : i + SPAN] for i in range(0, max(1, len(s) - SPAN + STEP), STEP)]
        elif s:
            out.append(s)
    return out


def _codes(joined: str) -> np.ndarray:
    return _LUT[np.frombuffer(joined.encode("latin-1", "replace"), np.uint8)].astype(np.uint32)


def subsequences(items: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, subsequence, weight) of all passages, and each passage's scale."""
    lens = np.array([len(s) + 2 for s in items], np.int64)
    a = _codes("".join(f" {s} " for s in items))
    row = np.repeat(np.arange(len(items)), lens)
    rs, us, ws = [], [], []
    for i, j in _PAIRS:
        n = len(a) - j
        if n <= 0:
            continue
        inside = row[:n] == row[j:]
        us.append((((a[:n] << 12) | (a[i : i + n] << 6) | a[j:]))[inside])
        rs.append(row[:n][inside])
        ws.append(np.full(int(inside.sum()), DECAY ** (j - 2), np.float32))
    cat = lambda xs, t: np.concatenate(xs) if xs else np.empty(0, t)
    return cat(rs, np.int64), cat(us, np.uint32), cat(ws, np.float32), 1 / np.sqrt(lens)


def position_scores(joined: str, weights: np.ndarray) -> np.ndarray:
    """What the subsequences starting at each character add to the decision."""
    a = _codes(joined)
    total = np.zeros(len(a), np.float32)
    for i, j in _PAIRS:
        n = len(a) - j
        if n > 0:
            total[:n] += np.float32(DECAY ** (j - 2)) * weights[(a[:n] << 12) | (a[i : i + n] << 6) | a[j:]]
    return total


class Model:
    """Folded weights, a bias, and the decision above which a document counts as abusive."""

    def __init__(self, weights: np.ndarray, bias: float, threshold: float):
        cube = weights.reshape(64, 64, 64).copy()
        cube[_GAP_CODE], cube[:, _GAP_CODE], cube[:, :, _GAP_CODE] = 0, 0, 0
        self.weights, self.bias, self.threshold = cube.ravel(), bias, threshold

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The highest decision of a passage of each text; -9 for texts without any."""
        out = np.full(len(texts), -9.0)
        items, owner = [], []
        for k, t in enumerate(texts):
            if t:
                p = passages(t)
                items += p
                owner += [k] * len(p)
        if not items:
            return out
        np.maximum.at(out, np.array(owner), _passage_scores(self, items))
        return out


def _fit_svm(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float) -> np.ndarray:
    """Squared hinge SVM in the primal by Newton steps; the last weight is the bias."""
    z1 = np.hstack([z, np.ones((len(z), 1))])
    reg = np.eye(z1.shape[1]) * ridge
    reg[-1, -1] = 1e-6
    w = np.zeros(z1.shape[1])
    for _ in range(25):
        active = y * (z1 @ w) < 1
        za, ca = z1[active], cost[active]
        new = np.linalg.solve(reg + (za * ca[:, None]).T @ za, (za * ca[:, None]).T @ y[active])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def _train(pos: list[str], neg: list[str], hard: list[str], rng: np.random.Generator, landmarks: int, ridge: float) -> tuple[np.ndarray, float]:
    """Weights by subsequence and a bias, from labelled passages."""
    part = landmarks * 2 // 5
    chosen = [pos[i] for i in rng.permutation(len(pos))[:part]]
    chosen += [hard[i] for i in rng.permutation(len(hard))[: landmarks * 3 // 10]]
    chosen += [neg[i] for i in rng.permutation(len(neg))[: landmarks - len(chosen)]]
    neg = neg + hard
    r, u, w, scale = subsequences(chosen)
    used, inv = np.unique(u, return_inverse=True)
    place = np.full(1 << 18, -1, np.int32)
    place[used] = np.arange(len(used))
    phi = np.zeros((len(chosen), len(used)), np.float32)
    np.add.at(phi, (r, inv), w)
    phi *= scale[:, None].astype(np.float32)
    kmm = (phi @ phi.T).astype(np.float64)
    values, vectors = np.linalg.eigh(kmm)
    keep = values > 1e-6 * values[-1]
    root = vectors[:, keep] / np.sqrt(values[keep])
    items = pos + neg
    rows = []
    for lo in range(0, len(items), 256):
        part = items[lo : lo + 256]
        r, u, w, s = subsequences(part)
        at = place[u]
        known = at >= 0
        x = np.zeros((len(part), len(used)), np.float32)
        np.add.at(x, (r[known], at[known]), w[known])
        rows.append((x @ phi.T) * s[:, None])
    z = np.vstack(rows) @ root
    y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
    cost = np.where(y > 0, 0.5 * len(y) / max(1, len(pos)), 0.5 * len(y) / max(1, len(neg))) / len(y) * 100
    cost = np.where(y > 0, np.minimum(cost, 8 * cost.min()), cost)
    v = _fit_svm(z, y, cost, ridge)
    folded = np.zeros(1 << 18, np.float32)
    folded[used] = phi.T @ (root @ v[:-1])
    return folded, float(v[-1])


def _disguised(phrase: str, rng: np.random.Generator) -> str:
    """The phrase with its longest word dotted, starred, doubled or with look-alike digits."""
    words = phrase.split()
    k = max(range(len(words)), key=lambda i: len(words[i]))
    w, how = words[k], int(rng.integers(5))
    if how == 0:
        w = "-.* "[int(rng.integers(3))].join(w)
    elif how == 1:
        w = w[0] + "*" * (len(w) - 2) + w[-1]
    elif how == 2:
        w = w.translate(str.maketrans("aeios", "431" + "0$"))
    elif how == 3:
        i = int(rng.integers(len(w)))
        w = w[:i] + w[i] * 3 + w[i + 1 :]
    else:
        i = int(rng.integers(1, len(w) - 1)) if len(w) > 2 else 1
        w = w[:i] + "*" + w[i + 1 :]
    return " ".join([*words[:k], w, *words[k + 1 :]])


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, ridge: float = RIDGE, rounds: int = 4) -> Model:
    """The model from document labels. Without any labelled document it rests on the seeds alone."""
    rng = np.random.default_rng(SEED)
    docs = [passages(t) if t else [] for t in texts]
    y = np.array([int(v) for v in labels], np.int64)
    seeds = [*SEEDS, *(_disguised(s, rng) for s in SEEDS for _ in range(2))]
    pool = list(dict.fromkeys(p for d, v in zip(docs, y) if not v for p in d))
    clean = [pool[i] for i in sorted(rng.permutation(len(pool))[: MAX_CLEAN_PASSAGES // 2])] + PLAIN
    dirty = [d for d, v in zip(docs, y) if v and d]
    # pairs of words that clean documents hardly have tell where in a labelled document to look
    seen = [Counter(), Counter()]
    for d, v in zip(docs, y):
        seen[v].update({w for p in d for w in _word_pairs(p)})
    n1, n0 = max(1, len(dirty)), max(1, len(docs) - len(dirty))
    strange = lambda w: seen[0][w] * n1 < 0.25 * seen[1][w] * n0 and seen[0][w] < MAX_FAMILIAR * n0
    novelty = np.array([np.mean([strange(w) for w in _word_pairs(p)]) for d in dirty for p in d])
    flat = [p for d in dirty for p in d]
    long_enough = np.array([len(p.split()) >= 4 for p in flat], bool)
    familiar = [p for p, v in zip(flat, novelty) if v < 0.15][: MAX_CLEAN_PASSAGES // 5]
    weights, bias = _train(seeds, clean, [], rng, landmarks, ridge)
    for k in range(rounds):
        f = _passage_scores(Model(weights, bias, 0.0), flat)
        g = np.where((novelty >= MIN_NOVELTY) & long_enough, f + novelty * (1.0, 0.5, 0.2, 0.1, 0.0)[min(k, 4)], -9.0)
        found, i = [], 0
        for d in dirty:
            own = g[i : i + len(d)]
            top = int(own.argmax())
            if own[top] > (-0.4, -0.5, -0.4, -0.3, -0.3)[min(k, 4)]:
                found.append(d[top])
            found += [d[j] for j in range(len(d)) if j != top and own[j] > 0.2]
            i += len(d)
        hardest = np.argsort(-_passage_scores(Model(weights, bias, 0.0), pool), kind="stable")[: MAX_CLEAN_PASSAGES // 2]
        weights, bias = _train(list(dict.fromkeys(found)) + seeds[:: 1 + k], clean + familiar, [pool[i] for i in hardest], rng, landmarks, ridge)
    return Model(weights, bias, _threshold(Model(weights, bias, 0.0), texts, y))


def _word_pairs(passage: str) -> list[tuple[str, str]]:
    w = passage.split()
    return list(zip(w, w[1:])) or [("", passage)]


def _passage_scores(m: Model, items: list[str]) -> np.ndarray:
    if not items:
        return np.empty(0)
    lens = np.array([len(s) + 2 for s in items], np.int64)
    at = position_scores("".join(f" {s} {_GAP}" for s in items), m.weights)
    ends = np.cumsum(lens + 4)
    cum = np.concatenate([[0.0], np.cumsum(at, dtype=np.float64)])
    return (cum[ends - 4] - cum[ends - 4 - lens]) / np.sqrt(lens) + m.bias


def _threshold(m: Model, texts: list[str], y: np.ndarray) -> float:
    """The middle of the decisions that do best in F1 on the labelled documents, the nearer to 0 the fewer of them are abusive."""
    s = m.scores(texts)
    grid = np.linspace(-0.2, 0.6, 33)
    f1 = np.array([2 * ((s > t) & (y == 1)).sum() / max(1, (s > t).sum() + y.sum()) for t in grid])
    return float(np.median(grid[f1 >= f1.max() - 0.004])) * float(y.sum() / (y.sum() + SHRINK))


def fit_labelled(docs: DataFrame, key: str, text: str, labels: DataFrame, label: str, max_docs: int = MAX_LABELLED) -> Model:
    """fit() on at most max_docs labelled documents, those whose key has the smallest hash; docs is read once.

    Null texts, keys and labels are left out. A document labelled both ways is taken with both.
    """
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).distinct()
    slot = F.pmod(F.xxhash64("__k"), F.lit(1 << 40))
    # only a few more rows than wanted pass, so what is sorted is bounded whatever the number of partitions
    bound = int(min(1.0, (1.2 * max_docs + 1000) / max(1, marked.count())) * (1 << 40))
    sample = marked.where(slot < bound).orderBy(slot, "__k", "__y").limit(max_docs)
    told = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("__k"), F.col(text).alias("__t"))
    rows = told.join(F.broadcast(sample), "__k").orderBy(slot, "__k", "__y").select("__t", "__y").collect()  # max_docs rows are broadcast
    return fit([r[0] for r in rows], [int(r[1] > 0) for r in rows])


def score_documents(docs: DataFrame, key: str, text: str, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, *keep, score, abusive) for each row; null and empty texts score -9 and aren't abusive."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    cols = docs.select(key, *keep, F.col(text).alias("__t"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols.schema if f.name != "__t") + ", score double, abusive boolean"

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = held.value
        for pdf in it:
            for lo in range(0, len(pdf), 1000):
                part = pdf.iloc[lo : lo + 1000]
                s = m.scores([t if isinstance(t, str) else None for t in part["__t"]])
                yield part.drop(columns="__t").assign(score=np.round(s, 6), abusive=s > m.threshold)

    return cols.mapInPandas(run, schema)


def source_rates(scored: DataFrame, source: str) -> DataFrame:
    """(source, n_docs, n_abusive, rate), null sources as one."""
    g = scored.groupBy(source).agg(F.count(F.lit(1)).alias("n_docs"), F.count_if("abusive").alias("n_abusive"))
    return g.withColumn("rate", F.col("n_abusive") / F.col("n_docs"))
