"""Toxicity by subword bags.

A window is the average of the embeddings of its character n-grams and its whole words, put through a linear softmax;
both are trained jointly in numpy. A text scores by its worst window of one or two words, so neither a long clean text nor
a long clean neighbour hides a short insult, and a misspelling that was never seen still shares most n-gram vectors with
the word. For scoring, embeddings and softmax fold into one number for each bucket. The logistic curve that turns the
worst window into a score is fitted on texts kept apart from training.

Labels come from a bounded sample of training rows (most_toxic, most_clean, the lowest by a hash of doc_id); every text
is scored whole. Defined cases: texts without words, null and empty ones included, score nearly 0; null doc_ids and labels are never
trained on; repeated labels of one doc_id count as toxic if any is; without both classes all scores are 0; columns other
than the named ones pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._text import LOWER, byte_table, prefix_hash, slices, span_hash

SIZES = (3, 4, 5)
BUCKET_BITS = 21
#: Marks that end a word as a space does.
BREAKS = b" \t\n\x0b\x0c\r.,;:!?\"()[]#$%&*|"
FOLD = LOWER.copy()
FOLD[list(BREAKS)] = 32
TABLE = (byte_table(11) >> np.uint64(32)).astype(np.uint32)
WORDS = byte_table(12)
#: Log-likelihood ratio from which a word of a toxic text is learned as toxic.
SURE = 5.0
#: What a text without words has for its worst window.
NOTHING = -1e9
STEP, SPREAD = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def grams(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, valid) of the n-gram starting at each byte; one valid has no break inside, only at its ends."""
    x = TABLE[raw]
    h = x[: len(x) - size + 1].copy()
    for k in range(1, size):
        h *= STEP
        h += x[k : len(x) - size + 1 + k]
    h *= SPREAD
    breaks = np.zeros(len(raw) + 1, dtype=np.int32)
    np.cumsum(raw == 32, out=breaks[1:])
    n = len(h)
    return (h >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), breaks[size - 1 : size - 1 + n] == breaks[1 : 1 + n]


def folded(offs: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case bytes with one break around every text, and the new offsets."""
    n = len(offs) - 1
    out = np.full(len(raw) + n + 1, 32, dtype=np.uint8)
    at = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(offs))
    out[at] = FOLD[raw]
    return offs + np.arange(n + 1), out


def whole_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, valid) at each byte; valid where a word starts."""
    edge = np.diff((raw != 32).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bucket, valid = np.zeros(len(raw), dtype=np.int32), np.zeros(len(raw), dtype=bool)
    bucket[starts] = (span_hash(prefix_hash(raw, WORDS), starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
    valid[starts] = True
    return bucket, valid


def features(raw: np.ndarray):
    """(bytes, bucket, valid) of the n-grams of each size, and of whole words by their first byte."""
    for s in SIZES:
        if len(raw) >= s:
            yield s, *grams(raw, s)
    if len(raw):
        yield 1, *whole_words(raw)


def windows(offs: np.ndarray, raw: np.ndarray, sizes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first byte, end byte, text), by text, of all windows of so many words; a text of fewer words is one window."""
    edge = np.diff((raw != 32).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    first = np.searchsorted(starts, offs)
    counts, got = np.diff(first), []
    for words in sizes:
        per = np.where(counts > 0, np.maximum(1, counts - words + 1), 0)
        text = np.repeat(np.arange(len(counts)), per)
        lo = first[text] + np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
        hi = np.minimum(lo + words, first[text + 1]) - 1
        got.append((starts[lo] - 1, ends[hi] + 1, text))
    lo, hi, text = (np.concatenate(x) for x in zip(*got, strict=True))
    order = np.argsort(text, kind="stable")
    return lo[order], hi[order], text[order]


def window_means(raw: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Mean weight of the valid features within each window."""
    total, count = np.zeros(len(lo)), np.zeros(len(lo))
    for s, bucket, valid in features(raw):
        v = np.where(valid, weight[bucket], np.float32(0))
        c, n = np.zeros(len(v) + 1), np.zeros(len(v) + 1, dtype=np.int64)
        np.cumsum(v, out=c[1:])
        np.cumsum(valid, out=n[1:])
        end = np.maximum(np.minimum(hi - s + 1, len(v)), lo)
        lo_ = np.minimum(lo, len(v))
        end = np.minimum(end, len(v))
        total += c[end] - c[lo_]
        count += n[end] - n[lo_]
    return total / np.maximum(count, 1)


def window_ids(raw: np.ndarray, lo: int, hi: int) -> np.ndarray:
    out = [bucket[valid] for _, bucket, valid in features(raw[lo:hi])]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int32)


class Model:
    def __init__(self, weight: np.ndarray, scale: float = 1.0, bias: float = 0.0, words: tuple[int, ...] = (1, 2)):
        self.weight, self.scale, self.bias, self.words = weight.astype(np.float32), scale, bias, words

    def worst(self, texts: pa.Array) -> np.ndarray:
        """Largest window mean of each text; NOTHING for one without words."""
        out = np.full(len(texts), NOTHING)
        for i, j, offs, raw in slices(pc.utf8_lower(texts.cast(pa.large_string()))):
            offs, raw = folded(offs, raw)
            lo, hi, text = windows(offs, raw, self.words)
            if len(text):
                mean = window_means(raw, lo, hi, self.weight)
                heads = np.flatnonzero(np.diff(text, prepend=-1))
                out[i + text[heads]] = np.maximum.reduceat(mean, heads)
        return out

    def proba(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.worst(texts) + self.bias, -60, 60)))


def train(texts: list[str], toxic: np.ndarray, words: tuple[int, ...] = (1, 2), apart: float = 0.25, seed: int = 5, **more) -> Model:
    """The model of all texts, and the curve of one that has not seen the texts it is fitted on."""
    toxic = np.asarray(toxic, dtype=bool)
    if not toxic.any() or toxic.all():
        return Model(np.zeros(1 << BUCKET_BITS), 0.0, -60.0, words)
    rng, away = np.random.default_rng(seed), np.zeros(len(texts), dtype=bool)
    for kind in (toxic, ~toxic):
        own = rng.permutation(np.flatnonzero(kind))
        away[own[: int(apart * len(own))]] = True
    away = away if toxic[away].any() and not toxic[away].all() else np.ones(len(texts), dtype=bool)
    seen = ~away if (~away).any() else away
    model = Model(weights([t for t, s in zip(texts, seen, strict=True) if s], toxic[seen], words, seed=seed, **more), words=words)
    x = model.worst(pa.array([t for t, s in zip(texts, away, strict=True) if s], pa.large_string()))
    some = x > NOTHING
    scale, bias = platt(x[some], toxic[away][some].astype(float)) if some.any() else (0.0, -60.0)
    return Model(weights(texts, toxic, words, seed=seed, **more), scale, bias, words)


def weights(texts: list[str], toxic: np.ndarray, words: tuple[int, ...], dim: int = 6, rounds: int = 2, epochs: int = 30, rate: float = 0.1, top: int = 3, hard: int = 6, seed: int = 5) -> np.ndarray:
    """Trained on the windows of toxic texts that are surest to be toxic by their features, and on windows of clean texts: some random ones, and in each round the worst by the model so far."""
    rng = np.random.default_rng(seed)
    bags = [folded(np.array([0, len(b)]), np.frombuffer(b, dtype=np.uint8)) for b in (t.lower().encode() for t in texts)]
    spans = [windows(o, r, words)[:2] for o, r in bags]
    seen = np.zeros((2, 1 << BUCKET_BITS))
    for (_, r), t in zip(bags, toxic, strict=True):
        seen[int(t), np.unique(window_ids(r, 0, len(r)))] += 1
    weight = evidence(seen, np.array([(~toxic).sum(), toxic.sum()]))
    ids, label = [], []
    for (_, r), t in zip(bags, toxic, strict=True):
        if t:
            for a, e in surest(r, weight, top):
                ids.append(window_ids(r, a, e))
                label.append(True)
    if not ids:  # too few labels for any word to stand out
        for (_, r), (lo, hi), t in zip(bags, spans, toxic, strict=True):
            if t and len(lo):
                w = int(window_means(r, lo, hi, weight).argmax())
                ids.append(window_ids(r, lo[w], hi[w]))
                label.append(True)
    if not ids:
        return np.zeros(1 << BUCKET_BITS)
    for _ in range(rounds):
        for (_, r), (lo, hi), t in zip(bags, spans, toxic, strict=True):
            if t or not len(lo):
                continue
            means = window_means(r, lo, hi, weight)
            worst = np.argpartition(-means, hard - 1)[:hard] if len(means) > hard else np.arange(len(means))
            for w in {*worst.tolist(), *rng.integers(len(lo), size=top).tolist()}:
                if len(g := window_ids(r, lo[w], hi[w])):
                    ids.append(g)
                    label.append(False)
        weight = fit(ids, np.array(label, dtype=float), dim, epochs, rate, rng)
    return weight


def surest(raw: np.ndarray, weight: np.ndarray, top: int) -> list[tuple[int, int]]:
    """(first byte, end byte) of the words of a text that are surest to be toxic as whole words: n-grams that an insult shares with a common word say nothing here."""
    bucket, valid = whole_words(raw)
    starts = np.flatnonzero(valid)
    own = weight[bucket[starts]]
    best = own.argsort(kind="stable")[::-1][:top]
    best = best[own[best] >= max(SURE, own.max() / 2)] if len(own) else best
    ends = np.flatnonzero(np.diff((raw != 32).astype(np.int8), prepend=0, append=0) == -1)
    return [(int(starts[k]) - 1, int(ends[k]) + 1) for k in best]


def evidence(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How far a feature's share among toxic texts exceeds that among all, as a log-likelihood ratio; 0 where it does not."""
    both = np.maximum(seen.sum(0), 1e-9)
    term = lambda a, p: a * np.log(np.maximum(a, 1e-9) / (both * p))
    share = n / n.sum()
    return np.where(seen[1] > both * share[1], term(seen[1], share[1]) + term(seen[0], share[0]), 0.0)


def fit(ids: list[np.ndarray], y: np.ndarray, dim: int, epochs: int, rate: float, rng: np.random.Generator) -> np.ndarray:
    """Embeddings and softmax together, by Adam over all windows; folded into a weight for each bucket."""
    flat, count = np.concatenate(ids), np.array([len(g) for g in ids])
    used, flat = np.unique(flat, return_inverse=True)
    row = np.repeat(np.arange(len(ids)), count)
    heads = np.cumsum(count) - count
    params = [rng.normal(0, 0.1, (len(used), dim)), rng.normal(0, 0.5, (dim, 2)), np.zeros(2)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    target = np.stack([1 - y, y], 1)
    for epoch in range(1, epochs + 1):
        e, w, b = params
        mean = np.add.reduceat(e[flat], heads, axis=0) / count[:, None]
        z = mean @ w + b
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        d = (p - target) * share[:, None]
        back = (d @ w.T) / count[:, None]
        grads = [np.stack([np.bincount(flat, back[row, k], len(used)) for k in range(dim)], 1) + 1e-7 * e, mean.T @ d + 1e-5 * w, d.sum(0)]
        for q, g, m, v in zip(params, grads, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q -= rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-10)
    e, w, _ = params
    own = e @ (w[:, 1] - w[:, 0])
    mean = np.add.reduceat(own[flat], heads) / count
    # a feature never met counts as clean as half the mean of clean windows
    out = np.full(1 << BUCKET_BITS, min(0.0, float(mean[y == 0].mean()) / 2) if (y == 0).any() else 0.0)
    out[used] = own
    return out


def platt(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and bias of the logistic curve through standardised x, by Newton steps."""
    mu, sd = x.mean(), x.std() or 1.0
    a = np.stack([(x - mu) / sd, np.ones_like(x)], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w -= np.linalg.solve(h, a.T @ (p - y) + 1e-3 * w)
    return float(max(w[0], 0) / sd), float(w[1] - max(w[0], 0) * mu / sd)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls on the fold that is never trained on; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == fold, F.lit(False))


def training(docs: DataFrame, labels: DataFrame, doc_id: str, label: str, folds: int, fold: int) -> DataFrame:
    """doc_id, y of the labelled rows that may be learned from, one row each."""
    rows = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(~held_out(F.col("doc_id"), folds, fold))
    return rows.groupBy("doc_id").agg(F.max("y").alias("y"))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 4, fold: int = 2, most_toxic: int = 1200, most_clean: int = 2400, most_chars: int = 30_000_000) -> Model:
    """most_chars bounds the driver's memory: of the sample, texts beyond it are left out whole."""
    rows = training(docs, labels, doc_id, label, folds, fold)
    picked = [rows.filter(f"y = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, most_toxic), (0, most_clean))]
    sample = picked[0].unionByName(picked[1])
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("text IS NOT NULL").join(F.broadcast(sample), "doc_id")
    texts = texts.withColumn("so_far", F.length("text")).orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(most_toxic + most_clean)
    got, chars = [], 0
    for r in texts.toLocalIterator():
        chars += r.so_far
        if chars <= most_chars:
            got.append((r.text, r.y))
    return train([t for t, _ in got], np.array([y for _, y in got]))


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """df with the score as out; a column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def proba(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.proba(texts))

    return df.withColumn(out, proba(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", cut: float = 0.3, folds: int = 4, fold: int = 2) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = learn(docs, labels, doc_id, text, folds=folds, fold=fold)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return score(rows, model).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
