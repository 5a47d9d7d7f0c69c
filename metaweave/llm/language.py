"""Language identification by averaged subword embeddings.

A text is the average of the embeddings of its hashed character n-grams (of bytes, within words, their edges marked),
put through a linear softmax over the languages; both are trained together by stochastic gradient descent in numpy. For
scoring, embeddings and softmax fold into one weight for each bucket and language, and every whole text is scored.

Calibration: part of the sample is kept apart from training. The softmax's temperature is the one of least loss on it, so
scores are probabilities; the rejection bound is the least score above which the share of wrong answers there, weighed by
how frequent each language is, stays within `wrong`. identify() marks what lies below as rejected, or answers `und` for
it if asked to.

The sample: at most most_each rows of each language, the lowest by a hash of doc_id, of which the driver takes most_chars
characters at most. Besides whole texts, short runs of their words are trained on, so that short texts are met.

Defined cases: a null text or one without a letter is `und` with score 0 and rejected; repeated rows and labels count as
often as they occur in the sample; null ids are trained on (they are on no fold) and nulls in lang are not; without any
labelled row all texts are `und`; with one language all texts with a letter are in it with score 1. Only id, text and
lang are read by classify(); identify() keeps all columns and replaces those named as its outputs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.window import Window

from ._text import slices
from .toxicity import folded, grams, held_out

SIZES = (2, 3, 4)
BUCKET_BITS = 18
UNKNOWN = "und"


def buckets(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, valid) at each byte; sizes are hashed apart."""
    b, valid = grams(raw, size)
    return (b * np.int32(2 * size + 1) + np.int32(size)) & np.int32((1 << BUCKET_BITS) - 1), valid


def bag(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, shares) of one folded text."""
    got = []
    for s in SIZES:
        if len(raw) >= s:
            b, valid = buckets(raw, s)
            got.append(b[valid])
    ids, n = np.unique(np.concatenate(got) if got else np.zeros(0, np.int32), return_counts=True)
    return ids, n / max(1, n.sum())


class Model:
    """languages in order; weight: bucket, language; a temperature and a rejection bound."""

    def __init__(self, languages: list[str], weight: np.ndarray, temperature: float = 1.0, bound: float = 0.0):
        self.languages, self.weight, self.temperature, self.bound = languages, np.ascontiguousarray(weight.T, dtype=np.float32), temperature, bound

    def logits(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        for i, j, offs, raw in slices(pc.utf8_lower(texts.cast(pa.large_string()))):
            offs, raw = folded(offs, raw)
            total, count = np.zeros((j - i, len(self.languages))), np.zeros(j - i)
            for s in SIZES:
                if len(raw) < s:
                    continue
                bucket, valid = buckets(raw, s)
                heads = np.minimum(offs[:-1], len(valid) - 1)
                own = np.append(offs[1:-1], len(valid)) > offs[:-1]  # not past the last n-gram
                bucket[~valid] = -1
                count += np.where(own, np.add.reduceat(valid.astype(np.int64), heads), 0)
                for k, w in enumerate(self.weight):
                    total[:, k] += np.where(own, np.add.reduceat(np.append(w, np.float32(0))[bucket], heads, dtype=np.float64), 0)
            out[i:j] = total / np.maximum(count, 1)[:, None]
        return out

    def proba(self, texts: pa.Array) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(-1, keepdims=True))
    return p / p.sum(-1, keepdims=True)


def descend(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, k: int, dim: int, epochs: int, rate: float, batch: int, rng: np.random.Generator) -> np.ndarray:
    """Embeddings and softmax, which has no bias, so that a text of n-grams never met is equally likely in all languages, by stochastic gradient descent over small batches, steps scaled by the gradients so far."""
    used, flat = np.unique(np.concatenate([b for b, _ in bags]), return_inverse=True)
    size = np.array([len(b) for b, _ in bags])
    ends, share = np.cumsum(size), np.concatenate([s for _, s in bags])
    e, w = rng.normal(0, 0.1, (len(used), dim)), rng.normal(0, 0.3, (dim, k))
    ge, gw = np.full((len(used), 1), 1e-8), np.full_like(w, 1e-8)
    weight = np.bincount(y, minlength=k)
    weight = len(y) / (k * np.maximum(weight, 1))
    for epoch in range(epochs):
        order, step = rng.permutation(len(bags)), rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            n = size[rows]
            pick = np.repeat(ends[rows] - n - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids, s, of = flat[pick], share[pick], np.repeat(np.arange(len(rows)), n)
            mean = np.add.reduceat(e[ids] * s[:, None], np.cumsum(n) - n, axis=0)
            d = softmax(mean @ w)
            d[np.arange(len(rows)), y[rows]] -= 1
            d *= weight[y[rows], None] / len(rows)
            back = d @ w.T
            own, inverse = np.unique(ids, return_inverse=True)
            grad = np.stack([np.bincount(inverse, back[of, c] * s, len(own)) for c in range(dim)], 1)
            ge[own] += (grad * grad).mean(1, keepdims=True)
            e[own] -= step * grad / np.sqrt(ge[own])
            g = mean.T @ d
            gw += g * g
            w -= step * g / np.sqrt(gw)
    out = np.zeros((1 << BUCKET_BITS, k))
    out[used] = e @ w
    return out


def cuts(text: str, runs: int, rng: np.random.Generator) -> list[str]:
    """The whole text and some short runs of its words."""
    words = text.split()
    out = [text]
    for _ in range(runs if len(words) > 1 else 0):
        n = int(rng.integers(1, min(12, len(words)) + 1))
        at = int(rng.integers(0, len(words) - n + 1))
        out.append(" ".join(words[at : at + n]))
    return out


def train(texts: list[str], lang: list[str], frequency: dict[str, int] | None = None, dim: int = 8, epochs: int = 5, rate: float = 0.1, batch: int = 32, runs: int = 3, apart: float = 0.2, wrong: float = 0.01, seed: int = 7) -> Model | None:
    """frequency: how many rows each language has, by which errors are weighed; None without any text."""
    if not texts:
        return None
    languages = sorted(set(lang))
    k, rng = len(languages), np.random.default_rng(seed)
    y = np.searchsorted(np.array(languages, dtype=object), np.array(lang, dtype=object))
    if k == 1:
        return Model(languages, np.zeros((1 << BUCKET_BITS, 1)))
    kept_apart = rng.random(len(texts)) < apart
    parts = {True: ([], []), False: ([], [])}
    for text, c, away in zip(texts, y, kept_apart, strict=True):
        for piece in cuts(text, runs, rng):
            parts[bool(away)][0].append(piece)
            parts[bool(away)][1].append(c)
    bags, labels = [], []
    for piece, c in zip(*parts[False], strict=True):
        b = piece.lower().encode()
        ids, share = bag(folded(np.array([0, len(b)]), np.frombuffer(b, dtype=np.uint8))[1])
        if len(ids):
            bags.append((ids, share))
            labels.append(c)
    if not bags:
        return Model(languages, np.zeros((1 << BUCKET_BITS, k)))
    model = Model(languages, descend(bags, np.array(labels), k, dim, epochs, rate, batch, rng))
    pieces, truth = parts[True]
    if pieces:
        truth = np.array(truth)
        many = np.array([(frequency or {}).get(x, 1) for x in languages], dtype=float)
        weight = (many / np.maximum(np.bincount(truth, minlength=k), 1))[truth]
        model.temperature, model.bound = calibrate(model.logits(pa.array(pieces, pa.large_string())), truth, weight, wrong)
    return model


def calibrate(z: np.ndarray, y: np.ndarray, weight: np.ndarray, wrong: float) -> tuple[float, float]:
    """(temperature of least weighted loss, least score above which the weighted share of errors is within wrong)."""
    weight = weight / weight.sum()
    loss = lambda t: -(weight * np.log(np.maximum(softmax(z / t)[np.arange(len(y)), y], 1e-12))).sum()
    grid = np.geomspace(0.02, 20, 61)
    best = grid[int(np.argmin([loss(t) for t in grid]))]
    fine = best * np.geomspace(0.9, 1.1, 41)
    t = float(fine[int(np.argmin([loss(x) for x in fine]))])
    p = softmax(z / t)
    score, bad = p.max(1), p.argmax(1) != y
    order = np.argsort(-score, kind="stable")
    share = np.cumsum((weight * bad)[order]) / np.cumsum(weight[order])
    last = np.append(np.diff(score[order]) != 0, True)  # where a run of equal scores ends
    ok = np.flatnonzero((share <= wrong) & last)
    return t, float(score[order][ok[-1]]) if len(ok) else 1.0


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, fold: int = 0, most_each: int = 500, most_chars: int = 20_000_000, wrong: float = 0.01) -> Model | None:
    """Rows on the held-out fold are never read into the sample."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL").filter(~held_out(F.col("doc_id"), folds, fold)).filter(has_letter(F.col("text")))
    known = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not known:
        return None
    # the lowest by hash of each language: a share first, so that no task sorts a whole language
    share = F.create_map(*[x for name, n in known.items() for x in (F.lit(name), F.lit(int(min(1.0, 2 * most_each / n + 20 / n) * (1 << 62))))])
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(3)), 2)
    some = rows.withColumn("h", hashed).filter(F.col("h") < share[F.col("lang")])
    some = some.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id", F.xxhash64("text")))).filter(F.col("place") <= most_each)
    got, chars = [], 0
    for r in some.withColumn("size", F.length("text")).orderBy("place", "lang").select("text", "lang", "size").toLocalIterator():
        chars += r["size"]
        if chars <= most_chars:
            got.append((r.text, r.lang))
    return train([t for t, _ in got], [x for _, x in got], known, wrong=wrong)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, model: Model | None, text: str = "text", out: tuple[str, str, str] = ("lang_pred", "score", "rejected"), reject: bool = False) -> DataFrame:
    """docs with the predicted language, its calibrated probability and whether that lies below the rejection bound; with reject such rows are answered `und`."""
    lang, score, rejected = out
    if model is None:
        return docs.withColumns({lang: F.lit(UNKNOWN), score: F.lit(0.0), rejected: F.lit(True)})
    held = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        p = held.value.proba(texts)
        names = pa.array(held.value.languages, pa.string()).take(pa.array(p.argmax(1)))
        return pa.StructArray.from_arrays([names, pa.array(p.max(1))], ["lang", "score"])

    letters = has_letter(F.col(text))
    made, seen = "__made", "__letters"
    rows = docs.withColumns({made: predict(F.col(text)), seen: letters})
    low = ~F.col(seen) | (F.col(made)["score"] < model.bound)
    answer = F.when(~F.col(seen) | (low if reject else F.lit(False)), UNKNOWN).otherwise(F.col(made)["lang"])
    return rows.withColumns({lang: answer, score: F.when(F.col(seen), F.col(made)["score"]).otherwise(0.0), rejected: low}).drop(made, seen)


def classify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, fold: int = 0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected."""
    model = learn(docs, doc_id, text, lang, folds, fold)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return identify(rows, model).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "lang_pred", "score", "rejected")
