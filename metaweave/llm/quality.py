"""Quality by pairwise ranking.

Every text becomes a short vector of measures of its whole bytes, words and lines. A Bradley-Terry model learns, from
pairs of a good and a poor text, a linear worth whose difference is the log-odds that the first is preferred (logistic
loss on feature differences). The threshold is the worth's quantile at the poor texts' share, taken over all labelled
training rows; the score is the logistic of the worth above it, so 0.5 is the threshold.

The pairs come from a bounded sample of labelled training rows (most_rows, the lowest by a hash of doc_id). Defined
cases: null and empty texts have zero measures and are scored as such; rows with a null doc_id or label are never
trained on; repeated labels of one doc_id count as poor if any is; without both classes every score is 0.5; columns
other than the named ones pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from ._text import IS_SPACE, LOWER, byte_table, prefix_hash, slices, span_hash, word_spans
from ._work import Work
from .toxicity import held_out, platt, training

TABLE = byte_table(3)[LOWER]
#: Byte classes whose shares are measures.
CLASSES = [
    IS_SPACE,
    np.isin(np.arange(256), np.arange(65, 91)),
    np.isin(np.arange(256), np.arange(48, 58)),
    np.isin(np.arange(256), list(b".,;:'-")),
    np.isin(np.arange(256), list(b"!?")),
    np.isin(np.arange(256), list(b"#$%&*+/<=>@\\^_`{|}~\"()[]")),
    np.arange(256) >= 128,
    np.arange(256) == 10,
    np.arange(256) < 9,
]
NAMES = len(CLASSES) + 10


def measures(texts: pa.Array) -> np.ndarray:
    out = np.zeros((len(texts), NAMES))
    pick = np.stack(CLASSES).astype(float).T
    for i, j, offs, raw in slices(texts):
        n = j - i
        doc = np.repeat(np.arange(n), np.diff(offs))
        hist = np.bincount(doc * 256 + raw, minlength=n * 256).reshape(n, 256).astype(float)
        size = np.maximum(hist.sum(1), 1)
        starts, ends, first = word_spans(offs, raw)
        words = np.diff(first)
        c = prefix_hash(raw, TABLE)
        h = span_hash(c, starts, ends)
        of = np.repeat(np.arange(n), words)
        solid = np.maximum(words, 1)
        same = np.zeros(len(h), dtype=bool)
        same[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
        distinct, top = tallies(of, h, n)
        line_end = np.flatnonzero(raw == 10)
        lo = np.union1d(offs[:-1][np.diff(offs) > 0], line_end + 1)
        lo = lo[lo < len(raw)]
        hi = np.append(lo, len(raw))[1:].astype(np.int64)
        hi -= raw[hi - 1] == 10
        line_of = np.searchsorted(offs, lo, "right") - 1
        lines = np.bincount(line_of, minlength=n)
        own_lines, _ = tallies(line_of, span_hash(c, lo, hi), n)
        length = ends - starts
        longest = np.zeros(n)
        np.maximum.at(longest, of, length)
        p = hist / size[:, None]
        entropy = -(p * np.log(np.maximum(p, 1e-12))).sum(1)
        marked = np.bincount(of, weights=MARK[raw[ends - 1]] if len(ends) else None, minlength=n)
        out[i:j] = np.column_stack([
            (hist @ pick) / size[:, None],
            np.log1p(words),
            np.bincount(of, weights=length, minlength=n) / solid,
            np.log1p(distinct) / np.log1p(solid),
            top / solid,
            np.bincount(of, weights=same, minlength=n) / solid,
            np.where(lines > 0, 1 - own_lines / np.maximum(lines, 1), 0),
            entropy,
            np.log1p(longest),
            marked / solid,
            words > 0,
        ])
    return out


#: Last bytes of a word that prose does not end words with.
MARK = np.zeros(256)
MARK[list(b"#$%&*+/<=>@\\^_`{|}~!")] = 1


def tallies(of: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text and how often its commonest occurs."""
    order = np.lexsort((h, of))
    of, h = of[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    top = np.zeros(n)
    np.maximum.at(top, of[at], np.diff(np.append(at, len(h))))
    return np.bincount(of[at], minlength=n), top


class Model:
    """worth = hinges(standardised measures) . w"""

    def __init__(self, x: np.ndarray | None = None):
        self.w, self.threshold, self.scale = None, 0.0, 1.0
        if x is not None:
            self.mean, self.sd = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0)
            self.knots = np.quantile(self._standard(x), (0.1, 0.5, 0.9), axis=0)

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.sd, -6, 6)

    def basis(self, x: np.ndarray) -> np.ndarray:
        z = self._standard(x)
        return np.concatenate([z, *(np.maximum(z - k, 0) for k in self.knots)], axis=1)

    def worth(self, x: np.ndarray) -> np.ndarray:
        return self.basis(x) @ self.w if self.w is not None else np.zeros(len(x))

    def score(self, worth: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * (worth - self.threshold), -60, 60)))


def train(x: np.ndarray, good: np.ndarray, pairs: int = 40_000, ridge: float = 1e-3, seed: int = 3) -> Model:
    """Newton steps on the logistic loss of the pairs' feature differences."""
    good = np.asarray(good, dtype=bool)
    if not good.any() or good.all():
        return Model()
    model, rng = Model(x), np.random.default_rng(seed)
    b = model.basis(x)
    d = b[rng.choice(np.flatnonzero(good), pairs)] - b[rng.choice(np.flatnonzero(~good), pairs)]
    w = np.zeros(d.shape[1])
    for _ in range(20):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / pairs + ridge * np.eye(len(w)), -(d.T @ (p - 1)) / pairs + -ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    model.w = w
    model.scale = max(platt(b @ w, good.astype(float))[0], 1e-6)
    return model


def learn(work: Work, measured: DataFrame, docs: DataFrame, labels: DataFrame, doc_id: str, label: str, folds: int, fold: int, most_rows: int) -> Model:
    """measured: doc_id, measures of the texts. The sample bounds what the driver gathers; the threshold is over all labelled training rows."""
    rows = training(docs, labels.withColumn(label, 1 - F.col(label)), doc_id, label, folds, fold).withColumn("y", 1 - F.col("y"))
    known = work.save(measured.filter("doc_id IS NOT NULL").join(rows, "doc_id"), "known")
    n = known.count()
    # the lowest by hash; a share of them first, so that no partition hands the driver more than its part
    least = F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < int(min(1.0, 1.5 * most_rows / max(1, n)) * (1 << 62))
    got = known.filter(least).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).select("y", "measures").collect()
    if not got:
        return Model()
    model = train(np.array([r.measures for r in got]), np.array([r.y for r in got]))
    if model.w is not None:
        shares = known.agg(F.count("*").alias("n"), F.avg(1 - F.col("y")).alias("poor")).first()
        near = [min(1.0, shares.poor), min(1.0, shares.poor + 1 / shares.n)]
        low, high = known.select(_worth(model)(F.col("measures")).alias("worth")).agg(F.percentile_approx("worth", near, 200_000).alias("t")).first().t
        model.threshold = (low + high) / 2
    return model


def _worth(model: Model):
    @arrow_udf("double")
    def worth(x: pa.Array) -> pa.Array:
        return pa.array(model.worth(np.asarray(x.flatten(), dtype=float).reshape(len(x), NAMES)))

    return worth


def measure(text: Column) -> Column:
    @arrow_udf("array<double>")
    def measure(texts: pa.Array) -> pa.Array:
        m = measures(texts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * NAMES), pa.array(m.ravel()))

    return measure(text)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 3, fold: int = 1, most_rows: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    work = Work(docs.sparkSession, "quality")
    measured = work.save(docs.select(F.col(doc_id).cast("long").alias("doc_id"), measure(F.col(text)).alias("measures")), "measured")
    model = learn(work, measured, docs, labels, doc_id, label, folds, fold, most_rows)
    score = _scored(model, F.col("measures"))
    return measured.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _scored(model: Model, x: Column) -> Column:
    if model.w is None:
        return F.lit(0.5)
    worth = _worth(model)(x)
    return 1 / (1 + F.exp(-F.lit(model.scale) * (worth - F.lit(model.threshold))))


def keep(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 3, fold: int = 1, most_rows: int = 20_000) -> DataFrame:
    """The rows of docs, all columns as they are, that score 0.5 or more."""
    work = Work(docs.sparkSession, "quality")
    measured = work.save(docs.select(F.col(doc_id).cast("long").alias("doc_id"), measure(F.col(text)).alias("measures")), "measured")
    model = learn(work, measured, docs, labels, doc_id, label, folds, fold, most_rows)
    return docs.filter(_scored(model, measure(F.col(text))) >= 0.5)
