"""Quality scores by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text train a small network by minimising the non-negative
unbiased risk. The class prior is estimated from the same two samples: a classifier of positive against
unlabelled ranks held-out halves of both, and the prior is the least ratio of the shares above a threshold
(best bin estimation). Rows labelled 0 are never used. Features of whole texts are hashed words and shape:
sizes, character classes, repetition.

Both training sets are bounded samples by hash of id and text (``SAMPLE`` rows each at most), so the fit does not
grow with the corpus; every text is scored whole.

Defined cases: a null text is the empty text; where every usable document has a label, all of them are taken as
unlabelled; without a usable positive nothing can be learned: every score is 0.5, and ``keep_good`` keeps every
document; repeated rows are scored once each, and alike (ties); very long texts are read whole; labels repeated
for one document count once, the smallest winning; labels without a document are left out; other columns,
of whatever name, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import text_or_empty

SAMPLE = 4000
WORD_BUCKETS = 256
HIDDEN = 24
EPOCHS, PRIOR_EPOCHS = 120, 40
BATCH = 400
#: A small sample is gone through as often as one of this many batches.
LEAST_ROUNDS = 6
RATE = 5e-3
DECAY = 3e-4
#: Weight of a standardised word feature beside one of shape: there are ten times as many.
WORD_WEIGHT = 0.3
#: Certainty of the bounds in the estimate of the prior.
DOUBT = 0.1
SEED = 11


def shape(text: str) -> list[float]:
    """Features of a whole text: sizes, character classes, repetition, punctuation that ends words."""
    words = text.split()
    chars, n = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    ascii_only = codes[codes < 128]
    seen = np.bincount(ascii_only, minlength=128) if len(ascii_only) else np.zeros(128, dtype=int)
    symbols = seen[33:48].sum() + seen[58:65].sum() + seen[91:97].sum() + seen[123:127].sum()
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
    repeats = sum(map(str.__eq__, words, words[1:])) / n
    pairs = len(set(zip(words, words[1:]))) / n
    top = np.sort(seen[33:127])[::-1]
    return [
        np.log1p(len(words)),
        np.log1p(len(text)),
        np.log1p(len(lines)),
        len(set(words)) / n**0.8,
        pairs,
        repeats,
        float(lengths.mean()),
        float(lengths.std()),
        float((lengths == 1).mean()),
        float(lengths.max()) ** 0.5,
        seen[65:91].sum() / chars,
        seen[48:58].sum() / chars,
        symbols / chars,
        (seen[33] + seen[63]) / n,
        (seen[46] + seen[44]) / n,
        seen[124] / n,
        (seen[35] + seen[36] + seen[37] + seen[38] + seen[42]) / n,
        (seen[60] + seen[62] + seen[123] + seen[125] + seen[61] + seen[59]) / n,
        (len(codes) - len(ascii_only)) / chars,
        seen[:32].sum() / chars,
        len(set(lines)) / max(1, len(lines)),
        float(top[0]) / chars,
    ]


def words_of(text: str) -> np.ndarray:
    """Distinct lower-cased words in hashed buckets, scaled to length 1."""
    found = set(text.lower().split())
    counts = np.bincount([zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_BUCKETS for w in found], minlength=WORD_BUCKETS) if found else np.zeros(WORD_BUCKETS)
    return counts / max(1.0, float(np.sqrt((counts * counts).sum())))


def features(texts: list[str]) -> np.ndarray:
    width = len(shape("a b")) + WORD_BUCKETS
    return np.array([np.concatenate([shape(t), words_of(t)]) for t in texts], dtype=np.float64).reshape(-1, width)


@dataclass
class Model:
    """A network of one hidden layer over standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        return _forward(self.layers, self._ready(x))[0]

    def _ready(self, x: np.ndarray) -> np.ndarray:
        ready = np.clip((x - self.mean) / self.scale, -6, 6)
        ready[:, -WORD_BUCKETS:] *= WORD_WEIGHT if x.shape[1] > WORD_BUCKETS else 1
        return ready

    def scores(self, texts: list[str], batch: int = 500) -> np.ndarray:
        logits = [self.logits(features(texts[at : at + batch])) for at in range(0, len(texts), batch)]
        return 1 / (1 + np.exp(-np.clip(np.concatenate(logits), -30, 30)))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w1, b1, w2, b2 = layers
    hidden = np.tanh(x @ w1 + b1)
    return hidden @ w2 + b2[0], hidden


def _gradient(layers: list[np.ndarray], x: np.ndarray, hidden: np.ndarray, d: np.ndarray) -> list[np.ndarray]:
    w2 = layers[2]
    back = (d[:, None] * w2[None, :]) * (1 - hidden**2)
    return [x.T @ back, back.sum(axis=0), hidden.T @ d, np.array([d.sum()])]


def risk(layers: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The two parts of the unbiased risk: prior * E_p[l(f)], and E_u[l(-f)] - prior * E_p[l(-f)], with the logistic loss."""
    fp, fu = _forward(layers, p)[0], _forward(layers, u)[0]
    return prior * np.logaddexp(0, -fp).mean(), np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()


def risk_gradient(layers: list[np.ndarray], p: np.ndarray, u: np.ndarray, prior: float) -> list[np.ndarray]:
    """Gradient of the risk; where its second part is negative, that part's gradient alone, backwards.

    Going backwards undoes the over-fitting that made it negative.
    """
    fp, hp = _forward(layers, p)
    fu, hu = _forward(layers, u)
    up_p, up_u = 1 / (1 + np.exp(-fp)), 1 / (1 + np.exp(-fu))
    if risk(layers, p, u, prior)[1] >= 0:
        dp, du = prior * ((up_p - 1) - up_p) / len(fp), up_u / len(fu)
    else:
        dp, du = prior * up_p / len(fp), -up_u / len(fu)
    return [a + b for a, b in zip(_gradient(layers, p, hp, dp), _gradient(layers, u, hu, du))]


def _pvu_gradient(layers: list[np.ndarray], p: np.ndarray, u: np.ndarray, _: float) -> list[np.ndarray]:
    """Gradient of the plain logistic loss of positive against unlabelled, both halves weighing the same."""
    fp, hp = _forward(layers, p)
    fu, hu = _forward(layers, u)
    dp, du = (1 / (1 + np.exp(-fp)) - 1) / len(fp), 1 / (1 + np.exp(-fu)) / len(fu)
    return [a + b for a, b in zip(_gradient(layers, p, hp, dp), _gradient(layers, u, hu, du))]


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, epochs: int = EPOCHS, gradient=risk_gradient) -> Model:
    """Minimise prior * E_p[l(f)] + max(0, E_u[l(-f)] - prior * E_p[l(-f)]) by Adam."""
    rng = np.random.default_rng(SEED)
    both = np.vstack([positive, unlabelled])
    model = Model(both.mean(axis=0), np.maximum(both.std(axis=0), 1e-6), [])
    p, u = model._ready(positive), model._ready(unlabelled)
    width = p.shape[1]
    model.layers = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in model.layers], [np.zeros_like(w) for w in model.layers]
    step, rounds = 0, max(1, -(-len(u) // BATCH))
    for _ in range(max(epochs, -(-epochs * LEAST_ROUNDS // rounds))):
        order_p, order_u = rng.permutation(len(p)), rng.permutation(len(u))
        for part_p, part_u in zip(np.array_split(np.resize(order_p, max(len(p), rounds)), rounds), np.array_split(order_u, rounds)):
            step += 1
            for i, g in enumerate(gradient(model.layers, p[part_p], u[part_u], prior)):
                g = g + DECAY * model.layers[i]
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                model.layers[i] = model.layers[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, by best bin estimation; the mean over both ways to halve the samples."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return 0.5
    halves = [_best_bin(positive[k::2], unlabelled[k::2], positive[1 - k :: 2], unlabelled[1 - k :: 2]) for k in (0, 1)]
    return float(np.clip(np.mean(halves), 0.01, 0.97))


def _best_bin(p_fit: np.ndarray, u_fit: np.ndarray, p_held: np.ndarray, u_held: np.ndarray) -> float:
    """Above a threshold lie a share q_p of the positives and q_u of the unlabelled texts; where only positives lie there,
    q_u / q_p is the prior. The threshold taken has the least upper bound of that ratio."""
    model = fit(p_fit, u_fit, 0.5, PRIOR_EPOCHS, _pvu_gradient)
    p, u = np.sort(model.logits(p_held)), np.sort(model.logits(u_held))
    q_p = 1 - np.arange(len(p)) / len(p)
    q_u = 1 - np.searchsorted(u, p, side="left") / len(u)
    slack = np.sqrt(np.log(4 / DOUBT) / 2 / len(u)) + np.sqrt(np.log(4 / DOUBT) / 2 / len(p))
    best = int(np.argmin((q_u + slack) / q_p))
    return q_u[best] / q_p[best]


def _sample(rows: DataFrame, size: int, salt: int) -> list[str]:
    """Texts of at most ``size`` rows, those with the least hash of id and text among about twice as many."""
    n = rows.count()
    if not n:
        return []
    scale, own = 1 << 30, F.xxhash64("doc_id", "text", F.lit(salt))
    kept = rows.where(F.pmod(own, F.lit(scale)) < min(scale, int(scale * 2 * size / n) + 1))
    found = kept.select(F.coalesce("text", F.lit("")).alias("text"), own.alias("own")).orderBy("own", "text").limit(size).collect()
    return [r["text"] for r in found]


def learn(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> tuple[Model | None, float]:
    """The model and the class prior; ``usable`` marks the rows of either table that may be learned from."""
    marks = labels.where(usable & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("mark"))
    texts = docs.where(usable).select("doc_id", "text")
    positive = _sample(texts.join(marks.where("mark = 1"), "doc_id", "left_semi"), sample, 1)
    unlabelled = _sample(texts.join(marks, "doc_id", "left_anti"), sample, 2) or _sample(texts, sample, 2)
    if not positive or not unlabelled:
        return None, 0.5
    p, u = features(positive), features(unlabelled)
    prior = estimate_prior(p, u)
    return fit(p, u, prior), prior


def score_quality(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier) of every whole text."""
    score = _scorer(docs, *learn(docs, labels, usable, sample))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(text_or_empty()).alias("score"))


def _scorer(docs: DataFrame, model: Model | None, prior: float):
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series(own.scores(texts.tolist()) if own is not None and len(texts) else np.full(len(texts), prior))

    return score


def keep_good(docs: DataFrame, labels: DataFrame, usable: Column, least: float, sample: int = SAMPLE) -> DataFrame:
    """The documents whose score is ``least`` or more, with their columns as they are; all of them where nothing can be learned."""
    model, prior = learn(docs, labels, usable, sample)
    if model is None:
        return docs
    score = _scorer(docs, model, prior)
    return docs.where(score(text_or_empty()) >= least)
