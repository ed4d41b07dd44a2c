"""Language identification by blended-spectrum presence kernels.

Two texts are as alike as the share of character n-grams (1 to ``ORDER``) that both contain:
k(x, y) = |G(x) and G(y)| / sqrt(|G(x)| |G(y)|). Landmark texts give a Nystroem map; one ridge regression
per language is fitted on it; whole texts are scored batch by batch as one matrix product with the
landmarks. n-grams are hashed to ``BUCKETS`` presence bits.

The fit uses a bounded sample of labelled rows: about ``PER_LANGUAGE`` of each language, chosen by a hash of id and text,
so it does not grow with the corpus; every text is scored whole. Every language is learned, and a table with more than
``MAX_LANGUAGES`` of them, a parameter, is an error: no language is left out in silence.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with nothing to learn from,
every text is; repeated rows are scored once each; of languages that tie the first by name is taken; the
n-grams of very long texts fill the ``BUCKETS``, which lowers all their kernel values alike; rows without a
language or text are not learned from; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ORDER = 4
BUCKETS = 1 << 17
PER_LANGUAGE = 150
MAX_LANGUAGES = 512
LANDMARKS_PER_LANGUAGE = 32
RIDGE = 1e-2
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_SHIFT = np.uint64(64 - BUCKETS.bit_length() + 1)


def presence(text: str) -> np.ndarray:
    """Which of the ``BUCKETS`` hashed n-grams of orders 1 to ``ORDER`` the whole text contains."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    bits, gram = np.zeros(BUCKETS, dtype=bool), codes
    for order in range(1, ORDER + 1):
        if order > 1:
            gram = gram[:-1] * _MULTIPLIERS[0] + codes[order - 1 :]
        if not len(gram):
            break
        bits[((gram + np.uint64(order)) * _MULTIPLIERS[1]) >> _SHIFT] = True
    return bits


@dataclass
class Model:
    """Landmark n-grams (columns of ``grams``), and ``weights`` from kernel values to one score a language."""

    languages: list[str]
    columns: np.ndarray
    grams: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    bias: np.ndarray | float = 0.0

    def kernel(self, bits: list[np.ndarray]) -> np.ndarray:
        sizes = np.sqrt(np.array([max(1, b.sum()) for b in bits], dtype=np.float32))
        seen = np.stack([b[self.columns] for b in bits]).astype(np.float32)
        return (seen @ self.grams) / (sizes[:, None] * self.norms[None, :])

    def scores(self, texts: list[str], batch: int = 64) -> np.ndarray:
        out = [self.kernel([presence(t) for t in texts[i : i + batch]]) @ self.weights for i in range(0, len(texts), batch)]
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), dtype=np.float32)


def fit(texts: list[str], languages: list[str]) -> Model | None:
    """Nystroem features of the landmark kernel, then one-versus-rest kernel ridge regression."""
    names = sorted(set(languages))
    if not names:
        return None
    taken: dict[str, int] = {}
    marks = []
    for text, language in zip(texts, languages):
        if taken.get(language, 0) < LANDMARKS_PER_LANGUAGE:
            taken[language] = taken.get(language, 0) + 1
            marks.append(presence(text))
    bits = np.stack(marks)
    columns = np.flatnonzero(bits.any(axis=0))
    norms = np.sqrt(np.maximum(bits.sum(axis=1), 1)).astype(np.float32)
    model = Model(names, columns, np.ascontiguousarray(bits[:, columns].T.astype(np.float32)), norms, np.eye(len(marks), dtype=np.float32))
    values, vectors = np.linalg.eigh(model.kernel(marks).astype(np.float64))
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    features = model.scores(texts).astype(np.float64) @ whiten
    features = np.hstack([features, np.ones((len(texts), 1))])
    targets = np.array([[x == n for n in names] for x in languages], dtype=np.float64)
    weight = 1 / np.sqrt(targets.sum(axis=0))[targets.argmax(axis=1)]
    a = features * weight[:, None]
    gram = a.T @ a
    solved = np.linalg.solve(gram + RIDGE * np.trace(gram) / len(gram) * np.eye(len(gram)), a.T @ (targets * weight[:, None]))
    model.weights = (whiten @ solved[:-1]).astype(np.float32)
    model.bias = solved[-1].astype(np.float32)
    return model


def training_rows(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], list[str]]:
    """Texts and languages of a bounded sample: about ``per_language`` rows of each language by hash of the id."""
    rows = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    common = rows.groupBy("lang").count().limit(max_languages + 1).collect()
    if len(common) > max_languages:
        raise ValueError(f"more than {max_languages} languages: raise max_languages")
    if not common:
        return [], []
    scale, own = 1 << 30, F.xxhash64("doc_id", "text")
    share = F.create_map(*[F.lit(x) for r in common for x in (r["lang"], min(scale, int(scale * 1.2 * per_language / r["count"]) + 1))])
    sample = rows.where(F.pmod(own, F.lit(scale)) < F.try_element_at(share, F.col("lang")))
    found = sample.select("lang", "text", own.alias("own")).orderBy("own", "lang", "text").limit(2 * per_language * len(common)).collect()
    return [r["text"] for r in found], [r["lang"] for r in found]


def identify(docs: DataFrame, usable: Column, per_language: int = PER_LANGUAGE, max_languages: int = MAX_LANGUAGES) -> DataFrame:
    """doc_id, lang_pred and score of every whole text; ``usable`` marks the rows whose ``lang`` may be learned from."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(fit(*training_rows(docs, usable, per_language, max_languages)))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for batch in batches:
            texts = batch.pop("text").tolist()
            batch["lang_pred"], batch["score"] = UNKNOWN, 0.0
            real = [i for i, t in enumerate(texts) if t is not None and _LETTER.search(t)] if model else []
            if real:
                raw = np.maximum(model.scores([texts[i] for i in real]) + model.bias, 1e-6)
                best = raw.argmax(axis=1)
                sure = raw[np.arange(len(real)), best] / raw.sum(axis=1)
                batch.iloc[real, batch.columns.get_loc("lang_pred")] = [model.languages[b] for b in best]
                batch.iloc[real, batch.columns.get_loc("score")] = sure.astype(float)
            yield batch

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(score, "doc_id long, lang_pred string, score double")
