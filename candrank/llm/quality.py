"""Quality classifier by co-training of two views.

The text view counts pairs of neighbouring bytes and repeated words; the metadata view knows
the source, the language, the length and the layout of a page, not its words. Both are logistic
models fitted on a bounded sample: ``LABELLED`` labelled and ``UNLABELLED`` other documents,
taken by a hash of their id. In each round either model labels the documents it is surest of,
a share ``SURE`` of the others at any size, for the other one. Each is then calibrated on held-out labelled documents, and the mean of the
two calibrated log odds scores every document. A document is rejected where that score is
below the largest cut that keeps ``KEEP_SHARE`` of the good held-out documents.

Defined results: a null text is empty; null source or language are values of their own; a
document without features gets the models' prior; repeated rows get equal scores; without
labels of both kinds nothing is rejected and scores are 0.5; an empty table gives no rows;
further columns pass through, columns of the results' names are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candrank.llm.common import fresh, trimmed

LABELLED = 4_000
UNLABELLED = 4_000
ROUNDS = 4
SURE = 0.05
KEEP_SHARE = 0.995
TEXT_FEATURES = 1024
META_FEATURES = 64


def text_view(text: str) -> np.ndarray:
    """Shares of hashed byte pairs, and how often words come again."""
    raw = np.frombuffer(text.encode(), np.uint8).astype(np.int64)
    if len(raw) < 2:
        return np.zeros(TEXT_FEATURES + 3, np.float32)
    pair = ((raw[:-1] * 256 + raw[1:]) * 2654435761 >> 7) % TEXT_FEATURES
    out = np.zeros(TEXT_FEATURES + 3, np.float32)
    out[:TEXT_FEATURES] = np.sqrt(np.bincount(pair, minlength=TEXT_FEATURES) / len(pair)) * 4
    words = text.split()
    if words:
        out[-3] = len(set(words)) / len(words)
        out[-2] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
    out[-1] = 1
    return out


def meta_view(text: str, source: str | None, lang: str | None) -> np.ndarray:
    """Length and layout, and hashed source and language."""
    out = np.zeros(META_FEATURES, np.float32)
    n = len(text)
    lines = text.split("\n") if text else []
    longest = max(map(len, lines), default=0)
    spaces = text.count(" ")
    marks = sum(text.count(c) for c in "!|*%#$&@_=<>{}[]~^")
    stops = sum(text.count(c) for c in ".,;:?")
    digits = sum(map(text.count, "0123456789"))
    out[:12] = (
        1,
        np.log1p(n) / 10,
        np.log1p(len(lines)) / 5,
        np.log1p(longest) / 10,
        np.log1p(n / max(1, len(lines))) / 8,
        min(4, n / max(1, spaces)) / 4,
        min(1, 4 * marks / max(1, n)),
        min(1, 10 * stops / max(1, n)),
        min(1, 10 * digits / max(1, n)),
        n < 100,
        sum(len(x) < 30 for x in lines) / max(1, len(lines)),
        marks == 0,
    )
    for value in (f"s:{source}", f"l:{lang}"):
        out[12 + zlib.crc32(value.encode()) % (META_FEATURES - 12)] = 0.5
    return out


def fit_logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, penalty: float = 1e-4) -> np.ndarray:
    """Weights by Nesterov's gradient descent, classes weighted equally."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    rate = 4.0 / (np.einsum("ij,ij,i->", x, x, share) + penalty)
    w, before = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(steps):
        v = w + k / (k + 3) * (w - before)
        # Products in the type of the features, so that no step copies them all.
        p = 1 / (1 + np.exp(-np.clip((x @ v.astype(x.dtype)).astype(float), -30, 30)))
        slope = x.T @ (share * (p - (y > 0))).astype(x.dtype)
        before, w = w, v - rate * (slope.astype(float) + penalty * v)
    return w


def calibrated(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that make log odds of raw scores."""
    scale = max(1e-6, float(np.std(z)))
    x = np.stack([z / scale, np.ones(len(z))], axis=1)
    a, b = np.zeros(2), None
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        b = x.T * (p * (1 - p) + 1e-6) @ x + 1e-2 * np.eye(2)
        a = a - np.linalg.solve(b, x.T @ (p - (y > 0)) + 1e-2 * a)
    return float(a[0] / scale), float(a[1])


def co_train(
    views: tuple[np.ndarray, np.ndarray],
    y: np.ndarray,
    other: tuple[np.ndarray, np.ndarray],
    rounds: int = ROUNDS,
    sure: float = SURE,
) -> list[np.ndarray]:
    """Weights of both views after rounds of exchanged pseudo-labels.

    A view labels the share ``sure`` of the other documents at a time, one of each kind at least, as
    long as two are left.
    """
    each = max(2, round(sure * len(other[0])))
    given = [(v, y) for v in views]
    free = np.ones(len(other[0]), bool)
    weights = [fit_logistic(*g) for g in given]
    for _ in range(rounds):
        for me, peer in ((0, 1), (1, 0)):
            at = np.flatnonzero(free)
            take = min(each, len(at))
            if take < 2:
                break
            order = at[np.argsort((other[me] @ weights[me].astype(other[me].dtype))[at])]
            # As many of each kind as the labels have.
            bad = min(take - 1, max(1, int(take * (y <= 0).mean())))
            chosen = np.r_[order[:bad], order[-(take - bad) :]]
            mark = np.r_[np.zeros(bad), np.ones(take - bad)]
            free[chosen] = False
            x, z = given[peer]
            given[peer] = (np.vstack([x, other[peer][chosen]]), np.r_[z, mark])
            weights[peer] = fit_logistic(*given[peer])
    return weights


def _featured(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = list(zip(pdf["text"], pdf["source"], pdf["lang"], strict=True))
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "y": pdf["y"],
                    "t": [text_view(t or "").tobytes() for t, _, _ in rows],
                    "m": [meta_view(t or "", s, g).tobytes() for t, s, g in rows],
                }
            )

    return docs.mapInPandas(lambda batches: trimmed(run(batches)), "doc_id long, y double, t binary, m binary")


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, unlabelled: int = UNLABELLED):
    """The fitted model, or None without labels of both kinds."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    marks = (
        labels.filter("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("__id"))
        .agg(F.max(F.col("quality").cast("double")).alias("y"))
    )
    order = F.xxhash64("doc_id", F.lit(11))
    # The bounded sample: the ids with the smallest hashes, chosen before any text is read.
    chosen = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"))
        .filter("doc_id is not null")
        .distinct()
        .join(marks, F.col("doc_id") == F.col("__id"), "left")
        .select("doc_id", "y", order.alias("o"))
    )
    ids = (
        chosen.filter("y is not null").orderBy("o").limit(labelled).select("doc_id", "y").collect()
        + chosen.filter("y is null").orderBy("o").limit(unlabelled).select("doc_id", "y").collect()
    )
    if not ids:
        return None
    picked = docs.sparkSession.createDataFrame(ids, "__id long, y double")
    # At most labelled + unlabelled ids, so small enough to be everywhere.
    sample = _featured(
        rows.join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).drop("__id")
    ).dropDuplicates(["doc_id"])
    got = sorted(sample.collect(), key=lambda r: r.doc_id)
    t, m = (
        np.stack([np.frombuffer(r[c], np.float32) for r in got]) if got else None for c in ("t", "m")
    )
    y = np.array([np.nan if r.y is None else float(r.y) for r in got])
    del got
    known = np.flatnonzero(~np.isnan(y))
    if not len(known) or len(set(y[known] > 0)) < 2:
        return None
    held = known[np.arange(len(known)) % 4 == 0]
    fit = known[np.arange(len(known)) % 4 != 0]
    if len(set(y[held] > 0)) < 2 or len(set(y[fit] > 0)) < 2:
        held = fit = known
    free = np.flatnonzero(np.isnan(y))
    weights = co_train((t[fit], m[fit]), (y[fit] > 0).astype(float), (t[free], m[free]))
    scales = [calibrated(x[held] @ w, y[held]) for x, w in zip((t, m), weights, strict=True)]
    logit = sum(a * (x[held] @ w) + b for x, w, (a, b) in zip((t, m), weights, scales, strict=True)) / 2
    good = np.sort(logit[y[held] > 0])
    cut = min(0.0, float(good[int(np.floor((1 - KEEP_SHARE) * len(good)))]) - 1e-9)
    return {"weights": [w.astype(np.float32) for w in weights], "scales": scales, "cut": cut}


def score(docs: DataFrame, model) -> DataFrame:
    """``docs`` with p_text, p_meta, quality_score and keep; equal texts decide alike."""
    added = ["p_text", "p_meta", "quality_score", "keep"]
    docs = docs.drop(*added)

    def values(texts: pd.Series, sources: pd.Series, langs: pd.Series) -> pd.DataFrame:
        if model is None:
            even = np.full(len(texts), 0.5)
            return pd.DataFrame(
                {"p_text": even, "p_meta": even, "quality_score": even, "keep": even > 0}
            )
        (wt, wm), ((at, bt), (am, bm)) = model["weights"], model["scales"]
        zt = np.array([float(text_view(t or "") @ wt) for t in texts]) * at + bt
        zm = np.array(
            [
                float(meta_view(t or "", s, g) @ wm)
                for t, s, g in zip(texts, sources, langs, strict=True)
            ]
        ) * am + bm
        z = (zt + zm) / 2

        def p(x):
            return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

        return pd.DataFrame(
            {"p_text": p(zt), "p_meta": p(zm), "quality_score": p(z), "keep": z >= model["cut"]}
        )

    udf = F.pandas_udf(values, "p_text double, p_meta double, quality_score double, keep boolean")
    (judged,) = fresh(docs.columns, "__q")
    return docs.withColumn(judged, udf("text", "source", "lang")).select(
        *docs.columns, *(F.col(f"{judged}.{name}").alias(name) for name in added)
    )


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model trained on a bounded sample of them."""
    return score(docs, train(docs, labels))


def without_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns."""
    # A name of its own, so that a column ``keep`` of the documents stays what it was.
    judged = score(docs.select(F.struct(*docs.columns).alias("__row"), "text", "source", "lang"), train(docs, labels))
    return judged.filter("keep").select("__row.*")
