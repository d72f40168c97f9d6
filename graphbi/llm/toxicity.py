"""Toxicity: a factorization machine over hashed terms.

The machine adds to linear weights a learned interaction of each pair of
terms (the inner product of their factors), so a pair can weigh more than its
parts.  Terms are the words of a text (runs of letters, lower-cased) and their
first letters, so that compounds and inflected forms share a term.  They are
hashed to a fixed number of buckets; the buckets that tell the classes apart
best are kept.  The model has a fixed size.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.llm.common import arrow_map, partition_map, remainder, sampled_labels, small_batches, table, texts

#: Labelled rows that the model is fitted on, at most (a sample by a hash of the id).
MAX_LABELLED = 20_000
BUCKETS = 1 << 18
TERMS, FACTORS = 512, 8
WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the word beginnings that are terms too.
STEMS = (4, 5, 6)
STEPS, BATCH, RATE, DECAY = 1200, 256, 0.02, 2e-4
THRESHOLD = 0.3
#: Entries of a task's cache from word to term.
CACHE = 400_000


@dataclass
class Model:
    slot: np.ndarray      # bucket -> term or -1
    bias: float
    linear: np.ndarray    # (terms,)
    factors: np.ndarray   # (terms, factors)

    def score(self, terms: np.ndarray) -> float:
        z = self.bias
        if len(terms):
            v = self.factors[terms]
            s = v.sum(axis=0)
            z += self.linear[terms].sum() + 0.5 * float((s * s).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def words_of(text: str) -> set[str]:
    return set(WORD.findall(text.lower()))


def word_buckets(word: str) -> list[int]:
    """The buckets of a word and of its beginnings."""
    terms = [word] + [word[:k] + "*" for k in STEMS if len(word) >= k]
    return [zlib.crc32(t.encode()) % BUCKETS for t in terms]


def buckets_of(text: str) -> np.ndarray:
    return np.array(sorted({b for w in words_of(text) for b in word_buckets(w)}), dtype=np.int64)


class Terms:
    """Distinct terms of a text through a bounded cache."""

    def __init__(self, slot: np.ndarray):
        self.slot, self.cache = slot, {}

    def __call__(self, text: str) -> np.ndarray:
        cache, found = self.cache, set()
        for w in words_of(text):
            t = cache.get(w)
            if t is None:
                if len(cache) >= CACHE:
                    cache.clear()
                t = cache[w] = tuple(k for b in word_buckets(w) if (k := int(self.slot[b])) >= 0)
            if t:
                found.update(t)
        return np.fromiter(found, dtype=np.int64, count=len(found))


def _choose(sample: DataFrame) -> np.ndarray:
    """The slots: buckets with the largest chi-square between presence and label, over the sample."""
    def run(batches):
        n, pos = np.zeros(BUCKETS, dtype=np.int64), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
                b = buckets_of(text.as_py())
                n[b] += 1
                pos[b] += y
        at = np.flatnonzero(n)
        yield {"bucket": at, "n": n[at], "pos": pos[at]}

    counts = partition_map(sample, "bucket bigint, n bigint, pos bigint", run).groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    rows, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).head()
    slot = np.full(BUCKETS, -1, dtype=np.int32)
    if 0 < ones < rows:
        expect = F.col("n") * F.lit(ones / rows)
        gain = (F.col("pos") - expect) * (F.col("pos") - expect) / (expect * F.lit(1 - ones / rows) + F.lit(1.0))
        best = counts.orderBy(gain.desc(), "bucket").limit(TERMS).select("bucket").toPandas()["bucket"].to_numpy(dtype=np.int64)
        slot[best] = np.arange(len(best))
    return slot


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, where=None) -> Model:
    """Fits on at most about ``max_labelled`` rows of ``labels`` (doc_id, toxic) that ``where`` admits.

    With no rows, or rows of one class only, the score is the smoothed share of label 1.
    """
    chosen = sampled_labels(labels, "toxic", max_labelled, where)
    # at most max_labelled ids and labels: the bound makes the broadcast safe
    sample = texts(docs).join(F.broadcast(chosen), "doc_id")
    slot = _choose(sample)
    if (slot >= 0).any():
        def start():
            terms = Terms(slot)

            def work(batch: pa.RecordBatch) -> dict:
                return {"terms": [sorted(terms(t.as_py()).tolist()) for t in batch.column("text")], "toxic": batch.column("toxic")}
            return work
        rows = arrow_map(sample, "terms array<int>, toxic int", start)
    else:
        rows = sample.select(F.expr("cast(array() as array<int>)").alias("terms"), "toxic")
    rows = rows.groupBy("terms", "toxic").count().orderBy(F.xxhash64("terms"), "terms", "toxic").toPandas()
    return train(slot, [np.asarray(t, dtype=np.int64) for t in rows["terms"]], rows["toxic"].to_numpy(dtype=np.float32), rows["count"].to_numpy(dtype=np.float32))


def train(slot: np.ndarray, terms: list[np.ndarray], y: np.ndarray, weight: np.ndarray, seed: int = 7) -> Model:
    """Minibatch Adam on the logistic loss; equal rows are one row with a weight."""
    total = float(weight.sum())
    prior = (float((y * weight).sum()) + 0.5) / (total + 1.0)
    rng = np.random.default_rng(seed)
    n_terms = int(slot.max()) + 1
    bias = np.array([np.log(prior / (1 - prior))], dtype=np.float32)
    params = [bias, np.zeros(max(n_terms, 1), dtype=np.float32), rng.normal(0, 0.02, (max(n_terms, 1), FACTORS)).astype(np.float32)]
    if n_terms <= 0 or not 0 < y.mean() < 1:
        params[2][:] = 0
        return Model(slot, float(bias[0]), params[1], params[2])
    x = np.zeros((len(y), n_terms), dtype=np.uint8)
    for i, t in enumerate(terms):
        x[i, t] = 1
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.sqrt(weight)  # a text that is copied very often doesn't outweigh all others
    epochs = -(-STEPS * BATCH // len(y))  # few rows are passed more often
    for epoch in range(epochs):
        order, rate = rng.permutation(len(y)), RATE * (1 - epoch / epochs)
        for at in range(0, len(y), BATCH):
            rows = order[at:at + BATCH]
            xb, wb = x[rows].astype(np.float32), weight[rows]
            s = xb @ params[2]
            z = params[0][0] + xb @ params[1] + 0.5 * ((s * s).sum(1) - xb @ (params[2] ** 2).sum(1))
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y[rows]) * wb / wb.sum()
            gx = xb.T @ g
            grads = [np.array([g.sum()], dtype=np.float32), gx + DECAY * params[1], xb.T @ (g[:, None] * s) - gx[:, None] * params[2] + DECAY * params[2]]
            step += 1
            for p, d, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (d - m)
                v += 0.001 * (d * d - v)
                p -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-6)
    return Model(slot, float(params[0][0]), params[1].astype(np.float64), params[2].astype(np.float64))


def add_score(rows: DataFrame, model: Model, text_col: str, out: str) -> DataFrame:
    """``rows`` with the score of the whole text in a new column; a null text counts as empty."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def start():
        model = shared.value
        terms = Terms(model.slot)
        return lambda batch: {n: batch.column(n) for n in batch.schema.names} | {out: [model.score(terms(t.as_py() or "")) for t in batch.column(text_col)]}

    return arrow_map(small_batches(rows), f"{kinds}, `{out}` double", start)


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) per row.

    Learned from labels of ids whose crc32 mod 4 isn't 2.  Null and empty texts
    have no terms and get the score of the bias.  A null id isn't held out and
    never learned from.  Repeated rows get equal scores.
    """
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = fit(docs, labels, where=~held)
    rows = add_score(texts(docs), model, "text", "score")
    return rows.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from ``labels.toxic``."""
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; all columns stay."""
    held = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False))
    model = fit(docs, labels, where=~held)
    return add_score(docs, model, "text", "__llm_score").where(F.col("__llm_score") < threshold).drop("__llm_score")
