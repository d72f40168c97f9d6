"""Quality rules: base rules, then an isolation forest on the rules' statistics.

The forest's random splits isolate unusual documents on short paths.  It is
fitted on a bounded sample of labelled documents; the threshold on its anomaly
score is calibrated on all labelled ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.llm.common import ASCII_SPACE, arrow_map, sampled_labels, stored, table, texts

#: Fixed by the contract: symbols, least words, largest percentage of words in repeated windows.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3
#: Labelled rows that the forest is fitted on, at most; its trees and their sample size.
MAX_LABELLED = 20_000
TREES, TREE_ROWS, DEPTH = 128, 128, 8
#: Bins of the anomaly score in which the calibration counts, and what a lost good document weighs against a kept bad one.
BINS, GOOD_WEIGHT = 2000, 2.0

UPPER, DIGITS, MARKS = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A)), b"!?;:()[]{}\"'/\\=+@_~^`-"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_distinct", "longest_word")


def repeat_words(words: list[bytes], size: int = REPEAT_WINDOW) -> tuple[int, int]:
    """(words in windows that occur at least twice, distinct words)."""
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    if len(words) <= size:
        return 0, len(ids)
    key = at[:len(at) - size + 1]
    for i in range(1, size):
        if len(ids) ** (i + 1) > 1 << 62:
            _, key = np.unique(key, return_inverse=True)
        key = key * len(ids) + at[i:len(at) - size + 1 + i]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key) + 1, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    hit = np.zeros(len(words), dtype=bool)
    for i in range(size):
        hit[i:i + len(key)] |= twice[:len(key)]
    return int(hit.sum()), len(ids)


def stats_of(text: str) -> tuple[int, ...]:
    raw = text.encode()
    words = raw.split()
    seen, dup, n_lines = set(), 0, 0
    for line in raw.split(b"\n"):
        if line and not line.isspace():
            n_lines += 1
            dup += line in seen
            seen.add(line)
    without = lambda drop: len(raw) - len(raw.translate(None, drop))
    repeated, distinct = repeat_words(words)
    return (len(words), len(text) - without(ASCII_SPACE), without(SYMBOLS), dup, repeated, n_lines, without(UPPER), without(DIGITS), without(MARKS),
            distinct, max(map(len, words), default=0))


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, the statistics) of every whole text; null is empty."""
    rows = texts(docs)

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            found = [stats_of(t.as_py()) for t in batch.column("text")]
            return {"doc_id": batch.column("doc_id")} | dict(zip(STATS, zip(*found, strict=True), strict=True))
        return work

    return arrow_map(rows, f"doc_id {dict(rows.dtypes)['doc_id']}, " + ", ".join(f"{s} bigint" for s in STATS), start)


def features(columns: dict[str, np.ndarray]) -> np.ndarray:
    """The statistics as rates of the text's size; shape (rows, features)."""
    c = {k: np.asarray(v, dtype=np.float64) for k, v in columns.items()}
    words, chars, lines = (np.maximum(c[k], 1) for k in ("n_words", "word_chars", "n_lines"))
    # rates that are rare in good text are stretched near zero, where they differ
    rate = lambda k, by: np.log1p(100 * c[k] / by)
    return np.column_stack([np.log1p(c["n_words"]), chars / words, rate("n_symbols", chars), rate("n_dup_lines", lines), rate("n_repeat_words", words),
                            rate("n_upper", chars), rate("n_digits", chars), rate("n_marks", chars), np.log1p(c["n_words"] / np.maximum(c["n_distinct"], 1)),
                            np.log1p(c["longest_word"])])


def path_correction(n: np.ndarray) -> np.ndarray:
    """Mean path length of an unsuccessful search in a random tree of n rows."""
    n = np.asarray(n, dtype=np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Complete binary trees as arrays: node k has the children 2k+1 and 2k+2."""

    feature: np.ndarray    # (trees, nodes), -1 at a leaf
    split: np.ndarray
    length: np.ndarray     # path length of a row that ends at this node
    norm: float

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """0 to 1, higher for shorter paths; 0 rows give none."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, s, length in zip(self.feature, self.split, self.length, strict=True):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                k = f[at]
                at = np.where(k < 0, at, 2 * at + 1 + (x[rows, np.maximum(k, 0)] >= s[at]))
            total += length[at]
        return 2.0 ** (-total / max(len(self.feature), 1) / max(self.norm, 1e-9))


def separation(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """For each feature the largest distance between its two distributions (good, bad), squared; all 1 without both kinds."""
    if not good.any() or good.all() or not len(x):
        return np.ones(x.shape[1])
    out = []
    for column in x.T:
        at = np.unique(column)
        out.append(np.abs(np.searchsorted(np.sort(column[good]), at, "right") / good.sum()
                          - np.searchsorted(np.sort(column[~good]), at, "right") / (~good).sum()).max())
    return np.square(out) + 1e-3


def fit_forest(x: np.ndarray, weight: np.ndarray, seed: int = 11) -> Forest:
    """Trees on random subsets of rows, split at random values of random features that still vary.

    A feature is drawn with its weight: statistics that don't tell labelled
    documents apart rarely isolate a document.
    """
    rng, nodes = np.random.default_rng(seed), 2 ** (DEPTH + 1) - 1
    size = min(TREE_ROWS, len(x))
    feature, split, length = np.full((TREES, nodes), -1, dtype=np.int16), np.zeros((TREES, nodes)), np.zeros((TREES, nodes))
    for t in range(TREES):
        todo = [(0, 0, x[rng.choice(len(x), size, replace=False)])] if len(x) else []
        while todo:
            node, depth, rows = todo.pop()
            low, high = rows.min(axis=0), rows.max(axis=0)
            varying = np.flatnonzero(high > low)
            if depth == DEPTH or len(rows) < 2 or not len(varying):
                length[t, node] = depth + float(path_correction(len(rows)))
                continue
            k = int(rng.choice(varying, p=weight[varying] / weight[varying].sum()))
            s = rng.uniform(low[k], high[k])
            s = s if s > low[k] else high[k]
            feature[t, node], split[t, node] = k, s
            right = rows[:, k] >= s
            todo += [(2 * node + 1, depth + 1, rows[~right]), (2 * node + 2, depth + 1, rows[right])]
    return Forest(feature, split, length, float(path_correction(size)))


def threshold_of(bins: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """Reject at a score of this or more: the bin edge that loses least, with weighted shares of good rejected and bad kept.

    Without labels of both kinds nothing is rejected.
    """
    if not good.sum() or not bad.sum():
        return 2.0
    g, b = np.zeros(BINS + 1), np.zeros(BINS + 1)
    np.add.at(g, bins, good)
    np.add.at(b, bins, bad)
    cost = GOOD_WEIGHT * np.append(np.cumsum(g[::-1])[::-1], 0) / g.sum() + np.append(0, np.cumsum(b)) / b.sum()
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    return float(best[-1]) / BINS if best[-1] <= BINS else 2.0


def judge(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, n_words, base statistics, base_failed, kept, anomaly) per row.

    Null and empty texts have no words and fail.  Repeated rows get equal
    rows.  Without usable labels the forest isn't fitted and only the base
    rules reject.
    """
    all_stats = stored(statistics(docs), "llm-quality")
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    passed = all_stats.where(~base_failed)
    # at most max_labelled ids: the bound makes the broadcast safe
    fit_on = passed.join(F.broadcast(sampled_labels(labels, "quality", max_labelled)), "doc_id").orderBy(*STATS, "doc_id").toPandas()
    x = features({s: fit_on[s].to_numpy() for s in STATS})
    forest = fit_forest(x, separation(x, fit_on["quality"].to_numpy() > 0))
    shared = docs.sparkSession.sparkContext.broadcast(forest)
    kinds = ", ".join(f"{n} {t}" for n, t in all_stats.dtypes)

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            x = features({s: batch.column(s).to_numpy() for s in STATS})
            return {n: batch.column(n) for n in batch.schema.names} | {"anomaly": pa.array(shared.value.anomaly(x))}
        return work

    scored = arrow_map(all_stats, f"{kinds}, anomaly double", start)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    counts = (scored.where(~base_failed).select("doc_id", F.floor(F.col("anomaly") * BINS).alias("bin")).join(known, "doc_id")
              .groupBy("bin").agg(F.sum((F.col("quality") > 0).cast("long")).alias("good"), F.sum((F.col("quality") <= 0).cast("long")).alias("bad")).toPandas())
    limit = threshold_of(*[counts[c].to_numpy(dtype=np.int64) for c in ("bin", "good", "bad")]) if len(counts) else 2.0
    return scored.withColumn("base_failed", base_failed).withColumn("kept", ~F.col("base_failed") & (F.floor(F.col("anomaly") * BINS) / BINS < limit))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, calibrated on ``labels.quality``."""
    out = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")
