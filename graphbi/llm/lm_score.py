"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class).  The class softmax
has weights for hashed features of the context (the word before, the word
before that, and both together).  It starts at the words' own shares, and its
updates are those of iterative scaling: a weight grows by the logarithm of
observed over expected counts of its feature and class, both with a
pseudocount.  Tasks sum the counts over their documents, Spark adds them up.
Texts are scored in numpy batches against the broadcast weights.

What is gathered grows with the corpus: the table of word counts, and the
number of buckets of hashed features (a power of two in proportion to the
training tokens, up to the ``BUCKETS`` that bound the broadcast).  Within a
class a word's share is its smoothed count.  Frequent words (a bounded table)
are split into classes of about equal count; all others share the last class,
and their counts are joined.

Null texts count as empty ones, which have an end token only; repeated rows
have equal scores; very long texts are hashed and scored in pieces; further
columns are not read; without training rows all words are unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.llm.common import ASCII_SPACE, LOWER, arrow_map, fields, partition_map, remainder, stored, table
from graphbi.llm.suffix_dedup import hash_words

#: Words in the table of frequent words, at most; classes; buckets of hashed features.
FREQUENT = 1 << 17
CLASSES = 32
#: Buckets of hashed features: one for so many training tokens, at least and at most.
TOKENS_PER_BUCKET, LEAST_BUCKETS, BUCKETS = 16, 1 << 12, 1 << 16
#: Kinds of features: previous word, skip, previous two; each position has one of each.
KINDS = 3
#: Gradient updates after the first; together they pass over all training documents once. The k-th has the rate 1 / k.
UPDATES = 2
#: Pseudocount of a feature; what a class seen with it gives to the prior (absolute discounting).
PRIOR, DISCOUNT = 64.0, 2.0
#: Bytes of text whose words are hashed at once, and positions scored at once.
_BYTES, _ROWS = 1 << 21, 1 << 15
#: The token at the end of a text; no word has this hash but by chance.
END = np.uint64(0x5851F42D4C957F2D)
_SPACE = np.ones(256, dtype=bool)
_SPACE[list(set(range(256)) - set(ASCII_SPACE))] = False


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of a lower-cased piece of text."""
    data = np.frombuffer(raw, dtype=np.uint8)
    word = ~_SPACE[data]
    edge = np.diff(np.concatenate([[False], word, [False]]).view(np.int8))
    return hash_words(raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))


def tokens(text: str | None) -> np.ndarray:
    """The words' hashes and the end token; a long text is hashed in pieces that end at white space."""
    raw, at, out = (text or "").encode().translate(LOWER), 0, []
    while at < len(raw):
        end = min(len(raw), at + _BYTES)
        while end < len(raw) and not _SPACE[raw[end]]:
            end += 1
        out.append(word_hashes(raw[at:end]))
        at = end
    return np.concatenate([*out, np.array([END], dtype=np.uint64)])


def blocks(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, lengths) of runs of texts: short texts are hashed together."""
    held, size, kept = [], 0, []

    def flush():
        buffer = b"\n".join(held)
        words = word_hashes(buffer)
        data = np.frombuffer(buffer, dtype=np.uint8)
        ends = np.cumsum([len(x) + 1 for x in held])
        word = ~_SPACE[data]
        begins = np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))
        upto = np.searchsorted(begins, ends)
        lengths = np.diff(np.concatenate([[0], upto])) + 1
        out = np.insert(words, upto, END)
        return out, lengths

    for text in column:
        text = text.as_py() or ""
        if len(text) > _BYTES // 4:
            if held:
                kept.append(flush())
                held, size = [], 0
            t = tokens(text)
            kept.append((t, np.array([len(t)])))
        else:
            held.append(text.encode().translate(LOWER))
            size += len(held[-1]) + 1
            if size >= _BYTES:
                kept.append(flush())
                held, size = [], 0
        yield from kept
        kept = []
    if held:
        yield flush()


def count_words(rows: DataFrame) -> DataFrame:
    """(h, c): tokens of all texts with their counts; summed in tasks, then in Spark."""
    def run(batches):
        hs, ns, size = [], [], 0

        def merged():
            h, inverse = np.unique(np.concatenate(hs), return_inverse=True)
            return h, np.bincount(inverse, weights=np.concatenate(ns), minlength=len(h)).astype(np.int64)

        for batch in batches:
            for t, _ in blocks(batch.column("text")):
                h, n = np.unique(t, return_counts=True)
                hs.append(h)
                ns.append(n)
                size += len(h)
                if size > 2_000_000:
                    h, n = merged()
                    hs, ns, size = [h], [n], len(h)
                    if size > 1_000_000:
                        yield {"h": h.view(np.int64), "c": n}
                        hs, ns, size = [], [], 0
        if hs:
            h, n = merged()
            yield {"h": h.view(np.int64), "c": n}

    return partition_map(rows.select("text"), "h bigint, c bigint", run).groupBy("h").agg(F.sum("c").alias("c"))


@dataclass
class Words:
    """The frequent words, sorted by hash, and the sizes of the classes; the last class has all other words."""

    hashes: np.ndarray    # uint64, sorted
    counts: np.ndarray
    classes: np.ndarray
    size: np.ndarray      # denominators of the classes: tokens and half the words, and half for unknown words in the last
    total: int            # training tokens
    distinct: int

    def look_up(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1, class) of each token."""
        if not len(self.hashes):
            return np.full(len(t), -1), np.full(len(t), CLASSES - 1)
        at = np.minimum(np.searchsorted(self.hashes, t), len(self.hashes) - 1)
        at = np.where(self.hashes[at] == t, at, -1)
        return at, np.where(at >= 0, self.classes[at], CLASSES - 1)


def choose_words(counts: DataFrame, frequent: int = FREQUENT) -> Words:
    """The words above the smallest count that at most ``frequent`` words reach, in classes of about equal count."""
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).head()
    level = F.floor(F.log2("c") * 8)  # a few hundred levels, whatever the counts
    levels = sorted(map(tuple, counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    least, n = None, 0
    for at, words in levels:
        if n + words > frequent:
            break
        least, n = at, n + words
    # n words, at most `frequent`
    top = counts.where(level >= least).toPandas() if least is not None else counts.limit(0).toPandas()
    h, c = top["h"].to_numpy(dtype=np.int64).view(np.uint64), top["c"].to_numpy(dtype=np.int64)
    order = np.lexsort((h, -c))
    upto = np.cumsum(c[order])
    classes = np.empty(len(c), dtype=np.int64)
    classes[order] = np.minimum((upto - c[order]) * (CLASSES - 1) // max(int(c.sum()), 1), CLASSES - 2)
    size = np.bincount(classes, weights=c + 0.5, minlength=CLASSES)
    size[-1] = total - int(c.sum()) + 0.5 * (distinct - len(c) + 1)
    order = np.argsort(h)
    return Words(h[order], c[order], classes[order], size, int(total), int(distinct))


def bucket_count(tokens: int) -> int:
    return min(BUCKETS, max(LEAST_BUCKETS, 1 << max(tokens // TOKENS_PER_BUCKET - 1, 0).bit_length()))


def feature_buckets(t: np.ndarray, lengths: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of the features of each position, shape (KINDS, positions); before a text there are end tokens."""
    begin = np.zeros(len(t), dtype=bool)
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    begin[starts] = True
    one = np.where(begin, END, np.concatenate([[END], t[:-1]]))
    after = np.concatenate([[True], begin[:-1]]) | begin
    two = np.where(after, END, np.concatenate([[END, END], t[:-2]])[:len(t)])
    keys = (one * np.uint64(0x9E3779B97F4A7C15), two * np.uint64(0xC2B2AE3D27D4EB4F), (one * np.uint64(0x165667B19E3779F9)) ^ (two * np.uint64(0xD6E8FEB86659FD93)))
    bits = np.uint64(64 - buckets.bit_length() + 1)
    return np.stack([((k ^ (k >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)) >> bits for k in keys]).astype(np.int64)


def class_log_probs(weights: np.ndarray, bias: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """Natural logarithms of P(class | context), shape (positions, classes)."""
    z = weights[buckets[0]]
    for b in buckets[1:]:
        z += weights[b]
    z += bias
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _summed(rows: DataFrame, kind: str, gather) -> np.ndarray:
    """Sums by bucket and class of what ``gather(batches)`` finds in the texts of each task, shape (buckets, CLASSES)."""
    names = [f"c{k}" for k in range(CLASSES)]

    def run(batches):
        found = gather(batches)
        at = np.flatnonzero(found.any(axis=1))
        yield {"bucket": at, "of": np.full(len(at), len(found)), **{f"c{k}": found[at, k] for k in range(CLASSES)}}

    # a task's sums are as large as the model, so there are only as many tasks as keep all cores busy
    few = rows.select("text").coalesce(2 * rows.sparkSession.sparkContext.defaultParallelism)
    summed = (partition_map(few, "bucket bigint, of bigint, " + ", ".join(f"{c} {kind}" for c in names), run)
              .groupBy("bucket").agg(F.max("of").alias("of"), *[F.sum(c).alias(c) for c in names])).toPandas()
    out = np.zeros((int(summed["of"].max()) if len(summed) else LEAST_BUCKETS, CLASSES))
    out[summed["bucket"].to_numpy(dtype=np.int64)] = summed[names].to_numpy()
    return out


def _observed(rows: DataFrame, shared, buckets: int) -> np.ndarray:
    """How often each class follows a feature."""
    def gather(batches):
        words, found = shared.value, np.zeros(buckets * CLASSES, dtype=np.int64)
        for batch in batches:
            for t, lengths in blocks(batch.column("text")):
                _, c = words.look_up(t)
                found += np.bincount((feature_buckets(t, lengths, buckets) * CLASSES + c).ravel(), minlength=buckets * CLASSES)
        return found.reshape(buckets, CLASSES)

    return _summed(rows, "bigint", gather)


def _gradient(rows: DataFrame, shared, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Observed minus expected classes of each feature over the texts of ``rows``."""
    model = rows.sparkSession.sparkContext.broadcast((weights, bias))

    def gather(batches):
        words, (w, b0) = shared.value, model.value
        found = np.zeros(w.shape, dtype=np.float32)
        for batch in batches:
            for t, lengths in blocks(batch.column("text")):
                _, c = words.look_up(t)
                f = feature_buckets(t, lengths, len(w))
                for at in range(0, len(t), _ROWS):
                    b = f[:, at:at + _ROWS]
                    rest = -np.exp(class_log_probs(w, b0, b))
                    rest[np.arange(len(rest)), c[at:at + _ROWS]] += 1
                    for k in b.astype(np.uint16):  # buckets fit; numpy sorts them by radix, in the same order
                        order = np.argsort(k, kind="stable")
                        cut = np.flatnonzero(np.concatenate([[True], np.diff(k[order]) != 0]))
                        found[k[order[cut]]] += np.add.reduceat(rest[order], cut, axis=0)
        return found

    return _summed(rows, "float", gather)


def train(rows: DataFrame, words: Words, updates: int = UPDATES):
    """(weights, bias) from the texts of ``rows``: a first update on all, then one on each of ``updates`` parts.

    At zero weights each feature expects classes by the bias, so the first
    expectation needs no pass; later ones are carried on from their part to all.
    """
    buckets = bucket_count(words.total)
    p = np.maximum(words.size / max(words.size.sum(), 1e-12), 1e-12)
    bias = np.log(p).astype(np.float32)
    if not words.total:
        return np.zeros((buckets, CLASSES), dtype=np.float32), bias
    shared = rows.sparkSession.sparkContext.broadcast(words)
    seen = _observed(rows, shared, buckets)
    # what was seen once tells little of other texts: each class seen gives a part of its count to the prior
    less = np.minimum(seen, DISCOUNT)
    prior = (PRIOR + less.sum(axis=1, keepdims=True)) * p
    scaled = lambda expected: np.log((seen - less + prior) / (np.maximum(expected, 0) + PRIOR * p)) / KINDS
    weights = scaled(seen.sum(axis=1, keepdims=True) * p).astype(np.float32)
    for k in range(updates):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(updates)) == k)
        gradient = _gradient(part, shared, weights, bias)
        gradient = gradient if len(gradient) == buckets else np.zeros((buckets, CLASSES))  # a part without rows
        weights = (weights + scaled(seen - updates * gradient) / (k + 1)).astype(np.float32)
    return weights, bias


_SCORED = "key binary, n_tokens bigint, known bigint, log_counts double, log_class double, log_size double, sender int, rare array<struct<h:bigint,n:int>>"


def score(docs: DataFrame, held_out=None, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row; logarithms to base 10.

    ``held_out``: a boolean column of rows that aren't learned from; by default
    crc32 of the id mod 5 is 1.  Null texts are empty and have the end token
    only.  A null id isn't held out.  Repeated rows get equal scores, and each
    counts in training.  Without training rows all words are unknown.
    """
    held = F.coalesce(remainder("doc_id", 5) == 1 if held_out is None else held_out, F.lit(False))
    rows = docs.select("doc_id", held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    training = rows.where(~F.col("held_out"))
    counts = stored(count_words(training), "llm-words")
    words = choose_words(counts, frequent)
    sc, kind = docs.sparkSession.sparkContext, dict(rows.dtypes)["doc_id"]
    shared, model = sc.broadcast(words), sc.broadcast(train(training, words))
    names = fields(_SCORED).names

    def start():
        from pyspark import TaskContext

        words, (weights, bias) = shared.value, model.value
        log_count, log_size = np.log10(words.counts + 0.5), np.log10(np.maximum(words.size, 1e-300))
        part, sent = TaskContext.get().partitionId(), set()

        def work(batch: pa.RecordBatch) -> dict:
            column = batch.column("text")
            out = {c: [] for c in names} | {"key": [xxhash.xxh3_128_digest(t.as_py()) for t in column]}
            for t, lengths in blocks(column):
                at, c = words.look_up(t)
                f, log_class = feature_buckets(t, lengths, len(weights)), np.empty(len(t))
                for i in range(0, len(t), _ROWS):
                    k = c[i:i + _ROWS]
                    log_class[i:i + _ROWS] = class_log_probs(weights, bias, f[:, i:i + _ROWS])[np.arange(len(k)), k]
                begins = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
                known = at >= 0
                sums = lambda x: np.add.reduceat(x, begins).tolist()
                out["n_tokens"] += lengths.tolist()
                out["known"] += sums(known.astype(np.int64))
                out["log_counts"] += sums(np.where(known, log_count[at] if len(log_count) else 0.0, 0.0))
                out["log_class"] += sums(log_class / np.log(10))
                out["log_size"] += sums(log_size[c])
                for a, n in zip(begins.tolist(), lengths.tolist(), strict=True):
                    key = out["key"][len(out["rare"])]
                    if key in sent:  # a task sends the rare words of a text once
                        out["rare"].append(None)
                        continue
                    sent.add(key)
                    h, times = np.unique(t[a:a + n][~known[a:a + n]], return_counts=True)
                    out["rare"].append([{"h": x, "n": y} for x, y in zip(h.view(np.int64).tolist(), times.tolist(), strict=True)])
            return out | {"sender": [part] * batch.num_rows, "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out")}
        return work

    scored = stored(arrow_map(rows, f"doc_id {kind}, held_out boolean, {_SCORED}", start), "llm-scored")
    uses = scored.where(F.size("rare") > 0).select("key", "sender", F.explode("rare").alias("w")).select("key", "sender", "w.h", "w.n")
    found = uses.join(counts, "h", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    by_text = (found.groupBy("key", "sender").agg(F.sum(F.col("n") * F.log10(F.col("c") + 0.5)).alias("rare_counts"),
                                                  F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("rare_known"))
               .groupBy("key").agg(F.min("rare_counts").alias("rare_counts"), F.min("rare_known").alias("rare_known")))  # the same from each sender
    size = float(np.log10(words.total + 0.5 * (words.distinct + 1)))
    log_counts = F.col("log_counts") + F.coalesce("rare_counts", F.lit(0.0))
    return scored.drop("rare").join(by_text, "key", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(words.total).cast("bigint").alias("train_tokens"),
        (log_counts - F.col("n_tokens") * size).alias("base_score"), (log_counts + F.col("log_class") - F.col("log_size")).alias("score"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, learned from four fifths of them."""
    return score(table(spark, sf_dir, "documents"))
