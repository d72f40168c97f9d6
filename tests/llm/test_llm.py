"""The training-data operators against plain versions, on small tables with awkward rows."""

import base64
import hashlib
import importlib.util
import itertools
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
from graphbi.llm import bloom, bpe, components, decontaminate, html_text, lm_score, quality_rules, queries, simhash, suffix_dedup, toxicity, url_filter, warc  # noqa: E402

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, fingerprint string, items string, rule string"


def words(n, seed, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", ",", "É", "."]) for _ in range(n)]


def awkward():
    """Nulls, empty and wordless texts, ties, repeated rows, equal and near copies, repeated passages, a very long text."""
    passage, other = " ".join(words(60, 1)), " ".join(words(120, 2))
    texts = [None, "", " \n\t ", "one", "Two words", "a b c", other, other, other + " tail", passage, "x " + passage + " y",
             " ".join(words(30, 3)) + "\n" + passage.replace(" ", "\n") + " " + " ".join(words(40, 4)), "same line\n" * 90, "dup " * 200,
             " ".join(words(20000, 5, 5000)), "q" * 30000, "é" * 9000 + " <|endoftext|> z", "idiot scum " + " ".join(words(70, 6)), "# * $ % & | < > " * 30]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "null id"), (None, None), (7, other), (7, other), (-5, other)]
    return [(i, t, None, "s" if i else None, None if t is None else len(t), 1.0, "f", "i", None) for i, t in rows]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), DOCS).repartition(3).persist()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_bloom(spark):
    keys = spark.range(0, 5000).selectExpr("xxhash64(id) as h")
    f = bloom.build(keys, keys.h, 5000)
    assert bloom.probe(f, np.array([r.h for r in keys.collect()])).all()
    rest = np.array([r.h for r in spark.range(10**6, 10**6 + 20000).selectExpr("xxhash64(id) as h").collect()])
    assert bloom.probe(f, rest).mean() < 0.02
    assert bloom.build(keys, keys.h, 10**12, 1 << 12).nbytes == 1 << 12
    assert not bloom.probe(bloom.build(keys.limit(0), keys.h, 0), rest).any()


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (1, 2), (1, 2)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        before = dict(root)
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
        if before == root:
            break
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    assert got == {x: root[x] for x in linked}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- toxicity and quality --------------------------------------------------------------------------------

def labelled(spark):
    """Documents in which an insult is toxic only together with a group."""
    rng, rows, labels = random.Random(9), [], []
    for i in range(1500):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        w = words(30, i, 200) + ["insult"] * insult + ["group"] * group
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(insult and group)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_toxicity(spark, docs, none):
    some, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score(some, labels).collect()}
    want = {r.doc_id: r.toxic for r in labels.collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert np.mean([got[i].predicted == want[i] for i in held]) > 0.95
    out = toxicity.score(docs, labels.limit(0))
    assert out.columns == ["doc_id", "held_out", "score", "predicted"] and out.count() == docs.count()
    assert {r.score for r in out.collect()} == {0.5}
    assert toxicity.score(none, labels).count() == 0
    kept = toxicity.drop_toxic(docs, labels, threshold=1.1)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    assert toxicity.drop_toxic(docs, labels, threshold=0.0).count() == 0


def test_toxicity_scores_like_a_plain_model(spark):
    """Every pair of a text's terms, one after the other, on the same fitted model."""
    some, labels = labelled(spark)
    model = toxicity.fit(some, labels)
    got = {r.doc_id: r.s for r in toxicity.add_score(some, model, "text", "s").collect()}
    for r in some.where("doc_id % 50 = 0").collect():
        words_in = set(re.findall(toxicity.WORD.pattern, r.text.lower()))
        pieces = words_in | {w[:k] + "*" for w in words_in for k in (4, 5, 6) if len(w) >= k}
        at = sorted({int(model.slot[zlib.crc32(p.encode()) % len(model.slot)]) for p in pieces} - {-1})
        z = model.bias + sum(model.linear[i] for i in at)
        for i, j in itertools.combinations(at, 2):
            z += sum(float(a) * float(b) for a, b in zip(model.factors[i], model.factors[j], strict=True))
        assert got[r.doc_id] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)


def test_forest_scores_like_plain_paths():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(700, 4))
    x[:, 3] = 1.0  # never splits
    forest = quality_rules.fit_forest(x, np.ones(4))
    assert (forest.feature != 3).all()

    def path(t, row):
        node, steps = 0, 0
        while forest.feature[t, node] >= 0:
            node = 2 * node + (2 if row[forest.feature[t, node]] >= forest.split[t, node] else 1)
            steps += 1
        # what ends here stands for a random tree of the rows left: at least the steps taken
        assert forest.length[t, node] >= steps
        return forest.length[t, node]

    want = [2 ** (-np.mean([path(t, row) for t in range(len(forest.feature))]) / forest.norm) for row in x[:40]]
    assert np.allclose(forest.anomaly(x[:40]), want)
    assert forest.anomaly(np.array([[40.0, -40.0, 40.0, 1.0]]))[0] > forest.anomaly(x).max()


def plain_stats(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality_rules(spark, docs, none):
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    empty = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    want = []
    for r in docs.collect():
        s = plain_stats(r.text)
        failed = s[0] < 50 or 100 * s[4] > 50 * s[0]
        want.append((r.doc_id, *s, failed, not failed))
    assert rows_of(quality_rules.judge(docs, empty).select(*base)) == sorted(want, key=repr)
    assert quality_rules.judge(none, empty).count() == 0
    rng = random.Random(2)
    many, labels = [], []
    for i in range(600):
        w = words(120, i, 3000)
        bad = rng.random() < 0.15
        many.append((i, " ".join(x + "%%%" * (bad and rng.random() < 0.8) for x in w)))
        labels.append((i, int(not bad), 0))
    got = {r.doc_id: r.kept for r in quality_rules.judge(spark.createDataFrame(many, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    assert np.mean([got[i] == bool(q) for i, q, _ in labels]) > 0.98


# -- encoding --------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(bpe.TOKENIZER))


def test_join_chunks(library):
    codec, rng = bpe.codec(public_tokenizers.path(bpe.TOKENIZER)), random.Random(1)
    letters = " \n\t\x0b\x1c  abcdeéÉΣσß'’s<|endoftext|>123世界éͅİ🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 300))) for _ in range(150)] + ["a<|endoftext|>b <|startoftext|> x" * 30, "x" * 20000, "ab " * 4000]
    for text in texts:
        raw, want = text.encode(), library.encode(text, add_special_tokens=False).ids
        for kw in ({}, {"cut_bits": 4, "least": 4, "most": 50}, {"cut_bits": 2, "least": 1, "most": 9}):
            if len(raw) > 9000 and kw:
                continue
            ends = bpe.cuts(raw, **kw)
            pieces = [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            assert b"".join(pieces) == raw
            assert np.frombuffer(bpe.join_chunks(codec, raw, ends, [codec.encode(p) for p in pieces]), dtype=codec.kind).tolist() == want


def test_bpe(docs, none, library):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    path = public_tokenizers.path(bpe.TOKENIZER)
    assert rows_of(bpe.encode(docs, path)) == sorted(want, key=repr)
    assert rows_of(bpe.encode(docs, path, max_filter_bytes=64)) == sorted(want, key=repr)  # a full filter: all chunks go the shared way
    assert bpe.encode(none, path).count() == 0


# -- decontamination -------------------------------------------------------------------------------------

def test_decontaminate(spark, docs, none):
    other = " ".join(words(120, 2))
    items = [(3, other[40:300].upper()), (20, "two words"), (20, "one"), (None, "a b c"), (4, None), (5, ""), (3, other[40:300]), (9, " ".join(words(15, 77)))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    windows = {}
    for i, t in items:
        w = split(t)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k:k + 10]), set()).add(i)
    want = []
    for r in docs.collect():
        w, hit, found = split(r.text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[k:k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= ids - {None}
        names = ",".join(sorted(map(str, found)))
        want.append((r.doc_id, len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit)))
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    out = decontaminate.find_hits(docs, bench).persist()
    assert rows_of(out.select(cols)) == sorted(want, key=repr) and any(w[-1] for w in want)
    assert rows_of(decontaminate.find_hits(docs, bench, block_chars=100).select(cols)) == sorted(want, key=repr)  # several automata
    text = {r.doc_id: r.text for r in docs.collect() if r.doc_id is not None}
    for r in out.where("contaminated and doc_id is not null").collect():
        assert sum(len(split(text[r.doc_id][s.start:s.end])) for s in r.spans) == r.n_hit
    assert not any(r.contaminated for r in decontaminate.find_hits(docs, bench.limit(0)).collect())
    assert decontaminate.find_hits(none, bench).count() == 0
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(not w[-1] for w in want)


# -- near duplicates -------------------------------------------------------------------------------------

def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    h = [xxhash.xxh64_intdigest(" ".join(w[i:i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, radius=2):
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    fps = sorted(fps)
    for i, a in enumerate(fps):
        for b in fps[i + 1:]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {f: top(f) for f in fps}


def test_simhash(docs, none):
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    top = linked({f for _, f in rows})
    least = {}
    for i, f in rows:
        if i is not None:
            least[top[f]] = min(i, least.get(top[f], i))
    assert rows_of(simhash.near_duplicates(docs)) == sorted(((i, f"{f:016x}", least.get(top[f])) for i, f in rows), key=repr)
    assert simhash.near_duplicates(none).count() == 0
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(top[plain_fingerprint(r.text)] for r in kept.collect()) == sorted(set(top.values()))
    assert all(r.doc_id == least.get(top[plain_fingerprint(r.text)]) for r in kept.collect())


@pytest.mark.parametrize("tile_rows", [4096, 7])
def test_near_pairs(spark, tile_rows):
    rng, fps = random.Random(4), set()
    for _ in range(60):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(f)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                f ^= 1 << b
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    edges = simhash.near_pairs(spark.createDataFrame([(signed(f),) for f in fps], "fp bigint"), tile_rows=tile_rows).collect()
    root = {f: f for f in fps}
    for _ in fps:
        for e in edges:
            a, b = e.a % 2**64, e.b % 2**64
            root[a] = root[b] = min(root[a], root[b])
    top = linked(fps)
    least = {}
    for f, t in top.items():
        least[t] = min(f, least.get(t, f))
    assert root == {f: least[top[f]] for f in fps}


# -- repeated passages -----------------------------------------------------------------------------------

def plain_cover(texts, size=50):
    split = {t: t.encode().split() for t in texts}
    count = Counter(tuple(w[p:p + size]) for w in split.values() for p in range(len(w) - size + 1))
    return {t: {q for p in range(len(w) - size + 1) if count[tuple(w[p:p + size])] > 1 for q in range(p, p + size)} for t, w in split.items()}, count


def test_repeated_spans(spark, docs, none):
    # near copies with edits, a passage shared by many, a line repeated within a text
    rng, rows = random.Random(8), [(r.doc_id, r.text) for r in docs.collect()]
    parent = words(300, 50)
    for i in range(25):
        w = list(parent)
        for _ in range(3):
            w[rng.randrange(300)] = f"edit{i}"
        rows.append((100 + i, " ".join(w)))
        rows.append((200 + i, " ".join([*words(20, i), *parent[100:170], *words(20, 90 + i)])))
    many = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).persist()
    texts = {t for _, t in rows if t}
    cover, _ = plain_cover(texts)
    by_key = {xxhash.xxh3_128_digest(t): t for t in texts}
    for max_group in (10_000, 4, 1):  # all sorted in tasks, some and all counted by Spark
        got = {by_key[bytes(r.key)]: r for r in suffix_dedup.repeated_spans(many, max_group=max_group).collect()}
        spread = lambda flat: {q for a, b in zip(flat[::2], flat[1::2], strict=True) for q in range(a, b)}
        assert {t: spread(r.covered) for t, r in got.items()} == {t: c for t, c in cover.items() if c}
        # the first occurrence of each window is whole in one text
        whole = Counter()
        for t, r in got.items():
            w, kept = t.encode().split(), spread(r.kept)
            whole.update({tuple(w[p:p + 50]) for p in range(len(w) - 49) if kept.issuperset(range(p, p + 50))})
        assert set(whole) >= {tuple(t.encode().split()[p:p + 50]) for t, c in cover.items() for p in c if c.issuperset(range(p, p + 50)) and p + 50 <= len(t.split())} & set(plain_cover(texts)[1] - Counter(set(plain_cover(texts)[1])))
    out = suffix_dedup.find_repeats(many)
    assert out.columns == ["doc_id", "first_word", "n_words", "removable"]
    copies = Counter(t for _, t in rows)
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, set()).update(range(r.first_word, r.first_word + r.n_words))
    want = {i: set(range(len(t.encode().split()))) if copies[t] > 1 else cover[t] for i, t in rows if t and len(t.encode().split()) >= 50}
    assert got == {i: c for i, c in want.items() if c}
    assert suffix_dedup.find_repeats(none).count() == 0
    kept = suffix_dedup.drop_repeats(docs)
    assert kept.columns == docs.columns and suffix_dedup.drop_repeats(none).count() == 0
    after = [r.text for r in kept.collect()]
    assert sum(" ".join(words(60, 1)) in " ".join((t or "").split()) for t in after) == 1
    clean = {r.text for r in docs.collect() if r.text is None or not cover.get(r.text)} - {" ".join(words(120, 2))}
    assert clean <= set(after)


def test_cut_words():
    assert suffix_dedup.cut_words(" a b\nc  d ", [1, 3]) == " a d "
    assert suffix_dedup._minus([0, 10, 20, 30], [2, 4, 25, 40]) == [0, 2, 4, 10, 20, 25]


# -- language model --------------------------------------------------------------------------------------

def test_lm_score(spark, docs, none):
    more = [(1000 + i, " ".join(words(40, i, 50) if i % 2 else [w.upper() + "x" for w in words(40, i, 50)])) for i in range(300)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id bigint, text string")).persist()
    rows = [tuple(r) for r in both.collect()]
    toks = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW)) + ["\n"], i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t in rows]
    c = Counter(w for _, t, held in toks if not held for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6)) for i, t, held in toks), key=repr)
    for frequent in (1 << 17, 40, 0):  # all, some and no words in the table
        out = lm_score.score(both, frequent=frequent).persist()
        assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out.collect()), key=repr) == want
        if frequent == 1 << 17:  # contexts tell the two kinds of texts apart
            held = [r for r in out.collect() if r.held_out]
            assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_score.score(none).count() == 0


def test_lm_model(spark):
    """The trained softmax and its scores, computed position by position."""
    rng = random.Random(5)
    texts = [(i, " ".join(f"A{k} b{k}" for k in (rng.randrange(60) for _ in range(30)))) for i in range(60)] + [(100, "new words"), (101, None), (7, "A1 b1"), (None, "A1 b1")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    training = docs.where(~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))).withColumn("text", F.coalesce("text", F.lit("")))
    counts = lm_score.count_words(training)
    words = lm_score.choose_words(counts, 100)
    all_counts = {np.int64(r.h).view(np.uint64): r.c for r in counts.collect()}
    n, K = lm_score.bucket_count(words.total), lm_score.CLASSES
    share = words.size / words.size.sum()
    p = np.maximum(share, 1e-12)

    def positions(text):
        t = lm_score.tokens(text)
        f = lm_score.feature_buckets(t, np.array([len(t)]), n)
        return [(f[:, i], int(words.look_up(t[i:i + 1])[1][0]), all_counts.get(t[i], 0)) for i in range(len(t))]

    def q(weights, f):
        z = np.log(p) + sum(weights[b] for b in f)
        e = np.exp(z - z.max())
        return e / e.sum()

    rows = [(i, text or "", positions(text)) for i, text in texts]
    learned = [(text, x) for i, text, x in rows if not held(i)]
    seen = np.zeros((n, K))
    for _, x in learned:
        for f, c, _ in x:
            for b in f:
                seen[b, c] += 1
    less = np.minimum(seen, lm_score.DISCOUNT)
    prior = (lm_score.PRIOR + less.sum(axis=1, keepdims=True)) * p
    step = lambda expected: np.log((seen - less + prior) / (np.maximum(expected, 0) + lm_score.PRIOR * p)) / lm_score.KINDS
    weights = step(seen.sum(axis=1, keepdims=True) * p)
    part = {r.text: r.k for r in training.select("text", F.pmod(F.xxhash64("text"), F.lit(lm_score.UPDATES)).alias("k")).collect()}
    for k in range(lm_score.UPDATES):
        gradient = np.zeros((n, K))
        for text, x in learned:
            for f, c, _ in x if part[text] == k else ():
                rest = np.eye(K)[c] - q(weights, f)
                for b in f:
                    gradient[b] += rest
        weights = weights + step(seen - lm_score.UPDATES * gradient) / (k + 1)
    got_w, got_b = lm_score.train(training, words)
    assert np.allclose(got_w, weights, atol=1e-3) and np.allclose(got_b, np.log(p), atol=1e-5)
    want = sorted(((i, held(i), len(x), sum(math.log10(q(weights, f)[c] * (m + 0.5) / words.size[c]) for f, c, m in x)) for i, _, x in rows), key=repr)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.score) for r in lm_score.score(docs, frequent=100).collect()), key=repr)
    assert [x[:3] for x in got] == [x[:3] for x in want] and np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-2)


def test_class_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    w = rng.normal(size=(lm_score.LEAST_BUCKETS, lm_score.CLASSES)).astype(np.float32)
    t = rng.integers(0, 2**63, 500).astype(np.uint64)
    f = lm_score.feature_buckets(t, np.array([200, 1, 299]), lm_score.LEAST_BUCKETS)
    assert np.allclose(np.exp(lm_score.class_log_probs(w, w[0], f)).sum(axis=1), 1, atol=1e-4)
    assert f.shape == (3, 500) and len(set(f[0][[0, 200, 201]])) == 1  # nothing is known of a text before it begins


# -- pages -----------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://A.Example.NET/en/x?q#f", "<p>one</p>\r\n\r\nWARC/1.1\r\n"), (2, "https://www.ads-track.b.org/fr", None), (3, None, ""),
            (4, "no scheme", "<p>one</p>\r\n\r\nWARC/1.1\r\n"), (None, "x://net", "é\n\n"), (5, "http://b.com/de/", "é\n\n"), (2, "https://ads-track.b.org/fr.html", "z\r"),
            (6, "http://m.ads-track.b.org/fr/", "\r\n"), (7, "ftp://net/", "q" * 300000), (0, "http://a b.c/ü\nx", "é\n\n")]
    return spark.createDataFrame([(*r, "v", "h") for r in rows], "page_id bigint, url string, html string, verdict string, host string").repartition(3).persist()


def test_url_filter(spark, pages):
    listed = spark.createDataFrame([("ads-track.b.org/fr",), (None,), ("ads-track.b.org/fr",)], "canonical string")
    got = {(r.page_id, r.host, r.path): (r.rule, r.verdict) for r in url_filter.filter_urls(pages, listed).collect()}
    assert got == {(1, "a.example.net", "/en/x"): ("example.net/en/", "allow"), (2, "www.ads-track.b.org", "/fr"): (None, "block"), (3, "", ""): (None, "allow"),
                   (4, "", ""): (None, "allow"), (None, "net", ""): (None, "allow"), (5, "b.com", "/de/"): (None, "allow"), (2, "ads-track.b.org", "/fr.html"): (None, "block"),
                   (6, "m.ads-track.b.org", "/fr/"): ("org/fr/", "allow"), (7, "net", "/"): ("net/", "block"), (0, "a b.c", "/ü\nx"): (None, "allow")}
    assert url_filter.filter_urls(pages.limit(0), listed).count() == 0
    assert url_filter.filter_urls(pages, listed.limit(0)).count() == pages.count()


def test_warc(spark, pages, tmp_path):
    for table, name in ((pages, "a"), (pages.limit(0), "b")):
        root = f"{tmp_path}/{name}"
        warc.write_arc(table, f"{root}/arc")
        arc = warc.read_arc(spark, f"{root}/arc")
        warc.write_warc(warc.mark_revisits(warc.convert(arc)), f"{root}/warc")
        back = warc.read_warc(spark, f"{root}/warc").where("type != 'warcinfo'").persist()
        assert back.count() == table.count()
    back = warc.read_warc(spark, f"{tmp_path}/a/warc").persist()
    assert {r.version for r in warc.read_arc(spark, f"{tmp_path}/a/arc").collect()} == {1, 2}
    assert back.where("type = 'warcinfo'").count() > 0
    rows = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    first = {}
    for i, p in rows:
        if i is not None:
            first[p] = min(i, first.get(p, i))
    digest = lambda p: base64.b32encode(hashlib.sha1(p).digest()).decode()
    want = sorted(((str(i) if i is not None else None, len(p), digest(p), "response" if i == first[p] else "revisit", None if i == first[p] else str(first[p])) for i, p in rows), key=repr)
    got = back.where("type != 'warcinfo'").select("page", "payload_bytes", "payload_digest", "type", "refers_to")
    assert rows_of(got) == want
    assert {bytes(r.payload) for r in back.where("type = 'response'").collect()} == {p for _, p in rows}
    assert warc.warc_date("2004") == "2004-01-01T00:00:00Z" and warc.warc_type("dns:x.org") == "resource" and warc.warc_type("filedesc://x") == "warcinfo"


def test_warc_urls(spark, tmp_path):
    """A page is a row whatever its url, and the smallest page of a payload is the response."""
    urls = ["mailto:x@y.z", "host:8080/y", "filedesc://z", "filedesc:z", "FILEDESC://z", "data:text/plain,a b", "urn:x", "dns:x.org", "unknown:", ":", "", None, "http://x/"]
    pages = [(i, u, "same") for i, u in enumerate(urls)] + [(100 + i, u, f"own {i}") for i, u in enumerate(urls)]
    spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = rows_of(warc.op10_warc(spark, str(tmp_path)).select("page_id", "record_type", "refers_to"))
    assert got == sorted(((i, "revisit" if 0 < i < 100 else "response", 0 if 0 < i < 100 else None) for i, _, _ in pages), key=repr)
    assert warc.warc_type("mailto:x", b"HTTP/1.1 200 OK\r\n\r\n") == "response"


HTML = [
    ("<p>a <b>b</b>\n c<p>d", "a b c\n\nd"), ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"), ("<ol start=3><li>x</li><li>y</ol>", "3. x\n4. y"),
    ("<table><tr><td>a<td>bbb<tr><th>cc</th><td>d</table>e", "a  | bbb\ncc | d\n\ne"), ("<div hidden>x</div><p style='display: none'>y</p><script>if (a<b) 'z'</script>v", "v"),
    ("a<!-- <p> -->b<br>c<pre>  x\n y</pre>", "ab\nc\n\n  x\n y"), ("<title>t</title><img alt='pic'>&lt;&amp;&eacute;", "pic<&é"), ("<td>loose</td> </p> <p", "loose"),
    (None, ""), ("", ""), ("<", "<"), ("<div>" * 3000 + "deep", "deep"), ("<dl><dt>a<dd>b<dt>c</dl>", "a\nb\nc"), ("<p>a<table><tr><td>b<p>c</table>d", "a\n\nb / c\n\nd"),
    ("<html><head><title>t</title><p>Hello<p>you", "Hello\n\nyou"), ("<head> <meta charset=x>\n<script>s</script> bare <b>text</b>", "bare text"),
    ("<head><noscript><p>n</p></noscript><style>x{}</style></head><body>b", "b"), ("<head><title>t</title></head>a<head><link rel=x><div>c</div>", "a\nc"),
    ("a<svg width='1'/>b<svg><path d='z'/><style/><g/><text>s</text></svg>c", "abc"), ("<p>a<svg/><p>b", "a\n\nb"), ("a<svg href=x/>hidden</svg>b<svg href='y?z=1'/>c", "abc"),
    ("<math><mspace/><mi>x</mi></math> y<div/>z", "x y\nz"),
    ("<div class=\"a\"\">text</div>more \"q\" <b>z</b>", 'text\nmore "q" z'), ("<a title=Bob's>text</a> it's <i>all</i>", "text it's all"),
    ("a<b title = 'x>y' hidden>h</b><i t=\">\">c</i>", "ac"), ("<p class=\"a\"\"hidden>v<p x='' hidden>h", "v"), ("<a href=>v</a ' >w<b ' hidden>h", "vw"),
    ("<table><tr><form><td>Name</td><td>x</td></form></tr></table>", "Name | x"), ("<table><tr>text<td>a</td></table>", "text\na"),
    ("<table><tr><b>t</b> u<td>a<td>b<tr><td>c</table>", "t u\na | b\nc"), ("<table><tr>k<form>l <td>a</td>m</form><td>b</tr></table>z", "k\nl m\na | b\n\nz"),
    ("<table><tr><div hidden><td>h</td></div><td>a<tr><table><tr><td>i<td>j</table></table>", "a\ni | j"), ("<table><tr>" + "<b>" * 3000 + "<td>deep", "deep"),
]


@pytest.mark.parametrize(("source", "text"), HTML)
def test_render(source, text):
    assert html_text.render(source) == text


def test_extract(pages):
    out = html_text.extract(pages)
    assert out.columns == ["page_id", "text"] and out.count() == pages.count()
    assert html_text.extract(pages.limit(0)).count() == 0
    rng = random.Random(6)
    bits = ["<p>", "</p>", "<table>", "<tr>", "<td>", "</table>", "<li>", "<ul>", "</ul>", "x", "&amp", "<!--", "-->", "<a b='", "'>", "<script>", "</script>", "<pre>", "\n"]
    for _ in range(300):
        html_text.render("".join(rng.choice(bits) for _ in range(40)))


# -- queries ---------------------------------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    """Runs on the given tables; equals the SQL where there is one."""
    df = queries.QUERIES[name](spark, SF)
    got = rows_of(df.select(sorted(df.columns)))
    if sql := queries.ORACLE_SQL.get(name):
        con = duckdb.connect()
        for t in ("documents", "benchmark", "labels", "pages"):
            con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert got == sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in want.fetchall()), key=repr)
    else:
        assert got


def test_pipeline(spark):
    import corpus_pipeline as cp

    assert 4 <= len(cp.STAGES) <= 5
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = {r.doc_id for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        after = cp.stored(stage(spark, docs, SF), f"test-{name}")
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.collect()} <= ids
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs, ids = after, {r.doc_id for r in after.collect()}
    out = rows_of(cp.run(spark, SF))
    assert out == rows_of(cp.STAGES[-1][1](spark, docs, SF)) and {r[0] for r in out} == ids
    assert importlib.util.find_spec("__spark_entry__") is not None
