"""Byte-level BPE against the library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from graphbi.llm import byte_bpe as B

PATH = public_tokenizers.path(B.RANKS)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    return B.Vocabulary(PATH)


def awkward():
    rng = random.Random(4)
    runs = ["a" * 10007, "ab" * 3001, " " * 5003, "漢字" * 2003, "-" * 4099, "".join(rng.choice("etaoinsh") for _ in range(6000))]
    mixed = ["".join(rng.choice(rng.choice(["abcde", "漢字かな", "ÀÉî", "019²", "-_=", " \n\t　", "'s're"])) for _ in range(rng.randrange(1, 400))) for _ in range(120)]
    odd = ["", "one", "I'll say it's <|endoftext|> now", "é", "\U0001f469‍\U0001f680 ok", "x\U000323b0\U000323b1 y\U00016ff4", "\x00\x7f", "same", "same"]
    return [*odd, *runs, *mixed]


def test_pieces_and_rows(library, vocabulary):
    split = B.Splitter(public_tokenizers.PATTERN, B.other_classes())
    for text in awkward():
        ids = np.frombuffer(b"".join(vocabulary.encode_pieces(p.encode() for p in split(text))), "<u4")
        assert ids.tolist() == library.encode_ordinary(text)
        assert vocabulary.decode(ids) == text.encode()


def test_long_pieces_do_not_depend_on_the_rows(vocabulary):
    for text in ("etaoinshrdlu" * 40, "a" * 999, "漢字仮名" * 60):
        whole = vocabulary.merge_wide(vocabulary.of_byte[np.frombuffer(text.encode(), np.uint8)]).tolist()
        for width in (2, 7, 64, 256):
            assert vocabulary.encode_long(text.encode(), width).tolist() == whole


def test_merges_take_the_leftmost_pair_of_least_rank():
    """Ranks under which a merge makes a pair of a lower rank than its own."""
    rng = random.Random(8)

    def plain(tokens, ranks):
        while True:
            pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(tokens, tokens[1:], strict=False)) if a + b in ranks]
            if not pairs:
                return [ranks[t] for t in tokens]
            i = min(pairs)[1]
            tokens[i:i + 2] = [tokens[i] + tokens[i + 1]]

    for _ in range(60):
        longer = list({"".join(rng.choice("ab") for _ in range(rng.randrange(2, 6))).encode() for _ in range(12)})
        rng.shuffle(longer)
        ranks = {bytes([b]): 1000 + b for b in range(256)} | {t: i for i, t in enumerate(longer)}
        v = B.Vocabulary.__new__(B.Vocabulary)
        v.fill(ranks)
        for n in (1, 2, 3, 9, 40, 300):
            row = bytes(rng.choice(b"ab") for _ in range(n))
            want = plain([bytes([b]) for b in row], ranks)
            assert v.encode_rows([row])[0].tolist() == want
            assert v.merge_wide(v.of_byte[np.frombuffer(row, np.uint8)]).tolist() == want
            assert v.encode_long(row, 5).tolist() == want


def test_pair_table():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 1 << 40, 5000))
    found = B.PairTable(keys, np.arange(len(keys), dtype=np.int32))
    assert (found.find(keys) == np.arange(len(keys))).all()
    assert (found.find(np.setdiff1d(rng.integers(0, 1 << 40, 5000), keys)) == B.NONE).all()


def test_rows(spark, library):
    texts = [None, *awkward()]
    rows = [(i, t, b"x", 1.5) for i, t in enumerate(texts)] + [(None, "no id", None, None), (5, "again", None, None), (5, "again", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids binary, decoded double").repartition(3)
    out = B.encode(docs, PATH)
    assert out.columns == ["doc_id", "ids", "decoded"]
    want = sorted(((i, np.array(library.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, bytes(r.ids), bytes(r.decoded)) for r in out.collect()), key=repr) == want
    assert B.encode(docs.limit(0), PATH).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in B.op13_byte_bpe(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode_bytes(ids)).hexdigest())
