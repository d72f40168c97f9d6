"""Byte-level BPE by ranks: rows of padded matrices that merge their pairs round by round.

A text is cut into pieces by a pattern; each distinct piece becomes a row of
token ids, one per byte.  Rows of similar length share a padded matrix.  In
each round every row finds its leftmost pair of the least rank, takes the
merged token in place of the pair and is compacted by one cell; a row without
a pair of any rank is done and leaves.  Pairs are looked up in an
open-addressed hash table of (left id, right id).

A piece longer than ``WIDTH`` bytes is cut into rows of that length first.  A
sequence of tokens is the encoding of its bytes if each two neighbours are
(no merge can then cross a border before it crosses it in the two alone), so
only the joins of rows are checked; where one fails, a window of tokens around
it is encoded anew, with twice the tokens in each further round.

Texts are split by the ``regex`` package.  Its letters and digits may be those
of another Unicode version than the library's; characters of another class
there are found once on the driver and stand in as one of that class.

Null texts count as empty ones (no ids).  Rows are independent of each other:
repeated rows give repeated results, further columns are not read, an empty
table gives an empty result.  Very long texts are worked through by pieces,
so only their ids and bytes are held whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.llm.common import partition_map, table, texts

RANKS = "byte_bpe_multi_50k.tiktoken"
#: Bytes of the longest row in a matrix; cells of a matrix.
WIDTH, CELLS = 256, 1 << 19
#: Widths of the padded matrices.
BUCKETS = (2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 32, 48, 64, 96, 128, 192, WIDTH)
#: Pieces looked up at once, and pieces in a task's cache, at most; bytes of texts in an output batch.
PIECES, CACHED, BATCH = 1 << 17, 1 << 18, 1 << 22
#: "No such pair"; above all ranks.
NONE = np.iinfo(np.int32).max
#: Fixed value: odd multiplier of the hash (2^64 divided by the golden ratio).
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


class PairTable:
    """int64 keys (0 or more) to int32 values: an open-addressed table, linear probing, at most a quarter full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
        slots = self._slots(keys)
        while len(keys):
            free = self.keys[slots] < 0
            self.keys[slots[free]] = keys[free]  # of several that want a slot the last one gets it
            won = self.keys[slots] == keys
            self.values[slots[won]] = values[won]
            keys, values, slots = keys[~won], values[~won], (slots[~won] + 1) & self.mask

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * _GOLDEN) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        flat = keys.ravel()
        slots = self._slots(flat)
        there = self.keys[slots]
        out = np.where(there == flat, self.values[slots], NONE)
        rest = np.flatnonzero((there != flat) & (there >= 0))
        slots = slots[rest]
        while len(rest):
            slots = (slots + 1) & self.mask
            there = self.keys[slots]
            hit = there == flat[rest]
            out[rest[hit]] = self.values[slots[hit]]
            on = ~hit & (there >= 0)
            rest, slots = rest[on], slots[on]
        return out.reshape(keys.shape)


class Vocabulary:
    """The tokens of a rank file, and the pairs of tokens whose bytes together are a token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.fill({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def fill(self, ranks: dict[bytes, int]) -> None:
        self.whole = ranks
        most = max(self.whole.values())
        self.tokens = [b""] * (most + 1)
        for token, rank in self.whole.items():
            self.tokens[rank] = token
        self.pad, self.base = most + 1, most + 2
        pairs = [(left * self.base + right, rank) for token, rank in self.whole.items() for k in range(1, len(token))
                 if (left := self.whole.get(token[:k])) is not None and (right := self.whole.get(token[k:])) is not None]
        keys, ranks = np.array(pairs, np.int64).reshape(-1, 2).T
        self.pairs = PairTable(keys, ranks.astype(np.int32))
        self.of_byte = np.array([self.whole[bytes([b])] for b in range(256)], np.int32)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return self.pairs.find(left.astype(np.int64) * self.base + right)

    # -- rows ------------------------------------------------------------------

    def merge_matrix(self, tokens: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yields (row numbers, their tokens padded) of the rows of a padded matrix, as they end."""
        rows, ranks = np.arange(len(tokens)), self.rank(tokens[:, :-1], tokens[:, 1:])
        while len(rows):
            if not ranks.shape[1]:
                yield rows, tokens
                return
            at = ranks.argmin(axis=1)
            best = np.take_along_axis(ranks, at[:, None], 1)[:, 0]
            if (done := best == NONE).any():
                yield rows[done], tokens[done]
                rows, tokens, ranks, at, best = (x[~done] for x in (rows, tokens, ranks, at, best))
                if not len(rows):
                    return
            each, width = np.arange(len(rows)), tokens.shape[1]
            tokens[each, at] = best  # a token's rank is its id
            keep = np.ones(tokens.shape, bool)
            keep[each, at + 1] = False
            tokens = tokens[keep].reshape(len(rows), width - 1)
            keep = np.ones(ranks.shape, bool)
            keep[each, np.minimum(at + 1, width - 2)] = False
            ranks = ranks[keep].reshape(len(rows), width - 2)
            for k in (at - 1, at):  # the pairs to both sides of the merged token
                ok = np.flatnonzero((k >= 0) & (k < width - 2))
                ranks[ok, k[ok]] = self.rank(tokens[ok, k[ok]], tokens[ok, k[ok] + 1])

    def merge_wide(self, tokens: np.ndarray) -> np.ndarray:
        """The same of a single long row; equal pairs merge in one round up to the first that makes a pair of a lower rank."""
        while len(tokens) > 1:
            ranks = self.rank(tokens[:-1], tokens[1:])
            best = ranks.min()
            if best == NONE:
                break
            at = np.flatnonzero(ranks == best)
            new = np.r_[True, np.diff(at) > 1]  # in a run of overlapping pairs every second one merges
            at = at[(np.arange(len(at)) - np.flatnonzero(new)[np.cumsum(new) - 1]) % 2 == 0]
            made = np.full(len(at), best, np.int32)
            around = np.r_[tokens, self.pad, self.pad]  # the last one also stands before the first token
            before = np.where(np.r_[False, np.diff(at) == 2], best, around[at - 1])
            low = (self.rank(before, made) < best) | (self.rank(made, around[at + 2]) < best)
            if low.any():
                at = at[: low.argmax() + 1]
            tokens[at] = best
            tokens = np.delete(tokens, at + 1)
        return tokens

    def encode_rows(self, rows: list[bytes]) -> list[np.ndarray]:
        """Ids of byte strings, by merges alone."""
        out: list = [None] * len(rows)
        lengths = np.array([len(r) for r in rows], np.int64)
        flat = np.frombuffer(b"".join(rows) + bytes(WIDTH), np.uint8)
        starts = np.cumsum(lengths) - lengths
        for i in np.flatnonzero((lengths < 2) | (lengths > WIDTH)):
            out[i] = self.merge_wide(self.of_byte[flat[starts[i]:starts[i] + lengths[i]]])
        low = 1
        for width in BUCKETS:
            members = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for a in range(0, len(members), CELLS // width):
                own = members[a:a + CELLS // width]
                cells = np.arange(width)
                tokens = np.where(cells < lengths[own, None], self.of_byte[flat[starts[own, None] + cells]], self.pad).astype(np.int32)
                for done, ended in self.merge_matrix(tokens):
                    real = ended != self.pad
                    for i, ids in zip(own[done], np.split(ended[real], np.cumsum(real.sum(axis=1))[:-1]), strict=True):
                        out[i] = ids
        return out

    def encode_long(self, piece: bytes, width: int = WIDTH) -> np.ndarray:
        """Ids of a piece of any length: rows of ``width`` bytes whose joins are repaired until all neighbours agree."""
        parts = self.encode_rows([piece[i:i + width] for i in range(0, len(piece), width)])
        ids, joins, span = np.concatenate(parts), np.cumsum([len(p) for p in parts])[:-1].tolist(), 8
        while joins:
            alone = self.encode_rows([self.decode(ids[j - 1:j + 1]) for j in joins])
            windows: list[list[int]] = []
            for j in (j for j, two in zip(joins, alone, strict=True) if not np.array_equal(two, ids[j - 1:j + 1])):
                if windows and j - span <= windows[-1][1]:
                    windows[-1][1] = min(len(ids), j + span)
                else:
                    windows.append([max(0, j - span), min(len(ids), j + span)])
            if not windows:
                break
            made = self.encode_rows([self.decode(ids[a:b]) for a, b in windows])
            parts, joins, n, last = [], [], 0, 0
            for (a, b), own in zip(windows, made, strict=True):
                n += a - last
                joins += [n] * (a > 0)
                parts += [ids[last:a], own]
                n, last = n + len(own), b
                joins += [n] * (b < len(ids))
            ids, span = np.concatenate([*parts, ids[last:]]), 2 * span
        return ids

    def encode_pieces(self, pieces: Iterable[bytes]) -> list[bytes]:
        """Ids, as little-endian unsigned 32-bit integers, of whole pieces; a piece that is a token is that token."""
        pieces = list(pieces)
        out: list = [None if (i := self.whole.get(p)) is None else i.to_bytes(4, "little") for p in pieces]
        short = [k for k, p in enumerate(pieces) if out[k] is None and len(p) <= WIDTH]
        for k, ids in zip(short, self.encode_rows([pieces[k] for k in short]), strict=True):
            out[k] = ids.astype("<u4").tobytes()
        return [self.encode_long(p).astype("<u4").tobytes() if i is None else i for p, i in zip(pieces, out, strict=True)]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


#: One character of each class of the pattern, and of none of them.
STAND_INS = {r"\p{L}": "\u00aa", r"\p{N}": "\u00b2", "": "\u00a7"}


@cache
def other_classes() -> dict[int, str]:
    """Characters that the library's patterns put into another class than the ``regex`` package: {code point: stand-in}."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000)]))
    out: dict[int, str] = {}
    for kind, like in STAND_INS.items():
        if kind:
            probe = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            theirs, ours = set(probe.decode(probe.encode_ordinary(every))), set(regex.findall(kind, every))
            out.update({ord(c): STAND_INS[""] for c in ours - theirs if ord(c) not in out})
            out.update({ord(c): like for c in theirs - ours})
    return out


class Splitter:
    """The pieces of a text, in order."""

    def __init__(self, pattern: str, others: dict[int, str]):
        self.pattern, self.others = regex.compile(pattern), others
        runs: list[list[int]] = []
        for c in sorted(others):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
        self.odd = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in runs) + "]") if runs else None

    def __call__(self, text: str) -> Iterator[str]:
        if self.odd is not None and not text.isascii() and self.odd.search(text):
            return (text[slice(*m.span())] for m in self.pattern.finditer(text.translate(self.others)))
        if len(text) > PIECES:
            return (m.group() for m in self.pattern.finditer(text))
        return iter(self.pattern.findall(text))


def encode(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """(doc_id, ids, decoded) of every row: the ids as little-endian unsigned 32-bit integers, and the bytes that they decode to.

    ``path`` is a rank file (base64 of a token's bytes and its rank on each
    line, all 256 bytes among them), read by the driver and broadcast: its
    size is that of the vocabulary.  ``pattern`` cuts texts into pieces.
    """
    rows = texts(docs)
    sent = docs.sparkSession.sparkContext.broadcast((Vocabulary(path), other_classes()))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        vocabulary, others = sent.value
        split, seen = Splitter(pattern, others), {}

        def known(pieces: list[str]) -> list[bytes]:
            new = list({p for p in pieces if p not in seen})
            if len(seen) + len(new) > CACHED:
                seen.clear()
                new = list(set(pieces))
            seen.update(zip(new, vocabulary.encode_pieces(p.encode() for p in new), strict=True))
            return [seen[p] for p in pieces]

        def encoded(some: list[str]) -> tuple[list[bytes], list[bytes]]:
            ids: list[list[bytes]] = [[] for _ in some]
            waiting, owners = [], []  # pieces of one or more texts, and (text, number of pieces)

            def flush() -> None:
                done, a = known(waiting), 0
                for i, n in owners:
                    ids[i].append(b"".join(done[a:a + n]))
                    a += n
                waiting.clear()
                owners.clear()

            for i, text in enumerate(some):
                found = split(text)
                while got := list(islice(found, PIECES)):
                    waiting.extend(got)
                    owners.append((i, len(got)))
                    if len(waiting) >= PIECES:
                        flush()
            flush()
            joined = [b"".join(x) for x in ids]
            return joined, [vocabulary.decode(np.frombuffer(x, "<u4")) for x in joined]

        for batch in batches:
            sizes = np.cumsum(batch.column("text").to_pandas().str.len().to_numpy()) if batch.num_rows else np.zeros(0)
            a = 0
            while a < batch.num_rows:
                b = max(a + 1, int(np.searchsorted(sizes, (sizes[a - 1] if a else 0) + BATCH, "right")))
                part = batch.slice(a, b - a)
                ids, decoded = encoded(part.column("text").to_pylist())
                yield {"doc_id": part.column("doc_id"), "ids": ids, "decoded": decoded}
                a = b

    return partition_map(rows, f"doc_id {id_type}, ids binary, decoded binary", run)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of all documents."""
    out = encode(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS))
    return out.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
                      F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
