"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash cuts each text into chunks at places that depend on the nearby
bytes only, so equal passages of different documents give equal chunks.
Chunks found more than once are encoded once for the whole corpus.  Where two
chunks meet, a span around the join is encoded anew; it is widened until its
ids agree with both chunks' ids on guard words at either side.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.llm import bloom
from graphbi.llm.common import ASCII_SPACE, arrow_map, fields, partition_map, stored, table, texts

TOKENIZER = "word_bpe_49k.json"
#: Chunks: a cut where the upper bits of the hash are zero (one place in 2^CUT_BITS), at least and at most so many bytes.
CUT_BITS, LEAST, MOST = 11, 256, 1 << 14
#: Words in a task's cache from word to ids.
CACHE = 700_000

_HASH_SEED = 42
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[list(ASCII_SPACE)] = True


@functools.cache
def _gear() -> np.ndarray:
    """A number for each byte: the upper half of its hash."""
    return np.array([xxhash.xxh64_intdigest(bytes([b]), _HASH_SEED) >> 32 for b in range(256)], dtype=np.uint32)


def cuts(raw: bytes, cut_bits: int = CUT_BITS, least: int = LEAST, most: int = MOST) -> list[int]:
    """Ends of the chunks of a UTF-8 text, the last is its length; never inside a character."""
    if len(raw) <= least:
        return [len(raw)] if raw else []
    data = np.frombuffer(raw, dtype=np.uint8)
    h = _gear()[data]
    for width in (1, 2, 4, 8, 16):  # the hash of the last 32 bytes, by doubling: h(i) = h(i-1) * 2 + gear
        h[width:] += h[:-width] << np.uint32(width)
    out, begin = [], 0
    for at in [*(np.flatnonzero(h >> np.uint32(32 - cut_bits) == 0) + 1).tolist(), len(raw)]:
        while at - begin > most:  # a stretch without a cut: the end follows from its beginning
            begin = _whole(data, begin + most)
            out.append(begin)
        if at - begin >= least and (at := _whole(data, at)) < len(raw) and at > begin:
            out.append(at)
            begin = at
    return [*out, len(raw)] if not out or out[-1] < len(raw) else out


def _whole(data: np.ndarray, at: int) -> int:
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def digest(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


class Codec:
    """Encodes and decodes as the tokenizers library does; words between ASCII white space go through a bounded cache.

    The tokenizer drops white space before it merges and normalises each
    character by itself or with following marks, so a text's ids are those of
    its words, special tokens inside words included (the tests hold whole
    texts against the library).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.tokens = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.numbers = [str(i) for i in range(size)]
        self.cache: dict[bytes, bytes] = {}

    def encode(self, raw: bytes) -> bytes:
        """The ids of a piece of text that neither begins nor ends inside a word, as an array's bytes."""
        cache, words = self.cache, raw.split()
        try:
            return b"".join([cache[w] for w in words])
        except KeyError:
            pass
        out = []
        for w in words:
            ids = cache.get(w)
            if ids is None:
                if len(cache) >= CACHE:
                    cache.clear()
                ids = np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, dtype=self.kind).tobytes()
                if len(w) < 64:
                    cache[w] = ids
            out.append(ids)
        return b"".join(out)

    def results(self, ids: bytes) -> tuple[int, str, str]:
        """(number of ids, digest of the ids, digest of the decoded text)."""
        ids = np.frombuffer(ids, dtype=self.kind).tolist()
        if self.tokenizer.decoder is None:  # the library then joins the tokens by spaces
            text = " ".join(map(self.tokens.__getitem__, ids))
        else:
            text = self.tokenizer.decode(ids, skip_special_tokens=False)
        numbers = " ".join(map(self.numbers.__getitem__, ids))
        return len(ids), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def join_chunks(codec: Codec, raw: bytes, ends: list[int], ids: list[bytes]) -> bytes:
    """The ids of the whole text from those of its chunks: spans around the joins are encoded anew until they agree."""
    if len(ends) < 2:
        return ids[0] if ids else b""
    starts = [0, *ends[:-1]]
    space = np.flatnonzero(_IS_SPACE[np.frombuffer(raw, dtype=np.uint8)])
    guards = [1] * (len(ends) - 1)
    while True:
        spans: list[list[int]] = []  # [begin, end), merged where they meet, with the joins inside
        for k, g in enumerate(guards):
            i = int(np.searchsorted(space, ends[k]))
            a = int(space[i - 1 - g]) + 1 if i - 1 - g >= 0 else 0
            b = int(space[i + g]) if i + g < len(space) else len(raw)
            if spans and (a <= spans[-1][1]):
                spans[-1][1:] = [max(b, spans[-1][1]), [*spans[-1][2], k]]
            else:
                spans.append([a, b, [k]])
        heads, tails, middle, wrong = [b""] * len(ends), [b""] * len(ends), [], []
        for a, b, joins in spans:
            first, last = joins[0], joins[-1] + 1
            new = codec.encode(raw[a:b])
            middle.append(new)
            # where a span begins or ends inside a chunk, the chunk's ids must have been the same there
            if a > starts[first]:
                tails[first] = codec.encode(raw[a:ends[first]])
                guard = codec.encode(raw[a:_last_space(raw, a, ends[first])])
                if not (ids[first].endswith(tails[first]) and new.startswith(guard)):
                    wrong.append(joins[0])
            if b < ends[last]:
                heads[last] = codec.encode(raw[starts[last]:b])
                guard = codec.encode(raw[_first_space(raw, starts[last], b):b])
                if not (ids[last].startswith(heads[last]) and new.endswith(guard)):
                    wrong.append(joins[-1])
        if not wrong:
            break
        for k in wrong:
            guards[k] *= 2
    out, at = [], 0
    for (a, b, joins), new in zip(spans, middle, strict=True):
        first, last = joins[0], joins[-1] + 1
        if a > starts[first] and first >= at:
            out.append(ids[first][len(heads[first]):len(ids[first]) - len(tails[first])])
        out.append(new)
        at = last if b < ends[last] else last + 1
    if at < len(ends):
        out.append(ids[at][len(heads[at]):])
    return b"".join(out)


def _last_space(raw: bytes, a: int, b: int) -> int:
    return max((raw.rfind(bytes([c]), a, b) for c in ASCII_SPACE), default=-1) + 1 or a


def _first_space(raw: bytes, a: int, b: int) -> int:
    return min((i for c in ASCII_SPACE if (i := raw.find(bytes([c]), a, b)) >= 0), default=b)


_CUTS = "array<struct<begin:int,size:int,digest:binary,shared:boolean>>"
_RESULT = "n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _shared_digests(rows: DataFrame) -> DataFrame:
    """Digests of chunks that occur more than once in the corpus; counted with pre-aggregation, in tasks and before the shuffle."""
    def run(batches):
        for batch in batches:
            found: dict[bytes, int] = {}
            for text in batch.column("text"):
                raw, begin = text.as_py().encode(), 0
                for end in cuts(raw):
                    d = digest(raw[begin:end])
                    found[d] = found.get(d, 0) + 1
                    begin = end
            yield {"digest": list(found), "n": list(found.values())}

    counted = partition_map(rows.select("text"), "digest binary, n bigint", run)
    return counted.groupBy("digest").agg(F.sum("n").alias("n")).where(F.col("n") > 1).select("digest")


def encode(docs: DataFrame, tokenizer_path: str, max_filter_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) per row.

    A null text is empty; an empty one has no ids.  Repeated rows and null ids
    each get a row.  A Bloom filter of bounded size tells a task which chunks
    may be shared; a false hit only sends a chunk the longer way.
    """
    rows = texts(docs)
    sc, kind = docs.sparkSession.sparkContext, dict(rows.dtypes)["doc_id"]
    shared = stored(_shared_digests(rows), "llm-chunks")
    seen = sc.broadcast(bloom.build(shared, F.xxhash64("digest"), shared.count(), max_filter_bytes))
    names = fields(f"doc_id {kind}, key binary, {_RESULT}, body binary, cuts {_CUTS}").names

    def split():
        own, sent = codec(tokenizer_path), set()

        def work(batch: pa.RecordBatch) -> dict:
            out = {c: [] for c in names}
            for text in batch.column("text"):
                raw, begin, found = text.as_py().encode(), 0, []
                for end in cuts(raw):
                    found.append({"begin": begin, "size": end - begin, "digest": digest(raw[begin:end])})
                    begin = end
                keys = np.array([xxhash.xxh64_intdigest(c["digest"], _HASH_SEED) for c in found], dtype=np.uint64)
                hits = bloom.probe(seen.value, keys) if found else []
                row = dict.fromkeys(names)
                if any(hits):
                    row["key"] = digest(raw)
                    if row["key"] not in sent:  # a text is sent once by a task
                        sent.add(row["key"])
                        row["body"], row["cuts"] = raw, [c | {"shared": bool(h)} for c, h in zip(found, hits, strict=True)]
                else:  # nothing to reuse
                    row["n_tokens"], row["ids_sha256"], row["decoded_sha256"] = own.results(own.encode(raw))
                for c in names[1:]:
                    out[c].append(row[c])
            return out | {"doc_id": batch.column("doc_id")}
        return work

    marked = stored(arrow_map(rows, f"doc_id {kind}, key binary, {_RESULT}, body binary, cuts {_CUTS}", split), "llm-chunked")
    done = marked.where(F.col("key").isNull()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    whole = marked.where(F.col("body").isNotNull())
    parts = whole.select("key", "body", F.posexplode("cuts").alias("place", "cut")).where("cut.shared")

    def once(batches):
        own, got = codec(tokenizer_path), set()
        for batch in batches:
            out = {"digest": [], "ids": []}
            for d, chunk in zip(batch.column("digest").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                if d not in got:
                    got.add(d)
                    out["digest"].append(d)
                    out["ids"].append(own.encode(chunk))
            yield out

    chunks = parts.select(F.col("cut.digest").alias("digest"), F.substring("body", F.col("cut.begin") + 1, F.col("cut.size")).alias("chunk"))
    encoded = partition_map(chunks.transform(_first_in_task).repartition("digest"), "digest binary, ids binary", once)
    uses = parts.select("key", "place", F.col("cut.digest").alias("digest")).join(encoded, "digest")
    pieces = uses.groupBy("key").agg(F.collect_set(F.struct("place", "ids")).alias("pieces"))
    ready = whole.select("key", "body", "cuts").join(pieces, "key")

    def assemble(batches):
        own, got = codec(tokenizer_path), set()
        for batch in batches:
            out = {c: [] for c in ("key", "n_tokens", "ids_sha256", "decoded_sha256")}
            for key, raw, places, have in zip(*[batch.column(c) for c in ("key", "body", "cuts", "pieces")], strict=True):
                key = key.as_py()
                if key in got:
                    continue
                got.add(key)
                raw, places, have = raw.as_py(), places.as_py(), {p["place"]: p["ids"] for p in have.as_py()}
                ends = [c["begin"] + c["size"] for c in places]
                ids = [have[k] if k in have else own.encode(raw[c["begin"]:c["begin"] + c["size"]]) for k, c in enumerate(places)]
                for c, x in zip(out, (key, *own.results(join_chunks(own, raw, ends, ids))), strict=True):
                    out[c].append(x)
            yield out

    results = partition_map(ready, f"key binary, {_RESULT}", assemble).dropDuplicates(["key"])
    copies = marked.where(F.col("key").isNotNull()).select("doc_id", "key").join(results, "key")
    return done.unionByName(copies.select(*done.columns))


def _first_in_task(chunks: DataFrame) -> DataFrame:
    """Drops repeats of a chunk within a task before the shuffle."""
    def run(batches):
        got = set()
        for batch in batches:
            keep = []
            for i, d in enumerate(batch.column("digest").to_pylist()):
                if d not in got:
                    got.add(d)
                    keep.append(i)
            part = batch.take(pa.array(keep, type=pa.int64()))
            yield {c: part.column(c) for c in ("digest", "chunk")}

    return partition_map(chunks, "digest binary, chunk binary", run)


def op2_bpe(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """All documents with the public word tokenizer."""
    import public_tokenizers

    return encode(table(spark, sf_dir, "documents"), tokenizer_path or public_tokenizers.path(TOKENIZER))
