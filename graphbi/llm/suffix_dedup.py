"""Suffix-array dedup with sparse suffixes.

Only suffixes that begin at minimisers are kept: of every window of MIN_WORDS
words the leftmost smallest hash of its K-word sequences, which equal windows
place alike.  Suffixes that share their first K words are sorted by what
follows and by what precedes; comparing neighbours in both orders gives the
lengths over which they agree, and so which windows, extended left and right
of the minimiser, occur more than once.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.llm import bloom
from graphbi.llm.common import arrow_map, partition_map, small_batches, stored, table, texts

#: A passage of at least so many words that occurs again is repeated.
MIN_WORDS = 50
#: Words in the sequences whose smallest hash is the minimiser.
K = 16
#: Suffixes of one K-word sequence that a task sorts at once; a commoner sequence has its windows counted one by one, in Spark.
MAX_GROUP = 10_000
_CHUNK = 8_000
#: Bytes whose words are hashed at once.
_PIECE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


@functools.cache
def _letters() -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(bytes([b]), 7) for b in range(256)], dtype=np.uint64)


class _Powers:
    """Powers of the odd base and of its inverse modulo 2^64, as far as needed."""

    def __init__(self):
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n >= len(self.up):
            n = max(n + 1, 2 * len(self.up))
            for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                p = np.full(n, base, dtype=np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))


_POWERS = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Spans:
    """Hashes of spans of numbers: a difference of prefix sums, shifted to its beginning."""

    def __init__(self, values: np.ndarray):
        _POWERS.grow(len(values) + 1)
        self.prefix = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * _POWERS.up[:len(values)], out=self.prefix[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.prefix[end] - self.prefix[begin]) * _POWERS.down[begin])


def word_bounds(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the words in their join by single spaces."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    return ends - sizes, ends


def hash_words(joined: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words at these places, a piece of the buffer at a time."""
    data, out, at = np.frombuffer(joined, dtype=np.uint8), np.empty(len(begins), dtype=np.uint64), 0
    while at < len(begins):
        to = max(at + 1, int(np.searchsorted(ends, begins[at] + _PIECE, "right")))
        shift = begins[at]
        out[at:to] = Spans(_letters()[data[shift:ends[to - 1]]])(begins[at:to] - shift, ends[at:to] - shift)
        at = to
    return out


def minimisers(grams: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, first window, last window) of runs of windows of ``width`` grams whose leftmost smallest gram is at ``place``."""
    n = len(grams) - width + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3
    at, span = np.arange(len(grams)), 1
    while span < width:  # leftmost smallest of `span` grams from each place, then of twice as many
        step = min(span, width - span)
        left, right = at[:len(at) - step], at[step:]
        at = np.where(grams[right] < grams[left], right, left)
        span += step
    begins = np.flatnonzero(np.concatenate([[True], at[1:n] != at[:n - 1]]))
    return at[begins], begins, np.append(begins[1:], n) - 1


def suffixes(text: str, min_words: int = MIN_WORDS, k: int = K):
    """(words joined by spaces, begins, ends, hashes of the minimisers, their places, first and last windows); None if too short."""
    words = text.encode().split()
    if len(words) < min_words:
        return None
    joined = b" ".join(words)
    begins, ends = word_bounds(words)
    at = np.arange(len(words) - k + 1)
    grams = Spans(hash_words(joined, begins, ends))(at, at + k)
    place, first, last = minimisers(grams, min_words - k + 1)
    return joined, begins, ends, grams[place].view(np.int64), place, first, last


def _key(text: str) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _counts(rows: DataFrame, min_words: int) -> DataFrame:
    """(g, n): minimisers found in more than one place; each task counts a text once, and sums before the shuffle."""
    def run(batches):
        sent = set()
        for batch in batches:
            found = []
            for text in batch.column("text"):
                text = text.as_py()
                if (key := _key(text)) not in sent:
                    sent.add(key)
                    if s := suffixes(text, min_words):
                        found.append(s[3])
            g, n = np.unique(np.concatenate(found), return_counts=True) if found else ([], [])
            yield {"g": np.asarray(g, dtype=np.int64), "n": np.asarray(n, dtype=np.int64)}

    return partition_map(rows.select("text"), "g bigint, n bigint", run).groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > 1)


def _occurrences(rows: DataFrame, shared, hot, min_words: int) -> DataFrame:
    """(g, key, place, low, high, around, lows): suffixes whose minimiser may be shared, with the words that their windows reach.

    ``around`` is the text from the first word of the first window (low) to
    the last word of the last one (high); ``place`` is the minimiser's word.
    Suffixes of common minimisers only have the surroundings and their first
    windows, ``lows``.
    """
    def start():
        sent = set()

        def work(batch: pa.RecordBatch) -> dict:
            out = {c: [] for c in ("g", "key", "place", "low", "high", "around", "lows")}
            for text in batch.column("text"):
                text = text.as_py()
                if (key := _key(text)) in sent:
                    continue
                sent.add(key)
                if not (s := suffixes(text, min_words)):
                    continue
                joined, begins, ends, g, place, first, last = s
                keep = np.flatnonzero(bloom.probe(shared.value, g))
                g, place, low, high = g[keep], place[keep], first[keep], last[keep]
                common = bloom.probe(hot.value, g) if hot is not None else np.zeros(len(g), dtype=bool)
                around = [joined[x:y] for x, y in zip(begins[low].tolist(), ends[high + min_words - 1].tolist(), strict=True)]
                lows: dict[bytes, list[int]] = {}
                for i in np.flatnonzero(common).tolist():  # equal surroundings in a text are one row
                    lows.setdefault(around[i], []).append(int(low[i]))
                for i in np.flatnonzero(~common).tolist():
                    for c, x in zip(out, (int(g[i]), key, int(place[i]), int(low[i]), int(high[i]), around[i], None), strict=True):
                        out[c].append(x)
                for piece, at in lows.items():
                    for c, x in zip(out, (None, key, None, None, None, piece, at), strict=True):
                        out[c].append(x)
            return out
        return work

    return arrow_map(rows.select("text"), "g bigint, key binary, place int, low int, high int, around binary, lows array<int>", start)


def _word_rows(around: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Hashes of the words of all pieces, one after the other; counts are the pieces' numbers of words."""
    buffer = b" ".join(around)
    begins, ends = word_bounds(buffer.split())
    assert len(begins) == counts.sum()
    return hash_words(buffer, begins, ends)


def _neighbour_lengths(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, length): rows of a matrix sorted, and over how many leading columns each agrees with the one before it."""
    order = np.lexsort(m.T[::-1])
    differs = m[order][1:] != m[order][:-1]
    return order, np.concatenate([[0], np.where(differs.any(axis=1), differs.argmax(axis=1), m.shape[1])])


def _classes(order: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
    """Number of each row's run of sorted rows that agree over ``depth`` columns."""
    out = np.empty(len(order), dtype=np.int64)
    out[order] = np.cumsum(length < depth)
    return out


def repeated_windows(g: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray, around: list[bytes], rank: np.ndarray,
                     min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, window, first): windows that occur more than once among suffixes of whole groups ``g``.

    ``rank`` orders the occurrences; the smallest of a class of equal windows is the first.
    """
    counts = high - low + min_words
    words = _word_rows(around, counts)
    at = np.concatenate([[0], np.cumsum(counts)[:-1]]) + (place - low)  # the minimiser's word in ``words``
    left_size, right_size = place - low, low + counts - place
    reach = max(int(left_size.max()), 1)
    steps = np.arange(reach)
    left = np.where(steps < left_size[:, None], words[np.clip(at[:, None] - 1 - steps, 0, None)], np.uint64(0))
    steps = np.arange(min_words)
    right = np.where(steps < right_size[:, None], words[np.clip(at[:, None] + steps, None, len(words) - 1)], np.uint64(0))
    group = g.view(np.uint64)[:, None]
    right_order, right_length = _neighbour_lengths(np.hstack([group, right]))  # the group is column 0
    left_order, left_length = _neighbour_lengths(left)
    rows, windows, first = [], [], []
    for before in range(int((place - high).min()), int((place - low).max()) + 1):  # words of the window ahead of the minimiser
        live = np.flatnonzero((place - high <= before) & (before <= place - low))
        if len(live) < 2:
            continue
        follows = _classes(right_order, right_length, min_words - before + 1)[live]
        precedes = _classes(left_order, left_length, before)[live] if before else np.zeros(len(live), np.int64)
        by = np.lexsort((rank[live], precedes, follows))
        new = np.concatenate([[True], (follows[by][1:] != follows[by][:-1]) | (precedes[by][1:] != precedes[by][:-1])])
        again = ~new | np.append(~new[1:], False)
        rows.append(live[by][again])
        windows.append(place[rows[-1]] - before)
        first.append(new[again])
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    return tuple(map(np.concatenate, (rows, windows, first)))


def _runs(windows: np.ndarray, min_words: int) -> list[list[int]]:
    """Flat [begin, end, begin, end ...] of the words that sorted windows cover."""
    if not len(windows):
        return []
    cut = np.flatnonzero(np.diff(windows) > min_words) + 1
    begins, ends = windows[np.concatenate([[0], cut])], windows[np.append(cut - 1, len(windows) - 1)] + min_words
    return np.column_stack([begins, ends]).ravel().tolist()


_COVER = "key binary, covered array<int>, kept array<int>"


def _cover_rows(keys: list[bytes], window: np.ndarray, first: np.ndarray, min_words: int) -> dict:
    """For each text: the words its repeated windows cover, and those that first occurrences cover."""
    names, who = np.unique(np.array([k.hex() for k in keys], dtype=object), return_inverse=True) if keys else ([], np.zeros(0, np.int64))
    order = np.lexsort((window, who))
    out = {"key": [], "covered": [], "kept": []}
    for part in np.split(order, np.flatnonzero(np.diff(who[order])) + 1) if len(order) else []:
        out["key"].append(bytes.fromhex(names[who[part[0]]]))
        out["covered"].append(_runs(np.unique(window[part]), min_words))
        out["kept"].append(_runs(np.unique(window[part[first[part]]]), min_words))
    return out


def _compare(occurrences: DataFrame, min_words: int) -> DataFrame:
    """Cover rows of groups that a task sorts: whole groups, many small ones at a time."""
    dealt = occurrences.repartition("g").sortWithinPartitions("g", "key", "place")

    def work(rows: dict) -> dict:
        # sorted by group, text and place: a copy of a row that another task sent lies next to it
        g, place = np.array(rows["g"], dtype=np.int64), np.array(rows["place"], dtype=np.int64)
        new = [i for i in range(len(g)) if not i or g[i] != g[i - 1] or place[i] != place[i - 1] or rows["key"][i] != rows["key"][i - 1]]
        if len(new) < 2:
            return {"key": [], "covered": [], "kept": []}
        keys = [rows["key"][i] for i in new]
        pick = lambda c: np.array([rows[c][i] for i in new], dtype=np.int64)
        row, window, first = repeated_windows(g[new], place[new], pick("low"), pick("high"), [rows["around"][i] for i in new], np.arange(len(new)), min_words)
        return _cover_rows([keys[i] for i in row.tolist()], window, first, min_words)

    def run(batches):
        held = {c: [] for c in ("g", "key", "place", "low", "high", "around")}
        for batch in batches:
            for c in held:
                held[c] += batch.column(c).to_pylist()
            if len(held["g"]) >= _CHUNK:
                last = held["g"][-1]  # its group may go on
                n = next((i for i in range(len(held["g"]) - 1, -1, -1) if held["g"][i] != last), -1) + 1
                if n:
                    yield work({c: x[:n] for c, x in held.items()})
                    held = {c: x[n:] for c, x in held.items()}
        yield work(held)

    return partition_map(dealt, _COVER, run)


def _count_windows(occurrences: DataFrame, min_words: int) -> DataFrame:
    """Cover rows of common groups; no group meets in a task.

    Suffixes with equal surroundings are one row; the windows of these rows
    are counted with pre-aggregation and joined back by their hash.
    """
    def context():
        def work(batch: pa.RecordBatch) -> dict:
            return {c: batch.column(c) for c in ("key", "lows", "around")} | {"context": [xxhash.xxh3_128_digest(x.as_py()) for x in batch.column("around")]}
        return work

    found = arrow_map(occurrences.select("key", "lows", "around"), "context binary, key binary, lows array<int>, around binary", context)
    # the same row from several tasks is one
    places = stored(found.groupBy("context", "key").agg(F.max("lows").alias("lows")), "llm-places")
    contexts = (found.groupBy("context").agg(F.max("around").alias("around"))
                .join(places.groupBy("context").agg(F.sum(F.size("lows")).alias("n"), F.min(F.struct("key", F.col("lows")[0].alias("low"))).alias("least")), "context"))

    def windows():
        def work(batch: pa.RecordBatch) -> dict:
            out = {c: [] for c in ("hash", "again", "context", "step", "n", "key", "window")}
            for name, around, n, least in zip(*[batch.column(c).to_pylist() for c in ("context", "around", "n", "least")], strict=True):
                begins, ends = word_bounds(around.split(b" "))
                for i in range(len(begins) - min_words + 1):
                    piece = around[begins[i]:ends[i + min_words - 1]]
                    for c, x in zip(out, (xxhash.xxh64_intdigest(piece, 1), xxhash.xxh64_intdigest(piece, 2), name, i, n, least["key"], least["low"] + i), strict=True):
                        out[c].append(x)
            return out | {c: np.array(out[c], dtype=np.uint64).view(np.int64) for c in ("hash", "again")}
        return work

    each = stored(arrow_map(contexts, "hash bigint, again bigint, context binary, step int, n bigint, key binary, window int", windows), "llm-windows")
    least = each.groupBy("hash", "again").agg(F.sum("n").alias("n"), F.min(F.struct("key", "window")).alias("first")).where("n > 1")
    repeated = (each.select("hash", "again", "context", "step").join(least.select("hash", "again", "first"), ["hash", "again"])
                .groupBy("context").agg(F.collect_list(F.struct("step", "first.key", "first.window")).alias("steps")))

    def cover():
        def work(batch: pa.RecordBatch) -> dict:
            out = {"key": batch.column("key"), "covered": [], "kept": []}
            for key, lows, steps in zip(*[batch.column(c).to_pylist() for c in ("key", "lows", "steps")], strict=True):
                windows = np.unique(np.add.outer(lows, [s["step"] for s in steps]))
                mine = np.array([s["window"] for s in steps if s["key"] == key], dtype=np.int64)
                out["covered"].append(_runs(windows, min_words))
                out["kept"].append(_runs(np.intersect1d(mine, windows), min_words))
            return out
        return work

    return arrow_map(places.join(repeated, "context").select("key", "lows", "steps"), _COVER, cover)


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, max_group: int = MAX_GROUP, max_filter_bytes: int = bloom.MAX_BYTES) -> DataFrame:
    """(key, covered, kept) of each text with repeated passages: key is the text's digest, the others flat lists of word ranges.

    ``covered``: words of windows of min_words words that occur again in
    another text or elsewhere in this one.  ``kept``: words of windows whose
    first occurrence (by text digest and place) is here.  Texts of fewer words
    have none.  Copies of a text count as one text.
    """
    if min_words < K:
        raise ValueError(f"min_words must be at least {K}")
    rows, sc = small_batches(texts(docs)), docs.sparkSession.sparkContext
    shared = stored(_counts(rows, min_words), "llm-minimisers")
    hot = shared.where(F.col("n") > max_group)
    n_shared, n_hot = shared.agg(F.count(F.lit(1)), F.count(F.when(F.col("n") > max_group, 1))).head()
    seen = sc.broadcast(bloom.build(shared, F.col("g"), n_shared, max_filter_bytes))
    # a group's members all go the same way, whether the filter is right about it or not
    common = sc.broadcast(bloom.build(hot, F.col("g"), n_hot, max_filter_bytes)) if n_hot else None
    found = _occurrences(rows, seen, common, min_words)
    if n_hot:
        found = stored(found, "llm-suffixes")
        covers = _compare(found.where("lows is null"), min_words).unionByName(_count_windows(found.where("lows is not null"), min_words))
    else:
        covers = _compare(found, min_words)
    merged = covers.groupBy("key").agg(F.flatten(F.collect_list("covered")).alias("covered"), F.flatten(F.collect_list("kept")).alias("kept"))

    def start():
        return lambda batch: {"key": batch.column("key")} | {c: [_union(x) for x in batch.column(c).to_pylist()] for c in ("covered", "kept")}

    return arrow_map(merged, _COVER, start)


def _union(flat: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(b, out[-1])
        else:
            out += [a, b]
    return out


def _minus(flat: list[int], less: list[int]) -> list[int]:
    """Ranges of ``flat`` without those of ``less``; both sorted and apart."""
    out, cuts = [], list(zip(less[::2], less[1::2], strict=True))
    for a, b in zip(flat[::2], flat[1::2], strict=True):
        for c, d in cuts:
            if d <= a or c >= b:
                continue
            if c > a:
                out += [a, c]
            a = max(a, d)
        if a < b:
            out += [a, b]
    return out


def _with_key(rows: DataFrame, text_col: str) -> DataFrame:
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def start():
        return lambda batch: {n: batch.column(n) for n in batch.schema.names} | {"__llm_key": [_key(t.as_py() or "") for t in batch.column(text_col)]}

    return arrow_map(small_batches(rows), f"{kinds}, `__llm_key` binary", start)


def _copies(keyed: DataFrame) -> DataFrame:
    """(__llm_key, __llm_least, __llm_copies) of texts that more than one row has."""
    return keyed.groupBy("__llm_key").agg(F.min("doc_id").alias("__llm_least"), F.count(F.lit(1)).alias("__llm_copies")).where("__llm_copies > 1")


def find_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """A row per repeated passage: doc_id, first_word, n_words, removable.

    Passages are maximal ranges of words (between ASCII white space, numbered
    from 0) that windows of ``min_words`` repeated words cover, cut where
    ``removable`` changes.  removable is false where the passage's first
    occurrence lies.  Of rows with equal texts those with the smallest doc_id
    come first, and repeated rows of that id all do; in the other rows each
    text of at least min_words words is one removable passage.  Null, empty
    and short texts have no passages.
    """
    keyed = stored(_with_key(texts(docs), "text").select("doc_id", "__llm_key", F.size(F.array_remove(F.split("text", r"[ \t\n\r\x0B\f]+"), "")).alias("n")), "llm-keys")
    spans = stored(repeated_spans(docs, min_words).withColumnRenamed("key", "__llm_key"), "llm-spans")
    rows = keyed.join(_copies(keyed), "__llm_key", "left").join(spans, "__llm_key", "left")
    rows = rows.where((F.col("n") >= min_words) & (F.col("covered").isNotNull() | F.col("__llm_copies").isNotNull()))
    kind = dict(rows.dtypes)["doc_id"]
    rows = rows.select("doc_id", "n", F.col("__llm_copies").isNotNull().alias("copied"),
                       (F.col("__llm_copies").isNull() | F.col("doc_id").eqNullSafe(F.col("__llm_least"))).alias("first"), "covered", "kept")

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            out = {c: [] for c in ("doc_id", "first_word", "n_words", "removable")}
            for doc, n, copied, first, covered, kept in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
                drop = _minus(covered or [], kept or []) if first else [0, n]
                stay = _minus([0, n] if copied else covered, drop) if first else []
                for flat, removable in ((drop, True), (stay, False)):
                    for a, b in zip(flat[::2], flat[1::2], strict=True):
                        for c, x in zip(out, (doc, a, b - a, removable), strict=True):
                            out[c].append(x)
            return out
        return work

    return arrow_map(rows, f"doc_id {kind}, first_word bigint, n_words bigint, removable boolean", start)


def cut_words(text: str, drop: list[int]) -> str:
    """The text without ranges of words, and without the white space after them."""
    raw = text.encode()
    is_word = ~np.isin(np.frombuffer(raw, dtype=np.uint8), np.frombuffer(b" \t\n\r\x0b\x0c", dtype=np.uint8))
    begins = np.flatnonzero(np.diff(np.concatenate([[0], is_word.view(np.int8)])) == 1)
    edge = np.append(begins, len(raw))
    out, at = [], 0
    for a, b in zip(drop[::2], drop[1::2], strict=True):
        out.append(raw[at:edge[a]])
        at = int(edge[b])
    return b"".join([*out, raw[at:]]).decode()


def drop_repeats(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """``docs`` with removable passages cut from the texts, n_chars as the text's new length; all columns stay.

    The first occurrence of each repeated window stays whole.  A row of which
    no word is left goes; texts without repeats, null ones too, stay as they are.
    """
    marked = _with_key(docs, "text")
    light = stored(marked.select("doc_id", "__llm_key"), "llm-keys")
    spans = repeated_spans(docs, min_words).select(F.col("key").alias("__llm_key"), F.col("covered").alias("__llm_covered"), F.col("kept").alias("__llm_stay"))
    rows = marked.join(_copies(light).join(spans, "__llm_key", "full"), "__llm_key", "left")
    copy = F.col("__llm_copies").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("__llm_least"))
    rows = rows.withColumn("__llm_copy", copy).drop("__llm_key", "__llm_least", "__llm_copies")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def start():
        def work(batch: pa.RecordBatch) -> dict:
            rows = batch.to_pydict()
            keep = []
            for i, (text, covered, stay, copied) in enumerate(zip(*[rows[c] for c in ("text", "__llm_covered", "__llm_stay", "__llm_copy")], strict=True)):
                if text is not None and copied and len(text.encode().split()) >= min_words:
                    continue
                drop = _minus(covered, stay) if covered else []
                if drop:
                    rows["text"][i] = cut_words(text, drop)
                    if "n_chars" in rows:
                        rows["n_chars"][i] = len(rows["text"][i])
                    if not rows["text"][i].split():
                        continue
                keep.append(i)
            return {c: [x[i] for i in keep] for c, x in rows.items()}
        return work

    return arrow_map(rows, kinds, start)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated passages of all documents."""
    return find_repeats(table(spark, sf_dir, "documents"))
