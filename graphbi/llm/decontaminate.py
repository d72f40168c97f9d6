"""Benchmark decontamination with an Aho-Corasick automaton over word windows.

Item and document are normalised in the same way (A-Z lower-cased, words of
``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` joined by single spaces), so a window
of ten words is one pattern between two spaces.  Each text is scanned once per
automaton; hits are mapped to word numbers and to offsets in the original.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphbi.llm.common import FOLD, arrow_map, fields, stored, table

WINDOW = 10
#: Characters of item text in one automaton. A larger benchmark is scanned in so many blocks, one pass each.
BLOCK_CHARS = 2_000_000


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Windows of ``size`` words; the whole text as one if shorter; none without words."""
    return [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))] if words else []


def build_automaton(items: list[tuple[str, str]], size: int = WINDOW):
    """Automaton whose patterns carry (number of words, item ids as text)."""
    import ahocorasick

    found: dict[bytes, set] = {}
    for item, text in items:
        for w in windows_of(words_of(text), size):
            found.setdefault(w, set()).update([] if item is None else [item])
    auto = ahocorasick.Automaton()
    for w, ids in found.items():
        auto.add_word(f" {w.decode('latin-1')} ", (w.count(b" ") + 1, tuple(sorted(ids))))
    if found:
        auto.make_automaton()
    return auto


def scan(auto, text: str) -> tuple[int, list[tuple[int, int]], set[str]]:
    """(words, merged hit word ranges [first, last), items) of a text."""
    folded = text.encode().translate(FOLD)
    words = folded.split()
    if not words or not len(auto):
        return len(words), [], set()
    joined = f" {b' '.join(words).decode('latin-1')} "  # a character for each byte
    ranges, items, starts = [], set(), None
    for end, (n, ids) in auto.iter(joined):
        if starts is None:
            starts = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), dtype=np.uint8) == 32)
        last = int(np.searchsorted(starts, end))  # the space that closes the window's last word
        first = last - n
        items.update(ids)
        if ranges and first <= ranges[-1][1]:
            ranges[-1][1] = max(last, ranges[-1][1])
            ranges[-1][0] = min(first, ranges[-1][0])
        else:
            ranges.append([first, last])
    return len(words), _merged(ranges), items


def _merged(ranges: list) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, ranges)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def original_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of hit word ranges."""
    if not ranges:
        return []
    raw = text.encode()
    word = np.frombuffer(raw.translate(FOLD), dtype=np.uint8) != 32
    edge = np.diff(np.concatenate([[0], word.view(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    chars = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)  # characters up to and with each byte
    return [(int(chars[starts[a]]) - 1, int(chars[ends[b - 1] - 1])) for a, b in ranges]


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text")).where("text is not null").distinct()


def _n_blocks(benchmark: DataFrame, block_chars: int) -> int:
    return int(_items(benchmark).agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).head()[0]) // block_chars + 1


def _block(benchmark: DataFrame, k: int, n: int) -> list[tuple[str, str]]:
    """The items of block k of n: about ``block_chars`` characters, whatever the benchmark's size."""
    part = _items(benchmark).where(F.pmod(F.xxhash64("text"), F.lit(n)) == k)
    return [(r.item, r.text) for r in part.toLocalIterator()]


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS,
              id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (original offsets).

    Null, empty and wordless texts have no words and no hit.  Repeated rows
    each get a row; items with equal id or equal text count by id; an item
    without id marks words but is no item.  ``keep`` names further columns of
    ``docs`` that are handed through.
    """
    spark = docs.sparkSession
    rows = docs.select(F.struct(*[F.col(id_col).alias("doc_id"), *[F.col(c) for c in keep]]).alias("__row"),
                       F.col(text_col).alias("__text"),
                       F.expr("cast(array() as array<int>)").alias("__ranges"), F.expr("cast(array() as array<string>)").alias("__items"))
    row_type = rows.schema["__row"].dataType.simpleString()
    state = f"__row {row_type}, __text string, __ranges array<int>, __items array<string>"
    result = (f"__row {row_type}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, "
              "items array<string>, spans array<struct<start:int,end:int>>")
    n = _n_blocks(benchmark, block_chars)
    for k in range(n):
        payload = spark.sparkContext.broadcast(pickle.dumps(_block(benchmark, k, n)))

        names = fields(result if k == n - 1 else state).names

        def start(payload=payload, last=k == n - 1, names=names):
            auto = build_automaton(pickle.loads(payload.value), window)

            def work(batch: pa.RecordBatch) -> dict:
                out: dict[str, list] = {c: [] for c in names}
                for text, old, seen in zip(batch.column("__text"), batch.column("__ranges"), batch.column("__items"), strict=True):
                    text, flat, seen = text.as_py(), old.as_py(), seen.as_py()
                    n_words, ranges, items = scan(auto, text or "")
                    ranges = _merged([*ranges, *zip(flat[::2], flat[1::2], strict=True)]) if flat else ranges
                    items = sorted(items.union(seen))
                    hit = sum(b - a for a, b in ranges)
                    row = {"__text": text, "__ranges": [x for r in ranges for x in r], "__items": items} if not last else {
                        "n_words": n_words, "n_hit": hit, "n_items": len(items), "contaminated": hit > 0, "items": items,
                        "items_sha256": hashlib.sha256(",".join(items).encode()).hexdigest(),
                        "spans": [{"start": a, "end": b} for a, b in original_spans(text or "", ranges)]}
                    for c, x in row.items():
                        out[c].append(x)
                return out | {"__row": batch.column("__row")}
            return work

        rows = arrow_map(rows, result if k == n - 1 else state, start)
        rows = rows if k == n - 1 else stored(rows, "llm-decontaminate")
    return rows.select("__row.*", *[c for c in rows.columns if c != "__row"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows in which a window of the benchmark occurs; all columns stay."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return find_hits(whole, benchmark, window, id_col="doc").where(~F.col("contaminated")).select("doc_id.*")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    out = find_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


SQL = r"""WITH dw AS (SELECT doc_id, row_number() OVER () AS rid,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id,
    list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS gram
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
occ AS (SELECT d.rid, d.i, d.n, win.item_id FROM (
    SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram FROM (
      SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, sizes WHERE len(w) >= n)) d JOIN win ON d.n = win.n AND d.gram = win.gram),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS p FROM occ) GROUP BY rid),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item FROM occ WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)"""
