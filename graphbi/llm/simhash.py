"""SimHash near-dedup: exact comparison of fingerprint tiles.

A tile holds fingerprints with equal population counts of their four 16-bit
parts.  Counts of two fingerprints that differ in r bits differ by r in sum at
most, so only tiles whose counts lie that near are compared, with numpy
exclusive-or and bit counts; all other tile pairs are skipped.  Equal
fingerprints are one row of a tile.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphbi.llm.common import LOWER, arrow_map, partition_map, small_batches, stored, table
from graphbi.llm.components import components

#: Fixed by the contract: words in a shingle, seed of the hash, largest bit distance.
SHINGLE, SEED, RADIUS = 3, 42, 2
PARTS, PART_BITS = 4, 16
#: Fingerprints in a tile, about; a fuller cell is split into several tiles.
TILE_ROWS = 4096
_STEP, _BLOCK = 1 << 14, 512


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Unsigned fingerprint of a whole text; 0 without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    joined, size = b" ".join(words), min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])[:len(words) - size + 1].tolist()
    ends = (ends[size - 1:] - 1).tolist()
    ones, digest = np.zeros(64, dtype=np.int64), xxhash.xxh64_digest
    for at in range(0, len(starts), _STEP):
        part = b"".join([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + _STEP], ends[at:at + _STEP], strict=True)])
        ones += np.unpackbits(np.frombuffer(part, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def add_fingerprint(rows: DataFrame, text_col: str, out: str, size: int = SHINGLE) -> DataFrame:
    """``rows`` with the fingerprint as a (signed) bigint."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def start():
        return lambda batch: {n: batch.column(n) for n in batch.schema.names} | {
            out: np.array([fingerprint(t.as_py(), size) for t in batch.column(text_col)], dtype=np.uint64).view(np.int64)}

    return arrow_map(small_batches(rows), f"{kinds}, `{out}` bigint", start)


def _cells(fps: DataFrame) -> DataFrame:
    counts = [F.bit_count(F.shiftrightunsigned("fp", PART_BITS * i).bitwiseAND(F.lit((1 << PART_BITS) - 1).cast("long"))) for i in range(PARTS)]
    return fps.select("fp", *[c.alias(f"p{i}") for i, c in enumerate(counts)])


def _cell_id(parts) -> F.Column:
    out = F.lit(0)
    for p in parts:
        out = out * (PART_BITS + 1) + p
    return out


def _shifts(radius: int) -> list[tuple[int, ...]]:
    """One of each pair of opposite count differences with a sum of at most the radius; not the zero one."""
    near = range(-radius, radius + 1)
    return [d for d in itertools.product(near, repeat=PARTS) if 0 < sum(map(abs, d)) <= radius and next(x for x in d if x) > 0]


def near_pairs(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Edges (a, b) that connect distinct fingerprints ``fp`` exactly as all pairs within ``radius`` bits do.

    Pairs that only repeat a connection found in the same tile are left out.
    """
    rows = stored(_cells(fps), "llm-cells")
    cell = _cell_id([F.col(f"p{i}") for i in range(PARTS)])
    # at most 17^4 cells, whatever the number of rows: the bound makes the broadcasts safe
    cells = rows.groupBy(cell.alias("cell")).agg(F.ceil(F.count(F.lit(1)) / tile_rows).cast("int").alias("tiles"))
    cells = F.broadcast(stored(cells, "llm-cells"))
    home = rows.withColumn("cell", cell).join(cells, "cell").withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int"))
    shift = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{i}") for i, x in enumerate(d)]) for d in _shifts(radius)]))
    moved = rows.select("fp", *[f"p{i}" for i in range(PARTS)], shift.alias("d")).select("fp", *[(F.col(f"p{i}") + F.col(f"d.d{i}")).alias(f"p{i}") for i in range(PARTS)])
    for i in range(PARTS):
        moved = moved.where(F.col(f"p{i}").between(0, PART_BITS))
    guests = moved.select("fp", cell.alias("cell")).join(cells, "cell").select("fp", "cell", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"))
    inside = home.where(F.col("tile") < F.col("tiles") - 1).select("fp", "cell", F.explode(F.sequence(F.col("tile") + 1, F.col("tiles") - 1)).alias("tile"))
    dealt = (home.select("cell", "tile", F.lit(False).alias("guest"), "fp")
             .unionByName(guests.unionByName(inside).select("cell", "tile", F.lit(True).alias("guest"), "fp"))
             .repartition("cell", "tile").sortWithinPartitions("cell", "tile", "guest"))

    def run(batches):
        tile, at = None, None
        for batch in batches:
            key = batch.column("cell").to_numpy().astype(np.int64) << 32 | batch.column("tile").to_numpy()
            guest, fp = batch.column("guest").to_numpy(zero_copy_only=False), batch.column("fp").to_numpy().view(np.uint64)
            cuts = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (guest[1:] != guest[:-1])]))
            for a, b in zip(cuts, [*cuts[1:], len(key)], strict=True):
                if key[a] != at:
                    if tile is not None:
                        yield tile.edges()
                    tile, at = _Tile(radius), key[a]
                tile.guests(fp[a:b]) if guest[a] else tile.home(fp[a:b])
                if tile.found > _STEP:
                    yield tile.edges()
        if tile is not None:
            yield tile.edges()

    return partition_map(dealt, "a bigint, b bigint", run)


class _Tile:
    """Bounded: the home rows (about a tile's size), a block of guests, and the edges since the last call of edges()."""

    def __init__(self, radius: int):
        self.radius, self.rows, self.label, self.a, self.b, self.found = radius, np.zeros(0, np.uint64), np.zeros(0, np.int64), [], [], 0

    def _add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a.append(a)
        self.b.append(b)
        self.found += len(a)

    def _unite(self, i: np.ndarray, j: np.ndarray) -> None:
        """Connects home rows; only those that aren't connected yet make an edge."""
        x, y = self.label[i], self.label[j]
        pairs = np.unique(np.column_stack([np.minimum(x, y), np.maximum(x, y)])[x != y], axis=0)
        parent: dict[int, int] = {}

        def top(k: int) -> int:
            while (p := parent.get(k, k)) != k:
                k = p
            return k

        a, b = [], []
        for x, y in pairs.tolist():
            x, y = sorted((top(x), top(y)))
            if x != y:
                parent[y] = x
                a.append(x)
                b.append(y)
        if a:
            self._add(self.rows[a], self.rows[b])
            names = np.arange(len(self.rows))
            for k in parent:
                names[k] = top(k)
            self.label = names[self.label]

    def home(self, fp: np.ndarray) -> None:
        before = len(self.rows)
        self.rows = np.concatenate([self.rows, fp])
        self.label = np.concatenate([self.label, np.arange(before, len(self.rows))])
        for at in range(before, len(self.rows), _BLOCK):
            block = self.rows[at:at + _BLOCK]
            i, j = np.nonzero(np.bitwise_count(self.rows[:at + len(block), None] ^ block[None, :]) <= self.radius)
            keep = i < j + at
            self._unite(i[keep], j[keep] + at)

    def guests(self, fp: np.ndarray) -> None:
        for at in range(0, len(fp), _BLOCK):
            block = fp[at:at + _BLOCK]
            j, i = np.nonzero(np.bitwise_count(block[:, None] ^ self.rows[None, :]) <= self.radius)
            if len(j):
                who, first = np.unique(j, return_index=True)
                self._add(block[who], self.rows[i[first]])
                self._unite(i, np.repeat(i[first], np.diff(np.append(first, len(j)))))

    def edges(self) -> dict:
        a, b = (np.concatenate([np.zeros(0, np.uint64), *x]).view(np.int64) for x in (self.a, self.b))
        self.a, self.b, self.found = [], [], 0
        return {"a": a, "b": b}


def link(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint in rows (doc_id, fp); component_id is null if all ids are."""
    fps = fingerprints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(near_pairs(fps.select("fp"), radius))
    named = fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return named.join(named.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row.

    Null and wordless texts have the fingerprint zero and link like any other.
    Repeated rows each get a row.  Null ids are never a component's smallest
    unless it has no other.
    """
    rows = docs.select("doc_id", "text")
    marked = stored(add_fingerprint(rows, "text", "fp", size).select("doc_id", "fp"), "llm-simhash")
    out = marked.join(link(marked, radius), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def drop_near_duplicates(docs: DataFrame, radius: int = RADIUS, size: int = SHINGLE) -> DataFrame:
    """One row of each component stays: that with the smallest doc_id, of several such rows the first by content; all columns stay.

    Decided on (doc_id, fp); texts take part in no shuffle while the ids that
    go are few enough for Spark to broadcast.  Only rows whose id is null or
    repeated are fingerprinted a second time, since their id doesn't tell them apart.
    """
    light = stored(add_fingerprint(docs.select("doc_id", "text"), "text", "fp", size).select("doc_id", "fp"), "llm-simhash")
    groups = stored(link(light, radius), "llm-simhash-groups")
    many = stored(light.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "llm-simhash-repeated")
    gone = stored(light.join(groups, "fp").where(F.col("doc_id") != F.coalesce("component_id", "doc_id")).select("doc_id").distinct(), "llm-simhash-gone")
    alone = docs.where("doc_id is not null").join(gone.unionByName(many), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
    unnamed = docs.where("doc_id is null")
    if not many.isEmpty():
        unnamed = unnamed.unionByName(docs.join(many, "doc_id", "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns]))
    marked = add_fingerprint(unnamed, "text", "__llm_fp", size)
    names = groups.select(F.col("fp").alias("__llm_fp"), F.col("root").alias("__llm_root"), F.col("component_id").alias("__llm_component"))
    kept = marked.join(names, "__llm_fp").where(F.col("doc_id").eqNullSafe(F.col("__llm_component")))
    # what is left of a component has one id
    order = [F.xxhash64("text"), *[F.col(f"`{c}`").cast("string") for c in docs.columns if c not in ("doc_id",)]]
    first = F.row_number().over(Window.partitionBy("__llm_root").orderBy(*order))
    repeated = kept.withColumn("__llm_n", first).where(F.col("__llm_n") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return alone.unionByName(repeated)
