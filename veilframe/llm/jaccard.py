"""Exact Jaccard join of texts on word shingles: size-banded tiles and hashed bit maps before exact intersection.

A text is the set of its shingles' 64-bit hashes; texts of one set are a class, and classes are what is joined.

1. Tiles. Sets as alike as the threshold share one of their first n - ceil(t * n) + 1 shingles in any order that
   all sets follow. The order puts shingles that many texts hold last, so that common passages make no tiles. A tile
   is a shingle and a band of set sizes; a class meets its own band and the one below.
2. Stars. In each tile every class is compared with a few centres. Their links join most near copies, in as many
   comparisons as there are rows, and give first components.
3. The rest, in two rounds. Classes of a tile are compared pair by pair only where their first components differ: all that could
   still join components, and nothing within a group of copies. Pairs of small tiles come from a join; the classes of
   a large tile meet in blocks of bounded size, where bit maps are laid side by side, and only likely pairs leave.

A comparison first bounds the overlap from above by the bits that only one of two bit maps has, and only where that
leaves a chance intersects the sorted hash arrays. Sets are made again from the texts for those classes alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilframe.llm.common import bit_set, col, release_memory, slices, spread_join, write_table
from veilframe.llm.components import components

WORDS = 5
#: Percent of the union that the intersection has at least.
PERCENT = 80
#: Common shingles that are sent to the executors at most, and what a task reports at most. They only order shingles.
COMMON, TASK_COMMON, LEAST_COMMON = 1 << 18, 1 << 14, 8
#: log2 of the bits of the filter for classes whose sets are made again; a false hit costs time only.
FILTER_BITS = 24
#: Classes of a shingle up to which they are paired by a join; beyond, bit maps are laid side by side in blocks.
SMALL_TILE, BLOCK = 32, 4096
#: Likeliest partners that a class of a large tile is compared with before all that are then still apart.
NEAREST = 3
#: Texts of a shingle from which its rows are dealt to several tasks when shared ones are told from the rest.
HOT_SHINGLE = 512
_COMPACT = 1 << 20
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def shingle_set(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a UTF-8 text's shingles of lower-cased (A-Z) words; of all words if there are fewer."""
    import xxhash

    tokens = text.lower().split() if text else []  # bytes have ASCII cases and white space alone
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    n = len(tokens) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = (out ^ (out >> np.uint64(31))) * _MIX[j % 5] + h[j : j + n]
    out = (out ^ (out >> np.uint64(29))) * _MIX[1]
    return np.unique(out ^ (out >> np.uint64(32)))


def class_of(hashes: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed numbers; of the first only the top bits are used."""
    import xxhash

    d = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(d[:8], "little", signed=True) >> (64 - bits), int.from_bytes(d[8:], "little", signed=True)


def class_name(pair: tuple[int, int], clashing: frozenset[int]) -> int:
    """The class of a set: the first number, but the second one where several sets share the first."""
    return pair[1] if pair[0] in clashing else pair[0]


def clashing_classes(sets: DataFrame) -> frozenset[int]:
    """First numbers that several sets share. Chance alone makes them: some hundreds among 10^11 sets."""
    shared = sets.groupBy("cls").agg(F.min("clash").alias("lo"), F.max("clash").alias("hi")).where("lo <> hi")
    return frozenset(r.cls for r in shared.select("cls").collect())


def renamed(sets: DataFrame, clashing: frozenset[int]) -> DataFrame:
    return sets.withColumn("cls", F.when(F.col("cls").isin(*clashing), F.col("clash")).otherwise(F.col("cls"))) if clashing else sets


def needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least overlap of linked sets of these sizes."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def bit_map(hashes: np.ndarray) -> bytes:
    """A bit for each hash by its low bits, in four times as many bits as hashes, rounded up to a power of 2."""
    bits = np.zeros(max(64, 1 << (4 * len(hashes) - 1).bit_length()), bool)
    bits[(hashes & np.uint64(len(bits) - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def overlap_bound(a: bytes, b: bytes, n_a: int, n_b: int) -> int:
    """No overlap is larger: what has a bit that the other map lacks isn't in the other set. Wide maps are folded."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    both = x & y
    return min(n_a - int(np.bitwise_count(x ^ both).sum()), n_b - int(np.bitwise_count(y ^ both).sum()))


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int((b[at] == a).sum()) if len(b) else 0


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, words: int, class_bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """Two tables from one pass: (doc_id, h, n, cls, clash, bits) of each row, and common shingles (key, n) of each task.

    h is a hash of the text. bits is the bit map, with the first text of a class in a task; a set of less than two
    shingles has none.
    """
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    schema = f"doc_id {kind}, h long, n long, cls long, clash long, bits binary, keys array<long>, counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        counted = _Counter()
        id_type = None
        for batch in batches:
            id_type = batch.column(0).type
            for part in slices(batch, 2):
                n, cls, clash, bits = [], [], [], []
                for text in part.column(2).to_pylist():
                    hashes = shingle_set(text, words)
                    this = class_of(hashes, class_bits)
                    fresh = len(hashes) > 1 and this not in seen
                    if fresh:
                        seen.add(this)
                        counted.add(hashes)
                    n.append(len(hashes))
                    cls.append(this[0])
                    clash.append(this[1])
                    bits.append(bit_map(hashes) if fresh else None)
                none = [None] * len(n)
                yield _batch(part.column(0), part.column(1), n, cls, clash, bits, none, none)
        if id_type is not None:
            keys, counts = counted.most(TASK_COMMON)
            yield _batch(pa.array([None], id_type), pa.array([0], pa.int64()), [-1], [0], [0], [None], [keys.view(np.int64)], [counts.astype(np.int32)])
        release_memory()

    rows = docs.select(col(id_col).alias("doc_id"), F.xxhash64(col(text_col)).alias("h"), col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
    written = write_table(rows, "shingle-sets")
    common = written.where("n < 0").select(F.explode(F.arrays_zip("keys", "counts")).alias("x")).groupBy(F.col("x.keys").alias("key")).agg(F.sum("x.counts").alias("n"))
    return written.where("n >= 0").select("doc_id", "h", "n", "cls", "clash", "bits"), common


def _batch(ids: pa.Array, h: pa.Array, n: list, cls: list, clash: list, bits: list, keys: list, counts: list) -> pa.RecordBatch:
    columns = [ids, h, pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(clash, pa.int64()), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "h", "n", "cls", "clash", "bits", "keys", "counts"])


class _Counter:
    """Counts of hashes, of which those seen once are forgotten now and then."""

    def __init__(self):
        self.waiting: list[np.ndarray] = []
        self.size = 0
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self.waiting.append(hashes)
        self.size += len(hashes)
        if self.size > _COMPACT:
            self._compact()

    def _compact(self) -> None:
        keys = np.concatenate([self.keys, *self.waiting])
        counts = np.concatenate([self.counts, np.ones(self.size, np.int64)])
        self.waiting, self.size = [], 0
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        if len(starts):
            keys, counts = keys[starts], np.add.reduceat(counts, starts)
        self.keys, self.counts = keys[counts > 1], counts[counts > 1]

    def most(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        self._compact()
        order = np.lexsort((self.keys, -self.counts))[:limit]
        return self.keys[order], self.counts[order]


def most_common(common: DataFrame) -> DataFrame:
    """(key, n) of at most COMMON shingles, those above a count that a histogram of counts gives."""
    common = write_table(common.where(F.col("n") >= LEAST_COMMON).withColumn("step", F.floor(F.log2("n") * 16).cast("int")), "common")
    left, least = COMMON, None
    for r in sorted(common.groupBy("step").count().collect(), key=lambda r: -r.step):  # 16 steps for each doubling
        left -= r["count"]
        if left < 0:
            break
        least = r.step
    return common.where(F.col("step") >= least if least is not None else F.lit(False)).select("key", "n")


def tiles(docs: DataFrame, common: DataFrame, text_col: str, words: int, percent: int, clashing: frozenset[int] = frozenset(), class_bits: int = 64) -> DataFrame:
    """(token, cls, n, at): each class at the shingles of its prefix that another class has in its prefix too.

    Shingles that are known to be common stay without that test, so that no task needs all rows of one of them.
    """
    top = most_common(common).toArrow()  # COMMON bounds it
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((keys[order], top.column("n").to_numpy()[order]))
    hot = HOT_SHINGLE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = shared.value
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch, 0):
                token, cls, size, place, dealt = [], [], [], [], []
                for text in part.column(0).to_pylist():
                    hashes = shingle_set(text, words)
                    this = class_name(class_of(hashes, class_bits), clashing)
                    if len(hashes) < 2 or this in seen:
                        continue
                    seen.add(this)
                    p = prefix_length(len(hashes), percent)
                    rank = np.zeros(len(hashes), np.int64)
                    if len(keys):
                        at = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
                        rank = np.where(keys[at] == hashes, counts[at], 0)
                        order = np.lexsort((hashes, rank))
                        hashes, rank = hashes[order], rank[order]
                    token.append(hashes[:p].view(np.int64))
                    cls.append(np.full(p, this, np.int64))
                    size.append(np.full(p, len(hashes), np.int32))
                    place.append(np.arange(p, dtype=np.int32))
                    dealt.append(np.where(rank[:p] > hot, 1 + this % np.maximum(-(-rank[:p] // hot), 1), 0).astype(np.int32))
                columns = [np.concatenate([np.empty(0, d), *x]) for x, d in ((token, np.int64), (cls, np.int64), (size, np.int32), (place, np.int32), (dealt, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "cls", "n", "at", "part"])
        release_memory()

    prefixes = docs.select(col(text_col).cast("binary")).mapInArrow(run, "token long, cls long, n int, at int, part int")
    by_token = Window.partitionBy("token", "part")
    several = prefixes.withColumn("lo", F.min("cls").over(by_token)).withColumn("hi", F.max("cls").over(by_token)).where("lo <> hi OR part > 0")
    return write_table(several.select("token", "part", "cls", "n", "at").distinct().drop("part"), "tiles")


def _band(percent: int, shift: float = 0.0):
    """The band of a set's size; sizes that can be linked are in one band or in bands side by side."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) - 1e-9 + shift).cast("int")


def star_pairs(tiled: DataFrame, percent: int, salts: int = 3) -> DataFrame:
    """(a, b, n_a, n_b): every class with the centres of each of its tiles, of bands and of bands moved by half.

    Each salt makes a class of the tile its centre, the same one in most tiles of a group of near copies.
    """
    found = None
    for shift in (0.0, 0.5):
        rows = tiled.withColumn("band", _band(percent, shift))
        least = [F.min_by(c, F.xxhash64("cls", F.lit(k))).alias(f"{c}{k}") for k in range(salts) for c in ("cls", "n")]  # numbers, which hash aggregates take
        cs = F.array_distinct(F.array(*(F.struct(F.col(f"cls{k}").alias("cls"), F.col(f"n{k}").alias("n")) for k in range(salts))))
        centres = rows.groupBy("token", "band").agg(*least).select("token", "band", cs.alias("cs"))
        each = spread_join(rows, centres, ["token", "band"], ["cls"]).select("cls", "n", F.explode("cs").alias("c"))
        pairs = each.where("cls <> c.cls").select(F.least("cls", "c.cls").alias("a"), F.greatest("cls", "c.cls").alias("b"), F.when(F.col("cls") < F.col("c.cls"), F.col("n")).otherwise(F.col("c.n")).alias("n_a"), F.when(F.col("cls") < F.col("c.cls"), F.col("c.n")).otherwise(F.col("n")).alias("n_b"))
        found = pairs if found is None else found.unionByName(pairs)
    return found.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").distinct()


def _apart(tiled: DataFrame, joined: DataFrame | None) -> DataFrame:
    """tiled with each class's component, and m, its rows, for shingles whose classes aren't all of one component."""
    if joined is None:
        rows = tiled.withColumn("comp", F.col("cls"))
    else:
        rows = write_table(tiled.join(joined, tiled.cls == joined.node, "left").select("token", "cls", "n", "at", F.coalesce("component", "cls").alias("comp")), "tiles-named")
    several = rows.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m")).where("lo <> hi").select("token", "m")
    return spread_join(rows, several, ["token"], ["cls"])


def cross_likely(tiled: DataFrame, joined: DataFrame | None, sets: DataFrame, percent: int, nearest: int | None = None) -> DataFrame:
    """(a, b): likely pairs of classes of a tile that joined (node, component) doesn't put into one component.

    With nearest, a class of a large tile has its likeliest partners only. Where a shingle is the first that two prefixes share, at most as much is shared as either has from there on.
    """
    rows = write_table(_apart(tiled, joined).withColumn("band", _band(percent)), "tiles-apart")
    small = rows.where(F.col("m") <= SMALL_TILE)
    left = small.select(F.col("token").alias("t"), F.col("band").alias("tile"), F.col("cls").alias("a"), F.col("n").alias("n_a"), F.col("at").alias("at_a"), F.col("comp").alias("comp_a"), F.col("band").alias("band_a"))
    right = small.select("token", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("into"), "cls", "n", "at", "comp", "band")
    most = F.least(F.col("n_a") - F.col("at_a"), F.col("n") - F.col("at"))
    alike = (F.col("t") == F.col("token")) & (F.col("tile") == F.col("into")) & (F.col("comp_a") != F.col("comp"))
    alike &= (F.col("band") < F.col("band_a")) | (F.col("a") < F.col("cls"))
    alike &= most * (100 + percent) >= (F.col("n_a") + F.col("n")) * percent
    pairs = left.join(right, alike).select("a", F.col("cls").alias("b"), "n_a", F.col("n").alias("n_b")).distinct()
    return bounded(pairs, sets, percent).unionByName(_blocks(rows.where(F.col("m") > SMALL_TILE), sets, percent, nearest)).distinct()


def _blocks(rows: DataFrame, sets: DataFrame, percent: int, nearest: int | None) -> DataFrame:
    """(a, b): likely pairs within large tiles. A tile's classes are cut into blocks, and any two blocks meet once."""
    maps = sets.where("bits IS NOT NULL").groupBy("cls").agg(F.first("bits").alias("bits"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("cls", F.lit("block")), blocks).cast("int")
    other = F.sequence(F.lit(0), blocks - 1)
    dealt = rows.join(maps, "cls").withColumn("own", own).withColumn("other", F.explode(other))
    dealt = dealt.select("token", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "cls", "comp", "n", "at", "bits")
    sorted_ = dealt.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            a, b = _pairs_of(held, key[1] != key[2], percent, nearest) if key else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            for token, i, j, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (token, i, j) != key:
                    yield done()
                    key, held = (token, i, j), []
                held.append(row)
        yield done()

    return sorted_.mapInArrow(compare, "a long, b long").distinct()


def _pairs_of(rows: list[list], two: bool, percent: int, nearest: int | None = None) -> tuple[list[int], list[int]]:
    """Likely pairs among rows (own, cls, comp, n, at, bits): the larger set of each pair against all smaller at once.

    With two, only pairs of two blocks. A set's map is as wide as a not much smaller set's, or twice as wide.
    """
    by_width: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r[3], r[1])):
        by_width.setdefault(len(r[5]), []).append(r)
    packed = {}
    for width, group in by_width.items():
        own, cls, comp, n, at = (np.array(x) for x in list(zip(*group, strict=True))[:5])
        packed[width] = own, cls, comp, n, at, np.frombuffer(b"".join([r[5] for r in group]), np.uint64).reshape(len(group), -1)
    left, right = [], []
    for width, (own, cls, comp, n, at, maps) in packed.items():
        for other in (width, width // 2):
            if other not in packed:
                continue
            half = maps.shape[1] // 2
            mine = maps if other == width else maps[:, :half] | maps[:, half:]
            own_b, cls_b, comp_b, n_b, at_b, maps_b = packed[other]
            first = np.searchsorted(n_b, -(-percent * n // 100), "left")
            last = np.arange(len(n)) if other == width else np.searchsorted(n_b, n, "right")
            for k in np.flatnonzero(last > first).tolist():
                x = slice(int(first[k]), int(last[k]))
                least = -(-percent * (n[k] + n_b[x]) // (100 + percent))
                keep = (comp_b[x] != comp[k]) & (np.minimum(n[k] - at[k], n_b[x] - at_b[x]) >= least)
                if two:
                    keep &= own_b[x] != own[k]
                where = np.flatnonzero(keep)
                if not len(where):
                    continue
                theirs = maps_b[x][where]
                only_mine, only_theirs = (np.bitwise_count(m).sum(axis=1, dtype=np.int64) for m in (mine[k] & ~theirs, theirs & ~mine[k]))
                spare = np.minimum(n[k] - only_mine, n_b[x][where] - only_theirs) - least[where]
                where, spare = where[spare >= 0], spare[spare >= 0]
                likely = where if nearest is None else where[np.argsort(-spare, kind="stable")[:nearest]]
                left += np.minimum(cls[k], cls_b[x][likely]).tolist()
                right += np.maximum(cls[k], cls_b[x][likely]).tolist()
    return left, right


def _both(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """Written pairs (a, b) with rows' (cls, value) of either side, under the names value_a and value_b.

    Centres of stars are in many pairs; these are dealt to several tasks.
    """
    side = lambda k: rows.select(F.col("cls").alias(k), F.col(value).alias(f"{value}_{k}"))
    one = spread_join(pairs, side("a"), ["a"], ["b"], pairs)
    return spread_join(one, side("b"), ["b"], ["a"], pairs)


def bounded(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bit maps leave a chance of enough overlap."""
    maps = sets.where("bits IS NOT NULL").groupBy("cls").agg(F.first("bits").alias("bits"))
    both = _both(write_table(pairs, "pairs"), maps, "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(i).to_numpy() for i in range(4))
            maps_a, maps_b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            keep = [i for i in range(batch.num_rows) if overlap_bound(maps_a[i], maps_b[i], int(n_a[i]), int(n_b[i])) >= needed(int(n_a[i]), int(n_b[i]), percent)]
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text_col: str, words: int, percent: int, label: str, clashing: frozenset[int] = frozenset(), class_bits: int = 64) -> DataFrame:
    """The pairs (a, b) whose sets overlap enough, by intersecting the sorted arrays.

    Only texts that may be the chosen one of a wanted class are cut into shingles again.
    """
    pairs = write_table(pairs, f"{label}-likely")
    wanted = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    chosen = sets.where("bits IS NOT NULL").groupBy("cls").agg(F.min("h").alias("h"))
    wanted = wanted.join(chosen, "cls").select(F.pmod("h", F.lit(1 << FILTER_BITS)).alias("at"))
    shared = docs.sparkSession.sparkContext.broadcast(bit_set(wanted, FILTER_BITS))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        seen: set[bytes] = set()
        for batch in batches:
            at = batch.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)
            likely = batch.filter(pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            for part in slices(likely, 1):
                cls, sets = [], []
                for text in part.column(1).to_pylist():
                    digest = xxhash.xxh3_128_digest(text or b"")
                    if digest not in seen:
                        seen.add(digest)
                        hashes = shingle_set(text, words)
                        cls.append(class_name(class_of(hashes, class_bits), clashing))
                        sets.append(hashes.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(cls, pa.int64()), pa.array(sets, pa.binary())], ["cls", "hashes"])
        release_memory()

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if overlap(a, b) >= needed(len(a), len(b), percent):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))
        release_memory()

    made = docs.select(F.xxhash64(col(text_col)).alias("h"), col(text_col).cast("binary").alias("text")).mapInArrow(make, "cls long, hashes binary")
    sets = write_table(made, f"{label}-sets").dropDuplicates(["cls"])
    both = _both(pairs, sets, "hashes")
    return write_table(both.select("a", "b", "hashes_a", "hashes_b").mapInArrow(intersect, "a long, b long"), f"{label}-links")


def class_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """All links: pairs (a, b) of classes, and membership (doc_id, n, cls). Rows of one class are linked unless n is 0.

    The number of pairs is that of the links between different sets; near_duplicates() does without most of them.
    """
    sets, common = shingle_sets(docs, id_col, text_col, words)
    clashing = clashing_classes(sets)
    sets = renamed(sets, clashing)
    tiled = tiles(docs, common, text_col, words, percent, clashing)
    links = verified(cross_likely(tiled, None, sets, percent), sets, docs, text_col, words, percent, "all", clashing)
    return links, sets.select("doc_id", "n", "cls")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, class_bits: int = 64) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs.

    Two rows are linked when their sets' intersection is percent of the union at least. component_id is the smallest
    doc_id that a row reaches over links, its own included. A text of fewer words than a shingle is one shingle; a
    null text, or one without words, has no shingles and is linked with nothing. Repeated rows are kept and linked.
    A null id stays null in doc_id and doesn't count as smallest. Other columns are ignored. class_bits shortens the
    first number of a class, for tests of what happens when sets share it.
    """
    sets, common = shingle_sets(docs, id_col, text_col, words, class_bits)
    clashing = clashing_classes(sets)
    sets = renamed(sets, clashing)
    tiled = tiles(docs, common, text_col, words, percent, clashing, class_bits)
    exact = lambda pairs, label: verified(pairs, sets, docs, text_col, words, percent, label, clashing, class_bits)
    near = exact(bounded(star_pairs(tiled, percent), sets, percent), "star")
    parts = write_table(components(near), "components")
    for nearest in (NEAREST, None):  # the likeliest of a large tile first, then all that is still apart
        rest = exact(cross_likely(tiled, parts, sets, percent, nearest), "cross")
        parts = write_table(components(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest)), "components")
    members = sets.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"))
    named = members.join(parts, members.cls == parts.node, "left").select("cls", "least", F.coalesce("component", "cls").alias("part"))
    smallest = named.groupBy("part").agg(F.min("least").alias("component_id"))
    ids = named.join(smallest, "part").select("cls", "component_id")
    narrow = sets.select("doc_id", "n", "cls", "h")
    return spread_join(narrow, ids, ["cls"], ["doc_id", "h"], how="left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
