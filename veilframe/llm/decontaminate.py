"""Benchmark decontamination by a prefix-filtered join of word shingles.

A window is 13 consecutive words of a benchmark item (a shorter item is one window). A document holds a window only
if it holds the window's rarest shingle of three words, so that shingle alone is looked up: shingles are ordered by
how many items hold them. Where one is found, the item is laid beside the document at the offset that it implies,
as far as both reach, and words are compared one by one; runs as long as a window are contained.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import col, slices, write_table

WINDOW = 13
SHINGLE = 3
#: Bytes of benchmark text in a block. Each block is a pass over the documents with an index of its own.
BLOCK_BYTES = 8 << 20
_MAP_BITS = 22
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def _word_table() -> bytes:
    """A-Z in lower case, digits, lower case letters and non-ASCII bytes as they are, all else a space."""
    table = bytearray(b" " * 256)
    for b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
        table[b] = b
    for b in range(0x41, 0x5B):
        table[b] = b + 32
    return bytes(table)


_TABLE = _word_table()


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_TABLE).split() if text else []


class Index:
    """Windows of a block of items, to be found in documents."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.items: list[tuple[str, np.ndarray]] = []
        for name, text in items:
            number = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)]
            if number:
                self.items.append((name, np.array(number, np.int64)))
        self.short: dict[int, dict[tuple[int, ...], list[str]]] = defaultdict(lambda: defaultdict(list))
        self.anchors: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        rarity = Counter(s for _, ids in self.items for s in {*self._shingles(ids)})
        for i, (name, ids) in enumerate(self.items):
            if len(ids) < SHINGLE:
                self.short[len(ids)][tuple(ids.tolist())].append(name)
                continue
            shingles = self._shingles(ids)
            span = min(window, len(ids)) - SHINGLE + 1
            order = lambda at, s=shingles: (rarity[s[at]], s[at], at)
            for at in {min(range(a, a + span), key=order) for a in range(len(shingles) - span + 1)}:
                self.anchors[shingles[at]].append((i, at))
        self.short, self.anchors = {k: dict(v) for k, v in self.short.items()}, dict(self.anchors)
        self.map = np.zeros(1 << _MAP_BITS, bool)
        if self.anchors:
            self.map[self._place(np.array(list(self.anchors), np.int64), 0)] = True

    @staticmethod
    def _shingles(ids: np.ndarray) -> list[tuple[int, ...]]:
        x = ids.tolist()
        return list(zip(x, x[1:], x[2:], strict=False))

    @staticmethod
    def _place(ids: np.ndarray, axis: int | None) -> np.ndarray:
        u = ids.astype(np.uint64)
        n = len(u) - SHINGLE + 1
        parts = [u[:, j] for j in range(SHINGLE)] if axis == 0 else [u[j : j + n] for j in range(SHINGLE)]
        h = parts[0] * _MIX[0]
        for p, m in zip(parts[1:], _MIX[1:], strict=True):
            h = (h ^ (h >> np.uint64(29))) + p * m
        return (h * _MIX[0]) >> np.uint64(64 - _MAP_BITS)

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Stretches of document words that windows cover, sorted and apart, and the items whose windows occur."""
        known = self.vocabulary.get
        ids = np.array([known(w, 0) for w in words], np.int64)
        runs, names = [], set()
        for n, wanted in self.short.items():
            for at in np.flatnonzero(np.isin(ids, [k[0] for k in wanted])).tolist():
                if found := wanted.get(tuple(ids[at : at + n].tolist())):
                    runs.append((at, at + n))
                    names.update(found)
        if len(ids) >= SHINGLE and self.anchors:
            done = set()
            for at in np.flatnonzero(self.map[self._place(ids, None)]).tolist():
                for i, pos in self.anchors.get(tuple(ids[at : at + SHINGLE].tolist()), ()):
                    if (i, at - pos) not in done:
                        done.add((i, at - pos))
                        self._align(ids, i, at - pos, runs, names)
        return _joined(runs), names

    def _align(self, ids: np.ndarray, i: int, start: int, runs: list, names: set) -> None:
        name, item = self.items[i]
        least = min(self.window, len(item))
        a, b = max(start, 0), min(start + len(item), len(ids))
        if b - a < least:  # the item sticks out of the document too far
            return
        same = np.concatenate(([False], ids[a:b] == item[a - start : b - start], [False]))
        edges = np.flatnonzero(same[1:] != same[:-1])
        for x, y in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if y - x >= least:
                runs.append((a + x, a + y))
                names.add(name)


def _joined(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, starts, ends, items, contaminated) for each row of docs.

    n_hit counts the words inside occurrences of windows, starts and ends are the stretches that they form, items the
    ids of the items found, sorted as strings. Contaminated: some word is hit, and a twentieth of all words at least.

    Null and empty texts have no words and aren't contaminated; items without words are never found; a null item id
    counts as an empty string, and repeated items count once. Repeated rows are kept, and so are null ids. Other columns
    are ignored. The benchmark goes to the executors in blocks of bounded size, a pass over docs for each.
    """
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))
    indexes = _indexes(benchmark, item_col, item_text_col, window, block_bytes)
    passes = [_pass(rows, i, kind) for i in indexes]
    blocks = len(passes)
    if blocks == 1:
        return passes[0].drop("text_hash")
    found = passes[0]
    for one in passes[1:]:
        found = found.unionByName(one)
    # equal rows have equal results: each comes once from every pass
    merged = found.groupBy("doc_id", "text_hash", "n_words").agg((F.count("*") / blocks).cast("int").alias("copies"), F.collect_set(F.arrays_zip("starts", "ends")).alias("runs"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for one in batch.to_pylist():
                runs = _joined([(r["starts"], r["ends"]) for part in one["runs"] for r in part])
                out += [_row(one["doc_id"], one["n_words"], runs, one["items"])] * one["copies"]
            yield _batch(out, batch.schema.field("doc_id").type)

    return merged.select("doc_id", "n_words", "copies", "runs", "items").mapInArrow(join, _schema(kind))


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that aren't contaminated, with all their columns. Nothing is shuffled."""
    indexes = _indexes(benchmark, item_col, item_text_col, window, block_bytes)
    stretches = F.array().cast("array<array<int>>")
    for index in indexes:  # a column of stretches each; each block's pass adds to what the ones before it found
        stretches = _stretches(index)(col(text_col), stretches)
    return docs.where(~_judge()(col(text_col), stretches))


def _stretches(index):
    @F.arrow_udf("array<array<int>>")
    def more(texts: pa.Array, before: pa.Array) -> pa.Array:
        found = [[*map(list, index.value.find(words_of(t))[0]), *b] for t, b in zip(texts.to_pylist(), before.to_pylist(), strict=True)]
        return pa.array(found, pa.list_(pa.list_(pa.int32())))

    return more


def _judge():
    @F.arrow_udf("boolean")
    def contaminated(texts: pa.Array, stretches: pa.Array) -> pa.Array:
        rows = zip(texts.to_pylist(), stretches.to_pylist(), strict=True)
        return pa.array([_row(None, len(words_of(t)), _joined([(a, b) for a, b in s]), [])[-1] for t, s in rows], pa.bool_())

    return contaminated


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int) -> list:
    """Broadcast indexes of blocks of distinct items, each of block_bytes of text at most or of one small range of hashes.

    Items fall into ranges of their hash, a few to a block; a block is as many ranges as its bytes allow. The
    benchmark is read once more and dealt to the blocks, each of which then reads its own part.
    """
    items = benchmark.select(F.coalesce(col(item_col).cast("string"), F.lit("")).alias("item"), col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    ranges = 1 if total <= block_bytes else 8 * math.ceil(total / block_bytes)
    if ranges == 1:
        return [_index(items, window)]
    dealt = write_table(items.withColumn("r", F.pmod(F.xxhash64("item", "text"), F.lit(ranges)).cast("int")), "items")
    sizes = {r.r: r.n for r in dealt.groupBy("r").agg(F.sum(F.octet_length("text")).alias("n")).collect()}  # ranges rows
    cuts, held = [0], 0
    for r in sorted(sizes):
        if held and held + sizes[r] > block_bytes:
            cuts.append(r)
            held = 0
        held += sizes[r]
    return [_index(dealt.where((F.col("r") >= a) & (F.col("r") < b)), window) for a, b in zip(cuts, [*cuts[1:], ranges], strict=True)]


def _index(items: DataFrame, window: int):
    rows = items.select("item", "text").orderBy("item", "text").collect()  # a block's
    return items.sparkSession.sparkContext.broadcast(Index([(r.item, r.text) for r in rows], window))


def _schema(kind: str) -> str:
    return f"doc_id {kind}, n_words long, n_hit long, starts array<int>, ends array<int>, items array<string>, contaminated boolean"


def _row(doc_id, n_words: int, runs: list[tuple[int, int]], items: list[str]) -> tuple:
    hit = sum(b - a for a, b in runs)
    return doc_id, n_words, hit, [a for a, _ in runs], [b for _, b in runs], items, hit > 0 and 20 * hit >= n_words


def _batch(rows: list[tuple], kind: pa.DataType, more: dict | None = None) -> pa.RecordBatch:
    kinds = [kind, pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.bool_()]
    names = ["doc_id", "n_words", "n_hit", "starts", "ends", "items", "contaminated"]
    columns = [pa.array(c, t) for c, t in zip([*zip(*rows, strict=True)] or [()] * len(names), kinds, strict=True)]
    more = more or {}
    return pa.RecordBatch.from_arrays([*columns, *more.values()], [*names, *more])


def _pass(rows: DataFrame, index, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                out, hashes = [], []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = words_of(text)
                    runs, names = index.value.find(words)
                    out.append(_row(key, len(words), runs, sorted(names)))
                    hashes.append(hashlib.blake2b((text or "").encode(), digest_size=16).digest())
                yield _batch(out, part.column(0).type, {"text_hash": pa.array(hashes, pa.binary())})

    return rows.mapInArrow(run, _schema(kind) + ", text_hash binary")
