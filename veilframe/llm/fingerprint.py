"""Canonical exact digests: NFKC, case folding and white space folding, then 128 bits of xxhash.

Texts of equal digest are compared byte by byte. Where two canonical texts share a digest after all, both are told
apart by SHA-256 behind the digest, so that a fingerprint stands for one canonical text.
"""

from __future__ import annotations

import hashlib
import math
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import bit_set, col, slices, write_table

#: Rows of a range of ids on average, and the most ranges; more rows make larger ranges. Keys that are looked at to cut
#: one range from the next: they only decide how even the ranges are.
RANGE_ROWS, MAX_RANGES, RANGE_KEYS = 2000, 1 << 15, 20
#: log2 of the bits of the map of digests that occur more than once; a digest's first bits are its place.
MAP_BITS = 22
#: Bytes of canonical texts that a task keeps for comparing before the shuffle.
KEPT_BYTES = 32 << 20


def canonical(text: str | None) -> bytes:
    """NFKC, full case folding, NFKC again, runs of white space as one space, none at the ends; null is empty."""
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text or "").casefold())
    return " ".join(folded.split()).encode()


def digest(body: bytes, bits: int = 128) -> str:
    import xxhash

    return f"{xxhash.xxh3_128_intdigest(body) >> (128 - bits):0{-(-bits // 4)}x}".ljust(32, "0")


def _named(body: bytes, bits: int, shared: frozenset[str]) -> str:
    name = digest(body, bits)
    return f"{name}-{hashlib.sha256(body).hexdigest()}" if name in shared else name


def shared_digests(docs: DataFrame, digests: DataFrame, text_col: str, bits: int) -> frozenset[str]:
    """Digests that stand for more than one canonical text; of 128 bits there should be none.

    digests has a column digest for each row of docs. A bit map of fixed size says which digests may occur twice;
    only texts of these are dealt out by digest, each once from a task, and compared byte by byte with the first.
    """
    place = F.shiftright(F.conv(F.substring("digest", 1, 6), 16, 10).cast("long"), 24 - MAP_BITS)
    twice = digests.groupBy("digest").count().where("count > 1").select(place.alias("at"))
    bitmap = bit_set(twice, MAP_BITS).tobytes()
    if not any(bitmap):
        return frozenset()

    def ship(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, kept, held = zstandard.ZstdCompressor(level=1), {}, 0
        for batch in batches:
            for part in slices(batch, 0):
                out = {"digest": [], "body": []}
                for text in part.column(0).to_pylist():
                    body = canonical(text)
                    name = digest(body, bits)
                    at = int(name[:6], 16) >> (24 - MAP_BITS)
                    if not bitmap[at >> 3] >> (at & 7) & 1 or kept.get(name) == body:
                        continue
                    if name not in kept and held + len(body) <= KEPT_BYTES:
                        kept[name], held = body, held + len(body)
                    out["digest"].append(name)
                    out["body"].append(packer.compress(body))
                yield pa.RecordBatch.from_arrays([pa.array(out["digest"], pa.string()), pa.array(out["body"], pa.binary())], ["digest", "body"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, told = None, None, False
        for batch in batches:
            found = []
            for this, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if this != name:
                    name, first, told = this, body, False
                elif body != first and not told:  # the packer gives equal bytes for equal bytes
                    found.append(name)
                    told = True
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["digest"])

    shipped = docs.select(col(text_col)).mapInArrow(ship, "digest string, body binary")
    dealt = shipped.repartition("digest").sortWithinPartitions("digest")
    return frozenset(r.digest for r in dealt.mapInArrow(compare, "digest string").collect())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """(doc_id, fingerprint) for each row of docs: equal where the canonical texts are equal, and nowhere else.

    A null text is empty. Null ids and repeated rows are kept. Other columns are ignored. bits shortens the digest,
    for tests of what happens when texts share one.
    """
    kind = docs.select(col(id_col)).schema[0].dataType.simpleString()
    rows = docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text"))

    def run(shared: frozenset[str]):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, 1):
                    names = [_named(canonical(t), bits, shared) for t in part.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string())], ["doc_id", "fingerprint"])

        return rows.mapInArrow(work, f"doc_id {kind}, fingerprint string")

    found = write_table(run(frozenset()), "fingerprints")
    shared = shared_digests(docs, found.select(F.col("fingerprint").alias("digest")), text_col, bits)
    return run(shared) if shared else found


def groups(prints: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(fingerprint, n, first_id): each group of equal canonical texts, its size and smallest id."""
    return prints.groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(col(id_col)).alias("first_id"))


def with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 128) -> DataFrame:
    """How a fingerprint takes an edit: a row for each row of docs, whose ids are whole numbers.

    A text's last floor(n_chars / 3) code points are replaced by the first as many, or all, of the next row's text,
    by descending id; the first row follows the last. (doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next); the last two are 1 where canonical texts are equal byte by byte, and
    0 elsewhere. Rows of one id follow each other by a hash of their text; null ids come after all others. A null
    text is empty. Other columns are ignored.

    Rows are dealt to ranges of ids and sorted there. A range also gets the first row of the range after it. An id of
    more rows than a range has is cut into ranges by the hash of its texts; rows equal in both stay together.
    """
    found = write_table(_edits(docs, id_col, text_col, bits, frozenset()), "edits")
    shared = shared_digests(docs, found.select(F.col("fingerprint").alias("digest")), text_col, bits)
    return _edits(docs, id_col, text_col, bits, shared) if shared else found


def _edits(docs: DataFrame, id_col: str, text_col: str, bits: int, shared: frozenset[str]) -> DataFrame:
    lowest = np.iinfo(np.int64).min
    key = F.coalesce(col(id_col).cast("long"), F.lit(int(lowest))).alias("k")
    ids = docs.select(key)
    total = ids.count()
    n = max(1, min(MAX_RANGES, math.ceil(total / RANGE_ROWS)))
    keys = ids.where(F.rand(0) < RANGE_KEYS * n / total).toArrow().column(0).to_numpy() if n > 1 else np.empty(0, np.int64)  # some RANGE_KEYS * n
    ranges = _Ranges(np.sort(keys)[np.arange(1, n) * len(keys) // n] if len(keys) else keys)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, tuple[int, int]] = {}  # the first row of each range: by descending key, then by tie
        for batch in batches:
            keys = batch.column(0).to_numpy()
            ties = np.zeros(len(keys), np.int64)
            if len(ranges.hot):
                some = np.flatnonzero(np.isin(keys, ranges.hot))
                ties[some] = [_tie((t or "").encode()) for t in batch.column(1).take(pa.array(some)).to_pylist()]
            where = ranges.of(keys, ties)
            order = np.lexsort((ties, -1 - keys, where))  # -1 - k turns the order of all 64-bit numbers round
            for i in order[np.flatnonzero(np.diff(where[order], prepend=-1))].tolist():
                b, row = int(where[i]), (-1 - int(keys[i]), int(ties[i]))
                least[b] = min(row, least.get(b, row))
        yield pa.RecordBatch.from_arrays([pa.array(least.keys(), pa.int32()), pa.array([x for x, _ in least.values()], pa.int64()), pa.array([x for _, x in least.values()], pa.int64())], ["b", "back", "tie"])

    keyed = docs.select(key, col(text_col)) if len(ranges.hot) else ids
    heads = keyed.mapInArrow(first, "b int, back long, tie long").groupBy("b").agg(F.min(F.struct("back", "tie")).alias("x")).collect()  # a row for each range
    heads = {r.b: (-1 - r.x.back, r.x.tie) for r in heads}
    order = sorted(heads)
    before = {b: order[i - 1] for i, b in enumerate(order)}  # the range that also gets a range's first row
    head_key, head_tie, head_hot = np.zeros(ranges.n, np.int64), np.zeros(ranges.n, np.int64), np.zeros(ranges.n, bool)
    for b, (k, tie) in heads.items():
        head_key[b], head_tie[b] = k, tie
    head_hot[order] = np.isin(head_key[order], ranges.hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        packer, sent = zstandard.ZstdCompressor(level=3), set()
        for batch in batches:
            for part in slices(batch, 1):
                keys = part.column(0).to_numpy()
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                tie = np.array([*map(_tie, raw)], np.int64)
                body = [packer.compress(t) for t in raw]
                where = ranges.of(keys, tie)
                hot = head_hot[where]
                twice = []
                for i in np.flatnonzero((keys == head_key[where]) & (~hot | (tie == head_tie[where]))).tolist():
                    if not hot[i] or where[i] not in sent:  # rows equal in id and text are one as a first row
                        sent.add(where[i])
                        twice.append(i)
                take = [*range(len(raw)), *twice]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([*where.tolist(), *(before[int(where[i])] for i in twice)], pa.int32()),
                        pa.array(np.arange(len(take)) >= len(raw)),
                        pa.array(keys[take], pa.int64()),
                        pa.array(tie[take], pa.int64()),
                        part.column(2).take(pa.array(take)),
                        pa.array([body[i] for i in take], pa.binary()),
                    ],
                    ["b", "tail", "k", "tie", "no_id", "body"],
                )

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpacker, last = zstandard.ZstdDecompressor(), None
        for batch in batches:
            out: list[tuple] = []
            for b, tail, k, none, body in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), batch.column(5), strict=True):
                if last is not None and last[0] != b:
                    last = None
                if tail and last is None:
                    continue
                text = unpacker.decompress(body.as_py()).decode()
                canon = canonical(text)
                this = (b, None if none else k, text, canon, _named(canon, bits, shared))
                if last is not None:
                    out.append(_edited(last, this, bits, shared))
                last = None if tail else this
            names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            columns = [*zip(*out, strict=True)] or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.coalesce(col(id_col).cast("long"), F.lit(int(lowest))).alias("k"), col(text_col).alias("text"), col(id_col).isNull().alias("no_id"))
    dealt = rows.mapInArrow(deal, "b int, tail boolean, k long, tie long, no_id boolean, body binary")
    ranged = dealt.repartitionById(ranges.n, F.col("b")).sortWithinPartitions("b", "tail", F.desc("k"), "tie")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ranged.mapInArrow(edit, schema)


def _tie(body: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(body) >> 1


class _Ranges:
    """Ranges of rows by descending key, numbered from 0; a cut is the highest key of the range that it begins.

    A key that is several cuts has more rows than a range: it is cut into as many parts, and one more, by ties of 63 bits.
    """

    def __init__(self, cuts: np.ndarray):
        self.bounds, times = np.unique(cuts, return_counts=True)
        self.hot = self.bounds[times > 1]
        self.parts = np.append(np.where(times > 1, times + 1, 1), 1)
        self.added = np.append(np.cumsum((self.parts[:-1] - 1)[::-1])[::-1], 0)  # parts beyond the first of this key and all above
        self.n = int(self.parts.sum())

    def of(self, keys: np.ndarray, ties: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(self.bounds, keys, "left"), np.searchsorted(self.bounds, keys, "right")
        width = np.uint64(1 << 63) // self.parts[low].astype(np.uint64) + np.uint64(1)
        part = np.where(high > low, (ties.astype(np.uint64) // width).astype(np.int64), 0)
        return len(self.bounds) - low + self.added[high] + part


def _edited(this: tuple, after: tuple, bits: int, shared: frozenset[str]) -> tuple:
    _, key, text, canon, name = this
    k = len(text) // 3
    edited = text[: len(text) - k] + after[2][:k]
    canon_edited = canonical(edited)
    return (key, len(text), hashlib.sha256(edited.encode()).hexdigest(), name, _named(canon_edited, bits, shared), float(canon_edited == canon), float(after[3] == canon))
