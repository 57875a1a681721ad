"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are folded to 128 symbols. Filters of several widths slide over windows of fixed length, each filter's
largest response in a window is kept, and a softmax over these gives the window's language. A text's language
comes from all of its windows, each weighted by its bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import col, lowest, pieces, release_memory, slices

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
SYMBOLS = 128
#: Bound on the labelled rows that training takes; their texts are taken whole.
TRAIN_DOCS = 3000
#: Windows that training goes through at least, each of the sample's at least once.
TRAIN_STEPS = 60_000
UNDETERMINED = "und"
_BLOCK = 64
_LETTER = re.compile(r"[^\W\d_]")


def symbol_table() -> bytes:
    """Byte to symbol: letters in one case, a symbol each for space, digits and other ASCII, the rest by their bits."""
    table = bytearray(256)
    for b in range(256):
        c = chr(b).lower()
        if b >= 0xC0:
            table[b] = 96 + (b & 31)
        elif b >= 0x80:
            table[b] = 32 + (b & 63)
        elif "a" <= c <= "z":
            table[b] = ord(c) - ord("a") + 1
        elif c.isdigit():
            table[b] = 28
        elif not c.isspace() and b >= 32:
            table[b] = 29
    return bytes(table)


_TABLE = symbol_table()


@dataclass
class Network:
    langs: list[str]
    filters: list[np.ndarray]  # of each width: (width, SYMBOLS, FILTERS)
    bias: np.ndarray  # (all filters,)
    dense: np.ndarray  # (all filters, langs)
    dense_bias: np.ndarray

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """(n, WINDOW) symbols to (n, all filters) largest responses. Pairs of symbols are looked up at once."""
        out = np.empty((len(x), len(WIDTHS) * FILTERS), np.float32)
        pairs = self._pairs()
        for a in range(0, len(x), _BLOCK):
            part = x[a : a + _BLOCK].astype(np.int32)
            two = part[:, :-1] * SYMBOLS + part[:, 1:]
            for k, width in enumerate(WIDTHS):
                n = part.shape[1] - width + 1
                r = pairs[k][0][two[:, :n]]
                if width == 3:
                    r += self.filters[k][2][part[:, 2 : 2 + n]]
                elif width == 4:
                    r += pairs[k][1][two[:, 2 : 2 + n]]
                out[a : a + len(part), k * FILTERS : (k + 1) * FILTERS] = r.max(axis=1)
        return out

    def _pairs(self) -> list[list[np.ndarray]]:
        if getattr(self, "_cached", None) is None:
            join = lambda f, i: (f[i][:, None, :] + f[i + 1][None, :, :]).reshape(-1, FILTERS)
            self._cached = [[join(f, i) for i in range(0, w - 1, 2)] for f, w in zip(self.filters, WIDTHS, strict=True)]
        return self._cached

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(self.pooled(x) + self.bias, 0)
        z = h @ self.dense + self.dense_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def windows_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, the text each belongs to, and its bytes; the last window of a text is padded."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    buffer = b"".join([t.translate(_TABLE).ljust(int(n) * WINDOW, b"\0") for t, n in zip(texts, counts, strict=True)])
    x = np.frombuffer(buffer, np.uint8).reshape(-1, WINDOW)
    owner = np.repeat(np.arange(len(texts)), counts)
    size = np.full(len(x), WINDOW, np.float64)
    last = np.cumsum(counts)[counts > 0] - 1
    size[last] = [len(t) - (n - 1) * WINDOW for t, n in zip(texts, counts, strict=True) if n]
    return x, owner, size


def train(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = TRAIN_STEPS, seed: int = 7) -> Network:
    """Adam on the cross-entropy, languages weighted alike; the gradient reaches a filter where its response was largest."""
    rng = np.random.default_rng(seed)
    params = [rng.normal(0, 0.3, (w, SYMBOLS, FILTERS)).astype(np.float32) for w in WIDTHS]
    total = len(WIDTHS) * FILTERS
    params += [np.zeros(total, np.float32), rng.normal(0, 0.2, (total, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    weight = (len(y) / (len(langs) * np.maximum(np.bincount(y, minlength=len(langs)), 1))).astype(np.float32)
    step = 0
    for _ in range(max(1, -(-steps // len(y)))):
        order = rng.permutation(len(y))
        for a in range(0, len(y), _BLOCK):
            rows = order[a : a + _BLOCK]
            part, target = x[rows].astype(np.int64), y[rows]
            best, where = [], []
            for k, width in enumerate(WIDTHS):
                n = WINDOW - width + 1
                r = params[k][0][part[:, :n]]
                for j in range(1, width):
                    r += params[k][j][part[:, j : j + n]]
                at = r.argmax(axis=1)
                where.append(at)
                best.append(np.take_along_axis(r, at[:, None, :], axis=1)[:, 0, :])
            pre = np.concatenate(best, axis=1) + params[-3]
            h = np.maximum(pre, 0)
            z = h @ params[-2] + params[-1]
            z = np.exp(z - z.max(axis=1, keepdims=True))
            p = z / z.sum(axis=1, keepdims=True)
            p[np.arange(len(rows)), target] -= 1
            p *= (weight[target] / len(rows))[:, None]
            back = (p @ params[-2].T) * (pre > 0)
            grads = []
            for k, width in enumerate(WIDTHS):
                g = np.zeros_like(params[k])
                own = back[:, k * FILTERS : (k + 1) * FILTERS]
                f = np.broadcast_to(np.arange(FILTERS), own.shape)
                for j in range(width):
                    np.add.at(g[j], (np.take_along_axis(part, where[k] + j, axis=1), f), own)
                grads.append(g)
            grads += [back.sum(axis=0), h.T @ p, p.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                first[i] += 0.1 * (g - first[i])
                second[i] += 0.01 * (g * g - second[i])
                params[i] -= 0.01 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.99**step)) + 1e-7)
    return Network(langs, params[:-3], *params[-3:])


def held_out(id_column: Column) -> Column:
    """Whether crc32 of the id's decimal text leaves 2 by 4; never for a null id."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_docs: int = TRAIN_DOCS) -> Network | None:
    """Trains on at most max_docs labelled texts that aren't held out, the lowest by a hash of their id.

    All windows of a text are learned from, cut as they are for prediction. Texts without a letter, and windows without
    one, are left out. A language that no row of the sample has is never predicted. None where there is nothing to
    learn from.
    """
    text, hashed = col(text_col), F.xxhash64(col(id_col))
    known = docs.where(~held_out(col(id_col)) & col(lang_col).isNotNull() & (F.length(text) > 0))
    total = known.count()
    share = 2 * max_docs / max(total, 1)
    while True:
        rows = known.where(lowest(hashed, share)).select(hashed.alias("h"), col(id_col).alias("i"), col(lang_col).cast("string").alias("lang"), text.alias("t"))
        # ranked by hash and digest alone, so that no whole text is sorted
        first = rows.select("h", "i", "lang", F.xxhash64("t").alias("d")).orderBy("h", "i", "lang", "d").limit(max_docs).agg(F.max(F.struct("h", "d")).alias("m"), F.count("*").alias("n")).first()
        if first.n == max_docs or share >= 1:
            break
        share *= 4
    if not first.n:
        return None
    inside = F.struct("h", F.xxhash64("t").alias("d")) <= F.struct(F.lit(first.m.h).alias("h"), F.lit(first.m.d).alias("d"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                lang, windows = [], []
                for name, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    raw = t.encode()
                    own = [w for a in range(0, len(raw), WINDOW) if _LETTER.search((w := raw[a : a + WINDOW]).decode("utf-8", "ignore"))]
                    lang += [name] * len(own)
                    windows += own
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(windows, pa.binary())], ["lang", "w"])

    got = rows.where(inside).select("lang", "t").mapInArrow(cut, "lang string, w binary").orderBy("lang", "w").toArrow()  # of max_docs rows
    names = got.column("lang").to_pylist()
    langs = sorted({*names})
    if not langs:
        return None
    x, _, _ = windows_of(got.column("w").to_pylist())
    return train(x, np.array([*map({n: k for k, n in enumerate(langs)}.get, names)]), langs)


def classify(texts: list[str | None], network: Network | None) -> tuple[list[str], np.ndarray]:
    """Language and score of each text."""
    lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
    known = [i for i, t in enumerate(texts) if t and network is not None and _LETTER.search(t)]
    if known:
        x, owner, size = windows_of([texts[i].encode() for i in known])
        p = network.probabilities(x) * size[:, None]
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        p = np.add.reduceat(p, starts, axis=0) / np.add.reduceat(size, starts)[:, None]
        for i, k, s in zip(known, p.argmax(axis=1), p.max(axis=1), strict=True):
            lang[i], score[i] = network.langs[k], min(float(s), 1.0)
    return lang, score


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for each row of docs, from the whole text and nothing else.

    A null text, one without a letter, and any text where there is no network give `und` with score 0. Repeated
    rows are kept. Other columns are ignored.
    """
    schema = "doc_id {}, lang_pred string, score double".format(docs.select(col(id_col)).schema[0].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                lang, score = classify(part.column(1).to_pylist(), network)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])
        release_memory()

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, schema)


def with_letter(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter: those for which a network finds a language."""

    @F.arrow_udf("boolean")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([bool(t and _LETTER.search(t)) for t in batch.to_pylist()], pa.bool_())

    return docs.where(told(col(text_col)))


def annotate(docs: DataFrame, network: Network | None, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score, as predict() has them, in place of columns of these names."""

    @F.arrow_udf("lang_pred string, score double")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            values, lang, score = batch.to_pylist(), [], []
            for a, b in pieces([t or "" for t in values]):
                found = classify(values[a:b], network)
                lang += found[0]
                score += found[1].tolist()
            yield pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["lang_pred", "score"])
        release_memory()

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    return docs.withColumn("__told", told(col(text_col))).select(*map(col, kept), "__told.lang_pred", "__told.score")
