"""Quality classifier with hierarchical empirical Bayes over hosts and paths.

A logistic model of words and form gives each document its evidence. Documents' evidence is averaged by host and by
path, and each average is shrunk: a path's towards its host's, a host's towards the mean of all. How much follows
from the data: the variance within sites against the variance between them (method of moments). A document's
log-odds then move by as much as its path's, without the document itself, differ from the mean of all.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import col, lowest, slices, write_table

#: Bound on the labelled documents that training takes, and the partitions that they are worked on in.
TRAIN_DOCS, TRAIN_PARTS = 6000, 8
#: Rows that labels may have for one document before fewer than TRAIN_DOCS are taken.
LABELS_OF_ONE = 4
#: Words that a model has at most, the least documents that hold one, and how far from chance it is (in deviations).
MAX_WORDS, LEAST_DOCS, LEAST_Z = 512, 8, 4.5
#: Bytes of the word beginnings that are features too, and log2 of the counters that choose among features.
STEMS, COUNTER_BITS = (4, 5, 6, 7, 8, 9), 22
BINS = 8
RIDGE = 1.0
#: From this quality, and below this toxicity, a document is kept.
KEEP_QUALITY, KEEP_TOXICITY = 0.5, 0.5
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or b in b"'-" else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def features_of(words: set[bytes]) -> set[bytes]:
    """The words, and beginnings of longer ones behind a mark: languages that inflect show a word in many forms."""
    return words | {b"^" + w[:n] for w in words for n in STEMS if len(w) > n}


def form_of(text: str, words: list[bytes]) -> list[float]:
    """How a text is built: size, repetition, word length, and shares of kinds of characters."""
    raw = text.encode()
    n, m = max(len(raw), 1), max(len(words), 1)
    tokens = raw.split()
    t = max(len(tokens), 1)
    lines = raw.split(b"\n")
    kept = lambda drop: len(raw.translate(None, drop))
    return [
        math.log(n),
        len({*words}) / m,
        len({*words}) / math.sqrt(m),
        sum(map(len, words)) / m,
        max(Counter(words).values(), default=0) / m,
        len({*lines}) / len(lines),
        n / len(lines),
        1 - kept(b"0123456789") / n,
        1 - kept(b"#$%&*|<>{}[]=_\\/~^@") / n,
        1 - kept(b"|") / n,
        1 - kept(b".,;:!?") / n,
        1 - kept(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ") / n,
        sum(not x[-1:].isalpha() and x[-1:] < b"\x80" for x in tokens) / t,
        len(tokens) / m,
    ]


@dataclass
class Model:
    """Log-odds: a weight for each word that a text has, and for the bin of each measure of its form."""

    words: dict[bytes, float]  # and word beginnings
    edges: np.ndarray  # (measures, BINS - 1)
    weights: np.ndarray  # (measures, BINS)
    bias: float

    def score(self, words: set[bytes], form: list[float]) -> float:
        bins = [int(np.searchsorted(e, x, "right")) for e, x in zip(self.edges, form, strict=True)]
        return self.bias + sum(map(self.words.__getitem__, self.words.keys() & features_of(words))) + float(self.weights[np.arange(len(bins)), bins].sum())


def place(feature: bytes) -> int:
    """The counter of a feature."""
    return zlib.crc32(feature) & ((1 << COUNTER_BITS) - 1)


def train(samples: list[tuple[set[bytes], list[float], int]], told: dict[int, float]) -> Model:
    """Ridge logistic regression by Newton's method on telling words and binned form.

    told has the places of telling features and how far from chance each is; samples have their features of these places.
    """
    y = np.array([s[2] for s in samples], float)
    known = {f for features, _, _ in samples for f in features if place(f) in told}
    chosen = sorted(known, key=lambda f: (-told[place(f)], f))[:MAX_WORDS]
    column = {f: k for k, f in enumerate(chosen)}
    form = np.array([s[1] for s in samples])
    edges = np.quantile(form, np.arange(1, BINS) / BINS, axis=0).T
    x = np.zeros((len(samples), len(chosen) + form.shape[1] * BINS + 1))
    for i, (features, _, _) in enumerate(samples):
        x[i, [column[f] for f in column.keys() & features]] = 1
    for j in range(form.shape[1]):
        x[np.arange(len(samples)), len(chosen) + j * BINS + np.searchsorted(edges[j], form[:, j], "right")] = 1
    x[:, -1] = 1
    penalty = np.full(x.shape[1], RIDGE)
    penalty[-1] = 1e-6
    b = np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * b)
        b += step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return Model(dict(zip(chosen, b[: len(chosen)].tolist(), strict=True)), edges, b[len(chosen) : -1].reshape(-1, BINS), float(b[-1]))


def telling(sample: DataFrame, names: list[str]) -> dict[str, dict[int, float] | None]:
    """For each label of names, the places of the MAX_WORDS most telling features of all words of sample, and how far from chance.

    None where all labels agree. Documents are counted by place on the executors.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, with_one = (np.zeros((len(names), 1 << COUNTER_BITS), np.int32) for _ in range(2))
        for batch in batches:
            for words, *labels in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                at = np.unique(np.fromiter(map(place, features_of({*words.split()})), np.int64))
                for k, y in enumerate(labels):
                    if y is not None:
                        held[k, at] += 1
                        with_one[k, at] += y
        used = np.flatnonzero(held.any(axis=0)).astype(np.int32)
        for i in range(0, len(used), 1 << 16):
            at = used[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(c[k, at]) for k in range(len(names)) for c in (held, with_one))], ["p", *(x for n in names for x in (f"h_{n}", f"o_{n}"))])

    sums = sample.agg(*(x for n in names for x in (F.count(n).alias(f"n_{n}"), F.sum(n).alias(f"s_{n}"), F.min(n).alias(f"a_{n}"), F.max(n).alias(f"b_{n}")))).first()
    schema = "p int, " + ", ".join(f"h_{n} int, o_{n} int" for n in names)
    counted = sample.select("w", *names).mapInArrow(count, schema).groupBy("p").agg(*(F.sum(x).alias(x) for n in names for x in (f"h_{n}", f"o_{n}")))
    counted = write_table(counted, "counters")
    out: dict[str, dict[int, float] | None] = {}
    for n in names:
        out[n] = None
        if sums[f"n_{n}"] and sums[f"a_{n}"] != sums[f"b_{n}"]:
            rate, held = sums[f"s_{n}"] / sums[f"n_{n}"], F.col(f"h_{n}")
            z = F.abs((F.col(f"o_{n}") - held * rate) / F.sqrt(held * rate * (1 - rate) + 1e-9))
            rows = counted.where(held >= LEAST_DOCS).select("p", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "p").limit(MAX_WORDS).collect()
            out[n] = {r.p: r.z for r in rows}
    return out


def features_at(sample: DataFrame, names: list[str], places: set[int]) -> DataFrame:
    """(features, form, the labels of names) for each row of sample, with its features of places."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[f for f in features_of({*w.split()}) if place(f) in places] for w in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.binary())), *batch.columns[1:]], ["features", *batch.schema.names[1:]])

    return sample.select("w", "form", *names).mapInArrow(pick, "features array<binary>, form array<double>, " + ", ".join(f"{n} int" for n in names))


def fit(docs: DataFrame, labels: DataFrame, targets: list[str], id_col: str = "doc_id", text_col: str = "text", max_docs: int = TRAIN_DOCS) -> dict[str, Model | None]:
    """A model of each target (0 or 1) in labels, from at most max_docs labelled documents, the lowest by a hash of the id.

    A model is None where all labels agree or there are none. A null label is left out; of labels of one document that
    disagree the larger counts.
    """
    label = [F.max(col(t)).alias(f"l{k}") for k, t in enumerate(targets)]
    share = 2 * max_docs * LABELS_OF_ONE / max(labels.count(), 1)
    ids = labels.where(col(id_col).isNotNull() & lowest(F.xxhash64(col(id_col)), share)).groupBy(col(id_col).alias("i")).agg(*label)
    ids = ids.orderBy(F.xxhash64("i"), "i").limit(max_docs)  # max_docs bounds what is broadcast

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                words = [words_of(t) for t in part.column(0).to_pylist()]
                form = [form_of(t, w) for t, w in zip(part.column(0).to_pylist(), words, strict=True)]
                own = [b" ".join(sorted({*w})) for w in words]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), pa.array(form, pa.list_(pa.float64())), *part.columns[1:]], ["w", "form", *part.schema.names[1:]])

    names = [f"l{k}" for k in range(len(targets))]
    texts = docs.where(col(text_col).isNotNull()).select(col(id_col).alias("id"), col(text_col).alias("text"))
    rows = texts.join(F.broadcast(ids), F.col("id") == F.col("i")).select("text", *(F.col(n).cast("int") for n in names))
    got = rows.mapInArrow(take, "w binary, form array<double>, " + ", ".join(f"{n} int" for n in names)).orderBy(F.xxhash64("w"), "w", *names).limit(2 * max_docs)
    sample = write_table(got.repartition(TRAIN_PARTS), "labelled")
    told = telling(sample, names)
    got = features_at(sample, names, {p for places in told.values() for p in places or ()}).toArrow()
    features = [{*f} for f in got.column("features").to_pylist()]
    form = got.column("form").to_pylist()
    out: dict[str, Model | None] = {}
    for t, n in zip(targets, names, strict=True):
        samples = [(w, f, y) for w, f, y in zip(features, form, got.column(n).to_pylist(), strict=True) if y is not None]
        out[t] = train(samples, told[n]) if told[n] is not None else None
    return out


def evidence(docs: DataFrame, models: dict[str, Model | None], keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """The columns of keep and the log-odds of each model for each row of docs; 0 without a model or a text."""
    rows = docs.select(col(text_col).alias("text"), *(c.alias(n) for n, c in keep.items()))
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema[1:]), *(f"{t} double" for t in models)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                scores: dict[str, list[float]] = {t: [] for t in models}
                for text in part.column(0).to_pylist():
                    words = words_of(text) if text else []
                    form = form_of(text, words) if text else []
                    own = {*words}
                    for t, m in models.items():
                        scores[t].append(m.score(own, form) if m and text else 0.0)
                yield pa.RecordBatch.from_arrays([*part.columns[1:], *(pa.array(s, pa.float64()) for s in scores.values())], [*part.schema.names[1:], *scores])

    return rows.mapInArrow(run, schema)


def _moments(sites: DataFrame, parent: Column) -> float:
    """The weight, in documents, of the level above: variance within sites by variance between them.

    Sites (n, s, q: number, sum and sum of squares) differ around the mean of their own parent, so that what parents
    differ in isn't counted again.
    """
    n, mean = F.col("n"), F.col("s") / F.col("n")
    sums = sites.groupBy(parent.alias("parent")).agg(F.sum(F.col("q") - F.col("s") * mean).alias("w"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * mean).alias("sm"), F.sum(n * n).alias("nn"), F.count("*").alias("k"))
    r = sums.agg(F.sum("w").alias("w"), F.sum("n").alias("n"), F.sum(F.col("sm") - F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum(F.col("n") - F.col("nn") / F.col("n")).alias("d"), F.sum("k").alias("k"), F.count("*").alias("h")).first()
    if not r.n or r.k == r.h or r.n == r.k or r.w <= 0 or r.d <= 0:
        return 1.0
    within = r.w / (r.n - r.k)
    between = (r.b - (r.k - r.h) * within) / r.d
    return max(1.0, within / max(between, 1e-6))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(1e-4)), F.lit(1 - 1e-4))


@dataclass
class Sites:
    """rows: (host, path, n, s, host_n, host_s, by_host, by_path), a row for each path; the mean of all and the weights."""

    rows: DataFrame
    prior: float
    k_host: float
    k_path: float

    def without(self, p: Column) -> Column:
        """What a path's probability would be without one of its documents, whose own is p."""
        by_host = (F.col("host_s") - p + self.k_host * self.prior) / (F.col("host_n") - 1 + self.k_host)
        return (F.col("s") - p + self.k_path * by_host) / (F.col("n") - 1 + self.k_path)


def posteriors(scored: DataFrame, target: str) -> Sites:
    """Shrunk mean probabilities of each path (by_path), towards those of its host (by_host), towards that of all.

    Three aggregates, each of sums that combine before the shuffle; hosts are aggregated from paths.
    """
    p = 1 / (1 + F.exp(-F.col(target)))
    paths = write_table(scored.select("host", "path", p.alias("p")).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    whole = hosts.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    prior = whole.s / whole.n if whole.n else 0.5
    k_host, k_path = _moments(hosts, F.lit(0)), _moments(paths, F.col("host"))
    above = hosts.select(F.col("host").alias("h"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    joined = paths.join(above, F.col("host").eqNullSafe(F.col("h")))
    by_host = (F.col("host_s") + k_host * prior) / (F.col("host_n") + k_host)
    rows = joined.withColumn("by_host", by_host).withColumn("by_path", (F.col("s") + k_path * F.col("by_host")) / (F.col("n") + k_path))
    return Sites(rows.select("host", "path", "n", "s", "host_n", "host_s", "by_host", "by_path"), prior, k_host, k_path)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_cols: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(doc_id, quality, toxicity, host_quality, path_quality, keep) for each row of docs.

    quality and toxicity are probabilities of the labels of these names, from the document's text and from the other
    documents of its path and host; host_quality and path_quality are of all documents there. keep: quality is KEEP_QUALITY or more and toxicity below KEEP_TOXICITY.

    A null or empty text has no evidence of its own (the log-odds of its site alone). A null host or path is a
    site like others. Without labels of both kinds a target has even odds. Null ids and repeated rows are kept. Other
    columns are ignored.
    """
    models = fit(docs, labels, ["quality", "toxic"], id_col, text_col)
    path = F.concat_ws("/", *(F.coalesce(col(c).cast("string"), F.lit("")) for c in path_cols))
    scored = write_table(evidence(docs, models, {"doc_id": col(id_col), "host": F.coalesce(col(host_col).cast("string"), F.lit("")), "path": path}, text_col), "evidence")
    found = scored
    for t in models:
        sites = posteriors(scored, t)
        own = 1 / (1 + F.exp(-F.col(t)))
        rows = sites.rows.withColumnsRenamed({"host": "h", "path": "p"})
        both = found.join(rows, (F.col("host") == F.col("h")) & (F.col("path") == F.col("p")))
        shown = 1 / (1 + F.exp(-(F.col(t) + _logit(_clipped(sites.without(own))) - _logit(_clipped(F.lit(sites.prior))))))
        found = both.select(*found.columns, shown.alias(f"{t}_shown"), F.col("by_host").alias(f"{t}_by_host"), F.col("by_path").alias(f"{t}_by_path"))
    out = found.select("doc_id", F.col("quality_shown").alias("quality"), F.col("toxic_shown").alias("toxicity"), F.col("quality_by_host").alias("host_quality"), F.col("quality_by_path").alias("path_quality"))
    return out.withColumn("keep", (F.col("quality") >= KEEP_QUALITY) & (F.col("toxicity") < KEEP_TOXICITY))
