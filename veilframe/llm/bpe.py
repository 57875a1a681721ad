"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The library sees a text's UTF-8 bytes as printable stand-in characters, one for each byte. Decoding maps the
stand-ins back to bytes. A token may hold part of a character; bytes are joined before they are decoded as UTF-8.
"""

from __future__ import annotations

import codecs
import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veilframe.llm.common import CHUNK_CHARS, col, pieces, release_memory, slices


def byte_alphabet() -> dict[str, int]:
    """Stand-in character to byte. Printable Latin-1 bytes stand for themselves; the others follow from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = (b for b in range(256) if b not in plain)
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=4)
def load(path: str, pattern: str):
    """The tokenizer of a rank file (base64 token, rank): (tokenizers.Tokenizer, list of each id's bytes).

    The library wants merges: a token's last merge joins the two parts that merging by lower ranks leaves.
    """
    import base64

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    standin = {b: c for c, b in byte_alphabet().items()}
    shown = lambda token: "".join(map(standin.__getitem__, token))
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1:
            left, right = _parts(token, rank, ranks)
            merges.append((shown(left), shown(right)))
    model = models.BPE(vocab={shown(t): r for t, r in ranks.items()}, merges=merges, cache_capacity=1000, ignore_merges=True)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return tokenizer, table


def _parts(token: bytes, limit: int, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 2:
        best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], limit))
        if ranks.get(parts[best] + parts[best + 1], limit) >= limit:
            break
        parts[best : best + 2] = [parts[best] + parts[best + 1]]
    if len(parts) != 2:
        raise ValueError(f"token {token!r} is not the merge of two tokens of lower rank")
    return parts[0], parts[1]


class Encoder:
    """Encodes texts through the library, chunk by chunk, and remembers chunks that aren't long: a bounded number of bytes.

    A chunk begins at a space or line feed between two characters that aren't white space; no match of the usual
    patterns crosses such a place, as a match either has white space at its start alone or nothing but white space.
    Texts with white space beside white space are left in one piece.
    """

    CHUNKS, KEPT, LONGEST, BATCH_CHARS = 150_000, 40_000, 64, 1 << 17  # chunks that are remembered, and their characters
    _NEXT = re.compile(r"\s\s")
    _CUT = re.compile(r"(?=[ \n])")
    _TAIL = re.compile(r"(?<=[A-Za-z])[!-/:-@\[-`{-~]+\Z")  # a match ends between a letter and these
    _MARK = "\ue000"  # stands between chunks, where a text lacks it

    def __init__(self, path: str, pattern: str):
        self.tokenizer, _ = load(path, pattern)
        self.ids: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        ids = self.ids
        for a, b in pieces(texts, CHUNK_CHARS // 4):
            cut = [self._chunks(t) for t in texts[a:b]]
            new = {c for chunks in cut for c in chunks if c not in ids}
            longer = {c for c in new if len(c) > self.LONGEST}
            self._learn(new - longer)
            for i, chunks in enumerate(cut):
                if longer and any(c in longer for c in chunks):
                    yield np.concatenate([np.frombuffer(ids[c], np.int32) if c not in longer else self._once(c) for c in chunks])
                else:
                    yield np.frombuffer(b"".join(map(ids.__getitem__, chunks)), np.int32)
                cut[i] = None
            if len(ids) > self.CHUNKS:
                self.shrink()
                ids = self.ids

    def encode_with_offsets(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of each text the ids and (n, 2) their spans in characters; a token of part of a character spans it."""
        for a, b in pieces(texts, CHUNK_CHARS // 4):
            for e in self.tokenizer.encode_batch(texts[a:b], add_special_tokens=False):
                yield np.array(e.ids, np.int32), np.array(e.offsets, np.int32).reshape(-1, 2)

    def _once(self, text: str) -> np.ndarray:
        """The ids of a long chunk, which isn't remembered."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def shrink(self) -> None:
        """Forgets all but the chunks met first, which are the likeliest to come again."""
        self.ids = dict(islice(self.ids.items(), self.KEPT))

    def _learn(self, new: set[str]) -> None:
        tails = {c: m.start() for c in new if (m := self._TAIL.search(c))}
        parts = {x for c, at in tails.items() for x in (c[:at], c[at:])}
        whole = [c for c in (new - tails.keys()) | parts if c not in self.ids]
        for x, y in pieces(whole, self.BATCH_CHARS):
            for c, e in zip(whole[x:y], self.tokenizer.encode_batch_fast(whole[x:y], add_special_tokens=False), strict=True):
                self.ids[c] = array("i", e.ids).tobytes()
        for c, at in tails.items():
            self.ids[c] = self.ids[c[:at]] + self.ids[c[at:]]

    def _chunks(self, text: str) -> list[str]:
        if not text:
            return []
        if self._NEXT.search(text):
            return [text]
        if self._MARK in text:
            return [c for c in self._CUT.split(text) if c]
        mark = self._MARK
        chunks = text.replace(" ", mark + " ").replace("\n", mark + "\n").split(mark)
        return chunks if chunks[0] else chunks[1:]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def decode_ids(ids: Iterable[int], path: str, pattern: str) -> bytes:
    table = load(path, pattern)[1]
    return b"".join(map(table.__getitem__, ids))


def decode_stream(ids: Iterable[int], path: str, pattern: str) -> Iterator[str]:
    """A piece of text for each id: bytes of a split character are held back until the rest has come."""
    table, held = load(path, pattern)[1], codecs.getincrementaldecoder("utf-8")("replace")
    for i in ids:
        yield held.decode(table[i])
    yield held.decode(b"", True)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", offsets: bool = False, decoded: bool = False) -> DataFrame:
    """(doc_id, ids array<int>), and on request starts and ends array<int> and decoded binary, for each row.

    path is a rank file that every executor can open, pattern splits a text before merging. A null text is empty;
    an empty text has no ids. Repeated rows are kept. Other columns are ignored.
    """
    schema = "doc_id {}, ids array<int>".format(docs.select(col(id_col)).schema[0].dataType.simpleString())
    schema += ", starts array<int>, ends array<int>" * offsets + ", decoded binary" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lists(rows: list) -> pa.Array:
            ends = np.cumsum([0, *map(len, rows)], dtype=np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *(np.asarray(r, np.int32) for r in rows)])
            return pa.ListArray.from_arrays(ends, flat)

        for batch in batches:
            for part in slices(batch, 1):
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, spans, back = [], [], []
                coder = encoder(path, pattern)
                for one in coder.encode_with_offsets(texts) if offsets else coder.encode(texts):
                    i = one[0] if offsets else one
                    ids.append(i)
                    if offsets:
                        spans.append(one[1])
                    if decoded:
                        back.append(decode_ids(i.tolist(), path, pattern))
                columns = [part.column(0), lists(ids)]
                if offsets:
                    columns += [lists([s[:, 0] for s in spans]), lists([s[:, 1] for s in spans])]
                if decoded:
                    columns.append(pa.array(back, pa.binary()))
                names = ["doc_id", "ids", *["starts", "ends"] * offsets, *["decoded"] * decoded]
                yield pa.RecordBatch.from_arrays(columns, names)
        encoder(path, pattern).shrink()
        release_memory()

    return docs.select(col(id_col).alias("doc_id"), col(text_col).alias("text")).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, decoded binary, text string) of id lists; a null list is empty, invalid UTF-8 is replaced in text only."""
    schema = "doc_id {}, decoded binary, text string".format(tokens.select(col(id_col)).schema[0].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                back = [decode_ids(i or (), path, pattern) for i in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(back, pa.binary()), pa.array([b.decode("utf-8", "replace") for b in back], pa.string())], ["doc_id", "decoded", "text"])

    return tokens.select(col(id_col).alias("doc_id"), col(ids_col).alias("ids")).mapInArrow(run, schema)
