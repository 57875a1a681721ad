"""Pseudonyms that a stream's pieces may split, restored as the pieces come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilframe.operators import rewrite

OUTPUT = "stream_id long, seq long, text string, is_done boolean"


class Buffer:
    """Gives out what no later text can change: all but a tail that may be the beginning of a longer match.

    What comes out in all is what restoring the whole text at once gives, however the text is cut.
    """

    def __init__(self, pairs: list[tuple[str, str]], held: str = ""):
        self.automaton = rewrite._automaton(pairs)
        self.longest = max((len(p) for p, _ in pairs), default=0)
        self.held = held

    def push(self, text: str) -> str:
        self.held += text
        return self._give(max(0, len(self.held) - self.longest + 1) if self.longest else len(self.held))

    def flush(self) -> str:
        return self._give(len(self.held))

    def _give(self, safe: int) -> str:
        """A match that starts before safe has all of its text here, and so has any longer one from there."""
        spans, upto = [], safe
        for s, e, to in rewrite.leftmost_longest(self.held, self.automaton):
            if s >= safe:
                break
            spans.append((s, e, to))
            upto = max(upto, e)
        out = rewrite.put(self.held[:upto], spans)
        self.held = self.held[upto:]
        return out


def session_pairs(known: DataFrame) -> list[tuple[str, str]]:
    """The pairs of one session's mapping for restore_stream(), if they are few enough for each executor to hold.

    A larger mapping is for rewrite.restore(), in foreachBatch over streams that have ended.
    """
    from pyspark.sql import functions as F

    size = known.agg(F.sum(F.octet_length("pseudonym") + F.octet_length("original") + 64).alias("n")).first().n or 0
    if size > rewrite.AUTOMATON_BYTES:
        raise ValueError(f"a mapping of {size} bytes is too large to stream with; restore whole texts with rewrite.restore()")
    return [(r.pseudonym, r.original) for r in known.select("pseudonym", "original").collect()]


def restore_stream(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """A streaming frame (stream_id, seq, text, is_done) with pseudonyms of pairs restored; a flush comes before the end.

    pairs is one session's mapping, read once when the stream starts. The state of a stream is the text that is held
    back; streams reach a worker many to an Arrow batch.
    """
    held, cache = df.sparkSession.sparkContext.broadcast(pairs), {}  # session_pairs() bounds it

    def restored(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if "b" not in cache:
            cache["b"] = Buffer(held.value)
        buffer = cache["b"]
        buffer.held = state.get[0] if state.exists else ""
        rows = pd.concat(list(frames)).sort_values("seq")
        out = []
        for seq, text, done in zip(rows["seq"], rows["text"], rows["is_done"], strict=True):
            given = buffer.push(text if isinstance(text, str) else "")
            out.append((key[0], seq, given + buffer.flush() if done else given, bool(done)))
        if buffer.held:
            state.update((buffer.held,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["stream_id", "seq", "text", "is_done"])

    return df.groupBy("stream_id").applyInPandasWithState(restored, OUTPUT, "held string", "append", GroupStateTimeout.NoTimeout)
