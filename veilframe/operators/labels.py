"""From token classifiers to entities: softmax, labels, runs of tokens, thresholds, segments."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.spans import let
from veilframe.functions.types import threshold, type_of_label

#: Characters of a segment, and how many two segments share.
SEGMENT, OVERLAP = 1536, 200


def softmax(logits: Column) -> Column:
    def shares(x: Column) -> Column:
        e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
        return let(e, lambda all_: F.transform(all_, lambda v: v / F.aggregate(all_, F.lit(0.0), lambda a, y: a + y)))

    return let(F.transform(logits, lambda v: v.cast("double")), shares)


def prediction(logits: Column) -> Column:
    """(label_id, confidence): the likeliest label, of equal ones the last."""

    def last_most(p: Column) -> Column:
        most = F.array_max(p)
        return F.struct((F.size(p) - F.array_position(F.reverse(p), most)).cast("int").alias("label_id"), most.alias("confidence"))

    return let(softmax(logits), last_most)


def label_map(config: str) -> list[str]:
    """Labels by id from the id2label of a model's JSON configuration; O where an id is missing."""
    named = {int(k): v for k, v in json.loads(config).get("id2label", {}).items()}
    return [named.get(i, "O") for i in range(max(named, default=-1) + 1)]


def decode(tokens: DataFrame, labels: list[str], id_col: str = "doc", text_col: str = "text", offset: Column | None = None) -> DataFrame:
    """(id, entity_type, value, start, end, confidence) from rows (id, text, offsets, preds).

    Tokens of one type in a row are one entity, a new B- doesn't start another; O and tokens of no width end it. Its
    confidence is the mean, which must reach the type's threshold. White space at its ends is left out.
    """
    names = F.array(*map(F.lit, labels)) if labels else F.array(F.lit("O"))
    offset = offset if offset is not None else F.lit(0)
    rows = tokens.select(id_col, text_col, offset.alias("base"), F.posexplode(F.arrays_zip("offsets", "preds")).alias("i", "t"))
    label = F.coalesce(F.try_element_at(names, F.col("t.preds.label_id") + 1), F.lit("O"))
    typed = rows.where("t.offsets IS NOT NULL AND t.preds IS NOT NULL").withColumn("type", F.when(F.col("t.offsets.s") != F.col("t.offsets.e"), type_of_label(label)))
    order = Window.partitionBy(id_col, "base").orderBy("i")
    starts = (~F.col("type").eqNullSafe(F.lag("type").over(order))).cast("int")
    runs = typed.withColumn("new", starts).withColumn("run", F.sum("new").over(order)).where("type IS NOT NULL")
    found = runs.groupBy(id_col, "base", "run", "type").agg(F.first(text_col).alias("text"), F.min("t.offsets.s").alias("s"), F.max("t.offsets.e").alias("e"), F.avg("t.preds.confidence").alias("confidence"))
    value = F.substring(F.col("text"), F.col("s") + 1, F.col("e") - F.col("s"))
    lead = F.length(value) - F.length(F.regexp_replace(value, r"^\s+", ""))
    trimmed = F.regexp_replace(value, r"^\s+|\s+$", "")
    kept = found.where(F.col("confidence") >= threshold(F.col("type"))).select(id_col, F.col("type").alias("entity_type"), trimmed.alias("value"), (F.col("s") + lead + F.col("base")).alias("start"), F.col("confidence"))
    return kept.where("value <> ''").select(id_col, "entity_type", "value", "start", (F.col("start") + F.length("value")).alias("end"), "confidence")


def merge_segments(found: DataFrame, id_col: str) -> DataFrame:
    """Entities of overlapping segments merged: of two that overlap the surer stays, of equal ones the first."""
    one = "struct<start:int,seg:int,end:int,entity_type:string,confidence:double>"
    rows = found.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("seg").cast("int").alias("seg"), F.col("end").cast("int").alias("end"), "entity_type", F.col("confidence").cast("double").alias("confidence")))).alias("all"))

    def step(kept: Column, x: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        apart = (F.size(kept) == 0) | (x["start"] >= last["end"])
        head = F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0)))
        return F.when(apart, F.concat(kept, F.array(x))).when(x["confidence"] > last["confidence"], F.concat(head, F.array(x))).otherwise(kept)

    merged = rows.select(id_col, F.explode(F.aggregate("all", F.array().cast(f"array<{one}>"), step)).alias("x"))
    return merged.select(id_col, "x.entity_type", "x.start", "x.end", "x.confidence")


def cut(text: str | None, size: int = SEGMENT, overlap: int = OVERLAP) -> list[tuple[int, str]]:
    """(offset, segment): segments end behind their last white space and begin overlap characters before that."""
    text = text or ""
    if len(text) <= size:
        return [(0, text)]
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            behind = max((i for i in range(end - 1, start - 1, -1) if text[i].isspace()), default=None) if not text[end - 1].isspace() else end - 1
            end = behind + 1 if behind is not None else end
        out.append((start, text[start:end]))
        if end >= len(text):
            break
        start = max(end - overlap if end > overlap else end, start + 1)
    return out


def segments(df: DataFrame, id_col: str, text_col: str = "text", size: int = SEGMENT, overlap: int = OVERLAP) -> DataFrame:
    """(id, seg, global_offset, segment) of texts for a model of limited length."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, k, at, piece) for i, t in zip(batch[id_col], batch[text_col], strict=True) for k, (at, piece) in enumerate(cut(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[id_col, "seg", "global_offset", "segment"])

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, seg int, global_offset int, segment string")
