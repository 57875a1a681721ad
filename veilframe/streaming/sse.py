"""Server-sent events of chat streams: parse and rebuild, with built-in expressions where these can."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DONE = "[DONE]"


def field(chunk: Column, name: str) -> Column:
    """The last value of a field of an event's lines; null if it has none."""
    found = F.filter(F.split(chunk, r"\r?\n"), lambda x: F.startswith(x, F.lit(f"{name}: ")))
    return F.trim(F.substring(F.try_element_at(found, F.lit(-1)), len(name) + 3, 1 << 30))


def parse(df: DataFrame, chunk_col: str = "chunk", provider_col: str = "provider") -> DataFrame:
    """df with event_type, data, text_delta and is_done, for events that have data; others are left out."""
    data = F.col("data")
    a = F.get_json_object(data, "$.delta.text")
    b = F.get_json_object(data, "$.choices[0].delta.content")
    rows = df.withColumn("event_type", field(F.col(chunk_col), "event")).withColumn("data", field(F.col(chunk_col), "data")).where("data IS NOT NULL")
    delta = F.when(data != DONE, F.when(F.col(provider_col) == "a", a).when(F.col(provider_col) == "b", b))
    return rows.withColumn("text_delta", delta).withColumn("is_done", data == DONE)


def set_delta(data: str, text: str, provider: str) -> str | None:
    """data with the delta's text replaced, where it has one; None if it isn't JSON."""
    try:
        root = json.loads(data)
    except ValueError:
        return None
    if provider == "a" and isinstance(root, dict) and isinstance(root.get("delta"), dict) and "text" in root["delta"]:
        root["delta"]["text"] = text
    if provider == "b":
        try:
            if "content" in root["choices"][0]["delta"]:
                root["choices"][0]["delta"]["content"] = text
        except (KeyError, IndexError, TypeError):
            pass
    return json.dumps(root, ensure_ascii=False, separators=(",", ":"))


def rebuild(df: DataFrame, text_col: str, provider_col: str = "provider") -> DataFrame:
    """df of parse() with chunk: the event with text_col as its delta."""

    @F.pandas_udf("string")
    def put(data: pd.Series, text: pd.Series, provider: pd.Series) -> pd.Series:
        return pd.Series([set_delta(d, t or "", p) for d, t, p in zip(data, text, provider, strict=True)], dtype=object)

    data = F.when(F.col("is_done"), F.col("data")).otherwise(put(F.col("data"), F.col(text_col), F.col(provider_col)))
    head = F.when(F.col("event_type").isNotNull(), F.concat(F.lit("event: "), F.col("event_type"), F.lit("\n"))).otherwise("")
    return df.withColumn("chunk", F.concat(head, F.lit("data: "), data, F.lit("\n\n")))


def split_events(df: DataFrame, bytes_col: str) -> DataFrame:
    """Events of raw text, a row each, from text that holds whole events; blank lines end an event."""
    return df.withColumn("chunk", F.explode(F.filter(F.split(F.col(bytes_col), r"\r?\n\r?\n"), lambda x: F.trim(x) != "")))
