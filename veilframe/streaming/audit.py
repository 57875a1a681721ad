"""The audit stream: events of requests and responses, counters, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REQUEST, RESPONSE = "→", "←"
SCHEMA = (
    "timestamp timestamp, provider string, path string, direction string, pii_count long, passthrough boolean, body_size long, model string, pii_types array<string>, "
    "status_code int, duration_ms long, streaming boolean, error string, upstream_error string"
)


def request_events(requests: DataFrame, timestamp, passthrough: bool = False, path_col: str = "path", body_col: str = "body") -> DataFrame:
    """Events (SCHEMA) of what sources.chat.pseudonymize_requests() gives, at a time column."""
    from veilframe.functions.validators import provider_of

    values = {
        "timestamp": timestamp,
        "provider": provider_of(F.col(path_col)),
        "path": F.col(path_col),
        "direction": F.lit(REQUEST),
        "pii_count": F.col("pii_count"),
        "passthrough": F.lit(passthrough),
        "body_size": F.octet_length(F.col(body_col)),
        "model": F.get_json_object(F.col(body_col), "$.model"),
        "pii_types": F.col("pii_types"),
    }
    named = [(x.split()[0], x.split()[1]) for x in SCHEMA.split(", ")]
    return requests.select(*(values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in named))


def status_class(status):
    return F.when(status.isNull(), "none").when(status < 300, "2xx").when(status == 429, "429").when(status < 500, "4xx").otherwise("5xx")


def counters(events: DataFrame) -> DataFrame:
    """(total_requests, total_pii): requests, and entities in all events."""
    return events.agg(F.count(F.when(F.col("direction") == REQUEST, 1)).alias("total_requests"), F.coalesce(F.sum(F.when(F.col("pii_count") > 0, F.col("pii_count"))), F.lit(0)).alias("total_pii"))


def newest(events: DataFrame, n: int = 200, order: tuple[str, ...] = ("timestamp",)) -> DataFrame:
    return events.orderBy(*(F.desc(c) for c in order)).limit(n)


def line(events: DataFrame) -> DataFrame:
    """events with line, as a console shows it."""
    time = F.coalesce(F.date_format("timestamp", "HH:mm:ss"), F.lit("??:??:??"))
    mode = F.when(F.col("passthrough"), "PASS").otherwise("PII")
    request = F.concat_ws(" ", F.lit(REQUEST), mode, "provider", "path", "model")
    response = F.concat_ws(" ", F.lit(RESPONSE), F.col("status_code").cast("string"), "provider", "path", F.concat(F.col("duration_ms").cast("string"), F.lit("ms")))
    failed = F.concat_ws(" ", F.lit("ERR"), "provider", "path", "error")
    return events.withColumn("line", F.concat(F.lit("["), time, F.lit("] "), F.when(F.col("error").isNotNull(), failed).when(F.col("direction") == REQUEST, request).otherwise(response)))


def windowed(events: DataFrame, ts_col: str, key_col: str, value_col: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, key, n, total) of tumbling windows; on a stream, events later than late are left out."""
    counted = events.withWatermark(ts_col, late).groupBy(F.window(ts_col, width), key_col).agg(F.count("*").alias("n"), F.sum(value_col).alias("total"))
    return counted.select(F.col("window.start").alias("window_start"), key_col, "n", "total")


def sessions(events: DataFrame, ts_col: str, key_col: str, gap: str = "30 minutes") -> DataFrame:
    """(key, session_start, session_end, n): events of a key no further apart than gap."""
    found = events.groupBy(F.session_window(ts_col, gap), key_col).agg(F.count("*").alias("n"))
    return found.select(key_col, F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")
