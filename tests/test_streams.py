"""Events, the buffer, the stateful stream, the audit stream."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veilframe.operators import rewrite
from veilframe.streaming import audit, restore, sse

PAIRS = [("Odile", "Rosa"), ("Odile Brun", "Ines"), ("+33 6 00", "+33 1 99"), ("él", "x"), ("aa", "b")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="Odile Brun+360éa", max_size=60) | st.lists(st.sampled_from([*[p for p, _ in PAIRS], " ", "Od", "a"]), max_size=12).map("".join), st.lists(st.integers(0, 60), max_size=8))
def test_buffer_equals_the_whole_text(text, cuts):
    whole = rewrite.put(text, rewrite.leftmost_longest(text, rewrite._automaton(PAIRS)))
    buffer, out, at = restore.Buffer(PAIRS), [], 0
    for cut in [*sorted(c for c in cuts if c <= len(text)), len(text)]:
        out.append(buffer.push(text[at:cut]))
        at = cut
    assert "".join([*out, buffer.flush()]) == whole


def test_buffer_gives_early_and_without_mapping():
    assert restore.Buffer([]).push("at once") == "at once"
    buffer = restore.Buffer(PAIRS)
    assert len(buffer.push("x" * 100)) >= 80


def test_events(spark):
    a = 'event: content_block_delta\ndata: {"delta":{"text":"Bon"}}\n\n'
    b = 'data: {"choices":[{"delta":{"content":"jour"}}]}\n\n'
    rows = [(1, "a", a), (2, "b", b), (3, "a", "data: [DONE]\n\n"), (4, "a", "event: ping\n\n"), (5, "a", "data: garbage"), (6, "a", 'data: {"type":"stop"}'), (7, "a", "data: one\r\ndata: two")]
    parsed = {r.i: r for r in sse.parse(spark.createDataFrame(rows, "i int, provider string, chunk string")).collect()}
    assert {*parsed} == {1, 2, 3, 5, 6, 7}
    assert (parsed[1].event_type, parsed[1].text_delta) == ("content_block_delta", "Bon")
    assert parsed[2].text_delta == "jour"
    assert [parsed[i].text_delta for i in (3, 5, 6)] == [None] * 3
    assert parsed[3].is_done
    assert parsed[7].data == "two"
    assert json.loads(sse.set_delta('{"delta":{"text":"x","k":1}}', "é", "a")) == {"delta": {"text": "é", "k": 1}}
    assert sse.set_delta("garbage", "x", "a") is None
    from pyspark.sql import functions as F

    again = sse.rebuild(sse.parse(spark.createDataFrame(rows[:3], "i int, provider string, chunk string")).withColumn("new", F.lit("!")), "new")
    assert {r.i: r.chunk for r in again.collect()} == {1: 'event: content_block_delta\ndata: {"delta":{"text":"!"}}\n\n', 2: 'data: {"choices":[{"delta":{"content":"!"}}]}\n\n', 3: "data: [DONE]\n\n"}
    assert sse.split_events(spark.createDataFrame([(a + b,)], "raw string"), "raw").count() == 2


def test_stateful_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "stream_id long, seq long, text string, is_done boolean"
    batches = [[(1, 0, "say Odi", False), (2, 0, "a", False)], [(1, 1, "le Br", False), (2, 1, "a", True)], [(1, 2, "un!", True)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = restore.restore_stream(source, PAIRS).writeStream.format("memory").queryName("restored").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("SELECT * FROM restored ORDER BY stream_id, seq").collect()
    assert {i: "".join(r.text for r in rows if r.stream_id == i) for i in (1, 2)} == {1: "say Ines!", 2: "b"}
    assert [r.is_done for r in rows] == [False, False, True, False, True]


def test_audit(spark):
    row = lambda **k: tuple(k.get(c.split()[0]) for c in audit.SCHEMA.split(", "))
    from datetime import datetime

    t = datetime(2026, 1, 2, 3, 4, 5)
    events = spark.createDataFrame([row(timestamp=t, provider="a", path="/p", direction=audit.REQUEST, pii_count=3, passthrough=False, model="m"), row(timestamp=t, provider="a", path="/p", direction=audit.RESPONSE, pii_count=0, status_code=429, duration_ms=7), row(timestamp=t, provider="b", path="/q", direction=audit.RESPONSE, error="down")], audit.SCHEMA)
    assert tuple(audit.counters(events).first()) == (1, 3)
    assert audit.counters(events.limit(0)).first() == (0, 0)
    lines = [r.line for r in audit.line(events).collect()]
    assert lines[0].endswith("→ PII a /p m")
    assert lines[1].endswith("← 429 a /p 7ms")
    assert lines[2].endswith("ERR b /q down")
    assert [r.c for r in events.select(audit.status_class(events.status_code).alias("c")).collect()] == ["none", "429", "none"]
    assert audit.newest(events, 2).count() == 2
    with pytest.raises(Exception):  # noqa: B017
        audit.windowed(events, "nothing", "provider", "pii_count").count()
