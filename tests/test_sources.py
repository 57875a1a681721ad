"""Chat bodies, DOCX and PDF."""

import base64
import io
import json
import zipfile
import zlib

import pytest

from veilframe.sources import chat, documents


def docx(body="", comments=None, core=None) -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        if comments:
            z.writestr("word/comments.xml", f"<w:comments {w}>{comments}</w:comments>")
        if core:
            z.writestr("docProps/core.xml", core)
    return out.getvalue()


def paragraph(*runs: str) -> str:
    return "<w:p>" + "".join(f"<w:r><w:t>{r}</w:t></w:r>" for r in runs) + "</w:p>"


def pdf(*pages: str, title: str | None = None, packed: bool = True) -> bytes:
    out = [b"%PDF-1.4\n"]
    for i, text in enumerate(pages):
        stream = ("BT /F1 12 Tf " + " T* ".join(f"({line}) Tj" for line in text.split("\n")) + " ET").encode("latin-1")
        data = zlib.compress(stream) if packed else stream
        out.append(f"{10 + 2 * i} 0 obj << /Type /Page /Contents {11 + 2 * i} 0 R >> endobj\n".encode())
        out.append(f"{11 + 2 * i} 0 obj << /Length {len(data)}{' /Filter /FlateDecode' if packed else ''} >>\nstream\n".encode() + data + b"\nendstream endobj\n")
    if title:
        out.append(f"1 0 obj << /Title ({title}) >> endobj\n".encode())
    return b"".join(out)


def test_docx():
    data = docx(paragraph("Ines Kl", "ar") + paragraph("a &amp;amp; b"), paragraph("noted"), '<c:p xmlns:c="c" xmlns:d="d"><d:creator>Ann</d:creator><d:title>Plan</d:title></c:p>')
    assert documents.docx_text(data) == "[contenu]\nInes Klar\na &amp; b\n\n[commentaires]\nnoted\n\n[métadonnées]\nauteur: Ann\ntitre: Plan"
    assert documents.docx_text(b"not a zip") is None
    assert documents.docx_text(docx()) is None


@pytest.mark.parametrize("packed", [True, False])
def test_pdf(packed):
    assert documents.pdf_text(pdf("call \\(me\\)\nnow", "", "two", title="T", packed=packed)) == "[métadonnées]\nTitle: T\n\n[page 1]\ncall (me)\nnow\n\n[page 3]\ntwo"
    assert documents.pdf_text(b"nothing") is None
    assert documents.pdf_text(pdf("")) is None


def test_files(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx(paragraph("hello")))
    (tmp_path / "b.pdf").write_bytes(pdf("there"))
    (tmp_path / "c.txt").write_text("x")
    found = {r.path.rpartition("/")[2]: r.text for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert found == {"a.docx": "[document DOCX]\n[contenu]\nhello", "b.pdf": "[document PDF]\n[page 1]\nthere"}


BODIES = [
    (1, "/v1/messages", {"system": "be kind", "messages": [{"role": "user", "content": "hi"}]}),
    (2, "/v1/messages", {"system": [{"type": "text", "text": "s0"}, {"x": 1}], "messages": [{"content": [{"type": "text", "text": "t"}, {"type": "image", "text": "no"}, {"type": "text"}]}]}),
    (3, "/v1/chat/completions", {"system": "ignored", "messages": [{"content": "yo"}, {"content": None}, {}]}),
    (4, "/v1/embeddings", {"input": "no field"}),
    (5, "/elsewhere", {"messages": [{"content": "x"}]}),
]


def requests(spark, more=()):
    return spark.createDataFrame([(i, p, json.dumps(b)) for i, p, b in BODIES] + [*more], "request_id long, path string, body string")


def test_text_fields(spark):
    rows = chat.text_fields(requests(spark, [(6, "/v1/messages", "not json"), (7, "/v1/messages", None)])).collect()
    assert sorted((r.request_id, r.field_ord, r.json_path, r.text) for r in rows) == [
        (1, 0, "system", "be kind"),
        (1, 1, "messages.0.content", "hi"),
        (2, 0, "system.0.text", "s0"),
        (2, 1, "messages.0.content.0.text", "t"),
        (3, 0, "messages.0.content", "yo"),
    ]


def test_set_paths_keeps_the_rest():
    body = '{"a":{"b":[1,{"c":"x"}]},"é":null}'
    assert chat.set_paths(body, ["a.b.1.c", "a.z", "q.0"], ["n", "no", "no"]) == '{"a":{"b":[1,{"c":"n"}]},"é":null}'
    assert chat.set_paths("nope", ["a"], ["b"]) == "nope"


def test_requests_and_responses(spark):
    data = base64.b64encode(docx(paragraph("mail lena@box.org"))).decode()
    block = {"type": "document", "source": {"type": "base64", "media_type": documents.DOCX, "data": data}}
    more = [
        (10, "/v1/messages", json.dumps({"model": "m", "keep": [1, None], "messages": [{"content": 'say "lena@box.org" and 10.0.0.1'}, {"content": [block]}]})),
        (11, "/v1/messages", "not json"),
        (12, "/v1/messages", json.dumps({"messages": [{"content": [block | {"source": {"type": "url"}}]}]})),
    ]
    out, known, bad = chat.pseudonymize_requests(requests(spark, more), salt="s")
    rows = {r.request_id: r for r in out.collect()}
    assert {r.request_id for r in bad.collect()} == {5, 11}
    assert (rows[10].pii_count, rows[10].pii_types) == (3, ["EMAIL:2", "IP_ADDRESS:1"])
    assert "lena@box.org" not in rows[10].body
    sent = json.loads(rows[10].body)
    assert (sent["model"], sent["keep"]) == ("m", [1, None])
    assert sent["messages"][1]["content"][0]["text"].startswith("[document DOCX]")
    assert rows[1].pii_count == 0
    assert json.loads(rows[12].body)["messages"][0]["content"][0]["type"] == "document"
    back = {r.request_id: json.loads(r.body) for r in chat.restore_responses(out.select("request_id", "body"), known).collect()}
    assert back[10]["messages"][0]["content"] == 'say "lena@box.org" and 10.0.0.1'


def test_passthrough_and_audit_events(spark):
    from pyspark.sql import functions as F

    from veilframe.streaming import audit

    same, known, bad = chat.pseudonymize_requests(requests(spark), passthrough=True)
    assert known is None
    assert {r.request_id for r in bad.collect()} == {5}
    assert {r.body for r in same.collect()} == {json.dumps(b) for i, _, b in BODIES if i != 5}
    out, _, _ = chat.pseudonymize_requests(requests(spark, [(10, "/v1/messages", '{"model":"m","messages":[{"content":"a@b.io"}]}')]))
    events = {r.path: r for r in audit.request_events(out.where("request_id = 10"), F.current_timestamp()).collect()}
    assert (events["/v1/messages"].pii_count, events["/v1/messages"].model, events["/v1/messages"].provider) == (1, "m", "a")
    assert [f.name for f in audit.request_events(out, F.current_timestamp()).schema] == [x.split()[0] for x in audit.SCHEMA.split(", ")]
