"""Text of DOCX and PDF documents, from bytes in a column or from files."""

from __future__ import annotations

import base64
import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Media types, and the words that head the parts of an extracted text.
PDF = "application/pdf"
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
CONTENT, COMMENTS, METADATA = "[contenu]", "[commentaires]", "[métadonnées]"
FIELDS = {"creator": "auteur", "company": "société", "title": "titre", "subject": "sujet"}


def _paragraphs(xml: bytes) -> str:
    out = []
    for p in ElementTree.fromstring(xml).iter():
        if p.tag.endswith("}p"):
            runs = [t.text or "" for t in p.iter() if t.tag.endswith("}t")]
            if "".join(runs).strip():
                out.append("".join(runs))
    return "\n".join(out)


def docx_text(data: bytes) -> str | None:
    """Content, comments and properties of a DOCX, each under its head; None if it can't be read or has nothing."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            names = {*z.namelist()}
            read = lambda n: z.read(n) if n in names else None
            parts = [(head, _paragraphs(xml)) for head, xml in ((CONTENT, read("word/document.xml")), (COMMENTS, read("word/comments.xml"))) if xml]
            found = {}
            for name in ("docProps/core.xml", "docProps/app.xml"):
                for e in ElementTree.fromstring(read(name)).iter() if name in names else ():
                    if (key := FIELDS.get(e.tag.rpartition("}")[2].lower())) and (e.text or "").strip():
                        found[key] = e.text.strip()
    except (zipfile.BadZipFile, ElementTree.ParseError, KeyError, RuntimeError, zlib.error):
        return None
    parts.append((METADATA, "\n".join(f"{k}: {found[k]}" for k in FIELDS.values() if k in found)))
    return "\n\n".join(f"{head}\n{text}" for head, text in parts if text) or None


def _pdf_string(raw: bytes) -> str:
    simple = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
    body = re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else b"" if m[1].strip() == b"" else simple.get(m[1], m[1]), raw, flags=re.S)
    return body[2:].decode("utf-16-be", "replace") if body[:2] == b"\xfe\xff" else body.decode("latin-1")


_SHOWN = re.compile(rb"\[((?:\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|[^\]()<])*)\]\s*TJ|(\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(T\*|T[dDm]\b|\bET\b)", re.S)
_PIECE = re.compile(rb"\(((?:\\.|[^\\()])*)\)|<([0-9A-Fa-f\s]*)>", re.S)


def _shown(stream: bytes) -> str:
    """The strings that a content stream shows; moves to another line are line ends."""
    out: list[str] = []
    for m in _SHOWN.finditer(stream):
        if m[3]:
            if out and out[-1] != "\n":
                out.append("\n")
            continue
        for a, b in _PIECE.findall(m[1] if m[1] is not None else m[2]):
            out.append(_pdf_string(a) if a or not b else _pdf_string(bytes.fromhex(re.sub(rb"\s", b"", b).decode().ljust(2 * -(-len(re.sub(rb"\s", b"", b)) // 2), "0"))))
    return "".join(out).strip()


def pdf_text(data: bytes) -> str | None:
    """Properties and pages of a PDF of plain or deflated streams in simple encodings; None if nothing is found."""
    if not data.startswith(b"%PDF"):
        return None
    objects = {int(n): body for n, body in re.findall(rb"(\d+)\s+\d+\s+obj(.*?)endobj", data, re.S)}

    def stream(number: int) -> bytes:
        m = re.search(rb"(.*?)stream\r?\n(.*?)\r?\n?endstream", objects.get(number, b""), re.S)
        if not m:
            return b""
        try:
            return zlib.decompressobj().decompress(m[2]) if b"FlateDecode" in m[1] else m[2]
        except zlib.error:
            return b""

    pages = []
    for _, body in sorted(objects.items()):
        if re.search(rb"/Type\s*/Page\b", body) and (m := re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)):
            text = "\n".join(filter(None, (_shown(stream(int(n))) for n in re.findall(rb"(\d+)\s+\d+\s+R", m[1]))))
            pages.append(text)
    named = [(k, m) for k in ("Title", "Author", "Subject") if (m := re.search(rb"/" + k.encode() + rb"\s*\(((?:\\.|[^\\()])*)\)", data, re.S))]
    parts = [METADATA + "\n" + "\n".join(f"{k}: {_pdf_string(m[1])}" for k, m in named)] if named else []
    parts += [f"[page {i}]\n{text}" for i, text in enumerate(pages, 1) if text]
    return "\n\n".join(parts) or None


def document_text(data: bytes | None, media_type: str | None) -> str | None:
    """The text of a document, under a head that names its kind; None for other media types and what can't be read."""
    if data is None:
        return None
    if media_type == PDF:
        return f"[document PDF]\n{t}" if (t := pdf_text(data)) else None
    if media_type == DOCX:
        return f"[document DOCX]\n{t}" if (t := docx_text(data)) else None
    return None


def block_text(block: dict) -> str | None:
    """The text of a chat document block; its source must be base64."""
    source = block.get("source")
    if not isinstance(source, dict) or source.get("type") != "base64":
        return None
    try:
        return document_text(base64.b64decode(source.get("data") or "", validate=True), source.get("media_type"))
    except ValueError:
        return None


def extract_text(data: Column | str, media_type: Column | str) -> Column:
    """document_text() of columns."""

    @F.pandas_udf("string")
    def extract(data: pd.Series, media_type: pd.Series) -> pd.Series:
        return pd.Series([document_text(d, m) for d, m in zip(data, media_type, strict=True)], dtype=object)

    return extract(data, media_type)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of PDF and DOCX files."""
    kind = F.when(F.lower("path").endswith(".pdf"), PDF).when(F.lower("path").endswith(".docx"), DOCX)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(kind.isNotNull()).select("path", extract_text("content", kind).alias("text"))
