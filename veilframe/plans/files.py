"""Small DOCX and PDF files of a text, for queries and tests."""

from __future__ import annotations

import io
import zipfile
import zlib
from xml.sax.saxutils import escape

NAMESPACE = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(text: str) -> bytes:
    """A DOCX of one paragraph."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{NAMESPACE}"><w:body><w:p><w:r><w:t>{escape(text)}</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def pdf(text: str) -> bytes:
    """A PDF of one page that shows a Latin-1 text, deflated."""
    shown = text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)")
    data = zlib.compress(f"BT /F1 12 Tf ({shown}) Tj ET".encode("latin-1"))
    page = b"10 0 obj << /Type /Page /Contents 11 0 R >> endobj\n"
    return b"%PDF-1.4\n" + page + f"11 0 obj << /Length {len(data)} /Filter /FlateDecode >>\nstream\n".encode() + data + b"\nendstream endobj\n"
