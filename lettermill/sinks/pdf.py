"""PDF files of messages. The built-in renderer needs no library; two others are used where installed."""

from __future__ import annotations

import os
import textwrap
import zlib
from typing import Any, Protocol

from lettermill.functions.html import NO_BODY, message_page
from lettermill.schema import HEADER_LABELS

WIDTH, HEIGHT, MARGIN, SIZE, LEADING = 595, 842, 45, 9, 12
COLUMNS = 100


class Renderer(Protocol):
    def __call__(self, path: str, headers: dict[str, str], body: str) -> None: ...


def _literal(text: str) -> bytes:
    raw = text.encode("cp1252", "replace")
    return b"(" + raw.replace(b"\\", rb"\\").replace(b"(", rb"\(").replace(b")", rb"\)") + b")"


def _lines(headers: dict[str, str], body: str) -> list[tuple[str, str]]:
    """(font, text) of every line; 'R' is a rule."""
    wrap = lambda t: textwrap.wrap(t, COLUMNS, break_long_words=True, drop_whitespace=False) or [""]
    out: list[tuple[str, str]] = []
    for label in HEADER_LABELS:
        value = " ".join(headers.get(label, "").replace("\r", "\n").replace("\t", "\n").split("\n")).strip()
        out.append(("B", f"{label}:"))
        out += [("N", line) for line in wrap(value or "[none]")]
    out.append(("R", ""))
    for line in (body or NO_BODY).expandtabs(4).split("\n"):
        out += [("N", part) for part in wrap(line)]
    return out


def write_plain_pdf(path: str, headers: dict[str, str], body: str) -> None:
    """A4 pages of labelled headers, a rule and the body's lines, as PDF 1.4 with the standard fonts."""
    lines = _lines(headers, body)
    each = (HEIGHT - 2 * MARGIN) // LEADING
    pages = [lines[k : k + each] for k in range(0, len(lines), each)]
    objects: list[bytes] = [b"<< /Type /Catalog /Pages 2 0 R >>", b""]
    objects += [b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>", b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica-Bold /Encoding /WinAnsiEncoding >>"]
    kids = []
    for page in pages:
        content, y = [], HEIGHT - MARGIN
        for font, text in page:
            y -= LEADING
            if font == "R":
                content.append(f"{MARGIN} {y + 4} m {WIDTH - MARGIN} {y + 4} l S".encode())
            else:
                content.append(b"BT /%s %d Tf %d %d Td %s Tj ET" % (b"F2" if font == "B" else b"F1", SIZE, MARGIN, y, _literal(text)))
        stream = zlib.compress(b"\n".join(content))
        objects.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(stream) + stream + b"\nendstream")
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Contents %d 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> >>" % (WIDTH, HEIGHT, len(objects)))
        kids.append(len(objects))
    objects[1] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    out, offsets = bytearray(b"%PDF-1.4\n"), []
    for k, o in enumerate(objects, 1):
        offsets.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (k, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % o for o in offsets)
    out += b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start)
    with open(path, "wb") as f:
        f.write(out)


def write_page_pdf(path: str, headers: dict[str, str], body: str) -> None:
    """The message's HTML page through an installed HTML renderer, with remote content refused."""
    from weasyprint import HTML  # type: ignore[import-not-found]

    def refuse(url: str, *_: Any, **__: Any) -> None:
        raise ValueError(f"remote content is not loaded: {url}")

    HTML(string=message_page(headers, body), base_url=os.path.dirname(path), url_fetcher=refuse).write_pdf(path)


RENDERERS: dict[str, Renderer] = {"fast": write_plain_pdf, "weasyprint": write_page_pdf}


def render(mode: str, path: str, headers: dict[str, str], body: str) -> None:
    """Write the PDF beside its place and move it there, so that a broken one is never taken for done."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    temp = f"{path}.tmp"
    try:
        RENDERERS[mode](temp, headers, body)
        os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.remove(temp)
