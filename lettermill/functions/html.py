"""Readable text of HTML, and the HTML page of a message."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lettermill.functions import text as TX
from lettermill.schema import HEADER_LABELS

# Elements whose text is not shown, and elements that start and end a line.
HIDDEN = {"style", "script", "head", "title", "noscript"}
BLOCK = {"address", "article", "aside", "blockquote", "br", "div", "footer", "h1", "h2", "h3", "h4", "h5", "h6", "header", "li", "main", "p", "pre", "section", "table", "tr"}

# what stands between a tag's name and its end; a quote counts only behind "=", and an open one is a plain character
_REST = r"(?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+"
#: One piece of markup: a comment, a raw element with all it holds, a tag, or a declaration.
_MARKUP = re.compile(
    rf"""<(?:
      !--.*?(?:-->|(?P<cut>\Z))
    | (?P<raw>script|style)(?=[\s/>]){_REST}(?<!/)>.*?(?:</(?P=raw)(?=[\s/>])[^>]*>|(?P<open>\Z))
    | (?P<end>/?)(?P<name>[a-z][^\s/>]*){_REST}>
    | [!?/][^>]*>
    )""",
    re.S | re.I | re.X,
)
_BLANKS = re.compile(r"[ \t\r\f\v]+")
_GAPS = re.compile(r"\n{3,}")


def html_text(value: str | None) -> str:
    """Visible text of a piece of HTML: one space between words, one blank line at most between lines.

    One scan over the pieces of markup; the state is how many hidden elements are open. An element that is
    never closed hides the rest; closing one that isn't open changes nothing. Null and '' give ''.
    """
    page = value or ""
    shown: list[str] = []
    hidden = at = 0
    # behind the last ">" no markup can end, so nothing there is looked at twice
    for mark in _MARKUP.finditer(page, 0, page.rfind(">") + 1):
        if not hidden and mark.start() > at:
            shown.append(html.unescape(page[at : mark.start()]))
        at = mark.end()
        if mark["cut"] is not None or mark["open"] is not None:
            hidden = 1  # to the end of the page
            break
        name = mark["name"]
        if name is None:
            continue
        name = name.lower()
        alone = page[at - 2] == "/"
        if name in BLOCK:
            shown.append("\n\n" if alone and not mark["end"] else "\n")
        elif name in HIDDEN and not (alone and not mark["end"]):
            hidden = max(0, hidden - 1) if mark["end"] else hidden + 1
    if not hidden:
        shown.append(html.unescape(page[at:]))
    lines = [_BLANKS.sub(" ", line).strip() for line in "".join(shown).splitlines()]
    return _GAPS.sub("\n\n", "\n".join(lines)).strip()


def html_to_text(c: Column) -> Column:
    """Column of visible texts. Runs in Python over Arrow batches: nesting and entities need a parser."""

    @F.pandas_udf("string")
    def convert(values: pd.Series) -> pd.Series:
        return values.map(html_text, na_action="ignore")

    return convert(c)


NO_BODY = "[No text body found]"
#: A page is the start, one entry per header, the middle, the body, and the end.
PAGE_START = (
    '<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><title>Message</title><style>'
    "@page { size: A4 portrait; margin: 2cm; } "
    ".fields dt { font-weight: bold; } .fields dd { margin: 0 0 4pt 12pt; word-break: break-word; } "
    ".body { border-top: 0.5pt solid black; padding-top: 8pt; white-space: pre-wrap; }"
    '</style></head><body><dl class="fields">'
)
PAGE_MIDDLE, PAGE_END = '</dl><div class="body">', "</div></body></html>"
ENTRY = ("<dt>", "</dt><dd>", "</dd>")


def message_page(headers: dict[str, str], body: str) -> str:
    """A page with the message's labelled headers and its body, everything escaped."""
    out = [PAGE_START]
    for label in HEADER_LABELS:
        out += [ENTRY[0], html.escape(label), ENTRY[1], html.escape(headers.get(label, "")), ENTRY[2]]
    return "".join([*out, PAGE_MIDDLE, html.escape(body or NO_BODY), PAGE_END])


def message_page_column(headers: dict[str, Column], body: Column) -> Column:
    """``message_page`` as an expression."""
    blank = F.lit("")
    entries = [F.concat(F.lit(ENTRY[0] + html.escape(label) + ENTRY[1]), TX.escape_html(TX.blank_if_null(headers.get(label, blank))), F.lit(ENTRY[2])) for label in HEADER_LABELS]
    shown = F.when(TX.blank_if_null(body) == "", NO_BODY).otherwise(body)
    return F.concat(F.lit(PAGE_START), *entries, F.lit(PAGE_MIDDLE), TX.escape_html(shown), F.lit(PAGE_END))
