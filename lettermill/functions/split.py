"""Quote-aware splitting of packed header fields into ordered items (problem 4).

A finite-state tokenizer walks a field once. A scanner hands it only the
characters that can change its state (quotes, brackets, delimiters), so plain
runs cost nothing. State: inside quotes or not, nesting depth of ``<>`` and
``()``, and the start of the current item. Delimiters count only outside quotes
at depth 0; a comma is weighed against its surroundings, since it also stands
inside unquoted names ("Last, First") and file names ("draft, v2.doc").
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lettermill.session import ship

ADDRESS_FIELDS = ("to", "cc", "bcc")
FILE_FIELDS = ("attachment_filenames",)
BLANKS = " \t\r\n"

_EVENT = re.compile(r'[",;|\n<>()\\:]')
_EXTENSION = re.compile(r"\.\w{1,8}$", re.ASCII)
_NAME_WORD = re.compile(r"[^\W\d_][\w'’.\-]*\Z")
_CASE_JOINT = re.compile(r"[a-zß-öø-ÿ][A-ZÀ-ÖØ-Þ]")
_AFTER_DASH = re.compile(r"\s+-\s+\S.*\Z", re.S)
_COMMENT = re.compile(r"\s*\([^()]*\)\s*\Z")
_INITIALS = re.compile(r"(?:\s+[^\W\d_]\.?)+\Z")
_GROUP = re.compile(r'[^"@<>,;:()]+:\Z')

#: Output of the splitting operator.
ITEM_SCHEMA = T.StructType([T.StructField("seq", T.LongType()), T.StructField("field", T.StringType()), T.StructField("pos", T.LongType()), T.StructField("item", T.StringType())])


def _closing(text: str, at: int, stop: int) -> int:
    """Index of the quote that closes the one at ``at``; -1 if it stays open."""
    i = at + 1
    while (i := text.find('"', i, stop)) >= 0:
        slashes = i
        while slashes > at + 1 and text[slashes - 1] == "\\":
            slashes -= 1
        if (i - slashes) % 2:
            i += 1
        elif text.startswith('""', i) and i + 1 < stop and text[i + 2 : i + 3] != "":
            # a doubled quote is one quote, unless the second opens nothing and a delimiter follows it
            i += 2
        elif text.startswith('""', i) and i + 1 < stop:
            return i + 1 if i > at + 1 else i
        else:
            return i
    return -1


def _one_name(text: str) -> bool:
    """A single plain word, as a family name, a given name or a legal form is."""
    return bool(_NAME_WORD.match(text)) and "_" not in text and not _CASE_JOINT.search(text)


def _comma_in_name(left: str, right: str) -> bool:
    """Whether the comma between two unquoted pieces belongs to one written name.

    ``left`` runs from the last delimiter to the comma, ``right`` to the next candidate. "Last, First" has one
    word before the comma, or one word after it once a department, a comment and initials are set aside. Two
    full names have neither.
    """
    left, right = left.strip(BLANKS), right.strip(BLANKS)
    if not left or not right or "," in left or any(c in left for c in '@<"') or right[0] == '"':
        return False
    name = right.split("<", 1)[0].strip(BLANKS)
    if not name or "@" in name:
        return False
    left = _COMMENT.sub("", left)
    name = _COMMENT.sub("", _AFTER_DASH.sub("", name))
    core = _INITIALS.sub("", name)
    if " - " in left:
        return False
    return _one_name(left) or len(left.split()) > 1 and _one_name(core)


def split_items(text: str | None, files: bool = False) -> list[str]:
    """Non-empty items of a field in order; quotes around a whole item are removed.

    ``files`` tells file-name lists from mailbox lists; they differ in what a comma means. Null and blank give
    no items, nor does an empty group ("undisclosed-recipients:;"). A quote that never closes is an ordinary
    character. The work is linear in the text's length.
    """
    if not text:
        return []
    spans, start, depth, i, n = [], 0, 0, 0, len(text)
    commas: list[int] = []
    brackets: list[str] = []

    def close(end: int) -> None:
        """Cut text[start:end] at those of its commas that divide items."""
        nonlocal start
        begin = start
        for k, at in enumerate(commas):
            nxt = commas[k + 1] if k + 1 < len(commas) else end
            if files:
                last = at
                while last > begin and text[last - 1] in BLANKS:
                    last -= 1
                tail = text[max(begin, last - 10) : last]  # an extension is no longer
                keep = not (not tail or tail[-1] == '"' or _EXTENSION.search(tail))
            else:
                keep = _comma_in_name(text[begin:at], text[at + 1 : nxt])
            if not keep:
                spans.append((begin, at))
                begin = at + 1
        spans.append((begin, end))
        commas.clear()
        start = end + 1

    open_until, unclosed, colon, shut = 0, set(), -1, {"<": -1, "(": -1}
    while m := _EVENT.search(text, i):
        at, c = m.start(), m.group()
        i = at + 1
        if c == '"':
            fresh = at == start or text[at - 1] in BLANKS or text[at - 1] in ",<("
            if fresh and at >= open_until:
                end = _closing(text, at, n)
                if end < 0:
                    open_until = n  # no later quote can close either
                else:
                    i = end + 1
        elif c == "\\":
            i = at + 2
        elif c in "<(":
            if not files and c not in unclosed:
                if shut[c] < i:
                    shut[c] = text.find(">" if c == "<" else ")", i)
                if shut[c] >= 0:
                    brackets.append(c)
                    depth += 1
                else:
                    unclosed.add(c)
        elif c in ">)":
            if brackets and brackets[-1] == ("<" if c == ">" else "("):
                brackets.pop()
                depth -= 1
        elif depth:
            if c == "\n" and text[i : i + 1] not in (" ", "\t"):
                depth = 0  # a line end closes what was left open
                brackets.clear()
                close(at)
        elif c == ":":
            if not files and colon < start and _GROUP.match(text[start:i].strip(BLANKS)):
                start = i
                commas.clear()
            colon = at
        elif c == ",":
            commas.append(at)
        elif c == "\n" and text[i : i + 1] in (" ", "\t") and not text[start:at].isspace() and at > start:
            continue  # a folded line goes on
        else:
            close(at)
    close(n)
    items = []
    for begin, end in spans:
        item = text[begin:end].strip(BLANKS)
        if len(item) > 1 and item[0] == '"' and _closing(item, 0, len(item)) == len(item) - 1:
            item = item[1:-1].replace('""', '"').strip(BLANKS)
        if item:
            items.append(item)
    return items


def _batches(fields: tuple[str, ...], least: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column("seq").to_pylist()
            seq_out, field_out, pos_out, item_out = [], [], [], []
            for field in fields:
                files = field in FILE_FIELDS
                for seq, text in zip(seqs, batch.column(field).to_pylist(), strict=True):
                    if text is None:
                        continue
                    items = split_items(text, files)
                    if len(items) >= least:
                        seq_out += [seq] * len(items)
                        field_out += [field] * len(items)
                        pos_out += range(1, len(items) + 1)
                        item_out += items
            yield pa.RecordBatch.from_arrays([pa.array(seq_out, pa.int64()), pa.array(field_out, pa.string()), pa.array(pos_out, pa.int64()), pa.array(item_out, pa.string())], names=["seq", "field", "pos", "item"])

    return run


def explode_items(rows: DataFrame, fields: tuple[str, ...] = ADDRESS_FIELDS + FILE_FIELDS, least: int = 1) -> DataFrame:
    """(seq, field, pos, item) of every field with at least ``least`` items.

    Only the named columns reach Python, and with ``least`` above 1 only fields that hold a delimiter. There is
    no shuffle. Null, empty and blank fields give no row; a repeated input row gives its items again; an empty
    table gives no rows; other columns are ignored.
    """
    pick: list[Column] = [F.col("seq").cast("long").alias("seq")]
    for f in fields:
        packed = F.col(f"`{f}`").rlike(r"[,;|\n]") if least > 1 else F.length(F.col(f"`{f}`")) > 0
        pick.append(F.when(packed, F.col(f"`{f}`")).alias(f))
    some = F.coalesce(*[F.col(f"`{f}`") for f in fields]).isNotNull()
    ship(rows.sparkSession)
    return rows.select(*pick).where(some).mapInArrow(_batches(tuple(fields), least), ITEM_SCHEMA)


def found(manifest: DataFrame) -> DataFrame:
    """p4_found: one row per item of every packed field."""
    return explode_items(manifest, least=2)
