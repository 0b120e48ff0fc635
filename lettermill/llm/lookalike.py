"""Text that looks alike but differs in its characters, brought to one form (problem 3).

The form is composed; presentation forms (full-width, ligatures, styled
letters) become the ordinary characters they stand for, every blank one plain
space, and default-ignorable characters go. A word that mixes scripts, or that
only look-alikes keep out of its neighbours' script, is put into the letters of
one script. Signs with a meaning of their own stay: superscripts, ordinals,
fractions, unit signs, emoji and what joins them.

``canonical`` keeps letter case, since it stands for the text as typed;
``comparison_key`` adds full case folding for comparing texts.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.llm import mojibake
from lettermill.session import ship

FIELDS = ("subject", "from")

# Letters of other scripts that look like Latin ones, each with the Latin letter below it.
_CYRILLIC = "АВЕКМНОРСТУХЅІЈԚԜаеорсухѕіјһԁԛԝӏ"
_CYRILLIC_LATIN = "ABEKMHOPCTYXSIJQWaeopcyxsijhdqwl"
_GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαγικνορυχϲϳ"
_GREEK_LATIN = "ABEZHIKMNOPTYXayikvopuxcj"
TO_LATIN = dict(zip(_CYRILLIC, _CYRILLIC_LATIN, strict=True)) | dict(zip(_GREEK, _GREEK_LATIN, strict=True))
LATIN_TO_CYRILLIC = {x: c for c, x in zip(_CYRILLIC, _CYRILLIC_LATIN, strict=True) if c not in "ԚԜһԁԛԝӏ"}
LATIN_TO_GREEK = {x: g for g, x in TO_LATIN.items() if g in _GREEK}
TO = {"Latin": TO_LATIN, "Cyrillic": LATIN_TO_CYRILLIC, "Greek": LATIN_TO_GREEK}

#: Characters that have no look of their own.
_IGNORABLE = "­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\U000e0000-\U000e0fff"
_INVISIBLE = re.compile(f"[{_IGNORABLE}]")
_EMOJI = r"[\U0001f000-\U0001faff←-⇿⌀-⏿①-➿⤀-⯿〰〽㊗㊙©®‼⁉™ℹ⃣#*0-9]"
_JOINS = re.compile(rf"(?<=[\U0001f000-\U0001faff☀-➿️])‍(?={_EMOJI})|(?<={_EMOJI})️|(?<=[\U0001f000-\U0001faff])[\U000e0020-\U000e007f]+|(?<=[؀-෿က-႟])[‌‍](?=[؀-෿က-႟])")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ͯ])*")
_OTHER_SCRIPT = re.compile("[\u0370-\u052f\u1f00-\u1fff]")
_SPECIAL = re.compile("[^\x00-\x7f]")


def script(c: str) -> str:
    """Latin, Greek, Cyrillic, or '' for any other character."""
    n = ord(c)
    if c.isascii():
        return "Latin" if c.isalpha() else ""
    if 0xC0 <= n <= 0x24F or 0x1E00 <= n <= 0x1EFF:
        return "Latin" if c.isalpha() else ""
    if 0x370 <= n <= 0x3FF or 0x1F00 <= n <= 0x1FFF:
        return "Greek" if c.isalpha() else ""
    if 0x400 <= n <= 0x52F:
        return "Cyrillic"
    return ""


# Signs with a meaning of their own that only compatibility makes letters: micro and ohm.
SIGNS = "\u00b5\u2126"


@lru_cache(maxsize=None)
def plain(c: str) -> str:
    """The ordinary form of one character: itself unless it is a presentation form or a blank."""
    if c == " " or c in SIGNS:
        return c
    kind = unicodedata.category(c)
    if kind == "Zs" or c in "  ⠀":
        return " "
    tag = unicodedata.decomposition(c)
    if tag.startswith(("<wide>", "<narrow>", "<font>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")):
        return unicodedata.normalize("NFKC", c)
    if tag.startswith("<compat>") and kind in ("Lu", "Ll", "Lt"):
        return unicodedata.normalize("NFKC", c)
    return c


def _strip_invisible(text: str) -> str:
    if not _INVISIBLE.search(text):
        return text
    kept = [m.span() for m in _JOINS.finditer(text)]
    if not kept:
        return _INVISIBLE.sub("", text)
    out, at = [], 0
    for begin, end in kept:
        out += [_INVISIBLE.sub("", text[at:begin]), text[begin:end]]
        at = end
    return "".join(out) + _INVISIBLE.sub("", text[at:])


def _foreign(word: str, target: str) -> str | None:
    """The word in the letters of ``target``; None if a letter has no counterpart there."""
    table, out = TO[target], []
    for c in word:
        s = script(c)
        if s in ("", target):
            out.append(c)
        elif c in table:
            out.append(table[c])
        elif target != "Latin" and s != "Latin" and TO_LATIN.get(c) in table:
            out.append(table[TO_LATIN[c]])
        elif len(parts := unicodedata.normalize("NFD", c)) > 1 and parts[0] in table:
            out.append(table[parts[0]] + parts[1:])
        else:
            return None
    return unicodedata.normalize("NFC", "".join(out))


def _one_script(text: str) -> str:
    """Every word in the letters of its own script."""
    if not _OTHER_SCRIPT.search(text):
        return text
    words = [(m.start(), m.end(), m.group(), {s for c in m.group() if (s := script(c))}) for m in _WORD.finditer(text)]
    # a script is at home in the text if a word of it has letters that look like no others
    home: dict[str, int] = {}
    for _, _, w, s in words:
        for name in s:
            own = [unicodedata.normalize("NFD", c)[0] for c in w if script(c) == name]
            strange = (c not in TO_LATIN for c in own) if name != "Latin" else (c not in LATIN_TO_CYRILLIC and c not in LATIN_TO_GREEK for c in own)
            home[name] = home.get(name, 0) + sum(strange)
    out, at = [], 0
    for begin, end, w, s in words:
        fit = None
        if len(s) > 1:
            options = {t: x for t in sorted(s, key=lambda t: (-sum(script(c) == t for c in w), t != "Latin")) if (x := _foreign(w, t)) is not None}
            if options:
                fit = max(options, key=lambda t: home.get(t, 0)) if len(options) > 1 else next(iter(options))
                fit = options[fit]
        elif s and s != {"Latin"} and not home.get(next(iter(s))) and home.get("Latin"):
            fit = _foreign(w, "Latin")
        elif s == {"Latin"} and not home.get("Latin") and home.get("Cyrillic") and len(w) > 1:
            fit = _foreign(w, "Cyrillic")
        if fit is not None and fit != w:
            out += [text[at:begin], fit]
            at = end
    return "".join(out) + text[at:]


def canonical(text: str) -> str:
    """``text`` in ordinary, composed characters."""
    if text.isascii():
        return text
    text = _strip_invisible(text)
    if _SPECIAL.search(text):
        text = "".join(map(plain, text))
        # composing must not turn a sign into a letter
        text = "Ω".join(unicodedata.normalize("NFC", p) for p in text.split("Ω"))
        text = _one_script(text)
    return text


def comparison_key(text: str) -> str:
    """Equal for texts that differ only in look or letter case."""
    return unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", canonical(text)).casefold())


#: What a value must hold to be looked at in Python: of the composed letters of Western languages only those
#: that ``canonical`` changes, and any character beyond them.
SUSPECT = "[" + "".join(f"\\x{{{n:04x}}}" for n in range(0x80, 0x250) if canonical(chr(n)) != chr(n)) + r"]|[^\x00-\x{024f}]"


def imitations(rows: DataFrame, fields: tuple[str, ...] = FIELDS, model: mojibake.Model | None = None) -> DataFrame:
    """(seq, field, canonical) of every value whose canonical form differs, unless it was decoded wrongly.

    ``model`` tells wrongly decoded values; it is learnt from ``rows`` if not given. Null, empty and ASCII
    values are no case; values are read whole, whatever their length. Repeated rows give their case again, an
    empty table none; other columns are ignored. Each distinct value of a batch is worked on once.
    """
    ship(rows.sparkSession)
    model = model or mojibake.learn(rows)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    suspect = [F.col(f"`{f}`").rlike(SUSPECT) for f in fields]
    pick = [F.when(x, F.col(f"`{f}`")).alias(f) for f, x in zip(fields, suspect, strict=True)]
    some = F.coalesce(*[F.when(x, F.lit(1)) for x in suspect]).isNotNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            seqs = batch.column("seq")
            for f in fields:
                coded = batch.column(f).dictionary_encode()
                forms = []
                for text in coded.dictionary.to_pylist():
                    c = canonical(text)
                    forms.append(c if c != text and m.repair(text) is None else None)
                taken = pa.array(forms, pa.string()).take(coded.indices)
                keep = taken.is_valid()
                n = taken.filter(keep)
                yield pa.RecordBatch.from_arrays([seqs.filter(keep), pa.array([f] * len(n), pa.string()), n], names=["seq", "field", "canonical"])

    return rows.where(some).select(F.col("seq").cast("long").alias("seq"), *pick).mapInArrow(run, "seq bigint, field string, canonical string")
