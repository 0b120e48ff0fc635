"""Text decoded with the wrong character encoding: find it and restore it (problem 1).

Learning. Texts are reduced to templates (digits squashed) and grouped by
skeleton, the template without non-ASCII characters, and by where in it their
runs of non-ASCII characters stand. Every run is undone by every transformation;
where the outcome stands in the same place of another template of the group, the
pair is evidence for that transformation. So every pair is found by a join, and
none by comparing templates with each other. Transformations that explain enough
pairs are learnt.

Applying. Every text with non-ASCII characters is decoded piece by piece with
the learnt transformations. A piece is restored if that makes its characters
likelier, by a trigram model of the same corpus, in which damage is the rarer.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lettermill.functions.split import split_items
from lettermill.session import cut, ship

FIELDS = ("subject", "from", "attachment_filenames")
LOST = "�"

# Encodings a mail program may have written, and single-byte ones it may have been read as.
WRITTEN = ("utf-8", "cp1252", "cp1250", "cp1251", "koi8_r", "cp866", "iso8859_5", "mac_cyrillic", "cp437", "cp850", "mac_roman", "cp1253", "cp1254", "cp932", "euc_jp", "gbk", "big5", "euc_kr")
READ = ("latin_1", "cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1257", "cp437", "cp850", "cp852", "cp866", "mac_roman", "koi8_r", "iso8859_2", "iso8859_5", "iso8859_15", "mac_cyrillic")

#: Different run pairs that a transformation must explain, beyond those that better ones explain.
LEAST_PAIRS = 2
#: Size of the hashed trigram table, whatever the corpus.
TABLE = 1 << 18
#: Gain in log likelihood that a restored text needs.
LEAST_GAIN = 3.0
#: Share of a restored piece's trigrams that the corpus must show, and the gain per trigram.
LEAST_SEEN, LEAST_MEAN = 0.7, 0.5

_PIECE = re.compile(r'[^ \t\r\n"|;,<>]+')
_RUN = re.compile(r"[^\x00-\x7f]+")
_DIGITS = re.compile(r"[0-9]+")
_UNWRITTEN = re.compile(r"[^\x21-\x7e]+")
_UNFIT = re.compile("[\x00-\x1f\x7f-\x9f\ue000-\uf8ff\ufffd]")
_MIXED = re.compile("[A-Za-z][\u0370-\u052f]|[\u0370-\u052f][A-Za-z]")
Chain = tuple[tuple[str, str], ...]


@cache
def _reader(name: str) -> tuple[str, dict[str, int]]:
    """Characters of the 256 bytes in a single-byte encoding, and back; unassigned bytes read as C1 controls."""
    chars = [bytes([b]).decode(name, "replace") for b in range(256)]
    chars = [chr(b) if c == LOST else c for b, c in enumerate(chars)]
    return "".join(chars), {c: b for b, c in reversed(list(enumerate(chars)))}


def garble(text: str, chain: Chain) -> str | None:
    """``text`` written and misread along ``chain``; None if it can't be written so."""
    for written, read in chain:
        try:
            raw = text.encode(written) if written != "cp1252" else _write(text, "cp1252")
        except UnicodeEncodeError:
            return None
        text = raw.decode("latin_1").translate(_table(read))
    return text


@cache
def _table(name: str) -> dict[int, str]:
    return dict(enumerate(_reader(name)[0]))


def _write(text: str, name: str) -> bytes:
    back = _reader(name)[1]
    try:
        return bytes([back[c] for c in text])
    except KeyError as e:
        raise UnicodeEncodeError(name, text, 0, 1, "no such character") from e


def restore(text: str, chain: Chain) -> str | None:
    """The text before ``chain``; None if it can't have gone through it."""
    for written, read in reversed(chain):
        back = _reader(read)[1]
        try:
            raw = bytes([back[c] for c in text])
            text = raw.decode("latin_1").translate(_table("cp1252")) if written == "cp1252" else raw.decode(written)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


@cache
def all_chains() -> tuple[Chain, ...]:
    single = [((w, r),) for w in WRITTEN for r in READ if w != r and not (w == "cp1252" and r in ("latin_1", "iso8859_15", "cp1254"))]
    twice = [(("utf-8", a), ("utf-8", b)) for a in READ for b in READ]
    return tuple(single + twice)


def runs(template: str) -> tuple[dict[int, str], int]:
    """Runs of non-ASCII characters by the number of ASCII characters before them, blanks not counted."""
    out, at = {}, 0
    for m in re.finditer(r"[^\x00-\x7f]+|[\x21-\x7e]+", template):
        piece = m.group()
        if piece[0] > "\x7f":
            out[at] = out.get(at, "") + piece
        else:
            at += len(piece)
    return out, at


def origins(run: str) -> dict[str, list[int]]:
    """What a run may have been before each chain: earlier form to chain numbers."""
    return _origins(run) if len(run) <= 64 else _undo(run)


def _undo(run: str) -> dict[str, list[int]]:
    out: dict[str, list[int]] = {}
    for k, chain in enumerate(all_chains()):
        c = restore(run, chain)
        if c is not None and c != run and not c.isascii():
            out.setdefault(c, []).append(k)
    return {c: fit for c, ks in out.items() if (fit := [k for k in ks if garble(c, all_chains()[k]) == run])}


_origins = lru_cache(20_000)(_undo)


def _hash(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) & (TABLE - 1)


def trigrams(piece: str) -> list[int]:
    """Hashed trigrams of a piece that hold a non-ASCII character; letter case and digits don't count."""
    t = "\x02" + _DIGITS.sub("0", piece).lower() + "\x03"
    shape = "".join("U" if c.isupper() else "l" if c.islower() else "." for c in piece)
    grams = [_hash(t[i : i + 3]) for i in range(len(t) - 2) if not t[i : i + 3].isascii()]
    # capitals within a word tell damage too: they hash beside the letters
    grams += [_hash("\x04" + shape[i : i + 2] + t[i + 1 : i + 3]) for i in range(len(shape) - 1) if not t[i + 1 : i + 3].isascii()]
    return grams


@dataclass
class Model:
    """Learnt transformations and trigram counts; of a fixed size."""

    chains: list[Chain]
    log_counts: np.ndarray
    total: float
    memo: dict[str, tuple[str, float, int]] = field(default_factory=dict)

    def score(self, piece: str) -> tuple[list[int], float]:
        """(foreign trigrams, their log likelihood) of a piece."""
        grams = trigrams(piece)
        return grams, float(self.log_counts[grams].sum()) - self.total * len(grams) if grams else 0.0

    def gain(self, before: tuple[list[int], float], after: tuple[list[int], float], chain: Chain) -> float:
        """Gain in log likelihood; 0 if what comes out is mostly unseen or no likelier by the character.

        Bytes that form valid UTF-8 are no accident, so there the gain as a whole is enough.
        """
        old = set(before[0])
        new = [g for g in after[0] if g not in old]
        if sum(self.log_counts[g] > 0 for g in new) < LEAST_SEEN * len(new):
            return 0.0
        mean = lambda s: s[1] / len(s[0]) if s[0] else 0.0
        if chain[0][0] != "utf-8" and mean(after) < mean(before) + LEAST_MEAN:
            return 0.0
        return after[1] - before[1]

    def best(self, piece: str) -> tuple[str, float, int]:
        """(restored piece, gain, chain) of a piece; no gain if it is better left."""
        got = self.memo.get(piece)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            own = None
            got = (piece, 0.0, -1)
            for k, chain in enumerate(self.chains):
                c = restore(piece, chain)
                if c is None or not sensible(piece, c, chain):
                    continue
                if own is None:
                    own = self.score(piece)
                gain = self.gain(own, self.score(c), chain)
                if gain > got[1]:
                    got = (c, gain, k)
            if got[2] < 0:
                # part of a piece may be damaged: its runs one by one
                parts = _RUN.findall(piece)
                if len(parts) > 1:
                    whole, gain, k = piece, 0.0, -1
                    for run in set(parts):
                        for j, chain in enumerate(self.chains):
                            c = restore(run, chain)
                            if c is None or not sensible(run, c, chain):
                                continue
                            tried = whole.replace(run, c)
                            if _MIXED.search(tried):
                                continue
                            g = self.gain(self.score(whole), self.score(tried), chain)
                            if g > LEAST_GAIN:
                                whole, gain, k = tried, gain + g, j
                    if k >= 0:
                        got = (whole, gain, k)
            self.memo[piece] = got
        return got

    def repair(self, text: str) -> str | None:
        """The restored text, '' if characters were lost, None if the text is not damaged."""
        if text.isascii():
            return None
        if LOST in text:
            return ""
        pieces = [(m.start(), m.end(), m.group()) for m in _PIECE.finditer(text)]
        pieces = [p for p in pieces if not p[2].isascii()]
        total, chains = 0.0, {}
        for _, _, p in pieces:
            _, gain, k = self.best(p)
            total += gain
            if k >= 0:
                chains[k] = chains.get(k, 0.0) + gain
        if total < LEAST_GAIN:
            return None
        # one text was mostly misread in one way: a piece follows the text's main way unless its own is clearly better
        main = max(chains, key=lambda k: (chains[k], -k))
        out, at = [], 0
        for begin, end, p in pieces:
            c, gain, k = self.best(p)
            if k < 0 and self.chains[main][0][0] == "utf-8" and (other := restore(p, self.chains[main])) is not None:
                c, gain = other, 1.0  # bytes that form valid sequences are no accident beside others that do
            elif k >= 0 and k != main and (other := restore(p, self.chains[main])) is not None and other != p and self.gain(self.score(p), self.score(other), self.chains[main]) > gain - 2:
                c = other
            if gain > 0:
                out += [text[at:begin], c]
                at = end
        restored = "".join(out) + text[at:]
        return restored if restored != text else None


def sensible(before: str, after: str, chain: Chain) -> bool:
    """Whether a restored piece can be text at all: no controls, private characters or mixed scripts come out.

    A misreading between two single-byte encodings is not inferred from blanks and invisible characters, nor
    from letter case alone.
    """
    if after.lower() == before.lower() or _UNFIT.search(after) or _MIXED.search(after):
        return False
    return chain[0][0] == "utf-8" or not ("\xa0" in before or "\xad" in before)


def units(rows: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(unit) of every text with non-ASCII characters that holds no lost ones; file lists by item."""
    ship(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for f in batch.schema.names:
                for text in batch.column(f).to_pylist():
                    if text:
                        parts = split_items(text, True) if f == "attachment_filenames" else [text]
                        out += [_DIGITS.sub("0", p) for p in parts if not p.isascii()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["template"])

    pick = [F.when(damaged_or_foreign(f), F.col(f"`{f}`")).alias(f) for f in fields]
    some = F.coalesce(*[F.when(damaged_or_foreign(f), F.lit(1)) for f in fields]).isNotNull()
    return rows.where(some).select(*pick).mapInArrow(run, "template string")


def damaged_or_foreign(f: str) -> Column:
    c = F.col(f"`{f}`")
    return c.rlike(r"[^\x00-\x7f]") & ~c.contains(LOST)


def _place_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, list, list] = ([], [], [])
        for template, n in zip(batch.column("template").to_pylist(), batch.column("n").to_pylist(), strict=True):
            found = runs(template)[0]
            layout = " ".join(map(str, found))
            for at, run in found.items():
                out[0].append(f"{at} of {layout}")
                out[1].append(run)
                out[2].append(n)
        skeletons = pa.array([_UNWRITTEN.sub("", t) for t in batch.column("template").to_pylist() for _ in runs(t)[0]], pa.string())
        yield pa.RecordBatch.from_arrays([skeletons, pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64())], names=["skeleton", "place", "run", "n"])


def _undo_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        group, rare, count, run, chains = [], [], [], [], []
        for key, g, n in zip(batch.column("key").to_pylist(), batch.column("run").to_pylist(), batch.column("n").to_pylist(), strict=True):
            for c, fit in origins(g).items():
                group.append(key)
                rare.append(g)
                count.append(n)
                run.append(c)
                chains.append(fit)
        yield pa.RecordBatch.from_arrays([pa.array(group, pa.int64()), pa.array(rare, pa.string()), pa.array(count, pa.int64()), pa.array(run, pa.string()), pa.array(chains, pa.list_(pa.int64()))], names=["key", "g", "g_n", "run", "chains"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = np.zeros(TABLE, np.int64)
    for batch in batches:
        for template, n in zip(batch.column("template").to_pylist(), batch.column("n").to_pylist(), strict=True):
            for p in _PIECE.findall(template):
                if not p.isascii():
                    np.add.at(table, trigrams(p), n) if len(p) > 200 else _bump(table, trigrams(p), n)
    at = np.flatnonzero(table)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], names=["gram", "n"])


def _bump(table: np.ndarray, grams: list[int], n: int) -> None:
    for g in grams:
        table[g] += n


def learn(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> Model:
    """Transformations and trigrams of a corpus. The driver gets counts per chain and per hash value only."""
    templates = cut(units(rows, fields).groupBy("template").agg(F.count("*").alias("n")))
    placed = templates.mapInArrow(_place_runs, "skeleton string, place string, run string, n bigint")
    placed = cut(placed.groupBy(F.xxhash64("skeleton", "place").alias("key"), "run").agg(F.sum("n").alias("n")))
    undone = placed.mapInArrow(_undo_runs, "key bigint, g string, g_n bigint, run string, chains array<bigint>")
    # bytes that form valid UTF-8 tell the direction by themselves; else the rarer form is the damaged one
    utf8 = F.array(*[F.lit(k).cast("bigint") for k, chain in enumerate(all_chains()) if chain[0][0] == "utf-8"])
    fit = F.when(F.col("n") > F.col("g_n"), F.col("chains")).otherwise(F.array_intersect("chains", utf8))
    # of the forms in its place that a run may come from, the most frequent one is clean; the others are damaged in other ways
    pairs = undone.join(placed, ["key", "run"]).withColumn("chains", fit).where("size(chains) > 0").groupBy("key", "g").agg(F.max(F.struct("n", "run", "chains")).alias("best"))
    evidence = pairs.select("g", F.col("best.run").alias("c"), F.explode("best.chains").alias("chain")).distinct()
    sets = evidence.groupBy("g", "c").agg(F.array_sort(F.collect_set("chain")).alias("chains")).groupBy("chains").agg(F.count("*").alias("n")).collect()
    grams = templates.mapInArrow(_count_grams, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(TABLE)
    for g, n in grams:
        counts[g] += n
    return Model(choose([(tuple(s), n) for s, n in sets]), np.log(counts + 0.3).astype(np.float32), math.log(counts.sum() + 1))


def choose(explained: list[tuple[tuple[int, ...], int]]) -> list[Chain]:
    """The fewest chains that explain the pairs, best first; ``explained`` counts pairs by the chains that fit."""
    chains, left = all_chains(), dict(explained)
    out: list[Chain] = []
    while left:
        gain: dict[int, int] = {}
        for fit, n in left.items():
            for k in fit:
                gain[k] = gain.get(k, 0) + n
        k = min(gain, key=lambda k: (-gain[k], len(chains[k]), k))
        if gain[k] < LEAST_PAIRS:
            break
        out.append(chains[k])
        left = {fit: n for fit, n in left.items() if k not in fit}
    return out


def damaged_values(rows: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(seq, field, restored) of every value decoded wrongly as a whole or in part.

    ``restored`` is '' where the value holds U+FFFD. Null, empty and ASCII values are no case; values of any
    length are read whole. Repeated rows give their case again; an empty table, or one too small to learn
    any transformation from, gives only the cases with U+FFFD. Of transformations that fit equally the
    shorter and earlier listed counts. Other columns are ignored.
    """
    model = learn(rows, fields)
    foreign = [F.col(f"`{f}`").rlike(r"[^\x00-\x7f]") for f in fields]
    pick = [F.when(x, F.col(f"`{f}`")).alias(f) for f, x in zip(fields, foreign, strict=True)]
    some = F.coalesce(*[F.when(x, F.lit(1)) for x in foreign]).isNotNull()
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            seqs = batch.column("seq").to_pylist()
            out: tuple[list, list, list] = ([], [], [])
            for f in fields:
                for seq, text in zip(seqs, batch.column(f).to_pylist(), strict=True):
                    if text and (r := m.repair(text)) is not None:
                        out[0].append(seq)
                        out[1].append(f)
                        out[2].append(r)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["seq", "field", "restored"])

    return rows.where(some).select(F.col("seq").cast("long").alias("seq"), *pick).mapInArrow(run, "seq bigint, field string, restored string")
