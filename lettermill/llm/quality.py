"""Text quality statistics and text types (problem 9).

A text falls into blocks, runs of lines between blank lines. Statistics of a
block pass thresholds, and each threshold is a noisy labelling function: it
votes "prose", "other" or nothing. How far each can be trusted is learnt from
how they agree over the whole corpus, by expectation-maximisation on the counts
of vote patterns; a block's type follows from its votes by the learnt weights.
A document's type is the one that holds most of its visible characters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lettermill.session import cut, ship

PROSE, OTHER, NONE = 0, 1, 2
#: The most common words that are sent to the workers; a longer list is an error, not cut short.
MOST_COMMON_WORDS = 200_000

_LINES = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]")
_QUOTE = re.compile(r"^(?:[ \t]*>)+[ \t]?")
_BULLET = re.compile(r"^\s*(?:[-*•·–+o]\s|\[[ xX]?\]\s|\(?\d{1,3}[.)]\s|\(?[a-zA-Z][.)]\s)")
_END = re.compile(r"[.!?…。！？][\"'”’»)\]]*\s*$")
_CELLS = re.compile(r"\t|\||(?<=\S) {2,}(?=\S)|[,;](?=[^\s\d])|[,;](?=\d)|[{}]")
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_CHUNK = re.compile(r"\S+")
_PLAIN = re.compile(r"[\"'“„«(¿¡\[]*[^\W\d_]+(?:['’\-][^\W\d_]+)*[.,;:!?…\"'”»)\]]*\Z")
_KANA = re.compile(r"[ぁ-ヿ㐀-鿿가-힯฀-๿]")
_DIGIT = re.compile(r"\d")
#: Neither letter, digit, space nor common punctuation.
_SYMBOL = re.compile("[^\\w\\s.,;:!?…\"'“”„«»‘’()¿¡\\-–—。、，！？「」・%&/]|_")
COUNTS = ("lines", "visible", "words", "letters", "common", "kana", "digits", "symbols", "ended", "bullets", "cells", "chunks", "plain", "run", "ends")

STATISTICS = ("n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "end_punctuation_share", "common_word_share", "bullet_share", "cell_share", "plain_run", "words_per_line")
#: (name, votes prose at, votes other at): a statistic on the prose side of the first votes prose, beyond the second other.
FUNCTIONS = (
    ("common_word_share", 0.16, 0.05),
    ("symbol_ratio", 0.03, 0.10),
    ("digit_ratio", 0.04, 0.12),
    ("mean_word_length", 8.5, 13.0),
    ("end_punctuation_share", 0.99, 0.01),
    ("bullet_share", -1.0, 0.40),
    ("cell_share", 0.20, 0.60),
    ("plain_run", 5.0, 3.0),
    ("words_per_line", 6.0, 4.5),
    ("plain_share", 0.85, 0.55),
)


def count(lines: list[str], common: frozenset[str]) -> dict[str, float]:
    """Counts over some non-blank lines; those of several blocks add up, the longest run aside."""
    text = " ".join(lines)
    words, chunks = _WORD.findall(text), _CHUNK.findall(text)
    run = best = plain = 0
    for c in chunks:
        if _PLAIN.match(c):
            run += 1
            plain += 1
        else:
            best, run = max(best, run), 0
    return {
        "lines": len(lines),
        "visible": sum(map(len, chunks)),
        "words": len(words),
        "letters": sum(map(len, words)),
        "common": sum(w in common for w in map(str.lower, words)),
        "kana": len(_KANA.findall(text)),
        "digits": len(_DIGIT.findall(text)),
        "symbols": len(_SYMBOL.findall(text)),
        "ended": sum(bool(_END.search(x)) for x in lines),
        "bullets": sum(bool(_BULLET.match(x)) for x in lines),
        "cells": sum(len(_CELLS.findall(x.strip())) >= 2 for x in lines),
        "chunks": len(chunks),
        "plain": plain,
        "run": max(best, run),
        "ends": int(bool(_END.search(lines[-1]))),
    }


def rates(c: dict[str, float]) -> dict[str, float]:
    """Statistics from counts."""
    visible, words, lines = max(1, c["visible"]), max(1, c["words"]), max(1, c["lines"])
    return {
        "n_words": c["words"],
        "mean_word_length": c["letters"] / words,
        "symbol_ratio": c["symbols"] / visible,
        "digit_ratio": c["digits"] / visible,
        "end_punctuation_share": c["ended"] / lines,
        "common_word_share": c["common"] / words,
        "bullet_share": c["bullets"] / lines,
        "cell_share": c["cells"] / lines,
        "plain_run": c["run"],
        "words_per_line": c["words"] / lines,
        "plain_share": c["plain"] / max(1, c["chunks"]),
        "kana_share": c["kana"] / visible,
        "visible": c["visible"],
        "ends": c["ends"],
    }


def vote(m: dict[str, float], lines: int) -> list[int]:
    """One vote per labelling function."""
    out = []
    spaceless = m["kana_share"] > 0.3  # a script without spaces has no words to count
    for name, prose, other in FUNCTIONS:
        x = m[name]
        if name in ("common_word_share", "mean_word_length", "plain_run", "words_per_line", "plain_share") and spaceless:
            v = NONE
        elif name in ("plain_run", "words_per_line") and lines == 1 and m["visible"] < 60:
            v = NONE  # a short note may be two words
        elif name == "common_word_share" and m["n_words"] < 6:
            v = PROSE if x >= prose else NONE
        elif name == "end_punctuation_share":
            # wrapped prose ends a sentence at its last line at least
            v = PROSE if m["ends"] else OTHER if x == 0 and lines > 1 else NONE
        elif prose > other:
            v = PROSE if x >= prose else OTHER if x <= other else NONE
        else:
            v = PROSE if x <= prose else OTHER if x >= other else NONE
        out.append(v)
    return out


def blocks(text: str) -> list[list[str]]:
    """Runs of non-blank lines, without marks of quotation."""
    out: list[list[str]] = [[]]
    for line in _LINES.split(text):
        line = _QUOTE.sub("", line)
        if not line.strip():
            if out[-1]:
                out.append([])
        elif out[-1] and bool(_BULLET.match(line)) != bool(_BULLET.match(out[-1][-1])) and not line.startswith((" ", "\t")):
            out.append([line])
        else:
            out[-1].append(line)
    return [b for b in out if b]


_STATS = "doc_id bigint, " + ", ".join(f"{s} double" for s in STATISTICS) + ", blocks array<struct<visible:int,votes:array<int>>>"


def _measure_batches(common: frozenset[str]) -> object:
    kinds = pa.list_(pa.struct([("visible", pa.int32()), ("votes", pa.list_(pa.int32()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats: list[list[float]] = [[] for _ in STATISTICS]
            voted = []
            for value in batch.column("text"):
                text = value.as_py() or ""
                own, whole = [], dict.fromkeys(COUNTS, 0)
                for b in blocks(text):
                    c = count(b, common)
                    own.append({"visible": c["visible"], "votes": [k * 3 + v for k, v in enumerate(vote(rates(c), len(b)))]})
                    for k, v in c.items():
                        whole[k] = max(whole[k], v) if k == "run" else whole[k] + v
                voted.append(own)
                whole = rates(whole)
                for k, s in enumerate(STATISTICS):
                    stats[k].append(float(whole[s]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(s, pa.float64()) for s in stats], pa.array(voted, kinds)], names=["doc_id", *STATISTICS, "blocks"])

    return run


def learn(patterns: list[tuple[list[int], int]], rounds: int = 100) -> tuple[float, np.ndarray]:
    """(bias, weight per vote) of the log odds of "other", from patterns of votes and how often each occurs.

    Votes are independent given the type. The start takes each function at its word a little; each round then
    weighs the patterns by their posterior and counts the votes anew. Nothing is labelled by hand.
    """
    k = len(FUNCTIONS)
    if not patterns:
        return 0.0, np.zeros(3 * k)
    votes = np.array([p for p, _ in patterns])
    n = np.array([c for _, c in patterns], float)
    weights = np.tile([-1.0, 1.0, 0.0], k)
    bias = 0.0
    for _ in range(rounds):
        other = 1 / (1 + np.exp(-np.clip(bias + weights[votes].sum(1), -30, 30)))
        tables = []
        for mass in (n * (1 - other), n * other):
            t = np.ones(3 * k)
            for j in range(votes.shape[1]):
                np.add.at(t, votes[:, j], mass)
            tables.append(t / t.reshape(k, 3).sum(1).repeat(3))
        new_bias = float(np.log(((n * other).sum() + 1) / ((n * (1 - other)).sum() + 1)))
        new = np.log(tables[1]) - np.log(tables[0])
        done = np.abs(new - weights).max() < 1e-6 and abs(new_bias - bias) < 1e-6
        weights, bias = new, new_bias
        if done:
            break
    return bias, weights


def text_types(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """Statistics and type of every document: ``doc_id``, the statistics, ``other_share``, ``text_type``.

    ``other_share`` is the part of the visible characters in blocks whose posterior type is not prose;
    ``text_type`` is 'prose', 'other' beyond half, or 'empty' for null, empty and blank texts. The whole text
    counts, whatever its length. Repeated rows give repeated results; with no rows at all, or none with text,
    nothing is learnt and nothing is 'other'. Equal odds count as prose. Other columns are ignored. What the
    driver gathers is the counts of vote patterns, at most three to the power of the number of functions.
    """
    spark = ship(docs.sparkSession)
    words = [r[0] for r in common_words.where("word is not null").select(F.lower("word")).distinct().limit(MOST_COMMON_WORDS + 1).collect()]
    if len(words) > MOST_COMMON_WORDS:
        raise ValueError("the list of common words is longer than MOST_COMMON_WORDS")
    del spark
    measured = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_measure_batches(frozenset(words)), _STATS))
    counted = measured.select(F.explode("blocks").alias("b")).groupBy("b.votes").agg(F.count("*").alias("n")).collect()
    bias, weights = learn(sorted((list(r[0]), r[1]) for r in counted))
    w = F.array(*[F.lit(float(x)) for x in weights])
    odds = lambda b: F.lit(bias) + F.aggregate(b["votes"], F.lit(0.0), lambda a, v: a + w[v])
    whole = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + b["visible"])
    apart = F.aggregate("blocks", F.lit(0).cast("long"), lambda a, b: a + F.when(odds(b) > 0, b["visible"]).otherwise(0))
    share = F.when(whole > 0, apart / whole).otherwise(F.lit(0.0))
    kind = F.when(whole == 0, "empty").when(share > 0.5, "other").otherwise("prose")
    return measured.withColumn("other_share", share).withColumn("text_type", kind).drop("blocks")


def found(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """p9_found: documents whose visible characters stand mostly outside running sentences."""
    return text_types(docs, common_words).where("text_type = 'other' and doc_id is not null").select("doc_id").distinct()
