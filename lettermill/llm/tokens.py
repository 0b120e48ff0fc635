"""Encoding of a corpus with a public byte-pair vocabulary (problem 7)."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lettermill.llm.bpe import encoder, vocabulary_path
from lettermill.session import ship


def share_vocabulary(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file to all workers; returns the name they know it by."""
    ship(spark)
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def encode_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(doc_id, ids) of every row: the token ids of its whole text, without special tokens.

    Null and empty texts give an empty list. Texts may be of any length: the work is linear in it. Names of
    special tokens in a text are ordinary text. Repeated rows give repeated results, an empty table none;
    other columns, whatever their names, are ignored. Narrow: no shuffle.
    """
    name = share_vocabulary(docs.sparkSession, vocabulary or vocabulary_path())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for batch in batches:
            # some rows at a time: the ids of a batch of long texts would not fit a small worker
            ids, keys, flat, ends = batch.column("text"), batch.column("doc_id"), [], [0]
            begin = 0
            for k in range(batch.num_rows):
                value = ids[k].as_py()
                if value:
                    flat += enc.encode(value)
                ends.append(len(flat))
                if len(flat) > 2_000_000 or k + 1 == batch.num_rows:
                    values = pa.ListArray.from_arrays(pa.array(np.asarray(ends, np.int32)), pa.array(np.asarray(flat, np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(begin, k + 1 - begin), values], names=["doc_id", "ids"])
                    begin, flat, ends = k + 1, [], [0]

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id bigint, ids array<int>")


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """The ``keep`` columns and ``tokens``, the length in tokens of each whole text; 0 for null and empty."""
    name = share_vocabulary(docs.sparkSession, vocabulary or vocabulary_path())
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = slim.drop("__text").withColumn("tokens", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(SparkFiles.get(name))
        for batch in batches:
            sizes = [len(enc.encode(t)) if t else 0 for t in (x.as_py() for x in batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(keep))], pa.array(sizes, pa.int64())], names=[*keep, "tokens"])

    return slim.mapInArrow(run, schema)
