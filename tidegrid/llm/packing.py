"""Concatenate and cut: token streams of all documents, cut into fixed windows at offsets from two-pass prefix sums.

Pass 1 encodes each document once, keeps its ids in the shared folder and its place within its partition; the totals of the partitions (one number each)
are summed to the offset at which each partition starts. Pass 2 turns offsets into windows: no sort, no shuffle, no window function over all rows. A
boundary record (`pieces`) says which ids of which document lie where; padding occurs in the last window only, up to the next power of two or to the whole length.

Defined cases: null or empty text: just the closing id. Repeated rows, repeated or null doc_ids: streams of their own. No rows: no pieces. Only doc_id
and text are read. A text that holds the literal end-of-text marker is encoded by the tokenizer file itself, which knows that marker.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.common import chunks, staged, texts

LENGTH, CLOSING = 2048, 1
MARKER = "<|endoftext|>"


@functools.cache
def encoder(path: str):
    """tiktoken's encoder over the same vocabulary (file beside it with the ending .tiktoken): the same ids, several times faster."""
    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def reference_encoder(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str, path: str) -> np.ndarray:
    """The ids of a whole text, as the tokenizer file gives them without added special tokens."""
    if MARKER in text:
        return np.array(reference_encoder(path).encode(text, add_special_tokens=False).ids, np.uint32)
    return np.array(encoder(path).encode_ordinary(text), np.uint32)


def streams(docs: DataFrame, path: str, closing: int = CLOSING) -> DataFrame:
    """(part, start_in_part, doc_id, n_ids, ids): ids as little-endian uint32 bytes with the closing id; part and place are fixed once written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in chunks(whole):
                ids = [np.append(encode(x, path), np.uint32(closing)).astype("<u4") for x in texts(b.column("text"))]
                n = np.array([len(x) for x in ids], np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int64)), pa.array(starts), b.column("doc_id"), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())], ["part", "start_in_part", "doc_id", "n_ids", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "part long, start_in_part long, doc_id long, n_ids long, ids binary")


def placed(docs: DataFrame, path: str, closing: int = CLOSING) -> DataFrame:
    """streams with first: the ids of all documents before it."""
    kept = staged(streams(docs, path, closing), "streams")
    totals = sorted(kept.groupBy("part").agg(F.sum("n_ids").alias("n")).collect())  # one row for each partition of the input
    sums = np.concatenate(([0], np.cumsum([n for _, n in totals]))).tolist()
    offsets = docs.sparkSession.createDataFrame([(int(p), int(s)) for (p, _), s in zip(totals, sums, strict=False)], "part long, base long")
    return kept.join(F.broadcast(offsets), "part").select("doc_id", "n_ids", (F.col("base") + F.col("start_in_part")).alias("first"), "ids")


def pieces(docs: DataFrame, path: str, length: int = LENGTH, closing: int = CLOSING) -> DataFrame:
    """One row for each document and window: doc_id, start, length, doc_tokens, sequence_id, offset, ids (little-endian uint32), ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, first = (b.column(c).to_numpy(zero_copy_only=False) for c in ("n_ids", "first"))
            many = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), many)
            k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            window = first[row] // length + k
            start = np.maximum(window * length, first[row]) - first[row]
            size = np.minimum((window + 1) * length, first[row] + n[row]) - first[row] - start
            ids = b.column("ids").to_pylist()
            cut = [ids[r][4 * s : 4 * (s + z)] for r, s, z in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
            crc = np.array([zlib.crc32(x) for x in cut], np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *map(pa.array, (start, size, n[row], window, (first[row] + start) % length)), pa.array(cut, pa.binary()), pa.array(crc)], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids", "ids_crc32"])

    return placed(docs, path, closing).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary, ids_crc32 long")


def sequences(cut: DataFrame, length: int = LENGTH, pad: int = 0) -> DataFrame:
    """pieces -> one row for each window: sequence_id, n_ids, padded_to, ids (padded); a window has a bounded size, so grouping is safe."""
    whole = cut.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit("").cast("binary"), lambda acc, x: F.concat(acc, x["ids"]))
    to = F.least(F.lit(length), F.pow(F.lit(2), F.ceil(F.log2("n_ids"))).cast("long"))
    return whole.select("sequence_id", "n_ids", to.alias("padded_to"), F.concat(joined, F.repeat(F.lit(chr(pad)), (4 * (to - F.col("n_ids"))).cast("int")).cast("binary")).alias("ids"))
