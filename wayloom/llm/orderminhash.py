"""Document fingerprints by Order MinHash (Marçais, DeBlasio, Pandey and Kingsford, 2019), which follow edit distance.

A text's k-mers of code points get their occurrence number, so that repeats count, and a hash. The hash range is parted into SLOTS equal parts, which stand for as many independent orders (one-permutation hashing); in each part the TUPLE least k-mers are chosen, put back in the order in which they stand in the text, and hashed together. Two texts are as alike as the share of slots with the same hash, of those that either fills: this falls when k-mers differ and also when equal k-mers change their order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import MIX_A, mix64, written

K, SLOTS, TUPLE = 8, 64, 2
#: Low bits of a packed k-mer that hold its place; the other bits hold its hash. Texts of 2^28 code points and more take 32 bits.
PLACE_BITS = 28
_EDGES = np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - SLOTS.bit_length() + 1)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def fingerprint(codes: np.ndarray) -> np.ndarray:
    """SLOTS 32-bit signatures, 0 where a slot has no k-mer. A text shorter than K is one k-mer; an empty one has none."""
    out = np.zeros(SLOTS, np.uint32)
    if not len(codes):
        return out
    h, step, factor = codes.astype(np.uint64), 1, int(MIX_A)
    if len(h) < K:
        h = np.array([np.bitwise_xor.reduce(mix64(h * MIX_A + np.arange(len(h), dtype=np.uint64)))])
    else:
        while step < K:
            h = h[:-step] * np.uint64(factor) + h[step:]
            factor, step = factor * factor % 2**64, step * 2
    place_bits = PLACE_BITS if len(h) <= 1 << PLACE_BITS else 32
    low = np.uint64((1 << place_bits) - 1)
    packed = np.sort((mix64(h) & ~low) | np.arange(len(h), dtype=np.uint64))
    own = packed & ~low
    again = own[1:] == own[:-1]
    if again.any():
        at = np.arange(len(own))
        begin = np.where(np.concatenate([[True], ~again]), at, 0)
        number = (at - np.maximum.accumulate(begin)).astype(np.uint64)
        packed = np.sort(np.where(number > 0, mix64(own + number) & ~low, own) | (packed & low))
    first = np.searchsorted(packed, _EDGES)
    size = np.diff(first, append=len(packed))
    filled = np.flatnonzero(size)
    chosen = first[filled][:, None] + np.minimum(np.arange(TUPLE), size[filled][:, None] - 1)
    least = packed[chosen]
    least = np.take_along_axis(least, np.argsort(least & low, axis=1, kind="stable"), axis=1) >> np.uint64(place_bits)
    sig = np.minimum(size[filled], TUPLE).astype(np.uint64)
    for t in range(TUPLE):
        sig = mix64(sig * MIX_A + least[:, t])
    out[filled] = (sig >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots among those that either fills; 1 for two empty texts."""
    some = (a | b) != 0
    return float(((a == b) & some).sum() / some.sum()) if some.any() else 1.0


def _text_of(sig: np.ndarray) -> str:
    return sig.astype(">u4").tobytes().hex()


def _row(doc_id, codes, text, sig, next_text, next_sig) -> tuple:
    n = len(codes)
    third = n // 3
    edited = text[: n - third] + next_text[:third]
    edited_sig = fingerprint(code_points(edited))
    return doc_id, n, hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), _text_of(sig), _text_of(edited_sig), likeness(sig, edited_sig), likeness(sig, next_sig)


_COLUMNS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _batch(rows: list[tuple], extra: list[tuple]) -> pa.RecordBatch:
    columns = [*_COLUMNS, ("part", pa.int32()), ("head", pa.string()), ("last", pa.string())]
    whole = [(*r, None, None, None) for r in rows] + extra
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in whole], kind) for k, (_, kind) in enumerate(columns)], names=[n for n, _ in columns])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with the next one of the task; then a row with the task's first text and last document, whose next one is in another task."""
    held, head = None, None
    part = TaskContext.get().partitionId()
    rows: list[tuple] = []
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            doc_id, text = doc_id.as_py(), text.as_py() or ""
            codes = code_points(text)
            sig = fingerprint(codes)
            if held is None:
                head = text
            else:
                rows.append(_row(*held, text, sig))
            held = (doc_id, codes, text, sig)
            if len(rows) >= 1000:
                yield _batch(rows, [])
                rows = []
    if held is not None:
        yield _batch(rows, [(held[0], len(held[1]), None, None, None, None, None, part, head, held[2])])


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, text, after in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            codes, follow = code_points(text), code_points(after)
            rows.append(_row(doc_id, codes, text, fingerprint(codes), after, fingerprint(follow)))
        yield _batch(rows, []).select([n for n, _ in _COLUMNS])


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id long, text string): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of the next document by descending doc_id; after the last comes the first. Null texts count as empty; a null doc_id comes last; rows with the same doc_id follow one another by the hash of their texts. A table of one row is its own next. Other columns are ignored.
    One shuffle deals the texts into ranges of doc_id; the first and last document of each range are joined afterwards, a row for each task.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    order = [F.desc_nulls_last("doc_id"), F.asc("tie")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    found = written(dealt.mapInArrow(_chain, f"{_SCHEMA}, part int, head string, last string"), "fingerprints")
    edges = found.where("part is not null").select("doc_id", "part", "head", "last")
    # the driver sees the numbers of the ranges that hold a row, one for each task
    parts = sorted(r["part"] for r in edges.select("part").collect())
    following = docs.sparkSession.createDataFrame(list(zip(parts, [*parts[1:], *parts[:1]], strict=True)), "part int, next int")
    heads = edges.select(F.col("part").alias("next"), F.col("head").alias("after"))
    after = edges.drop("head").join(F.broadcast(following), "part").join(heads, "next").select("doc_id", "last", "after")
    names = [n for n, _ in _COLUMNS]
    return found.where("part is null").select(*names).unionByName(after.mapInArrow(_joined, _SCHEMA))
