"""Best-fit packing of documents into training sequences of several permitted lengths.

Pieces are dealt by hash into groups of bounded size; within a group they are placed in order of decreasing length, each into the open sequence whose room is least among those that hold it. Where none does, a new sequence is opened; its size depends on the least permitted size that holds the piece, and these choices are optimised together: starting from the least sizes, one choice after another is changed while the whole group, packed so and its sequences shrunk, costs less. At the end each sequence shrinks to the least permitted size that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import written
from wayloom.llm.idstore import Encoder, text_slices

SIZES = (1024, 2048, 4096, 8192, 16384, 32768)
#: Pieces of a group on average.
GROUP_PIECES = 8192
#: Copies of one row that stay together; more go to several groups.
COPIES_TOGETHER = 64


def sequence_cost(size: int) -> float:
    """Cost of one sequence: its tokens, the attention between them, and a fixed part."""
    return size * (1 + size / 65536) + 32


def _place(order: list[int], lengths: list[int], sizes: Sequence[int], opening: Sequence[int]) -> tuple[list[int], list[int], list[int]]:
    """Of each length its sequence and offset, and how much each sequence holds. opening names, for each of sizes, the size to open for a piece that it is the least to hold."""
    where, offset = [0] * len(lengths), [0] * len(lengths)
    room_of: dict[int, list[int]] = {}
    rooms, used = 0, []
    for i in order:
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            stack = room_of[room]
            k = stack.pop()
            if not stack:
                rooms ^= 1 << room
        else:
            room = opening[bisect_left(sizes, n)]
            k = len(used)
            used.append(0)
        where[i], offset[i] = k, used[k]
        used[k] += n
        room -= n
        if room:
            stack = room_of.setdefault(room, [])
            if not stack:
                rooms |= 1 << room
            stack.append(k)
    return where, offset, used


def total_cost(used: Sequence[int], sizes: Sequence[int]) -> float:
    """Cost of sequences that hold so much, each shrunk to the least of the sorted sizes."""
    return float(sum(map(sequence_cost, np.array(sizes)[np.searchsorted(sizes, used)].tolist()))) if len(used) else 0.0


def best_openings(lengths: np.ndarray, sizes: Sequence[int] = SIZES, rounds: int = 3) -> tuple[list[int], float]:
    """The opening sizes found for lengths, one for each of the sorted sizes, and what the packing costs with them."""
    sizes, order, own = sorted(sizes), np.argsort(-lengths, kind="stable").tolist(), lengths.tolist()
    present = sorted(set(np.searchsorted(sizes, lengths).tolist()))
    opening = list(sizes)
    least = total_cost(_place(order, own, sizes, opening)[2], sizes)
    tried = {tuple(opening)}
    for _ in range(rounds):
        before = least
        for k in present:
            for size in sizes[k:]:
                other = [*opening[:k], size, *opening[k + 1 :]]
                if tuple(other) in tried:
                    continue
                tried.add(tuple(other))
                cost = total_cost(_place(order, own, sizes, other)[2], sizes)
                if cost < least:
                    opening, least = other, cost
        if least == before:
            break
    return opening, least


def pack(lengths: np.ndarray, sizes: Sequence[int] = SIZES, opening: Sequence[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each length (1 to the largest size): its sequence, its offset there, and the final size of that sequence; opening is that of best_openings.

    Ties in length keep the order given, ties in room the sequence that was last put to; the result depends on the order of lengths only.
    """
    sizes = sorted(sizes)
    opening = best_openings(lengths, sizes)[0] if opening is None else opening
    where, offset, used = _place(np.argsort(-lengths, kind="stable").tolist(), lengths.tolist(), sizes, opening)
    where = np.array(where, np.int64)
    final = np.array(sizes)[np.searchsorted(sizes, used)] if used else np.zeros(0, np.int64)
    return where, np.array(offset, np.int64), final[where]


def _packer(sizes: Sequence[int]):
    most = max(sizes)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("length", "ascending"), ("part", "ascending")])
        copies = table.column("copies").to_numpy()
        doc = table.column("doc_id").take(pa.array(np.repeat(np.arange(len(copies)), copies)))
        length = np.repeat(table.column("length").to_numpy(), copies)
        pieces = -(-length // most)
        owner = np.repeat(np.arange(len(length)), pieces)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        own = np.minimum(length[owner] - piece * most, most)
        where, offset, size = pack(own, sizes)
        group = int(table.column("group")[0].as_py()) if table.num_rows else 0
        return pa.table({
            "doc_id": doc.take(pa.array(owner)), "piece": pa.array(piece, pa.int64()), "piece_start": pa.array(piece * most, pa.int64()), "n_tokens": pa.array(own, pa.int64()),
            "sequence_id": pa.array(where + (group << 32), pa.int64()), "sequence_start": pa.array(offset, pa.int64()), "sequence_size": pa.array(size, pa.int64()),
        })

    return run


def byte_length(text: Column) -> Column:
    """Tokens of a byte-level tokenizer and one end token: UTF-8 bytes of text (null: 0) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def token_lengths(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, length long of each row: the ids of its text by a byte-level BPE file of the tokenizers library, there on every executor, and one for the end; a null text has the end only."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_lengths(tokenizer_path), "doc_id long, length long")


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for batch in batches:
            for part in text_slices(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder.counts(part.column(1)) + 1, pa.int64())], names=["doc_id", "length"])

    return run


def pack_documents(docs: DataFrame, length: Column | None = None, sizes: Sequence[int] = SIZES, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row for each piece: doc_id, piece, piece_start, n_tokens, sequence_id, sequence_start, sequence_size.

    length (a long column of docs, such as that of token_lengths; by default byte_length(text)) is cut into pieces of the largest size and a rest; null or lengths under 1 count as 1. Each row of docs is placed, repeated rows each on their own, rows with a null doc_id too. Other columns are ignored; an empty table returns no row.
    The number of groups follows the number of rows, so a task's memory doesn't; equal rows are counted first and dealt over groups, so that no key makes a group large.
    """
    length = byte_length(F.col("text")) if length is None else length
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.coalesce(length, F.lit(1)), F.lit(1)).cast("long").alias("length")), "lengths")
    same = rows.groupBy("doc_id", "length").agg(F.count("*").alias("n"))
    groups = max(1, -(-rows.count() // group_pieces))
    parts = same.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / COPIES_TOGETHER)))).select(
        "doc_id", "length", "part", F.least(F.lit(COPIES_TOGETHER), F.col("n") - F.col("part") * COPIES_TOGETHER).alias("copies"),
        F.pmod(F.xxhash64("doc_id", "length", "part"), F.lit(groups)).alias("group"),
    )
    schema = "doc_id long, piece long, piece_start long, n_tokens long, sequence_id long, sequence_start long, sequence_size long"
    return parts.groupBy("group").applyInArrow(_packer(sizes), schema)
