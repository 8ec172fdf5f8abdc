"""Removal of repeated line passages by content-defined chunks of lines.

Lines are hashed; a rolling hash over the last WINDOW line hashes of a text chooses where a chunk of lines ends, so that the same passage is cut alike wherever it stands. A line of many words is a chunk of its own. Chunks that occur more than once in the corpus are counted by a 128-bit hash; the first occurrence (least doc_id, then place) stays. An occurrence elsewhere goes only if its bytes equal those of the first, and only in runs of adjacent such chunks with enough words, so short lines that recur by nature stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.llm.common import MIX_A, fresh, join_split, mix64, written

WINDOW, DIVISOR, LONG_LINE = 2, 2, 12
#: Words that a run of repeated chunks needs to be removed.
RUN_WORDS = 30
#: Chunks that stand in many texts are broadcast up to so many bytes each, at most HOT_KEYS of them.
HOT_CHUNK = 1 << 16
#: Most lines of a chunk.
MOST_LINES = 64


def line_chunks(text: str, window: int = WINDOW, divisor: int = DIVISOR, long_line: int = LONG_LINE) -> list[tuple[int, int]]:
    """(first line, line after the last) of the chunks of text's lines, which split at newline characters."""
    lines = text.split("\n")
    h = np.fromiter((xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines), np.uint64, len(lines))
    rolling = np.zeros(len(h), np.uint64)
    for k in range(window):
        rolling[k:] += mix64(h[: len(h) - k] * MIX_A + np.uint64(k))
    ends = mix64(rolling) % np.uint64(divisor) == 0
    long = np.fromiter((x.count(" ") + 1 >= long_line for x in lines), bool, len(lines))
    ends |= long
    ends[:-1] |= long[1:]
    ends[-1] = True
    out, at = [], 0
    for e in np.flatnonzero(ends) + 1:
        while e - at > MOST_LINES:
            out.append((at, at + MOST_LINES))
            at += MOST_LINES
        out.append((at, int(e)))
        at = int(e)
    return out


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, place, h1, h2, times, chunk) of the chunks with a word; of a chunk's repeats within one text the first, with their number."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            ids, places, digests, times, bodies = [], [], [], [], []
            for key, text in zip(batch.column(0).slice(at, 1000).to_pylist(), batch.column(1).slice(at, 1000), strict=True):
                text, seen = text.as_py(), {}
                lines = text.split("\n")
                for place, (a, b) in enumerate(line_chunks(text)):
                    body = "\n".join(lines[a:b]).encode("utf-8", "surrogatepass")
                    if not body.strip():
                        continue
                    digest = xxhash.xxh3_128_digest(body)
                    if digest in seen:
                        seen[digest][2] += 1
                    else:
                        seen[digest] = [place, body, 1]
                for digest, (place, body, n) in seen.items():
                    ids.append(key), places.append(place), digests.append(digest), times.append(n), bodies.append(body)
                    if len(ids) >= 20_000:
                        yield _batch(ids, places, digests, times, bodies)
                        ids, places, digests, times, bodies = [], [], [], [], []
            if ids:
                yield _batch(ids, places, digests, times, bodies)


def _batch(ids, places, digests, times, bodies):
    d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(places, pa.int32()), pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(times, pa.int32()), pa.array(bodies, pa.binary())], names=["doc_id", "place", "h1", "h2", "times", "chunk"])


def _rewrite(names: list[str], run_words: int):
    """Texts without the runs of chunks whose bytes are those of an earlier occurrence."""

    def cut(text, known, own):
        lines, parts = text.split("\n"), line_chunks(text)
        gone, words, seen = np.zeros(len(parts), bool), np.zeros(len(parts), np.int64), set()
        for place, (a, b) in enumerate(parts):
            body = "\n".join(lines[a:b]).encode("utf-8", "surrogatepass")
            words[place] = len(body.split())
            first = known.get(body)
            gone[place] = body in seen or (first is not None and first != (own, place))
            seen.add(body)
        blank = words == 0
        at, n_gone, keep = 0, 0, []
        while at < len(parts):
            end = at
            while end < len(parts) and (gone[end] or blank[end]):
                end += 1
            if words[at:end].sum() >= run_words:
                n_gone += parts[end - 1][1] - parts[at][0]
            else:
                keep += range(at, end)
            if end < len(parts):
                keep.append(end)
            at = end + 1
        return "\n".join("\n".join(lines[parts[k][0] : parts[k][1]]) for k in keep), len(lines), n_gone

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, d = names.index("text"), names.index("doc_id")
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts, n, less = [], [], []
                for text, own, first in zip(part.column(t), part.column(d), part.column(len(names)), strict=True):
                    text = text.as_py()
                    if first.is_valid:
                        known = {x["chunk"]: (x["doc"], x["place"]) for x in first.as_py()}
                        text, lines, gone = cut(text, known, own.as_py())
                    else:
                        lines, gone = (text.count("\n") + 1 if text else 0), 0
                    texts.append(text), n.append(lines), less.append(gone)
                cols = [*part.columns[: len(names)], pa.array(n, pa.int64()), pa.array(less, pa.int64())]
                cols[t] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=[*names, "n_lines", "n_removed"])

    return rewrite


def dedup_lines(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with text freed of repeated passages, and with n_lines and n_removed (long, lines before and lines removed).

    docs needs doc_id and text; columns n_lines and n_removed are replaced. Every row returns, also one whose text is now empty. Null and empty texts have no line and stay; rows with a null doc_id stay as they are. Rows that repeat a doc_id count as one document: their chunks at the same place are all the first occurrence. A text whose own chunks are all first occurrences stays byte for byte. An empty table returns no row.
    """
    docs = docs.drop("n_lines", "n_removed")
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null and text <> ''")
    chunks = some.mapInArrow(_chunks, "doc_id long, place int, h1 long, h2 long, times int, chunk binary")
    at = F.struct("doc_id", "place")
    repeated = chunks.groupBy("h1", "h2").agg(F.min(at).alias("first"), F.sum("times").alias("n"), F.min_by("chunk", at).alias("chunk")).where("n > 1")
    found = written(repeated.select("h1", "h2", F.col("first.doc_id").alias("doc"), "first.place", "chunk", "n"), "repeated")
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    where = join_split(some.mapInArrow(_places, "doc_id long, h1 long, h2 long"), found, ["h1", "h2"], "n", total, f"octet_length(chunk) <= {HOT_CHUNK}").where("doc is not null")
    names = docs.columns
    of, first = fresh(names, "known_of"), fresh(names, "known_first")
    known = where.groupBy(F.col("doc_id").alias(of)).agg(F.collect_list(F.struct("doc", "place", "chunk")).alias(first))
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    joined = docs.join(known, F.col("doc_id") == F.col(of), "left").select(*names, first)
    return joined.mapInArrow(_rewrite(names, run_words), schema)


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _chunks(batches):
        yield batch.select(["doc_id", "h1", "h2"])
