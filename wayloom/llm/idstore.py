"""Token ids in a content-addressed store.

A store is a folder of Parquet tables. The ``chunk`` rows of ``rows`` hold each distinct chunk of ids once, under the BLAKE2b digest of its bytes; a rolling hash over the ids cuts the chunks, so texts that share a passage share most of its chunks. ``recipes`` holds, in ascending doc_id order, each document's place in the id stream, the digests of its chunks and their Merkle root; ``manifest`` holds the totals and the root of a tree over the documents of each part, and those of the whole store over its parts. Reading checks every chunk against its digest, every document against its root, every part and the whole against the manifest.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayloom.llm.common import MIX_A, MIX_B, remove

END_ID = 2
WINDOW, DIVISOR, LEAST, MOST = 16, 256, 64, 2048
WIDTH = "<u2"
#: Shift that leaves the bits of a hash that say one in DIVISOR.
_TOP = np.uint64(64 - DIVISOR.bit_length() + 1)
_BREAK = re.compile(r"(?<=\S) ")
#: Marks, and letters (all of long standing in Unicode) after which they begin a pre-token of their own.
MARKS = ".,;:!?%&*#$|"
LETTER_END = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$"
#: Documents or nodes under a node of a part's tree, and its height: enough for 4096^3 documents a part.
FAN, LEVELS = 4096, 3
#: The manifest's row of the whole store.
WHOLE = -1
_MANIFEST = "part int, docs long, ids long, root string"
#: Bytes of text that are encoded together.
TOGETHER = 1 << 24
#: Pieces whose ids are gathered at once.
_BLOCK = 1 << 18


class Encoder:
    """ids of whole texts by a byte-level BPE file of the tokenizers library, as 16-bit numbers.

    A space after a character that is no white space always begins a pre-token, so a text is encoded by the pieces between such spaces. The distinct pieces of many texts go through the library once, many in a row, and the texts' ids are gathered from theirs; nothing is kept from one call to the next. Texts with a special token's string go through the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocab = self.tokenizer.get_vocab()
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.token_bytes[i] = len(token)  # in a byte-level vocabulary a character stands for a byte

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts one after another, and how many each has."""
        ids, n = array("H"), array("q")
        for k in range(0, len(texts), 64):  # what the library returns is large, and let go at once
            for x in self.tokenizer.encode_batch_fast(texts[k : k + 64], add_special_tokens=False):
                own = x.ids
                n.append(len(own))
                ids.extend(own)
        return np.frombuffer(ids, np.uint16).astype(WIDTH), np.frombuffer(n, np.int64).copy()

    def _in_rows(self, pieces: pa.Array, together: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """As _library, of pieces with the space before them that end in no white space: such a piece also ends a pre-token, so the ids of a row of them part by their bytes."""
        spaced = pc.binary_join_element_wise(*(pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in ("", pieces, " ")))
        ends = np.cumsum(pc.binary_length(spaced).to_numpy().astype(np.int64))
        at = [0, *ends[together - 1 : -1 : together].tolist(), int(ends[-1]) if len(ends) else 0]
        data = memoryview(spaced.buffers()[2] or b"")
        ids, _ = self._library([str(data[x:y], "utf-8") for x, y in zip(at, at[1:], strict=False) if x < y])
        reached = np.cumsum(self.token_bytes[ids])
        last = np.searchsorted(reached, ends)
        if len(ends) and (last[-1] != len(ids) - 1 or (reached[last] != ends).any()):
            raise ValueError("a token crosses the end of a piece")
        return ids, np.diff(last, prepend=-1)

    def _spaced(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, size) of distinct pieces with the space before them, and whether each is empty or ends in white space.

        The ids of a word with marks after it are the word's and the marks'.
        """
        length = pc.binary_length(pieces)
        word = pc.utf8_rtrim(pieces, MARKS)
        ends_so = pc.and_(pc.less(pc.binary_length(word), length), pc.match_substring_regex(word, LETTER_END))
        marks = [p[len(p.rstrip(MARKS)) :] for p in pieces.filter(ends_so).to_pylist()]
        coded = pc.dictionary_encode(pc.if_else(ends_so, word, pieces))
        base = coded.dictionary
        size_of = pc.binary_length(base).to_numpy()
        loose = (pc.binary_length(pc.utf8_rtrim_whitespace(base)).to_numpy() < size_of) | (size_of == 0)
        kinds = sorted(set(marks))
        parts = [self._in_rows(base.filter(pa.array(~loose))), self._library([f" {p}" for p in base.filter(pa.array(loose)).to_pylist()]), self._library(kinds)]
        pool, size = (np.concatenate(x) for x in zip(*parts, strict=True))
        size, n_base = np.append(size, 0), len(base)
        begin = np.cumsum(size) - size
        # each piece is a base and marks; the last of the pool stands for no marks
        of_base = np.empty(n_base, np.int64)
        of_base[np.flatnonzero(~loose)], of_base[np.flatnonzero(loose)] = np.arange(n_base - loose.sum()), np.arange(n_base - loose.sum(), n_base)
        both = np.full((len(pieces), 2), len(size) - 1)
        both[:, 0] = of_base[coded.indices.to_numpy()]
        number = {m: n_base + k for k, m in enumerate(kinds)}
        both[ends_so.to_numpy(zero_copy_only=False), 1] = list(map(number.__getitem__, marks))
        ids = pool[_runs(begin[both.ravel()], size[both.ravel()])]
        return ids, size[both].sum(axis=1), loose[coded.indices.to_numpy()]

    def _bare(self, heads: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, size) of distinct pieces that begin a text, and the number of each of heads among them."""
        coded = pc.dictionary_encode(heads)
        return *self._library(coded.dictionary.to_pylist()), coded.indices.to_numpy().astype(np.int64)

    def many(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts one after another, and how many each has; a null text has none."""
        pool, first, size, n = self._gathered(texts)
        ids = np.concatenate([pool[_runs(first[k : k + _BLOCK], size[k : k + _BLOCK])] for k in range(0, len(size), _BLOCK)] or [pool[:0]])
        return ids, n

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids each text has."""
        return self._gathered(texts)[3]

    def _gathered(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A pool of ids, where in it the pieces of texts begin and how many ids they have, and how many each text has."""
        texts = texts.cast(pa.large_string())
        whole = np.zeros(len(texts), bool)
        for token in self.special:
            whole |= pc.fill_null(pc.match_substring(texts, token), False).to_numpy(zero_copy_only=False)
        plain = ~whole & (pc.fill_null(pc.binary_length(texts), 0).to_numpy() > 0)
        split = pc.split_pattern(texts.filter(pa.array(plain)), " ")
        n = np.zeros(len(texts), np.int64)
        n[plain] = pc.list_value_length(split).to_numpy()
        begin = np.cumsum(n) - n
        coded = pc.dictionary_encode(split.flatten())
        pool, size, loose = self._spaced(coded.dictionary)
        place = coded.indices.to_numpy()
        # a text with a space after white space is split anew
        inner = np.ones(len(place), bool)
        inner[(begin + n - 1)[n > 0]] = False
        odd = np.unique(np.searchsorted(np.cumsum(n), np.flatnonzero(loose[place] & inner), side="right"))
        pieces = [_BREAK.split(t) for t in texts.take(pa.array(odd)).to_pylist()]
        again = pc.dictionary_encode(pa.array([p for own in pieces for p in own], pa.large_string()))
        n[odd] = [len(own) for own in pieces]
        begin[odd] = len(place) + np.cumsum(n[odd]) - n[odd]
        more, more_size, _ = self._spaced(again.dictionary)
        place = np.concatenate([place, (len(size) + again.indices.to_numpy()).astype(np.int32)])
        pool, size = np.concatenate([pool, more]), np.concatenate([size, more_size])
        # what begins a text has no space before it
        some = np.flatnonzero(n)
        flat = pa.chunked_array([split.flatten(), again.dictionary_decode() if len(again) else pa.array([], pa.large_string())]).take(pa.array(begin[some])).combine_chunks()
        more, more_size, number = self._bare(flat)
        place[begin[some]] = len(size) + number
        pool, size = np.concatenate([pool, more]), np.concatenate([size, more_size])
        more, more_size = self._library(texts.filter(pa.array(whole)).to_pylist())
        begin[whole], n[whole] = len(place) + np.arange(whole.sum()), 1
        place = np.concatenate([place, (len(size) + np.arange(whole.sum())).astype(np.int32)])
        pool, size = np.concatenate([pool, more]), np.concatenate([size, more_size])
        place = place[_runs(begin, n)]
        first, size = (np.cumsum(size) - size)[place], size[place]
        reached, ends = np.concatenate([[0], np.cumsum(size)]), np.cumsum(n)
        return pool, first, size, reached[ends] - reached[ends - n]

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text as little-endian 16-bit bytes."""
        ids, n = self.many(pa.array(texts, pa.large_string()))
        raw, ends = ids.tobytes(), (2 * np.cumsum(n)).tolist()
        return [raw[e - 2 * k : e] for e, k in zip(ends, n.tolist(), strict=True)]


def _runs(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of n numbers each, one run after another."""
    ends = np.cumsum(n)
    return np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def _marks(ids: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """Places after which the rolling hash of the last WINDOW ids lets a chunk end, in ascending order."""
    out = []
    for k in range(0, max(len(ids) - WINDOW + 1, 0), block):
        h, step, factor = ids[k : k + block + WINDOW - 1].astype(np.uint64), 1, int(MIX_A)
        while step < WINDOW:
            h = h[:-step] * np.uint64(factor) + h[step:]
            factor, step = factor * factor % 2**64, step * 2
        out.append(np.flatnonzero((h ^ (h >> np.uint64(32))) * MIX_B >> _TOP == 0) + k + WINDOW)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def cuts_of(ids: np.ndarray, ends: np.ndarray) -> list[list[int]]:
    """For each text of a stream of ids, which end at ends, the ends of its chunks in the stream: where the rolling hash says so within the text, LEAST to MOST ids apart."""
    marks = _marks(ids)
    begin = np.concatenate([[0], ends]).astype(np.int64)[: len(ends)]
    # a window must lie in its own text
    low, high = np.searchsorted(marks, begin + WINDOW).tolist(), np.searchsorted(marks, ends).tolist()
    marks, out = marks.tolist(), []
    for last, n, a, b in zip(begin.tolist(), ends.tolist(), low, high, strict=True):
        own = []
        for m in [*marks[a:b], n]:
            while m - last > MOST:
                last += MOST
                own.append(last)
            if m - last >= LEAST or (m == n and m > last):
                own.append(m)
                last = m
        out.append(own)
    return out


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's ids."""
    return cuts_of(ids, np.array([len(ids)]))[0]


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle_root(leaves: list[bytes]) -> bytes:
    """Root of the binary tree over leaves; an odd node moves up as it is."""
    level = leaves or [digest(b"")]
    while len(level) > 1:
        level = [digest(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@lru_cache(1)
def _encoder(path: str) -> Encoder:
    """The encoder of a Python worker, which its later tasks use too."""
    return Encoder(path)


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = _encoder(path), set()
        for batch in batches:
            for part in text_slices(batch):
                ids, n = encoder.many(part.column(1))
                ids = np.insert(ids, np.cumsum(n), END_ID)
                n = n + 1
                ends = np.cumsum(n)
                raw, last = ids.tobytes(), 0
                keys, bodies, chains, roots = [], [], [], []
                for own in cuts_of(ids, ends):
                    leaves = []
                    for end in own:
                        body = raw[2 * last : 2 * end]
                        leaves.append(leaf := digest(body))
                        if leaf not in seen:
                            if len(seen) > 300_000:
                                seen.clear()
                            seen.add(leaf)
                            keys.append(leaf), bodies.append(body)
                        last = end
                    chains.append(b"".join(leaves)), roots.append(merkle_root(leaves))
                for k in range(0, len(keys), 5000):
                    yield _rows("chunk", keys[k : k + 5000], bodies[k : k + 5000], None, None, None)
                yield _rows("recipe", roots, None, part.column(0), pa.array(n, pa.int64()), chains)

    return encode


def text_slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """batch in parts of about TOGETHER bytes of text."""
    size = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy()
    total, at = np.cumsum(size, dtype=np.int64), 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TOGETHER)))
        yield batch.slice(at, end - at)
        at = end


def _rows(kind: str, keys: list[bytes], bodies: list[bytes] | None, docs: pa.Array | None, sizes: pa.Array | None, chains: list[bytes] | None) -> pa.RecordBatch:
    m = len(keys)
    columns = [pa.array([kind] * m, pa.string()), pa.array(keys, pa.binary())]
    for given, kind_of in ((bodies, pa.binary()), (docs, pa.int64()), (sizes, pa.int64()), (chains, pa.binary())):
        columns.append(pa.nulls(m, kind_of) if given is None else given if isinstance(given, pa.Array) else pa.array(given, kind_of))
    return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "ids", "doc_id", "n_tokens", "leaves"])


def write_store(docs: DataFrame, tokenizer_path: str, path: str) -> None:
    """Encode text of every row of docs (doc_id long, text string), append END_ID, and write a store under path.

    Null and empty texts are the end id alone. A null doc_id comes first. Rows that repeat a doc_id each have a recipe, in the order of their roots. An empty table makes an empty store. Within a task a chunk is shuffled once, so a chunk that stands everywhere is at most a row from each task.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encode(tokenizer_path), "kind string, key binary, ids binary, doc_id long, n_tokens long, leaves binary")
    dealt = rows.withColumn("deal", F.when(F.col("kind") == "chunk", F.xxhash64("key")).otherwise(F.xxhash64("doc_id", "key", "n_tokens")))
    again = F.row_number().over(Window.partitionBy("deal", "key").orderBy("deal"))
    once = dealt.withColumn("again", again).where("kind = 'recipe' or again = 1").drop("deal", "again")
    once.write.option("compression", "zstd").parquet(f"{path}/rows")
    stored = spark.read.schema("key binary, ids binary, doc_id long, n_tokens long, leaves binary, kind string").parquet(f"{path}/rows")
    recipes = stored.where("kind = 'recipe'").select("doc_id", F.col("key").alias("root"), "n_tokens", "leaves")
    placed = recipes.orderBy(F.asc_nulls_first("doc_id"), "root").withColumn("part", F.spark_partition_id())
    placed.mapInArrow(_running, "doc_id long, root binary, n_tokens long, leaves binary, part int, place long, within long").write.option("compression", "zstd").parquet(f"{path}/recipes")
    parts = _parts_of(_part_roots(_recipes(spark, path)))
    whole = (WHOLE, sum(p[1] for p in parts), sum(p[2] for p in parts), store_root(parts))
    spark.createDataFrame([whole, *parts], _MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's place in its task's order and the ids before it there."""
    rows, ids = 0, 0
    for batch in batches:
        n = batch.column(2).to_numpy()
        ends = ids + np.cumsum(n)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.arange(rows, rows + len(n))), pa.array(ends - n)], names=[*batch.schema.names, "place", "within"])
        if len(n):
            rows, ids = rows + len(n), int(ends[-1])


def _recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id long, root binary, n_tokens long, leaves binary, part int, place long, within long").parquet(f"{path}/recipes")


def _part_roots(recipes: DataFrame) -> DataFrame:
    """(part, docs, ids, root) of each part: a tree of SHA-256 over its documents' roots in order, FAN of them in a node, so that no list grows with the part."""
    level = recipes.select("part", F.col("place").alias("at"), F.lit(1).cast("long").alias("docs"), F.col("n_tokens").alias("ids"), F.hex("root").alias("root"))
    for _ in range(LEVELS):
        listed = F.sort_array(F.collect_list(F.struct("at", "root")))
        level = level.groupBy("part", F.floor(F.col("at") / FAN).alias("at")).agg(F.sum("docs").alias("docs"), F.sum("ids").alias("ids"), F.sha2(F.array_join(F.transform(listed, lambda x: x["root"]), ""), 256).alias("root"))
    return level.groupBy("part").agg(F.count("*").alias("tops"), F.sum("docs").alias("docs"), F.sum("ids").alias("ids"), F.first("root").alias("root")).select("part", "docs", "ids", F.when(F.col("tops") == 1, F.col("root")).alias("root"))


def store_root(parts: list[tuple[int, int, int, str]]) -> str:
    """Root of a whole store from its parts (part, docs, ids, root)."""
    return merkle_root([digest(f"{part} {docs} {ids} {root}".encode()) for part, docs, ids, root in sorted(parts)]).hex()


def _parts_of(rows: DataFrame) -> list[tuple[int, int, int, str]]:
    return sorted((r["part"], r["docs"], r["ids"], r["root"]) for r in rows.collect())


def _starts(spark: SparkSession, path: str) -> DataFrame:
    """Recipes with start; the manifest's parts, one row for each part, are what the driver sees."""
    recipes = _recipes(spark, path)
    stated = _parts_of(spark.read.schema(_MANIFEST).parquet(f"{path}/manifest"))
    root = [p for p in stated if p[0] == WHOLE]
    stated = [p for p in stated if p[0] != WHOLE]
    if stated != _parts_of(_part_roots(recipes)) or [r[3] for r in root] != [store_root(stated)]:
        raise ValueError("the recipes aren't those of the manifest")
    before, at = [], 0
    for part, _, ids, _ in stated:
        before.append((part, at))
        at += ids
    offsets = spark.createDataFrame(before, "part int, before long")
    return recipes.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "root", "leaves")


def _chunk_rows(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.schema("key binary, ids binary, doc_id long, n_tokens long, leaves binary, kind string").parquet(f"{path}/rows")
    return stored.where("kind = 'chunk'").select("key", "ids")


def _explode(starts: DataFrame) -> DataFrame:
    """A row for each chunk of each document."""
    places = F.sequence(F.lit(0), (F.octet_length("leaves") / 16).cast("int") - 1)
    return starts.withColumn("seq", F.explode(places)).select("doc_id", "start", "n_tokens", "root", "seq", F.expr("substring(leaves, seq * 16 + 1, 16)").alias("key"))


_TABLES: list[np.ndarray] = []


def _crc_tables() -> list[np.ndarray]:
    """For each k: four tables of 256 that carry a CRC-32 over 2^k zero bytes."""
    if not _TABLES:
        one = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
        values = [np.arange(256, dtype=np.uint32) << np.uint32(8 * b) for b in range(4)]
        table = np.stack([one[v & np.uint32(255)] ^ (v >> np.uint32(8)) for v in values])
        for _ in range(40):
            _TABLES.append(table)
            table = np.stack([_carry(table, _carry(table, v)) for v in values])
    return _TABLES


def _carry(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & np.uint32(255)] ^ table[1][(crc >> np.uint32(8)) & np.uint32(255)] ^ table[2][(crc >> np.uint32(16)) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)]


def crc_join(left: np.ndarray, right: np.ndarray, right_bytes: np.ndarray) -> np.ndarray:
    """CRC-32 of the concatenation, from those of its parts and the second one's length."""
    out, k, rest = left.astype(np.uint32), 0, right_bytes.astype(np.int64)
    tables = _crc_tables()
    while rest.any():
        out = np.where(rest & 1, _carry(tables[k], out), out)
        rest, k = rest >> 1, k + 1
    return out ^ right


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, n, crc) of chunks whose bytes have their digest; crc is over 32-bit ids."""
    for batch in batches:
        column = batch.column(1).cast(pa.large_binary())
        ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
        data = memoryview(column.buffers()[2] or b"")[ends[0] : ends[-1]]
        wide = memoryview(np.frombuffer(data, WIDTH).astype("<u4")).cast("B")
        crc, spans = [], (ends - ends[0]).tolist()
        for key, a, b in zip(batch.column(0).to_pylist(), spans, spans[1:], strict=False):
            if digest(data[a:b]) != key:
                raise ValueError("a chunk isn't what its digest says")
            crc.append(zlib.crc32(wide[2 * a : 2 * b]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(ends) // 2), pa.array(crc, pa.int64())], names=["key", "n", "crc"])


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, start, n_tokens, root, leaves), each checked for its leaves to have its root."""
    for batch in batches:
        for root, leaves in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            if merkle_root([leaves[k : k + 16] for k in range(0, len(leaves), 16)]) != root:
                raise ValueError("a document can't be rebuilt from its chunks")
        yield batch


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the chunk sums (seq, n, crc) of each document, neighbours two by two, after checking its length."""
    for batch in batches:
        length = pc.list_value_length(batch.column(3)).to_numpy()
        parts = batch.column(3).flatten()
        if parts.field(1).null_count:
            raise ValueError("a document can't be rebuilt from its chunks")
        seq, n, crc = (parts.field(k).to_numpy() for k in range(3))
        owner = np.repeat(np.arange(len(length)), length)
        order = np.lexsort((seq, owner))
        owner, n, crc = owner[order], n[order], crc[order].astype(np.uint32)
        if (np.bincount(owner, weights=n, minlength=len(length)).astype(np.int64) != batch.column(2).to_numpy()).any():
            raise ValueError("a document can't be rebuilt from its chunks")
        while len(owner) > len(length):
            first = np.searchsorted(owner, owner)
            left = (np.arange(len(owner)) - first) % 2 == 0
            joined = np.flatnonzero(left[:-1] & ~left[1:] & (owner[:-1] == owner[1:]))
            crc[joined] = crc_join(crc[joined], crc[joined + 1], 4 * n[joined + 1])
            n[joined] += n[joined + 1]
            owner, n, crc = owner[left], n[left], crc[left]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of a store, each chunk read and checked once.

    A CRC-32 of a concatenation follows from those of its parts, so no chunk travels to its documents. Raises where a chunk, a document or a part isn't what the store states.
    """
    sums = _chunk_rows(spark, path).mapInArrow(_checked, "key binary, n long, crc long")
    starts = _starts(spark, path)
    pieces = _explode(starts.mapInArrow(_rooted, starts.schema)).join(sums, "key", "left")
    whole = pieces.groupBy("doc_id", "start", "n_tokens").agg(F.collect_list(F.struct("seq", "n", "crc")).alias("parts"))
    return whole.mapInArrow(_summed, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = []
        for parts, root in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True):
            parts = sorted((p["seq"], p["ids"]) for p in parts)
            if merkle_root([digest(x) for _, x in parts]) != root:
                raise ValueError("a document can't be rebuilt from its chunks")
            ids.append(np.frombuffer(b"".join(x for _, x in parts), WIDTH).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "n_tokens", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids of every document of a store, rebuilt and checked."""
    pieces = _explode(_starts(spark, path)).join(_chunk_rows(spark, path), "key", "left")
    whole = pieces.groupBy("doc_id", "start", "n_tokens", "root").agg(F.collect_list(F.struct("seq", "ids")).alias("parts"))
    return whole.mapInArrow(_rebuilt, "doc_id long, start long, n_tokens long, ids array<int>")


def delete_store(spark: SparkSession, path: str) -> None:
    remove(spark, path)
