"""SentencePiece BPE with seeded merge-dropout, and its decoding.

A chunk's characters are merged in the order of an agenda, best rank first, leftmost on ties. Each candidate merge taken from the agenda is skipped if a hash keyed by the seed, the document, the chunk's number, the merge's place and its piece falls under the dropout rate, so each occurrence of a word is cut on its own while a run always repeats. Nothing is remembered from one occurrence to the next: many chunks of like length run their agendas side by side, a step of all of them at a time, over arrays of piece ids. Without dropout the ids are those of the library; with any dropout they decode to the text, byte for byte.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import MIX_A, MIX_B, MIX_C, mix64
from wayloom.llm.pieces import LITERAL, SPACE, PieceTable

#: Chunks of more characters than this have an agenda of their own, a heap.
WIDE = 480
#: Chunks that run side by side, and about how many of their characters.
TILE, TILE_CHARS = 8192, 1 << 18
#: Characters of the documents that are encoded together; a longer text is encoded in parts, cut between chunks.
TOGETHER = 1 << 19
_PLACE_BITS = 9
_NEVER = np.int32(2**31 - 1)
_M = (1 << 64) - 1
_A, _B, _C = int(MIX_A), int(MIX_B), int(MIX_C)


class PairTable:
    """The piece that two symbols make, by open addressing.

    A symbol is a piece's id or, for a character that is no piece, the number of pieces and its code point. ``order`` of a pair is the made piece's rank, or -1; ``piece`` leads back to its id, also where pieces share a rank.
    """

    _SHIFT = np.uint64(21)

    def __init__(self, table: PieceTable):
        self.size = table.size
        ranks = {score: k for k, score in enumerate(sorted({table.stored_score[i] for i in table.normal.values()}, reverse=True))}
        place = {i: ranks[table.stored_score[i]] for i in table.normal.values()}
        self.piece_at = np.full(len(ranks), -1, np.int32)
        self.piece_at[list(place.values())] = list(place)
        #: Whether several pieces have a rank.
        self.shared = np.bincount(list(place.values()), minlength=len(ranks)) > 1
        left, right, made, pieces = [], [], [], []
        for piece, own in table.normal.items():
            for cut in range(1, len(piece)):
                a, b = self._symbol(table, piece[:cut]), self._symbol(table, piece[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(place[own]), pieces.append(own)
        keys = (np.array(left, np.uint64) << self._SHIFT) | np.array(right, np.uint64)
        bits = max(8, int(len(keys) * 4 - 1).bit_length())
        self.down, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.orders, self.pieces = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32), np.full(1 << bits, -1, np.int32)
        slot, left_over = self._slot(keys), np.arange(len(keys))
        while len(left_over):
            free = self.keys[slot[left_over]] < 0
            here, first = np.unique(slot[left_over[free]], return_index=True)
            won = left_over[free][first]
            self.keys[here], self.orders[here] = keys[won].astype(np.int64), np.array(made, np.int32)[won]
            self.pieces[here] = np.array(pieces, np.int32)[won]
            left_over = np.setdiff1d(left_over, won, assume_unique=True)
            slot[left_over] = (slot[left_over] + 1) & self.mask
        chars = np.arange(0x110000, dtype=np.int32) + np.int32(self.size)
        for piece, own in table.normal.items():
            if len(piece) == 1:
                chars[ord(piece)] = own
        #: Symbol of each code point.
        self.chars = chars

    def _symbol(self, table: PieceTable, part: str) -> int | None:
        return table.normal.get(part, self.size + ord(part) if len(part) == 1 else None)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * MIX_A) >> self.down).astype(np.int64)

    def _find(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each pair, and whether it is there."""
        keys = (a.astype(np.int64) << np.int64(21)) | b
        slot = self._slot(keys.view(np.uint64))
        there = self.keys[slot]
        found = (there == keys) & (keys >= 0)
        at = np.flatnonzero((there != keys) & (there >= 0))
        while len(at):
            slot[at] = (slot[at] + 1) & self.mask
            there = self.keys[slot[at]]
            found[at] = there == keys[at]
            at = at[~found[at] & (there >= 0)]
        return slot, found

    def order(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """order of each pair; a negative symbol makes no piece."""
        slot, found = self._find(a, b)
        return np.where(found, self.orders[slot], np.int32(-1))

    def piece(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, for pairs that make one."""
        return self.pieces[self._find(a, b)[0]]


class DropoutEncoder:
    """Encodes texts, each occurrence of a chunk with its own skips."""

    def __init__(self, path: str, dropout: float, seed: int):
        self.table = PieceTable(path)
        self.pairs = PairTable(self.table)
        self.rank = {p: -self.table.stored_score[i] for p, i in self.table.normal.items()}
        self.seed = seed
        self.below = int(dropout * (1 << 53))

    # ---- one chunk, step by step

    def merge(self, chunk: str, key: int, skipped: Callable[[int], bool] | None = None) -> list[int]:
        """ids of a chunk for an occurrence's key, or with the candidates that skipped chooses; by a heap."""
        ids: list[int] = []
        for s in self._symbols(list(chunk), skipped or self._drawn(key)):
            known = self.table.normal.get(s)
            ids += [known] if known is not None else [self.table.byte_id[b] for b in (SPACE if s == LITERAL else s).encode("utf-8", "surrogatepass")]
        return ids

    def _drawn(self, key: int) -> Callable[[int], bool]:
        """Whether an occurrence with this key skips a candidate."""

        def skipped(candidate: int) -> bool:
            x = ((key ^ candidate) * _B) & _M
            return (((x ^ (x >> 32)) * _C) & _M) >> 11 < self.below

        return skipped

    def _symbols(self, symbols: list[str], skipped: Callable[[int], bool]) -> list[str]:
        rank, n = self.rank, len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = []
        for i in range(n - 1):
            pair = symbols[i] + symbols[i + 1]
            if pair in rank:
                agenda.append((rank[pair], i, pair))
        heapq.heapify(agenda)
        while agenda:
            _, i, pair = heapq.heappop(agenda)
            j = after[i]
            if j < 0 or not symbols[i] or symbols[i] + symbols[j] != pair:
                continue  # one of the two has been merged since
            if skipped((self.table.normal[pair] * _A + i * _C) & _M):
                continue
            symbols[i], symbols[j] = pair, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                right = pair + symbols[k]
                if right in rank:
                    heapq.heappush(agenda, (rank[right], i, right))
            k = before[i]
            if k >= 0:
                left = symbols[k] + pair
                if left in rank:
                    heapq.heappush(agenda, (rank[left], k, left))
        return [s for s in symbols if s]

    # ---- many chunks side by side

    def _tile(self, symbols: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Runs the agendas of all columns of symbols (place, chunk), -1 below a chunk's end; what is merged into the symbol above becomes -1."""
        wide, n = symbols.shape
        now = np.full((wide + 1, n), -1, np.int32)
        now[:wide] = symbols
        after = np.broadcast_to(np.arange(1, wide + 2, dtype=np.int16)[:, None], now.shape).copy()
        after[wide - 1 :] = wide
        before = np.broadcast_to(np.arange(-1, wide, dtype=np.int16)[:, None], now.shape).copy()
        flat, flat_after, flat_before = now.reshape(-1), after.reshape(-1), before.reshape(-1)
        places = np.arange(wide - 1, dtype=np.int32)[:, None]
        # an agenda holds each place's pair as (order, place), so its least entry is the next candidate; row wide stands for no place
        agenda = np.full((wide + 1, n), _NEVER, np.int32)
        order = self.pairs.order(now[: wide - 1].reshape(-1), now[1:wide].reshape(-1)).reshape(wide - 1, n)
        agenda[: wide - 1] = np.where(order < 0, _NEVER, (order << _PLACE_BITS) | places)
        column = np.arange(n)
        while True:
            best = agenda.min(axis=0)
            live = best != _NEVER
            n_live = int(np.count_nonzero(live))
            if not n_live:
                return now[:wide]
            if n_live < 0.8 * len(column):
                agenda, column, best = np.ascontiguousarray(agenda[:, live]), column[live], best[live]
                at = np.arange(n_live)
            else:
                at = np.flatnonzero(live)
                best = best[at]
            m, owner = agenda.shape[1], column[at]
            i = (best & ((1 << _PLACE_BITS) - 1)).astype(np.int64)
            here = i * n + owner
            order = best >> _PLACE_BITS
            piece = self.pairs.piece_at[order]
            tied = np.flatnonzero(self.pairs.shared[order])
            if len(tied):
                left = here[tied]
                piece[tied] = self.pairs.piece(flat[left], flat[flat_after[left].astype(np.int64) * n + owner[tied]])
            rows = agenda.reshape(-1)
            rows[i * m + at] = _NEVER
            if self.below:
                x = (keys[owner] ^ (piece.astype(np.uint64) * MIX_A + i.astype(np.uint64) * MIX_C)) * MIX_B
                go = np.flatnonzero(((x ^ (x >> np.uint64(32))) * MIX_C) >> np.uint64(11) >= np.uint64(self.below))
                at, owner, i, piece, here = at[go], owner[go], i[go], piece[go], here[go]
            j = flat_after[here].astype(np.int64)
            there = j * n + owner
            k = flat_after[there]
            follow = k.astype(np.int64) * n + owner
            flat[here], flat[there] = piece, -1
            flat_after[here], flat_before[follow] = k, i
            rows[j * m + at] = _NEVER
            order = self.pairs.order(piece, flat[follow])
            rows[i * m + at] = np.where(order < 0, _NEVER, (order << _PLACE_BITS) | i.astype(np.int32))
            h = flat_before[here].astype(np.int64)
            h[h < 0] = wide
            order = self.pairs.order(flat[h * n + owner], piece)
            rows[h * m + at] = np.where(order < 0, _NEVER, (order << _PLACE_BITS) | h.astype(np.int32))

    def chunk_symbols(self, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of chunks, one after another, and how many each has; codes are code points, a chunk is codes[begin : begin + length]."""
        start = self.pairs.chars[codes]
        order = np.argsort(length.astype(np.int32), kind="stable")
        sorted_length = length[order]
        count = np.zeros(len(begin), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        at, upto = 0, int(np.searchsorted(sorted_length, WIDE, side="right"))
        while at < upto:
            end = min(at + TILE, upto)
            end = at + max(1, int(np.searchsorted(sorted_length[at:end] * np.arange(1, end - at + 1), TILE_CHARS)))
            end = min(end, upto)
            own, wide = order[at:end], int(sorted_length[end - 1])
            step = np.arange(wide)[:, None]
            place = begin[own] + step
            symbols = np.where(step < length[own], start[np.minimum(place, len(start) - 1)], np.int32(-1))
            done = self._tile(symbols, keys[own]) if wide > 1 else symbols
            kept = done >= 0
            count[own] = kept.sum(axis=0)
            found.append((own, done.T[kept.T]))
            at = end
        for k in order[upto:].tolist():
            text = codes[begin[k] : begin[k] + length[k]].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
            # a byte's id stands for itself from here on
            ids = np.array(self.merge(text, int(keys[k])), np.int32)
            count[k] = len(ids)
            found.append((np.array([k]), ids))
        out = np.empty(int(count.sum()), np.int32)
        first = np.cumsum(count) - count
        for own, symbols in found:
            n = count[own]
            out[np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(len(symbols))] = symbols
        return out, count

    def _ids(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of symbols, and how many each has: a character that is no piece becomes the ids of its bytes."""
        size = np.ones(len(symbols), np.int64)
        other = np.flatnonzero(symbols >= self.table.size)
        if not len(other):
            return symbols.astype(np.uint16), size
        kinds, which = np.unique(symbols[other], return_inverse=True)
        chars = [chr(int(x) - self.table.size) for x in kinds]
        ids = [[self.table.byte_id[b] for b in (SPACE if c == LITERAL else c).encode("utf-8", "surrogatepass")] for c in chars]
        size[other] = np.array(list(map(len, ids)))[which]
        first = np.cumsum(size) - size
        out = np.empty(int(size.sum()), np.uint16)
        plain = symbols < self.table.size
        out[first[plain]] = symbols[plain]
        for byte in range(4):
            here = size[other] > byte
            out[first[other[here]] + byte] = np.array([x[byte] if byte < len(x) else 0 for x in ids], np.uint16)[which[here]]
        return out, size

    def keys(self, docs: list[int | None], n: list[int], done: list[int] | None = None) -> np.ndarray:
        """Keys of the n chunks of each document, by its doc_id and their place; done chunks come before them."""
        seed = mix64(np.array([self.seed & _M], np.uint64))
        base = mix64(np.array([(d or 0) & _M for d in docs], np.uint64) * MIX_A + seed)
        n = np.asarray(n, np.int64)
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.asarray(done or [0] * len(docs), np.int64), n)
        return mix64(np.repeat(base, n) + place.astype(np.uint64) * MIX_A)

    def __call__(self, doc_id: int | None, text: str | None) -> np.ndarray:
        """ids of a whole text as uint16; none for a null or empty one."""
        return self.many([doc_id], [text])[0]

    def many(self, docs: list[int | None], texts: list[str | None]) -> list[np.ndarray]:
        """ids of each text. Texts are taken together up to about TOGETHER characters; the chunks of a longer one in several goes."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        chunks_before = [0] * len(texts)
        group: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal size
            if group:
                who = [k for k, _ in group]
                for k, (ids, n) in zip(who, self._group([docs[k] for k in who], [t for _, t in group], [chunks_before[k] for k in who]), strict=True):
                    out[k].append(ids)
                    chunks_before[k] += n
                group.clear()
                size = 0

        for k, text in enumerate(texts):
            for part in _parts(text) if text else ():
                if size and (size + len(part) > TOGETHER or group[-1][0] == k):
                    flush()
                group.append((k, part))
                size += len(part)
        flush()
        return [np.concatenate(x) if len(x) > 1 else x[0] if x else np.zeros(0, np.uint16) for x in out]

    def _group(self, docs: list[int | None], parts: list[str], done: list[int]) -> list[tuple[np.ndarray, int]]:
        """(ids, chunks) of each part, which begins with the space of its first chunk."""
        codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        first = np.cumsum(size) - size
        codes[codes == ord(SPACE)] = ord(LITERAL)
        space = codes == 32
        codes[space] = ord(SPACE)
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins[first] = True
        begin = np.flatnonzero(begins)
        length = np.diff(begin, append=len(codes))
        n = np.diff(np.searchsorted(begin, first), append=len(begin))
        symbols, count = self.chunk_symbols(codes, begin, length, self.keys(docs, n, done))
        ids, made = self._ids(symbols)
        ends = np.cumsum(made)[np.cumsum(count)[np.cumsum(n) - 1] - 1]
        return [(x, int(k)) for x, k in zip(np.split(ids, ends[:-1]), n, strict=True)]


def _parts(text: str) -> Iterator[str]:
    """text with the space that is put before it, in parts that begin where a chunk does."""
    at, text = 0, f" {text}"
    while len(text) - at > TOGETHER:
        cut = at + TOGETHER
        while (cut := text.find(" ", cut)) >= 0 and text[cut - 1] == " ":
            cut += 1
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


class Decoder:
    """Bytes of ids, gathered from one pool."""

    def __init__(self, raw: list[bytes]):
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.first = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(raw), np.uint8)

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """The bytes of a whole text's ids, without the space before it."""
        out = []
        for k in range(0, len(ids), 1 << 18):
            own = ids[k : k + (1 << 18)]
            n = self.size[own]
            ends = np.cumsum(n)
            out.append(self.pool[np.repeat(self.first[own] - ends + n, n) + np.arange(ends[-1])].tobytes())
        return b"".join(out)[1:]


def decode(ids: np.ndarray, raw: list[bytes]) -> str:
    """The text of ids; raw holds each id's bytes. The space before the text goes."""
    return b"".join(map(raw.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """doc_ids and texts of a batch, about TOGETHER bytes at a time."""
    size = np.cumsum(np.fromiter(((len(t.as_buffer()) if t.is_valid else 0) for t in batch.column(1)), np.int64, batch.num_rows))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + TOGETHER)))
        yield batch.column(0).slice(at, end - at), batch.column(1).slice(at, end - at).to_pylist()
        at = end


def _encoder(path: str, dropout: float, seed: int, digest: bool):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = DropoutEncoder(path, dropout, seed)
        decoder = Decoder(encoder.table.raw)
        for batch in batches:
            for docs, texts in _slices(batch):
                n, crc, good, ids = [], [], [], []
                for text, own in zip(texts, encoder.many(docs.to_pylist(), texts), strict=True):
                    if digest:
                        n.append(len(own)), crc.append(zlib.crc32(own.astype("<u4"))), good.append(decoder.bytes_of(own) == (text or "").encode("utf-8", "surrogatepass"))
                    else:
                        ids.append(own.astype(np.int32))
                if digest:
                    yield pa.RecordBatch.from_arrays([docs, pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(good, pa.bool_())], names=["doc_id", "n_pieces", "ids_crc32", "lossless"])
                else:
                    yield pa.RecordBatch.from_arrays([docs, pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return encode


def encode_documents(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, ids array<int> for each row of docs (doc_id long, text string).

    path names a BPE SentencePiece file of at most 65,536 pieces with byte fallback, there on every executor. Null and empty texts have no id; a null doc_id takes the skips of doc_id 0. Repeated rows are encoded alike; other columns are ignored. An empty table returns no row.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(path, dropout, seed, False), "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text for each row of encoded (doc_id long, ids array<int>); a null ids gives an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(PieceTable(path).raw)
        for batch in batches:
            texts = [decoder.bytes_of(np.array(x, np.int64)).decode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str, dropout: float = 0.1, seed: int = 1) -> DataFrame:
    """doc_id, n_pieces long, ids_crc32 long (of the ids as little-endian 32-bit), lossless boolean (the ids decode to the text) for each row of docs; as encode_documents otherwise."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_encoder(path, dropout, seed, True), "doc_id long, n_pieces long, ids_crc32 long, lossless boolean")
