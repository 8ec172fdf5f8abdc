"""Token counts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists the pieces that end at each character; dynamic programming keeps for each place the best score and the number of tokens of the path that has it. Scores are whole numbers of 1/UNIT, so ties are real ties at any length, and they fall as in the tokenizer's own Viterbi search: of equal paths to a place the one whose last piece begins first, an unknown character last. An unknown character counts its UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.pieces import SPACE, PieceTable, chunks_of, whole

#: Scores are multiples of 1/UNIT.
UNIT = 64
#: How far an unknown character lies under the least score, as in the library.
UNKNOWN_PENALTY = 10
_COUNT_BITS = 40


def zipf_cost(place: int) -> int:
    """Cost in 1/UNIT of the piece at place (0, 1, ...) in a file: the negative logarithm of its Zipf probability without the constant."""
    return round(UNIT * math.log(place + 2))


class ViterbiCounter:
    """Counts tokens of chunks and remembers the counts of short ones; forgets all when there are many."""

    def __init__(self, path: str, most: int = 700_000):
        import ahocorasick

        table = PieceTable(path)
        first = min(table.normal.values())
        self.costs = {p: zipf_cost(i - first) for p, i in table.normal.items()}
        self.unknown = max(self.costs.values()) + UNKNOWN_PENALTY * UNIT
        self.automaton = ahocorasick.Automaton()
        for piece, cost in self.costs.items():
            self.automaton.add_word(piece, (len(piece), cost))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}
        self.most = most

    def best(self, chunk: str) -> tuple[int, int]:
        """(tokens, cost in 1/UNIT) of the best path over chunk."""
        n = len(chunk)
        cost, count = [0] + [-1] * n, [0] * (n + 1)
        done = 0  # every place up to here has had all its candidates
        for end, (size, own) in self.automaton.iter(chunk):  # of one end the longest piece comes first
            while done < end:
                done += 1
                self._unknown(chunk, done, cost, count)
            c = cost[end + 1 - size] + own
            if cost[end + 1] < 0 or c < cost[end + 1]:
                cost[end + 1], count[end + 1] = c, count[end + 1 - size] + 1
        while done < n:
            done += 1
            self._unknown(chunk, done, cost, count)
        return count[n], cost[n]

    def _unknown(self, chunk: str, end: int, cost: list[int], count: list[int]) -> None:
        char = chunk[end - 1]
        if char in self.costs:
            return
        c = cost[end - 1] + self.unknown
        if cost[end] < 0 or c < cost[end]:
            cost[end], count[end] = c, count[end - 1] + len(char.encode("utf-8", "surrogatepass"))

    def _packed(self, chunk: str) -> int:
        tokens, cost = self.best(whole(chunk))
        return (cost << _COUNT_BITS) + tokens

    def __call__(self, text: str | None) -> tuple[int, int]:
        """(tokens, cost in 1/UNIT) of a whole text; nothing for a null or empty one."""
        if not text:
            return 0, 0
        text = text.replace(SPACE, " ")
        total, known = 0, self.known
        for piece in _word_blocks(text):
            parts = chunks_of(piece)
            try:
                total += sum(map(known.__getitem__, parts))
            except KeyError:
                new = set(parts).difference(known)
                if len(known) + len(new) > self.most:
                    known.clear()
                    new = set(parts)
                for chunk in new:
                    known[chunk] = self._packed(chunk)
                total += sum(map(known.__getitem__, parts))
                for chunk in new:
                    if len(chunk) > 64:
                        del known[chunk]
        return total & ((1 << _COUNT_BITS) - 1), total >> _COUNT_BITS


def _word_blocks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """text in blocks of about size that begin where a chunk does; each but the first comes without the space it begins with."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while (cut := text.find(" ", cut)) >= 0 and (text[cut - 1] == " " or text[cut : cut + 2] == "  "):
            cut += 1
        if cut < 0 or cut + 1 == len(text):
            break
        yield text[at:cut]
        at = cut + 1
    yield text[at:]


def _counter(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = ViterbiCounter(path)
        for batch in batches:
            got = [counter(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.int64()), pa.array([-g[1] / UNIT for g in got], pa.float64())], names=["doc_id", "n_tokens", "score"])

    return count


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens long, score double (of the best path) for each row of docs (doc_id long, text string).

    path names a SentencePiece file, there on every executor; its pieces are the vocabulary, their Zipf probabilities by place in the file the scores. Null and empty texts have no token and score 0. Long texts are counted in blocks cut at single spaces. Repeated rows are counted alike; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counter(path), "doc_id long, n_tokens long, score double")
