"""Language identification by interpolated Kneser-Ney character models.

Each language of the training rows gets a character model of order ORDER over padded words (letters only, lower-cased). The models of all languages share one sorted array of 64-bit hashes for each order, with a column of values for each language. A text gets, for each language, its cross-entropy a character; the least wins. A rejection bound and the sharpness of the score are calibrated on training rows kept out of the counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import mix64

ORDER = 5
#: Training rows used at most; beyond it a sample chosen by the hash of doc_id.
MAX_TRAINING_ROWS = 12_000
#: Characters of the sample on average, so that the driver's arrays stay bounded where texts are long.
MAX_TRAINING_CHARS = 60_000_000
#: Rows that a language needs for a rejection bound of its own; others take that of all rows.
OWN_BOUND = 20
UNKNOWN = "und"
START, END = 1, 2


def held_out(doc_id):
    """crc32(doc_id as text) mod 5 = 0; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def letter_runs(chunk: str) -> list[str]:
    """The lower-cased runs of letters (Unicode category L) in chunk."""
    if chunk.isalpha():
        return [chunk.lower()]
    return [x.lower() for x in "".join(c if c.isalpha() else " " for c in chunk).split()]


def blocks(text: str, size: int = 1 << 20) -> Iterator[str]:
    """text in pieces of about size, cut at a space, so that what is held for one text stays bounded."""
    at = 0
    while len(text) - at > size:
        cut = text.find(" ", at + size)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text


def _events(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ORDER symbols, one for each letter and word end, and the row count of each word."""
    pad, end = chr(START) * (ORDER - 1), chr(END)
    flat = np.frombuffer("".join([f"{pad}{w}{end}" for w in words]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    spans = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.cumsum(spans + ORDER - 1) - (spans + ORDER - 1)
    first = np.repeat(starts - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
    return flat[first[:, None] + np.arange(ORDER)], spans


def _chains(symbols: np.ndarray, last: int, most: int) -> list[np.ndarray]:
    """Hashes of the 0 to most symbols that end at column last; longer ones extend shorter ones leftwards."""
    out = [np.full(len(symbols), np.uint64(11))]
    for i in range(most):
        out.append(mix64(out[-1] * np.uint64(0x9E3779B97F4A7C15) + symbols[:, last - i] + np.uint64(i)))
    return out


@dataclass
class LanguageModel:
    """langs; for each order n: sorted gram hashes with discounted probabilities, sorted context hashes with back-off weights."""

    langs: list[str]
    grams: list[np.ndarray]
    probs: list[np.ndarray]
    contexts: list[np.ndarray]
    backoff: list[np.ndarray]
    floor: float
    bound: np.ndarray | None = None  # (median, slack) for each language
    sharpness: float = 50.0

    def log_probability(self, symbols: np.ndarray) -> np.ndarray:
        """Natural log of p(last symbol | the others) for each row and language."""
        _, first, back = np.unique(_chains(symbols, ORDER - 1, ORDER)[-1], return_index=True, return_inverse=True)
        symbols = symbols[first]
        p = np.full((len(symbols), len(self.langs)), self.floor, np.float32)
        grams, contexts = _chains(symbols, ORDER - 1, ORDER), _chains(symbols, ORDER - 2, ORDER - 1)
        for n in range(1, ORDER + 1):
            p *= _lookup(self.contexts[n - 1], self.backoff[n - 1], contexts[n - 1], 1.0) if n > 1 else self.backoff[0]
            p += _lookup(self.grams[n - 1], self.probs[n - 1], grams[n], 0.0)
        return np.log(p)[back]


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    if not len(keys):
        return np.full((len(wanted), values.shape[1]), missing, np.float32)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    out = values[at]
    out[keys[at] != wanted] = missing
    return out


def build(langs: list[str], lang: np.ndarray, symbols: np.ndarray, count: np.ndarray) -> LanguageModel:
    """Kneser-Ney from distinct (lang, ORDER symbols) with counts; lower orders count the distinct grams they end."""
    width = len(langs)
    # the lower orders are held as (language, suffix) types; each is reached from the next higher order's types
    rows, value, who = symbols, count.astype(np.float64), lang
    grams, probs, contexts, backoff, alphabet = [], [], [], [], len(np.unique(symbols[:, -1])) + 1
    for n in range(ORDER, 0, -1):
        ends = _chains(rows, ORDER - 1, n)
        gram, ctx = ends[n], _chains(rows, ORDER - 2, n - 1)[n - 1]
        top = np.zeros(width)
        for k in range(width):
            v = value[who == k]
            one, two = (v == 1).sum(), (v == 2).sum()
            top[k] = one / (one + 2 * two) if one and two else 0.5
        ctx_keys, ctx_at = np.unique(ctx, return_inverse=True)
        total, kinds = np.zeros((len(ctx_keys), width)), np.zeros((len(ctx_keys), width))
        np.add.at(total, (ctx_at, who), value)
        np.add.at(kinds, (ctx_at, who), 1.0)
        weight = np.where(total > 0, top * kinds / np.maximum(total, 1), 1.0)
        keys, at = np.unique(gram, return_inverse=True)
        p = np.zeros((len(keys), width))
        p[at, who] = np.maximum(value - top[who], 0) / total[ctx_at, who]
        grams.append(keys), probs.append(p.astype(np.float32))
        contexts.append(ctx_keys), backoff.append((weight if n > 1 else weight[0]).astype(np.float32))
        if n > 1:  # continuation counts for the next lower order
            _, first, kinds_of = np.unique(mix64(ends[n - 1] + who.astype(np.uint64)), return_index=True, return_counts=True)
            rows, value, who = rows[first], kinds_of.astype(np.float64), who[first]
    for x in (grams, probs, contexts, backoff):
        x.reverse()
    return LanguageModel(langs, grams, probs, contexts, backoff, 1.0 / alphabet)


class _Scorer:
    """Log probabilities of chunks (what stands between white space), remembered in one growing table that is emptied when large."""

    def __init__(self, model: LanguageModel, most: int = 600_000):
        self.model, self.most = model, most
        self.at: dict[str, int] = {}
        self.table = np.zeros((0, len(model.langs) + 1), np.float32)

    def _learn(self, new: list[str]) -> None:
        runs = [letter_runs(c) for c in new]
        rows = np.zeros((len(new), len(self.model.langs) + 1))
        flat = [w for r in runs for w in r]
        owner = np.repeat(np.arange(len(new)), [len(r) for r in runs])
        at = 0
        while at < len(flat):  # by blocks of about 60 000 letters
            upto, size = at, 0
            while upto < len(flat) and size < 60_000:
                size += len(flat[upto])
                upto += 1
            symbols, spans = _events(flat[at:upto])
            who = np.repeat(owner[at:upto], spans)
            first = np.flatnonzero(np.diff(who, prepend=-1))
            rows[who[first], :-1] += np.add.reduceat(self.model.log_probability(symbols), first, axis=0, dtype=np.float64)
            rows[who[first], -1] += np.diff(first, append=len(who))
            at = upto
        self.at.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
        self.table = np.concatenate([self.table, rows.astype(np.float32)])

    def _make_room(self, chunks: set[str]) -> None:
        """Learn those of chunks that are not known, after forgetting all if they would be too many."""
        new = chunks.difference(self.at)
        if len(self.at) + len(new) > self.most:
            self.at, self.table, new = {}, self.table[:0], chunks
        if new:
            self._learn(sorted(new))

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """For each text the summed log probability for each language and, last, the number of events."""
        out = np.zeros((len(texts), len(self.model.langs) + 1))
        for i, text in enumerate(texts):
            for piece in blocks(text or ""):
                parts = piece.split()
                try:
                    at = np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))
                except KeyError:
                    self._make_room(set(parts))
                    at = np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))
                for k in range(0, len(at), 1 << 16):
                    out[i] += self.table[at[k : k + (1 << 16)]].sum(axis=0, dtype=np.float64)
        return out

    def batch(self, texts: list[str | None]) -> np.ndarray:
        """As a call, but what all texts have new is learned at once."""
        self._make_room(set().union(*[t.split() for t in texts if t and len(t) < 1 << 20]))
        return self(texts)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of each part of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1000):
            chunks: dict[str, Counter] = {}
            for text, lang in zip(batch.column(0).slice(at, 1000).to_pylist(), batch.column(1).slice(at, 1000).to_pylist(), strict=True):
                chunks.setdefault(lang, Counter()).update(c for b in blocks(text) for c in b.split())
            for lang, seen in chunks.items():
                words: Counter = Counter()
                for chunk, n in seen.items():
                    for w in letter_runs(chunk):
                        words[w] += n
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "word", "n"])


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, s0 .. s4, n) of words, summed over each part of a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, 20_000):
            part = batch.slice(at, 20_000)
            symbols, spans = _events(part.column(1).to_pylist())
            n = np.repeat(part.column(2).to_numpy(), spans)
            names, code = np.unique(np.array(part.column(0).to_pylist(), object).astype(str), return_inverse=True)
            code = np.repeat(code, spans)
            _, first, where = np.unique(mix64(_chains(symbols, ORDER - 1, ORDER)[-1] + code.astype(np.uint64)), return_index=True, return_inverse=True)
            total = np.bincount(where.ravel(), weights=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(names[code[first]].tolist(), pa.string()), *[pa.array(symbols[first, k].astype(np.int32)) for k in range(ORDER)], pa.array(total)], names=["lang", *[f"s{k}" for k in range(ORDER)], "n"])


def sampled(key, seed: int, share: float):
    """A condition that holds for share of the keys, by their hash; exact to 2^-62, so no share is rounded to nothing."""
    return F.xxhash64(key, F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1)) < F.lit(min(int(share * (1 << 62)) + 1, (1 << 62) - 1) if share < 1 else 1 << 62)


def train(docs: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_chars: int = MAX_TRAINING_CHARS) -> LanguageModel:
    """Fit on text and lang of the rows of docs with a non-null doc_id, text and lang that are not held out.

    About max_rows rows and max_chars characters at most, by the hash of doc_id; a tenth of the rows calibrates. The counts are summed in Spark; the driver gets the distinct ORDER-grams of that bounded sample. No training row: a model without languages, which predicts ``und``.
    """
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & F.col("lang").isNotNull())
    size = rows.agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    share = min(1.0, max_rows / max(size["n"], 1), max_chars / max(size["chars"] or 0, 1))
    sample = rows.where(sampled("doc_id", 1, share)).select("doc_id", "text", "lang")
    fitting = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(10)) > 0
    words = sample.where(fitting).select("text", "lang").mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    columns = ["lang", *[f"s{k}" for k in range(ORDER)]]
    grams = words.mapInArrow(_gram_counts, f"lang string, {', '.join(f's{k} int' for k in range(ORDER))}, n long").groupBy(*columns).agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(grams.column("lang").to_pylist()))
    if not langs:
        empty = np.zeros(0, np.uint64)
        return LanguageModel([], [empty] * ORDER, [np.zeros((0, 0))] * ORDER, [empty] * ORDER, [np.zeros((0, 0))] * ORDER, 1.0)
    code = {x: i for i, x in enumerate(langs)}
    who = np.array([code[x] for x in grams.column("lang").to_pylist()], np.int64)
    model = build(langs, who, np.stack([grams.column(f"s{k}").to_numpy().astype(np.uint64) for k in range(ORDER)], axis=1), grams.column("n").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(model)
    width = len(langs)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                got = scorer.batch(batch.column(0).slice(at, 500).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(at, 500), pa.array(list(got))], names=["lang", "sums"])

    check = sample.where(~fitting).select("text", "lang").mapInArrow(score, "lang string, sums array<double>").toArrow()
    shared.unpersist()
    if check.num_rows:
        _calibrate(model, np.array([code.get(x, -1) for x in check.column("lang").to_pylist()]), np.array(check.column("sums").to_pylist()).reshape(-1, width + 1))
    return model


def _calibrate(model: LanguageModel, who: np.ndarray, sums: np.ndarray) -> None:
    """Rejection: the least cross-entropy may exceed the language's median by the greatest excess seen, doubled, more for short texts. Sharpness: greatest likelihood.

    Of m rows like those seen, less than one in m + 1 is expected beyond the greatest excess; doubling leaves room for rows unlike them. A language with fewer than OWN_BOUND rows here takes the median and excess of all rows together. Without any row nothing is rejected by a bound.
    """
    seen = (sums[:, -1] > 0) & (who >= 0)
    who, sums = who[seen], sums[seen]
    if not len(who):
        return
    n = sums[:, -1:]
    cross = -sums[:, :-1] / n
    own = cross[np.arange(len(who)), who]
    model.bound = np.empty((len(model.langs), 2))
    for k in range(len(model.langs)):
        mine = who == k if (who == k).sum() >= OWN_BOUND else np.ones(len(who), bool)
        middle = np.median(own[mine])
        model.bound[k] = middle, 2 * np.max((own[mine] - middle) * np.sqrt(np.minimum(n[mine, 0], 400)))
    best = (np.inf, model.sharpness)
    for sharp in (2.0, 5.0, 10.0, 20.0, 50.0, 100.0):
        z = -cross * sharp
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z[np.arange(len(who)), who]) / np.exp(z).sum(axis=1)
        best = min(best, (-np.log(np.maximum(p, 1e-12)).mean(), sharp))
    model.sharpness = best[1]


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """docs with lang_pred string, score double, cross_entropy double, rejected boolean.

    docs needs a column text; a column of docs that has one of these names is replaced. A null text and one without a letter (empty, digits) have lang_pred ``und``, score 0, a null cross_entropy and are rejected; so are all rows if the model knows no language. rejected is also true where the cross-entropy is beyond the calibrated bound. Ties go to the language first in order. Repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score", "cross_entropy", "rejected")
    names, at = docs.columns, docs.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        scorer = _Scorer(model) if model.langs else None
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                lang, score, ce, out = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows, [None] * part.num_rows, [True] * part.num_rows
                sums = scorer.batch(part.column(at).to_pylist()) if scorer else np.zeros((part.num_rows, 1))
                for i in np.flatnonzero(sums[:, -1] > 0):
                    cross = -sums[i, :-1] / sums[i, -1]
                    k = int(cross.argmin())
                    e = np.exp(-(cross - cross[k]) * model.sharpness)
                    lang[i], score[i], ce[i] = model.langs[k], float(1 / e.sum()), float(cross[k])
                    out[i] = bool(model.bound is not None and cross[k] - model.bound[k, 0] > model.bound[k, 1] / np.sqrt(min(sums[i, -1], 400)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ce, pa.float64()), pa.array(out, pa.bool_())], names=[*names, "lang_pred", "score", "cross_entropy", "rejected"])

    from pyspark.sql import types as T

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(predict, schema)
