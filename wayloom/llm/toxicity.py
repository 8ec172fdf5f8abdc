"""Toxicity by weak supervision: voters, a generative label model, and a linear classifier of its posterior labels.

Features of a text are its distinct words (lower-cased runs of letters, common letter substitutes undone) and the beginnings of longer words. The labelled training rows yield the features that go with toxic rows; those that stand in the same texts, as a word and its beginnings do, stay together, and are dealt over several lexicon voters. Joined by pattern voters they vote toxic, clean or abstain on labelled and unlabelled rows alike. A generative model of the votes estimates each voter's accuracy and the correlations between voters by expectation-maximisation; the labels only say where it starts. Voters that move together share their weight. Its posterior labels train a logistic classifier over the hashed features, which alone scores texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayloom.llm.common import remove, written
from wayloom.llm.langid import blocks, held_out, sampled

#: Labelled training rows used at most; beyond it a sample chosen by the hash of doc_id.
MAX_TRAINING_ROWS = 40_000
#: Further training rows whose labels, if any, are not looked at, chosen likewise.
MAX_UNLABELLED_ROWS = 20_000
HASH_BITS = 20
#: Features kept for the voters and the classifier.
FEATURES = 4096
LEXICONS = 32
#: Features at most in the lexicons, and the share of common texts above which two of them stay together.
LEXICON_FEATURES, TOGETHER = 512, 0.7
PREFIXES = (4, 5, 6, 7, 8)
# fixed values: letters that stand in for others
SUBSTITUTES = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
# fixed values: patterns of insults and threats
PATTERNS = (
    re.compile(r"\b(?:you|u|ur|you're|youre|he|she|they)\s+(?:\w+\s+){0,3}(?:idiot|moron|loser|scum|trash|clown|stupid|worthless|pathetic|disgusting)s?\b"),
    re.compile(r"\b(?:hate|kill|hurt|destroy)\s+(?:you|him|her|them|yourself)\b"),
    re.compile(r"\b(?:idiot|moron|loser|scum|trash|clown|stupid|worthless|pathetic|disgusting)(?:s|ic|ity)?\b"),
)
VOTERS = LEXICONS + len(PATTERNS)


def words_of(chunk: str) -> list[str]:
    """The words of what stands between white space: runs of letters, lower-cased; substitutes are undone inside a run that has a letter on both sides."""
    low = chunk.lower()
    if low.isalpha():
        return [low]
    plain = "".join(c if c.isalpha() else " " for c in low).split()
    inner = low.strip("!\"#%&'()*,-./:;<=>?[]^_`{|}~")
    swapped = inner.translate(SUBSTITUTES)
    if swapped != inner and swapped.isalpha() and any(c.isalpha() for c in inner):
        plain.append(swapped)
    joined = re.sub(r"[-.*_]", "", inner)
    if joined != inner and joined.isalpha() and len(plain) > 2 and all(len(p) == 1 for p in plain):
        plain.append(joined)  # letters set apart
    return plain


def features_of(word: str) -> list[int]:
    """Hashed features of a word: itself and its proper beginnings."""
    mask = (1 << HASH_BITS) - 1
    return [xxhash.xxh3_64_intdigest(f"={word}") & mask] + [xxhash.xxh3_64_intdigest(f"^{word[:n]}") & mask for n in PREFIXES if len(word) > n]


class _Features(dict):
    """Chunk to the tuple of its features (of those in wanted, if given), remembered; emptied when large."""

    def __init__(self, wanted: np.ndarray | None = None):
        super().__init__()
        self.wanted = None if wanted is None else {int(f): i for i, f in enumerate(wanted)}

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        if len(self) > 400_000:
            self.clear()
        found = {f for w in words_of(chunk) for f in features_of(w)}
        if self.wanted is not None:
            found = {self.wanted[f] for f in found if f in self.wanted}
        got = self[chunk] = tuple(sorted(found))
        return got

    def of(self, text: str | None) -> set[int]:
        out: set[int] = set()
        for piece in blocks(text or ""):
            for got in map(self.__getitem__, set(piece.split())):
                if got:
                    out.update(got)
        return out


@dataclass
class ToxicityModel:
    """Hashed features with their weights and the intercept; what the label model estimated of each voter."""

    features: np.ndarray
    weights: np.ndarray
    intercept: float
    accuracies: np.ndarray
    correlations: np.ndarray


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic rows, clean rows) of a task; at most 2^HASH_BITS rows."""
    seen, total = _Features(), np.zeros((2, 1 << HASH_BITS), np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            own = seen.of(text.as_py())
            total[0 if toxic else 1, np.fromiter(own, np.int64, len(own))] += 1
    at = np.flatnonzero(total.any(axis=0))
    for k in range(0, len(at), 100_000):
        part = at[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[0, part]), pa.array(total[1, part])], names=["feature", "pos", "neg"])


def _examples(wanted: np.ndarray):
    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Features(wanted)
        for batch in batches:
            own, shapes = [], []
            for text in batch.column(0):
                text = text.as_py() or ""
                own.append(sorted(seen.of(text)))
                low = text.lower()
                shapes.append([int(bool(p.search(low))) for p in PATTERNS])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(own, pa.list_(pa.int32())), pa.array(shapes, pa.list_(pa.int32()))], names=["toxic", "own", "shapes"])

    return examples


def label_model(votes: np.ndarray, toxic: np.ndarray, rounds: int = 50, gold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior P(toxic) for each row, accuracy P(vote right | voted) and correlations of the voters.

    votes: 1 toxic, -1 clean, 0 abstain; toxic: 1, 0, or -1 where it isn't known. Each voter has a vote distribution for each class. Correlations are those of the votes' residuals given the class; a voter's log-likelihood counts 1 / (sum of squared correlations with all voters), so a block of copies counts once. Known labels only set the first posterior, unless gold is true: then they count as one more voter, right in 95 of 100 cases.
    """
    n, m = votes.shape
    shape = (votes + 1).astype(np.int64)  # 0 clean, 1 abstain, 2 toxic
    q = np.where(toxic < 0, 0.5 * (votes.max(axis=1, initial=0) > 0) + 0.1, np.clip(toxic, 0.05, 0.95)).astype(np.float64)
    share, corr = np.ones(m), np.eye(m)
    for _ in range(rounds):
        prior = np.clip(q.mean(), 1e-3, 1 - 1e-3)
        table = np.stack([[np.bincount(shape[:, j], weights=w, minlength=3) + 0.5 for j in range(m)] for w in (1 - q, q)])
        table /= table.sum(axis=2, keepdims=True)
        mean = table @ np.array([-1.0, 0.0, 1.0])
        rest = votes - (mean[0][None, :] * (1 - q)[:, None] + mean[1][None, :] * q[:, None])
        cov = rest.T @ rest / max(n, 1) + 1e-9 * np.eye(m)
        d = np.sqrt(np.diag(cov))
        corr = cov / np.outer(d, d)
        share = 1 / np.square(corr).sum(axis=1)
        ll = np.log(prior / (1 - prior)) + sum(share[j] * np.log(table[1, j] / table[0, j])[shape[:, j]] for j in range(m))
        if gold:
            ll += np.where(toxic < 0, 0, np.where(toxic > 0, 1, -1) * np.log(19))
        new = 1 / (1 + np.exp(-np.clip(ll, -30, 30)))
        if np.abs(new - q).max(initial=0) < 1e-6:
            break
        q = new
    right = ((votes > 0) * q[:, None] + (votes < 0) * (1 - q)[:, None]).sum(axis=0) / np.maximum((votes != 0).sum(axis=0), 1)
    return q, right, corr


def dealt(rows: list[np.ndarray], strong: np.ndarray, lexicons: int = LEXICONS) -> np.ndarray:
    """The lexicon of each of strong (feature numbers, best first): features that stand in mostly the same rows form a unit, units are dealt in turn."""
    place = np.full(max((int(x.max()) for x in rows if len(x)), default=-1) + 1, -1)
    strong = np.asarray(strong)
    place[strong[strong < len(place)]] = np.flatnonzero(strong < len(place))
    both = np.zeros((len(strong), len(strong)))
    for k in range(0, len(rows), 8192):
        dense = np.zeros((min(8192, len(rows) - k), len(strong)), np.float32)
        for i, x in enumerate(rows[k : k + 8192]):
            own = place[x]
            dense[i, own[own >= 0]] = 1
        both += dense.T @ dense
    size = np.diag(both)
    alike = both / np.maximum(size[:, None] + size[None] - both, 1)
    unit = np.full(len(strong), -1)
    n = 0
    for k in range(len(strong)):
        if unit[k] < 0:
            unit[(alike[k] >= TOGETHER) & (unit < 0)] = n
            unit[k] = n
            n += 1
    return unit % lexicons


def _logistic(rows: list[np.ndarray], target: np.ndarray, width: int, l2: float = 0.5, steps: int = 300) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on soft targets over binary features, by accelerated gradient steps scaled for each feature."""
    length = np.fromiter(map(len, rows), np.int64, len(rows))
    col = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(rows)), length)
    w, b = np.zeros(width), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    scale = 1 / (0.25 * np.bincount(col, weights=length[row], minlength=width) + l2)
    step_b = 4 / max(len(rows), 1)
    v, vb, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(vb + np.bincount(row, weights=v[col], minlength=len(rows)), -30, 30)))
        g = p - target
        new = v - scale * (np.bincount(col, weights=g[row], minlength=width) + l2 * v)
        new_b = vb - 0.2 * step_b * g.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    return w, b


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS, max_unlabelled: int = MAX_UNLABELLED_ROWS, gold: bool = False) -> ToxicityModel:
    """Fit on text of docs and toxic of labels, over rows that are not held out.

    At most about max_rows labelled rows and max_unlabelled others, by the hash of doc_id; the ids and labels of the former, which that bounds, are broadcast, so no text is shuffled. The sample is written once. The driver gets FEATURES features, and of each sampled row the indices of those it has. gold lets labels vote in the label model. Without a labelled row, or with one class only, the model scores every text by the share of toxic rows.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(sampled("doc_id", 3, min(1.0, max_rows / max(known.count(), 1)))).select(F.col("doc_id").alias("known_id"), "toxic")
    rows = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text")
    others = sampled("doc_id", 4, min(1.0, max_unlabelled / max(docs.select("doc_id").count(), 1)))
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("known_id"), "left").where(F.col("toxic").isNotNull() | others)
    rows = written(rows.select("text", F.coalesce(F.sign("toxic").cast("int"), F.lit(-1)).alias("toxic")), "toxicity_sample")
    size = rows.where("toxic >= 0").agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    p, total = float(size["p"] or 0), float(size["n"] or 0)
    rate = (p + 0.5) / (total + 1)
    empty = np.zeros(0)
    if not p or p == total:
        remove(docs.sparkSession, rows.path)
        return ToxicityModel(empty.astype(np.int64), empty, float(np.log(rate / (1 - rate))), empty, empty)
    counts = rows.where("toxic >= 0").mapInArrow(_counts, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    expected = (F.col("pos") + F.col("neg")) * F.lit(p / total)
    scored = counts.where("pos + neg >= 4").withColumn("z", (F.col("pos") - expected) / F.sqrt(expected * (1 - p / total) + 1))
    # a feature counts by how far its toxic share stands out, the more so where it is pure
    top = scored.where("z > 2").orderBy(F.desc(F.col("z") * F.col("pos") / (F.col("pos") + F.col("neg"))), "feature").limit(FEATURES).toPandas()
    wanted = top["feature"].to_numpy(np.int64)
    pure = (top["pos"] / (top["pos"] + top["neg"] + 1)).to_numpy()
    strong = np.flatnonzero((pure > 0.6) & (top["z"].to_numpy() > 4))[:LEXICON_FEATURES]
    got = rows.mapInArrow(_examples(wanted), "toxic int, own array<int>, shapes array<int>").toArrow()
    remove(docs.sparkSession, rows.path)
    own = [np.array(x, np.int64) for x in got.column("own").to_pylist()]
    toxic = np.array(got.column("toxic").to_pylist(), np.int64)
    group = np.full(len(wanted), -1)
    group[strong] = dealt(own, strong)
    votes = np.zeros((len(own), VOTERS), np.int8)
    for i, x in enumerate(own):
        g = group[x]
        votes[i, g[g >= 0]] = 1
    votes[:, LEXICONS:] = np.array(got.column("shapes").to_pylist(), np.int8).reshape(-1, len(PATTERNS))
    posterior, right, corr = label_model(votes, toxic, gold=gold)
    weights, intercept = _logistic(own, posterior, len(wanted))
    return ToxicityModel(wanted, weights, intercept, right, corr)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """docs with score double in 0 to 1 and predicted int (score >= 0.5).

    docs needs a column text; columns of docs named score or predicted are replaced. A null or empty text, or one without a word, has no feature and gets the score of the intercept. Whole texts count, in blocks. Repeated rows are scored alike.
    """
    docs = docs.drop("score", "predicted")
    names, at = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        seen = _Features(model.features)
        for batch in batches:
            out = np.empty(batch.num_rows)
            for i, text in enumerate(batch.column(at)):
                own = seen.of(text.as_py())
                out[i] = model.intercept + model.weights[np.fromiter(own, np.int64, len(own))].sum()
            out = 1 / (1 + np.exp(-np.clip(out, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out), pa.array((out >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(predict, schema)
