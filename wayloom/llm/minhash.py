"""Near-duplicate documents by MinHash bands, odd sketches and an exact check of whole shingle sets.

Stages: every text becomes its set of distinct word shingles (as 64-bit hashes), a MinHash sample, band keys and an odd sketch, the parity bitmap of the hashed sample (Mitzenmacher, Pagh and Pham, 2014). Documents with equal sets are one class. Within a band key each class is compared with the least class of that key (a star, so linear in the key's size); components that remain apart but have near sketches somewhere form a group, within which tiles of bounded size compare full sets. The XOR population count of two odd sketches gives a precise estimate at high similarity and drops most candidates; every link is checked on the full sets, and a tile returns no more pairs than it needs to join its components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.llm.common import MIX_A, connected_components, join_split, mix64, remove, written

BANDS, ROWS, SKETCH_BITS = 32, 4, 512
#: Chance at most that a pair at the threshold lies beyond the sketches' limit: of the sample and the sketch together.
MISS = 1e-9
#: Texts of keys that hold many pairs are broadcast up to so many bytes each, at most HOT_KEYS of them.
HOT_TEXT = 1 << 16
#: Rows without a text that a row with one counts as, when tables are dealt to files.
TEXT_ROWS = 8
#: Most rows, on average, of one side of a tile.
TILE = 256


class _WordHashes(dict):
    """64-bit hash of a word (bytes), remembered; emptied when it has grown large, so memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str | None, width: int, words: _WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the width-word shingles of text.

    A-Z are lower-cased; words are runs of anything but the bytes 0x20 and 0x09-0x0D. Fewer words than width: the whole sequence is one shingle. No text or no word: empty.
    """
    parts = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not parts:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, parts), np.uint64, len(parts))
    take = min(width, len(h))
    n = len(h) - take + 1
    out = np.full(n, np.uint64(take))
    for i in range(take):
        out = mix64(out * MIX_A + h[i : i + n])
    return np.unique(out)


def _parameters(seed: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64) * MIX_A + np.uint64(seed))
    return x[:count] | np.uint64(1), x[count:]


def minhash_sample(hashes: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the set, by blocks so that memory is bounded."""
    low = np.full(len(mul), np.uint64(2**64 - 1))
    for i in range(0, len(hashes), 2048):
        block = np.multiply.outer(hashes[i : i + 2048], mul)
        block += add
        np.minimum(low, block.min(axis=0), out=low)
    return low


def odd_sketch(sample: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmap: each (index, value) of the sample toggles one bit; returned as int64 words."""
    at = mix64(sample ^ (np.arange(len(sample), dtype=np.uint64) * MIX_A)) % np.uint64(bits)
    parity = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64)


def least_passing_distance(threshold: float, samples: int, bits: int, miss: float = MISS) -> int:
    """The least limit that the XOR population count of a pair at threshold exceeds with a chance under miss.

    Each of the samples differs with probability 1 - threshold and then toggles two bits of the XOR, each at a place drawn evenly; the sum over both draws is exact.
    """
    odd = np.zeros(bits + 1)
    odd[0] = 1
    total, k = np.zeros(bits + 1), np.arange(bits + 1)
    for differ in range(samples + 1):
        total += math.comb(samples, differ) * (1 - threshold) ** differ * threshold ** (samples - differ) * odd
        for _ in range(2):
            up, down = odd * (bits - k) / bits, odd * k / bits
            odd = np.concatenate([[0], up[:-1]]) + np.concatenate([down[1:], [0]])
    beyond = np.cumsum(total[::-1])[::-1]  # chance of k or more
    return int(np.flatnonzero(np.append(beyond[1:], 0) < miss)[0])


def _signer(width: int, bands: int, rows: int, bits: int, seed: int):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, (mul, add) = _WordHashes(), _parameters(seed, bands * rows)
        band_seed = mix64(np.arange(bands, dtype=np.uint64) * MIX_A + np.uint64(seed))
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                n, set_a, set_b, keys, sketches = [], [], [], [], []
                for text in part.column(1):
                    h = shingle_hashes(text.as_py(), width, words)
                    n.append(len(h))
                    if not len(h):
                        set_a.append(0), set_b.append(0), keys.append(None), sketches.append(None)
                        continue
                    digest = np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                    set_a.append(int(digest[0])), set_b.append(int(digest[1]))
                    sample = minhash_sample(h, mul, add)
                    key = band_seed.copy()
                    for r in range(rows):
                        key = mix64(key * MIX_A + sample[r::rows])
                    keys.append(key.view(np.int64))
                    sketches.append(odd_sketch(sample, bits))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(n, pa.int64()), pa.array(set_a, pa.int64()), pa.array(set_b, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))], names=["doc_id", "text_id", "n_shingles", "set_a", "set_b", "keys", "sketch"])

    return sign


def _verifier(width: int, percent: int, most: int = 1_000_000):
    """Keeps the pairs whose full sets have 100 * intersection >= percent * union. Sets of b are remembered, as many as have most hashes together."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kept, held = _WordHashes(), {}, 0
        for batch in batches:
            a, b, text_a, text_b = (batch.column(i) for i in range(4))
            good = np.zeros(batch.num_rows, bool)
            for i, key in enumerate(b.to_pylist()):
                if (other := kept.get(key)) is None:
                    if held > most:
                        kept, held = {}, 0
                    other = kept[key] = shingle_hashes(text_b[i].as_py(), width, words)
                    held += len(other)
                own = shingle_hashes(text_a[i].as_py(), width, words)
                both = len(own) + len(other) - len(np.unique(np.concatenate([own, other])))
                good[i] = 100 * both >= percent * (len(own) + len(other) - both)
            mask = pa.array(good)
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    return verify


def _confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) that hold on full sets; pairs is a written table, in which b may be the same in many rows."""
    with_a = pairs.join(texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), "a")
    often = pairs.groupBy("b").agg(F.count("*").alias("n"))
    other = often.join(texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")), "b")
    both = join_split(with_a, other, ["b"], "n", pairs.count(), f"octet_length(text_b) <= {HOT_TEXT}")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(_verifier(width, percent), "a long, b long")


def _find(root: dict[int, int], x: int) -> int:
    while (up := root.get(x, x)) != x:
        root[x] = root.get(up, up)
        x = up
    return x


def _forest(root: dict[int, int], ones, twos) -> list[int]:
    """Places of the pairs that join what root holds apart, in the order given; root takes them in."""
    keep = []
    for k, (x, y) in enumerate(zip(ones.tolist(), twos.tolist(), strict=True)):
        p, q = _find(root, x), _find(root, y)
        if p != q:
            root[max(p, q)] = min(p, q)
            keep.append(k)
    return keep


def _by_tile(found, n_keys: int = 3):
    """Arrow mapper: calls found on the table of each tile (equal first n_keys columns, by which rows come sorted) and returns its pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out(table: pa.Table) -> pa.RecordBatch:
            keys = [table.column(k).to_numpy() for k in range(n_keys)]
            cut = np.flatnonzero(np.logical_or.reduce([np.diff(k) != 0 for k in keys])) + 1
            pairs = [found(table.slice(x, y - x)) for x, y in zip([0, *cut.tolist()], [*cut.tolist(), table.num_rows], strict=True)]
            pairs = np.unique(np.concatenate(pairs), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = [batch.column(k)[-1].as_py() for k in range(n_keys)]
            if [held[0].column(k)[0].as_py() for k in range(n_keys)] == last:
                continue  # one tile so far; tiles are of bounded size
            table = pa.Table.from_batches(held).combine_chunks()
            same = np.logical_and.reduce([table.column(k).to_numpy() == v for k, v in enumerate(last)])
            first = int(np.flatnonzero(~same)[-1]) + 1
            yield out(table.slice(0, first))
            held = table.slice(first).combine_chunks().to_batches()
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks())

    return run


_NONE = np.empty((0, 2), np.int64)


def _near_sketches(limit: int):
    """Of a tile (key, i, j, side, doc, comp, leader, sketch words): pairs of components, a forest of those with near sketches.

    Pairs with the key's leader have been checked before.
    """

    def found(tile: pa.Table) -> np.ndarray:
        side, doc, comp, lead = (tile.column(k).to_numpy() for k in ("side", "doc", "comp", "leader"))
        if comp.min() == comp.max():
            return _NONE
        same = tile.column("i")[0].as_py() == tile.column("j")[0].as_py()
        one, two = (np.arange(len(doc)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        far = np.zeros((len(one), len(two)), np.int16)
        for name in tile.schema.names[7:]:
            word = tile.column(name).to_numpy().view(np.uint64)
            far += np.bitwise_count(word[one][:, None] ^ word[two][None, :])
        ok = (far <= limit) & (comp[one][:, None] != comp[two][None, :]) & (doc[one] != lead[one])[:, None] & (doc[two] != lead[two])[None, :]
        i, j = np.nonzero(ok)
        ones, twos = comp[one[i]], comp[two[j]]
        keep = _forest({}, ones, twos)
        return np.stack([ones[keep], twos[keep]], axis=1)

    return found


def _linked_sets(width: int, percent: int, block: int = 8192):
    """Of a tile (group, i, j, side, doc, comp, text): links between components, a forest of those that hold on full sets.

    The intersections of all pairs come from a product of 0/1 matrices over the shingles that stand on both sides, by blocks of columns.
    """

    def found(tile: pa.Table) -> np.ndarray:
        side, doc, comp = (tile.column(k).to_numpy() for k in ("side", "doc", "comp"))
        if comp.min() == comp.max():
            return _NONE
        words = _WordHashes()
        sets = [shingle_hashes(t.as_py(), width, words) for t in tile.column("text")]
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        same = tile.column("i")[0].as_py() == tile.column("j")[0].as_py()
        one, two = (np.arange(len(doc)),) * 2 if same else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        if not len(one) or not len(two):
            return _NONE
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
        values, at, count = np.unique(flat, return_inverse=True, return_counts=True)
        wanted = np.flatnonzero(count > 1)
        place = np.full(len(values), -1)
        place[wanted] = np.arange(len(wanted))
        at = place[at]
        both = np.zeros((len(one), len(two)), np.float32)
        for k in range(0, len(wanted), block):
            dense = np.zeros((len(sets), min(block, len(wanted) - k)), np.float32)
            own = (at >= k) & (at < k + block)
            dense[owner[own], at[own] - k] = 1
            both += dense[one] @ dense[two].T
        both = both.astype(np.int64)
        ok = (100 * both >= percent * (size[one][:, None] + size[two][None, :] - both)) & (comp[one][:, None] != comp[two][None, :])
        i, j = np.nonzero(ok)
        keep = _forest({}, comp[one[i]], comp[two[j]])
        return np.stack([doc[one[i[keep]]], doc[two[j[keep]]]], axis=1)

    return found


def _tiles(rows: DataFrame, chunk, chunks, reach) -> DataFrame:
    """rows dealt to the tiles (key, i, j) of their chunk with each chunk under reach; side tells the chunk i from j."""
    dealt = rows.withColumn("c", chunk.cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("c") < reach, chunks).otherwise(reach).cast("int") - 1)))
    return dealt.withColumn("i", F.least("c", "other")).withColumn("j", F.greatest("c", "other")).withColumn("side", (F.col("c") > F.col("other")).cast("int"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = SKETCH_BITS, seed: int = 7) -> DataFrame:
    """One row per row of docs (doc_id long, text string): doc_id, n_shingles, component_id, kept.

    Documents link when 100 * |A and B| >= percent * |A or B| over their sets of width-word shingles, held as 64-bit hashes. component_id is the least doc_id reachable over links, the own one included; kept is doc_id = component_id.
    Null and empty texts and texts without a word have n_shingles 0 and link with nothing. Rows with a null doc_id link with nothing either; their component_id is null and kept is true. Repeated rows each return a row; rows with the same doc_id are one document, so what links with any of their texts shares their component. Other columns are ignored. An empty table returns no row.
    The chance that the bands miss a pair at the threshold is under 1e-7 (0.8: (1 - 0.8^4)^32 = 5e-8), that the sketches drop it under MISS.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("text_id", F.xxhash64("text"))
    spark, limit, n_words = docs.sparkSession, least_passing_distance(percent / 100, bands * rows, bits), bits // 64
    schema = "doc_id long, text_id long, n_shingles long, set_a long, set_b long, keys array<long>, sketch array<long>"
    signed = written(texts.select("doc_id", "text", "text_id").mapInArrow(_signer(width, bands, rows, bits, seed), schema), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    n_signed = signed.count()
    # a class is what has equal sets; doc is its number from here on, first the least row that has it
    first = F.min(F.struct("doc_id", "text_id", "keys", "sketch")).alias("first")
    classes = written(some.groupBy("set_a", "set_b").agg(first, F.count("*").alias("n")).withColumn("doc", F.monotonically_increasing_id()), "classes", n_signed)
    sketches = classes.select("doc", *[F.col("first.sketch")[w].alias(f"s_{w}") for w in range(n_words)])
    member = classes.select("doc", F.explode("first.keys").alias("key"))
    shared = member.groupBy("key").agg(F.count("*").alias("n"), F.count("*").alias("size"), F.min("doc").alias("leader")).where("n > 1")
    n_classes, n_rows = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    member = written(join_split(member, shared, ["key"], "n", n_classes * bands).where("leader is not null"), "members", n_classes)
    n_members = member.count()

    needed = classes.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_id").alias("text_id"), "doc").join(member.select("doc").distinct(), "doc")
    held = written(texts.join(needed, ["doc_id", "text_id"]).dropDuplicates(["doc"]).select("doc", "text"), "texts", TEXT_ROWS * n_classes)

    star = written(member.where("doc <> leader").select(F.col("doc").alias("a"), F.col("leader").alias("b")).distinct(), "star", n_members)
    n_star = star.count()
    side = lambda of, extra=(): sketches.select(F.col("doc").alias(of), *[F.col(f"s_{w}").alias(f"{of}_{w}") for w in range(n_words)], *extra)
    other = star.groupBy("b").agg(F.count("*").alias("n")).join(side("b"), "b")
    met = join_split(star.join(side("a"), "a"), other, ["b"], "n", n_star)
    far = sum((F.bit_count(F.col(f"a_{w}").bitwiseXOR(F.col(f"b_{w}"))) for w in range(n_words)), F.lit(0))
    near_leader = written(met.where(far <= limit).select("a", "b"), "near_leader", n_star)
    confirmed = written(_confirmed(near_leader, held, width, percent), "confirmed", TEXT_ROWS * near_leader.count())
    links = written(confirmed.unionByName(_same_documents(some, classes)), "links", n_signed)
    n_links = links.count()
    parts = written(connected_components(links, rows=n_links), "parts", 2 * n_links)

    # of keys that hold several components: which of these have near sketches anywhere
    at = written(member.where("size > 2").join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component"), "at")
    n_at = at.count()
    apart = at.groupBy("key").agg(F.min("comp").alias("p"), F.max("comp").alias("q"), F.count("*").alias("n")).where("p <> q").drop("q")
    chunks = F.ceil(F.col("size") / TILE).cast("int")
    rest = join_split(at, apart, ["key"], "n", n_at).where("p is not null").join(sketches, "doc")
    rest = _tiles(rest, F.pmod(F.xxhash64("doc"), chunks), chunks, chunks)
    rest = rest.select("key", "i", "j", "side", "doc", "comp", "leader", *[f"s_{w}" for w in range(n_words)])
    rest = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    near = written(rest.mapInArrow(_by_tile(_near_sketches(limit)), "a long, b long").distinct(), "near", n_at)
    spent = [member, star, near_leader, confirmed, at, near, held, links]
    if not near.isEmpty():
        # components that near sketches join are a group; in it, all but the largest component's documents meet all others with their full sets
        group = connected_components(near, rows=near.count()).select(F.col("node").alias("comp"), F.col("component").alias("group"))
        docs_of = member.select("doc").distinct().join(parts.withColumnRenamed("node", "doc"), "doc", "left").select("doc", F.coalesce("component", "doc").alias("comp"))
        sizes = group.join(docs_of.groupBy("comp").agg(F.count("*").alias("n")), "comp")
        largest = sizes.groupBy("group").agg(F.max(F.struct("n", "comp")).alias("most"), F.sum("n").alias("n")).select("group", F.col("most.comp").alias("major"), F.ceil(F.col("most.n") / TILE).alias("major_chunks"), F.ceil((F.col("n") - F.col("most.n")) / TILE).alias("minor_chunks"))
        of_comp = sizes.join(largest, "group")
        placed = written(join_split(docs_of, of_comp, ["comp"], "n", n_classes).where("group is not null"), "placed", n_classes)
        minor, salt = F.col("minor_chunks"), F.xxhash64("doc")
        chunk = F.when(F.col("comp") == F.col("major"), minor + F.pmod(salt, F.col("major_chunks"))).otherwise(F.pmod(salt, minor))
        rest = _tiles(placed.join(held, "doc"), chunk, minor + F.col("major_chunks"), minor)
        rest = rest.select("group", "i", "j", "side", "doc", "comp", "text").repartition("group", "i", "j").sortWithinPartitions("group", "i", "j")
        more = rest.mapInArrow(_by_tile(_linked_sets(width, percent)), "a long, b long").distinct()
        spent += [placed, parts]
        parts = written(connected_components(links.unionByName(more), rows=n_links + n_at), "parts", 2 * (n_links + n_at))

    own = classes.select("set_a", "set_b", "n", "doc", F.col("first.doc_id").alias("least")).join(parts.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    least = own.groupBy("component").agg(F.count("*").alias("classes"), F.min("least").alias("component_id"))
    found = written(join_split(own.drop("least", "doc"), least, ["component"], "classes", n_classes).drop("component"), "found", n_classes)
    for table in [*spent, parts, classes]:
        remove(spark, table.path)
    linked = join_split(signed.select("doc_id", "n_shingles", "set_a", "set_b", (F.col("n_shingles") > 0).alias("some")), found, ["set_a", "set_b"], "n", n_rows)
    own_id = F.when(F.col("some") & F.col("doc_id").isNotNull(), F.col("component_id"))
    return linked.select("doc_id", "n_shingles", F.coalesce(own_id, F.col("doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_documents(some: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes that rows with the same doc_id belong to; none, as a rule."""
    sets = F.struct("set_a", "set_b")
    again = some.groupBy("doc_id").agg(F.min(sets).alias("p"), F.max(sets).alias("q")).where("p <> q").select("doc_id")
    rows = some.select("doc_id", "set_a", "set_b").join(again, "doc_id").distinct().join(classes.select("set_a", "set_b", "doc"), ["set_a", "set_b"])
    return rows.join(rows.groupBy("doc_id").agg(F.min("doc").alias("b")), "doc_id").where("doc <> b").select(F.col("doc").alias("a"), "b")
