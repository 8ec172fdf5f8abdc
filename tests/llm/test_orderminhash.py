import hashlib

import numpy as np

from wayloom.llm import orderminhash as omh


def test_follows_edit_distance_and_order():
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(400)]
    f = lambda w: omh.fingerprint(omh.code_points(" ".join(w)))
    base = f(words)
    few = list(words)
    few[100] = "changed"
    shuffled = list(rng.permutation(words))
    assert omh.likeness(base, f(words)) == 1.0
    assert omh.likeness(base, f(few)) > 0.9
    assert omh.likeness(base, f(few)) > omh.likeness(base, f(words[:250] + ["x"] * 150)) > omh.likeness(base, f(shuffled))
    assert omh.likeness(f([]), f([])) == 1.0 and omh.likeness(f([]), base) == 0.0


def test_repeats_count():
    a, b = (omh.fingerprint(omh.code_points("abcdefghij" * n)) for n in (3, 300))
    assert omh.likeness(a, b) < 0.5


def test_rows(spark, odd_docs, no_docs):
    got = omh.fingerprints(odd_docs).collect()
    assert len(got) == odd_docs.count()
    single = {r["doc_id"]: r["text"] or "" for r in odd_docs.where("doc_id > 1").collect()}
    by = {r["doc_id"]: r for r in got if r["doc_id"] in single}
    order = sorted(single, reverse=True)
    for own, after in zip(order, order[1:], strict=False):
        text, third = single[own], len(single[own]) // 3
        edited = text[: len(text) - third] + single[after][:third]
        assert by[own]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by[own]["n_chars"] == len(text)
        assert by[own]["edited_fingerprint"] == omh._text_of(omh.fingerprint(omh.code_points(edited)))
    assert by[8]["fingerprint"] == by[9]["fingerprint"] and by[9]["near_next"] == 1.0
    assert omh.fingerprints(no_docs).count() == 0
    alone = omh.fingerprints(odd_docs.where("doc_id = 6")).first()
    assert alone["near_next"] == 1.0


def test_last_meets_first_over_many_tasks(spark):
    rows = [(i, f"document number {i} " * 3) for i in range(40)]
    got = {r["doc_id"]: r for r in omh.fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    for i in range(40):
        text, after = rows[i][1], rows[(i - 1) % 40][1]
        third = len(text) // 3
        assert got[i]["edited_sha256"] == hashlib.sha256((text[: len(text) - third] + after[:third]).encode()).hexdigest()


def _brute(text, k=omh.K, slots=omh.SLOTS):
    """Order MinHash word by word: k-mers with their number, the two least of each slot in text order."""
    m, codes = (1 << 64) - 1, [ord(c) for c in text]
    def mix(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = ((x ^ (x >> shift)) * factor) & m
        return x ^ (x >> 31)
    a, low = 0x9E3779B97F4A7C15, (1 << omh.PLACE_BITS) - 1
    kept, seen = [[] for _ in range(slots)], {}
    for i in range(len(codes) - k + 1):
        h = 0
        for c in codes[i : i + k]:
            h = (h * a + c) & m
        own = mix(h) & ~low
        number = seen[own] = seen.get(own, -1) + 1
        own = mix((own + number) & m) & ~low if number else own
        kept[own >> 58].append((own | i, i, own >> omh.PLACE_BITS))
    out = []
    for slot in kept:
        two = sorted(sorted(slot)[:2], key=lambda x: x[1])
        if not two:
            out.append(0)
            continue
        sig = len(two)
        for x in (two * 2)[:2] if len(two) == 1 else two:
            sig = mix((sig * a + x[2]) & m)
        out.append(sig >> 32 | 1)
    return out


def test_is_order_minhash():
    rng = np.random.default_rng(7)
    for letters, n in (("ab", 40), ("abcdefgh é", 500), ("abc", 3000), ("a", 300), ("xyz", 8), ("xyz", 9)):
        text = "".join(rng.choice(list(letters), n))
        assert omh.fingerprint(omh.code_points(text)).tolist() == _brute(text)


def test_no_text_passes_through_one_task(odd_docs):
    plan = omh.fingerprints(odd_docs)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Window" not in plan
