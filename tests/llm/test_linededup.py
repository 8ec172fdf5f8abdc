import random

from wayloom.llm.linededup import dedup_lines, line_chunks


def _line(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def test_chunks_cover_and_resist_shifts():
    rng = random.Random(1)
    lines = [_line(rng, rng.randint(1, 9)) for _ in range(200)]
    chunks = line_chunks("\n".join(lines))
    assert [c[0] for c in chunks] == [0, *[c[1] for c in chunks[:-1]]] and chunks[-1][1] == 200
    cut = {tuple(lines[a:b]) for a, b in chunks}
    moved = ["new line", *lines]
    assert len({tuple(moved[a:b]) for a, b in line_chunks("\n".join(moved))} & cut) >= len(cut) - 2


def test_planted_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(2)
    passage = "\n".join(_line(rng, 9) for _ in range(14))
    solid = _line(rng, 60)
    rows = []
    for i in range(40):
        own = [_line(rng, rng.randint(1, 20)) for _ in range(8)] + ["Yes.", "No."]
        if i % 4 == 1:
            own[3:3] = passage.split("\n")
        if i % 4 == 2:
            own.insert(5, solid)
        rows.append((i, "\n".join(own)))
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    inner = passage.split("\n")[3:-3]
    for i, text in rows:
        out = got[i]["text"]
        if i % 4 in (0, 3) or i in (1, 2):
            assert out == text and got[i]["n_removed"] == 0
        elif i % 4 == 1:
            assert not any(x in out for x in inner)
        else:
            assert solid not in out
        if i % 4:
            assert "Yes.\nNo." in out


def test_a_passage_repeated_only_inside_one_text_goes(spark):
    rng = random.Random(3)
    passage, solid = "\n".join(_line(rng, 9) for _ in range(14)), _line(rng, 60)
    own = [_line(rng, rng.randint(12, 20)) for _ in range(7)]
    rows = [(1, "\n".join([own[0], solid, own[1], solid, own[2]])), (2, "\n".join([own[3], passage, own[4], passage])), (3, "\n".join([own[5], "Yes.", own[6], "Yes."]))]
    got = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["text"].count(solid) == 1 and got[1]["n_removed"] == 1
    assert all(got[2]["text"].count(x) == 1 for x in passage.split("\n")[3:-3]) and passage in got[2]["text"]
    assert got[3]["text"] == rows[2][1] and got[3]["n_removed"] == 0


def test_odd_rows(odd_docs, no_docs):
    got = dedup_lines(odd_docs)
    assert got.count() == odd_docs.count() and got.columns == [c for c in odd_docs.columns if c != "n_lines"] + ["n_lines", "n_removed"]
    by = {}
    for r in got.collect():
        by.setdefault(r["doc_id"], []).append(r)
    assert len({r["text"] for r in by[1]}) == 1 and by[1][0]["n_removed"] == 0
    assert by[2][0]["text"] == "" and by[2][0]["n_removed"] == 6
    assert by[11][0]["text"] == "last line here"
    assert by[3][0]["text"] is None and by[4][0]["text"] == "" and {r["n_removed"] for r in by[None]} == {0}
    assert dedup_lines(no_docs).count() == 0
