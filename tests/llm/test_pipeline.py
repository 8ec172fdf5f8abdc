"""Each stage on its own input, over the smallest tables."""

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages_and_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language id", "line dedup", "minhash near-dedup", "best-fit packing"]
    at, library = docs, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = corpus_pipeline.written(stage(spark, at, sf_dir), "test")
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        assert out.join(at, "doc_id", "left_anti").count() == 0
        if name == "line dedup":
            whole = at.join(out, "doc_id", "left_anti").collect()
            assert len(whole) < 0.2 * at.count()
            lines = {x for r in out.collect() for x in (r["text"] or "").split("\n")}
            assert all(x in lines for r in whole for x in r["text"].split("\n") if len(x.split()) >= 12)
            assert out.where("n_chars <> length(text)").count() == 0
        at = out
    packed = corpus_pipeline.STAGES[-1][1](spark, at, sf_dir)
    assert packed.select("doc_id").distinct().count() == at.count()
    assert packed.agg(F.sum("n_tokens")).first()[0] == sum(len(library.encode(r["text"], add_special_tokens=False).ids) + 1 for r in at.collect())
    ran = corpus_pipeline.run(spark, sf_dir)
    assert ran.columns == packed.columns and sorted(map(tuple, ran.select("doc_id", "n_tokens").collect())) == sorted(map(tuple, packed.select("doc_id", "n_tokens").collect()))


def test_near_copies_leave_one(spark, odd_docs, sf_dir):
    out = corpus_pipeline.drop_near_copies(spark, odd_docs, sf_dir)
    kept = sorted(r["doc_id"] for r in out.where("doc_id is not null").collect())
    assert kept == [1, 3, 4, 5, 6, 8, 10, 12]
    assert out.where("doc_id is null").count() == 2


def test_every_stage_on_odd_rows_and_no_rows(spark, odd_docs, no_docs, sf_dir):
    """Clashing names come back as they were; null, empty, repeated and very long texts have their stated fate."""
    odd = odd_docs.withColumns({c: F.lit(c) for c in ("rejected", "predicted", "n_removed", "known_of", "known_first", "kept_id", "turn", "own_3", "lang_pred", "kept_", "place")})
    rows = {r["doc_id"]: r for r in odd.collect()}
    want = {
        "toxicity": list(rows),
        "line dedup": [k for k in rows if k != 2],
        "minhash near-dedup": [1, 3, 4, 5, 6, 8, 10, 12, None],
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, sf_dir)
        assert out.columns == odd.columns and [t for _, t in out.dtypes] == [t for _, t in odd.dtypes]
        got = out.collect()
        assert all(r[c] == rows[r["doc_id"]][c] for r in got for c in odd.columns if c not in ("text", "n_chars"))
        if name in want:
            assert {r["doc_id"] for r in got} == set(want[name]), name
        else:
            assert not {r["doc_id"] for r in got} & {3, 4, 5, 12}
        assert stage(spark, no_docs, sf_dir).count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.pack(spark, odd, sf_dir).collect()} == set(rows)
    assert corpus_pipeline.pack(spark, no_docs, sf_dir).count() == 0
