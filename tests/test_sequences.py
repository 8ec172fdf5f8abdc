"""Numbering, line files, foreign formats, embeddings, the preprocessing job."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayloom import api
from wayloom.functions.region import Region
from wayloom.operators import graph, od, sequences
from wayloom.operators import trips as tr
from wayloom.plans import job
from wayloom.sources import fixtures as fx
from wayloom.sources import formats, tables

R = Region()


def test_numbers_without_a_window(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"), (F.col("id") % 3).alias("g"))
    got = sequences.numbered(rows.repartition(5), [F.desc("v")])
    assert [r["number"] for r in got.orderBy(F.desc("v")).collect()] == list(range(1000))
    assert "Window" not in got._jdf.queryExecution().toString()
    within = sequences.numbered_within(rows, ["g"], [F.col("v")]).collect()
    for g in range(3):
        own = sorted((r["v"], r["number"]) for r in within if r["g"] == g)
        assert [n for _, n in own] == list(range(len(own)))
    third = sequences.order_slice(rows, [F.col("v")]).collect()
    assert sorted(r["v"] for r in third) == sorted(r["v"] for r in rows.collect())[333:533]
    assert sequences.numbered(rows.limit(0), [F.col("v")]).count() == 0


def test_lines_come_back_in_order(spark, tmp_path):
    for name, lines in (("a", 500), ("b", 480)):
        (tmp_path / name).write_text("\n".join(f"{name}{k}" for k in range(lines)) + "\n")
    got = sequences.paired_lines(spark, str(tmp_path / "a"), str(tmp_path / "b")).orderBy("number").collect()
    assert [(r["source"], r["target"]) for r in got] == [(f"a{k}", f"b{k}") for k in range(480)]
    rows = spark.createDataFrame([(f"t{k:03d}", [k, k + 1], k % 16) for k in range(300)], "trip_key string, tokens array<int>, label int").repartition(3)
    sequences.write_labelled(rows, str(tmp_path / "l"))
    back = sequences.read_labelled(spark, str(tmp_path / "l")).collect()
    assert sorted((r["number"], r["tokens"], r["label"]) for r in back) == [(k, [k, k + 1], k % 16) for k in range(300)]
    places = [r["place"] for r in sorted(back, key=lambda r: r["number"])]
    assert sorted(places) == list(range(300)) != places


def test_buckets_and_batches(spark):
    rows = spark.createDataFrame([(f"t{k:02d}", list(range(k % 7 + 1)), [0] * (k % 4)) for k in range(40)], "trip_key string, tokens array<int>, target array<int>")
    got = {r["trip_key"]: r["bucket"] for r in sequences.length_buckets(rows, [(2, 1), (4, 3)], "tokens", "target").collect()}
    assert got == {f"t{k:02d}": 0 if k % 7 < 2 and k % 4 < 2 else 1 for k in range(40) if k % 7 < 4}
    placed = sequences.batches(rows, 8).collect()
    for r in placed:
        assert len(r["tokens"]) == max(x["length"] for x in placed if x["batch"] == r["batch"])
        assert [x for x in r["tokens"][: r["length"]]] == list(range(r["length"]))
    order = sorted(placed, key=lambda r: (r["batch"], r["row"]))
    assert [(-r["length"], r["trip_key"]) for r in order] == sorted((-r["length"], r["trip_key"]) for r in placed)


def test_embedding(spark, sf_dir):
    trips = fx.trips(spark, sf_dir)
    one = {r["trip_key"]: r["feature"] for r in sequences.embed(trips, R, 32).collect()}
    two = {r["trip_key"]: r["feature"] for r in sequences.embed(trips.repartition(3), R, 32).collect()}
    assert one == two and len(one) == trips.count() and all(len(v) == 32 and abs(np.linalg.norm(v) - 1) < 1e-9 for v in one.values())
    assert len({tuple(v) for v in one.values()}) > len(one) // 2

    def model():
        return lambda lists: [[float(len(x)), float(sum(x))] for x in lists]

    tokens = {r["trip_key"]: r["tokens"] for r in tr.tokens(trips, R).collect()}
    assert all(r["feature"] == [len(tokens[r["trip_key"]]), sum(tokens[r["trip_key"]])] for r in sequences.embed(trips, R, 2, model).collect())
    found = api.line_graph_communities(trips, None, 16, list(range(0, 100, 4)), 1, (1, 31), (0, 24))
    assert found["communities"].count() > 0 and found["nodes"].count() >= found["communities"].count()


def test_foreign_formats(spark, tmp_path):
    data = np.zeros((5, 10_000))
    data[2, 1234], data[4, 99] = 7, 1.5
    np.savez(tmp_path / "h.npz", data=data, selet=np.isin(np.arange(10_000), [99, 1234, 5000]))
    flows = formats.read_flow_history(spark, str(tmp_path / "h.npz"), first=100)
    assert sorted(map(tuple, flows.collect())) == [(102, 12, 34, 7.0), (104, 0, 99, 1.5)]
    mask = formats.read_mask(spark, str(tmp_path / "h.npz"))
    assert sorted(map(tuple, mask.collect())) == [(0, 0, 99), (1, 12, 34), (2, 50, 0)]
    assert [tuple(r) for r in od.first_masked(flows, mask).collect()] == [(0, 0, 99), (1, 12, 34)]
    assert [r["name"] for r in graph.slice_line_graph(flows, 102, mask)[0].collect()] == ["12_34"]
    (tmp_path / "g.gml").write_text('# made by hand\ngraph [\n directed 0\n node [ id 1 label "a b" value 3 ]\n node [ id 2 graphics [ x 1.5 ] ]\n edge [ source 1 target 2 weight 2.5 ]\n edge [ source 2 target 1 ]\n]\n')
    nodes, edges = formats.read_gml(spark, str(tmp_path / "g.gml"))
    assert sorted((r["id"], r["label"], r["attributes"].get("value")) for r in nodes.collect()) == [(1, "a b", "3"), (2, "2", None)]
    assert sorted(map(tuple, edges.collect())) == [(1, 2, 2.5), (2, 1, 1.0)]
    for read, name in ((lambda: formats.read_mat_graph(spark, "x.mat"), "scipy"), (lambda: formats.read_trip_files(spark, "x", 1, 1), "h5py"), (lambda: formats.read_poi_workbook(spark, "x.xlsx"), "openpyxl")):
        try:
            __import__(name)
        except ModuleNotFoundError:
            with pytest.raises(ModuleNotFoundError, match=name):
                read()
    config = formats.JobConfig.from_json('{"name": "x", "days": [1, 3], "usegrid": 1}')
    assert config.days == (1, 3) and config.extra == {"usegrid": 1} and formats.JobConfig.from_json(config.to_json()).name == "x"


def test_stored_tables(spark, sf_dir, tmp_path):
    poi = fx.poi(spark, sf_dir)
    tables.write_poi_index(poi, str(tmp_path / "poi"), 300.0)
    back = spark.read.parquet(str(tmp_path / "poi"))
    assert back.count() == poi.count() and {"bx", "by"} <= set(back.columns)
    tables.empty_folder(spark, str(tmp_path / "poi"))
    assert (tmp_path / "poi").is_dir() and not list((tmp_path / "poi").iterdir())
    trips = fx.trips(spark, sf_dir)
    try:
        assert tables.bootstrap(spark, "boot_trips", trips) == trips.count() == tables.bootstrap(spark, "boot_trips", trips.limit(1))
    finally:
        tables.drop_table(spark, "boot_trips")
    assert api.health(spark).startswith("Spark 4")


def test_preprocessing_job(spark, sf_dir, tmp_path):
    config = formats.JobConfig(cell_size=900.0, min_points=2, max_points=100, hot_cells=50, min_count=1, neighbours=3)
    out = job.preprocess(fx.gps(spark, sf_dir), config, str(tmp_path / "job"), variants=2)
    trips = spark.read.parquet(out["trips"])
    lines = {part: spark.read.text(out[part] + "/ori").count() for part in ("train", "valid", "test")}
    assert sum(lines.values()) == trips.count() and lines["train"] > lines["test"] > 0
    src, trg = (spark.read.text(f"{out['train_pairs']}/{f}").count() for f in ("src", "trg"))
    assert src == trg == 2 * lines["train"]
    words = spark.read.parquet(out["vocabulary"]).count()
    assert 0 < words <= 50 and spark.read.parquet(out["neighbours"]).count() == words * 3
