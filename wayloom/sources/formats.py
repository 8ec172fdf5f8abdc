"""Readers of small foreign files: flow histories, GML graphs, MATLAB graphs, HDF5 trips and workbooks of points of interest; and a job's configuration."""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _needed(name: str):
    """A library that isn't part of this engine; says clearly what is missing."""
    import importlib

    try:
        return importlib.import_module(name)
    except ModuleNotFoundError as e:
        raise ModuleNotFoundError(f"reading this format needs {name} on the driver and every executor; or turn the file into Parquet first", name=name) from e


def read_flow_history(spark: SparkSession, path: str, array: str = "data", first: int = 0, cells: int = 100) -> DataFrame:
    """(slice, o_cell, d_cell, flow) of .npz files with an array [slice][od]: od is o_cell * cells + d_cell; zeros are left out, slices count from first. A file is read by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                data = np.load(io.BytesIO(content))[array]
                for at in range(0, len(data), 256):
                    s, od = np.nonzero(data[at : at + 256])
                    yield pd.DataFrame({"slice": s + at + first, "o_cell": od // cells, "d_cell": od % cells, "flow": data[at : at + 256][s, od].astype(float)})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "slice long, o_cell long, d_cell long, flow double")


def read_mask(spark: SparkSession, path: str, array: str = "selet", cells: int = 100) -> DataFrame:
    """(number, o_cell, d_cell) of the pairs that a boolean array of an .npz file selects, numbered in order."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for content in f["content"]:
                od = np.flatnonzero(np.load(io.BytesIO(content))[array])
                yield pd.DataFrame({"number": np.arange(len(od)), "o_cell": od // cells, "d_cell": od % cells})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "number long, o_cell long, d_cell long")


_GML = re.compile(r'"[^"]*"|\[|\]|[^\s\[\]"]+')


def gml_records(text: str) -> tuple[list[dict], list[dict]]:
    """Attributes of the nodes and edges of a GML text; nested lists within them are left out."""
    words, nodes, edges = iter(_GML.findall(re.sub(r"(?m)^\s*#.*$", "", text))), [], []

    def block(kind: str) -> dict:
        out: dict = {}
        for key in words:
            if key == "]":
                break
            value = next(words)
            if value == "[":
                inner = block(key)
                if kind == "graph" and key in ("node", "edge"):
                    (nodes if key == "node" else edges).append(inner)
            else:
                out[key] = value[1:-1] if value.startswith('"') else float(value) if re.fullmatch(r"[+-]?\d*\.\d+(?:[eE][+-]?\d+)?", value) else int(value)
        return out

    for key in words:
        if next(words) == "[":
            block(key)
    return nodes, edges


def read_gml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(id, label, attributes map<string, string>) of the nodes and (src, dst, flow) of the edges (value or weight, 1 where absent) of GML files; a file is read by one task."""

    def run(kind: int):
        def frames_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                for text in f["value"]:
                    found = gml_records(text)[kind]
                    if kind == 0:
                        yield pd.DataFrame([(int(x["id"]), str(x.get("label", x["id"])), {k: str(v) for k, v in x.items()}) for x in found], columns=["id", "label", "attributes"])
                    else:
                        yield pd.DataFrame([(int(x["source"]), int(x["target"]), float(x.get("value", x.get("weight", 1)))) for x in found], columns=["src", "dst", "flow"])

        return frames_of

    text = spark.read.text(path, wholetext=True)
    return text.mapInPandas(run(0), "id long, label string, attributes map<string,string>"), text.mapInPandas(run(1), "src long, dst long, flow double")


def read_mat_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(i, j) edges of the sparse W and (i, feature, label) of fea and gnd of a MATLAB file; needs scipy."""
    got = _needed("scipy.io").loadmat(path)
    w = got["W"].tocoo()
    edges = spark.createDataFrame(pd.DataFrame({"i": w.row.astype(np.int64), "j": w.col.astype(np.int64)}))
    fea = got["fea"].toarray() if hasattr(got["fea"], "toarray") else got["fea"]
    rows = pd.DataFrame({"i": np.arange(len(fea), dtype=np.int64), "feature": fea.astype(float).tolist(), "label": got["gnd"].ravel().astype(np.int64)})
    return edges, spark.createDataFrame(rows)


def read_trip_files(spark: SparkSession, path: str, month: int, day: int) -> DataFrame:
    """(trip_key, month, day, idx, points) of HDF5 files with trips/<i> and timestamps/<i>; a file is read by one task, and needs h5py."""
    _needed("h5py")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import h5py

        for f in frames:
            for content in f["content"]:
                with h5py.File(io.BytesIO(content)) as h:
                    rows = []
                    for i in range(1, int(h.attrs["num"][0]) + 1):
                        at, sec = h[f"trips/{i}"][()], h[f"timestamps/{i}"][()]
                        rows.append((f"{day}_{i}", month, day, i, [(float(a), float(b), int(s)) for (a, b), s in zip(at, sec, strict=True)]))
                    yield pd.DataFrame(rows, columns=["trip_key", "month", "day", "idx", "points"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "trip_key string, month int, day int, idx int, points array<struct<lon:double,lat:double,sec:int>>")


def read_poi_workbook(spark: SparkSession, path: str) -> DataFrame:
    """(category, lon, lat) of a workbook: its last two columns, the category by its file's stem; needs openpyxl."""
    _needed("openpyxl")
    frame = pd.read_excel(path).iloc[:, -2:].set_axis(["lon", "lat"], axis=1)
    stem = re.sub(r"\.[^.]*$", "", path.rsplit("/", 1)[-1])
    return spark.createDataFrame(frame.astype(float)).select(F.lit(stem).alias("category"), "lon", "lat")


@dataclass(frozen=True)
class JobConfig:
    """What the preprocessing job and the text model's runs are told."""

    name: str = "job"
    min_lon: float = 120.1088
    min_lat: float = 30.2335
    max_lon: float = 120.1922
    max_lat: float = 30.3015
    cell_size: float = 100.0
    min_points: int = 2
    max_points: int = 10_000
    hot_cells: int = 40_000
    min_count: int = 2
    neighbours: int = 10
    month: int = 1
    days: tuple[int, int] = (1, 31)
    hours: tuple[int, int] = (0, 24)
    seed: int = 1
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> JobConfig:
        """Known names set fields, others go to extra."""
        given = json.loads(text)
        known = {k: tuple(v) if k in ("days", "hours") else v for k, v in given.items() if k in cls.__dataclass_fields__ and k != "extra"}
        return cls(**known, extra={k: v for k, v in given.items() if k not in known})

    def to_json(self) -> str:
        return json.dumps(asdict(self))
