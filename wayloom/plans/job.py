"""The preprocessing job: from GPS fixes to trips, a vocabulary, its neighbours, split token files and noisy pairs, as a configuration says."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayloom.functions.region import Region
from wayloom.operators import sequences, vocab
from wayloom.operators import trips as tr
from wayloom.plans.lineage import cut
from wayloom.sources import tables
from wayloom.sources.formats import JobConfig


def region_of(config: JobConfig) -> Region:
    return Region(config.min_lon, config.min_lat, config.max_lon, config.max_lat, config.cell_size, config.cell_size)


def preprocess(points: DataFrame, config: JobConfig, path: str, variants: int = 16) -> dict[str, str]:
    """Writes under path and names the folders: trips (by month and day), vocabulary, neighbours, train and valid (pairs of noisy and own tokens), and train, valid and test as lines of own tokens with labels.

    points has user_id, event_id, month, day, sec, lon and lat. Trips are clipped to the region and to least and most points; the vocabulary is that of the training part; a trip's label is its day.
    """
    region = region_of(config)
    trips = tr.clip(tables.trips_from_points(points, region), region, config.min_points, config.max_points)
    trips = cut(trips.withColumn("n", F.size("points")))
    tables.write_trips(trips, f"{path}/trips")
    parts = cut(tr.split_train(trips, ["user_id"]))
    train = parts.where("part = 'train'")
    seen = train.select(F.explode("points").alias("p")).select("p.lon", "p.lat")
    words = cut(vocab.vocabulary(vocab.cell_counts(seen, region), config.hot_cells, config.min_count))
    tables.write_result(words, f"{path}/vocabulary")
    tables.write_result(vocab.nearest_hot(words, words, region, config.neighbours), f"{path}/neighbours")
    out = {k: f"{path}/{k}" for k in ("trips", "vocabulary", "neighbours")}
    for part in ("train", "valid", "test"):
        own = parts.where(F.col("part") == part)
        if part != "test":
            sequences.write_token_pairs(sequences.token_pairs(tr.noise(own, variants), own, region, words), f"{path}/{part}_pairs")
            out[f"{part}_pairs"] = f"{path}/{part}_pairs"
        lines = tr.tokens(own, region, words).join(own.select("trip_key", F.col("day").alias("label")), "trip_key")
        sequences.write_labelled(lines, f"{path}/{part}")
        out[part] = f"{path}/{part}"
    return out
