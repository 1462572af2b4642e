import os

import pandas as pd

from trialspark.streaming import chunks


def run(spark, df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).collect()


def feed(tmp_path, parts):
    for i, p in enumerate(parts):
        pd.DataFrame(p, columns=["channel", "t", "value"]).to_parquet(tmp_path / f"{i}.parquet")
        os.utime(tmp_path / f"{i}.parquet", (1000 + i, 1000 + i))  # files come in order of age


def test_discontinuities_across_batches(spark, tmp_path):
    feed(tmp_path, [[(1, 0.0, 0.0), (1, 1.0, 0.1), (2, 0.0, 1.0)], [(1, 2.0, 5.0), (1, 3.0, 5.1), (2, 1.0, 1.0)]])
    s = spark.readStream.schema("channel long, t double, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    got = run(spark, chunks.discontinuities(s, threshold=1.0), "disc")
    assert [(r.channel, r.t, round(r.jump, 6)) for r in got] == [(1, 2.0, 4.9)]
    assert len(run(spark, chunks.nonzero(s), "nonzero")) == 5


def test_crossings_do_not_depend_on_chunks(spark, tmp_path):
    x = [0, 2, 2, 0, 3, 0, 0, 4, 5, 0]
    for name, cuts in (("one", [10]), ("many", [1, 2, 4, 5, 8, 10])):
        folder = tmp_path / name
        folder.mkdir()
        feed(folder, [[(1, float(i), float(x[i])) for i in range(a, b)] for a, b in zip([0, *cuts], cuts, strict=False)])
        s = spark.readStream.schema("channel long, t double, value double").option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(folder))
        assert sorted(r.t for r in run(spark, chunks.crossings(s, 1.0, refractory=3.5), f"cross_{name}")) == [1.0, 7.0]


def test_hits_are_merged(spark):
    hits = spark.createDataFrame([("e", 1, 10.0), ("e", 2, 10.2), ("e", 1, 50.0)], "entry string, channel long, t double")
    assert [(r.t, r.channels) for r in chunks.unique_discontinuities(hits, "entry", 1.0).orderBy("t").collect()] == [(10.0, [1, 2]), (50.0, [1])]


def test_windowed_counts(spark, tmp_path):
    rows = pd.DataFrame({"ts": pd.to_datetime(["2024-01-01 00:00:10", "2024-01-01 00:00:50", "2024-01-01 00:02:10"]), "kind": ["a", "a", "b"]})
    rows.to_parquet(tmp_path / "0.parquet", coerce_timestamps="us")
    s = spark.readStream.schema("ts timestamp, kind string").parquet(str(tmp_path))
    got = run(spark, chunks.event_counts(s, "ts", "1 minute", "1 minute", "kind"), "counts", "complete")
    assert sorted((r.kind, r.n) for r in got) == [("a", 2), ("b", 1)]
