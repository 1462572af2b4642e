import numpy as np
import pytest

from trialspark.sources import recordings, tables


def test_recordings(spark, tmp_path):
    x = np.round(np.random.default_rng(0).normal(size=(50, 3)) * 1e-3 / 1.907e-7) * 1.907e-7
    recordings.write(x[:30], str(tmp_path), stamp="2020-01-01")
    recordings.write(x[30:], str(tmp_path), stamp="2020-01-02")
    (tmp_path / "notes.txt").write_text("x")
    assert recordings.list_sources(str(tmp_path)) == ["Headstages"]
    meta = recordings.metadata(str(tmp_path), "Headstages")
    assert (meta["n_channels"], meta["n_samples"]) == (3, 50)
    df = recordings.read(spark, str(tmp_path), "Headstages")
    got = np.array([r["values"] for r in df.orderBy("i").collect()]) * meta["voltsperbit"]
    assert np.allclose(got, x, atol=1e-9)
    part = recordings.read(spark, str(tmp_path), "Headstages", channels=[2], start=25, end=35).orderBy("i").collect()
    assert [r.i for r in part] == list(range(25, 35)) and all(len(r["values"]) == 1 for r in part)
    assert recordings.long(df).count() == 150
    with pytest.raises(FileNotFoundError):
        recordings.metadata(str(tmp_path), "AnalogPanel")
    files = spark.createDataFrame([("a", 3, "1", 10), ("a", 3, "2", 5), ("a", 4, "3", 7), ("a", 3, "4", 1)], "source string, channels int, stamp string, rows long")
    assert sorted(r.rows for r in recordings.recordings(files).collect()) == [1, 7, 15]


def test_partitioned_tables(spark, tmp_path):
    df = spark.range(100).selectExpr("id as i", "id * 2.0 as v")
    root = str(tmp_path / "store")
    tables.save(df, root, "lfp", "s1", "2020-01-01", 7)
    tables.save(df, root, "lfp", "s1", "2020-01-01", 9)
    with pytest.raises(Exception, match="(?i)exists"):
        tables.save(df, root, "lfp", "s1", "2020-01-01", 7)
    assert tables.entry_ids(spark, root, "lfp", "s1", "2020-01-01") == [7, 9]
    one = tables.load(spark, root, "lfp", "s1", te_id=7)
    seg = tables.segment(one, 10.0, 1.0, 2.5)
    assert seg.count() == 15
    assert "PushedFilters: [IsNotNull(i), GreaterThanOrEqual(i,10), LessThan(i,25)]" in seg._jdf.queryExecution().toString()
    assert tables.lookup_value(df, "i", "v", 3) == 6.0 and tables.lookup_value(df, "i", "v", -1) == 0


def test_text_sources(spark, tmp_path):
    csv = tmp_path / "take.csv"
    csv.write_text("Format Version,1.23,Take Name,t1\n\n,,Type\n,,Name\n,,ID\n,,Rotation\nFrame,Time (Seconds),X,Y,Z,W,X,Y,Z\n0,0.0,1,2,3,4,5,6,7\n1,0.1,,,,,8,9,10\n")
    rows = tables.mocap(spark, str(csv)).orderBy("frame").collect()
    assert rows[0].rotation == [1, 2, 3, 4] and rows[0].position == [5, 6, 7] and rows[1].rotation == [None] * 4
    assert tables.mocap_metadata(spark, str(csv))["Take Name"] == "t1"
    for name, text in (("KSLabel", "cluster_id\tKSLabel\n0\tgood\n1\tmua\n"), ("Amplitude", "cluster_id\tAmplitude\n0\t12.5\n"), ("ContamPct", "cluster_id\tContamPct\n0\t1.5\n1\t80\n")):
        (tmp_path / f"cluster_{name}.tsv").write_text(text)
    assert sorted(map(tuple, tables.unit_labels(spark, str(tmp_path)).collect())) == [(0, "good", 12.5, 1.5), (1, "mua", None, 80.0)]
    xml = '<S><NP_PROBE slot="2" port="1"><CHANNELS CH1="1" CH0="0"/><ELECTRODE_XPOS CH0="27" CH1="59"/><ELECTRODE_YPOS CH0="0" CH1="15"/></NP_PROBE></S>'
    probe = tables.probes(xml)[0]
    assert probe["port"] == "1" and probe["channels"] == [{"channel": 0, "bank": 0, "x": 27.0, "y": 0.0}, {"channel": 1, "bank": 1, "x": 59.0, "y": 15.0}]
    assert sorted(map(tuple, tables.task_codes(spark, "REWARD: 48\nTARGET_ON: [16, 17]\n").collect())) == [("REWARD", 48), ("TARGET_ON", 16)]
