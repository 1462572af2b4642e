"""Preprocessed tables by partition, motion-capture CSV, sorter TSV, probe XML, YAML configuration."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS = ("data_source", "subject", "date", "te_id")


def file_name(subject: str, te_id: int, date: str, data_source: str) -> str:
    return f"preproc_{date}_{subject}_{te_id}_{data_source}"


def save(df: DataFrame, root: str, data_source: str, subject: str, date: str, te_id: int, overwrite: bool = False) -> None:
    """Write an entry's table in its partition; an existing one raises unless it may be overwritten."""
    path = f"{root}/data_source={data_source}/subject={subject}/date={date}/te_id={te_id}"
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def load(spark: SparkSession, root: str, data_source: str, subject: str | None = None, date: str | None = None, te_id: int | None = None) -> DataFrame:
    """Tables of a data source; subject, date and entry prune partitions."""
    df = spark.read.option("basePath", root).parquet(f"{root}/data_source={data_source}")
    for name, value in (("subject", subject), ("date", date), ("te_id", te_id)):
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df


def entry_ids(spark: SparkSession, root: str, data_source: str, subject: str, date: str) -> list[int]:
    return sorted(r[0] for r in load(spark, root, data_source, subject, date).select("te_id").distinct().collect())


def segment(df: DataFrame, samplerate: float, start: float, end: float, sample: str = "i") -> DataFrame:
    """Samples int(start fs) to int(end fs): a range on the sample column that reaches the Parquet scan."""
    return df.where((F.col(sample) >= int(start * samplerate)) & (F.col(sample) < int(end * samplerate)))


def mocap(spark: SparkSession, path: str, skip: int = 7) -> DataFrame:
    """``(frame, timestamp, rotation, position)`` of a motion-capture CSV: columns 2-5 quaternion, 6-8 position.

    Header lines are those whose first field isn't a number.
    """
    lines = spark.read.text(path).select(F.split("value", ",").alias("c")).where(F.col("c")[0].rlike(r"^\s*\d+\s*$") & (F.size("c") >= 9))
    at = lambda k: F.nullif(F.trim(F.col("c")[k]), F.lit("")).cast("double")
    return lines.select(F.col("c")[0].cast("int").alias("frame"), at(1).alias("timestamp"), F.array(*[at(k) for k in range(2, 6)]).alias("rotation"), F.array(*[at(k) for k in range(6, 9)]).alias("position"))


def mocap_metadata(spark: SparkSession, path: str) -> dict[str, str]:
    """Keys and values of the first line."""
    first = spark.read.text(path).first()[0].split(",")
    return {k.strip(): v.strip() for k, v in zip(first[::2], first[1::2], strict=False) if k.strip()}


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)


def unit_labels(spark: SparkSession, folder: str) -> DataFrame:
    """``(cluster_id, label, amplitude, contamination)`` from a sorter's TSV files."""
    label = tsv(spark, f"{folder}/cluster_KSLabel.tsv", "cluster_id int, label string")
    amp = tsv(spark, f"{folder}/cluster_Amplitude.tsv", "cluster_id int, amplitude double")
    cont = tsv(spark, f"{folder}/cluster_ContamPct.tsv", "cluster_id int, contamination double")
    return label.join(amp, "cluster_id", "left").join(cont, "cluster_id", "left")


def probes(text: str) -> list[dict]:
    """Probe attributes and ``channels`` (channel, bank, x, y by channel) of settings XML."""
    out = []
    for p in ET.fromstring(text).iter("NP_PROBE"):
        row = dict(p.attrib)
        get = lambda tag, p=p: {int(m[1]): v for k, v in (p.find(tag).attrib.items() if p.find(tag) is not None else []) if (m := re.fullmatch(r"CH(\d+)", k, re.I))}
        bank, x, y = get("CHANNELS"), get("ELECTRODE_XPOS"), get("ELECTRODE_YPOS")
        row["channels"] = [{"channel": c, "bank": int(str(bank[c]).split(":")[0]), "x": float(x.get(c, "nan")), "y": float(y.get(c, "nan"))} for c in sorted(bank)]
        out.append(row)
    return out


def task_codes(spark: SparkSession, text: str) -> DataFrame:
    """``(name, base)`` of a YAML map of names to a code or a list of codes, lists by their first."""
    import yaml

    rows = [(name, int(v[0] if isinstance(v, list) else v)) for name, v in yaml.safe_load(text).items() if isinstance(v, (int, list))]
    return spark.createDataFrame(rows, "name string, base long")


def lookup_value(table: DataFrame, from_column: str, to_column: str, value, otherwise=0):
    """First ``to_column`` of a row whose ``from_column`` is the value, else the sentinel."""
    row = table.where(F.col(from_column) == value).select(to_column).first()
    return otherwise if row is None else row[0]


def catalog(spark: SparkSession, path: str) -> dict[str, str]:
    """Column names and types of a stored table."""
    return dict(spark.read.parquet(path).dtypes)
