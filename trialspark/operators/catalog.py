"""Session catalogue: lookups, grouping, metadata, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.segments import _keys


def lookup(sessions: DataFrame, exclude: list | None = None, id_col: str = "id", **equal) -> DataFrame:
    """Rows whose columns equal (or are among) the given values, without the excluded ids; null arguments don't filter."""
    for name, value in equal.items():
        if value is not None:
            sessions = sessions.where(F.col(name).isin(*value) if isinstance(value, (list, tuple, set)) else F.col(name) == value)
    return sessions.where(~F.col(id_col).isin(*exclude)) if exclude else sessions


def has_features(wanted: list[str], features: str = "features") -> Column:
    return F.size(F.array_except(F.array(*[F.lit(w) for w in wanted]), F.col(features))) == 0


def json_param(source: str, name: str, default=None, kind: str = "string") -> Column:
    """A JSON column's field, or the default where it is absent or the JSON can't be read."""
    return F.coalesce(F.get_json_object(source, f"$.{name}").try_cast(kind), F.lit(default).cast(kind))


def group_entries(sessions: DataFrame, by, columns: list[str], order: str) -> DataFrame:
    """``(by, n, entries)``: the entries of each group in order."""
    keys = _keys(by)
    got = sessions.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("entries"))
    return got.withColumn("n", F.size("entries"))


def summarize(sessions: DataFrame, by, duration: str, trials: str, rewards: str) -> DataFrame:
    return sessions.groupBy(*_keys(by)).agg(F.round(F.sum(duration) / 60, 1).alias("minutes"), F.sum(trials).alias("trials"), F.sum(rewards).alias("rewards"))


def onehot(rows: DataFrame, column: str, names: list[str]) -> DataFrame:
    """A 0/1 column for each name."""
    return rows.withColumns({n: F.when(F.col(column) == n, 1).otherwise(0) for n in names})


def update_metadata(rows: DataFrame, sessions: DataFrame, key, columns: list[str]) -> DataFrame:
    """Columns of ``rows`` by their session's; rows of unknown sessions keep theirs (null if they had none)."""
    keys = _keys(key)
    new = sessions.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__known"))
    got = rows.join(new, keys, "left")
    for c in columns:
        got = got.withColumn(c, F.when(F.col("__known"), F.col(f"__{c}")).otherwise(F.col(c) if c in rows.columns else F.lit(None)))
    return got.drop("__known", *[f"__{c}" for c in columns])


def aba_labels(entries: DataFrame, day, order: str, perturbed: str) -> DataFrame:
    """``label``: a before the day's first perturbed entry, b from it on, aprime from the first unperturbed one after it; null without a pattern."""
    keys = _keys(day)
    n = entries.withColumn("__i", F.row_number().over(Window.partitionBy(*keys).orderBy(order)))
    w = Window.partitionBy(*keys)
    n = n.withColumn("__b", F.min(F.when(F.col(perturbed), F.col("__i"))).over(w))
    n = n.withColumn("__c", F.min(F.when(~F.col(perturbed) & (F.col("__i") > F.col("__b")), F.col("__i"))).over(w))
    label = F.when(F.col("__i") < F.col("__b"), "a").when(F.col("__i") < F.col("__c"), "b").otherwise("aprime")
    return n.withColumn("label", F.when((F.col("__b") > 1) & F.col("__c").isNotNull(), label)).drop("__i", "__b", "__c")


def aba_days(entries: DataFrame, day, order: str, perturbed: str) -> DataFrame:
    return aba_labels(entries, day, order, perturbed).where("label = 'aprime'").select(*_keys(day)).distinct()


def sources(features: str = "features", params: str = "params") -> Column:
    """The recordings an entry has, by its features."""
    rules = {"eye": ("eye_data", "eye_calibration", "eye_constrained"), "emg": ("emg",), "broadband": ("relay_blackrock", "record_headstage", "quattrocento_bmi"), "ap": ("neuropixel", "neuropixels"), "lfp": ("record_headstage", "neuropixel", "neuropixels")}
    any_of = lambda names: F.arrays_overlap(F.col(features), F.array(*[F.lit(n) for n in names]))
    return F.array_compact(F.array(F.lit("exp"), *[F.when(any_of(names), F.lit(kind)) for kind, names in rules.items()]))


def is_perturbed(mapping: str, tolerance: float = 1e-8) -> Column:
    """A 3 x 3 mapping (array of arrays) differs from the identity."""
    flat = F.flatten(F.col(mapping))
    eye = F.array(*[F.lit(1.0 if k % 4 == 0 else 0.0) for k in range(9)])
    return F.exists(F.zip_with(flat, eye, lambda a, b: F.abs(a - b) > tolerance), lambda x: x)


def parse_strings(rows: DataFrame, column: str, include: list[str] = (), avoid: list[str] = ()) -> DataFrame:
    for s in include:
        rows = rows.where(F.col(column).contains(s))
    for s in avoid:
        rows = rows.where(~F.col(column).contains(s))
    return rows


def count_symbols(rows: DataFrame, column: str, pattern: str = r"[A-Za-z_]\w*") -> DataFrame:
    """``(symbol, n)`` of all matches, most frequent first."""
    words = rows.select(F.explode(F.regexp_extract_all(column, F.lit(f"({pattern})"), F.lit(1))).alias("symbol"))
    return words.groupBy("symbol").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "symbol")
