"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialspark.llm._session import trim, trimming, tune, without
from trialspark.llm._text import U, buffers, mix, pieces_of, spans_of_rows

BINS = 1 << 15
ORDERS = (1, 2, 3)
SLICE = 1 << 19
#: Groups into which tasks' counts go before they are added up.
SALTS = 256
UNKNOWN = "und"
#: Code point that stands for every run of what isn't a letter.
GAP = 0x20


@cache
def letters() -> np.ndarray:
    """Lower-case form of each code point that is a letter, GAP of any other."""
    out = np.full(0x110000, GAP, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins of all n-grams of all rows, their rows, and whether each row has a letter.

    Letters are lower-cased, each run of other characters is one gap, a gap stands before and after each row, and no n-gram
    spans two rows.  A row longer than a slice is read in pieces, with the same bins.
    """
    if len(offsets) == 2 and offsets[1] - offsets[0] > SLICE:
        return _long_grams(data)
    rows = len(offsets) - 1
    text = data.tobytes().decode("utf-8", "surrogatepass") if _utf8(data) else None
    if text is None:
        fixed = [data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        text, counts = "".join(fixed), np.array([len(x) for x in fixed], np.int64)
    else:
        counts = np.diff(np.append(0, np.cumsum((data & 0xC0) != 0x80))[offsets])
    points = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    row = np.repeat(np.arange(rows, dtype=np.int32), counts)
    keep = points != GAP
    has = np.zeros(rows, bool)
    has[row[keep]] = True
    keep[1:] |= (points[:-1] != GAP) & (row[1:] == row[:-1])  # the first of a run of others
    points, row = points[keep], row[keep]
    fresh = np.ones(len(row), bool)
    fresh[1:] = row[1:] != row[:-1]
    begin = np.flatnonzero(fresh)
    points = np.insert(points, begin, GAP)
    row = np.insert(row, begin, row[begin])
    bins, owners = [], []
    for n, binned in _binned(points):
        ok = row[: len(binned)] == row[n - 1 :]
        bins.append(binned[ok])
        owners.append(row[: len(binned)][ok])
    if not bins:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), has
    return np.concatenate(bins), np.concatenate(owners), has


def _binned(points: np.ndarray):
    """Bins of all n-grams of one sequence of code points, for each n."""
    h = points.astype(U) + U(1)
    rolling = np.zeros(len(h), U)
    for n in range(1, max(ORDERS) + 1):
        m = len(h) - n + 1
        if m <= 0:
            return
        rolling = rolling[:m] * U(0x100000001B3) + h[n - 1 :]
        if n in ORDERS:
            yield n, (mix(rolling * U(8) + U(n)) >> U(64 - 15)).astype(np.int32)


def _long_grams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``grams`` of one row, in pieces that carry over the last points and whether a letter came last."""
    bins, tail, letter, has = [], np.zeros(0, np.uint32), False, False
    for a, b in pieces_of(data, SLICE):
        points = letters()[np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)]
        if not len(points):
            continue
        keep = points != GAP
        has |= bool(keep.any())
        keep[1:] |= points[:-1] != GAP
        keep[0] |= letter
        letter = bool(points[-1] != GAP)
        points = points[keep]
        if not len(tail) and len(points):
            tail, first = np.array([GAP], np.uint32), True
        else:
            first = False
        for n, binned in _binned(now := np.concatenate([tail, points])):
            bins.append(binned[0 if first else max(0, len(tail) - n + 1) :])
        tail = now[1 - max(ORDERS) :]
    out = np.concatenate([np.zeros(0, np.int32), *bins])
    return out, np.zeros(len(out), np.int32), np.array([has])


def _utf8(data: np.ndarray) -> bool:
    try:
        data.tobytes().decode()
    except UnicodeDecodeError:
        return False
    return True


class Model:
    """Log-probabilities of bins (rows) in languages (columns), and log-priors; languages in order of name."""

    def __init__(self, langs: list[str], counts: np.ndarray, docs: np.ndarray, smoothing: float):
        self.langs = langs
        total = counts.sum(0)
        self.table = (np.log(counts + smoothing) - np.log(total + smoothing * BINS)).astype(np.float32)
        self.prior = np.log(docs / docs.sum()) if len(langs) else np.zeros(0)

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
        rows = len(offsets) - 1
        bins, owner, has = grams(data, offsets)
        if not self.langs:
            return [UNKNOWN] * rows, np.zeros(rows)
        n = np.bincount(owner, minlength=rows)
        score = np.stack([np.bincount(owner, self.table[bins, k], rows) for k in range(len(self.langs))], 1) + self.prior
        best = score.argmax(1)
        # n-grams overlap, so evidence is counted once in as many characters as the longest has
        p = np.exp((score - score.max(1, keepdims=True)) / np.maximum(1, n / 50)[:, None])
        p = p[np.arange(rows), best] / p.sum(1)
        return [self.langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, p, 0.0)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.1, most_langs: int = 1000) -> Model:
    """Counts of all n-grams of all rows with a text and a language, by language, and the model they give.

    The counts are ``BINS`` numbers a language whatever the rows; languages beyond ``most_langs`` are an error.  Tasks add
    up their rows first.  Rows with a null text or language teach nothing; an empty input gives a model that knows nothing.
    """
    tune(docs.sparkSession)

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            trim()
            for i, j in spans_of_rows(buffers(batch.column(0))[1], SLICE):
                part = batch.slice(i, j - i)
                data, off = buffers(part.column(0))
                bins, owner, _ = grams(data[off[0] : off[-1]], off - off[0])
                names = part.column(1).to_pylist()
                langs = sorted(set(names))
                code = np.searchsorted(langs, names)
                table = np.bincount(code[owner] * BINS + bins, minlength=len(langs) * BINS).reshape(-1, BINS)
                for k, lang in enumerate(langs):
                    sums[lang] = sums[lang] + table[k] if lang in sums else table[k]
                    seen[lang] = seen.get(lang, 0) + int((code == k).sum())
        salt = TaskContext.get().partitionId() % SALTS
        for lang, table in sums.items():
            step = BINS // 16
            for s in range(16):
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([s], pa.int32()), pa.array([salt], pa.int32()), pa.array([seen[lang] if s == 0 else 0]), pa.array([table[s * step : (s + 1) * step].tolist()], pa.list_(pa.int64()))], ["lang", "part", "salt", "docs", "counts"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("lang"))
    parts = rows.mapInArrow(trimming(count), "lang string, part int, salt int, docs long, counts array<long>")

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x) for x in table["counts"].to_pylist()], axis=0)
        return pa.table({"lang": table["lang"][:1], "part": table["part"][:1], "salt": table["salt"][:1], "docs": [int(np.sum(table["docs"].to_numpy()))], "counts": pa.array([total.tolist()], pa.list_(pa.int64()))})

    kind = "lang string, part int, salt int, docs long, counts array<long>"
    summed = parts.groupBy("lang", "part", "salt").applyInArrow(add, kind).groupBy("lang", "part").applyInArrow(add, kind)  # in two steps, as there may be very many tasks
    got = summed.limit(16 * most_langs + 1).collect()
    if len(got) > 16 * most_langs:
        raise ValueError(f"more than {most_langs} languages")
    langs = sorted({r["lang"] for r in got})
    counts, seen = np.zeros((len(langs), BINS)), np.zeros(len(langs))
    for r in got:
        k = langs.index(r["lang"])
        counts[k, r["part"] * BINS // 16 : (r["part"] + 1) * BINS // 16] = r["counts"]
        seen[k] += r["docs"]
    return Model(langs, counts.T, seen, smoothing)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with ``lang_pred`` and ``score`` (posterior, tempered for overlapping n-grams).

    Only the text decides, whole, however long.  Null texts and texts without a letter are "und" with score 0, as is every text of a model that
    learned nothing.  Ties go to the language first in order of name.  Empty input: no rows.  Columns of ``docs`` with an
    output's name give way to it.
    """
    tune(docs.sparkSession)
    spark: SparkSession = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    docs = without(docs, "lang_pred", "score")
    plain = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain] + ["lang_pred string", "score double"])

    def work(batches):
        for batch in batches:
            trim()
            for i, j in spans_of_rows(buffers(batch.column(text_col))[1], SLICE):
                part = batch.slice(i, j - i)
                data, off = buffers(part.column(text_col))
                langs, score = held.value.predict(data[off[0] : off[-1]], off - off[0])
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in plain] + [pa.array(langs, pa.string()), pa.array(score)], [f.name for f in plain] + ["lang_pred", "score"])

    return docs.mapInArrow(trimming(work), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    model = train(docs.where(~F.col("held_out")))
    return predict(docs.select("doc_id", "held_out", "text"), model)
