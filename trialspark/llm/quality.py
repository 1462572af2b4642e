"""Quality classifier: document evidence combined with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm._session import materialize, trim, trimming, tune, without
from trialspark.llm._text import BYTE_HASH, Prefix, U, buffers, mix, spans_of_rows, words

SLICE = 1 << 19
#: Labelled rows the classifier is fitted on, at most.
MOST_LABELLED = 12_000
#: A table of sites up to this many rows is broadcast; a larger one is joined by its keys.
BROADCAST_SITES = 100_000
BEGINNINGS = (4, 5)
#: A term is strong if this share of the rows that have it is bad, and it stands this many standard errors out.
STRONG_SHARE, STRONG_Z = 0.98, 6.0
STRONG_EDGES = np.array([1, 4, 7])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SIGN = ~(_LETTER | _DIGIT)
_SIGN[:33] = False

#: Upper edges of the bins of the shares below; each share's bin is a feature.
EDGES = np.array([0.0005, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])
SHARES = 7
LENGTHS = np.array([20, 60, 200, 800, 3000])


def _share_columns() -> int:
    # upper case, digits, signs, repeated lines, lone signs, words like the one before; distinct words, by length
    return (SHARES - 1) * (len(EDGES) + 1) + (len(EDGES) + 1) * (len(LENGTHS) + 1)


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the rows' bytes: 32-bit hashes of terms and their rows (each once a row), share columns (rows x SHARES), rows with words."""
    rows = len(off) - 1
    first, end, tok = words(data, off)
    row = np.repeat(np.arange(rows), np.diff(tok))
    letter = _LETTER[data]
    upto = lambda mask: np.append(np.int32(0), np.cumsum(mask, dtype=np.int32))
    seen = upto(letter)
    pre = Prefix(BYTE_HASH[_LOWER[data[letter]]])
    a, b = seen[first], seen[end]
    some = b > a
    hashes, owners = [], []
    whole = pre.of(a[some], b[some])
    for k, h in ((0, whole), *((n, pre.of(a[some], np.minimum(a[some] + n, b[some]))) for n in BEGINNINGS)):
        hashes.append(mix(h + U(k)) >> U(32))
        owners.append(row[some])
    pairs = np.unique(np.concatenate(owners).astype(U) << U(32) | np.concatenate(hashes))
    distinct = np.bincount(np.unique(row[some].astype(U) << U(32) | (whole >> U(32))).astype(np.int64) >> 32, minlength=rows)
    n = np.bincount(row[some], minlength=rows)
    size = np.maximum(1, np.diff(off))
    each = lambda mask: np.diff(upto(mask)[off])
    letters = np.maximum(1, each(letter))
    line_end = np.flatnonzero(data == 10)
    cut = np.unique(np.concatenate([off, line_end + 1]))
    cut = cut[cut <= len(data)]
    line_row = np.searchsorted(off, cut[:-1], "right") - 1
    line = Prefix(BYTE_HASH[data]).of(cut[:-1], cut[1:])
    full = cut[1:] - cut[:-1] > 1
    lines = np.bincount(line_row[full], minlength=rows)
    single = np.bincount(np.unique(line_row[full].astype(U) << U(40) | (line[full] >> U(24))).astype(np.int64) >> 40, minlength=rows)
    alone = np.bincount(row[~some], minlength=rows)
    kept = row[some]
    again = np.bincount(kept[1:][(whole[1:] == whole[:-1]) & (kept[1:] == kept[:-1])], minlength=rows)
    shares = np.stack([each(_UPPER[data]) / letters, each(_DIGIT[data]) / size, each(_SIGN[data]) / size, 1 - single / np.maximum(1, lines), alone / np.maximum(1, n + alone), again / np.maximum(1, n), distinct / np.maximum(1, n)], 1)
    return (pairs & U(0xFFFFFFFF)).astype(np.uint32), (pairs >> U(32)).astype(np.int64), shares, n


def share_bins(shares: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Column of each share's bin, a row for each row."""
    width = len(EDGES) + 1
    at = np.searchsorted(EDGES, shares) + np.arange(SHARES) * width
    at[:, -1] += np.searchsorted(LENGTHS, n) * width
    return at


@dataclass
class Model:
    """Weights (of good) of terms, by their hash in order, of shares' bins, and of how many ``strong`` terms a row has."""

    terms: np.ndarray
    strong: np.ndarray
    weights: np.ndarray
    counts: np.ndarray
    shares: np.ndarray
    bias: float

    def __post_init__(self):
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[self.terms >> 16] = True

    def logits(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        term, row, shares, n = features(data, off)
        hit = self.maybe[term >> 16]
        term, row = term[hit], row[hit]
        at = np.minimum(np.searchsorted(self.terms, term), max(0, len(self.terms) - 1))
        out = self.shares[share_bins(shares, n)].sum(1) + self.bias
        if not len(self.terms):
            out += self.counts[0]
        else:
            hit = self.terms[at] == term
            out += np.bincount(row[hit], self.weights[at[hit]], len(off) - 1)
            out += self.counts[strong_bin(np.bincount(row[hit], self.strong[at[hit]], len(off) - 1))]
        return out


def strong_bin(n: np.ndarray) -> np.ndarray:
    """Bin of a number of strong terms; a word counts with its beginnings."""
    return np.searchsorted(STRONG_EDGES, n, "right")


def fit(docs: DataFrame, labels: DataFrame, good: str = "quality = 1 and toxic = 0", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED, least_z: float = 3.0) -> Model:
    """Logistic regression on at most ``most`` labelled rows, those whose ids hash lowest.

    Terms are all words and first letters of words that mark bad rows (share in bad over share in good rows, ``least_z``
    standard errors apart at least); clean rows are told by shares of upper case, digits, signs, repeated lines, repeated
    and distinct words.  Texts are read whole.  Labels with nulls, or of rows that are absent, teach nothing; of several
    labels of an id the worst counts, of several texts of an id the one whose XXH64 is least.  Without both kinds of labels
    every row has the labelled rows' odds (even ones, if there are none).
    """
    tune(docs.sparkSession)
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.expr(good).cast("int").alias("__y")).where("__id is not null and __y is not null")
    known = known.groupBy("__id").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(most)
    chosen = docs.sparkSession.createDataFrame(known.collect(), "__id long, __y int")  # ``most`` rows

    def make(batches):
        for batch in batches:
            trim()
            for i, j in spans_of_rows(buffers(batch.column("t"))[1], SLICE):
                part = batch.slice(i, j - i)
                data, off = buffers(part.column("t"))
                term, row, shares, n = features(data[off[0] : off[-1]], off - off[0])
                cut = np.searchsorted(row, np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays([part.column("y"), pa.array([term[a:b].astype("<u4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([x.astype("<i4").tobytes() for x in share_bins(shares, n)], pa.binary())], ["y", "terms", "shares"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").cast("binary").alias("t")).where("t is not null")
    one = rows.join(F.broadcast(chosen), "__id").groupBy("__id").agg(F.min_by("t", F.xxhash64("t")).alias("t"), F.first("__y").alias("y"))
    got = one.select("t", "y").mapInArrow(trimming(make), "y int, terms binary, shares binary").toPandas()  # ``most`` rows
    y = got.y.to_numpy(np.float64)
    none = Model(np.zeros(0, np.uint32), np.zeros(0), np.zeros(0), np.zeros(len(STRONG_EDGES) + 1), np.zeros(_share_columns()), float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))))
    if len(y) == 0 or y.min() == y.max():
        return none
    lists = [np.frombuffer(x, "<u4") for x in got.terms]
    terms, bad = _counts([x for x, g in zip(lists, y, strict=True) if not g])
    in_good, n = _counts([x for x, g in zip(lists, y, strict=True) if g])
    at = np.minimum(np.searchsorted(in_good, terms), len(in_good) - 1)
    fine = np.where(in_good[at] == terms, n[at], 0) if len(in_good) else np.zeros(len(terms), int)
    del in_good, n, at
    nb, ng = (1 - y).sum(), y.sum()
    p = (bad + fine) / len(y)
    z = (bad / nb - fine / ng) / np.sqrt(p * (1 - p) * (1 / nb + 1 / ng) + 1e-12)
    marks = np.flatnonzero((z > least_z) & (bad >= 0.9 * (bad + fine)))
    strong = ((z > STRONG_Z) & (bad >= STRONG_SHARE * (bad + fine)))[marks].astype(float)
    marks, m = terms[marks], len(marks)
    columns = []
    for t, s in zip(lists, got.shares, strict=True):
        k = np.minimum(np.searchsorted(marks, t), max(0, m - 1))
        k = k[marks[k] == t] if m else k[:0]
        columns.append(np.concatenate([k, [m + strong_bin(strong[k].sum())], m + len(STRONG_EDGES) + 1 + np.frombuffer(s, "<i4")]))
    del got, lists
    trim()
    w, bias = _logistic(columns, m + len(STRONG_EDGES) + 1 + _share_columns(), y)
    return Model(marks, strong, w[:m], w[m : m + len(STRONG_EDGES) + 1], w[m + len(STRONG_EDGES) + 1 :], bias)


def _counts(lists: list[np.ndarray], step: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of all lists, in order, and in how many lists each is; some lists at a time, to save memory."""
    values, n = np.zeros(0, np.uint32), np.zeros(0, np.int64)
    for i in range(0, len(lists), step):
        more, m = np.unique(np.concatenate(lists[i : i + step]), return_counts=True)
        values, at = np.unique(np.concatenate([values, more]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, m]), len(values)).astype(np.int64)
    return values, n


def _logistic(columns: list[np.ndarray], width: int, y: np.ndarray, rounds: int = 600, rate: float = 0.1, decay: float = 2e-5) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on all rows (each the list of its columns that are 1), with quadratic decay; deterministic."""
    at = np.concatenate(columns)
    size = np.array([len(c) for c in columns])
    first = np.cumsum(size) - size
    w, m, v = (np.zeros(width + 1) for _ in range(3))
    for t in range(1, rounds + 1):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[at], first) + w[-1], -30, 30)))
        e = p - y
        g = np.append(np.bincount(at, np.repeat(e, size), width) / len(y) + decay * w[:-1], e.mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def evidence(docs: DataFrame, model: Model, text_col: str = "text", drop: bool = False) -> DataFrame:
    """The columns of ``docs`` (with ``drop``: but the text) and ``__logit``, the classifier's log-odds that the text is good.

    Null text: as an empty one.  Long texts are read whole.  A column ``__logit`` of ``docs`` gives way.
    """
    tune(docs.sparkSession)
    docs = without(docs, "__logit")
    held = docs.sparkSession.sparkContext.broadcast(model)
    fields = [f for f in docs.schema.fields if not (drop and f.name == text_col)]
    names = [f.name for f in fields]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["__logit double"])

    def work(batches):
        for batch in batches:
            trim()
            for i, j in spans_of_rows(buffers(batch.column(text_col))[1], SLICE):
                part = batch.slice(i, j - i)
                data, off = buffers(part.column(text_col))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(held.value.logits(data[off[0] : off[-1]], off - off[0]))], [*names, "__logit"])

    return docs.mapInArrow(trimming(work), schema)


def _strength(row, between: str, units: str) -> float:
    """Prior weight in rows, from the variance between units beyond what binomial counts have (method of moments)."""
    n, mean = float(row["n"] or 0), float(row["s"] or 0) / max(1.0, float(row["n"] or 0))
    noise = mean * (1 - mean)
    spread = (float(row[between] or 0) - max(0.0, float(row[units] or 0)) * noise) / max(1.0, n - float(row["q" + between] or 0))
    return float(min(1e6, max(1.0, noise / spread - 1))) if spread > 0 else 1e6


def sites(scored: DataFrame) -> DataFrame:
    """``(host, path, prior, shift)`` of ``scored(host, path, p)``: each path's posterior share of good rows and its log-odds over all rows'.

    All rows of a site are summed before any shuffle.  A path's share is drawn to its host's, and a host's to the whole's,
    by as many rows' weight as the variance between paths and between hosts calls for.
    """
    path = scored.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("p").alias("s"))
    path = materialize(path, "paths")
    host = path.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("n") * F.col("n")).alias("hq"), F.count("*").alias("k"))
    total = host.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    if not total["n"]:
        return path.select("host", "path", F.lit(0.5).alias("prior"), F.lit(0.0).alias("shift"))
    mean = min(1 - 1e-6, max(1e-6, total["s"] / total["n"]))
    both = path.join(host.select(F.col("host").alias("host_"), "hn", "hs"), F.col("host").eqNullSafe(F.col("host_"))).drop("host_")
    h = host.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - F.lit(mean), 2)).alias("h"), (F.sum(F.col("hn") * F.col("hn")) / F.sum("hn")).alias("qh"), (F.count("*") - 1).alias("uh")).first()
    p = both.agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("hs") / F.col("hn"), 2)).alias("p"), F.sum(F.col("n") * F.col("n") / F.col("hn")).alias("qp"), (F.count("*") - F.lit(0)).alias("up")).first()
    a, b = _strength(h, "h", "uh"), _strength(p, "p", "up")
    upper = (F.col("hs") + a * mean) / (F.col("hn") + a)
    prior = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), (F.col("s") + b * upper) / (F.col("n") + b)))
    return both.select("host", "path", prior.alias("prior")).withColumn("shift", F.log(F.col("prior") / (1 - F.col("prior"))) - float(np.log(mean / (1 - mean))))


def classify(docs: DataFrame, model: Model, host: str = "source", path: str = "lang", text_col: str = "text", threshold: float = 0.5, carry: list[str] | None = None) -> DataFrame:
    """The columns of ``docs`` (or ``carry``) with ``site_prior``, ``score`` (posterior that the row is good) and ``keep`` (score >= threshold).

    ``host`` and ``path`` are SQL expressions (for pages: of the url).  Each row's odds are the classifier's times its
    path's over all rows'.  Texts are read once, whole, and their evidence is written.  Null hosts and paths are sites like
    any other.  A null text counts as an empty one.  Repeated rows each count.  Empty input: no rows.  Columns of ``docs``
    with an output's name give way to it.
    """
    own = ("site_prior", "score", "keep", "shift", "__host", "__path", "__logit", "__read", "__h", "__p")
    docs = without(docs, *own)
    carry = [c for c in docs.columns if carry is None or c in carry]
    keyed = docs.select(*[F.col(f"`{c}`") for c in carry], F.expr(host).cast("string").alias("__host"), F.expr(path).cast("string").alias("__path"), F.col(f"`{text_col}`").alias("__read"))
    full = materialize(evidence(keyed, model, "__read", drop=True), "evidence")
    scored = full.select(F.col("__host").alias("host"), F.col("__path").alias("path"), (1 / (1 + F.exp(-F.col("__logit")))).alias("p"))
    table = materialize(sites(scored).select(F.col("host").alias("__h"), F.col("path").alias("__p"), F.col("prior").alias("site_prior"), "shift"), "sites")
    if table.count() <= BROADCAST_SITES:
        table = F.broadcast(table)
    joined = full.join(table, full["__host"].eqNullSafe(table["__h"]) & full["__path"].eqNullSafe(table["__p"]), "left")
    score = 1 / (1 + F.exp(-(F.col("__logit") + F.coalesce("shift", F.lit(0.0)))))
    return joined.withColumn("score", score).withColumn("keep", F.col("score") >= threshold).select(*[F.col(f"`{c}`") for c in carry], "site_prior", "score", "keep")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return classify(docs.select("doc_id", "text", "source", "lang"), model, carry=["doc_id"]).select("doc_id", "site_prior", "score", "keep")
