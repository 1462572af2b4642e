"""Suffix-array dedup with a logarithmic family of sorted levels."""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm._blocks import HOT, Unit, remove_repeats

BATCH = 1 << 18


#: Suffixes whose first bytes are spelled out at once when two sorted arrays are held against each other.
CHUNK = 1 << 16


class Family:
    """Suffix arrays of one text, each with the smallest document of each suffix; sizes at least double from one to the next.

    A level is an array of positions in the text, sorted by the ``length`` bytes that follow.  A new batch gets an array of
    its own, is merge-scanned against all levels, and then merges with every level that isn't twice its size.
    """

    def __init__(self, length: int):
        self.length = length
        self.text = np.zeros(0, np.uint8)
        #: Sorted positions and their documents, from the largest level to the smallest.
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []

    def _spell(self, at: np.ndarray) -> np.ndarray:
        """The first ``length`` bytes of suffixes, as strings that compare like bytes."""
        view = np.lib.stride_tricks.sliding_window_view(self.text, self.length)
        return np.ascontiguousarray(view[at]).view(f"S{self.length}").ravel()

    def _scan(self, at: np.ndarray, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the sorted distinct suffixes ``at``: its place in the sorted ``level``, and whether its bytes stand there."""
        place, same = np.empty(len(at), np.int64), np.zeros(len(at), bool)
        for i in range(0, len(at), CHUNK):
            mine = self._spell(at[i : i + CHUNK])
            spelled = lambda p: self._spell(np.array([p]))[0]
            low, high = bisect_left(level, mine[0], key=spelled), bisect_right(level, mine[-1], key=spelled)
            done = 0
            for c in range(low, high, CHUNK):
                there = self._spell(level[c : min(c + CHUNK, high)])
                upto = int(np.searchsorted(mine, there[-1], "right"))
                k = np.searchsorted(there, mine[done:upto])
                place[i + done : i + upto] = c + k
                same[i + done : i + upto] = there[k] == mine[done:upto]
                done = upto
            place[i + done : i + len(mine)] = high
        return place, same

    def add(self, text: np.ndarray, starts: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Take suffixes of documents no smaller than those before; flags those whose first bytes a smaller one has.

        All batches are of the same ``text``.
        """
        self.text = text
        starts = starts.astype(np.int32 if len(text) < 1 << 31 else np.int64)
        keys = self._spell(starts)
        array = np.argsort(keys, kind="stable")  # the batch's suffix array, ties by document
        keys = keys[array]
        fresh = np.append(True, keys[1:] != keys[:-1])
        del keys
        group = np.cumsum(fresh) - 1
        at, least = starts[array[fresh]], doc[array[fresh]]
        best = least.copy()
        for level, theirs in self.levels:
            place, same = self._scan(at, level)
            best[same] = np.minimum(best[same], theirs[place[same]])
        flags = np.empty(len(starts), bool)
        flags[array] = doc[array] > best[group]
        new = best == least  # what a level already has from a smaller document isn't stored again
        self._push(at[new], least[new])
        return flags

    def _push(self, at: np.ndarray, docs: np.ndarray) -> None:
        if not len(at):
            return
        while self.levels and len(self.levels[-1][0]) < 2 * len(at):
            level, theirs = self.levels.pop()
            place, same = self._scan(at, level)  # where both have a suffix, the older level's document is no larger
            at, docs = np.insert(level, place[~same], at[~same]), np.insert(theirs, place[~same], docs[~same])
        self.levels.append((at, docs))


def _kernel(length: int, batch: int):
    def kernel(data: bytes, off: np.ndarray, wins: np.ndarray, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        flags, family, raw = np.zeros(int(wins.sum()), bool), Family(length), np.frombuffer(data, np.uint8)
        edge = np.append(0, np.cumsum(wins))
        i = 0
        while i < len(wins):
            j = max(i + 1, int(np.searchsorted(edge, edge[i] + batch, "right")) - 1)
            n = wins[i:j]
            starts = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(off[i:j], n)
            flags[edge[i] : edge[j]] = family.add(raw, starts, np.repeat(doc[i:j], n))
            i = j
        return flags

    return kernel


def _keep(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, list, bytes]:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    out.append(text[at:])
    kept = b"".join(out)
    return len(text), len(text) - len(kept), [{"start": a, "end": b} for a, b in spans], kept


def suffix_dedup(docs: DataFrame, length: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, batch: int = BATCH) -> DataFrame:
    """Remove every byte that a repeat of ``length`` bytes covers, where a document with a smaller id has it too.

    Passages meet in the reference block of their anchor; each block is fed to a family of suffix arrays in batches of
    about ``batch`` suffixes, by document.  Suffixes are ordered by their first ``length`` bytes, which is all that
    decides, and start where a passage still has ``length`` bytes, so that no match crosses a document.

    Returns the columns of ``docs`` but the text, and ``n_bytes``, ``n_removed``, ``spans`` (maximal removed runs of
    bytes, end exclusive) and ``kept`` (binary: a cut may fall inside a character).  Repeats are judged on the input.
    Runs that touch are one span.

    Null text: no bytes.  Null id: neither removes nor is removed.  Rows with equal ids do not remove each other's bytes.
    Shorter than ``length``: unchanged.  Empty input: no rows.  Columns of ``docs`` with an output's name give way to it.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    outputs = [("n_bytes", "bigint", pa.int64()), ("n_removed", "bigint", pa.int64()), ("spans", "array<struct<start:int,end:int>>", span), ("kept", "binary", pa.binary())]
    return remove_repeats(docs, Unit("byte", length, max(1, length * 2 // 5)), _kernel(length, batch), _keep, outputs, id_col, text_col, hot)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
k AS (SELECT doc_id, b, unnest(generate_series(1, n - 49)) AS i FROM d WHERE n >= 50),
h AS (SELECT doc_id, i, md5(b[i:i + 49]) AS h FROM k),
f AS (SELECT h, min(doc_id) AS m FROM h GROUP BY h),
hit AS (SELECT doc_id, i FROM h JOIN f USING (h) WHERE m < doc_id),
island AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
run AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM island),
span AS (SELECT doc_id, r, min(i) AS a, max(i) + 50 AS e FROM run GROUP BY ALL),
gap AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 1) AS a, a AS e FROM span UNION ALL SELECT s.doc_id, max(e), any_value(n) + 1 FROM span s JOIN d ON s.doc_id = d.doc_id GROUP BY 1),
kept AS (SELECT g.doc_id, string_agg(hex(b[g.a:g.e - 1]), '' ORDER BY g.a) AS x FROM gap g JOIN d ON g.doc_id = d.doc_id WHERE g.e > g.a GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n_spans, sum(e - a) AS n_removed FROM span GROUP BY 1)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(CASE WHEN c.doc_id IS NULL THEN b ELSE unhex(coalesce(x, '')) END) AS kept_sha256
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id
"""
