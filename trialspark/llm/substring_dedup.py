"""Substring dedup by relative Lempel-Ziv parsing of documents against indexed reference blocks."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm._blocks import HOT, Unit, remove_repeats


class ReferenceBlock:
    """The novel passages met so far, with an index from each window of ``window`` words to its first place."""

    def __init__(self, window: int):
        self.window = window
        self.passages: list[list[bytes]] = []
        self.index: dict[bytes, tuple[int, int]] = {}

    def parse(self, words: list[bytes]) -> list[tuple[int, int, int, int]]:
        """Factors (start, length, passage, place) of at least a window, greedily from the left.

        A factor goes on for as long as its source agrees.  The next one may overlap it: the first window that leaves a
        factor starts ``window - 1`` words before its end, so the parse resumes there and no window at a boundary is missed.
        """
        w, i, out = self.window, 0, []
        last = len(words) - w
        while i <= last:
            at = self.index.get(b" ".join(words[i : i + w]))
            if at is None:
                i += 1
                continue
            passage, place = at
            source = self.passages[passage]
            n, most = w, min(len(words) - i, len(source) - place)
            while n < most and words[i + n] == source[place + n]:
                n += 1
            out.append((i, n, passage, place))
            i += n - w + 1
        return out

    def add(self, words: list[bytes], factors: list[tuple[int, int, int, int]]) -> None:
        """Index the windows of a parsed passage that no factor covers."""
        w, i, own = self.window, 0, len(self.passages)
        self.passages.append(words)
        for start, n, _, _ in [*factors, (len(words), 0, 0, 0)]:
            for j in range(i, min(start, len(words) - w + 1)):
                self.index.setdefault(b" ".join(words[j : j + w]), (own, j))
            i = start + n - w + 1


def _kernel(window: int):
    def kernel(data: bytes, off: np.ndarray, wins: np.ndarray, doc: np.ndarray, key: np.ndarray) -> np.ndarray:
        flags = np.zeros(int(wins.sum()), bool)
        block, at, waiting, before = ReferenceBlock(window), 0, [], None
        for i, (a, b, n, d) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), wins.tolist(), doc.tolist(), strict=True)):
            if d != before:  # a document's passages join the reference only once the document is done
                for item in waiting:
                    block.add(*item)
                waiting, before = [], d
            words = data[a:b].split(b" ")
            factors = block.parse(words)
            for start, length, _, _ in factors:
                flags[at + start : at + start + length - window + 1] = True
            waiting.append((words, factors))
            at += n
        return flags

    return kernel


def _keep(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, list, str]:
    words, out, at = text.split(), [], 0
    for a, b in spans:
        out += words[at:a]
        at = b
    out += words[at:]
    return len(words), len(words) - len(out), [{"start": a, "end": b} for a, b in spans], b" ".join(out).decode("utf-8", "replace")


def _cut(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, list, str]:
    """Like ``_keep``, but what is left keeps its own white space, and a text without repeats stays as it is."""
    if not spans:
        return len(text.split()), 0, [], text.decode("utf-8", "replace")
    at = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", text)]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : at[a][0]])
        last = at[b][0] if b < len(at) else len(text)
    out.append(text[last:])
    return len(at), sum(b - a for a, b in spans), [{"start": a, "end": b} for a, b in spans], b"".join(out).decode("utf-8", "replace")


def substring_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, own_space: bool = False) -> DataFrame:
    """Remove every word that a repeat of ``window`` words covers, where a document with a smaller id has it too.

    Words are runs of bytes other than space and \\t \\n \\v \\f \\r.  Returns the columns of ``docs`` but the text, and
    ``n_words``, ``n_removed``, ``spans`` (removed runs of words, end exclusive) and ``kept`` (what is left, joined by a
    space; with ``own_space``, by the white space they had).  Repeats are judged on the input.

    Null text: no words.  Null id: neither removes nor is removed.  Rows with equal ids do not remove each other's words.
    Shorter than a window: unchanged.  Empty input: no rows.  Columns of ``docs`` with an output's name give way to it.
    Anchors in more than ``hot`` groups are routed window by window.
    """
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    outputs = [("n_words", "bigint", pa.int64()), ("n_removed", "bigint", pa.int64()), ("spans", "array<struct<start:int,end:int>>", span), ("kept", "string", pa.string())]
    return remove_repeats(docs, Unit("word", window, max(1, window // 6)), _kernel(window), _cut if own_space else _keep, outputs, id_col, text_col, hot)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
k AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM k),
f AS (SELECT h, min(doc_id) AS m FROM h GROUP BY h),
gone AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS p FROM h JOIN f USING (h) WHERE m < doc_id),
t AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS p FROM d),
kept AS (SELECT t.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY t.p) AS s FROM t LEFT JOIN gone g ON t.doc_id = g.doc_id AND t.p = g.p WHERE g.p IS NULL GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
