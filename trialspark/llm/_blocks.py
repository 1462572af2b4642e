"""Content-routed reference blocks for exact repeats of a fixed window length.

A window of W units (words or bytes) has one anchor: the least hash among its k-unit grams.  Equal windows have equal
anchors, so every repeat of a window meets in the block its anchor hashes to, and no other block can hold it.

1. Documents are dealt once into groups by a hash of their id (this exchange is reused by the later passes).
2. Each group sends every block the sorted 32-bit keys of its anchors, and how much it has at those with more than one
   passage; the block answers with two bits a key: held by another group, and hot (over HOT KB of distinct passages).
3. At a hot anchor each window is a passage of its own, routed by its own hash, so that no block grows with the anchor.
   Groups first send the keys of these windows alone, and the blocks answer which of them another group holds.
4. Each group sends the passages (or windows) that may occur in two documents.  One whose bytes a smaller document of
   the same group has at that anchor is settled there.
5. A block collapses passages of equal bytes, and its kernel finds which windows of the distinct ones stand in smaller
   documents.
6. Spans return to the groups and meet the texts.

Hashes only say what is to be compared.  A false match costs a comparison and never a result: passages count as equal
once their bytes (of words: the words) are, and kernels compare the units themselves.  Rows without an id take no part
and are never exchanged.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm._session import trim, tune, units, without
from trialspark.llm._text import BYTE_HASH, Prefix, U, buffers, mix, sliding_min, spans_of_rows, words

#: Stored input bytes of a group. Byte windows need more work space than word windows.
GROUP_BYTES = {"word": 3 << 20, "byte": 5 << 19}
SLICE = 1 << 19
#: KB of distinct passages at an anchor beyond which its windows are routed one by one.
HOT = 4096
#: Beyond so many partitions (or the session's own number) a partition has more groups, one after another.
MOST_PARTITIONS = 20_000
G, TEXT = "__g", "__text"
KEYS = "b int, g int, keys binary, more binary"
ANSWERS = "g int, b int, bits binary, hot boolean"
PASSAGES = "b int, g int, keys binary, docs binary, rows binary, starts binary, wins binary, sizes binary, data binary, spans binary"


@dataclass(frozen=True)
class Unit:
    """What a window counts: ``window`` units of ``kind`` ("word" or "byte"), grams of ``k`` units as anchors."""

    kind: str
    window: int
    k: int


@dataclass
class Runs:
    """Maximal runs of windows of one row with one anchor."""

    row: np.ndarray
    start: np.ndarray
    wins: np.ndarray
    key: np.ndarray
    region: np.ndarray
    #: Where the run's units lie in the group's bytes.
    first: np.ndarray
    end: np.ndarray

    def pick(self, which: np.ndarray) -> Runs:
        return Runs(*[getattr(self, n)[which] for n in Runs.__dataclass_fields__])


def _units(unit: Unit, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Prefix]:
    """First byte and end of each unit of each row, n+1 offsets of the rows' units, and hashes of their ranges."""
    if unit.kind == "word":
        first, end, tok = words(data, off)
        return first, end, tok, Prefix(Prefix(BYTE_HASH[data]).of(first, end))
    first = np.arange(len(data))
    return first, first + 1, off, Prefix(BYTE_HASH[data])


def _runs(unit: Unit, data: np.ndarray, off: np.ndarray, base: int, before: int = 0) -> Runs | None:
    """Runs of the rows that ``off`` (offsets into the group's ``data``) delimits; ``base``: number of the first row.

    ``before``: units of the (only) row ahead of its first byte here.
    """
    lo = int(off[0])
    first, end, tok, pre = _units(unit, data[lo : int(off[-1])], off - off[0])
    if len(first) < unit.window:
        return None
    low = sliding_min(pre.grams(unit.k), unit.window - unit.k + 1)
    row = np.repeat(np.arange(len(tok) - 1), np.diff(tok))
    valid = row[: len(low)] == row[unit.window - 1 :]
    begin = valid.copy()
    begin[1:] &= ~valid[:-1] | (low[1:] != low[:-1])
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | begin[1:]
    at, wins = np.flatnonzero(begin), np.flatnonzero(stop)
    wins = wins - at + 1
    key = mix(low[at] ^ U(0xA0761D6478BD642F))
    last = at + wins + unit.window - 1
    return Runs(row[at] + base, at - tok[row[at]] + before, wins, key, pre.of(at, last), first[at] + lo, end[last - 1] + lo)


def _within(lengths: np.ndarray) -> np.ndarray:
    """0 .. length-1 for each length, one after another."""
    return np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _long(unit: Unit, data: np.ndarray, a: int, b: int, row: int) -> list[Runs]:
    """Runs of a row longer than a slice, by pieces that overlap by a window less one unit."""
    out, before = [], 0
    while a < b:
        end = min(b, a + SLICE)
        if unit.kind == "word":
            while True:
                first, _, _ = words(data[a:end], np.array([0, end - a]))
                # the last word may go on, so the piece needs a window and more unless it is the last
                if end == b or len(first) > unit.window + 1:
                    break
                end = min(b, end + SLICE)
            stop = end if end == b else a + int(first[-1])
            step, place = (len(first), b) if end == b else (len(first) - unit.window, a + int(first[len(first) - unit.window]))
        else:
            stop = end
            step, place = (end - a, b) if end == b else (end - a - unit.window + 1, end - unit.window + 1)
        r = _runs(unit, data, np.array([a, stop]), row, before)
        if r is not None:
            out.append(r)
        a, before = place, before + step
    return out


def _group(unit: Unit, data: np.ndarray, off: np.ndarray) -> Runs:
    parts: list[Runs] = []
    for i, j in spans_of_rows(off, SLICE):
        if off[j] - off[i] > SLICE:
            parts += _long(unit, data, int(off[i]), int(off[j]), i)
        elif (r := _runs(unit, data, off[i : j + 1], i)) is not None:
            parts.append(r)
    if not parts:
        return Runs(*[np.zeros(0, t) for t in (np.int64, np.int64, np.int64, U, U, np.int64, np.int64)])
    return Runs(*[np.concatenate([getattr(p, n) for p in parts]) for n in Runs.__dataclass_fields__])


def _windows(unit: Unit, data: np.ndarray, runs: Runs) -> Runs:
    """The windows of runs, each with its own hash as key."""
    parts, size = [], np.append(0, np.cumsum(runs.end - runs.first))
    for i, j in spans_of_rows(size, SLICE):
        mine = runs.pick(np.arange(i, j))
        text = np.concatenate([data[a:b] for a, b in zip(mine.first.tolist(), mine.end.tolist(), strict=True)])
        first, end, tok, pre = _units(unit, text, size[i : j + 1] - size[i])
        of, k = np.repeat(np.arange(j - i), mine.wins), _within(mine.wins)
        at = tok[of] + k
        region = pre.of(at, at + unit.window)
        shift = mine.first[of] - (size[i:j] - size[i])[of]
        key = mix(region ^ U(0xE7037ED1A0B428DB))
        parts.append(Runs(mine.row[of], mine.start[of] + k, np.ones(len(of), np.int64), key, region, first[at] + shift, end[at + unit.window - 1] + shift))
    return Runs(*[np.concatenate([getattr(p, n) for p in parts]) for n in Runs.__dataclass_fields__]) if parts else runs


def _short(key: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and 32-bit key; one combined value orders and identifies both."""
    block = (key % U(blocks)).astype(np.int64)
    return block, block << 32 | ((key >> U(20)) & U(0xFFFFFFFF)).astype(np.int64)


def _rows(table: pa.Table, id_col: str) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """The group's rows in an order that every pass repeats, with their ids and the bytes of their texts."""
    hashes = [xxhash.xxh64_intdigest(x.as_buffer()) if x.is_valid else 0 for x in table[TEXT].cast(pa.large_binary())]
    order = pc.sort_indices(pa.table({"i": table[id_col], "h": pa.array(hashes, pa.uint64())}), [("i", "ascending"), ("h", "ascending")])
    table = table.take(order)
    data, off = buffers(table[TEXT].cast(pa.large_binary()))
    return table, table[id_col].to_numpy().astype(np.int64), data, off


def _messages(code: np.ndarray, g: int, weight: np.ndarray | None = None) -> pa.Table:
    """A row for each block of the ascending distinct ``code``: its keys, and (place, weight) of those that weigh over 1."""
    out = []
    for part in np.split(np.arange(len(code)), np.flatnonzero(np.diff(code >> 32)) + 1):
        if len(part):
            w = weight[part] if weight is not None else np.ones(len(part), np.int64)
            heavy = np.flatnonzero(w > 1)
            more = np.stack([heavy, np.minimum(w[heavy], 1 << 30)], 1).astype("<u4").tobytes()
            out.append((int(code[part[0]] >> 32), g, (code[part] & 0xFFFFFFFF).astype("<u4").tobytes(), more))
    columns = zip(*out, strict=True) if out else ([], [], [], [])
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.table({f.split()[0]: pa.array(x, t) for f, x, t in zip(KEYS.split(", "), columns, kinds, strict=True)})


def _send_keys(unit: Unit, id_col: str, blocks: int) -> Callable[[pa.Table], pa.Table]:
    def send(table: pa.Table) -> pa.Table:
        g = table[G][0].as_py()
        _, _, data, off = _rows(table, id_col)
        runs = _group(unit, data, off)
        _, code = _short(runs.key, blocks)
        order = np.lexsort((runs.wins, runs.region, code))
        c, r, w = code[order], runs.region[order], runs.wins[order]
        distinct = order[np.append(True, (c[1:] != c[:-1]) | (r[1:] != r[:-1]) | (w[1:] != w[:-1]))] if len(order) else order
        keys, inverse = np.unique(code[distinct], return_inverse=True)
        weight = np.bincount(inverse, 1 + (runs.end - runs.first)[distinct] // 1024, len(keys)).astype(np.int64)
        return _messages(keys, g, weight)

    return send


def _answer(hot: int) -> Callable[[pa.Table], pa.Table]:
    def answer(table: pa.Table) -> pa.Table:
        lists = [np.frombuffer(x, "<u4") for x in table["keys"].to_pylist()]
        keys = np.concatenate(lists)
        weight = np.ones(len(keys), np.int64)
        n = 0
        for x, more in zip(lists, table["more"].to_pylist(), strict=True):
            at, w = np.frombuffer(more, "<u4").reshape(-1, 2).astype(np.int64).T
            weight[n + at] = w
            n += len(x)
        order = np.argsort(keys, kind="stable")
        fresh = np.diff(keys[order].astype(np.int64), prepend=-1) != 0
        at = np.flatnonzero(fresh)
        of = np.cumsum(fresh) - 1
        shared, heavy = np.empty(len(keys), bool), np.empty(len(keys), bool)
        shared[order] = (np.diff(np.append(at, len(keys))) > 1)[of]
        heavy[order] = (np.add.reduceat(weight[order], at) > hot)[of]
        heavy &= shared
        out, n = [], 0
        for g, x in zip(table["g"].to_pylist(), lists, strict=True):
            one, two = shared[n : n + len(x)], heavy[n : n + len(x)]
            n += len(x)
            if one.any():
                out.append((g, table["b"][0].as_py(), np.packbits(np.concatenate([one, two])).tobytes(), bool(two.any())))
        columns = zip(*out, strict=True) if out else ([], [], [], [])
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.bool_())
        return pa.table({f.split()[0]: pa.array(x, t) for f, x, t in zip(ANSWERS.split(", "), columns, kinds, strict=True)})

    return answer


def _told(known: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Of the ascending codes ``known``: which the answers say another group holds, and which are hot."""
    shared, hot, top = np.zeros(len(known), bool), np.zeros(len(known), bool), known >> 32
    for b, bits in zip(answers["b"].to_pylist(), answers["bits"].to_pylist(), strict=True):
        i, j = np.searchsorted(top, (b, b + 1))
        flag = np.unpackbits(np.frombuffer(bits, np.uint8), count=2 * (j - i)).astype(bool)
        shared[i:j], hot[i:j] = flag[: j - i], flag[j - i :]
    return shared, hot


def _send_lone_keys(unit: Unit, id_col: str, blocks: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Keys of the windows at hot anchors."""

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not pc.any(answers["hot"]).as_py():
            return _messages(np.zeros(0, np.int64), 0)
        g = table[G][0].as_py()
        _, _, data, off = _rows(table, id_col)
        runs = _group(unit, data, off)
        known, inverse = np.unique(_short(runs.key, blocks)[1], return_inverse=True)
        split = _windows(unit, data, runs.pick(_told(known, answers)[1][inverse]))
        return _messages(np.unique(_short(split.key, blocks)[1]), g)

    return send


def _in_two(code: np.ndarray, doc: np.ndarray, answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Which runs' codes two documents may hold, and which are hot."""
    known, inverse = np.unique(code, return_inverse=True)
    shared, hot = _told(known, answers)
    low, high = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
    np.minimum.at(low, inverse, doc)
    np.maximum.at(high, inverse, doc)
    return (shared | (low < high))[inverse], hot[inverse]


def _send_passages(unit: Unit, id_col: str, blocks: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    names = [x.split()[0] for x in PASSAGES.split(", ")]

    def send(table: pa.Table, answers: pa.Table) -> pa.Table:
        empty = pa.table({n: pa.array([], pa.int32() if n in "bg" else pa.binary()) for n in names})
        if not table.num_rows:
            return empty
        g = table[G][0].as_py()
        _, ids, data, off = _rows(table, id_col)
        runs = _group(unit, data, off)
        if not len(runs.key):
            return empty
        shared, hot = _in_two(_short(runs.key, blocks)[1], ids[runs.row], answers.filter(pc.invert(answers["lone"])))
        if hot.any():
            split = _windows(unit, data, runs.pick(hot))
            again, _ = _in_two(_short(split.key, blocks)[1], ids[split.row], answers.filter(answers["lone"]))
            whole, split = runs.pick(shared & ~hot), split.pick(again)
            runs = Runs(*[np.concatenate([getattr(whole, n), getattr(split, n)]) for n in Runs.__dataclass_fields__])
        else:
            runs = runs.pick(shared)
        if not len(runs.key):
            return empty
        text = data.tobytes()
        block, code = _short(runs.key, blocks)
        doc = ids[runs.row]
        order = np.lexsort((doc, runs.region, runs.wins, code))
        c, r, w = code[order], runs.region[order], runs.wins[order]
        fresh = np.append(True, (c[1:] != c[:-1]) | (r[1:] != r[:-1]) | (w[1:] != w[:-1]))
        least = order[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
        settled = doc[order] > doc[least]
        for k in np.flatnonzero(settled).tolist():
            i, j = order[k], least[k]
            x, y = text[runs.first[i] : runs.end[i]], text[runs.first[j] : runs.end[j]]
            settled[k] = x == y or unit.kind == "word" and x.split() == y.split()
        out = []
        cut = np.flatnonzero(np.diff(block[order], prepend=-1))
        for part in np.split(np.arange(len(order)), cut[1:]):
            mine = runs.pick(order[part[~settled[part]]])
            done = runs.pick(order[part[settled[part]]])
            pieces = [text[a:b] for a, b in zip(mine.first.tolist(), mine.end.tolist(), strict=True)]
            if unit.kind == "word":
                pieces = [b" ".join(x.split()) for x in pieces]
            short = _short(mine.key, blocks)[1] & 0xFFFFFFFF
            numbers = [x.astype("<i4").tobytes() for x in (mine.row, mine.start, mine.wins, np.array([len(x) for x in pieces], np.int64))]
            spans = _pack(done.row, done.start, done.start + done.wins + unit.window - 1)
            out.append((int(block[order[part[0]]]), g, short.astype("<u4").tobytes(), ids[mine.row].astype("<i8").tobytes(), *numbers, b"".join(pieces), spans))
        return pa.table({n: pa.array(x, pa.int32() if n in "bg" else pa.binary()) for n, x in zip(names, zip(*out, strict=True), strict=True)})

    return send


def _pack(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Spans by row, overlapping and touching ones joined."""
    return np.stack(_join(row, start, end), 1).astype("<i4").tobytes() if len(row) else b""


def _join(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((start, row))
    row, start, end = row[order].astype(np.int64), start[order].astype(np.int64), end[order].astype(np.int64)
    reach = np.maximum.accumulate(end + (row << 32)) - (row << 32)  # rows ascend, so the running maximum stays within a row
    fresh = np.ones(len(row), bool)
    fresh[1:] = (row[1:] != row[:-1]) | (start[1:] > reach[:-1])
    at = np.flatnonzero(fresh)
    return row[at], start[at], reach[np.append(at[1:], len(row)) - 1]


#: data, n+1 offsets, windows, documents and anchor keys of distinct passages, in order of documents; gives a flag for each window.
Kernel = Callable[[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _solve(unit: Unit, kernel: Kernel) -> Callable[[pa.Table], pa.Table]:
    def solve(table: pa.Table) -> pa.Table:
        get = lambda n, t: np.concatenate([np.frombuffer(x, t) for x in table[n].to_pylist()]).astype(np.int64)
        key, doc, row, start, wins, size = (get(n, t) for n, t in (("keys", "<u4"), ("docs", "<i8"), ("rows", "<i4"), ("starts", "<i4"), ("wins", "<i4"), ("sizes", "<i4")))
        g = np.repeat(np.array(table["g"].to_pylist(), np.int64), [len(x) // 4 for x in table["keys"].to_pylist()])
        spans: dict[int, list[np.ndarray]] = {}
        for gi, x in zip(table["g"].to_pylist(), table["spans"].to_pylist(), strict=True):
            if x:
                spans.setdefault(gi, []).append(np.frombuffer(x, "<i4").reshape(-1, 3))
        if len(key):
            text = b"".join(table["data"].to_pylist())
            off = np.append(0, np.cumsum(size))
            region = _region(np.frombuffer(text, np.uint8), off)
            order = np.lexsort((doc, size, region, key))
            k, r, s = key[order], region[order], size[order]
            fresh = np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1]) | (s[1:] != s[:-1]))
            of = np.cumsum(fresh) - 1
            lead = order[fresh].tolist()
            for i in np.flatnonzero(~fresh).tolist():
                a, b = off[order[i]], off[lead[of[i]]]
                if text[a : a + s[i]] != text[b : b + s[i]]:  # equal in hash alone: a passage of its own
                    of[i] = len(lead)
                    lead.append(order[i])
            first = np.array(lead)  # the smallest document with each distinct passage
            full = doc[order] > doc[first][of]
            by = np.lexsort((key[first], doc[first]))
            chosen = first[by]
            view = memoryview(text)
            flags = kernel(b"".join([view[a:b] for a, b in zip(off[chosen].tolist(), off[chosen + 1].tolist(), strict=True)]), np.append(0, np.cumsum(size[chosen])), wins[chosen], doc[chosen], key[chosen])
            at = np.empty(len(first), np.int64)
            at[by] = np.cumsum(wins[chosen]) - wins[chosen]
            whole = order[full]
            found = [(g[whole], row[whole], start[whole], start[whole] + wins[whole] + unit.window - 1)]
            other = np.flatnonzero(~full)
            mine, where = order[other], at[of[other]]
            each = np.repeat(np.arange(len(mine)), wins[mine])
            w = _within(wins[mine])
            hit = flags[where[each] + w]
            each, w = each[hit], w[hit]
            found.append((g[mine][each], row[mine][each], start[mine][each] + w, start[mine][each] + w + unit.window))
            gg, rr, ss, ee = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(gg, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(gg[order])) + 1):
                if len(part):
                    spans.setdefault(int(gg[part[0]]), []).append(np.stack(_join(rr[part], ss[part], ee[part]), 1).astype("<i4"))
        return pa.table({"g": pa.array(list(spans), pa.int32()), "spans": pa.array([np.concatenate(x).tobytes() for x in spans.values()], pa.binary())})

    return solve


def _region(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Hash of each passage, in pieces so that the work space stays small."""
    out = [np.zeros(0, U)]
    for i, j in spans_of_rows(off, SLICE):
        lo = off[i]
        out.append(Prefix(BYTE_HASH[data[lo : off[j]]]).of(off[i:j] - lo, off[i + 1 : j + 1] - lo))
    return np.concatenate(out)


def _trimmed(f):
    """``f`` of a group or block, after which the worker gives its memory back."""

    def run(*tables: pa.Table) -> pa.Table:
        out = f(*tables)
        trim()
        return out

    run.__signature__ = inspect.signature(f)
    return run


def remove_repeats(docs: DataFrame, unit: Unit, kernel: Kernel, keep: Callable[[bytes, list[tuple[int, int]]], tuple], outputs: list[tuple[str, str, pa.DataType]], id_col: str, text_col: str, hot: int = HOT) -> DataFrame:
    """``docs`` with ``outputs`` (name, SQL type, Arrow type) that ``keep`` makes of each row's bytes and its repeated spans in units."""
    tune(docs.sparkSession)
    docs = without(docs, *[n for n, _, _ in outputs], G, TEXT)
    groups = units(docs, GROUP_BYTES[unit.kind])
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(-(-groups // 8), MOST_PARTITIONS))
    ready = docs.withColumn(TEXT, F.col(f"`{text_col}`").cast("binary")).withColumn(id_col, F.col(f"`{id_col}`").cast("long")).drop(text_col)
    # rows of one id with different texts may part, so that no id makes a group large
    group = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), TEXT, F.lit(17)), F.lit(groups)).cast("int")
    dealt = ready.where(F.col(f"`{id_col}`").isNotNull()).withColumn(G, group).repartition(n, G)
    keys = dealt.groupBy(G).applyInArrow(_trimmed(_send_keys(unit, id_col, groups)), KEYS)
    answers = keys.groupBy("b").applyInArrow(_trimmed(_answer(hot)), ANSWERS)
    lone_keys = dealt.groupBy(G).cogroup(answers.groupBy("g")).applyInArrow(_trimmed(_send_lone_keys(unit, id_col, groups)), KEYS)
    lone = lone_keys.groupBy("b").applyInArrow(_trimmed(_answer(hot)), ANSWERS)
    told = answers.withColumn("lone", F.lit(False)).unionByName(lone.withColumn("lone", F.lit(True)))
    passages = dealt.groupBy(G).cogroup(told.groupBy("g")).applyInArrow(_trimmed(_send_passages(unit, id_col, groups)), PASSAGES)
    spans = passages.groupBy("b").applyInArrow(_trimmed(_solve(unit, kernel)), "g int, spans binary")
    plain = [f for f in ready.schema.fields if f.name not in (G, TEXT)]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain] + [f"`{n}` {t}" for n, t, _ in outputs])

    def finish(table: pa.Table, found: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.Table.from_arrays([table[f.name] for f in plain] + [pa.array([], t) for _, _, t in outputs], [f.name for f in plain] + [n for n, _, _ in outputs])
        table, _, data, off = _rows(table, id_col)
        by: dict[int, list[tuple[int, int]]] = {}
        raw = b"".join(found["spans"].to_pylist())
        if raw:
            x = np.frombuffer(raw, "<i4").reshape(-1, 3)
            for r, a, b in zip(*(y.tolist() for y in _join(x[:, 0], x[:, 1], x[:, 2])), strict=True):
                by.setdefault(r, []).append((a, b))
        text = data.tobytes()
        made = [keep(text[a:b], by.get(i, [])) for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True))]
        return pa.Table.from_arrays([table[f.name] for f in plain] + [pa.array(x, t) for x, (_, _, t) in zip(zip(*made, strict=True), outputs, strict=True)], [f.name for f in plain] + [n for n, _, _ in outputs])

    def untouched(batches):
        for batch in batches:
            made = [keep(x.as_py() or b"", []) for x in batch.column(TEXT)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in plain] + [pa.array(x, t) for x, (_, _, t) in zip(zip(*made, strict=True), outputs, strict=True)], [f.name for f in plain] + [n for n, _, _ in outputs])

    whole = dealt.groupBy(G).cogroup(spans.groupBy("g")).applyInArrow(_trimmed(finish), schema)
    return whole.unionByName(ready.where(F.col(f"`{id_col}`").isNull()).mapInArrow(untouched, schema))
