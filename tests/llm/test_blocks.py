"""Exchange of passages: equal hashes without equal bytes, bounded blocks, many groups."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from trialspark.llm import _blocks, substring_dedup, suffix_dedup
from trialspark.llm._text import BYTE_HASH, Prefix, words


def least_gram(kind, k, alphabet, n, seed):
    """The k units with the least hash among those of a long random sequence."""
    r = random.Random(seed)
    units = [r.choice(alphabet) for _ in range(n)]
    if kind == "word":
        data = np.frombuffer(" ".join(units).encode(), np.uint8)
        first, end, _ = words(data, np.array([0, len(data)]))
        value = Prefix(BYTE_HASH[data]).of(first, end)
    else:
        value = BYTE_HASH[np.frombuffer("".join(units).encode(), np.uint8)]
    at = int(Prefix(value).grams(k).argmin())
    return units[at : at + k]


def colliding(kind):
    """Two texts without a common window whose polynomial hashes modulo 2**64 are equal: their two-valued places form a Thue-Morse sequence and its complement."""
    r = random.Random(4)
    if kind == "word":
        anchor, step, n = least_gram("word", 8, [f"a{i}" for i in range(5000)], 400_000, 1), 20, 1024
        fill, two, glue = lambda i: [f"f{i}x{j}" for j in range(step - 9)], ("yes", "no"), " "
    else:
        letters = "abcdefghijklmnopqrstuvwxyz"
        anchor, step, n = least_gram("byte", 20, letters, 2_000_000, 2), 28, 4096
        seen = {}
        fill, two, glue = lambda i: seen.setdefault(i, [r.choice(letters) for _ in range(step - 21)]), ("0", "1"), ""
    out = []
    for flip in (0, 1):
        units = []
        for i in range(n):
            units += [*anchor, *fill(i), two[(i.bit_count() & 1) ^ flip]]
        out.append(glue.join([*units, *anchor[:1]]))
    return out


@pytest.mark.parametrize("groups", [1, 9])
@pytest.mark.parametrize("kind", ["word", "byte"])
def test_equal_hashes_remove_nothing(spark, monkeypatch, kind, groups):
    a, b = colliding(kind)
    split = (lambda t: t.split()) if kind == "word" else (lambda t: t)
    window = lambda u: {tuple(u[i : i + 50]) for i in range(len(u) - 49)}
    assert not window(split(a)) & window(split(b))
    unit = _blocks.Unit(kind, 50, 8 if kind == "word" else 20)
    data, off = np.frombuffer((a + b).encode(), np.uint8), np.array([0, len(a), len(a) + len(b)])
    runs = _blocks._group(unit, data, off)
    assert len(set(runs.region.tolist())) < len(runs.region)  # the hashes do collide
    monkeypatch.setattr(_blocks, "units", lambda df, n: groups)
    docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
    out = {r.doc_id: r for r in (substring_dedup.substring_dedup if kind == "word" else suffix_dedup.suffix_dedup)(docs).collect()}
    assert out[1].n_removed == out[2].n_removed == 0
    assert out[3].n_removed == len(split(a))


def table(rows, g=0):
    ids, texts = zip(*rows, strict=True)
    return pa.table({"doc_id": pa.array(ids, pa.int64()), _blocks.G: pa.array([g] * len(ids), pa.int32()), _blocks.TEXT: pa.array([t.encode() for t in texts], pa.binary())})


def test_windows_of_hot_anchors_stay_home_unless_shared():
    """A line all documents have, with other words around it: its anchor is hot, but no window is held twice."""
    r = random.Random(3)
    line = least_gram("word", 8, [f"a{i}" for i in range(5000)], 200_000, 1)
    unit, blocks, hot = _blocks.Unit("word", 50, 8), 7, 40
    around = lambda: " ".join([*(f"w{r.randint(0, 10**9)}" for _ in range(60)), *line, *(f"w{r.randint(0, 10**9)}" for _ in range(60))])
    groups = [[(100 * g + i, around()) for i in range(20)] for g in range(6)]
    groups[5].append((599, groups[0][3][1]))
    keys = pa.concat_tables([_blocks._send_keys(unit, "doc_id", blocks)(table(x, g)) for g, x in enumerate(groups)])
    by = lambda t, c: [t.filter(pa.compute.equal(t[c], v)) for v in sorted(set(t[c].to_pylist()))]
    answers = pa.concat_tables([_blocks._answer(hot)(x) for x in by(keys, "b")])
    assert any(answers["hot"].to_pylist())
    of = lambda t, g: t.filter(pa.compute.equal(t["g"], g))
    lone_keys = pa.concat_tables([_blocks._send_lone_keys(unit, "doc_id", blocks)(table(x, g), of(answers, g)) for g, x in enumerate(groups)])
    lone = pa.concat_tables([_blocks._answer(hot)(x) for x in by(lone_keys, "b")])
    told = pa.concat_tables([t.append_column("lone", pa.array([flag] * t.num_rows)) for t, flag in ((answers, False), (lone, True))])
    sent = pa.concat_tables([_blocks._send_passages(unit, "doc_id", blocks)(table(x, g), of(told, g)) for g, x in enumerate(groups)])
    assert sum(len(x) // 8 for x in sent["docs"].to_pylist()) < 300 and set(sent["g"].to_pylist()) == {0, 5}
    found = [(g, np.frombuffer(s, "<i4").reshape(-1, 3)) for x in by(sent, "b") for g, s in zip(*_blocks._solve(unit, substring_dedup._kernel(50))(x).to_pydict().values(), strict=True)]
    assert {g for g, _ in found} == {5} and min(s[:, 1].min() for _, s in found) == 0 and max(s[:, 2].max() for _, s in found) == 128


def test_many_groups_and_blocks_cost_a_group_nothing():
    r = random.Random(6)
    rows = [(i, " ".join(f"w{r.randint(0, 10**6)}" for _ in range(200))) for i in range(60)]
    unit, blocks = _blocks.Unit("word", 50, 8), 10**8
    began = time.perf_counter()
    keys = _blocks._send_keys(unit, "doc_id", blocks)(table(rows))
    held = pa.concat_tables([keys, keys.set_column(1, "g", pa.array([1] * keys.num_rows, pa.int32()))])
    some = sorted(set(held["b"].to_pylist()))[:50]
    answers = pa.concat_tables([_blocks._answer(4096)(held.filter(pa.compute.equal(held["b"], b))) for b in some])
    mine = answers.filter(pa.compute.equal(answers["g"], 0))
    sent = _blocks._send_passages(unit, "doc_id", blocks)(table(rows), mine.append_column("lone", pa.array([False] * mine.num_rows)))
    assert sorted(sent["b"].to_pylist()) == some and time.perf_counter() - began < 5


def test_null_and_repeated_ids_are_spread(spark, monkeypatch):
    monkeypatch.setattr(_blocks, "units", lambda df, n: 5)
    shared = " ".join(f"s{i}" for i in range(70))
    rows = [(None, shared), (None, None), (None, "")] + [(7, f"{shared} end{i}") for i in range(20)] + [(8, shared), (None, shared)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    assert all(r.n_removed == 0 for r in out if r.doc_id != 8) and [r.n_removed for r in out if r.doc_id == 8] == [70]
    assert sorted(r.n_words for r in out if r.doc_id is None) == [0, 0, 70, 70]
