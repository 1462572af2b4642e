import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from trialspark.llm import components, simhash, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, __g int, n_removed string"


def corpus(seed=3):
    r = random.Random(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    passage = [[r.choice(vocabulary) for _ in range(n)] for n in (60, 90, 49, 50, 51)]
    rows = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 150))]
        for _ in range(r.randint(0, 2)):
            at = r.randint(0, len(words))
            words[at:at] = r.choice(passage)
        rows.append((i, r.choice([" ", "\n", " \t"]).join(words)))
    rows += [(60, rows[3][1]), (61, rows[3][1]), (62, rows[3][1].replace("w1é", "x")), (5, rows[5][1]), (5, rows[7][1])]
    rows += [(70, None), (71, ""), (72, " \n"), (None, rows[3][1]), (None, None), (73, " ".join(["a"] * 200)), (74, " ".join(["a"] * 90))]
    return [(i, t, 1, "x") for i, t in rows]


def brute(rows, window, by_word):
    units = lambda t: (t or "").encode().split() if by_word else (t or "").encode()
    first = {}
    for i, t, *_ in rows:
        u = units(t)
        for k in range(len(u) - window + 1) if i is not None else ():
            key = b" ".join(u[k : k + window]) if by_word else u[k : k + window]
            first[key] = min(i, first.get(key, i))
    out = []
    for i, t, *_ in rows:
        u = units(t)
        gone = [False] * len(u)
        for k in range(len(u) - window + 1) if i is not None else ():
            key = b" ".join(u[k : k + window]) if by_word else u[k : k + window]
            if first[key] < i:
                gone[k : k + window] = [True] * window
        kept = [x for x, g in zip(u, gone, strict=True) if not g]
        out.append((i, len(u), sum(gone), hashlib.sha256(b" ".join(kept) if by_word else bytes(kept)).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [4096, 1])
@pytest.mark.parametrize("by_word", [True, False])
def test_repeats_against_brute_force(spark, monkeypatch, hot, by_word):
    from trialspark.llm import _blocks

    monkeypatch.setattr(_blocks, "units", lambda df, n: 9)
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    if by_word:
        out = substring_dedup.substring_dedup(docs, hot=hot)
        assert out.columns == ["doc_id", "n_words", "n_removed", "spans", "kept"]
        got = [(r[0], r[1], r[2], hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()]
    else:
        got = [(r[0], r[1], r[2], hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.suffix_dedup(docs, hot=hot, batch=500).collect()]
    assert sorted(got, key=str) == brute(rows, 50, by_word)


def test_spans_and_own_space(spark):
    shared = " ".join(f"s{i}" for i in range(55))
    docs = spark.createDataFrame([(1, shared), (2, f"before\n\n{shared}\tafter"), (3, "alone  here\n")], "doc_id long, text string")
    out = {r.doc_id: r for r in substring_dedup.substring_dedup(docs, own_space=True).collect()}
    assert out[1].kept == shared and out[1].spans == []
    assert out[2].kept == "before\n\nafter" and out[2].spans[0] == (1, 56) and out[2].n_removed == 55
    assert out[3].kept == "alone  here\n"


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.substring_dedup(docs).count() == 0
    assert suffix_dedup.suffix_dedup(docs).count() == 0
    assert simhash.simhash_components(docs).count() == 0
    assert simhash.simhash_dedup(docs).count() == 0


def test_family_of_levels_keeps_the_smallest_document():
    family = suffix_dedup.Family(3)
    data = np.frombuffer(b"abcabc\0\0\0\0", np.uint8)
    assert family.add(data, np.arange(0, 4), np.array([1, 1, 1, 2])).tolist() == [False, False, False, True]
    assert family.add(data, np.arange(0, 8), np.full(8, 3)).tolist() == [True, True, True, True, False, False, False, False]
    assert family.add(data, np.arange(4, 8), np.full(4, 4)).tolist() == [True] * 4
    assert family.add(data, np.arange(0, 1), np.full(1, 1)).tolist() == [False]


def test_reference_block_checks_factor_boundaries():
    block = substring_dedup.ReferenceBlock(3)
    a, b = b"a b c d e".split(), b"c d e x y".split()
    block.add(a, block.parse(a))
    block.add(b, block.parse(b))
    # the second factor starts inside the first, at the first window that leaves it
    assert [(s, n) for s, n, *_ in block.parse(b"z a b c d e x y q".split())] == [(1, 5), (4, 4)]


def plain_fingerprint(text):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(x, 42) for x in [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


@pytest.mark.parametrize("dense", [4096, 1])
def test_links_against_all_pairs(spark, dense):
    r = random.Random(5)
    fps = {0, (1 << 64) - 1}
    while len(fps) < 400:
        x = r.getrandbits(64)
        fps.add(x)
        for _ in range(r.randint(0, 4)):
            for b in r.sample(range(64), r.randint(1, 4)):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    par = list(range(len(fps)))

    def find(i):
        while par[i] != i:
            i = par[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                par[max(a, b)] = min(a, b)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    edges = simhash.links(df.select(F.lit(2).alias("kind"), "fp"), dense=dense)
    assert all((( r.u ^ r.v) & (2**64 - 1)) for r in edges.collect())
    root = {r.u: r.root for r in components.components(edges.select("u", "v")).collect()}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    groups = {}
    for i, x in enumerate(signed):
        groups.setdefault(root.get(x, x), set()).add(i)
    want = {}
    for i in range(len(fps)):
        want.setdefault(find(i), set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_simhash_rows(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(3, base), (1, base.upper()), (2, base + " end"), (9, None), (8, ""), (7, " "), (6, "Two words"), (None, "two words"), (None, "lonely"), (4, "x " * 500), (3, "two words")]
    docs = spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, fp int")
    got = simhash.simhash_components(docs).collect()
    assert sorted(((r.doc_id, r.fp & (2**64 - 1)) for r in got), key=str) == sorted(((a, plain_fingerprint(b)) for a, b in rows), key=str)
    by = {(r.doc_id, r.fp): r.component_id for r in got}
    assert {c for (d, _), c in by.items() if d in (7, 8, 9)} == {7}
    assert len({c for (d, _), c in by.items() if d == 1}) == 1
    kept = sorted(((r.doc_id, r.text) for r in simhash.simhash_dedup(docs).collect()), key=str)
    assert (7, " ") in kept and (8, "") not in kept and (None, "lonely") in kept
    assert kept.count((3, "two words")) == 1


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(50)] + [(5, 5), (None, 3), (2, 1)]
    got = {r.u: r.root for r in components.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, **{200 + i: 100 for i in range(50)}}
    assert components.components(spark.range(0).select(F.col("id").alias("u"), F.col("id").alias("v"))).count() == 0


@pytest.mark.parametrize("by_word", [True, False])
def test_rows_longer_than_a_slice(spark, monkeypatch, by_word):
    from trialspark.llm import _blocks

    r = random.Random(8)
    words = [f"v{r.randint(0, 10**6)}" for _ in range(900)]
    rows = [(1, " ".join(words[:500])), (2, " ".join(words[100:])), (3, "x" * 4000), (4, "y" + "x" * 3000 + " " + " ".join(words[200:260])), (5, " ".join(words[-70:]))]
    unit, kernel = (_blocks.Unit("word", 50, 8), substring_dedup._kernel(50)) if by_word else (_blocks.Unit("byte", 50, 20), suffix_dedup._kernel(50, 1000))
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    off = np.append(0, np.cumsum([len(t) for _, t in rows]))
    window = lambda g: sorted((int(a), int(s) + k) for a, s, n in zip(g.row, g.start, g.wins, strict=True) for k in range(n))
    whole = window(_blocks._group(unit, data, off))
    monkeypatch.setattr(_blocks, "SLICE", 700)
    parts = _blocks._group(unit, data, off)
    assert window(parts) == whole and len(set(whole)) == len(whole)
    text = data.tobytes()
    for a, s, n, p, q in zip(parts.row, parts.start, parts.wins, parts.first, parts.end, strict=True):
        t = rows[a][1].encode()
        want = b" ".join(t.split()[s : s + n + 49]) if by_word else t[s : s + n + 49]
        assert text[p:q] == want


def test_long_texts_have_the_same_fingerprint(monkeypatch):
    texts = [" ".join(f"W{i % 37}" for i in range(n)) for n in (0, 1, 2, 3, 4, 50, 500)] + ["x" * 900, "a " + "x" * 900]
    whole = [simhash.fingerprint(t.encode()) for t in texts]
    monkeypatch.setattr(simhash, "PIECE", 40)
    assert [simhash.fingerprint(t.encode()) for t in texts] == whole == [plain_fingerprint(t) for t in texts]


def test_near_copies_of_several_fingerprints(spark):
    r = random.Random(11)
    rows = []
    for i in range(40):
        words = [f"w{r.randint(0, 5000)}" for _ in range(300)]
        rows.append((10 * i, " ".join(words)))
        for at in r.sample(range(300), 5):  # about 0.85 of the five-word shingles stay
            words[at] = f"new{r.randint(0, 10**6)}"
        rows.append((10 * i + 1, " ".join(words)))
    rows += [(1000, rows[0][1]), (1001, None), (1002, ""), (None, rows[0][1]), (1003, "one two"), (1003, "three four five six"), (1004, "ONE two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    gone = {x.doc_id: x.keeper for x in simhash.near_copies(docs).collect()}
    assert gone[1000] == 0 and gone[1002] == 1001 and gone[1004] == 1003
    assert all(a // 10 == b // 10 for a, b in gone.items() if a < 1000)
    assert sum(10 * i + 1 in gone for i in range(40)) >= 36
    kept = [x.doc_id for x in simhash.simhash_dedup(docs).collect()]
    assert kept.count(None) == 1 and kept.count(1003) == 2 and len(kept) == len(rows) - len(gone)
    assert simhash.several_fingerprints(b"a b c d", 3, 4)[0] == simhash.fingerprint(b"a b c d")
    assert len(set(simhash.several_fingerprints(b"a b c d e f", 3, 4))) == 4


def test_near_copies_are_what_shares_their_shingles(spark):
    r = random.Random(12)
    rows, shingles = [], {}
    for i in range(60):  # changes here and there, or one replaced run, to both sides of 0.8
        words = [f"w{r.randint(0, 5000)}" for _ in range(300)]
        rows.append((10 * i, " ".join(words)))
        for j in range(1, 4):
            copy, n = list(words), r.randint(1, 50)
            for at in r.sample(range(300), max(1, n // 5)) if j == 1 else range(100, 100 + n):
                copy[at] = f"new{r.randint(0, 10**6)}"
            rows.append((10 * i + j, " ".join(copy)))
    rows += [(2000 + i, " ".join(f"same{j}" for j in range(250)) + f" a{i} b{i}") for i in range(40)]
    for d, t in rows:
        w = t.split()
        shingles[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    root = {d: d for d in shingles}
    for a in sorted(shingles):
        for b in shingles:
            both = len(shingles[a] & shingles[b])
            if a < b and 5 * both >= 4 * (len(shingles[a]) + len(shingles[b]) - both) and root[a] != root[b]:
                x, y = sorted((root[a], root[b]))
                root = {d: x if c == y else c for d, c in root.items()}
    got = {x.doc_id: x.keeper for x in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: c for d, c in root.items() if d != c}
    assert any(d not in got for d in root if d % 10) and len(got) > 60
