"""SimHash near-duplicates through a Gray-ordered hierarchical index."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm import _shingles
from trialspark.llm._session import materialize, trim, trimming, tune
from trialspark.llm._text import U, mix, pieces_of
from trialspark.llm.components import components, join_hot

SEED = 42
#: Bytes of a text that are read at once.
PIECE = 1 << 20
#: Fingerprints in a bucket of one agreeing segment beyond which its members are routed by a second one.
DENSE = 4096
#: Pairs of nodes that a search holds at once, by level.
FRONTIER = 1 << 18
#: Routed fingerprints a block has at most on average.
BLOCK_ROWS = 1 << 19
#: Of 256 bits two texts of similarity 0.8 differ in 39 (standard deviation 5.7), in 48 (6.2) if they have but 4 and 5 shingles.
WIDE = 72
#: A sketch strays from the similarity by 0.018 at 0.8; what lies over 4.8 times that beside it needs no reading.
SLACK = 0.085
#: Pairs whose sketches are compared at once, and pairs that are tried on their sets before what they connect is looked at again.
STEP, PAIRS = 1 << 15, 1 << 12
#: Texts of a block of buckets; bytes of sets of a block of clusters, and of a tile.
BLOCK_TEXTS, BLOCK_BYTES, TILE_BYTES = 1 << 15, 16 << 20, 32 << 20
#: Rows (of 32 bytes at most) that are broadcast.
BROADCAST_ROWS = 1 << 19
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_LANE = (np.arange(8) * 256).astype(np.int64)


def fingerprint(text: bytes, k: int = 3) -> int:
    """64 bits, each 1 if set in over half the hashes of the k-word shingles of the text with A-Z in lower case."""
    return several_fingerprints(text, k, 1)[0]


def several_fingerprints(text: bytes, k: int, prints: int) -> list[int]:
    """Independent fingerprints of one text: the first of the shingles' XXH64, the others of mixtures of these.

    Long texts are read in pieces that carry their last k - 1 words over.
    """
    if len(text) <= PIECE:
        words = text.lower().split()
        n, counts = _count(words, k, prints) if len(words) >= k else (0, None)
    else:
        n, counts, words = 0, np.zeros((prints, 8, 256), np.int64), []
        for a, b in pieces_of(np.frombuffer(text, np.uint8), PIECE, True):
            words = words[max(0, len(words) - k + 1) :] + text[a:b].lower().split()
            if len(words) >= k:
                m, c = _count(words, k, prints)
                n, counts = n + m, counts + c
    if not n:
        if not words:
            return [0] * prints
        return [int(x[0]) for x in _mixtures(np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], U), prints)]
    return [int.from_bytes(np.packbits((c @ _BITS).ravel() * 2 > n).tobytes(), "big") for c in counts]


def _mixtures(h: np.ndarray, prints: int):
    yield from (h if j == 0 else mix(h + U(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) for j in range(prints))


def _count(words: list[bytes], k: int, prints: int) -> tuple[int, np.ndarray]:
    """Number of shingles, and for each fingerprint how often each byte of their hashes has each value."""
    joined = b" ".join(words)
    ends = list(accumulate(map(len, words), lambda a, n: a + n + 1))
    digest = xxhash.xxh64_digest
    raw = b"".join([digest(joined[a:b], SEED) for a, b in zip([0, *[e + 1 for e in ends]], ends[k - 1 :], strict=False)])
    bytes_ = lambda h: h.astype(">u8").view(np.uint8).reshape(-1, 8)
    parts = [np.frombuffer(raw, np.uint8).reshape(-1, 8)] if prints == 1 else map(bytes_, _mixtures(np.frombuffer(raw, ">u8").astype(U), prints))
    return len(words) - k + 1, np.stack([np.bincount((p + _LANE).ravel(), minlength=2048).reshape(8, 256) for p in parts])


def fingerprints(docs: DataFrame, k: int = 3, id_col: str = "doc_id", text_col: str = "text", prints: int = 1) -> DataFrame:
    """``(doc_id, fp, others)``: the fingerprint's 64 bits in a long, and further independent ones. Null text: all zero."""
    tune(docs.sparkSession)

    def make(batches):
        for b in batches:
            trim()
            fps = np.array([several_fingerprints(x.as_buffer().to_pybytes(), k, prints) if x.is_valid else [0] * prints for x in b.column(1)], np.uint64).reshape(-1, prints).view(np.int64)
            off = pa.array(np.arange(len(fps) + 1, dtype=np.int32) * (prints - 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.ascontiguousarray(fps[:, 0])), pa.ListArray.from_arrays(off, pa.array(fps[:, 1:].ravel()))], ["doc_id", "fp", "others"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("t")).mapInArrow(trimming(make), "doc_id long, fp long, others array<long>")


def gray_rank(bits: np.ndarray) -> np.ndarray:
    """Places in the Gray code's order of values of one or more 64-bit words (rows, most significant word first)."""
    x = bits.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> U(shift)
    odd = np.bitwise_xor.accumulate(x & U(1), axis=1)  # whether the words so far hold an odd number of ones
    x[:, 1:] ^= (U(0) - odd[:, :-1])
    return x


class GrayIndex:
    """Fingerprints of many buckets in Gray order, below nodes that hold the bits their members agree in.

    Gray neighbours differ in few bits, wherever these are.  A node is a run of neighbours that agree in ``shares`` of
    their bits at least; its mask says in which, its pattern how.  Runs of nodes that agree in fewer bits are nodes of the
    level above, up to one node a bucket.  Each bit is factored out at the highest node whose members agree in it, so a
    search adds up the differences of two nodes on its way down and drops both as soon as they exceed the radius.
    """

    def __init__(self, bucket: np.ndarray, bits: np.ndarray, shares: tuple[float, ...] = (0.9, 0.75, 0.5)):
        bits = bits.reshape(len(bits), -1)
        width = 64 * bits.shape[1]
        self.order = np.lexsort((*gray_rank(bits).T[::-1], bucket))
        level = (bits[self.order], np.full(bits.shape, ~U(0)), bucket[self.order])
        self.pattern, self.mask, self.child = [level[0]], [level[1]], []
        for share in (*shares, 0):
            level, at = self._above(*level, share * width)
            self.pattern.insert(0, level[0])
            self.mask.insert(0, level[1])
            self.child.insert(0, at)

    @staticmethod
    def _above(pattern: np.ndarray, mask: np.ndarray, bucket: np.ndarray, least: float) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
        """Nodes of runs with ``least`` common bits or more, and n+1 offsets of their children."""
        n = len(pattern)
        first = np.append(True, bucket[1:] != bucket[:-1])
        if least:
            both = mask[1:] & mask[:-1] & ~(pattern[1:] ^ pattern[:-1])
            near = np.append(False, np.bitwise_count(both).sum(1) >= least) & ~first
            # only stretches of near neighbours can form nodes; what a stretch's run so far agrees in decides where it ends
            ends = np.flatnonzero(near & ~np.append(near[1:], False))
            for i, end in zip(np.flatnonzero(~near & np.append(near[1:], False)).tolist(), ends.tolist(), strict=True):
                p, m = _ints(pattern[i : end + 1]), _ints(mask[i : end + 1])
                seen, common = p[0], m[0]
                for k in range(1, end + 1 - i):
                    agree = common & m[k] & ~(seen ^ p[k])
                    if agree.bit_count() >= least:
                        common = agree
                    else:
                        first[i + k], seen, common = True, p[k], m[k]
            first |= ~near
        at = np.flatnonzero(first)
        ones = np.bitwise_and.reduceat(pattern | ~mask, at, axis=0)
        zeros = np.bitwise_and.reduceat(~pattern | ~mask, at, axis=0)
        fixed = np.bitwise_and.reduceat(mask, at, axis=0) & (ones | zeros)
        return (ones & fixed, fixed, bucket[at]), np.append(at, n)

    def near(self, radius: int):
        """Pairs (positions in Gray order) within ``radius`` bits and their distances, in parts."""
        n = len(self.pattern[0])
        a = np.arange(n)
        stack = [(0, a, a, np.zeros(n, np.int64), 0)]
        while stack:
            level, a, b, far, row = stack.pop()
            if level == len(self.child):
                yield a, b, far
                continue
            lo, size = self.child[level][:-1], np.diff(self.child[level])
            total = np.cumsum(size[a] * size[b])
            if len(a) > 1 and total[-1] > FRONTIER:
                cut = max(1, int(np.searchsorted(total, FRONTIER, "right")))
                stack += [(level, a[cut:], b[cut:], far[cut:], 0), (level, a[:cut], b[:cut], far[:cut], 0)]
                continue
            if len(a) == 1:  # a large pair goes down by rows of its first node's children
                last = min(int(size[a[0]]), row + max(1, FRONTIER // int(size[b[0]])))
                if last < size[a[0]]:
                    stack.append((level, a, b, far, last))
                x = np.repeat(lo[a[0]] + np.arange(row, last), size[b[0]])
                y = np.tile(lo[b[0]] + np.arange(size[b[0]]), last - row)
                pair = np.zeros(len(x), np.int64)
            else:
                each = size[a] * size[b]
                pair = np.repeat(np.arange(len(a)), each)
                k = np.arange(len(pair)) - np.repeat(total - each, each)
                wide = size[b][pair]
                x, y = lo[a][pair] + k // wide, lo[b][pair] + k % wide
            stack += self._down(level, a, b, far, x, y, pair, radius)

    def _down(self, level, a, b, far, x, y, pair, radius):
        """The child pairs (x, y) of node pairs that stay within the radius."""
        keep = x < y if level + 1 == len(self.child) else x <= y
        x, y, pair = x[keep], y[keep], pair[keep]
        far = far[pair]
        above, below, pattern = self.mask[level], self.mask[level + 1], self.pattern[level + 1]
        for w in range(pattern.shape[1]):
            new = below[x, w] & below[y, w] & ~(above[a[pair], w] & above[b[pair], w])
            far = far + np.bitwise_count((pattern[x, w] ^ pattern[y, w]) & new)
            keep = far <= radius
            x, y, pair, far = x[keep], y[keep], pair[keep], far[keep]
        return [(level + 1, x, y, far, 0)] if len(x) else []

    def nodes(self) -> list[int]:
        """How many nodes each level has, from the buckets down."""
        return [len(p) for p in self.pattern]


def _ints(words: np.ndarray) -> list[int]:
    """Rows of 64-bit words as one number each."""
    raw = words.astype(">u8").tobytes()
    step = 8 * words.shape[1]
    return [int.from_bytes(raw[i : i + step], "big") for i in range(0, len(raw), step)]


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite the pairs' classes in place; label: the least position of each class."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def _link(radius: int):
    def link(table: pa.Table) -> pa.Table:
        fp = table["fp"].to_numpy().view(U)
        index = GrayIndex(np.unique(table["bucket"].to_numpy(), return_inverse=True)[1], fp)
        label = np.arange(len(fp))
        for a, b, _ in index.near(radius):
            _join(label, a, b)
        own = fp[index.order].view(np.int64)
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": own[far], "v": own[label[far]]})

    return link


def links(fps: DataFrame, radius: int = 3, dense: int = DENSE) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints (column ``fp``) that connect exactly what lies within ``radius`` (3 at most) bits.

    Two fingerprints that differ in 3 bits agree in one of four 16-bit segments, so each goes to four buckets.  A bucket of
    over ``dense`` members splits again: the other 48 bits hold at most 3 differences, so one of four 12-bit parts agrees
    too.  Each bucket is searched through a Gray-ordered index and emits a spanning forest, never all its pairs.
    """
    if not 0 <= radius <= 3:
        raise ValueError("radius is 0 to 3")
    value = lambda s: F.shiftrightunsigned("fp", 48 - 16 * s).bitwiseAND(0xFFFF)
    routed = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(s).alias("seg"), value(s).alias("v")) for s in range(4)])).alias("r")).select("fp", "r.seg", "r.v")
    crowded = routed.groupBy("seg", "v").agg(F.count("*").alias("n")).where(F.col("n") > dense).select("seg", "v", F.lit(True).alias("crowded"))
    crowded = F.broadcast(crowded)  # four segments of 16 bits have 2**18 values, so it has no more rows
    rest = F.when(F.col("seg") == 0, F.col("fp")).otherwise(F.expr("shiftleft(fp, seg * 16) | shiftrightunsigned(fp, (64 - seg * 16) % 64)"))
    part = lambda t: F.shiftrightunsigned(rest, 36 - 12 * t).bitwiseAND(0xFFF)
    whole = F.array(F.struct(F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("w")))
    split = F.array(*[F.struct(F.lit(t).alias("sub"), part(t).alias("w")) for t in range(4)])
    dealt = routed.join(crowded, ["seg", "v"], "left").withColumn("q", F.explode(F.when(F.col("crowded"), split).otherwise(whole)))
    blocks = max(8, int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-fps.count() * 16 // BLOCK_ROWS))
    bucket = F.col("seg") * 5 + F.col("q.sub") + 1 + 20 * (F.col("v") * 4096 + F.col("q.w"))
    keyed = dealt.select("fp", bucket.alias("bucket")).withColumn("block", F.pmod(F.xxhash64("bucket"), F.lit(blocks)))
    return keyed.groupBy("block").applyInArrow(_link(radius), "u long, v long")


def simhash_components(docs: DataFrame, k: int = 3, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", dense: int = DENSE) -> DataFrame:
    """``(doc_id, fp, component_id)``, a row for each row of ``docs``.

    Fingerprints within ``radius`` bits are linked; ``component_id`` is the smallest id of the component.  Null and empty
    texts have fingerprint zero and link like any other.  Null ids are kept and lose to any other; a component of null ids
    alone has a null id.  Repeated rows stay.  Empty input: no rows.  Very long texts are read in pieces, with the same
    fingerprint.  Other columns play no part, whatever their names.
    """
    each = materialize(fingerprints(docs, k, id_col, text_col).drop("others"), "fingerprints")
    nodes = materialize(each.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows")), "nodes")
    roots = components(links(nodes, radius, dense)).withColumnRenamed("u", "fp")
    placed = materialize(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    ids = placed.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("fps"))
    known = join_hot(placed.select("fp", "root", "rows"), ids, "root", nodes.count(), "fps").select("fp", "component_id", "rows")
    return join_hot(each, known, "fp", each.count(), "rows").select("doc_id", "fp", "component_id")


def _forest(table: pa.Table, cells: tuple[str, ...], least: float, exact: bool) -> tuple[list[bytes], list[bytes]]:
    """Links that connect, in each cell of a table, all texts that may be similar; with ``exact``, whose sets of shingles are.

    A cell is what agrees in the columns ``cells``; of a cell of two tiles (``i`` and ``j`` differ) only pairs of both are met.
    """
    wide = lambda name, kind: np.frombuffer(b"".join(table[name].to_pylist()), kind).reshape(table.num_rows, -1)
    cell = np.unique(np.stack([table[c].to_numpy().astype(np.int64) for c in cells], 1), axis=0, return_inverse=True)[1].ravel()
    n, tile, two = table["n"].to_numpy(), table["tile"].to_numpy(), table["i"].to_numpy() != table["j"].to_numpy()
    sketch, label, out = wide("sketch", np.uint8), np.arange(table.num_rows), []
    sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()] if exact else []

    def similar(i: int, j: int) -> bool:
        x, y = sets[i], sets[j]
        both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
        return both >= least * (len(x) + len(y) - both)

    index = GrayIndex(cell, wide("print", U).astype(U))
    for a, b, _ in index.near(WIDE):
        a, b = index.order[a], index.order[b]
        fits = (label[a] != label[b]) & (np.minimum(n[a], n[b]) >= least * np.maximum(n[a], n[b])) & (~two[a] | (tile[a] != tile[b]))
        a, b = a[fits], b[fits]
        share = np.concatenate([np.zeros(0), *[(sketch[a[i : i + STEP]] == sketch[b[i : i + STEP]]).mean(1) for i in range(0, len(a), STEP)]])
        order = np.argsort(-share, kind="stable")[: int((share >= least - SLACK).sum())]
        a, b = a[order], b[order]
        for i in range(0, len(a), PAIRS if exact else max(1, len(a))):
            x, y = (a[i : i + PAIRS], b[i : i + PAIRS]) if exact else (a, b)
            while True:
                apart = label[x] != label[y]
                x, y = x[apart], y[apart]
                if not len(x):
                    break
                # each class tries its likeliest link to one of a smaller position
                at = np.unique(np.maximum(label[x], label[y]), return_index=True)[1]
                p, q = x[at], y[at]
                if exact:
                    good = np.array([similar(*k) for k in zip(p.tolist(), q.tolist(), strict=True)], bool)
                    x, y = np.delete(x, at), np.delete(y, at)
                    p, q = p[good], q[good]
                out.append((p, q))
                _join(label, p, q)
    digest = table["digest"].to_pylist()
    ends = [(digest[i], digest[j]) for p, q in out for i, j in zip(p.tolist(), q.tolist(), strict=True)]
    return [max(e) for e in ends], [min(e) for e in ends]


def _linked(cells: tuple[str, ...], least: float, exact: bool):
    def link(table: pa.Table) -> pa.Table:
        u, v = _forest(table, cells, least, exact)
        trim()
        return pa.table({"u": pa.array(u, pa.binary()), "v": pa.array(v, pa.binary())})

    return link


def _tiled(df: DataFrame, key: str, tiles, texts: DataFrame, blocks: int) -> DataFrame:
    """Rows (key, digest) with what is known of their texts, dealt into blocks; a key of several tiles has a cell for each two."""
    tile = F.pmod(F.xxhash64("digest", key), F.col("tiles")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(F.least(x, "tile").alias("i"), F.greatest(x, "tile").alias("j")))
    dealt = df.withColumn("tiles", F.ceil(tiles).cast("int")).withColumn("tile", tile).withColumn("c", F.explode(cells)).select("digest", key, "tile", "c.i", "c.j")
    return dealt.join(texts, "digest").withColumn("block", F.pmod(F.xxhash64(key, "i", "j"), F.lit(blocks)))


def near_copies(docs: DataFrame, k: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", tile: int = DENSE) -> DataFrame:
    """``(doc_id, th, keeper)``: rows (by id and XXH64 of the text) that fall together with a smaller one, as their texts share ``least`` or more of their k-word shingles (Jaccard).

    Fingerprints that lie within a few bits miss most such pairs near 0.8, so texts are routed by 24 MinHash bands, of which a
    pair of 0.8 shares one with 0.9999 wherever its edits lie.  In each bucket the Gray-ordered index finds pairs whose
    fingerprints of 256 bits differ in ``WIDE`` bits at most, and a sketch drops those far below ``least``.  What these
    candidates connect is a cluster; it is searched once more, and every pair not yet connected is verified on the sets of
    shingles themselves.  Buckets and clusters send on spanning forests, never their pairs.  Those of over ``tile`` texts
    (clusters also: of over ``TILE_BYTES``) are searched by pairs of tiles, so that none gathers in one task.

    Texts of equal sets are one node, whatever their number; texts without words are equal.  Rows of one id with different
    texts are nodes of their own; rows of one id and text stay or go together.  ``keeper`` is the smallest id of the
    component; of several rows with that id, the one of the smallest ``th`` stays.  Null ids take no part.  Very long texts are
    read in pieces, with the same result.  Empty input: no rows.  Other columns play no part, whatever their names.
    """
    tune(docs.sparkSession)
    least_blocks = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = F.col(f"`{text_col}`").cast("binary")
    given = docs.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("t"))
    each = materialize(given.mapInArrow(*_shingles.bands(k)), "bands")
    low = F.min(F.struct("doc_id", "th")).alias("low")
    nodes = materialize(each.groupBy("digest").agg(low, F.count("*").alias("rows"), F.first("bands").alias("bands")), "nodes")
    count = nodes.count()

    routed = nodes.select("digest", F.explode("bands").alias("bucket"))
    sizes = routed.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1").withColumn("met", F.col("size"))
    members = materialize(join_hot(routed, sizes, "bucket", _shingles.BANDS * count, "met"), "members")
    shared = materialize(members.select("digest").distinct().join(nodes, "digest").select("digest", "low.doc_id", "low.th"), "shared")
    wanted = F.broadcast(shared) if shared.count() <= BROADCAST_ROWS else shared
    texts = given.join(wanted, ["doc_id", "th"]).select("digest", "t").mapInArrow(*_shingles.details(k, 4))
    one = [F.first(c).alias(c) for c in ("n", "print", "sketch", "shingles")]  # of a text's repeated rows
    texts = materialize(texts.groupBy("digest").agg(*one), "details")

    cells = _tiled(members, "bucket", F.col("size") / tile, texts.drop("shingles"), max(least_blocks, -(-members.count() // BLOCK_TEXTS)))
    candidates = cells.groupBy("block").applyInArrow(_linked(("bucket", "i", "j"), least, False), "u binary, v binary")
    roots = components(candidates)
    roots = materialize(roots.select(F.col("u").alias("digest"), "root").unionByName(roots.select(F.col("root").alias("digest"), "root").distinct()), "clusters")
    size = F.col("n") * 8 + _shingles.PLACES
    clusters = roots.join(texts.select("digest", size.alias("bytes")), "digest").groupBy("root").agg(F.count("*").alias("texts"), F.sum("bytes").alias("bytes"))
    clusters = materialize(clusters.withColumn("cluster", F.xxhash64("root")).withColumn("met", F.col("texts")), "sizes")
    whole = clusters.agg(F.sum("bytes"), F.sum("texts")).first()
    mine = join_hot(roots, clusters, "root", whole[1] or 0, "met").drop("root")
    tiles = F.greatest(F.col("texts") / tile, F.col("bytes") / TILE_BYTES)
    cells = _tiled(mine, "cluster", tiles, texts, max(least_blocks, -(-(whole[0] or 0) // BLOCK_BYTES)))
    found = materialize(cells.groupBy("block").applyInArrow(_linked(("cluster", "i", "j"), least, True), "u binary, v binary"), "links")

    roots = materialize(components(found).withColumnRenamed("u", "digest"), "roots")
    linked = roots.select("digest", "root").unionByName(roots.select(F.col("root").alias("digest"), "root").distinct())
    placed = nodes.select("digest", "low", "rows").join(linked, "digest", "left").where("root is not null or rows > 1")
    placed = materialize(placed.withColumn("root", F.coalesce("root", "digest")), "placed")
    keeper = placed.groupBy("root").agg(F.min("low").alias("keeper"), F.count("*").alias("texts"))
    known = join_hot(placed.select("digest", "root", "rows"), keeper, "root", count, "texts").select("digest", "keeper", "rows")
    rows = join_hot(each.select("digest", "doc_id", "th"), known, "digest", each.count(), "rows")
    return rows.where(F.struct("doc_id", "th") != F.col("keeper")).select("doc_id", "th", F.col("keeper.doc_id").alias("keeper"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` but those of ``near_copies``: of each group of near copies the row with the smallest id stays.

    Rows with a null id stay, as do all rows that repeat the id and text of one that stays.  Empty input: no rows.  Very
    long texts are read in pieces.  No column of ``docs`` clashes with those used here.
    """
    gone = materialize(near_copies(docs, id_col=id_col, text_col=text_col, **settings).select("doc_id", "th").distinct(), "gone")
    gone = (F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone).alias("gone")
    same = (F.col(f"docs.`{id_col}`").cast("long") == F.col("gone.doc_id")) & (F.xxhash64(F.col(f"docs.`{text_col}`").cast("binary")) == F.col("gone.th"))
    return docs.alias("docs").join(gone, same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_components(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
