"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding."""

from __future__ import annotations

import base64
import heapq
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trialspark.llm._session import trim, trimming, tune, without
from trialspark.llm._text import buffers, spans_of_rows

SLICE = 1 << 20
CACHE = 150_000
WIDTHS = (8, 16, 32, 64)
NONE = np.int32(2**31 - 1)

# Character classes. JOIN: the space that goes with the token after it; EDGE: other white space that ends its run before a
# token; QUOTE1 and QUOTE2: an apostrophe before one or two letters of a contraction. FIRST is added at a row's start.
LETTER, NUMBER, OTHER, QUOTE1, QUOTE2, JOIN, EDGE, SPACE = range(8)
FIRST = 8
# States: what the token so far is. FRESH: whatever comes next starts a token; TAIL1, TAIL2: letters a contraction still takes.
FRESH, LETTERS, NUMBERS, OTHERS, SPACES, JOINED, TAIL1, TAIL2 = range(8)


def _transitions() -> tuple[np.ndarray, np.ndarray]:
    """Next state and "a token starts here" for each class (16) and state (8)."""
    go, cut = np.zeros((16, 8), np.uint8), np.zeros((16, 8), bool)
    for q in range(8):
        plain = {LETTER: LETTERS, NUMBER: NUMBERS, OTHER: OTHERS}
        for c, run in plain.items():
            go[c, q], cut[c, q] = run, q not in (run, JOINED)
        for c, tail in ((QUOTE1, TAIL1), (QUOTE2, TAIL2)):
            inside = q in (OTHERS, JOINED)
            go[c, q], cut[c, q] = OTHERS if inside else tail, not inside
        go[JOIN, q], cut[JOIN, q] = JOINED, True
        go[EDGE, q], cut[EDGE, q] = FRESH, True
        go[SPACE, q], cut[SPACE, q] = SPACES, q != SPACES
    go[LETTER, TAIL1], cut[LETTER, TAIL1] = FRESH, False
    go[LETTER, TAIL2], cut[LETTER, TAIL2] = TAIL1, False
    go[FIRST:], cut[FIRST:] = go[:FIRST, [FRESH]], True  # a row starts afresh, whatever came before
    return go, cut


GO, CUT = _transitions()
#: Unicode's White_Space.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@cache
def classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER or SPACE of each code point."""
    kind = {"L": LETTER, "N": NUMBER}
    out = np.array([kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)], np.uint8)
    out[WHITE] = SPACE
    return out


def _classify(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Class of each character, by itself and the two after it in its row."""
    c = classes()[points]
    n = len(c)
    white = c == SPACE
    later = np.zeros(n, bool)  # the next character is of this row and not white
    later[:-1] = ~white[1:] & ~first[1:]
    c[white & later] = EDGE
    c[(points == 0x20) & later] = JOIN
    at = np.flatnonzero(points == 0x27)
    if len(at):
        padded, begins = np.append(points, [0, 0]), np.append(first, [True, True])
        a, b = padded[at + 1], padded[at + 2]
        one = ~begins[at + 1]
        two = one & ~begins[at + 2]
        c[at[two & (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l")))]] = QUOTE2
        c[at[one & np.isin(a, [ord(x) for x in "stmd"])]] = QUOTE1
    return c + FIRST * first.astype(np.uint8)


def scan(cls: np.ndarray) -> np.ndarray:
    """State before each character.

    Each class is a function from state to state, and composing functions is associative: blocks of characters are composed
    side by side, the blocks' functions are combined by a doubling scan, and the states inside follow from each block's first.
    """
    n, width = len(cls), 64
    rows = -(-n // width)
    grid = np.full(rows * width, SPACE, np.uint8)
    grid[:n] = cls
    grid = np.ascontiguousarray(grid.reshape(rows, width).T)
    flat = GO.ravel()
    step = grid.astype(np.int16) * 8
    whole = np.repeat(np.arange(8, dtype=np.uint8)[:, None], rows, 1)
    for j in range(width):
        whole = flat[step[j] + whole]
    f = np.ascontiguousarray(whole.T)
    d = 1
    while d < rows:
        f[d:] = np.take_along_axis(f[d:], f[:-d], 1)  # what came before, then this
        d *= 2
    q = np.empty(rows, np.uint8)
    q[0] = FRESH
    q[1:] = f[:-1, FRESH]
    out = np.empty((width, rows), np.uint8)
    for j in range(width):
        out[j] = q
        q = flat[step[j] + q]
    return out.T.reshape(-1)[:n]


def pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte of each piece, and n+1 offsets of the rows' pieces. ``data`` is valid UTF-8, ``offsets`` start at 0."""
    at = np.flatnonzero((data & 0xC0) != 0x80)
    if not len(at):
        return at, np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.zeros(len(at) + 1, bool)
    first[np.searchsorted(at, offsets[:-1])] = True
    cls = _classify(points, first[:-1])
    start = at[CUT.ravel()[cls.astype(np.int16) * 8 + scan(cls)]]
    return start, np.searchsorted(start, offsets)


def safe_cuts(data: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of about ``most`` bytes, cut before a space between two ASCII letters: a piece starts there whatever came before."""
    out, a, n = [], 0, len(data)
    end = a + most
    while end < n:
        part = data[a:end]
        letter = ((part | 0x20) >= ord("a")) & ((part | 0x20) <= ord("z"))
        at = np.flatnonzero(letter[:-2] & (part[1:-1] == 0x20) & letter[2:])
        if not len(at):
            end += most
            continue
        b = a + int(at[-1]) + 1
        out.append((a, b))
        a, end = b, b + most
    return [*out, (a, n)]


class Tokenizer:
    """Encodes and decodes by a table of ranks (a file of base64 tokens and ranks)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.known = {t: np.uint32(r).tobytes() for t, r in ranks.items()}
        self.fresh: dict[bytes, bytes] = {}
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.place = np.append(0, np.cumsum(self.size))[:-1]
        self.text = np.frombuffer(b"".join(tokens), np.uint8)
        pairs = {}
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = r
        self.pairs = pairs
        self._table(np.fromiter(pairs, np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressed table of pairs for lookups of whole arrays."""
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full((1 << self.bits) + 1, 2**64 - 1, np.uint64)
        self.values = np.full((1 << self.bits) + 1, NONE, np.int32)
        slot, left, self.probes = self._slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] == 2**64 - 1
            where, chosen = np.unique(slot[left[free]], return_index=True)
            won = left[free][chosen]
            self.keys[where], self.values[where] = keys[won], values[won]
            left = np.setdiff1d(left, won, assume_unique=True)
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of tokens, NONE where they don't merge (or either is -1)."""
        keys = a.astype(np.uint64) << np.uint64(32) | (b.astype(np.uint64) & np.uint64(0xFFFFFFFF))
        slot = self._slot(keys)
        have = self.keys[slot]
        out = np.where(have == keys, self.values[slot], NONE)
        left = np.flatnonzero((have != keys) & (have != np.uint64(2**64 - 1)))
        while len(left):
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)
            have = self.keys[slot[left]]
            hit = have == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (have != np.uint64(2**64 - 1))]
        return out

    def merge(self, words: list[bytes]) -> list[bytes]:
        """Ids (packed) of many pieces: in every round the leftmost lowest-ranked pair of each piece merges."""
        out: list[bytes] = [b""] * len(words)
        size = np.array([len(w) for w in words])
        low = 0
        for width in WIDTHS:
            group = np.flatnonzero((size > low) & (size <= width))
            low = width
            for part in np.array_split(group, -(-len(group) * width // (1 << 19)) or 1):
                if len(part):
                    self._merge_group(words, part, size[part], width, out)
        for i in np.flatnonzero(size > low).tolist():
            out[i] = self._merge_long(words[i])
        return out

    def _merge_group(self, words: list[bytes], part: np.ndarray, size: np.ndarray, width: int, out: list[bytes]) -> None:
        raw = np.frombuffer(b"".join([words[i].ljust(width, b"\0") for i in part.tolist()]), np.uint8).reshape(-1, width)
        column = np.arange(width)
        tok = np.where(column < size[:, None], self.bytes[raw], -1).astype(np.int32)
        rank = np.full((len(part), width), NONE, np.int32)
        rank[:, :-1] = self.ranks(tok[:, :-1].ravel(), tok[:, 1:].ravel()).reshape(len(part), -1)
        left = np.arange(len(part))  # rows of tok that still merge; they are kept in front
        done_tok, done_size = np.empty((len(part), width), np.int32), np.empty(len(part), np.int64)
        n = size.copy()
        while len(left):
            p = rank.argmin(1)
            rows = np.arange(len(left))
            best = rank[rows, p]
            live = best != NONE
            if not live.all():
                over = left[~live]
                done_tok[over], done_size[over] = tok[~live], n[~live]
                left, tok, rank, n, p, best = left[live], tok[live], rank[live], n[live], p[live], best[live]
                rows = np.arange(len(left))
                if not len(left):
                    break
            after = column[None, :-1] > p[:, None]
            tok[:, :-1] = np.where(after, tok[:, 1:], tok[:, :-1])
            rank[:, :-1] = np.where(column[None, :-1] >= p[:, None], rank[:, 1:], rank[:, :-1])
            tok[:, -1] = -1
            rank[:, -1] = NONE
            tok[rows, p] = best
            n -= 1
            right = np.minimum(p + 1, width - 1)
            rank[rows, p] = np.where(p + 1 < n, self.ranks(tok[rows, p], tok[rows, right]), NONE)
            back = np.flatnonzero(p > 0)
            rank[back, p[back] - 1] = self.ranks(tok[back, p[back] - 1], tok[back, p[back]])
        raw_ids = done_tok.astype("<u4").tobytes()
        for k, (i, m) in enumerate(zip(part.tolist(), done_size.tolist(), strict=True)):
            out[i] = raw_ids[4 * k * width : 4 * (k * width + m)]

    def _merge_long(self, word: bytes) -> bytes:
        """One long piece, by a heap of pairs over a linked list."""
        tok = self.bytes[np.frombuffer(word, np.uint8)].tolist()
        n, get = len(tok), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, tok[i], tok[i + 1]) for i in range(n - 1) if (r := get(tok[i] << 32 | tok[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if tok[i] != a or j >= n or tok[j] != b:
                continue
            tok[i], tok[j], k = r, -1, after[j]
            after[i] = k
            if k < n:
                before[k] = i
                if (s := get(r << 32 | tok[k])) is not None:
                    heapq.heappush(heap, (s, i, r, tok[k]))
            if (h := before[i]) >= 0 and (s := get(tok[h] << 32 | r)) is not None:
                heapq.heappush(heap, (s, h, tok[h], r))
        return np.array([t for t in tok if t >= 0], "<u4").tobytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Packed ids of each row, and the packed ends (bytes from the row's start) of its pieces.

        Rows longer than a slice are cut at safe places and put together again.
        """
        cuts = [[(int(a), int(b))] if b - a <= SLICE else [(int(a) + c, int(a) + d) for c, d in safe_cuts(data[a:b], SLICE)] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        if all(len(c) == 1 for c in cuts):
            return self._encode(data, offsets)
        ids, ends = [], []
        for row in cuts:
            got = [(a - row[0][0], *self._encode(data[a:b], np.array([0, b - a]))) for a, b in row]
            ids.append(b"".join([i[0] for _, i, _ in got]))
            ends.append(b"".join([(np.frombuffer(e[0], "<i4") + shift).astype("<i4").tobytes() for shift, _, e in got]))
        return ids, ends

    def _encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        start, rows = pieces(data, offsets)
        text = data.tobytes()
        ends = np.append(start, len(data))[1:]
        cut = [text[a:b] for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
        known, fresh = self.known.get, self.fresh
        missing = [w for w in set(cut) if w not in self.known and w not in fresh]
        if missing:
            if len(fresh) + len(missing) > CACHE:
                fresh.clear()
                missing = [w for w in set(cut) if w not in self.known]
            fresh.update(zip(missing, self.merge(missing), strict=True))
        ids = [known(w) or fresh[w] for w in cut]
        ends -= np.repeat(offsets[:-1], np.diff(rows))
        packed = ends.astype("<i4").tobytes()
        bounds = rows.tolist()
        return [b"".join(ids[a:b]) for a, b in zip(bounds, bounds[1:], strict=False)], [packed[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """Bytes of each row of packed ids, through one gather over all rows."""
        flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int64)
        size = self.size[flat]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        index = np.repeat(self.place[flat] - (end - size), size) + np.arange(total)
        text = self.text[index].tobytes()
        edge = np.append(0, end)[np.append(0, np.cumsum([len(x) // 4 for x in ids]))].tolist()
        return [text[a:b] for a, b in zip(edge, edge[1:], strict=False)]


@cache
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _valid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, off = buffers(column)
    part = data[off[0] : off[-1]]
    try:
        part.tobytes().decode()
    except UnicodeDecodeError:
        fixed = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(off[:-1], off[1:], strict=True)]
        return np.frombuffer(b"".join(fixed), np.uint8), np.append(0, np.cumsum([len(x) for x in fixed]))
    return part, off - off[0]


_OUT = [("n_tokens", "bigint", pa.int64()), ("ids", "binary", pa.binary()), ("piece_ends", "binary", pa.binary()), ("decoded", "binary", pa.binary())]


def _run(docs: DataFrame, column: str, names: list[str], make) -> DataFrame:
    """``docs`` without ``column`` and with the named outputs of ``make(column)``, a slice of rows at a time."""
    tune(docs.sparkSession)
    outs = [o for o in _OUT if o[0] in names]
    docs = without(docs, *[n for n in names if n != column])
    plain = [f for f in docs.schema.fields if f.name != column]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain] + [f"{n} {t}" for n, t, _ in outs])

    def work(batches):
        for batch in batches:
            trim()
            for i, j in spans_of_rows(buffers(batch.column(column))[1], SLICE):
                part = batch.slice(i, j - i)
                made = make(part.column(column))
                yield pa.RecordBatch.from_arrays([part.column(f.name) for f in plain] + [pa.array(made[n], t) for n, _, t in outs], [f.name for f in plain] + [n for n, _, _ in outs])

    return docs.mapInArrow(trimming(work), schema)


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """Ids of each text by the ranks in a file that every executor has at ``ranks_path``; each piece is merged separately.

    Returns the columns of ``docs`` but the text, and ``n_tokens``, ``ids`` (packed little-endian unsigned 32-bit) and
    ``piece_ends`` (packed signed 32-bit ends of the pre-tokeniser's pieces in the text's bytes).  Special tokens are text.

    Null and empty texts: no ids.  Invalid UTF-8 is read with replacement characters.  A text of any length is one piece of
    work.  Empty input: no rows.  Columns of ``docs`` with an output's name give way to it.
    """

    def make(column: pa.Array) -> dict:
        ids, ends = tokenizer(ranks_path).encode(*_valid(column))
        return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "piece_ends": ends}

    return _run(docs, text_col, ["n_tokens", "ids", "piece_ends"], make)


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """The columns of ``rows`` but the packed ids, and ``decoded``: their tokens' bytes. Null ids: empty bytes."""
    return _run(rows, ids_col, ["decoded"], lambda column: {"decoded": tokenizer(ranks_path).decode([x or b"" for x in column.to_pylist()])})


def round_trip(docs: DataFrame, ranks_path: str, text_col: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass over the texts: ``n_tokens``, ``ids``, ``piece_ends`` and ``decoded``."""

    def make(column: pa.Array) -> dict:
        tok = tokenizer(ranks_path)
        ids, ends = tok.encode(*_valid(column))
        return {"n_tokens": [len(x) // 4 for x in ids], "ids": ids, "piece_ends": ends, "decoded": tok.decode(ids)}

    return _run(docs, text_col, ["n_tokens", "ids", "piece_ends", "decoded"], make)


def default_ranks() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def digests(docs: DataFrame, ranks_path: str | None = None) -> DataFrame:
    out = round_trip(docs, ranks_path or default_ranks())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
