"""Best-fit packing by patterns and non-negative least squares.

Documents are tokenized on the executors and cut into pieces of at most LENGTH tokens. The histogram of piece
lengths (LENGTH numbers) goes to the driver, where patterns of few pieces that fill a sequence exactly or nearly
are enumerated, repeat counts are fitted to the histogram by non-negative least squares and rounded down, and
what remains is packed by best fit over lengths, not over pieces: bins of equal contents stay one entry with a
count. The plan says, per length, which ranks go to which sequences and offsets. Pieces then get ranks within their
length in two levels (salts, then rows of a salt), so that a length that many pieces share isn't one task's.

Defined results: null text counts as empty (the end id alone); repeated rows are packed each; equal rows may swap
places; an empty table gives an empty result; ids pass unchanged, null ones too; other columns are ignored, whatever
their names; texts of any length are encoded whole. Nothing is cut but pieces longer than LENGTH.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, prepare

LENGTH, END = 4096, 1
SALTS = 64
#: Chunks without white space and words they split into whose ids a worker keeps before it starts anew.
CACHE = 600_000
#: How the tokenizer file splits lower-case text (a fixed value of that file), and characters for which its
#: normalizer does what str.lower does; other texts go through the library whole.
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įĲ-ž]*+")


class Words:
    """Ids, as little-endian 32-bit bytes, of chunks (runs without white space) and of the words they split into."""

    def __init__(self, tokenizer):
        self.tokenizer = tokenizer
        self.model = tokenizer.model
        self.known: dict[str, bytes] = {}
        vocab = tokenizer.get_vocab()
        self.packed = [i.to_bytes(4, "little") for i in range(max(vocab.values()) + 1)]
        self.last = np.zeros(len(self.packed), bool)  # ids that end a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def encoded(self, words: list[str]) -> list[bytes]:
        """Many words in one call: each ends with an id that says so."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = (4 * (np.flatnonzero(self.last[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        own = ids.tobytes()
        return [own[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Ids of the chunks, none of which is known yet."""
        if len(self.known) + len(chunks) > CACHE:
            self.known.clear()
        known = self.known
        split = {c: SPLIT.findall(c) for c in chunks if not c.isalpha()}
        fresh = {c for c in chunks if c.isalpha()}  # such a chunk is one word
        fresh.update(w for s in split.values() for w in s if w not in known)
        packed, tokens = self.packed, self.model.tokenize
        out: dict[str, bytes] = {}
        other: list[str] = []
        for w in fresh:
            if w.isascii():  # the byte-level alphabet keeps these characters, so the model needs no more
                out[w] = b"".join([packed[t.id] for t in tokens(w)])
            else:
                other.append(w)
        for at in range(0, len(other), 1000):
            part = other[at : at + 1000]
            out.update(zip(part, self.encoded(part), strict=True))
        known.update(out)
        for c, s in split.items():
            out[c] = known[c] = b"".join([known[w] for w in s])
        return out


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Words(Tokenizer.from_file(path))


def token_bytes(known: Words, texts: list[str | None]) -> list[bytes]:
    """Ids of each whole text as bytes. Chunks are encoded once each: the tokenizer's splits never span white space
    and never merge."""
    found: list[tuple[list[str], list[bytes | None]] | None] = []
    missing: set[str] = set()
    get = known.known.get
    for t in texts:
        t = t or ""
        # "<|" could start a special token's string; combining marks never occur within PLAIN
        if PLAIN.fullmatch(t) and "<|" not in t:
            chunks = t.lower().split()
            own = list(map(get, chunks))
            missing.update([c for c, ids in zip(chunks, own, strict=True) if ids is None])
            found.append((chunks, own))
        else:
            found.append(None)
    new = known.learn(missing)
    out = []
    for t, f in zip(texts, found, strict=True):
        if f is None:
            out.append(np.array(known.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
        else:
            out.append(b"".join([new[c] if ids is None else ids for c, ids in zip(*f, strict=True)]))
    return out


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def pieces(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """One row per piece of each document's ids."""
    prepare(docs.sparkSession)
    end = np.array([END], "<u4").tobytes()

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = words(path)
        for b in found:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                rows = []
                for d, ids in enumerate(token_bytes(known, part.column(1).to_pylist())):
                    ids += end
                    for i in range(0, len(ids), 4 * length):
                        own = ids[i : i + 4 * length]
                        rows.append((d, i // (4 * length), i // 4, len(own) // 4, zlib.crc32(own)))
                d, piece, *rest = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array(piece, pa.int32()), *[pa.array(v, pa.int64()) for v in rest]], ["doc_id", "piece", "start", "length", "ids_crc32"])

    # ids pass as Arrow buffers, unchanged
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(batches, PIECES)


def patterns(h: np.ndarray, each: int = 6) -> list[tuple[int, ...]]:
    """Few lengths that fill a sequence: per length, its best partners for two and for three pieces."""
    full = len(h) - 1
    have = np.flatnonzero(h)
    out = {(full,)} if h[full] else set()
    have = have[have < full]
    for x in have[::-1].tolist():
        left = full - x
        if left <= x:
            i = int(np.searchsorted(have, left, side="right")) - 1
            out.update((x, int(y)) for y in have[max(0, i - 1) : i + 1])
        ys = have[(have <= min(x, left)) & (have >= left // 2)]
        zs = left - ys
        ok = (zs > 0) & (h[np.maximum(zs, 0)] > 0) & (zs <= ys)
        ys, zs = ys[ok], zs[ok]
        for i in np.argsort(-np.minimum(h[ys], h[zs]), kind="stable")[:each]:
            out.add((x, int(ys[i]), int(zs[i])))
    return sorted(out, reverse=True)


def nnls(found: list[tuple[int, ...]], h: np.ndarray, rounds: int = 300) -> np.ndarray:
    """Repeat counts x >= 0 with the least squared distance of the patterns' lengths from the histogram, by
    projected accelerated gradient on the sparse matrix."""
    owner = np.repeat(np.arange(len(found)), [len(p) for p in found])
    length = np.array([v for p in found for v in p], int)
    step = 1 / (np.bincount(length).max() * max(map(len, found)))  # the norm is at most rows' by columns' sums
    x = np.zeros(len(found))
    v, t = x.copy(), 1.0
    for _ in range(rounds):
        gap = np.bincount(length, v[owner], len(h)) - h
        new = np.maximum(0, v - np.bincount(owner, gap[length], len(found)) * step)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(histogram: dict[int, int], length: int = LENGTH) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """(contents, count): contents are (piece length, how often) pairs; every piece is placed once."""
    h = np.zeros(length + 1, np.int64)
    for k, n in histogram.items():
        h[k] = n
    out: dict[tuple[tuple[int, int], ...], int] = defaultdict(int)
    left = h.copy()
    found = patterns(h)
    if found:
        x = nnls(found, h.astype(float))
        for i in np.argsort(-x, kind="stable").tolist():
            need = Counter(found[i])
            n = min([int(x[i] + 1e-6), *[int(left[k]) // m for k, m in need.items()]])
            if n > 0:
                out[tuple(sorted(need.items(), reverse=True))] += n
                for k, m in need.items():
                    left[k] -= n * m
    # best fit, longest first, over groups of bins with equal contents
    bins: dict[int, list[tuple[tuple[tuple[int, int], ...], int]]] = defaultdict(list)
    rooms: list[int] = []

    def put(room: int, contents: tuple[tuple[int, int], ...], n: int) -> None:
        if room == 0:
            out[contents] += n
            return
        if not bins[room]:
            insort(rooms, room)
        bins[room].append((contents, n))

    for k in range(length, 0, -1):
        todo = int(left[k])
        while todo:
            i = bisect_left(rooms, k)
            if i == len(rooms):
                m = length // k
                n, rest = divmod(todo, m)
                if n:
                    put(length - m * k, ((k, m),), n)
                if rest:
                    put(length - rest * k, ((k, rest),), 1)
                break
            room = rooms[i]
            contents, n = bins[room].pop()
            if not bins[room]:
                rooms.pop(i)
            m = min(room // k, todo)
            used = min(n, todo // m)
            if n > used:
                put(room, contents, n - used)
            put(room - m * k, (*contents, (k, m)), used)
            todo -= used * m
    for room in rooms:
        for contents, n in bins[room]:
            out[contents] += n
    return sorted(out.items(), reverse=True)


def placements(planned: list[tuple[tuple[tuple[int, int], ...], int]]) -> dict[int, np.ndarray]:
    """Per piece length: rows (first rank, pieces a sequence, first sequence, first offset), by rank."""
    rows: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for contents, n in planned:
        offset = 0
        for k, m in contents:
            rows[k].append((taken[k], m, sequence, offset))
            taken[k] += n * m
            offset += k * m
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(docs: DataFrame, path: str, length: int = LENGTH) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset. path: the tokenizer's file."""
    spark = docs.sparkSession
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(SALTS)).cast("int")
    own = cut(pieces(docs, path, length).withColumn("_salt", salt))
    counts = own.groupBy("length", "_salt").count().collect()  # LENGTH x SALTS rows at most
    first = np.zeros((length + 1, SALTS), np.int64)
    for r in counts:
        first[r["length"], r["_salt"]] = r["count"]
    histogram = {int(k): int(n) for k, n in enumerate(first.sum(1)) if n}
    before = np.cumsum(first, 1) - first
    model = spark.sparkContext.broadcast((before, placements(plan(histogram, length))))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, places = model.value
        at = (-1, -1)
        rank = 0
        for f in found:
            n = f.num_rows
            if not n:
                continue
            k, s = (f.column(c).to_numpy() for c in ("length", "_salt"))
            seq, off = np.zeros(n, np.int64), np.zeros(n, np.int64)
            edges = np.flatnonzero((np.diff(k, prepend=-1) != 0) | (np.diff(s, prepend=-1) != 0))
            for a, b in zip(edges.tolist(), [*edges[1:].tolist(), n], strict=True):
                if (k[a], s[a]) != at:
                    at, rank = (k[a], s[a]), int(start[k[a], s[a]])
                r = rank + np.arange(b - a)
                p = places[int(k[a])]
                row = p[np.searchsorted(p[:, 0], r, side="right") - 1]
                i = r - row[:, 0]
                seq[a:b], off[a:b] = row[:, 2] + i // row[:, 1], row[:, 3] + i % row[:, 1] * k[a]
                rank += b - a
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*[f.column(c) for c in names], pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    dealt = own.repartition("length", "_salt").sortWithinPartitions("length", "_salt", "doc_id", "piece", "ids_crc32", "start")
    return dealt.mapInArrow(batches, PIECES + ", sequence_id bigint, offset bigint")
