"""Toxicity by a subsequence string-kernel SVM with Nystroem landmarks.

The kernel of two strings sums, over all common subsequences of ORDER characters, DECAY to the power of
the lengths they span in either string; so gaps and inserted characters weaken a match and do not end it. The units of
a text are windows of WINDOW characters, at every place, of its lower-case words, and of what its sentences hide words
in: words without their inner punctuation and with letters for the digits and signs that stand for them ("i-d-1-o-t"),
runs of single characters ("i d i o t"), and neighbours whose seam completes a part of a landmark ("id iot").

Landmarks are character n-grams that best tell the labels of training texts apart, chosen greedily so that each toxic
text is covered often. A text's kernel value to a landmark is the damped sum of its units' values, to the power SHARP, so
many weak likenesses don't add up to a strong one; the values times the inverse root of the landmarks' own kernel are its
Nystroem features. A linear SVM learns from labelled texts, and a logistic curve calibrates its margins. One sentence
is scored in the same way as a text of many.

Training reads a bounded sample of labelled texts, written once. Executors count n-grams and compute features; only
counts of the POOL best n-grams and a row of features a sampled text come to the driver, whatever the texts' lengths.

Defined results: null, empty and wordless texts get the score of no likeness at all; without both labels in
the training rows every score is 0. Repeated rows and ids get equal results where their texts are equal. A label that
repeats for an id is toxic if one of them says so. Ids pass as Arrow buffers, unchanged, null ones too. Columns other than
doc_id, text and toxic are ignored, whatever their names. Texts of any length are read whole; words of any length are cut into
windows. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, held_out, prepare

ORDER, DECAY = 3, 0.6
#: Landmarks; n-grams that they are chosen from; labelled documents that are fitted at most, half of either label.
TELLING, POOL, SAMPLE = 64, 6000, 3000
WINDOW, SHARP = 10, 4
#: Similarities below this count as none; words that share no more than some letters have them.
FAINT = 0.3
GRAMS = (4, 5, 6, 7, 8)
#: Words whose similarities a worker keeps before it starts anew. No result depends on it.
CACHE = 600_000
EDGES = "\"'()[]{}<>.,;:!?…|«»“”%&$#*="
#: What stands for a letter inside a word; other signs are left out.
STANDS_FOR = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})


def units_of(word: str) -> list[str]:
    """Windows at every place."""
    if len(word) <= WINDOW:
        return [word] if word else []
    return [word[i : i + WINDOW] for i in range(len(word) - WINDOW + 1)]


def bare(word: str) -> str:
    """The word's letters, with letters for what stands for them."""
    return "".join([c for c in word.translate(STANDS_FOR) if c.isalpha()])


def words_of(text: str | None, seams: frozenset[str] = frozenset()) -> set[str]:
    """Distinct lower-case words without outer punctuation, and the words that the text hides. seams: parts of landmarks, of
    two and four characters, that make neighbours one word where they cross from one into the other."""
    words = [w.strip(EDGES) for w in (text or "").lower().split()]
    out = set(words)
    if any(len(w) == 1 for w in out):
        run: list[str] = []
        for w in [*words, "  "]:
            if len(w) == 1:
                run.append(w)
            elif w:
                if len(run) >= 3:
                    out.add("".join(run))
                run = []
    if seams:
        for a, b in zip(words, words[1:]):  # noqa: B905
            if a and b and a[-1] + b[0] in seams and len(a) + len(b) <= WINDOW:
                s = a[-3:] + b[:3]
                k = min(3, len(a))
                for i in range(max(0, k - 3), min(k, len(s) - 3)):
                    if s[i : i + 4] in seams:
                        out.add(a + b)
                        break
    out.update([b for w in out if not w.isalpha() and len(w) <= 4 * WINDOW and len(b := bare(w)) >= 4])
    out.discard("")
    return out


def codes(units: list[str]) -> np.ndarray:
    """One row of WINDOW code points a unit; zeros pad."""
    joined = "".join([u.ljust(WINDOW, "\0") for u in units])
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, WINDOW)


#: The positions of all subsequences of ORDER characters in a window, and what they weigh: DECAY to their span.
PLACES = np.array(list(combinations(range(WINDOW), ORDER)))
WEIGHTS = (DECAY ** (PLACES[:, -1] - PLACES[:, 0] + 1)).astype(np.float32)


def subsequences(x: np.ndarray) -> np.ndarray:
    """Exact 63-bit codes of each unit's subsequences (rows of code points, zeros pad); 0 where one reaches padding."""
    wide = np.zeros((len(x), WINDOW), np.uint64)
    wide[:, : x.shape[1]] = x
    parts = [wide[:, PLACES[:, i]] for i in range(ORDER)]
    code = parts[0]
    for part in parts[1:]:
        code = (code << np.uint64(21)) | part
    return np.where(parts[-1] == 0, np.uint64(0), code)


def norms(code: np.ndarray) -> np.ndarray:
    """Roots of the units' kernels with themselves."""
    order = np.argsort(code, axis=1)
    ranked = np.take_along_axis(code, order, 1)
    weight = np.where(ranked == 0, 0, WEIGHTS[order]).astype(np.float64).ravel()
    new = np.ones(ranked.shape, bool)
    new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
    starts = np.flatnonzero(new.ravel())
    sums = np.add.reduceat(weight, starts) ** 2
    return np.sqrt(np.bincount(starts // code.shape[1], sums, len(code)))


#: Number of a unit's subsequences -> the least norm it can have (all different).
LEAST = np.zeros(len(PLACES) + 1)
for _n in range(ORDER, WINDOW + 1):
    _w = WEIGHTS[PLACES[:, -1] < _n].astype(float)
    LEAST[len(_w)] = np.sqrt((_w**2).sum())


class Table:
    """Subsequences of the landmarks, found by a hash without collisions among them."""

    def __init__(self, marks: np.ndarray):
        code = subsequences(marks)
        own = norms(code)
        self.keys = np.unique(code[code != 0])
        self.values = np.zeros((len(self.keys), len(marks)), np.float32)  # normalised weight per landmark
        for m in range(len(marks)):
            live = code[m] != 0
            np.add.at(self.values[:, m], np.searchsorted(self.keys, code[m][live]), WEIGHTS[live] / max(own[m], 1e-9))
        self.most = self.values.max(1)
        rng = np.random.default_rng(1)
        while True:
            self.factor = np.uint64(rng.integers(1, 2**62)) * np.uint64(2) + np.uint64(1)
            at = (self.keys * self.factor) >> np.uint64(42)
            if len(np.unique(at)) == len(at):
                break
        self.slots = np.zeros(1 << 22, np.int32)
        self.slots[at] = np.arange(len(self.keys))
        self.some = np.zeros(1 << 18, bool)  # a small table, that caches hold, rules most subsequences out
        self.some[at >> np.uint64(4)] = True

    def hits(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, columns and key numbers where a unit's subsequence is one of a landmark."""
        hashed = code * self.factor
        rows, cols = np.nonzero(self.some[hashed >> np.uint64(46)])
        found = self.slots[hashed[rows, cols] >> np.uint64(42)]
        own = self.keys[found] == code[rows, cols]
        return rows[own], cols[own], found[own]


@dataclass
class Kernel:
    """Normalised kernel values to landmarks."""

    landmarks: list[str]
    known: dict[str, np.ndarray | None] = field(default_factory=dict)

    def __post_init__(self):
        self.table = Table(codes([m[:WINDOW] for m in self.landmarks]))
        self.seams = frozenset(m[i : i + k] for m in self.landmarks for k in (2, 4) for i in range(len(m) - k + 1))

    def similarities(self, units: list[str], faint: float = 0.0) -> np.ndarray:
        """Units that can't reach `faint` with any landmark stay 0; the bound takes each subsequence's largest value."""
        out = np.zeros((len(units), len(self.landmarks)), np.float32)
        for at in range(0, len(units), 4096):
            code = subsequences(codes(units[at : at + 4096]))
            rows, cols, keys = self.table.hits(code)
            if not len(rows):
                continue
            bound = np.bincount(rows, WEIGHTS[cols] * self.table.most[keys], len(code))
            near = bound >= faint * np.maximum(LEAST[(code != 0).sum(1)], 1e-9)
            own = near[rows]
            rows, cols, keys = rows[own], cols[own], keys[own]
            if len(rows):
                first = np.flatnonzero(np.diff(rows, prepend=-1))
                sums = np.add.reduceat(WEIGHTS[cols][:, None] * self.table.values[keys], first, axis=0)
                out[at + rows[first]] = sums / norms(code[rows[first]])[:, None]
        return out

    def learn(self, words: Iterable[str]) -> None:
        """The powers of the similarities of words that aren't known yet, all together: of each the greatest of its windows."""
        new = [w for w in words if w not in self.known]
        if not new:
            return
        parts = [units_of(w) for w in new]
        flat = list(dict.fromkeys(u for p in parts for u in p))
        at = {u: i for i, u in enumerate(flat)}
        x = self.similarities(flat, FAINT)
        live = x.max(1) >= FAINT
        for w, p in zip(new, parts, strict=True):
            rows = [i for u in p if live[i := at[u]]]
            self.known[w] = (x[rows].max(0) ** SHARP).astype(np.float32) if rows else None

    def pooled(self, texts: list[str | None]) -> np.ndarray:
        """A row a text: damped sums of its words' powers."""
        out = np.zeros((len(texts), len(self.landmarks)))
        for at in range(0, len(texts), 250):
            bags = [words_of(t, self.seams) for t in texts[at : at + 250]]
            if len(self.known) > CACHE:
                self.known.clear()
            self.learn(set().union(*bags))
            get = self.known.__getitem__
            for i, b in enumerate(bags):
                found = [v for v in map(get, b) if v is not None]
                if found:
                    out[at + i] = np.log1p(np.sum(found, 0, dtype=np.float64))
        return out


@dataclass
class Scorer:
    kernel: Kernel
    weights: np.ndarray  # of pooled kernel values: the root of the landmarks' kernel is in them
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, texts: list[str | None]) -> np.ndarray:
        # rounded, as the order of a text's words isn't the same in every worker
        return np.round(self.kernel.pooled(texts) @ self.weights + self.bias, 6)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(np.clip(-(self.slope * self.margins(texts) + self.shift), -50, 50)))


def svm(x: np.ndarray, y: np.ndarray, rounds: int = 30, cost: float = 1000.0) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge and equal mass for both classes, by Newton steps on the margin's active set."""
    weight = np.where(y > 0, 0.5 / (y > 0).sum(), 0.5 / (y <= 0).sum())
    z = np.concatenate((x, np.ones((len(x), 1))), 1).astype(float)
    ridge = np.diag([1 / cost] * x.shape[1] + [1e-9])
    w, active = np.zeros(z.shape[1]), np.ones(len(z), bool)
    for _ in range(rounds):
        za = z[active] * weight[active, None]
        w = np.linalg.solve(za.T @ z[active] + ridge, za.T @ y[active])
        now = y * (z @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def grams(words: Iterable[str]) -> set[str]:
    return {w[i : i + k] for w in words for k in GRAMS for i in range(len(w) - k + 1)}


def landmarks(pool: list[tuple[str, int, int]], covers: list[list[int]], n: tuple[int, int], most: int = TELLING) -> list[str]:
    """n-grams from a pool of (gram, clean texts with it, toxic ones), greedily: the next is what tells most about toxic
    texts (covers: which grams of the pool each holds) that have few yet. None is a part of another."""
    names = [g for g, _, _ in pool]
    inside = np.zeros((len(pool), len(covers)), np.float32)
    for i, own in enumerate(covers):
        inside[own, i] = 1
    worth = np.array([np.log((b / n[1]) / ((a + 0.5) / (n[0] + 1))) + 0.1 * len(g) for g, a, b in pool], np.float32)
    need, out = np.ones(len(covers), np.float32), []
    while len(pool) and len(out) < most:
        value = (inside @ need) * worth
        best = int(value.argmax())
        if value[best] <= 2:
            break
        g = names[best]
        out.append(g)
        need *= 1 - 0.4 * inside[best]
        worth *= np.array([not (g in v or v in g) for v in names])
    return out


def fitted(kernel: Kernel, x: np.ndarray, y: np.ndarray) -> Scorer:
    """A scorer from pooled values and labels (0, 1)."""
    own = kernel.similarities([m[:WINDOW] for m in kernel.landmarks]).astype(float) + 1e-2 * np.eye(len(kernel.landmarks))
    values, vectors = np.linalg.eigh(own)
    root = (vectors / np.sqrt(np.maximum(values, 1e-2))) @ vectors.T
    w, bias = svm(x @ root, np.where(y > 0, 1.0, -1.0))
    s = Scorer(kernel, root @ w, bias)
    m = x @ s.weights + bias
    middle, spread = m.mean(), max(m.std(), 1e-6)
    z, a, b = (m - middle) / spread, 1.0, 0.0
    for _ in range(1500):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        a, b = a + 2.0 * ((y - p) * z).mean() - 1e-4 * a, b + 2.0 * (y - p).mean()
    s.slope, s.shift = max(a, 0.0) / spread, b - max(a, 0.0) * middle / spread
    return s


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text and toxic of at most `sample` labelled ids, half of either label where there are as many, by least hash; one
    text of an id."""
    marks = labels.where("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    ranked = marks.withColumn("h", F.xxhash64("doc_id"))
    picked = ranked.where("toxic = 1").orderBy("h").limit(sample // 2).union(ranked.where("toxic = 0").orderBy("h").limit(sample // 2))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return cut(rows.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "toxic", F.xxhash64("doc_id").alias("h")))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = TELLING) -> Scorer | None:
    """A scorer from documents (doc_id, text) with labels (doc_id, toxic)."""
    rows = sampled(docs, labels, sample)
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not n.get(0) or not n.get(1):
        return None

    def counts(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            for t, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                own = pa.array(grams(words_of(t)), pa.string())
                yield pa.RecordBatch.from_arrays([own, *[pa.array(np.full(len(own), v), pa.int64()) for v in (1 - y, y)]], ["g", "n0", "n1"])

    counted = rows.mapInArrow(counts, "g string, n0 bigint, n1 bigint").groupBy("g").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = (F.col("n1") / n[1]) / ((F.col("n0") + 0.5) / (n[0] + 1))
    telling = counted.where((F.col("n1") >= max(3, 0.01 * n[1])) & (ratio > 4)).withColumn("gain", F.round(F.col("n1") / n[1] * F.log(ratio), 9))
    best = telling.orderBy(F.desc("gain"), F.length("g").desc(), "g").limit(POOL).select("g", "n0", "n1")
    pool = [tuple(r) for r in best.collect()]
    spark = prepare(docs.sparkSession)
    place = spark.sparkContext.broadcast({g: i for i, (g, _, _) in enumerate(pool)})

    def cover(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"h": f["h"], "own": [[i for g in grams(words_of(t)) if (i := place.value.get(g)) is not None] for t in f["text"]]})

    covers = [r["own"] for r in rows.where("toxic = 1").mapInPandas(cover, "h bigint, own array<int>").orderBy("h").collect()]
    marks = landmarks(pool, covers, (n[0], n[1]), most)
    if not marks:
        return None
    kernel = Kernel(marks)
    shared = spark.sparkContext.broadcast(kernel)

    def values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"h": f["h"], "toxic": f["toxic"], "x": list(shared.value.pooled(list(f["text"])))})

    found = rows.mapInPandas(values, "h bigint, toxic int, x array<double>").orderBy("h", "toxic").collect()
    return fitted(kernel, np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found], float))


SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each document's whole text."""
    spark = prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    model = spark.sparkContext.broadcast(train(docs, labels))

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in found:
            s = m.scores(b.column(2).to_pylist()) if m else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.7).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(batches, SCHEMA)
