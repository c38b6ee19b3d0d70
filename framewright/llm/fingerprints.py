"""Document fingerprints from closed syncmers.

A k-mer (K characters) is a closed syncmer if the smallest of its inner S-mers by hash stands at either end.
Whether it is chosen depends on the k-mer alone, so an edit moves only anchors that it touches. Texts are padded
with K - 1 zeros on either side, which gives short texts anchors too. The fingerprint lists all anchors in order of
position: base64 of 5 bytes an anchor, the distance from the anchor before (K - S + 1 at most, from 0 for the first)
and 32 bits of its hash. `likeness` is the Jaccard similarity of anchors, counting only shared anchors that keep
their order.

Defined results: null text counts as empty; an empty text's fingerprint is '' (two of them are alike 1, one and
another text 0); equal texts have equal fingerprints. Texts are read whole, one at a time, megabytes too; ids pass
unchanged, null ones too; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, prepare

K, S = 16, 6
#: Characters of a batch's texts after which its rows are passed on.
HELD = 4_000_000
PACKED = np.dtype([("step", "u1"), ("hash", ">u4")])
_U = np.uint64
_M1, _M2, _M3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def anchors(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in the padded text) and 64-bit hashes of the closed syncmers."""
    x = np.zeros(len(points) + 2 * (K - 1), dtype=np.uint64)
    x[K - 1 : K - 1 + len(points)] = points
    x = (x + _U(1)) * _M1
    x ^= x >> _U(29)
    two = x[:-1] * _M2 + x[1:]
    h = (two[:-4] * _M3 + two[2:-2]) * _M1 + two[4:]
    h ^= h >> _U(32)
    h *= _M2
    h ^= h >> _U(29)
    w = K - S + 1
    low, width = h, 1
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < w:
        low = np.minimum(low[: len(low) - (w - width)], low[w - width :])
    n = len(low)
    at = np.flatnonzero((h[:n] == low) | (h[w - 1 : w - 1 + n] == low))
    hashes = (h[at] * _M3 + h[at + 5]) * _M1 + h[at + w - 1]
    hashes ^= hashes >> _U(31)
    return at, hashes * _M2


def fingerprint(text: str) -> np.ndarray:
    """Steps and hashes (32 bits each) of all anchors, by position."""
    if not text:
        return np.empty(0, dtype=PACKED)
    at, hashes = anchors(code_points(text))
    out = np.empty(len(at), dtype=PACKED)
    out["step"], out["hash"] = np.diff(at, prepend=0), hashes >> _U(32)
    return out


def as_text(fp: np.ndarray) -> str:
    return base64.b64encode(fp.tobytes()).decode()


def distinct(fp: np.ndarray) -> np.ndarray:
    """Distinct hashes by first position."""
    h = fp["hash"].astype(np.uint32)
    return h[np.sort(np.unique(h, return_index=True)[1])]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: shared anchors in common order among all distinct ones of both fingerprints."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    if not len(a) or not len(b):
        return 0.0
    a, b = distinct(a), distinct(b)
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    same = int(other[0]) if len(other) else n  # a common start is in the longest common order
    shared, at, to = np.intersect1d(a[same:], b[same:], assume_unique=True, return_indices=True)
    tails: list[int] = []
    for p in to[np.argsort(at)].tolist():
        i = bisect_left(tails, p)
        tails[i : i + 1] = [p]
    return (same + len(tails)) / (len(a) + len(b) - same - len(shared))


def edited(text: str, following: str) -> str:
    """The last third of text replaced by as many characters (or all) of the following text."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def bucket_of(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted cuts are at most value, by two short scans."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts) - 1) + 1
    groups = [cuts[i : i + size] for i in range(0, len(cuts), size)]
    numbers = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    coarse = F.size(F.filter(numbers([g[0] for g in groups[1:]]), lambda c: c <= value))
    return let(coarse, lambda i: i * size + F.size(F.filter(F.get(F.array(*[numbers(g) for g in groups]), i), lambda c: c <= value)))


def in_order(docs: DataFrame, partitions: int) -> DataFrame:
    """docs in descending order of doc_id: partition by partition, each row once, plus per bucket one extra row
    (_own false) that holds the first document of the following bucket.

    Buckets are ranges of doc_id at approximate quantiles. Only the buckets' first ids (one row a bucket, a
    number that the caller fixes) are gathered on the driver; texts are shuffled once."""
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = own.select("doc_id")
    cuts = sorted(set(ids.where("doc_id is not null").approxQuantile("doc_id", [i / partitions for i in range(1, partitions)], 0.1 / partitions))) if partitions > 1 else []
    bucket = bucket_of(F.coalesce(F.col("doc_id"), F.lit(-(2**63))), [int(c) for c in cuts])
    first = {r["b"]: r["top"] for r in ids.groupBy(bucket.alias("b")).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(first, reverse=True)
    target = {first[b]: order[i - 1] for i, b in enumerate(order) if first[b] is not None and i} | ({first[order[0]]: order[-1]} if order and first[order[0]] is not None else {})
    if target:
        to = F.try_element_at(F.create_map(*[F.lit(x) for kv in target.items() for x in kv]), F.col("doc_id"))
        places = F.when(to.isNull(), F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")))).otherwise(F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")), F.struct(to.alias("b"), F.lit(False).alias("own"))))
    else:
        places = F.array(F.struct(bucket.alias("b"), F.lit(True).alias("own")))
    placed = own.withColumn("_p", F.explode(places)).select("doc_id", "text", F.col("_p.b").alias("_bucket"), F.col("_p.own").alias("_own"))
    return placed.repartition("_bucket").sortWithinPartitions(F.col("_bucket"), F.col("_own").desc(), F.col("doc_id").desc_nulls_last(), F.col("text"))


def fingerprints(docs: DataFrame, rows_a_bucket: int = 1000, least: int = 1, most: int = 16384) -> DataFrame:
    """One row per document: fingerprints of its text and its edited text, and likenesses. The following document
    is the next in descending doc_id (ties by text), after the last the first; a null doc_id comes last. Extra
    columns are ignored."""
    spark = prepare(docs.sparkSession)
    n = docs.select("doc_id").count()
    partitions = max(least, min(most, n // rows_a_bucket))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # a document that waits for its following one: bucket, id, text, fingerprint

        def row(held, text, fp):
            _, doc_id, t, own_fp = held
            e = edited(t, text)
            efp = fingerprint(e) if e != t else own_fp
            return (doc_id, len(t), hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), as_text(own_fp), as_text(efp), likeness(own_fp, efp), likeness(own_fp, fp))

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for f in frames:
            rows, size = [], 0
            for doc_id, text, b, own in zip(f["doc_id"], f["text"], f["_bucket"], f["_own"], strict=True):
                fp = fingerprint(text)
                if held is not None:
                    if held[0] == b:
                        rows.append(row(held, text, fp))
                    else:  # a bucket without an extra row: the only one, followed by its own first document
                        rows.append(row(held, *firsts[held[0]]))
                if held is None or held[0] != b:
                    firsts = {b: (text, fp)}
                held = (b, doc_id, text, fp) if own else None
                if (size := size + len(text)) > HELD:
                    yield frame(rows, names)
                    rows, size = [], 0
            yield frame(rows, names)
        if held is not None:
            yield frame([row(held, *firsts[held[0]])], names)

    def frame(rows, names):
        return pd.DataFrame(rows, columns=names).astype({"doc_id": object})

    # the id passes as text, as pandas holds bigints with nulls as floats
    named = in_order(docs, partitions).withColumn("doc_id", F.col("doc_id").cast("string"))
    return named.mapInPandas(run, SCHEMA.replace("doc_id bigint", "doc_id string")).withColumn("doc_id", F.col("doc_id").cast("bigint"))
