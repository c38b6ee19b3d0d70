"""Language identification by error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier (logistic regression on hashed
character n-grams of the whole text) is trained on a bounded sample. A text's bit margins are decoded to the
codeword of least weighted logistic loss; a bit weighs as much as its accuracy on the part of the sample kept
from training. A small gap between the best two codewords flags the text as ambiguous.

Defined results: null texts and texts without a letter are `und`, score 0; without any labelled row all texts
are `und`; with one language every text with a letter gets it. Repeated rows get equal results. Texts are read whole,
megabytes too; an empty table gives an empty result; ids and all other columns pass as Arrow buffers, whatever their names.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import held_out, numbered, prepare

DIM = 2048
UNKNOWN = "und"
#: Rows of the training sample: a language at most, and in all; but each language has LEAST, however many there are.
SAMPLE_A_LANGUAGE, SAMPLE, LEAST = 800, 6000, 20
AMBIGUOUS = 0.2
#: Rows of features that are widened at a time.
ROWS = 500

_fold: np.ndarray | None = None


def fold() -> np.ndarray:
    """Code point -> code of its lower-case letter; a space (32) for what is no letter."""
    global _fold
    if _fold is None:
        out = np.full(0x110000, 32, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _fold = out
    return _fold


def features(text: str | None) -> np.ndarray | None:
    """Square roots of the shares of hashed 1- to 3-grams, or None without a letter."""
    x = fold()[np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")]
    if not len(x) or not (x != 32).any():
        return None
    x = np.concatenate(([np.uint32(32)], x, [np.uint32(32)]))
    two = x[:-1] * np.uint32(0x9E3779B1) + x[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + x[2:] * np.uint32(0x27D4EB2F)
    spaces = (x[1:] == 32) & (x[:-1] == 32)
    keys = np.concatenate((x[x != 32] * np.uint32(0x165667B1), two[~spaces], three[~spaces[:-1]]))
    keys ^= keys >> np.uint32(15)
    counts = np.bincount((keys * np.uint32(0x2C1B3C6D)) >> np.uint32(21), minlength=DIM).astype(np.float32)
    counts = np.sqrt(counts)
    return counts / np.sqrt((counts**2).sum())


def codebook(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +1 and -1: all splits up to 6 languages, else the best of random codes by least distance."""
    if n < 2:
        return np.ones((n, 0))
    if n <= 6:
        sets = [s for k in range(1, n) for s in combinations(range(n), k) if 0 in s]
        return np.array([[1.0 if i in s else -1.0 for s in sets] for i in range(n)])
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(n)))
    best, score = None, -1
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], (n, bits))
        d = min(int((bits - c[i] @ c[i + 1 :].T).min()) // 2 for i in range(n - 1))
        d = d if (np.abs(c.sum(0)) < n).all() else -1
        best, score = (c, d) if d > score else (best, score)
    return best


@dataclass
class Decoder:
    languages: list[str]
    codes: np.ndarray  # language x bit
    weights: np.ndarray  # bit
    planes: np.ndarray  # DIM x bit
    bias: np.ndarray

    def losses(self, x: np.ndarray) -> np.ndarray:
        margins = x @ self.planes + self.bias
        return (np.logaddexp(0, -margins) * self.weights) @ (self.codes > 0).T + (np.logaddexp(0, margins) * self.weights) @ (self.codes < 0).T

    def decode(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, whether ambiguous."""
        if len(self.languages) == 1:
            return self.languages * len(x), np.ones(len(x)), np.zeros(len(x), bool)
        losses = self.losses(x)
        p = np.exp(-(losses - losses.min(1, keepdims=True)) / max(self.weights.sum() / 4, 1e-9))
        p /= p.sum(1, keepdims=True)
        top = np.sort(p, 1)
        return [self.languages[i] for i in p.argmax(1)], p.max(1), top[:, -1] - top[:, -2] < AMBIGUOUS


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 4.0, ridge: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Planes and biases for all bits at once, by accelerated gradient descent on class-balanced loss. x may be of half
    precision: ROWS of it at a time are widened."""
    n, bits = y.shape
    share = (y > 0).mean(0)
    weight = np.where(y > 0, 0.5 / np.maximum(share, 1e-6), 0.5 / np.maximum(1 - share, 1e-6)).astype(np.float32) / n
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    vw, vb = w.copy(), b.copy()
    for i in range(rounds):
        m = i / (i + 3)
        lw, lb = w + m * vw, b + m * vb
        slope, drop = ridge * lw, np.zeros(bits, np.float32)
        for at in range(0, n, ROWS):
            part, yp = x[at : at + ROWS].astype(np.float32), y[at : at + ROWS]
            g = -yp * weight[at : at + ROWS] / (1 + np.exp(np.clip(yp * (part @ lw + lb), -30, 30)))
            slope += part.T @ g
            drop += g.sum(0)
        nw, nb = lw - rate * 4 * slope, lb - rate * drop
        vw, vb, w, b = nw - w, nb - b, nw, nb
    return w, b


def fit(labelled: DataFrame, per_language: int = SAMPLE_A_LANGUAGE, total: int = SAMPLE) -> Decoder | None:
    """A decoder from labelled rows (doc_id, text, lang), for every lang that isn't null. At most `per_language` rows
    of a language and `total` rows in all (but LEAST a language), of least hash, are fitted: their features (DIM numbers of
    half precision a row) come to the driver, a partition at a time. A fifth of them, by hash, only weighs the bits."""
    spark = prepare(labelled.sparkSession)
    counts = {r["lang"]: r["count"] for r in labelled.where("lang is not null").groupBy("lang").count().collect()}
    if not counts:
        return None
    per = max(1, min(per_language, max(LEAST, total // len(counts))))
    shares = spark.createDataFrame([(k, min(1.0, 1.5 * per / n + 20 / n)) for k, n in sorted(counts.items())], "lang string, share double")
    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    picked = labelled.select("doc_id", "text", "lang").join(F.broadcast(shares), "lang").where(part < F.col("share"))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            found = [(lang, h, x.astype(np.float16).tobytes()) for lang, h, t in zip(f["lang"], f["h"], f["text"], strict=True) if (x := features(t)) is not None]
            yield pd.DataFrame(found, columns=["lang", "h", "x"])

    hashed = picked.select("lang", F.xxhash64("text", "doc_id").alias("h"), "text").mapInPandas(batches, "lang string, h bigint, x binary")
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h", "x"))
    x, names, hashes = np.empty((per * len(counts), DIM), np.float16), [], []
    for lang, h, row in hashed.withColumn("i", order).where(F.col("i") <= per).select("lang", "h", "x").toLocalIterator():
        x[len(names)] = np.frombuffer(row, np.float16)
        names.append(lang)
        hashes.append(h)
    languages = sorted(set(names))
    codes = codebook(len(languages))
    if len(languages) < 2:
        return Decoder(languages, codes, np.ones(0), np.zeros((DIM, 0)), np.zeros(0)) if languages else None
    place = {lang: i for i, lang in enumerate(languages)}
    by_hash = sorted(range(len(names)), key=lambda i: (hashes[i], names[i]))
    checked = [i for k, i in enumerate(by_hash) if k % 5 == 0] if len(names) >= 50 else []
    learnt = [i for k, i in enumerate(by_hash) if k % 5] if checked else by_hash
    y = codes[[place[n] for n in names]].astype(np.float32)
    own, x = x[checked].astype(np.float32), x[learnt]
    w, b = logistic(x, y[learnt])
    right = (((own @ w + b) * y[checked]) > 0).mean(0) if checked else np.ones(codes.shape[1])
    weights = np.log(np.clip(right, 0.5, 0.999) / (1 - np.clip(right, 0.5, 0.999)))
    return Decoder(languages, codes, weights if weights.any() else np.ones(len(weights)), w, b)


def decoded(m: Decoder | None, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, scores, whether ambiguous."""
    n = len(texts)
    pred, score, unsure = [UNKNOWN] * n, np.zeros(n), np.ones(n, bool)
    for at in range(0, n, 500):
        found = [(at + i, x) for i, t in enumerate(texts[at : at + 500]) if m is not None and (x := features(t)) is not None]
        if found:
            names, s, u = m.decode(np.array([x for _, x in found]))
            for (i, _), name, si, ui in zip(found, names, s, u, strict=True):
                pred[i], score[i], unsure[i] = name, si, ui
    return pred, score, unsure


def told(docs: DataFrame, decoder: Decoder | None) -> DataFrame:
    """docs (numbered columns, so names can't clash) with lang_pred, score and ambiguous for each whole text. Other
    columns pass as Arrow buffers, unchanged."""
    spark = prepare(docs.sparkSession)
    model = spark.sparkContext.broadcast(decoder)
    rows, text = numbered(docs), docs.columns.index("text")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", lang_pred string, score double, ambiguous boolean"
    names = [*rows.columns, "lang_pred", "score", "ambiguous"]

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in found:
            pred, score, unsure = decoded(model.value, b.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(unsure, pa.bool_())], names)

    return rows.mapInArrow(batches, fields)


def predict(docs: DataFrame, decoder: Decoder | None, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs with lang_pred, score and ambiguous, for each row's whole text."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return told(docs, decoder).select(*[F.col(at[c]).alias(c) for c in keep], "lang_pred", "score", "ambiguous")


def relabel(docs: DataFrame, decoder: Decoder | None) -> DataFrame:
    """docs with lang predicted; rows of unknown language go. All other columns stay, whatever their names."""
    known = told(docs, decoder).where(F.col("lang_pred") != UNKNOWN)
    return known.select(*[F.col("lang_pred" if c == "lang" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous; learnt from the rows that aren't held out."""
    rows = docs.select("doc_id", "text", "lang", held_out(F.col("doc_id")).alias("held_out"))
    return predict(rows.drop("lang"), fit(rows.where("not held_out")), ["doc_id", "held_out"])
