"""N-gram Jaccard self-join by a MinHash LSH forest with exact verification.

A document is the set of its WORDS-word shingles (words are runs without white space; one with fewer words is one
shingle of all). Each of TREES trees labels it with a signature of DEEPEST MinHash values; sorted, the signatures are a
prefix trie, whose nodes at a depth hold the documents that share so many first values. All trees are descended to the
deepest level, then matched prefixes are shortened level by level, in all trees at once, as in an LSH forest's queries:

- At a level, a pair is compared in the first tree where it shares a prefix of that length, if it shares no longer one
  anywhere (then it was met before) and one of both is still a query. Only nodes that branch there and hold a query are read.
- A document stops being a query once its target recall is reached: from the similarities of the links found so far follows
  how likely links like them were to be found down to this level, hence how many were missed (`missed`).
- No prefix is shortened beyond the length at which a pair just at the threshold is found with the target recall.

Matches are verified exactly, on 64-bit shingle hashes.

Documents with equal shingle sets form one class of copies, of which one document is compared. Nodes go to tasks as
blocks: one of m documents makes blocks of about BLOCK, and each pair of blocks is one
group, so no task holds a whole large node. A group returns per document the number of links found and one link towards the
least document of its component there, not the pairs. Components of these links are found by distributed label passing.

Shingle sets go by their md5, ids are only names: different texts that share an id are all compared, as are texts
without an id. Defined results: documents without words (null text too) have no links and are classes of their own; a
class or set of rows without any id has null for its name; unconnected classes may share their least id; exact
duplicates of rows are copies of each other; an empty table gives an empty result; columns other than doc_id and text
are ignored, whatever their names; texts of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, prepare

WORDS, THRESHOLD, TARGET = 5, 0.8, 0.9999
TREES, DEEPEST = 24, 7
#: Bytes of a signature's value.
VALUE = 2
#: Nodes of SMALL documents are one group. Blocks of larger ones hold BLOCK documents and HELD shingles at most, by the average:
#: what a task has in memory at once. No result depends on them.
SMALL, BLOCK, HELD = 16, 1024, 4_000_000
_U = np.uint64
_M = [_U(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
_rng = np.random.default_rng(17)
PERMUTATIONS = _rng.integers(1, 2**62, (2, TREES * DEEPEST), dtype=np.int64).astype(np.uint64) * _U(2) + _U(1)
_SPACE = np.zeros(33, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = np.ones(1, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _M[4]
    return h ^ (h >> _U(29))


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word, all at once: characters times powers by place, summed."""
    global _powers
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    space = _SPACE[np.minimum(x, 33 - 1)] & (x <= 32)
    inside = ~space
    starts = np.flatnonzero(inside & np.concatenate(([True], space[:-1]))) if len(x) else np.zeros(0, int)
    if not len(starts):
        return np.zeros(0, np.uint64)
    place = np.arange(len(x)) - np.repeat(starts, np.diff(starts, append=len(x)), axis=0) if starts[0] == 0 else np.concatenate((np.zeros(starts[0], int), np.arange(starts[0], len(x)) - np.repeat(starts, np.diff(starts, append=len(x)))))
    if (longest := int(place.max()) + 1) > len(_powers):
        _powers = np.cumprod(np.concatenate(([_U(1)], np.full(2 * longest, _M[0]))))
    value = np.where(inside, mixed((x.astype(np.uint64) + _U(1)) * _M[1]) * _powers[place], _U(0))
    return mixed(np.add.reduceat(value, starts))


def shingles(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    k = min(n, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h = h * _M[2] + w[i : len(w) - k + 1 + i]
    return np.unique(mixed(h))


def prefix_length(threshold: float = THRESHOLD, target: float = TARGET, trees: int = TREES) -> int:
    """The longest prefix, shortened from DEEPEST, whose expected recall at the threshold reaches the target."""
    depth = DEEPEST
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < target:
        depth -= 1
    return depth


def signature(s: np.ndarray) -> bytes:
    """DEEPEST values for each tree, one tree after the other."""
    a, b = PERMUTATIONS
    low = np.full(TREES * DEEPEST, ~_U(0))
    for at in range(0, len(s), 2048):
        low = np.minimum(low, (s[at : at + 2048, None] * a + b).min(0))
    return (mixed(low) >> _U(64 - 8 * VALUE)).astype(">u2").tobytes()


def prefix_hashes(signatures: list[bytes], depth: int) -> np.ndarray:
    """Document x tree: one hash of the first depth values."""
    x = np.frombuffer(b"".join(signatures), ">u2").reshape(len(signatures), TREES, DEEPEST).astype(np.uint64)
    h = np.zeros(x.shape[:2], np.uint64)
    for i in range(depth):
        h = mixed(h * _M[3] + x[:, :, i] + _U(1))
    return h


def missed(similarity: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For links of these similarities found down to a depth: how many like each were missed, and how many there are."""
    gone = (1 - similarity**depth) ** TREES
    return gone / np.maximum(1 - gone, 1e-9), 1 / np.maximum(1 - gone, 1e-9)


def row_key(doc_id: Column, text: Column) -> Column:
    """md5 of a row's id and text; null differs from any value of either."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("bigint").cast("string"), F.lit("")), F.when(text.isNull(), ":").otherwise("::"), F.coalesce(text, F.lit(""))).cast("binary")))


def once(rows: DataFrame, name: str) -> DataFrame:
    """rows with one of equal values of a column in each partition, so that a value of many rows fills no task."""
    prepare(rows.sparkSession)
    at = rows.columns.index(name)

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for b in found:
            new = []
            for v in b.column(at).to_pylist():
                new.append(v not in seen)
                seen.add(v)
            yield b if all(new) else b.filter(pa.array(new, pa.bool_()))
            if len(seen) > 1_000_000:
                seen.clear()

    return rows.mapInArrow(batches, rows.schema)


def signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, row (its key), key (of the shingle set; null without words), n (shingles), signature."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            keys, sizes, signatures = [], [], []
            for t in f["text"]:
                s = shingles(t, words)
                keys.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                sizes.append(len(s))
                signatures.append(signature(s) if len(s) else None)
            yield pd.DataFrame({"doc_id": f["doc_id"], "row": f["row"], "key": keys, "n": sizes, "signature": signatures})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("row"), "text")
    # the id passes as text, as pandas holds bigints with nulls as floats
    return (
        rows.withColumn("doc_id", F.col("doc_id").cast("string"))
        .mapInPandas(batches, "doc_id string, row binary, key binary, n bigint, signature binary")
        .withColumn("doc_id", F.col("doc_id").cast("bigint"))
    )


def common_counts(sets: list[np.ndarray], left: int) -> np.ndarray:
    """Sizes of the intersections of sets[:left] with sets[left:], or of all with all where left is 0."""
    lengths = [len(s) for s in sets]
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), lengths)
    out = 0
    width = max(1024, (1 << 24) // len(sets))  # 64 MB at a time
    for at in range(0, len(values), width):
        own = (inverse >= at) & (inverse < at + width)
        m = np.zeros((len(sets), min(width, len(values) - at)), np.float32)
        m[owner[own], inverse[own] - at] = 1
        out = out + (m[:left] @ m[left:].T if left else m @ m.T)
    return np.rint(out).astype(np.int64)


def verified(tree: int, sets: list[np.ndarray], here: np.ndarray, deeper: np.ndarray | None, query: np.ndarray, block: np.ndarray, across: bool, rank: np.ndarray, limit: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of a group, with their similarities, that are similar enough. here, deeper: hashes of the prefixes of this
    level (no earlier tree may share one) and of the next deeper one (no tree may); one of a pair must be a query. Across
    blocks of a level that has a deeper one, the left block holds queries, and two queries meet in the order of their ranks."""
    none = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    if across:
        order = np.argsort(block, kind="stable")
        left = int((block == block.min()).sum())
        if left == len(sets):
            return none
    else:
        order, left = np.arange(len(sets)), 0
    a, b = (order[:left], order[left:]) if across else (order, order)
    size = np.array([len(s) for s in sets])
    fits = np.minimum(size[a][:, None], size[b][None]) * limit.denominator >= limit.numerator * np.maximum(size[a][:, None], size[b][None])
    fits &= query[a][:, None] | query[b][None]
    if not across:
        fits = np.triu(fits, 1)
    for t in range(tree):
        fits &= here[a, t][:, None] != here[b, t][None]
    if across and deeper is not None:
        fits &= (rank[a][:, None] < rank[b][None]) | ~query[b][None] & (rank[a][:, None] != rank[b][None])
    if deeper is not None:
        for t in range(TREES):
            fits &= deeper[a, t][:, None] != deeper[b, t][None]
    i, j = np.nonzero(fits)
    if not len(i):
        return none
    if len(i) <= 8:
        both = np.array([len(np.intersect1d(sets[a[x]], sets[b[y]], assume_unique=True)) for x, y in zip(i, j, strict=True)])
    else:
        both = common_counts([sets[x] for x in order], left)[i, j]
    every = size[a[i]] + size[b[j]] - both
    good = both * limit.denominator >= limit.numerator * every
    return a[i[good]], b[j[good]], both[good] / every[good]


def groups_at(member: DataFrame, depth: int) -> DataFrame:
    """tree, node, i, j, key, query, block: the documents of the nodes at a depth that branch there and hold a query, dealt
    to groups. member: key, n (shingles), tree, path (the signature there), query. A node's documents go to blocks. At the
    deepest level, where all are queries, each pair of blocks is a group; later, each block of queries with each of all."""
    node = F.substring("path", 1, VALUE * depth).alias("node")
    count = [F.count("*").alias("m"), F.sum("n").alias("w"), F.count_if("query").alias("q")]
    if depth == DEEPEST:
        sizes = member.groupBy("tree", node).agg(*count).where("m > 1")
    else:
        child = member.groupBy("tree", F.substring("path", 1, VALUE * (depth + 1)).alias("path")).agg(*count)
        sizes = child.groupBy("tree", node).agg(F.max("m").alias("top"), *[F.sum(c).alias(c) for c in "mwq"]).where("top < m and q > 0").drop("top")
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("w") / HELD)).cast("int")
    inner = member.select("tree", node, "key", "query").join(sizes.select("tree", "node", "m", blocks.alias("n"), F.ceil(blocks * F.col("q") / F.col("m")).cast("int").alias("nq")), ["tree", "node"])
    # small nodes: equal sets of members are compared once, in their first tree
    sets = inner.where(F.col("m") <= SMALL).groupBy("tree", "node").agg(F.sort_array(F.collect_list(F.struct("key", "query"))).alias("members"))
    distinct = sets.groupBy("members").agg(F.min(F.struct("tree", "node")).alias("g"))
    small = distinct.select("g.tree", "g.node", F.lit(0).alias("i"), F.lit(0).alias("j"), F.explode("members").alias("x")).select("tree", "node", "i", "j", "x.key", "x.query", F.lit(0).alias("block"))
    large = inner.where(F.col("m") > SMALL).withColumn("block", F.pmod(F.xxhash64("key"), F.col("n")).cast("int"))
    if depth == DEEPEST:
        large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("tree", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "key", "query", "block")
    else:
        own = F.pmod(F.xxhash64("key", F.lit(1)), F.col("nq")).cast("int")
        asked = large.where("query").withColumn("j", F.explode(F.sequence(F.col("nq"), F.col("nq") + F.col("n") - 1))).select("tree", "node", own.alias("i"), "j", "key", "query", F.lit(0).alias("block"))
        every = large.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).select("tree", "node", "i", (F.col("nq") + F.col("block")).alias("j"), "key", "query", F.lit(1).alias("block"))
        large = asked.unionByName(every)
    return small.unionByName(large)


FOUND = "no_id boolean, id bigint, key binary, root_no_id boolean, root_id bigint, root_key binary, n_docs bigint, n_texts bigint, missed array<double>, total array<double>"


def compared(dealt: DataFrame, depth: int, levels: list[int], limit: Fraction) -> DataFrame:
    """What each group found for each of its documents: a link towards its component's least, numbers of links, and for
    each level how many were missed down to it and how many there are."""

    def result(key: tuple, rows: list) -> list[tuple]:
        if len(rows) < 2:
            return []
        ids = [r[0] for r in rows]  # no_id, id, key
        signatures, mult = [r[1] for r in rows], np.array([r[2] for r in rows])
        place = {k: i for i, k in enumerate(sorted({r[0][2] for r in rows}))}
        rank = np.array([place[r[0][2]] for r in rows])
        deeper = prefix_hashes(signatures, depth + 1) if depth < DEEPEST else None
        x, y, alike = verified(key[0], [np.frombuffer(r[3], np.uint64) for r in rows], prefix_hashes(signatures, depth), deeper, np.array([r[5] for r in rows], bool), np.array([r[4] for r in rows]), key[2] != key[3], rank, limit)
        root = list(range(len(ids)))

        def find(v: int) -> int:
            while root[v] != v:
                root[v] = root[root[v]]
                v = root[v]
            return v

        for u, v in zip(x.tolist(), y.tolist(), strict=True):
            u, v = find(u), find(v)
            if u != v:
                u, v = (u, v) if ids[u] < ids[v] else (v, u)
                root[v] = u
        both = lambda w: np.bincount(x, w, len(ids)) + np.bincount(y, w, len(ids))
        texts = both(np.ones(len(x)))
        total = np.bincount(x, mult[y], len(ids)) + np.bincount(y, mult[x], len(ids))
        lost, every = ([both(m[k]) for m in (missed(alike, d) for d in levels)] for k in (0, 1))
        return [(*ids[i], *ids[find(i)], int(total[i]), int(texts[i]), [float(v[i]) for v in lost], [float(v[i]) for v in every]) for i in np.flatnonzero(texts).tolist()]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FOUND.split(", ")]
        at, held = None, []
        out: list[tuple] = []
        for f in frames:
            for tree, node, i, j, *row in zip(f["tree"], f["node"], f["i"], f["j"], zip(f["no_id"], f["id"], f["key"], strict=True), f["signature"], f["mult"], f["s"], f["block"], f["query"], strict=True):
                if (tree, node, i, j) != at:
                    out += result(at, held)
                    at, held = (tree, node, i, j), []
                held.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        out += result(at, held)
        if out:
            yield pd.DataFrame(out, columns=names)

    return dealt.mapInPandas(batches, FOUND)


def links(docs: DataFrame, reps: DataFrame, words: int, threshold: float, target: float) -> DataFrame:
    """key, node and root (no_id, id, key), n_docs, n_texts: what each group found for each of its documents."""
    least = min(prefix_length(threshold, target), DEEPEST)
    path = F.expr(f"substring(signature, tree * {VALUE * DEEPEST} + 1, {VALUE * DEEPEST})")
    every = reps.select("key", "n", "signature", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select("key", "n", "tree", path.alias("path"), F.substring(path, 1, VALUE * least).alias("top"))
    shared = every.groupBy("tree", "top").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    member = cut(every.join(shared, ["tree", "top"]).select("key", "n", "tree", "path"))
    wanted = reps.join(member.select("key").distinct(), "key", "left_semi").select("key", "rep.no_id", "rep.id", "rep.row", "signature", "mult")
    limit = Fraction(str(threshold))

    def sets_of(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f[["key", "no_id", "id", "signature", "mult"]].assign(s=[shingles(t, words).tobytes() for t in f["text"]])

    # texts are joined once, on the row's key alone, and read once: every level takes the sets from one table
    texts = once(docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "text"), "row").join(wanted, "row")
    sets = texts.select("key", "no_id", "id", "signature", "mult", "text").mapInPandas(sets_of, "key binary, no_id boolean, id bigint, signature binary, mult bigint, s binary")
    payload = cut(sets.dropDuplicates(["key"]))
    levels, found, stopped = list(range(DEEPEST, least - 1, -1)), [], None
    for k, depth in enumerate(levels):
        if stopped is None:
            queries = member.withColumn("query", F.lit(True))
        else:
            queries = member.join(stopped.withColumn("_s", F.lit(True)), "key", "left").withColumn("query", F.col("_s").isNull()).drop("_s")
        dealt = groups_at(queries, depth).join(payload, "key").repartition("tree", "node", "i", "j").sortWithinPartitions("tree", "node", "i", "j", "key")
        found.append(cut(compared(dealt, depth, levels, limit)))
        so_far = reduce(DataFrame.unionAll, found).groupBy("key").agg(F.sum(F.get("missed", F.lit(k))).alias("missed"), F.sum(F.get("total", F.lit(k))).alias("total"))
        stopped = so_far.where(F.col("missed") <= (1 - target) * F.col("total")).select("key")
    return reduce(DataFrame.unionAll, found).select(
        "key", F.struct("no_id", "id", "key").alias("node"), F.struct(*[F.col(f"root_{c}").alias(c) for c in ("no_id", "id", "key")]).alias("root"), "n_docs", "n_texts",
    )


def cut_of(table: DataFrame, *columns: str) -> DataFrame:
    """Columns of a stored table, that can be discarded with it."""
    out = table.select(*columns)
    out.stored_at = table.stored_at
    return out


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node of each component of edges (a, b). Labels pass along links and jump to the
    labels of labels until none changes; each round is written, so its lineage is short."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = cut(step.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")))
        discard(labels)
        if new.where("old != label").isEmpty():
            discard(both)
            return new.select("node", "label")
        labels = cut_of(new, "node", "label")


def classed(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, target: float = TARGET) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, row, key), and one row per shingle set: key, rep (no_id, id, row: its first row by id), mult, n_docs,
    n_texts (null without links) and label (no_id, id, key: the first set by id of its component; its own without links)."""
    prepare(docs.sparkSession)
    own = cut(signed(docs, words))
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("id"), "row"))
    reps = cut(own.where("key is not null").groupBy("key").agg(rep.alias("rep"), F.count("*").alias("mult"), F.first("n").alias("n"), F.first("signature").alias("signature")))
    found = links(docs, reps, words, threshold, target)
    classes = components(found.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))).select("node.key", "label")
    counts = found.groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_texts").alias("n_texts"))
    label = F.coalesce("label", F.struct("rep.no_id", "rep.id", "key"))
    return own.select("doc_id", "row", "key"), reps.drop("signature", "n").join(counts, "key", "left").join(classes, "key", "left").withColumn("label", label)


def firsts(docs: DataFrame) -> DataFrame:
    """row: the keys of the rows that stay, one of each class. Rows without words are classes of their own."""
    own, by_key = classed(docs)
    return by_key.where("label.key = key").select("rep.row").union(own.where("key is null").select("row").distinct())


def near_duplicates(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, target: float = TARGET) -> DataFrame:
    """One row per document: doc_id, class_id (the least doc_id of its component of links and copies), copy_of (the
    least doc_id with an equal shingle set), n_links (other documents that are similar enough, copies
    included) and n_link_texts (different shingle sets among them, its own not counted)."""
    own, by_key = classed(docs, words, threshold, target)
    named = by_key.select("key", F.when(~F.col("label.no_id"), F.col("label.id")).alias("class"), F.when(~F.col("rep.no_id"), F.col("rep.id")).alias("copy"), "mult", "n_docs", "n_texts")
    rows = own.select("doc_id", "key")
    # rows without words have no key to be joined on; there may be many
    worded = rows.where("key is not null").join(named, "key", "left").drop("key")
    loose = rows.where("key is null").select("doc_id", *[F.lit(None).cast("bigint").alias(c) for c in ("class", "copy", "mult", "n_docs", "n_texts")])
    return worded.select(*loose.columns).unionAll(loose).select(
        "doc_id", F.coalesce("class", "doc_id").alias("class_id"), F.coalesce("copy", "doc_id").alias("copy_of"),
        (F.coalesce("mult", F.lit(1)) - 1 + F.coalesce("n_docs", F.lit(0))).alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("bigint").alias("n_link_texts"),
    )
