"""SimHash near-dedup: fingerprints, a binary trie self-join within a Hamming budget, components.

A fingerprint is 64 majority bits of the XXH64 hashes of a text's word shingles. The join walks
binary tries: node pairs are descended together, differing bits are added up, and a pair whose sum
exceeds the budget is dropped. Within budget k two fingerprints share at least one of k + 1 blocks
of bits exactly, so k + 1 tries are built, each with another block rotated to the top, and each walk
starts at the pairs of equal top nodes: every other start would exceed the budget in all of them.
A fingerprint is thus shuffled k + 1 times, whatever the number of documents.

Top nodes with more than ``NODE_ROWS`` distinct fingerprints (large families of near copies) are
split along their own most balanced bits: each fingerprint goes to the pairs of child nodes whose
paths differ in at most k bits. A task reads its sorted rows as a stream and holds one top node or
one pair of child nodes at a time. Tasks return spanning edges of what they linked, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, map_batches, materialize, texts_of, without

SEED = 42
SHINGLE_WORDS = 3
BUDGET = 2
#: A top node with more distinct fingerprints than this is split; children aim at a quarter of it.
NODE_ROWS = 4096
#: Rows that a task joins at once, and node pairs that it descends at once.
RUN_ROWS, RUN_PAIRS = 1 << 16, 1 << 18


def _parts(text: str | None, words: int) -> Iterator[np.ndarray]:
    """XXH64 hashes of a whole text's shingles, repeats included, a slice at a time; none for null or no words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and the six ASCII spaces
    for at in range(0, max(1, len(w) - words + 1) if w else 0, RUN_ROWS):
        part = w[at : at + RUN_ROWS + words - 1]
        grams = zip(*(part[i:] for i in range(words)), strict=False) if len(w) >= words else [part]
        yield np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), SEED) for g in grams), np.uint64)


def shingle_hashes(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 hashes of all shingles, repeats included."""
    return np.concatenate([*_parts(text, words), np.zeros(0, np.uint64)])


def _majority(parts: Iterator[np.ndarray]) -> int:
    total, n = np.zeros(64, np.int64), 0
    for h in parts:
        total += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * total > n, bitorder="little").view("<i8")[0])


def majority(hashes: np.ndarray) -> int:
    """Signed 64-bit number of the bits that over half of the hashes have."""
    return _majority(hashes[at : at + RUN_ROWS] for at in range(0, len(hashes), RUN_ROWS))


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of a whole text; 0 for null or no words."""
    return _majority(_parts(text, words))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fingerprint long) for each row of ``docs``; null and empty texts have fingerprint 0."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        marks = pa.array([fingerprint(t, words) for t in texts_of(batch, "text")], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), marks], ["doc_id", "fingerprint"])

    kind = dict(docs.dtypes)[id_col]
    return map_batches(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, f"doc_id {kind}, fingerprint long")


def _roots(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if (up == i).all():
            return i
        i = up


def _unite(parent: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the sets of i and j: the larger root hangs below the smaller one until all agree."""
    while len(i):
        a, b = _roots(parent, i), _roots(parent, j)
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def trie_links(value: np.ndarray, pairs: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges (i, j) of all links within ``budget`` bits that the node pairs lead to.

    value: uint64, ascending within each node. pairs: rows (start, end, start, end) of two nodes,
    the same node twice for a self-join. A node is the slice that shares the bits read so far.
    """
    n = len(value)
    parent = np.arange(n)
    ones = {}
    stack = [(0, np.column_stack([pairs, np.zeros(len(pairs), np.int64)]))]
    while stack:
        depth, f = stack.pop()
        if len(f) > RUN_PAIRS:
            stack += [(depth, f[RUN_PAIRS:])]
            f = f[:RUN_PAIRS]
        a0, a1, b0, b1, d = f.T
        leaf = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[leaf], b0[leaf]
        near = (np.bitwise_count(value[i] ^ value[j]) <= budget) & (i != j)
        _unite(parent, i[near], j[near])
        f = f[~leaf]
        if not len(f) or depth == 64:
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((value >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        c = ones[depth]
        a0, a1, b0, b1, d = f.T
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        kids = [(a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1)]
        nxt = np.concatenate([np.column_stack(k) for k in kids] + [np.column_stack([am, a1, b0, bm, d + 1])[~same]])
        keep = (nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] <= budget)
        keep &= ~((nxt[:, 0] == nxt[:, 2]) & (nxt[:, 1] - nxt[:, 0] == 1))
        stack.append((depth + 1, nxt[keep]))
    root = _roots(parent, np.arange(n))
    i = np.flatnonzero(root != np.arange(n))
    return i, root[i]


def _join_runs(batches: Iterator[pa.RecordBatch], budget: int) -> Iterator[pa.RecordBatch]:
    """Join each run of whole nodes of a partition that is sorted by (trie, top, x, y, side, bits)."""
    held: list[np.ndarray] = []

    def table(batch: pa.RecordBatch) -> np.ndarray:
        return np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns])

    def linked(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        value = rows[:, 5].astype(np.uint64)
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, :5] != rows[:-1, :5]).any(axis=1)
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(rows))
        side = rows[start, 4]
        own = side == 0
        selfs = np.column_stack([start[own], end[own], start[own], end[own]])
        left = np.flatnonzero((side[:-1] == 1) & (side[1:] == 2) & (rows[start[:-1], :4] == rows[start[1:], :4]).all(axis=1))
        cross = np.column_stack([start[left], end[left], start[left + 1], end[left + 1]])
        i, j = trie_links(value, np.concatenate([selfs, cross]), budget)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array(rows[i, 6]), pa.array(rows[j, 6])], ["p", "q"])

    for batch in batches:
        if batch.num_rows:
            held.append(table(batch))
        if sum(map(len, held)) >= RUN_ROWS:
            rows = np.concatenate(held)
            differs = np.flatnonzero((rows[1:, :4] != rows[:-1, :4]).any(axis=1))
            if len(differs):
                cut = differs[-1] + 1
                yield from linked(rows[:cut])
                rows = rows[cut:]
            held = [rows]
    if held:
        yield from linked(np.concatenate(held))


def links(distinct: DataFrame, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """Spanning edges (p, q) over a table of distinct ``fingerprint`` values within ``budget`` bits."""
    spans, at = [], 0
    for k in range(budget + 1):
        width = (64 - at) // (budget + 1 - k)
        spans.append((k, at, width))
        at += width
    turned = F.array(*(F.struct(
        F.lit(k).alias("trie"),
        (F.expr(f"(fingerprint << {at}) | shiftrightunsigned(fingerprint, {64 - at})") if at else F.col("fingerprint")).alias("bits"),
        F.lit(64 - width).alias("rest"),
    ) for k, at, width in spans))
    rows = distinct.select("fingerprint", F.explode(turned).alias("t")).select("fingerprint", "t.trie", "t.bits", F.expr("shiftrightunsigned(t.bits, t.rest)").alias("top"))
    # Aggregates are written before they are joined to what they sum up, so that Spark can split a large node.
    n = materialize(rows.groupBy("trie", "top").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "trie-counts")
    shared = materialize(rows.join(n, ["trie", "top"]), "trie-nodes")
    plain = shared.where(F.col("n") <= node_rows).select("trie", "top", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"), "bits", "fingerprint")

    # Large nodes: child paths over the d most balanced bits, then pairs of paths within the budget.
    large = shared.where(F.col("n") > node_rows)
    balance = [F.abs(F.avg(F.expr(f"shiftrightunsigned(bits, {b}) & 1")) - 0.5) for b in range(64)]
    chosen = large.groupBy("trie", "top").agg(F.array(*balance).alias("balance"), F.first("n").alias("n")).select(
        "trie", "top",
        F.expr(f"slice(transform(array_sort(transform(balance, (v, i) -> struct(v, i))), s -> s.i), 1, least(24, 2 + int(ceil(log2(n / {node_rows}.0)))))").alias("at"),
    )
    chosen = materialize(chosen, "trie-bits")
    near = "array(0)"
    for _ in range(budget):
        near = f"array_distinct(flatten(transform({near}, m -> concat(array(m), transform(sequence(0, size(at) - 1), i -> m | shiftleft(1, i))))))"
    paths = large.join(chosen, ["trie", "top"]).withColumn("path", F.expr("aggregate(at, 0, (acc, b) -> acc * 2 + cast(shiftrightunsigned(bits, b) & 1 as int))"))
    pairs = paths.select("trie", "top", "bits", "fingerprint", "path", F.explode(F.expr(near)).alias("mask")).withColumn("other", F.expr("path ^ mask"))
    split = pairs.select("trie", "top", F.least("path", "other").alias("x"), F.greatest("path", "other").alias("y"), F.expr("case when mask = 0 then 0 when path < other then 1 else 2 end").alias("side"), "bits", "fingerprint")
    # A self pair must not stand among the plain rows' keys: its x and y are moved up by one.
    split = split.withColumns({"x": F.col("x") + 1, "y": F.col("y") + 1})

    dealt = plain.unionAll(split).repartition("trie", "top", "x", "y").sortWithinPartitions("trie", "top", "x", "y", "side", F.expr("shiftrightunsigned(bits, 1)"), F.expr("bits & 1"))
    return dealt.mapInArrow(lambda it: _join_runs(it, budget), "p long, q long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, budget: int = BUDGET, node_rows: int = NODE_ROWS) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for each row of ``docs``.

    Fingerprints link at ``budget`` or fewer differing bits; component_id is the smallest id that
    links reach. Null or empty texts share fingerprint 0 and link like any other; repeated rows get
    equal values; a null id is kept in its row and never becomes a component's name unless all ids
    of the component are null. Further columns of ``docs``, whatever their names, are not read.
    """
    marks = materialize(fingerprints(docs, id_col, text_col, words), "fingerprints")
    distinct = materialize(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "distinct-fingerprints")
    edges = links(distinct.select("fingerprint"), budget, node_rows).select(F.col("p").alias("a"), F.col("q").alias("b"))
    groups = connected_components(edges).withColumnRenamed("node", "fingerprint")
    named = distinct.join(groups, "fingerprint", "left").withColumn("component", F.coalesce("component", "fingerprint"))
    named = materialize(named.select("fingerprint", "least", "component"), "named-fingerprints")
    linked = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "component-ids")
    final = named.join(linked, "component").select("fingerprint", "component_id")
    return marks.join(final, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_fingerprint(c: str = "fingerprint"):
    """16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(c), 16, "0"))


def drop_near_duplicates(docs: DataFrame, **kw) -> DataFrame:
    """``docs`` without the rows whose doc_id is not the smallest of its component; same columns.

    Rows of one doc_id are one document: all go if any of them is a copy of a smaller id. Rows with a
    null doc_id stay.
    """
    found = near_duplicates(docs, **kw)
    dropped = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return without(docs, dropped, docs[kw.get("id_col", "doc_id")] == dropped["doc_id"])
