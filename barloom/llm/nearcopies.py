"""Near copies of texts by SimHash: tries walked within MinHash blocks, and each link checked exactly.

Texts of Jaccard similarity 0.8 over five-word shingles differ in about ten of 64 fingerprint bits, and a
trie walked from its root prunes next to nothing at such a budget. The tries here hang below blocks
instead: a text has ``BANDS`` block keys, each the hash of ``ROWS`` minima of its shingles under as many
hash functions, and two texts of similarity 0.8 share none of them with a probability of 3e-5. Within a
block the trie of fingerprints is self-joined: node pairs are descended together, differing bits are added
up, and a pair is dropped when the sum exceeds ``BUDGET`` bits, or when all its texts are one component
already. What is left is checked on whole shingle sets.

Two rounds keep families of near copies from being compared pair by pair: first only neighbours in the
tries' order are checked, which makes a family one component; then the tries of blocks that still hold
several components are walked. Blocks above ``NODE_ROWS`` rows are dealt to several tasks: the rows of
the most frequent component once each, all others to every part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_KEYS, connected_components, map_batches, materialize, texts_of, without
from .simhash import NODE_ROWS, majority, shingle_hashes

WORDS = 5
BANDS, ROWS = 20, 4
#: Differing bits that two fingerprints may have: 3.6 standard deviations above the mean at similarity 0.8.
BUDGET = 20
#: Of BANDS * ROWS equal minima, those that a pair of similarity 0.8 has but once in ten million times.
AGREE = 44
_MIX = np.random.default_rng(42).integers(1, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_MULTIPLY, _ADD = _MIX[0] | np.uint64(1), _MIX[1]
#: Shingles mixed at once, rows and bytes of sets that a task joins at once, node pairs descended at once.
RUN_SHINGLES, RUN_ROWS, RUN_BYTES, RUN_PAIRS = 1 << 12, 1 << 13, 12 << 20, 1 << 17


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles; all ones for none."""
    out = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(shingles), RUN_SHINGLES):
        out = np.minimum(out, (shingles[at : at + RUN_SHINGLES].view(np.uint64) * _MULTIPLY + _ADD).min(axis=1))
    return out


def sketch(text: str | None) -> tuple[int, int, int, np.ndarray, bytes]:
    """(hash of the set, its size, fingerprint, block keys, one byte of each minimum) of a whole text."""
    h = shingle_hashes(text, WORDS)
    s = np.unique(h)
    m = minima(s)
    keys = [xxhash.xxh64_intdigest(m[t * ROWS : (t + 1) * ROWS].tobytes(), t) for t in range(BANDS)]
    return xxhash.xxh64_intdigest(s.tobytes()), len(s), majority(h), np.array(keys, np.uint64), m.astype(np.uint8).tobytes()


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, node, n, fp, keys, sig) of rows (doc_id, h, text)."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        made = [sketch(t) for t in texts_of(batch, "text")]
        node, n, fp, keys, sig = zip(*made, strict=True) if made else [()] * 5
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate([*keys, np.zeros(0, np.uint64)]).view(np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _signed(node), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), lists, pa.array(sig, pa.binary())], ["doc_id", "h", "node", "n", "fp", "keys", "sig"])

    return map_batches(docs, run, f"doc_id {dict(docs.dtypes)['doc_id']}, h long, node long, n long, fp long, keys array<long>, sig binary")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(h, shingles) of rows (h, text): ascending distinct hashes."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, batch.num_rows, 500):
            part = batch.slice(at, 500)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([np.unique(shingle_hashes(t, WORDS).view(np.int64)) for t in texts_of(part, "text")], pa.list_(pa.int64()))], ["h", "shingles"])

    return map_batches(texts, run, "h long, shingles array<long>")


def alike(s: np.ndarray, t: np.ndarray) -> bool:
    """Whether two ascending sets have Jaccard similarity 0.8 or more."""
    if 9 * min(len(s), len(t)) < 4 * (len(s) + len(t)):
        return False
    both = np.concatenate([s, t])
    both.sort(kind="stable")
    return 9 * int((both[1:] == both[:-1]).sum()) >= 4 * len(both)


def trie_pairs(value: np.ndarray, label: np.ndarray, start: np.ndarray, end: np.ndarray, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of different labels and ``budget`` or fewer differing bits within the nodes [start, end).

    value: uint64, ascending within each node.
    """
    changes = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
    ones: dict[int, np.ndarray] = {}
    stack = [(0, np.column_stack([start, end, start, end, np.zeros(len(start), np.int64)]))]
    while stack:
        depth, f = stack.pop()
        if len(f) > RUN_PAIRS:
            stack.append((depth, f[RUN_PAIRS:]))
            f = f[:RUN_PAIRS]
        a0, a1, b0, b1, d = f.T
        one = (changes[a1 - 1] == changes[a0]) & (changes[b1 - 1] == changes[b0]) & (label[a0] == label[b0])
        f = f[~one]
        if not len(f):
            continue
        a0, a1, b0, b1, d = f.T
        small = ((a1 - a0) * (b1 - b0) <= 64) | (depth == 64)
        if small.any():
            for at in range(0, int(small.sum()), 4096):
                g = f[small][at : at + 4096]
                wide, high = g[:, 1] - g[:, 0], g[:, 3] - g[:, 2]
                which = np.repeat(np.arange(len(g)), wide * high)
                k = np.arange(len(which)) - np.repeat(np.cumsum(wide * high) - wide * high, wide * high)
                i, j = g[which, 0] + k // high[which], g[which, 2] + k % high[which]
                near = (np.bitwise_count(value[i] ^ value[j]) <= budget) & (label[i] != label[j])
                near &= (i < j) | (g[which, 0] != g[which, 2])
                if near.any():
                    yield i[near], j[near]
            f = f[~small]
        if not len(f):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum((value >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)])
        c = ones[depth]
        a0, a1, b0, b1, d = f.T
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = (a0 == b0) & (a1 == b1)
        kids = [np.column_stack(k) for k in ((a0, am, b0, bm, d), (am, a1, bm, b1, d), (a0, am, bm, b1, d + 1))]
        nxt = np.concatenate([*kids, np.column_stack([am, a1, b0, bm, d + 1])[~same]])
        stack.append((depth + 1, nxt[(nxt[:, 0] < nxt[:, 1]) & (nxt[:, 2] < nxt[:, 3]) & (nxt[:, 4] <= budget)]))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Checked edges (a, b) of a partition's blocks; rows come sorted by (key, part, fingerprint)."""
    held: list[pa.RecordBatch] = []

    def joined(t: pa.RecordBatch) -> pa.RecordBatch:
        key, part, band, fp, node, label = (t.column(i).to_numpy(zero_copy_only=False) for i in range(6))
        keys = t.column(6).flatten().to_numpy().reshape(-1, BANDS)
        sig = np.frombuffer(b"".join(t.column(7).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
        sets, places = t.column(8).flatten().to_numpy(), np.concatenate([[0], np.cumsum(t.column(8).value_lengths().to_numpy())])
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])]))
        up: dict[int, int] = {}
        a, b = [], []

        def root(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for i, j in trie_pairs(fp.view(np.uint64), label, new, np.append(new[1:], len(key)), BUDGET):
            # A pair is checked in the first block that it shares, and only if its minima agree as often as similar texts' do.
            first = (keys[i] == keys[j]).argmax(axis=1) == band[i]
            i, j = i[first], j[first]
            agree = (sig[i] == sig[j]).sum(axis=1) >= AGREE
            for x, y in zip(i[agree].tolist(), j[agree].tolist(), strict=True):
                p, q = root(int(node[x])), root(int(node[y]))
                if p != q and alike(sets[places[x] : places[x + 1]], sets[places[y] : places[y + 1]]):
                    up[max(p, q)] = min(p, q)
                    a.append(int(node[x]))
                    b.append(int(node[y]))
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def rows(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]

    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            held.append(batch.slice(at, 2048))
            if sum(b.num_rows for b in held) < RUN_ROWS and sum(b.nbytes for b in held) < RUN_BYTES:
                continue
            t = rows(held)
            key, part = t.column(0).to_numpy(), t.column(1).to_numpy()
            cut = np.flatnonzero((key[1:] != key[:-1]) | (part[1:] != part[:-1]))
            held = [t]
            if len(cut):
                yield joined(t.slice(0, int(cut[-1]) + 1))
                held = [t.slice(int(cut[-1]) + 1)]
    if sum(b.num_rows for b in held):
        yield joined(rows(held))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", node_rows: int = NODE_ROWS) -> DataFrame:
    """(doc_id, component_id) for each row of ``docs``; component_id is the smallest id that links reach.

    Texts link if they share a block, differ in ``BUDGET`` or fewer bits and have Jaccard similarity 0.8 or
    more of their sets of five-word shingles (A-Z lower-cased; a shorter text is one shingle). Texts without
    words link with each other; a null id names a component only if all its ids are null; repeated rows get
    equal values. Other columns are not read.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
    marks = materialize(sketches(slim), "near-sketches")
    nodes = materialize(marks.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("h").alias("h"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sig").alias("sig")), "near-nodes")

    rows = nodes.select("node", "n", "fp", F.posexplode("keys").alias("band", "key"))
    order = Window.partitionBy("key").orderBy(F.expr("shiftrightunsigned(fp, 1)"), F.expr("fp & 1"), "node")
    beside = rows.select("*", *(F.lag(c).over(order).alias(f"_{c}") for c in ("node", "n", "fp")), F.lead("node").over(order).alias("next"))
    shared = materialize(beside.where("_node is not null or next is not null").drop("next"), "near-blocks")

    wanted = materialize(nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "h"), "near-wanted")
    side = wanted.select("h")
    side = F.broadcast(side) if wanted.count() <= BROADCAST_KEYS else side
    sets = shingle_sets(slim.select("h", "text").join(side, "h", "left_semi")).dropDuplicates(["h"])
    sets = materialize(sets.join(wanted, "h").select("node", "shingles"), "near-sets")

    # First round: neighbours in a block's trie.
    fits = (F.bit_count(F.col("fp").bitwiseXOR(F.col("_fp"))) <= BUDGET) & (9 * F.least("n", "_n") >= 4 * (F.col("n") + F.col("_n")))
    pairs = shared.where(F.col("_node").isNotNull() & fits).select(F.least("node", "_node").alias("p"), F.greatest("node", "_node").alias("q")).distinct()
    both = pairs.join(sets.select(F.col("node").alias("p"), F.col("shingles").alias("s")), "p").join(sets.select(F.col("node").alias("q"), F.col("shingles").alias("t")), "q")
    overlap = F.size(F.array_intersect("s", "t"))
    near = materialize(both.where(9 * overlap >= 4 * (F.size("s") + F.size("t"))).select(F.col("p").alias("a"), F.col("q").alias("b")), "near-edges")
    families = connected_components(near)

    # Second round: the tries of blocks that hold several components.
    named = materialize(shared.select("key", "band", "node", "fp").join(families, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component"), "near-labels")
    held = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("key").agg(F.sum("c").alias("m"), F.count(F.lit(1)).alias("labels"), F.max_by("label", F.struct("c", "label")).alias("most"))
    mixed = named.join(materialize(held.where("labels > 1"), "near-held"), "key")
    parts = F.ceil(F.col("m") / node_rows).cast("int")
    # Part 0 of a large block compares what is not of its most frequent component; in the other parts this is one side.
    dealt = (
        F.when(F.col("m") <= node_rows, F.array(F.struct(F.lit(0).alias("part"), F.col("label").alias("label"))))
        .when(F.col("label") == F.col("most"), F.array(F.struct((1 + F.pmod(F.xxhash64("node"), parts)).cast("int").alias("part"), F.lit(0).cast("long").alias("label"))))
        .otherwise(F.transform(F.sequence(F.lit(0), parts), lambda i: F.struct(i.alias("part"), F.when(i == 0, F.col("label")).otherwise(F.lit(1)).alias("label"))))
    )
    mixed = mixed.select("key", "band", "node", "fp", F.explode(dealt).alias("d")).select("key", F.col("d.part").alias("part"), "band", "fp", "node", F.col("d.label").alias("label"))
    full = mixed.join(nodes.select("node", "keys", "sig"), "node").join(sets, "node").select("key", "part", "band", "fp", "node", "label", "keys", "sig", "shingles")
    full = full.repartition("key", "part").sortWithinPartitions("key", "part", F.expr("shiftrightunsigned(fp, 1)"), F.expr("fp & 1"))
    far = materialize(full.mapInArrow(_walk, "a long, b long"), "near-edges")

    groups = connected_components(near.unionAll(far))
    named = materialize(nodes.select("node", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-components")
    linked = materialize(named.groupBy("component").agg(F.min("least").alias("component_id")), "near-ids")
    return marks.select("doc_id", "node").join(named.join(linked, "component").select("node", "component_id"), "node").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose doc_id is not the smallest of its component; same columns.

    Rows of one doc_id are one document: all go if any of them is a copy of a smaller id. Rows with a
    null doc_id stay.
    """
    found = near_copies(docs, id_col, text_col)
    dropped = materialize(found.where("doc_id <> component_id").select("doc_id").distinct(), "near-copies")
    return without(docs, dropped, docs[id_col] == dropped["doc_id"])
