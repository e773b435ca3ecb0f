"""How the sources of a language differ in their words: counts by sorted word pointers, exact shares, distances.

1. ``term_runs`` (Arrow, a slice of a task's texts at a time): pointers to all word starts of the texts'
   buffer are sorted by the words they point to, with a multikey quicksort that compares eight bytes at a
   depth and splits a slice into smaller, equal and greater; a run of equal words then gives its documents and
   its count in each source. No word is made a string before its run is known.
2. Runs are summed by Spark, first for the documents of a term, which decide what a language keeps, and then,
   of kept terms only, for its count in each source.
3. Shares are whole numbers, floor(10^9 (count + 5) / (N + 5 V)) + 1, computed in decimals.
4. Distances of all sources of a language: terms are dealt by language and hash, so that a language that holds
   most of the rows is spread; each group has a block of terms by sources and adds up differences a source at a time.

What leaves a task grows with its vocabulary, not with its words. Groups are pairs of language and source;
the result holds each pair of sources of a language, so its size is stated by the question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

#: Bytes of text whose pointers are sorted at once; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20
#: Slices above this are split around a pivot; smaller ones are sorted on their eight bytes together.
CUTOFF = 1 << 16
#: Documents of a language that a kept term is in, the scale of shares, what is added to counts, and ranks of part ``term``.
LEAST_DOCS, SCALE, ADDED, TOP = 30, 1_000_000_000, 5, 50
#: Rows of kept counts in one group of the distance step, and sources whose distances one group adds up.
GROUP_ROWS, GROUP_SOURCES = 50_000, 256
#: Tables of kept terms and of groups are broadcast up to so many rows; beyond, they are joined by shuffle.
BROADCAST_ROWS = 500_000

#: For each byte the byte of a term it stands for, or 0: letters a to z, A to Z lower-cased, and all beyond ASCII.
_BYTE = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
#: Masks that keep the first 0 to 8 bytes of a big-endian number.
_FIRST = np.array([(2**64 - 1) ^ (2 ** (64 - 8 * n) - 1) for n in range(9)], np.uint64)


def word_pointers(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of each word; data holds term bytes, 0 between words; offsets are the texts' ends and the first's start."""
    inside = data != 0
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]  # texts that meet without a byte between them are parted here
    a, z = offsets[:-1][full], offsets[1:][full] - 1
    first[a], last[z] = inside[a], inside[z]
    start = np.flatnonzero(first)
    return start, np.flatnonzero(last) + 1 - start, np.searchsorted(offsets, start, "right") - 1


def sort_pointers(data: np.ndarray, start: np.ndarray, length: np.ndarray, cutoff: int = CUTOFF) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): the words' numbers sorted by the words' bytes, equal words in their given order, and where runs of equal words begin.

    Multikey quicksort on eight bytes at a depth. A word's bytes are followed by zeros, which no word contains: a slice
    of equal bytes that end in zero is a run.
    """
    n = len(start)
    order, begins = np.arange(n), np.zeros(n, bool)
    eights = np.ndarray((len(data) + 1,), ">u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    key_of = lambda own, depth: eights[np.minimum(start[own] + depth, len(data))].astype(np.uint64) & _FIRST[np.clip(length[own] - depth, 0, 8)]
    large = [(0, n, 0, None)] if n else []
    small: dict[int, list] = {}
    while large:
        lo, hi, depth, key = large.pop()
        if hi - lo <= cutoff:
            small.setdefault(depth, []).append(np.array([[lo, hi]]))
            continue
        own = order[lo:hi]
        key = key_of(own, depth) if key is None else key
        pivot = np.sort(key[:: max(1, len(key) // 63)])[32 if len(key) > 63 else 0]
        less, more = key < pivot, key > pivot
        same = ~(less | more)
        parts = [(own[m], key[m]) for m in (less, same, more)]
        order[lo:hi] = np.concatenate([p[0] for p in parts])
        ends = lo + np.cumsum([0, *(len(p[0]) for p in parts)])
        if int(pivot) & 0xFF == 0 or ends[2] - ends[1] == 1:
            begins[ends[1]] = True
        else:
            large.append((ends[1], ends[2], depth + 8, None))
        large += [(ends[k], ends[k + 1], depth, parts[k][1]) for k in (0, 2) if ends[k + 1] > ends[k]]
    while small:
        depth = min(small)
        slices = np.concatenate(small.pop(depth))
        slices = slices[np.argsort(slices[:, 0])]
        size = slices[:, 1] - slices[:, 0]
        part = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(part)) + np.repeat(slices[:, 0] - (np.cumsum(size) - size), size)
        own = order[place]
        key = key_of(own, depth)
        by = np.lexsort((key, part))
        own, key = own[by], key[by]
        order[place] = own
        cut = np.ones(len(part), bool)
        cut[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1])
        at = np.flatnonzero(cut)
        end = np.append(at[1:], len(part))
        done = (key[at] & np.uint64(0xFF) == 0) | (end - at == 1)
        begins[place[at[done]]] = True
        if not done.all():
            small.setdefault(depth + 8, []).append(np.stack([place[at[~done]], place[at[~done]] + (end - at)[~done]], axis=1))
    return order, np.flatnonzero(begins)


def _runs(batch: pa.RecordBatch) -> pa.RecordBatch:
    """One row for each language and term of a slice: documents, and the counts of each source."""
    lang, source = (batch.column(k).dictionary_encode() for k in (1, 2))
    width = max(1, len(source.dictionary))
    group = lang.indices.to_numpy().astype(np.int64) * width + source.indices.to_numpy()
    order = np.argsort(group, kind="stable")
    group = group[order]
    text = batch.column(0).take(pa.array(order))
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = _BYTE[np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]]
    start, length, doc = word_pointers(data, offsets - offsets[0])
    sort, first = sort_pointers(data, start, length)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(sort))))
    doc = doc[sort]
    own = group[doc]
    # Texts stand by group, and the sort is stable: within a run, groups and documents ascend.
    fresh = np.ones(len(sort), bool)
    fresh[1:] = (run[1:] != run[:-1]) | (own[1:] != own[:-1])
    new_doc = np.ones(len(sort), bool)
    new_doc[1:] = (run[1:] != run[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(fresh)
    n = np.diff(np.append(at, len(sort)))
    docs = np.add.reduceat(new_doc.astype(np.int64), at) if len(at) else n
    head = np.ones(len(at), bool)  # where a row (run and language) begins among the (run, group) cells
    head[1:] = (run[at][1:] != run[at][:-1]) | (own[at][1:] // width != own[at][:-1] // width)
    row = np.flatnonzero(head)
    word = sort[at[row]]
    terms = _strings(data, start[word], length[word])
    cells = np.append(row, len(at)).astype(np.int32)
    total = lambda x: np.add.reduceat(x, row) if len(row) else x
    listed = lambda x: pa.ListArray.from_arrays(pa.array(cells), x)
    return pa.RecordBatch.from_arrays(
        [lang.dictionary.take(pa.array(own[at[row]] // width)), terms, pa.array(total(docs)), pa.array(total(n)), listed(source.dictionary.take(pa.array(own[at] % width))), listed(pa.array(n))],
        ["lang", "term", "docs", "n", "sources", "counts"],
    )


def _strings(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """The words at the given pointers as one Arrow array."""
    ends = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], length)
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(data[at].tobytes()))


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``SLICE_BYTES`` of text, or of one text."""
    text = batch.column(0)
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def term_runs(docs: DataFrame) -> DataFrame:
    """(lang, term, docs, n, sources, counts): a row for each language and term of a slice of ``docs`` (text, lang, source, no nulls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                yield _runs(part)

    return docs.mapInArrow(run, "lang string, term string, docs long, n long, sources array<string>, counts array<long>")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE (count + ADDED) / (total + ADDED terms)), exact; null where there are no terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = wide(total + ADDED * terms)
    return (F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * wide(count + ADDED), F.when(over > 0, over)) + 1).cast("long")


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of all sources of each language.

    Part ``pair``: each other source of the language, its distance (the shares' absolute differences, summed over the kept
    terms; 0 if none is kept). Part ``term``: the terms whose share in the source exceeds the language's most, ``top`` of them.
    A term is kept in a language if ``least_docs`` of its rows have it. Null texts, languages and sources are ''. A source whose
    rows have no terms has a group all the same; no rows give no rows. Repeated rows count each. Other columns are not read.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    docs = docs.select(text(text_col).alias("text"), text(lang_col).alias("lang"), text(source_col).alias("source"))
    runs = materialize(term_runs(docs), "term-runs")
    kept = runs.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= least_docs)
    kept = materialize(kept.select("lang", "term", "n"), "kept-terms")
    rows = runs.join(_small(kept.select("lang", "term")), ["lang", "term"]).select("lang", "term", F.inline(F.arrays_zip("sources", "counts")))
    counts = materialize(rows.groupBy("lang", "sources", "term").agg(F.sum("counts").alias("n")).select("lang", F.col("sources").alias("source"), "term", "n"), "term-counts")
    release(runs)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs.select("lang", "terms"), "lang", "left")
    groups = groups.select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms"))
    groups = materialize(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))), "groups")
    shares = materialize(counts.join(_small(groups), ["lang", "source"]).select("lang", "source", "term", share(F.col("n"), F.col("total"), F.col("terms")).alias("p")), "shares")
    of_lang = materialize(kept.join(_small(langs.withColumnRenamed("total", "all")), "lang").select("lang", "term", share(F.col("n"), F.col("all"), F.col("terms")).alias("q")), "language-shares")
    terms = shares.join(_small(of_lang), ["lang", "term"]).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int"))
    return ranked(source_distances(shares, groups)).unionByName(ranked(terms).where(F.col("rank") <= top))


def source_distances(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, part, item, value): the summed absolute differences of shares of each two sources of a language.

    shares: (lang, source, term, p), written; groups: (lang, source, total, terms, p0), p0 the share of a term that the source lacks.
    Dealt by language, hash of the term, and block of sources; a source's row of differences is added up at once.
    """
    slots = max(1, -(-shares.count() // GROUP_ROWS))
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / GROUP_SOURCES).cast("int").alias("blocks"))
    by_block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = shares.join(_small(blocks), "lang").select("lang", F.pmod(F.xxhash64("term"), F.lit(slots)).alias("slot"), by_block.alias("block"), "source", "term", "p")
    right = groups.join(_small(blocks), "lang").select("lang", "blocks", "source", F.coalesce("p0", F.lit(0)).alias("p0"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slots - 1).cast("long"))).alias("slot"))
    right = right.select("lang", "slot", by_block.alias("block"), "blocks", "source", "p0")

    def add(key: tuple, terms: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source", kind="stable")
        names = sources["source"].to_numpy()
        own = np.arange(key[2], len(names), int(sources["blocks"].iloc[0]))
        far = np.zeros((len(own), len(names)), np.int64)
        code, _ = pd.factorize(terms["term"])
        by = np.argsort(code, kind="stable")
        code, at, p = code[by], pd.Index(names).get_indexer(terms["source"])[by], terms["p"].to_numpy()[by]
        many = code[-1] + 1 if len(code) else 0
        step = max(1, (1 << 20) // len(names))  # terms whose shares are laid out at once
        for a in range(0, many, step):
            lo, hi = np.searchsorted(code, [a, a + step])
            block = np.repeat(sources["p0"].to_numpy()[None, :], min(step, many - a), axis=0)
            block[code[lo:hi] - a, at[lo:hi]] = p[lo:hi]
            for k, s in enumerate(own):
                far[k] += np.abs(block - block[:, s : s + 1]).sum(axis=0)
        other = np.tile(np.arange(len(names)), len(own))
        mine = np.repeat(own, len(names))
        keep = mine != other
        return pd.DataFrame({"lang": key[0], "source": names[mine[keep]], "item": names[other[keep]], "value": far.ravel()[keep]})

    keys = ("lang", "slot", "block")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(add, "lang string, source string, item string, value long")
    return parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
