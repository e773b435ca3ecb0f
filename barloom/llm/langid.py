"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the ``PROFILE`` most frequent n-grams (one to three characters, word ends
marked) of all training texts of a language. A document's own list is compared to each profile by
out-of-place distance: the sum, over the document's n-grams, of how far each stands from its place
in the profile, with the full profile length for an absent one. The nearest language wins.

N-grams are packed into integers and counted with numpy, a bounded slice of a text at a time;
counts are summed by Spark over every training document. What is collected is the profiles: at
most ``PROFILE`` rows a language and ``MAX_LANGUAGES`` languages, beyond which training refuses.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, with_fields

#: N-grams in a profile.
PROFILE = 300
#: Languages whose profiles may be collected; more is an error, not a cut.
MAX_LANGUAGES = 1000
#: Characters counted at once, and documents whose counts are merged before they leave a task.
SLICE, MERGE = 1 << 18, 256


@lru_cache(1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams (ascending) and their counts; both empty if the text has no letter."""
    codes = _letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    parts = []
    for at in range(0, len(codes), SLICE):
        # Two characters of the next slice complete the n-grams that start in this one.
        a = np.concatenate([[0] if at == 0 else codes[at - 1 : at], codes[at : at + SLICE + 2], [0, 0]])
        end = min(len(codes) - at, SLICE) + 1
        x, y, z = a[:end], a[1 : end + 1], a[2 : end + 2]
        own = np.arange(end) > 0  # the first element only marks a word's start
        ones = x[own & (x > 0)]
        two = (x << 21) | y
        start = _starts(x, y, own, at + end - 1 >= len(codes))
        three = (two << 21) | z
        # Without this bit, a pair and a triple that starts a word would have the same number.
        parts.append(_count(np.concatenate([ones, two[start] | (1 << 42), three[start & (y > 0)] | (1 << 62)])))
    return _merge(parts)


def _starts(x: np.ndarray, y: np.ndarray, own: np.ndarray, last: bool) -> np.ndarray:
    """Places where an n-gram of two or more characters starts: each is counted in one slice only."""
    at = (x > 0) & own
    mark = (x == 0) & (y > 0)
    if not last and len(mark):
        mark[-1] = False  # the next slice sees this word start again
    return at | mark


def _count(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        u, n = np.unique(values, return_counts=True)
        return u, n.astype(np.int64)
    u, inverse = np.unique(values, return_inverse=True)
    return u, np.bincount(inverse, weights, len(u)).astype(np.int64)


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(parts) == 1:
        return parts[0]
    return _count(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", profile: int = PROFILE) -> DataFrame:
    """Profiles (lang, gram, place) over every row of ``docs`` with a text and a language; place counts from 0.

    Ties in frequency go to the smaller packed n-gram. Rows without text or language teach nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                g, n = _merge(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1), strict=True):
                parts = held.setdefault(lang.as_py(), [])
                parts.append(grams(text.as_py()))
                if len(parts) >= MERGE:
                    parts[:] = [_merge(parts)]
                    if len(parts[0][0]) > SLICE:
                        yield from out()
            if len(held) > MAX_LANGUAGES:
                yield from out()
        yield from out()

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return counts.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < profile).select("lang", "gram", "place")


def predict(docs: DataFrame, profiles: DataFrame, id_col: str = "doc_id", text_col: str = "text", profile: int = PROFILE) -> DataFrame:
    """``docs``'s columns with lang_pred and score; columns of these names are replaced.

    lang_pred is ``und`` and score 0 for a null text, a text without letters, or no profiles; ties go
    to the language that sorts first. score is 1 minus the distance as a share of the largest one.
    """
    rows = profiles.limit(MAX_LANGUAGES * profile + 1).collect()
    if len(rows) > MAX_LANGUAGES * profile:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    by: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["place"])):
        by.setdefault(r["lang"], []).append(r["gram"])
    langs = list(by)
    known = np.unique(np.array([g for v in by.values() for g in v], np.int64))
    places = np.full((len(langs), len(known) + 1), -1, np.int64)  # the last column: an n-gram of no profile
    for k, v in enumerate(by.values()):
        places[k, np.searchsorted(known, np.array(v, np.int64))] = np.arange(len(v))

    def judge(text: str | None) -> tuple[str, float]:
        g, n = grams(text) if text and langs else (np.zeros(0, np.int64),) * 2
        if not len(g):
            return "und", 0.0
        if len(g) > profile:
            least = np.partition(n, len(n) - profile)[len(n) - profile]
            g, n = g[n >= least], n[n >= least]
        g = g[np.lexsort((g, -n))][:profile]
        at = np.searchsorted(known, g)
        at[(at == len(known)) | (known[np.minimum(at, len(known) - 1)] != g)] = len(known)
        there = places[:, at]
        far = np.where(there < 0, profile, np.minimum(profile, np.abs(there - np.arange(len(g))))).sum(axis=1)
        best = int(far.argmin())
        return langs[best], 1.0 - float(far[best]) / (profile * len(g))

    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    place = kept.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [judge(t.as_py()) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*kept, "lang_pred", "score"])

    source = docs.select(*kept)
    return source.mapInArrow(run, with_fields(source, lang_pred="string", score="double"))


def learned(docs: DataFrame) -> DataFrame:
    """Profiles of ``docs``, written to the shared folder."""
    return materialize(train(docs), "language-profiles")
