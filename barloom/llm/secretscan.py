"""Secret scans: fixed patterns, and random strings found by character Markov models.

Two models of character pairs, one of random strings and one of ordinary identifiers, are trained from
labelled samples; a token is reported when the log-likelihood ratio of the two, a character, exceeds a
threshold. Random samples are drawn from a seeded generator and from the values that the patterns find;
identifiers are the corpus's own words, alone and joined in the usual ways. Half of the sampled documents
train, the other half calibrate: for each class of tokens (four lengths, letters only or not) the
threshold is what at most ``MISTAKES`` of its ordinary tokens exceed. The sample of documents is bounded
(``SAMPLE_DOCS`` by hash of id, a documented parameter); scanning covers every whole text.

Judged are all tokens of ``LEAST_CHARS`` or more outside the patterns' spans, what such a span leaves of
a token, and, where a token as a whole is not reported, its pieces between / = _ and -. Tokens of digits
alone are numbers, and not judged.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Documents that the identifier model may learn from, and random strings that are drawn.
SAMPLE_DOCS, SAMPLE_RANDOM = 2000, 3000
#: Shortest token that the models judge, and the least threshold of the log-likelihood ratio a character (nats).
LEAST_CHARS, LEAST_RATIO = 12, 0.3
#: Share of a class's ordinary tokens that may be reported; lengths at which a new class starts; bins of ratios.
MISTAKES, LENGTHS = 1e-3, (16, 20, 32)
BINS = np.arange(-4.0, 6.0, 0.02)
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as no shorter run can be part of it
TOKEN = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST_CHARS},}}")
PIECE = re.compile(rf"[A-Za-z0-9+]{{{LEAST_CHARS},}}")
WORDS = re.compile(r"[A-Za-z0-9+/_=-]+")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_PLACE = np.full(128, len(ALPHABET), np.int64)
_PLACE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
SIZE = len(ALPHABET) + 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, kind by kind; code points."""
    out = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in HEX.finditer(text)]
    return out


def codes_of(tokens: list[str]) -> np.ndarray:
    """Places in the alphabet of the tokens' characters, an end mark around and between tokens."""
    return _PLACE[np.frombuffer(("\n" + "\n".join(tokens) + "\n").encode("ascii"), np.uint8)]


def pair_counts(tokens: list[str]) -> np.ndarray:
    """How often each pair of neighbours occurs in the tokens, ends marked; a flat table."""
    c = codes_of(tokens)
    return np.bincount(c[:-1] * SIZE + c[1:], minlength=SIZE * SIZE) if tokens else np.zeros(SIZE * SIZE, np.int64)


def ratios(tokens: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's mean log-likelihood ratio, and its class: length, and 4 more if it has letters only."""
    if not tokens:
        return np.zeros(0), np.zeros(0, np.int64)
    c, n = codes_of(tokens), np.array([len(t) for t in tokens])
    start = np.cumsum(n + 1) - n - 1
    mean = np.add.reduceat(table[c[:-1] * SIZE + c[1:]], start) / (n + 1)
    letters = np.add.reduceat(((c < 52) | (c == SIZE - 1))[1:], start) == n + 1
    return mean, np.searchsorted(LENGTHS, n, "right") + 4 * letters


def drawn(n: int = SAMPLE_RANDOM, seed: int = 7, least: int = LEAST_CHARS) -> list[str]:
    """Labelled random strings over the alphabets that keys are written in."""
    draw = random.Random(seed)
    letters = ALPHABET[:62]
    sets = (letters + "+/", letters + "-_", letters, ALPHABET[:26] + "0123456789", "0123456789abcdef", ALPHABET[26:52] + "0123456789")
    return ["".join(draw.choices(sets[i % len(sets)], k=draw.randint(least, 64))) for i in range(n)]


def identifiers(words: list[str]) -> list[str]:
    """Labelled identifiers from neighbouring words: joined by a sign or by capitals, some with a number, some all in capitals."""
    joins = ("{}_{}", "{}-{}", "{}{}", "{}_{}_1", "{}/{}", "{}_{}2", "{}{}.", "{}=10")
    made = [joins[i % len(joins)].format(a.lower(), b.title() if i % 3 else b.lower()) for i, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    return [m.upper() if i % 4 == 3 else m for i, m in enumerate(made)]


def ratio_table(random_counts: np.ndarray, word_counts: np.ndarray) -> np.ndarray:
    """Log ratio of transition probabilities, each row smoothed by half a count."""

    def model(counts: np.ndarray) -> np.ndarray:
        c = counts.reshape(SIZE, SIZE) + 0.5
        return np.log(c / c.sum(axis=1, keepdims=True))

    return (model(random_counts) - model(word_counts)).ravel()


def pieces(start: int, token: str) -> Iterator[tuple[int, str]]:
    """(place, piece) of a token's pieces between / = _ and -, if long enough and shorter than the token."""
    for m in PIECE.finditer(token):
        if len(m[0]) < len(token):
            yield start + m.start(), m[0]


def open_tokens(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, str]]:
    """(place, token) of what the spans in ``taken`` leave of the text's tokens; digits alone are left out."""
    spans, k, out = sorted((a, b) for _, a, b in taken), 0, []
    for m in TOKEN.finditer(text):
        at, end = m.span()
        while k < len(spans) and spans[k][1] <= at:
            k += 1
        j = k
        while j < len(spans) and spans[j][0] < end:
            if spans[j][0] > at:
                out.append((at, text[at : spans[j][0]]))
            at = max(at, spans[j][1])
            j += 1
        if at < end:
            out.append((at, text[at:end]))
    return [(a, t) for a, t in out if len(t) >= LEAST_CHARS and not t.isdigit()]


def _sampled(docs: DataFrame, id_col: str, text_col: str, sample_docs: int) -> DataFrame:
    """(text, half) of the documents whose hashed ids are smallest; half is 0 or 1."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    ids = slim.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs).distinct()
    half = F.xxhash64("doc_id", F.lit("half")).bitwiseAND(1).cast("int")
    return slim.join(F.broadcast(ids), "doc_id", "left_semi").where("text is not null").select("text", half.alias("half"))


def ordinary(text: str) -> tuple[list[str], list[str]]:
    """A text's words and the identifiers made of them, and the values that the patterns find."""
    words, secret, at = [], [], 0
    for _, a, b in sorted(base_spans(text), key=lambda s: s[1]):
        if a >= at:
            words += WORDS.findall(text[at:a])
            secret += WORDS.findall(text[a:b])[-1:]
            at = b
    words += WORDS.findall(text[at:])
    known = [w for w in dict.fromkeys(words) if w.isalpha()]
    return words + [w for x in identifiers(known) for w in WORDS.findall(x)], secret


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """The log-ratio table and the eight classes' thresholds, from up to ``sample_docs`` documents.

    Only ids meet at the driver, and then counts: at most two tables of ``SIZE``^2 cells, and a histogram
    of eight classes.
    """
    sample = materialize(_sampled(docs, id_col, text_col, sample_docs), "secret-sample")

    def counted(fn: Callable[[str], list[np.ndarray]], half: int, size: int) -> np.ndarray:
        """Sums of the arrays that ``fn`` gives for each text of a half."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size, np.int64)
            for batch in batches:
                for v in batch.column(0):
                    total += fn(v.as_py())
            i = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(total[i])], ["i", "n"])

        out = np.zeros(size)
        for r in sample.where(F.col("half") == half).select("text").mapInArrow(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():
            out[r["i"]] = r["n"]
        return out

    def pairs(text: str) -> np.ndarray:
        words, secret = ordinary(text)
        return np.concatenate([pair_counts(secret), pair_counts(words)])

    counts = counted(pairs, 0, 2 * SIZE * SIZE).reshape(2, -1)
    table = ratio_table(counts[0] + pair_counts(drawn()), counts[1])

    def scored(text: str) -> np.ndarray:
        mean, kind = ratios([w for w in ordinary(text)[0] if len(w) >= LEAST_CHARS and not w.isdigit()], table)
        return np.bincount(kind * (len(BINS) + 1) + np.searchsorted(BINS, mean, "right"), minlength=8 * (len(BINS) + 1))

    seen = counted(scored, 1, 8 * (len(BINS) + 1)).reshape(8, -1)
    above = seen[:, ::-1].cumsum(axis=1)[:, ::-1]  # tokens at or above each bin's lower bound
    allowed = above <= MISTAKES * np.maximum(above[:, :1], 1)
    least = np.concatenate([[-np.inf], BINS])[allowed.argmax(axis=1)]
    return table, np.maximum(LEAST_RATIO, np.where(allowed.any(axis=1), least, np.inf))


def random_spans(text: str, model: tuple[np.ndarray, np.ndarray], taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Tokens, or pieces of them, that look random, outside the spans in ``taken``."""
    table, least = model

    def judge(found: list[tuple[int, str]]) -> np.ndarray:
        mean, kind = ratios([t for _, t in found], table)
        return mean >= least[kind]

    whole = open_tokens(text, taken)
    if not whole:
        return []
    hit = judge(whole)
    parts = [p for (a, t), h in zip(whole, hit.tolist(), strict=True) if not h for p in pieces(a, t) if not p[1].isdigit()]
    out = [w for w, h in zip(whole, hit.tolist(), strict=True) if h]
    out += [p for p, h in zip(parts, judge(parts).tolist(), strict=True) if h]
    return [("random", a, a + len(t)) for a, t in sorted(out)]


def written(spans: list[tuple[str, int, int]]) -> str:
    """kind:start:end by start, then by kind as listed, joined by commas."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))))


def scan(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans) for each row of ``docs``; null as empty.

    base and spans are texts of ``written``: the fixed patterns' spans, and those with the models' spans.
    Repeated rows repeat; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"]
        for batch in batches:
            rows = []
            for v in batch.column(1):
                text = v.as_py() or ""
                base = base_spans(text)
                n = Counter(k for k, _, _ in base)
                more = random_spans(text, model, base)
                rows.append((n["assign"], n["access"], n["hex"], written(base), written(base + more)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base string, spans string")


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``scan`` with models trained on ``docs`` themselves; an empty table gives no rows."""
    return scan(docs, train(docs, id_col, text_col), id_col, text_col)
