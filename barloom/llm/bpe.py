"""Exact BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word exactly one token can end its encoding. It is found among the vocabulary
tokens that end there (an automaton with suffix links names them) as the one that is compatible with
the last token of the prefix before it; back-pointers from the whole word then give the ids. Two
tokens are compatible if merging their joined text, from the rank list, never builds a token across
their border. The work is linear in the word's length, with no merge loop.

The vocabulary file is that of a word-level tokenizer: NFC, lower case, white space dropped, a
suffix on a word's last symbol, special tokens found in the raw text. Its path is a parameter; it is
read on the driver and broadcast (a few MB, whatever the corpus); each Python worker builds its tables once.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from .common import with_fields

#: Words whose ids a worker remembers, and the longest of them. Only speed depends on these.
CACHE_WORDS, CACHE_CHARS = 150_000, 40
#: Unicode White_Space, which the file's pattern excludes from words.
SPACE = r"\t-\r \x85\xa0  -     　"


ASTRAL = re.compile("[\U00010000-\U0010ffff]")


@lru_cache(8)
def ranges(pattern: str) -> list[tuple[int, int]]:
    """Runs of code points that one character of ``pattern`` matches.

    The tokenizer library's own pattern engine is asked, as its Unicode version is not Python's.
    """
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out: list[tuple[int, int]] = []
    for run, _ in pre_tokenizers.Split(Regex(f"{pattern}+"), "removed", invert=True).pre_tokenize_str(every):
        lo, hi = ord(run[0]), ord(run[-1])
        out += [(lo, hi)] if hi - lo + 1 == len(run) else [(lo, 0xD7FF), (0xE000, hi)]
    return out


def inside(runs: list[tuple[int, int]], most: int) -> str:
    """The inside of a character set with the runs' code points up to ``most``."""
    return "".join(f"\\U{lo:08x}-\\U{min(hi, most):08x}" for lo, hi in runs if lo <= most)


def late_capitals() -> dict[int, str]:
    """Lower case of characters that the library knows and this Python's tables do not."""
    low = normalizers.Lowercase()
    new = (chr(c) for c in range(0x20000) if unicodedata.category(chr(c)) == "Cn")
    return {ord(c): x for c in new if (x := low.normalize_str(c)) != c}


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Known(dict):
    """What ``make`` gives for a word, remembered for short words in two generations.

    When ``CACHE_WORDS`` are held, they become the old generation, from which used ones return.
    """

    def __init__(self, make: Callable[[str], str]):
        super().__init__()
        self.make = make
        self.old: dict[str, str] = {}

    def __missing__(self, word: str) -> str:
        out = self.old.get(word) or self.make(word)
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[word] = out
        return out


class WordBpe:
    """A vocabulary with its merge ranks. Pickles as the file's text; tables are built where used."""

    def __init__(self, source: str, letters: list | None = None, numbers: list | None = None):
        self.source = source
        self.letters, self.numbers = letters or ranges(r"\p{L}"), numbers or ranges(r"\p{N}")
        spec = json.loads(source)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.vocab: dict[str, int] = model["vocab"]
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.letter = byte_letters()
        self.spelling = dict(enumerate(self.letter))
        # A token as one character a symbol: the last symbol of a word is moved to a private plane.
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = (self.vocab[x] for x in (pair if isinstance(pair, list) else pair.split(" ")))
            made = self.vocab[self.token[left] + self.token[right]]
            self.rank[left, right] = rank
            self.parts[made] = (left, right, rank)
        self.matcher = ahocorasick.Automaton()
        symbols = set(self.letter) | {x + self.suffix for x in self.letter}
        for text, i in self.vocab.items():
            if i in self.parts or text in symbols:
                key = self._closed(text[: -len(self.suffix)]) if self.suffix and text.endswith(self.suffix) and text != self.suffix else text
                self.matcher.add_word(key, (i, len(key)))
        self.matcher.make_automaton()
        special = "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True))
        self.split_special = re.compile(f"({special})") if special else None
        # Small sets are looked up at once; runs beyond the first plane are tried one by one.
        self.latin_words, self.plane_words, self.any_words = (self.pattern(most) for most in (0xFF, 0xFFFF, 0x10FFFF))
        self.late = late_capitals()
        self.late_any = re.compile(f"[{''.join(map(chr, self.late))}]") if self.late else None
        self.ascii_words = re.compile(rf"[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^{SPACE}a-z0-9]+", re.ASCII)
        self.spelt = {str(i): t for i, t in self.token.items()}
        self.known = Known(lambda w: " ".join(map(str, self.encode_word(w))))
        self.fits: dict[tuple[int, int], bool] = {}

    def __reduce__(self):
        return type(self), (self.source, self.letters, self.numbers)

    @classmethod
    def load(cls, path: str) -> WordBpe:
        return cls(Path(path).read_text(encoding="utf-8"))

    def _closed(self, text: str) -> str:
        return text[:-1] + chr(0xF0000 + ord(text[-1])) if self.suffix else text

    def compatible(self, left: int, right: int) -> bool:
        """Whether the encoding of the joined text keeps the border between the two tokens.

        The merges inside both tokens are replayed from the last to the first: whichever side was
        built later is opened, and the pair that then touches at the border must not have a merge
        that would have come before the one that was opened.
        """
        a, b, before = left, right, 1 << 60
        while True:
            # A tie: the same merge stands in both; the left-hand place is merged first.
            if self.rank.get((a, b), 1 << 60) < before:
                ok = False
                break
            ra = self.parts[a][2] if a in self.parts else -1
            rb = self.parts[b][2] if b in self.parts else -1
            if ra < 0 and rb < 0:
                ok = True
                break
            if ra > rb:
                before, a = ra, self.parts[a][1]
            else:
                before, b = rb + 1, self.parts[b][0]
        if len(self.fits) >= 1 << 18:
            self.fits.clear()
        self.fits[left, right] = ok
        return ok

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word (lower case, no white space)."""
        if not (word.isascii() and word.isprintable()):
            word = word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.spelling)
        text = self._closed(word)
        last: list[int] = [-1] * (len(text) + 1)
        start: list[int] = [0] * (len(text) + 1)
        fits = self.fits
        for end, (token, size) in self.matcher.iter(text):
            i = end + 1
            if last[i] >= 0:
                continue
            j = i - size
            if j == 0 or (prev := last[j]) >= 0 and (ok if (ok := fits.get((prev, token))) is not None else self.compatible(prev, token)):
                last[i], start[i] = token, j
        ids, i = [], len(text)
        while i:
            ids.append(last[i])
            i = start[i]
        return ids[::-1]

    def words_of(self, part: str) -> list[str]:
        """The words of a stretch without special tokens."""
        if part.isascii():
            return self.ascii_words.findall(part.lower())
        try:
            part.encode("latin-1")  # such a text is composed already and stays in this range
        except UnicodeEncodeError:
            part = self.lower(unicodedata.normalize("NFC", part))
            return (self.any_words if ASTRAL.search(part) else self.plane_words).findall(part)
        return self.latin_words.findall(part.lower())

    def pattern(self, most: int) -> re.Pattern:
        """The file's word pattern, for texts without code points above ``most``."""
        x, n = inside(self.letters, most), inside(self.numbers, most)
        return re.compile(rf"[{x}]+|'s|'t|'re|'ve|'m|'ll|'d|[{n}]|[^{SPACE}{x}{n}]+")

    def lower(self, text: str) -> str:
        """Lower case of each character by itself: no final sigma."""
        if self.late_any and self.late_any.search(text):
            text = text.translate(self.late)
        return "".join(c.lower() for c in text) if "Σ" in text else text.lower()

    def encode(self, text: str | None) -> str:
        """Ids of a whole text, joined by one space; null as empty."""
        out, known = [], self.known.__getitem__
        for k, part in enumerate(self.split_special.split(text or "") if self.split_special else [text or ""]):
            if k % 2:
                out.append(str(self.special[part]))
            else:
                out += map(known, self.words_of(part))
        return " ".join(out)

    def decode(self, ids: str) -> str:
        """Tokens of space-joined ids, joined by one space: the file names no decoder. An unknown id is an error."""
        return " ".join(map(self.spelt.__getitem__, ids.split()))

    def plain_text(self, ids: str) -> str:
        """Readable text of space-joined ids: bytes restored, a space after each word."""
        back = {c: b for b, c in enumerate(self.letter)}
        out = bytearray()
        for i in ids.split():
            token = self.token[int(i)]
            ends = bool(self.suffix) and token.endswith(self.suffix)
            out += token.encode() if int(i) in self.special.values() else bytes(back[c] for c in (token[: -len(self.suffix)] if ends else token))
            out += b" " * ends
        return out.decode("utf-8", "replace")


_LOADED: dict[int, WordBpe] = {}


def _worker(parts: tuple) -> WordBpe:
    """The vocabulary's tables, built once in each Python worker."""
    key = hash(parts[0])
    if key not in _LOADED:
        _LOADED[key] = WordBpe(*parts)
    return _LOADED[key]


def _shared(df: DataFrame, vocabulary: str):
    """The file's text and the character runs (a few MB, fixed by the file), broadcast."""
    return df.sparkSession.sparkContext.broadcast((Path(vocabulary).read_text(encoding="utf-8"), ranges(r"\p{L}"), ranges(r"\p{N}")))


def _append(df: DataFrame, col: str, new: str, vocabulary: str, fn, kind: str) -> DataFrame:
    kept = [c for c in df.columns if c != new]
    place = kept.index(col)
    shared = _shared(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(shared.value)
        for batch in batches:
            out = pa.array([fn(bpe, v.as_py()) for v in batch.column(place)], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, out], [*kept, new])

    picked = df.select(*kept)
    return picked.mapInArrow(run, with_fields(picked, **{new: "string"}))


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", to: str = "token_ids") -> DataFrame:
    """``docs``'s columns with ``to``: the text's ids, decimal, joined by one space.

    A null or empty text has the empty string. A column that is already named ``to`` is replaced.
    """
    return _append(docs, text_col, to, vocabulary, lambda bpe, v: bpe.encode(v), "string")


def decode(docs: DataFrame, vocabulary: str, ids_col: str = "token_ids", to: str = "decoded") -> DataFrame:
    """``docs``'s columns with ``to``: the tokens of space-joined ids, joined by one space. Null as empty."""
    return _append(docs, ids_col, to, vocabulary, lambda bpe, v: bpe.decode(v or ""), "string")


def digest(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every text, null as empty.

    Each text's ids are decoded again where they were made: one Python worker a task, and only digests
    leave it. Repeated rows repeat, other columns are not read.
    """
    picked = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = _shared(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _worker(shared.value)
        sha = lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            n, ids_sha, decoded_sha = [], [], []
            for v in batch.column(1):
                ids = bpe.encode(v.as_py())
                n.append(ids.count(" ") + 1 if ids else 0)
                ids_sha.append(sha(ids))
                decoded_sha.append(sha(bpe.decode(ids)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(picked.dtypes)["doc_id"]
    return picked.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
