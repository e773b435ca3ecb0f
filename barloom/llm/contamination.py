"""Passages of benchmark items in documents: a prefix-filtered set join of word shingles.

An item's windows are its runs of ``width`` words (a shorter item is one window), and a window's tokens
are its shingles. A document contains a window only if it has every token of it at one distance from
another, so one token is enough to find the candidates: each window's rarest, counted over all documents.
The steps are joins and aggregations on words' shingles, without Python:

1. ``benchmark_windows``: different windows, their tokens, and a dictionary of different shingles;
2. ``shingle_places``: where documents have shingles of the dictionary, in one pass over the texts;
3. ``rarest_tokens``: tokens ordered by their count in documents; windows with an absent token go;
4. ``window_places``: places of the rarest token, bounded by position and length, then verified on the
   tokens that cover the window's words, which makes the comparison of the words exact.

Different windows are handled once, however many items share them, and what leaves the texts is a row for
each place of a benchmark shingle: linear in the documents, whatever passage they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, release

#: What parts words, once A-Z are lower-cased and before: all of ASCII but letters and digits.
GAPS, ANY_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Words in a window and in a shingle.
WIDTH, SHINGLE = 10, 5
#: The dictionary, and a table of windows, is broadcast up to so many rows (some 60 MB); beyond, it is joined by shuffle.
BROADCAST_ROWS = 500_000
#: What tells documents apart: the id and a hash of the text, so that rows that repeat an id with another text stay apart.
KEY = ["doc", "digest"]


def words_of(text: Column, gaps: str = GAPS) -> Column:
    """The words of a text; none for null. Splitting at gaps takes a quarter of the time of extracting words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), gaps), "")


def shingle_at(words: str | Column, pos: Column, size: int) -> Column:
    """The ``size`` words from ``pos`` on, joined by spaces; null where the text ends before."""
    words = F.col(words) if isinstance(words, str) else words
    joined = F.concat_ws(" ", *(F.get(words, pos + k) for k in range(size)))
    return F.when(pos + size <= F.size(words), joined)


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its counted rows allow."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, width: int, shingle: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, tokens, dictionary): (window, item), (window, length, pos, id) and (id, shingle, size), written to the shared folder.

    window numbers the different windows. A token is a shingle of ``shingle`` words, or all words of a shorter window.
    """
    items = items.select(F.col(item_col).cast("string").alias("item"), words_of(ascii_lower(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))
    runs = items.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, width))).alias("w"))
    runs = materialize(runs.select(F.concat_ws(" ", "w").alias("words"), "item", "w").distinct(), "runs")
    windows = materialize(runs.select("words", "w").distinct().select(F.monotonically_increasing_id().alias("window"), "words", "w"), "windows")
    members = materialize(runs.join(windows.drop("w"), "words").select("window", "item"), "window-items")
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - shingle, F.lit(0)))
    split = windows.select("window", "words", "w", F.size("w").alias("length"), F.explode(starts).alias("pos"))
    split = materialize(split.select("window", "length", "pos", F.when(F.col("length") > shingle, shingle_at("w", F.col("pos"), shingle)).otherwise(F.col("words")).alias("shingle")), "window-shingles")
    dictionary = split.select("shingle", F.least("length", F.lit(shingle)).alias("size")).distinct()
    dictionary = materialize(dictionary.select(F.monotonically_increasing_id().alias("id"), "shingle", "size"), "shingles")
    tokens = materialize(split.join(dictionary.drop("size"), "shingle").select("window", "length", "pos", "id"), "tokens")
    for done in (runs, windows, split):
        release(done)
    return members, tokens, dictionary


def shingle_places(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(doc, digest, n_words, pos, id) of each place of a shingle of the dictionary; docs has doc, digest and words ``w``."""
    sizes = sorted(r[0] for r in dictionary.select("size").distinct().collect()) or [1]  # at most SHINGLE numbers
    # An outer generator: for an inner one Spark adds a filter that splits all texts a second time. Words stay in
    # one stage of generated code, so that the array is not copied for its places.
    rows = docs.select(*KEY, "w", F.size("w").alias("n_words"), F.posexplode_outer("w").alias("pos", "word"))
    if len(sizes) == 1:
        rows = rows.select(*KEY, "n_words", "pos", shingle_at("w", F.col("pos"), sizes[0]).alias("shingle"))
    else:
        each = F.array(*(shingle_at("w", F.col("pos"), n) for n in sizes))
        rows = rows.select(*KEY, "n_words", "pos", each.alias("each")).select(*KEY, "n_words", "pos", F.explode_outer("each").alias("shingle"))
    return rows.join(small(dictionary.drop("size")), "shingle").select(*KEY, "n_words", "pos", "id")


def rarest_tokens(tokens: DataFrame, places: DataFrame, shingle: int) -> DataFrame:
    """(window, length, pos, id, cover): each window's token that documents have least often, and the others that must be verified.

    Windows with a token that no document has cannot occur and go. Tokens at multiples of the shingle's width, and the last one,
    cover all words.
    """
    counts = materialize(places.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "shingle-counts")
    covers = (F.col("pos") % shingle == 0) | (F.col("pos") == F.col("length") - shingle)
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "pos", "id")).alias("t")
    cover = F.array_sort(F.collect_list(F.when(covers, F.struct(F.col("pos").alias("off"), "id")))).alias("cover")
    found = tokens.join(counts, "id", "left").groupBy("window", "length").agg(rarest, cover).where("t.n > 0")
    return found.select("window", "length", "t.pos", "t.id", F.filter("cover", lambda c: c["off"] != F.col("t.pos")).alias("cover"))


def window_places(places: DataFrame, tokens: DataFrame, shingle: int) -> DataFrame:
    """(doc, digest, window, start, stop) of each occurrence of a window, in word positions, stop exclusive."""
    rarest = materialize(rarest_tokens(tokens, places, shingle), "rarest")
    start = F.col("p.pos") - F.col("r.pos")
    candidates = places.alias("p").join(small(rarest).alias("r"), F.col("p.id") == F.col("r.id"))
    # Position: the window may not start before the text; length: it may not end after it.
    candidates = candidates.where((start >= 0) & (start + F.col("r.length") <= F.col("n_words")))
    candidates = candidates.select(*KEY, "window", start.alias("start"), (start + F.col("r.length")).alias("stop"), "cover")
    sure = candidates.where(F.size("cover") == 0).drop("cover")
    needed = candidates.select(*KEY, "window", "start", "stop", F.size("cover").alias("want"), F.inline("cover"))
    needed = needed.withColumn("pos", F.col("start") + F.col("off"))
    there = needed.join(places, _same(needed, places) & (needed["pos"] == places["pos"]) & (needed["id"] == places["id"]), "left_semi")
    whole = there.groupBy(*KEY, "window", "start", "stop", "want").agg(F.count_distinct("pos").alias("n")).where("n = want")
    return sure.unionByName(whole.drop("want", "n"))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a["doc"].eqNullSafe(b["doc"]) & (a["digest"] == b["digest"])


def covered(found: DataFrame) -> DataFrame:
    """(doc, digest, n_hit, spans): the words inside any occurrence, and the maximal runs of them."""
    order = Window.partitionBy(*KEY).orderBy("start", "stop")
    before = F.max("stop").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = found.select(*KEY, "start", "stop").distinct().withColumn("fresh", F.coalesce(F.col("start") > before, F.lit(True)).cast("int"))
    runs = rows.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*KEY, "run").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
    return runs.groupBy(*KEY).agg(F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"), F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("spans"))


def find_contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) of each row of ``docs``.

    n_hit counts the words inside any occurrence of a window, spans are their maximal runs (start, stop) in words, items
    the ids, sorted as strings, of the items that a window of the row belongs to. A null text has no words. Rows that
    repeat repeat their result. An item of no words has no window, a null item id hits but is not listed; no items, or
    no documents, give no hits. Other columns of ``docs`` and ``items`` are not read.
    """
    shingle = min(shingle, width)
    members, tokens, dictionary = benchmark_windows(items, item_col, item_text, width, shingle)
    keyed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("digest"), F.col(text_col).alias("text"))
    places = materialize(shingle_places(keyed.where("text is not null").select(*KEY, words_of(ascii_lower(F.col("text"))).alias("w")), dictionary), "shingle-places")
    found = materialize(window_places(places, tokens, shingle), "window-places")
    release(places)
    listed = found.select(*KEY, "window").distinct().join(members, "window").groupBy(*KEY).agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = covered(found)
    hits = materialize(hits.join(listed, _same(hits, listed), "left").select(*(hits[c] for c in (*KEY, "n_hit", "spans")), "items"), "hits")
    release(found)
    sizes = keyed.select(*KEY, F.size(words_of(F.col("text"), ANY_GAPS)).cast("long").alias("n_words"))
    out = sizes.join(hits, _same(sizes, hits), "left")
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return out.select(sizes["doc"].alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("spans", none).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))
