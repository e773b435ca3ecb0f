"""Divergence audit, decontamination and centroid clustering against plain loops and their SQL, with odd rows."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import centroids, contamination, divergence, queries

SF = "/root/testdata/sf0.001"
NAMES = ("op11_divergence", "op12_decontamination", "op13_centroids")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"create view {t[:-8]} as select * from '{SF}/{t}'")
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.execute(queries.SQL[name]).df()
    assert sorted(want.columns) == cols
    rows = lambda f: sorted(map(str, f[cols].astype(str).itertuples(index=False, name=None)))
    assert rows(got.toPandas()) == rows(want)


# Divergence audit


def audit(rows, least, top=50):
    """(lang, source, part, item, value, rank) by dictionaries and whole numbers."""
    terms = [(la or "", so or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(t))) for t, la, so in rows]
    docs, counts, total = Counter(), Counter(), Counter()
    for la, so, w in terms:
        docs.update((la, t) for t in set(w))
        counts.update((la, so, t) for t in w)
        total.update((la, t) for t in w)
    out = []
    for la in {t[0] for t in terms}:
        kept = [t for (k, t), n in docs.items() if k == la and n >= least]
        groups = sorted({so for k, so, _ in terms if k == la})
        p = lambda count, all_: 1 + 10**9 * (count + 5) // (all_ + 5 * len(kept))
        n = {so: sum(counts[la, so, t] for t in kept) for so in groups}
        q = {t: p(total[la, t], sum(total[la, x] for x in kept)) for t in kept}
        shares = {so: {t: p(counts[la, so, t], n[so]) for t in kept} for so in groups}
        for so in groups:
            pairs = [(sum(abs(shares[so][t] - shares[x][t]) for t in kept), x) for x in groups if x != so]
            own = [(shares[so][t] - q[t], t) for t in kept if counts[la, so, t] and shares[so][t] > q[t]]
            for part, values, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(values, key=lambda v: (-v[0], v[1].encode()))[:most]
                out += [(la, so, part, item, value, k + 1) for k, (value, item) in enumerate(ranked)]
    return sorted(out)


def test_divergence_equals_a_loop(spark, monkeypatch):
    draw = random.Random(5)
    vocabulary = ["Zug", "zug", "été", "naïve", "a", "ab", "abcdefgh", "abcdefghi", "abcdefghj", "中文", "x" * 40, "Ⅷ"]
    rows = [(" ".join(draw.choices(vocabulary, k=draw.randint(0, 12))) + draw.choice(["", ".", "\x00", "_9"]), draw.choice(["en", "de", None]), draw.choice(["s0", "s0", "s1", None])) for _ in range(150)]
    rows += [(None, "en", "s9"), ("", "fr", "s0"), ("?!", "fr", "s1"), ("rare words", "it", "s0"), ("y" * 70_000 + " a" * 9000, "en", "s0"), ("a a", "en", "s1"), ("a a", "en", "s1")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(5).withColumns({c: F.lit("q") for c in ("term", "n", "p", "total", "part", "rank", "slot", "block")})
    want = audit(rows, 4)
    assert any(r[2] == "term" for r in want) and any(r[:2] == ("en", "s9") for r in want)
    for group_rows, sources, size in ((50_000, 256, 8 << 20), (3, 2, 64)):
        monkeypatch.setattr(divergence, "GROUP_ROWS", group_rows)
        monkeypatch.setattr(divergence, "GROUP_SOURCES", sources)
        monkeypatch.setattr(divergence, "SLICE_BYTES", size)
        assert sorted(map(tuple, divergence.divergence(df, least_docs=4).collect())) == want
    assert sorted(map(tuple, divergence.divergence(df, least_docs=10**6).collect())) == audit(rows, 10**6)  # no term is kept: distances of 0
    assert divergence.divergence(df.limit(0)).count() == 0


@pytest.mark.parametrize("cutoff", [1, 7, 1 << 16])
def test_pointer_sort_orders_words_and_keeps_equal_ones_in_place(cutoff):
    draw = random.Random(2)
    for _ in range(60):
        words = ["".join(draw.choices("abÿ", k=draw.randint(1, draw.choice([3, 9, 30])))) for _ in range(draw.randint(0, 200))] + ["same" * 10] * draw.randint(0, 9)
        draw.shuffle(words)
        texts, offsets = b"", [0]
        for w in words:  # some words are texts of their own, so that texts meet without a byte between them
            texts += (b"\x00" if draw.random() < 0.5 else b"") + w.encode()
            offsets.append(len(texts)) if draw.random() < 0.3 else None
            if offsets[-1] != len(texts):
                texts += b"\x00"
        offsets.append(len(texts))
        data = np.frombuffer(texts, np.uint8)
        start, length, text = divergence.word_pointers(data, np.array(offsets))
        found = [texts[s : s + n] for s, n in zip(start, length, strict=True)]
        assert found == [w.encode() for w in words]
        assert all(offsets[t] <= s < offsets[t + 1] for s, t in zip(start, text, strict=True))
        order, first = divergence.sort_pointers(data, start, length, cutoff)
        assert order.tolist() == sorted(range(len(words)), key=lambda k: (found[k], k))
        assert first.tolist() == [k for k in range(len(order)) if k == 0 or found[order[k]] != found[order[k - 1]]]


def test_shares_stay_exact_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**13, 3 * 10**13 + 7, 11)], "n long, total long, terms long")
    got = row.select(divergence.share(F.col("n"), F.col("total"), F.col("terms"))).first()[0]
    assert got == 1 + 10**9 * (10**13 + 5) // (3 * 10**13 + 7 + 55)


# Decontamination


def windows_hit(docs, items, width):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    runs = defaultdict(set)
    for i, t in items:
        w = words(t)
        for at in range(max(1, len(w) - width + 1) if w else 0):
            runs[tuple(w[at : at + width])].add(i)
    sizes, out = {len(r) for r in runs}, []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for n in sizes:
            for at in range(len(w) - n + 1):
                if found := runs.get(tuple(w[at : at + n])):
                    hit.update(range(at, at + n))
                    ids |= {str(i) for i in found if i is not None}
        spans = [[p, p + 1] for p in sorted(hit)]
        merged = []
        for a, b in spans:
            merged.append([a, b]) if not merged or merged[-1][1] < a else merged[-1].__setitem__(1, b)
        out.append((d, len(w), len(hit), merged, sorted(ids)))
    return sorted(out, key=str)


def joined(spans):
    """Spans that touch are one run of words."""
    out = []
    for a, b in spans:
        out.append([a, b]) if not out or out[-1][1] < a else out[-1].__setitem__(1, b)
    return out


def test_decontamination_equals_a_loop(spark):
    draw = random.Random(7)
    letters = ["a", "B", "é", "zz", "9x"]
    some = lambda n: " ".join(draw.choices(letters, k=n))  # noqa: E731  few words, so that windows overlap, repeat and share tokens
    items = [(i, some(draw.randint(0, 25))) for i in range(12)] + [(20, "B"), (21, "b é"), (22, None), (23, ""), (24, "--"), (None, some(11)), (3, "twice known"), (25, "twice known")]
    docs = [(i, some(draw.randint(0, 60)) + draw.choice(["", " " + (items[i % 12][1] or ""), ", " + items[3][1].upper()])) for i in range(80)]
    docs += [(100, None), (101, ""), (102, "!"), (103, "TWICE-known"), (7, "another text of an id"), (103, "TWICE-known"), (None, items[4][1]), (104, ("a " * 20_000) + items[5][1] + " é" * 20_000), (105, "aB" * 30_000)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumns({c: F.lit("q") for c in ("doc", "digest", "pos", "id", "w", "window", "start", "items", "n_hit")})
    i = spark.createDataFrame(items, "item_id long, text string").withColumns({c: F.lit("q") for c in ("item", "w", "words", "doc_id")})
    for width, shingle in ((10, 5), (10, 3), (4, 9)):
        got = [(r.doc_id, r.n_words, r.n_hit, joined([list(s) for s in r.spans]), r["items"]) for r in contamination.find_contamination(d, i, width, shingle).collect()]
        assert sorted(got, key=str) == windows_hit(docs, items, width)
    none = contamination.find_contamination(d, i.limit(0)).collect()
    assert len(none) == len(docs) and not any(r.n_hit for r in none)
    assert contamination.find_contamination(d.limit(0), i).count() == 0


def test_decontamination_runs_in_the_jvm_and_joins_beyond_the_broadcast(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    once = contamination.find_contamination(docs, items)
    assert not re.search("Python|Arrow|Pandas", once._jdf.queryExecution().executedPlan().toString())
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", 0)
    assert sorted(map(str, once.collect())) == sorted(map(str, contamination.find_contamination(docs, items).collect()))
    assert once.where("n_hit > 0").count() > 0


# Centroid clustering


def lloyd(rows, k=5, rounds=3, dims=4):
    kept = [(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    mark = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~"
    cs = [v for _, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))[:k]]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((gap(v, c), n) for n, c in enumerate(cs))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, v in kept:
            own[near(v)[1]].append(v)
        cs = [tuple(sum(x) // len(own[n]) for x in zip(*own[n], strict=True)) if n in own else c for n, c in enumerate(cs)]
    placed = [(i, *near(v)[::-1]) for i, v in kept]
    by = Counter()
    for _, c, d in placed:
        by[c] += d
    return sorted(((i, c, d, by[c], sum(by.values()), list(cs[c])) for i, c, d in placed), key=str)


def test_clusters_equal_a_loop(spark):
    draw = np.random.default_rng(4)
    rows = [(n, [float(np.float32(x)) for x in draw.normal(draw.integers(0, 3), 0.3, 4)]) for n in range(300)]
    rows += [(n, [0.5, 0.5, 0.5, -0.5]) for n in range(300, 330)] + [(300, [0.5, 0.5, 0.5, -0.5])]  # ties and repeated rows
    rows += [(400, None), (401, []), (402, [1.0, 2.0, 3.0]), (403, [1.0, None, 0.0, 0.0]), (404, [float("nan"), 0.0, 0.0, 0.0]), (405, [float("-inf"), 0.0, 0.0, 0.0]), (None, [0.1, 0.2, 0.3, 0.4])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).withColumns({c: F.lit("q") for c in ("cluster", "v", "far", "distance", "mark")})
    got = lambda d, **o: sorted((tuple(r) for r in centroids.cluster(d, dims=4, **o).collect()), key=str)
    assert got(df, k=5, rounds=3) == lloyd(rows)
    few = [(1, [0.0, 0.0, 0.0, 1.0]), (2, [0.0, 0.0, 0.0, 1.0])]
    assert got(spark.createDataFrame(few, df.select("vec_id", "embedding").schema), k=5, rounds=2) == lloyd(few, rounds=2)  # a cluster that stays empty
    assert got(df.limit(0), k=5) == [] and got(df.where("vec_id = 400"), k=5) == []
    with pytest.raises(Exception, match="beyond"):
        got(spark.createDataFrame([(1, [1e9, 0.0, 0.0, 0.0])], df.select("vec_id", "embedding").schema), k=1)


@pytest.mark.parametrize("spread", [1, 40, 1 << 26])
def test_bounds_stay_below_distances_and_spare_most_of_them(spread):
    draw = np.random.default_rng(spread)
    means = draw.integers(-spread, spread + 1, (12, 8))
    v = means[draw.integers(0, 12, 3000)] + draw.integers(-max(1, spread // 20), max(2, spread // 20 + 1), (3000, 8))
    v = np.concatenate([v, means, np.zeros((1, 8), np.int64), np.arange(4)[:, None] * np.ones((1, 8), np.int64)])
    pivots = centroids.pivots_of(means, 6)
    to_x = np.sqrt(centroids._squares(v, pivots))
    exact = centroids._squares(v, means)
    low = centroids.lower_bounds(to_x, np.sqrt(centroids._squares(means, pivots)), np.sqrt(centroids._squares(pivots, pivots)))
    assert (low * low * (1 - centroids.SLACK) <= exact * (1 + centroids.SLACK)).all()
    cluster, distance, measured = centroids.nearest(v, to_x, means, pivots)
    assert (cluster == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()
    assert spread == 1 or measured < 0.5 * exact.size
