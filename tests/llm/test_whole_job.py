"""Cases in which an operator once did less than its whole job."""

import gzip
import hashlib
import random
import time

from pyspark.sql import functions as F

from barloom.llm import nearcopies, warc

SF = "/root/testdata/sf0.001"


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def components(sets):
    """Smallest id of each id's component, by comparing all pairs."""
    comp, todo = {}, sorted(sets)
    for i in todo:
        if i in comp:
            continue
        comp[i], open_ = i, [i]
        while open_:
            x = open_.pop()
            for y in todo:
                if y not in comp and alike(sets[x], sets[y]):
                    comp[y] = i
                    open_.append(y)
    return comp


def test_near_copies_equal_brute_force(spark):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    draw = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    seal = draw.choices(words, k=60)
    for k in range(10):  # copies with some words changed, cut or added, about the threshold
        base = draw.choices(words, k=draw.randint(5, 300)) + seal * (k % 2)
        for c in range(8):
            w = list(base)
            for _ in range(draw.randint(0, 1 + len(w) // 40)):
                w[draw.randrange(len(w))] = draw.choice(words)
            rows[1000 + 10 * k + c] = " ".join(w[: len(w) - c % 3] + draw.choices(words, k=c % 2))
    rows |= {2000: None, 2001: "", 2002: " \n", 2003: "a b", 2004: "A  b", 2005: "a b c"}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    want = components({i: grams(t) for i, t in rows.items()})
    got = {r.doc_id: r.component_id for r in nearcopies.near_copies(df).collect()}
    assert got == want and len(set(want.values())) < len(rows) - 20
    odd = df.unionAll(spark.createDataFrame([(None, "a b"), (2005, "a b c"), (2006, "a B")], df.schema)).withColumn("node", F.lit("x"))
    kept = nearcopies.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(kept.where("doc_id >= 2000 or doc_id is null").collect(), key=str) == sorted([(2000, None, "x"), (2003, "a b", "x"), (2005, "a b c", "x"), (2005, "a b c", "x"), (None, "a b", "x")], key=str)
    assert nearcopies.near_copies(df.limit(0)).count() == 0


def test_pipeline_drops_near_copies_and_no_others(spark):
    import corpus_pipeline as p

    draw = random.Random(6)
    words = [f"v{i}" for i in range(5000)]
    base = draw.choices(words, k=400)
    near = base[:100] + ["new"] + base[101:200] + ["new"] + base[201:]
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(draw.choices(words, k=400)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in p.near_dedup(spark, docs, SF).collect()} == {1, 3}


def test_warc_two_texts_under_one_id(spark):
    rows = [(1, "a" * 1200), (1, "b" * 1300), (1, "short"), (2, "a" * 1200), (3, "b" * 1300), (4, "c" * 1100), (4, "a" * 1200)]
    df = spark.createDataFrame([(i, f"http://x/{i}", t) for i, t in rows], "page_id long, url string, html string")
    heads = {"a" * 1200: 4, "b" * 1300: 3, "c" * 1100: 4}
    want = sorted((i, len(t), hashlib.sha1(t.encode()).hexdigest(), "response" if heads.get(t, i) == i else "revisit", None if heads.get(t, i) == i else heads[t]) for i, t in rows)
    assert sorted(tuple(r) for r in warc.export_and_read(df).collect()) == want


def test_warc_salvage_within_members():
    body = [b"".join(hashlib.sha256(b"%d %d" % (i, k)).hexdigest().encode() for k in range(4000)) for i in range(6)]
    recs = [warc.record(i, f"http://x/{i}", b, hashlib.sha1(b).hexdigest(), None) for i, b in enumerate(body)]
    bad = list(recs)
    bad[2] = bad[2][:-50] + b"?" + bad[2][-49:]
    whole, tail = warc.member(b"".join(bad)), warc.member(warc.record(9, "u", b"t", hashlib.sha1(b"t").hexdigest(), None))
    got = list(warc.read_archive(whole + tail))
    assert [r["page_id"] for r in got if r["kind"] != "gap"] == [0, 1, 3, 4, 5, 9]
    assert [(r["offset"], r["length"]) for r in got if r["kind"] == "gap"] == [(0, 0)]
    one = warc.member(b"".join(recs))
    at = len(one) * 7 // 12
    for data in (one[:at], one[:at] + tail, b"junk" + one[:at] + b"\xff" * 40 + one[at + 40 :] + tail, one[:at] + one[:at]):
        got = list(warc.read_archive(data))
        ids = [r["page_id"] for r in got if r["kind"] != "gap"]
        assert {0, 1, 2} <= set(ids) and (9 in ids) == data.endswith(tail)
        gaps = [r for r in got if r["kind"] == "gap"]
        assert gaps and sum(g["length"] for g in gaps) + sum({r["offset"]: r["length"] for r in got if r["kind"] != "gap"}.values()) == len(data)


def test_warc_files_are_plain_archives(spark):
    """The files on disk are gzip members one after the other that any tool opens, also above 16 MB."""
    draw = random.Random(3)
    pages = [(i, f"http://x/{i}", draw.choice("abc") * draw.randint(0, 5000)) for i in range(200)] + [(900, "http://big", "z" * (17 << 20))]
    folder = warc.scratch_path(spark, "warc-test")
    files = warc.save_archives(warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), archive_bytes=4000), folder)
    got = files.collect()
    plain = [gzip.decompress(bytes(r.content)) for r in got]
    assert len(got) > 2 and all(p.startswith(b"WARC/1.1\r\n") for p in plain) and sum(p.count(b"WARC/1.1\r\n") for p in plain) == len(pages)
    back = warc.read_archives(files).where("kind = 'response'").select("page_id", F.octet_length("payload").alias("n")).collect()
    heads = {h: max(i for i, _, x in pages if x == h) for h in {x for _, _, x in pages if len(x) >= 1000}}
    assert {(r.page_id, r.n) for r in back} == {(i, len(h)) for i, _, h in pages if heads.get(h, i) == i}
    assert warc.read_archives(files).where("kind = 'gap'").count() == 0


def test_warc_reader_is_linear():
    """64 MB of small members, also behind a fault, are read in time that grows with the bytes."""
    rec = warc.member(warc.record(1, "u", b"p" * 40, hashlib.sha1(b"p" * 40).hexdigest(), None))
    took = []
    for n in (20_000, 80_000):
        data = b"\x1f\x8b\x08" + rec * n
        began = time.time()
        assert sum(r["kind"] == "response" for r in warc.read_archive(data)) == n
        took.append(time.time() - began)
    assert took[1] < 10 * took[0], took
