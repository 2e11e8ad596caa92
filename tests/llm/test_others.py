"""Classifiers, archives, decontamination, sharding, mixing and the pipeline, with odd rows."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinlink.llm import crf, decontam, labels, mixing, quality, queries, sharding, toxicity, warc
from kinlink.llm.scratch import fresh_path

SF = "/root/testdata/sf0.001"


def test_crf_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    m = crf.Model(np.zeros(1), rng.normal(size=(2, 2)), rng.normal(size=2))
    e = rng.normal(size=11) * 3
    starts = np.zeros(11, dtype=bool)
    starts[[0, 4, 5]] = True
    got = m.marginals(e, starts)
    for lo, hi in ((0, 4), (4, 5), (5, 11)):
        total, on = 0.0, np.zeros(hi - lo)
        for code in range(2 ** (hi - lo)):
            y = [(code >> k) & 1 for k in range(hi - lo)]
            s = m.first[y[0]] + sum(e[lo + k] * y[k] for k in range(hi - lo)) + sum(m.trans[a, b] for a, b in zip(y, y[1:], strict=False))
            total += np.exp(s)
            on += np.exp(s) * np.array(y)
        assert np.allclose(got[lo:hi], on / total)
    assert len(m.marginals(np.zeros(0), np.zeros(0, dtype=bool))) == 0


def test_fit_raises_the_likelihood_of_its_labels():
    rng = np.random.default_rng(1)
    f = rng.integers(0, 5, 400)
    y = (f > 2).astype(float)
    starts = np.arange(400) % 20 == 0
    m = crf.fit(lambda w: w[f], lambda g: np.bincount(f, weights=g, minlength=5), 5, starts, y, steps=80)
    assert ((m.marginals(m.weights[f], starts) > 0.5) == (y > 0)).mean() > 0.99


def labelled(spark, n=240):
    r = random.Random(1)
    docs, marks = [], []
    for i in range(n):
        w = [f"w{r.randint(0, 300)}" for _ in range(r.randint(5, 60))]
        toxic, bad = i % 5 == 0, i % 4 == 0
        if toxic:
            for _ in range(3):
                w.insert(r.randint(0, len(w)), r.choice(["idiot", "moronic", "scumbag"]))
        lines = [" ".join(w[k : k + 10]) for k in range(0, len(w), 10)]
        if bad:
            lines = [x.upper().replace(" ", "!! ") for x in lines]
        docs.append((i, "\n".join(lines), "en", "s"))
        marks.append((i, int(not bad), int(toxic)))
    docs += [(n, None, None, None), (n + 1, "", "en", None), (None, "fine words here", "en", "s"), (n + 2, "idiot " * 20000, "en", "s"), (n + 3, "x" * 300000, "en", "s")]
    return spark.createDataFrame(docs, "doc_id long, text string, score string, held_out string"), spark.createDataFrame(marks + [(n, None, None)], "doc_id long, quality int, toxic int")


def test_held_out_fold(spark):
    got = spark.range(50).select("id", labels.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def test_toxicity(spark):
    docs, marks = labelled(spark)
    rows = {r["doc_id"]: r for r in toxicity.detect(docs, marks).collect()}
    truth = {r["doc_id"]: r["toxic"] for r in marks.collect() if r["toxic"] is not None}
    held = [i for i in truth if rows[i]["held_out"]]
    assert held and np.mean([rows[i]["predicted"] == truth[i] for i in held]) > 0.95
    assert rows[240]["predicted"] == rows[241]["predicted"] == rows[None]["predicted"] == 0 and rows[242]["predicted"] == 1
    assert rows[None]["held_out"] and all(0 <= r["score"] <= 1 for r in rows.values())
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for i in held:
        for a, b in rows[i]["spans"]:
            assert re.search("idiot|moron|scum", text[i].encode()[a:b].decode().lower())


def test_labels_of_the_held_out_fold_are_not_learned_from(spark):
    docs, marks = labelled(spark)
    other = marks.withColumn("toxic", F.when(labels.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.detect(docs, m).collect()} for m in (marks, other))
    assert one == two


def test_without_labels(spark):
    docs, marks = labelled(spark)
    assert {r["score"] for r in toxicity.detect(docs, marks.limit(0)).collect()} == {0.0}
    assert {r["score"] for r in quality.assess(docs, marks.limit(0)).collect()} == {1.0}
    assert toxicity.detect(docs.limit(0), marks).count() == 0 and quality.keep_good(docs.limit(0), marks).count() == 0


def test_quality(spark):
    docs, marks = labelled(spark)
    rows = {r["doc_id"]: r for r in quality.assess(docs, marks).collect()}
    truth = {r["doc_id"]: r["quality"] for r in marks.collect() if r["quality"] is not None}
    held = [i for i in truth if rows[i]["held_out"]]
    assert np.mean([rows[i]["predicted"] == truth[i] for i in held]) > 0.95
    kept = quality.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in rows.items() if r["predicted"]}


def archive_rows(rows):
    groups = collections.defaultdict(list)
    for p, h in rows:
        groups[(h or "").encode()].append(p)
    out = []
    for k, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x if x is not None else 0))
        digest = base64.b32encode(hashlib.sha1(k).digest()).decode()
        out += [repr((p, len(k), digest, "revisit" if i else "response", ids[0] if i else None)) for i, p in enumerate(ids)]
    return sorted(out)


def test_archives_with_magic_inside_payloads(spark):
    fake = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:kinlink:page:99>\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\n"
    html = ["a", "", None, "x" + fake + "y", fake * 3, "WARC/1.1\r\n", "é" * 50, "a", "\r\n\r\n", fake + "WARC/1.1\r\nfoo", "WAWARC/1.1\r\n", "z" * 200000]
    pages = [(i, None if i % 3 else f"http://x/{i}\r\n", h, 1) for i, h in enumerate(html * 4)] + [(None, None, "a", 1), (3, "u", "zz", 1), (3, "u", "zz", 1)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, digest int").coalesce(3)
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")  # splits fall inside records and magic lines
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        path = fresh_path(spark, "warc")
        got = warc.roundtrip(df, path)
        rows = sorted(repr(tuple(r)) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())
        assert rows == archive_rows([(p, h) for p, _, h, _ in pages])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    whole = {bytes(r["payload"]) for r in warc.read_warc(spark, path, payloads=True).where("record_type = 'response'").collect()}
    assert whole == {(h or "").encode() for _, _, h, _ in pages}
    small = warc.plan_records(df, min_bytes=5).where("length(html) < 5").collect()
    assert {r["record_type"] for r in small} == {"response"}


def test_archives_with_text_ids(spark):
    pages = [("b>\n é", None, "x"), ("a", None, "x"), ("", "u", "y"), (None, "u", "y"), ("null", "u", "")]
    df = spark.createDataFrame(pages, "page_id string, url string, html string")
    got = warc.roundtrip(df, fresh_path(spark, "warc"))
    assert sorted(map(repr, (tuple(r) for r in got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()))) == archive_rows([(p, h) for p, _, h in pages])


def test_records_across_many_splits(spark):
    """One archive in many splits: pointer jumping joins the runs of the splits; candidates off the chain stay out."""
    fake = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = [(i, None, ("p" * (i % 37) + fake) if i % 5 == 0 else str(i) * 9) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1500")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        path = fresh_path(spark, "warc")
        got = warc.roundtrip(df, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
        assert sorted(repr(tuple(r)) for r in got) == archive_rows([(p, h) for p, _, h in pages])
        assert warc._candidates(spark, path).select("split").distinct().count() > 30
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def decontaminated(docs, items, size=13):
    words = lambda x: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x or "").encode().lower())
    wins = collections.defaultdict(set)
    for i, x in items:
        w = words(x)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            wins[tuple(w[k : k + size])].add(i)
    out = []
    for d, x in docs:
        w = words(x)
        mask, found = bytearray(len(w)), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                t = tuple(w[k : k + n])
                if t in wins:
                    mask[k : k + n] = b"\1" * n
                    found |= wins[t]
        out.append(repr((d, len(w), sum(mask), sorted(map(str, found)))))
    return sorted(out)


@pytest.mark.parametrize("block", [10**6, 60])
def test_decontamination(spark, block):
    r = random.Random(4)
    vocab = ["The", "a", "of"] * 20 + [f"Wört{i}" for i in range(50)]
    items = [(i, ", ".join(r.choice(vocab) for _ in range(n))) for i, n in enumerate([40, 13, 14, 5, 1, 20])] + [(7, None), (8, ""), (9, "THE a"), (9, "THE a")]
    docs = []
    for i in range(60):
        w = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        if i % 3 == 0:
            x = (r.choice(items)[1] or "").split(", ")
            k = r.randint(0, max(0, len(x) - 13))
            w[len(w) // 2 : len(w) // 2] = x[k : k + 20]
        docs.append((i, " - ".join(w)))
    docs += [(61, None), (62, ""), (63, items[0][1].upper()), (63, items[0][1].upper()), (None, items[1][1]), (64, "the a of " * 20000)]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, terms int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.phrase_matches(df, bench, block_words=block).collect()
    assert sorted(repr((x["doc_id"], x["n_words"], x["n_hit"], x["items"])) for x in got) == decontaminated(docs, items)
    for x in got:
        span = np.frombuffer(bytes(x["spans"]), dtype=np.uint32).reshape(-1, 2)
        assert int((span[:, 1] - span[:, 0]).sum()) == x["n_hit"]
    clean = decontam.keep_clean(df, bench, block_words=block)
    bad = {(x["doc_id"]) for x in got if x["n_hit"] and 20 * x["n_hit"] >= x["n_words"]}
    assert clean.columns == df.columns and {x["doc_id"] for x in clean.collect()} == {d for d, _ in docs} - bad
    assert decontam.keep_clean(df, bench.limit(0)).count() == len(docs) and decontam.phrase_matches(df.limit(0), bench).count() == 0


def test_proximity(spark):
    df = spark.createDataFrame([(1, "x rare1 y y rare2 z rare3 rare1"), (2, "rare1 " + "y " * 50 + "rare2 rare3"), (3, None), (4, "rare3"), (4, "rare1 rare2")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "rare3 rare1 rare2"), (6, "nowhere rare1"), (7, None), (8, "z z")], "item_id long, text string")
    got = lambda n: sorted((r["doc_id"], r["item_id"], r["position"]) for r in decontam.proximity_matches(df, items, within=n).collect())
    # three documents have each of the three terms, so the first of the item leads
    assert got(10) == [(1, "5", 6), (1, "8", 5)] and got(60) == [(1, "5", 6), (1, "8", 5), (2, "5", 52)]
    assert got(1) == [(1, "8", 5)]


def test_sharding(spark):
    r = random.Random(3)
    docs = [(i, "x" * r.randint(0, 400), 1) for i in range(500)] + [(600, None, 1), (None, "abc", 1), (601, "y" * 5000, 1)] + [(700, "z" * 100, 1)] * 80
    df = spark.createDataFrame(docs, "doc_id long, text string, shard_id int")
    limit = 2000
    out = sharding.shard(df, "doc_id", "text", limit)
    rows = out.collect()
    assert len(rows) == len(docs) and out.columns == ["doc_id", "text", "shard_id", "shard_depth", "row_bytes"]
    size = collections.Counter()
    members = collections.defaultdict(list)
    for x in rows:
        size[x["shard_id"]] += x["row_bytes"]
        members[x["shard_id"]].append(x["doc_id"])
    assert all(n <= limit or len(members[s]) == 1 for s, n in size.items())
    # only oversized buckets were split: the parent of every bucket is too large
    digest = lambda d: int(hashlib.md5((b"\\N" if d is None else str(d).encode())).hexdigest()[:15], 16)
    for x in rows:
        if 0 < x["shard_depth"] < sharding.HASH_BITS:
            up = digest(x["doc_id"]) >> (60 - x["shard_depth"] + 1)
            assert sum(len((t or "").encode()) for d, t, _ in docs if digest(d) >> (60 - x["shard_depth"] + 1) == up) > limit
    again = {(x["doc_id"], x["shard_id"]) for x in sharding.shard(df.where("doc_id <> 700"), "doc_id", "text", limit).collect()}
    assert len(again) == 502 and sharding.shard(df.limit(0), "doc_id", "text", limit).count() == 0
    assert sharding.shard(df, "doc_id", "text", 10**9).select("shard_id").distinct().count() == 1


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = share * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while free:
        total = sum(w[s] for s in free)
        over = {s for s in free if left * w[s] / total >= cap * sizes[s]}
        if not over:
            out |= {s: left * w[s] / total for s in free}
            break
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mixing(spark):
    r = random.Random(6)
    docs = []
    for s, n in (("b", 200), ("a", 30), ("é", 5), (None, 12), ("zero", 3), ("one", 1)):
        docs += [(len(docs), " \n".join(["w"] * (0 if s == "zero" else 90 if s == "one" else r.randint(0, 40))), s, 1) for _ in range(n)]
    docs += [(1000, None, "b", 1), (1001, " \t", "a", 1), (1002, "q q", "a", 1), (1002, "q q", "a", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size int")
    recipe = mixing.Recipe(block_rows=10, shards=4)
    rows = mixing.assign(df, "text", "source", "doc_id", recipe).collect()
    sizes = collections.Counter()
    for _, t, s, _ in docs:
        sizes[s] += len((t or "").split())
    goal = brute_targets(sizes)
    assert len(rows) == len(docs)
    taken = collections.Counter()
    for x in rows:
        taken[x["source"]] += x["taken"]
        assert 0 <= x["taken"] <= 2 * x["size"] and x["source_size"] == sizes[x["source"]] and abs(x["target"] - goal[x["source"]]) < 1e-6
        assert len(x["shards"]) == (-(-x["taken"] // x["size"]) if x["size"] else 0)
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    again = mixing.assign(df.repartition(3), "text", "source", "doc_id", recipe).collect()
    key = lambda x: repr((x["doc_id"], x["taken"], x["shards"]))
    assert sorted(map(key, rows)) == sorted(map(key, again))
    copies = mixing.mix(df, "text", "source", "doc_id", recipe)
    words = collections.Counter()
    for x in copies.collect():
        words[x["source"]] += len(x["text"].split())
    assert +words == +taken and copies.columns == [*df.columns, "shard"]
    assert mixing.assign(df.limit(0), "text", "source", "doc_id").count() == 0


def test_splitting_tree_is_exact():
    q = mixing.split_quotas([100, 7, 0, 1], 8, 3)
    assert q.sum(axis=0).tolist() == [100, 7, 0, 1] and q.sum(axis=1).max() - q.sum(axis=1).min() <= 3
    assert (q == mixing.split_quotas([100, 7, 0, 1], 8, 3)).all()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, path = docs, fresh_path(spark, "stage")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == names
        if k < 3:
            assert docs.join(before, "doc_id", "left_anti").isEmpty() and docs.select("doc_id").distinct().count() == counts[-1]
        if k == 2:
            items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
            judged = decontaminated([(r["doc_id"], r["text"]) for r in before.collect()], [tuple(r) for r in items])
            bad = set()
            for x in judged:
                d, n, hit, _ = eval(x)
                if hit and 20 * hit >= n:
                    bad.add(d)
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - bad
    assert counts[0] > counts[1] > counts[2] >= counts[3] and counts[4] == counts[5]
    assert "shard_id" in docs.columns and len(queries.queries()) == 10


def test_one_index_serves_any_test_set(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "x a b"), (3, None)], "doc_id long, text string")
    path = fresh_path(spark, "index")
    decontam.build_index(docs, "doc_id", "text").write.parquet(path)
    index = spark.read.parquet(path)
    for items in ([(4, "a b"), (5, "b c d")], [(6, "x")], [(7, "zz a")]):
        bench = spark.createDataFrame(items, "item_id long, text string")
        one = sorted(repr(tuple(x)[2:]) for x in decontam.phrase_matches(docs, bench, index=index).collect())
        assert one == sorted(repr(tuple(x)[2:]) for x in decontam.phrase_matches(docs, bench).collect())
    assert {x["doc_id"]: x["items"] for x in decontam.phrase_matches(docs, spark.createDataFrame([(6, "x")], "item_id long, text string"), index=index).collect()} == {1: [], 2: ["6"], 3: []}


def test_terms_that_agree_in_leading_bits():
    h = np.array([5 << 40, (5 << 40) + 1, 5 << 40, 7, (5 << 40) + 1], dtype=np.uint64)
    t, place = decontam._by_term(h, np.array([0, 1, 2, 3, 2**20], dtype=np.int64))
    assert t.tolist() == sorted(h.tolist()) and place.tolist() == [3, 0, 2, 1, 2**20]
