import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkfall.llm import audio, bpe, common, embed_dup, html_text, license_scan, mixing, near_dup, quality, sharding, url_filter
from inkfall.llm.registry import ORACLES, QUERIES

DOCS = "doc_id long, text string, source string, lang string, n_chars long, DOC_ID string, text_crc32 string, spell string, bucket int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with those that the operators use."""
    return spark.createDataFrame([(i, t, s, None, None, "x", "y", None, 1) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(1)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(500)) for _ in range(30_000))
    rows = [(1, None, "a"), (2, "", "a"), (3, "   \n ", None), (4, long, "b"), (5, long, "b"), (5, long, "b"), (6, "one two", ""), (7, "one two", "a"), (None, "lost id", "c"), (8, "x" * 5000, "a"), (9, "é̀ 中文   ß", None)]
    return docs(spark, rows)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, duck, small, name):
    from compare import duck_rows, spark_rows

    assert spark_rows(QUERIES[name](spark, small)) == duck_rows(duck, ORACLES[name])


# 1


def test_cascade_is_exact(spark):
    rng = random.Random(3)
    keys = [f"k{rng.randrange(10**9)}" for _ in range(4000)]
    listed = set(keys[:600])
    universe = spark.createDataFrame([(k, k in listed) for k in set(keys)], "key string, listed boolean")
    cascade = url_filter.build_cascade(universe)
    assert len(cascade.levels) > 2 and cascade.n_bytes < 4000
    got = universe.select("listed", cascade.contains(F.col("key")).alias("found")).where("listed <> found").count()
    assert got == 0
    assert url_filter.build_cascade(universe, max_bytes=8) is None
    assert url_filter.build_cascade(universe.where("false")).levels == []


@pytest.mark.parametrize("slice_bytes", [64, 1 << 20])
def test_a_cascade_in_slices_is_exact(spark, slice_bytes):
    rng = random.Random(3)
    keys = [f"k{rng.randrange(10**9)}" for _ in range(3000)]
    listed = set(keys[:500])
    universe = spark.createDataFrame([(k, k in listed) for k in set(keys)], "key string, listed boolean")
    assert {r.key for r in url_filter.listed_keys(universe, slice_bytes).collect()} == listed
    assert url_filter.listed_keys(universe.where("NOT listed")).count() == 0 and url_filter.listed_keys(universe.where("listed")).count() == len(listed)


def test_a_table_of_listed_hosts(spark):
    """With nulls, repeated keys and columns whose names clash."""
    pages = spark.createDataFrame([(i, f"http://h{i % 40}.org/x", "k") for i in range(80)], "page_id long, url string, key string")
    listed = spark.createDataFrame([("h3.org", 1, "a"), ("h3.org", 2, "b"), (None, 3, "c"), ("h17.org", 4, "d"), ("elsewhere.net", 5, "e")], "key string, page_id int, KEY string")
    for limit in (url_filter.MAX_BYTES, 1):
        got = {r.page_id for r in url_filter.filter_urls(pages, listed=listed, max_bytes=limit).where("is_listed").collect()}
        assert got == {3, 43, 17, 57}
        assert url_filter.filter_urls(pages, listed=listed.where("false"), max_bytes=limit).where("is_listed").count() == 0


def test_urls(spark):
    urls = ["http://Www.Example.COM/en/1?x", "https://a.example.com/en/", "http://b.net/es/1", "http://b.net/de", "http://x.com", "http://x.com/", "no scheme", None, "", "://", "http://casino-win.example.org/x", "http://m.casino-win.example.org", "ftp://a.b//c#d"]
    pages = spark.createDataFrame([(i, u, "h", "H") for i, u in enumerate(urls)], "page_id long, url string, host string, HOST string")
    for limit in (url_filter.MAX_BYTES, 1):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, max_bytes=limit).collect()}
        assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
        assert got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
        assert got[2] == ("b.net", "/es/1", "net/es/", "block") and got[3] == ("b.net", "/de", None, "allow")
        assert got[4] == ("x.com", "", None, "allow") and got[5] == ("x.com", "/", "com/", "allow")
        assert got[6] == got[7] == got[8] == got[9] == ("", "", None, "allow")
        assert got[10][3] == got[11][3] == "block" and got[12] == ("a.b", "//c", None, "allow")
    assert url_filter.filter_urls(pages.where("false")).count() == 0


# 2


def bag(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute_classes(texts):
    """{id: least id reachable} by comparing all pairs."""
    bags = {i: bag(t) for i, t in texts.items()}
    top = {i: i for i in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in bags:
        for b in bags:
            if a < b and bags[a] and bags[b]:
                both = sum((bags[a] & bags[b]).values())
                if both >= 0.8 * (sum(bags[a].values()) + sum(bags[b].values()) - both) - 1e-9:
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def near_texts(seed, n):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out = {}
    while len(out) < n:
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 60, 150]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out[len(out)] = " ".join(copy + copy[:20] * rng.choice([0, 0, 1]))
    return out


def test_estimate_is_unbiased():
    rng = random.Random(5)
    a = [f"w{rng.randrange(900)}" for _ in range(300)]
    b = a[:220] + a[:40] + [f"v{i}" for i in range(40)]
    owner, element, count = near_dup.shingles([" ".join(a), " ".join(b)])
    s = near_dup.bagminhash(owner, element, count, 2, 4000)
    both = sum((bag(" ".join(a)) & bag(" ".join(b))).values())
    want = both / (sum(bag(" ".join(a)).values()) + sum(bag(" ".join(b)).values()) - both)
    assert abs((s[0] == s[1]).mean() - want) < 0.03


def test_weights_count():
    """Multisets {x: 3} and {x: 1} overlap by a third."""
    s = near_dup.bagminhash(np.array([0, 1]), np.array([9, 9], dtype=np.uint64), np.array([3, 1]), 2, 3000)
    assert abs((s[0] == s[1]).mean() - 1 / 3) < 0.04


def test_classes_equal_brute_force(spark):
    texts = near_texts(7, 160)
    got = {r.doc_id: r.class_id for r in near_dup.near_classes(docs(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert got == brute_classes(texts)


def test_a_chain_across_a_large_bucket(spark):
    """Copies that are like their original but not like one another still are one class."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(400)]
    texts = {0: " ".join(base)}
    for i in range(1, 40):
        copy = list(base)
        for k in rng.sample(range(400), 9):
            copy[k] = f"new{i}_{k}"
        texts[i] = " ".join(copy)
    order = {i: (i + 17) % 40 for i in texts}
    texts = {order[i]: t for i, t in texts.items()}
    got = {r.doc_id: r.class_id for r in near_dup.near_classes(docs(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    assert got == brute_classes(texts)


def test_near_dup_odd_rows(spark, odd, empty):
    got = sorted((str(r.doc_id), r.class_id) for r in near_dup.near_classes(odd).collect())
    assert got == sorted([("1", 1), ("2", 2), ("3", 3), ("4", 4), ("5", 4), ("5", 4), ("6", 6), ("7", 6), ("None", None), ("8", 8), ("9", 9)])
    kept = near_dup.one_of_each(odd)
    assert kept.columns == odd.columns and sorted(str(r[0]) for r in kept.collect()) == ["1", "2", "3", "4", "6", "8", "9", "None"]
    assert near_dup.near_classes(empty).count() == 0 and near_dup.one_of_each(empty).count() == 0


def test_overlaps():
    rng = np.random.default_rng(0)
    bags = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.int32) for _ in range(12)]
    got = near_dup.overlaps(bags, 32)
    assert all(got[i, j] == len(np.intersect1d(bags[i], bags[j])) for i in range(12) for j in range(12) if i != j)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 500), rng.randrange(300, 500)) for _ in range(90)] + [(1000, 1000 + i) for i in range(60)]
    top = {}

    def find(x):
        top.setdefault(x, x)
        while top[x] != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    got = {r.node: r.label for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# 3


def test_license_odd_rows(spark, odd, empty):
    rows = docs(spark, [(1, "CC by\ncc  BY, all rights reserved", "s"), (2, "Released under\nMIT", "s"), (3, "Totally released under the mit license!", "s"), (4, "accby allrights", "s"), (5, "général public license", "s")])
    got = {r.doc_id: r for r in license_scan.scan_licenses(rows).collect()}
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word, got[1].base_labels) == (7, 3, 0, 4, "cc-by,reserved")
    assert (got[2].labels, got[2].score) == ("", 0.0) and (got[3].labels, got[3].base_labels, got[3].score) == ("mit", "", 1.0)
    assert got[4].n_base == 0 and got[5].n_base == 0
    assert license_scan.scan_licenses(odd).count() == 11 and license_scan.scan_licenses(empty).count() == 0
    nothing = {r.doc_id: r for r in license_scan.scan_licenses(odd).collect()}[1]
    assert (nothing.n_words, nothing.n_base, nothing.first_word, nothing.labels, nothing.score) == (0, 0, None, "", 0.0)


def test_wrapped_templates_are_found(spark):
    listed = [(label, t) for label, texts in license_scan.TEMPLATES.items() for t in texts]
    other = "lorem ipsum dolor sit amet " * 12
    rows, want = [], {}
    for label, text in listed:
        words = text.split()
        for n in (2, 3, len(words)):
            cuts = [len(words) * i // n for i in range(n + 1)]
            lines = [" ".join(words[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            for wrapped in ("\n".join(lines), f"{other}\r\n\r\n{other}" + "\r\n * ".join(lines) + f"{other}\n{other}"):
                want[len(rows)] = label
                rows.append((len(rows), wrapped, "s"))
    apart = listed[2][1].split()
    rows.append((len(rows), " ".join(apart[:10]) + f"\n{other}\n{other}\n" + " ".join(apart[10:]), "s"))
    # the words of a short template apart, about a line break, are no notice
    rows.append((len(rows), "ich bin mit ihr\nLicensed under the Apache License, Version 2.0", "s"))
    got = {r.doc_id: r for r in license_scan.scan_licenses(docs(spark, rows)).collect()}
    for i, label in want.items():
        assert label in got[i].labels.split(",") and got[i].score >= license_scan.TAU, rows[i]
    assert sum(got[i].score == 1 for i in want) >= len(want) // 2 and (got[len(want)].labels, got[len(want)].score) == ("", 0.0)
    assert got[len(want) + 1].labels == "apache"


def test_blocks_equal_brute_force(spark):
    """Texts of template words in all orders, with others among them, against every block of every text."""
    rng = random.Random(8)
    listed = [(label, license_scan._words(t)) for label, texts in license_scan.TEMPLATES.items() for t in texts]
    pool = sorted({w for _, ws in listed for w in ws})
    rows = []
    for i in range(400):
        words = []
        for _ in range(rng.randrange(1, 5)):
            part = list(rng.choice(listed)[1])
            for _ in range(rng.randrange(0, 6)):
                part.insert(rng.randrange(len(part) + 1), rng.choice([*pool, "other", "words", "\u212aind"]))
            for _ in range(rng.randrange(0, 5)):
                part.pop(rng.randrange(len(part)))
            if rng.random() < 0.3:
                rng.shuffle(part)
            words += part + ["filler"] * rng.choice([0, 0, 3, 40])
        rows.append((i, rng.choice([" ", "\n", ", "]).join(rng.choice([w, w.upper()]) for w in words), "s"))
    phrases = [(p.split(), label) for p, label in license_scan.PHRASES.items()]
    for r in license_scan.scan_licenses(docs(spark, rows)).collect():
        words = license_scan._words(rows[r.doc_id][1])
        best = {}
        for label, ws in listed:
            n, width = len(set(ws)), len(ws)
            share = max((len(set(ws) & set(words[i : i + width])) for i in range(len(words))), default=0) / n
            if share >= license_scan.TAU - 1e-9:
                best[label] = max(best.get(label, 0), share)
        starts = [i for p, _ in phrases for i in range(len(words)) if words[i : i + len(p)] == p]
        base = {label for p, label in phrases if any(words[i : i + len(p)] == p for i in range(len(words)))}
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | set(best))), rows[r.doc_id]
        assert math.isclose(r.score, 1.0 if starts else max(best.values(), default=0.0))


# 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 80))
def test_best_fit_decreasing(sizes, capacity):
    items = list(zip(sizes, map(str, range(len(sizes))), strict=True))
    got = sharding.best_fit_decreasing(items, capacity)
    load = collections.Counter()
    room = []
    want = {}
    for size, item in sorted(items, key=lambda x: (-x[0], x[1])):  # the plain rule
        fits = [(r, b) for b, r in enumerate(room) if r >= size]
        if fits:
            b = min(fits)[1]
        else:
            room.append(capacity)
            b = len(room) - 1
        room[b] -= size
        want[item] = b
    assert got == want
    for size, item in items:
        load[got[item]] += size
    assert all(v <= capacity for v in load.values())


def test_shards(spark, odd, empty, small):
    got = sharding.assign_shards(odd).collect()
    assert len(got) == 11
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and all(0 <= s < 40 for s in by)
    at = {}
    for r in got:
        assert at.setdefault(r.text_crc32, r.shard) == r.shard and r.law == "bytes"
    assert {r.doc_id: (r.size, r.text_crc32) for r in got}[1] == (16, 0)
    assert {r.doc_id: r.text_crc32 for r in got}[6] == zlib.crc32(b"one two")
    assert sharding.assign_shards(empty).count() == 0


def test_shards_are_even(spark):
    rng = random.Random(0)
    rows = [(i, "x" * rng.randrange(1, 2000) + str(i % 5000), "s") for i in range(6000)]
    sizes = collections.Counter()
    for r in sharding.assign_shards(docs(spark, rows)).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 40 and max(sizes.values()) < 1.03 * min(sizes.values())


@pytest.mark.parametrize("n", [300, 3000])
def test_every_group_is_packed(spark, n):
    """The bins of the plain rule over all groups, one by one, at two sizes of the corpus."""
    rng = random.Random(n)
    texts = ["y" * rng.randrange(1, 90) + str(rng.randrange(n // 3)) for _ in range(n)] + ["z" * 300] * (n // 3) + ["w" * n * 20]
    got = sharding.assign_shards(docs(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()
    size = lambda t: len(t) + 16
    groups = sorted((size(t) * k for t, k in collections.Counter(texts).items()), reverse=True)
    room = [math.ceil(sum(groups) / 40)] * 40
    held = [[] for _ in room]
    for g in groups:
        fits = [(r, b) for b, r in enumerate(room) if r >= g]
        b = min(fits)[1] if fits else max((r, b) for b, r in enumerate(room))[1]
        room[b] -= g
        held[b].append(g)
    bins = {}
    for r in got:
        bins.setdefault(r.shard, collections.Counter())[texts[r.doc_id]] += r.size
    assert all(sorted(bins.get(b, {}).values()) == sorted(held[b]) for b in range(40))


def test_slots_of_rows_that_share_an_id(spark):
    rows = [(None, "same", "s")] * 300 + [(7, f"text {i}", "s") for i in range(300)] + [(8, None, "s")] * 2
    old = sharding.TOGETHER, sharding.COPIES
    sharding.TOGETHER, sharding.COPIES = 50, 64
    try:
        got = sharding.assign_shards(docs(spark, rows)).collect()
    finally:
        sharding.TOGETHER, sharding.COPIES = old
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 602 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert len({r.shard for r in got if r.doc_id is None}) == 1


# 5


def test_mix_agrees_whatever_the_order(spark):
    """Rows that share an id, some with the same number of words, in several orders and partitions."""
    rng = random.Random(3)
    rows = [(i % 40, " ".join(["w"] * rng.randrange(1, 9)) + f" {i % 160}", rng.choice(["a", "b", None])) for i in range(900)]
    seen = []
    for k in range(4):
        rng.shuffle(rows)
        table = docs(spark, rows).repartition(1 + 2 * k)
        seen.append((sorted(map(repr, mixing.mix_sources(table).collect())), sorted(map(repr, mixing.mixed_documents(table).collect()))))
    assert all(x == seen[0] for x in seen)


def test_mix_reaches_its_targets(spark):
    rng = random.Random(0)
    rows = [(i, " ".join(["w"] * min(400, int(rng.lognormvariate(3, 1)))), rng.choice(["a", "a", "a", "b", "c", None])) for i in range(4000)]
    got = mixing.mix_sources(docs(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    taken, target, size = collections.Counter(), {}, collections.Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        taken[source[r.doc_id]] += r.taken
        size[source[r.doc_id]] += r.size
        target[source[r.doc_id]] = r.target
    assert math.isclose(sum(target.values()), 1.5 * sum(size.values()))
    assert all(abs(taken[s] - target[s]) <= 400 for s in target) and all(target[s] <= 2 * size[s] + 1e-6 for s in target)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.mix_sources(docs(spark, rows)).collect()), key=repr)


def test_mix_odd_rows(odd, empty):
    got = mixing.mix_sources(odd).collect()
    assert len(got) == 11 and {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    whole = collections.Counter(r.doc_id for r in got for _ in range(r.copies))
    mixed = mixing.mixed_documents(odd)
    assert mixed.columns == odd.columns and collections.Counter(r[0] for r in mixed.collect()) == whole
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0


# 6


def test_links_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(300, 32))
    near = np.concatenate([base + rng.normal(size=base.shape) * s for s in (0.0, 0.05, 0.2, 0.45)])
    rows = [(i, v.astype(np.float32).tolist(), "n", 0) for i, v in enumerate(near)]
    rows += [(2000, None, "n", 0), (2001, [], "n", 0), (2002, [0.0] * 32, "n", 0), (2003, [1.0, None], "n", 0), (2004, [math.nan] * 32, "n", 0), (2005, [math.inf] * 32, "n", 0), (2006, [1.0, 2.0], "n", 0), (2007, [2.0, 4.0], "n", 0), (None, [1.0, 2.0], "n", 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, VEC_ID string, label int")
    got = {r.vec_id: r for r in embed_dup.link_vectors(table).collect()}
    unit = np.array([r[1] for r in rows[:1200]], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    found, there = sum(got[i].n_links for i in range(1200)), int(close.sum())
    assert found <= there and found >= 0.99 * there
    assert all(got[i].n_links <= close[i].sum() for i in range(1200))
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in range(2000, 2006))
    assert got[2006].n_links == got[2007].n_links == 1 and got[2007].component_id == 2006 and not got[2007].kept
    assert got[None].n_links == 0 and got[None].component_id is None
    assert embed_dup.link_vectors(table.where("false")).count() == 0


def test_links_of_real_vectors_equal_brute_force(spark, duck):
    rows = duck.sql("SELECT vec_id, embedding FROM embeddings").fetchall()
    unit = np.array([r[1] for r in rows], dtype=np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    got = {r.vec_id: r.n_links for r in embed_dup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    found = np.array([got[r[0]] for r in rows])
    assert (found <= close.sum(axis=1)).all() and found.sum() >= 0.99 * close.sum()


def test_doubles_stay_doubles(spark):
    """A pair that lies below the threshold by less than four bytes can tell, and one above it."""
    dim, rng = 16, np.random.default_rng(5)
    rows = []
    for i in range(60):
        a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
        c = 0.9 + (1e-9 if i % 2 else -1e-9)
        rows += [(2 * i, (1e200 * a).tolist()), (2 * i + 1, (c * a + math.sqrt(1 - c * c) * b).tolist())]
    got = {r.vec_id: r for r in embed_dup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    unit = np.array([r[1] for r in rows])
    unit /= np.abs(unit).max(axis=1)[:, None]
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    assert all(got[4 * i].n_links == close[4 * i].sum() for i in range(30)) and sum(got[4 * i + 2].n_links for i in range(30)) >= 29


def test_very_long_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 30_000))
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([base, base + rng.normal(size=base.shape) * 0.2]))]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed_dup.link_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {i: (1, i % 6) for i in range(12)}


def test_a_dense_cluster_is_counted_in_blocks(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=24)
    near = base + rng.normal(size=(400, 24)) * 0.3
    old = embed_dup.BLOCK
    embed_dup.BLOCK = 64
    try:
        got = {r.vec_id: r for r in embed_dup.link_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(near)], "vec_id long, embedding array<double>")).collect()}
    finally:
        embed_dup.BLOCK = old
    unit = near / np.linalg.norm(near, axis=1)[:, None]
    close = unit @ unit.T >= 0.9
    np.fill_diagonal(close, False)
    assert all(got[i].n_links <= close[i].sum() for i in got) and sum(r.n_links for r in got.values()) >= 0.99 * close.sum()


def test_groups_grow_slowly_with_the_vectors():
    groups = [embed_dup.plan_for(n)["groups"] for n in (100, 50_000, 10**6, 10**8, 10**9)]
    assert groups == sorted(groups) and groups[1] <= 6 and groups[-1] <= 30


# 7


def test_odd_markup_takes_time_in_proportion():
    import time

    n = 60_000
    for unit, end in (('<a href="x ', ""), ("<div><p>t</p>", ""), ('<a ">"<a ', ""), ("<![CDATA[", ""), ("<!", ""), ("<div class=menu>t", ""), ("<div class=menu><h1>x", ""), ("<label>", "<p>x" * n), ("<li>", "<div>" * n), ("<a<a", "'>"), ("<!--", ""), ("</p>", "")):
        html = unit * n + end
        began = time.perf_counter()
        blocks = html_text.blocks_of(html)
        html_text.main_text(blocks, html_text.best_path(blocks))
        assert time.perf_counter() - began < 5 * len(html) / 1e6 + 1, unit


def test_tags_whose_quotes_stay_open_end_at_the_next_bracket():
    read = lambda html: html_text.main_text(html_text.blocks_of(html), ())
    assert read('<p title="a>b</p><p>c') == "b\nc" and read("<p title='a>b\">c</p><p>d") == 'b">c\nd'
    assert read('<p title="x>y">one</p><a href="open>two') == "one\ntwo" and read("1 < 2 <b>and") == "1 < 2 and"


def test_host_votes_on_whole_tables(spark, duck):
    """Votes and texts of all pages against counting them by hand."""
    rows = duck.sql("SELECT page_id, url, html FROM pages").fetchall()
    host = lambda u: re.match(r"(?s)^.*?://([^/?#]*)", u)[1].lower() if u and "://" in u else ""
    votes, worths, read = collections.Counter(), collections.Counter(), {}
    for i, url, html in rows:
        read[i] = html_text.blocks_of(html or "")
        best = html_text.best_path(read[i])
        if best:
            votes[host(url), best] += 1
            worths[host(url), best] += round(sum(html_text.worth(b[1], b[2]) for b in read[i]))
    winner = {}
    for (h, path), n in votes.items():
        winner[h] = max(winner.get(h, (0, 0, "")), (n, worths[h, path], html_text.SEP.join(path)))
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.host: r.path for r in html_text.host_paths(table).collect()} == {h: p for h, (_, _, p) in winner.items()}
    got = {r.page_id: r.text for r in html_text.extract_text(table).collect()}
    assert got == {i: html_text.main_text(read[i], tuple(winner[host(u)][2].split(html_text.SEP)) if host(u) in winner else html_text.best_path(read[i])) for i, u, _ in rows}


def test_an_article_keeps_its_own_header():
    html = "<body><header><p>The site's header</p></header><article><header><h1>Title</h1><p>By someone</p></header><p>The text of it all.</p><footer>Filed under</footer></article></body>"
    blocks = html_text.blocks_of(html)
    assert html_text.main_text(blocks, html_text.best_path(blocks)).split("\n") == ["Title", "By someone", "The text of it all."]


def test_main_text(spark):
    page = "<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=/>n</a></nav><div class='cookie-notice'>We use</div><main><div class='post post-{n}'><h1>A &lt;b&gt; B</h1><p>One  long paragraph of the article\n here<p>Two &amp;amp; <b>x</b> &eacute; of the article<ul><li>i1<li>i2</ul><script>var a='</p>';</script><form><p>mail</p></form><div id=comments><p>a reader says very much at length here to be the longest of all lines</p></div></div></main><aside>side</aside><footer>&copy;</footer></body></html>"
    rows = [(i, "http://h.example/x", page.replace("{n}", str(i)), "p") for i in range(3)] + [(7, None, None, "p"), (8, "u", "", "p"), (9, "http://h.example/y", "<body><p>other page of this host</body>", "p"), (9, "http://h.example/y", "<body><p>other page of this host</body>", "p"), (10, "z", "<nav>only</nav>", "p")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, path string")
    got = {r.page_id: r for r in html_text.extract_text(table).collect()}
    want = "A <b> B\nOne long paragraph of the article here\nTwo &amp; x é of the article\ni1\ni2"
    assert [got[i].text for i in range(3)] == [want] * 3 and got[0].n_chars == len(want)
    assert got[7].text == got[8].text == got[10].text == "" and got[9].text == "other page of this host"
    assert html_text.extract_text(table).count() == 8 and html_text.extract_text(table.where("false")).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>/pdiv ab=\"'!-&;", max_size=60))
def test_any_markup_is_read(html):
    html_text.main_text(html_text.blocks_of(html), ())


def test_parts_of_an_article_stay_together():
    p = lambda i: f"<p>Paragraph {i} tells at some length what part {i} of it all is about.</p>"
    side = '<div class="sidebar"><p>Sidebar.</p></div><section id="comments"><p>A reader says something at some length here, and more.</p></section>'
    items = "".join(f"<li>An item of a long list, the number {i} of it.</li>" for i in range(40))
    read = lambda inner: html_text.main_text(html_text.blocks_of(f"<body>{inner}{side}</body>"), html_text.best_path(html_text.blocks_of(f"<body>{inner}{side}</body>"))).split("\n")
    sections = f"<h1>Title</h1><section>{p(1)}{p(2)}</section><section>{p(3)}{p(4)}</section><section>{p(5)}</section>"
    for tag in ("article", 'div class="content"'):
        got = read(f"<{tag}>{sections}</{tag.split()[0]}>")
        assert got[0] == "Title" and len(got) == 6, tag
        got = read(f"<{tag}><h1>Title</h1>{p(1)}<ul>{items}</ul><table><tr><td>one</td><td>two</td></tr></table></{tag.split()[0]}>")
        assert got[0] == "Title" and len(got) == 44, tag


def test_unequal_blocks_without_an_article_stay_together(spark):
    p = lambda n: "<p>" + "word " * (n // 5) + "</p>"
    lead, text = f"<div class=lead>{p(300)}</div>", f"<div class=text>{p(900)}</div>"
    menu = "<div class=list><a href=/a>One place to go</a> <a href=/b>Another place</a></div>"
    inner = {
        "lead": (f"<div class=content><h1>T</h1>{lead}{text}</div>", 3),
        "title": (f"<div class=content><h1>T</h1>{text}</div>", 2),
        "linked title": (f"<div class=content><h1><a href=/t>T</a></h1>{text}</div>", 2),
        "deep": (f"<div class=content><h1>T</h1><div class=a><div class=b><div class=c><div class=d>{text}</div></div></div></div></div>", 2),
        "beside an article": (f"<div class=content><h1>T</h1><article>{text}</article></div>", 2),
    }
    for name, (html, n) in inner.items():
        blocks = html_text.blocks_of(f"<html><body>{menu}{html}</body></html>")
        got = html_text.main_text(blocks, html_text.best_path(blocks)).split("\n")
        assert len(got) == n and got[0] == "T", name
    # a host's path does not cut what one of its pages has outside it
    rows = [(i, "http://h.example/x", f"<html><body>{menu}{text}</body></html>") for i in range(3)] + [(3, "http://h.example/x", f"<html><body>{menu}{inner['lead'][0]}</body></html>"), (4, "http://h.example/x", f"<html><body><h1>T</h1>{text}</body></html>")]
    got = {r.page_id: r.text.split("\n") for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [len(got[i]) for i in range(5)] == [1, 1, 1, 3, 2] and got[3][0] == got[4][0] == "T"


def test_wrappers_named_like_furniture_keep_the_page():
    read = lambda inner: html_text.main_text(html_text.blocks_of(f"<body>{inner}</body>"), html_text.best_path(html_text.blocks_of(f"<body>{inner}</body>"))).split("\n")
    text = "<h1>Title</h1><p>The first paragraph tells at some length what this is about.</p><p>Another one goes on about it for a while.</p>"
    apart = '<div class="sidebar"><p>Sidebar.</p></div><div class="site-footer"><p>Footer.</p></div><div class="cookie-notice">We use</div><section id="comments"><article class="comment"><p>A reader says something at very great length here, and more, and then goes on until it is the longest of all the lines of the page.</p></article></section>'
    want = read(f"<div>{text}</div>")
    assert len(want) == 3
    wrappers = ("div class='content has-sidebar'", "div id=page class='no-sidebar sticky-header'", "section class='legal-news'", "form action=/x id=aspnetForm", "div class=sticky-header", "div class='layout header'", "div class=legal-notice", "div style='display:none'")
    for wrapper in wrappers:
        tag = wrapper.split()[0]
        for inner in (text, f"<article>{text}</article>", f"<main>{text}</main>", f"<div class='nav'><div class=menu>{text}</div></div>"):
            assert read(f"<{wrapper}>{inner}{apart}</{tag}>") == want, (wrapper, inner)
            assert read(f"<{wrapper}><nav>Menu</nav>{inner}</{tag}>{apart}") == want, (wrapper, inner)
    assert read(f"<header>Site<main>{text}</main>") == want
    assert read(f"{text}<section class='legal-news'><p>More.</p></section>") == [*want, "More."]
    assert read(f"{text}<div class='page-header'><h2>Part</h2></div>") == [*want, "Part"]
    for name in ("site-footer", "main-nav", "sidebar left", "cookie-consent", "related-posts", "ad", "comments-area", "widget-12"):
        assert read(f"{text}<div class='{name}'><p>Apart.</p></div>") == want, name
    assert read("<p>one <span class=ad>buy</span> two</p>") == ["one two"] and read("<div class=comments><p>Only what a reader says.</p></div>") == [""]


def test_captions_and_formulas_stay():
    html = "<body><nav>Menu</nav><h1>Title</h1><figure><img src=x><figcaption>What the picture shows.</figcaption></figure><svg><title>icon</title><text x=1>Tea</text><text x=2>Coffee</text></svg><p>It is <math><mi>x</mi><mo>=</mo><mn>2</mn></math> here.</p><object data=x><param name=a><p>In place of the film.</p></object><p>End.</p></body>"
    blocks = html_text.blocks_of(html)
    assert html_text.main_text(blocks, html_text.best_path(blocks)).split("\n") == ["Title", "What the picture shows.", "Tea Coffee", "It is x=2 here.", "In place of the film.", "End."]


def test_pages_against_a_plain_reading(duck):
    from html import unescape

    for html in [r[0] for r in duck.sql("SELECT html FROM pages").fetchall()]:
        article = re.search(r"<article>(.*?)</article>", html, re.S)[1]
        lines = [" ".join(unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        blocks = html_text.blocks_of(html)
        assert html_text.main_text(blocks, html_text.best_path(blocks)) == "\n".join(x for x in lines if x)


# 8


def test_quality(spark, odd, empty):
    rows = duckdb.sql("SELECT d.doc_id, l.quality, d.text FROM '/root/testdata/sf0.01/documents.parquet' d JOIN '/root/testdata/sf0.01/labels.parquet' l USING (doc_id)").fetchall()
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    table = docs(spark, [(r[0], r[2], "s") for r in rows])
    labels = spark.createDataFrame([(r[0], r[1]) for r in rows] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train(table, labels)
    got = {r.doc_id: r for r in quality.score_documents(table, model).collect()}
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    good, bad = [got[r[0]].score for r in held if r[1]], [got[r[0]].score for r in held if not r[1]]
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([x >= 0.3 for x in good]) > 0.97
    other = quality.score_documents(odd, model).collect()
    assert len(other) == 11 and all(0 <= r.score <= 1 for r in other) and len({r.score for r in other if r.doc_id in (1, 2)}) == 1
    kept = quality.kept_documents(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.predicted for r in other)
    assert quality.score_documents(empty, model).count() == 0
    # without rows to learn from nothing is rejected
    for none in (quality.train(table.where("false"), labels), quality.train(table, labels.where("false")), quality.train(table, labels, sample_bytes=0)):
        assert {r.score for r in quality.score_documents(table, none).collect()} == {0.5} and quality.kept_documents(table, none).count() == len(rows)


def test_scores_equal_a_plain_convolution():
    """Symbols, responses, pooling and probability worked out place by place."""
    rng = np.random.default_rng(4)
    shape = (quality.WIDTH, quality.SYMBOLS, quality.FILTERS)
    model = {"filters": rng.normal(size=shape).astype(np.float32), "weights": (rng.normal(size=2 * quality.FILTERS) / 20).astype(np.float32), "bias": np.array([0.1], np.float32)}
    texts = ["", None, "word word word other", "é" * 700, " ".join(f"w{i % 37}" for i in range(400))]
    for text, got in zip(texts, quality.scores(model, texts), strict=True):
        raw = (text or "").encode()
        starts = [0]
        while starts[-1] + quality.CHUNK < len(raw):
            starts.append(starts[-1] + quality.STRIDE)
        best = []
        for lo in starts:
            chunk = raw[lo : lo + quality.CHUNK].ljust(quality.CHUNK, b"\0")
            again = []
            for i in range(quality.CHUNK):
                gram = chunk[i : i + quality.GRAM]
                back = chunk.rfind(gram, 0, i + quality.GRAM - 1) if len(gram) == quality.GRAM and gram.strip(b"\0") else -1
                again.append(256 + (i - back).bit_length() if back >= 0 else 256)
            here = range(0, quality.CHUNK - quality.WIDTH + 1, quality.STEP)
            best.append(np.maximum(0, np.max([sum(model["filters"][o][chunk[i + o]] + model["filters"][o][again[i + o]] for o in range(quality.WIDTH)) for i in here], axis=0)))
        x = np.concatenate([np.max(best, axis=0), np.mean(best, axis=0)])
        assert math.isclose(got, 1 / (1 + math.exp(-(x @ model["weights"] + 0.1))), rel_tol=1e-4)


def test_training_takes_whole_texts_within_its_bound(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda docs, y: seen.append((docs, y)) or {})
    rows = [(i, f"{i} " * (20 + i * 30), "a") for i in range(200)] + [(7, "another text of the same id", "a"), (11, None, "a")]
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    quality.train(docs(spark, rows), labels, sample_bytes=60_000)
    (got, y), texts = seen[0], {quality.chunks_of(t).tobytes(): len(t or "") for _, t, _ in rows}
    sizes = [texts[np.ascontiguousarray(d).tobytes()] for d in got]
    assert 5 < len(got) == len(y) and 30_000 < sum(sizes) <= 60_000


def test_repetitions_are_seen():
    chunk = quality.chunks_of("Wher. Wher. Wher. ofly\0\0\0\0\0\0 Wher.")
    got = quality.repeats(chunk)[0]
    raw = bytes(chunk[0])
    for i in range(quality.CHUNK):
        gram = raw[i : i + quality.GRAM]
        back = i - raw.rfind(gram, 0, i + quality.GRAM - 1) if len(gram) == quality.GRAM and gram.strip(b"\0") and gram in raw[: i + quality.GRAM - 1] else 0
        assert got[i] == 256 + back.bit_length(), i
    assert got.max() < quality.SYMBOLS


def test_junk_of_repeated_words_is_rejected(spark):
    words = [f"w{'abcdefghij'[i % 10] * (i % 7 + 1)}{i}" for i in range(400)]
    clean = [(i, " ".join(words[(i * 37 + j * (i % 11 + 1)) % 400] for j in range(60))) for i in range(0, 300, 2)]
    junk = [(i, " ".join(w for j in range(6) for w in [words[(i * 37 + j) % 400]] * 10)) for i in range(1, 300, 2)]
    table = docs(spark, [(*row, "a") for row in clean + junk])
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)], "doc_id long, quality int")
    got = quality.score_documents(table, quality.train(table, labels)).collect()
    assert sum(r.predicted == 1 - r.doc_id % 2 for r in got if r.held_out) >= 0.95 * sum(r.held_out for r in got)


def test_chunks_cover_the_whole_text():
    for n in (0, 1, 512, 513, 960, 961, 5000):
        text = "".join(chr(97 + i % 26) for i in range(n))
        got = quality.chunks_of(text)
        seen = np.zeros((len(got) - 1) * quality.STRIDE + quality.CHUNK, np.uint8)
        for i, c in enumerate(got):
            seen[i * quality.STRIDE : i * quality.STRIDE + quality.CHUNK] = c
        assert bytes(seen[:n]).decode() == text and not seen[n:].any()


# 9


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.vocabulary())


def exact(codec, texts):
    for text, (ids, decoded) in zip(texts, codec.encode(texts), strict=True):
        want = codec.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded == codec.tokenizer.decode(want, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aB é́̀ñ \n\t\r\x1c\x85\xa0'st1²½ßΣσς中<|endoftext|>.!%한İ‍🤗"), max_size=300), max_size=4))
def test_encoding_is_the_librarys(codec, texts):
    exact(codec, texts)


def test_encoding_of_documents(codec, duck):
    texts = [r[0] for r in duck.sql("SELECT text FROM documents").fetchall()]
    exact(codec, [*texts, *texts, "a" * 9000, " " * 3000, "x<|startoftext|>y <|endoftext|> z" * 200, ""])
    assert codec.reused > 0


def test_chunks_are_cut_by_content():
    rng = random.Random(0)
    passage = " ".join(f"w{rng.randrange(999)}" for _ in range(3000))
    a, b = (set(p for core, p in bpe.pieces(x) if core) for x in ("intro " * 7 + passage, passage + " and an end"))
    assert len(a & b) >= 0.8 * len(a)
    text = "one\ttwo\n" + passage
    assert "".join(p for _, p in bpe.pieces(text)) == text.replace("\t", " ").replace("\n", " ")


def test_encoding_odd_rows(odd, empty):
    got = bpe.encode_documents(odd, bpe.vocabulary(), digests=True).collect()
    none = next(r for r in got if r.doc_id == 1)
    assert len(got) == 11 and none.n_tokens == 0 and none.ids == none.decoded == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_documents(empty, bpe.vocabulary()).count() == 0
    whole = {r.doc_id: r for r in bpe.encode_documents(odd, bpe.vocabulary()).collect()}
    assert whole[6].decoded == "one</w> two</w>" and whole[6].n_tokens == len(whole[6].ids) == 2


# 10


def test_audio_search(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 64))
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(100 + i, (v + rng.normal(size=64) * 0.1).tolist()) for i, v in enumerate(base[:20])] + [(50, base[0].tolist()), (200, None), (201, []), (202, [None] * 64), (None, base[3].tolist())]
    clips = audio.played_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    prints = common.written(audio.fingerprint_audio(clips), "prints")
    got = {r.id: r for r in audio.search_audio(prints, query_every=1).collect()}
    there = [i for i in range(1, 20) if got[i].best_id == 100 + i and got[i].best_errors < 0.15 and abs(got[i].best_offset) <= 1]
    assert len(there) >= 0.9 * 19 and all(got[i].n_matches == 0 for i in range(1, 20) if i not in there)
    assert got[0].n_matches == 2 and got[0].best_id == 50 and got[0].best_errors == 0 and got[25].n_matches == 0
    assert got[200].n_frames == 0 and got[200].best_id is None and not got[None].is_query
    assert audio.search_audio(prints.where("false")).count() == 0


def brute_matches(prints, every, most=audio.MAX_ERRORS):
    """{id: other ids that align over half of the shorter one at least, at the shift at which most steady bits agree}."""
    mask, out = audio.steady_bits(), {}
    for q, a in prints.items():
        if q % every == 0 and len(a):
            out[q] = set()
            for i, b in prints.items():
                shifts = collections.Counter(p - k for k, x in enumerate(a) for p, y in enumerate(b) if (x ^ y) & mask == 0)
                if i == q or not shifts:
                    continue
                shift = max(shifts, key=lambda s: (shifts[s], -abs(s), s))
                both = [(a[k], b[k + shift]) for k in range(len(a)) if 0 <= k + shift < len(b)]
                if 2 * len(both) >= min(len(a), len(b)) and sum(((x ^ y) & 0xFFFFFFFF).bit_count() for x, y in both) <= most * 32 * len(both) + 1e-9:
                    out[q].add(i)
    return out


def test_audio_matches_equal_brute_force(spark, monkeypatch):
    """Recordings of several lengths, shifted, with held tones and silence in them, and hot keys cut into blocks."""
    monkeypatch.setattr(audio, "TOGETHER", 8)
    rng = random.Random(6)
    value = lambda: rng.randrange(-(1 << 31), 1 << 31)
    flip = lambda x: x ^ sum(rng.random() < 0.03 and 1 << b for b in range(31))
    prints = {}
    base = [[value() for _ in range(rng.randrange(5, 40))] + [77] * rng.choice([0, 30]) for _ in range(12)]
    for i in range(70):
        whole = rng.choice(base)
        cut = rng.randrange(0, 4)
        prints[i] = [flip(x) if rng.random() < 0.5 else x for x in whole[cut:]]
    prints |= {70 + i: [77] * (10 + 5 * i) for i in range(12)} | {90: [], 91: [5]}
    table = spark.createDataFrame([(i, p, "x") for i, p in prints.items()], "id long, print array<int>, ID string")
    got = {r.id: r for r in audio.search_audio(table, query_every=3).collect()}
    want = brute_matches(prints, 3)
    assert {i: r.n_matches for i, r in got.items() if r.n_matches is not None} == {i: len(x) for i, x in want.items()}
    assert all(r.best_id in want[i] for i, r in got.items() if r.n_matches)


def rows_made(spark, run):
    """The most rows that a join or a Generate makes in any of the plans that run."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, most = store.executionsCount(), 0
    out = run()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    for i in range(store.executionsList().size()):
        e = store.executionsList().apply(i)
        if i >= before:
            values, nodes = store.executionMetrics(e.executionId()), store.planGraph(e.executionId()).allNodes()
            for node in (nodes.apply(k) for k in range(nodes.size())):
                for m in (node.metrics().apply(k) for k in range(node.metrics().size())):
                    if re.search("Join|Generate", node.name()) and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                        most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return out, most


def test_audio_makes_no_rows_of_pairs(spark):
    rng = random.Random(4)
    base = [rng.randrange(-(1 << 31), 1 << 31) for _ in range(40)]
    prints = {i: [x ^ sum(rng.random() < 0.01 and 1 << b for b in range(31)) for x in base] for i in range(80)}
    table = spark.createDataFrame(list(prints.items()), "id long, print array<int>")
    got, made = rows_made(spark, lambda: {r.id: r.n_matches for r in audio.search_audio(table, query_every=1).collect()})
    assert got == {i: len(x) for i, x in brute_matches(prints, 1).items()} and sum(got.values()) > 6000
    assert 0 < made <= 80 * 40  # at most a row for each frame


def test_audio_blocks_find_the_best_shifts(monkeypatch):
    """Long held tones, silence on either side, one id on two recordings, and pieces that end within a recording."""
    rng = random.Random(9)
    tone = lambda: [rng.choice([0, 1 << 1, 1 << 3])] * rng.choice([1, 1, 2, 9, 30])
    prints = [sum((tone() for _ in range(rng.randrange(1, 9))), []) for _ in range(40)] + [[0] * 50, [0] * 51, [0] * 3]
    nodes = [*range(len(prints) - 1), 0]
    mask = audio.steady_bits()
    want = {}
    for q, a in enumerate(prints[::3]):
        for x, b in enumerate(prints):
            shifts = collections.Counter(p - k for k, v in enumerate(a) for p, w in enumerate(b) if (v ^ w) & mask == 0)
            if shifts and nodes[::3][q] != nodes[x]:
                want[q, x] = max(shifts, key=lambda s: (shifts[s], -abs(s), s))
    side = lambda some, ids: (np.array(ids), np.array([len(x) for x in some]), np.array(sum(some, []), dtype=np.int32))
    for at_once in (1, 50, 1 << 18):
        monkeypatch.setattr(audio, "AT_ONCE", at_once)
        got = [(int(q), int(x), int(s)) for found in audio._best_shifts(side(prints[::3], nodes[::3]), side(prints, nodes)) for q, x, s in zip(*found, strict=True)]
        assert len(got) == len(want) and {(q, x): s for q, x, s in got} == want


def test_audio_odd_fingerprints(spark):
    rows = [(0, [5, 6, 7]), (1, [5, None, 7]), (2, []), (3, None), (None, [5, 6, 7]), (4, [5, 6, 7, 8])]
    got = {r.id: r for r in audio.search_audio(spark.createDataFrame(rows, "id long, print array<int>"), query_every=1).collect()}
    assert len(got) == 6 and (got[0].n_matches, got[0].best_id, got[4].n_matches) == (1, 4, 1)
    assert [got[i].n_matches for i in (1, 2, 3, None)] == [None] * 4


def test_very_long_recordings(spark):
    rng = np.random.default_rng(8)
    long = rng.integers(-(1 << 31), 1 << 31, 30_000).tolist()
    rows = [(0, long), (1, long[700:]), (2, [3] * 30_000), (3, [3] * 20_000 + long[:10]), (4, rng.integers(-(1 << 31), 1 << 31, 30_000).tolist())]
    got = {r.id: r for r in audio.search_audio(spark.createDataFrame(rows, "id long, print array<int>"), query_every=1).collect()}
    assert [got[i].n_matches for i in range(5)] == [1, 1, 1, 1, 0] and (got[0].best_id, got[0].best_offset, got[0].best_errors) == (1, -700, 0.0)


def test_a_held_tone_is_one_run(spark):
    table = spark.createDataFrame([(1, [4] * 5000 + [9]), (2, [4])], "node long, print array<int>")
    assert sorted((r.node, r.pos, r.len) for r in audio._runs(table).collect()) == [(1, 0, 5001 if audio.steady_bits() & 13 == 0 else 5000), *([] if audio.steady_bits() & 13 == 0 else [(1, 5000, 1)]), (2, 0, 1)]


def test_a_shifted_recording_aligns():
    rng = np.random.default_rng(2)
    whole, rate = audio.samples_of(audio.play(rng.normal(size=256)))
    hop = 512 // audio.HOPS
    a = audio.fingerprint(audio.chroma(whole[None, :], rate))[0]
    b = audio.fingerprint(audio.chroma(whole[None, 10 * hop :], rate))[0]
    assert (a[10:] == b[: len(a) - 10]).mean() > 0.95


def test_recordings_of_24_bits():
    import io
    import wave

    values = [[0, 1], [-(1 << 23), (1 << 23) - 1], [1 << 22, -1]]
    raw = io.BytesIO()
    with wave.open(raw, "wb") as w:
        w.setnchannels(2), w.setsampwidth(3), w.setframerate(8000)
        w.writeframes(b"".join(v.to_bytes(3, "little", signed=True) for pair in values for v in pair))
    x, rate = audio.samples_of(raw.getvalue())
    assert rate == 8000 and np.allclose(x, np.array(values).mean(axis=1) / (1 << 23), atol=0, rtol=1e-12)


def test_unreadable_recordings(spark):
    rows = [(1, None), (2, b""), (3, b"RIFFbroken"), (4, audio.play(np.ones(64)))]
    got = {r.id: len(r.print) for r in audio.fingerprint_audio(spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in rows], "id long, audio binary")).collect()}
    assert got[1] == got[2] == got[3] == 0 and got[4] > 0
