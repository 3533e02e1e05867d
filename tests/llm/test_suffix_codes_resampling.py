"""Decontamination, vector codes and resampling: parts against plain code, odd rows, bounded settings against whole ones."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import oracle
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from watchplan.llm import decontamination as dc
from watchplan.llm import queries, resampling
from watchplan.llm import vector_codes as vc
from watchplan.llm.spans import words_of, words_of_column

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{k % 4001}" for k in range(30_000))
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, n_words long, items string, starts int, bucket int, weight long, rank long"
TEXTS = [
    (1, None), (2, ""), (3, " \n--\t"), (4, "One two three four five six seven eight nine ten eleven twelve"), (5, "x one two three four five six seven eight nine ten y"),
    (5, "x one two three four five six seven eight nine ten y"), (5, "other text of the same id"), (6, "ÉTÉ été İstanbul 漢字漢字 naïve-Été 12"), (7, "short item here twice: Short ITEM here!"), (8, LONG), (9, LONG + " one two three four five six seven eight nine ten"),
    (None, "short item here"), (10, "three four five six seven eight nine ten eleven twelve three four five six seven eight nine ten eleven twelve"), (11, "nine ten eleven twelve and one two"),
]
ITEMS = [(1, "one two three four five six seven eight nine ten eleven"), (2, "Short, item: here"), (10, "été istanbul"), (3, None), (4, ""), (5, "!!"), (None, "naïve été"), (2, "five six seven eight nine ten eleven twelve three four five"), (9, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11"), (7, "漢字漢字")]


def lowered(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, empty, long and repeated texts, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "en", "s", 1, 2, 3, "i", 4, 5, 6, 7) for r in TEXTS], DOC_SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(*r, 1) for r in ITEMS], "item_id long, text string, n_words int")


def brute_hits(text, items, words=10):
    own, hit, met = lowered(text), set(), set()
    for name, t in items:
        w = lowered(t)
        k = min(words, len(w))
        wins = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()
        for i in range(len(own) - k + 1) if w else ():
            if tuple(own[i : i + k]) in wins:
                hit |= set(range(i, i + k))
                met.add("" if name is None else str(name))
    return len(own), len(hit), sorted(met)


def test_words_of_bytes_are_words_of_text():
    for _, t in TEXTS + ITEMS:
        assert [w.decode() for w in words_of((t or "").encode())] == lowered(t)
    column = pa.array([(t or "").encode() if t is not None else None for _, t in TEXTS], pa.binary())
    for c in (column, column.slice(3, 7), pa.array([b"ab", b"cd", b"", b"e f"]), pa.array([], pa.binary())):
        w = words_of_column(c)
        got = [[] for _ in range(len(c))]
        for s, e, t in zip(w.start, w.end, w.text):
            got[t].append(w.buffer[s:e].tobytes())
        assert got == [words_of(x or b"") for x in c.to_pylist()]


def test_suffix_array_and_bisection():
    rng = np.random.default_rng(5)
    for vocabulary, n, longest in [(1, 40, 7), (2, 300, 9), (5, 300, 30), (3000, 500, 12), (2**40, 60, 5)]:
        token = rng.integers(0, min(vocabulary, 50) + 1, n)
        array = dc.suffix_array(token, longest, vocabulary)
        rows = token.tolist()

        def head(p, rows=rows, longest=longest):
            own = rows[p : p + longest]
            return own[: own.index(0)] if 0 in own else own

        assert sorted(array.tolist()) == np.flatnonzero(token).tolist()
        keys = [head(p) for p in array.tolist()]
        assert keys == sorted(keys)
        query = np.concatenate([rng.integers(1, min(vocabulary, 50) + 1, 40), [0]])
        place = np.arange(40)
        length = np.minimum(rng.integers(1, longest + 1, 40), 40 - place)
        lo, hi = (dc.bisect(token, array, query, place, length, a) for a in (False, True))
        for k in range(40):
            q = query[place[k] : place[k] + length[k]].tolist()
            assert array[lo[k] : hi[k]].tolist() == [p for p in array.tolist() if rows[p : p + len(q)] == q]


@pytest.mark.parametrize(("block_bytes", "shard_words"), [(1 << 20, 400_000), (30, 400_000), (1, 1), (1 << 20, 15)])
def test_contamination_of_odd_rows(spark, docs, items, block_bytes, shard_words):
    got = dc.contamination(docs, items, 10, block_bytes=block_bytes, shard_words=shard_words).collect()
    want = []
    for doc_id, t in TEXTS:
        n, hit, met = brute_hits(t, ITEMS)
        want.append((doc_id, n, hit, len(met), hashlib.sha256(",".join(met).encode()).hexdigest(), hit > 0))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    kept = dc.clean(docs, items, 10, block_bytes=block_bytes, shard_words=shard_words)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(((i, t) for i, t in TEXTS if not brute_hits(t, ITEMS)[1]), key=repr)


def test_stretches_of_a_document(docs, items):
    got = {r.doc_id: (r.starts, r.ends, r["items"]) for r in dc.hits(docs, items).where("doc_id IN (7, 9)").collect()}
    assert got[7] == ([0, 4], [3, 7], ["2"])
    starts, ends, met = got[9]
    assert met == ["1", "9"] and (starts[-1], ends[-1]) == (30_000, 30_010) and len(starts) == 9


@pytest.mark.parametrize(("block_bytes", "shard_words"), [(1 << 20, 400_000), (30, 12)])
def test_longest_matches(docs, items, block_bytes, shard_words):
    got = {(r.item_id, r.item_word): (r.n_words, r.doc_id, r.doc_word) for r in dc.longest_matches(docs, items, 3, block_bytes, shard_words).collect()}
    want = {}
    for name, t in ITEMS:
        w = lowered(t)
        for i in range(len(w)):
            for doc_id, d in TEXTS:
                own = lowered(d)
                for at in range(len(own)) if len(own) < 100 else [p for p in range(len(own)) if own[p] == w[i]]:
                    n = 0
                    while i + n < len(w) and at + n < len(own) and w[i + n] == own[at + n]:
                        n += 1
                    key = ("" if name is None else str(name), i)
                    order = (-n, doc_id is None, doc_id or 0, at)
                    if n >= 3 and (key not in want or order < want[key][0]):
                        want[key] = (order, (n, doc_id, at))
    assert got == {k: v[1] for k, v in want.items()}


def test_decontamination_of_empty_tables(spark, docs, items):
    no_docs, no_items = docs.where("false"), items.where("false")
    assert dc.contamination(no_docs, items).collect() == []
    assert dc.contamination(docs, no_items).where("contaminated OR n_hit > 0 OR n_items > 0").isEmpty()
    assert dc.contamination(docs, no_items).count() == len(TEXTS)
    assert dc.longest_matches(docs, no_items).collect() == dc.longest_matches(no_docs, items).collect() == []
    assert dc.clean(docs, no_items).count() == len(TEXTS)


def test_a_passage_in_a_third_of_all_rows(spark):
    """One passage, in items of several names, in a third of many rows, and a row of nothing but it."""
    passage = " ".join(f"p{k}" for k in range(12))
    rows = [(k, f"a{k} {passage} b{k}" if k % 3 == 0 else f"c{k} d{k % 7} e") for k in range(3000)] + [(9999, " ".join([passage] * 500))]
    items = spark.createDataFrame([(k, passage) for k in range(40)], "item_id long, text string")
    got = dc.contamination(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), items)
    assert got.agg(F.sum("n_hit"), F.sum(F.col("contaminated").cast("int")), F.max("n_items")).first()[:] == (12 * 1000 + 6000, 1001, 40)


def tree_of(points, leaf=vc.LEAF):
    points, count = np.unique(points, axis=0, return_counts=True)
    order, nodes = vc.cover_tree(points, leaf)
    return vc.Tree(points[order], count[order], nodes)


@pytest.mark.parametrize(("n", "dim", "spread"), [(1, 3, 9), (9, 4, 2), (700, 4, 40), (900, 1, 400), (400, 6, 10**6), (2000, 2, 15)])
def test_cover_trees(n, dim, spread):
    rng = np.random.default_rng(n)
    tree = tree_of(np.floor(rng.normal(0, spread, (n, dim))).astype(np.int64))
    for node in tree.node:
        own, centre = tree.points[node["start"] : node["end"]], tree.points[node["centre"]]
        assert len(own) and node["start"] <= node["centre"] < node["end"] and np.sqrt(((own - centre) ** 2).sum(1)).max() <= node["radius"] + 1e-9
        if node["children"]:
            kids = tree.node[node["child"] : node["child"] + node["children"]]
            assert kids["start"][0] == node["start"] and kids["end"][-1] == node["end"] and (kids["start"][1:] == kids["end"][:-1]).all()  # nothing lost
            assert kids["centre"][0] == node["centre"]  # nesting
            scale = 2.0 ** (math.ceil(math.log2(node["radius"])) - 1)
            assert kids["radius"].max() <= scale + 1e-9  # covering
            c = tree.points[kids["centre"]]
            apart = np.sqrt(((c[:, None] - c[None]) ** 2).sum(-1)) + np.eye(len(c)) * 1e18
            assert apart.min() > scale  # separation
    for entries in (tree.points[rng.integers(0, len(tree.points), 16)], rng.integers(-3 * spread, 3 * spread, (5, dim))):
        of, total, amount, _ = vc.assign(tree, entries)
        want = ((tree.points[:, None] - entries[None]) ** 2).sum(-1).argmin(1)  # ties to the first
        assert (of == want).all()
        for e in range(len(entries)):
            assert amount[e] == tree.count[want == e].sum() and (total[e] == (tree.points * tree.count[:, None])[want == e].sum(0)).all()


def test_far_clusters_go_whole():
    rng = np.random.default_rng(3)
    points = np.concatenate([rng.integers(-20, 20, (500, 4)) + c for c in (0, 5000, -9000)])
    *_, whole = vc.assign(tree_of(points), np.array([[0] * 4, [5000] * 4, [-9000] * 4]))
    assert whole > 0.95 * len(np.unique(points, axis=0))


def brute_codes(rows, parts, entries, rounds):
    kept = [(i, x, [math.floor(256 * c) for c in v]) for i, x, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = len(kept[0][2]) // parts
    first = sorted({i: v for i, _, v in sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]), reverse=True) if i is not None}.items())[:entries]
    books = [[v[p * width : (p + 1) * width] for _, v in first] for p in range(parts)]

    def near(p, v):
        d = [sum((a - b) ** 2 for a, b in zip(v[p * width : (p + 1) * width], e)) for e in books[p]]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        own = [[near(p, v)[0] for p in range(parts)] for *_, v in kept]
        new = [[list(e) for e in b] for b in books]
        for p in range(parts):
            for e in range(len(books[p])):
                some = [v[p * width : (p + 1) * width] for (*_, v), o in zip(kept, own) if o[p] == e]
                if some:
                    new[p][e] = [sum(c) // len(some) for c in zip(*some)]
        books = new
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, by_label = [], Counter()
    for i, x, v in kept:
        n = [near(p, v) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for k, _ in n), sum(d for _, d in n), x))
        by_label[x] += out[-1][2]
    return sorted(((i, c, e, by_label[x], digest) for i, c, e, x in out), key=repr)


def test_codes_of_odd_rows(spark):
    rng = np.random.default_rng(8)
    rows = [(k, int(k % 3) if k % 5 else None, np.float32(rng.normal(0, 0.3, 8)).tolist()) for k in range(60, 0, -1)]
    hot = rows[0][2]
    rows += [(100 + k, 1, hot) for k in range(40)]  # a third alike, and equal entries in the codebook
    rows += [(2, 1, rows[3][2]), (2, 1, rows[3][2]), (None, 0, rows[5][2]), (0, 2, None), (-1, 2, [1.0, None] * 4), (-2, 2, [float("nan")] * 8), (-3, 2, [float("inf")] * 8), (-4, None, [-0.001] * 8)]
    schema = "vec_id long, label int, embedding array<float>, code string, points string"
    frame = spark.createDataFrame([(*r, "c", "p") for r in rows], schema).repartition(5)
    for parts, entries in ((4, 16), (2, 200)):
        assert sorted((tuple(r) for r in vc.codes(frame, parts, entries, 2).collect()), key=repr) == brute_codes(rows, parts, entries, 2)
    small = [r for r in vc.codes(frame.where("vec_id IN (1, 2)"), 4, 64, 2).collect()]
    assert len(small) == 4 and all(len(r.code) == 8 for r in small)
    assert vc.codes(frame.where("false")).collect() == [] == vc.codes(frame.where("embedding IS NULL")).collect()
    other = spark.createDataFrame([(5, 1, [0.5] * 6), (6, 1, [0.25] * 6), (7, 1, [0.5] * 4), (8, 1, []), (9, 1, [3e38] * 6)], "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: (r.code, r.error) for r in vc.codes(other, 4, 64, 1).collect()}  # 6 numbers in 4 parts; other lengths and what exceeds a long go
    assert got == {5: ("00000000", 0), 6: ("01010100", 0)}


def test_blocks_of_vectors_change_nothing(spark, small):
    rows, dim = vc.whole_numbers(spark.read.parquet(f"{small}/embeddings.parquet").limit(300))
    books = vc.start_entries(rows, dim, 16, 64)
    one, many = (vc.trees(rows, dim, 16, block).cache() for block in (10_000, 7))
    assert many.count() > one.count()
    assert (vc.lloyd_round(one, books) == vc.lloyd_round(many, books)).all()
    a, b = (sorted(map(tuple, vc.coded(t, books).collect())) for t in (one, many))
    assert a == b


def test_crc_of_spans():
    rng = np.random.default_rng(2)
    buffer = rng.integers(0, 256, 200_000).astype(np.uint8)
    start = rng.integers(0, 50_000, 400)
    length = rng.integers(0, 300, 400)
    length[:8] = [0, 1, 63, 64, 65, 128, 100_000, 4096]
    for block in (4, 64):
        got = resampling.PositionTable(block).crc32(buffer, start, length)
        assert got.tolist() == [zlib.crc32(buffer[s : s + n].tobytes()) for s, n in zip(start, length)]


def brute_resampled(docs, target, buckets, longest, least_words, percent, seed):
    def feats(t):
        w = lowered(t)
        return Counter(zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1))

    s, t = sum((feats(x) for _, x in docs), Counter()), sum((feats(x) for _, x in target), Counter())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (sum(s.values()) + buckets) / ((s[b] + 1) * (sum(t.values()) + buckets)))) for b in range(buckets)}
    rows = []
    for doc_id, x in docs:
        f = feats(x)
        weight = sum(gain[b] * n for b, n in f.items())
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((len(lowered(x)), doc_id, sum(f.values()), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[0] >= least_words), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2], r[3]))
    n = percent * len(able) // 100
    out = [(*r[1:], k if k <= n else None) for k, r in enumerate(able, 1)] + [(*r[1:], None) for r in rows if r[0] < least_words]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("buckets", "longest", "least", "percent"), [(50, 3, 3, 50), (10_000, 3, 1, 100), (7, 1, 20, 5), (101, 5, 0, 30)])
def test_resampling_of_odd_rows(spark, docs, items, buckets, longest, least, percent):
    got = resampling.resampled(docs, items, buckets, longest, least, percent, 42)
    want = brute_resampled(TEXTS, ITEMS, buckets, longest, least, percent, 42)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_of_empty_tables_and_ties(spark, docs, items):
    assert resampling.resampled(docs.where("false"), items).collect() == []
    none = resampling.resampled(docs, items.where("false"), least_words=1, percent=100).collect()
    assert sorted(r["rank"] for r in none if r["rank"]) == list(range(1, 1 + sum(bool(lowered(t)) for _, t in TEXTS)))
    alike = spark.createDataFrame([(7, "a b c d e")] * 900 + [(k, f"z{k} y x w v") for k in range(100)], "doc_id long, text string").repartition(6)
    got = resampling.resampled(alike, items, least_words=5, percent=40).where("rank IS NOT NULL").collect()
    assert sorted(r["rank"] for r in got) == list(range(1, 401))
    kept = resampling.draw(docs, items, least_words=1, percent=30)
    assert kept.columns == docs.columns and 0 < kept.count() < len(TEXTS)


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_vector_codes", "op13_resampling"])
def test_queries_against_sql(spark, small, name):
    assert oracle.difference(queries.queries()[name](spark, small), queries.oracle_sql()[name], oracle.connection(small)) == ""
