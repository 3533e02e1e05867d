"""The operators for training text against brute force, the tokenizer library, round trips and held-out accuracy."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import oracle
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from watchplan.llm import bpe, chat, exact_dedup, mixing, near_dedup, pii, queries, sharding, token_counts, toxicity, winnow

KEY = b"a test's own key"
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
LONG = " ".join(f"word{k % 977} и{k % 13}" for k in range(40_000))
ODD = [
    (1, None, None, None), (2, "", "en", "src1"), (3, "same  words here\tand THERE", "en", "src1"), (4, "same words here and there", None, "src2"),
    (4, "same words here and there", None, "src2"), (5, " \n\t ", "de", None), (6, "one", "en", "x"), (7, "ONE", "en", "x"), (8, LONG, "en", "src3"), (9, LONG + " tail", "en", "src3"),
    (10, "a <|endoftext|> b  I'll see 'tis \U0001f600\U0001f600 ñandú 123 !!", "es", "src4"), (11, LONG, "en", "src3"), (None, "no identifier", "en", "src1"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, nid long, key string, sha string, bucket int, n_tokens long, segment int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, very long and repeated texts, and columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, None, 5, "k", None, 1, -1, 2) for r in ODD], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def rows_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


def brute_near(rows, words, percent):
    sets = []
    for _, t in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        n = min(words, len(own))
        sets.append({tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if own else set())
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)].append(i)
    ids = [min((x for x in least[find(k)] if x is not None), default=None) for k in range(len(rows))]
    return [(i, len(s), c, i == c) for (i, _), s, c in zip(rows, sets, ids, strict=True)]


def by_key(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("words", [2, 5])
def test_near_dedup_brute_force(spark, docs, odd, words):
    for df in (docs, odd):
        rows = rows_of(df)
        got = [tuple(r) for r in near_dedup.near_groups(df, words, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()]
        assert by_key(got) == by_key(brute_near(rows, words, 80))


def test_near_dedup_large_group(spark):
    """A group beyond a verification block, and a chain whose ends aren't alike."""
    rng = np.random.default_rng(0)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(1300):
        t = list(base)
        t[int(rng.integers(60))] = f"x{rng.integers(10**9)}"
        texts.append(" ".join(t))
    chain = [" ".join(f"c{j}" for j in range(4 * k, 4 * k + 60)) for k in range(12)]
    rows = list(enumerate(texts + chain))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 2, 80).collect()}
    assert got == {i: c for i, _, c, _ in brute_near(rows, 2, 80)}


def test_near_dedup_keeps_one(spark, docs, odd, empty):
    out = near_dedup.keep_one(odd)
    assert out.columns == odd.columns
    assert {r["doc_id"] for r in out.collect()} == {i for i, _, _, kept in brute_near(rows_of(odd), 5, 80) if kept or i is None}
    assert near_dedup.near_groups(empty).count() == near_dedup.keep_one(empty).count() == 0


def test_chat_round_trip(spark, small):
    rows = spark.read.parquet(f"{small}/conversations.parquet").toPandas()
    said = "</s>[INST] ok [/INST]"
    whole = defaultdict(list)
    for r in rows.sort_values(["conv_id", "turn"]).itertuples():
        whole[r.conv_id].append((r.role or "", r.text or ""))
    whole[-7] = [("user", said), ("assistant", said)]
    got = queries.op2_chat_prefix_tree(spark, small).collect()
    assert sorted(r["conv_id"] for r in got) == sorted(whole)
    for r in got:
        turns = whole[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["loss_chars"]) == (len(turns), len(loss))
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert r["formatted_chars"] == sum(len(chat.render(*t)[0]) for t in turns)


@pytest.mark.parametrize("text", ["", "\\", "\\.", "<|turn|>", "\\<|text|>x<|end|>", "</s><s>[INST][/INST]", "<|<|turn|>|>", "<\\.|", "|>|>\\\\."])
def test_chat_escapes(text):
    made, begin, end = chat.render("a<|text|>", text)
    assert chat.unescape(made[begin:end]) == text
    for control in (chat.TURN, chat.TEXT, chat.END, "<s>", "</s>", "[INST]", "[/INST]"):
        assert control not in chat.escape(text)


def test_chat_prefix_tree(spark):
    """Shared turns once, before their branches; positions and attended intervals of each conversation are one gapless run."""
    rows = [(c, t, role, text) for c in range(40) for t, (role, text) in enumerate([("user", "hi"), ("assistant", f"a{c % 4}"), ("user", f"b{c % 8}"), ("assistant", None)])]
    rows += [(99, None, None, None), (98, 0, "user", "hi"), (98, 0, "user", "hi"), (97, 0, "user", "é" * 70_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packed = chat.packs(df).collect()
    for p in packed:
        for c in p["conversations"]:
            chain, at = [], c["leaf"]
            while at >= 0:
                chain.append(p["segments"][at])
                at = chain[-1]["parent"]
            position = 0
            for k, s in enumerate(reversed(chain)):
                assert s["position"] == position
                above = list(reversed(chain))[:k]
                assert [x for a in s["attends"] for x in range(a["begin"], a["end"])] == [x for a in above for x in range(a["begin"], a["end"])]
                position += s["end"] - s["begin"]
    out = {r["conv_id"]: r for r in chat.read_back(chat.packs(df)).collect()}
    assert set(out) == {*range(40), 97, 98, 99}
    assert sum(r["new_chars"] for r in out.values()) == sum(len(p["text"]) for p in packed) < sum(r["formatted_chars"] for r in out.values())
    assert chat.read_back(chat.packs(df.limit(0))).count() == 0


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_toxicity(spark, sf).toPandas()
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    assert ((got["score"] >= 0) & (got["score"] <= 1)).all() and ((got["score"] >= 0.5) == (got["predicted"] == 1)).all()
    labels = spark.read.parquet(f"{sf}/labels.parquet").toPandas()
    m = got[got["held_out"]].merge(labels, on="doc_id")
    rank = m["score"].rank()
    n1, n0 = int((m["toxic"] == 1).sum()), int((m["toxic"] == 0).sum())
    assert (rank[m["toxic"] == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0) > 0.85
    assert m.loc[m["toxic"] == 0, "predicted"].mean() < 0.1


def test_toxicity_ignores_held_out_labels(spark, docs, odd, empty, small):
    labels = spark.read.parquet(f"{small}/labels.parquet").select("doc_id", "toxic")
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    a, b = (toxicity.train(docs, x) for x in (labels, flipped))
    assert a.bias == b.bias and (a.weights == b.weights).all() and (a.ids == b.ids).all()
    assert toxicity.score(odd, a).count() == len(ODD)
    assert toxicity.clean(odd, a).columns == odd.columns
    nothing = toxicity.train(empty, labels.limit(0))
    assert {r["predicted"] for r in toxicity.score(odd, nothing).collect()} == {0} and toxicity.score(empty, a).count() == 0


def test_risk_stays_non_negative():
    """Positives hidden among the unlabelled are found."""
    rng = np.random.default_rng(1)
    bad = [np.array([0, int(rng.integers(2, 30))]) for _ in range(60)]
    mixed = bad[30:] + [np.array([1, int(rng.integers(2, 30))]) for _ in range(170)]
    model = toxicity.fit(np.arange(30), bad[:30], mixed, 0.15)
    w = dict(zip(model.ids.tolist(), model.weights.tolist(), strict=True))
    assert w[0] + model.bias > 0 > w.get(1, 0) + model.bias


def test_mixing_sql_and_odd(spark, small, docs, odd, empty):
    assert oracle.difference(queries.op4_mixing(spark, small), queries.oracle_sql()["op4_mixing"], oracle.connection(small)) == ""
    got = mixing.mix(odd, budget_share=1.0, max_epochs=2.0).toPandas()
    words = sum(len(t.split()) for _, t in rows_of(odd))
    assert got["taken_tokens"].sum() == pytest.approx(words, abs=8)
    assert mixing.mix(empty).count() == 0
    assert mixing.keep_taken(odd, budget_share=1.0, max_epochs=1.0).columns == odd.columns


def test_mixing_budget_goes_to_siblings_first(spark):
    leaves = [("d0", "en", "a", 1, 10), ("d0", "en", "b", 1, 1000), ("d0", "fr", "c", 1, 1000), ("d1", "en", "e", 1, 1000)]
    got = {r["source"]: r["quota"] for r in mixing.quotas(spark.createDataFrame(leaves, "domain string, lang string, source string, docs long, tokens long"), 800.0, 1.0).collect()}
    assert got == {"a": 10, "b": 190, "c": 200, "e": 400}


def test_bpe_as_the_library(docs, odd, empty):
    t = Tokenizer.from_file(VOCABULARY)
    for df in (docs, odd):
        want = []
        for i, text in rows_of(df):
            ids = t.encode(text, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
        assert by_key(tuple(r) for r in bpe.token_digests(df, VOCABULARY).collect()) == by_key(want)
    assert bpe.token_digests(empty, VOCABULARY).count() == 0


def test_token_counts_as_the_library(docs, odd, empty):
    t = Tokenizer.from_file(VOCABULARY)
    for df in (docs, odd):
        want = [(i, len(text.encode()), n := len(t.encode(text, add_special_tokens=False).ids), n > 512) for i, text in rows_of(df)]
        got = token_counts.count_tokens(df, VOCABULARY, 512)
        assert by_key(tuple(r) for r in got.select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()) == by_key(want)
    assert token_counts.count_tokens(empty, VOCABULARY, 512).count() == 0


def test_every_prefix_and_limit():
    t, counter = Tokenizer.from_file(VOCABULARY), token_counts.PrefixCounter(bpe.Vocabulary(VOCABULARY))
    for text in ("  two  blanks don't 'll aaaaaaaaaaaaaaaaaaa\n\n x", "Ünïcode жизнь 日本語 \U0001f600!!", "a<|endoftext|>b <|endof", "'", ""):
        counted = token_counts.CountedText(text, counter)
        want = [len(t.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)]
        assert [counted.at(k) for k in range(len(text) + 1)] == want
        for limit in range(want[-1] + 2):
            assert counted.longest(limit) == max(k for k, n in enumerate(want) if n <= limit)


def test_sharding(spark, docs, odd, empty):
    for df in (docs, odd):
        got = sharding.shards(df, 16).toPandas()
        want = [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in rows_of(df)]
        plain = [(None if pd.isna(i) else int(i), int(s), int(c)) for i, s, c in got[["doc_id", "size", "text_crc32"]].itertuples(index=False)]
        assert by_key(plain) == by_key(want)
        assert (got.groupby("text_crc32")["shard"].nunique() == 1).all()
        assert all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    sizes = sharding.shards(docs, 16).groupBy("shard").sum("size").toPandas()["sum(size)"]
    assert len(sizes) == 16 and sizes.max() <= max(1.02 * sizes.mean(), sharding.shards(docs, 16).groupBy("text_crc32").sum("size").toPandas()["sum(size)"].max())
    assert sharding.shards(empty, 16).count() == 0


def test_differencing_beats_greedy():
    items = [8, 7, 6, 5, 4]
    goes = [g[0] for g in sharding.difference([[x, 0] for x in items], 2)]
    sums = [sum(x for x, g in zip(items, goes, strict=True) if g == k) for k in (0, 1)]
    assert abs(sums[0] - sums[1]) == 2  # greedy ends with 4


def brute_winnow(text, gram, window):
    """Positions by direct search, with the operator's own hashes of single grams."""
    n = min(gram, len(text))
    hashes = [int(winnow.fingerprint(text[k : k + n], gram, 1)[0][0]) for k in range(len(text) - n + 1)] if text else []
    out = []
    for k in range(max(1, len(hashes) - window + 1) if hashes else 0):
        part = hashes[k : k + window]
        at = k + max(j for j, h in enumerate(part) if h == min(part))
        if not out or out[-1] != (hashes[at], at):
            out.append((hashes[at], at))
    return out


@pytest.mark.parametrize("gram,window", [(16, 64), (5, 4), (1, 3), (7, 1)])
def test_winnowing_brute_force(gram, window):
    for text in ("", "a", "abc", "abcabcabcabcabcabc" * 9, "жизнь \U0001f600 " * 30, "".join(chr(97 + k * k % 23) for k in range(300))):
        h, p = winnow.fingerprint(text, gram, window)
        assert list(zip(h.tolist(), p.tolist(), strict=True)) == brute_winnow(text, gram, window)


def test_winnowing_match_guarantee():
    shared = "".join(chr(97 + k * 7 % 26) for k in range(winnow.GRAM + winnow.WINDOW - 1))
    a, b = winnow.fingerprint("x" * 50 + shared + "y" * 90), winnow.fingerprint("qwertz" * 20 + shared)
    assert set(a[0].tolist()) & set(b[0].tolist())


def test_winnowing_edits_and_next(docs, odd, empty):
    for df in (docs, odd):
        rows = sorted(rows_of(df), key=lambda r: (r[0] is None, r[0] or 0))  # rows without doc_id come last; here there is one at most
        got = {(r["doc_id"], r["fingerprint"]): r for r in winnow.fingerprints(df).collect()}
        for k, (i, t) in enumerate(rows):
            if sum(i == j for j, _ in rows) > 1 or (k + 1 < len(rows) and sum(rows[k + 1][0] == j for j, _ in rows) > 1):
                continue
            following = rows[(k + 1) % len(rows)][1]
            half = len(t) // 2
            changed = t[: len(t) - half] + following[:half]
            print_, other, after = (winnow.fingerprint(x) for x in (t, changed, following))
            r = got[i, winnow.as_string(print_)]
            assert (r["n_chars"], r["edited_sha256"], r["edited_fingerprint"]) == (len(t), hashlib.sha256(changed.encode()).hexdigest(), winnow.as_string(other))
            assert (r["near_edited"], r["near_next"]) == (winnow.likeness(print_[0], other[0]), winnow.likeness(print_[0], after[0]))
    assert winnow.fingerprints(empty).count() == 0


def test_surrogates(spark, docs, odd, empty):
    text = "Write to Ann.Lee@mail.example or +49 30 1234567, card 4111 1111 1111 1111, ip 10.20.30.40. Mrs Clara Weber met Г-жа Анна Иванова."
    extra = spark.createDataFrame([(1, text), (2, text + " again ann.lee@mail.example; other bob.lee@mail.example"), (3, None), (3, None), (4, "")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replaced(extra, KEY).collect()}
    assert {e["kind"] for e in got[1]["entities"]} == {"email", "phone", "card", "ip", "name"}
    for secret in ("Ann.Lee", "1234567", "4111 1111", "10.20.30.40", "Clara Weber", "Анна Иванова"):
        assert secret not in got[1]["text"] and secret not in got[2]["text"]
    assert re.sub(r"\w", "", got[1]["text"].replace("Mrs", "")) == re.sub(r"\w", "", text.replace("Mrs", ""))
    assert got[2]["text"].startswith(got[1]["text"])  # one entity, one surrogate
    mails = [e["surrogate"] for e in got[2]["entities"] if e["kind"] == "email"]
    assert mails[0].lower() == mails[1] != mails[2]
    assert got[4]["text"] == "" and got[4]["n_entities"] == 0 and got[3]["text"] == ""
    assert pii.replaced(odd, KEY).count() == len(ODD) and pii.replaced(empty, KEY).count() == 0
    seen = {p[2:] for _, t in rows_of(docs) for e in pii.detect(t) for p in e.parts}
    out = pii.replaced(docs, KEY).collect()
    source = dict(rows_of(docs))
    back = defaultdict(set)
    for r in out:
        for e, d in zip(r["entities"], pii.detect(source[r["doc_id"]]), strict=True):
            back[e["kind"], e["surrogate"].lower()].add(d.canonical)
            again = [x for x in pii.detect(e["surrogate"]) if x.kind == e["kind"]]
            assert not {(x.kind, x.canonical) for x in again} & seen  # no one's real data
    assert all(len(v) == 1 for v in back.values())


def test_permutation():
    s = pii.Surrogates(b"k")
    assert sorted(s._permuted(x, 1000, "t") for x in range(1000)) == list(range(1000))


@pytest.mark.parametrize("keep,bits", [("largest", 256), ("smallest", 256), ("largest", 8)])
def test_exact_dedup_brute_force(docs, odd, empty, keep, bits):
    for df in (docs, odd):
        rows = rows_of(df)
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        got = exact_dedup.exact_groups(df, keep, bits).collect()
        choose = max if keep == "largest" else min
        want = [(i, choose((x for x in groups[t] if x is not None), default=None), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
        assert by_key((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == by_key(want)
        kept = [r for r in got if r["kept"]]
        assert len(kept) == len(groups) == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.exact_groups(empty, keep, bits).count() == 0
    left = exact_dedup.drop_copies(odd, keep)
    assert left.columns == odd.columns and left.count() == len({t for _, t in rows_of(odd)})


def test_exact_dedup_segments_without_hits(spark):
    """More index segments than digests: most have no hit, some no key."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "61")
    try:
        df = spark.createDataFrame([(k, f"t{k % 90}") for k in range(120)], "doc_id long, text string").repartition(7)
        assert exact_dedup.exact_groups(df).where("kept").count() == 90
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_exact_dedup_sql(spark, small):
    assert oracle.difference(queries.op10_exact_dedup(spark, small), queries.oracle_sql()["op10_exact_dedup"], oracle.connection(small)) == ""
    assert duckdb.__version__
