"""MinHash near-dedup with tensored banding and exact verification.

Two collections of t small groups of minhashes are computed; every pair (group i of the first, group j
of the second) is one table's key, so t * t tables of 2 * r minhashes each cost 2 * t * r minhashes
instead of 2 * t * t * r.  Documents that share a key become candidates, and only links confirmed on full
shingle sets count.  First each candidate meets its likest bucket leader: one comparison a document, which
joins most of a large group of copies into one part.  Documents of a cluster that are still in different
parts are then compared exactly, in blocks; documents of one part need not be.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchplan.llm.common import TEXT_JOIN_BYTES, broadcast_if_small, components, forest_roots, join_groups, texts, workspace, written

#: Groups a collection, minhashes a group: 100 tables of 4 from 40 minhashes.  A pair of likeness 0.8
#: is missed with probability 1 - (1 - (1 - 0.8**2)**10)**2 < 1e-4, more alike pairs far less often.
GROUPS, GROUP_SIZE = 10, 2
#: Candidates whose minhashes agree in a smaller share aren't joined to a bucket's first member (of 40 that agree with
#: probability 0.8 each, fewer than 14 do with probability < 1e-9).
LEAST_AGREEMENT = 0.35
#: Documents of a verification block.
BLOCK = 512
_ODD = np.random.default_rng(20).integers(1, 1 << 62, 2 * GROUPS * GROUP_SIZE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str, words: int = 2) -> np.ndarray:
    """Distinct 64-bit hashes of a text's word shingles, ascending; A-Z in lower case, words are what isn't white space.

    With fewer words the whole sequence is one shingle; without any there is none.
    """
    own = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and \x20\x09-\x0D alone
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, own), np.uint64, len(own))
    size = min(words, h.size)
    out = np.full(h.size - size + 1, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : h.size - size + 1 + k])
    return np.unique(out)


def minhashes(s: np.ndarray) -> np.ndarray:
    low = np.full(_ODD.size, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, s.size, 8192):
        low = np.minimum(low, (s[at : at + 8192, None] * _ODD).min(0))
    return low


def _hashed(docs: DataFrame) -> DataFrame:
    return texts(docs).withColumn("sha", F.sha2(F.col("text").cast("binary"), 256))


def signatures(docs: DataFrame, words: int) -> DataFrame:
    """nid (a row's own number), doc_id, sha (of the text), n_shingles, set_key, a, b (t group keys each), sig (a byte for each minhash)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nid = TaskContext.get().partitionId() << 33
        salt = np.arange(2 * GROUPS, dtype=np.uint64)
        for pdf in batches:
            out = []
            for doc_id, text, sha in zip(pdf["doc_id"], pdf["text"], pdf["sha"], strict=True):
                s = shingles(text, words)
                if s.size:
                    m = minhashes(s)
                    group = salt.copy()
                    for k in range(GROUP_SIZE):
                        group = _mix(group * np.uint64(0xC2B2AE3D27D4EB4F) + m[k::GROUP_SIZE])
                    keys = group.view(np.int64).tolist()
                    out.append((nid, doc_id, sha, s.size, xxhash.xxh3_128_hexdigest(s.tobytes()), keys[:GROUPS], keys[GROUPS:], (m >> np.uint64(56)).astype(np.uint8).tobytes()))
                else:
                    out.append((nid, doc_id, sha, 0, None, None, None, None))
                nid += 1
            frame = pd.DataFrame(out, columns=["nid", "doc_id", "sha", "n_shingles", "set_key", "a", "b", "sig"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return _hashed(docs).mapInPandas(run, "nid long, doc_id long, sha string, n_shingles long, set_key string, a array<long>, b array<long>, sig binary")


def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series(dtype="float64")
    x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1) for s in (a, b))
    return pd.Series((x == y).mean(1))


def candidate_edges(classes: DataFrame, folder: str) -> DataFrame:
    """Edges (a, b, agreement): each member of a table's bucket with the bucket's first member, if their minhashes agree enough.

    A class has one row in each of t * t buckets, so that even a third of all documents in one bucket
    of every table is no more than that share of a task's rows; the window streams from sorted, spillable rows.
    """
    rows = classes.select("nid", F.explode("a").alias("x"), "b").select("nid", "x", F.explode("b").alias("y")).select("nid", F.xxhash64("x", "y").alias("key"))
    first = F.expr("min(nid) over (partition by key)")
    stars = written(rows.withColumn("first", first).where("first <> nid").select("first", "nid").distinct(), folder, "stars")
    sig = classes.select("nid", "sig")
    both = stars.join(sig.hint("merge"), "nid").join(sig.select(F.col("nid").alias("first"), F.col("sig").alias("first_sig")).hint("merge"), "first")
    edges = both.select(F.col("first").alias("a"), F.col("nid").alias("b"), F.pandas_udf(_agreement, "double")("sig", "first_sig").alias("agreement"))
    return written(edges.where(F.col("agreement") >= LEAST_AGREEMENT), folder, "edges")


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Matrix of whether set left[i] and set right[j] have at least percent % of their union in common."""
    used = np.union1d(left, right)
    place = np.full(len(sets), -1)
    place[used] = np.arange(used.size)
    flat = np.concatenate([sets[k] for k in used])
    owner = np.repeat(np.arange(used.size), [sets[k].size for k in used])
    values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # a shingle of one set is in no intersection
    column = np.where(shared, np.cumsum(shared) - 1, -1)[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((left.size, right.size), np.float32)
    step = max(256, (1 << 22) // max(1, used.size))
    for at in range(0, int(shared.sum()), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        x = np.zeros((used.size, min(step, int(shared.sum()) - at)), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        both += x[place[left]] @ x[place[right]].T
    size = np.array([s.size for s in sets], np.int64)
    common = np.rint(both).astype(np.int64)
    return 100 * common >= percent * (size[left][:, None] + size[right][None, :] - common)


def _forest(match: np.ndarray, left: np.ndarray, right: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (member, least member) that connect what the links of match connect."""
    i, j = np.nonzero(match)
    a, b = left[i], right[j]
    label = np.arange(int(max(left.max(initial=0), right.max(initial=0))) + 1)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(k, int(label[k])) for k in np.unique(np.concatenate([a, b])).tolist() if label[k] != k]


def owners(edges: DataFrame, classes: DataFrame, folder: str) -> DataFrame:
    """(nid, doc_id, sha, leader, salt, salts) of the candidates: the likest leader of each (null: none), and how many tasks its own followers are dealt to (0: none)."""
    best = edges.groupBy("b").agg(F.max(F.struct("agreement", (-F.col("a")).alias("a"))).alias("t")).select(F.col("b").alias("nid"), (-F.col("t.a")).alias("leader"))
    best = written(best, folder, "best", edges.count())
    n = best.count()
    leads = written(best.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("salts")), folder, "leads", n)
    leads_n = leads.count()
    of_leader = broadcast_if_small(leads.withColumnRenamed("salts", "of_leader"), 24, leads_n)
    members = best.join(of_leader, "leader").select("nid", "leader", F.pmod(F.xxhash64("nid"), F.col("of_leader")).cast("int").alias("salt"))
    all_ = members.unionByName(leads.select(F.col("leader").alias("nid")).join(best.select("nid"), "nid", "left_anti").select("nid", F.lit(None).cast("long").alias("leader"), F.lit(0).alias("salt")))
    all_ = all_.join(broadcast_if_small(leads.withColumnRenamed("leader", "nid"), 24, leads_n), "nid", "left").withColumn("salts", F.coalesce("salts", F.lit(0)))
    out = classes.select("nid", "own.doc_id", "own.sha").join(broadcast_if_small(all_, 40, n + leads_n), "nid")
    return written(out, folder, "owners")


def sure_edges(sets: DataFrame, percent: int) -> DataFrame:
    """Edges (node, parent) between each candidate and its likest leader that are links on full sets: one comparison a candidate.

    Rows go to their leader, in one shuffle; the followers of a leader with many are dealt to several tasks, and the leader to
    each of them.
    """
    mine = sets.where("leader is not null").select(F.col("leader").alias("at"), "salt", F.lit(1).alias("follows"), "nid", "words")
    own = sets.where("salts > 0").select(F.col("nid").alias("at"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("follows"), "nid", "words")
    n = int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = mine.unionByName(own).repartition(n, "at", "salt").sortWithinPartitions("at", "salt", "follows")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, leader = None, None
        for pdf in batches:
            out = []
            for where, salt, follows, nid, words in pdf.itertuples(index=False, name=None):
                s = np.frombuffer(words, np.uint64)
                if not follows:
                    at, leader = (where, salt), s
                elif at == (where, salt):
                    common = np.intersect1d(s, leader, assume_unique=True).size
                    if 100 * common >= percent * (s.size + leader.size - common):
                        out.append((nid, where))
            yield pd.DataFrame(out, columns=["node", "parent"], dtype="int64")

    return dealt.mapInPandas(run, "node long, parent long")


def blocks_of_parts(located: DataFrame, folder: str, percent: int) -> DataFrame:
    """Of located (nid, cluster, part, n_shingles): (cluster, band, lo, hi, block, role, part, nid), the groups in which documents meet.

    Documents of one cluster and different parts meet if their sizes allow a link (bands of a factor 100/percent,
    each with the next).  A band of up to BLOCK rows is one block.  In a larger one the rows of its
    largest part have blocks of their own, which meet the others' blocks and not each other: a group of n
    copies with s stragglers costs n * s comparisons, not n * n, and no task holds more than two blocks.
    """
    key = ["cluster", "band"]
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    # role 0: in its own band; role 1: beside the band below
    unit = located.withColumn("own_band", band).select("cluster", "part", "nid", F.posexplode(F.array(F.col("own_band"), F.col("own_band") - 1)).alias("role", "band"))
    unit = written(unit, folder, "units")
    per = unit.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("role") == 0).cast("long")).alias("own"))
    sizes = per.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("own").alias("own"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "part")).alias("top")).where("own > 0 and parts > 1")
    of = lambda n: F.ceil(n / BLOCK).cast("int")
    small = F.col("n") <= BLOCK
    sizes = sizes.select(*key, "n", F.col("top.part").alias("main"), F.when(small, 0).otherwise(of(F.col("top.n"))).alias("of_main"), F.when(small, 1).otherwise(of(F.col("n") - F.col("top.n"))).alias("of_rest"))
    sizes = written(sizes, folder, "sizes")
    # large bands are few and known everywhere; only small ones are joined by a shuffle, if they are too many to broadcast
    large = broadcast_if_small(sizes.where(F.col("n") > BLOCK), 64)
    placed = unit.join(large, key).unionByName(unit.join(large.select(*key), key, "left_anti").join(broadcast_if_small(sizes.where(small), 64), key))
    in_main = (F.col("part") == F.col("main")) & (F.col("of_main") > 0)
    hashed = lambda n: F.pmod(F.xxhash64("nid"), n).cast("int")
    placed = placed.withColumn("block", F.when(in_main, hashed(F.greatest(F.col("of_main"), F.lit(1)))).otherwise(F.col("of_main") + hashed(F.col("of_rest"))))
    met = placed.withColumn("other", F.explode(F.sequence(F.when(in_main, F.col("of_main")).otherwise(F.lit(0)), F.col("of_main") + F.col("of_rest") - 1)))
    return met.select(*key, F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "role", "part", "nid")


def verified_edges(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between parts that links on full sets connect, of the groups that blocks_of_parts makes."""
    key = ["cluster", "band", "lo", "hi"]
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.join(sets.select("nid", "words"), "nid").repartition(n, *key).sortWithinPartitions(*key, "nid")

    def group(rows: list[tuple]) -> list[tuple[int, int]]:
        part, role, block = (np.array([r[k] for r in rows]) for k in (6, 5, 4))
        if len(rows) < 2:
            return []
        sets_ = [np.frombuffer(r[7], np.uint64) for r in rows]
        lo, hi = rows[0][2], rows[0][3]
        out: set[tuple[int, int]] = set()
        everything = np.arange(len(rows))
        for own, other in ((lo, hi), (hi, lo)) if lo != hi else ((lo, hi),):
            left, right = everything[(role == 0) & (block == own)], everything[block == other]
            if lo != hi and own == hi:
                right = right[role[right] == 1]  # role 0 of both blocks met already
            if not left.size or not right.size:
                continue
            match = _linked(sets_, left, right, percent)
            match &= part[left][:, None] != part[right][None, :]
            out |= {(int(part[a]), int(part[b])) for a, b in _forest(match, left, right)}
        return sorted(p for p in out if p[0] != p[1])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False, name=None):
                if rows and row[:4] != rows[0][:4]:
                    out += group(rows)
                    rows = []
                rows.append(row)
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        if rows:
            yield pd.DataFrame(group(rows), columns=["a", "b"], dtype="int64")

    return dealt.select(*key, "block", "role", "part", "words").mapInPandas(run, "a long, b long")


def _roots(docs: DataFrame, classes: DataFrame, folder: str, words: int, percent: int) -> DataFrame:
    """(nid, root) of the classes that links join with a lesser one."""
    edges = candidate_edges(classes, folder)
    # full sets, for candidates alone
    sets = _full_sets(docs, owners(edges, classes, folder), words, folder)
    parts = forest_roots(sure_edges(sets, percent), folder, "parts")
    # candidates that are still apart: edges between parts, and the clusters of parts that these make
    n_parts = parts.count()
    up = lambda c: broadcast_if_small(parts.select(F.col("node").alias(c), F.col("root").alias(f"{c}_part")), 32, n_parts)
    apart = edges.select("a", "b").join(up("a"), "a", "left").join(up("b"), "b", "left").select(F.coalesce("a_part", "a").alias("a"), F.coalesce("b_part", "b").alias("b")).where("a <> b")
    clusters = components(apart, folder, "clusters")
    clusters = clusters.select(F.col("node").alias("part"), F.col("root").alias("cluster")).unionByName(clusters.select(F.col("root").alias("part"), F.col("root").alias("cluster")).distinct())
    clusters = broadcast_if_small(written(clusters, folder, "open"), 24)
    located = written(sets.select("nid", "n_shingles").join(broadcast_if_small(parts.withColumnRenamed("node", "nid"), 32, n_parts), "nid", "left").select("nid", "n_shingles", F.coalesce("root", "nid").alias("part")).join(clusters, "part"), folder, "located")
    met = written(blocks_of_parts(located, folder, percent), folder, "met")
    mine = sets.join(broadcast_if_small(met.select("nid").distinct(), 16), "nid", "left_semi")
    more = components(verified_edges(met, mine, percent), folder, "links").select(F.col("node").alias("part"), F.col("root").alias("more"))
    known = broadcast_if_small(more, 32)
    out = parts.withColumnRenamed("root", "part").unionByName(more.select(F.col("part").alias("node"), "part"))  # parts' own roots may go on, too
    return out.join(known, "part", "left").select(F.col("node").alias("nid"), F.coalesce("more", "part").alias("root")).where("nid <> root")


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """A row per row of docs: doc_id, sha (of its text), n_shingles, component_id, and root, which tells groups apart (null without shingles)."""
    folder = workspace(docs.sparkSession)
    rows = written(signatures(docs, words), folder, "signatures")
    classes = rows.where("set_key is not null").groupBy("set_key", "n_shingles", "a", "b", "sig").agg(F.min("nid").alias("nid"), F.min("doc_id").alias("least_doc"), F.min_by(F.struct("doc_id", "sha"), "nid").alias("own"))
    classes = written(classes, folder, "classes")
    named = classes.join(_roots(docs, classes, folder, words, percent), "nid", "left").select("set_key", "least_doc", F.coalesce("root", "nid").alias("root"))
    named = written(named, folder, "named")
    least = written(named.groupBy("root").agg(F.min("least_doc").alias("component_id"), F.count(F.lit(1)).alias("_n")), folder, "least")
    final = join_groups(named, least, "root", 60).select("set_key", "root", "component_id")
    return rows.select("doc_id", "sha", "n_shingles", "set_key").join(final, "set_key", "left").select("doc_id", "sha", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), "root")


def near_groups(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """A row per row of docs: doc_id, n_shingles, component_id, kept; links are sets with percent % of their union in common.

    component_id is the least doc_id that links reach.  Null texts count as empty; texts without words
    have no shingle and are linked with nothing, not even each other: their component_id is their own
    doc_id.  Rows with equal sets (copies, repeated rows) are one class before anything is compared.
    """
    out = _grouped(docs, words, percent)
    return out.select("doc_id", "n_shingles", "component_id", F.col("component_id").eqNullSafe(F.col("doc_id")).alias("kept"))


def _full_sets(docs: DataFrame, owner: DataFrame, words: int, folder: str) -> DataFrame:
    """nid, n_shingles, leader, salt, salts, words (the set's hashes packed) of the owners, made from their texts again."""
    names = ["nid", "n_shingles", "leader", "salt", "salts", "words"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        met: set[int] = set()  # a row that repeats an owner's doc_id and text makes the same set
        for pdf in batches:
            new = pdf[[not (i in met or met.add(i)) for i in pdf["nid"].tolist()]]
            sets = [shingles(text, words) for text in new["text"]]
            leader = new["leader"].astype("Int64")
            yield pd.DataFrame({"nid": new["nid"], "n_shingles": [s.size for s in sets], "leader": leader.where(new["has"]), "salt": new["salt"], "salts": new["salts"], "words": [s.tobytes() for s in sets]}, columns=names)

    # a null leader goes as 0 with has false: pandas would make floats of the column
    few = owner.select("nid", F.coalesce("leader", F.lit(0)).alias("leader"), F.col("leader").isNotNull().alias("has"), "salt", "salts", F.col("doc_id").alias("own_id"), F.col("sha").alias("own_sha"))
    joined = _hashed(docs).join(broadcast_if_small(few, 150, most=TEXT_JOIN_BYTES), F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("sha") == F.col("own_sha")))
    sets = written(joined.select("nid", "leader", "has", "salt", "salts", "text").mapInPandas(run, "nid long, n_shingles long, leader long, salt int, salts int, words binary"), folder, "sets")
    twice = sets.groupBy("nid").count().where("count > 1")  # made by several tasks; ids alone are shuffled to see it
    return sets if twice.isEmpty() else written(sets.dropDuplicates(["nid"]), folder, "sets-once")


def keep_one(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each group of near-duplicates, all columns kept.

    It is the row with the least doc_id (null ids last), of several such the one with the least text digest, of
    equal ones any.  Decisions go by doc_id and text together, so rows that repeat a doc_id with another text are told apart.  Rows
    without words are in no group and all stay.
    """
    rows = written(_grouped(docs, words, percent), workspace(docs.sparkSession), "grouped")
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "sha")
    top = written(rows.where("root is not null").groupBy("root").agg(F.min(first).alias("top"), F.count(F.lit(1)).alias("_n")).where("_n > 1"), workspace(docs.sparkSession), "tops")
    both = join_groups(rows, top, "root", 200).withColumn("stays", (first == F.col("top")))
    gone = written(both.groupBy("doc_id", "sha").agg(F.first("stays").alias("stays"), F.count(F.lit(1)).alias("n")).where("not stays or n > 1"), workspace(docs.sparkSession), "gone")
    gone_side = gone.where("not stays").select(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha"))
    sha = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    left = docs.join(broadcast_if_small(gone_side, 150, most=TEXT_JOIN_BYTES), docs["doc_id"].cast("long").eqNullSafe(F.col("gone_id")) & (sha == F.col("gone_sha")), "left_anti")
    twice = gone.where("stays").select(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha"))
    if twice.isEmpty():
        return left
    again = docs["doc_id"].cast("long").eqNullSafe(F.col("gone_id")) & (sha == F.col("gone_sha"))
    twice = broadcast_if_small(twice, 150, most=TEXT_JOIN_BYTES)
    return left.join(twice, again, "left_anti").unionByName(left.join(twice, again, "left_semi").dropDuplicates(["doc_id", "text"]))
