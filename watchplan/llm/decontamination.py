"""Benchmark decontamination over suffix arrays of the training text.

Each task takes its documents in shards, numbers their words by the benchmark's vocabulary and builds the suffix
array of a shard: all its suffixes that begin with a benchmark word, sorted by their first words, as many as the longest item has.
Every suffix of every item is then searched by bisection, all at once; the lengths of its common prefixes with its neighbours in the
array give its longest verbatim match, the range of suffixes that share a whole window the window's occurrences.

The benchmark goes to the tasks in blocks of bounded size, one pass over the documents for each; one block holds some
millions of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchplan.llm.common import texts, workspace, written
from watchplan.llm.spans import words_of

#: Bytes of text of one block of the benchmark.
BLOCK_BYTES = 8 << 20
#: Words of one shard, unless one text alone has more.
SHARD_WORDS = 400_000


@dataclass
class Items:
    """A block of the benchmark: words by number, from 1; items one after another, a 0 after each."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    token: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: each item's name and, for each place, its item's end and item
    item_name: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    end: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    item: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    @classmethod
    def of(cls, rows: list[tuple[str, bytes]]) -> Items:
        out, tokens, names = cls(), [], {}
        item_name, ends, item = [], [], []
        for name, text in rows:
            words = words_of(text)
            if not words:
                continue
            base = sum(map(len, tokens))
            tokens.append(np.array([out.vocabulary.setdefault(w, len(out.vocabulary) + 1) for w in words] + [0], np.int64))
            ends.append(np.full(len(words) + 1, base + len(words)))
            item.append(np.full(len(words) + 1, len(item_name)))
            item_name.append(names.setdefault(name, len(names)))
        if tokens:
            out.token, out.end, out.item = np.concatenate(tokens), np.concatenate(ends), np.concatenate(item)
        out.names, out.item_name = list(names), np.array(item_name, np.int64)
        return out

    def longest(self) -> int:
        at = np.flatnonzero(self.token)
        return int((self.end[at] - at).max(initial=0))

    def windows(self, words: int) -> tuple[np.ndarray, np.ndarray]:
        """(place, length) of every window: so many consecutive words of an item, or all words of a shorter one."""
        at = np.flatnonzero(self.token)
        left = self.end[at] - at
        first = np.concatenate([[True], self.item[at][1:] != self.item[at][:-1]]) if len(at) else np.zeros(0, bool)
        take = (left >= words) | first
        return at[take], np.minimum(left[take], words)


def suffix_array(token: np.ndarray, longest: int, vocabulary: int) -> np.ndarray:
    """Places of the nonzero tokens, sorted by the longest tokens that follow from there; beyond the end comes 0.

    The first key packs as many tokens as a long holds; each later round doubles the length that is sorted.
    """
    n = len(token)
    bits = max(1, int(vocabulary).bit_length())
    width = max(1, min(63 // bits, longest))
    padded = np.concatenate([token, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(width):
        key = (key << bits) | padded[k : k + n]
    places = np.flatnonzero(token)
    rank = np.zeros(n + 1, np.int64)  # 0 for zeros: smaller than all others
    order = places[np.argsort(key[places], kind="stable")]
    ordered, done = key[order], width
    while True:
        new = np.concatenate([[1], 1 + np.cumsum(ordered[1:] != ordered[:-1])]) if len(order) else np.zeros(0, np.int64)
        rank[order] = new
        if done >= longest or not len(order) or new[-1] == len(order):
            return order
        key = rank[places] * (n + 1) + rank[np.minimum(places + done, n)]
        by = np.argsort(key, kind="stable")
        order, ordered, done = places[by], key[by], 2 * done


def _common(shard: np.ndarray, at: np.ndarray, query: np.ndarray, place: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Tokens that shard from at and query from place have in common, at most so many each."""
    length = np.zeros(len(at), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        a, b = at[live] + length[live], place[live] + length[live]
        ok = (a < len(shard)) & (shard[np.minimum(a, len(shard) - 1)] == query[b])
        live = live[ok]
        length[live] += 1
        live = live[length[live] < most[live]]
    return length


def bisect(shard: np.ndarray, array: np.ndarray, query: np.ndarray, place: np.ndarray, length: np.ndarray, after: bool) -> np.ndarray:
    """How many suffixes of the array are less than query[place : place + length]; with after, also those that begin with it."""
    lo, hi = np.zeros(len(place), np.int64), np.full(len(place), len(array), np.int64)
    live = np.flatnonzero(lo < hi)
    while len(live):
        mid = (lo[live] + hi[live]) // 2
        at = array[mid]
        same = _common(shard, at, query, place[live], length[live])
        whole = same == length[live]
        x = np.minimum(at + same, len(shard) - 1)
        mine = np.where(at + same < len(shard), shard[x], 0)
        less = np.where(whole, after, mine < query[np.minimum(place[live] + same, len(query) - 1)])
        lo[live[less]] = mid[less] + 1
        hi[live[~less]] = mid[~less]
        live = live[lo[live] < hi[live]]
    return lo


@dataclass
class Shard:
    """Documents one after another, a 0 after each; words outside the benchmark's vocabulary are 0."""

    token: np.ndarray
    begin: np.ndarray  # of each document, and the end
    array: np.ndarray

    @classmethod
    def of(cls, numbers: list[np.ndarray], items: Items, least: int, depth: int) -> Shard:
        """Suffixes sorted by their first depth words.  Runs of known words shorter than least, the shortest match that counts, are left out."""
        token = np.concatenate([x for n in numbers for x in (n, np.zeros(1, np.int64))])
        begin = np.concatenate([[0], np.cumsum([len(n) + 1 for n in numbers])])
        known = token > 0
        edge = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        start, end = edge[::2], edge[1::2]
        long = end - start >= least
        searched = np.zeros(len(token), bool)
        size = (end - start)[long]
        searched[np.repeat(start[long], size) + np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = True
        return cls(token, begin, suffix_array(np.where(searched, token, 0), depth, len(items.vocabulary)))

    def document(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, place, "right") - 1

    def occurrences(self, items: Items, place: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which window, place in the shard) of all occurrences of windows."""
        lo = bisect(self.token, self.array, items.token, place, length, False)
        hi = bisect(self.token, self.array, items.token, place, length, True)
        n = hi - lo
        which = np.repeat(np.arange(len(place)), n)
        return which, self.array[np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)]

    def longest(self, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in items, words, place in the shard) of each item suffix's longest match, the first in the array of equal ones."""
        place = np.flatnonzero(items.token)
        left = items.end[place] - place
        at = bisect(self.token, self.array, items.token, place, left, False)
        best, where = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        for k in (at - 1, at):
            ok = (k >= 0) & (k < len(self.array))
            there = self.array[np.clip(k, 0, max(len(self.array) - 1, 0))] if len(self.array) else np.zeros(len(place), np.int64)
            same = np.where(ok, _common(self.token, there, items.token, place, np.where(ok, left, 0)), 0)
            better = same > best
            best, where = np.where(better, same, best), np.where(better, there, where)
        return place, best, where


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, bytes]]]:
    """Rows (item_id, text) of the benchmark in blocks of bounded size, read a partition at a time; a null id is an empty name."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("name"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    held, size = [], 0
    for r in rows.toLocalIterator():
        if held and size + len(r["text"]) > block_bytes:
            yield held
            held, size = [], 0
        held.append((r["name"], bytes(r["text"])))
        size += len(r["text"])
    if held:
        yield held


def _shards(batches: Iterator[pa.RecordBatch], items: Items, least: int, depth: int, most_words: int) -> Iterator[tuple[list, Shard, list[int]]]:
    """(keys, shard, words of each) of a task's documents; batches are (key, text)."""
    number = items.vocabulary.get
    keys, held, size = [], [], 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = words_of(text)
            keys.append(key)
            held.append(np.fromiter(map(number, words, repeat(0)), np.int64, len(words)))
            size += len(words)
            if size >= most_words:
                yield keys, Shard.of(held, items, least, depth), [len(h) for h in held]
                keys, held, size = [], [], 0
    if keys:
        yield keys, Shard.of(held, items, least, depth), [len(h) for h in held]


def window_hits(rows: DataFrame, block: list[tuple[str, bytes]], words: int, most_words: int = SHARD_WORDS) -> DataFrame:
    """row, n_words, the hit stretches of words (starts, ends, apart and ascending) and items of each of rows (row, text as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items.of(block)
        place, length = items.windows(words)
        if len(place):  # windows that read alike are one, with several items
            shape = np.zeros((len(place), words), np.int64)
            for k in range(words):
                on = length > k
                shape[on, k] = items.token[place[on] + k]
            _, first, same = np.unique(shape, axis=0, return_index=True, return_inverse=True)
            same = same.ravel()
            name = items.item_name[items.item[place]]
            pairs = np.unique(np.stack([same, name], 1), axis=0)
            name_from = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
            place, length = place[first], length[first]
        least = int(length.min(initial=words))
        for keys, shard, sizes in _shards(batches, items, least, words, most_words):
            which, at = shard.occurrences(items, place, length)
            step = np.bincount(at, minlength=len(shard.token)) - np.bincount(at + length[which], minlength=len(shard.token))
            hit = np.cumsum(step) > 0
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
            start, end = edge[::2], edge[1::2]  # the 0 between documents is never hit
            doc = shard.document(start)
            cut = np.searchsorted(doc, np.arange(len(keys) + 1))
            met = np.unique(np.stack([shard.document(at), which], 1), axis=0) if len(at) else np.zeros((0, 2), np.int64)
            met_cut = np.searchsorted(met[:, 0], np.arange(len(keys) + 1))
            starts, ends, found = [], [], []
            for d in range(len(keys)):
                some = slice(cut[d], cut[d + 1])
                starts.append((start[some] - shard.begin[d]).tolist())
                ends.append((end[some] - shard.begin[d]).tolist())
                own = met[met_cut[d] : met_cut[d + 1], 1]
                found.append(sorted({items.names[k] for w in own for k in pairs[name_from[w] : name_from[w + 1], 1]}) if len(own) else [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, key_type), pa.array(sizes, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(ends, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.string()))],
                ["row", "n_words", "starts", "ends", "items"],
            )

    key = rows.schema["row"].dataType.simpleString()
    key_type = pa.string() if key == "string" else pa.int64()
    return rows.mapInArrow(run, f"row {key}, n_words long, starts array<int>, ends array<int>, items array<string>")


def _row_hits(rows: DataFrame, benchmark: DataFrame, words: int, block_bytes: int, shard_words: int) -> DataFrame:
    """row, n_words, starts, ends, items of each of rows (row, text as bytes).

    One block of the benchmark is one pass without a shuffle, in which row needs not tell rows apart.  With more of them it must,
    in every pass: each block's hits are written, and the rows that any block hits are merged.
    """
    blocks = item_blocks(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return window_hits(rows, first, words, shard_words)
    folder = workspace(rows.sparkSession)
    kept = ["row", "starts", "ends", "items"]
    base = written(window_hits(rows, first, words, shard_words), folder, "hits-0")
    every = base.where(F.size("items") > 0).select(*kept)
    for k, block in enumerate(chain([second], blocks), 1):
        every = every.unionByName(written(window_hits(rows, block, words, shard_words).where(F.size("items") > 0).select(*kept), folder, f"hits-{k}"))
    stretch = every.select("row", F.explode(F.arrays_zip("starts", "ends")).alias("s")).select("row", F.col("s.starts").alias("start"), F.col("s.ends").alias("end"))
    named = every.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = base.select("row", "n_words").join(_joined_stretches(stretch), "row", "left").join(named, "row", "left")
    none = F.array().cast("array<int>")
    return out.select("row", "n_words", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def hits(docs: DataFrame, benchmark: DataFrame, words: int = 10, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """doc_id, n_words, starts, ends, items of every row of docs: its stretches of hit words, and the items whose windows it has.

    A window is so many consecutive words of an item, or the whole of a shorter item that has any; a word inside any occurrence of a window is hit.
    Null and empty texts have no words; rows that repeat a doc_id are rows of their own; items that repeat an item_id are one
    item, those without one are one item of an empty name; an item without words has no window.  Without items nothing is hit.
    Further columns are left out.
    """
    rows = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    blocks = item_blocks(benchmark, block_bytes)
    next(blocks, None)
    if next(blocks, None) is None:
        return _row_hits(rows.withColumnRenamed("doc_id", "row"), benchmark, words, block_bytes, shard_words).withColumnRenamed("row", "doc_id")
    # with several passes rows need numbers that stay the same
    numbered = written(rows.withColumn("row", F.monotonically_increasing_id()), workspace(docs.sparkSession), "rows")
    found = _row_hits(numbered.select("row", "text"), benchmark, words, block_bytes, shard_words)
    return numbered.select("row", "doc_id").join(found, "row").drop("row")


def _joined_stretches(s: DataFrame) -> DataFrame:
    """(row, starts, ends) of (row, start, end): stretches that overlap or touch become one; a row's are those of one document."""

    def merge(rows):
        ordered = F.array_sort(rows)
        empty = F.array().cast("array<struct<start:int,end:int>>")

        def step(done, x):
            joins = (F.size(done) > 0) & (F.get(done, F.size(done) - 1)["end"] >= x["start"])
            longer = F.struct(F.get(done, F.size(done) - 1)["start"].alias("start"), F.greatest(F.get(done, F.size(done) - 1)["end"], x["end"]).alias("end"))
            return F.when(joins, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(done, F.array(x)))

        return F.aggregate(ordered, empty, step)

    grouped = s.groupBy("row").agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"))).alias("s"))
    return grouped.select("row", merge(F.col("s")).alias("m")).select("row", F.col("m.start").alias("starts"), F.col("m.end").alias("ends"))


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = 10, **settings) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row of docs; see hits for what counts."""
    found = hits(docs, benchmark, words, **settings)
    n_hit = F.aggregate(F.zip_with("starts", "ends", lambda a, b: (b - a).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") > 0).alias("contaminated"))


def longest_matches(docs: DataFrame, benchmark: DataFrame, least_words: int = 10, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """item_id (as text), item_word, n_words, doc_id, doc_word: each item suffix's longest verbatim match among all documents.

    Only matches of least_words or more; of equally long ones the smallest (doc_id, doc_word), rows without doc_id last.  Each shard
    gives one location for each suffix, so what is shuffled is at most the benchmark for each shard; if a shard has
    several equally long ones, it gives the least of them.  Of items that repeat an item_id the longest match at each place counts.
    """
    out = None
    rows = texts(docs).select(F.col("doc_id").alias("row"), F.col("text").cast("binary").alias("text"))
    for block in item_blocks(benchmark, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            items = Items.of(block)
            begin = {}
            for at in np.flatnonzero(items.token).tolist():
                begin.setdefault(int(items.item[at]), at)
            for keys, shard, _ in _shards(batches, items, least_words, items.longest(), shard_words):
                place, best, _ = shard.longest(items)
                some = np.flatnonzero(best >= least_words)
                if not len(some):
                    continue
                which, at = shard.occurrences(items, place[some], best[some])
                doc = shard.document(at)
                ids = np.array([np.iinfo(np.int64).max if k is None else k for k in keys])[doc]
                by = np.lexsort((at - shard.begin[doc], ids, which))
                one = by[np.unique(which[by], return_index=True)[1]]
                p = place[some]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([items.names[k] for k in items.item_name[items.item[p]]]), pa.array(p - np.array([begin[int(k)] for k in items.item[p]])), pa.array(best[some]),
                        pa.array([keys[k] for k in doc[one]], pa.int64()), pa.array((at - shard.begin[doc])[one]),
                    ],
                    ["item_id", "item_word", "n_words", "doc_id", "doc_word"],
                )

        got = rows.mapInArrow(run, "item_id string, item_word long, n_words long, doc_id long, doc_word long")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id string, item_word long, n_words long, doc_id long, doc_word long")
    best = F.min_by(F.struct("n_words", "doc_id", "doc_word"), F.struct(-F.col("n_words"), F.col("doc_id").isNull(), "doc_id", "doc_word")).alias("m")
    return out.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", "m.n_words", "m.doc_id", "m.doc_word")


def clean(docs: DataFrame, benchmark: DataFrame, words: int = 10, block_bytes: int = BLOCK_BYTES, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs, all columns, without the rows whose text is hit; copies of a hit text go with it, other rows of its doc_id stay."""

    def digest(text):
        return F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256)

    rows = docs.select(digest(F.col("text")).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    gone = _row_hits(rows, benchmark, words, block_bytes, shard_words).where(F.size("items") > 0).select(F.col("row").alias("_gone")).distinct()
    return docs.join(gone, digest(docs["text"]) == F.col("_gone"), "left_anti")
