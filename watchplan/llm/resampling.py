"""Importance resampling towards a target distribution, over hashed runs of words.

Features are runs of one to three words, hashed by CRC-32.  CRC-32 is affine over bits: the checksum of
a run is the XOR of one contribution for each byte, which depends on the byte and its distance from the run's
end alone, and of a constant for the run's length.  So the contributions are a table by distance and byte, a batch
of runs is one gather from it and one bitwise_xor.reduceat over the runs' spans.  Runs longer than the table fold
blockwise: the checksum so far moves on by a block of zero bytes, which is linear too, and takes up the next block.

A bucket's gain is the logarithm of its share in the target against its share in the documents; a document's weight is the
sum of its features' gains; Gumbel noise on top makes the highest scores a draw without replacement.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from watchplan.llm.common import workspace, written
from watchplan.llm.spans import Words, words_of_column

#: The CRC-32 polynomial, reflected (ISO-HDLC, as in zlib): a fixed value.
POLYNOMIAL = 0xEDB88320
#: Distances from the end that the table has; longer runs fold in blocks of so many bytes.
BLOCK = 64
#: Words and bytes of runs that one gather takes.
SLICE_WORDS, SLICE_BYTES = 16_384, 1 << 20


def _byte_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(POLYNOMIAL), t >> 1)
    return t


class PositionTable:
    """CRC-32 of many spans of one buffer."""

    def __init__(self, block: int = BLOCK) -> None:
        step = _byte_table()
        self.block = block
        # by_distance[d, b]: what byte b adds if d bytes of the span follow it
        self.by_distance = np.empty((block, 256), np.uint32)
        self.by_distance[0] = step
        for d in range(1, block):
            self.by_distance[d] = self._zero(step, self.by_distance[d - 1])
        self.flat = self.by_distance.ravel()
        # moved[k, b]: byte k of a checksum of value b, after a block of zero bytes
        self.moved = np.empty((4, 256), np.uint32)
        for k in range(4):
            state = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            for _ in range(block):
                state = self._zero(step, state)
            self.moved[k] = state
        # of_length[n]: the checksum's constant for n bytes, n below block, and, for whole blocks, moved on
        state = np.uint32(0xFFFFFFFF)
        self.of_length = np.empty(block, np.uint32)
        for n in range(block):
            self.of_length[n] = state
            state = self._zero(step, state)

    @staticmethod
    def _zero(step: np.ndarray, state):
        return step[state & np.uint32(0xFF)] ^ (state >> np.uint32(8))

    def _move(self, state: np.ndarray) -> np.ndarray:
        m = self.moved
        return m[0][state & 0xFF] ^ m[1][(state >> 8) & 0xFF] ^ m[2][(state >> 16) & 0xFF] ^ m[3][state >> 24]

    def _linear(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """XOR of the bytes' contributions of spans of 1 to block bytes."""
        first = np.cumsum(length) - length
        within = np.arange(int(length.sum())) - np.repeat(first, length)
        at = np.repeat(start, length) + within
        distance = np.repeat(length, length) - 1 - within
        return np.bitwise_xor.reduceat(self.flat[(distance << 8) | buffer[at]], first)

    def crc32(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRC-32 of buffer[start : start + length] for each span; a span of no bytes has 0."""
        out = np.zeros(len(start), np.uint32)
        short = np.flatnonzero((length > 0) & (length < self.block))
        if len(short):
            out[short] = ~(self._linear(buffer, start[short], length[short]) ^ self.of_length[length[short]])
        long = np.flatnonzero(length >= self.block)
        huge = length[long] > SLICE_BYTES
        for part in [long[~huge], *long[huge][:, None]]:
            out[part] = self._folded(buffer, start[part], length[part])
        return out

    def _folded(self, buffer: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Spans of a block or more: their blocks' XORs at once, then folded from the first to the last."""
        blocks, head = np.divmod(length, self.block)
        state = np.full(len(start), 0xFFFFFFFF, np.uint32)
        some = np.flatnonzero(head)
        if len(some):
            state[some] = self._linear(buffer, start[some], head[some]) ^ self.of_length[head[some]]
        step = max(1, SLICE_BYTES // self.block // max(1, len(start)))
        for base in range(0, int(blocks.max(initial=0)), step):
            now = np.clip(blocks - base, 0, step)
            first = np.cumsum(now) - now
            within = np.arange(int(now.sum())) - np.repeat(first, now)
            xors = self._linear(buffer, np.repeat(start + head + base * self.block, now) + within * self.block, np.full(len(within), self.block))
            for j in range(int(now.max())):
                on = np.flatnonzero(now > j)
                state[on] = self._move(state[on]) ^ xors[first[on] + j]
        return ~state


def features(words: Words, table: PositionTable, buckets: int, longest: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of each run of 1 to longest words of one text, a bounded slice at a time."""
    size = words.end - words.start
    total = len(size)
    reach = np.concatenate([[0], np.cumsum(size + 1)])
    at = 0
    while at < total:
        # so many runs as start in a slice of words, plus the words that the last of them need
        upto = max(at + 1, min(at + SLICE_WORDS, int(np.searchsorted(reach, reach[at] + SLICE_BYTES))))
        have = min(total, upto + longest - 1)
        own, start = size[at:have], words.start[at:have]
        begin = np.cumsum(own + 1) - own - 1  # words joined by one space each
        joined = np.full(int((own + 1).sum()), 32, np.uint8)
        within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
        joined[np.repeat(begin, own) + within] = words.buffer[np.repeat(start, own) + within]
        text, finish = words.text[at:have], begin + own
        for n in range(1, longest + 1):
            last = min(upto - at, have - at - n + 1)
            if last <= 0:
                break
            whole = np.flatnonzero(text[:last] == text[n - 1 : n - 1 + last])
            if len(whole):
                yield text[whole], (table.crc32(joined, begin[whole], finish[whole + n - 1] - begin[whole]) % np.uint32(buckets)).astype(np.int64)
        at = upto


def bucket_counts(rows: DataFrame, buckets: int, longest: int = 3) -> DataFrame:
    """(bucket, n): features of all texts by bucket; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, count = PositionTable(), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, bucket in features(words_of_column(batch.column(0)), table, buckets, longest):
                count += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some], pa.int64())], ["bucket", "n"])

    binary = rows.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return binary.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """Gain of each bucket in thousandths of a natural logarithm; source and target are (bucket, n) of at most so many rows."""

    def dense(counts: DataFrame) -> np.ndarray:
        out = np.zeros(buckets)
        for r in counts.collect():  # a row for each bucket at most
            out[r["bucket"]] = r["n"]
        return out

    s, t = dense(source), dense(target)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, longest: int = 3) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row."""
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = PositionTable()
        for batch in batches:
            words = words_of_column(batch.column(1))
            count, weight = np.zeros(words.texts, np.int64), np.zeros(words.texts, np.int64)
            for text, bucket in features(words, table, buckets, longest):
                low = text[0]  # texts of a slice are neighbours
                own = np.bincount(text - low)
                count[low : low + len(own)] += own
                # a slice's sum of whole numbers is exact in doubles
                weight[low : low + len(own)] += np.bincount(text - low, gain[bucket]).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.per_text(), pa.int64()), pa.array(count, pa.int64()), pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    binary = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    return binary.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resampled(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 3, least_words: int = 20, percent: int = 5, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs; rank is null for rows that aren't drawn.

    Of the N rows with at least least_words words, floor(percent * N / 100) are drawn: the highest scores, ties to the
    smaller doc_id, then to fewer features, then to the lower weight; rows that agree in all these are alike in every
    column but rank.  Null texts have no words: no features, weight 0.  Rows without doc_id share the noise of an empty id and come
    last among ties; rows that repeat a doc_id have the same noise, and are drawn each by itself.  An empty target gives
    every bucket the same share; an empty docs gives no rows.  Further columns are left out.

    Two passes over the texts, none of which are shuffled: one counts buckets, a row for each bucket and task; the other
    weighs.  The order is a range-partitioned sort of five numbers a row, with a place of its own for each row, so that
    no tie lands in one task; offsets are one row for each partition.
    """
    spark = docs.sparkSession
    folder = workspace(spark)
    gain = gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weighed(docs, gain, longest).withColumn("score", F.col("weight") + noise).withColumn("_row", F.monotonically_increasing_id())
    scored = written(scored, folder, "scored")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("_row")]
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = eligible.count() * percent // 100
    ranged = eligible.repartitionByRange(partitions, *order).sortWithinPartitions(*order)
    # a task's rows are numbered as they come: its own number in the upper bits
    ranged = written(ranged.withColumn("_at", F.monotonically_increasing_id()).select("doc_id", "n_features", "weight", "score", F.shiftright("_at", 33).alias("_part"), F.col("_at").bitwiseAND((1 << 33) - 1).alias("_at")), folder, "ranged")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).select("_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") + 1
    ranked = ranged.join(F.broadcast(offsets), "_part").select("doc_id", "n_features", "weight", "score", F.when(place <= drawn, place).alias("rank"))  # a row for each shuffle partition
    rest = scored.where(F.col("n_words") < least_words).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest)


def draw(docs: DataFrame, target: DataFrame, **settings) -> DataFrame:
    """docs, with all its columns, as far as resampled draws them, by doc_id: of rows that repeat one, all stay if one is drawn."""
    ids = resampled(docs, target, **settings).where("rank IS NOT NULL").select("doc_id").distinct()
    return docs.join(ids.withColumnRenamed("doc_id", "_drawn"), F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")
