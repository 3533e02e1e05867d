"""Exact token counts at every prefix.

For each byte prefix of a piece there is one token that can end its encoding: the token t whose
predecessor, the last token of the prefix before t, stays apart from t under the merges.  So
last[i] and count[i] follow from earlier prefixes alone (count[i] = count[i - len(t)] + 1).  A text's row of
counts is its pieces' rows, each raised by what is before it; stored, it answers truncation
and budget questions without encoding again.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchplan.llm.bpe import CACHE_PIECES, LONG_PIECE, SLICE_CHARS, PairTable, Vocabulary, blocks_by_length, byte_rows, split
from watchplan.llm.common import texts

#: Pieces x width that the arrays of one step hold.
CELLS = 1 << 18
#: Where a prefix is split otherwise than the whole: after a run of white space (its last blank belongs to what follows), within a contraction.
_RUNS = regex.compile(r"\s{2,}(?=\S)")
_CONTRACTIONS = regex.compile(r"'(?:re|ve|ll)")


class PrefixCounter:
    """Token counts of prefixes under a Vocabulary: its tokens as a trie, made once and sent to the tasks."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        special = set(vocabulary.special.values())
        nodes: dict[tuple[int, int], int] = {}
        token: list[int] = [-1]
        for k, b in enumerate(vocabulary.bytes):
            if k in special or not b:
                continue
            at = 0
            for c in b:
                if (at, c) not in nodes:
                    nodes[at, c] = len(token)
                    token.append(-1)
                at = nodes[at, c]
            token[at] = k
        self.child, self.token = PairTable(nodes), np.array(token, np.int32)
        self.longest = max(map(len, vocabulary.bytes))
        self.known: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.plain = tuple(x.tolist() for x in (vocabulary.rank, vocabulary.left, vocabulary.right))

    def apart(self, a: np.ndarray, b: np.ndarray, ask: np.ndarray) -> np.ndarray:
        """Whether token a followed by token b is the encoding of their bytes, for arrays of tokens; True where not asked.

        From the finished tokens back in time: whichever of the two facing parts was merged last is
        taken apart.  The pair may not merge while both parts exist; of equal ranks the left goes first.
        """
        v, good = self.v, np.ones(a.size, bool)
        live = np.flatnonzero(ask)
        a, b = a[live], b[live]
        until_a, until_b = (np.full(a.size, 1 << 30, np.int32) for _ in range(2))
        while live.size:
            joined = v.pairs.get(a, b)
            bad = (joined >= 0) & (joined < until_a) & (joined <= until_b)
            good[live[bad]] = False
            ra, rb = v.rank[a], v.rank[b]
            go = ~bad & ((ra >= 0) | (rb >= 0))
            live, a, b, until_a, until_b, ra, rb = (x[go] for x in (live, a, b, until_a, until_b, ra, rb))
            undo = ra > rb
            until_a, until_b = np.where(undo, ra, until_a), np.where(undo, until_b, rb)
            a, b = np.where(undo, v.right[a], a), np.where(undo, b, v.left[b])
        return good

    def apart_one(self, a: int, b: int) -> bool:
        """apart() of two tokens."""
        get, (rank, left, right) = self.v.ranks.get, self.plain
        until_a = until_b = 1 << 30
        while True:
            joined = get((a, b))
            if joined is not None and joined < until_a and joined <= until_b:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                until_a, a = ra, right[a]
            else:
                until_b, b = rb, left[b]

    def rows(self, pieces: list[bytes]) -> list[bytes]:
        """For each piece the counts of its byte prefixes 1, ..., len as packed int32."""
        out: list[bytes] = [b""] * len(pieces)
        for width, own in blocks_by_length(pieces, CELLS):
            if width > LONG_PIECE:
                for k in own:
                    out[k] = self._long(pieces[k]).astype("<i4").tobytes()
                continue
            counts = self._block([pieces[k] for k in own], width).astype("<i4")
            for k, row in zip(own, counts, strict=True):
                out[k] = row[1 : len(pieces[k]) + 1].tobytes()
        return out

    def _block(self, pieces: list[bytes], width: int) -> np.ndarray:
        rows, lengths = byte_rows(pieces, width)
        n, most = len(pieces), int(lengths.max(initial=0))
        r, start = np.nonzero(np.arange(width) < lengths[:, None])
        node, found = np.zeros(r.size, np.int64), []
        for size in range(1, self.longest + 1):
            ok = start + size <= lengths[r]
            r, start, node = r[ok], start[ok], node[ok]
            node = self.child.get(node, rows[r, start + size - 1]).astype(np.int64)
            ok = node >= 0
            r, start, node = r[ok], start[ok], node[ok]
            if not r.size:
                break
            token = self.token[node]
            hit = token >= 0
            found.append((start[hit] + size, r[hit], start[hit], token[hit]))
        end, r, start, token = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")
        end, r, start, token = end[order], r[order], start[order], token[order]
        last, count = np.full((n, most + 1), -1, np.int32), np.zeros((n, most + 1), np.int32)
        bounds = np.searchsorted(end, np.arange(1, most + 2))
        for e in range(1, most + 1):
            part = slice(bounds[e - 1], bounds[e])
            own, begin, made = r[part], start[part], token[part]
            before = last[own, begin]
            ok = (begin == 0) | (self.apart(before, made, begin > 0))
            own, begin, made = own[ok], begin[ok], made[ok]
            last[own, e], count[own, e] = made, count[own, begin] + 1
        return count

    def _long(self, piece: bytes) -> np.ndarray:
        """rows() of one very long piece: the same recurrence forward, as a plain loop; pairs of tokens are asked once."""
        n = len(piece)
        data = np.frombuffer(piece, np.uint8).astype(np.int64)
        last, count = [-1] * (n + 1), np.zeros(n + 1, np.int32)
        known, chunk = self.pairs, 1 << 14
        if len(known) > CACHE_PIECES:
            known.clear()
        for low in range(0, n, chunk):  # tokens that begin in a stretch, by their beginnings, then the recurrence over the stretch
            start = np.arange(low, min(n, low + chunk))
            node, found = np.zeros(start.size, np.int64), []
            for size in range(1, self.longest + 1):
                ok = start + size <= n
                start, node = start[ok], node[ok]
                node = self.child.get(node, data[start + size - 1]).astype(np.int64)
                start, node = start[node >= 0], node[node >= 0]
                if not start.size:
                    break
                hit = self.token[node] >= 0
                found.append((start[hit], start[hit] + size, self.token[node[hit]]))
            begin, end, token = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(begin, kind="stable")
            for s, e, made in zip(begin[order].tolist(), end[order].tolist(), token[order].tolist(), strict=True):
                if last[e] >= 0:
                    continue
                if s:
                    pair = (last[s], made)
                    ok = known.get(pair)
                    if ok is None:
                        ok = known[pair] = self.apart_one(*pair)
                    if not ok:
                        continue
                last[e], count[e] = made, count[s] + 1
        return count[1:]

    def learn(self, pieces: set[str]) -> None:
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        new = list(pieces.difference(self.known))
        self.known.update(zip(new, self.rows([p.encode() for p in new]), strict=True))

    def _sums(self, pieces: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Counts at each byte prefix 1, 2, ..., and the bytes of each piece, for a text's pieces."""
        get = self.known.__getitem__
        if any(isinstance(p, int) for p in pieces):
            rows = [get(p) if isinstance(p, str) else (b"\1\0\0\0" * len(self.v.bytes[p])) for p in pieces]
        else:
            rows = list(map(get, pieces))
        counts = np.frombuffer(b"".join(rows), "<i4").astype(np.int64)
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        whole = counts[np.cumsum(sizes) - 1]
        return counts + np.repeat(np.cumsum(whole) - whole, sizes), sizes

    def total(self, text: str) -> int:
        pieces = split(text, self.v)
        self.learn({p for p in pieces if isinstance(p, str)})
        return int(self._sums(pieces)[0][-1]) if pieces else 0

    def batch(self, part: list[str]) -> Iterator[tuple[str, int, int, np.ndarray]]:
        """(text, bytes, tokens, counts) of each text; counts[k]: tokens of its first k code points, k from 0."""
        cut = [split(t, self.v) for t in part]
        runs = [[(m.start(), m.end()) for m in _RUNS.finditer(t)] for t in part]
        need = {t[a:b] for t, own in zip(part, runs, strict=True) for a, b in own}
        self.learn(need.union(*({p for p in pieces if isinstance(p, str)} for pieces in cut)))
        for text, pieces, own in zip(part, cut, runs, strict=True):
            if not pieces:
                yield text, 0, 0, np.zeros(1, np.int64)
                continue
            data = np.frombuffer(text.encode(), np.uint8)
            sums, sizes = self._sums(pieces)
            n = int(sums[-1])
            at = np.flatnonzero(np.append(data[1:] & 0xC0 != 0x80, True))  # last bytes of code points
            counts = np.concatenate([np.zeros(1, np.int64), sums[at]])
            for a, b in own:
                counts[b] = counts[a] + int.from_bytes(self.known[text[a:b]][-4:], "little")
            special = [] if all(isinstance(p, str) for p in pieces) else self._specials(pieces)
            if "'" in text:  # a prefix that ends within 're, 've or 'll has what that apostrophe and letter are alone
                for m in _CONTRACTIONS.finditer(text):
                    self._anew(text, counts, m.start(), m.start() + 2, special)
            for begin, end in special:  # a prefix that ends within a special string has its beginning as plain text
                for c in range(begin + 1, end):
                    self._anew(text, counts, begin, c, special)
            yield text, data.size, n, counts

    def _specials(self, pieces: list[str | int]) -> list[tuple[int, int]]:
        out, k = [], 0
        for p in pieces:
            size = len(p) if isinstance(p, str) else len(self.v.bytes[p].decode())
            if isinstance(p, int):
                out.append((k, k + size))
            k += size
        return out

    def _anew(self, text: str, counts: np.ndarray, begin: int, end: int, special: list[tuple[int, int]]) -> None:
        """Counts text[:end] from the last place up to begin at which it is cut for certain: behind a letter or number, or a special string."""
        k = bisect.bisect_right(special, (begin, -1)) - 1  # the last special string that begins before
        floor = special[k][1] if k >= 0 else 0
        low = begin
        while low > floor and not text[low - 1].isalnum():
            low -= 1
        counts[end] = counts[low] + self.total(text[low:end])


class CountedText:
    """A text and its row of counts."""

    def __init__(self, text: str, counter: PrefixCounter):
        self.text, _, self.n, self.counts = next(counter.batch([text]))

    def tokens(self) -> int:
        return self.n

    def at(self, chars: int) -> int:
        """Tokens of text[:chars]."""
        return int(self.counts[max(0, min(chars, len(self.text)))])

    def longest(self, limit: int) -> int:
        return longest(self.counts, limit)


def longest(counts: np.ndarray, limit: int) -> int:
    """The most leading code points that have at most limit tokens, of a row of counts."""
    return int(np.flatnonzero(counts <= limit)[-1]) if limit >= 0 else 0


def _slices(batch: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in batch:
        if part and size + len(t) > SLICE_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def count_tokens(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, chars_in_limit of each whole text; null texts count as empty: 0 bytes, 0 tokens.

    chars_in_limit: the most leading code points that have at most limit tokens.  Tasks stream Arrow
    batches; a piece met before is answered by its stored row.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PrefixCounter(Vocabulary(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for batch in batches:
            out: list[list[int]] = [[], [], []]
            for text, size, n, counts in itertools.chain.from_iterable(map(counter.batch, _slices(batch.column(1).to_pylist()))):
                for x, value in zip(out, (size, n, len(text) if n <= limit else longest(counts, limit)), strict=True):
                    x.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in out)], names=["doc_id", "n_bytes", "n_tokens", "chars_in_limit"])

    counted = texts(docs).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, chars_in_limit long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "chars_in_limit")


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and steps: by how much each further code point changes the token count; to be stored.

    steps (array<smallint>, one for each code point) compress to less than a text; tokens_at and longest_within
    answer from them, in Spark, with no tokenizer at hand.  Null and empty texts have no steps.
    """
    shared = docs.sparkSession.sparkContext.broadcast(PrefixCounter(Vocabulary(tokenizer)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = shared.value
        for batch in batches:
            n, steps = [], []
            for _, _, total, counts in itertools.chain.from_iterable(map(counter.batch, _slices(batch.column(1).to_pylist()))):
                n.append(total)
                steps.append(np.diff(counts).astype(np.int16))
            ends = np.cumsum([0, *map(len, steps)])
            flat = pa.array(np.concatenate(steps) if steps else np.zeros(0, np.int16), pa.int16())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], names=["doc_id", "n_tokens", "steps"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, steps array<smallint>")


def tokens_at(steps: Column, chars: Column | int) -> Column:
    """Tokens of the first `chars` code points, from a stored column of steps; beyond the text's end, of all."""
    chars = chars if isinstance(chars, Column) else F.lit(chars)
    return F.aggregate(F.slice(steps, F.lit(1), F.greatest(chars, F.lit(0)).cast("int")), F.lit(0).cast("long"), lambda n, s: n + s)


def longest_within(steps: Column, limit: int) -> Column:
    """The most leading code points that have at most limit tokens, from a stored column of steps."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("k"), F.lit(0).alias("best"))

    def step(acc: Column, s: Column) -> Column:
        n, k = acc["n"] + s, acc["k"] + 1
        return F.struct(n.alias("n"), k.alias("k"), F.when(n <= limit, k).otherwise(acc["best"]).alias("best"))

    return F.aggregate(steps, start, step, lambda acc: acc["best"])
