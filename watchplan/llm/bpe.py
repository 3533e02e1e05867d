"""Byte-level BPE encoding and decoding.

A text is cut into pieces; within a piece, a segment tree over the ranks of adjacent pairs has the
leftmost lowest-rank merge at its root.  A merge rewrites three leaves and the nodes above them,
and the loop ends when no pair can merge.  Many pieces run side by side: row r of each array is one
piece, so a step is a few numpy operations over all pieces that still merge.  A very long piece has a
tree of its own, and a step takes all leaves of the root's rank at once, leftmost first.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchplan.llm.common import texts

#: Fixed value: the piece pattern of byte-level BPE vocabularies of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces held in a worker's cache; it starts anew beyond them.
CACHE_PIECES = 50_000
#: Characters whose pieces are encoded at once.
SLICE_CHARS = 1 << 18
#: Pieces of so many bytes have a tree of their own.
LONG_PIECE = 2048
_NONE = np.iinfo(np.int64).max


class PairTable:
    """Pairs of non-negative integers below 2**31 to an integer, looked up for whole arrays; -1 where absent."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        bits = max(4, (4 * len(pairs)).bit_length())
        self.shift, size = np.uint64(64 - bits), 1 << bits
        self.keys, self.values = np.full(size + 64, -1, np.int64), np.full(size + 64, -1, np.int32)
        for (a, b), v in pairs.items():
            key = a << 31 | b
            at = (key * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) >> (64 - bits)
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.values[at] = key, v

    def get(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 31 | b
        at = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        seen = self.keys[at]
        out = np.where(seen == key, self.values[at], -1)
        rest = np.flatnonzero((seen != key) & (seen >= 0))
        while rest.size:
            at[rest] += 1
            seen = self.keys[at[rest]]
            out[rest] = np.where(seen == key[rest], self.values[at[rest]], -1)
            rest = rest[(seen != key[rest]) & (seen >= 0)]
        return out


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """What a tokenizers .json file of a byte-level BPE says: tokens' bytes, ranked merges, special strings."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, letters = spec["model"], byte_letters()
        if model["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer"):
            raise ValueError(f"{path}: not a plain byte-level BPE")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = model["vocab"]
        self.bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, k in vocab.items():
            self.bytes[k] = bytes(letters[c] for c in token) if token not in self.special else token.encode()
        for token, k in self.special.items():
            self.bytes[k] = token.encode()
        self.of_byte = np.zeros(256, np.int32)
        for c, b in letters.items():
            self.of_byte[b] = vocab[c]
        self.left, self.right = np.full(len(self.bytes), -1, np.int32), np.full(len(self.bytes), -1, np.int32)
        self.rank, self.made, ranks = np.full(len(self.bytes), -1, np.int32), [], {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, new = vocab[a], vocab[b], vocab[a + b]
            ranks[a, b] = rank
            self.made.append(new)
            self.left[new], self.right[new], self.rank[new] = a, b, rank
        self.made = np.array([*self.made, -1], np.int32)
        self.pairs, self.ranks = PairTable(ranks), ranks
        # whether every pair with a merged token ranks behind that token's own merges, as trained vocabularies have it
        least: dict[int, int] = {}
        for (a, b), rank in ranks.items():
            least[a], least[b] = min(rank, least.get(a, rank)), min(rank, least.get(b, rank))
        self.ordered = all(least.get(new, len(ranks)) > rank for rank, new in enumerate(self.made[:-1].tolist()))


def split(text: str, vocabulary: Vocabulary) -> list[str | int]:
    """Pieces of text; a special string counts as its id."""
    if not any(s in text for s in vocabulary.special):
        return _pieces(text)
    out: list[str | int] = []
    for k, part in enumerate(regex.split("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")", text)):
        out += [vocabulary.special[part]] if k % 2 else _pieces(part)
    return out


_any_text = regex.compile(PIECES).findall
#: Letters, numbers and white space below U+0250, where the same pattern runs faster as plain classes.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾", " \t-\r\x85\xa0"
_low_text = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
_beyond = re.compile("[^\x00-ɏ]").search


def _pieces(text: str) -> list[str]:
    return _any_text(text) if _beyond(text) else _low_text(text)


def blocks_by_length(pieces: list[bytes], cells: int = 1 << 17) -> Iterator[tuple[int, list[int]]]:
    """(width, indices): pieces of similar length, width a power of two, width x indices at most cells or one piece."""
    by: dict[int, list[int]] = {}
    for k, p in enumerate(pieces):
        by.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(k)
    for width, own in sorted(by.items()):
        step = max(1, cells // width)
        for at in range(0, len(own), step):
            yield width, own[at : at + step]


def byte_rows(pieces: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    rows = np.zeros((len(pieces), width), np.uint8)
    rows[np.arange(width) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
    return rows, lengths


def encode_pieces(pieces: list[bytes], v: Vocabulary) -> list[bytes]:
    """Token ids of each piece as packed int32."""
    out: list[bytes] = [b""] * len(pieces)
    for width, own in blocks_by_length(pieces):
        if width > LONG_PIECE and v.ordered:
            for k in own:
                out[k] = _encode_long(pieces[k], v).astype("<i4").tobytes()
            continue
        ids, counts = _encode_block([pieces[k] for k in own], width, v)
        ends = np.cumsum(counts) * 4
        packed = ids.astype("<i4").tobytes()
        for k, a, b in zip(own, (ends - counts * 4).tolist(), ends.tolist(), strict=True):
            out[k] = packed[a:b]
    return out


def _encode_block(pieces: list[bytes], width: int, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    n, bits = len(pieces), width.bit_length() - 1
    rows, lengths = byte_rows(pieces, width)
    token = v.of_byte[rows]
    place = np.arange(width)
    token[place >= lengths[:, None]] = -1
    after = np.where(place + 1 < lengths[:, None], place + 1, width).astype(np.int64)
    before = np.broadcast_to(place - 1, (n, width)).copy()
    # leaf p: rank of the pair that begins at p, then p, so that the least value is the leftmost lowest rank
    leaves = np.full((n, width), _NONE)
    pair = place[:-1] + 1 < lengths[:, None]
    rank = v.pairs.get(token[:, :-1][pair], token[:, 1:][pair]).astype(np.int64)
    leaves[:, :-1][pair] = np.where(rank >= 0, rank << bits | np.broadcast_to(place[:-1], pair.shape)[pair], _NONE)
    tree = np.full((n, 2 * width), _NONE)
    tree[:, width:] = leaves
    level = width
    while level > 1:
        tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
        level //= 2
    t, tok, aft, bef = tree.ravel(), token.ravel(), after.ravel(), before.ravel()
    live = np.flatnonzero(tree[:, 1] < _NONE)
    while live.size:
        row, node = live * width, live * 2 * width
        root = t[node + 1]
        p, new = root & (width - 1), v.made[root >> bits]
        q = aft[row + p]
        follow, ahead = aft[row + q], bef[row + p]
        tok[row + p], tok[row + q], aft[row + p] = new, -1, follow
        has_next, has_prev = follow < width, ahead >= 0
        bef[(row + follow)[has_next]] = p[has_next]
        t[node + width + q] = _NONE
        rank = np.full(live.size, -1, np.int64)
        rank[has_next] = v.pairs.get(new[has_next], tok[(row + follow)[has_next]])
        t[node + width + p] = np.where(rank >= 0, rank << bits | p, _NONE)
        touched = [(node + width + p, node, p), (node + width + q, node, q)]
        if has_prev.any():
            own, at = node[has_prev], ahead[has_prev]
            rank = v.pairs.get(tok[row[has_prev] + at], new[has_prev]).astype(np.int64)
            t[own + width + at] = np.where(rank >= 0, rank << bits | at, _NONE)
            touched.append((own + width + at, own, at))
        own = np.concatenate([x[1] for x in touched])
        at = np.concatenate([x[2] for x in touched]) + width
        for _ in range(bits):
            at >>= 1
            t[own + at] = np.minimum(t[own + 2 * at], t[own + 2 * at + 1])
        live = live[t[live * 2 * width + 1] < _NONE]
    keep = token >= 0
    return token[keep], keep.sum(1)


def _encode_long(piece: bytes, v: Vocabulary) -> np.ndarray:
    """Token ids of one piece.  A merge makes pairs of higher ranks only (v.ordered), so all leaves of the root's rank may merge in one step."""
    n = len(piece)
    bits = max(1, (n - 1).bit_length())
    width = 1 << bits
    token = v.of_byte[np.frombuffer(piece, np.uint8)].astype(np.int64)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    none = np.iinfo(np.int32).max
    tree = np.full(2 * width, none, np.int32)  # the least rank below each node; leaf p: that of the pair which begins at p
    rank = v.pairs.get(token[:-1], token[1:])
    tree[width : width + n - 1] = np.where(rank >= 0, rank, none)
    level = width
    while level > 1:
        tree[level // 2 : level] = np.minimum(tree[level : 2 * level : 2], tree[level + 1 : 2 * level : 2])
        level //= 2
    while (root := tree[1]) < none:
        nodes = np.ones(1, np.int64)
        for _ in range(bits):  # down to all leaves of this rank, from left to right
            nodes = (2 * nodes[:, None] + np.arange(2)).ravel()
            nodes = nodes[tree[nodes] == root]
        p = nodes - width
        # of pairs that overlap (equal tokens in a row) every second one merges
        joined = np.concatenate(([False], after[p[:-1]] == p[1:]))
        at = np.arange(p.size)
        p = p[(at - np.maximum.accumulate(np.where(joined, 0, at))) % 2 == 0]
        q = after[p]
        follow = after[q]
        token[p], token[q], after[p] = v.made[root], -1, follow
        inner = follow < n
        before[follow[inner]] = p[inner]
        left = before[p]
        left = left[left >= 0]
        changed = np.concatenate([p, left])  # pairs that begin here have other tokens now
        right = after[changed]
        rank = np.full(changed.size, -1, np.int64)
        has = right < n
        rank[has] = v.pairs.get(token[changed[has]], token[right[has]])
        tree[width + q] = none
        tree[width + changed] = np.where(rank >= 0, rank, none)
        nodes = np.concatenate([changed, q]) + width
        for _ in range(bits):
            nodes = nodes >> 1
            nodes = nodes[np.concatenate(([True], nodes[1:] != nodes[:-1]))]
            tree[nodes] = np.minimum(tree[2 * nodes], tree[2 * nodes + 1])
    return token[token >= 0]


class Encoder:
    """Token ids of texts; pieces met before come from a bounded cache."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.known = vocabulary, {}

    def __call__(self, batch: list[str]) -> Iterator[np.ndarray]:
        at = 0
        while at < len(batch):
            size, end = 0, at
            while end < len(batch) and (end == at or size + len(batch[end]) <= SLICE_CHARS):
                size += len(batch[end])
                end += 1
            cut = [split(t, self.v) for t in batch[at:end]]
            if len(self.known) > CACHE_PIECES:
                self.known.clear()
            new = list(set().union(*cut).difference(self.known))
            words = [x for x in new if isinstance(x, str)]
            self.known.update(zip(words, encode_pieces([w.encode() for w in words], self.v), strict=True))
            self.known.update((x, np.array([x], "<i4").tobytes()) for x in new if not isinstance(x, str))
            get = self.known.__getitem__
            for pieces in cut:
                yield np.frombuffer(b"".join(map(get, pieces)), "<i4")
            at = end


def encode(docs: DataFrame, tokenizer: str, with_text: bool = True) -> DataFrame:
    """doc_id, text (unless with_text is false) and ids array<int>: the token ids of each whole text; a null text counts as empty, an empty text has no ids.

    The vocabulary (bounded by its file) is broadcast; each task streams Arrow batches, so memory is
    a batch, a slice's pieces and the cache, whatever the input.  Special strings inside texts become their ids.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = list(encoder(batch.column(1).to_pylist()))
            ends = np.cumsum([0, *map(len, ids)])
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), *([batch.column(1)] if with_text else []), lists], names=["doc_id", *(["text"] if with_text else []), "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, text string, ids array<int>" if with_text else "doc_id long, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and decoded: the text of the ids; bytes that are no UTF-8 become U+FFFD.  Null ids: empty."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(tokenizer).bytes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.__getitem__
        for batch in batches:
            ids = batch.column(1)
            out = [b"".join(map(get, x.values.to_numpy().tolist() if x.is_valid else ())).decode("utf-8", "replace") for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), ids, pa.array(out, pa.string())], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def token_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of encode() and decode()."""
    both = decode(encode(docs, tokenizer, with_text=False), tokenizer)
    return both.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
