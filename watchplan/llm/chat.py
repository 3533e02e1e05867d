"""Chat formatting into packs that share initial turns.

Conversations are sorted by the path of their turns, which is depth-first order over the prefix tree
of all of them.  A task walks its range of that order: turns that the open pack's current path has
already are not emitted again, so shared turns appear once, before their branches.  Each segment
carries the position of its first token and the intervals of its ancestors, which with its own
causal part are all that it may attend to.  Tokens are code points here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pack is closed beyond so many code points or conversations.
PACK_CHARS, PACK_CONVERSATIONS = 1 << 16, 2048
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Places inside texts where a control string, of this template or a common one, would begin; "\." is put there.
_CONTROL = re.compile(r"(?<=<)(?=\||/?s>)|(?<=\[)(?=/?INST\])|(?<=\|)(?=>)")
_ESCAPED = re.compile(r"\\([\\.])")
_SEGMENT = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\\.", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" if m[1] == "\\" else "", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and the bounds of its text within it."""
    head = TURN + escape(role) + TEXT
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


_PACK = (
    "pack string, text string, conversations array<struct<conv_id:long,leaf:int>>, "
    "segments array<struct<begin:int,end:int,parent:int,position:int,loss_begin:int,loss_end:int,attends:array<struct<begin:int,end:int>>>>"
)


def _packs(batches: Iterator[pd.DataFrame], most_chars: int, most_conversations: int, loss_roles: frozenset[str]) -> Iterator[pd.DataFrame]:
    task, number = TaskContext.get().partitionId(), 0
    parts: list[str] = []
    segments: list[tuple] = []
    conversations: list[tuple] = []
    path: list[tuple[tuple[str, str], int]] = []  # turns on the current path and their segments
    size = 0

    def row() -> tuple:
        return (f"{task}-{number}", "".join(parts), conversations, segments)

    for pdf in batches:
        out = []
        for conv_id, turns in zip(pdf["conv_id"], pdf["turns"], strict=True):
            own = [(t["role"], t["text"]) for t in turns]
            shared = 0
            while shared < min(len(path), len(own)) and path[shared][0] == own[shared]:
                shared += 1
            new = [render(*t) for t in own[shared:]]
            if conversations and (size + sum(len(x[0]) for x in new) > most_chars or len(conversations) >= most_conversations):
                out.append(row())
                number, size, shared = number + 1, 0, 0
                parts, segments, conversations, path = [], [], [], []
                new = [render(*t) for t in own]
            path = path[:shared]
            for turn, (text, begin, end) in zip(own[shared:], new, strict=True):
                parent = path[-1][1] if path else -1
                attends: list[tuple[int, int]] = []
                position = 0
                if path:
                    b, e, _, p, _, _, above = segments[parent]
                    position = p + e - b
                    attends = [*above[:-1], (above[-1][0], e)] if above and above[-1][1] == b else [*above, (b, e)]
                lost = (size + begin, size + end) if turn[0] in loss_roles else (size, size)
                path.append((turn, len(segments)))
                segments.append((size, size + len(text), parent, position, *lost, attends))
                parts.append(text)
                size += len(text)
            conversations.append((conv_id, path[-1][1] if path else -1))
        if out:
            yield _pack_frame(out)
    if conversations:
        yield _pack_frame([row()])


def _pack_frame(rows: list[tuple]) -> pd.DataFrame:
    out = []
    for name, text, conversations, segments in rows:
        c = [{"conv_id": None if pd.isna(i) else int(i), "leaf": leaf} for i, leaf in conversations]
        s = [dict(zip(("begin", "end", "parent", "position", "loss_begin", "loss_end"), x, strict=False)) | {"attends": [{"begin": b, "end": e} for b, e in x[6]]} for x in segments]
        out.append((name, text, c, s))
    return pd.DataFrame(out, columns=["pack", "text", "conversations", "segments"])


def packs(conversations: DataFrame, pack_chars: int = PACK_CHARS, pack_conversations: int = PACK_CONVERSATIONS, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Packs of conversations given as rows (conv_id, turn, role, text).

    A row per pack: text; conversations (conv_id, and the segment of its last turn); segments (begin,
    end, parent segment or -1, position id of the first token, the loss-masked interval, the ancestors'
    intervals it attends to).  Turns go by turn, then role, then text, so ties and repeated rows are
    kept in a fixed order; null roles and texts count as empty.  A conversation longer than pack_chars
    is a pack of its own.

    A conversation is gathered in one task, nothing larger is: the order is cut by range over (path,
    conv_id), so that a first turn or a whole conversation that a third of all share spreads over tasks.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    step = F.transform("turns", lambda t: F.substring(F.md5(F.concat(t["role"], F.lit("\n"), t["text"]).cast("binary")), 1, 16))
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = whole.withColumn("path", F.array_join(step, "")).repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id").select("conv_id", "turns")
    roles = frozenset(loss_roles)
    return ordered.mapInPandas(lambda b: _packs(b, pack_chars, pack_conversations, roles), _PACK)


def position_ids(packed: DataFrame) -> DataFrame:
    """pack and positions: a position id for each token of the pack."""
    run = F.transform("segments", lambda s: F.sequence(s["position"], s["position"] + s["end"] - s["begin"] - 1))
    return packed.select("pack", F.flatten(run).alias("positions"))


def read_back(packed: DataFrame) -> DataFrame:
    """What each conversation's tokens say, from its last segment up through the tree.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, and new_chars: how many
    tokens of it no other conversation before it in the pack has.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, convs, segments in zip(pdf["text"], pdf["conversations"], pdf["segments"], strict=True):
                met: set[int] = set()
                for c in convs:
                    chain, at = [], c["leaf"]
                    while at >= 0:
                        chain.append(at)
                        at = segments[at]["parent"]
                    own = [segments[k] for k in reversed(chain)]
                    formatted = "".join(text[s["begin"] : s["end"]] for s in own)
                    turns = [(unescape(m[1]), unescape(m[2])) for m in _SEGMENT.finditer(formatted)]
                    said = "".join(f"{r}\n{t}\n" for r, t in turns)
                    lost = "".join(unescape(text[s["loss_begin"] : s["loss_end"]]) for s in own)
                    fresh = sum(segments[k]["end"] - segments[k]["begin"] for k in chain if k not in met)
                    met.update(chain)
                    out.append((c["conv_id"], len(turns), _sha(said), len(lost), _sha(lost), len(formatted), fresh))
            frame = pd.DataFrame(out, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "new_chars"])
            frame["conv_id"] = frame["conv_id"].astype("Int64")
            yield frame

    return packed.select("text", "conversations", "segments").mapInPandas(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, new_chars long")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
