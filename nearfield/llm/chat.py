"""Chat formatting with a prefix tree.

Method: conversations are sorted by their chains of turn hashes, which is the depth-first order of their prefix tree.
In that order a conversation shares with its neighbour before exactly the turns of their common prefix, so each turn
node is emitted once, by the first conversation that passes it. A segment carries the position id of its first
character (the length of its ancestors) and the intervals of its ancestors in the pack, which are all that its tokens
may attend to besides themselves. A pack is one training sequence; it ends when its budget is full, and a pack that
starts inside a shared prefix holds that prefix again, as attention does not cross packs.

Control strings inside texts are escaped reversibly: a backslash is doubled, and a control string gets a backslash
after its first character.

Turns are sorted by (turn, role, text), nulls first; a null role or text counts as empty. Repeated rows are turns of
their own. Rows with a null conversation id are one conversation. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, materialize

# Control strings of this template and of common chat templates.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = (
    TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>",
)
_ESCAPE = re.compile("|".join(map(re.escape, ("\\", *CONTROLS))))
_UNESCAPE = re.compile(r"\\(\\?)")
_PARSE = re.compile(f"{re.escape(TURN)}(.*?){re.escape(TEXT)}(.*?){re.escape(END)}", re.S)

#: Turns of a conversation whose sharing is looked for; later ones are emitted unshared. Characters of one pack.
SHARED_TURNS, PACK_CHARS = 256, 1 << 20


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def format_turn(role: str, text: str) -> str:
    return f"{TURN}{escape(role)}{TEXT}{escape(text)}{END}"


def parse_turn(segment: str) -> tuple[str, str, int]:
    """Role, text, and where the escaped text starts in a formatted turn."""
    m = _PARSE.fullmatch(segment)
    return unescape(m[1]), unescape(m[2]), m.start(2)


class _Rows:
    """Rows gathered into record batches of bounded size."""

    def __init__(self, ddl: str, most: int = 1 << 22):
        self.schema, self.most, self.rows, self.size = arrow_schema(ddl), most, [], 0

    def add(self, row: tuple, size: int) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.size += size + 64
        if self.size > self.most:
            yield self.take()

    def take(self) -> pa.RecordBatch:
        cols = list(zip(*self.rows)) or [()] * len(self.schema)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, self.schema)], schema=self.schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in b.slice(at, 1024).columns))


_CHAIN = "conv_id long, idx long, role string, text string, node long"


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the turns of each conversation and name each by the hash of the turns up to it."""
    out, conv, idx, chain = _Rows(_CHAIN), object(), 0, None
    for c, role, text in _rows(batches):
        if c != conv:
            conv, idx, chain = c, 0, xxhash.xxh3_64()
        for part in (role, text):
            raw = part.encode()
            chain.update(len(raw).to_bytes(8, "little") + raw)
        node = chain.intdigest()
        yield from out.add((c, idx, role, text, node - (1 << 64) if node >> 63 else node), len(text))
        idx += 1
    yield out.take()


_PLACED = "conv_id long, n_turns long, pack long, place long, shared long"


def _place(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted conversations -> their pack, their place in it, and how many turns the one before shares."""
        from pyspark import TaskContext

        out, before, place, filled, pack = _Rows(_PLACED), None, 0, 0, TaskContext.get().partitionId() << 32
        for nodes, conv, n_turns, chars in _rows(batches):
            if before is None or filled > budget:
                pack, place, filled, before = pack + 1, 0, 0, ()
            shared = 0
            while shared < min(len(before), len(nodes)) and before[shared] == nodes[shared]:
                shared += 1
            filled += chars if not shared else chars * (n_turns - shared) // max(n_turns, 1)
            yield from out.add((conv, n_turns, pack, place, shared), 0)
            before, place = nodes, place + 1
        yield out.take()

    return run


SEGMENTS = (
    "pack long, place long, conv_id long, idx long, start long, position long, "
    "ancestors array<struct<start:long,stop:long>>, loss_start long, loss_stop long, content string, ends boolean"
)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """New turns and conversation ends in depth-first order -> segments of the packs. Intervals that touch are one."""
    out, pack, at, stack = _Rows(SEGMENTS), object(), 0, []
    for p, place, idx, conv, shared, n_turns, role, text in _rows(batches):
        if p != pack:
            pack, at, stack = p, 0, []
        del stack[n_turns if idx == n_turns else idx :]
        path, length = stack[-1] if stack else ((), 0)  # the intervals of all turns up to here, and their characters
        spans = [{"start": s, "stop": e} for s, e in path]
        if idx == n_turns:  # the end of a conversation: nothing is emitted, its path is the stack
            yield from out.add((p, place, conv, idx, at, length, spans, at, at, "", True), 16 * len(path))
            continue
        content = format_turn(role, text)
        stop = at + len(content)
        loss = (stop - len(END) - len(escape(text)), stop - len(END)) if role == "assistant" else (at, at)
        yield from out.add((p, place, conv, idx, at, length, spans, *loss, content, False), len(content) + 16 * len(path))
        path = (*path[:-1], (path[-1][0], stop)) if path and path[-1][1] == at else (*path, (at, stop))
        stack.append((path, length + len(content)))
        at = stop
    yield out.take()


def format_conversations(conversations: DataFrame, pack_chars: int = PACK_CHARS, shared_turns: int = SHARED_TURNS) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` -> the segments of the packs, see :data:`SEGMENTS`.

    Segments are clustered by pack and sorted by ``(place, idx)`` within it; a pack's text is their ``content`` in that
    order. ``start`` is a segment's first character in the pack, ``position`` its position id, ``ancestors`` the intervals
    it may attend to besides itself and ``loss_start, loss_stop`` the part that counts for the loss. A row with ``ends``
    closes a conversation: its ancestors are the conversation's whole path.
    """
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn"), text_of("role"), text_of("text"))
    turns = turns.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    turns = materialize(turns.select("conv_id", "role", "text").mapInArrow(_chain, _CHAIN), "turns")

    first = F.when(F.col("idx") < shared_turns, F.struct("idx", "node"))
    convs = turns.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(first)).alias("nodes"), F.count("*").alias("n_turns"), F.sum(F.length("text") + 32).alias("chars")
    )
    convs = convs.select(F.col("nodes.node").alias("nodes"), "conv_id", "n_turns", "chars")
    placed = (
        convs.repartitionByRange(parts, "nodes", "conv_id")
        .sortWithinPartitions("nodes", "conv_id")
        .mapInArrow(_place(pack_chars), _PLACED)
    )
    placed = materialize(placed, "placed")
    new = turns.alias("t").join(placed.alias("p"), F.col("t.conv_id").eqNullSafe(F.col("p.conv_id"))).where("idx >= shared")
    new = new.select("pack", "place", "idx", "t.conv_id", "shared", "n_turns", "role", "text")
    none = F.lit(None).cast("string")
    ends = placed.select("pack", "place", F.col("n_turns").alias("idx"), "conv_id", "shared", "n_turns", none.alias("role"), none.alias("text"))
    return new.union(ends).repartition(parts, "pack").sortWithinPartitions("pack", "place", "idx").mapInArrow(_emit, SEGMENTS)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out, pack, stack = _Rows(_DIGESTS), object(), []
    empty = (hashlib.sha256(), hashlib.sha256(), 0, 0)
    for p, conv, idx, start, loss_start, loss_stop, content, ends in _rows(batches):
        if p != pack:
            pack, stack = p, []
        del stack[idx:]
        turns, loss, n_loss, n_all = stack[-1] if stack else empty
        if ends:
            yield from out.add((conv, idx, turns.hexdigest(), n_loss, loss.hexdigest(), n_all), 160)
            continue
        role, text, _ = parse_turn(content)
        turns = turns.copy()
        turns.update(f"{role}\n{text}\n".encode())
        if loss_stop > loss_start:
            said = unescape(content[loss_start - start : loss_stop - start])
            loss = loss.copy()
            loss.update(said.encode())
            n_loss += len(said)
        stack.append((turns, loss, n_loss, n_all + len(content)))
    yield out.take()


def read_back(segments: DataFrame) -> DataFrame:
    """What each conversation says, read from the emitted segments along its path in the tree."""
    cols = ["pack", "conv_id", "idx", "start", "loss_start", "loss_stop", "content", "ends"]
    return segments.select(*cols).mapInArrow(_read_back, _DIGESTS)
