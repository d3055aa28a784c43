"""Chat formatting as prefix trees: shared first turns are stored and emitted once.

A turn is a node, named by the digest of all turns up to it, so conversations that begin alike
share nodes. The nodes of a tree are laid out depth-first in one token sequence. A node keeps its
place in the sequence, the position ids of its tokens (their distance from the start of the
conversation, not of the sequence) and the intervals of the sequence that its tokens may attend
to: those of its ancestors. Training on the sequence equals training on each conversation alone.

The layout is a sorted scan. Turns that follow each other without a branch, or the end of another
conversation, between them are a run. A node's key is the chain of the first digests of its runs from
the root, and its number in its own run, so byte order is depth-first order and a key grows with the branches
on the path, not with its turns. Spark sorts the nodes by range; each task scans its range with a
stack of open runs. What enters a range from those before it - a stack, and the tokens so far -
is found from a summary of each range, of which there are as many as partitions.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import keep, vocabulary
from corpusloom.llm.token_counts import encoding

VOCABULARY = "byte_bpe_50k.tiktoken"
START, END = "<|im_start|>", "<|im_end|>"
#: Ids of the two marks, above those of the vocabulary.
START_ID, END_ID = 50_257, 50_258
#: Role whose texts are trained on.
TRAINED = "assistant"
NAME_BYTES = 16
#: Rows of turns in each range of the layout.
RANGE_ROWS = 50_000

_MARK = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No mark is left in the text: ``<|`` gets a backslash inside, and so does each such run."""
    return _MARK.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """As for texts, and on one line."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where its text starts and ends in it."""
    head = f"{START}{escape_role(role)}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


def parse_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; the inverse of ``format_turn``."""
    head, _, rest = formatted.removeprefix(START).partition("\n")
    return unescape_role(head), unescape(rest.removesuffix(f"{END}\n"))


def turn_ids(formatted: str, encode) -> list[int]:
    """Token ids of a formatted turn: the marks are one id each."""
    inner = formatted[len(START) : -len(END) - 1]
    return [START_ID, *encode(inner), END_ID, *encode("\n")]


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, level, role, text, name, parent) of each turn.

    ``name`` is the digest of the conversation up to the turn, ``parent`` that of the turn before.
    Turns of a conversation go by turn number, then role and text; nulls come first. Null roles and
    texts count as empty. A conversation is read as a stream, in constant memory.
    """
    rows = conversations.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, level, name = object(), 0, None
        for batch in batches:
            levels, names, parents = [], [], []
            for conv_id, r, t in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2)]):
                if conv_id != current:
                    current, level, name = conv_id, 0, None
                parents.append(name)
                # Lengths keep role and text apart.
                raw_role, raw_text = r.encode(), t.encode()
                digest = hashlib.sha256(b"%b%d:%b%b" % (name or b"", len(raw_role), raw_role, raw_text)).digest()
                name = digest[:NAME_BYTES]
                levels.append(level)
                names.append(name)
                level += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(levels, pa.int32()), batch.column(1), batch.column(2), pa.array(names, pa.binary()), pa.array(parents, pa.binary())],
                names=["conv_id", "level", "role", "text", "name", "parent"],
            )

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return ordered.mapInArrow(run, "conv_id bigint, level int, role string, text string, name binary, parent binary")


def leaves_of(turns: DataFrame) -> DataFrame:
    """(conv_id, leaf): the last node of each conversation."""
    return turns.groupBy("conv_id").agg(F.max_by("name", "level").alias("leaf"))


#: Parts of a key. The number of a node sorts before the runs that follow its run.
RUN_MARK, NUMBER_MARK = b"\1", b"\0"
RUN_BYTES, NUMBER_BYTES = 1 + NAME_BYTES, 9
#: Bytes of keys in a batch.
BATCH_BYTES = 1 << 24


def _runs(key: bytes) -> int:
    """Runs on the path to a node, with its own."""
    return (len(key) - NUMBER_BYTES) // RUN_BYTES


def _is_first(key: bytes) -> bool:
    """Whether the node is the first of its run."""
    return not any(key[1 - NUMBER_BYTES :])


def keyed(turns: DataFrame, leaves: DataFrame) -> DataFrame:
    """(key, name, parent, level, role, text) of each node, as one of its conversations has it."""
    owners = turns.groupBy("name", "parent").agg(F.min(F.struct("conv_id")).alias("owner"))
    # A conversation that ends is a branch too, so a leaf is the last of its run.
    follow = owners.where("parent IS NOT NULL").select(F.col("parent").alias("name"))
    follow = follow.unionAll(leaves.select(F.col("leaf").alias("name")).distinct())
    splits = follow.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select("name", F.lit(True).alias("splits"))
    told = owners.select("name", "owner").join(splits, "name", "left")
    speaks = F.col("owner.conv_id").eqNullSafe(F.col("conv_id"))
    # Texts go along with one conversation only.
    spoken = [F.when(speaks, F.col(c)).alias(c) for c in ("role", "text")]
    rows = turns.join(told, "name").select("conv_id", "level", "name", "parent", *spoken, F.coalesce("splits", F.lit(False)).alias("splits"), speaks.alias("speaks"))
    names = ["key", "name", "parent", "level", "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, runs, number, split = object(), b"", 0, True
        for batch in batches:
            keys, at, size = [], [], 0

            def done() -> pa.RecordBatch:
                chosen = batch.take(pa.array(at, pa.int64()))
                return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *[chosen.column(i) for i in (2, 3, 1, 4, 5)]], names=names)

            for i, (conv_id, name, splits, own) in enumerate(zip(*[batch.column(c).to_pylist() for c in (0, 2, 6, 7)])):
                if conv_id != current:
                    current, runs, split = conv_id, b"", True
                if split:
                    runs, number = runs + RUN_MARK + name, 0
                if own:
                    keys.append(runs + NUMBER_MARK + number.to_bytes(NUMBER_BYTES - 1, "big"))
                    at.append(i)
                    size += len(keys[-1])
                number, split = number + 1, splits
                if size > BATCH_BYTES:
                    yield done()
                    keys, at, size = [], [], 0
            if keys:
                yield done()

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "level")
    return ordered.mapInArrow(run, "key binary, name binary, parent binary, level int, role string, text string")


class _Open(NamedTuple):
    """A run on the stack: its interval in the sequence of its tree so far, and the tokens above it."""

    start: int
    tokens: int
    above: int


def lay_out(turns: DataFrame, leaves: DataFrame, path: str | None = None) -> DataFrame:
    """The nodes of all prefix trees, a row for each.

    - ``tree``, ``name``, ``parent`` (null at a root), ``level``
    - ``formatted``: the turn under the template; ``text_start``, ``text_end``: its text in it
    - ``ids``: its tokens; ``trained``: whether its text bears loss
    - ``seq_start``, ``n_tokens``: its interval in the tree's sequence
    - ``position``: position id of its first token; the others follow
    - ``run``: where its run starts in the sequence
    - ``attends``: intervals (start, end) of its ancestors in the sequence, root first, one for each
      run; inside itself a node attends causally
    """
    path = path or vocabulary(VOCABULARY)

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(path).encode_ordinary
        for batch in batches:
            turns = [format_turn(r, t) for r, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            ids = [turn_ids(f, encode) for f, _, _ in turns]
            trained = [r == TRAINED for r in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(i) for i in range(4)],
                    pa.array([f for f, _, _ in turns], pa.string()),
                    pa.array([a for _, a, _ in turns], pa.int64()),
                    pa.array([b for _, _, b in turns], pa.int64()),
                    pa.array(ids, pa.list_(pa.int32())),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array(trained, pa.bool_()),
                ],
                names=["key", "name", "parent", "level", "formatted", "text_start", "text_end", "ids", "n_tokens", "trained"],
            )

    columns = "key binary, name binary, parent binary, level int, formatted string, text_start bigint, text_end bigint, ids array<int>, n_tokens bigint, trained boolean"
    nodes = keep(keyed(turns, leaves).mapInArrow(formatted, columns))
    ranges = max(1, -(-nodes.count() // RANGE_ROWS))
    ordered = nodes.repartitionByRange(ranges, "key").sortWithinPartitions("key")
    # The bounds of the ranges come from a sample, so the sorted ranges are kept as they are.
    ordered = keep(ordered.withColumn("range", F.spark_partition_id()))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one range: its tokens after its last root (or all), whether it has a root, and the runs open at its end.

        A run has its depth, start and tokens; one that an earlier range began has no start.
        """
        number, depth, at, rooted = None, 0, 0, False
        stack: list[list] = []
        for batch in batches:
            for r, k, n in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                number, depth = r, _runs(k)
                if _is_first(k):
                    if depth == 1:
                        at, rooted = 0, True
                    while stack and stack[-1][0] >= depth:
                        stack.pop()
                    stack.append([depth, at, 0])
                elif not stack:
                    stack.append([depth, None, 0])
                stack[-1][2] += n
                at += n
        if number is not None:
            depths, starts, sizes = zip(*stack)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([depth], pa.int32()), pa.array([rooted]), pa.array([at], pa.int64()), pa.array([depths], pa.list_(pa.int32())), pa.array([starts], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))],
                names=["range", "depth", "rooted", "at", "depths", "starts", "sizes"],
            )

    told = ordered.select("range", "key", "n_tokens").mapInArrow(
        summary, "range int, depth int, rooted boolean, at bigint, depths array<int>, starts array<bigint>, sizes array<bigint>"
    )
    # A row for each partition. What enters a range is what the ranges before it leave open.
    entering: dict[int, tuple[list[_Open], int]] = {}
    stack, at = [], 0
    for row in sorted(told.collect(), key=lambda r: r["range"]):
        entering[row["range"]] = (stack, at)
        base = 0 if row["rooted"] else at
        own = {d: (s, n) for d, s, n in zip(row["depths"], row["starts"], row["sizes"])}
        left: list[_Open] = []
        for d in range(1, row["depth"] + 1):
            start, tokens = own.get(d, (None, 0))
            if start is None:
                start, tokens = stack[d - 1].start, stack[d - 1].tokens + tokens
            else:
                start += base
            left.append(_Open(start, tokens, left[-1].above + left[-1].tokens if left else 0))
        stack, at = left, base + row["at"]
    shared = turns.sparkSession.sparkContext.broadcast({k: ([tuple(o) for o in s], a) for k, (s, a) in entering.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack, at = None, 0
        spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        kinds = dict(tree=pa.binary(), seq_start=pa.int64(), position=pa.int64(), run=pa.int64(), attends=spans)
        for batch in batches:
            out: dict[str, list] = {k: [] for k in kinds}
            for r, k, n in zip(*[batch.column(i).to_pylist() for i in (10, 0, 8)]):
                if stack is None:
                    opened, at = shared.value[r]
                    stack = [_Open(*o) for o in opened]
                depth = _runs(k)
                if _is_first(k):
                    if depth == 1:
                        at = 0  # a new tree
                    del stack[depth - 1 :]
                    stack.append(_Open(at, 0, stack[-1].above + stack[-1].tokens if stack else 0))
                own = stack[-1]
                out["tree"].append(k[1:RUN_BYTES])
                out["seq_start"].append(at)
                out["position"].append(own.above + own.tokens)
                out["run"].append(own.start)
                out["attends"].append([{"start": o.start, "end": o.start + o.tokens} for o in stack if o.tokens])
                stack[-1] = own._replace(tokens=own.tokens + n)
                at += n
            if out["tree"]:
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(v, kinds[k]) for k, v in out.items()], *[batch.column(i) for i in range(1, 10)]],
                    names=[*out, *batch.schema.names[1:10]],
                )

    schema = (
        "tree binary, seq_start bigint, position bigint, run bigint, attends array<struct<start: bigint, end: bigint>>, "
        "name binary, parent binary, level int, formatted string, text_start bigint, text_end bigint, ids array<int>, n_tokens bigint, trained boolean"
    )
    return ordered.mapInArrow(place, schema)


def with_each_ancestor(nodes: DataFrame) -> DataFrame:
    """``attends`` with an interval for each ancestor in place of one for each run.

    That has the square of the turns of a conversation in rows; ``lay_out`` alone has not.
    """
    spans = nodes.select("name", "tree", F.explode("attends").alias("a")).select("name", "tree", F.col("a.start").alias("run"), F.col("a.end").alias("upto"))
    each = spans.join(nodes.select("tree", "run", "seq_start", "n_tokens"), ["tree", "run"]).where("seq_start < upto")
    span = F.struct(F.col("seq_start").alias("start"), (F.col("seq_start") + F.col("n_tokens")).alias("end"))
    lists = each.groupBy("name").agg(F.sort_array(F.collect_list(span)).alias("each"))
    found = nodes.join(lists, "name", "left").withColumn("attends", F.coalesce("each", F.filter("attends", lambda a: F.lit(False))))
    return found.select(nodes.columns)


def read_back(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """Conversations from the laid-out trees: digests of what a leaf and its ancestors say.

    ``leaves`` has (leaf) names; the result has for each: ``n_turns``, ``turns_sha256``, ``loss_chars``,
    ``loss_sha256`` and ``formatted_chars``. A leaf, the last of its run, finds the runs above by their
    intervals in the sequence of its tree, and the turns are parsed from the formatted texts.
    """
    ends = leaves.select(F.col("leaf").alias("name")).distinct().join(nodes.select("name", "tree", "run", "attends"), "name")
    starts = F.array_union(F.transform("attends", lambda s: s["start"]), F.array("run"))
    path = ends.select(F.col("name").alias("leaf"), "tree", F.explode(starts).alias("run"))
    told = path.join(nodes.select("tree", "run", "seq_start", "formatted", "text_start", "text_end", "trained"), ["tree", "run"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for name, whole, a, b, trained in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                if name != leaf:
                    if state is not None:
                        done.append(_settled(leaf, state))
                    leaf, state = name, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = parse_turn(whole)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[4] += len(whole)
                if trained:
                    said = unescape(whole[a:b])
                    state[2] += len(said)
                    state[3].update(said.encode())
            if done:
                yield _digests(done)
        if state is not None:
            yield _digests([_settled(leaf, state)])

    rows = told.repartition("leaf").sortWithinPartitions("leaf", "seq_start").select("leaf", "formatted", "text_start", "text_end", "trained")
    return rows.mapInArrow(
        run, "leaf binary, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )


def _settled(leaf: bytes, state: list) -> tuple:
    return leaf, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]


def _digests(rows: Sequence[tuple]) -> pa.RecordBatch:
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def trees_of(conversations: DataFrame, path: str | None = None, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of the prefix trees, whose ``attends`` go by runs, and (conv_id, leaf).

    Rows with a null conversation id are one conversation of that id. An empty table gives empty
    results. Columns other than the four that are named are not read.
    """
    turns = keep(turns_of(conversations, **columns))
    leaves = keep(leaves_of(turns))
    return keep(lay_out(turns, leaves, path)), leaves


def format_conversations(conversations: DataFrame, path: str | None = None, **columns: str) -> tuple[DataFrame, DataFrame]:
    """As ``trees_of``, with an interval for each ancestor; for conversations of few turns."""
    nodes, leaves = trees_of(conversations, path, **columns)
    return with_each_ancestor(nodes), leaves


def conversation_digests(conversations: DataFrame, path: str | None = None, **columns: str) -> DataFrame:
    """Format all conversations, read them back from the trees, and return their digests."""
    nodes, leaves = trees_of(conversations, path, **columns)
    return leaves.join(read_back(nodes, leaves), "leaf").drop("leaf")
