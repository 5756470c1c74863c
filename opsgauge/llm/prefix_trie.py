"""The prefix trie of conversations: which turns are shared, by whom, and what sharing them saves.

Conversations become sequences of turn digests, range-partitioned and sorted by sequence and id, so that
one very common conversation is spread over many tasks.  Each task cuts its range into shards of
bounded size; in a shard the digests are encoded by a dictionary and the sequences are put into a ternary search
tree, the median first and then the medians of both halves, which keeps it balanced.  A
traversal without recursion accumulates members, leaves and savings from the bottom.  Only nodes
on a shard's first or last sequence can lie in other shards too: these few are merged by their key,
and what a merged node adds to the nodes above it is passed up along one of its paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgauge.llm.shared import bounded_batches, col, small, written

# A shard is closed once it holds so many turns; a longer conversation is a shard of its own.
SHARD_TURNS = 200_000
_DIGEST = 16
_ROOT = hashlib.md5(b"root").digest()
_INNER, _EDGE = 0, 1

_NODES = (
    "kind int, walk string, node binary, parent binary, depth bigint, tokens bigint, conv_id bigint, "
    "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends array<bigint>"
)


def turn_sequences(
    conversations: DataFrame,
    id_column: str = "conv_id",
    turn_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``conv_id, turns``: each conversation's turns in order, as digests of role and text, with the text's length.

    NULL turns come first; turns of equal number are ordered by digest.  NULL roles and texts are empty. Rows
    without an id belong to no conversation.  Texts stay where they are: 32 hexadecimal digits a turn are moved.
    """
    role, text = F.coalesce(col(role_column), F.lit("")), F.coalesce(col(text_column), F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turn = F.struct(
        col(turn_column).isNotNull().alias("numbered"),
        col(turn_column).alias("turn"),
        F.md5(F.encode(content, "UTF-8")).alias("code"),
        F.length(text).alias("tokens"),
    )
    listed = (
        conversations.filter(col(id_column).isNotNull())
        .groupBy(col(id_column).cast("bigint").alias("conv_id"))
        .agg(F.sort_array(F.collect_list(turn)).alias("t"))
    )
    return listed.select(
        "conv_id", F.transform("t", lambda x: F.struct(x["code"].alias("code"), x["tokens"].alias("tokens"))).alias("turns")
    )


def with_shared_heads(sequences: DataFrame, block: int, shared: Column, most: int) -> DataFrame:
    """Each conversation with its first ``shared`` turns (``most`` at most) taken from the first one of its block.

    A block is ``block`` consecutive ids; its first one is the id that ``block`` divides.  Of it all turns
    are taken if it has fewer and none if it is absent; the conversation's own turns follow after its first ``shared``.
    """
    heads = sequences.filter(F.col("conv_id") % block == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("turns", 1, most).alias("head")
    )
    joined = sequences.withColumn("h", shared.cast("int")).join(
        heads, F.col("conv_id") - F.col("conv_id") % block == F.col("head_id"), "left"
    )
    none = F.array().cast(sequences.schema["turns"].dataType)
    # Without turns of their own these lists are empty, never NULL.
    head = F.when(F.col("head").isNull(), none).otherwise(F.slice("head", F.lit(1), F.col("h")))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


class _Tree:
    """A ternary search tree of one shard; node 0 is the root of the trie."""

    def __init__(self) -> None:
        self.code, self.low, self.equal, self.high = [-1], [-1], [-1], [-1]
        self.above, self.tokens, self.ends = [-1], [0], [-1]

    def _new(self, code: int, above: int, tokens: int) -> int:
        for column, value in (
            (self.code, code), (self.low, -1), (self.equal, -1), (self.high, -1),
            (self.above, above), (self.tokens, tokens), (self.ends, -1),
        ):
            column.append(value)
        return len(self.code) - 1

    def insert(self, codes: list[int], tokens: list[int], sequence: int) -> None:
        code, low, equal, high = self.code, self.low, self.equal, self.high
        above = 0
        for at, value in enumerate(codes):
            node = equal[above]
            if node < 0:
                node = equal[above] = self._new(value, above, tokens[at])
            while code[node] != value:
                side = low if value < code[node] else high
                if side[node] < 0:
                    side[node] = self._new(value, above, tokens[at])
                node = side[node]
            above = node
        self.ends[above] = sequence

    def path(self, codes: list[int]) -> list[int]:
        """The nodes of an inserted sequence, the root first."""
        found = [0]
        for value in codes:
            node = self.equal[found[-1]]
            while self.code[node] != value:
                node = self.low[node] if value < self.code[node] else self.high[node]
            found.append(node)
        return found

    def preorder(self) -> list[int]:
        """All nodes, each after the one above it."""
        found, stack = [], [0]
        while stack:
            node = stack.pop()
            found.append(node)
            for link in (self.high[node], self.equal[node], self.low[node]):
                if link >= 0:
                    stack.append(link)
        return found


def _shard_nodes(ids: list[int], paths: list[bytes], tokens: list[list[int]], walk: str) -> dict[str, list]:
    """The nodes of one shard of sorted sequences, as columns."""
    members: list[list[int]] = []
    distinct: list[int] = []
    for at, path in enumerate(paths):
        if distinct and path == paths[distinct[-1]]:
            members[-1].append(ids[at])
        else:
            distinct.append(at)
            members.append([ids[at]])
    parts = [[paths[at][i : i + _DIGEST] for i in range(0, len(paths[at]), _DIGEST)] for at in distinct]
    known = sorted({part for sequence in parts for part in sequence})
    numbers = {part: number for number, part in enumerate(known)}
    codes = [[numbers[part] for part in sequence] for sequence in parts]

    tree = _Tree()
    spans = [(0, len(codes))]
    while spans:
        begin, end = spans.pop()
        if begin < end:
            middle = (begin + end) // 2
            tree.insert(codes[middle], tokens[distinct[middle]], middle)
            spans.append((middle + 1, end))
            spans.append((begin, middle))

    size = len(tree.code)
    first, last = tree.path(codes[0]), tree.path(codes[-1])
    edge = set(first) | set(last)
    count, least, kids, leaves, saved = [0] * size, [None] * size, [0] * size, [0] * size, [0] * size
    order = tree.preorder()
    keys: list[bytes] = [_ROOT] * size
    for node in order[1:]:
        keys[node] = hashlib.md5(keys[tree.above[node]] + known[tree.code[node]]).digest()
    for node in reversed(order):
        if tree.ends[node] >= 0:
            own = members[tree.ends[node]]
            count[node] += len(own)
            least[node] = own[0] if least[node] is None else min(least[node], own[0])
        above = tree.above[node]
        if node not in edge:
            leaves[node] += kids[node] == 0
            saved[node] += (count[node] - 1) * tree.tokens[node]
            kids[above] += 1
        if above >= 0:
            count[above] += count[node]
            leaves[above] += leaves[node]
            saved[above] += saved[node]
            least[above] = least[node] if least[above] is None else min(least[above], least[node])

    depth = [0] * size
    for node in order[1:]:
        depth[node] = depth[tree.above[node]] + 1
    rows: dict[str, list] = {name.split()[0]: [] for name in _NODES.split(", ")}

    def add(kind: int, node: int, label: str | None, counted: bool) -> None:
        above = tree.above[node]
        inside = kind == _INNER and above not in edge
        values = (
            kind, label, keys[node], keys[above] if above >= 0 and not inside else None, depth[node], tree.tokens[node],
            least[node], least[above] if inside else None,
            *((count[node], kids[node], leaves[node], saved[node]) if counted else (0, 0, 0, 0)),
            members[tree.ends[node]] if counted and tree.ends[node] >= 0 else [],
        )
        for column, value in zip(rows.values(), values, strict=True):
            column.append(value)

    for node in order:
        if node not in edge:
            add(_INNER, node, None, True)
    for node in first:
        add(_EDGE, node, f"{walk}-first", True)
    shared = set(first)
    for node in last:
        # Nodes of both walks count once.
        add(_EDGE, node, f"{walk}-last", node not in shared)
    return rows


_ARROW = pa.schema(
    [
        ("kind", pa.int32()), ("walk", pa.string()), ("node", pa.binary()), ("parent", pa.binary()),
        *[(name, pa.int64()) for name in (
            "depth", "tokens", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
        ("ends", pa.list_(pa.int64())),
    ]
)


def _tries(shard_turns: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, shard, held = TaskContext.get().partitionId(), 0, 0
        ids: list[int] = []
        paths: list[bytes] = []
        tokens: list[list[int]] = []
        for batch in batches:
            for conv, path, sizes in zip(*(batch.column(at).to_pylist() for at in range(3)), strict=True):
                if ids and held + len(sizes) + 1 > shard_turns:
                    yield pa.RecordBatch.from_pydict(_shard_nodes(ids, paths, tokens, f"{task}-{shard}"), _ARROW)
                    shard, held, ids, paths, tokens = shard + 1, 0, [], [], []
                ids.append(conv)
                paths.append(path)
                tokens.append(sizes)
                held += len(sizes) + 1
        if ids:
            yield pa.RecordBatch.from_pydict(_shard_nodes(ids, paths, tokens, f"{task}-{shard}"), _ARROW)

    return read


def prefix_trie(sequences: DataFrame, shard_turns: int = SHARD_TURNS) -> tuple[DataFrame, DataFrame]:
    """The nodes of the trie of ``conv_id, turns`` and, for nodes that lie in several shards, the members that end there.

    Nodes: ``node`` (a key), ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``,
    ``n_children``, ``n_leaves`` (childless nodes of the subtree), ``saved_tokens`` (over the subtree: members but one, times
    the turn's length) and ``ends``, the ascending ids of the members that have no further turn; it is NULL for
    nodes whose members are listed in the second table as ``node, first, conv_ids``: ascending lists, each bounded
    by a shard, ordered by ``first``.  A conversation without turns ends at the root, whose parent is NULL.
    Ids are distinct.  No rows: no nodes.
    """
    bounded_batches(sequences.sparkSession)
    flat = sequences.select(
        "conv_id",
        F.unhex(F.array_join(F.transform("turns", lambda x: x["code"]), "")).alias("path"),
        F.transform("turns", lambda x: x["tokens"]).alias("tokens"),
    )
    ordered = flat.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    found = written(ordered.mapInArrow(_tries(shard_turns), _NODES), "shards")

    # The nodes on the first and last sequences of the shards: a path for each shard's end.
    edge = found.filter(F.col("kind") == _EDGE)
    merged = edge.groupBy("node").agg(
        F.max("parent").alias("parent"),
        F.max("depth").alias("depth"),
        F.max("tokens").alias("tokens"),
        F.min("conv_id").alias("conv_id"),
        *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.min("walk").alias("owner"),
    )
    merged = written(merged, "merged")
    kids = merged.filter(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("kids"))
    merged = merged.join(kids, "node", "left").withColumn("n_children", F.col("n_children") + F.coalesce("kids", F.lit(0)))
    merged = written(
        merged.withColumns(
            {
                "own_leaf": (F.col("n_children") == 0).cast("bigint"),
                "own_saved": (F.col("n_convs") - 1) * F.col("tokens"),
            }
        ),
        "merged",
    )
    # Each merged node adds to those above it along one of the walks it lies on.
    below = Window.partitionBy("walk").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    owned = merged.select("node", "owner", "own_leaf", "own_saved")
    counts = F.col("walk") == F.col("owner")
    added = (
        edge.select("node", "walk", "depth")
        .join(small(owned, 96), "node")
        .select(
            "node",
            F.sum(F.when(counts, F.col("own_leaf"))).over(below).alias("leaves"),
            F.sum(F.when(counts, F.col("own_saved"))).over(below).alias("saved"),
        )
        .groupBy("node")
        .agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    )
    zero = F.lit(0).cast("bigint")
    whole = merged.join(added, "node", "left").select(
        "node",
        "parent",
        "conv_id",
        "depth",
        "n_convs",
        "n_children",
        (F.col("n_leaves") + F.col("own_leaf") + F.coalesce("leaves", zero)).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("own_saved") + F.coalesce("saved", zero)).alias("saved_tokens"),
    )
    whole = written(whole, "edge_nodes")
    parents = small(whole.select(F.col("node").alias("parent"), F.col("conv_id").alias("above")), 32)
    shown = ("node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
    inner = found.filter(F.col("kind") == _INNER).join(parents, "parent", "left")
    inner = inner.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*shown, "ends")
    whole = whole.join(parents, "parent", "left").withColumnRenamed("above", "parent_conv_id")
    nodes = inner.union(whole.select(*shown, F.lit(None).cast("array<bigint>").alias("ends")))
    ends = edge.filter(F.size("ends") > 0).select("node", F.get("ends", F.lit(0)).alias("first"), F.col("ends").alias("conv_ids"))
    return nodes, ends


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's comma-joined ids, list by list; rows are sorted by node and first id."""
    node, digest = None, None
    schema = pa.schema([("node", pa.binary()), ("ends_sha256", pa.string())])
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("conv_ids"), strict=True):
            joined = ",".join(map(str, ids.values.to_pylist())).encode()
            if key == node:
                digest.update(b"," + joined)
            else:
                if node is not None:
                    done.append((node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(joined)
        yield pa.RecordBatch.from_pydict({"node": [row[0] for row in done], "ends_sha256": [row[1] for row in done]}, schema)
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [digest.hexdigest()]}, schema)


def with_ends_digest(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """``nodes`` with ``ends_sha256``, the digest of the ids that end at each node, instead of the ids.

    A digest reads its ids one after the other, so those of one node pass one task, a list at a time.
    """
    ordered = ends.repartition("node").sortWithinPartitions("node", "first")
    digests = written(ordered.mapInArrow(_digests, "node binary, ends_sha256 string"), "digests")
    inner = nodes.filter(F.col("ends").isNotNull())
    edge = nodes.filter(F.col("ends").isNull()).join(small(digests, 96), "node", "left")
    names = [name for name in nodes.columns if name != "ends"]
    own = F.sha2(F.encode(F.array_join(F.col("ends").cast("array<string>"), ","), "UTF-8"), 256)
    return inner.select(*names, own.alias("ends_sha256")).union(
        edge.select(*names, F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"))
    )
