"""Prefix trie of conversations, by vertical bitmaps in shards.

A conversation is the sequence of its turns, each named by a digest of role and
text. A prefix with more than ``SHARD`` conversations is heavy; heavy prefixes are
found by counting, are few (all turns over ``SHARD`` at most), and are prefixes of
each other only. What hangs below them are light subtrees, whole ones of at most
``SHARD`` conversations each, and those are the shards.

In a shard, (position, turn) is indexed to the set of conversations that have the
turn there, as the bits of a number, in ascending order of their ids. From the
shard's top down, depth first, a node's set is intersected with the postings of
the next position: each non-empty intersection is a child, its bits counted are
its conversations, its lowest bit is the least of them, and the bits of those that
have no further turn are its end list. A first turn or a conversation that a third
of all share is spread over many shards; heavy nodes get the sums of what hangs
below them, and their end lists are hashed in a stream of sorted pieces.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeline.llm import words as W
from citeline.llm.columns import lists
from citeline.llm.tables import store

#: Conversations of a shard at most.
SHARD = 1024
#: Node rows that a task gathers before it hands them on, and characters of a
#: piece of an end list, about.
_ROWS, _PIECE = 1 << 13, 1 << 20
_EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, turns): every conversation as an array of structs of turn, digest
    (16 bytes that stand for role and text) and size (characters of the text), by
    turn, null first; turns of one number by their digests. A null role or text is
    empty. Rows without a conversation are left out. A conversation's digests, not
    its texts, are held by one row."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(r).cast("string"), F.lit(":"), r, t), 256), 1, 32))
    one = F.struct(F.col(turn).alias("turn"), digest.alias("digest"), F.char_length(t).cast("long").alias("size"))
    return (
        conversations.where(F.col(conv_id).isNotNull())
        .select(F.col(conv_id).alias("conv_id"), one.alias("one"))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list("one")).alias("turns"))
    )


def rebuilt(held: DataFrame) -> DataFrame:
    """Conversations that share beginnings: the first h turns of conversation
    c - c % 100, then c's own after its first h; h is the CRC of c, modulo 6."""
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    none = F.array().cast(held.schema["turns"].dataType)
    donors = held.where("conv_id % 100 = 0").select(F.col("conv_id").alias("donor"), F.slice("turns", 1, 5).alias("lent"))
    return held.join(donors, F.expr("conv_id - conv_id % 100 = donor"), "left").select(
        "conv_id",
        F.concat(
            F.slice(F.coalesce("lent", none), F.lit(1), h), F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
        ).alias("turns"),
    )


def _keyed(held: DataFrame) -> DataFrame:
    """(conv_id, n, digests, sizes, keys): the turns as bytes, and two numbers
    for each prefix, the empty one first. A prefix's numbers are sums over its
    turns of hashes of the turn at its position."""

    def run(batches):
        for batch in batches:
            column = batch.column("turns")
            n = np.diff(column.offsets.to_numpy())
            flat = column.flatten()
            data, _ = W.buffers(flat.field("digest"))
            raw, sizes = data.tobytes(), flat.field("size").to_numpy(zero_copy_only=False)
            both = np.frombuffer(raw, dtype=np.uint64).reshape(-1, 2)
            first = np.concatenate([[0], np.cumsum(n)])
            place = W.mix((np.arange(len(both)) - np.repeat(first[:-1], n)).astype(np.uint64) + np.uint64(1))
            row = np.repeat(np.arange(len(n)), n + 1)
            last = np.arange(len(row)) - row  # turns up to and with the prefix, over all rows
            keys = []
            for half, other in ((0, 1), (1, 0)):
                sums = np.zeros(len(both) + 1, dtype=np.uint64)
                np.cumsum(W.mix(W.mix(both[:, half] + place) ^ (both[:, other] * np.uint64(0x9E3779B97F4A7C15 + 2 * half))), out=sums[1:])
                keys.append((sums[last] - sums[first[row]]).view(np.int64))
            cuts = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
            packed = np.asarray(sizes, dtype=np.int64).tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("conv_id"),
                    pa.array(n.astype(np.int64)),
                    pa.array([raw[16 * a : 16 * b] for a, b in cuts], pa.binary()),
                    pa.array([packed[8 * a : 8 * b] for a, b in cuts], pa.binary()),
                    lists(pa.StructArray.from_arrays([pa.array(k) for k in keys], names=["a", "b"]), n + 1),
                ],
                names=["conv_id", "n", "digests", "sizes", "keys"],
            )

    return W.bounded_batches(held.select(F.col("conv_id").cast("long"), "turns")).mapInArrow(
        run, "conv_id bigint, n bigint, digests binary, sizes binary, keys array<struct<a:bigint,b:bigint>>"
    )


def _shard_nodes(ids: list[int], digests: list[bytes], sizes: list[np.ndarray], depth: int):
    """(conv_id, depth, parent's conv_id, n_convs, n_children, n_leaves, saved,
    ends) of the subtree of the prefix of ``depth`` turns that all conversations
    share, its top first and without a parent. ``ids`` ascend."""
    postings: dict[tuple[int, bytes], int] = {}
    over: dict[int, int] = {}
    for i, turns in enumerate(digests):
        bit, n = 1 << i, len(turns) // 16
        over[n] = over.get(n, 0) | bit
        for p in range(depth, n):
            at = p, turns[16 * p : 16 * p + 16]
            postings[at] = postings.get(at, 0) | bit
    nodes, up = [], []
    stack = [((1 << len(ids)) - 1, depth, -1)]
    while stack:
        members, d, parent = stack.pop()
        least, own, count = (members & -members).bit_length() - 1, len(nodes), members.bit_count()
        ended = members & over.get(d, 0)
        rest, children, more = members ^ ended, 0, []
        while rest:
            i = (rest & -rest).bit_length() - 1
            child = rest & postings[d, digests[i][16 * d : 16 * d + 16]]
            rest ^= child
            children += 1
            more.append((child, d + 1, own))
        stack.extend(reversed(more))
        ends = []
        while ended:
            low = ended & -ended
            ends.append(ids[low.bit_length() - 1])
            ended ^= low
        saved = (count - 1) * int(sizes[least][d - 1]) if d else 0
        nodes.append([ids[least], d, nodes[parent][0] if parent >= 0 else None, count, children, int(not children), saved, ends])
        up.append(parent)
    for own in reversed(range(1, len(nodes))):
        nodes[up[own]][5] += nodes[own][5]
        nodes[up[own]][6] += nodes[own][6]
    return nodes


_NODE = (
    "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
    "saved_tokens bigint, ends_sha256 string, top boolean, pa bigint, pb bigint"
)


def _light(shards: DataFrame) -> DataFrame:
    """Nodes of the shards (a, b, pa, pb, depth, conv_id, digests, sizes): those
    of one shard lie together and sorted, and one is held at a time."""
    ordered = shards.repartition("a", "b").sortWithinPartitions("a", "b", "conv_id")
    names = [x.split()[0] for x in _NODE.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string(), pa.bool_(), pa.int64(), pa.int64()]

    def packed(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def solved(held, key):
        sizes = [np.frombuffer(r["sizes"], dtype=np.int64) for r in held]
        found = _shard_nodes([r["conv_id"] for r in held], [r["digests"] for r in held], sizes, held[0]["depth"])
        for i, (*node, ends) in enumerate(found):
            name = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest() if ends else _EMPTY
            yield (*node, name, i == 0, *(key[2:] if i == 0 else (None, None)))

    def run(batches):
        held, key, rows = [], None, []
        for batch in batches:
            for r in batch.to_pylist():
                if (r["a"], r["b"], r["pa"], r["pb"]) != key:
                    if held:
                        rows.extend(solved(held, key))
                    held, key = [], (r["a"], r["b"], r["pa"], r["pb"])
                    if len(rows) >= _ROWS:
                        yield packed(rows)
                        rows = []
                held.append(r)
        if held:
            rows.extend(solved(held, key))
        yield packed(rows)

    return W.bounded_batches(ordered).mapInArrow(run, _NODE)


def _hashed_ends(ended: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) of lists of ids (a, b, conv_id). Ranges of ids make
    sorted pieces; the pieces of a list are hashed one after the other."""

    def cut(batches):
        held: dict[tuple[int, int], list] = {}
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                key = r["a"], r["b"]
                piece = held.setdefault(key, [r["conv_id"], [], 0])
                piece[1].append(str(r["conv_id"]))
                piece[2] += len(piece[1][-1]) + 1
                if piece[2] >= _PIECE:
                    rows.append((*key, piece[0], ",".join(piece[1])))
                    del held[key]
            yield given(rows)
        yield given([(*key, at, ",".join(ids)) for key, (at, ids, _) in held.items()])

    def given(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "first", "piece"]
        )

    def chain(batches):
        key, state = None, None
        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if (r["a"], r["b"]) != key:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (r["a"], r["b"]), hashlib.sha256(r["piece"].encode())
                else:
                    state.update(b"," + r["piece"].encode())
            yield hashed(done)
        yield hashed([(*key, state.hexdigest())] if key else [])

    def hashed(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        kinds = [pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "ends_sha256"])

    sorted_ids = ended.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    pieces = W.bounded_batches(sorted_ids).mapInArrow(cut, "a bigint, b bigint, first bigint, piece string")
    ordered = pieces.repartition("a", "b").sortWithinPartitions("a", "b", "first")
    return ordered.mapInArrow(chain, "a bigint, b bigint, ends_sha256 string")


def trie(held: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per node of the prefix trie of conversations (conv_id, turns), as
    ``sequences`` makes them, the root included: conv_id (the least of its
    conversations), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves (nodes without children in its subtree), saved_tokens
    (over its subtree, each node's last text in characters times its conversations
    but one) and ends_sha256 (of the ids that end there, ascending, comma-joined).

    Conversations without turns end at the root. Ids are whole numbers, one row
    each. Equal conversations share all nodes. A table without conversations has
    no nodes. A conversation of any length is one row of 24 bytes per turn.
    """
    keyed = store(_keyed(held))
    each = keyed.select("conv_id", F.posexplode("keys").alias("depth", "key")).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "key.a", "key.b"
    )
    heavy = store(
        each.groupBy("depth", "a", "b").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where(F.col("n_convs") > shard)
    )
    # the empty prefix is everyone's: it needs no join
    top = int(not heavy.where("depth = 0").isEmpty())
    above = (
        each.where("depth > 0").join(heavy.where("depth > 0").select("depth", "a", "b"), ["depth", "a", "b"])
        .groupBy("conv_id").agg(F.count("*").alias("deep"))
    )
    split = store(
        keyed.join(above, "conv_id", "left")
        .withColumn("depth", F.coalesce("deep", F.lit(0)) + top)
        .withColumns({"low": F.get("keys", F.col("depth").cast("int")), "up": F.get("keys", (F.col("depth") - 1).cast("int"))})
        .select("conv_id", "n", "depth", "digests", "sizes", "keys", F.col("low.a").alias("a"), F.col("low.b").alias("b"),
                F.col("up.a").alias("pa"), F.col("up.b").alias("pb"))
    )
    light = store(_light(split.where("n >= depth").select("a", "b", "pa", "pb", "depth", "conv_id", "digests", "sizes")))
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not top:
        return light.select(*result)
    tops = light.where("top")
    below = tops.groupBy("pa", "pb").agg(
        F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")
    )
    ends = _hashed_ends(split.where("n < depth").select(F.col("pa").alias("a"), F.col("pb").alias("b"), "conv_id"))
    at = F.col("depth").cast("int")
    size = F.conv(F.hex(F.reverse(F.expr("substring(sizes, 8 * (depth - 1) + 1, 8)"))), 16, 10).cast("long")
    found = (
        heavy.join(keyed.select("conv_id", "keys", "sizes"), "conv_id")
        .withColumn("up", F.get("keys", at - 1))
        .select(
            "depth", "a", "b", "n_convs", "conv_id", F.col("up.a").alias("pa"), F.col("up.b").alias("pb"),
            F.when(F.col("depth") > 0, (F.col("n_convs") - 1) * size).otherwise(0).alias("own"),
            F.slice("keys", F.lit(1), at + 1).alias("path"),
        )
    )
    kids = found.where("depth > 0").groupBy("pa", "pb").agg(F.count("*").alias("heavy_children"))
    named = lambda df: df.withColumnsRenamed({"pa": "a", "pb": "b"})
    zero = lambda name: F.coalesce(name, F.lit(0))
    found = store(
        found.join(named(below), ["a", "b"], "left").join(named(kids), ["a", "b"], "left").join(ends, ["a", "b"], "left")
        .withColumn("n_children", zero("children") + zero("heavy_children"))
        .withColumns({
            "leaves": zero("leaves") + (F.col("n_children") == 0).cast("long"),
            "saved": zero("saved") + F.col("own"),
            "ends_sha256": F.coalesce("ends_sha256", F.lit(_EMPTY)),
        })
    )
    sums = (
        found.select(F.explode("path").alias("key"), "leaves", "saved").groupBy("key.a", "key.b")
        .agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    )
    parents = found.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("held_by"))
    heads = found.join(sums, ["a", "b"]).join(parents, ["pa", "pb"], "left").withColumn("parent_conv_id", F.col("held_by"))
    hung = tops.drop("parent_conv_id").join(parents, ["pa", "pb"]).withColumn("parent_conv_id", F.col("held_by"))
    return light.where("NOT top").select(*result).union(hung.select(*result)).union(heads.select(*result))


def prefix_trie(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    shard: int = SHARD,
) -> DataFrame:
    """The trie of a table of turns: ``trie`` of its ``sequences``. Columns other
    than those named are not looked at."""
    return trie(sequences(conversations, conv_id, turn, role, text), shard)
