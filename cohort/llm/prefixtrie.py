"""A prefix trie of conversations in double arrays.

Every conversation becomes a sequence of turn tokens (a digest of role and text, and the bytes of the
text). Equal sequences are one sequence with a weight. Sequences are sorted across the cluster, so a
prefix shard, a run of sequences of bounded size, holds each of its prefixes in one piece. A task
gives the turns of a shard dense ids, packs the shard's trie into BASE and CHECK arrays (the child of
state s by turn id x is ``BASE[s] + x``, and ``CHECK`` of it is ``s``), and walks all sequences through them.

Only prefixes of a shard's first and last sequence can reach into other shards. These two paths,
with the sums that hang off them, are the sequences of the next round, until one shard is left.
What is not on them is final at once.

Long conversations are handled in segments. Beyond the depth to which two different sequences may agree (told
by hashes of the segments), the rest of a sequence is a chain, and its nodes follow from running sums.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from cohort.llm.text import chain, kept, mix, read_table

#: First turns of conversation ``c - c % FAMILY`` that begin conversation c: crc32(c) modulo LENT of them.
FAMILY, LENT = 5, 9
#: Turns of a segment, and of a prefix shard (which also holds sixteen sequences at least).
SEGMENT, SHARD_TURNS = 32, 100_000
LEAST = 16
#: Rows of one conversation that share a join key.
CHUNK = 4096
_TOKEN = np.dtype([("a", ">u8"), ("b", ">u8"), ("size", ">i8")])
_NO = np.iinfo(np.int64).max
_NODE = "depth long, conv long, parent long, n long, children long, leaves long, saved long, ender long, id1 long, id2 long, up1 long, up2 long"
_ITEM = "tokens array<binary>, first int, add_n array<long>, add_conv array<long>, add_ender array<long>, add_children array<long>, add_leaves array<long>, add_saved array<long>"
_ADDS = ("add_n", "add_conv", "add_ender", "add_children", "add_leaves", "add_saved")
_EMPTY = hashlib.sha256(b"").hexdigest()


# ---------------------------------------------------------------- turns in their places

def placed_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """``(conv, at, n, token, size)``: ``n`` equal turns from place ``at`` on.

    Turns are ranked by a sort across the cluster, and places of a conversation that lies over several
    partitions are joined by the counts of the parts, so no task holds a conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = turns.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), role.alias("role"), text.alias("text")).filter("conv is not null")
    same = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("n"))
    order = ["conv", F.col("turn").asc_nulls_first()]
    dealt = same.repartitionByRange(*order, F.substring("role", 1, 32), F.substring("text", 1, 256)).sortWithinPartitions(*order, "role", "text")
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    size = F.octet_length("text").cast("long")
    token = F.unhex(F.concat(digest, F.lpad(F.hex(size), 16, "0")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv, n = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            before = np.cumsum(n) - n
            first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
            at = before - np.repeat(before[first], np.diff(np.r_[first, len(conv)]))
            if conv[0] == last:
                at[conv == last] += done
            last, done = conv[-1], int(at[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], names=["part", "conv", "n", "token", "size", "at"])

    rows = kept(dealt.select(F.spark_partition_id().alias("part"), "conv", "n", token.alias("token"), size.alias("size")).mapInArrow(place, "part int, conv long, n long, token binary, size long, at long"), "turns")
    parts = rows.groupBy("part", "conv").agg(F.sum("n").alias("n"))
    before = parts.withColumn("before", F.sum("n").over(Window.partitionBy("conv").orderBy("part")) - F.col("n")).filter("before > 0").select("part", "conv", "before")
    joined = rows.join(F.broadcast(before), ["part", "conv"], "left")  # one row a partition at most: the conversation that began in an earlier one
    return joined.select("conv", (F.col("at") + F.coalesce("before", F.lit(0))).alias("at"), "n", "token", "size")


def rebuilt(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(conv, length)`` of every rebuilt conversation, and its turns ``(conv, pos, token, size)``."""
    lengths = placed.groupBy("conv").agg(F.sum("n").alias("n"))
    base = F.col("conv") - F.col("conv") % FAMILY
    heads = lengths.filter(base == F.col("conv")).select(F.col("conv").alias("base"), F.col("n").alias("lender"))
    own = F.when(base == F.col("conv"), 0).otherwise(F.crc32(F.col("conv").cast("string")) % LENT)
    plan = lengths.select("conv", "n", base.alias("base"), own.alias("cut")).join(heads, "base", "left")
    plan = plan.withColumn("lent", F.least("cut", F.coalesce("lender", F.lit(0))))
    plan = kept(plan.select("conv", "n", "base", "cut", "lent", (F.col("lent") + F.greatest(F.col("n") - F.col("cut"), F.lit(0))).alias("length")), "plan")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK).cast("long"))
    each = placed.select("conv", "at", "n", "token", "size", F.explode(blocks).alias("block"))
    each = each.select("conv", "token", "size", F.explode(F.sequence(
        F.col("at") + F.col("block") * CHUNK, F.col("at") + F.least((F.col("block") + 1) * CHUNK, F.col("n")) - 1)).alias("pos"))
    keyed = plan.select("conv", "cut", "lent", F.explode(blocks).alias("chunk"))
    kept_own = each.withColumn("chunk", F.floor(F.col("pos") / CHUNK)).join(keyed, ["conv", "chunk"]).filter("pos >= cut")
    kept_own = kept_own.select("conv", (F.col("pos") - F.col("cut") + F.col("lent")).alias("pos"), "token", "size")
    lent = each.filter((F.col("pos") < LENT - 1) & (base == F.col("conv"))).withColumnRenamed("conv", "base")
    lent = lent.join(plan.filter("lent > 0").select("conv", "base", "lent"), "base").filter("pos < lent").select("conv", "pos", "token", "size")
    return plan.select("conv", "length"), kept_own.unionByName(lent)


# ---------------------------------------------------------------- a shard's double arrays

class DoubleArray:
    """BASE and CHECK of the trie of sorted sequences of dense ids; state 0 is the root."""

    def __init__(self, ids: np.ndarray, edges: np.ndarray):
        size = 1024
        self.base, self.check, self.depth = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.check[0], self.end = -2, 1
        state, length = np.zeros(len(edges) - 1, np.int64), np.diff(edges)
        active, level = np.flatnonzero(length > 0), 0
        self.holes = holes = np.zeros(0, np.int64)
        self.seen, at = 1, 0
        while len(active):
            parent, child = state[active], ids[edges[active] + level]
            new = np.r_[True, (parent[1:] != parent[:-1]) | (child[1:] != child[:-1])]
            p, c = parent[new], child[new]
            begin = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
            count = np.diff(np.r_[begin, len(p)])
            slot = np.empty(len(p), np.int64)
            crowded = np.flatnonzero(count > 1)
            for k in crowded:
                own = c[begin[k]: begin[k] + count[k]]
                slot[begin[k]: begin[k] + count[k]] = self._fit(own)
                self._take(slot[begin[k]: begin[k] + count[k]], p[begin[k]], own[0])
            if len(crowded):
                holes, at = np.flatnonzero(self.check[: self.end] == -1), 0
                self.holes, self.seen = holes, self.end
            single = begin[count == 1]
            inner = min(len(single), len(holes) - at)
            free = np.r_[holes[at: at + inner], np.arange(self.end, self.end + len(single) - inner)]
            at += inner
            slot[single] = free
            self._take(free, p[single], c[single])
            self.depth[slot] = level + 1
            state[active] = slot[np.cumsum(new) - 1]
            level += 1
            active = active[length[active] > level]

    def _fit(self, children: np.ndarray) -> np.ndarray:
        """Free slots for all children of a state: among the first holes or some spread over all of them, else beyond all that is taken."""
        wide = children - children.min()
        for fresh in (False, True):
            if fresh:
                if self.end < self.seen + 4096:
                    break
                self.holes, self.seen = np.flatnonzero(self.check[: self.end] == -1), self.end
            n = len(self.holes)
            for k in dict.fromkeys([*range(min(4, n)), *(np.arange(12) * n // 12).tolist()] if n else []):
                wanted = self.holes[k] + wide
                if (self.check[wanted[wanted < self.end]] == -1).all():
                    return wanted
        return self.end + wide

    def _take(self, slots: np.ndarray, parent, child) -> None:
        if not len(slots):
            return
        need = int(slots.max()) + 1
        if need > len(self.check):
            more = max(need, 2 * len(self.check)) - len(self.check)
            self.base, self.depth = np.r_[self.base, np.zeros(more, np.int64)], np.r_[self.depth, np.zeros(more, np.int64)]
            self.check = np.r_[self.check, np.full(more, -1, np.int64)]
        self.end = max(self.end, need)
        self.check[slots] = parent
        self.base[parent] = slots - child if np.ndim(parent) else slots[0] - child

    def walk(self, ids: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """The state after every turn; a turn that the trie does not have is an error."""
        out, length = np.empty(len(ids), np.int64), np.diff(edges)
        state, active, level = np.zeros(len(edges) - 1, np.int64), np.flatnonzero(np.diff(edges) > 0), 0
        while len(active):
            own = edges[active] + level
            to = self.base[state[active]] + ids[own]
            if ((to < 0) | (to >= self.end)).any() or (self.check[to] != state[active]).any():
                raise KeyError("a sequence is not in the trie")
            out[own] = state[active] = to
            level += 1
            active = active[length[active] > level]
        return out


def _shard(tokens: np.ndarray, edges: np.ndarray, first: np.ndarray, adds: dict[str, np.ndarray], whole: bool) -> tuple[pa.RecordBatch, list[dict]]:
    """Final nodes of a shard, and its first and last path as sequences of the next round (none if it is the ``whole``)."""
    order = np.lexsort((tokens["b"], tokens["a"]))
    lanes = tokens["a"][order].astype(np.uint64), tokens["b"][order].astype(np.uint64)
    fresh = np.r_[True, (lanes[0][1:] != lanes[0][:-1]) | (lanes[1][1:] != lanes[1][:-1])] if len(order) else np.zeros(0, bool)
    ids = np.empty(len(order), np.int64)
    ids[order] = np.cumsum(fresh) - 1
    length = np.diff(edges)
    inner = np.arange(len(ids)) - np.repeat(edges[:-1], length)
    seen = np.full(int(fresh.sum()), len(ids))
    np.minimum.at(seen, ids[np.argsort(inner, kind="stable")], np.arange(len(ids)))
    by_seen = np.argsort(seen)  # ids go by first appearance, level by level, so children of a state lie close together
    rank = np.empty(len(seen), np.int64)
    rank[by_seen] = np.arange(len(seen))
    ids = rank[ids]
    trie = DoubleArray(ids, edges)
    states = trie.walk(ids, edges)

    used = np.flatnonzero(trie.check[: trie.end] != -1)
    number = np.full(trie.end, -1, np.int64)
    number[used] = np.arange(len(used))  # the root is 0
    depth, node = trie.depth[used], number[states]
    parent = np.r_[-1, number[trie.check[used[1:]]]]
    turn = trie.base[trie.check[used[1:]]]
    size = np.zeros(len(used), np.int64)
    size[node] = tokens["size"]
    low, high = (np.r_[lane[fresh][by_seen], np.uint64(0)] for lane in lanes)
    turn = np.r_[-1, used[1:] - turn]  # dense id of the last turn

    boundary = np.zeros(len(used), bool)
    if not whole:
        boundary[0] = True
        for k in (0, len(edges) - 2):
            boundary[node[edges[k]: edges[k + 1]]] = True
    reach = length - first + 1  # entries of the add arrays of each sequence
    inner = np.arange(reach.sum()) - np.repeat(np.cumsum(reach) - reach, reach)
    at = np.repeat(first, reach) + inner
    spot = np.repeat(edges[:-1], reach) + at - 1
    where = np.where(at > 0, node[np.minimum(np.maximum(spot, 0), len(node) - 1)] if len(node) else 0, 0)
    sums = {name: np.zeros(len(used), np.int64) for name in ("add_n", "add_children", "add_leaves", "add_saved")}
    for name, total in sums.items():
        np.add.at(total, where, adds[name])
    mins = {name: np.full(len(used), _NO) for name in ("add_conv", "add_ender")}
    for name, least in mins.items():
        np.minimum.at(least, where, adds[name])
    np.add.at(sums["add_children"], parent[1:][~boundary[1:]], 1)

    by_depth = np.argsort(depth, kind="stable")
    levels = np.searchsorted(depth[by_depth], np.arange(int(depth.max()) + 2))
    id1, id2 = np.zeros(len(used), np.uint64), np.zeros(len(used), np.uint64)
    id1[0], id2[0] = 1, 2
    with np.errstate(over="ignore"):
        for d in range(1, len(levels) - 1):
            own = by_depth[levels[d]: levels[d + 1]]
            id1[own] = chain(id1[parent[own]], low[turn[own]])
            id2[own] = chain(id2[parent[own]] ^ mix(low[turn[own]]), high[turn[own]])
    for d in range(len(levels) - 2, 0, -1):
        own = by_depth[levels[d]: levels[d + 1]]
        own = own[~boundary[own]]
        np.add.at(sums["add_n"], parent[own], sums["add_n"][own])
        np.minimum.at(mins["add_conv"], parent[own], mins["add_conv"][own])
    closed = ~boundary
    sums["add_leaves"][closed & (sums["add_children"] == 0)] += 1
    sums["add_saved"][closed] += ((sums["add_n"] - 1) * size)[closed]
    for d in range(len(levels) - 2, 0, -1):
        own = by_depth[levels[d]: levels[d + 1]]
        own = own[~boundary[own]]
        for name in ("add_leaves", "add_saved"):
            np.add.at(sums[name], parent[own], sums[name][own])

    rows = np.flatnonzero(closed)
    up = np.maximum(parent[rows], 0)
    known = (parent[rows] >= 0) & closed[up]
    columns = [
        pa.array(depth[rows]), pa.array(mins["add_conv"][rows]), pa.array(mins["add_conv"][up], mask=~known), pa.array(sums["add_n"][rows]), pa.array(sums["add_children"][rows]),
        pa.array(sums["add_leaves"][rows]), pa.array(sums["add_saved"][rows]), pa.array(mins["add_ender"][rows], mask=mins["add_ender"][rows] == _NO),
        pa.array(id1[rows].view(np.int64)), pa.array(id2[rows].view(np.int64)), pa.array(id1[up].view(np.int64)), pa.array(id2[up].view(np.int64))]
    final = pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _NODE.split(", ")])
    paths = []
    if not whole:
        left, right = node[edges[0]: edges[1]], node[edges[-2]: edges[-1]]
        both = min(len(left), len(right))
        same = int(np.argmin(np.r_[left[:both] == right[:both], False]))
        for k, path, start in ((0, left, 0), (len(edges) - 2, right, same + 1)):
            if start > len(path):
                continue
            nodes = np.r_[0, path][start:]
            paths.append({"tokens": [t.tobytes() for t in tokens[edges[k]: edges[k + 1]]], "first": start, **{
                name: (sums[name] if name in sums else mins[name])[nodes].tolist() for name in _ADDS}})
    return final, paths


def _round(items: DataFrame, whole: bool, shard_turns: int) -> DataFrame:
    """Final nodes and, apart from the last round, the paths for the next; ``items`` lie sorted in their partitions."""
    node_names, item_names = ([c.split()[0] for c in s.split(", ")] for s in (_NODE, _ITEM))
    item_type = pa.schema([("tokens", pa.list_(pa.binary())), ("first", pa.int32()), *[(n, pa.list_(pa.int64())) for n in _ADDS]])
    node_type = pa.schema([(n, pa.int64()) for n in node_names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        held = turns = 0

        def flush() -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting).combine_chunks()
            lists = {n: table.column(n).combine_chunks() for n in ("tokens", *_ADDS)}
            edges = np.r_[0, np.cumsum(lists["tokens"].value_lengths().to_numpy(zero_copy_only=False))].astype(np.int64)
            tokens = np.frombuffer(b"".join(lists["tokens"].flatten().to_pylist()), _TOKEN)
            final, paths = _shard(tokens, edges, table.column("first").to_numpy(), {n: lists[n].flatten().to_numpy() for n in _ADDS}, whole)
            more = pa.RecordBatch.from_pylist(paths, item_type)
            n, m = final.num_rows, more.num_rows
            return pa.RecordBatch.from_arrays(
                [pa.concat_arrays([c, pa.nulls(m, c.type)]) for c in final.columns] + [pa.concat_arrays([pa.nulls(n, c.type), c]) for c in more.columns], names=[*node_names, *item_names])

        for batch in batches:
            sizes = batch.column(0).value_lengths().to_numpy(zero_copy_only=False)
            a = 0
            for b in range(batch.num_rows):
                held, turns = held + 1, turns + int(sizes[b])
                if not whole and held >= LEAST and turns >= shard_turns:
                    waiting.append(batch.slice(a, b + 1 - a))
                    yield flush()
                    waiting.clear()
                    a, held, turns = b + 1, 0, 0
            if a < batch.num_rows:
                waiting.append(batch.slice(a))
        if waiting:
            yield flush()

    assert node_type.names == node_names
    return items.select(*item_names).mapInArrow(work, f"{_NODE}, {_ITEM}")


def trie_nodes(items: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """All nodes of the trie of ``items``: ``depth, conv, parent, n, children, leaves, saved, ender``.

    An item is a path of tokens with what it adds at the nodes from depth ``first`` on: members, smallest
    member, smallest member that ends here, and children, leaves and savings that lie beyond the path.
    """
    nodes = []
    while True:
        n_items, turns = items.agg(F.count("*"), F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()
        if not n_items:
            break
        whole = turns <= shard_turns or n_items <= LEAST
        dealt = items.repartition(1) if whole else items.repartitionByRange(max(1, int(turns // (4 * shard_turns))), "tokens")
        out = kept(_round(dealt.sortWithinPartitions("tokens"), whole, shard_turns), "trie")
        nodes.append(out.filter("depth is not null").drop(*[c.split()[0] for c in _ITEM.split(", ")]))
        if whole:
            break
        items = out.filter("depth is null").select(*[c.split()[0] for c in _ITEM.split(", ")])
    if not nodes:
        return items.sparkSession.createDataFrame([], _NODE).drop("id1", "id2", "up1", "up2")
    later = None
    for part in nodes[1:]:
        later = part if later is None else later.unionByName(part)
    out = nodes[0] if later is None else nodes[0].unionByName(later)
    if later is not None:  # parents on a shard's first or last path became final in a later round
        names = later.select(F.col("id1").alias("up1"), F.col("id2").alias("up2"), F.col("conv").alias("_late"))
        out = out.filter("parent is not null or depth = 0").unionByName(
            out.filter("parent is null and depth > 0").join(names, ["up1", "up2"]).withColumn("parent", F.col("_late")).drop("_late"))
    return out.drop("id1", "id2", "up1", "up2")


# ---------------------------------------------------------------- sequences, chains and ends

def _running(rows: DataFrame) -> DataFrame:
    """Segments with hashes and bytes of all before them in the conversation: within blocks, then over blocks."""
    rows = rows.withColumn("block", F.floor(F.col("seg") / 1024))
    inside = Window.partitionBy("conv", "block").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    sums = {"p1": F.bit_xor("a1"), "p2": F.bit_xor("a2"), "before": F.sum("bytes")}
    blocks = rows.groupBy("conv", "block").agg(*[s.alias(f"b_{n}") for n, s in sums.items()])
    over = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = {"p1": F.bit_xor("b_p1"), "p2": F.bit_xor("b_p2"), "before": F.sum("b_before")}
    blocks = blocks.select("conv", "block", *[F.coalesce(s.over(over), F.lit(0)).alias(f"c_{n}") for n, s in totals.items()])
    rows = rows.select("*", *[F.coalesce(s.over(inside), F.lit(0)).alias(n) for n, s in sums.items()]).join(blocks, ["conv", "block"])
    return rows.withColumns({
        "p1": F.col("p1").bitwiseXOR(F.col("c_p1")), "p2": F.col("p2").bitwiseXOR(F.col("c_p2")), "before": F.col("before") + F.col("c_before")}).drop("c_p1", "c_p2", "c_before", "block")


def _ends(members: DataFrame) -> DataFrame:
    """``(z1, z2, length, ends)``: the digest of each sequence's conversations, read in order, in runs of bounded size."""
    names = ["z1", "z2", "length"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, own in groupby(rows(batches), lambda r: r[:3]):
            start, ids = None, []
            for row in own:
                start = row[3] if start is None else start
                ids.append(str(row[3]))
                if len(ids) == CHUNK:
                    out.append((*key, start, ",".join(ids)))
                    start, ids = None, []
            if ids:
                out.append((*key, start, ",".join(ids)))
            if len(out) >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*names, "start", "ids"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*names, "start", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for key, own in groupby(rows(batches), lambda r: r[:3]):
            digest, comma = hashlib.sha256(), b""
            for row in own:
                digest.update(comma + row[4].encode())
                comma = b","
            out.append((*key, digest.hexdigest()))
            if len(out) >= CHUNK:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*names, "ends"])
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*names, "ends"])

    order = [*names, "conv"]
    parts = members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(runs, "z1 long, z2 long, length long, start long, ids string")
    return parts.repartition(*names).sortWithinPartitions(*names, "start").mapInArrow(digests, "z1 long, z2 long, length long, ends string")


def prefix_nodes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", shard_turns: int = SHARD_TURNS, segment: int = SEGMENT) -> DataFrame:
    """``(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)`` of every node.

    Turns go by ``turn``, null first; equal ones by role, then text, and repeated rows are repeated
    turns. Null roles and texts are empty. Rows without a conversation are left out, other columns
    are not read, and an empty table has no nodes, not even a root.
    """
    plan, turns = rebuilt(placed_turns(turns, conv, turn, role, text))
    parts = turns.groupBy("conv", F.floor(F.col("pos") / segment).alias("seg")).agg(F.sort_array(F.collect_list(F.struct("pos", "token"))).alias("own"), F.sum("size").alias("bytes"))
    segs = kept(parts.select("conv", "seg", F.transform("own", lambda t: t["token"]).alias("tokens"), "bytes"), "segments")
    marks = segs.withColumns({"a1": F.xxhash64("seg", "tokens"), "a2": F.xxhash64(F.lit(7), "seg", "tokens")})
    totals = marks.groupBy("conv").agg(F.bit_xor("a1").alias("z1"), F.bit_xor("a2").alias("z2"), F.sum("bytes").alias("total"))
    convs = kept(plan.join(totals, "conv", "left").select("conv", "length", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("z1", "z2", "total")]), "conversations")
    lines = kept(convs.groupBy("z1", "z2", "length").agg(F.min("conv").alias("conv"), F.count("*").alias("n"), F.max("total").alias("total")), "lines")  # one of equal ones stands for all

    none = F.array().cast("array<binary>")
    short = lines.filter(F.col("length") <= segment).join(segs.select("conv", "tokens"), "conv", "left").select("conv", "n", F.coalesce("tokens", none).alias("tokens"), F.lit(0).cast("long").alias("rest"), F.lit(False).alias("tail"))
    long = _running(lines.filter(F.col("length") > segment).select("conv", "n", "length", "total").join(marks, "conv"))
    place = ["seg", "p1", "p2"]
    forks = long.filter("seg > 0").groupBy(*place).agg(F.count("*").alias("lines")).filter("lines > 1")  # where different sequences still agree
    cut = long.join(forks, place, "left_semi").groupBy("conv").agg(F.max("seg").alias("cut"))
    long = kept(long.join(cut, "conv", "left").withColumn("cut", F.coalesce("cut", F.lit(0).cast("long"))), "long")
    head = long.filter("seg <= cut").groupBy("conv").agg(
        F.max("n").alias("n"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("seg", "tokens"))), lambda s: s["tokens"])).alias("tokens"),
        F.max(F.col("total")).alias("total"), F.sum("bytes").alias("bytes"), F.max("length").alias("length"))
    head = kept(head.select("conv", "n", "tokens", (F.col("total") - F.col("bytes")).alias("rest"), (F.col("length") > F.size("tokens")).alias("tail")), "heads")
    items = short.unionByName(head)

    def one(value) -> F.Column:
        return F.array(value.cast("long"))

    tail = F.col("tail").cast("int")
    items = kept(items.select(
        "tokens", F.size("tokens").alias("first"), one(F.col("n")).alias("add_n"), one(F.col("conv")).alias("add_conv"), one(F.when(F.col("tail"), F.lit(_NO)).otherwise(F.col("conv"))).alias("add_ender"),
        one(tail).alias("add_children"), one(tail).alias("add_leaves"), one(F.when(F.col("tail"), (F.col("n") - 1) * F.col("rest")).otherwise(0)).alias("add_saved")), "items")
    nodes = trie_nodes(items, shard_turns)

    join = head.groupBy("tokens").agg(F.min("conv").alias("above"))  # the node where a chain begins: a sequence that ends there may be smaller
    above = head.filter("tail").join(join, "tokens").select("conv", "above")
    links = long.filter("seg > cut").join(above, "conv").select(
        "conv", "n", "length", "total", "before", "seg", "cut", "above", F.posexplode("tokens").alias("k", "token"), F.col("tokens"))
    size = F.conv(F.hex(F.substring(F.col("token"), 17, 8)), 16, 10).cast("long")
    links = links.select("conv", "n", "length", "total", "before", "seg", "cut", "above", "k", size.alias("size"))
    done = F.sum("size").over(Window.partitionBy("conv", "seg").orderBy("k")) - F.col("size")
    links = links.withColumn("left", F.col("total") - F.col("before") - done).withColumn("depth", F.col("seg") * segment + F.col("k") + 1)
    starts = (F.col("seg") == F.col("cut") + 1) & (F.col("k") == 0)
    links = links.select(
        "depth", "conv", F.when(starts, F.col("above")).otherwise(F.col("conv")).alias("parent"), "n", (F.col("depth") < F.col("length")).cast("long").alias("children"), F.lit(1).cast("long").alias("leaves"),
        ((F.col("n") - 1) * F.col("left")).alias("saved"), F.when(F.col("depth") == F.col("length"), F.col("conv")).alias("ender"))
    ends = lines.join(_ends(convs), ["z1", "z2", "length"]).select(F.col("conv").alias("ender"), "ends")
    every = nodes.unionByName(links).join(ends, "ender", "left")
    return every.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"))


def op11_prefix_double_arrays(spark, sf_dir: str) -> DataFrame:
    return prefix_nodes(read_table(spark, sf_dir, "conversations"))


_CRC = "xor(list_reduce([4294967295] || list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT), lambda a, c: list_reduce([xor(a, c), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
#: Prefixes as lists; a node is named by its depth and smallest member.
OP11_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, CASE WHEN conv_id % 5 = 0 THEN 0 ELSE {_CRC} % 9 END AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base WHERE pos < h UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE pos >= h),
s AS MATERIALIZED (SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS seq FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS MATERIALIZED (SELECT conv_id, unnest(range(0, len(seq) + 1)) AS depth, seq, len(seq) AS n FROM s),
m AS MATERIALIZED (SELECT conv_id AS member, depth, n, min(conv_id) OVER (PARTITION BY depth, seq[1:depth]) AS conv_id, coalesce(octet_length(encode(seq[depth].text)), 0) AS bytes FROM p),
g AS MATERIALIZED (SELECT conv_id, depth, count(*) AS n_convs, max(bytes) AS bytes, string_agg(member::VARCHAR, ',' ORDER BY member) FILTER (n = depth) AS ends FROM m GROUP BY ALL),
e AS MATERIALIZED (SELECT g.*, up.conv_id AS parent_conv_id FROM g LEFT JOIN m AS up ON up.member = g.conv_id AND up.depth = g.depth - 1),
k AS MATERIALIZED (SELECT e.conv_id, e.depth, count(ch.conv_id) AS n_children FROM e LEFT JOIN e AS ch ON ch.parent_conv_id = e.conv_id AND ch.depth = e.depth + 1 GROUP BY ALL),
w AS (SELECT a.conv_id, a.depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * e.bytes)::BIGINT AS saved_tokens FROM e JOIN k USING (conv_id, depth) JOIN m AS a ON a.member = e.conv_id AND a.depth <= e.depth GROUP BY ALL)
SELECT e.conv_id, e.depth, e.parent_conv_id, e.n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM e JOIN k USING (conv_id, depth) JOIN w USING (conv_id, depth)
"""
