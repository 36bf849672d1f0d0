"""N-gram Jaccard self-join with a count-vector R-tree.

1. Every text becomes the set of its distinct k-word shingles (64-bit hashes). Texts with equal sets collapse into one
   representative before anything else is shuffled.
2. Tokens are hashed into groups; a set is the point of its group counts. An R-tree over points (sort-tile-recursive
   packing) is searched with the bound ``|A and B| <= sum over groups of min(a_g, b_g)``, for nodes with the upper corner
   of their box. Where m tokens of n are not shared, counts differ by about ``0.56 sqrt(groups m) / n`` of the size, with a
   deviation of ``0.42 sqrt(m) / n``. A set has so many groups that even sets which lack but a quarter of each other differ
   by ``APART`` deviations more than linked sets may: otherwise, the more texts there are, the more chains of mistaken
   links, until most sets are one component. It is a power of two, so that finer points fold into coarser ones.
3. One tree over all points would prune nothing near its root: a box of many points spans every likely count. So trees
   are built over the sets that have one of their rarest tokens in common. Linked sets of n tokens share at least p n, so
   in any order of all tokens they share one of the first n - p n + 1; in the order used, tokens come the
   later the more documents of a bounded sample hold them (the choice of order changes the work, never the result). Groups of tokens with the
   same members count once.
4. What the bound lets through is contracted to components, few and small. Their sets are read once more, a tree is built
   over each component, and what survives is verified on the sets.
5. A group or component too large for a task is dealt into blocks which all hold its first document as a hub; blocks are
   compared with each other only where components are still apart after that.

Memory of a task is bounded by ``BLOCK_SHINGLES`` and the longest text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .common import buffers, drop_table, lowest_hashes, materialize, salted_join, spread, text_slices
from .graph import connected_components

SHINGLE_WORDS, PERCENT = 5, 80
#: Groups of a count vector, least and most (powers of two), and deviations between linked sets and those that lack a quarter.
FEWEST_GROUPS, MOST_GROUPS, APART = 16, 1024, 4.5
#: Documents that the order of tokens is learned on, from how many of them on a token is frequent, and how many frequent
#: tokens are sent to all tasks (9 bytes each).
ORDER_DOCUMENTS, ORDER_LEAST, ORDER_TOKENS = 16_384, 2, 1 << 20
#: Shingles, or groups of count vectors, that one task holds at a time (8 bytes each), but for a single longer document.
BLOCK_SHINGLES = 2_000_000
LEAF, FAN = 32, 16


def prefix_keys(shingles: np.ndarray, percent: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first tokens of a set in the common order, of which linked sets share one."""
    n, (tokens, counts) = len(shingles), frequent
    order = tv.mix(shingles) >> np.uint64(8)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, shingles), len(tokens) - 1)
        order |= np.where(tokens[at] == shingles, counts[at], 0).astype(np.uint64) << np.uint64(56)
    first = n - -(-percent * n // 100) + 1
    return np.partition(order, first - 1)[:first] if first < n else order


def groups_of(n: int, percent: int) -> int:
    """Groups of the count vector of a set of n tokens."""
    apart = (100 - percent) / (100 + percent)  # linked sets of one size lack so much of each other
    wanted = (APART * 0.42 * 0.5 + apart * n**0.5) / (0.56 * 0.5)
    return min(max(FEWEST_GROUPS, 1 << int(wanted**2).bit_length()), MOST_GROUPS)


def group_counts(shingles: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((tv.mix(shingles ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(groups)).astype(np.int64), minlength=groups)


def pack_counts(counts: np.ndarray) -> bytes:
    """A count vector in the narrowest type that holds it, which the first byte names; N are two counts a byte."""
    if counts.max(initial=0) < 16:
        return b"N" + (counts[::2] << 4 | counts[1::2]).astype(np.uint8).tobytes()
    kind = next(k for k in "BHQ" if counts.max(initial=0) <= np.iinfo(k).max)
    return kind.encode() + counts.astype(kind).tobytes()


def unpack_counts(data: bytes) -> np.ndarray:
    if data[:1] == b"N":
        both = np.frombuffer(data, dtype=np.uint8, offset=1)
        return np.stack([both >> 4, both & 15], axis=1).reshape(-1).astype(np.int64)
    return np.frombuffer(data, dtype=chr(data[0]), offset=1).astype(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    for a, b in text_slices(texts):
        data, offsets = buffers(texts.slice(a, b - a))
        starts, ends, first = tv.word_spans(data, offsets)
        words = tv.span_hashes(data, starts, ends)
        for i in range(b - a):
            yield tv.shingle_hashes(words[first[i] : first[i + 1]], k)


_DIGEST = "id long, n long, hi long, lo long, keys array<long>, counts binary"


def _digest(batches: Iterator[pa.RecordBatch], k: int, percent: int, frequent) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column(1)):
            n, hi, lo, keys, counts = [], [], [], [], []
            for s in _sets(batch.column(1).slice(a, b - a), k):
                n.append(len(s))
                hi.append(int(_signed(np.sum(tv.mix(s), dtype=np.uint64, keepdims=True))[0]) if len(s) else None)
                lo.append(int(_signed(np.sum(tv.mix(s ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64, keepdims=True))[0]) if len(s) else None)
                keys.append(_signed(prefix_keys(s, percent, frequent.value)) if len(s) else np.zeros(0, np.int64))
                counts.append(pack_counts(group_counts(s, groups_of(len(s), percent))) if len(s) else None)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(keys))), pa.array(counts, pa.binary())], names=["id", "n", "hi", "lo", "keys", "counts"])


def _tokens(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column(0)):
            yield pa.RecordBatch.from_arrays([pa.array(_signed(np.concatenate([*_sets(batch.column(0).slice(a, b - a), k), np.zeros(0, np.uint64)])), pa.int64())], names=["token"])


def frequent_tokens(wanted: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that several documents of a bounded sample hold, sorted, and how many hold them."""
    few = wanted.where(F.xxhash64(F.lit(31), "id", "text") <= lowest_hashes(ORDER_DOCUMENTS, wanted.count())).select("text")
    counts = few.mapInArrow(partial(_tokens, k=k), "token long").groupBy("token").count().where(F.col("count") >= ORDER_LEAST)
    found = counts.orderBy(F.desc("count"), "token").limit(ORDER_TOKENS).select("token", F.least("count", F.lit(255)).alias("c")).toArrow()
    tokens = found["token"].to_numpy().view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], found["c"].to_numpy()[order].astype(np.uint8)


_POINT = "area long, id long, n long, data binary"


def _points(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in text_slices(batch.column(2)):
            sets = list(_sets(batch.column(2).slice(a, b - a), k))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["area", "id", "n", "data"])


class CountRTree:
    """Boxes over count vectors, packed by sort-tile-recursive order; searched by the summed-minima bound."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.points, self.sizes = points, sizes
        tiles = [np.arange(len(points))]
        for axis in [-1, *np.argsort(-points.var(axis=0))[:6]]:
            value = sizes if axis < 0 else points[:, axis]
            tiles = [part for t in tiles for part in (np.array_split(t[np.argsort(value[t], kind="stable")], 2 if len(t) > 2 * LEAF else 1))]
        order = np.concatenate(tiles) if len(points) else np.zeros(0, np.int64)
        self.leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
        self.high = np.array([points[x].max(axis=0) for x in self.leaves]).reshape(-1, points.shape[1])
        self.least = np.array([sizes[x].min() for x in self.leaves], dtype=np.int64)
        self.most = np.array([sizes[x].max() for x in self.leaves], dtype=np.int64)
        self.nodes = [np.arange(i, min(i + FAN, len(self.leaves))) for i in range(0, len(self.leaves), FAN)]
        self.node_high = np.array([self.high[x].max(axis=0) for x in self.nodes]).reshape(-1, points.shape[1])
        self.node_least = np.array([self.least[x].min() for x in self.nodes], dtype=np.int64)
        self.node_most = np.array([self.most[x].max() for x in self.nodes], dtype=np.int64)

    @staticmethod
    def _may(point, size, high, least, most, percent):
        """Boxes that can hold a set with 100 |A and B| >= percent |A or B|."""
        overlap = np.minimum(point, high).sum(axis=1)
        return ((100 + percent) * overlap >= percent * (size + least)) & (100 * size >= percent * least) & (100 * most >= percent * size)

    def search(self, point: np.ndarray, size: int, percent: int, open_: np.ndarray) -> np.ndarray:
        """Indices of the points still open that can be linked to the given one."""
        nodes = np.flatnonzero(self._may(point, size, self.node_high, self.node_least, self.node_most, percent))
        if not len(nodes):
            return nodes
        leaves = np.concatenate([self.nodes[x] for x in nodes])
        leaves = leaves[self._may(point, size, self.high[leaves], self.least[leaves], self.most[leaves], percent)]
        if not len(leaves):
            return leaves
        found = np.concatenate([self.leaves[x] for x in leaves])
        found = found[open_[found]]
        return found[self._may(point, size, self.points[found], self.sizes[found], self.sizes[found], percent)] if len(found) else found


def _reach(ids: np.ndarray, points: np.ndarray, sizes: np.ndarray, percent: int, parts: np.ndarray | None, same=None) -> np.ndarray:
    """For every set of a block the smallest one that links (or, without ``same``, the bound) lead to.

    Breadth first: a set is compared only with those not reached yet, so a dense group costs its size, not its square.
    ``parts`` are components known already; each is entered as a whole."""
    tree = CountRTree(points, sizes)
    root, open_ = np.full(len(ids), -1), np.ones(len(ids), dtype=bool)
    together: dict[int, np.ndarray] = {}
    if parts is not None:
        order = np.argsort(parts, kind="stable")
        cuts = np.flatnonzero(np.diff(parts[order])) + 1
        together = {int(parts[x[0]]): x for x in np.split(order, cuts) if len(x)}
    for seed in np.argsort(ids, kind="stable"):
        if not open_[seed]:
            continue
        queue = list(together[int(parts[seed])]) if parts is not None else [seed]
        open_[queue] = False
        while queue:
            x = queue.pop()
            root[x] = seed
            for y in tree.search(points[x], int(sizes[x]), percent, open_):
                if open_[y] and (same is None or same(x, y)):
                    more = together[int(parts[y])] if parts is not None else [y]
                    open_[more] = False
                    queue.extend(more)
    return ids[root] if len(ids) else ids


def link_block(ids: np.ndarray, shingles: list[np.ndarray], percent: int, parts: np.ndarray | None = None) -> np.ndarray:
    """Roots of a block by links that are verified on the sets."""
    sizes = np.array([len(s) for s in shingles], dtype=np.int64)
    groups = groups_of(int(sizes.mean()) if len(sizes) else 0, percent)
    points = np.array([group_counts(s, groups) for s in shingles], dtype=np.int32).reshape(len(shingles), groups)

    def same(x: int, y: int) -> bool:
        both = len(np.intersect1d(shingles[x], shingles[y], assume_unique=True))
        return 100 * both >= percent * (sizes[x] + sizes[y] - both)

    return _reach(ids, points, sizes, percent, parts, same)


def bound_block(ids: np.ndarray, sizes: np.ndarray, counts: list[np.ndarray], percent: int, parts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges between sets and the smallest one that the bound leads to.

    Sets with as many groups are compared, and those with more, folded, up to where sizes of linked sets can lead."""
    width, most = np.array([len(c) for c in counts]), 2 << int(np.log2(100 / percent))
    u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for groups in np.unique(width):
        members = np.flatnonzero((width >= groups) & (width <= most * groups))
        points = np.array([counts[i] if len(counts[i]) == groups else counts[i].reshape(-1, groups).sum(axis=0) for i in members], dtype=np.int32)
        if len(members) == 2 and parts is None:
            n, m = (int(x) for x in sizes[members])
            if (100 + percent) * int(points.min(axis=0).sum()) < percent * (n + m) or 100 * min(n, m) < percent * max(n, m):
                continue
            roots = np.full(2, ids[members].min())
        else:
            if len(members) <= 2 * LEAF:
                # Most small groups hold no two sets that may be linked; all their pairs are looked at at once.
                n, m = sizes[members][:, None], sizes[members][None, :]
                may = ((100 + percent) * np.minimum(points[:, None], points[None]).sum(axis=2) >= percent * (n + m)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                if np.count_nonzero(may) == len(members):
                    continue
            roots = _reach(ids[members], points, sizes[members], percent, None if parts is None else parts[members])
        far = roots != ids[members]
        u.append(ids[members][far])
        v.append(roots[far])
    return np.concatenate(u), np.concatenate(v)


def _link(rows: list[pa.RecordBatch], percent: int, exact: bool) -> tuple[np.ndarray, np.ndarray]:
    table = pa.Table.from_batches(rows)
    ids, sizes, data = table["id"].to_numpy(), table["n"].to_numpy(), table["data"].to_pylist()
    first = np.array(list({x: at for at, x in enumerate(zip(ids.tolist(), data, strict=True))}.values()))  # the hub may be there twice
    ids, sizes, data = ids[first], sizes[first], [data[i] for i in first]
    if len(ids) < 2:
        return ids[:0], ids[:0]
    parts = table["part"].to_numpy()[first] if "part" in table.column_names else None
    if exact:
        roots = link_block(ids, [np.frombuffer(d, dtype=np.uint64) for d in data], percent, parts)
        far = roots != ids
        return ids[far], roots[far]
    return bound_block(ids, sizes, [unpack_counts(d) for d in data], percent, parts)


def _link_blocks(batches: Iterator[pa.RecordBatch], percent: int, exact: bool) -> Iterator[pa.RecordBatch]:
    """Edges of blocks that come one behind the other; a block is the rows of equal area, x and y."""
    held: list[pa.RecordBatch] = []
    name, out, size = None, [], 0

    def edges():
        pairs = out or [(np.zeros(0, np.int64),) * 2]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*pairs, strict=True)], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("area", "x", "y")], axis=1)
        cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if held and name != tuple(names[a]):
                out.append(_link(held, percent, exact))
                size += len(out[-1][0])
                held = []
                if size > 100_000:
                    yield edges()
                    out, size = [], 0
            name = tuple(names[a])
            held.append(batch.slice(a, b - a))
    if held:
        out.append(_link(held, percent, exact))
    yield edges()


def _linked(points: DataFrame, percent: int, exact: bool) -> DataFrame:
    """A table of edges within each area, by verified links or by the bound alone; ``points`` is a table of its sets."""
    link = lambda rows: rows.repartition("area", "x", "y").sortWithinPartitions("area", "x", "y").mapInArrow(partial(_link_blocks, percent=percent, exact=exact), "u long, v long")
    # A block has a bounded number of rows as well, 512 of sets or 2,048 of vectors.
    volume = F.greatest("n", F.lit(BLOCK_SHINGLES // 512)) if exact else F.greatest(F.octet_length("data"), F.lit(BLOCK_SHINGLES // 2048)).cast("long")
    sized = points.groupBy("area").agg(F.sum(volume).alias("volume"), F.min("id").alias("hub")).withColumn("blocks", F.ceil(F.col("volume") / BLOCK_SHINGLES).cast("int"))
    # An area of one block needs nothing but its name. The others are few: Spark sends their table to all tasks while it is small.
    large = materialize(sized.where("blocks > 1").select("area", "hub", "blocks"))
    several = not large.isEmpty()
    dealt = points.join(large, "area", "left") if several else points.withColumns({"hub": F.lit(None).cast("long"), "blocks": F.lit(None).cast("int")})
    inside = F.when(F.col("id") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")))
    everywhere = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(inside)
    # Dealt out by block: a join's own partitioning, by area, would satisfy the grouping and keep an area in one task.
    edges = materialize(link(dealt.select("area", F.explode(everywhere).alias("x"), F.lit(0).alias("y"), "id", "n", "data")))
    if not several:
        drop_table(large)
        return edges
    # Areas of several blocks, where these are not yet one component: every pair of blocks that are apart.
    parts = connected_components(edges, "u", "v")
    rows = points.join(large.select("area", "blocks"), "area").join(parts.hint("merge"), F.col("id") == F.col("node"), "left")
    rows = rows.select("area", "blocks", "id", "n", "data", F.coalesce("component", "id").alias("part"))
    apart = rows.groupBy("area").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("area")
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = rows.join(apart, "area").select("area", "id", "n", "data", "part", block.alias("b"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    second = link(pairs.select("area", F.least("b", "other").alias("x"), F.greatest("b", "other").alias("y"), "id", "n", "data", "part"))
    out = materialize(edges.unionByName(second))
    drop_table(parts)
    drop_table(edges)
    drop_table(large)
    return out


def shared_groups(keyed: DataFrame) -> DataFrame:
    """``key, n`` of the groups of sets (``hi, key``) that share a key; of groups with the same members one counts."""
    stats = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("hi").alias("low"), F.bit_xor(F.xxhash64("hi")).alias("mark"), F.bit_xor(F.xxhash64(F.lit(5), "hi")).alias("mark2")).where("n > 1")
    return stats.groupBy("n", "low", "mark", "mark2").agg(F.min("key").alias("key")).select("key", "n")


def ngram_jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each input row: id, ``n_shingles`` (size of its set) and ``component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; two documents link when
    ``100 |A and B| >= percent |A or B|``; component_id is the smallest id reachable by links. Null, empty and blank
    texts have no shingles and stand alone. Rows of equal id are one node but keep their own n_shingles; a null id
    takes part in no link and has a null component. Other columns are not read, so any may be there.
    """
    wanted = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_tokens(wanted, k))  # ORDER_TOKENS of 9 bytes
    # What only an eager step reads is deleted behind it.
    base = materialize(spread(wanted).mapInArrow(partial(_digest, k=k, percent=percent, frequent=frequent), _DIGEST))
    sets = base.where("n > 0 and id is not null")
    copies = materialize(sets.groupBy("hi", "lo").agg(F.min("id").alias("rep"), F.max("id").alias("top"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("counts").alias("data")))
    each = copies.select("hi", F.explode("keys").alias("key"))
    met = salted_join(each, shared_groups(each), ["key"], copies.agg(F.sum(F.size("keys"))).first()[0] or 0, "hi")
    # Merge join: the sets have no proven bound, so they are never broadcast.
    near = materialize(met.select(F.col("key").alias("area"), "hi").join(copies.select("hi", F.col("rep").alias("id"), "n", "data").hint("merge"), "hi").select("area", "id", "n", "data"))
    close = _linked(near, percent, False)
    drop_table(near)
    areas = connected_components(close, "u", "v")
    drop_table(close)
    # The smallest representative of an area is its name; it and all others read their text once more.
    # Without a hint: texts are shuffled only where the table of areas is too large for Spark to send it to all tasks.
    todo = wanted.join(areas.select(F.col("node").alias("id"), F.col("component").alias("area")), "id").select("area", "id", "text")
    points = materialize(todo.mapInArrow(partial(_points, k=k), _POINT))
    drop_table(areas)
    # Rows of equal id but other texts: a set that is not the representative's own stands in the copies table as well.
    edges = _linked(points.where("n > 0"), percent, True)
    linked = connected_components(edges, "u", "v")
    drop_table(edges)
    drop_table(points)
    far = copies.join(linked, F.col("rep") == F.col("node"), "left").select("hi", "lo", F.coalesce("component", "rep").alias("component"), "top")
    far = far.where("component < top or component is null")
    repeated = base.where("id is not null").groupBy("id").agg(F.count("*").alias("c")).where("c > 1")
    out = base.join(far.select("hi", "lo", "component"), ["hi", "lo"], "left").select("id", "n", F.least("component", "id").alias("component"))
    if not repeated.isEmpty():
        # One id with several texts joins what these are linked to.
        ends = out.where("id is not null").select("id", "component").join(repeated.select("id"), "id", "left_semi")
        more = connected_components(out.where("id is not null").select("id", "component").where("id <> component").unionByName(ends), "id", "component")
        out = out.join(more.withColumnRenamed("component", "merged"), F.col("id") == F.col("node"), "left").select("id", "n", F.coalesce("merged", "component").alias("component"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.col("component")).alias("component_id"))
