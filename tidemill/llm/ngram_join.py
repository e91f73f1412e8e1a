"""Exact Jaccard join of 5-word shingle sets with count-vector R-trees.

1. Shingles are hashed to 64 bits. Their hash groups are counted over the whole
   corpus into a table of fixed size; shingles of rare groups come first.
2. The counts of a set's shingles in a few hundred hash groups are a point. An
   R-tree over points bounds the overlap of a set with all sets under a node by
   the summed coordinate minima.
3. Sets that share four fifths of their union share one of their first
   n - ceil(0.8 n) + 1 shingles in any common order. The points of the documents
   that have such a shingle make an R-tree; what its bound lets hang together,
   over all shingles, is a block.
4. Within a block an R-tree finds the pairs that the sets themselves verify.
   Pairs that links already join need no check of their own.

Equal sets are one node however many documents have them. The documents of a very
frequent shingle are a block without a tree of their own. A block too large for
one task is cut in tiles; tiles are joined alone, then by a few sets of each part
found, then in pairs as far as parts are still apart. Nothing is capped.

Null and wordless texts have no shingles and are alone. Repeated rows and equal
ids are kept as rows; null ids are linked but give no component its name. An empty
table gives no rows; further columns are not read, and stay where one of each
component does; very long texts are sets like others.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tidemill.llm.common import map_arrow, stored, utf8

WORDS = 5
#: Documents link if 100 * shared >= PERCENT * united.
PERCENT = 80
#: Hash groups that are counted over the corpus, for the order of shingles: 4 MB.
ORDER_BITS = 20
#: Coordinates of a point.
GROUPS = 256
LEAF = 16
#: Shingles of a tile, at most: 8 bytes each.
TILE_SHINGLES = 2_000_000
#: A token of so many nodes at most is known by the list of them.
FEW_NODES = 32
#: Nodes of a token whose points are joined at once (1 KB each); a token of more is a
#: block as a whole, and the R-trees of the block's tiles bound its pairs.
TOKEN_POINTS = 1_000
#: Candidates (16 bytes each) that are broadcast to fetch their texts, at most.
BROADCAST_ROWS = 1_000_000

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    from xxhash import xxh3_64_intdigest

    words = utf8(text).lower().split()  # bytes: A-Z only, and the six ASCII blanks
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(WORDS, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = (out ^ (out >> np.uint64(29))) * _MIX[j] + hashed[j : j + n]
    out = (out ^ (out >> np.uint64(32))) * _MIX[2]
    return np.unique(out ^ (out >> np.uint64(29)))


def _groups(found: np.ndarray) -> np.ndarray:
    return (found >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def point_of(found: np.ndarray) -> np.ndarray:
    """How many shingles each coordinate's hash group has."""
    return np.bincount((found % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def packed(point: np.ndarray) -> bytes:
    """Two bytes a coordinate where that is enough, else four; the length tells."""
    return point.astype("<u2" if point.max() < 1 << 16 else "<u4").tobytes()


def unpacked(point: bytes) -> np.ndarray:
    return np.frombuffer(point, "<u2" if len(point) == 2 * GROUPS else "<u4").astype(np.int32)


def group_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How many shingles of the corpus each hash group has; a table of fixed size."""
    slices, width = 64, (1 << ORDER_BITS) // 64

    def count(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(1 << ORDER_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(total, _groups(shingles(text.as_py())), 1)
        part = TaskContext.get().partitionId() % 32
        total = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(slices, width)
        yield pa.RecordBatch.from_pydict(
            {"slice": pa.array(range(slices), pa.int32()), "part": pa.array([part] * slices, pa.int32()), "n": [x.tobytes() for x in total]}
        )

    def summed(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in group.column("n"))
        packed = np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()
        return pa.table({"slice": group.column("slice")[:1], "part": pa.array([0], pa.int32()), "n": [packed]})

    schema = "slice int, part int, n binary"
    counted = map_arrow(docs.select(F.col(f"`{text_col}`")), count, schema)
    by_part = counted.groupBy("slice", "part").applyInArrow(summed, schema)
    rows = by_part.groupBy("slice").applyInArrow(summed, schema).collect()
    total = np.zeros((slices, width), np.int32)
    for r in rows:
        total[r["slice"]] = np.frombuffer(r["n"], np.int32)
    return total.ravel()


_SIGNED = T.StructType(
    [
        T.StructField("n", T.LongType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("prefix", T.ArrayType(T.LongType())),
        T.StructField("point", T.BinaryType()),
    ]
)


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A number for the row, id, text hash, set size, key of the set, its first
    shingles in the common order, and its point."""
    counts = docs.sparkSession.sparkContext.broadcast(group_counts(docs, text_col))
    inner = docs.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("text_hash"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([*inner.schema.fields[:3], *_SIGNED.fields])

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, keys, firsts, points = [], [], [], []
                for text in part.column(3):
                    found = shingles(text.as_py())
                    n = len(found)
                    sizes.append(n)
                    keys.append(xxh3_128_digest(found.tobytes()) if n else None)
                    take = n + (-n * PERCENT // 100) + 1
                    order = np.lexsort((found, counts.value[_groups(found)]))[:take]
                    firsts.append(found[order].view(np.int64) if n else None)
                    points.append(packed(point_of(found)) if n else None)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(points, pa.binary())],
                    names=schema.names,
                )

    return map_arrow(inner, sign, schema)


def components(edges: DataFrame) -> DataFrame:
    """node and label, its component's smallest node, of edges (a, b).

    Each label hooks to its smallest neighbour, chains of hooks are cut short by
    doubling, and edges are contracted, until none is left. All tables are stored.
    """
    edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = stored(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
    while edges.count():
        hooks = stored(edges.groupBy(F.col("b").alias("label")).agg(F.min("a").alias("to")), "hooks")
        while True:
            further = hooks.select(F.col("label").alias("to"), F.col("to").alias("next"))
            hooks = stored(hooks.join(further, "to", "left").select("label", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "hooks")
            if not hooks.filter("moved").count():
                break
            hooks = hooks.drop("moved")
        hooks = hooks.drop("moved")
        labels = stored(labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        for end in ("a", "b"):
            edges = edges.join(hooks.withColumnRenamed("label", end), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
        edges = stored(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    return labels


class CountTree:
    """An R-tree over points of group counts, packed so that like sets share a leaf.

    A node keeps the largest coordinates under it and the sizes it spans.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.levels = [(points, sizes, sizes)]
        while len(self.levels[-1][0]) > LEAF:
            top, least, most = self.levels[-1]
            at = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)))

    def query(self, point: np.ndarray, size: int) -> np.ndarray:
        """Positions of all points whose sets could link to a set with that point."""
        nodes = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            top, least, most = self.levels[k]
            if k < len(self.levels) - 1:
                nodes = (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
                nodes = nodes[nodes < len(top)]
            partner = np.maximum(least[nodes], -(-size * PERCENT // 100))
            nodes = nodes[(partner <= most[nodes]) & (partner * PERCENT <= 100 * size)]
            overlap = np.minimum(top[nodes], point).sum(axis=1)
            # shared >= PERCENT% of (size + partner - shared)
            partner = np.maximum(least[nodes], -(-size * PERCENT // 100))
            nodes = nodes[overlap * (100 + PERCENT) >= PERCENT * (size + partner)]
        return nodes


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= PERCENT * (len(a) + len(b) - shared)


def join_sets(sets: list[np.ndarray], parts: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the sets' components, as pairs of positions; parts: what is joined already."""
    order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
    sizes = np.array([len(sets[i]) for i in order], np.int64)
    points = np.array([point_of(sets[i]) for i in order])
    tree, part, links = CountTree(points, sizes), parts[order].copy(), []
    for i in range(len(order)):
        near = tree.query(points[i], int(sizes[i]))
        near = near[(near != i) & (part[near] != part[i])]
        near = near[np.argsort(np.abs(near - i), kind="stable")]
        while len(near):
            j = int(near[0])
            if linked(sets[order[i]], sets[order[j]]):
                links.append((order[i], order[j]))
                part[part == part[j]] = part[i]
                near = near[part[near] != part[i]]
            else:
                near = near[1:]
    return links


def join_points(points: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of positions that join all points between which the bound allows a link."""
    if len(points) == 2:  # most buckets
        a, b = sizes.tolist()
        near = min(a, b) * 100 >= PERCENT * max(a, b)
        return [(0, 1)] if near and int(np.minimum(*points).sum()) * (100 + PERCENT) >= PERCENT * (a + b) else []
    tree, part, pairs = CountTree(points, sizes), np.arange(len(points)), []
    for i in range(len(points)):
        near = tree.query(points[i], int(sizes[i]))
        for p in np.unique(part[near[part[near] != part[i]]]):
            pairs.append((i, int(near[part[near] == p][0])))
            part[part == p] = part[i]
    return pairs


def candidates(shared: DataFrame, points: DataFrame) -> DataFrame:
    """Edges (a, b) that join whatever could be linked, from rows (token, node, n).

    Tokens that one node has leave first, and pairs too far apart in size. The points
    of the others go to their tokens, and an R-tree over the points of each token tells
    which could overlap enough. The nodes of a token of very many are joined to one of
    them: what is linked and shares a token stays in one block either way.
    """
    counted = shared.groupBy("token").agg(F.count("*").alias("count"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("node").alias("one"))
    near = (F.col("count") > 2) | (100 * F.col("lo") >= PERCENT * F.col("hi"))
    counted = counted.filter(F.col("count") > 1).filter(near).drop("lo", "hi")
    rows = stored(shared.select("token", "node").join(counted, "token"), "shared")
    # tokens of copies have the same few nodes over and over: once is enough
    few = rows.filter(F.col("count") <= FEW_NODES).groupBy("token").agg(F.array_sort(F.collect_list("node")).alias("nodes"))
    few = few.select("nodes").distinct().select(F.xxhash64("nodes").alias("token"), F.explode("nodes").alias("node"))
    some = rows.filter((F.col("count") > FEW_NODES) & (F.col("count") <= TOKEN_POINTS)).select("token", "node")
    many = rows.filter((F.col("count") > TOKEN_POINTS) & (F.col("node") != F.col("one"))).select(F.col("one").alias("a"), F.col("node").alias("b")).distinct()
    rows = few.unionByName(some).join(points, "node").select("token", "node", "n", "point")
    # the rows of a token follow one another, so tokens are read as a stream
    rows = rows.repartition("token").sortWithinPartitions("token", "n", "node")

    def read(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        held: list[tuple[int, int, bytes]] = []
        token, done, found = None, set(), []

        def close() -> None:
            nodes = [x[0] for x in held]
            key = xxh3_128_digest(np.array(nodes, np.int64).tobytes())
            if len(nodes) > 1 and key not in done:  # tokens of copies have the same nodes over and over
                if len(done) > 100_000:
                    done.clear()
                done.add(key)
                made = np.array([unpacked(x[2]) for x in held])
                found.extend((nodes[i], nodes[j]) for i, j in join_points(made, np.array([x[1] for x in held])))
            held.clear()

        for batch in batches:
            for t, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if t != token:
                    close()
                    token = t
                held.append(tuple(row))
            if found:
                pairs, found = list(dict.fromkeys(found)), []
                yield pa.RecordBatch.from_pydict({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]})
        close()
        if found:
            yield pa.RecordBatch.from_pydict({"a": [a for a, _ in found], "b": [b for _, b in found]})

    return map_arrow(rows, read, "a long, b long").unionByName(many)


def _links(sets: DataFrame) -> DataFrame:
    """Joining links (a, b) within each (block, tile) of rows with node, part and set."""

    def join(group: pa.Table) -> pa.Table:
        seen: dict[int, tuple[int, np.ndarray]] = {}
        for node, part, packed in zip(*(group.column(c).to_pylist() for c in ("node", "part", "set"))):
            seen.setdefault(node, (part, np.frombuffer(packed, np.uint64)))
        nodes = sorted(seen)
        parts = np.unique([seen[x][0] for x in nodes], return_inverse=True)[1]
        found = join_sets([seen[x][1] for x in nodes], parts) if len(set(parts.tolist())) > 1 else []
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})

    return sets.groupBy("block", "tile").applyInArrow(join, "a long, b long")


def _small(df: DataFrame) -> DataFrame:
    """Broadcast up to a number of rows, else joined as it is."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def candidate_sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The nodes (block, tile, node, part, id, text_hash) with their sets, texts read again."""
    texts = docs.select(F.col(f"`{id_col}`").alias("of"), F.xxhash64(f"`{text_col}`").alias("hash"), F.col(f"`{text_col}`").alias("text"))
    same = (F.col("text_hash") == F.col("hash")) & F.col("id").eqNullSafe(F.col("of"))
    rows = texts.join(_small(nodes), same).select("block", "tile", "node", "part", "text")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [shingles(t.as_py()).tobytes() for t in part.column(4)]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(found, pa.binary())], names=["block", "tile", "node", "part", "set"])

    return map_arrow(rows, cut, "block long, tile int, node long, part long, set binary")


def _apart(signed: DataFrame, nodes: DataFrame, links: DataFrame) -> DataFrame:
    """The nodes that share a first shingle with a node of another part, with their
    parts after the links. No others can have a link left to find."""
    labels = components(links)
    parted = stored(nodes.drop("part").join(labels, "node", "left").withColumn("part", F.coalesce("label", "node")).drop("label"), "parted")
    own = signed.select(F.col("row").alias("node"), "prefix").join(_small(parted.select("node", "part")), "node")
    tokens = own.select("node", "part", F.explode("prefix").alias("token"))
    mixed = tokens.groupBy("token").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).filter("lo <> hi")
    left = stored(tokens.join(mixed, "token", "left_semi").select("node").distinct(), "apart")
    return parted.join(left, "node", "left_semi")


def _verified(docs: DataFrame, signed: DataFrame, nodes: DataFrame, id_col: str, text_col: str, tile_shingles: int) -> DataFrame:
    """node and label of the components that verified links make within blocks."""
    sizes = nodes.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / tile_shingles)).cast("int").alias("tiles"))
    # nodes of a large block are dealt over its tiles by hash
    nodes = nodes.join(sizes, "block").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    nodes = stored(nodes.withColumn("part", F.col("node")), "tiled")
    links = stored(_links(candidate_sets(docs, nodes, id_col, text_col)), "links")
    large = nodes.filter("tiles > 1")
    for heads in (True, False):
        if not large.count():
            break
        large = _apart(signed, large, links)
        if heads:  # a few sets of each part join most of what a large group of copies has
            first = F.row_number().over(Window.partitionBy("block", "tile", "part").orderBy("node"))
            pairs = stored(large.withColumn("first", first).filter("first <= 8"), "heads")
            room = pairs.groupBy("block").agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / tile_shingles)).cast("int").alias("rooms"))
            pairs = pairs.join(room, "block").withColumn("tile", F.pmod(F.xxhash64("part", "node"), F.col("rooms")).cast("int"))
        else:  # whatever is still apart: all pairs of tiles
            others = F.sequence(F.lit(0), F.col("tiles") - 1)
            pair = lambda t: F.least("tile", t) * F.col("tiles") + F.greatest("tile", t)
            pairs = large.withColumn("tile", F.explode(F.transform(others, pair)))
        pairs = pairs.select("block", "tile", "node", "part", "id", "text_hash")
        links = stored(links.union(_links(candidate_sets(docs, pairs, id_col, text_col))), "links")
    return components(links)


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile_shingles: int = TILE_SHINGLES) -> DataFrame:
    """id, text_hash, n_shingles, component_id (the smallest id that links reach), and
    whether the row is the one of its component that stays (equal rows all are)."""
    signed = stored(signatures(docs, id_col, text_col), "signatures")
    worded = signed.filter("n > 0")
    # equal sets are one node, the row with the smallest id
    reps = worded.groupBy("key").agg(F.min("id").alias("least"), F.min(F.struct("id", "text_hash", "row")).alias("some"))
    reps = stored(reps.withColumn("node", F.col("some.row")), "reps")
    copies = stored(worded.select("key", "row").join(reps.select("key", "node"), "key").filter("row <> node").select("row"), "copies")
    single = worded.join(_small(copies), "row", "left_anti")
    shared = single.select(F.col("row").alias("node"), "n", F.explode("prefix").alias("token"))
    points = signed.select(F.col("row").alias("node"), "n", "point")
    blocks = components(candidates(shared, points))
    nodes = signed.select(F.col("row").alias("node"), "id", "text_hash", "n").join(_small(blocks.withColumnRenamed("label", "block")), "node")
    labels = _verified(docs, signed, nodes, id_col, text_col, tile_shingles)
    named = reps.select("node", "key", "least", F.struct("some.id", "some.text_hash").alias("some"))
    named = named.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    names = named.groupBy("label").agg(F.min("least").alias("component_id"), F.min("some").alias("stays"))
    named = stored(named.join(names, "label").select("key", "component_id", "stays"), "named")
    found = signed.select("id", "text_hash", F.col("n").alias("n_shingles"), "key").join(named, "key", "left")
    own = F.struct("id", "text_hash").eqNullSafe(F.col("stays"))
    return found.select(
        "id",
        "text_hash",
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        ((F.col("n_shingles") == 0) | own).alias("stays"),
    )


def op10(docs: DataFrame) -> DataFrame:
    return joined(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def clean(docs: DataFrame) -> DataFrame:
    """One document of each component, all columns kept; wordless ones all stay."""
    found = stored(joined(docs).filter("n_shingles > 0"), "joined")
    gone = found.filter("NOT stays").select("id", "text_hash").distinct()
    again = found.filter("stays").groupBy("id", "text_hash").count().filter("count > 1").select("id", "text_hash")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text_hash"))

    def matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        right = right.select(F.col("id").alias("of"), F.col("text_hash").alias("hash"))
        if right.count() <= BROADCAST_ROWS:
            right = F.broadcast(right)
        return left.join(right, (F.col("text_hash") == F.col("hash")) & F.col("id").eqNullSafe(F.col("of")), how)

    rows, again = matched(rows, gone, "left_anti"), stored(again, "again")
    if again.count():
        once = matched(rows, again, "left_semi").dropDuplicates(["id", "text_hash"])
        rows = matched(rows, again, "left_anti").unionByName(once)
    return rows.select("row.*")
