"""N-gram Jaccard self-join by prefix trees.

Linked are two sets of n-grams with whole * intersection >= parts * union. Equal sets are one node. The n-grams of nodes
that may have partners are put in one order, the commonest first, and the ordered sets are stored in a prefix tree whose
chains are one edge. A set runs down the tree with all branches side by side: what it shares with a path is counted once
for everything below, and a branch goes as soon as the n-grams that remain in the set, the n-grams that remain below and
the sizes found there cannot make up the overlap any more. What arrives at the end of a stored set is the exact overlap.
A branch whose sets are all in the component of the running set is left out too, so copies do not make all their pairs.

Which nodes may be partners: sets of one class of sizes differ in at most D n-grams, so of D + SPARE + 1 buckets by hash
more than SPARE are equal. Nodes with an equal bucket are in one family; a bucket without n-gram is a reason only for
nodes with more than SPARE of those. Each family has its tree in one task. A family beyond MOST_TOKENS or MOST_WORK is
joined bucket by bucket instead: first each node in its largest bucket only, then all nodes of the buckets that still hold
several components, in pairs of blocks where a bucket is beyond the bounds. No pair that could be linked is left out.

n-grams are told apart by 64-bit hashes, sets by two sums of 64 bits and their size. Null text and text without words have
the empty set and no link. Rows with one doc_id are one document, its links are those of all its texts. A row without
doc_id is linked with nothing and has no component. Empty table: no row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents_of, map_batches, stored
from wardline.llm.graph import components
from wardline.llm.shingles import scramble, shingles, word_hashes

SPARE = 2
#: A tree has at most so many n-grams, and n-grams times sets, of which a run visits a small part.
MOST_TOKENS, MOST_WORK = 1 << 22, 1 << 33
#: Ids of documents whose sets are compared are sent to the texts up to this number (8 bytes each); more are joined.
MOST_SENT = 2_000_000
_SET = ["set_a", "set_b", "n_shingles"]


def _class_starts() -> list[int]:
    """The least size of each class; classes grow by a quarter."""
    starts = [1]
    while starts[-1] < 1 << 40:
        starts.append(starts[-1] + max(1, starts[-1] // 4))
    return starts


_STARTS = _class_starts()


def bucket_keys(hashes: np.ndarray, parts: int, whole: int) -> np.ndarray:
    """A key for each bucket in which a linked set may equal this one, for every class in which the two may meet."""
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    keys = []
    own, last = bisect_right(_STARTS, n) - 1, bisect_right(_STARTS, n * whole // parts) - 1
    placed, mixed = scramble(hashes ^ np.uint64(0x2545F4914F6CDD1D)), scramble(hashes)
    for group in range(own, last + 1):
        most_apart = 2 * (_STARTS[group + 1] - 1) * (whole - parts) // (whole + parts)
        if not most_apart:
            continue
        buckets = most_apart + SPARE + 1
        at = (placed % np.uint64(buckets)).astype(np.int64)
        sizes = np.bincount(at, minlength=buckets)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed[np.argsort(at, kind="stable")], dtype=np.uint64)])
        ends = np.cumsum(sizes)
        signed = sums[ends] - sums[ends - sizes]
        names = scramble(np.arange(buckets, dtype=np.uint64) + (np.uint64(group) << np.uint64(40)))
        made = scramble(signed ^ names)
        keys.append(made if (sizes == 0).sum() > SPARE else made[sizes > 0])
    return (np.concatenate(keys) if keys else np.zeros(0, np.uint64)).view(np.int64)


def _sums(hashes: np.ndarray) -> tuple[int, int]:
    """Two sums that tell sets apart."""
    made = scramble(hashes).sum(dtype=np.uint64), scramble(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return tuple(int(s.astype(np.int64)) for s in made)


def _features(docs: DataFrame, words: int, parts: int, whole: int) -> DataFrame:
    layout = pa.schema([
        ("doc_id", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("n_shingles", pa.int64()), ("keys", pa.list_(pa.int64())),
    ])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys = [], []
            for text in batch.column(1).to_pylist():
                hashes = shingles(word_hashes(text), words)
                rows.append((*_sums(hashes), len(hashes)))
                keys.append(bucket_keys(hashes, parts, whole))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            columns = [pa.array(list(column), pa.int64()) for column in zip(*rows)] or [pa.array([], pa.int64())] * 3
            yield pa.record_batch([batch.column(0), *columns, lists], schema=layout)

    return map_batches(documents_of(docs), make, "doc_id long, set_a long, set_b long, n_shingles long, keys array<long>")


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """(node, set) of ``nodes``, made again from the texts of their least documents; the texts stay where they are."""
    ids = stored(nodes.select(F.col("low").alias("doc_id")).distinct(), "ids")
    texts = documents_of(docs).join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "doc_id", "left_semi")
    layout = pa.schema([("set_a", pa.int64()), ("set_b", pa.int64()), ("n_shingles", pa.int64()), ("set", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(word_hashes(text), words) for text in batch.column(1).to_pylist()]
            rows = [(*_sums(hashes), len(hashes), hashes.tobytes()) for hashes in found]
            yield pa.record_batch([list(column) for column in zip(*rows)] or [[]] * 4, schema=layout)

    made = map_batches(texts.select("doc_id", "text"), make, "set_a long, set_b long, n_shingles long, set binary")
    return stored(made.join(nodes.select("node", *_SET), _SET).select("node", "set").dropDuplicates(["node"]), "sets")


class PrefixTree:
    """Distinct ordered sets, each an array of rising numbers; nodes lie level by level, so children are neighbours."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u4").tobytes())
        ordered = [sets[i] for i in self.order]
        depth, left, right, parent, ends = [0], [0], [0], [-1], [-1]

        def add(at: int, first: int, end: int) -> int:
            depth.append(at), left.append(first), right.append(0), parent.append(-1), ends.append(end)
            return len(depth) - 1

        path, before = [0], np.zeros(0, np.int32)
        for i, one in enumerate([*ordered, None]):
            common = 0
            if one is not None:
                size = min(len(one), len(before))
                apart = np.flatnonzero(one[:size] != before[:size])
                common = int(apart[0]) if apart.size else size
            done = -1
            while depth[path[-1]] > common:
                done = path.pop()
                right[done] = i
                parent[done] = path[-1]
            if done >= 0 and depth[path[-1]] < common:
                parent[done] = add(common, left[done], -1)
                parent[parent[done]] = path[-1]
                path.append(parent[done])
            if one is not None:
                path.append(add(len(one), i, i))
                before = one
        right[0] = len(ordered)
        self.depth, self.left, self.right = (np.asarray(x, np.int64) for x in (depth, left, right))
        parent, ends = np.asarray(parent, np.int64), np.asarray(ends, np.int64)
        level = np.zeros(len(depth), np.int64)
        for node in np.argsort(self.depth, kind="stable")[1:]:
            level[node] = level[parent[node]] + 1
        rows = np.lexsort((self.left, level))
        number = np.empty_like(rows)
        number[rows] = np.arange(len(rows))
        self.depth, self.left, self.right, self.ends = self.depth[rows], self.left[rows], self.right[rows], ends[rows]
        above = np.concatenate([[0], number[parent[rows[1:]]]])
        children = np.bincount(above[1:], minlength=len(rows))
        self.children, self.first_child = children, 1 + np.concatenate([[0], np.cumsum(children)[:-1]])
        begin = np.concatenate([[0], self.depth[above[1:]]])
        edges = [ordered[a][b:c] for a, b, c in zip(self.left[1:], begin[1:], self.depth[1:])]
        self.length = self.depth - begin
        self.start = np.cumsum(self.length) - self.length
        self.tokens = np.concatenate([np.zeros(0, np.int32), *edges])
        self.last = np.concatenate([[-1], self.tokens[self.start[1:] + self.length[1:] - 1]])
        sizes = np.asarray([len(s) for s in ordered], np.int64)
        self.least = np.asarray([sizes[a:b].min() for a, b in zip(self.left, self.right)])
        self.most = np.asarray([sizes[a:b].max() for a, b in zip(self.left, self.right)])

    def linked(self, one: np.ndarray, held: np.ndarray, same: np.ndarray, parts: int, whole: int) -> np.ndarray:
        """Places, in ``order``, of the sets that are linked with ``one``; ``held`` marks its numbers, ``same`` the nodes
        below which every set is in its component."""
        n, both = len(one), whole + parts
        found = []
        at, shared = np.arange(1, 1 + self.children[0]), np.zeros(self.children[0], np.int64)
        while at.size:
            alive = ~same[at] & (whole * self.most[at] >= parts * n) & (parts * self.least[at] <= whole * n)
            at, shared = at[alive], shared[alive]
            if not at.size:
                break
            length = self.length[at]
            begin = np.cumsum(length) - length
            tokens = self.tokens[np.repeat(self.start[at] - begin, length) + np.arange(length.sum())]
            shared = shared + np.add.reduceat(held[tokens], begin)
            remain = n - np.searchsorted(one, self.last[at], side="right")
            depth = self.depth[at]
            size = np.clip(depth + remain, self.least[at], self.most[at])
            alive = both * (shared + np.minimum(size - depth, remain)) >= parts * (n + size)
            at, shared, depth = at[alive], shared[alive], depth[alive]
            found.append(self.ends[at][(self.ends[at] >= 0) & (both * shared >= parts * (n + depth))])
            children = self.children[at]
            shared = np.repeat(shared, children)
            first = np.cumsum(children) - children
            at = np.repeat(self.first_child[at] - first, children) + np.arange(children.sum())
        return np.concatenate([np.zeros(0, np.int64), *found])


def tree_links(
    sets: list[np.ndarray], component: np.ndarray, asks: np.ndarray, stays: np.ndarray, parts: int, whole: int
) -> list[tuple[int, int]]:
    """Links between sets that ask and sets that stay in the tree, enough of them to join all components that are linked."""
    tokens = np.concatenate(sets)
    values, tokens, counts = np.unique(tokens, return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int32)
    rank[np.argsort(-counts, kind="stable")] = np.arange(len(values))
    tokens = rank[tokens]
    ends = np.cumsum([len(s) for s in sets])
    ordered = [np.sort(tokens[end - len(s) : end]) for end, s in zip(ends, sets)]
    stored_ones = np.flatnonzero(stays)
    tree = PrefixTree([ordered[i] for i in stored_ones])
    places = stored_ones[tree.order]
    component = component.copy()
    held = np.zeros(len(values), np.int64)
    links = []

    def uniform() -> tuple[np.ndarray, np.ndarray]:
        """Whether the sets below a node are all in one component, and which the first is in."""
        below = component[places]
        turns = np.concatenate([[0], np.cumsum(below[1:] != below[:-1])])
        return turns[tree.right - 1] == turns[tree.left], below[tree.left]

    one_component, first = uniform()
    for i in np.flatnonzero(asks):
        if one_component[0] and first[0] == component[i]:
            continue  # nothing in the tree is in another component
        held[ordered[i]] = 1
        found = places[tree.linked(ordered[i], held, one_component & (first == component[i]), parts, whole)]
        held[ordered[i]] = 0
        others = [j for j in found if component[j] != component[i]]
        if others:
            for j in others:
                if component[j] != component[i]:
                    links.append((int(i), int(j)))
                    low, high = sorted((component[i], component[j]))
                    component[component == high] = low
            one_component, first = uniform()
    return links


def _tree_joins(units: DataFrame, parts: int, whole: int) -> DataFrame:
    """Links (a, b) of the units: rows (unit, i, j, asks, stays, component, node, set), a tree for each (unit, i, j)."""
    layout = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def join(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        node = np.asarray([r[3] for r in rows], np.int64)
        asks, stays = (np.asarray([r[k] for r in rows], bool) for k in (0, 1))
        if asks.any() and stays.any() and len(rows) > 1:
            sets = [np.frombuffer(r[4], np.uint64) for r in rows]
            links = tree_links(sets, np.asarray([r[2] for r in rows], np.int64), asks, stays, parts, whole)
            if links:
                yield pa.record_batch([pa.array(node[[a for a, _ in links]]), pa.array(node[[b for _, b in links]])], schema=layout)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, rows = None, []
        for batch in batches:
            for *key, asks, stays, component, node, packed in zip(*(column.to_pylist() for column in batch.columns)):
                if key != unit:
                    yield from join(rows)
                    unit, rows = key, []
                rows.append((asks, stays, component, node, packed))
        yield from join(rows)

    rows = units.select("unit", "i", "j", "asks", "stays", "component", "node", "set")
    rows = rows.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j", "node")
    return stored(map_batches(rows, run, "a long, b long"), "links")


def _blocks(members: DataFrame, diagonal: bool) -> DataFrame:
    """``members`` (unit, node, n_shingles, component) dealt to blocks, so that each pair of blocks keeps the bounds.

    With ``diagonal`` the pairs of a block with itself only.
    """
    sizes = members.groupBy("unit").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("tokens"))
    work = F.col("sets") * F.col("tokens")
    split = F.greatest(F.ceil(2 * F.col("tokens") / MOST_TOKENS), F.ceil(2 * F.sqrt(work / MOST_WORK)))
    whole = (F.col("tokens") <= MOST_TOKENS) & (work <= MOST_WORK)
    sizes = sizes.select("unit", F.when(whole, 1).otherwise(split).cast("int").alias("blocks"))
    dealt = members.join(sizes, "unit").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    others = F.array("block") if diagonal else F.sequence(F.lit(0), F.col("blocks") - 1)
    dealt = dealt.select("unit", "node", "component", "block", F.explode(others).alias("other"))
    return dealt.select(
        "unit", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        (F.col("block") <= F.col("other")).alias("asks"), (F.col("block") >= F.col("other")).alias("stays"), "component", "node",
    )


def _with_components(members: DataFrame, groups: DataFrame) -> DataFrame:
    groups = groups.select("node", F.col("component").alias("found"))
    return members.join(groups, "node", "left").withColumn("component", F.coalesce("found", "node")).drop("found")


def _families(members: DataFrame) -> DataFrame:
    """(node, component) of the nodes that buckets connect.

    Each node meets the least node of all its buckets first; what is left to connect are buckets with nodes of several
    of the groups that come of this, so a large family makes one edge a node and not one for each bucket.
    """
    first = members.groupBy("key").agg(F.min("node").alias("a"))
    edges = members.join(first, "key").groupBy(F.col("node").alias("b")).agg(F.min("a").alias("a")).where("a <> b")
    early = stored(_with_components(members, components(edges)).select("key", "node", "component"), "early")
    mixed = early.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("high")).where("a < high").select("key", "a")
    edges = early.join(stored(mixed, "mixed"), "key").where("component <> a").select("a", F.col("component").alias("b")).distinct()
    later = components(edges).select(F.col("node").alias("component"), F.col("component").alias("found"))
    named = early.select("node", "component").distinct().join(later, "component", "left")
    return named.select("node", F.coalesce("found", "component").alias("component"))


def _links(members: DataFrame, nodes: DataFrame, sets: DataFrame, parts: int, whole: int) -> DataFrame:
    """Links (a, b) that join all components of linked nodes; ``members`` are (key, node) of the buckets with several nodes."""
    families = _families(members).withColumnRenamed("component", "unit").join(nodes.select("node", "n_shingles"), "node")
    families = stored(families.withColumn("component", F.col("node")), "families")
    sizes = families.groupBy("unit").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("tokens"))
    large = stored(sizes.where((F.col("tokens") > MOST_TOKENS) | (F.col("sets") * F.col("tokens") > MOST_WORK)).select("unit"), "large")
    alone = families.join(large, "unit", "left_anti")
    links = _tree_joins(_blocks(alone, diagonal=True).join(sets, "node"), parts, whole)
    if large.isEmpty():
        return links
    of_large = families.join(large, "unit", "left_semi").select("node", "n_shingles", "component")
    shared = stored(members.join(of_large, "node").withColumnRenamed("key", "unit"), "shared")
    held = shared.groupBy("unit").agg(F.count("*").alias("held"))
    largest = shared.join(held, "unit").groupBy("node").agg(F.max(F.struct("held", "unit")).alias("largest"))
    chosen = shared.join(largest.select("node", F.col("largest.unit").alias("unit")), ["node", "unit"])
    early = _tree_joins(_blocks(chosen, diagonal=True).join(sets, "node"), parts, whole)
    shared = stored(_with_components(shared, components(early)), "shared")
    mixed = shared.groupBy("unit").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    rest = shared.join(stored(mixed.select("unit"), "mixed"), "unit", "left_semi")
    return links.union(early).union(_tree_joins(_blocks(rest, diagonal=False).join(sets, "node"), parts, whole))


def jaccard_join(docs: DataFrame, words: int = 5, parts: int = 80, whole: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id), one row per document."""
    features = stored(_features(docs, words, parts, whole), "features")
    with_set = features.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    nodes = with_set.groupBy(*_SET).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.first("keys").alias("keys"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    several = stored(keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").select("key"), "several")
    members = stored(keyed.join(several, "key").select("key", "node"), "members")
    partners = nodes.join(members.select("node").distinct(), "node", "left_semi")
    links = _links(members, nodes, _sets(docs, partners, words), parts, whole)
    # texts under one doc_id are one document
    texts = with_set.select("doc_id", *_SET).distinct()
    repeated = stored(texts.groupBy("doc_id").agg(F.count("*").alias("texts")).where("texts > 1").select("doc_id"), "repeated")
    of_one = texts.join(repeated, "doc_id").join(nodes.select("node", *_SET), _SET).select("doc_id", "node")
    tied = of_one.join(of_one.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").select("a", F.col("node").alias("b"))
    groups = stored(components(links.union(tied)).join(nodes.select("node", "low"), "node"), "groups")
    least = groups.join(groups.groupBy("component").agg(F.min("low").alias("least")), "component").select("node", "least")
    named = nodes.drop("keys").join(least, "node", "left").where("least is not null or low < high")
    named = stored(named.select(*_SET, F.coalesce("least", "low").alias("component_id")), "named")
    found = features.drop("keys").join(named, _SET, "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
    # an empty text has the component of the other texts under its doc_id
    empty = stored(features.where("n_shingles = 0 and doc_id is not null").select("doc_id").distinct(), "empty")
    others = found.where("n_shingles > 0").join(empty, "doc_id").groupBy("doc_id").agg(F.min("component_id").alias("other"))
    others = stored(others, "others")
    return found.join(others, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("other", "component_id").alias("component_id"))
