"""MinHash near-dedup by an LSH forest, confirmed on full shingle sets.

A document's set holds its distinct word shingles. Documents with the same set are one node. Every node has TREES keys
of DEPTH MinHash values each; in each of the sorted orders a node is compared with the WINDOW nearest on either side
that share at least LEAST values with it, so the depth adapts to how crowded the region is: the longest common prefixes
come first. Candidates are confirmed on the full sets, first the best partner of each node, then whatever candidates
still lie in different components.

Where a window was full, nodes with a shorter common prefix may not have met. For each node the chance that a link
escaped all orders follows from the depths its windows reached. Nodes for which it exceeds MISS, and that share a region
with such a node of another component, are joined exactly: two sets as alike as asked share one of their rarest shingles.

Null text or text without words has the empty set and is linked with nothing. Rows with the same doc_id are one node.
A row without doc_id is a component of its own, without id, and stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import documents_of, map_batches, stored, without
from wardline.llm.exact_dedup import text_key
from wardline.llm.graph import components
from wardline.llm.shingles import scramble, shingles, word_hashes

TREES, DEPTH, LEAST, WINDOW = 20, 8, 3, 3
MISS = 1e-6
#: Ids of candidates are sent to the texts up to this number (8 bytes each); more are joined by a shuffle.
MOST_SENT = 2_000_000
_ODD = scramble(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFT = scramble(np.arange(10_001, 10_001 + TREES * DEPTH, dtype=np.uint64))


def signature(hashes: np.ndarray) -> bytes:
    """TREES * DEPTH MinHash values of 16 bits, the values of a tree side by side, highest byte first."""
    least = np.full(TREES * DEPTH, np.uint64(2**64 - 1))
    for start in range(0, len(hashes), 1_024):
        some = hashes[start : start + 1_024, None] * _ODD + _SHIFT
        least = np.minimum(least, some.min(axis=0))
    return scramble(least).astype(">u2").tobytes()


def _features(docs: DataFrame, words: int) -> DataFrame:
    layout = pa.schema([
        ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("signature", pa.binary()),
    ])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = shingles(word_hashes(text), words)
                sums = scramble(hashes).sum(dtype=np.uint64), scramble(hashes ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
                rows.append((doc_id, len(hashes), *(int(s.astype(np.int64)) for s in sums), signature(hashes) if len(hashes) else None))
            yield pa.record_batch([list(column) for column in zip(*rows)] or [[]] * 5, schema=layout)

    return map_batches(documents_of(docs), make, "doc_id long, n_shingles long, set_a long, set_b long, signature binary")


_ORDER = "tree int, key binary, doc_id long, n long"


def _orders(nodes: DataFrame) -> DataFrame:
    """A row per node and tree, in order."""
    size = 2 * DEPTH
    keys = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(
        t.cast("int").alias("tree"), F.substring("signature", t * size + 1, F.lit(size)).alias("key")
    ))
    rows = nodes.select("doc_id", F.col("n_shingles").alias("n"), F.inline(keys))
    return rows.select("tree", "key", "doc_id", "n").repartitionByRange("tree", "key", "doc_id").sortWithinPartitions("tree", "key", "doc_id")


_MET = "kind string, a long, b long, prefix int, tree int, key binary, n long"
_MET_LAYOUT = pa.schema([
    ("kind", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("prefix", pa.int32()), ("tree", pa.int32()), ("key", pa.binary()), ("n", pa.int64()),
])


def _meet(parts: int, whole: int, edges: bool):
    """Compare each row with the next WINDOW rows of its order.

    Gives pairs, the depth of the rows whose windows were full, and, with ``edges``, the first and last rows of the
    task, which meet those of the neighbouring tasks afterwards.
    """

    def compare(tree, key, doc_id, n, new_from: int) -> Iterator[pa.RecordBatch]:
        """Pairs whose later row is at ``new_from`` or behind."""
        for j in range(1, WINDOW + 1):
            left = np.arange(max(0, new_from - j), len(tree) - j)
            right = left + j
            if not left.size:
                continue
            same = np.cumprod(key[left] == key[right], axis=1).sum(axis=1) * (tree[left] == tree[right])
            near = (same >= LEAST) & (whole * np.minimum(n[left], n[right]) >= parts * np.maximum(n[left], n[right])) & (doc_id[left] != doc_id[right])
            a, b = doc_id[left][near], doc_id[right][near]
            yield rows("pair", np.minimum(a, b), np.maximum(a, b), same[near])
            if j == WINDOW:
                full = same >= LEAST
                for side in (left, right):
                    yield rows("full", doc_id[side][full], tree[side][full], same[full] + 1)

    def rows(kind, a, b, prefix) -> pa.RecordBatch:
        m, none = len(a), lambda kind: pa.nulls(len(a), kind)
        return pa.record_batch([
            pa.array([kind] * m, pa.string()), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)),
            pa.array(prefix.astype(np.int32)), none(pa.int32()), none(pa.binary()), none(pa.int64()),
        ], schema=_MET_LAYOUT)

    def edge(tree, key, doc_id, n) -> pa.RecordBatch:
        m = len(tree)
        raw = key.astype(">u2")
        return pa.record_batch([
            pa.array(["edge"] * m, pa.string()), pa.array(doc_id), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32()),
            pa.array(tree.astype(np.int32)), pa.array([k.tobytes() for k in raw], pa.binary()), pa.array(n),
        ], schema=_MET_LAYOUT)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, first = None, True
        for batch in batches:
            if not batch.num_rows:
                continue
            tree, doc_id, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            key = np.frombuffer(b"".join(batch.column(1).to_pylist()), ">u2").reshape(-1, DEPTH).astype(np.uint16)
            now = (tree, key, doc_id, n)
            if edges and first:
                ahead = now
                if len(tree) >= WINDOW:
                    yield edge(*(x[:WINDOW] for x in now))
                    first = False
            if kept is not None:
                now = tuple(np.concatenate([old, new]) for old, new in zip(kept, now))
                if edges and first and len(now[0]) >= WINDOW:
                    yield edge(*(x[:WINDOW] for x in now))
                    first = False
            yield from compare(*now, new_from=0 if kept is None else len(kept[0]))
            kept = tuple(x[-2 * WINDOW :] for x in now)
        if edges and kept is not None:
            yield edge(*(x[-(2 * WINDOW if first else WINDOW) :] for x in kept))

    return meet


def _candidates(nodes: DataFrame, parts: int, whole: int) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b, votes) and, for rows with full windows, (doc_id, tree, depth)."""
    met = stored(map_batches(_orders(nodes), _meet(parts, whole, edges=True), _MET), "met")
    # a few rows per task: what stands on either side of a border between tasks
    borders = met.where("kind = 'edge'").select("tree", "key", F.col("a").alias("doc_id"), "n").distinct()
    borders = borders.coalesce(1).sortWithinPartitions("tree", "key", "doc_id")
    met = met.unionByName(stored(map_batches(borders, _meet(parts, whole, edges=False), _MET), "borders"))
    pairs = met.where("kind = 'pair'").groupBy("a", "b").agg(F.count("*").alias("votes"), F.sum("prefix").alias("prefixes"))
    full = met.where("kind = 'full'").groupBy(F.col("a").alias("doc_id"), F.col("b").alias("tree")).agg(F.max("prefix").alias("depth"))
    return stored(pairs, "pairs"), full


def _sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, shingles) of the nodes in ``ids``, recomputed from their texts; the texts stay where they are."""
    few = ids.count() <= MOST_SENT
    texts = documents_of(docs).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi")
    layout = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(word_hashes(text), words).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.binary())], schema=layout)

    return stored(map_batches(texts, make, "doc_id long, shingles binary"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, parts: int, whole: int) -> DataFrame:
    """The pairs whose full sets are alike: whole * intersection >= parts * union."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("set_b"))
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "set_a", "set_b")
    layout = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            alike = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                common = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                alike.append(whole * common >= parts * ((len(x) + len(y)) // 8 - common))
            keep = pa.array(alike, pa.bool_())
            yield pa.record_batch([batch.column(0).filter(keep), batch.column(1).filter(keep)], schema=layout)

    return stored(map_batches(both, confirm, "a long, b long"), "confirmed")


def _apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose nodes are not in one component yet."""
    named = lambda side: groups.select(F.col("node").alias(side), F.col("component").alias("group_" + side))
    joined = pairs.join(named("a"), "a", "left").join(named("b"), "b", "left")
    return joined.where(F.coalesce("group_a", "a") != F.coalesce("group_b", "b")).select("a", "b")


def _uncertain(nodes: DataFrame, full: DataFrame, groups: DataFrame, similarity: float) -> DataFrame:
    """(doc_id, component) of the nodes that may have missed a link and share a region across components."""
    miss = lambda depth: math.log1p(-(similarity**depth)) if depth <= DEPTH else 0.0
    gain = F.coalesce(*[F.when(F.col("depth") == d, miss(d) - miss(LEAST)) for d in range(LEAST, DEPTH + 2)], F.lit(0.0))
    risky = full.groupBy("doc_id").agg(F.sum(gain).alias("gain")).where(F.col("gain") + TREES * miss(LEAST) > math.log(MISS))
    risky = risky.join(nodes.select("doc_id", "signature"), "doc_id").join(
        groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    ).select("doc_id", F.coalesce("component", "doc_id").alias("component"), "signature")
    risky = stored(risky, "risky")
    regions = risky.select("doc_id", "component", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(TREES - 1)),
        lambda t: F.struct(t.alias("tree"), F.substring("signature", t * 2 * DEPTH + 1, F.lit(2 * LEAST)).alias("prefix")),
    )).alias("region"))
    mixed = regions.groupBy("region").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high")
    return stored(regions.join(mixed.select("region"), "region", "left_semi").select("doc_id", "component").distinct(), "uncertain")


def _exact_pairs(uncertain: DataFrame, sets: DataFrame, parts: int, whole: int) -> DataFrame:
    """All pairs across components that can be as alike as asked, by their rarest shingles.

    In the order from the rarest shingle to the commonest, the first common shingle of two sets stands so early in both
    that what follows it can still make up the overlap they need. Pairs inside a component are not even met: of each
    shingle the rows of its commonest component are joined with those of the others only.
    """
    layout = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.int64()), ("shingle", pa.int64())])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = np.frombuffer(packed, np.int64)
                same = [np.full(len(found), value) for value in (doc_id, len(found), np.bitwise_xor.reduce(found))]
                yield pa.record_batch([*same, found], schema=layout)

    members = sets.join(uncertain, "doc_id", "left_semi").select("doc_id", "shingles").distinct()
    rows = stored(map_batches(members, spread, "doc_id long, n long, set long, shingle long"), "shingles")
    counts = rows.groupBy("shingle").agg(F.count("*").alias("documents")).where("documents > 1")
    of_one = Window.partitionBy("doc_id", "set")
    # shingles of one document alone come first in the order, so they use up places
    alone = F.col("n") - F.count("*").over(of_one)
    place = F.row_number().over(of_one.orderBy("documents", "shingle")) + alone
    ranked = rows.join(counts, "shingle").select("doc_id", "n", "shingle", place.alias("place"))
    early = ranked.where(whole * (F.col("n") - F.col("place") + 1) >= parts * F.col("n")).join(uncertain, "doc_id")
    by_group = early.groupBy("shingle", "component").agg(F.count("*").alias("rows"))
    mixed = by_group.groupBy("shingle").agg(F.max(F.struct("rows", "component")).alias("most"), F.count("*").alias("groups")).where("groups > 1")
    early = stored(early.join(mixed.select("shingle", F.col("most.component").alias("commonest")), "shingle"), "early")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("doc_id", "n", "place", "component")]
    left = early.where("component <> commonest").select("shingle", "commonest", *side("a"))
    right = early.select(F.col("shingle").alias("of"), *side("b"))
    left_over = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b")) + 1
    meet = (F.col("shingle") == F.col("of")) & (F.col("component_a") != F.col("component_b"))
    meet &= (F.col("component_b") == F.col("commonest")) | (F.col("doc_id_a") < F.col("doc_id_b"))
    meet &= (whole + parts) * left_over >= parts * (F.col("n_a") + F.col("n_b"))
    return left.join(right, meet).select(
        F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")
    ).distinct()


def near_duplicates(docs: DataFrame, words: int = 5, parts: int = 80, whole: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept); linked are sets with whole * intersection >= parts * union."""
    features = stored(_features(docs, words), "features")
    with_set = features.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    by_set = with_set.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("first"))
    same = with_set.join(by_set, ["set_a", "set_b", "n_shingles"]).select(F.col("first").alias("a"), F.col("doc_id").alias("b")).where("a <> b")
    # one node per set: rows with the same set carry the same signature
    nodes = stored(with_set.join(by_set.select(F.col("first").alias("doc_id"), "set_a", "set_b", "n_shingles"), ["doc_id", "set_a", "set_b", "n_shingles"]).select(
        "doc_id", "n_shingles", "signature"
    ).dropDuplicates(["doc_id", "signature"]), "nodes")
    pairs, full = _candidates(nodes, parts, whole)
    full = stored(full, "full")
    met = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).union(full.select("doc_id")).distinct()
    sets = _sets(docs, stored(met, "met"), words)
    order = F.struct("votes", "prefixes", F.negative("other").alias("other"))
    both = pairs.select("a", "votes", "prefixes", F.col("b").alias("other")).union(
        pairs.select("b", "votes", "prefixes", F.col("a").alias("other"))
    )
    best = both.groupBy("a").agg(F.max(order).alias("best")).select(
        F.least("a", F.negative("best.other")).alias("a"), F.greatest("a", F.negative("best.other")).alias("b")
    ).distinct()
    links = _confirmed(best, sets, parts, whole)
    groups = components(links)
    links = links.union(_confirmed(_apart(pairs, groups).join(best, ["a", "b"], "left_anti"), sets, parts, whole))
    groups = components(links)
    uncertain = _uncertain(nodes, full, groups, parts / whole)
    if not uncertain.isEmpty():
        links = links.union(_confirmed(_exact_pairs(uncertain, sets, parts, whole), sets, parts, whole))
    groups = components(links.union(same))
    return features.select("doc_id", "n_shingles").join(
        groups.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left"
    ).select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce(F.col("doc_id") == F.coalesce("component", "doc_id"), F.lit(True)).alias("kept"),
    )


def unlike_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with the document of the smallest doc_id of each group of near copies; rows without doc_id stay.

    Where a doc_id has several texts each is a document, and of those that are alike the one with the least key stays.
    """
    rows = documents_of(docs).where("doc_id is not null").select("doc_id", text_key(F.col("text")).alias("text_key"))
    several = rows.groupBy("doc_id").agg(F.min("text_key").alias("low"), F.max("text_key").alias("high")).where("low <> high")
    if several.isEmpty():
        return without(docs, near_duplicates(docs).where(~F.col("kept")).select("doc_id"))
    order = ["doc_id", "text_key"]  # numbers rise with the doc_id, so the smallest one still stays
    numbered = stored(
        rows.distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn("number", F.monotonically_increasing_id()), "numbered"
    )
    texts = documents_of(docs).withColumn("text_key", text_key(F.col("text")))
    named = texts.join(numbered, order).select(F.col("number").alias("doc_id"), "text")
    gone = near_duplicates(named).where(~F.col("kept")).select(F.col("doc_id").alias("number")).distinct()
    return without(docs, numbered.join(gone, "number").select(*order), text_key(docs["text"]))
