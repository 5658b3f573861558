"""Byte-level BPE by ranks: a segment tree over byte positions stores the leftmost minimum pair rank.

Each merge reads the root, joins the pair there and updates the three leaves it touches (the pair itself, the
removed right part, the live left neighbour), each in logarithmic time. Short pieces of one size class run side by
side in numpy arrays, long ones alone, by the same steps.

Null text counts as empty: no ids, and the hashes of the empty string. Repeated rows each give a row.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from wardline.llm.common import documents_of, map_batches
from wardline.llm.pieces import PartEncoder

#: Pieces up to this many bytes run side by side; this many leaves at a time.
_SHORT, _LEAVES = 128, 1 << 17
#: Pairs of a long piece that are looked up at a time at the start.
_LOOKUP = 1 << 12


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class ByteBpe:
    """Encoder and decoder for one rank file and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.base = max(ranks.values()) + 2
        self.none = self.base - 1  # the id that stands for "no neighbour"
        self.bytes_to_id = np.full(256, self.none, np.int64)
        pairs = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.bytes_to_id[token[0]] = rank
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    pairs[left * self.base + right] = rank
        self.pairs = pairs
        self.pair_keys = np.fromiter(sorted(pairs), np.int64, len(pairs))
        self.pair_ranks = np.fromiter((pairs[k] for k in self.pair_keys.tolist()), np.int64, len(pairs))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text."""
        split, ranks = self.split, self.ranks
        known: dict[bytes, bytes] = {}
        short: dict[int, list[bytes]] = {}
        pieces_of = []
        for text in texts:
            pieces = [piece.encode() for piece in split(text)]
            pieces_of.append(pieces)
            for piece in pieces:
                if piece not in known:
                    rank = ranks.get(piece)
                    if rank is not None:
                        known[piece] = rank.to_bytes(4, "little")
                    elif len(piece) > _SHORT:
                        known[piece] = self._merge_long(piece)
                    else:
                        known[piece] = b""
                        short.setdefault(max(2, 1 << (len(piece) - 1).bit_length()), []).append(piece)
        for leaves, pieces in short.items():
            step = max(1, _LEAVES // leaves)
            for start in range(0, len(pieces), step):
                some = pieces[start : start + step]
                known.update(zip(some, self._merge_short(some, leaves)))
        return [b"".join(map(known.__getitem__, pieces)) for pieces in pieces_of]

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))

    def _pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left * self.base + right
        at = np.searchsorted(self.pair_keys, keys)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == keys, self.pair_ranks[at], self.none)

    def _merge_short(self, pieces: list[bytes], leaves: int) -> list[bytes]:
        """All ``pieces`` fit ``leaves`` positions. A node holds rank * leaves + position, so a minimum is the leftmost."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        width = leaves + 1  # one spare position stands behind the last part
        ids = np.full((n, width), self.none, np.int64)
        inside = np.arange(width) < lengths[:, None]
        ids[inside] = self.bytes_to_id[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.tile(np.arange(1, width + 1), (n, 1))
        after[:, leaves] = leaves
        after = np.minimum(after, leaves)
        after[np.arange(n), lengths - 1] = leaves
        before = np.tile(np.arange(-1, width - 1), (n, 1))
        live = inside.copy()
        none = self.none * leaves
        tree = np.full((n, 2 * leaves), none, np.int64)
        rank = self._pair_rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, leaves)
        places = np.arange(leaves)
        tree[:, leaves:] = np.where(rank == self.none, none, rank * leaves + places)
        level = leaves // 2
        while level:
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            level //= 2
        rows = np.nonzero(tree[:, 1] < none)[0]
        while rows.size:
            best = tree[rows, 1]
            at, merged = best % leaves, best // leaves
            gone = after[rows, at]
            follow = after[rows, gone]
            ids[rows, at] = merged
            live[rows, gone] = False
            after[rows, at] = follow
            before[rows, follow] = at
            left = before[rows, at]
            has_left = left >= 0
            left = np.where(has_left, left, gone)
            rank_at = self._pair_rank(merged, np.where(follow < leaves, ids[rows, follow], self.none))
            rank_left = np.where(has_left, self._pair_rank(ids[rows, left], merged), self.none)
            tree[rows, leaves + gone] = none
            tree[rows, leaves + left] = np.where(rank_left == self.none, none, rank_left * leaves + left)
            tree[rows, leaves + at] = np.where(rank_at == self.none, none, rank_at * leaves + at)
            for place in (gone, left, at):
                node = (leaves + place) >> 1
                while node[0]:
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
                    node = node >> 1
            rows = rows[tree[rows, 1] < none]
        packed = ids[live].astype("<u4").tobytes()
        ends = (4 * np.cumsum(live.sum(axis=1))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends[:-1]], ends)]

    def _merge_long(self, piece: bytes) -> bytes:
        """The same for one long piece, in flat arrays of about 30 bytes a byte.

        The tree has a leaf a position and as many inner nodes; node 1 is above all leaves, whatever their number.
        """
        n = len(piece)
        pairs, base, none = self.pairs, self.base, self.none * n
        firsts = self.bytes_to_id[np.frombuffer(piece, np.uint8)].astype(np.int32)
        nodes = np.full(2 * n, none, np.int64)
        for start in range(0, n - 1, _LOOKUP):
            end = min(start + _LOOKUP, n - 1)
            rank = self._pair_rank(firsts[start:end].astype(np.int64), firsts[start + 1 : end + 1].astype(np.int64))
            nodes[n + start : n + end] = np.where(rank == self.none, none, rank * n + np.arange(start, end))
        done = n  # nodes from here on are right
        while done > 1:
            first = (done + 1) // 2
            nodes[first:done] = np.minimum(nodes[2 * first : 2 * done : 2], nodes[2 * first + 1 : 2 * done : 2])
            done = first
        follow, lead = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        there = np.ones(n, np.uint8)
        tree, ids, after, before, live = map(memoryview, (nodes, firsts, follow, lead, there))

        def node_of(left: int, right: int) -> int:
            rank = pairs.get(ids[left] * base + ids[right]) if right < n else None
            return none if rank is None else rank * n + left

        def put(place: int, value: int) -> None:
            node = n + place
            tree[node] = value
            node >>= 1
            while node:
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least
                node >>= 1

        while tree[1] < none:
            merged, at = divmod(tree[1], n)
            gone = after[at]
            ids[at], live[gone], after[at] = merged, 0, after[gone]
            if after[gone] < n:
                before[after[gone]] = at
            put(gone, none)
            put(at, node_of(at, after[at]))
            if before[at] >= 0:
                put(before[at], node_of(before[at], at))
        return firsts[there.astype(bool)].astype("<u4").tobytes()


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> tuple[ByteBpe, PartEncoder]:
    codec = ByteBpe(read_ranks(path), pattern)
    return codec, PartEncoder(codec.encode_many)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text; with ``keep_ids`` also the ids themselves."""
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields.append(("ids", pa.list_(pa.int32())))
        schema += ", ids array<int>"
    layout = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, parts = _codec(rank_file, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            ids = []
            for packed in parts.encode(batch.column(1).to_pylist()):
                out[1].append(len(packed) // 4)
                out[2].append(hashlib.sha256(packed).hexdigest())
                out[3].append(hashlib.sha256(codec.decode(packed)).hexdigest())
                if keep_ids:
                    ids.append(np.frombuffer(packed, "<u4").astype(np.int32))
            out[0] = batch.column(0)
            yield pa.record_batch([*out, ids] if keep_ids else out, schema=layout)

    return map_batches(documents_of(docs), encode, schema)
