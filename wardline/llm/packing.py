"""Pack tokenised documents into few sequences: large pieces are matched in pairs, small ones fill gaps by best fit.

Only longer documents are cut, into pieces of exactly the capacity after a first shorter one. How many pieces of which
length there are decides the packing; that histogram has at most ``capacity`` rows, whatever the input. The plan made
from it says, for runs of equal pieces, into which run of sequences they go. Each piece finds its place from its
length and its number among the pieces of that length, so no group of pieces ever meets in one task.

Null or empty text is a document of the closing id alone. Repeated rows are packed once each. A null doc_id stays null.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import documents_of, map_batches, stored
from wardline.llm.pieces import NumberedParts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, number long"


#: Fixed value: how byte-level pre-tokenisation splits a text.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Signs, digits and letters about whose class all versions of Unicode agree.
_PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+")


def _plain_encoding(tokenizer):
    """The same merges for plain parts by a faster library; None where the file describes anything else.

    That library joins any neighbours that make a token together, not only the pair a merge names. Both come to the same
    ids where every token is what its own bytes are merged into: up to the last merge inside a token no other two can
    be its halves.
    """
    import tiktoken

    described = json.loads(tokenizer.to_str())
    model, split = described["model"], described["pre_tokenizer"] or {}
    usual = described["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
    usual = usual and model["type"] == "BPE" and not any(model.get(key) for key in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
    vocabulary = model["vocab"]
    merged = [vocabulary.get("".join(pair if isinstance(pair, list) else pair.split(" "))) for pair in model["merges"]]
    if not usual or None in merged or merged != sorted(merged):
        return None
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in set(shown)]
    byte_of = {chr(byte): byte for byte in shown} | {chr(256 + i): byte for i, byte in enumerate(hidden)}
    made = {"".join(pair if isinstance(pair, list) else pair.split(" ")) for pair in model["merges"]}
    ranks = {bytes(map(byte_of.__getitem__, token)): number for token, number in vocabulary.items() if token in byte_of or token in made}
    return tiktoken.Encoding("plain", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _encoder(path: str) -> NumberedParts:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    plain = _plain_encoding(tokenizer)
    added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]

    vocabulary = tokenizer.get_vocab()
    starts = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens whose first byte is a blank
    starts[[number for token, number in vocabulary.items() if token.startswith("\u0120")]] = True

    def by_library(text: str) -> list[int]:
        return tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids

    def encode_parts(parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts without a blank go through a tokenizer together, and are told apart by the blank each starts with.

        No part holds an added token, as texts that do are not cut.
        """
        fits = _PLAIN.fullmatch
        easy = [i for i, part in enumerate(parts) if fits(part)] if plain else []
        hard = sorted({*range(len(parts))}.difference(easy))
        with_blank = [i for i in hard if " " in parts[i]]
        without = [i for i in hard if " " not in parts[i]]
        made, size = [np.zeros(0, "<u4")], 0
        begins, sizes = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        chunks = [(some[at : at + 2_000], encode) for some, encode in ((easy, plain and plain.encode_ordinary), (without, by_library))
                  for at in range(0, len(some), 2_000)]
        for some, encode in [*chunks, *(([i], by_library) for i in with_blank)]:
            ids = np.asarray(encode(" " + " ".join([parts[i] for i in some])), "<u4")
            at = np.flatnonzero(starts[ids]) if len(some) > 1 else np.zeros(1, np.int64)
            begins[some] = at + size
            sizes[some] = np.diff(at, append=len(ids))
            made.append(ids)
            size += len(ids)
        return np.concatenate(made), begins, sizes

    def encode_whole(texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(encoding.ids, "<u4") for encoding in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    return NumberedParts(encode_parts, encode_whole, lambda text: any(token in text for token in added))


def cut_documents(docs: DataFrame, tokenizer_file: str, capacity: int, closing_id: int) -> DataFrame:
    """A row per piece, numbered among the pieces of its length that the same task made."""
    closing = np.asarray([closing_id], "<u4")
    layout = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("part", pa.int32()), ("number", pa.int64()),
    ])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        part = TaskContext.get().partitionId()
        made: dict[int, int] = defaultdict(int)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1).to_pylist())):
                ids = np.concatenate([ids, closing])
                n = len(ids)
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for piece, (start, end) in enumerate(zip(cuts, cuts[1:])):
                    length = end - start
                    rows.append((doc_id, piece, start, length, zlib.crc32(ids[start:end]), part, made[length]))
                    made[length] += 1
            yield pa.record_batch([list(column) for column in zip(*rows)] or [[]] * 7, schema=layout)

    return map_batches(documents_of(docs), pieces, PIECES)


class PackingPlan:
    """From counts by length to places: arrays sorted by (length, first number)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.left = dict(counts)
        self.used: dict[int, int] = defaultdict(int)
        self.rows: list[tuple[int, int, int, int, int]] = []
        self.gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.open = 0  # bit g: some sequence has a gap of g
        third = capacity // 3
        self._match_large(third)
        for length in sorted((x for x in self.left if x <= third), reverse=True):
            self._best_fit(length)
        self.rows.sort()
        self.length, self.first, self.each, self.sequence, self.offset = (
            np.asarray(column, np.int64) for column in (zip(*self.rows) if self.rows else [[]] * 5)
        )

    def _place(self, length: int, each: int, sequence: int, count: int, offset: int) -> None:
        """``count`` sequences from ``sequence`` on get ``each`` pieces of ``length``, from ``offset`` on."""
        self.rows.append((length, self.used[length], each, sequence, offset))
        self.used[length] += each * count
        self.left[length] -= each * count

    def _leave(self, gap: int, sequence: int, count: int) -> None:
        if gap and count:
            self.gaps[gap].append((sequence, count))
            self.open |= 1 << gap

    def _match_large(self, third: int) -> None:
        """From the longest down: each large piece meets the longest large piece that still fits beside it."""
        large = 0
        for length, count in self.left.items():
            if length > third and count:
                large |= 1 << length
        for length in sorted((x for x in self.left if x > third), reverse=True):
            while self.left[length]:
                room = min(self.capacity - length, length if self.left[length] > 1 else length - 1)
                partner = (large & ((1 << (max(room, 0) + 1)) - 1)).bit_length() - 1
                if partner <= third:
                    count, gap = self.left[length], self.capacity - length
                    self._place(length, 1, self.sequences, count, 0)
                elif partner == length:
                    count, gap = self.left[length] // 2, self.capacity - 2 * length
                    self._place(length, 2, self.sequences, count, 0)
                else:
                    count, gap = min(self.left[length], self.left[partner]), self.capacity - length - partner
                    self._place(length, 1, self.sequences, count, 0)
                    self._place(partner, 1, self.sequences, count, length)
                    if not self.left[partner]:
                        large &= ~(1 << partner)
                self._leave(gap, self.sequences, count)
                self.sequences += count
            large &= ~(1 << length)

    def _best_fit(self, length: int) -> None:
        """Every piece goes to the smallest gap it fits; only then a new sequence begins."""
        while self.left[length]:
            fitting = self.open >> length
            if fitting:
                gap = length + (fitting & -fitting).bit_length() - 1
                sequence, count = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    self.open &= ~(1 << gap)
            else:
                gap = self.capacity
                sequence, count = self.sequences, -(-self.left[length] // (gap // length))
                self.sequences += count
            each = gap // length
            full = min(count, self.left[length] // each)
            if not full:
                each, full = self.left[length], 1
            self._place(length, each, sequence, full, self.capacity - gap)
            self._leave(gap - each * length, sequence, full)
            self._leave(gap, sequence + full, count - full)

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, offset) of the pieces."""
        wide = max(1, int(self.first.max(initial=0)) + 1, int(number.max(initial=0)) + 1)
        row = np.searchsorted(self.length * wide + self.first, length * wide + number, side="right") - 1
        nth = number - self.first[row]
        return self.sequence[row] + nth // self.each[row], self.offset[row] + nth % self.each[row] * length


def pack_documents(docs: DataFrame, tokenizer_file: str, capacity: int = 2048, closing_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece."""
    pieces = stored(cut_documents(docs, tokenizer_file, capacity, closing_id), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    by_length = pieces.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    plan = docs.sparkSession.sparkContext.broadcast(PackingPlan({r["length"]: r["n"] for r in by_length}, capacity))
    numbered = pieces.join(before, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("number") + F.col("before")).alias("number")
    )
    layout = pa.schema([
        ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.places(
                *(batch.column(name).to_numpy(zero_copy_only=False) for name in ("length", "number"))
            )
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], schema=layout)

    return map_batches(
        numbered, assign, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
