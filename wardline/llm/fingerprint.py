"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits.

Every shingle of five words is hashed once; the top bits choose a bin, each bin keeps its least hash. An empty bin takes
the value of the first filled one in its own fixed random order of all bins, so the choice does not depend on how
full the neighbours are. The lowest bits of each bin are packed; two fingerprints agree by chance in one of 2^bits bins,
which the likeness corrects for.

Null text is empty. A text without words has the empty fingerprint: like another such text (1), unlike every other (0).
Equal texts have equal fingerprints. Documents are ordered by doc_id, null first, rows with the same doc_id by a hash
of their text; the successor of the last is the first, of a single document the document itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents_of, map_batches, stored
from wardline.llm.shingles import scramble, windows, word_hashes

WORDS, BINS, BITS = 5, 256, 4
_PER_BYTE = 8 // BITS
#: For each bin the place of every bin in its order, which a hash of the two decides.
_ORDER = np.argsort(np.argsort(scramble(np.arange(1, BINS * BINS + 1, dtype=np.uint64)).reshape(BINS, BINS), axis=1), axis=1)
_EMPTY = np.uint64(2**64 - 1)


def fingerprint(text: str) -> bytes:
    """BINS * BITS bits; none for a text without words."""
    words = word_hashes(text)
    if not len(words):
        return b""
    hashes = windows(words, min(WORDS, len(words)))
    least = np.full(BINS, _EMPTY, np.uint64)
    np.minimum.at(least, (hashes >> np.uint64(56)).astype(np.intp), hashes & np.uint64(2**56 - 1))
    filled = np.flatnonzero(least != _EMPTY)
    if len(filled) < BINS:
        empty = np.flatnonzero(least == _EMPTY)
        least[empty] = least[filled[_ORDER[np.ix_(empty, filled)].argmin(axis=1)]]
    low = (least & np.uint64(2**BITS - 1)).astype(np.uint8).reshape(-1, _PER_BYTE)
    packed = np.zeros(len(low), np.uint8)
    for i in range(_PER_BYTE):
        packed |= low[:, i] << (i * BITS)
    return packed.tobytes()


def likeness(left: bytes, right: bytes) -> float:
    """Estimated share of common shingles, 0 to 1."""
    if not left or not right:
        return float(left == right)
    differ = np.frombuffer(left, np.uint8) ^ np.frombuffer(right, np.uint8)
    agree = sum(int(((differ >> (i * BITS)) & (2**BITS - 1) == 0).sum()) for i in range(_PER_BYTE)) / BINS
    chance = 2.0**-BITS
    return min(1.0, max(0.0, (agree - chance) / (1 - chance)))


def edited(text: str, following: str) -> str:
    """The second half of the code points replaced by the first as many of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _judge(doc_id, text: str, own: bytes, following: str, following_print: bytes) -> tuple:
    changed = edited(text, following)
    other = own if changed == text else fingerprint(changed)
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return doc_id, len(text), sha, own.hex(), other.hex(), likeness(own, other), likeness(own, following_print)


_RESULT = [
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """A row per document with its fingerprint, that of its edited text and their likeness.

    The texts are dealt out by ranges of doc_id and move once. A task knows the successor of each of its documents but
    the last; that one meets the first document of the next task in a second step of one row per task.
    """
    ordered = documents_of(docs).withColumn("tie", F.xxhash64("text"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    layout = pa.schema([("part", pa.int32()), ("place", pa.string()), ("text", pa.string()), *_RESULT])
    blank = (None,) * 6

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last = None
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = fingerprint(text)
                if last is None:
                    rows.append((part, "first", text, doc_id, *blank))
                else:
                    rows.append((part, "inside", None, *_judge(*last, text, own)))
                last = doc_id, text, own
            yield pa.record_batch([list(column) for column in zip(*rows)] or [[]] * len(layout), schema=layout)
        if last is not None:
            yield pa.record_batch([[value] for value in (part, "last", last[1], last[0], *blank)], schema=layout)

    judged = stored(map_batches(ordered, judge, "part int, place string, text string, " + RESULT), "fingerprints")
    inside = judged.where("place = 'inside'").select(*[name for name, _ in _RESULT])
    parts = sorted(row["part"] for row in judged.where("place = 'first'").select("part").collect())  # one per task
    if not parts:
        return inside
    succeeds = F.create_map(*[F.lit(value) for pair in zip(parts, parts[1:] + parts[:1]) for value in pair])
    ends = judged.where("place = 'last'").select("doc_id", "text", F.element_at(succeeds, F.col("part")).alias("next_part"))
    firsts = judged.where("place = 'first'").select(F.col("part").alias("next_part"), F.col("text").alias("following"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                _judge(doc_id, text, fingerprint(text), following, fingerprint(following))
                for doc_id, text, following in zip(*(column.to_pylist() for column in batch.columns))
            ]
            yield pa.record_batch([list(column) for column in zip(*rows)] or [[]] * len(_RESULT), schema=pa.schema(_RESULT))

    return inside.unionByName(
        map_batches(ends.join(firsts, "next_part").select("doc_id", "text", "following"), finish, RESULT)
    )
