"""Repeated passages by a sparse suffix array: suffixes at minimisers, sorted, compared and extended both ways.

Two documents share a passage exactly if they share one of its windows of LEAST_WORDS words. Every window is marked by
its anchor, the first place of the least hash of its runs of BLOCK words, which equal windows have in common. Only the
suffixes that begin at anchors are kept, about one for every 18 words, and of these only the ones whose block occurs in
several documents. A suffix is stored with the words its windows reach: to the right first, then to the left from the
anchor outwards, so one sort puts equal right sides next to each other.

Suffixes with one block meet in one task. The words that sorted neighbours share to the right put suffixes in runs for
each length; inside a run the left sides are sorted and compared too, so for each division of LEAST_WORDS into words left
and right of the anchor it is known which documents agree. Comparing with the one nearest neighbour would not do: in a
line that many documents share, the nearest on the right need not agree on the left. A match is extended from anchor to
anchor as long as windows agree, so passages are maximal. Blocks with more than MOST_SUFFIXES suffixes are not brought to
one task: their suffixes give one row for each division, and these rows are merged by hash before they are shuffled.
Neither way makes pairs: the documents that agree are counted by their least and greatest row and never listed.

Words are what ASCII white space separates, with A-Z lower-cased; they are compared by 32-bit hashes. Null and empty texts
have no passage, nor have texts shorter than the least length. Repeated rows (same doc_id, same text) are one document,
other rows with one doc_id are several; a null doc_id stays null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import documents_of, map_batches, stored
from wardline.llm.shingles import scramble, windows, word_hashes

LEAST_WORDS, BLOCK = 50, 16
REACH = LEAST_WORDS - BLOCK + 1
#: Words kept of a suffix: LEAST_WORDS to the right of its anchor, REACH - 1 to the left.
KEPT = LEAST_WORDS + REACH - 1
#: Ids of documents with matches are sent to the texts up to this number (about 40 bytes each as sent, 80 MB at
#: most); more are joined by a shuffle.
MOST_SENT = 2_000_000
#: Suffixes with one block that are compared in one task (336 bytes each); tasks gather about as many before comparing.
MOST_SUFFIXES = 20_000
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _keyed(docs: DataFrame) -> DataFrame:
    """(row, doc_id, text): one row per document, whose ``row`` follows from its id and text."""
    texts = documents_of(docs)
    return texts.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")


def anchors(hashes: np.ndarray) -> np.ndarray:
    """For each window the first place of the least of its REACH hashes."""
    if len(hashes) < REACH:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(hashes, REACH)
    return views.argmin(axis=1) + np.arange(len(views))


def selected(hashes: np.ndarray) -> np.ndarray:
    """Places of the least hash of every REACH neighbours; of equal ones as few as still serve every window."""
    places = np.unique(anchors(hashes))
    if len(places) <= 4 * len(hashes) // REACH + 4:
        return places
    kept = [int(places[0])]
    for i in range(1, len(places)):
        tied = hashes[places[i]] == hashes[kept[-1]]
        reached = i + 1 < len(places) and places[i + 1] - kept[-1] <= REACH and hashes[places[i + 1]] == hashes[kept[-1]]
        if not (tied and reached):
            kept.append(int(places[i]))
    return np.asarray(kept, np.int64)


def _lists(column: pa.ListArray, *fields: int) -> Iterator[list[np.ndarray]]:
    """The values of each row's list, or of the fields of its structs."""
    values = column.flatten()
    parts = [values.field(i) for i in fields] if fields else [values]
    ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
    for begin, end in zip([0, *ends], ends):
        yield [part.slice(begin, end - begin) for part in parts]


def _blocks(docs: DataFrame) -> DataFrame:
    """(block, row): the distinct least hashes of the windows of each document."""
    layout = pa.schema([("block", pa.int64()), ("row", pa.int64())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                hashes = windows(word_hashes(text), BLOCK)
                blocks.append(np.unique(hashes[selected(hashes)]).view(np.int64))
                rows.append(np.full(len(blocks[-1]), row, np.int64))
            yield pa.record_batch([pa.array(np.concatenate(blocks)), pa.array(np.concatenate(rows))], schema=layout)

    return map_batches(_keyed(docs).select("row", "text"), make, "block long, row long")


def suffixes(words: np.ndarray, at: np.ndarray, wanted: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(places, words kept, contexts) of the suffixes at the anchors, some thousand at a time.

    A row has the words from the anchor on, then those before it going left, as far as the windows with this anchor
    reach, and 0 beyond. A context is a hash of the row. With ``wanted`` only the places among them.
    """
    places, first, count = np.unique(at, return_index=True, return_counts=True)
    short = np.maximum(words.astype(np.uint32), np.uint32(1))
    if wanted is not None:
        keep = np.isin(places, wanted)
        places, first, count = places[keep], first[keep], count[keep]
    right, left = np.arange(LEAST_WORDS), np.arange(REACH - 1)
    for i in range(0, len(places), 1 << 13):
        place, begin, n = places[i : i + (1 << 13), None], first[i : i + (1 << 13), None], count[i : i + (1 << 13), None]
        end = begin + n - 1 + LEAST_WORDS
        after, before = place + right, place - 1 - left
        row = np.concatenate([
            np.where(after < end, short[np.minimum(after, len(words) - 1)], 0),
            np.where(before >= begin, short[np.maximum(before, 0)], 0),
        ], axis=1).astype(np.uint32)
        total = np.zeros(len(row), np.uint64)
        for column in np.ascontiguousarray(row.T):
            total = total * _MULTIPLIER + column
        yield place[:, 0], row, scramble(total)


def _suffixes(texts: DataFrame) -> DataFrame:
    """(block, context, suffix, row, doc_id): the distinct suffixes at anchors whose block is among the row's ``blocks``."""
    layout = pa.schema([
        ("block", pa.int64()), ("context", pa.int64()), ("suffix", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()),
    ])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, doc_id, text, (blocks,) in zip(*(column.to_pylist() for column in batch.columns[:3]), _lists(batch.column(3))):
                words = word_hashes(text)
                hashes = windows(words, BLOCK)
                at = anchors(hashes)
                wanted = np.flatnonzero(np.isin(hashes, blocks.to_numpy(zero_copy_only=False).view(np.uint64)))
                for places, kept, contexts in suffixes(words, at, wanted):
                    contexts, which = np.unique(contexts, return_index=True)
                    n = len(which)
                    data = kept[which].astype(">u4").tobytes()
                    ends = np.arange(n + 1, dtype=np.int32) * (4 * KEPT)
                    yield pa.record_batch([
                        pa.array(hashes[places[which]].view(np.int64)), pa.array(contexts.view(np.int64)),
                        pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(data)]),
                        pa.array(np.full(n, row, np.int64)), pa.array([doc_id] * n, pa.int64()),
                    ], schema=layout)

    return map_batches(
        texts.select("row", "doc_id", "text", "blocks"), make, "block long, context long, suffix binary, row long, doc_id long"
    )


def _in_several(df: DataFrame, key: str, *more) -> DataFrame:
    """The keys that rows of several documents have. Stored, so that a join with them can split a frequent key."""
    counted = df.groupBy(key).agg(F.min("row").alias("low"), F.max("row").alias("high"), *more).where("low <> high")
    return stored(counted.drop("low", "high"), key)


def _texts_of(docs: DataFrame, rows: DataFrame) -> DataFrame:
    few = rows.count() <= MOST_SENT
    return _keyed(docs).join(F.broadcast(rows) if few else rows, "row", "left_semi").dropDuplicates(["row"])


def _words_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u4").astype(np.uint32).reshape(-1, KEPT)


_LEAST, _GREATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def agreeing(kept: np.ndarray, row: np.ndarray, doc_id: np.ndarray, none: np.ndarray) -> list[np.ndarray]:
    """(item, from, to, other, without other): the divisions at which each suffix agrees with one of another row.

    The items are in the order of their words. A division is the number of words to the left of the anchor.
    """
    n = len(kept)
    same = kept[1:, :LEAST_WORDS] == kept[:-1, :LEAST_WORDS]
    shared_right = np.where(same.all(axis=1), LEAST_WORDS, same.argmin(axis=1))
    n_right, n_left = (kept[:, :LEAST_WORDS] != 0).sum(axis=1), (kept[:, LEAST_WORDS:] != 0).sum(axis=1)
    low_id, high_id = np.where(none, _GREATEST, doc_id), np.where(none, _LEAST, doc_id)
    agree = np.zeros((n, REACH), bool)
    other = np.zeros((n, REACH), np.int64)
    without = np.zeros((n, REACH), bool)
    left = np.zeros(n, np.uint64)
    for o in range(REACH):
        if o:
            left = left * _MULTIPLIER + kept[:, LEAST_WORDS + o - 1]
        run = np.concatenate([[0], np.cumsum(shared_right < LEAST_WORDS - o)])
        item = np.flatnonzero((n_right >= LEAST_WORDS - o) & (n_left >= o))
        if not len(item):
            continue
        item = item[np.lexsort((left[item], run[item]))]
        begin = np.concatenate([[0], 1 + np.flatnonzero((np.diff(run[item]) != 0) | (left[item[1:]] != left[item[:-1]]))])
        size = np.diff(np.concatenate([begin, [len(item)]]))
        several = np.minimum.reduceat(row[item], begin) != np.maximum.reduceat(row[item], begin)
        least, greatest = np.minimum.reduceat(low_id[item], begin), np.maximum.reduceat(high_id[item], begin)
        null = np.logical_or.reduceat(none[item], begin)
        keep = np.repeat(several, size)
        item, least, greatest, null = item[keep], *(np.repeat(x, size)[keep] for x in (least, greatest, null))
        agree[item, o] = True
        # the least id; where it is the item's own, the greatest, or none if only documents without id have the window too
        own = ~none[item] & (least == doc_id[item])
        lone = np.where(own, (least == greatest) & null, least == _GREATEST)
        other[item, o] = np.where(lone, 0, np.where(own, greatest, least))
        without[item, o] = lone
    cell = np.flatnonzero(agree)
    item, o, other, without = cell // REACH, cell % REACH, other.ravel()[cell], without.ravel()[cell]
    new = np.ones(len(cell), bool)
    new[1:] = (np.diff(cell) != 1) | (o[1:] == 0) | (other[1:] != other[:-1]) | (without[1:] != without[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(cell)]]) - 1 if len(cell) else first
    return [item[first], o[first], o[last], other[first], without[first]]


_MATCHES = "row long, context long, from int, to int, other long"


def _compared(ordinary: DataFrame) -> DataFrame:
    """Matches of the suffixes whose blocks are compared whole: sorted by Spark, neighbours compared block by block."""
    layout = pa.schema([("row", pa.int64()), ("context", pa.int64()), ("from", pa.int32()), ("to", pa.int32()), ("other", pa.int64())])

    def compare(table: pa.Table) -> pa.RecordBatch:
        row, context, doc_id = (table.column(name).combine_chunks() for name in ("row", "context", "doc_id"))
        row, context, none = row.to_numpy(), context.to_numpy(), doc_id.is_null().to_numpy(zero_copy_only=False)
        kept = _words_of(table.column("suffix").combine_chunks())
        item, low, high, other, without = agreeing(kept, row, doc_id.fill_null(0).to_numpy(zero_copy_only=False), none)
        return pa.record_batch([
            pa.array(row[item]), pa.array(context[item]), pa.array(low.astype(np.int32)), pa.array(high.astype(np.int32)),
            pa.array(other, mask=without),
        ], schema=layout)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(t.num_rows for t in held) < MOST_SUFFIXES:
                continue
            table = pa.concat_tables(held)
            block = table.column("block").to_numpy()
            whole = int(np.flatnonzero(block == block[-1])[0])  # the last block may go on in the next batch
            if whole:
                yield compare(table.slice(0, whole))
            held = [table.slice(whole)]
        if held:
            yield compare(pa.concat_tables(held))

    return map_batches(ordinary.repartition("block").sortWithinPartitions("block", "suffix"), make, _MATCHES)


def _merged_by_hash(hot: DataFrame) -> DataFrame:
    """Matches of the suffixes whose blocks are too frequent for one task, by a hash for each division."""
    layout = pa.schema([
        ("hash", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("context", pa.int64()), ("o", pa.int32()),
    ])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _words_of(batch.column(2))
            n_right, n_left = (kept[:, :LEAST_WORDS] != 0).sum(axis=1), (kept[:, LEAST_WORDS:] != 0).sum(axis=1)
            for o in range(REACH):
                item = np.flatnonzero((n_right >= LEAST_WORDS - o) & (n_left >= o))
                total = np.full(len(item), o, np.uint64)
                for column in (*range(LEAST_WORDS - o), *range(LEAST_WORDS, LEAST_WORDS + o)):
                    total = total * _MULTIPLIER + kept[item, column]
                taken = batch.take(pa.array(item))
                yield pa.record_batch([
                    pa.array(scramble(total).view(np.int64)), taken.column(3), taken.column(4), taken.column(1),
                    pa.array(np.full(len(item), o, np.int32)),
                ], schema=layout)

    rows = map_batches(hot.select("block", "context", "suffix", "row", "doc_id"), make, "hash long, row long, doc_id long, context long, o int")
    rows = stored(rows, "divisions")
    ids = F.min("doc_id").alias("least"), F.max("doc_id").alias("greatest"), F.max(F.col("doc_id").isNull()).alias("without_id")
    own = F.col("least").eqNullSafe(F.col("greatest")) & F.col("without_id")
    other = F.when(F.col("doc_id").isNull() | (F.col("least") != F.col("doc_id")), F.col("least")).when(~own, F.col("greatest"))
    return rows.join(_in_several(rows, "hash", *ids), "hash").select("row", "context", F.col("o").alias("from"), F.col("o").alias("to"), other.alias("other"))


def repeated_passages(docs: DataFrame, most_suffixes: int = MOST_SUFFIXES) -> DataFrame:
    """(doc_id, start, end, n_words, other_doc_id): the maximal passages, in code points, that another document has too.

    For each window the least id of its documents is taken, the greatest where the least is the document's own.
    ``other_doc_id`` is the one taken for the longest run of windows in the passage, of equal runs the least.
    """
    blocks = stored(_blocks(docs), "blocks")
    asked = stored(blocks.join(_in_several(blocks, "block"), "block").groupBy("row").agg(F.collect_list("block").alias("blocks")), "asked")
    found = stored(_suffixes(_texts_of(docs, asked.select("row")).join(asked, "row")), "suffixes")
    hot = stored(found.groupBy("block").count().where(F.col("count") > most_suffixes).select("block"), "hot")
    matches = _compared(found.join(hot, "block", "left_anti"))
    if not hot.isEmpty():
        matches = matches.unionByName(_merged_by_hash(found.join(hot, "block", "left_semi")))
    match = F.struct("context", "from", "to", "other").alias("match")
    given = stored(matches.select("row", match).groupBy("row").agg(F.collect_list("match").alias("given")), "given")
    span_layout = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("n_words", pa.int64()), ("other_doc_id", pa.int64()),
    ])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, matches in zip(*(column.to_pylist() for column in batch.columns[:2]), _lists(batch.column(2), 0, 1, 2, 3)):
                found = merged(_runs(word_hashes(text), *matches))
                places = [match.span() for match in _WORD.finditer(text)]
                out += [(doc_id, places[a][0], places[b - 1][1], b - a, other) for a, b, other in found]
            yield pa.record_batch([list(column) for column in zip(*out)] or [[]] * 5, schema=span_layout)

    return map_batches(
        _texts_of(docs, given.select("row")).join(given, "row").select("doc_id", "text", "given"), gather,
        "doc_id long, start long, end long, n_words long, other_doc_id long",
    )


def _division(contexts: np.ndarray, o: np.ndarray) -> np.ndarray:
    return scramble(contexts * _MULTIPLIER + o.astype(np.uint64))


def _runs(words: np.ndarray, contexts: pa.Array, low: pa.Array, high: pa.Array, others: pa.Array) -> list[tuple[int, int, int | None]]:
    """(from word, to word, other document) of the runs of neighbouring windows that match with the same other document."""
    contexts, low, high = (x.to_numpy(zero_copy_only=False) for x in (contexts, low, high))
    n = high - low + 1
    o = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)
    given = _division(np.repeat(contexts.view(np.uint64), n), o)
    ids = np.repeat(others.fill_null(0).to_numpy(zero_copy_only=False), n)
    none = np.repeat(others.is_null().to_numpy(zero_copy_only=False), n)
    order = np.argsort(given)
    given, ids, none = given[order], ids[order], none[order]
    at = anchors(windows(words, BLOCK))
    places, which = np.unique(at, return_inverse=True)
    own = np.concatenate([context for _, _, context in suffixes(words, at)])[which]
    own = _division(own, at - np.arange(len(at)))
    hit = np.minimum(np.searchsorted(given, own), len(given) - 1)
    starts = np.flatnonzero(given[hit] == own)
    ids, none = ids[hit[starts]], none[hit[starts]]
    new = np.ones(len(starts), bool)
    new[1:] = (np.diff(starts) > 1) | (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(starts)]]) - 1
    return [(int(starts[a]), int(starts[b]) + LEAST_WORDS, None if none[a] else int(ids[a])) for a, b in zip(first, last)]


def merged(spans: list[tuple[int, int, int | None]]) -> list[tuple[int, int, int | None]]:
    """The spans (from word, to word, other document) put together where they overlap, each with the longest one's other."""
    out: list[list] = []
    for a, b, other in sorted(spans, key=lambda s: (s[0], s[1], s[2] is None, s[2])):
        witness = (a - b, other is None, other)
        if out and a < out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
            out[-1][2] = min(out[-1][2], witness)
        else:
            out.append([a, b, witness])
    return [(a, b, witness[2]) for a, b, witness in out]
