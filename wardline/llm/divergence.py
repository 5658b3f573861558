"""How far the sources of a language diverge in their words, by stripes folded in the mappers.

A term is a run of letters (a-z after lower-casing A-Z) and non-ASCII characters. Each task folds its whole documents into
stripes, one per language and term: of every source the documents that have the term and how often it occurs there. A full
table of stripes is spilled; equal cells merge before and after the shuffle by key. A merged stripe then emits divergences:
of each source against the language, and, summed in the mappers, of each pair of sources that share the term.
For a pair of which one source lacks the term the divergence depends on the other's count alone, so those are summed from
the histogram of counts of each source, and no stripe is widened to all sources.

Kept are the terms in at least ``least`` documents of the language. With V of them and N occurrences in a group,
p = 1 + floor(1e9 * (count + 2) / (N + 2 * V)) and a divergence is floor((p - q)**2 / (p + q)), in whole numbers throughout.

Null text, language or source is ''. Each row is a document, repeated ones too. A group without terms has its pairs; if a
language keeps no term they are 0. Equal values rank by the UTF-8 bytes of the item. Empty table: no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wardline.llm.common import map_batches, stored

LEAST_DOCUMENTS, TOP = 10, 10
#: A task spills its stripes at this many cells or documents; so many pairs of sources are summed at a time.
MOST_CELLS, MOST_DOCUMENTS, MOST_PAIRS = 1_000_000, 1 << 22, 1 << 20
_ONE = 1 << 40  # a cell holds documents * _ONE + occurrences
_TERMS = bytes(
    byte + 32 if 0x41 <= byte <= 0x5A else byte if 0x61 <= byte <= 0x7A or byte >= 0x80 else 0x20 for byte in range(256)
)


def terms_of(text: str) -> list[bytes]:
    """All terms, in order, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TERMS).split(b" ") if text else []


def fold_stripes(docs: DataFrame) -> DataFrame:
    """(lang, source, term, documents, count), cells of the tasks' stripes; a group's documents have a null term."""
    text, lang, source = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source"))
    layout = pa.schema([
        ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("documents", pa.int64()), ("count", pa.int64()),
    ])

    def rows(lang: str, terms: list[bytes], sizes: list[int], sources: list[str], cells: list[int]) -> pa.RecordBatch:
        words = pa.array([term.decode("utf-8", "replace") for term in terms], pa.string())
        packed = np.asarray(cells, np.int64)
        return pa.record_batch([
            pa.repeat(pa.scalar(lang, pa.string()), len(cells)), pa.array(sources, pa.string()),
            words.take(pa.array(np.repeat(np.arange(len(terms)), sizes))), pa.array(packed // _ONE), pa.array(packed % _ONE),
        ], schema=layout)

    def spill(stripes: dict[str, dict[bytes, dict[str, int]]]) -> Iterator[pa.RecordBatch]:
        for lang, of_lang in stripes.items():
            terms, sizes, sources, cells = [], [], [], []
            for term, stripe in of_lang.items():
                terms.append(term)
                sizes.append(len(stripe))
                sources.extend(stripe)
                cells.extend(stripe.values())
                if len(cells) > 20_000:
                    yield rows(lang, terms, sizes, sources, cells)
                    terms, sizes, sources, cells = [], [], [], []
            if cells:
                yield rows(lang, terms, sizes, sources, cells)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes: dict[str, dict[bytes, dict[str, int]]] = {}
        groups: Counter = Counter()
        held = documents = 0
        for batch in batches:
            for text, lang, source in zip(*(column.to_pylist() for column in batch.columns)):
                groups[lang, source] += 1
                documents += 1
                counts = Counter(terms_of(text))
                counts.pop(b"", None)
                of_lang = stripes.setdefault(lang, {})
                for term, count in counts.items():
                    stripe = of_lang.get(term)
                    if stripe is None:
                        of_lang[term] = {source: _ONE + count}
                        held += 1
                    elif source in stripe:
                        stripe[source] += _ONE + count
                    else:
                        stripe[source] = _ONE + count
                        held += 1
                if held >= MOST_CELLS or documents >= MOST_DOCUMENTS:
                    yield from spill(stripes)
                    stripes, held, documents = {}, 0, 0
        yield from spill(stripes)
        if groups:
            made = [(lang, source, None, n, 0) for (lang, source), n in groups.items()]
            yield pa.record_batch([list(column) for column in zip(*made)], schema=layout)

    return map_batches(docs.select(text, lang, source), fold, "lang string, source string, term string, documents long, count long")


def _smoothed(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(1e9 * (count + 2) / (n + 2 * v)); null where v is 0. Decimals, so that no count is too large."""
    above = (count + 2).cast("decimal(20,0)") * F.lit(1_000_000_000).cast("decimal(10,0)")
    return F.when(v > 0, F.call_function("div", above, (n + 2 * v).cast("decimal(20,0)")) + 1)


def _diverged(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _between(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shared(stripes: DataFrame) -> DataFrame:
    """(lang, a, b, value): over the terms that sources numbered a < b share, how far their divergence departs from what
    the histograms of both account for. Summed over some pairs at a time, however many sources a stripe has."""
    layout = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = batch.column(1)
            number, p, without = (cells.flatten().field(i).to_numpy(zero_copy_only=False) for i in range(3))
            sizes = cells.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            names = batch.column(0).dictionary_encode()
            lang = np.repeat(names.indices.to_numpy(zero_copy_only=False).astype(np.int64), sizes)
            # each cell meets the cells of its stripe
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            sizes = np.repeat(sizes, sizes)
            named, short = np.unique(np.stack([lang, number]), axis=1, return_inverse=True)
            at, ends = 0, np.cumsum(sizes)
            while at < len(sizes):
                end = max(at + 1, int(np.searchsorted(ends, ends[at] - sizes[at] + MOST_PAIRS, side="right")))
                many = sizes[at:end]
                one = np.repeat(np.arange(at, end), many)
                two = np.arange(len(one)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first[at:end], many)
                rising = number[one] < number[two]
                one, two = one[rising], two[rising]
                value = (
                    _between(p[one], p[two]) - _between(p[one], without[two]) - _between(without[one], p[two]) + _between(without[one], without[two])
                )
                pairs, which = np.unique(short[one] * named.shape[1] + short[two], return_inverse=True)
                low, high = value & 0xFFFFFF, value >> 24  # sums of doubles are exact in halves
                total = np.bincount(which, low).astype(np.int64) + (np.bincount(which, high).astype(np.int64) << 24)
                a, b = pairs // named.shape[1], pairs % named.shape[1]
                yield pa.record_batch([
                    names.dictionary.take(pa.array(named[0, a])), pa.array(named[1, a]), pa.array(named[1, b]), pa.array(total),
                ], schema=layout)
                at = end

    return map_batches(stripes, fold, "lang string, a long, b long, value long")


def source_divergence(docs: DataFrame, least: int = LEAST_DOCUMENTS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): parts ``pair`` (other sources) and ``term`` (the ``top`` words of a source)."""
    cells = fold_stripes(docs).groupBy("lang", "source", "term").agg(F.sum("documents").alias("documents"), F.sum("count").alias("count"))
    cells = stored(cells, "cells")
    cell = F.struct("source", "count")
    stripes = cells.where("term is not null").groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("count").alias("of_lang"), F.collect_list(cell).alias("stripe")
    ).where(F.col("documents") >= least)
    stripes = stored(stripes.select("lang", "term", "of_lang", "stripe"), "stripes")

    kept = stripes.select("lang", "term", "of_lang", F.inline("stripe"))
    in_source = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    in_lang = stripes.groupBy("lang").agg(F.count("*").alias("v"), F.sum("of_lang").alias("n_lang"))
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long")
    groups = cells.where("term is null").select("lang", "source").join(in_source, ["lang", "source"], "left").join(in_lang, "lang", "left").select(
        "lang", "source", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("v", F.lit(0)).alias("v"),
        F.coalesce("n_lang", F.lit(0)).alias("n_lang"), number.alias("number"),
    )
    groups = stored(groups.withColumn("without", _smoothed(F.lit(0), F.col("n"), F.col("v"))), "groups")

    entries = stored(kept.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "number", "without", _smoothed(F.col("count"), F.col("n"), F.col("v")).alias("p"),
        _smoothed(F.col("of_lang"), F.col("n_lang"), F.col("v")).alias("q"),
    ), "entries")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = entries.where("p > q").select("lang", "source", F.col("term").alias("item"), _diverged(F.col("p"), F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    together = entries.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "p", "without")).alias("cells")).where(F.size("cells") > 1)
    shared = _shared(together.select("lang", "cells"))
    other = groups.select(F.col("lang").alias("lang_b"), F.col("number").alias("b"), F.col("without").alias("without_b"))
    beside = (F.col("lang") == F.col("lang_b")) & (F.col("a") != F.col("b"))
    histogram = entries.groupBy("lang", F.col("number").alias("a"), "p", "without").agg(F.count("*").alias("terms"))
    gained = F.col("terms") * (_diverged(F.col("p"), F.col("without_b")) - _diverged(F.col("without"), F.col("without_b")))
    one_sided = histogram.join(other, beside).groupBy("lang", "a", "b").agg(F.sum(gained).alias("value"))
    parts = shared.union(one_sided)
    parts = parts.union(parts.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    parts = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("more"))
    # a row per pair of sources is the result that is asked for; no document or term is paired
    named = groups.select("lang", F.col("number").alias("a"), "source", "v", "without")
    others = other.join(groups.select(F.col("lang").alias("lang_b"), F.col("number").alias("b"), F.col("source").alias("item")), ["lang_b", "b"])
    pairs = named.join(others, beside).join(parts, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("v") * _diverged(F.col("without"), F.col("without_b")), F.lit(0)) + F.coalesce("more", F.lit(0))
    pairs = pairs.select("lang", "source", "item", value.alias("value")).withColumn("rank", F.row_number().over(by_value))
    ranked = lambda rows, part: rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    return ranked(pairs, "pair").union(ranked(terms, "term"))
