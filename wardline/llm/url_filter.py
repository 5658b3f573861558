"""URL filters: rules first, then a multinomial naive Bayes over segmented host words and path tokens.

Host names are often words run together. Each distinct part of a host is split by the most likely way (Viterbi over
unigram counts of all words of the pages); only the counts of words that occur inside that part are joined to it, so no
vocabulary is broadcast or cut. Naive Bayes learns from the urls that a rule decides and judges the others. Its tokens
are hashed to a fixed number of slots, so the model has the same size for any input.

A url without ``://`` or a null url has empty host and path and is judged by the prior of the classes alone. Without
decided urls of both classes everything else is allowed. Repeated rows and null ids each give their row.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import map_batches, stored

#: (host, path, verdict)
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
SLOTS = 1 << 16
#: Longer words are looked up by their first so many letters; longer splits are tried only for words that are known.
LONGEST_WORD = 24
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def parse(pages: DataFrame) -> DataFrame:
    """(page_id, host, path)."""
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    host = F.translate(F.regexp_extract(url, _URL, 1), string.ascii_uppercase, string.ascii_lowercase)
    return pages.select("page_id", host.alias("host"), F.regexp_extract(url, _URL, 2).alias("path"))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; of equal length the one with the longer host."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule_host, rule_path, decided in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        rule = F.when(fits, rule_host + rule_path).otherwise(rule)
        verdict = F.when(fits, decided).otherwise(verdict)
    return rule, verdict


def word_counts(texts: DataFrame, column: str) -> DataFrame:
    """(word, n) over the whole texts, without markup; words of a to z as they could stand in a host."""
    plain = F.regexp_replace(F.coalesce(F.col(column).cast("string"), F.lit("")), "<[^>]*>", " ")
    words = F.regexp_extract_all(F.lower(plain), F.lit("[a-z]+"), F.lit(0))
    return texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, counts: dict[str, int], total: int) -> list[str]:
    """The most likely split of ``label``; of equal ones the one with the longer last word."""
    best, back = [0.0] + [-math.inf] * len(label), [0] * (len(label) + 1)
    longer = sorted({len(word) for word in counts if len(word) > LONGEST_WORD}, reverse=True)
    for end in range(1, len(label) + 1):
        known = [end - length for length in longer if length <= end and label[end - length : end] in counts]
        for start in [*known, *range(max(0, end - LONGEST_WORD), end)]:
            word = label[start:end]
            n = counts.get(word)
            cost = math.log(n / total) if n else -math.log(total) - 2.3 * (len(word) + 1)
            if best[start] + cost > best[end]:
                best[end], back[end] = best[start] + cost, start
    words, end = [], len(label)
    while end:
        words.append(label[back[end] : end])
        end = back[end]
    return words[::-1]


def segment(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words) for distinct labels; digits and other signs stay together as they are."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] + 1
    n = F.length("label")
    starts = F.sequence(F.lit(1), n)
    inside = F.flatten(F.transform(starts, lambda s: F.transform(
        F.sequence(s, F.least(s + LONGEST_WORD - 1, n)), lambda e: F.substring("label", s, e - s + 1)
    )))
    parts = labels.where(n > 0).select("label", F.explode(F.array_distinct(inside)).alias("word"))
    longer = counts.where(F.length("word") > LONGEST_WORD).select(
        F.substring("word", 1, LONGEST_WORD).alias("start"), F.col("word").alias("whole"), "n"
    )
    starts_of = parts.where(F.length("word") == LONGEST_WORD)
    whole = starts_of.join(longer, (F.col("word") == F.col("start")) & F.contains("label", "whole")).select("label", F.col("whole").alias("word"), "n")
    known = parts.join(counts, "word").select("label", "word", "n").unionByName(whole).groupBy("label").agg(F.collect_list(F.struct("word", "n")).alias("known"))
    layout = pa.schema([("label", pa.string()), ("words", pa.list_(pa.string()))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for label, known_words in zip(*(column.to_pylist() for column in batch.columns)):
                found.append(viterbi(label, {k["word"]: k["n"] for k in known_words or []}, total))
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.string()))], schema=layout)

    return map_batches(labels.join(known, "label", "left"), split, "label string, words array<string>")


def _slots(words: Column) -> Column:
    return F.transform(words, lambda word: F.pmod(F.xxhash64(word), F.lit(SLOTS)).cast("int"))


def path_words(path: Column) -> Column:
    """Letters and digits of the path; numbers all count as one token."""
    tokens = F.regexp_extract_all(F.lower(path), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(tokens, lambda t: F.concat(F.lit("/"), F.when(t.rlike("^[0-9]+$"), "0").otherwise(t)))


def filter_urls(pages: DataFrame, words: DataFrame, rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score); score is the log-odds of block where the method decided."""
    spark = pages.sparkSession
    rule, decided = rule_of(F.col("host"), F.col("path"), rules)
    parsed = stored(parse(pages).select("*", rule.alias("rule"), decided.alias("decided")), "urls")
    count = lambda verdict: F.count(F.when(F.col("decided") == verdict, 1))
    hosts = parsed.groupBy("host").agg(count("block").alias("block"), count("allow").alias("allow"))
    labels = hosts.select("host", F.posexplode(F.split("host", r"[.\-]")).alias("at", "label"))
    segmented = segment(labels.select("label").distinct(), words)
    host_words = stored(
        labels.join(segmented, "label").groupBy("host").agg(_slots(F.flatten(F.collect_list("words"))).alias("slots"))
        .join(hosts, "host", "right"), "hosts",
    )
    of_hosts = host_words.where("block + allow > 0").select(F.explode("slots").alias("slot"), "block", "allow")
    path_slots = parsed.where(F.col("decided").isNotNull()).select("decided", F.explode(_slots(path_words(F.col("path")))).alias("slot"))
    of_paths = path_slots.groupBy("slot").agg(count("block").alias("block"), count("allow").alias("allow"))
    seen = of_hosts.unionByName(of_paths).groupBy("slot").agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"))
    table = np.ones((2, SLOTS))
    for row in seen.collect():  # SLOTS rows at most
        table[:, row["slot"]] += row["block"], row["allow"]
    urls = hosts.agg(F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
    learnt = min(urls) > 0
    odds = np.log(table[0] / table[0].sum()) - np.log(table[1] / table[1].sum())
    prior = math.log(urls[0] / urls[1]) if learnt else -1.0
    model = spark.sparkContext.broadcast(odds if learnt else np.zeros(SLOTS))

    @F.arrow_udf("double")
    def score(slots: pa.Array) -> pa.Array:
        return pa.array([float(model.value[np.asarray(s or [], np.int64)].sum()) for s in slots.to_pylist()], pa.float64())

    by_host = host_words.select(F.col("host").alias("of"), score("slots").alias("host_score"))
    judged = parsed.join(by_host, F.col("host") == F.col("of"), "left")
    total = F.lit(prior) + F.coalesce(F.col("host_score"), F.lit(0.0)) + score(_slots(path_words(F.col("path"))))
    judged = judged.select("page_id", "host", "path", "rule", "decided", F.when(F.col("decided").isNull(), total).alias("score"))
    return judged.select(
        "page_id", "host", "path", "rule",
        F.coalesce("decided", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "score",
    )
