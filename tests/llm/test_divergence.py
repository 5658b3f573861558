import random
import re
from collections import Counter, defaultdict

import pytest

from wardline.llm import divergence
from wardline.llm.divergence import source_divergence, terms_of
from wardline.llm.queries import QUERIES

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=10, top=10):
    counts, having = defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = TERM.findall(lower(text or ""))
        counts[lang, source].update(words)
        having[lang].update(set(words))
        sources[lang].add(source)
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang, names in sources.items():
        kept = sorted(t for t, n in having[lang].items() if n >= least)
        v = len(kept)

        def shares(of):
            n = sum(of[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (of[t] + 2) // (n + 2 * v) for t in kept}

        p = {s: shares(counts[lang, s]) for s in names}
        q = shares(sum((counts[lang, s] for s in names), Counter()))
        for s in names:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in names if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[lang, s][t] > 0 and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(found, 1) if part == "pair" or k <= top]
    return sorted(out)


def table(spark, rows):
    clash = ["term", "count", "documents", "Number", "p", "q", "cells", "a", "b", "value"]
    schema = "text string, lang string, source string, " + ", ".join(f"`{name}` string" for name in clash)
    return spark.createDataFrame([(*row, *["q"] * len(clash)) for row in rows], schema)


def mixed(n=400, seed=1):
    random.seed(seed)
    words = [f"{c}{d}" for c in ("Wort", "été", "漢", "ſtK", "x") for d in "abcdefghij"]
    rows = []
    for _ in range(n):
        lang = random.choice(["en", "de", None, ""])
        source = random.choice(["s1", "s2", "s2", "s2", "s10", None, "", "é"])
        some = words[: 10 + 5 * len(source or "")]
        rows.append((" ".join(random.choice(some) for _ in range(random.randrange(30))) + random.choice(["", ". 99 x_y-z", "\x00\x7f"]), lang, source))
    return rows + [(None, "en", "s1"), ("", "fr", "only"), ("kept nowhere", "it", "a"), ("kept nowhere", "it", "b"), (None, None, None)] + rows[:5]


def found(df, *arguments):
    return sorted(map(tuple, source_divergence(df, *arguments).collect()))


@pytest.mark.parametrize("text", ["", "a", "Aé1B_c", "  x\ty ", "ÀÉ ſK \x00\x7f@[`{", "漢字,Kana"])
def test_terms(text):
    assert [t.decode() for t in terms_of(text) if t] == TERM.findall(lower(text))


def test_mixed_groups(spark):
    rows = mixed()
    assert found(table(spark, rows)) == brute(rows)
    assert found(table(spark, rows), 1, 3) == brute(rows, 1, 3)


@pytest.mark.parametrize("cells,documents,pairs", [(20, 1 << 22, 3), (1 << 20, 7, 1)])
def test_spills(spark, monkeypatch, cells, documents, pairs):
    """Stripes spilled many times over, sums over a few pairs of sources at a time."""
    monkeypatch.setattr(divergence, "MOST_CELLS", cells)
    monkeypatch.setattr(divergence, "MOST_DOCUMENTS", documents)
    monkeypatch.setattr(divergence, "MOST_PAIRS", pairs)
    rows = mixed(150, 2)
    assert found(table(spark, rows), 3) == brute(rows, 3)


def test_empty_and_long(spark):
    assert found(table(spark, [])) == []
    assert found(table(spark, [(None, None, None)])) == []
    rows = [("long " * 200_000 + "word", "en", "a"), ("a" * 100_000, "en", "b"), ("word", "en", "c")]
    assert found(table(spark, rows), 1) == brute(rows, 1)


def test_counts_beyond_64_bits(spark):
    """The share of a count whose product with 1e9 is no long."""
    count, n, v = 3 * 10**12, 10**13, 7
    made = spark.createDataFrame([(count, n, v)], "c long, n long, v long")
    got = made.select(divergence._smoothed(made.c, made.n, made.v)).collect()[0][0]
    assert got == 1 + 1_000_000_000 * (count + 2) // (n + 2 * v)


def test_query(spark, sf_dir):
    rows = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op12_source_divergence"](spark, sf_dir).collect())) == brute(rows)
