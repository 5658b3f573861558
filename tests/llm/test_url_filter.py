import itertools
import math
import random
import re

from wardline.llm.queries import QUERIES
from wardline.llm.url_filter import RULES, filter_urls, segment, viterbi, word_counts


def brute(url):
    host = path = ""
    if url is not None and "://" in url:
        host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule_host, rule_path, verdict in RULES:
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(rule_path):
            if best is None or len(rule_host + rule_path) > len(best[0]):
                best = rule_host + rule_path, verdict
    return host, path, best


def test_query(spark, sf_dir):
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = QUERIES["op1_url_filter"](spark, sf_dir).collect()
    assert len(rows) == len(urls)
    for r in rows:
        host, path, rule = brute(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule[0] if rule else None)
        assert r.verdict == rule[1] if rule else r.verdict in ("allow", "block")


def test_awkward_urls(spark):
    urls = [
        None, "", "nohost", "://", "http://A.NET", "HTTP://B.net/x", "ftp://u@thethinking.example.com:80/de/x?y", "http://x.org/fr/://z", "http://É.net/", "http://net/",
        "http://xnet/", "http://example.net/en/", "http://example.net/en", "http://a.example.com?/de/", "http://org/fr/\n", "http://a.b/" + "x" * 50_000, "http://a.net#/",
    ]
    rows = [(i if i % 3 else None, u, "the thin king", "h", "d") for i, u in enumerate(urls)] + [(1, urls[5], None, "h", "d")] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, decided string")
    found = filter_urls(pages, word_counts(pages, "html")).collect()
    assert len(found) == len(rows)
    expected = [(i, *brute(u)) for i, u, *_ in rows]
    got = sorted((str(r.page_id), r.host, r.path, r.rule or "") for r in found)
    assert got == sorted((str(i), h, p, rule[0] if rule else "") for i, h, p, rule in expected)
    assert all(r.verdict in ("allow", "block") for r in found)
    assert filter_urls(pages.limit(0), word_counts(pages.limit(0), "html")).count() == 0


def test_method_learns_from_decided_urls(spark):
    random.seed(2)
    words = ["cheap", "pills", "garden", "poems"]
    rows = [(i, f"http://{a}{b}{i}.net/x", "cheap pills garden poems") for i, (a, b) in enumerate([("cheap", "pills"), ("pills", "cheap")] * 20)]
    rows += [(100 + i, f"http://{a}{b}{i}.org/fr/x", "cheap pills garden poems") for i, (a, b) in enumerate([("garden", "poems"), ("poems", "garden")] * 20)]
    rows += [(200, "http://cheapcheap.info/x", ""), (201, "http://gardengarden.info/x", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    verdict = {r.page_id: r.verdict for r in filter_urls(pages, word_counts(pages, "html")).collect()}
    assert (verdict[200], verdict[201]) == ("block", "allow") and words


def test_viterbi_is_the_best_split(spark):
    counts = {"the": 10, "thin": 5, "king": 3, "think": 1, "thinking": 2, "in": 4, "g": 1}
    total = sum(counts.values()) + 1

    def cost(words):
        return sum(math.log(counts[w] / total) if w in counts else -math.log(total) - 2.3 * (len(w) + 1) for w in words)

    for label in ("thethinking", "king", "xthinx", "ggg"):
        splits = []
        for cuts in itertools.product([0, 1], repeat=len(label) - 1):
            at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(label)]
            splits.append([label[a:b] for a, b in zip(at, at[1:])])
        assert math.isclose(cost(viterbi(label, counts, total)), max(map(cost, splits)))
    assert viterbi("", counts, total) == []
    labels = spark.createDataFrame([("thethinking",), ("",), ("é漢",)], "label string")
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    found = {r.label: r.words for r in segment(labels, table).collect()}
    assert found["thethinking"] == viterbi("thethinking", counts, total) and found[""] == [] and "".join(found["é漢"]) == "é漢"


def test_words_of_any_length_are_known(spark):
    word = "donaudampfschifffahrtsgesellschaft"
    pages = spark.createDataFrame([(1, None, f"<p>{word} the {word}</p>")], "page_id long, url string, html string")
    counts = word_counts(pages, "html")
    assert {r.word: r.n for r in counts.collect()} == {word: 2, "the": 1}
    labels = spark.createDataFrame([(word,), (f"the{word}the",), (word[:-1],)], "label string")
    found = {r.label: r.words for r in segment(labels, counts).collect()}
    assert found[word] == [word] and found[f"the{word}the"] == ["the", word, "the"] and len(found[word[:-1]]) > 1
