import math
import random
import re
import zlib

import numpy as np
import pytest

from wardline.llm.linear import SLOTS, training_rows
from wardline.llm.quality import fit_quality, good_documents, score_quality, slots_of
from wardline.llm.queries import QUERIES
from wardline.llm.toxicity import fit_toxicity, offending_spans, score_toxicity, sentences_of

WORDS = ["the", "river", "runs", "past", "old", "mills", "and", "green", "hills", "where", "people", "walk", "home", "late"]


def made(n, seed):
    """Documents whose first label follows from shouting and whose second from one of two words, with their labels."""
    random.seed(seed)
    docs, labels = [], []
    for i in range(n):
        sentences = [[random.choice(WORDS) for _ in range(8)] for _ in range(random.randrange(2, 9))]
        toxic, good = random.random() < 0.3, random.random() < 0.7
        if toxic:
            random.choice(sentences)[3] = random.choice(["blast", "rotten"])
        text = ". ".join(" ".join(s) for s in sentences) + "."
        docs.append((i, text if good else text.upper().replace(" ", "!! ")))
        labels.append((i, int(good), int(toxic)))
    return docs, labels


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def tables(spark, frame):
    docs, labels = made(500, 3)
    return docs, labels, frame(docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("score,at,threshold", [(score_quality, 1, 0.7), (score_toxicity, 2, 0.3)])
def test_held_out_accuracy(tables, score, at, threshold):
    docs, labels, frame_, labelled = tables
    truth = {row[0]: row[at] for row in labels}
    rows = score(frame_, labelled).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
    out = [r.predicted == truth[r.doc_id] for r in rows if r.held_out]
    assert np.mean(out) > 0.93


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_held_out_labels_change_nothing(tables, spark, score):
    _, labels, frame_, labelled = tables
    flipped = [(i, 1 - q, 1 - t) if held(i) else (i, q, t) for i, q, t in labels]
    other = score(frame_, spark.createDataFrame(flipped, "doc_id long, quality int, toxic int"))
    assert sorted((r.doc_id, r.score) for r in other.collect()) == sorted((r.doc_id, r.score) for r in score(frame_, labelled).collect())


@pytest.mark.parametrize("score", [score_quality, score_toxicity])
def test_awkward_documents(awkward, awkward_rows, tables, spark, score):
    rows = score(awkward, tables[3]).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((i for i, _ in awkward_rows), key=str)
    assert all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert score(awkward, none).count() == len(awkward_rows)
    odd = spark.createDataFrame([(None, 1, 1), (1, None, None), (5, 7, 7), (5, 1, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert score(awkward, odd).count() == len(awkward_rows)
    assert score(awkward.limit(0), tables[3]).count() == 0


def test_good_documents_keep_their_columns(tables):
    docs, labels, frame_, labelled = tables
    kept = good_documents(frame_, frame_, labelled)
    assert kept.columns == frame_.columns
    truth = {i: q for i, q, _ in labels}
    ids = {r.doc_id for r in kept.collect()}
    assert sum(i in ids for i, q in truth.items() if q) >= 0.97 * sum(truth.values())
    assert sum(i in ids for i, q in truth.items() if not q) <= 0.05 * len(truth)


def test_offending_sentences(tables):
    docs, labels, frame_, labelled = tables
    weights = fit_toxicity(frame_, labelled)
    texts = dict(docs)
    rows = [r for r in score_toxicity(frame_, labelled).collect() if r.predicted]
    right = [any(w in texts[r.doc_id][s.start : s.end].lower() for w in ("blast", "rotten")) for r in rows for s in r.offending]
    assert len(right) >= 50 and np.mean(right) > 0.9
    assert offending_spans(weights, "", 0.3) == []
    slots, starts = sentences_of("One two two. \n!? Three")
    assert len(slots) == 12 and starts.tolist() == [0, 8]


def test_model_is_the_same_each_time(tables):
    _, _, frame_, labelled = tables
    assert np.array_equal(fit_quality(frame_, labelled), fit_quality(frame_.repartition(7), labelled))
    assert len(slots_of("a b c")) == 10 and len(slots_of("")) == 0


def test_queries(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    for name in ("op8_quality", "op10_toxicity"):
        rows = QUERIES[name](spark, sf_dir).collect()
        assert len(rows) == n and all(r.held_out == held(r.doc_id) for r in rows)


def slot(text):
    return 1 + zlib.crc32(text.encode()) % (SLOTS - 1)


def pair(left, right):
    h = (left * 0x9E3779B97F4A7C15 & 2**64 - 1) ^ (right * 0xC2B2AE3D27D4EB4F & 2**64 - 1)
    h ^= h >> 29
    h = h * 0xBF58476D1CE4E5B9 & 2**64 - 1
    return 1 + (h >> 32) % (SLOTS - 1)


def logistic(x):
    return 1 / (1 + math.exp(-max(-40.0, min(40.0, x))))


class PlainFtrl:
    """The updates one number at a time."""

    def __init__(self, rate, l1, l2, constant):
        self.rate, self.l1, self.l2, self.constant, self.z, self.n = rate, l1, l2, constant, {}, {}

    def weight(self, k):
        z, l1 = self.z.get(k, 0.0), 0.0 if k == 0 else self.l1
        w = 0.0 if abs(z) <= l1 else (math.copysign(l1, z) - z) / ((1 + math.sqrt(self.n.get(k, 0.0))) / self.rate + self.l2)
        return w + (self.constant if k == 0 else 0.0)

    def update(self, k, w, g):
        old = self.n.get(k, 0.0)
        own = w - (self.constant if k == 0 else 0.0)
        self.z[k] = self.z.get(k, 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / self.rate * own
        self.n[k] = old + g * g


def in_order(docs, labels, at):
    """Training rows as the one task takes them; all are taken where there are fewer than the bound."""
    truth = {row[0]: row[at] for row in labels}
    rows = [(i, text) for i, text in docs if not held(i)]
    return [(truth[i], text) for i, text in sorted(rows, key=lambda r: (r[0] * 2_654_435_761 % 2**32, r[0]))]


def plain_quality(text):
    words = text.split()
    letters, forms = [], []
    for word in words:
        kept = "".join(re.findall(r"[^\W_]+", word)).lower()
        case = "U" if len(kept) > 1 and word.isupper() else "T" if word[0].isupper() else "l"
        letters.append(slot("w" + kept))
        forms.append(slot(case + re.sub(r"[^\W_]+", "w", word)[:64]))
    grams = letters + forms
    for a, b in zip(letters, letters[1:]):
        grams.append(1 if a == b else pair(b, a))
    for a, b in zip(forms, forms[1:]):
        grams.append(pair(b + SLOTS, a))
    return grams


def test_quality_scores_recomputed(tables):
    docs, labels, frame_, labelled = tables
    rows = in_order(docs, labels, 1)
    positive = sum(y for y, _ in rows)
    rate = (positive + 1) / (len(rows) + 2)
    model = PlainFtrl(2.0, 1e-3, 1e-3, math.log(rate / (1 - rate)))
    features = []
    for y, text in rows:
        grams = plain_quality(text)
        values = {0: 1.0}
        for k in sorted(set(grams)):
            values[k] = float(np.float32(grams.count(k) / max(1, len(grams) / 4)))
        features.append((y, values))
    for _ in range(4):
        for y, values in features:
            weights = {k: model.weight(k) for k in values}
            error = logistic(sum(weights[k] * v for k, v in values.items())) - y
            for k, v in values.items():
                model.update(k, weights[k], error * v)
    f32 = lambda x: float(np.float32(x))
    scores = {r.doc_id: r.score for r in score_quality(frame_, labelled).collect()}
    for i, text in docs[:120]:
        grams = plain_quality(text)
        total = sum(f32(model.weight(k)) for k in grams)
        assert abs(scores[i] - logistic(f32(model.weight(0)) + 4 * total / max(4, len(grams)))) < 1e-6


def plain_sentences(text):
    found = []
    for sentence in re.split(r"[.!?\n]", text.lower()):
        tokens = {t.strip("_") for t in re.findall(r"\w+", sentence)}
        if tokens:
            found.append([slot(part) for w in sorted(tokens) for part in (w, "<" + w[:4], "<" + w[:5], w[-4:] + ">")])
    return found


def noisy_or(weights, sentences):
    clean = 1.0
    for slots_ in sentences:
        clean *= 1 - logistic(weights[0] + sum(weights[k] for k in slots_))
    return 1 - clean


def test_toxicity_scores_recomputed(tables):
    docs, labels, frame_, labelled = tables
    model = PlainFtrl(2.0, 3.0, 1e-3, -5.0)
    rows = [(y, plain_sentences(text)) for y, text in in_order(docs, labels, 2)]
    checked = 0
    for _ in range(8):
        for y, sentences in rows:
            weights = {k: model.weight(k) for k in {0, *(k for s in sentences for k in s)}}
            p = [logistic(weights[0] + sum(weights[k] for k in s)) for s in sentences]
            clean = math.prod(1 - x for x in p)
            share = [x * (-clean / (1 - clean) if y else 1.0) for x in p]
            gradient = dict.fromkeys(weights, 0.0)
            gradient[0] = sum(share)
            for s, part in zip(sentences, share):
                for k in s:
                    gradient[k] += part
            if checked < 5:  # against differences of the loss itself
                checked += 1
                loss = lambda w: -math.log(noisy_or(w, sentences) if y else 1 - noisy_or(w, sentences))
                for k in list(weights)[:12]:
                    up, down = {**weights, k: weights[k] + 1e-5}, {**weights, k: weights[k] - 1e-5}
                    assert abs((loss(up) - loss(down)) / 2e-5 - gradient[k]) < 1e-5
            for k, w in weights.items():
                model.update(k, w, gradient[k])
    weights = {k: float(np.float32(model.weight(k))) for k in {0, *model.z}}
    scores = {r.doc_id: r.score for r in score_toxicity(frame_, labelled).collect()}
    for i, text in docs[:120]:
        sentences = [[k for k in s if k in weights] for s in plain_sentences(text)]
        assert abs(scores[i] - noisy_or(weights, sentences)) < 1e-6


def test_many_rows_under_one_id_stay_bounded(spark, frame):
    free = [i for i in range(40) if not held(i)]
    labelled = spark.createDataFrame([(i, i % 2, 0) for i in free] + [(free[3], 1 - free[3] % 2, 0)], "doc_id long, quality int, toxic int")
    rows = spark.range(200_000).selectExpr(f"{free[0]}L as doc_id", "concat('text number ', id % 150000) as text").unionByName(
        spark.createDataFrame([(i, f"plain {i}") for i in free], "doc_id long, text string")
    )
    assert 0 < training_rows(rows, labelled, "quality", rows=100).count() < 300
    equal = frame([(free[1], "same text")] * 5_000 + [(free[2], "other"), (free[3], "both labels")])
    found = training_rows(equal, labelled, "quality").collect()
    assert sorted((r.doc_id, r.text) for r in found) == sorted([(free[1], "same text"), (free[2], "other")])
