import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from wardline.llm.packing import PackingPlan, _encoder, pack_documents
from wardline.llm.pieces import NumberedParts
from wardline.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")


TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]


def test_every_token_is_what_its_bytes_are_merged_into():
    """Why both libraries come to the same ids; tokens that are no text of their own cannot be asked for."""
    vocabulary = TOKENIZER.get_vocab()
    texts = {number: TOKENIZER.decode([number], skip_special_tokens=False) for number in vocabulary.values()}
    asked = {number: text for number, text in texts.items() if "\ufffd" not in text}
    assert len(asked) > 49_000
    found = TOKENIZER.encode_batch_fast(list(asked.values()), add_special_tokens=False)
    assert [encoding.ids for encoding in found] == [[number] for number in asked]


def test_parts_get_the_ids_of_the_library():
    random.seed(8)
    letters = "abcdefghijklmnopqrstuvwxyzABCXYZ0123456789.,;:!?'\"-_/()<>|\u00e9\u00fc\u00df\u00f7\u00d7\u00aa\u00b2\u0131\u6f22\U0001f600\t\n\u00a0\u2003 "
    encoder = _encoder(PATH)
    texts = ["".join(random.choice(letters) for _ in range(random.randrange(80))) for _ in range(4_000)]
    texts += ["it's I'll 'd 's' don't", "x" * 3_000, " ", "  a", "a  ", "\n \n", "<|endoftext|", " <|endoftext|> a"]
    for _ in range(2):  # the second time from the table
        assert [ids.tolist() for ids in encoder.encode(texts)] == [ids_of(text)[:-1] for text in texts]


def test_table_begun_anew(monkeypatch):
    monkeypatch.setattr(NumberedParts, "MOST_KEPT", 3)
    texts = ["a b c d e", "b c x y z", "a b c d e", "q"]
    assert [ids.tolist() for text in texts for ids in _encoder(PATH).encode([text])] == [ids_of(text)[:-1] for text in texts]


def fewest(lengths, capacity):
    """Sequences of an exhaustive packing."""
    best = len(lengths)

    def place(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for gap in {*gaps} - {g for g in gaps if g < lengths[i]}:
            rest = list(gaps)
            rest[rest.index(gap)] -= lengths[i]
            place(i + 1, rest)
        place(i + 1, [*gaps, capacity - lengths[i]])

    place(0, [])
    return best


def test_against_exhaustive_packing():
    random.seed(12)
    total = least = 0
    for _ in range(300):
        lengths = sorted((random.randint(1, 30) for _ in range(random.randrange(1, 10))), reverse=True)
        plan = PackingPlan({x: lengths.count(x) for x in lengths}, 30)
        best = fewest(lengths, 30)
        assert best <= plan.sequences <= best + 1
        total, least = total + plan.sequences, least + best
    assert total <= 1.03 * least


def check_layout(places, capacity):
    """Sequences are filled without gap and never beyond their capacity."""
    by_sequence = {}
    for sequence, offset, length in places:
        by_sequence.setdefault(sequence, []).append((offset, length))
    for items in by_sequence.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


@pytest.mark.parametrize("capacity,n,seed", [(2048, 5_000, 1), (2048, 40, 2), (10, 700, 3), (7, 300, 4), (1, 5, 5), (3, 50, 6)])
def test_plan(capacity, n, seed):
    random.seed(seed)
    lengths = [random.randint(1, capacity) if random.random() < 0.7 else min(capacity, capacity // 3 + 1) for _ in range(n)]
    counts, numbers = {}, []
    for length in lengths:
        numbers.append(counts.get(length, 0))
        counts[length] = counts.get(length, 0) + 1
    plan = PackingPlan(counts, capacity)
    sequence, offset = plan.places(np.asarray(lengths), np.asarray(numbers))
    used = check_layout(zip(sequence.tolist(), offset.tolist(), lengths), capacity)
    large = sorted((x for x in lengths if 2 * x > capacity), reverse=True)
    assert used >= max(-(-sum(lengths) // capacity), len(large))
    assert used <= 1.3 * max(-(-sum(lengths) // capacity), len(large)) + 2


def test_at_most_two_large_pieces_in_a_sequence():
    plan = PackingPlan({700: 9, 900: 4, 1200: 3, 30: 5}, 2048)
    placed = {}
    for length, count in ((700, 9), (900, 4), (1200, 3)):
        for sequence in plan.places(np.full(count, length), np.arange(count))[0].tolist():
            placed[sequence] = placed.get(sequence, 0) + 1
    assert max(placed.values()) == 2 and len(placed) == 8


def test_awkward_documents(awkward, awkward_rows):
    rows = pack_documents(awkward, PATH, capacity=64).collect()
    check_layout([(r.sequence_id, r.offset, r.length) for r in rows], 64)
    found = sorted(((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows))
    expected = []
    for doc_id, text in awkward_rows:
        ids = np.asarray(ids_of(text), "<u4")
        cuts = [0, *range(len(ids) % 64 or 64, len(ids) + 1, 64)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            expected.append((doc_id is None, doc_id or 0, piece, a, b - a, zlib.crc32(ids[a:b].tobytes())))
    assert found == sorted(expected)
    assert pack_documents(awkward.limit(0), PATH).count() == 0


def test_query(spark, sf_dir):
    rows = QUERIES["op4_packing"](spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    used = check_layout([(r.sequence_id, r.offset, r.length) for r in rows], 2048)
    assert sum(r.length for r in rows) == sum(len(ids_of(t)) for t in texts.values())
    assert used <= 1.1 * -(-sum(r.length for r in rows) // 2048) + 2


def test_added_tokens_are_what_the_library_makes_of_them(frame):
    token = "<|endoftext|>"
    texts = [
        f"x{token}y", token, f" {token}", f"a {token} b", f"a  {token}  b c", f"a\n {token}\n c", f"{token}{token} {token}", "plain words", " b\n", f"{token[:-1]} c",
    ]
    tokenizer = Tokenizer.from_file(PATH)
    expected = []
    for i, text in enumerate(texts):
        ids = np.asarray([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        expected.append((i, len(ids), zlib.crc32(ids.tobytes())))
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [87, 50256, 88]
    found = pack_documents(frame(list(enumerate(texts))), PATH).collect()
    assert sorted((r.doc_id, r.length, r.ids_crc32) for r in found) == expected
