import hashlib
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from wardline.llm.byte_bpe import ByteBpe, encode_documents, read_ranks
from wardline.llm.pieces import PartEncoder
from wardline.llm.queries import QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
ALPHABET = " \n\t\x0b\r\x85\xa0 \x1c's  tveab1²é漢😀_-.,!<|endoftext|>​"


@pytest.fixture(scope="module")
def codec():
    return ByteBpe(read_ranks(PATH), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(PATH), special_tokens={})


def ids(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_ids_are_those_of_the_library(codec, library):
    random.seed(1)
    texts = ["".join(random.choice(ALPHABET) for _ in range(random.randrange(60))) for _ in range(3_000)]
    texts += ["", " ", "  ", "a " * 10, "abc" * 400, "ab" * 2_000 + " " * 50 + "x", "é" * 700, "\n\n a \n b"]
    found = list(PartEncoder(codec.encode_many).encode(texts))
    assert [ids(p) for p in found] == [library.encode_ordinary(t) for t in texts]
    assert [codec.decode(p) for p in found] == [t.encode() for t in texts]


def test_long_and_short_pieces_merge_alike(codec):
    random.seed(2)
    pieces = [bytes(random.choice(b"abcdeinst") for _ in range(random.randrange(2, 120))) for _ in range(300)]
    assert codec._merge_short(pieces, 128) == [codec._merge_long(piece) for piece in pieces]


@pytest.mark.parametrize("n", [129, 255, 256, 257, 1_000, 131_073])
def test_long_pieces_of_any_length(codec, library, n):
    random.seed(n)
    text = "".join(random.choice("abcdeinst") for _ in range(n))
    assert ids(codec._merge_long(text.encode())) == library.encode_ordinary(text)


def test_memory_of_a_long_piece_is_a_few_bytes_a_byte(codec):
    random.seed(3)
    piece = bytes(random.choices(b"abcdeinst", k=40_000))
    tracemalloc.start()
    packed = codec._merge_long(piece)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert codec.decode(packed) == piece
    assert peak < 50 * len(piece)


def test_awkward_documents(awkward, awkward_rows, library):
    found = sorted(map(tuple, encode_documents(awkward, PATH, public_tokenizers.PATTERN).collect()), key=str)
    expected = []
    for doc_id, text in awkward_rows:
        tokens = library.encode_ordinary(text or "")
        digest = hashlib.sha256(np.asarray(tokens, "<u4").tobytes()).hexdigest()
        expected.append((doc_id, len(tokens), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert found == sorted(expected, key=str)
    assert encode_documents(awkward.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_ids_column_and_query(spark, sf_dir, frame, library):
    row = encode_documents(frame([(1, "Hello world")]), PATH, public_tokenizers.PATTERN, keep_ids=True).first()
    assert row.ids == library.encode_ordinary("Hello world")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in QUERIES["op2_byte_bpe"](spark, sf_dir).collect():
        assert r.ids_sha256 == hashlib.sha256(np.asarray(library.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
