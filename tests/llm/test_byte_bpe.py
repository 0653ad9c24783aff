import base64
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from tallyproof.llm.byte_bpe import coder, decoded, encoded, round_trip

VOCABULARY = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed):
    rng = random.Random(seed)
    letters = ["abc", "thing", " the", "é", "ß", "漢字", "🙂", "\n", "  ", "123", "...", "'s", "A", "\x00", "​", "ing", "tion", "eee"]
    return ["".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 40, 300]))) for _ in range(n)]


def test_ids_equal_the_library(library):
    bpe = coder(VOCABULARY, P.PATTERN)
    some = texts(400, 1) + ["a" * 5000, "ab" * 3000 + "é" * 2000, "x" * 2048, "-" * 9000, "<|endoftext|>", "don't  stop \n\n x"]
    rng = random.Random(5)
    some += ["".join(rng.choice("abcdefghij") for _ in range(3000))]
    for t, ids in zip(some, bpe.encode(some)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert bpe.decode(ids) == t.encode()


def test_tables(spark, library):
    rows = [(i, t, "x") for i, t in enumerate(texts(60, 2))] + [(60, None, "x"), (None, "", "x"), (0, "again", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(round_trip(docs, VOCABULARY, P.PATTERN).collect(), key=str)
    want = []
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    back = decoded(encoded(docs, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN).collect()
    assert sorted((r[0], bytes(r[1])) for r in back if r[0] is not None) == sorted((i, (t or "").encode()) for i, t, _ in rows if i is not None)
    assert round_trip(docs.limit(0), VOCABULARY, P.PATTERN).count() == 0
