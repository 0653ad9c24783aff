import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tallyproof.llm import token_grammar
from tallyproof.llm.token_grammar import decode_range, expand, lengths, re_pair, read_back, unpacked, write_grammar

VOCABULARY = P.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(25))
def test_grammar_is_exact_and_random_access_agrees(seed):
    rng = random.Random(seed)
    n, kinds = rng.choice([0, 1, 15, 16, 400, 5000]), rng.choice([1, 2, 5, 300])
    part = [rng.randrange(kinds) for _ in range(max(1, n // 7))]
    ids = np.array([x for _ in range(7) for x in part][:n] + [rng.randrange(kinds) for _ in range(n % 7)], dtype=np.uint32)
    rules, symbols = re_pair(ids, 300, least=3)
    assert expand(symbols, rules, 300).tolist() == ids.tolist()
    size = lengths(rules, 300)
    assert all(size[i] == len(expand(np.array([300 + i]), rules, 300)) for i in range(len(rules)))
    if n >= 400 and kinds <= 5:
        assert len(symbols) < len(ids) / 2
    for _ in range(20):
        a = rng.randrange(n + 1)
        b = rng.randrange(a, n + 2)
        assert decode_range(rules, symbols, 300, a, b).tolist() == ids[a:b].tolist()


def test_files_hold_the_library_s_ids_in_order(spark):
    rng = random.Random(8)
    words = ["The", "cat,", "É", "don't", "漢字", "İ", "ΑΣ", "x1y22", "\x0b", "é", "́", " ", "<|endoftext|>", "...", "\n", " a", "a.b", "it's", "x.'s", "END!!", "w%%%", "&c.'t", "a-b_c", "<b>Hi, A.</b>", "3.5,", "q'"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 200]))), 1) for i in rng.sample(range(1000), 200)]
    rows += [(5000, None, 1), (5001, "", 1), (rows[0][0], "again", 1), (None, "no id", 1), (rows[1][0], rows[1][1], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int").repartition(3)
    got = read_back(write_grammar(docs, VOCABULARY, block_ids=700, partition_bytes=3000)).collect()
    t = Tokenizer.from_file(VOCABULARY)
    want = []
    for i, x, _ in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids + [2]
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert sorted(((r[0], r[2], r[3]) for r in got), key=str) == sorted(want, key=str)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    in_order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert in_order[0] is None and in_order[1:] == sorted(in_order[1:])
    assert read_back(write_grammar(docs.limit(0), VOCABULARY)).count() == 0


def test_no_frequent_pair_is_left_and_long_copies_shrink():
    rng = np.random.default_rng(4)
    passage = rng.integers(0, 300, 700).astype(np.uint32)
    for ids in (np.tile(passage, 2000), np.zeros(100_000, np.uint32), rng.integers(0, 40, 60_000).astype(np.uint32), (rng.zipf(1.3, 200_000) % 4000).astype(np.uint32)):
        rules, symbols = re_pair(ids, 5000, least=8)
        assert (expand(symbols, rules, 5000) == ids).all()
        left, right = symbols[:-1].astype(np.int64), symbols[1:].astype(np.int64)
        assert not len(left) or np.unique((left << 32) | right, return_counts=True)[1].max() < 8
    rules, symbols = re_pair(np.tile(passage, 2000), 5000)
    assert len(symbols) + 2 * len(rules) < 2000 * 700 / 300  # four rounds end at a sixteenth
    size = lengths(rules, 5000)
    assert size.max() > 10_000 and decode_range(rules, symbols, 5000, 699_990, 700_010, size).tolist() == np.tile(passage, 2)[690:710].tolist()


def test_blocks_store_the_lengths_that_range_access_reads(spark):
    docs = spark.createDataFrame([(i, "the same old words again and again " * 40) for i in range(60)], "doc_id long, text string")
    for row in write_grammar(docs, VOCABULARY).collect():
        rules, symbols = np.frombuffer(row["rules"], "<u4").reshape(-1, 2), unpacked(row["symbols"])
        size = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        assert len(size) == len(rules) > 0 and (size == lengths(rules, row["base"])).all()
        ids = expand(symbols, rules, row["base"])
        assert len(ids) == row["n_ids"] and decode_range(rules, symbols, row["base"], 17, 400, size).tolist() == ids[17:400].tolist()


def test_words_that_a_polynomial_hash_confuses_and_a_very_long_text(spark):
    one = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = one.translate(str.maketrans("ab", "ba"))
    tok = Tokenizer.from_file(VOCABULARY)
    rows = [(1, f"{one} {other}"), (2, other), (3, "word and signs, " * 40_000)]
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in read_back(write_grammar(spark.createDataFrame(rows, "doc_id long, text string"), VOCABULARY)).collect()}
    for i, t in rows:
        ids = tok.encode(t, add_special_tokens=False).ids + [2]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_equal_hashes_are_told_apart_by_bytes(monkeypatch):
    monkeypatch.setattr(token_grammar, "span_hashes", lambda data, starts, ends: (ends - starts).astype(np.uint64))
    data = np.frombuffer(b"one two ten one six", dtype=np.uint8)
    first, which = token_grammar.alike(data, np.array([0, 4, 8, 12, 16]), np.array([3, 7, 11, 15, 19]))
    assert which[0] == which[3] and len({*which.tolist()}) == 4 and first.tolist() == [0, 1, 2, 4]
