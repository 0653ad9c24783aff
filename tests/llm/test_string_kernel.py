import pickle
import random
import zlib

import numpy as np
import pytest

from corpus_pipeline import language_id
from tallyproof.llm import labelled
from tallyproof.llm import string_kernel
from tallyproof.llm.string_kernel import fit, identify, presences, _joined

SYLLABLES = {"aa": ["ka", "to", "ni", "ra"], "bb": ["sch", "ung", "ein", "ber"], "cc": ["ção", "lho", "que", "mente"]}


def made(rng, lang):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))).capitalize() for _ in range(rng.randrange(8, 60)))


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, made(rng, lang := rng.choice(list(SYLLABLES))), lang, "x") for i in range(600)]
    odd = [(900, None, "aa", "x"), (901, "12 34 ...", "bb", "x"), (902, "", None, "x"), (None, rows[0][1], None, "x"), (0, rows[0][1], "aa", "x"), (903, rows[5][1] * 3000, None, "x"), (904, "漢", None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = identify(docs, docs, most=100).collect()
    assert len(got) == 607
    held = [r for r in got if r["held_out"] and r["doc_id"] < 600]
    lang = {i: y for i, _, y, _ in rows}
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 for r in held)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[900] == by[901] == by[902] == "und" and by[None] == by[0] and by[903] == by[5] and by[904] != "und"
    assert identify(docs.limit(0), docs).count() == 0
    assert {r["lang_pred"] for r in identify(docs, docs.limit(0)).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 40])
def test_verdicts_don_t_depend_on_the_number_of_languages(spark, n):
    rng = random.Random(12)
    parts = [["".join(rng.choice(x) for x in ("bcdfghjklmnprstvz", "aeiou", "bdgklmnrst")) for _ in range(8)] for _ in range(40)]
    say = lambda i: " ".join("".join(rng.choice(parts[i]) for _ in range(rng.randrange(1, 3))) for _ in range(40))
    rows = [(1000 * i + k, say(i), f"l{i:02}", "s", 1) for i in range(n) for k in range(30)]
    junk = [(900_000 + k, "ქართული " * 5 + "ⴰⵎⴰⵣⵉⵖ " * k, None, "s", 1) for k in range(1, 20)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"] for r in language_id(spark, docs, "").collect()}
    assert kept == {r[0] for r in rows}


def test_a_rare_script_has_columns_of_its_own():
    rng = random.Random(13)
    word = lambda signs: "".join(rng.choice(signs) for _ in range(rng.randrange(2, 8)))
    rows = [(" ".join(word("abcdefghijklmnopqrstuvwxyz"[k : k + 20]) for _ in range(300)).encode(), f"l{k}") for k in (0, 6) for _ in range(300)]
    rows += [(" ".join(word("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(30)).encode(), "gr") for _ in range(12)]
    model = fit(rows)
    assert model.presence(*_joined([rows[-1][0]])).any()
    share, _ = model.scores(*_joined([" ".join(word("αβγδεζηθικλμνξοπρστυφχψω") for _ in range(30)).encode() for _ in range(20)]))
    assert {model.languages[i] for i in share.argmax(axis=1)} == {"gr"}


def test_too_many_labels_are_refused(spark):
    docs = spark.range(2000).selectExpr("id AS doc_id", "'some text' AS text", "cast(id AS string) AS lang")
    with pytest.raises(ValueError):
        identify(docs, docs)
    assert labelled.MOST_LABELS == 1000


def test_kernel_values_equal_sets_of_n_grams():
    rng = random.Random(3)
    rows = [(made(rng, lang).encode(), lang) for lang in SYLLABLES for _ in range(40)]
    model = fit(rows, landmarks=4)
    grams_of = lambda t: {t.lower()[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)}
    seen, fitted = {y: 0 for y in SYLLABLES}, []
    for t, y in rows:
        seen[y] += 1
        if seen[y] % 5:
            fitted.append((t, y))
    marks = [grams_of(t) for y in sorted(SYLLABLES) for t in [t for t, z in fitted if z == y][:4]]
    for text in [rows[7][0], b"", b"ab", "ÄÖ zz zz".encode() + rows[50][0] * 9, b"no such thing"]:
        own = grams_of(text) if len(text) >= 3 else set()
        want = [len(own & m) / max(1, len(own)) ** 0.5 / len(m) ** 0.5 for m in marks]
        got = (model.presence(*_joined([b"xx", text])) @ model.landmarks.T)[1]
        assert all(abs(a - b) < 1e-5 for a, b in zip(got, want, strict=True))


def test_distinct_n_grams_of_texts_cut_in_slices(monkeypatch):
    rng = random.Random(8)
    texts = [b"", b"ab", bytes(rng.choice(b"abcdef") for _ in range(900)), b"abc", b"A" * 70, bytes(range(256))]
    whole = [x.tolist() for x in presences(*_joined(texts))]
    want = sorted((i, int(c)) for i, t in enumerate(texts) for c in string_kernel.grams(t))
    assert list(zip(*whole, strict=True)) == want
    monkeypatch.setattr(string_kernel, "_SLICE", 7)
    assert [x.tolist() for x in presences(*_joined(texts))] == whole
    assert [len(x) for x in presences(*_joined([]))] == [0, 0]


def test_landmarks_are_bounded_in_all_and_travel_as_bits():
    rng = random.Random(9)
    rows = [(made(rng, lang).encode(), lang) for lang in SYLLABLES for _ in range(60)]
    whole, small = fit(rows), fit(rows, cells=9 * 400)
    assert len(whole.landmarks) == 3 * 32 and len(whole.landmarks) > len(small.landmarks) >= 3 and len(small.landmarks) % 3 == 0
    assert small.landmarks.size <= max(9 * 400, small.landmarks.shape[1] * 3)
    sent = pickle.dumps(whole)
    assert np.allclose(pickle.loads(sent).landmarks, whole.landmarks) and len(pickle.dumps(whole.__getstate__()["landmarks"])) < whole.landmarks.nbytes / 20


def test_a_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * (10 if i % 2 else 1000), f"l{i % 3}") for i in range(60)], "doc_id long, text string, lang string")
    got, counts = labelled.sample(docs, docs, docs["lang"], docs["doc_id"] >= 0, 10, most_bytes=10 * 3 * 100)
    assert sum(counts.values()) == 60 and got and all(len(t) == 10 for t, _ in got)
