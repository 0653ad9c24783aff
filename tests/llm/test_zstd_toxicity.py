import math
import random
import re
import zlib

import numpy as np
import pytest

from tallyproof.llm.zstd_toxicity import fit, spelled, toxicity


def made(rng, bad):
    syllables = ["ta", "ro", "mi", "len", "ku", "vas", "pe", "dor", "sil", "an"]
    words = ["".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(30, 120))]
    for _ in range(rng.randrange(3, 7) if bad else 0):
        words.insert(rng.randrange(len(words)), rng.choice(["blorkface", "grimwad", "zuxxhead"]))
    return " ".join(words)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, made(rng, i % 4 == 0), "x") for i in range(900)]
    odd = [(5000, None, "x"), (5001, "", "x"), (None, rows[0][1], "x"), (0, rows[0][1], "x"), (5002, "blorkface grimwad " * 4000, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(900)] + [(None, 1), (5002, None)], "doc_id long, toxic int")
    got = toxicity(docs, labels).collect()
    assert len(got) == 905
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    assert held and all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held)
    assert sum(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in held) > 0.9 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[5001]["predicted"] == 0 and by[5000]["score"] == by[5001]["score"] and by[5002]["predicted"] == 1
    assert toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity(docs, labels.limit(0)).collect()} == {0.0}


@pytest.mark.parametrize("toxic", [["zx", "qy", "wv"], ["zxq", "qyw", "wvj"], ["悪口", "馬鹿", "死ね"], ["悪", "鹿"], ["blork" * 4]])
def test_short_unspaced_and_long_toxic_words_are_learned(toxic):
    rng = random.Random(9)
    unspaced = not toxic[0].isascii()

    def text(bad):
        if unspaced:
            run = [rng.choice("山川田中村木林森空海風花月") for _ in range(rng.randrange(60, 160))]
            for _ in range(4 if bad else 0):
                run.insert(rng.randrange(len(run)), rng.choice(toxic))
            return "".join(run).encode()
        words = made(rng, False).split()
        for _ in range(rng.randrange(4, 8) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(toxic) if len(toxic) > 1 else rng.choice("abcdefgh") + rng.choice("ijklm") + toxic[0])
        return " ".join(words).encode()

    model = fit([(text(i % 3 == 0), int(i % 3 == 0)) for i in range(600)])
    one, two = model.lengths()
    rows = [(text(y), y) for y in (0, 1) for _ in range(80)]
    score = model.score(np.array([model.features(t, one, two) for t, _ in rows]))
    assert sum((s >= 0.5) == bool(y) for s, (_, y) in zip(score, rows)) >= 0.9 * len(rows)


def test_window_bound_is_a_parameter():
    rows = [(made(random.Random(i), i % 3 == 0).encode(), int(i % 3 == 0)) for i in range(300)]
    assert fit(rows, most_windows=200).ordinary != fit(rows, most_windows=2000).ordinary


def plain_gains(model, text):
    """The gains of a text's windows, by the definition: lower-case words, six at a time, both compressed lengths."""
    one, two = model.lengths()
    text = text.encode().lower()
    for p in model.points:
        text = text.replace(p, spelled(p))
    words, out, window = re.findall(rb"[0-9a-z\x80-\xff]+", text), [], []
    for i, w in enumerate(words):
        window.append(spelled(w) if len(w) < 4 and w in model.short else w)
        if len(window) == 6 or i + 1 == len(words):
            said = b" " + b" ".join(window) + b" " + b"\n" * 40
            out.append(len(one(said)) - len(two(said)))
            window = []
    return out or [0]


def plain_score(model, text):
    gains = plain_gains(model, text)
    n, top = len(gains), sorted(gains, reverse=True)[:3] + [0, 0]
    over = [sum(g >= k for g in gains) for k in range(1, 8)]
    x = [*top[:3], sum(gains) / n, math.log(n), *(math.log(1 + c) for c in over), *(c / n for c in over)]
    z = sum((v - m) / s * w for v, m, s, w in zip(x, model.mean, model.scale, model.weight[:-1], strict=True)) + model.weight[-1] + model.shift
    return 1 / (1 + math.exp(-z))


def test_scores_equal_a_plain_version_of_the_same_model(spark):
    rng = random.Random(3)
    rows = [(i, made(rng, i % 3 == 0)) for i in range(240)] + [(900, ""), (901, "blorkface " * 50), (902, "漢字 É zuxxhead ok")]
    known = [(t.encode(), int(i % 3 == 0)) for i, t in rows if i < 240 and zlib.crc32(str(i).encode()) % 5]
    model = fit(known, sum(y for _, y in known) / len(known))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(240)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity(docs, labels).collect()}
    for i, t in rows:
        want = plain_score(model, t)
        assert got[i]["score"] == pytest.approx(want, abs=1e-9) and got[i]["predicted"] == int(want >= 0.5)


def test_a_few_labelled_rows_and_the_length_bound(spark):
    bad, good = b"grimwad zuxxhead blorkface", b"the sun rose over a quiet valley"
    for rows in ([(bad, 1), (good, 0)], [(bad, 1)] * 3 + [(good, 0)] * 2, [(b"", 1), (b"", 0)]):
        model = fit(rows)
        assert len(model.weight) and 0 <= model.score(np.array([model.features(bad, *model.lengths())]))[0] <= 1
    assert not len(fit([(bad, 1)]).weight) and not len(fit([(good, 0)] * 9).weight)
    docs = spark.createDataFrame([(i, made(random.Random(i), i % 2 == 0)) for i in range(80)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 2 == 0)) for i in range(80)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity(docs, labels, longest=0).collect()} == {0.0}
    assert len({r["score"] for r in toxicity(docs, labels).collect()}) > 1
