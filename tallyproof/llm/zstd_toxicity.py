"""Toxicity by compression distance.

Two zstandard dictionaries: one of ordinary text, one that also holds what toxic text
says and ordinary text does not. Windows of words are compressed with both; the bytes
that the toxic dictionary saves are a window's gain, and a logistic curve fitted on
labelled documents turns the gains of a whole text into a score.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, picked, pieces, text_bytes
from .labelled import LONGEST, sample

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Closes each window: zstandard looks for no match in a block's last bytes, and keeps small blocks raw.
PAD = b" " + b"\n" * 40
#: Set by every trained dictionary between its tables and its content.
_REPEATS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


#: Letters of scripts that are written without blanks (Thai to Khmer, kana, Han).
UNSPACED = re.compile("[\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
#: Words of fewer bytes save next to nothing as matches; those that toxic texts prefer are spelled out.
SHORT = 4


def spelled(word: bytes) -> bytes:
    """A short word and eight letters of its hash: long enough for a match that saves bytes."""
    return word + hashlib.blake2b(word, digest_size=4).hexdigest().encode()


def _lone(word: bytes) -> bool:
    """Whether this is one short code point of a script without blanks, which stands inside of runs."""
    return len(word) == 3 and bool(UNSPACED.fullmatch(word.decode(errors="ignore")))


def cut(text: bytes, words: int, short: frozenset[bytes] = frozenset(), points: tuple[bytes, ...] = ()) -> list[bytes]:
    """Windows of ``words`` lower-cased words each, over the whole text; those of ``short`` and all of ``points`` are spelled out."""
    text = text.lower()
    for p in points:
        text = text.replace(p, spelled(p))
    found = WORD.findall(text)
    if short:
        found = [spelled(w) if len(w) < SHORT and w in short else w for w in found]
    return [b" " + b" ".join(found[i : i + words]) + PAD for i in range(0, len(found), words)]


def _parts(text: bytes) -> set[str]:
    """What a dictionary may hold of a text: whole words of any length, their beginnings of 4 to 14 letters and

    pieces of 4 to 6 letters; of scripts without blanks, pieces of 1 to 8 code points that stand anywhere.
    """
    out = set()
    for w in set(WORD.findall(text.lower())):
        u = w.decode(errors="ignore")
        out.add(u)
        out.update(u[:k] for k in range(4, min(len(u), 14) + 1))
        low, high = (1, 8) if UNSPACED.search(u) else (4, 6)
        out.update(u[i : i + k] for k in range(low, high + 1) for i in range(len(u) - k + 1))
    out.discard("")
    return out


def contrast(toxic: list[bytes], ordinary: list[bytes], *, least: int = 5, ratio: float = 10.0) -> tuple[bytes, frozenset[bytes], tuple[bytes, ...]]:
    """What toxic texts hold ``ratio`` times as often as ordinary ones, the strongest last (nearest); its short words and lone code points."""
    ours: Counter = Counter()
    for t in toxic:
        ours.update(_parts(t))
    ours = Counter({w: k for w, k in ours.items() if k >= least})
    theirs: Counter = Counter()
    for t in ordinary:
        theirs.update(_parts(t) & ours.keys())
    odds = {w: (k + 0.5) / (len(toxic) + 1) / ((theirs[w] + 0.5) / (len(ordinary) + 1)) for w, k in ours.items()}
    good = {w for w, o in odds.items() if o >= ratio}
    longer: dict[str, int] = {}
    for w in good:
        for inner in {w[:-1], w[1:]} & good:
            longer[inner] = max(longer.get(inner, 0), ours[w])
    keep = [w for w in good if longer.get(w, 0) < 0.9 * ours[w]]  # of parts of one word the longest is enough
    keep.sort(key=lambda w: (ours[w] * math.log(odds[w]), w))
    raw = [w.encode() for w in keep]
    points = tuple(sorted(w for w in raw if _lone(w)))
    short = frozenset(w for w in raw if len(w) < SHORT) - set(points)
    entries = [cut(w, 1, short, points)[0][1 : -len(PAD)] for w in raw]  # as windows will show them
    return b" " + b"  ".join(entries) + b" ", short, points


@dataclass
class Model:
    """The dictionaries and the curve; small enough to travel with a task."""

    ordinary: bytes
    toxic: bytes
    words: int = 6
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    shift: float = 0.0
    short: frozenset[bytes] = frozenset()
    points: tuple[bytes, ...] = ()

    def lengths(self):
        """Two functions: the compressed length of a window with either dictionary."""
        settings = zstandard.ZstdCompressionParameters(
            format=zstandard.FORMAT_ZSTD1_MAGICLESS, write_content_size=False, write_checksum=False, write_dict_id=False,
            window_log=max(15, (len(self.toxic) + 4096).bit_length()), hash_log=14, chain_log=14, search_log=4, min_match=4, target_length=16,
            strategy=zstandard.STRATEGY_LAZY2,
        )
        out = []
        for content in (self.ordinary, self.toxic):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=settings)
            out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=settings).compress)
        return out

    def features(self, text: bytes, ordinary, toxic) -> list[float]:
        gains = np.array([len(ordinary(w)) - len(toxic(w)) for w in cut(text, self.words, self.short, self.points)] or [0])
        top = np.sort(gains)[::-1][:3].tolist()
        counts = [int((gains >= k).sum()) for k in range(1, 8)]
        return [
            *top, *[0] * (3 - len(top)), float(gains.mean()), math.log(len(gains)),
            *(math.log1p(c) for c in counts), *(c / len(gains) for c in counts),
        ]

    def score(self, rows: np.ndarray) -> np.ndarray:
        if not len(self.weight):
            return np.zeros(len(rows))
        z = (rows - self.mean) / self.scale @ self.weight[:-1] + self.weight[-1] + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def fit(rows: list[tuple[bytes, int]], share: float | None = None, *, words: int = 6, seed: int = 7, most_windows: int = 20_000) -> Model:
    """Dictionaries from two thirds of the rows; curve and threshold from the others.

    The threshold is calibrated to the best balance of precision and recall (F1) where
    toxic documents are ``share`` of all (None: as in ``rows``), and moved to 0.5. The ordinary dictionary is
    trained on at most ``most_windows`` windows of ordinary rows, drawn at random. A label of so few rows that none is left for the curve
    has all of them on both sides; with no row of a label the model scores 0 throughout.
    """
    rng = random.Random(seed)
    rows = rows[:]
    rng.shuffle(rows)
    toxic, ordinary = [t for t, y in rows if y == 1], [t for t, y in rows if y == 0]
    if not toxic or not ordinary:
        return Model(b"", b"", words)
    a, b = max(1, len(toxic) * 2 // 3), max(1, len(ordinary) * 2 // 3)
    samples = [w[: -len(PAD)] + b" " for t in ordinary[:b] for w in cut(t, 8)]
    rng.shuffle(samples)
    try:
        shared = zstandard.train_dictionary(8192, samples[:most_windows], k=32, d=6).as_bytes()
        shared = shared[shared.index(_REPEATS) + len(_REPEATS) :]
    except (zstandard.ZstdError, ValueError):  # too few or too short samples to train on
        shared = b"".join(samples)[-8192:] or b" "
    strong, short, points = contrast(toxic[:a], ordinary[:b])
    model = Model(shared, strong + shared, words, short=short, points=points)
    one, two = model.lengths()
    held = [(t, 1) for t in toxic[a:] or toxic] + [(t, 0) for t in ordinary[b:] or ordinary]
    x = np.array([model.features(t, one, two) for t, _ in held])
    y = np.array([k for _, k in held], dtype=float)
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.c_[(x - model.mean) / model.scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(25):  # Newton's steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(z @ w, -50, 50)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w))
        w = w + np.linalg.solve(h, z.T @ (y - p) - w)
    model.weight = w
    s = z @ w
    order = np.argsort(-s)
    share = min(max(y.mean() if share is None else share, 1e-4), 1 - 1e-4)
    count = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum()))[order]
    f1 = 2 * np.cumsum(count * y[order]) / (np.cumsum(count) + share)
    best = int(f1.argmax())
    border = s[order[best]] if best + 1 == len(s) else (s[order[best]] + s[order[best + 1]]) / 2
    model.shift = -float(border)
    return model


def toxicity(
    docs: DataFrame, labels: DataFrame, *, most: int = 3000, most_windows: int = 20_000, longest: int = LONGEST, folds: int = 5, held_out_fold: int = 0,
    id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic",
) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted (score >= 0.5).

    The model is fitted on at most ``most`` labelled documents of each label (its ordinary
    dictionary on at most ``most_windows`` windows of eight words of them), of at most ``longest`` bytes each, whose
    crc32(doc_id as text) mod ``folds`` is not ``held_out_fold``; neither labels nor ids nor
    any other column takes part in a score. Every whole text is scored in windows; null and
    empty texts are scored as no windows. Repeated ids stay apart, each text scored by itself;
    a null id is held out of nothing (held_out false). All scores are 0 without any fitted row of either label.
    """
    spark = docs.sparkSession
    rows = picked(docs, id_col, text_col)
    fold = F.pmod(crc32_of_id(), F.lit(folds)) == held_out_fold
    marks = labels.select(labels[id_col].cast("long").alias("doc_id"), labels[toxic_col].cast("int").alias("toxic"))
    known, counts = sample(rows, marks.filter("toxic in (0, 1)"), F.col("toxic"), ~fold, most, longest)
    shared = spark.sparkContext.broadcast(
        fit([(t.encode(), y) for t, y in known], counts.get(1, 0) / max(1, sum(counts.values())), most_windows=most_windows)
    )

    def run(batches):
        model: Model = shared.value
        one, two = model.lengths() if model.toxic else (bytes, bytes)
        for batch in pieces(batches):
            data, offsets = text_bytes(batch.column("text"))
            x = [model.features(bytes(data[a:b]), one, two) for a, b in zip(offsets, offsets[1:])]
            score = model.score(np.array(x).reshape(len(x), -1))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                    "score": pa.array(score), "predicted": pa.array((score >= 0.5).astype(np.int32)),
                }
            )

    return rows.withColumn("held_out", F.coalesce(fold, F.lit(False))).mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )
