"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts is the number of byte n-grams (two and
three bytes, ASCII letters lower-cased) that both hold, over the root of the product of
their own numbers. Landmark texts give Nystroem features: a text's kernel values with the
landmarks, whitened. One-versus-rest kernel ridge regression on them yields one score a
language. Scoring a batch is a presence matrix times the landmarks' and two small products.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, carried, crc32_of_id, kept_of, kept_schema, picked, pieces
from .labelled import LONGEST, sample

UNKNOWN = "und"
#: Cells of a presence matrix, which bounds the texts of one batch.
CELLS = 4 << 20
#: Cells of the landmarks' matrix, beyond which no language gets another landmark.
LANDMARK_CELLS = 16 << 20
#: Bytes whose n-grams are sorted at once; so many of texts, or one text, make a batch.
_SLICE = 1 << 18


def _codes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the two- and three-byte n-grams that begin at each place; those of three lie above all of two."""
    low = data + (((data >= 65) & (data <= 90)) * 32).astype(np.uint8)
    low = low.astype(np.uint32)
    two = (low[:-1] << 8) | low[1:]
    three = ((low[:-2] << 16) | (low[1:-1] << 8) | low[2:]) + np.uint32(1 << 16)
    return two, three


def grams(text: bytes) -> np.ndarray:
    """The sorted codes of the distinct n-grams of a text; of fewer than three bytes none."""
    return np.unique(np.concatenate(_codes(np.frombuffer(text, dtype=np.uint8)))) if len(text) >= 3 else np.zeros(0, np.uint32)


class Columns:
    """N-gram codes by column: a first table by hash, and a small second one for codes whose slot is taken."""

    BITS = 20

    def __init__(self, codes: np.ndarray):
        self.codes = np.append(codes, np.uint32(0xFFFFFFFF))
        self.first = np.full(1 << self.BITS, len(codes), dtype=np.int32)
        slot = self._slot(codes)
        self.first[slot[::-1]] = np.arange(len(codes), dtype=np.int32)[::-1]
        self.rest = np.flatnonzero(self.first[slot] != np.arange(len(codes)))

    def _slot(self, codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(0x9E3779B1)) >> np.uint32(32 - self.BITS)

    def of(self, codes: np.ndarray) -> np.ndarray:
        """The column of each code, their number where it has none."""
        found = self.first[self._slot(codes)]
        other = np.flatnonzero(self.codes[found] != codes)
        none = np.int32(len(self.codes) - 1)
        if len(self.rest):  # sorted, as codes are
            at = np.searchsorted(self.codes[self.rest], codes[other])
            column = self.rest[np.minimum(at, len(self.rest) - 1)]
            found[other] = np.where(self.codes[column] == codes[other], column, none)
        else:
            found[other] = none
        return found


def presences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and code of the distinct n-grams of each text, in order; a text of fewer than three bytes has none."""
    size = np.diff(offsets)
    of = np.repeat(np.where(size >= 3, np.arange(len(size)), -1).astype(np.int32), size)
    seen, new, waiting = np.zeros(0, np.int64), [], 0
    for a in range(0, max(len(data) - 1, 0), _SLICE):
        for n, code in enumerate(_codes(data[a : a + _SLICE + 2]), 2):
            code = code[:_SLICE]
            text = of[a : a + len(code)]
            inside = (text == of[a + n - 1 : a + n - 1 + len(code)]) & (text >= 0)
            new.append(np.unique(text[inside].astype(np.int64) << 25 | code[inside]))
            waiting += len(new[-1])
        if waiting > 4 * _SLICE:
            seen, new, waiting = np.unique(np.concatenate([seen, *new])), [], 0
    seen = np.unique(np.concatenate([seen, *new]))
    return seen >> 25, (seen & ((1 << 25) - 1)).astype(np.uint32)


@dataclass
class Model:
    """N-gram columns, landmarks and weights. The landmarks travel as bits, so that LANDMARK_CELLS and one landmark a language bound what is sent."""

    languages: list[str]
    columns: Columns
    landmarks: np.ndarray
    weights: np.ndarray
    usual: np.ndarray  # by language: the median lead of rows that were not fitted

    def presence(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """One row a text: where it holds the n-gram of the column 1 over the root of the number of all its n-grams, else 0."""
        rows, none = len(offsets) - 1, len(self.columns.codes) - 1
        text, code = presences(data, offsets)
        column = self.columns.of(code)
        out = np.zeros((rows, none), dtype=np.float32)
        weight = (1 / np.sqrt(np.maximum(np.bincount(text, minlength=rows), 1))).astype(np.float32)
        known = column < none
        out[text[known], column[known]] = weight[text[known]]
        return out

    def __getstate__(self) -> dict:
        return self.__dict__ | {"landmarks": (np.packbits(self.landmarks > 0, axis=1), self.landmarks.max(axis=1, initial=0))}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        bits, weight = state["landmarks"]
        self.landmarks = np.unpackbits(bits, axis=1, count=len(self.columns.codes) - 1).astype(np.float32) * weight[:, None]

    def rows_at_once(self) -> int:
        return max(8, CELLS // len(self.columns.codes))

    def raw(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Ridge scores of the languages, one row a text."""
        return (self.presence(data, offsets) @ self.landmarks.T) @ self.weights[:-1] + self.weights[-1]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shares of the languages, one row a text; and the leads in terms of the usual one."""
        z = self.raw(data, offsets)
        ahead = leads(z) / self.usual[z.argmax(axis=1)]
        z = np.exp(4 * (z - z.max(axis=1, keepdims=True)))
        return z / z.sum(axis=1, keepdims=True), ahead


def leads(z: np.ndarray) -> np.ndarray:
    """How far the best language is before the second; before -1, what others are fitted to, if it is alone."""
    return z[:, 0] + 1 if z.shape[1] == 1 else np.diff(np.partition(z, -2, axis=1)[:, -2:], axis=1)[:, 0]


def _landmarks(rows: list[tuple[bytes, str]], languages: list[str], most: int, cells: int) -> list[int]:
    """Rows that are landmarks: in turns one of each language, at most ``most`` of each, while their matrix has ``cells`` at most; the first turn is whole."""
    of: dict[str, list[int]] = {name: [] for name in languages}
    for i, (_, y) in enumerate(rows):
        of[y].append(i)
    chosen: list[int] = []
    known = np.zeros(0, np.uint32)
    for turn in range(most):
        more = [x[turn] for x in of.values() if turn < len(x)]
        if not more:
            break
        wider = np.unique(np.concatenate([known, *(grams(rows[i][0]) for i in more)]))
        if turn and (len(chosen) + len(more)) * len(wider) > cells:
            break
        known, chosen = wider, chosen + more
    return sorted(chosen, key=lambda i: (rows[i][1], i))


def fit(rows: list[tuple[bytes, str]], *, landmarks: int = 32, ridge: float = 0.1, cells: int = LANDMARK_CELLS) -> Model | None:
    """At most ``landmarks`` a language (fewer, the same number for all, where their matrix would pass ``cells``), all of whose n-grams are columns; None without rows.

    Of languages with ten rows or more every fifth is not fitted, but tells the usual lead of its language.
    """
    languages = sorted({y for _, y in rows})
    if not languages:
        return None
    seen: Counter = Counter()
    many = Counter(y for _, y in rows)
    held, fitted = [], []
    for row in rows:
        seen[row[1]] += 1
        (held if many[row[1]] >= 10 and seen[row[1]] % 5 == 0 else fitted).append(row)
    rows = fitted
    chosen = _landmarks(rows, languages, landmarks, cells)
    columns = Columns(np.unique(np.concatenate([grams(rows[i][0]) for i in chosen])).astype(np.uint32))
    width = len(columns.codes) - 1
    model = Model(languages, columns, np.zeros((0, width), np.float32), np.zeros((1, len(languages))), np.ones(len(languages)))
    model.landmarks = model.presence(*_joined([rows[i][0] for i in chosen]))
    step = model.rows_at_once()
    near = [model.presence(*_joined([t for t, _ in rows[i : i + step]])) @ model.landmarks.T for i in range(0, len(rows), step)]
    k = np.concatenate(near)
    k = k.astype(np.float64)
    value, vector = np.linalg.eigh(model.landmarks.astype(np.float64) @ model.landmarks.T.astype(np.float64))
    whiten = vector / np.sqrt(np.maximum(value, 1e-6))
    phi = np.c_[k @ whiten, np.ones(len(k))]
    y = np.array([[1.0 if lang == name else -1.0 for name in languages] for _, lang in rows])
    share = np.array([1 / sum(b == lang for _, b in rows) for _, lang in rows])[:, None] * len(rows) / len(languages)
    beta = np.linalg.solve(phi.T @ (phi * share) + ridge * np.eye(phi.shape[1]), phi.T @ (y * share))
    model.weights = np.r_[whiten @ beta[:-1], beta[-1:]].astype(np.float32)
    held = held or rows
    z = np.concatenate([model.raw(*_joined([t for t, _ in held[i : i + step]])) for i in range(0, len(held), step)])
    lead, best, true = leads(z), z.argmax(axis=1), np.array([languages.index(lang) for _, lang in held])
    right = best == true
    common = float(np.median(lead[right])) if right.any() else 1.0
    model.usual = np.array([max(1e-3, float(np.median(x)) if len(x := lead[right & (true == i)]) else common) for i in range(len(languages))])
    return model


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])


def lettered(data: np.ndarray, offsets: np.ndarray) -> list[bool]:
    """Whether each text holds a letter of any script."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    out = [bool(ascii_letter[a:b].any()) for a, b in zip(offsets, offsets[1:])]
    for i, found in enumerate(out):
        if not found:
            out[i] = any(c.isalpha() for c in bytes(data[offsets[i] : offsets[i + 1]]).decode(errors="ignore"))
    return out


def identify(
    docs: DataFrame, train: DataFrame, *, most: int = 400, folds: int = 4, held_out_fold: int = 2,
    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    keep: tuple[str, ...] = (), longest: int = LONGEST,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score (share of the predicted language, 0 to 1), lead, kept_<c> for each column c of ``keep``.

    The model is fitted on at most ``most`` rows of ``train`` of each language, of at most ``longest`` bytes (fewer with many languages, see labelled.sample), of the folds
    crc32(doc_id as text) mod ``folds`` that are not ``held_out_fold``; a prediction reads the
    text alone. ``lead`` is how far the language is before the second, 1 where it is as far as the
    median of known rows of it that were not fitted; unlike the share it doesn't depend on how many languages there are. Of languages that score alike
    the first by name is taken. ``und`` with score 0: null, empty and letterless texts, and every text if no
    language could be learned. Repeated ids stay apart; a null id is held out of nothing.
    """
    spark = docs.sparkSession
    rows = picked(docs, id_col, text_col, *carried(docs, keep, text_col))
    fold = F.pmod(crc32_of_id(), F.lit(folds)) == held_out_fold
    known = picked(train, id_col, text_col, lang_col).withColumnRenamed(lang_col, "lang")
    marks = known.filter("text is not null").select("doc_id", "lang")
    fitted, _ = sample(known.select("doc_id", "text"), marks, F.col("lang"), ~fold, most, longest)
    shared = spark.sparkContext.broadcast(fit([(t.encode(), y) for t, y in fitted if t]))

    def run(batches):
        model: Model | None = shared.value
        for batch in pieces(batches, most=_SLICE, rows=model.rows_at_once() if model else 512):
            data, offsets = bytes_of(batch.column("text"))
            n = len(offsets) - 1
            share, ahead = model.scores(data, offsets) if model else (np.zeros((n, 1)), np.zeros(n))
            names = model.languages if model else [UNKNOWN]
            ok = lettered(data, offsets) if model else [False] * n
            best = share.argmax(axis=1)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                    "lang_pred": pa.array([names[b] if k else UNKNOWN for b, k in zip(best.tolist(), ok, strict=True)], pa.string()),
                    "score": pa.array(np.where(ok, share[np.arange(n), best], 0.0).astype(np.float64)),
                    "lead": pa.array(np.where(ok, ahead, 0.0).astype(np.float64)),
                    **kept_of(batch, keep, text_col),
                }
            )

    return rows.withColumn("held_out", F.coalesce(fold, F.lit(False))).mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double, lead double" + kept_schema(docs, keep)
    )
