"""PII by candidate gradient boosting, in DataFrame functions.

Generators of high recall propose spans that may overlap: the four base formats and wider
forms of them (spelled-out addresses, eight-group addresses, cards and phones with other
separators). Candidates that pass their kind's check (digits, Luhn, octets) are positive
examples, those that fail are negative ones. Format and context features that leave the
check out are counted over the whole corpus; the counts (a table no larger than the product
of the features' values) train boosted trees of depth two, which go back into the plan
as CASE expressions. A document counts once in each cell, and a source no more than the median
source of its kind, so that no writer of many digits outvotes the others. Each kind's threshold is
the lowest score at which, in the other fold, candidates that pass their check reach the wished
precision; how many pass by chance is told by those that fail. Base spans always stay; wider
candidates that pass their check, overlap no base span and reach the threshold are added.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import picked, stored
from .spans import located, no_spans, written

KINDS = ("email", "ip", "card", "phone")

#: The base formats. Runs are possessive and begin at a run's first character (or where the
#: last match ended), which finds the same leftmost matches without going back.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider forms of the same kinds.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]++(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9._/])[0-9]{4}(?:[._/][0-9]{4}){2}[._/][0-9]{1,7}(?![0-9])",
    "phone": r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[.-][0-9]{4}(?![0-9])",
}
#: Texts without these can't hold a match; looked for before the patterns run.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"),
    "card": lambda t: t.rlike("[0-9]"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}
WIDE_NEEDS = {
    "email": lambda t: t.rlike(r"[(\[]at[)\]]"),
    "ip": lambda t: t.rlike(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:"),
    "card": lambda t: t.rlike(r"[0-9]{4}[._/][0-9]{4}"),
    "phone": lambda t: t.rlike(r"[0-9]{3}[.-][0-9]{4}"),
}
#: Words on the left that speak for a kind.
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach)", "ip": r"(?i)(?:\bip\b|host|server|addr|from)",
    "card": r"(?i)(?:card|visa|credit|pay|account)", "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell)",
}
FEATURES = ("digits", "separators", "longest", "cue", "before", "after", "bracket")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check of card numbers, from the last digit on."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda d: d != ""), lambda d: d.cast("int"))
    doubled = F.transform(values, lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """The check of a base match."""
    n = F.length(_digits(m))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "email": F.lit(True),
        "ip": m.rlike(rf"^{part}(?:\.{part}){{3}}$"),
        "card": F.when(n.between(13, 19), luhn(_digits(m))).otherwise(False),
        "phone": n.between(9, 15),
    }[kind]


def passes_wide(kind: str, m: Column) -> Column:
    return {
        "email": m.rlike(r"[A-Za-z]{2,}$"), "ip": m.rlike("[A-Fa-f]") | m.rlike("[0-9]{4}"),
        "card": passes("card", m), "phone": ~m.rlike(r"^\(?[01]"),
    }[kind]


def _bin(value: Column, *borders: int) -> Column:
    """How many borders the value reaches."""
    out = F.lit(0)
    for b in borders:
        out = out + (value >= b).cast("int")
    return out


def _char_class(c: Column) -> Column:
    return (
        F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^[,.;:!?)\]\"']"), 2).when(c.rlike(r"^\p{L}"), 3).otherwise(4)
    )


def featured(kind: str, x: Column) -> Column:
    """The struct of features of one candidate; small integers all."""
    m = x["m"]
    return F.struct(
        _bin(F.length(_digits(m)), 1, 7, 9, 11, 13, 16, 17, 20).alias("digits"),
        _bin(F.length(F.regexp_replace(m, r"[\p{L}0-9]", "")), 1, 2, 3, 4, 6).alias("separators"),
        _bin(F.array_max(F.transform(F.split(m, "[^0-9]+"), lambda p: F.length(p))), 1, 3, 4, 5, 9, 13).alias("longest"),
        x["l"].rlike(CUES[kind]).cast("int").alias("cue"),
        _char_class(F.right(x["l"], F.lit(1))).alias("before"),
        _char_class(x["r"]).alias("after"),
        m.rlike(r"[(\[+]").cast("int").alias("bracket"),
    )


def proposed(text: Column, kind: str, wide: bool) -> Column:
    """Candidates of one generator: the located spans with ok (the check) and f (features)."""
    pattern, needs, check = (WIDE, WIDE_NEEDS, passes_wide) if wide else (BASE, NEEDS, passes)
    found = F.when(needs[kind](text), located(text, pattern[kind])).otherwise(no_spans())
    return F.transform(
        found,
        lambda x: F.struct(
            F.lit(kind).alias("k"), x["s"].alias("s"), x["e"].alias("e"), check(kind, x["m"]).alias("ok"), featured(kind, x).alias("f")
        ),
    )


# ---- training on counts ----------------------------------------------------------------


#: Of candidates that mean something else, how many pass their check for each one that fails: one in ten numbers passes Luhn.
BY_CHANCE = {"email": 0.0, "ip": 0.0, "card": 1 / 9, "phone": 0.0}


def counted(rows: DataFrame) -> list[dict]:
    """Candidates by kind, fold and features: how many pass their check and how many fail it.

    Of a document, candidates with the same features and verdict count once. A source (column
    ``source``; all rows are one where it is null) whose sum of a kind is over the median
    source's is scaled down to it. One aggregation over every candidate of the corpus, then one over sources. At most
    2 x 4 x 9 x 6 x 7 x 2 x 5 x 5 x 2 rows can come back, whatever the corpus.
    """
    every = F.array_distinct(F.concat(*(F.transform(proposed(F.col("text"), k, w), lambda c: F.struct(c["k"], c["ok"], c["f"])) for k in KINDS for w in (False, True))))
    one = rows.select("source", F.pmod(F.xxhash64("text"), F.lit(2)).alias("fold"), F.explode(every).alias("c"))
    cells = one.groupBy("source", "fold", F.col("c.k").alias("k"), *(F.col(f"c.f.{f}").alias(f) for f in FEATURES)).agg(
        F.sum(F.col("c.ok").cast("long")).alias("good"), F.sum((~F.col("c.ok")).cast("long")).alias("bad")
    )
    cells = stored(cells, "pii")  # no larger than the cells of all sources
    sums = cells.groupBy("source", "k").agg(F.sum(F.col("good") + F.col("bad")).alias("n"))
    bound = sums.groupBy("k").agg(F.percentile_approx("n", 0.5, 10_000).alias("bound"))
    share = sums.join(F.broadcast(bound), "k").select("k", F.col("source").alias("of"), F.least(F.lit(1.0), F.col("bound") / F.col("n")).alias("w"))
    weighed = cells.join(share.withColumnRenamed("k", "kind"), (F.col("k") == F.col("kind")) & F.col("source").eqNullSafe(F.col("of")))
    grouped = weighed.groupBy("fold", "k", *FEATURES).agg(F.sum(F.col("good") * F.col("w")).alias("good"), F.sum(F.col("bad") * F.col("w")).alias("bad"))
    return [r.asDict() for r in grouped.orderBy("fold", "k", *FEATURES).collect()]


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float = 1.0):
    """(feature, border, left, right) or a leaf's value, by the best gain of second order."""
    best = None
    if depth:
        base = g.sum() ** 2 / (h.sum() + ridge)
        for j in range(x.shape[1]):
            for b in np.unique(x[:, j])[:-1]:
                low = x[:, j] <= b
                gain = g[low].sum() ** 2 / (h[low].sum() + ridge) + g[~low].sum() ** 2 / (h[~low].sum() + ridge) - base
                if gain > 1e-6 and (best is None or gain > best[0]):
                    best = (gain, j, int(b), low)
    if best is None:
        return float(g.sum() / (h.sum() + ridge))
    _, j, b, low = best
    return (j, b, _tree(x[low], g[low], h[low], depth - 1), _tree(x[~low], g[~low], h[~low], depth - 1))


def _value(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, b, left, right = tree
    return np.where(x[:, j] <= b, _value(left, x), _value(right, x))


def boost(cells: list[dict], *, rounds: int = 20, rate: float = 0.4) -> tuple[float, list]:
    """Boosted trees on weighted cells: start value and trees of the log-odds that a candidate is good."""
    x = np.array([[c[f] for f in FEATURES] for c in cells]).reshape(len(cells), len(FEATURES))
    good, bad = np.array([c["good"] for c in cells], float), np.array([c["bad"] for c in cells], float)
    start = math.log((good.sum() + 1) / (bad.sum() + 1))
    z, trees = np.full(len(cells), start), []
    for _ in range(rounds if len(cells) > 1 else 0):
        p = 1 / (1 + np.exp(-z))
        tree = _tree(x, good - (good + bad) * p, (good + bad) * p * (1 - p) + 1e-9, 2)
        trees.append(tree)
        z = z + rate * _value(tree, x)
    return start, trees


def threshold(cells: list[dict], start: float, trees: list, rate: float, precision: float, by_chance: float = 0.0) -> float:
    """The lowest log-odds at which the held candidates that pass reach the precision; infinite if none does.

    ``by_chance``: how many pass though they mean something else, for each one that fails.
    Without it what fails counts against what passes, as no check tells them apart.
    """
    if not cells:
        return math.inf
    x = np.array([[c[f] for f in FEATURES] for c in cells])
    z = start + rate * sum((_value(t, x) for t in trees), np.zeros(len(cells)))
    good, bad = np.array([c["good"] for c in cells], float), np.array([c["bad"] for c in cells], float)
    order = np.argsort(-z, kind="stable")
    false = np.minimum(good, bad * by_chance)
    share = np.cumsum((good - false)[order]) / (np.cumsum((good if by_chance else good + bad)[order]) + 1)
    ok = np.flatnonzero(share >= precision)
    return float(z[order][ok[-1]]) if len(ok) else math.inf


def _as_column(tree, f: Column) -> Column:
    if isinstance(tree, float):
        return F.lit(tree)
    j, b, left, right = tree
    return F.when(f[FEATURES[j]] <= b, _as_column(left, f)).otherwise(_as_column(right, f))


def trained(rows: DataFrame, *, precision: float = 0.9, rate: float = 0.4) -> dict[str, tuple[float, list, float]]:
    """By kind: start value, trees, threshold."""
    cells = counted(rows)
    out = {}
    for kind in KINDS:
        one, two = ([c for c in cells if c["k"] == kind and c["fold"] == fold] for fold in (0, 1))
        start, trees = boost(one, rate=rate) if one else (0.0, [])
        out[kind] = (start, trees, threshold(two, start, trees, rate, precision, BY_CHANCE[kind]))
    return out


def find_pii(docs: DataFrame, *, precision: float = 0.9, rate: float = 0.4, id_col: str = "doc_id", text_col: str = "text", source_col: str | None = None) -> DataFrame:
    """Counts and spans of personal data, a row for each document.

    doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256 (of the base spans as
    written), spans (all spans as written: kind:start:end in code points, by kind, then start),
    n_added. ``source_col`` names who wrote a text; it takes part in the counts alone. Null and empty texts have no spans; repeated ids stay apart. Two narrow passes:
    one counts candidates to train, one finds and selects; neither shuffles texts.
    """
    source = (docs[source_col] if source_col else F.lit(None)).cast("string").alias("source")
    rows = picked(docs, id_col, text_col, source).withColumn("text", F.coalesce("text", F.lit("")))
    models = trained(rows, precision=precision, rate=rate)
    base = {k: F.filter(proposed(F.col("text"), k, False), lambda x: x["ok"]) for k in KINDS}
    rows = rows.select(
        "doc_id",
        *(F.transform(base[k], lambda x: F.struct(x["k"], x["s"], x["e"])).alias(f"b_{k}") for k in KINDS),
        *(F.filter(proposed(F.col("text"), k, True), lambda x: x["ok"]).alias(f"w_{k}") for k in KINDS),
    )
    every = F.concat(*(F.col(f"b_{k}") for k in KINDS))

    def selected(kind: str) -> Column:
        start, trees, least = models[kind]
        if math.isinf(least):
            return F.filter(F.col(f"b_{kind}"), lambda _: F.lit(False))

        def score(f: Column) -> Column:
            z = F.lit(start)
            for t in trees:
                z = z + F.lit(rate) * _as_column(t, f)
            return z

        fits = F.filter(
            F.col(f"w_{kind}"),
            lambda x: (score(x["f"]) >= least - 1e-9) & ~F.exists(every, lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])),
        )
        return F.transform(fits, lambda x: F.struct(x["k"], x["s"], x["e"]))

    rows = rows.select(
        "doc_id", *(F.col(f"b_{k}") for k in KINDS), *(selected(k).alias(f"a_{k}") for k in KINDS)
    )
    all_spans = F.concat(*(F.array_sort(F.concat(F.col(f"b_{k}"), F.col(f"a_{k}"))) for k in KINDS))
    return rows.select(
        "doc_id", *(F.size(f"b_{k}").cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(written(every), 256).alias("base_sha256"), written(all_spans).alias("spans"),
        sum((F.size(f"a_{k}") for k in KINDS), F.lit(0)).cast("long").alias("n_added"),
    )
