"""Secret scans with corpus-wide ownership, in DataFrame functions.

Candidates are spans of three base formats and of further ones (service keys by prefix,
long mixed tokens). Each candidate's value is hashed; over the whole corpus a hash is
counted by distinct repositories (documents) and owners (sources). Values that many owners
hold are copied examples; values of one or two owners that look random are live, in however
many of their repositories they stand. Base spans
always stay; further candidates are added where they look live and overlap no base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .spans import let, located, no_spans, written

KINDS = ("assign", "access", "hex")
BASE = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""",
    "access": r"AKIA[A-Z0-9]++",
    # Runs shorter than 24 would be dropped: a possessive run of 24 or more finds the same spans.
    "hex": r"(?<![0-9a-f])[0-9a-f]{24,}+",
}
NEEDS = {
    "assign": lambda t: t.rlike("(?i:passw|secret|token|api_?key)"),
    "access": lambda t: F.contains(t, F.lit("AKIA")),
    "hex": lambda t: t.rlike("[0-9a-f]{24}"),
}
#: Formats beyond the base: keys with a service's prefix, signed tokens, long tokens of mixed signs.
FURTHER = (
    r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{20,}+|github_pat_[A-Za-z0-9_]{20,}+|glpat-[A-Za-z0-9_-]{16,}+"
    r"|xox[abprs]-[A-Za-z0-9-]{10,}+|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{30,}+"
    r"|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{6,}+|[A-Za-z0-9+/_-]{28,}+)"
)
PREFIXED = r"^(?:gh[pousr]_|github_pat_|glpat-|xox[abprs]-|[sr]k_(?:live|test)_|AIza|eyJ)"


def base_spans(text: Column) -> Column:
    """array<struct<k, s, e, v>> of the base formats, by start, then kind as listed; v is the secret value."""

    def of_kind(order: int, kind: str) -> Column:
        found = F.when(NEEDS[kind](text), located(text, BASE[kind], int(kind == "assign"))).otherwise(no_spans())
        least = {"assign": 6, "access": 20, "hex": 24}[kind]
        return F.transform(
            F.filter(found, lambda x: F.length(x["g"]) >= least),
            lambda x: F.struct(x["s"], F.lit(order).alias("o"), F.lit(kind).alias("k"), x["e"], x["g"].alias("v")),
        )

    parts = [of_kind(i, kind) for i, kind in enumerate(KINDS)]
    return F.transform(F.array_sort(F.concat(*parts)), lambda x: F.struct(x["k"], x["s"], x["e"], x["v"]))


def looks_random(v: Column) -> Column:
    """Several kinds of signs and many different ones."""
    kinds = v.rlike("[a-z]").cast("int") + v.rlike("[A-Z]").cast("int") + v.rlike("[0-9]").cast("int")
    different = F.size(F.array_distinct(F.split(v, "")))
    return (kinds >= 2) & v.rlike("[0-9]") & (different >= F.least(F.lit(12), F.length(v) / 2))


def further_spans(text: Column) -> Column:
    """Candidates beyond the base, as struct<k, s, e, v>."""
    found = F.when(text.rlike("[A-Za-z0-9+/_.-]{15}"), located(text, FURTHER)).otherwise(no_spans())
    likely = F.filter(found, lambda x: x["m"].rlike(PREFIXED) | looks_random(x["m"]))
    return F.transform(likely, lambda x: F.struct(F.lit("live").alias("k"), x["s"], x["e"], x["m"].alias("v")))


def ownership(candidates: DataFrame) -> DataFrame:
    """hash -> repositories, owners, over all candidates.

    A value pasted into very many documents shrinks before each shuffle: to one row a
    repository in each task, then to one a owner, then to one.
    """
    return (
        candidates.select("hash", "owner", "repo").distinct()
        .groupBy("hash", "owner").agg(F.count("*").alias("n"))
        .groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))
    )


def find_secrets(
    docs: DataFrame, *, most_owners: int = 2, id_col: str = "doc_id", text_col: str = "text",
    owner_col: str = "source", keep: tuple[str, ...] = (),
) -> DataFrame:
    """Counts and spans of secrets, a row for each document.

    doc_id, n_assign, n_access, n_hex (base spans), base_sha256 (of the base spans as written),
    spans (all spans as written: kind:start:end in code points, by start; added ones have the
    kind ``live``), n_live and n_copied (spans whose value looks live, or is held by more
    than ``most_owners`` owners), places (array of
    start and end) and the columns of ``keep`` as they were. Null and empty texts have no
    spans; a null owner counts as one owner; repeated ids stay apart. The spans are
    found once and written without texts (unless kept); only candidates are shuffled.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    found = stored(
        docs.select(
            F.monotonically_increasing_id().alias("_rid"), docs[id_col].try_cast("long").alias("_id"),
            docs[owner_col].cast("string").alias("_owner"), base_spans(text).alias("_base"), further_spans(text).alias("_more"),
            *(docs[c].alias(f"_keep_{c}") for c in keep),
        ),
        "secrets",
    )
    apart = F.filter("_more", lambda x: ~F.exists("_base", lambda y: (y["s"] < x["e"]) & (x["s"] < y["e"])))
    one = found.select(
        "_rid", F.coalesce(F.col("_owner"), F.lit("")).alias("owner"), F.col("_id").alias("repo"),
        F.explode(F.concat("_base", apart)).alias("c"),
    ).withColumn("hash", F.xxhash64("c.v"))
    live = F.col("owners") <= most_owners  # repositories grow with the corpus and with copies of one text; owners judge
    # Written first, one row a hash: the join then meets a plain table and can split the rows of a widespread hash.
    verdicts = stored(ownership(one).select("hash", live.alias("live")), "verdicts")
    judged = (
        one.select("_rid", "c", "hash").join(verdicts, "hash")
        .select("_rid", "c", "live", looks_random(F.col("c.v")).alias("random"))
        .filter("live or c.k <> 'live'")  # copied candidates beyond the base are no secrets
        .groupBy("_rid").agg(
            F.array_sort(F.collect_list(F.struct("c.s", F.array_position(F.array(*(F.lit(k) for k in (*KINDS, "live"))), F.col("c.k")).alias("o"), "c.k", "c.e"))).alias("_all"),
            F.sum((F.col("live") & F.col("random")).cast("long")).alias("n_live"), F.sum((~F.col("live")).cast("long")).alias("n_copied"),
        )
    )
    count = lambda k: F.size(F.filter("_base", lambda x: x["k"] == k)).cast("long").alias(f"n_{k}")
    return found.join(judged, "_rid", "left").select(
        F.col("_id").alias("doc_id"), *(count(k) for k in KINDS),
        F.sha2(written(F.col("_base")), 256).alias("base_sha256"), F.coalesce(written(F.col("_all")), F.lit("")).alias("spans"),
        F.coalesce("n_live", F.lit(0)).alias("n_live"), F.coalesce("n_copied", F.lit(0)).alias("n_copied"),
        F.transform("_all", lambda x: F.struct(x["s"], x["e"])).alias("places"),
        *(F.col(f"_keep_{c}").alias(f"kept_{c}") for c in keep),
    )


def masked(text: Column, places: Column, mark: str = "[secret]") -> Column:
    """The text with every place (array of s and e, by start) replaced by the mark; overlapping places are one."""
    merged = F.aggregate(
        places,
        F.from_json(F.lit("[]"), "array<struct<s:int,e:int>>"),
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(a, F.lit(-1))["e"] > x["s"]),
            F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(F.element_at(a, F.lit(-1))["s"].alias("s"), F.greatest(F.element_at(a, F.lit(-1))["e"], x["e"]).alias("e")))),
        ).otherwise(F.concat(a, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"))))),
    )
    pieces = lambda m: F.concat(
        F.transform(
            m, lambda x, i: F.substring(text, F.when(i == 0, 0).otherwise(F.get(m, i - 1)["e"]) + 1, x["s"] - F.when(i == 0, 0).otherwise(F.get(m, i - 1)["e"]))
        ),
        F.array(F.substring(text, F.element_at(m, F.lit(-1))["e"] + 1, F.length(text))),
    )
    return F.when(F.coalesce(F.size(places), F.lit(0)) <= 0, text).otherwise(let(merged, lambda m: F.array_join(pieces(m), mark)))
