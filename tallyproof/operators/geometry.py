"""From positioned words to lines and money columns. All windows are keyed by (document, page)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import let

PAGE = ["doc_id", "page"]


def page_skew(words: DataFrame, *more: Column) -> DataFrame:
    """Slope of the base lines (0 unless strong) and the line tolerance of each page.

    The slope counts for 40 words or more, spread in both directions, R-squared of 0.5 or
    more and at most 0.25. The tolerance is 0.45 of the upper median height, 2 at least;
    a median of zero counts as 8. ``more``: further aggregates of the page.
    """
    x, y = (F.col("x0") + F.col("x1")) / 2, F.col("bottom")
    height = F.col("bottom") - F.col("top")
    page = words.groupBy(*PAGE).agg(
        F.count("*").alias("n"), F.regr_slope(y, x).alias("b"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"), F.sort_array(F.collect_list(height)).alias("heights"), *more,
    )
    strong = (F.col("n") >= 40) & (F.col("sxx") >= 1e-6) & (F.col("syy") >= 1e-6) & (F.col("r2") >= 0.5) & (F.abs("b") <= 0.25)
    median = F.get("heights", (F.floor(F.col("n") / 2)).cast("int"))
    median = F.when(median == 0, 8.0).otherwise(median)
    return page.select(
        *PAGE, "n", F.when(strong, F.col("b")).otherwise(0.0).alias("slope"), F.greatest(F.lit(2.0), median * 0.45).alias("tol"),
        *page.columns[len(PAGE) + 6 :],
    )


def gap_islands(rows: DataFrame, keys: list[str], value: Column, ties: list[str], tol: Column, name: str) -> DataFrame:
    """Numbers runs of rows (from 1) whose neighbours in ``value`` order are no further apart than ``tol``."""
    w = Window.partitionBy(*keys).orderBy("_v", *ties)
    rows = rows.withColumn("_v", value)
    new = F.coalesce(F.col("_v") - F.lag("_v").over(w) > tol, F.lit(True))
    return rows.withColumn("_new", new.cast("int")).withColumn(name, F.sum("_new").over(w)).drop("_new", "_v")


def group_lines(words: DataFrame) -> DataFrame:
    """D3: words with line_no and v (the top after the slope is taken out)."""
    pages = page_skew(words).select(*PAGE, "slope", "tol")
    placed = words.join(pages, PAGE).withColumn("v", F.col("top") - F.col("slope") * (F.col("x0") + F.col("x1")) / 2)
    return gap_islands(placed, PAGE, F.col("v"), ["word_idx"], F.col("tol"), "line_no").drop("slope", "tol")


def line_text(lined: DataFrame) -> DataFrame:
    """One row a line: its words from left to right, the text and the top."""
    fields = ["x0", "v", "word_idx", "x1", "top", "bottom", "text"]
    return lined.groupBy(*PAGE, "line_no").agg(
        F.sort_array(F.collect_list(F.struct(*fields))).alias("words"), F.min("top").alias("top")
    ).select(*PAGE, "line_no", F.array_join(F.transform("words", lambda w: w["text"]), " ").alias("text"), "top", "words")


def _runs(values: Column, at, tol: Column) -> Column:
    """A sorted array cut where neighbours' ``at`` lie further apart than ``tol``: an array of arrays."""
    n = F.size(values)
    cuts = F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i == 0) | (at(F.get(values, i)) - at(F.get(values, i - 1)) > tol))

    def cut(c: Column) -> Column:
        return F.transform(c, lambda a, k: F.slice(values, a + 1, F.coalesce(F.get(c, k + 1), n) - a))

    return F.when(n > 0, let(cuts, cut))


def page_lines(words: DataFrame) -> DataFrame:
    """D1-D4 in one shuffle: one row a page, with its lines as an array of struct(line_no, text, words).

    The same lines as line_text(group_lines(words)); a page is put together once, so no table joins back to its words.
    """
    fields = ["x0", "v", "word_idx", "x1", "top", "bottom", "text"]
    pages = page_skew(words, F.collect_list(F.struct("top", "word_idx", "x0", "x1", "bottom", "text")).alias("ws"))
    v = lambda w: w["top"] - F.col("slope") * (w["x0"] + w["x1"]) / 2
    placed = F.sort_array(F.transform("ws", lambda w: F.struct(v(w).alias("v"), *(w[c].alias(c) for c in ("word_idx", "x0", "x1", "top", "bottom", "text")))))
    line = lambda ws: F.sort_array(F.transform(ws, lambda w: F.struct(*(w[c].alias(c) for c in fields))))
    grouped = let(placed, lambda p: F.transform(_runs(p, lambda w: w["v"], F.col("tol")), line))
    said = lambda ws: F.array_join(F.transform(ws, lambda w: w["text"]), " ")
    lines = F.transform(grouped, lambda ws, k: F.struct((k + 1).alias("line_no"), said(ws).alias("text"), ws.alias("words")))
    return pages.select(*PAGE, lines.alias("lines"))


def page_centers(edges: Column, tol: float = 6.0) -> Column:
    """D5 for a page's right edges as an array: the centres from left to right. Clusters of one edge go, unless there is no other."""
    clusters = lambda e: F.transform(
        _runs(e, lambda x: x, F.lit(tol)), lambda c: F.struct((F.aggregate(c, F.lit(0.0), lambda a, x: a + x) / F.size(c)).alias("center"), F.size(c).alias("n"))
    )
    kept = lambda cs: F.filter(cs, lambda c: (c["n"] >= 2) | (F.array_max(F.transform(cs, lambda x: x["n"])) < 2))
    return F.coalesce(let(F.sort_array(edges), lambda e: F.transform(let(clusters(e), kept), lambda c: c["center"])), F.array().cast("array<double>"))


# The words that head money columns, and those of them that make a line a header.
HEADER_WORDS = ("credits", "debits", "balance", "amount", "deposits", "withdrawals", "additions", "subtractions", "charges")
DIRECTION_WORDS = ("credits", "debits", "withdrawals", "balance")


def header_words(words: Column) -> Column:
    """struct(name, mid) of the words of a column header's line; none unless two names stand there, one of them a direction."""
    name = lambda w: F.regexp_replace(F.lower(w["text"]), r"^[():]+|[():]+$", "")
    found = F.filter(F.transform(words, lambda w: F.struct(name(w).alias("name"), ((w["x0"] + w["x1"]) / 2).alias("mid"))), lambda h: h["name"].isin(*HEADER_WORDS))

    def header(f: Column) -> Column:
        names = F.array_distinct(F.transform(f, lambda h: h["name"]))
        return F.when((F.size(names) >= 2) & F.exists(names, lambda n: n.isin(*DIRECTION_WORDS)), f).otherwise(F.slice(f, 1, 0))

    return let(found, header)


def center_labels(centers: Column, headers: Column, reach: float = 80.0) -> Column:
    """D8 for a page: the nearest header word of each centre (array of string, null beyond ``reach``); the first of two as near."""
    near = lambda c: F.array_min(
        F.filter(F.transform(headers, lambda h, i: F.struct(F.abs(h["mid"] - c).alias("far"), i.alias("i"), h["name"].alias("name"))), lambda s: s["far"] < reach)
    )
    return F.transform(centers, lambda c: near(c)["name"])


def date_led_edges(lines: DataFrame) -> DataFrame:
    """The right edges that make columns: those of the figures on lines that a date leads.

    ``lines``: page keys, line_no, scan (as from statement.row_scan). Result: page keys, edge_id, x1.
    """
    dated = lines.filter("scan.date is not null").select(*PAGE, "line_no", F.posexplode("scan.moneys").alias("i", "m"))
    return dated.select(*PAGE, (F.col("line_no") * 1000 + F.col("i")).alias("edge_id"), F.col("m.x1").alias("x1"))


def money_columns(edges: DataFrame, tol: float = 6.0) -> DataFrame:
    """Centres of right-edge clusters of a page, from left to right.

    ``edges``: page keys, edge_id, x1. Clusters of one edge go, unless the page has no other.
    """
    runs = gap_islands(edges, PAGE, F.col("x1"), ["edge_id"], F.lit(tol), "run")
    clusters = runs.groupBy(*PAGE, "run").agg(F.avg("x1").alias("center"), F.count("*").alias("n"))
    most = F.max("n").over(Window.partitionBy(*PAGE))
    return clusters.withColumn("most", most).filter("n >= 2 or most < 2").select(*PAGE, "center", "n")


def nearest_column(edges: DataFrame, columns: DataFrame, reach: float = 7.0) -> DataFrame:
    """Each edge with the nearest centre of its page within ``reach``; the left one of two as near; else null.

    The centres travel as one array a page, so this is an equi-join without a range condition.
    """
    arrays = columns.groupBy(*PAGE).agg(F.collect_list("center").alias("centers"))
    near = F.array_min(
        F.filter(
            F.transform("centers", lambda c: F.struct(F.abs(c - F.col("x1")).alias("far"), c.alias("center"))),
            lambda s: s["far"] <= reach,
        )
    )
    return edges.join(arrays, PAGE, "left").withColumn("center", near["center"]).drop("centers")


def balance_column(columns: DataFrame) -> DataFrame:
    """The right-most centre of each page that has two or more."""
    return columns.groupBy(*PAGE).agg(F.max("center").alias("center"), F.count("*").alias("n")).filter("n >= 2").drop("n")


def column_labels(columns: DataFrame, headers: DataFrame, reach: float = 80.0) -> DataFrame:
    """The nearest header word of each centre, if nearer than ``reach``; only on pages of two centres or more.

    ``headers``: page keys, header_seq, name, mid.
    """
    many = columns.withColumn("_n", F.count("*").over(Window.partitionBy(*PAGE))).filter("_n >= 2").drop("_n")
    far = F.abs(F.col("mid") - F.col("center"))
    return (
        many.join(headers, PAGE).withColumn("far", far).filter(F.col("far") < reach)
        .groupBy(*PAGE, "center").agg(F.min_by("name", F.struct("far", "header_seq")).alias("label"))
    )


def ocr_words(boxes: DataFrame, dpi: float = 300.0) -> DataFrame:
    """A3: pixel boxes of a scan as word boxes in points; blank words and negative confidences go."""
    k = 72.0 / dpi
    return boxes.filter((F.length(F.trim("text")) > 0) & (F.col("conf") >= 0)).select(
        *PAGE, "word_idx", "text", (F.col("left") * k).alias("x0"), ((F.col("left") + F.col("width")) * k).alias("x1"),
        (F.col("top") * k).alias("top"), ((F.col("top") + F.col("height")) * k).alias("bottom"), "conf",
    )


def ocr_lines(words: DataFrame, bucket: float = 8.0) -> DataFrame:
    """Text of a scan by buckets of 8 points."""
    return words.groupBy(*PAGE, F.floor(F.col("top") / bucket).alias("bucket")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "word_idx", "text"))), lambda w: w["text"]), " ").alias("text")
    )


def ocr_confidence(words: DataFrame) -> DataFrame:
    """Mean of the pages' mean confidences as a rounded percent, ``n/a`` where no word has one; pages without words don't count."""
    pages = words.groupBy(*PAGE).agg(F.avg("conf").alias("c"))
    return pages.groupBy("doc_id").agg(F.avg("c").alias("mean")).select(
        "doc_id", F.coalesce(F.concat(F.round("mean").cast("int").cast("string"), F.lit("%")), F.lit("n/a")).alias("conf"), "mean"
    )
