"""Proofs of ledgers by their own printed figures.

A ledger holds one row a movement: block keys, an order, amount (null: unread), the printed
balance after the row (null: none), and the block's beginning and ending. Nothing here
changes a figure. All windows and groups are keyed by the block, so one shuffle serves them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import MONEY, printed
from . import scan

TOLERANCE = 0.01


def _far(a: Column, b: Column) -> Column:
    return F.abs(a - b) > F.lit(TOLERANCE).cast(MONEY)


def with_segments(rows: DataFrame, keys: list[str], order: list[str], closes: Column) -> DataFrame:
    """Adds seg: how many closing rows stand before the row in its group. Serves chains and printed totals alike.

    Rows with a column ``chunk`` (from scan.chunked) are counted in two levels, so that no task holds a whole group.
    """
    if scan.CHUNK in rows.columns:
        return scan.count_before(rows, keys, order, closes.cast("int"), "seg")
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("seg", F.coalesce(F.sum(F.when(closes, 1).otherwise(0)).over(before), F.lit(0)))


def chain_segments(ledger: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """the rows between printed balances, one row a segment.

    keys, seg, opening, closing, move, n, state: ``OK`` if the rows sum to the difference of
    the balances (to the cent, tolerance included), ``NEEDS_REVIEW`` if not, ``UNCHECKED`` if a
    balance is missing or the segment holds an unread amount. An unread amount restarts
    the chain from its own printed balance.
    """
    return _segments(ledger, keys, order).select(*keys, "seg", "opening", "closing", "move", "n", "state")


def _segments(ledger: DataFrame, keys: list[str], order: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """chain_segments, with the segment's rows, its block's balances, the greatest of each column of ``carry``, and marked: rows whose amount is unread or whose own status (column ``status``, if there is one) asks for a review."""
    rows = with_segments(ledger, keys, order, F.col("balance").isNotNull() | F.col("amount").isNull())
    doubtful = F.col("amount").isNull() | (F.col("status") == "NEEDS_REVIEW" if "status" in ledger.columns else F.lit(False))
    groups = rows.groupBy(*keys, "seg").agg(
        F.sum(F.coalesce(doubtful, F.lit(False)).cast("int")).alias("marked"), F.max("beginning").alias("beginning"), F.sum("amount").cast(MONEY).alias("move"), F.count("amount").alias("n"),
        F.max("balance").alias("closing"), F.max(F.col("amount").isNull().cast("int")).alias("broken"), F.count("*").alias("rows"),
        (F.max("ending") if "ending" in ledger.columns else F.lit(None).cast(MONEY)).alias("ending"), *(F.max(c).alias(c) for c in carry),
    )
    if scan.CHUNK in ledger.columns:  # by a join of neighbours, as a window would hold all segments of a block
        prior = groups.select(*keys, (F.col("seg") + 1).alias("seg"), F.col("closing").alias("_last"))
        groups, last = groups.join(prior, [*keys, "seg"], "left"), F.col("_last")
    else:
        last = F.lag("closing").over(Window.partitionBy(*keys).orderBy("seg"))
    groups = groups.withColumn("opening", F.when(F.col("seg") == 0, F.col("beginning")).otherwise(last))
    state = (
        F.when((F.col("broken") == 1) | F.col("closing").isNull() | F.col("opening").isNull(), "UNCHECKED")
        .when(_far(F.col("move"), F.col("closing") - F.col("opening")), "NEEDS_REVIEW")
        .otherwise("OK")
    )
    return groups.withColumn("state", state)


def _chain_note(amount: Column) -> Column:
    """A failing segment's reason in figures, from its columns opening, closing, move and n."""
    moved = F.col("closing") - F.col("opening")
    single = F.concat(
        F.lit("Amount "), printed(amount), F.lit(" against a balance change of "), printed(moved),
        F.lit(": "), printed(F.col("opening")), F.lit(" before, "), printed(F.col("closing")), F.lit(" after."),
    )
    group = F.concat(
        F.col("n").cast("string"), F.lit(" amounts add up to "), printed(F.col("move")), F.lit("; from balance "), printed(F.col("opening")),
        F.lit(" to balance "), printed(F.col("closing")), F.lit(" it should be "), printed(moved), F.lit("."),
    )
    return F.when(F.col("n") == 1, single).otherwise(group)


def chain_flags(ledger: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """the ledger with status and note; every row of a failing segment carries its reason in figures."""
    rows = with_segments(ledger, keys, order, F.col("balance").isNotNull() | F.col("amount").isNull())
    segments = chain_segments(ledger, keys, order).select(*keys, "seg", "opening", "closing", "move", "n", F.col("state"))
    note = F.when(F.col("state") == "NEEDS_REVIEW", _chain_note(F.col("amount")))
    return rows.join(segments, [*keys, "seg"]).select(
        *ledger.columns, "seg", F.when(F.col("state") == "NEEDS_REVIEW", "NEEDS_REVIEW").otherwise("OK").alias("status"),
        F.coalesce(note, F.lit("")).alias("note"),
    )


def chain_notes(rows: DataFrame, within: list[str], order: list[str], chain: Column, amount: Column, balance: Column, beginning: Column) -> DataFrame:
    """F2 without a join, for chains that follow one another in the ``order`` of what lies together by ``within``: ``rows`` with note, null where chain_flags says OK.

    ``chain``: the number of a row's chain, null for rows of none. A segment closes with its one printed balance, so its opening is the balance that the
    last segment of the chain closed with. One sort by the segments is all that rows in that order need.
    """
    columns = rows.columns
    rows = rows.withColumns({"_chain": chain, "_amount": amount, "_balance": balance})
    closes = F.col("_chain").isNotNull() & (F.col("_balance").isNotNull() | F.col("_amount").isNull())
    before = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(closes, F.struct("_chain", "_balance")), ignorenulls=True).over(before)
    rows = with_segments(rows, within, order, closes).withColumn("_last", last)
    segment = Window.partitionBy(*within, "_chain", "seg")
    rows = rows.withColumns({
        "opening": F.when(F.col("_last._chain") == F.col("_chain"), F.col("_last._balance")).otherwise(beginning), "closing": F.max("_balance").over(segment),
        "move": F.sum("_amount").over(segment).cast(MONEY), "n": F.count("_amount").over(segment), "_broken": F.max(F.col("_amount").isNull().cast("int")).over(segment),
    })
    wrong = F.col("_chain").isNotNull() & (F.col("_broken") == 0) & _far(F.col("move"), F.col("closing") - F.col("opening"))
    return rows.select(*columns, F.when(wrong, _chain_note(F.col("_amount"))).alias("note"))


def block_proof(ledger: DataFrame, keys: list[str], order: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """one row a block: n, total, passed (true, false or null: not provable), detail, flagged.

    Both balances printed: beginning + movements against ending. Else the chain, if any of its
    segments could be checked: it proves only if no row is flagged. Else null. Flagged are the rows of
    failing segments, unread amounts, and rows whose ``status`` asks for a review. ``carry``: columns that are one to a block. One
    shuffle by the keys serves all of it.
    """
    blocks = _segments(ledger, keys, order, carry).groupBy(*keys).agg(
        F.max("beginning").alias("beginning"), F.max("ending").alias("ending"), F.sum("n").alias("n"), F.coalesce(F.sum("move"), F.lit(0)).cast(MONEY).alias("total"), F.sum("rows").alias("rows"),
        F.max((F.col("state") != "UNCHECKED").cast("int")).alias("checked"), F.sum(F.when(F.col("state") == "NEEDS_REVIEW", F.col("n")).otherwise(F.col("marked"))).alias("flagged"),
        *(F.max(c).alias(c) for c in carry),
    )
    expected = (F.col("beginning") + F.col("total")).cast(MONEY)
    both = F.col("beginning").isNotNull() & F.col("ending").isNotNull()
    passed = F.when(both, ~_far(expected, F.col("ending"))).when(F.col("checked") == 1, F.col("flagged") == 0)
    count = F.concat(F.lit(" ("), F.col("n").cast("string"), F.lit(" amounts)"))
    head = F.concat(printed(F.col("beginning")), F.lit(" + "), printed(F.col("total")), count, F.lit(" = "), printed(expected))
    detail = (
        F.when(both & passed, F.concat(head, F.lit(", as printed at the end.")))
        .when(both, F.concat(head, F.lit(", printed at the end is "), printed(F.col("ending")), F.lit(", off by "), printed(F.col("ending") - expected), F.lit(".")))
        .when(passed, F.lit("Each printed running balance follows from the amounts before it."))
        .when(~passed, F.lit("Running balances and amounts disagree, or amounts are unread: see the marked rows."))
        .otherwise(F.lit("Neither two end balances nor a running balance is printed: nothing proves the amounts."))
    )
    return blocks.select(*keys, "rows", "n", "total", "beginning", "ending", "flagged", passed.alias("passed"), detail.alias("detail"), *carry)


def section_mismatches(ledger: DataFrame, printed_totals: DataFrame, keys: list[str]) -> DataFrame:
    """printed totals that the rows of their section in the same block don't reach.

    ``printed_totals``: keys, name, amount. A section counts if it holds the first twenty
    characters of the name, in any case; a total without rows is left out.
    """
    named = printed_totals.withColumn("head", F.substring(F.lower("name"), 1, 20))
    rows = ledger.filter("amount is not null and section <> ''").groupBy(*keys, F.lower("section").alias("section")).agg(
        F.sum(F.abs("amount")).alias("s")
    )  # one row a section before the join
    return (
        named.join(rows, keys).filter(F.contains("section", "head"))
        .groupBy(*keys, "name", F.col("amount").alias("printed")).agg(F.sum("s").cast(MONEY).alias("found"))
        .filter(_far(F.col("found"), F.col("printed")))
    )


def group_mismatch(n: Column, total: Column, printed_n: Column, printed_sum: Column) -> Column:
    """What a printed total gets wrong: the count, else the sum, else null."""
    return F.when(n != printed_n, "count").when(_far(total, printed_sum), "sum")


def printed_group_totals(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows since the last printed total against its count, then (counts agreeing) its sum.

    ``rows``: keys, order, amount; total rows carry printed_n and printed_sum instead of an
    amount. One row a total: seg, n, total, printed_n, printed_sum, mismatch (count, sum or null).
    """
    is_total = F.col("printed_n").isNotNull()
    marked = with_segments(rows, keys, order, is_total)
    mismatch = group_mismatch(*map(F.col, ("n", "total", "printed_n", "printed_sum")))
    return marked.groupBy(*keys, "seg").agg(
        F.count("amount").alias("n"), F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("total"),
        F.max("printed_n").alias("printed_n"), F.max("printed_sum").alias("printed_sum"),
    ).filter("printed_n is not null").withColumn("mismatch", mismatch)


def document_outcome(blocks: DataFrame, keys: list[str], detail: bool = True) -> DataFrame:
    """one row a document: rows, flagged, state (proven, unproven, failed), verdict and (if asked for) detail.

    ``blocks``: keys, block, block_name, rows, flagged, passed, detail, complete, and ``reason`` (why a read is
    incomplete, else null) if it is known.
    """
    passed, failed = F.min(F.coalesce("passed", F.lit(False))), F.max(~F.coalesce("passed", F.lit(True)))
    reason = F.max("reason") if "reason" in blocks.columns else F.lit(None).cast("string")
    parts = F.sort_array(F.collect_list(F.struct("block", "block_name", "detail"))) if detail else F.lit(None).cast("array<struct<block:int,block_name:string,detail:string>>")
    rows = blocks.groupBy(*keys).agg(
        F.sum("rows").alias("rows"), F.sum("flagged").alias("flagged"), passed.alias("all_passed"), failed.alias("any_failed"),
        F.min("complete").alias("complete"), reason.alias("reason"), parts.alias("parts"),
    )
    proven = F.col("all_passed") & (F.col("flagged") == 0) & F.col("complete")
    many = F.size("parts") > 1
    texts = F.transform("parts", lambda p: F.when(many, F.concat_ws(": ", p["block_name"], p["detail"])).otherwise(p["detail"]))
    incomplete = F.when(~F.col("complete"), F.concat_ws(": ", F.lit("INCOMPLETE READ"), "reason"))
    return rows.select(
        *keys, "rows", "flagged",
        F.when(F.col("rows") == 0, "failed").when(proven, "proven").otherwise("unproven").alias("state"),
        F.when(proven, "PASSED").when(F.col("any_failed"), "FAILED").otherwise("NOT PROVABLE").alias("verdict"),
        *([F.concat_ws(" | ", incomplete, F.array_join(texts, " | ")).alias("detail")] if detail else []),
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """F8: documents by state, with each state's severity (proven 0, unproven 1, failed 2)."""
    severity = F.when(F.col("state") == "proven", 0).when(F.col("state") == "unproven", 1).otherwise(2)
    return outcomes.groupBy("state").agg(F.count("*").alias("documents")).withColumn("severity", severity)


def run_severity(outcomes: DataFrame) -> DataFrame:
    """F8: one row: documents, severity of the worst state, 3 where there was no document at all."""
    severity = F.when(F.col("state") == "proven", 0).when(F.col("state") == "unproven", 1).otherwise(2)
    return outcomes.agg(F.count("*").alias("documents"), F.coalesce(F.max(severity), F.lit(3)).alias("severity"))


def pages_read(statements: DataFrame, keys: list[str]) -> DataFrame:
    """pages read of each document: of each statement up to its stopping page. ``statements``: keys, stop_page (null: none), pages."""
    return statements.groupBy(*keys).agg(F.sum(F.least(F.coalesce("stop_page", "pages"), F.col("pages"))).alias("pages_read"), F.sum("pages").alias("pages"))


def unexpected_states(outcomes: DataFrame, expected: list[str]) -> DataFrame:
    """The states that a run must not end in, with their documents; no rows where all is as expected."""
    return outcomes.filter(~F.coalesce(F.col("state").isin(expected), F.lit(False))).groupBy("state").agg(F.count("*").alias("documents"))
