"""Statements end to end: positioned words of pages to signed, dated ledgers, their proofs and each document's outcome.

A corpus mixes issuers and bundles: a document may hold several statements, each is read by the profile that its own
head tells, and each may hold several accounts. Steps, with what they shuffle:

1. words to pages with their lines, money columns and header labels (words, by page);
2. statements, profiles and periods from facts of pages (narrow rows, by document), joined to the pages;
3. lines with all that their profile's patterns say of them, written once;
4. account events of each statement, a few lines a page, folded in order;
5. lines and fold results together, by statement: windows carry sections, boxes, accounts and open rows along,
   and groups make rows of them. Proofs of accounts are groups of the same partitioning.

A bundle's statements are apart from step 3 on, so a document of any number of them is many groups.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import FIGURE_IN_TEXT, MONEY, collapsed, letters, money, resolve_year, squashed
from ..sources.tables import shared_table
from . import documents, geometry, reconcile, statement
from .profiles import Profile, best_profile, by_profile, confidence, flag, says

STATEMENT = ["doc_id", "stmt_no"]
BLOCK = [*STATEMENT, "block_no"]


def _profiles(profiles: Profile | Sequence[Profile]) -> list[Profile]:
    return [profiles] if isinstance(profiles, Profile) else list(profiles)


def statement_pages(words: DataFrame) -> DataFrame:
    """A row a page: lines (line_no, text, scan), centers, headings of columns, and what its text says of statements and periods."""
    pages = geometry.page_lines(words)
    some = "(?i)" + "|".join(geometry.HEADER_WORDS)
    none = F.array().cast("array<struct<name:string,mid:double>>")
    headers_of = lambda l: F.when(l["text"].rlike(some), geometry.header_words(l["words"])).otherwise(none)
    scanned = F.transform("lines", lambda l: F.struct(
        l["line_no"].alias("line_no"), l["text"].alias("text"), statement.row_scan(l["words"]).alias("scan"), headers_of(l).alias("headers"),
    ))
    pages = pages.select(*geometry.PAGE, scanned.alias("lines"))
    edges = F.flatten(F.transform(F.filter("lines", lambda l: l["scan"]["date"].isNotNull()), lambda l: F.transform(l["scan"]["moneys"], lambda m: m["x1"])))
    pages = pages.withColumn("centers", geometry.page_centers(edges)).withColumn("text", F.array_join(F.transform("lines", lambda l: l["text"]), "\n"))
    headers = F.flatten(F.transform("lines", lambda l: l["headers"]))
    return pages.select(
        *geometry.PAGE, "centers", _lone(F.col("lines"), F.col("centers")).alias("lone"), geometry.center_labels(F.col("centers"), headers).alias("labels"), documents.starts_statement(F.col("text")).alias("starts"),
        F.substring("text", 1, documents.HEAD).alias("head"), F.length("text").alias("n_chars"), documents.period_marks(F.col("text")).alias("marks"),
        F.transform("lines", lambda l: l.dropFields("headers")).alias("lines"),
    )


def _lone(lines: Column, centers: Column, reach: float = 7.0) -> Column:
    """The right edge of a last figure that stands alone, right of a page's only column and behind another figure of its dated line; null if there is none.

    One edge makes no column (D5), but where an issuer prints running balances this is the one balance of its page.
    """
    several = F.filter(lines, lambda l: l["scan"]["date"].isNotNull() & (F.size(l["scan"]["moneys"]) >= 2))
    lasts = F.transform(several, lambda l: F.try_element_at(l["scan"]["moneys"], F.lit(-1))["x1"])
    return F.when(F.size(centers) == 1, F.array_max(F.filter(lasts, lambda x: x > F.get(centers, F.lit(0)) + reach)))


def _numbered(pages: DataFrame) -> DataFrame:
    """B5 on page facts: stmt_no, and how many characters of the statement stand before the page."""
    order = Window.partitionBy("doc_id").orderBy("page")
    first = F.coalesce(F.col("starts"), F.lit(False)) | (F.row_number().over(order) == 1)
    facts = pages.withColumn("_s", first.cast("int")).withColumn("stmt_no", F.sum("_s").over(order)).drop("_s")
    before = Window.partitionBy(*STATEMENT).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return facts.withColumn("before", F.coalesce(F.sum(F.col("n_chars") + 1).over(before), F.lit(0)))


def statement_facts(pages: DataFrame, profiles: Profile | Sequence[Profile]) -> DataFrame:
    """stmt_no, key, score, confidence, period and label of each statement, one row each.

    ``pages``: as from statement_pages. A single profile is taken without asking the text.
    """
    chosen = _profiles(profiles)
    facts = _numbered(pages.select(*geometry.PAGE, "starts", "n_chars", "head", "marks"))
    head = F.collect_list(F.when(F.col("before") < documents.HEAD, F.struct("page", "head")))
    said = facts.groupBy(*STATEMENT).agg(head.alias("heads"), documents.joined_marks("marks", "page").alias("marks"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))
    text = F.substring(F.array_join(F.transform(F.sort_array("heads"), lambda h: h["head"]), "\n"), 1, documents.HEAD)
    said = said.withColumn("head", text)
    if isinstance(profiles, Profile):
        key, score, sure = F.lit(profiles.key), F.lit(0), F.lit(97)
    else:
        said = said.withColumn("b", best_profile(F.col("head"), [(i, p.key, *f) for i, p in enumerate(chosen) for f in p.fingerprints]))
        key, score, sure = F.coalesce("b.key", F.lit(documents.CATCH_ALL)), F.coalesce("b.score", F.lit(0)), confidence(F.col("b.score"))
    said = said.select(*STATEMENT, "first_page", "last_page", "head", key.alias("key"), score.cast("int").alias("score"), sure.cast("int").alias("confidence"), documents.period_of(F.col("marks")).alias("period"))
    label = by_profile(chosen, lambda p: documents.bundle_label(F.col("head"), list(p.labels)) if p.labels else None, F.lit(None).cast("string"))
    return said.select(*STATEMENT, "first_page", "last_page", "key", "score", "confidence", "period", label.alias("label"))


def statement_lines(words: DataFrame, profiles: Profile | Sequence[Profile]) -> DataFrame:
    """The lines of all statements with what their patterns say, written to the shared folder.

    doc_id, stmt_no, page, line_no, seq, text, key, period, date, description, moneys, amount and balance (E16), label (of the amount's column), dir and
    heading (E3), cls (H heading, S section total, B and E beginning and ending rows, X head of a balance box, else -), marker (name), stop, resume, unread (a row by its looks).
    """
    chosen = _profiles(profiles)
    pages = shared_table(statement_pages(words), "statement-pages")
    facts = statement_facts(pages, profiles)
    numbered = _numbered(pages.select(*geometry.PAGE, "starts", "n_chars")).select(*geometry.PAGE, "stmt_no")
    of_page = numbered.join(facts.select(*STATEMENT, "key", "period", "confidence", F.col("label").alias("stmt_label")), STATEMENT)
    lines = pages.select(*geometry.PAGE, "centers", "lone", "labels", "lines").join(of_page, geometry.PAGE).select("*", F.explode("lines").alias("l")).drop("lines")
    text, n = F.col("text"), F.size("moneys")
    centers = F.when(flag(chosen, "running_balance") & F.col("lone").isNotNull(), F.concat("centers", F.array("lone"))).otherwise(F.col("centers"))
    lines = lines.select(
        *STATEMENT, "page", "key", "period", "confidence", "stmt_label", centers.alias("centers"), "labels", F.col("l.line_no").alias("line_no"), (F.col("page").cast("long") * 1_000_000 + F.col("l.line_no")).alias("seq"),
        F.col("l.text").alias("text"), F.col("l.scan.date").alias("date"), F.col("l.scan.description").alias("description"), F.col("l.scan.moneys").alias("moneys"),
    )
    many = F.size("centers") >= 2
    right = F.when(flag(chosen, "running_balance") & many, F.try_element_at("centers", F.lit(-1)))
    figures = statement.amount_balance(F.col("moneys"), F.col("centers"), right)
    lines = lines.withColumn("f", F.when(n > 0, figures))
    amounts = F.size("centers") - F.when(flag(chosen, "running_balance") & many, 1).otherwise(0)
    label = F.when(amounts >= 2, F.get("labels", F.array_position("centers", F.col("f.column")).cast("int") - 1))
    direction = by_profile(chosen, lambda p: statement.section_direction(text, list(p.credit_headings), list(p.debit_headings)) if p.credit_headings or p.debit_headings else None, F.lit(None).cast("int"))
    begins, ends = statement.begins_block(text, F.col("description")), statement.ends_block(text, F.col("description"))
    box = (n == 0) & text.rlike("(?i)beginning") & text.rlike("(?i)ending")
    cls = (
        F.when(direction.isNotNull(), "H").when(statement.section_total(text).isNotNull(), "S").when(begins, "B").when(ends, "E").when(box, "X").otherwise("-")
    )
    datelike = text.rlike(r"\b\d{1,2}/\d{1,2}(?:/\d{2,4})?\b") & text.rlike(FIGURE_IN_TEXT)
    labelled = lambda which: by_profile(chosen, lambda p: statement.labelled_balance(text, list(getattr(p, which))) if getattr(p, which) else None, F.lit(None).cast(MONEY))
    loose = ~(F.col("date").isNotNull() & (letters(F.col("description")) >= 4)) & (n > 0)
    begin_label = F.when(loose, labelled("begin_labels"))
    lines = lines.select(
        *STATEMENT, "page", "line_no", "seq", "text", "key", "period", "confidence", "stmt_label", "date", "description", "moneys", F.when(F.col("f.amount").isNotNull(), F.struct("f.amount", "f.sign")).alias("amount"),
        F.col("f.balance").alias("balance"), label.alias("label"), direction.alias("dir"), cls.alias("cls"), begin_label.alias("begin_label"),
        F.when(loose & begin_label.isNull(), labelled("end_labels")).alias("end_label"),
        by_profile(chosen, lambda p: statement.marker_name(text, list(p.markers)) if p.markers else None, F.lit(None).cast("string")).alias("marker"),
        F.coalesce(says(chosen, "stops", text), F.lit(False)).alias("stop"), F.coalesce(says(chosen, "resumes", text), F.lit(False)).alias("resume"), F.coalesce(datelike, F.lit(False)).alias("unread"),
        charge_found(chosen, text).alias("charge"),
    )
    return shared_table(lines, "statement-lines")


def charge_found(profiles: Sequence[Profile], text: Column) -> Column:
    """struct(title, word, value) of a card's summary charge on this line; year-to-date lines and lines without a figure are none."""
    kind = "struct<title:string,word:string,value:decimal(18,2)>"

    def one(p: Profile) -> Column | None:
        if not (p.card and p.charges):
            return None
        found = []
        for label, word, title in p.charges:
            value = money(F.regexp_extract(text, rf"(?i){label}\b.{{0,22}}?({FIGURE_IN_TEXT})", 1))["value"]
            yearly = text.rlike(rf"(?i)total\s+{word}|year|in\s+20\d\d")
            found.append(F.when(text.rlike(rf"(?i){label}\b") & ~yearly & value.isNotNull(), F.struct(F.lit(title).alias("title"), F.lit(word).alias("word"), value.alias("value"))))
        return F.coalesce(*found).cast(kind)

    return by_profile(profiles, one, F.lit(None).cast(kind))


def _row_kind(in_section: Column) -> Column:
    """E14, E15 by line: R a row with its amount, N one without, M and B undated with an amount or a balance only, U undated text, T a refused dated line, C clearing."""
    dated, n = F.col("date").isNotNull(), F.size("moneys")
    return (
        F.when(F.col("special"), "C").when(dated & ~in_section, "T").when(dated & (n > 0) & (letters(F.col("description")) < 4), "T")
        .when(dated & F.col("amount").isNotNull(), "R").when(dated, "N").when(F.col("amount").isNotNull(), "M").when(n > 0, "B").otherwise("U")
    )


def _with_boxes(lines: DataFrame) -> DataFrame:
    """Marks the line of three figures or more behind a box's head (cls V), and label lines (cls L); special is what is no part of a row."""
    order = Window.partitionBy(*STATEMENT).orderBy("seq")
    loose = (F.col("cls") == "-") & F.col("date").isNull() & (F.size("moneys") > 0)
    last = F.last(F.when(F.col("cls") == "X", True).when(loose, False), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("_box", loose & (F.size("moneys") >= 3) & F.coalesce(last, F.lit(False)))
    says_balance = F.coalesce(F.col("begin_label"), F.col("end_label")).isNotNull()
    cls = F.when(F.col("_box"), "V").when((F.col("cls") == "-") & says_balance, "L").otherwise(F.col("cls"))
    return lines.withColumn("cls", cls).drop("_box").withColumn("special", F.col("cls") != "-")


FOLDED = "struct<seq: bigint, block_no: int, name: string, card: boolean, accepted: boolean>"


def account_events(lines: DataFrame, profiles: Sequence[Profile]) -> DataFrame:
    """What each statement's event lines do, by a fold over them in order.

    Events are markers, beginning rows, what sets a beginning balance, stops and resumes. A marker counts only if it names another account
    than the open one; it and a beginning row open a new block if the open one holds rows or a beginning balance, else they give it the name
    it lacks. A stop is waived if a later page resumes. Rows: doc_id, stmt_no, seq, block_no, name, card, accepted (a marker that counts), stop_page
    (on the row of the stop alone).
    """
    order = Window.partitionBy(*STATEMENT).orderBy("seq")
    lines = _with_boxes(lines)
    named = F.col("marker").isNotNull()
    prior = F.last(F.col("marker"), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("_new", named & ~F.col("marker").eqNullSafe(prior))
    section = F.last(F.when(F.col("_new"), False).when(F.col("cls") == "H", True), ignorenulls=True).over(order)
    in_section = ~flag(profiles, "require_section") | F.coalesce(section, F.lit(False))
    sets = (F.col("cls") == "V") | ((F.col("cls") == "L") & F.col("begin_label").isNotNull())
    event = named | (F.col("cls") == "B") | sets | F.col("stop") | F.col("resume")
    lines = lines.withColumn("kind", _row_kind(in_section)).withColumn("_event", F.coalesce(event, F.lit(False)))
    content = ~named & ((F.col("kind") == "R") | ((F.col("kind") == "N") & F.lead("kind").over(order).isin("M", "B")))
    lines = lines.withColumn("rows", F.sum(F.coalesce(content, F.lit(False)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    value = F.try_element_at("moneys", F.lit(-1))
    fields = F.struct(
        "seq", "page", "marker", (F.col("cls") == "B").alias("begins"), F.substring(collapsed(F.col("description")), 1, 60).alias("title"), (F.col("cls").eqNullSafe("B") & value.isNotNull()).alias("valued"),
        sets.alias("sets"), F.coalesce("rows", F.lit(0)).alias("rows"), "stop", "resume",
    )
    events = lines.filter("_event").groupBy(*STATEMENT, "key").agg(F.sort_array(F.collect_list(fields)).alias("e"))
    resumed = F.array_max(F.transform(F.filter("e", lambda e: e["resume"]), lambda e: e["page"]))
    ends = F.get(F.filter("e", lambda e: e["stop"] & ~F.coalesce(F.col("resumed") > e["page"], F.lit(False))), 0)
    events = events.withColumn("resumed", resumed).withColumn("end", ends)
    read = F.filter("e", lambda e: F.col("end").isNull() | (e["seq"] < F.col("end.seq")))
    card = flag(profiles, "card")
    begin = F.struct(
        F.lit(1).alias("no"), F.lit("").alias("name"), card.alias("card"), F.lit(0).cast("long").alias("rows"), F.lit(False).alias("set"), F.array().cast(f"array<{FOLDED}>").alias("out"),
    )

    def step(a: Column, e: Column) -> Column:
        accepted = e["marker"].isNotNull() & (e["marker"] != a["name"])
        opens = accepted | e["begins"]
        started = opens & ((e["rows"] > a["rows"]) | a["set"])
        title = F.when(accepted, e["marker"]).otherwise(e["title"])
        name = F.when(started | (opens & (a["name"] == "")), title).otherwise(a["name"])
        no = a["no"] + started.cast("int")
        is_card = F.when(accepted, card).when(opens, F.lit(False)).otherwise(a["card"])
        was_set = F.when(opens, ~accepted & e["valued"]).otherwise(a["set"] | e["sets"])
        row = F.struct(e["seq"].alias("seq"), no.alias("block_no"), name.alias("name"), is_card.alias("card"), accepted.alias("accepted"))
        return F.struct(
            no.alias("no"), name.alias("name"), is_card.alias("card"), F.when(started, e["rows"]).otherwise(a["rows"]).alias("rows"), was_set.alias("set"),
            F.concat(a["out"], F.array(row)).alias("out"),
        )

    folded = events.select(*STATEMENT, "end", F.aggregate(read, begin, step)["out"].alias("out"))
    end = F.when(F.col("end").isNotNull(), F.array(F.struct(F.col("end.seq").alias("seq"), F.lit(None).cast("int").alias("block_no"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("boolean").alias("card"), F.lit(False).alias("accepted"), F.col("end.page").alias("stop_page"))))
    rows = F.transform("out", lambda o: o.withField("stop_page", F.lit(None).cast("int")))
    return folded.select(*STATEMENT, F.explode(F.concat(rows, F.coalesce(end, F.slice(rows, 1, 0)))).alias("o")).select(*STATEMENT, "o.*")


def statement_rows(lines: DataFrame, profiles: Profile | Sequence[Profile]) -> DataFrame:
    """The ledger: a row a movement, signed and dated, with its account's printed balances.

    doc_id, stmt_no, block_no, seq, page, date (DATE), date_raw, description, section, amount, balance, beginning, ending, block_name, card, sign_source, status, note,
    raw_text, and of the statement key, period, confidence, stmt_label, stop_page and incomplete: an unread page behind its stop holds what looks like a row.
    """
    chosen = _profiles(profiles)
    outcomes = account_events(lines, chosen)
    both = lines.withColumn("is_line", F.lit(1)).unionByName(outcomes.withColumn("is_line", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*STATEMENT).orderBy("seq", "is_line")
    whole = Window.partitionBy(*STATEMENT)
    event = F.last(F.when(F.col("is_line") == 0, F.struct("seq", "block_no", "name", "card", "accepted", "stop_page")), ignorenulls=True).over(order)
    both = both.withColumn("o", event).withColumn("stopped", F.max("o.stop_page").over(order)).filter("is_line = 1")
    tail = F.max(F.coalesce(F.col("stopped").isNotNull() & (F.col("page") > F.col("stopped")) & F.col("unread"), F.lit(False))).over(whole)
    both = both.withColumn("incomplete", tail).withColumn("stop_page", F.max("stopped").over(whole))
    both = both.withColumn("block_no", F.coalesce("o.block_no", F.lit(1))).withColumn("card", F.coalesce("o.card", flag(chosen, "card"))).withColumn("accepted", F.coalesce((F.col("o.seq") == F.col("seq")) & F.col("o.accepted"), F.lit(False)))
    charged = both.filter("charge is not null").select(*STATEMENT, "key", "period", "confidence", "stmt_label", "seq", "text", "charge", "incomplete", "stop_page")
    read = _with_boxes(both.filter("stopped is null").withColumn("cls", F.when(F.col("accepted"), "A").otherwise(F.col("cls"))))
    title = F.substring(F.trim("text"), 1, 60)
    again = by_profile(chosen, lambda p: statement.section_direction(title, list(p.credit_headings), list(p.debit_headings)) if p.credit_headings or p.debit_headings else None, F.lit(None).cast("int"))
    mark = F.when(F.col("cls") == "A", F.struct(F.lit("").alias("section"), F.lit(None).cast("int").alias("dir"))).when(F.col("cls") == "H", F.struct(title.alias("section"), again.alias("dir")))
    running = Window.partitionBy(*STATEMENT).orderBy("seq")
    read = read.withColumn("m", F.last(mark, ignorenulls=True).over(running)).withColumn("section", F.coalesce("m.section", F.lit("")))
    read = read.withColumn("kind", _row_kind(~flag(chosen, "require_section") | (F.col("section") != "")))
    block = Window.partitionBy(*BLOCK)
    value = lambda i: F.try_element_at(F.transform("moneys", lambda m: (m["value"] * F.coalesce(m["sign"], F.lit(1))).cast(MONEY)), F.lit(i))
    at = lambda when, v: F.when(when & v.isNotNull(), F.struct("seq", v.alias("v")))
    cls = F.col("cls")
    begun, ended = F.min(at(cls == "B", value(-1))).over(block)["v"], F.max(at(cls == "E", value(1))).over(block)["v"]
    begin_fill = F.min(at(cls == "V", value(1))).over(block), F.min(at(cls == "L", F.col("begin_label"))).over(block)
    end_fill = F.min(at(cls == "V", value(-1))).over(block), F.min(at(cls == "L", F.col("end_label"))).over(block)
    first_of = lambda pair: F.array_min(F.filter(F.array(*pair), lambda x: x.isNotNull()))["v"]
    read = read.withColumn("beginning", F.coalesce(begun, first_of(begin_fill))).withColumn("ending", F.coalesce(ended, first_of(end_fill)))
    read = read.withColumn("block_name", F.last("o.name", ignorenulls=True).over(block.orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    read = read.withColumn("anchor", F.sum(F.col("kind").isin("R", "N", "C").cast("int")).over(running))
    facts = ("key", "period", "confidence", "stmt_label", "incomplete", "stop_page")
    part = F.struct("seq", "kind", "text", "description", "amount", "label", "balance", "date", "page")
    account = ("block_name", "card", "beginning", "ending", *facts)
    joined = read.groupBy(*BLOCK, "anchor").agg(F.sort_array(F.collect_list(F.when(F.col("kind") != "C", part))).alias("parts"), *(F.min(c).alias(c) for c in account), F.min_by("section", "seq").alias("section"), F.min_by("m", "seq")["dir"].alias("section_dir"))
    rows = statement.assembled_rows(joined)
    charges = _summary_charges(charged, chosen, joined)
    rows = rows.unionByName(charges, allowMissingColumns=True) if charges is not None else rows
    rows = rows.filter("not empty")
    words = by_profile(chosen, lambda p: statement.word_direction(F.col("description"), list(p.credit_words), list(p.debit_words)), F.lit(0))
    of = lambda field, none: by_profile(chosen, lambda p: F.lit(getattr(p, field)) if getattr(p, field) != none else None, F.lit(none))
    signed = statement.resolve_signs(
        rows, words, section_first=flag(chosen, "section_first"), default_direction=of("default_direction", 0), card=F.coalesce("card", F.lit(False)), card_explicit=of("card_explicit", 1)
    )
    dated = signed.withColumn("day", F.coalesce("charged_on", resolve_year(F.col("date"), F.col("period.start"), F.col("period.end"))))
    unplaced = F.col("day").isNull()
    late = F.when(unplaced, F.concat(F.lit("Date '"), F.coalesce("date.raw", F.lit("")), F.lit("' lies in no year of the statement's period.")))
    lost = F.when(F.col("balance_only"), F.lit("No amount could be read for this transaction row."))
    nothing = F.coalesce((F.col("signed") == 0) & (F.col("sign_source") == "unknown"), F.lit(False))  # 0.00 is the same as a credit and a debit
    note = F.concat_ws(" ", late, lost, F.when(~nothing, F.nullif(F.col("note"), F.lit(""))))
    review = unplaced | F.col("balance_only") | ((F.col("status") == "NEEDS_REVIEW") & ~nothing)
    return dated.select(
        *BLOCK, "seq", "page", F.col("day").alias("date"), F.col("date.raw").alias("date_raw"), "description", "section",
        F.col("signed").cast(MONEY).alias("amount"), "balance", "beginning", "ending", F.coalesce(F.nullif("block_name", F.lit("")), F.concat(F.lit("Account "), F.col("block_no").cast("string"))).alias("block_name"),
        "card", "sign_source", F.when(review, "NEEDS_REVIEW").otherwise("OK").alias("status"), note.alias("note"), "raw_text", *facts,
    )


def _summary_charges(charged: DataFrame, profiles: Sequence[Profile], joined: DataFrame) -> DataFrame | None:
    """Rows for a card's charges that only the summary prints, dated at the period's end; None where no profile knows any.

    The first line of each title counts; zero is no charge. Nothing is added where a row of the statement's first card account names the word.
    """
    if not any(p.card and p.charges for p in profiles):
        return None
    first = charged.groupBy(*STATEMENT, F.col("charge.title").alias("title")).agg(F.min_by(F.struct(*(c for c in charged.columns if c not in STATEMENT)), "seq").alias("c"))
    first = first.select(*STATEMENT, "title", "c.*").filter("charge.value <> 0")
    rows = statement.assembled_rows(joined)
    cards = rows.filter("card").groupBy(*STATEMENT).agg(F.min_by(F.struct("block_no", "block_name", "beginning", "ending"), "block_no").alias("b"))
    placed = first.join(cards, STATEMENT)
    said = rows.filter("not empty").select(*STATEMENT, "block_no", F.lower("description").alias("_d"))
    tight = squashed(F.col("_d")).alias("_t")
    named = placed.join(said.select("*", tight), STATEMENT).filter("block_no = b.block_no").filter("_d rlike concat('(?i)', charge.word) or _t rlike concat('(?i)', charge.word)")
    left = placed.join(named.select(*STATEMENT, "title").distinct(), [*STATEMENT, "title"], "left_anti")
    return left.select(
        *STATEMENT, "b.block_no", "b.block_name", "b.beginning", "b.ending", "key", "period", "confidence", "stmt_label", "incomplete", "stop_page", F.lit(True).alias("card"), F.lit(False).alias("empty"),
        F.col("seq").alias("seq"), F.lit(0).alias("page"), F.col("title").alias("description"), F.col("title").alias("section"), F.col("charge.value").alias("amount"),
        F.col("text").alias("raw_text"), F.col("period.end").alias("charged_on"), F.lit(False).alias("balance_only"),
    )


def statement_proofs(words: DataFrame, profiles: Profile | Sequence[Profile]) -> DataFrame:
    """One row an account: doc_id, stmt_no, block, block_name, key, rows, n, total, beginning, ending, flagged, passed, detail, complete; accounts without rows have none.

    Where a document holds several statements, the label of each (B8) stands behind its accounts' names.
    """
    return account_proofs(statement_rows(statement_lines(words, profiles), profiles))


def account_proofs(ledger: DataFrame) -> DataFrame:
    """The proofs of a ledger from statement_rows."""
    proofs = reconcile.block_proof(ledger, BLOCK, ["seq"], carry=("block_name", "key", "confidence", "stmt_label", "incomplete", "stop_page"))
    several = F.max("stmt_no").over(Window.partitionBy("doc_id")) > 1
    name = F.when(several, F.concat_ws(" ", "block_name", "stmt_label")).otherwise(F.col("block_name"))
    reason = F.when(F.col("incomplete"), F.concat(F.lit("reading stopped on page "), F.col("stop_page").cast("string"), F.lit(", later pages hold what looks like movements")))
    return proofs.select(
        "doc_id", "stmt_no", F.col("block_no").cast("long").alias("block"), name.alias("block_name"), "key", "confidence", "rows", "n", "total", "beginning", "ending", "flagged", "passed", "detail",
        (~F.col("incomplete")).alias("complete"), reason.alias("reason"),
    )


def statement_outcomes(words: DataFrame, profiles: Profile | Sequence[Profile]) -> DataFrame:
    """One row a document of ``words``: rows, flagged, state, verdict, detail, profile (B9) and its confidence; a document without any row has failed."""
    lines = statement_lines(words, profiles)
    return document_outcomes(lines, statement_rows(lines, profiles))


def document_outcomes(lines: DataFrame, ledger: DataFrame) -> DataFrame:
    """The outcomes of all documents of ``lines`` by their ledger."""
    proofs = shared_table(account_proofs(ledger), "account-proofs")  # read twice
    blocks = proofs.withColumn("block", (F.col("stmt_no") * 1_000_000 + F.col("block")).cast("long"))
    found = reconcile.document_outcome(blocks, ["doc_id"])
    every = lines.groupBy("doc_id", "stmt_no").agg(F.min("key").alias("key"), F.min("confidence").alias("confidence"))
    some = proofs.groupBy("doc_id", "stmt_no").agg(F.sum("rows").alias("n_txn"))
    best = every.join(some, STATEMENT, "left")
    at = F.when(F.col("n_txn") > 0, F.col("stmt_no"))
    of = lambda c: F.coalesce(F.max_by(c, at), F.min_by(c, "stmt_no"))
    profile = best.groupBy("doc_id").agg(of("key").alias("profile"), of("confidence").alias("confidence"))
    return profile.join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("flagged", F.lit(0)).alias("flagged"), F.coalesce("state", F.lit("failed")).alias("state"),
        F.coalesce("verdict", F.lit("NOT PROVABLE")).alias("verdict"), F.coalesce("detail", F.lit("")).alias("detail"), "profile", "confidence",
    )
