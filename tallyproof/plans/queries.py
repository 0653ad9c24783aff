"""The registered queries of the statement operators, each over a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit, documents, flow, geometry, grammars, projection, reconcile, route, scan, settlement, statement
from ..operators.profiles import Profile
from ..sources.tables import spread
from ..streaming.ingest import ingest
from . import views as V

KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
#: The query's own vocabulary: fingerprints of four languages.
VOCABULARY = (
    ("english", " the ", 30), ("english", " and ", 15), ("english", " of ", 10), ("french", " les? ", 30), ("french", " et ", 15),
    ("german", " der ", 30), ("german", " und ", 15), ("spanish", " el ", 30), ("spanish", " los ", 15), ("spanish", " que ", 5),
)
ORDINALS = ("english", "french", "german", "spanish")


def _events(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.EVENT_LEDGER)


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.LINE_LEDGER)


def _words(spark: SparkSession, d: str) -> DataFrame:
    return V.view(spark, d, V.MADE_WORDS)


def money_tokens(spark, d):
    price = F.col("l_extendedprice").cast(S.MONEY)
    shape, plain, grouped = F.col("l_linenumber") % 6, price.cast("string"), F.format_number(price, 2)
    token = (
        F.when(shape == 0, plain).when(shape == 1, F.concat(grouped, F.lit("-"))).when(shape == 2, F.concat(F.lit("-$"), plain))
        .when(shape == 3, F.concat(F.lit("($"), grouped, F.lit(")"))).when(shape == 4, F.concat(F.lit("+"), plain)).otherwise(F.concat(F.lit("$"), grouped))
    )
    m = S.money(token)
    return V.table(spark, d, "lineitem").select(*KEY, m["value"].alias("value"), m["sign"].alias("sign"), S.figure(F.concat(F.lit("$"), grouped)).alias("again"))


def document_figures(spark, d):
    found = S.money_in_text(F.col("text"))
    total = F.aggregate(found, F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x).cast("decimal(28,2)"))
    return V.table(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n"), total.cast(S.MONEY).alias("total"))


def date_tokens(spark, d):
    day = F.col("l_shipdate")
    shape = F.col("l_linenumber") % 4
    text = (
        F.when(shape == 0, F.date_format(day, "M/d/yyyy")).when(shape == 1, F.date_format(day, "MM-dd-yy"))
        .when(shape == 2, F.concat(F.date_format(day, "MM/dd"), F.lit("*"))).otherwise(F.date_format(day, "M-d"))
    )
    start = F.date_sub(F.trunc(day, "month"), 1)
    said = V.table(spark, d, "lineitem").select(*KEY, text.alias("text"), start.alias("start"), F.last_day(day).alias("end"))
    read = said.select(*KEY, S.date_token(F.col("text")).alias("t"), "start", "end")
    return read.select(*KEY, "t.m", "t.d", "t.y", S.resolve_year(F.col("t"), F.col("start"), F.col("end")).alias("day"))


def month_name_dates(spark, d):
    day = F.col("o_orderdate")
    t = S.month_name_date(F.date_format(day, "MMM"), F.concat(F.date_format(day, "d"), F.lit(",")))
    return V.table(spark, d, "orders").select("o_orderkey", t["m"].alias("m"), t["d"].alias("d"))


def statement_periods(spark, d):
    start, end = F.trunc("o_orderdate", "month"), F.last_day("o_orderdate")
    shape = F.col("o_orderkey") % 4
    text = (
        F.when(shape == 0, F.concat(F.date_format(start, "MMMM dd, yyyy"), F.lit("through"), F.date_format(end, "MMMM dd, yyyy")))
        .when(shape == 1, F.concat(F.lit("Period "), F.date_format(start, "MM/dd/yyyy"), F.lit(" - "), F.date_format(end, "MM/dd/yyyy")))
        .when(shape == 2, F.concat(F.date_format(start, "MMM d"), F.lit(" to "), F.date_format(end, "MMM d, yyyy")))
        .otherwise(F.concat(F.lit("Statement date "), F.date_format(end, "MMMM d, yyyy")))
    )
    found = V.table(spark, d, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", documents.find_period(F.col("text")).alias("p"))
    return found.select("o_orderkey", F.col("p.start").alias("start_day"), F.col("p.end").alias("end_day"))


def statement_periods_more(spark, d):
    """The dates of two balances, a comma without a blank, a month's name with its year but no comma (no date)."""
    start, end = F.trunc("o_orderdate", "month"), F.last_day("o_orderdate")
    shape = F.col("o_orderkey") % 3
    text = (
        F.when(shape == 0, F.concat(F.lit("Your previous balance as of "), F.date_format(start, "MM/dd/yyyy"), F.lit(" was 12.00\nNew balanceasof"), F.date_format(end, "M/d/yyyy")))
        .when(shape == 1, F.concat(F.date_format(start, "MMM d,yyyy"), F.lit(" thru "), F.date_format(end, "MMMM d,yyyy")))
        .otherwise(F.concat(F.lit("printed "), F.date_format(end, "MMMM d yyyy")))
    )
    found = V.table(spark, d, "orders").select("o_orderkey", text.alias("text")).select("o_orderkey", documents.find_period(F.col("text")).alias("p"))
    return found.select("o_orderkey", F.col("p.start").alias("start_day"), F.col("p.end").alias("end_day"))


def text_facts(spark, d):
    text = F.col("text")
    return V.table(spark, d, "documents").select(
        "doc_id", F.length(S.squashed(text)).cast("long").alias("squashed"), F.length(S.collapsed(text)).cast("long").alias("collapsed"),
        F.substring(S.collapsed(text), 1, 60).alias("head"), S.printed(F.col("n_chars").cast(S.MONEY)).alias("chars"),
    )


def native_or_scan(spark, d):
    pages = V.table(spark, d, "pages").select(F.floor(F.col("page_id") / 4).alias("doc_id"), F.col("page_id").alias("page"), F.col("html").alias("text"))
    return documents.native_or_scan(pages)


def profile_scores(spark, d):
    profiles = spark.createDataFrame([(k, i) for i, k in enumerate(ORDINALS)], "key string, ordinal int")
    patterns = spark.createDataFrame([(k, "fingerprint", p, w) for k, p, w in VOCABULARY], "key string, kind string, pattern string, weight int")
    return documents.profile_scores(V.table(spark, d, "documents"), profiles, patterns)


def statement_split(spark, d):
    pages = V.table(spark, d, "pages").select(
        F.floor(F.col("page_id") / 25).alias("doc_id"), F.col("page_id").alias("page"),
        F.when(F.col("page_id") % 3 == 0, "head PAGE 1 of 3 tail").otherwise("Page 2 of 3").alias("text"),
    )
    return documents.statement_split(pages).drop("text")


def native_pages(spark, d):
    """B1 over whole pages, five a document; the bound is high enough that both outcomes occur."""
    pages = V.table(spark, d, "pages").select(F.floor(F.col("page_id") / 5).alias("doc_id"), F.col("page_id").alias("page"), F.col("html").alias("text"))
    return documents.native_or_scan(pages, least=10_000)


def statement_split_pages(spark, d):
    """B5 over whole pages, each under a rendered page head, twelve a document."""
    pages = V.table(spark, d, "pages").select(
        F.floor(F.col("page_id") / 12).alias("doc_id"), F.col("page_id").alias("page"),
        F.concat(F.lit("Page "), (F.col("page_id") % 5 + 1).cast("string"), F.lit(" of 5\n"), F.coalesce("html", F.lit(""))).alias("text"),
    )
    return documents.statement_split(pages).drop("text")


def page_skew(spark, d):
    return geometry.page_skew(_words(spark, d)).drop("page")


def line_groups(spark, d):
    lined = geometry.group_lines(_words(spark, d))
    return lined.groupBy("doc_id", "line_no").agg(F.count("*").alias("n"), F.min("top").alias("top"), F.min("word_idx").alias("first"))


def line_text(spark, d):
    return geometry.line_text(geometry.group_lines(_words(spark, d))).select("doc_id", "line_no", "text")


def _edges(spark, d):
    return _words(spark, d).select("doc_id", "page", F.col("word_idx").alias("edge_id"), "x1")


def money_columns(spark, d):
    return geometry.money_columns(_edges(spark, d)).select("doc_id", F.round("center", 6).alias("center"), "n")


def nearest_column(spark, d):
    near = geometry.nearest_column(_edges(spark, d).withColumn("x1", F.col("x1") + F.col("edge_id") % 9), geometry.money_columns(_edges(spark, d)))
    return near.groupBy("doc_id", F.round("center", 6).alias("center")).agg(F.count("*").alias("n"))


def column_labels(spark, d):
    words = _words(spark, d)
    headers = words.groupBy("doc_id", "page").agg(F.min("x1").alias("lo"), F.max("x1").alias("hi")).select(
        "doc_id", "page", F.explode(F.array(
            F.struct(F.lit(1).alias("header_seq"), F.lit("withdrawals").alias("name"), (F.col("lo") + 10).alias("mid")),
            F.struct(F.lit(2).alias("header_seq"), F.lit("deposits").alias("name"), (F.col("hi") - 120).alias("mid")),
            F.struct(F.lit(3).alias("header_seq"), F.lit("balance").alias("name"), (F.col("hi") + 30).alias("mid")),
        )).alias("h")).select("doc_id", "page", "h.*")
    return geometry.column_labels(geometry.money_columns(_edges(spark, d)), headers).select("doc_id", F.round("center", 6).alias("center"), "label")


def _boxes(spark, d):
    return _words(spark, d).select(
        "doc_id", "page", "word_idx", F.when(F.col("word_idx") % 17 == 0, " ").otherwise(F.col("text")).alias("text"),
        (F.col("x0") * 10).cast("int").alias("left"), F.lit(125).alias("width"), (F.col("top") * 10).cast("int").alias("top"), F.lit(42).alias("height"), "conf",
    )


def ocr_confidence(spark, d):
    words = geometry.ocr_words(_boxes(spark, d))
    facts = words.groupBy("doc_id").agg(F.count("*").alias("n"), F.round(F.max("x1"), 6).alias("right_edge"))
    return geometry.ocr_confidence(words).join(facts, "doc_id").select("doc_id", F.round("mean", 6).alias("conf"), F.col("conf").alias("percent"), "n", "right_edge")


def ocr_lines(spark, d):
    return geometry.ocr_lines(geometry.ocr_words(_boxes(spark, d))).select("doc_id", "bucket", "text")


def balance_chain(spark, d):
    return reconcile.chain_segments(_events(spark, d), ["block_id"], ["seq"])


def chain_flags(spark, d):
    return reconcile.chain_flags(_events(spark, d), ["block_id"], ["seq"]).select("block_id", "seq", "status", "note")


def block_proof(spark, d):
    return reconcile.block_proof(_lines(spark, d), ["block_id"], ["seq"]).select("block_id", "n", "total", "ending", "passed", "detail")


def _hot(spark, d):
    return scan.chunked(V.view(spark, d, V.HOT_LEDGER), ["block_id"], ["seq"])


def hot_account_proof(spark, d):
    """F1-F3 where one account holds a third of all rows: in chunks, none of which is an account's whole."""
    return reconcile.block_proof(_hot(spark, d), ["block_id"], ["seq"]).select("block_id", "n", "total", "flagged", "passed")


def hot_account_flags(spark, d):
    """F2 on the same ledger."""
    return reconcile.chain_flags(_hot(spark, d), ["block_id"], ["seq"]).select("block_id", "seq", "status", "note")


def hot_section_fill(spark, d):
    """E4 where one statement holds a third of all lines."""
    rows = V.view(spark, d, V.HOT_LEDGER)
    lines = scan.chunked(rows.select("block_id", "seq", "section"), ["block_id"], ["seq"])
    direction = F.when(F.col("section") == "signup", 1).when(F.col("section") == "view", -1)
    return statement.section_fill(lines, ["block_id"], ["seq"], F.col("section"), direction, F.col("section") == "error").select("block_id", "seq", "section", "section_dir")


def section_totals(spark, d):
    ledger = _lines(spark, d).withColumn("section", F.concat(F.lit("Deposits and Additions "), F.col("section")))
    totals = ledger.groupBy("block_id", F.col("section").alias("name")).agg(F.sum("amount").alias("s")).select(
        "block_id", "name", (F.col("s") + F.when(F.col("block_id") % 5 == 0, F.lit(2)).otherwise(F.lit(0))).cast(S.MONEY).alias("amount")
    )
    # the first twenty characters of all names agree, so each total meets the whole block
    return reconcile.section_mismatches(ledger, totals, ["block_id"])


def _outcome_blocks(spark, d):
    return reconcile.block_proof(_events(spark, d), ["block_id"], ["seq"]).select(
        F.floor(F.col("block_id") / 3).alias("doc_id"), F.col("block_id").alias("block"), F.concat(F.lit("Account "), F.col("block_id").cast("string")).alias("block_name"),
        "rows", "flagged", "passed", "detail", (F.col("block_id") % 11 != 0).alias("complete"),
    )


def document_outcome(spark, d):
    outcomes = reconcile.document_outcome(_outcome_blocks(spark, d), ["doc_id"])
    return outcomes.select("doc_id", "rows", "flagged", "state", "verdict", "detail")


def run_summary(spark, d):
    """The flagship: which documents' ledgers are proven by their own balances?"""
    return reconcile.run_summary(reconcile.document_outcome(_outcome_blocks(spark, d), ["doc_id"], detail=False))


def run_severity(spark, d):
    return reconcile.run_severity(reconcile.document_outcome(_outcome_blocks(spark, d), ["doc_id"], detail=False))


def unexpected_states(spark, d):
    return reconcile.unexpected_states(reconcile.document_outcome(_outcome_blocks(spark, d), ["doc_id"], detail=False), ["proven"])


def _printed_pages(spark, d):
    """FLOW_LEDGER as words on pages of forty lines: an account's name, its beginning, the rows, its ending."""
    rows = V.view(spark, d, V.FLOW_LEDGER)
    word = lambda i, text, x0, x1: F.struct(F.lit(i).alias("i"), text.cast("string").alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"))
    shown = lambda v: F.concat(F.when(v < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(v), 2))
    line = F.array(
        word(0, F.date_format("day", "MM/dd/yyyy"), 30, 80), word(1, F.lit("Card"), 90, 110), word(2, F.col("section"), 115, 150),
        word(3, F.format_number("amount", 2), 350, 400), word(4, F.format_number("balance", 2), 450, 500),
    )
    body = rows.select("block_id", (F.col("seq") + 1).alias("at"), F.filter(line, lambda w: w["text"].isNotNull()).alias("w"))
    ends = rows.groupBy("block_id").agg(F.max("seq").alias("n"), F.max("ending").alias("ending"))
    words_of = lambda *ts: F.array(*(word(i, t, 30 + 60 * i, 80 + 60 * i) for i, t in enumerate(ts)))
    head = ends.select("block_id", F.lit(0).alias("at"), words_of(F.lit("Account"), F.concat(F.lit("No-"), F.col("block_id").cast("string"))).alias("w"))
    first = ends.select("block_id", F.lit(1).alias("at"), words_of(F.lit("Beginning"), F.lit("balance"), F.lit("$0.00")).alias("w"))
    last = ends.select("block_id", (F.col("n") + 2).alias("at"), words_of(F.lit("Ending"), F.lit("balance"), shown(F.col("ending"))).alias("w"))
    lines = body.unionByName(head).unionByName(first).unionByName(last)
    each = lines.select(F.col("block_id").alias("doc_id"), (F.floor(F.col("at") / 40) + 1).cast("int").alias("page"), "at", F.explode("w").alias("w"))
    top = (F.col("at") % 40) * 14.0
    return each.select("doc_id", "page", (F.col("at") * 10 + F.col("w.i")).cast("int").alias("word_idx"), "w.text", "w.x0", "w.x1", top.alias("top"), (top + 10.0).alias("bottom"))


PRINTED = Profile(markers=(r"^Account\s+(No-\d+)",), credit_words=("signup", "click", "view"), running_balance=True)


def statements_end_to_end(spark, d):
    """From words on pages to each document's outcome."""
    return flow.statement_outcomes(_printed_pages(spark, d), PRINTED).select("doc_id", "rows", "flagged", "state", "verdict")


def account_proofs(spark, d):
    """The accounts of the same pages: names, balances and movements as read."""
    found = flow.statement_proofs(_printed_pages(spark, d), PRINTED)
    return found.select("doc_id", "block", "block_name", "rows", "total", "beginning", "ending", "flagged", "passed", "complete")


#: Three issuers: two money columns under a header, a running balance, and headings with amounts on a line of their own.
ISSUERS = (
    Profile("columns", fingerprints=(("Bank Alpha", 40),), markers=(r"^Account\s+(No-\d+)",), credit_words=("signup", "click", "view"), debit_words=("purchase", "error")),
    Profile("running", fingerprints=(("Bank Beta", 40),), markers=(r"^Account\s+(No-\d+)",), credit_words=("signup", "click", "view"), debit_words=("purchase", "error"), running_balance=True),
    Profile("headings", fingerprints=(("Bank Gamma", 40),), markers=(r"^Account\s+(No-\d+)",), credit_headings=("^Money in",), debit_headings=("^Money out",), require_section=True),
)


def _bundled_pages(spark, d):
    """BUNDLE_LEDGER as words: pages of 33 lines, each with its number, the issuer and the account; dates without years."""
    rows = V.view(spark, d, V.BUNDLE_LEDGER).withColumn("p", F.col("doc_id") % 3)
    word = lambda i, text, x0, x1: F.struct(F.lit(i).alias("i"), text.cast("string").alias("text"), F.lit(float(x0)).alias("x0"), F.lit(float(x1)).alias("x1"))
    said = lambda *ts: F.array(*(word(i, t if not isinstance(t, str) else F.lit(t), 30 + 60 * i, 80 + 60 * i) for i, t in enumerate(ts)))
    shown = lambda v: F.concat(F.when(v < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(v), 2))
    none = F.array().cast("array<struct<i:int,text:string,x0:double,x1:double>>")
    day, price, income = F.date_format("day", "MM/dd"), F.format_number(F.abs("amount"), 2), F.col("amount") >= 0
    dated = said(day, "Card", F.col("section"))
    columns = F.concat(dated, F.when(income, F.array(word(3, price, 450, 500))).otherwise(F.array(word(3, price, 350, 400))))
    running = F.concat(dated, F.array(word(3, price, 350, 400), word(4, shown(F.col("running")), 450, 500)))
    parts = F.when(F.col("p") == 0, F.array(columns)).when(F.col("p") == 1, F.array(running)).otherwise(
        F.array(F.when(income, said("Money", "in")).otherwise(said("Money", "out")), dated, F.array(word(3, price, 350, 400)))
    )
    keys = ("doc_id", "stmt_no", "p")
    body = rows.select(*keys, "seq", F.posexplode(parts).alias("k", "w")).withColumn("slot", (F.col("seq") - 1) * F.when(F.col("p") == 2, 3).otherwise(1) + F.col("k"))
    body = body.select(*keys, F.floor(F.col("slot") / 33).alias("at_page"), (6 + F.col("slot") % 33).alias("line"), "w")
    ends = rows.groupBy(*keys).agg(F.max("n").alias("n"), F.max("ending").alias("ending"), F.max("beginning").alias("beginning"), F.max("start_day").alias("a"), F.max("end_day").alias("b"))
    ends = ends.withColumn("last", F.floor((F.col("n") * F.when(F.col("p") == 2, 3).otherwise(1) - 1) / 33))
    pages = ends.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("at_page"))
    name = F.when(F.col("p") == 0, "Alpha").when(F.col("p") == 1, "Beta").otherwise("Gamma")
    first = F.col("at_page") == 0
    head = F.array(
        said("Page", (F.col("at_page") + 1).cast("string"), "of", (F.col("last") + 1).cast("string")), said("Bank", name), said("Account", F.concat(F.lit("No-"), F.col("doc_id").cast("string"))),
        F.when(F.col("p") == 0, F.array(word(0, F.lit("Date"), 30, 80), word(1, F.lit("Withdrawals"), 340, 400), word(2, F.lit("Deposits"), 450, 500))).otherwise(none),
        F.when(first, said("Period", F.date_format("a", "MM/dd/yyyy"), "through", F.date_format("b", "MM/dd/yyyy"))).otherwise(none),
        F.when(first, said("Beginning", "balance", shown(F.col("beginning")))).otherwise(none),
    )
    foot = F.when(F.col("at_page") == F.col("last"), said("Ending", "balance", shown(F.col("ending")))).otherwise(none)
    heads = pages.select(*keys, "at_page", F.posexplode(F.concat(head, F.array(foot))).alias("line", "w")).withColumn("line", F.when(F.col("line") == 6, 39).otherwise(F.col("line")))
    each = body.unionByName(heads).select("doc_id", "stmt_no", "at_page", "line", F.explode("w").alias("w"))
    top = F.col("line") * 14.0
    page = (F.col("stmt_no") * 1000 + F.col("at_page")).cast("int")
    return each.select("doc_id", page.alias("page"), (F.col("line") * 10 + F.col("w.i")).cast("int").alias("word_idx"), "w.text", "w.x0", "w.x1", top.alias("top"), (top + 10.0).alias("bottom"))


def mixed_statements(spark, d):
    """Bundles of three issuers' statements in one plan: the proof of each account of each statement."""
    found = flow.statement_proofs(_bundled_pages(spark, d), ISSUERS)
    return found.select("doc_id", "stmt_no", "block", "block_name", "key", "confidence", "rows", "total", "beginning", "ending", "flagged", "passed", "complete")


def mixed_ledger(spark, d):
    """The movements of the same bundles: dated by their statement's period and signed by their issuer's conventions."""
    lines = flow.statement_lines(_bundled_pages(spark, d), ISSUERS)
    rows = flow.statement_rows(lines, ISSUERS)
    by = Window.partitionBy("doc_id", "stmt_no").orderBy("seq")
    return rows.select("doc_id", "stmt_no", F.row_number().over(by).cast("long").alias("n"), "date", "amount", "balance", "status", "block_name", "key")


def mixed_outcomes(spark, d):
    """What becomes of the same documents: rows, state, verdict and the profile they count by."""
    return flow.statement_outcomes(_bundled_pages(spark, d), ISSUERS).select("doc_id", "rows", "flagged", "state", "verdict", "profile", "confidence")


JOB_WORDS = grammars.JobWords(
    job=r"\d+-JB", cost_labels=("Total Cost", "Driver Pay"), commission=r"House\s*\d+%", total_jobs="Total Jobs:", total_pay="TOTAL PAY TO DRIVER", negative="Negative Settlement",
    held="holding", column_head=r"Job\s?#", trailer_head=r"Settlement Week\s+Job\s?#", opening="settlement week",
)
CODE_WORDS = grammars.CodeWords(code_total="Deduct/Earning code", totals="totals?:", records="Record", report_total="Report totals?:")


def _order_bodies(spark, d):
    """Orders as jobs and as loads of a customer's settlements, their items as movements and as earnings; some subtotals and totals are off by one.

    doc_id, jobs, jobs_printed (their sum), loads, loads_printed. Figures are shuffled, to the order and to its customer; text is made behind that.
    """
    price = F.col("l_extendedprice").cast(S.MONEY)
    items = V.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", price.alias("price"), (F.col("l_returnflag") == "R").alias("back"))
    heads = V.table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("doc_id"), F.col("o_totalprice").cast(S.MONEY).alias("net"))
    orders = items.join(heads, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("doc_id", F.col("o_orderkey").alias("job")).agg(
        F.max("net").alias("net"), F.sum("price").cast(S.MONEY).alias("sum"), F.coalesce(F.sum(F.when(F.col("back"), F.col("price"))), F.lit(0)).cast(S.MONEY).alias("given"),
        F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "price", "back"))), lambda x: F.struct(x["price"].alias("price"), x["back"].alias("back"))).alias("items"),
    ).repartition("doc_id")
    usd = lambda v: F.concat(F.lit("$"), F.format_number(v, 2))
    off = lambda k: F.when(F.col("job") % k == 0, 1).otherwise(0)
    said = lambda x: F.when(x["back"], F.concat(usd(x["price"]), F.lit(" given back"))).otherwise(F.concat(F.lit("-"), usd(x["price"]), F.lit(" for a part")))
    job = F.concat_ws(
        "\n", F.concat(F.lit("Cust of "), F.col("job").cast("string"), F.lit(" $3.00 "), F.col("job").cast("string"), F.lit("-JB "), usd(F.col("sum") + 1000), F.lit(" Total Cost")),
        F.array_join(F.transform("items", said), "\n"), usd(F.col("jobs_printed")),
    )
    earned = F.sort_array(F.transform("items", lambda x: F.concat(F.lit("Earning Part 01/03/24 1.00 1.00 "), usd(x["price"]))))
    load = F.concat_ws(
        "\n", F.concat(F.lit("SETTLEMENT "), F.col("job").cast("string")), F.lit("Page 2"),
        F.concat(F.lit("A B Loaded 5.0 T1 01/02/24 01/03/24 "), usd(F.col("net") * 2), F.lit(" 50.00% "), usd(F.col("net"))), F.array_join(earned, "\n"), F.concat(F.lit("ORDER TOTAL _"), usd(F.col("loads_printed"))),
    )
    orders = orders.withColumn("jobs_printed", (2 * F.col("given") + 1000 + off(10)).cast(S.MONEY)).withColumn("loads_printed", F.col("net") + F.col("sum") + off(13))
    body = lambda text: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("job", text.alias("t")))), lambda x: x["t"]), "\n")
    return orders.groupBy("doc_id").agg(
        body(job).alias("jobs"), F.sum("jobs_printed").cast(S.MONEY).alias("jobs_printed"), body(load).alias("loads"), F.sum("loads_printed").cast(S.MONEY).alias("loads_printed")
    )


def _job_text():
    """The text of a row of _order_bodies as a settlement of jobs."""
    usd = lambda v: F.concat(F.lit("$"), F.format_number(v, 2))
    total = F.col("jobs_printed")
    off = F.when(F.col("doc_id") % 9 == 0, 1).otherwise(0)
    tail = F.concat(F.lit("Total Jobs: "), usd(total), F.lit(" $2.00\nInsurance -$5.00\nTOTAL PAY TO DRIVER "), usd(total - 5 + off), F.lit("\n**NOTES**\nBalance left $4.00"))
    return F.concat_ws("\n", "jobs", tail)


def _job_texts(spark, d):
    """Orders as jobs of a customer's settlement, printed as text."""
    return _order_bodies(spark, d).select("doc_id", _job_text().alias("text"))


def job_rows(spark, d):
    """G1-G4, G8, G9 from text: rows, sums and flagged rows by kind."""
    rows = grammars.job_rows(_job_texts(spark, d), JOB_WORDS)
    return rows.groupBy("doc_id", "section", "type").agg(F.count("*").alias("n"), F.sum("amount").cast(S.MONEY).alias("total"), F.sum((F.col("status") != "OK").cast("long")).alias("flagged"))


def job_settlement(spark, d):
    """G5, G6 from text: job nets against the total of jobs, that and adjustments against the total pay."""
    rows = grammars.job_rows(_job_texts(spark, d), JOB_WORDS)
    nets = settlement.job_nets(grammars.job_ledger(rows), ["doc_id", "job_no"], ["line_no", "part"])
    return settlement.job_proof(nets, grammars.job_totals(rows))


def _coded_texts(spark, d):
    """A supplier's line items as rows of three codes, with printed counts and sums, some off."""
    price, flag = F.col("l_extendedprice").cast(S.MONEY), F.col("l_returnflag")
    items = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), "l_orderkey", "l_linenumber", "l_partkey", price.alias("price"), flag.alias("code")).repartition("doc_id")
    items = items.withColumn("amount", F.when(F.col("code") == "R", -F.col("price")).otherwise(F.col("price")).cast(S.MONEY))
    text = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 7, "1"), F.lit(" PAYEE Some Name 01/02/2024 "), F.format_number("amount", 2))
    codes = items.groupBy("doc_id", "code").agg(
        F.sum("amount").cast(S.MONEY).alias("s"), F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "price", text.alias("t")))), lambda x: x["t"]), "\n").alias("lines")
    )
    off = lambda k: F.when(F.col("doc_id") % k == 0, 1).otherwise(0)
    total = F.concat(F.lit("Deduct/Earning code X"), F.col("code"), F.lit(" totals: "), (F.col("n") + off(5)).cast("string"), F.lit(" Records __"), F.format_number(F.col("s") + off(3), 2))
    docs = codes.withColumn("t", F.concat_ws("\n", F.concat(F.lit("X"), F.col("code"), F.lit(" PARTS SENT")), "lines", total)).groupBy("doc_id").agg(
        F.sum("s").cast(S.MONEY).alias("s"), F.sum("n").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("code", "t"))), lambda x: x["t"]), "\n").alias("body")
    )
    report = F.concat(F.lit("Report total: "), F.col("n").cast("string"), F.lit(" Records "), F.format_number("s", 2))
    return docs.select("doc_id", F.concat_ws("\n", "body", report).alias("text"))


def coded_report(spark, d):
    """G10-G12 from text."""
    rows = grammars.coded_rows(_coded_texts(spark, d), CODE_WORDS)
    flagged = rows.filter("kind = 'row'").groupBy("doc_id").agg(F.count_distinct("section").alias("sections"), F.sum((F.col("status") != "OK").cast("long")).alias("flagged"))
    return settlement.report_totals(grammars.coded_totals(rows), ["doc_id"], ["line_no"]).join(flagged, "doc_id")


LOAD_WORDS = grammars.LoadWords(
    furniture=(r"^Page \d+$",), order="SETTLEMENT", order_total="ORDER TOTAL", loaded="Loaded", kinds=("Earning", "Reimbursement", "Deduction"), summary="PAY SUMMARY", information=("dispatch",),
    headings=((r"^Driver Ledger$", "driver"), (r"^RECURRING$", "recurring"), (r"^DEDUCTIONS$", "deductions"), (r"^ESCROW$", "escrow"), (r"^DISPATCH$", "dispatch")),
    untyped=(("deductions", "Deduction"),), recurring=("recurring",), accounts=("escrow",),
)


def load_settlement(spark, d):
    """G13-G15, G19 from text."""
    docs = _order_bodies(spark, d)
    tail = F.lit("Driver Ledger\nDeduction Diesel 01/03/24 1.00 20.00 -$20.00\n-$20.00\nPAY SUMMARY Order Pay: $7.00\nDISPATCH\nsome note")
    found = grammars.load_rows(docs.select("doc_id", F.concat_ws("\n", "loads", tail).alias("text")), LOAD_WORDS)
    return found.groupBy("doc_id", "section", "type").agg(
        F.count("*").alias("n"), F.count_distinct("job").alias("orders"), F.sum("amount").cast(S.MONEY).alias("total"), F.sum((F.col("status") != "OK").cast("long")).alias("flagged")
    )


LOAD_PROOF = route.LoadProof(
    labels=(("order_pay", "pay_summary", "ORDER PAY"), ("deductions", "pay_summary", "DEDUCTIONS"), ("net_pay", "pay_summary", "NET PAY")),
    sums=(("order_totals", "order", "Order Total"), ("taken", "driver", "Deduction"), ("taken", "recurring", "Deduction"), ("taken", "deductions", "Deduction")),
    identities=(("orders", ("order_totals",), "order_pay"), ("deductions", ("taken",), "deductions"), ("net_pay", ("order_pay", "deductions"), "net_pay")),
    accounts=("escrow", {"previous": "PREVIOUS", "withdrawals": "WITHDRAWAL", "deposits": "DEPOSIT", "new": "NEW BALANCE"}),
)
KINDS = (
    route.Kind("jobs", (r"Total Jobs:", r"-JB "), JOB_WORDS), route.Kind("codes", (r"Deduct/Earning code",), CODE_WORDS), route.Kind("loads", (r"ORDER TOTAL", r"(?m)^SETTLEMENT "), LOAD_WORDS, LOAD_PROOF),
)


def _settlement_texts(spark, d):
    """Settlements of three kinds and prose that is none; doc_id is 10 * the maker's id + 1, 2, 3 and 4."""
    usd = lambda v: F.concat(F.when(v < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(v), 2))
    pay = F.col("loads_printed")
    off = F.when(F.col("doc_id") % 11 == 0, 1).otherwise(0)
    tail = F.concat(
        F.lit("Driver Ledger\nDeduction Diesel 01/03/24 1.00 20.00 -$20.00\n-$20.00\nRECURRING\nDeduction Lease escrow 1,000.00 Per Settlement -$25.00\n-$25.00\nDEDUCTIONS\nFuel advance 01/02/24 5.0 3.00 -$15.00\n_-_$15.00\nPAY SUMMARY Order Pay: "),
        usd(pay), F.lit("\nDeductions: -$60.00\nNET PAY: "), usd(pay - 60 + off), F.lit("\nESCROW\n10.1 Tire Fund\nPrevious Balance: $50.00\nDeposits: $25.00\nNew Balance: $"),
        F.when(F.col("doc_id") % 17 == 0, "76").otherwise("75"), F.lit(".00\nDISPATCH\nMiles: 12"),
    )
    ordered = F.array(*(F.struct((F.col("doc_id") * 10 + k).alias("doc_id"), text.alias("text")) for k, text in ((1, _job_text()), (3, F.concat_ws("\n", "loads", tail)))))
    out = _order_bodies(spark, d).select(F.inline(ordered))
    for k, docs in ((2, _coded_texts(spark, d)), (4, V.table(spark, d, "documents"))):
        out = out.unionByName(docs.select((F.col("doc_id") * 10 + k).alias("doc_id"), "text"))
    return out


def document_kind(spark, d):
    """B2 over texts of three kinds and prose."""
    return route.with_kinds(_settlement_texts(spark, d), KINDS).select("doc_id", "kind")


def settlement_route(spark, d):
    """From text of three kinds to each settlement's outcome."""
    return route.settlement_outcomes(*route.settlement_rows(_settlement_texts(spark, d), KINDS, whole=False)).select("doc_id", "rows", "flagged", "state", "verdict", "profile", "confidence")


def settlement_projection(spark, d):
    """H5: the same settlements' output rows, summed up by kind of row."""
    rows = route.settlement_table(route.typed_rows(_settlement_texts(spark, d), KINDS))
    return rows.groupBy("doc_id", "section", "type", "status").agg(F.count("*").alias("n"), F.sum("amount").cast(S.MONEY).alias("total"), F.count("raw").alias("raws"), F.count("customer").alias("customers"))


def run_info(spark, d):
    """What a run says of the bundles of mixed_statements."""
    outcomes = flow.statement_outcomes(_bundled_pages(spark, d), ISSUERS)
    pages = _bundled_pages(spark, d).groupBy("doc_id", "page").agg(F.array_join(F.collect_list("text"), " ").alias("text"))
    info = projection.run_info(outcomes, route.run_facts(pages))
    log = route.run_log(outcomes).select("doc_id", "severity")
    return info.drop("detail").join(log, "doc_id")


def unread_tail(spark, d):
    """statements' pages behind a stop, and whether anything there looks like a row."""
    lines = _event_lines(spark, d).select(
        "doc_id", "seq", "page", "event_id", (F.col("event_type") == "purchase").alias("has_date"), (F.col("event_type") == "purchase").alias("has_money")
    )
    stop = F.col("event_id") % 41 == 0
    read = statement.stop_reading(lines, ["doc_id"], "page", ["seq"], stop, F.lit(False)).groupBy("doc_id").agg(F.max("incomplete").alias("incomplete"))
    stops = lines.groupBy("doc_id").agg(F.min(F.when(stop, F.col("page"))).cast("long").alias("stop_page"), F.max("page").cast("long").alias("pages"))
    return reconcile.pages_read(stops, ["doc_id"]).join(read, "doc_id", "left").withColumn("incomplete", F.coalesce("incomplete", F.lit(True)))


def amount_balance(spark, d):
    """Amounts and balances of lines by money columns."""
    price = F.col("l_extendedprice").cast(S.MONEY)
    at = F.when(F.col("l_linenumber") % 3 == 0, 302.0).when(F.col("l_linenumber") % 3 == 1, 500.0).otherwise(430.0)
    moneys = F.array(
        F.struct(price.alias("value"), F.when(F.col("l_partkey") % 4 == 0, -1).alias("sign"), at.alias("x1")),
        F.struct((price + 1).cast(S.MONEY).alias("value"), F.when(F.col("l_partkey") % 5 == 0, -1).alias("sign"), F.lit(498.5).alias("x1")),
    )
    both = statement.amount_balance(moneys, F.array(F.lit(300.0), F.lit(400.0), F.lit(500.0)), F.lit(500.0))
    return V.table(spark, d, "lineitem").select(*KEY, price.alias("price"), both["amount"].alias("amount"), both["sign"].alias("sign"), both["column"].alias("column"), both["balance"].alias("balance"))


def code_totals(spark, d):
    return reconcile.printed_group_totals(V.view(spark, d, V.CODE_ROWS), ["doc_id"], ["seq"])


def _jobs(spark, d):
    """The rows of V.JOB_ROWS as one chain of steps by order: dealt once into parts that don't grow with the table, and sorted once."""
    items = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("job_id"), "l_linenumber", "l_partkey", "l_extendedprice", "l_returnflag")
    orders = V.table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_totalprice").cast(S.MONEY).alias("beginning"), F.col("o_custkey").alias("doc_id"))
    by = Window.partitionBy("job_id").orderBy("l_linenumber", "l_partkey", "l_extendedprice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    amount = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(-F.col("l_extendedprice")).cast(S.MONEY)
    rows = spread(items, "job_id").join(orders, "job_id").withColumn("amount", amount)
    rows = rows.withColumn("seq", F.row_number().over(by)).withColumn("running", F.sum("amount").over(by))
    balance = F.col("beginning") + F.col("running") + F.when(F.col("job_id") % 50 == 0, F.lit("0.02").cast(S.MONEY)).otherwise(F.lit(0).cast(S.MONEY))
    return rows.select("job_id", "seq", "amount", "beginning", F.when(F.col("seq") % 3 == 0, balance.cast(S.MONEY)).alias("balance"), "doc_id")


def job_chain(spark, d):
    return settlement.job_chain(_jobs(spark, d), ["job_id"], ["seq"])


def job_proof(spark, d):
    rows = _jobs(spark, d)
    nets = settlement.job_nets(rows, ["doc_id", "job_id"], ["seq"])
    printed = rows.groupBy("doc_id", "job_id").agg((F.first("beginning") + F.sum("amount")).alias("net")).groupBy("doc_id").agg(F.sum("net").alias("s")).select(
        "doc_id", F.col("s").cast(S.MONEY).alias("total_jobs"), F.lit(-5).cast(S.MONEY).alias("adjustments"),
        (F.col("s") - F.when(F.col("doc_id") % 9 == 0, F.lit(6)).otherwise(F.lit(5))).cast(S.MONEY).alias("total_pay"),
    )
    return settlement.job_proof(nets, printed)


def order_pay_proof(spark, d):
    price = F.col("l_extendedprice").cast(S.MONEY)
    net = F.col("o_totalprice").cast(S.MONEY)
    rows = V.table(spark, d, "lineitem").join(V.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    total = rows.groupBy("o_orderkey").agg((F.max(net) + F.sum(price)).alias("t")).select(
        F.col("o_orderkey").alias("order_id"), (F.col("t") + F.when(F.col("o_orderkey") % 13 == 0, F.lit(1)).otherwise(F.lit(0))).cast(S.MONEY).alias("printed")
    )
    typed = rows.select(F.col("o_orderkey").alias("order_id"), net.alias("net"), price.alias("amount")).join(total, "order_id")
    return settlement.order_pay(typed, ["order_id"])


def cross_foot(spark, d):
    c = V.table(spark, d, "customer")
    base = F.col("c_acctbal").cast(S.MONEY)
    off = F.when(F.col("c_custkey") % 10 == 0, F.lit(3)).otherwise(F.lit(0))
    values = {
        "order_total_sum": base, "order_pay": base, "driver_deductions": F.lit(-20), "driver_net": base - 20, "driver_net_sum": base - 20,
        "summary_order_pay": base - 20 + off, "other_earnings": F.lit(7), "gross": base - 13 + off, "deductions": F.lit(-4), "reimbursements": F.lit(2), "net_pay": base - 15 + off,
    }
    figures = c.select("c_custkey", F.explode(F.array(*(
        F.struct(F.lit(n).alias("name"), v.cast(S.MONEY).alias("amount"), F.lit(i).alias("seq")) for i, (n, v) in enumerate(values.items())))).alias("f")).select("c_custkey", "f.*")
    return settlement.cross_foot(figures.filter(~((F.col("name") == "net_pay") & (F.col("c_custkey") % 17 == 0))), ["c_custkey"]).drop("earnings_ok", "deductions_ok", "reimbursements_ok")


def cross_foot_parts(spark, d):
    """G17 with the itemised parts: each of their three identities is off for some customers, whose printed totals agree."""
    c = V.table(spark, d, "customer")
    base = F.col("c_acctbal").cast(S.MONEY)
    off = lambda k: F.when(F.col("c_custkey") % k == 0, F.lit(1)).otherwise(F.lit(0))
    values = {
        "summary_order_pay": base, "other_earnings": F.lit(7), "earning_rows": 7 + off(7), "gross": base + 7, "deductions": F.lit(-9),
        "driver_deduction_rows": -2 - off(11), "recurring_rows": F.lit(-3), "itemized_rows": F.lit(-4), "reimbursements": F.lit(5),
        "order_reimbursement_rows": 2 + off(13), "page_reimbursement_rows": F.lit(3), "net_pay": base + 3,
    }
    figures = c.select("c_custkey", F.explode(F.array(*(
        F.struct(F.lit(n).alias("name"), v.cast(S.MONEY).alias("amount"), F.lit(1).alias("seq")) for n, v in values.items()))).alias("f")).select("c_custkey", "f.*")
    return settlement.cross_foot(figures, ["c_custkey"]).select("c_custkey", "earnings_ok", "gross_ok", "deductions_ok", "reimbursements_ok", "net_pay_ok", "passed")


def report_totals(spark, d):
    """G12 over the line items of each supplier: one code total and one report total, off for some."""
    amount = F.col("l_extendedprice").cast(S.MONEY)
    rows = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.struct(F.lit(0), "l_orderkey", "l_linenumber", "l_partkey").alias("seq"), amount.alias("amount"))
    sums = rows.groupBy("doc_id").agg(F.sum("amount").alias("s"), F.count("*").alias("n"))
    last = lambda k: F.struct(F.lit(k), F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(0).cast("long")).alias("seq")
    off = lambda k: F.when(F.col("doc_id") % k == 0, F.lit(1)).otherwise(F.lit(0))
    codes = sums.filter("doc_id % 11 <> 0").select("doc_id", last(1), F.col("n").alias("printed_n"), F.col("s").cast(S.MONEY).alias("printed_sum"))
    report = sums.filter("doc_id % 7 <> 0").select("doc_id", last(2), (F.col("n") + off(5)).alias("report_n"), (F.col("s") + off(3)).cast(S.MONEY).alias("report_sum"))
    named = lambda t: t.withColumn("seq", t["seq"].cast("struct<col1:bigint,l_orderkey:bigint,l_linenumber:bigint,l_partkey:bigint>"))
    both = named(rows).unionByName(named(codes), allowMissingColumns=True).unionByName(named(report), allowMissingColumns=True)
    return settlement.report_totals(both, ["doc_id"], ["seq"])


def section_subtotals(spark, d):
    rows = V.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc_id"), F.col("l_returnflag").alias("section"), F.col("l_extendedprice").cast(S.MONEY).alias("amount"))
    printed = rows.groupBy("doc_id", "section").agg(F.sum("amount").alias("s"), F.count("*").alias("n")).select(
        "doc_id", "section", F.explode(F.array(
            F.struct(F.lit(1).alias("seq"), F.lit(0).cast(S.MONEY).alias("amount")),
            F.struct(F.lit(2).alias("seq"), (F.col("s") + F.when(F.col("n") % 4 == 0, F.lit(1)).otherwise(F.lit(0))).cast(S.MONEY).alias("amount")))).alias("p")
    ).select("doc_id", "section", "p.*")
    return settlement.section_subtotals(rows, printed, ["doc_id"])


def escrow_rollforward(spark, d):
    e = V.table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), F.col("ts").cast("date").alias("account"),
        F.when(F.col("event_type") == "purchase", "withdrawals").when(F.col("event_type") == "error", "previous").when(F.col("event_type") == "view", "new").otherwise("deposits").alias("part"),
        F.col("value").cast(S.MONEY).alias("v"),
    )
    signed = e.select("doc_id", "account", "part", F.when(F.col("part") == "withdrawals", -F.col("v")).otherwise(F.col("v")).alias("amount"))
    return settlement.escrow_rollforward(signed, ["doc_id", "account"])


def printed_vs_captured(spark, d):
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    captured = docs.filter("doc_id % 2 = 0").select("doc_id", F.explode(S.money_in_text(F.col("text"))).alias("amount")).withColumn("description", F.lit("paid 1.00"))
    return audit.printed_not_captured(docs, captured)


def printed_vs_altered(spark, d):
    """I1 over all documents: every third figure of each was captured with another amount."""
    docs = V.table(spark, d, "documents").select("doc_id", "text")
    captured = docs.select("doc_id", F.posexplode(S.money_in_text(F.col("text"))).alias("i", "value")).select(
        "doc_id", (F.col("value") + F.when(F.col("i") % 3 == 0, 1_000_000).otherwise(0)).cast(S.MONEY).alias("amount"), F.lit("paid 1.00").alias("description")
    )
    return audit.printed_not_captured(docs, captured)


def golden_compare(spark, d):
    golden = _events(spark, d).select("block_id", "seq", "amount", "section")
    found = golden.filter("seq % 101 <> 0").withColumn("amount", F.when(F.col("seq") % 103 == 0, F.col("amount") + 1).otherwise(F.col("amount")).cast(S.MONEY))
    return audit.golden_compare(found, golden, ["block_id", "seq"], ["amount", "section"])


def bank_projection(spark, d):
    txns = _events(spark, d).select(
        F.lit("events").alias("source"), F.lit("Bank").alias("institution"), F.lit("0000").alias("doc_account"),
        F.when(F.col("block_id") % 4 == 0, "Beginning balance").otherwise(F.concat(F.lit("Acct "), F.col("block_id").cast("string"))).alias("block_name"),
        (F.col("block_id") % 3 == 0).alias("is_credit_card"), F.col("day").alias("date"), F.concat(F.col("section"), F.lit(" "), F.col("seq").cast("string")).alias("description"),
        "amount", "balance", F.when(F.col("amount").isNull(), "NEEDS_REVIEW").otherwise("OK").alias("status"), F.lit("").alias("note"), F.col("section").alias("raw"),
    )
    return projection.bank_projection(txns)


def row_scan(spark, d):
    price = F.format_number(F.col("l_extendedprice").cast(S.MONEY), 2)
    shape = F.col("l_linenumber") % 4
    tokens = (
        F.when(shape == 0, F.array(F.date_format("l_shipdate", "MM/dd"), F.lit("Card"), F.lit("shop"), price))
        .when(shape == 1, F.array(F.lit("REF123"), F.date_format("l_shipdate", "M/d"), F.date_format("l_shipdate", "MM-dd"), F.lit("shop"), price, F.lit("-")))
        .when(shape == 2, F.array(F.date_format("l_shipdate", "MMM"), F.date_format("l_shipdate", "d,"), F.lit("-"), price, F.lit("shop"), F.lit("9.99")))
        .otherwise(F.array(F.lit("no"), F.lit("date"), price))
    )
    words = F.transform(tokens, lambda t, i: F.struct(t.alias("text"), (i * 40.0).alias("x0"), (i * 40.0 + 35.0).alias("x1")))
    rows = V.table(spark, d, "lineitem").withColumn("words", words).select(*KEY, statement.row_scan(F.col("words")).alias("r"))
    figure = lambda i, f: F.get("r.moneys", i)[f]
    return rows.select(
        *KEY, F.col("r.date.m").alias("m"), F.col("r.date.d").alias("d"), F.col("r.date2").isNotNull().alias("second"), F.size("r.moneys").alias("n"),
        figure(0, "value").alias("value"), figure(0, "sign").alias("sign"), F.col("r.description").alias("description"),
    )


def _event_lines(spark, d):
    return V.view(spark, d, V.EVENT_LINES)


def section_fill(spark, d):
    lines = _event_lines(spark, d)
    direction = statement.section_direction(F.col("text"), ["^deposits", "credits$"], ["debits"])
    return statement.section_fill(lines, ["doc_id"], ["seq"], F.col("text"), direction, F.col("event_type") == "error").select("doc_id", "seq", "section", "section_dir")


def stop_resume(spark, d):
    lines = _event_lines(spark, d).select(
        "doc_id", "seq", "page", "event_id", (F.col("event_type") == "purchase").alias("has_date"), (F.col("event_type") == "purchase").alias("has_money")
    )
    read = statement.stop_reading(lines, ["doc_id"], "page", ["seq"], F.col("event_id") % 41 == 0, (F.col("event_id") % 29 == 0) & (F.col("doc_id") % 2 == 0))
    return read.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("seq").alias("last"), F.max("incomplete").alias("incomplete"))


def wrapped_rows(spark, d):
    lines = _event_lines(spark, d).select("doc_id", "seq", "kind", "text", F.when(F.col("kind").isin("R", "M"), F.col("value")).alias("amount"))
    return statement.wrapped_rows(lines, ["doc_id"], "seq")


def sign_resolution(spark, d):
    rows = _event_lines(spark, d).select(
        "doc_id", "seq", F.col("value").alias("amount"), F.when(F.col("event_id") % 7 == 0, -1).alias("sign"),
        F.when(F.col("event_id") % 5 == 0, "deposits").when(F.col("event_id") % 11 == 0, "charges").alias("label"),
        F.when(F.col("event_id") % 3 == 0, 1).when(F.col("event_id") % 13 == 0, -1).alias("section_dir"),
        F.when(F.col("event_type") == "purchase", "Card pur chase at shop").when(F.col("event_type") == "signup", "Interest paid").otherwise("misc").alias("description"),
    )
    words = statement.word_direction(F.col("description"), [r"\binterest paid\b"], [r"\bpurchase\b"])
    out = statement.resolve_signs(
        rows, words, section_first=F.col("doc_id") % 2 == 0, default_direction=F.when(F.col("doc_id") % 5 == 0, -1).otherwise(0),
        card=F.col("doc_id") % 3 == 0, card_explicit=F.lit(-1),
    )
    return out.select("doc_id", "seq", "signed", "sign_source", "status", "note")


def card_summary_charges(spark, d):
    lines = _event_lines(spark, d)
    said = F.when(F.col("event_id") % 50 == 0, "In terest charge on purchases").otherwise("Shop in town")
    rows = lines.filter("event_type = 'purchase'").select("doc_id", said.alias("description"))
    summaries = lines.filter("event_type = 'view'").select(
        "doc_id", F.col("seq").alias("line_no"), F.when(F.col("event_id") % 2 == 0, "Interest").otherwise("Fees").alias("charge"),
        F.when(F.col("event_id") % 9 == 0, 0).otherwise(F.col("value")).cast(S.MONEY).alias("amount"), F.lit("2024-01-31").cast("date").alias("period_end"),
        (F.col("event_id") % 4 == 0).alias("year_to_date"),
    )
    return statement.card_summary_charges(rows, summaries, ["doc_id"])


def account_blocks(spark, d):
    lines = _event_lines(spark, d)
    value = F.when(F.col("event_id") % 3 != 0, F.col("value"))
    out = statement.account_blocks(lines, ["doc_id"], ["seq"], F.col("event_type") == "signup", value, F.col("event_type") == "purchase")
    return out.select("doc_id", "seq", "block_no")


def printed_balances(spark, d):
    kinds = F.create_map(*(F.lit(x) for x in ("signup", "begin_row", "error", "end_row", "click", "begin_fill", "view", "end_fill")))
    events = _event_lines(spark, d).select("doc_id", "page", "seq", kinds[F.col("event_type")].alias("kind"), F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("value"))
    return statement.printed_balances(events, ["doc_id", "page"], "seq")


def section_total_lines(spark, d):
    price = F.format_number(F.col("o_totalprice").cast(S.MONEY), 2)
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("TOTAL Checks paid  $"), price)).when(
        F.col("o_orderkey") % 3 == 1, F.concat(F.lit("Total "), F.col("o_orderpriority"), F.lit(" orders "), price, F.lit("-"))
    ).otherwise(F.concat(F.lit("Totals "), price))
    t = statement.section_total(text)
    return V.table(spark, d, "orders").select("o_orderkey", t["name"].alias("name"), t["amount"].alias("amount"))


def incremental_ingest(spark, d):
    """Events written as dropped files, taken in two runs; then the ledger proof over what arrived."""
    root = V.scratch(spark, "ingest")
    events = V.table(spark, d, "events").select("event_id", "user_id", "event_type", F.col("value").cast(S.MONEY).alias("value"))
    schema = "event_id long, user_id long, event_type string, value decimal(18,2)"
    totals = lambda rows: rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("value").cast(S.MONEY).alias("total"))
    for half in (0, 1):
        events.filter(F.col("event_id") % 2 == half).write.mode("append").parquet(f"{root}/drop")
        ingest(spark, f"{root}/drop", schema, totals, f"{root}/out", f"{root}/checkpoint")
    out = spark.read.parquet(f"{root}/out")
    return out.groupBy("user_id").agg(F.sum("n").alias("n"), F.sum("total").cast(S.MONEY).alias("total"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        money_tokens, document_figures, date_tokens, month_name_dates, statement_periods, statement_periods_more, text_facts, native_or_scan, profile_scores, statement_split,
        page_skew, line_groups, line_text, money_columns, nearest_column, column_labels, ocr_confidence, ocr_lines, balance_chain, chain_flags,
        statements_end_to_end, account_proofs, mixed_statements, mixed_ledger, mixed_outcomes, job_rows, job_settlement, coded_report, load_settlement,
        block_proof, hot_account_proof, hot_account_flags, hot_section_fill, section_totals, document_outcome, run_summary, run_severity, unexpected_states, code_totals, job_chain, job_proof, order_pay_proof, cross_foot, section_subtotals,
        escrow_rollforward, printed_vs_captured, golden_compare, bank_projection, row_scan, section_fill, stop_resume, wrapped_rows, sign_resolution,
        card_summary_charges, account_blocks, printed_balances, section_total_lines, incremental_ingest,
        document_kind, settlement_route, settlement_projection, run_info, unread_tail, amount_balance, native_pages, statement_split_pages, printed_vs_altered, cross_foot_parts, report_totals,
    )
    return {f.__name__: f for f in every}
