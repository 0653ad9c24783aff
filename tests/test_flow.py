import datetime as dt
from decimal import Decimal as D

from tallyproof.operators import documents as B
from tallyproof.operators import flow, geometry, statement
from tallyproof.operators.profiles import Profile
from tallyproof.sources.tables import shared_table

PROFILE = Profile(
    credit_headings=(r"^Deposits",), debit_headings=(r"^Withdrawals",), markers=(r"^(\w+ Account) \d+$",), credit_words=("refund",),
    begin_labels=(r"opening balance",), end_labels=(r"closing balance",), stops=(r"^IMPORTANT NOTICE",), running_balance=True,
)
YEAR = "Period January 1, 2024 through February 28, 2024"


def words(spark, documents):
    """Pages of lines as word boxes; a figure's right edge is where its column says."""
    rows = []
    for doc, pages in documents.items():
        for page, lines in enumerate(pages, 1):
            for n, line in enumerate(lines):
                at = 20.0
                for i, token in enumerate(line.split()):
                    token, _, edge = token.partition("@")
                    x1 = float(edge) if edge else at + 6 * len(token)
                    rows.append((doc, page, n * 40 + i, token, x1 - 6 * len(token), x1, n * 14.0, n * 14.0 + 10))
                    at = x1 + 12
    return spark.createDataFrame(rows, "doc_id long, page int, word_idx int, text string, x0 double, x1 double, top double, bottom double")


def read(spark, documents, profiles=PROFILE):
    lines = flow.statement_lines(words(spark, documents), profiles)
    ledger = shared_table(flow.statement_rows(lines, profiles), "ledger")
    proofs = {(r["doc_id"], r["stmt_no"], r["block"]): r for r in flow.account_proofs(ledger).collect()}
    out = {r["doc_id"]: r for r in flow.document_outcomes(lines, ledger).collect()}
    rows = {}
    for r in sorted(ledger.collect(), key=lambda r: (r["doc_id"], r["stmt_no"], r["seq"])):
        rows.setdefault(r["doc_id"], []).append(r)
    return rows, proofs, out


def test_lines_become_proven_accounts(spark):
    good = [[YEAR, "Checking Account 11", "Beginning balance 01/01 $100.00@500", "Deposits and credits", "01/02 Salary of January 50.00@400", "part two of it",
             "01/03 Salary again 25.00@400 175.00@500", "Withdrawals", "01/04 Rent paid 75.00@400 100.00@500"],
            ["01/05 Late refund 5.00@400", "Ending balance $105.00@500", "Savings Account 12", "opening balance is $7.00@500", "Deposits", "02/01 Interest paid 1.00@400", "closing balance $8.00@500"]]
    boxed = [[YEAR, "Beginning Credits Debits Ending", "10.00@100 5.00@200 0.00@300 15.00@400", "Deposits", "01/02 Cheque cashed 5.00@400", "IMPORTANT NOTICE", "01/09 Not a row 9.00@400"]]
    unread = [[YEAR, "Beginning balance $1.00@500", "01/02 Some thing ??", "2.00@400", "01/03 Other thing 2.00@400", "Ending balance $1.00@500"]]
    late = [[YEAR, "Beginning balance $1.00@500", "Deposits", "01/02 First thing 2.00@400", "IMPORTANT NOTICE"], ["01/03 Unread thing 2.00@400"]]
    undated = [["Beginning balance $1.00@500", "Deposits", "01/02 First thing 2.00@400", "Ending balance $3.00@500"]]
    rows, proofs, out = read(spark, {1: good, 2: boxed, 3: unread, 4: [["nothing here"]], 5: late, 6: undated})
    one = proofs[1, 1, 1]
    assert (one["block_name"], one["rows"], one["total"], one["beginning"], one["ending"]) == ("Checking Account", 4, D("5.00"), D("100.00"), D("105.00"))
    assert one["passed"] is True and one["flagged"] == 0
    two = proofs[1, 1, 2]
    assert (two["block_name"], two["rows"], two["beginning"], two["ending"], two["passed"]) == ("Savings Account", 1, D("7.00"), D("8.00"), True)
    assert (proofs[2, 1, 1]["beginning"], proofs[2, 1, 1]["ending"], proofs[2, 1, 1]["rows"]) == (D("10.00"), D("15.00"), 1)
    said = {d: (r["rows"], r["state"], r["verdict"]) for d, r in out.items()}
    assert said[1] == (5, "proven", "PASSED") and said[2] == (1, "proven", "PASSED") and said[4] == (0, "failed", "NOT PROVABLE")
    assert said[3][1:] == ("unproven", "FAILED")
    assert said[5][1] == "unproven" and "stopped on page 1" in out[5]["detail"]  # a page behind the stop holds a row
    assert said[6][1:] == ("unproven", "NOT PROVABLE") and "Date '01/02'" in rows[6][0]["note"]  # no year, no date
    assert [r["date"] for r in rows[1]][:2] == [dt.date(2024, 1, 2), dt.date(2024, 1, 3)] and rows[1][0]["description"] == "Salary of January part two of it"
    assert flow.statement_outcomes(words(spark, {1: good}).limit(0), PROFILE).count() == 0


def test_repeated_page_heads_keep_one_account(spark):
    pages = [[YEAR, "Main Account 1", "Beginning balance $100.00@500", "Deposits", "01/02 Salary paid 30.00@400"], ["Main Account 1", "01/03 More salary 5.00@400", "Ending balance $135.00@500"]]
    rows, proofs, out = read(spark, {1: pages})
    assert list(proofs) == [(1, 1, 1)] and proofs[1, 1, 1]["block_name"] == "Main Account"
    assert proofs[1, 1, 1]["total"] == D("35.00") and proofs[1, 1, 1]["passed"] and out[1]["state"] == "proven"
    assert [r["section"] for r in rows[1]] == ["Deposits", "Deposits"]


def test_columns_are_labelled_by_their_header(spark):
    profile = Profile(begin_labels=("opening",))
    lines = [YEAR, "Beginning balance $100.00@600", "Date Text Withdrawals@400 Deposits@500", "01/02 Rent paid 10.00@400", "01/03 Rent again 10.00@400", "01/04 Some income 40.00@500", "01/05 More income 40.00@500", "Ending balance $160.00@600"]
    rows, proofs, out = read(spark, {1: [lines]}, profile)
    assert [r["amount"] for r in rows[1]] == [D("-10.00"), D("-10.00"), D("40.00"), D("40.00")] and {r["sign_source"] for r in rows[1]} == {"column:credit", "column:debit"}
    assert proofs[1, 1, 1]["total"] == D("60.00") and proofs[1, 1, 1]["passed"] and out[1]["state"] == "proven"
    titled = [YEAR, "Beginning balance $0.00@600", "Deposits and Other Additions", "01/02 Thing one 10.00@400 1.00@500", "01/03 Thing two 10.00@400 2.00@500"]
    rows, _, _ = read(spark, {1: [titled]}, profile)
    assert {r["sign_source"] for r in rows[1]} == {"unknown"}  # a section title is no header


def test_beginning_and_ending_rows_behind_dates_and_references(spark):
    lines = [YEAR, "Jan 01 Beginning Balance 500.00@500", "Deposits", "01/02 Salary paid 5.00@400", "4711 01/31 Ending Bal ance 505.00@500"]
    _, proofs, _ = read(spark, {1: [lines]})
    assert (proofs[1, 1, 1]["beginning"], proofs[1, 1, 1]["ending"], proofs[1, 1, 1]["passed"]) == (D("500.00"), D("505.00"), True)


MIXED = (
    Profile("north", fingerprints=(("North Bank", 40),), credit_words=("salary",), debit_words=("rent",), running_balance=True),
    Profile("south", fingerprints=(("South Bank", 40), ("Bank", 5)), credit_headings=("^Money in",), debit_headings=("^Money out",), require_section=True, stops=("^Fine print",), resumes=("^continued",), labels=(r"Statement of (\w+)",)),
    Profile("card", fingerprints=(("Card Co", 40),), card=True, card_explicit=1, credit_words=("payment",), debit_words=("purchase", "interest charged"), begin_labels=("previous balance",), end_labels=("new balance",),
            charges=((r"interest charged", "interest", "Interest charged"), (r"fees charged", "fee", "Fees charged"))),
)


def test_mixed_profiles_bundles_and_years_in_one_plan(spark):
    north = [["North Bank", YEAR, "Beginning balance $10.00@500", "01/02 Salary paid 5.00@400 15.00@500", "01/03 Rent paid 2.00@400 13.00@500", "Ending balance $13.00@500"]]
    south = [["South Bank", "Page 1 of 2 Statement of december", "Dec 5, 2023 - Jan 4, 2024", "Beginning balance $1.00@500", "01/01 Summary noise 9.00@400", "Money in", "12/31 Old year gift 4.00@400", "Fine print"],
             ["continued", "01/02 New year gift 4.00@400", "Money out", "01/03 A loss", "2.00@400", "Ending balance $7.00@500"],
             ["South Bank", "Page 1 of 1 Statement of january", "Jan 5, 2024 - Feb 4, 2024", "Beginning balance $7.00@500", "Money in", "02/01 Small gift 1.00@400", "Ending balance $8.00@500"]]
    card = [["Card Co", YEAR, "Interest charged year to date $9.00@400", "Interest charged $1.50@400", "Fees charged $0.00@400", "previous balance $50.00@500", "01/02 Purchase at shop 20.00@400", "01/05 Payment sent 30.00@400", "new balance $41.50@500"],
            ["Beginning balance $5.00@500", "01/09 Payment to savings 2.00@400", "Ending balance $7.00@500"]]
    other = [["Unknown", YEAR, "Beginning balance $1.00@500", "01/02 Plus thing +1.00@400", "Ending balance $2.00@500"]]
    rows, proofs, out = read(spark, {1: north, 2: south, 3: card, 4: other}, MIXED)
    assert [r["amount"] for r in rows[1]] == [D("5.00"), D("-2.00")] and [r["balance"] for r in rows[1]] == [D("15.00"), D("13.00")]
    assert [(r["stmt_no"], r["date"], r["amount"]) for r in rows[2]] == [
        (1, dt.date(2023, 12, 31), D("4.00")), (1, dt.date(2024, 1, 2), D("4.00")), (1, dt.date(2024, 1, 3), D("-2.00")), (2, dt.date(2024, 2, 1), D("1.00")),
    ]
    assert proofs[2, 1, 1]["block_name"].endswith(" December") and proofs[2, 2, 1]["block_name"].endswith(" January")
    assert [(r["description"], r["amount"], r["card"]) for r in rows[3]] == [
        ("Interest charged", D("1.50"), True), ("Purchase at shop", D("20.00"), True), ("Payment sent", D("-30.00"), True), ("Payment to savings", D("2.00"), False),
    ]
    assert rows[3][0]["date"] == dt.date(2024, 2, 28)
    assert {d: (r["profile"], r["confidence"], r["state"]) for d, r in out.items()} == {
        1: ("north", 70, "proven"), 2: ("south", 75, "proven"), 3: ("card", 70, "proven"), 4: ("generic", 50, "proven"),
    }


WRAPPED = [
    (["01/02 Waits for it 7.00@500", "9.00@500", "text 3.00@400", "more"], [("3.00", "7.00", "NEEDS_REVIEW")]),
    (["01/02 Waits for it", "nothing", "3.00@400"], []),
    (["01/02 Waits for it", "3.00@400 8.00@500", "9.00@500"], [("3.00", "8.00", "OK")]),
    (["01/02 ab", "c 3.00@400"], []),
    (["01/02 ab", "cd 3.00@400"], [("3.00", None, "OK")]),
    (["01/02 Waits for it", "01/03 5.00@400", "3.00@400"], []),
    (["01/02 First row 1.00@400", "01/03 5.00@400", "9.00@500"], [("1.00", "9.00", "OK")]),
]


def test_wrapped_rows_of_all_kinds(spark):
    head, tail = [YEAR, "Deposits", "01/01 Opening row 1.00@400 1.00@500"], ["Deposits", "01/09 Closing row 1.00@400 1.00@500"]
    rows, _, _ = read(spark, {i: [[*head, *lines, *tail]] for i, (lines, _) in enumerate(WRAPPED)})
    for i, (_, want) in enumerate(WRAPPED):
        got = [(str(r["amount"]), r["balance"] and str(r["balance"]), r["status"]) for r in rows[i]]
        assert got[1:-1] == want, i


def test_pages_are_grouped_like_windows_do(spark):
    pages = {d: [[f"row {i} {d}.00@{300 + (i * d) % 9} tail" for i in range(d * 7)]] for d in range(1, 6)}
    w = words(spark, pages).selectExpr("* except (top)", "top + x0 * 0.01 as top")
    want = sorted((r["doc_id"], r["page"], r["line_no"], r["text"]) for r in geometry.line_text(geometry.group_lines(w)).collect())
    got = geometry.page_lines(w).selectExpr("doc_id", "page", "inline(lines)").collect()
    assert sorted((r["doc_id"], r["page"], r["line_no"], r["text"]) for r in got) == want


def test_names_labels_and_owners(spark):
    texts = [(1, 1, "A", "\n  Some One (1/2/2024)\nPeriod: MARCH 2024"), (1, 2, "B", "no label"), (2, 1, "C", "Period: MAY 2024")]
    df = spark.createDataFrame(texts, "doc_id long, stmt_no int, block_name string, text string")
    got = {(r["doc_id"], r["stmt_no"]): r["block_name"] for r in B.bundle_names(df, [r"For (\w+)", r"Period: (\w+ \d+)"]).collect()}
    assert got == {(1, 1): "A March 2024", (1, 2): "B", (2, 1): "C"}
    owner = df.select(B.owner_name(df["text"], r"^([A-Za-z .'-]+?)\s*\(", r"Owner: (\w+)").alias("o"))
    assert [r["o"] for r in owner.collect()] == ["Some One", None, None]


def test_card_charges_stop_at_their_own_words(spark):
    rows = spark.createDataFrame([(1, "A late fee of May"), (2, "Shop")], "doc_id long, description string")
    said = "doc_id long, line_no int, charge string, amount decimal(18,2), period_end date, year_to_date boolean, stop string"
    end = dt.date(2024, 5, 31)
    lines = spark.createDataFrame([(1, 1, "Fees", D("5.00"), end, False, "fees|late fee"), (2, 1, "Fees", D("5.00"), end, False, "fees|late fee")], said)
    assert [r["doc_id"] for r in statement.card_summary_charges(rows, lines, ["doc_id"]).collect()] == [2]
