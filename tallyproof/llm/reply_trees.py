"""Reply trees: root-to-leaf paths by iterative self-joins, formatted as conversations.

Messages name the message that they answer. Pointer doubling joins the table of pointers
with itself: after k rounds each message knows the one 2^k above it, and the count and the sum of
scores of the messages up to there, so that long threads take rounds by the logarithm of
their length. Leaves are ranked by the mean score of their path within their tree, and only the
chosen paths are spelled out, again by doubling: round k adds the messages 2^k above those found.

The template puts markers of the form ``<|...|>`` around roles and texts. In texts and roles a
backslash becomes two and ``<|`` becomes ``<\\|``, so no text can hold a marker and all can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared_dir, stored

OPEN, SAYS, CLOSE = "<|turn|>", "<|says|>", "<|end|>"


def escaped(text: Column) -> Column:
    """Text without markers; null counts as empty."""
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def with_parents(messages: DataFrame, id_col: str, parent_col: str, role_col: str, text_col: str, score_col: str | None, at: str) -> DataFrame:
    """rid, parent (a rid), id, role, text, score of each message, written under ``at``.

    A message whose parent is null, itself or nowhere to be found begins a tree. Of several rows with one id
    the least by role, text and score is the one that others answer.
    """
    score = F.lit(0.0) if score_col is None else F.coalesce(messages[score_col].cast("double"), F.lit(0.0))
    rows = messages.select(
        F.monotonically_increasing_id().alias("rid"), messages[id_col].alias("id"), messages[parent_col].alias("answers"),
        messages[role_col].cast("string").alias("role"), messages[text_col].cast("string").alias("text"), score.alias("score"),
    )
    rows = stored(rows, "messages", at)
    asked = rows.select("answers").distinct()
    known = rows.filter("id is not null").join(asked.withColumnRenamed("answers", "id"), "id")
    known = known.groupBy("id").agg(F.min_by("rid", F.struct(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")), "score", "rid")).alias("parent"))
    answers = rows.filter("answers is not null").join(known.withColumnRenamed("id", "answers"), "answers").filter("parent <> rid")
    return stored(answers.select("rid", "parent").join(rows.drop("answers"), "rid", "right"), "messages", at)


def _climbed(nodes: DataFrame, at: str) -> tuple[DataFrame, list[DataFrame]]:
    """(rid, root, steps, total) of each message below a root, and for each k the pairs (rid, up) of messages 2^k apart."""
    first = nodes.select("rid", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total"), F.col("rid").alias("root"))
    first = stored(first, "pointers", at)
    ends, below, jumps = first.filter("up is null"), first.filter("up is not null"), []
    most = nodes.count()
    while 1 << len(jumps) <= most and not below.isEmpty():
        jumps.append(below.select("rid", "up"))
        above = ends.unionByName(below).select(F.col("rid").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("total").alias("sum"), F.col("root").alias("top"))
        moved = below.join(above, "up").select(
            "rid", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("sum")).alias("total"), F.col("top").alias("root")
        )
        moved = stored(moved, "pointers", at)
        ends, below = ends.unionByName(moved.filter("up is null")), moved.filter("up is not null")
    return ends.drop("up"), jumps


def best_paths(nodes: DataFrame, best: int, at: str) -> DataFrame:
    """(leaf, rid, place, branch) of the messages on the chosen paths; place counts from 0 at the root, branch from 1."""
    ends, jumps = _climbed(nodes, at)
    leaves = ends.join(nodes.select(F.col("parent").alias("rid")).distinct(), "rid", "left_anti")
    order = Window.partitionBy("root").orderBy(F.desc(F.col("total") / F.col("steps")), "rid")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).filter(F.col("branch") <= best)
    path = stored(chosen.select(F.col("rid").alias("leaf"), "rid", (F.col("steps") - 1).alias("place"), "branch"), "paths", at)
    for k, jump in enumerate(jumps):
        above = path.join(jump, "rid").select("leaf", F.col("up").alias("rid"), (F.col("place") - (1 << k)).alias("place"), "branch")
        path = stored(path.unionByName(above), "paths", at)
    return path


def conversations(
    messages: DataFrame, *, best: int = 1, loss_role: str = "assistant", id_col: str = "id", parent_col: str = "parent", role_col: str = "role", text_col: str = "text", score_col: str | None = None
) -> DataFrame:
    """The ``best`` branches (at most 1,000) of each tree, each formatted as one conversation.

    leaf_id, branch (rank by the path's mean score, ties by the message's place in the table), formatted string,
    turns array<struct<start, loss_start, loss_end>>: code point offsets in ``formatted`` of each turn and of what its role's
    text gives to the loss (equal offsets where the role is another).

    Null roles and texts count as empty, null scores as 0. Messages without a parent in the table begin trees.
    Repeated rows are messages of their own. Messages that answer each other in a ring have no path.
    An empty table gives an empty one. A conversation is a row, so it has to fit in one (2 GB); nothing
    else is gathered whole: a tree with any number of leaves is ranked from each task's first ``best``.
    Columns other than the named ones are not read. Tables of the rounds stay under spark.checkpoint.dir until the
    cluster clears it.
    """
    if not 1 <= best <= 1000:
        raise ValueError("best is from 1 to 1000")
    spark = messages.sparkSession
    at = shared_dir(spark, "reply_trees")
    nodes = with_parents(messages, id_col, parent_col, role_col, text_col, score_col, at)
    path = best_paths(nodes, best, at)
    turns = path.join(nodes.select("rid", "id", "role", "text"), "rid")
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SAYS))
    turns = turns.select("leaf", "branch", "place", "id", head.alias("head"), escaped(F.col("text")).alias("body"), F.coalesce(F.col("role") == loss_role, F.lit(False)).alias("loss"))
    n_head, n_body = F.length("head").cast("long"), F.length("body").cast("long")
    before = Window.partitionBy("leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(n_head + n_body + len(CLOSE)).over(before), F.lit(0))
    begin = F.col("start") + n_head
    span = F.struct("start", begin.alias("loss_start"), (begin + F.when(F.col("loss"), n_body).otherwise(0)).alias("loss_end"))
    placed = turns.withColumn("start", start).withColumn("span", span)
    whole = placed.groupBy("leaf", "branch").agg(F.array_sort(F.collect_list(F.struct("place", "id", "head", "body", "span"))).alias("t"))
    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    return whole.select(F.element_at("t", -1)["id"].alias("leaf_id"), "branch", formatted.alias("formatted"), F.col("t.span").alias("turns"))


def read_back(formatted: DataFrame, *keep: str) -> DataFrame:
    """Roles and texts of formatted conversations, and the text under the loss mask, all unescaped.

    The columns of ``keep``, formatted, said array<struct<role, text>>, loss array<string>: one for each turn, empty where it has none.
    """
    pieces = F.split("formatted", r"<\|end\|>")
    whole = F.transform(
        F.arrays_zip(F.slice(pieces, 1, F.size(pieces) - 1).alias("p"), F.col("turns").alias("s")),
        lambda z: F.struct(
            unescaped(F.substring_index(F.substring(z["p"], len(OPEN) + 1, 1 << 30), SAYS, 1)).alias("role"),
            unescaped(F.substring_index(z["p"], SAYS, -1)).alias("text"),
            unescaped(F.substr(z["p"], (z["s"]["loss_start"] - z["s"]["start"] + 1).cast("int"), (z["s"]["loss_end"] - z["s"]["loss_start"]).cast("int"))).alias("loss"),
        ),
    )
    rows = formatted.select(*keep, "formatted", whole.alias("w"))
    return rows.select(*keep, "formatted", F.transform("w", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("said"), F.col("w.loss").alias("loss"))


def threads(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversations by turn as messages: conv_id, id, parent, role, text; each row answers the one before it.

    Rows of one conversation are put in the order of turn, role and text, nulls first; repeated rows follow each
    other. Rows without a conversation's id make up one conversation.
    """
    rows = turns.select(turns[conv_col].alias("conv_id"), turns[turn_col].alias("turn"), turns[role_col].cast("string").alias("role"), turns[text_col].cast("string").alias("text"))
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    name = lambda n: F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), n.cast("string"))
    return rows.withColumn("at", at).select(
        "conv_id", F.struct("conv_id", name(F.col("at")).alias("name")).alias("id"),
        F.when(F.col("at") > 1, F.struct("conv_id", name(F.col("at") - 1).alias("name"))).alias("parent"), "role", "text",
    )


def conversation_digest(turns: DataFrame, *, loss_role: str = "assistant") -> DataFrame:
    """Formats conversations by turn, writes them, reads them back, and returns digests of what was read.

    conv_id, n_turns, turns_sha256 (role, \\n, text, \\n of each turn), loss_chars, loss_sha256 (code points and digest of the
    text under the loss mask), formatted_chars.
    """
    made = stored(conversations(threads(turns), loss_role=loss_role), "conversations", shared_dir(turns.sparkSession, "formatted"))
    read = read_back(made.withColumn("conv_id", F.col("leaf_id.conv_id")), "conv_id")
    told = F.array_join(F.transform("said", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id", F.size("said").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
