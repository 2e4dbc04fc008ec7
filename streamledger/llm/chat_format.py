"""Chat formatting of reply trees, with DataFrame operations only.

Messages point at the message they answer. Self-joins that double the distance at
each step give every message its root, its depth and the score of the path to it;
leaves are ranked within their tree by that score; and the same doubled pointers,
read from the largest to the smallest, list the messages of each chosen path, each
once. A path of length n takes about log2(n) joins, whatever the tree's shape.

The template puts ``<|im_start|>role``, a line feed, the text and ``<|im_end|>`` with a
line feed around each turn. A text that holds a control string is kept apart from
the template's own by an escape that can be undone: between ``<`` and ``|`` one more
backslash than there was. In roles, ``%``, ``<``, carriage return and line feed are
percent-encoded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamledger.llm.common import stage, text_or_empty

START, END = "<|im_start|>", "<|im_end|>\n"


def escape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape_text(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    for plain, coded in (("%", "%25"), ("<", "%3C"), ("\r", "%0D"), ("\n", "%0A")):
        role = F.replace(role, F.lit(plain), F.lit(coded))
    return role


def unescape_role(role: Column) -> Column:
    for plain, coded in (("\n", "%0A"), ("\r", "%0D"), ("<", "%3C"), ("%", "%25")):
        role = F.replace(role, F.lit(coded), F.lit(plain))
    return role


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """Root-to-leaf paths of reply trees: ``tree_id, leaf, branch, depth, node``.

    ``messages(node long, parent long, tree_id, score double)``, ``node`` unique. A message
    whose parent is null or absent is a root. Each tree's ``branches`` paths with the
    highest sums of scores are listed (null scores count as 0; ties go to the smaller
    leaf), with the root at depth 0. Messages that only answer each other in a circle
    have no root and are on no path.
    """
    nodes = messages.select("node", "parent", "tree_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    known = nodes.select(F.col("node").alias("known"))
    nodes = nodes.join(known, F.col("parent") == F.col("known"), "left").withColumn("parent", F.col("known")).drop("known")
    # what is known of each message: how far up the pointer reaches, the score on the way, and where it points
    jump = stage(nodes.select("node", "tree_id", "parent", F.lit(1).cast("long").alias("hops"), "score"), "jumps")
    steps = [jump.where("parent is not null").select(F.col("node").alias("from"), F.col("parent").alias("to"))]
    open_before = None
    while True:
        still = jump.where("parent is not null").count()
        # the pointers of a circle never end; when 2^steps exceeds every path, only they are left
        if not still or still == open_before and len(steps) > 1 and 2 ** len(steps) > jump.count():
            break
        open_before = still
        up = jump.select(F.col("node").alias("parent"), F.col("parent").alias("next"), F.col("hops").alias("more"), F.col("score").alias("above"))
        # finished messages stay out of the join: their null pointers would all meet in one task
        moved = jump.where("parent is not null").join(up, "parent").select(
            "node", "tree_id", F.col("next").alias("parent"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("score") + F.col("above")).alias("score")
        )
        jump = stage(moved.unionByName(jump.where("parent is null")), "jumps")
        steps.append(jump.where("parent is not null").select(F.col("node").alias("from"), F.col("parent").alias("to")))
    # a message nobody answers ends a path
    leaves = jump.where("parent is null").join(nodes.where("parent is not null").select(F.col("parent").alias("node")).distinct(), "node", "left_anti")
    rank = Window.partitionBy("tree_id").orderBy(F.col("score").desc(), "node")
    chosen = leaves.withColumn("branch", F.row_number().over(rank)).where(F.col("branch") <= branches)
    found = stage(chosen.select("tree_id", F.col("node").alias("leaf"), "branch", (F.col("hops") - 1).alias("depth"), "node"), "paths")
    for k in reversed(range(len(steps))):
        above = found.join(steps[k], F.col("node") == F.col("from")).select("tree_id", "leaf", "branch", (F.col("depth") - 2**k).alias("depth"), F.col("to").alias("node"))
        # written out, as each step would else hold the plan of all steps before it twice
        found = stage(found.unionByName(above), "paths")
    return found


def format_paths(listed: DataFrame, messages: DataFrame) -> DataFrame:
    """Each path as one conversation: ``tree_id, branch, formatted, loss_spans``.

    ``messages(node, role, text)``; null roles and texts are empty. ``loss_spans`` are the
    places, in code points, of the assistant's escaped texts in ``formatted``.
    """
    turns = messages.select("node", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = turns.select("node", head.alias("head"), escape_text(F.col("text")).alias("body"), (F.col("role") == "assistant").alias("loss"))
    rows = listed.join(turns, "node").groupBy("tree_id", "branch", "leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "head", "body", "loss"))).alias("turns"))
    # the places follow from a running length
    spans = F.expr(f"""
        aggregate(turns, named_struct('at', 0L, 'spans', cast(array() as array<struct<start:bigint,stop:bigint>>)),
          (a, t) -> named_struct(
            'at', a.at + length(t.head) + length(t.body) + {len(END)},
            'spans', if(t.loss, array_append(a.spans, named_struct('start', a.at + length(t.head), 'stop', a.at + length(t.head) + length(t.body))), a.spans)),
          a -> a.spans)
    """)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return rows.select("tree_id", "branch", text.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``turns(role, text)`` and the text under the loss mask, taken from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_end\|>\n", -1), 1, F.size(F.split("formatted", r"<\|im_end\|>\n", -1)) - 1)

    def turn(piece: Column) -> Column:
        rest = F.substr(piece, F.lit(len(START) + 1))
        line = F.instr(rest, "\n")
        return F.struct(unescape_role(F.substr(rest, F.lit(1), line - 1)).alias("role"), unescape_text(F.substr(rest, line + 1)).alias("text"))

    def under(span: Column) -> Column:
        start, stop = span["start"].cast("int"), span["stop"].cast("int")
        return unescape_text(F.substr(F.col("formatted"), start + 1, stop - start))

    return formatted.withColumns({"turns": F.transform(pieces, turn), "loss_text": F.array_join(F.transform("loss_spans", under), "")})


def conversations_as_trees(conversations: DataFrame) -> DataFrame:
    """``conversations(conv_id, turn, role, text)`` as messages, each answering the turn before it.

    Turns follow by number (null first), then role and text; rows that repeat are turns
    of their own. Rows with a null conv_id are one conversation.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("tree_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    )
    rows = stage(rows.withColumn("node", F.monotonically_increasing_id()), "turns")
    order = Window.partitionBy("tree_id").orderBy("turn", "role", "text", "node")
    parents = rows.select("node", F.lag("node").over(order).alias("parent"), "tree_id", F.lit(0.0).alias("score"))
    return stage(parents, "parents").join(rows.select("node", "role", "text"), "node")
