"""Chat formatting of reply trees, DataFrame functions only.

Messages form trees by parent id. Root-to-leaf paths come from iterative self-joins that double the distance: in
round k every (leaf, node) pair of the paths so far is joined with the node's ancestor 2^k steps up, and the
ancestors are joined with themselves; a tree of depth d takes log2(d) rounds. Branches of a tree are ranked by the
mean score of their messages, and each of the chosen paths becomes one conversation.

Template: ``<|im_start|>role<|im_sep|>text<|im_end|>`` for each turn, nothing between turns. Control strings
inside roles and texts (those of the template and the common ones listed in ``CONTROL``) get a backslash after
their first character; a text that already has such a form gets one more, so unescaping is exact for every text.
The loss mask holds (start, length) in code points of each assistant text in the formatted string.

Defined results: null text or role counts as empty. A message whose parent is missing or null is a root; of
messages that repeat an id all are kept and ordered by text. A cycle has no root and no leaf and gives no path.
``linear_messages`` turns rows (conversation, turn) into chains: rows are ordered by turn (null first), then role
and text, and repeated rows are turns of their own; a null conversation id is one conversation. Extra columns
are ignored; an empty table gives an empty result. A conversation is one row, so its whole text is in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import columns_of, stored

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
# fixed values: control strings of common chat templates, without their first character
CONTROL = ["|im_start|>", "|im_sep|>", "|im_end|>", "|endoftext|>", "|system|>", "|user|>", "|assistant|>", "s>", "/s>",
           "unk>", "<SYS>>", "</SYS>>", "INST]", "/INST]"]
LOSS_ROLE = "assistant"


def _pattern(slashes: str) -> str:
    rest = "|".join("".join("\\" + c if c in "|[]<>/" else c for c in x) for x in CONTROL)
    return rf"([<\[]){slashes}({rest})"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _pattern(r"(\\*)"), r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _pattern(r"\\(\\*)"), "$1$2$3")


def linear_messages(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                    text_col: str = "text") -> DataFrame:
    """Rows by turn as chains of messages (tree, msg, parent, role, text, score)."""
    rows = columns_of(df, tree=conv_col, turn=turn_col, role=role_col, text=text_col)
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "text"))
    return (rows.withColumn("msg", place)
            .select("tree", F.col("msg").cast("long").alias("msg"),
                    F.when(F.col("msg") > 1, F.col("msg") - 1).cast("long").alias("parent"), "role", "text",
                    F.lit(0.0).alias("score")))


def paths(messages: DataFrame) -> DataFrame:
    """(tree, leaf, msg, up): every message of every root-to-leaf path, ``up`` steps above its leaf."""
    nodes = stored(messages.select("tree", "msg", "parent", "score").distinct(), "chat-nodes")
    known = nodes.select("tree", F.col("msg").alias("parent")).distinct()
    child = nodes.select("tree", "msg", "parent").where("parent is not null and msg is not null")
    # links whose parent exists
    jump = stored(child.join(known, [child["tree"].eqNullSafe(known["tree"]), child["parent"] == known["parent"]], "left_semi")
                  .distinct().toDF("tree", "msg", "above"), "chat-jump")
    parents = jump.select("tree", F.col("above").alias("msg")).distinct()
    ids = nodes.select("tree", "msg").distinct()
    leaves = ids.join(parents, [ids["tree"].eqNullSafe(parents["tree"]), ids["msg"].eqNullSafe(parents["msg"])], "left_anti")
    walk = stored(leaves.select("tree", F.col("msg").alias("leaf"), "msg", F.lit(0).cast("long").alias("up")), "chat-walk")
    step, limit = 1, None
    while not jump.isEmpty():
        if limit is None:
            limit = 4 * nodes.count() + 4
        if step > limit:  # only a cycle has ancestors beyond the number of messages
            break
        a, j = walk.alias("a"), jump.alias("j")
        found = (a.join(j, [F.col("a.tree").eqNullSafe(F.col("j.tree")), F.col("a.msg") == F.col("j.msg")])
                 .select("a.tree", "a.leaf", F.col("j.above").alias("msg"), (F.col("a.up") + step).alias("up")))
        walk = stored(walk.unionByName(found), "chat-walk")
        x, y = jump.alias("x"), jump.alias("y")
        jump = stored(x.join(y, [F.col("x.tree").eqNullSafe(F.col("y.tree")), F.col("x.above") == F.col("y.msg")])
                      .select("x.tree", "x.msg", "y.above"), "chat-jump")
        step *= 2
    # a path ends at a message without a parent among the messages; a leaf that hangs on a cycle has none
    linked = child.join(known, [child["tree"].eqNullSafe(known["tree"]), child["parent"] == known["parent"]], "left_semi") \
        .select("tree", "msg").distinct()
    w = walk.alias("w")
    ended = (w.join(linked.alias("l"), [F.col("w.tree").eqNullSafe(F.col("l.tree")), F.col("w.msg").eqNullSafe(F.col("l.msg"))], "left_anti")
             .select("tree", "leaf").distinct())
    return w.join(ended.alias("e"), [F.col("w.tree").eqNullSafe(F.col("e.tree")), F.col("w.leaf").eqNullSafe(F.col("e.leaf"))], "left_semi")


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """(tree, leaf, branch, branch_score, n_turns, formatted, loss_mask): the ``branches`` best paths of each tree
    (all of them by default), one row each."""
    rows = stored(messages.select("tree", "msg", "parent", F.coalesce("role", F.lit("")).alias("role"),
                                  F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score")),
                  "chat-messages")
    walk = paths(rows)
    if branches is not None:
        scores = walk.alias("w").join(rows.select("tree", "msg", "score").alias("r"), _same_message("w", "r"))
        mean = scores.groupBy(F.col("w.tree").alias("tree"), F.col("w.leaf").alias("leaf")).agg(F.avg("r.score").alias("mean"))
        best = Window.partitionBy("tree").orderBy(F.col("mean").desc(), "leaf")
        chosen = mean.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
        w, c = walk.alias("w"), chosen.alias("c")
        walk = w.join(c, [F.col("w.tree").eqNullSafe(F.col("c.tree")), F.col("w.leaf").eqNullSafe(F.col("c.leaf"))],
                      "left_semi")
    turn = F.struct((-F.col("w.up")).alias("at"), F.col("r.msg").alias("msg"), escape(F.col("r.role")).alias("role"),
                    escape(F.col("r.text")).alias("text"), (F.col("r.role") == LOSS_ROLE).alias("loss"))
    told = (walk.alias("w").join(rows.alias("r"), _same_message("w", "r"))
            .groupBy(F.col("w.tree").alias("tree"), F.col("w.leaf").alias("leaf"))
            .agg(F.sort_array(F.collect_list(turn)).alias("turns"), F.avg("r.score").alias("branch_score")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("branch_score").desc(), "leaf"))
    return (told.withColumn("formatted", F.array_join(F.transform("turns", _turn), ""))
            .withColumn("loss_mask", _mask(F.col("turns")))
            .withColumn("branch", rank)
            .select("tree", "leaf", "branch", "branch_score", F.size("turns").cast("long").alias("n_turns"), "formatted",
                    "loss_mask"))


def _same_message(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.tree").eqNullSafe(F.col(f"{b}.tree")), F.col(f"{a}.msg").eqNullSafe(F.col(f"{b}.msg"))]


def _turn(t: Column) -> Column:
    return F.concat(F.lit(START), t["role"], F.lit(SEP), t["text"], F.lit(END))


def _mask(turns: Column) -> Column:
    """(start, length) of every assistant text in the formatted string."""
    head = len(START) + len(SEP)
    spans = "array<struct<start:int,length:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))

    def add(acc, t):
        text, role = F.char_length(t["text"]), F.char_length(t["role"])
        span = F.array(F.struct((acc["at"] + head + role).cast("int").alias("start"), text.cast("int").alias("length")))
        return F.struct((acc["at"] + head + role + text + len(END)).cast("int").alias("at"),
                        F.when(t["loss"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, add, lambda acc: acc["spans"])


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation."""
    parts = F.split(formatted, r"<\|im_end\|>")
    turns = F.slice(parts, 1, F.size(parts) - 1)
    body = F.transform(turns, lambda t: F.split(F.substr(t, F.lit(len(START) + 1)), r"<\|im_sep\|>"))
    return F.transform(body, lambda b: F.struct(unescape(b[0]).alias("role"), unescape(b[1]).alias("text")))


def loss_text(formatted: Column, mask: Column) -> Column:
    """All text under the mask, unescaped part by part."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(formatted, m["start"] + 1, m["length"]))), "")
