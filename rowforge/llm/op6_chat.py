"""Reply trees to formatted conversations, in DataFrame expressions only.

Messages name their parents.  Self-joins double their reach: round i joins each message with its ancestor 2**i above,
so a chain of n messages takes log2(n) rounds.  The same rounds add up the scores from each message to its root, a row a
message; branches are ranked by the sum at their leaf (ties: the smaller leaf), and only the chosen leaves'
paths are enumerated, by joining them with those ancestors.  Each is formatted with its loss mask.  A conversation is one
row in the end, so its length is bounded by what a row can hold (2 GB); until then its messages are dealt out by conversation
and message, but for the window that numbers turns.

The template writes `<|im_start|>role\\ntext<|im_end|>\\n` for each message.  Inside roles and texts `&` becomes
`&amp;` and `<|` becomes `&lt;|`, so no text can hold a mark; in roles a line end becomes `&#10;`.  Unescaping
runs the other way round and gives back every text.

Defined cases: a null role or text is empty; rows without a conversation id are left out; equal turns are
ordered by role and text, a null turn first; repeated rows are messages of their own; a message whose parent is
missing is a root; parents that run in a circle are an error; a null score counts as 0; very long texts are kept whole;
other columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowforge.sources.staging import scope, stage

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
MOST_ROUNDS = 40


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def reply_chains(conversations: DataFrame) -> DataFrame:
    """Rows by turn as messages: conv_id, node, parent, role, text, score."""
    rows = conversations.where(F.col("conv_id").isNotNull())
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    node = F.row_number().over(order).cast("long")
    return rows.select("conv_id", node.alias("node"), "role", "text").select("conv_id", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _jumps(messages: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """For k = 0, 1, ... each message's ancestor 2**k above (conv_id, node, far), if it has one; and each message's path_score, from it to its root."""
    links = messages.select("conv_id", "node", F.col("parent").alias("far"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("path_score"))
    known = links.select("conv_id", F.col("node").alias("far"), F.col("far").isNull().alias("_known"))
    rows = stage(links.join(known, ["conv_id", "far"], "left").select("conv_id", "node", F.when(F.col("_known").isNotNull(), F.col("far")).alias("far"), "path_score"))
    settled, climbing, jumps = rows.where("far is null"), rows.where("far is not null"), []
    for _ in range(MOST_ROUNDS):
        if climbing.isEmpty():
            return jumps, settled.select("conv_id", "node", "path_score")
        jumps.append(climbing.select("conv_id", "node", "far"))
        above = settled.unionByName(climbing).select("conv_id", F.col("node").alias("far"), F.col("far").alias("top"), F.col("path_score").alias("more"))
        rows = stage(climbing.join(above, ["conv_id", "far"]).select("conv_id", "node", F.col("top").alias("far"), (F.col("path_score") + F.col("more")).alias("path_score")))
        settled, climbing = settled.unionByName(rows.where("far is null")), rows.where("far is not null")
    raise ValueError("a message is its own ancestor")


def best_paths(messages: DataFrame, most: int | None = 1) -> DataFrame:
    """conv_id, leaf, node, above (how far the node is above the leaf), path_score and rank from 1 of the messages on each
    conversation's `most` best branches (None: on all)."""
    with scope():
        jumps, scores = _jumps(messages)
        parents = messages.where("parent is not null").select("conv_id", F.col("parent").alias("node")).distinct()
        leaves = scores.join(parents, ["conv_id", "node"], "left_anti").withColumnRenamed("node", "leaf")
        ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("path_score"), "leaf")))
        chosen = stage(ranked if most is None else ranked.where(F.col("rank") <= most))
        paths = chosen.select("conv_id", "leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above"))
        for k, jump in enumerate(jumps):
            found = paths.join(jump, ["conv_id", "node"]).select("conv_id", "leaf", F.col("far").alias("node"), (F.col("above") + (1 << k)).alias("above"))
            paths = stage(paths.unionByName(found))
        return stage(paths.join(chosen, ["conv_id", "leaf"]), keep=True)


def leaf_paths(messages: DataFrame) -> DataFrame:
    """conv_id, leaf, node, above of every root-to-leaf path."""
    return best_paths(messages, None).select("conv_id", "leaf", "node", "above")


def format_paths(messages: DataFrame, paths: DataFrame, learned: str = "assistant") -> DataFrame:
    """conv_id, leaf, rank, formatted, loss (spans [a, z) of code points: the texts of the learned role)."""
    turns = paths.join(messages.select("conv_id", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), ["conv_id", "node"])
    turns = turns.withColumns({"head": F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit("\n")), "body": escape(F.col("text"))})
    size = F.char_length("head") + F.char_length("body") + len(CLOSE)
    before = Window.partitionBy("conv_id", "leaf").orderBy(F.desc("above")).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("head")
    spans = turns.withColumn("a", begin).withColumn("z", F.col("a") + F.char_length("body"))
    piece = F.struct((-F.col("above")).alias("at"), F.concat("head", "body", F.lit(CLOSE)).alias("piece"), (F.col("role") == learned).alias("learn"), F.col("a").cast("int").alias("a"), F.col("z").cast("int").alias("z"))
    whole = spans.groupBy("conv_id", "leaf").agg(F.max("rank").alias("rank"), F.array_sort(F.collect_list(piece)).alias("pieces"))
    loss = F.transform(F.filter("pieces", lambda p: p["learn"]), lambda p: F.struct(p["a"].alias("a"), p["z"].alias("z")))
    return whole.select("conv_id", "leaf", "rank", F.array_join("pieces.piece", "").alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """role and text of each turn of a formatted conversation."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, "\n", 1)
        return F.struct(unescape_role(F.substring(head, F.lit(len(OPEN) + 1), F.char_length(head))).alias("role"), unescape(F.substring(piece, F.char_length(head) + 2, F.char_length(piece))).alias("text"))

    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under a loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, s["a"] + 1, s["z"] - s["a"]))), "")


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Format conversations given by turn, and digest what is read back from the output."""
    lean = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    messages = stage(reply_chains(lean))
    out = format_paths(messages, best_paths(messages))
    back = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
