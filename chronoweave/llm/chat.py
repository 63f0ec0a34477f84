"""Reply trees to conversations, with DataFrame functions only.

A message names the message it replies to.  Pointer doubling walks these links:
a self-join of the table of ancestors at distance d gives those at 2 d, so a
tree of depth n takes log2 n self-joins, whatever its shape.  The same tables
carry the sum of scores on the way, so all branches (paths from the root to a
leaf) are ranked before any path is spelt out; then only the chosen leaves are
expanded, again by doubling, and each path becomes one conversation.

Template: ``<|role|>``, newline, text, ``</s>``, newline for each turn; roles
are URL-encoded.  In texts a backslash goes behind the first character of every
control string (and of those that a backslash stands in already), which is
undone by taking it out.  A conversation is an array of segments (text, loss):
their texts joined are the formatted conversation, and the mask is the segments
with loss, one for each text of an assistant.

Defined cases: a null text is the empty text, a null role the empty role; a
reply to a message that is not there starts a tree; messages that reply in a
circle start a tree at the circle's smallest id; rows that repeat an id (or
have none) are messages of their own, and replies go to the first of them by
parent, role and text; a null or NaN score counts as 0; ties in the score go to
the longer, then to the path of the smaller leaf; an empty table gives no rows;
extra columns never reach the operator.  One conversation has to fit into a
row, which is at most 2 GB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoweave.llm.common import Scratch

#: Ends of a turn and of its head, and what is escaped in texts.
END, HEAD = "</s>\n", "|>\n"
CONTROL = r"(?:/?s>|\||/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*" + CONTROL + ")", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*" + CONTROL + ")", "$1$2")


def segments(turns: Column, trained: str = "assistant") -> Column:
    """array<struct<text, loss>> of an array of structs (role, text) in order."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    turn = lambda t: F.array(piece(F.concat(F.lit("<|"), F.url_encode(t["role"]), F.lit(HEAD)), no), piece(escape(t["text"]), t["role"] == trained), piece(F.lit(END), no))
    return F.flatten(F.transform(turns, turn))


def formatted(parts: Column) -> Column:
    """The conversation as one text."""
    return F.array_join(F.transform(parts, lambda p: p["text"]), "")


def loss_text(parts: Column) -> Column:
    """All text under the mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(parts, lambda p: p["loss"]), lambda p: unescape(p["text"])), "")


def read_back(text: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    whole = F.filter(F.split(text, END), lambda p: p != "")
    role = lambda p: F.url_decode(F.substring(F.substring_index(p, HEAD, 1), 3, 2**31 - 1))
    body = lambda p: unescape(F.substring(p, F.locate(HEAD, p) + len(HEAD), F.length(p)))
    return F.transform(whole, lambda p: F.struct(role(p).alias("role"), body(p).alias("text")))


def _ancestors(links: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], bool]:
    """Tables (key, anc, last, total, n, low, fell) with the ancestors at distance 1, 2, 4 and so on.

    ``last`` is the farthest message reached, ``total``, ``n`` and ``low`` are
    the sum of scores, the number and the smallest key of the messages from
    ``key`` up to, but without, ``anc``; ``fell`` says that ``low`` fell in the
    last round.  The second value tells of circles.
    """
    steps = [links.select("key", F.col("up").alias("anc"), F.col("key").alias("last"), F.col("score").alias("total"), F.lit(1).cast("long").alias("n"), F.col("key").alias("low"), F.lit(True).alias("fell"))]
    before = None
    while True:
        steps[-1] = t = scratch.table(steps[-1])
        # Each round ends some of the paths unless all that are left run in circles; these are done once ``low`` stands.
        left, fell = t.agg(F.count("anc"), F.count_if("fell")).first()
        if not left or (left == before and not fell):
            return steps, bool(left)
        before = left
        up = t.select(F.col("key").alias("anc"), F.col("anc").alias("anc2"), F.col("last").alias("last2"), F.col("total").alias("total2"), F.col("n").alias("n2"), F.col("low").alias("low2"))
        on = t.where("anc is not null").join(up, "anc")
        joined = on.select("key", F.col("anc2").alias("anc"), F.col("last2").alias("last"), (F.col("total") + F.col("total2")).alias("total"), (F.col("n") + F.col("n2")).alias("n"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("fell"))
        steps.append(joined.union(t.where("anc is null").withColumn("fell", F.lit(False))))


def conversations(
    messages: DataFrame, best: int = 1, conv_col: str = "conv_id", id_col: str = "msg_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text",
    score_col: str | None = None, trained: str = "assistant",
) -> DataFrame:
    """The ``best`` branches of every tree, each as one conversation.

    Columns: conv_id, root, leaf (ids), rank (1 is best), n_branches of the
    tree, score (the mean score of the path's messages) and segments.
    """
    scratch = Scratch(messages.sparkSession, "chat")
    score = F.nanvl(F.coalesce(messages[score_col].cast("double"), F.lit(0.0)), F.lit(0.0)) if score_col else F.lit(0.0)
    empty = F.lit("")
    m = messages.select(
        messages[conv_col].alias("conv"), messages[id_col].alias("id"), messages[parent_col].alias("parent"), F.coalesce(messages[role_col], empty).alias("role"), F.coalesce(messages[text_col], empty).alias("text"), score.alias("score")
    )
    again = F.row_number().over(Window.partitionBy("conv", "id").orderBy("parent", "role", "text", "score")) - 1
    none = F.lit(0).cast("int")
    m = m.select(
        F.struct("conv", "id", again.cast("int").alias("again")).alias("key"), F.when(F.col("parent").isNotNull(), F.struct("conv", F.col("parent").cast(m.schema["id"].dataType).alias("id"), none.alias("again"))).alias("to"), "role", "text", "score"
    )
    m = scratch.table(m)
    there = m.select(F.col("key").alias("to"), F.col("key").alias("up"))
    links = scratch.table(m.select("key", "to", "score").join(there, "to", "left").select("key", "up", "score"))
    steps, circles = _ancestors(links, scratch)
    if circles:  # the smallest message of a circle is what its own ancestors see as smallest
        far = steps[-1].select("key", "anc")
        cut = far.join(steps[-1].select(F.col("key").alias("anc"), "low"), "anc").where(F.col("key") == F.col("low")).select("key", F.lit(True).alias("cut"))
        links = scratch.table(links.join(cut, "key", "left").select("key", F.when(F.col("cut").isNull(), F.col("up")).alias("up"), "score"))
        steps, _ = _ancestors(links, scratch)

    inner = links.select(F.col("up").alias("key")).where("key is not null").distinct()
    leaves = steps[-1].join(inner, "key", "left_anti").select(F.col("key").alias("leaf"), F.col("last").alias("root"), "n", (F.col("total") / F.col("n")).alias("score"))
    leaves = scratch.table(leaves)
    order = Window.partitionBy("root").orderBy(F.desc("score"), F.desc("n"), "leaf")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    chosen = scratch.table(chosen.join(leaves.groupBy("root").agg(F.count(F.lit(1)).alias("n_branches")), "root"))

    path = chosen.select("leaf", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("dist"))
    for k, t in enumerate(steps[:-1]):
        path = path if k == 0 else scratch.table(path)
        more = path.join(t.where("anc is not null").select(F.col("key").alias("node"), "anc"), "node")
        path = path.union(more.select("leaf", F.col("anc").alias("node"), F.col("dist") + (1 << k)))
    turns = path.join(m.select(F.col("key").alias("node"), "role", "text"), "node")
    whole = turns.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("dist")).alias("at"), "role", "text"))).alias("turns"))
    return whole.join(chosen, "leaf").select(
        F.col("leaf.conv").alias("conv_id"), F.col("root.id").alias("root"), F.col("leaf.id").alias("leaf"), "rank", "n_branches", "score", segments(F.col("turns"), trained).alias("segments")
    )


def chained(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as messages that each reply to the turn before (ties: by role, then text)."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    r = rows.select("conv_id", "role", "text", F.row_number().over(w).alias("msg_id"))
    return r.withColumn("parent_id", F.when(F.col("msg_id") > 1, F.col("msg_id") - 1))


def digests(rows: DataFrame) -> DataFrame:
    """The columns of the contract for all conversations of a table and the planted one, -1."""
    said = "</s>[INST] ok [/INST]"
    planted = rows.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    c = conversations(chained(rows.select("conv_id", "turn", "role", "text").unionByName(planted)))
    c = c.withColumn("formatted", formatted(F.col("segments"))).withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss_text(F.col("segments")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return c.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "n_branches",
    )
