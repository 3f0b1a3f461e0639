r"""Chat formatting: reply trees into conversations, with columns and SQL functions only.

``branches`` finds root-to-leaf paths by self-joins that double the step each round (the pointer of a message jumps to the pointer of
its target), so a thread of n messages takes log2(n) rounds. Branches are ranked by the sum of their messages' scores.

Template: every turn is ``### role: text</turn>`` and a line end. In roles and texts ``\``, ``#``, ``<`` and (roles only) ``:`` are
escaped as ``\b``, ``\h``, ``\l`` and ``\c``, so no mark of the template can arise from a text, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.storage import written

#: Fixed marks of the template.
HEAD, SEP, TAIL = "### ", ": ", "</turn>\n"


def escaped(text: Column, role: bool = False) -> Column:
    for raw, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), *([(":", "\\c")] if role else [])):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    """Inverse of :func:`escaped`. A backslash only ever starts a code, so the codes can't be mistaken for one another."""
    for code, raw in (("\\c", ":"), ("\\l", "<"), ("\\h", "#"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def branches(messages: DataFrame, best: int | None = 1) -> DataFrame:
    """messages(tree, id, parent, score, ...) -> (tree, leaf, place, id): the ``best`` branches of each tree (all with None), from the root.

    ``tree`` may be null (a tree of its own), ``id`` is unique in a tree; a parent that is null or absent makes a root. Score null
    counts 0; ties go to the smaller leaf id. A cycle of replies has no root and no leaf and yields nothing.
    """
    m = messages.select("tree", "id", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    same = lambda a, b, x, y: F.expr(f"{a}.tree <=> {b}.tree and {a}.{x} = {b}.{y}")
    known = m.select("tree", "id")
    m = m.alias("m").join(known.alias("k"), same("m", "k", "parent", "id"), "left").select("m.tree", "m.id", F.col("k.id").alias("parent"), "m.score")
    # up: the message 2^round steps above (null beyond the root), root so far, steps and score from this message up to before ``up``.
    now = written(m.select("tree", "id", F.col("parent").alias("up"), F.lit(1).cast("long").alias("steps"), "score", F.when(F.col("parent").isNull(), F.col("id")).alias("root")), "chat-up")
    links = []
    open_ = now.where("up is not null").count()
    while open_:
        links.append(now)
        # Only messages that have not reached their root jump on.
        step = now.where("up is not null").alias("a").join(now.alias("b"), same("a", "b", "up", "id"))
        step = step.select("a.tree", "a.id", "b.up", (F.col("a.steps") + F.col("b.steps")).alias("steps"), (F.col("a.score") + F.col("b.score")).alias("score"), "b.root")
        now = written(step.unionByName(now.where("up is null")), "chat-up")
        left = now.where("up is not null").count()
        if left == open_:
            break  # only cycles, and what hangs from them, are left: any other thread has a message that reached its root just now
        open_ = left
    rooted = now.where("root is not null")
    parents = m.where("parent is not null").select("tree", F.col("parent").alias("id"))
    leaves = rooted.alias("n").join(parents.alias("p"), same("n", "p", "id", "id"), "left_anti").select("tree", F.col("id").alias("leaf"), "score", "steps")
    if best is not None:
        rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf"))
        leaves = leaves.withColumn("rank", rank).where(F.col("rank") <= best).drop("rank")
    # Downwards from the leaves: a path holds the messages of stride 2^k; each round adds those half a stride above.
    path = leaves.select("tree", "leaf", F.col("leaf").alias("id"), F.col("steps").alias("place"))
    for k, link in reversed(list(enumerate(links))):
        above = path.alias("p").join(link.where("up is not null").alias("l"), same("p", "l", "id", "id"))
        path = path.unionByName(above.select("p.tree", "p.leaf", F.col("l.up").alias("id"), (F.col("p.place") - F.lit(1 << k)).alias("place")))
        path = path if k % 3 else written(path, "chat-path")
    return path


def formatted(turns: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """turns(conv, place, role, text) -> (conv, formatted, mask): one text a conversation and the (start, length) of each learned text in
    code points, both from 0. A null text or role counts as empty. Rows of a conversation are ordered by place.
    """
    head = F.concat(F.lit(HEAD), escaped(F.coalesce("role", F.lit("")), role=True), F.lit(SEP))
    rows = turns.select("conv", "place", head.alias("head"), escaped(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role").isin(*learned), F.lit(False)).alias("learned"))
    rows = rows.withColumn("size", F.length("head") + F.length("body") + len(TAIL))
    upto = Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("size").over(upto), F.lit(0)) + F.length("head"))
    turn = F.struct("place", F.concat("head", "body", F.lit(TAIL)).alias("said"), "start", F.length("body").alias("length"), "learned")
    sorted_ = rows.groupBy("conv").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["learned"]), lambda x: F.struct(x["start"].cast("long").alias("start"), x["length"].cast("long").alias("length")))
    return sorted_.select("conv", F.concat_ws("", F.transform("t", lambda x: x["said"])).alias("formatted"), mask.alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv, formatted, mask) -> also turns ARRAY<STRUCT<role, text>> and under_mask, the texts the mask covers, unescaped."""
    parts = F.expr("slice(split(formatted, '</turn>\\n'), 1, greatest(size(split(formatted, '</turn>\\n')) - 1, 0))")
    turn = lambda x: F.struct(unescaped(F.substring_index(F.substr(x, F.lit(len(HEAD) + 1)), SEP, 1)).alias("role"), unescaped(F.substr(x, F.instr(x, SEP) + len(SEP))).alias("text"))
    cut = F.transform("mask", lambda s: unescaped(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select("*", F.transform(parts, turn).alias("turns"), cut.alias("under_mask"))


def threads(rows: DataFrame, key: str = "conv_id", order: tuple[str, ...] = ("turn", "role", "text")) -> DataFrame:
    """Plain conversations as reply trees: every row answers the one before it. -> (tree, id, parent, score, role, text)"""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")
    return rows.select(F.col(key).alias("tree"), place.alias("id"), "role", "text").withColumn("parent", F.when(F.col("id") > 1, F.col("id") - 1)).withColumn("score", F.lit(1.0))


def conversations(messages: DataFrame, best: int | None = 1, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages(tree, id, parent, score, role, text) -> (tree, leaf, formatted, mask), one row a chosen branch."""
    messages = written(messages.select("tree", "id", "parent", "score", "role", "text"), "chat-messages")
    chosen = branches(messages, best)
    turns = chosen.alias("c").join(messages.alias("m"), F.expr("c.tree <=> m.tree and c.id = m.id"))
    turns = turns.select(F.struct("c.tree", "c.leaf").alias("conv"), "c.place", "m.role", "m.text")
    out = formatted(turns, learned)
    return out.select("conv.tree", "conv.leaf", "formatted", "mask")
