"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in a shuffled, fixed order (md5 of seed, doc_id, text and, for rows equal in these, a number),
repeated up to ``epochs`` times. A copy's
virtual finish time is the source's words up to and with it, divided by the source's target. All copies are cut into ranges of
virtual time; the range in which the total budget is reached is sorted and cut inside, the ranges before are taken whole.

Sums along a queue never need a source in one task: words are summed by (source, bucket of the shuffle key) and then by (source),
over a number of buckets that follows the row count, and only inside a bucket row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.storage import written

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
EPOCHS = 2
SEED = "mix-0"
#: Rows that a bucket of a queue and a range of virtual time hold on average, at most.
BUCKET_ROWS = 512
#: Equal rows that are numbered together.
PIECE = 4096


def n_words(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size) -> also target. One row a source, so a handful of rows: the window below is over sources alone.

    Sources by code point, null last, weigh ``weights`` in turn. They share ``budget`` times all words; a target stops at ``epochs``
    times the source's size and the excess goes to the others by weight. With sources in order of cap / weight, the first k are at
    their cap for the smallest k at which the level of the rest does not pass the next source's ratio.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(epochs))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    out = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", cap)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("before_cap", F.coalesce(F.sum("cap").over(by_ratio), F.lit(0.0)))
        .withColumn("before_weight", F.coalesce(F.sum("weight").over(by_ratio), F.lit(0.0)))
        .withColumn("all_size", F.sum("source_size").over(everyone))
        .withColumn("all_weight", F.sum("weight").over(everyone))
        .withColumn("level", (F.col("all_size") * F.lit(budget) - F.col("before_cap")) / (F.col("all_weight") - F.col("before_weight")))
        .withColumn("first_level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.coalesce(F.col("source"), F.lit(""))))).over(everyone))
    )
    target = F.when(F.col("first_level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("first_level") * F.col("weight")))
    return out.select("source", "source_size", target.alias("target"))


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, epochs: int = EPOCHS, seed: str = SEED) -> DataFrame:
    """docs(doc_id, text, source, ...) -> one row a document: doc_id, source, size, source_size, target, copies and taken (copies * size).

    A null source is a source of its own; a null or empty text has size 0 and is never taken. Rows that are equal in doc_id, text and
    source are documents of their own, numbered, each with its place in the queue. An empty table gives an empty result. Reruns agree, as
    order and buckets depend on the rows' values alone. Columns other than the three are not looked at.
    """
    queue, copies = _taken(docs.select("doc_id", "source", "text"), weights, budget, epochs, seed)
    out = queue.withColumn("copies", copies)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def taken(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row of ``docs`` with all its columns, as often as :func:`mixed` takes it. Rows that are equal in doc_id, text
    and source, but not in other columns, may stand for one another."""
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = docs.select("*", _print(F.col("text")).alias("__print"))
    own = rows.toDF(*names, "__print")
    doc_id, source = (names[docs.columns.index(c)] for c in ("doc_id", "source"))
    queue, copies = _taken(docs.select("doc_id", "source", "text"), **({"weights": WEIGHTS, "budget": BUDGET, "epochs": EPOCHS, "seed": SEED} | options))
    # Of each kind of row: how many there are, and how many of them are taken k times.
    each = queue.withColumn("n", copies).groupBy("doc_id", "source", "print", "n").agg(F.count("*").alias("rows"))
    kinds = each.groupBy("doc_id", "source", "print").agg(F.max("n").alias("most"), F.min("n").alias("least"), F.array_sort(F.collect_list(F.struct("n", "rows"))).alias("each"))
    kinds = written(kinds.where("most > 0"), "mix-kinds").withColumnRenamed("doc_id", "id").withColumnRenamed("source", "of").withColumnRenamed("print", "p")
    match = F.col(doc_id).eqNullSafe(F.col("id")) & F.col(source).eqNullSafe(F.col("of")) & (F.col("__print") == F.col("p"))
    same = own.join(kinds.where("least = most"), match).withColumn("n", F.col("most")).select(*names, "n")
    uneven = kinds.where("least < most")
    if few := uneven.count():
        same = same.unionByName(_in_part(own.join(F.broadcast(uneven) if few <= PIECE else uneven, match), names))
    return same.where("n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select(*names).toDF(*docs.columns)


def _in_part(met: DataFrame, names: list[str]) -> DataFrame:
    """Rows of kinds that are not all taken equally often, with ``n``, how often each is."""
    # A kind whose rows are not all taken equally often straddles the end of the budget: one a source and epoch at most. Its rows are
    # numbered by two levels, as they may be very many, over a table, as any numbering of them will do but it must be one.
    odd = written(met.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(4096))), "mix-odd")
    by = ["id", "of", "p"]
    parts = odd.groupBy(*by, "part").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*by, "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy(*by, "part").orderBy(*names)) + F.col("before")
    odd = odd.alias("o").join(parts.alias("b"), _same("o", "b", *by, "part")).select("o.*", "before").withColumn("place", place)
    # From the rows taken least often upwards.
    upto = F.aggregate("each", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("n")), lambda x, e: F.when(x["n"] >= 0, x).otherwise(F.struct((x["sum"] + e["rows"]).alias("sum"), F.when(F.col("place") <= x["sum"] + e["rows"], e["n"]).otherwise(F.lit(-1).cast("long")).alias("n"))))
    return odd.withColumn("n", upto["n"]).select(*names, "n")


def _print(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def _taken(docs: DataFrame, weights: tuple, budget: float, epochs: int, seed: str) -> tuple[DataFrame, Column]:
    """The queue, a row a document, and how often each of its rows is taken."""
    kinds = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), _print(F.col("text")).alias("print")).groupBy("doc_id", "source", "size", "print").agg(F.count("*").alias("rows"))
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("/"), F.col("print"), F.lit("/"), F.col("number").cast("string")))
    base = written(_numbered(written(kinds, "mix-kinds")).withColumn("key", key), "mix-sizes")
    sources = written(source_targets(base.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, epochs), "mix-targets")
    rows = base.count()
    queue = written(_queue(base, sources, rows), "mix-queue")
    finish = [(F.col("cum") + F.lit(e) * F.col("source_size")) / F.col("target") for e in range(epochs)]
    last = _last_taken(queue, finish, sources.agg(F.sum("target")).first()[0], rows)
    if last is None:
        inside = [F.lit(True)] * epochs
    else:
        f, k, s = (F.lit(x) for x in last)
        inside = [(x < f) | ((x == f) & ((F.col("key") < k) | ((F.col("key") == k) & (F.coalesce("source", F.lit("")) <= s)))) for x in finish]
    return queue, sum((F.when(t & (F.col("size") > 0), 1).otherwise(0) for t in inside), F.lit(0)).cast("long")


def _numbered(kinds: DataFrame) -> DataFrame:
    """(..., rows) -> a row for each number from 0 to rows - 1; a large count is dealt out in pieces before it is counted out."""
    few, many = kinds.where(F.col("rows") <= PIECE), kinds.where(F.col("rows") > PIECE)
    whole = few.withColumn("number", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    piece = many.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(PIECE).cast("long")))).repartition("print", "at")
    pieces = piece.withColumn("number", F.explode(F.sequence(F.col("at"), F.least(F.col("at") + PIECE, F.col("rows")) - 1))).drop("at")
    return whole.unionByName(pieces).drop("rows")


def _same(a: str, b: str, *names: str) -> Column:
    return F.expr(" and ".join(f"{a}.{n} <=> {b}.{n}" for n in names))


def _queue(base: DataFrame, sources: DataFrame, rows: int) -> DataFrame:
    """Each row with ``cum``, its source's words up to and with it in the shuffled order.

    A bucket is a run of shuffle keys; there are as many as keep a bucket at BUCKET_ROWS even if one source held all rows.
    """
    bits = min(28, (rows // BUCKET_ROWS).bit_length())
    lead = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    base = base.withColumn("bucket", F.shiftrightunsigned(lead, 28 - bits))
    sums = base.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sums = _running(sums.withColumnsRenamed({"bucket": "range", "bucket_size": "range_size"}), "source")
    sums = sums.select("source", F.col("range").alias("bucket"), (F.col("running") - F.col("range_size")).alias("before"))
    upto = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = base.withColumn("inside", F.sum("size").over(upto)).alias("q").join(sums.alias("b"), _same("q", "b", "source", "bucket"))
    out = out.select("q.*", (F.col("inside") + F.col("before")).alias("cum"))
    out = out.alias("q").join(sources.alias("s"), _same("q", "s", "source"))
    return out.select("doc_id", "q.source", "size", "print", "key", "cum", "source_size", "target")


def _last_taken(queue: DataFrame, finish: list[Column], limit: float | None, rows: int) -> tuple | None:
    """(finish, key, source) of the last copy inside the budget in the global order of virtual time; None if all copies fit."""
    ranges = max(1, rows * len(finish) // BUCKET_ROWS)
    copy = F.explode(F.array(*finish)).alias("finish")
    copies = queue.where("size > 0 and target > 0").select("size", "key", F.coalesce("source", F.lit("")).alias("source"), copy)
    copies = copies.withColumn("range", F.floor(F.col("finish") * ranges))
    fits = f"running <= {limit or 0.0!r} * (1 + 1e-12)"
    edge = _running(copies.groupBy("range").agg(F.sum("size").alias("range_size"))).where(f"not ({fits})")
    edge = edge.agg(F.min_by(F.struct("range", F.expr("running - range_size").alias("base")), "range").alias("e")).first()["e"]
    if edge is None:
        return None
    order = Window.orderBy("finish", "key", "source").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = copies.where(F.col("range") == edge["range"]).withColumn("running", F.sum("size").over(order) + edge["base"]).where(fits)
    last = inside.agg(F.max(F.struct("finish", "key", "source")).alias("last")).first()["last"]
    return tuple(last) if last else (edge["range"] / ranges, "", "")


def _running(totals: DataFrame, *by: str) -> DataFrame:
    """totals(by..., range, range_size) -> also running, the sum up to and with each range of its group, by two levels: no window has more
    than 4,096 ranges, or a row for 4,096 ranges."""
    coarse = totals.withColumn("coarse", F.floor(F.col("range") / 4096))
    upto = Window.partitionBy(*by, "coarse").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = coarse.groupBy(*by, "coarse").agg(F.sum("range_size").alias("coarse_size"))
    earlier = Window.partitionBy(*by).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*by, "coarse", F.coalesce(F.sum("coarse_size").over(earlier), F.lit(0)).alias("before"))
    inside = coarse.withColumn("inside", F.sum("range_size").over(upto)).alias("q").join(sums.alias("b"), _same("q", "b", *by, "coarse"))
    return inside.select(*[f"q.{c}" for c in by], "range", "range_size", (F.col("inside") + F.col("before")).alias("running"))
