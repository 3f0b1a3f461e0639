"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

A sketch has T coordinates. In each of T rounds every shingle falls into one hashed bin with one hashed value, and a bin that is still
empty keeps the least value of the round; T more rounds send all shingles to one bin each. So every coordinate fills, after about
T log T placements, and the share of equal coordinates of two sketches is concentrated about the Jaccard similarity of their sets.

Sketches only propose: documents with an equal band are candidates, groups of candidates are compared on their full sets.

1. Documents with one set are one class from then on; its representative stands for all copies.
2. Each band's bucket is a star of links; their components are *loose groups*. All true links lie inside loose groups.
3. A loose group of up to BLOCK classes goes to one task, where all its pairs are compared on full sets. A larger one is cut into blocks:
   each block and its successor are compared fully; what is then outside the group's largest verified component (few) is compared with
   every block of the group that shares a bucket with it. Pairs that are already in one component need no comparison, as only
   components are asked for. No step emits pairs of a group, and no task gets more than two blocks of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.components import components
from tidewatch.llm.storage import released, sized, slots, written
from tidewatch.llm.textcore import STEP, U, WordHashes, as_bytes, chunks, forget, mixed, portions, shingle_sets, sliced, trimmed

WORDS, PERCENT = 5, 75
#: Coordinates of a sketch and coordinates in a band: two sets of similarity 0.75 miss all 32 bands with probability 5e-6.
T, ROWS = 128, 4
#: Classes of a large loose group in a block.
BLOCK = 256
#: A class with more than one in so many of all rows is hot.
HOT = 1000
EMPTY = U(0xFFFFFFFFFFFFFFFF)


def sketches(sets: list[np.ndarray], t: int = T) -> np.ndarray:
    """A row of ``t`` filled coordinates for each set; an empty set's stay EMPTY."""
    out = np.full(len(sets) * t, EMPTY, U)
    flat = np.concatenate(sets) if sets else np.empty(0, U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for i in range(2 * t):
        if not len(flat):
            break
        x = mixed(flat ^ U(int(STEP) * (2 * i + 1) & int(EMPTY)))
        key = owner * t + ((x % U(t)).astype(np.int64) if i < t else i - t)
        free = out[key] == EMPTY  # a bin keeps what the first round that reached it gave it
        np.minimum.at(out, key[free], x[free] >> U(1))
        if i % 2 or i < 8:
            unfilled = (out.reshape(-1, t) == EMPTY).any(1)[owner]
            flat, owner = flat[unfilled], owner[unfilled]
    return out.reshape(-1, t)


def bands(sketch: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """Hash of each band of each sketch, different for different bands."""
    parts = sketch.reshape(len(sketch), -1, rows)
    value = np.arange(parts.shape[1], dtype=U) * STEP + np.zeros((len(sketch), 1), U)
    for k in range(rows):
        value = mixed(value * STEP + parts[:, :, k])
    return value.view(np.int64)


@trimmed
def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    hashes = WordHashes()
    for batch, texts in portions(batches, "text"):
        sets = shingle_sets(hashes, texts, WORDS)
        prints = [xxhash.xxh3_128_digest(s) if len(s) else None for s in sets]
        band = bands(sketches(sets))
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * band.shape[1]), pa.array(band.ravel()))
        own = [batch.column(c) for c in ("doc_id", "key")]
        yield pa.RecordBatch.from_arrays([*own, pa.array([len(s) for s in sets], pa.int64()), pa.array(prints, pa.binary()), flat], names=["doc_id", "key", "n_shingles", "print", "bands"])


@trimmed
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(print, grp, text) -> (print, grp, shingles); a repeated row's set is made once in a partition."""
    forget()
    hashes, seen = WordHashes(), set()
    for batch in sliced(batches):
        rows = list(zip(batch.column("print").to_pylist(), batch.column("grp").to_pylist(), as_bytes(batch.column("text")), strict=True))
        rows = list({r[0]: r for r in rows if r[0] not in seen}.values())
        seen.update(r[0] for r in rows)
        for a, b in chunks([r[2] for r in rows]):
            sets = shingle_sets(hashes, [r[2] for r in rows[a:b]], WORDS)
            yield pa.RecordBatch.from_arrays([*[pa.array([r[k] for r in rows[a:b]], pa.binary()) for k in (0, 1)], pa.array([s.tobytes() for s in sets], pa.binary())], names=["print", "grp", "shingles"])


class Union:
    """Union-find over 0 .. n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def verified(sets: list[np.ndarray], asks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links of a spanning forest over ``sets``: all components by 100 * intersection >= PERCENT * union, on full sets.

    ``asks``: which sets are compared with all others (all, if None). For a set, one count over the postings of its shingles gives its
    intersection with every other at once.
    """
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    # One sort numbers the shingles and lays out their postings; numbers and owners take four bytes.
    order = np.argsort(flat, kind="stable").astype(np.int32 if len(flat) < 2**31 else np.int64)
    flat = flat[order]
    edge = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
    del flat
    number = np.empty(len(order), order.dtype)
    number[order] = np.cumsum(edge, dtype=order.dtype) - 1
    posting = np.repeat(np.arange(len(sets), dtype=np.int32), size)[order]
    start = np.r_[np.flatnonzero(edge), len(order)]
    del order, edge
    bounds, union, out = np.r_[0, np.cumsum(size)], Union(len(sets)), []
    for i in range(len(sets)) if asks is None else np.flatnonzero(asks).tolist():
        own = number[bounds[i] : bounds[i + 1]]
        n = start[own + 1] - start[own]
        at = np.repeat(start[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        both = np.bincount(posting[at], minlength=len(sets))
        for j in np.flatnonzero(100 * both >= PERCENT * (size + size[i] - both)).tolist():
            if j != i and union.join(i, j):
                out.append((i, j))
    return out


@trimmed
def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``task`` and ``print``: (task, print, asks, shingles), of which repeats are passed over. Compares inside each run of one task; holds one run at a time."""

    def found() -> pa.RecordBatch:
        asks = np.array([a for _, a, _ in held])
        pairs = verified([np.frombuffer(s, U) for _, _, s in held], None if asks.all() else asks) if len(held) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([held[p[k]][0] for p in pairs], pa.binary()) for k in (0, 1)], names=["a", "b"])

    now, held = None, []
    for b in sliced(batches):
        for task, own, asks, shingles in zip(*(b.column(c).to_pylist() for c in ("task", "print", "asks", "shingles")), strict=True):
            if task != now:
                if held:
                    yield found()
                now, held = task, []
            if not held or held[-1][0] != own:
                held.append((own, asks, shingles))
    if held:
        yield found()


def _compared(rows: DataFrame) -> DataFrame:
    """rows(task, print, asks, shingles) -> links (a, b). A task's rows are few by construction."""
    n = slots(rows.sparkSession)
    return rows.repartition(n, "task").sortWithinPartitions("task", "print").mapInArrow(_links, "a binary, b binary")


def grouped(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_shingles, component_id, kept), one row for every row.

    Rows are linked by their sets alone, so repeated rows and equal doc_ids do no harm. A null or empty text has no set, is linked with
    nothing and stays: component_id is its own doc_id. A null doc_id never is a component_id, unless all of a component are null; ``kept``
    is false for it unless its component has no doc_id. If several rows share the kept doc_id, all of them are kept.
    """
    return _grouped(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame) -> DataFrame:
    """What :func:`grouped` gives, and ``key``, the hash of each row's text."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    signed = written(keyed.mapInArrow(_signed, f"doc_id {dict(docs.dtypes)['doc_id']}, key long, n_shingles long, print binary, bands array<long>"), "neardup-signed")
    # Classes of equal sets, from sums that are partial first. Their bands are equal, so any copy's will do; ``one`` is a copy to read the
    # set from, ``least`` the smallest doc_id of all copies.
    of = signed.where("print is not null").groupBy("print")
    classes = written(of.agg(F.any_value("bands").alias("bands"), F.min(F.struct("doc_id", "key")).alias("one"), F.min("doc_id").alias("least"), F.count("*").alias("copies")), "neardup-classes")
    buckets = classes.select("print", F.explode("bands").alias("bucket"))
    total = classes.count()
    rows = total * T // ROWS
    leads = sized(buckets.groupBy("bucket").agg(F.min("print").alias("lead"), F.count("*").alias("n")), rows).where("n > 1").select("bucket", "lead")
    # A class and its buckets' leads are all linked to the least of them. Classes of a dense group share these few leads, so links between
    # leads repeat and vanish, and about one link a class is left.
    held = sized(buckets.join(leads, "bucket"), rows).groupBy("print").agg(F.collect_set("lead").alias("leads"))
    ends = F.array_union("leads", F.array("print"))
    loose = components(held.select(F.array_min(ends).alias("a"), F.explode(ends).alias("b"))).withColumnsRenamed({"node": "print", "label": "grp"})
    sets = _with_sets(docs, classes, loose)
    large = written(sized(loose.groupBy("grp").agg(F.count("*").alias("n")), rows).where(f"n > {BLOCK}").select("grp", F.ceil(F.col("n") / BLOCK).cast("long").alias("blocks")), "neardup-large")
    links = _verified_links(sets, large, classes, loose.count())
    labels = components(links)
    # Smallest doc_id of a component over all copies of all its classes.
    least = sized(classes.join(labels.select(F.col("node").alias("print"), "label"), "print", "left"), total).select("print", "copies", "least", F.coalesce("label", "print").alias("label"))
    whole = sized(least.groupBy("label").agg(F.min("least").alias("component_id")), total)
    found = written(sized(least.join(whole, "label"), total).select(F.col("print").alias("p"), "copies", "component_id"), "neardup-found")
    released(classes, loose, sets, large, links, labels)
    return _back(signed, found)


def _back(signed: DataFrame, found: DataFrame) -> DataFrame:
    """Each row of ``signed`` with its class's component: rows without a set need no join; classes that hold over a thousandth of all rows
    are fewer than a thousand, so they are broadcast, and no key with many rows is left for the exchange."""
    rows = signed.select("doc_id", "key", "n_shingles", "print")
    many = signed.count() // HOT
    hot = found.where(F.col("copies") > many).select("p", F.col("component_id").alias("hot_id"))
    marked = rows.where("print is not null").join(F.broadcast(hot), F.col("print") == F.col("p"), "left")
    usual = marked.where("p is null").drop("p", "hot_id").join(found.where(F.col("copies") <= many), F.col("print") == F.col("p"))
    names = ("doc_id", "key", "n_shingles")
    out = rows.where("print is null").select(*names, F.col("doc_id").alias("component_id"))
    out = out.unionByName(marked.where("p is not null").select(*names, F.col("hot_id").alias("component_id"))).unionByName(usual.select(*names, "component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _with_sets(docs: DataFrame, classes: DataFrame, loose: DataFrame) -> DataFrame:
    """(print, grp, shingles) for each class in a loose group, from the text of its document with the smallest doc_id.

    The text's hash goes with the doc_id, so that rows without a doc_id, or with one doc_id and several texts, meet their own text only.
    """
    one = classes.join(loose, "print").select("print", "grp", F.col("one.doc_id").alias("id"), F.col("one.key").alias("key"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("key"))
    texts = docs.select("doc_id", "text").join(one, same).select("print", "grp", "text")
    return written(texts.mapInArrow(_sets, "print binary, grp binary, shingles binary"), "neardup-sets")


def _verified_links(sets: DataFrame, large: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """``n``: classes in loose groups."""
    fit = lambda df: sized(df, 8 * n)
    marked = sets.join(large, "grp", "left")
    small = marked.where("blocks is null").select(F.col("grp").alias("task"), "print", F.lit(True).alias("asks"), "shingles")
    placed = marked.where("blocks is not null").withColumn("block", F.pmod(F.xxhash64("print"), F.col("blocks")))
    if large.limit(1).count() == 0:
        return written(_compared(small), "neardup-links")
    # A task for each block and its successor.
    name = lambda block: F.concat(F.col("grp"), F.lit("/"), block.cast("string")).cast("binary")
    chain = placed.withColumn("at", F.explode(F.array_distinct(F.array("block", F.pmod(F.col("block") - 1, F.col("blocks"))))))
    chain = chain.select(name(F.col("at")).alias("task"), "print", F.lit(True).alias("asks"), "shingles")
    first = written(_compared(small.unionByName(chain)), "neardup-links")
    labels = components(first)
    # Who is outside the largest verified component of its large group?
    member = fit(placed.select("print", "grp", "block", "blocks").join(labels.select(F.col("node").alias("print"), "label"), "print", "left"))
    kept = member = written(member.withColumn("label", F.coalesce("label", "print")), "neardup-members")
    released(labels)
    counts = fit(member.groupBy("grp", "label").agg(F.count("*").alias("n")))
    main = fit(counts.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("main")))
    # Blocks where such a class has a candidate: those of the classes in its buckets, beyond the blocks already compared with.
    member = fit(member.join(main, "grp")).select("print", "grp", "block", "blocks", (F.col("label") != F.col("main")).alias("asks"))
    seen = fit(member.join(classes, "print")).select("print", "grp", "block", "blocks", "asks", F.explode("bands").alias("bucket"))
    seats = fit(seen.select("bucket", F.col("block").alias("at")).distinct())
    wanted = fit(seen.where("asks").join(seats, "bucket")).where("pmod(block - at + 1, blocks) > 2")
    wanted = written(fit(wanted.select("print", "grp", "at").distinct()), "neardup-wanted")
    released(kept)
    if wanted.limit(1).count() == 0:
        released(wanted)
        return first
    # Those who ask come to the block in lots of BLOCK at most on average; the block goes to each lot.
    asked = wanted
    lots = fit(wanted.groupBy("grp", "at").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("lots")))
    wanted = wanted.join(lots, ["grp", "at"]).withColumn("lot", F.pmod(F.xxhash64("print"), F.col("lots")))
    task = lambda: F.concat(F.col("grp"), F.lit("/"), F.col("at").cast("string"), F.lit("/"), F.col("lot").cast("string")).cast("binary").alias("task")
    ask = wanted.select("print", task()).join(placed.select("print", "shingles"), "print").select("task", "print", F.lit(True).alias("asks"), "shingles")
    seat = placed.withColumn("at", F.col("block")).join(lots, ["grp", "at"]).withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("lots") - 1)))
    seat = seat.select(task(), "print", F.lit(False).alias("asks"), "shingles")
    out = written(first.unionByName(_compared(ask.unionByName(seat))), "neardup-links")
    released(first, asked)
    return out


def deduplicated(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates stays, with all its columns: the one with the smallest doc_id. Rows that repeat it
    in doc_id and text stay with it; rows of a group without any doc_id all stay."""
    kept = _grouped(docs).where("kept").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left_semi")
