"""Token ids in a compact binary format: frequency-ranked, byte-aligned, with control bytes apart from data bytes.

An id is written as its rank by frequency in the corpus (ties by id), in 1 to 4 bytes, lowest byte first; the lengths of four ids share
a control byte. Frequent ids take one byte, the next 65 thousand ranks two.

The files are a table of blocks, as only Spark's writers commit safely to any shared store. A block holds whole documents in ascending
doc_id order (null first): part, the part's ids before it (``start``), doc_ids, lengths, ``control`` and ``data``. A second table maps ranks
to ids. Decoding looks all lengths up in one table of the control bytes and gathers all ids by masked numpy sums.
"""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.bpe import byte_letters, cased, vocabulary_path
from tidewatch.llm.storage import released, slots, written
from tidewatch.llm.textcore import WordTable, as_bytes

END = 1
#: Ids in a block (a longer document is a block of its own); pieces of words that a worker remembers, and that the library gets in one text.
BLOCK_IDS, PIECES, GROUP = 1 << 18, 300_000, 500
#: Lower-case Latin-1 letters in UTF-8, and ASCII marks but the apostrophe.
LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])*")
MARKS = bytes(x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) != "'")
#: Lengths 1 to 4 of the four ids that a control byte stands for.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = values.astype("<u4")
    size = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    codes = np.zeros(-len(values) % 4 + len(values), np.uint8)
    codes[: len(values)] = size - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4) < size[:, None]].tobytes()


def unpack(n: int, control: bytes, data: bytes) -> np.ndarray:
    """Inverse of :func:`pack` for ``n`` values."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    out = np.zeros((n, 4), np.uint8)
    out[np.arange(4) < size[:, None]] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


@functools.cache
def library_words(path: str, kind: str) -> WordTable:
    """Ids of words by the ``tokenizers`` library, as integers of the numpy type ``kind``; kept as long as the worker lives.

    A word of lower-case Latin-1 letters and then ASCII marks (no apostrophe, no digit) is unchanged by the normaliser and falls into two
    pre-tokens, so the library's model gets these directly: many in one text, told apart by the suffix that only a last token bears.
    Many words share their letters with others. All other words go through the whole tool.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
    from tokenizers import Tokenizer, pre_tokenizers

    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    bare = Tokenizer(tool.model)
    bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    letters, suffix, vocab = dict(enumerate(byte_letters())), tool.model.end_of_word_suffix, tool.get_vocab()
    last = np.zeros(max(vocab.values()) + 1, bool)
    last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
    pieces: dict[bytes, bytes] = {}

    def learn(new: list[bytes]) -> None:
        """Pieces' ids, from the model alone."""
        shown = [x.decode("latin-1").translate(letters) for x in new]
        groups = [" ".join(shown[k : k + GROUP]) for k in range(0, len(shown), GROUP)]
        for k, found in enumerate(bare.encode_batch_fast(groups, add_special_tokens=False)):
            own, ids = new[k * GROUP : (k + 1) * GROUP], np.array(found.ids, kind)
            ends = (np.flatnonzero(last[ids]) + 1).tolist()
            if len(ends) == len(own) and ends[-1] == len(ids):
                raw, width = ids.tobytes(), ids.itemsize
                pieces.update(zip(own, [raw[width * a : width * b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
            else:  # a vocabulary without such a suffix
                pieces.update((x, np.array([t.id for t in bare.model.tokenize(y)], kind).tobytes()) for x, y in zip(own, shown[k * GROUP :], strict=False))

    def encode(words: list[bytes]) -> list[bytes]:
        stems = [w.rstrip(MARKS) for w in words]
        tails = [w[len(s) :] for s, w in zip(stems, words, strict=True)]
        other = [k for k, (s, w) in enumerate(zip(stems, words, strict=True)) if not (s.isalpha() and s.islower() or LETTERS.fullmatch(s)) or b"<|" in w]
        for k in other:
            stems[k] = tails[k] = b""
        if len(pieces) > PIECES:
            pieces.clear()
        pieces[b""] = b""
        learn(list((set(stems) | set(tails)) - pieces.keys()))
        out = list(map(add, map(pieces.__getitem__, stems), map(pieces.__getitem__, tails)))
        for k in other:
            out[k] = np.array(tool.encode(words[k].decode(), add_special_tokens=False).ids, kind).tobytes()
        return out

    return WordTable(encode, kind)


def id_type(path: str) -> str:
    from tokenizers import Tokenizer

    return "<u2" if Tokenizer.from_file(path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenized(docs: DataFrame, path: str, kind: str, end: int) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, ids BINARY), the ids with the end id as plain integers. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tail = library_words(path, kind), np.array([end], kind).tobytes()
        for b in batches:
            made = [ids.tobytes() + tail for ids in words.ids([cased(t) for t in as_bytes(b.column("text"))])]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made, pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary")


def frequencies(tokens: DataFrame, kind: str) -> np.ndarray:
    """Ids by falling frequency over all documents, ties by id. At most as many rows as the vocabulary has ids reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            more = np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), kind))
            size = max(len(more), len(total))
            total = np.pad(total, (0, size - len(total))) + np.pad(more, (0, size - len(more)))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    found = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return found.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)


def write_files(docs: DataFrame, path: str | None = None, end: int = END) -> tuple[DataFrame, DataFrame]:
    """Write ``docs`` in the format above. -> (blocks, ranks), the two tables as read from the shared folder.

    Repeated rows are documents of their own; documents with one doc_id stand in the order of their ids. An empty table gives empty files.
    """
    path = path or vocabulary_path()
    kind, key = id_type(path), dict(docs.dtypes)["doc_id"]
    tokens = written(tokenized(docs, path, kind, end), "ids-plain")
    by_rank = frequencies(tokens, kind)
    rank = np.zeros(int(by_rank.max(initial=0)) + 1, np.uint32)
    rank[by_rank] = np.arange(len(by_rank), dtype=np.uint32)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        held: list[tuple] = []
        size = 0

        def block() -> pa.RecordBatch:
            ids = [np.frombuffer(raw, kind) for _, raw in held]
            control, data = pack(rank[np.concatenate(ids)])
            own = [pa.array([part], pa.int64()), pa.array([start], pa.int64()), pa.array([[d for d, _ in held]], pa.list_(key_type)), pa.array([[len(x) for x in ids]], pa.list_(pa.int64())), pa.array([control], pa.binary()), pa.array([data], pa.binary())]
            return pa.RecordBatch.from_arrays(own, names=["part", "start", "doc_ids", "lengths", "control", "data"])

        for b in batches:
            key_type = b.schema.field("doc_id").type
            for d, raw in zip(b.column("doc_id").to_pylist(), b.column("ids").to_pylist(), strict=True):
                n = len(raw) // np.dtype(kind).itemsize
                if held and size + n > BLOCK_IDS:
                    yield block()
                    held, start, size = [], start + size, 0
                held.append((d, raw))
                size += n
        if held:
            yield block()

    order = [F.col("doc_id").asc_nulls_first(), F.col("ids")]
    placed = tokens.repartitionByRange(slots(docs.sparkSession), order[0]).sortWithinPartitions(*order)
    out = written(placed.mapInArrow(blocks, f"part long, start long, doc_ids array<{key}>, lengths array<long>, control binary, data binary"), "ids-blocks")
    released(tokens)
    ranks = docs.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(by_rank)], "rank long, id long")
    return out, written(ranks.coalesce(1), "ids-ranks")


def read_files(blocks: DataFrame, ranks: DataFrame) -> DataFrame:
    """(blocks, ranks) -> (doc_id, start, n_tokens, ids_crc32), from the files alone.

    What is kept from them on the driver is the rank table (a row an id of the vocabulary) and the ids in each part (a row a part).
    """
    ids = np.array([i for _, i in sorted(ranks.collect())], "<u4")
    sums = blocks.groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    before, total = {}, 0
    for part, n in sorted(sums):
        before[part], total = total, total + n
    key = dict(blocks.dtypes)["doc_ids"].removeprefix("array<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part, start, docs, lengths, control, data = (batch.column(c)[k] for c in ("part", "start", "doc_ids", "lengths", "control", "data"))
                n = np.array(lengths.as_py(), np.int64)
                raw = ids[unpack(int(n.sum()), control.as_py(), data.as_py())].tobytes() if len(ids) else b""
                at = np.r_[0, np.cumsum(n)]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                first = before[part.as_py()] + start.as_py()
                yield pa.RecordBatch.from_arrays([docs.values, pa.array(first + at[:-1]), pa.array(n), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(run, f"doc_id {key}, start long, n_tokens long, ids_crc32 long")
