"""What the pipeline's Python workers hold: they stand beside an executor's heap and live on from stage to stage."""

from __future__ import annotations

import random
import tracemalloc

import pyarrow as pa
import pytest

from tidewatch.llm import bpe, neardup, quality

MB = 1 << 20
COLUMNS = ("doc_id", "text", "source")


@pytest.fixture(scope="module")
def batch() -> pa.RecordBatch:
    """As many texts as Spark hands over at once: 16 MB."""
    r = random.Random(1)
    words = ["".join(r.choices("etaoinshrdlu", k=r.randint(2, 8))) for _ in range(2000)]
    texts = [" ".join(r.choices(words, k=680)) for _ in range(4096)]
    return pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "source": ["a"] * len(texts)})


@pytest.fixture
def worked(spark, monkeypatch, batch):
    """make(docs) -> what its worker's function takes from ``batch`` in, and the most and the rest in MB of what Python held."""

    def run(make) -> tuple[list[str], float, float]:
        tasks = []
        docs = spark.createDataFrame([], "doc_id long, text string, source string")
        monkeypatch.setattr(type(docs), "mapInArrow", lambda self, f, schema: tasks.append((self.columns, f)) or self)
        make(docs)
        (names, task), *_ = tasks
        given = pa.RecordBatch.from_arrays([batch.column("text" if n == "__text" else n) for n in names], names=names)
        tracemalloc.start()
        try:
            rows = sum(b.num_rows for b in task(iter([given])))
            now, most = tracemalloc.get_traced_memory()
        finally:
            tracemalloc.stop()
        assert rows == batch.num_rows
        return names, most / MB, now / MB

    return run


@pytest.mark.parametrize("make", [lambda d: quality.rules(d, carry=COLUMNS), lambda d: quality.with_features(d, ("doc_id", "source"), keep_text=True)], ids=["rules", "features"])
def test_a_carried_text_is_sent_once_and_taken_in_parts(worked, make):
    names, most, _ = worked(make)
    assert sorted(names) == sorted(COLUMNS)
    assert most < 32


def test_a_worker_drops_the_word_table_of_another_stage(worked, batch):
    _, most, rest = worked(lambda d: bpe.encoded(d, carry=("doc_id", "source")))
    assert 30 < rest < 60  # kept for the next task of its own
    assert most < 100
    table = bpe.remembered(bpe.vocabulary_path())
    assert table is bpe.remembered(bpe.vocabulary_path())
    worked(lambda d: quality.rules(d, carry=COLUMNS))
    assert table is not bpe.remembered(bpe.vocabulary_path())
    table = bpe.remembered(bpe.vocabulary_path())
    list(neardup._signed(iter([])))
    assert table is not bpe.remembered(bpe.vocabulary_path())
