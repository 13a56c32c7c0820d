"""What a worker keeps for tasks of one kind goes when tasks of another kind begin."""

import gc
import weakref
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from sieveframe.llm import common, quality, tokens

TASKS = {
    "cores": lambda: quality._cores,
    "count": lambda: quality._count(SimpleNamespace(value=quality.Vocabulary(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32))), 8, 3, 100),
    "merged": lambda: quality._merged(8),
    "summed": lambda: quality._summed(SimpleNamespace(value=(8, [0.5] * 3, [0.5] * 3, np.ones(96)))),
}


def kept_encoder() -> weakref.ref:
    encoder = tokens.encoder(tokens.public_path("byte_bpe_50k.json"))
    encoder.encode(["Some words, kept by the encoder."])
    return weakref.ref(encoder)


@pytest.fixture
def no_collector():
    common._held.clear()
    gc.disable()
    yield
    gc.enable()
    common._held.clear()


def test_an_encoder_is_freed_when_another_kind_of_task_begins(no_collector):
    kept = kept_encoder()
    common.held("another", bool)
    assert kept() is None


@pytest.mark.parametrize("task", TASKS)
def test_the_quality_classifier_begins_without_an_encoder(no_collector, task):
    kept = kept_encoder()
    batches = [pa.RecordBatch.from_pydict({"text": ["a few words"]})] if task in ("cores", "count") else []
    list(TASKS[task]()(iter(batches)))
    assert kept() is None
