"""What a shard of windows takes in a task that orders its suffixes."""

import tracemalloc

import numpy as np
import pytest

from basketry.llm import suffix_arrays, suffix_dedup


def peak(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("by_word, length", [(False, 400), (True, 51)])
def test_a_shard_takes_few_megabytes(by_word, length):
    """Two tasks of an executor hold a shard each, beside a JVM that takes most of the memory."""
    random = np.random.default_rng(3)
    text = random.integers(97, 105, suffix_dedup.SHARD_BYTES, dtype=np.uint8).tobytes()
    rows = [{"bytes": text[a:a + 640], "starts": (640 if not by_word else 80) - length + 1} for a in range(0, len(text), 640)][:-1]
    assert peak(lambda: suffix_dedup._unit_marks(rows, 0, 0, length, by_word)) < 64 << 20


def test_suffix_array_takes_few_bytes_a_unit():
    """Strings that agree for long, so that many rounds sort all positions."""
    data = np.tile(np.random.default_rng(4).integers(97, 105, 5000, dtype=np.uint8), 40)
    assert peak(lambda: suffix_arrays.suffix_array(data, len(data))) < 75 * len(data)


def test_order_with_many_rounds():
    for data in (np.tile(np.array([1, 1, 2, 1], np.uint8), 60), np.full(200, 7, np.uint8), np.tile(np.array([5, 9, 5], np.uint64), 50)):
        sa = suffix_arrays.suffix_array(data, len(data))
        assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:].tolist())
