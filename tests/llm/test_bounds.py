"""What a task of the repeats holds and does at a time."""

import random
import time
import tracemalloc

import numpy as np
import pyarrow as pa

from loglathe.llm import repeats


def test_parsing_holds_little_beside_its_batch():
    rng = random.Random(5)
    texts = [rng.randbytes(10_000).hex().encode() for _ in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(100)), pa.array(texts)], ["doc_id", "text"])
    tracemalloc.start()
    try:
        (found,) = repeats._parse(iter([batch]))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found.num_rows > 10_000 and most < 48 << 20


def test_triggers_cost_less_than_a_sort():
    x = np.random.default_rng(2).integers(0, 1 << 63, 1 << 19, dtype=np.uint64)

    def seconds(f):
        best = 1e9
        for _ in range(3):
            at = time.process_time()
            f()
            best = min(best, time.process_time() - at)
        return best

    assert seconds(lambda: repeats.triggers(x, 69)) < seconds(lambda: np.argsort(x, kind="stable"))


def test_triggers_of_hashes_alike_in_their_upper_bits():
    x = np.array([9, 4, 7, 4, 1, 1, 8, 3] * 20, np.uint64) | np.uint64(1 << 63)
    for width in (1, 2, 3, 8, 69):
        assert repeats.triggers(x, width).tolist() == [i + int(np.argmin(x[i : i + width])) for i in range(len(x) - width + 1)]
