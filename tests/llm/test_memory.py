"""What Python workers hold while they read texts, and after a task."""

import ctypes
import re
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from shoal.llm import spread, substring_dedup, superminhash, vectext


def texts(megabytes):
    rng = np.random.default_rng(2)
    words = np.array(["".join(rng.choice(list("abdehinorst"), 5)) for _ in range(5000)])
    rows = [" ".join(words[rng.integers(0, 5000, 170)]) for _ in range(megabytes << 10)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(rows))), pa.array(rows)], names=["k", "text"])


@pytest.mark.parametrize("work", ["signatures", "windows"])
def test_a_block_of_texts_takes_little_memory(work):
    batch = texts(4)

    def run(rows):
        if work == "signatures":
            for b in vectext.blocks(iter([rows]), 1):
                superminhash._described(b.column(1), superminhash.NearDuplicates())
        else:
            for _ in substring_dedup._first_level(substring_dedup.RepeatWindows())(iter([rows])):
                pass

    run(batch.slice(0, 1))
    tracemalloc.start()
    run(batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32_000_000


def test_free_memory_goes_back_after_a_task():
    if not Path("/proc/self/smaps_rollup").exists() or not hasattr(ctypes.CDLL(None), "malloc_trim"):
        pytest.skip("needs Linux and glibc")

    def own():
        return int(re.search(r"\nAnonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024

    pinned = []

    def task(batches):
        for b in batches:
            some = [bytearray(b"x") * 100_000 for _ in range(800)]
            # What lies above keeps the allocator from shrinking by itself.
            pinned.append(bytearray(b"y") * 100_000)
            del some
            yield b

    before = own()
    assert sum(1 for _ in spread._giving_back(task)(iter(range(3)))) == 3
    assert own() < before + 20


def test_rows_pass_through_tasks_that_give_back(spark):
    rows = spark.range(1000).repartition(3)
    assert spread.in_arrow(rows, lambda batches: batches, "id long").agg({"id": "sum"}).first()[0] == 499_500
    assert spread.in_pandas(rows, lambda frames: (f + 1 for f in frames), "id long").agg({"id": "sum"}).first()[0] == 500_500
    assert spread.in_arrow(rows, lambda batches: batches, "id long").limit(5).count() == 5
