"""What a reused worker still holds after a task, measured as the system counts it."""

import gc
import random
import re
import weakref
from pathlib import Path

import pyarrow as pa
import pytest

from colweave.llm import phrases
from colweave.llm.common import frugal

ROLLUP = Path("/proc/self/smaps_rollup")


def held_mb():
    gc.collect()
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", ROLLUP.read_text()))) / 1024


class Rows:
    """Stands in for a frame: hands out the function that its tasks would run."""

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.skipif(not ROLLUP.exists(), reason="memory can't be read here")
def test_freed_memory_leaves_the_worker():
    pins = []

    def run(batches):
        made = []
        for _ in batches:
            made.extend(bytes(700) for _ in range(200_000))
            pins.extend(made[::5000])  # what stays lies between what goes
            yield len(made)

    before = held_mb()
    assert list(frugal(run)(iter([1]))) == [200_000]
    assert held_mb() - before < 30


def test_finished_chunks_of_phrases_are_let_go(monkeypatch):
    made = []

    class Chunk(phrases._Chunk):
        def __init__(self, seed):
            super().__init__(seed)
            made.append(weakref.ref(self))

    monkeypatch.setattr(phrases, "_Chunk", Chunk)
    monkeypatch.setattr(phrases, "HELD_WORDS", 50)
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(50)]
    batch = pa.RecordBatch.from_pylist([{"lang": "x", "text": t} for t in texts])
    gc.disable()  # the collector of cycles comes late, if at all
    try:
        alive = [sum(r() is not None for r in made) for _ in phrases.encode(Rows(), 0)(iter([batch]))]
    finally:
        gc.enable()
    assert len(alive) > 10 and max(alive) <= 2
