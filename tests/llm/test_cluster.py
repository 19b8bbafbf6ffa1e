import re
from pathlib import Path

import pyarrow as pa

from contingo.llm.cluster import give_back, lean


def resident() -> int:
    return int(re.search(r"VmRSS:\s+(\d+)", Path("/proc/self/status").read_text()).group(1)) // 1024


def test_a_lean_step_gives_back_what_it_freed():
    """Many small objects below one that lives stay with the process otherwise."""
    batch, kept = pa.RecordBatch.from_pydict({"x": [1, 2]}), []

    def step(batches):
        for b in batches:
            held = [bytes(2000) for _ in range(60_000)]
            kept.append(bytes(2000))
            del held
            yield b

    give_back()
    before = resident()
    assert [b.to_pydict() for b in lean(step)(iter([batch, batch]))] == [{"x": [1, 2]}] * 2
    assert resident() < before + 60


def test_lean_steps_end_when_their_reader_does():
    ended = []

    def step(batches):
        try:
            yield from batches
        finally:
            ended.append(True)

    steps = lean(step)(iter([1, 2]))
    assert next(steps) == 1
    steps.close()
    assert ended == [True]
