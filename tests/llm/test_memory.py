"""What a Python worker still holds after a kernel's task."""

import subprocess
import sys
from pathlib import Path

import pytest

HELD = """
import random, re, sys
sys.path.insert(0, {root!r})
import pyarrow as pa
from blockloom.llm import op4_lines, op5_decontaminate, op8_quality, op10_minhash, textkernel

def held():
    return int(re.search(r"\\nRssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

rng = random.Random(1)
words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(5000)]
texts = [" ".join(rng.choices(words, k=400)) for _ in range(4000)]
ids = pa.array(range(len(texts)), pa.int64())
batch = pa.RecordBatch.from_arrays([ids, ids, pa.array(texts)], ["doc_id", "text_hash", "text"])
items = type("Row", (), {{"item_id": 1, "text": texts[0][:300]}})
kernel = {{"lines": lambda: op4_lines._read, "sets": lambda: op10_minhash._sets(5, 64), "clean": lambda: op5_decontaminate._clean(*op5_decontaminate.read_items([items], 5), 5, 0.8), "features": lambda: op8_quality._label(op8_quality.Field(__import__("numpy").zeros(op8_quality.N_FEATURES), __import__("numpy").zeros((2, 2))), 0.5)}}[{name!r}]()
textkernel.powers(textkernel.CHUNK_BYTES + 1)
textkernel._give_back() if hasattr(textkernel, "_give_back") else __import__("ctypes").CDLL(None).malloc_trim(0)
before = held()
for _ in range(2):
    for part in kernel(iter([batch])):
        pass
    part = None
print(held() - before)
"""


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="memory can't be read here")
@pytest.mark.parametrize("name", ["lines", "sets", "clean", "features"])
def test_worker_gives_memory_back(name):
    """An idle worker keeps little of what a task needed (F1: idle workers and the JVM together passed an executor's memory)."""
    code = HELD.format(root=str(Path(__file__).resolve().parents[2]), name=name)
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert float(done.stdout) < 16
