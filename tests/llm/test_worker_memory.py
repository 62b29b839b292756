"""What a Python worker holds in and after a task, each time in a process of its own."""

import subprocess
import sys

import pytest

HEAD = """
import random, re, sys
import numpy as np, pyarrow as pa, public_tokenizers
from docjson.llm import ngram_join, packing
def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
draw = random.Random(5)
words = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(20_000)]
def batches(n, rows=4_000):
    for k in range(n):
        yield pa.RecordBatch.from_arrays([pa.array(range(k * rows, (k + 1) * rows)), pa.array([" ".join(draw.choices(words, k=300)) for _ in range(rows)])], names=["doc_id", "text"])
path = public_tokenizers.path("word_bpe_49k.json")
tasks = {
    "tokenise": packing._tokenise(path, 1, np.zeros(4096, np.int64), np.ones(4096, np.int64)),
    "send": ngram_join._send_tokens(12, 5, np.zeros(0, np.uint64), np.zeros(0, np.int32)),
}
run, most = tasks[sys.argv[1]], 0
for _ in run(batches(1, 20)):
    pass
start = held()
for made in run(batches(4)):
    most = max(most, held())
del made
print(most - start, held() - start)
"""


@pytest.mark.parametrize(("task", "within", "after"), [("tokenise", 115, 70), ("send", 200, 70)])
def test_a_worker_gives_back_what_a_task_has_freed(task, within, after):
    said = subprocess.run([sys.executable, "-c", HEAD, task], capture_output=True, text=True, timeout=120, check=True).stdout
    most, rest = map(float, said.split())
    assert most < within, said
    assert rest < after, said
