"""What packing's workers keep when their tasks are over."""

import random
import re
import string
from pathlib import Path

import public_tokenizers
import pyarrow as pa
import pytest

from barflow.llm.common import giving_back
from barflow.llm.packing import Words

ROLLUP = Path("/proc/self/smaps_rollup")


def _held() -> float:
    """MB of this process's own memory."""
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", ROLLUP.read_text()))) / 1024


@pytest.mark.skipif(not ROLLUP.exists(), reason="memory can't be read here")
def test_nothing_stays_of_a_tasks_tokenizer():
    """The tokenizer library remembers words for the thread, beyond the tokenizer's end: many tasks in one worker piled that up."""
    r = random.Random(3)
    made = ["".join(r.choices(string.ascii_lowercase, k=r.randint(3, 9))) for _ in range(60_000)]
    lines = [" ".join(made[at : at + 100]) for at in range(0, len(made), 100)]
    spec = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")

    def task(batches):
        words = Words(spec, 2)
        for line in lines:
            words.ids(line)
        yield from batches
        words.close()

    after = []
    for _ in range(10):
        list(giving_back(task)(iter([pa.RecordBatch.from_pydict({"x": [1]})])))
        after.append(_held())
    assert after[-1] - after[1] < 12, after


def test_the_librarys_memory_does_not_change_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    words, lib = Words(Path(path).read_text(encoding="utf-8"), 2), Tokenizer.from_file(path)
    for text in ("Plain words, don't they're 1234 end", "Grüße naïve ÀÉ <|x|> 東京 ﬁ é", "a\x1cb  c\n\nd", ""):
        for _ in range(2):
            assert words.ids(text) == words._pack(lib.encode(text, add_special_tokens=False).ids)
