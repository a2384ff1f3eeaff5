"""Short chunks that are merged together, against the heap of long ones and the library."""

import gc
import random

import pyarrow as pa
import public_tokenizers

from quillstone.llm import sentencepieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_rounds_give_what_the_heap_gives():
    coder, rng = sentencepieces._encoder(MODEL), random.Random(7)
    letters = "aaabcdeeeinorstuäß€語\U0001f600\x07"
    chunks = [sentencepieces.MARK + "".join(rng.choices(letters, k=rng.randrange(12))) for _ in range(3000)] + [sentencepieces.MARK, "a"]
    assert coder.merge_short(chunks) == [coder.merge_long(c) for c in chunks]
    assert coder.merge_short(["a"]) == [coder.merge_long("a")]
    merged = coder._merged(coder.of_char[[ord("e")]], coder.of_char[[ord("r")]])
    assert coder._rank(merged)[0] == coder.place[merged[0]] << 32 < sentencepieces.NONE == coder._rank(merged * 0 - 1)[0]


def test_the_collector_rests_within_a_task_only():
    rows = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["to be or not", None])], ["doc_id", "text"])
    task = sentencepieces._encode(MODEL, True)(iter([rows, rows]))
    assert gc.isenabled()
    first = next(task)
    assert not gc.isenabled()
    assert [next(task), *task] == [first] and gc.isenabled()
    assert first["decoded"].to_pylist() == ["to be or not", ""]
