"""Python holds a bounded part of a batch."""

import tracemalloc

import pyarrow as pa

from millrace.functions.tokenize import _slices
from millrace.operators import similarity
from millrace.runtime import table


def test_tables_bound_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "64m")
    table(spark, "/root/testdata/sf0.001", "nation")
    assert spark.conf.get(key) == "2m"
    spark.conf.set(key, before)


def test_tokenizers_get_slices():
    got = list(_slices(pa.array(["x" * 1000, None] * 3000)))
    assert sum(got, []) == ["x" * 1000, None] * 3000
    assert max(sum(len(t or "") for t in some) for some in got) <= 1 << 18
    assert list(_slices(pa.array([], pa.string()))) == []


def test_shingles_of_one_text_are_held():
    text = pa.array(["".join(chr(97 + (i * i + j) % 26) + chr(65 + (i + j) % 23) for i in range(3000)) for j in range(60)] + ["", None, "abc"])
    count = similarity.character_shingles().func
    tracemalloc.start()
    one = count(text.slice(0, 1)).to_pylist()
    small = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    out = count(text).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out[0] == one[0] and out[-3:] == [{"n": 1, "chars": 0}, {"n": 1, "chars": 0}, {"n": 1, "chars": 3}]
    assert peak < 3 * small
