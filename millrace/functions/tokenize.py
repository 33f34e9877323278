"""Token ids by a public tokenizer's file; where it lies is a parameter."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _slices(part: pa.Array, size: int = 1 << 18) -> Iterator[list]:
    """Values of a batch, some at a time, about as many as hold `size` bytes: what tokenizers keep of a text is many times its size."""
    step = max(1, size * len(part) // max(1, part.nbytes))
    for i in range(0, len(part), step):
        yield part.slice(i, step).to_pylist()


def ids(text: Column, path: str) -> Column:
    """The ids of a text, in which the names of special tokens are ordinary text; null is empty. A task reads the tokenizer once."""

    kind = pa.list_(pa.int32())

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def encode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        for part in parts:
            made = [pa.array([f.ids for f in tokenizer.encode_batch([t or "" for t in some], add_special_tokens=False)], kind) for some in _slices(part)]
            yield pa.concat_arrays(made) if made else pa.array([], kind)

    return encode(text)


def decoded(ids: Column, path: str) -> Column:
    """The text that ids stand for."""

    @F.arrow_udf(T.StringType())
    def decode(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for part in parts:
            made = [pa.array(tokenizer.decode_batch([i or [] for i in some], skip_special_tokens=False), pa.string()) for some in _slices(part)]
            yield pa.concat_arrays(made) if made else pa.array([], pa.string())

    return decode(ids)


def stand_again(text: Column, **paths: str) -> Column:
    """struct: for each tokenizer, by its name, whether a text's ids stand for it again. Ids are decoded where they are made; none are stored or handed on."""

    @F.arrow_udf(T.StructType([T.StructField(name, T.BooleanType()) for name in paths]))
    def same(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        from tokenizers import Tokenizer

        tokenizers = [Tokenizer.from_file(path) for path in paths.values()]
        for t in tokenizers:
            t.encode_special_tokens = True
        for part in parts:
            found: list[list[bool]] = [[] for _ in tokenizers]
            for some in _slices(part):
                texts = [t or "" for t in some]
                for tokenizer, out in zip(tokenizers, found, strict=True):
                    made = [f.ids for f in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
                    out += [a == b for a, b in zip(tokenizer.decode_batch(made, skip_special_tokens=False), texts, strict=True)]
            yield pa.StructArray.from_arrays([pa.array(f, pa.bool_()) for f in found], names=list(paths))

    return same.asNondeterministic()(text)  # else each field runs it again
