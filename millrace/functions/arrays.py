"""Token-id arrays: truncation, padding with masks, labels masked over prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
PAD, BOS, EOS, IGNORED = 0, 1, 2, -100


def truncated(ids: Column, most: int, bos: bool = True, eos: bool = True) -> Column:
    """ids between BOS and EOS, cut to `most` with EOS kept at the end."""
    whole = F.concat(F.array(F.lit(BOS)), ids) if bos else ids
    if not eos:
        return F.slice(whole, 1, most)
    whole = F.concat(whole, F.array(F.lit(EOS)))
    return F.when(F.size(whole) > most, F.concat(F.slice(whole, 1, most - 1), F.array(F.lit(EOS)))).otherwise(whole)


def padded(ids: Column, size: int) -> Column:
    """struct(ids, mask): ids cut or filled with PAD to `size`, and 1 where an id is."""
    held = F.slice(ids, 1, size)
    fill = F.greatest(F.lit(size) - F.size(held), F.lit(0))
    return F.struct(F.concat(held, F.array_repeat(F.lit(PAD), fill)).alias("ids"), F.concat(F.array_repeat(F.lit(1), F.size(held)), F.array_repeat(F.lit(0), fill)).alias("mask"))


def labels(prompt: Column, answer: Column, most: int) -> Column:
    """The training labels of prompt and answer: IGNORED over the prompt, the ids of the answer, cut to `most`."""
    return F.slice(F.concat(F.array_repeat(F.lit(IGNORED), F.size(prompt)), answer), 1, most)


def fertility(text: Column, ids: Column) -> Column:
    """Characters for each token."""
    return F.when(F.size(ids) > 0, F.length(text) / F.size(ids)).otherwise(0.0)
