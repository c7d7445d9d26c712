"""Sizes of texts in tokens of a public tokenizer.

The vocabulary file is read by each Python worker from ``path`` (a parameter;
it must be on every machine) and never copied.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A vocabulary of byte-pair ranks, one base64 token and its rank a line.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern that goes with this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at a time; the pattern never joins across a line end followed by a letter, where texts are cut.
_ENCODERS: dict[str, object] = {}


def encoder(path: str = VOCABULARY):
    """The tokenizer of ``path``, made once a process."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def sizes(docs: DataFrame, key: str, text: str, keep: list[str] | None = None, path: str = VOCABULARY) -> DataFrame:
    """``docs`` reduced to key, ``keep`` and tokens (long): 0 for null and empty texts."""
    kept = [key, *(keep or [])]

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for p in parts:
            out = p[kept].copy()
            out["tokens"] = [len(enc.encode_ordinary(t)) if t else 0 for t in p["_text"]]
            yield out

    shape = docs.select(*kept, F.col(text).alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.schema if f.name != "_text")
    return shape.mapInPandas(count, f"{schema}, tokens long")
