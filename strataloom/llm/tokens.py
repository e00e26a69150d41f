"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level BPE vocabulary of ranks; every function takes another path.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The pattern that this vocabulary's texts are split by.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_loaded: dict[str, object] = {}


def encoding(path: str = TOKENIZER):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(docs: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER, also: tuple[str, ...] = ()) -> DataFrame:
    """(key, n_tokens, *also) of every row; a null text has null tokens, an empty one none. Texts are counted whole."""
    docs.sparkSession.sparkContext.addFile(tokenizer)  # to every executor; there it lies under its name
    kind = docs.schema[key].dataType.simpleString()
    extra = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in also)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoding(SparkFiles.get(tokenizer.rsplit("/", 1)[-1]))
        for b in batches:
            n = [None if t is None else len(e.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *b.columns[2:]], names=["key", "n_tokens", *also])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text"), *also).mapInArrow(run, f"key {kind}, n_tokens long{extra}")
