"""Text sizes in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A byte-level BPE vocabulary as ranks (``<base64 of the bytes> <rank>`` a line); a parameter of all operators here.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is cut before the merges (fixed value, belongs to the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_ENCODINGS: dict[int, object] = {}


def encoding(ranks: bytes):
    """The tokenizer of a vocabulary, built once in a worker."""
    key = hash(ranks)
    if key not in _ENCODINGS:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _ENCODINGS[key] = tiktoken.Encoding("given", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _ENCODINGS[key]


def with_tokens(docs: DataFrame, *, text_col: str, keep: list[str], tokenizer: str = TOKENIZER) -> DataFrame:
    """The columns ``keep`` and ``n_tokens``, the size of the whole text; null and blank texts drop out."""
    with open(tokenizer, "rb") as f:
        ranks = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary, under 1 MB
    rows = docs.where(F.trim(F.regexp_replace(text_col, r"\s+", " ")) != "").select(*keep, F.col(text_col).alias("__text"))
    kept = rows.drop("__text").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(ranks.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int32())], [*batch.schema.names[:-1], "n_tokens"])

    return rows.mapInArrow(run, ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "n_tokens int"]))
