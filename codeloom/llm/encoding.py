"""Encoding a whole corpus with a public byte-level BPE tokenizer."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_ENCODERS: dict[int, object] = {}


def _encoder(shared):
    """One encoder per Python worker and vocabulary."""
    from codeloom.llm.bpe import Encoder, read_ranks

    data = shared.value
    key = hash(data)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(data))
    return _ENCODERS[key]


def _over_text(df: DataFrame, text: str, keep: list[str], column: T.StructField, make: Callable, vocabulary: str) -> DataFrame:
    with open(vocabulary, "rb") as f:
        shared = df.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary file: under 1 MB, whatever the corpus
    out = T.StructType([df.schema[c] for c in keep] + [column])
    src = df.select(*keep, df[text].cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for batch in batches:
            texts = batch.column(len(keep))
            for at in range(0, batch.num_rows, 512):  # small results, as texts may be very long
                values = make(encoder, texts.slice(at, 512).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(k).slice(at, 512) for k in range(len(keep))] + [values], names=[*keep, column.name])

    return src.mapInArrow(run, out)


def _lists(encoder, texts) -> pa.Array:
    ids = [encoder.encode(t) for t in texts]
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(x) for x in ids], out=offsets[1:])
    flat = np.fromiter((i for x in ids for i in x), dtype=np.int32, count=int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _counts(encoder, texts) -> pa.Array:
    return pa.array([encoder.count(t) for t in texts], pa.int64())


def encode_corpus(df: DataFrame, text: str = "text", keep: list[str] | None = None, ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns keep of df (default: all but the text) and ids, the list of token ids of the text.

    Each text is parted into words by the tokenizer's pattern, and each word's bytes are merged by rank; see bpe.py.
    Null and empty texts give an empty list. Strings that name special tokens are encoded as plain text. No shuffle:
    one pass over the rows in Arrow batches, the ids of words met before are looked up. A column of df that is named as
    ids is not kept. vocabulary: a .tiktoken file on the driver; it is broadcast.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, ids)]
    return _over_text(df, text, keep, T.StructField(ids, T.ArrayType(T.IntegerType())), _lists, vocabulary)


def token_counts(df: DataFrame, text: str = "text", keep: list[str] | None = None, count: str = "n_tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """As encode_corpus, with the number of tokens instead of their ids; 0 for null and empty texts."""
    keep = [c for c in (df.columns if keep is None else keep) if c not in (text, count)]
    return _over_text(df, text, keep, T.StructField(count, T.LongType()), _counts, vocabulary)
