"""Token counts by public tokenizers' files, as columns. The driver reads a file, tasks get it by broadcast; nothing is downloaded."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: The splitting pattern of byte-level rank files, which don't hold it themselves. Fixed value.
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _opened(kind: str, raw: bytes, special: bool) -> Callable[[list[str]], list[int]]:
    if kind == "tiktoken":
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
        own = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
    if kind == "json":
        from tokenizers import Tokenizer

        own = Tokenizer.from_str(raw.decode("utf-8"))
        own.no_truncation()
        own.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in own.encode_batch(texts, add_special_tokens=special)]
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_proto=raw)
    return lambda texts: [len(ids) for ids in own.encode(texts, add_bos=special, add_eos=special, num_threads=1)]


def counter(spark: SparkSession, path: str, special: bool = False) -> Callable[[Column], Column]:
    """A function from a text column to its number of tokens by the file at path: a .tiktoken rank file, a tokenizers .json or a
    sentencepiece .model. special: the tokens that the file's own rule puts around a text count too. A null text has 0; nothing is cut."""
    kind = path.rsplit(".", 1)[-1]
    with open(path, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = _opened(kind, held.value, special)
        for s in batches:
            yield pd.Series(count(["" if x is None else x for x in s.tolist()]), dtype="int32")

    return lambda text: F.when(text.isNotNull(), run(text)).otherwise(F.lit(0))
