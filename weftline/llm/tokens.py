"""Token budget: how many tokens a document holds under an existing tokenizer, and the sums by slice.

The distinct pieces of all texts are sorted into partitions, each of which is walked as a prefix trie: the states of the
tokenizer at every prefix of the last piece stand on a stack, a piece takes over those of the prefix it shares and steps
on from there. The states are exact, so the count at a piece's end is the tokenizer's own. The counts are then joined to
the documents' pieces, of which a table has each once per document. Pieces that make up at least one in 2000 of its rows, of which
there can be no more than 2000, are joined by broadcast and so cost no shuffle; the others by a shuffle in which no piece can be hot.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.session import cut

from .common import once

HOT = 2000


class Lexical:
    """Runs of letters and digits of the text in NFC and lower case.

    A piece is a run of letters, digits and marks: NFC composes nothing across its borders. A state is (tokens, inside one).
    """

    PIECE = r"[\p{L}\p{N}\p{M}]+"

    def open(self) -> None:
        self.start = (0, False)

    def form(self, piece: str) -> str:
        return unicodedata.normalize("NFC", piece).lower()

    def step(self, form: str, end: int, states: list) -> tuple[int, bool]:
        count, inside = states[end - 1]
        now = unicodedata.category(form[end - 1])[0] in "LN"
        return count + (now and not inside), now

    def tokens(self, state: tuple[int, bool]) -> int:
        return state[0]


class ByteBpe:
    """Byte-level BPE by a rank file of a public tokenizer. A piece is a match of the tokenizer's own splitting pattern.

    The state at a prefix is its (last token, tokens): the last token of a prefix is the one token that ends there and that
    the merges would leave apart from the last token of the prefix before it.
    """

    PIECE = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:  # on the driver; tasks get the lines by broadcast
            self.lines = f.read().splitlines()

    def open(self) -> None:
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines)}
        self.bytes = {b: a for a, b in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.bpe = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=self.ranks, special_tokens={})
        self.apart: dict[tuple[int, int], bool] = {}
        self.start = (-1, 0)

    def form(self, piece: str) -> bytes:
        return piece.encode("utf-8")

    def stays(self, a: int, b: int) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) > 1_000_000:
                self.apart.clear()
            known = self.apart[a, b] = self.bpe._encode_single_piece(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def step(self, form: bytes, end: int, states: list) -> tuple[int, int]:
        for begin in range(max(0, end - self.longest), end):
            token = self.ranks.get(form[begin:end])
            if token is not None:
                last, count = states[begin]
                if last < 0 or self.stays(last, token):
                    return token, count + 1
        raise ValueError("the rank file lacks a byte")

    def tokens(self, state: tuple[int, int]) -> int:
        return state[1]


def walk(pieces: list[str], tokenizer: Lexical | ByteBpe, states: list, before: list) -> Iterator[int]:
    """The tokens of each piece; states and before[0] carry the trie's current branch from call to call."""
    for piece in pieces:
        form, last, k = tokenizer.form(piece), before[0], 0
        most = min(len(form), len(last))
        while k < most and form[k] == last[k]:
            k += 1
        del states[k + 1 :]
        for end in range(k + 1, len(form) + 1):
            states.append(tokenizer.step(form, end, states))
        before[0] = form
        yield tokenizer.tokens(states[-1])


def count_tokens(df: DataFrame, key: str, text: Column, tokenizer: Lexical | ByteBpe) -> DataFrame:
    """(key, tokens bigint) for each row of df, whose key must be unique. A null or empty text has 0."""
    # the empty piece stands for the row itself, so that texts without tokens stay
    found = F.concat(F.array(F.lit("")), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(tokenizer.PIECE), F.lit(0)))
    pieces = df.select(F.col(key), F.explode(found).alias("_piece"))
    each = cut(pieces.groupBy(key, "_piece").agg(F.count(F.lit(1)).alias("_times")))
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        own.open()
        states, before = [own.start], [own.form("")]
        for b in batches:
            counts = list(walk(b.column(0).to_pylist(), own, states, before))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(counts, pa.int64())], ["_piece", "_rows", "_tokens"])

    tries = each.groupBy("_piece").agg(F.count(F.lit(1)).alias("_rows")).repartitionByRange("_piece").sortWithinPartitions("_piece")
    terminal = cut(tries.mapInArrow(run, "_piece string, _rows bigint, _tokens bigint"))
    total = terminal.agg(F.sum("_rows")).first()[0] or 0
    hot = F.broadcast(terminal.where(F.col("_rows") * HOT >= total).select("_piece", "_tokens"))
    cold = terminal.where(F.col("_rows") * HOT < total).select("_piece", "_tokens")
    both = each.join(hot, "_piece").unionByName(each.join(hot, "_piece", "left_anti").join(cold, "_piece"))
    return both.groupBy(key).agg(F.sum(F.col("_times") * F.col("_tokens")).alias("tokens"))


def counted_chunks(chunks: DataFrame, tokenizer: Lexical | ByteBpe | None = None) -> DataFrame:
    """Each chunk once with the tokens of its text beside the recorded count."""
    named = chunks.select("chunk_id", "event_id", "talk_id", "text", "token_count").where(F.col("chunk_id").isNotNull())
    rows = named.dropDuplicates(["chunk_id"])  # and so stands by chunk, which the counting needs
    about = named.drop("text").dropDuplicates(["chunk_id"])
    return about.join(count_tokens(rows, "chunk_id", F.col("text"), tokenizer or Lexical()), "chunk_id")


def wrong_counts(chunks: DataFrame) -> DataFrame:
    """Chunks whose recorded count is null or isn't the number of tokens in their text (a null text has 0).

    Repeated rows count once; a chunk without an id can't be named and gives none; an empty table gives none.
    """
    return counted_chunks(chunks).where(~F.col("token_count").eqNullSafe(F.col("tokens"))).select("chunk_id")


def budget(chunks: DataFrame, talks: DataFrame, languages: DataFrame, subword: ByteBpe | None = None) -> DataFrame:
    """Tokens by event, language of the talk and domain, counted anew: the recorded counts aren't trusted, nor are the talks' labels.

    languages: (talk_id, language), unique; a talk that isn't there has 'und'. Chunks of unknown talks have a null domain. With a
    subword tokenizer its tokens are summed too.
    """
    counted = counted_chunks(chunks)
    if subword:
        rows = chunks.select("chunk_id", "text").where(F.col("chunk_id").isNotNull()).dropDuplicates(["chunk_id"])
        counted = counted.join(count_tokens(rows, "chunk_id", F.col("text"), subword).withColumnRenamed("tokens", "subword_tokens"), "chunk_id")
    else:
        counted = counted.withColumn("subword_tokens", F.lit(None).cast("bigint"))
    about = once(talks.select("talk_id", "domain"), "talk_id")
    return (
        counted.join(about, "talk_id", "left")
        .join(languages, "talk_id", "left")
        .groupBy("event_id", F.coalesce("language", F.lit("und")).alias("language"), "domain")
        .agg(
            F.count(F.lit(1)).alias("chunks"),
            F.sum("tokens").alias("tokens"),
            F.sum("subword_tokens").alias("subword_tokens"),
            F.count_if(~F.col("token_count").eqNullSafe(F.col("tokens"))).alias("wrong_counts"),
        )
    )
