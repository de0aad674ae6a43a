"""Tokenizer quality: compression, fertility, coverage, density, bits per byte."""

from __future__ import annotations

import math
import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenmill.operators.codec import TokenizerLike, encode


def evaluate(docs: DataFrame, tokenizer: TokenizerLike, by: list[str] | None = None, text: str = "text") -> DataFrame:
    """Bytes, tokens, words, compression ratio, coverage (share of ids above 255) and tokens for each word in running text, from one encoding."""
    by = by or []
    d = docs.select(*by, text, F.octet_length(text).cast("long").alias("n_bytes"), F.regexp_count(text, F.lit(r"\S+")).cast("long").alias("n_words"))
    e = encode(d, tokenizer, text)
    e = e.select(*by, "n_bytes", "n_words", F.size("tokens").cast("long").alias("n_tokens"), F.size(F.filter("tokens", lambda t: t > 255)).cast("long").alias("n_multi")).where("n_bytes is not null")
    s = e.groupBy(*by).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_bytes", "n_words", "n_tokens", "n_multi")])
    return s.select(*by, "n_bytes", "n_words", "n_tokens", (F.col("n_bytes") / F.greatest("n_tokens", F.lit(1))).alias("compression"), (F.col("n_multi") / F.greatest("n_tokens", F.lit(1))).alias("coverage"), (F.col("n_tokens") / F.greatest("n_words", F.lit(1))).alias("tokens_per_word"))


def fertility(docs: DataFrame, tokenizer: TokenizerLike, text: str = "text") -> DataFrame:
    """``n_words, n_tokens, fertility``: mean tokens of a word that is encoded alone; each different word is encoded once."""
    words = docs.select(F.explode(F.regexp_extract_all(text, F.lit(r"(\S+)"), 1)).alias("word")).groupBy("word").count()
    e = encode(words, tokenizer, "word")
    s = e.agg(F.sum("count").alias("n_words"), F.sum(F.col("count") * F.size("tokens")).alias("n_tokens"))
    return s.select("n_words", "n_tokens", (F.col("n_tokens") / F.col("n_words")).alias("fertility"))


def compare(rows: DataFrame, name: str, base: str, measures: list[str]) -> DataFrame:
    """Rows of one tokenizer each, with the ratio of every measure to that of ``base``."""
    b = rows.where(F.col(name) == base).select(*[F.col(m).alias(f"__{m}") for m in measures]).limit(1)
    return rows.join(F.broadcast(b), F.lit(True)).select(*rows.columns, *[(F.col(m) / F.col(f"__{m}")).alias(f"{m}_ratio") for m in measures])


def density(tokens: DataFrame, vocab: DataFrame, first: int) -> DataFrame:
    """Mean bytes of the first tokens of a stream (``pos, token_id``); special tokens have none."""
    v = F.broadcast(vocab.select("token_id", F.when(F.col("kind").isin("byte", "token"), F.octet_length("token")).otherwise(F.lit(0)).alias("size")))
    return tokens.where(F.col("pos") < first).join(v, "token_id").agg(F.count("*").alias("n_tokens"), F.avg("size").alias("bytes_per_token"))


def vocab_mean_length(vocab: DataFrame) -> DataFrame:
    """Mean length of tokens, with and without the special ones."""
    plain = F.col("kind").isin("byte", "token")
    return vocab.agg(F.avg(F.octet_length("token")).alias("mean_all"), F.avg(F.when(plain, F.octet_length("token"))).alias("mean_plain"))


def bits_per_byte(nats: Column, n_bytes: Column) -> Column:
    """Ratio of sums, from negative log probabilities in nats."""
    return F.sum(nats) / F.lit(math.log(2.0)) / F.sum(n_bytes)


def loss_to_bpb(loss: Column, bytes_per_token: Column) -> Column:
    return loss / F.lit(math.log(2.0)) / bytes_per_token


def encode_speed(text: str, tokenizer: TokenizerLike, repeats: int = 3) -> float:
    """MB encoded in a second on this machine, the best of some runs."""
    best, size = math.inf, len(text.encode())
    for _ in range(repeats):
        began = time.perf_counter()
        tokenizer.encode(text)
        best = min(best, time.perf_counter() - began)
    return size / 1e6 / max(best, 1e-9)
