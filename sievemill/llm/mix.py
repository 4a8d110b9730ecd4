"""Mixing sources to target weights, in tokens of a public tokenizer."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievemill.session import cut

#: Where the vocabulary lies; a parameter, for it is no part of this repository.
VOCABULARY = os.environ.get("SIEVEMILL_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the split pattern of the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SEED = 17


@lru_cache(2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a whole text; 0 for null and empty ones."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = encoding(vocabulary)
        for texts in batches:
            yield pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, T.LongType())(text)


def source_name(c: Column) -> Column:
    """One spelling of a source: lower case, no blanks around, hyphens and blanks inside as underscores."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"[\s ]+", " "))), r"[-\s]+", "_")


def sized(documents: DataFrame, *, text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with ``mix_source`` and ``tokens``."""
    return documents.withColumns({"mix_source": source_name(F.col(source)), "tokens": token_counts(F.col(text), vocabulary)})


def mixing_rates(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source its tokens, the rate (mean copies of a document) and whether the cap binds.

    ``sizes``: (mix_source, tokens, ...) rows. The total is that of all tokens, those of sources without a
    target included. rate = target_share x total / tokens of the source, at most ``max_repeats`` (null: no
    cap). A source without documents has no rate. Targets of one source, spelled in several ways, add up
    and the smallest cap holds; repeated rows count once.
    """
    per = sizes.groupBy("mix_source").agg(F.sum("tokens").alias("source_tokens"), F.count(F.lit(1)).alias("source_docs"))
    wanted = targets.select(source_name(F.col("source")).alias("mix_source"), "target_share", "max_repeats").distinct().groupBy("mix_source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    corpus = per.agg(F.sum("source_tokens")).first()[0] or 0
    asked = F.col("target_share") * F.lit(float(corpus)) / F.nullif(F.col("source_tokens"), F.lit(0))
    return (
        wanted.join(per, "mix_source", "left")
        .withColumns({"corpus_tokens": F.lit(corpus).cast("bigint"), "asked_rate": asked})
        .withColumn("rate", F.least("asked_rate", F.col("max_repeats").cast("double")))
        .withColumn("capped", F.col("asked_rate") > F.col("max_repeats"))
    )


def _copied(rows: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    """The rows (doc_id, mix_source, ...) once for each copy of the mixture, with ``copy_no``."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    copies = F.floor("rate").cast("int") + (draw < F.col("rate") - F.floor("rate")).cast("int")
    # One row a source on the small side: it is as long as the list of targets.
    joined = rows.join(F.broadcast(rates.select("mix_source", "rate")), "mix_source").withColumn("copies", copies).where("copies > 0")
    return joined.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("copies"))))


def _emitted(sizes: DataFrame, rates: DataFrame, seed: int) -> DataFrame:
    return _copied(sizes, rates, seed).select("doc_id", "mix_source", "tokens", "copy_no")


def _counted(documents: DataFrame, doc_id: str, text: str, source: str, vocabulary: str) -> DataFrame:
    """Id, source and tokens, written once, as the rates and the emission both read them."""
    lean = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(source).alias("source"))
    return cut(sized(lean, vocabulary=vocabulary).select("doc_id", "mix_source", "tokens").where("tokens > 0"))


def mixed(documents: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, mix_source, tokens, copy_no): each document floor(rate) times, and once more by a
    Bernoulli draw with the fraction of the rate as probability.

    The draw hashes the id and the seed, so it does not depend on partitions and repeats exactly when an
    executor is lost. Sources without a target are left out; null and empty texts have no tokens and are
    left out. The tokens are counted once, in the scan, the rates (one row a source) are joined by key.
    """
    sizes = _counted(documents, doc_id, text, source, vocabulary)
    return _emitted(sizes, mixing_rates(sizes, targets), seed)


def mixed_texts(documents: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, mix_source, copy_no, text): the mixture itself, the copies of ``mixed`` with their texts.

    The copies follow from the id and the rates, so the texts come from a second scan and are not shuffled."""
    rates = mixing_rates(_counted(documents, doc_id, text, source, vocabulary), targets)
    rows = documents.select(F.col(doc_id).alias("doc_id"), source_name(F.col(source)).alias("mix_source"), F.col(text).alias("text")).where("text <> ''")
    return _copied(rows, rates, seed).select("doc_id", "mix_source", "copy_no", "text")


def mixture_report(documents: DataFrame, targets: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per target source: documents, tokens, target, cap, rate, what was emitted and the share reached,
    of the emitted total and of the corpus total."""
    sizes = _counted(documents, doc_id, text, source, vocabulary)
    rates = mixing_rates(sizes, targets)
    got = _emitted(sizes, rates, seed).groupBy("mix_source").agg(F.sum("tokens").alias("mixed_tokens"), F.count(F.lit(1)).alias("mixed_docs"), F.max("copy_no").alias("most_copies"))
    joined = rates.join(got, "mix_source", "left").fillna(0, ["mixed_tokens", "mixed_docs", "most_copies", "source_tokens", "source_docs"])
    # One row a target source: the window's single partition is as long as the list of targets.
    of_mix = F.col("mixed_tokens") / F.nullif(F.sum("mixed_tokens").over(Window.partitionBy()), F.lit(0))
    return joined.select(
        F.col("mix_source").alias("source"), "target_share", "max_repeats", "source_docs", "source_tokens", "corpus_tokens", "rate", "capped", "mixed_docs", "mixed_tokens", "most_copies",
        of_mix.alias("share_of_mix"), (F.col("mixed_tokens") / F.nullif(F.col("corpus_tokens"), F.lit(0))).alias("share_of_corpus"),
    )
