"""Evaluation passages inside a training corpus: Wu-Manber search over words."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.session import map_batches

#: Consecutive words that make a leak.
WINDOW = 12
#: Words of test items that one scan of the corpus searches for; more items are searched in blocks. The tables
#: of a block take some 150 MB of a worker.
BLOCK_WORDS = 500_000
#: Words of one block of the shift and bucket tables.
_B = 2

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters and digits in lower case, markup tags aside; none for null."""
    if not text:
        return []
    return _WORD.findall((_TAG.sub(" ", text) if "<" in text else text).lower())


class WuManber:
    """Finds every pattern (``window`` consecutive words of an item) in a list of words.

    ``shift`` tells by the block of two words at the end of the window how far the window may move without
    missing a pattern; only a shift of 0 opens the bucket of the window's hash, whose patterns are then
    compared directly, word by word. A pattern is kept as its item and place in one number, so the words of
    the items are held once."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW) -> None:
        self.window = window
        self.items = [(item, words_of(text)) for item, text in items]
        self.shift: dict[tuple[str, str], int] = {}
        self.buckets: dict[int, int | list[int]] = {}
        for n, (_, words) in enumerate(self.items):
            for start in range(len(words) - window + 1):
                for end in range(_B, window + 1):
                    block = (words[start + end - 2], words[start + end - 1])
                    if window - end < self.shift.get(block, window):
                        self.shift[block] = window - end
                key, here = hash(tuple(words[start : start + window])), n << 32 | start
                held = self.buckets.setdefault(key, here)
                if isinstance(held, list):
                    held.append(here)
                elif held != here:
                    self.buckets[key] = [held, here]

    def search(self, words: list[str]) -> set[int]:
        found: set[int] = set()
        skip, shift, window = self.window - _B + 1, self.shift, self.window
        at, n = window, len(words)
        while at <= n:
            move = shift.get((words[at - 2], words[at - 1]), skip)
            if not move:
                here = words[at - window : at]
                held = self.buckets.get(hash(tuple(here)), ())
                for place in (held,) if isinstance(held, int) else held:
                    item, told = self.items[place >> 32]
                    start = place & 0xFFFFFFFF
                    if item not in found and told[start : start + window] == here:
                        found.add(item)
                move = 1
            at += move
        return found


#: The tables of the last block in this worker, by the name of the block.
_BUILT: dict[str, WuManber] = {}


def _machine(name: str, items: list[tuple[int, str]], window: int) -> WuManber:
    """The tables of a block, built once a worker process instead of once a task."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = WuManber(items, window)
    return _BUILT[name]


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(doc_id, item_id): documents that hold ``window`` or more consecutive words of an item.

    The test items are the stated query set; they go to the executors in blocks of at most about
    ``block_words`` words (their number is counted first), one narrow scan of the corpus for each, so
    neither side is shuffled until equal pairs collapse. Null and short texts hold nothing; items shorter
    than ``window`` cannot leak; repeated rows give one pair; a null id is no record.
    """
    bare = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text"), (F.length(F.col(item_text)) / 4).alias("n"))
    total = bare.agg(F.sum("n")).first()[0] or 0
    blocks = int(total // block_words) + 1
    ids = documents.schema[doc_id].dataType.simpleString()
    kind = items.schema[item_id].dataType.simpleString()
    docs = documents.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark = documents.sparkSession
    out = None
    for k in range(blocks):
        block = [(r["item_id"], r["text"]) for r in bare.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).select("item_id", "text").collect()]
        shared, name = spark.sparkContext.broadcast(block), uuid.uuid4().hex

        def scan(batches: Iterator[pd.DataFrame], shared=shared, name=name) -> Iterator[pd.DataFrame]:
            machine = _machine(name, shared.value, window)
            for pdf in batches:
                pairs = [(d, i) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for i in machine.search(words_of(t))]
                yield pd.DataFrame(pairs, columns=["doc_id", "item_id"])

        part = map_batches(docs, scan, f"doc_id {ids}, item_id {kind}")
        out = part if out is None else out.unionByName(part)
    return out.distinct()
