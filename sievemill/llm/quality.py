"""Text quality: counts and ratios per document, and lines labelled by a hidden Markov model."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievemill.session import map_batches

LABELS = ("prose", "list", "table", "junk")
#: Chance that a line has the label of the line before it.
STAY = 0.9
#: Share of characters that are not prose, above which a document is not prose.
MOST = 0.5

_BREAK = re.compile(r"(?i)<\s*(?:br|/p|/div|/h[1-6]|/ul|/ol|/table|p|div|h[1-6]|ul|ol|table|/li|/tr|tr)\b[^<>]*>")
_ITEM = re.compile(r"(?i)<\s*li\b[^<>]*>")
_CELL = re.compile(r"(?i)<\s*/\s*t[dh]\s*>")
_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
_BULLET = r"^[\s\p{Z}]*(?:[-*•·‣◦▪–+>][\s\p{Z}]+)*(?:[-*•·‣◦▪–+]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])[\s\p{Z}]+"
_TOKEN = re.compile(r"[^\W_]+")
_INLINE = re.compile(r"\s[·•|/]\s|;\s|,\s")
_VOWELS = frozenset("aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýœ")
_HEX = frozenset("0123456789abcdef")
# What UTF-8 read as another encoding leaves behind.
_MOJIBAKE = re.compile(r"[ÃÂâ][-¿‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¬€]|ï¿½|ðŸ|â€|Å¾|�")
_CODE = r"[{}\[\]=;<>()$&*#\\^~|+_@]"
_SYMBOL = r"[^\p{L}\p{N}\p{M}\p{Z}\s.,;:!?'\"’“”„«»\-–—()/%&…、。！？，：；（）「」『』・،؛؟।]"
_ENDS = r"[.!?…\"”»。！？」』؟।។။]$"
#: Characters of scripts written without blanks between words.
_UNSPACED = re.compile("[฀-໿က-႟ក-៿぀-ヿ㐀-䶿一-鿿豈-﫿\U00020000-\U0003ffff]")
#: Characters of texts that are labelled at once.
PART_CHARS = 4_000_000


def _parts(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
    """A batch in parts of about ``PART_CHARS`` characters; a longer text is a part by itself."""
    size = pdf["text"].str.len().fillna(0).cumsum() // PART_CHARS
    for _, part in pdf.groupby(size, sort=False):
        yield part


def lines_of(text: str) -> list[str]:
    """The lines of a text with markup turned into layout: breaks, bullets and cells."""
    if "<" in text:
        text = _CELL.sub("\t", _ITEM.sub("\n• ", _BREAK.sub("\n", text)))
        text = _TAG.sub("", text)
    return [line for line in text.split("\n") if line.strip()]


@lru_cache(1 << 16)
def _voiced(t: str) -> bool:
    return not t.isascii() or not _VOWELS.isdisjoint(t)


def _odd(t: str) -> bool:
    """No word of a language: letters and digits mixed, no vowel, or far too long."""
    return (not t.isalpha() and not t.isdigit() and t.isascii() and len(t) > 2) or (len(t) > 3 and t.isalpha() and not _voiced(t)) or len(t) > 34


@lru_cache(1 << 16)
def _traits(t: str) -> tuple[int, bool, bool, bool, bool]:
    """Of a token: the words it stands for, whether it is odd, four hexadecimal digits, letters only, voiced letters.

    Two characters of a script written without blanks count as a word."""
    unspaced = 0 if t.isascii() else len(_UNSPACED.findall(t))
    odd = not unspaced and (_odd(t) if t.isascii() else len(t) > 34 or (len(t) > 2 and not t.isdigit() and any(map(str.isdigit, t))))
    alpha = t.isalpha()
    return max(1, round(unspaced / 2) + (unspaced < len(t) if unspaced else 0)), odd, len(t) == 4 and not set(t) - _HEX, alpha, alpha and _voiced(t)


def _short_pieces(body: str) -> bool:
    """Whether a line is a row of five or more short items."""
    pieces = [p for p in _INLINE.split(body) if p.strip()]
    return len(pieces) >= 5 and sum(len(_TOKEN.findall(p)) <= 6 for p in pieces) >= 0.85 * len(pieces)


def _scores(lines: list[str], doc: np.ndarray, common: frozenset[str]) -> np.ndarray:
    """Log scores of each line under prose, list, table and junk, all lines of a batch at once.

    ``doc`` numbers the document of each line, in order. Lines of scripts other than Latin are judged
    without the share of common words, which a list of some languages says nothing about."""
    n = len(lines)
    raw = pa.array(lines, pa.large_string())
    s = pc.utf8_trim_whitespace(raw)
    count = lambda pattern, of=s: pc.count_substring_regex(of, pattern).to_numpy(zero_copy_only=False)
    has = lambda pattern, of=s: pc.match_substring_regex(of, pattern).to_numpy(zero_copy_only=False)
    body = pc.replace_substring_regex(s, _BULLET, "")
    bullet = pc.not_equal(body, s).to_numpy(zero_copy_only=False)
    low = pc.utf8_lower(s)

    # Tokens of all lines in one array; each distinct token is looked at once.
    split = pc.split_pattern_regex(pc.utf8_lower(body), r"[^\p{L}\p{N}\p{M}]+")
    tokens = pc.list_flatten(split)
    parent = pc.list_parent_indices(split).to_numpy(zero_copy_only=False)
    full = pc.not_equal(tokens, "").to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(tokens.filter(pa.array(full)))
    parent, code = parent[full], coded.indices.to_numpy(zero_copy_only=False)
    each = coded.dictionary.to_pylist()
    traits = np.array([(*_traits(t), t in common) for t in each] or np.empty((0, 6)), dtype=float).reshape(-1, 6)
    total = lambda w: np.bincount(parent, weights=w[code], minlength=n)
    k_tokens = np.bincount(parent, minlength=n)
    k, odd, hexish, alpha_words, voiced, function = (total(traits[:, i]) for i in range(6))
    many = np.flatnonzero(k_tokens >= 12)
    distinct = np.zeros(n)
    if len(many):
        in_many = (k_tokens >= 12)[parent]
        kinds = np.sort(parent[in_many].astype(np.int64) * max(1, len(each)) + code[in_many])
        kinds = kinds[np.r_[True, kinds[1:] != kinds[:-1]]]
        distinct = np.bincount(kinds // max(1, len(each)), minlength=n).astype(float)

    over = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    # What is rarer is counted: a pattern that matches nearly every character costs ten times as much.
    length = pc.utf8_length(s).to_numpy(zero_copy_only=False)
    k_any, solid = k_tokens > 0, length - count(r"[\s\x{0085}\p{Z}]")
    function, hexish, odd_share = over(function, k_tokens), over(hexish, k_tokens), np.where(k_any, over(odd, k_tokens), 1.0)
    alpha, symbols, code_signs = length - count(r"\P{L}"), count(_SYMBOL), count(_CODE)
    foreign = (alpha > 0) & (count(r"[^\P{L}\p{Latin}]") > 0.5 * alpha)
    ends = has(_ENDS)
    broken = np.zeros(n)
    for i in np.flatnonzero(has(r"[ÃÂâïðÅ\x{FFFD}]")):
        broken[i] = sum(map(len, _MOJIBAKE.findall(lines[i])))

    # Cells of a line under the delimiter that gives most; 1 for none, and for code.
    tabs = pc.count_substring(s, "\t").to_numpy(zero_copy_only=False)
    bars = pc.count_substring(pc.utf8_trim(s, "|"), "|").to_numpy(zero_copy_only=False)
    tight = count(r"[,;]") - count(r"[,;](?:\s|$)")
    gaps = count(r"\S {2,}") - count(r"\S {2,}[\t\n\f\r\v]")
    cells = 1 + np.maximum.reduce([tabs, bars, np.where(tight >= 2, tight, 0), gaps])
    cells = np.where(has(r"\{") | (count("=") > 3), 1, cells)
    same = np.zeros(n + 1, dtype=bool)
    same[1:n] = (doc[1:] == doc[:-1]) & (cells[1:] == cells[:-1])
    near = same[:-1].astype(int) + same[1:].astype(int)

    texts = pc.dictionary_encode(low)
    key = doc.astype(np.int64) * max(1, len(texts.dictionary)) + texts.indices.to_numpy(zero_copy_only=False)
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    times, of_doc = times[inverse], np.bincount(doc)[doc]
    repeats = np.where(times >= 4, times / of_doc, 0.0)
    short_pieces = np.zeros(n, dtype=bool)
    rows = body.to_pylist() if n else []
    for i in np.flatnonzero(count(_INLINE.pattern, body) >= 4):
        short_pieces[i] = _short_pieces(rows[i])

    junk = np.where(over(symbols, solid) > 0.3, 6 * np.minimum(1.0, over(symbols, solid) + 0.3), 0.0)
    junk += 5 * ((over(code_signs, solid) > 0.1) & (cells <= 2))
    junk += 6 * ((broken >= 2) & (broken / np.maximum(1, solid) > 0.1))
    junk += 5 * ((k_tokens >= 3) & (odd_share > 0.4)) + 5 * ((k_tokens >= 3) & (hexish > 0.6))
    junk += np.where((k_tokens >= 12) & ((over(distinct, k_tokens) < 0.2) | (distinct <= 5)), np.where(distinct <= 12, 7.0, 2.0), 0.0)
    junk += 7 * (repeats >= 0.3)
    junk += 2.5 * (~k_any | (alpha / np.maximum(1, solid) < 0.2) & (cells < 3))
    junk += 4 * ((alpha_words >= 4) & (over(voiced, alpha_words) < 0.6))

    table = np.where(cells >= 3, 3.5 + 1.5 * (near > 0) + (cells >= 4), np.where((cells == 2) & (near > 0) & (tabs > 0), 3.5, 0.0))
    table -= 2 * ((function > 0.2) & ~foreign)

    listy = 2.5 * (k_any & (k <= 9) & ~ends) + 0.5 * (k_any & (k <= 4)) + 1.5 * bullet
    listy += 4.5 * (short_pieces & (foreign | (function < 0.12)))
    few = (k <= 12) & np.where(foreign, ~ends, function < 0.12)
    listy += few - 2.0 * (~few & ~foreign & (function > 0.22) & (k >= 6))

    known = np.where(foreign, 2.0 * (ends | (k >= 12)), 2.0 * (function >= 0.15) + 2.5 * (function >= 0.25))
    prose = (k >= 5) * known + 2.0 * (k >= 8) + 1.5 * (ends & (k >= 4)) - 2.0 * (~foreign & (function < 0.08) & (k >= 6))
    return np.stack([prose, listy, table, junk], axis=1)


def _paths(scores: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The most likely labels of all documents, line by line of all documents at once (Viterbi)."""
    n = len(scores)
    stay, move = math.log(STAY), math.log((1 - STAY) / (len(LABELS) - 1))
    starts = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]]) if n else np.empty(0, int)
    sizes = np.diff(np.r_[starts, n])
    order = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[order], sizes[order]
    score, came = scores.copy(), np.zeros((n, len(LABELS)), dtype=np.int8)
    longest = int(sizes[0]) if len(sizes) else 0
    # Documents stand by falling length, so those with a line at a step are the first ones.
    alive = np.searchsorted(-sizes, -np.arange(1, longest + 1), side="right")
    for i in range(1, longest):
        at = starts[: alive[i]] + i
        before = score[at - 1]
        top = before.argmax(axis=1)
        best = before[np.arange(len(at)), top] + move
        own = before + stay
        kept = own >= best[:, None]
        score[at] += np.where(kept, own, best[:, None])
        came[at] = np.where(kept, np.arange(len(LABELS)), top[:, None])
    path = np.zeros(n, dtype=np.int8)
    path[starts + sizes - 1] = score[starts + sizes - 1].argmax(axis=1)
    for i in range(longest - 1, 0, -1):
        at = starts[: alive[i]] + i
        path[at - 1] = came[at, path[at]]
    return path


def label_lines(text: str | None, common: frozenset[str]) -> list[tuple[str, str]]:
    """(line, label) by the most likely path through the model; nothing for null or blank texts."""
    lines = lines_of(text or "")
    doc = np.zeros(len(lines), dtype=np.int64)
    return [(line, LABELS[t]) for line, t in zip(lines, _paths(_scores(lines, doc, common), doc), strict=True)] if lines else []


def _shares_of(texts: list[str | None], common: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lines of each text, and its characters by label."""
    split = [lines_of(t or "") for t in texts]
    counts = np.array([len(x) for x in split], dtype=np.int64)
    lines = [line for x in split for line in x]
    chars = np.zeros((len(texts), len(LABELS)))
    if lines:
        doc = np.repeat(np.arange(len(texts)), counts)
        path = _paths(_scores(lines, doc, common), doc)
        np.add.at(chars, (doc, path), [len(line.strip()) for line in lines])
    return counts, chars


def label_shares(documents: DataFrame, common_words: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lexicon: int = 100_000) -> DataFrame:
    """(doc_id, n_lines, prose, list, table, junk): shares of the characters of a document by line label.

    Each document is labelled by itself in the scan; repeated rows collapse. A null or blank text has no
    lines and null shares; a null id is no record. ``common_words`` goes to every executor: it is a word
    list, refused beyond ``lexicon`` words.
    """
    ids = documents.schema[doc_id].dataType.simpleString()
    words = [r[0] for r in common_words.select(F.lower("word").alias("w")).where("w is not null").distinct().limit(lexicon + 1).collect()]
    if len(words) > lexicon:
        raise ValueError(f"a list of common words has at most {lexicon} words")
    common = frozenset(words)

    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            # Long texts are taken in smaller parts, so that the arrays of a part stay small.
            for part in _parts(pdf):
                counts, chars = _shares_of(list(part["text"]), common)
                total = chars.sum(axis=1)
                # Arrow takes what is no number for null.
                share = np.where(total[:, None] > 0, chars / np.maximum(total, 1)[:, None], np.nan)
                out = pd.DataFrame(share, columns=list(LABELS))
                out.insert(0, "n_lines", counts)
                out.insert(0, "doc_id", part["doc_id"].to_numpy())
                yield out

    docs = documents.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return map_batches(docs, shares, f"doc_id {ids}, n_lines long, prose double, list double, table double, junk double").distinct()


def not_prose(documents: DataFrame, common_words: DataFrame, **options) -> DataFrame:
    """(doc_id, form): documents of which most characters are not natural prose; ``form`` is the label
    with the largest share (junk before table before list at equal shares)."""
    s = label_shares(documents, common_words, **options)
    top = F.greatest("list", "table", "junk")
    form = F.when(F.col("junk") == top, "junk").when(F.col("table") == top, "table").otherwise("list")
    return s.where(F.col("prose") < 1 - MOST).select("doc_id", form.alias("form"))


def text_statistics(documents: DataFrame, common_words: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document row: words, mean word length, symbol ratio, lines, share of lines that end in
    punctuation, share of common words.

    Words are runs of letters and digits in lower case; symbols are characters that are neither letters,
    digits nor blanks; blank lines do not count. All native, in the scan. Null texts count as empty;
    ratios of nothing are null. The word list is a literal of the plan, so it must be a short one.
    """
    words = sorted({r[0] for r in common_words.select(F.lower("word")).distinct().limit(5001).collect() if r[0]})
    if len(words) > 5000:
        raise ValueError("a list of common words has at most 5000 words")
    t = F.coalesce(F.col(text), F.lit(""))
    staged = documents.select(
        F.col(doc_id).alias("doc_id"),
        F.length(t).alias("n_chars"),
        F.regexp_extract_all(F.lower(t), F.lit(r"[\p{L}\p{N}]+"), 0).alias("w"),
        F.filter(F.split(t, "\n"), lambda x: F.trim(x) != "").alias("l"),
        F.length(F.regexp_replace(t, r"[\p{L}\p{N}\s]", "")).alias("n_symbols"),
    )
    ratio = lambda a, b: F.round(a / F.nullif(b, F.lit(0)), 6)
    n_words, n_lines = F.size("w"), F.size("l")
    return staged.select(
        "doc_id", "n_chars", n_words.alias("n_words"),
        ratio(F.aggregate("w", F.lit(0), lambda a, x: a + F.length(x)), n_words).alias("mean_word_length"),
        ratio(F.col("n_symbols"), F.col("n_chars")).alias("symbol_ratio"),
        n_lines.alias("n_lines"),
        ratio(F.size(F.filter("l", lambda x: F.rtrim(x).rlike(r"[.!?]$"))), n_lines).alias("ended_lines"),
        ratio(F.size(F.filter("w", lambda x: x.isin(*words))), n_words).alias("common_share"),
    )
