"""Variant spellings of organisations' names, linked by suffix blocking."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.operators.components import connected_components
from sievemill.operators.skew import salted_join
from sievemill.session import cut, map_batches

#: Suffixes shorter than this are not indexed; of the beginnings of a word those of this length and one more.
SUFFIX = 3
#: Suffixes longer than this are not indexed either, as their names meet under the shorter ones.
LONGEST = 12
#: A key that more than one in so many of the index rows hold is spread over tasks.
COMMON = 64
#: Least ratio of the longest common subsequence, of each word and of all words together.
WORD_RATIO, NAME_RATIO = 0.7, 0.82
#: A last word is a line of business if it ends at least this share of the names, this many in number, after
#: as many different first words, and stands last in at least this share of the names that hold it.
TAIL_SHARE, TAIL_COUNT, TAIL_LAST = 0.005, 5, 0.8
#: Letters are counted in so many slots for a bound of what two names share, up to three a slot.
SLOTS = 21

#: Names of up to so many words are compared in every order, longer ones by an assignment.
FEW = 5

# Words without weight, legal forms, lines of business for those who know them beforehand (the
# queries of this package learn them from the names), and short forms of first names.
NOISE = frozenset("the and und et y of for a an der die das la le el".split())
LEGAL = frozenset(
    "ltd limited llc llp lp inc incorporated gmbh ag sa sas sarl srl spa bv nv ab as oy plc corp corporation co company pty pte kg ug se kk "
    "holding holdings group gruppe worldwide global jobs careers career hiring team".split()
)
LINES = frozenset(
    "mobility technologies technology logistics printing robotics international insurance education energy analytics construction biosciences foods "
    "security services payments consulting laboratories agriculture engineering aviation manufacturing health healthcare software systems solutions "
    "media capital partners ventures pharmaceuticals pharma retail banking finance financial transport automotive chemicals textiles networks studios "
    "entertainment hospitality electronics semiconductors telecom materials mining shipping travel publishing marketing design research".split()
)
SHORT_NAMES = {
    "frederick": "fritz fred freddy freddie", "eleanor": "nell nellie ellie ella nora lenny", "anthony": "tony ant toni", "robert": "bob rob bobby robbie bert", "josephine": "josie jo joey",
    "susannah": "sue susie suzy susan", "richard": "dick rick rich ricky", "theodore": "ted theo teddy", "william": "bill will billy liam willy", "katherine": "kate kathy katie kat kay kit kitty",
    "christopher": "chris kit topher kester", "margaret": "peggy peg maggie mags meg marge margie greta daisy", "alexander": "alex sandy xander al lex sasha alec alick", "elizabeth": "liz beth betty lizzie eliza bess bessie libby lisa elsie",
    "edward": "ed eddie ted ned", "james": "jim jimmy jamie", "john": "jack johnny", "charles": "charlie chuck", "thomas": "tom tommy", "michael": "mike mick", "joseph": "joe joey",
    "benjamin": "ben benny", "samuel": "sam sammy", "daniel": "dan danny", "patricia": "pat patty tricia", "victoria": "vicky tori", "catherine": "kate cathy cat", "henry": "harry hank",
}


@lru_cache(1)
def _first_names() -> dict[str, frozenset[str]]:
    """Each first name or short form with the full names it may stand for."""
    out: dict[str, set[str]] = {}
    for full, short in SHORT_NAMES.items():
        for name in (full, *short.split()):
            out.setdefault(name, set()).add(full)
    return {k: frozenset(v) for k, v in out.items()}


# Letters that no decomposition turns into plain ones.
_STROKES = str.maketrans({"ł": "l", "Ł": "L", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "þ": "th", "Þ": "Th", "ð": "d", "ı": "i"})


def tokens_of(name: str) -> list[str]:
    """Words of a name, of letters and digits of any script, without accents, case, legal forms and words
    without weight; joined words split where the case changes. A comma puts what stands before it last."""
    bare = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
    plain = unicodedata.normalize("NFC", bare).translate(_STROKES)
    plain = re.sub(r"\b(?:[A-Za-z]\.){2,}", lambda m: m.group().replace(".", ""), plain)
    plain = re.sub(r"(?<=[a-z])(?=[A-Z][a-z]{2})", " ", plain).lower()
    plain = re.sub(r"(?<=\w)['’](?=\w)", "", plain)
    head, comma, rest = plain.partition(",")
    words = re.findall(r"[^\W_]+", f"{rest} {head}" if comma and rest.strip() else plain)
    kept = [w for w in words if w not in NOISE and w not in LEGAL]
    return kept or words


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, all of ``a`` in the bits of one number."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _subsequence(short: str, word: str) -> bool:
    at = iter(word)
    return all(c in at for c in short)


def line_of_business(tokens: Sequence[str], lines: frozenset[str]) -> tuple[str, list[str]]:
    """The line of business among the words, by its full, shortened or misspelt form, and the other words."""
    for i in reversed(range(len(tokens))):
        if tokens[i] in lines and len(tokens) > 1:
            return tokens[i], [*tokens[:i], *tokens[i + 1 :]]
    if len(tokens) > 2 or len(tokens) == 2 and len(tokens[-1]) <= 4:
        last = tokens[-1]
        if 2 <= len(last) <= 8:
            fits = [w for w in lines if w[0] == last[0] and len(w) > len(last) and _subsequence(last, w)]
            fits = [w for w in fits if w.startswith(last)] or [w for w in fits if w[-1] == last[-1] or last[-1] == "s"] or fits
            if fits:
                return min(fits, key=lambda w: (len(w), w)), list(tokens[:-1])
        near = [(2 * lcs(last, w) / (len(last) + len(w)), w) for w in lines if abs(len(w) - len(last)) <= 2 and len(w) >= 5]
        best = max(near, default=(0.0, ""))
        if best[0] >= 0.8:
            return best[1], list(tokens[:-1])
    return "", list(tokens)


def _alike(a: str, b: str) -> int | None:
    """Length of the common subsequence of two words that are alike, else None."""
    if a == b:
        return len(a)
    if abs(len(a) - len(b)) > 3 or min(len(a), len(b)) < 4:
        return None
    n = lcs(a, b)
    return n if 2 * n / (len(a) + len(b)) >= WORD_RATIO else None


def _assigned(gain: list[list[int | None]]) -> int | None:
    """The greatest sum of one cell a row and column, without the cells that are None (Hungarian method)."""
    n, far = len(gain), 10**12
    u, v, row_of = [0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        row_of[0], j, least, way, done = i, 0, [far * n] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while row_of[j]:
            done[j], r = True, row_of[j]
            for k in range(1, n + 1):
                if not done[k]:
                    g = gain[r - 1][k - 1]
                    cost = (far if g is None else -g) - u[r] - v[k]
                    if cost < least[k]:
                        least[k], way[k] = cost, j
            to = min((k for k in range(1, n + 1) if not done[k]), key=least.__getitem__)
            step = least[to]
            for k in range(n + 1):
                if done[k]:
                    u[row_of[k]] += step
                    v[k] -= step
                else:
                    least[k] -= step
            j = to
        while j:
            row_of[j] = row_of[way[j]]
            j = way[j]
    cells = [gain[row_of[k] - 1][k - 1] for k in range(1, n + 1)]
    return None if None in cells else sum(cells)


def _matched(a: Sequence[str], b: Sequence[str]) -> str | None:
    """As the orders of few words, by an assignment: 'full' if one without single letters for words is enough."""
    need = round(100 * NAME_RATIO)
    gains, initials = [], []
    for x in a:
        row = [None if (n := _alike(x, y)) is None else 1000 * (200 * n - need * (len(x) + len(y))) + 1 for y in b]
        short = [g if g is not None or min(len(x), len(y)) > 1 or x[0] != y[0] else 0 for g, y in zip(row, b, strict=True)]
        if all(g is None for g in short):
            return None
        gains.append(row)
        initials.append(short)
    # The one that each pair of words counts tells a sum of nothing but initials from one that is just enough.
    for kind, table in (("full", gains), ("initial", initials)):
        best = _assigned(table)
        if best is not None and best > 0:
            return kind
    return None


def same_organisation(a: Sequence[str], b: Sequence[str]) -> str | None:
    """'full' if the words of one name are those of the other, in any order, misspelt or joined; 'initial'
    if a single letter stands for a word; None otherwise. First names may be short forms or be missing."""
    if a and sorted(a) == sorted(b):
        return "full"
    first = _first_names()
    names_a, names_b = [t for t in a if t in first], [t for t in b if t in first]
    if names_a and names_b:
        if not any(first[x] & first[y] for x in names_a for y in names_b):
            return None
        a, b = [t for t in a if t not in names_a], [t for t in b if t not in names_b]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return None
    if len(a) == len(b) <= FEW:
        for order in permutations(b):
            common = total = 0
            kind = "full"
            for x, y in zip(a, order, strict=True):
                if x == y:
                    n = len(x)
                elif len(x) == 1 or len(y) == 1:
                    if x[0] != y[0]:
                        break
                    kind, n = "initial", 0
                    continue
                elif (n := _alike(x, y)) is None:
                    break
                common, total = common + 2 * n, total + len(x) + len(y)
            else:
                if total and common / total >= NAME_RATIO:
                    return kind
    elif len(a) == len(b):
        return _matched(a, b)
    if len(b) == len(a) + 1:
        extra = [t for t in b if t in first]
        if extra and len(a) >= 2 and not (set(a) & first.keys()):
            return same_organisation(a, [t for t in b if t != extra[0]])
        for i, j in permutations(range(len(b)), 2):
            joined = [t for k, t in enumerate(b) if k not in (i, j)] + [b[i] + b[j]]
            if len(b[i]) > 2 and len(b[j]) > 2 and len(joined) == len(a) and all((n := _alike(x, y)) is not None and 2 * n / (len(x) + len(y)) >= NAME_RATIO for x, y in zip(sorted(a), sorted(joined), strict=True)):
                return "full"
    return None


def _letters(tokens: Sequence[str]) -> tuple[int, int, int]:
    """Letters of words as bits, up to three a slot; the number of those beyond, and of all."""
    counts, total = [0] * SLOTS, 0
    for t in tokens:
        for c in t:
            counts[ord(c) % SLOTS] += 1
        total += len(t)
    bits = sum((1 << min(n, 3)) - 1 << 3 * i for i, n in enumerate(counts))
    return bits, sum(max(n - 3, 0) for n in counts), total


def _parsed(names: DataFrame) -> DataFrame:
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            tokens = [tokens_of(c) for c in pdf["company"]]
            yield pd.DataFrame({"company": pdf["company"], "tokens": tokens})

    return map_batches(names, parse, "company string, tokens array<string>")


def _tails(parsed: DataFrame) -> frozenset[str]:
    """The lines of business the names themselves show: words that end many names, after many different
    first words, and hardly stand elsewhere; at most 1 / TAIL_SHARE. A shortened form of a commoner one is none."""
    words = parsed.select(F.get("tokens", F.lit(0)).alias("head"), F.size("tokens").alias("n"), F.posexplode("tokens").alias("pos", "w"))
    last = (F.col("n") > 1) & (F.col("pos") == F.col("n") - 1)
    counted = words.groupBy("w").agg(F.count_if(last).alias("n"), F.count(F.lit(1)).alias("all"), F.count_distinct(F.when(last, F.col("head"))).alias("heads"))
    common = (F.col("n") >= TAIL_SHARE * parsed.count()) & (F.col("n") >= TAIL_COUNT) & (F.col("heads") >= TAIL_COUNT) & (F.col("n") >= TAIL_LAST * F.col("all")) & (F.length("w") >= 4)
    found = sorted(counted.where(common).select("w", "n").collect(), key=lambda r: (-r["n"], r["w"]))
    lines: list[str] = []
    for r in found:
        if not any(len(r["w"]) < len(w) and r["w"][0] == w[0] and _subsequence(r["w"], w) for w in lines):
            lines.append(r["w"])
    return frozenset(lines)


#: What a row of the index carries to bound a pair: letters of all words, and of those that are no first names.
_BOUNDS = ("all_bits", "all_over", "all_n", "core_bits", "core_over", "core_n", "open")


def _resolved(parsed: DataFrame, lines: frozenset[str]) -> DataFrame:
    """Line of business and other words of each name, with the bounds of its letters. ``open`` marks names
    that no bound holds for: single letters stand for words, or several first names may be missing."""

    def resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = _first_names()
        for pdf in batches:
            found = [line_of_business(list(t), lines) for t in pdf["tokens"]]
            rows = []
            for company, (line, core) in zip(pdf["company"], found, strict=True):
                given = sum(t in first for t in core)
                rows.append((company, line, core, *_letters(core), *_letters([t for t in core if t not in first]), given > 1 or any(len(t) == 1 for t in core)))
            yield pd.DataFrame(rows, columns=["company", "line", "core", *_BOUNDS])

    kinds = ", ".join(f"{c} {'boolean' if c == 'open' else 'bigint'}" for c in _BOUNDS)
    return map_batches(parsed, resolve, f"company string, line string, core array<string>, {kinds}")


def _may_match() -> Column:
    """Whether two names share letters enough for the least ratio, with or without their first names."""

    def shares(x: str, y: str) -> Column:
        common = F.bit_count(F.col(f"{x}_bits_a").bitwiseAND(F.col(f"{y}_bits_b"))) + F.least(f"{x}_over_a", f"{y}_over_b")
        return 2 * common >= (NAME_RATIO - 1e-9) * (F.col(f"{x}_n_a") + F.col(f"{y}_n_b"))

    return F.col("open_a") | F.col("open_b") | shares("all", "all") | shares("core", "core") | shares("all", "core") | shares("core", "all")


def _candidates(names: DataFrame) -> DataFrame:
    """Pairs of names that share a suffix of a word, or all words, and do not differ in the line of business.

    Every suffix is refined by the line, which loses no pair: names with a line meet those of the same line,
    and names without one meet all. Where the letters of both are known, pairs that share too few of them
    are left out where they meet. Only ids and letters are shuffled until then.
    """
    numbered = cut(names.withColumn("nid", F.monotonically_increasing_id()))
    bounds = [c for c in _BOUNDS if c in names.columns]
    long = F.filter("core", lambda t: F.length(t) >= SUFFIX)
    lean = numbered.select("nid", "line", *bounds, F.when(F.size("core") > 0, F.concat(F.lit("="), F.array_join(F.array_sort("core"), " "))).alias("whole"), long.alias("long"))
    word = lean.select("nid", "line", *bounds, "whole", F.explode_outer(F.array_distinct("long")).alias("word"))
    plain = F.regexp_replace("word", r"(.)\1", "$1")  # a doubled letter is the commonest slip
    n, inner = F.length(plain), SUFFIX + 1
    # What shares a longer suffix shares these too.
    ends = F.transform(F.sequence(F.lit(SUFFIX), F.greatest(F.least(n, F.lit(LONGEST)), F.lit(SUFFIX))), lambda k: F.right(plain, k))
    # Slips near the end of every word hide all suffixes; those of the word's beginnings remain.
    each = F.transform(F.sequence(F.lit(1), n - inner), lambda k: F.substring(plain, k, F.lit(inner)))
    starts = F.when(n <= inner, F.array().cast("array<string>")).when(n <= 512, each).otherwise(F.regexp_extract_all(plain, F.lit(rf"(?=(.{{{inner}}}))"), 1))
    # Words too short for a suffix meet in the name as a whole.
    keys = F.when(F.col("word").isNull(), F.array("whole")).otherwise(F.array_union(F.array_union(ends, starts), F.array("whole")))
    suffix = word.select("nid", "line", *bounds, F.explode_outer(keys).alias("suffix")).where("suffix is not null")
    bare = F.col("line") == ""
    by_line = F.when(~bare, F.concat_ws("|", F.col("suffix"), F.lit("line"), F.col("line")))
    to_all = F.concat_ws("|", F.col("suffix"), F.lit("all"))

    def keyed(side: str, *common: Column) -> DataFrame:
        named = [F.col(c).alias(f"{c}_{side}") for c in ("nid", *bounds)]
        return suffix.select(F.explode_outer(F.array_compact(F.array(*common))).alias("key"), *named)

    both = salted_join(keyed("a", by_line, F.when(bare, to_all)), keyed("b", by_line, to_all), "key", spread_by="nid_a", one_in=COMMON)
    # Only the keys of all are not the same on both sides, so their pairs may come in the other order.
    ordered = F.col("nid_a") < F.col("nid_b")
    one_way = F.endswith("key", F.lit("|all")) & (F.col("nid_a") != F.col("nid_b"))
    fits = both.where((ordered | one_way) & (_may_match() if bounds else F.lit(True)))
    pairs = fits.select(F.least("nid_a", "nid_b").alias("nid_a"), F.greatest("nid_a", "nid_b").alias("nid_b")).distinct()
    side = lambda s: numbered.select(*[F.col(c).alias(f"{c}_{s}") for c in ("nid", "company", "line", "core")])
    told = pairs.join(side("a"), "nid_a").join(side("b"), "nid_b")
    a_first = F.col("company_a") < F.col("company_b")
    return told.select(*[F.when(a_first, F.col(f"{c}_{x}")).otherwise(F.col(f"{c}_{y}")).alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in ("company", "line", "core")])


def _judged(pairs: DataFrame) -> DataFrame:
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = [same_organisation(list(a), list(b)) for a, b in zip(pdf["core_a"], pdf["core_b"], strict=True)]
            yield pdf[["company_a", "company_b", "line_a", "line_b"]].assign(kind=kinds)

    return map_batches(pairs, judge, "company_a string, company_b string, line_a string, line_b string, kind string").where("kind is not null")


def organisations(names: DataFrame, *, column: str = "company", lines: frozenset[str] = LINES) -> DataFrame:
    """(company, organisation): every distinct spelling with one that stands for its organisation.

    ``lines`` are lines of business known beforehand, beside those that the names show. Names are parsed,
    blocked by the suffixes of their words and compared by the ratio of their longest common subsequences.
    Names of different lines of business are different. A name that lacks the line,
    or has a single letter for a word, is linked only where it fits one organisation. Null and blank names
    are left out; a name without letters or digits is linked to nothing.
    """
    distinct = names.select(F.col(column).alias("company")).where(F.trim("company") != "").distinct()
    parsed = cut(_parsed(distinct))
    known = cut(_resolved(parsed, lines | _tails(parsed)))
    judged = cut(_judged(_candidates(known)))
    weak = (F.col("line_a") != F.col("line_b")) | (F.col("kind") == "initial")
    strong = judged.where(~weak)
    groups = connected_components(strong, "company_a", "company_b")
    vague = F.exists("core", lambda t: F.length(t) == 1)
    placed = known.join(groups, F.col("company") == F.col("node"), "left").select("company", F.coalesce("component", "company").alias("part"), vague.cast("int").alias("vague"), (F.col("line") == "").cast("int").alias("bare"))
    # How little a part says: parts of fewer facts lean on parts of more.
    lack = placed.groupBy("part").agg((F.min("vague") + F.min("bare")).alias("lack"))
    labelled = cut(placed.select("company", "part").join(lack, "part"))
    # The weaker links join a name's part to another one only where that is the only choice.
    loose = judged.where(weak)
    ways = F.explode_outer(F.array(F.struct(F.col("company_a").alias("x"), F.col("company_b").alias("y")), F.struct(F.col("company_b").alias("x"), F.col("company_a").alias("y"))))
    side = lambda company, end: labelled.select(F.col("company").alias(company), F.col("part").alias(f"{end}_part"), F.col("lack").alias(f"{end}_lack"))
    sides = loose.select(ways.alias("w")).select("w.*").join(side("x", "from"), "x").join(side("y", "to"), "y")
    leans = sides.where("from_part <> to_part and to_lack < from_lack").select("from_part", "to_part", "to_lack").distinct()
    # Where it leans on a part that lacks nothing, only those count; else those that lack less than it.
    n = F.when(F.min("to_lack") == 0, F.count_if(F.col("to_lack") == 0)).otherwise(F.count(F.lit(1)))
    only = cut(leans.groupBy("from_part").agg(F.min(F.struct("to_lack", "to_part"))["to_part"].alias("to_part"), n.alias("n")).where("n = 1").select("from_part", "to_part"))
    # A part lacks at most two facts, so links are at most two steps long.
    further = only.select(F.col("from_part").alias("to_part"), F.col("to_part").alias("end"))
    ends = only.join(further, "to_part", "left").select(F.col("from_part").alias("part"), F.coalesce("end", "to_part").alias("to_part"))
    return labelled.select("company", "part").join(ends, "part", "left").select("company", F.coalesce("to_part", "part").alias("organisation"))


def spelling_classes(boards: DataFrame, jobs: DataFrame, *, lines: frozenset[str] = LINES) -> DataFrame:
    """(company, organisation, spellings): each stored spelling once, the smallest one of its organisation, and their number."""
    known = cut(organisations(boards.select("company").unionByName(jobs.select("company")), lines=lines))
    heads = known.groupBy("organisation").agg(F.min("company").alias("head"), F.count(F.lit(1)).alias("spellings"))
    return known.join(heads, "organisation").select("company", F.col("head").alias("organisation"), "spellings")


def spelling_pairs(boards: DataFrame, jobs: DataFrame, *, lines: frozenset[str] = LINES) -> DataFrame:
    """(company_a, company_b): two stored spellings of one organisation, the smaller first."""
    known = cut(organisations(boards.select("company").unionByName(jobs.select("company")), lines=lines))
    one, two = known.withColumnRenamed("company", "company_a"), known.withColumnRenamed("company", "company_b")
    return one.join(two, "organisation").where("company_a < company_b").select("company_a", "company_b")
