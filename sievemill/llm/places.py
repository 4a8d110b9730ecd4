"""Free-typed locations mapped to the listed places they name."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievemill.operators.skew import salted_join
from sievemill.session import cut, map_batches

#: Slips allowed in a word of at least so many letters.
SLIPS = ((7, 2), (5, 1))
#: Letters of the longest word that meets others by its forms less letters; longer ones meet by their pieces.
LONGEST = 24
# Short forms of words in place names, and other names of countries by code.
SHORT = {"mt": "mount", "ft": "fort", "st": "saint", "lk": "lake", "n": "north", "s": "south", "e": "east", "w": "west", "pt": "port", "ste": "sainte"}
COUNTRY_NAMES = {
    "US": "usa us u s america", "GB": "uk gb great britain", "DE": "de deutschland ger", "FR": "fr", "ES": "es espana", "IN": "in", "CA": "ca", "AU": "au", "NL": "nl holland",
    "CH": "ch schweiz suisse", "AT": "at osterreich", "IT": "it italia", "BR": "br brasil", "PL": "pl polska", "DK": "dk danmark", "SE": "se sverige", "NO": "no norge", "FI": "fi suomi", "AE": "ae uae",
    "IE": "ie eire", "JP": "jp nippon", "MX": "mx", "NZ": "nz", "ZA": "za rsa", "KR": "kr", "CN": "cn prc", "SG": "sg",
}
_FOLD_FROM = "".join(chr(c) for c in range(0xC0, 0x250) if len(unicodedata.normalize("NFD", chr(c))) > 1)
_FOLD_TO = "".join(unicodedata.normalize("NFD", c)[0] for c in _FOLD_FROM)
# Letters that no decomposition turns into plain ones.
_STROKES = ("łŁøØđĐıħĦŧŦ", "lLoOdDihHtT")
_LETTERS = {"ß": "ss", "æ": "ae", "Æ": "Ae", "œ": "oe", "Œ": "Oe", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D"}
#: A word: letters and digits of any script.
WORD = r"[\p{L}\p{N}]+"


def fold(c: Column) -> Column:
    """Text without accents, and with plain letters for those with strokes and joined ones."""
    out = F.regexp_replace(F.translate(c, _FOLD_FROM + _STROKES[0], _FOLD_TO + _STROKES[1]), r"\p{M}", "")
    for letter, plain in _LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(plain))
    return out


def osa(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; most + 1 if more."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            new.append(v)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


def _allowed(length: Column) -> Column:
    out = F.lit(0)
    for letters, slips in reversed(SLIPS):
        out = F.when(length >= letters, slips).otherwise(out)
    return out


def _without(words: DataFrame, column: str) -> DataFrame:
    """Each word with its forms less none, one and two letters; two words within two slips share a form."""
    one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    first = F.array_distinct(F.concat(F.array(column), one(F.col(column))))
    step = words.withColumn("__one", first)
    two = F.array_distinct(F.flatten(F.transform("__one", lambda w: F.concat(F.array(w), one(w)))))
    # No array is empty; the outer form keeps the optimizer from computing it once more for a test of its length.
    return step.withColumn("form", F.explode_outer(two)).drop("__one")


def _pieces_of_words(words: DataFrame, column: str) -> DataFrame:
    """Long words cut into five pieces, by length, number and piece: two slips leave one of them whole."""
    n = F.length(column)
    piece = lambda i: F.concat_ws("|", n, i, F.substring(F.col(column), F.floor(i * n / 5).cast("int") + 1, (F.floor((i + 1) * n / 5) - F.floor(i * n / 5)).cast("int")))
    return words.select(column, F.explode_outer(F.transform(F.sequence(F.lit(0), F.lit(4)), piece)).alias("form"))


def _pieces_of_tokens(tokens: DataFrame, column: str) -> DataFrame:
    """The pieces that words within two slips of a long token may have, up to two letters off their place."""
    each = F.array(*[F.lit(k) for k in range(-2, 3)])
    of_length = tokens.select(column, F.explode_outer(F.transform(each, lambda k: F.length(column) + k)).alias("n"))
    moved = of_length.select(column, "n", F.explode_outer(F.sequence(F.lit(0), F.lit(4))).alias("i")).select(column, "n", "i", F.explode_outer(each).alias("by"))
    start = F.floor(F.col("i") * F.col("n") / 5).cast("int") + 1
    size = (F.floor((F.col("i") + 1) * F.col("n") / 5) - F.floor(F.col("i") * F.col("n") / 5)).cast("int")
    return moved.where(start + F.col("by") >= 1).select(column, F.concat_ws("|", "n", "i", F.substring(F.col(column), start + F.col("by"), size)).alias("form"))


def repaired_tokens(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(token, word, sim): each distinct token with the words of the vocabulary within its allowed slips.

    Both sides meet on their forms with up to two letters left out, longer ones on pieces of which two slips
    leave one whole: equality joins that miss no pair within two slips. The distance is then computed. A
    token that is a word itself, or nothing but digits, is not repaired.
    """
    longest = vocabulary.agg(F.max(F.length("word"))).first()[0] or 0
    exact = tokens.join(vocabulary, F.col("token") == F.col("word")).select("token", "word", F.lit(1.0).alias("sim"))
    slipped = tokens.join(exact.select("token"), "token", "left_anti").where(F.length("token").between(SLIPS[-1][0] - 1, longest + 2)).where(F.col("token").rlike(r"\p{L}"))
    words = vocabulary.where(F.length("word") >= SLIPS[-1][0])
    short = lambda df, c, most: df.where(F.length(c) <= most)
    near = _without(short(slipped, "token", LONGEST + 2), "token").join(_without(short(words, "word", LONGEST), "word"), "form").select("token", "word")
    if longest > LONGEST:
        cut_up = _pieces_of_tokens(slipped.where(F.length("token") > LONGEST - 2), "token")
        near = near.unionByName(cut_up.join(_pieces_of_words(words.where(F.length("word") > LONGEST), "word"), "form").select("token", "word"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(d=[osa(a, b, 2) for a, b in zip(pdf["token"], pdf["word"], strict=True)])

    found = map_batches(near.distinct(), measure, "token string, word string, d int").where(F.col("d") <= _allowed(F.length("word")))
    return exact.unionByName(found.select("token", "word", (1 - F.col("d") / F.greatest(F.length("token"), F.length("word"))).alias("sim")))


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), 0)


def _terms(places: DataFrame) -> DataFrame:
    """(term, code, country_code, region_code): the names and codes of regions and countries."""
    r = places.select("region", "region_code", "country_code", "country").distinct()
    words = lambda c: F.array_join(_words(F.lower(fold(F.col(c)))), " ")
    none = F.lit(None).cast("string")
    named = r.select(words("region").alias("term"), F.lit(False).alias("code"), "country_code", "region_code")
    coded = r.select(F.lower("region_code").alias("term"), F.lit(True).alias("code"), "country_code", "region_code")
    countries = r.select(words("country").alias("term"), F.lit(False).alias("code"), "country_code", none.alias("region_code"))
    other = F.create_map(*[F.lit(x) for kv in COUNTRY_NAMES.items() for x in kv])
    codes = F.split(F.concat_ws(" ", F.lower("country_code"), F.try_element_at(other, F.col("country_code"))), " ")
    short = r.select(F.explode(codes).alias("term"), F.lit(True).alias("code"), "country_code", none.alias("region_code")).where(F.length("term") > 1)
    return named.unionByName(coded).unionByName(countries).unionByName(short).where("term <> ''").distinct()


def named_places(locations: DataFrame, places: DataFrame, *, column: str = "location") -> DataFrame:
    """(location, place_ids): the places each distinct non-blank location names; an empty list for none.

    Each distinct token is repaired against the words of the cities; the repaired tokens, and the regions
    and countries stated, rank the listed places by soft TF-IDF for each mention of a city. A place counts
    if the words that tell its city apart are met, and if no other region or country is stated instead.
    Equal scores (a city name of two regions with neither stated) all count.
    """
    blank = r"^[\s ]*$"
    distinct = locations.select(F.col(column).alias("location")).where(F.col("location").isNotNull() & ~F.col("location").rlike(blank)).distinct()
    # A number stands for the text from here on, so that long texts are not repeated for their words.
    loc = cut(distinct.withColumn("lid", F.monotonically_increasing_id()))
    raw = _words(fold("location"))
    short = F.create_map(*[F.lit(x) for kv in SHORT.items() for x in kv])
    listed = places.where("place_id is not null and city is not null").dropDuplicates(["place_id"])
    city_words = F.transform(_words(F.lower(fold(F.col("city")))), lambda w: F.coalesce(F.try_element_at(short, w), w))
    entry = listed.withColumn("word", F.explode(F.array_distinct(city_words)))
    # The number of places, and the words of the longest name of a region or country.
    long_name = F.greatest(*[F.size(_words(F.coalesce(c, F.lit("")))) for c in ("region", "country")], F.lit(1))
    total, gram = listed.agg(F.count(F.lit(1)), F.coalesce(F.max(long_name), F.lit(1))).first()
    # The frequency of a word over cities, not rows, so a name of two regions stays distinctive.
    frequency = entry.groupBy("word").agg(F.count_distinct(F.lower("city")).alias("df")).select("word", "df", F.log(1 + F.lit(total) / F.col("df")).alias("idf"))
    of_place = Window.partitionBy("place_id")
    measured = entry.join(frequency, "word").select("place_id", "word", "idf", "region_code", "country_code", F.max("idf").over(of_place).alias("top"), F.sum(F.col("idf") * F.col("idf")).over(of_place).alias("norm2"))
    words = cut(measured)
    vocabulary = words.select("word").distinct()

    tokens = loc.select("lid", F.posexplode(raw).alias("pos", "raw")).withColumn("low", F.lower("raw"))
    tokens = tokens.withColumn("token", F.coalesce(F.try_element_at(short, F.col("low")), F.col("low")))
    repairs = repaired_tokens(tokens.select("token").distinct(), vocabulary)
    hits = tokens.select("lid", "pos", "token").join(repairs, "token").join(words, "word")

    # Regions and countries stated: names as they are, codes in capitals, or at the end where all is of one case.
    one_case = (F.col("location") == F.lower("location")) | (F.col("location") == F.upper("location"))
    split = loc.select("lid", one_case.alias("one_case"), raw.alias("raw")).where(F.size("raw") > 0)
    starts = F.sequence(F.lit(0), F.size("raw") - 1)
    here = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(gram), F.size("raw") - i)), lambda k: F.struct(F.array_join(F.slice("raw", i + 1, k), " ").alias("gram"), (i >= F.size("raw") - 1).alias("last")))
    grams = split.select("lid", "one_case", F.explode_outer(F.flatten(F.transform(starts, here))).alias("g")).select("lid", "one_case", "g.*")
    stated = (
        grams.withColumn("term", F.lower("gram"))
        .join(_terms(listed), "term")
        .where(~F.col("code") | F.when(F.col("one_case"), F.col("last")).otherwise(F.col("gram") == F.upper("gram")))
        .groupBy("lid")
        .agg(
            F.collect_set(F.when(F.col("region_code").isNotNull(), F.concat_ws("/", "country_code", "region_code"))).alias("regions"),
            F.collect_set(F.when(F.col("region_code").isNull(), F.col("country_code"))).alias("countries"),
        )
    )
    ranked = hits.join(stated, "lid", "left").withColumns({"regions": F.coalesce("regions", F.array().cast("array<string>")), "countries": F.coalesce("countries", F.array().cast("array<string>"))})
    in_region = F.array_contains("regions", F.concat_ws("/", "country_code", "region_code"))
    in_country = F.array_contains("countries", F.col("country_code"))
    other = F.when(F.size("regions") > 0, ~in_region).otherwise((F.size("countries") > 0) & ~in_country)
    # A lone code may mean a region as well as a country: the place's own country by that code is no contradiction.
    same_code = F.exists("regions", lambda r: F.lower(F.substring_index(r, "/", -1)) == F.lower(F.col("country_code")))
    elsewhere = other & ~((F.size("regions") == 1) & in_country & same_code)
    scored = ranked.withColumns({"in_region": in_region, "in_country": in_country, "elsewhere": elsewhere}).where("not elsewhere")
    # One row a place and mention: the mention is the position of the word that tells the city apart.
    per_word = scored.groupBy("lid", "place_id", "word").agg(F.max("sim").alias("sim"), F.first("idf").alias("idf"), F.first("top").alias("top"), F.first("norm2").alias("norm2"), F.max_by("pos", "sim").alias("pos"), F.first("in_region").alias("in_region"), F.first("in_country").alias("in_country"))
    evidence = F.first("in_region").cast("double") + 0.5 * F.first("in_country").cast("double")
    place_score = (
        per_word.groupBy("lid", "place_id")
        .agg(
            F.sum(F.col("sim") * F.col("idf") * F.col("idf")).alias("dot"),
            F.max(F.when(F.col("idf") == F.col("top"), F.col("pos"))).alias("mention"),
            evidence.alias("evidence"),
            F.first("norm2").alias("norm2"),
        )
        .where("mention is not null")
        .withColumn("score", F.round(F.col("dot") / F.col("norm2") + F.col("evidence"), 6))
    )
    best = Window.partitionBy("lid", "mention").orderBy(F.desc("score"))
    kept = place_score.withColumn("nth", F.rank().over(best)).where("nth = 1").groupBy("lid").agg(F.sort_array(F.collect_set("place_id")).alias("place_ids"))
    return loc.join(kept, "lid", "left").select("location", F.coalesce("place_ids", F.array().cast("array<int>")).alias("place_ids"))


def posting_places(jobs: DataFrame, places: DataFrame) -> DataFrame:
    """(id, place_id): for each id with a non-blank location each place it names, or -1 for none.

    Places are found once for each distinct location; a location that a large share of all rows has is
    spread over many tasks when they are joined back. Repeated rows give one row; a null id is no record.
    """
    found = cut(named_places(jobs, places).select("location", F.when(F.size("place_ids") > 0, F.col("place_ids")).otherwise(F.array(F.lit(-1))).alias("place_ids")))
    rows = jobs.select("id", "location").where("id is not null and location is not null").distinct()
    return salted_join(rows, found, "location", spread_by="id").select("id", F.explode(F.col("place_ids").cast("array<int>")).alias("place_id")).distinct()
