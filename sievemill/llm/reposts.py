"""Openings posted again with small edits, found by bottom-k sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from sievemill.llm.names import LINES, organisations
from sievemill.llm.places import named_places
from sievemill.operators.components import connected_components
from sievemill.operators.skew import salted_join
from sievemill.session import cut

#: Least Jaccard likeness of two titles.
ALIKE = 0.7
#: Values a sketch retains for the estimate.
K = 32
#: How far below ``ALIKE`` the estimate of a pair may lie and the pair still be verified. The union sketch of
#: two texts of that likeness shares 0.7 of its values with a deviation of 0.08, so the bound lies five
#: deviations off. Texts that the sketch retains whole need no estimate.
MARGIN = 0.4
#: Slots in which pieces are counted, to index the rare ones first.
SLOTS = 1 << 12
#: Texts of a block from which the inverted lists of its values are split, and the part of a list that one task takes.
LARGE, PART = 10_000, 10_000


def plain_title(c: Column) -> Column:
    """Lower case, each run of characters other than letters and digits as one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{Nd}]+", " "))


def pieces(c: Column, n: int = 3) -> Column:
    """The distinct pieces of ``n`` characters; none for shorter texts. Long texts are cut in one pass."""
    size = F.length(c)
    cut_each = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return F.when(size < n, F.array().cast("array<string>")).otherwise(F.array_distinct(F.when(size <= 512, cut_each).otherwise(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{n}}}))"), 1))))


def text_classes(rows: DataFrame, block: str, text: str, tag: str) -> DataFrame:
    """(block, text, tag): each text of a block once, with its smallest tag; null blocks and texts are left out."""
    return rows.select(F.col(block).alias("block"), F.col(text).alias("text"), F.col(tag).alias("tag")).where("block is not null and text is not null").groupBy("block", "text").agg(F.min("tag").alias("tag"))


def _split_lists(lists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the join of inverted lists, where lists of more than ``PART`` texts are cut into parts: a
    text is in one part on the left and meets every part on the right."""
    large = lists.where(F.col("size") > LARGE).groupBy("value").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > PART)
    parts = large.select("value", F.ceil(F.col("m") / PART).cast("int").alias("parts"))
    cut_up = lists.join(parts, "value", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    left = cut_up.withColumn("part", F.pmod(F.xxhash64("t"), F.col("parts")).cast("int"))
    return left.drop("parts"), cut_up.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")


def alike_texts(texts: DataFrame, block: str, text: str, tag: str, *, alike: float = ALIKE, k: int = K) -> DataFrame:
    """(block, text_a, text_b, tag_a, tag_b), with the smallest tag of each text: distinct texts of one block whose pieces have a Jaccard likeness of ``alike``.

    Texts without pieces (shorter than three characters) are alike to nothing; null blocks and texts are left out.
    """
    return alike_classes(text_classes(texts, block, text, tag), alike=alike, k=k)


def alike_classes(classes: DataFrame, *, alike: float = ALIKE, k: int = K) -> DataFrame:
    """As ``alike_texts`` for (block, text, tag) in which each text stands once in its block.

    One hash serves for all. The k smallest hashes of a text are the sketch it retains. The inverted lists
    hold those hashes of a text that a pair of that likeness cannot miss: in any one order of all hashes
    two such texts share a value among their first n - ceil(alike x n) + 1, and the order taken puts rare
    values first, counted over all texts in a fixed number of slots. Where two texts meet, their sizes,
    the places of the value and a bit for each value bound what they can share. The union of the sketches then estimates the
    likeness of longer texts, whose sketch is not the whole text, and drops what is far off; exact Jaccard
    verifies the rest. Only ids and hashes are shuffled until then, and blocks of one text not at all.
    """
    crowded = classes.groupBy("block").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    usable = classes.where(F.length("text") >= 3).join(crowded, "block")
    largest = Observation()
    each = F.sort_array(F.transform(pieces(F.col("text")), lambda p: F.xxhash64(p)))
    # A bit for each value: where the bits of two texts differ, their values do.
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(h, 20), F.lit(64)).cast("int"))
    bits = F.aggregate("hashes", F.lit(0).cast("bigint"), lambda x, h: x.bitwiseOR(bit(h)))
    hashed = usable.observe(largest, F.max("size").alias("size")).select("block", "text", "tag", "size", F.monotonically_increasing_id().alias("t"), each.alias("hashes"))
    base = cut(hashed.withColumns({"n": F.size("hashes"), "bits": bits}))
    slot = lambda h: F.pmod(h, F.lit(SLOTS)).cast("int")
    counts = dict(map(tuple, base.select(F.explode_outer("hashes").alias("h")).groupBy(slot(F.col("h")).alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()))
    # At most SLOTS numbers: the rank of each slot by its count.
    rank = [0] * SLOTS
    for place, s in enumerate(sorted(range(SLOTS), key=lambda s: (counts.get(s, 0), s))):
        rank[s] = place
    ranks = F.split(F.lit(",".join(map(str, rank))), ",").cast("array<int>")
    below = (1 << 47) - 1
    order = F.sort_array(F.transform("hashes", lambda h: F.shiftleft(F.get(ranks, slot(h)).cast("bigint"), 47).bitwiseOR(h.bitwiseAND(F.lit(below)))))
    n = F.col("n")
    first = F.slice(order, F.lit(1), n - F.ceil(n * F.lit(alike) - 1e-9).cast("int") + 1)
    # The outer form keeps the optimizer from computing the array once more for a test of its length.
    lists = base.select("block", "t", "size", "n", "bits", F.posexplode_outer(first).alias("pos", "piece")).select("t", "n", "pos", "size", "bits", F.xxhash64("block", "piece").alias("value"))
    if (largest.get["size"] or 0) > LARGE:
        left, right = _split_lists(lists)
    else:  # no list is longer than the largest block
        left, right = (lists.withColumn("part", F.lit(0)),) * 2
    side = lambda df, s: df.select("value", "part", *[F.col(c).alias(f"{c}_{s}") for c in ("t", "n", "pos", "bits")])
    sized = (F.col("t_a") < F.col("t_b")) & (F.col("n_a") >= alike * F.col("n_b") - 1e-9) & (F.col("n_b") >= alike * F.col("n_a") - 1e-9)
    reach = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    enough = reach >= (F.col("n_a") + F.col("n_b")) * (alike / (1 + alike)) - 1e-9
    close = F.bit_count(F.col("bits_a").bitwiseXOR(F.col("bits_b"))) <= (F.col("n_a") + F.col("n_b")) * ((1 - alike) / (1 + alike)) + 1e-9
    near = side(left, "a").join(side(right, "b"), ["value", "part"]).where(sized & enough & close).select("t_a", "t_b").distinct()
    # A sketch is kept where it is less than the text.
    sketch = F.when(n > k, F.slice("hashes", 1, k))
    known = lambda s: base.select(*[c.alias(f"{name}_{s}") for name, c in {"t": F.col("t"), "block": F.col("block"), "text": F.col("text"), "tag": F.col("tag"), "n": n, "sketch": sketch}.items()])
    pairs = near.join(known("a"), "t_a").join(known("b"), "t_b").withColumnRenamed("block_a", "block")
    whole = lambda s: F.coalesce(f"sketch_{s}", F.sort_array(F.transform(pieces(F.col(f"text_{s}")), lambda p: F.xxhash64(p))))
    union = F.slice(F.sort_array(F.array_union(whole("a"), whole("b"))), 1, k)
    estimate = F.size(F.array_intersect(F.array_intersect(whole("a"), whole("b")), union)) / F.size(union)
    likely = F.col("sketch_a").isNull() & F.col("sketch_b").isNull() | (estimate >= alike - MARGIN)
    # Each side is cut into pieces once: both / (n_a + n_b - both) >= alike, solved for both.
    both = F.size(F.array_intersect(pieces(F.col("text_a")), pieces(F.col("text_b"))))
    return pairs.where(likely & (both * (1 + alike) >= (F.col("n_a") + F.col("n_b")) * alike - 1e-9)).select("block", "text_a", "text_b", "tag_a", "tag_b")


def _linked(jobs: DataFrame, boards: DataFrame, places: DataFrame, lines: frozenset[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, block, title) of all usable postings, where a block is an organisation at a place; their classes
    (block, text, tag); and the links (tag_a, tag_b) of alike classes."""
    known = organisations(boards.select("company").unionByName(jobs.select("company")), lines=lines)
    rows = jobs.select("id", "company", "location", plain_title(F.col("title")).alias("title")).where("id is not null and company is not null and location is not null and title <> ''")
    located = named_places(jobs, places)
    whole = salted_join(salted_join(rows, known, "company", spread_by="id"), located, "location", spread_by="id")
    listed = F.transform("place_ids", lambda p: F.concat(F.lit("p"), p))
    sites = F.explode(F.when(F.size("place_ids") > 0, listed).otherwise(F.array(F.concat(F.lit("t"), F.col("location")))))
    members = cut(whole.select("id", "organisation", "title", sites.alias("site")).select("id", F.concat_ws("\u0001", "organisation", "site").alias("block"), "title"))
    classes = cut(text_classes(members, "block", "title", "id"))
    return members, classes, alike_classes(classes)


def _components(members: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    heads = classes.select("block", F.col("text").alias("title"), "tag")
    copies = members.join(heads, ["block", "title"]).where("id <> tag").select(F.col("id").alias("a"), F.col("tag").alias("b"))
    return connected_components(copies.unionByName(links.select(F.col("tag_a").alias("a"), F.col("tag_b").alias("b")))).select(F.col("node").alias("id"), F.col("component").alias("opening"))


def openings(jobs: DataFrame, boards: DataFrame, places: DataFrame, *, lines: frozenset[str] = LINES) -> DataFrame:
    """(id, opening): ids of one opening share ``opening``, the smallest of them; only ids that have another.

    Two ids are of one opening if organisation and a place agree (the location text where no listed place
    is named; blank never matches) and titles are alike, or through further such ids. Null companies and
    locations and blank titles match nothing; titles too short for a piece match their equals. Ids of one
    organisation, place and plain title meet through the smallest of them, so copies cost one edge each.
    """
    return _components(*_linked(jobs, boards, places, lines))


def linked_openings(jobs: DataFrame, boards: DataFrame, places: DataFrame, *, lines: frozenset[str] = LINES) -> DataFrame:
    """(id, opening, links): as ``openings``, with the number of other postings each is alike to directly; a
    posting at two common places counts for each."""
    members, classes, links = _linked(jobs, boards, places, lines)
    links = cut(links)
    sizes = members.distinct().groupBy("block", F.col("title").alias("text")).agg(F.count(F.lit(1)).alias("n"))
    both = links.select("block", F.col("text_a").alias("text"), F.col("text_b").alias("other")).unionByName(links.select("block", F.col("text_b").alias("text"), F.col("text_a").alias("other")))
    others = both.join(sizes.select("block", F.col("text").alias("other"), "n"), ["block", "other"]).groupBy("block", "text").agg(F.sum("n").alias("beside"))
    degree = sizes.join(others, ["block", "text"], "left").select("block", F.col("text").alias("title"), (F.col("n") - 1 + F.coalesce("beside", F.lit(0))).alias("links"))
    counted = members.distinct().join(degree, ["block", "title"]).groupBy("id").agg(F.sum("links").alias("links"))
    return _components(members, classes, links).join(counted, "id")


def repost_pairs(jobs: DataFrame, boards: DataFrame, places: DataFrame, *, lines: frozenset[str] = LINES) -> DataFrame:
    """(id_a, id_b): every two different ids of one opening, the smaller first."""
    found = openings(jobs, boards, places, lines=lines)
    return found.select(F.col("id").alias("id_a"), "opening").join(found.select(F.col("id").alias("id_b"), "opening"), "opening").where("id_a < id_b").select("id_a", "id_b")
