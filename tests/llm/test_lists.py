"""Inverted lists that are cut into parts, texts longer than a sketch, link counts, mixed texts and reliability."""

import random

import pytest
from pyspark.sql import functions as F

from sievemill.llm import reposts
from sievemill.llm.leak import WuManber, words_of
from sievemill.llm.mix import mixed, mixed_texts, mixing_rates
from sievemill.llm.reposts import alike_texts, linked_openings
from sievemill.llm.survivor import source_reliability, truth_discovery


def _pieces(t):
    return {t[i : i + 3] for i in range(len(t) - 2)}


def _alike(a, b):
    x, y = _pieces(a), _pieces(b)
    return bool(x | y) and len(x & y) / len(x | y) >= 0.7


@pytest.mark.parametrize(("large", "part"), [(10_000, 10_000), (2, 3)])
def test_one_block_of_short_and_long_texts(spark, monkeypatch, large, part):
    monkeypatch.setattr(reposts, "LARGE", large)
    monkeypatch.setattr(reposts, "PART", part)
    draw = random.Random(3)
    words = "senior data engineer platform growth tools billing insights machine learning operations support".split()
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 40))) for _ in range(60)]
    texts += [t[:i] + draw.choice("xyz") + t[i:] for t in texts for i in (draw.randrange(len(t)),)] + ["vp", "", "qa", "東京電力株式会社", "東京電力株式会社様"]
    got = {tuple(sorted((r["text_a"], r["text_b"]))) for r in alike_texts(spark.createDataFrame([("b", t) for t in texts], "b string, x string"), "b", "x", "x").collect()}
    distinct = sorted(set(texts))
    assert got == {(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if _alike(a, b)}


def test_links_are_counted(spark):
    rows = [("1", "Data Engineer Billing"), ("2", "data engineer, billing"), ("3", "Data Engineer Billing!"), ("4", "Data Engineers Billing"), ("5", "Actuary"), ("6", "VP"), ("7", "vp"), ("8", " ")]
    jobs = spark.createDataFrame([(i, t, "Xado Ybro Foods", "Remote") for i, t in rows], "id string, title string, company string, location string")
    places = spark.createDataFrame([], "place_id int, city string, region_code string, region string, country_code string, country string")
    got = {tuple(r) for r in linked_openings(jobs, spark.createDataFrame([], "company string"), places).collect()}
    assert got == {("1", "1", 3), ("2", "1", 3), ("3", "1", 3), ("4", "1", 3), ("6", "6", 1), ("7", "6", 1)}


def test_mixed_texts_are_the_copies(spark):
    docs = spark.createDataFrame([(i, f"text number {i} " * (i % 5), "web" if i % 3 else "Book Shop") for i in range(60)] + [(90, None, "web"), (91, "x", None), (92, "x", "other")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("web", 0.5, 3), ("book-shop", 0.25, 9), (" Book  Shop", 0.25, 4), ("web", 0.5, 3), ("absent", 0.1, None)], "source string, target_share double, max_repeats int")
    copies = {(r["doc_id"], r["mix_source"], r["copy_no"]) for r in mixed(docs, targets).collect()}
    told = mixed_texts(docs, targets).collect()
    assert {(r["doc_id"], r["mix_source"], r["copy_no"]) for r in told} == copies and len(told) == len(copies) > 0
    assert all(r["text"] == f"text number {r['doc_id']} " * (r["doc_id"] % 5) for r in told)
    rates = {r["mix_source"]: (r["target_share"], r["max_repeats"]) for r in mixing_rates(spark.createDataFrame([("web", 5)], "mix_source string, tokens bigint"), targets).collect()}
    assert rates == {"web": (0.5, 3), "book_shop": (0.5, 4), "absent": (0.1, None)}


def test_careless_sources_are_outvoted(spark):
    """Planted: three careless sources are wrong together in some objects, where they are the majority; two are careful."""
    draw = random.Random(7)
    rows, truth = [], {}
    for o in range(200):
        truth[o] = f"v{draw.randrange(9)}"
        together = draw.random() < 0.15
        rows += [(o, "title", truth[o], s) for s in ("careful", "exact")]
        rows += [(o, "title", "a wrong one" if together else f"{s} {o}" if draw.random() < 0.4 else truth[o], s) for s in ("bad1", "bad2", "bad3")]
    claims = spark.createDataFrame(rows + [(0, "title", None, "exact"), (None, "title", "v", "exact")], "object int, field string, value string, source string")
    votes = {}
    for o, _, v, _ in rows:
        votes.setdefault(o, []).append(v)
    assert sum(max(set(v), key=v.count) == truth[o] for o, v in votes.items()) < 0.92 * len(truth)
    got = {r["object"]: r["value"] for r in truth_discovery(claims).collect()}
    assert sum(got[o] == v for o, v in truth.items()) >= 0.99 * len(truth)
    weights = {r["source"]: r for r in source_reliability(claims).collect()}
    assert all(r["at_rest"] and r["rounds"] >= 2 for r in weights.values())
    assert min(weights[s]["weight"] for s in ("careful", "exact")) > max(weights[s]["weight"] for s in ("bad1", "bad2", "bad3"))
    with pytest.warns(UserWarning, match="still move"):
        assert not source_reliability(claims, rounds=1).first()["at_rest"]


def test_equal_windows_of_many_items():
    text = " ".join(f"w{i}" for i in range(30))
    items = [(k, text) for k in range(5)] + [(9, text.replace("w3 ", "w3x ")), (10, "too short")]
    machine = WuManber(items)
    assert machine.search(words_of("a b " + text + " c")) == {0, 1, 2, 3, 4, 9}
    assert machine.search(words_of(" ".join(f"w{i}" for i in range(12)))) == {0, 1, 2, 3, 4}
    assert machine.search(words_of(" ".join(f"w{i}" for i in range(11)))) == set() == machine.search([])


def test_hot_keys_are_found_in_one_pass(spark):
    from sievemill.operators.skew import hot_hashes

    rows = spark.createDataFrame([("hot",)] * 60 + [(f"k{i}",) for i in range(40)] + [(None,)] * 50, "k string")
    want = {r[0] for r in rows.where("k = 'hot'").select(F.xxhash64("k")).distinct().collect()}
    assert set(hot_hashes(rows, F.col("k"), 5)) == want and hot_hashes(rows.limit(0), F.col("k"), 5) == []
