"""Near-duplicates by sketches against brute force."""

import random
import re

from sievemill.llm.reposts import alike_texts, repost_pairs

random.seed(9)
WORDS = "senior junior lead data backend platform engineer developer analyst payments growth tools insights operations machine learning support billing".split()


def _pieces(t):
    return {t[i : i + 3] for i in range(len(t) - 2)}


def _alike(a, b):
    x, y = _pieces(a), _pieces(b)
    return bool(x | y) and len(x & y) / len(x | y) >= 0.7


def test_alike_texts_against_all_pairs(spark):
    texts = [" ".join(random.choices(WORDS, k=random.randint(1, 9))) for _ in range(250)]
    texts += [t + " " + random.choice(WORDS) for t in texts[:80]] + ["", "ab", "abc", "abc"]
    rows = [(str(i % 3), t) for i, t in enumerate(texts)] + [(None, "x y z"), ("1", None)]
    got = {(r["block"], *sorted((r["text_a"], r["text_b"]))) for r in alike_texts(spark.createDataFrame(rows, "b string, x string"), "b", "x", "x").collect()}
    by = {}
    for b, t in rows:
        if b is not None and t is not None:
            by.setdefault(b, set()).add(t)
    want = {(b, *sorted((x, y))) for b, ts in by.items() for x in ts for y in ts if x < y and _alike(x, y)}
    assert got == want


def test_repost_pairs(spark):
    titles = {"1": "Senior Data Engineer - Billing", "2": "senior data engineer, billing!", "3": "Senior Data Engineer (Billing) NEW", "4": "Actuary", "5": "Senior Data Engineer - Billing", "6": "Senior Data Engineer - Billing", "7": "Senior Data Engineer - Billing", "8": "Senior Data Engineer - Billing"}
    where = {"1": ("Xado Ybro Foods", "Lannowick, NY"), "2": ("Xado Ybro Fds", "Lannowick, New York"), "3": ("Xado Ybro Foods", "Lanowick, NY"), "4": ("Xado Ybro Foods", "Lannowick, NY"), "5": ("Xado Ybro Foods", "Remote"), "6": ("Xado Ybro Foods", "Remote"), "7": ("Zedu Webre Foods", "Lannowick, NY"), "8": ("Xado Ybro Foods", " ")}
    jobs = spark.createDataFrame([(i, t, *where[i]) for i, t in titles.items()] * 2 + [(None, "x", "Xado Ybro Foods", "Remote")], "id string, title string, company string, location string")
    places = spark.createDataFrame([(1, "Lannowick", "NY", "New York", "US", "United States")], "place_id int, city string, region_code string, region string, country_code string, country string")
    got = {tuple(r) for r in repost_pairs(jobs, spark.createDataFrame([], "company string"), places).collect()}
    norm = {i: re.sub(r"[^a-z0-9]+", " ", t.lower()).strip() for i, t in titles.items()}
    assert _alike(norm["1"], norm["3"])
    assert got == {("1", "2"), ("1", "3"), ("2", "3"), ("5", "6")}
