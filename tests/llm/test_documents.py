"""Leaks, mixtures and quality of texts."""

import random

import pytest
from pyspark.sql import functions as F

from sievemill.llm.leak import WuManber, leaked_passages, words_of
from sievemill.llm.mix import encoding, mixed, mixture_report
from sievemill.llm.quality import label_lines, label_shares, not_prose
from sievemill.session import table
from tests.conftest import SMALL

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def _brute(docs, items, window=12):
    grams = {}
    for i, t in items:
        w = words_of(t)
        for k in range(len(w) - window + 1):
            grams.setdefault(tuple(w[k : k + window]), set()).add(i)
    return {(d, i) for d, t in docs for k in range(len(words_of(t)) - window + 1) for i in grams.get(tuple(words_of(t)[k : k + window]), ())}


def test_search_against_all_positions():
    random.seed(3)
    for window in (2, 3, 12):
        letters = "ab" if window == 12 else "abc"
        items = [(i, " ".join(random.choices(letters, k=random.randint(1, 20)))) for i in range(30)]
        machine = WuManber(items, window)
        for _ in range(100):
            text = " ".join(random.choices(letters, k=random.randint(0, 60)))
            assert machine.search(words_of(text)) == {i for _, i in _brute([(0, text)], items, window)}


def test_leaks(spark):
    passage = "If Marrine hires 437 clerks in September and Gufekli dismisses 551 of them by the second week, how many"
    items = spark.createDataFrame([(1, passage), (2, "too short to leak"), (3, None), (4, ""), (5, passage)], "item_id int, text string")
    docs = [(1, f"<p>X</p> if <b>marrine</b> HIRES 437 clerks, in september: and gufekli dismisses 551 of"), (2, "marrine hires 437 clerks in september and gufekli dismisses 551 of"), (3, None), (4, ""), (1, passage), (None, passage), (6, "a < b " + passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(7))
    for block in (2_000_000, 10):
        got = sorted(tuple(r) for r in leaked_passages(df, items, block_words=block).collect())
        assert got == [(1, 1), (1, 5), (6, 1), (6, 5)]


def test_leaks_of_the_tables(spark):
    docs, items = table(spark, SMALL, "documents"), table(spark, SMALL, "eval_items")
    got = {tuple(r) for r in leaked_passages(docs, items).collect()}
    assert got == _brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()]) and got


def test_mixture(spark):
    docs, targets = table(spark, SMALL.replace("0.001", "0.01"), "documents"), table(spark, SMALL, "mix_targets")
    got = mixed(docs, targets).toPandas()
    enc = encoding(VOCABULARY)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert all(len(enc.encode_ordinary(texts[d])) == t for d, t in zip(got["doc_id"], got["tokens"], strict=True))
    report = {r["source"]: r for r in mixture_report(docs, targets).collect()}
    total = sum(len(enc.encode_ordinary(t)) for t in texts.values() if t)
    for source, r in report.items():
        rows = got[got["mix_source"] == source]
        assert rows["copy_no"].max() <= r["max_repeats"] == {x["source"]: x["max_repeats"] for x in targets.collect()}[source]
        assert rows["tokens"].sum() == r["mixed_tokens"] and r["corpus_tokens"] == total
        assert not rows.duplicated(["doc_id", "copy_no"]).any()
        want = min(r["target_share"] * total, r["max_repeats"] * r["source_tokens"])
        assert abs(r["mixed_tokens"] - want) < 0.25 * want  # a Bernoulli draw of few documents
    assert mixed(docs, targets).exceptAll(mixed(docs.repartition(7), targets)).count() == 0


COMMON = frozenset("the a of to in and for is we you that with on it der die und ist nicht le la et est pour".split())
TEXTS = {
    "prose": ["We build things that people can use without reading the manual. The board meets twice a year and looks at the plan.", "In this role you review what others only describe and you repair it\nThe old process needed a lot of steps and the new one needs a conversation", "<p>It is not a startup and we argue about the plan.</p><p>You will like the work that we do in the team.</p>", "THE OFFICE IS QUIET AND THE CREW NEXT DOOR IS NOT. YOU WILL LIKE IT."],
    "list": ["Requirements\n- batch jobs\n- data entry\n- code review\n- first aid", "<ul><li>data entry</li><li>code review</li><li>cost models</li><li>tax forms</li></ul>", "Forklift Licence · Budget Drafts · Time Sheets · Cost Models · Stock Control · Code Review", "1. schema design\n2. stock control\n3. chart design"],
    "table": ["Place,Posted,Pay,Grade\nOslo NY,2025-01-18,133000,D6\nBonn TX,2025-06-20,95000,C8", "| Place | Pay |Grade |\n| Oslo | 1000 | C1 |\n| Bonn | 2000 | C2 |", "<table><tr><td>Place</td><td>Pay</td><td>Grade</td></tr><tr><td>Oslo</td><td>1</td><td>C</td></tr></table>", "Oslo NY    2025-01-18   133000   D6\nBonn TX    2025-06-20   95000    C8"],
    "junk": ["click here click here click here click here click here click here click here", "2641 2cd2 808a 9d96 a583 67c7 c026 c0c5 7286 abda", "====<<<<>>>>~~~~++++\n####____----^^^^", "var _x=function(e){return n[20]||{};};var _y=function(e){return e[55]||{};};", "Ã©Ã¢â‚¬Å¾ï¿½Ã¢â‚¬ Ã© ðŸâ€™Ã©â€™Â  Å¾ï¿½ Ã©Å¾Ã¢â‚¬", "\n".join(["Apply now"] * 12)],
}


@pytest.mark.parametrize(("label", "text"), [(k, t) for k, ts in TEXTS.items() for t in ts])
def test_labels(label, text):
    size = {}
    for line, found in label_lines(text, COMMON):
        size[found] = size.get(found, 0) + len(line)
    assert max(size, key=size.get) == label


def test_not_prose(spark):
    rows = [(i, t) for i, t in enumerate(t for ts in TEXTS.values() for t in ts)] + [(-1, None), (-2, ""), (-3, " \n "), (0, TEXTS["prose"][0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("prose", F.lit("x"))
    words = spark.createDataFrame([(w,) for w in COMMON] + [(None,)], "word string")
    got = {r["doc_id"]: r["form"] for r in not_prose(docs, words).collect()}
    labels = [k for k, ts in TEXTS.items() for _ in ts]
    assert got == {i: k for i, k in enumerate(labels) if k != "prose"}
    empty = [r for r in label_shares(docs, words).collect() if r["doc_id"] < 0]
    assert len(empty) == 3 and all(r["prose"] is None and r["n_lines"] == 0 for r in empty)
