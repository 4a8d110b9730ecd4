"""Lists of postings gathered by others, as rows of eight fixed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.sources.feeds import first_of, json_at

#: Characters of a description, and postings of one remote list, that are taken.
DESCRIPTION, FIRST = 2000, 100
# Where a list may lie, and the fields of each gatherer.
REPOSITORIES = (
    "data-scientist-jobs data-engineer-jobs ai-engineer-jobs machine-learning-engineer-jobs llm-engineer-jobs data-analyst-jobs analytics-engineer-jobs backend-engineer-jobs "
    "software-engineer-jobs fullstack-engineer-jobs devops-engineer-jobs frontend-engineer-jobs product-manager-jobs data-architect-jobs bi-analyst-jobs research-scientist-jobs"
).split()
PATHS = {
    "remoteok": {"title": ("position",), "company": ("company",), "location": ("location",), "url": ("url",), "published": ("date",)},
    "landedjobs": {"title": ("role", "title"), "company": ("company",), "location": ("location",), "url": ("applyUrl", "url"), "published": ("datePosted",)},
}


def listed(payload: Column, kind: str) -> Column:
    """The items of a payload: the remote list less its first row, which describes it, up to ``FIRST``; the
    other list bare or under 'jobs'. Broken payloads give none."""
    text = F.trim(payload)
    inner = F.when(text.startswith("["), text).otherwise(F.get_json_object(text, "$.jobs"))
    items = F.coalesce(F.from_json(inner, "array<string>"), F.array().cast("array<string>"))
    return F.slice(items, 2, FIRST) if kind == "remoteok" else items


def aggregator_rows(payloads: DataFrame, kind: str, now: Column) -> DataFrame:
    """(title, company, location, url, description, salary, source, published) of the titled items of
    payloads (column ``payload``). Missing fields are ''; a missing date is ``now``."""
    item = F.col("item")
    rows = payloads.select(F.explode(listed(F.col("payload"), kind)).alias("item"))
    field = {name: F.coalesce(first_of(item, paths), F.lit("")) for name, paths in PATHS[kind].items() if name != "published"}
    low, high = json_at(item, "salary_min"), json_at(item, "salary_max")
    if kind == "remoteok":
        salary = F.when(low.isNotNull() & (low != "0"), F.concat(F.lit("$"), low, F.lit("-$"), F.coalesce(high, F.lit("")))).otherwise("")
        field["location"] = F.coalesce(json_at(item, "location"), F.lit("Remote"))
        description = F.regexp_replace(F.coalesce(json_at(item, "description"), F.lit("")), r"<[^>]+>", "")
    else:
        salary = F.coalesce(json_at(item, "salary"), F.lit(""))
        description = F.coalesce(json_at(item, "description"), F.lit(""))
    published = F.coalesce(F.try_to_timestamp(first_of(item, PATHS[kind]["published"])), now)
    return rows.select(*[c.alias(n) for n, c in field.items()], F.substring(description, 1, DESCRIPTION).alias("description"), salary.alias("salary"), F.lit(kind).alias("source"), published.alias("published")).where("title <> ''")
