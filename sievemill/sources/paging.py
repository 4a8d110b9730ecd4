"""Platforms that deliver their postings in pages: declared rules, and a walk over pages, live or recorded."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from sievemill.session import map_batches

#: Gives the page of a view (a search, an order, or '') at an offset or page number; None for none.
Fetch = Callable[[str, str], Any]


@dataclass(frozen=True)
class Paging:
    """How a platform is read. ``step`` is added from ``first`` up to ``last``. A walk of a view ends at its
    number of pages, after ``blank`` empty pages, on a page shorter than ``short``, on one without a new row
    (``fresh``), when the ``total`` is reached or when nothing lies at ``more``. Rows are known by the first
    of ``keys`` that is filled, and come once over all views. ``keep`` and ``drop`` test a field. With
    ``detail`` each row that is kept is completed by a page of its own, read last."""

    size: int
    last: int
    items: str
    first: int = 0
    step: int | None = None
    total: str | None = None
    more: str | None = None
    short: int = 0
    blank: int = 1
    fresh: bool = False
    keys: tuple[str, ...] = ()
    views: tuple[tuple[str, int], ...] = (("", 10_000),)
    keep: tuple[str, str] | None = None
    drop: tuple[tuple[str, Any], ...] = ()
    title: str = "title"
    detail: str | None = None


# Page sizes, ends and field names of the platforms.
PAGING: dict[str, Paging] = {
    "smartrecruiters": Paging(100, 299, "content", total="totalFound", short=100, title="name"),
    "oracle": Paging(25, 149, "items.0.requisitionList", short=25, title="Title"),
    "workday": Paging(20, 10_000, "jobPostings", total="total", keys=("bulletFields.0", "externalPath", "title"), views=(("data", 5), (".net", 2))),
    "icims": Paging(50, 201, "", first=1, short=40, fresh=True, keys=("url",)),
    "hireology": Paging(50, 40, "data", first=1, step=1, total="count", keep=("status", "open"), title="name"),
    "adp": Paging(20, 2000, "jobRequisitions", total="meta.totalNumber", title="requisitionTitle", detail="itemID"),
    "dover": Paging(300, 3000, "results", more="next", drop=(("is_published", False), ("is_sample", True))),
    "ukg": Paging(50, 2000, "opportunities", total="totalCount", title="Title"),
    "successfactors": Paging(10, 99, "jobSearchResult", step=1, total="totalJobs", blank=2, keys=("id",), title="unifiedStandardTitle"),
    "brassring": Paging(50, 30, "Jobs.Job", first=1, step=1, total="JobsCount", keys=("reqid",), views=(("lastupdated desc", 30), ("title asc", 30))),
    "phenom": Paging(10, 2000, "data.jobs", total="totalHits", short=10, keys=("jobId", "reqId")),
    "careerplug": Paging(60, 0, "", keys=("url",), detail="url"),
}


def dig(page: Any, path: str) -> Any:
    """What lies at a dotted path of names and positions; None for nothing."""
    for step in path.split(".") if path else ():
        if isinstance(page, list) and step.isdigit():
            page = page[int(step)] if int(step) < len(page) else None
        else:
            page = page.get(step) if isinstance(page, dict) else None
    return page


def _wanted(rule: Paging, row: Any, title: re.Pattern | None) -> bool:
    if rule.keep and str(dig(row, rule.keep[0]) or "").lower() != rule.keep[1]:
        return False
    if any(dig(row, path) is value for path, value in rule.drop):
        return False
    return title is None or bool(title.search(str(dig(row, rule.title) or "")))


def walk(rule: Paging, fetch: Fetch, title: str | None = None) -> Iterator[Any]:
    """The rows of a board, page by page. ``title`` (a pattern) drops rows before their details are read."""
    wanted, seen = re.compile(title, re.I) if title else None, set()
    step = rule.step or rule.size
    for view, pages in rule.views:
        got = empty = 0
        for n in range(pages):
            at = rule.first + n * step
            page = fetch(view, str(at)) if at <= rule.last else None
            if page is None:
                break
            rows = dig(page, rule.items)
            rows = [r for r in rows if isinstance(r, dict)] if isinstance(rows, list) else []
            if not rows:
                empty += 1
                if empty >= rule.blank:
                    break
                continue
            empty, new = 0, 0
            for row in rows:
                if rule.keys:
                    key = next((str(k) for k in (dig(row, p) for p in rule.keys) if k is not None and k != ""), None)
                    if key is None or key in seen:
                        continue
                    seen.add(key)
                new += 1
                if _wanted(rule, row, wanted):
                    more = fetch("detail", str(dig(row, rule.detail))) if rule.detail else None
                    yield row | more if isinstance(more, dict) else row
            got += len(rows)
            total = dig(page, rule.total) if rule.total else None
            ended = total is not None and str(total).isdigit() and got >= int(total) > 0
            if ended or len(rows) < rule.short or (rule.fresh and not new and n) or (rule.more and not dig(page, rule.more)):
                break


def page_path(root: str, kind: str, token: str, view: str, at: str) -> str:
    """Where the page of a recorded board lies; names are escaped so that they stay one level deep."""
    plain = lambda s: re.sub(r"[^A-Za-z0-9._-]", lambda m: f"%{ord(m.group()):02X}", s) or "_"
    return os.path.join(root, plain(kind), plain(token), plain(view), f"{plain(at)}.json")


def recorded(root: str, kind: str, token: str) -> Fetch:
    """Pages as they were recorded; a page that is not there ends the walk, a broken one raises."""

    def fetch(view: str, at: str) -> Any:
        try:
            with open(page_path(root, kind, token, view, at), encoding="utf-8") as f:
                return json.load(f)
        except FileNotFoundError:
            return None

    return fetch


def read_boards(boards: DataFrame, source: Callable[[str, str], Fetch], *, searches: Sequence[str] | None = None, title: str | None = None) -> DataFrame:
    """(kind, token, company, ok, error, payload): the rows of each board as one JSON list.

    Each task walks the boards of its partition. A board that fails becomes a row that says so; a kind
    without a rule too. ``searches`` and ``title`` are conditions of the caller that the reader takes
    over: which views are asked for, and which titles are worth their details.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for kind, token, company in zip(pdf["kind"], pdf["token"], pdf["company"], strict=True):
                try:
                    rule = PAGING[kind]
                    if searches is not None:
                        rule = replace(rule, views=tuple(v for v in rule.views if v[0] in searches))
                    rows = list(walk(rule, source(kind, token), title))
                    out.append((kind, token, company, True, None, json.dumps(rows, ensure_ascii=False)))
                except (OSError, ValueError, KeyError) as e:
                    out.append((kind, token, company, False, f"{type(e).__name__}: {e}"[:300], None))
            yield pd.DataFrame(out, columns=["kind", "token", "company", "ok", "error", "payload"])

    given = boards.select("kind", "token", "company").where("kind is not null and token is not null")
    return map_batches(given, read, "kind string, token string, company string, ok boolean, error string, payload string")
