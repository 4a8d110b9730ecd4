"""Finding the stated pay in one text: a multi-pattern automaton of unit aliases, and the amounts near them."""

from __future__ import annotations

import re
from bisect import bisect_left
from decimal import Decimal
from functools import lru_cache
from typing import NamedTuple

import ahocorasick

# Spellings of the units of pay_units (lower case, blanks squashed).
ALIASES: dict[tuple[str, str], list[str]] = {
    ("currency", "USD"): ["usd", "us$", "$", "us dollars", "us dollar", "u.s. dollars", "american dollars", "dollars", "dollar"],
    ("currency", "EUR"): ["eur", "€", "euros", "euro"],
    ("currency", "GBP"): ["gbp", "£", "pounds sterling", "pound sterling", "british pounds", "pounds", "pound", "sterling", "quid"],
    ("currency", "CHF"): ["chf", "swiss francs", "swiss franc", "sfr.", "sfr", "fr.", "francs", "franken"],
    ("currency", "CAD"): ["cad", "c$", "ca$", "can$", "cad$", "cdn$", "canadian dollars", "canadian dollar"],
    ("currency", "AUD"): ["aud", "a$", "au$", "aud$", "australian dollars", "australian dollar"],
    ("currency", "SGD"): ["sgd", "s$", "sg$", "sgd$", "singapore dollars", "singapore dollar"],
    ("currency", "JPY"): ["jpy", "¥", "￥", "円", "japanese yen", "yen"],
    ("currency", "INR"): ["inr", "₹", "rs.", "rs", "indian rupees", "rupees", "rupee"],
    ("period", "year"): [
        "per year", "a year", "/year", "/yr", "/y", "per yr", "per annum", "/annum", "p.a.", "p.a", "pa", "annually", "annual", "yearly", "each year",
        "pro jahr", "/jahr", "jährlich", "im jahr", "par an", "/an", "al año", "por año", "anual",
    ],
    ("period", "month"): [
        "per month", "a month", "/month", "/mo", "/mo.", "/mth", "per mo", "monthly", "p.m.", "pcm", "each month",
        "pro monat", "/monat", "monatlich", "im monat", "par mois", "/mois", "al mes", "por mes", "/mes", "mensual",
    ],
    ("period", "week"): ["per week", "a week", "/week", "/wk", "per wk", "weekly", "p.w.", "pw", "each week", "pro woche", "/woche", "wöchentlich", "par semaine"],
    ("period", "day"): ["per day", "a day", "/day", "/d", "daily", "day rate", "per diem", "p.d.", "p/d", "pd", "each day", "pro tag", "/tag", "täglich", "par jour", "/jour", "al día"],
    ("period", "hour"): [
        "per hour", "an hour", "/hour", "/hr", "/h", "per hr", "hourly", "p/h", "p.h.", "ph", "each hour",
        "pro stunde", "/stunde", "/std", "/std.", "stündlich", "par heure", "/heure", "por hora", "/hora",
    ],
    ("scale", "thousand"): ["k", "thousand", "thousands", "tsd", "tsd.", "mille", "mil"],
    ("scale", "lakh"): ["lakh", "lakhs", "lac", "lacs", "l"],
    ("scale", "million"): ["m", "mn", "mio", "mio.", "million", "millions"],
    ("lpa", "lpa"): ["lpa"],
}
#: Aliases that count only right after a number.
_GLUED = {"k", "m", "l", "mn"}
#: Words around a number that make it something other than pay.
_NOT_PAY_BEFORE = re.compile(r"(?:grade|band|level|step|tier|class|stufe|gruppe|tg|eg|top|over|last|age)\s*$")
_NOT_PAY_AFTER = re.compile(r"\s*(?:%|\(k\)|percent|(?:days?|weeks?|months?|years?|hours?|hrs?)\b(?!\s*rate))")
_GROUP = r"[.,'    ’]"
_NUMBER = re.compile(rf"(?<![\w.])(?:\d{{1,3}}(?:{_GROUP}\d{{2,3}})*{_GROUP}\d{{3}}(?!\d)(?:[.,]\d{{1,2}}(?!\d))?|\d+(?:[.,]\d+)?)")
#: Characters between the ends of a range, units included, at most: those of the longest unit on either side.
_NEAR = 80
_BETWEEN = re.compile(r"^\s*(?:-|–|—|−|~|/|to|and|bis|a|à|y|und|et|up to)\s*$")


class Pay(NamedTuple):
    """What a text states: amounts with their scales already named, or units only; ``stated`` is False for no
    pay. ``further`` counts amounts that stand beside the one or the range taken."""

    stated: bool
    low: float | None = None
    high: float | None = None
    low_scale: str | None = None
    high_scale: str | None = None
    currency: str | None = None
    period: str | None = None
    further: int = 0


def aliases_of(kind: str, unit: str) -> list[str]:
    """Spellings of a unit that the fixed list lacks: its own name, for a period with what stands before it."""
    name = " ".join(unit.lower().split())
    return [f"{before}{name}" for before in ("per ", "a ", "an ", "each ", "/")] if kind == "period" else [name]


@lru_cache(8)
def _automaton(more: tuple[tuple[str, str], ...] = ()) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for unit, names in ALIASES.items():
        for name in names:
            machine.add_word(name, (name, *unit))
    for kind, unit in more:
        for name in aliases_of(kind, unit):
            if name and name not in machine:
                machine.add_word(name, (name, kind, unit))
    machine.make_automaton()
    return machine


def _number(text: str) -> Decimal:
    """The value of a number in any grouping: 150,000 / 150 000 / 125'000 / 4.195 / 10,00,000 / 53.50."""
    s = re.sub(r"['    ’]", "", text)
    marks = [c for c in s if c in ".,"]
    if len(set(marks)) == 2:
        last = marks[-1]
        s = s.replace("," if last == "." else ".", "").replace(last, ".")
    elif marks:
        tail = s.rsplit(marks[0], 1)[1]
        grouped = len(tail) == 3 and s[0] != "0"
        s = s.replace(marks[0], "") if grouped or len(marks) > 1 else s.replace(marks[0], ".")
    return Decimal(s)


def _units(low: str, more: tuple[tuple[str, str], ...] = ()) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, unit) from left to right, of matches at one place the longest, on word boundaries."""
    hits = []
    for end, (name, kind, unit) in _automaton(more).iter(low):
        start = end + 1 - len(name)
        before, after = low[start - 1] if start else " ", low[end + 1] if end + 1 < len(low) else " "
        if name in _GLUED:
            if not before.isdigit() and not (before in "  " and start > 1 and low[start - 2].isdigit()):
                continue
            if after.isalnum():
                continue
        else:
            if name[0].isalpha() and before.isalpha():
                continue
            if name[-1].isalpha() and after.isalpha():
                continue
        hits.append((start, end + 1, kind, unit))
    taken: list[tuple[int, int, str, str]] = []
    for h in sorted(hits, key=lambda h: (h[0], -h[1])):
        if not taken or h[0] >= taken[-1][1]:
            taken.append(h)
    return taken


Amount = tuple[int, int, Decimal, str | None]


def _amounts(low: str, units: list[tuple[int, int, str, str]]) -> list[Amount]:
    """Every number that may be an amount: start, end, value and the scale right after it."""
    scales = {s: u for s, _, k, u in units if k in ("scale", "lpa")}
    found: list[Amount] = []
    for m in _NUMBER.finditer(low):
        before = low[max(0, m.start() - 12) : m.start()].rstrip()
        if _NOT_PAY_AFTER.match(low, m.end()) or _NOT_PAY_BEFORE.search(before):
            continue
        scale = scales.get(m.end(), scales.get(m.end() + 1))
        found.append((m.start(), m.end(), _number(m.group()), "lakh" if scale == "lpa" else scale))
    return found


def _ranges(low: str, amounts: list[Amount], units: list[tuple[int, int, str, str]]) -> list[tuple[Amount, Amount | None]]:
    """The amounts one by one, or in pairs where a dash or a word, and nothing else but units, stands between."""
    starts = [u[0] for u in units]
    out: list[tuple[Amount, Amount | None]] = []
    i = 0
    while i < len(amounts):
        first, second = amounts[i], None
        if i + 1 < len(amounts) and amounts[i + 1][0] - first[1] <= _NEAR:
            begin, end = first[1], amounts[i + 1][0]
            gap = low[begin:end]
            inside = units[bisect_left(starts, begin) : bisect_left(starts, end)]
            for s, e, _, _ in reversed([u for u in inside if u[1] <= end]):
                gap = gap[: s - begin] + " " + gap[e - begin :]
            if _BETWEEN.match(gap):
                second = amounts[i + 1]
        out.append((first, second))
        i += 1 if second is None else 2
    return out


def _marked(pay: tuple[Amount, Amount | None], units: list[tuple[int, int, str, str]]) -> bool:
    """Whether a unit stands right beside an amount, a blank aside."""
    edges = {x for a in pay if a for x in (a[0], a[0] - 1)}, {x for a in pay if a for x in (a[1], a[1] + 1)}
    return any(a and a[3] for a in pay) or any(e in edges[0] or s in edges[1] for s, e, _, _ in units)


def read_pay(text: str | None, more: tuple[tuple[str, str], ...] = ()) -> Pay | None:
    """None for blank text; otherwise what it states. ``more``: units (kind, name) beside the listed ones.

    Of several amounts the first one, or the first range, with a unit beside it is taken; without any the
    first; the others are counted in ``further``."""
    if text is None or not text.strip():
        return None
    low = re.sub(r"\s*/\s*", "/", re.sub(r"[\s]+", " ", text.strip())).lower()
    units = _units(low, more)
    ranges = _ranges(low, _amounts(low, units), units)
    currencies = [u for u in units if u[2] == "currency"]
    periods = [u for u in units if u[2] == "period"]
    lakhs = any(k == "lpa" or u == "lakh" for _, _, k, u in units)
    if not (currencies or periods or any(k in ("scale", "lpa") for _, _, k, _ in units)) or not (currencies or periods or lakhs or ranges):
        return Pay(False)
    taken = ranges[0] if len(ranges) == 1 else next((r for r in ranges if _marked(r, units)), ranges[0]) if ranges else None
    near = lambda us: min(us, key=lambda u: min(abs(u[0] - taken[0][1]), abs(taken[0][0] - u[1])) if taken else u[0])[3] if us else None
    currency = near(currencies) or ("INR" if lakhs else "USD")
    period = near(periods) or "year"
    if taken is None:
        if not currencies and not periods:
            return Pay(False)
        scale = next((u for _, _, k, u in units if k == "scale"), None)
        return Pay(True, None, None, scale, scale, currency, period)
    (_, _, a, scale_a), second = taken
    further = sum(1 if r[1] is None else 2 for r in ranges) - (1 if second is None else 2)
    if second is None:
        return Pay(True, float(a), float(a), scale_a, scale_a, currency, period, further)
    _, _, b, scale_b = second
    shared = scale_a or (scale_b if a <= b or not scale_b else None)
    return Pay(True, float(a), float(b), shared, scale_b or (scale_a if b >= a else None), currency, period, further)
