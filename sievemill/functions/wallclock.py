"""Reading one timestamp text: its wall-clock fields, its zone, or its relative label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# English month names by their first three letters, zone abbreviations as minutes east of UTC.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MET": 60, "MEST": 120,
    "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "SGT": 480, "HKT": 480, "JST": 540, "KST": 540, "AWST": 480,
    "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "AST": -240, "ADT": -180,
}

_BLANKS = r"[\s\u00A0\u2007\u202F]+"
_ZONE = r"[A-Z][A-Za-z_]+(?:/[A-Z][A-Za-z_+-]+){1,2}"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s*([AaPp])\.?[Mm]\.?)?"
_TAIL = r"\s*(Z|z|[+-]\d{2}:?\d{2}|[+-]\d{2}|\(?[A-Z]{2,5}\)?|(?:UTC|GMT)\s?[+-]\d{1,2}(?::?\d{2})?)?\s*(?:\[(" + _ZONE + r")\]|\(?(" + _ZONE + r")\)?)?$"
_DAY = r"(?:[A-Za-z]{3,9}\.?,\s*)?"
_ISO = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})"
_DMONY = r"^" + _DAY + r"(\d{1,2})(?:st|nd|rd|th)?[-\s./]+([A-Za-z]{3,9})\.?[-\s,./]+(\d{4}|\d{2})"
_MONDY = r"^" + _DAY + r"([A-Za-z]{3,9})\.?\s+(\d{1,2})(?:st|nd|rd|th)?,?\s+(\d{4})"
_SLASH = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})"
_BASIC = r"^(\d{4})(\d{2})(\d{2})(?:[Tt](\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?)?"

_NOTE_OFFSET = r"\b((?:UTC|GMT)\s?[+-]\d{1,2}(?::?\d{2})?|" + "|".join(sorted((k for k in ABBREVIATIONS if len(k) > 2), key=len, reverse=True)) + r")\b"
_DAY_FIRST = r"(?i)day\s*(?:first|before)|\bd+\s*[/.-]\s*m+\b"
_MONTH_FIRST = r"(?i)month\s*(?:first|before)|\bm+\s*[/.-]\s*d+\b"


def _int(c: Column) -> Column:
    return c.try_cast("int")


def _month(name: Column) -> Column:
    found = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    full = "january february march april may june july august september october november december sept".split()
    known = F.lower(name).isin(*MONTHS, *full)
    return F.when(known & (found > 0), found.cast("int"))


def _offset_minutes(tail: Column) -> Column:
    """Minutes east of UTC of 'Z', '+0530', '+05:30', 'GMT+2' or an abbreviation; null for anything else."""
    clean = F.upper(F.regexp_replace(tail, r"[()\s]", ""))
    part = r"^(?:UTC|GMT)?([+-])(\d{1,2}):?(\d{2})?$"
    sign = F.when(F.regexp_extract(clean, part, 1) == "-", -1).otherwise(1)
    hours, minutes = _int(F.regexp_extract(clean, part, 2)), F.coalesce(_int(F.regexp_extract(clean, part, 3)), F.lit(0))
    named = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.when(clean.rlike(part), F.when((hours <= 18) & (minutes < 60), sign * (hours * 60 + minutes))).otherwise(F.try_element_at(named, clean))


def days_of(year: Column, month: Column, day: Column) -> Column:
    """Days since 1970 of a date that exists, else null; never raises."""
    m = F.greatest(F.lit(1), F.least(F.lit(12), month))
    first = F.make_date(F.greatest(F.lit(1), F.least(F.lit(9999), year)), m, F.lit(1))
    real = year.between(1, 9999) & month.between(1, 12) & day.between(1, F.dayofmonth(F.last_day(first)))
    return F.when(real, F.unix_date(first) + day - 1)


def read_wallclock(rows: DataFrame, value: str, meaning: str) -> DataFrame:
    """Adds what the text in column ``value`` states; extra columns stay.

    ``epoch_us``: the instant, if the value counts seconds, milli-, micro- or nanoseconds since 1970.
    ``local_us``: the wall time as microseconds since 1970-01-01 00:00 of the same clock.
    ``offset_min``: minutes east of UTC where an offset or an abbreviation is given.
    ``zone``: the region's name (the value's before the meaning's); null where neither names one.
    ``days_back``: whole days before the visit, of a relative label.
    All are null where the text states no time or an impossible one. Each stage is a projection of its
    own, so that no pattern is matched twice.
    """
    v, note, f = F.col("__v"), F.col("__note"), F.col("__f")
    clock = r"(?:(?:[Tt]|,?\s+(?:at\s+)?)" + _TIME + r")?"
    rest = "|$4|$5|$6|$7|$8|$9|$10$11"
    layouts = {
        "ymd": (_ISO + clock + _TAIL, "$1|$2|$3" + rest),
        "slash": (_SLASH + clock + _TAIL, "$3|$1|$2" + rest),
        "dmony": (_DMONY + clock + _TAIL, "$3|$2|$1" + rest),
        "mondy": (_MONDY + clock + _TAIL, "$3|$1|$2" + rest),
        "basic": (_BASIC + _TAIL, "$1|$2|$3|$4|$5|$6|$7||$8|$9$10"),
    }
    layout, fields = F.when(v.rlike(r"^\d{9,}$"), "epoch"), F.lit("||||||||||")
    for name, (pattern, order) in layouts.items():
        layout = layout.when(v.rlike(pattern), name)
        fields = F.when(F.col("__kind") == name, F.regexp_replace(v, pattern, order)).otherwise(fields)
    label = r"^(?:posted\s+|published\s+|updated\s+)?(?:about\s+|over\s+)?(\d{1,5}|a|an|one)\+?\s*(day|week)s?\s+ago\.?$"
    part = lambda n: F.get(f, F.lit(n))
    num = lambda n: F.coalesce(_int(part(n)), F.lit(0))

    df = rows.withColumns({"__v": F.trim(F.regexp_replace(value, _BLANKS, " ")), "__note": F.coalesce(F.col(meaning), F.lit(""))})
    df = df.withColumn("__kind", layout)
    df = df.withColumn("__f", F.split(fields, r"\|"))
    # Where nothing tells the order of day and month, the one that gives a date is taken; day first if both do.
    flip = note.rlike(_MONTH_FIRST) | (~note.rlike(_DAY_FIRST) & (num(1) <= 12) & (num(2) > 12))
    year = F.when(F.length(part(0)) == 2, num(0) + F.when(num(0) < 70, 2000).otherwise(1900)).otherwise(num(0))
    named = F.col("__kind").isin("dmony", "mondy")
    df = df.withColumns(
        {
            "__year": year,
            "__flip": F.when(F.col("__kind") == "slash", ~flip).otherwise(F.lit(False)),
            "__month": F.when(named, _month(part(1))).otherwise(num(1)),
            "__day": num(2),
            "__hour": F.when(part(7) == "", F.when(num(3) <= 23, num(3))).when(num(3).between(1, 12), num(3) % 12 + F.when(F.lower(part(7)) == "p", 12).otherwise(0)),
            "__minute": F.when(num(4) <= 59, num(4)),
            "__second": F.when(num(5) <= 59, num(5)),
            "__micro": num_micro(part(6)),
            "__tail": F.nullif(part(8), F.lit("")),
            "__own": F.nullif(part(9), F.lit("")),
            "__note_zone": F.nullif(F.regexp_extract(note, r"\b(" + _ZONE + r")", 1), F.lit("")),
            "__note_tail": F.nullif(F.regexp_extract(note, _NOTE_OFFSET, 1), F.lit("")),
            "__digits": F.when(F.col("__kind") == "epoch", F.when(F.length(v) <= 19, v.try_cast("bigint"))),
            "__fraction": F.when(v.rlike(r"^\d{9,11}\.\d{1,9}$"), v.try_cast("decimal(30,9)")),
            "__back": F.regexp_extract(F.lower(v), label, 1),
            "__unit": F.regexp_extract(F.lower(v), label, 2),
        }
    )
    month = F.when(F.col("__flip"), F.col("__day")).otherwise(F.col("__month"))
    day = F.when(F.col("__flip"), F.col("__month")).otherwise(F.col("__day"))
    df = df.withColumns({"__days": days_of(F.col("__year"), month, day), "__own_offset": _offset_minutes(F.col("__tail")), "__note_offset": _offset_minutes(F.col("__note_tail"))})
    n, digits = F.length(v), F.col("__digits")
    seconds = F.col("__days").cast("bigint") * 86400 + F.col("__hour") * 3600 + F.col("__minute") * 60 + F.col("__second")
    silent = F.col("__own_offset").isNull() & F.col("__own").isNull()
    # 10 digits count seconds, 13 milli-, 16 micro-, 19 nanoseconds.
    epoch = F.when(n <= 11, digits * 1_000_000).when(n <= 14, digits * 1_000).when(n <= 17, digits).otherwise(F.floor(digits / F.lit(1000)).cast("bigint"))
    low = F.lower(v)
    back = (
        F.when(low.rlike(r"^(?:posted\s+|published\s+|updated\s+)?(?:today|just now|just posted)\.?$"), 0)
        .when(low.rlike(r"^(?:posted\s+|published\s+|updated\s+)?yesterday\.?$"), 1)
        .when(F.col("__unit") != "", F.coalesce(_int(F.col("__back")), F.lit(1)) * F.when(F.col("__unit") == "week", 7).otherwise(1))
    )
    df = df.withColumns(
        {
            "epoch_us": F.coalesce((F.col("__fraction") * 1_000_000).cast("bigint"), epoch),
            # A remark after the time that is no zone: not a time.
            "local_us": F.when(F.col("__tail").isNull() | F.col("__own_offset").isNotNull(), seconds * 1_000_000 + F.col("__micro")),
            "offset_min": F.coalesce("__own_offset", F.when(silent & F.col("__note_zone").isNull(), F.col("__note_offset"))),
            "zone": F.when(F.col("__own_offset").isNull(), F.coalesce("__own", F.when(silent, F.col("__note_zone")))),
            "days_back": back.cast("int"),
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith("__") and c not in rows.columns])


def num_micro(digits: Column) -> Column:
    """The fraction of a second as microseconds; what is finer is cut."""
    return F.when(digits == "", F.lit(0)).otherwise(_int(F.rpad(F.substring(digits, 1, 6), 6, "0")))
