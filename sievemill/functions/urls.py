"""Boards and their addresses."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where the platforms keep their boards; {} is the token.
HOSTED = {
    "greenhouse": "https://job-boards.greenhouse.io/{}", "lever": "https://jobs.lever.co/{}", "ashby": "https://jobs.ashbyhq.com/{}",
    "smartrecruiters": "https://jobs.smartrecruiters.com/{}", "workable": "https://apply.workable.com/{}", "jobvite": "https://jobs.jobvite.com/{}",
    "rippling": "https://ats.rippling.com/{}/jobs", "recruitee": "https://{}.recruitee.com/", "breezy": "https://{}.breezy.hr/",
    "bamboohr": "https://{}.bamboohr.com/careers/", "teamtailor": "https://{}.teamtailor.com/", "personio": "https://{}.jobs.personio.com/",
    "pinpoint": "https://{}.pinpointhq.com/", "jazzhr": "https://{}.applytojob.com/apply",
}
PATH_HOSTS = {
    "boards.greenhouse.io": "greenhouse", "job-boards.greenhouse.io": "greenhouse", "jobs.lever.co": "lever", "jobs.ashbyhq.com": "ashby",
    "jobs.smartrecruiters.com": "smartrecruiters", "apply.workable.com": "workable", "jobs.jobvite.com": "jobvite", "ats.rippling.com": "rippling",
}
SUFFIX_HOSTS = {
    ".applytojob.com": "jazzhr", ".pinpointhq.com": "pinpoint", ".recruitee.com": "recruitee", ".breezy.hr": "breezy", ".bamboohr.com": "bamboohr",
    ".teamtailor.com": "teamtailor", ".jobs.personio.com": "personio", ".jobs.personio.de": "personio",
}
# Path segments and labels that are no board, so that the same tokens are refused.
RESERVED = "www api en us jobs careers login signup about help support static assets embed search company companies job apply home index".split()
# Platforms whose tokens hold a slash, and those whose tokens are addresses.
LONG_TOKENS = ("workday", "oracle", "icims")
URL_TOKENS = ("careerpage", "successfactors")
#: Files that every site has and that are no board.
_SITE_FILES = r"(?i)/(?:robots\.txt|sitemap(?:_index)?\.xml|favicon\.ico|manifest\.json)$"
#: The characters at which an address in running text ends, blanks aside.
URL_ENDS = "\"'<>)]}"
URL = rf"https?://[^\s{re.escape(URL_ENDS)}]+"


def host_of(url: Column) -> Column:
    """The host in lower case, '' for none. A pattern, as Java's parser refuses hosts with underscores."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)^https?://[^/?#]*([^?#]*)", 1)


def board_key(kind: Column, token: Column) -> Column:
    return F.concat_ws(":", kind, F.lower(F.coalesce(token, F.lit(""))))


def quoted(c: Column) -> Column:
    """Percent-encoding with blanks as %20 and slashes kept."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def board_url(kind: Column, token: Column) -> Column:
    """The address of a board; null for unknown platforms."""
    slug, host, site = quoted(token), F.split_part(token, F.lit("/"), F.lit(1)), F.split_part(token, F.lit("/"), F.lit(2))
    out = F.when(kind == "workday", F.concat(F.lit("https://"), token)).when(kind == "icims", F.concat(F.lit("https://"), token, F.lit("/")))
    out = out.when((kind == "oracle") & (site != ""), F.concat(F.lit("https://"), host, F.lit("/hcmUI/CandidateExperience/en/sites/"), site))
    for name, pattern in HOSTED.items():
        before, after = pattern.split("{}")
        out = out.when(kind == name, F.concat(F.lit(before), slug, F.lit(after)))
    return out


def safe_url(c: Column) -> Column:
    """The address itself if it is https, else null."""
    return F.when(c.rlike(r"(?i)^https://[^/\s]+"), c)


def valid_token(kind: Column, token: Column) -> Column:
    short, long = token.rlike(r"^[a-z0-9][a-z0-9._-]{1,90}$"), token.rlike(r"^[a-z0-9][a-z0-9._/-]{1,180}$")
    return F.coalesce(F.when(kind.isin(*LONG_TOKENS), long).otherwise(short) & ~token.isin(*RESERVED), F.lit(False))


def usable_token(kind: Column, token: Column) -> Column:
    """As ``valid_token`` for a lower-case token of a directory: platforms whose boards are whole addresses
    take those, and files that every site has are refused."""
    address = token.rlike(r"^https://[a-z0-9][a-z0-9.-]*\.[a-z]{2,}(?:/\S*)?$")
    return F.coalesce(F.when(kind.isin(*URL_TOKENS), address).otherwise(valid_token(kind, token)) & ~token.rlike(_SITE_FILES), F.lit(False))


def extra_board_url(kind: Column, token: Column) -> Column:
    """The address of a board of the platforms whose tokens have several parts; null for others."""
    part = lambda i: F.split_part(token, F.lit("/"), F.lit(i))
    base = F.regexp_replace(token, r"/+$", "")
    several = F.contains(token, F.lit("/"))
    pages = {
        "hireology": F.concat(F.lit("https://careers.hireology.com/"), quoted(token)),
        "adp": F.concat(F.lit("https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid="), quoted(part(1)), F.lit("&ccId="), quoted(part(2)), F.lit("&lang=en_US")),
        "dover": F.concat(F.lit("https://app.dover.com/careers/"), quoted(token)),
        "ukg": F.when(several, F.concat(F.lit("https://"), part(1), F.lit("/"), part(2), F.lit("/JobBoard/"), quoted(part(3)), F.lit("/"))),
        "successfactors": F.concat(base, F.lit("/search/")),
        "brassring": F.concat(F.lit("https://sjobs.brassring.com/TGnewUI/Search/Home/Home?partnerid="), quoted(part(1)), F.lit("&siteid="), quoted(part(2))),
        "phenom": F.concat(F.lit("https://"), base, F.when(F.contains(base, F.lit("/")), "").otherwise("/search-results")),
        "paylocity": F.concat(F.lit("https://recruiting.paylocity.com/recruiting/jobs/All/"), quoted(token)),
        "zoho": F.concat(F.lit("https://"), part(1), F.lit(".zohorecruit."), F.when(several, part(2)).otherwise("com"), F.lit("/jobs/Careers")),
        "careerplug": F.concat(F.lit("https://"), quoted(token), F.lit(".careerplug.com/jobs")),
    }
    return F.coalesce(*[F.when(kind == name, page) for name, page in pages.items()])


def board_of_url(url: Column) -> Column:
    """struct<kind, token> of a posting's address; null where it is no known board or no valid token."""
    host, path = host_of(url), path_of(url)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    seg = lambda i: F.lower(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
    kind, token = F.lit(None).cast("string"), F.lit(None).cast("string")
    oracle = F.regexp_extract(path, r"/sites/([^/]+)", 1)
    rules = [(host.endswith(".oraclecloud.com") & (oracle != ""), F.lit("oracle"), F.concat_ws("/", host, F.lower(oracle))), (host.endswith(".icims.com") & path.startswith("/jobs/"), F.lit("icims"), host)]
    rules += [(host.endswith(s), F.lit(k), F.expr(f"'{s}'")) for s, k in SUFFIX_HOSTS.items()]
    rules = [(test, k, t if i < 2 else F.substring(host, F.lit(1), F.length(host) - F.length(t))) for i, (test, k, t) in enumerate(rules)]
    work = host.rlike(r"^[a-z0-9-]+\.wd\d+\.myworkdayjobs\.com$") & ~seg(0).isin("", "wday", "d")
    rules.append((work, F.lit("workday"), F.concat_ws("/", host, F.split_part(host, F.lit("."), F.lit(1)), seg(0))))
    rules += [(host == h, F.lit(k), F.when((F.lit(k) == "rippling") & path.startswith("/api/v1/board/"), seg(3)).otherwise(seg(0))) for h, k in PATH_HOSTS.items()]
    for test, k, t in rules:
        kind, token = F.when(test, k).otherwise(kind), F.when(test, t).otherwise(token)
    return F.when(valid_token(kind, token), F.struct(kind.alias("kind"), token.alias("token")))


def urls_in(text: Column) -> Column:
    """Every address in a free text, without the punctuation after it."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL), 0), lambda u: F.regexp_replace(u, r"[.,;]+$", ""))


def path_token(url: Column) -> Column:
    """The first segment of the path that is no locale."""
    parts = F.filter(F.split(path_of(url), "/"), lambda p: (p != "") & ~p.rlike(r"^[a-z]{2}(-[A-Za-z]{2})?$"))
    return F.lower(F.get(parts, F.lit(0)))


def host_token(url: Column, suffix: str) -> Column:
    """The single label before the suffix of the host; null for none or several."""
    host = host_of(url)
    label = F.substring(host, F.lit(1), F.length(host) - len(suffix))
    return F.when(host.endswith(suffix) & label.rlike(r"^[a-z0-9-]+$"), label)


def kind_of_csv(url: Column, vendor: Column) -> Column:
    """The platform of a directory row: by its address before the vendor named."""
    low = F.lower(F.coalesce(url, F.lit("")))
    out = F.lower(F.trim(vendor))
    for mark, kind in (("greenhouse.io", "greenhouse"), ("lever.co", "lever"), ("ashbyhq.com", "ashby")):
        out = F.when(F.contains(low, F.lit(mark)), kind).otherwise(out)
    return out


def last_segment(url: Column) -> Column:
    parts = F.filter(F.split(F.regexp_replace(F.coalesce(url, F.lit("")), r"[?#].*$", ""), "/"), lambda p: p != "")
    return F.when(F.size(parts) > 2, F.element_at(parts, -1))
