"""What the hiring platforms deliver, declared as paths, and its normalisation to one row shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievemill.functions import dates
from sievemill.functions.html import label_title
from sievemill.functions.text import collapse, strip_html
from sievemill.functions.urls import quoted, safe_url
from sievemill.session import cut

#: Envelope keys under which a list of postings may lie, in order.
ENVELOPES = ("data", "jobs", "content", "offers", "results", "result", "items", "jobPostings")


@dataclass(frozen=True)
class Feed:
    """Paths of one platform. A location is the first group of paths that gives text: the paths of a group
    are joined by ', ', a path ending in [*] is a list joined by '; '. A path [Name|Name] asks the
    name/value questions. Addresses may be patterns of {token}, {host}, {site} and {id}. ``salary`` counts only
    where ``salary_if`` is true; ``salary_range`` names its ends and currency instead. ``place_name`` is the
    name of a place that stands before its city and region; ``place_line`` a text with a line 'Location:';
    ``labelled`` titles may end in the place, 'title in City, ST'."""

    native: tuple[str, ...]
    title: tuple[str, ...]
    location: tuple[tuple[str, ...], ...] = ()
    url: tuple[str, ...] = ()
    pattern: str | None = None
    published: tuple[str, ...] = ()
    dated: str = "iso"
    description: tuple[str, ...] = ()
    workplace: tuple[str, ...] = ()
    remote: tuple[str, ...] = ()
    salary: tuple[str, ...] = ()
    keep: tuple[str, str] | None = None
    salary_if: str | None = None
    salary_range: tuple[str, str, str] | None = None
    place_name: str | None = None
    place_line: str | None = None
    labelled: bool = False


# The field names of the platforms.
FEEDS: dict[str, Feed] = {
    "greenhouse": Feed(("id", "absolute_url"), ("title",), (("location.name",),), ("absolute_url",), None, ("first_published",), description=("content",)),
    "ashby": Feed(("id", "jobUrl", "applyUrl"), ("title",), (("locationName",), ("location.name",), ("location",)), ("applyUrl", "jobUrl"), None, ("publishedAt",), description=("descriptionPlain", "descriptionHtml"), workplace=("workplaceType",), remote=("isRemote",), salary=("compensation.scrapeableCompensationSalarySummary",)),
    "lever": Feed(("id", "hostedUrl"), ("text",), (("categories.allLocations[*]",), ("categories.location",)), ("applyUrl", "hostedUrl"), None, ("createdAt",), description=("descriptionPlain", "description"), workplace=("workplaceType",), salary_range=("salaryRange.min", "salaryRange.max", "salaryRange.currency")),
    "smartrecruiters": Feed(("id",), ("name",), (("location.city", "location.region", "location.country"),), (), "https://jobs.smartrecruiters.com/{token}/{id}", ("releasedDate", "createdOn", "postingDate"), description=("jobAd.sections.jobDescription.text", "jobAd.sections.qualifications.text"), remote=("location.remote",)),
    "workable": Feed(("shortcode", "id", "url"), ("title",), (("location.city", "location.region", "location.country"), ("location",), ("city", "state", "country")), ("application_url", "url", "shortlink"), None, ("published_at", "published_on", "created_at"), description=("description", "description_html"), workplace=("workplace",), remote=("telecommuting", "remote")),
    "recruitee": Feed(("id", "careers_url"), ("title",), (("location.city", "location.state", "location.country"), ("location",), ("city", "state", "country")), ("careers_apply_url", "careers_url", "apply_url"), None, ("published_at", "created_at"), description=("description",), remote=("remote",)),
    "breezy": Feed(("id", "url"), ("name", "title"), (("location.name",), ("location",)), ("apply_url", "url"), None, ("published_date", "published_at"), description=("description",), remote=("location.is_remote",)),
    "bamboohr": Feed(("id", "jobOpeningUrl"), ("jobOpeningName", "title"), (("locationName",), ("location",)), ("jobOpeningUrl", "url"), None, ("datePosted", "createdDate"), description=("description",)),
    "teamtailor": Feed(("id", "url"), ("title",), (), ("url",), None, ("date_published",), description=("content_html",)),
    "personio": Feed(("id",), ("name",), (("offices[*]",), ("office",)), (), "https://{token}.jobs.personio.com/job/{id}", description=("description",)),
    "workday": Feed(("bulletFields[0]", "externalPath", "title"), ("title",), (("locationsText",),), (), "https://{host}/{site}{path}", ("postedOn",), dated="relative"),
    "pinpoint": Feed(("id", "url"), ("title",), (("location.name",), ("location.city", "location.province")), ("url",), description=("description",), workplace=("workplace_type",), salary=("compensation",), salary_if="compensation_visible"),
    "rippling": Feed(("uuid", "url"), ("name",), (("workLocation.label",),), ("url",)),
    "oracle": Feed(("Id", "Title"), ("Title",), (("PrimaryLocation",),), (), "https://{host}/hcmUI/CandidateExperience/en/sites/{site}/job/{id}", ("PostedDate",), description=("ShortDescriptionStr", "ExternalResponsibilitiesStr", "ExternalQualificationsStr"), workplace=("WorkplaceTypeCode", "WorkplaceType"), keep=("Language", r"(?i)^(us|en)")),
    "jazzhr": Feed(("url",), ("title",), (("location",),), ("url",)),
    "icims": Feed(("url",), ("title",), (("location",),), ("url",)),
    "jobvite": Feed(("url",), ("title",), (("location",),), ("url",)),
    "hireology": Feed(("id",), ("name",), (("locations[0].city", "locations[0].state"),), ("career_site_url",), "https://careers.hireology.com/{token}/{id}/description", ("created_at",), description=("job_description",), remote=("remote",), keep=("status", r"^open$")),
    "adp": Feed(("itemID", "clientRequisitionID"), ("requisitionTitle",), (("requisitionLocations[0].nameCode.shortName",), ("requisitionLocations[0].address.cityName", "requisitionLocations[0].address.countrySubdivisionLevel1.codeValue")), (), "https://workforcenow.adp.com/mascsr/default/mdf/recruitment/recruitment.html?cid={token}&jobId={id}", ("postDate",), description=("requisitionDescription",)),
    "dover": Feed(("id",), ("title",), (("locations[0].name",), ("locations[0].location_option.display_name",)), (), "https://app.dover.com/careers/{token}", workplace=("workplace_type",)),
    "ukg": Feed(("Id",), ("Title",), (("Locations[0].Address.City", "Locations[0].Address.State.Code"), ("Locations[0].Address.City", "Locations[0].Address.State.Name"), ("Locations[0].LocalizedDescription",)), (), "https://{host}/{site}/OpportunityDetail?opportunityId={id}", ("PostedDate",), description=("BriefDescription",)),
    "successfactors": Feed(("id",), ("unifiedStandardTitle",), (("jobLocationShort[*]",),), (), "https://{host}/job/{id}", ("unifiedStandardStart",), dated="day_first"),
    "brassring": Feed(("[reqid|jobreqid|requisitionid|jobid]",), ("[jobtitle|title]",), (("[formtext12|city|locationcity]", "[formtext10|state|locationstate|province]"), ("[location|joblocation|primarylocation]",)), (), "https://sjobs.brassring.com/TGnewUI/Search/Home/Home?partnerid={token}", ("[lastupdated|posteddate|dateposted]",), dated="day_first", description=("[jobdescription|description]",)),
    "phenom": Feed(("jobId", "reqId"), ("title",), (("cityStateCountry",), ("city", "state", "country"), ("locationName",)), (), "https://{host}/job/{id}", ("postedDate",), description=("descriptionTeaser",), workplace=("workLocation",), salary=("salary", "salaryRange")),
    "paylocity": Feed(("JobId",), ("JobTitle",), (("JobLocation.City", "JobLocation.State"), ("LocationName",)), (), "https://recruiting.paylocity.com/recruiting/jobs/Details/{id}", ("PublishedDate",), description=("Description",), remote=("IsRemote",), keep=("IsInternal", r"^false$"), place_name="LocationName"),
    "zoho": Feed(("guid", "link"), ("title",), (("location",),), ("link", "guid"), None, ("pubDate",), dated="rfc", description=("description",), place_line="description"),
    "careerplug": Feed(("url",), ("title", "ld.title"), (("location",),), ("url",), None, ("ld.datePosted",), description=("ld.description",), labelled=True),
}


def json_at(item: Column, path: str) -> Column:
    """Text at a path, null for blank; [a|b] asks the questions by name."""
    if path.startswith("["):
        names = path.strip("[]").split("|")
        pairs = F.from_json(F.get_json_object(item, "$.Questions"), "array<struct<QuestionName:string,Value:string>>")
        said = F.filter(pairs, lambda q: F.lower(q["QuestionName"]).isin(*names) & (F.trim(q["Value"]) != ""))
        return F.trim(F.get(said, F.lit(0))["Value"])
    found = F.get_json_object(item, f"$.{path}")
    return F.when(~F.trim(found).isin("", "null") & ~(found.startswith("{") & F.lit(path == "location")), found)


def first_of(item: Column, paths: tuple[str, ...]) -> Column:
    return F.coalesce(*[json_at(item, p) for p in paths]) if paths else F.lit(None).cast("string")


def _place(item: Column, groups: tuple[tuple[str, ...], ...]) -> Column:
    options = []
    for group in groups:
        if group[0].endswith("[*]"):
            listed = F.from_json(F.get_json_object(item, f"$.{group[0][:-3]}"), "array<string>")
            options.append(F.nullif(F.array_join(F.filter(F.transform(listed, lambda x: F.trim(x)), lambda x: x != ""), "; "), F.lit("")))
        else:
            options.append(F.nullif(F.concat_ws(", ", *[json_at(item, p) for p in group]), F.lit("")))
    return F.coalesce(*options, F.lit("Not listed"))


def _place_of(item: Column, feed: Feed) -> Column:
    """The place by the feed's paths, its named site or the line of its description."""
    place = _place(item, feed.location)
    if feed.place_name:
        name, city = json_at(item, feed.place_name), json_at(item, feed.location[0][0])
        place = F.when(name.isNotNull() & city.isNotNull() & ~F.contains(city, name), F.concat(name, F.lit(" ("), place, F.lit(")"))).otherwise(place)
    if feed.place_line:
        line = F.nullif(strip_html(F.regexp_extract(F.coalesce(json_at(item, feed.place_line), F.lit("")), r"(?i)location:\s*([^\n<]+)", 1)), F.lit(""))
        place = F.when(place == "Not listed", F.coalesce(line, place)).otherwise(place)
    if feed.labelled:
        place = F.when(place == "Not listed", F.coalesce(label_title(first_of(item, feed.title))["place"], place)).otherwise(place)
    return place


def _salary_of(item: Column, feed: Feed) -> Column:
    said = first_of(item, feed.salary)
    if feed.salary_if:
        said = F.when(F.lower(json_at(item, feed.salary_if)) == "true", said)
    if feed.salary_range:
        low, high, unit = (json_at(item, p) for p in feed.salary_range)
        ends = F.concat_ws("–", low, high)
        said = F.when(low.isNotNull() & (low != "0"), F.concat_ws(" ", ends, unit))
    return said


def unwrap(payload: Column) -> Column:
    """The postings in a payload as JSON texts: the list itself, the requisitions of the first item, or the
    first list among the usual keys; empty for anything else, broken JSON included."""
    as_list = lambda c: F.from_json(c, "array<string>")
    text = F.trim(payload)
    keyed = [F.get_json_object(text, f"$.{k}") for k in ENVELOPES]
    lists = [F.when(k.startswith("["), k) for k in keyed]
    nested = F.get_json_object(text, "$.items[0].requisitionList")
    found = F.coalesce(F.when(text.startswith("["), text), F.when(nested.startswith("["), nested), *lists)
    return F.coalesce(as_list(found), F.array().cast("array<string>"))


def _published(raw: Column, kind: str, checked: Column) -> Column:
    if kind == "relative":
        return dates.relative_instant(raw, checked)
    if kind == "day_first":
        return dates.day_first(raw)
    if kind == "rfc":
        return F.coalesce(dates.iso_instant(raw), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), r"GMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")))
    return dates.iso_instant(raw)


def _kept(item: Column, feed: Feed) -> Column:
    if not feed.keep:
        return F.lit(True)
    # A missing language keeps the row; other marks must be there.
    return F.coalesce(json_at(item, feed.keep[0]).rlike(feed.keep[1]), F.lit(feed.keep[0] == "Language"))


def _fields(kind: str) -> dict[str, Column]:
    """The canonical columns of one platform's items (company, token, item JSON, checked)."""
    feed, item, token = FEEDS[kind], F.col("item"), F.col("token")
    native = first_of(item, feed.native)
    url = first_of(item, feed.url)
    if feed.pattern:
        made = F.lit(feed.pattern)
        parts = {"{token}": quoted(token), "{host}": F.split_part(token, F.lit("/"), F.lit(1)), "{site}": F.element_at(F.split(token, "/"), -1), "{id}": quoted(F.coalesce(native, F.lit(""))), "{path}": F.coalesce(json_at(item, "externalPath"), F.lit(""))}
        for mark, value in parts.items():
            made = F.replace(made, F.lit(mark), value)
        url = F.coalesce(url, made)
    remote = F.lower(F.coalesce(first_of(item, feed.remote), F.lit("false"))).isin("true", "1")
    said = F.lower(F.coalesce(first_of(item, feed.workplace), F.lit("")))
    place, title = _place_of(item, feed), first_of(item, feed.title)
    title = label_title(title)["title"] if feed.labelled else title
    return {
        "id": F.concat_ws(":", F.lit(kind), "token", native),
        "company": F.col("company"),
        "source": F.lit(kind),
        "title": collapse(title),
        "location": place,
        "workplace": F.when(remote | F.contains(said, F.lit("remote")) | F.contains(F.lower(place), F.lit("remote")), "remote").when(F.contains(said, F.lit("hybrid")), "hybrid").when(said.rlike("on-?site"), "onsite"),
        "salary": _salary_of(item, feed),
        "published": _published(first_of(item, feed.published), feed.dated, F.col("checked")),
        "applyurl": safe_url(url),
        "descriptiontext": strip_html(F.concat_ws("\n", *[json_at(item, p) for p in feed.description]) if feed.description else F.lit("")),
        "checked": F.col("checked"),
        "boardkey": F.concat(F.lit(kind + ":"), F.lower("token")),
    }


def normalise(items: DataFrame, kind: str) -> DataFrame:
    """Canonical rows of one platform's postings.

    ``items``: (company, token, item JSON, checked). A row without title or https address is dropped.
    """
    rows = items.where(_kept(F.col("item"), FEEDS[kind])).select(*[c.alias(n) for n, c in _fields(kind).items()])
    return rows.where("title <> '' and applyurl is not null")


def normalise_all(payloads: DataFrame) -> DataFrame:
    """Canonical rows of payloads (kind, company, token, payload, checked) of any platforms.

    The payloads are read and opened once and their items written to the shared folder, from which the
    projection of each platform reads its own. (All platforms in one projection take longer to compile
    than the items to read.) Rows of other kinds give nothing.
    """
    opened = payloads.where(F.col("kind").isin(*FEEDS)).select("kind", "company", "token", "checked", F.explode_outer(unwrap(F.col("payload"))).alias("item"))
    items = cut(opened.where("item is not null"))
    out = None
    for kind in FEEDS:
        part = normalise(items.where(F.col("kind") == kind), kind)
        out = part if out is None else out.unionByName(part)
    return out


def _nest(paths: dict[str, Column]) -> Column:
    tree: dict = {}
    for path, value in paths.items():
        at = tree
        keys = path.replace("[0]", "[]").split(".")
        for k in keys[:-1]:
            at = at.setdefault(k, {})
        at[keys[-1]] = value

    def build(node) -> Column:
        if not isinstance(node, dict):
            return node
        return F.struct(*[(F.array(build(v)) if k.endswith("[]") else build(v)).alias(k.removesuffix("[]")) for k, v in node.items()])

    return build(tree)


def as_delivered(kind: str, native: Column, title: Column, location: Column, url: Column, published: Column) -> Column:
    """JSON as the platform would deliver it, from its first paths; for replays and tests."""
    feed, paths, asked = FEEDS[kind], {}, {}

    def put(path: str, value: Column) -> None:
        if path.startswith("["):
            asked[path.strip("[]").split("|")[0]] = value
        elif path.endswith("[*]"):
            paths[path[:-3]] = F.array(value)
        else:
            paths[path] = value

    for target, value in ((feed.url, url), (feed.native, native), (feed.title, title), (feed.published, published)):
        if target and target[0] not in paths:
            put(target[0], value)
    if feed.location:
        put(feed.location[0][0], location)
    if feed.keep:
        put(feed.keep[0], F.lit({"Language": "en", "status": "open", "IsInternal": "false"}[feed.keep[0]]))
    if asked:
        paths["Questions"] = F.array(*[F.struct(F.lit(n).alias("QuestionName"), v.alias("Value")) for n, v in asked.items()])
    return F.to_json(_nest(paths))

