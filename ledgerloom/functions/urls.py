"""URL canonicalisation, keys and classification as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ledgerloom.functions import fixed, text as T

_PARTS = r"(?i)^(https?)://([^/?#]*)([^?#;]*)(;[^?#]*)?(?:\?([^#]*))?(?:#.*)?$"


def _part(c: Column, group: int) -> Column:
    return F.regexp_extract(F.trim(T.text(c)), _PARTS, group)


def is_web(c: Column) -> Column:
    return F.trim(T.text(c)).rlike(r"(?i)^https?://")


def host(c: Column) -> Column:
    """Network location in lower case, with its port."""
    return F.lower(_part(c, 2))


def domain(c: Column) -> Column:
    """The host without a leading www."""
    return F.regexp_replace(F.trim(host(c)), r"^www\.", "")


def bare_domain(c: Column) -> Column:
    return F.regexp_replace(domain(c), ":.*$", "")


def registrable(c: Column) -> Column:
    """The last two labels of a host."""
    labels = F.filter(F.split(F.regexp_replace(F.lower(T.text(c)), ":.*$", ""), r"\."), lambda x: x != "")
    return F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.array_join(labels, "."))


def _path(c: Column) -> Column:
    return F.regexp_replace(F.coalesce(F.nullif(_part(c, 3), F.lit("")), F.lit("/")), "/+", "/")


def canonical(c: Column) -> Column:
    """Scheme and host in lower case, single slashes, none at the end, no query and no fragment; other text is squeezed and lower-cased."""
    path = F.coalesce(F.nullif(F.regexp_replace(_path(c), "/+$", ""), F.lit("")), F.lit("/"))
    return F.when(is_web(c), F.concat(F.lower(_part(c, 1)), F.lit("://"), host(c), path, _part(c, 4))).otherwise(T.normal_text(c))


def _encoded(c: Column) -> Column:
    """Decoded and encoded again, as forms are."""
    return F.replace(F.replace(F.url_encode(F.coalesce(F.try_url_decode(c), c)), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def stripped(c: Column, other: str = "as is") -> Column:
    """Scheme and host in lower case, single slashes, the query without tracking parameters and no fragment.

    Text that is no web URL stays as it is, trimmed (other="lower": in lower case).
    """
    pairs = F.filter(F.split(_part(c, 5), "&"), lambda p: p != "")
    key = lambda p: _encoded(F.regexp_extract(p, "^([^=]*)", 1))
    value = lambda p: _encoded(F.regexp_extract(p, "^[^=]*=?(.*)$", 1))
    tracking = "^(" + "|".join(fixed.TRACKING_PREFIXES) + ")"
    kept = F.filter(pairs, lambda p: ~F.lower(F.coalesce(F.try_url_decode(p), p)).rlike(tracking))
    query = F.array_join(F.transform(kept, lambda p: F.concat(key(p), F.lit("="), value(p))), "&")
    link = F.concat(F.lower(_part(c, 1)), F.lit("://"), host(c), _path(c), _part(c, 4), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit("")))
    rest = F.lower(F.trim(T.text(c))) if other == "lower" else F.trim(T.text(c))
    return F.when(is_web(c), link).otherwise(rest)


def query_value(c: Column, name: str) -> Column:
    """The first non-empty value of a query parameter, decoded; else null."""
    raw = F.regexp_extract(F.concat(F.lit("&"), _part(c, 5)), f"&{name}=([^&]+)", 1)
    return F.try_url_decode(F.nullif(raw, F.lit("")))


def _bing_target(raw: Column) -> Column:
    """The address coded in a redirect of Bing; empty if it has none that can be read. Line breaks and tabs, as of base64 in lines, are no part of it."""
    coded = F.regexp_replace(F.regexp_replace(F.coalesce(query_value(raw, "u"), F.lit("")), r"[\t\r\n]", ""), "^a1", "")
    padded = T.bound(coded, lambda x: F.rpad(x, (F.ceil(F.length(x) / 4) * 4).cast("int"), F.lit("=")))
    return F.trim(F.coalesce(F.try_to_binary(F.translate(padded, "-_", "+/"), F.lit("base64")).cast("string"), F.lit("")))


def unwrapped(c: Column) -> Column:
    """The target of a search engine's redirect link, without a fragment; empty if it is no web URL.

    Each step names its address several times, so it is bound: written out, three steps would be more than the JVM compiles.
    """
    duck = lambda x: F.when(F.contains(x, F.lit("duckduckgo.com/l/?")), F.coalesce(query_value(x, "uddg"), x)).otherwise(x)
    bing = lambda x: F.when(host(x).endswith("bing.com") & _part(x, 3).startswith("/ck/a"), F.coalesce(F.nullif(_bing_target(x), F.lit("")), x)).otherwise(x)
    google = lambda x: F.when(host(x).endswith("google.com") & _part(x, 3).startswith("/url"), F.coalesce(query_value(x, "q"), x)).otherwise(x)
    target = F.trim(T.text(c))
    for step in (duck, bing, google):
        target = T.bound(target, step)
    return T.bound(target, lambda x: F.when(is_web(x), F.regexp_replace(x, "#.*$", "")).otherwise(F.lit("")))


def normal_location(c: Column, url: Column | None = None) -> Column:
    """The family of a location, or its words; a blank one is named by its URL, or unknown."""
    loc = T.normal_text(c)
    named = F.lit("unknown")
    if url is not None:
        named = F.when(T.text(url) != "", F.concat(F.lit("url-"), F.substring(F.sha1(canonical(url)), 1, 8))).otherwise(named)
    out = F.when(loc.isin(*fixed.BLANK_LOCATIONS), named)
    for family in fixed.LOCATION_FAMILIES:
        out = out.when(F.contains(loc, F.lit(family)), F.lit(family))
    return out.otherwise(T.squeezed(F.regexp_replace(loc, r"(?U)[^a-z0-9\s]", " ")))


def posting_hash(company: Column, title: Column, location: Column, url: Column) -> Column:
    return F.sha2(F.concat_ws("|", T.normal_text(company), T.normal_title(title), normal_location(location, url), canonical(url)), 256)


def title_location(title: Column, location: Column, url: Column | None = None) -> Column:
    return F.concat_ws("|", T.normal_title(title), normal_location(location, url))


def posting_key(title: Column, location: Column, url: Column) -> Column:
    link = canonical(url)
    return F.when(link != "", F.concat(F.lit("url|"), link)).otherwise(F.concat(F.lit("title_location|"), title_location(title, location, url)))


def stable_key(title: Column, company: Column, link: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lower(F.trim(T.text(title))), F.lower(F.trim(T.text(company))), stripped(link)), 256)


def fingerprint(title: Column, link: Column) -> Column:
    return F.concat_ws("|", F.lower(F.trim(T.text(title))), F.lower(F.trim(T.text(link))))


def table_key(title: Column, company: Column, link: Column) -> Column:
    """Key of a row of the primary table: its link, else title and company, else empty."""
    by_name = F.when((T.normal_text(title) != "") | (T.normal_text(company) != ""), F.concat_ws("|", F.lit("title_company"), T.normal_text(title), T.normal_text(company))).otherwise(F.lit(""))
    return F.when(T.text(link) != "", F.concat(F.lit("link|"), stripped(link, "lower"))).otherwise(by_name)


def opening_key(title: Column, company: Column, location: Column, link: Column) -> Column:
    """Key of a posting by link or title, with company, title and location; empty without both."""
    url = stripped(link, "lower")
    seen = F.concat_ws("|", F.lit("fp"), T.normal_text(company), T.normal_title(title), normal_location(location, url))
    return F.when(url != "", F.concat_ws("|", F.lit("title_link"), seen, url)).when(T.normal_title(title) != "", F.concat_ws("|", F.lit("title_only"), seen)).otherwise(F.lit(""))


def change_token(status: Column, company: Column, role: Column, location: Column, link: Column) -> Column:
    place = F.coalesce(F.nullif(T.normal_text(location), F.lit("")), F.lit("not specified"))
    return F.concat_ws("|", T.normal_text(status), T.normal_text(company), T.normal_text(role), place, canonical(link))


def platform(c: Column) -> Column:
    """The applicant system named in host or path, by order of precedence."""
    where = F.lower(F.concat(host(c), _part(c, 3)))
    out = F.when(F.lit(False), F.lit(""))
    for part, name in fixed.PLATFORMS:
        out = out.when(F.contains(where, F.lit(part)), F.lit(name))
    return out.otherwise(F.lit("Custom HTML"))


def _segments(c: Column) -> Column:
    return F.filter(F.split(_part(c, 3), "/"), lambda s: F.trim(s) != "")


def _labels(c: Column) -> Column:
    return F.filter(F.split(bare_domain(c), r"\."), lambda s: s != "")


def _first(c: Column) -> Column:
    return F.try_element_at(c, F.lit(1))


def company_name(c: Column, url: Column) -> Column:
    """The company as given, or else by its applicant system's path or label, or by its host."""
    labels, ends = _labels(url), lambda hosts: T.any_of([bare_domain(url).endswith(h) for h in hosts])
    by_host = F.when((F.size(labels) >= 3) & _first(labels).isin(*fixed.GENERIC_LABELS), F.try_element_at(labels, F.lit(2))).otherwise(_first(labels))
    found = F.when(ends(fixed.PATH_HOSTS) & (F.size(_segments(url)) > 0), _first(_segments(url))).when(ends(fixed.LABEL_HOSTS), _first(labels)).otherwise(by_host)
    found = T.squeezed(F.translate(F.coalesce(F.nullif(found, F.lit("")), F.lit("unknown")), "-_", "  "))
    return F.when(T.squeezed(c) != "", T.squeezed(c)).otherwise(T.title_case(found))


def company_from_host(url: Column) -> Column:
    """The first label of the host that doesn't name a job board, in title case."""
    labels = _labels(url)
    found = F.when(_first(labels).isin(*fixed.BOARD_LABELS) & (F.size(labels) > 1), F.try_element_at(labels, F.lit(2))).otherwise(_first(labels))
    return T.title_case(F.translate(F.coalesce(found, F.lit("")), "-_", "  "))


def company_from_url(url: Column) -> Column:
    """The company by query parameter, applicant system or host label; null if there is none."""
    ends = lambda h: bare_domain(url).endswith(h)
    by_path = F.when(T.any_of([ends(h) for h in fixed.PATH_HOSTS]), F.trim(_first(_segments(url))))
    by_label = F.when(ends("breezy.hr") & ~_first(_labels(url)).isin("careers", "jobs"), _first(_labels(url)))
    by_host = F.when(F.size(_labels(url)) >= 2, _first(F.filter(_labels(url), lambda x: ~x.isin(*fixed.SKIP_LABELS))))
    return F.coalesce(*[F.trim(query_value(url, k)) for k in fixed.COMPANY_KEYS], by_path, by_label, by_host)


def company_words(c: Column) -> Column:
    """The first four telling words of a company's name."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(T.text(c))), r"[\-_+]+", " "), r"(?U)[^a-z0-9\s]", " ")
    words = F.filter(F.split(T.squeezed(plain), " "), lambda w: ~w.isin(*fixed.COMPANY_STOP_WORDS) & (F.length(w) > 1))
    return F.array_join(F.slice(words, 1, 4), " ")


def company_candidates(url: Column) -> Column:
    """Names of the company in a URL, in order: query parameters, path, label; the first label of the host if there is none."""
    own = [query_value(url, k) for k in fixed.COMPANY_KEYS]
    own += [F.when(bare_domain(url).endswith(h), _first(_segments(url))) for h in fixed.HINT_PATH_HOSTS]
    own += [F.when(bare_domain(url).endswith("breezy.hr"), _first(_labels(url)))]
    found = F.filter(F.array(*own), lambda x: x.isNotNull())
    return F.when(F.size(found) > 0, found).when(F.size(_labels(url)) >= 2, F.slice(_labels(url), 1, 1)).otherwise(F.array().cast("array<string>"))


def company_matches(hint: Column, employer: Column) -> Column:
    """True if the first two telling words of the hint are parts of the employer's."""
    words = F.slice(F.filter(F.split(company_words(hint), " "), lambda w: w != ""), 1, 2)
    name = company_words(employer)
    return (F.size(words) > 0) & (name != "") & F.forall(words, lambda w: F.contains(name, w))


def table_title(url: Column) -> Column:
    """A name for a source's table, 95 characters at most."""
    where = F.coalesce(F.nullif(domain(url), F.lit("")), F.lit("unknown"))
    path = F.replace(F.regexp_replace(_part(url, 3), "^/+|/+$", ""), F.lit("/"), F.lit("-"))
    base = F.when(path == "", where).otherwise(F.concat_ws("-", where, path))
    clean = T.squeezed(F.regexp_replace(base, r"[^A-Za-z0-9 _\-]", "-"))
    return F.substring(F.concat(F.lit("Company_"), F.coalesce(F.nullif(clean, F.lit("")), F.lit("source"))), 1, 95)


def pagination_mode(c: Column) -> Column:
    low = F.lower(T.text(c))
    return F.when(F.contains(low, F.lit("cursor=")), "cursor").when(F.contains(low, F.lit("offset=")), "offset").when(F.contains(low, F.lit("page=")), "page").otherwise("unknown")


def next_page(c: Column, step: int = 1) -> Column:
    """The URL with its page (at least 1) or offset (at least 0) moved on; page 2 if it has neither."""
    url, query = F.trim(T.text(c)), _part(c, 5)
    bumped = lambda name, least: F.greatest(F.lit(least), F.regexp_extract(F.concat(F.lit("&"), query), f"&{name}=(\\d+)", 1).cast("int") + step).cast("string")
    moved = lambda name, least: F.regexp_replace(url, F.lit(f"([?&]){name}=\\d+"), F.concat(F.lit(f"$1{name}="), bumped(name, least)))
    has = lambda name: F.concat(F.lit("&"), query).rlike(f"&{name}=\\d+")
    plain = F.regexp_extract(url, "^([^#]*)", 1)
    added = F.concat(F.regexp_replace(plain, r"\?$", ""), F.when(query != "", F.lit("&")).otherwise(F.lit("?")), F.lit("page=2"), F.regexp_extract(url, "(#.*)$", 1))
    return F.when(has("page"), moved("page", 1)).when(has("offset"), moved("offset", 0)).otherwise(added)


def related(base_host: Column, other_host: Column) -> Column:
    """Same host, same registrable domain, or a known applicant system."""
    own, other = F.lower(T.text(base_host)), F.lower(T.text(other_host))
    same = (registrable(own) != "") & (registrable(own) == registrable(other))
    return (other != "") & ((own == other) | same | T.any_of([other.endswith(h) for h in fixed.ATS_HOSTS]))


def resolved(base: Column, href: Column) -> Column:
    """A link's absolute URL for the usual forms: absolute, //host, /path, ?query and a path beside the page."""
    link = F.trim(T.text(href))
    root = F.concat(F.lower(_part(base, 1)), F.lit("://"), _part(base, 2))
    folder = F.regexp_extract(_part(base, 3), "^(.*/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), link)
        .when(link.startswith("//"), F.concat(F.lower(_part(base, 1)), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(root, link))
        .when(link.startswith("?"), F.concat(root, _part(base, 3), link))
        .when(link == "", F.trim(T.text(base)))
        .otherwise(F.concat(root, folder, link))
    )


def ats_candidates(name: Column) -> Column:
    """Distinct URLs at the usual applicant systems, for the name as one word and, where that differs, with hyphens."""
    low = F.lower(F.trim(T.text(name)))
    word, dashed = F.regexp_replace(low, "[^a-z0-9]+", ""), F.regexp_replace(F.regexp_replace(low, "[^a-z0-9]+", "-"), "^-|-$", "")
    forms = ("https://%s.lever.co", "https://jobs.%s.com", "https://boards.greenhouse.io/%s", "https://%s.breezy.hr", "https://apply.workable.com/%s", "https://%s.workdayjobs.com")
    again = F.filter(F.array(*[F.when((dashed != "") & (dashed != word), F.format_string(forms[i], dashed)) for i in (0, 2, 4)]), lambda x: x.isNotNull())
    return F.array_distinct(F.concat(F.array(*[F.format_string(f, word) for f in forms]), again))
