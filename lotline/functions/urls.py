"""URL column builders: filtered inventory URLs, relative-link resolution, domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCHEME_HOST_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"
# In-stock filter parameter and the year used when a model is
# requested without one.
IN_STOCK = ("status", "1-1")
DEFAULT_YEAR = "2026"


def form_encode(s: Column) -> Column:
    """application/x-www-form-urlencoded value: space -> '+', unreserved
    characters letters, digits and '_.-~' kept, everything else %XX (UTF-8)."""
    enc = F.url_encode(s)
    return F.replace(F.replace(enc, F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def default_year(model: Column, year: Column) -> Column:
    """A year only counts when a model is requested; then it defaults to 2026."""
    has_model = F.coalesce(model != "", F.lit(False))
    has_year = F.coalesce(year != "", F.lit(False))
    return F.when(has_model, F.when(has_year, year).otherwise(F.lit(DEFAULT_YEAR)))


def _replace_query(base: Column, query: Column) -> Column:
    """Rebuild ``base`` with its query replaced by ``query``; params and a
    non-empty fragment are kept."""
    before = F.regexp_extract(base, r"^([^?#]*)", 1)
    frag = F.regexp_extract(base, r"#(.*)$", 1)
    return F.concat(before, F.lit("?"), query,
                    F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit("")))


def dealercom_filtered_url(base: Column, model: Column, year: Column) -> Column:
    """``?year=Y&model=M&status=1-1`` replacing any existing query; the
    in-stock parameter is always present."""
    y = default_year(model, year)
    has_model = F.coalesce(model != "", F.lit(False))
    parts = F.concat_ws("&",
                        F.when(y.isNotNull(), F.concat(F.lit("year="), form_encode(y))),
                        F.when(has_model, F.concat(F.lit("model="), form_encode(model))),
                        F.lit(f"{IN_STOCK[0]}={IN_STOCK[1]}"))
    return _replace_query(base, parts)


def roadster_filtered_url(base: Column, model: Column, year: Column) -> Column:
    """Repeated ``f=submodel:M&f=year:Y``; with neither the URL is unchanged."""
    y = default_year(model, year)
    has_model = F.coalesce(model != "", F.lit(False))
    parts = F.concat_ws("&",
                        F.when(has_model, F.concat(F.lit("f="), form_encode(F.concat(F.lit("submodel:"), model)))),
                        F.when(y.isNotNull(), F.concat(F.lit("f="), form_encode(F.concat(F.lit("year:"), y)))))
    return F.when(has_model | y.isNotNull(), _replace_query(base, parts)).otherwise(base)


def domain(url: Column) -> Column:
    """Host of an http(s) URL with a leading 'www.' dropped; NULL when none."""
    d = F.regexp_extract(url, r"https?://(?:www\.)?([^/]+)", 1)
    return F.when(d != "", d)


def _path(ref: Column) -> Column:
    return F.regexp_extract(ref, r"^([^?#]*)", 1)


def _after_path(ref: Column) -> Column:
    """Query and fragment, as written."""
    return F.regexp_extract(ref, r"^[^?#]*(.*)$", 1)


def _resolve_segments(segments: Column) -> Column:
    """Rooted path of segments with '.' and '..' worked off, in one pass over them."""
    def step(done: Column, s: Column) -> Column:
        return (F.when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
                .when(s == ".", done).otherwise(F.array_append(done, s)))
    done = F.aggregate(segments, F.array().cast("array<string>"), step)
    last = F.element_at(segments, -1)
    done = F.when(last.isin(".", ".."), F.array_append(done, "")).otherwise(done)
    return F.concat(F.lit("/"), F.array_join(done, "/"))


def _rooted(path: Column) -> Column:
    """A path that starts with '/'."""
    parts = F.split(path, "/")
    return _resolve_segments(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(1))))


def _merged(base_path: Column, path: Column) -> Column:
    """A relative path below the folder of the page; empty segments inside fall away."""
    base = F.split(F.when(base_path == "", F.lit("/")).otherwise(base_path), "/")
    folder = F.slice(base, F.lit(1), F.size(base) - 1)
    parts = F.concat(folder, F.split(path, "/"))
    n = F.size(parts)
    return _resolve_segments(F.filter(parts, lambda s, i: (s != "") | (i == n - 1)))


def resolve_url(base: Column, ref: Column) -> Column:
    """Resolve a reference against a page URL: scheme-relative, rooted path,
    query-only, fragment-only and relative paths.  Dot segments of the path are
    worked off, however many; query and fragment stay as written."""
    origin = F.regexp_extract(base, SCHEME_HOST_RE, 1)
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1)
    bpath = F.regexp_extract(base, SCHEME_HOST_RE + r"([^?#]*)", 2)
    bnofrag = F.regexp_extract(base, r"^([^#]*)", 1)
    bnoquery = F.regexp_extract(base, r"^([^?#]*)", 1)
    return (F.when(ref.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), ref)
            .when(ref.startswith("//"), F.concat(scheme, F.lit(":"), ref))
            .when(ref.startswith("/"), F.concat(origin, _rooted(_path(ref)), _after_path(ref)))
            .when(ref.startswith("?"), F.concat(bnoquery, ref))
            .when(ref.startswith("#"), F.concat(bnofrag, ref))
            .when(ref == "", base)
            .otherwise(F.concat(origin, _merged(bpath, _path(ref)), _after_path(ref))))


def vehicle_url(page_url: Column, link: Column) -> Column:
    """Detail link of a listing: a relative link is resolved against the page;
    an absolute (http...) or missing link gives the page URL itself."""
    rel = F.coalesce(link != "", F.lit(False)) & ~F.coalesce(link.startswith("http"), F.lit(False))
    return F.when(rel, resolve_url(page_url, link)).otherwise(page_url)
