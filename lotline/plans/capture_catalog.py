"""Registered extraction / normalisation queries over the capture table.

The Spark side reads the written capture pages (JSON text) and extracts and
normalises them.  The oracle never sees the JSON: it derives the expected
rows straight from the sightings (page assignment, record variation and the
expected value of every coerced field), so a match proves the round trip.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import inputs
from .catalog import register
from .oracle_views import CTES, register as register_view
from ..functions import variant as V
from ..operators import extract as X
from ..operators import normalize as N
from ..operators.platforms import DEALERCOM, ROADSTER
from ..session import at_most
from ..sources.captures import DEALERCOM_SHAPES, PAGE_SIZE, ROADSTER_SHAPES

ITEM_SQL = ("vin, dealer, dealer_platform, source_url, title, year, model, trim, price, msrp, ext_color, "
            "int_color, odometer, options")


def _shape_case(shapes) -> str:
    n = len(shapes)
    whens = " ".join(f"WHEN {i} THEN '{p}'" for i, (p, _) in enumerate(shapes))
    return f"CASE (page_no + dealer_key) % {n} {whens} END"


register_view("capobs", ["obs"], (
    "SELECT o.*, CAST((l_orderkey * 7919 + l_linenumber * 31 + id) % c.n_pages AS BIGINT) AS page_no, "
    "l_orderkey * 8 + l_linenumber AS m, c.n_pages, "
    "CASE WHEN dealer_platform = 'Roadster' THEN 'roadster' ELSE 'dealercom' END AS platform "
    f"FROM obs o JOIN (SELECT dealer_key, CAST(ceil(count(*) / {PAGE_SIZE}.0) AS BIGINT) AS n_pages "
    "FROM obs GROUP BY dealer_key) c ON o.dealer_key = c.dealer_key"))

register_view("caprec", ["capobs"], (
    "SELECT *, CAST(row_number() OVER (PARTITION BY dealer, page_no ORDER BY m, vin, scraped_at) - 1 AS INTEGER) "
    "AS pos, "
    "CASE WHEN platform = 'roadster' THEN 'https://express.dealer' || dealer_key || "
    "'.example.com/inventory?page=' || page_no ELSE 'https://www.dealer' || dealer_key || "
    f"'.example.com/new-inventory/index.htm?start=' || (page_no * {PAGE_SIZE}) END AS page_url, "
    f"CASE WHEN platform = 'roadster' THEN {_shape_case(ROADSTER_SHAPES)} "
    f"ELSE {_shape_case(DEALERCOM_SHAPES)} END AS path, "
    "CASE WHEN m % 101 = 0 THEN 'not_object' WHEN m % 53 = 0 THEN 'no_vin' "
    "WHEN platform = 'roadster' AND m % 97 = 0 THEN 'bad_odometer' END AS reject_reason "
    "FROM capobs"))

register_view("expected_items", ["caprec"], (
    "SELECT vin, dealer, dealer_platform, "
    "CASE WHEN platform = 'roadster' THEN CASE m % 4 "
    "  WHEN 0 THEN 'https://express.dealer' || dealer_key || '.example.com/inventory/vehicle/' || vin "
    "  WHEN 2 THEN 'https://express.dealer' || dealer_key || '.example.com/vehicle/' || vin || '?next=/x/../y' "
    "  ELSE page_url END ELSE page_url END AS source_url, "
    "CASE WHEN platform = 'dealercom' AND m % 4 = 0 THEN "
    "  coalesce(CAST(CASE WHEN year BETWEEN 1980 AND 2030 THEN year END AS VARCHAR), 'None') "
    "  || ' BMW ' || model || ' ' || trim ELSE title END AS title, "
    "CASE WHEN platform = 'dealercom' THEN CASE WHEN year BETWEEN 1980 AND 2030 THEN year END "
    "  ELSE year END AS year, "
    "model, trim, CASE WHEN platform = 'roadster' AND m % 5 = 3 THEN NULL ELSE price END AS price, "
    "msrp, ext_color, int_color, CASE WHEN m % 89 <> 0 THEN odometer END AS odometer, options, page_no, pos, "
    "platform, reject_reason FROM caprec"))

# The same over pages of one requested model and year each.
_REQUEST = "dealer_key, model, year"
register_view("reqobs", ["obs"], CTES["capobs"][1].replace("GROUP BY dealer_key)", f"GROUP BY {_REQUEST})").replace(
    "(SELECT dealer_key,", f"(SELECT {_REQUEST},").replace("ON o.dealer_key = c.dealer_key", f"USING ({_REQUEST})"))
register_view("reqrec", ["reqobs"], CTES["caprec"][1].replace("FROM capobs", "FROM reqobs").replace(
    "PARTITION BY dealer, page_no", "PARTITION BY dealer, model, year, page_no"))
register_view("expected_request_items", ["reqrec"], CTES["expected_items"][1].replace("FROM caprec", "FROM reqrec"))


def _caps(spark, sf):
    return inputs.captures(spark, sf)


def _vin_text(rec):
    return F.when(V.is_object_cheap(rec), V.as_text(V.first_truthy(V.get(rec, "vin"), V.get(rec, "VIN"))))


def _extract_rows(spec, spark, sf):
    caps = _caps(spark, sf).where(F.col("platform") == spec.name)
    recs = X.extract(spec, caps)
    return recs.select("dealer", "page_no", "path", "pos", _vin_text(F.col("rec")).alias("vin"))


_EXTRACT_SQL = ("SELECT dealer, page_no, path, pos, CASE WHEN m % 53 = 0 OR m % 101 = 0 THEN NULL "
                "ELSE vin END AS vin FROM caprec WHERE platform = '{p}'")


@register("extract_dealercom", _EXTRACT_SQL.format(p="dealercom"), ("caprec",))
def q_extract_dealercom(spark, sf):
    return _extract_rows(DEALERCOM, spark, sf)


@register("extract_dealercom_alt",
          _EXTRACT_SQL.format(p="dealercom") + f" AND path <> '{DEALERCOM.primary}'", ("caprec",))
def q_extract_dealercom_alt(spark, sf):
    return _extract_rows(DEALERCOM, spark, sf).where(F.col("path") != DEALERCOM.primary)


@register("extract_roadster", _EXTRACT_SQL.format(p="roadster"), ("caprec",))
def q_extract_roadster(spark, sf):
    return _extract_rows(ROADSTER, spark, sf)


@register("extract_explode",
          "SELECT platform, dealer, page_no, pos, CASE WHEN m % 101 = 0 THEN 'STRING' ELSE 'OBJECT' END "
          "AS rec_type FROM caprec", ("caprec",))
def q_extract_explode(spark, sf):
    caps = _caps(spark, sf)
    parts = []
    for spec in (DEALERCOM, ROADSTER):
        r = X.extract(spec, caps.where(F.col("platform") == spec.name))
        parts.append(r.select(F.lit(spec.name).alias("platform"), "dealer", "page_no", "pos",
                              F.regexp_extract(F.schema_of_variant("rec"), "^[A-Z]+", 0).alias("rec_type")))
    return parts[0].unionByName(parts[1])


@register("filter_vin",
          "SELECT platform, dealer, page_no, pos, vin FROM caprec WHERE m % 53 <> 0 AND m % 101 <> 0",
          ("caprec",))
def q_filter_vin(spark, sf):
    caps = _caps(spark, sf)
    parts = []
    for spec in (DEALERCOM, ROADSTER):
        r = X.extract(spec, caps.where(F.col("platform") == spec.name))
        vin = _vin_text(F.col("rec"))
        parts.append(r.select(F.lit(spec.name).alias("platform"), "dealer", "page_no", "pos", vin.alias("vin"))
                     .where(F.coalesce(F.col("vin") != "", F.lit(False))))
    return parts[0].unionByName(parts[1])


@register("rejects_by_reason",
          "SELECT dealer_platform, reject_reason, count(*) AS n FROM caprec WHERE reject_reason IS NOT NULL "
          "GROUP BY ALL", ("caprec",))
def q_rejects_by_reason(spark, sf):
    """From the stored records: only the keys that a reason depends on are read."""
    recs = inputs.records(spark, sf)
    parts = [N.normalize_records(spec, recs.where(F.col("platform") == spec.name), ())
             .where(F.col("reject_reason").isNotNull()).select("dealer_platform", "reject_reason")
             for spec in (DEALERCOM, ROADSTER)]
    return parts[0].unionByName(parts[1]).groupBy("dealer_platform", "reject_reason").agg(
        F.count(F.lit(1)).alias("n"))


@register("split_accepted", f"SELECT {ITEM_SQL}, page_no, pos FROM expected_items WHERE reject_reason IS NULL", ("expected_items",))
def q_split_accepted(spark, sf):
    """The accepted folder of the write that holds items and rejects."""
    return inputs.split_items(spark, sf).where("reject_reason IS NULL").select(*N.ITEM_COLUMNS, "page_no", "pos")


@register("split_rejects",
          "SELECT dealer, page_no, pos, dealer_platform, reject_reason FROM caprec WHERE reject_reason IS NOT NULL", ("caprec",))
def q_split_rejects(spark, sf):
    """The folders of rejected records of the same write, by reason."""
    return inputs.split_items(spark, sf).where("reject_reason IS NOT NULL").select(
        "dealer", "page_no", "pos", "dealer_platform", "reject_reason")


@register("normalize_records", f"SELECT {ITEM_SQL}, page_no, pos FROM expected_items WHERE reject_reason IS NULL", ("expected_items",))
def q_normalize_records(spark, sf):
    """All fields of all platforms from the stored records, without parsing a page."""
    recs = inputs.records(spark, sf)
    parts = [N.normalize_records(spec, recs.where(F.col("platform") == spec.name)).where("reject_reason IS NULL")
             .select(*N.ITEM_COLUMNS, "page_no", "pos") for spec in (DEALERCOM, ROADSTER)]
    return parts[0].unionByName(parts[1])


def _normalized(spec, spark, sf):
    caps = _caps(spark, sf).where(F.col("platform") == spec.name)
    return N.normalize(spec, caps).select(*N.ITEM_COLUMNS, "page_no", "pos")


_NORM_SQL = f"SELECT {ITEM_SQL}, page_no, pos FROM expected_items WHERE platform = '{{p}}' AND reject_reason IS NULL"


@register("normalize_dealercom", _NORM_SQL.format(p="dealercom"), ("expected_items",))
def q_normalize_dealercom(spark, sf):
    return _normalized(DEALERCOM, spark, sf)


@register("normalize_roadster", _NORM_SQL.format(p="roadster"), ("expected_items",))
def q_normalize_roadster(spark, sf):
    return _normalized(ROADSTER, spark, sf)


@register("ingest_all_platforms", f"SELECT {ITEM_SQL} FROM expected_items WHERE reject_reason IS NULL",
          ("expected_items",))
def q_ingest_all_platforms(spark, sf):
    return N.normalize_all([DEALERCOM, ROADSTER], _caps(spark, sf))


# Per-field keys: each checks one coercion rule over the whole table of stored
# records, of which it reads the field's keys only.
def _fields(spec, spark, sf, *fields):
    recs = inputs.records(spark, sf).where(F.col("platform") == spec.name)
    return N.normalize_records(spec, recs, fields).where(F.col("reject_reason").isNull()).select(
        "dealer", "page_no", "pos", *fields)


def _field_query(spec, field):
    def q(spark, sf):
        return _fields(spec, spark, sf, field)
    return q


def _field_sql(platform, field):
    return (f"SELECT dealer, page_no, pos, {field} FROM expected_items "
            f"WHERE platform = '{platform}' AND reject_reason IS NULL")


for _key, _spec, _field in [
    ("price_dealercom", DEALERCOM, "price"), ("price_roadster", ROADSTER, "price"),
    ("year_validate", DEALERCOM, "year"), ("odometer_dealercom", DEALERCOM, "odometer"),
    ("odometer_roadster", ROADSTER, "odometer"), ("color_nested", ROADSTER, "ext_color"),
    ("color_alias", DEALERCOM, "ext_color"), ("list_join", DEALERCOM, "model"),
    ("title_dealercom", DEALERCOM, "title"), ("title_roadster", ROADSTER, "title"),
    ("options_json", DEALERCOM, "options"), ("url_resolve", ROADSTER, "source_url"),
]:
    register(_key, _field_sql(_spec.name, _field), ("expected_items",))(_field_query(_spec, _field))


@register("first_truthy",
          "SELECT dealer, page_no, pos, ext_color, int_color, msrp FROM expected_items "
          "WHERE platform = 'dealercom' AND reject_reason IS NULL", ("expected_items",))
def q_first_truthy(spark, sf):
    return _fields(DEALERCOM, spark, sf, "ext_color", "int_color", "msrp")


_DIAG_FOUND = [1, 2, 3, 4, 5, 3]  # step at which each Roadster page shape finds its list
_DIAG_STEPS = ", ".join(f"({s}, {i + 1}, '{p}')" for s in range(len(ROADSTER_SHAPES))
                        for i, p in enumerate(ROADSTER.paths) if i + 1 <= _DIAG_FOUND[s])


@register("extract_diagnostics",
          "SELECT g.dealer, g.page_no, 'page' AS capture_kind, d.step, d.path, 'list' AS path_type, "
          "CASE WHEN d.step = g.found THEN CAST(g.n AS VARCHAR) ELSE '0' END AS path_len FROM "
          "(SELECT dealer, page_no, (page_no + dealer_key) % 6 AS shape, count(*) AS n, "
          " CASE (page_no + dealer_key) % 6 " +
          " ".join(f"WHEN {s} THEN {f}" for s, f in enumerate(_DIAG_FOUND)) +
          " END AS found FROM capobs WHERE platform = 'roadster' GROUP BY ALL) g "
          f"JOIN (VALUES {_DIAG_STEPS}) d(shape, step, path) ON g.shape = d.shape", ("capobs",))
def q_extract_diagnostics(spark, sf):
    return X.path_diagnostics(ROADSTER, _caps(spark, sf))


# Dealer.com fallback attempts per page shape: (path, type, length) up to the
# path that yields the list ('n' = the page's record count).
_DC_ATTEMPTS = {
    1: [("DDC.inventory", "list", "n")],
    2: [("DDC.inventory", "NoneType", "N/A"), ("inventory", "list", "n")],
    3: [("DDC.inventory", "NoneType", "N/A"), ("inventory", "NoneType", "N/A"), ("_DDC.InvData.inventory", "list", "n")],
    4: [("DDC.inventory", "NoneType", "N/A"), ("inventory", "NoneType", "N/A"),
        ("_DDC.InvData.inventory", "NoneType", "N/A"), ("ddc.InvData.inventory", "list", "n")],
    5: [("DDC.inventory", "NoneType", "N/A"), ("inventory", "NoneType", "N/A"),
        ("_DDC.InvData.inventory", "NoneType", "N/A"), ("ddc.InvData.inventory", "NoneType", "N/A"),
        ("DDC.inventoryData", "list", "n")],
    6: [("DDC.inventory", "NoneType", "N/A"), ("inventory", "NoneType", "N/A"),
        ("_DDC.InvData.inventory", "NoneType", "N/A"), ("ddc.InvData.inventory", "NoneType", "N/A"),
        ("DDC.inventoryData", "NoneType", "N/A"), ("DDC.InvData.vehicles", "list", "n")],
    7: [("DDC.inventory", "list", "0"), ("inventory", "list", "n")],
}
_DC_STEPS = ", ".join(f"({s}, {i + 1}, '{p}', '{t}', '{ln}')" for s, att in _DC_ATTEMPTS.items()
                      for i, (p, t, ln) in enumerate(att))
_EMPTY_STEPS = ", ".join(f"({i + 1}, '{p}')" for i, p in enumerate(DEALERCOM.paths))


@register("extract_diagnostics_dealercom",
          "SELECT g.dealer, g.page_no, 'page' AS capture_kind, d.step, d.path, d.path_type, "
          "CASE WHEN d.len = 'n' THEN CAST(g.n AS VARCHAR) ELSE d.len END AS path_len FROM "
          "(SELECT dealer, page_no, (page_no + dealer_key) % 8 AS shape, count(*) AS n FROM capobs "
          "WHERE platform = 'dealercom' GROUP BY ALL) g "
          f"JOIN (VALUES {_DC_STEPS}) d(shape, step, path, path_type, len) ON g.shape = d.shape "
          "UNION ALL SELECT e.dealer, e.page_no, 'empty', d.step, d.path, 'NoneType', 'N/A' FROM "
          "(SELECT DISTINCT dealer, page_no FROM capobs WHERE platform = 'dealercom' AND page_no % 10 = 1) e "
          f"CROSS JOIN (VALUES {_EMPTY_STEPS}) d(step, path)", ("capobs",))
def q_extract_diagnostics_dealercom(spark, sf):
    return X.path_diagnostics(DEALERCOM, _caps(spark, sf))


_PRESENCE_KEYS = {0: "InvData", 1: "inventory", 5: "inventoryData", 6: "InvData", 7: "accounts,inventory"}


_INVDATA_KEYS = {0: "inventory", 6: "vehicles"}


@register("extract_presence",
          "SELECT dealer, page_no, capture_kind, has_ddc, ddc_keys, has_invdata, invdata_keys, has_inventory, "
          "inventory_type, inventory_keys, inventory_is_array, inventory_length FROM ("
          "SELECT dealer, page_no, 'page' AS capture_kind, s IN (0, 1, 5, 6, 7) AS has_ddc, "
          "CASE s " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _PRESENCE_KEYS.items()) +
          " ELSE '' END AS ddc_keys, s IN (0, 6) AS has_invdata, "
          "CASE s " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in _INVDATA_KEYS.items()) +
          " ELSE '' END AS invdata_keys, s = 0 AS has_inventory, "
          "CASE WHEN s = 0 THEN 'object' ELSE 'undefined' END AS inventory_type, "
          "CASE WHEN s = 0 THEN 'inventory,pageInfo' ELSE '' END AS inventory_keys, "
          "s = 0 AS inventory_is_array, CASE WHEN s = 0 THEN n END AS inventory_length FROM "
          "(SELECT dealer, page_no, (page_no + dealer_key) % 8 AS s, CAST(count(*) AS INTEGER) AS n "
          " FROM capobs WHERE platform = 'dealercom' GROUP BY ALL) "
          "UNION ALL SELECT DISTINCT dealer, page_no, 'trap', true, 'InvData', true, 'inventory', true, 'object', '', "
          "false, CAST(NULL AS INTEGER) FROM capobs WHERE platform = 'dealercom' AND page_no % 10 = 0 "
          "UNION ALL SELECT DISTINCT dealer, page_no, 'empty', false, '', false, '', false, 'undefined', '', false, "
          "CAST(NULL AS INTEGER) FROM capobs WHERE platform = 'dealercom' AND page_no % 10 = 1)",
          ("capobs",))
def q_extract_presence(spark, sf):
    return X.presence(_caps(spark, sf))


@register("capture_completeness",
          f"SELECT dealer, page_no, 'page' AS capture_kind, CAST(count(*) AS INTEGER) AS n_records, "
          f"count(*) >= {PAGE_SIZE} AND page_no < max(n_pages) - 1 AS has_more "
          f"FROM capobs WHERE platform = 'dealercom' GROUP BY dealer, page_no "
          "UNION ALL SELECT DISTINCT dealer, page_no, CASE page_no % 10 WHEN 0 THEN 'trap' ELSE 'empty' END, "
          "CAST(0 AS INTEGER), false FROM capobs WHERE platform = 'dealercom' AND page_no % 10 IN (0, 1)", ("capobs",))
def q_capture_completeness(spark, sf):
    return X.completeness(DEALERCOM, _caps(spark, sf))


# ---------------------------------------------------------------- more platforms / layouts
from ..sources.custom_platform import CARLOT, build_carlot_captures  # noqa: E402
from ..sources.store import materialize_partitioned  # noqa: E402
from . import derived  # noqa: E402


@register("normalize_custom",
          "SELECT vin, dealer, 'CarLot' AS dealer_platform, 'https://carlot.example.com/cars/' || vin AS source_url, "
          "title, CASE WHEN year BETWEEN 1980 AND 2030 THEN year END AS year, model, trim, price, msrp, ext_color, "
          "int_color, odometer, options, page_no, pos FROM caprec WHERE m % 53 <> 0", ("caprec",))
def q_normalize_custom(spark, sf):
    caps = build_carlot_captures(derived.obs(spark, sf), inputs.dealer_pages(spark, sf), derived.LATE_OBS_COLUMNS)
    return N.normalize(CARLOT, caps).select(*N.ITEM_COLUMNS, "page_no", "pos")


def request_captures(spark, sf):
    """Captures of pages asked for by model and year, in folders of that request:
    a crawl for one model and year reads one folder, and payloads of other
    requests are neither read nor parsed."""
    from ..sources.captures import DEALING, build_captures

    def build():
        caps = build_captures(derived.obs(spark, sf), {"model": "req_model", "year": "req_year"}, late=derived.LATE_OBS_COLUMNS)
        # a few files a folder, however large one request is
        salt = F.pmod(F.xxhash64("source_url", "capture_kind"), F.lit(4))
        return caps.repartition("req_model", "req_year", salt)
    with at_most(spark, DEALING):
        return materialize_partitioned(spark, "request_captures", build, inputs.key(spark, sf), ["req_model", "req_year"])


@register("capture_pruned",
          f"SELECT {ITEM_SQL} FROM expected_request_items WHERE reject_reason IS NULL AND model = 'iX' AND year = 2016",
          ("expected_request_items",))
def q_capture_pruned(spark, sf):
    caps = request_captures(spark, sf).where((F.col("req_model") == "iX") & (F.col("req_year") == 2016))
    return N.normalize_all([DEALERCOM, ROADSTER], caps)
