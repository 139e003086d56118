"""Capture table: the dealer inventory pages as they arrive, one JSON payload
per page, built from the sighting history so that extraction and
normalisation have a full-size, realistic input.

Each dealer's sightings are spread over pages of about 18 vehicles (the page
size of the larger vendor).  A page is packed into one of the vendor payload
shapes (primary and fallback list paths), and each vehicle record uses one of
the field spellings and value forms seen in the wild (aliases, '$62,500'
strings, nested colour objects, '1,234 miles', relative links, list-valued
fields).  A few records are broken on purpose (no VIN, not an object, an
object where a number belongs) and some pages are failed captures that must
yield no rows.

Scale: the page of a sighting is a pure function of its keys and the dealer's
page count, so there is no per-dealer window: one partial aggregate (count per
dealer, written by ``inputs.dealer_pages``), one join back, one shuffle of the
sightings by (dealer, page); the JSON is made behind it.  The counts are broadcast
for that join up to ``BROADCAST_GROUPS`` of them.  Columns that follow from others are
left out of that shuffle (``late``), and the tasks that write it are kept small
(``DEALING``), so that none has to spill the rows it deals.  A dealer holding a third
of all rows spreads over as many page groups as it has pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_SIZE = 18
# Pages that one task puts together: some 100 MB of JSON, whatever the size of the input.
PAGES_PER_TASK = 6000
# Page counts (a dealer each) that a join sends to all tasks, some 50 MB; more of them are joined by a shuffle.
BROADCAST_GROUPS = 1_000_000
# What a task reads before it deals its rows out: some half a million to a million narrow rows, which a
# task's share of memory holds.  By default it is 64 or 128 MB, several million rows once the input is large.
DEALING = {"spark.sql.files.maxPartitionBytes": "16m", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16m",
           "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m"}
# An odometer no integer column holds, and a relative link through five folders
# whose query holds dot segments of its own.
TOO_LARGE = 9_999_999_999
DEEP_LINK = ("a/b/c/d/e/../../../../.././vehicle/", "?next=/x/../y")

# Page shapes: JSON wrappers around the vehicle list text ``%s``.
DEALERCOM_SHAPES = [
    ("DDC.InvData.inventory.inventory", '{"DDC":{"InvData":{"inventory":{"inventory":%s,"pageInfo":{}}}}}'),
    ("DDC.inventory", '{"DDC":{"inventory":%s}}'),
    ("inventory", '{"inventory":%s}'),
    ("_DDC.InvData.inventory", '{"_DDC":{"InvData":{"inventory":%s}}}'),
    ("ddc.InvData.inventory", '{"ddc":{"InvData":{"inventory":%s}}}'),
    ("DDC.inventoryData", '{"DDC":{"inventoryData":%s}}'),
    ("DDC.InvData.vehicles", '{"DDC":{"InvData":{"vehicles":%s}}}'),
    ("inventory", '{"DDC":{"inventory":[],"accounts":{}},"inventory":%s}'),
]
ROADSTER_SHAPES = [
    ("search.vehicles", '{"search":{"vehicles":%s,"filters":{}}}'),
    ("search.new_inventory", '{"search":{"new_inventory":%s}}'),
    ("search.results", '{"search":{"results":%s}}'),
    ("vehicles", '{"vehicles":%s}'),
    ("results", '{"results":%s}'),
    ("search.results", '{"search":{"vehicles":[],"results":%s}}'),
]
# Failed captures (no rows may come out of them).
DEALERCOM_TRAP = '{"DDC":{"InvData":{"inventory":{}}},"inventory":%s}'
ROADSTER_TRAP = '{"search":[],"vehicles":%s}'


def _v(c: Column) -> Column:
    return c.cast("variant")


def _money(x: Column, decimals: int = 2) -> Column:
    return F.format_number(x, decimals)


def variation_key() -> Column:
    return F.col("l_orderkey") * 8 + F.col("l_linenumber")


# Keys that hold text only are plain strings, the others variants: a variant's text is
# written to JSON by a generator of its own.
def _dealercom_record(m: Column) -> Column:
    price = F.col("price")
    has_price = price.isNotNull()
    words = F.transform(F.split(F.col("model"), " "), lambda w: w.cast("variant"))
    model_list = F.concat(words, F.array(_v(F.lit("")), _v(F.lit(0)), _v(F.lit(False)), F.parse_json(F.lit("[]"))))
    fields = {
        "vin": F.when((m % 53 != 0) & (m % 2 == 0), F.col("vin")),
        "VIN": F.when((m % 53 != 0) & (m % 2 == 1), F.col("vin")),
        "year": F.when(m % 3 == 0, _v(F.col("year"))).when(m % 3 == 2, _v(F.col("year").cast("string"))),
        "Year": F.when(m % 3 == 1, F.col("year").cast("string")),
        "make": F.when(m % 2 == 0, F.lit("BMW")),
        "Make": F.when(m % 2 == 1, F.lit("BMW")),
        "model": F.when(m % 5 == 0, _v(model_list)).when(m % 5 >= 2, _v(F.col("model"))),
        "Model": F.when(m % 5 == 1, F.col("model")),
        "trim": F.when(m % 3 == 0, F.col("trim")),
        "Trim": F.when(m % 3 == 1, F.col("trim")),
        "series": F.when(m % 3 == 2, F.col("trim")),
        "title": F.when(m % 4 >= 2, F.col("title")),
        "vehicleTitle": F.when(m % 4 == 1, F.col("title")),
        "price": F.when(has_price & (m % 4 == 0), _v(price)).when(has_price & (m % 4 == 2), _v(F.lit("Call"))),
        "sellingPrice": F.when(has_price & (m % 4 == 1), F.concat(F.lit("$"), _money(price))),
        "internetPrice": F.when(has_price & (m % 4 == 2), _v(price))
                          .when(has_price & (m % 4 == 3), _v(price.cast("string"))),
        "msrp": F.when(m % 3 == 0, _v(F.col("msrp"))),
        "MSRP": F.when(m % 3 == 1, F.concat(F.lit("$"), _money(F.col("msrp")))),
        "listPrice": F.when(m % 3 == 2, _v(F.col("msrp"))),
        "extColor": F.when(m % 4 == 0, F.col("ext_color")).when(m % 4 == 3, F.lit("")),
        "exteriorColor": F.when(m % 4 == 1, F.col("ext_color")).when(m % 4 == 3, F.col("ext_color")),
        "ext_color": F.when(m % 4 == 2, F.col("ext_color")),
        "intColor": F.when(m % 3 == 0, F.col("int_color")),
        "interiorColor": F.when(m % 3 == 1, F.col("int_color")),
        "int_color": F.when(m % 3 == 2, F.col("int_color")),
        "odometer": F.when(m % 89 == 0, _v(F.lit(TOO_LARGE))).when(m % 3 == 0, _v(F.col("odometer"))),
        "mileage": F.when(m % 3 == 1, _money(F.col("odometer"), 0)),
        "miles": F.when(m % 3 == 2, _v(F.col("odometer"))),
        "options": F.when(m % 2 == 0, F.parse_json(F.col("options"))),
        "packageCodes": F.when(m % 2 == 1, F.col("options")),
    }
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def _roadster_record(m: Column) -> Column:
    price = F.col("price")
    has_price = price.isNotNull()
    money = F.concat(F.lit("$"), _money(price))
    price_v = (F.when(m % 5 == 0, _v(price))
               .when(m % 5 == 1, _v(money))
               .when(m % 5 == 2, F.to_variant_object(F.struct(money.alias("value"))))
               .when(m % 5 == 3, F.to_variant_object(F.struct(price.alias("amount"))))
               .otherwise(_v(F.concat(F.lit("Call for price: "), money))))
    price_key = F.when(m % 7 == 0, "dealer_starting_price").when(m % 2 == 0, "price").otherwise("asking_price")
    c = F.col("ext_color")
    ext = (F.when(m % 4 == 0, F.to_variant_object(F.struct(c.alias("label"), F.concat(F.lit("x-"), c).alias("id"))))
           .when(m % 4 == 1, F.to_variant_object(F.struct(c.alias("id"))))
           .when(m % 4 == 2, _v(c))
           .otherwise(F.to_variant_object(F.struct(F.lit("").alias("label"), c.alias("id")))))
    ic = F.col("int_color")
    inter = F.when(ic.isNotNull(), F.when(m % 2 == 0, F.to_variant_object(F.struct(ic.alias("label"))))
                   .otherwise(_v(ic)))
    odo = F.col("odometer")
    vin = F.col("vin")
    fields = {
        "vin": F.when((m % 53 != 0) & (m % 2 == 0), vin),
        "VIN": F.when((m % 53 != 0) & (m % 2 == 1), vin),
        "year": F.when(m % 3 == 1, _v(F.col("year").cast("string"))).otherwise(_v(F.col("year"))),
        "make": F.when(m % 2 == 0, F.lit("BMW")),
        "model": F.when(m % 2 == 0, F.col("model")),
        "submodel": F.when(m % 2 == 1, F.col("model")),
        "trim": F.when(m % 2 == 0, F.col("trim")),
        "series": F.when(m % 2 == 1, F.col("trim")),
        "title": F.when(m % 3 == 2, F.col("title")),
        "name": F.when(m % 3 == 1, F.col("title")),
        "price": F.when(has_price & (price_key == "price"), price_v),
        "asking_price": F.when(has_price & (price_key == "asking_price"), price_v),
        "dealer_starting_price": F.when(has_price & (price_key == "dealer_starting_price"), price_v),
        "calc_msrp": F.when(m % 3 == 0, _v(F.col("msrp"))),
        "msrp": F.when(m % 3 == 1, _v(F.col("msrp"))),
        "original_price": F.when(m % 3 == 2, F.concat(F.lit("$"), _money(F.col("msrp")))),
        "exterior_color": ext,
        "interior_color": inter,
        "mileage": F.when(m % 97 == 0, F.to_variant_object(F.struct(odo.alias("value"))))
                    .when(m % 89 == 0, _v(F.lit(1e30)))
                    .when(m % 3 == 0, _v(odo))
                    .when(m % 3 == 1, _v(F.concat(_money(odo, 0), F.lit(" miles")))),
        "odometer": F.when((m % 97 != 0) & (m % 3 == 2), _v(odo)),
        "url": F.when(m % 4 == 0, F.concat(F.lit("/inventory/vehicle/"), vin))
                .when(m % 4 == 1, F.concat(F.lit("https://cdn.example.com/v/"), vin)),
        "detail_url": F.when(m % 4 == 2, F.concat(F.lit(DEEP_LINK[0]), vin, F.lit(DEEP_LINK[1]))),
        "options": F.when(m % 2 == 0, F.parse_json(F.col("options"))),
        "packages": F.when(m % 2 == 1, F.parse_json(F.col("options"))),
    }
    return F.struct(*[c.alias(k) for k, c in fields.items()])


def page_url(platform: Column, dealer_key: Column, page_no: Column) -> Column:
    k = dealer_key.cast("string")
    return F.when(platform == "roadster",
                  F.concat(F.lit("https://express.dealer"), k, F.lit(".example.com/inventory?page="),
                           page_no.cast("string"))) \
            .otherwise(F.concat(F.lit("https://www.dealer"), k, F.lit(".example.com/new-inventory/index.htm?start="),
                                (page_no * PAGE_SIZE).cast("string")))


def page_counts(obs: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pages of each dealer (and of further columns ``by``)."""
    keys = ["dealer_key", *by]
    counts = obs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.select(*keys, F.ceil(F.col("_n") / PAGE_SIZE).cast("bigint").alias("n_pages"))


def assign_pages(obs: DataFrame, by: tuple[str, ...] = (), counts: DataFrame | None = None,
                 late: dict[str, str] | None = None) -> DataFrame:
    """Page of each sighting: ``pmod(mix(keys), n_pages)``, pages being counted
    per dealer (and per further columns ``by``).

    ``counts``: ``page_counts`` of the sightings, written before; they are few, so the
    sightings meet them where they are.  Without it they are counted in the same plan.

    ``late``: SQL of columns that follow from others (or from late ones before them); they
    are not shuffled but worked out behind it.

    The rows come dealt by page, in as many partitions as the number of pages asks
    for: what is derived of a sighting afterwards is not shuffled, and a task's share
    stays the same however large the input is."""
    spark = obs.sparkSession
    keys = ["dealer_key", *by]
    written, counts = counts is not None, page_counts(obs, by) if counts is None else counts
    groups, total = counts.agg(F.count(F.lit(1)), F.sum("n_pages")).first()
    mix = F.col("l_orderkey") * 7919 + F.col("l_linenumber") * 31 + F.col("id")
    few = F.broadcast(counts) if written and groups <= BROADCAST_GROUPS else counts
    late = {c: sql for c, sql in (late or {}).items() if c not in keys}
    o = obs.drop(*late).join(few, keys).withColumn("page_no", F.pmod(mix, F.col("n_pages")))
    tasks = max((total or 0) // PAGES_PER_TASK + 1, spark.sparkContext.defaultParallelism)
    o = o.repartition(tasks, "dealer_key", "page_no", *by)
    for c, sql in late.items():
        o = o.withColumn(c, F.expr(sql))
    return o.withColumn("m", variation_key())


def _wrap(shapes, idx: Column) -> Column:
    expr = None
    for i, (_, tmpl) in enumerate(shapes):
        pre, post = tmpl.split("%s")
        val = F.concat(F.lit(pre), F.col("_list"), F.lit(post))
        expr = F.when(idx == i, val) if expr is None else expr.when(idx == i, val)
    return expr


def build_captures(obs: DataFrame, request: dict[str, str] | None = None, counts: DataFrame | None = None,
                   late: dict[str, str] | None = None) -> DataFrame:
    """Pages of vendor payloads (JSON text) from sightings; see module doc.
    ``counts``: their ``page_counts``, if they are written; ``late``: see ``assign_pages``.

    ``request`` names columns of the sightings that were asked for by the
    crawl (source column -> capture column): pages then hold one value of each,
    and the capture carries them as columns."""
    request = request or {}
    o = assign_pages(obs, tuple(request), counts, late)
    platform = F.when(F.col("dealer_platform") == "Roadster", "roadster").otherwise("dealercom")
    m = F.col("m")
    keep_nulls = F.col("page_no") % 2 == 1
    rec_json = (F.when(m % 101 == 0, F.lit('"broken"'))
                .when(F.col("platform") == "roadster", F.to_json(_roadster_record(m)))
                .when(keep_nulls, F.to_json(_dealercom_record(m), {"ignoreNullFields": "false"}))
                .otherwise(F.to_json(_dealercom_record(m))))
    o = o.withColumn("platform", platform).withColumn("rec", rec_json)
    for column, name in request.items():
        o = o.withColumn(name, F.col(column))
    # dealt by page already (``assign_pages``), under the names of the sightings' columns
    pages = o.groupBy("dealer_key", "page_no", *request, *request.values(), "dealer", "platform", "n_pages").agg(
        F.sort_array(F.collect_list(F.struct("m", "vin", "scraped_at", "rec"))).alias("_recs"),
        F.max("scraped_at").alias("captured_at"))
    pages = pages.withColumn("_list", F.concat(
        F.lit("["), F.array_join(F.transform("_recs", lambda x: x["rec"]), ","), F.lit("]")))
    shape = lambda shapes: F.pmod(F.col("page_no") + F.col("dealer_key"), F.lit(len(shapes)))
    roadster = F.col("platform") == "roadster"
    payload = F.when(roadster, _wrap(ROADSTER_SHAPES, shape(ROADSTER_SHAPES))).otherwise(
        _wrap(DEALERCOM_SHAPES, shape(DEALERCOM_SHAPES)))
    # Failed captures of some pages: the list sits where the reader must not look, or there is none.
    trap = F.replace(F.when(roadster, F.lit(ROADSTER_TRAP)).otherwise(F.lit(DEALERCOM_TRAP)), F.lit("%s"), F.col("_list"))
    empty = F.when(roadster, F.when(F.col("page_no") % 20 == 1, F.lit("null")).otherwise(F.lit('"text"'))).otherwise(F.lit("{}"))
    kind = lambda name, text: F.struct(F.lit(name).alias("capture_kind"), text.alias("payload"))
    kinds = F.filter(F.array(kind("page", payload), F.when(F.col("page_no") % 10 == 0, kind("trap", trap)),
                             F.when(F.col("page_no") % 10 == 1, kind("empty", empty))), lambda k: k.isNotNull())
    url = page_url(F.col("platform"), F.col("dealer_key"), F.col("page_no"))
    next_url = F.when(F.col("page_no") < F.col("n_pages") - 1,
                      page_url(F.col("platform"), F.col("dealer_key"), F.col("page_no") + 1))
    # outer, though there is always one: a plain explode has its array worked out twice (by an inferred filter)
    return pages.withColumn("_kind", F.explode_outer(kinds)).select(
        "dealer", "platform", F.col("page_no").cast("bigint").alias("page_no"), url.alias("source_url"),
        next_url.alias("next_url"), "captured_at", "_kind.payload", "_kind.capture_kind", *request.values())
