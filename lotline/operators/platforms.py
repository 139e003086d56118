"""Platform specs as data: where the vehicle list sits in a captured page and
how each listing field is read (aliases + coercion rule).

Adding a platform = adding one ``PlatformSpec``; ``extract`` and
``normalize`` generate the column expressions from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class FieldRule:
    kind: str                       # coercion rule, see normalize.FIELD_BUILDERS
    keys: tuple[str, ...] = ()
    default: object = None
    extra: dict = field(default_factory=dict)


@dataclass(frozen=True)
class PlatformSpec:
    name: str                        # configuration name, e.g. 'dealercom'
    label: str                       # stored platform label, e.g. 'Dealer.com'
    # Gate: when this path exists the list is read from ``primary`` only.
    gate: str | None
    primary: str | None
    # Fallback list paths, first non-empty list wins (non-lists are skipped).
    paths: tuple[str, ...]
    # Container that must be an object when present (else no rows at all).
    object_parent: str | None
    fields: dict[str, FieldRule]
    # Record-level rejects beyond 'no_vin' / 'not_object': reason -> field.
    row_errors: tuple[str, ...] = ()


# List paths and field aliases of the supported vendors.
DEALERCOM = PlatformSpec(
    name="dealercom",
    label="Dealer.com",
    gate="DDC.InvData.inventory",
    primary="DDC.InvData.inventory.inventory",
    paths=("DDC.inventory", "inventory", "_DDC.InvData.inventory", "ddc.InvData.inventory",
           "DDC.inventoryData", "DDC.InvData.vehicles"),
    object_parent=None,
    fields={
        "vin": FieldRule("truthy_text", ("vin", "VIN")),
        "year": FieldRule("year_range", ("year", "Year"), extra={"lo": 1980, "hi": 2030}),
        "make": FieldRule("truthy_text", ("make", "Make"), default="BMW", extra={"join_lists": True}),
        "model": FieldRule("truthy_text", ("model", "Model"), default="",
                           extra={"join_lists": True, "absent_default": True}),
        "trim": FieldRule("truthy_text", ("trim", "Trim", "series"), extra={"join_lists": True}),
        "title": FieldRule("title_or_compose", ("title", "vehicleTitle")),
        "price": FieldRule("first_parsable_double", ("price", "sellingPrice", "internetPrice")),
        "msrp": FieldRule("first_parsable_double", ("msrp", "MSRP", "listPrice")),
        "ext_color": FieldRule("truthy_text", ("extColor", "exteriorColor", "ext_color")),
        "int_color": FieldRule("truthy_text", ("intColor", "interiorColor", "int_color")),
        "odometer": FieldRule("int_no_commas", ("odometer", "mileage", "miles")),
        "options": FieldRule("json_text", ("options", "packageCodes")),
        "source_url": FieldRule("page_url"),
    },
)

ROADSTER = PlatformSpec(
    name="roadster",
    label="Roadster",
    gate=None,
    primary=None,
    paths=("search.vehicles", "search.new_inventory", "search.results", "vehicles", "results"),
    object_parent="search",
    fields={
        "vin": FieldRule("truthy_text", ("vin", "VIN")),
        "year": FieldRule("raw_int", ("year",)),
        "make": FieldRule("key_default", ("make",), default="BMW"),
        "model": FieldRule("truthy_text", ("model", "submodel")),
        "trim": FieldRule("truthy_text", ("trim", "series")),
        "title": FieldRule("title_if_parts", ("title", "name")),
        "price": FieldRule("polymorphic_price", ("price", "asking_price", "dealer_starting_price")),
        "msrp": FieldRule("polymorphic_price", ("calc_msrp", "msrp", "original_price")),
        "ext_color": FieldRule("nested_label", ("exterior_color", "ext_color")),
        "int_color": FieldRule("nested_label", ("interior_color", "int_color")),
        "odometer": FieldRule("int_digits", ("mileage", "odometer")),
        "options": FieldRule("json_text", ("options", "packages")),
        "source_url": FieldRule("detail_url", ("url", "detail_url")),
    },
    row_errors=("bad_odometer", "bad_url"),
)

PLATFORMS = {p.name: p for p in (DEALERCOM, ROADSTER)}
