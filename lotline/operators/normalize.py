"""Vehicle record (VARIANT) -> typed 14-field listing item, per platform spec.

Every field is a column expression generated from its ``FieldRule``.  The
record is inspected in stages so each key is read and typed exactly once:

1. ``_k``: the values of all keys, in one pass over the record;
2. of each key ``_f<i>``: its value (VARIANT, SQL NULL when absent); ``_t<i>``: its variant
   type name (both NULL for a string); ``_s<i>``: its text, if it is a string; ``_d<i>``: its number,
   where a field is one; ``_b<i>``: its truthiness;
3. the same of each alias chain;

and the field builders combine those columns.  Each stage is a select of its own:
its columns are referred to more than once, so Spark does not merge it with the next.
The larger ones are kept out of whole-stage code (``in_small_methods``).
The reject reason is kept apart (``apart``), or a filter on it would be pushed below
the stages, each reference replaced by the whole expression.
A record that cannot become an item gets a ``reject_reason`` and is split
off instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions import variant as V
from ..functions.variant import try_cast
from ..sources.schemas import ITEM, ITEM_COLUMNS
from .extract import extract, key_column
from .platforms import PlatformSpec


def apart(df: DataFrame, cols: list[Column]) -> DataFrame:
    """``df`` with further columns that a filter above stays above of.  A filter is
    pushed below a plain select, its references replaced by their expressions, until the
    generated code is too long to compile; a generator of one row holds it back.  Only
    for a few small columns: the code of a generator's columns is one method, which
    the JVM does not compile beyond 8,000 bytes."""
    return df.select("*", F.inline(F.array(F.struct(*cols))))


def in_small_methods(c: Column) -> Column:
    """A boolean column as it is, in a form that keeps its select out of whole-stage code.  There
    a select is one method, which the JVM does not compile beyond 8,000 bytes but interprets, for
    each record; outside its code is split into many small ones."""
    return F.exists(F.array(c), lambda x: x)


# Kinds of fields that read a number.
NUMERIC = ("year_range", "raw_int", "first_parsable_double", "polymorphic_price", "int_no_commas", "int_digits")


class Rec:
    """Access to the staged key columns of a record."""

    def __init__(self, rules, keys, stored: frozenset[str] = frozenset()):
        # stored records have a column for each key, and one for their type
        self.stored = stored
        # Columns are named by position: keys such as 'vin' and 'VIN' differ
        # only by case, and column names resolve case-insensitively.
        self.keys = list(dict.fromkeys(keys))
        # what a field reads inside of a key's object is staged like a key
        self.inner = [(r.keys[0], k) for r in rules if r.kind == "nested_label" for k in ("label", "id")]
        self.idx = {k: i for i, k in enumerate([*self.keys, *dict.fromkeys(self.inner)])}
        self.numeric = {k for r in rules if r.kind in NUMERIC for k in r.keys}

    def v(self, k):
        return F.col(f"_f{self.idx[k]}")

    def t(self, k):
        return F.col(f"_t{self.idx[k]}")

    def s(self, k):
        return F.col(f"_s{self.idx[k]}")

    def d(self, k):
        return F.col(f"_d{self.idx[k]}") if k in self.numeric else F.lit(None).cast("double")

    def b(self, k):
        return F.col(f"_b{self.idx[k]}")

    def missing(self, k):
        return self.v(k).isNull() & self.s(k).isNull()

    def stages(self) -> list[list[Column]]:
        """Columns of each stage: the values of all keys, then what is known of each."""
        rec = F.col("rec")
        if self.stored:
            rec = rec[0]        # a list of one (``extract.shredded_records``)
            at = lambda k: F.col(f"`{key_column(k)}`") if key_column(k) in self.stored else V.get(rec, k)
            is_object = F.coalesce(F.col("kind") == "OBJECT", F.lit(False))
            # of the columns as they are Spark would have the scan read each variant in all the types asked for below
            first = [F.when(is_object, at(k)).alias(f"_k{i}") for i, k in enumerate(self.keys)]
            value = lambda k: F.col(f"_k{self.idx[k]}")
        else:
            first = [V.fields(rec, self.keys).alias("_k")]
            value = lambda k: F.col(f"_k._{self.idx[k]}")
            is_object = F.col("_k").isNotNull()
        known = [in_small_methods(is_object).alias("_obj_rec")]
        for k, i in self.idx.items():
            v = V.get(value(k[0]), k[1]) if isinstance(k, tuple) else value(k)
            # a string is carried on as its text only
            s = V.json_string(v)
            t = F.when(s.isNull(), F.schema_of_variant(v))
            d = V.number(v, t) if k in self.numeric else None
            known += [F.when(s.isNull(), v).alias(f"_f{i}"), t.alias(f"_t{i}"), s.alias(f"_s{i}"), V.truthy(v, t, s, d).alias(f"_b{i}")]
            if d is not None:
                known.append(d.alias(f"_d{i}"))
        return [first, known]

    staged_chains: dict = {}

    @staticmethod
    def _sig(rule):
        return (tuple(rule.keys), rule.default, bool(rule.extra.get("absent_default")))

    def stage_chains(self, rules) -> list[Column]:
        """Evaluate each distinct alias chain once into (value, type, text, number) columns;
        builders then refer to those columns instead of repeating the chain
        (keeps the generated code small and the row work single)."""
        self.staged_chains = {}
        cols = []
        for rule in rules:
            sig = self._sig(rule)
            if not rule.keys or sig in self.staged_chains or rule.kind in ("first_parsable_double", "nested_label"):
                continue
            i = len(self.staged_chains)
            names = [f"_c{x}{i}" for x in "vtsd"]
            cols += [c.alias(n) for c, n in zip(self._chain_expr(rule), names, strict=True)]
            self.staged_chains[sig] = tuple(F.col(n) for n in names)
        return cols

    def chain(self, rule) -> tuple[Column, Column, Column, Column]:
        """``a or b or c`` over the rule's keys (with its default) -> (value, type, text, number)."""
        sig = self._sig(rule)
        if sig in self.staged_chains:
            return self.staged_chains[sig]
        return self._chain_expr(rule)

    def _chain_expr(self, rule) -> tuple[Column, Column, Column, Column]:
        operands = [(self.v(k), self.t(k), self.s(k), self.d(k), self.b(k)) for k in rule.keys]
        if rule.default is not None:
            d = F.lit(rule.default).cast("variant")
            text = V.string(d)
            default = (F.when(text.isNull(), d), F.when(text.isNull(), F.schema_of_variant(d)), text, V.number(d), V.truthy(d))
            if rule.extra.get("absent_default"):
                # ``d.get(last_key, default)``: the default only replaces a missing key
                missing = self.missing(rule.keys[-1])
                operands[-1] = tuple(F.when(missing, x).otherwise(c) for x, c in zip(default, operands[-1], strict=True))
            else:
                operands.append(default)
        return V.first_truthy_typed(operands)


def b_truthy_text(r: Rec, rule, ctx):
    v, t, s, _ = r.chain(rule)
    return V.text_or_joined(v, t, s) if rule.extra.get("join_lists") else V.as_text(v, t, s)


def b_year_range(r: Rec, rule, ctx):
    v, t, s, d = r.chain(rule)
    n = V.to_long(v, None, t, s, d)
    ok = V.truthy(v, t, s) & n.between(rule.extra["lo"], rule.extra["hi"])
    return F.when(ok, n).cast("int")


def b_raw_int(r: Rec, rule, ctx):
    return try_cast(V.to_long(*_with_strip(None, r.chain(rule))), "int")


def b_key_default(r: Rec, rule, ctx):
    k = rule.keys[0]
    return F.when(r.missing(k), F.lit(rule.default)).otherwise(V.as_text(r.v(k), r.t(k), r.s(k)))


def b_first_parsable_double(r: Rec, rule, ctx):
    return F.coalesce(*[V.to_double(r.v(k), "$,", r.t(k), r.s(k), r.d(k)) for k in rule.keys])


def b_polymorphic_price(r: Rec, rule, ctx):
    return V.polymorphic_price(*r.chain(rule))


def b_int_no_commas(r: Rec, rule, ctx):
    return try_cast(V.to_long(*_with_strip(",", r.chain(rule))), "int")


def b_int_digits(r: Rec, rule, ctx):
    v, t, s, d = r.chain(rule)
    digits = F.regexp_replace(s, "[^0-9]", "")
    return F.when(s.isNotNull(), F.when(digits != "", try_cast(digits, "int"))).otherwise(try_cast(V.to_long(v, None, t, s, d), "int"))


def _with_strip(strip_chars: str | None, chain: tuple[Column, ...]) -> tuple:
    v, *known = chain
    return v, strip_chars, *known


def b_nested_label(r: Rec, rule, ctx):
    obj, flat = rule.keys
    label, ident = (obj, "label"), (obj, "id")
    named = F.when(r.b(label), V.as_text(r.v(label), r.t(label), r.s(label))).otherwise(V.as_text(r.v(ident), r.t(ident), r.s(ident)))
    plain = F.when(r.b(flat), V.as_text(r.v(flat), r.t(flat), r.s(flat))).otherwise(V.as_text(r.v(obj), r.t(obj), r.s(obj)))
    return F.when(r.missing(obj) | V.is_object(r.v(obj), r.t(obj)), named).when(r.b(obj), plain)


def b_json_text(r: Rec, rule, ctx):
    v, t, s, _ = r.chain(rule)
    return V.as_text(v, t, s)       # lists and objects are JSON text there


def b_page_url(r: Rec, rule, ctx):
    return ctx["source_url"]


def b_detail_url(r: Rec, rule, ctx):
    v, t, s, _ = r.chain(rule)
    return U.vehicle_url(ctx["source_url"], V.as_text(v, t, s))


FIELD_BUILDERS = {
    "truthy_text": b_truthy_text,
    "year_range": b_year_range,
    "raw_int": b_raw_int,
    "key_default": b_key_default,
    "first_parsable_double": b_first_parsable_double,
    "polymorphic_price": b_polymorphic_price,
    "int_no_commas": b_int_no_commas,
    "int_digits": b_int_digits,
    "nested_label": b_nested_label,
    "json_text": b_json_text,
    "page_url": b_page_url,
    "detail_url": b_detail_url,
}


def _title(spec: PlatformSpec, r: Rec) -> Column:
    """The title, over the finished columns of the other fields."""
    rule = spec.fields["title"]
    given, gt, gs, _ = r.chain(rule)
    given_ok = V.truthy(given, gt, gs)
    if rule.kind == "title_or_compose":
        # Missing title: "{year} {make} {model} {trim}" with absent parts
        # written as 'None', outer whitespace stripped.
        composed = F.regexp_replace(F.concat_ws(" ", F.coalesce(F.col("_year").cast("string"), F.lit("None")),
                                                F.coalesce(F.col("_make"), F.lit("None")),
                                                F.coalesce(F.col("_model"), F.lit("None")),
                                                F.coalesce(F.col("_trim"), F.lit("None"))), r"^\s+|\s+$", "")
        return F.when(given_ok, V.text_or_joined(given, gt, gs)).otherwise(composed)
    if rule.kind == "title_if_parts":
        # Only when year, make and model are all truthy; trim appended if truthy.
        year_v, year_t, year_s, _ = r.chain(spec.fields["year"])
        make_ok = r.missing("make") | r.b("make")
        model_v, model_t, model_s, _ = r.chain(spec.fields["model"])
        trim_v, trim_t, trim_s, _ = r.chain(spec.fields["trim"])
        base = F.concat_ws(" ", V.as_text(year_v, year_t, year_s), F.col("_make"), V.as_text(model_v, model_t, model_s))
        composed = F.when(V.truthy(trim_v, trim_t, trim_s), F.concat_ws(" ", base, V.as_text(trim_v, trim_t, trim_s))) \
                    .otherwise(base)
        can = V.truthy(year_v, year_t, year_s) & make_ok & V.truthy(model_v, model_t, model_s)
        return F.when(given_ok, V.as_text(given, gt, gs)).when(can, composed).otherwise(V.as_text(given, gt, gs))
    raise ValueError(rule.kind)


def _row_errors(spec: PlatformSpec, r: Rec) -> dict[str, Column]:
    errs = {}
    if "bad_odometer" in spec.row_errors:
        v, t, *_ = r.chain(spec.fields["odometer"])
        errs["bad_odometer"] = V.present(v) & ~(V.is_number(v, t) | V.is_bool(v, t))
    if "bad_url" in spec.row_errors:
        v, t, s, _ = r.chain(spec.fields["source_url"])
        errs["bad_url"] = V.truthy(v, t, s) & s.isNull()
    return errs


def needed_fields(spec: PlatformSpec, fields: tuple[str, ...] | None) -> list[str]:
    """Fields whose keys have to be read for ``fields`` (None: all) and for the reject reason."""
    if fields is None:
        return list(spec.fields)
    want = {*fields, "vin"} | {f for f, e in (("odometer", "bad_odometer"), ("source_url", "bad_url")) if e in spec.row_errors}
    if "title" in want:
        want |= {"year", "make", "model", "trim"}
    return [f for f in spec.fields if f in want]


def spec_keys(spec: PlatformSpec, fields: tuple[str, ...] | None = None) -> list[str]:
    names = needed_fields(spec, fields)
    keys = ["make"] if "make" in names else []
    for name in names:
        keys.extend(spec.fields[name].keys)
    return keys


_PLANS: dict[tuple, tuple] = {}


def _plan(spec: PlatformSpec, fields: tuple[str, ...] | None = None,
          stored: frozenset[str] = frozenset()) -> tuple[list[list[Column]], Column, list[Column], list[Column]]:
    """(stages, reject reason, field columns, item columns) of a platform.  They do not depend
    on the data, so they are built once: each part of an expression costs a
    call into the JVM."""
    known = _PLANS.get((id(spec), fields, stored))
    if known is not None:
        return known[1]
    names = needed_fields(spec, fields)
    r = Rec([spec.fields[n] for n in names], spec_keys(spec, fields), stored)
    stages = r.stages()
    chains = r.stage_chains([spec.fields[n] for n in names])
    stages.append([in_small_methods(F.col("_obj_rec")).alias("_is_obj"), *chains])
    vin = r.chain(spec.fields["vin"])
    reason = F.when(~F.col("_is_obj"), F.lit("not_object")) \
              .when(~V.truthy(*vin[:3]), F.lit("no_vin")) \
              .when(V.is_array(*vin[:2]) | V.is_object(*vin[:2]), F.lit("bad_vin"))
    for name, cond in _row_errors(spec, r).items():
        reason = reason.when(cond, F.lit(name))
    ctx = {"source_url": F.col("source_url")}
    wanted = [c for c in ITEM_COLUMNS if c in names and c != "dealer" and (fields is None or c in fields)]
    # the parts of a title are worked out once, below it
    parts = ["year", "make", "model", "trim"] if "title" in wanted else []
    built = [FIELD_BUILDERS[spec.fields[n].kind](r, spec.fields[n], ctx).alias(f"_{n}")
             for n in names if n != "title" and (n in wanted or n in parts)]
    out = [(_title(spec, r) if c == "title" else F.col(f"_{c}")).cast(ITEM[c].dataType).alias(c) for c in wanted]
    _PLANS[id(spec), fields, stored] = (spec, (stages, reason.alias("reject_reason"), built, out))
    return _PLANS[id(spec), fields, stored][1]


def normalize_records(spec: PlatformSpec, records: DataFrame, fields: tuple[str, ...] | None = None) -> DataFrame:
    """records(dealer, source_url, rec, ...) -> items + ``reject_reason``.

    ``fields``: item fields to work out; only their keys (and those that a reject
    reason depends on) are looked up.  With stored records (``extract.shredded_records``)
    no other key's column is read from the file; a key without a column is looked up
    in the whole record."""
    stored = frozenset(c for c in records.columns if c == "kind" or c.startswith("k_")) if "kind" in records.columns else frozenset()
    keep = [c for c in records.columns if c != "rec" and c not in stored]
    stages, reason, built, out = _plan(spec, fields, stored)
    # the first stage of stored records is the scan's own projection: it reads their columns
    staged = records.select(*keep, *(["kind"] if stored else []), *stages[0])
    for stage in stages[1:]:
        staged = staged.select("*", *stage)
    staged = apart(staged, [reason]).select("*", *built)
    return staged.select(*[c for c in keep if c != "source_url"], *out,
                         F.lit(spec.label).alias("dealer_platform"), "reject_reason")


def split_items(specs, records: DataFrame, path: str) -> dict[str, int]:
    """Items and rejects of stored records (with a ``platform`` column) in one pass: one
    write to ``path`` in folders by platform and ``reject_reason`` (null: accepted).
    Returns {'records', 'rejected'}, counted along the way (``observe``)."""
    parts = [normalize_records(spec, records.where(F.col("platform") == spec.name)) for spec in specs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    seen = Observation()
    out = out.observe(seen, F.count(F.lit(1)).alias("records"), F.count("reject_reason").alias("rejected"))
    out.write.partitionBy("platform", "reject_reason").parquet(path)
    return seen.get


def normalize(spec: PlatformSpec, captures: DataFrame, with_rejects: bool = False) -> DataFrame:
    """Captures of one platform -> accepted listing items (14 columns + page keys).

    ``with_rejects=True`` keeps every record with its ``reject_reason``."""
    recs = extract(spec, captures)
    out = normalize_records(spec, recs)
    if not with_rejects:
        out = out.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return out


def items(df: DataFrame) -> DataFrame:
    """Project to the 14 item columns in declared order."""
    return df.select(*ITEM_COLUMNS)


def normalize_all(platform_specs, captures: DataFrame) -> DataFrame:
    """Route each capture to its platform's normaliser and union the items."""
    parts = [items(normalize(spec, captures)) for spec in platform_specs]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
