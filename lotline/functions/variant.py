"""Column builders over VARIANT values with dynamic-language semantics.

Captured payloads are schemaless: a field may be a number in one record, a
string such as ``'$62,500'`` in the next and an object in a third.  These
builders reproduce the truthiness, alias-chain and number-coercion rules the
listing normalisers depend on, entirely as built-in expressions (no UDF).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def try_cast(c: Column, t: str) -> Column:
    """Cast that yields NULL instead of failing."""
    return c.try_cast(t)


NUMERIC_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT")


def _path(key: str) -> str:
    if key.replace("_", "").isalnum():
        return f"$.{key}"
    return "$['" + key.replace("'", "\\'") + "']"


def get(v: Column, key: str) -> Column:
    """Field of an object variant as a variant; SQL NULL when absent or not an object."""
    return F.try_variant_get(v, _path(key), "variant")


def fields(v: Column, keys: list[str]) -> Column:
    """Values of an object's keys as a struct of variants ``_0``, ``_1``, ... (SQL NULL: absent), SQL NULL
    when ``v`` is no object.  The object is gone through once; a look-up reads field names until it finds its key."""
    read = ", ".join(f"`{k.replace('`', '``')}`: variant" for k in keys)
    # named by position: keys may differ by case only
    return F.try_variant_get(v, "$", f"struct<{read}>").cast("struct<" + ", ".join(f"_{i}: variant" for i in range(len(keys))) + ">")


def get_path(v: Column, dotted: str) -> Column:
    """Nested field ``a.b.c`` as a variant (SQL NULL when any step is missing)."""
    return F.try_variant_get(v, "$." + dotted, "variant")


def vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_object(v: Column, t: Column | None = None) -> Column:
    return F.coalesce((vtype(v) if t is None else t).startswith("OBJECT"), F.lit(False))


def is_object_cheap(v: Column) -> Column:
    """Object test without rendering the value's full schema: an object casts
    to an empty struct, anything else does not."""
    return F.try_variant_get(v, "$", "struct<>").isNotNull()


def object_at(v: Column, path: str) -> Column:
    """True when ``path`` holds an object (nothing of it is copied)."""
    return F.try_variant_get(v, "$." + path, "struct<>").isNotNull()


def size_at(v: Column, path: str) -> Column:
    """Members of the array at ``path``, SQL NULL when it is no array.  The members are
    read as booleans, which an object is not: as variants each would be built anew, as
    empty structs the names of all their fields would be."""
    return F.size(F.try_variant_get(v, "$" + ("." + path if path else ""), "array<boolean>"))


def exists_at(v: Column, path: str) -> Column:
    """True when ``path`` is there, be it JSON null (objects and lists are not copied)."""
    return object_at(v, path) | size_at(v, path).isNotNull() | get_path(v, path).isNotNull()


def nonempty_array_at(v: Column, path: str) -> Column:
    """True when ``path`` holds an array with at least one member (no member is copied)."""
    return F.coalesce(size_at(v, path) > 0, F.lit(False))


def is_array(v: Column, t: Column | None = None) -> Column:
    return F.coalesce((vtype(v) if t is None else t).startswith("ARRAY"), F.lit(False))


def is_string(v: Column, t: Column | None = None) -> Column:
    return F.coalesce((vtype(v) if t is None else t) == "STRING", F.lit(False))


def is_number(v: Column, t: Column | None = None) -> Column:
    t = vtype(v) if t is None else t
    return F.coalesce(t.isin(*NUMERIC_TYPES) | t.startswith("DECIMAL"), F.lit(False))


def is_bool(v: Column, t: Column | None = None) -> Column:
    return F.coalesce((vtype(v) if t is None else t) == "BOOLEAN", F.lit(False))


def present(v: Column) -> Column:
    """The value exists and is not JSON null (a dynamic ``is not None``)."""
    return F.coalesce(v.isNotNull() & ~F.is_variant_null(v), F.lit(False))


def string(v: Column, t: Column | None = None) -> Column:
    """The text of a string value, SQL NULL for anything else."""
    return F.when((vtype(v) if t is None else t) == "STRING", F.try_variant_get(v, "$", "string"))


def json_string(v: Column) -> Column:
    """``string`` of a value that JSON can hold, without its type: of those a string alone is read as binary."""
    return F.try_variant_get(v, "$", "binary").cast("string")


def number(v: Column, t: Column | None = None) -> Column:
    """A number or boolean as a float, SQL NULL for anything else."""
    return F.when(is_number(v, t) | is_bool(v, t), F.try_variant_get(v, "$", "double"))


# In what follows ``s`` is the value's ``string`` and ``d`` its ``number``, if they are worked out before: each
# reading of a variant costs about a microsecond.  Value and type of a string may then be SQL NULL.
def truthy(v: Column, t: Column | None = None, s: Column | None = None, d: Column | None = None) -> Column:
    """Dynamic truthiness: missing, null, '', 0, 0.0, false, [] and {} are false;
    '0', 'false', ' ', [0] and {"a": null} are true.  Never NULL."""
    t = vtype(v) if t is None else t
    if s is not None:
        return (F.when(t.isNull() | s.isNotNull(), F.coalesce(s != "", F.lit(False)))
                .when(t.startswith("ARRAY"), F.try_variant_get(v, "$[0]", "variant").isNotNull())
                .when(t.startswith("OBJECT"), t != "OBJECT<>")
                .when(t == "BOOLEAN", F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False)))
                .otherwise(F.coalesce((F.try_variant_get(v, "$", "double") if d is None else d) != 0, F.lit(False))))
    test = (F.when(t == "STRING", F.try_variant_get(v, "$", "string") != "")
            .when(t.startswith("ARRAY") | t.startswith("OBJECT"), ~F.to_json(v).isin("[]", "{}"))
            .when(t == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .otherwise(F.try_variant_get(v, "$", "double") != 0))
    return F.coalesce(present(v) & test, F.lit(False))


def first_truthy_typed(operands: list[tuple[Column, ...]]) -> tuple[Column, ...]:
    """``first_truthy`` over precomputed (value, type, ..., truthy) columns; returns
    (value, type, ...) of the chosen operand so later tests need no re-inspection."""
    *others, last = operands
    chosen = []
    for i, c in enumerate(last[:-1]):
        case = F
        for o in others:
            case = case.when(o[-1], o[i])
        chosen.append(case.otherwise(c) if others else c)
    return tuple(chosen)


def first_truthy(*vs: Column) -> Column:
    """``a or b or c``: the first truthy operand, else the last operand as it is."""
    if len(vs) == 1:
        return vs[0]
    expr = F.when(truthy(vs[0]), vs[0])
    for v in vs[1:-1]:
        expr = expr.when(truthy(v), v)
    return expr.otherwise(vs[-1])


def as_text(v: Column, t: Column | None = None, s: Column | None = None) -> Column:
    """Variant rendered as text: strings as they are, anything else as JSON text."""
    if s is not None:
        return F.coalesce(s, F.when(present(v), F.to_json(v)))
    return (F.when(~present(v), F.lit(None).cast("string"))
            .when(is_string(v, t), F.try_variant_get(v, "$", "string"))
            .otherwise(F.to_json(v)))


def _only(s: Column, allowed: str) -> Column:
    """True when ``s`` consists of the ``allowed`` characters only (no regex)."""
    return F.translate(s, allowed, "") == ""


def _joined_digits(s: Column) -> Column:
    """Number text with the single underscores between its digits taken out ('1_000')."""
    return F.when(s.contains("_"), F.regexp_replace(s, r"(?<=[0-9])_(?=[0-9])", "")).otherwise(s)


def text_to_double(s: Column) -> Column:
    """Strict float parse of text: the whole string must be a number.

    The character check rules out what the JVM parser would also accept
    (type suffixes such as '12d', hex floats, 'NaN' / 'Infinity'); the cast
    then rejects malformed arrangements ('1.2.3', '1e', '+-1')."""
    s = _joined_digits(s)
    return F.when(_only(s, "0123456789.eE+- \t\n\r"), try_cast(s, "double"))


def text_to_long(s: Column) -> Column:
    """Strict integer parse of text (no fraction, no exponent)."""
    s = _joined_digits(s)
    return F.when(_only(s, "0123456789+- \t\n\r"), try_cast(s, "bigint"))


def to_double(v: Column, strip_chars: str | None = None, t: Column | None = None, s: Column | None = None,
              d: Column | None = None) -> Column:
    """Float conversion of a variant: numbers and booleans convert, strings are
    parsed strictly (after removing ``strip_chars``), anything else is NULL."""
    known = s is not None
    s = s if known else F.try_variant_get(v, "$", "string")
    if strip_chars:
        s = F.translate(s, strip_chars, "")
    if known:
        return F.when(s.isNotNull(), text_to_double(s)).otherwise(number(v, t) if d is None else d)
    return (F.when(is_number(v, t) | is_bool(v, t), F.try_variant_get(v, "$", "double"))
            .when(is_string(v, t), text_to_double(s)))


def to_long(v: Column, strip_chars: str | None = None, t: Column | None = None, s: Column | None = None,
            d: Column | None = None) -> Column:
    """Integer conversion of a variant: integers as they are, floats truncated
    toward zero, booleans 0/1, strings parsed strictly; anything else NULL."""
    known = s is not None
    s = s if known else F.try_variant_get(v, "$", "string")
    if strip_chars:
        s = F.translate(s, strip_chars, "")
    dbl = F.try_variant_get(v, "$", "double") if d is None else d
    if known and d is not None:
        return F.when(s.isNotNull(), text_to_long(s)).otherwise(try_cast(F.when(dbl < 0, F.ceil(dbl)).otherwise(F.floor(dbl)), "bigint"))
    return (F.when(is_bool(v, t), F.try_variant_get(v, "$", "boolean").cast("bigint"))
            .when(is_number(v, t), try_cast(F.when(dbl < 0, F.ceil(dbl)).otherwise(F.floor(dbl)), "bigint"))
            .when(is_string(v, t), text_to_long(s)))


def first_parsable_double(v: Column, keys: list[str], strip_chars: str = "$,") -> Column:
    """First key whose value is present *and* converts to a float; a value that
    fails to convert hands over to the next key.  Zero is kept."""
    return F.coalesce(*[F.when(present(get(v, k)), to_double(get(v, k), strip_chars)) for k in keys])


def price_from_text(s: Column) -> Column:
    """Currency text: drop '$' and ',' then read the first run of digits and
    points as a float ('Call for price: $55,000' -> 55000.0; '1.2.3' -> NULL)."""
    cleaned = F.translate(s, "$,", "")
    run = F.regexp_extract(cleaned, r"[\d.]+", 0)
    dots = F.length(run) - F.length(F.replace(run, F.lit("."), F.lit("")))
    return F.when((dots <= 1) & (F.length(run) > dots), try_cast(run, "double"))


def polymorphic_price(v: Column, t: Column | None = None, s: Column | None = None, d: Column | None = None) -> Column:
    """Price given as a number, as currency text, or as an object whose
    ``value`` / ``amount`` holds currency text.  A number inside an object
    is not read (stays NULL), matching the pinned behaviour."""
    inner = first_truthy(get(v, "value"), get(v, "amount"))
    if s is not None and d is not None:
        return (F.when(d.isNotNull(), d).when(s.isNotNull(), price_from_text(s))
                .when(is_object(v, t) & is_string(inner), price_from_text(F.try_variant_get(inner, "$", "string"))))
    return (F.when(is_number(v, t) | is_bool(v, t), F.try_variant_get(v, "$", "double"))
            .when(is_string(v, t), price_from_text(F.try_variant_get(v, "$", "string")))
            .when(is_object(v, t) & is_string(inner), price_from_text(F.try_variant_get(inner, "$", "string"))))


def nonempty_list(v: Column) -> Column:
    """The value as ARRAY<VARIANT> when it is a non-empty array, else NULL."""
    arr = F.try_variant_get(v, "$", "array<variant>")
    return F.when(F.size(arr) > 0, arr)


def join_truthy(v: Column) -> Column:
    """Space-join of the truthy members of an array value, each as text (0,
    0.0, false, null, '', [] and {} are dropped; '0' and 'false' are kept)."""
    def text(x: Column) -> Column:
        # type and text of a member are worked out once each
        return _let(vtype(x), lambda t: _let(string(x, t), lambda s: F.when(truthy(x, t, s), as_text(x, t, s))))
    return F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), text), " ")


def _let(c: Column, of) -> Column:
    """``of(c)`` with ``c`` worked out once."""
    return F.element_at(F.transform(F.array(c), of), 1)


def text_or_joined(v: Column, t: Column | None = None, s: Column | None = None) -> Column:
    """A list value becomes the space-join of its truthy members; other values as text."""
    return F.when(is_array(v, t), join_truthy(v)).otherwise(as_text(v, t, s))
