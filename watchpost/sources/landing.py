"""Landed documents to records, field by field, with what cannot be read kept apart.

A document is parsed once to a VARIANT. Each declared field is then cast by itself and held
against what is there: a field that is absent or null is null, one that is present and does not
fit its type is a reject. Text is read from any scalar, a number from a number or a numeral, a
whole number from nothing with a fraction, a flag from a flag only.

Most records have nothing wrong. The records of a document are therefore cast in one go first,
numbers as texts and flags as they are, so that every problem shows in what comes out. Where none of a
document's records is in doubt that is all; otherwise each is cast by itself, and one that is still
in doubt is taken field by field.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..schemas import RAW

#: characters of a document that a message shows
SHOWN = 80
_PROBLEM = "struct<field:string,reason:string,fatal:boolean>"


def _is(v: Column, *kinds: str) -> Column:
    """Whether the variant is of one of these kinds (the first word of its schema)."""
    return F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0).isin(*kinds)


def _problem(field: str | Column, reason: str | Column, fatal: bool = True) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(field).alias("field"), lit(reason).alias("reason"), F.lit(fatal).alias("fatal"))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


class _Field:
    """A declared field: its value, and a list of problems (null: none)."""

    def __init__(self, value: Column, problems: list[Column]):
        self.value, self.problems = value, problems


def _field(v: Column, path: str, kind: T.DataType) -> _Field:
    """The field at ``path`` of record ``v``."""
    raw = _get(v, path, "variant")
    there = raw.isNotNull() & ~F.is_variant_null(raw)
    name = path.removeprefix("$.")
    shown = kind.simpleString()

    def checked(value: Column, fits: Column, reason: str) -> _Field:
        wrong = there & ~F.coalesce(fits, F.lit(False))
        return _Field(value, [F.when(wrong, F.array(_problem(name, reason)))])

    if isinstance(kind, T.StructType):
        inner = [(f.name, _field(v, f"{path}.{f.name}", f.dataType)) for f in kind.fields]
        held = F.struct(*[i.value.alias(n) for n, i in inner])
        own = checked(F.when(there, held), _is(raw, "OBJECT"), "not an object")
        return _Field(own.value, own.problems + [p for _, i in inner for p in i.problems])
    if isinstance(kind, T.MapType):
        values = F.map_values(_get(v, path, "map<string,variant>"))
        fits = _is(raw, "OBJECT")
        if isinstance(kind.valueType, T.DoubleType):
            fits &= F.forall(values, lambda e: e.isNull() | _number(e))
        return checked(_get(v, path, shown), fits, f"not {shown}")
    if isinstance(kind, T.ArrayType):
        return _list(v, path, kind, name, there, checked)
    value = _get(v, path, shown)
    fits = value.isNotNull() & ~_is(raw, "ARRAY", "OBJECT")
    if isinstance(kind, T.BooleanType):
        fits = _is(raw, "BOOLEAN")
    elif isinstance(kind, (T.LongType, T.IntegerType)):
        # a text is a whole number only as the numeral of one
        whole = _get(v, path, "decimal(38,6)")
        fits &= ~_is(raw, "BOOLEAN") & (whole == F.floor(whole))
    elif isinstance(kind, (T.DecimalType, T.DoubleType)):
        fits &= ~_is(raw, "BOOLEAN")
    return checked(value, fits, f"not {shown}")


def _number(e: Column) -> Column:
    return F.is_variant_null(e) | (_get(e, "$", "double").isNotNull() & ~_is(e, "BOOLEAN"))


def _list(v: Column, path: str, kind: T.ArrayType, name: str, there: Column, checked) -> _Field:
    items = _get(v, path, "array<variant>")
    element = kind.elementType
    if isinstance(element, T.StringType):
        plain = F.forall(items, lambda e: e.isNull() | ~_is(e, "ARRAY", "OBJECT"))
        return checked(_get(v, path, "array<string>"), items.isNotNull() & plain, "not a list of texts")
    if isinstance(element, T.StructType):
        def one(e: Column) -> Column:
            inner = [_field(e, f"$.{f.name}", f.dataType).value.alias(f.name) for f in element.fields]
            return F.when(e.isNotNull() & ~F.is_variant_null(e), F.struct(*inner))

        def fine(e: Column) -> Column:
            inner = [p.isNull() for f in element.fields for p in _field(e, f"$.{f.name}", f.dataType).problems]
            all_fine = inner[0]
            for p in inner[1:]:
                all_fine &= p
            return e.isNull() | F.is_variant_null(e) | (_is(e, "OBJECT") & all_fine)

        return checked(F.transform(items, one), items.isNotNull() & F.forall(items, fine), "not a list of records")
    # points: a list each, judged one by one, so that a bad one costs no other
    def point(e: Column) -> Column:
        numbers = _get(e, "$", "array<variant>")
        return (F.size(numbers) >= 2) & ~F.is_variant_null(F.get(numbers, F.lit(0))) & F.forall(numbers, _number)

    good = lambda e: F.coalesce(point(e), F.lit(False))
    values = F.transform(items, lambda e: F.when(good(e), _get(e, "$", "array<double>")))
    own = checked(values, items.isNotNull(), "not a list")
    numbered = F.transform(
        items,
        lambda e, i: F.when(
            ~good(e), _problem(F.concat(F.lit(f"{name}["), i, F.lit("]")), "not a time and a number", False)
        ),
    )
    return _Field(own.value, own.problems + [F.filter(numbered, lambda p: p.isNotNull())])


#: texts that come to the same whole number, decimal of six places or double from text and number
_WHOLE, _DECIMAL = "^-?[0-9]{1,19}$", r"^-?[0-9]{1,14}(\.[0-9]{1,6})?$"
_DOUBLE = r"^-?[0-9]{1,30}(\.[0-9]{1,30})?([eE][+-]?[0-9]{1,3})?$"
_NUMBERS = (T.LongType, T.IntegerType, T.DecimalType, T.DoubleType)


def _loose(kind: T.DataType) -> T.DataType:
    """The type that shows what a field holds: texts for numbers, variants for flags."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _loose(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_loose(kind.elementType))
    if isinstance(kind, T.MapType):
        return T.MapType(kind.keyType, _loose(kind.valueType))
    if isinstance(kind, T.BooleanType):
        return T.VariantType()
    return T.StringType() if isinstance(kind, _NUMBERS) else kind


def _made(own: Column, kind: T.DataType) -> Column:
    """The declared value of a field that is plain."""
    if isinstance(kind, T.StructType):
        inner = [_made(own[f.name], f.dataType).alias(f.name) for f in kind.fields]
        return F.when(own.isNotNull(), F.struct(*inner))
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, T.StringType):
        return F.transform(own, lambda e: _made(e, kind.elementType))
    if isinstance(kind, T.MapType) and not isinstance(kind.valueType, T.StringType):
        return F.transform_values(own, lambda _, e: _made(e, kind.valueType))
    if isinstance(kind, T.BooleanType):
        return _get(own, "$", "boolean")
    return own.try_cast(kind) if isinstance(kind, _NUMBERS) else own


def _plain(own: Column, kind: T.DataType, absent: Callable[[str], Column] | None, path: str = "$") -> Column:
    """Whether a field, cast to its loose type, surely has no problem (``_field``).

    A null is one that is absent or null, and with lists, maps and records one that does not fit,
    too: ``absent`` tells them apart by the path, and without it they are in doubt.
    """
    doubt = absent(path) if absent else F.lit(False)

    def flat(text: Column) -> Column:
        return text.isNull() | ~F.left(text, F.lit(1)).isin("{", "[")

    if isinstance(kind, T.StructType):
        inner = [_plain(own[f.name], f.dataType, absent, f"{path}.{f.name}") for f in kind.fields]
        return F.when(own.isNull(), doubt).otherwise(_all(inner))
    if isinstance(kind, T.StringType):
        return flat(own)
    if isinstance(kind, T.BooleanType):
        return own.isNull() | F.schema_of_variant(own).isin("BOOLEAN", "VOID")
    if isinstance(kind, (T.LongType, T.IntegerType)):
        return own.isNull() | (own.rlike(_WHOLE) & own.try_cast(kind).isNotNull())
    if isinstance(kind, T.DecimalType):
        return own.isNull() | own.rlike(_DECIMAL)
    if isinstance(kind, T.DoubleType):
        return own.isNull() | own.rlike(_DOUBLE)
    if isinstance(kind, T.MapType):
        if isinstance(kind.valueType, T.StringType):
            return own.isNotNull() | doubt
        number = lambda e: _plain(e, kind.valueType, None)
        return F.when(own.isNull(), doubt).otherwise(F.forall(F.map_values(own), number))
    element = kind.elementType
    if isinstance(element, T.ArrayType):
        # points: two numbers or more, the first of them not null
        def fits(e: Column) -> Column:
            dated = (F.size(e) >= 2) & F.get(e, F.lit(0)).isNotNull()
            return e.isNotNull() & dated & F.forall(e, lambda x: _plain(x, element.elementType, None))
    else:
        def fits(e: Column) -> Column:
            return _plain(e, element, None)
    return F.when(own.isNull(), doubt).otherwise(F.forall(own, fits))


def _timely(own: Column, path: str) -> Column:
    """Whether the text at ``path``, or those in a list of records, are times or null."""
    outer, _, inner = path.partition("[].")

    def fits(t: Column) -> Column:
        return t.isNull() | F.try_to_timestamp(t).isNotNull()

    held = reduce(lambda c, name: c[name], outer.split("."), own)
    if inner:
        return held.isNull() | F.forall(held, lambda e: fits(e[inner]))
    return fits(held)


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def _is_object(v: Column) -> Column:
    """The same as ``_is(v, "OBJECT")``, without the schema of all that is in it."""
    return _get(v, "$", "struct<_: boolean>").isNotNull()


def _items(v: Column, kind: str, loose: T.StructType, plain: Callable[..., Column]) -> Column:
    """array<struct(v, own, problem)>: a document's records, or the one thing wrong with it.

    ``own`` is the record as cast to ``loose``. A record without ``v`` is plain.
    """
    spec = RAW[kind]
    key = spec["envelope"]
    path = "$" if key is None else f"$.{key}"
    raw = _get(v, path, "variant")
    absent = raw.isNull() | F.is_variant_null(raw)
    none = F.lit(None).cast("string")
    failed = F.lit(False)
    problem = F.when(v.isNull(), F.concat(F.lit("malformed document: "), F.left("value", F.lit(SHOWN))))
    if kind == "metric_points":
        note = F.coalesce(_get(v, "$.message", "string"), F.lit(""))
        failed = F.coalesce(_get(v, "$.status", "string") == "error", F.lit(False))
        problem = problem.when(failed, F.concat(F.lit("metric query failed: "), note))
    problem = problem.when(absent, F.lit(spec["required"]) if spec["required"] else none)
    if key is not None:
        problem = problem.when(~_is_object(v), F.lit("not an object"))
    if spec.get("single"):
        held = F.array(raw)
    else:
        held = _get(v, path, "array<variant>")
        problem = problem.when(held.isNull(), F.lit("not a list of records"))
    no_v, no_own = F.lit(None).cast("variant"), F.lit(None).cast(loose)

    def item(v: Column, own: Column, problem: Column) -> Column:
        return F.struct(v.alias("v"), own.alias("own"), problem.alias("problem"))

    wrong = F.array(item(no_v, no_own, problem))
    found = F.transform(held, lambda e: item(e, _get(e, "$", loose.simpleString()), none))
    doubtful = F.when(problem.isNotNull(), wrong).when(~absent, found)
    if spec.get("single"):
        return doubtful

    def whole(records: Column) -> Column:
        fine = records.isNotNull() & ~failed & F.forall(records, lambda e: e.isNotNull() & plain(e))
        return F.when(fine, F.transform(records, lambda e: item(no_v, e, none))).otherwise(doubtful)

    # a list of one, so that the records are cast once
    cast = _get(v, path, f"array<{loose.simpleString()}>")
    return F.flatten(F.transform(F.array(cast), whole))


def parsed(docs: DataFrame, kind: str) -> DataFrame:
    """(file, text, r, problems) for each record of landed documents (file, value).

    A document with something wrong as a whole is one row, ``text`` its beginning. A record with
    nothing wrong may be without its text.
    """
    record = T.StructType.fromDDL(RAW[kind]["record"].removeprefix("struct<").removesuffix(">"))
    loose, iso = _loose(record), RAW[kind].get("iso", ())
    v, own, problem = F.col("v"), F.col("own"), F.col("problem")

    def plain(cast: Column, absent: Callable[[str], Column] | None = None) -> Column:
        return F.coalesce(
            _all([_plain(cast, record, absent)] + [_timely(cast, path) for path in iso]), F.lit(False)
        )

    def absent(path: str) -> Column:
        raw = _get(v, path, "variant")
        return raw.isNull() | F.is_variant_null(raw)

    # of a document only its beginning goes with its records
    variants = docs.select(
        "file", F.left("value", F.lit(SHOWN)).alias("value"), F.try_parse_json("value").alias("doc")
    )
    items = variants.select(
        "file", "value", F.explode(_items(F.col("doc"), kind, loose, plain)).alias("i")
    ).select("file", "value", "i.*")
    fields = [(f.name, _field(v, f"$.{f.name}", f.dataType)) for f in record.fields]
    none = F.expr(f"cast(array() as array<{_PROBLEM}>)")
    found = [F.coalesce(p, none) for _, f in fields for p in f.problems]
    found += [F.coalesce(_not_a_time(path), none) for path in iso]
    whole = F.when(problem.isNotNull(), F.array(_problem("$", problem)))
    problems = (
        whole.when(~F.coalesce(_is_object(v), F.lit(False)), F.array(_problem("$", "not an object")))
        .otherwise(F.concat(*found))
    )
    careful = F.struct(
        F.when(problem.isNull(), F.to_json("v")).otherwise(F.col("value")).alias("text"),
        F.struct(*[f.value.alias(n) for n, f in fields]).alias("r"),
        problems.alias("problems"),
    )
    sure = problem.isNull() & own.isNotNull() & (v.isNull() | plain(own, absent))
    taken = F.struct(F.lit(None).cast("string").alias("text"), _made(own, record).alias("r"), none.alias("problems"))
    # as the rows of a generator the fields are made once; a projection would be merged into every
    # filter and projection that follows
    made = F.explode(F.array(F.when(sure, taken).otherwise(careful)))
    return items.select("file", made.alias("x")).select("file", "x.*")


def _not_a_time(path: str) -> Column:
    """Text that is there and is no time, in a field or in the fields of a list of records."""
    outer, _, inner = path.partition("[].")

    def unreadable(t: Column) -> Column:
        return t.isNotNull() & F.try_to_timestamp(t).isNull()

    if inner:
        items = _get(F.col("v"), f"$.{outer}", "array<variant>")
        wrong = F.exists(items, lambda e: unreadable(_get(e, f"$.{inner}", "string")))
    else:
        wrong = unreadable(_get(F.col("v"), f"$.{path}", "string"))
    return F.when(wrong, F.array(_problem(path, "not a time")))


def documents(spark: SparkSession, path: str, whole_files: bool) -> DataFrame:
    """(file, value) for each document that is not blank: a line, or a whole file."""
    docs = spark.read.text(path, wholetext=whole_files)
    return docs.select(F.col("_metadata.file_path").alias("file"), "value").filter(F.trim("value") != "")


def all_readable(records: DataFrame) -> DataFrame:
    """The records; one problem among them fails the query, whichever columns it asks for."""
    first = F.get("problems", F.lit(0))
    message = F.when(first["field"] == "$", first["reason"]).otherwise(
        F.concat(F.lit("unreadable "), first["field"], F.lit(": "), first["reason"], F.lit(" in "), F.left("text", F.lit(SHOWN)))
    )
    return records.filter(
        F.when(F.size("problems") == 0, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    ).select("r")


def readable(records: DataFrame) -> DataFrame:
    """The records with nothing wrong in them as a whole."""
    return records.filter(~F.exists("problems", lambda p: p["fatal"])).select("r")


def rejects(records: DataFrame) -> DataFrame:
    """(file, text, field, reason): a row for each thing wrong, ``$`` for all of a record."""
    return records.select("file", "text", F.explode("problems").alias("p")).select(
        "file", "text", "p.field", "p.reason"
    )
