"""Text expressions: normalising, templates, hashing, JSON repair."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The characters that Python's str.split() and str.strip() treat
# as whitespace. The JVM's own \s covers ASCII only; a class of plain ranges is
# matched faster than one with Unicode properties.
WS = (
    r"[\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
)
WS_CHARS = "".join(
    chr(c)
    for c in [
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    ]
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Catalyst may inline an expression into the lambda that uses it, where it
    would run once per element; a lambda variable is never re-evaluated.
    """
    return F.transform(F.array(value), body).getItem(0)


def strip(col: Column) -> Column:
    """Without whitespace at both ends; looks at the ends only."""
    return F.btrim(col, F.lit(WS_CHARS))


def words(col: Column) -> Column:
    """Whitespace-separated words; no words gives an empty array."""
    return F.array_remove(F.split(col, rf"{WS}+"), "")


def normalize_text(col: Column | str, falsy=None) -> Column:
    """Lower-cased text with line breaks, tabs and runs of blanks squeezed.

    Null gives ''. For a non-string column pass its falsy value (0, False):
    rows equal to it give '' as well.
    """
    col = F.col(col) if isinstance(col, str) else col
    text = F.lower(col.cast("string"))
    out = strip(F.regexp_replace(text, rf"{WS}{{2,}}|[\r\n\t]", " "))
    if falsy is not None:
        out = F.when(col != F.lit(falsy), out)
    return F.coalesce(out, F.lit(""))


def normalize_column(df: DataFrame, name: str) -> DataFrame:
    """``normalize_text`` with the falsy value taken from the column type."""
    dtype = df.schema[name].dataType
    falsy = None
    if isinstance(dtype, T.BooleanType):
        falsy = False
    elif isinstance(dtype, T.NumericType):
        falsy = 0
    return df.withColumn(name, normalize_text(F.col(name), falsy))


def prompt_render(template: str | None, columns: Iterable[str], text: str = "req") -> Column:
    """Fill ``{name}`` slots from the row; without a template, the text column.

    The template is split once, here; the row only concatenates.
    """
    known = set(columns)
    if not template:
        return F.col(text)
    parts: list[Column] = []
    for literal, slot, spec, conversion in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if slot is None:
            continue
        if spec or conversion:
            raise ValueError(f"format specs are not supported: {slot!r}")
        if slot not in known:
            raise KeyError(slot)
        parts.append(F.coalesce(F.col(slot).cast("string"), F.lit("None")))
    return F.concat(*parts) if parts else F.lit("")


def content_sha256(*cols: str) -> Column:
    """SHA-256 of one text column, or of several as key-sorted JSON."""
    if len(cols) == 1:
        return F.sha2(F.col(cols[0]), 256)
    ordered = [F.col(name) for name in sorted(cols)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


def _by_key(col: Column, kind: T.DataType) -> Column:
    """The value with the fields of its structs and the keys of its maps in order, at every depth."""
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        ordered = F.struct(*[_by_key(col[f.name], f.dataType).alias(f.name) for f in fields])
        return F.when(col.isNotNull(), ordered)
    if isinstance(kind, T.MapType):
        pairs = F.transform(
            F.array_sort(F.map_keys(col)), lambda k: F.struct(k, _by_key(F.element_at(col, k), kind.valueType))
        )
        return F.map_from_entries(pairs)
    if isinstance(kind, T.ArrayType):
        return F.transform(col, lambda x: _by_key(x, kind.elementType))
    return col


def row_sha256(df: DataFrame, *cols: str) -> Column:
    """SHA-256 of columns of ``df`` as JSON whose keys are sorted at every depth, so that neither the
    order of columns or struct fields nor that of map entries counts."""
    names = sorted(cols or df.columns)
    whole = F.struct(*[_by_key(F.col(n), df.schema[n].dataType).alias(n) for n in names])
    return F.sha2(F.to_json(whole, {"ignoreNullFields": "false"}), 256)


def repair_quotes(col: Column) -> Column:
    """Single quotes to double quotes, the repair applied to near-JSON."""
    return F.translate(col, "'", '"')


def parse_json(col: Column, schema: T.DataType | str, repair: bool = False) -> Column:
    """Typed value of a JSON text, null where it does not parse."""
    return F.from_json(repair_quotes(col) if repair else col, schema)


def split_names(names: str) -> list[str]:
    """A comma list of names, trimmed and lower-cased, blanks dropped."""
    return [n.strip().lower() for n in names.split(",") if n.strip()]


def split_names_col(col: Column) -> Column:
    """The same for a column holding comma lists."""
    return F.array_remove(F.transform(F.split(col, ","), lambda n: F.lower(strip(n))), "")
