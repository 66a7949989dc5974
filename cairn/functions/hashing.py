"""Row hashes (HSH-1 to HSH-7): SHA-1 of a canonical JSON text of chosen properties.

Values become culture-free text, are ordered by property name (case-insensitively), written as
the JSON array of ``{"h": [...]}`` and hashed to 20 bytes. NULL and '' hash alike. All of it is
column expressions; nothing runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..entity import BOOKKEEPING

#: ASCII characters that the canonical JSON text writes as escapes; the backslash comes first.
ESCAPES = {"\\": "\\\\", '"': "\\u0022", "\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", "\x7f": "\\u007F", "'": "\\u0027", "<": "\\u003C", ">": "\\u003E", "&": "\\u0026", "+": "\\u002B", "`": "\\u0060"}


def invariant_text(value: Column, dtype: T.DataType) -> Column:
    """Culture-free text of a value; '' for NULL."""
    if isinstance(dtype, T.BooleanType):
        text = F.when(value, "True").when(~value, "False")
    elif isinstance(dtype, T.TimestampNTZType):
        text = F.date_format(value, "MM/dd/yyyy HH:mm:ss")
    elif isinstance(dtype, T.TimestampType):
        # In UTC, whatever the session's zone: the epoch as a local time, and the seconds since.
        none = F.lit(0)
        moment = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(none, none, none, F.unix_seconds(value))
        text = F.concat(F.date_format(moment, "MM/dd/yyyy HH:mm:ss"), F.lit(" +00:00"))
    elif isinstance(dtype, T.DateType):
        text = F.date_format(value, "MM/dd/yyyy")
    elif isinstance(dtype, T.BinaryType):
        text = F.hex(value)
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        plain = value.cast("string")
        exponent = F.regexp_replace(F.regexp_replace(plain, r"\.0(E|$)", "$1"), r"E(\d)", "E+$1")
        small = F.regexp_replace(exponent, r"E-(\d)$", "E-0$1")
        whole = F.when((F.abs(value) < 1e15) & (value == F.floor(value)), value.cast("decimal(20,0)").cast("string"))
        spelled = F.when((F.abs(value) >= 1e-4) & (F.abs(value) < 1e15) & plain.contains("E"), F.regexp_replace(value.cast("decimal(38,18)").cast("string"), r"\.?0+$", ""))
        text = F.when(F.isnan(value), "NaN").otherwise(F.coalesce(whole, spelled, small))
    else:
        text = value.cast("string")
    return F.coalesce(text, F.lit(""))


def _escape_other(text: Column) -> Column:
    """Characters outside ASCII as \\uXXXX, through their UTF-16 code units."""
    units = F.hex(F.encode(text, "UTF-16BE"))
    pieces = F.transform(F.sequence(F.lit(0), (F.length(units) / 4 - 1).cast("int")), lambda i: F.substring(units, (i * 4 + 1).cast("int"), F.lit(4)))

    def piece(u: Column) -> Column:
        code = F.conv(u, 16, 10).cast("int")
        return F.when((code < 127) & (code >= 32), F.char(code)).otherwise(F.concat(F.lit("\\u"), u))

    return F.when(text.rlike(r"[^ -~]"), F.array_join(F.transform(pieces, piece), "")).otherwise(text)


def json_text(value: Column) -> Column:
    """A text as the inside of a JSON string; most hold nothing to escape."""
    escaped = value
    for plain, written in ESCAPES.items():
        escaped = F.replace(escaped, F.lit(plain), F.lit(written))
    return F.when(value.rlike(r"[^A-Za-z0-9 _.,:;#/()*=?!@$%^|~\[\]{}-]"), _escape_other(escaped)).otherwise(value)


def canonical_json(values: list[Column]) -> Column:
    """``{"h":[...]}`` of texts in the given order, each escaped by itself."""
    parts: list[Column] = []
    for v in values:
        parts += [F.lit(',"' if parts else '"'), json_text(v), F.lit('"')]
    return F.concat(F.lit('{"h":['), *parts, F.lit("]}"))


class HashSpec:
    """Which properties a hash covers (HSH-1 to HSH-4)."""

    def __init__(self, df: DataFrame | T.StructType, ignore: tuple[str, ...] = ()):
        schema = df.schema if isinstance(df, DataFrame) else df
        self.types = {f.name: f.dataType for f in schema.fields}
        self.ignore = {*BOOKKEEPING, *ignore}
        self.names: list[str] = []
        self.seeds: dict[str, int] = {}
        self.unset: dict[str, str] = {}

    def include(self, *names: str) -> HashSpec:
        """Adds properties; ignored if unmapped, bookkeeping or present."""
        self.names += [n for n in names if n in self.types and n not in self.ignore and n not in self.names]
        return self

    def all(self) -> HashSpec:
        return self.include(*self.types)

    def exclude(self, *names: str) -> HashSpec:
        self.names = [n for n in self.names if n not in names]
        return self

    def with_seed(self, seed: int, name: str = "Seed") -> HashSpec:
        self.seeds[name] = seed
        return self

    def with_unset(self, name: str, text: str = "0") -> HashSpec:
        """A property that nothing sets, such as an identity key, hashed as its default."""
        self.unset[name] = text
        return self

    def ordered(self) -> list[str]:
        return sorted({*self.names, *self.seeds, *self.unset}, key=lambda n: (n.lower(), n))

    def text(self) -> Column:
        values = []
        for n in self.ordered():
            if n in self.seeds:
                values.append(F.lit(str(self.seeds[n])))
            elif n in self.unset:
                values.append(F.lit(self.unset[n]))
            else:
                values.append(invariant_text(F.col(f"`{n}`"), self.types[n]))
        return canonical_json(values)

    def column(self) -> Column:
        """HSH-5: the 20 bytes."""
        return F.unhex(F.sha1(self.text()))


def base64_view(value: Column) -> Column:
    """PRJ-13: base64 text; '' for an empty or all-zero hash."""
    blank = (F.length(value) == 0) | (F.hex(value) == F.lit("00" * 20))
    return F.when(blank, "").otherwise(F.base64(value))
