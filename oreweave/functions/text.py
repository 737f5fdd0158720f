"""Names, paths and metadata texts as column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normal_path(path: Column) -> Column:
    """Forward slashes, no doubled ones, none at the end."""
    return F.regexp_replace(F.regexp_replace(F.translate(path, "\\", "/"), "/+", "/"), "(?<=.)/$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "\\.[^.]*$", "")


def safe_label(name: Column) -> Column:
    return F.regexp_replace(name, "[^A-Za-z0-9_.-]+", "_")


def path_hash(path: Column) -> Column:
    return F.substring(F.sha1(path), 1, 12)


def fourcc(data: Column) -> Column:
    """A four-byte id as text when printable, else its hexadecimal digits."""
    text = data.cast("string")
    return F.when(text.rlike("\\A[\\x20-\\x7E]*\\z"), text).otherwise(F.concat(F.lit("hex:"), F.lower(F.hex(data))))


def split_tags(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[;,/]"), lambda x: F.trim(x)), lambda x: x != "")


def control_characters(text: Column) -> Column:
    """How many characters below 32 there are but for tab to carriage return."""
    return F.length(text) - F.length(F.regexp_replace(text, "[\\x00-\\x08\\x0E-\\x1F]", ""))


def letter_ratio(text: Column) -> Column:
    """Letters and digits among all characters."""
    return F.when(F.length(text) > 0, F.length(F.regexp_replace(text, "[^A-Za-z0-9]", "")) / F.length(text)).otherwise(0.0)


def looks_like_a_name(text: Column) -> Column:
    return text.rlike("[._/\\\\ -]") & (letter_ratio(text) >= 0.6) & text.rlike("(\\.[A-Za-z0-9]{1,5}$)|[/\\\\]")


def without_bom(text: Column) -> Column:
    return F.regexp_replace(text, "^\\x{FEFF}", "")


def human_size(n: Column) -> Column:
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, F.concat(F.format_string("%.1f", F.bround(n / 1024, 1)), F.lit(" KiB"))).otherwise(F.concat(F.format_string("%.1f", F.bround(n / (1 << 20), 1)), F.lit(" MiB")))


def decoded(data: Column) -> Column:
    """Bytes as UTF-8 if they are, else as Latin-1."""
    return F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))


def c_string(data: Column, padding: str = "\\s") -> Column:
    """Bytes up to the first zero as text, without white space, or what else `padding` (a regex) names, at its ends."""
    # Two digits and a blank a byte, so that the zero is a whole byte.
    spaced = F.split(F.regexp_replace(F.hex(data), "(..)", "$1 "), "(?<= |^)00 ", 2)[0]
    return F.regexp_replace(decoded(F.unhex(F.replace(spaced, F.lit(" "), F.lit("")))), f"\\A({padding})+|({padding})+\\z", "")


@F.pandas_udf(T.StringType())
def _escaped(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else bytes(x).decode("utf-8", "backslashreplace"))


def safe_path(data: Column) -> Column:
    """A path's bytes as text that JSON can hold: bytes that are no UTF-8 as `\\xNN`. Only such paths leave the JVM."""
    good = F.is_valid_utf8(data.cast("string"))
    return F.when(good, data.cast("string")).otherwise(_escaped(F.when(~good, data)))
