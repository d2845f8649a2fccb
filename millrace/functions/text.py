"""Text functions as Column expressions; whitespace and letters are Unicode ones."""

from __future__ import annotations

import re
import textwrap

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARKS = ".!?;"


def strip(s: Column) -> Column:
    """Both ends, all white space; ``trim`` takes spaces only."""
    return F.regexp_replace(s, r"(?U)^\s+|\s+$", "")


def align(s: Column, width: int, side: str = "left") -> Column:
    """Pads to ``width``; longer text stays whole. ``side`` counts by its first letter: l, r or c."""
    need = F.greatest(F.length(s), F.lit(width))
    kind = side[:1].lower()
    if kind == "l":
        return F.rpad(s, need, " ")
    if kind == "r":
        return F.lpad(s, need, " ")
    pad = need - F.length(s)
    left = (pad / 2).cast("int") + pad.bitwiseAND(F.lit(width)).bitwiseAND(F.lit(1))
    return F.rpad(F.lpad(s, F.length(s) + left, " "), need, " ")


def remove_non_alphanumeric(s: Column, replace_with: str = "_", keep_underscore: bool = True) -> Column:
    """Ampersands become the word and; each run of other characters becomes ``replace_with``."""
    s = F.regexp_replace(s, "&+", "&")
    for old, new in ((" & ", " and "), ("_&_", "_and_"), ("&", " and ")):
        s = F.replace(s, F.lit(old), F.lit(new))
    return replace_non_alphanumeric(s, replace_with, keep_underscore)


def replace_non_alphanumeric(s: Column, replace_with: str = "_", keep_underscore: bool = True) -> Column:
    return F.regexp_replace(s, r"(?U)\W+" if keep_underscore else r"(?U)[\W_]+", replace_with)


def remove_non_alphabetic(s: Column) -> Column:
    return F.regexp_replace(s, r"[^\p{L}]", "")


def camel_to_snake(s: Column, clean: bool = True) -> Column:
    s = strip(s)
    if clean:
        s = remove_non_alphanumeric(s)
    s = F.regexp_replace(s, "(.)([A-Z][a-z]+)", "$1_$2")
    s = F.regexp_replace(s, "([a-z0-9])([A-Z])", "$1_$2")
    return F.regexp_replace(F.lower(s), r"\s*_+", "_")


def snake_name(name: str | tuple, camel: bool = True) -> str:
    """The same for a column name, on the driver; parts of a tuple are joined by underscores."""
    if isinstance(name, tuple):
        name = "__".join(map(str, name))
    s = re.sub(r"&+", "&", name.strip()).replace(" & ", " and ").replace("_&_", "_and_").replace("&", " and ")
    s = re.sub(r"\W+", "_", s)
    if camel:
        s = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", re.sub(r"(.)([A-Z][a-z]+)", r"\1_\2", s))
    return re.sub(r"\s*_+", "_", s.lower())


def is_word(s: Column) -> Column:
    return s.rlike(r"\p{L}")


def count_words(s: Column) -> Column:
    """Stretches without white space that hold a letter."""
    return F.regexp_count(s, F.lit(r"(?U)\S*\p{L}\S*"))


def count_sentences(s: Column) -> Column:
    """Ends of sentences: a mark before a space, or at the very end."""
    s = strip(s)
    return F.regexp_count(s, F.lit(f"[{MARKS}] ")) + s.rlike(rf"[{MARKS}]\z").cast("int")


def split_and_strip(s: Column, sep: str = ",") -> Column:
    quoted = "\\Q" + sep + "\\E"
    plain = re.sub(r"([\\$])", r"\\\1", sep)
    return F.split(F.regexp_replace(strip(s), rf"(?U)\s*{quoted}\s*", plain), quoted)


def wrap(s: Column, width: int = 80, side: str = "left", indentation: int = 0, prefix: str = "", suffix: str = "", left_margin: int = 0, right_margin: int = 0) -> Column:
    """Greedy wrapping, each line aligned between margins, prefix and suffix. Arrow batches: no built-in breaks
    lines by words."""
    inner = width - len(prefix) - len(suffix) - left_margin - right_margin
    put = {"l": str.ljust, "r": str.rjust}.get(side[:1].lower(), str.center)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        lines = textwrap.wrap(text, max(1, inner), initial_indent=" " * indentation) or [""]
        return "\n".join(prefix + " " * left_margin + put(x, inner) + " " * right_margin + suffix for x in lines)

    def batch(texts: pd.Series) -> pd.Series:
        return pd.Series([one(x) for x in texts])

    return F.pandas_udf(batch, "string")(s)
