"""String functions of the wrangler. Each folds text to ASCII and goes on in the JVM; `folded` composes several with one folding."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(s: pa.Array) -> pa.Array:
    return pc.fill_null(pc.replace_substring_regex(pc.utf8_normalize(s.cast(pa.string()), form="NFKD"), pattern=r"[^\x00-\x7F]", replacement=""), "")


def ascii_folded(c: Column) -> Column:
    """Compatibility decomposition without what isn't ASCII; null becomes empty. Whole Arrow arrays at a time."""

    def fold(s: pa.Array) -> pa.Array:
        return _fold(s)

    return F.arrow_udf(fold, "string")(c)


def _lower(c: Column) -> Column:
    return F.lower(c)


def _trim(c: Column) -> Column:
    bare = F.regexp_replace(c, r"^[\x09-\x0D\x1C-\x20]+|[\x09-\x0D\x1C-\x20]+$", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\n+", ""), r"[\x09-\x0D\x1C-\x20]+", " ")
    return F.regexp_replace(bare, "[\"']", "")


def lowercase(c: Column) -> Column:
    return _lower(ascii_folded(c))


def trim(c: Column) -> Column:
    """Strip; drop line breaks; other white space becomes one space; drop quotes."""
    return _trim(ascii_folded(c))


#: What is left of a function once its input is folded.
AFTER_FOLDING = {lowercase: _lower, trim: _trim}


def folded(functions: tuple[Callable[[Column], Column], ...], c: Column) -> Column:
    """The functions in order; those that fold, one right after the other, fold once."""
    clean = False
    for f in functions:
        rest = AFTER_FOLDING.get(f)
        if rest is None:
            c, clean = f(c), False
        else:
            c, clean = rest(c if clean else ascii_folded(c)), True
    return c
