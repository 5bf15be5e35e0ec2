"""Text expressions: tokens, masks, levels, timestamps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT = "<*>"

#: Spellings of the seven levels.
LEVELS = {
    "trace": ["trace"],
    "debug": ["debug", "dbg"],
    "info": ["info", "information"],
    "notice": ["notice"],
    "warning": ["warning", "warn"],
    "error": ["error", "err"],
    "critical": ["critical", "crit", "fatal", "alert", "emerg", "emergency", "panic"],
}


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with the value computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def level_of(spelling: Column) -> Column:
    """The canonical level of any spelling, else null."""
    word = F.lower(F.trim(spelling))
    out = F.lit(None).cast("string")
    for level, spellings in LEVELS.items():
        out = F.when(word.isin(spellings), level).otherwise(out)
    return out


def tokens(message: Column) -> Column:
    """Split at any Unicode white space, without empty tokens."""
    return F.filter(F.split(message, r"(?U)\s+"), lambda t: t != "")


def masked(parts: Column) -> Column:
    """Tokens with a digit become slots."""
    return F.transform(parts, lambda t: F.when(t.rlike(r"(?U)\d") | (t == SLOT), SLOT).otherwise(t))


def params(parts: Column, template: Column) -> Column:
    """The message's tokens at the template's slots."""
    at_slot = F.transform(parts, lambda t, i: F.when(F.get(template, i) == SLOT, t))
    return F.filter(at_slot, lambda t: t.isNotNull())


def timestamp_of(text: Column) -> Column:
    """ISO 8601 (comma decimals too), epoch seconds or milliseconds by length, and common log layouts."""
    t = F.trim(text)
    length, mark = F.length(t), lambda at: F.substring(t, at, 1)
    layout = lambda p: F.try_to_timestamp(t, F.lit(p))
    return (  # what stands where tells which layout to try
        F.when(all_digits(t) & (length == 13), F.timestamp_millis(t.try_cast("long")))
        .when(all_digits(t) & length.between(9, 12), F.timestamp_seconds(t.try_cast("double")))
        .when(all_digits(t) & (length == 8), layout("yyyyMMdd"))
        .when(mark(5) == "-", F.when(picture(F.left(t, F.lit(16))).isin("9999-99-99", "9999-99-99a99:99", "9999-99-99 99:99") & mark(11).isin("", "T", " "), F.replace(t, F.lit(","), F.lit(".")).try_cast("timestamp")))
        .when(mark(5) == "/", layout("yyyy/MM/dd HH:mm:ss"))
        .when(mark(3) == "-", F.coalesce(layout("dd-MM-yyyy HH:mm:ss"), layout("MM-dd-yyyy HH:mm:ss")))
        .when(mark(3) == "/", F.coalesce(layout("dd/MMM/yyyy:HH:mm:ss Z"), layout("dd/MMM/yyyy:HH:mm:ss")))
    )


def all_digits(text: Column) -> Column:
    """Whether a text has characters, all of them 0 to 9."""
    return (text != "") & (F.translate(text, "0123456789", "") == "")


def picture(text: Column) -> Column:
    """A text with 9 for each digit and a for each ASCII letter."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return F.translate(text, "0123456789" + letters + letters.upper(), "9" * 10 + "a" * 52)


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def group(text: Column, pattern: str, index: int) -> Column:
    """A regular expression's group; null where the whole doesn't match or the group is empty."""
    return F.nullif(F.regexp_extract(text, pattern, index), F.lit(""))


def unterminated(line: Column) -> Column:
    """Whether brackets or quotes stay open, folding over the characters with escapes in mind."""
    state = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(s: Column, c: Column) -> Column:
        quote = (c == '"') & ~s["escaped"]
        depth = F.when(s["quoted"], s["depth"]).when(c.isin("{", "["), s["depth"] + 1).when(c.isin("}", "]"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when(quote, ~s["quoted"]).otherwise(s["quoted"]).alias("quoted"), (s["quoted"] & (c == "\\") & ~s["escaped"]).alias("escaped"))

    return F.aggregate(F.split(line, ""), state, step, lambda s: (s["depth"] > 0) | s["quoted"])
