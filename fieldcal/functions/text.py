"""Text column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Device names that are not allowed as file names, and the characters never allowed.
RESERVED_NAMES = (
    ["CON", "PRN", "AUX", "NUL"] + [f"COM{i}" for i in range(1, 10)] + [f"LPT{i}" for i in range(1, 10)]
)
FORBIDDEN_CHARS = r'[<>:"/\\|?*]'


def first_upper(s: Column) -> Column:
    return F.concat(F.upper(F.left(s, F.lit(1))), F.substr(s, F.lit(2)))


def capitalize(s: Column) -> Column:
    """First character upper, the rest lower."""
    return F.concat(F.upper(F.left(s, F.lit(1))), F.lower(F.substr(s, F.lit(2))))


def concat_pair(s1: Column, s2: Column, sep: str = "") -> Column:
    return F.concat(s1, F.lit(sep), s2)


def concat_all(parts: Column, sep: str = "") -> Column:
    return F.array_join(parts, sep)


def digits_only(s: Column) -> Column:
    return F.regexp_replace(s, r"\D", "")


def is_vowel(c: Column) -> Column:
    return c.rlike(r"^[aeiouAEIOU]$")


def is_consonant(c: Column) -> Column:
    return c.rlike(r"^\p{L}$") & ~is_vowel(c)


def acronym(s: Column, n_chars: int = 3) -> Column:
    """First character, following consonants and all digits, ``n_chars`` long.

    NULL where the digits alone fill the acronym, in place of an exception that would end the job.
    """
    upper = F.upper(s)
    digits = digits_only(upper)
    consonants = F.regexp_replace(F.substr(upper, F.lit(2)), r"[^\p{L}]|[AEIOU]", "")
    room = F.lit(n_chars) - F.length(digits)
    made = F.concat(F.left(upper, F.lit(1)), F.left(consonants, room - 1), digits)
    return F.when((room > 0) & (F.length(s) > 0), made)


def is_valid_filename(name: Column) -> Column:
    length = F.length(name)
    stem = F.upper(F.substring_index(name, ".", 1))
    return F.coalesce(
        (length > 0) & (length <= 255) & ~name.rlike(FORBIDDEN_CHARS) & ~stem.isin(RESERVED_NAMES), F.lit(False)
    )


def choose(values: Column, *key: Column, seed: int = 0) -> Column:
    """An element of an array, drawn by a hash of the row key, so it does not move with partitioning."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in key]))
    number = F.conv(F.left(digest, F.lit(12)), 16, 10).cast("long")
    return F.element_at(values, (number % F.size(values) + 1).cast("int"))


def model_label(name: Column) -> Column:
    """Display label of a model name: short names in capitals, others word by word."""
    words = F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))
    return F.replace(
        F.when(F.length(name) > 3, words).otherwise(F.upper(name)), F.lit("Cocal"), F.lit("COCAL")
    )


def header_label(name: str) -> str:
    return name.capitalize().replace("_", " ")


def adler32(s: Column) -> Column:
    """Adler-32 checksum of the UTF-8 bytes, as a built-in fold over the bytes."""
    hex_text = F.hex(F.encode(s, "UTF-8"))
    positions = F.sequence(F.lit(1), F.length(hex_text) - 1, F.lit(2))
    byte_values = F.transform(
        positions, lambda p: F.conv(F.substr(hex_text, p, F.lit(2)), 16, 10).cast("long")
    )
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))

    def step(acc: Column, byte: Column) -> Column:
        a = (acc["a"] + byte) % 65521
        return F.struct(a.alias("a"), ((acc["b"] + a) % 65521).alias("b"))

    folded = F.aggregate(byte_values, start, step, lambda acc: acc["b"] * 65536 + acc["a"])
    return F.when(F.length(s) > 0, folded).when(s.isNotNull(), F.lit(1).cast("long"))


def parse_augmentation(mode: Column) -> Column:
    """``simple_<share>_<copies>_<xnoise>_<ynoise>`` to a struct of numbers."""
    parts = F.split(mode, "_")
    return F.when(
        F.startswith(mode, F.lit("simple")),
        F.struct(
            F.get(parts, F.lit(1)).try_cast("double").alias("share"),
            F.get(parts, F.lit(2)).try_cast("int").alias("copies"),
            F.get(parts, F.lit(3)).try_cast("double").alias("x_noise"),
            F.get(parts, F.lit(4)).try_cast("double").alias("y_noise"),
        ),
    )


def argument_line(pairs: Column, sep: str = ";") -> Column:
    """A map of run arguments as ``key;value;…``, sorted by key."""
    entries = F.array_sort(F.map_entries(pairs))
    return F.array_join(F.transform(entries, lambda e: F.concat_ws(sep, e["key"], e["value"])), sep)


def parse_argument_line(line: Column, sep: str = ";") -> Column:
    """``key;value;key;value…`` to a map."""
    parts = F.split(line, sep)
    positions = F.sequence(F.lit(0), F.size(parts) - 1)
    keys = F.filter(F.transform(positions, lambda i: F.when(i % 2 == 0, F.get(parts, i))), lambda x: x.isNotNull())
    values = F.filter(F.transform(positions, lambda i: F.when(i % 2 == 1, F.get(parts, i))), lambda x: x.isNotNull())
    return F.map_from_arrays(keys, values)
