"""Scalar expressions over paths, names, sizes and durations; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from copyfold.functions.dimensions import BACKUP_DIRS, BACKUP_EXTENSIONS

# A year, month and day in a name; a year in parentheses.
DATE = r"(20\d{2}|19\d{2})[-_.]?(0[1-9]|1[0-2])[-_.]?(0[1-9]|[12]\d|3[01])"
YEAR = r"\((20\d{2}|19\d{2})\)"

# The pattern of names of derived copies, and that of names of backups; upper and lower case count alike.
DERIVED = r"(copy of|\bcopy\b|\(\s*\d+\s*\)|[-_ ](?:resized|small|thumb|thumbnail|edited?|dup(?:licate)?)\b)"
BACKUP_WORDS = r"(?:\bbackup\b|\bbak\b|\bcopy\b|copy of|\bold\b|\barchive\b|~$|\bv\d+\b)"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """What stands before the last slash; '/' for entries of the root."""
    head = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when((head == "") & F.startswith(path, F.lit("/")), F.lit("/")).otherwise(head)


def extension(name: Column) -> Column:
    """Lower-case extension with its dot; leading dots start no extension."""
    return F.lower(F.regexp_extract(name, r"^.*[^.].*(\.[^.]*)$", 1))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))


def pixels(width: Column, height: Column) -> Column:
    return width.cast("bigint") * height.cast("bigint")


def resolution(width: Column, height: Column) -> Column:
    return F.when((width == 0) | (height == 0), F.lit("")).otherwise(F.concat(width.cast("string"), F.lit("x"), height.cast("string")))


def under(path: Column, root: str) -> Column:
    """Whether a path is ``root`` or below it; a sibling that merely shares its letters is not."""
    root = root.rstrip("/")
    return (path == root) | F.startswith(path, F.lit(root + "/"))


def is_derived(name: Column) -> Column:
    return name.rlike(f"(?iU){DERIVED}")


def embedded_date(name: Column) -> Column:
    """Epoch seconds of the first date in a name, else of a year in parentheses, else null.

    A date that doesn't exist is null and doesn't fall back to the year.
    """
    found = F.regexp_extract(name, DATE, 0)
    parts = [F.regexp_extract(name, DATE, i) for i in (1, 2, 3)]
    date = F.try_to_timestamp(F.concat_ws("-", *parts), F.lit("yyyy-MM-dd"))
    year = F.regexp_extract(name, YEAR, 1)
    first = F.try_to_timestamp(F.concat(F.nullif(year, F.lit("")), F.lit("-01-01")), F.lit("yyyy-MM-dd"))
    return F.when(found != "", date).otherwise(first).cast("double")


def backup_score(path: Column) -> Column:
    """Sum of the signs of a backup: extension or tilde, words, folder, date."""
    name = basename(path)
    parent = F.lower(basename(dirname(path)))

    def part(condition: Column, weight: float) -> Column:
        return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))

    return (
        part(F.endswith(name, F.lit("~")) | extension(name).isin(*BACKUP_EXTENSIONS), 0.6)
        + part(name.rlike(f"(?iU){BACKUP_WORDS}"), 0.4)
        + part(parent.isin(*BACKUP_DIRS), 0.4)
        + part(embedded_date(name).isNotNull(), 0.2)
    )


def parsed_extensions(text: Column) -> Column:
    """The extensions of a list as it is typed, with commas or white space between them."""
    return normalized_extensions(F.split(text, r"(?U)[,\s]+"))


def normalized_extensions(exts: Column) -> Column:
    """An array of extensions trimmed, lower-case, dotted, distinct and sorted; empty ones go."""
    cleaned = F.filter(F.transform(exts, lambda e: F.lower(F.trim(e))), lambda e: e != "")
    return F.array_sort(F.array_distinct(F.transform(cleaned, lambda e: F.when(F.startswith(e, F.lit(".")), e).otherwise(F.concat(F.lit("."), e)))))


def one_decimal(x: Column) -> Column:
    """A number from 0 up as text with one decimal, rounded from its exact binary value, half to even.

    The value is taken apart in integers: below 1000 a double has at most 52 binary places, from there on at most 43.
    """

    def rounded(places: int) -> Column:
        units = (x * float(1 << places)).cast("bigint")
        tenths = units.bitwiseAND(F.lit((1 << places) - 1)) * 10
        low = F.shiftright(units, places) * 10 + F.shiftright(tenths, places)
        rest, half = tenths.bitwiseAND(F.lit((1 << places) - 1)), 1 << (places - 1)
        up = (rest > half) | ((rest == half) & (low % 2 == 1))
        out = low + up.cast("bigint")
        return F.concat(F.floor(out / 10).cast("string"), F.lit("."), (out % 10).cast("string"))

    return F.when(x < 1000, rounded(52)).otherwise(rounded(43))


def human_bytes(n: Column) -> Column:
    """Size in units of 1000 with one decimal, bytes without."""
    n = n.cast("double")
    out = F.concat(one_decimal(n / 1e15), F.lit(" PB"))
    for unit, scale in (("TB", 1e12), ("GB", 1e9), ("MB", 1e6), ("KB", 1e3)):
        out = F.when(n < scale * 1000, F.concat(one_decimal(n / scale), F.lit(f" {unit}"))).otherwise(out)
    return F.when(n < 1000, F.format_string("%d B", n.cast("bigint"))).otherwise(out)


def human_count(n: Column) -> Column:
    return F.format_number(n, 0)


def duration(seconds: Column) -> Column:
    whole = seconds.cast("bigint")
    minutes = F.format_string("%dm %ds", F.floor(whole / 60), whole % 60)
    return F.when(seconds < 1, F.lit("<1s")).when(seconds < 60, F.concat(one_decimal(seconds.cast("double")), F.lit("s"))).otherwise(minutes)


def relative_time(when: Column, now: float) -> Column:
    age = F.lit(float(now)) - when
    return (
        F.when(age < 60, F.lit("just now"))
        .when(age < 3600, F.format_string("%d min ago", F.floor(age / 60)))
        .when(age < 86400, F.format_string("%d h ago", F.floor(age / 3600)))
        .otherwise(F.format_string("%d days ago", F.floor(age / 86400)))
    )


def filter_label(types: Column) -> Column:
    """All types when empty, up to five by name, else four and how many more."""
    more = F.concat(F.array_join(F.slice(types, 1, 4), ", "), F.lit(" +"), (F.size(types) - 4).cast("string"), F.lit(" more"))
    return F.when(F.size(types) == 0, F.lit("All Files")).when(F.size(types) <= 5, F.array_join(types, ", ")).otherwise(more)


def fraction(done: Column, total: Column) -> Column:
    return F.when(total > 0, done / total).otherwise(F.lit(0.0))


def as_bool(value: Column) -> Column:
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "yes"), F.lit(False))


def strip_markup(text: Column) -> Column:
    """Tags as spaces, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two arrays of distinct values: 1 if both are empty, 0 if one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def drive_label(model: Column, kind: Column, transport: Column, fstype: Column) -> Column:
    return F.concat_ws(" · ", *[F.nullif(c, F.lit("")) for c in (model, kind, F.upper(transport), fstype)])
