"""Text functions as column expressions; Java's regular expressions need (?U) for Unicode white space."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The labels of a total row, matched anywhere in a lower-cased first cell.
TOTAL_LABELS = ("合計", "小計", "總計", "總額", "合 計", "total", "sum", "subtotal")
# What counts as a clause heading, tried in this order.
CLAUSE_PATTERNS = (
    r"(?U)^\s*(第\s*[一二三四五六七八九十百千零兩\d]+\s*條)",
    r"(?iU)^\s*(Article\s+\d+)",
    r"(?iU)^\s*(Section\s+\d+)",
    r"(?U)^\s*(\d+(?:\.\d+)*)[\.\)、]",
)
# Date styles by name.
DATE_STYLES = {
    "YYYY/MM/DD": r"(?U)\b\d{4}/\d{1,2}/\d{1,2}\b",
    "YYYY-MM-DD": r"(?U)\b\d{4}-\d{1,2}-\d{1,2}\b",
    "YYYY年MM月DD日": r"(?U)\d{4}年\d{1,2}月\d{1,2}日",
    "MM/DD/YYYY": r"(?U)\b\d{1,2}/\d{1,2}/\d{4}\b",
}


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize_heading(text: Column) -> Column:
    """Letters and digits alone, lower case."""
    return F.lower(F.regexp_replace(text, r"(?U)[\W_]+", ""))


def normalize_label(text: Column) -> Column:
    """A table label without any white space, the full-width space included."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def to_number(text: Column) -> Column:
    """The number in a cell: all but digits, points and minus signs goes; null if that is none."""
    kept = F.regexp_replace(text, r"(?U)[^\d.\-]", "")
    return F.when(kept.rlike(r"^-?(\d+\.?\d*|\.\d+)$"), kept.try_cast("double"))


def plain_float(text: Column) -> Column:
    """A plain decimal with optional sign and white space around it; no exponent."""
    return F.when(text.rlike(r"(?U)^\s*-?\d+(\.\d+)?\s*$"), strip(text).try_cast("double"))


def is_total_label(text: Column) -> Column:
    label = F.lower(strip(text))
    return F.coalesce(F.exists(F.array(*(F.lit(x) for x in TOTAL_LABELS)), lambda x: F.contains(label, x)), F.lit(False))


def clause_key(text: Column) -> Column:
    """The key of a clause heading without white space, or null."""
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for p in CLAUSE_PATTERNS]
    return F.regexp_replace(F.coalesce(*found), r"(?U)\s+", "")


def pointer_part(part: Column) -> Column:
    """One escaped segment of a JSON pointer, with its slash."""
    return F.concat(F.lit("/"), F.replace(F.replace(part.cast("string"), F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))


def clip(text: Column, limit: int = 8192) -> Column:
    """Without NUL, stripped and cut."""
    return F.substring(strip(F.replace(text, F.lit("\0"), F.lit(""))), 1, limit)


def cell_text(value: Column) -> Column:
    """A scalar as cell text: whole doubles lose the fraction, null is empty."""
    return F.coalesce(F.regexp_replace(value.cast("string"), r"^(-?\d+)\.0$", "$1"), F.lit(""))


def date_styles(text: Column) -> Column:
    """The sorted names of the date styles in a text."""
    return F.array_sort(F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in DATE_STYLES.items()))))


def has_any(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(F.lower(text), F.lower(w)))


def hits(text: Column, words: Column) -> Column:
    return F.filter(words, lambda w: F.contains(F.lower(text), F.lower(w)))


def is_placeholder(text: Column, patterns: Column) -> Column:
    """Blank, holding a placeholder pattern, or shorter than eight characters."""
    body = strip(F.coalesce(text, F.lit("")))
    return (F.length(body) < 8) | has_any(body, patterns)


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def artifact_id(name: Column, digest: Column) -> Column:
    return F.sha2(F.concat(name, F.lit("\0"), digest), 256)


def milliseconds(stamp: Column) -> Column:
    """[HH:]MM:SS,mmm or with a point, in milliseconds."""
    parts = F.transform(F.split(F.replace(stamp, F.lit(","), F.lit(".")), ":"), lambda x: x.try_cast("decimal(12,3)"))
    return (F.aggregate(parts, F.lit(0).cast("decimal(20,3)"), lambda a, x: (a * 60 + x).cast("decimal(20,3)")) * 1000).cast("long")


def column_letters(index: Column) -> Column:
    """0-based column number to spreadsheet letters, up to three."""
    n = index.cast("int")
    letter = lambda c: F.chr((c % 26 + 65).cast("long"))
    one, two = letter(n), F.concat(letter(F.floor(n / 26) - 1), letter(n))
    m = n - 702
    three = F.concat(letter(F.floor(m / 676)), letter(F.floor(m / 26)), letter(m))
    return F.when(n < 26, one).when(n < 702, two).otherwise(three)


def exact_decimal(text: Column, scale: int) -> Column:
    """An ASCII decimal of at most 18 integer digits and exactly ``scale`` fraction digits; -0 is 0."""
    fraction = rf"\.\d{{{scale}}}" if scale else ""
    ok = text.rlike(rf"^-?(0|[1-9][0-9]{{0,17}}){fraction}$")
    return F.when(ok, F.regexp_replace(text, r"^-(0(\.0*)?)$", "$1"))


def trim_row(cells: Column, width: int = 32) -> Column:
    """At most ``width`` cells, without empty ones at the end, one at least."""
    some = F.slice(cells, 1, width)
    last = F.aggregate(
        F.transform(some, lambda c, i: F.when(c != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x)
    )
    return F.slice(some, F.lit(1), F.greatest(last, F.lit(1)))
