"""Parse text cells into typed values as column expressions.

Every parser returns NULL for text it cannot read; ``unreadable`` tells such a
cell from an empty one, so a bad cell becomes an error message instead of a
failed job. Date text is recognised by its shape, rewritten to ISO form and
cast: a cast that fails gives NULL, while a datetime parser that fails costs a
Java exception per row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters removed at both ends of a cell.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Accepted spellings of a boolean.
TRUE_WORDS = ("true", "1", "yes", "y", "active")
FALSE_WORDS = ("false", "0", "no", "n", "inactive")

MONEY = "decimal(14,2)"
QUANTITY = "decimal(14,3)"

_CLOCK = r"\d{1,2}:\d{1,2}:\d{1,2}"
_ISO_DAY = r"\d{4}-\d{1,2}-\d{1,2}"
_SLASH_DAY = r"(\d{1,2})/(\d{1,2})/(\d{4})"
_SCRIPT = r"[A-Za-z]{3} [A-Za-z]{3} \d{1,2} \d{4} " + _CLOCK + r" GMT[+-]\d{2}:?\d{2}"
_MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_text(c: Column | str) -> Column:
    """Trim a cell; an empty cell becomes NULL.

    A cell that begins and ends with a printable ASCII character is its own trimmed text: it is not searched for the
    28 characters of ``WHITESPACE``, which costs more than reading the value.
    """
    text = _col(c)
    return F.when(_printable(text) & _printable(F.right(text, F.lit(1))), text).otherwise(
        F.nullif(F.btrim(text, F.lit(WHITESPACE)), F.lit(""))
    )


def _printable(text: Column) -> Column:
    """Whether the first character is one of ``!`` to ``~``."""
    return F.ascii(text).between(33, 126)


def _trimmed(c: Column | str, is_trimmed: bool) -> Column:
    return _col(c) if is_trimmed else clean_text(c)


def unreadable(raw: Column | str, parsed: Column) -> Column:
    """True where the cell holds text but the parser found no value."""
    return clean_text(raw).isNotNull() & parsed.isNull()


def drop_zone_name(c: Column | str, is_trimmed: bool = False) -> Column:
    """Cut the trailing `` (zone description)`` of a script-style date."""
    text = _col(c)
    cut = clean_text(F.substring_index(text, " (", 1))
    return F.when(~F.contains(text, F.lit(" (")), text).otherwise(cut) if is_trimmed else cut


def _shaped(text: Column, shape: str) -> Column:
    return text.rlike(f"^{shape}$")


def _rewrite(text: Column, shape: str, form: str) -> Column:
    return F.regexp_replace(text, f"^{shape}$", form)


def _day(iso_text: Column) -> Column:
    return iso_text.try_cast("date")


def _instant(iso_text: Column) -> Column:
    return iso_text.try_cast("timestamp")


def _script_day(text: Column) -> Column:
    """ISO day of ``Sat Aug 15 2026 ...``: the calendar day where it was written."""
    place = F.position(F.lower(F.substring(text, 5, 3)), F.lit(_MONTHS))
    month = F.when(place % 3 == 1, ((place + 2) / 3).cast("int").cast("string"))
    return F.concat_ws("-", _word(text, 4), F.coalesce(month, F.lit("?")), _word(text, 3))


def _word(text: Column, n: int) -> Column:
    return F.split_part(text, F.lit(" "), F.lit(n))


def _script_instant(text: Column) -> Column:
    zone = _word(text, 6)
    offset = F.concat(F.substring(zone, 4, 3), F.lit(":"), F.right(zone, F.lit(2)))
    return F.concat(_script_day(text), F.lit(" "), _word(text, 5), offset)


def parse_date_day_first(c: Column | str, is_trimmed: bool = False) -> Column:
    """Date A: ISO day, ISO day with clock, day/month before month/day, script text."""
    text = drop_zone_name(c, is_trimmed)
    return (
        F.when(_shaped(text, _ISO_DAY), _day(text))
        .when(_shaped(text, _ISO_DAY + " " + _CLOCK), _instant(text).cast("date"))
        .when(
            _shaped(text, _SLASH_DAY),
            F.coalesce(_day(_rewrite(text, _SLASH_DAY, "$3-$2-$1")), _day(_rewrite(text, _SLASH_DAY, "$3-$1-$2"))),
        )
        .when(_shaped(text, _SCRIPT), _day(_script_day(text)))
    )


def parse_date_month_first(c: Column | str, is_trimmed: bool = False) -> Column:
    """Date B: ISO day with dashes or slashes, month/day before day/month, d-m-Y, script text."""
    text = drop_zone_name(c, is_trimmed)
    return (
        F.when(_shaped(text, _ISO_DAY), _day(text))
        .when(
            _shaped(text, _SLASH_DAY),
            F.coalesce(_day(_rewrite(text, _SLASH_DAY, "$3-$1-$2")), _day(_rewrite(text, _SLASH_DAY, "$3-$2-$1"))),
        )
        .when(_shaped(text, r"\d{4}/\d{1,2}/\d{1,2}"), _day(F.replace(text, F.lit("/"), F.lit("-"))))
        .when(
            _shaped(text, r"(\d{1,2})-(\d{1,2})-(\d{4})"),
            _day(_rewrite(text, r"(\d{1,2})-(\d{1,2})-(\d{4})", "$3-$2-$1")),
        )
        .when(_shaped(text, _SCRIPT), _day(_script_day(text)))
    )


def _basic_instants(text: Column, start: Column) -> Column:
    """``start`` extended by the timestamp shapes every source may use."""
    return start.when(_shaped(text, _ISO_DAY + "T" + _CLOCK + r"(\.\d{1,6})?"), _instant(text)).when(
        _shaped(text, _SCRIPT), _instant(_script_instant(text))
    )


def parse_timestamp_basic(c: Column | str, is_trimmed: bool = False) -> Column:
    """Timestamp A: clock after blank or ``T``, fraction after ``T``, script text with its offset."""
    text = drop_zone_name(c, is_trimmed)
    return _basic_instants(text, F.when(_shaped(text, _ISO_DAY + " " + _CLOCK), _instant(text)))


def parse_timestamp_wide(c: Column | str, is_trimmed: bool = False) -> Column:
    """Timestamp B: as A, and also minutes only, a bare day, and month/day/year with or without clock."""
    text = drop_zone_name(c, is_trimmed)
    slash_clock = _SLASH_DAY + " (" + _CLOCK + ")"
    return (
        _basic_instants(text, F.when(_shaped(text, _ISO_DAY + r"( \d{1,2}:\d{1,2}(:\d{1,2})?)?"), _instant(text)))
        .when(_shaped(text, slash_clock), _instant(_rewrite(text, slash_clock, "$3-$1-$2 $4")))
        .when(_shaped(text, _SLASH_DAY), _instant(_rewrite(text, _SLASH_DAY, "$3-$1-$2")))
    )


def parse_int(c: Column | str, is_trimmed: bool = False) -> Column:
    """Whole number without fraction or exponent."""
    text = _trimmed(c, is_trimmed)
    return F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))


def parse_decimal(c: Column | str, to: str = MONEY, is_trimmed: bool = False) -> Column:
    """Plain number; exponents are read, thousands separators are not."""
    return _trimmed(c, is_trimmed).try_cast(to)


def parse_decimal_commas(c: Column | str, to: str = MONEY, is_trimmed: bool = False) -> Column:
    """Number with optional thousands separators."""
    return F.replace(_trimmed(c, is_trimmed), F.lit(","), F.lit("")).try_cast(to)


def parse_decimal_dollars(c: Column | str, to: str = MONEY, is_trimmed: bool = False) -> Column:
    """Number with optional currency sign and thousands separators."""
    return F.regexp_replace(_trimmed(c, is_trimmed), r"[$,]", "").try_cast(to)


def parse_amount(c: Column | str, to: str = MONEY, is_trimmed: bool = False) -> Column:
    """Currency amount; parentheses mean a negative value, as does a leading minus."""
    text = F.btrim(F.regexp_replace(_trimmed(c, is_trimmed), r"[$,]", ""), F.lit(WHITESPACE))
    in_parens = text.rlike(r"^\([\s\S]*\)$")
    inner = F.btrim(F.when(in_parens, F.regexp_replace(text, r"^\(|\)$", "")).otherwise(text), F.lit(WHITESPACE))
    negative = in_parens | inner.startswith("-")
    size = F.regexp_replace(inner, "^-", "").try_cast(to)
    return F.when(negative, -size).otherwise(size).cast(to)


def parse_quantity(c: Column | str, is_trimmed: bool = False) -> Column:
    """Quantity with separators and accounting parentheses, three decimals. A currency sign is no quantity."""
    return F.when(~F.contains(_trimmed(c, is_trimmed), F.lit("$")), parse_amount(c, QUANTITY, is_trimmed))


def parse_boolean(c: Column | str, is_trimmed: bool = False) -> Column:
    """Yes/no words in any letter case."""
    word = F.lower(_trimmed(c, is_trimmed))
    return F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))


def normalize_term(c: Column | str) -> Column:
    """Business term in comparable form: lower case, blanks for underscores, single blanks."""
    spaced = F.regexp_replace(F.replace(_col(c), F.lit("_"), F.lit(" ")), r"\s+", " ")
    return F.lower(F.btrim(spaced, F.lit(WHITESPACE)))
