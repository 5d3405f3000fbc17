"""Text expressions. Offsets are characters unless a name says bytes; null texts give null."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ligatures that search expands, and what for.
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
SOFT_HYPHEN = "\u00ad"
#: What separates whole words besides white space and control characters.
BOUNDARY = "[\\s\\p{Cntrl}.,;:!?()\\[\\]{}\"'\\-/\\\\]"
#: Private-use characters; a text with a tenth of them, or with a replacement character, is unreliable.
PRIVATE_USE = "[\uE000-\uF8FF]"


def normalize(text: Column) -> Column:
    """Lower case, soft hyphens dropped, four ligatures expanded; accents stay."""
    out = F.replace(F.lower(text), F.lit(SOFT_HYPHEN), F.lit(""))
    for one, many in LIGATURES:
        out = F.replace(out, F.lit(one), F.lit(many))
    return out


def fold_accents(text: Column, pairs: tuple[str, str] = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")) -> Column:
    """A separate option: letters without their accents."""
    return F.translate(text, *pairs)


def char_at(text: Column, at: Column) -> Column:
    """The character at a 0-based place, empty outside."""
    return F.when(at < 0, F.lit("")).otherwise(F.substring(text, at + 1, F.lit(1)))


def is_boundary(char: Column) -> Column:
    return (char == "") | char.rlike(BOUNDARY)


def overlaps_itself(needle: str) -> bool:
    """Whether two occurrences of needle can share characters: whether some end of it is also its beginning."""
    return any(needle.startswith(needle[i:]) for i in range(1, len(needle)))


def starts_of(text: Column, needle: str) -> Column:
    """All starts of needle, overlapping ones too, as an array: the text is cut before each of them, in one pass."""
    pieces = F.split(text, f"(?=\\Q{needle}\\E)", -1)
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda held, x: F.concat(held, F.array(F.element_at(held, -1) + F.length(x))))
    inner = F.slice(ends, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.when(F.startswith(text, F.lit(needle)), F.concat(F.array(F.lit(0)), inner)).otherwise(inner)


def apart(starts: Column, width: int) -> Column:
    """From left to right, starts that begin where no earlier hit covers."""
    empty = F.array().cast("array<int>")
    return F.aggregate(starts, empty, lambda held, i: F.when((F.size(held) == 0) | (i >= F.element_at(held, -1) + width), F.concat(held, F.array(i))).otherwise(held))


def hits(text: Column, needle: str, whole_word: bool = False, overlapping: bool = False) -> Column:
    """Starts of needle in text: left to right without overlap unless told otherwise; a rejected word moves one on."""
    n = len(needle)
    found = starts_of(text, needle)
    if whole_word:
        found = F.filter(found, lambda i: is_boundary(char_at(text, i - 1)) & is_boundary(char_at(text, i + n)))
    return found if overlapping else apart(found, n)


def hit_count(text: Column, needle: str) -> Column:
    """How many times needle occurs without overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def byte_offset(text: Column, at: Column) -> Column:
    return F.octet_length(F.substring(text, F.lit(1), at))


def is_reliable(text: Column) -> Column:
    """Empty texts are; texts with U+FFFD or with a tenth of private-use characters aren't."""
    private = F.length(text) - F.length(F.regexp_replace(text, PRIVATE_USE, ""))
    return (F.length(text) == 0) | ((F.instr(text, "\ufffd") == 0) & (F.try_divide(private, F.length(text)) < 0.1))


def html_escape(text: Column) -> Column:
    out = text
    for one, many in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(one), F.lit(many))
    return out


def xml_escape(text: Column) -> Column:
    out = text
    for one, many in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(one), F.lit(many))
    return out


def xml_unescape(text: Column) -> Column:
    out = text
    for many, one in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(many), F.lit(one))
    return out


def pdf_escape(text: Column) -> Column:
    """Backslash, then parentheses and line ends, as in a literal string of the file format."""
    out = text
    for one, many in (("\\", "\\\\"), ("(", "\\("), (")", "\\)"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(one), F.lit(many))
    return out


def padded(number: Column, width: int) -> Column:
    """Zeros up to a least width; longer numbers stay whole."""
    return F.format_string(f"%0{width}d", number)


def short_number(number: Column) -> Column:
    """Four decimals without trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", number), "\\.?0+$", "")


def safe_file_name(name: Column) -> Column:
    """The last part of a path; control and reserved characters become _, outer dots and blanks go."""
    base = F.regexp_extract(name, "[^/\\\\]*$", 0)
    clean = F.regexp_replace(base, '[\\x00-\\x1f<>:"|?*]', "_")
    trimmed = F.regexp_replace(clean, "^[. ]+|[. ]+$", "")
    return F.when(trimmed == "", F.lit("attachment")).otherwise(trimmed)


def composite_key(source: Column, page: Column) -> Column:
    return F.concat_ws(":", source, page.cast("string"))
