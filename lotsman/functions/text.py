"""Column expressions on texts and hierarchical codes.  Null, missing and blank are one value after ``strip``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAF = r"^[0-9]+\.[0-9]+\.[0-9]+\z"
#: Phrases that make a whole segment uninformative.
STOP_PHRASES = ("проект", "утверждаю", "техническое задание", "согласовано", "приложение", "содержание", "раздел", "задачи:", "задача:", "цель:", "цель")
#: Characters that mark a list item before white space.
LIST_SIGNS = "•‣◦▪●o·-"
#: Signs after which two or more blanks become one.
TIGHT_SIGNS = "•◦▪▫○●◉◯◐◑◒◓◔◕◖◗◘◙◚◛◜◝◞◟◠◡·o-"
#: Characters that count as a blank.
NO_BREAK = "\u00a0\u2007\u202f\u2060\ufeff"
#: Notices that a document converter puts into a text.
WATERMARKS = (r"Created with an evaluation copy of Aspose\.Words\..*?license/", r"Evaluation Only\. Created with Aspose\.Words\..*?Aspose Pty Ltd\.")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str, chars: str = r"\s") -> Column:
    """Both ends without (Unicode) white space, or without the given class of characters; null gives ''."""
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), rf"(?U)^[{chars}]+|[{chars}]+$", "")


def missing(c: Column | str) -> Column:
    """Stripped text, or null where it is blank."""
    return F.nullif(strip(c), F.lit(""))


def squeeze(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), r"(?U)\s+", " "))


def is_leaf(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(LEAF), F.lit(False))


def is_leaf_loose(c: Column | str) -> Column:
    """Three non-empty parts, digits or not."""
    return F.coalesce(col(c).rlike(r"^[^.]+\.[^.]+\.[^.]+\z"), F.lit(False))


def to_level(c: Column | str, level: int) -> Column:
    """The first ``level`` parts; null when there are fewer or one of them is not all digits."""
    if level <= 0:
        return F.lit(None).cast("string")
    head = F.substring_index(col(c), ".", level)
    return F.when((F.size(F.split(col(c), r"\.")) >= level) & head.rlike(rf"^[0-9]+(\.[0-9]+){{{level - 1}}}\z"), head)


def roll_up(codes: Column | str, level: int) -> Column:
    """Codes of a list at a level, each once, in the order of their first occurrence."""
    return F.array_distinct(F.filter(F.transform(col(codes), lambda x: to_level(x, level)), lambda x: x.isNotNull()))


def parent_of(leaf: Column | str) -> Column:
    return F.when(is_leaf(leaf), F.substring_index(col(leaf), ".", 2)).otherwise(col(leaf))


def grand_of(leaf: Column | str) -> Column:
    return F.substring_index(col(leaf), ".", 1)


def code_list(c: Column | str, leaves: bool = True) -> Column:
    """Parts of a ';'-list, stripped, without empty ones, in order; only leaf codes if asked."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), ";"), lambda x: strip(x))
    return F.filter(parts, lambda x: is_leaf(x) if leaves else x != "")


def document_text(title: Column | str, abstract: Column | str) -> Column:
    return strip(F.concat(strip(title), F.lit("\n\n"), strip(abstract)))


#: A label that begins with its code.
_LABEL = r"^(\d{2}(?:\.\d{2}){0,2})\s*((?s).*)$"


def label_code(label: Column | str) -> Column:
    return F.nullif(F.regexp_extract(strip(label), _LABEL, 1), F.lit(""))


def label_title(label: Column | str) -> Column:
    """The label without its code; the code where nothing is left, the label where there is no code."""
    title = F.nullif(strip(F.regexp_extract(strip(label), _LABEL, 2), r"\s:–\-"), F.lit(""))
    return F.when(label_code(label).isNull(), strip(label)).otherwise(F.coalesce(title, label_code(label)))


def display_label(label: Column | str) -> Column:
    """Parts of a full label on lines of their own, without the words for section and area."""
    bare = F.replace(F.replace(col(label), F.lit("Раздел:"), F.lit("")), F.lit("Область:"), F.lit(""))
    parts = F.filter(F.transform(F.split(bare, r"\."), lambda x: strip(x, r"\s.")), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.array_join(parts, "\n")).otherwise(strip(label))


def node_id(prefix: str, code: Column | str) -> Column:
    return F.concat(F.lit(f"{prefix}GRNTI_"), F.replace(col(code), F.lit("."), F.lit("_")))


def rubric_id(code: Column | str) -> Column:
    return F.concat(F.lit("-"), F.replace(col(code), F.lit("."), F.lit("")), F.lit("10000000000000001"))


def slug(c: Column | str) -> Column:
    return strip(F.regexp_replace(col(c), r"[^A-Za-z0-9._-]+", "_"), "_")


def strip_bullet(c: Column | str) -> Column:
    """Without a leading list sign and the white space after it, and without a Latin o or a dot that follows it."""
    sign = LIST_SIGNS.replace("-", r"\-")
    out = F.regexp_replace(col(c), rf"(?U)^\s*[{sign}]\s+", "")
    return strip(F.regexp_replace(F.regexp_replace(out, "^o ", ""), "^· ", ""))


def join_hyphens(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"(?U)(\S)-\s*\n\s*(\S)", "$1$2")


def plain_spaces(c: Column | str) -> Column:
    return F.translate(col(c), NO_BREAK, " " * len(NO_BREAK))


def tight_bullets(c: Column | str) -> Column:
    """One blank after a list sign, within a line."""
    sign = TIGHT_SIGNS.replace("-", r"\-")
    return F.regexp_replace(col(c), rf"(?U)([{sign}])[\s&&[^\n]]{{2,}}", "$1 ")


def without_watermarks(c: Column | str) -> Column:
    """A text without converter notices, page numbers among the first three lines or in the first line that is left,
    blank lines at either end, and marks of byte order or zero width at the beginning."""
    blank = r"[\s&&[^\n]]"
    notice = "|".join(f"(?:{w})" for w in WATERMARKS)
    kept = F.filter(F.split(col(c), "\n"), lambda x, i: ~x.rlike(f"(?i){notice}") & ~((i < 3) & x.rlike(r"(?U)^\s*\d+\s*$")))
    s = F.regexp_replace(F.array_join(kept, "\n"), rf"(?U)^(?:{blank}*\n)+|(?:\n{blank}*)+$", "")
    s = F.when(s.rlike(r"(?U)^\s*$"), "").otherwise(s)
    return F.regexp_replace(F.regexp_replace(s, "^[\ufeff\u200b\u200c\u200d]+", ""), rf"(?U)^{blank}*\d+{blank}*(?:\n|$)", "")


def truncated(c: Column | str, size: int = 600, mark: str = "…") -> Column:
    return F.when(F.length(col(c)) > size, F.concat(F.left(col(c), F.lit(size)), F.lit(mark))).otherwise(col(c))


def repaired_json(line: Column | str) -> Column:
    """A JSON line without a trailing comma, a comma that slid into a key's quotes, or a comma before a closing bracket."""
    s = F.regexp_replace(strip(line), r"(?U),\s*$", "")
    s = F.regexp_replace(s, r'(?U)",([A-Za-z_][A-Za-z0-9_]*)"\s*:', '"$1":')
    return F.regexp_replace(s, r"(?U),\s*([}\]])", "$1")


def clean_codes(codes: Column | str) -> Column:
    """Codes of an array without white space and leading commas or semicolons; empty ones are left out."""
    return F.filter(F.transform(col(codes), lambda x: F.regexp_replace(strip(x), "^[ ,;]+", "")), lambda x: x != "")


def numbered_replies(reply: Column | str, size: int) -> Column:
    """An array of ``size`` texts: slot n holds what follows ``n)`` in the last line that begins so, null without one."""
    lines = F.transform(F.split(F.coalesce(col(reply), F.lit("")), r"\r?\n"), lambda x: strip(x))
    numbered = F.filter(lines, lambda x: x.rlike(r"^[0-9]{1,9}\s*\)"))
    number = lambda x: F.regexp_extract(x, r"^([0-9]{1,9})", 1).cast("int")
    last = lambda n: F.try_element_at(F.filter(numbered, lambda x: number(x) == n), F.lit(-1))
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda n: strip_or_null(F.regexp_replace(last(n), r"^[0-9]{1,9}\s*\)", "")))


def strip_or_null(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def evidence_of(numbers: Column | str, segments: Column | str, most: int = 2) -> Column:
    """The segments that a reply names by number from 1, at most ``most``; numbers outside the list are left out."""
    known = F.filter(col(numbers), lambda n: (n >= 1) & (n <= F.size(col(segments))))
    return F.slice(F.transform(known, lambda n: F.element_at(col(segments), n.cast("int"))), 1, most)


def chunks(items: Column | str, size: int) -> Column:
    """An array cut into arrays of ``size`` items; the last may be shorter, an empty array has none."""
    n = F.ceil(F.size(col(items)) / F.lit(size)).cast("int")
    return F.when(n <= 0, F.array().cast("array<array<string>>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.slice(col(items), i * size + 1, F.lit(size))))


def number_text(x: Column | str) -> Column:
    """A number as a part of a name: up to four digits after the point, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.4f", col(x).cast("double")), r"\.?0+$", "")


def numbered_reply(reply: Column | str, number: int) -> Column:
    """Text of the line ``number) text`` of a reply."""
    return F.nullif(strip(F.regexp_extract(col(reply), rf"(?m)^\s*{number}[\).]\s*(.+)$", 1)), F.lit(""))


def first_json(reply: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(reply), r"(?s)\{.*\}", 0), F.lit(""))


def uninformative(c: Column | str, min_length: int = 15, headers: bool = True, dates: bool = True, phrases: bool = True) -> Column:
    """Whether a segment carries no content: too short, a stock phrase, a heading, a date, a place with a year, or digits."""
    # The forms of headings, dates and places.
    # Before each form stands what any text of it has and few others, as a form is tried at every character.
    def empty(s: Column) -> Column:
        out = F.length(s) < max(1, min_length)
        if phrases:
            out = out | (F.length(s) <= max(map(len, STOP_PHRASES))) & F.lower(s).isin(*STOP_PHRASES)
            out = out | s.endswith(":") & F.regexp_replace(F.lower(s), ":+$", "").isin(*STOP_PHRASES)
        if headers:
            out = out | F.left(s, F.lit(6)).rlike("(?iu)^раздел") & (s.rlike(r"(?iu)^раздел(?U:\s+)[0-9]+\.?(?U:\s*)$") | s.rlike(r"(?iu)^раздел(?U:\s+)[0-9]+\.?(?U:\s+)(?:[а-яё]|(?U:\s))+$"))
        if dates:
            out = out | F.right(s, F.lit(1)).rlike("[0-9]") & (s.rlike(r"^[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{2,4}$") | s.rlike(r"(?U)^[А-ЯЁ][а-яё\s]+,\s*г\.\s*[А-ЯЁ][а-яё]+\s+[0-9]{4}$") | s.rlike(r"(?U)^[А-ЯЁ][а-яё]+\s+[0-9]{4}$"))
        return out | F.left(s, F.lit(1)).rlike(r"(?U)[0-9\s.,\-:]") & s.rlike(r"(?U)^[0-9\s.,\-:]+$")

    # Bound by a lambda, the stripped text is made once, not once a condition, and only where an end is white space.
    whole = F.coalesce(col(c), F.lit(""))
    ends = F.concat(F.left(whole, F.lit(1)), F.right(whole, F.lit(1)))
    return F.exists(F.array(F.when(ends.rlike(r"(?U)\s"), strip(c)).otherwise(whole)), empty)
