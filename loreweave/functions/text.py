"""Text columns: tokens, normal forms of names, tests on names, renderings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The character ranges that count as CJK.
CJK = r"　-〿㐀-䶿一-鿿豈-﫿＀-￯"
#: White space of any script.
WHITE = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"


def _accents() -> tuple[str, str]:
    """Lower-case letters that decompose into an ASCII letter and marks, and these letters."""
    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base.isascii() and base.islower():
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


ACCENTED, PLAIN = _accents()
#: Combining accents: they go, so that a letter with one is the letter itself and no word is split by it.
MARKS = "".join(map(chr, range(0x300, 0x332)))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def spaced_cjk(text: Column | str) -> Column:
    """A space between CJK characters, and between them and ASCII letters or digits."""
    out = F.regexp_replace(_col(text), f"(?<=[{CJK}])(?=[{CJK}0-9A-Za-z])", " ")
    spaced = F.regexp_replace(out, f"(?<=[0-9A-Za-z])(?=[{CJK}])", " ")
    return F.when(_col(text).rlike(f"[{CJK}]"), spaced).otherwise(_col(text))


def folded(text: Column | str) -> Column:
    return F.translate(F.lower(_col(text)), ACCENTED + MARKS, PLAIN)


def tokens(text: Column | str) -> Column:
    """Folded runs of letters and digits, CJK characters one by one."""
    return F.regexp_extract_all(folded(spaced_cjk(F.coalesce(_col(text), F.lit("")))), F.lit(r"([\p{L}\p{N}]+)"))


def query_phrases(query: Column | str, most: int | None = 8) -> Column:
    """The token lists of the first `most` (None: all) white-space separated parts of a query, without `?` and empty ones."""
    parts = F.filter(F.split(F.replace(F.coalesce(_col(query), F.lit("")), F.lit("?"), F.lit("")), f"{WHITE}+"), lambda x: x != "")
    return F.filter(F.transform(parts if most is None else F.slice(parts, 1, most), tokens), lambda p: F.size(p) > 0)


def trimmed(text: Column | str) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(_col(text), f"^{WHITE}+|{WHITE}+$", "")


def norm_name(name: Column | str) -> Column:
    return trimmed(F.regexp_replace(F.lower(_col(name)), r"(?U)[^\w\s一-鿿]|_", " "))


def alnum_only(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(name)), rf"[-_.\\/]|{WHITE}", "")


def is_path(name: Column | str) -> Column:
    """A slash or backslash anywhere, or a lower-case letter before a colon."""
    return trimmed(name).rlike(r"[\\/]|[a-z]:")


def scoped_name(name: Column | str) -> Column:
    return F.nullif(F.regexp_extract(trimmed(name), r"^@[^/]+/([^/]+)$", 1), F.lit(""))


def is_ascii(name: Column | str) -> Column:
    return _col(name).rlike(r"^[\x00-\x7F]*$")


def is_domain(name: Column | str) -> Column:
    return trimmed(name).rlike(r"(?i)^[a-z0-9.-]{1,63}\.[a-z]{2,}$")


def norm_path(name: Column | str) -> Column:
    return F.rtrim(F.replace(F.lower(_col(name)), F.lit("\\"), F.lit("/")), F.lit("/"))


def basename(name: Column | str) -> Column:
    return F.element_at(F.split(F.rtrim(F.replace(_col(name), F.lit("\\"), F.lit("/")), F.lit("/")), "/"), -1)


def without_www(name: Column | str) -> Column:
    return F.regexp_replace(F.lower(_col(name)), r"^www\.", "")


def default_name(name: Column | str, content: Column | str, n: int = 60) -> Column:
    return F.coalesce(F.nullif(_col(name), F.lit("")), F.substring(_col(content), 1, n))


def snippet(text: Column | str, n: int = 500) -> Column:
    return F.substring(_col(text), 1, n)


def without_fence(text: Column | str) -> Column:
    """A model's answer without its opening code fence."""
    return F.regexp_replace(trimmed(text), r"^```[A-Za-z]*\s*", "")


def rendered(name: Column | str, fact: Column | str, valid_at: Column | str, invalid_at: Column | str, n: int = 300) -> Column:
    """A line for a found fact: its predicate, the beginning of its text, and when it holds."""
    label = validity_label(valid_at, invalid_at)
    return F.concat(F.lit("- "), F.coalesce(_col(name), F.lit("")), F.lit(": "), snippet(F.coalesce(_col(fact), F.lit("")), n), F.when(label != "", F.concat(F.lit(" "), label)).otherwise(F.lit("")))


def validity_label(valid_at: Column | str, invalid_at: Column | str, open_end: str = "now") -> Column:
    day = lambda c: F.date_format(_col(c), "yyyy-MM-dd")
    return F.when(_col(valid_at).isNull() & _col(invalid_at).isNull(), F.lit("")).otherwise(F.concat(F.lit("["), F.coalesce(day(valid_at), F.lit("?")), F.lit(" → "), F.coalesce(day(invalid_at), F.lit(open_end)), F.lit("]")))


def fact_line(fact: Column | str, valid_at: Column | str, invalid_at: Column | str) -> Column:
    """A found fact as a line of a rendered search: when it holds follows if its beginning is known; an open end is the word for now."""
    day = lambda c: F.date_format(_col(c), "yyyy-MM-dd")
    window = F.concat(F.lit(" ["), day(valid_at), F.lit(" → "), F.coalesce(day(invalid_at), F.lit("现在")), F.lit("]"))
    return F.concat(F.lit("  • "), F.coalesce(_col(fact), F.lit("")), F.coalesce(window, F.lit("")))


def entity_line(name: Column | str, labels: Column | str, summary: Column | str, n: int = 80) -> Column:
    """A found entity as a line: name, labels (or `Entity`) and the summary's beginning."""
    said = F.when(F.size(F.coalesce(_col(labels), F.array().cast("array<string>"))) > 0, F.array_join(_col(labels), ", ")).otherwise(F.lit("Entity"))
    return F.concat(F.lit("  • "), F.coalesce(_col(name), F.lit("")), F.lit(" ("), said, F.lit(") — "), snippet(F.coalesce(_col(summary), F.lit("")), n))


def episode_line(content: Column | str, n: int = 120) -> Column:
    """A found episode as a line: its text's beginning."""
    return F.concat(F.lit("  • "), snippet(F.coalesce(_col(content), F.lit("")), n))
