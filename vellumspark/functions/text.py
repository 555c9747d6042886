"""Text functions as column expressions. Patterns keep to what RE2 and Java share, so that they can be checked against SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of lines that are no content.
PAGE_NUMBER = r"^\s*\p{Nd}+\s*$|(?i:^\s*Page\s+\p{Nd}+\s*$)|(?i:^\s*Page\s+\p{Nd}+\s+of\s+\p{Nd}+\s*$)|(?i:^\s*\p{Nd}+\s+of\s+\p{Nd}+\s*$)|^\s*[IVXLCDM]+\s*$|^\s*[-—–]\s*\p{Nd}+\s*[-—–]\s*$"
NOISE = (
    r"(?i)^\s*Page\s+\d+\s*(of|/)\s*\d+\s*$|^\s*\d+\s*(of|/)\s*\d+\s*$|^\s*Version\s*[\d.]+(\s*-\s*\d{4})?\s*$"
    r"|^\s*([A-Za-z0-9./-]+\s+)?Version\s*[\d.]+(\s*-\s*\d{4})?\s*(\|\s*Page\s+\d+(\s*(of|/)\s*\d+)?)?\s*$"
    r"|\|\s*Page\s+\d+\s*(of|/)\s*\d+|\bPage\s+\d+\s*(of|/)\s*\d+\b|^\s*Revision\b.*History\b|^\s*Effective\s+(Date|as of)\b.*\||\|\s*Page\b"
    r"|^\s*DESCRIPTION\s+OF\s+CHANGE\s*$|^\s*DATE\s+VERSION\s+DESCRIPTION.*$|^\s*AUTHOR\s*/\s*REVIEWER\s*$"
)
UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{FFFD}]"
PROPER_NAME = r"^[A-Z][a-zA-Z\-']{0,19}(\s+[A-Z][a-zA-Z\-']{0,19}){0,3}$"
FOOTNOTE = r"^\s*\p{Nd}+\s*[.)]?\s+\S"
CONTENTS_LINE = r"\.{4,}\s*\d+\s*$"
BOUNDARY = r"^\s*\d+\.\s+[A-Za-z]|^\s*\d+\)\s+[A-Za-z]|^\s*[IVXivx]+\.\s+[A-Za-z]|^\s*[A-Z][A-Z][A-Z][A-Z\s]{3,}\s*[:\-.]?\s*$"
UNFINISHED = r"[(,;:—-]\s*$"
CUT_LINE = r"\p{Ll}$"
DATE = r"(?i)\b\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}\b|\b\d{4}[/-]\d{1,2}[/-]\d{1,2}\b|\b\d{1,2}\s+(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{2,4}\b|\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{2,4}\b"
REFERENCE = r"^[A-Za-z0-9][A-Za-z0-9._\-/]{0,30}$"
DEPARTMENT = r"(?i)\b(department|team|division|unit|group|office|function|directorate|section|branch|board|committee|desk)\s*$"
PERSON = r"^([A-Z][a-zA-Z'\-.]*\.?\s+){1,3}[A-Z][a-zA-Z'\-.]+$"
BULLETS = "•◦▪○●◆▸‣*–—"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalize(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0))


def label_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "")


def repair_replacement_marks(c: Column) -> Column:
    """U+FFFD as an apostrophe between letters, as a dash where no letter is beside it, else as a question mark."""
    c = F.regexp_replace(c, "(?<=[A-Za-z])�(?=[A-Za-z])", "’")
    c = F.regexp_replace(c, "(?<![A-Za-z])�(?![A-Za-z])", "–")
    return F.replace(c, F.lit("�"), F.lit("?"))


def garbled(c: Column) -> Column:
    """At least 30 % of the characters can't be printed."""
    return (F.length(c) > 0) & ((F.length(c) - F.length(F.regexp_replace(c, UNPRINTABLE, ""))) / F.length(c) >= 0.3)


def strip_bullet(c: Column) -> Column:
    return F.regexp_replace(c, rf"^\s*([{BULLETS}]|[oO]\s)\s*", "")


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+(?=[A-Z(])")


def html_text(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, "<[^>]*>", "")
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return strip(c)


def html_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def with_stop(c: Column) -> Column:
    """A final stop where none of . ! ? ends the text."""
    c = normalize(c)
    return F.when(c.rlike(r"[.!?]$") | (F.length(c) == 0), c).otherwise(F.concat(c, F.lit(".")))


def version_of(c: Column) -> Column:
    v = F.coalesce(*[F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (r"(?i)\bversion\s*[:\-]?\s*(\d+(\.\d+)*)", r"(?i)\bv\.?\s*(\d+(\.\d+)+)", r"(?i)\brev(?:ision)?\.?\s*(\d+(\.\d+)*)")])
    return v


def safe_name(c: Column) -> Column:
    """A file name without its extension and without characters that file systems refuse."""
    c = F.regexp_replace(F.regexp_replace(c, r"\.[A-Za-z0-9]{1,5}$", ""), r'[\\/:*?"<>|]', "_")
    return F.when(F.length(F.trim(c)) > 0, F.trim(c)).otherwise(F.lit("document"))


def megabytes(c: Column) -> Column:
    return F.format_string("%.1f MB", F.round(c / F.lit(1048576.0), 1))


def script_language(c: Column) -> Column:
    """my, mixed or en by the share of Myanmar letters."""
    my = F.length(F.regexp_replace(c, r"[^\x{1000}-\x{109F}\x{AA60}-\x{AA7F}\x{A9E0}-\x{A9FF}]", ""))
    latin = F.length(F.regexp_replace(c, "[^A-Za-z]", ""))
    share = my / F.nullif(my + latin, F.lit(0))
    return F.when(share >= 0.3, "my").when(share >= 0.1, "mixed").otherwise("en")


def corruption_score(c: Column) -> Column:
    """0 for sound Myanmar text up to 1: surplus and doubled viramas, marks beside spaces, private characters."""
    n = F.length(c)
    count = lambda p: n - F.length(F.regexp_replace(c, p, ""))
    hits = lambda p: F.size(F.regexp_extract_all(c, F.lit(p), F.lit(0)))
    virama = count("်")
    consonants = count("[က-ဪ]")
    clip = lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))
    apart = F.size(F.array_union(F.regexp_extract_all(c, F.lit(r"\s[ါ-်]\s"), F.lit(0)), F.regexp_extract_all(c, F.lit(r"\s[ါ-်]|[ါ-်]\s"), F.lit(0))))
    score = (
        F.lit(0.30) * clip((virama * 100.0 / F.greatest(n, F.lit(1)) - 2.0) / 10.0)
        + F.lit(0.20) * clip(hits("်{2,}") / 10.0)
        + F.lit(0.25) * clip(apart / 12.0)
        + F.lit(0.15) * F.when(consonants > 0, clip(virama / F.nullif(consonants, F.lit(0)) - 0.5)).otherwise(0.0)
        + F.lit(0.10) * clip(count(r"[\x{E000}-\x{F8FF}]") / 20.0)
    )
    return F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.least(F.lit(1.0), score)).otherwise(0.0)


def repair_myanmar(c: Column) -> Column:
    """Removes private and invisible characters, puts marks back to their letters and drops repeated viramas and stray visargas."""
    c = F.regexp_replace(c, r"[\x{E000}-\x{F8FF}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]", "")
    c = F.regexp_replace(c, r"\s+([ါ-်])", "$1")
    c = F.regexp_replace(c, r"်{2,}", "်")
    c = F.regexp_replace(c, r"(^|\s)း", "$1")
    return F.regexp_replace(c, " {2,}", " ")


def slot_of_text(c: Column) -> Column:
    """The section that a line names by its beginning; 0 for none."""
    x = F.coalesce(F.upper(strip(c)), F.lit(""))
    word = lambda w: (x == w) | x.startswith(f"{w} ")
    return (
        F.when(word("INTRODUCTION"), 5).when(word("POLICY STATEMENT"), 6).when(word("DEFINITIONS"), 12).when(word("HISTORY"), 14).when(x.startswith("RELATED POLICIES"), 13)
        .when(x.startswith("1. PURPOSE") | (x == "PURPOSE"), 7).when(x.startswith("2. SCOPE") | (x == "SCOPE & BENEFICIARIES"), 8).when(x.startswith("3. EXCLUSIONS") | (x == "EXCLUSIONS"), 9)
        .when(x.startswith("4. AWARD STRUCTURE") | (x == "AWARD STRUCTURE & PAYOUT TIERS"), 10).when(x.startswith("POLICY REVIEW NOTE"), 11).otherwise(0)
    )
