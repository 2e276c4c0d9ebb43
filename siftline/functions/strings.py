"""Text predicates and keys as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .answers import _with, json_in  # noqa: F401

#: Fixed value: how a DOI stands in a text.
DOI = r"(?i)(?:doi[:\s]*|https?://doi\.org/)(10\.\d{4,}/[^\s,;]+)"


def doi(text: Column) -> Column:
    """The first DOI, without closing punctuation; null where there is none."""
    found = F.regexp_replace(F.regexp_extract(text, DOI, 1), r"[.)\]]+$", "")
    return F.when(found != "", found)


def slug(doi_: Column) -> Column:
    """A DOI as a file name."""
    bare = F.regexp_replace(F.lower(F.trim(doi_)), r"^https?://(dx\.)?doi\.org/", "")
    return F.regexp_replace(F.regexp_replace(bare, "/", "__"), r'[<>:"\\|?*]', "_")


def key(text: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_garbled(text: Column) -> Column:
    """Words run together: over 20 letters on average, few spaces, or mostly words of over 15. A text of 20 or more
    blanks is garbled too, a shorter text never is."""
    w = words(text)
    n = F.size(w)
    letters = F.aggregate(w, F.lit(0), lambda a, x: a + F.length(x))
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    long_ = F.size(F.filter(w, lambda x: F.length(x) > 15))
    run_together = (n == 0) | (letters > 20 * n) | (spaces < 0.04 * F.length(text)) | (2 * long_ > n)
    return F.when(F.length(text) < 20, False).otherwise(run_together)


def is_titleless(text: Column) -> Column:
    """A citation without title: at most two words of four letters are left once the address, what stands from the
    volume and pages on, the authors in either order and short forms are gone."""
    replace = F.regexp_replace
    t = replace(text, r"(?i)https?://\S+|doi[:\s]*10\.\S+", " ")
    tail = r"\b\d{1,4}\s*,\s*[\dA-Za-z]+\s*[-–]?\s*[\dA-Za-z]*\s*\(\d{4}\)"
    t = F.when(t.rlike(tail), replace(t, f"(?s){tail}.*$", "")).otherwise(replace(t, r"\(\d{4}\).*$", " "))
    t = replace(t, r"(?:[A-Z]\.[-\s]*){1,4}\s*(?:van der |von |de |del |della |di |le |la )?[A-Z][A-Za-z'`-]+", " ")
    t = replace(t, r"[A-Z][A-Za-z'`-]+,\s*(?:[A-Z]\.[-\s]*){1,4}", " ")
    t = replace(t, r"\b(?:[A-Z]\.)+|\b[A-Z][a-z]{0,3}\.|\b\d+\b", " ")
    return F.regexp_count(t, F.lit("[A-Za-z]{4,}")) <= 2


def is_truncated_doi(d: Column) -> Column:
    """A DOI that a line's end cut off: it ends in a sign, in a year in brackets or in a bare group of three or four
    digits after a point, or its suffix has no digit."""
    suffix = F.when(F.contains(d, F.lit("/")), F.regexp_extract(d, r"(?s)^[^/]*/(.*)$", 1)).otherwise("")
    group = suffix.rlike(r"\.\d{3,4}$") & ~suffix.rlike(r"\.\d{3,4}\.\d")
    return d.rlike(r"[-/.]$") | suffix.rlike(r"\(\d{2,4}\)$") | ~suffix.rlike(r"\d") | group


def is_elsewhere_doi(d: Column) -> Column:
    """A DOI that the usual index of works doesn't hold, so that a miss there says nothing."""
    low = F.lower(d)
    known = F.lit(False)
    for prefix in ELSEWHERE:
        known = known | low.startswith(prefix)
    return known | F.contains(low, F.lit("arxiv"))


#: Prefixes of preprints and data that other agencies register.
ELSEWHERE = ("10.48550/", "10.5281/", "10.6084/", "10.5061/")


def is_noise(text: Column) -> Column:
    """A reference that was read badly, so that a finding on it counts for little: too short, words run together,
    two citations in one, or pieces of identifiers inside."""
    t = F.coalesce(text, F.lit(""))
    w = words(t)
    n = F.size(w)
    lengths = F.transform(w, lambda x: F.length(x))
    letters = F.aggregate(lengths, F.lit(0), lambda a, x: a + x)
    begins = F.ltrim(t)
    return (
        (F.length(t) < 20)
        | (n < 3)
        | (letters > 25 * F.greatest(n, F.lit(1)))
        | (F.coalesce(F.array_max(lengths), F.lit(0)) > 30)
        | (F.regexp_count(t, F.lit(r"\(\d{4}\)")) >= 2)
        | begins.startswith("doi:")
        | begins.startswith("DOI:")
        | F.substring(t, F.lit(31), F.length(t)).rlike(r"\d{1,3}\.\s+[A-Z]")
        | F.contains(F.lower(F.substring(t, F.lit(21), F.length(t))), F.lit("doi:"))
        | F.contains(F.substring(t, F.lit(21), F.length(t)), F.lit("doi.org/"))
        | t.rlike(r"(?:pone|s\d{4})[.-]\d{4,}")
        | t.rlike(r"\b\d{4}/[a-z]+\.\d{4,}")
        | t.rlike(r"\b\d{3,}/[A-Za-z]\d{3,}")
    )


#: Lines that a publisher prints on every page, and notices on personal data.
PAGE_LINES = (
    r"^\s*Article\s+https?://doi\.org/\S+",
    r"^\s*https?://doi\.org/\S+\s*$",
    r"\|\s*Volume\s+\d+\s*\|",
    r"^\s*Publisher.s note\b",
    r"^\s*Springer Nature (?:remains|or its licensor)",
    r"(?:see our )?privacy policy",
    r"\buse of your personal data\b",
    r"\bto change your choices\b",
    r"\bfor further information and to change\b",
    r"\bcookie(?:s| settings| policy)\b",
)


#: What running feet and a publisher's notice on personal data leave within lines.
FRAGMENTS = (
    r"[A-Z][A-Za-z.&\- ]{2,40}\|\s*Volume\s+\d+\s*\|[^\n]{0,60}",
    r"Your privacy, your choice",
    r"We and our \d+ partners[^.]*\.",
    r"transfers to third parties[^.]*\.",
    r"Some third parties are outside[^.]*\.",
    r"(?:with varying|varying)? ?standards of data protection[^.]*\.",
    r"advertising, personal, ?personalisation of content[^.]*\.",
    r"advertising, personalisation of content[^.]*\.",
    r"usage analysis,? and social[^.]*\.",
    r"See our privacy policy[^.]*\.",
    r"for further information and to change your choices[^.]*\.",
)


#: A part in small letters that a text has wherever the fragment of the same place, or any of the lines, fits.
_FRAGMENT_PARTS = ("|", "your privacy, your choice", "we and our ", "transfers to third parties", "some third parties are outside", "standards of data protection", "advertising, personal,", "advertising, personalisation of content", "usage analysis", "see our privacy policy", "for further information and to change your choices")
_LINE_PARTS = ("doi.org/", "volume", "publisher", "springer nature", "privacy policy", "use of your personal data", "to change your choices", "for further information", "cookie")


def without_fragments(text: Column) -> Column:
    """A text with a blank for each fragment, one kind after the other. Only texts with a fragment's fixed part are
    searched for it: the patterns try every place."""
    for fragment, part in zip(FRAGMENTS, _FRAGMENT_PARTS):
        text = _with(text, lambda t: F.when(F.contains(F.lower(t), F.lit(part)), F.regexp_replace(t, "(?i)" + fragment, " ")).otherwise(t))  # noqa: B023
    return text


def without_running_text(text: Column, own_doi: Column) -> Column:
    """A text without the lines, heads and fragments that come from the page around it."""
    return without_fragments(without_own_doi(without_page_lines(text), own_doi))


def without_page_lines(text: Column) -> Column:
    """A text without the lines that come from running heads, footers and notices."""

    def kept(p: Column) -> Column:
        lines = F.filter(F.split(p["t"], "\n"), lambda line: ~line.rlike("(?i)" + "|".join(PAGE_LINES)))
        maybe = F.contains(p["low"], F.lit(_LINE_PARTS[0]))
        for part in _LINE_PARTS[1:]:
            maybe = maybe | F.contains(p["low"], F.lit(part))
        return F.when(maybe, F.array_join(lines, "\n")).otherwise(p["t"])

    return _with(_with(text, lambda t: F.struct(t.alias("t"), F.lower(t).alias("low"))), kept)


def without_own_doi(text: Column, own: Column) -> Column:
    """A text without what a running head with the article's own DOI left in its lines."""
    head = F.concat(F.lit(r"(?i)\bArticle\s+https?://doi\.org/\Q"), F.regexp_replace(own, r"\\E", ""), F.lit(r"\E"))
    return F.when(own.isNull() | (own == ""), text).otherwise(F.regexp_replace(text, head, F.lit(" ")))


def clean_name(name: Column) -> Column:
    """A person's or institution's name without numbering, superscript digits and marks, and extra blanks."""
    t = F.regexp_replace(name, r"^\s*\d+\.\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[\d*†‡§]+", ""), r"\s+", " "))


def swapped_name(name: Column) -> Column:
    """``Last, First`` as ``First Last``; other names stay."""
    parts = F.split(name, r"\s*,\s*")
    return F.when(F.size(parts) == 2, F.concat_ws(" ", F.trim(parts[1]), F.trim(parts[0]))).otherwise(F.trim(name))


def journal_name(text: Column) -> Column:
    """A journal without the year, volume and pages that may follow it."""
    return F.trim(F.regexp_replace(text, r"\s+\d{4}\s+\d+:\d+$", ""))


def journal_and_doi(subject: Column) -> tuple[Column, Column]:
    """Journal and DOI of a subject line like ``Journal, doi:10.1/x``; each null where it isn't there."""
    found = F.rtrim(F.regexp_extract(subject, r"(10\.\d{4,}/[^\s,;]+)", 1), F.lit(".)]"))
    head = F.trim(F.regexp_extract(subject, r"^([^,;]*)", 1))
    return F.when((head != "") & ~head.rlike(r"(?i)^doi\b|^https?:|^10\."), journal_name(head)), F.when(found != "", found)


def plain_report_text(text: Column) -> Column:
    """Model text without Markdown: fences, headings, emphasis, rules and table lines go; words stay."""
    t = F.regexp_replace(text, r"(?s)```[a-zA-Z]*\n?(.*?)```", "$1")
    t = F.regexp_replace(t, r"(?m)^\s*\|.*\|\s*$|^\s*[-*_]{3,}\s*$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"(?m)^\s{0,3}#{1,6}\s*", ""), r"\*\*|__|`", "")
    return F.trim(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def reworded(text: Column, wording: dict[str, str]) -> Column:
    """``wording`` applied in order, each word as it stands."""
    for old, new in wording.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def is_safe_name(name: Column) -> Column:
    """A table's name: letters, digits and underscores, not beginning with a digit."""
    return name.rlike(r"^[A-Za-z_][A-Za-z0-9_]{0,127}$")


def safe_path(name: Column) -> Column:
    """A path of names whose other signs became underscores; empty parts and dots alone go."""
    parts = F.transform(F.split(name, r"[/\\]+"), lambda x: F.regexp_replace(F.trim(x), r"[^A-Za-z0-9._-]+", "_"))
    return F.array_join(F.filter(parts, lambda x: ~x.rlike(r"^\.*$")), "/")


def numbered_lines(text: Column) -> Column:
    """How many lines after the last heading of references begin with a number."""
    after = F.element_at(F.split(text, r"(?im)^\s*references\s*$"), -1)
    return F.when(text.rlike(r"(?im)^\s*references\s*$"), F.regexp_count(after, F.lit(r"(?m)^\s*\[?\d{1,3}\]?[.\s]"))).otherwise(0)


def html_text(html: Column) -> Column:
    """Visible text: scripts, styles and comments go, then tags, then entities of the common kind."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(?:script|style)>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for code, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        t = F.replace(t, F.lit(code), F.lit(sign))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def truncated(text: Column, width: int) -> Column:
    return F.left(F.coalesce(text, F.lit("")), F.lit(width))
