"""Scalar functions on post links, captions and untrusted text as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumora.functions.scalars import code_to_id

# The milliseconds at which post ids start, and patterns of links, words and login pages
EPOCH_MS = 1314220021721
CODE_RE = r"/(?:reel|reels|p|tv)/([A-Za-z0-9_\-]+)"
OWNER_RE = r"instagram\.com/([A-Za-z0-9._]+)/(?:reel|reels|p|tv)/"
WORD_RE = r"[a-z][a-z&'\-]+"
AUTH_TITLE_RE = r"(?i)\b(login|challenge|checkpoint)\b"
AUTH_BODY_RE = r"(?i)log\s*in\s+to\s+instagram|login\s+required|challenge|checkpoint"


def _found(text: Column, pattern: str) -> Column:
    """Group 1 of the first match; null if there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def code_of(value: Column) -> Column:
    """The short code of a link or a bare code, cut at 11 characters; null if it has other letters."""
    t = F.trim(value)
    last = F.element_at(F.split(F.regexp_replace(t, "^/+|/+$", ""), "/"), -1)
    code = F.coalesce(_found(t, CODE_RE), last)
    return F.when(code.rlike(r"^[A-Za-z0-9_\-]+$"), F.substring(code, 1, 11))


def time_of_link(link: Column) -> Column:
    """Unix seconds at which the post of a link was made; null if the link is none of a post."""
    code = F.substring(_found(link, CODE_RE), 1, 11)
    return (F.shiftright(code_to_id(code), 23) + EPOCH_MS) / 1000.0


def owner_of_link(link: Column) -> Column:
    return F.lower(_found(link, OWNER_RE))


def caption_of(description: Column) -> Column:
    """What follows the first colon of a page's description; all of it without one; null if nothing is left."""
    after = F.regexp_extract(description, r"(?s):\s*(.+)$", 1)
    return F.nullif(F.trim(F.when(after != "", after).otherwise(description)), F.lit(""))


def needs_login(title: Column, body: Column) -> Column:
    return F.coalesce(title.rlike(AUTH_TITLE_RE), F.lit(False)) | F.coalesce(body.rlike(AUTH_BODY_RE), F.lit(False))


def normal(text: Column) -> Column:
    """Lower case, underscores and runs of white space as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(F.replace(text, F.lit("_"), F.lit(" "))), r"[ \t\n\r]+", " "))


def fenced(name: str, text: Column) -> Column:
    """Untrusted text between marks that it cannot close itself."""
    body = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("<<<"), F.lit("‹‹‹")), F.lit(">>>"), F.lit("›››"))
    return F.concat(F.lit(f"<<<{name}\n"), body, F.lit(f"\n{name}>>>"))


def words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD_RE), F.lit(0)))

