"""Profiles from the lines of a page's header, read by a state machine in one fold.

A header has a handle and a name, counts ("12 posts"), perhaps a label of the kind of account, lines about the account, a link and
what follows it. The fold passes the lines once: a line of counts starts anew, the first line after the counts may be the label, a
link or "and 2 more" ends the text with its line, "followed by" and "threads" end it before theirs. Its state is four values
and never a list of lines, so the work grows with the page's length; the text is cut out of the lines afterwards. All of it
is Column expressions: no page leaves the JVM and none is shuffled.

A page without lines, or a null one, has no text, label and counts; its flags are false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions import scalars

# Lines of counts, lines of buttons, lines that end the text, labels and labels of businesses
STAT_RE = r"(?i)^\d[\d.,]*\s*[km]?\s*(posts?|followers?|following)$"
BUTTON_RE = r"(?i)^(follow|following|message|contact|email|call|directions|book now|order food|view shop|edit profile|share profile|options|follow back|subscribe|see translation|more)$"
STOP_RE = r"^(followed by|threads)"
LINK_RE = r"^(https?://|www\.|[\w-]+\.(com|in|me|link|ee|bio)\b)"
MORE_RE = r"\band \d+ more$"
LABEL_RE = r"^[A-Z][A-Za-z &/,()'.-]{2,40}$"
BUSINESS_RE = r"(?i)restaurant|cafe|café|bakery|\bbar\b|pub|brewery|hotel|resort|store|shop|retail|brand|company|product/service|local business|agency|advertising|marketing|media|news|school|college|university|academy|education|clinic|hospital|salon|spa\b|boutique|caterer|catering|event planner|organization|nonprofit|community|e-commerce|real estate|travel company|tour agency|gym/physical fitness center|food & beverage|grocery|supermarket"

UNSEEN_RE = r"(?is)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->"
BLOCK_RE = r"(?i)</?(address|article|aside|blockquote|br|dd|div|dl|dt|footer|form|h[1-6]|header|hr|li|main|nav|ol|p|pre|section|table|td|th|tr|ul)\b[^>]*>"


def plain(html: Column) -> Column:
    """A page's text with a line for each block."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, UNSEEN_RE, ""), BLOCK_RE, "\n"), "<[^>]*>", "")


def lines(text: Column) -> Column:
    """The trimmed lines of a text that are not empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def display_name(title: Column) -> Column:
    """A title up to its first bracket; null if nothing is left."""
    return F.nullif(F.trim(F.substring_index(title, "(", 1)), F.lit(""))


def _names(handle: Column, name: Column) -> Column:
    return F.array(F.lower(F.coalesce(handle, F.lit(""))), F.lower(F.coalesce(name, F.lit(""))))


def header(own: Column, handle: Column, name: Column) -> Column:
    """struct(label, bio) of an array of lines."""
    names = _names(handle, name)
    passed = lambda x: F.array_contains(names, F.lower(x)) | x.rlike(BUTTON_RE)
    whole, none = F.lit(0), F.lit(None).cast("string")
    state = lambda at, start, until, label: F.struct(at.alias("at"), start.alias("start"), until.alias("until"), label.alias("label"))

    def step(s: Column, x: Column) -> Column:
        at = s["at"] + 1
        stop, first = F.lower(x).rlike(STOP_RE), at == s["start"]
        end = F.lower(x).rlike(LINK_RE) | x.rlike(MORE_RE)
        same = state(at, s["start"], s["until"], s["label"])
        return (
            F.when(x.rlike(STAT_RE), state(at, at + 1, whole, none))
            .when((s["until"] != 0) | passed(x), same)
            .when(stop, state(at, s["start"], -at, s["label"]))
            .when(first & x.rlike(LABEL_RE), state(at, s["start"], s["until"], x))
            .when(end, state(at, s["start"], at, s["label"]))
            .otherwise(same)
        )

    def cut(s: Column) -> Column:
        # until: 0 is open, n > 0 the last line of the text, -n the line behind it
        last = F.when(s["until"] == 0, s["at"]).when(s["until"] > 0, s["until"]).otherwise(-s["until"] - 1)
        start = s["start"] + F.when(s["label"].isNull(), 0).otherwise(1)
        text = F.transform(F.filter(F.slice(own, start, F.greatest(last - start + 1, F.lit(0))), lambda x: ~passed(x)), lambda x: F.regexp_replace(x, r"\s*\.\.\.\s*$", ""))
        bio = F.regexp_replace(F.array_join(text, "\n"), r"^\s+|\s+$", "")
        return F.struct(s["label"].alias("label"), F.nullif(bio, F.lit("")).alias("bio"))

    # one fold: the state is kept in an array of one element, so that the text is cut out of it without folding again
    return F.transform(F.array(F.aggregate(own, state(F.lit(0), F.lit(1), whole, none), step)), cut)[0]


def profiles(df: DataFrame) -> DataFrame:
    """df with handle, display_name and lines (an array) to the profile's fields; other columns are kept."""
    text = F.concat_ws(" ", "_h.bio", F.array_join("lines", " "))
    count = lambda what: scalars.parse_count(F.regexp_extract("_text", rf"(?i)([\d.,]+\s*[KM]?)\s*{what}", 1))
    read = df.withColumn("_h", header(F.col("lines"), F.col("handle"), F.col("display_name"))).withColumn("_text", text)
    low, business = F.lower("_text"), F.coalesce(F.col("_h.label").rlike(BUSINESS_RE), F.lit(False))
    return read.withColumns(
        {
            "bio": F.col("_h.bio"),
            "category_label": F.col("_h.label"),
            "is_business": business,
            "followers": count("followers"),
            "following": count("following"),
            "posts": count("posts"),
            "is_verified": low.contains("verified"),
            "is_private": low.contains("private account"),
            "account_type": F.when(business, "business").otherwise(F.col("_h.label")),
        }
    ).drop("_h", "_text", "lines")
