import random
import re

from pyspark.sql import functions as F

from lumora.operators import pagelines

LINES = ["12 posts", "1.2K followers", "30 following", "3 m posts", "Creator", "Book now", "Follow", "ann", "Ann B", "threads", "Followed by x", "a line ...", "Digital creator", "Bakery & bar", "and 2 more", "x and 2 more", "www.x.y", "Site.com", "link-in.bio/x", "the end", "12 postsx", "é text", "  ", "Verified badge", "Private account", "band 3 more"]


def plain(lines, handle, name):
    """label and bio by what is said of headers, rule by rule."""
    lines = [x.strip() for x in lines if x.strip()]
    stat = [i for i, x in enumerate(lines) if re.match(pagelines.STAT_RE, x)]
    rest = lines[max(stat) + 1 :] if stat else lines
    names, label, kept = {handle.lower(), (name or "").lower()}, None, []
    for i, x in enumerate(rest):
        if x.lower() in names or re.match(pagelines.BUTTON_RE, x):
            continue
        if re.match(pagelines.STOP_RE, x.lower()):
            break
        if i == 0 and re.match(pagelines.LABEL_RE, x):
            label = x
            continue
        kept.append(re.sub(r"\s*\.\.\.\s*$", "", x))
        if re.match(pagelines.LINK_RE, x.lower()) or re.search(pagelines.MORE_RE, x):
            break
    return label, "\n".join(kept).strip() or None


def read(spark, rows):
    df = spark.createDataFrame(rows, "id long, handle string, display_name string, text string")
    return {r.id: r for r in pagelines.profiles(df.withColumn("lines", pagelines.lines(F.col("text")))).collect()}


def test_random_headers(spark):
    r = random.Random(4)
    rows = [(i, "ann", r.choice(["Ann B", None]), "\n".join(r.choice(LINES) for _ in range(r.randint(0, 14)))) for i in range(600)]
    got = read(spark, rows)
    for i, handle, name, text in rows:
        assert (got[i].category_label, got[i].bio) == plain(text.split("\n"), handle, name), text
    assert any(x.account_type == "business" for x in got.values())


def test_whole_header(spark):
    text = "ann\nAnn B\n12 posts\n1.2K followers\n30 following\nBakery & bar\nBread ...\nPune\nann.com/x\nHighlights"
    x = read(spark, [(1, "ann", "Ann B", text), (2, None, None, None), (3, "ann", None, "")])
    assert (x[1].posts, x[1].followers, x[1].following, x[1].bio, x[1].account_type, x[1].is_business) == (12, 1200, 30, "Bread\nPune\nann.com/x", "business", True)
    for i in (2, 3):
        assert (x[i].bio, x[i].category_label, x[i].posts, x[i].is_verified, x[i].is_private) == (None, None, None, False, False)


def test_long_page(spark):
    x = read(spark, [(1, "ann", None, "5 posts\n" + "\n".join(f"line {i}" for i in range(50_000)) + "\nhttps://x.example\nno more")])
    assert x[1].bio.count("\n") == 50_000 and x[1].bio.endswith("https://x.example") and x[1].posts == 5
