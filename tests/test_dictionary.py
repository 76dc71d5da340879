import random
import re

import pytest

from lumora.operators import dictionary



def plain(pairs, text):
    """The same by trying all stems, longest first, at every place."""
    owner = {}
    for s, n in pairs:
        owner.setdefault(s, n)
    low, scores, i = (text or "").lower(), dict.fromkeys(owner.values(), 0), 0
    letter = lambda c: "a" <= c <= "z"
    while i < len(low):
        here = [s for s in owner if low.startswith(s, i) and not (i and letter(low[i - 1])) and not (i + len(s) < len(low) and letter(low[i + len(s)]))]
        if here:
            s = max(here, key=len)
            scores[owner[s]] += 1
            i += len(s)
        else:
            i += 1
    for tag in re.findall("#([a-z0-9_]+)", low):
        inside = sorted((s for s in owner if s in tag and len(s) >= 4 and " " not in s), key=lambda s: (-len(s), s))
        if inside:
            scores[owner[inside[0]]] += 1
    return scores


@pytest.mark.parametrize("seed", range(3))
def test_longest_stems_first(spark, seed):
    r = random.Random(seed)
    word = lambda n: "".join(r.choice("ab.&+é ") for _ in range(n)).strip() or "a"
    pairs = [(word(r.randint(1, 7)).strip(), f"n{r.randrange(4)}") for _ in range(60)] + [("aaaa", "n0"), ("aabb", "n1"), ("food", "n2"), ("street food", "n3"), ("foodie", "n1")]
    texts = ["".join(r.choice("ab.&+é #AB") for _ in range(r.randint(0, 120))) for _ in range(60)]
    texts += ["Street Food foodies foodie #delhifoodie #food_x food", "", None, "#aaaabb", "a" * 9000, "street food " * 3000, "#" + "food" * 2000, "street  food"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = {(x.id, x.niche): x.score for x in dictionary.Dictionary(pairs).scores(df, "id", "text").collect()}
    assert got == {(i, n): v for i, t in enumerate(texts) for n, v in plain(pairs, t).items()}


def test_thousands_of_stems(spark):
    r = random.Random(5)
    pairs = [("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))), f"n{i % 9}") for i in range(20_000)]
    texts = [" ".join(r.choice(pairs)[0] + r.choice(["", "", "x"]) for _ in range(50)) for _ in range(4)]
    got = {(x.id, x.niche): x.score for x in dictionary.Dictionary(pairs).scores(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), "id", "text").collect()}
    assert got == {(i, n): v for i, t in enumerate(texts) for n, v in plain(pairs, t).items()}


def test_empty(spark):
    df = spark.createDataFrame([(1, "a")], "id long, text string")
    assert dictionary.Dictionary([]).scores(df, "id", "text").collect() == []
    assert dictionary.Dictionary([("a", "n")]).scores(df.limit(0), "id", "text").collect() == []
    with pytest.raises(ValueError):
        dictionary.Dictionary((str(i), "n") for i in range(dictionary.MOST_STEMS + 1))
