import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lumora.llm import packing, tokens

TEXTS = ["Wait. No, yes., ok.. a.b, Z. .x ,", "end.", "a,\n.", "é. ß, x.\u3000y, 's. I'm.", "Hello world, it's 12 o'clock!\n\n Next  line \t x", "", None, "  lead", "trail  \n", "a  b  \n c", "café \x00 nul \x00", "<|endoftext|> x<|startoftext|>", "A b<|endoftext|>.  C, d <|ENDOFTEXT|> e <|StartOfText|>", " <|endoftext|>", "a <|endoftext|>\n\n b", "<|endoftext", "|>", "don't I'LL 'S \x1c \x85 y", "a\u3000 b \u2003\xa0 c\xa0d\u2028\n e", "日本語 テキスト", "İstanbul ΟΔΟΣ Σ", "é ño", "w" * 5000, " ", "\n\n\n"]


@pytest.mark.parametrize(("name", "kind"), [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_ids_are_the_library_s(name, kind):
    import pyarrow as pa

    path = public_tokenizers.path(name)
    t = Tokenizer.from_file(path)
    e = tokens.encoder(path, kind)
    for texts in (TEXTS, TEXTS[::-1], [], ["again Hello world"]):
        ids, n = e.encode(pa.array(texts, pa.string()))
        want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def check(pieces, docs, window):
    by_doc = {}
    by_seq = {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_seq.setdefault(p.sequence_id, []).append(p)
        assert len(p.ids) == 4 * p.length and p.length > 0
    for own in by_seq.values():
        own.sort(key=lambda p: p.offset)
        at = 0
        for p in own:
            assert p.offset == at
            at += p.length
        assert at <= window
    full = [sum(p.length for p in own) for own in by_seq.values()]
    assert sum(x < window for x in full) <= 1 and sorted(by_seq) == list(range(len(by_seq)))
    for d, want in docs.items():
        own = sorted(by_doc[d], key=lambda p: p.start)
        assert b"".join(p.ids for p in own) == want and [p.start for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        assert {p.doc_tokens for p in own} == {len(want) // 4}
    return by_seq


def test_packs_everything(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    rows = [(i, TEXTS[i % len(TEXTS)], None if i % 7 == 0 else f"s{i % 5 * (i % 3)}", 1) for i in range(200)]
    docs = {d: np.array([*t.encode(x or "", add_special_tokens=False).ids, 1], "<u4").tobytes() for d, x, *_ in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, part int").repartition(5)
    for mixture in (None, {"s0": 0.7, "s1": 0.3}):
        pieces = packing.pack(df, path, window=256, grain=16, mixture=mixture)
        check(pieces.collect(), docs, 256)
    assert sum(len(s.ids) for s in packing.sequences(pieces).collect()) == sum(map(len, docs.values()))
    assert packing.pack(df.limit(0), path).count() == 0


def test_random_control_strings():
    import pyarrow as pa

    r = random.Random(9)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "word", " ", "  ", "\n", ".", ", ", "É", "x's", "12"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 9))) for _ in range(1500)]
    for name, kind in (("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")):
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        ids, n = tokens.encoder(path, kind).encode(pa.array(texts, pa.string()))
        want = [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_no_overflow_in_long_queues():
    lengths = [10**12, 3 * 10**9, 10**6]
    for shares in ([65535, 1, 1], [1, 65535, 1], [60_000, 5_000, 536]):
        s = packing.Schedule(lengths, shares, 128, 2048)
        queue = np.array([0, 0, 0, 1, 1, 2])
        start = np.array([0, 5 * 10**11, 10**12 - 1000, 0, 3 * 10**9 - 1000, 10**6 - 1000])
        run, begin, n, place = s.pieces(queue, start, np.full(6, 1000))
        assert np.bincount(run, n).tolist() == [1000] * 6 and (place >= 0).all() and (place + n <= sum(lengths)).all()
        spans = sorted(zip(place.tolist(), (place + n).tolist(), strict=True))
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_many_sources(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(i, f"text number {i}", None if i == 7 else f"source {i}") for i in range(3000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), path).collect()
    t = Tokenizer.from_file(path)
    check(pieces, {d: np.array([*t.encode(x, add_special_tokens=False).ids, 1], "<u4").tobytes() for d, x, _ in rows}, 2048)


def test_windows_hold_the_shares():
    s = packing.Schedule([10_000, 30_000, 60_000], [1, 3, 6], 16, 1000)
    got = np.zeros((100, 3), int)
    for q in range(3):
        run, begin, n, place = s.pieces(np.array([q]), np.array([0]), s.lengths[[q]])
        np.add.at(got[:, q], place // 1000, n)
    assert (got.sum(1) == 1000).all() and (np.abs(got - [100, 300, 600]) <= 48).all()


def test_ratio_is_exact_beyond_64_bits():
    r = random.Random(3)
    a, b, c = ([r.randrange(1, 1 << k) for _ in range(4000)] for k in (50, 50, 60))
    a[:2000] = [-x for x in a[:2000]]
    c[1000:3000] = [r.randrange(1 << 40, 1 << 50) for _ in range(2000)]
    want = [x * y // z for x, y, z in zip(a, b, c, strict=True)]
    ok = [i for i, w in enumerate(want) if abs(w) < 1 << 61 and abs(a[i] * b[i]) < 1 << 111]
    got = packing.ratio(*(np.array(x, np.int64)[ok] for x in (a, b, c)))
    assert len(ok) > 3000 and got.tolist() == [want[i] for i in ok]


def test_many_small_sources_leave_a_large_one_its_share():
    small = np.random.default_rng(1).integers(1, 400, 100_000)
    large = 9 * int(small.sum())  # 0.90 of all tokens
    total = large + int(small.sum())
    s = packing.Schedule([large, *small.tolist()], [large, *small.tolist()], 128, 2048)
    # the large queue's place lags behind its share by what small queues were served; all queues end in the last round
    grain = np.arange(0, large // 128, 997)
    place = s.places(np.zeros(len(grain), np.int64), grain)
    rounds = place // 2048 + 1
    assert (grain * 128 >= (rounds - 1) * 2048 * 0.9 - 2048 - 128).all()
    q = np.arange(1, 100_001)
    ends = s.places(q, (small - 1) // 128) + small - (small - 1) // 128 * 128
    assert ends.max() <= total and len(np.unique(ends)) == len(ends)
    last = s.served(np.array([-(-total // 2048) - 1, -(-total // 2048)]), np.arange(100_001), s.turns[0][1])
    assert last[1].sum() == total and (last[0] < s.lengths).all()


def test_sources_without_a_target_follow():
    s = packing.Schedule([1000, 5000, 300, 0], [0, 7, 0, 0], 16, 100)
    queue, start = np.array([0, 1, 2]), np.zeros(3, np.int64)
    run, begin, n, place = s.pieces(queue, start, np.array([1000, 5000, 300]))
    used = np.zeros(6300, int)
    for a, m in zip(place.tolist(), n.tolist(), strict=True):
        used[a : a + m] += 1
    assert (used == 1).all() and place[run == 1].max() < 5000 <= place[run != 1].min()
