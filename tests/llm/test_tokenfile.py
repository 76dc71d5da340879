import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lumora.llm import tokenfile


def test_round_trip(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    words = "the cat sat on a mat with 12 hats,\n\n and  then é".split(" ")
    rows = [(i * 3 % 301, " ".join(words[(i * j) % len(words)] for j in range(i % 40)), 1) for i in range(301)]
    rows += [(999, "a <|endoftext|> b", 1), (1000, None, 1), (1001, "", 1), (1002, "x " * 60_000, 1), (None, "lost", 1), (7, "again", 1)]
    got = tokenfile.round_trip(spark.createDataFrame(rows, "doc_id long, text string, part int"), path).collect()
    want = sorted((-1 if d is None else d, x or "", np.array([*t.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()) for d, x, _ in rows)
    got.sort(key=lambda r: r.start)
    assert [(-1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in got] == [(d, i) for d, _, i in want]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    assert all(4 * r.n_tokens == len(r.ids) for r in got)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfile.round_trip(df, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
