import random

import pytest

from lumora.sources import byteranges


def plain(path):
    out, at = [], 0
    for line in path.read_bytes().split(b"\n"):
        out.append((str(path), at, line))
        at += len(line) + 1
    if out and not out[-1][2]:
        out.pop()
    return [(f, a, min(a + len(x) + 1, path.stat().st_size), x.decode("utf-8", "replace").rstrip("\r")) for f, a, x in out]


def write(path, r, n, end=b"\n"):
    rows = [bytes(r.choice([65, 10, 13, 0xC3, 0xA9, 255]) for _ in range(r.choice([0, 1, 3, 40]))) for _ in range(n)]
    path.write_bytes(b"\n".join(rows) + end)


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_lines_that_ranges_cut_count_once(spark, tmp_path, size):
    r = random.Random(size)
    for i in range(2):
        write(tmp_path / f"f{i}.txt", r, 12, b"\n" if i else b"")
    (tmp_path / "_SUCCESS").write_bytes(b"x\n")
    (tmp_path / "empty").write_bytes(b"")
    want = sorted(x for i in range(2) for x in plain(tmp_path / f"f{i}.txt"))
    assert sorted(tuple(x) for x in byteranges.lines(spark, str(tmp_path), range_bytes=size).collect()) == want
    file, _, at, _ = want[3]
    got = byteranges.lines(spark, f"file:{tmp_path}", {file: at}, size).collect()
    assert sorted(tuple(x) for x in got) == want[4:]


def test_no_files(spark, tmp_path):
    assert byteranges.lines(spark, str(tmp_path)).collect() == []
    assert byteranges.lines(spark, str(tmp_path / "none")).collect() == []


def test_line_ends(tmp_path, monkeypatch):
    monkeypatch.setattr(byteranges, "CHUNK", 3)
    r = random.Random(2)
    for _ in range(60):
        write(tmp_path / "f", r, r.randint(0, 8), r.choice([b"", b"\n"]))
        data = (tmp_path / "f").read_bytes()
        begin, most = r.choice([0, *(i + 1 for i, c in enumerate(data) if c == 10)]), r.randint(1, 50)
        ends = [i + 1 for i, c in enumerate(data) if c == 10 and i >= begin]
        want = max([e for e in ends if e <= begin + most], default=min(ends, default=begin))
        assert byteranges.line_end(byteranges.fs.LocalFileSystem(), str(tmp_path / "f"), begin, most, len(data)) == want


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    r = random.Random(8)
    (tmp_path / "in").mkdir()
    first, second = tmp_path / "in" / "a", tmp_path / "in" / "b"
    write(first, r, 30)
    first.write_bytes(first.read_bytes() + b"cut he")

    def take(batch_bytes):
        q = byteranges.follow(spark, str(tmp_path / "in"), 16, batch_bytes).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
        try:
            q.processAllAvailable()
            return [p.numInputRows for p in q.recentProgress if p.numInputRows]
        finally:
            q.stop()

    assert len(take(100)) > 1
    read = lambda: sorted(tuple(x) for x in spark.read.parquet(str(tmp_path / "out")).collect())
    assert read() == [x for x in plain(first) if x[3] != "cut he"]
    first.write_bytes(first.read_bytes() + b"re\nmore\n")
    write(second, r, 20)
    take(1 << 20)
    assert read() == sorted(plain(first) + plain(second)) and any(x[3] == "cut here" for x in read())
    assert take(1 << 20) == [] and len(read()) == len(plain(first) + plain(second))
