import gzip
import random

import pytest
from pyspark.sql import functions as F

from brindle.llm.warc import DECOY, HTTP, MAX_HEADER, header_of, left_out, read_warc, round_trip, write_warc

from .conftest import LONG

PAGE = "page_id bigint, url string, html string"


def _file(tmp_path, name, blocks):
    data, starts = b"", []
    for i, b in enumerate(blocks):
        starts.append(len(data))
        data += header_of("response", f"http://x/{i}", f"urn:page:{i}", len(b)) + b + b"\r\n\r\n"
    (tmp_path / name).write_bytes(data)
    return starts


def _read(spark, path, split):
    return read_warc(spark, f"file://{path}", split)


@pytest.mark.parametrize("split", [97, 1 << 26])
def test_records_inside_payloads_are_none(spark, tmp_path, split):
    rng = random.Random(split)
    inner = header_of("response", "http://in/", "urn:page:9", 3) + b"abc\r\n\r\n"
    sound = [rng.choice([b"", b"WARC/1.0\r\n", inner, inner * 3, b"x" * 500, DECOY.encode(), inner[:50]]) * rng.randrange(1, 4) for _ in range(30)]
    starts = _file(tmp_path, "a.warc", sound)
    more = _file(tmp_path, "b.warc", sound[:3])
    rows = _read(spark, tmp_path, split).collect()
    a = sorted((r["offset"], bytes(r["block"])) for r in rows if r["path"].endswith("a.warc"))
    assert a == list(zip(starts, sound, strict=True))
    assert sorted(r["offset"] for r in rows if r["path"].endswith("b.warc")) == more
    assert {r["uri"] for r in rows} == {f"http://x/{i}" for i in range(30)}


def test_broken_files(spark, tmp_path):
    starts = _file(tmp_path, "cut.warc", [b"a" * 50, b"b" * 50, b"c" * 50])
    cut = (tmp_path / "cut.warc").read_bytes()
    (tmp_path / "cut.warc").write_bytes(cut[: starts[2] + 150])
    (tmp_path / "late.warc").write_bytes(b"junk " + cut)
    (tmp_path / "bad.warc").write_bytes(cut[: starts[1]] + cut[starts[1] :].replace(b"Content-Length: 50", b"Content-Length: 5x", 1))
    (tmp_path / "empty.warc").write_bytes(b"")
    (tmp_path / "nolength.warc").write_bytes(b"WARC/1.0\r\nWARC-Type: a\r\n\r\n")
    got = sorted((r["path"].rsplit("/", 1)[1], r["offset"]) for r in _read(spark, tmp_path, 64).collect())
    assert got == [("bad.warc", 0), ("cut.warc", 0), ("cut.warc", starts[1])]
    sizes = {p.name: p.stat().st_size for p in tmp_path.iterdir() if p.stat().st_size}
    broken = {"cut.warc": starts[2], "bad.warc": starts[1], "late.warc": 0, "nolength.warc": 0}
    rows = {r["path"].rsplit("/", 1)[1]: (r["size"], r["left_out"]) for r in left_out(spark, f"file://{tmp_path}", 64).collect()}
    assert rows == {f: (n, n - broken[f]) for f, n in sizes.items()}


def test_records_with_lf_line_ends(spark, tmp_path):
    data = b"".join(header_of("response", f"u{i}", f"urn:page:{i}", 3 + i).replace(b"\r\n", b"\n") + b"x" * (3 + i) + b"\n\n" for i in range(5))
    (tmp_path / "lf.warc").write_bytes(data)
    for split in (50, 1 << 20):
        rows = _read(spark, tmp_path, split).collect()
        assert sorted((r["uri"], bytes(r["block"])) for r in rows) == [(f"u{i}", b"x" * (3 + i)) for i in range(5)]
        assert [r["left_out"] for r in left_out(spark, f"file://{tmp_path}", split).collect()] == [0]


def test_headers_are_bounded(spark, tmp_path):
    payload = b"WARC/1.0\r\n" + b"\1" * (MAX_HEADER + 5000)
    starts = _file(tmp_path, "long.warc", [payload, b"after"])
    assert sorted(r["offset"] for r in _read(spark, tmp_path, 1 << 16).collect()) == starts
    (tmp_path / "long.warc").write_bytes(header_of("a", "b" * (MAX_HEADER + 1), "c", 1) + b"x\r\n\r\n")
    assert _read(spark, tmp_path, 1 << 16).count() == 0


@pytest.mark.parametrize("split", [2500, 1 << 26])
def test_a_gzip_member_for_each_record(spark, tmp_path, split):
    rng = random.Random(split)
    inner = gzip.compress(header_of("response", "http://in/", "urn:page:9", 3) + b"abc\r\n\r\n")
    blocks = [rng.choice([b"", inner, bytes(rng.randrange(256) for _ in range(700)), b"\x1f\x8b\x08\0" * 5, b"y" * 3_000]) for _ in range(25)]
    data, starts = b"", []
    for i, b in enumerate(blocks):
        starts.append(len(data))
        data += gzip.compress(header_of("response", f"http://x/{i}", f"urn:page:{i}", len(b)) + b + b"\r\n\r\n", rng.choice([0, 6]))
    (tmp_path / "a.warc.gz").write_bytes(data)
    got = sorted((r["offset"], bytes(r["block"])) for r in _read(spark, tmp_path, split).collect())
    assert got == list(zip(starts, blocks, strict=True))
    (tmp_path / "a.warc.gz").write_bytes(data[: starts[20]] + b"damage" + data[starts[20] + 6 :])
    assert sorted(r["offset"] for r in _read(spark, tmp_path, split).collect()) == starts[:20]
    assert [r["left_out"] for r in left_out(spark, f"file://{tmp_path}", split).collect()] == [len(data) - starts[20]]


def test_any_bigint_is_an_id_and_no_row_is_hot(spark, tmp_path):
    ids = [9223372036854775807, -9223372036854775808, 1234567890123456789, -5, 0, None]
    df = spark.createDataFrame([(i, "u", "h") for i in ids], PAGE)
    for gzipped in (False, True):
        assert sorted(((r["page_id"], r["url"]) for r in round_trip(df, gzipped=gzipped).collect()), key=repr) == sorted(((i, "u") for i in ids), key=repr)
    same = spark.range(4000, numPartitions=2).selectExpr("cast(null as bigint) as page_id", "'u' as url", "'h' as html")
    write_warc(same, f"file://{tmp_path}/w", 100)
    counts = [p.read_bytes().count(b"WARC-Type: response") for p in (tmp_path / "w").iterdir()]
    assert sum(counts) == 4000 and len(counts) > 30 and max(counts) < 300
    sparse = spark.createDataFrame([(i * 10**12, "u", "h") for i in range(50)], PAGE)
    write_warc(sparse, f"file://{tmp_path}/s")
    assert len(list((tmp_path / "s").iterdir())) == 1


def test_odd_and_clashing_pages(spark):
    rows = [(1, None, "x"), (None, "u", LONG), (2, "", ""), (2, "", ""), (3, "u", None)]
    df = spark.createDataFrame(rows, PAGE)
    names = ["file", "bundle", "path", "off", "next", "exit", "block", "type", "uri", "offset", "digest", "n_bytes", "a", "b", "size", "entry"]
    want = sorted(((i, u or "", len((HTTP + (h or "")).encode())) for i, u, h in rows), key=repr)
    for d in (df, df.select(*(F.lit("z").alias(c) for c in names), "*")):
        assert sorted(((r["page_id"], r["url"], r["n_bytes"]) for r in round_trip(d).collect()), key=repr) == want


def test_no_files(spark, tmp_path):
    assert _read(spark, tmp_path, 100).count() == 0


@pytest.mark.parametrize(("per_file", "split"), [(3, 3000), (1000, 1 << 20)])
def test_pages_round_trip(spark, per_file, split):
    rows = [(i, f"http://h/{i}", "<p>" + "x" * (i * 37 % 400) + "é WARC/1.0\r\n") for i in range(40)]
    rows += [(None, None, None), (5, "http://h/5", rows[5][2]), (7, "a\r\nb", ""), (41, "u", "y" * 300_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], PAGE + ", file string")
    got = sorted(((r["page_id"], r["url"], r["n_bytes"]) for r in round_trip(df, per_file, split).collect()), key=repr)
    size = lambda i, h: len((HTTP + (h or "") + (DECOY if i is not None and i % 5 == 0 else "")).encode())
    assert got == sorted(((i, (u or "").replace("\r", " ").replace("\n", " "), size(i, h)) for i, u, h in rows), key=repr)


def test_no_pages(spark):
    assert round_trip(spark.createDataFrame([], PAGE)).count() == 0


def test_writing_twice_gives_the_same_files(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "h" * i) for i in range(20)], PAGE)
    write_warc(df, f"file://{tmp_path}/w", 7)
    before = {p.name: p.read_bytes() for p in (tmp_path / "w").iterdir()}
    write_warc(df.repartition(5).orderBy(F.desc("page_id")), f"file://{tmp_path}/w", 7)
    assert before == {p.name: p.read_bytes() for p in (tmp_path / "w").iterdir()} and len(before) == 3
