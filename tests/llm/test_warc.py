"""Archives written and read back, and damaged ones salvaged."""

import glob
import gzip
import hashlib
import random

import pytest

from activity_engine.llm import token_files, warc

PAGES = "page_id long, url string, html string, digest string, size int, key string, first int, payload string, copies int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k", 1, "p", 1) for r in rows], PAGES)


def write(spark, rows, parts=4):
    where = token_files.shared_folder(spark, "warc-test")
    warc.write_warc(frame(spark, rows).repartition(parts), where)
    return where


def brute(rows):
    first = {}
    for i, _, html in rows:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = first.get(html) if len(data) >= 100 and first.get(html) != i else None
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "response" if again is None else "revisit", again))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abc é<>\r\n日") for _ in range(n))
    rows = [(i, f"http://h.example/{i}?q=a b\r\nX: y", text(rnd.randint(0, 400))) for i in range(200)]
    copy, odd = "copy " * 50, "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n" * 3
    rows += [(1000 - i, None, copy) for i in range(150)] + [(300, "http://é/", "x" * 99), (301, "u", "x" * 99), (302, "u", "x" * 100), (303, "", "x" * 100)]
    rows += [(None, "u", copy), (None, "u", None), (310, "u", None), (311, "u", ""), (312, "u", odd), (313, "u", "y" * 3_000_000), rows[3], rows[3]]
    return rows + [(None, "n", "only without ids " * 9), (None, "n", "only without ids " * 9), (851, "u", copy)]


def test_round_trip(spark, rows):
    where = write(spark, rows)
    read = warc.read_warc(spark, where).cache()
    assert sorted((tuple(r) for r in warc.digest(read).collect()), key=str) == brute(rows)
    assert warc.gaps(read).count() == 0
    payloads = {r.record_id: bytes(r.payload) for r in read.where("record_type = 'response'").collect()}
    assert all(payloads[f"urn:row:{i}"] == (html or "").encode() for i, _, html, in rows if f"urn:row:{i}" in payloads)
    uris = {r.record_id: r.target_uri for r in read.collect()}
    assert uris["urn:row:7"] == "http://h.example/7?q=a%20b%0D%0AX:%20y" and uris["urn:row:303"] == "urn:row:303"


def test_any_gzip_reader_opens_the_files(spark, rows):
    where = write(spark, rows).removeprefix("file:")
    files = [f for f in glob.glob(f"{where}/part-*")]
    records = [r for f in files for r in warc.salvage(gzip.open(f).read())]
    assert not [r for r in records if r.problem] and sum(r.headers["warc-type"] != "warcinfo" for r in records) == len(rows)


def test_no_rows(spark):
    read = warc.read_warc(spark, write(spark, []))
    assert warc.digest(read).count() == 0 and read.columns == [c.split()[0] for c in warc.RECORDS.split(", ")]


def pages(n, seed=0):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        body = rnd.randbytes(rnd.randint(0, 3000))
        out.append(warc.page_record(str(i), f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None, None))
    return out


def ids(found):
    return [f.headers["warc-record-id"] for f in found if not f.problem]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_covers_every_byte_and_loses_only_what_is_damaged(packed):
    """Random damage: whole records are found again, damaged ones are not, and records and gaps cover the file without overlap."""
    rnd = random.Random(6)
    parts = [warc.member(p) + warc.EMPTY_MEMBER if packed else p for p in pages(30)]
    begin = [sum(map(len, parts[:i])) for i in range(31)]
    for trial in range(60):
        data, hurt = bytearray(b"".join(parts)), set()
        for _ in range(rnd.randint(1, 4)):
            at, size = rnd.randrange(len(data)), rnd.randint(1, 5000)
            data[at: at + size] = rnd.randbytes(len(data[at: at + size]))
            hurt |= {i for i in range(30) if begin[i] < at + size and at < begin[i + 1]}
        found = list(warc.salvage(bytes(data)))
        got = {int(x.strip("<>").split(":")[-1]) for x in ids(found)}
        assert got >= set(range(30)) - hurt
        assert got - (set(range(30)) - hurt) <= hurt  # damage to a closer or to blank lines may leave a record whole
        at = 0
        for f in found:
            assert f.offset >= at and f.length > 0
            at = f.offset + f.length
            if not f.problem:
                assert hashlib.sha256(f.payload).hexdigest() == f.headers["warc-payload-digest"][7:]
        assert sum(f.length for f in found if f.problem) >= 1 or not hurt or len(got) == 30


def test_salvage_cases():
    a, b, c = pages(3)
    packed = [warc.member(p) for p in (a, b, c)]
    name = ["<urn:row:0>", "<urn:row:1>", "<urn:row:2>"]
    assert ids(warc.salvage(b"".join(packed))) == name
    assert ids(warc.salvage(warc.member(a + b + c))) == name
    assert ids(warc.salvage(a + warc.member(b) + c)) == name
    cut = list(warc.salvage(packed[0] + packed[1][:-9]))
    assert ids(cut) == name[:1] and [(f.offset, f.length, f.problem) for f in cut[1:]] == [(len(packed[0]), len(packed[1]) - 9, "member cut short")]
    lost = list(warc.salvage(b"junk" + a + b[:-20] + c))
    assert ids(lost) == [name[0], name[2]] and [(f.offset, f.length) for f in lost if f.problem] == [(0, 4), (4 + len(a), len(b) - 20)]
    wrong = a.replace(b"sha256:", b"sha256:0", 1)
    assert ids(warc.salvage(wrong + b)) == name[1:2]
    flipped = bytearray(packed[1])
    flipped[-6] ^= 1
    found = list(warc.salvage(packed[0] + bytes(flipped) + packed[2]))
    assert ids(found) == [name[0], name[2]] and found[1].problem == "member fails its checksum"
    assert list(warc.salvage(b"")) == [] and [f.length for f in warc.salvage(b"nothing here")] == [12]
    assert [f.problem for f in warc.salvage(b"WARC/1.0\r\nno colon\r\n\r\n")] == ["header line without a colon"]


def test_foreign_records():
    """Other digests and spellings, folded headers, bare newlines, and no HTTP header at all."""
    import base64

    body = b"plain text"
    told = base64.b32encode(hashlib.sha1(body).digest()).decode()
    head = f"WARC/1.0\nWARC-Type: resource\nWARC-Record-ID: <urn:x>\nX-Long: one\n two\nWARC-Block-Digest: sha1:{told}\ncontent-length: {len(body)}\n\n"
    found = list(warc.salvage(head.encode() + body + b"\r\n\r\n"))
    assert len(found) == 1 and found[0].payload == body and found[0].headers["x-long"] == "one two" and not found[0].problem
    assert list(warc.salvage(head.replace(told, told[::-1]).encode() + body + b"\r\n\r\n"))[0].problem == "block digest differs"


def test_gap_log_through_spark(spark, tmp_path):
    packed = [warc.member(p) for p in pages(5)]
    (tmp_path / "a.warc.gz").write_bytes(packed[0] + b"\0" * 100 + b"".join(packed[1:]))
    (tmp_path / "b.warc").write_bytes(b"")
    read = warc.read_warc(spark, str(tmp_path))
    assert read.where("problem is null").count() == 5
    assert [(r.offset, r.length) for r in warc.gaps(read).collect()] == [(len(packed[0]), 100)]
