import gzip
import hashlib
import random

from pyspark.sql import types as T
from vigilia.llm import warc as W

SCHEMA = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                       T.StructField("digest", T.StringType()), T.StructField("block", T.StringType())])


def rows():
    big = "<p>é same page</p>" * 20
    out = [(5, "http://a", big), (3, "http://b\r\nWARC/1.1", big), (9, None, big), (4, "u", "short"), (2, "u", "short"), (7, "u", None), (8, None, ""),
           (None, "u", big), (None, None, "x\r\n\r\nWARC/1.1\r\ny" * 30), (11, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" * 40), (12, "u", "z" * 300000),
           (3, "http://b", big)]
    return [(*r, "x", "y") for r in out]


def want():
    first = {}
    for i, _, html, *_ in rows():
        body = (html or "").encode()
        if len(body) >= 100 and (body not in first or (i is None, i or 0) < (first[body] is None, first[body] or 0)):
            first[body] = i
    out = []
    for i, _, html, *_ in rows():
        body = (html or "").encode()
        again = len(body) >= 100 and first[body] != i
        out.append((i, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return out


def test_round_trip(spark, monkeypatch):
    for few in (W.FEW_REVISITS, 0):
        monkeypatch.setattr(W, "FEW_REVISITS", few)
        got = W.round_trip(spark.createDataFrame(rows(), SCHEMA))
        assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want()))
    assert W.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def archive(spark, tmp_path):
    path = str(tmp_path / "w")
    W.write_warc(spark.createDataFrame([(i, f"http://p/{i}", f"page {i} " * 50) for i in range(40)], "page_id long, url string, html string").coalesce(1), path)
    files = sorted(tmp_path.glob("w/part*"))
    data = b"".join(f.read_bytes() for f in files)
    assert data.endswith(b"\r\n\r\n")
    return data


def ids(found):
    return [r.record_id for r in found if r.kind == "record"]


def read(spark, tmp_path, name, data):
    (tmp_path / name).mkdir()
    (tmp_path / name / "x.warc").write_bytes(data)
    found = sorted(W.read_warc(spark, str(tmp_path / name)).collect(), key=lambda r: (r.offset, r.kind == "record"))
    return found


def test_salvage_of_plain_and_gzip_files(spark, tmp_path):
    data = archive(spark, tmp_path)
    parts = [data[a:b] for a, b, kind, _ in W.read_plain(data)]
    names = [W._fields(r, True)["record_id"] for _, _, _, r in W.read_plain(data)]
    assert len(parts) == 40 and b"".join(parts) == data
    assert ids(read(spark, tmp_path, "whole", data)) == names

    flipped = bytearray(parts[7])
    flipped[-40] ^= 1
    broken = [parts[0], b"junk before", parts[1], bytes(flipped), parts[8], parts[9][:60], parts[10], parts[11].replace(b"Content-Length", b"Content-Width", 1), parts[12], parts[13][:-30]]
    found = read(spark, tmp_path, "broken", b"".join(broken))
    assert ids(found) == [names[i] for i in (0, 1, 8, 10, 12)]
    gaps = [(r.offset, r.length) for r in found if r.kind == "gap"]
    assert sum(r.length for r in found) == sum(map(len, broken)) and len(gaps) == 5 and all(r.reason for r in found if r.kind == "gap")
    pos = 0
    for r in found:  # records and gaps cover the file without holes
        assert r.offset == pos
        pos += r.length

    members = [gzip.compress(p, mtime=0) for p in parts]
    assert ids(read(spark, tmp_path, "gz", b"".join(members))) == names
    cut = bytearray(members[5])
    cut[len(cut) // 2] ^= 0xFF
    found = read(spark, tmp_path, "gzbroken", b"".join([members[0], bytes(cut), members[6], members[7][:50], members[8], b"tail"]))
    assert ids(found) == [names[i] for i in (0, 6, 8)] and len([r for r in found if r.kind == "gap"]) == 3


def test_any_damage_loses_only_the_records_it_touches():
    rng = random.Random(1)
    record = lambda i: (f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{i}>\r\nWARC-Block-Digest: sha256:{hashlib.sha256(b'body %d' % i).hexdigest()}\r\n"  # noqa: E731
                        f"Content-Length: {len(b'body %d' % i)}\r\n\r\nbody {i}\r\n\r\n").encode()
    parts = [record(i) for i in range(30)]
    for _ in range(60):
        hit = sorted(rng.sample(range(30), 3))
        bad = [bytearray(p) for p in parts]
        for i in hit:
            at = rng.randrange(len(bad[i]))
            bad[i][at:at + rng.randrange(1, 9)] = bytes(rng.randrange(256) for _ in range(rng.randrange(0, 5)))
        got = list(W.read_plain(b"".join(bad)))
        seen = {int(r["head"][b"warc-record-id"][10:-1]) for _, _, k, r in got if k == "record" and r["head"][b"warc-record-id"][10:-1].isdigit()}
        assert set(range(30)) - set(hit) <= seen
        assert [a for a, *_ in got] == [0, *[b for _, b, *_ in got][:-1]]


def test_damage_to_the_first_bytes_of_a_gzip_archive(spark, tmp_path):
    data = archive(spark, tmp_path)
    parts = [data[a:b] for a, b, _, _ in W.read_plain(data)]
    names = [W._fields(r, True)["record_id"] for _, _, _, r in W.read_plain(data)]
    members = [gzip.compress(p, mtime=0) for p in parts]
    whole = b"".join(members)
    for name, bad, left in (("junk", b"junk" + whole, names), ("lost", whole[3:], names[1:]), ("flipped", b"\x00" + whole[1:], names[1:]),
                            ("mixed", b"".join([members[0][5:], members[1], parts[2], b"x", parts[3], members[4]]), names[1:5])):
        found = read(spark, tmp_path, "start-" + name, bad)
        assert ids(found) == left
        assert [r.offset for r in found][0] == 0 and sum(r.length for r in found) == len(bad)


def test_round_trip_of_a_page_with_a_very_long_url(spark):
    pages = spark.createDataFrame([(1, "data:text/html," + "x" * 70000, "one"), (2, "http://b", "two")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes) for r in W.round_trip(pages).collect()) == [(1, 3), (2, 3)]
