import gzip
import hashlib
import random

import duckdb
import pytest

from tessera.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, part int"


def plain(i, body):
    return warc.record(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None)


def archive(rng, n=12):
    """Records, gzipped or plain, as (start, end, body)."""
    data, where = b"", []
    for i in range(n):
        body = bytes(rng.randrange(256) for _ in range(rng.randint(0, 300)))
        raw = plain(i, body)
        part = warc.member(raw) if rng.random() < 0.6 else gzip.compress(raw) if rng.random() < 0.5 else raw
        where.append((len(data), len(data) + len(part), body))
        data += part
    return data, where


def bodies(found):
    return [x.payload()[0] for x in found if isinstance(x, warc.Record)]


@pytest.mark.parametrize("seed", range(5))
def test_reads_what_it_wrote(seed):
    data, where = archive(random.Random(seed))
    found = list(warc.salvage(data))
    assert bodies(found) == [b for _, _, b in where]
    assert not [x for x in found if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("seed", range(30))
def test_damage_costs_only_what_it_touches(seed):
    """Bytes are changed, cut out or put in at random places; records that none of them touches are all found, and gaps and records cover the data."""
    rng = random.Random(seed)
    data, where = archive(rng)
    hurt = rng.sample(range(len(where)), 3)
    out, kept = b"", []
    for k, (a, b, body) in enumerate(where):
        part = data[a:b]
        if k in hurt:
            at = rng.randrange(1, len(part) - 1)
            how = rng.randrange(3)
            part = part[:at] + (bytes([part[at] ^ 0xFF]) + part[at + 1 :] if how == 0 else part[at + 1 :] if how == 1 else b"junk" + part[at:])
        else:
            kept.append(body)
        out += part
    found = list(warc.salvage(out))
    got = bodies(found)
    for body in kept:
        assert body in got
        got.remove(body)
    assert len(got) <= 3
    ends = sorted({(x.start, x.end) for x in found})
    assert ends[0][0] == 0 and ends[-1][1] == len(out)
    assert all(a[1] <= b[0] for a, b in zip(ends[:-1], ends[1:], strict=True))
    holes = [(a[1], b[0]) for a, b in zip(ends[:-1], ends[1:], strict=True) if a[1] != b[0]]
    assert not holes


def test_garbage_and_empty():
    assert list(warc.salvage(b"")) == []
    junk = b"\x1f\x8b\x08 no member, no WARC/1.0 record"
    only = list(warc.salvage(junk))
    assert len(only) == 1 and isinstance(only[0], warc.Gap) and (only[0].start, only[0].end) == (0, len(junk))


def test_long_records_span_members(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER", 1000)
    body = bytes(random.Random(1).randrange(256) for _ in range(10_000))
    data = warc.member(plain(1, body)) + warc.member(plain(2, b"after"))
    assert bodies(warc.salvage(data)) == [body, b"after"] and data[-1] == 0


def test_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE", 2000)
    same, other = "x" * 100, "é" * 60
    rows = [(5, "u", same), (3, None, same), (9, "u\r\nEvil: 1", same), (1, "u", "x" * 99), (2, "u", "x" * 99), (4, "u", None), (6, "u", ""), (7, "u", other), (8, "u", other), (10, "u", "<p>\x00\n WARC/1.1\r\n" * 3000)]
    pages = spark.createDataFrame([(*r, "d", 1) for r in rows], SCHEMA)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, html varchar)")
    con.executemany("insert into pages values (?, ?)", [(i, h) for i, _, h in rows])
    want = con.sql(warc.ORACLE_SQL).fetchall()
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.values()) == sorted(want)
    assert got[5].refers_to == 3 and got[3].record_type == "response" and got[2].record_type == "response"
    path = str(tmp_path / "w")
    warc.write_archives(pages.union(spark.createDataFrame([(None, "u", same, "d", 1), (3, "u", same, "d", 1)], SCHEMA)), path)
    back = warc.read_archives(spark, path).collect()
    assert all(r.kind == "record" for r in back) and len(back) == len(rows) + 2
    assert {r.record_type for r in back if r.page_id in (None, 3)} == {"response"}
    assert next(bytes(r.payload) for r in back if r.page_id == 7) == other.encode()
    assert warc.round_trip(pages.limit(0)).collect() == []


@pytest.mark.parametrize("how", ["digest", "version", "length"])
def test_a_damaged_record_in_a_member_costs_itself_alone(how):
    rng = random.Random(1)
    all_ = [bytes(rng.choice(b"abcdef \n") for _ in range(200)) for _ in range(20)]
    raw = [plain(i, b) for i, b in enumerate(all_)]
    if how == "digest":
        raw[7] = raw[7][:-10] + b"?" + raw[7][-9:]
    elif how == "version":
        raw[7] = b"X" + raw[7][1:]
    else:
        raw[7] = raw[7].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1)
    data = gzip.compress(b"".join(raw))
    found = list(warc.salvage(data + warc.member(plain(99, b"after"))))
    assert bodies(found) == all_[:7] + all_[8:] + [b"after"]
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert [(g.start, g.end) for g in gaps] == [(0, len(data))]


def test_a_cut_member_keeps_its_whole_records():
    rng = random.Random(2)
    all_ = [bytes(rng.randrange(256) for _ in range(300)) for _ in range(30)]
    data = gzip.compress(b"".join(plain(i, b) for i, b in enumerate(all_)))
    cut = data[: len(data) * 2 // 3]
    found = list(warc.salvage(cut))
    got = bodies(found)
    assert len(got) >= 17 and got == all_[: len(got)]
    assert isinstance(found[-1], warc.Gap) and (found[-1].start, found[-1].end) == (0, len(cut))


@pytest.mark.parametrize("length", ["²", "9" * 5000, "-1", "", "٣", "9" * 19])
def test_odd_lengths_are_damage(length):
    good = [warc.record(k, "u", b"x" * 50, hashlib.sha256(b"x" * 50).hexdigest(), None) for k in range(2)]
    bad = b"WARC/1.1\r\nContent-Length: " + length.encode() + b"\r\n\r\n\r\n\r\n"
    found = list(warc.salvage(good[0] + bad + good[1]))
    assert [type(x).__name__ for x in found] == ["Record", "Gap", "Record"]


def test_an_http_header_that_cannot_be_read_is_payload():
    x = warc.Record(0, 1, {"content-type": "application/http"}, b"HTTP/1.1 200 OK\r\nno colon\r\n\r\nbody")
    assert x.payload() == (x.block, {})
