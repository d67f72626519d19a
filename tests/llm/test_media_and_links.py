import base64
import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthbook.llm import mpeg_audio, oracles, permutation_index, url_filter, warc
from hearthbook.llm._graph import components
from hearthbook.llm._store import Scratch

RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


@settings(max_examples=50, deadline=None)
@given(st.binary(max_size=4000))
def test_streams_carry_any_payload(payload):
    full = mpeg_audio.padded(payload)
    found = mpeg_audio.decode(mpeg_audio.encode(full))
    assert found["payload"] == full and found["crc_failed"] == 0 and found["resyncs"] == 0
    assert found["table"]["frames"] == found["frames"] == len(found["offsets"]) and found["samples"] == 1152 * found["frames"]


def test_reader_resynchronises_and_counts_bad_checksums():
    payload = mpeg_audio.padded(random.Random(1).randbytes(5000))
    media = mpeg_audio.encode(payload)
    sound = media[media.index(b"\xff\xfb") :]
    noisy = b"\xff\xfa\x90 not a frame \xff" * 20 + sound
    found = mpeg_audio.decode(noisy)
    assert found["resyncs"] == 1 and found["payload"][: len(payload)] == payload
    broken = bytearray(media)
    broken[mpeg_audio.decode(media)["offsets"][2] + 12] ^= 1
    failed = mpeg_audio.decode(bytes(broken))
    assert failed["crc_failed"] == 1 and failed["frames"] == mpeg_audio.decode(media)["frames"] 
    room = mpeg_audio._ROOM
    assert failed["payload"] == payload[: 2 * room] + bytes(room) + payload[3 * room :]  # zeros where the frame failed
    assert mpeg_audio.decode(b"")["frames"] == mpeg_audio.decode(b"ID3\xff\xfa")["frames"] == 0
    assert mpeg_audio.crc16(b"123456789") == 0xAEE7  # published check value of this CRC


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=1, max_size=9000))
def test_an_independent_walk_finds_the_same_frames(payload):
    """Frames, durations, CRCs and seek points worked out from the bytes by a walk that knows only these streams."""
    media = mpeg_audio.encode(mpeg_audio.padded(payload))
    found = mpeg_audio.decode(media)
    at = 10 + int("".join(f"{b:07b}" for b in media[6:10]), 2)
    bits = lambda k: "".join(f"{b:08b}" for b in media[k : k + 4])
    kbits = lambda k: [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320][int(bits(k)[16:20], 2)]
    first, offsets, carried = at, [], b""
    while at < len(media):
        assert bits(at)[:15] == "1" * 11 + "1101" and bits(at)[20:22] == "01" and bits(at)[24:26] == "11"
        size = 3 * kbits(at)
        if at > first:
            offsets.append(at)
            register = 0xFFFF
            for bit in "".join(f"{b:08b}" for b in media[at + 2 : at + 4] + media[at + 6 : at + 23]):
                top = register >> 15 ^ int(bit)
                register = (register << 1 & 0xFFFF) ^ (0x8005 if top else 0)
            assert register == int.from_bytes(media[at + 4 : at + 6], "big")
            carried += media[at + 23 : at + size]
        at += size
    assert at == len(media) and offsets == found["offsets"] and carried.startswith(found["payload"]) and found["payload"].startswith(payload)
    assert found["sample_rate"] == 48000 and found["version"] == 1 and found["layer"] == 3 and found["crc_checked"] == len(offsets)
    table = found["table"]
    assert table["kind"] == "xing" and table["bytes"] == len(media) - first and len(table["seek"]) == 100 and table["seek"] == sorted(table["seek"])
    for percent, place in enumerate(table["seek"]):
        true = offsets[percent * len(offsets) // 100] - first
        assert 0 <= true - place <= table["bytes"] / 256 + 1


def header(version, layer, index, rate, protected=False, padding=0, mode=3):
    return bytes([0xFF, 0xE0 | {1: 3, 2: 2, 2.5: 0}[version] << 3 | (4 - layer) << 1 | (not protected), index << 4 | rate << 2 | padding << 1, mode << 6])


def test_frames_of_other_versions_and_layers():
    """Sizes and durations by hand."""
    for version, layer, index, rate, padding, size, samples, hertz in [
        (1, 3, 9, 0, 0, 417, 1152, 44100), (1, 3, 9, 0, 1, 418, 1152, 44100), (1, 2, 14, 1, 0, 1152, 1152, 48000), (1, 1, 14, 2, 0, 672, 384, 32000), (1, 1, 1, 0, 1, 36, 384, 44100),
        (2, 3, 8, 0, 0, 208, 576, 22050), (2, 2, 14, 2, 0, 1440, 1152, 16000), (2, 1, 6, 1, 0, 192, 384, 24000), (2.5, 3, 1, 2, 0, 72, 576, 8000), (2.5, 3, 14, 0, 0, 1044, 576, 11025),
    ]:
        stream = header(version, layer, index, rate, padding=padding).ljust(size, b"\0") * 5
        found = mpeg_audio.decode(stream)
        assert found["offsets"] == [k * size for k in range(5)] and found["samples"] == 5 * samples and found["sample_rate"] == hertz and (found["version"], found["layer"]) == (version, layer)
    one = bytearray(header(1, 1, 14, 2, protected=True) + b"\0\0" + bytes(16)).ljust(672, b"\0")
    one[4:6] = mpeg_audio.crc16(bytes(one[2:4]) + bytes(16)).to_bytes(2, "big")
    found = mpeg_audio.decode(bytes(one) * 3)
    assert (found["crc_checked"], found["crc_failed"]) == (3, 0)
    one[10] = 1
    assert mpeg_audio.decode(bytes(one) * 3)["crc_failed"] == 3


@pytest.mark.parametrize(("version", "index", "rate", "mode", "widths"), [
    (1, 4, 1, 3, "44444444444333333333333" "2222"),  # 64 kbit/s in one channel
    (1, 10, 1, 0, "44444444444333333333333" "2222"),  # 96 a channel at 48 kHz
    (1, 10, 0, 0, "44444444444333333333333" "2222222"),  # 96 a channel at 44.1 kHz
    (1, 1, 0, 3, "44333333"), (1, 1, 2, 3, "443333333333"),  # 32 kbit/s at 44.1 and at 32 kHz
    (1, 10, 0, 1, "44444444444333333333333" "2222222"),  # joint: one allocation from subband 8 on
    (2, 8, 1, 2, "4444" "3333333" + 19 * "2"), (2.5, 8, 2, 1, "4444" "3333333" + 19 * "2"),
])
def test_layer_two_checksums(version, index, rate, mode, widths):
    """Frames written bit by bit: an error is told in what the checksum covers, and only there."""
    draw = random.Random(index * 7 + rate)
    for empty in (0.0, 0.5, 1.0):
        allocations, choices = "", 0
        for band, width in enumerate(int(w) for w in widths):
            stored = 1 if mode == 3 or (mode == 1 and band >= 8) else 2
            for _ in range(stored):
                value = 0 if draw.random() < empty else draw.randrange(1, 1 << width)
                allocations += f"{value:0{width}b}"
                choices += (value > 0) * (2 if mode != 3 and stored == 1 else 1)
        covered = allocations + "".join(draw.choice("01") for _ in range(2 * choices))
        head = bytearray(header(version, 2, index, rate, protected=True, mode=mode))
        head[3] |= 1 << 4 if mode == 1 else 0
        register = 0xFFFF
        for bit in f"{head[2]:08b}{head[3]:08b}" + covered:
            register = (register << 1 & 0xFFFF) ^ (0x8005 if register >> 15 ^ int(bit) else 0)
        size = mpeg_audio._described(bytes(head)).size
        bits = covered + "".join(draw.choice("01") for _ in range(8 * (size - 6) - len(covered)))
        body = lambda b: bytes(head) + register.to_bytes(2, "big") + int(b, 2).to_bytes(size - 6, "big")  # noqa: B023, E731
        flip = lambda k: bits[:k] + "10"[int(bits[k])] + bits[k + 1 :]  # noqa: B023, E731
        told = lambda b: [mpeg_audio.decode(body(b) * 3)[k] for k in ("frames", "crc_checked", "crc_failed")]  # noqa: B023, E731
        assert told(bits) == [3, 3, 0] and told(flip(len(covered))) == [3, 3, 0]
        assert all(told(flip(len(covered) - back)) == [3, 3, 3] for back in (1, 2) if choices)


def test_tags_and_tables():
    frame = header(1, 3, 9, 0).ljust(417, b"\0")
    vbri = header(1, 3, 9, 0) + bytes(32) + b"VBRI" + b"".join(n.to_bytes(w, "big") for n, w in ((1, 2), (0, 2), (75, 2), (2502, 4), (5, 4), (2, 2), (3, 2), (2, 2), (3, 2), (139, 2), (417, 2)))
    tag = b"TIT2" + (7).to_bytes(4, "big") + b"\0\0" + b"\x01" + "été".encode("utf-16-le")
    id3 = b"ID3\x03\0\0" + bytes([0, 0, 0, len(tag)]) + tag
    old = b"TAG" + b"Song".ljust(30, b"\0") + b"Singer".ljust(30) + b"Album".ljust(30) + b"1999" + bytes(31)
    found = mpeg_audio.decode(id3 + vbri.ljust(417, b"\0") + 5 * frame + old)
    assert found["table"] == {"kind": "vbri", "frames": 5, "bytes": 2502, "seek": [0, 417, 1668]} and found["frames"] == 5 and found["resyncs"] == 0
    assert found["tags"] == {"TIT2": "été", "title": "Song", "artist": "Singer", "album": "Album", "year": "1999"}
    info = header(1, 3, 9, 0) + bytes(17) + b"Info" + (1).to_bytes(4, "big") + (7).to_bytes(4, "big")
    assert mpeg_audio.decode(info.ljust(417, b"\0") + 2 * frame)["table"] == {"kind": "info", "frames": 7, "bytes": None, "seek": None}


def test_media_with_nulls_and_clashing_names(spark):
    rows = [(1, mpeg_audio.encode(bytes(64)), 5, "x"), (2, None, 6, None), (2, b"no stream", 7, "y")]
    got = mpeg_audio.inspect(spark.createDataFrame(rows, "doc_id long, media binary, frames int, a string"))
    assert got.columns[:2] == ["doc_id", "a"] and got.columns.count("frames") == 1
    held = {(r.doc_id, r.a): r for r in got.collect()}
    assert held[1, "x"].duration == held[1, "x"].samples / 48000 > 0 and held[2, None].media_bytes == 0 and held[2, "y"].frames == 0 and held[2, "y"].table_kind is None


def test_media_table_round_trip(spark):
    texts = ["", None, "abc", "é" * 70000, "abc", "\x00" * 64]
    stored = mpeg_audio.store(spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, media int"))
    got = {r.doc_id: r for r in mpeg_audio.inspect(stored, payload=True).withColumn("feature", mpeg_audio.feature()).collect()}
    for k, t in enumerate(texts):
        want = mpeg_audio.padded((t or "").encode())
        assert got[k].payload == want and got[k].payload_sha256 == hashlib.sha256(want).hexdigest() and got[k].tail_crc32 == zlib.crc32(want[-64:]) and got[k].n_bytes == len((t or "").encode())
    assert got[2].media_sha256 == got[4].media_sha256 and got[0].feature == got[1].feature
    assert mpeg_audio.inspect(stored.limit(0)).count() == 0


def test_archives_resolve_revisits(spark, tmp_path):
    nested = "x\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n"
    pages = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "http://c/é", ""), (5, "u", nested), (6, "u", nested), (7, "v", "ends\r\n\r\n"), (8, "w", "é" * 40000), (9, "w", "\r\n\r\n")]
    frame = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, digest int")
    for packed in ("gzip", "none"):
        warc.write_archives(frame, f"{tmp_path}/{packed}", compression=packed)
        rows = {int(r.record_id[:-1].rpartition(":")[2]): r for r in warc.read_archives(spark, f"{tmp_path}/{packed}").collect()}
        assert set(rows) == set(range(1, 10))
        for k, _, html in pages:
            raw = (html or "").encode()
            assert rows[k].digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
            later = [p for p, _, h in pages if (h or "") == (html or "") and p > k]
            assert (rows[k].record_type == "revisit") == bool(later)
            assert rows[k].refers_to == (f"<urn:hearthbook:page:{max(later)}>" if later else None)
            if not later:
                assert bytes(rows[k].payload) == raw
            block = rows[k].http.encode() + b"\r\n\r\n" + (b"" if later else raw)
            assert rows[k].block_digest == base64.b32encode(hashlib.sha1(block).digest()).decode()
            assert (rows[k].refers_target, rows[k].refers_date) == ((rows[max(later)].target, rows[max(later)].date) if later else (None, None))
        assert len({r.date for r in rows.values()}) == 1 and rows[1].date > "2024-01-01T00:00:00Z"
    warc.write_archives(frame, f"{tmp_path}/dated", date="2001-02-03T04:05:06Z")
    assert {r.date for r in warc.read_archives(spark, f"{tmp_path}/dated").collect()} == {"2001-02-03T04:05:06Z"}
    warc.write_archives(frame.limit(0), f"{tmp_path}/empty")
    assert warc.read_archives(spark, f"{tmp_path}/empty").count() == 0
    sizes = warc.resolve(spark.createDataFrame([(1, "d", 3), (2, "d", 3), (None, "d", 3)], "id long, digest string, bytes long"), Scratch(spark, "test"), least_bytes=4)
    assert sizes.where("refers_to is not null").count() == 0


def test_many_short_revisits_come_back_whole(spark, tmp_path):
    pages = spark.range(200000).selectExpr("id as page_id", "concat('http://a/', repeat('x', cast(id % 97 as int))) as url", "case when id % 3 = 0 then concat(id, '\\r\\n') else 'same' end as html")
    for packed in ("gzip", "none"):
        warc.write_archives(pages, f"{tmp_path}/{packed}", compression=packed)
        found = warc.read_archives(spark, f"{tmp_path}/{packed}").selectExpr("count(*) as n", "count(distinct record_id) as ids", "count_if(record_type = 'revisit') as revisits", "count_if(record_type = 'response' and digest = '') as torn").first()
        assert tuple(found) == (200000, 200000, 133332, 0)


def test_a_payload_that_holds_the_separator_comes_back_whole(spark, tmp_path):
    texts = [warc.MARK, f"x{warc.MARK}y\r\n\r\n", warc.MARK[:-1], f"{warc.MARK[:10]}{warc.MARK}", f"a\r\n\r\n{warc.MARK[:10]}b", "WARC/1.1\r\n"]
    frame = spark.createDataFrame([(k, "u", t) for k, t in enumerate(texts)], "page_id long, url string, html string")
    for packed in ("gzip", "none"):
        warc.write_archives(frame, f"{tmp_path}/{packed}", compression=packed)
        rows = {int(r.record_id[:-1].rpartition(":")[2]): bytes(r.payload).decode() for r in warc.read_archives(spark, f"{tmp_path}/{packed}").collect()}
        assert rows == dict(enumerate(texts))


def test_large_archives_of_payloads_that_hold_the_separator(spark, tmp_path):
    """Files that are read in several splits."""
    held = f"x{warc.MARK}y"
    pages = spark.range(3000).selectExpr("id as page_id", "'u' as url", f"concat(id, repeat('{held}', 5), repeat('z', cast(id % 300 as int) * 5)) as html").coalesce(1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", 100_000)
    try:
        warc.write_archives(pages, f"{tmp_path}/large", compression="none")
        found = warc.read_archives(spark, f"{tmp_path}/large")
        got = found.selectExpr("record_id", "sha1(payload) as s").collect()
        want = {f"<urn:hearthbook:page:{r.page_id}>": r.s for r in pages.selectExpr("page_id", "sha1(html) as s").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == 3000 and {r.record_id: r.s for r in got} == want


def test_components_match_union_find(spark):
    draw = random.Random(2)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)] + [(5, None), (7, 7)] + [(5000, 5000 + k) for k in range(1, 200)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        if a is not None and b is not None and a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {x: find(x) for x in root}


def test_url_rules_and_propagation(spark):
    pages = [
        (1, "https://X.example.net/en/a?b", None), (2, "http://y.net", ""), (3, "http://y.net/", ""), (4, "http://a.io/x", '<LINK href="https://bad.net/q" rel=canonical>'), (5, "https://a.io/x#f", None),
        (6, "nohost", None), (7, None, "<link rel=canonical href=/z>"), (8, "http://b.io/d/y", '<meta http-equiv="refresh" content="0; url=../k">'), (9, "http://c.io/", "<p>canonical</p>"),
        (10, "http://m.io/", '<link rel="canonical" href="http://bad.net/1">'), (11, "http://n.org/fr/1", '<link rel="canonical" href="//m.io/">'), (12, "http://net/", None), (13, "http://mynet/", None),
    ]
    more = [
        (14, "http://e.io/a/b?q", "<link rel=canonical href='?x=1&amp;y=2'>"), (15, "http://e.io/a/b?x=1&y=2", '<meta http-equiv=refresh content="1; url=../../../c/./d/..">'), (16, "http://e.io/c/", '<link rel=canonical href="http://bad.net/2">'),
        (17, "http://f.io/", '<!-- <link rel="canonical" href="http://bad.net/3"> --><script>"<link rel=canonical href=http://bad.net/4>"</script>'), (18, "http://g.io/x", '<link rel="canonical" href="#top">'),
    ]
    pages = [*pages, *more, *(more * 2)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, rule string")
    redirects = spark.createDataFrame([("http://b.io/d/y", "http://q.example.com/de/"), (None, "http://z/"), ("http://c.io/", None)], "from_url string, to_url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(frame, RULES, redirects).collect()}
    assert got[1] == ("x.example.net", "/en/a", "example.net/en/", "allow")
    assert got[2] == ("y.net", "", None, "allow") and got[3] == ("y.net", "/", "net/", "block")
    assert got[4][2:] == (None, "block") and got[5][2:] == (None, "block")
    assert got[6] == got[7] == ("", "", None, "allow")
    assert got[8][2:] == (None, "block") and got[9][2:] == (None, "allow")
    assert got[10][2:] == (None, "allow") and got[11][2:] == ("org/fr/", "allow")  # an explicit allow outranks the block
    assert got[14][2:] == got[15][2:] == got[16][2:] == (None, "block") and got[17][2:] == got[18][2:] == (None, "allow")
    assert url_filter.judge(frame, RULES, redirects).count() == len(pages)  # repeated rows come back as often
    assert got[12][2:] == ("net/", "block") and got[13][2:] == (None, "allow")
    assert url_filter.judge(frame.limit(0), RULES).count() == 0


def test_url_verdicts_match_sql_where_pages_link(spark, tmp_path):
    """The oracle's SQL over pages of which most have links: chains, hubs, cycles, repeated rows, relative and broken targets."""
    draw = random.Random(13)
    hosts = ["a.io", "x.net", "example.com", "s.example.net", "n.org", "b.io", "C.io"]
    paths = ["/", "/en/", "/de/1", "/fr/2", "", "/k/l/m?x=1", "/k", "/very/hot"]
    rows = []
    for k in range(300):
        url = draw.choice([None, "nohost"] + [f"http://{draw.choice(hosts)}{draw.choice(paths)}{draw.choice(['', '', k])}"] * 8)
        target = draw.choice(["http://hub.io/", f"//{draw.choice(hosts)}{draw.choice(paths)}", "../z", "./", "?x=1&amp;y", "#a", "mailto:me", "/k/../en/", "", f"https://{draw.choice(hosts)}{draw.choice(paths)}"])
        html = draw.choice([None, "", f'<LINK href="{target}" rel=canonical>', f'<meta http-equiv="refresh" content="0; url={target}">', f"<!-- <link rel=canonical href={target}> -->", f'<link rel="canonical" href="{target}"><link rel=icon href=/i>'])
        rows.append((k, url, html))
    rows += rows[:20]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/pages")
    found = url_filter.judge(frame, RULES)
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    # repeated rows make the oracle's joins repeat too; compare distinct rows
    want = {tuple(r) for r in con.execute(f"select page_id, host, path, rule, verdict, component from ({oracles.url_filter(RULES)})").fetchall()}
    got = found.select("page_id", "host", "path", "rule", "verdict", "component").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want and sum(r.component is not None for r in got) > 100


def nearest(spark, rows, kind="float", every=20):
    usable = permutation_index.usable(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, vector int"), "vec_id", "embedding")
    got = {}
    for r in permutation_index.search(usable, usable.where(f"id % {every} = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return usable, got


@pytest.mark.parametrize(("block", "clusters"), [(4096, 0), (150, 0), (150, 12)])
def test_nearest_neighbours(spark, monkeypatch, block, clusters):
    """Against brute force over all vectors, in one block and in many, with and without structure."""
    monkeypatch.setattr(permutation_index, "BLOCK", block)
    monkeypatch.setattr(permutation_index, "LEAST", 60)
    monkeypatch.setattr(permutation_index, "FEWEST_PIVOTS", 32)
    monkeypatch.setattr(permutation_index, "LENGTH", 16)
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(1500, 16)).astype(np.float32)
    if clusters:
        vectors = (0.2 * vectors + draw.normal(size=(clusters, 16))[draw.integers(0, clusters, size=1500)]).astype(np.float32)
    vectors[500:700] = vectors[500]  # one very common vector
    rows = [(k, v.tolist(), 1) for k, v in enumerate(vectors)] + [(5000, None, 1), (5020, [0.0] * 16, 1), (5040, [float("nan")] * 16, 1), (5060, [None] * 16, 1), (5080, [1.0], 1)]
    usable, got = nearest(spark, rows)
    assert usable.count() == 1501
    wide, hits = vectors.astype(np.float64), 0
    for q in range(0, 1500, 20):
        scores = (wide * wide[q]).sum(axis=1)  # equal vectors get equal scores
        scores[q] = -np.inf
        want = np.lexsort((np.arange(1500), -scores))[:20].tolist()
        assert len(got[q]) == 20 and all(abs(s - wide[v] @ wide[q]) < 1e-9 for v, s in got[q])
        hits += len(set(want) & {v for v, _ in got[q]})
        if 500 <= q < 700:
            same = [v for v in range(500, 700) if v != q][:20]
            assert want != same or [v for v, _ in got[q]] == same
    assert hits >= 0.9 * 20 * 75 and set(got) == set(range(0, 1500, 20))


def test_a_query_skips_blocks_of_other_clusters(spark, monkeypatch):
    monkeypatch.setattr(permutation_index, "FEWEST_PIVOTS", 32)
    draw = np.random.default_rng(5)
    vectors = np.repeat(np.eye(16), 200, axis=0) + 0.05 * draw.normal(size=(3200, 16))
    usable = permutation_index.usable(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    pivots = vectors[::100]
    probe, enough = permutation_index.calibrate(usable, usable.where("id % 20 = 0"), pivots, 16, 20, 0.96)
    assert probe <= 8 and enough > 0


def test_doubles_repeated_and_null_ids_and_few_vectors(spark):
    rows = [(0, [1.0, 0.1]), (0, [0.5, 0.5]), (1, [1e300, 1.0]), (2, [1e-60, 0.0]), (3, [0.5, 0.5]), (None, [0.5, 0.5]), (4, [0.5, float("inf")])]
    _, got = nearest(spark, [(*r, 1) for r in rows], "double")
    # both rows of id 0 are queries, each with five candidates, the other of them included
    assert set(got) == {0} and sorted(v if v is not None else -1 for v, _ in got[0]) == sorted([0, 1, 2, 3, -1] * 2)
    assert sum(v == 0 and abs(s - 0.55) < 1e-15 for v, s in got[0]) == 2
    _, one = nearest(spark, [(0, [1.0, 0.1], 1), *((*r, 1) for r in rows[2:])], "double")
    assert one[0] == [(1, 1e300 + 0.1), (3, 0.55), (None, 0.55), (2, 1e-60)]
    _, few = nearest(spark, [(0, [1.0, 0.0], 1), (2, [0.5, 0.5], 1), (1, [0.5, 0.5], 1)])
    assert few == {0: [(1, 0.5), (2, 0.5)]}
    assert nearest(spark, [])[1] == {}


def test_base32(spark):
    rows = spark.createDataFrame([("",), ("abc",), ("é\r\n",)], "t string").select("t", warc.base32_sha1(F.col("t")).alias("d")).collect()
    assert all(r.d == base64.b32encode(hashlib.sha1(r.t.encode()).digest()).decode() for r in rows)


def near_by_brute_force(vectors, queries, k):
    scores = queries @ vectors.T
    scores[np.arange(len(queries)), np.arange(len(queries)) * 20] = -np.inf
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


@pytest.mark.parametrize("clusters", [0, 120])
def test_recall_where_queries_are_routed_to_blocks(spark, monkeypatch, clusters):
    """At least 50 blocks; clustered vectors are searched in few of them, others in as many as it takes."""
    monkeypatch.setattr(permutation_index, "BLOCK", 40)
    draw = np.random.default_rng(clusters)
    shape = (3000, 16)
    vectors = draw.normal(size=shape) if not clusters else 4 * draw.normal(size=(clusters, 16))[draw.integers(clusters, size=shape[0])] + 0.3 * draw.normal(size=shape)
    frame = permutation_index.usable(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    visited = []
    routed = permutation_index._visits
    monkeypatch.setattr(permutation_index, "_visits", lambda pivots, first, parts, counts, probe, most: visited.append((int(first.max()) + 1, probe, len(pivots))) or routed(pivots, first, parts, counts, probe, most))
    found = {}
    for r in permutation_index.search(frame, frame.where("id % 20 = 0"), k=10).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    best = near_by_brute_force(vectors, vectors[::20], 10)
    recall = np.mean([len(found[20 * q] & set(b.tolist())) / 10 for q, b in enumerate(best)])
    blocks, probe, pivots = visited[0]
    assert blocks >= 50 and recall >= 0.9 and all(len(f) == 10 for f in found.values())
    assert probe <= pivots / 4 if clusters else probe <= pivots
