"""Tokenisers, token files, packing, BPE, audio, archives and shards: exact round trips."""

import base64
import gzip
import hashlib
import io
import os
import random
import zlib
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import archives, bpe, mpeg, packing, sharding, token_files
from tallyframe.llm.chunks import ChunkEncoder, library_encoder, vocabulary_path

TEXTS = ["", "a", "The quick brown fox.", "  two  spaces \n\n lines\t x", "it's WE'LL don't!!\r\n", "日本語 テキスト é ΑΣ Σ", "c² ²3 ½ x_y 12ab", "café  x　y \x1cz İs", "<|endoftext|> <|startoftext|>", "a <|endoftext|> b", "<|ENDOFTEXT|>x", "İstanbul", "é" * 700 + "x" * 300, "a" * 3000, "word " * 2000, " ", "퟿\U0001f600 ok"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_encode_as_the_library(name):
    from tokenizers import Tokenizer

    path = vocabulary_path(name)
    whole = Tokenizer.from_file(path)
    encoder = library_encoder(path)
    for t in TEXTS:
        assert encoder.encode(t).tolist() == whole.encode(t, add_special_tokens=False).ids, t


@lru_cache
def plain_tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*"ab'sé² \n\t.,3_-\u0301\u3000Σİ", "<|endoftext|>"]), max_size=40).map("".join))
def test_any_text_encodes_as_the_library(text):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = vocabulary_path(name)
        assert library_encoder(path).encode(text).tolist() == plain_tokenizer(path).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("unit", ["x", "é", "ab1", "..!"])
def test_a_very_long_text_without_white_space_encodes_as_the_library(unit):
    from tokenizers import Tokenizer

    text = unit * ((1 << 20) // len(unit) + 50) + " end"
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = vocabulary_path(name)
        encoder = library_encoder(path)
        assert encoder.encode(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
        assert max(map(len, encoder.known)) <= 256


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("span, block", [(1, 1), (3, 40), (64, 1000), (1 << 20, 1 << 22)])
def test_many_texts_encode_as_each_alone(name, span, block, monkeypatch):
    monkeypatch.setattr("tallyframe.llm.chunks.SPAN", span)
    monkeypatch.setattr("tallyframe.llm.chunks.BLOCK", block)
    texts = ["", None, *TEXTS, "", "!!ab..cd's", " 's", "\t\n", None, *TEXTS[::-1], "x" * 300 + " y", ""]
    whole = plain_tokenizer(vocabulary_path(name))
    encoder = library_encoder(vocabulary_path(name))
    for known in (encoder.known.clear(), None):  # nothing is known, then all
        got = [x.tolist() for x in encoder.encode_many(iter(texts))]
        assert got == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert list(encoder.encode_many([])) == []


def test_a_worker_that_forgets_chunks_encodes_as_one_that_does_not():
    encoder = library_encoder(vocabulary_path("byte_bpe_50k.json"))
    small = ChunkEncoder(encoder.encode_all, encoder.whole, encoder.apart, cached=5)
    for t in TEXTS:
        assert small.encode(t).tolist() == encoder.encode(t).tolist()
        assert len(small.known) <= max(5, len(t))


def test_a_worker_keeps_a_bounded_number_of_chunks_and_the_usual_ones_among_them():
    encoder, asked = library_encoder(vocabulary_path("byte_bpe_50k.json")), []

    def encode(chunks):
        asked.extend(chunks)
        return encoder.encode_all(chunks)

    small = ChunkEncoder(encode, encoder.whole, encoder.apart, cached=100)
    for k in range(40):
        rare = [f"{k}x{i}" for i in range(20)]
        text = " the cat" + "".join(f" the {x}" for x in rare)
        assert small.encode(text).tolist() == encoder.encode(text).tolist()
        assert len(small.known) + len(small.older) <= 100
    assert asked.count(" the") == asked.count(" cat") == 1
    small.encode(" ".join(f"y{i}" for i in range(1000)))  # one text has more than are kept
    assert len(small.known) + len(small.older) <= 100


def test_a_worker_that_is_done_holds_little_memory():
    """It stays, idle, beside the stages that follow; the pipeline failed by that."""
    import subprocess
    import sys

    code = """
import re
from tallyframe.llm.chunks import library_encoder, vocabulary_path

def held():
    return sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) >> 10

encoder = library_encoder(vocabulary_path("byte_bpe_50k.json"))
encoder.encode("one text")
before = held()
rare = iter(range(10**9))
for _ in range(2):
    texts = (" ".join(f"w{next(rare) * 7919 % 10**9:x}" for _ in range(500)) for _ in range(800))
    for ids in encoder.encode_many(texts):
        pass
print(held() - before)
"""
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.getcwd())
    assert int(done.stdout) < 220


def test_each_distinct_chunk_is_looked_up_once():
    class Counted(dict):
        asked = 0

        def get(self, *a):
            self.asked += 1
            return super().get(*a)

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    encoder = library_encoder(vocabulary_path("byte_bpe_50k.json"))
    before, encoder.known = encoder.known, Counted()
    try:
        encoder.encode("the cat, " * 10_000)
        assert encoder.known.asked <= 10
    finally:
        encoder.known = before


@pytest.fixture(scope="module")
def reference_bpe():
    import public_tokenizers as P
    import tiktoken

    path = vocabulary_path("byte_bpe_multi_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.codec(path, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_segment_tree_merges_as_the_library(reference_bpe):
    codec, whole = reference_bpe
    rng = random.Random(4)
    texts = [*TEXTS, *("".join(rng.choice("abcdeht") for _ in range(n)) for n in (2, 3, 17, 64, 65, 500, 20000))]
    for t in texts:
        ids = codec.encode(t)
        assert ids.tolist() == whole.encode_ordinary(t), t[:40]
        assert codec.decode(ids) == t.encode()


def test_bpe_query(spark, documents, reference_bpe):
    rows = [*enumerate(TEXTS), (98, None), (None, "x y"), (3, TEXTS[3])]
    got = bpe.query(documents(rows, ids=1, n_tokens=2, DECODED="d")).collect()
    _, whole = reference_bpe
    want = []
    for i, t in rows:
        ids = np.array(whole.encode_ordinary(t or ""), "<u4").tobytes()
        want.append((i, len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert bpe.query(documents([])).count() == 0


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 31, 32])
def test_bits_pack_and_unpack(bits):
    rng = np.random.default_rng(bits)
    for n in (0, 1, 7, 8, 4096, 5001):
        ids = rng.integers(0, 2**bits, n, dtype=np.uint64).astype(np.uint32)
        data = token_files.pack(ids, bits)
        assert len(data) == -(-n * bits // 8) and (token_files.unpack(data, bits, n) == ids).all()


def test_token_file_gives_any_range(tmp_path):
    rng = np.random.default_rng(0)
    docs = [(i if i != 2 else None, rng.integers(0, 49_408, n).astype(np.uint32)) for i, n in enumerate([5, 0, 9000, 1, 4096])]
    w = token_files.TokenWriter(f"{tmp_path}/x/a.tok", 49_408)
    for name, ids in docs:
        w.add(name, ids)
    with pytest.raises(ValueError):
        w.add(9, np.array([70_000], np.uint32))
    w.close()
    r, every = token_files.TokenReader(f"file://{tmp_path}/x/a.tok"), np.concatenate([d for _, d in docs])
    for a, b in ((0, 0), (0, 5), (4000, 4200), (4096, 8192), (13_000, 13_102), (0, len(every))):
        assert (r.ids(a, b) == every[a:b]).all()
    assert [(n, ids.tolist()) for n, _, ids in r.documents(100)] == [(n, d.tolist()) for n, d in docs]


def test_token_files_round_trip(documents):
    from tokenizers import Tokenizer

    rows = [(7, "second doc"), (3, TEXTS[2]), (5, None), (None, "no id"), (9, "word " * 4000), (3, TEXTS[2])]
    t = Tokenizer.from_file(vocabulary_path("word_bpe_49k.json"))
    got = sorted(token_files.query(documents(rows, start=1, file=2, path="p", n_tokens=3)).collect(), key=lambda r: r.start)
    at = 0
    for r, (i, text) in zip(got, sorted(rows, key=lambda r: -1 if r[0] is None else r[0]), strict=True):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        assert tuple(r) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.query(documents([])).count() == 0


def check_plan(counts, room):
    runs = packing.plan(counts, room)
    used, places = {}, {}
    for length, rank, n, first, offset in runs:
        for k in range(n):
            assert used.setdefault(length, set()).isdisjoint({rank + k})
            used[length].add(rank + k)
            places.setdefault(first + k, []).append((offset, length))
    assert {k: len(v) for k, v in used.items()} == {k: v for k, v in counts.items() if v}
    assert all(used[k] == set(range(v)) for k, v in counts.items() if v)
    for spans in places.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= room
    return len(places)


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 40), max_size=20))
def test_plan_fills_every_sequence_without_gaps(counts):
    n = check_plan(counts, 32)
    total = sum(k * v for k, v in counts.items())
    assert -(-total // 32) <= n <= sum(counts.values()) and n <= 2 * -(-total // 32) + 1


def plain_best_fit(counts, room):
    left = []
    for length in sorted((k for k, n in counts.items() for _ in range(n)), reverse=True):
        fits = [x for x in left if x >= length]
        if fits:
            left.remove(min(fits))
        left.append((min(fits) if fits else room) - length)
    return len(left)


@settings(max_examples=300, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(0, 12), max_size=12))
def test_plan_is_best_fit_piece_by_piece(counts):
    assert check_plan(counts, 32) == plain_best_fit(counts, 32)
    assert check_plan({10: 2, 3: 2, 2: 3}, 16) == plain_best_fit({10: 2, 3: 2, 2: 3}, 16) == 2


def test_plan_refuses_what_does_not_fit():
    with pytest.raises(ValueError):
        packing.plan({33: 1}, 32)


def test_packing_query_equals_brute_force(documents):
    rows = [(i, "word " * (37 * i % 900)) for i in range(60)] + [(100, "tok " * 7000), (101, None), (102, "a <|endoftext|> b"), (None, "x"), (5, "same"), (5, "same")]
    got = packing.query(documents(rows, length=1, offset=2)).collect()
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 2048
    t, want, counts = plain_tokenizer(vocabulary_path("byte_bpe_50k.json")), [], {}
    for i, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
            counts[b - a] = counts.get(b - a, 0) + 1
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, want))
    assert len(by) == plain_best_fit(counts, 2048)
    assert packing.query(documents([])).count() == 0


def test_audio_keeps_any_payload():
    for payload in (b"", b"x" * 64, os.urandom(5000), b"\xff\xfb" * 3000, bytes(1417), bytes(1418)):
        m = mpeg.parse(data := mpeg.store(payload))
        assert mpeg.stored(data) == payload and m.junk == 0 and m.crc_bad == 0
        assert m.vbr["frames"] == len(m.offsets) and m.tags["id3v1"] == "payload"
        assert m.duration * 32000 == 1152 * len(m.offsets)


def test_audio_resynchronises_and_checks():
    data = mpeg.store(os.urandom(9000))
    clean = mpeg.parse(data)
    k = clean.offsets[3]
    torn = mpeg.parse(data[:k] + b"\xff\xe0garbage\xff" + data[k:])
    assert (len(torn.offsets), torn.junk, torn.resyncs) == (len(clean.offsets), 10, 1)
    bad = bytearray(data)
    bad[k + 8] ^= 1
    assert mpeg.parse(bytes(bad)).crc_bad == 1
    with pytest.raises(ValueError):
        mpeg.stored(bytes(bad))
    assert clean.seek(0) == clean.offsets[0] and clean.seek(clean.duration) is None and mpeg.parse(b"").duration == 0


def test_tags_inside_audio_are_audio():
    """Texts whose bytes look like a tag, at every place before the end of the stream."""
    for mark in (b"APETAGEX", b"TAG", b"ID3", b"\xff\xfb\x90\xc0"):
        for at in range(0, 190, 2):
            p = (b"a" * at + mark).ljust(192, b"b")[:192]
            assert mpeg.stored(mpeg.store(p)) == p, (mark, at)
    rng = random.Random(9)
    for n in (64, 1216, 1280, 1344, 5056):
        for size in (32, 64, 96, 144, 500, 1000, 1500):
            footer = b"APETAGEX" + (2000).to_bytes(4, "little") + size.to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(3) + bytes([rng.choice([0, 128])]) + bytes(8)
            for back in range(32, min(n, 400), 3):
                p = bytearray(rng.randbytes(n))
                p[n - back : n - back + 32] = footer
                assert mpeg.stored(mpeg.store(bytes(p))) == bytes(p)


def test_tags_after_audio_are_read():
    frames = mpeg.store(os.urandom(3000))[:-128]
    item = (5).to_bytes(4, "little") + bytes(4) + b"Title\0hello"
    footer = b"APETAGEX" + (2000).to_bytes(4, "little") + (32 + len(item)).to_bytes(4, "little") + (1).to_bytes(4, "little") + bytes(3) + b"\x80" + bytes(8)
    whole = mpeg.parse(frames)
    for tag in (footer + item + footer, footer + item + footer + b"TAG" + b"song".ljust(125, b"\0")):
        m = mpeg.parse(frames + tag)
        assert m.tags["APE:Title"] == "hello" and m.offsets == whole.offsets and m.junk == 0
        assert m.tags.get("id3v1") == ("song" if tag[-128:-125] == b"TAG" else None)
        torn = mpeg.parse(frames[:-40] + tag)  # the last frame is cut off
        assert torn.tags["APE:Title"] == "hello" and torn.offsets == whole.offsets[:-1] and torn.junk > 0


def plain_frames(data):
    """Frame places by the plainest walk: MPEG-1 Layer III at 32 kHz from the first one on."""
    kbps = [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320]
    at, out = 10 + data[9] + 128 * data[8], []
    while data[at] == 0xFF:
        out.append(at)
        at += 144_000 * kbps[data[at + 2] >> 4] // 32_000
    assert data[at : at + 3] == b"TAG" and at + 128 == len(data)
    return out[1:]  # the first holds the table


def remainder(bits):
    """The checksum by long division of the bits, 16 zeros after them, all ones before."""
    value = (int(bits, 2) << 16) ^ (0xFFFF << len(bits))
    for k in range(len(bits) - 1, -1, -1):
        if value >> (k + 16) & 1:
            value ^= 0x18005 << k
    return value & 0xFFFF


@pytest.mark.parametrize("head,tables", [(b"\xff\xfc\x94\x00", [4] * 11 + [3] * 12 + [2] * 4), (b"\xff\xfc\x90\x00", [4] * 11 + [3] * 12 + [2] * 4), (b"\xff\xfc\xd0\x00", [4] * 11 + [3] * 12 + [2] * 7), (b"\xff\xfc\x10\xc0", [4] * 2 + [3] * 6), (b"\xff\xfc\x18\xc0", [4] * 2 + [3] * 10), (b"\xff\xf4\x80\x00", [4] * 4 + [3] * 7 + [2] * 19)])
def test_layer_two_checksums(head, tables):
    rng = random.Random(len(tables))
    h = mpeg.header(head)
    for joint in (None, 0, 3) if h.channels == 2 else (None,):
        top = head[:3] + bytes([head[3] | (0x40 | joint << 4 if joint is not None else 0)])
        bound = len(tables) if joint is None else min(len(tables), 4 * joint + 4)
        bits, chosen = "", 0
        for k, width in enumerate(tables):
            for _ in range(h.channels if k < bound else 1):
                x = rng.randrange(1 << width) if rng.random() < 0.3 else 0
                bits += format(x, f"0{width}b")
                chosen += (x > 0) * (1 if k < bound else h.channels)
        bits += "".join(rng.choice("01") for _ in range(2 * chosen))
        crc = remainder("".join(format(b, "08b") for b in top[2:]) + bits)
        rest = bits + "".join(rng.choice("01") for _ in range(-len(bits) % 8))
        frame = top + crc.to_bytes(2, "big") + int(rest, 2).to_bytes(len(rest) // 8, "big")
        assert len(frame) <= h.size
        frame = frame.ljust(h.size, b"\x55")
        m = mpeg.parse(frame * 3)
        assert (len(m.offsets), m.crc_ok, m.crc_bad) == (3, 3, 0)
        bad = bytearray(frame)
        bad[6 + (len(bits) - 1) // 8] ^= 1 << (7 - (len(bits) - 1) % 8)
        assert mpeg.parse(bytes(bad) * 2).crc_bad == 2


def test_headers_of_other_layers():
    h = mpeg.header(bytes([0xFF, 0xFD, 0x94, 0x00]))  # MPEG-1 Layer II, 160 kbit/s, 48 kHz
    assert (h.version, h.layer, h.kbps, h.rate, h.size, h.samples) == ("1", 2, 160, 48000, 480, 1152)
    h = mpeg.header(bytes([0xFF, 0xF3, 0x40, 0xC0]))  # MPEG-2 Layer III, 32 kbit/s, 22.05 kHz
    assert (h.version, h.layer, h.size, h.samples, h.side) == ("2", 3, 104, 576, 9)
    assert mpeg.header(b"\xff\xfb\xf0\x00") is None and mpeg.header(b"abcd") is None


def test_audio_query(documents):
    rows = [(1, "héllo"), (2, None), (3, "x" * 64), (4, "y" * 100_000), (5, "héllo"), (None, "n"), (6, ("a" * 161 + "APETAGEX").ljust(192, "b"))]
    got = {r.doc_id: r for r in mpeg.query(documents(rows, media="m", mpeg=1)).collect()}
    for i, t in rows:
        data = (t or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        media = mpeg.store(padded)
        at = plain_frames(media)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        seconds = Fraction(1152 * len(at), 32000)
        seek = zlib.crc32(np.array(at, "<u8").tobytes())
        assert r.feature.startswith(f"frames={len(at)};seconds={seconds.numerator}/{seconds.denominator};") and r.feature.endswith(f"vbr=Xing:{len(at)};crc={len(at)}/{len(at)};junk=0;seek={seek:08x}")
    assert tuple(got[1])[1:] == tuple(got[5])[1:]
    assert mpeg.query(documents([])).count() == 0


def test_arc_versions_and_damage():
    for version in (1, 2):
        data = archives.arc_file_record(version, "a.arc", "20200102030405") + archives.arc_record(version, "http://x/a b", "1.2.3.4", "20200102030405", "text/html", b"HTTP/1.1 200 OK\r\n\r\nhi\n") + b"\n" + archives.arc_record(version, "http://y", "-", "2020", "text/plain", b"")
        records = list(archives.read_arc(data))
        assert [(r.version, r.fields["url"], r.body) for r in records] == [(version, "http://x/a%20b", b"HTTP/1.1 200 OK\r\n\r\nhi\n"), (version, "http://y", b"")]
        headers, block = next(archives.read_warc(io.BytesIO(archives.convert(records[0], "a.arc"))))
        assert headers["warc-type"] == "response" and headers["warc-date"] == "2020-01-02T03:04:05Z" and block == records[0].body
        assert headers["warc-payload-digest"] == "sha256:" + hashlib.sha256(b"hi\n").hexdigest()
        assert archives.convert(records[0], "a.arc") == archives.convert(records[0], "a.arc") != archives.convert(records[0], "b.arc")
    assert archives.warc_date("2020") == "2020-01-01T00:00:00Z"
    for bad in (b"http://x - 2020 text/html 50\nshort\n", b"nonsense\nmore", b"no end of line"):
        with pytest.raises(ValueError):
            list(archives.read_arc(archives.arc_file_record(1, "a", "2020") + bad))


def test_archive_query(spark):
    big = "<p>é</p>" * 40
    rows = [(5, "http://a", big), (2, "http://b c", big), (9, None, None), (8, "u", ""), (7, "v", "short"), (6, "w", "short"), (1, "z", "q" * 3_000_000), (2, "again", big), (3, "filedesc://x.arc", "1 0 anyone\n"), (4, "filedesc://y", "2"), (None, "filedesc://z", big), (None, None, None)]
    got = archives.query(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = []
    for i, _, h in rows:
        data = (h or "").encode()
        again = h == big and i != 2
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 2 if again else None))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert archives.query(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    clash = spark.createDataFrame([(1, "u", "h", "p", 3)], "page_id long, url string, html string, path string, at int")
    assert archives.query(clash).count() == 1


def test_converted_archives_refer_to_records(spark, tmp_path):
    big = "<p>same</p>" * 30
    rows = [(k, f"http://h/{k % 3}", big if k % 2 else f"{k}" * 60) for k in range(40)] + [(5, "http://h/2", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warcs = archives.convert_archives(archives.write_arcs(pages, f"{tmp_path}/arc", version=1), f"{tmp_path}/warc")
    records = []
    for r in warcs.collect():
        with open(r.path, "rb") as f:
            records += archives.read_warc(io.BytesIO(gzip.decompress(f.read())))
    by = {h["warc-record-id"]: h for h, _ in records}
    assert len(by) == len(rows) == warcs.agg({"n": "sum"}).first()[0]  # equal rows have identifiers of their own
    again = [h for h in by.values() if h["warc-type"] == "revisit"]
    assert len(again) == 20
    for h in again:
        first = by[h["warc-refers-to"]]
        assert first["warc-type"] == "response" and first["warc-payload-digest"] == h["warc-payload-digest"]
        assert (first["warc-target-uri"], first["warc-date"]) == (h["warc-refers-to-target-uri"], h["warc-refers-to-date"])


def test_shards_have_exact_sizes(documents):
    rows = [(i, f"text {i % 7}") for i in range(1000)] + [(None, None), (None, "x"), (3, "text 3")]
    docs = documents(rows, hg_part=1, row=2)
    got = sharding.query(docs).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r.shard, []).append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert set(sizes) == set(range(24)) and max(map(len, sizes.values())) - min(map(len, sizes.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in sizes.values())
    by = {r.doc_id: (r.size, r.text_crc32) for r in got}
    assert by[4] == (8 + 6, zlib.crc32(b"text 4"))
    again = sharding.query(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    clash = sharding.hypergeometric_shuffle(documents(rows, Shard=77))
    assert "Shard" not in clash.columns and clash.filter("shard = 77").count() == 0 and clash.count() == len(rows)
    assert sharding.query(documents([])).count() == 0


def test_matrix_has_the_law_of_a_uniform_permutation(spark):
    """Cells of a small matrix over many seeds against the exact multivariate law."""
    from math import comb

    sizes, draws = [3, 2, 1], {}
    counts = spark.createDataFrame(list(enumerate(sizes)), "part int, n long")
    rows = sharding.communication_matrix(counts, 2, 3, 1).collect()
    assert sorted((r.part, r.ends[-1]) for r in rows) == list(enumerate(sizes)) and sum(r.ends[0] for r in rows) == 3
    from pyspark.sql import functions as F

    # The same expression for many keys at once: two shards of three rows.
    long = lambda *x: F.array(*(F.lit(i).cast("long") for i in x))
    got = spark.range(6000).select(sharding._matrix(long(*sizes), long(3, 3), 2, F.col("id")).alias("m")).collect()
    for r in got:
        assert [sum(x) for x in r.m] == sizes and [sum(x) for x in zip(*r.m, strict=True)] == [3, 3]
        key = tuple(x[0] for x in r.m)
        draws[key] = draws.get(key, 0) + 1
    law = {(a, b, c): comb(3, a) * comb(2, b) * comb(1, c) / comb(6, 3) for a in range(4) for b in range(3) for c in range(2) if a + b + c == 3}
    assert set(draws) == set(law)
    chi = sum((draws[k] - 6000 * p) ** 2 / (6000 * p) for k, p in law.items())
    assert chi < 27.9  # 0.999 quantile at nine degrees, more than there are


def test_shuffle_is_uniform(documents):
    """Where a row lands does not depend on where it came from."""
    from pyspark.sql import functions as F

    docs = documents([(i, str(i)) for i in range(4800)])
    cells = sharding.hypergeometric_shuffle(docs, shards=8, partitions=6, seed=3).groupBy((F.col("doc_id") % 12).alias("k"), "shard").count().collect()
    chi = sum((r["count"] - 50) ** 2 / 50 for r in cells)
    assert len(cells) == 96 and chi < 127  # 0.999 quantile at 77 degrees is 121.1


def test_hypergeometric_law(spark):
    from pyspark.sql import functions as F

    long = lambda n: F.lit(n).cast("long")
    for pool, good, draws in ((50, 20, 30), (10, 3, 9), (5000, 400, 300), (4, 0, 2), (4, 4, 2)):
        x = spark.range(4000).select(sharding.hypergeometric(sharding._uniform(F.col("id"), F.lit(pool)), long(pool), long(good), long(draws)).alias("x")).toPandas()["x"]
        p = good / pool
        sd = (draws * p * (1 - p) * (pool - draws) / max(1, pool - 1)) ** 0.5
        assert abs(x.mean() - draws * p) <= 5 * sd / 4000**0.5 + 1e-9 and abs(x.std() - sd) <= 0.1 * sd + 1e-9
        assert x.min() >= max(0, draws - (pool - good)) and x.max() <= min(good, draws)


def test_media_tables_are_stored_and_sought(spark, documents, tmp_path):
    texts = [None, "", "short", "é" * 5000, "short"]
    table = mpeg.write_media(documents(list(enumerate(texts)), media="x", offsets=1), str(tmp_path / "media"))
    rows = table.collect()
    assert len(rows) == 5 and any(p.name.endswith(".zstd.parquet") for p in (tmp_path / "media").iterdir())
    for r in rows:
        m = mpeg.parse(r.media)
        assert r.offsets == m.offsets and (r.seconds_num, r.seconds_den) == (m.duration.numerator, m.duration.denominator) and mpeg.stored(r.media, m).rstrip(b"\0").decode() == (texts[r.doc_id] or "")
    for second in (0.0, 0.05, 1.0):
        for r in mpeg.seek(table, second).collect():
            n, whole = len(r.offsets), r.seconds_num / r.seconds_den
            assert (r.frame is not None) == (second < whole)
            if r.frame is not None:
                assert r.frame == int(second * n / whole) and r.bytes == r.media[r.offsets[r.frame] :][: len(r.bytes)] and r.bytes[:1] == b"\xff"
                assert r.frame == n - 1 or len(r.bytes) == r.offsets[r.frame + 1] - r.offsets[r.frame]


def test_described_takes_names_of_any_case(spark):
    stream = bytearray(mpeg.store(b"payload".ljust(64, b"\0")))
    df = spark.createDataFrame([(1, "a", stream), (2, "b", None)], "id int, MPEG string, Media binary")
    out = mpeg.described(df, "Media")
    assert out.columns == ["id", "mpeg"] and {r.id: r.mpeg.payload_bytes for r in out.collect()} == {1: 64, 2: None}


def test_variates_far_from_the_mode(spark):
    """A uniform number next to 1 leads past the near values, to the end of the support at
    most; others give the distribution's inverse."""
    from math import comb

    from pyspark.sql import functions as F

    pool, good, drawn = 4000, 1500, 900
    total = comb(pool, drawn)
    p = {k: comb(good, k) * comb(pool - good, drawn - k) / total for k in range(200, 500)}
    us = [(i + 0.5) / 4000 for i in range(4000)] + [1 - 1e-16, 1.0, 1.5]
    df = spark.createDataFrame([(u,) for u in us], "u double")
    of = lambda n: F.lit(n).cast("long")
    got = [r.x for r in df.select(sharding.hypergeometric(F.col("u"), of(pool), of(good), of(drawn)).alias("x")).collect()]
    mean = drawn * good / pool
    assert abs(sum(got[:4000]) / 4000 - mean) < 0.1 and got[-1] == min(good, drawn)
    assert all(0 <= x <= min(good, drawn) for x in got)
    for k in range(325, 350):
        assert abs(sum(x == k for x in got[:4000]) / 4000 - p[k]) < 0.0006


def test_packed_replaces_columns_of_its_own(spark):
    df = spark.createDataFrame([(1, 5, "s", "o", 1), (2, 3, "s", "o", 2)], "id int, length int, SEQUENCE_ID string, offset string, pk_place int")
    out = packing.packed(df, 8, ["id"])
    rows = out.collect()
    assert sorted(out.columns) == ["id", "length", "offset", "sequence_id"] and len({r.sequence_id for r in rows}) == 1 and sorted(r.offset for r in rows) == [0, 5]
