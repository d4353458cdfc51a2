"""Media bytes: round trips, every PNG filter, delays, boxes, and what is damaged."""

import hashlib
import struct
import zlib

import numpy as np
import pytest

from tallyframe.functions import media as M
from tallyframe.sources import media as S


def filtered_png(pixels, kinds):
    """The same pixels with a filter of each line, made by the definition."""
    h, w, n = pixels.shape
    raw, above = b"", np.zeros(w * n, int)
    for y in range(h):
        x = pixels[y].ravel().astype(int)
        left, corner = np.concatenate([np.zeros(n, int), x[:-n]]), np.concatenate([np.zeros(n, int), above[:-n]])
        pa, pb, pc = abs(above - corner), abs(left - corner), abs(left + above - 2 * corner)
        paeth = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, above, corner))
        near = [0 * x, left, above, (left + above) // 2, paeth][kinds[y]]
        raw += bytes([kinds[y]]) + ((x - near) % 256).astype(np.uint8).tobytes()
        above = x
    chunk = lambda k, b: len(b).to_bytes(4, "big") + k + b + zlib.crc32(k + b).to_bytes(4, "big")
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[n]
    z = zlib.compress(raw)
    return M._PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"x") + chunk(b"IDAT", z[:5]) + chunk(b"IDAT", z[5:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_png_filters_and_colours(n):
    rng = np.random.default_rng(n)
    x = rng.integers(0, 256, (10, 7, n), dtype=np.uint8)
    got = M.decode_png(filtered_png(x, [0, 1, 2, 3, 4, 4, 3, 1, 2, 0]))
    assert np.array_equal(got, np.repeat(x[..., :1], 3, 2) if n < 3 else x[..., :3])


def test_png_round_trip_and_damage():
    x = np.random.default_rng(0).integers(0, 256, (5, 6, 3), dtype=np.uint8)
    png = M.encode_png(x)
    assert np.array_equal(M.decode_png(png), x) and np.array_equal(M.decode_png(M.encode_png(x[..., 0]))[..., 2], x[..., 0])
    for k in range(0, len(png), 3):
        bad = bytearray(png)
        bad[k] ^= 0x41
        with pytest.raises(ValueError):
            M.decode_png(bytes(bad))
        with pytest.raises(ValueError):
            M.decode_png(png[:k])


def test_gif_delays():
    p = M.probe_gif(M.encode_gif(20, 10, [5, 7, 8]))
    assert (p["width"], p["height"], p["frame_count"], p["fps_source"]) == (20, 10, 3, "container") and p["duration_s"] == pytest.approx(0.2) and p["fps"] == pytest.approx(15)
    for delays in ([None] * 48, [5, None, 5], [0, 3]):
        p = M.probe_gif(M.encode_gif(3, 3, delays))
        assert p["fps"] == pytest.approx(10) and p["duration_s"] == pytest.approx(0.1 * len(delays)) and p["fps_source"] == "gif_default_delay"
    gif = M.encode_gif(30, 30, [4, 4])
    for cut in (0, 5, 12, 40, len(gif) - 1):
        with pytest.raises(ValueError):
            M.probe_gif(gif[:cut])
    with pytest.raises(ValueError, match="no frames"):
        M.probe_gif(M.encode_gif(3, 3, []))


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I", 8 + len(body)) + kind + body


def mp4(scale=600, times=((29, 20), (1, 40)), kind=b"vide", version=0):
    head = struct.pack(">B3s", version, b"") + (struct.pack(">QQIQ", 0, 0, scale, 9) if version else struct.pack(">IIII", 0, 0, scale, 9)) + bytes(4)
    stts = bytes(4) + struct.pack(">I", len(times)) + b"".join(struct.pack(">II", *t) for t in times)
    track = box(b"trak", box(b"tkhd", bytes(76), struct.pack(">II", 320 << 16, 240 << 16)), box(b"mdia", box(b"mdhd", head), box(b"hdlr", bytes(8), kind, bytes(12)), box(b"minf", box(b"stbl", box(b"stts", stts)))))
    sound = box(b"trak", box(b"tkhd", bytes(84)), box(b"mdia", box(b"hdlr", bytes(8), b"soun", bytes(12))))
    return box(b"ftyp", b"isom") + box(b"mdat", bytes(50)) + box(b"moov", box(b"mvhd", bytes(100)), sound, track)


@pytest.mark.parametrize("version", [0, 1])
def test_mp4_boxes(version):
    p = M.probe_mp4(mp4(version=version))
    assert (p["width"], p["height"], p["frame_count"]) == (320, 240, 30) and p["duration_s"] == pytest.approx(620 / 600) and p["fps"] == pytest.approx(30 * 600 / 620)
    for bad in (mp4(kind=b"soun"), mp4(scale=0), mp4()[:-9], box(b"ftyp", b"isom")):
        with pytest.raises(ValueError):
            M.probe_mp4(bad)


def test_probes_of_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.gif").write_bytes(M.encode_gif(4, 4, [10]))
    (tmp_path / "y.MP4").write_bytes(mp4())
    got = {r.path.rsplit("/", 1)[1]: r for r in S.probe_media(spark, str(tmp_path)).collect()}
    assert got["x.gif"].fps == pytest.approx(10) and got["y.MP4"].frame_count == 30
    (tmp_path / "z.avi").write_bytes(b"RIFF")
    with pytest.raises(Exception, match="no probe for .avi"):
        S.probe_media(spark, str(tmp_path)).collect()


def test_sequences_are_verified(spark, tmp_path):
    rng = np.random.default_rng(1)
    frames = {(c, i): rng.integers(0, 256, (4, 5, 3), dtype=np.uint8) for c in "ab" for i in range(3)}
    files = spark.createDataFrame([(f"{c}/{i:06d}.png", bytearray(M.encode_png(x))) for (c, i), x in frames.items()], "path string, content binary").repartition(3)
    written = S.write_files(files, str(tmp_path / "root")).collect()
    assert {r.path: r.sha256 for r in written} == {f"{c}/{i:06d}.png": hashlib.sha256(M.encode_png(x)).hexdigest() for (c, i), x in frames.items()}
    index = spark.createDataFrame([(r.path[0], int(r.path[2:8]), r.path, r.sha256) for r in written], "sequence string, place int, path string, sha256 string")
    read = lambda ix: S.read_png_sequences(spark, str(tmp_path / "root"), ix)
    got = read(index).collect()
    assert len(got) == 6 and all(np.array_equal(np.frombuffer(r.pixels, np.uint8).reshape(r.height, r.width, 3), frames[r.sequence, r.place]) for r in got)
    for bad, match in ((index.filter("place <> 1"), "gaps"), (index.unionByName(index), "gaps"), (index.withColumn("path", index.path.substr(1, 6)), "not there"), (index.selectExpr("sequence", "place", "concat('../root/', path) path", "sha256"), "escapes")):
        with pytest.raises(Exception, match=match):
            read(bad).collect()
    (tmp_path / "root" / "a" / "000001.png").write_bytes(b"not the registered pixels")
    with pytest.raises(Exception, match="artifact hash mismatch: a/000001.png"):
        read(index).collect()
    fake = index.filter("place = 1 and sequence = 'a'").selectExpr("sequence", "0 AS place", "path", f"'{hashlib.sha256(b'not the registered pixels').hexdigest()}' AS sha256")
    with pytest.raises(Exception, match="no PNG signature"):
        read(fake).collect()


def test_archives_of_arrays(spark, tmp_path):
    arrays = {"mask": np.arange(6).reshape(2, 3) % 2 == 0, "flow": np.linspace(0, 1, 8).reshape(2, 2, 2)}
    data = M.encode_npz(arrays)
    assert data == M.encode_npz(dict(reversed(arrays.items())))
    (tmp_path / "x.npz").write_bytes(data)
    index = lambda b: spark.createDataFrame([("x.npz", hashlib.sha256(b).hexdigest())], "path string, sha256 string")
    got = S.read_npz_arrays(spark, str(tmp_path), index(data)).collect()
    assert [(r.member, r.place) for r in got] == [("flow", 0), ("mask", 1)]
    assert all(np.array_equal(np.frombuffer(r.data, r.dtype).reshape(r["shape"]), arrays[r.member]) for r in got)
    (tmp_path / "x.npz").write_bytes(data[:-30])
    with pytest.raises(Exception, match="hash mismatch"):
        S.read_npz_arrays(spark, str(tmp_path), index(data)).collect()
    with pytest.raises(Exception, match="damaged"):
        S.read_npz_arrays(spark, str(tmp_path), index(data[:-30])).collect()


def test_indexed_files_are_opened_by_the_tasks(spark, tmp_path):
    """No folder is listed: the plan has no scan of files, a folder holds a hundred parts, and all tasks work."""
    spark.range(250).selectExpr("id AS p_partkey", "cast(id % 50 AS int) AS p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    from tallyframe.plans.media import media_probe

    got = media_probe(spark, str(tmp_path))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "binaryfile" not in plan.lower() and got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.id: (r.width, r.frames) for r in got.collect()} == {i: (8 + i % 5, 1 + i % 50 % 4) for i in range(250)}


def test_long_files_are_batches_of_their_own(spark, tmp_path):
    sizes = {"a/0": 5, "b/1": S.BATCH_BYTES + 1, "b/2": 7, "b/3": S.BATCH_BYTES, "c/4": 0}
    for name, n in sizes.items():
        (tmp_path / name[0]).mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode()[-1:] * n)
    index = spark.createDataFrame([(p, hashlib.sha256(p.encode()[-1:] * n).hexdigest(), n) for p, n in sizes.items()], "path string, sha256 string, n long").coalesce(1)
    got = S.verified_files(spark, str(tmp_path), index).selectExpr("path", "n", "octet_length(content) AS held", "decode(substr(content, 1, 1), 'utf-8') AS first").collect()
    assert {r.path: (r.n, r.held, r.first) for r in got} == {p: (n, n, p[-1] if n else "") for p, n in sizes.items()}
