import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from tidemark.llm import queries, tiff

RNG = np.random.default_rng(0)


@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [tiff.NO_PREDICTOR, tiff.HORIZONTAL])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("dtype", ["u1", "u2"])
def test_pages_come_back(how, predictor, tile, order, dtype):
    images = [RNG.integers(0, 9, (37, 65), dtype), RNG.integers(0, 255, (20, 16, 3), dtype), np.zeros((1, 1), dtype)]
    got = list(tiff.pages(tiff.write(images, how, predictor, rows_per_strip=10, tile=tile, order=order)))
    assert [(p["height"], p["width"]) for p in got] == [x.shape[:2] for x in images]
    assert [p["raster"] for p in got] == [x.astype(f"<{dtype}").tobytes() for x in images]
    assert {p["layout"] for p in got} == {"tiles" if tile else "strips"}


@pytest.mark.parametrize("pack, unpack", [(tiff.pack_bits, tiff.unpack_bits), (tiff.pack_lzw, tiff.unpack_lzw)])
def test_codecs(pack, unpack):
    rng = random.Random(1)
    for n in (0, 1, 2, 127, 128, 129, 300, 5000, 40_000):
        for letters in (1, 2, 200):
            data = bytes(rng.randrange(letters) for _ in range(n))
            assert unpack(pack(data), n) == data and len(unpack(pack(data), n // 2)) <= n // 2 + 4096


def test_known_streams():
    # the worked examples of the two codecs' descriptions
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.unpack_lzw(bytes.fromhex("80 01 E0 40 80 44 08 0C 06 80 80".replace(" ", "")), 9) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_floating_predictor():
    values = RNG.normal(size=(4, 6)).astype("<f4")
    rows = values.astype(">f4").view(np.uint8).reshape(4, 6, 4).transpose(0, 2, 1).reshape(4, -1)
    raw = zlib.compress(np.concatenate((rows[:, :1], np.diff(rows, axis=1)), axis=1).astype(np.uint8).tobytes())
    tags = [(256, 4, 6), (257, 4, 4), (258, 3, 32), (259, 3, 8), (273, 4, 8), (277, 3, 1), (278, 4, 4), (279, 4, len(raw)), (317, 3, 3), (339, 3, 3)]
    at = 8 + len(raw)
    data = struct.pack("<2sHI", b"II", 42, at) + raw + struct.pack("<H", len(tags))
    data += b"".join(struct.pack("<HHII", t, k, 1, v) for t, k, v in tags) + struct.pack("<I", 0)
    assert next(tiff.pages(data))["raster"] == values.tobytes()


def test_rows_and_faults(spark):
    two = tiff.write([RNG.integers(0, 255, (5, 7), "u1")] * 2)
    rows = [(1, two), (2, None), (3, b""), (4, b"II*\0\xff\xff\xff\x7f"), (None, two), (5, two[:-30]), (1, two), (6, tiff.write([tiff.payload(b"x" * 300_000)]))]
    df = spark.createDataFrame(rows, "id long, media binary")
    got = tiff.decode_pages(df).collect()
    pages = sorted((r.id or 0, r.page) for r in got if not r.error)
    assert pages == sorted([(0, 0), (0, 1), (1, 0), (1, 0), (1, 1), (1, 1), (5, 0), (6, 0)])
    assert sorted(r.id for r in got if r.error) == [3, 4, 5]
    assert tiff.decode_pages(df.limit(0)).collect() == []


def test_texts(spark):
    texts = [(1, ""), (2, None), (3, "a" * 64), (4, "é" * 100), (5, "long text " * 100_000), (5, "long text " * 100_000)]
    df = spark.createDataFrame([(*t, "other") for t in texts], "doc_id long, text string, media string")
    got = tiff.decode_pages(tiff.encode_texts(df, predictor=tiff.HORIZONTAL), keep=("id", "n_bytes")).collect()
    assert len(got) == len(texts)
    want = {i: (t or "").encode() for i, t in texts}
    for r in got:
        assert r.n_bytes == len(want[r.id]) and bytes(r.raster)[: r.n_bytes] == want[r.id]
        assert len(r.raster) == max(64, -(-r.n_bytes // 64) * 64) and not any(bytes(r.raster)[r.n_bytes :])


def file(tags, raw=b"", order="<", more=0):
    """One directory of (tag, kind, value) after `raw`, which starts at 8; `more` is where the next is."""
    data = struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 8 + len(raw)) + raw + struct.pack(order + "H", len(tags))
    return data + b"".join(struct.pack(order + "HHI", t, k, 1) + struct.pack(order + {3: "HH", 4: "I"}[k], *([v, 0] if k == 3 else [v])) for t, k, v in tags) + struct.pack(order + "I", more)


def tags(width=4, height=4, bits=8, how=1, size=16, samples=1, rows=4, **more):
    own = {256: (4, width), 257: (4, height), 258: (3, bits), 259: (3, how), 273: (4, 8), 277: (3, samples), 278: (4, rows), 279: (4, size)}
    own |= {int(k[1:]): v for k, v in more.items()}
    return [(t, *v) for t, v in sorted(own.items()) if v]


@pytest.mark.parametrize("bits", [1, 2, 4])
@pytest.mark.parametrize("predictor", [1, 2])
def test_samples_below_a_byte(bits, predictor):
    values = RNG.integers(0, 1 << bits, (5, 11))
    stored = values if predictor == 1 else np.concatenate((values[:, :1], np.diff(values, axis=1)), axis=1) % (1 << bits)
    rows = ["".join(f"{v:0{bits}b}" for v in row) for row in stored]
    raw = tiff.pack_bits(b"".join(int(r.ljust(-(-len(r) // 8) * 8, "0"), 2).to_bytes(-(-len(r) // 8), "big") for r in rows))
    own = tags(11, 5, bits, tiff.PACKBITS, len(raw), rows=5, t317=(3, predictor), **({"t258": None} if bits == 1 else {}))
    page = next(tiff.pages(file(own, raw)))
    assert page["bits"] == bits and page["raster"] == values.astype("u1").tobytes()


HOSTILE = {
    "width x height": tags(2**31 - 1, 2**31 - 1), "no samples, planes": tags(samples=0, t284=(3, 2)), "tile of no height": tags(t322=(4, 16), t323=(4, 0), t324=(4, 8), t325=(4, 16)),
    "floats of a byte": tags(t339=(3, 3)), "floating predictor of integers": tags(how=8, t317=(3, 3)), "no width": tags(width=0), "strips of no rows": tags(rows=0),
    "part beyond the end": tags(t273=(4, 4_000_000_000)), "too few bytes": tags(size=3), "three bits": tags(bits=3), "unknown codec": tags(how=7), "bad deflate": tags(how=8),
    "bad LZW": tags(how=5, size=2), "bomb": tags(60_000, 30_000, how=8, rows=30_000), "no strips": tags(t273=None), "least bits first": tags(t266=(3, 2)),
}


@pytest.mark.parametrize("name", HOSTILE)
def test_hostile_pages_are_errors(name):
    data = file(HOSTILE[name], b"\xff" * 16)
    got = list(tiff.pages(data))
    assert len(got) == 1 and got[0]["error"]


def test_random_damage_is_never_anything_else():
    rng = random.Random(4)
    whole = [tiff.write([RNG.integers(0, 255, (9, 17), "u1")] * 2, how, tile=t) for how in (1, 5, 8, 32773) for t in (None, (16, 16))]
    for _ in range(3000):
        data = bytearray(rng.choice(whole))
        for _ in range(rng.randint(1, 6)):
            data[rng.randrange(2, len(data))] = rng.randrange(256)
        try:
            assert all("raster" in p or p["error"] for p in tiff.pages(bytes(data[: rng.randint(len(data) // 2, len(data))])))
        except tiff.Malformed:
            pass


def test_pages_after_a_fault_are_read(spark):
    good = tiff.write([RNG.integers(0, 255, (5, 7), "u1")])
    bad = tags(bits=3)
    first = file(bad, b"\0" * 16)
    at = len(first) - 4
    data = bytearray(first)
    tail = file(tags(), b"\7" * 16)
    struct.pack_into("<I", data, at, len(first) + 24)  # the next directory stands behind, its strip at 8
    data += tail
    got = tiff.decode_pages(spark.createDataFrame([(1, bytes(data)), (2, good)], "id long, media binary")).orderBy("id", "page").collect()
    assert [(r.id, r.page, bool(r.error)) for r in got] == [(1, 0, True), (1, 1, False), (2, 0, False)]


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([None, "", "a", "é" * 64, "x" * 64, "word " * 700, "word " * 700])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op4_tiff_pages(spark, str(tmp_path)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        whole = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    assert got[5][1:] == got[6][1:] and got[0][1:] == got[1][1:] and len(got) == 7
