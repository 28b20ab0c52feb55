import struct
import zlib

import numpy as np
import pytest

from figmill.operators import consensus as C
from figmill.operators import kernels as K
from figmill.operators import pixels as P


@pytest.mark.parametrize("samples", [1, 2, 3, 4])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
def test_round_trip(samples, kind):
    a = np.random.default_rng(1).integers(0, np.iinfo(kind).max + 1, (13, 17, samples)).astype(kind)
    assert (P.read_png(P.write_png(a)) == a).all()
    assert P.as_rgb(a).shape == (13, 17, 3) and (P.as_bgr(a)[..., 0] == P.as_rgb(a)[..., 2]).all()


def filtered(a, kind):
    h, w, s = a.shape
    flat = a.reshape(h, -1).astype(int)
    out = b""
    for y in range(h):
        line = []
        for x in range(w * s):
            l, u, c = (flat[y, x - s] if x >= s else 0), (flat[y - 1, x] if y else 0), (flat[y - 1, x - s] if y and x >= s else 0)
            p = l + u - c
            paeth = l if abs(p - l) <= abs(p - u) and abs(p - l) <= abs(p - c) else u if abs(p - u) <= abs(p - c) else c
            line.append((flat[y, x] - [0, l, u, (l + u) // 2, paeth][kind]) % 256)
        out += bytes([kind, *line])
    return out


def png(w, h, depth, colour, raw, interlaced=0, extra=b""):
    chunk = lambda k, c: struct.pack(">I", len(c)) + k + c + struct.pack(">I", zlib.crc32(k + c))
    return P._SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced)) + extra + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_filters(kind):
    a = np.random.default_rng(kind).integers(0, 256, (9, 11, 3)).astype(np.uint8)
    assert (P.read_png(png(11, 9, 8, 2, filtered(a, kind))) == a).all()


def test_small_depths_palette_and_passes():
    bits = np.random.default_rng(3).integers(0, 2, (5, 13)).astype(np.uint8)
    raw = b"".join(b"\0" + np.packbits(r).tobytes() for r in bits)
    assert (P.read_png(png(13, 5, 1, 0, raw))[..., 0] == bits * 255).all()
    pal = np.array([[1, 2, 3], [9, 8, 7]], np.uint8)
    chunk = struct.pack(">I", 6) + b"PLTE" + pal.tobytes() + struct.pack(">I", zlib.crc32(b"PLTE" + pal.tobytes()))
    assert (P.read_png(png(13, 5, 1, 3, raw, extra=chunk)) == pal[bits]).all()
    a = np.random.default_rng(4).integers(0, 256, (10, 9, 3)).astype(np.uint8)
    raw = b"".join(filtered(a[y::dy, x::dx], 4) for x, y, dx, dy in P._PASSES if a[y::dy, x::dx].size)
    assert (P.read_png(png(9, 10, 8, 2, raw, interlaced=1)) == a).all()


def test_masks_and_broken_files(spark):
    m = np.eye(6, dtype=np.uint8)
    assert P.read_png(P.mask_png(m)).max() == 255 and P.read_png(P.mask_png(m.astype(np.uint16) * 700)).max() == 700
    df = spark.createDataFrame([("a", P.write_png(m)), ("b", b"no"), ("c", P.write_png(m)[:40]), ("d", None)], "path string, content binary")
    got = {r["path"]: r for r in P.decoded(df).collect()}
    assert got["a"]["height"] == 6 and len(got["a"]["pixels"]) == 108 and all(got[k]["error"] and got[k]["pixels"] is None for k in "bcd")


@pytest.mark.parametrize("model", ["affine", "homography"])
def test_agreeing(model):
    rng = np.random.default_rng(5)
    p = rng.random((80, 2)) * 400
    m = np.array([[0.9, 0.1, 30], [-0.2, 1.1, 5], [0, 0, 1]])
    if model == "homography":
        m[2, :2] = 2e-4, -1e-4
    q = C.moved(p, m)
    assert np.allclose(C.fit_transform(p, q, model), m, atol=1e-6)
    q[::3] += rng.random((27, 2)) * 200 + 50
    assert C.agreeing(p, q, model).tolist() == [i for i in range(80) if i % 3]
    assert len(C.agreeing(p[:3], q[:3], model, least=4)) == 0 and len(C.agreeing(np.zeros((9, 2)), q[:9], model)) == 0


def test_clusters():
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.normal(c, 3, (20, 2)) for c in ((20, 20), (150, 30), (80, 160))])
    assert C.cluster_points(p, 200, 200) == [list(range(20)), list(range(20, 40)), list(range(40, 60))]
    assert C.cluster_points(p[:1], 9, 9) == [[0]] and C.cluster_points(p[:0], 9, 9) == []
    assert len(C.cluster_points(p[:4], 1, 1)) == 4


def test_match_without_a_plug_in():
    rng = np.random.default_rng(7)
    d, p = rng.random((30, 16)), rng.random((30, 2)) * 90
    a = {"points": p, "descriptors": d, "shape": (100, 100)}
    b = {"points": p + 4, "descriptors": d + 1e-4, "shape": (100, 100)}
    got = K.match_features(a, b)
    assert got["is_match"] and got["matched_keypoints"] == 30 and K.match_masks(got, (100, 100), (100, 100))[0].mean() > 0.5


def test_pixels_come_in_bounded_batches():
    import pandas as pd

    files = pd.DataFrame({"path": [str(i) for i in range(500)], "content": [P.write_png(np.zeros((128, 150), bool))] * 499 + [b"no file"]})
    got = list(P.frames(iter([files]), "path", "content", P.as_rgb))
    assert [p for f in got for p in f["path"]] == files["path"].tolist() and got[-1]["error"].iloc[-1]
    assert max(sum(len(x) for x in f["pixels"] if x is not None) for f in got) < P.BATCH_BYTES + 128 * 150 * 3
