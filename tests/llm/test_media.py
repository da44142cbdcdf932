import hashlib
import random
import zlib

import numpy as np
import pytest

from keyflow.llm import webp
from keyflow.llm.media import ROWS, all_images, all_stored, digests, images, load, payload, samples, store, stored

from .util import clashing, corpus, docs, prose


def test_near_codes():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)


@pytest.mark.parametrize("transforms", [(), (webp.PREDICTOR,), (webp.CROSS,), (webp.GREEN,), (webp.PALETTE,), (webp.PREDICTOR, webp.CROSS, webp.GREEN), (webp.PALETTE, webp.PREDICTOR)])
@pytest.mark.parametrize("cache", [0, 1, 10])
def test_round_trips(transforms, cache):
    rng = np.random.default_rng(1)
    for h, w, k in ((1, 1, 1), (3, 5, 2), (7, 9, 4), (6, 10, 15), (9, 17, 200)):
        pixels = rng.integers(0, 256, (k, 4), dtype=np.uint8)[rng.integers(0, k, (h, w))]
        shape = -(-h >> 2), -(-w >> 2)
        modes = None if webp.PALETTE in transforms else rng.integers(0, 14, shape).astype(np.uint8)
        elements = rng.integers(0, 256, (*shape, 4)).astype(np.uint8)
        for references in (False, True):
            data = webp.encode_with(pixels, transforms, cache, references, modes, elements)
            assert (webp.decode(data) == pixels).all()
        grey = pixels[..., 0]
        even = webp.decode(webp.encode(grey))
        assert (even[..., :3] == grey[..., None]).all() and (even[..., 3] == 255).all()


def test_a_known_file():
    """One opaque pixel, written by hand from the format's description: no transform, no cache, one group, five single symbols."""
    w = webp.Writer()
    webp.header(w, 1, 1, False)
    for value, n in ((0, 1), (0, 1), (0, 1)):
        w.bits(value, n)
    for symbol in (7, 200, 13, 255, 0):
        w.bits(1, 1)
        w.bits(0, 1)
        w.bits(int(symbol > 1), 1)
        w.bits(symbol, 8 if symbol > 1 else 1)
    pixel = webp.decode(webp.container(w.value.to_bytes((w.at + 7) // 8, "little")))
    assert pixel.tolist() == [[[200, 7, 13, 255]]]


def test_broken_files():
    good = webp.encode(np.zeros((2, 192), np.uint8) + np.arange(192, dtype=np.uint8))
    for bad in (b"", good[:11], b"RIFX" + good[4:], good[:20] + b"\x00" + good[21:], good[:-60]):
        with pytest.raises((ValueError, IndexError, webp.struct.error)):
            webp.decode(bad)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 100, 128, 129, 256])
def test_grey_images(colours):
    rng = np.random.default_rng(colours)
    for width in (1, 7, 192):
        grey = rng.choice(256, colours, replace=False).astype(np.uint8)[rng.integers(0, colours, (5, width))]
        assert (webp.decode(webp.encode(grey))[..., 2] == grey).all()


def test_very_long_texts_are_several_images():
    rng = random.Random(1)
    raw = prose(rng, 300_000, 5000).encode() + bytes(range(256)) * 2000
    media = stored(raw)
    parts = [*images(media)]
    rows = -(-len(raw) // 192)
    assert [p.shape[0] for p in parts] == [ROWS] * (rows // ROWS) + [rows % ROWS]
    assert samples(media) == payload(raw)
    assert len(media) < len(raw) / 2


def test_what_texts_use(monkeypatch):
    """Back-references, prefix codes, palette, subtract-green and the predictor come up in texts; files are about as short as deflate's."""
    rng = random.Random(2)
    used = set()
    for name in ("predictor", "subtract_green", "bundle"):
        was = getattr(webp, name)
        monkeypatch.setattr(webp, name, lambda *a, name=name, was=was: (used.add((name, a[-1])), was(*a))[1])
    texts = [prose(rng, 400).encode(), b"abc " * 300, "".join(rng.choice("01") for _ in range(900)).encode()]
    texts.append(b"".join(bytes(rng.randrange(32, 120) for _ in range(8)) + b"-" * 184 for _ in range(30)))
    for raw in texts:
        media = stored(raw)
        assert samples(media) == payload(raw)
        assert len(media) < 1.15 * len(zlib.compress(payload(raw))) + 60
    assert {("predictor", False), ("subtract_green", False)} <= used and any(name == "bundle" for name, _ in used)


def test_references_that_overlap_and_reach_far():
    rng = np.random.default_rng(3)
    block = rng.integers(0, 256, 192 * 30).astype(np.uint8)
    grey = np.concatenate([block, np.full(192 * 50, 7, np.uint8), rng.integers(0, 256, 192 * 60).astype(np.uint8), block]).reshape(-1, 192)
    data = webp.encode(grey)
    assert (webp.decode(data)[..., 0] == grey).all()
    assert len(data) < 192 * 100


@pytest.mark.parametrize("raw", [b"", b"a", b"abc" * 5, b"ab" * 40000, bytes(range(256)) * 3, random.Random(6).randbytes(70000) * 2, prose(random.Random(7), 30000).encode()])
def test_matches_of_zlib(raw):
    at = 0
    for start, n, far in webp.parse(raw).tolist():
        assert start >= at and 0 < far <= start and n > 2
        assert all(raw[start + i] == raw[start + i - far] for i in range(n))
        at = start + n
    assert at <= len(raw)
    if raw[:4] == b"abab":
        assert at > len(raw) - 300


def test_packed_bits():
    rng = random.Random(4)
    sizes = [rng.randrange(64) for _ in range(500)]
    values = [rng.getrandbits(n) if n else 0 for n in sizes]
    want = at = 0
    for v, n in zip(values, sizes, strict=True):
        want |= v << at
        at += n
    assert webp.packed_bits(np.array(values, np.uint64), np.array(sizes)) == want


def plainly(mode, left, top, corner, after):
    """The format's fourteen predictions of one channel list, written out."""
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: [min(255, max(0, x)) for x in v]
    far = lambda a, b: sum(abs(x - y) for x, y in zip(a, b, strict=True))
    return [
        lambda: [0, 0, 0, 255],
        lambda: left,
        lambda: top,
        lambda: after,
        lambda: corner,
        lambda: mean(mean(left, after), top),
        lambda: mean(left, corner),
        lambda: mean(left, top),
        lambda: mean(corner, top),
        lambda: mean(top, after),
        lambda: mean(mean(left, corner), mean(top, after)),
        lambda: left if far(top, corner) < far(left, corner) else top,
        lambda: clamp([x + t - c for x, t, c in zip(left, top, corner, strict=True)]),
        lambda: clamp([m + int((m - c) / 2) for m, c in zip(mean(left, top), corner, strict=True)]),
    ][mode]()


def test_predictor_against_single_pixels():
    rng = np.random.default_rng(5)
    residual = rng.integers(0, 256, (17, 15, 4)).astype(np.uint8)
    modes = (np.arange(20) % 14).reshape(5, 4).astype(np.uint8)
    out = np.zeros(residual.shape, int).tolist()
    for y in range(17):
        for x in range(15):
            if y == 0:
                guess = out[0][x - 1] if x else [0, 0, 0, 255]
            elif x == 0:
                guess = out[y - 1][0]
            else:
                guess = plainly(int(modes[y >> 2, x >> 2]), out[y][x - 1], out[y - 1][x], out[y - 1][x - 1], out[y - 1][x + 1] if x < 14 else out[y][0])
            out[y][x] = [(int(v) + g) % 256 for v, g in zip(residual[y, x], guess, strict=True)]
    got = webp.predictor(residual, modes, 2, False)
    assert got.tolist() == out
    assert (webp.predictor(got, modes, 2, True) == residual).all()


def test_digests(spark):
    rows = corpus(8)
    got = digests(clashing(docs(spark, rows))).collect()
    assert len(got) == len(rows)
    same = {}
    for r, (i, t) in zip(sorted(got, key=lambda r: (str(r.doc_id), r.payload_sha256)), sorted(rows, key=lambda x: (str(x[0]), hashlib.sha256(payload((x[1] or "").encode())).hexdigest())), strict=True):
        raw = (t or "").encode()
        p = payload(raw)
        assert len(p) % 192 == 0 and len(p) > 0 and p.rstrip(b" ") == raw.rstrip(b" ")
        assert (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert same.setdefault(t or "", (r.media_sha256, r.media_bytes, r.feature)) == (r.media_sha256, r.media_bytes, r.feature)
    media = store(docs(spark, rows))
    kept = {r.doc_id: r for r in media.collect() if r.doc_id is not None}
    for r in load(media).collect():
        if r.doc_id is not None:
            assert b"".join(np.frombuffer(x.pixels, np.uint8).reshape(x.height, x.width, 4)[..., 0].tobytes() for x in r.images)[: kept[r.doc_id].n_bytes] == (dict(rows)[r.doc_id] or "").encode()
    assert digests(docs(spark, rows).limit(0)).count() == 0


def test_many_texts_side_by_side():
    """Streams of all lengths, some of which go on alone when the others have ended, are read as each one by itself."""
    rng = np.random.default_rng(8)
    words = [bytes(rng.integers(97, 123, rng.integers(2, 9)).astype(np.uint8)) for _ in range(300)]
    raws = [b" ".join(words[i] for i in rng.integers(0, 300, n)) for n in [*rng.integers(0, 400, 120).tolist(), 4000, 30_000]]
    raws += [b"", b"a" * 5000, b"ab" * 3000, rng.integers(0, 256, 9000).astype(np.uint8).tobytes(), bytes(range(256)) * 40]
    medias = all_stored(raws)
    assert medias == [stored(r) for r in raws]
    for raw, parts in zip(raws, all_images(medias), strict=True):
        assert b"".join(p[..., 0].tobytes() for p in parts) == payload(raw)
    with pytest.raises(ValueError):
        all_images([*medias[:100], medias[100][:20] + medias[100][20:-60] + bytes(60)])


def test_texts_are_written_together(monkeypatch):
    """The tokens, codes and bits of a group's files are found for all of them at once, not text by text."""
    groups = []
    was = webp.write_greens
    monkeypatch.setattr(webp, "write_greens", lambda images: (groups.append(len(images)), was(images))[1])
    raws = [prose(random.Random(i), 30 + i).encode() for i in range(70)]
    medias = all_stored(raws)
    assert groups[0] == len(raws) and len(groups) < 4
    assert [samples(m) for m in medias] == [payload(r) for r in raws]
