import hashlib
import zlib

import numpy as np
import pytest

from factloom.llm import media as M

FIELDS = "doc_id long, text string, lang string, source string, n_chars long"
TEXTS = ["", None, "a", "x" * 191, "x" * 192, "x" * 193, "größe 日本 \U0001f600\n" * 700, "plain words " * 9000]


def decoded(png):
    """A PNG decoder by the standard's text, a byte at a time."""
    assert png[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, found = 8, {}
    while at < len(png):
        n, kind = int.from_bytes(png[at : at + 4]), png[at + 4 : at + 8]
        body = png[at + 8 : at + 8 + n]
        assert zlib.crc32(kind + body) == int.from_bytes(png[at + 8 + n : at + 12 + n])
        found[kind] = found.get(kind, b"") + body
        at += 12 + n
    assert list(found) == [b"IHDR", b"IDAT", b"IEND"]
    width, height = int.from_bytes(found[b"IHDR"][:4]), int.from_bytes(found[b"IHDR"][4:8])
    assert found[b"IHDR"][8:] == bytes([8, 2, 0, 0, 0])
    raw, size, rows, kinds = zlib.decompress(found[b"IDAT"]), 3 * width, [], []
    assert len(raw) == height * (size + 1)
    for k in range(height):
        kind, line, row = raw[k * (size + 1)], raw[k * (size + 1) + 1 : (k + 1) * (size + 1)], bytearray()
        up = rows[-1] if rows else bytes(size)
        for i, x in enumerate(line):
            a, b, c = (row[i - 3] if i > 2 else 0), up[i], (up[i - 3] if i > 2 else 0)
            p = a + b - c
            near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            row.append((x + [0, a, b, (a + b) // 2, near][kind]) % 256)
        rows.append(bytes(row))
        kinds.append(kind)
    return b"".join(rows), kinds


def payloads():
    rng = np.random.default_rng(3)
    out = [M.padded((t or "").encode()) for t in TEXTS]
    out += [rng.integers(0, 256, n * M.ROW, dtype=np.uint8).tobytes() for n in (1, 2, 17, 90)]
    smooth = np.cumsum(np.cumsum(rng.integers(-2, 3, (70, 64, 3)), axis=0), axis=1)
    return [*out, smooth.astype(np.uint8).tobytes(), bytes(range(192)) * 9, bytes(192), *out[:3]]


@pytest.mark.parametrize("kind", [None, 0, 1, 2, 3, 4])
def test_round_trip_under_every_filter(kind):
    made = M.to_png(payloads(), kind)
    assert M.from_png(made) == payloads()
    for png, payload in zip(made, payloads()):
        # alone as beside others, and for another decoder
        assert M.to_png([payload], kind) == [png] and M.from_png([png]) == [payload]
        found, kinds = decoded(png)
        assert found == payload and (kind is None or set(kinds) == {kind})


def test_rows_choose_their_filters():
    used = set()
    for png, payload in zip(M.to_png(payloads()), payloads()):
        rows, kinds = [payload[k : k + 192] for k in range(0, len(payload), 192)], decoded(png)[1]
        used |= set(kinds)
        # the least sum of absolute differences, by bytes
        for k in range(0, len(rows), 7):
            up, sums = rows[k - 1] if k else bytes(192), []
            for kind in range(5):
                total = 0
                for i, x in enumerate(rows[k]):
                    a, b, c = (rows[k][i - 3] if i > 2 else 0), up[i], (up[i - 3] if i > 2 else 0)
                    p = a + b - c
                    near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
                    d = (x - [0, a, b, (a + b) // 2, near][kind]) % 256
                    total += min(d, 256 - d)
                sums.append(total)
            assert kinds[k] == sums.index(min(sums))
    assert used == {0, 1, 2, 3, 4}


def test_stacks_of_many_pictures():
    rng = np.random.default_rng(5)
    many = [rng.integers(0, 256, int(n) * M.ROW, dtype=np.uint8).tobytes() for n in rng.integers(1, 40, 150)]
    assert M.from_png(M.to_png(many)) == many


def test_every_damage_is_found():
    (data,) = M.to_png([M.padded(b"some text " * 50)])
    for at in range(len(data)):
        broken = bytearray(data)
        broken[at] ^= 0x21
        with pytest.raises(M.DamagedMedia):
            M.from_png([bytes(broken)])
    for n in range(len(data)):
        with pytest.raises(M.DamagedMedia):
            M.from_png([data[:n]])


def test_hash_is_near_for_pictures_that_are_near():
    rng = np.random.default_rng(2)
    smooth = np.cumsum(np.cumsum(rng.normal(size=(96, 64, 3)), axis=0), axis=1)
    smooth = ((smooth - smooth.min()) / np.ptp(smooth) * 250).astype(np.uint8)
    noisy = np.clip(smooth + rng.integers(-2, 3, smooth.shape), 0, 255).astype(np.uint8)
    other = smooth[::-1, ::-1].copy()
    bits = lambda x: int(M.cosine_hash(x.tobytes()), 16)
    assert (bits(smooth) ^ bits(noisy)).bit_count() < 6 < (bits(smooth) ^ bits(other)).bit_count()
    # the direct definition of the transform, on a picture of 32 rows
    x = rng.integers(0, 256, (32, 64, 3), dtype=np.uint8)
    small = x.sum(axis=2).reshape(32, 32, 2).sum(axis=2)
    n = np.arange(32)
    want = np.array([[(small * np.outer(np.cos(np.pi * u * (2 * n + 1) / 64), np.cos(np.pi * v * (2 * n + 1) / 64))).sum() for v in range(8)] for u in range(8)]).ravel()
    assert bits(x) == int("".join("1" if b else "0" for b in want > np.median(want[1:])), 2)


def test_digest(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(TEXTS)] + [(2, "a", "", "", 0), (None, "a", "", "", 0)]
    df = spark.createDataFrame(rows, FIELDS).withColumnRenamed("lang", "media").withColumnRenamed("source", "payload")
    got = M.digest(M.read_back(M.stored(df))).collect()
    assert len(got) == len(rows)
    for r in got:
        raw = next((t or "") for i, t, *_ in rows if i == r.doc_id).encode()
        payload = raw + b" " * (-len(raw) % 192 if raw else 192)
        (png,) = M.to_png([payload])
        assert decoded(png)[0] == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(png), hashlib.sha256(png).hexdigest(), M.cosine_hash(payload))
    assert M.digest(M.read_back(M.stored(df.limit(0)))).collect() == []
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"no")), (3, bytearray(M.to_png([b"y" * 192])[0]))], "doc_id long, media binary")
    assert [r.payload and bytes(r.payload) for r in M.read_back(broken, strict=False).orderBy("doc_id").collect()] == [None, None, b"y" * 192]
