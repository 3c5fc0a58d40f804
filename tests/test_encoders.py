"""Encoders: quality floors after a round trip, exact flat blocks, mips and edges."""

import numpy as np
import pytest

from blockloom.functions import blocks, encoders


def gradient(w, h):
    y, x = np.mgrid[:h, :w]
    return np.stack([x * 255 // w, y * 255 // h, np.full_like(x, 40), (200 + x + y) % 256], -1).astype(np.uint8)


def psnr(a, b):
    mse = ((a.astype(float) - b.astype(float)) ** 2).mean()
    return np.inf if mse == 0 else 10 * np.log10(65025 / mse)


@pytest.mark.parametrize(("content", "channels", "floor"), [("bc1", 3, 18), ("bc2", 4, 18), ("bc3", 4, 18), ("bc4u", 1, 28), ("bc5u", 2, 28), ("bc7", 4, 22), ("rgba8", 4, 999), ("bgra8", 4, 999)])
@pytest.mark.parametrize(("w", "h"), [(32, 32), (9, 7), (6, 10)])
def test_round_trip(content, channels, floor, w, h):
    image = gradient(w, h)
    data, error = encoders.encode_surface(content, image.tobytes(), w, h)
    assert error is None
    back, error = blocks.decode_surface(content, data, w, h)
    assert error is None
    back = np.frombuffer(back, np.uint8).reshape(h, w, 4)
    assert psnr(image[:, :, :channels], back[:, :, :channels]) >= floor


def test_flat_blocks_are_exact():
    for v in (0, 1, 127, 254, 255):
        assert (blocks.decode_bc4(encoders.encode_bc4(np.full((1, 16), v)))[0, :, 0] == v).all()
    white = np.full((1, 16, 4), 255, np.uint8)
    assert (blocks.decode_bc1(encoders.encode_bc1(white)) == 255).all()


def test_mips_and_errors():
    assert encoders.halve(gradient(7, 5)).shape == (2, 3, 4) and encoders.halve(gradient(1, 3)).shape == (1, 1, 4)
    odd = np.arange(12, dtype=np.uint8).reshape(1, 3, 4)
    assert encoders.halve(odd).tolist() == [[[2, 3, 4, 5]]]
    assert encoders.encode_surface("bc1", b"", 4, 4) == (None, "TruncatedData")
    assert encoders.encode_surface("bc6h", bytes(64), 4, 4) == (None, "UnsupportedFormat")
    assert encoders.encode_surface("bc1", b"", 0, 4) == (None, "InvalidField")
    data, _ = encoders.encode_surface("bc1", gradient(16, 16).tobytes(), 16, 16, mips=5)
    assert len(data) == 128 + 32 + 8 + 8 + 8


def test_bc6h():
    from blockloom.functions import hdr

    y, x = np.mgrid[:32, :32]
    image = np.stack([2.0 ** (x / 32 * 14 - 7), 2.0 ** (y / 32 * 14 - 7), 2.0 ** ((x + y) / 64 * 14 - 7), np.ones((32, 32))], -1).astype(np.float32)
    px = image.reshape(8, 4, 8, 4, 4).swapaxes(1, 2).reshape(-1, 16, 4)
    back, own = blocks.decode_bc6h_single(hdr.encode_bc6h(px))
    assert own.all() and hdr.log_psnr(px[:, :, :3], back[:, :, :3]) > 40
    flat = np.full((1, 16, 4), 3.7, np.float32)
    assert abs(blocks.decode_bc6h_single(hdr.encode_bc6h(flat))[0][0, 0, 0] / 3.7 - 1) < 0.02
    assert hdr.to_half(np.array([-5.0, np.nan, 1e30, np.inf, 1.0, 2.0**-24, 2.0**-26])).tolist() == [0, 0, 0x7BFF, 0x7BFF, 0x3C00, 1, 0]
    every = np.arange(0x7C00)
    assert (hdr.to_half(blocks.half_to_float(every)) == every).all()


def test_images_are_encoded_together():
    """Many images in one call give the bytes of each by itself, flat ones too."""
    import numpy as np

    from blockloom.functions import encoders

    rng = np.random.default_rng(3)
    images = np.concatenate([rng.integers(0, 256, (5, 6, 10, 4)), np.full((1, 6, 10, 4), 90), rng.integers(70, 73, (2, 6, 10, 4))]).astype(np.uint8)
    for name in [*encoders.ENCODERS, "rgba8", "bgra8"]:
        assert encoders.encode_many(name, images) == [encoders.encode_blocks(name, x) for x in images], name
