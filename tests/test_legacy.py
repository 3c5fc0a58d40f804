"""Legacy formats and container sizes against values written by hand."""

import pytest

from blockloom.functions import legacy


def test_masks_by_hand():
    rows = {r["name"]: r for r in legacy.rows()}
    assert len(rows) == 37
    of = lambda n: tuple(rows[n][f"{c}_mask"] for c in "rgba")
    assert of("A8B8G8R8") == (0xFF, 0xFF00, 0xFF0000, 0xFF000000)
    assert of("A2B10G10R10") == (0x3FF, 0xFFC00, 0x3FF00000, 0xC0000000)
    assert of("A2R10G10B10") == (0x3FF00000, 0xFFC00, 0x3FF, 0xC0000000)
    assert of("G16R16") == (0xFFFF, 0xFFFF0000, None, None)
    assert of("A1R5G5B5") == (0x7C00, 0x3E0, 0x1F, 0x8000) and of("X1R5G5B5") == (0x7C00, 0x3E0, 0x1F, None)
    assert of("R5G6B5") == (0xF800, 0x7E0, 0x1F, None) and of("A8R3G3B2") == (0xE0, 0x1C, 0x3, 0xFF00)
    assert of("A8L8") == (0xFF, None, None, 0xFF00) and of("L16") == (0xFFFF, None, None, None) and of("A4L4") == (0xF, None, None, 0xF0) and of("A8") == (None, None, None, 0xFF)
    assert of("R16F") == of("DXT1") == (None,) * 4
    bits = {"R8G8B8": 24, "A8L8": 16, "L8": 8, "A16B16G16R16": 64, "Q16W16V16U16": 64, "R16F": 16, "A32B32G32R32F": 128, "R8G8_B8G8": 32, "UYVY": 16, "CXV8U8": 16, "DXT1": None, "X4R4G4B4": 16}
    assert {n: rows[n]["bits_per_pixel"] for n in bits} == bits
    assert rows["DXT1"]["fourcc"] == 0x31545844 and rows["R8G8_B8G8"]["fourcc"] == 0x47424752 and rows["A32B32G32R32F"]["fourcc"] == 116
    assert (rows["DXT1"]["block_bytes"], rows["DXT4"]["block_bytes"], rows["R16F"]["block_bytes"]) == (8, 16, None)


@pytest.mark.parametrize(
    ("name", "needs"),
    [("R32G32B32_Float", True), ("R16G16B16A16_UNorm", True), ("X32_Typeless_G8X24_UInt", True), ("R10G10B10A2_Typeless", True), ("R10G10B10A2_UNorm", False), ("R11G11B10_Float", True), ("R8G8B8A8_UNorm_sRGB", True), ("R8G8B8A8_UNorm", False), ("R16G16_UNorm", False), ("D24_UNorm_S8_UInt", False), ("R24_UNorm_X8_Typeless", True),
     ("X24_Typeless_G8_UInt", False), ("D16_UNorm", False), ("R16_Float", True), ("R8_UNorm", False), ("A8_UNorm", False), ("R9G9B9E5_SharedExp", True), ("R8G8_B8G8_UNorm", False), ("BC1_UNorm_sRGB", False), ("BC7_Typeless", False), ("B5G6R5_UNorm", False), ("B8G8R8A8_UNorm", False), ("B8G8R8X8_Typeless", True), ("R10G10B10_XR_Bias_A2_UNorm", True),
     ("AYUV", True), ("NV12", True), ("Format_420_Opaque", True), ("A8P8", True), ("B4G4R4A4_UNorm", False), ("P208", True), ("V408", True), ("Unknown", False), ("R32_Float_X8X24_Typeless", True), ("R1_UNorm", False)],
)
def test_requires_extension(name, needs):
    assert legacy.requires_extension(name) is needs


def test_sizes_by_hand(spark):
    from blockloom.operators import containers

    ddl = "width long, height long, depth long, pitch long, linear_size long, mip_map_count long, rgb_bit_count long, array_size long, is_cube boolean, dx10 boolean, bits long, block long, packed boolean"
    rows = [
        (5, 7, None, None, None, 3, None, None, False, False, None, 8, False),  # two blocks by two, then two least levels
        (3, 2, None, None, None, None, 32, 4, False, True, 32, None, False),
        (3, 2, 4, None, None, None, None, None, True, False, 32, None, True),  # packed pairs
        (0xFFFFFFFF, 1, None, 12, None, None, None, None, False, False, 32, None, False),  # too wide: the header's pitch
        (10, 10, None, None, None, None, None, None, False, False, None, None, None),
        (10, 10, None, None, 777, 0, None, None, False, False, None, None, None),
    ]
    got = containers.metrics(spark.createDataFrame(rows, ddl)).select("row_bytes", "size0", "least", "layers", "stride", "error").collect()
    assert [tuple(r) for r in got] == [(16, 32, 8, 1, 32 + 8 + 8, None), (12, 24, 4, 4, 24, None), (8, 64, 4, 6, 64, None), (12, 12, 4, 1, 12, None), (None, None, 1, 1, None, "UnsupportedFormat"), (None, 777, 1, 1, 0, None)]
