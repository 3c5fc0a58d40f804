"""The legacy (pre-DX10) formats: channel masks and widths by rule from their names, and four-character codes."""

from __future__ import annotations

import re

# Names of the formats that are told by their masks, in the enumeration's order.
MASKED = "A8B8G8R8 G16R16 A2B10G10R10 A1R5G5B5 R5G6B5 A8 A8R8G8B8 X8R8G8B8 X8B8G8R8 A2R10G10B10 R8G8B8 X1R5G5B5 A4R4G4B4 X4R4G4B4 A8R3G3B2 A8L8 L16 L8 A4L4".split()
# Codes of the formats that are told by four characters or a number in their place.
CODED = {"DXT1": "DXT1", "DXT3": "DXT3", "DXT5": "DXT5", "R8G8_B8G8": "RGBG", "G8R8_G8B8": "GRGB", "A16B16G16R16": 36, "Q16W16V16U16": 110, "R16F": 111, "G16R16F": 112, "A16B16G16R16F": 113, "R32F": 114, "G32R32F": 115, "A32B32G32R32F": 116, "DXT2": "DXT2", "DXT4": "DXT4", "UYVY": "UYVY", "YUY2": "YUY2", "CXV8U8": 117}
# Widths that the names do not tell.
ODD_BITS = {"UYVY": 16, "YUY2": 16, "CXV8U8": 16}
# Codes that some DXGI formats had before the second header.
DXGI_CODED = {"BC1_UNorm": "DXT1", "BC2_UNorm": "DXT3", "BC3_UNorm": "DXT5", "BC4_UNorm": "BC4U", "BC4_SNorm": "BC4S", "BC5_UNorm": "ATI2", "BC5_SNorm": "BC5S", "R8G8_B8G8_UNorm": "RGBG", "G8R8_G8B8_UNorm": "GRGB", "R16G16B16A16_UNorm": 36, "R16G16B16A16_SNorm": 110, "R16_Float": 111, "R16G16_Float": 112, "R16G16B16A16_Float": 113, "R32_Float": 114, "R32G32_Float": 115, "R32G32B32A32_Float": 116}
PACKED = ("R8G8_B8G8", "G8R8_G8B8", "R8G8_B8G8_UNorm", "G8R8_G8B8_UNorm")
# The content class of the block formats.
CONTENT = {"DXT1": "bc1", "DXT2": "bc2", "DXT3": "bc2", "DXT4": "bc3", "DXT5": "bc3"}


def code(text: str | int) -> int:
    """Four characters as the word they make."""
    return text if isinstance(text, int) else int.from_bytes(text.encode(), "little")


def channels(name: str) -> list[tuple[str, int]]:
    return [(c, int(n)) for c, n in re.findall(r"([A-Z])(\d+)", name)]


def bits_per_pixel(name: str) -> int | None:
    if name.startswith("DXT"):
        return None
    return ODD_BITS.get(name) or sum(n for _, n in channels(name))


def block_bytes(name: str) -> int | None:
    return (8 if name == "DXT1" else 16) if name.startswith("DXT") else None


def masks(name: str) -> dict[str, int | None]:
    """Masks of red (or luminance), green, blue and alpha: a name lists its channels from the highest bit down."""
    found: dict[str, int | None] = dict.fromkeys("rgba")
    at = 0
    for channel, n in reversed(channels(name)) if name in MASKED else ():
        if channel != "X":
            found[{"L": "r"}.get(channel, channel.lower())] = ((1 << n) - 1) << at
        at += n
    return found


def requires_extension(name: str) -> bool:
    """Whether a DXGI format can be told by the second header only: too wide, typeless, float, sRGB, or no plain channels."""
    if name.startswith("BC") or name in DXGI_CODED and name in PACKED:
        return False
    wide = re.match(r"(R32G32|R16G16B16A16|R32G8X24|D32_Float_S8|R32_Float_X8|X32_Typeless_G8)", name)
    kind = re.search(r"(Typeless$|Float$|sRGB$|SharedExp$|XR_Bias)", name)
    video = not re.search(r"_|^Unknown$|^B4", name) or name.startswith("Format_420")
    odd = name in ("X24_Typeless_G8_UInt", "R24_UNorm_X8_Typeless")
    return bool(wide or kind and name != "X24_Typeless_G8_UInt" or video or odd and name.startswith("R24"))


def rows() -> list[dict]:
    """One row for each legacy format: name, bits, block bytes, word of its code, masks and content class."""
    return [{"name": n, "bits_per_pixel": bits_per_pixel(n), "block_bytes": block_bytes(n), "fourcc": code(CODED[n]) if n in CODED else None, **{f"{c}_mask": m for c, m in masks(n).items()}, "content": CONTENT.get(n)} for n in (*MASKED, *CODED)]


DDL = "name string, bits_per_pixel bigint, block_bytes bigint, fourcc bigint, r_mask bigint, g_mask bigint, b_mask bigint, a_mask bigint, content string"


def mask_keys() -> list[dict]:
    """What a file's pixel format must say for each masked format; one writes no alpha mask, and one may leave out its bits."""
    out = []
    for name in MASKED:
        held = masks(name)
        letters = {c for c, _ in channels(name)}
        if name == "A2B10G10R10":
            held["a"] = None
        key = {"name": name, "luminance": "L" in letters, "rgb": "R" in letters, "alpha": "A" in letters, "bits": bits_per_pixel(name), **{f"{c}_mask": m for c, m in held.items()}}
        out.append(key)
        if name == "A8":
            out.append(key | {"bits": None})
    return out


KEY_DDL = "name string, luminance boolean, rgb boolean, alpha boolean, bits bigint, r_mask bigint, g_mask bigint, b_mask bigint, a_mask bigint"
