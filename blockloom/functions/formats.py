"""Format tables as plain rows: the public DXGI enumeration, content classes and GPU names."""

from __future__ import annotations

import re

# Names of the DXGI formats, by code from 0 on.
DXGI_NAMES = """Unknown
R32G32B32A32_Typeless R32G32B32A32_Float R32G32B32A32_UInt R32G32B32A32_SInt
R32G32B32_Typeless R32G32B32_Float R32G32B32_UInt R32G32B32_SInt
R16G16B16A16_Typeless R16G16B16A16_Float R16G16B16A16_UNorm R16G16B16A16_UInt R16G16B16A16_SNorm R16G16B16A16_SInt
R32G32_Typeless R32G32_Float R32G32_UInt R32G32_SInt
R32G8X24_Typeless D32_Float_S8X24_UInt R32_Float_X8X24_Typeless X32_Typeless_G8X24_UInt
R10G10B10A2_Typeless R10G10B10A2_UNorm R10G10B10A2_UInt R11G11B10_Float
R8G8B8A8_Typeless R8G8B8A8_UNorm R8G8B8A8_UNorm_sRGB R8G8B8A8_UInt R8G8B8A8_SNorm R8G8B8A8_SInt
R16G16_Typeless R16G16_Float R16G16_UNorm R16G16_UInt R16G16_SNorm R16G16_SInt
R32_Typeless D32_Float R32_Float R32_UInt R32_SInt
R24G8_Typeless D24_UNorm_S8_UInt R24_UNorm_X8_Typeless X24_Typeless_G8_UInt
R8G8_Typeless R8G8_UNorm R8G8_UInt R8G8_SNorm R8G8_SInt
R16_Typeless R16_Float D16_UNorm R16_UNorm R16_UInt R16_SNorm R16_SInt
R8_Typeless R8_UNorm R8_UInt R8_SNorm R8_SInt A8_UNorm R1_UNorm R9G9B9E5_SharedExp R8G8_B8G8_UNorm G8R8_G8B8_UNorm
BC1_Typeless BC1_UNorm BC1_UNorm_sRGB BC2_Typeless BC2_UNorm BC2_UNorm_sRGB BC3_Typeless BC3_UNorm BC3_UNorm_sRGB
BC4_Typeless BC4_UNorm BC4_SNorm BC5_Typeless BC5_UNorm BC5_SNorm
B5G6R5_UNorm B5G5R5A1_UNorm B8G8R8A8_UNorm B8G8R8X8_UNorm R10G10B10_XR_Bias_A2_UNorm
B8G8R8A8_Typeless B8G8R8A8_UNorm_sRGB B8G8R8X8_Typeless B8G8R8X8_UNorm_sRGB
BC6H_Typeless BC6H_UF16 BC6H_SF16 BC7_Typeless BC7_UNorm BC7_UNorm_sRGB
AYUV Y410 Y416 NV12 P010 P016 Format_420_Opaque YUY2 Y210 Y216 NV11 AI44 IA44 P8 A8P8 B4G4R4A4_UNorm""".split()
# Codes after a gap in the enumeration.
DXGI_LATE = {130: "P208", 131: "V208", 132: "V408"}
# Bits per pixel that do not follow from the name's channel widths.
ODD_BITS = {"Unknown": None, "R9G9B9E5_SharedExp": 32, "R8G8_B8G8_UNorm": 16, "G8R8_G8B8_UNorm": 16, "R10G10B10_XR_Bias_A2_UNorm": 32, "R32_Float_X8X24_Typeless": 64, "AYUV": 32, "Y410": 10, "Y416": 16, "NV12": 12, "P010": 10, "P016": 16, "Format_420_Opaque": 20, "YUY2": 16, "Y210": 10, "Y216": 16, "NV11": 11, "AI44": 44, "IA44": 44, "P8": 8, "A8P8": 16, "P208": 8, "V208": 8, "V408": 8}
# Codes that a legacy file names by its four characters.
FOURCC = {"DXT1": "BC1_UNorm_sRGB", "DXT3": "BC2_UNorm_sRGB", "DXT5": "BC3_UNorm_sRGB", "ATI1": "BC4_UNorm", "ATI2": "BC5_UNorm"}
# Content class, bytes of a 4x4 block (none: 4 bytes a pixel).
CONTENT = [("bc1", 8), ("bc2", 16), ("bc3", 16), ("bc4u", 8), ("bc4s", 8), ("bc5u", 16), ("bc5s", 16), ("bc7", 16), ("rgba8", None), ("bgra8", None)]


def bits_per_pixel(name: str) -> int | None:
    """The sum of the channel widths in a name; block formats have none."""
    if name in ODD_BITS:
        return ODD_BITS[name]
    if name.startswith("BC"):
        return None
    return sum(int(n) for n in re.findall(r"[RGBADSX](\d+)", name))


def block_bytes(name: str) -> int | None:
    found = re.match(r"BC(\d)", name)
    return (8 if found[1] in "14" else 16) if found else None


def content_class(name: str) -> str | None:
    """The decoded class of a format, or none."""
    if name in ("R8G8B8A8_Typeless", "R8G8B8A8_UNorm", "R8G8B8A8_UNorm_sRGB", "R8G8B8A8_UInt"):
        return "rgba8"
    if name in ("B8G8R8A8_Typeless", "B8G8R8A8_UNorm", "B8G8R8A8_UNorm_sRGB"):
        return "bgra8"
    found = re.match(r"BC([123457])_", name)
    if not found:
        return None
    return f"bc{found[1]}" + (("s" if name.endswith("SNorm") else "u") if found[1] in "45" else "")


def hdr_class(name: str) -> str | None:
    return {"BC6H_Typeless": "bc6h_uf16", "BC6H_UF16": "bc6h_uf16", "BC6H_SF16": "bc6h_sf16"}.get(name)


def gpu_names(name: str) -> tuple[str, str, str] | None:
    """DXGI, WebGPU and Vulkan names that a format is uploaded as."""
    if content_class(name) is None and hdr_class(name) is None:
        return None
    srgb = name.endswith("sRGB")
    base = re.split("_", name)[0]
    kind = "sf16" if name.endswith("SF16") else "uf16" if base == "BC6H" else "snorm" if name.endswith("SNorm") else "unorm"
    plain = base + {"sf16": "_SF16", "uf16": "_UF16", "snorm": "_SNorm", "unorm": "_UNorm"}[kind] + ("_sRGB" if srgb else "")
    if base.startswith("BC"):
        channels = {"BC4": "R", "BC5": "Rg", "BC6H": "Rgb"}.get(base, "Rgba")
        word = {"sf16": "Float", "uf16": "Ufloat", "snorm": "Snorm", "unorm": "Unorm"}[kind]
        vk = {"sf16": "SFLOAT", "uf16": "UFLOAT", "snorm": "SNORM", "unorm": "SRGB" if srgb else "UNORM"}[kind]
        middle = "_RGBA" if base == "BC1" else ""
        return plain, base.capitalize().replace("Bc6h", "Bc6h") + channels + word + ("Srgb" if srgb else ""), f"VK_FORMAT_{base}{middle}_{vk}_BLOCK"
    order = "Rgba8" if base.startswith("R") else "Bgra8"
    return plain, order + "Unorm" + ("Srgb" if srgb else ""), f"VK_FORMAT_{base}_{'SRGB' if srgb else 'UNORM'}"


def dxgi_rows() -> list[dict]:
    """One row for each format: code, name, bits_per_pixel, block_bytes, content, hdr_content and GPU names."""
    named = dict(enumerate(DXGI_NAMES)) | DXGI_LATE
    rows = []
    for code, name in named.items():
        gpu = gpu_names(name) or (None, None, None)
        rows.append({"code": code, "name": name, "bits_per_pixel": bits_per_pixel(name), "block_bytes": block_bytes(name), "content": content_class(name), "hdr_content": hdr_class(name), "gpu_name": gpu[0], "wgpu_name": gpu[1], "vulkan_name": gpu[2]})
    return rows


DXGI_DDL = "code bigint, name string, bits_per_pixel bigint, block_bytes bigint, content string, hdr_content string, gpu_name string, wgpu_name string, vulkan_name string"
