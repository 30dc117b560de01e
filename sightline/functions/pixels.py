"""Pixels on the driver or in a Python worker: resampling, labels, PNG files.  No image library is needed.

Resampling follows the usual definitions with pixel centres at halves: linear, cubic
(a = -0.75) and area weights.  Libraries that calculate in fixed point may differ by 1.
"""

from __future__ import annotations

import os
import struct
import zlib

import numpy as np

# A plain 5 by 7 font of the characters that labels use, a row of bits each.
GLYPHS = {
    " ": (0, 0, 0, 0, 0, 0, 0), "#": (10, 10, 31, 10, 31, 10, 10), "(": (2, 4, 8, 8, 8, 4, 2), ")": (8, 4, 2, 2, 2, 4, 8),
    ",": (0, 0, 0, 0, 12, 4, 8), "-": (0, 0, 0, 31, 0, 0, 0), ".": (0, 0, 0, 0, 0, 12, 12), "=": (0, 0, 31, 0, 31, 0, 0),
    "0": (14, 17, 19, 21, 25, 17, 14), "1": (4, 12, 4, 4, 4, 4, 14), "2": (14, 17, 1, 2, 4, 8, 31), "3": (31, 2, 4, 2, 1, 17, 14),
    "4": (2, 6, 10, 18, 31, 2, 2), "5": (31, 16, 30, 1, 1, 17, 14), "6": (6, 8, 16, 30, 17, 17, 14), "7": (31, 1, 2, 4, 8, 8, 8),
    "8": (14, 17, 17, 14, 17, 17, 14), "9": (14, 17, 17, 15, 1, 2, 12), "P": (30, 17, 17, 30, 16, 16, 16), "[": (14, 8, 8, 8, 8, 8, 14),
    "]": (14, 2, 2, 2, 2, 2, 14), "b": (16, 16, 22, 25, 17, 17, 30), "c": (0, 0, 14, 16, 16, 17, 14), "d": (1, 1, 13, 19, 17, 17, 15),
    "e": (0, 0, 14, 17, 31, 16, 14), "f": (6, 9, 8, 28, 8, 8, 8), "i": (4, 0, 12, 4, 4, 4, 14), "n": (0, 0, 22, 25, 17, 17, 17),
    "o": (0, 0, 14, 17, 17, 17, 14), "r": (0, 0, 22, 25, 16, 16, 16), "s": (0, 0, 14, 16, 14, 1, 30), "t": (8, 8, 28, 8, 8, 9, 6),
}
UNKNOWN = (31, 17, 17, 17, 17, 17, 31)


def weights(before: int, after: int, kind: str) -> np.ndarray:
    """Of each of ``after`` samples the shares of the ``before`` ones; edges are repeated."""
    out, step = np.zeros((after, before)), before / after
    place = np.arange(after)
    if kind == "area":
        for o in place:
            low, high = o * step, (o + 1) * step
            cells = np.arange(int(low), min(int(np.ceil(high)), before))
            out[o, cells] = np.minimum(cells + 1, high) - np.maximum(cells, low)
        return out / out.sum(axis=1, keepdims=True)
    centre = (place + 0.5) * step - 0.5
    first = np.floor(centre).astype(int)
    t = centre - first
    if kind == "linear":
        taps = {0: 1 - t, 1: t}
    elif kind == "cubic":
        a = -0.75
        near = lambda x: (a + 2) * x**3 - (a + 3) * x**2 + 1
        far = lambda x: a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a
        taps = {-1: far(t + 1), 0: near(t), 1: near(1 - t), 2: far(2 - t)}
    else:
        raise ValueError(f"no such filter: {kind}")
    for offset, share in taps.items():
        np.add.at(out, (place, np.clip(first + offset, 0, before - 1)), share)
    return out


def resize(image: np.ndarray, width: int, height: int, kind: str = "linear") -> np.ndarray:
    """An image of bytes resampled to a size."""
    high, wide, channels = image.shape
    rows = weights(high, height, kind) @ image.reshape(high, -1).astype(float)
    columns = np.tensordot(weights(wide, width, kind), rows.reshape(height, wide, channels), axes=(1, 1))
    return np.clip(np.rint(columns.transpose(1, 0, 2)), 0, 255).astype(np.uint8)


def fitted(image: np.ndarray, size: tuple[int, int], kind: str | None = None) -> np.ndarray:
    """The image scaled into ``size`` (width, height), centred on black; by default area to shrink, cubic to enlarge."""
    h, w = image.shape[:2]
    scale = min(size[0] / w, size[1] / h)
    rw, rh = max(1, round(w * scale)), max(1, round(h * scale))
    canvas = np.zeros((size[1], size[0], image.shape[2]), image.dtype)
    x, y = (size[0] - rw) // 2, (size[1] - rh) // 2
    canvas[y : y + rh, x : x + rw] = resize(image, rw, rh, kind or ("area" if scale < 1 else "cubic"))
    return canvas


def draw_text(image: np.ndarray, text: str, x: int, y: int, colour: tuple[int, int, int]) -> None:
    """Text whose first character's lower left corner is (x, y); what doesn't fit is cut off."""
    for character in text:
        for row, bits in enumerate(GLYPHS.get(character, UNKNOWN)):
            for column in range(5):
                at = y - 7 + row, x + column
                if bits >> (4 - column) & 1 and 0 <= at[0] < image.shape[0] and 0 <= at[1] < image.shape[1]:
                    image[at] = colour
        x += 6


def png_bytes(image: np.ndarray) -> bytes:
    """An RGB image as a PNG file."""
    rgb = np.ascontiguousarray(image[:, :, :3], np.uint8)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    lines = np.hstack((np.zeros((rgb.shape[0], 1), np.uint8), rgb.reshape(rgb.shape[0], -1)))
    head = struct.pack(">IIBBBBB", rgb.shape[1], rgb.shape[0], 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def save_png(image: np.ndarray, path: str) -> str:
    """Write a PNG whole or not at all, making its folder; a repeated attempt replaces it."""
    path = path.removeprefix("file://")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    part = f"{path}.{os.getpid()}.part"
    with open(part, "wb") as f:
        f.write(png_bytes(image))
    os.replace(part, path)
    return path
