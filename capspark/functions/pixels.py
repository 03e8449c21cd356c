"""Small numpy helpers for the pixels of one row: thumbnails, styles, masks, backgrounds, compositing.

Gray is 0.114 B + 0.587 G + 0.299 R, rounded; scaling is bilinear at pixel centres. Both are close to
what image libraries do, not equal to them bit by bit. Pixels outside an image count as set for erosion.
"""

from __future__ import annotations

import numpy as np


def image(data: bytes, h: int, w: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(h, w, 3)


def gray(bgr: np.ndarray) -> np.ndarray:
    return np.rint(bgr @ np.array([0.114, 0.587, 0.299])).astype(np.uint8)


def resized(img: np.ndarray, h: int, w: int) -> np.ndarray:
    def at(n: int, m: int):
        x = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(x).astype(int)
        return low, np.minimum(low + 1, n - 1), x - low

    (a, b, f), (c, d, g) = at(img.shape[0], h), at(img.shape[1], w)
    v = img.astype(float)
    top = v[a][:, c] * (1 - g) + v[a][:, d] * g
    low = v[b][:, c] * (1 - g) + v[b][:, d] * g
    return np.rint(top * (1 - f)[:, None] + low * f[:, None]).astype(np.uint8)


def thumbnail(data: bytes, h: int, w: int, crop_y: int, crop_h: int, th: int, tw: int) -> bytes:
    return resized(gray(image(data, h, w)[crop_y : crop_y + crop_h]), th, tw).tobytes()


def _shifted(mask: np.ndarray, size: int, outside: bool):
    r = size // 2
    padded = np.pad(mask, r, constant_values=outside)
    h, w = mask.shape
    for y in range(size):
        for x in range(size):
            yield padded[y : y + h, x : x + w]


def erode(mask: np.ndarray, size: int = 3, rounds: int = 1) -> np.ndarray:
    for _ in range(rounds):
        mask = np.logical_and.reduce(list(_shifted(mask, size, True)))
    return mask


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    return np.logical_or.reduce(list(_shifted(mask, size, False)))


WHITE, INK = (255, 255, 255), (16, 16, 16)


def text_style(bgr: np.ndarray, boxes: list[tuple[int, int, int, int]]):
    """(fill, outline, glyph mask or None) of text inside boxes (in the image's own pixels). The class
    of bright or dark pixels that outlasts two erosions better is the fill, on a tie the dark one."""
    inside = np.zeros(bgr.shape[:2], bool)
    for x1, y1, x2, y2 in boxes:
        inside[max(0, y1) : max(0, y2), max(0, x1) : max(0, x2)] = True
    g = gray(bgr)
    dark, bright = inside & (g < 70), inside & (g > 190)
    if inside.sum() < 100 or dark.sum() < 80 or bright.sum() < 80:
        return WHITE, INK, None
    core = {k: int(erode(m, 3, 2).sum()) for k, m in (("dark", dark), ("bright", bright))}
    fill, outline = (bright, dark) if core["bright"] > core["dark"] else (dark, bright)
    colour = lambda m: tuple(int(v) for v in np.median(bgr[m], axis=0))
    glyph = dark | bright
    share = glyph.sum() / inside.sum()
    return colour(fill), colour(outline), glyph if 0.08 <= share <= 0.85 else None


def erase_mask(roi: tuple[int, int, int, int], boxes: list[tuple[int, int, int, int]], glyph: np.ndarray | None, glyph_rect: tuple[int, int, int, int] | None) -> np.ndarray:
    """What to erase inside roi: the glyphs, a little wider; without usable glyphs the lines' boxes."""
    x1, y1, x2, y2 = roi
    out = np.zeros((y2 - y1, x2 - x1), bool)
    if glyph is not None and glyph_rect is not None:
        gx1, gy1, gx2, gy2 = glyph_rect
        if glyph.shape == (gy2 - gy1, gx2 - gx1):
            a, b, c, d = max(x1, gx1), max(y1, gy1), min(x2, gx2), min(y2, gy2)
            if a < c and b < d:
                out[b - y1 : d - y1, a - x1 : c - x1] = glyph[b - gy1 : d - gy1, a - gx1 : c - gx1]
                out = dilate(out, 5)
                if out.any():
                    return out
                out[:] = False
    for bx1, by1, bx2, by2 in boxes:
        out[max(0, by1 - 7 - y1) : max(0, by2 + 7 - y1), max(0, bx1 - 10 - x1) : max(0, bx2 + 10 - x1)] = True
    return out


def background(patches: list[np.ndarray], mask: np.ndarray, spread: int):
    """(median, static mask, ring) of patches without text, or None if they tell too little."""
    if len(patches) < 2:
        return None
    stack = np.stack(patches)
    median = np.median(stack, axis=0).astype(np.uint8)
    moved = (stack.max(axis=0).astype(int) - stack.min(axis=0)).max(axis=2)
    static = (moved < spread) & mask
    ring = dilate(mask, 15) & ~mask
    if not mask.any() or static.sum() < 0.05 * mask.sum() or ring.sum() < 200:
        return None
    return median, static, ring


def neighbour_fill(img: np.ndarray, mask: np.ndarray, rounds: int = 64) -> np.ndarray:
    """Masked pixels from the mean of known neighbours, from the edge inwards."""
    out, known = img.astype(float), ~mask
    for _ in range(rounds):
        if known.all() or not known.any():
            break
        total, n = np.zeros_like(out), np.zeros(known.shape)
        for shifted, k in zip(_shift_all(out * known[..., None]), _shift_all(known.astype(float)), strict=True):
            total += shifted
            n += k
        new = ~known & (n > 0)
        out[new] = total[new] / n[new][:, None]
        known = known | new
    return np.rint(out).astype(np.uint8)


def _shift_all(a: np.ndarray):
    padded = np.pad(a, ((1, 1), (1, 1)) + ((0, 0),) * (a.ndim - 2))
    h, w = a.shape[:2]
    return [padded[y : y + h, x : x + w] for y in range(3) for x in range(3) if (y, x) != (1, 1)]


def blend(under: np.ndarray, rgba: np.ndarray) -> np.ndarray:
    """The integer alpha blend of an overlay (last channel alpha) on pixels."""
    a = rgba[..., 3:].astype(int)
    return ((rgba[..., :3].astype(int) * a + under.astype(int) * (255 - a) + 127) // 255).astype(np.uint8)


def composite(frame: np.ndarray, roi, mask, back, overlay, at, ring_max: float = 11.0, fill=neighbour_fill) -> np.ndarray:
    """One frame with its old text erased and the overlay laid on. back: background() or None."""
    out = frame.copy()
    if roi is not None and mask is not None and mask.any():
        x1, y1, x2, y2 = roi
        part = out[y1:y2, x1:x2]
        if back is not None and np.abs(part[back[2]].astype(int) - back[0][back[2]]).mean() <= ring_max:
            part[back[1]] = back[0][back[1]]
            rest = mask & ~back[1]
        else:
            rest = mask
        if rest.any():
            out[y1:y2, x1:x2] = fill(part, rest)
    if overlay is not None:
        ox, oy = at
        h, w = overlay.shape[:2]
        ax, ay, bx, by = max(0, ox), max(0, oy), min(out.shape[1], ox + w), min(out.shape[0], oy + h)
        if ax < bx and ay < by:
            out[ay:by, ax:bx] = blend(out[ay:by, ax:bx], overlay[ay - oy : by - oy, ax - ox : bx - ox])
    return out


def wrap(text: str, max_w: float, width) -> list[str]:
    """Lines of at most max_w by a width function, broken between any two characters; a line's first
    character is never pushed out. Line breaks of the text stay."""
    lines = []
    for part in text.split("\n"):
        line = ""
        for c in part:
            if line and width(line + c) > max_w:
                lines.append(line)
                line = c
            else:
                line += c
        lines.append(line)
    if len(lines) > 1 and lines[-1] == "":
        lines.pop()
    return lines
