"""Image kernels over arrays of H x W x 3 bytes: what SQL functions apply, and what the column forms are held against."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import xxhash

Image = np.ndarray
Params = dict[str, float]

# The luminance and chrominance tables of the JPEG standard, row by row.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99,
]
GRAY = np.array([0.299, 0.587, 0.114])
# The small kernels that stand in for sigma 0, by size; each row sums to 1.
SMALL_KERNELS = {
    1: (1.0,),
    3: (0.25, 0.5, 0.25),
    5: (0.0625, 0.25, 0.375, 0.25, 0.0625),
    7: (0.03125, 0.109375, 0.21875, 0.28125, 0.21875, 0.109375, 0.03125),
}


def saturated(x: np.ndarray) -> Image:
    """Rounded to even and kept within a byte."""
    return np.clip(np.rint(x), 0, 255).astype(np.uint8)


def truncated(x: np.ndarray) -> Image:
    return np.clip(x, 0, 255).astype(np.uint8)


def mirror(at: np.ndarray, size: int) -> np.ndarray:
    """Indices reflected at the outermost pixels, which are not repeated."""
    if size == 1:
        return np.zeros_like(at)
    at = np.abs(at) % (2 * size - 2)
    return np.where(at < size, at, 2 * size - 2 - at)


def sample_at(image: np.ndarray, x: np.ndarray, y: np.ndarray, border: bool = True) -> np.ndarray:
    """Bilinear values at (x, y); outside is the mirrored image, or 0."""
    h, w = image.shape[:2]
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    out = 0.0
    for dx in (0, 1):
        for dy in (0, 1):
            share = (1 - np.abs(x - x0 - dx)) * (1 - np.abs(y - y0 - dy))
            inside = (x0 + dx >= 0) & (x0 + dx < w) & (y0 + dy >= 0) & (y0 + dy < h)
            values = image[mirror(y0 + dy, h), mirror(x0 + dx, w)].astype(np.float64)
            share = share if border else share * inside
            out = out + values * (share[..., None] if image.ndim == 3 else share)
    return out


def turned(image: np.ndarray, angle: float, centre: tuple[float, float], border: bool = True) -> np.ndarray:
    """The image turned counter-clockwise by angle degrees about centre."""
    a, b = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    y, x = np.mgrid[: image.shape[0], : image.shape[1]].astype(float)
    dx, dy = x - centre[0], y - centre[1]
    return sample_at(image, a * dx - b * dy + centre[0], b * dx + a * dy + centre[1], border)


def resized(image: Image, height: int, width: int, area: bool) -> np.ndarray:
    """By pixel areas, or bilinear between pixel centres."""

    def weights(old: int, new: int) -> np.ndarray:
        out, scale = np.zeros((new, old)), old / new
        for k in range(new):
            if area:
                cells = np.arange(old)
                out[k] = np.clip(np.minimum(cells + 1, (k + 1) * scale) - np.maximum(cells, k * scale), 0, None) / scale
            else:
                at = min(max((k + 0.5) * scale - 0.5, 0), old - 1)
                low = min(int(at), old - 1)
                out[k, low] += 1 - (at - low)
                out[k, min(low + 1, old - 1)] += at - low
        return out

    return np.einsum("yi,ijc,xj->yxc", weights(image.shape[0], height), image.astype(np.float64), weights(image.shape[1], width))


def convolved(image: Image, kernel: np.ndarray) -> np.ndarray:
    """Correlation with an odd kernel over the mirrored image."""
    h, w = image.shape[:2]
    ry, rx = kernel.shape[0] // 2, kernel.shape[1] // 2
    padded = image[mirror(np.arange(-ry, h + ry), h)][:, mirror(np.arange(-rx, w + rx), w)].astype(np.float64)
    return sum(kernel[i, j] * padded[i : i + h, j : j + w] for i, j in zip(*np.nonzero(kernel), strict=True))


def gaussian_line(size: int, sigma: float) -> np.ndarray:
    """A row of taps; with sigma 0 it is a small one's fixed row, or sigma follows from the size."""
    if not sigma and size in SMALL_KERNELS:
        return np.array(SMALL_KERNELS[size])
    sigma = sigma or 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    line = np.exp(-((np.arange(size) - size // 2) ** 2) / (2 * sigma**2))
    return line / line.sum()


def gaussian(size: int, sigma: float) -> np.ndarray:
    """A size x size kernel."""
    return np.outer(gaussian_line(size, sigma), gaussian_line(size, sigma))


def motion(size: int, angle: float) -> np.ndarray:
    line = np.zeros((size, size))
    line[size // 2] = 1.0
    line = turned(line, angle, (size // 2, size // 2), border=False)
    if line.sum() == 0:
        line[size // 2, size // 2] = 1.0
    return line / line.sum()


def jpeg_tables(quality: int) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t).reshape(8, 8) * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE)]


def jpeg_round_trip(image: Image, quality: int) -> Image:
    """What quantisation of 8 x 8 cosine blocks at a quality leaves, colour at half the resolution."""
    h, w = image.shape[:2]
    r, g, b = np.moveaxis(image[mirror(np.arange(-(-h // 16) * 16), h)][:, mirror(np.arange(-(-w // 16) * 16), w)].astype(float), 2, 0)
    luma = 0.299 * r + 0.587 * g + 0.114 * b
    planes = [luma, 128 + (b - luma) * 0.564, 128 + (r - luma) * 0.713]
    k = np.arange(8)
    basis = np.sqrt((1 + (k > 0)) / 8)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    tables, out = jpeg_tables(quality), []
    for i, plane in enumerate(planes):
        if i:
            plane = plane.reshape(plane.shape[0] // 2, 2, plane.shape[1] // 2, 2).mean(axis=(1, 3))
        blocks = plane.reshape(plane.shape[0] // 8, 8, plane.shape[1] // 8, 8).transpose(0, 2, 1, 3) - 128
        table = tables[min(i, 1)]
        kept = basis.T @ (np.rint(basis @ blocks @ basis.T / table) * table) @ basis + 128
        plane = kept.transpose(0, 2, 1, 3).reshape(plane.shape)
        out.append(plane.repeat(2, axis=0).repeat(2, axis=1) if i else plane)
    y, cb, cr = out[0], out[1] - 128, out[2] - 128
    return saturated(np.stack([y + 1.403 * cr, y - 0.344 * cb - 0.714 * cr, y + 1.773 * cb], axis=2))[:h, :w]


@dataclass(frozen=True)
class Kernel:
    """draw(rng) gives the parameters, apply(image, params, rng) the new image."""

    draw: Callable[[np.random.Generator], Params]
    apply: Callable[[Image, Params, np.random.Generator], Image]


def between(name: str, low: float, high: float) -> Callable[[np.random.Generator], Params]:
    if low > high:
        raise ValueError(f"{name}: {low} is above {high}")
    return lambda rng: {name: float(rng.uniform(low, high))}


def odd_size(low: int, high: int) -> Callable[[np.random.Generator], Params]:
    if low % 2 == 0 or high % 2 == 0 or not 1 <= low <= high:
        raise ValueError("kernel sizes must be odd and ascending")
    return lambda rng: {"kernel_size": float(low + 2 * rng.integers(0, (high - low) // 2 + 1))}


def both(*draws) -> Callable[[np.random.Generator], Params]:
    return lambda rng: {k: v for draw in draws for k, v in draw(rng).items()}


def _scaled(image: Image, p: Params, _) -> Image:
    h, w = image.shape[:2]
    height, width = max(1, round(h * p["scale"])), max(1, round(w * p["scale"]))
    zoomed = saturated(resized(image, height, width, p["scale"] < 1))
    if p["scale"] >= 1:
        top, left = (height - h) // 2, (width - w) // 2
        return zoomed[top : top + h, left : left + w]
    top, left = (h - height) // 2, (w - width) // 2
    return zoomed[mirror(np.arange(-top, h - top), height)][:, mirror(np.arange(-left, w - left), width)]


def _shifted(image: Image, p: Params, _) -> Image:
    h, w = image.shape[:2]
    y, x = np.mgrid[:h, :w].astype(float)
    return saturated(sample_at(image, x - p["tx_percent"] * w, y - p["ty_percent"] * h))


def gray(image: Image) -> np.ndarray:
    """Weighted channels, rounded."""
    return np.rint(image @ GRAY)


def _contrast(image: Image, p: Params) -> Image:
    mean = float(gray(image).mean())
    return truncated(mean + p["factor"] * (image.astype(float) - mean))


def _contrast_rounded(image: Image, p: Params, _) -> Image:
    """Values below 0 turn positive, as absolute values do."""
    mean = float(gray(image).mean())
    return saturated(np.abs(p["factor"] * image.astype(float) + mean * (1 - p["factor"])))


def _speckled(image: Image, p: Params, rng: np.random.Generator) -> Image:
    hit = rng.random(image.shape[:2]) < p["noise_probability"]
    salt = hit & (rng.random(image.shape[:2]) < 0.5)
    out = image.copy()
    out[hit & ~salt] = 0
    out[salt] = 255
    return out


def default_kernels() -> dict[str, Kernel]:
    """All kernels with their default ranges."""
    plain = lambda f: lambda image, p, rng: f(image, p)
    blur = lambda sigma: lambda image, p, rng: saturated(convolved(image, gaussian(int(p["kernel_size"]), p.get("sigma", sigma))))
    noise = lambda image, p, rng: truncated(image + rng.normal(0.0, p["sigma"], image.shape))
    return {
        "rotation": Kernel(between("angle", -15, 15), plain(lambda i, p: saturated(turned(i, p["angle"], (i.shape[1] / 2, i.shape[0] / 2))))),
        "translation": Kernel(both(between("tx_percent", -0.1, 0.1), between("ty_percent", -0.1, 0.1)), _shifted),
        "scaling": Kernel(between("scale", 0.9, 1.1), _scaled),
        "horizontal_flip": Kernel(lambda rng: {}, plain(lambda i, p: i[:, ::-1].copy())),
        "brightness": Kernel(between("factor", 0.7, 1.3), plain(lambda i, p: saturated(np.abs(p["factor"] * i.astype(float))))),
        "contrast": Kernel(between("factor", 0.7, 1.3), plain(_contrast)),
        "contrast_rounded": Kernel(between("factor", 0.7, 1.3), _contrast_rounded),
        "gamma": Kernel(between("gamma", 0.7, 1.5), plain(lambda i, p: truncated((np.arange(256) / 255.0) ** p["gamma"] * 255.0)[i])),
        "gaussian_blur": Kernel(odd_size(3, 11), blur(0.0)),
        "gaussian_blur_random": Kernel(both(odd_size(3, 9), between("sigma", 0.1, 2.0)), blur(0.0)),
        "motion_blur": Kernel(both(odd_size(3, 9), between("angle", 0, 180)), plain(lambda i, p: saturated(convolved(i, motion(int(p["kernel_size"]), p["angle"]))))),
        "gaussian_noise": Kernel(between("sigma", 2, 15), noise),
        "salt_pepper": Kernel(between("noise_probability", 0.01, 0.05), _speckled),
        "jpeg_compression": Kernel(lambda rng: {"quality": float(rng.integers(30, 91))}, plain(lambda i, p: jpeg_round_trip(i, int(p["quality"])))),
        "sharpen": Kernel(between("strength", 0.5, 2.0), plain(lambda i, p: saturated((1 + p["strength"]) * i - p["strength"] * convolved(i, gaussian(19, 3.0))))),
    }


class Registry:
    """Kernels by name; names are unique and not empty."""

    def __init__(self, kernels: dict[str, Kernel] | None = None):
        self._kernels: dict[str, Kernel] = dict(default_kernels() if kernels is None else kernels)

    def register(self, name: str, kernel: Kernel) -> None:
        if not name.strip():
            raise ValueError("a kernel needs a name")
        if name in self._kernels:
            raise ValueError(f"{name} is registered already")
        self._kernels[name] = kernel

    def unregister(self, name: str) -> None:
        del self._kernels[name]

    def get(self, name: str) -> Kernel:
        return self._kernels[name]

    def names(self) -> list[str]:
        return sorted(self._kernels)

    def clear(self) -> None:
        self._kernels.clear()


def rng_for(seed: int, path: str, name: str, copy: int = 0) -> np.random.Generator:
    """A generator that depends on the record and the kernel alone, not on the order of rows."""
    return np.random.default_rng([seed, copy, xxhash.xxh64_intdigest(path.encode()), zlib.crc32(name.encode())])


def augment_one(image: Image, path: str, names: list[str], registry: Registry, seed: int, probability: float, copy: int = 0):
    """(image, applied names, parameters, error) of a chain; a kernel that fails leaves the image as it was."""
    if image.dtype != np.uint8 or image.ndim != 3 or image.shape[2] != 3 or not image.size:
        raise ValueError("images are H x W x 3 bytes")
    applied, params, errors = [], {}, []
    for name in names:
        kernel, rng = registry.get(name), rng_for(seed, path, name, copy)
        if rng.random() >= probability:
            continue
        try:
            drawn = kernel.draw(rng)
            image = np.ascontiguousarray(kernel.apply(image, drawn, rng), dtype=np.uint8)
        except Exception as error:  # a failing kernel must not end the chain
            errors.append(f"{name}: {error}")
            continue
        applied.append(name)
        params |= {f"{name}.{k}": v for k, v in drawn.items()}
    return image, applied, params, "; ".join(errors) or None
