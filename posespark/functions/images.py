"""NumPy image kernels: threshold, morphology, components, crop, drawing, similarity.

Images are two-dimensional uint8 arrays; points are (x, y).
"""

from __future__ import annotations

import numpy as np

#: Share of the longer side that is cut from each edge before blobs are compared.
CENTRAL_MARGIN = 0.15
#: Drawn bodies are this much thicker than measured.
THICKNESS = 1.2
#: Overlap of body patches is averaged.
ALPHA = 0.5


def blur(image: np.ndarray, size: int) -> np.ndarray:
    """Gaussian blur with an odd kernel, edges reflected; sigma follows from the size."""
    if size <= 1:
        return image.astype(float)
    sigma = 0.3 * ((size - 1) * 0.5 - 1) + 0.8
    at = np.arange(size) - size // 2
    kernel = np.exp(-(at**2) / (2 * sigma**2))
    kernel /= kernel.sum()
    out = image.astype(float)
    for axis in (0, 1):
        pad = [(size // 2,) * 2 if a == axis else (0, 0) for a in (0, 1)]
        wide = np.pad(out, pad, mode="reflect" if out.shape[axis] > size // 2 else "edge")
        out = np.apply_along_axis(np.convolve, axis, wide, kernel, "valid")
    return out


def otsu(values: np.ndarray) -> int:
    """Threshold of greatest variance between classes."""
    counts = np.bincount(values.astype(np.uint8).ravel(), minlength=256).astype(float)
    below, total = np.cumsum(counts), counts.sum()
    mass = np.cumsum(counts * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (mass[-1] * below - mass * total) ** 2 / (below * (total - below))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def otsu_level(image: np.ndarray, blur_size: int = 5) -> int:
    """Otsu's level of the blurred image over pixels that are not zero, blurred or not; 0 where none is left."""
    smooth = np.clip(np.rint(blur(image, blur_size)), 0, 255).astype(np.uint8)
    inside = smooth[(image > 0) & (smooth > 0)]
    return otsu(inside) if inside.size else 0


def dilate(mask: np.ndarray, size: int) -> np.ndarray:
    """Maximum over a square of odd side."""
    half, out = size // 2, mask
    for axis in (0, 1):
        wide = np.pad(out, [(half, half) if a == axis else (0, 0) for a in (0, 1)])
        out = np.lib.stride_tricks.sliding_window_view(wide, size, axis=axis).max(axis=-1)
    return out


def erode(mask: np.ndarray, size: int) -> np.ndarray:
    return ~dilate(~mask, size) if size > 1 else mask


def close(mask: np.ndarray, size: int) -> np.ndarray:
    """Fills gaps narrower than the square; the image's edge fills nothing."""
    return erode(dilate(mask, size), size)


def components(mask: np.ndarray) -> np.ndarray:
    """Labels from 1 of 8-connected blobs, by spreading the least pixel number to neighbours."""
    number = np.where(mask, np.arange(1, mask.size + 1).reshape(mask.shape), 0)
    big = mask.size + 1
    while True:
        wide = np.pad(np.where(mask, number, big), 1, constant_values=big)
        least = np.min([wide[1 + dy : 1 + dy + mask.shape[0], 1 + dx : 1 + dx + mask.shape[1]] for dy in (-1, 0, 1) for dx in (-1, 0, 1)], axis=0)
        new = np.where(mask, least, 0)
        new = np.where(mask, np.minimum(new, new.ravel()[np.maximum(new - 1, 0)]), 0)  # jump to the root's number
        if (new == number).all():
            break
        number = new
    found = np.unique(number[mask])
    return np.where(mask, np.searchsorted(found, number) + 1, 0)


def segment_foreground(image: np.ndarray, level: int | None = None, blur_size: int = 5, closing: int = 3, dilation: int = 5, lighter: bool = False) -> tuple[np.ndarray, int]:
    """Mask of the body and the background's mean, cut to a whole number.

    Pixels of value 0 are masked out of the frame: they are neither body nor background, and don't count for the level. The
    dark part is what is below the level (given, or Otsu's of the blurred frame), with narrow gaps closed; a lighter body is the
    rest. The body is the blob with most pixels in the central part of the image, the first one where none reaches it.
    """
    seen = image > 0
    dark = close(seen & (image < (otsu_level(image, blur_size) if level is None else level)), closing)
    mask, outside = (seen & ~dark, dark) if lighter else (dark, seen & ~dark)
    background = int(image[outside].mean()) if outside.any() else 0
    labels = components(mask)
    margin = int(CENTRAL_MARGIN * max(image.shape))
    inner = labels[margin : max(margin, image.shape[0] - margin), margin : max(margin, image.shape[1] - margin)]
    counts = np.bincount(inner.ravel(), minlength=labels.max() + 1)
    body = labels == 1 + int(np.argmax(counts[1:])) if labels.any() else np.zeros_like(mask)
    return dilate(body, dilation), background


def preprocess(image: np.ndarray, **options) -> tuple[np.ndarray, int, tuple[int, int, int, int]]:
    """Image with a uniform background, that background, and the body's rows and columns.

    The range is half-open from the least to the greatest row and column: the last of each is out.
    """
    mask, background = segment_foreground(image, **options)
    out = np.where(mask, image, background).astype(np.uint8)
    ys, xs = np.nonzero(mask)
    box = (int(ys.min()), int(ys.max()), int(xs.min()), int(xs.max())) if len(ys) else (0, image.shape[0], 0, image.shape[1])
    return out, background, box


def crop(image: np.ndarray, box: tuple[int, int, int, int], size: int, background: int) -> tuple[np.ndarray, tuple[int, int]]:
    """A square of even size around the box, and its top left corner (x, y) in the image."""
    if size % 2:
        raise ValueError("the crop size must be even")
    y0, y1, x0, x1 = box
    top, left = (y0 + y1) // 2 - size // 2, (x0 + x1) // 2 - size // 2
    out = np.full((size, size), background, dtype=image.dtype)
    a, b = max(0, top), min(image.shape[0], top + size)
    c, d = max(0, left), min(image.shape[1], left + size)
    if a < b and c < d:
        out[a - top : b - top, c - left : d - left] = image[a:b, c:d]
    return out, (left, top)


def resize(image: np.ndarray, factor: float) -> np.ndarray:
    """Bilinear values at the centres of the new pixels."""
    h, w = (max(1, int(round(s * factor))) for s in image.shape)
    y = (np.arange(h) + 0.5) * image.shape[0] / h - 0.5
    x = (np.arange(w) + 0.5) * image.shape[1] / w - 0.5
    return np.clip(np.rint(sample(image, *np.meshgrid(x, y))), 0, 255).astype(np.uint8)


def sample(image: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bilinear values at places, edges held."""
    x, y = np.clip(x, 0, image.shape[1] - 1), np.clip(y, 0, image.shape[0] - 1)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy, v = x - x0, y - y0, image.astype(float)
    return v[y0, x0] * (1 - fx) * (1 - fy) + v[y0, x1] * fx * (1 - fy) + v[y1, x0] * (1 - fx) * fy + v[y1, x1] * fx * fy


def median3(image: np.ndarray) -> np.ndarray:
    wide = np.pad(image, 1, mode="edge")
    return np.median([wide[dy : dy + image.shape[0], dx : dx + image.shape[1]] for dy in range(3) for dx in range(3)], axis=0).astype(image.dtype)


def body_frame(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unit tangents and normals along a skeleton."""
    tangent = np.gradient(points, axis=0)
    tangent /= np.maximum(np.hypot(*tangent.T)[:, None], 1e-12)
    return tangent, np.stack([-tangent[:, 1], tangent[:, 0]], axis=1)


def body_mask(shape: tuple[int, int], points: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Pixels within half the local width of the skeleton, in discs along it."""
    mask = np.zeros(shape, dtype=bool)
    fine = np.linspace(0, len(points) - 1, 4 * len(points))
    xs, ys, ws = (np.interp(fine, np.arange(len(points)), v) for v in (points[:, 0], points[:, 1], widths))
    for x, y, w in zip(xs, ys, ws, strict=True):
        r = w / 2
        y0, y1 = max(0, int(np.floor(y - r))), min(shape[0], int(np.ceil(y + r)) + 1)
        x0, x1 = max(0, int(np.floor(x - r))), min(shape[1], int(np.ceil(x + r)) + 1)
        if y0 < y1 and x0 < x1:
            yy, xx = np.ogrid[y0:y1, x0:x1]
            mask[y0:y1, x0:x1] |= (yy - y) ** 2 + (xx - x) ** 2 <= r * r
    return mask


def render(template: np.ndarray, template_points: np.ndarray, target_points: np.ndarray, widths: np.ndarray, shape: tuple[int, int], background: int) -> np.ndarray:
    """The template's body bent to a new skeleton, on a uniform background.

    The body is cut into patches of a few joints, tail first so that the head lies on
    top. Every pixel of a patch is looked up in the template by its place along and
    across the skeleton; where patches overlap their values are averaged.
    """
    n = len(target_points)
    step = max(1, n // 16)
    widths = widths * THICKNESS
    source = [np.interp(np.linspace(0, len(template_points) - 1, n), np.arange(len(template_points)), template_points[:, k]) for k in (0, 1)]
    source = np.stack(source, axis=1)
    _, source_normal = body_frame(source)
    tangent, normal = body_frame(target_points)
    out, drawn = np.full(shape, float(background)), np.zeros(shape, dtype=bool)
    for start in reversed(range(0, n - 1, step)):
        stop = min(n - 1, start + step)
        joints = np.arange(start, stop + 1)
        reach = widths[joints].max() / 2 + 1
        near = target_points[joints]
        y0, y1 = max(0, int(near[:, 1].min() - reach)), min(shape[0], int(near[:, 1].max() + reach) + 2)
        x0, x1 = max(0, int(near[:, 0].min() - reach)), min(shape[1], int(near[:, 0].max() + reach) + 2)
        if y0 >= y1 or x0 >= x1:
            continue
        yy, xx = np.mgrid[y0:y1, x0:x1]
        d = np.stack([xx, yy], axis=-1)[:, :, None, :] - near[None, None]
        closest = np.argmin((d**2).sum(axis=-1), axis=-1)
        j = joints[closest]
        offset = np.take_along_axis(d, closest[:, :, None, None], axis=2)[:, :, 0]
        along, across = (offset * tangent[j]).sum(-1), (offset * normal[j]).sum(-1)
        end = ((j == 0) & (along < 0)) | ((j == n - 1) & (along > 0))
        inside = (np.abs(across) <= widths[j] / 2) & (~end | (along**2 + across**2 <= (widths[j] / 2) ** 2))
        spacing = np.hypot(*(source[min(n - 1, 1)] - source[0])) / max(1e-9, np.hypot(*(target_points[min(n - 1, 1)] - target_points[0])))
        source_tangent = np.stack([source_normal[j][..., 1], -source_normal[j][..., 0]], axis=-1)
        place = source[j] + along[..., None] * spacing * source_tangent + across[..., None] * source_normal[j]
        value = sample(template, place[..., 0], place[..., 1])
        old, seen = out[y0:y1, x0:x1], drawn[y0:y1, x0:x1]
        out[y0:y1, x0:x1] = np.where(inside, np.where(seen, ALPHA * old + (1 - ALPHA) * value, value), old)
        drawn[y0:y1, x0:x1] |= inside
    image = np.clip(np.rint(out), 0, 255).astype(np.uint8)
    image[image == 0] = background
    return median3(image)


def bounding_box(image: np.ndarray, background: int, padding: int = 2) -> tuple[slice, slice]:
    """Rows and columns of what differs from the background, padded and clipped; all if nothing does."""
    ys, xs = np.nonzero(image != background)
    if not len(ys):
        return slice(0, image.shape[0]), slice(0, image.shape[1])
    return (
        slice(max(0, int(ys.min()) - padding), min(image.shape[0], int(ys.max()) + 1 + padding)),
        slice(max(0, int(xs.min()) - padding), min(image.shape[1], int(xs.max()) + 1 + padding)),
    )


def similarity(source: np.ndarray, template: np.ndarray) -> tuple[float, tuple[int, int]]:
    """Greatest normalised cross-correlation of a template in an image, as a magnitude, and its (x, y).

    A constant template is alike everywhere (1); constant parts of the image are unlike a
    template with texture (0). The sums under the window come from running sums,
    the products from one Fourier transform.
    """
    image, small = source.astype(float), template.astype(float)
    small = small - small.mean()
    h, w = small.shape
    rows, cols = image.shape[0] - h + 1, image.shape[1] - w + 1
    energy = float((small**2).sum())
    if energy < 1e-9:
        return 1.0, (0, 0)
    shape = (image.shape[0] + h, image.shape[1] + w)
    shifted = image - image.mean()
    product = np.fft.irfft2(np.fft.rfft2(shifted, shape) * np.conj(np.fft.rfft2(small, shape)), shape)[:rows, :cols]

    def window(values: np.ndarray) -> np.ndarray:
        total = np.pad(values.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        return total[h:, w:] - total[:-h, w:] - total[h:, :-w] + total[:-h, :-w]

    spread = np.maximum(window(shifted**2) - window(shifted) ** 2 / (h * w), 0)
    flat = spread < 1e-6 * max(1.0, float((shifted**2).max()))
    score = np.where(flat, 0.0, product / np.sqrt(np.where(flat, 1.0, spread) * energy))
    y, x = np.unravel_index(int(np.argmax(score)), score.shape)
    return float(abs(score[y, x])), (int(x), int(y))


def draw_overlay(image: np.ndarray, points: np.ndarray, widths: np.ndarray | None = None, value: int = 255) -> np.ndarray:
    """A copy with the skeleton, a disc at its first point and the widths' outline; no points, no change."""
    out = image.copy()
    if not len(points) or np.isnan(points).any():
        return out
    fine = np.linspace(0, len(points) - 1, 8 * len(points))
    xs, ys = (np.rint(np.interp(fine, np.arange(len(points)), points[:, k])).astype(int) for k in (0, 1))
    inside = (xs >= 0) & (ys >= 0) & (xs < image.shape[1]) & (ys < image.shape[0])
    out[ys[inside], xs[inside]] = value
    out[body_mask(image.shape, points[:1].repeat(2, axis=0), np.array([5.0, 5.0]))] = value
    if widths is not None:
        body = body_mask(image.shape, points, widths)
        out[body & ~erode(body, 3)] = value
    return out
