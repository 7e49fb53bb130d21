"""Symbols in page rasters: black-line masks, template correlation, suppression of overlaps; numpy, one page at a time.

A library of templates is spread out once into its variants (every turn and scale).  A page's sums over
windows come from integral images and its products with a variant from a Fourier transform, so the work for
a variant grows with the page, not with page times template.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Darkness and colour of a black line, least correlation, most overlap, turns and sizes that are tried.
BLACK, CHROMA, THRESHOLD, OVERLAP = 120, 40, 0.7, 0.3
ROTATIONS = (0, 90, 180, 270)
SCALES = (0.5, 0.7, 0.85, 1.0, 1.2, 1.5)
LEAST_SIDE = 4


def black_mask(image: np.ndarray) -> np.ndarray:
    """255 where a pixel is dark and without colour, else 0; pixels have three channels of eight bits."""
    dark = (image < BLACK).all(axis=-1)
    grey = np.ptp(image, axis=-1) < CHROMA
    return np.uint8(255) * (dark & grey)


def crop_template(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    """The mask of a box (x0, y0, x1, y1) of a page, as a template; what lies off the page is left out."""
    x0, y0, x1, y1 = (max(0, int(v)) for v in box)
    return black_mask(image[y0:y1, x0:x1])


def rotated(template: np.ndarray, degrees: int) -> np.ndarray:
    """Turned clockwise by a multiple of 90 degrees."""
    return np.rot90(template, -degrees // 90)


def resized(template: np.ndarray, scale: float) -> np.ndarray:
    """Scaled by the area that each new pixel covers."""
    if scale == 1.0:
        return template.astype(float)

    def weights(old: int, new: int) -> np.ndarray:
        edges = np.linspace(0, old, new + 1)
        cover = np.minimum(edges[1:, None], np.arange(1, old + 1)) - np.maximum(edges[:-1, None], np.arange(old))
        return np.clip(cover, 0, None) / (old / new)

    h, w = (max(LEAST_SIDE, int(n * scale)) for n in template.shape)
    return weights(template.shape[0], h) @ template.astype(float) @ weights(template.shape[1], w).T


@dataclass(frozen=True)
class Variant:
    """A template as it may stand on a page, around its mean."""

    kind: str
    degrees: int
    pixels: np.ndarray

    @property
    def shape(self) -> tuple[int, int]:
        return self.pixels.shape


def variants(templates: dict[str, np.ndarray]) -> list[Variant]:
    """All turns and sizes of all templates."""
    found = ((kind, degrees, resized(rotated(own, degrees), scale)) for (kind, own), degrees, scale in product(templates.items(), ROTATIONS, SCALES))
    return [Variant(kind, degrees, own - own.mean()) for kind, degrees, own in found]


class Page:
    """A mask with what its windows need: integral images and the transform."""

    def __init__(self, mask: np.ndarray):
        self.mask = mask.astype(float)
        self.shape = mask.shape
        self.sums, self.squares = (np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for m in (self.mask, self.mask**2))
        self.transform = np.fft.rfft2(self.mask)

    def windows(self, integral: np.ndarray, h: int, w: int) -> np.ndarray:
        return integral[h:, w:] - integral[:-h, w:] - integral[h:, :-w] + integral[:-h, :-w]

    def responses(self, variant: Variant) -> np.ndarray:
        """Normalised correlation at every place; 0 where either side is flat."""
        h, w = variant.shape
        energy = self.windows(self.squares, h, w) - self.windows(self.sums, h, w) ** 2 / (h * w)
        scale = np.sqrt(np.maximum(energy, 0) * (variant.pixels**2).sum())
        turned = np.fft.irfft2(self.transform * np.conj(np.fft.rfft2(variant.pixels, self.shape)), self.shape)
        return np.divide(turned[: energy.shape[0], : energy.shape[1]], scale, out=np.zeros_like(energy), where=scale > 1e-3)


def suppressed(boxes: np.ndarray, scores: np.ndarray, most: float = OVERLAP) -> list[int]:
    """Boxes (x0, y0, x1, y1) kept in order of score, none of which overlaps a kept one by more than ``most`` of their union."""
    kept: list[int] = []
    for i in np.argsort(-scores, kind="stable"):
        a = boxes[i]
        b = boxes[kept].reshape(-1, 4)
        inner = np.clip(np.minimum(a[2:], b[:, 2:]) - np.maximum(a[:2], b[:, :2]), 0, None).prod(axis=1)
        union = (a[2:] - a[:2]).prod() + (b[:, 2:] - b[:, :2]).prod(axis=1) - inner
        if not (inner > most * union).any():
            kept.append(int(i))
    return kept


Hit = tuple[str, int, float, tuple[int, int, int, int]]


def symbols(mask: np.ndarray, templates: dict[str, np.ndarray] | list[Variant], threshold: float = THRESHOLD) -> list[Hit]:
    """(kind, rotation, score, box) of all templates in all rotations and scales, best first; overlaps are settled over all templates."""
    library = variants(templates) if isinstance(templates, dict) else templates
    page = Page(mask)
    able = [v for v in library if v.shape[0] <= page.shape[0] and v.shape[1] <= page.shape[1]]
    places = []
    for number, variant in enumerate(able):
        answer = page.responses(variant)
        y, x = np.nonzero(answer >= threshold)
        places.append(np.column_stack([np.full(len(y), number), x, y, x + variant.shape[1], y + variant.shape[0], answer[y, x]]))
    every = np.concatenate(places) if places else np.zeros((0, 6))
    best = every[suppressed(every[:, 1:5], every[:, 5])]
    return [(able[int(n)].kind, able[int(n)].degrees, float(score), tuple(int(v) for v in box)) for n, *box, score in best]


def detect(pages: DataFrame, templates: dict[str, np.ndarray]) -> DataFrame:
    """(source, page, kind, rotation, score, x0, y0, x1, y1) of raster pages (source, page, height, width, rgb as bytes).

    Templates are a library of fixed size; a task holds one batch of pages.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        library = variants(templates)
        for batch in batches:
            rows = []
            for p in batch.itertuples():
                mask = black_mask(np.frombuffer(p.rgb, np.uint8).reshape(p.height, p.width, 3))
                rows += [(p.source, p.page, kind, turn, score, *box) for kind, turn, score, box in symbols(mask, library)]
            yield pd.DataFrame(rows, columns=["source", "page", "kind", "rotation", "score", "x0", "y0", "x1", "y1"])

    return pages.mapInPandas(run, "source string, page int, kind string, rotation int, score double, x0 int, y0 int, x1 int, y1 int")


def symbol_counts(hits: DataFrame) -> DataFrame:
    """(source, page, kind, count): how many symbols of each kind a page shows."""
    return hits.groupBy("source", "page", "kind").agg(F.count(F.lit(1)).alias("count"))
