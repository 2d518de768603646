"""Copies of images by local descriptors.

Corners are found at several scales; the patch around each is turned by its
intensity centroid's angle, and pairs of its smoothed pixels are compared, which
gives a binary descriptor. Corners meet in Hamming tables together with a corner
near them: a key is some bits of both descriptors, and two that share one must
also lie alike. Of images that meet, two are linked if enough corners agree on
one shift, turn and scale, each weighed by how near its descriptors are. Cropped
or edited copies keep many corners, and so are found.

Formats that are read: binary PGM and PPM of 8 bits, and PNG of 8 bits without
interlacing and palette. An image of another format takes part by its bytes only.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cluster import dropped, placed, slices, written
from .components import components

SCALES = tuple(2 ** (-i / 4) for i in range(5))
RADIUS = 7  # of a patch
WORDS = 4  # of 64 bits in a descriptor
BANDS, BAND_BITS = 8, 15  # keys of a doublet, each of so many bits of both descriptors
CHECK_BITS = 32  # of each of the two, compared where doublets meet
NEIGHBOURS = 6  # corners that a corner makes doublets with
CHECK_DIFFERING = 5  # of the two times CHECK_BITS, at most
TURN_STEPS, TURN_APART, LENGTH_STEPS, LENGTH_APART = 256, 8, 16, 3  # of a full turn and of a doubling; how far doublets that meet may be apart
SKETCH = 16  # keys of an image by which it meets others first


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels of a binary PGM or PPM (8 bits), or of a PNG of 8 bits without interlacing; None for anything else."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            return _netpbm(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, IndexError, OverflowError, zlib.error, KeyError):
        return None
    return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    if pixels.shape[2] in (2, 4):
        pixels = pixels[:, :, :-1]
    return pixels[:, :, 0].astype(np.float32) if pixels.shape[2] == 1 else (pixels @ np.array([0.299, 0.587, 0.114])).astype(np.float32)


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields
    if most > 255:
        raise ValueError("16-bit samples")
    channels = 3 if data[:2] == b"P6" else 1
    pixels = np.frombuffer(data, np.uint8, width * height * channels, at + 1)
    return _grey(pixels.reshape(height, width, channels))


def _png(data: bytes) -> np.ndarray:
    at, head, parts = 8, b"", []
    while at < len(data):
        size, kind = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8]
        if kind == b"IHDR":
            head = data[at + 8 : at + 8 + size]
        elif kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += 12 + size
    width, height = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, colour, _, _, interlaced = head[8:13]
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced:
        raise ValueError("not 8 bits, or interlaced")
    size = height * (1 + width * channels)
    # no more is unpacked than the picture can have
    rows = np.frombuffer(zlib.decompressobj().decompress(b"".join(parts), size), np.uint8).reshape(height, 1 + width * channels)
    out = np.zeros((height, width, channels), np.uint8)
    above = np.zeros((width, channels), np.uint8)
    for y in range(height):
        kind, line = rows[y, 0], rows[y, 1:].reshape(width, channels)
        if kind == 1:
            line = np.cumsum(line, axis=0, dtype=np.uint8)
        elif kind == 2:
            line = line + above
        elif kind in (3, 4):
            line = line.copy()
            left = np.zeros(channels, np.int64)
            corner = np.zeros(channels, np.int64)
            for x in range(width):
                up = above[x].astype(np.int64)
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                line[x] = (line[x] + guess) & 255
                left, corner = line[x].astype(np.int64), up
        out[y] = above = line
    return _grey(out)


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear; of an image or a stack of them."""
    own_height, own_width = image.shape[-2:]
    y = np.clip((np.arange(height) + 0.5) * own_height / height - 0.5, 0, own_height - 1)
    x = np.clip((np.arange(width) + 0.5) * own_width / width - 0.5, 0, own_width - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, own_height - 1), np.minimum(x0 + 1, own_width - 1)
    fy, fx = (y - y0)[:, None], (x - x0)[None, :]
    above, below = image[..., y0, :], image[..., y1, :]
    top = above[..., x0] * (1 - fx) + above[..., x1] * fx
    low = below[..., x0] * (1 - fx) + below[..., x1] * fx
    return (top * (1 - fy) + low * fy).astype(np.float32)


def _edged(stack: np.ndarray, r: int) -> np.ndarray:
    """Edges of each image repeated ``r`` times."""
    return np.pad(stack, ((0, 0), (r, r), (r, r)), mode="edge")


def _box(stack: np.ndarray, r: int) -> np.ndarray:
    """Mean over a square of side 2r + 1, edges repeated, of each image of a stack."""
    padded = _edged(stack, r)
    total = np.zeros((len(padded), padded.shape[1] + 1, padded.shape[2] + 1))
    np.cumsum(padded, axis=1, dtype=np.float64, out=total[:, 1:, 1:])
    np.cumsum(total[:, 1:, 1:], axis=2, out=total[:, 1:, 1:])
    n = 2 * r + 1
    return ((total[:, n:, n:] - total[:, :-n, n:] - total[:, n:, :-n] + total[:, :-n, :-n]) / (n * n)).astype(np.float32)


def corners(stack: np.ndarray) -> np.ndarray:
    """(image, y, x) of local maxima of the smaller eigenvalue of the gradients' moments, over a hundredth of the greatest of the image; equal neighbours: the first in reading order."""
    smooth = _box(stack, 1)
    gy, gx = np.gradient(smooth, axis=(1, 2))
    xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
    response = (xx + yy) / 2 - np.sqrt(((xx - yy) / 2) ** 2 + xy * xy)
    padded = np.pad(response, ((0, 0), (3, 3), (3, 3)), constant_values=-1.0)
    least = np.maximum(1e-3, 0.01 * response.max(axis=(1, 2), initial=0.0).astype(np.float64)).astype(np.float32)
    peak = response > least[:, None, None]
    _, h, w = response.shape
    for dy in range(-3, 4):
        for dx in range(-3, 4):
            if (dy, dx) != (0, 0):
                other = padded[:, 3 + dy : 3 + dy + h, 3 + dx : 3 + dx + w]
                peak &= (response > other) if (dy, dx) < (0, 0) else (response >= other)
    return np.argwhere(peak)


@cache
def _tests() -> np.ndarray:
    """Pairs of points of a patch, from a fixed seed: (test, point, y and x)."""
    r = np.random.default_rng(20_240_117)
    return np.clip(r.normal(0, RADIUS / 2, (64 * WORDS, 2, 2)), -RADIUS + 1, RADIUS - 1)


@cache
def _disc() -> tuple[np.ndarray, np.ndarray]:
    y, x = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
    inside = y * y + x * x <= RADIUS * RADIUS
    return y[inside], x[inside]


def describe(image: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, descriptors): y, x, scale and angle of each corner in the image's own pixels, and its 256 bits."""
    return describe_all([image])[0]


def describe_all(images: list[np.ndarray | None], most: int = 1 << 16) -> list[tuple[np.ndarray, np.ndarray]]:
    """``describe`` of each: images of one size are taken as a stack, of about ``most`` pixels or one image."""
    out = [(np.zeros((0, 4)), np.zeros((0, WORDS), np.uint64))] * len(images)
    by_shape: dict[tuple[int, int], list[int]] = {}
    for row, image in enumerate(images):
        if image is not None and min(image.shape) >= 8:
            by_shape.setdefault(image.shape, []).append(row)
    for (height, width), rows in by_shape.items():
        step = max(1, most // (height * width))
        for own in (rows[at : at + step] for at in range(0, len(rows), step)):
            for row, found in zip(own, _described(np.stack([images[row] for row in own])), strict=True):
                out[row] = found
    return out


def _described(stack: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    owners, places, found = [], [], []
    for scale in SCALES:
        h, w = round(stack.shape[1] * scale), round(stack.shape[2] * scale)
        if min(h, w) < 8:
            continue
        level = stack.astype(np.float32) if scale == 1.0 else resized(stack, h, w)
        at = corners(level)
        if not len(at):
            continue
        padded = _edged(_box(level, 1), RADIUS + 1)
        owner, at = at[:, 0], at[:, 1:]
        own = (at + 0.5) / scale - 0.5
        at = at + RADIUS + 1
        bits, angles = np.empty((len(at), WORDS), np.uint64), np.empty(len(at))
        for part in (slice(i, i + 256) for i in range(0, len(at), 256)):
            bits[part], angles[part] = _patches(padded, owner[part], at[part])
        owners.append(owner)
        found.append(bits)
        places.append(np.column_stack([own, np.full(len(at), 1 / scale), angles]))
    if not found:
        return [(np.zeros((0, 4)), np.zeros((0, WORDS), np.uint64))] * len(stack)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ends = np.searchsorted(owner[order], np.arange(1, len(stack)))
    return list(zip(np.split(np.concatenate(places)[order], ends), np.split(np.concatenate(found)[order], ends), strict=True))


def _patches(padded: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(descriptors, angles) of corners of a stack's images."""
    _, height, width = padded.shape
    flat, first = padded.ravel(), owner * (height * width)
    dy, dx = _disc()
    patch = flat[(first + at[:, 0] * width + at[:, 1])[:, None] + (dy * width + dx)]
    patch = patch - patch.mean(axis=1, keepdims=True)
    angle = np.arctan2((patch * dy).sum(axis=1), (patch * dx).sum(axis=1))
    cos, sin = np.cos(angle)[:, None], np.sin(angle)[:, None]
    value = []
    for ty, tx in _tests().transpose(1, 2, 0):
        y = np.rint(at[:, :1] + sin * tx + cos * ty).clip(0, height - 1)
        x = np.rint(at[:, 1:] + cos * tx - sin * ty).clip(0, width - 1)
        value.append(flat[(y * width + x).astype(np.int64) + first[:, None]])
    return np.packbits(value[0] < value[1], axis=1, bitorder="little").view("<u8"), angle


def nearest_descriptors(a: np.ndarray, b: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """The nearest of ``b`` for each of ``a``, the first of those as near, and the bits between them; ``most`` pairs are held at once."""
    near, apart = np.empty(len(a), np.int64), np.empty(len(a), np.int64)
    step = max(1, most // len(b))
    for at in range(0, len(a), step):
        own = a[at : at + step]
        bits = np.zeros((len(own), len(b)), np.uint16)
        for word in range(WORDS):
            bits += np.bitwise_count(own[:, word, None] ^ b[None, :, word])
        near[at : at + step] = bits.argmin(axis=1)
        apart[at : at + step] = bits[np.arange(len(own)), near[at : at + step]]
    return near, apart


def _votes(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shift (y, x), turn and change of scale that take places ``p`` to ``q``, each in the widths of a cell."""
    turn = (q[..., 3] - p[..., 3] + math.pi) % (2 * math.pi) - math.pi
    scale = np.log2(q[..., 2] / p[..., 2])
    grow, cos, sin = 2.0**scale, np.cos(turn), np.sin(turn)
    dy = q[..., 0] - grow * (cos * p[..., 0] + sin * p[..., 1])
    dx = q[..., 1] - grow * (cos * p[..., 1] - sin * p[..., 0])
    return dy / 6, dx / 6, turn / 0.35, scale / 0.5


def consensus(a_places: np.ndarray, a: np.ndarray, b_places: np.ndarray, b: np.ndarray, most_bits: int = 48) -> tuple[int, float]:
    """(corners, evidence) of two images: corners of ``a`` whose nearest descriptors in ``b`` agree on one shift, turn and change of scale, and the sum of the bits by which these are nearer than ``most_bits``.

    Of the cells of votes, with their neighbours, the one with the most
    evidence; a corner of ``b`` counts once. The more descriptors an image has
    the nearer is one by chance, so for each doubling of 22 a corner counts
    three bits less.
    """
    if not len(a) or not len(b):
        return 0, 0.0
    near, apart = nearest_descriptors(a, b)
    worth = _worth(len(b), most_bits) - apart
    ok = worth > 0
    if not ok.any():
        return 0, 0.0
    p, q, worth, owner = a_places[ok], b_places[near[ok]], worth[ok], near[ok]
    votes = np.column_stack(_votes(p, q))
    best = (0, 0.0)
    order = np.argsort(-worth, kind="stable")  # of corners with one partner the nearest comes first
    votes, worth, owner = votes[order], worth[order], owner[order]
    step = max(1, (1 << 18) // len(votes))
    for at in range(0, len(votes), step):
        off = np.abs(votes - votes[at : at + step, None])
        off[:, :, 2] = np.minimum(off[:, :, 2], 2 * math.pi / 0.35 - off[:, :, 2])
        near_by = (off <= 1).all(axis=2)
        # corners that count twice included, and more than is lost by rounding
        at_most = near_by @ worth + 1e-6
        for held, bound in zip(near_by, at_most.tolist(), strict=True):
            if bound <= best[1]:
                continue
            mine = np.flatnonzero(held)
            _, first = np.unique(owner[mine], return_index=True)
            found = float(worth[mine[first]].sum())
            if found > best[1]:
                best = len(first), found
    return best


def _worth(n: np.ndarray | int, most_bits: int = 48) -> np.ndarray:
    """Bits that a corner counts whose descriptor is equal to one of ``n``: for each doubling of 22 three less."""
    return most_bits - 3 * np.maximum(0.0, np.log2(np.maximum(n, 1) / 22))


def bounds(places: np.ndarray, bits: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray, least_agreeing: int, least_share: float, least_evidence: float, most: int = 1 << 17) -> np.ndarray:
    """Whether each pair of images may agree enough, which is true of all for which ``consensus`` says so, and of few others.

    First by the descriptors alone: what the nearest ones are worth to either
    image. Then by the cells of votes, in which here a corner of ``b`` may count
    more than once. An image's corners are ``sizes`` rows of ``places`` and
    ``bits`` from ``starts`` on. About ``most`` pairs of corners are held at
    once; pairs of images that have more are true.
    """
    keep = sizes[a] * sizes[b] > most
    order = np.lexsort((sizes[b], sizes[a]))
    order = order[~keep[order] & (sizes[a[order]] > 0) & (sizes[b[order]] > 0)]
    widest = lambda own, of: int(sizes[of[own]].max())
    at = 0
    while at < len(order):
        end = min(len(order), at + max(1, most // int(sizes[a[order[at]]] * sizes[b[order[at]]])))
        while end > at + 1 and (end - at) * widest(order[at:end], a) * widest(order[at:end], b) > most:
            end = at + max(1, (end - at) * 7 // 8)
        own = order[at:end]
        at = end
        # an image with fewer corners has its last repeated, by which no least changes
        p, q = (starts[i[own], None] + np.minimum(np.arange(widest(own, i)), sizes[i[own], None] - 1) for i in (a, b))
        x, y = bits[p], bits[q]
        apart = np.zeros((len(own), p.shape[1], q.shape[1]), np.uint16)
        for word in range(WORDS):
            apart += np.bitwise_count(x[:, :, None, word] ^ y[:, None, :, word])
        enough = np.maximum(least_agreeing, least_share * np.minimum(sizes[a[own]], sizes[b[own]]))
        limit = _worth(sizes[b[own]])[:, None]
        ok = np.ones(len(own), bool)
        for i, axis in ((b, 1), (a, 2)):
            worth = limit - apart.min(axis=axis)
            worth[(worth < 0) | (np.arange(worth.shape[1]) >= sizes[i[own], None])] = 0
            ok &= ((worth > 0).sum(axis=1) >= enough) & (worth.sum(axis=1) + 1e-6 >= least_evidence)
        own, worth, enough = own[ok], worth[ok], enough[ok]
        near = np.take_along_axis(q[ok], apart[ok].argmin(axis=2), axis=1)
        # corners that are worth something come first, and no more are looked at
        first = np.argsort(worth <= 0, axis=1, kind="stable")[:, : int((worth > 0).sum(axis=1).max(initial=0))]
        worth, p, q = np.take_along_axis(worth, first, axis=1), places[np.take_along_axis(p[ok], first, axis=1)], places[np.take_along_axis(near, first, axis=1)]
        near_by = (worth > 0)[:, None, :] & (worth > 0)[:, :, None]
        for vote, around in zip(_votes(p, q), (0, 0, 2 * math.pi / 0.35, 0), strict=True):
            off = np.abs(vote[:, None, :] - vote[:, :, None])
            near_by &= (np.minimum(off, around - off) if around else off) <= 1 + 1e-3
        ok = near_by.sum(axis=2).max(axis=1, initial=0) >= enough
        keep[own] = ok & ((near_by @ worth[:, :, None])[:, :, 0].max(axis=1, initial=0) + 1e-6 >= least_evidence)
    return keep


def describe_images(df: DataFrame, key: str, image: str) -> DataFrame:
    """(image_id, same, places, bits): places and descriptors as bytes; ``same`` is a hash of the decoded grey levels, by which equal images are one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), "image", 4 << 20):
                data = batch.column("image").to_pylist()
                decoded = [decode(d) for d in data]
                rows = describe_all(decoded)
                same = [hash_of(i, d, k) for i, d, k in zip(decoded, data, batch.column("image_id").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("image_id"), pa.array(same, pa.binary()), pa.array([p.astype("<f4").tobytes() for p, _ in rows], pa.binary()), pa.array([b.tobytes() for _, b in rows], pa.binary())], names=["image_id", "same", "places", "bits"])

    return df.select(F.col(key).cast("long").alias("image_id"), F.col(image).cast("binary").alias("image")).mapInArrow(run, "image_id bigint, same binary, places binary, bits binary")


def hash_of(image: np.ndarray | None, data: bytes | None, key: int | None) -> bytes:
    """Of the grey levels; of the bytes of what cannot be read; of the key where there is no image, as nulls are no copies of one another."""
    raw = repr(image.shape).encode() + image.tobytes() if image is not None else f"null {key}".encode() if data is None else b"raw" + data
    return hashlib.blake2b(raw, digest_size=16).digest()


@cache
def _chosen_bits() -> np.ndarray:
    """The descriptors' bits in a fixed mixed order: those of each key, then at the end those that are compared."""
    return np.random.default_rng(7).permutation(64 * WORDS)


def near_corners(places: np.ndarray, part: np.ndarray, among: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(corners of ``part``, their ``NEIGHBOURS`` nearest ``among`` which are ``least`` off or more), of as near ones the first.

    Corners are in reading order, so a part is a strip: its surroundings are
    looked at first, and all only for corners that do not have enough there.
    """
    reach = 16 * least
    y = places[part, 0]
    around = among[(places[among, 0] >= y.min() - reach) & (places[among, 0] <= y.max() + reach)]
    for own, held, bound in ((part, around, reach), (None, among, np.inf)):
        own = rest if own is None else own
        if not len(own):
            return
        apart = np.hypot(places[held, 0] - places[own, 0][:, None], places[held, 1] - places[own, 1][:, None])
        apart = np.where(apart >= least, apart, np.inf)
        near = np.argsort(apart, axis=1, kind="stable")[:, :NEIGHBOURS]
        far = np.take_along_axis(apart, near, axis=1)
        # what lies outside the surroundings is farther than the reach
        enough = (far.shape[1] == NEIGHBOURS) & (far <= bound).all(axis=1) if len(held) < len(among) else np.ones(len(own), bool)
        rest = own[~enough]
        ok = np.isfinite(far[enough]).ravel()
        yield np.repeat(own[enough], near.shape[1])[ok], held[near[enough].ravel()][ok]
        if len(held) == len(among):
            return


def doublets(places: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, check, layout) of each two corners of one scale of which one is among the other's nearest, three pixels off or more; each with a column for each band.

    A key has the smaller of the two descriptors' bits above the larger, and the
    corner with the smaller ones is the first, so each two are one doublet in
    any image. check has further bits of the first and the second. layout has
    the direction to the second corner against the first's angle, the difference
    of their angles, and the logarithm of their distance, in steps.
    """
    return doublets_of_all(places, bits, np.zeros(len(places), np.int64))[1:]


def _near_in_groups(places: np.ndarray, starts: np.ndarray, sizes: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``near_corners`` gives for each group of corners among themselves, of small groups that lie one after another."""
    most = int(sizes.max())
    step = np.arange(most)
    held = step < sizes[:, None]
    at = np.where(held, starts[:, None] + step, starts[:, None])
    y, x = places[at, 0], places[at, 1]
    apart = np.hypot(y[:, None, :] - y[:, :, None], x[:, None, :] - x[:, :, None])
    apart = np.where((apart >= least[:, None, None]) & held[:, None, :] & held[:, :, None], apart, np.inf)
    near = np.argsort(apart, axis=2, kind="stable")[:, :, :NEIGHBOURS]
    ok = np.isfinite(np.take_along_axis(apart, near, axis=2))
    group, own, _ = np.nonzero(ok)
    return at[group, own], at[group, near[ok]]


def doublets_of_all(places: np.ndarray, bits: np.ndarray, image: np.ndarray, small: int = 48, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(image, keys, check, layout): ``doublets`` of each image, whose corners lie one after another by image and scale. Images with few corners are taken together, up to ``most`` distances at a time."""
    n = len(places)
    near_of = []
    new = np.flatnonzero(np.concatenate([[True], (image[1:] != image[:-1]) | (places[1:, 2] != places[:-1, 2])])) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.append(new, n))
    pairs_of = lambda i, j: np.minimum(i, j) * n + np.maximum(i, j)
    few = np.flatnonzero((sizes > 1) & (sizes <= small))
    few = few[np.argsort(sizes[few], kind="stable")]
    step = max(1, most // (small * small))
    for own in (few[at : at + step] for at in range(0, len(few), step)):
        near_of.append(pairs_of(*_near_in_groups(places, new[own], sizes[own], 3 * places[new[own], 2])))
    for group in np.flatnonzero(sizes > small):
        at = np.arange(new[group], new[group] + sizes[group])
        for part in np.array_split(at, len(at) // 256 + 1):
            near_of.extend(pairs_of(i, j) for i, j in near_corners(places, part, at, 3 * places[new[group], 2]))
    pairs = np.unique(np.concatenate(near_of)) if near_of else np.zeros(0, np.int64)
    if not len(pairs):
        return np.zeros(0, np.int64), np.zeros((0, BANDS), np.uint32), np.zeros((0, BANDS, 2), np.uint32), np.zeros((0, BANDS, 3), np.uint8)
    i, j = pairs // n, pairs % n
    one = np.unpackbits(bits.view(np.uint8).reshape(n, -1), axis=1, bitorder="little")[:, _chosen_bits()]

    def pack(part: np.ndarray) -> np.ndarray:
        packed = np.zeros((n, 8), np.uint8)
        found = np.packbits(part, axis=1, bitorder="little")
        packed[:, : found.shape[1]] = found
        return packed.view("<u8")[:, 0]

    band = np.column_stack([pack(one[:, k * BAND_BITS : (k + 1) * BAND_BITS]) for k in range(BANDS)])
    last = pack(one[:, -CHECK_BITS:]).astype(np.uint32)
    around = lambda angle: (np.rint(angle / (2 * math.pi) * TURN_STEPS).astype(np.int64) % TURN_STEPS).astype(np.uint8)

    def layout(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        dy, dx = places[b, 0] - places[a, 0], places[b, 1] - places[a, 1]
        length = np.rint(np.log2(np.hypot(dy, dx) / places[a, 2]) * LENGTH_STEPS).clip(0, 255).astype(np.uint8)
        return np.column_stack([around(np.arctan2(dy, dx) - places[a, 3]), around(places[b, 3] - places[a, 3]), length])

    turned = band[i] > band[j]  # by band
    low, high = np.where(turned, band[j], band[i]), np.where(turned, band[i], band[j])
    check = np.where(turned[:, :, None], np.column_stack([last[j], last[i]])[:, None, :], np.column_stack([last[i], last[j]])[:, None, :])
    return image[i], (low << np.uint64(BAND_BITS) | high).astype(np.uint32), check, np.where(turned[:, :, None], layout(j, i)[:, None, :], layout(i, j)[:, None, :])


def alike(check: np.ndarray, layout: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the positions ``x`` and ``y`` of doublets of one key that have near descriptors and lie alike."""
    for column, apart in ((2, LENGTH_APART), (1, TURN_APART), (0, TURN_APART)):
        off = layout[:, column]
        if column == 2:
            near = np.abs(off[x].astype(np.int16) - off[y]) <= apart
        else:  # a full turn is as many steps as a byte has values
            near = off[x] - off[y] + np.uint8(apart) <= 2 * apart
        x, y = x[near], y[near]
    near = np.bitwise_count(check[x] ^ check[y]).sum(axis=1) <= CHECK_DIFFERING
    return x[near], y[near]


def _of_images(batch: pa.RecordBatch, most: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(row, keys, check, layout) of the doublets of a batch's images, of rows in order; of images with ``most`` corners together, or of one image."""
    sizes = np.array([len(b) // (8 * WORDS) for b in batch.column("bits").to_pylist()], np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        part = batch.slice(at, end - at)
        places, bits = (b"".join(part.column(c).to_pylist()) for c in ("places", "bits"))
        yield doublets_of_all(np.frombuffer(places, "<f4").reshape(-1, 4).astype(float), np.frombuffer(bits, "<u8").reshape(-1, WORDS), np.repeat(np.arange(at, end), sizes[at:end]))
        at = end


def first_pairs(classes: DataFrame) -> DataFrame:
    """(a, b): under each of an image's ``SKETCH`` least keys, by their hash, the image and one of those that have the key, another for each key.

    That joins a large group of copies by few pairs: of the group's images each
    has the same chance to be a key's centre, and they share most keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in range(7)]
            images = batch.column("image").to_numpy()
            for row, keys, check, layout in _of_images(batch):
                flat, row = (np.arange(BANDS, dtype=np.uint64) << np.uint64(32) | keys).ravel(), np.repeat(row, BANDS)
                mixed = flat * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                at = np.lexsort((mixed, row))
                new = np.concatenate([[True], (row[at][1:] != row[at][:-1]) | (mixed[at][1:] != mixed[at][:-1])])[: len(at)]
                at = at[new]  # the first of each of an image's keys
                at = at[np.arange(len(at)) - np.searchsorted(row[at], row[at]) < SKETCH]
                check, layout = check.reshape(-1, 2), layout.reshape(-1, 3)
                for held, values in zip(out, (flat[at].view(np.int64), images[row[at]], *check[at].T.astype(np.int64), *layout[at].T.astype(np.int32)), strict=True):
                    held.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held)) for held in out], names=["key", "image", "c", "e", "d", "t", "l"])

    rows = classes.select("image", "places", "bits").mapInArrow(run, "key bigint, image bigint, c bigint, e bigint, d int, t int, l int")
    rows = written(rows, "image-sketches")
    centre = rows.groupBy("key").agg(F.min_by(F.struct("image", "c", "e", "d", "t", "l"), F.xxhash64("image", "key")).alias("o"), F.count("*").alias("n")).where(F.col("n") > 1)
    met = rows.join(centre, "key").where(F.col("image") != F.col("o.image"))
    turned = lambda x: F.least(F.abs(F.col(x) - F.col(f"o.{x}")), TURN_STEPS - F.abs(F.col(x) - F.col(f"o.{x}"))) <= TURN_APART
    lie = turned("d") & turned("t") & (F.abs(F.col("l") - F.col("o.l")) <= LENGTH_APART)
    near = F.bit_count(F.col("c").bitwiseXOR(F.col("o.c"))) + F.bit_count(F.col("e").bitwiseXOR(F.col("o.e"))) <= CHECK_DIFFERING
    return met.where(lie & near).select(F.greatest("image", "o.image").alias("a"), F.least("image", "o.image").alias("b")).distinct()


def crossing(key: np.ndarray, label: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs with one key and different labels, of rows in order of key and label, about ``most`` at a time: what has the key and the same label is passed over without being looked at."""
    n = len(key)
    if not n:
        return
    key_end = np.searchsorted(key, key, side="right")
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (label[1:] != label[:-1])])
    ends = np.append(np.flatnonzero(new)[1:], n)
    own_end = ends[np.cumsum(new) - 1]
    count = key_end - own_end
    first = np.flatnonzero(count)
    total = np.cumsum(count[first])
    at = 0
    while at < len(first):
        end = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, side="right")))
        rows, many = first[at:end], count[first[at:end]]
        step = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        yield np.repeat(rows, many), np.repeat(own_end[rows], many) + step
        at = end


def meetings(key: np.ndarray, image: np.ndarray, label: np.ndarray, check: np.ndarray, layout: np.ndarray) -> tuple[np.ndarray, int]:
    """(the pairs of images of different labels, the greater above the lesser, that have doublets of one key that are alike; how many pairs of doublets were looked at)."""
    found, looked_at = [np.zeros((2, 0), np.int64)], 0
    by_key, by_label = (np.unique(x, return_inverse=True)[1] for x in (key, label))
    sectors = TURN_STEPS // (2 * TURN_APART)
    sector = lambda column, turned: (layout[:, column].astype(np.int64) + turned) % TURN_STEPS // (2 * TURN_APART)
    # doublets that lie alike share a sector of one of two divisions of the circle, half a sector apart; so for the direction and for the turn
    for i, j in ((0, 0), (0, TURN_APART), (TURN_APART, 0), (TURN_APART, TURN_APART)):
        own = (by_key * sectors + sector(0, i)) * sectors + sector(1, j)
        order = np.argsort(own * (len(key) + 1) + by_label) if len(key) < 1 << 27 else np.lexsort((by_label, own))
        held = check[order], np.asfortranarray(layout[order])
        for x, y in crossing(own[order], by_label[order]):
            looked_at += len(x)
            x, y = (image[order[at]] for at in alike(*held, x, y))
            if len(x):
                found.append(np.stack([np.maximum(x, y), np.minimum(x, y)]))
            if len(found) > 64:
                found = [np.unique(np.concatenate(found, axis=1), axis=1)]
    return np.unique(np.concatenate(found, axis=1), axis=1), looked_at


def crossing_pairs(labelled: DataFrame, part_rows: int = 1 << 20) -> DataFrame:
    """(a, b): all images (image, places, bits, label) of different labels of which doublets meet under a key and are alike.

    Doublets are dealt by a hash of their key, packed in columns of bytes, and
    each is compared with all of its key, of about its direction and turn, that
    have another label. A task holds
    one part of the keys, of about ``part_rows`` doublets by the images' corners;
    a key is in one part.
    """
    n_corners = (labelled.agg(F.sum(F.octet_length("bits"))).first()[0] or 0) // (8 * WORDS)
    parts = max(int(labelled.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_corners * NEIGHBOURS // 2 * BANDS // part_rows)
    names = ["part", "bands", "keys", "owners", "checks", "layouts", "images", "labels"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, 256) for at in range(0, whole.num_rows, 256)):
                owner, keys, check, layout = (np.concatenate(x) for x in zip(*_of_images(batch), strict=True))
                if not len(keys):
                    continue
                owner, keys = np.repeat(owner, BANDS).astype(np.uint8), keys.ravel()
                bands = np.tile(np.arange(BANDS, dtype=np.uint8), len(keys) // BANDS)
                flat = bands.astype(np.uint64) << np.uint64(32) | keys
                check, layout = check.reshape(-1, 2), layout.reshape(-1, 3)
                mixed = flat * np.uint64(0xD6E8FEB86659FD93)
                part = ((mixed ^ mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                values, starts = np.unique(part[order], return_index=True)
                images, labels = (batch.column(c).to_numpy().astype("<i8") for c in ("image", "label"))
                rows = []
                for value, o in zip(values.tolist(), np.split(order, starts[1:]), strict=True):
                    own, at = np.unique(owner[o], return_inverse=True)  # only the images that are in the part
                    rows.append((value, bands[o].tobytes(), keys[o].tobytes(), at.astype(np.uint8).tobytes(), check[o].tobytes(), layout[o].tobytes(), images[own].tobytes(), labels[own].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64() if i == 0 else pa.binary()) for i in range(len(names))], names=names)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        images = [np.frombuffer(x, "<i8") for x in group["images"]]
        labels = [np.frombuffer(x, "<i8") for x in group["labels"]]
        owners = [np.frombuffer(x, np.uint8) for x in group["owners"]]
        key = np.frombuffer(b"".join(group["bands"]), np.uint8).astype(np.uint64) << np.uint64(32) | np.frombuffer(b"".join(group["keys"]), np.uint32)
        check = np.frombuffer(b"".join(group["checks"]), np.uint32).reshape(-1, 2)
        layout = np.frombuffer(b"".join(group["layouts"]), np.uint8).reshape(-1, 3)
        image, label = (np.concatenate([x[o] for x, o in zip(held, owners, strict=True)]) for held in (images, labels))
        a, b = meetings(key, image, label, check, layout)[0]
        return pd.DataFrame({"a": a, "b": b})

    dealt = labelled.select("image", "places", "bits", "label").mapInArrow(deal, ", ".join(["part bigint", *[f"{n} binary" for n in names[1:]]]))
    return dealt.groupBy("part").applyInPandas(meet, "a bigint, b bigint").distinct()


def may_agree(pairs: DataFrame, classes: DataFrame, least_agreeing: int, least_share: float, least_evidence: float, block_bytes: int = 96 << 20) -> DataFrame:
    """The pairs (a, b) of images for which ``bounds`` does not rule out that they agree enough: pairs that meet by chance are most, and nearly all end here.

    Images are dealt to blocks of about ``block_bytes`` of corners; a task has
    two blocks and all pairs between them, so corners are shuffled once for each
    block, not for each pair.
    """
    total = classes.agg(F.sum(F.octet_length("bits") + F.octet_length("places"))).first()[0] or 0
    blocks = max(-(-total // block_bytes), round(math.sqrt(2 * pairs.sparkSession.sparkContext.defaultParallelism)))
    block = lambda image: F.pmod(F.xxhash64(image), F.lit(blocks))
    group = lambda x, y: F.least(x, y) * blocks + F.greatest(x, y)

    def flat(column: pa.ChunkedArray, kind: str) -> np.ndarray:
        held = column.combine_chunks()
        held = held if isinstance(held, pa.Array) else pa.concat_arrays(held.chunks)
        _, offsets, data = held.buffers()
        first, *_, end = np.frombuffer(offsets, np.int32, len(held) + 1, 4 * held.offset)
        return np.frombuffer(data, kind, (end - first) // np.dtype(kind).itemsize, first) if end > first else np.zeros(0, kind)

    def run(met: pa.Table, images: pa.Table) -> pa.Table:
        met = met.select(["a", "b"])
        if not met.num_rows:
            return met
        ids = images.column("image").to_numpy()
        sizes = pc.binary_length(images.column("bits")).to_numpy().astype(np.int64) // (8 * WORDS)
        corners = flat(images.column("places"), "<f4").reshape(-1, 4), flat(images.column("bits"), "<u8").reshape(-1, WORDS), np.cumsum(sizes) - sizes, sizes
        order = np.argsort(ids)
        a, b = (order[np.searchsorted(ids, met.column(c).to_numpy(), sorter=order)] for c in ("a", "b"))
        keep = [bounds(*corners, a[at : at + (1 << 16)], b[at : at + (1 << 16)], least_agreeing, least_share, least_evidence) for at in range(0, len(a), 1 << 16)]
        return met.filter(pa.array(np.concatenate(keep)))

    dealt = pairs.select("a", "b", group(block("a"), block("b")).alias("g"))
    own = classes.select("image", "places", "bits", block("image").alias("own"))
    held = own.select("image", "places", "bits", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: group(F.col("own"), i.cast("long")))).alias("g"))
    return dealt.groupBy("g").cogroup(held.groupBy("g")).applyInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, classes: DataFrame, least_agreeing: int, least_share: float, least_evidence: float) -> DataFrame:
    """The pairs (a, b) of images that agree enough."""
    left = classes.select(F.col("image").alias("a"), F.col("places").alias("pa"), F.col("bits").alias("ba"))
    right = classes.select(F.col("image").alias("b"), F.col("places").alias("pb"), F.col("bits").alias("bb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for xp, xb, yp, yb in zip(*(batch.column(c).to_pylist() for c in ("pa", "ba", "pb", "bb")), strict=True):
                x, y = (np.frombuffer(b, "<u8").reshape(-1, WORDS) for b in (xb, yb))
                p, q = (np.frombuffer(b, "<f4").reshape(-1, 4) for b in (xp, yp))
                corners, evidence = consensus(p, x, q, y)
                keep.append(corners >= max(least_agreeing, least_share * min(len(x), len(y))) and evidence >= least_evidence)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "pa", "ba", "pb", "bb").mapInArrow(run, "a bigint, b bigint")


def copies(df: DataFrame, key: str, image: str, least_agreeing: int = 4, least_share: float = 0.15, least_evidence: float = 120.0) -> DataFrame:
    """(image_id, component_id) of every row: copies, whole, cropped or edited, have one component, the smallest id reachable.

    Equal images are one class. Classes that meet in the tables are linked if at
    least ``least_agreeing`` corners, and ``least_share`` of those of the image
    that has fewer, agree on a shift, turn and scale, with ``least_evidence`` in
    bits. Pairs come in two steps: first a few for each image, which join most
    of a large group; then all that meet between different groups. So whatever
    meets is either verified or joined already, and a group of n copies makes
    about n pairs.

    Null and cornerless images link to no others; those that are not read are
    one class if their bytes are equal. Repeated rows stay; rows with a null id
    take part and have their class's component; an empty table gives no rows;
    other columns are not read.
    """
    rows, described = placed(describe_images(df, key, image), "image-descriptors")
    classes = rows.groupBy("same").agg(F.min("image_id").alias("image"), F.first("places").alias("places"), F.first("bits").alias("bits"))
    classes = written(classes.where(F.col("image").isNotNull()), "image-classes")
    rows = written(rows.select("image_id", "same"), "image-hashes")
    dropped(df.sparkSession, described)
    rules = (least_agreeing, least_share, least_evidence)
    links = written(verified(written(first_pairs(classes), "image-first-pairs"), classes, *rules), "image-first-links")
    roots = components(links)
    labelled = classes.join(roots, F.col("image") == F.col("node"), "left").select("image", "places", "bits", F.coalesce("root", "image").alias("label"))
    labelled, beside = placed(labelled, "image-labels")
    met = written(crossing_pairs(labelled), "image-pairs")
    dropped(df.sparkSession, beside)
    more = verified(written(may_agree(met, classes, *rules), "image-likely-pairs"), classes, *rules)
    roots = components(written(more, "image-links").unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    found = classes.join(roots, F.col("image") == F.col("node"), "left")
    found = written(found.select("same", F.coalesce("root", "image").alias("component_id")), "image-components")
    return rows.join(found, "same", "left").select("image_id", "component_id")


def thumbnails(vector: Column, side: int = 8, factor: int = 4) -> Column:
    """Vectors of side * side numbers as images: binary PGM, each number a grey level about 128 by the vector's own spread, enlarged smoothly. A null vector, one of another size, or with a number that is null or not finite, is null."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf(T.BinaryType())
    def draw(column: pd.Series) -> pd.Series:
        out: list[bytes | None] = [None] * len(column)
        sized = [i for i, v in enumerate(column) if v is not None and len(v) == side * side]
        for part in (sized[at : at + 64] for at in range(0, len(sized), 64)):
            # a null number is not finite, as floats have it
            grid = np.array([np.asarray(column.iloc[i], np.float64) for i in part])
            finite = np.isfinite(grid).all(axis=1)
            grid = grid[finite]
            off = grid - grid.mean(axis=1, keepdims=True)
            spread = np.abs(off).max(axis=1, keepdims=True, initial=0.0)
            grey = (128 + 127 * off / np.where(spread > 0, spread, 1.0)).astype(np.float32)
            level = resized(grey.reshape(-1, side, side), side * factor, side * factor)
            for i, drawn in zip(np.array(part)[finite].tolist(), np.rint(level).clip(0, 255).astype(np.uint8), strict=True):
                out[i] = b"P5\n%d %d\n255\n" % (side * factor, side * factor) + drawn.tobytes()
        return pd.Series(out, dtype=object)

    return draw(vector)
