"""DartMinHash signatures of weighted word shingles, in numpy, for many texts at a time.

The elements of a text are its shingles of five words (all its words, if fewer), weighted by how often they occur. An
element's weight axis is cut into the regions [0,1), [1,2), [2,4), [4,8), ... . Hashed darts fall into a region as a Poisson
process over ranks, as dense as the region is wide; each has a weight inside the region and one of K coordinates, all from
hashes of the element, the region and the dart's number, so that texts that share an element share its darts. A dart counts
if its weight is below the element's. A coordinate keeps its earliest dart. Two texts agree in a coordinate with the
probability of their weighted Jaccard similarity.

Ranks are followed up to (K ln K + 3 K) / total weight, where nearly all coordinates have a dart; texts with an empty
coordinate go on with twice the rank. The work is in proportion to the elements plus K ln K.
"""

from __future__ import annotations

import math
import re

import numpy as np

from loomery.llm.licenses import WORD_BYTES

SHINGLE = 5
#: Bits of an element's hash within a text.
ELEMENT_BITS = 48
_FACTOR = 0x9E3779B97F4A7C15
_INVERSE = pow(_FACTOR, -1, 1 << 64)
_OF_BYTE = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BLANKS = re.compile(rb" +")
NO_DART = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: each bit of the input moves about half of the output's."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    if n:
        out[1:] = np.uint64(base)
    return np.multiply.accumulate(out, out=out)


def normal(text: str) -> bytes:
    """The text's words with one blank between: the form in which texts count as equal."""
    return _BLANKS.sub(b" ", text.encode().translate(WORD_BYTES)).strip(b" ")


def elements(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in normal form: number of the text, hash and weight of each of its different shingles, in this order."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    lengths = np.array([len(t) for t in texts], np.int64) + 1
    text_end = np.cumsum(lengths)
    # Word hashes from prefix sums of a polynomial whose factor has an inverse, for all words at once.
    power, back = _powers(_FACTOR, len(data)), _powers(_INVERSE, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_OF_BYTE[data] * power[:-1])])
    blank = data == 32
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    ends = np.flatnonzero(blank & np.concatenate([[False], ~blank[:-1]]))
    words = mix((sums[ends] - sums[starts]) * back[starts])
    word_end = np.searchsorted(starts, text_end)  # words up to the end of each text
    counts = np.diff(np.concatenate([[0], word_end]))
    owner = np.repeat(np.arange(len(texts)), counts)
    left = np.repeat(word_end, counts) - np.arange(len(words))  # words from here to the text's end
    first = left == np.repeat(counts, counts)
    hashes = np.zeros(len(words), np.uint64)
    for j, factor in enumerate(_powers(0xD6E8FEB86659FD93, SHINGLE - 1)):
        shifted = np.concatenate([words[j:], np.zeros(min(j, len(words)), np.uint64)])
        hashes += np.where(left > j, shifted * factor, np.uint64(0))
    whole = (left >= SHINGLE) | first
    hashes, owner = mix(hashes[whole]), owner[whole]
    low = np.uint64((1 << ELEMENT_BITS) - 1)
    out_o, out_h, out_w = [], [], []
    step = 1 << (64 - ELEMENT_BITS)  # texts whose number fits above the hash
    for lo in range(0, len(texts), step):
        here = slice(*np.searchsorted(owner, [lo, lo + step]))
        keys, weights = np.unique((owner[here] - lo).astype(np.uint64) << np.uint64(ELEMENT_BITS) | hashes[here] & low, return_counts=True)
        out_o.append((keys >> np.uint64(ELEMENT_BITS)).astype(np.int64) + lo)
        out_h.append(keys & low)
        out_w.append(weights)
    return np.concatenate(out_o), np.concatenate(out_h), np.concatenate(out_w)


def signatures(owner: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k: the earliest dart of each coordinate, as rank bits above and dart hash below; NO_DART throughout without elements.

    owner (ascending), hashes and weights: as elements() gives them; weights may be any positive numbers.
    """
    best = np.full(n * k, NO_DART, np.uint64)
    total = np.bincount(owner, weights, minlength=n)
    reach = (k * math.log(k) + 3 * k) / np.maximum(total, 1e-300)
    todo = total > 0
    while todo.any():
        mine = todo[owner]
        _throw(owner[mine], hashes[mine], np.asarray(weights, float)[mine], reach, k, best)
        todo &= (best.reshape(n, k) == NO_DART).any(axis=1)
        reach = np.where(todo, 2 * reach, reach)
    return best.reshape(n, k)


def _throw(owner, hashes, weights, reach, k, best) -> None:
    region, low, high = 0, 0.0, 1.0
    while len(owner):
        width = high - low
        seeds = mix(hashes + np.uint64((region + 1) * 0xA0761D6478BD642F & (1 << 64) - 1))
        at, rank, number = np.arange(len(owner)), np.zeros(len(owner)), 0
        while len(at):
            number += 1
            draw = mix(seeds[at] + np.uint64(number * _FACTOR & (1 << 64) - 1))
            # The gap to the next dart's rank is exponential.
            rank = rank - np.log(((draw >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / width
            inside = rank <= reach[owner[at]]
            at, rank, draw = at[inside], rank[inside], draw[inside]
            dart = mix(draw)
            if weights[at].min(initial=high) < high:
                # Where a dart falls on the weight axis matters only in the region that holds the element's own weight.
                place = low + width * (mix(dart) >> np.uint64(11)).astype(float) * 2.0**-53
                hit = place < weights[at]
            else:
                hit = slice(None)
            cell = owner[at][hit] * k + ((dart[hit] >> np.uint64(40)) % np.uint64(k)).astype(np.int64)
            bits = rank[hit].astype(np.float32).view(np.uint32).astype(np.uint64)  # of positive numbers, in their order
            np.minimum.at(best, cell, bits << np.uint64(32) | dart[hit] & np.uint64(0xFFFFFFFF))
        region, low, high = region + 1, high, 2 * high
        more = weights > low
        owner, hashes, weights = owner[more], hashes[more], weights[more]


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard of (ascending hashes, weights) of two texts; two texts without elements are equal."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum())
    both = float(a[1].sum()) + float(b[1].sum()) - shared
    return shared / both if both else 1.0
