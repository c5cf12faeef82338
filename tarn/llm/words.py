"""Words of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

ODD = np.random.default_rng(20240517).integers(1, 1 << 63, 1 << 12, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_table(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+``, with A-Z lower-cased; where each text's words begin
    (and the last end); each word's first byte and length; the bytes, as they are."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first = int(offsets[0]) if len(texts) else 0
    total = int(offsets[-1]) - first if len(texts) else 0
    data = np.frombuffer(texts.buffers()[2], np.uint8, total, first) if total else np.zeros(0, np.uint8)
    bounds = offsets - first
    raw = data
    data = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edge = bounds[:-1][bounds[:-1] < total]
    begins[edge] = inside[edge]
    kept = np.flatnonzero(inside)
    starts = np.flatnonzero(begins[kept])
    lengths = np.diff(np.append(starts, len(kept)))
    place = np.arange(len(kept)) - np.repeat(starts, lengths)
    # A byte's weight depends on its own place alone, never on what other words the batch holds.
    weight = ODD[place & 4095]
    far = np.flatnonzero(place > 4095)
    weight[far] *= ODD[4095 - (place[far] >> 12 & 4095)]
    words = np.add.reduceat((data[kept].astype(np.uint64) + np.uint64(1)) * weight, starts) if len(starts) else np.zeros(0, np.uint64)
    words = mix(words + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return words, np.searchsorted(kept[starts], bounds), kept[starts], lengths, raw


def word_hashes(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The first two of ``word_table``."""
    return word_table(texts)[:2]
