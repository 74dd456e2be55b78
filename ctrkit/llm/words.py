"""Lower-case words of whole text columns, each distinct word once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Signs that are cut off either end of a word.
SIGNS = "".join(chr(c) for c in range(33, 128) if not chr(c).isalnum()) + "«»„“”‚‘’…–—¿¡"


def word_index(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words, place of every word among them, offsets of the texts in that).

    Words are split at ASCII white space, lower-cased and freed of signs at their ends; what is
    empty then is left out.
    """
    split = pc.ascii_split_whitespace(pc.utf8_lower(texts))
    starts = split.offsets.to_numpy().astype(np.int64) - split.offsets[0].as_py()
    coded = pc.dictionary_encode(split.flatten())
    bare = [w.strip(SIGNS) for w in coded.dictionary.to_pylist()]
    place = {w: i for i, w in enumerate(dict.fromkeys(w for w in bare if w))}
    to = np.fromiter((place.get(w, -1) for w in bare), np.int64, len(bare))
    index = to[coded.indices.to_numpy()]
    full = index >= 0
    return list(place), index[full], np.concatenate([[0], np.cumsum(full)])[starts]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the rows of each stretch; empty ones give zeros."""
    out = np.zeros((len(offsets) - 1, *values.shape[1:]), np.float64)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = np.add.reduceat(values, offsets[full], axis=0, dtype=np.float64)
    return out
