"""Byte-level BPE of whole text columns with the ``tokenizers`` library.

The library encodes a distinct space-led unit once; texts are put together from those ids.
Byte-level BPE cuts a text before every single space that follows or precedes other
characters, so the ids of a text are the ids of its units in turn. Texts where that does
not hold (two spaces in a row, the string of an added token) go through the library whole.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ctrkit.llm.common import process_store

#: Distinct units whose ids a worker remembers, in two halves: when the young one is full it becomes the old
#: one, and the old one goes.
CACHE_UNITS = 400_000


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class UnitEncoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``.

    A text with the string of an added token goes through the library whole, which gives that
    token's id; with ``specials_as_text`` such strings count as ordinary text.
    """

    def __init__(self, path: str, cache_units: int = CACHE_UNITS, specials_as_text: bool = False):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        store = process_store("bpe")
        if path not in store:
            tok = Tokenizer.from_file(path)
            tok.encode_special_tokens = True
            added = [t.content for t in tok.get_added_tokens_decoder().values()]
            store[path] = (tok, tok.model, [{}, {}], Tokenizer.from_file(path), added)
        self.tokenizer, self.model, self.known, self.default, self.added = store[path]
        if specials_as_text:
            self.default, self.added = self.tokenizer, []
        self.cache_units = cache_units
        self.alphabet = byte_alphabet()
        self.space = self.alphabet[ord(" ")]

    def _words(self, word: str) -> bytes:
        """Ids of letters after at most one space: one pre-token, so the model alone applies."""
        if word.isascii():
            mapped = self.space + word[1:] if word[0] == " " else word
        else:
            mapped = word.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _lookup(self, units: list[str]) -> list[bytes]:
        young, old = self.known
        out, hard = list(map(young.get, units)), []
        for at, unit in enumerate(units):
            if out[at] is None:
                ids = old.get(unit)
                if ids is None:
                    ids = self._easy(unit)
                if ids is None:
                    hard.append(at)
                else:
                    out[at] = ids
                    self._remember(unit, ids)
        if hard:
            found = self.tokenizer.encode_batch_fast([units[at] for at in hard], add_special_tokens=False)
            for at, enc in zip(hard, found):
                out[at] = array("I", enc.ids).tobytes()
                self._remember(units[at], out[at])
        return out

    def _remember(self, unit: str, ids: bytes) -> None:
        young = self.known[0]
        young[unit] = ids
        if len(young) > self.cache_units // 2:
            self.known[:] = {}, young

    def _easy(self, unit: str) -> bytes | None:
        """Letters, with or without a comma or full stop after them and a space before."""
        core = unit[1:] if unit[:1] == " " else unit
        if core.isalpha():
            return self._words(unit)
        if core[-1:] in (",", ".") and core[:-1].isalpha():
            return self._cached(unit[:-1]) + self._cached(unit[-1])
        return None

    def _cached(self, unit: str) -> bytes:
        young, old = self.known
        ids = young.get(unit) or old.get(unit)
        if ids is None:
            if unit.strip().isalpha():
                ids = self._words(unit)
            else:
                ids = array("I", self.tokenizer.encode(unit, add_special_tokens=False).ids).tobytes()
            self._remember(unit, ids)
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in turn, offsets of the texts in them)."""
        n = len(texts)
        hard = pc.match_substring(texts, "  ").to_numpy(zero_copy_only=False)
        for token in self.added:
            hard = hard | pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        simple = pc.if_else(pa.array(hard), "", texts) if hard.any() else texts
        pieces = pc.split_pattern(simple, " ")
        starts = pieces.offsets.to_numpy().astype(np.int64) - pieces.offsets[0].as_py()
        flat = pieces.flatten()
        coded = pc.dictionary_encode(flat)
        index = coded.indices.to_numpy().astype(np.int64)
        units = self._lookup([" " + u for u in coded.dictionary.to_pylist()])
        if n:
            # The first unit of a text has no space before it.
            head, own = np.unique(index[starts[:-1]], return_inverse=True)
            heads = self._lookup(coded.dictionary.take(pa.array(head)).to_pylist())
            index[starts[:-1]] = len(units) + own
            units += heads
        sizes = np.fromiter(map(len, units), np.int64, len(units)) // 4
        pool = np.frombuffer(b"".join(units), "<u4")
        begin = np.cumsum(sizes) - sizes
        counts = sizes[index]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        ids = pool[np.repeat(begin[index] - (ends - counts), counts) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[starts]
        if not hard.any():
            return ids, offsets
        rows = np.split(ids, offsets[1:-1])
        at = np.flatnonzero(hard)
        whole = self.default.encode_batch_fast([texts[int(i)].as_py() for i in at], add_special_tokens=False)
        for i, enc in zip(at, whole):
            rows[i] = np.array(enc.ids, "<u4")
        return np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
