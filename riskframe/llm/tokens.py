"""Token ids of whole texts, each distinct stretch of text encoded once.

A text is cut before a single space or line break that follows a character other than white space, after such a line
break, and between a letter and the punctuation after it. Both kinds of vocabulary used here split a text at all these
places before they look for tokens, so the ids of the stretches, one after the other, are the ids of the text.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism

#: Runs of white space, where a cut could move a token border; the mark used below; and what can be a special token.
#: Such texts are cut with more care.
_ODD = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}][ \n]|\n[\s\x0b\x1c-\x1f\x{85}\p{Z}]|\x01|<\|"
_CAREFUL = re.compile(r"(?<=\S)(?=[ \n])")
_MARKED = r"(\pL)([.,!?|#%*$&;:])"
_MOST = 1_500_000  # stretches, and their ids, that a worker remembers before it lets go those its last batch did not use
_MOST_IDS = 8_000_000


class Encoder:
    """Encodes texts. Known stretches stand before a batch's own when those are numbered, so their numbers find their ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known = pa.array([], pa.string())
        self.begins, self.sizes, self.store = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _keep(self, used: np.ndarray) -> None:
        """Remember only the stretches with these numbers."""
        self.known = self.known.take(pa.array(used))
        sizes, begins = self.sizes[used], self.begins[used]
        self.store = self.store[_places(begins, sizes)]
        self.sizes, self.begins = sizes, np.cumsum(sizes) - sizes

    def _numbers(self, flat: pa.Array) -> np.ndarray:
        """The number of each stretch among the known ones; new ones are encoded and known from here on."""
        coded = pa.concat_arrays([self.known, flat]).dictionary_encode()
        codes, old = np.asarray(coded.indices)[len(self.known):].astype(np.int64), len(self.known)
        fresh, sizes, ids = coded.dictionary[old:].to_pylist(), [], []
        for k in range(0, len(fresh), 20_000):
            encoded = [e.ids for e in self.tokenizer.encode_batch_fast(fresh[k:k + 20_000], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, encoded), dtype=np.int64, count=len(encoded)))
            ids.append(np.fromiter(chain.from_iterable(encoded), dtype=np.uint32, count=int(sizes[-1].sum())))
        if fresh:
            self.known = coded.dictionary
            self.sizes, self.store = np.concatenate([self.sizes, *sizes]), np.concatenate([self.store, *ids])
            self.begins = np.cumsum(self.sizes) - self.sizes
        return codes

    @staticmethod
    def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All stretches in order, and the text of each."""
        odd = np.asarray(pc.match_substring_regex(texts, _ODD))
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        marked = pc.replace_substring(pc.replace_substring(plain, "\n", "\x01\n\x01"), " ", "\x01 ")
        lists = pc.split_pattern(pc.replace_substring_regex(marked, _MARKED, "\\1\x01\\2"), "\x01")
        row = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
        flat = lists.flatten()
        if odd.any():
            extra = [(i, s) for i in np.flatnonzero(odd) for s in _CAREFUL.split(texts[int(i)].as_py())]
            keep = ~odd[row]
            flat = pa.concat_arrays([flat.filter(pa.array(keep)), pa.array([s for _, s in extra], flat.type)])
            row = np.concatenate([row[keep], np.array([i for i, _ in extra], dtype=np.int64)])
            order = np.argsort(row, kind="stable")
            flat, row = flat.take(pa.array(order)), row[order]
        return flat, row

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed with ``end``, and the number of ids of each text (null: an empty text)."""
        flat, row = self._cut(pc.fill_null(texts, ""))
        codes = self._numbers(flat)
        out = self.sizes[codes]
        lengths = np.bincount(row, weights=out, minlength=len(texts)).astype(np.int64) + 1
        ids = np.full(int(lengths.sum()), end, dtype=np.uint32)
        # The ids of a text stand one place further for every text before it, whose end id comes in between.
        ids[np.arange(int(out.sum())) + np.repeat(row, out)] = self.store[_places(self.begins[codes], out)]
        if len(self.known) > _MOST or len(self.store) > _MOST_IDS:
            self._keep(np.unique(codes))
        return ids, lengths


def _places(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each stretch, one after the other."""
    return np.arange(int(sizes.sum())) + np.repeat(begins - (np.cumsum(sizes) - sizes), sizes)


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)
