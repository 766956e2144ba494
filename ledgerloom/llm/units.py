"""Token ids of whole texts from the cached ids of their units.

A unit is a run of white space and the run of other characters after it. The
pre-token pattern of byte-level BPE never lets a match go on from another
character to white space, so units can be encoded one by one. Nearly all units
are a space and a word. A batch of texts is split, its units are numbered, and
known units are looked up by Arrow kernels; the tokenizer sees only units that
the worker doesn't know yet. Ids of texts are then gathered by numpy.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of the pre-token pattern; unlike Python's, without U+001C to U+001F.
_UNIT = re.compile(r"[^\S\x1c-\x1f]*[\S\x1c-\x1f]+|[^\S\x1c-\x1f]+")
_ENDS_WHITE = r"^$|[\pZ\t-\r\x{85}]\z"
_PUNCTUATION = ".,;:!?|&%$#*)\"]}"
#: Bytes of text that are looked at together, and of the units that a worker keeps.
BATCH_BYTES, KEPT_BYTES = 5 << 20, 32 << 20


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions starts[k] ... starts[k] + sizes[k] - 1 of all k, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    kind = np.int32 if total + int(starts.max(initial=0)) < 1 << 30 else np.int64
    found = np.repeat((starts - ends + sizes).astype(kind), sizes)
    found += np.arange(total, dtype=kind)
    return found


class UnitEncoder:
    """``encode(texts)`` gives all ids of an Arrow array of texts and the number of each text's.

    ``encode_many`` encodes a list of units. What it finds is kept, up to ``kept``
    bytes; then only what the last batch used stays.
    """

    def __init__(self, encode_many: Callable[[list[str]], list[list[int]]], kept: int = KEPT_BYTES):
        self.encode_many, self.kept = encode_many, kept
        self.units = pa.array([], pa.string())
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, units: pa.Array, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.flat = np.concatenate([self.flat, flat])
        self.units = pa.concat_arrays([self.units, units])

    def _find(self, units: pa.Array) -> np.ndarray:
        """The places of units among those that are known, -1 for others."""
        return pc.fill_null(pc.index_in(units, value_set=self.units), -1).to_numpy().astype(np.int64)

    def _forget(self, units: pa.Array) -> None:
        """Keeps only what these units need."""
        places = self._find(units)
        known, places = units.filter(pa.array(places >= 0)), places[places >= 0]
        flat, sizes = self.flat[_runs(self.starts[places], self.sizes[places])], self.sizes[places]
        self.__init__(self.encode_many, self.kept)
        self._add(known, flat, sizes)

    def _places(self, units: pa.Array) -> np.ndarray:
        """The places of distinct units, of which unknown ones are encoded and added.

        A word and the punctuation after it are encoded by themselves: between a
        letter and punctuation there is always a pre-token boundary.
        """
        places = self._find(units)
        unknown = places < 0
        if not unknown.any():
            return places
        units = units.filter(pa.array(unknown))
        cores = pc.utf8_rtrim(units, characters=_PUNCTUATION)
        parted = pc.and_(pc.not_equal(cores, units), pc.utf8_is_alpha(pc.utf8_ltrim(cores, characters=" ")))
        whole, units, cores = units.filter(pc.invert(parted)), units.filter(parted), cores.filter(parted)
        tails = pc.replace_substring_regex(pc.utf8_ltrim(units, characters=" "), pattern=r"^\pL+", replacement="")
        parts = pa.concat_arrays([whole, cores, tails]).dictionary_encode()
        of = self._find(parts.dictionary)
        new = parts.dictionary.filter(pa.array(of < 0))
        of[of < 0] = len(self.units) + np.arange(len(new))
        ids = [x for at in range(0, len(new), 4096) for x in self.encode_many(new.slice(at, 4096).to_pylist())]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        self._add(new, np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes.sum())), sizes)
        of = of[parts.indices.to_numpy()]
        two = of[len(whole) :].reshape(2, -1).T
        sizes, found = self.sizes[two], np.zeros(len(parted), np.int64)
        parted = parted.to_numpy(zero_copy_only=False)
        found[~parted], found[parted] = of[: len(whole)], len(self.units) + np.arange(len(units))
        self._add(units, self.flat[_runs(self.starts[two].ravel(), sizes.ravel())], sizes.sum(axis=1))
        places[unknown] = found
        return places

    def _gather(self, units: pa.Array, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts given as codes of distinct units; ``ends`` has each text's last code's place."""
        if self.units.nbytes + self.flat.nbytes + self.starts.nbytes * 2 > self.kept:
            self._forget(units)
        places = self._places(units)[codes]
        sizes = self.sizes[places]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        return self.flat[_runs(self.starts[places], sizes)], np.diff(upto[np.concatenate([[0], ends])])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids (uint32) of some texts, and how many each has; null is empty."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lists = pc.split_pattern(pc.fill_null(texts, ""), " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        coded = lists.flatten().dictionary_encode()
        codes, firsts = coded.indices.to_numpy().copy(), np.concatenate([[0], ends[:-1]]).astype(np.int64)
        # The first piece of a text has no space before it.
        heads = coded.dictionary.take(pa.array(codes[firsts])).dictionary_encode()
        white = pc.match_substring_regex(coded.dictionary, _ENDS_WHITE).to_numpy(zero_copy_only=False)
        odd = white[codes]
        odd[firsts] &= pc.not_equal(coded.dictionary.take(pa.array(codes[firsts])), "").to_numpy(zero_copy_only=False) | (np.diff(ends, prepend=0) > 1)
        odd = np.add.reduceat(odd.astype(np.int64), firsts) > 0 if len(firsts) else np.zeros(0, bool)
        if odd.any():
            return self._encode_odd(texts, odd)
        codes[firsts] = heads.indices.to_numpy() + len(coded.dictionary)
        units = pa.concat_arrays([pc.binary_join_element_wise("", coded.dictionary, " "), heads.dictionary])
        return self._gather_distinct(units, codes, ends)

    def _gather_distinct(self, units: pa.Array, codes: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units that no code names are left out, repeated ones (an empty head) are one."""
        used = np.zeros(len(units), bool)
        used[codes] = True
        number = np.cumsum(used) - 1
        coded = units.filter(pa.array(used)).dictionary_encode()
        return self._gather(coded.dictionary, coded.indices.to_numpy()[number[codes]], ends)

    def _encode_odd(self, texts: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Texts of which some have runs of white space: these are split by the pattern of units."""
        plain, sizes = self.encode(texts.filter(pa.array(~odd)))
        found = [_UNIT.findall(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        coded = pa.array([u for units in found for u in units], pa.string()).dictionary_encode()
        other, other_sizes = self._gather(coded.dictionary, coded.indices.to_numpy(), np.cumsum([len(u) for u in found]))
        counts = np.zeros(len(texts), np.int64)
        counts[odd], counts[~odd] = other_sizes, sizes
        starts = np.zeros(len(texts), np.int64)
        starts[odd] = len(plain) + np.cumsum(other_sizes) - other_sizes
        starts[~odd] = np.cumsum(sizes) - sizes
        return np.concatenate([plain, other])[_runs(starts, counts)], counts


def text_slices(batch: pa.RecordBatch, column: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about ``most`` bytes of text, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy()
    ends, at = np.cumsum(sizes.astype(np.int64)), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def id_column(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    """One binary value per text: its ids as little-endian unsigned 32-bit integers."""
    offsets = np.concatenate([[0], np.cumsum(counts) * 4]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(ids, "<u4"))])
