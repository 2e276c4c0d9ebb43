"""Token ids of texts by a public tokenizer, with a per-worker memory of words already encoded."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import hashing

#: Pieces in a worker's memory, at some 50 bytes each; then it begins anew, since frequent ones are soon back.
MEMO_PIECES = 2_000_000
#: Bytes of new pieces that the library encodes as one text, about; longer pieces aren't remembered.
_RUN, _LONGEST = 4_096, 200

#: Bytes after which a space may stand within a longer white space: ASCII white space, and the first bytes of others.
_AFTER_SPACE = np.ones(256, bool)
_AFTER_SPACE[[0x20, *range(0x09, 0x0E), *range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3]] = False
_OTHER = np.random.default_rng(22).integers(0, 2**64, 256, "u8")


class WordEncoder:
    """Encodes texts with the ``tokenizers`` library.

    The byte-level pre-tokenizer always ends a token before a space that something else than white space follows.
    So texts are cut into pieces there, and each different piece goes to the library once and is remembered under
    two 64-bit hashes and found again by numpy, many at once. New pieces go to it in runs: as a token ends between
    them and each id stands for a fixed number of bytes, the ids of a run fall to its pieces by their lengths.
    Where the vocabulary has another pre-tokenizer all texts are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        rules = json.loads(self.tokenizer.to_str())
        before = rules["pre_tokenizer"] or {}
        self.by_pieces = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and rules["normalizer"] is None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, "i8")
        for token, k in vocabulary.items():
            self.bytes_of[k] = len(token)  # the alphabet of byte-level tokens has a character for each byte
        self._forget()

    def _forget(self) -> None:
        none = np.empty(0, "u8")
        # (hash, other hash, place of the ids, number of ids), by hash: what is held, and what came of late
        self.tables = [(none, none, none.astype("i8"), none.astype("i8"))] * 2
        self.pool, self.n_pool = np.empty(1 << 16, "<u4"), 0

    def _whole(self, texts: list[bytes]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)]

    def _run_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, where each ends); each begins with a space, so that it may follow any other."""
        sizes = np.array([len(x) for x in pieces], "i8")
        ends = np.cumsum(sizes)
        cuts = [0, *(np.flatnonzero(np.diff(ends // _RUN)) + 1).tolist(), len(pieces)]
        ids = np.concatenate(self._whole([b"".join(pieces[a:b]) for a, b in zip(cuts, cuts[1:])]))
        return ids, np.searchsorted(np.cumsum(self.bytes_of[ids]), ends) + 1

    def _fresh(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) in the pool of the ids of pieces that aren't known."""
        spaced = np.array([x[0] == 0x20 for x in pieces], bool)
        counts, parts = np.zeros(len(pieces), "i8"), []
        for which in (spaced, ~spaced):
            some = [pieces[k] for k in np.flatnonzero(which).tolist()]
            if some and which is spaced:
                ids, ends = self._run_ids(some)
                counts[which] = np.diff(ends, prepend=0)
                parts.append(ids)
            elif some:  # what a text begins with
                found = self._whole(some)
                counts[which] = [len(x) for x in found]
                parts += found
        places = np.zeros(len(pieces), "i8")
        order = np.concatenate([np.flatnonzero(spaced), np.flatnonzero(~spaced)])
        places[order] = self.n_pool + np.cumsum(counts[order]) - counts[order]
        new = np.concatenate(parts)
        if self.n_pool + len(new) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.n_pool], np.empty(self.n_pool + 2 * len(new), "<u4")])
        self.pool[self.n_pool : self.n_pool + len(new)] = new
        self.n_pool += len(new)
        return places, counts

    def _look_up(self, blob: bytes, key: np.ndarray, other: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, number) in the pool of the ids of pieces that differ in ``key``, which ascends."""
        place, count, open_ = np.zeros(len(key), "i8"), np.zeros(len(key), "i8"), np.ones(len(key), bool)
        for keys, others, places, counts in self.tables:
            if len(keys):
                at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                hit = (keys[at] == key) & (others[at] == other)
                place[hit], count[hit] = places[at[hit]], counts[at[hit]]
                open_ &= ~hit
        if open_.any():
            new = np.flatnonzero(open_)
            place[new], count[new] = self._fresh([blob[a:b] for a, b in zip(starts[new].tolist(), ends[new].tolist())])
            held, late = self.tables
            new = new[ends[new] - starts[new] <= _LONGEST]
            late = self._merged(late, (key[new], other[new], place[new], count[new]))
            self.tables = [held, late] if 8 * len(late[0]) < len(held[0]) else [self._merged(held, late), tuple(x[:0] for x in late)]
        return place, count

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b))

    def _encode_slice(self, blob: bytes, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many of them stand before each of ``edges``) of texts that end at ``edges``."""
        flat = np.frombuffer(blob, "u1")
        begins = flat == 0x20
        begins[:-1] &= _AFTER_SPACE[flat[1:]]
        begins[-1:] = False
        begins[edges[edges < len(flat)]] = True
        starts = np.flatnonzero(begins)
        if not len(starts):
            return np.empty(0, "<u4"), np.zeros(len(edges), "i8")
        ends = np.append(starts[1:], len(flat))
        keys, others = hashing.stretches(flat, starts, ends), hashing.stretches(flat, starts, ends, _OTHER)
        key, first, which = np.unique(keys, return_index=True, return_inverse=True)
        if (others[first][which] != others).any():  # two pieces with one hash: tell them apart by their bytes
            pieces = [blob[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
            number = {x: k for k, x in enumerate(dict.fromkeys(pieces))}
            which = np.array([number[x] for x in pieces])
            place, count = self._fresh(list(number))
        else:
            place, count = self._look_up(blob, key, others[first], starts[first], ends[first])
        counts = count[which]
        before = np.concatenate([[0], np.cumsum(counts)])
        ids = self.pool[np.repeat(place[which] - before[:-1], counts) + np.arange(before[-1])]
        return ids, before[np.searchsorted(starts, edges)]

    def encode_bytes(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of each text, UTF-8, as unsigned 32-bit integers."""
        if not self.by_pieces:
            return self._whole(texts)
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for owners, parts in _slices(texts):
            if len(self.tables[0][0]) + len(self.tables[1][0]) > MEMO_PIECES:
                self._forget()
            edges = np.cumsum([0, *map(len, parts)])
            ids, before = self._encode_slice(b"".join(parts), edges)
            for k, a, b in zip(owners, before.tolist(), before[1:].tolist()):
                out[k].append(ids[a:b])
        return [x[0] if len(x) == 1 else np.concatenate(x) if x else np.empty(0, "<u4") for x in out]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self._whole([x.encode() for x in texts])]

    def encode(self, texts: list[str]) -> list[bytes]:
        return [x.tobytes() for x in self.encode_bytes([x.encode() for x in texts])]

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text of a column of strings; null counts as empty."""
        return self.encode_bytes([x or b"" for x in texts.cast(pa.binary()).to_pylist()])


def _slices(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Texts, or parts of long ones that end before a space within a line of words, about a slice together."""
    owners, parts, size = [], [], 0
    for k, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text)
            if end - at > hashing.SLICE:
                cut = at + hashing.SLICE
                while 0 <= (cut := text.find(b" ", cut)) < end - 1 and not _AFTER_SPACE[text[cut + 1]]:
                    cut += 1
                end = cut if 0 <= cut < end - 1 else end
            owners.append(k)
            parts.append(text[at:end])
            size += end - at
            at = end
            if size >= hashing.SLICE:
                yield owners, parts
                owners, parts, size = [], [], 0
    if parts:
        yield owners, parts


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each task one core
    return WordEncoder(path)


def forget() -> None:
    """Give back a worker's memory of words, for stages that need the room themselves."""
    encoder.cache_clear()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
