"""Token ids by the tokenizers library, each distinct word of a bounded part of the texts encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
#: Letters of the texts that are encoded at once, each distinct word of theirs once; a longer text is encoded alone.
LETTERS = 8_000_000
#: Distinct words whose encodings the library holds at once, and how many of them make one text.
REMEMBERED, TOGETHER = 262_144, 1024
#: Signs that are tokens of their own after a letter.
SIGNS = ".,"
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: How vocabularies of this kind write the space.
_SPACE = "\u0120"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


class Encoder:
    """Encodes whole texts without special tokens added.

    A byte-level BPE with the usual splitting pattern always ends a token before a single space that stands
    between two other characters, neither white space.  So a text may be cut there, and what is between two
    cuts gets the same ids wherever it stands.  Other white space is left within its part.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(vocabulary)
        self.size = self.library.get_vocab_size()
        names = self.library.get_vocab(with_added_tokens=True)
        self.after_space = np.zeros(max(names.values()) + 1, bool)
        self.after_space[[i for name, i in names.items() if name.startswith(_SPACE)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, np.uint32).tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, each with a space before it, and how many each has; words have no space in them, nor white space at an end.
        They are encoded many at a time: the ids of one begin where a token begins with a space."""
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), REMEMBERED):
            some = words.slice(at, REMEMBERED).cast(pa.string())
            edges = np.append(np.arange(0, len(some), TOGETHER), len(some))
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), some), " ").to_pylist()
            for n, x in zip(np.diff(edges).tolist(), self.library.encode_batch_fast([" " + w for w in joined], add_special_tokens=False), strict=True):
                ids.append(np.array(x.ids, np.uint32))
                starts = np.flatnonzero(self.after_space[ids[-1]])
                if len(starts) != n:
                    raise ValueError("the vocabulary's tokens don't show where words begin")
                sizes.append(np.diff(np.append(starts, len(ids[-1]))))
        return np.concatenate(ids), np.concatenate(sizes)

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """The ids of each text; of None or an empty one, none."""
        out, some, letters = [], [], 0
        for t in texts:
            some.append(t or "")
            letters += len(some[-1])
            if letters >= LETTERS:
                out += self._encode_some(some)
                some, letters = [], 0
        return out + self._encode_some(some) if some else out

    def _encode_some(self, texts: list[str]) -> list[np.ndarray]:
        """Each distinct word is encoded once; the texts' ids are then taken from the words' by their places."""
        split = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        edges = split.offsets.to_numpy().astype(np.int64)
        begins = words.take(pa.array(codes[edges[:-1]])).to_pylist()
        odd = _white(words)
        signs, stems = _signs(words, odd)
        stems = stems.filter(pa.array(~odd)).dictionary_encode()
        own, own_sizes = self._encode_words(stems.dictionary)
        first = self._encode([*SIGNS, *begins])
        ids = np.concatenate([own, np.frombuffer(b"".join(first), np.uint32)])
        sizes = np.concatenate([own_sizes, [len(x) // 4 for x in first], [0]]).astype(np.int64)
        # pieces: distinct stems, the signs, the texts' first words, which have no space before them, and nothing
        n = len(stems.dictionary)
        stem = np.full(len(words), len(sizes) - 1, np.int64)
        stem[~odd] = stems.indices.to_numpy()
        piece, sign, strange = stem[codes], signs[codes], odd[codes]
        piece[edges[:-1]] = n + len(SIGNS) + np.arange(len(texts))
        sign[edges[:-1]], strange[edges[:-1]] = 0, False
        count = 1 + (sign > 0)
        at = np.concatenate([[0], np.cumsum(count)])
        pieces = np.repeat(piece, count)
        pieces[at[1:][sign > 0] - 1] = n + sign[sign > 0] - 1
        long = sizes[pieces]
        ends = np.concatenate([[0], np.cumsum(long)])
        starts = np.cumsum(sizes) - sizes
        taken = ids[np.repeat(starts[pieces] - ends[:-1], long) + np.arange(ends[-1])]
        alone = np.logical_or.reduceat(strange, edges[:-1]).tolist()
        whole, many = ends[at[edges]].tolist(), np.diff(edges).tolist()
        return [
            self._by_parts(t) if alone[i] or (many[i] > 1 and (not w or w[-1].isspace())) else taken[whole[i] : whole[i + 1]]
            for i, (t, w) in enumerate(zip(texts, begins, strict=True))
        ]

    def _by_parts(self, text: str) -> np.ndarray:
        first, *rest = _CUT.split(text)
        return np.frombuffer(b"".join(self._encode([first, *(" " + x for x in rest)])), np.uint32)


def _ends(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: bytes, the first byte, the last and the one before; 0 if there is none."""
    offsets = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, 8 * words.offset)
    data = np.concatenate([np.frombuffer(words.buffers()[2] or b"", np.uint8)[: offsets[-1]], np.zeros(1, np.uint8)])
    size = np.diff(offsets)
    return size, *(np.where(size > k, data[np.where(size > k, place, 0)], 0) for k, place in ((0, offsets[:-1]), (0, offsets[1:] - 1), (1, offsets[1:] - 2)))


def _white(words: pa.Array) -> np.ndarray:
    """Whether a word is empty or has white space at an end."""
    size, first, last, _ = _ends(words)
    white = size == 0
    maybe = np.flatnonzero(~white & ((first <= 32) | (first >= 127) | (last <= 32) | (last >= 127)))
    white[maybe] = [w[0].isspace() or w[-1].isspace() for w in words.take(pa.array(maybe)).to_pylist()]
    return white


def _signs(words: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Which of SIGNS, from 1, ends a word after a letter, else 0, and the words without it.  Such a sign is a token of its own, so "word,"
    needs no more than "word"."""
    _, _, last, before = _ends(words)
    letter = ((before | 32) >= 97) & ((before | 32) <= 122) & ~odd
    out = np.zeros(len(words), np.int64)
    for i, sign in enumerate(SIGNS):
        out[letter & (last == ord(sign))] = i + 1
    return out, pc.if_else(pa.array(out > 0), pc.utf8_slice_codeunits(words, 0, -1), words)


@lru_cache(4)
def encoder(vocabulary: str) -> Encoder:
    """One for each worker process, as a vocabulary takes time to load."""
    return Encoder(vocabulary)
