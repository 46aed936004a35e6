"""Token ids of whole texts with a public tokenizer, word by word through a bounded cache.

A text's ids are those of its words between ASCII white space, one after the other: the tokenizers used here drop
white space and never join across it. That makes words the unit to cache, and lets Arrow split, deduplicate and
gather them without a Python step per word.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of words kept per worker process, about 130 bytes each; beyond the bound the next slice starts anew.
CACHE_PIECES = 400_000
#: Bytes of text that are split into words at a time.
SLICE_BYTES = 2_000_000

#: A word of Latin-1 letters and then ASCII marks: the pre-tokenizer always cuts between the two. A word with "<" may
#: hold the name of a special token and is none.
_PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<marks>[!-&(-/:;=-@\[-`{-~]*)$"


def _gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[start : start + len] end to end, and where each begins and the last one ends."""
    cum = np.concatenate(([0], np.cumsum(lens)))
    return flat[np.repeat(starts - cum[:-1], lens) + np.arange(cum[-1])], cum


class WordEncoder:
    """ids(texts): an Arrow list<int32> array with the ids of each text, ``end_id`` appended if given.

    Takes the JSON of a BPE tokenizer whose pre-tokenizer separates letters from marks, drops white space and ends
    words with </w>. Plain words (Latin-1 letters, then marks) only need lower case, and skip its normaliser and
    regular expression; all others go through the tokenizer itself.
    """

    def __init__(self, tokenizer_json: str, end_id: int | None = None, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(tokenizer_json)
        bare = json.loads(tokenizer_json) | {"normalizer": None, "added_tokens": []}
        bare["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.bare = Tokenizer.from_str(json.dumps(bare))
        vocab = self.whole.get_vocab()
        self.is_end = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.is_end[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.end_id, self.cache_pieces = end_id, cache_pieces
        self._forget()

    def _forget(self) -> None:
        """Start anew: piece 0 is the empty one."""
        self.pieces: dict[str, int] = {"": 0}
        self.flat, self.ends = np.zeros(1 << 16, dtype=np.int32), np.zeros(1 << 12, dtype=np.int64)

    def _add(self, pieces: list[str], ids: np.ndarray, lens: np.ndarray) -> None:
        n, used = len(self.pieces), int(self.ends[len(self.pieces) - 1])
        for name, need in (("flat", used + len(ids)), ("ends", n + len(pieces))):
            if need > len(old := getattr(self, name)):
                setattr(self, name, np.concatenate([old, np.zeros(need, dtype=old.dtype)]))
        self.flat[used : used + len(ids)] = ids
        self.ends[n : n + len(pieces)] = used + np.cumsum(lens)
        self.pieces.update(zip(pieces, range(n, n + len(pieces))))

    def _learn(self, plain: list[str], odd: list[str]) -> None:
        """Encode new pieces, the plain ones many to a call."""
        if plain:
            lines = [" ".join(plain[i : i + 256]) for i in range(0, len(plain), 256)]
            ids = np.concatenate([np.array(e.ids, dtype=np.int32) for e in self.bare.encode_batch_fast(lines, add_special_tokens=False)])
            last = np.flatnonzero(self.is_end[ids]) + 1
            if len(last) != len(plain):
                raise ValueError("this tokenizer does not end each word with a </w> token")
            self._add(plain, ids, np.diff(last, prepend=0))
        if odd:
            found = [e.ids for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)]
            self._add(odd, np.array([i for x in found for i in x], dtype=np.int32), np.array([len(x) for x in found], dtype=np.int64))

    def _numbers(self, pieces: pa.Array, plain: bool) -> np.ndarray:
        """The piece number of each, new ones encoded."""
        coded = pieces.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if new := [x for x in names if x not in self.pieces]:
            self._learn(*((new, []) if plain else ([], new)))
        return np.fromiter(map(self.pieces.__getitem__, names), dtype=np.int64, count=len(names))[coded.indices.to_numpy()]

    def _codes(self, words: pa.Array) -> np.ndarray:
        """(words, 2): two piece numbers for each of the distinct ``words``."""
        if len(self.pieces) > self.cache_pieces:
            self._forget()
        cut = pc.extract_regex(words, _PLAIN)
        plain = cut.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros((len(words), 2), dtype=np.int64)
        mask = pa.array(plain)
        # "Of," "of," and "of" share the encoding of "of".
        out[plain, 0] = self._numbers(pc.utf8_lower(pc.struct_field(cut, 0).filter(mask)), True)
        out[plain, 1] = self._numbers(pc.struct_field(cut, 1).filter(mask), True)
        out[~plain, 0] = self._numbers(words.filter(pc.invert(mask)), False)
        return out

    def ids(self, texts: pa.Array) -> pa.Array:
        """Null texts count as empty."""
        texts = pc.fill_null(texts, "")
        if pa.types.is_string_view(texts.type):
            texts = texts.cast(pa.large_string())
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        at = np.concatenate(([0], np.cumsum(sizes)))
        out, lo = [], 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, side="right")) - 1)
            out.append(self._encode(texts.slice(lo, hi - lo)))
            lo = hi
        return pa.concat_arrays(out) if out else pa.array([], type=pa.list_(pa.int32()))

    def _encode(self, texts: pa.Array) -> pa.Array:
        split = pc.ascii_split_whitespace(texts)
        first_word = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        if len(coded):
            both = self._codes(coded.dictionary).ravel()
            starts = np.where(both > 0, self.ends[both - 1], 0)
            of_words, at = _gather(self.flat, starts, np.where(both > 0, self.ends[both] - starts, 0))
            use = coded.indices.to_numpy()
            flat, cum = _gather(of_words, at[:-1:2][use], (at[2::2] - at[:-1:2])[use])
        else:
            flat, cum = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)
        per = cum[first_word - first_word[0]]
        if self.end_id is not None:
            flat = np.insert(flat, per[1:], self.end_id)
            per = per + np.arange(len(per))
        return pa.ListArray.from_arrays(pa.array(per.astype(np.int32)), pa.array(flat.astype(np.int32)))


_encoders: dict[tuple, WordEncoder] = {}


def encoder(key: str, tokenizer_json: str, end_id: int | None = None) -> WordEncoder:
    """One per worker process, tokenizer and end id."""
    if (key, end_id) not in _encoders:
        _encoders.clear()
        _encoders[key, end_id] = WordEncoder(tokenizer_json, end_id)
    return _encoders[key, end_id]
