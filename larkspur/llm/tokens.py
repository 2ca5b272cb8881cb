"""Token ids of whole texts, by a public tokenizer file whose tokens never cross white space.

Byte-pair merging is the costly part, and words repeat: ids are kept by white-space word in a
bounded two-generation cache for the life of a worker, and the words that are new in a batch
are merged in one call. A text with control characters that the tokenizer and Python's
``str.split`` see differently is encoded whole. A null or empty text has no ids.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import kept

_ODD = re.compile("[\x1c-\x1f]")
_TAIL = ".,;:!?"
_CODERS: dict[tuple, "WordCoder"] = kept()


def coder(path: str, special_as_text: bool = False) -> "WordCoder":
    """The worker's coder for a tokenizer file: made once, kept with its cache until another operator's task releases it."""
    key = (path, special_as_text)
    if key not in _CODERS:
        _CODERS[key] = WordCoder(path, special_as_text)
    return _CODERS[key]


class WordCoder:
    """``ids(texts)``: the uint32 little-endian ids of each text as bytes."""

    def __init__(self, path: str, special_as_text: bool = False, capacity: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.most = max(vocabulary.values())
        self.ends = np.zeros(self.most + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.capacity, self.new, self.old = capacity, {}, {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of words that are not cached. A word of letters is one unit of the tokenizer, so many are encoded as one text."""
        letters = [w for w in words if w.isalpha()]
        others = [w for w in words if not w.isalpha()]
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) == len(letters):
                flat, at = ids.tobytes(), 0
                for w, stop in zip(letters, (stops * 4).tolist()):
                    self.new[w] = flat[at:stop]
                    at = stop
            else:
                others += letters
        self.new.update(zip(others, self._whole(others)))

    def _cover(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, all of which are brought into the newer generation."""
        if len(self.new) > self.capacity:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        out = list(map(new.get, words))
        missing = []
        for i, w in enumerate(words):
            if out[i] is None:
                known = old.get(w)
                if known is None:
                    missing.append(i)
                else:
                    out[i] = new[w] = known
        if not missing:
            return out
        units, stems, tails = {}, [], []
        for i in missing:
            w = words[i]
            stem = w.rstrip(_TAIL)
            if stem.isalpha():
                tail = w[len(stem) :]
                stem = stem.lower() if stem.isascii() else stem
                if tail:
                    units[tail] = None
            else:
                stem, tail = w, ""
            units[stem] = None
            stems.append(stem)
            tails.append(tail)
        self._learn([p for p in units if p not in new and new.setdefault(p, old.get(p)) is None])
        for i, stem, tail in zip(missing, stems, tails):
            out[i] = new[words[i]] = new[stem] + new[tail] if tail else new[stem]
        return out

    def ids(self, texts: list[str | None]) -> list[bytes]:
        odd = [bool(text and _ODD.search(text)) for text in texts]
        lists = pc.utf8_split_whitespace(pa.array(["" if o else text or "" for text, o in zip(texts, odd)], pa.string()))
        found = lists.flatten().dictionary_encode()
        words = found.dictionary.to_pylist()
        known = self._cover([w for w in words if w])
        if len(known) < len(words):  # a text's outer white space leaves an empty word
            known.insert(words.index(""), b"")
        # Each word's ids lie in one array: a text's are gathered from it, word after word.
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        word = found.indices.to_numpy()
        times = size[word]
        ends = np.concatenate(([0], np.cumsum(times)))
        place = np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[word] - ends[:-1], times)
        data = np.frombuffer(b"".join(known), dtype="<u4")[place].tobytes()
        bounds = (ends[lists.offsets.to_numpy() - lists.offsets[0].as_py()] * 4).tolist()
        return [self._whole([text])[0] if o else data[a:b] for text, o, a, b in zip(texts, odd, bounds, bounds[1:])]
