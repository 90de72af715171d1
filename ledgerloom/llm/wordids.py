"""Token ids of whole texts by the BPE tokenizer with word ends, looked up word by word."""

from __future__ import annotations

import functools
import os
import re

import numpy as np

_LETTER, _NUMBER, _SPACE = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
#: How the tokenizer cuts folded Latin-1 text before its merges: contractions, letters, single digits, marks.
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^{_SPACE}{_LETTER}{_NUMBER}]+")
_WIDE = re.compile("[^\x00-\xff]")
_GAP = re.compile("[ \t\n\r]+")
#: Bytes that a worker's table may take, about, and what an entry takes beside its word and ids: objects and their place in a dict.
TABLE_BYTES, ENTRY_BYTES = 64 << 20, 200


class WordIds:
    """Ids of each word as little-endian 32-bit bytes, encoded when the word is first met.

    The tokenizer folds case, drops white space and never merges across words, and each word's
    last token is marked as a word end. So Latin-1 text is cut into words here, and new words are
    encoded many at a time and parted at the word ends; other text is cut at white space
    and encoded run by run. The ids are those of the whole text. When the table takes about ``most``
    bytes, words not met since it was last half full go: memory is bounded whatever the vocabulary.
    """

    def __init__(self, path: str, most: int = TABLE_BYTES):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content.lower() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._ends = np.zeros(self._tokenizer.get_vocab_size(), bool)
        for token, k in self._tokenizer.get_vocab().items():
            self._ends[k] = token.endswith("</w>")
        self._now, self._old, self._half, self._size = {}, {}, most // 2, 0

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        old = self._old
        found = {w: old[w] for w in words if w in old}
        new = [w for w in words if w not in found]
        latin = [w for w in new if not _WIDE.search(w)] if _WIDE.search("".join(new)) else new
        if latin:
            # without offsets, which take a third of the time
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(latin)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * np.flatnonzero(self._ends[ids]) + 4).tolist()
            if len(ends) == len(latin):
                packed = ids.tobytes()
                found.update(zip(latin, [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        if len(found) < len(words):
            found |= {w: self._ids(w).tobytes() for w in new if w not in found}
        now, size = self._now, self._size
        for w, of_word in found.items():
            if size >= self._half:
                self._old, self._now, size = now, {}, 0
                now = self._now
            now[w] = of_word
            size += ENTRY_BYTES + len(w) + len(of_word)
        self._size = size
        return found

    def of(self, text: str) -> bytes:
        low = text.lower()
        if any(s in low for s in self._special):
            return self._ids(text).tobytes()
        if _WIDE.search(text):
            words = [x for run in _GAP.split(text) for x in ([run] if _WIDE.search(run) else _WORD.findall(run.lower()))]
        else:
            words = _WORD.findall(low)
        ids = list(map(self._now.get, words))
        if None in ids:
            learned = self._learn({w for w, x in zip(words, ids, strict=True) if x is None})
            ids = [learned[w] if x is None else x for w, x in zip(words, ids, strict=True)]
        return b"".join(ids)


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One table for all tasks of a worker."""
    return WordIds(path)
