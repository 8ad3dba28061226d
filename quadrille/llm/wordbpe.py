"""Fast bulk encoding with a word-level BPE of the tokenizers library.

Its pre-tokenizer never joins text across white space, so a text's ids are the ids of its words in order; each distinct word is
encoded once by the library and then looked up by a 64-bit hash.  The table of known words is emptied at a fixed size, so memory is bounded.
"""

from __future__ import annotations

import re

import numpy as np

from quadrille.llm import common as C

#: A full stop or comma that ends a word after a letter: a token of its own.
_MARK, _LETTER = np.zeros(256, bool), np.zeros(256, bool)
_MARK[[44, 46]] = True
_LETTER[97:123] = True
#: Words of lower-case ASCII and Latin-1 letters, which are in normal form and have no upper case left.
_LATIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+").fullmatch


def _byte_chars() -> dict[int, int]:
    """The printable characters that byte-level tokenizers write bytes as: printable ones stay, the others follow from 256 on."""
    stay = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in stay]
    return {b: 256 + i for i, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


class WordEncoder:
    """Ids (uint16/uint32) of texts given as UTF-8 bytes.  known: words that are remembered at most."""

    def __init__(self, path: str, known: int = 1_500_000):
        from tokenizers import Tokenizer

        self.tok, self.known = Tokenizer.from_file(path), known
        self.type = np.uint16 if self.tok.get_vocab_size() <= 1 << 16 else np.uint32
        mark = self.tok.encode("7", add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        one = lambda x: self.tok.encode(x, add_special_tokens=False).ids
        bare = lambda x: [t.id for t in self.tok.model.tokenize(x.encode().decode("latin-1").translate(_BYTE_CHARS))]
        #: Whether words may be lower-cased and parted from a mark behind them first, and go to the model alone.
        self.plain = all(one(x.title()) == one(x) == bare(x) for x in ("the", "zqxj", "été", "größe", "çà"))
        self.marks = self.plain and all(one("The" + m + " a") == one("the") + one(m) + one("a") for m in ".,")
        self.reset()

    def reset(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # of the known words, sorted
        self.where = np.zeros(0, np.int64)  # and their places in what follows
        self.first = np.zeros(1 << 16, np.int64)
        self.count = np.zeros(1 << 16, np.int32)
        self.ids = np.zeros(1 << 18, self.type)
        self.words = self.used = 0

    def _plain(self, words: list[bytes]) -> list[bytes]:
        """Learn words of Latin letters by the library's model alone: nothing is there to normalise, and the pre-tokenizer leaves
        them whole.  Returns the other words."""
        tokenize, rest, done, flat, n = self.tok.model.tokenize, [], [], [], []
        for w in words:
            if w.isalpha() and w.islower():  # of bytes: ASCII letters
                x = w.decode()
            else:
                x = w.decode()
                if not _LATIN(x):
                    rest.append(w)
                    continue
                x = w.decode("latin-1").translate(_BYTE_CHARS)
            ids = [t.id for t in tokenize(x)]
            done.append(w)
            flat += ids
            n.append(len(ids))
        n = np.array(n, np.int64)
        self._add(done, np.array(flat, self.type), np.cumsum(n) - n, n)
        return rest

    def _learn(self, words: list[bytes]) -> None:
        """The library encodes many words at once, with the token of the mark '7' between them; words with a 7 go one by one."""
        words = self._plain(words) if self.plain else words
        easy = [w for w in words if b"7" not in w] if self.mark is not None else []
        hard = [w for w in words if b"7" in w] if self.mark is not None else words
        parts = [easy[i : i + 200] for i in range(0, len(easy), 200)]
        for part, got in zip(parts, self.tok.encode_batch_fast([b" 7 ".join(p).decode() for p in parts], add_special_tokens=False)):
            ids = np.array(got.ids, self.type)
            cut = np.flatnonzero(ids == self.mark)
            if len(cut) != len(part) - 1:
                hard += part
                continue
            ends = np.concatenate([cut, [len(ids)]])
            starts = np.concatenate([[0], cut + 1])
            self._add(part, ids, starts, ends - starts)
        if hard:
            got = [e.ids for e in self.tok.encode_batch_fast([w.decode() for w in hard], add_special_tokens=False)]
            n = np.array([len(x) for x in got], np.int64)
            flat = np.array([y for x in got for y in x], self.type)
            self._add(hard, flat, np.cumsum(n) - n, n)

    def _add(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray, n: np.ndarray) -> None:
        k = self.words
        while k + len(words) > len(self.first):
            self.first, self.count = np.resize(self.first, 2 * len(self.first)), np.resize(self.count, 2 * len(self.count))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[k : k + len(words)] = self.used + starts
        self.count[k : k + len(words)] = n
        self.used += len(ids)
        self.words += len(words)
        self.learnt += words

    def _places(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The place of each word's ids; words are told apart by 64-bit hashes of their bytes."""
        h = C.word_hashes(data, starts, ends)
        order = np.argsort(h)
        first, n = C.runs_of(h[order])
        unique, sample = h[order[first]], order[first]
        at = np.minimum(np.searchsorted(self.hashes, unique), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == unique if len(self.hashes) else np.zeros(len(unique), bool)
        if self.words + (~known).sum() > self.known and self.words:
            self.reset()
            known[:] = False
        place = np.empty(len(unique), np.int64)
        place[known] = self.where[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            raw = data.tobytes()
            words = [raw[a:z] for a, z in zip(starts[sample[new]].tolist(), ends[sample[new]].tolist())]
            self.learnt: list[bytes] = []
            k = self.words
            self._learn(words)
            of = dict(zip(self.learnt, range(k, self.words)))
            place[new] = [of[w] for w in words]
            self.hashes, self.where = np.concatenate([self.hashes, unique[new]]), np.concatenate([self.where, place[new]])
            by = np.argsort(self.hashes)
            self.hashes, self.where = self.hashes[by], self.where[by]
        out = np.empty(len(h), np.int64)
        out[order] = np.repeat(place, n)
        return out

    def encode(self, column, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of an Arrow column, each with `end` after it, one after the other, and the n+1 offsets."""
        data, text_at = C.text_bytes(column)
        texts = len(text_at) - 1
        plain = self.plain and not ((data[:-1] == 60) & (data[1:] == 124)).any()  # "<|": special tokens are found before case goes
        if plain:
            data = C.lower_ascii(data)
        starts, ends, words_at = C.word_spans(data, text_at)
        if plain and self.marks and len(starts):
            mark = np.flatnonzero((ends - starts > 1) & _MARK[data[ends - 1]] & _LETTER[data[ends - 2]])
            words_at = words_at + np.searchsorted(mark, words_at)
            stop = ends[mark]
            ends = ends.copy()
            ends[mark] -= 1
            starts, ends = np.insert(starts, mark + 1, stop - 1), np.insert(ends, mark + 1, stop)
        at = self._places(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
        n = self.count[at].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(n)])
        flat = self.ids[np.arange(total[-1]) + np.repeat(self.first[at] - total[:-1], n)]
        stop = total[words_at[1:]] + np.arange(texts)
        out = np.empty(len(flat) + texts, self.type)
        body = np.ones(len(out), bool)
        body[stop] = False
        out[body] = flat
        out[stop] = end
        return out, np.concatenate([[0], stop + 1])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
