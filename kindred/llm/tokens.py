"""Token ids from vocabulary files of the tokenizers library, with caches of words and pieces.

Texts of plain characters are taken apart into the words of the vocabulary's own pattern by whole columns, and the library's model
encodes each word that is new; only distinct words meet Python. Other texts are split before every space that a
non-space follows, where both vocabularies split as well, so that their ids are those of their pieces; the library encodes a
piece as a whole, and so it does a byte-level text in which a space stands before white space or
at the end, and every text in which the string of a special token occurs: it gets that token's id, as by the library's plain call.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from itertools import chain, repeat
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from kindred.llm.common import cache, ranges, utf8

# The vocabularies' patterns.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A space before white space or the end, in RE2's syntax.
ODD = r" (?:[\t-\r \x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|\z)"
#: Printable ASCII, line feed and precomposed Latin letters: stable under normalisation, one case mapping everywhere.
PLAIN = re.compile("[ !-~\nÀ-ɏ]+").fullmatch

#: Texts of such characters, without apostrophes (which start contractions) and the one letter that grows in lower case.
EASY = r"\A[ -&(-~\n\x{c0}-\x{12f}\x{131}-\x{24f}]*\z"
#: What stands apart from letters in such texts: single digits, and runs of marks.
MARKS = r"[0-9]|[!-/:-@\[-`{-~\x{d7}\x{f7}]+"

#: Such texts for the byte-level pattern: no white space before white space, no space at the end, all that isn't ASCII a letter.
EASY_BYTES = r"\A(?:[ \n]?[!-&(-~\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{24f}]+)*\n?\z"
SEPARATOR = "\x01"


def _values(words: pa.StringArray) -> list[str]:
    """Strings without the separator as a list; much faster than one by one."""
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), SEPARATOR)[0].as_py().split(SEPARATOR) if len(words) else []


_ENCODERS: dict[tuple[str, int], Encoder] = cache("encoders")
Made = tuple[list[str], np.ndarray, np.ndarray]  # strings, the number of ids of each, the ids


class _Table:
    """Ids by string: rows of one flat array."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used = 0

    def add(self, keys: list[str], counts: np.ndarray, flat: np.ndarray) -> None:
        base = len(self.index)
        self.index.update(zip(keys, range(base, base + len(keys))))
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.zeros(self.used + 2 * len(flat), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        if base + len(keys) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros(len(self.starts) + 2 * len(keys), np.int64)])
        self.starts[base + 1 : base + len(keys) + 1] = self.used + np.cumsum(counts)
        self.used += len(flat)

    def rows(self, keys: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.get, keys, repeat(-1)), np.int64, len(keys))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.starts[at + 1] - self.starts[at]
        return self.flat[ranges(self.starts[at], counts)], counts


class _Cache:
    """Ids by string in two generations: a full one becomes the old one, and strings that are met again move on from it.
    So what holds memory is bounded, and frequent strings stay."""

    def __init__(self, entries: int, make: Callable[[list[str]], Made]):
        self.entries, self.make = entries, make
        self.new, self.old = _Table(), _Table()

    def ids(self, keys: list[str], codes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the keys together and the number of each; with codes, of the keys that codes name."""
        if len(self.new.index) >= self.entries:
            self.new, self.old = _Table(), self.new
        at = self.new.rows(keys)
        unknown = np.flatnonzero(at < 0).tolist()
        if unknown:
            names = list(dict.fromkeys([keys[k] for k in unknown]))
            known = self.old.rows(names)
            again = [names[k] for k in np.flatnonzero(known >= 0).tolist()]
            flat, counts = self.old.gather(known[known >= 0])
            self.new.add(again, counts, flat)
            if len(again) < len(names):
                self.new.add(*self.make([names[k] for k in np.flatnonzero(known < 0).tolist()]))
            at[unknown] = self.new.rows([keys[k] for k in unknown])
        return self.new.gather(at if codes is None else at[codes])


def _byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return dict(zip(kept, kept)) | {b: 256 + i for i, b in enumerate(rest)}


def _folded_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts and where each text's begin: digits and runs of marks, and what white space parts."""
    low = pc.replace_substring(pc.utf8_lower(texts), "\n", " ")
    lists = pc.split_pattern(pc.replace_substring_regex(low, MARKS, r" \0 "), " ")
    borders = lists.offsets.to_numpy().astype(np.int64)
    return lists.flatten(), borders - borders[0]


_SPACE, _LINE, _LETTER, _DIGIT, _MARK = range(5)
_KINDS = np.full(256, _LETTER, np.uint8)
_KINDS[33:128] = [_LETTER if c.isalpha() else _DIGIT if c.isdigit() else _MARK for c in map(chr, range(33, 128))]
_KINDS[[32, 10]] = _SPACE, _LINE


def _byte_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Likewise for the byte-level pattern: runs of one kind of bytes with the space before them, and single line feeds."""
    raw, offsets = utf8(texts)
    kind = _KINDS[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[1:-1] = (kind[1:] <= _LINE) | ((kind[1:] != kind[:-1]) & (kind[:-1] != _SPACE))
    first[offsets] = True
    at = np.flatnonzero(first)  # the end among them
    words = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
    return words, np.searchsorted(at, offsets)


class Encoder:
    """Encodes Arrow arrays of texts. The caches hold at most `entries` strings in each generation."""

    def __init__(self, path: str, entries: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        # a normaliser that folds white space and case makes spaces around words harmless
        self._folds = self._tokenizer.normalizer is not None
        self._split = regex.compile(WORD_PATTERN if self._folds else BYTE_PATTERN).findall
        self._letters = _byte_letters()
        self.size = self._tokenizer.get_vocab_size()
        self._words, self._pieces = _Cache(entries, self._make_words), _Cache(entries // 4, self._make_pieces)

    def _make_words(self, words: list[str]) -> Made:
        """No word has a zero byte, which parts them while they are put into the model's alphabet."""
        spelt = "\0".join(words).encode().decode("latin-1").translate(self._letters).split(chr(self._letters[0])) if words else []
        found = list(map(self._tokenizer.model.tokenize, spelt))
        counts = np.fromiter(map(len, found), np.int64, len(found))
        return words, counts, np.fromiter(map(attrgetter("id"), chain.from_iterable(found)), np.uint32, int(counts.sum()))

    def _make_pieces(self, keys: list[str]) -> Made:
        """A key is a piece after a space; one that starts with a space is the first piece of a text."""
        texts = [k[1:] if k[:1] == " " else f" {k}" for k in keys]
        plain = [bool(PLAIN(t)) for t in texts]
        easy = [(k, t.lower() if self._folds else t) for k, t, p in zip(keys, texts, plain) if p]
        hard = [(k, t) for k, t, p in zip(keys, texts, plain) if not p]
        parts = [self._split(t) for _, t in easy]
        flat, counts = self._words.ids(list(chain.from_iterable(parts)))
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum([0, *map(len, parts)])]
        ids = [e.ids for e in self._tokenizer.encode_batch_fast([t for _, t in hard], add_special_tokens=False)] if hard else []
        more = np.fromiter(map(len, ids), np.int64, len(ids))
        return [k for k, _ in easy + hard], np.concatenate([np.diff(ends), more]), np.concatenate([flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(more.sum()))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts together and the number of each; null is empty."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        named = np.zeros(len(texts), bool)
        for s in self._special:
            named |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        return self._joined(texts, named, self._encode_whole, self._encode_plain) if named.any() else self._encode_plain(texts)

    def _joined(self, texts: pa.Array, mine: np.ndarray, one: Callable, other: Callable) -> tuple[np.ndarray, np.ndarray]:
        """The texts of `mine` encoded by one way, the rest by another."""
        n, parts = np.empty(len(texts), np.int64), []
        for rows, how in ((mine, one), (~mine, other)):
            parts.append(how(texts.filter(pa.array(rows))) if rows.any() else (np.zeros(0, np.uint32), np.zeros(0, np.int64)))
            n[rows] = parts[-1][1]
        starts, out = np.cumsum(n) - n, np.empty(int(n.sum()), np.uint32)
        for rows, (ids, counts) in zip((mine, ~mine), parts):
            out[ranges(starts[rows], counts)] = ids
        return out, n

    def _encode_whole(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        ids = [self._tokenizer.encode(t.as_py(), add_special_tokens=False).ids for t in texts]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def _encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts without special tokens."""
        easy = pc.match_substring_regex(texts, EASY if self._folds else EASY_BYTES).to_numpy(zero_copy_only=False)
        if easy.all():
            return self._encode_words(texts)
        return self._joined(texts, ~easy, self._encode_pieces, self._encode_words)

    def _encode_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Easy texts. Empty strings among the words have no ids."""
        words, borders = (_folded_words if self._folds else _byte_words)(texts)
        coded = words.dictionary_encode()
        ids, counts = self._words.ids(_values(coded.dictionary), coded.indices.to_numpy())
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[borders])

    def _encode_pieces(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole: dict[int, list[int]] = {}
        if not self._folds:
            odd = pc.match_substring_regex(texts, ODD)
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                whole[i] = self._tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
            texts = pc.if_else(odd, "", texts)
        lists = pc.split_pattern(texts, " ")
        borders = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        keys = coded.dictionary.to_pylist()
        if not self._folds and len(texts):
            # first pieces have no space before them: keys of their own
            heads = [f" {keys[c]}" for c in codes[borders[:-1] - borders[0]].tolist()]
            known: dict[str, int] = {}
            codes[borders[:-1] - borders[0]] = [known.setdefault(h, len(keys) + len(known)) for h in heads]
            keys += known
        ids, counts = self._pieces.ids(keys, codes)
        ends = np.concatenate([[0], np.cumsum(counts)])[borders - borders[0]] if len(borders) else np.zeros(1, np.int64)
        n = np.diff(ends)
        if whole:
            rows = [np.array(whole[i], np.uint32) if i in whole else ids[ends[i] : ends[i + 1]] for i in range(len(n))]
            return np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        return ids, n


def encoder(path: str) -> Encoder:
    """One encoder a worker process and vocabulary; it outlives tasks where workers are reused."""
    key = (path, os.getpid())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path)
    return _ENCODERS[key]


def vocabulary(name: str) -> str:
    """Where the public vocabulary file of that name is installed."""
    import public_tokenizers

    return public_tokenizers.path(name)
