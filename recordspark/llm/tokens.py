"""Token ids of whole texts, by the tokenizers library, with words that come again taken from a bounded cache.

Both public vocabularies split a text into words before any merge, and no merge crosses a word's bounds. So a text cut
where a run of blanks starts, and after a word's letters, gives the ids of the whole text. A text with blanks other than
space, tab, newline or return, or with the string of a special token, goes to the library as one piece.
"""

from __future__ import annotations

import array
import os
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

ODD_BLANK = r"[\x00\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]"
WIDE = r"[^\x00-\xff]"
#: Two blanks in a row, where a cut at a single blank would part a run; a newline at a text's bounds.
RUNS = r"[ \n]{2}|[\t\r]|\A\n|\n\z"
#: What a word of letters may hold to be told apart from the stops after it: lower-case Latin-1 where a vocabulary folds case.
FOLDED = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
ASCII = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Bytes of texts to encode at once: the more, the more of their words are the same.
SLICE = 8_000_000


class Encoder:
    """encode(texts) gives each text's ids as little-endian unsigned integers of `width` bytes."""

    #: Words kept at once: those looked for since half as many were new, and as many from before that.
    LIMIT = 200_000
    #: New words that go to the library in one text.
    TOGETHER = 200

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(path)
        vocabulary = self.full.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.code = "H" if self.width == 2 else "I"
        model = type(self.full.model).__name__
        ends = model == "BPE" and self.full.model.end_of_word_suffix
        self.word_ends = bool(ends)
        self.cuts = model == "BPE" and (self.word_ends or type(self.full.pre_tokenizer).__name__ == "ByteLevel")
        self.letters = FOLDED if self.word_ends else ASCII
        # the same model for words of letters after single spaces, which need neither folding nor the expression that parts words
        self.bare = Tokenizer(self.full.model)
        cut = pre_tokenizers.WhitespaceSplit() if self.word_ends else pre_tokenizers.Split(" ", "merged_with_next")
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([cut, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        probe = [f" {' '.join(self.letters)} {self.letters}"]
        if not self.cuts or self._ids(self.bare, probe) != self._ids(self.full, probe):
            self.bare = self.full
        # where words begin (a byte-level token that opens with a space or newline), or end (a token with the suffix)
        self.bounds = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.bounds[i] = token.endswith(ends) if ends else token[:1] in ("\u0120", "\u010a")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def _ids(self, by, texts: Sequence[str]) -> list[bytes]:
        return [array.array(self.code, x.ids).tobytes() for x in by.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuttable(self, texts: pa.Array) -> pa.Array:
        odd = pc.or_(pc.match_substring_regex(texts, ODD_BLANK), pc.match_substring(texts, "<|"))
        return pc.invert(odd if self.word_ends else pc.or_(odd, pc.match_substring_regex(texts, RUNS)))

    def _pieces(self, texts: pa.Array) -> pa.ListArray:
        """Texts that can be cut as lists of pieces (see _learn)."""
        if self.word_ends:
            # letters beyond ASCII may join what stands before them, so their texts are left as they are
            return pc.ascii_split_whitespace(pc.if_else(pc.string_is_ascii(texts), pc.ascii_lower(texts), texts))
        return pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise("\x00", texts, ""), "\n", " \n"), " ")

    def _together(self, by, words: list[str], before: str) -> None:
        """Learns words that are one word each to the tokenizer, or begin one after `before` (a space or newline) and hold no blank: many in a text."""
        groups = [words[i : i + self.TOGETHER] for i in range(0, len(words), self.TOGETHER)]
        for group, raw in zip(groups, self._ids(by, [before + before.join([x.removeprefix("\n") for x in g]) for g in groups]), strict=True):
            at = np.flatnonzero(self.bounds[np.frombuffer(raw, f"<u{self.width}")])
            if len(at) != len(group):  # not as expected: one by one
                self.known.update(zip(group, self._ids(self.full, [before + x.removeprefix("\n") for x in group]), strict=True))
                continue
            cuts = (np.concatenate([[0], at + 1]) if self.word_ends else np.append(at, len(raw) // self.width)) * self.width
            cuts = cuts.tolist()
            self.known.update(zip(group, [raw[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)], strict=True))

    def _learn(self, pieces: list[str]) -> None:
        """A piece stands for itself (vocabularies with word ends), else for itself after a space, a newline (as written) or nothing (\\x00)."""
        letters = [x for x in pieces if x and not x.strip(self.letters)]
        self._together(self.bare, letters, " ")
        skip = set(letters)
        pieces = [x for x in pieces if x not in skip]
        if not self.word_ends:
            lines = [x for x in pieces if x[:1] == "\n" and len(x) > 1]
            odd = [x for x in pieces if x[:1] == "\x00" or x == "\n" or not x]
            self._together(self.full, lines, "\n")
            self.known.update(zip(odd, self._ids(self.full, [x.removeprefix("\x00") if x else " " for x in odd]), strict=True))
            skip = {*lines, *odd}
            self._together(self.full, [x for x in pieces if x not in skip], " ")
            return
        self.known.update(zip(pieces, self._ids(self.full, pieces), strict=True))

    def _known(self, pieces: pa.Array, times: np.ndarray) -> pa.Array:
        """The ids of distinct pieces. times: how often they come in the texts; new words that come once aren't kept."""
        if self.word_ends:
            pieces = pc.if_else(pc.match_substring_regex(pieces, WIDE), pieces, pc.utf8_lower(pieces))
        # words of letters apart from the stops after them (after \x00 where pieces begin with a space), which no merge joins
        words = pc.utf8_rtrim(pieces, ".,")
        parted = pc.match_substring_regex(words, rf"\A[{self.letters}]+\z")
        words = pc.if_else(parted, words, pieces).dictionary_encode()
        stops = pc.if_else(parted, pc.utf8_ltrim(pieces, self.letters), "").dictionary_encode()
        own = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        ends = [x if self.word_ends else "\x00" + x for x in stops.dictionary.to_pylist()]
        new = {*own, *ends} - self.known.keys()
        old = new & self.before.keys()
        self.known.update([(x, self.before[x]) for x in old])
        new -= old
        if new:
            self._learn(list(new))
        get, kind = self.known.__getitem__, pa.large_binary()
        out = pc.binary_join_element_wise(
            pa.array([get(x) for x in own], kind).take(words.indices), pa.array([get(x) for x in ends], kind).take(stops.indices), pa.scalar(b"", kind)
        )
        if new:
            often = np.bincount(words.indices.to_numpy(), times, len(own)) > 1
            new.difference_update([x for x, more in zip(own, often.tolist(), strict=True) if more], ends)
            for x in new:
                del self.known[x]
        if 2 * len(self.known) > self.LIMIT:
            self.before, self.known = self.known, {}
        return out

    def encode(self, texts: pa.Array | Sequence[str | None]) -> list[bytes]:
        texts = pc.fill_null(texts.cast(pa.string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        out: list[bytes] = [b""] * len(texts)
        some, cuttable = np.asarray(pc.binary_length(texts)) > 0, np.asarray(self._cuttable(texts))
        cut, whole = np.flatnonzero(some & cuttable), np.flatnonzero(some & ~cuttable)
        if len(cut):
            lists = self._pieces(texts.take(pa.array(cut)))
            pieces = lists.flatten().dictionary_encode()
            times = np.bincount(pieces.indices.to_numpy(), minlength=len(pieces.dictionary))
            _, ends, data = self._known(pieces.dictionary, times).take(pieces.indices).buffers()
            at, raw = np.frombuffer(ends, "<i8")[lists.offsets.to_numpy()].tolist(), data.to_pybytes() if data else b""
            for i, a, b in zip(cut.tolist(), at[:-1], at[1:], strict=True):
                out[i] = raw[a:b]
        for i, ids in zip(whole.tolist(), self._ids(self.full, texts.take(pa.array(whole)).to_pylist()), strict=True):
            out[i] = ids
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder; its cache serves the next task too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
