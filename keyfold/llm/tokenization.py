"""Whole-text encoding with a public tokenizer file, each different word once a batch.

A byte-level BPE file splits a text at every change from a non-space to a space
and encodes the parts one by one, so a text is its words between spaces, each
with the space before it. Arrow splits a batch of texts and numbers its words;
punctuation behind a word of Latin letters is set apart, as the file does. The
library encodes each different part once, many in one joined call whose ids are
dealt back by their byte lengths, and the texts are put together from them. The
ids equal those of encoding each whole text at once, and nothing is kept from
batch to batch. Texts in which a run of white space crosses a cut, or that hold
the string of an added token, are encoded whole, as is every text where the file
is of another kind.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a task a core

SPACES = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: White space that goes on beyond the space that a text is cut at.
_CROSSING = rf"[{SPACES}] (?:[{SPACES}]|\z)"
#: Words that a joined call could not tell from their neighbours' white space.
_LOOSE = rf"\A[{SPACES}]|[{SPACES}]\z|\A\z"
#: Latin letters, and ASCII punctuation behind them; an apostrophe may begin a part with letters.
_LETTERS = r"[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{17f}]"
_PUNCTUATED = rf"\A(?P<core>{_LETTERS}+)(?P<tail>[!-&(-/:-@\[-`{{-~]+)\z"
#: Words in a joined call; joined texts in a call.
_RUN, _CALL = 128, 64
#: Bytes of text that are split and numbered together.
_SLICE = 16 << 20

_encoders: dict[tuple[str, bool], Encoder] = {}


def _joined(ids: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The parts of ``ids`` (which end at ``ends``) numbered ``which``, one after another, and their ends."""
    counts = np.diff(ends, prepend=0)[which]
    out = np.cumsum(counts)
    at = np.repeat((ends[which] - out).astype(np.int32), counts)
    at += np.arange(len(at), dtype=np.int32)
    return ids[at], out


class Encoder:
    """Encodes texts to unsigned 32-bit ids.

    Strings of added tokens in a text become those tokens, as the library does by
    itself; with ``special_as_text`` they are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False, max_known: int = 1_500_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, added = spec.get("pre_tokenizer") or {}, spec.get("added_tokens") or []
        self.by_word = (
            pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space")
            and pre.get("use_regex", True)
            and spec.get("normalizer") is None
            and spec["model"]["type"] == "BPE"
            and not spec["model"].get("dropout")
        )
        self.whole_if = [x["content"] for x in added if not (special_as_text and x.get("special"))]
        vocabulary = self.tokenizer.get_vocab()
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = list(map(len, vocabulary))  # a character a byte
        # words with a space before them, their ids one after another, and where each word's end
        self.max_known, self.known = max_known, (pa.array([], pa.large_string()), np.zeros(0, "<u4"), np.zeros(0, np.int64))

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, one after another, and their ends."""
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.array([x for own in found for x in own], "<u4")
        return ids, np.cumsum([len(own) for own in found], dtype=np.int64)

    def _spaced(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words, each with a space before it, and their ends."""
        loose = pc.match_substring_regex(words, _LOOSE).to_numpy(zero_copy_only=False)
        rest, tight = np.flatnonzero(loose), np.flatnonzero(~loose)
        ids, ends = self._whole([" " + x for x in words.take(pa.array(rest)).to_pylist()])
        parts, at = [ids], len(ids)
        place, counts = np.empty((2, len(words)), np.int64)  # a word's end in the order of encoding, and its ids
        place[rest], counts[rest] = ends, np.diff(ends, prepend=0)
        sizes = pc.binary_length(words).to_numpy() + 1
        for a in range(0, len(tight), _RUN * _CALL):
            own = tight[a : a + _RUN * _CALL]
            runs = pa.ListArray.from_arrays([*range(0, len(own), _RUN), len(own)], words.take(pa.array(own)))
            ids, _ = self._whole([" " + x for x in pc.binary_join(runs, pa.scalar(" ", words.type)).to_pylist()])
            ends, stops = np.cumsum(self.bytes_of[ids]), np.cumsum(sizes[own])
            cuts = np.searchsorted(ends, stops)
            if not np.array_equal(ends[cuts], stops):
                raise ValueError("a token crosses the space between two words")
            place[own], counts[own] = at + cuts + 1, np.diff(cuts, prepend=-1)
            parts.append(ids)
            at += len(ids)
        out = np.cumsum(counts)
        return np.concatenate(parts)[np.repeat(place - out, counts) + np.arange(at)], out

    def _remembered(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_spaced`, for words that are not known from before."""
        known, ids, ends = self.known
        found = pc.index_in(words, value_set=known).fill_null(-1).to_numpy()
        new = np.flatnonzero(found < 0)
        fresh = words.take(pa.array(new))
        new_ids, new_ends = self._spaced(fresh)
        which = found.astype(np.int64)
        which[new] = len(ends) + np.arange(len(new))
        ids, ends = np.append(ids, new_ids), np.append(ends, new_ends + len(ids))
        out = _joined(ids, ends, which)
        full = len(known) + len(fresh) > self.max_known
        self.known = (words, *out) if full else (pa.concat_arrays([known, fresh]), ids, ends)
        return out

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_spaced`, with equal letters before different punctuation encoded once."""
        parts = pc.extract_regex(words, _PUNCTUATED)
        core, tail = (pc.struct_field(parts, x).fill_null("") for x in ("core", "tail"))
        main = pc.if_else(parts.is_valid(), core, words).dictionary_encode()
        tails = tail.dictionary_encode()
        ids, ends = self._remembered(main.dictionary)
        tail_ids, tail_ends = self._whole(tails.dictionary.to_pylist())
        which = np.empty(2 * len(words), np.int64)
        which[::2], which[1::2] = main.indices.to_numpy(), tails.indices.to_numpy() + len(ends)
        ids, ends = _joined(np.append(ids, tail_ids), np.append(ends, tail_ends + len(ids)), which)
        return ids, ends[1::2]

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        whole = pc.match_substring_regex(texts, _CROSSING)
        for content in self.whole_if:
            whole = pc.or_(whole, pc.match_substring(texts, content))
        places = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        starts = split.offsets.to_numpy()
        numbered = split.flatten().dictionary_encode()
        heads = numbered.take(pa.array(starts[:-1])).dictionary_decode().dictionary_encode()
        ids, ends = self._words(numbered.dictionary)
        which = numbered.indices.to_numpy().astype(np.int64)
        for extra, number in (
            (self._whole(heads.dictionary.to_pylist()), heads.indices.to_numpy()),
            (self._whole(texts.take(pa.array(places)).to_pylist()), None),
        ):
            if number is not None:
                which[starts[:-1]] = len(ends) + number
            else:
                which[starts[:-1][places]] = len(ends) + np.arange(len(places))
            ids, ends = np.append(ids, extra[0]), np.append(ends, extra[1] + len(ids))
        ids, ends = _joined(ids, ends, which)
        return iter(np.split(ids, ends[starts[1:-1] - 1]))

    def encode_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text; a null text is empty."""
        texts = texts.cast(pa.large_string()).fill_null("")
        if not self.by_word:
            for text in texts:
                yield self._whole([text.as_py()])[0]
            return
        size, a = np.cumsum(pc.binary_length(texts).to_numpy()), 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + _SLICE, "right")))
            yield from self._slice(texts.slice(a, b - a))
            a = b


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for ``path``."""
    key = path, special_as_text
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]
