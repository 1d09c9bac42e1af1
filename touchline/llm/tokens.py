"""Token ids of whole texts with the tokenizers library, cached by chunk.

A text is cut before each single space; a chunk never changes the ids of its neighbours in the supported vocabularies
(their pre-tokenizers never cross from ink to a following space).  A text in which white space follows a space, or that ends
in one, is encoded in one piece, and so is a text with a NUL or with the content of an added token ('<|endoftext|>').  Pieces that
were seen before come from a bounded cache, all others from the library: words of ASCII and Latin-1 letters from its model, as they
are one piece to the pre-tokenizers (probed for each vocabulary), the rest from its whole pipeline.
"""

from __future__ import annotations

import gc
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from touchline.llm.common import caches

#: Chunks that a Python worker remembers (each in two generations).
CACHE = 600_000
#: Bytes of text that are encoded at a time: the longer, the more of the chunks are the same.
STEP_BYTES = 4 << 20


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file; a path (with a slash) is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
_LETTERS = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x100)) if chr(c).isalpha()]
#: A word of those letters with its space, and the punctuation behind it.
_WORD = re.compile(f"( ?[{''.join(_LETTERS)}]+)([{re.escape(_PUNCTUATION)}]*)")


def _ends_as_letter(word: str) -> bool:
    """Whether the word's last letter is still one after folding: a dotted capital I becomes a letter and a mark."""
    return unicodedata.normalize("NFC", word[-1].lower())[-1].isalpha()


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.lowers = self.tokenizer.encode("A", add_special_tokens=False).ids == self.tokenizer.encode("a", add_special_tokens=False).ids
        self.mark, self.mark_id = None, None
        for mark in ("\n", " \x01 "):  # kept as a piece of its own by one or the other pre-tokenizer
            one, two = (self.tokenizer.encode(t, add_special_tokens=False).ids for t in (f"a{mark}b", f"ab,{mark},b"))
            if len(one) == 3 and two.count(one[1]) == 1:
                self.mark, self.mark_id = mark, one[1]
                break
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.one = [k.to_bytes(4, "little") for k in range(max(self.tokenizer.get_vocab(True).values()) + 1)]
        self.model, self.space = self.tokenizer.model, None
        level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in _LETTERS})
        probes = [f"{a}{w}" for c in _LETTERS for w in (c, f"{c}e", f"n{c}", f"the{c}ing", f"TH{c}R") for a in ("", " ")]
        want = self._library(probes)
        for space in (level.pre_tokenize_str(" ")[0][0], ""):  # a space is a byte of the word, or is dropped
            self.space = space
            if list(map(self._word, probes)) == want:
                break
        else:
            self.space = None  # the model alone doesn't do for this vocabulary

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _word(self, word: str) -> bytes:
        """ids of a word of ``_LETTERS`` (with a space before it or without) from the library's model."""
        bare = word.lstrip(" ")
        spelled = bare.lower() if self.lowers else bare
        if not spelled.isascii():
            spelled = spelled.translate(self.spelled)
        if bare is not word:
            spelled = self.space + spelled
        one = self.one
        return b"".join([one[t.id] for t in self.model.tokenize(spelled)])

    def _many(self, chunks: list[str]) -> list[bytes]:
        """ids of chunks; printable ones are encoded as one text, with a mark between them that has an id of its own."""
        if self.mark is None:
            return self._library(chunks)
        plain = [c for c in chunks if c.isprintable()]
        if not plain:
            return self._library(chunks)
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(plain)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(np.flatnonzero(ids == self.mark_id), len(ids))
        if len(ends) != len(plain):
            return self._library(chunks)
        data = ids.tobytes()
        found = [data[a:b] for a, b in zip([0, *(4 * ends[:-1] + 4).tolist()], (4 * ends).tolist(), strict=True)]
        if len(plain) == len(chunks):
            return found
        rest = [c for c in chunks if not c.isprintable()]
        both = dict(zip(plain, found, strict=True)) | dict(zip(rest, self._library(rest), strict=True))
        return [both[c] for c in chunks]

    def _learn(self, chunks: list[str]) -> None:
        """Cache chunks.  Ink after a letter that is punctuation up to the chunk's end is a piece of its own in the
        supported pre-tokenizers, so such a chunk is put together from its word and its tail."""
        young, old = self.young, self.old
        split, ask, match = [], {}, _WORD.fullmatch if self.space is not None else lambda _: None
        for chunk in chunks:
            if (found := match(chunk)) is not None:
                word, tail = found.groups()
                ids = young.get(word) or old.get(word) or self._word(word)
                young[word] = ids
                if not tail:
                    continue
                if (more := young.get(tail)) is not None:
                    young[chunk] = ids + more
                    continue
                split.append((chunk, (word, tail)))
                ask[tail] = None
                continue
            word = chunk.rstrip(_PUNCTUATION)
            if word != chunk and word[-1:].isalpha() and _ends_as_letter(word):
                parts = (self._folded(word), chunk[len(word) :])
            else:
                parts = (self._folded(chunk),)
            split.append((chunk, parts))
            for p in parts:
                if p not in young:
                    if p in old:
                        young[p] = old[p]
                    else:
                        ask[p] = None
        if ask:
            young.update(zip(ask, self._many(list(ask)), strict=True))
        for chunk, parts in split:
            young[chunk] = b"".join([young[p] for p in parts])

    def _folded(self, chunk: str) -> str:
        if not (self.lowers and chunk.isascii()):
            return chunk
        low = chunk.lower()
        return chunk if self._has_added(low) else low  # added tokens are found before letters are folded

    def _has_added(self, text: str) -> bool:
        for content in self.added:
            if content in text:
                return True
        return False

    def encode(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """ids of each text.  The collector of cycles rests meanwhile: it would walk the lists of chunks over and over."""
        resting = gc.isenabled()
        gc.disable()
        try:
            return self._encode(pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string()))
        finally:
            if resting:
                gc.enable()

    def _encode(self, texts: pa.Array) -> list[bytes]:
        """Arrow cuts the texts and numbers their different chunks, which are looked up once for all texts; numpy puts ids together."""
        texts, n = texts.fill_null(""), len(texts)
        if not n:
            return []
        whole = np.zeros(n, bool)
        for content in ("\0", *self.added):
            whole |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        cut = pc.split_pattern(texts, " ")
        ranges, coded = cut.offsets.to_numpy().astype(np.int64), cut.values.dictionary_encode()
        keys, codes = [f" {k}" for k in coded.dictionary.to_numpy(zero_copy_only=False).tolist()], coded.indices.to_numpy().astype(np.int64)
        codes[ranges[:-1]] = np.arange(len(keys), len(keys) + n)  # a text's first chunk has no space
        keys += cut.values.take(pa.array(ranges[:-1])).to_numpy(zero_copy_only=False).tolist()
        used = np.zeros(len(keys), bool)
        used[codes[~np.repeat(whole, np.diff(ranges))]] = True
        young, old, late, uncut = self.young, self.old, [], np.zeros(len(keys), bool)
        ids = list(map(young.get, keys))
        for i in [i for i, have in enumerate(ids) if have is None]:
            key = keys[i]
            if (have := old.get(key)) is not None:
                young[key] = ids[i] = have
            elif used[i] and not (key == " " or key[1:2].isspace()):
                late.append(i)
            else:
                ids[i], uncut[i] = b"", used[i]
        if late:
            self._learn(list(dict.fromkeys([keys[i] for i in late])))
            for i in late:
                ids[i] = young[keys[i]]
        whole[np.searchsorted(ranges, np.flatnonzero(uncut[codes]), "right") - 1] = True
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        counts = size[codes]
        ends = np.cumsum(counts)
        place = np.arange(ends[-1]) + np.repeat((np.cumsum(size) - size)[codes] - ends + counts, counts)
        data = np.frombuffer(b"".join(ids), "<u4")[place].tobytes()
        edges = (4 * np.concatenate([[0], ends])[ranges]).tolist()
        out = [data[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
        if whole.any():
            at = np.flatnonzero(whole)
            for k, found in zip(at.tolist(), self._library(texts.take(pa.array(at)).to_pylist()), strict=True):
                out[k] = found
        if len(young) > CACHE:
            self.old, self.young = young, {}
        return out


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)


caches.append(encoder.cache_clear)
