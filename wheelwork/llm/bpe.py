"""Byte-level BPE encoding with the tokenizers library, remembering what has been encoded.

Texts are cut before each single space, and around commas, points and line breaks that
stand after a word: no token crosses such a cut, as the pre-tokenizer cuts there too.
Equal chunks of a batch are looked up once. Unknown words of letters go through the
library's model, already in its byte-level alphabet; other unknown chunks go through the
whole tokenizer. A text where a cut could be wrong (two spaces in a row, a point after a
sign) is encoded whole, and so is one with the string of a special token: as the library
does by itself, that string becomes the special token's id, unless it is asked to take it
as ordinary text.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wheelwork.llm.common import kept_for_stage

#: Entries remembered per generation and worker: two generations of some 80 MB.
GENERATION = 400_000


def encoder(path: str, special_as_text: bool = False) -> Encoder:
    """The worker's encoder for a tokenizer file; it lives as long as the stage of the task that asks (in ``tidy``)."""
    return kept_for_stage((path, special_as_text), lambda: Encoder(path, special_as_text))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes with a byte-level BPE file whose pre-tokenizer is the usual regex without a space put first; refuses others."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        n = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if n <= 1 << 16 else "<u4")
        # the same model behind a split at blanks, for words that are already in the byte-level alphabet
        with open(path, encoding="utf-8") as file:
            parts = json.load(file)
        cut = parts.get("pre_tokenizer") or {}
        if parts["model"].get("type", "BPE") != "BPE" or parts.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError(f"{path} is no byte-level BPE with the regex pre-tokenizer and without a prefix space")
        self.special = [] if special_as_text else [t["content"] for t in parts["added_tokens"]]
        self.split = Tokenizer(self.tokenizer.model)
        self.split.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = byte_letters() | {0: " "}
        self.opens = np.zeros(n, bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token.startswith(self.letters[32])
        #: ids of chunks, of this generation and the one before
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> None:
        """Learns words of letters, each with a space before it."""
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            text = ("\0".join([" " + w for w in part])).encode().decode("latin-1").translate(self.letters)
            ids = np.array(self.split.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            at = (np.flatnonzero(self.opens[ids]) * ids.itemsize).tolist()
            packed = ids.tobytes()
            self.new.update(zip(part, [packed[a:b] for a, b in zip(at, [*at[1:], len(packed)], strict=True)], strict=True))

    def _learn(self, chunks: list[str]) -> None:
        """Learns chunks: words of letters in one go, words with signs after them in two parts, all others whole."""
        known, before = self.new, self.old
        words, heads, parts, others = set(), [], [], []
        for c in chunks:
            if (ids := before.get(c)) is not None:
                known[c] = ids
            elif c.isalpha():
                words.add(c)
            elif c[:1] == HEAD and c[1:].isalpha():
                heads.append(c)
            elif (w := c.rstrip(SIGNS)).isalpha():
                parts.append((c, w))
                if w not in known:
                    words.add(w)
            else:
                others.append(c)
        self._words(list(words))
        if heads:
            plain = "\0".join(heads).replace(HEAD, "").encode().decode("latin-1").translate(self.letters).split(" ")
            known.update(zip(heads, [np.array(e.ids, self.dtype).tobytes() for e in self.split.encode_batch_fast(plain, add_special_tokens=False)], strict=True))
        signs = list({c[len(w) :] for c, w in parts})
        after = dict(zip(signs, self._whole(signs), strict=True))
        for c, w in parts:
            known[c] = known[w] + after[c[len(w) :]]
        known.update(zip(others, self._whole([c[1:] if c[:1] in (MARK, HEAD) else " " + c for c in others]), strict=True))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a string array without nulls, as packed ``dtype`` integers."""
        if len(self.new) > GENERATION:
            self.old, self.new = self.new, {}
        known, width = self.new, self.dtype.itemsize
        plain = pc.binary_join_element_wise(pa.scalar(HEAD), texts, pa.scalar(""))
        for found, cut in ((("\n", f" {MARK}\n {HEAD}")), (", ", f" {MARK}, "), (". ", f" {MARK}. ")):
            plain = pc.replace_substring(plain, found, cut)
        lists = pc.split_pattern(plain, " ")
        begin = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        chunks = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(known.get, chunks))
        if None in ids:
            self._learn([c for c, x in zip(chunks, ids, strict=True) if x is None])
            ids = list(map(known.__getitem__, chunks))
        # chunk by chunk, the ids of all texts one after the other
        flat = np.frombuffer(b"".join(ids), self.dtype)
        size = np.fromiter(map(len, ids), np.int32, len(ids)) // width
        start = np.cumsum(size, dtype=np.int32) - size
        index = coded.indices.to_numpy()
        index_size = size[index]
        past = np.cumsum(index_size, dtype=np.int32)
        place = np.repeat(start[index] - past + index_size, index_size) + np.arange(past[-1] if len(past) else 0, dtype=np.int32)
        out = flat[place].tobytes()
        edge = (np.concatenate(([0], past)) * width).tolist()
        # texts in which a cut may not fall where the pre-tokenizer's would, are encoded whole
        kind = np.full(len(chunks), LETTER, np.uint8)
        for i in np.flatnonzero(~pc.utf8_is_alnum(coded.dictionary).to_numpy(zero_copy_only=False)).tolist():
            kind[i] = _kind(chunks[i])
        kind = kind[index]
        before = np.concatenate(([0], kind[:-1])) if len(kind) else kind
        odd = (kind & EMPTY != 0) | ((kind & MARKED != 0) & (before & LETTER == 0)) | ((kind & BREAK != 0) & (before & SPACE != 0))
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(begin, np.flatnonzero(odd), side="right") - 1] = True
        for odd_text in (MARK, HEAD, *self.special):
            whole |= pc.match_substring(texts, odd_text).to_numpy(zero_copy_only=False)
        result = [out[edge[a] : edge[b]] for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        again = np.flatnonzero(whole).tolist()
        for i, x in zip(again, self._whole([texts[i].as_py() for i in again]), strict=True):
            result[i] = x
        return result


#: Before a comma, point or line break that is a chunk of its own; before a chunk without a space before it.
MARK, HEAD = "\x02", "\x01"
#: Signs that form one piece of their own after a word of letters.
SIGNS = ".,;:!?#$%&*|"
#: What matters of a chunk: nothing in it; a mark after letters; a line break; ends with a letter or digit; ends with white space.
EMPTY, MARKED, BREAK, LETTER, SPACE = 1, 2, 4, 8, 16
_MARKS = {MARK + ",": MARKED, MARK + ".": MARKED, MARK + "\n": BREAK}


def _kind(chunk: str) -> int:
    if (k := _MARKS.get(chunk)) is not None:
        return k
    if not chunk or chunk == HEAD or chunk[0] == HEAD and chunk[1].isspace():
        return EMPTY
    last = chunk[-1]
    return LETTER if last.isalnum() else SPACE if last.isspace() else 0


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def in_portions(texts: pa.Array, most: int = 4 << 20):
    """Bounds of slices of a string array of about ``most`` bytes each."""
    lo = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        size += n
        if size >= most:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)
