"""Whole-text encoding from the ids of repeated units, many texts at a time.

All three vocabularies split a text before they merge, and no merge crosses a
single space between two ordinary characters. So the texts of a block are cut
there by Arrow, and only the block's distinct units are encoded; each text's ids
are the units' ids in order: the same ids as encoding the text at once. A word of
letters and the marks behind it are atoms of their own, kept in a bounded cache;
any other unit goes to the library. Where white space is anything but single
spaces and newlines between ordinary characters, a text isn't cut and the library
gets it whole.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from planweft.llm.shared import give_back

#: White space and controls that make a cut beside them unsafe, besides the space and the newline themselves.
_ODD = r"[\x00-\x09\x0b-\x1f\x7f-\x{a0}\x{ad}\x{34f}\x{61c}\x{115f}\x{1160}\x{1680}\x{180b}-\x{180f}\x{2000}-\x{200f}\x{2028}-\x{202f}\x{205f}-\x{206f}\x{3000}\x{fe00}-\x{fe0f}\x{feff}\x{e0000}-\x{e0fff}]"
#: Neighbouring white space, or some at a text's end.
_UNEVEN = r"  | \n|\n |\n\n|\A[ \n]|[ \n]\z"
#: Letters that all vocabularies take for letters, with the same small ones.
LETTERS = "".join(map(chr, (*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100))))
#: Begins a unit that has no space before it.
BARE = "\x02"
#: A word, what stands before it, and the marks behind it; all vocabularies split a letter from a mark, but for the apostrophe.
_WORD = rf"\A(?P<head>[\x02\n]?)(?P<word>[{LETTERS}]+)(?P<tail>[!-&(-/:-@\[-`{{-~]*)\z"
#: Text bytes whose words are told apart at once, and words whose ids are laid out at once; one longer text aside.
BLOCK = 8 << 20
LAID = 1 << 18


class Units(dict):
    """unit -> little-endian 32-bit ids, of two generations of at most ``most`` units.

    A full generation becomes the old one, and units found there move to the new one.
    """

    def __init__(self, encode: Callable[[str], bytes], most: int):
        super().__init__()
        self.encode, self.most, self.old = encode, most, {}

    def __missing__(self, unit: str) -> bytes:
        ids = self.old.get(unit)
        if ids is None:
            ids = self.encode(unit)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[unit] = ids
        return ids


def blocks(texts: pa.Array, most_bytes: int = BLOCK) -> Iterator[pa.Array]:
    """Slices of at most ``most_bytes`` of text, or one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, "right")))
        yield texts.slice(at, end - at)
        at = end


def joined(blobs: list[bytes], kind=np.dtype("<u4")) -> tuple[np.ndarray, np.ndarray]:
    """Numbers one after another, and how many each blob has."""
    return np.frombuffer(b"".join(blobs), kind), np.fromiter(map(len, blobs), np.int64, len(blobs)) // np.dtype(kind).itemsize


def gathered(flat: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists ``which`` of lists that lie in ``flat`` one after another, and their ends."""
    n = sizes[which]
    ends = np.cumsum(n)
    if not len(ends):
        return flat[:0], ends
    at = np.repeat((np.cumsum(sizes) - sizes)[which] - (ends - n), n)
    at += np.arange(ends[-1])
    return flat[at], ends


class Library:
    """The ids of one tokenizer file, by the tokenizers library.

    ``spaced``: units begin with the space before them, as byte-level
    vocabularies have it; else white space is dropped and letters are small. The library's
    defaults hold otherwise: no special token is added, and their strings count as it has them.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.tokenizer, self.spaced = Tokenizer.from_file(path), spaced
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, normalizer = self.tokenizer.model, self.tokenizer.normalizer
        if (normalizer.normalize_str(LETTERS) if normalizer else LETTERS) != (LETTERS if spaced else LETTERS.lower()):
            raise ValueError("the tokenizer changes letters in another way")
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in visible]
        # the byte-level alphabet: visible bytes stand for themselves, the others for characters from 256 on
        self.alphabet = joined([chr(b if b in visible else 256 + hidden.index(b)).encode() for b in range(256)], np.uint8)

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs of letters, with the space before them if they have one: each is one pre-token, so only the model's merges are left to do."""
        words = words.cast(pa.large_string())
        offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        raw, ends = gathered(*self.alphabet, raw)
        offsets = np.concatenate([[0], ends])[offsets - offsets[0]]
        spelled = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw)))
        tokenize, ids, sizes = self.model.tokenize, [], []
        for word in spelled.to_pylist():
            found = tokenize(word)
            sizes.append(len(found))
            ids += [t.id for t in found]
        return np.array(ids, np.uint32), np.array(sizes, np.int64)

    def distinct(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct units, one after another, and how many each has."""
        parts = pc.extract_regex(units, _WORD)
        fits = pc.is_valid(parts).to_numpy(zero_copy_only=False)
        head, word, tail = (parts.field(c).filter(pa.array(fits)) for c in ("head", "word", "tail"))
        if self.spaced:
            no = pa.scalar("", word.type)
            word = pc.binary_join_element_wise(pc.if_else(pc.equal(head, no), pa.scalar(" ", word.type), no), word, no)
        else:
            word = pc.utf8_lower(word)
        word, tail = word.dictionary_encode(), tail.dictionary_encode()
        odd = units.filter(pa.array(~fits)).to_pylist()
        if self.spaced:
            odd = [u[1:] if u[:1] == BARE else u if u[:1] == "\n" else f" {u}" for u in odd]
        marks = tail.dictionary.to_pylist()
        # atoms of each unit: a newline, a word or an odd unit, marks
        (flat, sizes), (more, n) = self.words(word.dictionary), joined([self.whole(x) for x in ("\n", *marks, *odd, "")])
        flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, n])
        none, newline = len(sizes) - 1, len(word.dictionary)
        atoms = np.full((len(units), 3), none)
        atoms[fits, 0] = np.where(pc.equal(head, "\n").to_numpy(zero_copy_only=False), newline, none)
        atoms[fits, 1] = word.indices.to_numpy(zero_copy_only=False)
        atoms[fits, 2] = newline + 1 + tail.indices.to_numpy(zero_copy_only=False)
        atoms[~fits, 1] = newline + 1 + len(marks) + np.arange(len(odd))
        ids, ends = gathered(flat, sizes, atoms.ravel())
        return ids, np.diff(ends[2::3], prepend=0)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of whole texts (null: none) one after another, unsigned 32-bit, and each text's end, for some texts after others."""
        for some in blocks(texts):
            some = pc.fill_null(some, "").cast(pa.large_string())
            unsafe = pc.match_substring_regex(some, f"{_ODD}|{_UNEVEN}" if self.spaced else BARE)
            apart = unsafe.to_numpy(zero_copy_only=False)
            if apart.any():
                whole = [self.whole(x) for x in some.filter(unsafe).to_pylist()]
                some = pc.if_else(unsafe, "", some)
            if self.spaced:
                some = pc.binary_join_element_wise(pa.scalar(BARE, pa.large_string()), pc.replace_substring(some, "\n", " \n"), pa.scalar("", pa.large_string()))
            else:
                some = pc.replace_substring(some, "\n", " ")
            lists = pc.split_pattern(some, " ")
            last = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            units = lists.flatten().dictionary_encode()
            flat, sizes = self.distinct(units.dictionary)
            which = units.indices.to_numpy(zero_copy_only=False)
            if apart.any():  # a text that isn't cut is one more unit
                more, n = joined(whole)
                which = which.copy()
                which[last[apart] - 1] = len(sizes) + np.arange(len(n))
                flat, sizes = np.concatenate([flat, more]), np.concatenate([sizes, n])
            del some, lists, units
            starts, at = np.concatenate([[0], last]), 0
            while at < len(last):
                end = max(at + 1, int(np.searchsorted(last, starts[at] + LAID, "right")))
                ids, ends = gathered(flat, sizes, which[starts[at] : starts[end]])
                yield ids, np.concatenate([[0], ends])[last[at:end] - starts[at]]
                at = end
            give_back()

    def documents(self, texts: pa.Array, end_id: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """As :meth:`encode`, with ``end_id`` behind each text's ids."""
        for ids, ends in self.encode(texts):
            yield np.insert(ids, ends, end_id), ends + 1 + np.arange(len(ends))

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of one whole text."""
        return next(self.encode(pa.array([text])))[0].tobytes()


@functools.cache
def of_file(path: str, spaced: bool) -> Library:
    """A tokenizer file, loaded once in a worker process."""
    return Library(path, spaced)
