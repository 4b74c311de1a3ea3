"""Encoding a text part by part, where the byte-level pre-tokeniser always cuts.

The public pattern splits text before any merge, and a merge never crosses such
a split.  A single space between two non-space characters always starts a new
piece, so the parts of ``text.split(" ")`` can be encoded one by one, and a word
that was seen before need not be encoded again.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

#: White space in other than lone spaces and lone line feeds: such texts are cut by SAFE.
ODD = ("  ", "\n\n", " \n", "\n ", *(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"))
#: A space between two characters that are no white space.
SAFE = re.compile(r"(?<=\S) (?=\S)")


def odd(text: str) -> bool:
    """Whether a text has other white space than lone spaces and lone line feeds between other characters."""
    return text != "" and (text[0].isspace() or text[-1].isspace() or any(x in text for x in ODD))


class _Words(dict):
    """Bytes by word; ``lead`` is what stands before each of them.  Long ones are not kept."""

    def __init__(self, lead: str, owner: PartCache):
        super().__init__()
        self.lead, self.owner = lead, owner
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        owner = self.owner
        if part.isalpha():
            found = self.old.get(part)
            if found is None:
                found = owner.piece(self.lead + part)
            if len(part) <= 64:
                self._keep(part, found)
            return found
        word, last = part[:-1], part[-1:]
        if last in owner.marks and word.isalpha():
            known = self.get(word)
            if known is None:
                return self[word] + owner.marks[last]
            self._keep(part, known + owner.marks[last])  # a word that came before
            return known + owner.marks[last]
        found = b"".join([owner.any(x) for x in owner.split(self.lead + part)])
        if len(part) <= 32:
            self._keep(part, found)
        return found

    def _keep(self, part: str, found: bytes) -> None:
        self[part] = found
        if len(self) > self.owner.limit:
            self.old = dict(self)
            self.clear()


class PartCache:
    """``encode(text)`` gives the joined bytes that ``piece`` gives for each pre-token of a text.

    ``pattern`` splits text into pre-tokens.  A cache of ``limit`` words starts
    anew when it is full and its predecessor serves once more; that costs time
    and never changes a result.  Any text is allowed: empty, white space only,
    or one long part.
    """

    def __init__(self, pattern: str, piece: Callable[[str], bytes], limit: int = 400_000):
        self.split = regex.compile(pattern).findall
        self.piece, self.limit = piece, limit
        self.line = piece("\n")
        self.marks = {x: piece(x) for x in ".,;:!?"}
        self.other: dict[str, bytes] = {}
        self.after, self.first = _Words(" ", self), _Words("", self)

    def any(self, token: str) -> bytes:
        found = self.other.get(token)
        if found is None:
            if len(self.other) > self.limit:
                self.other.clear()
            found = self.piece(token)
            if len(token) <= 64:
                self.other[token] = found
        return found

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        first, after = self.first.__getitem__, self.after.__getitem__
        if odd(text):
            cut = SAFE.split(text)
            return first(cut[0]) + b"".join(map(after, cut[1:]))
        out = []  # lone spaces, and lone line feeds, which are pieces of their own
        for line in text.split("\n"):
            word, *words = line.split(" ")
            out.append(first(word) + b"".join(map(after, words)))
        return self.line.join(out)


def runs(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places begin to begin + size of each run, one run after another."""
    ends = np.cumsum(size)
    out = np.repeat(begin - ends + size, size)
    out += np.arange(len(out))
    return out


class PartStore:
    """Ids of many texts at once: each distinct part of them is looked up once.

    A part is what a space leads (``word``) or what a line feed leads (``\nWord``,
    whose ids start with that of the line feed).  ``pieces`` gives the ids of
    pre-tokens that line feeds part, one after another, and how many each has.
    Parts seen before come from the store.  Beyond ``limit`` parts, or 16 times as many characters, those
    that were not met for longest are forgotten; that costs time and never changes
    a result.
    """

    def __init__(self, pattern: str, pieces: Callable[[str], tuple[np.ndarray, np.ndarray]], line: bytes, limit: int = 600_000):
        self.split, self.pieces, self.limit = regex.compile(pattern).findall, pieces, limit
        self.line, self.marks = np.frombuffer(line, dtype="<u4"), {x: "\n" + x for x in ".,;:!?"}
        self.index: dict[str, int] = {}  # in ascending order of its values
        self.chars = self.now = 0
        self.ids, self.begin, self.size, self.used = self.line[:0], *(np.zeros(0, dtype=np.int64) for _ in range(3))
        self._add(["\n"], self.line, np.array([len(self.line)]))
        self.used[0] = np.iinfo(np.int64).max

    def _add(self, parts: list[str], ids: np.ndarray, size: np.ndarray) -> None:
        begin, first = len(self.ids) + np.cumsum(size) - size, len(self.index)
        self.ids, self.begin, self.size = (np.concatenate(x) for x in ((self.ids, ids), (self.begin, begin), (self.size, size)))
        self.used = np.concatenate([self.used, np.zeros(len(parts), dtype=np.int64)])
        self.index.update(zip(parts, range(first, first + len(parts))))
        self.chars += sum(map(len, parts))

    def _learn(self, parts: list[str]) -> None:
        spaced, lined, mixed, tokens, counts = [], [], [], [], []  # tokens: the pre-tokens of mixed parts, as parts
        for part in parts:
            if part.isalpha():
                spaced.append(part)
            elif part[-1] in self.marks and part[:-1].isalpha():
                mixed.append(part)
                tokens += part[:-1], self.marks[part[-1]]
                counts.append(2)
            elif part[0] == "\n":
                if part[1:].isalpha() or len(found := self.split(part[1:])) == 1:
                    lined.append(part)
                else:
                    mixed.append(part)
                    tokens += ["\n" + t for t in found]
                    counts.append(len(found))
            elif len(found := self.split(" " + part)) == 1:
                spaced.append(part)
            else:
                mixed.append(part)
                tokens.append(found[0][1:])
                tokens += ["\n" + t for t in found[1:]]
                counts.append(len(found))
        for t in set(tokens).difference(self.index, spaced, lined):
            (lined if t[0] == "\n" else spaced).append(t)
        if spaced:
            self._add(spaced, *self.pieces(" " + "\n ".join(spaced)))
        if lined:
            ids, size = self.pieces("".join(lined)[1:])
            begin = np.cumsum(size) - size
            self._add(lined, np.insert(ids, np.repeat(begin, len(self.line)), np.tile(self.line, len(lined))), size + len(self.line))
        if mixed:
            at = np.array(list(map(self.index.__getitem__, tokens)))
            first = np.cumsum([0, *counts])[:-1]
            less = np.full(len(at), len(self.line))  # of tokens that no line feed leads here
            less[first] = 0
            size = self.size[at] - less
            self._add(mixed, self.ids[runs(self.begin[at] + less, size)], np.add.reduceat(size, first))

    def _forget(self) -> None:
        keep, names = np.sort(np.argsort(-self.used, kind="stable")[: self.limit // 2]), list(self.index)
        parts = [names[k] for k in keep.tolist()]
        if sum(map(len, parts)) > 8 * self.limit:
            keep, parts = keep[:1], parts[:1]
        ids, size, used = self.ids[runs(self.begin[keep], self.size[keep])], self.size[keep], self.used[keep]
        self.index, self.chars, self.ids, self.begin, self.size = {}, 0, ids[:0], self.begin[:0], size[:0]
        self.used = used[:0]
        self._add(parts, ids, size)
        self.used = used

    def places(self, parts: list[str]) -> np.ndarray:
        """Where the ids of each of these distinct parts are."""
        if len(self.index) > self.limit or self.chars > 16 * self.limit:
            self._forget()
        at = np.fromiter(map(self.index.get, parts, repeat(-1)), dtype=np.int64, count=len(parts))
        if len(new := np.flatnonzero(at < 0)):
            lost = [parts[k] for k in new.tolist()]
            self._learn(lost)
            at[new] = list(map(self.index.__getitem__, lost))
        self.now += 1
        self.used[at[at > 0]] = self.now
        return at

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of each text; none is null or ``odd``.  A line feed is put before each, and its id is left out again."""
        if not len(texts):
            return []
        line, nothing = pa.scalar("\n", texts.type), pa.scalar("", texts.type)
        split = pc.split_pattern(pc.binary_join_element_wise(line, pc.replace_substring(texts, "\n", " \n"), nothing), " ")
        coded = split.flatten().dictionary_encode()
        at = self.places(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        size = self.size[at]
        ids = self.ids[runs(self.begin[at], size)]
        ends = np.concatenate([[0], np.cumsum(size)])[split.offsets.to_numpy()].tolist()
        return [ids[i + len(self.line) : j] for i, j in zip(ends, ends[1:])]


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


def library_piece(tokenizer) -> Callable[[str], bytes]:
    """Ids of one pre-token by the model of a ``tokenizers.Tokenizer``, as little-endian 32-bit integers."""
    letters = dict(enumerate(byte_letters()))
    space, tokenize = letters[32], tokenizer.model.tokenize

    def piece(text: str) -> bytes:
        if text.isascii() and text.isprintable():  # then only the space has another letter
            shown = text.replace(" ", space)
        else:
            shown = text.encode().decode("latin-1").translate(letters)
        return array("I", [t.id for t in tokenize(shown)]).tobytes()

    return piece


def library_pieces(tokenizer) -> Callable[[str], tuple[np.ndarray, np.ndarray]]:
    """As ``library_piece`` for pre-tokens that line feeds part: their ids, and how many each has."""
    letters = np.array([ord(x) for x in byte_letters()], dtype="<u2")
    letters[10] = 10
    tokenize = tokenizer.model.tokenize

    def pieces(texts: str) -> tuple[np.ndarray, np.ndarray]:
        ids, size = array("I"), array("q")
        for found in map(tokenize, letters[np.frombuffer(texts.encode(), dtype=np.uint8)].tobytes().decode("utf-16-le").split("\n")):
            size.append(len(found))
            ids.extend([t.id for t in found])
        return np.array(ids, dtype="<u4"), np.array(size, dtype=np.int64)

    return pieces
