"""Token ids of whole texts, equal to the tokenizers library's, through a bounded cache of pre-tokens.

Both vocabularies cut a text into pre-tokens and encode each on its own, so the ids of a text are the
joined ids of its pre-tokens. A worker asks the library once for a pre-token it has not met lately and
keeps the answer; the pre-tokens themselves come from one compiled pattern.
"""

from __future__ import annotations

import collections
import functools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The split patterns of the two vocabulary files. L, N, S: letters, numbers, white space.
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[{L}]+| ?[{N}]+| ?[^{S}{L}{N}]+|[{S}]+(?![^{S}])|[{S}]+"
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[{L}]+|[{N}]|[^{S}{L}{N}]+"
#: Unicode's white space.
SPACES = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Characters a worker keeps in its cache before it starts over.
CACHE_CHARS = 12_000_000
#: Characters of the texts that are encoded together.
BLOCK_CHARS = 4_000_000
#: Characters past the Latin blocks; outside the basic plane; white space after a space; what Python alone takes for white space.
BEYOND = re.compile("[\u0370-\U0010ffff]")
ASTRAL = re.compile("[\U00010000-\U0010ffff]")
DOUBLE = re.compile(f" (?:[{SPACES}]|$)")
SEPARATORS = re.compile("[\x1c-\x1f]")


@functools.cache
def _ranges(kind: str, top: int) -> str:
    """Character-class body of all code points up to ``top`` whose category starts with ``kind``."""
    out, first = [], None
    for c in range(top + 2):
        inside = c <= top and unicodedata.category(chr(c))[0] == kind
        if inside and first is None:
            first = c
        elif not inside and first is not None:
            out.append(f"{re.escape(chr(first))}-{re.escape(chr(c - 1))}")
            first = None
    return "".join(out)


@functools.cache
def _pattern(template: str, top: int) -> re.Pattern:
    return re.compile(template.format(L=_ranges("L", top), N=_ranges("N", top), S=SPACES))


class Encoder:
    """Ids of texts by one vocabulary file (JSON of the tokenizers library).

    Strings of special tokens inside a text become their special id, the library's default; nothing is
    added, cut or padded. Null counts as the empty text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        split = spec["pre_tokenizer"]
        lowers = "Lowercase" in json.dumps(spec["normalizer"])
        if split["type"] == "ByteLevel" and split["use_regex"] and not spec["normalizer"]:
            self.template, self.lowers = BYTE_SPLIT, False
        elif lowers and spec["model"]["end_of_word_suffix"] == "</w>":
            self.template, self.lowers = WORD_SPLIT, True
        else:
            raise ValueError(f"unknown kind of vocabulary: {path}")
        self.special = {x["content"]: np.uint32(x["id"]).tobytes() for x in spec["added_tokens"]}
        self.marks = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.merger, self.ends = self._merger(spec["model"]["vocab"])
        self.forget()

    def _merger(self, vocab: dict[str, int]):
        """The same merges for words that each end in a line end, and which ids hold that line end.

        Merge order is id order in both files. The end-of-word mark becomes a line end, which no word of
        that vocabulary holds.
        """
        import tiktoken

        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        others = [b for b in range(256) if b not in printable]
        byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
        ranks = {}
        for token, k in vocab.items():
            if token not in self.special:
                end = b"\n" if self.lowers and token.endswith("</w>") else b""
                ranks[bytes(byte_of[c] for c in (token[:-4] if end else token)) + end] = k
        spare = iter(range(max(vocab.values()) + 1, 1 << 20))
        for b in range(256):
            ranks.setdefault(bytes([b]), next(spare))
        ends = np.zeros(max(ranks.values()) + 1, bool)
        if self.lowers:
            ends[[k for token, k in ranks.items() if token.endswith(b"\n")]] = True
            split = "[^\n]*\n"
        else:
            ends[ranks[b"\n"]] = True
            split = "[^\n]+|\n"
        merger = tiktoken.Encoding("words", pat_str=split, mergeable_ranks=ranks, special_tokens={})
        return merger, ends

    def forget(self) -> None:
        """Empty the caches: of pre-tokens, and of runs of text between single spaces."""
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.held = 0

    def _normal(self, text: str) -> str:
        if not self.lowers:
            return text
        if not text.isascii():
            # lower-casing is by single character there: no special form of a final sigma
            text = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3")
        return text.lower()

    def _split(self, text: str) -> list[str]:
        """Pre-tokens of a normalised text without special strings."""
        if text.isascii():
            top = 0x7F
        else:
            top = 0x10FFFF if ASTRAL.search(text) else 0xFFFF
        return _pattern(self.template, top).findall(text)

    def _cut(self, text: str) -> list[str]:
        """Parts of a normalised text that can be encoded alone.

        White space ends every pre-token of the vocabulary that drops it. In the other one a pre-token can
        begin with a space but not go over one, so a text falls apart at each space behind which no more
        white space follows.
        """
        if self.lowers:
            # Python also splits at these four, which are no white space there
            return self._split(text) if SEPARATORS.search(text) else text.split()
        if DOUBLE.search(text):
            return self._split(text)
        first, *others = text.split(" ")
        return [first, *map(" ".__add__, others)]

    def _unknown(self, text: str | None) -> bool:
        """Whether a code point is one that Python's Unicode tables do not know."""
        return bool(text and BEYOND.search(text) and any(unicodedata.category(c) == "Cn" for c in set(text)))

    def _sections(self, text: str | None):
        """(special string or None, normalised text) in order."""
        if text:
            if "<|" not in text:
                yield None, self._normal(text)
            else:
                for k, part in enumerate(self.marks.split(text)):
                    if k % 2:
                        yield part, ""
                    elif part:
                        yield None, self._normal(part)

    def tally(self, texts) -> tuple[list[dict[str, int]], list[int]]:
        """For each text the frequencies of its pre-tokens, and its number of special strings (of all ids, where
        the library reads the text whole)."""
        counts, marks = [], []
        for text in texts:
            runs: collections.Counter = collections.Counter()
            n = 0
            if self._unknown(text):
                n = len(self.library.encode(text, add_special_tokens=False).ids)
            else:
                for mark, part in self._sections(text):
                    if mark:
                        n += 1
                    else:
                        runs.update(self._cut(part))
            words: dict[str, int] = {}
            for run, k in runs.items():
                for w in self._split(run):
                    words[w] = words.get(w, 0) + k
            counts.append(words)
            marks.append(n)
        return counts, marks

    def counts(self, words: list[str]) -> list[int]:
        """Number of ids of each pre-token; new ones are merged together and remembered."""
        if self.held > CACHE_CHARS:
            self.forget()
        new = [w for w in words if w not in self.words]
        if new:
            self.words.update(zip(new, self.ids_of(new)))
            self.held += sum(map(len, new))
        return [len(self.words[w]) // 4 for w in words]

    def ids_of(self, words: list[str]) -> list[bytes]:
        """Ids of single pre-tokens, all in one call."""
        out: list[bytes | None] = [None] * len(words)
        # a line end closes each word: as the end-of-word mark, or as a token of its own
        plain = [k for k, w in enumerate(words) if "\n" not in w]
        joined = "".join([words[k] + "\n" for k in plain])
        ids = np.array(self.merger.encode_ordinary(joined), np.uint32)
        cuts = np.flatnonzero(self.ends[ids])
        starts = np.concatenate([[0], cuts[:-1] + 1])
        raw = ids.tobytes()
        for k, a, b in zip(plain, (4 * starts).tolist(), (4 * (cuts + self.lowers)).tolist()):
            out[k] = raw[a:b]
        for k, x in enumerate(out):
            if x is None:
                ids = self.library.encode(words[k], add_special_tokens=False).ids
                out[k] = np.array(ids, np.uint32).tobytes()
        return out

    def _learn(self, runs: list[str]) -> None:
        if self.held > CACHE_CHARS:
            self.forget()
        new = {r: self._split(r) for r in set(runs) if r not in self.runs}
        words = list({w for ws in new.values() for w in ws if w not in self.words})
        if words:
            self.words.update(zip(words, self.ids_of(words)))
        for r, ws in new.items():
            self.runs[r] = self.words[ws[0]] if len(ws) == 1 else b"".join([self.words[w] for w in ws])
        self.held += sum(map(len, words)) + sum(map(len, new))

    def _learn_words(self, runs: list[str]) -> None:
        """As ``_learn`` where each pre-token ends in a mark of its own: the runs are merged in one call."""
        if self.held > CACHE_CHARS:
            self.forget()
        new = [r for r in runs if r not in self.runs]
        if not new:
            return
        # a run of letters is one pre-token
        cut = [[r] if r.isalpha() else self._split(r) for r in new]
        joined = "".join(["\n".join(ws) + "\n" if ws else "" for ws in cut])
        ids = np.array(self.merger.encode_ordinary(joined), np.uint32)
        ends = np.concatenate([[0], 4 * (np.flatnonzero(self.ends[ids]) + 1)])
        last = ends[np.cumsum([len(ws) for ws in cut])].tolist()
        raw = ids.tobytes()
        self.runs.update(zip(new, [raw[a:b] for a, b in zip([0, *last], last)]))
        self.held += sum(map(len, new))

    def _encode(self, text: str) -> bytes:
        runs = self._cut(text)
        try:
            return b"".join(map(self.runs.__getitem__, runs))
        except KeyError:
            self._learn(runs)
            return b"".join(map(self.runs.__getitem__, runs))

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A text with a code point that Python's Unicode tables do not know goes to the library whole, whose
        tables may be newer.
        """
        if self._unknown(text):
            ids = self.library.encode(text, add_special_tokens=False).ids
            return np.array(ids, np.uint32).tobytes()
        parts = [self.special[mark] if mark else self._encode(part) for mark, part in self._sections(text)]
        return parts[0] if len(parts) == 1 else b"".join(parts)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """``encode`` of each text.

        Where white space ends every pre-token, plain texts are encoded in blocks: each distinct run between
        ASCII white space is looked up once a block and its ids are dealt to its places as arrays.
        """
        out: list[bytes | None] = [None] * len(texts)
        plain, chars = [], 0
        for k, text in enumerate(texts):
            if not self.lowers or text and ("<|" in text or self._unknown(text)):
                out[k] = self.encode(text)
                continue
            plain.append(k)
            chars += len(text or "")
            if chars >= BLOCK_CHARS:
                self._encode_block(texts, plain, out)
                plain, chars = [], 0
        self._encode_block(texts, plain, out)
        return out

    def _encode_block(self, texts: list[str | None], places: list[int], out: list[bytes | None]) -> None:
        if not places:
            return
        normal = pa.array([self._normal(texts[k] or "") for k in places], pa.large_string())
        split = pc.ascii_split_whitespace(normal)
        coded = split.flatten().dictionary_encode()
        runs = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._learn_words(runs)
        ids = pa.array(list(map(self.runs.__getitem__, runs)), pa.large_binary()).take(coded.indices)
        _, offsets, raw = ids.buffers()
        starts = np.frombuffer(offsets, np.int64)[ids.offset : ids.offset + len(ids) + 1]
        ends = starts[split.offsets.to_numpy()].tolist()
        raw = raw.to_pybytes() if raw else b""
        for k, a, b in zip(places, ends, ends[1:]):
            out[k] = raw[a:b]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path)


def vocabulary(name: str) -> str:
    """Path of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
