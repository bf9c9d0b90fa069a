"""Exact token ids of a public word-level BPE, fast.

A text is cut at white space into chunks, and a chunk by the tokenizer's own pattern into pieces. Chunks met before
come from a per-worker cache. Pieces of new ones are merged by the byte-pair encoder of tiktoken, given the same merges
by rank; a piece's end, on which merges depend, is a byte that no piece holds. What a worker merges first is compared
with the tokenizers library, which alone encodes texts beyond plain European ones.
"""

from __future__ import annotations

import json
import re
import struct

import numpy as np

# Within these characters, lower-casing and the splitting pattern of the tokenizer agree with Python's own;
# a text with any other character, or with a special token's opening, is encoded whole by the library.
_UNSAFE = re.compile("[^\t\n\x0b\x0c\r\x20-\x7e\u00a1-\u00b1\u00b4-\u00b8\u00ba\u00bb\u00bf-\u012f\u0131-\u017f]|<\\|")
_PIECES = re.compile(r"\n|'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
_END, _WORD_END = "\x01", "</w>"
#: Entries of each of the cache's two generations; a worker's cache stays below about 100 MB.
CACHE_ENTRIES = 200_000
#: Texts whose new chunks are merged together.
TOGETHER = 8
#: Pieces that each worker compares with the library.
COMPARED = 2_000
_ENCODERS: dict[str, "WordBpe"] = {}


def _alphabet() -> dict[str, int]:
    """Characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class _Merges:
    """The vocabulary as ranks of byte strings: bytes, bytes that end a piece, then merges in order."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, byte_of, end = model["vocab"], _alphabet(), _END.encode()
        tokens = [c for c, _ in sorted(byte_of.items(), key=lambda x: x[1])]
        tokens += [c + _WORD_END for c in tokens]
        tokens += ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        ranks: dict[bytes, int] = {}
        for rank, token in enumerate(tokens):
            ends = len(token) > len(_WORD_END) and token.endswith(_WORD_END)
            body = bytes(byte_of[c] for c in (token[: -len(_WORD_END)] if ends else token))
            if end not in body or rank < 256:  # no piece holds the byte that marks ends
                ranks[body + end * ends] = rank
        self.ids = np.array([vocabulary[t] for t in tokens], dtype="<u4")
        self.ends = np.array([t.endswith(_WORD_END) and t != _WORD_END for t in tokens])
        self._encode = tiktoken.Encoding("pieces", pat_str="[^ ]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ranks_of(self, pieces: list[str]) -> np.ndarray:
        return np.array(self._encode(f"{_END} ".join(pieces) + _END), dtype=np.int64)


class WordBpe:
    """Little-endian unsigned 32-bit ids of whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self._tokenizer, self._merges = Tokenizer.from_file(path), _Merges(path)
        self._break = int(self._merges.ranks_of(["\n"])[0])
        self._compared = 0
        self._chunks: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def encode_whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def _compare(self, chunks: list[str], found: list[bytes]) -> None:
        for chunk, ids in zip(chunks, found, strict=True):
            if ids != self.encode_whole(chunk):
                raise RuntimeError(f"merging by rank differs from the tokenizer on {chunk!r}")
        self._compared += len(chunks)

    def _merge(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; line breaks, which no chunk holds, stand between them."""
        ranks = self._merges.ranks_of(_PIECES.findall("\n".join(chunks)))
        data, at = self._merges.ids[ranks].tobytes(), (4 * np.flatnonzero(ranks == self._break)).tolist()
        found = [data[a:b] for a, b in zip([0, *(x + 4 for x in at)], [*at, len(data)], strict=True)]
        if self._compared < COMPARED:
            self._compare(chunks, found)
        return found

    def _learn(self, new: set[str]) -> None:
        known = self._older.keys() & new
        self._chunks.update(zip(known, map(self._older.__getitem__, known), strict=True))
        if order := list(new - known):
            self._chunks.update(zip(order, self._merge(order), strict=True))

    def _encode_safe(self, texts: list[str]) -> list[bytes]:
        if len(self._chunks) >= CACHE_ENTRIES:
            self._chunks, self._older = {}, self._chunks
        lists = [t.lower().split() for t in texts]
        found = [[*map(self._chunks.get, chunks)] for chunks in lists]
        holes = [k for k, ids in enumerate(found) if None in ids]
        self._learn({c for k in holes for c, ids in zip(lists[k], found[k], strict=True) if ids is None})
        learnt = self._chunks
        for k in holes:
            found[k] = [learnt[c] if ids is None else ids for c, ids in zip(lists[k], found[k], strict=True)]
        return [b"".join(ids) for ids in found]

    def encode_all(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = [b""] * len(texts)
        for at in range(0, len(texts), TOGETHER):
            some = range(at, min(at + TOGETHER, len(texts)))
            safe = [i for i in some if not _UNSAFE.search(texts[i])]
            for i in set(some).difference(safe):
                out[i] = self.encode_whole(texts[i])
            for i, ids in zip(safe, self._encode_safe([texts[i] for i in safe]), strict=True):
                out[i] = ids
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]


def encoder(path: str) -> WordBpe:
    """One encoder and its caches for each worker process, kept across tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordBpe(path)
    return _ENCODERS[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))
