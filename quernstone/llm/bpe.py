"""Byte-pair encoding and decoding of whole texts without merging loops.

Encoding runs an Aho-Corasick automaton over each piece of a text to find, for every position, the longest vocabulary
token that starts there, then walks the piece from left to right. A token may follow its predecessor only if the pair is
compatible, that is, if merging the pair's characters by rank would leave exactly these two tokens; where no token fits,
the walk steps back and takes a shorter one. Each position is given up at most once, so the time is linear in the piece.
The result is the one that rank-ordered merging gives. Decoding gathers the tokens' bytes from one buffer through an
offset table.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows are encoded alike; texts
of any length are encoded whole; columns besides the named two pass through ``encode_decode`` only if asked for.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: The pre-tokenizer's pattern as tokenizer files state it and as this module applies it, and the visible
#: characters that stand for the 256 bytes.
STATED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_HIDDEN = [b for b in range(256) if b not in set(_SHOWN)]
BYTE_TO_CHAR = {b: chr(b) for b in _SHOWN} | {b: chr(256 + i) for i, b in enumerate(_HIDDEN)}
CHAR_TO_BYTE = {c: b for b, c in BYTE_TO_CHAR.items()}
#: A piece's last byte is a symbol of its own: the byte plus END.
END = 256
_AS_SYMBOLS = {b: chr(b) for b in range(256)}


@lru_cache(maxsize=2)
def _tables(path: str):
    """The library's own normaliser and splitter, for code points younger than Python's tables."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pieces(chunk: str, path: str) -> list[str]:
    """Normalised pieces of a run of text, as the pre-tokenizer cuts it."""
    if chunk.isascii():
        return PIECE.findall(chunk.lower())
    if any(unicodedata.category(c) == "Cn" for c in chunk):
        library = _tables(path)
        normal = library.normalizer.normalize_str(chunk)
        return [normal[start:end] for _, (start, end) in library.pre_tokenizer.pre_tokenize_str(normal)]
    return PIECE.findall(unicodedata.normalize("NFC", chunk).replace("Σ", "σ").lower())


def refuse_other_cuts(spec: dict, path: str) -> None:
    """An error for a tokenizer file that cuts or marks words in another way than this package does."""
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    if (steps[0].get("pattern") or {}).get("Regex") != STATED or spec["model"].get("end_of_word_suffix") != "</w>":
        raise ValueError(f"{path} cuts texts in another way than this encoder")


class WordBpe:
    """A word-end BPE vocabulary read from a tokenizer file.

    ``cache_words`` bounds the caches of encoded words, of runs between spaces and of compatible pairs. A full cache
    becomes the old one, from which what is still in use is taken over.
    """

    def __init__(self, path: str, cache_words: int = 240_000) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        refuse_other_cuts(spec, path)
        self._path = path
        model = spec["model"]
        vocabulary: dict[str, int] = model["vocab"]
        suffix = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._id_of_rank: list[int] = []
        self._lengths: list[int] = []
        self._halves: list[tuple[int, int] | None] = []
        self._pairs: dict[tuple[int, int], int] = {}
        self._automaton = ahocorasick.Automaton()
        ranks: dict[str, int] = {}

        def add(token: str, halves: tuple[int, int] | None) -> int:
            ends = token.endswith(suffix) and token != suffix
            body = token[: -len(suffix)] if ends else token
            symbols = [CHAR_TO_BYTE[c] for c in body]
            if ends:
                symbols[-1] += END
            rank = ranks[token] = len(self._id_of_rank)
            self._id_of_rank.append(vocabulary[token])
            self._lengths.append(len(symbols))
            self._halves.append(halves)
            self._automaton.add_word("".join(map(chr, symbols)), rank)
            return rank

        for char in CHAR_TO_BYTE:
            for token in (char, char + suffix):
                if token in vocabulary:
                    add(token, None)
        for left, right in model["merges"]:
            halves = (ranks[left], ranks[right])
            self._pairs[halves] = add(left + right, halves)
        self._shorter = self._proper_prefixes()
        self._automaton.make_automaton()
        self._fits: dict[int, bool] = {}
        self._cache_words = cache_words
        self._chunks: dict[str, bytes] = {"": b""}
        self._words: dict[str, bytes] = {}
        self._old_chunks: dict[str, bytes] = {}
        self._old_words: dict[str, bytes] = {}

        texts = {i: t.encode() for t, i in vocabulary.items()} | {i: t.encode() for t, i in self.special.items()}
        table = [texts.get(i, b"") + b" " for i in range(max(texts) + 1)]
        self._buffer = np.frombuffer(b"".join(table), np.uint8)
        self._sizes = np.fromiter(map(len, table), np.int64, len(table))
        self._offsets = np.concatenate([[0], np.cumsum(self._sizes)[:-1]])

    def _proper_prefixes(self) -> list[int]:
        """For each token the longest other token that it starts with, or -1."""
        found = [-1] * len(self._id_of_rank)
        for word, rank in self._automaton.items():
            for end in range(len(word) - 1, 0, -1):
                shorter = self._automaton.get(word[:end], None)
                if shorter is not None:
                    found[rank] = shorter
                    break
        return found

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves ``left`` and ``right`` side by side.

        Undo the latest merge on either side of the border again and again; a pair across the border that merges
        before the merge just undone would have consumed the border.
        """
        key = left << 32 | right
        known = self._fits.get(key)
        if known is not None:
            return known
        pairs, halves = self._pairs, self._halves
        bound = len(halves)
        fits = True
        while True:
            merged = pairs.get((left, right))
            if merged is not None and merged < bound:
                fits = False
                break
            inner_left, inner_right = halves[left], halves[right]
            if inner_left is None and inner_right is None:
                break
            if inner_right is None or (inner_left is not None and left > right):
                bound, left = left, inner_left[1]
            else:
                bound, right = right + 1, inner_right[0]
        if len(self._fits) >= self._cache_words:
            self._fits.clear()
        self._fits[key] = fits
        return fits

    def _word(self, piece: str) -> bytes:
        """Ids of one piece of a text, as little-endian unsigned 32-bit integers."""
        known = self._words.get(piece)
        if known is not None:
            return known
        ids = self._old_words.get(piece)
        if ids is None:
            ids = self._encode_word(piece)
        if len(piece) <= 64:
            if len(self._words) >= self._cache_words // 2:
                self._old_words, self._words = self._words, {}
            self._words[piece] = ids
        return ids

    def _encode_word(self, piece: str) -> bytes:
        raw = piece.encode().decode("latin-1")
        symbols = raw[:-1] + chr(ord(raw[-1]) + END)
        size = len(symbols)
        longest = [-1] * size
        lengths = self._lengths
        for end, rank in self._automaton.iter(symbols):
            longest[end - lengths[rank] + 1] = rank
        open_ = bytearray(b"\x01" * (size + 1))
        taken: list[int] = []
        at, token = 0, longest[0]
        compatible, shorter = self._compatible, self._shorter
        while at < size:
            last = taken[-1] if taken else -1
            while token >= 0:
                end = at + lengths[token]
                if open_[end] and (last < 0 or compatible(last, token)):
                    break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                at = end
                token = longest[at] if at < size else -1
            else:
                open_[at] = 0
                taken.pop()
                at -= lengths[last]
                token = last
        return struct.pack(f"<{len(taken)}I", *[self._id_of_rank[t] for t in taken])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of a run of text between spaces; no piece crosses a space."""
        ids = self._old_chunks.get(chunk)
        if ids is None:
            ids = b"".join(map(self._word, pieces(chunk, self._path)))
        if len(chunk) <= 64:
            if len(self._chunks) >= self._cache_words // 2:
                self._old_chunks, self._chunks = self._chunks, {"": b""}
            self._chunks[chunk] = ids
        return ids

    def _plain(self, text: str) -> bytes:
        chunks = text.replace("\n", " ").split(" ")
        get = self._chunks.get
        found = list(map(get, chunks))
        if None in found:
            found = [self._chunk(c) if ids is None else ids for c, ids in zip(chunks, found, strict=True)]
        return b"".join(found)

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self._special_pattern is None or not any(token in text for token in self.special):
            return self._plain(text)
        parts = self._special_pattern.split(text)
        return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def decode(self, ids: bytes, block: int = 1 << 18) -> bytes:
        """The tokens' texts with one space between each two, in UTF-8, ``block`` ids at a time."""
        tokens = np.frombuffer(ids, "<u4").astype(np.int64)
        out = []
        for at in range(0, len(tokens), block):
            part = tokens[at : at + block]
            sizes = self._sizes[part]
            ends = np.cumsum(sizes)
            places = np.repeat(self._offsets[part] - (ends - sizes), sizes)
            places += np.arange(ends[-1])
            out.append(self._buffer[places].tobytes())
        return b"".join(out)[:-1]


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """The vocabulary of ``path``, read once in each Python worker."""
    return WordBpe(path)


def rows_of(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def encode_decode(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", keep_ids: bool = False) -> DataFrame:
    """Encode and decode every text; one row per input row, no shuffle.

    Columns: the id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, with ``keep_ids``, ``ids`` and ``decoded``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for batch in batches:
            keys = batch.column(0)
            # a bounded number of rows at a time, so that ids and decoded texts of a batch never stand together
            for at in range(0, batch.num_rows, 256):
                counts, hashes, decoded_hashes, ids_rows, decoded_rows = [], [], [], [], []
                for text in batch.column(1).slice(at, 256).to_pylist():
                    ids = bpe.encode(text)
                    decoded = bpe.decode(ids) if ids else b""
                    counts.append(len(ids) // 4)
                    hashes.append(hashlib.sha256(ids).hexdigest())
                    decoded_hashes.append(hashlib.sha256(decoded).hexdigest())
                    if keep_ids:
                        ids_rows.append(np.frombuffer(ids, "<u4").astype(np.int32))
                        decoded_rows.append(decoded.decode())
                columns = [keys.slice(at, 256), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded_hashes, pa.string())]
                names = [id_column, "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    columns += [pa.array(ids_rows, pa.list_(pa.int32())), pa.array(decoded_rows, pa.string())]
                    names += ["ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[id_column].dataType.simpleString()
    schema = f"`{id_column}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(id_column, text_column).mapInArrow(run, schema)
