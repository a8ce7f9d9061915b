"""Token ids as Parquet list columns that can be read selectively.

Documents are sorted by id over range partitions and encoded there, so each file holds a run of the id order. Token lists
are dictionary-encoded, the other integers delta-encoded; row groups and pages have bounded sizes and carry page indexes,
so that a reader of ids, starts or lengths never touches token pages and a reader of few documents skips row groups and
pages. A row's start is its offset within its file plus the sum of all files before it, and that sum comes from one row
per file.

Defined results: a null or empty text has the end id alone; rows with the same id stand next to each other, in text
order; a null id sorts first; an empty table gives empty files; further columns are not written.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.llm.bpe import refuse_other_cuts

_SPACE, _LETTER, _DIGIT, _OTHER = range(4)


def _kinds() -> np.ndarray:
    """Kinds of lowered Latin-1 characters, as the pre-tokenizer sees them."""
    table = np.full(256, _OTHER, np.uint8)
    for kind, ranges in ((_SPACE, ((9, 13), (32, 32), (133, 133), (160, 160))), (_LETTER, ((97, 122), (170, 170), (181, 181), (186, 186), (223, 246), (248, 255))), (_DIGIT, ((48, 57), (178, 179), (185, 185), (188, 190)))):
        for low, high in ranges:
            table[low : high + 1] = kind
    return table


_KINDS = _kinds()
#: Pieces are told apart by a 64-bit sum of random products of characters and places, longer ones by another hash; two of
#: a billion different pieces share one with a chance of about one in forty.
_LONG = 64
_DRAW = np.random.default_rng(23)
_CHARS, _PLACES = (_DRAW.integers(1, 2**63, size, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1) for size in (256, _LONG))


def cut_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the pre-tokenizer's pieces in lowered Latin-1 bytes.

    A piece is a run of letters, one digit, or a run of anything else but white space; an apostrophe that begins a piece
    takes the letters of a contraction with it.
    """
    n = len(data)
    kinds = _KINDS[data]
    begins = np.ones(n, bool)
    begins[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
    marks = np.flatnonzero((data == ord("'")) & begins)
    marks = marks[marks + 1 < n]
    marks = marks[kinds[marks + 1] == _LETTER]
    if len(marks):
        first, second = data[marks + 1], data[np.minimum(marks + 2, n - 1)]
        short = np.isin(first, np.frombuffer(b"stmd", np.uint8))
        pair = (np.isin(first, np.frombuffer(b"rv", np.uint8)) & (second == ord("e"))) | ((first == ord("l")) & (second == ord("l")))
        pair &= marks + 2 < n
        for found, size in ((marks[short], 2), (marks[pair], 3)):
            begins[found + 1] = False
            after = found + size
            after = after[after < n]
            begins[after[kinds[after] == _LETTER]] = True
    starts = np.flatnonzero(begins)
    ends = np.append(starts[1:], n)
    place = np.arange(n) - np.repeat(starts, ends - starts)
    hashes = np.add.reduceat(_CHARS[data] * _PLACES[np.minimum(place, _LONG - 1)], starts)
    solid = kinds[starts] != _SPACE
    starts, ends, hashes = starts[solid], ends[solid], hashes[solid]
    for i in np.flatnonzero(ends - starts >= _LONG).tolist():
        hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return starts, ends, hashes


class LibraryEncoder:
    """The tokenizers library over the pieces of texts, each distinct piece encoded once while a cache holds it.

    The pre-tokenizer cuts a text into pieces and drops white space, so a text's ids are its pieces' ids in order. New
    pieces go to the library as one text; each piece's last token carries the vocabulary's word end, by which the ids are
    taken apart again. Texts beyond Latin-1, and those that may hold special tokens, go to the library whole.
    ``cache_pieces`` bounds the cache; when half of it is full it becomes the old half, of which what is used is kept.
    """

    def __init__(self, path: str, cache_pieces: int = 600_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        refuse_other_cuts(spec, path)
        self._special = tuple(t["content"] for t in spec["added_tokens"])
        self._tokenizer = Tokenizer.from_file(path)
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        self._ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._most = cache_pieces
        self._pieces: dict[int, bytes] = {}
        self._old: dict[int, bytes] = {}

    def _plain(self, text: str) -> bool:
        """Whether a text is Latin-1 and holds no special token."""
        if any(token in text for token in self._special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return True

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids(self, hashes: list[int], spell) -> list[bytes]:
        """Ids of distinct pieces; ``spell`` gives the text of the piece at a place."""
        found = list(map(self._pieces.get, hashes))
        missing = [i for i, ids in enumerate(found) if ids is None]
        if not missing:
            return found
        fresh = []
        for i in missing:
            found[i] = self._old.get(hashes[i])
            if found[i] is None:
                fresh.append(i)
        if fresh:
            ids = self._library([" ".join(map(spell, fresh))])[0]
            raw = ids.tobytes()
            ends = (4 * (np.flatnonzero(self._ends[ids]) + 1)).tolist()
            for i, low, high in zip(fresh, [0, *ends[:-1]], ends, strict=True):
                found[i] = raw[low:high]
        if len(self._pieces) + len(missing) > self._most // 2:
            self._old, self._pieces = self._pieces, {}
        self._pieces.update((hashes[i], found[i]) for i in missing)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out = [b""] * len(texts)
        plain = [i for i, text in enumerate(texts) if text and self._plain(text)]
        whole = [i for i, text in enumerate(texts) if text and not self._plain(text)]
        for i, ids in zip(whole, self._library([texts[i] for i in whole]) if whole else [], strict=True):
            out[i] = ids.tobytes()
        if not plain:
            return out
        parts = [texts[i].lower().encode("latin-1") for i in plain]
        data = np.frombuffer(b" ".join(parts), np.uint8)
        starts, ends, hashes = cut_pieces(data)
        if not len(starts):
            return out
        distinct, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        rows = self._ids(distinct.tolist(), lambda i: data[starts[first[i]] : ends[first[i]]].tobytes().decode("latin-1"))
        buffer = np.frombuffer(b"".join(rows), "<u4")
        sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // 4
        lengths = sizes[which]
        reached = np.cumsum(lengths)
        places = np.repeat((np.cumsum(sizes) - sizes)[which] - (reached - lengths), lengths) + np.arange(reached[-1])
        raw = buffer[places].tobytes()
        begins = np.cumsum([0, *(len(p) + 1 for p in parts)])
        bounds = (4 * np.append(0, reached)[np.searchsorted(starts, begins)]).tolist()
        for i, low, high in zip(plain, bounds[:-1], bounds[1:], strict=True):
            out[i] = raw[low:high]
        return out


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    """The encoder of ``path``, made once in each Python worker."""
    return LibraryEncoder(path)


FILE_SCHEMA = "part int, start_in_part long, n_tokens long, tokens array<int>"


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 2, id_column: str = "doc_id", text_column: str = "text", row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Encode every text, append ``end_id`` and write the files below ``path`` in ascending id order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        start = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                rows = [ids + end for ids in encoder.encode(texts)]
                sizes = np.fromiter((len(ids) // 4 for ids in rows), np.int64, len(rows))
                offsets = np.concatenate([[0], np.cumsum(sizes)])
                tokens = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.frombuffer(b"".join(rows), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array(np.full(len(rows), part, np.int32)), pa.array(start + offsets[:-1]), pa.array(sizes), tokens],
                    [id_column, "part", "start_in_part", "n_tokens", "tokens"],
                )
                start += int(offsets[-1])

    kind = docs.schema[id_column].dataType.simpleString()
    ordered = docs.select(id_column, text_column).repartitionByRange(F.col(id_column)).sortWithinPartitions(id_column, text_column)
    (
        ordered.mapInArrow(run, f"`{id_column}` {kind}, {FILE_SCHEMA}")
        .write.option("compression", "snappy")
        .option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .parquet(path)
    )


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with each document's ``start`` over all files; only selected columns are read."""
    rows = spark.read.parquet(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("in_part"))
    # one row per file, no more than the partitions that write_token_files sorted into
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "part").withColumn("start", F.col("base") + F.col("start_in_part")).drop("base", "start_in_part", "part")


def checksums(rows: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The id, start, length and CRC-32 of each row's ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets = lists.offsets.to_numpy()
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)).tobytes())
            sums = [zlib.crc32(values[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sums, pa.int64())], [id_column, "start", "n_tokens", "ids_crc32"])

    kind = rows.schema[id_column].dataType.simpleString()
    return rows.select(id_column, "start", "n_tokens", "tokens").mapInArrow(run, f"`{id_column}` {kind}, start long, n_tokens long, ids_crc32 long")
