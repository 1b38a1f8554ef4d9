"""Token-id files with Elias-Fano document boundaries.

Documents are dealt into ranges of ascending id, tokenised there and written as
files: the concatenated ids, and the boundaries and the document ids as an
Elias-Fano sequence each (low bits packed, high bits as a bitmap in unary).  A
value is found with ``select``: sampled positions of every 256th one-bit,
then a scan of a few words; no table of 64-bit offsets or ids is kept.

File: 8 bytes ``EFTOKEN2``; little-endian 64-bit each: documents, those of them with a
null id (they come first), least id (signed), ids, bytes of an id; then low bits, high
words, low words and samples of the boundaries, and the same of the document ids less the least;
then samples (uint32), high words, low words (uint64) of both, and the ids.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from bisect import bisect_left
from codecs import charmap_decode
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import prepare, releasing, scratch_path, stored
from .files import read_file, write_file

MAGIC = b"EFTOKEN2"
_HEAD = "<2Qq10Q"
#: Ids in a file, but for a single longer document.
FILE_IDS = 1 << 23
#: Words of which the ids are kept by a worker.
CACHE_WORDS = 500_000
#: Words of at most so many characters, the common ones, outlast the others in
#: the cache: when it is full, and (fewer) when a task ends and others need its memory.
SHORT_WORD, SHORT_BETWEEN_TASKS = 8, 5
_SAMPLE = 256
#: Documents in a batch that a reader hands on.
READ_ROWS = 1 << 14
#: White space other than space and line feed: such texts are encoded whole.
_ODD_SPACE = re.compile(r"[^\S \n]").search


# ------------------------------------------------------------- Elias-Fano --
def ef_encode(values: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Non-decreasing uint64 values -> (low bits, high words, low words, samples)."""
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    bits = np.zeros(((int(ones[-1]) + 1 if n else 0) + 63) // 64 * 64, np.uint8)
    bits[ones] = 1
    high = np.packbits(bits, bitorder="little").view("<u8")
    lows = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    packed = np.packbits(np.concatenate([lows, np.zeros(-len(lows) % 64, np.uint8)]), bitorder="little").view("<u8")
    return low, high, packed, ones[::_SAMPLE].astype("<u4")


class EliasFano:
    """Access to an encoded sequence without decoding it."""

    def __init__(self, n: int, low: int, high: np.ndarray, packed: np.ndarray, samples: np.ndarray):
        self.n, self.low, self.high, self.packed, self.samples = n, low, high, packed, samples

    def _select(self, i: int) -> int:
        """Position of the one-bit number ``i``."""
        at = int(self.samples[i // _SAMPLE])
        left, word = i % _SAMPLE, at // 64
        bits = int(self.high[word]) >> (at % 64) << (at % 64)
        while (c := bits.bit_count()) <= left:
            left -= c
            word += 1
            bits = int(self.high[word])
        for _ in range(left):
            bits &= bits - 1
        return word * 64 + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, value = i * self.low, 0
        if self.low:
            pair = int(self.packed[start // 64])
            if start // 64 + 1 < len(self.packed):
                pair |= int(self.packed[start // 64 + 1]) << 64
            value = pair >> (start % 64) & ((1 << self.low) - 1)
        return (self._select(i) - i) << self.low | value


# ------------------------------------------------------------------ format --
def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: list[bytes], width: int) -> list[bytes]:
    """Parts of a file; ``ids`` are little-endian with ``width`` bytes each.  ``doc_ids``
    ascend, nulls first, and may repeat."""
    known = np.array([d for d in doc_ids if d is not None], "<i8")
    nulls = len(doc_ids) - len(known)
    if any(d is not None for d in doc_ids[:nulls]) or (known[1:] < known[:-1]).any():
        raise ValueError("document ids do not ascend")
    least = int(known[0]) if len(known) else 0
    above = known.view("<u8") - np.array(known[:1]).view("<u8")  # modulo 2^64, so any span of ids fits
    bounds = np.concatenate([[0], np.cumsum(lengths)]).astype(np.uint64)
    head, parts = [len(doc_ids), nulls, least, int(bounds[-1]), width], []
    for values in (bounds, above):
        low, high, packed, samples = ef_encode(values)
        head += [low, len(high), len(packed), len(samples)]
        parts += [samples.tobytes(), high.tobytes(), packed.tobytes()]
    return [MAGIC + struct.pack(_HEAD, *head), *parts, *ids]


class TokenFile:
    """A file's documents by number: ``doc_id(i)`` and ``ids(i)`` of document ``i``, ``find`` by id.

    ``bounds`` and the ids of documents are read where they lie, each value by a select."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        self.n, self.nulls, self.least, self.n_ids, self.width, *sizes = struct.unpack_from(_HEAD, data, 8)
        at = 8 + struct.calcsize(_HEAD)

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            got = np.frombuffer(data, kind, count, at)
            at += got.nbytes
            return got

        def sequence(n: int, low: int, highs: int, lows: int, samples: int) -> EliasFano:
            s, h = take("<u4", samples), take("<u8", highs)
            return EliasFano(n, low, h, take("<u8", lows), s)

        self.bounds = sequence(self.n + 1, *sizes[:4])
        self._above = sequence(self.n - self.nulls, *sizes[4:])
        self._ids = take(f"<u{self.width}", self.n_ids)

    def doc_id(self, i: int) -> int | None:
        return None if 0 <= i < self.nulls else self.least + self._above[i - self.nulls]

    def find(self, doc_id: int) -> int | None:
        """Number of the first document with this id, by bisection; None without one."""
        i = self.nulls + bisect_left(range(self.n - self.nulls), doc_id - self.least, key=self._above.__getitem__)
        return i if i < self.n and self.doc_id(i) == doc_id else None

    def ids(self, i: int) -> np.ndarray:
        return self._ids[self.bounds[i]: self.bounds[i + 1]]


# --------------------------------------------------------------- tokenising --
# How a byte-level BPE cuts text, and the characters it gives to bytes.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _byte_characters() -> str:
    """Printable Latin-1 characters stand for themselves, the other bytes for 256, 257 and so on."""
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in _PLAIN else chr(next(rest)) for b in range(256))


class _Words(dict):
    """Word -> its ids after ``space``; a word that is looked up for the first time is encoded."""

    def __init__(self, cache: WordCache, space: str):
        super().__init__()
        self.cache, self.space = cache, space

    def __missing__(self, word: str) -> bytes:
        cache, space = self.cache, self.space
        if not (word.isascii() or max(word) < "\u0250"):  # Unicode versions may tell later letters apart differently
            got = cache.whole([space + word])[0]
        elif word.isalpha():
            got = cache.piece(space + word)
        elif word[-1] in cache.marks and word[:-1].isalpha():  # the mark is a piece of its own
            got = self[word[:-1]] + cache.marks[word[-1]]
        else:
            got = b"".join(map(cache.piece, cache.cut(space + word)))
        self[word] = got
        return got

    def shrink(self, most: int, length: int = SHORT_WORD) -> None:
        """Beyond ``most`` words keep those of at most ``length`` characters."""
        if len(self) > most:
            kept = {w: x for w, x in self.items() if len(w) <= length}
            self.clear()
            if len(kept) <= CACHE_WORDS // 2:
                self.update(kept)


class WordCache:
    """Encodes texts with a byte-level BPE tokenizer, each distinct word once.

    Its pre-tokenizer never joins two words over a space that follows a
    non-space, and takes a lone line feed between two non-spaces as a token of
    its own.  So texts without adjacent or outer white space are cut there and
    the words' ids come from a cache.  A new word in Latin script is cut by the
    pre-tokenizer's pattern and goes to the tokenizer's model directly; other
    words and texts are encoded whole by the tokenizer, as are texts with an
    added token's content.  ``special`` takes special tokens' contents in a
    text as those tokens, which is the library's default; else they are ordinary text."""

    def __init__(self, path: str, width: int, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks fill the cores
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.width = Tokenizer.from_file(path), width
        if not special:
            self.tokenizer.encode_special_tokens = True
        about = json.loads(self.tokenizer.to_str())
        cut = about["pre_tokenizer"] or {}
        self.byte_level = about["model"]["type"] == "BPE" and not about["normalizer"] and cut.get("type") == "ByteLevel" \
            and not cut.get("add_prefix_space") and cut.get("use_regex", True)
        self.added = [t["content"] for t in about["added_tokens"] if special or not t["special"]]
        self.model, self.cut, self.chars = self.tokenizer.model, regex.compile(_PATTERN).findall, _byte_characters()
        self.pack = {n: partial(struct.pack, f"<{n}{'H' if width == 2 else 'I'}") for n in range(64)}  # goes to tasks; a Struct does not
        self.feed = self.whole(["\n"])[0]
        self.marks = {m: self.whole([m])[0] for m in ".,!?;:"}
        self.first, self.after_space = _Words(self, ""), _Words(self, " ")

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, f"<u{self.width}").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def piece(self, piece: str) -> bytes:
        """Ids of one piece of the pre-tokenizer."""
        ids = [t.id for t in self.model.tokenize(charmap_decode(piece.encode(), "strict", self.chars)[0])]
        return self.pack[len(ids)](*ids) if len(ids) < 64 else np.array(ids, f"<u{self.width}").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.byte_level or _ODD_SPACE(text) or any(t in text for t in self.added):
            return self.whole([text])[0]
        first, after, out = self.first, self.after_space.__getitem__, []
        for line in text.split("\n"):
            words = line.split(" ")
            if "" in words:  # adjacent or outer spaces or line feeds
                return self.whole([text])[0]
            out.append(first[words[0]] + b"".join(map(after, words[1:])))
        self.first.shrink(CACHE_WORDS // 2)
        self.after_space.shrink(CACHE_WORDS)
        return self.feed.join(out)


_cache: dict[tuple[str, int, bool], WordCache] = {}


def _write(path: str, end_id: int, width: int, folder: str, file_ids: int, special: bool):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (path, width, special) not in _cache:
            _cache[path, width, special] = WordCache(path, width, special)
        cache = _cache[path, width, special]
        part, end = TaskContext.get().partitionId(), int(end_id).to_bytes(width, "little")
        docs: list[int | None] = []
        lengths: list[int] = []
        ids: list[bytes] = []
        total, made = 0, 0

        def flush() -> pa.RecordBatch:
            name = write_file(folder, f"tokens-{part:06d}-{made:06d}", encode_file(docs, np.array(lengths, np.int64), ids, width))
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([part], pa.int32()), pa.array([made], pa.int32()),
                 pa.array([len(docs)], pa.int64()), pa.array([total], pa.int64())], ["file", "part", "no", "n_docs", "n_ids"])

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), map(cache.encode, b.column(1).to_pylist()), strict=True):
                docs.append(d)
                ids.append(x + end)
                lengths.append(len(ids[-1]) // width)
                total += lengths[-1]
                if total >= file_ids:
                    yield flush()
                    docs, lengths, ids, total, made = [], [], [], 0, made + 1
        if docs:
            yield flush()
        for known in (cache.first, cache.after_space):
            known.shrink(0, SHORT_BETWEEN_TASKS)
    return run


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
                 folder: str | None = None, file_ids: int = FILE_IDS, special: bool = False) -> tuple[str, DataFrame]:
    """Write token files in ascending id order (null ids first; rows that
    repeat an id in the order of their texts' hashes); returns their folder and
    the manifest (file, part, no, n_docs, n_ids, base), ``base`` being the ids
    in all files before.  ``tokenizer`` is the path of a tokenizer file that
    every executor can read; ``special`` is that of WordCache.  Null texts are
    empty and get the end id alone."""
    from tokenizers import Tokenizer

    spark = prepare(docs.sparkSession)
    folder = folder or scratch_path(spark, "tokens")
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else 4
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    manifest = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order)
                      .mapInArrow(_write(tokenizer, end_id, width, folder, file_ids, special),
                                  "file string, part int, no int, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("part", "no").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return folder, manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")))


def _read(folder: str):
    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                f = TokenFile(read_file(folder, name))
                start = 0
                for first in range(0, f.n, READ_ROWS):
                    rows = []
                    for i in range(first, min(f.n, first + READ_ROWS)):
                        end = f.bounds[i + 1]
                        rows.append((f.doc_id(i), base + start, end - start, zlib.crc32(f._ids[start:end].astype("<u4").tobytes())))
                        start = end
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)],
                                                     ["id", "start", "n_tokens", "ids_crc32"])
    return run


def read_tokens(folder: str, manifest: DataFrame) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document, from the files."""
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("file", "base").repartition(n, "file").mapInArrow(
        _read(folder), "id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text",
                     special: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32): all documents written as token files and read back from them.

    Ids are integers or text of integers; null ids come first.  Rows that repeat an id each get a
    row, in the order of their texts' hashes.  A null or empty text has the end id alone; a text longer
    than a file may hold is a file of its own.  An empty table gives no row and no file.  Other columns are ignored."""
    folder, manifest = write_tokens(docs, tokenizer, end_id, id_col, text_col, special=special)
    return read_tokens(folder, stored(manifest, "bases"))
