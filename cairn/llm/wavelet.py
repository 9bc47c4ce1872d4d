"""Token ids in wavelet-matrix shard files.

A shard is one compressed file: a table of its sections, the documents' ids and sizes, the sorted alphabet of
the tokens that occur, and one bit-plane per alphabet bit, from the highest down; each plane lists the bits
in the order that a stable partition by all higher bits leaves.  Cumulative ones per 512 bits give rank in
constant time, and access, count and occurrence lookup walk the planes without decoding the shard.
Planes are compressed in pieces of 64 KB and read when asked for, so an access inflates one piece a plane,
and from a file reads no more than that.

Cases: a null text is empty; an empty document is its end id alone; null doc_ids come first; repeated
rows are written as often as they occur, equal ids ordered by their texts' xxhash64; a document is never
split, so a very long one makes a longer shard; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches_of, bound_batches, parts_of, tidy, written
from .tokens import Encoder, default_tokenizer_path, ids_crc32

MAGIC = b"CWM2"
BLOCK = 512
#: Bits of a plane that are compressed together.
CHUNK = 1 << 19
#: A shard is closed at so many tokens.
SHARD_TOKENS = 1 << 20
_HEAD = struct.Struct("<4sIQQII")  # magic, sections, documents, tokens, planes, bits of a piece


def _packed(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


class Sections:
    """A file's compressed sections by number, read and inflated when asked for and then kept."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        magic, count, self.n_docs, self.n_tokens, self.depth, self.chunk = _HEAD.unpack(read(0, _HEAD.size))
        if magic != MAGIC:
            raise ValueError("not a wavelet shard")
        self.ends = _HEAD.size + 8 * count + np.cumsum(np.frombuffer(read(_HEAD.size, 8 * count), "<u8").astype(np.int64))
        self.held: dict[int, bytes] = {}

    def get(self, i: int, dtype: str = "<u4") -> np.ndarray:
        if i not in self.held:
            begin = int(self.ends[i - 1]) if i else _HEAD.size + 8 * len(self.ends)
            self.held[i] = zstandard.ZstdDecompressor().decompress(self.read(begin, int(self.ends[i]) - begin))
        return np.frombuffer(self.held[i], dtype)

    @staticmethod
    def join(arrays: list[np.ndarray], n_docs: int, matrix: "WaveletMatrix") -> bytes:
        raw = [_packed(a) for a in arrays]
        return b"".join([_HEAD.pack(MAGIC, len(raw), n_docs, matrix.n, len(matrix.planes), matrix.chunk), np.array([len(r) for r in raw], "<u8").tobytes(), *raw])


class Plane:
    """Bits with rank and select.  ones() gives the ones before each block and in all, piece(i) the i-th chunk of bits."""

    def __init__(self, n: int, chunk: int, ones: Callable[[], np.ndarray], piece: Callable[[int], np.ndarray]):
        self.n, self.chunk, self.ones, self.piece = n, chunk, ones, piece

    def bit(self, i: int) -> int:
        return int(self.piece(i // self.chunk)[i % self.chunk >> 3]) >> (7 - (i & 7)) & 1

    def rank(self, i: int) -> int:
        """Ones among the first i bits."""
        at = i // BLOCK
        n = int(self.ones()[at])
        if i % BLOCK == 0:
            return n
        piece, lo, hi = self.piece(i // self.chunk), at * BLOCK % self.chunk, i % self.chunk
        n += int(np.bitwise_count(piece[lo >> 3 : hi >> 3]).sum())
        return n + (int(piece[hi >> 3]) >> (8 - (hi & 7))).bit_count() if hi & 7 else n

    def select(self, bit: int, j: int) -> int:
        """Position of the j-th (from 0) such bit, by bisection over the ones."""
        ones = self.ones().astype(np.int64)
        upto = ones if bit else np.minimum(np.arange(len(ones)) * BLOCK, self.n) - ones
        at = int(np.searchsorted(upto, j, "right")) - 1
        lo = at * BLOCK % self.chunk >> 3
        bits = np.unpackbits(self.piece(at * BLOCK // self.chunk)[lo : lo + (BLOCK >> 3)])[: self.n - at * BLOCK]
        return at * BLOCK + int(np.flatnonzero(bits == bit)[j - int(upto[at])])

    def bits(self) -> np.ndarray:
        pieces = [self.piece(i) for i in range(-(-self.n // self.chunk))]
        return np.unpackbits(np.concatenate(pieces) if pieces else np.zeros(0, np.uint8), count=self.n).view(bool)


class WaveletMatrix:
    """Rank, select, access and count over a token sequence, from bit-planes."""

    def __init__(self, alphabet: Callable[[], np.ndarray], n: int, chunk: int, planes: list[Plane]):
        self.symbols, self.n, self.chunk, self.planes = alphabet, n, chunk, planes

    @classmethod
    def build(cls, tokens: np.ndarray, chunk: int = CHUNK) -> "WaveletMatrix":
        tokens = np.asarray(tokens, np.int64)
        present = np.bincount(tokens, minlength=1) > 0
        alphabet = np.flatnonzero(present).astype(np.uint32)
        dense = np.zeros(len(present), np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        dense[alphabet] = np.arange(len(alphabet))
        cur, planes = dense[tokens], []
        for b in reversed(range(max(1, (len(alphabet) - 1).bit_length() if len(alphabet) else 1))):
            bit = (cur >> b) & 1 == 1
            packed = np.packbits(bit)
            ones = _ranks(packed)
            planes.append(Plane(len(tokens), chunk, lambda ones=ones: ones, lambda i, packed=packed: packed[i * chunk >> 3 : (i + 1) * chunk >> 3]))
            cur = np.concatenate([np.compress(~bit, cur), np.compress(bit, cur)])
        return cls(lambda: alphabet, len(tokens), chunk, planes)

    def arrays(self) -> list[np.ndarray]:
        """The sections of the matrix: alphabet steps, then each plane's ones and pieces."""
        out = [np.diff(self.symbols().astype(np.int64), prepend=0).astype("<u4")]
        for p in self.planes:
            out += [p.ones().astype("<u4"), *(p.piece(i) for i in range(-(-self.n // self.chunk)))]
        return out

    @classmethod
    def from_sections(cls, s: Sections, at: int = 0) -> "WaveletMatrix":
        """The matrix whose sections begin at number at; nothing is read yet."""
        each = 1 + -(-s.n_tokens // s.chunk)
        planes = []
        for k in range(s.depth):
            first = at + 1 + k * each
            planes.append(Plane(s.n_tokens, s.chunk, lambda first=first: s.get(first), lambda i, first=first: s.get(first + 1 + i, "u1")))
        return cls(lambda: np.cumsum(s.get(at), dtype=np.int64).astype(np.uint32), s.n_tokens, s.chunk, planes)

    def to_bytes(self) -> bytes:
        return Sections.join(self.arrays(), 0, self)

    @classmethod
    def from_bytes(cls, blob: bytes) -> "WaveletMatrix":
        return cls.from_sections(Sections(lambda at, size: blob[at : at + size]))

    def _zeros(self, k: int) -> int:
        return self.n - int(self.planes[k].ones()[-1])

    def _code(self, token: int) -> int | None:
        alphabet = self.symbols()
        c = int(np.searchsorted(alphabet, token))
        return c if c < len(alphabet) and alphabet[c] == token else None

    def _steps(self, code: int) -> Iterator[tuple[int, int]]:
        """(plane, its bit of code), from the highest down."""
        return ((k, code >> (len(self.planes) - 1 - k) & 1) for k in range(len(self.planes)))

    def access(self, i: int) -> int:
        """The i-th token."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        code = 0
        for k, plane in enumerate(self.planes):
            b, ones = plane.bit(i), plane.rank(i)
            code = code << 1 | b
            i = self._zeros(k) + ones if b else i - ones
        return int(self.symbols()[code])

    def _range(self, code: int, lo: int, hi: int) -> tuple[int, int]:
        """Where the occurrences of code in [lo, hi) stand after the last plane."""
        for k, bit in self._steps(code):
            a, b = self.planes[k].rank(lo), self.planes[k].rank(hi)
            lo, hi = (self._zeros(k) + a, self._zeros(k) + b) if bit else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of token in [lo, hi)."""
        code = self._code(token)
        hi = self.n if hi is None else hi
        if code is None or lo >= hi:
            return 0
        lo, hi = self._range(code, lo, hi)
        return hi - lo

    def select(self, token: int, j: int) -> int:
        """Position of the j-th (from 0) occurrence of token; -1 if there is none."""
        code = self._code(token)
        if code is None or j < 0:
            return -1
        lo, hi = self._range(code, 0, self.n)
        if j >= hi - lo:
            return -1
        i = lo + j
        for k, bit in reversed(list(self._steps(code))):
            i = self.planes[k].select(bit, i - self._zeros(k) if bit else i)
        return i

    def decode(self) -> np.ndarray:
        """All tokens: the partitions undone from the lowest plane up."""
        alphabet = self.symbols()
        code = np.zeros(self.n, np.uint16 if len(alphabet) <= 1 << 16 else np.uint32)
        for k in reversed(range(len(self.planes))):
            bit, zeros = self.planes[k].bits(), self._zeros(k)
            code[zeros:] |= code.dtype.type(1 << (len(self.planes) - 1 - k))
            before = np.empty_like(code)
            before[np.flatnonzero(~bit)] = code[:zeros]
            before[np.flatnonzero(bit)] = code[zeros:]
            code = before
        return alphabet[code] if self.n else np.zeros(0, np.uint32)


def _ranks(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of 512 bits, and in all."""
    per = np.bitwise_count(plane).astype(np.int64)
    at = np.arange(0, len(plane), BLOCK >> 3)
    sums = np.add.reduceat(per, at) if len(plane) else np.zeros(0, np.int64)
    return np.concatenate([[0], np.cumsum(sums)]).astype(np.uint32)


def shard_bytes(doc_ids: list, sizes: np.ndarray, tokens: np.ndarray, chunk: int = CHUNK) -> bytes:
    """One shard file: the documents' ids, which of them are null, and sizes; then the matrix."""
    ids = np.array([d or 0 for d in doc_ids], "<i8")
    null = np.packbits(np.array([d is None for d in doc_ids], bool))
    matrix = WaveletMatrix.build(tokens, chunk)
    return Sections.join([ids, null, np.asarray(sizes, "<u4"), *matrix.arrays()], len(doc_ids), matrix)


class Shard:
    """A shard file; its directory and matrix are read when asked for."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.sections = Sections(read)
        self.matrix = WaveletMatrix.from_sections(self.sections, 3)

    def doc_ids(self) -> list:
        null = np.unpackbits(self.sections.get(1, "u1"), count=self.sections.n_docs)
        return [None if x else d for d, x in zip(self.sections.get(0, "<i8").tolist(), null.tolist())]

    def sizes(self) -> np.ndarray:
        """Tokens of each document, with its end id."""
        return self.sections.get(2)


def open_shard(blob: bytes) -> Shard:
    return Shard(lambda at, size: blob[at : at + size])


def open_file(path: str) -> Shard:
    """A shard in a file that save_files wrote; reads the parts of it that are asked for."""
    where, name = fs.FileSystem.from_uri(path)
    file = where.open_input_file(name)

    def read(at: int, size: int) -> bytes:
        file.seek(at)
        return file.read(size)

    return Shard(read)


def save_files(shards: DataFrame, folder: str) -> DataFrame:
    """Writes each shard to a file of its own in folder, a URI of a store that all executors reach; gives the files.

    Names follow the order of the shards.  A file appears whole, and a repeated task writes the same one again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = fs.FileSystem.from_uri(folder)
        where.create_dir(base)
        for batch in batches:
            paths = []
            for part, shard, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "blob"))):
                name, draft = f"{base}/{part:07d}-{shard:05d}.cwm", f"{base}/.{uuid.uuid4().hex}"
                with where.open_output_stream(draft) as out:
                    out.write(blob)
                where.move(draft, name)
                paths.append(f"{folder.rstrip('/')}/{part:07d}-{shard:05d}.cwm")
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), batch.column(2), batch.column(3)], names=["path", "n_docs", "n_tokens"])

    return written(shards.select("part", "shard", "n_docs", "n_tokens", "blob").mapInArrow(tidy(run), "path string, n_docs bigint, n_tokens bigint"), "files")


SHARDS = "part bigint, shard bigint, n_docs bigint, n_tokens bigint, blob binary"
_SHARDS = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("blob", pa.binary())])


def write_shards(docs: DataFrame, tokenizer: str | None = None, end_id: int = 0, shard_tokens: int = SHARD_TOKENS, chunk: int = CHUNK) -> DataFrame:
    """Shard files of all documents in ascending doc_id order, written to the shared folder.

    One row per shard: (part, shard) is its place in the order, blob its file.  One range shuffle of
    the texts, in which rows of one id, or without any, are ordered by text and dealt out like others; a task
    holds one shard's ids at a time.
    """
    path = tokenizer or default_tokenizer_path()
    bound_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("key"), F.monotonically_increasing_id().alias("tie"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, shard = Encoder.get(path), TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        doc_ids: list = []
        sizes: list[np.ndarray] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, doc_ids, sizes, total, shard
            blob = shard_bytes(doc_ids, np.concatenate(sizes), np.concatenate(held), chunk)
            row = [(part, shard, len(doc_ids), total, blob)]
            held, doc_ids, sizes, total, shard = [], [], [], 0, shard + 1
            return next(batches_of(row, _SHARDS))

        for batch in batches:
            flat, n = encoder.encode(batch.column(1).to_pylist())
            whole = np.full(len(flat) + len(n), end_id, np.int32)
            whole[np.arange(len(flat)) + np.repeat(np.arange(len(n)), n)] = flat
            held.append(whole)
            doc_ids += batch.column(0).to_pylist()
            sizes.append(n + 1)
            total += len(whole)
            if total >= shard_tokens:
                yield flush()
        if doc_ids:
            yield flush()

    order = [F.asc_nulls_first("doc_id"), "key", "tie"]
    dealt = docs.repartitionByRange(parts_of(docs), *order).sortWithinPartitions(*order)
    return written(dealt.select("doc_id", "text").mapInArrow(tidy(build), SHARDS), "shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32 (start counts all before it)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, shard, blob in zip(*(batch.column(c).to_pylist() for c in ("part", "shard", "blob"))):
                file = open_shard(blob)
                ids, rows, at = file.matrix.decode(), [], 0
                for doc_id, n in zip(file.doc_ids(), file.sizes().tolist()):
                    rows.append((part, shard, doc_id, at, n, ids_crc32(ids[at : at + n])))
                    at += n
                yield from batches_of(rows, _READ)

    rows = shards.select("part", "shard", "blob").mapInArrow(tidy(read), "part bigint, shard bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint")
    # ids before each shard: over parts (as many as tasks), then over the shards of a part
    sizes = shards.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n"))
    inner = sizes.withColumn("inner", F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens"))
    base = inner.join(parts, "part").select("part", "shard", (F.col("before") + F.col("inner")).alias("base"))
    return rows.join(base, ["part", "shard"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


_READ = pa.schema([(n, pa.int64()) for n in ("part", "shard", "doc_id", "at", "n_tokens", "ids_crc32")])
