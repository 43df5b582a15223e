"""Token ids as length-delimited binary record files with a separate offset index.

Documents are range-partitioned and sorted by id; each task encodes its range with
the tokenizers library and writes one shard. A record is

    length of the payload   unsigned 64-bit, little-endian
    masked CRC-32 of these eight bytes   unsigned 32-bit
    payload                 the ids, little-endian, 2 bytes each if every id fits, else 4
    masked CRC-32 of the payload         unsigned 32-bit

where masked means rotated right by 15 bits plus 0xA282EAD8, modulo 2**32. The index
is a Parquet table with shard, offset, length, tokens and ids before each record, so
readers can fetch records in any order without scanning shards. Each task attempt
writes a file of its own name, and only the files of committed attempts are in the
index, so retried or speculative tasks leave no wrong record behind. Files go
through pyarrow's file systems (local or mounted, s3, gs, hdfs).

Defined cases: a null or empty text is a record with the end id alone; the string of a
special token in a text is that token, as the library has it; null ids come first; rows that repeat an id follow each other by text; an empty table gives an
empty index; other columns are not written.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlens.llm.bpe import safe_parts
from martlens.llm.common import folder, saved
from martlens.llm.textkit import buffer_of, row_slices, span_hashes

_MASK = 0xA282EAD8  # fixed value of the record format
_OPEN_SHARDS = 8

INDEX_SCHEMA = ("doc_id long, shard string, shard_no long, offset long, length long, width int, "
                "n_tokens long, before long")


def masked_crc(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + _MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked_crc(head)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes) -> bytes:
    """Payload of one whole record; raises ValueError where length or checksum is wrong."""
    (n,), (c,) = struct.unpack("<Q", data[:8]), struct.unpack("<I", data[8:12])
    if c != masked_crc(data[:8]) or n != len(data) - 16:
        raise ValueError("record with a damaged length")
    payload = data[12:-4]
    if struct.unpack("<I", data[-4:])[0] != masked_crc(payload):
        raise ValueError("record with a damaged payload")
    return payload


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer of a file as the library loads it, once per Python worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0D]] = True
# White space of the pattern beside these four, in UTF-8.
_OTHER_SPACE = re.compile(rb"[\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]"
                          rb"|\xe2\x81\x9f|\xe3\x80\x80")
#: Bytes of text that are cut into pieces together.
SLICE_BYTES = 2 << 20


class PieceEncoder:
    """Ids of whole texts. A piece begins where white space follows something else, so no match of the
    byte-level pattern crosses its border: ids of a text are those of its pieces. Pieces of a slice are
    told apart by their 64-bit hashes, each distinct one is encoded once and its ids are remembered (up to
    ``limit`` pieces per Python worker; then those not in the slice at hand are forgotten), and the ids
    of the slice are gathered from the remembered ones. Texts with other white space are encoded in
    larger parts, those with the string of a special token whole."""

    def __init__(self, tok, width: int, limit: int = 500_000) -> None:
        self.tok, self.kind, self.limit = tok, f"<u{width}", limit
        self.known = np.empty(0, dtype=np.uint64)  # hashes, rising
        self.first = np.empty(0, dtype=np.int64)  # place of the first id
        self.size = np.empty(0, dtype=np.int64)  # number of ids
        self.ids = np.empty(0, dtype=self.kind)
        # a token is written with one character for each of its bytes
        self.bytes = np.array([len(tok.id_to_token(i) or "") for i in range(tok.get_vocab_size())])
        special = [re.escape(t.content.encode()) for t in tok.get_added_tokens_decoder().values()]
        self.special = re.compile(b"|".join(special)) if special else None

    def _encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each piece, all ids)."""
        # pieces that begin with white space and end without it can be encoded as one text
        inner = np.array([p[0] in " \t\r\n" and p[-1] not in " \t\r\n" for p in pieces])
        joined = [p for p, j in zip(pieces, inner, strict=True) if j]
        alone = [p for p, j in zip(pieces, inner, strict=True) if not j]
        whole, *rest = (np.asarray(e.ids, dtype=self.kind)
                        for e in self.tok.encode_batch_fast(["".join(joined), *alone], add_special_tokens=False))
        ends = np.cumsum([len(p.encode()) for p in joined])
        upto = np.cumsum(self.bytes[whole])
        cuts = np.searchsorted(upto, ends) + 1
        if len(joined) and not np.array_equal(upto[cuts - 1], ends):
            raise RuntimeError("a token crosses the border of a piece")
        size = np.empty(len(pieces), dtype=np.int64)
        size[inner], size[~inner] = np.diff(np.r_[0, cuts])[:len(joined)], [len(x) for x in rest]
        ids, place = np.empty(size.sum(), dtype=self.kind), np.repeat(inner, size)
        ids[place] = whole
        if rest:
            ids[~place] = np.concatenate(rest)
        return size, ids

    def _learn(self, new: np.ndarray, pieces: list[str], used: np.ndarray) -> None:
        """Remember the ids of new pieces; ``used`` are the places of the known ones in use."""
        size, ids = self._encoded(pieces)
        if len(self.known) + len(new) > self.limit:
            at, self.known, self.size = _ragged(self.first[used], self.size[used]), self.known[used], self.size[used]
            self.ids = self.ids[at]
            self.first = np.cumsum(self.size) - self.size
        first = len(self.ids) + np.cumsum(size) - size
        order = np.argsort(known := np.concatenate([self.known, new]), kind="stable")
        self.known, self.ids = known[order], np.concatenate([self.ids, ids])
        self.first = np.concatenate([self.first, first])[order]
        self.size = np.concatenate([self.size, size])[order]

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        space = _SPACE[data]
        begins = np.empty(len(data) + 1, dtype=bool)
        begins[:-1] = space
        begins[1:-1] &= ~space[:-1]
        begins[offsets] = True
        start = np.flatnonzero(begins[:-1])
        end = np.r_[start[1:], len(data)][:len(start)]
        piece, at, which = np.unique(span_hashes(data, start, end), return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.known, piece), max(0, len(self.known) - 1))
        new = self.known[place] != piece if len(self.known) else np.ones(len(piece), dtype=bool)
        if new.any():
            raw = data.tobytes()
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(start[at[new]].tolist(), end[at[new]].tolist(), strict=True)]
            self._learn(piece[new], texts, place[~new])
            place = np.searchsorted(self.known, piece)
        size = self.size[place][which]
        ids = self.ids[_ragged(self.first[place][which], size)]
        upto = np.r_[0, np.cumsum(size)][np.searchsorted(start, offsets)] * ids.itemsize
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(upto.tolist(), upto.tolist()[1:], strict=False)]

    def _apart(self, text: bytes) -> bytes:
        whole = self.special is not None and self.special.search(text)
        text = text.decode()
        parts = [text] if whole else safe_parts(text)
        return b"".join(np.asarray(e.ids, dtype=self.kind).tobytes()
                        for e in self.tok.encode_batch_fast(parts, add_special_tokens=False))

    def encode(self, column: pa.Array) -> list[bytes]:
        """Ids of every text of a column, a null as an empty one, little-endian."""
        data, offsets = buffer_of(column)
        raw = data.tobytes()
        odd = [p for p in (_OTHER_SPACE, self.special) if p is not None and p.search(raw)]
        if not odd:
            return self._slice(data, offsets)
        texts = [raw[a:b] for a, b in zip(offsets.tolist(), offsets.tolist()[1:], strict=False)]
        apart = {i: self._apart(t) for i, t in enumerate(texts) if any(p.search(t) for p in odd)}
        left = [b"" if i in apart else t for i, t in enumerate(texts)]
        plain = self._slice(np.frombuffer(b"".join(left), dtype=np.uint8), np.r_[0, np.cumsum([len(t) for t in left])])
        return [apart.get(i, ids) for i, ids in enumerate(plain)]


def _ragged(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of every run, one run after another."""
    return np.arange(size.sum()) + np.repeat(first - (np.cumsum(size) - size), size)


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def piece_encoder(path: str, end_id: int) -> tuple[PieceEncoder, int]:
    """The encoder of a file, kept per Python worker, and the bytes per id."""
    tok = tokenizer(path)
    width = 2 if max(tok.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    return _encoders.setdefault((path, width), PieceEncoder(tok, width)), width


def write_records(docs: DataFrame, tokenizer_path: str, end_id: int, root: str | None = None,
                  text: str = "text") -> DataFrame:
    """Encode and write all documents; returns the index read back from its table, one
    row per record: doc_id, shard, offset, length, width, n_tokens (with the end id),
    start (ids of all records before it)."""
    spark = docs.sparkSession
    root = root or folder(spark, "records")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = piece_encoder(tokenizer_path, end_id)
        end = end_id.to_bytes(width, "little")
        no, out, at, before = TaskContext.get().partitionId(), None, 0, 0
        shard = f"{root}/{no:06d}-{uuid.uuid4().hex}.rec"
        for whole in batches:
            for i, j in row_slices(whole.column(1), SLICE_BYTES):
                batch = whole.slice(i, j - i)
                if out is None:
                    system, path = _file_system(shard)
                    system.create_dir(path.rpartition("/")[0], recursive=True)
                    out = system.open_output_stream(path)
                rows = []
                for ids in encoder.encode(batch.column(1)):
                    record, n_ids = frame(ids + end), len(ids) // width + 1
                    out.write(record)
                    rows.append((at, len(record), n_ids, before))
                    at, before = at + len(record), before + n_ids
                offset, length, n, prior = (pa.array(x, pa.int64()) for x in zip(*rows, strict=True))
                fill = [pa.repeat(pa.scalar(shard), len(rows)), pa.repeat(pa.scalar(no, pa.int64()), len(rows))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *fill, offset, length, pa.repeat(pa.scalar(width, pa.int32()), len(rows)),
                     n, prior],
                    names=["doc_id", "shard", "shard_no", "offset", "length", "width", "n_tokens", "before"])
        if out is not None:
            out.close()

    ordered = (docs.select(F.col("doc_id").cast("long"), F.col(text).cast("string").alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text"))
    index = saved(ordered.mapInArrow(write, INDEX_SCHEMA), "record-index")
    # ids before a shard: a running sum over one row per shard
    base = (index.groupBy("shard_no", "shard").agg(F.sum("n_tokens").alias("ids"))
            .withColumn("base", F.sum("ids").over(Window.orderBy("shard_no").rowsBetween(Window.unboundedPreceding, 0))
                        - F.col("ids")))
    return (index.join(base.select("shard", "base"), "shard")
            .select("doc_id", "shard", "offset", "length", "width", "n_tokens",
                    (F.col("base") + F.col("before")).alias("start")))


def read_records(index: DataFrame) -> DataFrame:
    """Fetch the records that index rows name, in any order, checking lengths and
    checksums: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files: OrderedDict[str, object] = OrderedDict()
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                ids = []
                for shard, offset, length, width, n in zip(*(x.to_pylist() for x in batch.columns[2:]), strict=True):
                    if shard not in files:
                        if len(files) >= _OPEN_SHARDS:
                            files.popitem(last=False)[1].close()
                        system, path = _file_system(shard)
                        files[shard] = system.open_input_file(path)
                    files.move_to_end(shard)
                    got = np.frombuffer(unframe(files[shard].read_at(length, offset)), dtype=f"<u{width}")
                    if len(got) != n:
                        raise ValueError("record and index differ in the number of ids")
                    ids.append(got.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), batch.column("n_tokens"), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "n_tokens", "ids"])
        for f in files.values():
            f.close()

    return index.select("doc_id", "start", "shard", "offset", "length", "width", "n_tokens").mapInArrow(read, schema)
