"""Byte-level BPE encoding and decoding with a local rank file.

Texts are encoded with tiktoken inside Arrow tasks, one map without a shuffle.
A long text is cut before encoding, only where a cut cannot change a match of the
pre-splitting pattern, so memory follows the cut size and ids equal those of the
uncut text. Decoding joins the raw bytes of the ranks.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated
rows are encoded each on its own; other columns of the input pass through, and an
input column named like a result column is replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from martlens.llm.textkit import row_slices

#: A longer text is cut at the next safe place after so many characters.
CUT_CHARS = 1 << 16

# Places where every match of the pattern ends, whatever stands around them: before
# a run of white space, between a letter and a digit, and after or before a mark.
# An apostrophe may begin a contraction and is never a mark here.
_SAFE = re.compile(r"(?<=[0-9A-Za-z.,;:!?)À-Ö一-龥。，])(?=[ \n\t])"
                   r"|(?<=[A-Za-z一-龥])(?=[0-9])|(?<=[0-9])(?=[A-Za-z一-龥])"
                   r"|(?<=[.,;:!?)。，])(?=[0-9A-Za-z一-龥])"
                   r"|(?<=[0-9A-Za-z一-龥])(?=[.,;:!?(。，])")


def safe_parts(text: str, chars: int = CUT_CHARS) -> list[str]:
    """The text in consecutive parts of at least ``chars`` characters, cut at safe
    places; a stretch without any safe place stays whole."""
    parts, at = [], 0
    while len(text) - at > chars:
        found = _SAFE.search(text, at + chars)
        if found is None:
            break
        parts.append(text[at:found.start()])
        at = found.start()
    parts.append(text[at:])
    return parts


_encodings: dict[tuple[str, str], object] = {}


def encoding(path: str, pattern: str):
    """The tiktoken encoding of a rank file, loaded once per Python worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encodings[path, pattern] = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks,
                                                      special_tokens={})
    return _encodings[path, pattern]


def encode_text(enc, text: str, chars: int = CUT_CHARS) -> np.ndarray:
    """Ids of one whole text as little-endian unsigned 32-bit integers."""
    return np.concatenate([np.asarray(enc.encode_ordinary(p), dtype="<u4") for p in safe_parts(text, chars)])


def _added(df: DataFrame, fields: list[T.StructField]) -> tuple[list[str], T.StructType]:
    names = {f.name for f in fields}
    keep = [f for f in df.schema.fields if f.name not in names]
    return [f.name for f in keep], T.StructType(keep + fields)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", drop_text: bool = False,
           decode: bool = True) -> DataFrame:
    """Input columns plus ``n_tokens``, ``ids`` (binary, little-endian unsigned 32-bit)
    and, if asked for, ``decoded`` (the bytes that the ids stand for)."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    fields += [T.StructField("decoded", T.BinaryType())] if decode else []
    keep, schema = _added(docs, fields)
    if drop_text:
        keep = [c for c in keep if c != text]
        schema = T.StructType([f for f in schema.fields if f.name != text])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for whole in batches:
            for i, j in row_slices(whole.column(text)):
                batch = whole.slice(i, j - i)
                ids = [encode_text(enc, t or "") for t in batch.column(text).to_pylist()]
                out = [batch.column(c) for c in keep]
                out += [pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if decode:
                    out.append(pa.array([enc.decode_bytes(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    columns = list(dict.fromkeys([*keep, text]))
    return docs.select(*columns).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Input columns plus ``decoded``: raw bytes of the ids; null ids give no bytes."""
    keep, schema = _added(tokens, [T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path, pattern)
        for batch in batches:
            raw = [enc.decode_bytes(np.frombuffer(x or b"", dtype="<u4").tolist())
                   for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(raw, pa.binary())],
                                             names=schema.names)

    return tokens.mapInArrow(run, schema)
