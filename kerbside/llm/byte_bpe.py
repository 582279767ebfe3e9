"""Byte-level BPE: encoding with a local rank file, and decoding back to bytes.

The tiktoken library merges; this module only decides where a long text may be cut. A token
never reaches from a letter or digit into the white space after it: no alternative of the
pattern holds both in that order, and the one look-ahead asks for no white space after white
space. So a space or newline right after an ASCII letter or digit always begins a new match,
and a text may be cut there without changing any match.

Null texts read as empty (no ids). A text without a safe boundary, such as one long run of one
character, is matched as a whole and each match is encoded by itself.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from kerbside.llm.common import text_slices

#: Texts are cut at the first safe boundary after so many characters.
PIECE_CHARS = 1 << 16
#: A piece above so many characters holds no early boundary; its matches are taken one by one.
LONGEST_PIECE = 1 << 18
#: So many id lists are decoded at a time.
DECODED_ROWS = 64

_BOUNDARY = regex.compile(r"(?<=[A-Za-z0-9])[ \n]")
_loaded: dict[tuple[str, str], Codec] = {}


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Consecutive parts of a text, cut at safe boundaries only."""
    start = 0
    while len(text) - start > size:
        found = _BOUNDARY.search(text, start + size)
        if found is None:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class Codec:
    """One rank file and its splitting pattern."""

    def __init__(self, ranks_path: str, pattern: str):
        ranks = {}
        with open(ranks_path, "rb") as lines:
            for line in lines:
                token, rank = line.split()
                ranks[base64.b64decode(token)] = int(rank)
        self._encoding = tiktoken.Encoding(
            "local-ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self._matches = regex.compile(pattern)

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a whole text, in parts of bounded size."""
        for piece in pieces(text):
            if len(piece) <= LONGEST_PIECE:
                yield self._encoding.encode_ordinary(piece)
            else:
                for match in self._matches.finditer(piece):
                    yield self._encoding._encode_single_piece(match.group())

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes; a part may end inside a character."""
        return self._encoding.decode_bytes(ids)


def codec(ranks_path: str, pattern: str) -> Codec:
    """Loaded once per worker process."""
    key = (ranks_path, pattern)
    if key not in _loaded:
        _loaded[key] = Codec(ranks_path, pattern)
    return _loaded[key]


ENCODED = T.ArrayType(T.IntegerType())


def _lists(parts: list[list[np.ndarray]]) -> pa.Array:
    """One list of ids per text, from its parts, without Python numbers."""
    sizes = [sum(map(len, own)) for own in parts]
    flat = [part for own in parts for part in own]
    values = np.concatenate(flat) if flat else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values, pa.int32()))


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    text: str = "text",
    ids: str = "ids",
    keep_text: bool = True,
) -> DataFrame:
    """Append the ids of each text as an array column named ``ids`` (replaced if present)."""
    rest = [name for name in docs.columns if name != ids and (keep_text or name != text)]
    schema = T.StructType([*(docs.schema[n] for n in rest), T.StructField(ids, ENCODED)])

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            for first, texts in text_slices(batch, text):
                part = batch.slice(first, len(texts)).select(rest)
                lists = _lists([[np.asarray(c, np.int32) for c in own.encode(t)] for t in texts])
                yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*rest, ids])

    return docs.mapInArrow(run, schema)


def decode(
    rows: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", out: str = "decoded"
) -> DataFrame:
    """Append the raw bytes of each id list (null reads as empty)."""
    rest = [name for name in rows.columns if name != out]
    schema = T.StructType([*(rows.schema[n] for n in rest), T.StructField(out, T.BinaryType())])

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, DECODED_ROWS):
                part = batch.slice(first, DECODED_ROWS)
                decoded = [own.decode(x.as_py() or []) for x in part.column(ids)]
                yield pa.RecordBatch.from_arrays(
                    [*part.select(rest).columns, pa.array(decoded, pa.binary())], names=[*rest, out]
                )

    return rows.mapInArrow(run, schema)


def round_trip(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids"
) -> DataFrame:
    """The ids in place of each text, their number ``n_tokens``, the digest ``decoded_sha256`` of the bytes that
    they decode to, and ``is_text``, whether these are the text's. One pass encodes and decodes, part by part,
    so a worker holds one vocabulary and the ids of a run of texts."""
    added = (ids, "n_tokens", "decoded_sha256", "is_text")
    rest = [name for name in docs.columns if name != text and name not in added]
    schema = T.StructType(
        [*(docs.schema[n] for n in rest), T.StructField(ids, ENCODED)]
        + [T.StructField("n_tokens", T.LongType()), T.StructField("decoded_sha256", T.StringType())]
        + [T.StructField("is_text", T.BooleanType())]
    )

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            for first, texts in text_slices(batch, text):
                parts, digests, same = [], [], []
                for whole in texts:
                    held, decoded = [], hashlib.sha256()
                    for part in own.encode(whole):
                        held.append(np.asarray(part, np.int32))
                        decoded.update(own.decode(part))
                    parts.append(held)
                    digests.append(decoded.hexdigest())
                    same.append(hashlib.sha256(whole.encode()).hexdigest() == digests[-1])
                lists = _lists(parts)
                yield pa.RecordBatch.from_arrays(
                    [
                        *batch.slice(first, len(texts)).select(rest).columns,
                        lists,
                        pa.array(np.diff(lists.offsets.to_numpy()), pa.int64()),
                        pa.array(digests, pa.string()),
                        pa.array(same, pa.bool_()),
                    ],
                    names=[*rest, *added],
                )

    return docs.mapInArrow(run, schema)


def round_trip_digests(
    docs: DataFrame, ranks_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded bytes.

    Ids and bytes are digested part by part, so a very long text needs no more memory than its
    own characters.
    """

    def run(batches):
        own = codec(ranks_path, pattern)
        for batch in batches:
            for first, texts in text_slices(batch, text):
                counts, id_digests, byte_digests = [], [], []
                for whole in texts:
                    count, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
                    for part in own.encode(whole):
                        count += len(part)
                        of_ids.update(np.asarray(part, "<u4").tobytes())
                        of_bytes.update(own.decode(part))
                    counts.append(count)
                    id_digests.append(of_ids.hexdigest())
                    byte_digests.append(of_bytes.hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(doc_id).slice(first, len(texts)),
                        pa.array(counts, pa.int64()),
                        pa.array(id_digests, pa.string()),
                        pa.array(byte_digests, pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema[doc_id].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )
    return docs.select(doc_id, text).mapInArrow(run, schema)
