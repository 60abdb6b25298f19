"""Byte-level BPE encoding and decoding with a local rank file.

The merges are tiktoken's.  Long texts are cut before white space that follows
a character other than white space: no match of the split pattern crosses such
a place and none looks behind it, so the pieces encode to the same ids as the
whole.  A run without white space is encoded match by match, and a match too
long for a quadratic merge is merged with a heap.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallystream.llm._arrow import arrow_map, map_texts

#: Characters above which a text is cut at safe places.
CHUNK = 1 << 16
#: Bytes above which one match is merged with a heap.
LONG_MATCH = 512
_SAFE = regex.compile(r"(?<=\S)(?=\s)")
_CODECS: dict[str, Codec] = {}


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, ranks_file: bytes, pattern: str):
        import tiktoken

        self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines()) if a}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=self.ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.decimal = [str(i) for i in range(max(self.bytes_of, default=0) + 1)]
        self.dense = regex.compile(r"\S{%d,}" % LONG_MATCH)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text, without special tokens."""
        if len(text) <= CHUNK and not self.dense.search(text):
            return self.encoding.encode_ordinary(text)
        ids: list[int] = []
        for chunk in safe_chunks(text):
            if self.dense.search(chunk):
                for match in self.pattern.finditer(chunk):
                    ids += self.merge(match[0])
            else:
                ids += self.encoding.encode_ordinary(chunk)
        return ids

    def merge(self, match: str) -> list[int]:
        """Ids of one match of the split pattern; alone, a match is split no further."""
        if len(match) < LONG_MATCH:
            return self.encoding.encode_ordinary(match)
        raw = match.encode()
        if (whole := self.ranks.get(raw)) is not None:
            return [whole]
        return heap_merge(raw, self.ranks)

    def decode(self, ids: list[int]) -> bytes:
        """The raw bytes of ids; an unknown id raises KeyError."""
        return b"".join([self.bytes_of[i] for i in ids])


def safe_chunks(text: str, size: int = CHUNK):
    """Pieces of about ``size`` characters that encode independently."""
    start = 0
    while len(text) - start > size:
        cut = _SAFE.search(text, start + size - 1)
        if not cut or cut.start() <= start:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def heap_merge(raw: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Byte-pair merging in O(n log n): always the lowest rank, leftmost first."""
    n = len(raw)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(raw[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, left, middle, right = heapq.heappop(heap)
        if not alive[left] or end[left] != middle or middle >= n or not alive[middle] or end[middle] != right:
            continue
        alive[middle], end[left] = False, right
        if right < n:
            before[right] = left
            if (r := ranks.get(raw[left : end[right]])) is not None:
                heapq.heappush(heap, (r, left, right, end[right]))
        if (previous := before[left]) >= 0 and (r := ranks.get(raw[previous:right])) is not None:
            heapq.heappush(heap, (r, previous, left, right))
    out, at = [], 0
    while at < n:
        out.append(ranks[raw[at : end[at]]])
        at = end[at]
    return out


def codec(ranks_file: bytes, pattern: str) -> Codec:
    """The codec of a rank file, made once in each Python worker."""
    key = hashlib.sha256(ranks_file + pattern.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS[key] = Codec(ranks_file, pattern)
    return _CODECS[key]


def _broadcast(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``ids``, the token ids of each whole text.

    The rank file at ``path`` is read on the driver and sent to the executors;
    its size does not depend on the data.  A null or empty text has no ids.
    Repeated rows are encoded each.
    """
    shared = _broadcast(df, path)

    def kernel():
        coder = codec(shared.value, pattern)
        return lambda texts: [[coder.encode(t or "") for t in texts.to_pylist()]]

    return map_texts(df, text, list(keep), [T.StructField("ids", T.ArrayType(T.IntegerType()))], kernel)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` and ``decoded``, the raw bytes of each list of ids; null counts as empty."""
    shared = _broadcast(df, path)
    chosen = df.select(*keep, ids)
    schema = T.StructType([*chosen.schema.fields[:-1], T.StructField("decoded", T.BinaryType())])

    def run(batches):
        coder = codec(shared.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                raw = pa.array([coder.decode(x or []) for x in part.column(len(keep)).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], raw], schema.names)

    return arrow_map(chosen, run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes each text, decodes the ids and returns digests of both.

    Columns ``keep``, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by
    commas), ``decoded_sha256``, ``n_bytes`` and ``lossless``, whether the decoded
    bytes are the text's.  The ids never leave the worker, so nothing larger
    than a digest is written.  A null text counts as empty.
    """
    shared = _broadcast(df, path)
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()), T.StructField("n_bytes", T.LongType()), T.StructField("lossless", T.BooleanType())]

    def kernel():
        coder = codec(shared.value, pattern)
        decimal = coder.decimal

        def compute(texts):
            out: list[list] = [[], [], [], [], []]
            for t in texts.to_pylist():
                t = t or ""
                ids = coder.encode(t)
                decoded = coder.decode(ids)
                row = (len(ids), hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest(), hashlib.sha256(decoded).hexdigest(), len(decoded), decoded == t.encode())
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            return out

        return compute

    return map_texts(df, text, list(keep), fields, kernel)
