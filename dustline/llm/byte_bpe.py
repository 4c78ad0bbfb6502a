"""Byte-level BPE by the tiktoken library: encoding of whole texts to packed ids and decoding of ids to raw bytes.

Null, empty and long texts: a null text is an empty one and has no ids. Long texts are cut about every CHUNK characters before
white space that follows another character; the pattern never matches across such a place, so the chunks' ids are those of the
whole text, whatever its length. Long runs of white space, in which the library's pattern engine goes too deep, are cut off as the pattern would
(all but the last character, which belongs to what follows; all of it at the end of a text) and encoded as single pieces.
Repeated rows are encoded alike, an empty table gives an empty one, and input columns that clash
with the output's names are replaced.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dustline.llm.common import map_arrow, pieces

#: Characters after which a text is cut at the next safe place, and white space that is encoded as a piece of its own.
CHUNK, LONG_SPACE = 16_384, 4096
# Unicode's White_Space characters, which the pattern's \s stands for.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SAFE = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")
_LONG = re.compile(f"[{SPACE}]{{{LONG_SPACE},}}")


def default_ranks() -> tuple[bytes, str]:
    import public_tokenizers as P

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), P.PATTERN


def encoding(ranks: bytes, pattern: str):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_chunks(text: str, size: int = CHUNK) -> Iterator[str]:
    """Cuts before white space that follows another character."""
    start = 0
    while len(text) - start > size:
        at = _SAFE.search(text, start + size)
        if not at:
            break
        yield text[start : at.start()]
        start = at.start()
    yield text[start:]


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: bytes, pattern: str):
        self.library = encoding(ranks, pattern)
        self.bytes: list[bytes | None] = [None] * self.library.n_vocab
        for token, i in self.library._mergeable_ranks.items():
            self.bytes[i] = token

    def _ordinary(self, text: str) -> Iterator[bytes]:
        for chunk in safe_chunks(text):
            yield np.asarray(self.library.encode_ordinary(chunk), dtype="<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        out, done = [], 0
        for run in _LONG.finditer(text or ""):
            end = run.end() if run.end() == len(text) else run.end() - 1
            out += self._ordinary(text[done : run.start()])
            out.append(np.asarray(self.library._encode_single_piece(text[run.start() : end].encode()), dtype="<u4").tobytes())
            done = end
        if text:
            out += self._ordinary(text[done:])
        return b"".join(out)

    def decode(self, ids: bytes | None) -> bytes:
        """The bytes of packed ids; an id outside the vocabulary is an error."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(ids or b"", "<u4").tolist()))


def encode(df: DataFrame, ranks: bytes | None = None, pattern: str | None = None, text: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """The kept columns (all, if none are named), `n_tokens` and `token_ids` (packed little-endian unsigned 32-bit ids).

    With `decoded` also what the ids decode to, as decode() gives it, by the same worker: a round trip needs one Python process for each task, not two.

    The rank file (under 2 MB, whatever the corpus) goes to the executors by broadcast; they read no local file.
    """
    if ranks is None:
        ranks, pattern = default_ranks()
    spark: SparkSession = df.sparkSession
    sent = spark.sparkContext.broadcast((ranks, pattern))
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("n_tokens", "token_ids", *(["decoded"] if decoded else []))]
    whole = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*whole.select(*keep).schema.fields, T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())])
    if decoded:
        schema = schema.add("decoded", T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*sent.value)
        for batch in batches:
            for part in pieces(batch, column="__text"):
                ids = [coder.encode(t) for t in part.column("__text").to_pylist()]
                made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    made.append(pa.array([coder.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made], names=schema.names)

    return map_arrow(whole, run, schema)


def decode(df: DataFrame, ranks: bytes | None = None, pattern: str | None = None, ids: str = "token_ids") -> DataFrame:
    """Adds `decoded`, the raw bytes of packed ids; they need not be valid UTF-8, as ids can end inside a character."""
    if ranks is None:
        ranks, pattern = default_ranks()
    sent = df.sparkSession.sparkContext.broadcast((ranks, pattern))
    keep = [c for c in df.columns if c != "decoded"]
    schema = T.StructType([*df.select(*keep).schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(*sent.value)
        for batch in batches:
            for part in pieces(batch, column=ids):
                back = pa.array([coder.decode(x) for x in part.column(ids).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), back], names=[*keep, "decoded"])

    return map_arrow(df.select(*keep), run, schema)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded bytes of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    both = encode(docs, keep=["doc_id"], decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
