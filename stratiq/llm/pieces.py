"""SentencePiece encoding and decoding with a distinct-chunk table.

The model writes each space as a marker, and no piece of its vocabulary has a
marker after another character (checked when the model is loaded).  A merge can
therefore never cross from a word into the marker behind it, and a text falls
into chunks (a run of markers and the word behind it) that are segmented
independently.  Each task keeps a table from distinct chunk to ids, asks the
library only for chunks it has not met, and joins the ids back by position.

The table holds at most ``table_size`` chunks and is emptied when full; chunks
of over ``LONG`` characters are not kept.  Both bounds affect memory only.

Defined results
---------------
* Null text counts as empty: begin and end ids alone, decoded to "".
* Texts of any length are encoded whole (the library takes about 80 bytes a
  character for a chunk, so memory bounds chunks without a space, not texts); ties and repeated rows are encoded
  one by one and give equal results; an empty table gives an empty result.
* Further columns pass through, whatever their names; ``encode`` and ``decode``
  raise ValueError if one has the name of an output column.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T


MARK = "▁"
LONG = 64
CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")


def load(model_file: str):
    """The library's processor, after the check that chunks are independent."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    for i in range(model.vocab_size()):
        if MARK in model.id_to_piece(i).lstrip(MARK):
            raise ValueError(f"piece {i} crosses a marker: texts can't be cut into chunks")
    # The marker in front of a text and the identity of all other characters.
    if model.encode("a  a ", out_type=str) != [f"{MARK}a", MARK, f"{MARK}a", MARK]:
        raise ValueError("the model changes white space: texts can't be cut into chunks")
    return model


class ChunkTable(dict):
    """From chunk to (ids as little-endian unsigned 32-bit bytes, text when decoded behind another chunk)."""

    def __init__(self, model, size: int):
        super().__init__()
        self.model, self.size = model, size

    def __missing__(self, chunk: str) -> tuple[bytes, str]:
        # The library puts one marker in front of what it encodes.
        ids = self.model.encode(chunk[1:].replace(MARK, " ")) if chunk != MARK else [self.model.piece_to_id(MARK)]
        found = b"".join(i.to_bytes(4, "little") for i in ids), " " + self.model.decode(ids)
        if len(chunk) <= LONG:
            if len(self) >= self.size:
                self.clear()
            self[chunk] = found
        return found

    def text(self, text: str) -> tuple[bytes, str]:
        """Ids and decoded text of a whole text, without begin and end."""
        if not text:
            return b"", ""
        marked = MARK + text.replace(" ", MARK)
        if "\0" in marked:  # the library ends a piece there; such texts go through it whole
            ids = self.model.encode(text)
            return b"".join(i.to_bytes(4, "little") for i in ids), self.model.decode(ids)
        found = list(map(self.__getitem__, CHUNKS.findall(marked)))
        return b"".join([x[0] for x in found]), "".join([x[1] for x in found])[1:]


def encode(
    docs: DataFrame,
    model_file: str,
    text_col: str = "text",
    ids: bool = True,
    decoded: bool = True,
    digests: bool = False,
    bos: bool = True,
    eos: bool = True,
    table_size: int = 200_000,
) -> DataFrame:
    """Add n_tokens and, as asked, ids (array<int>), decoded (string), ids_sha256 and decoded_sha256."""
    added = [("n_tokens", pa.int64(), "long")]
    added += [("ids", pa.list_(pa.int32()), "array<int>")] * ids + [("decoded", pa.string(), "string")] * decoded
    added += [("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")] * digests
    if clash := {x[0] for x in added} & set(docs.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, _, t in added)).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        model = load(model_file)
        table = ChunkTable(model, table_size)
        first = model.bos_id().to_bytes(4, "little") if bos else b""
        last = model.eos_id().to_bytes(4, "little") if eos else b""
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                out: dict[str, list] = {n: [] for n, _, _ in added}
                for text in batch.column(at):
                    body, plain = table.text(text.as_py() or "")
                    packed = first + body + last
                    out["n_tokens"].append(len(packed) // 4)
                    if ids:
                        out["ids"].append(np.frombuffer(packed, "<i4"))
                    if decoded:
                        out["decoded"].append(plain)
                    if digests:
                        out["ids_sha256"].append(hashlib.sha256(packed).hexdigest())
                        out["decoded_sha256"].append(hashlib.sha256(plain.encode("utf-8")).hexdigest())
                columns = [*batch.columns, *(pa.array(out[n], t) for n, t, _ in added)]
                yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, *out])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, model_file: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Add the text of an array of ids, as the library decodes it; null ids decode to ""."""
    if out_col in docs.columns:
        raise ValueError(f"the input already has {out_col}")
    at = docs.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_file)
        for batch in batches:
            texts = [model.decode(x.as_py() or []) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, out_col])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out_col, T.StringType())]))


def digest(docs: DataFrame, model_file: str) -> DataFrame:
    """The contract's rows: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    out = encode(docs.select("doc_id", "text"), model_file, ids=False, decoded=False, digests=True)
    return out.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

