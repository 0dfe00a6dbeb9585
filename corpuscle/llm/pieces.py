"""SentencePiece ids by a table of distinct chunks, and texts from ids.

Where no piece holds a blank mark after another character, a text falls into chunks, each a run of marks and what follows up to the next one, that
are segmented independently. Each distinct chunk is segmented once and its ids are kept as bytes; the ids of a text are those of its chunks joined by
position. The table belongs to a Python worker and starts anew when it is full, so a chunk is segmented once in a table's life: occurrences
outnumber distinct chunks about 25 to 1 in the given tables, and moving them to a table of the whole corpus would shuffle more than it saves. Nothing is
shuffled, and a lost executor costs its own batches. Under a model whose pieces can cross marks, a whole text is one chunk.

Decoding joins the pieces' bytes: marks become blanks, the mark that the library put before a text goes, begin and end are silent, and a run of byte pieces that isn't
valid UTF-8 gives one replacement character for each wrong byte.

Defined cases: a null text is an empty one and has begin and end alone; null ids give a null text; long texts are taken in windows that end where a chunk begins;
equal rows give equal results; an empty table gives no rows; further columns pass through, but for those named like an added one, which it replaces.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import attached, bounded_batches, frugal, read, without
from .tokens import BLANK, MODEL, model_path

#: Chunks after which a worker's table starts anew, and the characters of the longest ones that stay in it.
KEPT, KEPT_CHARS = 500_000, 48
#: Characters of a text, and ids, that are taken at once.
WINDOW = 1 << 20
_CHUNK = re.compile(" +[^ ]*")
#: Ids as they are stored and hashed.
IDS = np.dtype("<u4")


class ChunkTable:
    """Distinct chunks and their ids under one model."""

    def __init__(self, path: str, kept: int = KEPT):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.silent = [lib.is_control(i) for i in range(n)]
        self.byte = [lib.is_byte(i) for i in range(n)]
        names = [lib.id_to_piece(i) for i in range(n)]
        self.bytes = [b"" if self.silent[i] else bytes([int(names[i][3:5], 16)]) if self.byte[i] else " ⁇ ".encode() if lib.is_unknown(i) else names[i].replace(BLANK, " ").encode() for i in range(n)]
        self.marked = [not self.silent[i] and names[i].startswith(BLANK) for i in range(n)]
        if lib.decode(lib.encode("  ﬁ  x")) != "  ﬁ  x" or lib.encode("x", out_type=str)[0][0] != BLANK:
            raise ValueError("not a model that keeps texts as they are and begins them with a blank")
        self.apart = not any(BLANK in names[i].lstrip(BLANK) for i in range(n) if not (self.silent[i] or self.byte[i]))
        self.blank = np.array([lib.piece_to_id(BLANK)], IDS).tobytes()
        self.begin, self.end = (np.array([i], IDS).tobytes() for i in (lib.bos_id(), lib.eos_id()))
        self.kept, self.known = kept, {}

    def chunks(self, text: str):
        """Lists of chunks, the mark as a blank, that make up the text with a blank before it."""
        if not text:
            return
        text = " " + text.replace(BLANK, " ")
        if not self.apart:
            yield [text]
            return
        at = 0
        while at < len(text):
            end = at + WINDOW
            if end >= len(text):
                end = len(text)
            else:  # a window ends before a run of blanks
                while end < len(text) and not (text[end] == " " and text[end - 1] != " "):
                    blank = text.find(" ", end + 1)
                    end = len(text) if blank < 0 else blank
            yield _CHUNK.findall(text, at, end)
            at = end

    def segment(self, chunks: list[str]) -> dict[str, bytes]:
        """The ids of each of some distinct chunks. The library puts one blank before what it gets."""
        found = self.lib.encode([c[1:] for c in chunks], num_threads=1)
        size = np.fromiter(map(len, found), np.int64, len(found))
        flat = np.fromiter(chain.from_iterable(found), IDS, int(size.sum())).tobytes()
        off = (IDS.itemsize * np.concatenate([[0], np.cumsum(size)])).tolist()
        out = {c: flat[a:z] for c, a, z in zip(chunks, off, off[1:])}
        if " " in out:
            out[" "] = self.blank  # nothing after its mark
        return out

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, without begin and end."""
        out = []
        for t in texts:
            parts = []
            for some in self.chunks(t):
                new = [c for c in dict.fromkeys(some) if c not in self.known]
                if new:
                    if len(self.known) + len(new) > self.kept:
                        self.known = {c: self.known[c] for c in some if c in self.known}
                    self.known |= self.segment(new)
                parts.append(b"".join(map(self.known.__getitem__, some)))
                for c in new:
                    if len(c) > KEPT_CHARS:
                        del self.known[c]
            out.append(b"".join(parts))
        return out

    def text(self, ids: bytes) -> str:
        """The text that ids stand for."""
        numbers = np.frombuffer(ids, IDS)
        parts = [b"".join(map(self.bytes.__getitem__, numbers[a : a + WINDOW].tolist())) for a in range(0, len(numbers), WINDOW)]
        raw = b"".join(parts)
        first = next((int(i) for i in numbers if not self.silent[i]), None)
        own = first is not None and self.marked[first]
        try:
            out = raw.decode()
        except UnicodeDecodeError:
            out = "".join(self._lossy(numbers.tolist()))
        return out[1:] if own else out

    def _lossy(self, numbers: list[int]):
        run = b""
        for i in [*numbers, None]:
            if i is not None and self.byte[i]:
                run += self.bytes[i]
                continue
            while run:
                k = next((k for k in (1, 2, 3, 4) if _whole(run[:k])), 0)
                yield run[:k].decode() if k else "�"
                run = run[max(k, 1) :]
            if i is not None:
                yield self.bytes[i].decode()


def _whole(b: bytes) -> bool:
    try:
        return len(b.decode()) == 1
    except UnicodeDecodeError:
        return False


_tables: dict[str, ChunkTable] = {}


def chunk_table(path: str) -> ChunkTable:
    """One table for each worker process and model."""
    if path not in _tables:
        _tables[path] = ChunkTable(path)
    return _tables[path]


def encode_pieces(docs: DataFrame, path: str | None = None, begin: bool = True, end: bool = True, text: str = "text") -> DataFrame:
    """docs with sp_ids (binary: little-endian unsigned 32-bit ids) and sp_count. `path` names the model on the executors."""
    bounded_batches(docs.sparkSession)
    path = path or model_path(MODEL)
    docs = without(docs, "sp_ids", "sp_count")

    def run(batches):
        t = chunk_table(path)
        first, last = t.begin * begin, t.end * end
        for b in batches:
            ids = [first + x + last for x in t.ids([x or "" for x in b.column(text).to_pylist()])]
            cols = [pa.array(ids, pa.binary()), pa.array([len(x) // IDS.itemsize for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "sp_ids", "sp_count"])

    return docs.mapInArrow(frugal(run), attached(docs, [("sp_ids", T.BinaryType()), ("sp_count", T.LongType())]))


def decode_pieces(rows: DataFrame, path: str | None = None, ids: str = "sp_ids") -> DataFrame:
    """rows with sp_text, the text that the ids in a binary column stand for."""
    bounded_batches(rows.sparkSession)
    path = path or model_path(MODEL)
    rows = without(rows, "sp_text")

    def run(batches):
        t = chunk_table(path)
        for b in batches:
            texts = pa.array([None if x is None else t.text(x) for x in b.column(ids).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, texts], names=[*b.schema.names, "sp_text"])

    return rows.mapInArrow(frugal(run), attached(rows, [("sp_text", T.StringType())]))


def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode_pieces(read(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return decode_pieces(ids).select("doc_id", F.col("sp_count").alias("n_tokens"), F.sha2("sp_ids", 256).alias("ids_sha256"), F.sha2("sp_text", 256).alias("decoded_sha256"))


SQL: dict[str, str] = {}
QUERIES = {"op13_pieces": op13_pieces}
