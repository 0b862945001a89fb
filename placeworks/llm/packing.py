"""Bounded-space online packing of tokenised documents into fixed windows.

Every Spark partition keeps a fixed number of open windows. A document's ids are cut into
full windows while they last; the rest goes to the open window it fits best. When none fits and
no window may be opened, the fullest window is topped up with the head of the piece (ids may
be cut freely), emitted, and the remainder is placed anew. What is still open at the end of a
partition is merged with the leftovers of a bounded number of other partitions.

No text leaves its partition: only piece descriptions do, and of the leftovers (at most
``open_windows * size`` ids a partition) the ids, so that merging may cut as well.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeworks.llm.store import written

SIZE, OPEN_WINDOWS, MERGED_PARTITIONS, END_ID = 1024, 32, 32, 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_STAGED = PIECES + ", part long, ids binary"


def byte_bpe(name: str = "byte_bpe_50k.tiktoken"):
    """The byte-level BPE of byte_bpe_50k.json. The rank file holds the same vocabulary; its
    encoder gives the same ids several times faster (tests compare the two). The special string
    is encoded as its one id, as the tokenizers library does by default."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": 50256})


class Packer:
    """Windows of ``size`` ids, at most ``open_windows`` of them open. A piece is
    (doc_id, start, doc_tokens, ids); closed windows are handed to ``emit`` as lists of pieces."""

    def __init__(self, emit, size: int = SIZE, open_windows: int = OPEN_WINDOWS):
        self.emit, self.size, self.most = emit, size, open_windows
        self.gaps: list[tuple[int, int]] = []  # (free ids, window), ascending
        self.windows: dict[int, list] = {}
        self.next = 0

    def add(self, doc_id, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        while len(ids) >= self.size:
            self.emit([(doc_id, start, doc_tokens, ids[: self.size])])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            at = bisect.bisect_left(self.gaps, (len(ids), -1))
            if at < len(self.gaps):
                gap, window = self.gaps.pop(at)
            elif len(self.windows) < self.most:
                gap, window = self.size, self.next
                self.windows[window] = []
                self.next += 1
            else:
                gap, window = self.gaps.pop(0)
            head = ids[:gap]
            self.windows[window].append((doc_id, start, doc_tokens, head))
            if gap == len(head):
                self.emit(self.windows.pop(window))
            else:
                bisect.insort(self.gaps, (gap - len(head), window))
            start, ids = start + len(head), ids[gap:]

    def leftovers(self) -> Iterator[tuple]:
        for _, window in self.gaps:
            yield from self.windows[window]


def _row(piece: tuple, sequence: int, offset: int) -> tuple:
    doc_id, start, doc_tokens, ids = piece
    return doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), doc_tokens, sequence, offset


def _laid(window: list, sequence: int) -> Iterator[tuple]:
    offset = 0
    for piece in window:
        yield _row(piece, sequence, offset)
        offset += len(piece[3])


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, open_windows: int = OPEN_WINDOWS, merged_partitions: int = MERGED_PARTITIONS) -> DataFrame:
    """One row per piece: which ids of which document lie where in which sequence.

    A null or empty text is the end id alone; a null id stays null; repeated rows are packed once
    each; an empty table gives no rows; other columns are ignored. Sequences hold ``size`` ids,
    except one at the end of each group of ``merged_partitions`` partitions.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("ids", pa.binary())])

    def partition(batches):
        encoder, part = byte_bpe(), TaskContext.get().partitionId()
        rows: list[tuple] = []
        made = [0]

        def emit(window):
            rows.extend((*r, None, None) for r in _laid(window, (part << 32) + made[0]))
            made[0] += 1

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            return out

        packer = Packer(emit, size, open_windows)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = encoder.encode_to_numpy(text.as_py() or "", allowed_special="all")
                packer.add(doc_id, 0, len(ids) + 1, np.append(ids, np.uint32(END_ID)))
                if len(rows) >= 20_000:
                    yield batch()
        rows.extend((*_row(p, -1, 0), part, p[3].astype("<u4").tobytes()) for p in packer.leftovers())
        if rows:
            yield batch()

    def merged(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        first = int(pdf["part"].min())
        made = [0]

        def emit(window):
            out.extend(_laid(window, (first << 32) + (1 << 31) + made[0]))
            made[0] += 1

        packer = Packer(emit, size, open_windows)
        rest = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        for doc_id, start, tokens, ids in zip(rest["doc_id"], rest["start"], rest["doc_tokens"], rest["ids"]):
            packer.add(None if pd.isna(doc_id) else int(doc_id), int(start), int(tokens), np.frombuffer(ids, "<u4"))
        last = Packer(emit, size, 1)
        for piece in list(packer.leftovers()):
            last.add(*piece)
        for window in last.windows.values():
            emit(window)
        made_of = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
        return made_of.astype({"doc_id": "Int64"})

    pieces = written(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(partition, _STAGED))
    names = [c.split()[0] for c in PIECES.split(", ")]
    closed = pieces.filter("part is null").select(*names)
    rest = pieces.filter("part is not null").groupBy(F.floor(F.col("part") / merged_partitions)).applyInPandas(merged, PIECES)
    return closed.unionByName(rest)
