"""Token counts without token ids: pieces are counted once for each distinct pre-token and joined to the texts' pre-token frequencies.

The merges of a sentence-piece model cannot cross the start of a run of spaces if none of its pieces holds a space mark
behind another character. `PieceCounter` checks that when it loads a model, cuts texts there, and counts each distinct
segment once. The join of segment counts to per-document frequencies stays inside an Arrow batch: a document's segments
are never shuffled, so no key can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimp.llm import textvec as tv
from palimp.llm.durable import few_at_once

#: Distinct pre-tokens a worker remembers; beyond, it forgets them all and counts anew.
REMEMBERED = 400_000
MARK = "▁"


class PieceCounter:
    """Counts the pieces of whole texts by a sentencepiece model file."""

    def __init__(self, model: str) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        #: Whether texts may be cut before a run of spaces.
        self.cut = not any(MARK in p.lstrip(MARK) for p in pieces) and self.sp.encode("  a", out_type=str)[0].startswith(MARK * 2) and len(self.sp.encode("a ")) == 2
        self.known: dict[int, int] = {}
        self.powers = tv.Powers()

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.sp.encode(texts, num_threads=1)]

    def counts(self, col: pa.Array) -> np.ndarray:
        """The number of pieces of each text; a null one has none."""
        if not self.cut:
            return np.array(self.whole(pc.fill_null(col, "").to_pylist()), np.int64)
        col = pc.replace_substring(col, MARK, " ")  # the model takes a mark in a text for a space
        parts = [self.slice(buf, offs) for _, buf, offs in tv.slices(col)]
        return np.concatenate(parts) if parts else np.empty(0, np.int64)

    def slice(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        texts = len(offs) - 1
        if not len(buf):
            return np.zeros(texts, np.int64)
        space = buf == 0x20
        edge = np.zeros(len(buf) + 1, bool)
        edge[offs] = True
        at = edge[:-1] | space & ~np.r_[False, space[:-1]]
        starts = np.flatnonzero(at)
        ends = np.r_[starts[1:], len(buf)]
        # The model adds one mark before what it is given, which stands for the segment's first space, if it isn't the text's first.
        inner = ~edge[starts]
        starts = starts + inner
        of = np.searchsorted(offs, starts - inner, "right") - 1
        bare = starts == ends  # a single space at the end of a text
        h = tv.hashes(buf, starts, ends, self.powers)
        keys, at, inverse = np.unique(h, return_index=True, return_inverse=True)
        table = self.lookup(buf, keys, starts[at], ends[at])
        return np.bincount(of, np.where(bare, 1, table[inverse]), texts).astype(np.int64)

    def lookup(self, buf: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known, listed = self.known, keys.tolist()
        new = [i for i, k in enumerate(listed) if k not in known]
        if new:
            raw = buf.tobytes()
            a, b = starts.tolist(), ends.tolist()
            for lo in range(0, len(new), 20_000):
                part = new[lo : lo + 20_000]
                for i, n in zip(part, self.whole([raw[a[i] : b[i]].decode("utf-8", "replace") for i in part]), strict=True):
                    known[listed[i]] = n
        return np.fromiter(map(known.__getitem__, listed), np.int64, len(listed))


def token_counts(docs: DataFrame, model: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), limit: int = 4096) -> DataFrame:
    """keep + n_bytes, n_tokens, over_limit for each row of `docs`.

    A null or empty text has no bytes and no tokens. Repeated rows are counted each. Columns other than `text` and `keep`
    are not read, so their names cannot clash; an empty table gives an empty result. Equal 64-bit hashes of different
    segments of one worker would miscount; at a million distinct segments the odds are about 3 in 100 million.
    """
    kept = few_at_once(docs).select(*(F.col(f"`{c}`") for c in keep)).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = PieceCounter(model)
        for b in batches:
            col = b.column(b.schema.names.index("__text"))
            n = counter.counts(col)
            size = pc.fill_null(pc.binary_length(col), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), size, pa.array(n), pa.array(n > limit)], names=[*keep, "n_bytes", "n_tokens", "over_limit"])

    from pyspark.sql import types as T

    schema = T.StructType([*kept.fields, T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text")).mapInArrow(count, schema)
