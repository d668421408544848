"""Byte-level BPE over whole texts: overlapping chunks are pre-tokenised in parallel, stitched where their pre-token
boundaries agree again, and the pieces between the stitches are encoded; decoding concatenates the tokens' bytes.

Why stitching is exact: the pattern is matched from left to right and looks behind nothing, so what follows a boundary
depends only on the text from there. Once the boundaries of a chunk's run and of the next chunk's run share a position,
both agree from there on, as far as the earlier chunk could see. `MARGIN` keeps out the boundaries near a chunk's end
that unseen text could move: a run that reaches the end has no boundary before it, and the fixed alternatives of the
pattern are at most three characters long. A piece is encoded by itself, so its last pre-token must not depend on what
follows; runs of white space do (they leave their last sign to a word behind them), so texts are never cut behind one. If two chunks never agree in their overlap (a run of letters or spaces longer
than it), the text is pre-tokenised on from the last sure boundary, with no limit.
"""

from __future__ import annotations

import base64
import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from palimp.llm.durable import few_at_once

CHUNK, OVERLAP, MARGIN = 16_384, 256, 8


class ByteBPE:
    """Encoder and decoder for a rank file (base64 token, rank) and a pre-token pattern."""

    def __init__(self, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> None:
        import regex
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.chunk, self.overlap = chunk, overlap
        self.pattern = regex.compile(pattern)
        self.bpe = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.bytes = [b""] * (max(table.values(), default=-1) + 1)
        for token, rank in table.items():
            self.bytes[rank] = token

    def windows(self, text: str) -> Iterator[tuple[int, str]]:
        """(start, chunk with its overlap)."""
        for a in range(0, max(1, len(text)), self.chunk):
            yield a, text[a : a + self.chunk + self.overlap]

    def boundaries(self, window: str, last: bool) -> list[int]:
        """Ends of the pre-tokens that text behind the window cannot move, of those that lie in an overlap (only there chunks can agree) and not behind white space."""
        sure = len(window) if last else len(window) - MARGIN
        return [e for m in self.pattern.finditer(window) if (e := m.end()) <= sure and (e <= self.overlap or e >= self.chunk) and not window[e - 1].isspace()]

    def stitch(self, text: str, found: Iterable[tuple[int, list[int]]]) -> list[int]:
        """Positions, each a boundary of the whole text, that cut it into pieces; found: (start, ends from there) of the chunks in order."""
        cuts, sure = [0], {0}
        for start, ends in found:
            if start:
                own = [start + e for e in ends]
                agreed = next((e for e in own if e in sure), None)
                if agreed is None:
                    # No boundary in common: go on from the last sure one, to the end of this chunk's reach.
                    at, reach = max(sure), own[-1] if own else start
                    run = []
                    for m in self.pattern.finditer(text, at):
                        run.append(m.end())
                        if m.end() > reach:
                            break
                    sure = {at, *run}
                    agreed = next((e for e in own if e in sure), None)
                    if agreed is None:
                        continue
                if agreed > cuts[-1]:
                    cuts.append(agreed)
                sure = {e for e in own if e >= agreed}
            else:
                sure = {0, *ends}
        return [*cuts, len(text)]

    def encode(self, text: str, cuts: list[int] | None = None) -> list[int]:
        if cuts is None:
            if len(text) <= self.chunk:
                return self.bpe.encode_ordinary(text)
            cuts = self.stitch(text, ((a, self.boundaries(w, a + len(w) >= len(text))) for a, w in self.windows(text)))
        ids: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            ids += self.bpe.encode_ordinary(text[a:b])
        return ids

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


def as_ids(coder: ByteBPE, ids: list[int]) -> tuple:
    """The ids and the decoded text."""
    return ids, coder.decode(ids).decode("utf-8", "replace")


AS_IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


class Digest:
    """n_tokens and the SHA-256 of the ids in decimal, joined by a space, and of the decoded bytes."""

    def __init__(self) -> None:
        self.names: list[str] = []

    def __call__(self, coder: ByteBPE, ids: list[int]) -> tuple:
        if len(self.names) < len(coder.bytes):
            self.names = [str(i) for i in range(len(coder.bytes))]
        said = " ".join(map(self.names.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(said).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()


AS_DIGEST = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_decode(docs: DataFrame, ranks: str, pattern: str, *, text: str = "text", key: str = "doc_id", emit: Callable[[], Callable[[ByteBPE, list[int]], tuple]] = lambda: as_ids, columns: T.StructType = AS_IDS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """`key` and what `emit` makes of each text's ids (by default the ids and the decoded text).

    A text of up to `chunk` characters is one chunk and is encoded where it is read. The chunks of longer texts are dealt
    out, pre-tokenised wherever they land, and come together by (key, hash of the text) for stitching; repeated rows are
    counted before that and each of their chunks goes there once. A null text counts as empty and gives no ids; repeated rows give a row each; an empty table gives an empty result. Only `key` and `text`
    are read, so other columns cannot clash. Lone surrogates cannot occur in Spark strings.
    """
    kind = docs.select(F.col(f"`{key}`").alias(key)).schema
    schema = T.StructType([*kind.fields, *columns.fields])
    names = columns.fieldNames()
    source = few_at_once(docs).select(F.col(f"`{key}`").alias("__key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__text"))
    long = F.length("__text") > chunk
    made: dict[str, object] = {}  # filled once for each task

    def coder() -> tuple[ByteBPE, Callable]:
        if not made:
            made.update(coder=ByteBPE(ranks, pattern, chunk, overlap), emit=emit())
        return made["coder"], made["emit"]

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, row = coder()
        types = to_arrow_schema(schema)
        for b in batches:
            rows = [row(bpe, bpe.encode(x)) for x in b.column(1).to_pylist()]
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), types.field(n).type) for n, c in zip(names, columns, strict=True))], schema=types)

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The chunks of each different row of the task, and last, with start -1, how often each came."""
        bpe, _ = coder()
        rows: Counter = Counter()
        for b in batches:
            for k, x in zip(b["__key"], b["__text"], strict=True):
                digest, size = hashlib.sha1(x.encode()).hexdigest(), len(x)
                rows[k, digest] += 1
                if rows[k, digest] == 1:
                    yield pd.DataFrame([(k, digest, a, w, a + len(w) >= size, 0) for a, w in bpe.windows(x)], columns=pieces)
        yield pd.DataFrame([(k, digest, -1, None, None, n) for (k, digest), n in rows.items()], columns=pieces)

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each different chunk once, with its boundaries; the counts of each text in one row."""
        bpe, _ = coder()
        seen: set = set()
        rows: Counter = Counter()
        for b in batches:
            out = []
            for k, digest, start, w, last, n in b[pieces].itertuples(index=False, name=None):
                if start < 0:
                    rows[k, digest] += n
                elif (k, digest, start) not in seen:
                    seen.add((k, digest, start))
                    out.append((k, digest, start, w, n, bpe.boundaries(w, last)))
            yield pd.DataFrame(out, columns=ended_pieces)
        yield pd.DataFrame([(k, digest, -1, None, n, []) for (k, digest), n in rows.items()], columns=ended_pieces)

    def join(group: pd.DataFrame) -> pd.DataFrame:
        bpe, row = coder()
        copies = int(group["rows"].sum())
        group = group[group["start"] >= 0].sort_values("start")
        final = group["start"].max()
        whole = "".join(x[:chunk] if a < final else x for a, x in zip(group["start"], group["chunk"], strict=True))
        cuts = bpe.stitch(whole, ((int(a), list(e)) for a, e in zip(group["start"], group["ends"], strict=True)))
        out = pd.DataFrame([row(bpe, bpe.encode(whole, cuts))], columns=names)
        out.insert(0, "__key", group["__key"].iloc[0])
        out.insert(1, "__rows", copies)
        return out

    pieces, ended_pieces = ["__key", "digest", "start", "chunk", "last", "rows"], ["__key", "digest", "start", "chunk", "rows", "ends"]
    parts = source.where(long).withColumn("__key", F.col("__key").cast("string")).mapInPandas(split, "__key string, digest string, start long, chunk string, last boolean, rows long")
    ended = parts.repartition("__key", "digest", "start").mapInPandas(bound, "__key string, digest string, start long, chunk string, rows long, ends array<int>")
    stitched = ended.groupBy("__key", "digest").applyInPandas(join, T.StructType([T.StructField("__key", T.StringType()), T.StructField("__rows", T.LongType()), *columns.fields]))
    stitched = stitched.withColumn("__rows", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__rows")))).select(F.col("__key").cast(kind.fields[0].dataType).alias(key), *names)
    return source.where(~long).mapInArrow(short, schema).unionByName(stitched)
