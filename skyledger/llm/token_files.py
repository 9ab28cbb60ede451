"""Token ids in binary files: range-coded, checksummed blocks, one shard for each range of doc_ids.

Documents are range-partitioned and sorted by doc_id. Each partition encodes its texts, ends every
document with an end id, cuts the ids into blocks and codes them (`range_coder`). A shard is a
file of a Parquet table in the shared folder, so Spark's committer publishes it and lost executors
cost nothing but a retry. A row is one block: shard, block, ids in it, the documents that begin in
it with their lengths, and the coded record, which can be decoded and checked by itself.

Null text counts as empty and has the end id alone. Null doc_ids come first; rows with one doc_id
follow each other in the order of their text. Texts are encoded whole; an empty table gives an
empty one. Ids are 16-bit: a larger vocabulary is refused.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skyledger.llm import range_coder
from skyledger.llm.bpe import pre_token_pattern
from skyledger.llm.common import pieces, share, shared

END = 0
BLOCK = 4096
#: Blocks that are coded together; they and their models are what a worker holds.
LANES = 2048
#: Pre-tokens a worker remembers before it starts a new table; the one before is kept beside it.
MEMORY = 120_000
SLICE = 1 << 20
#: New pre-tokens that the library encodes at a time.
ROW = 100
SCHEMA = ("shard int, block int, n_ids int, docs array<struct<doc_id:bigint,n:bigint>>, record binary")


class LibraryEncoder:
    """Texts to ids with the tokenizers library, each distinct pre-token once."""

    def __init__(self, spec: str):
        self.spec, self.library = spec, None

    def prepare(self) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, Split

        self.library = Tokenizer.from_str(self.spec)
        self.library.no_padding()
        self.library.no_truncation()
        if self.library.get_vocab_size(with_added_tokens=True) > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit into 16 bits")
        special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        whole = "|".join(map(re.escape, sorted(special, key=len, reverse=True)))
        # A special token is a piece of its own; the others are the library's own pre-tokens.
        self.patterns = [re.compile(pre_token_pattern(end)) for end in (0x110000, 0x100)]
        self.special = re.compile(f"({whole})") if whole else None
        self.apart = self.library.pre_tokenizer
        self.in_a_row = Sequence([Split(" ", "merged_with_next"), ByteLevel(add_prefix_space=False, use_regex=False)])
        # The ids whose bytes begin with a blank.
        self.opens = np.zeros(1 << 16, bool)
        self.opens[[i for t, i in self.library.get_vocab(with_added_tokens=False).items() if t.startswith("\u0120")]] = True
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
            pattern = self.patterns[1]
        except UnicodeEncodeError:
            pattern = self.patterns[0]
        if not (self.special and self.special.search(text)):
            return pattern.findall(text)
        out = []
        for k, part in enumerate(self.special.split(text)):
            out += [part] if k % 2 else pattern.findall(part)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """16-bit ids of each text, in a row."""
        if self.library is None:
            self.prepare()
        if len(self.known) >= MEMORY:
            self.known, self.older = {}, self.known
        cut = [self.cut(t) for t in texts]
        flat = list(chain.from_iterable(cut))
        found = list(map(self.known.get, flat))
        holes = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for piece in {flat[i] for i in holes}:
            if piece in self.older:
                self.known[piece] = self.older[piece]
            else:
                new.append(piece)
        self.meet(new)
        for i in holes:
            found[i] = self.known[flat[i]]
        ends = [0, *accumulate(map(len, cut))]
        return [b"".join(found[a:b]) for a, b in pairwise(ends)]

    def meet(self, pieces: list[str]) -> None:
        """Encode new pieces. Those with one blank, in front, go to the library in rows, which it
        cuts at the blanks; the id that begins with a blank begins a piece."""
        simple = [p for p in pieces if p.rfind(" ") == 0 and len(p) > 1]
        rows = [simple[i : i + ROW] for i in range(0, len(simple), ROW)]
        others = [p for p in pieces if p.rfind(" ") != 0 or len(p) == 1]
        self.library.pre_tokenizer = self.in_a_row
        coded = self.library.encode_batch_fast(["".join(r) for r in rows], add_special_tokens=False)
        for row, found in zip(rows, coded, strict=True):
            ids = np.array(found.ids, "<u2")
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) != len(row):  # a special token across pieces
                others += row
                continue
            data = ids.tobytes()
            self.known.update(zip(row, (data[a:b] for a, b in pairwise([*(2 * starts).tolist(), len(data)])), strict=True))
        self.library.pre_tokenizer = self.apart
        for piece, found in zip(others, self.library.encode_batch_fast(others, add_special_tokens=False), strict=True):
            self.known[piece] = np.array(found.ids, "<u2").tobytes()


def write(docs: DataFrame, tokenizer: str, path: str, doc_id: str = "doc_id", text: str = "text",
          end: int = END, block: int = BLOCK) -> None:
    """Encode documents and write their ids to `path` in ascending doc_id order."""
    with open(tokenizer, encoding="utf-8") as file:
        handle = share(docs.sparkSession, LibraryEncoder(file.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, shard = shared(handle), TaskContext.get().partitionId()
        waiting: list[bytes] = []  # ids that aren't coded yet
        begun: list[tuple[int | None, int, int]] = []  # doc_id, ids, place
        held = coded = 0  # ids waiting, and ids before them
        last = np.array([end], "<u2").tobytes()

        def flush(n: int) -> pa.RecordBatch:
            nonlocal held, coded, begun
            ids = np.frombuffer(b"".join(waiting), "<u2")
            now, rest = ids[:n], ids[n:]
            waiting[:] = [rest.tobytes()]
            blocks = [now[i : i + block] for i in range(0, n, block)]
            inside: list[list] = [[] for _ in blocks]
            for d, length, place in begun:
                if place < coded + n:
                    inside[(place - coded) // block].append({"doc_id": d, "n": length})
            begun = [b for b in begun if b[2] >= coded + n]
            first = coded // block
            held, coded = held - n, coded + n
            return pa.RecordBatch.from_arrays([
                pa.array([shard] * len(blocks), pa.int32()), pa.array(range(first, first + len(blocks)), pa.int32()),
                pa.array([len(b) for b in blocks], pa.int32()),
                pa.array(inside, pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64())]))),
                pa.array(range_coder.encode(blocks), pa.binary()),
            ], ["shard", "block", "n_ids", "docs", "record"])

        for whole in batches:
            width = np.asarray(pc.fill_null(pc.binary_length(whole.column(1)), 0), np.int64)
            for a, b in pieces(np.concatenate(([0], np.cumsum(width))), SLICE):
                part = whole.slice(a, b - a)
                texts = [t or "" for t in part.column(1).to_pylist()]
                for d, ids in zip(part.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    n = len(ids) // 2 + 1
                    begun.append((d, n, coded + held))
                    waiting += [ids, last]
                    held += n
                while held >= LANES * block:
                    yield flush(LANES * block)
        if held:
            yield flush(held)

    (
        docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, SCHEMA).write.parquet(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens, ids_crc32 and ids of every document."""
    files = spark.read.schema(SCHEMA).parquet(path)
    sizes = files.groupBy("shard").agg(F.sum("n_ids").alias("size"))  # a row for each file
    before = F.sum("size").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("shard", F.coalesce(before, F.lit(0)).alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, at, open_docs, parts, have = None, 0, [], [], 0
        for batch in batches:
            for a in range(0, batch.num_rows, LANES):
                rows = batch.slice(a, LANES)
                decoded = range_coder.decode(rows.column(3).to_pylist())
                out: list[tuple] = []
                for own, docs, ids in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), decoded, strict=True):
                    if own != shard:
                        shard, at, open_docs, parts, have = own, 0, [], [], 0
                    open_docs += [(d["doc_id"], d["n"]) for d in docs]
                    parts.append(ids)
                    have += len(ids)
                    if have < open_docs[0][1]:
                        continue  # a document that goes on in the next block
                    whole, place = np.concatenate(parts), 0
                    done = 0
                    while done < len(open_docs) and place + open_docs[done][1] <= len(whole):
                        d, n = open_docs[done]
                        own_ids = whole[place : place + n]
                        out.append((shard, d, at, n, range_coder.crc(own_ids), own_ids))
                        place, at, done = place + n, at + n, done + 1
                    open_docs = open_docs[done:]
                    parts, have = [whole[place:]], len(whole) - place
                columns = list(zip(*out, strict=True)) or [[]] * 6
                ids = columns[5]
                ends = np.concatenate(([0], np.cumsum([len(x) for x in ids])))
                flat = np.concatenate([np.zeros(0, np.uint16), *ids]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()),
                    pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)),
                ], ["shard", "doc_id", "at", "n_tokens", "ids_crc32", "ids"])

    decoded = (
        files.select("shard", "block", "docs", "record")
        .repartitionByRange("shard").sortWithinPartitions("shard", "block")
        .mapInArrow(run, "shard int, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>")
    )
    return decoded.join(F.broadcast(offsets), "shard").select(
        "doc_id", (F.col("offset") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "ids")
