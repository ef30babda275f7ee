"""Token counts: a separator scan over flat, unindexed token files.

Tokens lie in flat files as little-endian integers, documents end in an end-of-document identifier, and nothing says
where. Blocks of a file are searched for the identifier all at once; a prefix scan over the blocks' sizes and last
separators, in file order, stitches the documents that cross block borders. Tokens after a file's last separator are
an open document, with ``closed`` false.

``token_blocks`` writes such files from texts, with the names of the documents that end in each block (only used to name
the scan's counts). Rows: null and empty texts have 0 tokens; repeated rows are separate documents; a null id stays
null; texts may be of any length; bytes after a flat file's last whole token are passed over; further columns, of any names,
are left out; an empty table gives an empty result. Tokenizers come from files whose path is a parameter.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heliograph.llm.common import materialize, table

#: Ranks of a byte-level BPE of 50,256 tokens, read on the driver and sent along; the next id is free.
RANKS, SEPARATOR, DTYPE = "/opt/tokenizers/byte_bpe_50k.tiktoken", 50_256, "<u2"
#: Tokens a block, and blocks of a flat file that a task reads at a time.
BLOCK, RANGE = 1 << 16, 512
# Fixed value: the public pattern by which byte-level BPE splits text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_encoders: dict = {}


def ranks_of(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encoder(ranks: bytes):
    """One a Python worker."""
    key = hashlib.sha256(ranks).digest()
    if key not in _encoders:
        import tiktoken

        merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})
    return _encoders[key]


def token_blocks(docs: DataFrame, id: str = "doc_id", text: str = "text", ranks: str = RANKS, separator: int = SEPARATOR, dtype: str = DTYPE, block: int = BLOCK) -> DataFrame:
    """file, block, payload (zstd), tokens, names: a flat token file for each partition, in blocks."""
    kind, shared = dict(docs.dtypes)[id], docs.sparkSession.sparkContext.broadcast(ranks_of(ranks))  # a vocabulary: about a megabyte

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        no, enc = TaskContext.get().partitionId(), encoder(shared.value)
        held, size, names, at = [], 0, [], 0  # names: (place of the separator in what is held, id)

        def cut(n: int):
            nonlocal held, size, names, at
            flat = np.concatenate(held)
            here = [i for p, i in names if p < n]
            data = flat[:n].astype(dtype).tobytes()
            out = pa.RecordBatch.from_arrays(
                [pa.array([no], pa.int64()), pa.array([at], pa.int64()), pa.array([pa.compress(data, codec="zstd", asbytes=True)], pa.binary()), pa.array([n], pa.int64()), pa.array([here], pa.list_(kind_type))],
                names=["file", "block", "payload", "tokens", "names"],
            )
            held, size, names, at = [flat[n:]], len(flat) - n, [(p - n, i) for p, i in names if p >= n], at + 1
            return out

        kind_type = None
        for b in batches:
            kind_type = b.schema.field(0).type
            ids = b.column(0).to_pylist()
            for k, t in enumerate(b.column(1)):
                tokens = enc.encode_ordinary(t.as_py() or "")
                held.append(np.array(tokens + [separator], np.int64))
                size += len(tokens) + 1
                names.append((size - 1, ids[k]))
                while size >= block:
                    yield cut(block)
        if size:
            yield cut(size)

    return docs.select(id, text).mapInArrow(run, f"file long, block long, payload binary, tokens long, names array<{kind}>")


def read_flat(spark, path: str, dtype: str = DTYPE, block: int = BLOCK) -> DataFrame:
    """Blocks of flat token files under ``path``, of any size: tasks read stretches of RANGE blocks; documents have no names there.

    Files are listed by Spark, without their contents; the file system must be one that pyarrow opens, too.
    """
    size = np.dtype(dtype).itemsize
    step = block * size
    files = spark.read.format("binaryFile").load(path).select("path", "length").filter("length > 0")
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("length") - 1) / (step * RANGE)))).alias("range")).repartition("path", "range")

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for p, length, k in zip(*(b.column(c).to_pylist() for c in ("path", "length", "range"))):
                system, at = fs.FileSystem.from_uri(p.replace("file:/", "file:///", 1) if p.startswith("file:/") and not p.startswith("file://") else p)
                with system.open_input_file(at) as f:
                    f.seek(k * RANGE * step)
                    for n in range(k * RANGE, min((k + 1) * RANGE, -(-length // step))):
                        part = f.read(min(step, length - n * step))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([p]), pa.array([n], pa.int64()), pa.array([pa.compress(part[: len(part) // size * size], codec="zstd", asbytes=True)], pa.binary()), pa.array([len(part) // size], pa.int64()), pa.array([None], pa.list_(pa.string()))],
                            names=["file", "block", "payload", "tokens", "names"],
                        )

    return ranges.mapInArrow(run, "file string, block long, payload binary, tokens long, names array<string>")


def scan_separators(blocks: DataFrame, separator: int = SEPARATOR, dtype: str = DTYPE) -> DataFrame:
    """file, seq, name, n_tokens, closed: a row a document, in file order by seq."""
    size = np.dtype(dtype).itemsize
    types = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            inner, first, last = [], [], []
            for payload, n in zip(b.column("payload"), b.column("tokens").to_pylist()):
                x = np.frombuffer(pa.decompress(payload.as_py(), decompressed_size=n * size, codec="zstd", asbytes=True), dtype)
                hits = np.flatnonzero(x == separator)
                first.append(int(hits[0]) if len(hits) else None)
                last.append(int(hits[-1]) if len(hits) else None)
                inner.append((np.diff(hits) - 1).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("file"), b.column("block"), b.column("tokens"), b.column("names"), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(inner, pa.list_(pa.int64()))],
                names=["file", "block", "tokens", "names", "first", "last", "inner"],
            )

    found = blocks.select("file", "block", "payload", "tokens", "names").mapInArrow(run, f"file {types['file']}, block long, tokens long, names {types['names']}, first long, last long, inner array<long>")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("file").orderBy("block")
    based = found.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    based = based.withColumn("open", F.col("base") - F.coalesce(F.max(F.col("base") + F.col("last")).over(before) + 1, F.lit(0)))
    ends = F.when(F.col("first").isNotNull(), F.concat(F.array(F.col("open") + F.col("first")), "inner")).otherwise(F.array().cast("array<long>"))
    based = based.withColumn("ends", ends).withColumn("seq0", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)))
    tail = F.when(F.col("first").isNull(), F.col("open") + F.col("tokens")).otherwise(F.col("tokens") - F.col("last") - 1)
    based = based.withColumn("tail", F.when(F.lead("block").over(here).isNull() & (tail > 0), tail))
    every = F.concat(
        F.transform("ends", lambda n, i: F.struct((F.col("seq0") + i).alias("seq"), F.get("names", i).alias("name"), n.alias("n_tokens"), F.lit(True).alias("closed"))),
        F.when(F.col("tail").isNotNull(), F.array(F.struct((F.col("seq0") + F.size("ends")).alias("seq"), F.get("names", F.size("ends")).alias("name"), F.col("tail").alias("n_tokens"), F.lit(False).alias("closed")))).otherwise(F.array()),
    )
    return based.select("file", F.inline(every))


def op10(spark, sf_dir: str) -> DataFrame:
    blocks = materialize(token_blocks(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return scan_separators(blocks).select(F.col("name").alias("doc_id"), "n_tokens")
