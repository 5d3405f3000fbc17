"""Token counts from pre-token frequencies.

The pieces of a pre-token are counted once, not once per occurrence, and no id sequence is built. The
``hot`` most frequent pre-tokens, a fixed number, are counted first and go to every task as a table of a
known size. The other pre-tokens of a document go to the partition that owns them, by a hash. There a table of
the distinct ones, each counted once, is joined to the frequencies: a partition's rows come with its part of that
table first. Frequencies travel by the block: a block of documents sends one packed row to each owner and gets
one vector of sums back, so rows grow with blocks and not with documents times owners.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of, written
from .pretokens import Memo, shared_pretokenizer, tokenizer_json

HOT = 65_536
LIMIT = 2048
BLOCK = 1000
BLOCK_BYTES = 8_000_000
#: Names that a task passes on once while it remembers them.
KNOWN = 200_000


def frequent(docs: DataFrame, content: str, hot: int = HOT) -> dict[str, int]:
    """The most frequent pre-tokens over all documents and their pieces: at most ``hot`` entries."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = shared_pretokenizer(content)
        of, total = Memo(pre.of), Counter()
        for batch in batches:
            units = Counter()
            for text in batch.column(0).to_pylist():
                units.update(pre.units(text))
            for unit, n in units.items():
                for p in of(unit):
                    total[p] += n
            if len(total) > 8 * hot:  # what is rare here is left to the owners
                total = Counter(dict(total.most_common(4 * hot)))
        top = total.most_common(2 * hot)
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pretoken", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = shared_pretokenizer(content)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pre.pieces(p) for p in batch.column(0).to_pylist()], pa.int32())], ["pretoken", "pieces"])

    seen = docs.select(text_of().cast("binary").alias("text")).mapInArrow(tally, "pretoken string, n long")
    top = seen.groupBy("pretoken").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "pretoken").limit(hot)
    return {r[0]: r[1] for r in top.select("pretoken").repartition(4).mapInArrow(count, "pretoken string, pieces int").collect()}


def pack(rows: list[tuple[int, str, int]]) -> bytes:
    """rows: (index of the document in its block, pre-token, frequency), by pre-token."""
    names: dict[str, list[tuple[int, int]]] = {}
    for at, p, n in rows:
        names.setdefault(p, []).append((at, n))
    held = np.array([len(v) for v in names.values()], "<u4")
    pairs = np.array([x for v in names.values() for x in v], "<u4")
    head = "\x02".join(names).encode()
    return zstandard.ZstdCompressor(level=1).compress(np.array([len(names), len(head), len(pairs)], "<u4").tobytes() + held.tobytes() + pairs[:, 0].tobytes() + pairs[:, 1].tobytes() + head)


def unpack(blob: bytes) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    names, head, pairs = np.frombuffer(data, "<u4", 3).tolist()
    held = np.frombuffer(data, "<u4", names, 12)
    at = np.frombuffer(data, "<u4", pairs, 12 + 4 * names)
    n = np.frombuffer(data, "<u4", pairs, 12 + 4 * names + 4 * pairs)
    return data[len(data) - head :].decode().split("\x02"), held, at, n


def blocks(batches: Iterator[pa.RecordBatch], block: int = BLOCK, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, bytes]]]:
    """Documents in blocks of a bounded number and size (a longer document is a block of its own)."""
    held, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            for row in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                held.append(row)
                size += len(row[1])
                if len(held) >= block or size >= most:
                    yield held
                    held, size = [], 0
    if held:
        yield held


BLOCK_SCHEMA = "block long, owner int, ids array<long>, bytes array<long>, sums array<long>, packed binary"


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per row of docs.

    Null texts count as empty (0 tokens); null and repeated doc_ids are kept as they are, since nothing is
    joined on them. Added tokens' strings inside a text count as the library counts them. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    content = tokenizer_json(path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    shared = spark.sparkContext.broadcast((content, frequent(docs, content, hot)))
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        content, known = shared.value
        pre = shared_pretokenizer(content)
        of = Memo(pre.of)
        part = TaskContext.get().partitionId() << 33
        for k, docs_in in enumerate(blocks(batches)):
            ids, sizes, sums = [], [], []
            rare: dict[int, list[tuple[int, str, int]]] = {}
            for at, (doc_id, text) in enumerate(docs_in):
                total = 0
                unseen: dict[str, int] = {}
                for unit, n in Counter(pre.units(text)).items():
                    for p in of(unit):
                        c = known.get(p)
                        if c is None:
                            unseen[p] = unseen.get(p, 0) + n
                        else:
                            total += c * n
                for p, n in unseen.items():
                    rare.setdefault(zlib.crc32(p.encode()) % owners, []).append((at, p, n))
                ids.append(doc_id)
                sizes.append(len(text))
                sums.append(total)
            out = [(part + k, -1, ids, sizes, sums, None)]
            out += [(part + k, owner, None, None, None, pack(x)) for owner, x in rare.items()]
            schema = pa.schema([("block", pa.int64()), ("owner", pa.int32()), ("ids", pa.list_(pa.int64())), ("bytes", pa.list_(pa.int64())), ("sums", pa.list_(pa.int64())), ("packed", pa.binary())])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The pre-tokens of packed rows with their owners; most repeats within a task are left out."""
        met: set[str] = set()
        for batch in batches:
            for owner, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                names = [n for n in unpack(blob.as_py())[0] if n not in met]
                if len(met) + len(names) > KNOWN:
                    met.clear()
                met.update(names)
                yield pa.RecordBatch.from_arrays([pa.array([owner] * len(names), pa.int32()), pa.array(names, pa.string())], ["owner", "pretoken"])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pre = shared_pretokenizer(shared.value[0])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pre.pieces(p) for p in batch.column(1).to_pylist()], pa.int32())], ["owner", "pretoken", "pieces"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, pieces = None, {}  # rows come by owner, its distinct pre-tokens before its blocks
        for batch in batches:
            for at, name, n, block, blob in zip(*(batch.column(i) if i == 4 else batch.column(i).to_pylist() for i in range(5))):
                if at != owner:
                    owner, pieces = at, {}
                if name is not None:
                    pieces[name] = n
                    continue
                names, held, place, times = unpack(blob.as_py())
                counts = np.repeat(np.fromiter(map(pieces.__getitem__, names), np.int64, len(names)), held)
                got = np.bincount(place, weights=counts * times).astype(np.int64)  # exact below 2^53
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([got.tolist()], pa.list_(pa.int64()))], ["block", "sums"])

    packed = written(rows.mapInArrow(split, BLOCK_SCHEMA), "pretoken-blocks")
    rare = packed.where("owner >= 0").select("owner", "block", "packed")
    distinct = rare.select("owner", "packed").mapInArrow(named, "owner int, pretoken string").dropDuplicates()
    counts = distinct.mapInArrow(counted, "owner int, pretoken string, pieces int")
    joined = counts.select("owner", "pretoken", "pieces", F.lit(None).cast("long").alias("block"), F.lit(None).cast("binary").alias("packed")).unionByName(
        rare.select("owner", F.lit(None).cast("string").alias("pretoken"), F.lit(None).cast("int").alias("pieces"), "block", "packed"))
    back = joined.repartition(owners, "owner").sortWithinPartitions("owner", F.col("block").isNotNull()).mapInArrow(own, "block long, sums array<long>")

    def close(t: pa.Table) -> pa.Table:
        base = next(i for i, x in enumerate(t.column("ids").to_pylist()) if x is not None)
        ids, sizes = t.column("ids")[base].as_py(), t.column("bytes")[base].as_py()
        total = np.zeros(len(ids), np.int64)
        for x in t.column("sums"):
            values = np.array(x.as_py(), np.int64)
            total[: len(values)] += values
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(sizes, pa.int64()), "n_tokens": pa.array(total), "over_limit": pa.array(total > limit)})

    whole = packed.where("owner < 0").select("block", "ids", "bytes", "sums")
    parts = back.select("block", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("bytes"), "sums")
    return whole.unionByName(parts).groupBy("block").applyInArrow(close, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
