"""Near copies by shingle similarity, for simhash.near_components: bands of minima add to its candidates, whole shingle sets decide.

Pairs of similarity 0.8 differ in ten of 64 SimHash bits on average, and no choice of pigeonhole blocks finds those
without comparing a large share of all pairs; so blocks of minima find what blocks of bits don't reach.

Two texts are linked where the Jaccard similarity of their sets of five-word shingles is at least
``SIMILARITY``. Texts that agree on a whole band of ``ROWS`` minima meet in a bucket; there a sketch of one
byte per minimum drops pairs that are clearly apart, and the rest make coarse groups. Within a coarse group
similarities are taken from the sets themselves. Buckets and groups report only a spanning forest of their
links, never all pairs; those beyond a chunk are dealt into pairs of chunks, so no task grows with the data.
A pair of similarity 0.8 shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, below 1 in 10,000.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 24
ROWS = 5
#: Share of equal sketch bytes below which a pair is not looked at further: four deviations below SIMILARITY.
COARSE = 0.65
BUCKET_CHUNK = 8192
GROUP_CHUNK = 1024
SEED = 42

_RANDOM = np.random.default_rng(SEED)
_FACTORS = _RANDOM.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _RANDOM.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted XXH64 of the distinct word shingles; a text of fewer words is one shingle."""
    words = text.lower().split()
    n = max(1, len(words) - shingle + 1)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(n)), "<u8", n))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        mixed = hashes[at : at + 4096, None] * _FACTORS + _SHIFTS
        out = np.minimum(out, (mixed ^ mixed >> np.uint64(29)).min(axis=0))
    return out


def sketches(docs: DataFrame, fingerprint: Callable[[np.ndarray], int]) -> DataFrame:
    """node, fp (fingerprint() of the shingle set, as a signed long), bands (a hash per band), sketch (a byte per minimum): one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                prints, bands, bytes_ = [], [], []
                for text in batch.column(1).to_pylist():
                    hashes = shingle_set(text)
                    m = minima(hashes)
                    prints.append(fingerprint(hashes))
                    bands.append([xxhash.xxh64_intdigest(r.tobytes(), SEED) - (1 << 63) for r in m.reshape(BANDS, ROWS)])
                    bytes_.append((m * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, "<u8").view("<i8")), pa.array(bands, pa.list_(pa.int64())), pa.array(bytes_, pa.binary())], ["node", "fp", "bands", "sketch"])

    return docs.select(node_of().alias("node"), text_of().cast("binary").alias("text")).mapInArrow(run, "node long, fp long, bands array<long>, sketch binary")


def node_of():
    """Equal texts are one node."""
    return F.xxhash64(text_of())


def forest(nodes: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links of a spanning forest; near(i, left) tells which of the places left are linked to place i."""
    found: list[tuple[int, int]] = []
    left = np.arange(len(nodes))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        root = int(nodes[queue[0]])
        while queue and len(left):
            hit = near(queue.pop(), left)
            found += [(root, int(nodes[y])) for y in left[hit]]
            queue += list(left[hit])
            left = left[~hit]
    return found


def sketch_links(nodes: np.ndarray, values: list[bytes]) -> list[tuple[int, int]]:
    m = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)
    return forest(nodes, lambda i, left: (m[left] == m[i]).mean(axis=1) >= COARSE)


def set_links(nodes: np.ndarray, values: list[bytes]) -> list[tuple[int, int]]:
    sets = [np.frombuffer(v, "<u8") for v in values]
    sizes = np.array([len(s) for s in sets])

    def near(i: int, left: np.ndarray) -> np.ndarray:
        hit = np.minimum(sizes[left], sizes[i]) >= SIMILARITY * np.maximum(sizes[left], sizes[i])
        for k in np.flatnonzero(hit):
            other = sets[left[k]]
            at = np.searchsorted(sets[i], other)
            both = int((sets[i][np.minimum(at, sizes[i] - 1)] == other).sum())
            hit[k] = both >= SIMILARITY * (sizes[i] + len(other) - both) - 1e-9
        return hit

    return forest(nodes, near)


def grouped_links(rows: DataFrame, by: list[str], chunk: int, links: Callable) -> DataFrame:
    """rows: by, node, value. a, b: a spanning forest of what links() finds between any two rows of a group."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    dealt = rows.join(counts, by).withColumn("parts", F.ceil(F.col("n") / chunk).cast("int")).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # A row meets those of every chunk of its group; the pair of chunks is the unit of work.
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        *by, F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "value")
    unit = [*by, "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_key, nodes, values = None, [], []

        def close() -> pa.RecordBatch:
            first = np.unique(np.array(nodes, "<i8"), return_index=True)[1]
            found = links(np.array(nodes, "<i8")[first], [values[i] for i in first]) if len(first) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])

        for batch in batches:
            for *key, node, value in zip(*(batch.column(c).to_pylist() for c in [*unit, "node", "value"])):
                if key != held_key:
                    if len(nodes) > 1:
                        yield close()
                    held_key, nodes, values = key, [], []
                nodes.append(node)
                values.append(value)
        if len(nodes) > 1:
            yield close()

    return paired.repartition(*unit).sortWithinPartitions(*unit).mapInArrow(run, "a long, b long")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """rows: root, node, text. root, node, value: the bytes of the shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                values = [shingle_set(t).tobytes() for t in batch.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.binary())], ["root", "node", "value"])

    return rows.mapInArrow(run, "root long, node long, value binary")
