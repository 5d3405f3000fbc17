"""SimHash near-dedup with pigeonhole blocks.

A fingerprint of 64 bits is cut into ``BLOCKS`` blocks; two that differ in at most ``DISTANCE`` bits agree on
at least BLOCKS - DISTANCE whole blocks, so they share the key made of some choice of that many blocks.
Distinct fingerprints are joined on those keys; every pair in a key's bucket is verified by Hamming distance
and a bucket reports only a spanning forest of its links, never all pairs. Buckets of more than ``CHUNK``
fingerprints are dealt into chunks, and each pair of chunks is a group of its own, so no group grows with
the data.

near_components links texts by shingle similarity instead: fingerprints of the shingle sets, joined on the same
blocks, find the pairs within DISTANCE bits, bands of minima (minhash) those that 64 bits don't reach, and whole
shingle sets decide on both.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import minhash
from .common import discard, text_of, written
from .components import connected_components

SHINGLE = 3
SEED = 42
BLOCKS = 5
DISTANCE = 3
CHUNK = 1024


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of all word shingles, repeats included; 0 without words."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    h = xxhash.xxh64_intdigest
    if n <= shingle:
        return h(b" ".join(words), SEED)
    ones = np.zeros(64, np.int64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n)) + np.arange(n)
    starts = np.concatenate(([0], ends[:-1] + 1))[: n - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    m = len(starts)
    for at in range(0, m, 65536):
        hashes = np.fromiter([h(line[a:b], SEED) for a, b in zip(starts[at : at + 65536], ends[at : at + 65536])], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > m, bitorder="little").view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long): one row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.fromiter((fingerprint(x, shingle) for x in batch.column(1).to_pylist()), "<u8", batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view("<i8"))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = BLOCKS, distance: int = DISTANCE) -> list[int]:
    """One mask for each choice of blocks - distance blocks, as signed 64-bit numbers."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    of = [((1 << edges[i + 1]) - (1 << edges[i])) for i in range(blocks)]
    masks = [sum(of[i] for i in chosen) for chosen in combinations(range(blocks), blocks - distance)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def forest(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links of a spanning forest over distinct values, linked at no more than distance differing bits."""
    found: list[tuple[int, int]] = []
    left = values.view("<u8")
    while len(left) > 1:  # one tree at a time, by breadth-first search over what isn't reached yet
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                reached = left[near]
                left = left[~near]
                root = int(x.view("<i8"))
                found += [(root, int(y)) for y in reached.view("<i8")]
                queue += list(reached)
    return found


def bucket_links(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; at most two chunks' worth of one key is held."""
    held_key, held = None, []

    def close() -> list[tuple[int, int]]:
        values = np.unique(np.concatenate(held)) if held else np.empty(0, "<i8")
        return forest(values, distance)

    for batch in batches:
        keys = batch.select(["key", "mask", "lo", "hi"]).to_pandas().to_numpy()
        fps = batch.column("fp").to_numpy()
        if not len(fps):
            continue
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        found: list[tuple[int, int]] = []
        for at, to in zip([0, *cuts], [*cuts, len(fps)]):
            key = tuple(keys[at])
            if key != held_key:
                found += close()
                held_key, held = key, []
            held.append(fps[at:to])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
    found = close()
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])


def links(distinct: DataFrame, blocks: int = BLOCKS, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """distinct: fp, one row each. a, b: links whose components are those of all links."""
    masks = block_masks(blocks, distance)
    choices = F.explode(F.array(*[F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(masks)]))
    keyed = distinct.select("fp", choices.alias("k")).select("fp", "k.mask", "k.key")
    counts = keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(counts, ["mask", "key"])
    dealt = shared.withColumn("parts", F.ceil(F.col("n") / chunk).cast("int")).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    # A fingerprint meets those of every chunk of its bucket; the pair of chunks is the group.
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "mask", "key", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "fp")
    grouped = paired.repartition("mask", "key", "lo", "hi").sortWithinPartitions("mask", "key", "lo", "hi")
    return grouped.mapInArrow(lambda b: bucket_links(b, distance), "a long, b long")


def near_dedup(docs: DataFrame, shingle: int = SHINGLE, blocks: int = BLOCKS, distance: int = DISTANCE, chunk: int = CHUNK) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least doc_id reachable): one row per row of docs.

    Null and empty texts have fingerprint zero and link like any other; null doc_ids are passed over as
    component_id unless a component has no other. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    firsts = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    roots = connected_components(links(firsts.select("fp"), blocks, distance, chunk))
    # The component of a fingerprint that has no link is its own.
    rooted = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def print_links(drawn: DataFrame) -> DataFrame:
    """drawn: node, fp. a, b: nodes whose components are those of all nodes within DISTANCE bits of each other."""
    firsts = written(drawn.groupBy("fp").agg(F.min("node").alias("first")), "near-fingerprints")
    of = lambda c, name: firsts.select(F.col("fp").alias(c), F.col("first").alias(name))
    apart = links(firsts.select("fp")).join(of("a", "x"), "a").join(of("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    out = written(apart.unionByName(drawn.join(firsts, "fp").where("node <> first").select(F.col("node").alias("a"), F.col("first").alias("b"))), "near-links")
    discard(firsts)
    return out


def near_components(docs: DataFrame) -> DataFrame:
    """node, root: the component of each distinct text that has a near copy of another text; other texts don't appear.

    Candidates are the pairs within DISTANCE bits, all of them, and those that share a band of minima. Null texts count
    as empty; a text of fewer words than a shingle is one shingle. An empty table gives no rows.
    """
    drawn = written(minhash.sketches(docs, majority).dropDuplicates(["node"]), "near-sketches")
    close = print_links(drawn.select("node", "fp"))
    keyed = drawn.select("node", F.col("sketch").alias("value"), F.posexplode("bands").alias("band", "key"))
    further = minhash.grouped_links(keyed, ["band", "key"], minhash.BUCKET_CHUNK, minhash.sketch_links)
    coarse = written(connected_components(close.unionByName(further)), "near-groups")
    discard(drawn)
    discard(close)
    texts = docs.select(minhash.node_of().alias("node"), text_of().cast("binary").alias("text")).join(coarse, "node").select("root", "node", "text")
    sets = written(minhash.shingle_sets(texts).dropDuplicates(["node"]), "near-sets")
    out = written(connected_components(minhash.grouped_links(sets, ["root"], minhash.GROUP_CHUNK, minhash.set_links)), "near-components")
    discard(coarse)
    discard(sets)
    return out


def keep_representatives(docs: DataFrame) -> DataFrame:
    """One row of docs for each group of near copies, with all columns whatever their names.

    Texts are linked at a similarity of 0.8 or more of their sets of five-word shingles (near_components). The row of the least doc_id stays, null ids last; then by text, then by the
    other columns. Null texts count as empty, empty texts are one group, equal texts are near copies. An empty table
    gives no rows.
    """
    key = ["none", "id", "node"]
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), minhash.node_of().alias("node"), F.xxhash64("*").alias("draw"))
    # A text without a near copy is a component of its own; rows of equal text share it.
    rooted = keyed.select(*key).join(near_components(docs), "node", "left").withColumn("root", F.coalesce("root", "node"))
    first = written(rooted.groupBy("root").agg(F.min(F.struct(*key)).alias("first")).select("first.*"), "near-copies")
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("draw"))
    return keyed.join(first, key, "left_semi").withColumn("nth", nth).where("nth = 1").select("row.*")
