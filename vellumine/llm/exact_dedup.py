"""Exact dedup by a minimal perfect hash over historical distinct digests.

History (an earlier corpus, or a fixed half of the present one) gives one row per distinct SHA-256
digest. The digests fall into buckets by their leading bits; each bucket of about ``BUCKET`` digests
gets a perfect hash by hash-and-displace: a group of a few digests takes the first seed that sends all
of them to free places of a somewhat larger array, and the rank among the places taken makes it minimal.
Groups of one size, of all buckets that a task holds at a time, try their next seeds together. A slot holds
the whole digest and the locator (doc_id) of the history's winner, so a lookup is a seed fetch, one rank, one
slot and a comparison of all 32 bytes. Digests that aren't in the slot found are no members and group on
their own.

Every side is one row per distinct digest before it is shuffled, so a text with millions of copies
costs a task no more than any other.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, text_of, written

BUCKET = 128
GROUP = 4  # digests that share a seed, on average
#: Places a digest, before ranks close the gaps.
ROOM = 1.25
#: A task hashes whole buckets of about so many digests at a time.
AT_ONCE = 32_768


def groups_in(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, -(-n // GROUP))


def places_in(n: np.ndarray) -> np.ndarray:
    return np.ceil(n * ROOM).astype(np.int64) + 1


def place_of(words: np.ndarray, seeds: np.ndarray, places: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (words[..., 2] ^ (seeds.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        x = (x + words[..., 3]) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(32)
    return (x % places.astype(np.uint64)).astype(np.int64)


def displace(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seeds of all groups, place of each digest, and which places are taken; bucket after bucket.

    words: digests as four numbers each, ordered by bucket and distinct within one; sizes: digests by bucket.
    """
    groups, places = groups_in(sizes), places_in(sizes)
    first_group, first_place = np.cumsum(groups) - groups, np.cumsum(places) - places
    bucket = np.repeat(np.arange(len(sizes)), sizes)
    group = first_group[bucket] + (words[:, 1] % groups[bucket].astype(np.uint64)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    starts = np.searchsorted(group[order], np.arange(groups.sum() + 1))
    held = np.diff(starts)
    seeds, at, free = np.zeros(len(held), "<u4"), np.zeros(len(words), np.int64), np.ones(places.sum(), bool)
    for size in range(int(held.max(initial=0)), 0, -1):
        live = np.flatnonzero(held == size)
        members = order[starts[live][:, None] + np.arange(size)]
        while len(live):
            b = bucket[members]
            tried = first_place[b] + place_of(words[members], seeds[live][:, None], places[b])
            ordered = np.sort(tried, axis=1)
            good = free[tried].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
            # Of groups that want one place, the first takes it.
            taker = np.full(len(free), len(live), np.int64)
            rows = np.flatnonzero(good)
            np.minimum.at(taker, tried[rows].ravel(), np.repeat(rows, size))
            won = good & (taker[tried] == np.arange(len(live))[:, None]).all(axis=1)
            at[members[won]] = tried[won]
            free[tried[won]] = False
            seeds[live[~won]] += 1
            live, members = live[~won], members[~won]
    return seeds, at, ~free


def build_buckets(buckets: np.ndarray, digests: np.ndarray, winners: np.ndarray, known: np.ndarray) -> Iterator[dict]:
    """One index row per bucket. buckets: sorted; digests: rows of 32 bytes; winners: locators where known."""
    words = np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)
    names, sizes = np.unique(buckets, return_counts=True)
    seeds, at, taken = displace(words, sizes)
    order = np.argsort(at)  # by bucket, then by place: the rank
    group_ends, place_ends, ends = np.cumsum(groups_in(sizes)), np.cumsum(places_in(sizes)), np.cumsum(sizes)
    for i, name in enumerate(names.tolist()):
        mine = order[ends[i] - sizes[i] : ends[i]]
        yield {
            "bucket": name, "seeds": seeds[group_ends[i - 1] if i else 0 : group_ends[i]].tobytes(), "taken": np.packbits(taken[place_ends[i - 1] if i else 0 : place_ends[i]]).tobytes(),
            "digests": digests[mine].tobytes(), "winners": winners[mine].astype("<i8").tobytes(), "known": known[mine].astype("u1").tobytes(),
        }


def build_bucket(bucket: int, digests: list[bytes], winners: list[int | None]) -> dict:
    array = np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)
    return next(build_buckets(np.full(len(digests), bucket), array, np.array([w or 0 for w in winners]), np.array([w is not None for w in winners])))


def probe(index: dict, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """asked: rows of 32 bytes. Whether the slot that each points at holds the same bytes, that slot's winner, and whether it is known."""
    seeds = np.frombuffer(index["seeds"], "<u4")
    held = np.frombuffer(index["digests"], np.uint8).reshape(-1, 32)
    places = places_in(np.array([len(held)]))
    taken = np.unpackbits(np.frombuffer(index["taken"], np.uint8), count=int(places[0]))
    words = np.ascontiguousarray(asked).view("<u8").reshape(-1, 4)
    at = place_of(words, seeds[(words[:, 1] % np.uint64(len(seeds))).astype(np.int64)], places)
    slot = np.maximum(np.cumsum(taken, dtype=np.int64)[at] - 1, 0)
    same = taken[at].astype(bool) & (held[slot] == asked).all(axis=1)
    return same, np.frombuffer(index["winners"], "<i8")[slot], np.frombuffer(index["known"], "u1")[slot].astype(bool)


def look_up(index: dict | None, digests: list[bytes]) -> list[tuple[bool, int | None]]:
    """For each digest, whether it is a member, and its slot's winner."""
    if index is None or not digests:
        return [(False, None)] * len(digests)
    same, winners, known = probe(index, np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32))
    return [(bool(s), int(w) if s and k else None) for s, w, k in zip(same, winners, known)]


def with_digest(docs: DataFrame) -> DataFrame:
    """doc_id and the digest of the text (null: empty), nothing else."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest"))


def distinct_digests(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("winner"), F.count(F.lit(1)).alias("n"))


def bucket_of(buckets: int) -> Column:
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 6)), 16, 10).cast("long"), F.lit(buckets)).cast("int")


INDEX = "bucket int, seeds binary, taken binary, digests binary, winners binary, known binary"


def byte_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def build_index(history: DataFrame, buckets: int) -> DataFrame:
    """history: digest, winner (one row per digest). One row per bucket: seeds, places taken, digests and winners by slot."""
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows: pa.Table) -> pa.RecordBatch:
            winner = rows.column("winner").combine_chunks()
            made = list(build_buckets(rows.column("bucket").to_numpy(), byte_rows(rows.column("digest")), winner.fill_null(0).to_numpy(zero_copy_only=False), winner.is_valid().to_numpy(zero_copy_only=False)))
            return pa.RecordBatch.from_arrays([pa.array([m[k] for m in made], pa.int32() if k == "bucket" else pa.binary()) for k in names], names)

        held: pa.Table | None = None  # rows come by bucket; the last one may go on in the next batch
        for batch in batches:
            more = pa.Table.from_batches([batch])
            held = more if held is None else pa.concat_tables([held, more])
            if held.num_rows >= AT_ONCE:
                of = held.column("bucket").to_numpy()
                cut = int(np.searchsorted(of, of[-1]))
                if cut:
                    yield close(held.slice(0, cut))
                    held = held.slice(cut)
        if held is not None and held.num_rows:
            yield close(held)

    rows = history.select(bucket_of(buckets).alias("bucket"), "digest", "winner")
    return rows.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, INDEX)


def member_rows(index: DataFrame, asked: DataFrame, buckets: int) -> DataFrame:
    """asked: digest, winner, n (one row per digest). Adds member (byte-checked) and the slot's winner, held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict | None = None  # rows come by bucket, its index first
        for batch in batches:
            of, ask = batch.column("bucket").to_numpy(), batch.column("digest").is_valid().to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((of[1:] != of[:-1]) | (ask[1:] != ask[:-1])) + 1
            for at, to in zip([0, *cuts.tolist()], [*cuts.tolist(), len(of)]) if len(of) else ():
                if not ask[at]:
                    held = {"bucket": int(of[at])} | {k: batch.column(k)[at].as_py() for k in ("seeds", "taken", "digests", "winners", "known")}
                    continue
                digests = batch.column("digest").slice(at, to - at)
                same, winner, known = np.zeros(to - at, bool), np.zeros(to - at, np.int64), np.zeros(to - at, bool)
                if held is not None and held["bucket"] == of[at]:
                    same, winner, known = probe(held, byte_rows(digests))
                yield pa.RecordBatch.from_arrays([digests, batch.column("winner").slice(at, to - at), batch.column("n").slice(at, to - at), pa.array(same), pa.array(winner, mask=~(same & known))], ["digest", "winner", "n", "member", "held"])

    rows = asked.select(bucket_of(buckets).alias("bucket"), "digest", "winner", "n").unionByName(index, allowMissingColumns=True)
    ordered = rows.repartition("bucket").sortWithinPartitions("bucket", F.col("digest").isNotNull())
    return ordered.mapInArrow(run, "digest binary, winner long, n long, member boolean, held long")


def groups(docs: DataFrame, is_history: Column | None = None) -> DataFrame:
    """One row per distinct text: digest, keep_id (its largest doc_id, null if all are null), group_size.

    is_history: a condition over doc_id that marks the earlier rows; even ids where none is given.
    """
    condition = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(2)) == 0 if is_history is None else is_history
    sides = (
        with_digest(docs).groupBy("digest")
        .agg(
            F.max(F.when(condition, F.col("doc_id"))).alias("old_winner"), F.count_if(condition).alias("old_n"),
            F.max(F.when(~condition, F.col("doc_id"))).alias("winner"), F.count_if(~condition).alias("n"),
        )
    )
    sides = written(sides, "digests")
    history = sides.where("old_n > 0").select("digest", F.col("old_winner").alias("winner"), F.col("old_n").alias("n"))
    buckets = max(1, math.ceil(history.count() / BUCKET))
    index = written(build_index(history, buckets), "perfect-hash")
    asked = written(member_rows(index, sides.where("n > 0").select("digest", "winner", "n"), buckets), "looked-up")
    # Members join the group of the slot that holds their digest; the rest are groups of their own.
    every = history.select("digest", "winner", "n").unionByName(asked.where("member").select("digest", F.greatest("winner", "held").alias("winner"), "n"))
    known = every.groupBy("digest").agg(F.max("winner").alias("keep_id"), F.sum("n").alias("group_size"))
    out = written(known.unionByName(asked.where("not member").select("digest", F.col("winner").alias("keep_id"), F.col("n").alias("group_size"))), "copies")
    for used in (asked, index, sides):
        discard(used)
    return out


#: Rows that agree in id and text are written out so many at a time.
REPEATS = 4096


def exact_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of docs.

    Null texts count as empty; of equal texts the largest doc_id stays (null ids are smaller than any).
    Where a row repeats the winner's doc_id and text, exactly one of them is kept. An empty table gives no rows.
    """
    rows = with_digest(docs).groupBy("digest", "doc_id").agg(F.count(F.lit(1)).alias("times"))
    joined = rows.join(groups(docs), "digest")
    parts = joined.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATS))))
    first = F.col("part") * REPEATS + 1
    each = parts.withColumn("nth", F.explode(F.sequence(first, F.least(F.col("times"), first + REPEATS - 1))))
    return each.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_winners(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact dedup keeps, with all columns of docs, whatever their names.

    Nulls, ties and repeats as in exact_dedup: of rows that agree in doc_id and text any one stays. An empty table gives no rows.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.unhex(F.sha2(text_of().cast("binary"), 256)).alias("digest"))
    same = lambda a, b: (F.col(f"{a}.digest") == F.col(f"{b}.digest")) & F.col(f"{a}.id").eqNullSafe(F.col(f"{b}.id"))
    winners = groups(docs).select("digest", F.col("keep_id").alias("id")).alias("w")
    again = with_digest(docs).groupBy("digest", "doc_id").count().where("count > 1").select("digest", F.col("doc_id").alias("id")).alias("a")
    left = rows.alias("r").join(winners, same("r", "w"), "left_semi").alias("l")
    once = left.join(again, same("l", "a"), "left_anti")
    repeated = left.join(again, same("l", "a"), "left_semi").dropDuplicates(["id", "digest"])
    return once.unionByName(repeated).select("row.*")
