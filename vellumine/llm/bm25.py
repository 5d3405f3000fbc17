"""Exact top-k BM25 over a sharded inverted index, with block-max WAND pruning.

Documents are indexed where they are read: a task turns a bounded number of tokens into one shard, a compressed
row of a table in the shared folder that holds the shard's terms, postings and lengths. Document frequencies and
lengths are summed over all shards, so that every shard scores with the same statistics and the merged lists are
exact.

Queries come in blocks of a bounded number of terms; a block goes to every shard. A shard's documents lie in runs
of ``RUN``, sorted by their commonest word and length, so that a run's documents are alike. Each long list has the
maximum of its contributions in each run; lists with hardly a posting a run are their own maxima and are added up as
they are. The sum of a query's maxima in a run bounds all scores there. First the runs of the highest bounds are
scored, which sets the threshold (the k-th best score so far, carried from shard to shard in a task). Then a cursor
goes through the runs in document order: the pivot is the next run whose bound reaches the threshold, everything
before it is passed over unscored, and the pivot's documents are scored in full, which may raise the threshold.
Some hundred queries go through a shard together, so that a run is scored by one matrix product for all queries whose
pivot it is; that product is of single precision with a margin for its error, and what it finds is summed up anew.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, text_of, written

K1, B = 1.2, 0.75
TOP = 10
#: A shard ends at so many tokens or documents.
SHARD_TOKENS = 5_000_000
SHARD_DOCS = 20_000
RUN = 64
#: Lists longer than this share of a shard's documents (and than one run) are bounded instead of added up, the longest
#: first, as many as a table of so many numbers holds.
LONG = 1 / 32
DENSE = 12_000_000
#: Runs that set a query's threshold in a shard.
STEP = 8
#: Queries that go through a shard together: so many, and no more than a table of so many sums holds.
QUERIES = 256
SUMS = 3_000_000
#: Scores count to nine decimals; a bound below the threshold by more than this can't reach it.
SLACK = 2e-9
#: A block of queries holds about so many (query, term) pairs.
BLOCK_TERMS = 1_000_000
_KEEP = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def tokens(text: str) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters, in UTF-8."""
    return text.lower().encode("utf-8", "replace").translate(_KEEP).split()


SHARD_SCHEMA = "docs long, tokens long, shard binary"
_PARTS = ("ids", "known", "lengths", "terms", "starts", "places", "counts")


def packed(parts: dict[str, bytes]) -> bytes:
    sizes = np.array([len(parts[k]) for k in _PARTS], "<u4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(sizes + b"".join([parts[k] for k in _PARTS]))


def unpacked(blob: bytes) -> dict[str, memoryview]:
    data = memoryview(zstandard.ZstdDecompressor().decompress(blob))
    ends = 4 * len(_PARTS) + np.cumsum(np.frombuffer(data, "<u4", len(_PARTS)).astype(np.int64))
    return {k: data[a:z] for k, a, z in zip(_PARTS, [4 * len(_PARTS), *ends], ends)}


class Builder:
    def __init__(self):
        self.term: dict[bytes, int] = {}
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.rows: list[np.ndarray] = []
        self.common: list[int] = []
        self.size = 0

    def add(self, doc_id: int | None, text: str) -> None:
        held = Counter(tokens(text))
        term = self.term
        at = np.fromiter([term.setdefault(t, len(term)) for t in held], "<u4", len(held))
        self.rows.append(np.stack([at, np.fromiter(held.values(), "<u4", len(held))]))
        self.ids.append(doc_id)
        n = held.total()
        self.common.append(int(at[int(self.rows[-1][1].argmax())]) if n else -1)
        self.lengths.append(n)
        self.size += n

    def row(self) -> list:
        n = len(self.ids)
        place = np.empty(n, "<u4")
        by = np.lexsort((self.lengths, self.common))
        place[by] = np.arange(n)
        doc = np.repeat(place, [r.shape[1] for r in self.rows])
        pairs = np.concatenate(self.rows, axis=1) if self.rows else np.zeros((2, 0), "<u4")
        self.rows = []
        order = np.argsort(pairs[0], kind="stable")
        starts = np.zeros(len(self.term) + 1, "<u4")
        starts[1:] = np.cumsum(np.bincount(pairs[0], minlength=len(self.term)))
        ids = np.array([i or 0 for i in self.ids], "<i8")[by]
        known = np.array([i is not None for i in self.ids], "u1")[by]
        return [n, self.size, packed({
            "ids": ids.tobytes(), "known": known.tobytes(), "lengths": np.array(self.lengths, "<u4")[by].tobytes(), "terms": b" ".join(self.term),
            "starts": starts.tobytes(), "places": doc[order].tobytes(), "counts": pairs[1][order].tobytes(),
        })]


def build_index(docs: DataFrame, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """One row per shard, written to the shared folder; every row of docs is indexed."""
    names = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(b: Builder) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], pa.int64() if i < 2 else pa.binary()) for i, v in enumerate(b.row())], names)

        held = Builder()
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held.add(doc_id, text)
                    if held.size >= shard_tokens or len(held.ids) >= shard_docs:
                        yield close(held)
                        held = Builder()
        if held.ids:
            yield close(held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return written(rows.mapInArrow(run, SHARD_SCHEMA), "bm25-index")


def document_frequencies(index: DataFrame) -> DataFrame:
    """term, df over all shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0):
                shard = unpacked(blob.as_py())
                names = bytes(shard["terms"]).split()
                df = np.diff(np.frombuffer(shard["starts"], "<u4")).astype("<i8")
                for at in range(0, len(names), 50_000):
                    yield pa.RecordBatch.from_arrays([pa.array(names[at : at + 50_000], pa.binary()), pa.array(df[at : at + 50_000])], ["term", "df"])

    return index.select("shard").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def query_terms(queries: DataFrame) -> DataFrame:
    """query_id, term, qtf; queries: query_id, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                ids, names, counts = [], [], []
                for q, text in zip(whole.column(0).slice(at, 256).to_pylist(), whole.column(1).slice(at, 256).to_pylist()):
                    held = Counter(tokens(text))
                    ids += [q] * len(held)
                    names += held.keys()
                    counts += held.values()
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.binary()), pa.array(counts, pa.int64())], ["query_id", "term", "qtf"])

    return queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), text_of().alias("text")).mapInArrow(run, "query_id long, term binary, qtf long")


def spaced(names: bytes) -> pa.Array:
    """Words that stand between single spaces, each with a space after it."""
    data = np.frombuffer(names + b" " if names else b"", "u1")
    ends = np.concatenate([[0], np.flatnonzero(data == 0x20) + 1]).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(data)])


class Shard:
    """A shard opened for one block of queries: postings of the block's terms with their contributions.

    wanted: the block's words as spaced() gives them.
    """

    def __init__(self, blob: bytes, wanted: pa.Array, average: float):
        row = unpacked(blob)
        self.ids = np.frombuffer(row["ids"], "<i8")
        self.known = np.frombuffer(row["known"], "u1").astype(bool)
        n = self.n = len(self.ids)
        lengths = np.frombuffer(row["lengths"], "<u4").astype(float)
        starts = np.frombuffer(row["starts"], "<u4").astype(np.int64)
        self.places = np.frombuffer(row["places"], "<u4").astype(np.int64)
        counts = np.frombuffer(row["counts"], "<u4").astype(float)
        self.norm = K1 * (1 - B + B * lengths / max(average, 1e-9))
        self.parts = counts * (K1 + 1) / (counts + self.norm[self.places])
        self.first, self.count = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        found = pc.index_in(spaced(bytes(row["terms"])), value_set=wanted)
        w, i = found.drop_null().to_numpy(), np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
        self.first[w], self.count[w] = starts[i], starts[i + 1] - starts[i]
        self.runs = -(-n // RUN)
        long = np.flatnonzero(self.count > max(n * LONG, RUN))
        long = long[np.argsort(-self.count[long], kind="stable")][: DENSE // max(1, self.runs * RUN)]
        self.row_of = np.full(len(wanted), -1, np.int64)
        self.row_of[long] = np.arange(len(long))
        self.counts = np.zeros((len(long), self.runs * RUN), np.float32)  # the long lists' counts, exact
        self.dense = np.zeros((self.runs, len(long), RUN), np.float32)  # and contributions, by run
        for r, t in enumerate(long):
            at = slice(self.first[t], self.first[t] + self.count[t])
            run, nth = np.divmod(self.places[at], RUN)
            self.counts[r, self.places[at]] = counts[at]
            self.dense[run, r, nth] = self.parts[at]
        self.maxima = np.ascontiguousarray(self.dense.max(axis=2).T)
        # A sum over long lists in single precision errs by less than this share; what is found is summed up anew.
        self.error = (len(long) + 8) * 2.0**-23

    def short_sums(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Each document's score by these short lists."""
        sizes = self.count[terms]
        if not len(sizes):
            return np.zeros(self.runs * RUN)
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.first[terms] - ends + sizes, sizes)
        return np.bincount(self.places[at], np.repeat(weights, sizes) * self.parts[at], self.runs * RUN)

    def long_sums(self, rows: np.ndarray, weights: np.ndarray, places: np.ndarray) -> np.ndarray:
        """The score of these places by these long lists, in double precision."""
        out = np.empty(len(places))
        for at in range(0, len(places), 1024):
            some = places[at : at + 1024]
            counts = self.counts[rows[:, None], some].astype(float)
            out[at : at + 1024] = weights @ (counts * (K1 + 1) / (counts + self.norm[some]))
        return out

    def top(self, queries: list[tuple[np.ndarray, np.ndarray]], best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each query (terms, weights) all documents that can be among the k best: query's number, place, score.

        best: for each query the k best scores found elsewhere, 0 where there are fewer. Documents of no score or
        of one below all of those are left out.
        """
        k, lists = best.shape[1], []
        sums = np.zeros((len(queries), self.runs, RUN))
        factors = np.zeros((len(queries), len(self.dense[0]) if self.runs else 0), np.float32)
        for q, (terms, weights) in enumerate(queries):
            held = self.count[terms] > 0
            terms, weights = terms[held], weights[held]
            rows = self.row_of[terms]
            long = rows >= 0
            sums[q] = self.short_sums(terms[~long], weights[~long]).reshape(self.runs, RUN)
            factors[q, rows[long]] = weights[long]
            lists.append((rows[long], weights[long]))
        over = 1 + 2 * self.error
        bound = (sums.max(axis=2) + factors @ self.maxima) * over
        best = best.copy()
        least = best.min(axis=1) / over - SLACK
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def score(run: int, some: np.ndarray) -> None:
            """Scores a run's documents for the queries whose pivot it is, and raises their thresholds."""
            got = sums[some, run] + (factors if len(some) == len(factors) else factors[some]) @ self.dense[run]
            reach = (got > 0) & (got >= least[some, None])
            nth, at = np.nonzero(reach)
            if not len(nth):
                return
            found.append((some[nth], run * RUN + at, got[nth, at]))
            rise = np.flatnonzero(reach.any(axis=1))
            more = np.concatenate([best[some[rise]], got[rise]], axis=1)
            best[some[rise]] = more = np.partition(more, RUN, axis=1)[:, RUN:]
            least[some[rise]] = more.min(axis=1) / over - SLACK

        # The runs of the highest bounds set the thresholds; then the cursor goes through the others in document
        # order: a run is the pivot of the queries whose threshold its bound reaches, the others pass it over.
        first = np.zeros(bound.shape, bool)
        if self.runs:
            np.put_along_axis(first, np.argpartition(-bound, min(STEP, self.runs) - 1, axis=1)[:, :STEP], True, 1)
        for now in (first, ~first):
            for run in range(self.runs):
                some = np.flatnonzero(now[:, run] & (bound[:, run] > 0) & (bound[:, run] >= least))
                if len(some):
                    score(run, some)
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        of, places, scores = (np.concatenate([x[c] for x in found]) for c in range(3))
        held = scores >= least[of]
        of, places = of[held], places[held]
        order = np.argsort(of, kind="stable")
        of, places = of[order], places[order]
        scores = sums.reshape(len(queries), -1)[of, places]
        cuts = np.searchsorted(of, np.arange(len(queries) + 1))
        for (rows, weights), a, z in zip(lists, cuts, cuts[1:]):
            if z > a and len(rows):
                scores[a:z] += self.long_sums(rows, weights, places[a:z])
        return of, places, scores


def shared_block(rows: DataFrame) -> tuple:
    """rows: query_id, term, weight of one block. Its words, and query, word number and weight by query."""
    got = rows.toArrow()
    names = got.column("term").combine_chunks().dictionary_encode() if got.num_rows else pa.array([], pa.binary()).dictionary_encode()
    ids, term, weight = got.column("query_id").to_numpy(), names.indices.to_numpy(), got.column("weight").to_numpy()
    order = np.lexsort((term, ids))
    return b" ".join(names.dictionary.to_pylist()), ids[order], term[order].astype(np.int64), weight[order]


def best_rows(index: DataFrame, shared, average: float, k: int) -> DataFrame:
    """query_id, doc_id, ranked, score: the k best rows of each query of the block in each task's shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, ids, term, weight = shared.value
        wanted = spaced(names)
        cuts = np.flatnonzero(np.diff(ids)) + 1
        parts = [(term[a:z], weight[a:z]) for a, z in zip([0, *cuts], [*cuts, len(ids)])] if len(ids) else []
        asked = ids[[0, *cuts]] if len(ids) else ids
        of, scores, known, doc_ids = np.empty(0, np.int64), np.empty(0), np.empty(0, bool), np.empty(0, np.int64)
        for batch in batches:
            for blob in batch.column(0):
                shard = Shard(blob.as_py(), wanted, average)
                best = np.zeros((len(parts), k))
                best[of, np.arange(len(of)) - np.searchsorted(of, of)] = scores
                new = [(of, scores, known, doc_ids)]
                # The queries go through a shard together, as many as a bounded table of sums holds.
                step = max(1, min(QUERIES, SUMS // max(1, shard.runs * RUN)))
                for at in range(0, len(parts), step):
                    which, places, more = shard.top(parts[at : at + step], best[at : at + step])
                    new.append((which + at, more, shard.known[places], shard.ids[places]))
                of, scores, known, doc_ids = (np.concatenate([x[c] for x in new]) for c in range(4))
                order = np.lexsort((doc_ids, ~known, -np.round(scores, 9), of))
                of = of[order]
                order = order[(kept := np.arange(len(of)) - np.searchsorted(of, of) < k)]
                of, scores, known, doc_ids = of[kept], scores[order], known[order], doc_ids[order]
        for at in range(0, len(of), 10_000):
            part = slice(at, at + 10_000)
            yield pa.RecordBatch.from_arrays([pa.array(asked[of[part]], pa.int64()), pa.array(doc_ids[part], pa.int64(), mask=~known[part]), pa.array(np.round(scores[part], 9)), pa.array(scores[part])], ["query_id", "doc_id", "ranked", "score"])

    return index.select("shard").mapInArrow(run, "query_id long, doc_id long, ranked double, score double")


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS, shard_tokens: int = SHARD_TOKENS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """query_id, rank, doc_id, score: the k best documents of each query by BM25.

    queries: query_id, text; each text is a bag of words in which repeats count. Rows are ranked by scores
    rounded to nine decimals, and scores are as summed up; ties go to the smaller doc_id, null ids last. Documents that share no word with a query aren't
    listed; null and empty texts match nothing and find nothing. Queries that repeat a query_id are one query
    of all their words; those of null id aren't asked. An empty table, of documents or of queries, gives no rows.
    """
    spark = docs.sparkSession
    index = build_index(docs, shard_tokens, shard_docs)
    n, size = index.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    df = document_frequencies(index)
    idf = F.log(1 + (F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = query_terms(queries).groupBy("query_id", "term").agg(F.sum("qtf").alias("qtf")).join(df, "term").select("query_id", "term", (F.col("qtf") * idf).alias("weight"))
    weighted = written(weighted, "bm25-queries")
    blocks = max(1, math.ceil(weighted.count() / block_terms))
    of_block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = []
    for b in range(blocks):
        # One block, of a bounded number of terms, is sent to all shards, and dropped again.
        shared = spark.sparkContext.broadcast(shared_block(weighted.where(of_block == b).select("query_id", "term", "weight")))
        found.append(written(best_rows(index, shared, size / max(1, n), k), f"bm25-found-{b}"))
        shared.destroy()
    discard(index)
    discard(weighted)
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    # Tasks keep k rows a query before the shuffle, and the ordered rows of a query spill.
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("ranked"), F.col("doc_id").asc_nulls_last()))
    return rows.withColumn("rank", nth).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
