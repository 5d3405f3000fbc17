"""The stages of corpus_pipeline against plain Python."""
from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from vellumine.llm import minhash, mixing, pretokens, simhash, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", len(t or "")) for i, t in rows], DOCS).repartition(3)


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def brute_roots(texts):
    """The first place of each text's component, all pairs compared."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for j in range(len(texts)):
        for i in range(j):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(texts))]


def near_texts():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    out = [None, "", "one", "ONE", "a b c d", "A b c d"]
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(20, 500))]
        out.append(" ".join(base))
        for _ in range(3):  # a chain: each link is a near copy of the one before it, or no longer one
            for _ in range(max(1, round(len(base) * rng.uniform(0.005, 0.03)))):
                base[rng.randrange(len(base))] = rng.choice(words)
            out.append(" ".join(base))
    rng.shuffle(out)
    return out


def test_near_copies_of_the_whole_range(spark):
    texts = near_texts()
    want = [i for i, r in enumerate(brute_roots(texts)) if r == i]
    assert 0.3 * len(texts) < len(want) < 0.8 * len(texts)
    got = pipeline.drop_near_copies(spark, frame(spark, enumerate(texts)), "").collect()
    assert sorted(r.doc_id for r in got) == want
    assert pipeline.drop_near_copies(spark, frame(spark, [(0, "x")]).limit(0), "").collect() == []


def test_near_copies_in_dealt_groups(spark, monkeypatch):
    texts = near_texts()
    monkeypatch.setattr("vellumine.llm.minhash.BUCKET_CHUNK", 2)
    monkeypatch.setattr("vellumine.llm.minhash.GROUP_CHUNK", 2)
    got = pipeline.drop_near_copies(spark, frame(spark, enumerate(texts)), "").collect()
    assert sorted(r.doc_id for r in got) == [i for i, r in enumerate(brute_roots(texts)) if r == i]


def test_near_copies_by_fingerprint_blocks(spark, monkeypatch):
    """Without the bands of minima the SimHash blocks find what is within their bits; similarity decides on it."""
    monkeypatch.setattr("vellumine.llm.minhash.sketch_links", lambda nodes, values: [])
    rng, texts = random.Random(3), []
    for k in range(30):
        base = [f"w{rng.randrange(3000)}" for _ in range(300)]
        texts += [" ".join(base), " ".join([*base[:-1], f"other{k}"])]
    prints = [simhash.majority(minhash.shingle_set(t.encode())) for t in texts]
    want = [i for i in range(60) if i % 2 == 0 or (prints[i] ^ prints[i - 1]).bit_count() > simhash.DISTANCE]
    assert 30 <= len(want) < 45
    got = pipeline.drop_near_copies(spark, frame(spark, enumerate(texts)), "").collect()
    assert sorted(r.doc_id for r in got) == want
    # Equal fingerprints of texts that aren't similar.
    monkeypatch.setattr("vellumine.llm.simhash.majority", lambda hashes: 5)
    got = pipeline.drop_near_copies(spark, frame(spark, enumerate(texts[::2])), "").collect()
    assert len(got) == 30


def test_near_copies_of_repeated_and_null_ids(spark):
    near = lambda w: (" ".join(f"{w}{i}" for i in range(60)), " ".join(f"{w}{i}" for i in range(59)))
    (b, b2), (c, c2), (e, e2) = near("b"), near("c"), near("e")
    rows = [(3, b2), (7, b), (7, "unlike both"), (None, c), (None, c2), (9, "twice"), (9, "twice"), (None, e), (4, e2)]
    got = [(r.doc_id, r.text) for r in pipeline.drop_near_copies(spark, frame(spark, rows), "").collect()]
    assert sorted(x for x in got if x[0] is not None) == [(3, b2), (4, e2), (7, "unlike both"), (9, "twice")]
    assert [x[1] for x in got if x[0] is None] in ([c], [c2])


def test_copies(spark):
    rows = [(1, "same text"), (4, "same text"), (2, "other"), (3, None), (5, "")]
    want = {}
    for i, t in rows:
        want[t or ""] = max(i, want.get(t or "", i))
    assert sorted(r.doc_id for r in pipeline.drop_copies(spark, frame(spark, rows), "").collect()) == sorted(want.values())


def test_run(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = pipeline.run(spark, sf).collect()
    library = Tokenizer.from_str(pretokens.tokenizer_json())
    assert got
    for r in got:
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    kept = sorted({r.doc_id for r in got})
    assert len({texts[i] for i in kept}) == len(kept)
    assert brute_roots([texts[i] for i in kept]) == list(range(len(kept)))


CLASH = "row string, id long, node long, digest string, copies int, source_size long, root long, draw long, key string, n long"


@pytest.fixture(scope="module")
def uneven(spark):
    """Nulls in any column, ties, repeated rows, a long text, and columns named like the operators' own."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=rng.randint(6, 80))) for _ in range(40)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t)) for i, t in enumerate(texts)]
    rows += [(100, texts[3], "en", "a", 1), (101, None, None, None, None), (102, "", "en", "b", 0), (None, texts[4], "en", "a", 1), (None, "only here", "en", None, 1), (103, texts[5], "en", "a", 1), (103, texts[5], "en", "a", 1), (103, "same id, other text", "en", "a", 1)]
    rows += [(104, " ".join(rng.choices(words, k=30_000)), "en", "c", 1), (105, " ".join(texts[6].split()[:-1]), "en", "b", 1)]
    full = [(*r, f"r{j}", j % 4, None, "d", 7, 1, j, 2, None, 3) for j, r in enumerate(rows)]
    return spark.createDataFrame(full, f"{DOCS}, {CLASH}").repartition(3)


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def test_stages_on_uneven_rows(spark, uneven):
    every = [tuple(r) for r in uneven.collect()]
    key = lambda r: (r[0] is not None, r[0] or 0)  # noqa: E731  null ids are smallest
    # Exact copies: the largest doc_id of a text, one row of it.
    got = pipeline.drop_copies(spark, uneven, "")
    assert got.columns == uneven.columns
    got = [tuple(r) for r in got.collect()]
    best = {}
    for r in every:
        best[r[1] or ""] = max(best.get(r[1] or "", (False, 0)), key(r))
    assert sorted((r[1] or "", key(r)) for r in got) == sorted(best.items()) and set(map(repr, got)) <= set(map(repr, every))
    # Near copies: one row of each group, that of the least id, nulls last.
    got = pipeline.drop_near_copies(spark, uneven, "")
    assert got.columns == uneven.columns
    got = [tuple(r) for r in got.collect()]
    roots, least = brute_roots([r[1] for r in every]), {}
    for r, root in zip(every, roots):
        least[root] = min(least.get(root, (True, 0)), (r[0] is None, r[0] or 0))
    assert sorted((r[0] is None, r[0] or 0) for r in got) == sorted(least.values()) and set(map(repr, got)) <= set(map(repr, every))
    # The mix: as many rows of each document as its share says, all columns with them.
    got = pipeline.mix_sources(spark, uneven, "")
    assert got.columns == uneven.columns
    want = Counter()
    for r in mixing.mix(uneven).collect():
        want[r.doc_id, r.source, r.size] += 1 if r.size == 0 else r.copies
    have = Counter((r.doc_id, r.source, len(re.findall("[^\x20\x09-\x0d]+", r.text or ""))) for r in got.collect())
    assert have == +want
    # Encoding keeps every row.
    got = pipeline.encode(spark, uneven, "")
    library = Tokenizer.from_str(pretokens.tokenizer_json())
    assert sorted((repr(r.doc_id), list(r.ids)) for r in got.collect()) == sorted((repr(r[0]), library.encode(r[1] or "", add_special_tokens=False).ids) for r in every)


def test_toxic_documents_go(spark, tmp_path, uneven):
    labels = [(i, 1, 0) for i in range(40)] + [(i, 1, 1) for i in range(200, 240)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    blank = [None] * (len(uneven.columns) - 5)
    bad = spark.createDataFrame([(i, f"you idiot scum {i} " * 4, "en", "a", 1, *blank) for i in range(200, 240)], uneven.schema)
    docs = uneven.unionByName(bad)
    got = pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    want = {(r.doc_id, r.predicted) for r in toxicity.toxicity(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")).collect()}
    assert rows_of(got) == rows_of(docs.where(~docs.doc_id.isin([i for i, p in want if p]) | docs.doc_id.isNull()))
    assert {i for i, p in want if p} >= set(range(200, 240)) and not any(p for i, p in want if i is not None and i < 200)


def test_stages_on_no_rows(spark, tmp_path, uneven):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in pipeline.STAGES:
        assert stage(spark, uneven.limit(0), str(tmp_path)).collect() == []
