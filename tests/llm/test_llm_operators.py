"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns."""
from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vellumine.llm import bm25, boosting, bpe_codec, components, exact_dedup, mixing, pii, pretokens, simhash, suffix_dedup, token_counts, toxicity, url_reputation

DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, key string, part int"


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["the", "An", "idiot", "über", "naïve", "x1", "don't", "www", "σΑΣ", "end.", "<|endoftext|>", "ſ", "a,b"]
    out = [None, "", " \t\n", "one", "one", "Two words", "two words", "a b c", "a b c", "\u00a0\u3000", "x" * 5000]
    for _ in range(60):
        out.append(" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))))
    out += [out[20], out[20], out[21] + " more", (out[22] + " ") * 200]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i if i != 5 else None, t, "en", ["b", "a", None, "é", "c"][i % 5], 0, "d", "k", 1) for i, t in enumerate(texts)]
    rows.append(rows[20])  # a repeated row
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def plain(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]


def same(got, want):
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_exact_dedup(spark, docs, empty):
    rows = plain(docs)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    kept = Counter()
    for r in got:
        t = next(t for _, t in rows if hashlib.sha256(t.encode()).hexdigest() == r["text_sha256"])
        assert r["keep_id"] == max((x for x in groups[t] if x is not None), default=None)
        assert r["group_size"] == len(groups[t])
        kept[t] += r["kept"]
    assert set(kept.values()) == {1} and len(kept) == len(groups)
    stay = exact_dedup.keep_winners(docs)
    assert stay.columns == docs.columns
    same([(r["doc_id"], r["text"] or "") for r in stay.collect()], [(max((x for x in v if x is not None), default=None), t) for t, v in groups.items()])
    assert exact_dedup.exact_dedup(empty).collect() == []


def test_perfect_hash_is_minimal_and_byte_checked():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    index = exact_dedup.build_bucket(0, digests, list(range(3000)))
    assert len(index["digests"]) == 32 * 3000
    found = exact_dedup.look_up(index, digests)
    assert found == [(True, i) for i in range(3000)]
    strangers = [hashlib.sha256(f"x{i}".encode()).digest() for i in range(500)] + [digests[0][:31] + b"\0"]
    assert not any(m for m, _ in exact_dedup.look_up(index, strangers))


def fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reachable(values, ids, distance=3):
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= distance:
                root[find(i)] = find(j)
    out = {}
    for i in range(len(values)):
        out.setdefault(find(i), []).append(ids[i])
    return [min((x for x in out[find(i)] if x is not None), default=None) for i in range(len(values))]


def test_simhash(docs, empty):
    rows = plain(docs)
    prints = [fingerprint(t) for _, t in rows]
    want = [(i, f"{p:016x}", c) for (i, _), p, c in zip(rows, prints, least_reachable(prints, [i for i, _ in rows]))]
    same([tuple(r) for r in simhash.near_dedup(docs).select("doc_id", "fingerprint", "component_id").collect()], want)
    assert simhash.near_dedup(empty).collect() == []


def test_simhash_links_in_crowded_buckets(spark):
    rng = random.Random(3)
    center = rng.getrandbits(64)
    values = {center}
    while len(values) < 300:  # one dense cluster and strangers
        x = rng.choice(sorted(values))
        values.add(x ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values |= {rng.getrandbits(64) for _ in range(100)}
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    links = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), chunk=16)
    roots = {r["node"]: r["root"] for r in components.connected_components(links).collect()}
    want = least_reachable(values, signed)
    groups = defaultdict(set)
    for v, c in zip(signed, want):
        groups[c].add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({next(iter(g)) for g in groups.values()})
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= 3 for a, b in links.collect())


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(199)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in components.connected_components(edges).collect()}
    assert got == {i: 0 for i in range(200)} | {500: 500, 501: 500}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_str(pretokens.tokenizer_json())


@pytest.mark.parametrize("hot", [token_counts.HOT, 3])
def test_token_counts(docs, empty, library, hot):
    want = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 2048) for i, t in plain(docs)]
    same([tuple(r) for r in token_counts.token_counts(docs, hot=hot).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()], want)
    assert token_counts.token_counts(empty, hot=hot).collect() == []


def test_bpe_round_trip(docs, empty, library):
    want = []
    for i, t in plain(docs):
        ids = library.encode(t, add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    same([tuple(r) for r in bpe_codec.bpe_round_trip(docs).collect()], want)
    assert bpe_codec.bpe_round_trip(empty).collect() == []


def test_bpe_agrees_with_merging_and_the_library(library):
    codec = bpe_codec.Codec(pretokens.tokenizer_json())
    rng = random.Random(5)
    for alphabet in ("ab", "thenisg", "'s é́ñ<|>0 ½ǅ\x1c\x85한", "xyz-_.,!"):
        for _ in range(300):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 50)))
            assert codec(text.encode())[1] == " ".join(map(str, library.encode(text, add_special_tokens=False).ids)), text
    for word in ("thethethe", "aaaaaaaaaaaaaaa", "internationalization"):
        assert codec.bpe.encode(word) == codec.bpe.plain(codec.bpe.word(word))


def removed_by_force(texts, length):
    seen = Counter(t[p : p + length] for t in texts for p in range(len(t) - length + 1))
    out = []
    for t in texts:
        cover = bytearray(len(t))
        for p in range(len(t) - length + 1):
            if seen[t[p : p + length]] > 1:
                cover[p : p + length] = b"\1" * length
        out.append((len(t), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(bytes(b for b, c in zip(t, cover) if not c)).hexdigest()))
    return out


@pytest.mark.parametrize(("group", "hot"), [(suffix_dedup.GROUP, suffix_dedup.HOT_ROWS), (2, 1)])
def test_suffix_dedup(spark, docs, empty, group, hot):
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choice("abcdefgh ä") for _ in range(n))
    passage, other = letters(130), letters(90)
    made = [letters(50) + passage[: 60 + 10 * i] + letters(rng.randint(0, 150)) for i in range(8)]
    made += [letters(30) + passage[20:] + other + letters(20), other, other + letters(3), "z" * 300, letters(40) * 5, passage + passage, None, ""]
    table = spark.createDataFrame([(i, t) for i, t in enumerate(made)] + [(3, made[3])], "doc_id long, text string").repartition(3)
    rows = plain(table)
    want = [(i, *x) for (i, _), x in zip(rows, removed_by_force([t.encode() for _, t in rows], 80))]
    got = suffix_dedup.without_repeats(table, 80, 40, group, hot_rows=hot).collect()
    same([tuple(r)[:5] for r in got], want)
    cores = Counter(t.encode()[i : i + 40] for _, t in rows for i in range(len(t.encode()) - 39))
    for r in got:  # every repeat shows in a shared core, and a shared core is a string of 40 bytes that stands twice
        text = next(t for i, t in rows if i == r.doc_id).encode()
        assert (r.n_removed == 0 or r.n_shared > 0) and (r.n_shared == 0 or any(cores[text[i : i + 40]] > 1 for i in range(len(text) - 39)))
    if group > 2:
        rows = plain(docs)
        want = [(i, *x) for (i, _), x in zip(rows, removed_by_force([t.encode() for _, t in rows], 400))]
        same([tuple(r)[:5] for r in suffix_dedup.without_repeats(docs).collect()], want)
        assert suffix_dedup.without_repeats(empty).collect() == []


def shared_words_by_force(texts: list[str], words: int) -> list[int]:
    parts = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    owners: dict[tuple, set] = {}
    for t, p in zip(texts, parts):
        for i in range(len(p) - words + 1):
            owners.setdefault(tuple(p[i : i + words]), set()).add(t)
    out = []
    for p in parts:
        at = [i for i in range(len(p) - words + 1) if len(owners[tuple(p[i : i + words])]) > 1]
        out.append(len({k for i in at for k in range(i, i + words)}))
    return out


@pytest.mark.parametrize("block", [suffix_dedup.BLOCK, 200])
def test_passages_of_51_words_shared_by_texts_are_counted(spark, docs, monkeypatch, block):
    rng = random.Random(7)
    some = lambda n: ["".join(rng.choice("abcdeä") for _ in range(rng.randint(1, 6))) for _ in range(n)]
    passage, line = some(60), some(51)
    made = [" ".join([*some(rng.randint(0, 70)), *passage[: 48 + i], *some(rng.randint(0, 70))]) for i in range(13)]
    made += [" ".join(passage[5:]), "\n".join(passage[2:58]) + "\t", " ".join(passage[:51]) + "x", " ".join([*line, *some(9), *line]), " ".join(some(80))]
    made += [made[-1], made[12], " ".join(["x"] * 60), " ".join(["x"] * 70), " ".join(["x"] * 50), "y" * 500, None, ""]
    made = [(i, t) for i, t in enumerate(made)]
    want = shared_words_by_force([t or "" for _, t in made], 51)
    assert want[3] >= 51 and want[16] == want[17] == want[18] == want[22] == 0 and want[20] == 60
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)  # however the texts are cut up, anchors and cores are the same
    numbers, cores, lo, hi = suffix_dedup.passage_cores([(t or "").encode() for _, t in made])
    named = {}
    for n, core, a, b in zip(numbers.tolist(), cores.tolist(), lo.tolist(), hi.tolist()):
        for i in range(a, b + 1):
            assert named.setdefault(tuple(made[n][1].split()[i : i + 51]), core) == core
    assert len(cores) and set(named) == {tuple((t or "").split()[i : i + 51]) for _, t in made for i in range(len((t or "").split()) - 50)}
    if block == 200:
        return
    table = spark.createDataFrame(made, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.n_shared_words for r in suffix_dedup.without_repeats(table).collect()}
    assert [got[i] for i, _ in made] == want
    rows = plain(docs)
    got = {r.doc_id: r.n_shared_words for r in suffix_dedup.without_repeats(docs).collect()}
    assert [got[i] for i, _ in rows] == shared_words_by_force([t or "" for _, t in rows], 51)


def test_long_texts_are_scanned_in_overlapping_pieces(monkeypatch):
    text = random.Random(2).randbytes(5000)
    whole = suffix_dedup.anchors([text])[0].tolist()
    monkeypatch.setattr(suffix_dedup, "PIECE", 1000)
    assert suffix_dedup.anchors([text])[0].tolist() == whole


def test_bm25(docs, empty):
    rows = plain(docs)
    queries = docs.where("doc_id % 10 = 0").selectExpr("doc_id AS query_id", "text")
    held = [Counter(bm25.tokens(t)) for _, t in rows]
    n, average = len(rows), sum(c.total() for c in held) / len(rows)
    df = Counter(t for c in held for t in c)
    asked = defaultdict(Counter)
    for i, t in rows:
        if i is not None and i % 10 == 0:
            asked[i].update(bm25.tokens(t))
    want = []
    for q, terms in asked.items():
        scored = []
        for (i, _), c in zip(rows, held):
            norm = bm25.K1 * (1 - bm25.B + bm25.B * c.total() / average)
            s = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * (bm25.K1 + 1) / (c[t] + norm) for t, m in terms.items() if t in c)
            if s > 0:
                scored.append((-round(s, 6), i is None, i or 0, i))
        want += [(q, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:5])]
    for shard, block in ((10**9, 10**9), (200, 20)):
        got = bm25.search(docs, queries, 5, block_terms=block, shard_tokens=shard).collect()
        assert len(got) == len(want)
        got, must = sorted((r[0], r[1], round(r[3], 5)) for r in got), sorted((q, r, round(s, 5)) for q, r, _, s in want)
        assert [x[:2] for x in got] == [x[:2] for x in must] and np.allclose([x[2] for x in got], [x[2] for x in must], atol=2e-5)
    assert bm25.search(empty, queries, 5).collect() == []
    assert bm25.search(docs, queries.selectExpr("CAST(NULL AS LONG) AS query_id", "text"), 5).collect() == []
    assert bm25.search(docs, queries.where("false"), 5).collect() == []


def test_bm25_many_and_uneven_shards(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(400)], k=rng.randint(1, 60))) for _ in range(900)]
    texts += [" ".join(rng.choices(words, k=20_000)) for _ in range(3)] + [texts[5]] * 20
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    queries = table.where("doc_id % 90 = 0").selectExpr("doc_id AS query_id", "text")
    got = [[tuple(r) for r in bm25.search(table, queries, 7, block, shard, docs).orderBy("query_id", "rank").collect()] for block, shard, docs in ((10**9, 10**9, 10**9), (500, 3000, 10**9), (10**9, 10**9, 300))]
    held = [Counter(bm25.tokens(t)) for t in texts]
    n, average, df = len(texts), sum(c.total() for c in held) / len(texts), Counter(t for c in held for t in c)
    for q in range(0, n, 90):
        scores = [sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / average)) for t, m in held[q].items() if t in c) for c in held]
        want = sorted((-round(s, 9), i) for i, s in enumerate(scores) if s > 0)[:7]
        for rows in got:
            mine = [r for r in rows if r[0] == q]
            assert [r[1] for r in mine] == list(range(1, len(want) + 1))
            assert np.allclose([r[3] for r in mine], [-s for s, _ in want], atol=1e-6)
            assert [r[2] for r in mine if r[3] > -want[-1][0] + 1e-6] == [i for s, i in want if -s > -want[-1][0] + 1e-6]


def test_bm25_queries_go_through_a_shard_together():
    """Runs are scored for many queries by one product, with the results of each query scored alone in double precision."""
    rng = random.Random(5)
    builder, held = bm25.Builder(), []
    for i in range(700):
        held.append(Counter(f"w{min(int(rng.expovariate(0.02)), 399)}" for _ in range(rng.randint(1, 80))))
        builder.add(i, " ".join(held[-1].elements()))
    docs, tokens, blob = builder.row()
    words = sorted({t for c in held for t in c}) + ["elsewhere"]
    shard = bm25.Shard(blob, bm25.spaced(" ".join(words).encode()), tokens / docs)
    assert 20 < len(shard.counts) < len(words) - 20  # long and short lists
    queries = [(np.array(sorted(rng.sample(range(len(words)), m))), np.array([rng.uniform(0.1, 30) for _ in range(m)])) for m in (1, 2, 9, 40, 200) * 8]
    queries.append((np.array([len(words) - 1]), np.ones(1)))
    best = np.zeros((len(queries), 5))
    best[::3] = 20.0  # found in other shards
    of, places, scores = shard.top(queries, best)
    got = defaultdict(dict)
    for q, p, s in zip(of.tolist(), places.tolist(), scores.tolist()):
        assert int(shard.ids[p]) not in got[q]
        got[q][int(shard.ids[p])] = s
    for q, (terms, weights) in enumerate(queries):
        norm = [1.2 * (0.25 + 0.75 * c.total() * docs / tokens) for c in held]
        want = {i: sum(w * c[words[t]] * 2.2 / (c[words[t]] + norm[i]) for t, w in zip(terms, weights)) for i, c in enumerate(held)}
        least = max(sorted([*want.values(), *best[q]])[-5], 1e-12)
        assert all(abs(got[q][i] - s) < 1e-8 for i, s in want.items() if i in got[q] or s >= least), q
        assert len(got[q]) < 350


def test_bm25_scores_are_rounded_once(spark):
    """A score that is rounded to nine decimals first may be rounded to another one of six."""
    rng = random.Random(6)
    texts = [" ".join(f"w{min(int(rng.expovariate(0.05)), 99)}" for _ in range(rng.randint(1, 90))) for _ in range(80)]
    held = [Counter(bm25.tokens(t)) for t in texts]
    n, average, df = len(texts), sum(c.total() for c in held) / len(texts), Counter(t for c in held for t in c)
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bm25.search(table, table.where("doc_id % 20 = 0").selectExpr("doc_id AS query_id", "text"), 7).collect()
    assert len(rows) == 28
    for q, _, i, score in rows:
        c = held[i]
        want = sum(m * math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * c.total() / average)) for t, m in held[q].items() if t in c)
        assert abs(score - want) < 1e-11


def brute_pii(t):
    found = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found += [(*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0:
            found.append((*m.span(), "card"))
    found += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_patterns():
    rng = random.Random(0)
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789..@@a-+ ()é4") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == brute_pii(t), t


def test_pii(spark, empty):
    rng = random.Random(4)
    card = lambda: next(x for x in iter(lambda: str(rng.randrange(4 * 10**15, 5 * 10**15)), "") if pii.luhn(x))
    texts = [f"é write to w{i}.x@mail{i}.example.com or +1 (415) 555-{1000 + i} from 10.0.{i}.7, card {card()}." for i in range(60)] + [None, "", "nothing at all.", "7" * 4000, "a@" * 2000]
    disguised = "please write to jane.roe [at] mail3 [dot] example [dot] com today"
    table = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, disguised])], "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r for r in pii.find_pii(table).collect()}
    assert len(got) == len(texts) + 1
    for i, t in enumerate([*texts, disguised]):
        want = brute_pii(t or "")
        line = ",".join(f"{k}:{s}:{e}" for s, e, k in want)
        assert got[i]["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[2] == k for x in want) for k in pii.KINDS]
        assert set(line.split(",")) <= set(got[i]["spans"].split(",")) or not line
        assert got[i]["n_spans"] == len(want) + got[i]["n_added"] == len([x for x in got[i]["spans"].split(",") if x])
    at = disguised.index("jane")
    assert got[len(texts)]["spans"] == f"email:{at}:{disguised.index(' today')}"
    assert pii.find_pii(empty).collect() == []
    assert pii.redact("call +1 415 555 1234 now", pii.base_spans("call +1 415 555 1234 now")) == "call <phone> now"


def test_pii_marks_without_digits():
    for t in ("write to jane.roe (at) example.com please", "jane.roe [AT] example.com", "jane(At)example.com", "jane at example dot com", "jane @ x", "no mark here", "٣٣٣ (at)", ""):
        want = [(m.start(), m.end()) for m in pii._MARK.finditer(t)]
        assert pii.marks(t) == want and bool(want) == ("no mark" not in t and t != ""), t
    rng = random.Random(3)
    name = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    weights = pii.fit_weights([x for i in range(150) for x in pii.training_windows(f"please write to {name(5)}.{name(4)}@{name(6)}.com or call me", i)])
    for t in ("write to jane.roe (at) example.com please", "write to jane.roe [at] example [dot] com please"):
        found = [t[a:b] for a, b, k in pii.added_spans(t, pii.base_spans(t), weights) if k == "email"]
        assert found and found == [(t + " 7")[a:b] for a, b, k in pii.added_spans(t + " 7", [], weights) if k == "email"], t



def test_segments_are_chosen_together():
    weights = np.zeros((len(pii.KINDS), len(pii.FEATURES)))
    weights[0, 0] = weights[1, 0] = 1.0
    one = [1.0] + [0.0] * (len(pii.FEATURES) - 1)
    assert pii.viterbi(4, [(0, 2, 0, one), (1, 4, 1, one), (2, 4, 1, one)], weights) == [(0, 2, 0), (2, 4, 1)]


def test_toxicity(spark, empty):
    rng = random.Random(9)
    clean = ["river", "table", "green", "walks", "paper", "seven", "light"]
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [rng.choice(clean) + rng.choice(["", "s", "ly"]) for _ in range(30)]
        if toxic:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["idiotic", "idiot", "scum"]))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000, None), (None, "river"), (1001, "x " * 30_000)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    known = spark.createDataFrame([*labels, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(table, known).collect()}
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    held = [i for i in range(600) if got[i]["held_out"]]
    import zlib

    assert held == [i for i in range(600) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == (i % 4 == 0) for i in held) >= 0.97 * len(held)
    stay = toxicity.keep_clean(table, known)
    assert stay.columns == ["doc_id", "text"] and stay.count() == sum(not r["predicted"] for r in got.values())
    assert toxicity.toxicity(empty, known).collect() == []
    assert {r["predicted"] for r in toxicity.toxicity(table, known.where("false")).collect()} == {0}


def test_isotonic_rises():
    x, y = boosting.isotonic(np.array([3.0, 1.0, 2.0, 4.0]), np.array([0, 0, 1, 1]))
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and y[0] == 0 and y[-1] == 1


def waterfill(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), float(sum(sizes.values()))
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return target | share
        for s in over:
            target[s] = cap * sizes[s]
            left -= target[s]
            free.remove(s)
    return target


def test_mixing(docs, empty):
    rows = [(r["doc_id"], r["source"], len(re.findall("[^\x20\x09-\x0d]+", r["text"] or ""))) for r in docs.collect()]
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    target = waterfill(sizes)
    got = mixing.mix(docs).collect()
    same([(r["doc_id"], r["source"], r["size"]) for r in got], rows)
    took = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], target[r["source"]], rel_tol=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        took[r["source"]] += r["taken"]
    for s in sizes:  # near the target, or as near as whole copies can come
        sums = {0}
        for _, source, n in rows:
            if source == s and n:
                sums = {x + k * n for x in sums for k in range(4)}
        assert abs(took[s] - target[s]) <= max(1, 0.02 * target[s], min(abs(x - target[s]) for x in sums))
    same([tuple(r) for r in mixing.mix(docs).collect()], [tuple(r) for r in got])
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in out.collect())
    assert words == sum(took.values())
    assert mixing.mix(empty).collect() == []


def test_mixing_solves_the_dual(spark):
    histogram = spark.createDataFrame([("a", 10, 5), ("a", 200, 2), ("b", 7, 100), ("b", 900, 1)], "source string, size long, docs long")
    targets = spark.createDataFrame([("a", 450, 700.0), ("b", 1600, 400.0)], "source string, source_size long, target double")
    got = {r["source"]: r for r in mixing.solve(histogram, targets).collect()}
    for s, rows in (("a", [(10, 5), (200, 2)]), ("b", [(7, 100), (900, 1)])):
        r = got[s]
        assert math.isclose(sum(n * z * min(3.0, math.exp(r["multiplier"] * z / r["mean_size"])) for z, n in rows), r["target"], rel_tol=1e-6)


def test_rules_and_hosts(spark):
    urls = ["http://A.Example.ORG/es/x?q#f", "https://example.org/en/12", "x://notexample.org/es/", "http://org/", "http://b.com/fr/", "http://b.com/de/1", "http://b.com", "no scheme", None, "", "http://c.co.uk?x=1", "://d.net#t", "http://example.org"]
    pages = spark.createDataFrame([(i, u, "", "h") for i, u in enumerate(urls)] + [(None, "http://b.com/x", "", "h")], "page_id long, url string, html string, host string")
    labels = spark.createDataFrame([(5, 0, 0), (6, 0, 1), (None, 0, 0), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r["page_id"]: r for r in url_reputation.url_filter(pages, labels).collect()}
    assert len(got) == len(urls) + 1
    assert [(got[i]["host"], got[i]["path"], got[i]["rule"]) for i in range(len(urls))] == [
        ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("notexample.org", "/es/", "org/"), ("org", "/", "org/"),
        ("b.com", "/fr/", "com/fr/"), ("b.com", "/de/1", "com/de/"), ("b.com", "", None), ("", "", None), ("", "", None), ("", "", None), ("c.co.uk", "", None), ("d.net", "", None), ("example.org", "", None),
    ]
    assert [got[i]["verdict"] for i in range(6)] == ["block", "block", "allow", "allow", "allow", "block"]
    assert {r["verdict"] for r in got.values()} <= {"allow", "block"}
    assert url_reputation.url_filter(pages.where("false"), labels).collect() == []


def test_reputation_shrinks_towards_the_level_above(spark):
    pages = spark.createDataFrame([(i, h) for i, h in enumerate(["bad.x.com"] * 200 + ["new.x.com"] + ["ok.y.net"] * 200)], "page_id long, host string")
    outcomes = spark.createDataFrame([(i, int(i < 200)) for i in range(401) if i != 200], "page_id long, bad int")
    got = {r["host"]: r for r in url_reputation.reputations(pages, outcomes).collect()}
    assert got["bad.x.com"]["mean"] > 0.9 and got["bad.x.com"]["bad_chance"] > 0.99 and got["ok.y.net"]["mean"] < 0.05 and got["ok.y.net"]["bad_chance"] < 0.01
    assert 0.3 < got["new.x.com"]["mean"] < got["bad.x.com"]["mean"] and got["new.x.com"]["bad_chance"] <= got["bad.x.com"]["bad_chance"]


def test_mass_of_a_beta_posterior(spark):
    rng = np.random.default_rng(5)
    cases = [(0.3, 2.0, 5.0), (0.345, 40.0, 60.0), (0.1, 0.02, 1.98), (0.7, 300.0, 100.0), (0.26, 26_000.0, 74_000.0), (0.5, 1.0, 1.0)]
    got = spark.createDataFrame(cases, "x double, a double, b double").select("x", "a", "b", url_reputation.mass_above(F.col("x"), F.col("a"), F.col("b")).alias("m")).collect()
    for x, a, b, m in got:
        assert abs(m - (rng.beta(a, b, 400_000) > x).mean()) < 0.004, (x, a, b)
    assert abs(next(m for x, a, b, m in got if a == 2) - (1 - (1 - 0.7**6 - 6 * 0.3 * 0.7**5))) < 1e-9  # by the binomial sum


def test_a_bad_host_is_blocked_whatever_the_base_rate(spark):
    for others in (0, 5, 10):  # of twenty, so many pages of each other host are bad
        urls, labels = [], []
        for h in range(12):
            for k in range(20):
                bad = k < (18 if h == 0 else others)
                labels.append((len(urls), 0 if bad else 1, 0))
                urls.append(f"http://h{h}.site{h}.net/p{k}")
        urls += ["http://h0.site0.net/unlabelled", "http://h3.site3.net/unlabelled"]
        pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
        known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
        got = {r["page_id"]: r for r in url_reputation.url_filter(pages, known).collect()}
        assert {r["host"] for r in got.values() if r["verdict"] == "block"} == {"h0.site0.net"}, others
        assert got[240]["verdict"] == "block" and got[241]["verdict"] == "allow" and got[240]["rule"] is None


def brute_features(text, lexicon):
    """The features of a text, word by word."""
    words = text.split()
    n = max(1, len(words))

    def best(w):
        return max([lexicon.get(x, 0.0) for x in (["=" + w] + [w[:k] + "*" for k in range(3, 9) if len(w) > k] if w else [])], default=0.0)

    total = most = strong = weak = hidden = second = upper = inner = doubled = letters = 0
    kinds, hits, marks = set(), [], []
    for i, raw in enumerate(words):
        word = re.sub(r"^[\W_]+|[\W_]+$", "", raw).lower()
        weight = best(word)
        plain = re.sub(r"(.)\1{2,}", r"\1", re.sub(r"[\W\d_]", "", raw.lower().translate(toxicity.STAND_INS)))
        total += weight
        most = max(most, weight)
        if weight >= 3:
            strong, kinds = strong + 1, kinds | {raw}
            hits.append(i)
        elif weight:
            weak += 1
        hidden += not weight and plain != word and best(plain) >= 3
        second += word in toxicity.SECOND_PERSON
        marks += [i] * (word in toxicity.SECOND_PERSON)
        upper += len(raw) > 1 and raw.isupper()
        inner += bool(re.search(r"[^\W\d_][\d@$!|*#+]+[^\W\d_]", raw))
        doubled += bool(re.search(r"(.)\1{2,}", word))
        letters += len(word)
    away = [min(abs(h - m) for m in marks) for h in hits] if marks else []
    near, gap = (sum(a <= toxicity.NEAR for a in away) / len(away), 1 / (1 + min(away))) if away else (0.0, 0.0)
    size = max(1, len(text.encode()))
    capitals, punctuation = len(re.findall("[A-Z]", text)), len(re.findall(r"[!-/:-@\[-`{-~]", text))
    top = max((words.count(w) for w in words), default=0)
    return [
        total / n, strong / n, math.log1p(strong), len(kinds), weak / n, math.log1p(weak), most, total / math.sqrt(n), hidden / n, math.log1p(hidden), second / n, near, gap, capitals / size, upper / n,
        punctuation / size, text.count("!") / n, text.count("?") / n, inner / n, doubled / n, letters / n, top / n if n > 20 else 0.0,
    ]


def test_toxicity_features():
    rng = random.Random(12)
    lexicon = {"=idiot": 4.0, "idi*": 3.5, "scu*": 3.2, "=meh": 1.5, "jer*": 2.0}
    words = ["idiot", "Idiots!", "1d10t", "id!ot", "SCUM", "scuuuum", "meh", "jerky", "you", "YOUR", "du", "river", "ÜBER", "a", "?!", "x_y", "nooo", "", "it's"]
    read = toxicity.Extractor(lexicon)
    for text in ["", " ", "idiot", "you", *[" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(300)]]:
        assert np.allclose(read(text.encode()), brute_features(text, lexicon)), text


def test_segmentation_is_the_best_of_all():
    rng = random.Random(13)
    for _ in range(200):
        n = rng.randint(1, 9)
        found = []
        for _ in range(rng.randint(0, 8)):
            i = rng.randrange(n)
            found.append((i, rng.randint(i + 1, n), rng.randrange(4), [rng.uniform(-1, 2)]))
        weights = np.array([[1.0], [0.5], [2.0], [-1.0]])
        score = lambda s: float(weights[s[2], 0] * s[3][0])
        best = 0.0
        for mask in range(1 << len(found)):
            held = sorted((found[k] for k in range(len(found)) if mask >> k & 1), key=lambda s: s[:2])
            if all(a[1] <= b[0] for a, b in zip(held, held[1:])):
                best = max(best, sum(map(score, held)))
        got = pii.viterbi(n, found, weights)
        assert all(a[1] <= b[0] for a, b in zip(got, got[1:]))
        took = sum(max(score(s) for s in found if s[:3] == g) for g in got)
        assert math.isclose(took, best, abs_tol=1e-9)


def test_a_python_worker_keeps_no_words_of_finished_tasks(spark, docs):
    bpe_codec.bpe_round_trip(docs).collect()
    content = pretokens.tokenizer_json()

    def kept(batches):
        codec = bpe_codec.shared_codec(content)
        for batch in batches:
            size = len(codec.young) + len(codec.old) + len(codec.words.young) + len(codec.words.old) + sum(map(len, codec.bpe._apart.values()))
            yield pa.RecordBatch.from_arrays([pa.array([size] * batch.num_rows, pa.int64())], ["n"])

    # Whichever of the workers a task gets.
    assert spark.range(16).repartition(16).mapInArrow(kept, "n long").agg(F.max("n")).first()[0] == 0
