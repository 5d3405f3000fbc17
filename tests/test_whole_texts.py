"""Queries over long, short and non-ASCII texts against plain Python."""
from __future__ import annotations

import base64
import hashlib

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from vellumine.plans.catalog import QUERIES

#: Over two pages of lines, over five words, over 40 characters, short, empty, not ASCII.
TEXTS = [
    "\n".join(f"line {i % 31} with nation {i}" for i in range(55)),
    "\n".join(f"line {i % 29} with nation {i}" for i in range(70)),
    "an idiot here\n" + "\n".join(["plain"] * 25) + "\nthe idiot\there at the end",
    "short", "", "größe über alles, naïve Ärzte überall und noch viel länger als vierzig Zeichen", "x" * 24 + "é",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(i, t, "en", "src1", len(t)) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    talk = [(0, 0, "user", TEXTS[0]), (0, 1, "assistant", TEXTS[5]), (0, 2, "user", "ok"), (1, 0, "user", TEXTS[5])]
    spark.createDataFrame(talk, "conv_id long, turn int, role string, text string").write.parquet(f"{at}/conversations.parquet")
    return at


def rows(spark, folder, name, *columns):
    return sorted(tuple(r) for r in QUERIES[name](spark, folder).select(*columns).collect())


def test_comment_summary(spark, folder):
    want = [(0, f"user: {TEXTS[0]}\n  assistant: {TEXTS[5]}\n  user: ok"), (1, f"user: {TEXTS[5]}")]
    assert rows(spark, folder, "comment_summary", "thread", "summary") == want


def lines_of(text):
    return text.removesuffix("\n").split("\n") if text else []


def test_positional_diff(spark, folder):
    want = []
    for pair, before in enumerate(TEXTS):
        b, a = lines_of(before), lines_of(TEXTS[pair + 1]) if pair + 1 < len(TEXTS) else []
        for i in range(max(len(b), len(a))):
            want.append((pair, i, "removed" if i >= len(a) else "added" if i >= len(b) else "same" if a[i] == b[i] else "changed"))
    assert rows(spark, folder, "positional_diff", "pair", "idx", "kind") == sorted(want)


def test_move_pairing(spark, folder):
    want = []
    for pair in range(len(TEXTS) - 1):
        b, a = lines_of(TEXTS[pair]), lines_of(TEXTS[pair + 1])
        for t in set(b):
            want += [(pair, t, i, j) for i, j in zip([i for i, x in enumerate(b) if x == t], [j for j, x in enumerate(a) if x == t])]
    assert any(i >= 20 for _, _, i, _ in want)
    assert rows(spark, folder, "move_pairing", "pair", "text", "before_idx", "after_idx") == sorted(want)


def test_redaction_verification(spark, folder):
    want = []
    for i, t in enumerate(TEXTS):
        li = lines_of(t)
        pages = [li[k : k + 20] for k in range(0, len(li), 20)] or [None]
        risks = [p is None or "idiot" in "\n".join(p).lower() for p in pages] + [p is None for p in pages] + [True] * (len(pages) * (i % 3 == 0))
        want.append((i, len(risks), risks.count(False), risks.count(True), not any(risks)))
    assert want[2][3] == 2  # the word stands on the first and on the second page
    assert rows(spark, folder, "redaction_verification", "doc_id", "regions", "confirmed", "risks", "passed") == want


def words_of(text):
    """(place from 1, word) of the words that recognition keeps."""
    return [(n, w) for n, w in enumerate(text.replace("\n", " ").replace("\t", " ").split(" "), 1) if len(w) >= 3]


def test_ocr(spark, folder):
    kept = {i: words_of(t) for i, t in enumerate(TEXTS) if words_of(t)}
    assert max(n for n, _ in kept[0]) > 200
    share = lambda w: len(w) * 7 % 100 / 100
    want = sorted((i, n, (n - 1) * 40.0, w, share(w)) for i, k in kept.items() for n, w in k)
    assert rows(spark, folder, "ocr_words", "page", "n", "x", "text", "confidence") == want
    mean = {i: sum(share(w) for _, w in k) / len(k) for i, k in kept.items()}
    want = [(i, " ".join(w for _, w in k), "failed" if i % 10 == 0 else "uncertain" if mean[i] < 0.5 else "applied") for i, k in kept.items()]
    assert rows(spark, folder, "ocr_gate", "page", "full_text", "outcome") == want
    got = rows(spark, folder, "ocr_text_layer", "page", "n", "x", "font_size")
    want = sorted((i, n, round((n - 1) * 40 * 612 / 2550, 6), round(max(6, min(24, 36 / len(w.encode()))), 6)) for i, k in kept.items() for n, w in k)
    assert got == [pytest.approx(x) for x in want]


def test_base64_hex_keys(spark, folder):
    want = [(i, base64.b64encode(t.encode()).decode(), t.encode().hex()) for i, t in enumerate(TEXTS)]
    assert rows(spark, folder, "base64_hex_keys", "doc_id", "b64", "hexed") == want


def test_byte_range_digest(spark, folder):
    want = []
    for i, t in enumerate(TEXTS):
        b = t.encode()
        want.append((i, hashlib.sha256(b"".join(b[o : o + n] for o, n in ((0, 10), (20, 5), (10**9, 5)) if o + n <= len(b))).hexdigest()))
    assert rows(spark, folder, "byte_range_digest", "doc_id", "digest") == want
