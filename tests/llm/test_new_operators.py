"""Periodic runs, spelling variants and best-fit packing against brute force."""

import hashlib
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from engramic.llm import best_fit, packing, periodic_runs, spelling

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, word string, rank long"  # the last three clash with names used inside


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2) for i, t in rows], DOCS)


def brute_runs(words):
    out = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((a, p, b) for (a, b), p in out.items())


def brute_digest(doc, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str("" if doc is None else doc).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    drop = {i for a, p, b in runs for i in range(a + p, b)}
    best = min(runs, key=lambda r: (-Fraction(r[2] - r[0], r[1]), r[0], r[1]), default=None)
    told = (best[0], best[2] - best[0], best[1], 1000 * (best[2] - best[0]) // best[1]) if best else (None,) * 4
    lines = "".join(f"{a},{b - a},{p}\n" for a, p, b in runs)
    kept = " ".join(w for i, w in enumerate(words) if i not in drop)
    return doc, len(runs), *told, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()


def test_periodic_runs_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = [None, "", " \t\n", "one", "a " * 23, "a " * 24, "a b c " * 9 + "a b", "é x  y " * 13, "x " * 3000, "a b " * 700 + "c " + "a b " * 700]
    for _ in range(150):
        words = [str(w) for w in rng.integers(0, int(rng.integers(1, 6)), int(rng.integers(0, 150)))]
        motif = [str(w) for w in rng.integers(0, 5, int(rng.integers(1, 30)))]
        at = int(rng.integers(0, len(words) + 1))
        texts.append(" ".join(words[:at] + motif * int(rng.integers(1, 8)) + words[at:]))
    rows = [*enumerate(texts), (None, "a b " * 20), (5, "a " * 24), (5, "a " * 24)]
    got = [tuple(r) for r in periodic_runs.digest(periodic_runs.periodic_runs(docs_of(spark, rows), periodic_runs.planted)).collect()]
    want = [brute_digest(*r) for r in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[1] for r in want) > 100 and sum(r[1] > 1 for r in want) > 10


def test_periodic_runs_of_texts_in_small_batches_and_spans(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "BATCH_CANDIDATES", 50)
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 2, 200), np.tile(rng.integers(0, 9, 50), 4), np.zeros(100, int), np.arange(40)]
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    words = np.concatenate([t + 1000 * i for i, t in enumerate(texts)]).astype(np.int32)
    start, end, period = periodic_runs.find_runs(words, starts, sizes)
    want = sorted((a + s, p, b + s) for t, s in zip(texts, starts.tolist(), strict=True) for a, p, b in brute_runs(t.tolist()))
    assert list(zip(start.tolist(), period.tolist(), end.tolist(), strict=True)) == want
    (row,) = periodic_runs.periodic_runs(docs_of(spark, [(1, "k " + "a b c " * 8)])).collect()
    assert row["n_words"] == 25 and [tuple(r) for r in row["runs"]] == [(1, 24, 3)] and row["collapsed"] == "k a b c"
    assert periodic_runs.digest(periodic_runs.periodic_runs(docs_of(spark, []))).count() == 0


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows, plant=True):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if plant and h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            counts[word] += 1
    known = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in known if v != w and one_edit(w, v)] for w in known}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-known[v], v), default=None)
        form[w] = best if best and known[best] >= 5 * known[w] else None
    out = []
    for w, n in known.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, n, len(near[w]), form[w], known[form[w]] if form[w] else None, root))
    return out


@pytest.mark.parametrize("most", [512, 6])
def test_spelling_variants_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(spelling, "MOST_WORDS", most)
    rng = np.random.default_rng(5)
    stems = ["color", "colour", "ÀÉîõüÿ", "straße", "aaaaaa", "aaaaaaa", "abcabc", "bcabca"] + ["".join(rng.choice(list("abcd"), int(rng.integers(6, 9)))) for _ in range(60)]
    words = []
    for stem in stems:
        words += [stem] * int(rng.integers(1, 400))
        for _ in range(4):
            at = int(rng.integers(0, len(stem)))
            variant = [stem[:at] + stem[at + 1 :], stem[:at] + "é" + stem[at:], stem[:at] + "B" + stem[at + 1 :]][int(rng.integers(0, 3))]
            words += [variant] * int(rng.integers(1, 60))
    # forms of forms: each five times as frequent as the one before
    words += ["chains"] * 5 + ["chainsa"] * 25 + ["chainsab"] * 125 + ["chainsabc"] * 625
    rng.shuffle(words)
    rows = [(i, " ".join(words[i * 50 : i * 50 + 50]) + ", 12") for i in range(len(words) // 50 + 1)] + [(None, None), (7, ""), (None, "colour Colour COLOUR"), (7, "colour"), (7, "colour"), (8, "x" * 5000 + " " + "colour " * 3000)]
    got = [tuple(r) for r in spelling.group_variants(docs_of(spark, rows), spelling.planted).collect()]
    want = brute_variants(rows)
    assert sorted(got) == sorted(want) or sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(w[2] for w in want) > 100 and any(w[3] and w[5] != w[3] for w in want)


def test_spelling_variants_of_no_words(spark):
    assert spelling.group_variants(docs_of(spark, [])).count() == 0
    assert spelling.group_variants(docs_of(spark, [(1, None), (2, "short words")])).count() == 0


def test_near_pairs_of_a_subtree():
    rng = np.random.default_rng(6)
    for _ in range(60):
        words = sorted({bytes(rng.integers(97, 97 + int(rng.integers(1, 5)), int(rng.integers(1, 9))).astype(np.uint8)) for _ in range(int(rng.integers(1, 100)))})
        for depth in (0, 2):
            p, q = spelling.near_pairs(words, depth)
            common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            want = sorted((i, j) for j in range(len(words)) for i in range(j) if one_edit(words[i], words[j]) and common(words[i], words[j]) >= depth)
            assert sorted(tuple(sorted(x)) for x in zip(p.tolist(), q.tolist(), strict=True)) == want


def unpacked(rows, window=2048):
    """Checks that sequences are gapless and within the window; pieces by document."""
    sequences, docs = {}, {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append(r)
        docs.setdefault(r["doc_id"], []).append(r)
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
    return docs, len(sequences)


def test_best_fit_packing_is_whole_and_dense(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    rng = np.random.default_rng(7)
    texts = [None, "", "   ", "<|endoftext|> and \x00 control", "déjà vu 東京 ☃", "word " * 9000, "x" * 40_000] + [" ".join(f"w{w}" for w in rng.integers(0, 3000, int(rng.integers(1, 900)))) for _ in range(400)]
    rows = list(enumerate(texts))
    got = best_fit.pack(docs_of(spark, rows).repartition(5), packing.default_tokenizer()).collect()
    docs, n = unpacked(got)
    assert len(docs) == len(texts)
    total = 0
    for i, text in rows:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        total += len(want)
        pieces = sorted(docs[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(k, at, min(2048, len(want) - at)) for k, at in enumerate(range(0, len(want), 2048))]
        assert b"".join(r["ids"] for r in pieces) == np.asarray(want, "<u4").tobytes()
        assert all(r["ids_crc32"] == zlib.crc32(r["ids"]) for r in pieces)
    assert n <= 1.01 * -(-total // 2048) + 1


def test_best_fit_packing_of_repeated_rows_and_none(spark):
    rows = [(None, "a b c")] * 7 + [(3, "same text")] * 500
    got = best_fit.pack(docs_of(spark, rows), packing.default_tokenizer(), keep_ids=False).collect()
    docs, n = unpacked(got)
    assert len(got) == 507 and len(docs[None]) == 7 and n == 1 and all(r["ids"] is None for r in got)
    assert best_fit.pack(docs_of(spark, []), packing.default_tokenizer()).count() == 0


@pytest.mark.parametrize(("histogram", "least"), [({}, 0), ({1: 5}, 1), ({2048: 3}, 3), ({683: 7, 1365: 7}, 7), ({1025: 100, 1023: 90, 2047: 4}, 104), ({700: 1000}, 500), ({3: 700, 1000: 10, 1045: 9}, 11)])
def test_plan_gives_each_rank_one_place(histogram, least):
    runs, room = best_fit.plan(histogram, 2048), Counter()
    for length, n in histogram.items():
        starts, first = runs[length]
        for rank in range(n):
            k = int(np.searchsorted(starts, rank, "right")) - 1
            room[int(first[k]) + rank - int(starts[k])] += length
    assert max(room.values(), default=0) <= 2048 and len(room) == least


def test_plan_of_many_documents_is_no_longer():
    runs = best_fit.plan({5: 10_000_000_000, 700: 30_000_000_000, 1348: 29_999_999_999}, 2048)
    assert sum(len(starts) for starts, _ in runs.values()) < 2048
    assert all(starts[0] == 0 and (np.diff(starts) > 0).all() for starts, _ in runs.values())
