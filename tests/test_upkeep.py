"""The index, recall accesses, corpus sync, compaction, compression, ingress and verdicts against brute force, restarts and hot keys."""

import json
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from engramic.functions import admission, envelope, rules
from engramic.functions.metadata import with_smart_metadata
from engramic.operators import compaction, compression, corpus, ingress, ordered, pairs, postings, recall_updates, retrieval, verdicts


def bm25(rows, query, k):
    sized = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in rows}
    mean = sum(map(len, sized.values())) / len(sized) or 1.0
    df = Counter(w for ws in sized.values() for w in set(ws))
    out = []
    for i, ws in sized.items():
        raw = sum(math.log1p((len(sized) - df[t] + 0.5) / (df[t] + 0.5)) * ws.count(t) * 2.2 / (ws.count(t) + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for t in set(re.findall(r"[^\W_]+", query.lower())) if t in ws)
        if raw:
            out.append((-round(1 / (1 + math.exp(-raw / 5)), 6), i))
    return [(i, -s) for s, i in sorted(out)[:k]]


def test_index_search_equals_brute_force_through_appends_and_folds(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: " ".join(rng.choice(["the", "the", *(f"w{n}" for n in range(40))]) for _ in range(rng.randint(0, 30)))
    rows = {f"r{i}": text() for i in range(120)}
    rows |= {"r3": None, "r4": "", "r5": "the " * 5000}
    table = lambda d: spark.createDataFrame(list(d.items()), "id string, text string")
    queries = spark.createDataFrame([(q, t) for q, t in enumerate(["the w1 w2", "w39", "nothing", "", "The W3, w4; the"])], "query_id long, text string")
    index = postings.build(table(rows), str(tmp_path / "index"), shards=5)

    def same(index):
        got = defaultdict(list)
        for r in sorted(retrieval.indexed_search(index, queries, 7).collect(), key=lambda r: (r["query_id"], r["rank"])):
            got[r["query_id"]].append((r["id"], r["score"]))
        assert dict(got) == {q: hits for q, t in enumerate(["the w1 w2", "w39", "nothing", "", "The W3, w4; the"]) if (hits := bm25(rows.items(), t, 7))}

    same(index)
    changed = {"r7": "the w39 w39", "new": "w1 the"}
    rows |= changed
    del rows["r9"], rows["r5"]
    index = postings.appended(index, table(changed), spark.createDataFrame([("r9",), ("r5",), ("gone",)], "id string"))
    same(index)
    same(postings.opened(spark, index.folder))
    index = postings.folded(index)
    assert len(index.segments) == 1
    same(index)
    same(postings.rebuilt(index, table(rows)))
    # a segment that no version names, as a lost job leaves it, is not seen
    (tmp_path / "index" / "segment-lost").mkdir()
    same(postings.opened(spark, index.folder))


def test_index_folds_itself_after_some_appends(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "FOLD_AFTER", 2)
    index = postings.build(spark.createDataFrame([("a", "x y")], "id string, text string"), str(tmp_path / "i"))
    for n in range(3):
        index = postings.appended(index, spark.createDataFrame([(f"n{n}", "x")], "id string, text string"))
    assert len(index.segments) == 2 and index.documents().count() == 4
    assert {r["term"]: r["df"] for r in index.terms().collect()} == {"x": 4, "y": 1}


def test_search_within_spaces_uses_each_spaces_own_frequencies(spark):
    rows = [(f"{s}{i}", f"common w{i % 5} w{i % 3}", s) for s in "ab" for i in range(20 if s == "a" else 7)]
    asked = spark.createDataFrame([(1, "w1 common", "a"), (2, "w1 common", "b")], "query_id long, text string, space string")
    got = retrieval.lexical_search(spark.createDataFrame(rows, "id string, text string, space string"), asked, 50).collect()
    for q, s in ((1, "a"), (2, "b")):
        assert [(r["id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == bm25([(i, t) for i, t, x in rows if x == s], "w1 common", 50)


UPDATES = "id string, expected_scope string, delta long, accessed_at long, snapshot struct<bad_recall_count: long, suppressed_until_turn: long, suppressed_until_ms: long>, seq long"
STORE = "id string, text string, category string, scope string, importance double, timestamp long, metadata string"


def test_recall_updates_are_applied_once_and_release_only_what_they_saw(spark, tmp_path):
    meta = json.dumps({"access_count": 2, "last_accessed_at": 500, "bad_recall_count": 3, "suppressed_until_ms": 900, "customTag": "kept"})
    rows = spark.createDataFrame([("row-1", "a", "fact", "s", 0.5, 100, meta), ("row-2", "b", "fact", None, 0.5, 100, meta), ("row-3", "c", "fact", "s", 0.5, 100, "{}")], STORE)
    ledger = recall_updates.opened(rows, str(tmp_path / "store"))
    seen = (3, 0, 900)
    accesses = [("row-1", "s", 1, 700, (9, 9, 9), 1), ("row-1", "s", 2, 800, seen, 2), ("row-1", "s", 0, 999, None, 3), ("row-2", "global", 1, 400, (2, 0, 900), 4), ("row-3", "other", 1, 5, None, 5), ("row-9", "s", 1, 5, None, 6), ("!", "s", 1, 5, None, 7), ("row-3", "s", 4, 1, None, 8)]
    updates = recall_updates.coalesced(spark.createDataFrame(accesses, UPDATES))
    want = {("row-1", "s"): "updated", ("row-2", "global"): "updated", ("row-3", "other"): "moved", ("row-9", "s"): "missing", ("!", "s"): "invalid id", ("row-3", "s"): "updated"}
    for _ in range(2):  # the second time as after a restart
        again = recall_updates.Ledger(spark, ledger.folder)
        assert {(r["id"], r["expected_scope"]): r["outcome"] for r in again.apply(updates, 7).collect()} == want
    now = {r["id"]: json.loads(r["metadata"]) for r in ledger.current().collect()}
    assert {k: int(now["row-1"][k]) for k in ("access_count", "last_accessed_at", "last_confirmed_use_at", "bad_recall_count", "suppressed_until_ms")} == {"access_count": 5, "last_accessed_at": 800, "last_confirmed_use_at": 800, "bad_recall_count": 0, "suppressed_until_ms": 0}
    assert now["row-1"]["customTag"] == "kept"
    assert int(now["row-2"]["bad_recall_count"]) == 3 and int(now["row-2"]["last_accessed_at"]) == 500 and int(now["row-2"]["access_count"]) == 3
    ledger.apply(updates, 8)
    ledger.fold()
    assert int({r["id"]: json.loads(r["metadata"]) for r in ledger.current().collect()}["row-1"]["access_count"]) == 8
    assert ledger.apply(updates, 7).count() == 6  # known also after the fold
    assert int({r["id"]: json.loads(r["metadata"]) for r in ledger.current().collect()}["row-1"]["access_count"]) == 8


def test_invalid_and_repeated_updates(spark):
    rows = with_smart_metadata(spark.createDataFrame([("row-1", "a", "fact", "s", 0.5, 100, "{}")], STORE))
    bad = [("row-1", "s", 1, 5, None, 1), ("row-1", "s", 1, 5, None, 2), ("row-1", "t", 0, 5, None, 3), ("row-1", "u", 1, 0, None, 4), (None, "s", 1, 5, None, 5)]
    got = {r["seq"]: r["outcome"] for r in recall_updates.judged(rows, spark.createDataFrame(bad, UPDATES)).collect()}
    assert got == {1: "updated", 2: "duplicate", 3: "invalid delta", 4: "invalid time", 5: "invalid id"}


def test_failed_updates_wait_longer_and_end(spark):
    schema = UPDATES.replace(", seq long", "") + ", attempts long"
    failed = spark.createDataFrame([("a", "s", 1, 10, None, 0), ("b", "s", 2, 20, None, 3), ("c", "s", 1, 5, None, 1)], schema)
    pending = spark.createDataFrame([("a", "s", 5, 9, None, 0)], schema)
    got = {r["id"]: (r["delta"], r["accessed_at"], r["attempts"], r["wait_ms"]) for r in recall_updates.retried(failed, pending).collect()}
    assert got == {"a": (6, 10, 0, 100), "c": (1, 5, 2, 200)}


def test_access_stream_survives_a_restart(spark, tmp_path):
    rows = spark.createDataFrame([("row-1", "a", "fact", "s", 0.5, 100, "{}")], STORE)
    ledger = recall_updates.opened(rows, str(tmp_path / "store"))
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "check")
    for n in range(2):
        spark.createDataFrame([("row-1", "s", 1, 50 + n, None, n)] * 3, UPDATES).coalesce(1).write.mode("append").parquet(source)
        recall_updates.merged_stream(spark.readStream.schema(UPDATES).parquet(source), recall_updates.Ledger(spark, ledger.folder), checkpoint).awaitTermination()
    recall_updates.merged_stream(spark.readStream.schema(UPDATES).parquet(source), ledger, checkpoint).awaitTermination()
    assert int(json.loads(ledger.current().first()["metadata"])["access_count"]) == 6


def test_corpus_sync_of_files_that_did_not_change_does_nothing(spark):
    chunks = corpus.with_ids(spark.createDataFrame([("w", "a", "memory", f"p{i}", 1, 9, None if i == 3 else f"t{i}") for i in range(9)], "workspace string, agent string, source string, path string, first_line int, last_line int, text string"))
    none = chunks.limit(0).select(*corpus.DOCUMENT)
    first = corpus.sync_plan(chunks, corpus.stored_refs(chunks.limit(0)), chunks.select("workspace", "agent"), none)
    assert {r["action"] for r in first.collect()} == {"add"}
    store = corpus.synced(chunks.select("id", "text", "metadata").limit(0), chunks, first)
    again = corpus.sync_plan(chunks, corpus.stored_refs(store), chunks.select("workspace", "agent"), none)
    assert [r["action"] for r in again.collect()] == ["keep"] * 9
    # no file is left: chunks of watched agents go, others stay
    away = lambda agents: {r["action"] for r in corpus.sync_plan(chunks.limit(0), corpus.stored_refs(store), spark.createDataFrame(agents, "workspace string, agent string"), none).collect()}
    assert away([("w", "a")]) == {"remove"} and away([("w", "b")]) == {"keep"}


def test_bucket_pairs_find_near_pairs(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    near = base + rng.standard_normal((60, 64)) * np.linalg.norm(base, axis=1)[:, None] / 8 * 0.52
    rows = [(i, v.tolist(), "s") for i, v in enumerate(np.concatenate([base, near]))] + [(200, None, "s"), (201, [1.0, 2.0], "s")]
    table = spark.createDataFrame(rows, "id long, vector array<double>, scope string")
    exact = {(r["a"], r["b"]) for r in pairs.similar_pairs(table.where("size(vector) = 64"), ["scope"], 0.88).collect()}
    got = {(r["a"], r["b"]) for r in compaction.bucket_pairs(table, ["scope"], 0.88).collect()}
    assert len(exact) > 20 and got <= exact and len(got) >= len(exact) - 1


def test_clusters_of_many_copies_are_linear_and_merge_in_order(spark):
    copies = [(f"c{i:04d}", "Line one\nline two" if i else "First\nLINE ONE", [1.0, 0.0], "fact", "s", 0.9 if i == 5 else 0.5, 100, "{}") for i in range(3000)]
    others = [("x1", "alone", [0.0, 1.0], "fact", "s", 0.5, 100, "{}"), ("x2", "none", None, "fact", "s", 0.5, 100, "{}"), ("y1", "Line one", [1.0, 0.0], "fact", "t", 0.5, 100, "{}")]
    rows = with_smart_metadata(spark.createDataFrame(copies + others, "id string, text string, vector array<double>, category string, scope string, importance double, timestamp long, metadata string"))
    after, found, stats = compaction.compacted(rows, 10**12)
    assert stats.first().asDict() == {"scanned": 3002, "clusters": 1, "deleted": 3000, "created": 1}
    assert found.where("seed = 'c0005'").count() == 3000
    new = {r["id"]: r for r in after.collect()}
    assert set(new) == {"compacted:c0005", "x1", "x2", "y1"}
    merged = new["compacted:c0005"]
    assert merged["text"] == "Line one\nline two\nFirst" and merged["importance"] == 0.9 and json.loads(merged["metadata"])["sourceCount"] == 3000
    assert compaction.compacted(rows, 10**12, dry_run=True)[0].count() == 3003


def brute_compression(texts, worth, budget):
    n, kept, used = len(texts), set(), 0
    if sum(map(len, texts)) <= budget:
        return set(range(n))

    def add(i):
        nonlocal used
        if i in kept or not 0 <= i < n or used + len(texts[i]) > budget:
            return False
        kept.add(i)
        used += len(texts[i])
        return True

    add(0)
    if n > 1:
        add(n - 1)
    mate = {}
    for i in range(n - 1):
        if worth[i][1] == "tool_call" and i not in mate and i + 1 not in mate:
            mate[i], mate[i + 1] = i + 1, i
    for i in sorted(range(1, n - 1), key=lambda i: (-worth[i][0], i)):
        if used >= budget:
            break
        if add(i) and i in mate:
            add(mate[i])
    if all(s < 0.3 for s, _ in worth):
        for i in reversed(range(n)):
            if len(kept) >= min(3, n):
                break
            add(i)
    return kept


def test_compression_equals_a_pass_in_order(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 7)
    rng = random.Random(5)
    bits = ["", "", " ", "ok", "thanks", "tool_result was fine", "[tool_call] x", "no, that is wrong", "we decided", "what?", "short", "y" * 90, "z" * 40, "function_call: f", None]
    talks = {c: [rng.choice(bits if c % 3 else ["", "ok", "", " ", "thanks"]) for _ in range(rng.randint(1, 40))] for c in range(60)}
    rows = [(c, 3 * i + 1, t) for c, ts in talks.items() for i, t in enumerate(ts)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    worth = {(r["conv_id"], r["turn"]): (r["v"]["score"], r["v"]["reason"]) for r in table.select("conv_id", "turn", rules.text_value(F.coalesce("text", F.lit(""))).alias("v")).collect()}
    assert {r for _, r in worth.values()} >= {"tool_call", "empty", "acknowledgment", "short_question"}
    for budget in (5, 37, 150):
        got = defaultdict(set)
        for r in compression.compressed(table, budget).collect():
            got[r["conv_id"]].add(r["pos"])
        for c, ts in talks.items():
            want = brute_compression([t or "" for t in ts], [worth[c, 3 * i + 1] for i in range(len(ts))], budget)
            assert got[c] == want, (c, budget, ts)
    assert compression.compressed(table.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        compression.compressed(table, 0)


def test_running_values_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 4)
    rng = random.Random(2)
    rows = [(k, at, rng.randint(0, 3)) for k in "ab" for at in rng.sample(range(60), 30)]
    got = ordered.running_sum(spark.createDataFrame(rows, "k string, at long, v long"), "k", "at", F.col("v"), "s")
    got = ordered.last_before(got, "k", "at", F.col("v") == 0, "l").collect()
    for r in got:
        own = sorted((a, v) for k, a, v in rows if k == r["k"])
        assert r["s"] == sum(v for a, v in own if a <= r["at"])
        assert r["l"] == max((a for a, v in own if a < r["at"] and v == 0), default=None)


def test_ingress_equals_the_rules(spark):
    rng = random.Random(8)
    turns, eligible, new, want = [], [], [], {}
    for s in range(80):
        said = [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.randint(0, 7))]
        may = [t for r, t in said if s % 2 or r == "user"]
        tail = may[rng.randint(0, len(may)) :] if s % 3 else [rng.choice("abc") for _ in range(rng.randint(0, 3))]
        turns += [(s, i, r, t) for i, (r, t) in enumerate(said)]
        eligible += [(s, i, t) for i, t in enumerate(may)]
        new += [(s, i, t) for i, t in enumerate(tail)]
        if not (len(tail) <= len(may) and may[len(may) - len(tail) :] == tail):
            out = [(i, "user", t) for i, t in enumerate(tail)]
        elif len(said) == len(may):
            out = [(i, *said[i]) for i in range(len(may) - len(tail), len(said))]
        else:
            skip, users, out = len(may) - len(tail), 0, []
            for i, (r, t) in enumerate(said):
                users += r == "user"
                if users > skip:
                    out.append((i, r, t))
        want[s] = out
    got = ingress.turns_for_extraction(spark.createDataFrame(turns, "session long, pos long, role string, text string"), spark.createDataFrame(eligible, "session long, pos long, text string"), spark.createDataFrame(new, "session long, pos long, text string"))
    found = defaultdict(list)
    for r in got.collect():
        found[r["session"]].append((r["pos"], r["role"], r["text"]))
    assert {s: sorted(v) for s, v in found.items()} == {s: v for s, v in want.items() if v}


def test_verdicts_on_one_row_add_up(spark):
    held = json.dumps({"support_info": json.dumps({"slices": [{"context": f"c{i}", "confirmations": 1, "contradictions": 0, "last_observed_at": i} for i in range(8)]}), "fact_key": "preferences:tea"})
    rows = with_smart_metadata(spark.createDataFrame([("row-1", "Tea: green", "preference", "s", 0.5, 100, held), ("row-2", "I am Ana", "fact", "s", 0.5, 100, json.dumps({"memory_category": "profile"}))], STORE))
    candidates = [(i, i, c, f"Tea: {i}", "- o", "c", "s1", "s") for i, c in enumerate(["preferences", "preferences", "preferences", "preferences", "profile", "events", "preferences"])]
    told = ["support", "supersede", "supersede", "contradict", None, "merge", "supersede"]
    judged = [(i, None if d is None else (d, "1" if i < 6 else "3", "r", "evening" if d in ("support", "contradict") else None), ["row-1"]) for i, d in enumerate(told)]
    c = spark.createDataFrame(candidates, "cand_id long, seq long, category string, abstract string, overview string, content string, session string, scope string")
    j = spark.createDataFrame(judged, "cand_id long, verdict struct<decision: string, match_index: string, reason: string, context_label: string>, similar array<string>")
    routed = verdicts.routed(c, j, rows)
    assert [r["action"] for r in sorted(routed.collect(), key=lambda r: r["cand_id"])] == ["support", "supersede", "supersede", "contradict", "merge", "create", "create"]
    merges = spark.createDataFrame([(4, "Ana, nurse", "- o", "c")], "cand_id long, abstract string, overview string, content string")
    after = {r["id"]: (r["text"], json.loads(r["metadata"])) for r in verdicts.applied(rows, routed, merges, 1000).collect()}
    assert set(after) == {"row-1", "row-2", "mem:1", "mem:2", "mem:3", "mem:5", "mem:6"}
    meta = after["row-1"][1]
    support = json.loads(meta["support_info"])
    assert meta["superseded_by"] == "mem:2" and meta["invalidated_at"] == "1000" and support["total_observations"] == 10
    assert len(support["slices"]) == 8 and support["slices"][0] == {"context": "evening", "confirmations": 1, "contradictions": 1, "last_observed_at": 1000}
    assert after["row-2"][0] == "Ana, nurse" and after["mem:2"][1]["supersedes"] == "row-1" and after["mem:2"][1]["fact_key"] == "preferences:tea"
    assert after["mem:3"][1]["relations"] == [{"type": "contradicts", "targetId": "row-1"}] and after["mem:3"][1]["contexts"] == ["evening"]


def slow_repair(text):
    out, inside, escaped = [], False, False
    for i, c in enumerate(text):
        after = text[i + 1 :].lstrip()[:1]
        if escaped:
            out.append(c)
            escaped = False
        elif inside and c == "\\":
            out.append(c)
            escaped = True
        elif inside and c == '"':
            inside = bool(after) and after not in ",}]:"
            out.append('\\"' if inside else c)
        elif inside:
            out.append({"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(c, c))
        elif c == '"':
            inside = True
            out.append(c)
        elif c != "," or after not in ("}", "]"):
            out.append(c)
    return "".join(out)


def test_json_repair_equals_a_scan_and_leaves_valid_json_alone():
    rng = random.Random(1)
    for _ in range(30_000):
        s = "".join(rng.choice('"\\,:}]{[ \n\tab') for _ in range(rng.randint(0, 12)))
        assert envelope.repaired(s) == slow_repair(s)
    for _ in range(500):
        value = {"".join(rng.choices("ab\\ é", k=3)): [rng.random(), None, {"k": "".join(rng.choices('xyz {}[]\n\\"', k=6))}]}
        text = json.dumps(value)
        assert json.loads(envelope.extracted(f"so:\n```json\n{text}\n```")) == value
    assert json.loads(envelope.usable('<think>{"a": 1}</think> sure {"a": "say "hi" now", "b": [1, 2, ], } bye')) == {"a": 'say "hi" now', "b": [1, 2]}
    assert envelope.usable("no json") is None and envelope.usable("{ open") is None


@pytest.mark.parametrize("hostile", ['"' * 300_000, "{" * 300_000, "\\" * 300_000, '```json{"a"```' * 30_000, '"\n  ' * 80_000, ", " * 150_000, "[Subagent Task] " * 20_000])
def test_scanners_are_linear(hostile):
    import time

    began = time.time()
    envelope.repaired(hostile), envelope.extracted(hostile), envelope.without_envelope(hostile)
    assert time.time() - began < 3


def test_envelopes(spark):
    fence = "```"
    strip = envelope.without_envelope
    assert strip(f'Sender (untrusted metadata):\n{fence}json\n{{"a": "}}"}}\n{fence}\nhello') == "hello"
    assert strip(f'{fence}json\n{{"message_id": 1, "sender_id": 2}}\n{fence}\nhi') == "hi"
    assert strip(f'{fence}json\n{{"a": 1}} {{"b": 2}}\n{fence}') == f'{fence}json\n{{"a": 1}} {{"b": 2}}\n{fence}'
    assert strip("Do not use any memory tools.\nreal") == "Do not use any memory tools.\nreal"
    assert strip("[Subagent Context] You are running as a subagent (depth 1/1). Results auto-announce to your requester. Do it\nnow") == "Do it\nnow"
    assert strip("x\n[Subagent Task] kept") == "x\n[Subagent Task] kept"
    rows = spark.createDataFrame(
        [("user", "@bot [Subagent Task] Do it.  Now"), ("user", "A new session was started via /new or /reset. Execute your Session Startup sequence now\nx\n\nreal"), ("user", "<relevant-memories>\nm\n</relevant-memories>\nyes"), ("assistant", " [Subagent Task] as is "), (None, "x"), ("user", None), ("user", "[Subagent Task]\n\n")],
        "role string, text string",
    )
    assert [r[0] for r in rows.select(envelope.capture_text(F.col("role"), F.col("text"))).collect()] == ["Do it. Now", "real", "yes", "[Subagent Task] as is", None, None, None]
    tags = spark.createDataFrame([("a <user_message> b",), ("<​ / Assistant_Message id='x'>",), ("<user_messages> <user_message",), ("1 < 2 > <user_message/> <",), ("",), (None,)], "text string")
    assert [r[0] for r in tags.select(envelope.without_spoofed_tags(F.col("text"))).collect()] == ["a ‹user_message› b", "‹​ / Assistant_Message id='x'›", "<user_messages> <user_message", "1 < 2 > ‹user_message/› <", "", None]


def test_longest_common_subsequence_and_support(spark):
    rng = random.Random(4)
    for _ in range(300):
        a, b = (rng.choices("abcd", k=rng.randint(0, 20)) for _ in "ab")
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
        assert admission.lcs_length(a, b) == row[-1]
    got = spark.createDataFrame([("green tea daily", "I drink green tea daily. Also coffee."), ("green tea", "nothing alike"), ("", "x")], "a string, b string").select(F.round(admission.confidence(F.col("a"), F.col("b")), 6)).collect()
    assert got[1][0] == 0.0 and got[2][0] == 0.0 and got[0][0] == pytest.approx(0.7 * 2 * 3 / 10 + 0.3, abs=1e-6)  # sentences of one line are one span
