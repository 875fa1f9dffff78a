import math
import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from pithy.config import CompressionConfig, NoiseConfig, RedundancyConfig, TrimConfig
from pithy.functions import patterns as P
from pithy.functions import text as X
from pithy.operators import dedup, findings, fold, jsonshape, noise, phrases, rank, trim
from pithy.plans import compress as plan
from pithy.sources import documents, generators


def frame(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def one(df, *cols):
    r = df.orderBy("doc_id").first()
    return tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]]


def clean(spark, text, config=None):
    return one(noise.filter_noise(frame(spark, text), "text", "d", config), "text", "d")


def test_noise(spark):
    log = "2024-01-15 10:30:45\nreal data line\n████████░░ 80%\nConnecting to host...\nanother real line\n-------------------"
    assert clean(spark, log) == ("real data line\nanother real line", {"timestamp": 1, "progress_bar": 1, "status_msg": 1, "separator": 1})
    assert clean(spark, "[ERROR] something broke\n[INFO]") == ("[ERROR] something broke\n[INFO]", {})
    assert clean(spark, "[ERROR] x\n[INFO]", NoiseConfig(drop_log_levels=True)) == ("[ERROR] x", {"log_level": 1})
    assert clean(spark, "a\n\n\n\nb") == ("a\n\nb", {"blank_line": 2})
    assert clean(spark, "a\n\n\n\nb", NoiseConfig(collapse_blank_lines=False))[0] == "a\n\n\n\nb"
    assert clean(spark, "a\n\nConnecting\n\nb")[0] == "a\n\n\nb"
    assert clean(spark, "connections\nROWS AFFECTED: 3\nfoo\n  at x.y(z)\n at x", NoiseConfig(extra_patterns=[("^fo+$", "foo")])) == ("connections\n at x", {"sql_stats": 1, "foo": 1, "stack_frame": 1})
    assert clean(spark, "Connecting") == ("", {"status_msg": 1})
    assert clean(spark, "") == ("", {}) and clean(spark, None) == (None, None)
    assert clean(spark, "rows affected\x85x\r")[0] == ""


def test_noise_all_off(spark):
    off = NoiseConfig(False, False, False, False, False, False, False)
    assert clean(spark, "-----\n\n\n50%", off) == ("-----\n\n\n50%", {})


def test_exact_dedup(spark):
    run = lambda t, **k: one(dedup.drop_exact(frame(spark, t), "text", "n", **k), "text", "n")
    assert run("port 22 open\nport 22 open\nport 22 open\nunique line") == ("port 22 open  [x3]\nunique line", 2)
    assert run("  a\na  ") == ("  a  [x2]", 1)
    assert run("a\na", annotate=False) == ("a", 1)
    assert run("__blank__x\ny\n \n\ny") == ("\ny  [x2]\n\n", 1)
    assert run("") == ("", 0) and run(None) == (None, None)


def test_near_dedup(spark):
    run = lambda t, thr: one(dedup.drop_near(frame(spark, t), "text", "n", thr), "text", "n")
    assert run("the server returned an error code 500\nthe server returned an error code 501", 0.8) == ("the server returned an error code 500", 1)
    a, b = "x" * 23, "x" * 25
    assert run(f"{a}\n{b}", 0.92) == (f"{a}\n{b}", 0)


def test_matcher_bounds_change_nothing():
    rnd = random.Random(1)
    for _ in range(300):
        a = "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 260)))
        b = "".join(c if rnd.random() < 0.95 else rnd.choice("abcd") for c in a)
        assert fold.similar(a, b, 0.9) == (SequenceMatcher(None, a, b).ratio() >= 0.9)


def test_literals(spark):
    run = lambda t, limit=120, keep=60: one(trim.trim_literals(frame(spark, t), "text", "n", limit, keep), "text", "n")
    assert run('{"ua": "' + "x" * 300 + '"}') == ('{"ua": "' + "x" * 60 + '… [+240 chars]"}', 1)
    assert run('"' + "x" * 65 + "\n" + "x" * 65 + '"')[1] == 1
    assert run('"abcdefg"', 5, 10) == ('"abcdefg… [+-3 chars]"', 1)
    assert run('a "b" "c\\"d" e "open') == ('a "b" "c\\"d" e "open', 0)
    assert run('"' + "\\x" * 100_000 + '"')[1] == 1
    assert run("") == ("", 0) and run(None) == (None, None)


def test_tables_and_prefixes(spark):
    rows = "\n".join(f"| host{i} | open |" for i in range(30))
    assert one(trim.trim_tables(frame(spark, rows), "text", "n", 5), "text", "n") == ("\n".join(rows.split("\n")[:5]) + "\n… (+25 more rows)", 25)
    mixed = "x\n| a\n| b\n| c\ny\n| d\n| e"
    assert one(trim.trim_tables(frame(spark, mixed), "text", "n", 2), "text") == "x\n| a\n| b\n… (+1 more rows)\ny\n| d\n| e"
    items = "\n".join(["- item"] * 30)
    assert one(trim.trim_tables(frame(spark, items), "text", "n", 5), "text", "n") == (items, 0)
    assert one(trim.trim_tables(frame(spark, ""), "text", "n", 5), "text", "n") == ("", 0)
    done = trim.trim_detail(frame(spark, "2024-01-15 10:30:45.123 - pid=42 - thread_id=7 - Error: boom"), "text", "d")
    assert one(done, "text", "d") == ("Error: boom", {"log_meta_stripped": 1, "table_rows_trimmed": 0, "strings_trimmed": 0})
    assert "log_meta_stripped" not in one(trim.trim_detail(frame(spark, "x"), "text", "d", TrimConfig(strip_log_metadata=False)), "d")


def test_phrases(spark):
    run = lambda t: one(phrases.remove_repeats(frame(spark, t), "text", "d"), "text", "d")
    long = "I have already queried the database for results."
    assert run(f"{long}\nother text here is fine\n{long}") == (f"{long}\nother text here is fine", {"phrases_removed": 1})
    assert run("Short one.  Another short.")[0] == "Short one. Another short."
    assert run(f"{long} \n{long} ")[0] == f"{long} \n"
    assert run("")[0] == "" and run(None) == (None, None)


def test_phrase_window_forgets_resemblance():
    base = "the quick brown fox number jumps over the lazy dog again and again today"
    near = base.replace("today", "todaz")
    fill = [f"filler sentence {i * 7919} with its own {i * 104729} words {i}" for i in range(70)]
    assert fold.without_repeats("\n".join([base, near]))[1] == 1
    assert near in fold.without_repeats("\n".join([base, *fill, near]))[0]
    assert fold.without_repeats("\n".join([base, *fill, base]))[1] >= 1


def test_candidate_pairs_lose_nothing(spark):
    rnd = random.Random(4)
    words = [f"w{i}" for i in range(14)]
    rows = [(d, "\n".join(" ".join(rnd.sample(words, rnd.randint(8, 12))) + " endword" for _ in range(25))) for d in range(4)]
    got = {tuple(r) for r in phrases.candidate_pairs(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()}
    want = set()
    for d, t in rows:
        norms = sorted({x for x in t.split("\n") if len(x) >= 20})
        for i, a in enumerate(norms):
            for b in norms[i + 1 :]:
                x, y = set(a.split()), set(b.split())
                if not fold.lengths_differ(len(a), len(b), 0.9) and len(x & y) / len(x | y) >= 0.8:
                    want.add((d, a, b))
    assert got == want


def test_json(spark):
    cap = lambda t, **k: jsonshape.reshape_text(t, TrimConfig(**k))
    import json

    text, ok = cap('{"a": {"b": {"c": {"d": 1}}}, "items": [1,2,3,4,5,6]}', max_json_depth=2, max_list_items=3)
    assert ok and json.loads(text) == {"a": {"b": "{… 1 keys}"}, "items": [1, 2, 3, "… (+3 more items)"]}
    assert json.loads(cap('{"a": "' + "y" * 200 + '"}', max_json_depth=1)[0])["a"] == "y" * 200
    assert cap('{"a":1,"a":2}') == ('{\n  "a": 2\n}', True)
    assert cap("NaN") == ("NaN", True) and cap("5") == ("5", True) and cap("nope") == ("nope", False)
    assert cap("[" * 100_000)[1] is False
    done = plan.compress_json(frame(spark, "Connecting...\nthis is not json\nthis is not json\n", None))
    assert [r.compressed for r in done.orderBy("doc_id").collect()] == ["this is not json  [x2]\n", None]


SCAN = """[!] SQL Injection found at https://shop.local/search?q=test (CVE-2024-2117)
SQL injection https://shop.local/item?id=42
https://shop.local/feedback?msg=hello reflected XSS
Stored cross-site scripting https://shop.local/profile/bio
remote code execution at https://shop.local/ping?host=8.8.8.8
[!] Weak password policy on admin portal
default credentials at https://shop.local/admin
[!] Cleartext password transmission over http on login form
10.0.0.5 port 22 open
10.0.0.5 port 80 open
10.0.0.5 port 443 open"""


def test_brief(spark):
    want = """【Security Scan Summary】

Detected 11 findings across 6 categories.

🔴 SQL Injection [CRITICAL]: 2  (CVE-2024-2117)
    1. https://shop.local/search?q=test
    2. https://shop.local/item?id=42

🔴 Command Injection [CRITICAL]: 1
    1. https://shop.local/ping?host=8.8.8.8

🟠 Cross-Site Scripting (XSS) [HIGH]: 2
    1. https://shop.local/feedback?msg=hello
    2. https://shop.local/profile/bio

🟠 Sensitive Data / Cleartext [HIGH]: 1
    1. [!] Cleartext password transmission over http on login form

🟡 Weak / Default Credentials [MEDIUM]: 2
    1. [!] Weak password policy on admin portal
    2. https://shop.local/admin

🟢 Open Port / Service [LOW]: 3
    1. 10.0.0.5
    … and 2 more
"""
    assert one(plan.compress_scan(frame(spark, SCAN), examples=2), "compressed") == want
    assert one(plan.compress_scan(frame(spark, "everything looks fine here")), "compressed") == "【Security Scan Summary】\nNo recognizable findings detected."
    assert one(plan.compress_scan(frame(spark, None)), "compressed") is None


@pytest.mark.parametrize(
    ("line", "label"),
    [("data source reloaded", "Command Injection"), ("opentcp", None), ("open 53/tcp", "Open Port / Service"), ("sqlite", None), ("foo sqli", "SQL Injection"), ("xssx", None), ("../etc", "Path Traversal"), ("End-of-life os", "Outdated Component"), ("insecure  config", "Misconfiguration")],
)
def test_rules(spark, line, label):
    rows = findings.classify(frame(spark, line), "doc_id", "text").collect()
    assert [r.label for r in rows] == ([label] if label else [])


def test_summaries(spark):
    sents = [f"Sentence number {i} speaks of topic {i % 5} and nothing else." for i in range(60)]
    text = "\n\n".join(sents)
    done = plan.compress(frame(spark, text), config=CompressionConfig(target_ratio=0.2, enable_noise_filter=False, enable_redundancy_filter=False, enable_detail_trim=False, enable_pattern_remover=False))
    r = done.first()
    assert [s.name for s in r.stats.stages] == ["extractive"] and r.stats.token_ratio < 1
    assert len(r.compressed.split("\n")) == 12
    assert rank.summarize_text("a\nb\nc") == "a\nb\nc" and rank.summarize_text("") == ""
    assert rank.summarize_text("A x.\n\nB x.\n\nC x.\n\nD x.\n\nE x.", 0.5).count("\n") == 1
    assert rank.summarize_text("\n\n".join(sents), 0.5, max_sentences=3).count("\n") == 2


def slow_scores(sents):
    """Rank by plain loops over dictionaries."""
    bags = []
    for s in sents:
        bag = {}
        for w in rank._WORD.findall(s):
            if w.lower() not in rank._STOP:
                bag[w.lower()] = bag.get(w.lower(), 0) + 1
        bags.append(bag)
    n = len(sents)
    size = [sum(v * v for v in b.values()) ** 0.5 for b in bags]
    w = [[0.0 if i == j or not bags[i] or not bags[j] else sum(v * bags[j].get(k, 0) for k, v in bags[i].items()) / (size[i] * size[j]) for j in range(n)] for i in range(n)]
    total = []
    for i in range(n):
        t = 0.0
        for j in range(n):
            t += w[i][j]
        total.append(t)
    score = [1 / n] * n
    for _ in range(30):
        new = []
        for i in range(n):
            acc = 0.0
            for j in range(n):
                if j != i and total[j]:
                    acc += w[j][i] / total[j] * score[j]
            new.append((1 - 0.85) / n + 0.85 * acc)
        score = new
    return score


def test_scores_equal_plain_loops(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).collect()]
    for t in texts:
        sents = rank.split(t)[:40]
        if sents:
            assert rank.scores(sents).tolist() == slow_scores(sents)


def test_tokens(spark):
    rows = frame(spark, "abcd", "abcde", "a_b!", "\xa0", "", None).select("doc_id", X.tokens(F.col("text")).alias("n")).orderBy("doc_id").collect()
    assert [r.n for r in rows] == [1, 2, 2, 0, 0, None]


def test_pipeline_goldens(spark):
    log = "\n".join(["2024-01-15 10:30:45 [INFO] heartbeat ok\nConnecting to upstream...\nport 22 open"] * 200) + "\nCRITICAL: disk almost full on /var"
    r = plan.compress(frame(spark, log)).first()
    assert r.compressed == "[INFO] heartbeat ok  [x200]\nport 22 open  [x200]\nCRITICAL: disk almost full on /var"
    assert r.stats.reduction_pct > 30 and [s.name for s in r.stats.stages] == ["noise", "detail_trim", "pattern", "redundancy"]
    before = r.stats.original_chars
    for s in r.stats.stages:
        assert s.chars_before == before and s.chars_removed == s.chars_before - s.chars_after
        before = s.chars_after
    assert before == len(r.compressed) == r.stats.compressed_chars
    empty = plan.compress(frame(spark, "")).first()
    assert empty.compressed == "" and empty.stats.reduction_pct == 0.0 and empty.stats.char_ratio == 1.0
    null = plan.compress(frame(spark, None)).first()
    assert null.compressed is None and null.stats is None


def test_presets_and_extra_stage(spark):
    docs = frame(spark, "A fine sentence about cats and dogs. " * 3 + "\n\nAnother one about birds.\n\nA third about fish.\n\nA fourth on trees.")
    for config in (CompressionConfig.aggressive(), CompressionConfig.conservative()):
        assert plan.compress(docs, config=config).first().stats.token_ratio < 1
    shout = [("shout", lambda df, t, d: df.withColumn(d, F.create_map(F.lit("n"), F.lit(1).cast("long"))).withColumn(t, F.upper(t)))]
    r = plan.compress(docs, extra_stages=shout).first()
    assert r.compressed.isupper() and r.stats.stages[-1].name == "shout"
    off = CompressionConfig(enable_noise_filter=False, enable_redundancy_filter=False, enable_detail_trim=False, enable_pattern_remover=False)
    assert plan.compress(frame(spark, "x  y"), config=off).first().compressed == "x  y"
    assert plan.compress(frame(spark, "a\na"), config=CompressionConfig(redundancy=RedundancyConfig(drop_exact_duplicates=False))).first().compressed == "a\na"


def test_benchmark_inputs(spark):
    done = {name: plan.compress(getattr(generators, name)(spark).withColumn("doc_id", F.lit(0))).first() for name in ("app_log", "scan_output", "agent_transcript")}
    detail = {name: {k: v for s in r.stats.stages for k, v in s.details.items()} for name, r in done.items()}
    log, scan, agent = detail["app_log"], detail["scan_output"], detail["agent_transcript"]
    assert (log["status_msg"], log["progress_bar"], log["log_meta_stripped"], log["phrases_removed"], log["exact_removed"]) == (100, 45, 400, 0, 0)
    assert (scan["log_meta_stripped"], scan["phrases_removed"], scan["exact_removed"]) == (1, 60, 0)
    assert (agent["phrases_removed"], agent["exact_removed"]) == (39, 0)
    assert [len(r.compressed.split("\n")) for r in done.values()] == [401, 310, 122]
    dump = plan.compress_json(generators.json_dump(spark)).first()
    assert len(dump.compressed.split("\n")) == 28 and dump.compressed.startswith("{  [x21]")


def test_sources_and_adapters(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\rthree \xff\n")
    assert documents.from_files(spark, str(tmp_path)).first().text == "one\ntwo\nthree �\n"
    docs = spark.createDataFrame([("Connecting to db...\nreal payload line\nreal payload line\n", "src"), (None, "none")], "body string, source string")
    got = documents.compress_documents(docs, "body").collect()
    assert got[0].body == "real payload line  [x2]\n" and got[0].source == "src" and got[0].compression.original_tokens > got[0].compression.compressed_tokens
    assert got[1].body is None and got[1].compression is None
    assert documents.compress_nodes(docs, "body").columns == ["body", "source"]
    documents.write_text(frame(spark, "x\ny").withColumn("compressed", F.col("text")), f"{tmp_path}/out")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/out").collect()) == ["x", "y"]


def test_cli(spark, tmp_path, capsys):
    from pithy.cli import main

    (tmp_path / "in.log").write_text("Connecting...\nrepeat\nrepeat\n")
    assert main([str(tmp_path / "in.log"), "--stats"], spark) == 0
    out, err = capsys.readouterr()
    assert out == "repeat  [x2]\n" and "tokens" in err
    (tmp_path / "scan").write_text(SCAN)
    assert main([str(tmp_path / "scan"), "--security"], spark) == 0
    assert "SQL Injection" in capsys.readouterr()[0]
    assert main([str(tmp_path / "in.log"), "--preset", "aggressive", "--target", "0.5"], spark) == 0


def test_default_plan_has_no_shuffle(spark, capsys):
    plan.compress(frame(spark, "x")).explain()
    assert "Exchange" not in capsys.readouterr().out


def test_generated_texts(spark):
    """Digests of the published inputs, and the lines that are left of the application log."""
    import hashlib

    digest = {name: hashlib.sha256(getattr(generators, name)(spark).first()["text"].encode()).hexdigest()[:12] for name in ("app_log", "scan_output", "agent_transcript", "json_dump")}
    paths = "/api/users /api/orders /health /login /api/cart /static/app.js /api/search /metrics /api/payments".split()
    log = []
    for i in range(400):
        log.append("2024-01-15 10:%02d:%02d [INFO] %s %s %d %dms %db uid=%d" % (i % 60, i * 7 % 60, ("GET", "POST")[i % 2], paths[i % 9], (200, 200, 200, 404, 500)[i % 5], i * 13 % 900 + 5, i * 31 % 4096, i % 97))
        log += ["Connecting to upstream service..."] * (i % 4 == 0) + ["[==========> ] %d%%" % (i % 10 * 10)] * (i % 9 == 0)
    log.append("ERROR: disk full on /var, write failed")
    assert digest["app_log"] == hashlib.sha256("\n".join(log).encode()).hexdigest()[:12]
    agent = []
    for i in range(120):
        topic = "orders payments inventory auth search billing".split()[i % 6]
        agent.append(f"Assistant: Step {i}: inspecting the {topic} service latency and comparing it against the {i * 3 % 500}ms baseline.")
        agent += ["Assistant: I have already queried the database for the relevant metrics."] * (i % 3 == 0)
    agent.append("Assistant: Final answer: the bottleneck is a missing index.")
    assert digest["agent_transcript"] == hashlib.sha256("\n".join(agent).encode()).hexdigest()[:12]
    assert len(set(digest.values())) == 4


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_edges_stay_in_their_document(spark, monkeypatch):
    """Only texts are shuffled, once; rows with equal ids are one document, and rows without an id have no edges."""
    rows = [(1, "Red fox runs. Blue fox sleeps.\n\nNo match here"), (2, "one"), (1, "Fox eats. İstanbul sleeps fox. ²x"), (None, "a b c. b c d."), (3, None), (4, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    done = rank.cosine_edges(df, "doc_id", "text")
    assert exchanges(done) == 1 and "Join" not in done._jdf.queryExecution().executedPlan().toString()
    bags = [Counter("red fox runs fox eats".split()), Counter(["blue", "fox", "sleeps", "İstanbul".lower(), "sleeps", "fox"]), Counter("no match here ²x".split())]
    norm = [math.sqrt(sum(n * n for n in bag.values())) for bag in bags]
    dot = sum(n * bags[1][w] for w, n in bags[0].items())
    want = [(1, 0, 1, dot / (norm[0] * norm[1]))]
    assert [tuple(r) for r in done.collect()] == want
    some = [rank.Terms() for _ in range(2)]
    for held, terms in zip((1, 1 << 20), some, strict=True):  # counts added up early and late
        monkeypatch.setattr(rank, "HELD_TERMS", held)
        for _, text in rows[:3]:
            terms.add(rank.split(text))
    assert [[*map(list, t.table())] for t in some][0] == [[*map(list, t.table())] for t in some][1]


def test_terms_are_counted_in_their_document(spark):
    """Only texts are shuffled, once; rows with equal ids are one document, also those without an id."""
    df = spark.createDataFrame([(1, "Fox fox. Dog"), (1, "A fox. Dog! Fox"), (None, "Fox"), (None, "dog. fox"), (2, None), (3, "the of")], "doc_id long, text string")
    done = rank.document_terms(df, "doc_id", "text")
    assert exchanges(done) == 1
    assert {tuple(r) for r in done.collect()} == {(1, "fox", 4, 2), (1, "dog", 2, 1), (None, "fox", 2, 2), (None, "dog", 1, 1)}
    assert {tuple(r) for r in rank.term_counts(df, "doc_id", "text").collect()} == {(1, 0, "fox", 3), (1, 1, "dog", 2), (1, 2, "fox", 1), (None, 0, "fox", 1), (None, 0, "dog", 1), (None, 1, "fox", 1)}


def test_matcher_stops_early(monkeypatch):
    """Answers are those of the whole ratio, and long lines that share no long block cost few searches."""
    rng = random.Random(5)
    calls = []
    find = SequenceMatcher.find_longest_match
    monkeypatch.setattr(SequenceMatcher, "find_longest_match", lambda self, *a: calls.append(a) or find(self, *a))
    whole = early = 0
    for k in range(400):
        a = "".join(rng.choice("abcdef ") for _ in range(rng.randrange(0, 300)))
        b = "".join(c for c in a if rng.random() > 0.04) if k % 2 else "".join(rng.sample(a, len(a)))
        for threshold in (0.0, 0.6, 0.92, 1.0):
            calls.clear()
            want = SequenceMatcher(None, a, b).ratio() >= threshold
            whole += len(calls)
            calls.clear()
            monkeypatch.setattr(fold, "SHORT", 4096 if k % 3 else 0)
            assert fold.similar(a, b, threshold) == want
            early += len(calls)
    assert early < whole / 4


@pytest.mark.parametrize("build", [lambda df: plan.compress(df), lambda df: plan.compress_json(df), lambda df: jsonshape.reshape(df, "text", "ok"), lambda df: dedup.drop_near(df, "text", "n"), lambda df: rank.summarize(df, "text"), lambda df: rank.rank_scores(df, "doc_id", "text")])
def test_workers_get_small_batches(spark, build):
    """Whatever the table, a worker holds a few megabytes of texts at a time."""
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    build(frame(spark, "some text."))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == 4 << 20


def test_strip_scans_no_text(spark):
    """All white space goes from both ends, as with Python's strings, by a trim that looks at the ends only."""
    spaces = [chr(c) for c in range(0x11000) if chr(c).isspace()]
    assert sorted(P.SPACES) == spaces
    made = [f"{c}{c} a{c}b\n{c}" for c in spaces] + ["", " ", "".join(spaces), "é​", "᠎x᠎"]
    done = frame(spark, *made).select("doc_id", "text", X.strip(F.col("text")).alias("t"), F.col("text").rlike(P.java(rf"\A{P.WS}*\z")).alias("blank"))
    assert all(r.t == r.text.strip() and r.blank == (not r.t) for r in done.collect())
    assert "regexp" not in done.select("t")._jdf.queryExecution().optimizedPlan().toString()
