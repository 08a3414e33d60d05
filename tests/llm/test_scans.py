"""License scans, periodic runs and conversation repair against brute force, and their edge cases."""

import glob
import hashlib
import os
import random
import re
import struct
import time
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from budgetsieve.llm import conversation_repair, html_text, license_scan, ogg_media, periodic_runs, queries

SPACE = " \t\n\x0b\f\r"


@pytest.mark.parametrize("name", ["op11_license_scan", "op12_periodic_runs", "op13_conversation_repair"])
def test_sql(spark, sf_dir, name):
    duck = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        duck.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = duck.sql(f"select {', '.join(got.columns)} from ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


# periodic runs


def brute_runs(words, least, exponent):
    n, out = len(words), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            size = i - s + q
            smaller = any(q % p == 0 and all(words[x] == words[x + p] for x in range(s, s + size - p)) for p in range(1, q))
            if size >= max(least, exponent * q) and not smaller:
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least, exponent", [(6, 4), (2, 2), (10, 3)])
def test_runs_against_brute_force(least, exponent):
    r = random.Random(exponent)
    for _ in range(400):
        group = []
        for _ in range(r.randint(1, 4)):
            n, letters = r.randint(0, 90), "abc"[: r.randint(1, 3)]
            words = [r.choice(letters) for _ in range(n)]
            if n and r.random() < 0.6:
                s = r.randrange(n)
                p = 1 + r.randrange((n - s) // 4 + 1)
                words = [words[i] if i < s else words[s + (i - s) % p] for i in range(n)]
            group.append(words)
        for words, (n, runs, kept) in zip(group, periodic_runs.runs_of_texts([" ".join(w) for w in group], least, exponent)):
            want = brute_runs(words, least, exponent)
            gone = {i for s, size, q in want for i in range(s + q, s + size)}
            assert (n, runs, kept) == (len(words), want, " ".join(w for i, w in enumerate(words) if i not in gone))


def test_bands_guarantee_their_grams():
    for least, exponent in ((6, 4), (2, 2), (30, 5)):
        want = 1
        for low, high, k in periodic_runs.bands(3_000, least, exponent):
            assert low == want and high <= k == min(max(least - q, (exponent - 1) * q) for q in range(low, high + 1))
            want = high + 1
        assert want > 3_000 // exponent


def test_long_runs(spark):
    texts = ["a " * 300_000, " ".join(f"w{i % 40_000}" for i in range(200_000)), " ".join(f"w{i}" for i in range(200_000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = periodic_runs.find_runs(docs).select("doc_id", "n_words", "runs", F.length("collapsed").alias("kept")).orderBy("doc_id").collect()
    assert [[tuple(x) for x in r["runs"]] for r in rows] == [[(0, 300_000, 1)], [(0, 200_000, 40_000)], []]
    assert rows[0]["kept"] == 1 and rows[1]["kept"] == sum(len(f"w{i}") + 1 for i in range(40_000)) - 1


def test_runs_on_odd_input(spark):
    rows = [(1, None, "x"), (None, "a a a a a a b", "y"), (2, "", "x"), (3, " \t\n", "x"), (1, "a b " * 4, "z"), (1, "a b " * 4, "z"), (4, "é é é é é é é", "x")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, runs string, n_chars int")
    got = periodic_runs.report(docs).collect()
    found = sorted((str(r["doc_id"]), r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"]) for r in got)
    assert sorted(found, key=str) == sorted([("1", 0, None, None, None, None), ("None", 1, 0, 6, 1, 6000), ("2", 0, None, None, None, None), ("3", 0, None, None, None, None), ("1", 1, 0, 8, 2, 4000), ("1", 1, 0, 8, 2, 4000), ("4", 0, None, None, None, None)], key=str)
    assert all(r["runs_sha256"] and r["collapsed_sha256"] for r in got)
    kept = periodic_runs.collapse(docs.drop("runs"))
    assert kept.columns == ["doc_id", "text", "n_chars"]
    assert sorted(map(str, (tuple(r) for r in kept.where("doc_id is null or doc_id = 1").collect()))) == sorted(map(str, [(1, None, 7), (None, "a b", 3), (1, "a b", 3), (1, "a b", 3)]))
    assert periodic_runs.report(docs.limit(0)).count() == 0


def test_planted_runs(spark):
    texts = {i: " ".join(f"w{k}" for k in range(i % 37)) for i in range(300)}
    docs = spark.createDataFrame([*texts.items(), (None, "a b")], "doc_id long, text string")
    want = []
    for i, t in texts.items():
        words, h = t.split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k if k < a else a + (k - a) % p] for k in range(n)]
        want.append((str(i), " ".join(words)))
    assert sorted((str(r[0]), r[1]) for r in periodic_runs.with_planted_runs(docs).collect()) == sorted([*want, ("None", "a b")])


# license scans

NOTICE = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"


def test_labels(spark):
    words = ["the", "license", "software", "of", "free", "general", "mit", "public", "cc", "nc"]
    r = random.Random(5)
    noise = lambda n: " ".join(r.choice(words) for _ in range(n))
    texts = [
        None, "", "  ", "The MIT License; mit-license\nMIT LICENSE", "pad " * 50 + NOTICE, noise(300) + ". " + NOTICE + " " + noise(300),
        "licensed under CC BY-NC 4.0.", "hereby granted free of charge", "Permission is hereby granted, free of charge " + "pad " * 40 + " to deal in the software without restriction",
        "mit licenſe mit licenKe MİT license", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Permission is hereby granted by ACME Limited and its heirs, free of charge", "mit license " * 3_000,
    ]
    docs = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(texts)], "doc_id long, text string, label string, n_words int")
    got = {r["doc_id"]: tuple(r)[1:] for r in license_scan.report(docs).collect()}
    assert got[0] == got[1] == got[2] == (0, 0, None, None, "", "", 0.0)
    assert got[3] == (7, 3, 1, 5, "mit", "mit", 1.0)
    assert got[4][1:] == (0, None, None, "", "mit", 1.0) and got[5][5] in ("mit", "gpl,mit")
    assert got[6] == (7, 0, None, None, "", "cc-by-nc", 1.0)
    assert got[7][5] == got[8][5] == got[11][5] == ""
    assert got[9] == (6, 0, None, None, "", "", 0.0)
    assert got[10][1:6] == (1, 12, 12, "gpl", "gpl")
    assert got[12] == (6_000, 3_000, 0, 5_998, "mit", "mit", 1.0)


def test_scan_loses_no_base_phrase(spark):
    r = random.Random(9)
    words = ["mit", "license", "apache", "general", "public", "x", "é", "MIT", "License"]
    texts = [r.choice(["", "-", ". "]) + "".join(r.choice(words) + r.choice([" ", "\n", ", ", "-"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string")
    base = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
    want = []
    for i, t in enumerate(texts):
        found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(k, label) for phrase, label in base.items() for k in range(len(found)) if found[k : k + len(phrase.split())] == phrase.split()]
        places = [k for k, _ in at]
        want.append((i if i % 9 else None, len(found), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))))
    got = license_scan.report(docs).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert license_scan.report(docs.limit(0)).count() == 0


def test_own_templates_and_counts(spark):
    docs = spark.createDataFrame([(1, "red green blue here"), (2, "green"), (3, "green red"), (3, "green blue")], "doc_id long, text string")
    counts = {r["word"]: r["n_docs"] for r in license_scan.document_frequency(docs, ["red", "green", "blue", "none"]).collect()}
    assert counts == {"red": 2, "green": 4, "blue": 2}
    mine = license_scan.Template("own", "a red green blue", ("red green", "green blue"), slack=0)
    assert license_scan.rare_words([mine], counts) == [["blue", "red", "green"]]
    found = license_scan.scan(docs, [mine]).where("size(licenses) > 0").collect()
    assert [(r["doc_id"], r["licenses"][0]["starts"], r["licenses"][0]["share"]) for r in found] == [(1, [-1], 0.75)]


def test_scan_is_native(spark, sf_dir):
    plan = queries.QUERIES["op11_license_scan"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# conversation repair


def brute_repair(rows):
    space = lambda v: " " if v is None else v
    convs, out = {}, {}
    for c, t, role, text in rows:
        role, text = space(role), space(text)
        h = zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20
        turns = convs.setdefault(c, [])
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            turns += [(t, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    after = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    names = {"u": "user", "a": "assistant"}
    for c, turns in convs.items():
        turns.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.sha256(v[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in turns:
            bare = text.strip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        rest = {"": (0, "", []), "a": (0, "", [])}
        for i in range(len(turns), -1, -1):
            now = dict(rest) if i == len(turns) else {}
            for s in ("", "s", "u", "a") if i < len(turns) else ():
                (_, role, text), fault = turns[i], faults[i]
                ways = [(rest[s][0] + 2, "D" + rest[s][1], rest[s][2])]
                if fault not in ("blank", "duplicate"):
                    more = 5 * (fault == "truncated")
                    if (y := after.get((s, role[:1]))) is not None:
                        ways.append((rest[y][0] + more, "K" + rest[y][1], [f"{role}:{text}", *rest[y][2]]))
                    ways += [(rest[y][0] + more + 1, "R" + rest[y][1], [f"{names[x]}:{text}", *rest[y][2]]) for x in "ua" if (y := after.get((s, x))) is not None]
                now[s] = min(ways, key=lambda w: w[:2])
            for _ in range(3):
                for (s, x), y in after.items():
                    if x in names and y in now:
                        way = (now[y][0] + 5, "I" + now[y][1], [f"{names[x]}:", *now[y][2]])
                        if s not in now or way[:2] < now[s][:2]:
                            now[s] = way
            rest = now
        cost, audit, lines = rest[""]
        ts = [t for t, _, _ in turns if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(turns, turns[1:])]
        out[c] = (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, *[faults.count(x) for x in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("n, convs, bits", [(400, 40, 2), (250, 3, 1)])
def test_repair_against_brute_force(spark, n, convs, bits):
    r = random.Random(n)
    roles, texts = ["user", "assistant", "system", "tool", None, "user", "assistant", ""], ["a.", "b!", "c", "  ", "", None, "d?", "e. ", "fé.\n"]
    rows = [(r.choice([None, *range(convs)]), r.choice([None, *range(n // convs + 2)]), r.choice(roles), r.choice(texts), "x") for _ in range(n)]
    rows += [(convs, i, r.choice(roles[:3]), f"x{i // 2}" + r.choice(".!?a"), "x") for i in range(100)]
    got = conversation_repair.report(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, cost string"), bits).select(COLUMNS).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == brute_repair([x[:4] for x in rows])


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Q?"), (1, 2, "user", "Q?"), (2, 0, "system", "S."), (3, 0, "user", "A."), (3, 1, "user", "B.")]
    found = conversation_repair.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), bits=1)
    assert {r["conv_id"]: (r["audit"], r["cost"]) for r in found.report.collect()} == {1: ("RRD", 4), 2: ("D", 2), 3: ("KR", 1)}
    turns = [tuple(r) for r in found.turns.orderBy("conv_id", "place", "nth").select("conv_id", "role", "text").collect()]
    assert turns == [(1, "user", "Hi."), (1, "assistant", "Q?"), (3, "user", "A."), (3, "assistant", "B.")]


def test_repair_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert conversation_repair.report(none).select(COLUMNS).count() == 0
    lost = next(t for t in range(100) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    one = conversation_repair.report(spark.createDataFrame([(5, lost, "user", "a.")], "conv_id long, turn long, role string, text string")).select(COLUMNS).collect()
    assert [tuple(r) for r in one] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# pages


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><p>See <a href="/hidden-gems">Hidden gems</a> here</p></article>', ["See Hidden gems here"]),
        ('<p title="the hidden cost">cost text</p>', ["cost text"]),
        ('<p data-id="comment">body</p>', ["body"]),
        ('<article><h2 id="related-work">Related work</h2><section id="comment-on-method">x y</section></article>', ["Related work", "x y"]),
        ('<main><div class="share-price">12</div><div class="comments">bad</div><div id="ads">buy</div></main>', ["12"]),
        ("<div hidden>q</div><div class=ad>z</div><div aria-hidden = 'true'>w</div>ok", ["ok"]),
        ("<p class='a \"hidden\" b'>kept</p><p title=\"'\" hidden>gone</p>", ["kept"]),
    ],
)
def test_attributes_are_names_outside_quotes(page, text):
    assert [t for t, _ in html_text.blocks_of(page)] == text


@pytest.mark.parametrize("bits", [1 << 29, 40])
def test_common_lines_against_table(monkeypatch, bits):
    monkeypatch.setattr(html_text, "ALIGNED_BITS", bits)
    r = random.Random(bits)
    for _ in range(500):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 18))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = html_text.common_lines(a, b)
        rest = iter(b)
        assert len(found) == best[-1][-1] and all(a[k] in rest for k in sorted(found))


def test_pages_in_linear_time():
    began = time.time()
    html_text.common_lines(["x"] * 30_000 + ["q"], ["y"] + ["x"] * 30_000)
    assert html_text.blocks_of("<script></script>x " * 60_000) == [("x", 0)] * 60_000
    assert time.time() - began < 10


# media


def test_hostile_media(spark):
    """Well-formed pages with odd contents are errors of their file, not of the job."""
    head = lambda rate, total: struct.pack("<8sIHHQ", b"PCM     ", rate, 8, 1, total)
    of = lambda *packets, serial=7: b"".join(ogg_media.pages_of(list(packets), serial))
    good = ogg_media.store("text")[0]
    files = [
        of((head(8000, 0), 0)), of((head(0, 4), 0), (b"abcd", 4)), of((head(8000, 0), 0), (b"", 0)), of((head(8000, 4), 0), (b"abcd", 3)), of((b"PCM     ", 0)),
        of((head(8000, 4), 0), (b"abcd", 4)) + of((b"TEXT    \xff\xfe", 0), serial=8), good[:-1], b"", b"OggS", good,
    ]
    media = spark.createDataFrame([(i, 4, bytearray(m)) for i, m in enumerate(files)], "doc_id long, n_bytes long, media binary")
    rows = {r["doc_id"]: r for r in ogg_media.media_features(media).collect()}
    assert all(rows[i]["error"] and rows[i]["feature"] is None for i in range(len(files) - 1))
    assert rows[len(files) - 1]["error"] is None and rows[len(files) - 1]["payload_bytes"] == 192
