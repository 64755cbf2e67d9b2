import random
import re
from collections import defaultdict

from brackwater.llm import copies, spans
from brackwater.shared import table

FIELDS = "subj dev ts p1 p2 p3 p4 p5 p6 temp humid event".split()
NAME = re.compile(r"(?i)(?<![^\W_])(" + "|".join(FIELDS) + r")[\])>”’\"'\s]*(?:->|=|:)")


def plain(text):
    found = list(NAME.finditer(text))
    out = {}
    for m, n in zip(found, [*found[1:], None], strict=True):
        v, f, o = text[m.end():n.start() if n else len(text)], m[1].lower(), ""
        for k, ch in enumerate(v):
            digit = v[k + 1:k + 2].isdigit()
            if ch.isalnum():
                o += ch.lower()
            elif f != "ts" and digit and (ch == "-" and not (k and v[k - 1].isalnum()) or ch == "." and k and v[k - 1].isdigit()):
                o += ch
        out[f] = o
    return tuple(out.get(f) for f in FIELDS)


def test_copies_like_brute_force(spark, sf):
    df = table(spark, sf, "upload_records")
    groups = defaultdict(list)
    for r in df.select("record_id", "full_text").collect():
        if r["full_text"] and any(x is not None for x in plain(r["full_text"])):
            groups[plain(r["full_text"])].append(r["record_id"])
    want = {(min(g), i) for g in groups.values() for i in g if i != min(g)}
    assert {tuple(r) for r in copies.grouped(df).collect()} == want and want
    kept = {r["kept_id"]: r["n_copies"] for r in copies.collapsed(df).collect()}
    assert sum(kept.values()) == df.count() and len(kept) == df.count() - len(want)


def test_copies_edge_cases(spark):
    schema = "record_id long, full_text string, kept_id string, _text string"
    rows = [(5, "subj=a,p1=1,temp=-2,event=x y"), (3, "EVENT: x-y; Temp: -2 ; P1 -> 1 ; <subj>=<A>"), (4, "subj=a,p1=1,temp=2,event=x y"), (6, "subj=a,p1=1,temp=-2,event="), (7, "subj=a,p1=1,temp=-2"), (8, "subj=1,p1=a,temp=-2,event=x y"),
            (9, None), (10, ""), (11, "nothing here"), (12, "nothing here"), (None, "subj=a,p1=1,temp=-2,event=x y"), (13, "temp=2.0"), (14, "temp=20"), (15, "temp=2.0 "), (16, "event=" + "z" * 100_000), (17, "event=" + "Z" * 100_000), (3, "subj=a,p1=1,temp=-2,event=x y")]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], schema)
    assert {tuple(r) for r in copies.grouped(df).collect()} == {(3, 5), (13, 15), (16, 17)}
    empty = spark.createDataFrame([], schema)
    assert copies.grouped(empty).count() == 0 and copies.collapsed(empty).count() == 0


def test_dress_of_letters_and_fields(spark):
    full = "subj=a{s}dev=1{s}ts=2025-01-02 03:04:05{s}p1=1{s}p2=2{s}p3=3{s}p4=4{s}p5=5{s}p6=6{s}temp=1.5{s}humid=2{s}event="
    same = [["night temp: check x", "Night Temp Check X"], ["ＡＢ strasse", "ab STRASSE", "AB Straße"], ["caf\u00e9 \ud55c", "cafe\u0301 \u1112\u1161\u11ab"], ["x, p1: 7", "x p1 7"], ["a <1> b", "A-1: b"]]
    rows = [(10 * g + i, full.format(s=[",", " | ", "\t"][i]) + text) for g, texts in enumerate(same) for i, text in enumerate(texts)]
    rows += [(100, "subj=a dev=1 ts=1 p1=1 p2=2 p3=3 p4=4 p5=5 p6=6 temp=1.5 humid=2 event=q"), (101, "SUBJ=a,dev=1,ts=1,p1=1,p2=2,p3=3,p4=4,p5=5,p6=6,temp=1.5,humid=2,event=q")]
    df = spark.createDataFrame(rows, "record_id long, full_text string")
    assert {tuple(r) for r in copies.grouped(df).collect()} == {(10 * g, 10 * g + i) for g, texts in enumerate(same) for i in range(1, len(texts))} | {(100, 101)}


def test_other_texts_of_a_record(spark):
    rows = [(1, "ts=2025-01-01 00:00:00,p1=1,p2=1,temp=-1", "A b"), (2, "TEMP: -1 | P2: 1 | TS: 2025/01/01 00:00:00 | P1: 1", "a-B"), (3, "ts=2025-01-01 00:00:00,p1=1,p2=1,temp=1", "ab."), (4, None, None), (5, "", "")]
    df = spark.createDataFrame(rows, "record_id long, st string, event_raw string")
    assert {tuple(r) for r in copies.grouped(df, text="st", fields=copies.ST_FIELDS).collect()} == {(1, 2)}
    assert {tuple(r) for r in copies.grouped(df, text="event_raw", fields=()).collect()} == {(1, 2), (1, 3)}


def test_multisets_and_collisions(spark, monkeypatch):
    cases = [(["a", "b"], ["b", "a"], True), (["a", "a", "b"], ["a", "b", "b"], False), (["a", "b", "a"], ["a", "a", "b"], True), (["a"], ["a", "a"], False), ([], [], True)]
    df = spark.createDataFrame(cases, "a array<string>, b array<string>, want boolean")
    assert all(r[0] == r[1] for r in df.select(copies.same_multiset(df["a"], df["b"]), "want").collect())
    from pyspark.sql import functions as F
    monkeypatch.setattr(copies, "fingerprint", lambda items: [F.lit(0).cast("long")] * 4)  # everything collides
    rows = [(1, "p1=1,p2=1"), (2, "p1=2,p2=1"), (3, "p2=1;p1=2"), (4, "p1=1,p2=1"), (5, "p1=3,p2=3"), (6, "p1=2,p1=1"), (7, "p1=1,p1=2")]
    df = spark.createDataFrame(rows, "record_id long, full_text string")
    assert {tuple(r) for r in copies.grouped(df).collect()} == {(1, 4), (2, 3), (6, 7)}


def covered(docs, span):
    seen = defaultdict(set)
    for i, t in docs:
        if i is not None and t:
            for s in range(len(t) - span + 1):
                seen[t[s:s + span]].add(i)
    out = set()
    for i, t in docs:
        at = [s for s in range(len(t or "") - span + 1) if i is not None and len(seen[t[s:s + span]]) > 1]
        k = 0
        while k < len(at):
            a = b = at[k]
            while k + 1 < len(at) and at[k + 1] <= b + span:
                k += 1
                b = at[k]
            out.add((i, a, b + span - a))
            k += 1
    return out


def test_spans_like_brute_force(spark, sf):
    df = table(spark, sf, "documents")
    want = covered([tuple(r) for r in df.select("doc_id", "text").collect()], spans.SPAN)
    assert {tuple(r) for r in spans.found(df).collect()} == want


def test_spans_edge_cases(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda n: "".join(rng.choice("abcdefgh 한글é😀") for _ in range(n))
    p, q = word(200), word(650)
    docs = [(1, word(50) + p + word(70) + q + word(3)), (2, q[:400] + word(30) + p), (3, word(199)), (4, None), (5, ""), (6, p[:199]), (7, q[100:350]), (7, q[100:350]), (8, "x" * 700), (9, "x" * 450), (10, "y" * 500), (10, "y" * 500), (None, q),
            (11, word(900_000) + q), (12, p + p)]
    schema = "doc_id long, text string, seed string, at string"
    df = spark.createDataFrame([(*d, "clash", "clash") for d in docs], schema)
    got = [tuple(r) for r in spans.found(df).collect()]
    small = [(i, t) for i, t in docs if i != 11] + [(11, docs[13][1][-1_000:])]
    want = {(i, s + (899_650 if i == 11 else 0), n) for i, s, n in covered(small, spans.SPAN)}
    assert set(got) == want and len(got) == len(want)
    shares = {r["doc_id"]: r["shared_share"] for r in spans.shares(df).collect()}
    assert shares[12] == 1.0 and shares[3] == 0.0 and shares[5] == 0.0
    empty = spark.createDataFrame([], schema)
    assert spans.found(empty).count() == 0
