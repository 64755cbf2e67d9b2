import base64
from array import array
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brackwater.llm import mixing, tokenizer
from brackwater.shared import table


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    lines = (Path(tokenizer.TOKENIZER_DIR) / "byte_bpe_50k.tiktoken").read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def machine():
    return tokenizer.automaton(f"{tokenizer.TOKENIZER_DIR}/{tokenizer.VOCABULARY}")


def encode(machine, text):
    out = array("i")
    machine.encode(text, out)
    return list(out)


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text("abcdehlnorst '", max_size=60), st.text(" \n\t\r", max_size=20), st.text("가나다라한국어äöüß😀́", max_size=30)))
def test_like_reference(machine, reference, text):
    ids = encode(machine, text)
    assert ids == reference.encode_ordinary(text)
    assert machine.decode(ids).decode() == text


def test_repeated_letters_and_special_strings(machine, reference):
    for text in ("a" * 3_001, "aaa aaaa", "=" * 100, "<|endoftext|>", "don't they'll I'M", " 　 x"):
        assert encode(machine, text) == reference.encode_ordinary(text)


def test_table(spark, sf, reference):
    docs = table(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = {r["doc_id"]: r["ids"] for r in tokenizer.ids(docs).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in texts.items()}
    back = {r["doc_id"]: r["text"] for r in tokenizer.decoded(tokenizer.ids(docs)).collect()}
    assert back == {i: t or "" for i, t in texts.items()}


SCHEMA = "doc_id long, text string, source string, ids string, n_tokens string, copies string"


def test_tokens_edge_cases(spark):
    df = spark.createDataFrame([(1, None, None, "c", "c", "c"), (1, "", None, "c", "c", "c"), (None, "a a", None, "c", "c", "c"), (2, "word " * 30_000, None, "c", "c", "c"), (2, " ", None, "c", "c", "c")], SCHEMA)
    rows = [(r["doc_id"], len(r["ids"])) for r in tokenizer.ids(df).collect()]
    assert sorted(rows, key=str) == sorted([(1, 0), (1, 0), (None, 2), (2, 30_001), (2, 1)], key=str)
    assert tokenizer.ids(spark.createDataFrame([], SCHEMA)).count() == 0


def test_shares(spark, sf):
    docs, mix = table(spark, sf, "documents"), table(spark, sf, "mix_targets")
    got = {r["source"]: r for r in mixing.shares(docs, mix).collect()}
    sizes = tokenizer.counts(docs, ["source"])
    total = sizes.agg(F.sum("n_tokens")).first()[0]
    has = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    longest = sizes.agg(F.max("n_tokens")).first()[0]
    for r in mix.collect():
        quota = min(r["target_share"] * total, r["max_repeats"] * has.get(r["source"], 0))
        assert abs(got[r["source"]]["tokens"] - quota) <= longest and got[r["source"]]["most_copies"] <= r["max_repeats"]
    assert abs(sum(r["real_share"] for r in got.values()) - 1) < 1e-9
    rows = mixing.mixture(docs, mix)
    assert rows.exceptAll(mixing.mixture(docs, mix)).count() == 0 and rows.where("copies < 1").count() == 0


def test_mixture_edge_cases(spark):
    text = lambda n: "a" + " a" * (n - 1)
    docs = spark.createDataFrame([(i, text(10), "big", "c", "c", "c") for i in range(1_000)] + [(2_000 + i, text(5), "small", "c", "c", "c") for i in range(20)]
                                 + [(5_000, text(50), None, "c", "c", "c"), (5_001, None, "big", "c", "c", "c"), (5_002, "", "small", "c", "c", "c"), (None, text(10), "big", "c", "c", "c"), (5_003, text(7), "other", "c", "c", "c")], SCHEMA)
    mix = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("none", 0.0, 5), ("gone", None, None), (None, 0.3, 2), ("big", 0.5, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r for r in mixing.shares(docs, mix).collect()}
    total = 10_010 + 100 + 50 + 7
    assert abs(got["big"]["tokens"] - total / 2) <= 10 and got["small"]["tokens"] == 300 and got["small"]["most_copies"] == 3
    assert got["none"]["tokens"] == 0 and got["gone"]["tokens"] == 0
    per = mixing.mixture(docs, mix).groupBy("source").agg(F.count("*").alias("n"), F.max("copies").alias("m")).collect()
    assert {(r["source"], r["m"]) for r in per} == {("big", 1), ("small", 3)}
    nothing = spark.createDataFrame([], SCHEMA)
    assert mixing.mixture(nothing, mix).count() == 0 and mixing.shares(nothing, mix).where("tokens > 0").count() == 0


def test_draw_in_proportion_to_size(spark):
    text = lambda n: "a" + " a" * (n - 1)
    docs = spark.createDataFrame([(i, text(1 + 9 * (i % 2)), "s", "c", "c", "c") for i in range(4_000)] + [(9_000, text(4_000), "s", "c", "c", "c"), (9_001, text(5_000), "t", "c", "c", "c")], SCHEMA)
    mix = spark.createDataFrame([("s", 0.4, 1), ("t", 0.1, 1)], "source string, target_share double, max_repeats int")
    rows = mixing.mixture(docs, mix).where("source = 's'").collect()
    taken = {n: sum(r["n_tokens"] == n for r in rows) for n in (1, 10, 4_000)}
    rest = 0.4 * (2_000 + 20_000 + 4_000 + 5_000) - 4_000
    c = rest / (2_000 + 200_000)
    assert taken[4_000] == 1  # larger than any share of the draw: certain
    assert abs(taken[1] - 2_000 * c) < 4 * (2_000 * c) ** 0.5 and abs(taken[10] - 20_000 * c) < 4 * (20_000 * c) ** 0.5
    assert abs(sum(r["n_tokens"] for r in rows) - rest - 4_000) <= 10
