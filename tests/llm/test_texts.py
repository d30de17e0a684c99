"""Problems 8, 9 and 10."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadloom.llm import leak, mix, split, tokens

RNG = random.Random(5)
WORDS = ["".join(RNG.choice("bcdfgklmnprst") + RNG.choice("aeiou") for _ in range(3)) for _ in range(900)]
ITEM = [WORDS[i] for i in range(40)]


def item_rows(spark):
    return spark.createDataFrame([(1, " ".join(ITEM), "t"), (2, " ".join(WORDS[100:170]), "t"), (3, None, "t"), (4, "too short", "t"), (5, "", "t")], "item_id long, text string, doc_id string")


def leaks(spark, texts, items=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as t")
    return {(r["item_id"], r["doc_id"]) for r in leak.find_leaks(df, "doc_id", "text", items if items is not None else item_rows(spark), "item_id", "text").collect()}


def test_leaks(spark):
    noise = lambda n: " ".join(RNG.choice(WORDS[300:]) for _ in range(n))
    marked = "<p>" + "</b> <b class='x'>".join(w.upper() + "&nbsp;" for w in ITEM[8:32]) + "</p>"
    changed = [*ITEM[:10], "oddword", *ITEM[11:20], *ITEM[21:28]]
    shuffled = ITEM[:]
    RNG.shuffle(shuffled)
    texts = [
        noise(300) + " " + " ".join(ITEM[5:28]) + " " + noise(300), marked, "> " + "\n> ".join(ITEM), f"{noise(5)} {' '.join(changed)}", noise(3000) + " " + " ".join(WORDS[100:170]) + " " + noise(9000),
        " ".join(ITEM[:12]) + noise(50), " ".join(shuffled), noise(200), None, "", " ", " ".join(ITEM), "x" * 200_000,
    ]
    want = {(1, 0), (1, 1), (1, 2), (1, 3), (2, 4), (1, 11)}
    assert leaks(spark, texts) == want
    assert leaks(spark, texts, item_rows(spark).limit(0)) == set()


def test_several_passes(spark, monkeypatch):
    rng = random.Random(8)
    stock = WORDS[700:712]
    bodies = [rng.sample(WORDS[:600], 30) for _ in range(16)]
    items = spark.createDataFrame([(i, " ".join(b[:8] + stock + b[8:])) for i, b in enumerate(bodies)], "item_id long, text string")
    texts = []
    for b in bodies * 3:
        cut = (b[:8] + stock + b[8:])[(at := rng.randrange(20)) : at + rng.randint(18, 30)]
        for _ in range(rng.randrange(6)):
            cut[rng.randrange(len(cut))] = rng.choice(WORDS)
        texts.append(" ".join(rng.choices(WORDS, k=40) + cut + rng.choices(WORDS, k=40)))
    one = leaks(spark, texts, items)
    monkeypatch.setattr(leak, "MAX_ITEMS", 2)
    assert leaks(spark, texts, items) == one and len(one) > 10


def test_stock_wording_is_no_case(spark):
    stock = WORDS[700:720]
    own = [WORDS[16 * i : 16 * i + 16] for i in range(40)]
    items = spark.createDataFrame([(i, " ".join(w[:8] + stock + w[8:])) for i, w in enumerate(own)], "item_id long, text string")
    texts = [" ".join(WORDS[880:] + stock + WORDS[860:880]), " ".join(WORDS[880:] + own[3][:8] + stock + own[3][8:]), " ".join(own[5][2:8] + stock + own[5][8:10])]
    assert leaks(spark, texts, items) == {(3, 1), (5, 2)}


def test_long_tags_are_no_words():
    assert leak.words("<a href='" + "x " * 400 + "'>One</a> TWO &lt;b&gt;three") == ["one", "two", "three"]


def test_multi_index_finds_every_near_fingerprint():
    rng = np.random.default_rng(1)
    index = leak.ItemIndex([(i, " ".join(rng.choice(WORDS, 40))) for i in range(30)])
    for size, (rows, prints, tables) in index.classes.items():
        flips = np.zeros((len(prints), 64), np.uint8)
        for r in flips:
            r[rng.choice(64, leak.RADIUS, replace=False)] = 1
        near = prints ^ (np.packbits(flips, axis=1).reshape(-1, 4, 2).astype(np.uint16) @ np.array([256, 1], np.uint16))
        for k, v in enumerate(near):
            hits = {int(o) for b, (starts, owner) in enumerate(tables) for o in owner[starts[v[b]] : starts[int(v[b]) + 1]]}
            assert k in hits


@pytest.fixture(scope="module")
def enc():
    return tokens.encoder(tokens.load())


@pytest.mark.parametrize("text", ["a" * 9000, " " * 6000, "é" * 6000, "日本語" * 1500, "😀" * 900, "\n" * 7000, "a b " * 3000, "Word here. " * 900, "line of words\n" * 800, "para of words.\n\n" * 700])
def test_pieces_round_trip(enc, text):
    got = split.pieces(text, enc, 300, 40)
    assert len(got) > 1 and "".join(text[f:b] for _, f, b, _, _ in got) == text
    assert all(a <= f < b and n <= 300 for a, f, b, n, _ in got)
    assert all(len(enc.encode_ordinary(text[a:b])) == n for a, _, b, n, _ in got)


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="ab .\nçé😀", min_size=200, max_size=1500), st.integers(20, 80), st.integers(0, 30))
def test_pieces_property(text, limit, overlap):
    enc = tokens.encoder(tokens.load())
    got = split.pieces(text, enc, limit, overlap)
    if len(enc.encode_ordinary(text)) <= limit:
        assert got == []
    else:
        assert "".join(text[f:b] for _, f, b, _, _ in got) == text and all(n <= limit for *_, n, _ in got)


def test_cut_at_topic_change(enc):
    a, b = ("cats purr softly while sleeping cats. " * 12).strip(), ("engines need regular fresh engine oil. " * 12).strip()
    cut = split.pieces(a + "\n" + b, enc, 150, 0)
    assert cut[0][2] == len(a) + 1 and cut[0][4] == "line"


def test_deepest_valley_beats_a_paragraph_end(enc):
    # a paragraph end inside one topic, a plain sentence end where the topic changes
    cats, oil = "cats purr softly while sleeping cats. ", "engines need regular fresh engine oil. "
    text = cats * 8 + "\n\n" + cats * 6 + oil * 16
    cut = split.pieces(text, enc, 150, 0)
    assert cut[0][2] == len(cats) * 14 + 2 and cut[0][4] == "sentence"


def test_planted_topic_changes(enc):
    rng = random.Random(4)
    right = total = 0
    for _ in range(40):
        topics = [rng.sample(WORDS, 14) for _ in range(6)]
        parts = [" ".join(" ".join(rng.choices(t, k=9)).capitalize() + "." for _ in range(rng.randint(9, 13))) for t in topics]
        text, ends = " ".join(parts), set(np.cumsum([len(p) + 1 for p in parts]).tolist())
        for _, _, end, _, kind in split.pieces(text, enc, 700, 0)[:-1]:
            total += 1
            right += end in ends
    assert total > 30 and right / total > 0.8


def test_split_documents(spark):
    df = spark.createDataFrame([(1, "word " * 4000, 5), (2, "short", 5), (3, None, 5), (4, "", 5), (1, "word " * 4000, 5)], "doc_id long, text string, piece_no int")
    got = split.split_documents(df, "doc_id", "text")
    assert {r["id"] for r in got.collect()} == {1} and got.where("piece_no = 0").count() == 2
    assert split.split_documents(df.limit(0), "doc_id", "text").count() == 0


def test_pivotal_keeps_mass():
    rng = np.random.default_rng(3)
    size, p = rng.integers(1, 500, 4000).astype(float), np.full(4000, 0.37)
    rest = p.copy()
    out, hold = mix.pivotal(rest, size, rng.random(4000))
    taken = out.astype(float)
    if hold >= 0:
        taken[hold] = rest[hold]
    assert abs((taken * size).sum() - (p * size).sum()) < 1e-6 * size.sum()
    mean = np.zeros(30)
    for s in range(400):
        r = np.random.default_rng(s)
        out, hold = mix.pivotal(pp := np.full(30, 0.3), np.arange(1, 31).astype(float), r.random(30))
        mean += np.where(out < 0, pp, out)
    assert abs(mean / 400 - 0.3).max() < 0.12


def test_tree_of_residuals(spark, monkeypatch):
    monkeypatch.setattr(mix, "ROWS_PER_TASK", 50)
    monkeypatch.setattr(mix, "FAN", 3)  # 1,000 rows: 20 tasks, 7, 3 and 1 nodes
    made = []
    keep = mix.runtime.materialize
    monkeypatch.setattr(mix.runtime, "materialize", lambda df, name: made.append((name, keep(df, name))) or made[-1][1])
    sizes = spark.range(500).selectExpr("id", "if(id % 2 = 0, 'a', 'b') as source", "id % 90 + 1 as n")
    targets = spark.createDataFrame([(m, s, w, 1) for m, w in (("x", 2.0), ("y", 1.0)) for s, w in (("a", w), ("b", 1.0))], "mix_name string, source string, weight double, max_repeats int")
    chosen, report = mix.select_mix(sizes, targets, total=6000.0)
    assert [name for name, _ in made].count("residuals") == 3
    left = [df.where("taken < 0").groupBy("mix_name", "source").count().agg({"count": "max"}).first()[0] for name, df in made if name in ("rounded", "residuals")]
    assert left[0] > left[1] >= left[2] and (left[3] or 0) <= 1
    for r in report.collect():  # less than one document, the largest of which has 90 tokens
        assert abs(r["mixed_tokens"] - 6000 * r["target_share"]) < 90 and r["most_copies"] <= r["max_repeats"]
    assert chosen.count() == chosen.select("mix_name", "id").distinct().count()


def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mix, "ROWS_PER_TASK", 200)
    sizes = spark.range(2000).selectExpr("id", "case when id % 10 = 0 then 'small' when id % 97 = 1 then null else 'big' end as source", "id % 50 + 1 as n", "'x' as mix_name")
    targets = spark.createDataFrame([("m", "small", 1.0, 3), ("m", "big", 3.0, 1), ("m", "none", 1.0, 1), ("m", "zero", None, 1), ("e", "none", 1.0, 2), (None, "big", 1.0, 1)], "mix_name string, source string, weight double, max_repeats int")
    chosen, report = mix.select_mix(sizes.drop("mix_name"), targets)
    r = {(x["mix_name"], x["source"]): x for x in report.collect()}
    assert abs(r["m", "small"]["actual_share"] * 3 - r["m", "big"]["actual_share"]) < 0.02 and r["m", "small"]["most_copies"] == 3
    assert r["m", "none"]["mixed_tokens"] == 0 and r["e", "none"]["actual_share"] == 0 and r["m", "big"]["most_copies"] == 1
    assert sorted(chosen.collect()) == sorted(mix.select_mix(sizes.drop("mix_name"), targets)[0].collect())
    chosen, report = mix.select_mix(sizes.drop("mix_name").limit(0), targets)
    assert chosen.count() == 0 and report.count() == 5
