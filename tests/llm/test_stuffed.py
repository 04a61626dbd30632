"""Stuffed pages: the parts of the model, and held-out pages of known kinds."""

from __future__ import annotations

import random

import numpy as np
import pytest

from waymark.llm import stuffed as s

PLACES = ["甲山市", "乙川町", "丙谷村", "丁田町"]
WORDS = ["温泉", "駐車場", "キャンプ", "林道情報", "絶景", "紅葉"]


def prose(rnd):
    parts = []
    for _ in range(rnd.randrange(3, 9)):
        place, number = rnd.choice(PLACES), rnd.randrange(2, 900)
        parts.append(rnd.choice([f"{place}の資料によると、入口から{number}mのところで路面が崩れている。", f"この道は{place}にあり、延長はおよそ{number}kmである。", f"帰り道に、{place}の職員から復旧は{number}日後になると聞いた。", f"標高{number}mを越えると、反対側は下りが続く。", "The road leaves the village near a bridge and climbs for about 4.5 km. "]))
    return "".join(parts)


def log(rnd):
    return prose(rnd) + "\n" + "".join(f"{rnd.randrange(10, 20)}:{rnd.randrange(10, 60)} 36.{rnd.randrange(10000, 99999)},138.{rnd.randrange(10000, 99999)} {rnd.randrange(100, 2000)}m\n" for _ in range(12)) + prose(rnd)


def table(rnd):
    return prose(rnd) + "\n" + "".join(f"山川線\t{rnd.choice(PLACES)}\t{rnd.randrange(10, 2000)}m\tR{rnd.randrange(7, 12)}\n" for _ in range(12)) + prose(rnd)


def spam(rnd):
    n = rnd.randrange(25, 60)
    word, place = (lambda: rnd.choice(WORDS)), (lambda: rnd.choice(PLACES))
    kinds = [
        lambda: "".join(rnd.choice([word() * 3, word() + "★", word() + " "]) for _ in range(n)),
        lambda: "".join(f'<a href="https://x.example/{k}">{word()}</a>\n' for k in range(n)),
        lambda: "、".join(f"{word()}({rnd.randrange(500)})" for _ in range(n)),
        lambda: "".join(f"https://x.example/{rnd.randrange(9999)}\n" for _ in range(n)),
        lambda: ", ".join(f"{word()} SKU{rnd.randrange(9999)}" for _ in range(n)),
        lambda: "".join(f"{place()}で{word()}！{word()}は{place()}、{word()}も{place()}！" for _ in range(n // 2)),
        lambda: " ".join(f"{place()} {word()}" for _ in range(n)) + " 。",
    ]
    return rnd.choice(kinds)()


def corpus(seed, n):
    rnd = random.Random(seed)
    kinds = [prose] * 8 + [log, table]
    return [rnd.choice(kinds)(rnd) for _ in range(n)], [spam(rnd) for _ in range(n // 12)]


def flagged(spark, texts):
    df = spark.createDataFrame([(k, t, "x", 0.0) for k, t in texts], "doc_id long, text string, key string, odd_share double")
    return {r.doc_id for r in s.stuffed_pages(df).collect()}


def test_known_kinds(spark):
    good, bad = corpus(1, 400)
    mixed = prose(random.Random(9)) + "\n関連: 温泉 | 駐車場\nhttps://x.example/1"
    texts = [*enumerate(good), *((1000 + k, t) for k, t in enumerate(bad)), (2000, mixed), (3000, None), (3001, ""), (3002, " \n "), (None, bad[0]), (1000, bad[0]), (4000, good[0] * 2000)]
    got = flagged(spark, texts)
    wrong = {k for k in got if k is not None and k < 1000} | (got & {2000, 3000, 3001, 3002, 4000})
    assert not wrong
    found = sum(k in got for k in range(1000, 1000 + len(bad)))
    assert found >= 0.95 * len(bad)
    assert None in got


def test_keywords_in_sentences_are_found_however_many(spark):
    rnd = random.Random(4)
    good, _ = corpus(2, 200)

    def page():
        pairs = [(rnd.choice(PLACES), rnd.choice(WORDS), rnd.choice(WORDS)) for _ in range(12)]
        return "".join(f"{p}の{a}なら{p}の{b}。{p} {a} {b} {a}をお探しの方は{p}の{a}へ。" for p, a, b in pairs)

    texts = [*enumerate(good), *((1000 + k, page()) for k in range(80))]
    assert flagged(spark, texts) == set(range(1000, 1080))


def test_copies_teach_nothing(spark):
    good, _ = corpus(3, 200)
    odd = "".join(f"{a}へ{b}をへ、もで{a}がとがへ{b}に。" for a, b in zip(WORDS, reversed(WORDS), strict=True))
    texts = [*enumerate(good), *((1000 + k, odd) for k in range(60))]
    assert flagged(spark, texts) == set(range(1000, 1060))


def test_own_variety():
    assert s.own_variety("甲山市の温泉なら乙川町の紅葉。") == s.own_variety("温泉\t温泉\t温泉") == s.own_variety("") == 0
    assert s.own_variety("温泉の温泉による温泉。") == pytest.approx(np.log(1 / 3))


def test_no_prose(spark):
    assert flagged(spark, [(1, "温泉 " * 30), (2, None)]) == set()
    assert flagged(spark, []) == set()


def test_segments():
    assert s.segments("一つ。二つ。\n三つ\nEnd here. Next 2.5 km.") == ["一つ。", "二つ。\n", "三つ\n", "End here. ", "Next 2.5 km."]
    assert s.segments("") == []
    assert "".join(s.segments("a！b\nc。d")) == "a！b\nc。d"


def test_sequence():
    ids = s._ids()
    assert s.sequence("道は12kmである。") == [ids["kanji1"], ids["ja:は"], ids["num"], ids["word"], ids["ja:である"], ids["sign:。"]]
    assert s.sequence("The road") == [ids["en:the"], ids["word"]]
    assert s.sequence("https://x.example/a b")[0] == ids["url"]
    flat, sizes = s.sequences(["道は", "", "12:30 36.1,138.2\n"])
    assert sizes.tolist() == [2, 0, 4]
    assert flat.tolist() == [ids["kanji1"], ids["ja:は"], ids["num"], ids["sp"], ids["num"], ids["nl"]]


def test_perplexity_prefers_what_was_counted():
    counts = np.zeros(1 << s.SLOT_BITS)
    s.count_grams(*s.sequences(["道は谷にある。", "川は山にある。"] * 20), counts)
    usual, odd = s.perplexities(*s.sequences(["森は谷にある。", "谷谷 谷 、谷"]), counts)
    assert usual < 0.5 < 2 < odd


def test_long_tags_and_equal_segments():
    tag = '<div class="' + "a b " * 200 + '">'
    assert s.sequence(tag) == s.sequence("<b>")
    assert len(s.sequence(tag)) == 1
    # Equal segments, one within the prose and one after it, are not one.
    parts = ["この道は車で通れる。", "\t", "この道は広くて良い。", "\t"]
    assert s.prose_places(parts) == [0, 1, 2]


def test_prose_part():
    parts = s.segments("これは道の話である。\n12:30 36.1,138.2 900m\n関連: 温泉\nここで道は終わりである。\n温泉 | 駐車場\n")
    assert s.prose_part(parts) == [parts[0], parts[1], parts[3]]
    assert s.prose_part(["温泉 ", "駐車場"]) == []


@pytest.mark.parametrize("text", ["a", "。", "\n", "<" * 500, "あ" * 50_000, "퟿\x00"])
def test_any_text(text):
    flat, sizes, chars, train = s.text_shapes([text])[0]
    assert len(sizes) == len(chars) == 4 * len(train)
    assert len(flat) == 2 * np.frombuffer(sizes, dtype=np.int32).sum()
