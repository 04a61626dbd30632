"""Text that looks the same but differs in its characters, in one consistent form.

Method: values are mapped sign by sign to what a reader sees (``plain``), then to a skeleton in which kana and
kanji of one shape are one sign. In SQL the distinct values are grouped by skeleton under the accent-sensitive
collation ``UNICODE``, which also makes canonically equivalent texts and texts that differ in ignorable signs
one. A deterministic member of each class is its canonical form, and it is joined back.

Which of two twins (``ロ`` or ``口``) belongs in a place is learned from all values: a run of kana is a word if it is
common, more so than the same run with kanji for twins, and not just a word with a twin beside it; twins inside a word
are kana, others are what isolated twins mostly are in the whole corpus. The canonical member is the member that has every twin where it belongs and no unusual sign;
if there is none, that form itself.

Defined results: null stays null; an empty text is its own form; letter case, old and new forms of kanji, linking
kana and ordinary signs are kept; repeated values are one class, so a value that fills a third of all rows is one
row in every step but the last join, where its form is broadcast.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..operators.skew import join_to_lookup
from ..session import cut_lineage

#: Signs that show nothing. Format signs come by their category; these are the others.
INVISIBLE_OTHERS = "͏ᅟᅠ឴឵ㅤﾠ" + "".join(map(chr, [*range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]))
#: Capital letters of other scripts drawn like Latin ones; the small ones follow their capitals.
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX")
CYRILLIC = ("АВЕЅІЈКМНОРСТУХ", "ABESIJKMHOPCTYX")
#: Signs drawn like a usual one.
SIGNS = ("‐‑‒–—−﹘﹣·∙•‧⋅᛫･｡｢｣’‘‛′“”″", "--------・・・・・・・。「」''''\"\"\"")
#: Radicals that stand for a whole kanji and that Unicode gives no decomposition for.
RADICALS = ("⺁⺄⺇⺈⺊⺎⺏⺐⺒⺓⺔⺖⺘⺙⺛⺜⺝⺞⺠⺡⺢⺣⺤⺥⺦⺧⺨⺩⺫⺬⺭⺯⺰⺱⺲⺶⺸⺹⺺⺼⺾⻀⻁⻂⻃⻄⻅⻆⻈⻉⻋⻍⻎⻏⻐⻑⻒⻓⻔⻖⻘⻙⻚⻛⻜⻝⻟⻠⻢⻣⻤⻥⻦⻧⻨⻩⻪⻫⻬⻭⻮⻯⻰⻱⻲", "厂乙几刀卜兀尣尢巳幺彑忄扌攵旡日月歺民氵氺灬爫爫丬牛犭王罒示礻糹纟罓罒羊羋耂肀肉艹艹虎衤覀西见角讠贝车辶辶阝钅長镸长门阝青韦页风飞食飠饣马骨鬼鱼鸟卤麦黄黾斉齐歯齿竜龙龜亀")
#: Kana and kanji of one shape.
TWIN_KANA, TWIN_KANJI = "ロハタニエトカミチオヌー", "口八夕二工卜力三千才又一"
#: Ordinary signs between which a word goes on.
NOISE = r" \-.,*・()「」『』。、_/'\""
#: A run of kana is a word if such a share of the distinct values has it, and so many of them as the least evidence, if
#: more values have it than its skeleton with kanji,
WORD_SHARE, WORD_SUPPORT = 2e-5, 5
#: has at most so many signs,
LONGEST_WORD = 32
#: and if no word with a twin beside it explains it, that is, none that is so many times as common.
WORD_RATIO = 10

#: Signs that ``plain`` leaves as they are: ASCII, kana without marks of their own, kanji and Japanese stops.
ORDINARY = r"\x00-\x7fぁ-ゖァ-ヺー一-鿿、。・「」『』"

COMPOSED_SOUND, COMPOSED_HALF = "゙", "゚"


@cache
def sign_map() -> tuple[str, str]:
    """From and to texts for ``translate``: signs with one usual sign, then those that show nothing."""
    table: dict[str, str] = {}
    ranges = [(0xA0, 0xA1), (0xB2, 0xB4), (0xB9, 0xBA), (0x1680, 0x1681), (0x2000, 0x200B), (0x202F, 0x2030), (0x205F, 0x2060), (0x2070, 0x209D), (0x2100, 0x2150), (0x2E80, 0x2FE0), (0x3000, 0x3001), (0x3036, 0x303B), (0xF900, 0xFB00), (0xFF01, 0xFFF0), (0x1D400, 0x1D800), (0x2F800, 0x2FA20)]
    for low, high in ranges:
        for code in range(low, high):
            sign, usual = chr(code), unicodedata.normalize("NFKC", chr(code))
            if sign != usual and len(usual) == 1:
                table[sign] = usual
    for off, on in (GREEK, CYRILLIC):
        table |= dict(zip(off + off.lower(), on + on.lower(), strict=True))
    for off, on in (SIGNS, RADICALS):
        table |= dict(zip(off, on, strict=True))
    table |= {"゛": COMPOSED_SOUND, "゜": COMPOSED_HALF, "ﾞ": COMPOSED_SOUND, "ﾟ": COMPOSED_HALF}
    hidden = INVISIBLE_OTHERS + "".join(chr(c) for c in range(0x80, 0xE0080) if unicodedata.category(chr(c)) == "Cf" and not 0x600 <= c <= 0x8E2 and c not in (0x110BD, 0x110CD))
    table = {k: v for k, v in table.items() if k not in hidden}
    return "".join(table) + hidden, "".join(table.values())


@cache
def voiced() -> dict[str, tuple[str, str]]:
    """For each combining mark the kana it joins and what they become."""
    out = {}
    for mark in (COMPOSED_SOUND, COMPOSED_HALF):
        pairs = [(chr(c), unicodedata.normalize("NFC", chr(c) + mark)) for c in range(0x3041, 0x30FF)]
        pairs = [(a, b) for a, b in pairs if len(b) == 1]
        out[mark] = ("".join(a for a, _ in pairs), "".join(b for _, b in pairs))
    return out


def plain(text: Column) -> Column:
    """``text`` with the usual sign for each sign, whatever stands beside it, and without invisible ones.

    Texts of ordinary signs alone, which are most, are only searched.
    """
    off, on = sign_map()

    def mapped(text: Column) -> Column:
        text = F.translate(text, off, on)
        for mark, (base, whole) in voiced().items():
            text = _composed(text, mark, base, whole)
        return text

    return let(text, lambda t: F.when(t.rlike(f"[^{ORDINARY}]"), mapped(t)).otherwise(t))


def _composed(text: Column, mark: str, base: str, whole: str) -> Column:
    return let(text, lambda t: F.when(F.contains(t, F.lit(mark)), _compose(t, mark, base, whole)).otherwise(t))


def _compose(text: Column, mark: str, base: str, whole: str) -> Column:
    def joined(parts: Column) -> Column:
        last = F.size(parts) - 1
        return F.array_join(F.transform(parts, lambda p, i: F.when(i < last, F.concat(F.substring(p, F.lit(1), F.length(p) - 1), F.translate(F.right(p, F.lit(1)), base, whole))).otherwise(p)), "")

    return let(F.split(text, mark), joined)


def skeleton(text: Column) -> Column:
    """``plain`` text in which twins are one sign, the kana."""
    return F.translate(text, TWIN_KANJI, TWIN_KANA)


def kana_words(values: DataFrame, support: int = WORD_SUPPORT, ratio: int = WORD_RATIO) -> DataFrame:
    """``word``: runs of kana common among the distinct texts ``value`` and mostly written in kana, in skeleton form.

    A run is compared with what has its skeleton between the same neighbours, that is no kana, but holds a kanji.
    """
    compact = F.regexp_replace("value", f"[{NOISE}]", "")
    places = values.select(F.monotonically_increasing_id().alias("id"), F.explode(F.array_distinct(F.regexp_extract_all(compact, F.lit(f"([ァ-ヶー{TWIN_KANJI}]{{2,}})"), F.lit(1)))).alias("place"))
    units = F.regexp_extract_all("place", F.lit(f"([ァ-ヶー]+|[{TWIN_KANJI}])"), F.lit(1))
    spelled = places.select("id", units.alias("u")).select("id", F.explode(F.expr(f"flatten(transform(sequence(1, size(u)), a -> transform(sequence(1, least({LONGEST_WORD}, size(u) - a + 1)), n -> array_join(slice(u, a, n), ''))))")).alias("spelling"))
    spelled = spelled.select("id", F.translate("spelling", TWIN_KANJI, TWIN_KANA).alias("word"), "spelling").filter(F.length("word").between(2, LONGEST_WORD))
    # A word must hold a kana that is no twin, else two kanji in a row might be taken for one.
    spelled = spelled.filter(F.translate("word", TWIN_KANA, "") != "").select("id", "word", (F.col("spelling") == F.col("word")).alias("kana")).distinct()
    counts = spelled.groupBy("word").agg(F.count_if("kana").alias("n"), F.count_if(~F.col("kana")).alias("other"))
    least = values.agg(F.greatest(F.lit(support), F.count("*") * WORD_SHARE).alias("least"))
    counts = counts.filter("n > other").join(F.broadcast(least), F.col("n") >= F.col("least")).select("word", "n")
    # Read three times below; words are few against the values they come from.
    counts = cut_lineage(counts)
    cut = F.expr("filter(array(substring(word, 2), left(word, length(word) - 1)), (p, i) -> length(p) > 1)")
    beside = F.array(F.left("word", F.lit(1)), F.right("word", F.lit(1)))
    shorter = counts.select("word", "n", F.explode(F.arrays_zip(cut.alias("part"), beside.alias("sign"))).alias("z")).select("word", "n", "z.part", "z.sign")
    shorter = shorter.filter((F.translate("sign", TWIN_KANA, "") == "") & F.col("sign").isNotNull() & F.col("part").isNotNull())
    explained = shorter.join(counts.select(F.col("word").alias("part"), F.col("n").alias("m")), "part").filter(F.col("m") >= ratio * F.col("n"))
    return counts.join(explained.select("word").distinct(), "word", "left_anti").select("word")


def _hidden_twins() -> str:
    return "".join(chr(0xE000 + k) for k in range(len(TWIN_KANA)))


def settled(values: DataFrame, words: DataFrame) -> DataFrame:
    """``(skeleton, usual)`` for each distinct skeleton of ``(value, skeleton)``: the form with every twin where it belongs."""
    shapes = values.select("skeleton").distinct()
    shapes = shapes.withColumn("compact", F.regexp_replace("skeleton", f"[{NOISE}]", ""))
    twin = f"[{TWIN_KANA}]"
    open_shapes = shapes.filter(F.col("compact").rlike(twin))
    runs = open_shapes.select("skeleton", F.explode(F.regexp_extract_all("compact", F.lit("([ァ-ヶー]{2,})"), F.lit(1))).alias("run")).distinct()
    pieces = runs.select("skeleton", F.explode(F.expr(f"array_distinct(flatten(transform(sequence(1, length(run) - 1), a -> transform(sequence(2, least({LONGEST_WORD}, length(run) - a + 1)), n -> substring(run, a, n)))))")).alias("word"))
    held = pieces.join(words, "word").groupBy("skeleton").agg(F.sort_array(F.collect_set(F.struct((-F.length("word")).alias("n"), "word"))).alias("words"))
    hidden = _hidden_twins()
    text = open_shapes.join(held, "skeleton", "left")
    marked = F.coalesce(F.aggregate("words", F.col("compact"), lambda s, w: F.replace(s, w["word"], F.translate(w["word"], TWIN_KANA, hidden))), F.col("compact"))
    text = cut_lineage(text.select("skeleton", "compact", marked.alias("marked")))
    kanji = isolated_as_kanji(values, text)
    base = "".join(kanji.get(k, k) for k in TWIN_KANA)
    usual = F.translate(F.translate("marked", TWIN_KANA, base), hidden, TWIN_KANA)
    # The noise goes back where it stood.
    noise = f"[{NOISE}]"
    put_back = F.aggregate(F.split("skeleton", ""), F.struct(F.lit(0).alias("k"), F.lit("").alias("t")), lambda acc, c: F.when((c == "") | c.rlike(noise), F.struct(acc["k"].alias("k"), F.concat(acc["t"], c).alias("t"))).otherwise(F.struct((acc["k"] + 1).alias("k"), F.concat(acc["t"], F.substring(F.col("settled"), acc["k"] + 1, F.lit(1))).alias("t"))), lambda acc: acc["t"])
    done = text.select("skeleton", usual.alias("settled")).select("skeleton", put_back.alias("usual"))
    rest = shapes.filter(~F.col("compact").rlike(twin)).select("skeleton", F.col("skeleton").alias("usual"))
    return done.unionByName(rest)


def isolated_as_kanji(values: DataFrame, text: DataFrame) -> dict[str, str]:
    """For each twin kana its kanji, if outside words the kanji is what the values mostly hold (12 rows at most)."""
    stored = values.join(text.select("skeleton", "marked"), "skeleton")
    stored = stored.select(F.regexp_replace("value", f"[{NOISE}]", "").alias("value"), "marked")
    signs = stored.select(F.explode(F.arrays_zip(F.split("value", "").alias("stored"), F.split("marked", "").alias("marked"))).alias("z")).select("z.stored", "z.marked")
    counts = signs.filter(F.col("marked").isin(list(TWIN_KANA))).groupBy("stored").agg(F.count("*").alias("n"))
    n = {r.stored: r.n for r in counts.collect()}
    return {a: b for a, b in zip(TWIN_KANA, TWIN_KANJI, strict=True) if n.get(b, 0) > n.get(a, 0)}


def canonical_forms(names: DataFrame) -> DataFrame:
    """``(name, canonical)`` for each distinct non-null ``name``."""
    spark = names.sparkSession
    # These are read many times; cut here, signs are mapped once and plans stay small.
    stored = names.filter("name IS NOT NULL").select("name").distinct().withColumn("value", plain(F.col("name")))
    stored = cut_lineage(stored.withColumn("skeleton", skeleton(F.col("value"))))
    values = stored.select("value", "skeleton").distinct()
    shapes = settled(values, kana_words(values))
    members = cut_lineage(stored.drop("value").join(shapes, "skeleton"))
    # In SQL: a class is a skeleton under the collation; its canonical form is the member that is in the least
    # unusual form of the class, or that form where no member is.
    return spark.sql(
        """
        WITH members AS (SELECT name, usual, skeleton COLLATE UNICODE AS class FROM {members}),
        classes AS (SELECT class, min_by(usual, struct(length(usual), usual)) AS usual FROM members GROUP BY class),
        chosen AS (
          SELECT c.class, c.usual, min(CASE WHEN m.name = c.usual THEN m.name END) AS member
          FROM classes c JOIN members m ON m.class = c.class GROUP BY c.class, c.usual
        )
        SELECT m.name, coalesce(c.member, c.usual) AS canonical FROM members m JOIN chosen c ON m.class = c.class
        """,
        members=members,
    )


def in_one_form(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with ``canonical`` (set anew if there), the consistent form of column ``name``; null where the name is null.

    The forms of names that hold a large share of the rows are broadcast, the others joined by a shuffle.
    """
    forms = canonical_forms(rows.select(F.col(name).alias("name"))).withColumnRenamed("name", name)
    return join_to_lookup(rows.drop("canonical"), forms, name, "left")
