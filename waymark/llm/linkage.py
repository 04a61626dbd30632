"""Rows of two tables on the same road, without a shared key.

Method: collective graph linkage. Entities (distinct name and municipality, on the map side per road ID) are nodes.
Candidate edges come from shared attributes of the names within a municipality and a number, letter or branch.
Meta-blocking prunes them: a name is looked up only by two of its rarest signs, out of as many as make it impossible to
miss a name with so few edits that it is a link, and edges below ``LINK`` go. Where a name has several candidates they
are weighted by the rarity of all pairs of neighbouring signs they share.

Scores are then refined from the neighbours until they are stable. Neighbours of a plan entity are the entities of the same
place whose names are a sure edge (``SURE``) from its own; each passes on what it has for the road it is itself best
linked to, half of its doubt being taken as a misspelling both share:
``score(e, r) = max(likeness(e, r), w(e, n) * (1 + score(n, r)) / 2)``. So a spelling can be linked over others that are
none of the map's, and a neighbour that belongs to another road speaks for that road. Scores only rise, each round is
worked out for what the round before has raised, and the last one is that in which nothing rises by ``STABLE``.

Roads of one name with other numbers, letters or branches, or in other municipalities, never share an attribute.
A municipality that is missing is taken from the row's source text, then from other rows of the same road ID;
entities without one are looked up by their whole name and linked only if that name belongs to one road.

Copies and reloads are one entity, so a name or municipality that holds a third of all rows is no hot group: blocks
hold distinct entities. Rows come back at the end by equi-joins.

Defined results: null and blank names link to nothing; ties between roads of exactly one name and municipality all
count; a row's weaker candidates don't; empty tables give no pairs.
"""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from ..session import cut_lineage
from .lookalikes import TWIN_KANA, TWIN_KANJI, plain

#: Edges of at least so high a likeness are links, and from there on they pass scores on.
LINK, SURE = 0.6, 0.79
FULL_LENGTH = 6
#: Scores that rise by less are stable.
STABLE = 0.01

_log = logging.getLogger(__name__)

#: Old or variant forms of kanji and the new ones.
OLD_KANJI = "澤瀧濱廣櫻嶽峯嶋嶌檜鹽邊邉齋齊國學體區醫驛圓應櫸會繪價畫擴覺樂觀關歸舊據擧曉勳縣嚴廣恆黃號齒實寫釋壽收從澁獸縱肅處敍將燒證條狀乘淨疊讓眞圖隨聲靜攝專戰淺潛錢禪雙總藏臟續墮對瀧擇澤單團彈晝鑄聽鎭鐵點傳黨當稻鬪讀惱發拜賣麥秡濱拂佛變辨寶豐萬滿默藥與豫餘樣搖謠來覽龍兩獵綠壘禮靈齡勞樓灣峽狹莖藝蠶櫃桝舘塚彌龜增德都神福祥"
NEW_KANJI = "沢滝浜広桜岳峰島島桧塩辺辺斎斉国学体区医駅円応欅会絵価画拡覚楽観関帰旧拠挙暁勲県厳広恒黄号歯実写釈寿収従渋獣縦粛処叙将焼証条状乗浄畳譲真図随声静摂専戦浅潜銭禅双総蔵臓続堕対滝択沢単団弾昼鋳聴鎮鉄点伝党当稲闘読悩発拝売麦祓浜払仏変弁宝豊万満黙薬与予余様揺謡来覧竜両猟緑塁礼霊齢労楼湾峡狭茎芸蚕櫃枡館塚弥亀増徳都神福祥"
#: Kana that link two parts of a name, by sound.
LINKING = ("ヶケヵカがか力之の", "ガガガガガガガノノ")
GENERIC = "林道"
NUMBERS = "一二三四五六七八九"
TAIL = rf"^(.*?)(?:第([0-9]+|[{NUMBERS}十]+)号?|([0-9]+|[{NUMBERS}十]+)号|([A-Z]))?(支)?線?$"


def folded_name(name: Column) -> Column:
    """Name without formatting, variants of signs and the generic word before or after it."""
    twins = dict(zip(TWIN_KANA, TWIN_KANJI, strict=True))
    twins.pop("カ")
    off, on = LINKING[0] + OLD_KANJI + "".join(twins), LINKING[1] + NEW_KANJI + "".join(twins.values())
    text = F.upper(F.regexp_replace(F.translate(plain(name), off, on), r"[^\p{L}\p{N}]", ""))
    return F.regexp_replace(text, f"^{GENERIC}|{GENERIC}$", "")


def _number(text: Column) -> Column:
    digits = F.translate(text, NUMBERS, "123456789")
    tens = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(digits, "^十$", "10"), "^十", "1"), "^(.)十$", "$10"), "十", "")
    return F.regexp_replace(tens, "^0+", "")


def name_parts(name: Column) -> Column:
    """``struct<stem, tail>``: the name proper, and the number, letter and branch it ends in."""

    def parts(text: Column) -> Column:
        piece = lambda k: F.regexp_extract(text, TAIL, k)
        return F.struct(piece(1).alias("stem"), F.concat_ws("/", _number(F.concat(piece(2), piece(3))), piece(4), piece(5)).alias("tail"))

    return let(folded_name(name), parts)


def municipality_key(text: Column) -> Column:
    """Municipality without prefecture, county and kind; null for none."""
    bare = F.regexp_replace(plain(text), r"(?U)[\s\p{P}]", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"^.{1,4}?[都道府県](?=.{2})", ""), r"^.{1,4}?郡(?=.{2})", "")
    bare = F.regexp_replace(bare, r"(?<=..)[市町村区]$", "")
    return F.when(bare != "", bare)


def municipality_keys(cell: Column) -> Column:
    """Sorted distinct municipalities of a cell."""
    pieces = F.split(plain(cell), r"[\s|/、,・;]+")
    return F.sort_array(F.array_distinct(F.filter(F.transform(pieces, municipality_key), lambda x: x.isNotNull())))


def edits(a: Column, b: Column) -> Column:
    """Edits between two short texts: signs put in, left out, replaced, or two neighbours that change places.

    No sign is edited twice (restricted transposition distance). Signs that one text has and the other lacks are a lower
    bound, the distance without transpositions an upper one; only where they differ the distance is worked out.
    """
    count = lambda t, c: F.length(t) - F.length(F.replace(t, c, F.lit("")))
    common = F.aggregate(F.array_distinct(F.split(a, "")), F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(count(a, c), count(b, c))))
    bounds = F.struct(F.levenshtein(a, b).alias("most"), (F.greatest(F.length(a), F.length(b)) - common).alias("least"))
    return let(bounds, lambda n: F.when(n["least"] == n["most"], n["most"]).otherwise(_transposed(a, b)))


def _transposed(a: Column, b: Column) -> Column:
    """The distance of ``edits`` row by row; neither text is empty."""
    sign = lambda t, k: F.substring(t, k, F.lit(1))
    first = F.sequence(F.lit(0), F.length(b))

    def cell(rows: Column, row: Column, i: Column, j: Column) -> Column:
        at = lambda r, k: F.get(r, k)
        replaced = at(rows["last"], j - 1) + F.when(sign(a, i) == sign(b, j), 0).otherwise(1)
        turned = (i > 1) & (j > 1) & (sign(a, i) == sign(b, j - 1)) & (sign(a, i - 1) == sign(b, j))
        return F.least(at(row, j - 1) + 1, at(rows["last"], j) + 1, replaced, F.when(turned, at(rows["before"], j - 2) + 1))

    def row(rows: Column, i: Column) -> Column:
        cells = F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), lambda r, j: F.array_append(r, cell(rows, r, i, j)))
        return F.struct(rows["last"].alias("before"), cells.alias("last"))

    return F.aggregate(F.sequence(F.lit(1), F.length(a)), F.struct(first.alias("before"), first.alias("last")), row, lambda rows: F.element_at(rows["last"], -1))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal texts, less by the share of signs edited, never below 0.

    From ``FULL_LENGTH`` signs on an edit costs the same, so a long common word doesn't make up for three edits.
    """
    scale = F.least(F.greatest(F.length(a), F.length(b), F.lit(1)), F.lit(FULL_LENGTH))
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - edits(a, b) / scale))


def _attributes(stem: Column) -> Column:
    padded = F.concat(F.lit("^"), stem, F.lit("$"))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(stem) + 1), lambda k: F.substring(padded, k, F.lit(2))))


def most_edits(length: Column | int) -> Column:
    """Edits that a link between texts of which the longer one has ``length`` signs may have."""
    scale = F.least(F.lit(length) if isinstance(length, int) else length, F.lit(FULL_LENGTH))
    return F.floor((1 - LINK) * scale + 1e-9).cast("int")


def _signs(stem: Column) -> Column:
    """The signs of a name, each with how often it stood so far, and its begin, which all names share."""

    def sign(k: Column) -> Column:
        c, before = F.substring(stem, k, F.lit(1)), F.left(stem, k)
        return F.concat(c, (F.length(before) - F.length(F.replace(before, c, F.lit("")))).cast("string"))

    return F.concat(F.array(F.lit("^")), F.transform(F.sequence(F.lit(1), F.length(stem)), sign))


def _rare_pairs(stems: DataFrame) -> DataFrame:
    """``(stem, pairs)``: the pairs among the rarest signs of each distinct ``stem``.

    With ``d`` edits all signs but ``d`` of the longer name are shared, as an edit changes one at most and a change of
    places none. So in any one order of all signs, the first ``d + 2`` of two such names share two.
    """
    signs = stems.select("stem", F.explode(_signs(F.col("stem"))).alias("sign"))
    known = signs.groupBy("sign").agg(F.count("*").alias("n"))
    ordered = signs.join(known, "sign").groupBy("stem").agg(F.sort_array(F.collect_list(F.struct("n", "sign"))).alias("signs"))
    ordered = ordered.select("stem", F.slice("signs.sign", F.lit(1), most_edits(F.length("stem")) + 2).alias("rare"))
    pairs = F.expr("flatten(transform(sequence(1, size(rare) - 1), i -> transform(slice(rare, i + 1, size(rare)), b -> concat(rare[i - 1], b))))")
    return ordered.select("stem", pairs.alias("pairs"))


def _place() -> Column:
    return F.xxhash64("muni", "tail").alias("place")


def _alike(names: DataFrame, aliases: DataFrame) -> DataFrame:
    """``(place, stem, alias)``: all pairs of ``(place, stem)`` and ``(place, alias)`` that are links."""
    aliases = aliases.withColumnRenamed("alias", "stem")
    pairs = cut_lineage(_rare_pairs(names.select("stem").union(aliases.select("stem")).distinct()))
    # Blocks travel as hashes: a chance collision costs one comparison.
    blocks = lambda df, *columns: df.join(pairs, "stem").select(*columns, "place", F.explode("pairs").alias("pair")).withColumn("block", F.xxhash64("place", "pair")).drop("pair")
    both = blocks(names, "stem").join(blocks(aliases, F.col("stem").alias("alias")), ["block", "place"])
    longest = F.greatest(F.length("stem"), F.length("alias"))
    near = (F.abs(F.length("stem") - F.length("alias")) <= most_edits(longest)) & (F.levenshtein("stem", "alias", 2 * int((1 - LINK) * FULL_LENGTH + 1e-9)) >= 0)
    both = both.filter(near).select("place", "stem", "alias").distinct()
    return both.withColumn("alike", likeness(F.col("stem"), F.col("alias"))).filter(F.col("alike") >= LINK)


def _with_entity(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with ``entity``, a digest of its columns long enough to stand for them."""
    texts = [F.array_join(c, "\x1e") if kind.startswith("array") else F.col(c) for c, kind in ((c, df.schema[c].dataType.simpleString()) for c in columns)]
    return df.withColumn("entity", F.unhex(F.md5(F.concat_ws("\x1f", *texts))))


def link(plan: DataFrame, mapped: DataFrame) -> DataFrame:
    """``(plan_row, map_row, confidence)`` of the pairs of rows on the same road.

    ``plan`` has ``plan_row, name, municipalities`` (text of one or more), ``mapped`` has ``map_row, road, name,
    municipality, source`` (text that may begin with the municipality).
    """
    plan = plan.select("plan_row", name_parts(F.col("name")).alias("n"), municipality_keys(F.coalesce(F.col("municipalities"), F.lit(""))).alias("munis"))
    plan = _with_entity(plan.select("plan_row", "n.stem", "n.tail", "munis").filter("stem <> ''"), ["stem", "tail", "munis"])
    named = F.regexp_extract("source", r"^\s*([^「『|\s]+)\s*[「『]", 1)
    mapped = mapped.select("map_row", "road", name_parts(F.col("name")).alias("n"), municipality_key(F.col("municipality")).alias("own"), municipality_key(named).alias("hinted"))
    mapped = mapped.filter("n.stem <> ''").select("map_row", F.coalesce(F.col("road"), F.concat(F.lit("row "), F.col("map_row").cast("string"))).alias("road"), "n.stem", "n.tail", F.coalesce("own", "hinted").alias("muni"))
    plan, mapped = cut_lineage(plan), cut_lineage(mapped)

    entities = plan.select("entity", "stem", "tail", "munis").distinct()
    spots = mapped.select("road", "stem", "tail", "muni").distinct()
    known = spots.filter("muni IS NOT NULL").groupBy("road").agg(F.min("muni").alias("other"), F.count_distinct("muni").alias("n")).filter("n = 1")
    spots = spots.join(known.select("road", "other"), "road", "left").select("road", "stem", "tail", F.coalesce("muni", "other").alias("muni")).distinct()

    looked = cut_lineage(entities.select("entity", "stem", "tail", F.explode("munis").alias("muni")).select("entity", "stem", "muni", "tail", _place()))
    edges = _candidates(looked, spots).unionByName(_without_municipality(entities, spots))
    links = _refined(cut_lineage(edges), looked)
    return _best(links).join(plan.select("entity", "plan_row"), "entity").join(mapped.select("road", "map_row"), "road").select("plan_row", "map_row", F.round("confidence", 4).alias("confidence"))


def _candidates(looked: DataFrame, spots: DataFrame) -> DataFrame:
    """``(entity, road, score, overlap)``: edges of likeness ``LINK`` between plan entities and roads."""
    placed = cut_lineage(spots.filter("muni IS NOT NULL").select("road", F.col("stem").alias("alias"), "muni", "tail", _place()).distinct())
    mine = looked.select("place", "stem", "entity", "muni", "tail")
    other = placed.select("place", "alias", "road", F.col("muni").alias("__muni"), F.col("tail").alias("__tail"))
    # Places travel as hashes and are compared when the rows come back.
    same = F.expr("muni = __muni AND tail = __tail")
    exact = cut_lineage(mine.join(other.withColumnRenamed("alias", "stem"), ["place", "stem"]).filter(same).select("entity", "road").distinct())
    # An entity with a road of just its name is linked to no other road, so only the others look for likeness.
    rest = cut_lineage(mine.join(exact.select("entity"), "entity", "left_anti"))
    pairs = cut_lineage(_alike(rest.select("place", "stem").distinct(), placed.select("place", "alias").distinct()))
    edges = pairs.join(_overlaps(pairs, placed), ["place", "stem", "alias"], "left").join(rest, ["place", "stem"]).join(other, ["place", "alias"]).filter(same)
    edges = edges.groupBy("entity", "road").agg(F.max("alike").alias("score"), F.max(F.coalesce("overlap", F.lit(1.0))).alias("overlap"))
    return edges.unionByName(exact.select("entity", "road", F.lit(1.0).alias("score"), F.lit(1.0).alias("overlap")))


def _overlaps(pairs: DataFrame, placed: DataFrame) -> DataFrame:
    """``(place, stem, alias, overlap)`` of the names with several candidates: share of the rarity that they have in common."""
    several = pairs.groupBy("place", "stem").agg(F.count("*").alias("n")).filter("n > 1").select("place", "stem")
    total = placed.count() or 1
    block = F.xxhash64("place", "attribute").alias("block")
    rarity = placed.select("place", F.explode(_attributes(F.col("alias"))).alias("attribute")).groupBy(block).agg(F.log(1 + F.lit(float(total)) / F.count("*")).alias("weight"))
    keys = pairs.select("place", "stem", "alias").join(several, ["place", "stem"], "left_semi").select("place", "stem", "alias", F.explode(_attributes(F.col("stem"))).alias("attribute"), _attributes(F.col("alias")).alias("others"))
    keys = keys.select("place", "stem", "alias", block, F.array_contains("others", F.col("attribute")).alias("shared"))
    # An attribute that no road has is as rare as can be.
    keys = keys.join(rarity, "block", "left").withColumn("weight", F.coalesce("weight", F.log(F.lit(1.0 + total))))
    return keys.groupBy("place", "stem", "alias").agg((F.sum(F.when(F.col("shared"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("overlap"))


def _without_municipality(entities: DataFrame, spots: DataFrame) -> DataFrame:
    """Edges of entities or spots without a municipality: by whole name, where it belongs to one road."""
    roads = spots.groupBy("stem", "tail").agg(F.count_distinct("road").alias("n"), F.min("road").alias("road"), F.count("muni").alias("placed")).filter("n = 1")
    both = entities.join(roads, ["stem", "tail"]).filter("size(munis) = 0 OR placed = 0")
    return both.select("entity", "road", F.lit(0.8).alias("score"), F.lit(1.0).alias("overlap"))


def _refined(edges: DataFrame, looked: DataFrame) -> DataFrame:
    """``(entity, road, score, overlap)`` after propagation between neighbours, with scores that don't rise any more."""
    scores = cut_lineage(edges.groupBy("entity", "road").agg(F.max("score").alias("score"), F.max("overlap").alias("overlap")))
    # An exact name passes nothing on that the road's own spelling doesn't give, and a sure link needs no neighbours.
    sure = F.col("top") >= SURE
    tops = looked.select("entity", "place", "stem").join(scores.groupBy("entity").agg(F.max("score").alias("top")), "entity", "left").withColumn("top", F.coalesce("top", F.lit(0.0)))
    tops = cut_lineage(tops.filter("top < 1"))
    risen = scores.filter((F.col("score") >= SURE) & (F.col("score") < 1.0)).select("entity", "road")
    near = _alike(tops.filter(~sure).select("place", "stem").distinct(), tops.select("place", F.col("stem").alias("alias")).distinct()).filter((F.col("alike") >= SURE) & (F.col("alike") < 1.0))
    near = near.join(tops.filter(~sure).select("place", "stem", "entity"), ["place", "stem"]).join(tops.select("place", F.col("stem").alias("alias"), F.col("entity").alias("from")), ["place", "alias"])
    near = cut_lineage(near.groupBy("entity", "from").agg(F.max("alike").alias("alike")).filter(F.col("entity") != F.col("from")))
    rounds, order = 0, F.struct("score", "overlap", "road")
    while not near.isEmpty() and not risen.isEmpty():
        rounds += 1
        best = scores.groupBy(F.col("entity").alias("from")).agg(F.max_by("road", order).alias("road"), F.max("score").alias("sent"), F.max_by("overlap", order).alias("overlap"))
        sent = best.join(risen.withColumnRenamed("entity", "from"), ["from", "road"], "left_semi")
        via = near.join(sent, "from").groupBy("entity", "road").agg(F.max(F.col("alike") * (1 + F.col("sent")) / 2).alias("via"), F.max("overlap").alias("via_overlap")).filter(F.col("via") >= LINK)
        after = cut_lineage(scores.join(via, ["entity", "road"], "full"))
        risen = after.filter(F.coalesce(F.col("via") >= F.coalesce("score", F.lit(0.0)) + STABLE, F.lit(False))).select("entity", "road")
        scores = after.select("entity", "road", F.greatest("score", "via").alias("score"), F.coalesce("overlap", "via_overlap").alias("overlap"))
    _log.info("scores are stable after %d rounds", rounds)
    return scores


def _best(scores: DataFrame) -> DataFrame:
    """``(entity, road, confidence)``: the best road of each entity, all of them where names are equal."""
    linked = scores.filter(F.col("score") >= LINK)
    order = F.struct("score", "overlap")
    best = linked.groupBy("entity").agg(F.max(order).alias("top"), F.max_by("road", order).alias("only"))
    chosen = linked.join(best, "entity").filter(((F.col("top.score") == 1.0) & (F.col("score") == 1.0)) | (F.col("road") == F.col("only")))
    return chosen.select("entity", "road", F.col("score").alias("confidence"))
