"""Pages of stuffed keywords, lists of links or product tags instead of sentences.

Method: texts are cut into segments (lines, and sentences within lines) and each segment into a sequence of function
words and word classes. An n-gram model is trained on prose: on the sentences, and the rows of data among them, of
documents that largely consist of sentences; closing links and tags are not learned. Segments whose perplexity is
abnormally high against that of the segments trained on, or that repeat too many of their own words to be sentences,
are odd, and a page is flagged if more than half of its characters lie in odd segments.

A sequence counts once per distinct text, and a text is scored without what it and its copies were counted for. All
counts cover all documents. The vocabulary is fixed, and counts are kept in ``2 ** SLOT_BITS`` slots, so the
model's size has a bound that doesn't depend on the corpus; it is summed per partition first and then per slot.
Beside that only the sequences are shuffled, one of each text and its reposts, combined before; each distinct text is
scored once, and its reposts take its share by their digest.

Defined results: null, empty and blank texts are never flagged; a text of one segment counts as its segment;
a repost is flagged as its original; with no prose at all nothing is flagged.
"""

from __future__ import annotations

import logging
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import cache, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_to_lookup
from ..session import cut_lineage

_log = logging.getLogger(__name__)

#: Function words, the longest first where one begins with another.
JA_WORDS = "ところ および または ながら について によると によって において として という ている てから だけ ほど まで から より ため こと もの とき ので のに では には とは へは にも でも なら など かも しか さえ ばかり および られ され せる れる れた した する して しない ない なく なかった いる いた ある あった です ます でした ました だった である だ た て は が を に で と も の や か へ ば し な り る れ"
EN_WORDS = "a an the this that these those it its he she they we you i his her their our your who which what where when while if unless because although and or but so nor not no of to in on at by for from with without into onto over under near after before since until about above below between along across up down out off as than then there here is are was were be been being has have had do does did will would can could may might must should shall only also still just more most some any each all one two"
#: Word classes beside them; runs of kanji, katakana and other hiragana and Latin words are also classed by length.
LONG_RUN = 12

_JA = sorted(set(JA_WORDS.split()), key=lambda w: (-len(w), w))
_EN = sorted(set(EN_WORDS.split()))
_JA_PATTERN = re.compile("|".join(_JA) + "|.", re.S)
_ADDRESS, _TAG, _NUMBER = re.compile(r"https?://[!-~]+"), re.compile(r"<[^<>\n]+>"), re.compile(r"[0-9０-９]+(?:[.,:][0-9]+)*")
#: Signs that stand for an address, a tag and the end of a segment while a text is cut up.
_ADDRESS_SIGN, _TAG_SIGN, _END = "\ue000", "\ue001", "\ue002"
_SIGNS = "。、.,!?！？:：;；()（）「」『』[]【】|/・★-—–~〜>＞<＜≪≫▶→#*+=%&\"'_^●◆■…○"
BOS, EOS, VOCABULARY = 0, 1, 512
SLOT_BITS = 20
ORDER = 4
#: Weight of the lower orders, in occurrences.
BACKOFF = 5.0

#: Characters or tokens that are worked on at once.
CHUNK = 400_000

#: A document is prose if so much of what isn't rows of data is in sentences.
PROSE_SHARE = 0.4
#: Perplexity is abnormal this many times the distance of the 5 % and 75 % quantiles above the median.
SPREADS = 3.0
#: and at least this far from it.
LEAST_REACH = 1.0
#: Variety is abnormal below this, whatever is trained on, so that pages of one kind can't move it, however many.
LEAST_VARIETY = math.log(0.7)
#: Content words before a word in which it isn't repeated, so that long segments count as short ones.
NEAR = 16
#: How often the model is trained, each time without what the one before flags.
ROUNDS = 2
#: Histogram of perplexities for the quantiles.
BINS, BINS_PER_UNIT = 1600, 100
#: More than so much of a page in odd segments flags it.
ODD_SHARE = 0.5


@cache
def _ids() -> dict[str, int]:
    names = ["<s>", "</s>", "url", "tag", "nl", "tab", "sp", "hira", "sign", "num"]
    names += [f"kanji{k}" for k in range(1, LONG_RUN + 1)] + [f"kata{k}" for k in range(1, LONG_RUN + 1)] + ["word", "Word", "WORD", "wordlong"]
    names += ["ja:" + w for w in _JA] + ["en:" + w for w in _EN] + ["sign:" + s for s in _SIGNS]
    assert len(names) <= VOCABULARY
    return {n: k for k, n in enumerate(names)}


#: Kinds of signs; of the last ones each is a token of its own.
KANJI, KATA, HIRA, LATIN, BLANK, END, SINGLE = range(7)


@cache
def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each code up to the end of the basic plane its kind, and its token if it is one of its own."""
    ids = _ids()
    kind, token = np.full(0x10000, SINGLE, dtype=np.uint8), np.full(0x10000, ids["sign"], dtype=np.uint16)
    for low, high, k in ((0x4E00, 0xA000, KANJI), (0xF900, 0xFB00, KANJI), (0x3005, 0x3008, KANJI), (0x30A1, 0x30FB, KATA), (0x30FC, 0x30FD, KATA), (0x3041, 0x3097, HIRA), (0x41, 0x5B, LATIN), (0x61, 0x7B, LATIN), (0xC0, 0x250, LATIN)):
        kind[low:high] = k
    for blank in (0x20, 0xA0, 0x3000):
        kind[blank] = BLANK
    kind[ord(_END)] = END
    for sign, name in ((_ADDRESS_SIGN, "url"), (_TAG_SIGN, "tag"), ("0", "num"), ("\n", "nl"), ("\t", "tab")):
        token[ord(sign)] = ids[name]
    for sign in _SIGNS:
        token[ord(sign)] = ids["sign:" + sign]
    return kind, token


def segments(text: str) -> list[str]:
    """Lines, cut after each Japanese full stop and each sentence-final sign that a blank follows."""
    return [s for s in re.split(r"(?<=\n)|(?<=。)(?!\n)|(?<=[！？](?![！？\n]))|(?<=[^A-Z][.!?] )", text) if s]


@lru_cache(maxsize=100_000)
def _run_tokens(run: str) -> tuple[int, ...]:
    """Tokens of a run of hiragana or of Latin letters."""
    ids = _ids()
    if "ぁ" <= run[0] <= "ゖ":
        return tuple(ids.get("ja:" + w, ids["hira"]) for w in _JA_PATTERN.findall(run))
    low = run.lower()
    return (ids.get("en:" + low) or ids["wordlong" if len(run) > LONG_RUN else "word" if run == low else "WORD" if run.isupper() else "Word"],)


def sequences(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Function words and word classes of the segments, one after another, and how many each has.

    Runs of one kind of sign are found for all segments at once; only runs of hiragana and Latin letters are looked
    up one by one.
    """
    if not parts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    text = "".join(p.replace(_END, "?") + _END for p in parts)
    if "http" in text:
        text = _ADDRESS.sub(_ADDRESS_SIGN, text)
    if "<" in text:
        text = _TAG.sub(_TAG_SIGN, text)
    text = _NUMBER.sub("0", text)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    kinds, singles = _kinds()
    codes = np.minimum(codes, 0xFFFF)
    kind = kinds[codes]
    begins = np.ones(len(kind), dtype=bool)
    begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] >= END)
    at = np.flatnonzero(begins)
    run, length = kind[at], np.diff(np.append(at, len(kind)))
    ids = _ids()
    token = singles[codes[at]].astype(np.int64)
    capped = np.minimum(length, LONG_RUN)
    token = np.where(run == KANJI, ids["kanji1"] + capped - 1, np.where(run == KATA, ids["kata1"] + capped - 1, np.where(run == BLANK, ids["sp"], token)))
    count = np.ones(len(run), dtype=np.int64)
    count[run == END] = 0
    # A blank between words that go on in ASCII says nothing.
    following = np.append(codes[at[1:]], 0)
    before = np.append(END, run[:-1])
    count[(run == BLANK) & (before == LATIN) & (following < 128)] = 0
    looked = np.flatnonzero((run == HIRA) | (run == LATIN))
    found = [_run_tokens(text[a : a + n]) for a, n in zip(at[looked].tolist(), length[looked].tolist(), strict=True)]
    count[looked] = [len(f) for f in found]
    flat = np.repeat(token, count)
    mine = np.zeros(len(run), dtype=bool)
    mine[looked] = True
    flat[np.repeat(mine, count)] = [t for f in found for t in f]
    ends = np.cumsum(count)[run == END]
    return flat, np.diff(np.append(0, ends))


def sequence(segment: str) -> list[int]:
    """Function words and word classes of a segment."""
    return sequences([segment])[0].tolist()


_JA_PARTICLES = "はがをにでとものへ"
_EN_END, _EN_WORD = re.compile(r"[a-z)][.!?]\s*$"), re.compile(rf"\b(?:{'|'.join(_EN)})\b")


def is_sentence(segment: str) -> bool:
    """Whether a segment ends like a sentence and has at least two function words."""
    if segment.rstrip().endswith("。"):
        return sum(map(segment.count, _JA_PARTICLES)) > 1
    return bool(_EN_END.search(segment)) and len(_EN_WORD.findall(segment)) > 1


def prose_places(parts: list[str]) -> list[int]:
    """Places of the segments to train on: sentences, and rows of data among them, of a text that largely consists of sentences."""
    whole, data = [is_sentence(p) for p in parts], [is_data(p) for p in parts]
    size = lambda chosen: sum(len(p) for p, c in zip(parts, chosen, strict=True) if c)
    if not any(whole) or size(whole) < PROSE_SHARE * (size([True] * len(parts)) - size(data)):
        return []
    first, last = whole.index(True), len(whole) - whole[::-1].index(True)
    return [k for k in range(first, last) if whole[k] or data[k]]


def prose_part(parts: list[str]) -> list[str]:
    """The segments at ``prose_places``."""
    return [parts[k] for k in prose_places(parts)]


def is_data(segment: str) -> bool:
    """Whether a segment is a row of a table or log: with tabs, or mostly digits."""
    return "\t" in segment or 2 * sum(map(segment.count, "0123456789")) > len(segment)


_CONTENT = re.compile(r"[\u4e00-\u9fff々]{2,}|[ァ-ヶー]{2,}|[A-Za-zÀ-ɏ]{4,}")


def own_variety(segment: str) -> float:
    """Log share of words of a segment that don't repeat one of the ``NEAR`` before; 0 for rows of data."""
    words = _CONTENT.findall(segment)
    different = len(set(words))
    if different == len(words) or is_data(segment):
        return 0.0
    if len(words) > NEAR:
        last: dict[str, int] = {}
        different = 0
        for k, word in enumerate(words):
            different += k - last.get(word, -NEAR - 1) > NEAR
            last[word] = k
    return math.log(different / len(words))


def _grams(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each token of the sequences the ``ORDER - 1`` tokens before it and itself; starts; which are no fill.

    ``flat`` holds the sequences one after another, ``sizes`` how long each is.
    """
    fill = ORDER - 1
    starts = np.cumsum(sizes + fill + 1) - (sizes + fill + 1)
    ids = np.full(int((sizes + fill + 1).sum()), BOS, dtype=np.int64)
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ids[np.repeat(starts, sizes) + fill + within] = flat
    ids[starts + fill + sizes] = EOS
    return np.stack([np.roll(ids, fill - k) for k in range(ORDER)]), starts, ids != BOS


def _step(h: np.ndarray, c: np.ndarray | int) -> np.ndarray:
    h = (h ^ (np.uint64(c) if isinstance(c, int) else c)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _slots(grams: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots of the n-grams of each order, from the lowest, and of their contexts; all share one table."""
    grams = grams.astype(np.uint64)
    last = grams[-1] + np.uint64(1)
    slot = lambda h: (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    for k in reversed(range(ORDER)):
        h = np.full(grams.shape[1], 0x9E3779B97F4A7C15 + k, dtype=np.uint64)
        for c in grams[k:-1]:
            h = _step(h, c)
        yield slot(_step(h, last)), slot(_step(h, 0))


def count_grams(flat: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> None:
    """Add the n-grams of all orders, and their contexts, to ``table``."""
    grams, _, real = _grams(flat, sizes)
    for gram, context in _slots(grams[:, real]):
        table += np.bincount(gram, minlength=len(table))
        table += np.bincount(context, minlength=len(table))


def _own_counts(owner: np.ndarray, counted: np.ndarray, slot: np.ndarray) -> np.ndarray:
    """For each token how often the tokens of the same text that were ``counted`` have its slot."""
    key = (owner << SLOT_BITS) | slot
    # Shorter keys are sorted faster; the order of equal ones doesn't matter.
    order = np.argsort(key.astype(np.int32) if len(owner) and owner[-1] < 1 << (31 - SLOT_BITS) else key)
    key = key[order]
    first = np.ones(len(key), dtype=bool)
    first[1:] = key[1:] != key[:-1]
    at = np.flatnonzero(first)
    own = np.empty(len(key), dtype=np.int64)
    own[order] = np.repeat(np.add.reduceat(counted[order].astype(np.int64), at), np.diff(np.append(at, len(key))))
    return own


def perplexities(flat: np.ndarray, sizes: np.ndarray, table: np.ndarray, owner: np.ndarray | None = None, counted: np.ndarray | None = None) -> np.ndarray:
    """Log perplexity of each sequence under the counts of ``table``.

    With ``owner``, the text of each sequence, without what the ``counted`` sequences of the same text added.
    """
    if not len(sizes):
        return np.zeros(0)
    grams, starts, real = _grams(flat, sizes)
    p = np.full(grams.shape[1], 1.0 / VOCABULARY)
    # From the lowest order up, each trusted the more the more often its context was seen.
    owners, mine = (None, None) if owner is None else (np.repeat(owner, sizes + ORDER), np.repeat(counted, sizes + ORDER) & real)
    for gram, context in _slots(grams):
        n, of = table[gram], table[context]
        if owners is not None:
            n, of = np.maximum(0.0, n - _own_counts(owners, mine, gram)), np.maximum(0.0, of - _own_counts(owners, mine, context))
        p = (n + BACKOFF * p) / (of + BACKOFF)
    cost = np.where(real, -np.log(np.minimum(p, 1.0)), 0.0)
    return np.add.reduceat(cost, starts) / np.add.reduceat(real.astype(float), starts)


SHAPE = "flat binary, sizes binary, chars binary, train binary, variety binary"


def text_shapes(texts: Iterable[str | None]) -> list[tuple[bytes, bytes, bytes, bytes]]:
    """Per text the sequences of its segments, their lengths, their characters and which to train on, as bytes."""
    return [shape[:4] for shape in _all_shapes(texts)]


def _all_shapes(texts: Iterable[str | None]) -> list[tuple[bytes, bytes, bytes, bytes, bytes]]:
    """``text_shapes`` and the ``own_variety`` of each segment."""
    cut = [segments(t) if t and t.strip() else [] for t in texts]
    flat, sizes = sequences([p for parts in cut for p in parts])
    flat, out, a, b = flat.astype(np.uint16), [], 0, 0
    for parts in cut:
        mine = sizes[a : a + len(parts)]
        a += len(parts)
        tokens = flat[b : b + int(mine.sum())]
        b += len(tokens)
        prose = set(prose_places(parts))
        seen: set[bytes] = set()
        train, at = [], 0
        for k, n in enumerate(mine.tolist()):
            shape = tokens[at : at + n].tobytes()
            at += n
            # One sequence counts once in a text, so a text can't teach the model what it repeats.
            train.append(k in prose and shape not in seen)
            seen.add(shape)
        out.append((tokens.tobytes(), mine.astype(np.int32).tobytes(), np.asarray([len(p.strip()) for p in parts], dtype=np.int32).tobytes(), np.asarray(train, dtype=np.uint8).tobytes(), np.asarray([own_variety(p) for p in parts], dtype=np.float32).tobytes()))
    return out


def _few(texts: Iterable[str | None], most: int = CHUNK) -> Iterator[list[str | None]]:
    """Texts in lists of about ``most`` characters, so that memory doesn't depend on the batch; whole texts always."""
    few: list[str | None] = []
    size = 0
    for text in texts:
        few.append(text)
        size += len(text or "")
        if size >= most:
            yield few
            few, size = [], 0
    if few:
        yield few


def _pieces(batch: pd.DataFrame, most: int = CHUNK) -> Iterator[pd.DataFrame]:
    """Rows of a batch in pieces of about ``most`` tokens."""
    number = np.asarray([len(f) // 2 for f in batch["flat"]], dtype=np.int64).cumsum() // most
    for _, piece in batch.groupby(number, sort=True):
        yield piece


def shapes(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``text_shapes``, variety and digest of the documents, computed once and written to the shared folder."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [shape for few in _few(batch["text"]) for shape in _all_shapes(few)]
            yield pd.DataFrame([(k, d, *shape) for k, d, shape in zip(batch["key"], batch["digest"], found, strict=True)], columns=["key", "digest", "flat", "sizes", "chars", "train", "variety"], dtype=object)

    # Keys travel as texts, lest pandas makes numbers of whole numbers with nulls.
    return cut_lineage(documents.select(F.col(key).cast("string").alias("key"), F.md5(F.col(text).cast("binary")).alias("digest"), F.col(text).alias("text")).mapInPandas(cut, f"key string, digest string, {SHAPE}"))


def _batch(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Flat sequences, sizes, characters, train flags, and for each segment the number of its text in the batch."""
    join = lambda name, kind: np.frombuffer(b"".join(batch[name]), dtype=kind)
    owner = np.repeat(np.arange(len(batch)), [len(s) // 4 for s in batch["sizes"]])
    return join("flat", np.uint16).astype(np.int64), join("sizes", np.int32).astype(np.int64), join("chars", np.int32), join("train", np.uint8).astype(bool), owner


def odd_shares(batch: pd.DataFrame, model: Model) -> np.ndarray:
    """Share of each text's characters, blanks around segments not counted, in odd segments."""
    flat, sizes, chars, _, owner = _batch(batch)
    variety = np.frombuffer(b"".join(batch["variety"]), dtype=np.float32)
    cost = perplexities(flat, sizes, model.table(), owner, _learned(batch))
    odd = (cost > model.high) | (variety < LEAST_VARIETY)
    of = lambda weight: np.bincount(owner, weights=weight, minlength=len(batch))
    return of(chars * odd) / np.maximum(1.0, of(chars.astype(float)))


@dataclass(frozen=True)
class Model:
    """Counts by slot and the bound above which perplexity is abnormal."""

    slots: np.ndarray
    counts: np.ndarray
    high: float = math.inf

    def table(self) -> np.ndarray:
        table = np.zeros(1 << SLOT_BITS)
        table[self.slots] = self.counts
        return table


def _learned(batch: pd.DataFrame) -> np.ndarray:
    """Which sequences are trained on, none of those of texts that the model before flagged."""
    _, _, chars, train, owner = _batch(batch)
    keep = train & (chars > 0)
    return keep & (batch["odd_share"].to_numpy(float) <= ODD_SHARE)[owner] if len(owner) else keep


def _training(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sequences to train on."""
    flat, sizes, _, _, _ = _batch(batch)
    keep = _learned(batch)
    return flat[np.repeat(keep, sizes)], sizes[keep]


def distinct_texts(documents: DataFrame) -> DataFrame:
    """One of each text of ``shapes``, with ``odd_share`` 0. Copies have its digest and so its shapes: any of them will do."""
    return cut_lineage(documents.drop("key").dropDuplicates(["digest"]).withColumn("odd_share", F.lit(0.0)))


def fit(texts: DataFrame) -> Model | None:
    """Train on ``distinct_texts`` but those flagged before. None if there is no prose."""
    spark = texts.sparkSession
    prose = texts.filter(F.col("odd_share") <= ODD_SHARE)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table = np.zeros(1 << SLOT_BITS)
        for batch in batches:
            for piece in _pieces(batch):
                count_grams(*_training(piece), table)
        used = np.flatnonzero(table)
        yield pd.DataFrame({"slot": used, "n": table[used]})

    found = prose.mapInPandas(count, "slot long, n double").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    if found.empty:
        return None
    _log.info("n-grams and contexts fill %.3f of the slots", len(found) / (1 << SLOT_BITS))
    model = Model(found["slot"].to_numpy(np.int64), found["n"].to_numpy(float))
    shared = spark.sparkContext.broadcast(model)

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bins, table = np.zeros(BINS, dtype=np.int64), shared.value.table()
        for batch in batches:
            for piece in _pieces(batch):
                keep, owner = _learned(piece), _batch(piece)[4]
                cost = perplexities(*_training(piece), table, owner[keep], np.ones(int(keep.sum()), dtype=bool))
                bins += np.bincount(np.minimum(BINS - 1, (cost * BINS_PER_UNIT).astype(int)), minlength=BINS)
        used = np.flatnonzero(bins)
        yield pd.DataFrame({"bin": used, "n": bins[used]})

    histogram = prose.mapInPandas(spread, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas().sort_values("bin")
    at = lambda q: float(histogram["bin"].iloc[int(np.searchsorted(histogram["n"].cumsum(), q * histogram["n"].sum()))] + 0.5) / BINS_PER_UNIT
    reach = max(LEAST_REACH, SPREADS * (at(0.75) - at(0.05)))
    return replace(model, high=at(0.5) + reach)


def scored(texts: DataFrame, model: Model) -> DataFrame:
    """``texts`` with ``odd_share`` under ``model``, in place of that under the model before."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for piece in _pieces(batch):
                yield piece.assign(odd_share=odd_shares(piece, shared.value))

    return texts.mapInPandas(score, texts.schema)


def odd_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """``(key, odd_share)`` of each document; each round trains without what the one before flags."""
    cut, kind = shapes(documents, key, text), documents.schema[key].dataType
    texts = distinct_texts(cut)
    for k in range(rounds):
        model = fit(texts)
        if model is None:
            return cut.select(F.col("key").cast(kind).alias(key), F.lit(0.0).alias("odd_share"))
        texts = scored(texts, model)
        if k + 1 < rounds:
            texts = cut_lineage(texts)
    # A null text has no digest and is odd in nothing.
    shares = cut_lineage(texts.filter("digest IS NOT NULL").select("digest", "odd_share"))
    return join_to_lookup(cut.select("key", "digest"), shares, "digest", "left").select(F.col("key").cast(kind).alias(key), F.coalesce("odd_share", F.lit(0.0)).alias("odd_share"))


def stuffed_pages(documents: DataFrame, key: str = "doc_id", text: str = "text", odd_share: float = ODD_SHARE) -> DataFrame:
    """Documents more than half of whose characters are in odd segments."""
    return odd_documents(documents, key, text).filter(F.col("odd_share") > odd_share).select(key)
