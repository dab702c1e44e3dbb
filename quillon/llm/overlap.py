"""Same or nearly the same records on both sides of a split (problem 3)."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.common import cut, spread

TRAINING = ("indexed", "calibration")
EVALUATION = ("tuning", "test")
#: Share of the longer text's words that must stand in the other in the same order for a pair to be reported. No such
#: pair is passed over.
REPORTED = 0.85
#: Texts of fewer words are no case.
LEAST_WORDS = 5
#: Buckets (as a power of 2) of the table that tells common words from rare ones: 16 MB whatever the data.
COMMON_BITS = 24
#: 64-bit words of a text's signature.
SIGNATURE = 4
#: Texts of at most so many words are aligned as a whole, longer ones between the words they share.
WHOLE = 4096
#: Seeds per window of ``winnow``: ten words in a row.
WIDE = 8

_TAG = re.compile(r"</?[a-z!?][^<>]*>", re.IGNORECASE)
_WORD = re.compile(r"[^\W_]+")
#: UTF-8 read as a one-byte code page: a lead character and the right number of followers.
_BROKEN = re.compile("[Â-ß].|[à-ï]..|[ð-ô]...", re.DOTALL)
#: Code page 1252 where it differs from Latin-1 (fixed values).
_CP1252 = {bytes([b]).decode("cp1252"): b for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def _repair(match: re.Match) -> str:
    try:
        return bytes(_CP1252.get(c, ord(c)) for c in match.group()).decode("utf-8")
    except ValueError:  # no such bytes, or not UTF-8
        return match.group()


def words_of(text: str | None) -> list[str]:
    """The words that count in comparing: case, spacing, punctuation, accents, markup, invisible characters,
    compatible letter forms and broken encoding are left aside. Null gives none."""
    if not text:
        return []
    if not text.isascii():
        for _ in range(2):  # broken twice, at times
            text = _BROKEN.sub(_repair, text)
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", html.unescape(_TAG.sub(" ", text)))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", text)
        text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Me", "Cf"))
    return _WORD.findall(text.casefold())


def least(words: int) -> int:
    """Words that a text must share, in order, with one of at most so many words to be reported."""
    return int(np.ceil(REPORTED * words - 1e-9))


def slack(words: int) -> int:
    """Words that may be missing from the other, in the longest text that a text of so many words can match."""
    longest = int(words / REPORTED + 1e-9)
    return longest - least(longest)


_word_id = lru_cache(1 << 17)(xxhash.xxh3_64_intdigest)


def word_ids(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_word_id, words), np.uint64, len(words))


def prefix(ids: np.ndarray, common: np.ndarray) -> list[tuple[int, int]]:
    """The places of a text's rarest words, and before how many places of rarer words each comes.

    Places are ordered by the commonness and hash of their word, the same for all texts. Of a text of n words
    n - least(n) at most stay unmatched in a pair to be reported, so the first n - least(n) + 1 places hold a
    matched one. The rarest of all matched words has only unmatched places before it, on both sides: all its
    places are among those first ones or hold the word of the last of them, and are returned. So the two places
    of one matched word are selected in both texts, whatever was swapped, dropped or added and however common
    the words are.
    """
    order = np.lexsort((ids, common)).tolist()
    value = ids.tolist()
    out, first, most = [], 0, len(order) - least(len(order))
    for i, at in enumerate(order):
        if not i or value[at] != value[order[i - 1]]:
            if i > most:
                break
            first = i
        out.append((at, first))
    return out


def signature(ids: np.ndarray) -> list[int]:
    """Bits that each word flips one of: those of two texts differ in no more than there are unmatched words in both."""
    odd = np.bincount((ids % np.uint64(64 * SIGNATURE)).astype(np.int64), minlength=64 * SIGNATURE) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _minima(rank: np.ndarray, window: int) -> np.ndarray:
    if len(rank) <= window:
        return np.array([int(np.argmin(rank))])
    views = np.lib.stride_tricks.sliding_window_view(rank, window)
    return np.unique(np.arange(len(views)) + np.argmin(views, axis=1))


def winnow(seeds: np.ndarray, common: np.ndarray, window: int, most: int) -> np.ndarray:
    """Positions of the selected seeds: minima of windows of consecutive ones, in the order of commonness and hash.

    Windows of ``window`` seeds select rare ones (``common`` 0), windows of WIDE seeds any, of common ones the
    ``most`` first. This misses pairs that share common seeds only, so ``overlaps`` does not use it.
    """
    order = np.lexsort((seeds, common))
    rank = np.empty(len(seeds), np.int64)
    _, first = np.unique(seeds[order], return_index=True)
    starts = np.sort(first)
    rank[order] = np.repeat(starts, np.diff(np.append(starts, len(seeds))))  # equal seeds rank alike
    narrow, wide = _minima(rank, window), _minima(rank, max(window, WIDE))
    return np.union1d(narrow[common[narrow] == 0], wide[rank[wide] < most])


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, 64 cells at a time or more: a bit row per word of ``b``."""
    if not a or not b:
        return 0
    masks: dict = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        m = masks.get(y)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def chain(seeds: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest chain of seeds that advance in both texts."""
    tails: list[int] = []
    last: list[int] = []
    before: list[int] = []
    ordered = sorted(set(seeds), key=lambda s: (s[0], -s[1]))
    for i, (_, b) in enumerate(ordered):
        at = bisect_left(tails, b)
        before.append(last[at - 1] if at else -1)
        if at == len(tails):
            tails.append(b)
            last.append(i)
        else:
            tails[at], last[at] = b, i
    i, out = last[-1] if last else -1, []
    while i >= 0:
        out.append(ordered[i])
        i = before[i]
    return out[::-1]


def align(a: list[str], b: list[str], seeds: list[tuple[int, int]]) -> int:
    """Words of ``a`` matched in order in ``b``; in texts of over WHOLE words seeds are chained, each grows to the
    sides, gaps are aligned.

    Where that falls short of REPORTED, both texts are aligned as a whole, so that a misleading seed loses nothing.
    """
    need = least(max(len(a), len(b)))
    if sum((Counter(a) & Counter(b)).values()) < need:
        return 0
    if max(len(a), len(b)) <= WHOLE:
        return lcs(a, b)
    total, i, j = 0, 0, 0
    for pa, pb in chain(seeds):
        if pa < i or pb < j or a[pa] != b[pb]:
            continue
        x, y = pa, pb
        while x > i and y > j and a[x - 1] == b[y - 1]:
            x, y = x - 1, y - 1
        total += lcs(a[i:x], b[j:y])
        while pa < len(a) and pb < len(b) and a[pa] == b[pb]:
            pa, pb = pa + 1, pb + 1
        total += pa - x
        i, j = pa, pb
    total += lcs(a[i:], b[j:])
    return total if total >= need else lcs(a, b)


def _texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for docs in batches:
        words = [words_of(t) for t in docs.text.tolist()]
        joined = [" ".join(w) for w in words]
        yield pd.DataFrame({"rec_no": docs.rec_no, "evaluation": docs.evaluation, "source": docs.source, "key": [xxhash.xxh3_128_hexdigest(j) for j in joined], "n": [len(w) for w in words], "words": joined})[
            [len(w) >= LEAST_WORDS for w in words]
        ]


def _count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts that hold a word of each bucket; at most 2^COMMON_BITS rows a task."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def merge() -> None:
        buckets, at = np.unique(np.concatenate([b for b, _ in held]), return_inverse=True)
        held[:] = [(buckets, np.bincount(at, weights=np.concatenate([n for _, n in held])).astype(np.int64))]

    for docs in batches:
        words = [np.unique(word_ids(joined.split(" "))) for joined in docs.words.tolist()]
        if words:
            held.append(np.unique((np.concatenate(words) >> np.uint64(64 - COMMON_BITS)).astype(np.int64), return_counts=True))
        if sum(len(b) for b, _ in held[1:]) > 1 << 20:
            merge()
    if held:
        merge()
        yield pd.DataFrame({"bucket": held[0][0], "n": held[0][1]})


def band_of(n: int) -> int:
    """The length band of a text; texts that match lie at most one band apart."""
    return int(np.log(n) / -np.log(REPORTED) + 1e-9)


def reach_of(band: int) -> int:
    """How far apart, at most, matching words of a text in this band and one in a band beside it stand."""
    return slack(int(REPORTED ** -(band + 2)) + 1) + 1


_SIGNED = [f"s{i}" for i in range(SIGNATURE)]


def _fingerprints(commonness):
    """A row for each word that a text selects in a cell of a band, with its first and last place there; texts of the
    evaluation side look in the cells and bands beside their own too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        level = commonness.value
        for docs in batches:
            n, evaluation, training = docs.n.to_numpy(), docs.evaluation.to_numpy(bool), docs.training.to_numpy(bool)
            chosen, seeds, signed = [], [], []
            for joined in docs.words.tolist():
                ids = word_ids(joined.split(" "))
                places = np.array(prefix(ids, level[(ids >> np.uint64(64 - COMMON_BITS)).astype(np.int64)]))
                chosen.append(places)
                seeds.append(ids[places[:, 0]])
                signed.append(signature(ids))
            if not chosen:
                continue
            at, seed = np.concatenate(chosen), np.concatenate(seeds).view(np.int64)
            doc = np.repeat(np.arange(len(docs)), [len(c) for c in chosen])
            band = np.array([band_of(x) for x in n.tolist()])
            own = {x: reach_of(x) for x in range(int(band.min()) - 1, int(band.max()) + 2)}
            parts = []
            for asked, side_ in ((True, evaluation), (False, training)):
                of = side_[doc]
                d, s, p, before = doc[of], seed[of], at[of, 0], at[of, 1]
                for other in (-1, 0, 1) if asked else (0,):
                    near = band[d] + other
                    cell = p // np.array([own[x] for x in range(min(own), max(own) + 1)])[near - min(own)]
                    for c in (-1, 0, 1) if asked else (0,):
                        parts.append(np.stack([np.full(len(d), asked, np.int64), d, s, near, cell + c, p, before]))
            rows = np.concatenate(parts, axis=1)
            rows = rows[:, np.lexsort(rows[5::-1])]
            first = np.ones(rows.shape[1], bool)
            first[1:] = (rows[:5, 1:] != rows[:5, :-1]).any(0)
            starts = np.flatnonzero(first)
            asked, d, s, near, cell, low, before = rows[:, starts]
            frame = {"key": docs.key.to_numpy()[d], "n": n[d], "low": low, "high": rows[5, np.append(starts[1:], rows.shape[1]) - 1], "before": before, "seed": s, "evaluation": asked.astype(bool), "band": near, "cell": cell}
            yield pd.DataFrame(frame | dict(zip(_SIGNED, np.array(signed, np.int64)[d].T)))

    return run


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pairs in batches:
        found = []
        for ke, kt, e, t, seeds in zip(pairs.e_key.tolist(), pairs.t_key.tolist(), pairs.e_words.tolist(), pairs.t_words.tolist(), pairs.seeds.tolist()):
            a, b = e.split(" "), t.split(" ")
            matched = align(a, b, [(s["e_at"], s["t_at"]) for s in seeds])
            if matched >= least(max(len(a), len(b))):
                found.append((ke, kt, matched / max(len(a), len(b))))
        yield pd.DataFrame(found, columns=["e_key", "t_key", "coverage"])


def side(split_name: Column) -> Column:
    """True for the evaluation side, false for training, null for neither; case and outer blanks do not matter."""
    name = F.lower(F.trim(split_name))
    return F.when(name.isin(*EVALUATION), True).when(name.isin(*TRAINING), False)


def class_links(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links between classes of records of the same words, and the members of the classes:
    ``e_key, t_key, coverage`` and ``rec_no, evaluation, source, key``.

    Each class is compared once, however many records it has; one with members on both sides is linked to itself.
    Null or too short texts, null ``rec_no`` and unknown splits are no case; repeated rows count once.

    No pair of at least REPORTED is passed over. Common words do not gather all texts that hold them: a text
    selects its rarest words (see ``prefix``), and the join is by word, length band and place in the text. Joined
    pairs remain where lengths, places, what comes before the word in both orders, and signatures allow a match.
    What is still skewed is left to the adaptive skew join.
    """
    spark = records.sparkSession
    rows = spread(records.select("rec_no", side(F.col("split_name")).alias("evaluation"), "source", "text").where("rec_no IS NOT NULL AND evaluation IS NOT NULL AND text IS NOT NULL"))
    read = cut(rows.mapInPandas(_texts, "rec_no long, evaluation boolean, source string, key string, n long, words string"))
    members = read.select("rec_no", "evaluation", "source", "key").distinct()
    classes = read.groupBy("key").agg(F.first("n").alias("n"), F.first("words").alias("words"), F.bool_or("evaluation").alias("evaluation"), F.bool_or(~F.col("evaluation")).alias("training"))
    counts = cut(classes.select("words").mapInPandas(_count_words, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
    rare = max(1, int(counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] >> COMMON_BITS))
    hot = counts.where(F.col("n") > rare).select(F.col("bucket").cast("int"), F.least(F.floor(8 * F.log2(F.col("n") / rare)) + 1, F.lit(255)).cast("short").alias("level")).toArrow()
    level = np.zeros(1 << COMMON_BITS, np.uint8)
    level[hot["bucket"].to_numpy()] = hot["level"].to_numpy()
    kinds = "key string, n long, low long, high long, before long, seed long, evaluation boolean, band long, cell long, " + ", ".join(f"{c} long" for c in _SIGNED)
    prints = cut(classes.mapInPandas(_fingerprints(spark.sparkContext.broadcast(level)), kinds))
    own = ("key", "n", "low", "high", "before", *_SIGNED)
    e = prints.where("evaluation").select("seed", "band", "cell", *(F.col(c).alias(f"e_{c}") for c in own))
    t = prints.where("NOT evaluation").select("seed", "band", "cell", *(F.col(c).alias(f"t_{c}") for c in own))
    need = F.ceil(F.greatest("e_n", "t_n") * F.lit(REPORTED) - 1e-9)
    reach = F.greatest("e_n", "t_n") - need
    alike = (F.least("e_n", "t_n") >= need) & (F.col("e_low") - F.col("t_high") <= reach) & (F.col("t_low") - F.col("e_high") <= reach)
    first = (F.col("e_before") <= F.col("e_n") - need) & (F.col("t_before") <= F.col("t_n") - need)
    differing = sum((F.bit_count(F.col(f"e_{c}").bitwiseXOR(F.col(f"t_{c}"))) for c in _SIGNED), F.lit(0))
    pairs = (
        e.join(t, ["seed", "band", "cell"])
        .where(alike & first & (differing <= F.col("e_n") + F.col("t_n") - 2 * need) & (F.col("e_key") != F.col("t_key")))
        .groupBy("e_key", "t_key")
        .agg(F.collect_set(F.struct(F.col("e_low").alias("e_at"), F.col("t_low").alias("t_at"))).alias("seeds"))
    )
    words = classes.select("key", "words")
    near = (
        pairs.join(words.select(F.col("key").alias("e_key"), F.col("words").alias("e_words")), "e_key")
        .join(words.select(F.col("key").alias("t_key"), F.col("words").alias("t_words")), "t_key")
        .mapInPandas(_verify, "e_key string, t_key string, coverage double")
    )
    same = classes.where("evaluation AND training").select(F.col("key").alias("e_key"), F.col("key").alias("t_key"), F.lit(1.0).alias("coverage"))
    return near.unionByName(same), members


def overlaps(records: DataFrame) -> DataFrame:
    """Pairs of an evaluation and a training record of the same or nearly the same text:
    ``eval_rec, train_rec, eval_source, coverage``: the links of ``class_links`` expanded to their members."""
    linked, members = class_links(records)
    evaluation = members.where("evaluation").select(F.col("key").alias("e_key"), F.col("rec_no").alias("eval_rec"), F.col("source").alias("eval_source"))
    training = members.where("NOT evaluation").select(F.col("key").alias("t_key"), F.col("rec_no").alias("train_rec")).distinct()
    return linked.join(evaluation, "e_key").join(training, "t_key").select("eval_rec", "train_rec", "eval_source", "coverage")


def report(records: DataFrame) -> DataFrame:
    """Per evaluation split and source: records, those found on the training side, the number of pairs they make and
    their mean best coverage. Counted from links between classes and class sizes; no pair is expanded."""
    linked, members = class_links(records)
    sizes = members.where("NOT evaluation").groupBy(F.col("key").alias("t_key")).agg(F.count_distinct("rec_no").alias("size"))
    by_class = linked.join(sizes, "t_key").groupBy("e_key").agg(F.sum("size").alias("partners"), F.max("coverage").alias("coverage"))
    found = members.where("evaluation").select("rec_no", F.col("key").alias("e_key")).join(by_class, "e_key").groupBy("rec_no").agg(F.sum("partners").alias("partners"), F.max("coverage").alias("coverage"))
    name = F.lower(F.trim(F.col("split_name")))
    own = records.where(side(F.col("split_name"))).where("rec_no IS NOT NULL").select("rec_no", name.alias("split_name"), "source").distinct()
    return (
        own.join(found, "rec_no", "left")
        .groupBy("split_name", "source")
        .agg(F.count("*").alias("records"), F.count("partners").alias("found_records"), F.coalesce(F.sum("partners"), F.lit(0)).alias("pairs"), F.avg("coverage").alias("mean_coverage"))
    )
