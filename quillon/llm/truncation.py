"""Finding texts that were cut off (problem 8).

A backward character n-gram model tells how often a text ends after a context against how often it goes on
there. The context is read backwards from the end, first as character classes, then as one, two, ... characters.
Counts are exact and cover all positions of all texts; only contexts in which some text ends are counted, since
no other is ever asked for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.common import cut, spread

#: The contexts, from coarse to fine: so many character classes, or so many characters.
CONTEXTS = (("class", 1), ("class", 3), ("char", 1), ("char", 2), ("char", 3), ("char", 4), ("char", 6), ("char", 9), ("char", 12))
REACH = 12
#: The odds of a cut that the first round supposes everywhere; later ones estimate them.
PRIOR_ODDS = 0.5
#: How many of the contexts each round looks at. Few texts are cut in just the same fine context, many in the same
#: coarse one that no complete text ends in, so the coarse ones come first.
DEPTHS = (4, 9)
#: Lengths, in characters or bytes, below a field limit in which texts cut back to a word or a character end.
SLACK = 16
#: Texts that make a limit, and how many times as many as nearby.
LIMIT_TEXTS, LIMIT_TIMES = 8, 6
#: Bits, as a power of 2, of the filter that keeps contexts in which no text ends from being counted. It has about
#: eight for each context wanted, at most 32 MB of them; too few only cost work.
FILTER_BITS = (20, 28)
#: Characters hashed at a time.
CHUNK = 1 << 19
#: Function words that tell the languages apart (fixed values).
WORDS = {
    "en": (" the ", " and ", " of ", " is ", " in "),
    "de": (" der ", " die ", " das ", " und ", " nicht "),
    "fr": (" le ", " la ", " les ", " pour ", " dans "),
    "es": (" el ", " los ", " las ", " para ", " que "),
}
#: What cutting and transfer leave at an end: marks of omission, broken characters, entities and escapes, dangling separators (fixed patterns).
DEBRIS = re.compile(
    r"(?:[\x00�]|[,;\-–—<({\[]|[(\[](?:more|continued|truncated|cut|\.{2,3}|…)[)\]]|…|\.{3}|\\(?:u[0-9a-f]{0,3}|x[0-9a-f]?)?|&(?:#?\w{0,7})?|%[0-9a-f]?)$",
    re.IGNORECASE,
)
LANGUAGES = (*WORDS, "zh")


def _classes() -> np.ndarray:
    table = np.full(0x110000, 8, np.uint8)  # scripts without letter case
    of = {"L": 1, "M": 1, "N": 2, "Z": 3, "C": 3, "P": 4, "S": 5}
    for c in range(0x3000):
        table[c] = of[unicodedata.category(chr(c))[0]]
    for c in ".!?。！？":
        table[ord(c)] = 6
    for c in ")]}\"'»”`":
        table[ord(c)] = 7
    for c in "，、；：":
        table[ord(c)] = 4
    return table


CLASS = _classes()


def strip_debris(text: str) -> tuple[str, bool]:
    """The text without what a cut left at its end, and whether there was any such thing.

    One trailing white space is nothing; two or more are padding.
    """
    found = False
    while text:
        bare = text.rstrip()
        found |= len(text) - len(bare) > 1
        mark = DEBRIS.search(bare[-24:])
        if not mark:
            return bare, found
        text, found = bare[: len(bare) - len(mark.group())], True
    return text, found


def language(text: str) -> str:
    """A guess from the script and function words; declared languages are not reliable."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if 5 * np.count_nonzero((codes >= 0x4E00) & (codes <= 0x9FFF)) > len(codes):
        return "zh"
    low = f" {text.lower()} "
    return max(WORDS, key=lambda k: sum(low.count(w) for w in WORDS[k]))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


@cache
def _salt(name: str | None) -> np.uint64:
    h = np.uint64(14695981039346656037)
    with np.errstate(over="ignore"):
        for b in b"\xff" if name is None else name.encode("utf-8", "replace"):
            h = (h ^ np.uint64(b)) * np.uint64(1099511628211)
    return _mix(np.array([h]))[0]


#: An odd number and its inverse modulo 2^64 (fixed values of the hash).
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b)]), dtype=np.uint64) for b in (_BASE, _INVERSE))


def context_keys(codes: np.ndarray, languages: np.ndarray) -> Iterator[np.ndarray]:
    """For each of CONTEXTS the key of the context that ends at each position. Digits are all alike.

    Keys are differences of a running polynomial hash, so that a long context costs no more than a short one.
    """
    kinds = CLASS[codes]
    chars = np.where(kinds == 2, np.uint32(48), codes)
    up, down = (p[: len(codes)] for p in _powers(1 << int(max(1, len(codes) - 1)).bit_length()))
    sums = {}
    for kind, source in (("class", kinds), ("char", chars)):
        sums[kind] = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(source.astype(np.uint64) + np.uint64(1)) * down, dtype=np.uint64)])
    for at, (kind, n) in enumerate(CONTEXTS):
        total = sums[kind]
        h = total[1:].copy()
        h[n:] -= total[1:-n]
        h *= up
        h += np.uint64(at + 1)
        yield _mix(h + languages) if kind == "class" else h


def _ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for docs in batches:
        out, tails = [], []
        for doc_id, source, text in zip(docs.doc_id.tolist(), docs.source.tolist(), docs.text.tolist()):
            bare, debris = strip_debris(text)
            if bare:
                out.append((doc_id, source, language(text), len(text), len(text.encode("utf-8", "replace")), len(bare), debris))
                tails.append(("\x02" + bare)[-REACH:].replace("\x00", "\ufffd").rjust(REACH, "\x00"))
        frame = pd.DataFrame(out, columns=["doc_id", "source", "lang", "length", "bytes", "bare", "debris"])
        codes = np.frombuffer("".join(tails).encode("utf-32-le"), np.uint32)
        with np.errstate(over="ignore"):
            languages = np.repeat(np.array([LANGUAGES.index(r[2]) for r in out], np.uint64), REACH)
            last = np.stack([k[REACH - 1 :: REACH] for k in context_keys(codes, languages)], axis=1) if out else np.zeros((0, len(CONTEXTS)), np.uint64)
            salts = np.array([_salt(r[1]) for r in out], np.uint64)
            frame["keys"] = list(_mix(last ^ salts[:, None]).astype(np.int64))
        yield frame


ENDS = "doc_id long, source string, lang string, length long, bytes long, bare long, debris boolean, keys array<long>"


def _counter(wanted):
    """Counts, over all positions of the texts, the contexts that pass the filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = wanted.value
        mask = np.uint64(8 * len(bits) - 1)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def tally(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
            at, unique = pd.factorize(keys.view(np.int64))
            return unique, np.bincount(at, weights=weights, minlength=len(unique)).astype(np.int64)

        def merged() -> pd.DataFrame:
            keys, n = tally(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
            held.clear()
            return pd.DataFrame({"key": keys, "n": n})

        def count(codes: np.ndarray, salts: np.ndarray, languages: np.ndarray) -> None:
            text = codes[REACH:] != 0
            own = salts[REACH:][text]
            for key in context_keys(codes, languages):
                salted = _mix(key[REACH:][text] ^ own)
                low = salted & mask
                hit = bits[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8) & np.uint8(1)
                held.append(tally(salted[hit.view(bool)]))

        with np.errstate(over="ignore"):
            for docs in batches:
                parts, salts, langs, sizes, held_back = [], [], [], [], 0

                def flush() -> None:
                    if parts:
                        gap = np.zeros(REACH, np.uint32)
                        codes = np.concatenate([gap, *parts])
                        s = np.concatenate([gap.astype(np.uint64), np.repeat(np.array(salts, np.uint64), sizes)])
                        g = np.concatenate([gap.astype(np.uint64), np.repeat(np.array(langs, np.uint64), sizes)])
                        for a in range(0, len(codes) - REACH, CHUNK):
                            count(codes[a : a + CHUNK + REACH], s[a : a + CHUNK + REACH], g[a : a + CHUNK + REACH])
                    for x in (parts, salts, langs, sizes):
                        x.clear()

                for source, text in zip(docs.source.tolist(), docs.text.tolist()):
                    bare, _ = strip_debris(text)
                    codes = np.frombuffer(("\x02" + bare.replace("\x00", "\ufffd") + "\x00" * REACH).encode("utf-32-le"), np.uint32)  # 0 separates texts
                    parts.append(codes)
                    salts.append(_salt(source))
                    langs.append(LANGUAGES.index(language(text)))
                    sizes.append(len(codes))
                    held_back += len(codes)
                    if held_back >= CHUNK:
                        flush()
                        held_back = 0
                flush()
                if sum(len(k) for k, _ in held) > 1 << 21:
                    yield merged()
            if held:
                yield merged()

    return run


def _filter_of(keys: DataFrame) -> np.ndarray:
    """A bitmap that holds the keys, about eight bits for each, within FILTER_BITS."""
    distinct = keys.agg(F.approx_count_distinct("key")).first()[0]
    bits = min(max(FILTER_BITS[0], int(8 * distinct).bit_length()), FILTER_BITS[1])
    low = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
    words = keys.groupBy(F.shiftright(low, 5).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, int(key & 31))")).alias("b")).toArrow()
    bitmap = np.zeros(1 << (bits - 5), np.uint32)
    bitmap[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.uint32)
    return bitmap.view(np.uint8)


def limit_cells(ends: DataFrame) -> DataFrame:
    """Lengths at which texts pile up: ``source, unit, length, limit, below, usual``.

    A limit is a length, in characters or bytes, that far more texts of a source have than lengths around it, or
    a cliff: far more texts end within SLACK before it than after it and than further before it, as they do where
    a cut moves back to the last whole word or character. ``below`` is the distance to the limit, ``usual`` the
    share of the texts of this length that the lengths further before let expect.
    """
    lengths = (
        ends.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length")))).alias("s"))
        .groupBy("source", "s.unit", "s.length")
        .agg(F.count("*").alias("n"))
    )
    over = lambda a, b: F.coalesce(F.sum("n").over(Window.partitionBy("source", "unit").orderBy("length").rangeBetween(a, b)), F.lit(0))
    seen = (
        lengths.withColumn("around", (over(-10, 10) - F.col("n")) / 20)
        .withColumn("inside", over(1 - SLACK, 0))
        .withColumn("after", over(1, SLACK))
        .withColumn("before", over(-5 * SLACK, -SLACK - 1) / (4 * SLACK))
    )
    peak = (F.col("n") >= LIMIT_TEXTS) & (F.col("n") > LIMIT_TIMES * F.greatest("around", F.lit(0.5)))
    cliff = (F.col("inside") >= LIMIT_TEXTS) & (F.col("inside") > LIMIT_TIMES * F.col("after")) & (F.col("inside") > 2 * SLACK * F.col("before"))
    limits = seen.where(peak | cliff).select("source", "unit", F.col("length").alias("limit"), F.explode(F.when(cliff, F.sequence(F.lit(0), F.lit(SLACK - 1))).otherwise(F.array(F.lit(0)))).alias("below"))
    nearest = limits.groupBy("source", "unit", (F.col("limit") - F.col("below")).alias("length")).agg(F.min("below").alias("below"))
    same = [nearest["source"].eqNullSafe(seen["source"]), nearest["unit"] == seen["unit"], nearest["length"] == seen["length"]]
    return nearest.join(seen, on=same).select(
        nearest["source"], nearest["unit"], nearest["length"], (nearest["length"] + F.col("below")).alias("limit"), "below", F.least(F.lit(1.0), (F.col("before") + 0.5) / F.col("n")).alias("usual")
    )


def _kinds(ends: DataFrame) -> DataFrame:
    """``ends`` with ``kind``, the ``cell`` and ``part`` of it whose odds are estimated, and ``complete``, the first
    guess at how likely the text is complete."""
    cells = limit_cells(ends)
    out = ends
    for unit, column in (("chars", "length"), ("bytes", "bytes")):
        own = cells.where(F.col("unit") == unit).select(F.col("source").alias("s"), F.col("length").alias("l"), F.struct("usual", F.concat_ws("-", "unit", "limit").alias("cell"), F.col("below").cast("string").alias("part")).alias(f"_{unit}"))
        out = out.join(own, on=[F.col("source").eqNullSafe(F.col("s")), F.col(column) == F.col("l")], how="left").drop("s", "l")
    limit = F.least("_chars", "_bytes")  # nulls are skipped; the one with more texts than usual comes first
    plain = F.struct(F.lit(1.0).alias("usual"), F.lit("plain").alias("cell"), F.col("lang").alias("part"))
    debris = F.struct(F.lit(0.0).alias("usual"), F.lit("debris").alias("cell"), F.lit("").alias("part"))
    return (
        out.withColumn("_k", F.when(F.col("debris"), debris).otherwise(F.coalesce(limit, plain)))
        .withColumn("kind", F.when(F.col("_k.cell").isin("plain", "debris"), F.col("_k.cell")).otherwise("limit"))
        .select("doc_id", "source", "lang", "length", "bare", "keys", "kind", "_k.cell", "_k.part", F.col("_k.usual").alias("complete"))
    )


def _novel(ends: DataFrame) -> DataFrame:
    """``ends`` with ``single``: for each context but the last, whether no other text that ends in it ends in the
    next finer one too."""
    pairs = ends.select("doc_id", F.posexplode(F.arrays_zip(F.slice("keys", 1, len(CONTEXTS) - 1).alias("a"), F.slice("keys", 2, len(CONTEXTS) - 1).alias("b"))).alias("at", "pair"))
    alone = pairs.groupBy("at", "pair").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1").groupBy("doc_id").agg(F.collect_set("at").alias("ats"))
    return ends.join(alone, "doc_id", "left").withColumn("single", F.transform(F.sequence(F.lit(0), F.lit(len(CONTEXTS) - 1)), lambda i: F.coalesce(F.array_contains("ats", i), F.lit(False)))).drop("ats")


def _ratios(ends: DataFrame, positions: DataFrame, depth: int) -> DataFrame:
    """``ends`` without keys and with ``log_ratio``: the log of how often texts end anywhere (per character of
    their source and language) over how often they end, for each time they go on, in this text's final context.

    Each text counts as an end as far as it is ``complete``, and never for itself. The rate is followed from
    coarse to fine. In the first context in which no other text ends it becomes that of ends new to the context
    before: those that no other text shares, over the places there (the Good-Turing estimate). From there on the
    places at which nothing ended lower it further. A context after which nothing goes on either tells nothing.
    """
    counts = positions.join(
        ends.select("complete", F.explode(F.slice(F.arrays_zip("keys", "single"), 1, depth)).alias("k")).groupBy(F.col("k.keys").alias("key")).agg(F.count("*").alias("ends"), F.sum("complete").alias("e"), F.sum(F.when(F.col("k.single"), F.col("complete")).otherwise(0.0)).alias("t")),
        "key",
    ).withColumn("n", F.greatest(F.col("n") - F.col("ends"), F.lit(0)))
    by_stratum = ends.groupBy("source", "lang").agg(F.sum("complete").alias("d"), F.sum("bare").alias("c"))
    by_source = by_stratum.groupBy(F.col("source").alias("of")).agg(F.sum("d").alias("sd"), F.sum("c").alias("sc"))
    weight = 20.0  # texts of the whole source that stand beside those of one language in it
    base = by_stratum.join(by_source, F.col("source").eqNullSafe(F.col("of"))).select(
        F.col("source").alias("s"), F.col("lang").alias("g"), F.least(F.lit(0.5), (F.col("d") + weight) / (F.col("c") + weight * (F.col("sc") + 1) / (F.col("sd") + 1))).alias("base")
    )
    step = f"""named_struct(
        'p', CAST(CASE WHEN y.e >= 0.5 AND a.open THEN least((y.e + 1) / (y.n + 1 / a.p), 100)
                  ELSE 1 / (y.n + 1 / CASE WHEN a.open AND y.n > 0 THEN least(a.p, a.h) ELSE a.p END) END AS DOUBLE),
        'h', CAST(y.t / greatest(y.n, 1) AS DOUBLE), 'open', a.open AND (y.e >= 0.5 OR y.n = 0))"""
    others = "transform(xs, x -> named_struct('n', x.n, 'e', greatest(0D, x.e - complete), 't', greatest(0D, x.t - IF(single[x.at], complete, 0D)) + 0.5D))"
    seen = (
        ends.select("doc_id", F.posexplode(F.slice("keys", 1, depth)).alias("at", "key"))
        .join(counts, "key")
        .groupBy("doc_id")
        .agg(F.sort_array(F.collect_list(F.struct("at", "e", "n", "t"))).alias("xs"))
    )
    return (
        ends.drop("keys", "bare")
        .join(seen, "doc_id")
        .join(base, on=[F.col("source").eqNullSafe(F.col("s")), F.col("lang") == F.col("g")])
        .withColumn("log_ratio", F.expr(f"ln(base) - ln(aggregate({others}, named_struct('p', CAST(base AS DOUBLE), 'h', CAST(base AS DOUBLE), 'open', true), (a, y) -> {step}).p)"))
        .drop("xs", "base", "s", "g", "single")
    )


def _odds(bins: pd.DataFrame) -> pd.DataFrame:
    """The share of cuts among the texts of each part of one cell, by expectation maximisation over binned ratios.

    A part leans on the whole cell as if two more of its texts had that share.
    """
    parts, at = np.unique(bins["part"].to_numpy(), return_inverse=True)
    ratio, n = np.exp(bins["bin"].to_numpy() / 10.0), bins["n"].to_numpy().astype(float)
    size, rate = np.bincount(at, weights=n), np.full(len(parts), 0.5)
    for _ in range(60):
        odds = (rate / (1 - rate))[at] * ratio
        cuts = np.bincount(at, weights=odds / (1 + odds) * n)
        rate = np.clip((cuts + 2 * (cuts.sum() + 0.5) / (size.sum() + 1)) / (size + 2), 1e-4, 0.99)
    return pd.DataFrame({"s": [bins["source"].iloc[0]] * len(parts), "c": bins["cell"].iloc[0], "r": parts, "prior": np.log(rate / (1 - rate))})


def truncated(documents: DataFrame) -> DataFrame:
    """Per non-empty text: ``doc_id, source, lang, length, kind, log_odds, is_cut``.

    ``kind`` tells what else speaks for a cut: ``debris`` at the end, a ``limit`` (see ``limit_cells``), or
    ``plain`` nothing. The prior odds are estimated from the texts themselves: per source for debris, per limit
    and distance from it, and per source and language for the rest; a transfer cuts texts at a limit as others. A text counts as cut where the log odds are
    above 0, that is where its ``log_ratio`` passes the threshold of its source, language and kind.

    Cuts would teach the model that texts end where they were cut, the more of them the more texts there are. So
    ends are counted by how likely the text is complete: at first by its kind, then by what the round before found.

    Null and empty texts and those of null id are left out (they are no case); null is a source of
    its own. Each row stands for itself; ids are expected to be unique.
    """
    spark = documents.sparkSession
    texts = spread(documents.where(F.col("doc_id").isNotNull() & (F.length("text") > 0)).select("doc_id", "source", "text"))
    ends = cut(texts.mapInPandas(_ends, ENDS))
    wanted = spark.sparkContext.broadcast(_filter_of(ends.select(F.explode("keys").alias("key"))))
    positions = cut(texts.select("source", "text").mapInPandas(_counter(wanted), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    ends = cut(_novel(_kinds(ends)))
    found = None
    for turn, depth in enumerate(DEPTHS):
        if found is not None:
            ends = cut(ends.drop("complete").join(found.select("doc_id", (1 / (1 + F.exp("log_odds"))).alias("complete")), "doc_id"))
        ratios = cut(_ratios(ends, positions, depth))
        bins = ratios.groupBy("source", "cell", "part", F.round(F.col("log_ratio") * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))
        priors = cut(bins.groupBy("source", "cell").applyInPandas(_odds, "s string, c string, r string, prior double"))
        anywhere = priors.where("c = 'plain'").select(F.col("s").alias("ps"), F.col("r").alias("pr"), F.col("prior").alias("transfer"))
        prior = F.greatest("prior", "transfer") if turn else F.when(F.col("kind") == "plain", F.log(F.lit(PRIOR_ODDS))).otherwise(F.col("prior"))
        found = (
            ratios.join(priors, on=[F.col("source").eqNullSafe(F.col("s")), F.col("cell") == F.col("c"), F.col("part") == F.col("r")])
            .join(anywhere, on=[F.col("source").eqNullSafe(F.col("ps")), F.col("lang") == F.col("pr")], how="left")
            .withColumn("log_odds", F.col("log_ratio") + prior)
        )
    return found.select("doc_id", "source", "lang", "length", "kind", "log_odds", (F.col("log_odds") > 0).alias("is_cut"))


def rates(found: DataFrame) -> DataFrame:
    """Per source: texts, those cut off, and their share."""
    return found.groupBy("source").agg(F.count("*").alias("texts"), F.count_if("is_cut").alias("cut_texts")).withColumn("cut_rate", F.col("cut_texts") / F.col("texts"))
