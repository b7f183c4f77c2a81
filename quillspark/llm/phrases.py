"""Collocations by contiguous pattern growth in the manner of PrefixSpan.

Two passes over the texts. The first counts single words and, as a filter only, pairs of neighbours. The second projects: each
place where a frequent word begins a frequent pair is a pointer to what follows, cut where the next pair isn't frequent or the piece
ends. Equal pointers are merged with their number before they are shuffled. A prefix and its projected pointers are then one
task's work: it extends the prefix to the right by each next word that is frequent enough, projects again and goes on depth-first. A
prefix whose projection is large is dealt by its next word, so its subtrees are tasks of their own.

The filter goes to the tasks as a bitmap of a fixed number of bits; a bit that several pairs share only lets more pointers pass, and the
growth counts exactly. Words and pairs are known by 63-bit hashes that hold their language.

Defined results: null text is empty; a null language is ``und`` and one with texts that say so; a row counts as often as it occurs, its
id doesn't matter; very long words and texts are words and texts; other columns are ignored; an empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textkit as K
from .scratch import discard, written

#: The characters that end a piece, and those that part the words of a piece.
PIECE_ENDS = ".,;:!?\n\x0b\x0c\r"
WORD_GAPS = " \t"
#: Bits of the filter of frequent pairs: 4 MB in each task, whatever the corpus holds.
FILTER_BITS = 1 << 25
#: Different pointers of a prefix beyond which its subtrees are dealt apart.
LARGE_PREFIX = 256
#: Items that a task merges at once.
HELD = 1 << 20

ENDS, GAPS = np.zeros(256, bool), np.zeros(256, bool)
ENDS[[ord(c) for c in PIECE_ENDS]] = True
GAPS[[ord(c) for c in PIECE_ENDS + WORD_GAPS]] = True


def _tokens(batch: pa.RecordBatch) -> tuple:
    """Bytes in lower case, starts, stops, rows and hashes of the words (even numbers), which words have a neighbour to the right in their piece, and the rows' languages."""
    langs = [x if x is not None else "und" for x in batch.column(1).to_pylist()]
    data, offsets = K.buffer(K.texts(batch))
    data = K.LOWER[data]
    starts, stops, row = K.spans(data, offsets, GAPS)
    seeds = np.array([xxhash.xxh3_64_intdigest(x.encode()) for x in langs], np.uint64)
    words = K.mixed(K.hashes(data, starts, stops) ^ seeds[row]) & ~np.uint64(1)
    piece = np.cumsum(ENDS[data], dtype=np.int64)[starts] if len(starts) else np.empty(0, np.int64)
    linked = np.zeros(len(starts), bool)
    linked[:-1] = (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
    return data, starts, stops, row, words, linked, langs


def _pairs(words: np.ndarray) -> np.ndarray:
    """The hash of each word and its right neighbour (odd numbers)."""
    with np.errstate(over="ignore"):
        return K.mixed(words[:-1] * np.uint64(K.BASE) + words[1:]) | np.uint64(1)


def _supports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []
    totals: dict[str, int] = {}

    def merged() -> Iterator[pa.RecordBatch]:
        found, n = np.unique(np.concatenate(held), return_counts=True)
        for at in range(0, len(found), 1 << 17):
            h = found[at : at + (1 << 17)].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.string()), pa.array(h), pa.array(n[at : at + len(h)])], names=["lang", "h", "n"])

    for batch in K.slices(batches):
        _, _, _, row, words, linked, langs = _tokens(batch)
        for r, n in zip(*(x.tolist() for x in np.unique(row, return_counts=True)), strict=True):
            totals[langs[r]] = totals.get(langs[r], 0) + n
        held += [words, _pairs(words)[linked[:-1]]]
        if sum(map(len, held)) > HELD:
            yield from merged()
            held = []
    if held:
        yield from merged()
    yield pa.RecordBatch.from_pydict({"lang": list(totals), "h": [None] * len(totals), "n": list(totals.values())}, schema=pa.schema([("lang", pa.string()), ("h", pa.int64()), ("n", pa.int64())]))


def supports(docs: DataFrame, least: int) -> DataFrame:
    """h, n of each word (even h) and pair (odd h) that occurs ``least`` times; lang, n of each language's words where h is null. Written."""
    found = docs.mapInArrow(K.trimmed(_supports), "lang string, h long, n long").groupBy("lang", "h").agg(F.sum("n").alias("n"))
    return written(found.where((F.col("n") >= least) | F.col("h").isNull()), "phrase-supports")


def _filter(found: DataFrame) -> bytes:
    """The bitmap of frequent pairs, of FILTER_BITS bits however many pairs there are."""
    slot = F.shiftrightunsigned("h", 1).bitwiseAND(FILTER_BITS - 1)
    cells = found.where("h is not null and (h & 1) = 1").select(F.shiftrightunsigned(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(h, 1) & 63 as int))").alias("bit"))
    got = cells.groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[got.column("cell").to_numpy()] = got.column("bits").to_numpy()
    return out.tobytes()


def _names(most: int) -> list[str]:
    return [f"w{j}" for j in range(1, most + 1)]


def _projection(bitmap, most: int) -> Callable:
    """Pointers (lang, w1 ..., n); and, where n is null, each task's words (lang, w1, word) that pointers need."""
    schema = pa.schema([("lang", pa.string()), *[(w, pa.int64()) for w in _names(most)], ("word", pa.string()), ("n", pa.int64())])

    def run(batches):
        bits = np.frombuffer(bitmap.value, np.uint64)
        known = np.empty(0, np.uint64)
        numbers: dict[str, int] = {}
        held: list[np.ndarray] = []

        def merged() -> Iterator[pa.RecordBatch]:
            table = np.concatenate(held, axis=1)  # words and the language's number
            key = table[0].copy()
            with np.errstate(over="ignore"):
                for line in table[1:]:
                    key = K.mixed(key * np.uint64(K.BASE) + line)
            _, at, n = np.unique(key, return_index=True, return_counts=True)
            names = pa.array(list(numbers), pa.string())
            for a in range(0, len(at), 1 << 16):
                own = table[:, at[a : a + (1 << 16)]]
                columns = [pa.array(w.view(np.int64), mask=w == 0) for w in own[:-1]]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(own[-1].view(np.int64))), *columns, pa.nulls(own.shape[1], pa.string()), pa.array(n[a : a + own.shape[1]])], schema=schema)

        for batch in K.slices(batches):
            data, starts, stops, row, words, linked, langs = _tokens(batch)
            if len(words) < 2:
                continue
            pair = _pairs(words) >> np.uint64(1)
            slot = pair & np.uint64(FILTER_BITS - 1)
            good = np.zeros(len(words), bool)
            good[:-1] = linked[:-1] & ((bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)).astype(bool)
            at = np.flatnonzero(good)
            path, reach = [words[at]], np.ones(len(at), bool)
            for j in range(1, most):
                reach = reach & good[np.minimum(at + j - 1, len(words) - 1)]
                path.append(np.where(reach, words[np.minimum(at + j, len(words) - 1)], np.uint64(0)))
            for x in langs:
                numbers.setdefault(x, len(numbers))
            lang = np.array([numbers[x] for x in langs], np.uint64)
            held.append(np.stack([*path, lang[row[at]]]))
            used = np.union1d(at, at + 1)
            fresh, first = np.unique(words[used], return_index=True)
            new = ~np.isin(fresh, known)
            if new.any():
                known = np.union1d(known, fresh)
                place = np.sort(used[first[new]])
                text = K.as_binary(data, starts[place], stops[place]).cast(pa.string())
                none = pa.nulls(len(place), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([langs[r] for r in row[place].tolist()], pa.string()), pa.array(words[place].view(np.int64)), *[none] * (most - 1), text, none], schema=schema)
            if sum(x.shape[1] for x in held) > HELD // 2:
                yield from merged()
                held = []
        if held:
            yield from merged()

    return run


def _growth(least: int, most: int) -> Callable:
    """From pointers in order to a row for each frequent phrase; a task holds one prefix's pointers at a time."""
    schema = pa.schema([("lang", pa.string()), ("path", pa.list_(pa.int64())), ("a", pa.int64())])

    def grow(lang, path: list[int], words: np.ndarray, n: np.ndarray, out: list) -> None:
        """words: what follows ``path`` in its projection, in order; a zero is no word."""
        if not words.shape[1]:
            return
        edges = np.flatnonzero(np.append(True, words[1:, 0] != words[:-1, 0]))
        support = np.add.reduceat(n, edges)
        stops = np.append(edges[1:], len(n))
        for k in np.flatnonzero((support >= least) & (words[edges, 0] != 0)).tolist():
            longer = [*path, int(words[edges[k], 0])]
            out.append((lang, longer, int(support[k])))
            grow(lang, longer, words[edges[k] : stops[k], 1:], n[edges[k] : stops[k]], out)

    def run(batches):
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks().to_batches()
            if table:
                rest = yield from settled(table[0], False)
        if rest is not None and rest.num_rows:
            yield from settled(rest, True)

    def settled(batch: pa.RecordBatch, final: bool):
        deal = batch.column(0).to_numpy()
        edges = np.flatnonzero(np.append(True, deal[1:] != deal[:-1]))
        stops = np.append(edges[1:], len(deal))
        whole = len(edges) if final else len(edges) - 1
        out: list = []
        if whole:
            words = np.stack([batch.column(2 + j).fill_null(0).to_numpy() for j in range(most)], axis=1)
            n, langs = batch.column(2 + most).to_numpy(), batch.column(1)
            for a, b in zip(edges[:whole].tolist(), stops[:whole].tolist(), strict=True):
                # two prefixes may share a deal; each is a projection of its own
                starts = [a, *(a + 1 + np.flatnonzero(words[a + 1 : b, 0] != words[a : b - 1, 0])).tolist(), b]
                for x, y in zip(starts[:-1], starts[1:], strict=True):
                    grow(langs[x].as_py(), [int(words[x, 0])], words[x:y, 1:], n[x:y], out)
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("lang", "path", "a"), map(list, zip(*out, strict=True)), strict=True)), schema=schema)
        return batch.slice(int(edges[-1])) if not final else None

    return run


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, most_words: int = 3) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three written tables: phrases of two to ``most_words`` words (lang, words, a), words (lang, word, n) and languages (lang, n)."""
    assert most_words >= 2 and least >= 1
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    found = supports(texts, least)
    bitmap = spark.sparkContext.broadcast(_filter(found))
    names = _names(most_words)
    schema = f"lang string, {', '.join(f'{w} long' for w in names)}, word string, n long"
    pointers = texts.mapInArrow(K.trimmed(_projection(bitmap, most_words)), schema).groupBy("lang", *names, "word").agg(F.sum("n").alias("n"))
    pointers = written(pointers, "phrase-pointers")
    words = pointers.where("n is null").select("lang", F.col("w1").alias("h"), "word").join(found.select("h", "n"), "h").select("h", "lang", "word", "n")
    words = written(words, "phrase-words")
    prefixes = written(pointers.where("n is not null").groupBy(F.col("w1").alias("p")).agg(F.count(F.lit(1)).alias("size")), "phrase-prefixes")
    deal = F.when(F.col("size") > LARGE_PREFIX, F.xxhash64("w1", "w2")).otherwise(F.xxhash64("w1"))
    dealt = written(pointers.where("n is not null").join(prefixes, F.col("w1") == F.col("p")).select(deal.alias("deal"), "lang", *names, "n"), "phrase-dealt")
    grown = dealt.repartition("deal").sortWithinPartitions("deal", *names).mapInArrow(K.trimmed(_growth(least, most_words)), "lang string, path array<long>, a long")
    grown = written(grown, "phrase-grown")
    steps = grown.select("path", "a", F.posexplode("path").alias("j", "h")).join(words.select("h", "lang", "word"), "h")
    named = steps.groupBy("path", "a", "lang").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "word"))), lambda x: x["word"]).alias("words"))
    named = written(named.select("lang", "words", "a"), "phrase-named")
    languages = written(found.where("h is null").select("lang", "n"), "phrase-languages")
    known = written(words.select("lang", "word", "n"), "phrase-known")
    for table in (found, pointers, prefixes, dealt, grown, words):
        discard(table)
    bitmap.unpersist()
    return named, known, languages


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, most_words: int = 3, inside_percent: int = 50, top: int | None = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases, or all of them if ``top`` is None.

    A phrase's score is that of its lowest cut, floor(1000000 * a * a / (l * r)) in exact decimals (counts below 10**15). Phrases
    inside a longer one that occurs ``inside_percent`` in a hundred times as often as they do are left out.
    """
    named, words, languages = phrases(docs, text_col, lang_col, least, most_words)
    joined = lambda x: F.array_join(x, " ")
    parts = written(named.select("lang", joined("words").alias("part"), "a").unionByName(words.select("lang", F.col("word").alias("part"), F.col("n").alias("a"))), "phrase-parts")
    cuts = named.select("lang", joined("words").alias("phrase"), "a", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = written(cuts.select("lang", "phrase", "a", "k", F.expr("array_join(slice(words, 1, k), ' ')").alias("first"), F.expr("array_join(slice(words, k + 1, size(words)), ' ')").alias("rest")), "phrase-cuts")
    left = parts.select(F.col("lang").alias("l_lang"), F.col("part").alias("first_part"), F.col("a").alias("l"))
    right = parts.select(F.col("lang").alias("r_lang"), F.col("part").alias("rest_part"), F.col("a").alias("r"))
    half = written(cuts.join(left, (cuts.lang == left.l_lang) & (F.col("first") == left.first_part)).select("lang", "phrase", "a", "k", "rest", "l"), "phrase-halves")
    both = half.join(right, (half.lang == right.r_lang) & (F.col("rest") == right.rest_part))
    score = F.expr("cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    scored = both.select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("cut")).groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))
    inner = named.where(F.size("words") > 2).select("lang", "a", "words", F.explode(F.expr("transform(sequence(2, size(words) - 1), x -> x)")).alias("m"))
    inner = inner.select("lang", "a", F.explode(F.expr("transform(sequence(1, size(words) - m + 1), i -> array_join(slice(words, i, m), ' '))")).alias("inside"))
    outer = inner.groupBy(F.col("lang").alias("o_lang"), "inside").agg(F.max("a").alias("longer"))
    free = scored.join(outer, (scored.lang == outer.o_lang) & (scored.phrase == outer.inside) & (100 * outer.longer >= inside_percent * scored.a), "left_anti")
    out = free.join(languages.select(F.col("lang").alias("n_lang"), "n"), F.col("lang") == F.col("n_lang"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), F.asc("phrase"))).cast("long")
    out = out.withColumn("rank", rank)
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select("lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast("long").alias("score"))
