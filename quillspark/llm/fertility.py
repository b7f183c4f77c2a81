"""Quality rules: word and line counts of a document, and how well a public vocabulary fits it.

A text that belongs to its language is cut into few tokens of several characters. Noise, broken encodings, keyboard runs and one
repeated string show in three figures: characters per token, the share of tokens that are pieces of a character (byte fallback),
and the entropy of the document's tokens as a share of the largest entropy so many tokens can have. Each language or, for
languages without a row of their own, the text's main script has a band; a document outside it is rejected. A band is what
prose can be at all, narrowed to fences around the quartiles of all different texts of that language that pass the base rules: quartiles are
exact over values in steps, so they don't depend on the order of rows, and neither junk nor copies move them much. Figures and a hash of each
different text are shuffled for that, no texts.

Defined results: null text has no words and so fails the base rules; the language may be null or unknown (the script decides); ids
are handed through (null or repeated too); other columns are ignored by ``quality_rules`` and kept by ``clean_documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textkit as K
from . import vocab
from .scratch import free_name, written

#: Characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

#: Parameters. Characters per token (least, most), largest byte-fallback share, least share of entropy: beyond it, nothing is prose.
LANGUAGE_BANDS = {
    "en": (1.5, 8.0, 0.15, 0.25),
    "de": (1.2, 8.0, 0.20, 0.25),
    "fr": (1.2, 8.0, 0.20, 0.25),
    "es": (1.2, 8.0, 0.20, 0.25),
}
SCRIPT_BANDS = {
    "latin": (1.1, 9.0, 0.30, 0.20),
    "greek": (0.7, 6.0, 0.60, 0.25),
    "cyrillic": (0.7, 7.0, 0.60, 0.25),
    "arabic": (0.5, 6.0, 0.80, 0.25),
    "indic": (0.3, 6.0, 0.98, 0.20),
    "east": (0.3, 4.0, 0.98, 0.25),
    "other": (0.3, 9.0, 1.00, 0.20),
}
#: Parameters of the fences: for each figure, interquartile ranges and the least distance below the first and above the third
#: quartile (None: no fence there). Characters per token is what tells; the distances are wide for the others. The distance for
#: characters per token is a share of the median, so that few documents make no narrow band.
FENCES = {"chars_per_token": ((4, 0.08), (8, 0.25)), "fallback_share": (None, (8, 0.10)), "entropy_share": ((5, 0.20), None)}
#: Steps that figures are rounded down to for quartiles.
STEPS = {"chars_per_token": 1 / 512, "fallback_share": 1 / 1024, "entropy_share": 1 / 1024}
#: Vocabulary for a language; others take the multilingual one.
VOCABULARIES = {"en": "byte_bpe_50k"}
DEFAULT_VOCABULARY = "byte_bpe_multi_50k"

#: First code point after each stretch of scripts, and the stretch's name.
SCRIPT_ENDS = np.array([0x41, 0x250, 0x370, 0x400, 0x530, 0x590, 0x780, 0x900, 0x1000, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0xD800, 0xF900, 0xFB00, 0x20000, 0x32000, 0x110000])
SCRIPT_NAMES = ["", "latin", "latin", "greek", "cyrillic", "other", "arabic", "other", "indic", "other", "latin", "greek", "", "east", "other", "east", "other", "east", "other"]


def script(text: str) -> str:
    """The script that most letters of a text belong to."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    counts = np.bincount(np.searchsorted(SCRIPT_ENDS, points, "right"), minlength=len(SCRIPT_NAMES) + 1)
    sums: dict[str, int] = {}
    for name, count in zip(SCRIPT_NAMES, counts.tolist(), strict=False):
        if name:
            sums[name] = sums.get(name, 0) + count
    best = max(sums, key=lambda x: sums[x])
    return best if sums[best] else "other"


def base_counts(column: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text."""
    data, offsets = K.buffer(column)
    rows = len(column)
    starts, stops, row = K.spans(data, offsets)
    codes, distinct = K.coded(K.as_binary(data, starts, stops))

    def summed(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[offsets[1:]] - total[offsets[:-1]]

    begins_char = ((data & 0xC0) != 0x80) & ~K.SPACE[data]
    out = {"n_words": np.bincount(row, minlength=rows), "word_chars": summed(begins_char), "n_symbols": summed(SYMBOLS[data])}

    # lines: stretches between line feeds, within rows
    feeds = np.flatnonzero(data == 10)
    first = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    line_row = np.sort(np.concatenate([np.arange(rows), np.searchsorted(offsets, feeds, "right") - 1]))
    ends = np.append(first[1:], len(data))
    last_in_row = np.append(line_row[1:] != line_row[:-1], True) if len(line_row) else np.empty(0, bool)
    line_ends = np.where(last_in_row, offsets[1:][line_row], ends - 1)
    solid = np.concatenate([[0], np.cumsum(~K.SPACE[data], dtype=np.int64)])
    real = solid[line_ends] > solid[first]
    first, line_ends, line_row = first[real], line_ends[real], line_row[real]
    line_codes, _ = K.coded(K.as_binary(data, first, line_ends))
    pairs = np.unique(line_row * (len(first) + 1) + line_codes)
    out["n_dup_lines"] = np.bincount(line_row, minlength=rows) - np.bincount(pairs // (len(first) + 1), minlength=rows)

    # three-word windows that occur twice in a row
    covered = np.zeros(len(codes), bool)
    if len(codes) > 2:
        size = len(distinct) + 1
        pair = codes[:-2] * size + codes[1:-1]
        if size >= 1 << 21:  # of one very long row: number the pairs, so that three words fit 64 bits
            pair = np.unique(pair, return_inverse=True)[1]
        window = pair * size + codes[2:]
        inside = np.flatnonzero(row[2:] == row[:-2])
        window = window[inside]
        order = np.argsort(window)
        ranked = window[order]
        same = np.zeros(len(ranked) + 1, bool)
        same[1:-1] = ranked[1:] == ranked[:-1]
        twice = same[1:] | same[:-1]
        rank = np.cumsum(~same[:-1])[twice]
        at = inside[order[twice]]
        key = rank * (rows + 1) + row[at]
        by = np.argsort(key, kind="stable")
        key, at = key[by], at[by]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        at = at[same[1:] | same[:-1]]
        for step in range(3):
            covered[at + step] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=rows)
    return out


def figures(text: str, vocabulary: str, vocab_dir: str) -> tuple[int, float, float, float]:
    """Tokens, characters per token, byte-fallback share, entropy share."""
    ids = vocab.ids(text, vocabulary, vocab_dir)
    n = len(ids)
    if not n:
        return 0, 0.0, 0.0, 0.0
    ranked = np.sort(ids)
    counts = np.diff(np.append(np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])), n))
    share = counts / n
    entropy = float(-(share * np.log2(share)).sum())
    return n, len(text) / n, float(vocab.fragments(vocabulary, vocab_dir)[ids].mean()), entropy / max(1.0, float(np.log2(n)))


def _measured(column: pa.Array, langs: list, vocab_dir: str) -> dict:
    out: dict = base_counts(column)
    out["base_failed"] = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
    found = []
    for text, lang in zip(column.to_pylist(), langs, strict=True):
        name = VOCABULARIES.get(lang, DEFAULT_VOCABULARY)
        found.append((*figures(text, name, vocab_dir), lang if lang in LANGUAGE_BANDS else script(text)))
    for key, values in zip(("n_tokens", "chars_per_token", "fallback_share", "entropy_share", "band"), zip(*found, strict=True), strict=True):
        out[key] = np.array(values)
    return out


def general(band: str) -> tuple[float, float, float, float]:
    return LANGUAGE_BANDS.get(band) or SCRIPT_BANDS[band]


def fitted(measured: DataFrame) -> dict[str, tuple[float, float, float, float]]:
    """The band of each language or script that occurs, in the form of LANGUAGE_BANDS. measured: the figures of all documents and tkey; each different text counts once."""
    quartiles = [F.percentile(F.floor(F.col(name) / step) * step, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(name) for name, step in STEPS.items()]
    out = {}
    # equal texts of a band have equal figures
    texts = measured.where("not base_failed").groupBy("band", "tkey").agg(*[F.max(name).alias(name) for name in STEPS])
    for row in texts.groupBy("band").agg(*quartiles).collect():  # as many rows as there are languages and scripts
        least, most, fallback, entropy = general(row.band)

        def fence(name: str, up: bool, row=row) -> float:
            low, middle, high = row[name]
            ranges, distance = FENCES[name][up]
            away = max(ranges * (high - low), distance * (middle if name == "chars_per_token" else 1))
            return high + away if up else low - away

        out[row.band] = (max(least, fence("chars_per_token", False)), min(most, fence("chars_per_token", True)), min(fallback, fence("fallback_share", True)), max(entropy, fence("entropy_share", False)))
    return out


FIGURES = [
    ("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long"), ("base_failed", "boolean"),
    ("n_tokens", "long"), ("chars_per_token", "double"), ("fallback_share", "double"), ("entropy_share", "double"), ("band", "string"),
]
ARROW = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


def measure(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None, vocab_dir: str) -> DataFrame:
    """doc_id, FIGURES and tkey (a hash of the text) of each document."""

    def run(batches):
        for batch in K.slices(batches):
            found = _measured(K.texts(batch), batch.column(2).to_pylist(), vocab_dir)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[k], ARROW[t]) for k, t in FIGURES), batch.column(3)], names=["doc_id", *(k for k, _ in FIGURES), "tkey"])

    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    wanted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    wanted = wanted.withColumn("tkey", F.xxhash64("text"))
    return wanted.mapInArrow(K.trimmed(run), "doc_id long, " + ", ".join(f"{k} {t}" for k, t in FIGURES) + ", tkey long")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocab_dir: str = vocab.VOCAB_DIR) -> DataFrame:
    """One row per document: its id as doc_id, the base counts, the vocabulary's figures, the band it is held to and the verdict."""
    measured = written(measure(docs, id_col, text_col, lang_col, vocab_dir), "quality-figures")
    bands = fitted(measured)
    in_band = inside(bands, F.col)
    return measured.drop("tkey").select("*", in_band.alias("in_band"), (~F.col("base_failed") & in_band).alias("kept"))


def clean_documents(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", vocab_dir: str = vocab.VOCAB_DIR) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns. Rows are written once with their figures, and neither measured again nor shuffled."""
    own = free_name(docs.columns)
    needed = [("base_failed", "boolean"), *((k, "double") for k in STEPS), ("band", "string")]

    def run(batches):
        for batch in K.slices(batches, text_col):
            found = _measured(K.texts(batch, text_col), batch.column(batch.schema.get_field_index(lang_col)).to_pylist(), vocab_dir)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[k], ARROW[t]) for k, t in needed)], names=[*batch.schema.names, *(f"{own}_{k}" for k, _ in needed)])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(f"{own}_{k}", T._parse_datatype_string(t)) for k, t in needed)])
    measured = written(docs.mapInArrow(K.trimmed(run), schema), "quality-rows")
    figures_of = [F.col(f"{own}_{k}").alias(k) for k, _ in needed]
    bands = fitted(measured.select(*figures_of, F.xxhash64(F.col(f"`{text_col}`").cast("string")).alias("tkey")))
    kept = ~F.col(f"{own}_base_failed") & inside(bands, lambda k: F.col(f"{own}_{k}"))
    return measured.where(kept).select(*[F.col(f"`{c}`") for c in docs.columns])


def inside(bands: dict[str, tuple[float, float, float, float]], of: Callable[[str], Column]) -> Column:
    """Whether a row's figures are within the band of its language or script."""
    out = F.lit(False)
    for band, (least, most, fallback, entropy) in bands.items():
        out = out | ((of("band") == band) & of("chars_per_token").between(least, most) & (of("fallback_share") <= fallback) & (of("entropy_share") >= entropy))
    return out
