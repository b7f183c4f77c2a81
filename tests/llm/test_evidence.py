"""Figures of operators 2, 6 and 7 against versions that share no code with them: other tokenizer library, loops for BM25, direct convolution and DFT."""

import math
from collections import Counter

import numpy as np
import pytest
from quillspark.llm import audio, fertility, packing, vocab

from . import plain


def fragment(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return True
    return False


def plain_figures(text, lang):
    """By the JSON tokenizer where there is one, token by token."""
    name = fertility.VOCABULARIES.get(lang, fertility.DEFAULT_VOCABULARY)
    ids = vocab.json_encoder(name).encode(text or "", add_special_tokens=False).ids if name == "byte_bpe_50k" else vocab.encoder(name).encode_ordinary(text or "")
    if not ids:
        return 0, 0.0, 0.0, 0.0
    token = {rank: raw for raw, rank in vocab.ranks(name).items()}
    counts = Counter(ids)
    entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in counts.values())
    return len(ids), len(text) / len(ids), sum(fragment(token.get(i, b"x")) for i in ids) / len(ids), entropy / max(1.0, math.log2(len(ids)))


def quantile(values, q):
    values = sorted(values)
    at = q * (len(values) - 1)
    lo = math.floor(at)
    return values[lo] + (values[min(lo + 1, len(values) - 1)] - values[lo]) * (at - lo)


def test_token_figures_fences_and_verdict(spark):
    rows = [(i, t, lang if i % 3 else None) for i, t, lang, _ in plain.corpus(seed=3, n=90) if i is not None and i < 10_000]
    rows += [(300 + i, f"The river runs from village {i} to the sea and past many old mills, which nobody has counted since the war ended. " * (2 + i % 3), "en") for i in range(40)]
    rows += [(400 + i, f"Ключ {i} лежит под старым камнем у дороги, где никто его не ищет уже много лет подряд. " * 5, None) for i in range(12)]
    got = {r.doc_id: r for r in fertility.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect() if r.doc_id >= 300 or True}
    figures = [(i, t, *plain_figures(t, lang), plain.base2(t)[-1]) for i, t, lang in rows]
    bands = {}
    for i, _, n, chars, fallback, entropy, _ in figures:
        if sum(x[0] == i for x in rows) > 1:
            continue  # rows that share an id are told apart nowhere in a dict
        r = got[i]
        assert r.n_tokens == n and math.isclose(r.chars_per_token, chars) and math.isclose(r.fallback_share, fallback, abs_tol=1e-6) and math.isclose(r.entropy_share, entropy, abs_tol=1e-9), i
    for band in {r.band for r in got.values()}:
        texts = {t: f for i, t, *f, failed in figures if got[i].band == band and not failed}
        if not texts:
            continue
        least, most, fallback_most, entropy_least = fertility.general(band)
        three = [[quantile([math.floor(f[k] / step) * step for f in texts.values()], q) for q in (0.25, 0.5, 0.75)] for k, step in ((1, 1 / 512), (2, 1 / 1024), (3, 1 / 1024))]
        (a, b, c), (_, _, g), (x, _, z) = three
        bands[band] = (max(least, a - max(4 * (c - a), 0.08 * b)), min(most, c + max(8 * (c - a), 0.25 * b)), min(fallback_most, g + max(8 * (g - three[1][0]), 0.10)), max(entropy_least, x - max(5 * (z - x), 0.20)))
    checked = 0
    for i, _, _, chars, fallback, entropy, failed in figures:
        if sum(x[0] == i for x in rows) == 1:
            low, high, most, least = bands.get(got[i].band, (math.inf, 0, 0, 0))
            assert got[i].kept == (not failed and low <= chars <= high and fallback <= most and entropy >= least), i
            checked += 1
    assert checked > 120 and 30 < sum(r.kept for r in got.values()) < len(got)


def plain_scores(remainders, seed):
    """BM25 of every remainder for the seed's most telling tokens."""
    n, mean = len(remainders), sum(map(len, remainders)) / len(remainders)
    counts = [Counter(x.tolist()) for x in remainders]
    df = Counter(t for c in counts for t in c)
    known = {t for t in df if 1 < df[t] <= max(8, n // 10)}

    def weight(t, d):
        idf = math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
        return idf * counts[d][t] * 2.2 / (counts[d][t] + 1.2 * (0.25 + 0.75 * len(remainders[d]) / mean))

    asked = sorted((t for t in counts[seed] if t in known), key=lambda t: (-np.float32(weight(t, seed)), t))[: packing.QUERY_TOKENS]
    return [sum(float(np.float32(weight(t, d))) for t in asked if counts[d][t]) for d in range(n)]


@pytest.mark.parametrize("kinds", [300, 12])
def test_neighbours_are_those_of_plain_bm25(kinds):
    """With many kinds of tokens, and with so few that scores tie and most tokens are too common to ask for."""
    r = np.random.default_rng(kinds)
    remainders = [r.integers(0, kinds, r.integers(1, 60)).astype(np.int32) for _ in range(50)]
    remainders += [remainders[3].copy(), remainders[3].copy()]  # equal ones tie
    index = packing.Index(remainders)
    for seed in range(len(remainders)):
        assert np.allclose(index.scores(seed), plain_scores(remainders, seed), atol=1e-5)


def test_windows_take_the_best_unused_neighbours():
    r = np.random.default_rng(2)
    remainders = [r.integers(0, 200, r.integers(1, 50)).astype(np.int32) for _ in range(40)]
    window, used, out = 64, [0] * 40, []
    while any(used[d] < len(x) for d, x in enumerate(remainders)):
        free = [d for d, x in enumerate(remainders) if used[d] < len(x)]
        seed, pieces, room = free[0], [], window
        scores = plain_scores(remainders, seed)
        done = set()
        doc = seed
        while room and doc is not None:
            size = min(room, len(remainders[doc]) - used[doc])
            pieces.append((doc, used[doc], size))
            used[doc] += size
            room -= size
            done.add(doc)
            left = [d for d, x in enumerate(remainders) if used[d] < len(x)]
            near = [d for d in left if d not in done and scores[d] > 0]
            doc = max(near, key=lambda d: (np.float32(scores[d]), -d)) if near else (min(left) if left else None)
        out.append(pieces)
    assert list(packing.fill(remainders, window)) == out


def test_resampling_is_a_convolution():
    x = np.random.default_rng(4).normal(size=700).astype(np.float32)
    n = audio.UP * audio.TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / audio.DOWN) * np.hamming(n) / audio.DOWN * audio.UP
    stuffed = np.zeros(len(x) * audio.UP)
    stuffed[:: audio.UP] = x
    want = np.convolve(stuffed, h)[:: audio.DOWN][: -(-len(x) * audio.UP // audio.DOWN)]
    assert np.allclose(audio.resample(x), want, atol=1e-4)


def test_log_mel_by_the_definition():
    y = np.random.default_rng(5).normal(size=audio.FRAME + 3 * audio.HOP - 7).astype(np.float32)
    got = audio.log_mel(y)
    k = np.arange(audio.FRAME // 2 + 1)
    dft = np.exp(-2j * np.pi * k[:, None] * np.arange(audio.FRAME) / audio.FRAME)
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(audio.FRAME) / (audio.FRAME - 1))
    top = 2595 * math.log10(1 + audio.RATE_OUT / 2 / 700)
    edges = [700 * (10 ** (top * i / (audio.BANDS + 1) / 2595) - 1) for i in range(audio.BANDS + 2)]
    padded = np.concatenate([y, np.zeros(audio.FRAME)])
    assert len(got) == 4  # the last one is filled up
    for frame in range(len(got)):
        power = np.abs(dft @ (padded[frame * audio.HOP : frame * audio.HOP + audio.FRAME] * window)) ** 2
        for band in range(audio.BANDS):
            total = 0.0
            for b, p in enumerate(power):
                f = b * audio.RATE_OUT / audio.FRAME
                total += p * max(0.0, min((f - edges[band]) / (edges[band + 1] - edges[band]), (edges[band + 2] - f) / (edges[band + 2] - edges[band + 1])))
            assert abs(got[frame, band] - 10 * math.log10(total + 1e-6)) < 0.02


def test_spans_follow_the_signal():
    """Silence, a tone, silence: clips' spans cover the sound without gaps, and the one active stretch is where the tone is."""
    rate = audio.RATE_IN
    quiet, tone = np.full(rate, 128, np.uint8), (128 + 100 * np.sin(2 * np.pi * 440 * np.arange(rate) / rate)).astype(np.uint8)
    tensors, spans, stretches = audio.features(np.concatenate([quiet, tone, quiet]).tobytes())
    assert spans[0, 0] == 0 and np.allclose(spans[1:, 0], spans[:-1, 1]) and math.isclose(spans[-1, 1], 3.0, abs_tol=audio.HOP / audio.RATE_OUT * audio.CLIP)
    assert len(stretches) == 1 and abs(stretches[0, 0] - 1) < 0.05 and abs(stretches[0, 1] - 2) < 0.05
    assert len(tensors) == len(spans)
