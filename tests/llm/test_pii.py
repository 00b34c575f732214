"""The tagger: training, scores, decoding, and what it adds."""

import numpy as np

from tessera.llm import crf_lstm, pii


def plain_viterbi(scores, moves):
    if not len(scores):
        return []
    best, back = scores[0].astype(float), []
    for row in scores[1:]:
        ways = best[:, None] + moves
        back.append(ways.argmax(0))
        best = ways.max(0) + row
    out = [int(best.argmax())]
    for step in reversed(back):
        out.append(int(step[out[-1]]))
    return out[::-1]


def plain_scores(model, symbols):
    """One window, a character at a time."""
    w = model.weights
    hidden, both = len(w["ul"]), []
    for d, read in (("l", symbols), ("r", symbols[::-1])):
        h, c, out = np.zeros(hidden), np.zeros(hidden), []
        for x in read:
            z = w["e"][x] @ w[f"w{d}"] + h @ w[f"u{d}"] + w[f"b{d}"]
            i, f, o = (np.clip(z[k * hidden : (k + 1) * hidden] / 4 + 0.5, 0, 1) for k in range(3))
            g = z[3 * hidden :] / (1 + abs(z[3 * hidden :]))
            c = f * c + i * g
            h = o * c / (1 + abs(c))
            out.append(h)
        both.append(out if d == "l" else out[::-1])
    return np.concatenate(both, 1) @ w["o"] + w["ob"]


def test_blocks_decode_as_one_pass():
    draw = np.random.default_rng(0)
    for _ in range(150):
        crf_lstm.BLOCK = int(draw.integers(2, 9))
        bounds = np.cumsum([0, *draw.integers(0, 60, draw.integers(1, 8))])
        moves, scores = draw.normal(size=(5, 5)) * 2, draw.normal(size=(bounds[-1], 5)) * 2
        scores[:, 0] += draw.uniform(0, 4)
        want = [t for a, b in zip(bounds[:-1], bounds[1:], strict=True) for t in plain_viterbi(scores[a:b], moves)]
        assert crf_lstm.viterbi(scores, moves, bounds).tolist() == want
    crf_lstm.BLOCK = 64


def test_every_character_is_scored_by_the_model():
    """Texts of many lengths at once; a text's scores don't depend on its neighbours, and are those
    of a plain loop over its windows, blended where these overlap."""
    model, draw = pii.tagger(), np.random.default_rng(3)
    signs = list("abc xyz 019 @.-+ éß")
    texts = ["".join(draw.choice(signs, n)) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 1984, 1985, 2500)]
    scores, bounds = pii.emissions(texts, model)
    assert bounds.tolist() == np.cumsum([0, *map(len, texts)]).tolist() and len(scores) == bounds[-1]
    for k, t in enumerate(texts):
        want, weight = np.zeros((len(t), 5)), np.zeros(len(t))
        for a, b in pii.windows(len(t)):
            ramp = np.ones(b - a)
            rise = (np.arange(pii.OVERLAP) + 0.5) / pii.OVERLAP
            if a:
                ramp[: pii.OVERLAP] *= rise[: b - a]
            if b < len(t):
                ramp[-pii.OVERLAP :] *= rise[::-1]
            want[a:b] += plain_scores(model, pii.codes(t[a:b])) * ramp[:, None]
            weight[a:b] += ramp
        assert np.allclose(weight, 1) and np.allclose(scores[bounds[k] : bounds[k + 1]], want, atol=2e-3)


def test_gradients_equal_differences():
    draw = np.random.default_rng(5)
    model = crf_lstm.Tagger.fresh(7, 3, 4, 3)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, tags = draw.integers(0, 7, (6, 2)), draw.integers(0, 3, (6, 2))
    _, g = model.step(x, tags)
    for name, w in model.weights.items():
        for _ in range(3):
            at = tuple(draw.integers(0, n) for n in w.shape)
            w[at] += 1e-5
            up = model.step(x, tags)[0]
            w[at] -= 2e-5
            down = model.step(x, tags)[0]
            w[at] += 1e-5
            assert abs((up - down) / 2e-5 - g[name][at]) < 1e-4


def test_tagger_adds_and_base_stays():
    model = pii.tagger()
    text = "call (212) 555-0187 now or write to jo.doe@mail3.example.com about 10.1.2.3 today"
    base = pii.base_spans(text)
    assert [(k, text[s:e]) for s, k, e in base] == [(0, "jo.doe@mail3.example.com"), (1, "10.1.2.3")]
    assert "(212) 555-0187" in [text[s:e] for s, k, e in pii.tagged_spans([text], model)[0] if k == 3]
    hidden = "please write to tessa at mail dot com or ask here"
    assert [(k, hidden[s:e]) for s, k, e in pii.tagged_spans([hidden], model)[0]] == [(0, "tessa at mail dot com")]


def test_spans_held_out():
    """Drawn windows with another seed: most spans are found to the character."""
    x, tags = pii.drawn_examples(300, 77, 256)
    model = pii.tagger()
    lanes = x.T.astype(np.uint8)
    both = model.scores(np.stack([lanes, lanes[:, ::-1]]), np.full(300, 256))
    scores = (both[0] + both[1][:, ::-1] + model.weights["ob"]).reshape(-1, 5)
    bounds = np.arange(0, 300 * 256 + 1, 256)
    found, want = crf_lstm.viterbi(scores, model.weights["m"], bounds), tags.T.ravel()
    spans = [{(s, e, int(t[s])) for s, e in pii._runs(t, bounds)} for t in (found, want)]
    assert len(spans[0] & spans[1]) > 0.8 * len(spans[1]) and (found == want).mean() > 0.97


def test_long_texts_of_digits():
    import time

    began = time.thread_time()
    pii.tagged_spans(["0123456789" * 60_000, "1 " * 100_000], pii.tagger())
    assert time.thread_time() - began < 60
