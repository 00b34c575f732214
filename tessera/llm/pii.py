"""Personal data: exact base patterns, and a character-level BiLSTM-CRF that adds spans.

The base patterns are matched over whole texts. The tagger is trained in numpy from labelled spans
that are written into drawn sentences in many spellings, beside look-alikes (dates, versions,
amounts, times) that are labelled as nothing. It reads every character of every text: a text is cut
into overlapping windows, windows of many texts are scored together, the scores of two windows are
blended where they overlap, and one decoding over the whole text settles all of them. A span of the
tagger is added if it has what its kind needs and overlaps no base span.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns
from .crf_lstm import Tagger, viterbi
from .hashing import chunks

KINDS = ("email", "ip", "card", "phone")
#: Characters of a window, and of what it shares with the next one.
WINDOW, OVERLAP = 1024, 64
#: Characters of the labelled windows, their number, and steps of training.
DRAWN, EXAMPLES, STEPS = 64, 4000, 700
#: Characters that are scored at once, or one longer text.
BATCH = 1 << 19

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Spellings of "@" and "." that people use to hide addresses.
_AT = re.compile(r"\s*[\[({]?\s*(?:@|\bat\b)\s*[\])}]?\s*", re.I)
_DOT = re.compile(r"\s*[\[({]?\s*(?:[.]|\bdot\b)\s*[\])}]?\s*", re.I)
_ADDRESS = re.compile(r"[\w.%+-]+@[\w-]+(?:[.][\w-]+)+")
_SPACED = re.compile(r"[0-9](?:[\s.-]{0,2}[0-9])+")
_NUMBER = re.compile(r"[+(]?[0-9](?:[\s().+/-]{0,3}[0-9])+")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns, sorted."""
    out = []
    if "@" in text:
        done = 0
        for m in _DOMAIN.finditer(text):
            # The part before "@" reaches back as far as its characters do, up to the last match.
            start = m.start()
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start():
                out.append((start, 0, m.end()))
                done = m.end()
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


_SYMBOLS = "abcdefghijklmnopqrstuvwxyz@.-+() _%:/,;#\"'=\n"
_CODE = np.full(0x250, len(_SYMBOLS) + 2, np.uint8)  # other
for _k, _c in enumerate(_SYMBOLS):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _k
_CODE[48:58] = len(_SYMBOLS)
_CODE[0xC0:] = len(_SYMBOLS) + 1
N_SYMBOLS = len(_SYMBOLS) + 3
#: Letters get rarer along the list.
_FALLING = [0.88**k for k in range(30)]


def codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.take(_CODE, points, mode="clip")


def drawn_examples(count: int = EXAMPLES, seed: int = 1, length: int = DRAWN) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags (time, example) of labelled windows. Tags: 0 outside, 1 + k in kind k."""
    draw = random.Random(seed)
    pick = draw.choice

    def digits(n: int) -> str:
        return "".join(draw.choices("0123456789", k=n))

    def word(low: int = 2, high: int = 9) -> str:
        return "".join(draw.choices("etaoinshrdlucmfwypvbgkjqxzéäñö", _FALLING, k=draw.randint(low, high)))

    def ascii_word() -> str:
        return "".join(draw.choices("etaoinshrdlucmfwypvbgkjqxz", _FALLING[:26], k=draw.randint(2, 8)))

    def email() -> str:
        at, dot = pick([("@", "."), ("@", "."), ("@", "."), (" @ ", "."), ("(@)", "."), (" at ", " dot "), (" at ", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), ("@", "[.]")])
        local = pick([ascii_word(), ascii_word() + pick([".", "_", "-"]) + ascii_word(), digits(draw.randint(2, 6)), ascii_word() + digits(2)])
        return local + at + pick([ascii_word(), "mail" + digits(1) + dot + ascii_word()]) + dot + pick(["com", "org", "net", "de", f"example{dot}com"])

    def ip() -> str:
        return pick([".", ".", ".", ". ", "[.]", " . "]).join(str(draw.randrange(256)) for _ in range(4))

    def card() -> str:
        n = pick([14, 15, 16, 16, 16, 18, 19])
        d = digits(n - 1)
        d += next(x for x in "0123456789" if luhn(d + x))
        gap = pick(["", "", "-", " ", ".", "  "])
        return gap.join(d[k : k + 4] for k in range(0, n, 4)) if gap else d

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{digits(2)}{a}{b}{c}", f"0{digits(2)}/{b}{c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits(2)} {a} {b}{c}"])

    def nothing() -> str:
        return pick([f"{digits(4)}-{digits(2)}-{digits(2)}", f"v{digits(1)}.{digits(1)}.{digits(2)}", f"{digits(2)}:{digits(2)}", f"{digits(2)}:{digits(2)}:{digits(2)}", digits(draw.randint(1, 8)), digits(draw.randint(20, 30)), f"${digits(3)}.{digits(2)}", "@" + ascii_word(), f"{digits(2)}%", f"{digits(1)}.{digits(2)}", "".join(draw.choices("0123456789abcdef", k=pick([8, 24, 40]))), f"{digits(2)}/{digits(2)}/{digits(4)}", f"no. {digits(5)}", f"{word()} at {word()}", f"{word()} at {word()}. {word()}", "at", "dot", f"{digits(1)}, {digits(2)}, {digits(2)}", "AKIA" + "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16)), f'token = "{ascii_word()}{digits(6)}"'])

    makers = (email, ip, card, phone)
    x, tags = np.empty((length, count), np.int64), np.zeros((length, count), np.int64)
    for k in range(count):
        text, marks = "", []
        loud, gaps = draw.random() < 0.1, pick([[" "], [" "], [" ", " ", ". ", ", ", "\n"], [" ", "### ", "$$$ ", "!! ", "%%% ", "&&& ", "*** "], [" | "]])
        while len(text) < 2 * length:
            what = draw.random()
            if what < 0.12:
                kind = draw.randrange(4)
                value = makers[kind]()
                marks.append((len(text), kind, len(text) + len(value)))
                text += value
            else:
                plain = nothing() if what < 0.2 else word().capitalize() if what < 0.3 else word()
                text += plain.upper() if loud else plain
            text += pick(gaps)
        begin = draw.randrange(length)
        inside = np.zeros(len(text), np.int64)
        for s, kind, e in marks:
            inside[s:e] = 1 + kind
        x[:, k], tags[:, k] = codes(text)[begin : begin + length], inside[begin : begin + length]
    return x, tags


@functools.cache
def tagger() -> Tagger:
    """Trained once in a process, always alike."""
    model = Tagger.fresh(N_SYMBOLS, 1 + len(KINDS))
    model.train(*drawn_examples(), STEPS)
    return model


def _fits(kind: int, value: str) -> bool:
    """Whether a value has what its kind needs, hidden spellings written plainly."""
    if kind == 0:
        return _ADDRESS.fullmatch(_DOT.sub(".", _AT.sub("@", value, 1))) is not None
    if kind == 1:
        parts = _DOT.sub(".", value).split(".")
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and len(p) < 4 and int(p) <= 255 for p in parts)
    digits = "".join(_DIGIT.findall(value))
    if kind == 2:
        return 14 <= len(digits) <= 19 and _SPACED.fullmatch(value) is not None and luhn(digits)
    return 9 <= len(digits) <= 15 and len(digits) < len(value) and _NUMBER.fullmatch(value) is not None


def windows(length: int) -> list[tuple[int, int]]:
    """Ranges of a text of this length, each of at most WINDOW characters, overlapping by OVERLAP."""
    return [(s, min(s + WINDOW, length)) for s in range(0, max(1, length - OVERLAP), WINDOW - OVERLAP)] if length else []


def emissions(texts: list[str], model: Tagger) -> tuple[np.ndarray, np.ndarray]:
    """Scores (place, tag) of every character, text after text, and where texts begin (and the end).
    Where two windows overlap, their scores are blended from the one into the other."""
    bounds = np.cumsum([0, *map(len, texts)])
    symbols = codes("".join(texts))
    ranges = [(a + s, a + e, s > 0, a + e < b) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True) for s, e in windows(b - a)]
    ranges.sort(key=lambda r: r[0] - r[1])
    out = np.zeros((len(symbols), 1 + len(KINDS)), np.float32)
    if not ranges:
        return out, bounds
    x = np.zeros((2, len(ranges), ranges[0][1] - ranges[0][0]), np.uint8)
    for k, (a, b, _, _) in enumerate(ranges):
        x[0, k, : b - a] = symbols[a:b]
        x[1, k, : b - a] = symbols[a:b][::-1]
    scored = model.scores(x, np.array([b - a for a, b, _, _ in ranges]))
    rise = ((np.arange(OVERLAP, dtype=np.float32) + 0.5) / OVERLAP)[:, None]
    for k, (a, b, before, after) in enumerate(ranges):
        part = scored[0, k, : b - a]
        part += scored[1, k, : b - a][::-1]
        if before:
            part[:OVERLAP] *= rise[: b - a]
        if after:
            part[-OVERLAP:] *= rise[::-1]
        out[a:b] += part
    out += model.weights["ob"]
    return out, bounds


def tagged_spans(texts: list[str], model: Tagger) -> list[list[tuple[int, int, int]]]:
    """The tagger's spans (start, kind number, end) of each text."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for a, b in chunks(texts, BATCH):
        scores, bounds = emissions(texts[a:b], model)
        tags = viterbi(scores, model.weights["m"], bounds)
        for s, e in _runs(tags, bounds):
            n = int(np.searchsorted(bounds, s, "right")) - 1
            s, e, kind = s - int(bounds[n]), e - int(bounds[n]), int(tags[s]) - 1
            value = texts[a + n][s:e]
            left = len(value) - len(value.lstrip())
            value = value.strip()
            if _fits(kind, value):
                out[a + n].append((s + left, kind, s + left + len(value)))
    return out


def _runs(tags: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of one tag other than 0 inside one text."""
    cut = np.ones(len(tags) + 1, bool)
    cut[1:-1] = tags[1:] != tags[:-1]
    cut[bounds] = True
    cuts = np.flatnonzero(cut)
    some = np.flatnonzero(tags[cuts[:-1]]) if len(tags) else []
    return [(int(cuts[k]), int(cuts[k + 1])) for k in some]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_email, n_ip, n_card, n_phone (base spans), base (kind:start:end,
    comma-joined, by start and kind; code points, end exclusive), spans (all spans likewise), base_sha256.

    A null text counts as empty. Null and repeated ids keep their rows; other columns are ignored,
    whatever their names; an empty table gives no rows. Whole texts are read, however long.
    """
    sent = docs.sparkSession.sparkContext.broadcast(tagger())

    def run(texts: list[str | None]) -> list[pa.Array]:
        texts = ["" if t is None else t for t in texts]
        base = [base_spans(t) for t in texts]
        more = tagged_spans(texts, sent.value)
        every = [sorted(b + [s for s in m if all(s[2] <= x[0] or s[0] >= x[2] for x in b)]) for b, m in zip(base, more, strict=True)]
        counts = [pa.array([sum(s[1] == k for s in b) for b in base], pa.int64()) for k in range(len(KINDS))]
        return [*counts, *(pa.array(map(written, spans), pa.string()) for spans in (base, every))]

    found = append_columns(docs, text_col, [id_col], "n_email long, n_ip long, n_card long, n_phone long, base string, spans string", run)
    return found.withColumn("base_sha256", F.sha2("base", 256))
