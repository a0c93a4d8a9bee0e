"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions for what they miss.

The tagger is trained in numpy from labelled spans: windows of the corpus with the spans that the patterns find there,
and windows into which personal data are written in ways that no pattern knows (spelled-out addresses, numbers with
signs in between, phones without a country), next to numbers that are none (dates, prices, versions, digests). It reads
every place of a text that holds a digit, an @ or a spelled-out one, in overlapping windows. Spans decoded in a window
count where that window sees them best; spans of all windows are then reconciled over the whole text: pattern spans stay,
of overlapping others the surest stays. A span that lacks what its kind cannot do without (an @ and a dot, four numbers,
check digits, ten digits with signs between them) is no span. Spans that the tagger adds have at most LENGTH characters.

Texts are tagged where they lie, in batches; nothing is shuffled. Training takes a bounded sample of windows.

Defined results: a null text is empty and has no spans. Rows are tagged one by one, so null or repeated doc_ids are as
good as others. Without labelled spans no tagger is trained and only the patterns count.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]|[(\[][Aa][Tt][)\]]")
#: Signs that stand for an @ or a dot in a spelled-out address.
SPELLED_AT, SPELLED_DOT = re.compile(r"\s*[(\[](?:at|@)[)\]]\s*|\s+@\s+", re.I), re.compile(r"\s*[(\[](?:dot|\.)[)\]]\s*|\s+\.\s+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> Iterator[Span]:
    """From each @ outwards, so that long runs of letters cost their length once."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        left = at
        while left > done and (text[left - 1].isascii() and (text[left - 1].isalnum() or text[left - 1] in "._%+-")):
            left -= 1
        found = DOMAIN.match(text, at + 1) if left < at else None
        if found:
            done = found.end()
            yield "email", left, done
        at = max(at + 1, done)


def ips(text: str) -> Iterator[Span]:
    for run in DOTTED.finditer(text):
        parts = run[0].split(".")
        at = run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def pattern_spans(text: str) -> list[Span]:
    """The spans of the exact patterns, by start and then kind."""
    if not TRIGGER.search(text):
        return []
    found = [*emails(text), *ips(text)]
    for m in CARD.finditer(text):
        if 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 10 <= len(digits_of(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def plausible(kind: str, text: str) -> bool:
    n = digits_of(text)
    if kind == "email":
        user, at, host = SPELLED_AT.sub("@", text).partition("@")
        return bool(user and at) and "." in SPELLED_DOT.sub(".", host).strip(".")
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and text[:1].isdigit() and text[-1:].isdigit()
    if kind == "card":
        return 14 <= len(n) <= 19 and luhn(n)
    return 10 <= len(n) <= 15 and bool(re.search(r"[()\x20.-]", text)) and not dotted_number(text)


def dotted_number(text: str) -> bool:
    return bool(re.fullmatch(r"[0-9]+(?:\.[0-9]+)+", text))


# ---------------------------------------------------------------- windows

LENGTH, STRIDE, AROUND = 64, 32, 20
CLASSES = 26
PAD = CLASSES - 1


def _class_table() -> np.ndarray:
    table = np.full(128, 20, np.int8)
    for i, chars in enumerate(["0123456789", "abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "@", ".", "-", "+", "(", ")", "_", "%", " ", "\n\r\t", '"\'', "=", "|", ",;:", "/"]):
        for c in chars:
            table[ord(c)] = i
    return table


TABLE = _class_table()


def classes(text: str) -> np.ndarray:
    """A small class for each code point; letters and signs beyond ASCII are two."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, TABLE[np.minimum(points, 127)], np.where(points < 0x2000, 21, 22)).astype(np.int8)


def windows_of(text: str) -> list[int]:
    """Starts of the windows that cover all digits and @ with what is around them; consecutive ones overlap by half."""
    starts, end = [], -1
    for m in TRIGGER.finditer(text):
        p = m.start()
        if p + AROUND <= end or (starts and p < starts[-1] + STRIDE):
            continue
        start = max(0, p - AROUND) if not starts or p - AROUND > starts[-1] + STRIDE else starts[-1] + STRIDE
        starts.append(start)
        end = start + LENGTH
    return starts


def padded(text: str, starts: list[int]) -> np.ndarray:
    got = np.concatenate([classes(text), np.full(LENGTH, PAD, np.int8)])
    return got[np.array(starts)[:, None] + np.arange(LENGTH)]


TAGS = 1 + 2 * len(KINDS)  # 0: outside; 1 + 2k begins kind k, 2 + 2k goes on


def tags_of(spans: list[Span], start: int) -> np.ndarray:
    out = np.zeros(LENGTH, np.int64)
    for kind, a, b in spans:
        k = KINDS.index(kind)
        lo, hi = max(a - start, 0), min(b - start, LENGTH)
        if lo < hi:
            out[lo:hi] = 2 + 2 * k
            if a >= start:
                out[lo] = 1 + 2 * k
    return out


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of a window's tags."""
    out, open_ = [], None
    for i, t in enumerate([*tags.tolist(), 0]):
        if open_ and (t == 0 or t % 2 == 1 or (t - 1) // 2 != open_[0]):
            out.append((open_[0], open_[1], i))
            open_ = None
        if t and open_ is None:
            open_ = ((t - 1) // 2, i)
    return out


# ---------------------------------------------------------------- the network

FORBIDDEN = -1e4


def allowed() -> np.ndarray:
    """0 where a tag may follow another, else a large negative number: a span goes on only within its kind."""
    out = np.zeros((TAGS, TAGS))
    for t in range(2, TAGS, 2):
        out[[s for s in range(TAGS) if s not in (t, t - 1)], t] = FORBIDDEN
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


class Tagger:
    """One LSTM in each direction over character classes, a linear layer, CRF transitions."""

    def __init__(self, hidden: int = 16, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in "fb":
            self.p[f"w{d}"] = rng.normal(0, 0.3, (CLASSES, 4 * hidden))
            self.p[f"u{d}"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            bias = np.zeros(4 * hidden)
            bias[hidden : 2 * hidden] = 1.0
            self.p[f"c{d}"] = bias
        self.p |= {"o": rng.normal(0, 1 / np.sqrt(2 * hidden), (2 * hidden, TAGS)), "ob": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS))}

    def lstm(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States of both directions, (length, windows, 2 * hidden); keep gets what the way back needs.

        The backward direction reads the windows from their end, so both take each step together.
        """
        hid, length, n = self.hidden, x.shape[1], len(x)
        gates = np.stack([self.p[f"w{d}"] + self.p[f"c{d}"] for d in "fb"])
        own = np.stack([self.p[f"u{d}"] for d in "fb"])
        h, c = np.zeros((2, n, hid), gates.dtype), np.zeros((2, n, hid), gates.dtype)
        out = np.empty((length, n, 2 * hid), gates.dtype)
        for s in range(length):
            z = np.stack([gates[0][x[:, s]], gates[1][x[:, length - 1 - s]]]) + h @ own
            ifo, g = sigmoid(z[:, :, : 3 * hid]), np.tanh(z[:, :, 3 * hid :])
            i, f, o = ifo[:, :, :hid], ifo[:, :, hid : 2 * hid], ifo[:, :, 2 * hid :]
            before = h, c
            c = f * c + i * g
            t = np.tanh(c)
            h = o * t
            if keep is not None:
                keep.append((*before, i, f, o, g, t))
            out[s, :, :hid], out[length - 1 - s, :, hid:] = h[0], h[1]
        return out

    def lstm_back(self, x: np.ndarray, kept: list, dout: np.ndarray, grad: dict) -> None:
        hid, length, n = self.hidden, x.shape[1], len(x)
        own = np.stack([self.p[f"u{d}"] for d in "fb"]).transpose(0, 2, 1)
        dh = dc = np.zeros((2, n, hid), dout.dtype)
        every = np.empty((length, 2, n, 4 * hid), dout.dtype)
        for s in range(length - 1, -1, -1):
            _, c0, i, f, o, g, t = kept[s]
            dh = dh + np.stack([dout[s, :, :hid], dout[length - 1 - s, :, hid:]])
            dc = dc + dh * o * (1 - t * t)
            dz = every[s]
            dz[:, :, :hid], dz[:, :, hid : 2 * hid] = dc * g * i * (1 - i), dc * c0 * f * (1 - f)
            dz[:, :, 2 * hid : 3 * hid], dz[:, :, 3 * hid :] = dh * t * o * (1 - o), dc * i * (1 - g * g)
            dh, dc = dz @ own, dc * f
        h0 = np.stack([k[0] for k in kept])
        for k, d in enumerate("fb"):
            dz = every[:, k].reshape(length * n, -1)
            read = (x if d == "f" else x[:, ::-1]).T.ravel()
            seen = np.zeros((CLASSES, length * n), dz.dtype)
            seen[read, np.arange(length * n)] = 1
            grad[f"w{d}"], grad[f"u{d}"], grad[f"c{d}"] = seen @ dz, h0[:, k].reshape(length * n, hid).T @ dz, dz.sum(0)

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(length, windows, tags)"""
        return self.lstm(x) @ self.p["o"] + self.p["ob"]

    def step(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tags, and its gradient."""
        p, n, length = self.p, len(x), x.shape[1]
        kept: list = []
        h = self.lstm(x, kept)
        e = h @ p["o"] + p["ob"]
        t = (p["t"] + allowed()).astype(e.dtype)
        alpha, beta = forward_backward(e, t)
        z = log_sum(alpha[-1], 1)
        at, rows = np.arange(length)[:, None], np.arange(n)
        gold = e[at, rows, y.T].sum(0) + t[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(alpha + beta - z[:, None])
        de[at, rows, y.T] -= 1
        pair = np.exp(alpha[:-1][:, :, :, None] + t + (e[1:] + beta[1:])[:, :, None, :] - z[:, None, None]).sum((0, 1))
        np.subtract.at(pair, (y[:, :-1], y[:, 1:]), 1)
        de, grad = de / n, {k: np.zeros_like(v) for k, v in p.items()}
        grad["t"] = np.where(allowed() < 0, 0, pair / n)
        grad["o"], grad["ob"] = np.einsum("lnh,lnt->ht", h, de), de.sum((0, 1))
        self.lstm_back(x, kept, de @ p["o"].T, grad)
        return float((z - gold).mean()), grad

    def train(self, x: np.ndarray, y: np.ndarray, steps: int = 500, batch: int = 32, rate: float = 0.02, seed: int = 5) -> float:
        """Adam over shuffled batches in single precision, as many steps for few examples as for many, at a falling rate; the mean loss of the last tenth."""
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        rng, m, v, order, losses = np.random.default_rng(seed), {}, {}, np.empty(0, np.int64), []
        for k in range(1, steps + 1):
            if len(order) < batch:
                order = np.concatenate([order, rng.permutation(len(x))])
            at, order = order[:batch], order[batch:]
            value, grad = self.step(x[at], y[at])
            losses.append(value)
            for name, g in grad.items():
                g = np.clip(g, -1, 1)
                m[name] = 0.9 * m.get(name, 0) + 0.1 * g
                v[name] = 0.999 * v.get(name, 0) + 0.001 * g * g
                self.p[name] -= rate * (1 - 0.95 * k / steps) * (m[name] / (1 - 0.9**k)) / (np.sqrt(v[name] / (1 - 0.999**k)) + 1e-8)
        return float(np.mean(losses[-max(1, steps // 10) :]))

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Viterbi tags of windows, and the posterior probability of each tag (1 in windows without a span)."""
        e = self.emissions(x).astype(np.float32)
        t = (self.p["t"] + allowed()).astype(np.float32)
        length, n, _ = e.shape
        score, back = e[0], np.empty((length, n, TAGS), np.int8)
        for s in range(1, length):
            paths = score[:, :, None] + t
            back[s] = paths.argmax(1)
            score = paths.max(1) + e[s]
        tags = np.empty((n, length), np.int64)
        tags[:, -1] = score.argmax(1)
        for s in range(length - 1, 0, -1):
            tags[:, s - 1] = back[s][np.arange(n), tags[:, s]]
        belief, some = np.ones((n, length), np.float32), np.flatnonzero(tags.any(1))
        if len(some):
            alpha, beta = forward_backward(e[:, some], t)
            sure = np.exp(alpha + beta - log_sum(alpha[-1], 1)[:, None]).transpose(1, 0, 2)
            belief[some] = np.take_along_axis(sure, tags[some][:, :, None], 2)[:, :, 0]
        return tags, belief


def forward_backward(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log sums over all tag paths up to and after each place."""
    alpha, beta = np.empty_like(e), np.zeros_like(e)
    alpha[0] = e[0]
    for s in range(1, len(e)):
        alpha[s] = log_sum(alpha[s - 1][:, :, None] + t, 1) + e[s]
    for s in range(len(e) - 2, -1, -1):
        beta[s] = log_sum(t + (e[s + 1] + beta[s + 1])[:, None, :], 2)
    return alpha, beta


def single(tagger: Tagger) -> Tagger:
    """The tagger in single precision, for decoding."""
    out = Tagger(tagger.hidden)
    out.p = {k: v.astype(np.float32) for k, v in tagger.p.items()}
    return out


def tagged(texts: list[str], tagger: Tagger | None, sure: float = 0.8) -> tuple[list[list[Span]], list[list[Span]]]:
    """The patterns' spans of each text, and all spans."""
    base = [pattern_spans(t) for t in texts]
    both = list(base)
    if tagger is None:
        return base, both
    starts = [windows_of(t) for t in texts]
    where = [(i, s) for i, own in enumerate(starts) for s in own]
    found: dict[int, list[tuple[float, Span]]] = {}
    made = [padded(texts[i], own) for i, own in enumerate(starts) if own]
    x = np.concatenate(made) if made else np.empty((0, LENGTH), np.int8)
    for k in range(0, len(x), 2048):
        tags, belief = tagger.decode(x[k : k + 2048])
        for row in np.flatnonzero(tags.any(1)):
            i, start = where[k + row]
            for kind, a, b in spans_of(tags[row]):
                cut = (a == 0 and start > 0) or (b == LENGTH and start + LENGTH < len(texts[i]))
                p = float(belief[row, a:b].mean())
                span = (KINDS[kind], start + a, min(start + b, len(texts[i])))
                if not cut and p >= sure and plausible(span[0], texts[i][span[1] : span[2]]):
                    found.setdefault(i, []).append((p, span))
    for i, more in found.items():
        taken = list(base[i])
        for _, span in sorted(more, key=lambda x: (-x[0], x[1][1], x[1][2])):
            if all(span[2] <= a or b <= span[1] for _, a, b in taken):
                taken.append(span)
        both[i] = in_order(taken)
    return base, both


# ---------------------------------------------------------------- Spark

EXAMPLES = 2000
SOURCE_DOCS = 20_000
#: Windows with planted spans that the tagger learns from, whatever the table holds.
PLANTED = 2000


def written_as(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def read_from(spans: str) -> list[Span]:
    return [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in spans.split(",") if x)]


def labelled_windows(docs: DataFrame, limit: int = EXAMPLES, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, list[Span]]]:
    """Windows with the spans that the patterns label, from about SOURCE_DOCS documents; at most limit, half of them with a span."""
    total = max(1, docs.count())
    key = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000))
    some = docs.where((key < int(1e6 * min(1.0, SOURCE_DOCS / total)) + 1) & F.col(text_col).rlike("[0-9@]"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for t in f["t"]:
                spans = pattern_spans(t)
                for s in windows_of(t):
                    own = [(k, a - s, b - s) for k, a, b in spans if s <= a and b <= s + LENGTH]
                    rows.append((t[s : s + LENGTH], written_as(own), bool(own)))
            yield pd.DataFrame(rows, columns=["w", "spans", "some"])

    made = some.select(F.col(text_col).alias("t")).mapInPandas(cut, "w string, spans string, some boolean").distinct()
    order = F.xxhash64("w", "spans")
    halves = [made.where(F.col("some") == yes).orderBy(order, "w").limit(limit // 2).collect() for yes in (True, False)]
    return [(r.w, read_from(r.spans)) for half in halves for r in half]


def with_check_digit(digits: str) -> str:
    return next(digits + d for d in "0123456789" if luhn(digits + d))


def unusual(kind: str, rng: np.random.Generator) -> str:
    """Personal data of a kind, written as no pattern has it."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    word = lambda lo, hi: "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in rng.integers(0, 26, rng.integers(lo, hi)))
    if kind == "email":
        user, host, end = word(3, 9) + pick("", "", f".{word(2, 7)}", f"_{number(2)}", number(2)), word(3, 10) + pick("", f"-{word(2, 5)}", number(1)), pick("com", "org", "net", "de", "fr", "es", "edu")
        at, dot = pick((" (at) ", " (dot) "), (" [at] ", " [dot] "), ("(at)", "(dot)"), ("[at]", "."), (" (at) ", "."), (" @ ", "."), (" @ ", " . "), (" (AT) ", " (DOT) "), ("[@]", "[.]"))
        return f"{user}{at}{host}{dot}{end}"
    if kind == "ip":
        return pick("[.]", " . ", "(.)", "[dot]", " (dot) ").join(str(rng.integers(0, 256)) for _ in range(4))
    if kind == "card":
        n = with_check_digit(pick("4", "5", "37") + number(14))[:16]
        n = with_check_digit(n[:15])
        return pick(".", "_", "  ", " - ", "/").join(n[k : k + 4] for k in range(0, 16, 4))
    a, b, c = number(3), number(3), number(4)
    return pick(f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"001 {a} {b} {c}", f"00 1 {a} {b} {c}", f"({a}){b}-{c}", f"1-{a}-{b}-{c}")


def harmless(rng: np.random.Generator) -> str:
    """A number or a name with a sign in it that is no personal data."""
    pick = lambda *x: x[int(rng.integers(len(x)))]
    number = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    return pick(
        f"20{number(2)}-0{number(1)}-1{number(1)}", f"1{number(1)}:{number(2)}:{number(2)}", f"${number(1)},{number(3)}.{number(2)}", f"v{number(1)}.{number(1)}.{number(2)}", number(16),
        rng.bytes(10).hex(), f"978-{number(1)}-{number(2)}-{number(6)}-{number(1)}", f"{number(2)}.{number(1)}.20{number(2)}", f"#{number(6)}", f"@{pick('home', 'work', 'night')}",
        f"{number(3)} {number(3)} {number(3)}", f"{number(2)} (at least)", f"{number(4)}-{number(4)}", f"[{number(1)}] [{number(2)}]", f"{number(1)}.{number(2)} . {number(1)}",
    )


def planted(windows: list[str], n: int, rng: np.random.Generator) -> list[tuple[str, list[Span]]]:
    """n windows of words from the given ones with personal data in between that no pattern finds, or with a harmless number."""
    kinds, out = [*KINDS, "email", None], []  # spelled-out addresses have the most forms
    words = [w for x in windows for w in x.split() if not TRIGGER.search(w)] or ["the"]
    some = lambda k: " ".join(words[i] for i in rng.integers(0, len(words), k))
    for i in range(n):
        kind = kinds[i % len(kinds)]
        own = unusual(kind, rng) if kind else harmless(rng)
        left = some(int(rng.integers(0, 6)))
        left = left[-max(0, LENGTH - len(own) - 6) :] + ("" if not left else " ") if len(own) < LENGTH - 6 else ""
        end = rng.choice(["", ".", ",", "!", ")", "."])
        text = f"{left}{own}{end} {some(12)}"[:LENGTH]
        out.append((text, [(kind, len(left), len(left) + len(own))] if kind else []))
    return out


def train_tagger(examples: list[tuple[str, list[Span]]], steps: int = 1000) -> Tagger | None:
    """A tagger from windows with their spans, and PLANTED ones with planted spans, as many for a small table as for a large one."""
    if not any(spans for _, spans in examples):
        return None
    made = examples + planted([w for w, _ in examples], PLANTED, np.random.default_rng(11))
    x = np.concatenate([padded(w[:LENGTH], [0]) for w, _ in made])
    y = np.stack([tags_of([s for s in spans if s[2] <= LENGTH], 0) for _, spans in made])
    tagger = Tagger()
    tagger.train(x, y, steps)
    return single(tagger)


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Tagger | None:
    """A tagger for the documents. It is trained in a task, which has a thread of its own; the examples and the weights are bounded, whatever the table holds."""
    examples = labelled_windows(docs, EXAMPLES, id_col, text_col)

    def train(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            tagger = train_tagger(examples)
            yield pd.DataFrame({"id": f["id"], "tagger": [pickle.dumps(tagger.p) if tagger else None] * len(f)})

    made = docs.sparkSession.range(0, 1, 1, 1).mapInPandas(train, "id long, tagger binary").first().tagger
    if made is None:
        return None
    tagger = Tagger()
    tagger.p = pickle.loads(bytes(made))
    return tagger


def find(docs: DataFrame, tagger: Tagger | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (of the patterns), base and spans as kind:start:end, comma-joined."""
    names = [f"n_{k}" for k in KINDS]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k in range(0, len(f), 1024):
                part = f.iloc[k : k + 1024]
                texts = [t or "" for t in part["t"]]
                base, both = tagged(texts, tagger)
                out = {"doc_id": part["doc_id"].astype("Int64").array}
                out |= {n: [sum(s[0] == kind for s in b) for b in base] for n, kind in zip(names, KINDS, strict=True)}
                yield pd.DataFrame(out | {"base": [written_as(b) for b in base], "spans": [written_as(b) for b in both]})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return slim.mapInPandas(run, "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base string, spans string")
