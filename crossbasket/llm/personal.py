"""Personal data: fixed patterns, and a bidirectional LSTM with CRF transitions over characters.

The base patterns find e-mail addresses, IP addresses, card and phone numbers. The network reads
characters (folded to ``SYMBOLS`` symbols) and scores a begin, an inside and an outside tag of each kind; it is
trained in numpy on windows around what the patterns' shapes label, as they are and with the labelled
spans in other spellings, and on windows without labels, by the likelihood of a conditional random field. Texts are read in windows of ``WINDOW`` characters, each
half over the next. Where windows overlap their scores are averaged, an end of a window counting less
than its middle, and each run of overlapping windows is then decoded as one sequence, so a span
across windows is found once and whole. Regions in which no span can be as clear as is asked for, by a bound
on what any path gains, are not decoded.

A decoded span counts if its plain spelling (``plain``: digits and signs of other scripts as ASCII, words
and brackets that stand for "@" and "." as these) passes its kind's check (an address around an at sign,
parts up to 255, Luhn, number of digits), if it beats the outside path by ``CLEAR``, and overlaps no base
span. Windows without a digit of any script, an at sign or a word for one can hold no such span and are
not read. Addresses whose at sign is a word in brackets, or goes with a word for a dot, count without the
network, which reads letters by class.

The labelled windows come from about ``FIT_ROWS`` rows taken by a hash, ``FIT_WINDOWS`` of them at most
by the same means; they are trained on by the driver, which broadcasts the weights. Texts are
scanned where they lie; nothing else is shuffled.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crossbasket.llm import wordhash
from crossbasket.llm.batches import arrow_schema, map_batches, pieces, texts

KINDS = ("email", "ip", "card", "phone")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the first part's possessive runs and look-behind give the same matches in linear time
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

FIT_ROWS = 40_000
FIT_WINDOWS = 2_500
WINDOW = 96
STRIDE = WINDOW // 2
EMBEDDED = 8
HIDDEN = 16
EPOCHS = 8
BATCH = 64
CLEAR = 3.0  # nats
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
SYMBOLS = 43
_PIECE = 1 << 20
_AT_ONCE = 4096  # windows

Span = tuple[int, int, int]  # kind, start, end


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: int, text: str) -> bool:
    """Whether a match of the kind's shape counts."""
    if kind == 0:
        return "@" in text
    if kind == 1:
        parts = text.split(".")
        return len(parts) == 4 and all(p.isdigit() and p.isascii() and int(p) <= 255 for p in parts)
    digits = _digits(text)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 9 <= len(digits) <= 15


# fixed values: words that stand for "@" and "." in spelled addresses
_AT_WORD = r"(?:at|ät|arroba|arobase)"
_DOT_WORD = r"(?:dot|punkt|punto|point)"
_SPELLED = re.compile(
    rf"(?<![^\W_])(?:(?P<at>{_AT_WORD})|{_DOT_WORD})(?![^\W_])|(?<=[(\[{{<])(?P<letter>[aä])(?=[)\]}}>])", re.IGNORECASE
)
_PLAIN_AT = re.compile(
    rf"\s*[(\[{{<]\s*(?:{_AT_WORD}|[aä]|@)\s*[)\]}}>]\s*|\s+{_AT_WORD}\s+|\s*@\s*", re.IGNORECASE
)
_PLAIN_DOT = re.compile(rf"\s*[(\[{{<]\s*(?:{_DOT_WORD}|\.)\s*[)\]}}>]\s*|\s+{_DOT_WORD}\s+", re.IGNORECASE)
_SPELLED_TAIL = re.compile(
    rf"(?P<at>{_PLAIN_AT.pattern})[A-Za-z0-9-]+(?:(?:\.|{_PLAIN_DOT.pattern})[A-Za-z0-9-]+)+", re.IGNORECASE
)
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")


def plain(value: str) -> str:
    """A span in the spelling that the checks know."""
    value = unicodedata.normalize("NFKC", value)
    if not value.isascii():
        value = "".join(str(d) if (d := unicodedata.decimal(c, -1)) >= 0 else c for c in value)
    return _PLAIN_DOT.sub(".", _PLAIN_AT.sub("@", value))


def acceptable(kind: int, value: str) -> bool:
    """Whether a span of the network counts."""
    spelled = plain(value)
    return valid(kind, spelled) and (kind > 0 or "@" in value or _ADDRESS.fullmatch(spelled) is not None)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    upto, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        domain = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            upto = domain.end()
        else:
            upto = at + 1
        at = text.find("@", upto)


def spelled_addresses(text: str) -> list[Span]:
    """Addresses with a word for the at sign that stands in brackets or goes with a word for a dot."""
    found: list[Span] = []
    for m in _SPELLED.finditer(text):
        if not m["at"]:
            continue
        end = m.start()
        while end > max(0, m.start() - 4) and (text[end - 1].isspace() or text[end - 1] in "([{<"):
            end -= 1
        start, upto = end, found[-1][2] if found else 0
        while start > upto and text[start - 1] in _LOCAL:
            start -= 1
        tail = _SPELLED_TAIL.match(text, end) if start < end else None
        if tail and (any(c in "([{<" for c in tail["at"]) or _PLAIN_DOT.search(tail[0], len(tail["at"]))):
            found.append((0, start, tail.end()))
    return found


def shapes(text: str) -> list[Span]:
    """All matches of the patterns, by kind and start, whether or not they count."""
    found = [(0, s, e) for s, e in _emails(text)]
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text)]
    return found


def base_spans(text: str) -> list[Span]:
    return [(k, s, e) for k, s, e in shapes(text) if valid(k, text[s:e])]


# --- the network -----------------------------------------------------------------------------------


def _symbol_table() -> np.ndarray:
    """0 pads, 1-32 ASCII marks, 33 digit of any script, 34 small and 35 large letter, 36 space, 37 line end,
    38 other control, 39 other letters, 40 anything else; full-width signs and letters as their ASCII ones.
    Words for "@" are 41 and words for "." are 42 (``symbols``)."""
    table = np.full(0x110000, 40, np.int8)
    table[: 0x80] = 38
    table[[i for i in range(0x80, 0x3000) if chr(i).isalpha()]] = 39
    table[[i for i in range(0x21, 0x7F) if not chr(i).isalnum()]] = np.arange(1, 33)
    table[0x30:0x3A], table[0x61:0x7B], table[0x41:0x5B] = 33, 34, 35
    table[[0x20, 0x09, 0xA0, 0x3000]], table[[0x0A, 0x0D]] = 36, 37
    table[0xFF01:0xFF5F] = table[0x21:0x7F]
    table[[i for i in range(0x80, 0x110000) if unicodedata.category(chr(i)) == "Nd"]] = 33
    return table


_SYMBOL = _symbol_table()
_TRIGGERS = np.zeros(SYMBOLS, bool)
_TRIGGERS[[33, 41, 1 + [i for i in range(0x21, 0x7F) if not chr(i).isalnum()].index(0x40)]] = True


def symbols(text: str) -> np.ndarray:
    codes = _SYMBOL[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
    for m in _SPELLED.finditer(text):
        codes[m.start() : m.end()] = 41 if m["at"] or m["letter"] else 42
    return codes


class Network(NamedTuple):
    embedding: np.ndarray  # symbols x EMBEDDED
    forward: np.ndarray  # input, hidden and bias rows x four gates
    backward: np.ndarray
    output: np.ndarray  # both hidden states and bias rows x tags
    transitions: np.ndarray  # from tag x to tag


def _allowed() -> np.ndarray:
    """Penalty of transitions: an inside tag follows the begin or inside tag of its kind alone."""
    table = np.zeros((TAGS, TAGS), np.float32)
    for kind in range(len(KINDS)):
        inside = 2 * kind + 2
        table[:, inside] = -1e4
        table[[inside - 1, inside], inside] = 0
    return table


_ALLOWED = _allowed()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _lstm(inputs: np.ndarray, weights: np.ndarray, keep: bool = False):
    """Hidden states for ``inputs`` (time x rows x width); with ``keep``, also what learning needs."""
    steps, rows, width = inputs.shape
    hidden = weights.shape[1] // 4
    h, c = np.zeros((rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
    projected = inputs.reshape(-1, width) @ weights[:width] + weights[-1]
    projected = projected.reshape(steps, rows, -1)
    out = np.empty((steps, rows, hidden), np.float32)
    memory = []
    for t in range(steps):
        gates = projected[t] + h @ weights[width:-1]
        ifo = _sigmoid(gates[:, : 3 * hidden])
        g = np.tanh(gates[:, 3 * hidden :])
        i, f, o = ifo[:, :hidden], ifo[:, hidden : 2 * hidden], ifo[:, 2 * hidden :]
        before = c
        c = f * before + i * g
        squashed = np.tanh(c)
        if keep:
            memory.append((h, before, i, f, o, g, squashed))
        h = o * squashed
        out[t] = h
    return (out, memory) if keep else out


def _lstm_back(inputs: np.ndarray, weights: np.ndarray, memory: list, d_out: np.ndarray):
    steps, rows, width = inputs.shape
    hidden = weights.shape[1] // 4
    d_weights, d_inputs = np.zeros_like(weights), np.empty_like(inputs)
    dh, dc = np.zeros((rows, hidden), np.float32), np.zeros((rows, hidden), np.float32)
    for t in reversed(range(steps)):
        before_h, before_c, i, f, o, g, squashed = memory[t]
        dh = dh + d_out[t]
        dc = dc + dh * o * (1 - squashed**2)
        d_gates = np.concatenate(
            [dc * g * i * (1 - i), dc * before_c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], 1
        )
        d_weights[:width] += inputs[t].T @ d_gates
        d_weights[width:-1] += before_h.T @ d_gates
        d_weights[-1] += d_gates.sum(0)
        d_inputs[t] = d_gates @ weights[:width].T
        dh, dc = d_gates @ weights[width:-1].T, dc * f
    return d_weights, d_inputs


def _scores(net: Network, codes: np.ndarray) -> np.ndarray:
    """Tag scores of windows (rows x time), as rows x time x tags."""
    inputs = net.embedding[codes.T]
    both = np.concatenate([_lstm(inputs, net.forward), _lstm(inputs[::-1], net.backward)[::-1]], 2)
    return (both @ net.output[:-1] + net.output[-1]).transpose(1, 0, 2)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _crf_gradient(scores: np.ndarray, tags: np.ndarray, transitions: np.ndarray):
    """Loss and its gradients to the scores (time x rows x tags) and the transitions."""
    steps, rows, _ = scores.shape
    moves = transitions + _ALLOWED
    alpha, beta = np.empty_like(scores), np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = scores[t] + _log_sum(alpha[t - 1][:, :, None] + moves, 1)
    for t in range(steps - 2, -1, -1):
        beta[t] = _log_sum(moves + (scores[t + 1] + beta[t + 1])[:, None, :], 2)
    total = _log_sum(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - total[None, :, None])
    pairs = np.zeros_like(transitions)
    for t in range(1, steps):
        joint = alpha[t - 1][:, :, None] + moves + (scores[t] + beta[t] - total[:, None])[:, None, :]
        pairs += np.exp(joint).sum(0)
    at = np.arange(rows)
    gold = scores[np.arange(steps)[:, None], at, tags].sum(0) + moves[tags[:-1], tags[1:]].sum(0)
    np.add.at(d_scores, (np.arange(steps)[:, None], at[None, :], tags), -1)
    np.subtract.at(pairs, (tags[:-1], tags[1:]), 1)
    return float((total - gold).sum()), d_scores, pairs


def train(codes: np.ndarray, tags: np.ndarray, epochs: int = EPOCHS, seed: int = 1) -> Network:
    """A network for windows ``codes`` (rows x time) labelled with ``tags``, by Adam on the CRF likelihood."""
    rng = np.random.default_rng(seed)

    def drawn(*shape: int, scale: float) -> np.ndarray:
        return rng.normal(0, scale, shape).astype(np.float32)

    recurrent = (EMBEDDED + HIDDEN + 1, 4 * HIDDEN)
    weights = [
        drawn(SYMBOLS, EMBEDDED, scale=0.5), drawn(*recurrent, scale=0.2), drawn(*recurrent, scale=0.2),
        drawn(2 * HIDDEN + 1, TAGS, scale=0.2), np.zeros((TAGS, TAGS), np.float32),
    ]
    for w in weights[1:3]:
        w[-1, HIDDEN : 2 * HIDDEN] = 1  # remember at first
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    step, total = 0, epochs * max(1, -(-len(codes) // BATCH))
    for _ in range(epochs):
        order = rng.permutation(len(codes))
        for i in range(0, len(order), BATCH):
            own, gold = codes[order[i : i + BATCH]].T, tags[order[i : i + BATCH]].T
            embedding, ahead, back, output, transitions = weights
            inputs = embedding[own]
            h1, m1 = _lstm(inputs, ahead, True)
            h2, m2 = _lstm(inputs[::-1], back, True)
            both = np.concatenate([h1, h2[::-1]], 2)
            _, d_scores, d_moves = _crf_gradient(both @ output[:-1] + output[-1], gold, transitions)
            scale = np.float32(1 / own.shape[1])
            d_scores, d_moves = d_scores.astype(np.float32) * scale, d_moves.astype(np.float32) * scale
            flat = d_scores.reshape(-1, TAGS)
            d_output = np.vstack([both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)])
            d_both = d_scores @ output[:-1].T
            d_ahead, d_in1 = _lstm_back(inputs, ahead, m1, d_both[..., :HIDDEN])
            d_back, d_in2 = _lstm_back(inputs[::-1], back, m2, d_both[::-1][..., HIDDEN:])
            d_embedding = np.zeros_like(embedding)
            np.add.at(d_embedding, own.reshape(-1), (d_in1 + d_in2[::-1]).reshape(-1, EMBEDDED))
            step += 1
            rate = 0.01 * (1 - step / (total + 1))
            for k, g in enumerate((d_embedding, d_ahead, d_back, d_output, d_moves)):
                g = np.clip(g, -1, 1)
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                weights[k] = weights[k] - np.float32(rate) * (first[k] / (1 - 0.9**step)) / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
    return Network(*(w.astype(np.float32) for w in weights))


def decode(scores: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """The best tag sequence (Viterbi) of one region's scores."""
    moves = transitions + _ALLOWED
    best = scores[0] + _ALLOWED[0]  # a region starts like what follows an outside tag
    came = np.empty(scores.shape, np.int8)
    for t in range(1, len(scores)):
        paths = best[:, None] + moves
        came[t] = paths.argmax(0)
        best = paths.max(0) + scores[t]
    tags = np.empty(len(scores), np.int64)
    tags[-1] = best.argmax()
    for t in range(len(scores) - 1, 0, -1):
        tags[t - 1] = came[t, tags[t]]
    return tags


# --- windows ---------------------------------------------------------------------------------------

_NEARNESS = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)


def _windows(codes: np.ndarray) -> np.ndarray:
    """Numbers of the windows to read: those with a digit, an at sign or a word for one. Window i starts at
    (i - 1) * STRIDE, so every character stands in two."""
    at = np.flatnonzero(_TRIGGERS[codes]) // STRIDE
    return np.unique(np.concatenate([at, at + 1]))


def _regions(numbers: np.ndarray) -> list[np.ndarray]:
    return np.split(numbers, np.flatnonzero(np.diff(numbers) > 1) + 1) if len(numbers) else []


def model_spans(net: Network, batch: list[tuple[str, list[Span]]]) -> list[list[Span]]:
    """For each text with its base spans, the further spans of the network."""
    coded = [symbols(text) for text, _ in batch]
    chosen = [_windows(codes) for codes in coded]
    rows = []
    for codes, numbers in zip(coded, chosen):
        padded = np.concatenate([np.zeros(STRIDE, np.int8), codes, np.zeros(WINDOW, np.int8)])
        rows.append(padded[numbers[:, None] * STRIDE + np.arange(WINDOW)])
    joined_rows = np.concatenate(rows) if rows else np.empty((0, WINDOW), np.int8)
    blocks = [_scores(net, joined_rows[i : i + _AT_ONCE]) for i in range(0, len(joined_rows), _AT_ONCE)]
    scores = np.concatenate(blocks) if blocks else np.empty((0, WINDOW, TAGS))
    out, done = [], 0
    for (text, base), numbers in zip(batch, chosen):
        found: list[Span] = []
        covered = _Covered(base)
        for region in _regions(numbers):
            own = scores[done : done + len(region)]
            done += len(region)
            found += _region_spans(net, text, covered, (int(region[0]) - 1) * STRIDE, own)
        out.append(found)
    return out


def _lead(scores: np.ndarray, transitions: np.ndarray, tags: np.ndarray, begin: int, end: int) -> float:
    """By how much the decoded path from ``begin`` to ``end`` beats the one outside any span."""

    def path(own: np.ndarray) -> float:
        around = np.concatenate([tags[begin - 1 : begin], own, tags[end : end + 1]])
        return scores[np.arange(begin, end), own].sum() + transitions[around[:-1], around[1:]].sum()

    return float(path(tags[begin:end]) - path(np.zeros(end - begin, np.int64)))


class _Covered:
    """What some spans cover, as stretches that are apart, so that one look finds an overlap."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, start, end in sorted(spans, key=lambda s: s[1]):
            if self.ends and start <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], end)
            else:
                self.starts.append(start)
                self.ends.append(end)

    def within(self, start: int, end: int) -> range:
        """The numbers of the stretches that meet a span."""
        return range(bisect_right(self.ends, start), bisect_left(self.starts, end))

    def meets(self, span: Span) -> bool:
        return len(self.within(span[1], span[2])) > 0


def _clearest(net: Network, scores: np.ndarray, base: _Covered, origin: int) -> float:
    """The most by which a path through a span of one kind, which overlaps none of ``base``, can beat the outside path:
    exact within the span, and with the best neighbours at its ends."""
    t = net.transitions.astype(np.float64)
    outside = scores[:, 0].astype(np.float64)
    free = np.ones(len(scores), bool)
    for i in base.within(origin, origin + len(scores)):
        free[max(0, base.starts[i] - origin) : max(0, base.ends[i] - origin)] = False
    best = -np.inf
    for kind in range(len(KINDS)):
        begin, inside = 2 * kind + 1, 2 * kind + 2
        enter = max(0.0, float((t[:, begin] - t[:, 0]).max()))
        leave = [max(0.0, float((t[tag] - t[0])[_ALLOWED[0] == 0].max())) for tag in (begin, inside)]
        first = np.where(free, scores[:, begin] - outside, -1e9) + enter
        more = np.where(free, scores[:, inside] - outside, -1e9) + t[inside, inside] - t[0, 0]
        sums = np.cumsum(more)
        best = max(best, float(first.max()) + leave[0])
        if len(sums) > 1:
            ahead = np.maximum.accumulate(first - sums)[:-1]
            longest = float((sums[1:] + ahead).max()) + t[begin, inside] - t[inside, inside]
            best = max(best, longest + leave[1])
    return best


def _region_spans(net: Network, text: str, base: _Covered, origin: int, scores: np.ndarray) -> list[Span]:
    size = (len(scores) + 1) * STRIDE
    merged, weight = np.zeros((size, TAGS), np.float32), np.zeros((size, 1), np.float32)
    for i, window in enumerate(scores):
        merged[i * STRIDE : i * STRIDE + WINDOW] += window * _NEARNESS[:, None]
        weight[i * STRIDE : i * STRIDE + WINDOW] += _NEARNESS[:, None]
    merged /= weight
    low, high = max(0, -origin), min(size, len(text) - origin)
    merged = merged[low:high]
    # with a little more for what is added up in another order
    if _clearest(net, merged, base, origin + low) < CLEAR - 0.01:
        return []  # what would be decoded does not count
    tags = decode(merged, net.transitions)
    if not tags.any():
        return []
    begins = np.flatnonzero(tags % 2 == 1)
    found = []
    for b in begins.tolist():
        inside = tags[b] + 1
        e = b + 1
        while e < len(tags) and tags[e] == inside:
            e += 1
        kind, start, end = int(tags[b] - 1) // 2, origin + low + b, origin + low + e
        value = text[start:end]
        if _lead(merged, net.transitions, tags, b, e) >= CLEAR and acceptable(kind, value) and not base.meets((kind, start, end)):
            found.append((kind, start, end))
    return found


# --- operators -------------------------------------------------------------------------------------


def _flagged(column: pa.Array) -> np.ndarray:
    """Indices of the texts with a digit or an at sign, which the patterns need."""
    data, offsets = wordhash.text_bytes(column)
    at = np.flatnonzero(((data >= 0x30) & (data <= 0x39)) | (data == 0x40))
    return np.unique(np.searchsorted(offsets[1:], at, side="right"))


def labelled_windows(text: str) -> list[tuple[str, list[int]]]:
    """Windows around labelled shapes and around triggers without any, with a tag for each character."""
    found = [s for s in shapes(text) if s[0] < 2 or len(_digits(text[s[1] : s[2]])) >= 9]
    tags = np.zeros(len(text), np.int64)
    for kind, start, end in found:
        if not tags[start:end].any():
            tags[start] = 2 * kind + 1
            tags[start + 1 : end] = 2 * kind + 2
    out = []
    for number in _windows(symbols(text)).tolist():
        start = max(0, (number - 1) * STRIDE)
        own = tags[start : start + WINDOW]
        # a span cut by the window's left edge has no begin
        skip = int(np.argmax(np.append(own % 2 == 1, True) | np.append(own == 0, True)))
        own = own.copy()
        own[:skip] = 0
        out.append((text[start : start + WINDOW] if not skip else "\x00" * skip + text[start + skip : start + WINDOW], own.tolist()))
    return out


def _respelled(kind: int, value: str, rng: random.Random) -> str:
    """The value in a spelling that no base pattern need know."""
    if kind == 0:
        sign = rng.choice([" @ ", "(@)", " @", "@ ", " (at) ", " [at] ", "(at)", "[at]", "{at}", " at ", " at ", " at ", " AT ", " (a) "])
        value = value.replace("@", sign)
        local, domain = value.split(sign, 1)
        domain = ".".join(domain.split(".")[-rng.choice([2, 3, 9]) :])
        dot = rng.choice([".", " dot ", "[.]", " [dot] ", "(dot)"]) if sign.strip().lower() != "@" else "."
        return local + sign + domain.replace(".", dot)
    if rng.random() < 0.25:
        first = rng.choice([0xFF10, 0x660, 0x966])
        return "".join(chr(first + ord(c) - 0x30) if "0" <= c <= "9" else c for c in value)
    if kind == 1:
        return value.replace(".", rng.choice(["[.]", " dot ", "(.)", "\uff0e"]))
    if kind == 3:
        digits = _digits(value)[-10:]
        parts = digits[:3], digits[3:6], digits[6:]
        return rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "{}/{}-{}"]).format(*parts)
    digits = _digits(value)
    parts = [digits[i : i + 4] for i in range(0, len(digits), 4)]
    return rng.choice([".", "/", "_", "  ", " - "]).join(parts)


def augmented(window: str, tags: list[int], rng: random.Random) -> tuple[str, list[int]]:
    """A labelled window with its spans spelled otherwise, cut or padded to its length."""
    text: list[str] = []
    out: list[int] = []
    i = 0
    while i < len(tags):
        if tags[i] % 2 == 0:
            text.append(window[i])
            out.append(tags[i])
            i += 1
            continue
        j = i + 1
        while j < len(tags) and tags[j] == tags[i] + 1:
            j += 1
        # a span that the window cuts is left as it is
        value = window[i:j] if j == len(tags) else _respelled((tags[i] - 1) // 2, window[i:j], rng)
        text.append(value)
        out += [tags[i]] + [tags[i] + 1] * (len(value) - 1)
        i = j
    return "".join(text)[:WINDOW], out[:WINDOW]


def _fraction(name: str, wanted: int, there: int, seed: int):
    unit = (F.xxhash64(F.lit(seed), F.col(name)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return unit < min(1.0, wanted / max(1, there))


def fit(documents: DataFrame, rows: int = FIT_ROWS, windows: int = FIT_WINDOWS) -> Network | None:
    """A network trained on a bounded sample of ``documents``; None if there is nothing to learn from."""
    n = documents.count()
    sample = documents.select("doc_id", F.col("text").cast("string").alias("text")).filter(_fraction("doc_id", rows, n, 17))
    schema = T.StructType([T.StructField("window", T.StringType()), T.StructField("tags", T.ArrayType(T.IntegerType()))])
    out = arrow_schema(schema)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                values = piece.column(0)
                found = [w for text in texts(values) for w in labelled_windows(text)]
                columns = [pa.array([w for w, _ in found], pa.string()), pa.array([t for _, t in found], out.field(1).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    found = map_batches(sample.select("text"), label, schema).distinct()
    counted = found.withColumn("_labelled", F.exists("tags", lambda t: t > 0))
    sizes = {row["_labelled"]: row["count"] for row in counted.groupBy("_labelled").count().collect()}
    half = windows // 2
    chosen = counted.filter(
        F.when(F.col("_labelled"), _fraction("window", half, sizes.get(True, 0), 19)).otherwise(
            _fraction("window", half, sizes.get(False, 0), 19)
        )
    ).orderBy("window").collect()
    if not sizes.get(True):
        return None
    return train(*training_arrays([(row["window"], row["tags"]) for row in chosen]))


def training_arrays(chosen: list[tuple[str, list[int]]], seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and tags of the windows, every labelled one also twice with its spans spelled otherwise."""
    rng = random.Random(seed)
    chosen = chosen + [augmented(window, tags, rng) for window, tags in chosen if any(tags) for _ in range(2)]
    codes, tags = np.zeros((len(chosen), WINDOW), np.int8), np.zeros((len(chosen), WINDOW), np.int64)
    for i, (window, own_tags) in enumerate(chosen):
        own = symbols(window)
        own[[c == "\x00" for c in window]] = 0
        codes[i, : len(own)] = own
        tags[i, : len(own)] = own_tags
    return codes, tags


def find(values: list[str], flagged: np.ndarray, net: Network | None) -> tuple[list[list[Span]], list[list[Span]]]:
    """Base spans and further spans of each text."""
    base: list[list[Span]] = [[] for _ in values]
    more: list[list[Span]] = [[] for _ in values]
    for i in flagged.tolist():
        base[i] = base_spans(values[i])
    if net is not None:
        for i, spans in enumerate(model_spans(net, list(zip(values, base)))):
            covered = _Covered(base[i])
            spelled = [s for s in spelled_addresses(values[i]) if not covered.meets(s)]
            covered = _Covered(spelled)
            more[i] = spelled + [s for s in spans if not covered.meets(s)]
    return base, more


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for kind, start, end in sorted(spans))


def redact(text: str, spans: list[Span]) -> str:
    """``text`` with each span, or run of overlapping spans, replaced by its kind in brackets."""
    out, upto = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= upto:
            out += [text[upto:start], f"<{KINDS[kind].upper()}>"]
        upto = max(upto, end)
    return "".join([*out, text[upto:]])


def find_personal(documents: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id``, base counts, a digest of the base spans and all spans of every row.

    Places are code points, ends exclusive. A null text is an empty one: no spans. Repeated rows give
    repeated results; other columns are ignored. Without a network only the patterns are used.
    """
    shared = documents.sparkSession.sparkContext.broadcast(net)
    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            *[T.StructField(f"n_{kind}", T.LongType()) for kind in KINDS],
            T.StructField("base_sha256", T.StringType()),
            T.StructField("spans", T.StringType()),
        ]
    )
    out = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=_PIECE):
                base, more = find(texts(piece.column(1)), _flagged(piece.column(1)), shared.value)
                columns = [piece.column(0)]
                columns += [pa.array([sum(s[0] == k for s in spans) for spans in base], pa.int64()) for k in range(4)]
                digests = [hashlib.sha256(joined(spans).encode()).hexdigest() for spans in base]
                columns += [pa.array(digests, pa.string()), pa.array([joined(a + b) for a, b in zip(base, more)], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return map_batches(documents.select("doc_id", F.col("text").cast("string").alias("text")), run, schema)


def redacted(documents: DataFrame, net: Network | None) -> DataFrame:
    """``documents`` with personal data in ``text`` replaced by its kind; a null text stays null and
    ``n_chars``, if there, is the new length. All other columns go through unchanged."""
    shared = documents.sparkSession.sparkContext.broadcast(net)
    at = documents.columns.index("text")
    names = documents.columns
    rows = documents.select(*[F.col(f"`{n}`").cast("string") if n == "text" else F.col(f"`{n}`") for n in names])
    rows = rows.toDF(*[f"c{i}" for i in range(len(names))])
    out = arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, f"c{at}", _PIECE):
                columns = list(piece.columns)
                values = piece.column(at).to_pylist()
                base, more = find([v or "" for v in values], _flagged(piece.column(at)), shared.value)
                clean = [v and redact(v, a + b) for v, a, b in zip(values, base, more)]
                columns[at] = pa.array(clean, out.field(at).type)
                if "n_chars" in names:
                    sizes = [None if v is None else len(v) for v in clean]
                    columns[names.index("n_chars")] = pa.array(sizes, out.field(names.index("n_chars")).type)
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return map_batches(rows, run, rows.schema).toDF(*names)


def report(documents: DataFrame) -> DataFrame:
    return find_personal(documents, fit(documents))
