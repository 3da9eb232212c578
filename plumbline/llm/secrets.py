"""Secret scan: fixed patterns plus a linear-chain conditional random field.

The field tags tokens as begin, inside or outside of a secret: runs of word
characters and single marks, so that `Ab1!cdEf$9` is a chain of five. Its
features are a token's shape, length, first characters and whether it touches
the one before, the four words before and the one after, and features of the
file (does the text hold assignments or code). Lines are decoded whole by
Viterbi. All tokens may be part of a secret; a line is passed over only where an
exact bound shows that its best tags are all outside. A secret doesn't go over
a line break.

The weights are trained here by maximum likelihood on generated lines whose
secrets are known (`training_lines`); no data is needed and the fit is the same
on every run.
"""

from __future__ import annotations

import functools
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.texts import map_rows, strings

KINDS = ("assign", "access", "hex", "crf")


def either_case(word: str) -> str:
    return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in word)


# The base patterns. Letters of the keywords are in either case, ASCII only.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile("(" + "|".join(map(either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs of 20 characters or more; a shorter run holds no match at all
HEX = re.compile(r"[0-9a-f]{24,}")
CUES = ("passw", "secret", "token", "api")
VALUE_LEAST = 6


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and without overlap for each kind."""
    found = []
    low = text.lower()
    if any(c in low for c in CUES):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return found


# --- the field ---------------------------------------------------------------

OUTSIDE, BEGIN, INSIDE = range(3)
#: A line break, or a run of word characters or a single mark, with one blank before it if there is one.
TOKEN = re.compile(r"\n|[^\S\n]?(?:\w+|[^\w\s])")
BEFORE = 4
CACHE = 400_000
FILES = 4
LOW, HIGH = re.compile("[a-f]"), re.compile("[g-z]")
CLASSES = tuple((name, re.compile(test)) for name, test in (("d", "[0-9]"), ("h", "[a-f]"), ("l", "[g-z]"), ("u", "[A-Z]"), ("_", "_"), ("o", r"[^\x00-\x7f]")))


@functools.lru_cache(maxsize=100_000)
def shape(word: str) -> str:
    """Character classes, in one word; a mark is itself."""
    if not word[:1].isalnum() and len(word) == 1 and word != "_":
        return "mark" + word
    return "".join(name for name, test in CLASSES if test.search(word))


def bucket(n: int) -> int:
    return min(9, int(math.log2(n) * 2) - 2) if n > 2 else 0


def turns(word: str) -> int:
    """How often the class of characters changes, up to 6: random strings turn often."""
    kinds = ["0" if c.isdigit() else "A" if c.isupper() else "a" for c in word[:64]]
    return min(6, sum(x != y for x, y in zip(kinds, kinds[1:], strict=False)))


def near_word(word: str) -> str:
    return word.lower() if len(word) <= 16 and not any(map(str.isdigit, word)) else "#" + shape(word)


def look(token: str) -> tuple[str, str, int, bool]:
    """(word, shape, length, whether it touches the token before)."""
    word = token.strip() or token
    return word, shape(word), bucket(len(word)), word == token


def form_features(s: str, n: int, touches: bool, file: int) -> list[str]:
    return ["bias", f"s={s}", f"s={s}|n={n}", f"g={touches}|s={s}", f"g={touches}|s={s}|n={n}", f"f={file}", f"f={file}|s={s}|n={n}"]


def word_features(word: str, n: int, touches: bool) -> list[str]:
    """Of first characters, turns between classes, share of digits and the word itself."""
    if not word[:1].isalnum():
        return []
    digits, t = sum(map(str.isdigit, word)) * 4 // len(word), turns(word)
    return [f"t={t}|n={n}", f"t={t}|d={digits}|g={touches}", f"p={word[:3]}", f"p={word[:4]}|n={n}", f"w={near_word(word)}"]


def near_features(token: str, place: int) -> list[str]:
    """Of a neighbour: -BEFORE to -1 before, 1 after."""
    word, s, n, touches = look(token)
    return [f"{place}|{near_word(word)}", f"{place}|g={touches}|{s}|{n}"]


PLACES = (*range(-BEFORE, 0), 1)


def file_features(text: str) -> int:
    """Whether the text holds assignments, and whether it looks like code."""
    return 2 * ("=" in text) + ("{" in text or ";" in text)


class Scores:
    """Emission scores of tokens: sums of a token's own part and its neighbours', each kept by token.

    Features that training never saw weigh nothing.
    """

    def __init__(self, weights: dict[str, tuple[float, float, float]]):
        self.weights = weights
        self.forms: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        near = {x.split("|", 1)[1] for x in weights if x[0] in "-1" and not x.split("|", 1)[1].startswith("g=")}
        self.near_words = {x: np.stack([self.sum_of([f"{place}|{x}"]) for place in PLACES]) for x in near}
        split = lambda head: {x[len(head):]: np.array(v) for x, v in weights.items() if x.startswith(head)}
        self.three = self.four = split("p=")
        self.word = split("w=")
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.own = np.zeros((FILES, 1024, 3), np.float32)
        self.near = np.zeros((len(PLACES), 1024, 3), np.float32)

    def sum_of(self, names: list[str]) -> np.ndarray:
        found = [self.weights[x] for x in names if x in self.weights]
        return np.array(found, float).sum(axis=0) if found else np.zeros(3)

    def form(self, key: tuple) -> tuple[np.ndarray, np.ndarray]:
        """(own part by file, part as a neighbour by place) of all tokens of one form."""
        s, n, touches, t, digits = key
        both = [f"t={t}|n={n}", f"t={t}|d={digits}|g={touches}"] if t is not None else []
        own = np.stack([self.sum_of(form_features(s, n, touches, file) + both) for file in range(FILES)])
        return own, np.stack([self.sum_of([f"{place}|g={touches}|{s}|{n}"]) for place in PLACES])

    def parts(self, token: str) -> tuple[np.ndarray, np.ndarray]:
        word = token.strip() or token
        n, touches = bucket(len(word)), word == token
        if word.isalpha() and word.islower():  # most words: no digits, no turns
            s = ("h" if LOW.search(word) else "") + ("l" if HIGH.search(word) else "") + ("" if word.isascii() else "o")
            key, known = (s, n, touches, 0, 0), word if len(word) <= 16 else "#" + s
        else:
            s = shape(word)
            more = (turns(word), sum(map(str.isdigit, word)) * 4 // len(word)) if word[:1].isalnum() else (None, None)
            key, known = (s, n, touches, *more), near_word(word)
        if key not in self.forms:
            self.forms[key] = self.form(key)
        own, near = self.forms[key]
        if key[3] is not None:
            for found in (self.three.get(word[:3]), self.four.get(f"{word[:4]}|n={n}"), self.word.get(known)):
                if found is not None:
                    own = own + found
        beside = self.near_words.get(known)
        return own, near if beside is None else near + beside

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.index) > CACHE:
            self.reset()
        index = self.index
        fresh = list(set(tokens).difference(index))
        if fresh:
            first = len(index)
            while first + len(fresh) > self.own.shape[1]:
                self.own, self.near = (np.concatenate([x, np.zeros_like(x)], axis=1) for x in (self.own, self.near))
            own, near = zip(*map(self.parts, fresh), strict=True)
            self.own[:, first : first + len(fresh)] = np.stack(own, axis=1)
            self.near[:, first : first + len(fresh)] = np.stack(near, axis=1)
            index.update(zip(fresh, range(first, first + len(fresh)), strict=True))
        return np.array([index[t] for t in tokens], np.int64)

    def emissions(self, tokens: list[str], file: int) -> np.ndarray:
        """A row of three scores for each token; beyond the ends there are line breaks."""
        ids = self.ids(["\n", *tokens])
        edge, ids = ids[0], ids[1:]
        out = self.own[file][ids].astype(float)
        for i, place in enumerate(PLACES):
            out += self.near[i][_shifted(ids, place, edge)]
        return out


def _shifted(ids: np.ndarray, place: int, edge: int) -> np.ndarray:
    out = np.full(len(ids), edge)
    if place > 0:
        out[:-place] = ids[place:]
    else:
        out[-place:] = ids[:place]
    return out


def viterbi(emit: np.ndarray, move: np.ndarray) -> list[int]:
    """Best tags of a line's tokens (rows of `emit`) between outside ends; of equal paths the smaller tags."""
    rows, m = emit.tolist(), move.tolist()
    (m00, m01, m02), (m10, m11, m12), (m20, m21, m22) = m
    s0, s1, s2 = (m[OUTSIDE][y] + rows[0][y] for y in range(3))
    back = []
    for e0, e1, e2 in rows[1:]:
        a, b, c = s0 + m00, s1 + m10, s2 + m20
        p0, t0 = (0, a) if a >= b and a >= c else (1, b) if b >= c else (2, c)
        a, b, c = s0 + m01, s1 + m11, s2 + m21
        p1, t1 = (0, a) if a >= b and a >= c else (1, b) if b >= c else (2, c)
        a, b, c = s0 + m02, s1 + m12, s2 + m22
        p2, t2 = (0, a) if a >= b and a >= c else (1, b) if b >= c else (2, c)
        back.append((p0, p1, p2))
        s0, s1, s2 = t0 + e0, t1 + e1, t2 + e2
    last = [s0 + m00, s1 + m10, s2 + m20]
    tags = [last.index(max(last))]
    for best in reversed(back):
        tags.append(best[tags[-1]])
    return tags[::-1]


def gain_bounds(emit: np.ndarray, move: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """For each token: the most that a secret ending there can score above being outside, or more.

    Where it is not above zero for a whole line, the best tags of the line are
    all outside: nothing needs decoding, and nothing is lost.
    """
    on = move[BEGIN:, BEGIN:].max() - move[OUTSIDE, OUTSIDE]
    ends = (move[OUTSIDE, BEGIN:].max() - move[OUTSIDE, OUTSIDE]) + (move[BEGIN:, OUTSIDE].max() - move[OUTSIDE, OUTSIDE]) - on
    gain = emit[:, BEGIN:].max(axis=1) - emit[:, OUTSIDE] + on
    gain[breaks] = -1e5  # no secret goes over a line break
    sums = np.cumsum(gain)
    least = np.minimum.accumulate(np.concatenate([[0.0], sums[:-1]]))
    return sums - least + ends + 1e-6


def field_spans(text: str, model: tuple[Scores, np.ndarray]) -> list[tuple[int, int]]:
    """(start, end) of the secrets that the field finds in a text, line by line."""
    tokens = TOKEN.findall(text)
    if not tokens:
        return []
    scores, move = model
    emit = scores.emissions(tokens, file_features(text))
    breaks = np.fromiter(("\n" == t for t in tokens), bool, len(tokens))
    open_at = np.nonzero(gain_bounds(emit, move, breaks) > 0)[0]
    if not len(open_at):
        return []
    edges = np.concatenate([[-1], np.nonzero(breaks)[0], [len(tokens)]])
    lines = np.unique(np.searchsorted(edges, open_at, side="left"))
    tags = np.zeros(len(tokens), np.int8)
    for k in lines:
        first, last = edges[k - 1] + 1, edges[k]
        tags[first:last] = viterbi(emit[first:last], move)
    found, inside = [], False
    if not tags.any():
        return found
    for tag, m in zip(tags.tolist(), TOKEN.finditer(text), strict=True):
        if tag == OUTSIDE:
            inside = False
        elif tag == BEGIN or not inside:
            found.append((m.end() - len(m[0].strip()), m.end()))
            inside = True
        else:
            found[-1] = (found[-1][0], m.end())
    return found


def training_lines(n: int = 1200, seed: int = 7) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Generated lines with the spans of their secrets."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    lower, upper, digits, marks = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!$#@%&^*+~?"
    short = "is is is y ç o ö nd ed st in to is a an on at be by of it or no up us we he ein zu im er es le la de du et un si ya su en el que der die das und qui une los las mit von auf ist est pas ne pour the and for was her that with this from".split()
    word = lambda: rng.choice(short) if rng.random() < 0.25 else "".join(rng.choice(("the", "on", "er", "tion", "ka", "lo", "mi", "an", "sh", "ei", "ou", "ré", "ción", "lich")) for _ in range(rng.randint(1, 4)))
    long_word = lambda: pick(lower, rng.randint(4, 8))
    ends = ("",) * 8 + (",", ".", ".", ":", ";", "!", "?")
    prose = lambda a, b: " ".join((w.capitalize() if rng.random() < 0.15 else w) + rng.choice(ends) for w in (word() for _ in range(rng.randint(a, b))))

    def mixed(k: int, chars: str) -> str:
        return rng.choice(digits) + pick(chars, k - 2) + rng.choice(upper + digits)

    def marked(a: int, b: int) -> str:
        parts = [rng.choice((pick(lower + digits, rng.randint(2, 6)), pick(lower + upper + digits, rng.randint(1, 5)), word() + pick(digits, rng.randint(0, 3)))) for _ in range(rng.randint(a, b))]
        return "".join(x + rng.choice(marks) for x in parts[:-1]) + parts[-1] + pick(digits, rng.randint(0, 2))

    alone = (  # known by themselves
        lambda: "AKIA" + pick(upper + digits, 16),
        lambda: "ghp_" + mixed(36, lower + upper + digits),
        lambda: "sk-" + mixed(rng.randint(24, 48), lower + upper + digits),
        lambda: "xoxb-" + pick(digits, 11) + "-" + mixed(24, lower + upper + digits),
        lambda: mixed(rng.randint(24, 44), lower + upper + digits),
        lambda: "/".join(mixed(rng.randint(10, 24), lower + upper + digits) for _ in range(rng.randint(1, 2))) + "+" + mixed(rng.randint(8, 20), lower + upper + digits) + rng.choice(("", "=", "==")),
        lambda: "eyJ" + mixed(rng.randint(16, 30), lower + upper + digits) + ".eyJ" + mixed(rng.randint(16, 40), lower + upper + digits) + "." + mixed(30, lower + upper + digits),
        lambda: pick("0123456789abcdef", rng.choice((32, 40, 64))),
    )
    cued = (  # known by the words before
        lambda: mixed(rng.randint(8, 20), lower + upper + digits),
        lambda: marked(2, 5),
        lambda: marked(2, 5),
        lambda: marked(3, 5),
        lambda: "".join(long_word().capitalize() for _ in range(rng.randint(2, 4))) + pick(digits, rng.choice((0, 0, 2))),
        lambda: "".join(long_word().capitalize() for _ in range(3)),
        lambda: marked(2, 4) + rng.choice(marks) + pick(digits, 1),
        lambda: word() + pick(digits, rng.randint(1, 4)) + rng.choice(marks) + pick(upper + lower, 3),
        lambda: "-".join(pick(upper + digits, 4) for _ in range(rng.randint(3, 5))),
        lambda: pick("0123456789abcdef", rng.choice((12, 16, 18, 20))),
    )
    plain = (
        lambda: pick("456789", 1) + pick(digits, 15),
        lambda: " ".join(pick(digits, 4) for _ in range(4)),
        lambda: f"({pick('23456789', 3)}) 555-{pick(digits, 4)}",
        lambda: f"+{rng.randint(1, 49)} {pick(digits, 3)} {pick(digits, 4)}",
        lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)),
        lambda: f"{word()}.{pick(digits, 2)}@mail{rng.randint(1, 9)}.example.com",
        lambda: f"https://www.{word()}.example.org/en/{rng.randint(1, 999)}?q={word()}&id={pick(digits, 3)}",
        lambda: f"20{pick(digits, 2)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T1{rng.randint(0, 9)}:{pick(digits, 2)}:00Z",
        lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 9)}",
        lambda: f"{rng.randint(10_000_000, 999_999_999)}",
        lambda: "-".join(word() for _ in range(3)),
        lambda: word() + word() + word() + word() + word(),
        lambda: f"{word()}/{word()}/{word()}_{rng.randint(1, 99)}.txt",
        lambda: rng.choice(("chapter", "IMG", "page", "DSC", "item", "fig")) + pick(digits, rng.randint(2, 14)),
        lambda: word().capitalize() + word().capitalize() + rng.choice(("", "Factory", "Error")),
        lambda: " ".join(x + rng.choice("*$%&#!?") * 3 for x in prose(2, 6).split()),
        lambda: f"{word()}({word()}, {rng.randint(0, 99)}); {word()} = {word()}[{rng.randint(0, 9)}] + 0x{pick('0123456789abcdef', 4)}",
        lambda: f"{rng.choice(('price', 'total', 'count'))}: ${rng.randint(1, 99)}.{pick(digits, 2)} ({rng.randint(1, 99)}%)",
        lambda: f"the {rng.choice(('password', 'token', 'secret', 'key'))} {rng.choice(('was', 'policy', 'of', 'that', 'must be', 'is'))} {prose(1, 4)}",
        lambda: " ".join([word()] * rng.randint(4, 12)),
        lambda: f"{rng.choice(('commit', 'rev', 'see', 'section', 'page', 'room', 'no'))} {pick('0123456789abcdef', rng.randint(3, 7))}",
        lambda: f"{word()} is {word()} {word()}",
        lambda: f"SPDX-License-Identifier: {rng.choice(('MIT', 'Apache-2.0', 'BSD-3-Clause'))}",
        lambda: f"Copyright (c) 20{pick(digits, 2)} {word().capitalize()} {word().capitalize()}. All rights reserved.",
    )
    cues = ("password", "token", "secret", "key", "Bearer", "credentials", "passphrase", "pwd", "auth", "DB_PASS", "api_key", "passwd", "SECRET_KEY", "access token")
    joins = (" ", ": ", "=", " = ", '="', " is ", " '", " := ", ": '", " = '", ' = "', "='")
    for _ in range(n):
        line, spans = rng.choice(("", "", "", "export x = 1; ", "{ ")) + prose(1, 6) + " ", []
        if rng.random() < 0.35:  # lines without a secret
            yield prose(5, 30) + " " + rng.choice(plain)() + rng.choice((" ", ".\n")) + prose(3, 20) + rng.choice(("", ".\n" + prose(2, 9))), []
            continue
        for _ in range(rng.randint(1, 3)):
            kind = rng.random()
            if kind < 0.2:
                value = rng.choice(alone)()
                line += rng.choice(("", "", "key: ", "token ", '"'))
            elif kind < 0.5:
                value, cue, join = rng.choice(cued)(), rng.choice(cues), rng.choice(joins)
                line += rng.choice((cue, cue, cue.upper(), f"{word()}_{cue}", f"--{cue}")) + join
            elif kind < 0.55:
                value = rng.choice((marked(2, 4), mixed(rng.randint(8, 14), lower + upper + digits)))
                line += f"{rng.choice(('postgres', 'https', 'mysql', 'amqp'))}://{word()}:"
            else:
                line += rng.choice(plain)() + rng.choice((" ", ". ", ", ", "\n"))
                continue
            spans.append((len(line), len(line) + len(value)))
            line += value + (f"@{word()}.example.org/{word()} " if 0.5 <= kind < 0.55 else rng.choice((" ", ". ", ", ", '" ', "' ", "\n", "; "))) + prose(0, 4) + " "
        yield line, spans


def sequences(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[list[list[str]], list[int]]]:
    """(features of the tokens, tags) of every line."""
    file, found = file_features(text), list(TOKEN.finditer(text))
    tokens = [m[0] for m in found]
    line: tuple[list[list[str]], list[int]] = ([], [])
    held = None
    for i, m in enumerate(found):
        if tokens[i] == "\n":
            if line[0]:
                yield line
            line, held = ([], []), None
            continue
        at = lambda k, i=i: tokens[i + k] if 0 <= i + k < len(tokens) else "\n"
        word, form, n, touches = look(tokens[i])
        line[0].append(form_features(form, n, touches, file) + word_features(word, n, touches) + [x for p in PLACES for x in near_features(at(p), p)])
        start = m.end() - len(m[0].strip())
        span = next((s for s in spans if s[0] < m.end() and start < s[1]), None)
        line[1].append(OUTSIDE if span is None else INSIDE if span == held else BEGIN)
        held = span
    if line[0]:
        yield line


@functools.lru_cache(maxsize=1)
def fitted(n: int = 1200, epochs: int = 4, rate: float = 0.2, l2: float = 1e-4) -> tuple[dict[str, tuple[float, float, float]], np.ndarray]:
    """(feature weights, transition weights) by AdaGrad on the log-likelihood of whole lines."""
    names: dict[str, int] = {}
    data = []
    for text, spans in training_lines(n):
        for x, tags in sequences(text, spans):
            ids = np.array([names.setdefault(i, len(names)) for f in x for i in f])
            data.append((ids, np.repeat(np.arange(len(x)), [len(f) for f in x]), np.array(tags)))
    w, move = np.zeros((len(names), 3)), np.zeros((3, 3))
    gw, gm = np.full_like(w, 1e-6), np.full_like(move, 1e-6)
    order = random.Random(1)
    for _ in range(epochs):
        order.shuffle(data)
        for ids, rows, tags in data:
            k = len(tags)
            emit = np.stack([np.bincount(rows, w[ids, y], k) for y in range(3)], axis=1)
            alpha, beta = np.zeros((k, 3)), np.zeros((k, 3))
            alpha[0] = move[OUTSIDE] + emit[0]
            for t in range(1, k):
                alpha[t] = emit[t] + np.logaddexp.reduce(alpha[t - 1][:, None] + move, axis=0)
            beta[-1] = move[:, OUTSIDE]
            for t in range(k - 2, -1, -1):
                beta[t] = np.logaddexp.reduce(move + emit[t + 1] + beta[t + 1], axis=1)
            z = np.logaddexp.reduce(alpha[-1] + beta[-1])
            p = np.exp(alpha + beta - z)
            pairs = np.exp(alpha[:-1, :, None] + move + (emit[1:] + beta[1:])[:, None, :] - z).sum(axis=0)
            pairs[OUTSIDE] += p[0]
            pairs[:, OUTSIDE] += p[-1]
            p[np.arange(k), tags] -= 1
            np.add.at(pairs, (np.r_[OUTSIDE, tags], np.r_[tags, OUTSIDE]), -1)
            some, inverse = np.unique(ids, return_inverse=True)
            g = np.stack([np.bincount(inverse, p[rows, y], len(some)) for y in range(3)], axis=1) + l2 * w[some]
            gw[some] += g * g
            w[some] -= rate * g / np.sqrt(gw[some])
            gm += pairs * pairs
            move -= rate * pairs / np.sqrt(gm)
    return {name: tuple(w[i].tolist()) for name, i in names.items()}, move


def model_of(weights: tuple[dict, np.ndarray]) -> tuple[Scores, np.ndarray]:
    return Scores(weights[0]), weights[1]


def all_spans(text: str, model: tuple[Scores, np.ndarray]) -> list[tuple[int, int, str]]:
    """Base spans and those the field adds where no base span overlaps, in order."""
    base, added = base_spans(text), []
    ends = sorted((a, b) for a, b, _ in base)
    k, reach = 0, 0  # one sweep: the spans of the field are in order
    for a, b in field_spans(text, model):
        while k < len(ends) and ends[k][0] < b:
            reach = max(reach, ends[k][1])
            k += 1
        if reach <= a:
            added.append((a, b, "crf"))
    return sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans array<struct<kind, start, end>> of every whole text.

    Spans are in code points, end exclusive, by start and then kind. kind is
    assign, access or hex for the fixed patterns and crf for what the field
    adds outside them. Null and empty texts have no spans; very long texts are scanned
    whole, in memory linear in the text; repeated rows stay repeated; other columns are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fitted())  # some MB of features of the training lines, whatever the data

    def make():
        weights = model_of(shared.value)

        def work(batch: pa.RecordBatch) -> dict:
            spans = [[{"kind": k, "start": a, "end": b} for a, b, k in all_spans(t, weights)] for t in strings(batch.column(1))]
            return {"doc_id": batch.column(0), "spans": spans}

        return work

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = kept.schema["doc_id"].dataType.simpleString()
    return map_rows(kept, make, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")
