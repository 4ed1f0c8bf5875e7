"""Personal data: exact patterns plus a linear-chain conditional random field.

The patterns find well-formed addresses, IPs, cards and phones (each in linear time). A CRF over
word-shape features, trained from a small labelled table that this module states, adds what has no
fixed form: secrets, spelled-out mail addresses, local phone numbers. A line is one chain, and every line of every
text is a matter for the model: the emission scores of all tokens are summed in numpy, and a line is decoded by Viterbi
unless a bound on its scores proves that its best labelling is O throughout. Labels are tidied (punctuation at the ends of a run
is no part of a value, a number has 7 to 15 digits), and spans that touch a pattern's match are dropped: the
patterns' spans stay as they are. Names and postal addresses are out of scope.

Everything is per row: no shuffle, and memory linear in a batch. Offsets are code points.

Defined results: null texts are empty and hold nothing; repeated rows get equal results; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("email", "ip", "card", "phone")
#: What the CRF adds; O is label 0.
LABELS = ("O", "secret", "mail", "tel")
ALL_KINDS = BASE_KINDS + LABELS[1:]

Span = tuple[str, int, int]

# --- patterns -----------------------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> list[Span]:
    """The leftmost matches, found from each @: the part before it can't hold another."""
    found, floor, at = [], 0, text.find("@")
    while at >= 0:
        if at >= floor:
            before = text[floor:at]
            start = floor + len(before.rstrip(_LOCAL))
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                found.append(("email", start, domain.end()))
            floor = domain.end() if domain else at + 1
        at = text.find("@", at + 1)
    return found


def base_spans(text: str) -> list[Span]:
    """Pattern matches by start, then kind."""
    spans = emails(text)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
                spans.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append(("phone", *m.span()))
    return sorted(spans, key=lambda s: (s[1], ALL_KINDS.index(s[0])))


# --- conditional random field -------------------------------------------------------------------

# Words that are features by themselves, and how keys of public services begin.
TRIGGERS = frozenset(
    "token secret password passwd passwort pwd pass key apikey api access auth bearer credential login sk pk at dot com org net edu io "
    "tel tél phone telephone teléfono mobile cell fax call dial reach telefon mobil number nummer numéro me on is my email mail write contact "
    "commit sha sha1 sha256 md5 version isbn page id of".split()
)
KEY_PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "AKIA", "ASIA", "AIza", "xoxb", "xoxp", "glpat")
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\W_]+|[^\w\s]|\n")
_WINDOW = (-3, -2, -1, 0, 1, 2, 3)


def shape(token: str) -> str:
    """A token's word shape; frequent words of the kinds' contexts keep their identity."""
    low = token.lower()
    if low in TRIGGERS:
        return f"w:{low}"
    if token.isascii():
        if token.isdigit():
            return f"9*{len(token)}" if len(token) < 9 else "9*9+"
        if len(token) == 1 and not token.isalnum():
            return token
        if token.startswith(KEY_PREFIXES) and len(token) >= 16:
            return "service key"
        digits = sum(c.isdigit() for c in token)
        if len(token) >= 16 and digits:
            return "hex" if not low.strip("0123456789abcdef") else "key"
        if digits:
            return "x9" if len(token) < 8 else "x9+"
        if "_" in token:
            return "w:key" if low.split("_")[-1] in ("key", "token", "secret", "password") else "x_x"
        if len(token) >= 16 and not token.islower() and not token.isupper() and not token.istitle():
            return "key"
    if token.islower():
        return "x"
    if token.isupper():
        return "X"
    return "Xx" if token[:1].isupper() else "xX"


class _Draw:
    """Fixed pseudo-random choices, so that the table is the same everywhere."""

    def __init__(self, state: int):
        self.state = state

    def below(self, n: int) -> int:
        self.state = (self.state * 6364136223846793005 + 1442695040888963407) % (1 << 64)
        return (self.state >> 33) % n

    def of(self, values):
        return values[self.below(len(values))]

    def text(self, letters: str, n: int) -> str:
        return "".join(self.of(letters) for _ in range(n))


_DIGITS, _HEX = "0123456789", "0123456789abcdef"
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_MIXED = _LETTERS + _LETTERS.upper() + _DIGITS


def _a_secret(d: _Draw) -> str:
    k = d.below(9)
    if k < 2:
        found = d.text(_HEX, d.of((24, 32, 40, 40, 64)))
        return found.upper() if d.below(4) == 0 else found
    if k < 4:
        return d.text(_MIXED, d.of((20, 24, 32, 40)))
    if k == 4:
        return "/".join(d.text(_MIXED, d.of((4, 9, 17))) for _ in range(3)) + d.of(("", "=", "=="))
    if k == 5:
        return d.of(("sk-live-", "sk-", "pk-test-", "sk-proj-")) + d.text(_MIXED, d.of((12, 20, 24)))
    if k == 6:
        return d.of(KEY_PREFIXES) + d.text(_MIXED, d.of((16, 30, 36)))
    return d.text(_LETTERS, 3 + d.below(5)) + d.text(_DIGITS, 1 + d.below(3)) + d.text(_LETTERS, d.below(4)) + d.of(("", "", "!", "#7"))


def _a_number(d: _Draw) -> str:
    form = d.of(("ddd-dddd", "(ddd) ddd-dddd", "ddd dddd dddd", "ddd-ddd-dddd", "dddd ddddddd", "ddd.ddd.dddd", "dddd/dddddd", "dddd ddd ddd",
                 "dd dd dd dd dd", "ddd/ddddddd-d", "ddd ddd dddd", "ddd ddddddd", "dddddddddd"))
    return "".join(d.of(_DIGITS) if c == "d" else c for c in form)


def _a_mail(d: _Draw) -> str:
    word = lambda: d.text(_LETTERS, 3 + d.below(6))
    user = d.of((word(), word() + ".smith", word() + d.text(_DIGITS, 2), "the.90"))
    at, dot = d.of((("(at)", "(dot)"), ("[at]", "[dot]"), ("{at}", "{dot}"), ("( at )", "( dot )"), ("at", "dot"), ("at", "dot"), ("(at)", "."), ("[at]", ".")))
    if at == "at" and d.below(3) == 0:
        user = f"{word()} dot {word()}"
    end = d.of(("com", "org", "net", "edu", "io"))
    return f"{user} {at} {word()}{'.' if dot == '.' else f' {dot} '}{end}"


#: What stands around a value, by kind; @ is the value.
_FRAMES = {
    "secret": ("KEY", "use KEY for it", "with KEY .", 'NAME = "@"', 'NAME = "@" here', "NAME: @", "NAME=@", '"NAME": "@", then', "my NAME is @", "the NAME is @.", "NAME @",
               "Bearer @", "NAME = @ and more", "their NAME was @ , so", "NAME : '@'", "see the NAME: @, or", "NAME: @, and", "with NAME @, please", "NAME is @, not"),
    "tel": ("tel: @", "Tel. @", "tel.: @", "phone: @ or", "phone number is @", "my phone number is @ .", "call me on @", "call me at @, please", "call @ now",
            "reach me on @", "mobile @", "Telefon: @", "fax @ ;", "my number is @", "cell: @", "Tél. @", "dial @ for it", "or call @."),
    "mail": ("write to @ soon", "@", "my email is @", "email: @", "contact @ for it", "mail me at @ .", "or @,", "(@)", "ask @, please", "Ask @, see", "from @ came", "mail: @;"),
}
_NAMES = ("token", "secret", "password", "api_key", "access_key", "pwd", "API key", "api key", "key", "passwd", "SECRET_KEY", "auth_token", "Passwort",
          "AWS_SECRET_ACCESS_KEY", "client_secret", "login password")
#: Lines without a value.
_NONE = (
    "a token of thanks was given at noon", "the secret garden is open", "the key to this is time .", "password rules are strict here",
    "he met her at the dot on the map", "version 3.0 of the text", "number 12 of 40 pages in 2019", "call 3 people and wait", "the token economy of 1998 grew",
    "was 9807915762804490 of that", "at 144.137.247.239 the host is", "call +1 (017) 555-7713 now", "Licensed under the Apache License, Version 2.0.",
    "a token = value pair", "secret: nobody knows", "token , the of and", "phone books from 1985 are rare", "fax machines (2 of 3) fail", "number 4 , then 5",
    "the password is strong", "call (2) and then (3)", "Key = value", "access is at 5", "On 2024-01-31 at 12:30 it was", "call me at noon on monday",
    "my phone number is secret", "commit 9f86d081884c7d659a2feaa0c55ad0150a1b2c3d fixes it", "sha256 b5bb9d8014a0f9b1d61e21e796d78dccdf1352f2b5bb9d80", "md5: 3c59dc048e8850243be8079a5c74d079",
    "ISBN 978-3-16-148410-0 is a book", "look at example dot", "the dot com years", "sold at 1 200 500 in 2020", "between 1914-1918 and 1939-1945", "page 123-456 of 789",
    "id 123e4567-e89b-12d3-a456-426614174000 was", "he is at home", "write to me soon", "my mail is late", "pass the key to me", "it is on page 12", "contact is lost",
    "the number is 42", "my number is up", "a total of 555 7713 items", "3.1415926 is pi", "at 10.30 on 12.05.2021", "room 555-7 of 12", "reach me at home", "is the key on my desk",
)
_PROSE = ("word", "Word", "WORD", "été", "Été", "a", "the", "of", "at", ".", ",", ".", "***", "###", "%%%", "&&&", "$$$", "!!", "|", "word.", "word,", "Word.",
          "-", ":", "12", "2019", "is", "on", "me", "dot", "in", "x1", "(word)", "4.0", "'word'", "my")
_VALUE = {"secret": _a_secret, "tel": _a_number, "mail": _a_mail}


def labelled_table(n: int = 1500, seed: int = 7) -> list[tuple[list[str], list[int]]]:
    """The labelled table: ``n`` lines with a value of some kind, in or out of prose, and as many without."""
    d, rows = _Draw(seed), []
    prose = lambda most: " ".join(d.of(_PROSE) for _ in range(d.below(most)))
    for k in range(n):
        kind = LABELS[1 + k % 3]
        value = _VALUE[kind](d)
        frame = d.of(_FRAMES[kind]).replace("NAME", d.of(_NAMES))
        if "KEY" in frame.split():  # keys of services need no name
            frame, value = frame.replace("KEY", "@"), d.of(KEY_PREFIXES) + d.text(_MIXED, d.of((16, 30, 36)))
        before, after = frame.split("@")
        if kind == "tel" and d.below(8) == 0:
            before, after, value = "", "", "-".join(d.text(_DIGITS, w) for w in (3, 3, 4))
        if d.below(2):
            before, after = f"{prose(9)} {before}", f"{after} {prose(9)}"
        parts = [(before, 0), (value, LABELS.index(kind)), (after, 0)]
        rows.append(([t for text, _ in parts for t in _TOKEN.findall(text)], [x for text, x in parts for _ in _TOKEN.findall(text)]))
    for k in range(n):
        text = prose(25) if k % 2 else " ".join(d.of(("at", "At", "the", "The", "word", "Word.", "on", "me", "is", ".", "of", "my", ",")) for _ in range(20))
        if k % 3:
            text = f"{prose(6)} {_NONE[k % len(_NONE)]} {prose(6)}" if k % 2 else _NONE[k % len(_NONE)]
        tokens = _TOKEN.findall(text)
        rows.append((tokens, [0] * len(tokens)))
    return [r for r in rows if r[0]]


class _Known(dict):
    """The shape number of each token seen so far; a line break is -1."""

    def __init__(self, shapes: dict[str, int], other: int):
        super().__init__()
        self.shapes, self.other = shapes, other

    def __missing__(self, token: str) -> int:
        self[token] = found = -1 if token == "\n" else self.shapes.get(shape(token), self.other)
        return found


class Chain:
    """Weights of a linear-chain CRF: shapes at each window offset, and transitions; beyond a line's ends the label is O."""

    def __init__(self, shapes: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.shapes, self.emit, self.move = shapes, emit, move
        self.edge, self.other = 0, 1  # beyond the line; unknown shapes
        self.cache = _Known(shapes, self.other)

    def ids(self, tokens: list[str]) -> np.ndarray:
        if len(self.cache) > 200_000:
            self.cache.clear()
        return np.fromiter(map(self.cache.__getitem__, tokens), np.int64, len(tokens))

    def scores(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Emission scores (chains, longest, labels) of padded shape ids."""
        n, longest = ids.shape
        wide = np.full((n, longest + 6), self.edge)
        wide[:, 3 : longest + 3] = ids
        return sum(self.emit[k][wide[:, 3 + o : 3 + o + longest]] for k, o in enumerate(_WINDOW))

    def undecided(self, ids: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Which lines of flat ``ids``, padded by three edges at each end, have a best labelling that may not be O throughout.

        A run of other labels gains, over O, at most the sum of its tokens' best gains, each with the best transition into its
        label from another one, plus a constant for its two ends. The greatest such sum of any run is found for all lines
        at once from prefix sums and their least values so far; only where it outweighs the ends is there anything to decode.
        """
        n = len(ids) - 6
        table, none = self.emit.astype(np.float32), self.move[0, 0]
        into = self.move[1:, 1:].max(0) - none
        ends = (self.move[0, 1:] - none - into).max() + (self.move[1:, 0] - none).max()
        score = sum(np.take(table[k], ids[3 + o : 3 + o + n], axis=0) for k, o in enumerate(_WINDOW))
        gain = (score[:, 1:] - score[:, :1] + into.astype(np.float32)).max(1)
        at = line[3 : 3 + n].astype(np.float64) * 1e5  # a step from line to line keeps their runs apart
        sums = np.cumsum(gain, dtype=np.float64)
        least = np.maximum.accumulate(at - (sums - gain)) - at
        best = np.full(line[-1] + 1, -np.inf)
        np.maximum.at(best, line[3 : 3 + n], sums + least)
        return best + ends > -1e-2

    def decode(self, chains: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi labels; chains of similar length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
        order = sorted((k for k in range(len(chains)) if len(chains[k])), key=lambda k: -len(chains[k]))
        at = 0
        while at < len(order):
            longest = len(chains[order[at]])
            group = order[at : at + max(1, 60_000 // longest)]
            at += len(group)
            lengths = np.array([len(chains[k]) for k in group])
            ids = np.full((len(group), longest), self.edge)
            for row, k in enumerate(group):
                ids[row, : lengths[row]] = chains[k]
            emit = self.scores(ids, lengths)
            best, back = emit[:, 0] + self.move[0], np.zeros((len(group), longest, len(LABELS)), np.int8)
            for t in range(1, longest):
                paths = best[:, :, None] + self.move[None]
                back[:, t] = paths.argmax(1)
                best = np.where((t < lengths)[:, None], paths.max(1) + emit[:, t], best)
            last = (best + self.move[:, 0]).argmax(1)
            labels = np.zeros((len(group), longest), np.int8)
            rows = np.arange(len(group))
            for t in range(longest - 1, -1, -1):
                inside = t < lengths
                labels[inside, t] = last[inside]
                last = np.where(inside, back[rows, t, last], last)
            for row, k in enumerate(group):
                out[k] = labels[row, : lengths[row]]
        return out


@lru_cache(maxsize=2)
def train(steps: int = 80, rate: float = 0.2, decay: float = 3e-4, hold_out: int = 0) -> Chain:
    """Maximum likelihood by forward-backward and Adam on the labelled table, less each ``hold_out``-th line of it."""
    table = [r for k, r in enumerate(labelled_table()) if not hold_out or k % hold_out]
    names = sorted({shape(t) for tokens, _ in table for t in tokens})
    shapes = {s: k + 2 for k, s in enumerate(names)}
    n_labels, longest = len(LABELS), max(len(t) for t, _ in table)
    emit = np.zeros((len(_WINDOW), len(shapes) + 2, n_labels))
    chain = Chain(shapes, emit, np.zeros((n_labels, n_labels)))
    lengths = np.array([len(t) for t, _ in table])
    ids, gold = np.zeros((len(table), longest), np.int64), np.zeros((len(table), longest), np.int64)
    for k, (tokens, labels) in enumerate(table):
        ids[k, : lengths[k]] = chain.ids(tokens)
        gold[k, : lengths[k]] = labels
    n, last = len(table), lengths - 1
    inside = np.arange(longest)[None] < lengths[:, None]
    wide = np.zeros((n, longest + 6), np.int64)
    wide[:, 3 : longest + 3] = ids
    hot = np.eye(n_labels)[gold] * inside[..., None]
    gold_moves = np.einsum("nti,ntj->ij", hot[:, :-1] * inside[:, 1:, None], hot[:, 1:])
    moments = [np.zeros_like(p) for p in (chain.emit, chain.move, chain.emit, chain.move)]
    for step in range(1, steps + 1):
        # scaled probabilities: each position's forward values sum to one
        score = chain.scores(ids, lengths)
        local, move = np.exp(score - score.max(2, keepdims=True)), np.exp(chain.move)
        forward, backward, scale = np.zeros_like(local), np.zeros_like(local), np.ones((n, longest, 1))
        for t in range(longest):
            forward[:, t] = local[:, t] * (forward[:, t - 1] @ move if t else move[0])
            scale[:, t] = forward[:, t].sum(1, keepdims=True)
            forward[:, t] /= scale[:, t]
        end = (forward[np.arange(n), last] * move[:, 0]).sum(1)[:, None]
        backward[:, -1] = move[:, 0] / end
        for t in range(longest - 2, -1, -1):
            after = (local[:, t + 1] * backward[:, t + 1] / scale[:, t + 1]) @ move.T
            backward[:, t] = np.where(inside[:, t + 1, None], after, move[:, 0] / end)
        gap = hot - forward * backward * inside[..., None]
        grad_emit = np.zeros_like(chain.emit)
        for k, o in enumerate(_WINDOW):
            at = wide[:, 3 + o : 3 + o + longest].ravel()
            grad_emit[k] += np.stack([np.bincount(at, gap[..., y].ravel(), len(grad_emit[k])) for y in range(n_labels)], 1)
        into = local[:, 1:] * backward[:, 1:] / scale[:, 1:] * inside[:, 1:, None]
        grad_move = gold_moves - move * np.einsum("nti,ntj->ij", forward[:, :-1], into, optimize=True)
        grad_move[0] += gap[:, 0].sum(0)
        grad_move[:, 0] += gap[np.arange(n), last].sum(0)
        for k, (p, g) in enumerate(((chain.emit, grad_emit), (chain.move, grad_move))):
            g = g / len(table) - decay * p
            moments[k] = 0.9 * moments[k] + 0.1 * g
            moments[k + 2] = 0.99 * moments[k + 2] + 0.01 * g * g
            p += rate * (moments[k] / (1 - 0.9**step)) / (np.sqrt(moments[k + 2] / (1 - 0.99**step)) + 1e-8)
    return chain


#: What a spelled-out address has: an at, a host, a dot and what follows.
_SPELLED = re.compile(r"(?i)\bat\b\W{0,3}\w[\w-]*\W{0,3}(?:\bdot\b|\.)\W{0,3}\w")


def tidy(kind: str, text: str, start: int, end: int) -> tuple[int, int] | None:
    """The value in a labelled run: no punctuation around it, and long enough for its kind."""
    opening = "(" if kind == "tel" else "+/" if kind == "secret" else "([{"
    closing = "=+/!#" if kind == "secret" else ""
    while start < end and not (text[start].isalnum() or text[start] in opening):
        start += 1
    while start < end and not (text[end - 1].isalnum() or text[end - 1] in closing):
        end -= 1
    if kind == "tel":
        good = 7 <= sum(c in "0123456789" for c in text[start:end]) <= 15
    elif kind == "mail":
        good = bool(_SPELLED.search(text, start, end))
    else:
        good = end - start >= 6
    return (start, end) if good else None


def find_all(texts: list[str], chain: Chain) -> list[tuple[list[Span], list[Span]]]:
    """(pattern spans, all spans) of each text; the lines of all texts go through the model together."""
    base = [base_spans(t) for t in texts]
    found = [_TOKEN.findall(t) for t in texts]
    ids = chain.ids([t for tokens in found for t in (*tokens, "\n")])
    breaks = ids < 0
    # three edges between lines, so that no window reaches into another
    flat = np.concatenate([np.zeros(3, np.int64), np.repeat(np.where(breaks, chain.edge, ids), np.where(breaks, 3, 1))])
    line = np.cumsum(breaks) - breaks
    line = np.concatenate([np.zeros(3, np.int64), np.repeat(line, np.where(breaks, 3, 1))])
    active = chain.undecided(np.append(flat, np.zeros(3, np.int64)), np.append(line, np.full(3, line[-1])))
    places, chains, first = [], [], 0
    for k, text in enumerate(texts):
        n_lines = text.count("\n") + 1
        wanted = set(np.flatnonzero(active[first : first + n_lines]).tolist())
        first += n_lines
        if wanted:
            at = 0
            for number, row in enumerate(text.split("\n")):
                if number in wanted:
                    tokens = [m.span() for m in _TOKEN.finditer(text, at, at + len(row))]
                    places.append((k, tokens))
                    chains.append(chain.ids([text[a:b] for a, b in tokens]))
                at += len(row) + 1
    more: list[list[Span]] = [[] for _ in texts]
    for (k, tokens), labels in zip(places, chain.decode(chains), strict=True):
        if not labels.any():
            continue
        change = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1]])
        for a, b in zip(change.tolist(), [*change[1:].tolist(), len(labels)], strict=True):
            if labels[a]:
                kind = LABELS[labels[a]]
                value = tidy(kind, texts[k], tokens[a][0], tokens[b - 1][1])
                if value:
                    more[k].append((kind, *value))
    out = []
    for own, added in zip(base, more, strict=True):
        free = [s for s in added if not any(s[1] < b[2] and b[1] < s[2] for b in own)]
        out.append((own, sorted(own + free, key=lambda s: (s[1], ALL_KINDS.index(s[0])))))
    return out


def digest(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FOUND = T.StructType(
    [T.StructField(f"n_{k}", T.LongType()) for k in (*ALL_KINDS, "spans")]
    + [T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())]
)
_FOUND_ARROW = pa.struct([(f"n_{k}", pa.int64()) for k in (*ALL_KINDS, "spans")] + [("base", pa.string()), ("spans", pa.string())])


def batches_of(texts, most_texts: int = 256, most_chars: int = 1 << 20):
    """Texts in groups of bounded number and size; a longer text is a group of its own."""
    held, size = [], 0
    for text in texts:
        body = text.as_py() or ""
        if held and (len(held) >= most_texts or size + len(body) > most_chars):
            yield held
            held, size = [], 0
        held.append(body)
        size += len(body)
    if held:
        yield held


def finder():
    """A column function text -> struct of counts by kind and in all, pattern spans and all spans."""
    chain = train()

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for group in batches_of(texts):
            for own, spans in find_all(group, chain):
                counts = {f"n_{kind}": sum(s[0] == kind for s in spans) for kind in ALL_KINDS} | {"n_spans": len(spans)}
                rows.append(counts | {"base": digest(own), "spans": digest(spans)})
        return pa.array(rows, _FOUND_ARROW)

    return find


def find_personal_data(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    return docs.withColumn(out_col, finder()(F.col(f"`{text_col}`")))


def op7(docs: DataFrame) -> DataFrame:
    """Contract digest."""
    found = find_personal_data(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[f"pii.n_{k}" for k in BASE_KINDS],
        F.sha2("pii.base", 256).alias("base_sha256"),
        "pii.spans",
        *[f"pii.n_{k}" for k in (*LABELS[1:], "spans")],
    )
