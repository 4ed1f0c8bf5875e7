"""Secrets: exact patterns, and a character convolutional network over every candidate and what stands around it.

The patterns are the contract's. Candidates are all of their matches, every key-like run of 16 characters or more, every value
after a name such as "password" in four languages, and every password within an address. A network in numpy reads ``BEFORE`` bytes before a
candidate, its head and tail, and ``AFTER`` bytes after it: character embeddings with a part for the region, one convolution, pooling per
region, a hidden layer. It is trained on a table of labelled findings that this module states by rule. A part of the table that is not
trained on calibrates it: logits are scaled to probabilities (Platt), and each form's threshold is the highest that keeps ``RECALL``
of that form's secrets.

Candidates above their threshold that touch no pattern match become spans of kind ``secret``; the patterns' spans stay as they are, and
``n_confirmed`` tells how many of them the network accepts. Everything is per row: no shuffle, memory linear in ``SLICE`` bytes or one text.
Offsets are code points.

Defined results: null texts are empty and hold nothing; repeated rows get equal results; an empty table gives an empty result; other columns
pass through.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASE_KINDS = ("assign", "access", "hex")
ALL_KINDS = (*BASE_KINDS, "secret")
#: Forms of candidates, each with a threshold of its own.
FORMS = (*BASE_KINDS, "key", "value")
#: Share of the labelled secrets of a form that its threshold must keep.
RECALL = 0.97
#: Bytes of text searched at once; whole texts only.
SLICE = 4 << 20

# --- candidates ---------------------------------------------------------------------------------

_ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ASSIGN_NAMES = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_ACCESS, _HEX = re.compile(rb"AKIA[A-Z0-9]+"), re.compile(rb"[0-9a-f]{16,}")
# Names that announce a value.
_NAMES = _ASSIGN_NAMES + tuple(
    n.encode() for n in ("api key", "access key", "access_key", "private_key", "passwort", "kennwort", "contraseña", "clave", "mot de passe", "pwd", "passphrase",
                         "credential", "bearer", "authorization", "client_id")
)
_VALUE = re.compile(
    rb"""[A-Za-z0-9_]{0,24}["'`\])]{0,2}[\x20\t]{0,8}(:?=>?|:|\b(?:is|was|ist|war|lautet|est|es|era)\b|(?=[\x20\t\n]|\x60))\s{0,8}["'`(\[]{0,2}([^\s"'`<>,;]{6,})"""
)
_USER = re.compile(rb"://[^\s/@:\"']{1,64}:([^\s/@\"']{4,})@")
_PIECE = re.compile(rb"[A-Za-z0-9+/_.~-]{16,}={0,2}")
_KEY_CLASS = np.zeros(256, bool)
_KEY_CLASS[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=~-")] = True
_NOT_KEY = re.compile(rb"[^A-Za-z0-9+/_.=~-]")

#: (form, start of the span, end of the span, start of the value, end of the value), in bytes
Candidate = tuple[str, int, int, int, int]


def _places(low: bytes, names: tuple[bytes, ...]) -> list[int]:
    found = set()
    for name in names:
        at = low.find(name)
        while at >= 0:
            found.add(at)
            at = low.find(name, at + 1)
    return sorted(found)


def key_runs(data: bytes, block: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Maximal runs of 16 or more key characters; blocks are cut outside runs."""
    start = 0
    while start < len(data):
        stop = _NOT_KEY.search(data, min(start + block, len(data)))
        end = stop.start() + 1 if stop else len(data)
        inside = np.zeros(end - start + 2, bool)
        inside[1:-1] = _KEY_CLASS[np.frombuffer(data, np.uint8, end - start, start)]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        first, last = edges[::2], edges[1::2]
        long = last - first >= 16
        for a, b in zip((first[long] + start).tolist(), (last[long] + start).tolist(), strict=True):
            yield a, b
        start = end


def candidates(data: bytes) -> list[Candidate]:
    """All candidates of joined texts (a line feed between two); no pattern crosses a line feed but a value may stand on the line after its name."""
    low, found = data.lower(), []
    floor = 0
    for at in _places(low, _ASSIGN_NAMES):
        m = _ASSIGN.match(data, at) if at >= floor else None
        if m:
            floor = m.end()
            if m.end(1) - m.start(1) >= 12:
                found.append(("assign", *m.span(), *m.span(1)))
    for a, b in key_runs(data):
        for m in _ACCESS.finditer(data, a, b):
            if m.end() - m.start() >= 18:
                found.append(("access", *m.span(), *m.span()))
        for m in _HEX.finditer(data, a, b):
            found.append(("hex", *m.span(), *m.span()))
        for m in _PIECE.finditer(data, a, b):
            s, e = m.span()
            while s < e and data[s] in b"./~-":
                s += 1
            while s < e and data[e - 1] in b"./~-":
                e -= 1
            part = data[s:e]
            if e - s >= 16 and not part.isalpha() and any(c in part for c in b"0123456789") and any(65 <= c for c in part):
                found.append(("key", s, e, s, e))
    for at in _places(low, _NAMES):
        name = next(n for n in sorted(_NAMES, key=len, reverse=True) if low.startswith(n, at))
        m = _VALUE.match(data, at + len(name))
        if m:
            s, e = m.span(2)
            while s < e and data[e - 1] in b".,;:!?)]}":
                e -= 1
            if e - s >= 6 and (m[1] or any(c in data[s:e] for c in b"0123456789")):
                found.append(("value", s, e, s, e))
    at = low.find(b"://")
    while at >= 0:
        m = _USER.match(data, at)
        if m:
            found.append(("value", *m.span(1), *m.span(1)))
        at = low.find(b"://", at + 3)
    return found


# --- network ------------------------------------------------------------------------------------

BEFORE, HEAD, TAIL, AFTER = 28, 28, 12, 8
WIDTH = BEFORE + HEAD + TAIL + AFTER
#: Code of each byte: 0 is padding, printable ASCII is itself, 96 is beyond ASCII, 97 other controls.
_CODE = np.array([97 if b < 32 or b == 127 else b - 31 if b < 127 else 96 for b in range(256)], np.int16)
_REGION = np.repeat([0, 1, 1, 2], [BEFORE, HEAD, TAIL, AFTER])
_TAPS, _DIM, _FILTERS, _HIDDEN = 5, 10, 32, 24


def encode(data: bytes, found: list[Candidate]) -> tuple[np.ndarray, np.ndarray]:
    """Character codes (n, WIDTH) and two measures (length, distinct characters) of each candidate."""
    ids, more = np.zeros((len(found), WIDTH), np.int16), np.zeros((len(found), 2), np.float32)
    for row, (_, _, _, s, e) in enumerate(found):
        line = data.rfind(b"\n", max(0, s - BEFORE), s)
        before = data[max(0, s - BEFORE) : s] if line < 0 or s - line < 3 else data[line:s]
        after = data[e : e + AFTER].split(b"\n", 1)[0]
        head, tail = data[s : min(e, s + HEAD)], data[max(s + HEAD, e - TAIL) : e]
        for at, part in ((BEFORE - len(before), before), (BEFORE, head), (BEFORE + HEAD, tail), (WIDTH - AFTER, after)):
            ids[row, at : at + len(part)] = _CODE[np.frombuffer(part, np.uint8)]
        value = head + tail
        more[row] = np.log(e - s) / 4, len(set(value)) / max(1, len(value))
    return ids, more


class Network:
    """Weights and both passes. ``scale`` and ``thresholds`` come from calibration."""

    def __init__(self, seed: int = 3):
        draw = np.random.default_rng(seed)
        init = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {
            "chars": 0.3 * draw.standard_normal((98, _DIM)).astype(np.float32), "regions": 0.3 * draw.standard_normal((3, _DIM)).astype(np.float32),
            "conv": init(_TAPS * _DIM, _FILTERS), "conv0": np.zeros(_FILTERS, np.float32),
            "hidden": init(4 * _FILTERS + 2, _HIDDEN), "hidden0": np.zeros(_HIDDEN, np.float32), "out": init(_HIDDEN, 1), "out0": np.zeros(1, np.float32),
        }
        self.scale, self.thresholds = (1.0, 0.0), dict.fromkeys(FORMS, 0.5)
        centre = _REGION[_TAPS // 2 : WIDTH - _TAPS // 2]
        self.parts = [np.flatnonzero(centre == r) for r in range(3)]

    def forward(self, ids: np.ndarray, more: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        there = (ids > 0)[..., None]
        x = (p["chars"][ids] + p["regions"][_REGION]) * there
        t = WIDTH - _TAPS + 1
        cols = np.concatenate([x[:, k : k + t] for k in range(_TAPS)], 2)
        a = (cols.reshape(-1, _TAPS * _DIM) @ p["conv"]).reshape(len(ids), t, _FILTERS) + p["conv0"]
        a = np.maximum(a, 0) * there[:, _TAPS // 2 : _TAPS // 2 + t]
        tops = [a[:, part].argmax(1) + part[0] for part in self.parts]
        rows, filters = np.arange(len(ids))[:, None], np.arange(_FILTERS)
        size = np.maximum(there[:, self.parts[1] + _TAPS // 2].sum(1), 1).astype(np.float32)
        pooled = np.concatenate([*(a[rows, top, filters] for top in tops), a[:, self.parts[1]].sum(1) / size, more], 1)
        hidden = np.maximum(pooled @ p["hidden"] + p["hidden0"], 0)
        return (hidden @ p["out"] + p["out0"])[:, 0], (ids, there, cols, a, tops, size, pooled, hidden)

    def gradients(self, state: tuple, push: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the parameters for ``push``, those of the logits."""
        ids, there, cols, a, tops, size, pooled, hidden = state
        p, g = self.p, {}
        g["out"], g["out0"] = hidden.T @ push[:, None], push.sum(keepdims=True)
        back = (push[:, None] @ p["out"].T) * (hidden > 0)
        g["hidden"], g["hidden0"] = pooled.T @ back, back.sum(0)
        pool = back @ p["hidden"].T
        da = np.zeros_like(a)
        rows, filters = np.arange(len(ids))[:, None], np.arange(_FILTERS)
        for k, top in enumerate(tops):
            da[rows, top, filters] += pool[:, k * _FILTERS : (k + 1) * _FILTERS]
        da[:, self.parts[1]] += (pool[:, 3 * _FILTERS : 4 * _FILTERS] / size)[:, None]
        da *= a > 0
        flat = da.reshape(-1, _FILTERS)
        g["conv"], g["conv0"] = cols.reshape(-1, _TAPS * _DIM).T @ flat, flat.sum(0)
        dcols, dx = (flat @ p["conv"].T).reshape(cols.shape), np.zeros((*ids.shape, _DIM), np.float32)
        for k in range(_TAPS):
            dx[:, k : k + da.shape[1]] += dcols[..., k * _DIM : (k + 1) * _DIM]
        dx *= there
        g["regions"] = np.stack([dx[:, _REGION == r].sum((0, 1)) for r in range(3)])
        order = ids.ravel().astype(np.int64)
        g["chars"] = np.stack([np.bincount(order, dx[..., d].ravel(), 98) for d in range(_DIM)], 1)
        return g

    def fit(self, ids: np.ndarray, more: np.ndarray, gold: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 6e-3, decay: float = 1e-4, seed: int = 5) -> None:
        """Logistic loss by Adam in shuffled batches; characters of the value are hidden now and then, so that no single one decides."""
        draw, step = np.random.default_rng(seed), 0
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        for epoch in range(epochs):
            order = draw.permutation(len(ids))
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                some = ids[at] * (draw.random((len(at), WIDTH)) > 0.04)
                logits, state = self.forward(some, more[at])
                push = (1 / (1 + np.exp(-logits)) - gold[at]).astype(np.float32) / len(at)
                step += 1
                now = rate * (1 - epoch / epochs)
                for name, grad in self.gradients(state, push).items():
                    grad = grad + decay * self.p[name]
                    first, second = moments[name]
                    first += 0.1 * (grad - first)
                    second += 0.01 * (grad * grad - second)
                    self.p[name] -= (now * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def calibrate(self, ids: np.ndarray, more: np.ndarray, gold: np.ndarray, forms: np.ndarray, recall: float) -> None:
        """Platt scaling by Newton's method, then per form the highest threshold that keeps ``recall`` of its secrets."""
        logits, _ = self.forward(ids, more)
        x = np.stack([logits, np.ones_like(logits)], 1).astype(np.float64)
        w, aim = np.array([1.0, 0.0]), np.where(gold > 0, 1 - 1 / (gold.sum() + 2), 1 / ((1 - gold).sum() + 2))
        for _ in range(20):
            prob = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            curve = (x * (prob * (1 - prob))[:, None]).T @ x + 1e-3 * np.eye(2)
            w = w - np.linalg.solve(curve, x.T @ (prob - aim) + 1e-3 * (w - [1.0, 0.0]))
        self.scale = (float(w[0]), float(w[1]))
        prob = self.probabilities(ids, more)
        for k, form in enumerate(FORMS):
            held = np.sort(prob[(forms == k) & (gold > 0)])
            if len(held):
                self.thresholds[form] = float(held[int((1 - recall) * len(held))])

    def probabilities(self, ids: np.ndarray, more: np.ndarray, block: int = 512) -> np.ndarray:
        out = [self.forward(ids[k : k + block], more[k : k + block])[0] for k in range(0, len(ids), block)]
        logits = np.concatenate([*out, np.zeros(0, np.float32)]).astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -30, 30)))


# --- labelled findings --------------------------------------------------------------------------

# Words of which the table's prose, names and paths are made.
WORDS = (
    "the of and to in is that for with on as are this be at or from by report house garden water letter system network number people little morning open between market "
    "server request response handler config module version update build release branch feature default content image upload download account user manager service index "
    "le la les des une pour dans qui sur avec maison jardin lettre réseau ouvrir entre marché serveur demande mise jour utilisateur compte fichier erreur toujours demain "
    "der die und das nicht mit von auf für werden haus garten wasser brief netzwerk zwischen Verwaltung Bestellung Fehler Datei Benutzer Anmeldung immer morgen wegen "
    "el los una para con por casa jardín agua carta sistema red número gente entre mercado servidor usuario cuenta archivo siempre mañana error desde cuando donde"
).split()
_LETTERS, _DIGITS, _HEXES = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
_MIXED = _LETTERS + _LETTERS.upper() + _DIGITS


class _Draw:
    """Fixed pseudo-random choices, so that the table is the same everywhere."""

    def __init__(self, seed: int):
        self.draw = np.random.default_rng(seed)

    def below(self, n: int) -> int:
        return int(self.draw.integers(n))

    def of(self, values):
        return values[self.below(len(values))]

    def text(self, letters: str, n: int) -> str:
        return "".join(letters[k] for k in self.draw.integers(len(letters), size=n))

    def prose(self, n: int) -> str:
        return " ".join(self.of(WORDS) for _ in range(n))


def _secret_key(d: _Draw) -> str:
    """A machine-made key."""
    return [
        lambda: d.text(_MIXED, d.of((20, 24, 32, 40, 64))),
        lambda: d.text(_MIXED + "+/", d.of((22, 40, 43, 86))) + d.of(("", "=", "==")),
        lambda: d.text(_MIXED + "-_", d.of((22, 32, 43))),
        lambda: f"eyJ{d.text(_MIXED, 17 + d.below(12))}.eyJ{d.text(_MIXED, 30 + d.below(40))}.{d.text(_MIXED + '-_', 43)}",
        lambda: d.of(("ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_test_", "sk-proj-", "xoxb-", "npm_", "hf_", "AIza", "shpat_", "SG.")) + d.text(_MIXED, d.of((20, 24, 36, 40))),
        lambda: f"xoxb-{d.text(_DIGITS, 12)}-{d.text(_DIGITS, 12)}-{d.text(_MIXED, 24)}",
        lambda: d.text(_LETTERS.upper() + _DIGITS, d.of((20, 26, 32))),
    ][d.below(7)]()


def _hex_key(d: _Draw) -> str:
    return d.text(_HEXES, d.of((16, 24, 32, 32, 40, 48, 64)))


def _password(d: _Draw) -> str:
    word = lambda: d.of([w for w in WORDS if w.isascii() and len(w) > 3])
    return [
        lambda: d.of((word(), word().title())) + d.text(_DIGITS, 1 + d.below(4)) + d.of(("", "", "!", "?x", "#", "$")),
        lambda: word().translate(str.maketrans("aeios", "43105")) + d.text(_DIGITS, 2) + d.of(("!", "", "%", "_")),
        lambda: d.text(_MIXED + "!#$%&*+-@^", 8 + d.below(10)),
        lambda: f"{word().title()}{word().title()}{d.text(_DIGITS, 1 + d.below(4))}{d.of(('', '!'))}",
        lambda: d.text(_LETTERS, 6) + d.text(_DIGITS, 3) + d.text(_LETTERS.upper(), 2),
    ][d.below(5)]()


def _harmless_key(d: _Draw) -> str:
    """A key-like run that is no secret: names, paths, addresses, versions, dates, identifiers."""
    word = lambda: d.of([w for w in WORDS if w.isascii()]).lower()
    n = d.text(_DIGITS, 1 + d.below(4))
    return [
        lambda: f"{word()}_{word()}_{word()}_{n}",
        lambda: f"{word()}{word().title()}{word().title()}{n}",
        lambda: f"/{word()}/{word()}/{word()}-{n}.{d.of(('html', 'py', 'json', 'png', 'tar.gz', 'js'))}",
        lambda: f"{word()}-{word()}.{d.of(('example.com', 'example.org', 'internal.net'))}/{word()}/{n}",
        lambda: f"{word()}{n}.{word()}.{d.of(('com', 'org', 'net', 'fr', 'de', 'es'))}",
        lambda: f"20{d.text(_DIGITS, 2)}-{d.of(('01', '07', '11'))}-{d.of(('03', '14', '28'))}T{d.of(('09', '17'))}-{d.text(_DIGITS, 2)}-{d.text(_DIGITS, 2)}Z",
        lambda: f"{word()}-{n}.{d.text(_DIGITS, 1)}.{d.text(_DIGITS, 2)}-{d.of(('linux', 'beta', 'snapshot', 'rc', 'win'))}-{d.of(('x86_64', 'amd64', 'arm64'))}",
        lambda: "-".join(d.text(_HEXES, k) for k in (8, 4, 4, 4, 12)),
        lambda: f"com.{word()}.{word()}.{word().title()}{word().title()}{n}",
        lambda: f"{word()}-{word()}-{word()}-{word()}-{n}",
        lambda: f"{word().upper()}_{word().upper()}_{word().upper()}_{n}",
        lambda: f"{word()}.{word()}.{word()}={n}{word()}",
        lambda: f"{word()}{n}/{word()}/{word()}/{word()}",
    ][d.below(13)]()


# What stands around a value in the table; @ is the value.
_NAMED = (
    'NAME = "@"', "NAME=@", "NAME: @", "'NAME': '@',", '"NAME": "@"', "export NAME=@", "NAME := @", "my NAME is @", "the NAME was @ ,", "NAME is `@` .", "le NAME est @ .", "das NAME lautet @ ,", "el NAME es @ .",
    "NAME:\n@", "set NAME to '@'", "Authorization: Bearer @", "-H 'Authorization: token @'", "NAME @ ;", "?NAME=@&x=1", "<NAME>@</NAME>", "--NAME=@", "--NAME @", "NAME ( @ )",
)
_SECRET_NAMES = (
    "password", "passwd", "secret", "token", "api_key", "apikey", "API_KEY", "PASSWORD", "SECRET_KEY", "AUTH_TOKEN", "client_secret", "AWS_SECRET_ACCESS_KEY", "access_key", "db_password", "Passwort", "Kennwort",
    "contraseña", "clave", "mot de passe", "pwd", "passphrase", "private_key", "Token", "Secret", "user password", "api key",
)
_BARE = ("use @ here", "see @ .", "with @ please", "@", "key @", "(@)", "took @ from the log", "curl -u @:", "login with @ now", "and @ too")
_DIGESTS = (
    "commit @", "sha256:@", "sha256 @", "md5: @", "SHA1 (@)", "etag @", "integrity sha512-@", "checksum @", "revision @", "git show @", "hash @", "digest: @", "ETag: \"@\"", "index @", "build @", "sha1sum @",
    "fingerprint @", "object @", "Prüfsumme @", "empreinte @", "blob @", "data:image/png;base64,@", "request id @", "trace_id=@", "session id @", "uuid @", "cache/@.bin",
)
_MENTIONS = (
    "the NAME is @", "NAME: @", "NAME = @", "your NAME @ here", "a NAME of @ letters", "NAME est @", "NAME ist @", "el NAME es @", "NAME is a @", "NAME=@", 'NAME: "@"', "NAME := @", "--NAME @",
)
_HOLLOW = (
    "required", "changeme-please", "${PASSWORD}", "{{ token }}", "<your-token-here>", "your_api_key_here", "xxxxxxxxxxxxxxxx", "****************", "undefined", "string", "os.environ", "process.env.TOKEN", "config.get", "forgotten",
    "strong enough", "optional", "obligatoire", "erforderlich", "obligatorio", "invalid", "getPassword()", "self.password", "example", "placeholder", "missing", "important", "not here", "None", "nullptr", "............", "request.headers",
    "length", "verschlüsselt", "oublié", "olvidada", "expired", "your-password", "$SECRET_TOKEN", "%PASSWORD%", "vault.read", "settings.SECRET_KEY", "input.value", "REDACTED", "0000000000000000", "secret.token.value", "hidden_from_logs",
)


def labelled_findings(n: int = 4800, seed: int = 11) -> list[tuple[str, str, bool]]:
    """(text, value, whether it is a secret): ``n`` findings by rule, half of them secrets."""
    d, rows = _Draw(seed), []
    for k in range(n):
        kind = k % 12
        if kind < 6:
            gold = True
            value = _password(d) if kind < 2 else _hex_key(d) if kind == 2 else "AKIA" + d.text(_LETTERS.upper() + _DIGITS, 16) if kind == 3 and d.below(3) == 0 else _secret_key(d)
            frame = d.of(_BARE) if kind == 5 else d.of(_NAMED).replace("NAME", d.of(_SECRET_NAMES))
            if kind == 1 and d.below(3) == 0:
                frame = f"{d.of(('postgres', 'mysql', 'amqp', 'https', 'redis'))}://{d.of(WORDS)}:@@@{d.of(WORDS)}.internal:5432/db".replace("@@@", "@\0")
        else:
            gold = False
            if kind in (6, 7):
                value, frame = (d.of((_hex_key, _hex_key, _secret_key))(d), d.of(_DIGESTS))
                if d.below(2):
                    value = d.text(_HEXES, d.of((32, 40, 64))) if "sha512" not in frame and "base64" not in frame else d.text(_MIXED + "+/", 64)
            elif kind in (8, 9):
                value, frame = _harmless_key(d), d.of(("@", "see @", "in @ ,", "file @ .", "https://@", "import @", "<a href='@'>", "at @ .", "host @", "(@)", "name: @", "url = \"@\"", "id=@"))
            elif kind == 10:
                value, frame = d.of((d.of(_HOLLOW), d.of(_HOLLOW), d.of(WORDS), f"{d.of(WORDS)}.{d.of(WORDS)}", _harmless_key(d))), d.of(_MENTIONS).replace("NAME", d.of(_SECRET_NAMES))
            else:
                value, frame = d.text(d.of((_DIGITS, "0", "abcdefghijklmnopqrstuvwxyz", "-", "ACGT", "=")), 16 + d.below(20)) + d.of(("a1", "x0", "9z")), d.of(("@", "code @", "total @ ,", "seq @", "line @"))
        before, after = frame.split("@", 1) if "\0" not in frame else (frame.split("@\0")[0], "@" + frame.split("@\0")[1])
        if d.below(3):
            before, after = f"{d.prose(1 + d.below(6))}{d.of((' ', ' ', chr(10), '; ', '*** '))}{before}", f"{after}{d.of((' ', '.', chr(10), '***', ', '))}{d.prose(1 + d.below(4))}"
        rows.append((before + value + after, value, gold))
    return rows


def labelled_candidates(rows: list[tuple[str, str, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, measures, label, form) of all candidates of the rows; one is a secret if its value holds, or is held by, the row's."""
    ids, more, gold, forms = [], [], [], []
    for text, value, secret in rows:
        data, wanted = text.encode(), value.encode()
        at = data.find(wanted)
        found = candidates(data)
        if found:
            a, b = encode(data, found)
            ids.append(a)
            more.append(b)
            gold += [secret and s < at + len(wanted) and at < e for *_, s, e in found]
            forms += [FORMS.index(c[0]) for c in found]
    return np.concatenate(ids), np.concatenate(more), np.array(gold, np.float32), np.array(forms)


@lru_cache(maxsize=1)
def train(recall: float = RECALL) -> Network:
    """Fit on four fifths of the labelled findings, calibrate and set thresholds on the fifth that is left."""
    rows = labelled_findings()
    network = Network()
    network.fit(*labelled_candidates([r for k, r in enumerate(rows) if (k // 12) % 5])[:3])
    network.calibrate(*labelled_candidates([r for k, r in enumerate(rows) if not (k // 12) % 5]), recall)
    return network


def trained(spark: SparkSession) -> Network:
    """The network, trained in a task: there BLAS keeps to the task's cores and the driver is spared. Its weights are some 40 KB."""

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"network": pa.array([pickle.dumps(train())], pa.binary())})

    return pickle.loads(bytes(spark.range(0, 1, 1, 1).mapInArrow(fit, "network binary").first()["network"]))


# --- scan ---------------------------------------------------------------------------------------


def scan(texts: list[bytes], network: Network) -> list[tuple[list[tuple], list[tuple], int]]:
    """(pattern spans, all spans, confirmed pattern spans) of each text; spans are (kind, start, end) in code points."""
    data = b"\n".join(texts)
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    found = candidates(data)
    home = np.searchsorted(starts, [c[1] for c in found], "right") - 1
    found = [c for c, h in zip(found, home, strict=True) if c[2] < starts[h + 1]]  # not across two texts
    prob = network.probabilities(*encode(data, found)) if found else np.zeros(0)
    kept: dict[int, tuple[list, list]] = {}
    for c, p in zip(found, prob.tolist(), strict=True):
        accepted = p >= network.thresholds[c[0]]
        own, more = kept.setdefault(int(np.searchsorted(starts, c[1], "right")) - 1, ([], []))
        if c[0] in BASE_KINDS:
            own.append((c[0], c[1], c[2], accepted))
        elif accepted:
            more.append(("secret", c[1], c[2], True))
    # code points before each place: sums between neighbouring places
    places = np.unique([0, *(starts[k] for k in kept), *(x for own, more in kept.values() for s in own + more for x in s[1:3])]).astype(np.int64)
    lead = np.append((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, True)
    points = dict(zip(places.tolist(), np.r_[0, np.cumsum(np.add.reduceat(lead, places, dtype=np.int64))[:-1]].tolist(), strict=True))
    out = []
    for k in range(len(texts)):
        own, more = kept.get(k, ([], []))
        zero = points[int(starts[k])] if k in kept else 0
        free, reach = [], -1
        for s in sorted(more, key=lambda s: (s[1], -s[2])):
            if s[1] >= reach and not any(s[1] < b[2] and b[1] < s[2] for b in own):
                free.append(s)
                reach = s[2]
        place = lambda spans: sorted(((s[0], points[s[1]] - zero, points[s[2]] - zero) for s in spans), key=lambda s: (s[1], ALL_KINDS.index(s[0])))  # noqa: B023, E731
        out.append((place(own), place(own + free), sum(s[3] for s in own)))
    return out


def digest(spans: list[tuple]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


_FIELDS = (*(f"n_{k}" for k in ALL_KINDS), "n_confirmed")
_FOUND = T.StructType([*(T.StructField(f, T.LongType()) for f in _FIELDS), T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])
_FOUND_ARROW = pa.struct([*((f, pa.int64()) for f in _FIELDS), ("base", pa.string()), ("spans", pa.string())])


def finder(network: Network, slice_bytes: int = SLICE):
    """A column function binary text -> struct of counts by kind, confirmed ones, pattern spans and all spans."""

    @F.arrow_udf(_FOUND)
    def find(texts: pa.Array) -> pa.Array:
        rows, held, size = [], [], 0

        def run() -> None:
            for own, spans, confirmed in scan(held, network):
                counts = {f"n_{kind}": sum(s[0] == kind for s in spans) for kind in ALL_KINDS}
                rows.append(counts | {"n_confirmed": confirmed, "base": digest(own), "spans": digest(spans)})
            held.clear()

        for text in texts:
            held.append(text.as_py() or b"")
            size += len(held[-1])
            if size >= slice_bytes:
                run()
                size = 0
        if held:
            run()
        return pa.array(rows, _FOUND_ARROW)

    return find


def find_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "secrets") -> DataFrame:
    return docs.withColumn(out_col, finder(trained(docs.sparkSession))(F.col(f"`{text_col}`").cast("binary")))


def op11(docs: DataFrame) -> DataFrame:
    """Contract digest."""
    found = find_secrets(docs.select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[f"secrets.n_{k}" for k in BASE_KINDS],
        F.sha2("secrets.base", 256).alias("base_sha256"),
        "secrets.spans",
        "secrets.n_secret",
        "secrets.n_confirmed",
    )
