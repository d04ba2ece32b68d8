"""Secret scan: fixed patterns plus a linear-chain conditional random field.

Tokens are runs of characters between blanks, quotes, brackets and the signs
that assign, and those signs. The field tags each token of each line of every
text as secret begin (B), inside (I) or outside (O) from its shape, the
neighbouring words and features of the whole file; Viterbi decodes. Tokens
that no path better than all O can tag are found first, from upper bounds of
what each token gains by a tag (``Bounds``), by NumPy passes over about a
million characters at a time; decoding the stretches between them, with O at
both ends, equals decoding whole lines.

The weights are fitted here by maximum likelihood (forward-backward, Adam) on
a generated set of labelled lines of fixed seed and size, on the driver, and
shipped as a table of a few thousand numbers. The scan is one narrow map.

Defined results: a null text is empty; an empty text has no spans and the
digest of the empty string; long texts are scanned whole; repeated rows each
get theirs; spans are code points, end exclusive, ordered by start and then by
kind as listed in ``KINDS``. What a pattern's span covers is taken out of the
tagged spans, the rest of them and the pattern's stay. An empty table gives an
empty result. Columns other than id and text pass through ``redact`` untouched
(but ``n_chars``, where there is one, follows the text).
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidelog.llm.shared import pick
from tidelog.llm.words import U64, Rule, Words, mix, steps

KINDS = ("assign", "access", "hex", "crf")
# The three patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16}

ABLE_LENGTH = 12
_ABLE = re.compile(r"[A-Za-z0-9+/_.=\-]{12,}")
_VOWELS = "aeiouAEIOUáéíóúäöüàèù"
#: Edges of the buckets of a token's entropy in bits and of its share of vowels.
_ENTROPY, _VOWEL_SHARE = (1.5, 2, 2.5, 3, 3.5, 4, 4.5), (0.1, 0.2, 0.3, 0.4)
#: Marks that may end a plain word, ascending.
_MARKS = "!.?"
_MARK_CODES = np.array([*map(ord, _MARKS)], np.uint16)
#: Characters of texts that are read at once.
BLOCK = 1 << 20
_TOKEN = re.compile(r"""[^\s=:,;"'`()\[\]{}<>]+(?:={1,2}(?![^\s"'`,;)\]}>]))?|[=:,;"'`()\[\]{}<>]""")
_LETTER, _DIGIT = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]")
_KEY_BYTES = np.zeros(256, bool)
_KEY_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_.=-"]] = True
_RUNS = Rule(_KEY_BYTES, False)
REDACTED = "[REDACTED]"
#: Words after which a secret may follow, in four languages: inside of names, and as words of their own.
CUES = ("password", "passwd", "passphrase", "passcode", "secret", "token", "apikey", "credential", "authorization", "bearer", "passwort", "kennwort", "contraseña", "mot de passe", "schlüssel", "jeton")
SHORT_CUES = ("pwd", "pin", "key", "auth", "login", "pass", "clave", "basic", "otp", "psk")
_CUE = re.compile(rf"{'|'.join(CUES)}|(?<![^\W\d_])(?:{'|'.join(SHORT_CUES)})(?![^\W\d_])", re.IGNORECASE)
#: Tokens after a cue, and on both sides of a key-like run, of a likely stretch.
REACH, AROUND = 10, 2


def able(token: str) -> bool:
    return len(token) >= ABLE_LENGTH and bool(_LETTER.search(token)) and bool(_DIGIT.search(token))


def _bucket(x: float, *edges: float) -> int:
    return sum(x >= e for e in edges)


@lru_cache(maxsize=1 << 16)
def _word(token: str) -> str:
    """A neighbour: cues and short lower-case words as they are, others by kind."""
    if len(token) == 1 and not token.isalnum():
        return token
    if cue := _CUE.search(token):
        return f"cue:{cue.group().lower()}" if len(cue.group()) == len(token) else "cue"
    if token.isalpha() and len(token) <= 12:
        return token.lower()
    return "#" if token.isdigit() else "key" if able(token) else "other"


@lru_cache(maxsize=1 << 16)
def _shape(token: str) -> tuple[str, ...]:
    n = len(token)
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "s" for c in token]
    counts = {k: kinds.count(k) for k in "duls"}
    entropy = -sum(c / n * math.log2(c / n) for c in (token.count(x) for x in set(token)))
    vowels = sum(c in _VOWELS for c in token) / n
    switches = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / n
    case = sum(a + b == "lu" for a, b in zip(kinds, kinds[1:], strict=False))
    ending = token.rpartition(".")[2].lower() if "." in token and len(token.rpartition(".")[2]) <= 5 else ""
    return (
        "bias", f"len:{_bucket(n, 2, 4, 6, 8, 10, 12, 16, 20, 24, 32, 40, 64)}", "kinds:" + "".join(k for k in "duls" if counts[k]),
        f"digits:{_bucket(counts['d'] / n, 0.01, 0.1, 0.2, 0.35, 0.6, 0.9, 1)}", f"entropy:{_bucket(entropy, *_ENTROPY)}", f"vowels:{_bucket(vowels, *_VOWEL_SHARE)}:{counts['d'] > 0}",
        f"switches:{_bucket(switches, 0.05, 0.1, 0.2, 0.35, 0.5)}", f"case:{min(case, 3)}", f"dots:{min(3, token.count('.'))}", f"dashes:{min(4, token.count('-'))}", f"slashes:{min(3, token.count('/'))}",
        f"marks:{min(2, sum(c in '!@#$%^&*~?|' for c in token))}", f"hex:{bool(re.fullmatch(r'[0-9a-f]+', token))}", f"uuid:{[len(x) for x in token.split('-')] == [8, 4, 4, 4, 12]}", f"tail:{ending}",
        f"eq:{token.endswith('=')}", f"at:{bool(re.fullmatch(r'[^@]+@[^@]+[.][a-z]+', token))}", f"word:{token.lower() if token.isalpha() and n <= 10 else ''}", f"head:{token[:3].lower() if n > 6 and token[:2].isalpha() else ''}", f"cue:{bool(_CUE.search(token))}",
    )


def features(words: list[str], i: int, file: tuple[str, ...]) -> list[str]:
    """Active features of word i of a line: shape, neighbouring words, file."""
    shape = _shape(words[i])
    past = [_word(t) for t in words[max(0, i - 4) : i]][::-1] + ["^"]
    out = list(shape)
    out += [f"p{k + 1}:{t}" for k, t in enumerate(past[:4])]
    cue = next((k for k, t in enumerate(past) if t.startswith("cue")), 9)
    signs = "".join(t for t in past[:cue] if len(t) == 1 and not t.isalnum())[::-1]
    out += [f"cue@{cue}:{signs}", f"cue:{cue < 9}:{shape[1]}", f"cue:{cue < 9}:{shape[2]}", f"signs:{signs if cue < 9 else ''}:{shape[2]}"]
    out += [f"n{k + 1}:{t}" for k, t in enumerate(([_word(t) for t in words[i + 1 : i + 3]] + ["$"])[:2])]
    return out + [f"file:{f}" for f in file] + [f"p1len:{past[0]}:{_bucket(len(words[i]), 6, 10, 20, 32)}"]


def file_features(text: str) -> tuple[str, ...]:
    """What the whole file looks like: share of lines that assign, and of symbols."""
    lines = text.count("\n") + 1
    return (f"assigns{_bucket((text.count('=') + text.count(': ')) / lines, 0.2, 0.6)}", f"braces{_bucket(sum(map(text.count, '{}();<>')) / (len(text) + 1), 0.01, 0.05)}")


# ---- training ---------------------------------------------------------------

#: Kinds of generated lines. Any can be held out to measure what the field makes of a style it has not seen.
STYLES = ("assign", "header", "prose", "two", "phrase", "short", "url", "plain-assign", "plain-prose", "plain-cue", "plain-digest", "plain-lines")


def _lines(seed: int, n: int, styles: tuple[str, ...] = STYLES):
    """Labelled lines: the text with each secret between \x02 and \x03, and the file features."""
    rng = np.random.default_rng(seed)
    pick_ = lambda xs: xs[int(rng.integers(len(xs)))]
    low, digits, marks = "abcdefghijklmnopqrstuvwxyz", "0123456789", "!@#$%^&*~?"
    chars = lambda a, k: "".join(a[i] for i in rng.integers(0, len(a), k))
    word = lambda: "".join(pick_(["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ti", "st", "ar", "te", "se", "al", "le", "ment", "que", "ung", "ción"]) for _ in range(int(rng.integers(1, 5))))
    prose = lambda k: " ".join(word() for _ in range(k))
    mixed, upper = low + low.upper() + digits, low.upper()
    hexes = "0123456789abcdef"
    long = [
        lambda: chars(mixed, int(rng.integers(16, 48))), lambda: chars(mixed + "+/", 40), lambda: chars(hexes, int(rng.integers(20, 64))), lambda: chars(low + upper, int(rng.integers(16, 40))), lambda: chars(upper + digits, int(rng.integers(16, 32))),
        lambda: "ghp_" + chars(mixed, 36), lambda: "sk-" + chars(mixed, 40), lambda: "eyJ" + chars(mixed, 30) + "." + chars(mixed + "-_", 40), lambda: chars(mixed + "+/", 42) + "==", lambda: "xoxb-" + chars(digits, 11) + "-" + chars(mixed, 24),
    ]
    short = [
        lambda: word() + chars(digits, int(rng.integers(1, 5))) + chars(low, int(rng.integers(0, 3))), lambda: word().title().replace("a", "@").replace("o", "0") + pick_(marks) + chars(digits, int(rng.integers(1, 5))), lambda: chars(mixed + marks, int(rng.integers(8, 14))), lambda: chars(low + upper, int(rng.integers(8, 12))),
        lambda: chars(low, int(rng.integers(7, 11))) + chars(digits, 2), lambda: word().title() + word().title() + chars(digits, int(rng.integers(1, 4))) + pick_(marks), lambda: chars(digits, int(rng.integers(4, 9))), lambda: f"{word()}-{word()}-{chars(digits, 2)}",
    ]
    plain = [
        lambda: f"{word()}.{chars(digits, 2)}@mail{chars(digits, 1)}.example.com", lambda: f"www{chars(digits, 1)}.{word()}.{pick_(['com', 'org', 'net', 'io', 'de'])}/{word()}/{word()}{chars(digits, 2)}.html",
        lambda: f"{word()}_{word()}_{chars(digits, 2)}.{pick_(['py', 'txt', 'csv', 'json', 'tar.gz', 'log', 'png', 'pem'])}", lambda: f"20{chars(digits, 2)}-0{chars('123456789', 1)}-1{chars(digits, 1)}T1{chars(digits, 1)}:00:00Z", lambda: f"{word()}-{word()}-{chars('0123456789', 1)}.{chars(digits, 1)}.{chars(digits, 2)}",
        lambda: f"{word()}{word().title()}{word().title()}{chars(digits, 1)}", lambda: f"{word()}/{word()}/v{chars(digits, 1)}/{word()}", lambda: f"{chars(digits, 3)}.{chars(digits, 2)}.{chars(digits, 3)}.{chars(digits, 2)}", lambda: f"{word()}=====2=====", lambda: f"{word()}...{word()}2{word()}", lambda: f"-{chars(digits, 4)}-{word()}-{chars(digits, 2)}-{word()}",
    ]
    digest = [
        lambda: f"commit {chars(hexes, pick_([7, 28]))}", lambda: f"integrity sha512-{chars(mixed + '+/', 86)}==", lambda: f'"integrity": "sha{pick_(["256", "384"])}-{chars(mixed + "+/", 43)}="', lambda: f"md5 {chars(hexes, 30)}", lambda: f"id: {chars(hexes, 8)}-{chars(hexes, 4)}-{chars(hexes, 4)}-{chars(hexes, 4)}-{chars(hexes, 12)}",
        lambda: f"checksum = {chars(hexes, 28)}", lambda: f"data:image/png;base64,iVBOR{chars(mixed + '+/', 60)}", lambda: f"digest: sha256:{chars(hexes, 30)}", lambda: f"color: #{chars(hexes, 6)}", lambda: f"etag: W/{chars(hexes, 12)}", lambda: f"requestId={chars(hexes, 8)}-{chars(hexes, 4)}-{chars(hexes, 4)}-{chars(hexes, 4)}-{chars(hexes, 12)}",
    ]
    names = ["AWS_SECRET_ACCESS_KEY", "aws_secret_access_key", "client_secret", "auth", "Authorization", "private_key", "credentials", "access_token", "SECRET_KEY", "key", "pwd", "passphrase", "signing_key", "DB_PASSWORD", "dbPassword", "api-key", "login", "MYSQL_PWD", "PIN", "contraseña", "Passwort", "auth_key"]
    said = ["password", "token", "secret", "key", "pwd", "pin", "passcode", "passphrase", "Passwort", "clave", "mot de passe", "contraseña", "login", "Kennwort"]
    harmless = ["version", "path", "file", "url", "host", "image", "name", "id", "email", "date", "commit", "class", "build", "user", "port"]
    values = ["none", "null", "true", "false", "required", "optional", "changeme", "string", "str", "os.environ", "getenv", "value", "None", "***", "xxxx", "expired", "invalid", "yes", "no", "file", "enabled", "disabled"]
    quote = lambda x: (lambda q: f"{q}{x}{q}")(pick_(["", "", '"', "'"]))
    for _ in range(n):
        style, mark = pick_(styles), lambda s: f"\x02{s}\x03"
        secret = lambda: pick_(long)() if rng.random() < 0.55 else pick_(short)()
        if style == "assign":
            text = f"{pick_(['', '', 'export ', '  '])}{pick_(names)}{pick_([' = ', '=', ': ', ' := ', ' => '])}{quote(mark(secret()))}{pick_(['', '', ';', ','])}"
        elif style == "header":
            text = f"{pick_(['auth', 'Authorization', 'X-Auth', 'header', 'curl -H Authorization'])}: {pick_(['Bearer ', 'Basic ', 'token ', 'Bearer '])}{mark(pick_(long)())}"
        elif style == "prose":
            text = f"{prose(int(rng.integers(1, 5)))} {pick_(said)} {pick_(['is', 'was', '->', ':', 'ist', 'es', 'est', 'is now'])} {quote(mark(secret()))}{pick_(['', '.', ','])} {prose(3)}"
        elif style == "two":
            text = f"{pick_(names)} = {mark(pick_(long[:5])())} {mark(pick_(long[:5])())}"
        elif style == "phrase":
            text = f'{pick_(["passphrase", "pass", "passcode"])}: "{mark(prose(int(rng.integers(3, 5))))}"'
        elif style == "short":
            text = f"{pick_(['pwd', 'PIN', 'password', 'login', 'pass', 'Passwort', 'clave', 'passcode', 'otp'])}: {quote(mark(pick_(short)()))}{pick_(['', '', ' ' + prose(2)])}"
        elif style == "url":
            text = f"{pick_(['https', 'http'])}://{word()}.example.com/{word()}?{word()}={chars(digits, 2)}&{pick_(['token', 'key', 'auth', 'apikey'])}={mark(pick_(long[:5])())}"
        elif style == "plain-assign":
            text = f"{pick_(harmless)} {pick_(['=', ':'])} {quote(pick_(plain)())}"
        elif style == "plain-prose":
            text = f"{prose(int(rng.integers(2, 6)))} {pick_(plain)()}{pick_([' ', ', ', '. '])}{pick_(['', pick_(plain)() + ' '])}{prose(4)}"
        elif style == "plain-cue":
            text = pick_([
                lambda: f"{prose(3)} the {pick_(said)} {pick_(['of', 'to', 'for', 'and', 'is', 'was', 'in', 'page', 'field', 'idea'])} {prose(6)}", lambda: f"{pick_(names + said)}{pick_([' = ', ': ', '='])}{quote(pick_(values))}", lambda: f"{pick_(said)}: {prose(5)}", lambda: f"{prose(2)} {pick_(said)}, {prose(5)}",
                lambda: f"{pick_(said)} = {word()}.{word()}({word()})", lambda: f"{pick_(names)}: ${{{word().upper()}_{word().upper()}}}", lambda: f"{pick_(said)}: {word()}/{word()}.{pick_(['txt', 'pem', 'json'])}", lambda: f"the {pick_(said)} was {pick_(['sent', 'lost', 'found', 'changed', 'not'])} {prose(3)} {chars(digits, 2)} {prose(2)}", lambda: f"{pick_(said)} length: {chars(digits, 2)}, {prose(3)}",
                lambda: f"{prose(1)} {pick_(said)} {prose(4)} {pick_(plain)()} {prose(2)}", lambda: f"{prose(2)} {pick_(said)}. {prose(1).title()} {prose(5)}",
            ])()
        elif style == "plain-digest":
            text = f"{pick_(['', prose(2) + ' '])}{pick_(digest)()}{pick_(['', ' ' + prose(2)])}"
        else:
            text = f"{prose(2)}, {pick_(plain)()}. {prose(5)}"
        config = rng.random() < (0.6 if style in ("assign", "header", "two", "short", "plain-assign", "plain-digest") else 0.2)
        yield text, (f"assigns{2 if config else int(rng.integers(0, 2))}", f"braces{int(rng.integers(0, 3))}")


def _runs(text: str):
    """Stretches where secrets are likeliest (after cues, around key-like runs), as (tokens of the line as (start, end), their words, first and end of the stretch)."""
    marks = [(m.start(), m.end(), False) for m in _CUE.finditer(text)] + [(m.start(), m.end(), True) for m in _ABLE.finditer(text) if able(m.group())]
    marks.sort()
    i = 0
    while i < len(marks):
        line, end = text.rfind("\n", 0, marks[i][0]) + 1, text.find("\n", marks[i][0])
        end = len(text) if end < 0 else end
        spans = [m.span() for m in _TOKEN.finditer(text, line, end)]
        starts, ends = [a for a, _ in spans], [b for _, b in spans]
        words, run = [text[a:b] for a, b in spans], None
        while i < len(marks) and marks[i][0] <= end:
            start, stop, key = marks[i]
            first, last = bisect_right(ends, start), bisect_left(starts, stop)
            first, last = (max(0, first - AROUND), last + AROUND) if key else (first, last + REACH)
            last = min(last, len(spans))
            if run and first <= run[1]:
                run[1] = max(run[1], last)
            else:
                if run:
                    yield spans, words, *run
                run = [first, last]
            i += 1
        if run and run[1] > run[0]:
            yield spans, words, *run


class Field:
    """Weights of a fitted field: of each feature for O, B and I, and of the transitions."""

    def __init__(self, index: dict[str, int], weight: np.ndarray, move: np.ndarray):
        self.weight = {f: tuple(weight[i]) for f, i in index.items()}
        self.move = move.tolist()
        self._bounds: Bounds | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_bounds": None}

    @property
    def bounds(self) -> Bounds:
        """Made on first use in each process, never shipped."""
        self._bounds = self._bounds or Bounds(self)
        return self._bounds

    def decode(self, run: list[list[str]]) -> list[int]:
        """Viterbi over one run between two O tokens. I follows only B or I."""
        move, best, back = self.move, [0.0, -math.inf, -math.inf], []
        for active in run:
            o = b = i = 0.0
            for w in filter(None, map(self.weight.get, active)):
                o, b, i = o + w[0], b + w[1], i + w[2]
            own = (o, b, i)
            step = [max((best[x] + move[x][y], x) for x in range(3)) for y in range(3)]
            back.append([x for _, x in step])
            best = [s + o for (s, _), o in zip(step, own, strict=True)]
        y = max(range(3), key=lambda x: best[x] + move[x][0])
        out = [y]
        for prior in back[:0:-1]:
            y = prior[y]
            out.append(y)
        return out[::-1]


def labelled(marked: str) -> tuple[str, list[tuple[int, int]]]:
    """The text and the secrets' places of a generated line."""
    text, places, at = [], [], 0
    for c in marked:
        if c == "\x02":
            places.append((at, at))
        elif c == "\x03":
            places[-1] = (places[-1][0], at)
        else:
            text.append(c)
            at += 1
    return "".join(text), places


def _examples(seed: int, n: int, styles: tuple[str, ...]) -> tuple[list, list]:
    """Features and tags of all tokens of generated lines."""
    runs, tags = [], []
    for marked, file in _lines(seed, n, styles):
        text, places = labelled(marked)
        spans = [m.span() for m in _TOKEN.finditer(text)]
        words = [text[a:b] for a, b in spans]
        runs.append([features(words, i, file) for i in range(len(words))])
        tags.append([next((1 if a <= x else 2 for x, y in places if a < y and x < b), 0) for a, b in spans])
    return runs, tags


def fit(n: int = 3000, seed: int = 11, rounds: int = 80, penalty: float = 3e-4, styles: tuple[str, ...] = STYLES) -> Field:
    """Maximum likelihood with forward-backward over generated lines."""
    runs, tags = _examples(seed, n, styles)
    index: dict[str, int] = {}
    seen = Counter(f for run in runs for active in run for f in active)
    for f, count in seen.items():
        if count > 1:
            index[f] = len(index)
    most, size = max(map(len, runs)), np.array([len(r) for r in runs])
    place = [(i, k) for i, run in enumerate(runs) for k in range(len(run))]
    row, column = (np.array(x) for x in zip(*place, strict=True))
    active = [[index[f] for f in runs[i][k] if f in index] for i, k in place]
    token, feature = np.repeat(np.arange(len(active)), [len(a) for a in active]), np.array([f for a in active for f in a])
    y = np.zeros((len(runs), most), int)
    for i, own in enumerate(tags):
        y[i, : len(own)] = own
    inside = np.arange(most) < size[:, None]
    weight, move = np.zeros((len(index), 3)), np.zeros((3, 3))
    barred = np.zeros((3, 3))
    barred[0, 2] = -1e4
    slots = [(weight, np.zeros_like(weight), np.zeros_like(weight)), (move, np.zeros_like(move), np.zeros_like(move))]
    log_sum = lambda a, axis: a.max(axis=axis) + np.log(np.exp(a - a.max(axis=axis, keepdims=True)).sum(axis=axis))
    for t in range(1, rounds + 1):
        own, step = np.zeros((len(runs), most, 3)), move + barred
        own[row, column] = np.stack([np.bincount(token, weight[feature, k], len(active)) for k in range(3)], axis=1)
        alpha = np.full((len(runs), most + 1, 3), -1e4)
        alpha[:, 0, 0] = 0
        for k in range(most):
            new = log_sum(alpha[:, k, :, None] + step, 1) + own[:, k]
            alpha[:, k + 1] = np.where(inside[:, k, None], new, alpha[:, k])
        beta = np.zeros((len(runs), most + 1, 3))
        beta[:] = step[:, 0]
        for k in range(most - 1, 0, -1):
            new = log_sum(step[None] + (own[:, k] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(inside[:, k, None], new, beta[:, k])
        z = log_sum(alpha[:, -1] + step[:, 0], 1)
        error, turn = np.zeros((len(runs), most, 3)), np.zeros_like(move)
        for k in range(most):
            live = inside[:, k]
            pair = np.exp(alpha[:, k, :, None] + step + (own[:, k] + beta[:, k + 1])[:, None, :] - z[:, None, None]) * live[:, None, None]
            true = np.eye(3)[y[:, k]] * live[:, None]
            turn += pair.sum(axis=0)
            turn -= np.einsum("ix,iy->xy", np.eye(3)[y[:, k - 1] if k else np.zeros(len(runs), int)], true)
            error[:, k] = pair.sum(axis=1) - true
        last = np.exp(alpha[:, -1] + step[:, 0] - z[:, None])
        turn[:, 0] += last.sum(axis=0) - np.eye(3)[y[np.arange(len(runs)), size - 1]].sum(axis=0)
        flat = error[row, column]
        grad = np.stack([np.bincount(feature, flat[token, k], len(index)) for k in range(3)], axis=1)
        for (p, m1, m2), g in zip(slots, (grad / len(runs) + penalty * weight, turn / len(runs) + penalty * move), strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            p -= 0.1 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    return Field(index, np.round(weight, 5), move + barred)


def measure(field: Field, seed: int, n: int, styles: tuple[str, ...] = STYLES) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and number of true tokens of the tags begin and inside on generated lines."""
    runs, tags = _examples(seed, n, styles)
    found = Counter((a, b) for run, own in zip(runs, tags, strict=True) for a, b in zip(own, field.decode(run), strict=True))
    out = {}
    for name, k in (("begin", 1), ("inside", 2)):
        said, true = sum(v for (_, b), v in found.items() if b == k), sum(v for (a, _), v in found.items() if a == k)
        out[name] = (found[k, k] / max(1, said), found[k, k] / max(1, true), true)
    return out


@lru_cache(maxsize=1)
def default_field() -> Field:
    return fit()


# ---- scanning ---------------------------------------------------------------


class _Numbers(dict):
    """A number for each token, given on first use."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, token: str) -> int:
        self[token] = out = self.add(token)
        return out


class _Characters:
    """Tables by character of the basic plane, made on first use in each process; its last one, 0xFFFF, stands for those of all others."""

    _made: _Characters | None = None

    def __init__(self):
        n = 1 << 16
        #: 0: part of tokens, 1: blank, 2: a token of its own.
        self.place = np.zeros(n, np.uint8)
        #: Letters that tables can speak for, and their lower case (1 for all other characters).
        self.lower, self.upper, self.fold = np.zeros(n, bool), np.zeros(n, bool), np.ones(n, np.uint16)
        #: What may follow the signs that end a token.
        self.close = np.zeros(n, bool)
        letters = set("".join(CUES + SHORT_CUES)) - {" "}
        like = re.compile(f"[{''.join(sorted(letters))}]", re.IGNORECASE)
        for i in (*range(0xD800), *range(0xE000, n - 1)):
            c = chr(i)
            if c.isspace():
                self.place[i] = 1
            elif c.isalpha() and (c.islower() or c.isupper()) and len(low := c.lower()) == 1 and (low in letters or not like.fullmatch(c)):
                self.lower[i], self.upper[i], self.fold[i] = c.islower(), c.isupper(), ord(low)
        self.place[[*map(ord, "=:,;\"'`()[]{}<>")]] = 2
        self.close[[*map(ord, "\"'`,;)]}>")]] = True
        self.close |= self.place == 1
        self.vowel, self.hex, self.mark = (np.isin(np.arange(n), [*map(ord, x)]) for x in (_VOWELS, "abcdef", _MARKS))

    @classmethod
    def get(cls) -> _Characters:
        cls._made = cls._made or cls()
        return cls._made


class Tokens:
    """Tokens of texts, as ``_TOKEN`` finds them: ``start`` and ``end`` in the joined text, ``place`` in and ``rest`` to the end of the line, ``line``."""

    def __init__(self, texts: list[str]):
        self.text = "\n".join(texts)
        self.chars = np.minimum(np.frombuffer((self.text + "\n\n\n").encode("utf-32-le", "surrogatepass"), np.uint32), 0xFFFF).astype(np.uint16)
        c, table = self.chars, _Characters.get()
        place = table.place[c]
        inside, sign = place == 0, place == 2
        edge = np.concatenate([[False], inside])
        head, last = inside & ~edge[:-1], inside & ~np.append(edge[2:], False)
        # One or two signs = end a token where none but a blank, quote or closing sign follows.
        e = np.flatnonzero(last[:-3]) + 1
        e = e[c[e] == 61]
        n = 1 + (c[e + 1] == 61)
        ok = table.close[c[e + n]]
        e, n = e[ok], n[ok]
        last[e - 1] = False
        last[e + n - 1] = True
        sign[e] = sign[e + n - 1] = False
        self.start, self.end = np.flatnonzero(head | sign), np.flatnonzero(last | sign) + 1
        self.line = np.searchsorted(np.flatnonzero(c == 10), self.start)
        at = np.arange(len(self.start))
        first = np.append(True, np.diff(self.line) > 0)[: len(at)]
        self.place = at - np.maximum.accumulate(np.where(first, at, 0))
        self.rest = np.minimum.accumulate(np.where(np.append(first[1:], True)[: len(at)], at, len(at))[::-1])[::-1] - at
        self.doc = np.searchsorted(np.cumsum([len(x) + 1 for x in texts]), self.start, "right")

    def words(self, at: np.ndarray | slice) -> list[str]:
        return [self.text[a:b] for a, b in zip(self.start[at].tolist(), self.end[at].tolist(), strict=True)]


def _within(mask: np.ndarray, tokens: Tokens) -> np.ndarray:
    """How many characters of each token a mask has."""
    total = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=total[1:], dtype=np.int32)
    return total[tokens.end] - total[tokens.start]


class Bounds:
    """Upper bounds of what B and I gain over O; exact but for the signs and cues of tokens after a cue.

    Plain words (letters, lower-case but for the first, and at most one mark) are summed from tables by NumPy passes
    over a block of texts; every other token has a row in ``table``, made from its features when it is first met.
    """

    #: Tokens whose rows are kept; after that they start anew.
    KEPT = 1 << 18
    MARGIN = 1e-3
    #: Letters of the longest words that a feature names, and characters of the longest token by tables.
    NAMED, LONG = 12, 64

    def __init__(self, field: Field):
        self.weight, move = field.weight, np.array(field.move)
        self.step, self.close = np.array([move[:, 1].max(), move[1:, 2].max()]) - move[0, 0], move[1:, 0].max() - move[0, 0]
        names = {m[1] for f in self.weight if (m := re.fullmatch(r"(?:p[1-4]|n[12]):(.*)", f, re.S) or re.fullmatch(r"p1len:(.*):\d", f, re.S))}
        self.kinds = {c: k for k, c in enumerate(sorted(names | {"^", "$"}), 1)}
        kinds = ["", *self.kinds]
        none = lambda f, c: self._gain(f) if c else np.zeros(2)
        self.past = np.array([[none(f"p{k}:{c}", c) for c in kinds] for k in range(1, 5)])
        self.next = np.array([[none(f"n{k}:{c}", c) for c in kinds] for k in (1, 2)])
        self.size = np.array([none(f"p1len:{c}:{n}", c) for c in kinds for n in range(5)])
        self.most = {g: np.maximum(0, np.max([self._gain(f) for f in self.weight if f.startswith(g)] or [[0, 0]], axis=0)) for g in ("cue@", "signs:")}
        # Signs since the start of the line, where no cue is near: numbers in base ``signs + 2``, the greatest digit for unknown ones.
        series = {f[6:] for f in self.weight if f.startswith("cue@9:")}
        self.signs = {c: k for k, c in enumerate(sorted({"^"}.union(*series)), 1)}
        numbers = {}
        for x in series:
            number = 0
            for c in x:
                number = number * (len(self.signs) + 2) + self.signs[c]
            numbers[number] = self._gain(f"cue@9:{x}")
        self.series, self.series_gain = self._sorted(numbers)
        self._clear()
        self._tables()

    def _gain(self, feature: str) -> np.ndarray:
        w = self.weight.get(feature, (0.0, 0.0, 0.0))
        return np.array([w[1] - w[0], w[2] - w[0]])

    @staticmethod
    def _sorted(gains: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        keys = sorted(gains)
        return np.array([*keys, (1 << 63) - 1], np.int64), np.array([*(gains[k] for k in keys), np.zeros(2)])

    def _clear(self) -> None:
        self.ids, self.rows, self.ends = _Numbers(self._add), [], {}
        self.table = np.zeros((0, 8))

    def _add(self, token: str) -> int:
        """A row of the table: gains with no cue before it and with one, number as a neighbour, bucket of its length, number as a sign (0: none) and whether it is a cue."""
        word = _word(token)
        sign = self.signs.get(word, len(self.signs) + 1) if len(word) == 1 and not word.isalnum() else 0
        self.rows.append((*self._both(_shape(token)), self.kinds.get(word, 0), _bucket(len(token), 6, 10, 20, 32), sign, word.startswith("cue")))
        return len(self.ids)

    def _both(self, shape: tuple[str, ...]) -> tuple[float, float, float, float]:
        if (ends := self.ends.get(shape[1:3])) is None:
            bare = self._gain(f"cue:False:{shape[1]}") + self._gain(f"cue:False:{shape[2]}") + self._gain(f"signs::{shape[2]}")
            cued = self._gain(f"cue:True:{shape[1]}") + self._gain(f"cue:True:{shape[2]}") + self.most["signs:"]
            ends = self.ends[shape[1:3]] = (*bare.tolist(), *cued.tolist())
        o = b = i = 0.0
        for w in filter(None, map(self.weight.get, shape)):
            o, b, i = o + w[0], b + w[1], i + w[2]
        return b - o + ends[0], i - o + ends[1], b - o + ends[2], i - o + ends[3]

    def _tables(self) -> None:
        """What plain words gain: by first letter's case, mark and number of letters; by entropy, vowels, hex digits, head and the word itself."""
        apart = ("entropy:", "vowels:", "hex:", "word:", "head:")
        like = [[_shape(first + "b" * n + mark) for n in range(self.LONG)] for first in "bB" for mark in ("", *_MARKS)]
        self.plain = np.array([[self._both(tuple(f for f in x if not f.startswith(apart))) for x in row] for row in like])
        self.entropy = np.array([self._gain(f"entropy:{k}") for k in range(len(_ENTROPY) + 1)])
        self.vowels = np.array([self._gain(f"vowels:{k}:False") for k in range(len(_VOWEL_SHARE) + 1)])
        self.hexes = np.array([self._gain("hex:False"), self._gain("hex:True")])
        codes = lambda x, n: np.frombuffer(x.encode("utf-16-le", "surrogatepass").ljust(2 * n, b"\0"), np.uint16)
        heads = {x: self._gain(f) for f in self.weight if f.startswith("head:") and len((x := f[5:]).encode("utf-16-le", "surrogatepass")) == 6}
        self.heads, self.head_gain = self._sorted({int(codes(x, 4).view(np.int64)[0]): g for x, g in heads.items()})
        fits = lambda x: x and len(x.encode("utf-16-le", "surrogatepass")) <= 2 * self.NAMED
        named = sorted({x for x in (*self.kinds, *SHORT_CUES, *(f[5:] for f in self.weight if f.startswith("word:"))) if fits(x)})
        key = np.array([codes(x, self.NAMED) for x in named]).view(np.int64)
        order = np.argsort(self._hash(key), kind="stable")
        self.names, self.name_hash, named = key[order], self._hash(key)[order], [named[i] for i in order]
        # The last row is for words that no feature names.
        self.name_kind = np.array([*(self.kinds.get(x, 0) for x in named), 0])
        self.name_gain = np.array([*(self._gain(f"word:{x}") for x in named), np.zeros(2)])
        self.name_cue = np.array([*(x in SHORT_CUES for x in named), False])

    @staticmethod
    def _hash(key: np.ndarray) -> np.ndarray:
        return mix(mix(mix(key[:, 0].view(U64)) + key[:, 1].view(U64)) + key[:, 2].view(U64))

    def _named(self, tokens: Tokens, at: np.ndarray, letters: np.ndarray, folded: np.ndarray) -> np.ndarray:
        """The row of each word among the named ones, the last row for all others; hashes find it, the letters confirm."""
        k = np.arange(self.NAMED)
        short = np.flatnonzero(letters <= self.NAMED)
        place = tokens.start[at[short], None] + k
        key = np.where(k < letters[short, None], folded[np.minimum(place, len(folded) - 1)], 0).astype(np.uint16).view(np.int64)
        i = np.minimum(np.searchsorted(self.name_hash, self._hash(key)), len(self.names) - 1)
        out = np.full(len(at), len(self.names))
        out[short] = np.where((self.names[i] == key).all(axis=1), i, len(self.names))
        return out

    def _entropies(self, tokens: Tokens, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Gain of the bucket of each word's entropy; the greater one where the value is at the edge of two."""
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(at)), size)
        key = (word << 16) | tokens.chars[np.arange(len(word)) + np.repeat(tokens.start[at] - first, size)]
        key.sort()
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
        count = np.diff(np.append(new, len(key)))
        bits = np.arange(self.LONG + 2) * np.log2(np.maximum(1, np.arange(self.LONG + 2)))
        exact = np.log2(size) - np.bincount(key[new] >> 16, bits[count], len(at)) / size
        low, high = (np.searchsorted(_ENTROPY, exact + e, "right") for e in (-1e-9, 1e-9))
        return np.maximum(self.entropy[low], self.entropy[high])

    def _rows_of(self, tokens: Tokens) -> np.ndarray:
        """The row of each token, with the columns of ``table``."""
        chars, t, n = tokens.chars, _Characters.get(), len(tokens.start)
        size = tokens.end - tokens.start
        mark = t.mark[chars[tokens.end - 1]] & (size > 1)
        letters = size - mark
        lower = t.lower[chars]
        high = t.upper[chars[tokens.start]]
        plain = (_within(lower, tokens) == letters - high) & (size <= self.LONG)
        folded = t.fold[chars]
        searched, found = folded.tobytes().decode("utf-16-le"), []
        for cue in CUES:
            place = searched.find(cue)
            while place >= 0:
                found.append(place)
                place = searched.find(cue, place + 1)
        plain[np.searchsorted(tokens.start, np.array(found, np.int64), "right") - 1] = False
        at = np.flatnonzero(plain)
        name = self._named(tokens, at, letters[at], folded)
        cued = self.name_cue[name]
        plain[at[cued]] = False
        at, name = at[~cued], name[~cued]
        own, size, letters, mark = np.zeros((n, 8)), size[at], letters[at], mark[at]
        marks = np.where(mark, 1 + np.searchsorted(_MARK_CODES, chars[tokens.end[at] - 1]), 0)
        own[at, :4] = self.plain[high[at] * (1 + len(_MARKS)) + marks, letters - 1]
        whole = ~mark & (letters <= 10)
        more = self._entropies(tokens, at, size)
        more += self.vowels[np.searchsorted(_VOWEL_SHARE, _within(t.vowel[chars], tokens)[at] / size, "right")]
        more += self.hexes[(_within(t.hex[chars], tokens)[at] == size).astype(np.int64)]
        more += np.where(whole[:, None], self.name_gain[name], self._gain("word:"))
        long = size > 6
        start = tokens.start[at[long]]
        key = (folded[start].astype(np.int64)) | (folded[start + 1].astype(np.int64) << 16) | (folded[start + 2].astype(np.int64) << 32)
        i = np.searchsorted(self.heads, key)
        more[long] += np.where((self.heads[i] == key)[:, None], self.head_gain[i], 0)
        more[~long] += self._gain("head:")
        own[at, :2] += more
        own[at, 2:4] += more
        own[at, 4] = np.where(~mark & (letters <= self.NAMED), self.name_kind[name], self.kinds.get("other", 0))
        own[at, 5] = np.searchsorted((6, 10, 20, 32), size, "right")
        at = np.flatnonzero(~plain)
        sign = t.place[chars[tokens.start[at]]] == 2
        ids = np.zeros(len(at), np.int64)
        ids[~sign] = np.fromiter(map(self.ids.__getitem__, tokens.words(at[~sign])), np.int64, len(at) - int(sign.sum()))
        which, each = np.unique(chars[tokens.start[at[sign]]], return_inverse=True)
        ids[sign] = np.array([self.ids[chr(c)] for c in which], np.int64)[each]
        if self.rows:
            end = len(self.ids)
            if end > len(self.table):
                self.table = np.concatenate([self.table, np.zeros((end, 8))])
            self.table[end - len(self.rows) : end], self.rows = self.rows, []
        own[at] = self.table[ids]
        return own

    def gains(self, tokens: Tokens, files: list[tuple[str, ...]]) -> np.ndarray:
        """At most what each token adds to a path by a tag; files: the features of each text's file."""
        if len(self.ids) > self.KEPT:
            self._clear()
        own, n = self._rows_of(tokens), len(tokens.start)
        kind, length, signs, cues = (own[:, k].astype(np.int64) for k in (4, 5, 6, 7))
        start, stop = self.kinds["^"], self.kinds["$"]
        cue, series = np.zeros(n, bool), np.full(n, self.signs["^"])
        add = np.zeros((n, 2))
        before = lambda x, k: np.append(np.zeros(k, x.dtype), x)[:n]
        for k in range(4, 0, -1):
            inside = tokens.place >= k
            near = np.where(inside, before(kind, k), np.where(tokens.place == k - 1, start, 0))
            add += self.past[k - 1][near]
            sign = np.where(inside, before(signs, k), 0)
            series = np.where(sign > 0, series * (len(self.signs) + 2) + sign, series)
            cue |= inside & (before(cues, k) > 0)
        add += self.size[near * 5 + length]
        for k in (1, 2):
            after = np.append(kind, np.zeros(k, np.int64))[k:]
            add += self.next[k - 1][np.where(tokens.rest >= k, after, np.where(tokens.rest == k - 1, stop, 0))]
        i = np.searchsorted(self.series, series)
        add += np.where(cue[:, None], own[:, 2:4] + self.most["cue@"], own[:, :2] + np.where((self.series[i] == series)[:, None], self.series_gain[i], 0))
        add += np.array([sum(self._gain(f"file:{f}") for f in file) for file in files])[tokens.doc]
        return (add + self.step).max(axis=1)

    def live(self, tokens: Tokens, files: list[tuple[str, ...]]) -> np.ndarray:
        """Tokens that a stretch of tags with a positive gain could cover; on the best path all others are outside."""
        gain = self.gains(tokens, files)
        gap = np.add.reduceat(np.abs(gain), np.flatnonzero(tokens.place == 0)).max() + 1
        after = np.cumsum(gain) - gap * tokens.line
        best = np.maximum.accumulate(after[::-1])[::-1] - np.minimum.accumulate(after - gain)
        return best + self.close > -self.MARGIN - 1e-10 * np.abs(after)


def _cut(text: str):
    """Pieces of whole lines, of about ``BLOCK`` characters (more, where a line has more), and their places."""
    at = 0
    while len(text) - at > BLOCK:
        end = text.rfind("\n", at, at + BLOCK) + 1 or text.find("\n", at + BLOCK) + 1 or len(text)
        yield at, text[at:end]
        at = end
    if at < len(text):
        yield at, text[at:]


def stretches_of(texts: list[str], field: Field, files: list[tuple[str, ...]]) -> list[list[tuple]]:
    """For each text the stretches of tokens that may be tagged, with the tokens around them that features read, as (tokens as (start, end), their words, first and end of the stretch); all other tokens are outside."""
    out: list[list[tuple]] = [[] for _ in texts]
    block, size = [], 0
    for i, text in enumerate(texts):
        for at, piece in _cut(text):
            if block and size + len(piece) > BLOCK:
                _read(block, field, files, out)
                block, size = [], 0
            block.append((i, at, piece))
            size += len(piece) + 1
    if block:
        _read(block, field, files, out)
    return out


def _read(block: list[tuple[int, int, str]], field: Field, files: list[tuple[str, ...]], out: list[list[tuple]]) -> None:
    tokens = Tokens([piece for _, _, piece in block])
    if not len(tokens.start):
        return
    at = np.flatnonzero(field.bounds.live(tokens, [files[i] for i, _, _ in block]))
    if not len(at):
        return
    heads = np.cumsum([0] + [len(piece) + 1 for _, _, piece in block])
    for run in np.split(at, np.flatnonzero((np.diff(at) > 1) | (np.diff(tokens.line[at]) > 0)) + 1):
        low, high = int(run[0] - min(4, tokens.place[run[0]])), int(run[-1] + 1 + min(2, tokens.rest[run[-1]]))
        k = tokens.doc[run[0]]
        move = block[k][1] - int(heads[k])
        spans = [(a + move, b + move) for a, b in zip(tokens.start[low:high].tolist(), tokens.end[low:high].tolist(), strict=True)]
        out[block[k][0]].append((spans, tokens.words(slice(low, high)), int(run[0]) - low, int(run[-1]) + 1 - low))


def stretches(text: str, field: Field, file: tuple[str, ...]) -> list[tuple]:
    """The stretches of one text."""
    return stretches_of([text], field, [file])[0]


Span = tuple[int, int, int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end, start and end of the secret itself) of the fixed patterns."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end(), *m.span(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return out + [(m.start(), 2, m.end(), *m.span()) for m in HEX.finditer(text)]


def all_spans(text: str, field: Field) -> list[Span]:
    """Spans of the patterns and of the field."""
    file = file_features(text)
    return _with_field(base_spans(text), field, file, stretches(text, field, file))


def _with_field(base: list[Span], field: Field, file: tuple[str, ...], runs: list[tuple]) -> list[Span]:
    """Spans of the patterns and of the field, decoded on a text's stretches."""
    added = []
    for spans, words, first, stop in runs:
        last = None
        tags = field.decode([features(words, i, file) for i in range(first, stop)])
        for (start, end), tag in zip(spans[first:stop], tags, strict=True):
            rest = _uncovered(start, end, base) if tag else []
            for k, (s, e) in enumerate(rest):
                if tag == 2 and k == 0 and s == start and last is not None and added and added[-1][1] == last:
                    added[-1][1] = e
                else:
                    added.append([s, e])
            last = end if tag else None
    return sorted(base + [(s, 3, e, s, e) for s, e in added])


def _uncovered(start: int, end: int, base: list[Span]) -> list[tuple[int, int]]:
    """The parts of a tagged token that no pattern's span covers; none of a token that ends an assignment, which is the name and the value."""
    parts = [(start, end)]
    for a, kind, b, *_ in base:
        if a < end and start < b:
            parts = [] if kind == 0 else [(s, e) for x, y in parts for s, e in ((x, min(y, a)), (max(x, b), y)) if s < e]
    return parts


def suspects(column: pa.Array) -> np.ndarray:
    """Whether a text can hold any span but one after a cue: it has a key-like run of 12 bytes, or an assignment sign and a run of 8."""
    runs = Words(column, _RUNS)
    length = runs.end - runs.start
    longest = np.zeros(len(runs.count), np.int64)
    np.maximum.at(longest, runs.doc, length)
    total = np.zeros(len(runs.raw) + 1, np.int32)
    np.cumsum((runs.raw == 61) | (runs.raw == 58), out=total[1:], dtype=np.int32)
    long, digits = length >= ABLE_LENGTH, np.zeros(len(runs.raw) + 1, np.int32)
    np.cumsum((runs.raw >= 48) & (runs.raw <= 57), out=digits[1:], dtype=np.int32)
    long &= (digits[runs.end] > digits[runs.start]) | (length >= 16)
    out = np.bincount(runs.doc[long], minlength=len(longest)) > 0
    return out | ((longest >= LEAST["assign"]) & (np.diff(total[runs.offsets]) > 0))


@lru_cache(maxsize=1)
def _cues() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for c in (*CUES, *SHORT_CUES):
        out.add_word(c.casefold(), len(c.casefold()) if c in SHORT_CUES else 0)
    out.make_automaton()
    return out


def _cued(text: str) -> bool:
    """Whether a text holds a cue; case folds at least as far as in ``_CUE``."""
    low = text.casefold()
    return any(not n or not (low[max(0, end - n) : end - n + 1].isalpha() and end >= n or low[end + 1 : end + 2].isalpha()) for end, n in _cues().iter(low))


def _spans_of(column: pa.Array, field: Field) -> list[list[Span]]:
    hot, texts = suspects(column), [text or "" for text in column.to_pylist()]
    files = [file_features(text) for text in texts]
    return [_with_field(base_spans(text) if h else [], field, file, runs) for text, h, file, runs in zip(texts, hot, files, stretches_of(texts, field, files), strict=True)]


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, *_ in spans)


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", field: Field | None = None) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, n_crf, base_sha256 and spans."""
    field = field or default_field()

    def find(batches):
        for batch in batches:
            for part in steps(batch, "text"):
                found = _spans_of(part.column("text"), field)
                columns = [pa.array([sum(s[1] == k for s in x) for x in found], pa.int64()) for k in range(4)]
                digest = [hashlib.sha256(_joined([s for s in x if s[1] < 3]).encode()).hexdigest() for x in found]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns, pa.array(digest), pa.array([_joined(x) for x in found])], names=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"])

    return pick(docs, id_col, text_col).mapInArrow(find, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string")


def _without(text: str, spans: list[Span]) -> str:
    parts, at = [], 0
    for start, end in sorted((s[3], s[4]) for s in spans):
        if start >= at:
            parts += [text[at:start], REDACTED]
        at = max(at, end)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, *, text_col: str = "text", length_col: str = "n_chars", field: Field | None = None) -> DataFrame:
    """The documents with each secret replaced by a mark; all rows and columns stay."""
    field = field or default_field()
    kind = dict(docs.dtypes).get(length_col)

    def clean(batches):
        for batch in batches:
            for part in steps(batch, text_col):
                found = _spans_of(part.column(text_col), field)
                if any(found):
                    texts = part.column(text_col).to_pylist()
                    for i, spans in enumerate(found):
                        if spans:
                            texts[i] = _without(texts[i], spans)
                    at = part.schema.get_field_index(text_col)
                    if kind in ("bigint", "int"):
                        sizes = part.column(length_col).to_pylist()
                        sizes = [len(texts[i]) if spans else sizes[i] for i, spans in enumerate(found)]
                        k = part.schema.get_field_index(length_col)
                        part = part.set_column(k, part.schema.field(k), pa.array(sizes, part.schema.field(k).type))
                    part = part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))
                yield part

    return docs.mapInArrow(clean, docs.schema)
