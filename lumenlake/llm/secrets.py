"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds spans.

The patterns give the base spans. A CRF over white-space tokens (states outside, begin, inside)
reads each token's shape, its neighbours' shapes and words, and features of the whole text. It is
trained on a bounded sample of texts twice over: as they are, their tokens marked by the base spans
(silver labels), and with generated pieces spliced in at random places: secrets of shapes that no
pattern knows (other key words, prefixed keys, base64, three-part tokens, connection strings) with
their labels, and look-alikes (addresses, links with ids, UUIDs, paper and part numbers, dates,
versions, names) that are none. So it learns
what secrets look like beside what the patterns say, and the decoded spans are added to the base
ones. Weights come from exact forward-backward gradients; Viterbi decodes. Tokens whose margin for
"outside" exceeds anything the transitions can make up for are outside in the best path whatever
their neighbours are; the exact decoding therefore only runs over the stretches between them.

A decoded span is added when MIN_NEW of its letters and digits lie outside all base spans.

Defined cases: null and empty texts have no spans; repeated rows are scanned each and copies of a
text train once; very long texts are scanned whole; a table without words trains no model and adds no
spans; a null doc_id is kept; extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlake.llm.bytetok import SPACE, utf8, words
from lumenlake.llm.common import blocks, materialize

#: The base patterns; a match counts from the length given (of group 2, of all, of all).
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the runs of [0-9a-f]+ that are long enough
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ("assign", "access", "hex", "crf")

#: Texts that training reads at most, with and without base spans, and windows with and without a secret, in hash order.
TRAIN_WITH, TRAIN_WITHOUT = 600, 400
TRAIN_WINDOWS = 4_000
#: Pieces spliced into a training text, tokens on each side of a window's centre, and words that may be cues.
SPLICES = 6
WINDOW = 6
CUE_WORDS = 64
MIN_NEW = 8
OUTSIDE, BEGIN, INSIDE = range(3)
_TOKEN = ~SPACE
_HEXDIGIT = np.zeros(256, bool)
_HEXDIGIT[list(b"0123456789abcdef")] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True
_CLASS = np.zeros(256, np.uint8)
for _n, _m in enumerate((b"0123456789", b"abcdef", bytes(range(103, 123)), bytes(range(65, 91)), b"=:", b"\"'`", b"+/", b"_-.", b",;()[]{}<>", bytes(range(0x80, 256)), b"@", b"#$%^&*!~?|"), 1):
    _CLASS[list(_m)] = _n
_TRIM = "\"'`,.;:()[]{}<>"


class Model(NamedTuple):
    cues: np.ndarray  # hashes of words that tend to stand near secrets
    emission: np.ndarray  # features x 3
    transition: np.ndarray  # 3 x 3


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]] if "=" in text or ":" in text else []
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]] if "AKIA" in text else []
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _suspects(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows that may hold a base span: a long run of hex digits, a capital A with K, I and A after it, or = or : ."""
    rows = len(offsets) - 1
    runs = words(data, offsets, _HEXDIGIT, hashed=False)
    long = np.bincount(runs.doc[runs.end - runs.start >= LEAST["hex"]], minlength=rows) > 0
    marks = (data == 0x3D) | (data == 0x3A)
    if len(data) > 3:
        marks[:-3] |= (data[:-3] == 0x41) & (data[1:-2] == 0x4B) & (data[2:-1] == 0x49) & (data[3:] == 0x41)
    at = np.searchsorted(offsets, np.flatnonzero(marks), "right") - 1
    return np.flatnonzero(long | (np.bincount(at, minlength=rows) > 0))


class Tokens(NamedTuple):
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    count: np.ndarray
    x: np.ndarray  # features


def token_features(data: np.ndarray, offsets: np.ndarray, cues: np.ndarray) -> Tokens:
    """White-space tokens of a block of texts with their binary features, neighbours' included."""
    t = words(data, offsets, _TOKEN, hashed=False)
    n, size = len(t.start), t.end - t.start
    rows = len(offsets) - 1
    if not n:
        return Tokens(t.doc, t.start, t.end, t.count, np.zeros((0, 0), np.float32))
    cls = _CLASS[data]

    def within(marked: np.ndarray, first: np.ndarray = t.start) -> np.ndarray:
        """How many marked bytes each token has, from `first` on."""
        upto = np.concatenate([np.zeros(1, np.int32), np.cumsum(marked, dtype=np.int32)])
        return upto[t.end] - upto[first]

    digit, low, other, up, sign, quote, slash, link, punct, wide, at_sign, mark = (within(cls == k) for k in range(1, 13))
    letters = low + other + up
    kind = np.where(cls == 1, 1, np.where((cls >= 2) & (cls <= 4), 2, 0)).astype(np.int8)
    case = np.where((cls == 2) | (cls == 3), 1, np.where(cls == 4, 2, 0)).astype(np.int8)
    turns = []
    for of in (kind, case):  # neighbours of different kinds inside a token
        turn = np.zeros(len(data), bool)
        turn[1:] = (of[1:] != of[:-1]) & (of[1:] > 0) & (of[:-1] > 0)
        turns.append(within(turn, np.minimum(t.start + 1, t.end)))
    switch, cases = turns
    w = words(data, offsets)
    cue_word = np.isin(w.hash, cues) if len(cues) else np.zeros(len(w.hash), bool)
    at = np.searchsorted(t.start, w.start[cue_word], "right") - 1
    cue = np.bincount(at, minlength=n) > 0
    core = digit + letters
    runs = words(data, offsets, _ALNUM, hashed=False)
    longest, groups, hexgroups, of = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.searchsorted(t.start, runs.start, "right") - 1
    np.maximum.at(longest, of, runs.end - runs.start)
    np.add.at(groups, of, 1)
    no_hex = np.concatenate([np.zeros(1, np.int32), np.cumsum(~_HEXDIGIT[data | 0x20] & ~_HEXDIGIT[data], dtype=np.int32)])
    np.add.at(hexgroups, of, no_hex[runs.end] == no_hex[runs.start])
    scheme = np.zeros(len(data), bool)
    scheme[:-2] = (data[:-2] == 0x3A) & (data[1:-1] == 0x2F) & (data[2:] == 0x2F)
    scheme = within(scheme) > 0
    shape = np.column_stack([
        (size >= 8) & (size < 12), (size >= 12) & (size < 16), (size >= 16) & (size < 24), (size >= 24) & (size < 48), size >= 48,
        digit > 0, (digit > 0) & (letters > 0), digit == size, (digit + low >= 12) & (other == 0) & (up == 0), (up > 0) & (low + other > 0) & (digit > 0),
        (up + digit >= 14) & (low + other == 0) & (up > 0), switch >= 2, switch >= 4, sign > 0, quote > 0, slash > 0, link > 0, punct > 0, wide > 0,
        (letters > 0) & (digit == 0), cue, cue & (sign > 0), (sign > 0) & ~scheme & (longest >= 12) & (switch >= 2), (sign == size),
        cases >= 2, cases >= 5, (cases >= 3) & (digit > 0) & (size >= 12), (switch + cases >= 8), at_sign > 0, (at_sign > 0) & (sign > 0) & (slash > 1), mark > 0, (mark > 0) & (digit > 0) & (letters > 0),
        (letters == 0) & (digit > 0), (core >= 20) & (switch + cases >= 6), link >= 2, slash >= 2, (slash >= 2) & (sign > 0), (core >= 16) & (3 * (switch + cases) >= core), (core >= 16) & (5 * digit >= core) & (letters > 0),
        longest < 8, (longest >= 8) & (longest < 12), (longest >= 12) & (longest < 16), longest >= 20, (hexgroups >= 5) & (groups - hexgroups <= 2) & (letters > 0), (groups >= 5) & (longest < 12), scheme & (at_sign == 0), scheme & (at_sign > 0),
        (link > 0) & (2 * longest < core), (sign > 0) & (longest < 12),
    ])
    near = np.column_stack([sign > 0, quote > 0, cue, (digit > 0) & (letters > 0), size >= 16])
    first, last = np.ones(n, bool), np.ones(n, bool)
    first[1:], last[:-1] = t.doc[1:] != t.doc[:-1], t.doc[1:] != t.doc[:-1]
    prev, after, prev2 = np.zeros_like(near), np.zeros_like(near), np.zeros((n, 1), bool)
    prev[1:] = near[:-1] & ~first[1:, None]
    after[:-1] = near[1:] & ~last[:-1, None]
    prev2[2:, 0] = cue[:-2] & (t.doc[2:] == t.doc[:-2])
    digits = np.bincount(t.doc, digit > 0, rows) / np.maximum(t.count, 1)
    signs = np.bincount(t.doc, sign > 0, rows) / np.maximum(t.count, 1)
    file = np.column_stack([digits > 0.1, signs > 0.05, t.count < 30])[t.doc]
    led = np.column_stack([(prev[:, 0] & (size >= 6) & (digit > 0)), (prev[:, 0] & prev2[:, 0] & (size >= 6)), cue & (size < 16) & (digit == 0)])
    ones = np.ones((n, 1), bool)
    return Tokens(t.doc, t.start, t.end, t.count, np.hstack([ones, shape, prev, after, prev2, file, first[:, None], led]).astype(np.float32))


def _code_points(data: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte, and in all."""
    return np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def fit(x: np.ndarray, y: np.ndarray, used: np.ndarray, steps: int = 100, rate: float = 0.2, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """Emission and transition weights of the CRF for sequences x[n, length, features], tags y and the mask of used places."""
    n, length, k = x.shape
    e_w, t_w = np.zeros((k, 3)), np.zeros((3, 3))
    moments = [np.zeros_like(e_w), np.zeros_like(e_w), np.zeros_like(t_w), np.zeros_like(t_w)]
    flat, total = x.reshape(-1, k), float(used.sum())
    one = np.eye(3)[y] * used[..., None]
    pair = np.einsum("nia,nib->ab", one[:, :-1], one[:, 1:])
    for step in range(1, steps + 1):
        e = (flat @ e_w).reshape(n, length, 3)
        alpha, beta = np.zeros((n, length, 3)), np.zeros((n, length, 3))
        alpha[:, 0] = e[:, 0]
        for i in range(1, length):
            forward = e[:, i] + _log_sum(alpha[:, i - 1, :, None] + t_w, 1)
            alpha[:, i] = np.where(used[:, i, None], forward, alpha[:, i - 1])
        for i in range(length - 2, -1, -1):
            back = _log_sum(t_w[None] + (e[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
            beta[:, i] = np.where(used[:, i + 1, None], back, beta[:, i + 1])
        z = _log_sum(alpha[:, -1], 1)
        p = np.exp(alpha + beta - z[:, None, None]) * used[..., None]
        q = np.exp(alpha[:, :-1, :, None] + t_w + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * used[:, 1:, None, None]
        g_e = flat.T @ (one - p).reshape(-1, 3) / total - ridge * e_w
        g_t = (pair - q.sum((0, 1))) / total - ridge * t_w
        for w, g, m, v in ((e_w, g_e, moments[0], moments[1]), (t_w, g_t, moments[2], moments[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return e_w, t_w


def viterbi(e: np.ndarray, transition: np.ndarray, before: bool, after: bool) -> np.ndarray:
    """The best tags for emissions e, between outside tokens where before and after say so."""
    back = np.zeros((len(e), 3), np.int8)
    score = e[0] + (transition[OUTSIDE] if before else 0)
    for i in range(1, len(e)):
        options = score[:, None] + transition
        back[i] = options.argmax(0)
        score = options.max(0) + e[i]
    tag = int((score + (transition[:, OUTSIDE] if after else 0)).argmax())
    tags = [tag]
    for i in range(len(e) - 1, 0, -1):
        tag = int(back[i, tag])
        tags.append(tag)
    return np.array(tags[::-1])


def transition_gain(t: np.ndarray) -> float:
    """The most that transitions can gain when a token is not outside, whatever its neighbours' tags are."""
    into, out = t[:, 1:] - t[:, :1], t[1:, :] - t[:1, :]  # [before, tag], [tag, after]
    both = into[:, :, None] + out[None, :, :]
    return float(max(both.max(), into.max(), out.max(), 0))


def crf_spans(model: Model, tokens: Tokens) -> list[tuple[int, int]]:
    """(first, last) token of each span that the CRF tags."""
    if not len(tokens.start):
        return []
    e = tokens.x @ model.emission
    most = transition_gain(model.transition)
    open_ = e[:, OUTSIDE] - np.maximum(e[:, BEGIN], e[:, INSIDE]) <= most
    at = np.flatnonzero(open_)
    if not len(at):
        return []
    found = []
    cut = np.flatnonzero((np.diff(at) > 1) | (tokens.doc[at[1:]] != tokens.doc[at[:-1]])) + 1
    for run in np.split(at, cut):
        a, b = int(run[0]), int(run[-1])
        before, after = a > 0 and tokens.doc[a - 1] == tokens.doc[a], b + 1 < len(tokens.doc) and tokens.doc[b + 1] == tokens.doc[b]
        tags = viterbi(e[a : b + 1], model.transition, before, after)
        begin = None
        for i, tag in enumerate([*tags.tolist(), OUTSIDE]):
            if begin is not None and tag != INSIDE:
                found.append((a + begin, a + i - 1))
                begin = None
            if tag == BEGIN or tag == INSIDE and begin is None:
                begin = i
    return found


def generated_piece(r: random.Random) -> tuple[str, int, int]:
    """(text, start, end): a secret of a shape that no base pattern knows and where it lies in the text, or a look-alike (0, 0)."""
    alnum, lower, upper = string.ascii_letters + string.digits, string.ascii_lowercase, string.ascii_uppercase

    def chars(alphabet: str, low: int, high: int) -> str:
        made = [r.choice(alphabet) for _ in range(r.randint(low, high))]
        made[r.randrange(len(made))] = r.choice(string.digits) if alphabet[-1] in string.digits else made[0]
        return "".join(made)

    def word(low: int = 2, high: int = 9) -> str:
        return "".join(r.choice(lower) for _ in range(r.randint(low, high)))

    if r.random() < 0.55:
        kind, before = r.randrange(8), ""
        if kind == 0:  # other key words
            key = r.choice(("pwd", "pass", "passphrase", "auth", "auth_key", "access_key", "private_key", "credential", "signing_key", "session_key", "PWD", "DB_PASS", "authKey"))
            value = r.choice((chars(alnum, 12, 40), word(4, 7).capitalize() + chars(string.digits, 2, 4) + r.choice("!@#$%&*") + word(2, 4), chars(lower + string.digits, 10, 24), chars("abcdef" + string.digits, 16, 40)))
            q = r.choice(("", "", '"', "'"))
            secret = key + r.choice((":", "=", ": ", " = ", " : ", "=")) + q + value
            return secret + q + r.choice(("", "", ".", ",")), 0, len(secret)
        if kind == 1:
            secret = word(2, 4) + r.choice("_-") + chars(alnum, 20, 40)
        elif kind == 2:
            secret = chars(alnum + "+/" + string.digits, 24, 64) + r.choice(("", "=", "=="))
        elif kind == 3:
            secret = ".".join(chars(alnum + "-_" + string.digits, low, low + 20) for low in (16, 24, 20))
        elif kind == 4:
            secret = chars(upper + r.choice((string.digits, "234567", "7")), 16, 32)  # base 36, base 32, hardly a digit
        elif kind == 5:
            secret = f"{r.choice(('postgres', 'mysql', 'amqp', 'redis', 'mongodb', 'ftp', word(3, 6)))}://{word()}:{chars(alnum, 8, 16)}@{word()}.{word(2, 5)}{r.choice(('', ':5432', '/' + word()))}"
        elif kind == 6:
            secret = chars(lower + string.digits, 20, 40)
        else:
            secret, before = chars(alnum, 20, 48), r.choice(("Authorization: Bearer ", "bearer ", "Basic ", "key ", "x-key: "))
        q = r.choice(("", "", "", '"', "'"))
        return before + q + secret + q + r.choice(("", "", ".", ",")), len(before + q), len(before + q + secret)
    n = lambda low, high: str(r.randint(low, high))
    name = lambda k: "".join(word(3, 8).capitalize() for _ in range(k))
    return r.choice((
        f"{word()}.{n(1, 99)}@{word()}{n(1, 9)}.{word(2, 6)}.com", f"{word()}@{word()}.org", f"https://{word()}.{word(2, 6)}.net/{word()}/{word()}-{n(1, 9999)}.html", f"http://www.{word()}.com/?id={n(1, 99999)}&page={n(1, 9)}",
        ".".join(n(1, 255) for _ in range(4)), f"+1 ({n(200, 999)}) 555-{n(1000, 9999)}", f"20{n(10, 29)}-0{n(1, 9)}-{n(10, 28)}T{n(10, 23)}:{n(10, 59)}:{n(10, 59)}Z", f"v{n(1, 9)}.{n(0, 20)}.{n(0, 9)}-{word(2, 5)}{n(1, 9)}",
        f"/{word()}/{word()}/{word()}_{n(1, 20)}.txt", name(3), name(2) + n(1, 9), "_".join(word(3, 8) for _ in range(4)), f"{word(2, 4).upper()}-20{n(10, 29)}-{n(10000, 99999)}", f"${n(1, 999)},{n(100, 999)}.00",
        "-".join(word(4, 8) for _ in range(3)), word(12, 24), word(8, 14).upper(), f"#{word(3, 12)}{n(1, 99)}", f"password: {word(4, 8)}", f"the token {word()} {word()}", f"secret: {word()} {word()}", f"key: {word(3, 8)}", f"{word(3, 8)} = {word(3, 8)}",
        f"{word()}###", f"{n(10, 99)}%%%", f"({n(1000, 2030)})", f"{word()}={n(1, 99)}", f"ISBN 978-{n(0, 9)}-{n(1000, 9999)}-{n(1000, 9999)}-{n(0, 9)}", f"{word(3, 6)}:{n(1, 200)}", f"{n(1, 12)}:{n(10, 59)}pm", f"{word(4, 9)}'s", word().capitalize() + "&&&",
        *(q.replace("@", "-".join("".join(r.choice(hexa) for _ in range(k)) for k in (8, 4, 4, 4, 12))) for hexa in (string.digits + "abcdef", string.digits + "ABCDEF") for q in ("@", "@", "{@}", "urn:uuid:@", "id=@", f"/{word()}/@")),
        *(f"http{r.choice(('', 's'))}://{r.choice(('www.', '', 'm.'))}{word()}.{word(2, 4)}/{word()}{q}" for q in (
            f"?{word(1, 4)}={chars(alnum + '-_' + string.digits, 9, 14)}&{word(1, 5)}={chars(alnum + '-_' + string.digits, 16, 40)}", f"?{word(1, 2)}={chars(alnum + '-_' + string.digits, 9, 13)}", f"/{chars(alnum + string.digits, 8, 44)}/{word()}", f"/{word()}_{chars(lower + string.digits, 6, 12)}.{word(2, 4)}?{word(1, 3)}={n(100, 1200)}",
            f"/{chars(upper + string.digits, 8, 12)}?{word(2, 4)}={word(2, 3)}_{n(1, 9)}_{n(1, 9)}#{word()}", f"/20{n(10, 29)}/{n(10, 12)}/{word()}-{word()}-{word()}-{chars(lower + string.digits, 8, 14)}/",
        )),
        f"arXiv:{n(10, 29)}{n(10, 12)}.{n(10000, 29999)}{r.choice(('', 'v1', 'v3'))}", f"{word(3, 6)}-{word(2, 4)}/{n(90, 99)}{n(10, 12)}{n(100, 999)}", f"10.{n(1000, 99999)}/{word(1, 5)}{n(1000, 99999)}-0{n(10, 99)}-{n(10000, 99999)}-{n(0, 9)}", f"doi:10.{n(1000, 9999)}/{word(2, 6)}.{n(1990, 2029)}.{n(1000, 99999)}", f"PMC{n(100000, 9999999)}",
        ":".join(chars("ABCDEF" + string.digits, 2, 2) for _ in range(6)), ":".join(chars("abcdef" + string.digits, 3, 4) for _ in range(8)), f"{word()}.{chars('abcdef' + string.digits, 8, 12)}.{r.choice(('js', 'css', 'png'))}", f"IMG_20{n(10, 29)}{n(10, 12)}{n(10, 28)}_{n(100000, 235959)}.jpg", chars("abcdef" + string.digits, 7, 10),
        f"{word(2, 4)}.{word()}.{word()}:{word()}-{word()}{n(1, 9)}:{n(1, 9)}.{n(10, 20)}.{n(0, 9)}", f"{word(2, 4).upper()}-{word(1, 3).upper()}{n(10, 99)}{word(2, 4).upper()}-{n(10, 99)}{word(1, 2).upper()}{n(10, 99)}", f"{word()}@{word()}.com:{word()}/{word()}.{word(2, 3)}", f"({word(3, 9).capitalize()}{n(1990, 2029)}{word(3, 8)})",
    )), 0, 0


def spliced(text: str, spans: list[tuple[int, int]], r: random.Random, pieces: int = SPLICES) -> tuple[str, list[tuple[int, int]], list[tuple[int, int]]]:
    """The text with generated pieces between its tokens, the secrets in it and the places of the pieces."""
    gaps = [m.start() for m in re.finditer(r"(?<=\S)[\x20\x09-\x0D]", text)]
    gaps = [g for g in gaps if not any(s < g < e for s, e in spans)]
    cuts = sorted(r.sample(gaps, min(pieces, len(gaps)))) if gaps else [0]
    out, kept, places, at, size = [], [], [], 0, 0

    def add(piece: str) -> None:
        nonlocal size
        out.append(piece)
        size += len(piece)

    moved = []
    for cut in cuts:
        add(text[at:cut])
        at = cut
        piece, start, end = generated_piece(r)
        add(" ")
        if end:
            kept.append((size + start, size + end))
        places.append((size, size + len(piece)))
        moved.append((cut, len(piece) + 2))
        add(piece + " ")
    add(text[at:])
    kept += [(s + d, e + d) for s, e in spans for d in [sum(n for cut, n in moved if cut <= s)]]
    return "".join(out), kept, places


def _marked(tokens, data: np.ndarray, offsets: np.ndarray, spans: list[list[tuple[int, int]]]) -> np.ndarray:
    """Tags of the tokens from each text's spans (code points)."""
    point, tags = _code_points(data), np.zeros(len(tokens.start), np.int64)
    for d, own in enumerate(spans):
        for start, end in own:
            low, high = np.searchsorted(point, [point[offsets[d]] + start, point[offsets[d]] + end], "left")
            first, last = np.searchsorted(tokens.end, low, "right"), np.searchsorted(tokens.start, high, "left")
            if last > first and not tags[first:last].any():
                tags[first:last] = INSIDE
                tags[first] = BEGIN
    return tags


def _lessons(batch: pa.RecordBatch, leave_out: str) -> Iterator[tuple]:
    """(data, offsets, spans, places) of each block of training texts: as they are, and spliced. places: what windows look
    at besides (the generated pieces). Spans of the kind left out are dropped, and their texts are not used as they are."""
    for part in blocks(batch, "text"):
        texts = part.column(0).to_pylist()
        base = [base_spans(t) for t in texts]
        use = [i for i, b in enumerate(base) if not any(k == leave_out for *_, k in b)]
        plain = [(texts[i], [(s, e) for s, e, _ in base[i]], []) for i in use]
        mixed = [spliced(t, s, random.Random(hashlib.sha256(t.encode()).digest())) for t, s, _ in plain]
        for lesson in (plain, mixed):
            column = pa.array([t for t, *_ in lesson], pa.string())
            yield *utf8(column), [s for _, s, _ in lesson], [p for *_, p in lesson]


def sample_texts(docs: DataFrame, n_with: int, n_without: int) -> DataFrame:
    """(text): at most n_with texts with base spans and n_without others, in hash order, each text once."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                data, offsets = utf8(part.column(1))
                found = np.zeros(part.num_rows, bool)
                for d in _suspects(data, offsets).tolist():
                    found[d] = bool(base_spans(data[offsets[d] : offsets[d + 1]].tobytes().decode()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["_h", "_m"])

    some = docs.where(F.length("text") > 0)
    marked = materialize(some.select(F.xxhash64("text").alias("_h"), "text").mapInArrow(mark, "_h long, _m boolean"), "secret-marks")
    few = lambda m, n: marked.where(m).select("_h").distinct().orderBy("_h").limit(n)
    picked = few("_m", n_with).unionByName(few("NOT _m", n_without))
    # only hashes are ranked; at most n_with + n_without of them are joined back to their texts
    chosen = some.select("text", F.xxhash64("text").alias("_h")).join(F.broadcast(materialize(picked, "secret-picked")), "_h").dropDuplicates(["_h"])
    return materialize(chosen, "secret-sample").repartition(8, "_h").select("text")


def train(docs: DataFrame, n_with: int = TRAIN_WITH, n_without: int = TRAIN_WITHOUT, leave_out: str = "") -> Model | None:
    """Fit on windows of a bounded sample of texts, as they are and with pieces spliced in; None when there are no words.
    leave_out: a kind of base spans that training must not see (to measure what the CRF finds by itself)."""
    sample = sample_texts(docs, n_with, n_without)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list[int]] = {}
        for batch in batches:
            for data, offsets, spans, _ in _lessons(batch, leave_out):
                t, w = words(data, offsets, _TOKEN, hashed=False), words(data, offsets)
                tags, tok = _marked(t, data, offsets, spans), np.searchsorted(t.start, w.start, "right") - 1
                near = np.zeros(len(tags) + 4, bool)
                for shift in range(3):  # the span's own first token and the two before it
                    near[: len(tags)] |= np.concatenate([tags[shift:], np.zeros(shift, np.int64)])[: len(tags)] == BEGIN
                plain = (w.end - w.start) < 12
                for h, close in zip(w.hash[plain].tolist(), near[tok[plain]].tolist(), strict=True):
                    total.setdefault(h, [0, 0])[close] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.array(list(total), np.uint64).view(np.int64)), pa.array([v[1] for v in total.values()], pa.int64()), pa.array([v[0] for v in total.values()], pa.int64())], ["h", "close", "far"])

    counted = sample.mapInArrow(count, "h long, close long, far long").groupBy("h").agg(F.sum("close").alias("close"), F.sum("far").alias("far"))
    cues = np.sort(np.array([r["h"] for r in counted.where("close >= 5 AND close > far").orderBy(F.desc("close"), "h").limit(CUE_WORDS).collect()], np.int64).view(np.uint64))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, spans, places in _lessons(batch, leave_out):
                t = token_features(data, offsets, cues)
                if not len(t.start):
                    continue
                tags, pieces = _marked(t, data, offsets, spans), np.flatnonzero(_marked(t, data, offsets, places))
                odd = np.flatnonzero((t.x[:, 6] > 0) & (tags == 0))
                centres = np.unique(np.concatenate([np.flatnonzero(tags == BEGIN), pieces, odd, np.arange(0, len(tags), 97)]))
                at = centres[:, None] + np.arange(-WINDOW, WINDOW + 1)
                inside = (at >= 0) & (at < len(tags))
                at = np.clip(at, 0, len(tags) - 1)
                used = inside & (t.doc[at] == t.doc[centres][:, None])
                k = t.x.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.uint8).tobytes() for r in t.x[at].reshape(len(at), -1)], pa.binary()), pa.array([r.astype(np.uint8).tobytes() for r in tags[at]], pa.binary()), pa.array([r.astype(np.uint8).tobytes() for r in used], pa.binary()), pa.array([k] * len(at), pa.int32())], ["x", "y", "used", "k"])

    cut = sample.mapInArrow(windows, "x binary, y binary, used binary, k int").dropDuplicates(["x", "y", "used"]).withColumn("_h", F.xxhash64("x", "y", "used"))
    cut = materialize(cut.withColumn("_b", F.contains("y", F.lit(bytes([BEGIN])))), "secret-windows")
    got = cut.where("_b").orderBy("_h").limit(TRAIN_WINDOWS // 2).unionByName(cut.where("NOT _b").orderBy("_h").limit(TRAIN_WINDOWS // 2)).toPandas().sort_values("_h", kind="stable")
    if got.empty or not any(BEGIN in y for y in got["y"]):
        return None
    k = int(got["k"].iloc[0])
    x = np.stack([np.frombuffer(v, np.uint8) for v in got["x"]]).reshape(len(got), 2 * WINDOW + 1, k).astype(np.float32)
    y, used = (np.stack([np.frombuffer(v, np.uint8) for v in got[c]]) for c in ("y", "used"))
    # a masked place before the window's first used one must not start the chain: move used places to the front
    order = np.argsort(~used.astype(bool), axis=1, kind="stable")
    x, y, used = np.take_along_axis(x, order[..., None], 1), np.take_along_axis(y, order, 1).astype(int), np.take_along_axis(used, order, 1).astype(bool)
    return Model(cues, *fit(x, y, used))


def new_characters(text: str, start: int, base: list[tuple[int, int, str]]) -> int:
    """Letters and digits of the text (which begins at start) outside the base spans."""
    return sum(c.isalnum() and not any(s <= i < e for s, e, _ in base) for i, c in enumerate(text, start))


def scan(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_added of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in blocks(batch, "text"):
                data, offsets = utf8(part.column(1))
                base: dict[int, list[tuple[int, int, str]]] = {}
                for d in _suspects(data, offsets).tolist():
                    if found := base_spans(data[offsets[d] : offsets[d + 1]].tobytes().decode()):
                        base[d] = found
                added: dict[int, list[tuple[int, int, str]]] = {}
                if model is not None:
                    tokens, point = token_features(data, offsets, model.cues), _code_points(data)
                    for a, b in crf_spans(model, tokens):
                        d, low, high = int(tokens.doc[a]), int(tokens.start[a]), int(tokens.end[b])
                        text = data[low:high].tobytes().decode()
                        start = int(point[low] - point[offsets[d]]) + len(text) - len(text.lstrip(_TRIM))
                        text = text.strip(_TRIM)
                        end = start + len(text)
                        if new_characters(text, start, [s for s in base.get(d, ()) if s[0] < end and start < s[1]]) >= MIN_NEW:
                            added.setdefault(d, []).append((start, end, "crf"))
                counts, digests, spans, extra = np.zeros((3, part.num_rows), np.int64), [], [], np.zeros(part.num_rows, np.int64)
                empty = hashlib.sha256(b"").hexdigest()
                for d in range(part.num_rows):
                    own, more = base.get(d, []), added.get(d, [])
                    for *_, kind in own:
                        counts[KINDS.index(kind), d] += 1
                    extra[d] = len(more)
                    digests.append(hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in own).encode()).hexdigest() if own else empty)
                    spans.append(",".join(f"{k}:{s}:{e}" for s, e, k in sorted([*own, *more], key=lambda x: (x[0], KINDS.index(x[2])))))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, counts), pa.array(digests), pa.array(spans, pa.string()), pa.array(extra)], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long")


def find_secrets(docs: DataFrame) -> DataFrame:
    return scan(docs, train(docs))
