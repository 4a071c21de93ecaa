"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds
what they don't know (operator 4).

Patterns, leftmost and non-overlapping for each kind:

* assign: a keyword, ``:`` or ``=``, and a value (group 2) of 12 characters or more;
* access: ``AKIA`` and capitals or digits, 18 characters or more;
* hex: 16 or more of ``[0-9a-f]``.

The field tags tokens (runs of what is neither blank nor quote) as begin, inside or
outside a secret, from the token's shape, entropy and prefixes, the words before and
after it, and features of the file (lines that look like settings or code).  Three kinds of
tokens may be part of a secret: of ``LEAST`` ASCII characters with a digit or a change of letter case
inside; of any form, if ``CUED`` stands right before it (a word for a secret, and ``:``, ``=``, "is" or
"was"); and the lines of a private key's block, which are one chain.  All others are held to be outside,
so only the runs of these are decoded, by Viterbi, exactly as if the whole text were.  An
inside tag never follows an outside one.  The field is trained here, by gradient
steps on the conditional likelihood: on generated lines that hold public formats of
credentials, weak passwords after such words, key blocks, and the look-alikes that aren't
(numbers of cards, addresses, hashes in paths, versions, long words).

Cases: null or empty text has no spans; spans are in code points, end exclusive; of two
spans at one place the patterns' goes first; a span of the field that overlaps a pattern's goes;
repeated rows are scanned alike; extra columns are not read.  A task holds one text of any
length, in about 20 times its size.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import lean

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # whole runs of [0-9a-f], those of 16 or more
KINDS = ("assign", "access", "hex")
LEAST = 12  # characters of a token that the field may tag
SHORT = 6  # the same, after a word for a secret
TOKEN = re.compile(r"[^\s\"'`<>(){}\[\],;|]+")
TAGS = ("B", "I", "O")
BITS = 13  # of the field's hashed features
MARGIN = 1.0  # log-odds that an added span must have over being outside


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the patterns' matches."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(2), m.end(2), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    if DIGIT_OR_RUN.search(text):
        out += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], s[2]))


DIGIT_OR_RUN = re.compile(r"[0-9a-f]{16}")
SOME = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]")  # every token that may be tagged has one


def eligible(token: str) -> bool:
    if len(token) < LEAST:
        return False
    body = token.strip(".:!?*#$%&-_=/")
    return body.isascii() and SOME.search(body) is not None


#: What stands before a value of any form (fixed values).
CUED = re.compile(r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|(?:api|private|access)[_ -]?key)s?[\"']?(?:[ \t]{0,3}[:=]+[ \t]{0,3}|[ \t]{1,3}(?:is|was)[ \t]{1,3})[\"'`]?", re.IGNORECASE | re.ASCII)
HINTS = ("pass", "pwd", "secret", "token", "credential", "key")
BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s((?:\s*[A-Za-z0-9+/=]{4,}[^\S\n]*\n)+)\s*-----END")  # one way to read blank lines
LINE = re.compile(r"[A-Za-z0-9+/=]{4,}")


def cued(tokens: list[str], i: int) -> bool:
    """As ``CUED``, on tokens."""
    before = " ".join(tokens[max(0, i - 2) : i]) + " "
    return len(tokens[i]) >= SHORT and any(m.end() == len(before) for m in CUED.finditer(before))


def shape(token: str) -> str:
    out: list[str] = []
    for c in token:
        k = "d" if c.isdigit() else "x" if c.islower() else "X" if c.isupper() else c if c in "+/_.=-:@%" else "o"
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out[:8])


def entropy(token: str) -> float:
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in (token.count(c) for c in set(token)))


#: Words near a secret (fixed values).
CUES = ("password", "passwd", "pwd", "secret", "token", "key", "api", "apikey", "auth", "bearer", "credential", "private", "access", "authorization")
#: Prefixes that issuers of credentials publish (fixed values).
PREFIXES = ("ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "sk-", "AIza", "ya29.", "eyJ", "npm_", "pypi-", "SG.", "AKIA", "ASIA", "hf_", "dop_v1_")


def features(tokens: list[str], i: int, file: str) -> list[str]:
    t = tokens[i]
    before, after = tokens[i - 1].lower() if i else "^", tokens[i + 1].lower() if i + 1 < len(tokens) else "$"
    kinds = (any(map(str.isdigit, t)), any(map(str.islower, t)), any(map(str.isupper, t)), any(not c.isalnum() for c in t))
    changes = sum(a.isdigit() != b.isdigit() or a.isupper() != b.isupper() for a, b in zip(t, t[1:], strict=False))
    out = [
        "1", f"shape={shape(t)}", f"len={min(8, len(t) // 6)}", f"ent={round(2 * entropy(t))}", f"mix={kinds}", f"chg={min(8, 10 * changes // len(t))}",
        f"file={file}", f"end={before[-1:]}", f"cue={any(c in before for c in CUES)}", f"after={after[:1] in '-#/' }",
        f"own={any(c in t.lower() for c in CUES)}", f"url={'://' in t}", f"at={'@' in t}", f"dots={min(4, t.count('.'))}", f"slash={min(4, t.count('/'))}", f"dash={min(5, t.count('-'))}",
        f"num={t.strip('.,:').replace('.', '').replace('-', '').isdigit()}",
    ]
    out += [f"pre={p}" for p in PREFIXES if t.startswith(p) or f"={p}" in t or f":{p}" in t]
    if i > 1:
        out.append(f"cue2={any(c in tokens[i - 2].lower() for c in CUES)}")
    return out


def coded(names: list[str]) -> list[int]:
    return [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=4).digest(), "little") & ((1 << BITS) - 1) for x in names]


def file_kind(text: str) -> str:
    head = text.count("=") + text.count("{") + text.count(";")
    return "code" if 40 * head > len(text) else "prose"


class Field:
    """weights[feature, tag] and steps[tag, tag]; outside before the first token."""

    def __init__(self, weights: np.ndarray, steps: np.ndarray):
        self.weights, self.steps = weights, steps

    def scores(self, tokens: list[str], lo: int, hi: int, file: str) -> np.ndarray:
        return np.array([self.weights[coded(features(tokens, i, file))].sum(axis=0) for i in range(lo, hi)])

    def viterbi(self, emit: np.ndarray) -> list[int]:
        """Best tags of a run with outside tokens on both sides."""
        steps = self.steps.copy()
        steps[2, 1] = -np.inf  # a secret begins with B
        best = steps[2] + emit[0]
        back = []
        for e in emit[1:]:
            total = best[:, None] + steps
            back.append(total.argmax(axis=0))
            best = total.max(axis=0) + e
        tag = int((best + self.steps[:, 2]).argmax())
        out = [tag]
        for b in reversed(back):
            tag = int(b[tag])
            out.append(tag)
        return out[::-1]


def _generated(rng: random.Random) -> tuple[list[str], list[int], str]:
    """A line's tokens and tags."""
    alnum = string.ascii_letters + string.digits
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    word = lambda: pick(string.ascii_lowercase, 2, 11)
    secret = [
        lambda: "ghp_" + pick(alnum, 36, 36), lambda: "sk_live_" + pick(alnum, 24, 32), lambda: "xoxb-" + pick(string.digits, 11, 12) + "-" + pick(alnum, 24, 24),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16, 16), lambda: "AIza" + pick(alnum + "_-", 35, 35), lambda: "glpat-" + pick(alnum + "_-", 20, 20),
        lambda: "eyJ" + pick(alnum, 20, 40) + "." + pick(alnum + "_-", 30, 60) + "." + pick(alnum + "_-", 30, 43), lambda: pick("0123456789abcdef", 32, 40), lambda: pick(alnum + "+/", 40, 44) + "=",
        lambda: pick(alnum, 20, 40), lambda: pick(alnum + "!@#%", 14, 24), lambda: "hf_" + pick(alnum, 34, 34), lambda: "npm_" + pick(alnum, 36, 36),
    ]
    plain = [
        lambda: pick(string.digits, 12, 19), lambda: f"{word()}.{word()}@{word()}.com", lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"https://{word()}.{word()}.org/{word()}/{rng.randint(1, 9999)}",
        lambda: f"20{rng.randint(10, 29)}-0{rng.randint(1, 9)}-1{rng.randint(0, 9)}T10:{rng.randint(10, 59)}:00Z", lambda: f"{word()}_{word()}_{rng.randint(1, 99)}.{word()[:3]}", lambda: f"/usr/{word()}/{word()}-{rng.randint(1, 9)}.{rng.randint(0, 20)}",
        lambda: word() + word().capitalize() + word().capitalize(), lambda: word() + pick("$%&*#", 3, 3) + str(rng.randint(1, 99)), lambda: f"+{rng.randint(1, 99)}-{pick(string.digits, 3, 4)}-{pick(string.digits, 7, 8)}",
        lambda: f"{word()}-{word()}-{rng.randint(1, 40)}.{rng.randint(0, 9)}", lambda: (word() + word()).capitalize() + str(rng.randint(1990, 2030)), lambda: f"{pick('0123456789abcdef', 8, 8)}-{word()}", lambda: "-".join(pick(string.digits, 4, 4) for _ in range(4)),
    ]
    weak = [
        lambda: word() + pick(string.digits, 1, 4), lambda: "-".join(word() for _ in range(rng.randint(3, 5))), lambda: pick(string.ascii_lowercase, 15, 28), lambda: word().capitalize() + pick("!@#%&", 1, 2) + pick(string.digits, 1, 4),
        lambda: pick(alnum + "!@#%", 8, 11), lambda: (word() + pick(string.digits, 1, 2)) * 2,
    ]
    none = [lambda: pick(string.ascii_lowercase, 6, 12), lambda: pick(string.ascii_lowercase, 6, 10).capitalize(), lambda: f"{word()}.{word()}", lambda: f"{word()}_{word()}", lambda: f"${word().upper()}_{word().upper()}"]
    if rng.random() < 0.05:  # a private key
        width, n = rng.choice([64, 64, 76]), rng.randint(2, 12)
        lines = [pick(alnum + "+/", width, width) for _ in range(n)] + [pick(alnum + "+/", 4, width - 2) + "="]
        return ["-----BEGIN", "PRIVATE", "KEY-----", *lines, "-----END"], [2, 2, 2, 0, *[1] * n, 2], "prose"
    tokens, tags = [], []
    for _ in range(rng.randint(3, 9)):
        roll = rng.random()
        if roll < 0.08:
            tokens += [rng.choice(["password", "Password", "pwd", "passphrase", "secret", "token", "db_pass", "api_key"]), rng.choice(["=", ":", "is", "was"])]
            found = rng.random() < 0.5
            tokens.append(rng.choice(weak if found else none)())
            tags += [2, 2, 0 if found else 2]
        elif roll < 0.2:
            if rng.random() < 0.75:
                cue = rng.choice(CUES)
                tokens += [rng.choice([cue, cue.upper(), f"{word()}_{cue}"]), rng.choice(["=", ":", "is"])]
                tags += [2, 2]
            parts = [rng.choice(secret)()]
            if rng.random() < 0.1:
                parts.append(rng.choice(secret)())
            tokens += parts
            tags += [0] + [1] * (len(parts) - 1)
        elif roll < 0.5:
            tokens.append(rng.choice(plain)())
            tags.append(2)
        else:
            tokens.append(rng.choice([word(), word().capitalize(), word() + ","]))
            tags.append(2)
    return tokens, tags, rng.choice(["code", "prose"])


def train(lines: int = 2500, epochs: int = 4, seed: int = 11, rate: float = 0.3) -> Field:
    """Stochastic gradient (Adagrad) on the conditional likelihood of generated lines."""
    rng = random.Random(seed)
    data = []
    for _ in range(lines):
        tokens, tags, file = _generated(rng)
        i = 0
        may = [eligible(t) or cued(tokens, k) or tokens[0] == "-----BEGIN" and 2 < k < len(tokens) - 1 for k, t in enumerate(tokens)]
        while i < len(tokens):
            if not may[i]:
                i += 1
                continue
            j = i
            while j < len(tokens) and may[j]:
                j += 1
            run = tags[i:j]
            run = [0 if t == 1 and (not k or run[k - 1] == 2) else t for k, t in enumerate(run)]
            data.append(([coded(features(tokens, k, file)) for k in range(i, j)], run))
            i = j
    weights, steps = np.zeros((1 << BITS, 3)), np.zeros((3, 3))
    steps[2, 1] = -np.inf  # an inside tag doesn't follow an outside one
    gw, gs = np.full((1 << BITS, 3), 1e-2), np.full((3, 3), 1e-2)
    for _ in range(epochs):
        rng.shuffle(data)
        for feats, tags in data:
            n = len(tags)
            emit = np.array([weights[f].sum(axis=0) for f in feats])
            a, b = np.zeros((n, 3)), np.zeros((n, 3))
            a[0] = steps[2] + emit[0]
            for i in range(1, n):
                a[i] = emit[i] + np.logaddexp.reduce(a[i - 1][:, None] + steps, axis=0)
            b[-1] = steps[:, 2]
            for i in range(n - 2, -1, -1):
                b[i] = np.logaddexp.reduce(steps + emit[i + 1] + b[i + 1], axis=1)
            z = np.logaddexp.reduce(a[-1] + b[-1])
            p = np.exp(a + b - z)
            dsteps = np.zeros((3, 3))
            dsteps[2] += p[0]
            dsteps[:, 2] += p[-1]
            for i in range(1, n):
                dsteps += np.exp(a[i - 1][:, None] + steps + emit[i] + b[i] - z)
            path = [2, *tags, 2]
            for x, y in zip(path, path[1:], strict=False):
                dsteps[x, y] -= 1
            gs += dsteps**2
            steps -= rate * dsteps / np.sqrt(gs)
            for i, f in enumerate(feats):
                d = p[i].copy()
                d[tags[i]] -= 1
                gw[f] += d**2
                weights[f] -= rate * (d + 1e-4 * weights[f]) / np.sqrt(gw[f])
    return Field(weights, steps)


def _tokens(text: str) -> list[tuple[int, int, int]]:
    """Tokens that may be tagged, and the place of the key block that they are in, or -1."""
    out: dict[int, tuple[int, int]] = {}
    at = 0
    while m := SOME.search(text, at):
        a = m.start()
        while a > at and TOKEN.match(text[a - 1]):
            a -= 1
        b = TOKEN.match(text, a).end() if TOKEN.match(text[a]) else a + 1
        if eligible(text[a:b]):
            out[a] = (b, -1)
        at = b
    low = text.lower()
    if any(h in low for h in HINTS):
        for m in CUED.finditer(text):
            if (t := TOKEN.match(text, m.end())) and len(t.group()) >= SHORT:
                out.setdefault(m.end(), (t.end(), -1))
        if "-----BEGIN" in text:
            for m in BLOCK.finditer(text):
                out |= {x.start(): (x.end(), m.start()) for x in LINE.finditer(text, *m.span(1))}
    found: list[tuple[int, int, int]] = []
    for a, (b, block) in sorted(out.items()):
        if found and a < found[-1][1]:  # a value inside a longer token: the value
            found.pop()
        found.append((a, b, block))
    return found


def _runs(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring tokens that may be tagged."""
    out: list[list[tuple[int, int]]] = []
    last = -1
    for a, b, block in _tokens(text):
        end = out[-1][-1][1] if out else a
        if out and (block >= 0 and block == last or block == last and a - end < 80 and "\n" not in (gap := text[end:a]) and not TOKEN.search(gap)):
            out[-1].append((a, b))
        else:
            out.append([(a, b)])
        last = block
    return out


def field_spans(text: str, field: Field, margin: float = MARGIN) -> list[tuple[int, int]]:
    """(start, end) of the secrets that the field finds."""
    out: list[tuple[int, int]] = []
    runs = _runs(text)
    kind = file_kind(text) if runs else ""
    for run in runs:
        a, b = run[0][0], run[-1][1]
        low = max(0, a - NEAR)
        line = max(text.rfind("\n", low, a) + 1, low)
        # at the start of a line, the end of the one before
        before = TOKEN.findall(text[line:a])[-2:] or TOKEN.findall(text[max(0, line - NEAR) : line])[-2:]
        stop = text.find("\n", b, b + NEAR)
        after = TOKEN.findall(text[b : b + NEAR if stop < 0 else stop])[:1]
        tokens = before + [text[x:y] for x, y in run] + after
        emit = field.scores(tokens, len(before), len(before) + len(run), kind)
        emit[:, 2] += margin
        for (x, y), tag in zip(run, field.viterbi(emit), strict=True):
            if tag == 0:
                out.append((x, y))
            elif tag == 1:
                out[-1] = (out[-1][0], y)
    return [_trimmed(text, a, b) for a, b in out]


NEAR = 120  # characters of the line on either side whose words are looked at


def _trimmed(text: str, a: int, b: int) -> tuple[int, int]:
    """Without a keyword before ``=`` and the sentence's stops."""
    for sign in "=:":
        k = text.rfind(sign, a, b - SHORT)
        if k >= 0 and text[a:k].replace("_", "").replace("-", "").isalnum() and any(c in text[a:k].lower() for c in CUES):
            a = k + 1
            break
    while b > a and text[b - 1] in ".,:;!?*#$%&":
        b -= 1
    return a, b


def scan(docs: DataFrame, field: Field | None = None, redact: bool = False) -> DataFrame:
    """doc_id and ``spans``: array of (start, end, kind), the patterns' first for equal
    starts, then the field's (kind ``crf``) that overlap none of them.  With ``redact``, all
    columns of ``docs``, the text with each span replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(field or train())
    rows = docs if redact else docs.select("doc_id", F.col("text").cast("string").alias("text"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])

    def spans_of(text: str | None) -> list[tuple[int, int, str]]:
        if not text:
            return []
        base = base_spans(text)
        out = [(a, b, KINDS[k]) for a, b, k in base]
        joined: list[list[int]] = []
        for a, b, _ in base:
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(b, joined[-1][1])
            else:
                joined.append([a, b])
        starts = [a for a, _ in joined]
        for a, b in field_spans(text, shared.value):
            k = bisect_right(starts, b - 1) - 1  # the last joined span that begins before b
            if b > a and (k < 0 or joined[k][1] <= a):
                out.append((a, b, "crf"))
        return sorted(out, key=lambda s: (s[0], (*KINDS, "crf").index(s[2])))

    def run(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            spans = [spans_of(t) for t in texts]
            if not redact:
                flat = [{"start": a, "end": b, "kind": k} for s in spans for a, b, k in s]
                offs = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat, span))], names=["doc_id", "spans"])
                continue
            clean = [t if not s else _redacted(t, s) for t, s in zip(texts, spans, strict=True)]
            i = batch.schema.get_field_index("text")
            yield batch.set_column(i, batch.schema.field(i), pa.array(clean, batch.schema.field(i).type))

    return rows.mapInArrow(lean(run), rows.schema if redact else "doc_id long, spans array<struct<start: long, end: long, kind: string>>")


def _redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])
