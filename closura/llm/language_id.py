"""Language identification, family first (operator 2).

A text is lower-cased, runs of what is not a letter become one blank, and its byte
1- to 4-grams are hashed.  Their relative frequencies, each divided by its deviation
in the sample, feed linear support vector machines (squared hinge, trained in the
primal by Newton steps with conjugate gradients): one against one between families,
then one against one between the languages of the chosen family.

The machines are fitted on the driver to a sample of at most about ``per_lang``
documents a language (chosen by a hash of the id, so that it doesn't depend on the
partitions), of which only hashed counts are collected.  All documents are predicted,
on whole texts, with a table of weights of a fixed size.

Cases: null text, or one without a letter, is ``und`` with score 0; rows without a
language are not learnt from; with one language only it is always predicted, with
score 1; with none, all is ``und``; repeated rows and extra columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import lean, slices, texts

BITS = 16  # of the hashed feature space
FEATURES = 4096  # features kept, the most frequent ones
PER_LANG = 800  # documents a language in the sample
ORDERS = (1, 2, 3, 4)

#: Families of ISO 639-1 codes (fixed values).  Another code is a family of its own.
FAMILIES = {
    "germanic": "en de nl af sv da no nb nn is fy lb",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk tt",
    "iranian": "fa ku ps tg",
    "indic": "hi ur bn pa gu mr ne si",
    "dravidian": "ta te kn ml",
    "semitic": "ar he mt am",
    "celtic": "ga cy gd br",
    "sinitic": "zh",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

LETTER = np.zeros(256, bool)
LETTER[0x61:0x7B] = True
LETTER[0x80:] = True
ASCII_LETTER = np.zeros(256, bool)
ASCII_LETTER[0x61:0x7B] = True
_multipliers = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Offsets of the normalised rows, hashed n-grams of each order by start, and the
    normalised rows' lengths.  Past a row's end there are blanks, so a text's grams are
    its own, whatever row comes next."""
    letter = LETTER[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first other byte after a letter stands for the run
    edge = np.zeros(len(raw) + 1, bool)
    edge[offs] = True
    keep &= letter | ~edge[:-1]
    counts = np.concatenate([[0], np.cumsum(keep)])
    at = counts[offs]
    body = np.where(letter, raw, 32)[keep].astype(np.uint32)
    padded = np.concatenate([body, np.full(4, 32, np.uint32)])
    n = len(body)
    out, h = [], np.zeros(n, np.uint32)
    for k in range(len(ORDERS)):
        ahead = padded[k : k + n].copy()
        for j in range(1, k + 1):
            p = at[1:] - j
            ahead[p[p >= at[:-1]]] = 32
        h = (h + ahead + np.uint32(1)) * _multipliers[k]
        out.append(((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BITS))
    return at, out, np.diff(at)


def has_letter(raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
    seen = np.concatenate([[0], np.cumsum(ASCII_LETTER[raw])])
    out = np.diff(seen[offs]) > 0
    for r in np.flatnonzero(~out & (np.diff(offs) > 0)):
        out[r] = any(map(str.isalpha, raw[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "ignore")))
    return out


def counted(docs: DataFrame) -> DataFrame:
    """label, packed: hashed features (uint16) and their frequencies (float32)."""

    def run(batches):
        for batch in batches:
            packed, keep = [], []
            for a, b, raw, offs in slices(pc.utf8_lower(texts(batch.column("text")))):
                ok = has_letter(raw, offs)
                at, orders, n = grams(raw, offs)
                for r in range(b - a):
                    keep.append(bool(ok[r]))
                    c = sum(np.bincount(o[at[r] : at[r + 1]], minlength=1 << BITS) for o in orders)
                    f = np.flatnonzero(c)
                    packed.append(f.astype(np.uint16).tobytes() + (c[f] / max(1, n[r])).astype(np.float32).tobytes())
            rows = pa.RecordBatch.from_arrays([batch.column("label"), pa.array(packed, pa.binary())], names=["label", "packed"])
            yield rows.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(lean(run), "label string, packed binary")


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights, the bias last, of an L2-regularised squared-hinge machine; y is +-1."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1], x.dtype)
    c = c / len(x)
    for _ in range(steps):
        slack = 1 - y * (x @ w)
        on = slack > 0
        xa = x[on]
        grad = w - 2 * c * (xa.T @ (y[on] * slack[on]))
        if np.linalg.norm(grad) < 1e-4:
            break
        d, r = np.zeros_like(w), -grad
        p, rr = r.copy(), float(r @ r)
        for _ in range(40):
            hp = p + 2 * c * (xa.T @ (xa @ p))
            alpha = rr / float(p @ hp)
            d += alpha * p
            r -= alpha * hp
            new = float(r @ r)
            if new < 1e-8 * float(grad @ grad):
                break
            p = r + (new / rr) * p
            rr = new
        loss = lambda v: 0.5 * float(v @ v) + c * float((np.maximum(0, 1 - y * (x @ v)) ** 2).sum())
        step, now = 1.0, loss(w)
        while step > 1e-4 and loss(w + step * d) > now:
            step /= 2
        w = w + step * d
    return w


class Model:
    """tests: (one, other) pairs of families or of languages, a column of ``weights``
    each; a positive margin speaks for ``one``."""

    def __init__(self, langs: list[str], tests: list[tuple[str, str]], weights: np.ndarray, bias: np.ndarray, families: dict[str, list[str]]):
        self.langs, self.tests, self.weights, self.bias, self.families = langs, tests, weights, bias, families

    def predict(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(margins)
        family, sure = self._elect(sorted(self.families), margins, np.ones(n, bool))
        langs, score = np.empty(n, object), np.ones(n)
        for f, members in self.families.items():
            mine = family == f
            if mine.any():
                best, s = self._elect(sorted(members), margins[mine], np.ones(mine.sum(), bool))
                langs[mine], score[mine] = best, np.minimum(s, sure[mine])
        return langs.tolist(), score

    def _elect(self, names: list[str], margins: np.ndarray, _) -> tuple[np.ndarray, np.ndarray]:
        """The name with the most won duels, then the largest sum of margins, and the
        logistic of its narrowest duel."""
        n = len(margins)
        wins, total, least = np.zeros((n, len(names))), np.zeros((n, len(names))), np.full((n, len(names)), np.inf)
        place = {x: i for i, x in enumerate(names)}
        for k, (one, other) in enumerate(self.tests):
            if one in place and other in place:
                for name, m in ((one, margins[:, k]), (other, -margins[:, k])):
                    i = place[name]
                    wins[:, i] += m > 0
                    total[:, i] += m
                    least[:, i] = np.minimum(least[:, i], m)
        best = np.argmax(wins + 1e-3 * np.tanh(total), axis=1)
        rows = np.arange(n)
        return np.array(names, object)[best], 1 / (1 + np.exp(-2 * np.minimum(least[rows, best], 30)))


def fit(docs: DataFrame, per_lang: int = PER_LANG, families: dict[str, str] | None = None) -> Model | None:
    """From ``text`` and ``lang`` of ``docs``; doc_id only chooses the sample."""
    family_of = FAMILY_OF if families is None else families
    known = docs.where(F.col("lang").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not sizes:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_lang / n))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / float(1 << 30)
    rows = counted(known.where(draw < share).select(F.col("lang").alias("label"), F.col("text").cast("string").alias("text"))).toArrow()
    labels = np.array(rows.column("label").to_pylist(), object)
    packed = rows.column("packed").to_pylist()
    order = sorted(range(len(packed)), key=lambda i: (labels[i], packed[i]))  # whatever order they came in
    labels, packed = labels[order], [packed[i] for i in order]
    sparse = [(np.frombuffer(p, np.uint16, len(p) // 6), np.frombuffer(p, np.float32, offset=len(p) // 6 * 2)) for p in packed]
    total = np.zeros(1 << BITS)
    for f, v in sparse:
        total[f] += v
    chosen = np.sort(np.argsort(-total, kind="stable")[:FEATURES])
    place = np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    x = np.zeros((len(sparse), len(chosen)), np.float32)
    for i, (f, v) in enumerate(sparse):
        at = place[f]
        x[i, at[at >= 0]] = v[at >= 0]
    scale = 1 / (x.std(axis=0) + 1e-4)
    mean = x.mean(axis=0) if len(x) else np.zeros(len(chosen), np.float32)
    x = (x - mean) * scale / np.sqrt(len(chosen))
    langs = sorted(set(labels))
    groups: dict[str, list[str]] = {}
    for lang in langs:
        groups.setdefault("family:" + family_of.get(lang, lang), []).append(lang)
    own = np.array(["family:" + family_of.get(lang, lang) for lang in labels], object)
    tests, columns = [], []
    for names, who in [(sorted(groups), own)] + [(sorted(m), labels) for m in groups.values()]:
        for i, one in enumerate(names):
            for other in names[i + 1 :]:
                on = (who == one) | (who == other)
                tests.append((one, other))
                columns.append(fit_svm(x[on], np.where(who[on] == one, 1, -1).astype(np.float32), c=100.0))
    weights = np.zeros((1 << BITS, max(1, len(tests))), np.float32)
    bias = np.zeros(max(1, len(tests)), np.float32)
    for k, w in enumerate(columns):
        v = w[:-1] * scale / np.sqrt(len(chosen))
        weights[chosen, k] = v
        bias[k] = w[-1] - mean @ v
    return Model(langs, tests, weights, bias, groups)


def predict(docs: DataFrame, model: Model | None, *more: Column) -> DataFrame:
    """doc_id, ``more``, lang_pred, score."""
    rows = docs.select("doc_id", *more, F.col("text").cast("string").alias("text"))
    names = rows.columns[:-1]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            pred: list[str] = []
            score: list[np.ndarray] = []
            for a, b, raw, offs in slices(pc.utf8_lower(texts(batch.column("text")))):
                ok = has_letter(raw, offs) & (model is not None)
                lang, s = ["und"] * (b - a), np.zeros(b - a)
                if ok.any():
                    at, orders, n = grams(raw, offs)
                    sums = model.weights[orders[0]]
                    for o in orders[1:]:
                        sums += model.weights[o]
                    rows = np.flatnonzero(ok)
                    some = np.flatnonzero(np.diff(at) > 0)
                    m = np.tile(model.bias, (b - a, 1))
                    if len(some):
                        m[some] += np.add.reduceat(sums, at[some], axis=0, dtype=np.float32) / n[some, None]
                    got, sure = model.predict(m[rows])
                    for r, x, y in zip(rows, got, sure, strict=True):
                        lang[r], s[r] = x, y
                pred += lang
                score.append(s)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in names] + [pa.array(pred, pa.string()), pa.array(np.concatenate(score) if score else [], pa.float64())], names=[*names, "lang_pred", "score"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
    return rows.mapInArrow(lean(run), kinds + ", lang_pred string, score double")


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
