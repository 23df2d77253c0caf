"""Personal data by candidate gradient boosting.

Base rules find well-formed emails, IP addresses, card and phone numbers; their spans always stay. High-recall generators
propose further, overlapping candidates: spelled-out emails, numbers with other separators, keys and passwords.
Boosted trees, written in numpy, score a candidate from its format and context, and a threshold per kind, calibrated
on a part of the sample the trees did not see, selects those that are redacted as well.

The trees are fitted on a sample bounded by ``Settings.rows`` documents (the smallest digests of the id) and
``Settings.chars`` characters each. Positives are base spans, and rewritten forms set into the sample's own contexts;
negatives are near misses set there alike (dates, versions, decimals, failed checksums, paths, slugs, digests, UUIDs), and
candidates of number kinds that no base rule confirms. Every text is then scanned whole, map-only.

Defined cases: null text is empty and has no spans; positions are code points; repeated rows, null ids and extra columns
change nothing; where the sample offers nothing to learn from, the base spans are the result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import content_key, keyed, small_batches

KINDS = ("email", "ip", "card", "phone", "secret")


@dataclass(frozen=True)
class Settings:
    rows: int = 1500
    chars: int = 20_000
    trees: int = 60
    depth: int = 3
    rate: float = 0.2
    precision: float = 0.98
    floor: float = 0.6
    seed: int = 5


# The base rules. Possessive runs and the look-behind match the same spans in linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost emails, one ``@`` at a time: the local part is the run of its characters before it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            done = domain.end()
            yield begin, done
        else:
            done = max(done, at + 1)
        at = text.find("@", done)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of the base rules by kind, in order; matches that fail their check are dropped."""
    found = {"email": list(_emails(text)) if "@" in text else [], "ip": [], "card": [], "phone": []}
    for m in _IP.finditer(text):
        if all(int(x[-4:] if x[:-4].strip("0") == "" else "999") <= 255 for x in m.group().split(".")):
            found["ip"].append(m.span())
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            found["phone"].append(m.span())
    return found


_DOT = r"(?:\s?(?:\(dot\)|\[dot\])\s?|\sdot\s|\s?\.\s?)"
_SPELT = r"(?:\s?(?:\(dot\)|\[dot\])\s?|\sdot\s)"
GENERATORS = tuple((kind, re.compile(pattern)) for kind, pattern in (
    ("email", r"(?<![\w.%+-])[\w.%+-]{1,64}(?:\s?@\s?|\s?(?:\(at\)|\[at\])\s?)[A-Za-z0-9-]{1,63}(?:" + _DOT + r"[A-Za-z0-9-]{1,63}){1,4}"),
    ("email", r"(?<![\w.%+-])[\w.%+-]{1,64}\sat\s[A-Za-z0-9-]{1,63}(?:" + _SPELT + r"[A-Za-z0-9-]{1,63}){1,4}"),
    ("ip", r"(?<![0-9.])[0-9]{1,3}(?:\s?[.,:]\s?[0-9]{1,3}){3}(?![0-9])"),
    ("ip", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){4,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{0,2}[0-9]{2,6}){2,5}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\+|00|\()?[0-9][0-9\x20().\-/]{6,20}[0-9](?![0-9])"),
    ("secret", r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+"),
))

_CONTEXT = tuple(re.compile(p) for p in (
    r"e-?mail|mailto|contact|correo|courriel", r"\bip\b|host|server|addr|login", r"card|visa|carte|karte|tarjeta|credit",
    r"phone|tel|call|fax|mobil|appel|anruf|whatsapp", r"key|token|secret|passw|pwd|auth|bearer|credential"))
#: What every candidate holds: a digit, an at sign, a spelled-out "at" or "dot", or two colon-separated hex groups.
_NEEDED = re.compile(r"[0-9@]|\(at\)|\[at\]|\(dot\)|\[dot\]|\sdot\s|[A-Fa-f]:[A-Fa-f]")
_ENDING = re.compile(r"[.)\]\s](?:com|org|net|edu|gov|info|io|co|uk|eu|de|fr|es)$")
#: A piece of a name, path or slug: a word that can be spoken, with a few figures behind it at most; a year or small number
_WORDY = re.compile(r"[A-Z]?(?=[a-z]*[aeiouy])(?![a-z]*[bcdfghjklmnpqrstvwxz]{5})[a-z]{2,14}[0-9]{0,2}|[0-9]{1,4}")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_DIGEST = re.compile(r"(?:[0-9a-f]{40}|[0-9a-f]{64})")
_NAMED = re.compile(r"commit|sha-?\d|digest|checksum|revision|uuid|guid|http|www|path|file|see |\bid\b")
_PREFIX = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|sk-|sk_live|xox[bp]-|AIza|eyJ)")


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping candidate spans of all generators."""
    if not _NEEDED.search(text):
        return []
    found = []
    for kind, pattern in GENERATORS:
        for m in pattern.finditer(text):
            if kind != "secret" or (any("0" <= c <= "9" for c in m.group()) and any(c.isalpha() for c in m.group())):
                found.append((kind, *m.span()))
    return list(dict.fromkeys(found))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate, as numbers."""
    span, before, after = text[start:end], text[max(0, start - 28):start].lower(), text[end:end + 1]
    n, digits = len(span), _digits(span)
    counts = Counter(span)
    entropy = -sum(v / n * np.log2(v / n) for v in counts.values())
    groups = re.split(r"[^0-9A-Za-z]+", span)
    numbers = [int(g) for g in groups if g.isdigit() and len(g) < 10]
    letters = sum(c.isalpha() for c in span)
    switches = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
    return [*(float(kind == k) for k in KINDS), n, len(digits), len(digits) / n, letters / n, n - len(digits) - letters,
            entropy, switches / n, float(luhn(digits)) if digits else 0.0, float(len(set(digits))), float(len(groups)),
            float(max(map(len, groups))), float(min(map(len, groups))), float(max(numbers, default=-1) <= 255),
            float("@" in span), float(" " in span), float(span[0] in "+0("), float("." in span), float("," in span),
            float(bool(re.search(r"[(\[](?:at|dot)", span))), float(" dot " in span), float("/" in span),
            sum(c.isupper() for c in span) / n, sum(c in "aeiouAEIOU" for c in span) / n, float(bool(_PREFIX.match(span))),
            *(float(bool(p.search(before))) for p in _CONTEXT), float(before[-1:] in "=\"':"), float(after in "\"'"),
            float(bool(re.search(r"[=:]\s?[\"']?$", before))), float(min(numbers, default=-1) >= 1900),
            float(":" in span), float(len({len(g) for g in groups})), float(bool(_ENDING.search(span))),
            sum(len(g) for g in groups if _WORDY.fullmatch(g)) / n, float(max((len(g) for g in groups if not _WORDY.fullmatch(g)), default=0)),
            float(bool(_UUID.fullmatch(span))), float(bool(_DIGEST.fullmatch(span))), float(bool(_NAMED.search(before)))]


class Trees:
    """Boosted regression trees on the logistic loss, over features cut at quantiles."""

    def __init__(self, settings: Settings):
        self.settings, self.trees, self.start, self.thresholds = settings, [], 0.0, {}

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> Trees:
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, 24)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        mean = np.clip((weight * y).sum() / weight.sum(), 0.01, 0.99)
        self.start = float(np.log(mean / (1 - mean)))
        margin = np.full(y.size, self.start)
        for _ in range(self.settings.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(binned, cuts, weight * (y - p), weight * p * (1 - p), np.arange(y.size), self.settings.depth)
            self.trees.append(tree)
            margin += self._walk(tree, x)
        return self

    def _grow(self, binned, cuts, slope, bend, rows, depth):
        leaf = self.settings.rate * slope[rows].sum() / (bend[rows].sum() + 1.0)
        if depth == 0 or rows.size < 10:
            return leaf
        best, gain = None, 1e-3
        whole = slope[rows].sum() ** 2 / (bend[rows].sum() + 1.0)
        for k, cut in enumerate(cuts):
            if cut.size == 0:
                continue
            left = np.cumsum(np.bincount(binned[rows, k], slope[rows], cut.size + 1))[:-1]
            left_bend = np.cumsum(np.bincount(binned[rows, k], bend[rows], cut.size + 1))[:-1]
            right, right_bend = slope[rows].sum() - left, bend[rows].sum() - left_bend
            gains = left ** 2 / (left_bend + 1) + right ** 2 / (right_bend + 1) - whole
            if gains.max() > gain:
                best, gain = (k, int(gains.argmax())), gains.max()
        if best is None:
            return leaf
        low = binned[rows, best[0]] <= best[1]
        if low.all() or not low.any():
            return leaf
        return (best[0], cuts[best[0]][best[1]], self._grow(binned, cuts, slope, bend, rows[low], depth - 1),
                self._grow(binned, cuts, slope, bend, rows[~low], depth - 1))

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(x.shape[0], tree)
        feature, cut, low, high = tree
        return np.where(x[:, feature] <= cut, self._walk(low, x), self._walk(high, x))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a candidate is personal data."""
        return 1 / (1 + np.exp(-(self.start + sum(self._walk(t, x) for t in self.trees))))

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Per kind, the lowest threshold whose selections on unseen candidates are precise enough; none: select nothing."""
        p = self.score(x)
        for k, kind in enumerate(KINDS):
            own = x[:, k] == 1
            order = np.argsort(-p[own])
            good = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1) if own.any() else np.zeros(0)
            fine = np.flatnonzero(good >= self.settings.precision)
            self.thresholds[kind] = max(self.settings.floor, float(p[own][order][fine[-1]])) if fine.size else 2.0


def _forms(draw: np.random.Generator, words: list[str]) -> list[tuple[str | None, str]]:
    """Rewritten personal data (kind, form) and near misses (None, form) to set into a context, made of the text's words."""
    word = words[int(draw.integers(len(words)))]
    some = lambda n, sep: sep.join(words[int(k)] + (str(draw.integers(0, 30)) if draw.random() < 0.2 else "")
                                   for k in draw.integers(0, len(words), n))
    hexed = lambda n: "".join(draw.choice(list("abcdef0123456789"), n))
    d = lambda n: "".join(map(str, draw.integers(0, 10, n)))
    card = d(15)
    card = next(card + str(c) for c in range(10) if luhn(card + str(c)))
    wrong = card[:-1] + str((int(card[-1]) + 1 + int(draw.integers(0, 9))) % 10)
    quad = [str(x) for x in draw.integers(1, 255, 4)]
    key = "".join(draw.choice(list("abcdef0123456789"), 32))
    upper = "".join(draw.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), 16))
    mixed = lambda n: "".join(draw.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), n))
    long = int(2 ** draw.uniform(7.6, 12))  # of a key that no line break divides
    name, host = f"{word}.{d(2)}", f"{word[:6]}{d(1)}"
    four = lambda s, sep: sep.join(s[k:k + 4] for k in range(0, 16, 4))
    return [("email", f"{name} (at) {host} (dot) com"), ("email", f"{name}[at]{host}.org"), ("email", f"{name} @ {host}.com"),
            ("email", f"{name} at {host} dot com"), ("email", f"{word} at {word[:6]} dot com"), ("email", f"{word} at {word[:6]} (dot) com"),
            ("email", f"{word}.{word[:4]} (at) {word[:6]} [dot] org"), ("email", f"{word}\tat\t{word[:6]}\tdot\tnet"),
            ("ip", "contact ip " + " . ".join(quad)),
            ("card", "card " + four(card, ".")), ("card", four(card, " - ")), ("card", four(card, "/")),
            ("phone", f"tel ({d(3)}) {d(3)}-{d(4)}"), ("phone", f"call {d(3)}.{d(3)}.{d(4)}"), ("phone", f"phone: 00{d(2)} {d(3)} {d(4)}"),
            ("secret", f"password={key[:18]}"), ("secret", f"token = \"{key}\""), ("secret", f"token = \"{hexed(40)}\""), ("secret", f"secret: {hexed(64)}"),
            ("secret", f"AKIA{upper}"), ("secret", f"key AKIA{upper}"), ("secret", f"ASIA{upper}"),
            ("secret", "ghp_" + mixed(36).replace("+", "a").replace("/", "b")), ("secret", "sk-" + mixed(32).replace("+", "c").replace("/", "d")), ("secret", f"api_key: {key}"),
            ("secret", f"token: {mixed(long)}"), ("secret", mixed(long)), ("secret", "eyJ" + mixed(long).replace("+", "-").replace("/", "_")),
            ("secret", "".join(draw.choice(list("abcdef0123456789"), long))),
            (None, f"/{word}{d(1)}" * (long // 8)), (None, f"{word}-{d(1)}-" * (long // 8) + word), (None, f"{word}_" * (long // 8) + d(2)),
            (None, f"{draw.integers(1900, 2030)}-{draw.integers(10, 13)}-{draw.integers(10, 29)}"),
            (None, f"{d(2)}.{d(3)}.{d(3)},{d(2)}"), (None, wrong), (None, four(wrong, "/")), (None, f"{d(1)}.{d(2)}, {d(1)}.{d(2)}"),
            (None, f"{d(4)} {d(4)} {d(4)}"), (None, f"version {d(1)}.{d(1)}.{d(2)}.{d(4)}"), (None, ".".join(["999", *quad[:3]])),
            (None, "/" + some(int(draw.integers(3, 60)), "/")), (None, f"see /{some(4, '/')}/{some(3, '_')}.py"),
            (None, some(int(draw.integers(3, 40)), "-")), (None, f"{some(4, '-')}-{draw.integers(1990, 2030)}"),
            (None, f"{word}.com/{some(1, '/')}/{draw.integers(2000, 2030)}/0{d(1)}/{some(6, '-')}"), (None, f"https://www.{word}.org/{some(5, '/')}"),
            (None, f"commit {hexed(40)}"), (None, f"sha256 {hexed(64)}"), (None, hexed(40)), (None, f"id {hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}"),
            (None, f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}"),
            (None, f"{word}{word}{word}1"), (None, f"{word}-{word}-{word}-{d(2)}"), (None, d(12)), (None, d(20)),
            (None, f"{word} at {word}. {word}"), (None, f"{word} at {word[:6]} dot {word}"),
            (None, f"{word} at {word} dot {word[:3]} {word}"), (None, f"{d(3)} {d(3)} {d(3)} {d(3)}"), (None, f"/{word}/{word}/{word}{d(1)}")]


def fit(texts: list[str], settings: Settings = Settings()) -> Trees | None:
    """Fit and calibrate on sample texts; None where they have no word to set a form beside."""
    draw = np.random.default_rng(settings.seed)
    rows: list[tuple[list[float], int, int]] = []  # features, label, fold
    for number, text in enumerate(texts):
        fold = int(number % 3 == 0)
        base = {(k, *s) for k, spans in base_spans(text).items() for s in spans}
        for kind, a, b in candidates(text):
            if kind != "secret":
                rows.append((features(text, kind, a, b), int((kind, a, b) in base), fold))
        gaps = [m.start() for m in re.finditer(" ", text)]
        words = re.findall(r"[a-z]{2,12}", text)
        if not gaps or not words:
            continue
        kinds = _forms(draw, words)
        for pick in draw.choice(len(kinds), min(len(kinds), max(8, 6000 // len(texts))), replace=False):
            kind, form = kinds[pick]
            at = gaps[int(draw.integers(len(gaps)))]
            left, right = text[max(0, at - 60):at] + " ", " " + text[at + 1:at + 60]
            near = left + form + right
            for own, a, b in candidates(near):
                inside = min(b, len(left) + len(form)) - max(a, len(left))
                if inside <= 0:
                    continue
                whole = kind == own and a >= len(left) and b <= len(left) + len(form) and (inside >= 0.6 * len(form) or own == "secret")
                if whole or kind is None or own == kind:
                    rows.append((features(near, own, a, b), int(whole), fold))
    if len(rows) < 50:
        return None
    x, y, fold = (np.array(c, float) for c in zip(*rows))
    if min(y[fold == 0].sum(), (1 - y[fold == 0]).sum(), (fold == 1).sum()) < 10:
        return None
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()) * y.size
    trees = Trees(settings).fit(x[fold == 0], y[fold == 0], share[fold == 0])
    trees.calibrate(x[fold == 1], y[fold == 1])
    return trees


def spans(text: str, trees: Trees | None) -> tuple[dict[str, list[tuple[int, int]]], list[tuple[str, int, int]]]:
    """(base spans by kind, all spans in order of kind and start)."""
    base = base_spans(text)
    every = [(k, a, b) for k in KINDS[:4] for a, b in base[k]]
    proposed = candidates(text) if trees else []
    if proposed:
        taken = sorted((a, b) for _, a, b in every)
        ends = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0)
        starts = np.array([a for a, _ in taken])

        def free(a: int, b: int) -> bool:  # no base span reaches into [a, b)
            k = int(np.searchsorted(starts, b)) if taken else 0
            return k == 0 or ends[k - 1] <= a
        proposed = [c for c in proposed if free(c[1], c[2])]
    if proposed:
        p = trees.score(np.array([features(text, *c) for c in proposed], float))
        chosen = sorted(((-s, a, b, k) for s, (k, a, b) in zip(p.tolist(), proposed) if s >= trees.thresholds[k]))
        covered: list[tuple[int, int]] = []  # disjoint, in order
        for _, a, b, k in chosen:
            at = bisect(covered, (a, b))
            if (at == 0 or covered[at - 1][1] <= a) and (at == len(covered) or covered[at][0] >= b):
                covered.insert(at, (a, b))
                every.append((k, a, b))
    return base, sorted(every, key=lambda s: (KINDS.index(s[0]), s[1]))


def redact_text(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one."""
    out, done = [], 0
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join(out) + text[done:]


def learn(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Fit on a bounded sample of texts that hold a digit or an at sign."""
    rows = keyed(docs, id_col, text_col).filter(F.col("text").rlike("[0-9@]")).withColumn("k", F.xxhash64("id", "text"))
    # keys first: a task sends eight bytes a row to choose among, and the texts of the chosen rows only
    least = rows.select("k").orderBy("k").limit(settings.rows).agg(F.max("k")).first()[0]
    if least is None:
        return None
    sample = (rows.filter(F.col("k") <= least).select("k", F.substring("text", 1, settings.chars).alias("text"))
              .groupBy("k").agg(F.min("text").alias("text")).collect())  # rows alike in id and text once
    return fit([r["text"] for r in sorted(sample, key=lambda r: r["k"])], settings)


def _listed(found) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in found)


def find_pii(docs: DataFrame, settings: Settings = Settings(), trees: Trees | None = None, id_col: str = "doc_id",
             text_col: str = "text", with_text: bool = False) -> DataFrame:
    """``doc_id``, base counts, ``base_sha256``, ``spans`` (``kind:start:end``), ``part`` per row, and ``redacted`` text if
    asked for. ``trees`` is learned from ``docs`` unless given."""
    trees = trees or learn(docs, settings, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # its size is set by the settings
    names = ["doc_id", "part", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"] + ["redacted"] * with_text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, every = spans(text, shared.value)
                own = _listed((k, a, b) for k in KINDS[:4] for a, b in base[k])
                out.append((*(len(base[k]) for k in KINDS[:4]), hashlib.sha256(own.encode()).hexdigest(), _listed(every),
                            *((redact_text(text, every),) if with_text else ())))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c) for c in zip(*out))], names)
    return keyed(docs, id_col, text_col).withColumn("part", content_key()).mapInArrow(
        run, "doc_id long, part long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
        + (", redacted string" if with_text else ""))


def redact(docs: DataFrame, settings: Settings = Settings(), id_col: str = "doc_id", text_col: str = "text",
           length_col: str | None = "n_chars") -> DataFrame:
    """All rows and columns, with every span of the text replaced by its kind and the length column kept true. Null text
    stays null, and a text without spans is returned as it is."""
    small_batches(docs)
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, settings, id_col, text_col))
    at, schema = docs.columns.index(text_col), docs.schema
    size = docs.columns.index(length_col) if length_col in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            texts, columns, changed = batch.column(at).to_pylist(), list(batch.columns), {}
            for k, text in enumerate(texts):
                if text and (found := spans(text, shared.value)[1]):
                    texts[k] = changed[k] = redact_text(text, found)
            columns[at] = pa.array(texts, pa.string())
            if size is not None and changed:
                sizes = columns[size].to_pylist()
                for k, text in changed.items():
                    sizes[k] = len(text)
                columns[size] = pa.array(sizes, columns[size].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
    return docs.mapInArrow(run, schema)
