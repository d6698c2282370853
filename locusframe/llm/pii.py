"""Personal data: base patterns, and a semi-Markov conditional random field for what they miss.

The base patterns (email, ip, card, phone) are exact. The field scores whole candidate segments of tokens, by features of
the span (shape of its groups, digits, check digit, separators, at-signs, the word before) and of its type; dynamic
programming over entities of at most ``MAX_TOKENS`` tokens (a bracketed ``[at]`` or ``[.]`` is one) jointly chooses boundaries and types. Its spans are added where they
overlap no base span. It is trained here, by gradient steps on the conditional likelihood of sentences generated from a seed:
written variants of the four kinds (``name at host dot com``, dotted cards, phones without a plus, spaced addresses) among
look-alikes (versions, dates, prices, hashes, order numbers) and prose.

Defined cases: null and empty texts have no spans; texts of any length are scanned in linear time; tokens of more than
``MAX_TOKEN`` characters are never inside an added span, nor is what lies more than 80 characters from a digit, an at-sign or a written one;
texts of many such are decoded in windows of about 4,000 characters, and an added span never crosses from one to the next; null doc_ids are reported as such; repeated rows are treated alike; an empty table gives no rows; further
columns are ignored (redact keeps them).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ["email", "ip", "card", "phone"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, in linear time: from every @ back over the local part."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in order of start, then of kind."""
    found = [(s, e, "email") for s, e in emails(text)]
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if octets(m[0])]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


# --- the field -----------------------------------------------------------------------------------------------------

TOKEN = re.compile(r"[(\[]\s?(?:at|arroba|chez|bei|dot|punto|point|punkt|[.@])\s?[)\]]|[0-9]+|[^\W\d_]+|[^\s\w]|_", re.IGNORECASE)
MAX_TOKENS, MAX_TOKEN = 20, 40
AT, DOT = {"at", "arroba", "chez", "bei"}, {"dot", "punto", "point", "punkt"}
#: What every entity has: a digit, an at-sign, or a written one that is bracketed or followed by a written dot. Elsewhere
#: nothing is decoded.
TRIGGER = re.compile(
    r"[0-9]|@|[(\[]\s?(?:at|arroba|chez|bei)\s?[)\]]|\b(?:at|arroba|chez|bei)\b(?=[^\n,;!?]{1,60}\b(?:dot|punto|point|punkt)\b)", re.IGNORECASE
)
CUES = {"email", "mail", "contact", "write", "phone", "call", "tel", "mobile", "fax", "card", "visa", "paid", "number", "ip", "host", "server", "address", "version", "order", "invoice", "price", "date"}
DIM = 1 << 12


def tokens_of(text: str, start: int, end: int) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m[0]) for m in TOKEN.finditer(text, start, end)]


def shape_of(tokens: list, i: int, j: int) -> str:
    """Digit groups by length, words as w (at, dot kept), signs as they are, gaps as a blank."""
    out = []
    for k in range(i, j):
        s, _, t = tokens[k]
        if k > i and s > tokens[k - 1][1]:
            out.append(" ")
        low = t.lower()
        if len(t) > 2 and t[0] in "([":
            low = t = low[1:-1].strip()
        if "0" <= t[0] <= "9":
            out.append(str(min(len(t), 9)))
        elif t[0].isalpha():
            out.append("A" if low in AT else "D" if low in DOT else "w")
        else:
            out.append(t)
    return "".join(out)


#: A plain table, which functions take along to executors.
_slots: dict[str, int] = {}


def slot(name: str) -> int:
    found = _slots.get(name)
    if found is None:
        found = int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=4).digest(), "big") % DIM
        if len(_slots) < 1 << 16:
            _slots[name] = found
    return found


def span_features(tokens: list, i: int, j: int) -> list[int]:
    """Feature numbers of the segment of tokens i..j-1, before they are joined to a type."""
    shape = shape_of(tokens, i, j)
    text = "".join(t for _, _, t in tokens[i:j])
    digits = digits_of(text)
    groups = re.findall(r"[0-9]", shape)
    n = len(digits)
    small = all(len(t) <= 3 and int(t) <= 255 for _, _, t in tokens[i:j] if t[0].isdigit() and t.isascii())
    before = tokens[i - 1][2].lower() if i else ""
    close = "l" * (i > 0 and tokens[i - 1][1] == tokens[i][0]) + "r" * (j < len(tokens) and tokens[j][0] == tokens[j - 1][1])
    more = "d" * (j < len(tokens) and tokens[j][2][0].isdigit()) + "b" * (i > 0 and tokens[i - 1][2][0].isdigit())
    kinds = "".join(sorted(set(re.sub(r"[0-9]", "9", shape))))
    names = [
        "bias", f"shape {re.sub(r'w+', 'w', shape)}" if len(shape) < 24 else "shape long", f"groups {''.join(groups)}", f"digits {min(n, 20)}", f"kinds {kinds}", f"close {close}", f"more {more}",
        f"ends {shape[0]}{shape[-1]}", f"at {('@' in shape) + 2 * ('A' in shape)} dot {('.' in shape) + 2 * ('D' in shape)} end {shape[-1] == 'w'}",
    ]
    if 14 <= n <= 19:
        names.append(f"luhn {luhn(digits)} {len(set(groups)) == 1}")
    if len(groups) == 4:
        names.append(f"four small {small}")
    if before in CUES:
        names.append(f"before {before}")
    return [slot(x) for x in names]


def segments(tokens: list) -> list[tuple[int, int, list[int]]]:
    """Candidate entities of a window: at most MAX_TOKENS tokens of one sentence with a trigger, not ending with a sign."""
    out = []
    n = len(tokens)
    low = [t.lower() for _, _, t in tokens]
    bare = [t[1:-1].strip() if len(t) > 2 and t[0] in "([" else t for t in low]
    trigger = [t[0].isdigit() or x == "@" or (x in AT and (t != x or not DOT.isdisjoint(bare[k + 1 : k + 8]))) for k, (t, x) in enumerate(zip(low, bare, strict=True))]
    for i in range(n):
        if tokens[i][1] - tokens[i][0] > MAX_TOKEN or (not tokens[i][2][0].isalnum() and tokens[i][2] not in "(+"):
            continue
        any_trigger = False
        for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
            s, e, t = tokens[j - 1]
            if e - s > MAX_TOKEN or t in ",;!?\"" or (j - 1 > i and s - tokens[j - 2][1] > 2):
                break
            any_trigger |= trigger[j - 1]
            if any_trigger and t[0].isalnum() and not glued(tokens, i, j):
                out.append((i, j, span_features(tokens, i, j)))
    return out


def glued(tokens: list, i: int, j: int) -> bool:
    """Is the segment part of a longer run of letters and digits?"""
    left = i > 0 and tokens[i - 1][1] == tokens[i][0] and tokens[i - 1][2][-1].isalnum() and tokens[i][2][0].isalnum()
    right = j < len(tokens) and tokens[j][0] == tokens[j - 1][1] and tokens[j][2][0].isalnum()
    return left or right


def segment_scores(tokens: list, i: int, j: int, total: np.ndarray) -> np.ndarray:
    """total with the kinds that the segment can't be shut out: an email has letters, the others have none."""
    letters = any(t[0].isalpha() for _, _, t in tokens[i:j])
    out = total.copy()
    out[slice(1, None) if letters else slice(0, 1)] = -np.inf
    return out


def decode(n: int, scores: dict[tuple[int, int], np.ndarray]) -> list[tuple[int, int, int]]:
    """The best cover of n tokens by outside tokens (score 0) and entities (i, j, kind)."""
    best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
    ending: dict[int, list] = {}
    for (i, j), s in scores.items():
        k = int(s.argmax())
        if s[k] > 0:
            ending.setdefault(j, []).append((i, k, float(s[k])))
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for i, k, s in ending.get(j, ()):
            if best[i] + s > best[j]:
                best[j], back[j] = best[i] + s, (i, j, k)
    out, j = [], n
    while j:
        if back[j]:
            out.append(back[j])
            j = back[j][0]
        else:
            j -= 1
    return out[::-1]


def expected(n: int, scores: dict[tuple[int, int], np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """Probability of every entity (by kind) under the field: forward and backward sums over all covers."""
    forward, backward = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    forward[0] = backward[n] = 0.0
    ending: dict[int, list] = {}
    starting: dict[int, list] = {}
    for (i, j), s in scores.items():
        whole = float(np.logaddexp.reduce(s))
        ending.setdefault(j, []).append((i, whole))
        starting.setdefault(i, []).append((j, whole))
    for j in range(1, n + 1):
        forward[j] = np.logaddexp.reduce([forward[j - 1], *(forward[i] + s for i, s in ending.get(j, ()))])
    for i in range(n - 1, -1, -1):
        backward[i] = np.logaddexp.reduce([backward[i + 1], *(backward[j] + s for j, s in starting.get(i, ()))])
    return {(i, j): np.exp(forward[i] + s + backward[j] - forward[n]) for (i, j), s in scores.items()}


def training_sentences(many: int, seed: int) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Sentences with entities (start, end, kind) in characters."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "re", "la", "ti", "es", "mo", "ka", "ñe", "üb", "é"]) for _ in range(r.randint(1, 3)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))

    def card_digits(n: int = 16) -> str:
        d = r.choice("456") + num(n - 2)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def entity(kind: str) -> str:
        if kind == "email":
            at, dot = r.choice([(" at ", " dot "), ("(at)", "."), (" (at) ", " dot "), (" [at] ", "."), (" at ", "[dot]"), (" @ ", "."), ("@", "."), (" arroba ", " punto "), (" bei ", " punkt "), ("[at]", "[dot]"), (" (at) ", " (dot) ")])
            host = dot.join([word().strip("é") or "mail", *([r.choice(["example", "mail1", "host"])] * r.randint(0, 1)), r.choice(["com", "org", "net", "de", "fr"])])
            return r.choice([word(), f"{word()}.{num(2)}", f"{word()}{num(2)}"]) + at + host
        if kind == "ip":
            return r.choice([".", " . ", "[.]", "."]).join(str(r.randint(1, 255)) for _ in range(4))
        if kind == "card":
            d, sep = card_digits(), r.choice([" ", "-", ".", "", "/", "  "])
            return sep.join(d[i : i + 4] for i in range(0, 16, 4))
        sep = r.choice(["-", " ", "."])
        return r.choice(["({}) {}{s}{}", "{}{s}{}{s}{}", "+1 ({}) {}{s}{}", "+44 {} {}{s}{}", "00 1 {} {}{s}{}"]).format(num(3), num(3), num(4), s=sep)

    def decoy() -> str:
        return r.choice([
            lambda: f"{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: f"version {r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}", lambda: f"{r.randint(1900, 2030)}-{num(2)}-{num(2)}",
            lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(2)}:{num(2)}:{num(2)}", lambda: f"${num(3)}.{num(2)}", lambda: num(r.randint(1, 20)), lambda: "".join(r.choice("0123456789abcdef") for _ in range(40)),
            lambda: f"order {num(4)}-{num(4)}", lambda: f"{word()} at {word()}", lambda: f"look at the {word()} dot", lambda: f"{word()} at {word()}. {word()} {word()} dot", lambda: f"{word()} (at {word()})", lambda: f"{word()}@{word()}", lambda: f"{num(3)} {num(3)}", lambda: f"{num(4)} {num(4)} {num(4)}",
            lambda: f"CC BY-NC {num(1)}.{num(1)}", lambda: f"{num(1)}, {num(1)}, {num(1)}, {num(1)}", lambda: f"{num(4)}.{num(4)}.{num(4)}.{num(4)}", lambda: f"{r.randint(256, 999)}.{num(3)}.{r.randint(300, 999)}.{num(2)}", lambda: f"at {num(2)}.", lambda: f"{num(16)}", lambda: f"{num(3)}-{num(2)}-{num(4)}",
        ])()

    out = []
    for _ in range(many):
        text, marks = "", []
        for _ in range(r.randint(2, 4)):
            text += " ".join(word() for _ in range(r.randint(0, 3))) + " "
            if r.random() < 0.45:
                k = r.randrange(4)
                if r.random() < 0.2:
                    text += r.choice([["mail", "contact"], ["ip", "server"], ["card", "visa"], ["call", "phone"]][k]) + r.choice([" ", ": "])
                e = entity(KINDS[k])
                marks.append((len(text), len(text) + len(e), k))
                text += e
            else:
                text += decoy()
            text += r.choice([" ", ". ", ", "])
        out.append((text, marks))
    return out


@cache
def trained(many: int = 600, seed: int = 11, rounds: int = 14, rate: float = 0.3, ridge: float = 1e-4) -> np.ndarray:
    """Weights (feature, kind) after AdaGrad on the log likelihood; a few seconds on one core, the same every time."""
    w, seen = np.zeros((DIM, 4)), np.full((DIM, 4), 1e-6)
    data = []
    for text, marks in training_sentences(many, seed):
        tokens = tokens_of(text, 0, len(text))
        segs = segments(tokens)
        place = {(tokens[i][0], tokens[j - 1][1]): (i, j) for i, j, _ in segs}
        gold = {place[s, e]: k for s, e, k in marks}  # every entity is a candidate
        width = max((len(f) for *_, f in segs), default=0)
        if not segs:
            continue
        features = np.array([f + [DIM] * (width - len(f)) for *_, f in segs])
        shut = np.array([segment_scores(tokens, i, j, np.zeros(4)) for i, j, _ in segs])
        data.append((len(tokens), [(i, j) for i, j, _ in segs], features, shut, gold))
    order = random.Random(seed)
    for _ in range(rounds):
        order.shuffle(data)
        for n, spans, features, shut, gold in data:
            wide = np.vstack([w, np.zeros((1, 4))])
            scores = wide[features].sum(axis=1) + shut
            chance = expected(n, dict(zip(spans, scores, strict=True)))
            error = -np.array([chance[x] for x in spans])
            for x, k in gold.items():
                error[spans.index(x), k] += 1
            step = np.zeros((DIM + 1, 4))
            np.add.at(step, features, error[:, None, :])
            touched = np.unique(features)
            touched = touched[touched < DIM]
            g = step[touched] - ridge * w[touched]
            seen[touched] += g * g
            w[touched] += rate * g / np.sqrt(seen[touched])
    return w


def windows(text: str, reach: int = 80) -> Iterator[tuple[int, int]]:
    """Stretches around triggers, joined where they touch; between them no entity can be."""
    low = high = -1
    for m in TRIGGER.finditer(text):
        s, e = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if high < 0:
            low, high = s, e
        elif s <= high and e - low <= 4000:
            high = e
        else:
            yield low, high
            low, high = s, e
    if high >= 0:
        yield low, high


def field_spans(text: str, weights: np.ndarray) -> list[tuple[int, int, str]]:
    out, done = [], 0
    for low, high in windows(text):
        while low > 0 and low < high and text[low - 1].isalnum() and text[low].isalnum():
            low += 1  # no half words
        tokens = tokens_of(text, max(low, done), high)
        segs = segments(tokens)
        if not segs:
            continue
        scores = {(i, j): segment_scores(tokens, i, j, weights[f].sum(axis=0)) for i, j, f in segs}
        for i, j, k in decode(len(tokens), scores):
            out.append((tokens[i][0], tokens[j - 1][1], KINDS[k]))
            done = max(done, tokens[j - 1][1])
    return out


def find_personal(text: str | None, weights: np.ndarray) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans; all spans."""
    if not text:
        return [], []
    base = base_spans(text)
    if not TRIGGER.search(text):
        return base, base
    taken = sorted((s, e) for s, e, _ in base)
    added = []
    for s, e, k in field_spans(text, weights):
        if all(e <= x or s >= y for x, y in taken):
            added.append((s, e, k))
    return base, sorted(base + added, key=lambda x: (x[0], KINDS.index(x[2])))


def written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    weights = docs.sparkSession.sparkContext.broadcast(trained())  # DIM x 4 numbers

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, text in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True):
                base, spans = find_personal(text, weights.value)
                kinds = [k for *_, k in base]
                rows.append((doc_id, *map(kinds.count, KINDS), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            out = pd.DataFrame(rows, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select("doc_id", "text").mapInPandas(find, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact_text(text: str | None, weights: np.ndarray) -> str | None:
    """The text with every span (overlapping ones as one, named by the first) replaced by [KIND]."""
    _, spans = find_personal(text, weights)
    if not spans:
        return text
    out, at = [], 0
    for s, e, k in spans:
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the personal data in column text replaced; all columns stay."""
    weights = docs.sparkSession.sparkContext.broadcast(trained())

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series) -> pd.Series:
        return pd.Series([redact_text(t, weights.value) for t in texts], dtype="object")

    return docs.withColumn(text, cleaned(F.col(text)))


def op3_semi_markov_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(table(spark, sf_dir, "documents"))
