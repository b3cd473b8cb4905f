"""Personal data: candidate spans scored by gradient-boosted trees, calibrated thresholds, redaction.

1. Base rules (`base_spans`): fixed patterns with checks for e-mail addresses, IP addresses, card and phone numbers.
2. Generators (`candidates`) propose overlapping spans with high recall: around every @, every dotted number, and every run of
   neighbouring digit groups, so that a number the base rule swallows together with its neighbours is proposed on its own.
   Runs are bounded by their digits alone, so a number may be written in any groups.
3. Boosted trees score a candidate by its format (digits, groups, separators, checks) and context (what stands on each side).
   They are trained on the candidates of all texts, kept as distinct vectors with counts, each text as it is and once more
   with a generated case in it (`planted`), so that forms rare in the corpus are known. Positives of a kind are what the base rules
   confirm and what has a form of its own (`well_formed`: Luhn numbers of 13 to 19 digits, phone-shaped groups without a +,
   addresses with letters beyond ASCII); the others are negatives, except parts of a confirmed span, of a base match of the
   kind that failed its check, and phone-like groups in doubt, about which nothing is known. All texts fit the trees. Each half of the
   texts also fits trees of its own, which score the other half, so that all texts calibrate and none is judged by trees that know it.
   Each level of the three is one pass over the rows in their partitions, which gives sums for each node, feature and bin.
4. Thresholds: per kind, the least score at which all texts show at least 99 % precision, but none that makes a candidate
   less likely than not; a kind without positives selects nothing. Candidates above it are taken by score, best first, unless they overlap one taken before or
   lie inside a base span. Base spans always stay; a candidate may extend or overlap them, and redaction replaces both as one.

Positions count code points, the end is exclusive. Defined results: null texts count as empty and have no spans. Rows are
searched each for itself, so repeated rows, null ids, ties and further columns need no care.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import give_back
from cuegrid.plans.store import as_table

KINDS = ("email", "ip", "card", "phone")
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Generators: what may stand around an @, and digit groups with what may join them to the next one.
AROUND_AT = re.compile(r"[^\s@<>()\[\],;:\"']+@[^\s@<>()\[\],;:\"']+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
NUMBERS = re.compile(r"[+(]{0,2}[0-9]+(?:[\x20().-]{1,2}[0-9]+)*")
GROUP = re.compile(r"[0-9]+")
DIGITS = re.compile(r"[0-9]")

# Forms of their own. Letters: Latin, Greek and Cyrillic; scripts written without blanks would join an address to its sentence.
LETTERS = "A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F\u0300-\u036F\u0370-\u052F\u1E00-\u1FFF"
ADDRESS = re.compile(rf"[{LETTERS}0-9_%+-]+(?:\.[{LETTERS}0-9_%+-]+)*@(?:[{LETTERS}0-9-]+\.)+[{LETTERS}][{LETTERS}0-9-]*[{LETTERS}0-9]")
#: An area code in brackets, three groups of 3, 3 and 4 digits, a trunk 0, or a country code; after them one kind of separator.
PHONE_FORMS = re.compile(r"(?:\+?[0-9]{1,3}[\x20.-]?)?\([0-9]{2,5}\)[\x20.-]?[0-9]{2,4}(?:([\x20.-]?)[0-9]{2,4}(?:\1[0-9]{2,4})*)?|"
                         r"(?:\+?1[\x20.-])?[0-9]{3}([\x20.-])[0-9]{3}\2[0-9]{4}|"
                         r"0[0-9]{1,4}([\x20.-])[0-9]{2,4}(?:\3[0-9]{2,4}){1,4}|0[0-9]{2,4}[\x20.-][0-9]{5,8}|"
                         r"\+[0-9]{1,3}([\x20.-])[0-9]{2,4}(?:\4[0-9]{2,4}){1,4}")
#: What makes the number behind it a part of a longer one.
COUNTRY = re.compile(r"\+[0-9]{1,3}[\x20.-]{0,2}\Z")
LOCAL = re.compile(r"[0-9]{3}[\x20.-][0-9]{4}")
CARD_GROUPS = ((4, 6, 5), (4, 6, 4))


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    total = 0
    for place, c in enumerate(reversed(digits)):
        d = int(c) * (1 + place % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(GROUP.findall(s))


def holds(kind: str, s: str) -> bool:
    """The check of a base match of the kind."""
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    digits = only_digits(s)
    return 16 <= len(digits) <= 19 and luhn(digits) if kind == "card" else 8 <= len(digits) <= 15


def base_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(spans that pass their check, matches that fail it), by kind and start."""
    good: list[Span] = []
    bad: list[Span] = []
    has_digit = DIGITS.search(text) is not None
    for kind, pattern, able in (("email", EMAIL, "@" in text), ("ip", IP, has_digit and "." in text), ("card", CARD, has_digit), ("phone", PHONE, has_digit and "+" in text)):
        if able:
            for m in pattern.finditer(text):
                (good if holds(kind, m.group()) else bad).append(Span(kind, m.start(), m.end()))
    return good, bad


def candidates(text: str) -> list[Span]:
    """Overlapping spans of each kind, with high recall."""
    found: set[Span] = set()
    if "@" in text:
        for m in AROUND_AT.finditer(text):
            start, end = m.span()
            found.add(Span("email", start, end))
            s = m.group().rstrip(".-_!?*#$%&|/\\")
            found.add(Span("email", start, start + len(s)))
            found.update(Span("email", start + b.start(), start + b.end()) for pattern in (EMAIL, ADDRESS) for b in pattern.finditer(s))
    if DIGITS.search(text):
        for m in DOTTED.finditer(text) if "." in text else ():
            groups = [g.span() for g in GROUP.finditer(text, *m.span())]
            found.update(Span("ip", groups[i][0], groups[i + 3][1]) for i in range(len(groups) - 3))
        for m in NUMBERS.finditer(text):
            groups = [g.span() for g in GROUP.finditer(text, *m.span())]
            if sum(b - a for a, b in groups) < 7:
                continue
            for i in range(len(groups)):
                digits = 0
                for j in range(i, len(groups)):
                    digits += groups[j][1] - groups[j][0]
                    if digits > 19:
                        break
                    if digits >= 7:
                        start, end = groups[i][0], groups[j][1]
                        if 13 <= digits:
                            found.add(Span("card", start, end))
                        if digits <= 15:
                            found.add(Span("phone", start, end))
                            while start > m.start() and text[start - 1] in "+(":
                                start -= 1
                                found.add(Span("phone", start, end))
    return sorted(found, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def char_class(text: str, at: int) -> int:
    """What stands at a position: 0 nothing, 1 white space, 2 letter, 3 digit, 4 sentence mark, 5 joining mark, 6 other."""
    if not 0 <= at < len(text):
        return 0
    c = text[at]
    return 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 if c in ".,;:!?" else 5 if c in "+-()/@_" else 6


def alone(text: str, span: Span) -> bool:
    """No further digit group stands beside the number."""
    before, after = text[max(0, span.start - 3):span.start].rstrip(" ().-"), text[span.end:span.end + 3].lstrip(" ().-")
    return not before[-1:].isdigit() and not after[:1].isdigit()


def well_formed(text: str, span: Span) -> bool:
    """The form of its own that makes a candidate personal data without the base rules."""
    s = text[span.start:span.end]
    if span.kind == "email":
        return ADDRESS.fullmatch(s) is not None
    if span.kind == "ip":
        return False
    groups = GROUP.findall(s)
    n = sum(map(len, groups))
    apart = {x.strip() for x in GROUP.split(s)[1:-1]}
    if span.kind == "card":
        sizes = tuple(map(len, groups))
        regular = len(apart) <= 1 and (len(set(sizes[:-1])) <= 1 and (len(sizes) == 1 or sizes[0] >= 3 and sizes[-1] <= sizes[0]) or sizes in CARD_GROUPS)
        return 13 <= n <= 19 and luhn("".join(groups)) and (regular or alone(text, span))
    if not 8 <= n <= 15 or PHONE_FORMS.fullmatch(s) is None or s[0] != "+" and n < 9 and "(" not in s or COUNTRY.search(text[max(0, span.start - 6):span.start]):
        return False
    return s[0] in "+(" or "(" in s or apart in ({"-"}, {"."}) or alone(text, span)


def features(text: str, span: Span) -> list[float]:
    """Format and context of a candidate. The base checks of its own kind are not among them, only their ingredients."""
    s = text[span.start:span.end]
    groups = GROUP.findall(s)
    digits = "".join(groups)
    local, _, domain = s.partition("@")
    labels = domain.split(".")
    before, after = char_class(text, span.start - 1), char_class(text, span.end)
    before2, after2 = char_class(text, span.start - 2), char_class(text, span.end + 1)
    return [
        float(KINDS.index(span.kind)), len(s), len(digits), len(groups), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        max(map(len, groups), default=0), min(map(len, groups), default=0), max((int(g[:6]) for g in groups), default=0), s[:1] == "+", s.count("("), s.count(")"), s.count("."), s.count("-"), s.count(" "),
        luhn(digits) if digits else 0, int(digits[0]) if digits else -1, before, before2, after, after2, len(local), len(labels), len(labels[-1]), min(map(len, labels)),
        sum(c.isalpha() for c in labels[-1]), s.isascii(), sum(c.isalpha() for c in s), well_formed(text, span),
    ]


class Trees(NamedTuple):
    """Boosted regression trees of depth 3, as complete binary trees: 7 tests and 8 leaves each."""
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(3):
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - 7]
        return total


#: Histograms hold whole numbers of this part of a gradient, so that sums do not depend on their order.
UNIT = 1 << 20


#: Which rows fit a model, by their half: each half its own, and all of them the last.
FITS = (0,), (1,), (0, 1)


def _histograms(rows: DataFrame, models: list[Trees], trees: list[list], nodes: int, width: int) -> np.ndarray:
    """[model, node, feature, bin, (gradient, curvature)] sums over all rows that fit a model, for the nodes of the level that its tree has reached."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            every = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(batch), -1)
            if total is None:
                total = np.zeros((2, len(models), every.shape[1], nodes * width))
            for k, (model, tree) in enumerate(zip(models, trees)):
                fits = np.isin(batch["check"], FITS[k])
                codes, label, weight = every[fits], batch["label"].to_numpy()[fits], batch["n"].to_numpy(float)[fits]
                p = 1 / (1 + np.exp(-model.margin(codes)))
                g, h = np.rint((p - label) * UNIT) * weight, np.rint(p * (1 - p) * UNIT) * weight
                node, at = np.zeros(len(codes), np.int64), np.arange(len(codes))
                for feature, cut in tree:
                    node = 2 * node + (codes[at, feature[node]] > cut[node])
                for f in range(codes.shape[1]):
                    cell = node * width + codes[:, f]
                    total[0, k, f] += np.bincount(cell, g, nodes * width)
                    total[1, k, f] += np.bincount(cell, h, nodes * width)
        if total is not None:
            used = np.argwhere(total.any(axis=0))
            yield pd.DataFrame({"model": used[:, 0], "feature": used[:, 1], "cell": used[:, 2], "g": total[0][tuple(used.T)].astype(np.int64), "h": total[1][tuple(used.T)].astype(np.int64)})

    of = "model", "feature", "cell"
    sums = rows.mapInPandas(run, "model long, feature long, cell long, g long, h long").groupBy(*of).agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    out = np.zeros((len(models), nodes, int(sums["feature"].max()) + 1, width, 2))
    out[sums["model"], sums["cell"] // width, sums["feature"], sums["cell"] % width] = sums[["g", "h"]].to_numpy(float) / UNIT
    return out


def _tests(sums: np.ndarray, cuts: list[np.ndarray], shrink: float) -> tuple[np.ndarray, np.ndarray, list]:
    """(feature, cut, sums of gradient and curvature on both sides) of the best test of each node, from its histograms."""
    score = lambda g, h: g ** 2 / (h + shrink)
    nodes = len(sums)
    feature, cut, sides = np.zeros(nodes, np.int64), np.full(nodes, np.inf), []
    for n in range(nodes):
        G, H = sums[n, 0].sum(axis=0)
        best, both = 1e-9, ((G, H), (0.0, 0.0))
        for f in range(sums.shape[1]):
            gl, hl = sums[n, f, :len(cuts[f])].cumsum(axis=0).T
            gain = score(gl, hl) + score(G - gl, H - hl) - score(G, H)
            k = int(gain.argmax())
            if gain[k] > best:
                best, feature[n], cut[n], both = gain[k], f, k, ((gl[k], hl[k]), (G - gl[k], H - hl[k]))
        sides.append(both)
    return feature, cut, sides


def boost(rows: DataFrame, cuts: list[np.ndarray], starts: list[float], rounds: int = 40, rate: float = 0.3, shrink: float = 1.0) -> list[Trees]:
    """Newton boosting of the logistic loss over (check, label, code, n) rows, for each of FITS; one pass for each level of their trees; trees on codes.

    A code byte tells how many cuts of its feature lie below the value. Only histograms come to the driver.
    """
    width = max(map(len, cuts)) + 1
    models = [Trees(np.zeros((0, 7), np.int64), np.zeros((0, 7)), np.zeros((0, 8)), start) for start in starts]
    for _ in range(rounds):
        trees: list[list] = [[] for _ in models]
        for level in range(3):
            sums = _histograms(rows, models, trees, 2 ** level, width)
            found_ = [_tests(own, cuts, shrink) for own in sums]
            for tree, (feature, cut, _) in zip(trees, found_):
                tree.append((feature, cut))
        leaves = [np.array([-rate * g / (h + shrink) for both in sides for g, h in both]) for _, _, sides in found_]
        models = [Trees(np.vstack([m.feature, np.concatenate([f for f, _ in tree])]), np.vstack([m.cut, np.concatenate([c for _, c in tree])]), np.vstack([m.leaf, leaf]), m.start)
                  for m, tree, leaf in zip(models, trees, leaves)]
    return models


class Model(NamedTuple):
    trees: Trees | None
    #: Least margin that selects a candidate, by kind.
    least: dict[str, float]


def labelled(text: str) -> Iterator[tuple[list[float], int]]:
    good, bad = base_spans(text)
    confirmed = set(good)
    for s in candidates(text):
        if s in confirmed:
            yield features(text, s), 1
        elif well_formed(text, s):
            if not any(b.start <= s.start and s.end <= b.end for b in good):
                yield features(text, s), 1
        elif s.kind == "phone" and (LOCAL.fullmatch(text[s.start:s.end]) or PHONE_FORMS.fullmatch(text[s.start:s.end])):
            continue
        elif not any(b.kind == s.kind and b.start <= s.start and s.end <= b.end and b != s for b in bad):
            yield features(text, s), 0


def planted(text: str, seed: int) -> str:
    """A text with a generated case among its words: a phone number without +, a card of 13 to 19 digits, or an address."""
    rng = random.Random(seed)
    words = text.split(" ")
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    which = rng.randrange(3)
    if which == 0:
        mark = rng.choice(" -.")
        case = rng.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}{mark}{digits(3)}{mark}{digits(4)}", f"0{digits(2)}{mark}{digits(4)}{mark}{digits(4)}", f"({digits(3)}) {digits(3)} {digits(4)}"))
    elif which == 1:
        sizes = rng.choice(((4, 6, 5), (4, 6, 4), (4, 4, 4, 4), (4, 4, 4, 4, 3), (13,), (14,), (15,), (16,), (19,), (1,) * 16))
        body = digits(sum(sizes) - 1)
        number = body + next(c for c in "0123456789" if luhn(body + c))
        ends = np.cumsum(sizes)
        case = rng.choice(" -").join(number[e - k:e] for e, k in zip(ends, sizes))
    else:
        letters = lambda n: "".join(rng.choices("abcdefghiklmnoprstuwz\u00e4\u00e9\u00f6\u00fc\u00f1\u0142\u0430\u0438", k=n))
        case = f"{letters(rng.randint(1, 8))}{rng.choice('._-')}{letters(rng.randint(1, 8))}@{letters(6)}.{rng.choice(('com', 'org', 'de', 'info'))}"
    at = rng.randint(0, len(words))
    return " ".join([*words[:at], case + rng.choice(("", "", ".", ",")), *words[at:]])


def _examples(docs: DataFrame) -> DataFrame:
    """(check, kind, label, x, n): the distinct feature vectors of all texts, with and without a generated case, and how often each occurs.

    A hash of id and text decides which half a text belongs to, and its generated case.
    """
    rows = docs.where("text <> ''").select("text", F.xxhash64("doc_id", "text").alias("turn"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [(turn % 2, int(x[0]), y, x) for text, turn in zip(batch["text"], batch["turn"])
                    for t in (text, planted(text, turn)) for x, y in labelled(t)]
            yield pd.DataFrame(made, columns=["check", "kind", "label", "x"])

    found_ = rows.mapInPandas(run, "check int, kind int, label int, x array<float>")
    return as_table(found_.groupBy("check", "kind", "label", "x").agg(F.count("*").alias("n")), "pii-examples")


def _cuts(examples: DataFrame) -> list[np.ndarray]:
    """Up to 32 quantiles of each feature, exact over all rows."""
    values = examples.select("n", F.posexplode("x").alias("feature", "value")).groupBy("feature", "value").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("feature")
    upto, total = F.sum("n").over(w.orderBy("value")), F.sum("n").over(w)
    placed = values.select("feature", "value", F.floor(32 * (upto - 1) / total).alias("last"), F.floor(32 * (upto - F.col("n") - 1) / total).alias("before"))
    by_feature: dict[int, list[float]] = {}
    for r in placed.where("last > before").orderBy("feature", "value").collect():
        by_feature.setdefault(r["feature"], []).append(r["value"])
    return [np.array(by_feature[f]) for f in sorted(by_feature)]


def _coded(examples: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.vstack(batch["x"].to_numpy())
                codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
                yield batch[["check", "kind", "label", "n"]].assign(code=[row.tobytes() for row in codes])

    coded = examples.mapInPandas(run, "check int, kind int, label int, n long, code binary")
    return as_table(coded.groupBy("check", "kind", "label", "code").agg(F.sum("n").alias("n")), "pii-codes")


def _least(rows: DataFrame, halves: list[Trees], precision: float, steps: int = 1_024) -> dict[str, float]:
    """The least margin of each kind, in steps and not below 0, at which all rows show the precision, each scored by the trees of the half that it is not in."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = np.frombuffer(b"".join(batch["code"]), np.uint8).reshape(len(batch), -1)
            margin = np.where(batch["check"] == 0, halves[1].margin(codes), halves[0].margin(codes))
            yield batch[["kind", "label", "n"]].assign(step=np.floor(margin * steps).astype(np.int64))

    told = rows.mapInPandas(run, "kind int, label int, n long, step long").groupBy("kind", "step").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("label")).alias("good")).toPandas()
    least = dict.fromkeys(KINDS, float("inf"))
    for kind, own in told.sort_values("step", ascending=False).groupby("kind"):
        enough = own["step"][own["good"].cumsum() >= precision * own["n"].cumsum()]
        if own["good"].any() and len(enough):
            least[KINDS[kind]] = max(float(enough.iloc[-1]) / steps, 0.0)
    return least


def train(docs: DataFrame, precision: float = 0.99) -> Model:
    """Fit and calibrate on all texts."""
    examples = _examples(docs)
    seen = {(r["check"], r["label"]): r["n"] for r in examples.groupBy("check", "label").agg(F.sum("n").alias("n")).collect()}
    if not any(label for _, label in seen):
        return Model(None, {k: float("inf") for k in KINDS})
    cuts = _cuts(examples)
    coded = _coded(examples, cuts)
    odds = lambda fits: float(np.log((sum(seen.get((c, 1), 0) for c in fits) + 1) / (sum(seen.get((c, 0), 0) for c in fits) + 1)))
    *halves, codes = boost(coded, cuts, [odds(fits) for fits in FITS])
    values = np.array([[cuts[f][int(c)] if np.isfinite(c) else np.inf for f, c in zip(*tests)] for tests in zip(codes.feature, codes.cut)])
    return Model(Trees(codes.feature, values, codes.leaf, codes.start), _least(coded, halves, precision))


def all_spans(text: str | None, model: Model) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text, both by kind as listed and start."""
    if not text or not ("@" in text or DIGITS.search(text)):
        return [], []
    base, _ = base_spans(text)
    taken = list(base)
    if model.trees is not None:
        proposed = [s for s in candidates(text) if not any(b.start <= s.start and s.end <= b.end for b in base)]
        if proposed:
            margins = model.trees.margin(np.array([features(text, s) for s in proposed], float))
            ranked = sorted(((m, s) for m, s in zip(margins, proposed) if m >= model.least[s.kind]), key=lambda x: (-x[0], x[1].start - x[1].end, KINDS.index(x[1].kind), x[1].start))
            used = bytearray(len(text))
            for _, s in ranked:
                if not any(used[s.start:s.end]):
                    used[s.start:s.end] = b"\1" * (s.end - s.start)
                    taken.append(s)
    return base, sorted(taken, key=lambda s: (KINDS.index(s.kind), s.start, s.end))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in angle brackets; overlapping spans are replaced as one, by the first kind."""
    if not spans:
        return text
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done:s.start], f"<{s.kind.upper()}>"]
        done = max(done, s.end)
    return "".join(out) + text[done:]


def found(text: Column, model: Model, spark) -> Column:
    """struct(n_email, n_ip, n_card, n_phone, base, spans, redacted): counts and spans of the base rules, all spans, and the redacted text.

    redacted is null where nothing was found: the text stays as it is.
    """
    shared = spark.sparkContext.broadcast(model)

    def rows(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Model(Trees(*shared.value[0]) if shared.value[0] is not None else None, shared.value[1])
        for batch in batches:
            out = []
            for t in batch:
                base, every = all_spans(t, known)
                kinds = [s.kind for s in base]
                out.append((*(kinds.count(k) for k in KINDS), joined(base), joined(every), redacted(t, every) if every else None))
            yield pd.DataFrame(out, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans", "redacted"])
            give_back()

    return F.pandas_udf(rows, "n_email long, n_ip long, n_card long, n_phone long, base string, spans string, redacted string")(text)
