"""Personal data: rules that always hold, and further spans chosen by boosted trees.

The rules find e-mail addresses, IPv4 addresses, payment cards (Luhn) and international phone numbers. High-recall
generators then propose further and wider spans, overlapping ones too: addresses with letters beyond ASCII or written
out ("name at host dot org"), IPv6, cards of 13 to 15 digits or with dots, national phone numbers. Boosted trees score
each proposal by its format and its context; a threshold for each kind, chosen on held-out examples after calibration,
selects those that are redacted besides the spans of the rules. The trees are trained here, on EXAMPLES examples drawn
from format grammars with a fixed seed: proposals of the same generators in texts with personal data and in texts with
numbers that look alike (versions, dates, prices, order numbers, hashes).

All patterns run in time linear in the text, apart from runs of bounded length. Positions are code points, ends
exclusive. Defined results: a null or empty text has no spans; repeated rows give equal rows; a null doc_id stays
null; other columns are ignored (find_pii) or kept (redact); an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees

KINDS = ("email", "ip", "card", "phone")
#: Bound of the training sample, drawn from grammars; a third is held out for calibration and thresholds.
EXAMPLES = 6000
#: Share of selected held-out proposals that must be right.
PRECISION = 0.98
#: Characters of context on either side.
CONTEXT = 24

# The patterns of the rules. The look-behinds leave out starts from which a match can only fail again.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

AT = r"\(at\)|\[at\]|\{at\}|\sat\s"
WRITTEN_AT = re.compile(AT, re.I)
PROPOSALS = {
    "email": (
        re.compile(r"(?<![\w.%+-])[\w.%+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63}){1,8}"),
        re.compile(rf"(?<![\w.+-])[\w.+-]{{1,64}}\s?(?:{AT})\s?[\w-]{{1,63}}(?:\s?(?:\(dot\)|\[dot\]|\{{dot\}}|\sdot\s|\.)\s?[\w-]{{1,24}}){{1,4}}", re.I),
    ),
    "ip": (re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])|(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![\w:])"),),
    "card": (re.compile(r"(?<![\w.-])[0-9]{4}(?:[ .-]?[0-9]{2,6}){2,4}(?![\w-])"),),
    "phone": (
        re.compile(r"(?<![\w+.-])\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{2,4}(?:[ ./-][0-9]{2,5}){1,3}(?![\w-])"),
        re.compile(r"(?<![\w+.-])00[1-9][0-9]{0,2}(?:[ .()-]{1,2}[0-9]{2,5}){2,4}(?![\w-])"),
    ),
}
CUES = {
    "email": re.compile(r"mail|contact|write|reach|send", re.I),
    "ip": re.compile(r"\bip\b|address|host|server|login|from", re.I),
    "card": re.compile(r"card|visa|master|amex|credit|pay|kreditkarte|carte|tarjeta", re.I),
    "phone": re.compile(r"tel|phone|call|fax|mobil|dial|whatsapp|handy", re.I),
}
# Usual endings of host names.
ENDINGS = re.compile(r"(?:^|[\W_]|dot\s)(?:com|org|net|edu|gov|info|biz|io|eu|de|fr|es|it|nl|ch|at|be|pl|uk|us|ca|au|in|jp|cn|br|ru)$", re.I)
BRACKETS = re.compile(r"[(\[{](?:at|dot)[)\]}]", re.I)
AGAINST = re.compile(r"version|\bv\.?$|order|invoice|isbn|issn|serial|part|price|usd|eur|[$€£#§]|page|section|date|chapter|id\b|ref", re.I)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(x), 10)) for x in digits[-2::-2])
    return total % 10 == 0


def only_digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of the rules, by kind, then start."""
    found, since = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > since and LOCAL.match(text, start - 1):
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        since = match.end() if match else max(since, at + 1)
        if match:
            found.append(("email", start, since))
        at = text.find("@", since)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := only_digits(m[0])) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 8 <= len(only_digits(m[0])) <= 15:
            found.append(("phone", *m.span()))
    return found


def proposed_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the generators, overlapping ones too."""
    found = []
    for kind, patterns in PROPOSALS.items():
        for k, pattern in enumerate(patterns):
            if kind == "email" and (k == 0 and "@" not in text or k == 1 and not WRITTEN_AT.search(text)):
                continue  # no match without it
            if kind == "ip" and ":" not in text:
                continue
            found += [(kind, *m.span()) for m in pattern.finditer(text)]
    return found


def span_features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format of the span and what stands around it."""
    s, left, right = text[start:end], text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits = only_digits(s)
    groups = [len(x) for x in re.findall("[0-9]+", s)]
    n = max(1, len(s))
    return [
        *(float(kind == k) for k in KINDS),
        len(s), len(digits), len(set(digits)), len(groups), max(groups, default=0), min(groups, default=0), groups[-1] if groups else 0,
        float(bool(digits) and luhn(digits)), sum(c.isalpha() for c in s) / n, s.count("."), s.count("-"), s.count(" "), s.count("/"), s.count(":"),
        float("(" in s), float("@" in s), float(s[:1] == "0"), float(digits[:1] in ("3", "4", "5", "6")), float(bool(re.search(r"\.[A-Za-z]{2,6}$|dot\W+[A-Za-z]{2,6}$", s))),
        float(bool(ENDINGS.search(s))), float(bool(BRACKETS.search(s))), float(bool(re.search(r"\.\s", s))), float(s[:2] == "00"),
        float(bool(CUES[kind].search(left))), float(bool(AGAINST.search(left))), float(left[-1:].isalnum()), float(right[:1].isalnum()),
        float(right[:1] in (".", "-", ":", "/")), float(bool(re.search("[0-9]", left[-3:]))), float(bool(re.search("[0-9]", right[:3]))),
    ]


def drawn_examples(n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of proposals in n texts drawn from grammars."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    pick = lambda *x: x[rng.integers(len(x))]
    word = lambda: "".join(pick("an", "re", "mi", "ton", "el", "sú", "ka", "oß", "li", "é", "dor") for _ in range(rng.integers(1, 5)))

    def card(length: int, dot: str) -> str:
        body = pick("4", "5", "37", "6") + num(length)
        body = body[: length - 1]
        full = next(body + str(c) for c in range(10) if luhn(body + str(c)))
        cuts = (4, 10) if length == 15 else (4, 8, 12)
        return dot.join(full[a:b] for a, b in zip((0, *cuts), (*cuts, None), strict=True))

    cased = lambda x: x.upper() if rng.random() < 0.2 else x
    right = {
        "email": lambda: pick(
            lambda: f"{word()}.{word()}{pick(' at ', ' (at) ', '[at]', '(at)')}{word()}{pick(' dot ', '[dot]', '(dot)', '.')}{pick('com', 'org', 'net', 'de')}",
            lambda: cased(f"{word()}{pick(' at ', ' (at) ', '[at]', '(at)', ' [at] ')}{word()}{pick(' dot ', '[dot]', '(dot)', ' (dot) ')}{pick('com', 'org', 'net', 'de', 'info', 'fr', 'es', 'io')}"),
            lambda: f"{word()}é{num(2)}@{word()}.{pick('com', 'org', 'fr', 'example.com')}",
        )(),
        "ip": lambda: pick(lambda: ":".join(f"{x:x}" for x in rng.integers(0, 65536, 8)), lambda: f"fe80::{rng.integers(4096):x}:{rng.integers(1, 65536):x}", lambda: f"2001:db8::{rng.integers(1, 65536):x}")(),
        "card": lambda: pick(lambda: card(15, pick("", " ", "-")), lambda: card(16, "."))(),
        "phone": lambda: pick(lambda: f"({num(3)}) {num(3)}-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"0{num(3)} {num(3)} {num(4)}", lambda: f"00{rng.integers(1, 99)} {num(3)} {num(3)} {num(4)}", lambda: f"00{rng.integers(1, 999)}{pick(' ', '-')}{num(rng.integers(2, 4))} {num(rng.integers(3, 5))} {num(rng.integers(3, 5))}", lambda: f"0{num(2)}/{num(3)} {num(4)}")(),
    }
    wrong = {
        "email": lambda: pick(lambda: f"{word()} at {word()} dot {word()}", lambda: f"{word()} at {word()}.{word()}", lambda: f"{word()} at {word()}. {word().capitalize()}", lambda: f"{word()} at {word()}.{pick(' ', chr(10))}{pick('In', 'It', 'At', 'De', 'Es', 'Be', 'Us', 'Fr')}")(),
        "ip": lambda: pick(lambda: f"{rng.integers(24):02}:{rng.integers(60):02}::{rng.integers(60):02}", lambda: f"a::{word()}", lambda: f"1::{rng.integers(10)}")(),
        "card": lambda: pick(lambda: num(16), lambda: num(15), lambda: f"{num(4)}.{num(4)}.{num(4)}", lambda: f"{num(4)} {num(4)} {num(4)}", lambda: f"{1900 + rng.integers(130)}-{num(2)}-{num(2)} {num(2)}", lambda: num(14))(),
        "phone": lambda: pick(lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}/{num(2)}/{num(4)}", lambda: f"{num(3)}-{num(2)}-{num(5)}", lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"{num(2)}-{num(2)}", lambda: f"{num(3)}-{num(4)}-{num(4)}-{num(3)}")(),
    }
    cue = {"email": "mail contact write", "ip": "host server login from ip", "card": "card visa credit amex", "phone": "tel phone call fax mobil"}
    x, y, kinds = [], [], []
    while len(y) < n:
        kind, good = KINDS[rng.integers(4)], bool(rng.integers(2))
        body = (right if good else wrong)[kind]()
        lead = pick(*cue[kind].split()) if rng.random() < (0.6 if good else 0.15) else pick("version", "order", "invoice no", "price", "#") if not good and rng.random() < 0.5 else word()
        text = f"{word()} {word()} {lead}{pick(' ', ': ')}{body}{pick(' ', ', ', '. ')}{word()} {word()}"
        at = text.index(body)
        for k, start, end in proposed_spans(text):
            hit = good and k == kind and start >= at and abs(end - at - len(body)) <= 1 and start == at
            x.append(span_features(text, k, start, end))
            y.append(hit)
            kinds.append(k)
    return np.array(x), np.array(y, float), kinds


_fitted: dict[tuple[int, int], tuple[BoostedTrees, dict[str, float]]] = {}


def fit_selector(examples: int = EXAMPLES, seed: int = 42) -> tuple[BoostedTrees, dict[str, float]]:
    """Trees and the threshold of each kind: the lowest calibrated one that holds PRECISION on held-out examples."""
    if (examples, seed) not in _fitted:
        x, y, kinds = drawn_examples(examples, seed)
        held = np.arange(len(y)) % 3 == 0
        model = BoostedTrees().fit(x[~held], y[~held]).calibrate(x[held], y[held])
        p, own, limits = model.proba(x[held]), np.array(kinds)[held], {}
        for kind in KINDS:
            score, truth = p[own == kind], y[held][own == kind]
            order = np.argsort(-score, kind="stable")
            right = truth[order].cumsum() / np.arange(1, len(order) + 1)
            # of equal scores all or none are taken
            ends = np.flatnonzero(np.append(np.diff(score[order]) != 0, True)) if len(order) else np.array([], int)
            good = [k for k in ends if right[k] >= PRECISION]
            limits[kind] = max(0.5, float(score[order][max(good)])) if good else 2.0
        _fitted[examples, seed] = model, limits
    return _fitted[examples, seed]


def find_spans(texts: list[str | None], model: BoostedTrees, limits: dict[str, float]) -> list[list[tuple[str, int, int, float, bool]]]:
    """For each text its (kind, start, end, score, base), by kind, then start; the score of a rule's span is 1."""
    found, asked, where = [], [], []
    for k, text in enumerate(texts):
        base = base_spans(text) if text else []
        found.append([(*s, 1.0, True) for s in base])
        known = set(base)
        for span in dict.fromkeys(proposed_spans(text)) if text else ():
            # inside a rule's span there is nothing left to redact
            if span not in known and not any(a <= span[1] and span[2] <= b for _, a, b in base):
                asked.append(span_features(text, *span))
                where.append((k, span))
    if asked:
        for (k, span), p in zip(where, model.proba(np.array(asked)), strict=True):
            if p >= limits[span[0]]:
                found[k].append((*span, float(p), False))
    order = {kind: k for k, kind in enumerate(KINDS)}
    return [sorted(x, key=lambda s: (order[s[0]], s[1], s[2])) for x in found]


SPANS = "spans array<struct<kind:string,start:long,end:long,score:double,base:boolean>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """doc_id and SPANS of every row of docs (doc_id, text): all spans by kind as in KINDS, then start."""
    model, limits = fit_selector()
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = find_spans(batch.column("text").to_pylist(), model, limits)
            spans = [[dict(zip(("kind", "start", "end", "score", "base"), s, strict=True)) for s in x] for x in rows]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, pa.list_(item))], names=["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {SPANS}")


def digests(found: DataFrame) -> DataFrame:
    """Counts of base spans, their digest, and all spans as text."""

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; spans that overlap become one.

    Columns and rows stay as they are; n_chars, where there is one, is counted anew. A null text stays null.
    """
    model, limits = fit_selector()

    def clean(text: str | None, spans: list[tuple[str, int, int, float, bool]]) -> str | None:
        out, since = [], 0
        for kind, start, end, *_ in sorted(spans, key=lambda s: (s[1], -s[2])):
            if start >= since:
                out += [text[since:start], f"<{kind.upper()}>"]
            since = max(since, end)
        return "".join([*out, text[since:]]) if out else text

    @F.pandas_udf("string")
    def redacted(texts: pd.Series) -> pd.Series:
        rows = [None if x is None or x != x else x for x in texts]
        return pd.Series([clean(t, s) for t, s in zip(rows, find_spans(rows, model, limits), strict=True)], dtype=object)

    out = docs.withColumn("text", redacted("text"))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
