"""Personal data by weak supervision (operator 10).

One scan of each whole text finds the base spans (e-mail, IP, card, phone; exact rules,
always kept) and further candidates: secrets, IBANs, national ids, bare numbers, spelled
out e-mail addresses, and every pair of neighbouring capitalised words, which may be names. Labelers of three sorts vote on every candidate, base
spans included: format rules, gazetteers and context words; each says yes (1), no (0) or
nothing (-). Expectation-maximisation over the counts of vote patterns estimates every
labeler's reliability in both classes and so a probability for each pattern. A logistic
span classifier is then trained on those probabilities from features of the span, and
decides which further candidates are personal data.

Both fits need only counts per (votes, features), both from small fixed sets of values,
so the corpus is aggregated in Spark and a table of bounded size is fitted on the driver.

Positions are code points, end exclusive. Candidates that overlap a base span, or one of a
stricter rule, are left out; names may overlap, and of those that do the likeliest stays, the
first of equals. Defined results: a null or empty text has no spans and
the digest of the empty string; repeated rows are judged alike; other columns are not carried.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, as_longs, as_texts, checkpoint

BASE = ("email", "ip", "card", "phone")
MORE = ("handle", "iban", "national_id", "number", "person", "secret")
KINDS = BASE + MORE

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts within a run of digits, as it would have started at the run's head;
# saying so keeps long runs of digits linear.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

# Candidates beyond the base.
HANDLE = re.compile(r"\b[A-Za-z0-9_.-]{2,40} ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,40} ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,10}\b")
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b")
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?![A-Za-z0-9+/_-])")
# The second word is looked at, not consumed: each capitalised word may start a name.
PART = r"\p{Lu}(?:['\u2019]\p{Lu})?\p{Ll}+(?:\p{Lu}\p{Ll}+)?(?:-\p{Lu}\p{Ll}+)?"
PERSON = regex.compile(rf"(?<![\w'\u2019-])({PART})(?=( {PART})(?![\w-]))")
NUMBER = re.compile(r"(?<![0-9A-Za-z.+-])\(?[0-9][0-9 ().-]{5,22}[0-9](?![0-9A-Za-z.-])")

# Gazetteers: common given names, and top-level names of addresses.
NAMES = frozenset(
    "Alexander Amelia Andreas Anna Antoine Barbara Camille Carlos Carmen Charles Charlotte Christine Claire Daniel David "
    "Elena Elizabeth Emily Emma Felix Francisco George Hannah Hans Isabel Jacques James Javier Jean Jennifer Johann John Jose "
    "Juan Julia Karl Katharina Laura Louis Lucia Manuel Maria Marie Martin Mary Michael Michel Miguel Nicolas Olivia Patricia "
    "Paul Pedro Peter Philippe Pierre Robert Sabine Sarah Sofia Sophie Stefan Susan Thomas Ursula William Wolfgang".split()
)
TOP_LEVEL = frozenset("com org net edu gov info io de fr es uk eu".split())
CUES = {
    "email": "email e-mail mail contact write",
    "handle": "email e-mail mail contact write",
    "ip": "ip host address server from",
    "card": "card visa mastercard credit payment",
    "phone": "phone tel telephone call mobile fax",
    "number": "phone tel telephone call mobile fax account customer",
    "iban": "iban account bank konto",
    "national_id": "ssn social security id passport",
    "person": "name mr mrs ms dr herr frau madame contact signed dear",
    "secret": "password passwd pwd token secret key apikey api_key auth bearer",
}
CUES = {k: frozenset(v.split()) for k, v in CUES.items()}
# Words that often open a sentence or a title.
OPENERS = frozenset("the a an this that these those and but or if when on in at for from to by we you he she it they our your his her its dear new".split())
AGAINST = frozenset("version page isbn chapter figure sha md5 commit checksum build http https www".split())
LEFT = re.compile(r"[A-Za-z_-]+")
#: Least rate at which a labeler is taken to be right.
BETTER = 0.6


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail rule, found from each @, in linear time."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.group().split(".")):
                found.append(("ip", *m.span()))
        for m in CARD.finditer(text):
            if 16 <= m.end() - m.start() <= 37:  # 19 digits and 18 separators at most
                digits = re.sub(r"[\x20-]", "", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    found.append(("card", *m.span()))
        for m in PHONE.finditer(text):
            if 8 <= len(DIGIT.findall(m.group())) <= 15:
                found.append(("phone", *m.span()))
    return found


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates that overlap neither the base nor an earlier candidate."""
    rough: list[tuple[str, int, int]] = []
    if "(at)" in text or "[at]" in text:
        rough += [("handle", *m.span()) for m in HANDLE.finditer(text)]
    if DIGIT.search(text):
        rough += [("iban", *m.span()) for m in IBAN.finditer(text)]
        rough += [("national_id", *m.span()) for m in NATIONAL.finditer(text)]
        for m in SECRET.finditer(text):
            if DIGIT.search(m.group()) and re.search(r"[A-Za-z]", m.group()):
                rough.append(("secret", *m.span()))
        rough += [("number", *m.span()) for m in NUMBER.finditer(text) if len(DIGIT.findall(m.group())) >= 7]
    taken: list[tuple[int, int]] = []
    for a, b in sorted((a, b) for _, a, b in base):
        # Base spans of different kinds may overlap; what they cover is kept as places apart.
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    # Rules are listed from strict to loose: the first that claims a place has it.
    out: list[tuple[str, int, int]] = []
    for kind, a, b in rough:
        if not _overlaps(taken, a, b):
            taken.insert(_place(taken, a), (a, b))
            out.append((kind, a, b))
    pairs = [("person", m.start(), m.end(2)) for m in PERSON.finditer(text)]
    return out + [p for p in pairs if not _overlaps(taken, p[1], p[2])]


def likeliest(names: list[tuple[float, int, int]]) -> list[tuple[int, int]]:
    """Of names (chance, start, end) that overlap the likeliest, the first of equals, in order."""
    out: list[tuple[int, int]] = []
    for _, a, b in sorted(names, key=lambda n: (-n[0], n[1])):
        if not _overlaps(out, a, b):
            out.insert(_place(out, a), (a, b))
    return out


def _place(spans: list[tuple[int, int]], at: int) -> int:
    import bisect

    return bisect.bisect_left(spans, (at, -1))


def _overlaps(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    """spans: sorted and apart, so the last that starts before b reaches furthest."""
    k = _place(spans, b)
    return k > 0 and spans[k - 1][1] > a


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def listed(kind: str, value: str) -> bool | None:
    """Whether a gazetteer has the span's name or ending; None where there is none for the kind."""
    if kind in ("email", "handle"):
        return re.split(r"[^A-Za-z]+", value)[-1].lower() in TOP_LEVEL
    return value.split()[0] in NAMES if kind == "person" else None


def cues_of(kind: str, left: str) -> set[str]:
    """Lower-cased words before a span; before a name only the last two, as names stand at their cue."""
    words = [w.lower() for w in LEFT.findall(left)]
    return set(words[-2:] if kind == "person" else words)


def opens(value: str) -> bool:
    """Whether a pair of words starts as a sentence or with a form of address, not with a name."""
    first = value.split()[0].lower()
    return first in OPENERS or first in CUES["person"]


def votes(kind: str, value: str, left: str) -> str:
    """One character per labeler: 1 yes, 0 no, - nothing."""
    cue_words = cues_of(kind, left)
    digits = DIGIT.findall(value)
    bare = value.replace(" ", "")
    shape = {
        "email": value.rpartition(".")[2].isalpha(), "ip": not re.search(r"\b0[0-9]", value), "phone": 10 <= len(digits) <= 13,
        "handle": None, "card": value[0] in "3456", "national_id": value[4:6] != "00" and value[7:] != "0000",
        "iban": 15 <= len(bare) <= 34, "number": 8 <= len(digits) <= 15, "secret": len(digits) * 5 >= len(value),
        "person": False if opens(value) else None,
    }[kind]
    check = None
    if kind == "card" or kind == "number" and len(digits) >= 16:
        check = luhn("".join(digits))
    elif kind == "iban":
        check = int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1
    elif kind == "ip":
        check = value.split(".")[0] not in ("0", "127", "255")
    elif kind == "national_id":
        check = value[:3] not in ("000", "666") and value[0] != "9"
    gazetteer = listed(kind, value)
    cue = True if cue_words & CUES[kind] else None
    if kind == "person" and not gazetteer and cue:
        gazetteer = None  # no list has all names: it denies only pairs that nothing speaks for
    against = False if cue_words & AGAINST else None
    e = entropy(value) if kind == "secret" else None
    spread = None if e is None else True if e >= 3.2 else False if e < 2.5 else None
    return "".join("-" if v is None else "1" if v else "0" for v in (shape, check, gazetteer, cue, against, spread))


def features(kind: str, value: str, left: str) -> str:
    """Discrete features of a span, one character each after the kind."""
    n = len(value)
    digits = 4 * len(DIGIT.findall(value)) // max(1, n)
    words = cues_of(kind, left)
    sound = not opens(value) if kind == "person" else kind != "secret" or entropy(value) >= 3
    return f"{kind}|{min(7, n.bit_length())}{digits}{int(bool(words & CUES[kind]))}{int(bool(words & AGAINST))}{int(listed(kind, value) is not False)}{int(sound)}"


SCAN = "doc_id string, base array<struct<kind:string,start:long,end:long>>, more array<struct<kind:string,start:long,end:long,votes:string,features:string>>, seen array<struct<votes:string,features:string>>"


def scan(docs: DataFrame) -> DataFrame:
    """Base spans, candidates with votes, and votes on the base, of every document."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                text = text or ""
                base = base_spans(text)
                about = lambda k, a, b, t=text: (k, t[a:b], t[max(0, a - 40) : a])
                more = [
                    {"kind": k, "start": a, "end": b, "votes": votes(*about(k, a, b)), "features": features(*about(k, a, b))}
                    for k, a, b in candidates(text, base)
                ]
                seen = [{"votes": votes(*about(*s)), "features": features(*about(*s))} for s in base]
                rows.append((doc_id, [{"kind": k, "start": a, "end": b} for k, a, b in base], more, seen))
            yield pd.DataFrame(rows, columns=["doc_id", "base", "more", "seen"])

    arrow_rows(docs.sparkSession)
    return as_longs(as_texts(docs.select("doc_id", "text"), "doc_id").mapInPandas(run, SCAN), "doc_id")


def expectation_maximisation(patterns: dict[str, int], rounds: int = 60) -> dict[str, float]:
    """Probability of each pattern, kind|votes, from its count. Every labeler has an own rate of
    yes among its votes in either class, better than chance, and every kind an own share of
    positives; the majority of votes starts it off."""
    if not patterns:
        return {}
    names = sorted(patterns)
    kinds = sorted({p.rpartition("|")[0] for p in names})
    of = np.array([[p.rpartition("|")[0] == k for k in kinds] for p in names], dtype=np.float64)
    cast = [p.rpartition("|")[2] for p in names]
    n = np.array([patterns[p] for p in names], dtype=np.float64)
    yes = np.array([[c == "1" for c in v] for v in cast], dtype=np.float64)
    no = np.array([[c == "0" for c in v] for v in cast], dtype=np.float64)
    p = (yes.sum(1) + 0.5) / (yes.sum(1) + no.sum(1) + 1)
    for _ in range(rounds):
        w1, w0 = n * p, n * (1 - p)
        # Four pseudo-votes to each side hold the classes to the sense of the votes.
        r1 = np.maximum((w1 @ yes + 3) / (w1 @ (yes + no) + 4), BETTER)
        r0 = np.minimum((w0 @ yes + 1) / (w0 @ (yes + no) + 4), 1 - BETTER)
        prior = of @ ((w1 @ of + 1) / (n @ of + 2))
        log1 = np.log(prior) + yes @ np.log(r1) + no @ np.log(1 - r1)
        log0 = np.log(1 - prior) + yes @ np.log(r0) + no @ np.log(1 - r0)
        p = 1 / (1 + np.exp(np.clip(log0 - log1, -50, 50)))
    return dict(zip(names, p.tolist(), strict=True))


def _vector(feature: str) -> np.ndarray:
    kind, rest = feature.split("|")
    x = np.zeros(1 + len(KINDS) + 8 + 5 + 4)
    x[0] = 1
    x[1 + KINDS.index(kind)] = 1
    x[1 + len(KINDS) + int(rest[0])] = 1
    x[9 + len(KINDS) + int(rest[1])] = 1
    x[14 + len(KINDS) + np.arange(4)] = [int(c) for c in rest[2:]]
    return x


def train(counts: list[tuple[str, str, int]]) -> dict[str, float]:
    """Probability of personal data for each feature value seen, by ridge logistic regression
    on the votes' probabilities. counts: (votes, features, spans)."""
    patterns: Counter = Counter()
    for v, f, n in counts:
        patterns[f"{f.split('|')[0]}|{v}"] += n
    label = expectation_maximisation(patterns)
    names = sorted({f for _, f, _ in counts})
    if not names:
        return {}
    x = np.array([_vector(f) for f in names])
    at = {f: i for i, f in enumerate(names)}
    positive, total = np.zeros(len(names)), np.zeros(len(names))
    for v, f, n in sorted(counts):
        positive[at[f]] += n * label[f"{f.split('|')[0]}|{v}"]
        total[at[f]] += n
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (positive - total * p) - w
        curve = (x * (total * p * (1 - p))[:, None]).T @ x + np.eye(len(w))
        w += np.linalg.solve(curve, gradient)
    return dict(zip(names, (1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))).tolist(), strict=True))


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


OUT = "doc_id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per document the base counts and digest, and all spans."""
    scanned = checkpoint(scan(docs))
    voted = scanned.select(F.explode(F.concat(F.col("seen"), F.transform("more", lambda m: F.struct(m["votes"].alias("votes"), m["features"].alias("features"))))).alias("s"))
    counts = [(r["votes"], r["features"], r["n"]) for r in voted.groupBy("s.votes", "s.features").agg(F.count("*").alias("n")).collect()]
    chance = train(counts)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, base, more in zip(part["doc_id"], part["base"], part["more"], strict=True):
                kept = [(s["kind"], s["start"], s["end"]) for s in base]
                likely = [(chance.get(s["features"], 0.0), s["kind"], s["start"], s["end"]) for s in more]
                added = [(k, a, b) for p, k, a, b in likely if p >= least and k != "person"]
                added += [("person", a, b) for a, b in likeliest([(p, a, b) for p, k, a, b in likely if p >= least and k == "person"])]
                n = Counter(k for k, _, _ in kept)
                rows.append((doc_id, *(n[k] for k in BASE), hashlib.sha256(joined(kept).encode()).hexdigest(), joined(kept + added)))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OUT.split(", ")])

    arrow_rows(docs.sparkSession, 2_000)
    return as_longs(as_texts(scanned.select("doc_id", "base", "more"), "doc_id").mapInPandas(run, OUT), "doc_id")
