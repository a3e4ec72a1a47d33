import hashlib
import random
import re

from hypothesis import given
from hypothesis import strategies as st

from wakeline.llm import pii as P

from .cases import empty, frame, rows

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute(text):
    digits = lambda m: re.findall("[0-9]", m.group())
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and P.luhn("".join(digits(m)))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@given(st.text(alphabet="ab9801.@-+ (%_)é", max_size=120))
def test_base_rules_against_the_patterns(text):
    assert P.base_spans(text) == brute(text)


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "9" * 300_000, "a@" * 100_000, "1." * 150_000, "+1" * 100_000):
        P.base_spans(text)
        P.candidates(text, [])


TEXTS = [
    "write to jo.doe@mail.example.com or call +1 (212) 555-7713 now",
    'the token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" is secret',
    "password=e3b3ed3cc8548923d6 for the host 97.51.17.173",
    "pay with 4111 1111 1111 1111 please",
    "nothing personal here at all",
]


def test_methods_spans_are_added_and_base_ones_stay(spark):
    docs = [(i, t) for i, t in enumerate(TEXTS * 20)]
    got = P.find(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    for r in got:
        base = brute(docs[r["doc_id"]][1])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) == tuple(sum(k == n for k, _, _ in base) for n in P.BASE)
    spans = {r["doc_id"] % 5: r["spans"] for r in got}
    assert "secret" in spans[1] and "secret" in spans[2] and spans[4] == ""


def test_names_are_found_wherever_they_stand():
    for name in ("Mary Smith", "Priya Raman", "José García", "Jürgen Müller", "Mary O'Brien", "Anne-Marie McDonald", "Łukasz Żak"):
        for text in (f"({name})", f'by "{name}"', f"Dear {name},", f"Contact {name}", f"Herr {name}", name):
            at = text.index(name)
            assert ("person", at, at + len(name)) in P.candidates(text, [])
    assert P.likeliest([(0.9, 5, 16), (0.9, 11, 20), (0.5, 0, 10)]) == [(5, 16)]
    # A name inside a word is none: the pair it stands in is a candidate that the gazetteer denies.
    assert P.candidates("Rosemary Smith, xMary Smith, Mary Smith2 and Mary smith", []) == [("person", 0, 14)]
    assert P.listed("person", "Rosemary Smith") is False


def test_long_secrets_are_candidates():
    key = "a1B2" * 300
    assert P.candidates(f"key={key} end", []) == [("secret", 4, 4 + len(key))]


def test_reliabilities_follow_agreement():
    p = P.expectation_maximisation({"11-": 80, "10-": 20, "00-": 90, "-1-": 5})
    assert p["11-"] > 0.9 > p["00-"] and p["00-"] < 0.1


def test_ids_beside_a_null(spark):
    ids = [2**53 + 1, None, 2**53 + 3]
    got = P.find(spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").coalesce(1))
    assert {r["doc_id"] for r in got.collect()} == set(ids)


def test_edges(spark):
    assert P.find(frame(spark)).count() == len(rows())
    assert P.find(empty(spark)).count() == 0


#: Names that no gazetteer has.
FAR = ("Priya Raman", "Ahmed Khan", "José García", "Jürgen Müller", "Siobhan O'Brien", "Łukasz Żak", "Anne-Marie McDonald", "Ngozi Okafor")


def planted(seed):
    """Texts with spans that are personal, and others of the same looks that are not."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abdeghilmnorstu") for _ in range(rng.randint(3, 9)))
    code = lambda n, letters="abcdefghjkmnpqrstuvwxyz0123456789": "".join(rng.choice(letters) for _ in range(n - 2)) + "4x"

    def iban(good):
        bank = "".join(rng.choice("0123456789") for _ in range(18))
        n = 98 - int(bank + "131400") % 97
        return f"DE{(n if good else n % 95 + 1):02}{bank}"

    makers = [
        (True, "person", lambda: rng.choice(sorted(P.NAMES)) + " " + word().capitalize(), ["Contact ", "signed by ", "", "Mrs "]),
        (False, "person", lambda: rng.choice(["The", "This", "Our", "On"]) + " " + word().capitalize(), ["", "and so. "]),
        (False, "person", lambda: word().capitalize() + " " + word().capitalize(), ["", "near "]),
        (True, "person", lambda: rng.choice(FAR), ["Dear ", "Herr ", "contact ", "signed by "]),
        (True, "secret", lambda: code(rng.randint(20, 40)), ["password: ", "api_key=", "token "]),
        (False, "secret", lambda: rng.choice("ab") * 14 + "111", ["", "row "]),
        (True, "iban", lambda: iban(True), ["account ", "IBAN: ", ""]),
        (True, "national_id", lambda: f"{rng.randint(100, 599)}-{rng.randint(10, 99)}-{rng.randint(1000, 9999)}", ["SSN ", "id "]),
        (True, "handle", lambda: f"{word()}(at){word()}(dot){rng.choice(['com', 'org', 'de'])}", ["mail ", ""]),
    ]
    docs, truth = [], set()
    for i in range(1500):
        text = f"{word()} {word()}. "
        good, kind, make, cues = rng.choice(makers)
        text += rng.choice(cues)
        value = make()
        if good:
            truth.add((i, kind, len(text), len(text) + len(value)))
        docs.append((i, f"{text}{value} {word()} {word()}."))
    return docs, truth


def test_precision_and_recall_of_planted_spans(spark):
    docs, truth = planted(8)
    found = set()
    for r in P.find(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect():
        found |= {(r["doc_id"], k, int(a), int(b)) for k, a, b in (x.split(":") for x in filter(None, r["spans"].split(",")))}
    assert len(found & truth) >= 0.95 * len(truth)
    assert len(found & truth) >= 0.95 * len(found)


def test_candidates_never_overlap_the_base():
    text = "a@" + "1.1.1.1." * 12 + "abcdefghijklmnop1"
    base = P.base_spans(text)
    assert base and all(b <= c or d <= a for _, a, b in P.candidates(text, base) for _, c, d in base)
