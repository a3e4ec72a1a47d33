import random

from wakeline.llm import revisits as R
from wakeline.sources.storage import table

SCHEMA = "record_id long, url string, at long, kind string, headers map<string,string>, digest string, body string"


def strong(tag):
    return tag.strip().removeprefix("W/")


def brute(records):
    out = {}
    for r in records:
        if r[3] != "revisit":
            continue
        key = r[1].split("#")[0] if r[1] else None
        own = {k.lower(): v for k, v in (r[4] or {}).items()}
        earlier = [s for s in records if s[3] == "response" and s[1] and key and s[1].split("#")[0] == key and s[2] is not None and r[2] is not None and (s[2], s[0]) < (r[2], r[0])]
        if not earlier:
            out[r[0]] = (None, "no_response", None)
            continue
        s = max(earlier, key=lambda s: (s[2], s[0]))
        theirs = {k.lower(): v for k, v in (s[4] or {}).items()}
        pairs = [(own.get("etag"), theirs.get("etag")), (own.get("last-modified"), theirs.get("last-modified")), (r[5], s[5])]
        both = [(a, b) for a, b in pairs if a is not None and b is not None]
        if not both:
            out[r[0]] = (None, "no_validator", None)
        elif strong(both[0][0]) != strong(both[0][1]):
            out[r[0]] = (None, "validator_mismatch", None)
        else:
            merged = theirs | {k: v for k, v in own.items() if k in R.PERMITTED and v is not None}
            out[r[0]] = (s[0], "resolved", merged)
    return out


def records(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        url = rng.choice(["http://hot/", "http://hot/", f"http://h{rng.randrange(9)}/x", None])
        tag = rng.choice(['"a"', 'W/"a"', '"b"', None])
        headers = rng.choice([None, {"ETag": tag, "Cache-Control": f"c{i}", "Content-Type": "t"}, {"last-modified": rng.choice("xy"), "Server": "s"}])
        at = rng.choice([None, *range(0, 20000, 400)]) if rng.random() < 0.5 else rng.randrange(20000)
        kind = rng.choice(["response", "revisit"])
        rows.append((i, url + "#f" if url and rng.random() < 0.3 else url, at, kind, headers, rng.choice(["d", "e", None]), f"body{i}" if kind == "response" else None))
    return rows


def test_against_brute_force(spark):
    rows = records(4)
    for slot in (R.SLOT, 100):
        found = R.resolve(spark.createDataFrame(rows, SCHEMA).repartition(3), slot).collect()
        got = {r["record_id"]: (r["response_id"], r["outcome"], r["headers"]) for r in found}
        assert len(found) == len(got) and got == brute(rows)
        assert all(r["body"] == f"body{r['response_id']}" for r in found if r["outcome"] == "resolved")


def test_edges(spark):
    assert R.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
    twice = [(1, "http://a/", 1, "response", {"etag": "x"}, None, "b"), (2, "HTTP://A", 2, "revisit", {"ETAG": "x", "Etag": "x"}, None, None)] * 2
    extra = spark.createDataFrame(twice, SCHEMA).selectExpr("*", "1 AS _slot", "2 AS canonical", "3 AS outcome")
    assert [(r["response_id"], r["outcome"]) for r in R.resolve(extra).collect()] == [(1, "resolved")] * 2
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    assert R.digest(R.resolve(R.archive_of(pages))).count() == pages.count()
