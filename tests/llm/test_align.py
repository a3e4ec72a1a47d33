import bisect
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wakeline.llm import align

from .cases import empty, frame, rows


def tokens(text):
    """Whole texts by both libraries: (ids, bytes) of A and B, or none."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    if not hasattr(tokens, "a"):
        path_a, path_b = align.paths()
        tokens.a, tokens.b = Tokenizer.from_file(path_a), SentencePieceProcessor(model_file=path_b)
        tokens.a.encode_special_tokens = True
        plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
        tokens.letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    if not text:
        return [], []
    raw = f" {text}".encode()
    of_a = lambda i: bytes(tokens.letters[c] for c in tokens.a.id_to_token(i))

    def of_b(i):
        p = tokens.b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    a = [(i, of_a(i)) for i in tokens.a.encode(f" {text}", add_special_tokens=False).ids]
    b = [(i, of_b(i)) for i in tokens.b.encode(text)]
    return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])


def brute(docs):
    groups = []
    for _, text in docs:
        a, b = tokens(text)
        ends = []
        for side in (a, b):
            at, out = 0, []
            for _, x in side:
                at += len(x)
                out.append(at)
            ends.append(out)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        group = [([], []) for _ in cuts]
        for k, side in enumerate((a, b)):
            for (i, _), e in zip(side, ends[k], strict=True):
                group[bisect.bisect_left(cuts, e)][k].append(i)
        groups.append(group)
    counts = Counter(p for g in groups for p in {(i, j) for x, y in g for i in x for j in y})
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = []
    for (d, _), g in zip(docs, groups, strict=True):
        links = [(i, j) for x, y in g for i in x for j in y]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g)
        digest = hashlib.sha256(text.encode()).hexdigest() if text else ""
        out.append((d, sum(len(x) for x, _ in g), sum(len(y) for _, y in g), len(g), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), digest))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df, **more):
    return sorted((tuple(r[c] for c in COLUMNS) for r in align.digest(align.align(df, **more)).collect()), key=str)


ODD = [
    "<|endoftext|> is text", "a▁b ▁", " ", "  two  spaces ", "tabs\tand\n\nlines \n x", "　wide space x y", "ﬁne é ½", "日本語のテキスト です", "\x00 \x01",
    "x" * 3000, "    ", "emoji 😀😀 end", "don't 12345 3.14 (a) [b] {c};\r\n", "ends with space ", "\n", "<s> <unk> </s> <0x41>", "don 't ' s ' ll",
]


@pytest.mark.parametrize("chunk_bytes", [align.CHUNK_BYTES, 50])
def test_odd_texts_against_brute_force(spark, chunk_bytes):
    docs = [(i, t) for i, t in enumerate(ODD + ["the same words here"] * 3 + [None, ""])] + [(None, "no id"), (2**53 + 1, "no id"), (2**53 + 1, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    assert got(df, chunk_bytes=chunk_bytes) == brute(docs)


def test_table_against_brute_force(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    assert got(df) == brute([tuple(r) for r in df.collect()])


def test_relational_alignment_of_lists(spark):
    rng = random.Random(4)

    def cut(n):
        at = sorted(rng.sample(range(1, n), rng.randrange(0, min(n, 9)))) if n > 1 else []
        return [b - a for a, b in zip([0, *at], [*at, n], strict=True)]

    lists = [(k, cut(n), cut(n)) for k, n in enumerate(rng.randrange(1, 30) for _ in range(200))]
    out = {r["list"]: r for r in align.alignments(spark.createDataFrame(lists, "list long, a array<int>, b array<int>")).collect()}
    for k, a, b in lists:
        ends = lambda x: [sum(x[: i + 1]) for i in range(len(x))]
        both = set(ends(a)) & set(ends(b))
        group = lambda x: [sum(c < e for c in both) for e in ends(x)]
        assert (out[k]["group_a"], out[k]["group_b"]) == (group(a), group(b))
        links = [(i, j) for i, g in enumerate(group(a)) for j, h in enumerate(group(b)) if g == h]
        assert list(zip(out[k]["link_a"], out[k]["link_b"], strict=True)) == links


def test_texts_are_split_into_units():
    both = align.Tokenizers(*align.paths())
    assert both.splits and both.units("a b  c\n d▁ e") == [" a", " b", "  c\n d▁ e"]
    for text in ODD:
        whole, (a, b, _) = tokens(text), both.encode(both.units(text))
        if whole[0]:
            assert [i for x in a for i in x.tolist()] == [i for i, _ in whole[0]] and [i for y in b for i in y] == [i for i, _ in whole[1]]


def test_units_encoded_as_one_text():
    both = align.Tokenizers(*align.paths())
    units = list(dict.fromkeys(u for t in ODD if "▁" not in t for u in both.units(t))) * 5
    raw = [u.encode() for u in units]
    told = both.joined(units, np.cumsum(list(map(len, raw))), b"".join(raw))
    alone = [both.flat([u]) for u in units]
    assert told is not None and all(np.array_equal(x, np.concatenate(y)) for x, y in zip(told, zip(*alone, strict=True), strict=True))
    # Where a unit is not given back, all of them are encoded one by one.
    odd = [" a", " ▁b", " c"]
    assert both.joined(odd, np.cumsum([len(u.encode()) for u in odd]), "".join(odd).encode()) is None
    assert both.flat(odd)[4].tolist() == [True, False, True]
    assert [x.tolist() for x in both.flat([])] == [[]] * 5


def test_edges(spark):
    assert got(frame(spark)) == brute([(r[0], r[1]) for r in rows()])
    assert got(empty(spark)) == []
    assert align.align(frame(spark)).where(F.col("groups") == "").count() == 2
