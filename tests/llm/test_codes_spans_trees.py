"""Vector codes, personal data and Merkle manifests against plain Python."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from tidemark.llm import merkle, personal_data, vector_codes

VECTORS = "vec_id long, embedding array<double>, label int"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


# vector codes


def plain_codes(rows, parts=16, entries=64, rounds=2):
    """The contract by loops: (vec_id, code, error, label_error, digest) of the kept rows."""
    kept = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    ints = [[int(np.floor(256 * x)) for x in r[1]] for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    width = len(ints[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in ints]
    books = [[cut[i][p] for i in order[:entries]] for p in range(parts)]

    def best(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            members = collections.defaultdict(list)
            for v in cut:
                members[best(p, v[p])[1]].append(v[p])
            books[p] = [tuple(sum(c) // len(members[j]) for c in zip(*members[j], strict=True)) if members[j] else e for j, e in enumerate(books[p])]
    digest = sha(",".join(str(c) for book in books for e in book for c in e))
    out, by_label = [], collections.Counter()
    for r, v in zip(kept, cut, strict=True):
        found = [best(p, v[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{j:02x}" for _, j in found), sum(d for d, _ in found), r[2]))
        by_label[r[2]] += out[-1][2]
    return collections.Counter((i, code, e, by_label[label], digest) for i, code, e, label in out)


def vectors(n: int, width: int = 32, seed: int = 5, grid: int = 0) -> list[tuple]:
    rng = random.Random(seed)
    value = (lambda: rng.randint(-grid, grid) / 256) if grid else (lambda: rng.gauss(0, 0.3))
    return [(i * 3, [value() for _ in range(width)], rng.choice([None, 1, 1, 1, 2])) for i in range(n)]


@pytest.mark.parametrize("grid", [0, 2])
def test_vector_codes(spark, grid):
    """grid: components of few values, so that most parts are equally near to several entries."""
    rows = vectors(150, grid=grid)
    rows += [rows[7], rows[7], (rows[9][0], rows[3][1], 2), (None, rows[5][1], None), (1, None, 1), (2, [], 1), (4, [*rows[0][1][:-1], None], 1), (5, [*rows[0][1][:-1], float("nan")], 1), (7, [*rows[0][1][:-1], float("-inf")], 1)]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, VECTORS).repartition(5).withColumns({c: F.lit("x") for c in ("code", "part", "entry", "n", "error", "of_label")})
    found = vector_codes.compressed(df)
    assert found.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert collections.Counter(tuple(r) for r in found.collect()) == plain_codes(rows)


def test_vector_codes_of_few_and_no_vectors(spark):
    few = vectors(3)
    assert collections.Counter(tuple(r) for r in vector_codes.compressed(spark.createDataFrame(few, VECTORS)).collect()) == plain_codes(few)
    for none in ([], [(1, None, 1), (2, [], 2)]):
        assert vector_codes.compressed(spark.createDataFrame(none, VECTORS)).count() == 0
    with pytest.raises(Exception, match="components"):
        vector_codes.compressed(spark.createDataFrame([*few, (99, [0.5] * 16, 1)], VECTORS)).count()


def test_tree_search_is_exact_and_prunes():
    rng = np.random.default_rng(2)
    for spread, width in ((3, 1), (4, 3), (200, 4), (1 << 28, 4)):
        book = rng.integers(-spread, spread + 1, (64, width))
        queries = rng.integers(-spread, spread + 1, (3000, width))
        index, d2 = vector_codes.nearest(book, queries)
        every = ((queries[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == every.argmin(axis=1)).all() and (d2 == every.min(axis=1)).all()
    centres = rng.integers(-10_000, 10_000, (64, 2))
    queries = centres[rng.integers(0, 64, 2000)] + rng.integers(-20, 20, (2000, 2))
    search = vector_codes.Search(centres, vector_codes.grown(centres, np.arange(64)), queries)
    assert search.compared < 0.5 * 64 * len(queries)


# personal data


def plain_base(text: str) -> list[tuple[str, int, int]]:
    """The contract's patterns as they stand."""

    def luhn(digits):
        doubled = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return out


def test_base_spans_are_the_patterns():
    rng = random.Random(8)
    pieces = ["4111 1111 1111 1111", "4111111111111111", "+1 (555) 123-4567", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "001.0255.3.4", "a.b@c.d", "x@y", "@", "a@b@c.de", "%+-@-.-", "+", " ", "-", ".", "..", "é", "７", "\n", "12", "7", "(", ")", "word", "_", "+49 30 1234567", "5500-0000-0000-0004", "😀"]
    for _ in range(4000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        assert sorted(personal_data.base_spans(text)[0]) == sorted(plain_base(text)), text


def test_the_method_adds_what_context_and_checksums_confirm():
    def added(text):
        return {(s[0], text[s[1] : s[2]]) for s, _, base in personal_data.scored_spans(text) if not base}

    assert added("call +1 (269) 555-3296 4524132264652876 now") == {("phone", "+1 (269) 555-3296"), ("card", "4524132264652876")}
    assert added("IBAN DE89 3704 0044 0532 0130 00 bitte") == {("iban", "DE89 3704 0044 0532 0130 00")}
    assert added("IBAN DE88 3704 0044 0532 0130 00 bitte") == set()
    assert added("my social security number is 219-09-9999.") == {("ssn", "219-09-9999")}
    assert added("part 219-09-9999 of the list") == added("219-09-9999") == set()
    assert added("Amex card 378282246310005 expires") == {("card", "378282246310005")}
    assert added("Telefon 030 1234 5678, danke") == {("phone", "030 1234 5678")}
    assert added("the years 1998 2004 2010 and pages 030 1234 5678") == set()
    assert added("clean words, 12 apples, 3.14 and 2024-01-05 at 10:30") == set()
    for text in ("token = \"a4111111111111111b\"", "order 4111111111111112"):
        assert added(text) == set()


def test_personal_data_rows(spark):
    from pyspark.sql import functions as F

    some = [None, "", "a@b.cd", "é a@b.cd 1.2.3.4 +1 (269) 555-3296 4524132264652876", "plain words", "4111 1111 1111 1111 and x@y.z"]
    rows = [(i, t) for i, t in enumerate(some)] + [(None, "q@r.st"), (2, "a@b.cd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("spans", "n_email", "scores")})
    found = collections.Counter(tuple(r)[:6] for r in personal_data.personal_data(df).collect())
    expected = collections.Counter()
    for i, t in rows:
        base = sorted(plain_base(t or ""), key=lambda s: (personal_data.KINDS.index(s[0]), s[1]))
        expected[(i, *[sum(s[0] == k for s in base) for k in ("email", "ip", "card", "phone")], sha(",".join(f"{k}:{a}:{b}" for k, a, b in base)))] += 1
    assert found == expected
    for r in personal_data.personal_data(df).collect():
        assert len([x for x in r.spans.split(",") if x]) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_added == len([x for x in r.scores.split(",") if x])
    assert personal_data.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("unit", ["a", "1", "1 ", "1.", "a@", "a@b", "+1", "+1 ", "@a.", "AB12 ", "1-", "4111111111111111 ", "AD12", "123-45-6789 ", "."])
def test_scans_are_linear(unit):
    began = time.perf_counter()
    personal_data.scored_spans(unit * (300_000 // len(unit)))
    assert time.perf_counter() - began < 20


# Merkle manifests


def plain_manifest(rows, fanout=2):
    """(doc_id, leaf, subroot, root, proof, folded, verified) by loops."""

    def leaf(r, bent=False):
        doc_id, text, lang, source, n = r
        n = n + 1 if bent and n is not None else n
        return sha("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n, text)))

    def climb(nodes):
        """The root, and for each node the (before, after) siblings on its way."""
        paths, groups = [[] for _ in nodes], [[i] for i in range(len(nodes))]
        while len(nodes) > 1:
            runs = [range(i, min(i + fanout, len(nodes))) for i in range(0, len(nodes), fanout)]
            for run in runs:
                for k in run:
                    for i in groups[k]:
                        paths[i].append(("".join(nodes[j] for j in run if j < k), "".join(nodes[j] for j in run if j > k)))
            nodes, groups = [sha("".join(nodes[j] for j in run)) for run in runs], [[i for j in run for i in groups[j]] for run in runs]
        return nodes[0], paths

    by_lang = collections.defaultdict(list)
    for r in rows:
        by_lang[r[2]].append(r)
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = climb([leaf(r) for r in by_lang[lang]])
    root, tops = climb([trees[x][0] for x in order])
    out = collections.Counter()
    for lang, top in zip(order, tops, strict=True):
        for r, path in zip(by_lang[lang], trees[lang][1], strict=True):
            bent = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            folded = leaf(r, bent)
            for before, after in path + top:
                folded = sha(before + folded + after)
            out[r[0], leaf(r), trees[lang][0], root, sha("".join(b + a for b, a in path + top)), folded, folded == root] += 1
    return out


@pytest.mark.parametrize("fanout", [2, 3])
def test_merkle_manifest(spark, fanout):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = [(rng.choice([None, i, i, i - 5]), rng.choice([None, "", f"text {i} é"]), rng.choice(["en"] * 6 + ["fr", "fr", None, "", "é", "zz"]), rng.choice([None, "s"]), rng.choice([None, i])) for i in range(150)]
    rows += [rows[3], rows[3], rows[4], (900, "alone", "only", "s", 5)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("grp", "idx", "n", "digest", "path", "uid", "name", "root", "children", "slice")})
    found = merkle.documents_manifest(df, fanout, slice_rows=20)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    expected = plain_manifest(rows, fanout)
    assert collections.Counter(tuple(r) for r in found.collect()) == expected
    assert any(not k[-1] for k in expected) and any(k[-1] for k in expected)


def test_merkle_manifest_small(spark):
    for rows in ([], [(7, "t", "en", "s", 1)], [(1, "t", "en", "s", 1), (2, "u", "fr", "s", None)], [(None, None, None, None, None)]):
        found = merkle.documents_manifest(spark.createDataFrame(rows, DOCS))
        assert collections.Counter(tuple(r) for r in found.collect()) == (plain_manifest(rows) if rows else collections.Counter())


def test_decontamination_of_a_repetitive_document(spark):
    """A document of one word again and again is compared on every diagonal, in work that grows with its length."""
    from tidemark.llm import decontaminate

    items = spark.createDataFrame([(1, "w " * 30), (2, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen")], "item_id long, text string")
    took = {}
    for n in (5_000, 20_000, 20_000):  # the first run compiles
        docs = spark.createDataFrame([(1, "w " * n), (2, "x " * n + "one two three four five SIX seven eight nine 10 eleven twelve thirteen fourteen"), (3, "x " * n)], "doc_id long, text string")
        began = time.perf_counter()
        found = {(r.doc_id, r.item_id): (r.n_agree, r.best_window) for r in decontaminate.leaks(docs, items).collect()}
        took[n] = time.perf_counter() - began
        assert found == {(1, 1): (30, 13), (2, 2): (13, 12)}
    assert took[20_000] < 60
