"""Operators against brute force, on small documents with nulls, ties, copies and clashing columns."""

from __future__ import annotations

import base64
import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from tidemark.llm import components, decontaminate, html_extract, language, language_model, mixing, quality, simhash, substrings, token_counts, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts() -> list[str | None]:
    rng = random.Random(3)
    vocabulary = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 6))) for _ in range(120)] for k, a in (("en", "abcdefgh"), ("fr", "éèçlmnop"))}
    some = [" ".join(rng.choice(vocabulary["en" if i % 3 else "fr"]) for _ in range(rng.randint(40, 160))) for i in range(24)]
    near = some[1].split()
    near[-1] = "changed"
    passage = " ".join(some[2].split()[:40])
    return [
        *some, some[0], some[0], " ".join(near), f"{some[4]}\n{passage} {some[5]}", passage, None, "", "  \n\t", "one", "ONE", "a b", "über STRASSE é",
        "same line here\n" * 12, "x " * 400, "#$ *| <a> & %", "word " * 34, "word " * 35, "a" * 5000, " no break space",
    ]


@pytest.fixture(scope="module")
def rows() -> list[tuple]:
    found = [(i, t, [None, "en", "fr"][i % 3] if t and i % 7 else "en", [None, "b", "a", "hot", "hot"][i % 5], len(t or "")) for i, t in enumerate(texts())]
    return [*found, found[3], found[3]]  # a row three times


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def wide(docs):
    """The same with extra columns, named as operators might name theirs."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("x") for c in ("h", "d", "size", "key", "n_words", "kept", "text_hash", "whole", "head", "count", "tokens", "repetition", "host")})


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str) -> str:
    return text.translate({i: i + 32 for i in range(65, 91)})


def multiset(df, *columns) -> collections.Counter:
    return collections.Counter(tuple(r) for r in df.select(*columns).collect())


def folder(tmp_path_factory_or_spark, docs, name="documents"):
    path = os.path.join("/tmp", f"tidemark-test-{os.getpid()}-{random.random()}")
    docs.write.parquet(f"{path}/{name}.parquet")
    return path


def test_mixing(spark, docs, rows):
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    clamped: set = set()
    while True:
        level = (sum(sizes.values()) - sum(3 * sizes[s] for s in clamped)) / sum(weight[s] for s in order if s not in clamped)
        above = {s for s in order if 3 * sizes[s] < level * weight[s]}
        if above == clamped:
            break
        clamped = above
    path = folder(spark, docs)
    out = mixing.op1_mixing(spark, path).collect()
    assert len(out) == len(rows)
    taken = collections.Counter()
    by_id = {r[0]: r for r in rows}
    for r in out:
        source = by_id[r.doc_id][3]
        assert r.size == len(words(by_id[r.doc_id][1])) and r.source_size == sizes[source]
        assert r.target == pytest.approx(3 * sizes[source] if source in clamped else level * weight[source])
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        taken[source] += r.taken
    for s in order:
        target = next(r.target for r in out if by_id[r.doc_id][3] == s)
        assert abs(taken[s] - target) <= 3 * max(len(words(r[1])) for r in rows if r[3] == s)
    again = mixing.op1_mixing(spark, path)
    assert multiset(again, "doc_id", "taken") == collections.Counter((r.doc_id, r.taken) for r in out)


def test_mixing_columns(wide, docs):
    out = mixing.mix_sources(wide)
    assert out.columns == [*wide.columns, "mix_repetition"]
    plain = mixing.mix_sources(docs)
    assert multiset(out, "doc_id", "mix_repetition") == multiset(plain, "doc_id", "repetition")


def test_mixing_ties(spark):
    """Rows without doc_ids, and rows repeated whole, come within one document of their source's target; empty texts of a clamped source get no fourth copy."""
    rows = [(None, f"a b c d text{i} x y z u v", "en", "free", 1) for i in range(400)] + [(5, "same words in each of these rows here", "en", "same", i % 3) for i in range(500)]
    rows += [(7, None, "en", "tiny", 0), (8, "", "en", "tiny", 0), (9, "three words here", "en", "tiny", 0)] + [(100 + i, "w " * 20, "en", "big", 0) for i in range(300)]
    some = spark.createDataFrame(rows, DOCS)
    cuts = {r.mix_source: r for r in mixing.mix_cuts(mixing.sized_documents(some)).collect()}
    taken, most = collections.Counter(), collections.Counter()
    out = mixing.mix_sources(some)
    assert out.columns == [*some.columns, "repetition"]
    for r in out.collect():
        taken[r.source] += len(words(r.text))
        most[r.source] = max(most[r.source], r.repetition)
    sizes = {"free": 10, "same": 8, "tiny": 3, "big": 20}
    assert all(abs(taken[s] - cuts[s].target) <= n for s, n in sizes.items()) and max(most.values()) <= 3
    digest = mixing.op1_mixing(spark, folder(spark, some)).collect()
    assert len(digest) == len(rows)
    assert sum(r.taken for r in digest) == sum(taken.values()) and all(r.copies <= 3 for r in digest)


def test_substrings(docs, rows):
    every = [[w.encode() for w in words(r[1])] for r in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in every for i in range(len(w) - 34))
    expected = collections.Counter()
    for r, w in zip(rows, every, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        expected[(r[0], len(w), sum(gone), hashlib.sha256(kept).hexdigest())] += 1
    for hot in (substrings.HOT, 1):  # automata, and hash counts of every anchor
        assert multiset(substrings.dedup_substrings(docs, hot=hot), "doc_id", "n_words", "n_removed", "kept_sha256") == expected
    assert any(k[2] not in (0, k[1]) for k in expected)


def test_suffix_automaton():
    rng = random.Random(1)
    for _ in range(200):
        some = [[rng.randint(0, 2) for _ in range(rng.randint(1, 14))] for _ in range(rng.randint(1, 4))]
        weights = [rng.randint(1, 2) for _ in some]
        automaton = substrings.SuffixAutomaton()
        for s, w in zip(some, weights, strict=True):
            automaton.add(s, w)
        automaton.finish()
        count = collections.Counter()
        for s, w in zip(some, weights, strict=True):
            for i in range(len(s)):
                for j in range(i + 1, len(s) + 1):
                    count[tuple(s[i:j])] += w
        for s in some:
            assert automaton.statistics(s) == [max([k for k in range(1, e + 1) if count[tuple(s[e - k : e])] > 1], default=0) for e in range(1, len(s) + 1)]


def test_substring_stage(wide):
    out = substrings.documents_without_repeats(wide)
    assert out.columns == wide.columns
    assert all(r.n_chars == len(r.text or "") for r in out.collect())


def test_language_model(spark, docs, rows):
    tokens = [[*lower(r[1] or "").encode().split(), b"\n"] for r in rows]
    held = [zlib.crc32(str(r[0]).encode()) % 7 == 2 for r in rows]
    count = collections.Counter(w for t, h in zip(tokens, held, strict=True) if not h for w in t)
    n, v = sum(count.values()), len(count)
    expected = collections.Counter()
    for r, t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t)
        expected[(r[0], h, len(t), sum(count[w] > 0 for w in t), n, round(base, 6))] += 1
    out = language_model.language_model_scores(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == expected
    assert sum(r.score for r in out if r.held_out) > sum(r.base_score for r in out if r.held_out) * 1.05
    assert all(r.score < 0 for r in out)


def tiny_model() -> tuple:
    rng = np.random.default_rng(2)
    counts = np.array([50, 20, 20, 7, 3, 1, 1], dtype=np.int64)
    head = np.array([xxhash.xxh64_intdigest(bytes([65 + i])) for i in range(7)], dtype=np.uint64)
    shapes = np.array([1, 1, 2, 2, 3, 3, 3])
    kinds, sizes = np.bincount(shapes, minlength=language_model.SHAPES), np.bincount(shapes, weights=counts, minlength=language_model.SHAPES)
    model = language_model.Model(head, counts, shapes, int(counts.sum()), 7, sizes.astype(float), kinds.astype(float))
    for w in model.weights:
        w += rng.normal(size=w.shape).astype(np.float32)
    return model, head, shapes


def test_model_is_normalised():
    model, head, shapes = tiny_model()
    codes, count = model.look_up(head, shapes)
    assert count.tolist() == [50, 20, 20, 7, 3, 1, 1]
    every = [*codes, *(language_model.TOP + np.arange(language_model.SHAPES))]  # each known token, and an unseen one of each shape
    for before in (codes[0], codes[4], language_model.TOP + 9):
        ln = [language_model.log_probability(model.fitted(), np.array([before, c], dtype=np.uint16), np.array([2]))[1] for c in every]
        # the seven leave their shapes' classes, which then hold an unseen type alone
        assert np.exp(ln).sum() == pytest.approx(1, abs=1e-4)


def plain_score(model, text: str | None, counts: dict) -> float:
    """log10 probability of a text, token by token from the model's weights."""
    m, top, width = model.fitted(), language_model.TOP, language_model.WIDTH
    words = [*lower(text or "").encode().split(), b"\n"]
    total, codes = 0.0, []
    for i, word in enumerate(words):
        h, shape, _ = (x[:1] for x in language_model.encoded([word]))
        code = int(model.look_up(h, shape)[0][0]) if word != b"\n" else int(model.look_up(*(x[-1:] for x in language_model.encoded([b""])[:2]))[0][0])
        codes.append(code)
        outer, inner = language_model.features(np.array(codes, dtype=np.uint16), np.array([len(codes)]))
        logits = [float(m.bias[k]) + sum(float(w[f[-1], k]) for w, f in zip(m.weights, outer)) for k in range(language_model.CLASSES)]
        klass = int(m.classes[code])
        total += logits[klass] - math.log(sum(map(math.exp, logits)))
        if code < top:
            row = [float(m.weights[-1][inner[-1] * (top // width) + klass, k] + m.inner_bias[klass, k]) for k in range(width)]
            total += row[int(m.place[code]) % width] - math.log(sum(map(math.exp, row)))
        else:
            total += math.log(counts.get(word, 0) + 1) - float(m.log_shapes[code - top])
    return total / math.log(10)


def test_scores_by_brute_force(spark, docs, rows, monkeypatch):
    """Scores of all rows follow from the fitted weights by plain arithmetic; a second run is the same; some tokens are not in the head."""
    from pyspark.sql import functions as F
    from tidemark.llm.common import stash

    monkeypatch.setattr(language_model, "HEAD", 60)
    train = docs.filter(language_model.fold() != language_model.HELD_OUT)
    model = language_model.head_model(stash(language_model.count_tokens(train), "vocabulary"))
    assert 0 < len(model.head) <= 60
    coded = stash(language_model.coded_documents(docs, model), "coded")
    language_model.fit(coded.filter(language_model.fold() != language_model.HELD_OUT).select("rid", "codes"), model)
    counts = collections.Counter(w for r in rows if zlib.crc32(str(r[0]).encode()) % 7 != 2 for w in [*lower(r[1] or "").encode().split(), b"\n"])
    out = collections.Counter((r.doc_id, round(r.score, 3)) for r in language_model.language_model_scores(docs).collect())
    again = collections.Counter((r.doc_id, round(r.score, 3)) for r in language_model.language_model_scores(docs).collect())
    assert out == again
    got = {r.doc_id: r.score for r in language_model.language_model_scores(docs.filter(F.lit(True))).collect()}
    for r in rows[:6] + rows[24:]:
        assert got[r[0]] == pytest.approx(plain_score(model, r[1], counts), rel=1e-4)


def test_gradient_lowers_loss():
    """A part's descent lowers its own loss, leaves the common weights as they are, and gives the same again."""
    model, head, shapes = tiny_model()
    rng = np.random.default_rng(7)
    codes, lengths = rng.integers(0, 7, 5000).astype(np.uint16), np.full(50, 100)
    for i in range(1, 5000, 2):
        codes[i] = (codes[i - 1] + 1) % 7
    before = [w.copy() for w in model.weights]
    changes = language_model.descend(model.fitted(), codes, lengths)
    assert all((a == b).all() for a, b in zip(before, model.weights, strict=True))
    assert all((a == b).all() for a, b in zip(changes, language_model.descend(model.fitted(), codes, lengths), strict=True))
    loss = -language_model.log_probability(model.fitted(), codes, lengths).sum()
    for w, c in zip(model.weights, changes, strict=True):
        w += c
    assert -language_model.log_probability(model.fitted(), codes, lengths).sum() < 0.9 * loss


def test_language(docs, wide, rows):
    out = language.identify(docs)
    assert out.count() == len(rows)
    got = {r.doc_id: r for r in out.collect()}
    for r in rows:
        letters = any(c.isalpha() for c in r[1] or "")
        assert letters or not got[r[0]].kept
        if r[0] < 24:
            assert got[r[0]].kept
    kept = language.identified_documents(wide)
    assert kept.columns == wide.columns
    assert multiset(kept, "doc_id") == multiset(out.filter("kept"), "doc_id")


def plain_fusion(rows: list[tuple]) -> list[tuple]:
    """(language, posterior) of (text, declared, host, suffix) rows by dictionaries and sums."""
    names = sorted({r[1] for r in rows if r[1] and r[0] is not None})
    grams = [language.trigrams([(r[0] or "").encode()])[0].tolist() for r in rows]
    folds = [(xxhash.xxh64_intdigest(r[0].encode(), 42) if r[0] is not None else 42) for r in rows]
    folds = [(f - (1 << 64) if f >> 63 else f) % language.FOLDS for f in folds]
    tables = {}
    for part in range(language.FOLDS):  # from the texts of all other folds
        for x in names:
            n = collections.Counter(g for r, t, f in zip(rows, grams, folds) if r[1] == x and r[0] is not None and f != part for g in t)
            whole = sum(n.values()) + len(n)
            tables[part, x] = [math.log((n[b] + len(n) / language.BUCKETS) / whole) if whole else math.log(0.5 / language.BUCKETS) for b in range(language.BUCKETS)]
    order = [*names, "und"]
    size = len(order)
    said_by = collections.Counter(r[1] for r in rows if r[1] and r[0] is not None)
    flat = [(1 - language.NONE_PRIOR) * (said_by[x] + 1) / (sum(said_by.values()) + len(names)) for x in names] + [language.NONE_PRIOR]
    evidence = []
    for t, f in zip(grams, folds):
        part = min(len(t), language.EFFECTIVE) / max(len(t), 1)
        evidence.append([part * sum(tables[f, x][g] if x != "und" else -math.log(language.BUCKETS) for g in t) for x in order])
    pick = lambda v, t: size - 1 if not t or v[-1] == max(v) else v.index(max(v))
    best = [pick([x + math.log(w) for x, w in zip(e, flat)], t) for e, t in zip(evidence, grams)]
    tally = lambda keep: [float(sum(b == i for b, r in zip(best, rows) if keep(r))) for i in range(size)]
    shares = lambda n, p, pull: [(a + pull * q) / (sum(n) + pull) for a, q in zip(n, p)]
    corpus = shares(tally(lambda r: True), flat, language.PULL)
    said = tally(lambda r: r[1] is not None)
    out = []
    for r, e, b, t in zip(rows, evidence, best, grams):
        own = [float(i == b) for i in range(size)]
        less = lambda n: [x - o for x, o in zip(n, own)]  # noqa: E731, B023
        suffix = shares(tally(lambda x: x[3] == r[3]), corpus, language.PULL)  # noqa: B023
        prior = shares(less(tally(lambda x: x[2] == r[2] and x[3] == r[3])), suffix, language.PULL)  # noqa: B023
        fused = [x + math.log(p) for x, p in zip(e, prior)]
        if r[1] is not None:
            n = tally(lambda x: x[1] == r[1])  # noqa: B023
            fused = [f + math.log((c + language.DECLARED_PULL * sum(n) / sum(said)) / (s + language.DECLARED_PULL)) for f, c, s in zip(fused, less(n), less(said))]
        k = pick(fused, t)
        out.append((order[k], 1 / sum(math.exp(f - max(fused)) for f in fused)))
    return out


def test_language_of_pages(spark):
    """Language of pages from text, html's lang, host and suffix, against plain sums; evidence of host and suffix decides short texts."""
    rng = random.Random(31)
    vocabulary = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 6))) for _ in range(80)] for k, a in (("en", "abcdefgh"), ("fr", "éèçlmnop"), ("de", "äößrstuv"))}
    pages, rows = [], []
    for i in range(150):
        lang = ("en", "fr", "de")[i % 3]
        suffix = {"en": "com", "fr": "fr", "de": "de"}[lang]
        text = " ".join(rng.choice(vocabulary[lang]) for _ in range(rng.choice([2, 60, 90]))) if i % 29 else None
        said = None if i % 4 == 0 else rng.choice(["en", lang, lang])
        host = f"h{i % 5}.{suffix}" if i % 11 else None
        pages.append((i, f"https://{host}/p{i}" if host else None, f"<html{f' lang={chr(34)}{said}-XX{chr(34)}' if said else ''}><body><p>{text or ''}</p></body></html>"))
        rows.append((text or "", said, host, host and suffix))
    out = {r.doc_id: r for r in language.identify_pages(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    expected = plain_fusion(rows)
    assert len(out) == len(rows)
    for i, (name, posterior) in enumerate(expected):
        assert out[i].language == name and out[i].posterior == pytest.approx(posterior, abs=2e-3)
    assert sum(out[i].language == ("en", "fr", "de")[i % 3] for i in range(150) if i % 29) > 135


def test_labels_in_shards(spark, docs, monkeypatch):
    """Labels whose tables do not go to the workers together give the same verdicts."""
    whole = collections.Counter(map(tuple, language.identify(docs).collect()))
    monkeypatch.setattr(language, "SHARD", 1)
    assert collections.Counter(map(tuple, language.identify(docs).collect())) == whole


def test_wrong_declarations_are_found(spark):
    """Texts with a planted wrong label are named by what they are, though they count for that label; clean ones keep theirs."""
    rng = random.Random(14)
    vocabulary = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 6))) for _ in range(120)] for k, a in (("en", "abcdefgh"), ("fr", "éèçlmnop"), ("de", "äößrstuv"))}
    rows = []
    for i in range(300):
        lang = ("en", "fr", "de")[i % 3]
        rows.append((i, " ".join(rng.choice(vocabulary[lang]) for _ in range(40)), "en" if i % 10 == 4 else lang, f"h{i % 7}"))
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [got[i].language for i in range(300)] == [("en", "fr", "de")[i % 3] for i in range(300)]
    assert sum(got[i].declared != got[i].language for i in range(300)) == sum(i % 10 == 4 and i % 3 > 0 for i in range(300))


def test_quality(spark, docs, rows):
    out = {r.doc_id: r for r in quality.op5_repetition(spark, folder(spark, docs)).collect()}
    for r in rows:
        w = words(r[1])
        grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        under = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in (r[1] or "").split("\n") if words(x)]
        got = out[r[0]]
        assert (got.n_words, got.word_chars, got.n_repeat_words) == (len(w), sum(map(len, w)), len(under))
        assert (got.n_symbols, got.n_dup_lines) == (sum(c in "#*$%&|<>" for c in r[1] or ""), len(lines) - len(set(lines)))
        failed = len(w) < 50 or 100 * len(under) > 50 * len(w)
        assert got.base_failed == failed and not (failed and got.kept)


PAGES = [
    ("http://www.A.example/x#f", "<html><body><nav><a href=/>Menu</a></nav><div class='cookie-notice'>We use cookies</div><article><h1>Top &amp; title</h1><p>One  two<br>three<p>Four &lt;five</article><footer>&copy; us</footer>"),
    ("http://a.example/x", "<main><div><p>Body <b>bold</b> text</p><script>var x = '</p>';</script><ul><li>a<li>b</ul><form><p>Search</p></form><div id=comments><p>First!</p></div></main>"),
    ("http://b.example/y", "<body><div class=sidebar>links</div><div><p>No article here.</p></div><aside>x</aside><!-- <p>hidden</p> --></body>"),
    (None, None), ("", ""), ("http://b.example/y", "plain words &amp; no markup"), ("http://c.example/", "<p>cut off <b>here &am"),
]
TEXTS = ["Top & title\nOne two three\nFour <five", "Body bold text\na\nb", "No article here.", "", "", "plain words & no markup", "cut off here &am"]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "extra") for i, (u, h) in enumerate(PAGES)] + [(3, None, None, "again")], "page_id long, url string, html string, template string")


def test_html(pages):
    out = {r.page_id: r for r in html_extract.extract(pages).collect()}
    assert [out[i].text for i in range(len(TEXTS))] == TEXTS
    assert all(r.n_chars == len(r.text) for r in out.values())


def test_warc(spark, pages):
    rows = pages.collect()
    first: dict[str, int] = {}
    for r in sorted(rows, key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    out = warc.op7_warc(spark, folder(spark, pages, "pages"))
    expected = collections.Counter()
    for r in rows:
        payload = (r.html or "").encode()
        of = first[r.html or ""]
        expected[(r.page_id, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if of == r.page_id else "revisit", None if of == r.page_id else of)] += 1
    assert multiset(out, "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected
    got = out.collect()
    keys = [(r.url_key, r.ts, r.page_id) for r in got]
    assert keys == sorted(keys)


def test_archives_are_bounded(spark):
    """Archives hold about as many bytes as they may, greater pages one each; null ids and repeated rows are all there."""
    import gzip
    import pathlib

    rows = [(i, f"http://h.example/{i}", "x" * n + str(i)) for i, n in enumerate([100] * 50 + [40_000] * 12 + [300_000] * 5 + [3_000_000] * 2)] + [(None, None, "x"), (3, "u", None), (3, "u", None)]
    path = f"/tmp/tidemark-test-{os.getpid()}-{random.random()}"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), path, most=1 << 20)
    sizes = [len(gzip.decompress(p.read_bytes())) for p in pathlib.Path(path).glob("part-*")]
    assert max(s for s in sizes if s < 3_000_000) <= (1 << 20) * 1.1 + 5000 and sum(s >= 3_000_000 for s in sizes) == 2
    index = warc.read_archives(spark, f"file://{path}")
    assert index.count() == len(rows) and index.filter("not intact").count() == 0


def test_loser_tree():
    rng = random.Random(4)
    for k in range(9):
        runs = [sorted(((f"k{rng.randint(0, 5)}", str(rng.randint(0, 3)), rng.randint(0, 9)) for _ in range(rng.randint(0, 7))), key=warc.order) for _ in range(k)]
        assert [warc.order(r) for r in warc.loser_tree(runs)] == sorted(warc.order(r) for run in runs for r in run)


def test_decontamination(spark, rows, wide):
    item = "The quick brown fox jumps over the lazy dog and runs far away home"
    changed = item.replace("lazy", "sleepy").upper().replace(" ", ",  ")
    halves = " ".join(item.split()[:6]) + " other words come in between and then " + " ".join(item.split()[8:])
    some = [(0, f"before it {item} after it"), (1, changed), (2, halves), (3, None), (4, ""), (5, item.split()[0]), (None, f"x {item}"), (1, changed), (7, " ".join(reversed(item.split())))]
    docs = spark.createDataFrame([(i, t, "keep") for i, t in some], "doc_id long, text string, tokens string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "too short"), (10, item)], "item_id long, text string")
    assert multiset(decontaminate.leaks(docs, bench), "doc_id", "item_id") == collections.Counter([(0, 10), (1, 10), (None, 10)])
    clean = decontaminate.clean_documents(docs, bench)
    assert clean.columns == docs.columns and multiset(clean, "doc_id") == collections.Counter([(2,), (3,), (4,), (5,), (7,)])
    assert decontaminate.clean_documents(wide, bench).count() == len(rows)


def test_short_items(spark):
    """Items shorter than the masks are looked for as a whole; of five tokens or more."""
    bench = spark.createDataFrame([(1, "one two three four five"), (2, "alpha beta gamma delta epsilon zeta eta"), (3, "yes or no")], "item_id long, text string")
    docs = spark.createDataFrame([(0, "x one two three, four five y"), (1, "one two three four six"), (2, "Alpha beta gamma delta epsilon zeta eta"), (3, "yes or no"), (4, "one two three four five")], "doc_id long, text string")
    assert multiset(decontaminate.leaks(docs, bench), "doc_id", "item_id") == collections.Counter([(0, 1), (2, 2), (4, 1)])


def test_recall_by_substitutions(spark):
    """Of items with so many tokens replaced in every 13, at least nine in ten that still pass the comparison are found."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [[rng.choice(vocabulary) for _ in range(rng.randint(15, 30))] for _ in range(150)]
    rows, passing = [], collections.defaultdict(set)
    for s in (0, 1, 2):
        for i, item in enumerate(items):
            out = list(item)
            for a in range(0, len(out), 13):
                for k in rng.sample(range(a, min(a + 13, len(out))), min(s, len(out) - a)):
                    out[k] = "changed"
            doc = s * 1000 + i
            rows.append((doc, " ".join([*rng.choices(vocabulary, k=30), *out, *rng.choices(vocabulary, k=30)])))
            same = [x == y for x, y in zip(item, out)]
            if any(sum(same[a : a + 13]) >= 11 for a in range(len(same) - 12)):
                passing[s].add((doc, i))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    for s in (0, 1, 2):
        assert len(found & passing[s]) >= (0.9 if s == 2 else 1.0) * len(passing[s]) > 100
    assert all(d % 1000 == i for d, i in found)


def brute_groups(rows: list[tuple]) -> tuple[list[int], dict]:
    marks = []
    for r in rows:
        w = words(lower(r[1] or ""))
        hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
        marks.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes)))
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 4 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}
    return marks, {rows[i][0]: least[g] for i, g in enumerate(group)}


def brute_near_copies(rows: list[tuple]) -> dict:
    """The smallest doc_id that links of similarity 0.8 or more (sets of five-word shingles) reach."""
    sets = []
    for r in rows:
        w = words(lower(r[1] or ""))
        sets.append({" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if (a == b or 5 * len(a & b) >= 4 * len(a | b)) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group)}
    return {rows[i][0]: least[g] for i, g in enumerate(group)}


def test_simhash(spark, docs, wide, rows):
    marks, group = brute_groups(rows)
    expected = collections.Counter((r[0], f"{m:016x}", group[r[0]]) for r, m in zip(rows, marks, strict=True))
    assert multiset(simhash.op9_simhash(spark, folder(spark, docs)), "doc_id", "fingerprint", "component_id") == expected
    heads = simhash.group_heads(wide)
    assert heads.columns == wide.columns
    assert multiset(heads, "doc_id") == collections.Counter((x,) for x in set(brute_near_copies(rows).values()))


def edited(rng: random.Random, text: list[str], edits: int) -> list[str]:
    out = list(text)
    for k in range(edits):
        at = rng.randrange(len(out))
        if k % 3 == 0:
            out[at] = f"new{rng.random()}"
        elif k % 3 == 1:
            out.insert(at, f"more{rng.random()}")
        elif len(out) > 30:
            del out[at]
    return out


def test_near_copies(spark):
    """One of each group by the texts' own similarity; copies of copies, one large group, clean texts."""
    rng = random.Random(31)
    fresh = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    found = [fresh(rng.randint(20, 500)) for _ in range(120)]
    hot = fresh(200)
    found += [edited(rng, hot, rng.randint(0, 3)) for _ in range(120)]
    for i in range(60):
        found.append(edited(rng, found[i], max(1, len(found[i]) // rng.choice((15, 40, 60, 150)))))
    rng.shuffle(found)
    rows = [(i, " ".join(x), "en", "s", 0) for i, x in enumerate(found)]
    expected = set(brute_near_copies(rows).values())
    kept = {r.doc_id for r in simhash.group_heads(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(expected) < 175
    assert len(kept ^ expected) <= 1


def test_wide_links(spark):
    """Crowded buckets in shards, large groups in tiles: the components of all pairs, with no pair beyond the radius."""
    import numpy as np

    from tidemark.llm import near_copies
    from tidemark.llm.common import stash

    rng = random.Random(32)
    marks = {rng.getrandbits(128) for _ in range(60)}
    for base in sorted(marks)[:3]:
        marks |= {base ^ sum(1 << b for b in rng.sample(range(128), rng.randint(1, 26))) for _ in range(130)}
    marks = sorted(marks)
    signed = [tuple(np.array([m & (2**64 - 1), m >> 64], np.uint64).view(np.int64).tolist()) for m in marks]
    of = {s: m for s, m in zip(signed, marks)}
    group = list(range(len(marks)))
    for i, a in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j]).bit_count() <= 23 and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    want = {frozenset(marks[i] for i in range(len(marks)) if group[i] == g) for g in set(group)}

    def joined(pairs) -> set[frozenset]:
        mine = {m: {m} for m in marks}
        for a, b in pairs:
            assert (a ^ b).bit_count() <= 23
            if mine[a] is not mine[b]:
                mine[a] |= mine[b]
                for x in mine[b]:
                    mine[x] = mine[a]
        return {frozenset(x) for x in mine.values()}

    fps = stash(spark.createDataFrame(signed, "f0 long, f1 long"), "test")
    for shard in (4, 60, 4096):
        assert joined((of[r.a0, r.a1], of[r.b0, r.b1]) for r in near_copies.links(fps, shard=shard).collect()) == want
    bits = np.array(signed).view(np.uint64)
    for pairs in (near_copies.small_forests(np.zeros(len(bits), int), bits, 23), near_copies.large_forest(bits, None, 23, tile=16)):
        assert joined((marks[a], marks[b]) for a, b in pairs) == want
        assert len(pairs) == len(marks) - len(want)


def test_tiles(spark):
    """Small tiles give the same components as all pairs, in a bucket that holds everything."""
    rng = random.Random(6)
    base = rng.getrandbits(64)
    marks = sorted({base ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 6))) & ((1 << 64) - 1) for _ in range(120)})
    signed = [(x - (1 << 64) if x >> 63 else x,) for x in marks]
    from tidemark.llm.common import stash

    fps = stash(spark.createDataFrame(signed, "fp long"), "test")
    group = {x[0]: x[0] for x in signed}
    for i, a in enumerate(marks):
        for b in marks[:i]:
            x, y = group[signed[i][0]], group[signed[marks.index(b)][0]]
            if (a ^ b).bit_count() <= 4 and x != y:
                group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    found = {r.node: r.root for r in components.components(simhash.links(fps, tile=8)).collect()}
    for k, v in group.items():
        assert found.get(k, k) == v


def test_components(spark):
    rng = random.Random(8)
    pairs = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(None, 3), (5, 5)]
    group: dict[int, int] = {}
    for a, b in pairs:
        if a is not None and a != b:
            x, y = group.setdefault(a, a), group.setdefault(b, b)
            group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
    out = components.components(spark.createDataFrame(pairs, "a long, b long"))
    assert {(r.node, r.root) for r in out.collect()} == set(group.items())
    assert out.count() == len(group)


def test_tokens(spark, docs, rows):
    from tokenizers import Tokenizer

    path = token_counts.public_path(token_counts.VOCABULARY)
    plain = Tokenizer.from_file(path)
    count = lambda t: len(plain.encode(t, add_special_tokens=False).ids)
    out = token_counts.op10_tokens(spark, folder(spark, docs))
    expected = collections.Counter((r[0], len((r[1] or "").encode()), count(r[1] or ""), count(r[1] or "") > 2048) for r in rows)
    assert multiset(out, "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    odd = ["é<|endoftext|> " * 90, "x" * 700 + " y " * 200, "can't we'll " * 80, "́a ́" * 120, "Ωσς ΣΑΣ " * 60, "z" * 300, "", " " * 500, "a\u00a0b\u2003c " * 90, "".join(chr(0x4E00 + i) for i in range(900)), "1234 " * 99 + "5" * 400, "<|startoftext|>" * 40]
    rng = random.Random(4)
    odd += ["".join(rng.choice("ab' \n\t1é́ß,<|>中") for _ in range(rng.randint(1, 900))) for _ in range(150)]
    hard = [t for t in texts() if t] + odd
    expected_counts = [count(t) for t in hard]
    for chunk, overlap in ((40, 4), (64, 16), (200, 20), (1000, 100)):
        counter = token_counts.Counter(path, chunk, overlap)
        assert counter.count(hard) == expected_counts
        assert counter.spliced > 0 and (counter.widened > 0 or chunk > 64)


def test_bench_texts_are_spliced():
    """Most characters of the corpus are in texts that go through overlapping chunks, and all counts are the library's."""
    import pyarrow.parquet as pq
    from tokenizers import Tokenizer

    path = token_counts.public_path(token_counts.VOCABULARY)
    some = [x or "" for x in pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])["text"].to_pylist()]
    counter, plain = token_counts.Counter(path), Tokenizer.from_file(path)
    assert counter.count(some) == [len(plain.encode(x, add_special_tokens=False).ids) for x in some]
    assert counter.spliced > 0.5 * sum(map(len, some))


@pytest.mark.parametrize("name", ["op1_mixing", "op2_substrings", "op3_maxent", "op4_language", "op5_repetition", "op6_wrapper", "op7_warc", "op8_spaced_seeds", "op9_simhash", "op10_tokens"])
def test_empty_tables(spark, tmp_path, name):
    from tidemark.llm.registry import QUERIES

    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert QUERIES[name](spark, str(tmp_path)).collect() == []


def test_null_ids(spark):
    rows = [(None, "some words that repeat " * 20, "en", None, None), (None, "some words that repeat " * 20, "en", None, None), (None, None, None, None, None), (1, "other", "en", "s", 5)]
    some = spark.createDataFrame(rows, DOCS)
    assert substrings.dedup_substrings(some).count() == 4
    assert language.identify(some).count() == 4
    assert simhash.simhash_groups(some).count() == 4
    assert simhash.group_heads(some).count() == 3
    assert language_model.language_model_scores(some).count() == 4
    assert mixing.mix_sources(some).count() > 0


def test_group_heads_without_ids(spark):
    """Each group keeps exactly one row: without doc_ids, with one doc_id on two texts, with copies that differ by a null's place."""
    far = [" ".join(f"w{k}x{i}" for i in range(60)) for k in range(6)]
    rows = [
        (None, far[0], "en", "s", 1), (None, far[0], "en", "s", 1), (None, far[1], "en", "s", 1), (None, None, None, None, None),
        (7, far[2], "en", "s", 1), (7, far[3], "en", "s", 1), (8, far[4], "en", None, 1), (8, far[4], None, "en", 1), (None, far[5], "en", "s", 1), (9, far[5], "en", "s", 1),
    ]
    some = spark.createDataFrame(rows, DOCS)
    assert multiset(simhash.group_heads(some), "doc_id", "text") == collections.Counter([(None, far[0]), (None, far[1]), (None, None), (7, far[2]), (7, far[3]), (8, far[4]), (9, far[5])])


def test_rare_labels(spark):
    """Every labelled row is fitted: a rare language has its table, a stray label none, and junk is in no language."""
    rng = random.Random(12)
    vocabulary = {k: ["".join(rng.choice(a) for _ in range(rng.randint(2, 6))) for _ in range(120)] for k, a in (("en", "abcdefgh"), ("fr", "éèçlmnop"))}
    prose = lambda k: " ".join(rng.choice(vocabulary[k]) for _ in range(60))
    late = lambda i: int(hashlib.md5(f"fit:{i}".encode()).hexdigest()[:8], 16) / 2**32 > 0.75
    rare = [i for i in range(10_000, 10_400) if late(i)][:30]
    rows = [(i, prose("en"), "en", "s") for i in range(6000)] + [(i, prose("fr"), "fr", "s") for i in rare]
    junk = [(20_000 + i, "".join(rng.choice("qrstuvwxyz") for _ in range(90)), None, "j") for i in range(10)]
    rows += [(30_000, "12 34", "aa", "t"), *junk]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {got[i].language for i in rare} == {"fr"} and {got[i].language for i in range(6000)} == {"en"}
    assert {(got[i].text_lang, got[i].language, got[i].kept) for i, *_ in junk} == {("und", "und", False)}


def test_near_copies_lose_no_pair(spark):
    """Short texts, whose fingerprints lie far apart, texts with a line in common and a family: the brute-force groups, exactly."""
    rng = random.Random(77)
    fresh = lambda n: [f"u{rng.randrange(5000)}" for _ in range(n)]
    line = fresh(9)
    found = [fresh(rng.randint(9, 40)) for _ in range(90)] + [line + fresh(rng.randint(1, 4)) for _ in range(60)]
    found += [edited(rng, x, 1) for x in found[:90] for _ in range(2)]
    hot = fresh(60)
    found += [edited(rng, hot, rng.randint(0, 5)) for _ in range(90)]
    rows = [(i, " ".join(x), "en", "s", 0) for i, x in enumerate(found)] + [(900, None, "en", "s", 0), (901, " ", "en", "s", 0)]
    expected = set(brute_near_copies(rows).values())
    assert {r.doc_id for r in simhash.group_heads(spark.createDataFrame(rows, DOCS)).collect()} == expected


def test_near_rows_by_sketches():
    """Sketches leave no pair out that is similar enough, few others in, whatever the sizes; crowded shingles pair by shards as without."""
    import numpy as np

    from tidemark.llm import near_texts

    gen = np.random.default_rng(5)
    fresh = lambda n: gen.integers(-(1 << 63), (1 << 63) - 1, n)
    sets = []
    for size in (1, 3, 9, 31, 33, 60, 64, 130, 500, 1030):
        base = fresh(size)
        sets += [np.unique(np.concatenate((base[gen.random(size) >= gen.random() * 0.3], fresh(int(size * gen.random() * 0.2) + 1)))) for _ in range(24)]
    sets.sort(key=len)
    n = np.array([len(x) for x in sets])
    sketches = [near_texts.sketch(x) for x in sets]
    shared = lambda a, b: len(np.intersect1d(sets[a], sets[b]))
    similar = {(a, b) for b in range(len(sets)) for a in range(b) if 9 * shared(a, b) >= 4 * (n[a] + n[b])}
    for root, side in ((np.arange(len(n)), None), (np.arange(len(n)) // 2, np.arange(len(n)) % 3)):
        found = [x for a, b, _ in near_texts.near_rows(n, root, side, sketches, tile=32) for x in zip(a.tolist(), b.tolist(), strict=True)]
        allowed = {(a, b) for a, b in similar if root[a] != root[b] and (side is None or side[a] != side[b])}
        assert len(found) == len(set(found)) and allowed <= set(found)
        assert len(found) < 2 * len(allowed)


def test_large_family_is_paired_sparsely(spark):
    """Of a family at one shingle each text is held against its closest one first, not against all."""
    import numpy as np

    from tidemark.llm import near_texts

    gen = np.random.default_rng(6)
    base = gen.integers(-(1 << 63), (1 << 63) - 1, 100)
    sets = [np.unique(np.concatenate((base[gen.random(100) > 0.05], gen.integers(-(1 << 63), (1 << 63) - 1, 3)))) for _ in range(300)]
    rows = spark.createDataFrame([(h, i, len(x), bytearray(near_texts.sketch(x)), i) for h in (1, 2) for i, x in enumerate(sets)], "h long, node long, n int, sketch binary, root long")
    for shard in (64, 4096):
        first = near_texts.many_pairs(rows, True, shard).select("a", "b").distinct().collect()
        assert {x for r in first for x in r} == set(range(300)) and len(first) <= (300 if shard > 300 else 300 * 5)
        every = {tuple(r) for r in near_texts.many_pairs(rows, False, shard).select("a", "b").collect()}
        assert {(a, b) for b in range(300) for a in range(b) if 9 * len(np.intersect1d(sets[a], sets[b])) >= 4 * (len(sets[a]) + len(sets[b]))} <= every
        one = rows.withColumn("root", near_texts.F.lit(0).cast("long"))
        assert near_texts.many_pairs(one, False, shard).count() == 0


def test_run_sums():
    """Gradients of a row of weights are summed as np.add.at does, in short runs and long ones, and faster than reduceat."""
    import time

    import numpy as np

    gen = np.random.default_rng(3)
    rows = np.minimum(gen.zipf(1.3, 8192), 4096) - 1
    g = gen.standard_normal((len(rows), language_model.CLASSES)).astype(np.float32)
    for some in (rows, rows[:1], np.zeros(500, int), np.arange(70), np.repeat(np.arange(5), (1, 31, 32, 33, 34))):
        order = np.argsort(some, kind="stable")
        ordered = some[order]
        first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        want = np.zeros((4096, g.shape[1]))
        np.add.at(want, some, g[: len(some)])
        rank, summed = language_model.run_sums(g[: len(some)], order, first)
        assert sorted(rank.tolist()) == list(range(len(first)))
        assert np.allclose(summed, want[ordered[first[rank]]], atol=1e-3)

    def took(f) -> float:
        best = 9.0
        for _ in range(5):
            began = time.process_time()
            f()
            best = min(best, time.process_time() - began)
        return best

    power = np.full(4096, 10.0, np.float32)
    weights = np.zeros((4096, g.shape[1]), np.float32)
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.concatenate(([True], rows[order][1:] != rows[order][:-1])))
    assert took(lambda: language_model.step_rows(weights, power, rows, g)) < took(lambda: np.add.reduceat(g[order], first, axis=0))
