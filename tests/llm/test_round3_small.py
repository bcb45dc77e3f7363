"""Whitening, licence scans and collocations against brute force and on odd rows."""

import collections
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from tidemark.llm import collocations, html_text, licenses, whitening

# --- whitening


def test_scatter_is_exact(spark):
    rng = np.random.default_rng(3)
    rows = [[int(v) for v in rng.integers(-(2**62), 2**62, 3)] for _ in range(50)] + [[1, 2, 3], [-(2**63), 2**63 - 1, 0]]
    got = whitening.scatter(spark.createDataFrame([(r,) for r in rows], "x array<long>"))[3]
    n = len(rows)
    s = [sum(r[j] for r in rows) for j in range(3)]
    want = [[n * sum(r[i] * r[j] for r in rows) - s[i] * s[j] for j in range(3)] for i in range(3)]
    assert got.n == n and got.centred().tolist() == want


def test_whitening_against_fractions(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(40, 4)) @ rng.normal(size=(4, 4))).round(3).tolist()
    rows = [(i, v) for i, v in enumerate(vectors)] + [(7, vectors[7]), (None, vectors[3])]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id int, embedding array<double>"), k=16).toPandas()
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    distinct = sorted(set(map(tuple, x)))
    n = len(distinct)
    s = [sum(col) for col in zip(*distinct, strict=True)]
    v = np.array([[float(sum((Fraction(r[i]) - Fraction(s[i], n)) * (Fraction(r[j]) - Fraction(s[j], n)) for r in distinct) / n) for j in range(4)] for i in range(4)])
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    assert len(out) == 4 * len(rows) and out.n.eq(n).all() and out.identity_error.max() < 1e-9
    for i, g in out[out.vec_id.notna()].groupby("vec_id"):
        r = x[int(i)]
        assert g.deviation.eq(sum((n * a - b) ** 2 for a, b in zip(r, s, strict=True))).all() and set(g.deviation_digits) == {str(g.deviation.iloc[0])}
    assert np.allclose(out.groupby("component").explained.first(), e / e.sum(), rtol=1e-10)
    y = out[out.vec_id.notna()].drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    d = (np.array(x, float) - np.array([float(Fraction(t, n)) for t in s])).astype(float)
    assert np.allclose(y @ y.T, d @ np.linalg.inv(v) @ d.T, atol=1e-8)  # Mahalanobis products are free of signs


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0], "a"), (1, [1.0, 2.0], "a"), (None, [7.0, 1.0], "b"), (2, [3.0, float("nan")], "b"), (3, None, ""), (4, [], ""), (5, [1.0], ""), (6, [1e300, -1e300, 0.0], ""), (7, [float("inf"), 0.0], ""), (8, [None, 0.0], ""), (9, [0.0, 0.0, 0.0], "")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, component string")
    out = whitening.whiten(df).toPandas()
    assert sorted(out.vec_id.fillna(-1)) == [-1, 1, 1, 6, 9] and out[out.vec_id == 6].deviation.isna().all()  # one dimension has one vector and so no component
    assert whitening.whiten(df.limit(0)).count() == 0


# --- licences


def brute_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return w, sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())


def test_matching_statistics(spark):
    rng = random.Random(1)
    for _ in range(200):
        lists = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
        a = licenses.Automaton(lists)
        text = [rng.choice([b"a", b"b", b"c", b"z"]) for _ in range(40)]
        got = {i: (n, sorted(a.states[s].ends)) for i, s, n in a.statistics(text)}
        for i in range(len(text)):
            best = (0, [])
            for n in range(1, i + 2):
                if found := sorted((t, e) for t, x in enumerate(lists) for e in range(n, len(x) + 1) if x[e - n : e] == text[i + 1 - n : i + 1]):
                    best = (n, found)
            assert got.get(i, (0, [])) == best


def test_chains_cover_copies_and_gaps():
    mit = licenses.TEMPLATES[1][1]
    scanner = licenses.Scanner()
    size = scanner.sizes[1]
    spans = scanner.scan("foo " + mit.replace("publish", "print") + " and then " + mit.upper() + " bar")[2]
    assert [(s[1], s[2], s[3]) for s in spans] == [(1, 1, size + 1), (1, size + 3, 2 * size + 3)] and spans[0][4] == (size - 1) / size and spans[1][4] == 1
    assert licenses.chain([licenses.Match(0, 4, 5), licenses.Match(10, 14, 0)], 9) == [(0, 4, 4), (10, 14, 4)]  # back in the template: another span
    assert scanner.scan("Released under the MIT License. " * 3)[2] == [("mit", 0, 5 * i, 5 * i + 5, 1.0) for i in range(3)]


def test_licenses_against_brute_force_and_odd_rows(spark):
    texts = [None, "", " \n", "CC BY", "cc\tby-sa 4.0, General  Public\nLICENSE; all rights reserved. All rights reserved", "ccby cc-by é cc by", "All rights all rights reserved reserved", "Licensed under CC BY-NC 4.0.", "x " * 20_000 + "This work is licensed under the GNU General Public License, version 3.", "Ünder the mit license", "Released under the MIT License."]
    df = spark.createDataFrame([(i, t, "label?") for i, t in enumerate(texts)] + [(3, "CC BY", ""), (None, "cc by", "")], "doc_id long, text string, labels string")
    out = licenses.licenses(df).toPandas()
    assert len(out) == len(texts) + 2
    for r in out[out.doc_id.notna()].itertuples():
        words, base = brute_base(texts[int(r.doc_id)])
        assert r.n_words == len(words) and r.n_base == len(base) and r.base_labels == ",".join(sorted({b for _, b in base}))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
        assert (np.isnan(r.first_word) if not base else (r.first_word, r.last_word) == (base[0][0], base[-1][0]))
    label = dict(zip(out.doc_id, out.labels, strict=True))
    assert label[7] == "cc-by,cc-by-nc" and label[8] == "gpl" and label[9] == "" and label[10] == "mit"
    assert licenses.licenses(df.limit(0)).count() == 0


# --- collocations


def brute_collocations(rows, least=30, percent=80, top=2000):
    n, f = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    out = []
    for (lang, p), a in f.items():
        if len(p) < 2 or a < least:
            continue
        if any(100 * g >= percent * a for (x, q), g in f.items() if x == lang and len(q) > len(p) and g >= least and any(q[i : i + len(p)] == p for i in range(len(q)))):
            continue
        s, k = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p)))
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], s))
    best = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        best += [(lang, i + 1, *r[1:]) for i, r in enumerate(own[:top])]
    return sorted(best)


@pytest.fixture(scope="module")
def phrases():
    rng = random.Random(2)
    words = ["the", "of", "New", "york", "é", "a\x00b", "İ", " x", "été", "city"]
    rows = [(rng.choice(["en", "de", None, ""]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", ","]) for _ in range(rng.randint(0, 60)))) for _ in range(300)]
    return rows + [("en", None), (None, ""), ("de", " .,"), ("en", "new york city hall " * 200)] + [("en", "new york")] * 40


def test_collocations_against_brute_force(spark, phrases, monkeypatch):
    df = spark.createDataFrame([(1, lang, t, "rank?") for lang, t in phrases], "doc_id long, lang string, text string, rank string")
    want = brute_collocations(phrases, least=5)
    get = lambda d, **x: sorted(tuple(r) for r in collocations.collocations(d, **x).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())
    assert get(df, least=5) == want and len(want) > 100
    assert get(df, least=5, top=7) == brute_collocations(phrases, least=5, top=7)
    assert get(df.repartition(7), least=30) == brute_collocations(phrases)
    assert get(df.limit(0)) == []


def test_sketches_lose_nothing(phrases):
    """A sketch so small that everything meets in it lets all through; chunks of any size give the same counts."""
    held = collocations.Words()
    for lang, t in phrases:
        held.add(lang or "und", (t or "").encode())
    ids, names = held.ids(), held.names()
    all_hashes = np.concatenate([h[b] for b, h in collocations.phrase_hashes(ids, *names)])
    for bits in (10, 16):
        cells = collocations.cells(all_hashes, bits)
        counts = [np.bincount(c, minlength=2**bits) for c in cells]
        _, true = np.unique(all_hashes, return_counts=True)
        first = np.unique(all_hashes, return_index=True)[1]
        least = np.minimum(*[n[c[first]] for n, c in zip(counts, cells, strict=True)])
        assert (least >= true).all()
    block, n = np.array([3, 9, 70_000], np.uint32), np.array([1, 30, 2])
    back = collocations._unpack(collocations._pack(block, n))
    assert (back[0] == block).all() and (back[1] == n).all()


def test_scores_pass_64_bits(spark):
    a = 5 * 10**12
    f = spark.createDataFrame([("en", 1, "x", a), ("en", 1, "y", a), ("en", 2, "x y", a)], "lang string, size int, phrase string, f long")
    r = collocations.scored(f, f.alias("again").select("lang", "size", "phrase", "f")).first()
    assert (r["a"], r["l"], r["r"], r["score"]) == (a, a, a, 1_000_000)


# --- pages that name nothing --------------------------------------------------------------------


def bare_pages(n=12, host="plain.example"):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    some = lambda k: " ".join(word() for _ in range(k))
    rows = []
    for i in range(n):
        menu = "".join(f'<div><a href="/{w}">{w}</a></div>' for w in (word() for _ in range(4)))
        body, table = [some(rng.randint(60, 200)) for _ in range(3)], [[word(), word()] for _ in range(3)]
        main = "".join(f"<p>{t}</p>" for t in body) + "<table>" + "".join(f"<tr><td>{a}</td><td>{b}</td></tr>" for a, b in table) + "</table>"
        want = " ".join([*body, *(c for r in table for c in r)])
        rows.append((i, f"http://{host}/{i}", f"<html><body><div>{menu}</div><div>{some(6)}</div><div><div>{main}</div></div><div>{some(9)}</div></body></html>", want))
    return rows


@pytest.mark.parametrize("names", [True, False])
def test_slots_are_told_apart_without_names(spark, names):
    rows = bare_pages()
    df = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    out = html_text.main_text(df, names=names).collect()
    assert len(out) == len(rows) and all(r["text"] == r["want"] for r in out)


def test_furniture_is_short_or_dense_with_links():
    reference = html_text.skeleton([(-1, "#"), (0, "div"), (0, "div"), (2, "ul"), (0, "div"), (0, "div")])
    words, links = {1: 8.0, 2: 400.0, 3: 5.0, 4: 150.0, 5: 90.0}, {1: 8.0, 4: 140.0}
    assert html_text.furniture(reference, words, links) == [1, 4]  # what lies in the content stays, and so does what is long
    assert html_text.furniture(reference, {}, {}) == [] and html_text.furniture(reference, {1: 3.0}, {}) == []


def test_compound_names_of_noise():
    page = '<body><div class="cookie-banner">a</div><div id="disqus_thread">b</div><div class="related-posts">c</div><div class="share-buttons">d</div><div class="cookies-recipe">e</div></body>'
    assert html_text.extract(page, None, frozenset(), html_text.Aligner()) == "e"
