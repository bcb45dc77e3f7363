"""The corpus operators on small fixtures, against brute force and on odd rows."""

import base64
import hashlib
import ipaddress
import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, common, hnsw, html_text, mixing, near_dups, packing, pii, quality, text_model, toxicity, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (4, "one"), (None, "two words"), (5, "x" * 30_000), (6, "word " * 5000)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(11)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), 5)) for _ in range(400)]
    rows = []
    for i in range(60):
        words = list(rng.choice(vocab, 120))
        text = " ".join(words) + "."
        rows.append((i * 10, text))
        if i % 3 == 0:  # near copies
            for k in range(1, 4):
                near = list(words)
                near[int(rng.integers(0, 120))] = f"edit{k}"
                rows.append((i * 10 + k, " ".join(near) + "."))
        if i % 5 == 0:  # exact copy
            rows.append((i * 10 + 9, text))
    return spark.createDataFrame(rows, "doc_id long, text string").cache()


def odd(spark):
    return spark.createDataFrame([(i, t, "s", "id?") for i, t in ODD], "doc_id long, text string, source string, id string")


def empty(spark):
    return odd(spark).limit(0)


# --- quality


def brute_counts(t):
    import re

    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    w3 = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, w in enumerate(w3) if w3.count(w) > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit)


@pytest.mark.parametrize("text", [None, "", "a b c a b c d", "x\nx\n \n \nx", "é#ü %% y z", "a b a b a b a", "\x1cq\x85r"])
def test_counts_equal_brute_force(text):
    assert quality.text_counts(text)[:5] == brute_counts(text)


def test_quality_on_odd_rows(spark):
    out = quality.score_quality(odd(spark)).toPandas()
    assert len(out) == len(ODD) and out["base_failed"].all() and not out["kept"].any()
    assert quality.score_quality(empty(spark)).count() == 0
    assert quality.keep_good(odd(spark)).columns == ["doc_id", "text", "source", "id"]


def test_label_model_tells_kinds_of_bad_text_from_good():
    rng = np.random.default_rng(0)
    votes = np.where(rng.random((3000, 6)) < 0.998, 1, -1)
    votes[rng.random((3000, 6)) < 0.1] = 0
    bad = rng.random(3000) < 0.15
    for i in np.flatnonzero(bad):  # each kind of bad text breaks its own two rules
        kind = 2 * int(rng.integers(0, 3))
        votes[i, kind : kind + 2] = -1
    post = quality.LabelModel().fit(votes, np.ones(3000)).posterior(votes)
    assert ((post < 0.5) == bad).mean() > 0.95


# --- packing


@pytest.mark.parametrize("text", ["Hello, world. It's 42!", "école İstanbul ΣΑΣ", "a.b c.. d,", "<|endoftext|> x", "\x1cq ½ ²", ""])
def test_cached_ids_equal_the_tokenizer(text):
    c = packing.word_cache(TOKENIZER)
    assert list(c.ids(text)) == c.tokenizer.encode(text, add_special_tokens=False).ids


def test_cached_ids_equal_the_tokenizer_on_random_texts():
    c = packing.word_cache(TOKENIZER)
    assert not c.whole and c.direct
    rng = np.random.default_rng(2)
    odd_letters = [0x130, 0x131, 0x307, 0x301, 0x30A, 0x3A3, 0x3C2, 0xDF, 0x1E9E, 0xFB01, 0xBD, 0x85, 0xA0, 0x2028, 0x200B, 0x4F60, 0x645, 0x94D, 0x1C5, 0x212B, 0x1FB3, 0x149, 0x3AA, 0xAD, 0xFF21]
    letters = np.array([*"abcXYZ .,!?'-_0123\n\t", *map(chr, odd_letters)], dtype=object)
    for n in rng.integers(1, 14, 8000):
        text = "".join(rng.choice(letters, n))
        assert c.ids(text).tolist() == c._whole(text), ascii(text)


def test_other_tokenizers_encode_whole_texts():
    c = packing.word_cache(public_tokenizers.path("byte_bpe_50k.json"))
    assert c.whole and c.ids("Two  Words").tolist() == c._whole("Two  Words")


def test_a_cache_forgets_by_bytes():
    c = packing.WordCache(packing.word_cache(TOKENIZER).tokenizer, limit=5000)
    for i in range(200):
        c.ids(f"word{i}")
    assert c.held < 5000 and c.ids("word0 word199").tolist() == c._whole("word0 word199")


def test_the_tokenizer_is_asked_for_words_and_signs_alone(monkeypatch):
    c = packing.WordCache(packing.word_cache(TOKENIZER).tokenizer)
    assert c.split and c.direct and not c.whole
    c.ids("alpha beta 0 1 2 3 4 5 6 7 8 9")
    asked = []
    for name in ("_word", "_whole"):
        monkeypatch.setattr(c, name, lambda chunk, real=getattr(c, name): (asked.append(chunk), real(chunk))[1])
    text = "alpha!! (beta) alpha, 77 beta-alpha 7.7, (716)555-8176 beta.. x9@beta.alpha"
    got = c.ids(text).tolist()
    assert not any(ch.isalnum() for a in asked for ch in a)
    assert got == packing.word_cache(TOKENIZER)._whole(text)


def test_a_cache_keeps_what_it_meets_of_late():
    c = packing.WordCache(packing.word_cache(TOKENIZER).tokenizer, limit=8000)
    for i in range(300):
        c.ids(f"often {chr(97 + i % 26) * (1 + i // 26)}")
    size = lambda d: sum(len(k) + len(v) + 120 for k, v in d.items())
    assert ("often" in c or "often" in c.before) and size(c) + size(c.before) < 8000 and len(c) < 60


def test_pieces_cover_every_id_once(spark, docs):
    src = docs.select("doc_id", "text").union(spark.createDataFrame([(9001, None), (9002, "long word list. " * 3000), (None, "no id")], "doc_id long, text string"))
    p = packing.pack(src.repartition(3), TOKENIZER, capacity=256).toPandas()
    tok = packing.word_cache(TOKENIZER).tokenizer
    for doc, text in src.where("doc_id is not null").collect():
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in p[p.doc_id == doc].sort_values("start").itertuples():
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for _, s in p.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 256
    assert p.length.sum() / (256 * p.sequence_id.nunique()) > 0.95
    assert packing.pack(empty(spark), TOKENIZER).count() == 0


# --- near duplicates


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(5)
    k = rng.integers(0, 2**63, 600).astype(np.uint64)
    a, b = np.sort(k[:450]), np.sort(k[100:])
    wa, wb = rng.integers(1, 5, len(a)), rng.integers(1, 5, len(b))
    exact = near_dups.probability_jaccard(a, wa, b, wb)
    agree = np.mean(near_dups.signature(a, wa, 4000) == near_dups.signature(b, wb, 4000))
    assert agree == pytest.approx(exact, abs=0.04)
    naive = 0.0
    x = dict(zip(a.tolist(), wa.tolist(), strict=True))
    y = dict(zip(b.tolist(), wb.tolist(), strict=True))
    for i in set(x) & set(y):
        naive += 1 / sum(max(x.get(j, 0) / x[i], y.get(j, 0) / y[i]) for j in set(x) | set(y))
    assert exact == pytest.approx(naive)
    same = np.ones(450, dtype=int)
    assert near_dups.probability_jaccard(a, same, a, same) == pytest.approx(1.0)


def brute_classes(rows):
    hashes = near_dups.WordHashes()
    bags = {i: near_dups.shingles(near_dups.words_of(t), hashes) for i, t in rows}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(bags), 2):
        if near_dups.probability_jaccard(*bags[a], *bags[b]) >= 0.8:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in bags}


@pytest.mark.parametrize("small", [16, 2])
def test_classes_equal_brute_force(spark, docs, small):
    got = {r["id"]: r["class_id"] for r in near_dups.classes(docs, small=small).collect()}
    assert got == brute_classes([(r["doc_id"], r["text"]) for r in docs.collect()])


def test_near_dups_on_odd_rows(spark):
    out = near_dups.classes(odd(spark)).toPandas()
    assert len(out) == len(ODD)
    assert near_dups.keep_one(odd(spark)).count() == len(ODD) - 1  # one of the two equal rows goes
    assert near_dups.classes(empty(spark)).count() == 0


def test_rows_count_by_their_own_key_where_ids_repeat(spark):
    t1, t2, t3 = (" ".join(f"{w}{i}" for i in range(30)) for w in ("alpha", "beta", "gamma"))
    near = t3.replace("gamma29", "other")
    rows = [(3, t1), (5, t1), (5, t2), (7, t2), (5, t3), (5, t3), (None, near), (None, None), (5, None), (5, ""), (5, "  ")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    out = near_dups.classes(d)
    assert out.count() == len(rows)
    id_, h = near_dups._key("doc_id", "text")
    rows_, first, repeated = near_dups._classes(d.select(id_.alias("id"), h.alias("h"), "text"), common.Scratch(spark), 0.8, 16)
    assert repeated and first.count() == 6  # three texts, two kinds of wordless rows of one id, one of none
    text_of = d.select(h.alias("h"), F.coalesce("text", F.lit("")).alias("t")).distinct()
    of = {}
    for r in rows_.join(text_of, "h").collect():
        of.setdefault(r["class_id"], set()).add(r["t"])
    assert {frozenset(x) for x in of.values()} == {frozenset(x) for x in ([t1], [t2], [t3, near], [""], ["  "])} and len(of) == 6
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in near_dups.keep_one(d).collect())
    assert kept == sorted([("3", t1), ("5", t2), ("None", near), ("None", ""), ("5", ""), ("5", "  ")])


# --- pseudonyms


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pseudonyms_keep_formats_and_links(spark):
    text = "Card 4111 1111 1111 1111, 4111111111111111; a.b7@mail.example.com +1 (636) 555-9042 50.234.85.130 on 2001-02-28 or 28/02/2001, DE89 3704 0044 0532 0130 00, 999.1.1.1 2001-02-30 4111111111111112."
    d = spark.createDataFrame([(1, text), (2, "again 4111111111111111"), (3, None), (4, "plain")], "doc_id long, text string")
    a = {r["doc_id"]: r for r in pii.pseudonymise(d, "k", count_col="n").collect()}
    new, again = a[1]["text"], a[2]["text"].split()[1]
    assert a[1]["n"] == 8 and a[3]["text"] is None and a[3]["n"] == 0 and a[4]["text"] == "plain"
    assert again in new and luhn(again) and again != "4111111111111111"
    spaced = new.split("Card ")[1][:19]
    assert spaced.replace(" ", "") == again
    for gone in ("a.b7@", "555-9042", "50.234.85.130", "2001-02-28", "28/02/2001", "DE89"):
        assert gone not in new
    for kept in ("999.1.1.1", "2001-02-30", "4111111111111112", "+1 (", "@mail.example.com"):
        assert kept in new
    iban = [x for x in new.split(", ") if x.startswith("DE")][0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    b = {r["doc_id"]: r["text"] for r in pii.pseudonymise(d, "other").collect()}
    assert b[1] != new


def only(spark, values, key="k"):
    d = spark.createDataFrame(list(enumerate(values)), "i int, text string")
    return [r["text"] for r in pii.pseudonymise(d, key).orderBy("i").collect()]


def test_values_are_found_beside_numbers_and_capitals(spark):
    iban = "BE68 5390 0754 7034"
    card, card19 = "4111 1111 1111 1111", "6304 1234 0000 0000 129"
    texts = [f"{card} 12 times", f"{card} 123", f"12 {card}", f"2024 {card}", f"{card} {card}", f"{iban} EUR", f"{iban} 1234 X", "12 555-123-4567 89", "+44 20 7946 0958 1234 5678", f"x {card19} y", f"{card}-" + "1111 " * 3000, "4111111111111111 4111111111111112"]
    *new, moved, moved_iban = only(spark, [*texts, card, iban])
    assert moved != card and luhn(moved.replace(" ", "")) and len(moved) == 19
    assert new[:4] == [f"{moved} 12 times", f"{moved} 123", f"12 {moved}", f"2024 {moved}"] and new[4] == f"{moved} {moved}"
    assert new[5] == moved_iban + " EUR" and new[6].endswith(" 1234 X") and iban not in new[6]
    assert new[7].startswith("12 ") and new[7].endswith(" 89") and "555-123-4567" not in new[7]
    assert "7946 0958" not in new[8] and new[8].startswith("+44 ") and new[8].endswith(" 1234 5678")
    assert luhn(new[9][2:-2].replace(" ", "")) and new[9] != texts[9]
    assert new[10] != texts[10] and new[11].endswith(" 4111111111111112") and not new[11].startswith("4111111111111111")


def python_feistel_number(x, size_a, size_b, key):
    a, b = divmod(x, size_b)
    noise = lambda r, other: int(hashlib.sha256(f"{key}|{r}|{other}".encode()).hexdigest()[:12], 16)
    for r in range(pii.ROUNDS):
        a, b = ((a + noise(r, b)) % size_a, b) if r % 2 == 0 else (a, (b + noise(r, a)) % size_b)
    return a * size_b + b


def python_feistel(text, kinds, key):
    cut = len(text) // 2
    a, b, ka, kb = text[:cut], text[cut:], kinds[:cut], kinds[cut:]

    def add(half, kinds, other, r, tag):
        pad = "".join(hashlib.sha256(f"{tag}|{r}|{i}|{other}".encode()).hexdigest() for i in range(8))
        return "".join(al[(al.index(c) + int(pad[7 * i : 7 * i + 7], 16)) % len(al)] if (al := pii.ALPHABETS.get(k)) else c for i, (c, k) in enumerate(zip(half, kinds, strict=True)))

    for r in range(pii.ROUNDS):
        a, b = (add(a, ka, b, r, f"{key}|{len(text)}"), b) if r % 2 == 0 else (a, add(b, kb, a, r, f"{key}|{len(text)}"))
    return a + b


def test_pseudonyms_equal_brute_force_and_stay_valid(spark):
    key = hashlib.sha256(b"k").hexdigest()
    rng = np.random.default_rng(4)
    ssns = ["001-01-0001", "899-99-9999", "665-01-0001", "667-99-9999"] + [f"{a:03d}-{int(rng.integers(1, 100)):02d}-{int(rng.integers(1, 10000)):04d}" for a in rng.integers(1, 900, 1500) if a != 666]
    phones, card = ["+1 (636) 555-9042", "(017) 155-0000", "212-555-0100"], "4111111111111111"
    new = only(spark, [*ssns, *phones, card])
    new, new_phones, new_card = new[: len(ssns)], new[len(ssns) : -1], new[-1]
    for old, x in zip(ssns, new, strict=True):
        area, group, serial = map(int, old.split("-"))
        place = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        m = python_feistel_number(place, 898 * 99, 9999, key + "ssn")
        area = m // (99 * 9999) + 1
        assert x == f"{area + (area >= 666):03d}-{m // 9999 % 99 + 1:02d}-{m % 9999 + 1:04d}"
        assert x[:3] not in ("000", "666") and x[0] != "9" and x[4:6] != "00" and x[7:] != "0000"
    assert len(set(new)) == len(set(ssns))
    for old, x in zip(phones, new_phones, strict=True):
        d = "".join(c for c in old if c.isdigit())
        code, own = d[:-10], d[-10:]
        kinds = "".join("n" if own[i] in "23456789" else "o" if i in (0, 3) else "d" for i in (0, 3))
        kinds = kinds[0] + "dd" + kinds[1] + "d" * 6
        assert "".join(c for c in x if c.isdigit()) == code + python_feistel(own, kinds, key + "phone")
    assert new_card[:15] == "4" + python_feistel(card[1:15], "d" * 14, key + "card") and luhn(new_card)


def test_long_addresses_and_forms_of_dates(spark):
    long = "a" * 130 + "@" + "x." * 30 + "example.com"
    dates = ["2001/02/28", "2001-02-28", "5 March 2001", "Mar 5, 2001", "March 5, 2001", "31 May 1999", "28.02.2001"]
    new = only(spark, [long, *dates, "31 February 2001", "2001/02/30"])
    local, domain = new[0].split("@")
    assert len(local) == 130 and "aaaa" not in local and "@" + domain == long[130:]
    assert new[1].replace("/", "-") == new[2] and new[7].split(".")[::-1] == new[2].split("-")
    short = new[4].replace(",", "").split()
    assert len(short[0]) == 3 and short[0] == new[5][:3] and f"{short[1]} {short[0]}" == " ".join([new[3].split()[0], new[3].split()[1][:3]])
    assert new[8:] == ["31 February 2001", "2001/02/30"] and not set(new) & set(dates)


def test_addresses_secrets_and_numbers_by_context(spark):
    key = hashlib.sha256(b"k").hexdigest()
    v6 = ["2001:db8::1", "2001:0DB8:0:0:0:0:0:1", "fe80::1ff:fe23:4567:890a", "2001:db8:85a3:0:0:8a2e:370:7334", "2001:db8::"]
    new = only(spark, [f"at {x}, x" for x in v6])
    got = [x[3:].split(",")[0] for x in new]
    for old, x in zip(v6, got, strict=True):
        whole = ipaddress.ip_address(old).exploded.replace(":", "")
        assert ipaddress.ip_address(x).exploded == x and x.replace(":", "") == whole[:4] + python_feistel(whole[4:], "x" * 28, key + "ipv6")
    assert got[0] == got[1] and len(set(got)) == 4
    clean = ["std::vector a::b 12::30 10:20:30:40:50:60", "ace::add 1:2:3:4:5:6:7:8:9 2001:db8:1::2::3", "v 1.2.3.4", "v1.2.3.4 and Version 10.0.0.1", "section 3.2.1.4", "123456789", "SSN: 000456789", "sk-short ghp_short AIzax eyJab.cd.ef", "a@b @x.com"]
    assert only(spark, clean) == clean
    ip, ipv, bare, hyphened, words = only(spark, ["pav 1.2.3.4", "server 1.2.3.4", "SSN: 123456789", "123-45-6789", "social security number is 123456789."])
    assert ip[4:] == ipv[7:] != "1.2.3.4" and bare == "SSN: " + hyphened.replace("-", "") != "SSN: 123456789" and words == "social security number is " + bare[5:] + "."
    secrets = ["ghp_" + "aB3" * 12, "ghp_" + "abcdefghij" * 4, "xoxb-123456789012-abcdefABCDEF", "sk_live_" + "4eC39HqLyjWDarjtT1zdp7dc", "AIza" + "Sy9" * 11 + "xY", "glpat-" + "a1-b2_" * 4, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dozjgNryP4J3jVmNHl0w5N_XgL0n3I9P", "github_pat_" + "a1_B2" * 30]
    begin = ["ghp_", "ghp_", "xoxb-", "sk_live_", "AIza", "glpat-", "eyJ", "github_pat_"]
    for old, b, x in zip(secrets, begin, only(spark, [f"key={s} end" for s in secrets]), strict=True):
        x = x[4:-4]
        kinds = lambda t: ["d" if c in "0123456789" else "l" if c.islower() else "u" if c.isupper() else c for c in t]
        assert x != old and x.startswith(b) and kinds(x) == kinds(old)


def test_addresses_beyond_ascii(spark):
    olds = ["ü@ex.de", "müller.ß@bücher.example", "иван@почта.рф", "ΑΘΗΝΑ@x.gr", "łódź1@x.xn--p1ai", "ann@" + "x" * 30 + "." + "museum" * 6, "王@例子.中国"]
    *new, han = only(spark, [f"({x})" for x in olds])
    assert han == f"({olds[-1]})"  # letters of other scripts stay
    for old, x in zip(olds, new, strict=False):
        (a, d), (b, e) = old.split("@"), x[1:-1].split("@")
        assert d == e and a != b and len(a) == len(b) and [c.isalpha() for c in a] == [c.isalpha() for c in b] and [ord(c) < 128 for c in a] == [ord(c) < 128 for c in b]
    local = "müllеr.ßx"
    kinds = "".join(next((k for k, al in (pii.ALPHABETS | pii.FOREIGN).items() if k in "dluaAgGcC" and c in al), "-") for c in local)
    alphabets = dict(pii.ALPHABETS)
    try:
        pii.ALPHABETS.update(pii.FOREIGN)
        want = python_feistel(local, kinds, hashlib.sha256(b"k").hexdigest() + "|email|0")
    finally:
        pii.ALPHABETS.clear()
        pii.ALPHABETS.update(alphabets)
    assert only(spark, [local + "@x.de"]) == [want + "@x.de"]


def test_number_permutation_is_one_to_one(spark):
    d = spark.range(229 * 319).select(pii.feistel_number(F.col("id"), 229, 319, F.lit("k")).alias("x"))
    r = d.agg(F.count_distinct("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).first()
    assert (r["n"], r["lo"], r["hi"]) == (229 * 319, 0, 229 * 319 - 1)
    e = spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("t"))
    assert e.select(pii.feistel(F.col("t"), F.lit("ddd"), F.lit("k")).alias("x")).distinct().count() == 1000


def test_pseudonyms_on_odd_rows(spark):
    out = pii.pseudonymise(odd(spark), "k")
    assert out.count() == len(ODD) and out.columns == odd(spark).columns
    assert pii.pseudonymise(empty(spark), "k").count() == 0


# --- html


def page(host, i, main, extra=""):
    return (i, f"https://{host}/p/{i}", f"<html><head><title>t</title><script>var t='</p>';</script></head><body><div class='wrap'><div class='box'>Stay in touch today</div><div class='body'><p>{main}<p>second &amp; last {i}</p></div></div>{extra}</body></html>")


def test_template_goes_and_content_stays(spark):
    rows = [page("a.example", i, f"Main <b>text</b> {i}<br>line {i}", "<div id='comments'>me too</div><footer>f</footer>") for i in range(8)]
    rows.append((100, "https://a.example/x", "<body><nav>menu</nav><article><h1>Head</h1><p>Stay in touch today<p>x&nbsp;y&lt;z<div class='ad'>buy</div></article><p>tail</p>"))
    rows += [(101, None, None), (102, "no host", ""), (103, "https://b.example/", "<p>only <i>one</i></p")]
    out = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert out[3] == "Main text 3 line 3 second & last 3"
    assert out[100] == "Head Stay in touch today x y<z"
    assert out[101] == "" and out[102] == "" and out[103] == "only one"
    assert html_text.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_matching_aligns_across_a_missing_node():
    a = [(-1, "#"), (0, "body"), (1, "nav"), (1, "div"), (1, "footer")]
    b = [(-1, "#"), (0, "body"), (1, "div"), (1, "footer")]
    assert html_text.match_trees(a, b) == {0: 0, 1: 1, 3: 2, 4: 3}


def test_articles_are_aligned_like_all_else(spark):
    top = "<div class='wrap'><div class='box'>Stay in touch</div>"
    rows = []
    for i in range(12):
        if i < 6:
            body = f"{top}<div class='lead'>Lead {i}</div><article class='post-{i}'><p>House rules apply</p><p>Own {i}</p></article></div>"
        else:
            body = f"{top}<div class='list'>List {i}</div></div>"
        rows.append((i, f"https://d.example/{i}", f"<html><body class='page-{i}'>{body}</body></html>"))
    rows += [(20 + i, f"https://d.example/copy/{i}", rows[0][2]) for i in range(30)]  # copies of a page say nothing new
    out = {r["page_id"]: r["text"] for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert out[i] == (f"Lead {i} Own {i}" if i < 6 else f"List {i}")
    assert {out[20 + i] for i in range(30)} == {"Lead 0 Own 0"}


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<html class='cookies'><body class='has-sidebar search'>a<main class='no-comments comments'>b", "a b"),
        ("<body><article class='post category-ads related'>a<div class='x-share'>b</div><div class='share x'>c</div></article>", "a b"),
        ("<body><div class='modal'>a<main>b</main></div><form>c<article>d<section id='comments'><article>e</article></section></article></form>", "d"),
        ("<body><div class='modal'>a<main>b<div role='search'>c</div></main></div><nav><main>d</main></nav>", "b"),
        ("<body><div class='no-header'>a</div><div class='site-header'>b</div>", "a"),
    ],
)
def test_names_of_whole_pages_say_nothing(html, text):
    assert html_text.extract(html, None, frozenset(), html_text.Aligner()) == text


def test_lists_tables_and_long_pages_are_aligned(spark):
    menu = "".join(f"<section><div class='s{k}'></div></section>" for k in range(300))
    rows = []
    for i in range(8):
        cells = ["Yes" if k == i % 8 else f"v{i}-{k}" for k in range(8)]  # on every page, each time in another cell
        table = "".join(f"<tr><td>{c}</td></tr>" for c in cells)
        items = "".join(f"<li>item {i} {k}</li>" for k in range(i + 1))
        rows.append((i, f"https://c.example/{i}", f"<body><table>{table}</table><ul>{items}</ul>{menu}<div class='box'>Stay in touch</div><div class='text'>Own {i}</div></body>"))
    out = {r["page_id"]: r["text"].split() for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(8):
        assert out[i].count("Yes") == 1 and "Stay" not in out[i] and out[i][-2:] == ["Own", str(i)]
        assert out[i].count("item") == i + 1


def test_odd_pages(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 2000
    rows = [(1, "https://e.example/a", deep), (1, "https://e.example/a", deep), (1, "https://e.example/b", "<p>" + "word " * 200_000), (None, "https://e.example/c", "</div></p>broken <b>tags</i> <p>x"), (2, "https://e.example/d", "plain \u00e9&eacute;&#233;"), (3, "https://e.example/e", "<p>x</p>" * 3000), (4, "HTTPS://E.example", "<!-- no text -->")]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, reference int")
    out = html_text.main_text(d)
    assert out.columns == ["page_id", "url", "host", "reference", "text"]
    texts = sorted((r["text"] for r in out.collect()), key=len)
    assert texts == sorted(["deep", "deep", " ".join(["word"] * 200_000), "broken tags x", "plain ééé", " ".join(["x"] * 3000), ""], key=len)


def most_pairs(a, b):
    """Size of the largest matching, by plain recursion."""
    ca, cb = html_text.children(a), html_text.children(b)

    def best(x, y):
        if a[x][1] != b[y][1]:
            return 0

        def rows(xs, ys):
            return max(rows(xs[1:], ys), rows(xs, ys[1:]), best(xs[0], ys[0]) + rows(xs[1:], ys[1:])) if xs and ys else 0

        return 1 + rows(ca[x], cb[y])

    return best(0, 0)


def test_tree_matching_equals_brute_force():
    rng = np.random.default_rng(5)

    def tree():
        nodes, path = [(-1, "#")], [0]
        for i in range(1, int(rng.integers(2, 9))):
            path = path[: int(rng.integers(1, len(path) + 1))]
            nodes.append((path[-1], "ab"[int(rng.integers(0, 2))]))
            path.append(i)
        return nodes

    for _ in range(200):
        a, b = tree(), tree()
        pairs = html_text.match_trees(a, b)
        assert len(pairs) == most_pairs(a, b) and len(set(pairs.values())) == len(pairs)
        assert all(a[x][1] == b[y][1] and (x == 0 or pairs[a[x][0]] == b[y][0]) for x, y in pairs.items())
        shapes = html_text.Shapes()
        xs, ys = ([shapes.read([(-1, k)])[0] for k in rng.choice(list("abc"), 12)] for _ in range(2))
        assert len(shapes.align(xs, ys, cells=4)) == len(shapes.align(xs, ys))
    deep = [(-1, "#")] + [(i, "div") for i in range(3000)]
    assert len(html_text.match_trees(deep, deep[:2500])) == 2500


# --- archives


def test_archives_round_trip(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>é{i % 4}</p>") for i in range(20)] + [(20, None, None), (21, "u", ""), (22, "u", "b" * 3000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("x")).repartition(3)
    index = warc.write_archives(d, str(tmp_path / "a"), frame_bytes=1000, bundle_bytes=4000)
    out = {r["page_id"]: r for r in warc.read_archives(index).collect()}
    first = {}
    for i, _, h in rows:
        first.setdefault(h or "", i)
    for i, _, h in rows:
        raw = (h or "").encode()
        r = out[i]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if first[h or ""] == i else ("revisit", first[h or ""]))
    import zstandard

    for f in (tmp_path / "a").glob("*.zst"):
        data = f.read_bytes()
        frames = warc.read_seek_table(data)
        at = 0
        for c, plain in frames:
            assert len(zstandard.ZstdDecompressor().decompress(data[at : at + c])) == plain
            at += c
    odd_ids = spark.createDataFrame([(7, "u", "same"), (7, "u", "same"), (3, None, "same"), (None, "u", "same"), (None, "u", None)], "page_id long, url string, html string")
    got = warc.read_archives(warc.write_archives(odd_ids, str(tmp_path / "c"))).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0) for r in got) == [(0, "response", 0), (0, "response", 0), (3, "response", 0), (7, "revisit", 3), (7, "revisit", 3)]
    assert warc.read_archives(warc.write_archives(odd_ids.limit(0), str(tmp_path / "d"))).count() == 0
    alone = warc.write_archives(d, str(tmp_path / "b"), least_bytes=100)
    assert {r["record_type"] for r in warc.read_archives(alone).collect()} == {"response"}


# --- neighbours


def test_graph_recall_and_ties(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[100:400] = x[100]  # one vector that a fifth of the rows have
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [None] * 16)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = hnsw.nearest(d, d.where("vec_id % 50 = 0"), k=10, least_shards=2).toPandas()
    xs = x.astype(float)
    hits = total = 0
    for q, g in out.groupby("query_id"):
        s = (xs * xs[q]).sum(1)
        best = [i for i in np.lexsort((np.arange(1500), -s)) if i != q][:10]
        got = list(g.sort_values("rank").vec_id)
        hits += len(set(best) & set(got))
        total += 10
        np.testing.assert_allclose(g.sort_values("rank").score, s[got])
        if q == 150:
            assert got == best == list(range(100, 110))
    assert hits / total >= 0.9 and out.query_id.nunique() == 30
    assert hnsw.nearest(d.limit(0), d.limit(0)).count() == 0


def test_recall_of_a_shard_far_larger_than_the_beam():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(6000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    found = hnsw.Graph(hnsw._lifted(x, 1.0)).search(np.concatenate([x[:100], np.zeros((100, 1))], 1), 240)
    score = x[:100] @ x.T
    hits = sum(len(set(np.argsort(-score[i])[1:21]) & set(found[i][found[i] != i])) for i in range(100))
    assert hits / 2000 >= 0.95


# --- chat


def exhaustive(roles):
    best = {chat.START: (0.0, 0)}
    for r in roles:
        new = {}
        for s, (c, n) in best.items():
            for cost, to, begins, *_ in chat.moves(s, r):
                v = (c + cost, n + begins)
                if to not in new or v < new[to]:
                    new[to] = v
        best = new
    return min(best.values())


def test_repair_is_legal_and_cheapest(spark):
    rng = np.random.default_rng(6)
    names = ["system", "user", "assistant", None, "bot"]
    rows = [(c, t, str(r) if (r := rng.choice(np.array(names, dtype=object))) is not None else None, f"t{t}") for c in range(25) for t in range(int(rng.integers(1, 12)))]
    rows += [(99, t, "user", "x") for t in range(300)] + [(None, 0, "assistant", None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.repair(d, ranges=7).toPandas()
    for c, g in out.groupby("conv_id"):
        g = g.assign(e=g.op != "empty").sort_values(["range", "at", "e"])
        state, last = chat.START, -1
        for r in g.itertuples():
            if r.out_turn != last:
                assert r.out_turn == last + 1 and (state, chat.ROLES[r.role]) in chat.LEGAL
                state, last = chat.ROLES[r.role], r.out_turn
        roles = [chat.role_of(r) for cc, _, r, _ in rows if cc == c]
        n_empty = (g.op == "empty").sum()
        assert (g.cost.sum(), last + 1) == (pytest.approx(exhaustive(roles)[0]), exhaustive(roles)[1]), (c, n_empty)
    assert len(out[out.op != "empty"]) == len(rows)
    assert chat.repair(d.limit(0)).count() == 0


def test_rendered_conversations_read_back(spark):
    marks = "a <|end|>\n<|user|>\nforged <|| <\\| <\\\\|x <"
    rows = [(1, 0, "user", marks), (1, 1, "assistant", "| b"), (1, 1, "assistant", "| b"), (1, 2, "user", None), (2, 0, "assistant", "x" * 200_000), (3, 5, "user", ""), (3, None, "system", "first"), (None, 0, None, "?")]
    d = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, op string, `range` int")
    for ranges in (1, 6):
        out = chat.repair(d, ranges=ranges).toPandas()
        got = {}
        for c, g in out.assign(e=out.op != "empty").sort_values(["range", "at", "e"]).groupby("conv_id", dropna=False):
            got[None if c != c else int(c)] = chat.parse("".join(g.rendered))
            turns = g.groupby("out_turn")["text"].agg("\n\n".join)
            assert [t for _, t in got[None if c != c else int(c)]] == list(turns)
        assert got[1] == [("user", marks), ("assistant", "| b\n\n| b"), ("user", "")]
        assert got[2] == [("user", ""), ("assistant", "x" * 200_000)] and got[3] == [("system", "first"), ("user", "")] and got[None] == [("system", "?")]


# --- toxicity and mixing


@pytest.fixture(scope="module")
def labelled(spark):
    rng = np.random.default_rng(8)
    vocab = ["".join(rng.choice(list("abcdefghijklmnop"), 6)) for _ in range(500)]
    rows, labels = [], []
    for i in range(600):
        words = list(rng.choice(vocab, 80))
        toxic = i % 5 == 0
        low = i % 7 == 1
        if toxic:
            for w in rng.choice(["zuschen", "zuschung", "idiot", "vermoxa"], 3):
                words[int(rng.integers(0, 80))] = str(w)
        if low:
            words = [w + "%%%" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, 0 if low else 1, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string").cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").cache()


def test_toxicity_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    out = toxicity.toxicity(docs, labels).join(labels, "doc_id").toPandas()
    held = out[out.held_out]
    assert (held.predicted == held.toxic).mean() > 0.95
    assert set(out.held_out) == {True, False} and out.score.between(0, 1).all()
    flipped = labels.withColumn("toxic", F.when(common.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity.toxicity(docs, flipped).toPandas().set_index("doc_id").score
    assert np.allclose(again.sort_index(), out.set_index("doc_id").score.sort_index())


def test_toxicity_on_odd_rows(spark, labelled):
    out = toxicity.toxicity(odd(spark), labelled[1]).toPandas()
    assert len(out) == len(ODD) and out.score.notna().all() and not out.predicted.any()
    assert toxicity.toxicity(empty(spark), labelled[1]).count() == 0


def test_mixture_meets_targets(spark, labelled):
    docs, labels = labelled
    out = mixing.mixture(docs, labels, {"low": 0.05, "plain": 0.9, "toxic": 0.05}).toPandas()
    used = (out.tokens * out.rate).sum()
    assert used == pytest.approx(out.tokens.sum(), rel=0.05) and (out.rate >= 0).all()
    for d, share in (("low", 0.05), ("plain", 0.9), ("toxic", 0.05)):
        assert (out.tokens * out[f"p_{d}"] * out.rate).sum() / used == pytest.approx(share, abs=0.02)
    mixed = mixing.remix(docs.withColumn("uses", F.lit(1)), labels)
    assert mixed.columns == ["doc_id", "text", "uses"]
    assert mixing.mixture(empty(spark), labels).count() == 0


@pytest.mark.parametrize(("low", "high"), [(0.0, 1.0), (0.01, 0.5)])
def test_rates_equal_least_squares_without_a_domain(spark, low, high):
    rng = np.random.default_rng(8)
    toxic = low + (high - low) * rng.beta(0.3, 3, 300)
    p, tokens = np.column_stack([0 * toxic, 1 - toxic, toxic]), rng.integers(1, 500, 300)
    rows = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(tokens, p, strict=True)], "tokens long, p array<double>")
    model = mixing.DomainModel(None, None, None, [False, True, True])
    rates = mixing.rates_of(model, rows.coalesce(1), mixing.TARGETS)
    a, total = (p * tokens[:, None]).T[1:], tokens.sum()
    want = np.array([0.96, 0.03]) / 0.99 * total
    assert toxic.min() < 0.03 / 0.99 < toxic.max()
    best = want  # it is inside the cone of the documents, so least squares has a residual of 0
    assert rates.converged and rates.reached[0] == 0 and np.abs(rates.reached[1:] - best).max() < 1e-3 * total
    got = np.array([r[0] for r in rows.coalesce(1).select(rates.column(F.col("p"))).collect()])
    assert np.allclose(a @ got, rates.reached[1:])
    with pytest.warns(UserWarning, match="not converged"):
        assert not mixing.fit_rates(rows, np.array([0.0, 0.9999, 0.0001]), rounds=0).converged


def test_a_target_out_of_reach_draws_no_others_after_it(spark):
    rng = np.random.default_rng(3)
    low, toxic = rng.uniform(0.0001, 0.0013, 200), rng.beta(0.4, 3, 200)
    p, tokens = np.column_stack([low, 1 - low - toxic * (1 - low), toxic * (1 - low)]), rng.integers(1, 300, 200)
    rows = spark.createDataFrame([(int(n), [float(x) for x in q]) for n, q in zip(tokens, p, strict=True)], "tokens long, p array<double>").coalesce(1)
    want = np.array([0.01, 0.96, 0.03])
    rates = mixing.fit_rates(rows, want)
    a, x = (p * tokens[:, None]).T / tokens.sum(), np.ones(200)  # dense accelerated projected gradient
    y, momentum, step = x, 1.0, 1 / np.linalg.eigvalsh(a @ a.T)[-1]
    for _ in range(100_000):
        new = np.maximum(0, y - step * (a.T @ (a @ y - want)))
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        x, y, momentum = new, new + (momentum - 1) / following * (new - x), following
    assert np.abs(rates.reached / rates.total - a @ x).max() < 2e-3
    got = np.array([r[0] for r in rows.select(rates.column(F.col("p"))).collect()])
    assert np.allclose(a @ got, rates.reached / rates.total) and (got * tokens).sum() < 1.1 * tokens.sum()


def test_domains_are_learnt_from_the_rows_that_are_left(spark, labelled):
    docs, labels = labelled
    gone = labels.where("quality = 0 and toxic = 0").select("doc_id")
    left = docs.join(gone, "doc_id", "left_anti")
    ghosts = spark.createDataFrame([(10_000_000 + i, 1, 0) for i in range(3000)], labels.select("doc_id", "quality", "toxic").schema)
    out = mixing.mixture(left, labels.select("doc_id", "quality", "toxic").unionByName(ghosts), per_class=100).agg(
        *[F.sum(F.expr(f"tokens * p_{d} * rate")).alias(d) for d in mixing.DOMAINS], F.sum("tokens").alias("n")
    ).first()
    assert out["low"] == 0
    assert abs(out["toxic"] / out["n"] - 0.03 / 0.99) < 1e-3 and abs(out["plain"] / out["n"] - 0.96 / 0.99) < 1e-3


def test_mixing_on_odd_rows(spark, labelled):
    docs, labels = labelled
    extra = odd(spark).select("doc_id", "text", F.lit(1).alias("copies"), F.lit("x").alias("membership"))
    both = docs.where("doc_id > 6").select("doc_id", "text", F.lit(1).alias("copies"), F.lit("x").alias("membership")).unionByName(extra)
    out = mixing.mixture(both, labels).toPandas()
    assert len(out) == both.count() and out.rate.notna().all() and (out.rate >= 0).all() and out[["p_low", "p_plain", "p_toxic"]].sum(axis=1).round(9).eq(1).all()
    again = mixing.mixture(both.repartition(5), labels).toPandas()
    order = ["doc_id", "tokens", "copies"]
    assert again.sort_values(order)[order].reset_index(drop=True).equals(out.sort_values(order)[order].reset_index(drop=True))
    mixed = mixing.remix(both, labels)
    assert mixed.columns == both.columns and mixed.count() == out.copies.sum()
    assert mixing.remix(both.limit(0), labels).count() == 0 and mixing.mixture(both, labels.limit(0)).count() == len(out)


def test_vocabulary_hits_are_the_features():
    v = text_model.Vocabulary(["w:loser", "p:zusc", "s:short"])
    assert v.hits("A l0ser, zuschen!") == [0, 1, 2] and v.hits(None) == []
