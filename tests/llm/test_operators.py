"""Each operator against a plain version of its contract on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bpe, decontaminate, exact_dedup, license_scan, line_dedup, lm_scoring, pii, simhash, toxicity, url_filter

random.seed(11)
SYLLABLES = ["the", "tion", "er", "an", "ou", "ré", "and ", " of ", ". ", ",\n", "Mit License ", "GNU general-public LICENSE ", "1", "😀", "apache\tlicense "]
TEXTS = ["".join(random.choices(SYLLABLES, k=random.randint(0, 60))) for _ in range(120)]
TEXTS += [t.upper() for t in TEXTS[:10]] + [t + " x" for t in TEXTS[20:50]] + TEXTS[:5]


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string").repartition(5).cache()


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_groups_even_when_digests_collide(docs, digest):
    groups = collections.defaultdict(list)
    for i, t in enumerate(TEXTS):
        groups[lower(t)].append(i)
    got = exact_dedup.exact_groups(docs, salts=3, **({"digest": digest} if digest else {})).collect()
    assert len(got) == len(TEXTS)
    for r in got:
        g = groups[lower(TEXTS[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(g), len(g), r.doc_id == max(g), hashlib.sha256(lower(TEXTS[r.doc_id]).encode()).hexdigest())


@pytest.mark.parametrize("digest", [None, lambda c: F.substring(F.sha2(c, 256), 1, 1)])
def test_exact_filter_keeps_one_each(docs, digest):
    got = exact_dedup.drop_exact_copies(docs, **({"digest": digest} if digest else {})).collect()
    assert sorted(map(tuple, got)) == sorted({lower(t): (i, t) for i, t in enumerate(TEXTS)}.values())


def test_license_base_counts(docs):
    for r in license_scan.scan(docs).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(TEXTS[r.doc_id]))
        hits = [(i, label) for p, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in hits]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(hits), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in hits})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_rules_and_suppression(spark):
    assert len(license_scan.rules()) > 200
    rows = {
        "Released under the MIT License. All rights reserved.": "all-rights-reserved,mit", "GNU Lesser General Public License, version 2.1": "gpl,lgpl-2.1", "SPDX-License-Identifier: Apache-2.0": "apache-2.0",
        "licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc", "nothing here": "",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(df).collect()} == dict(enumerate(rows.values()))


def test_license_gate_is_implied_by_every_rule(spark):
    import re._parser as parser

    def needs(items, run=""):
        """Whether all that this matches, after `run`, has a root."""
        for op, arg in items:
            before, run = run, run + chr(arg) if op is parser.LITERAL else ""
            if any(x in run for x in license_scan.ROOTS):
                return True
            if op is parser.SUBPATTERN and needs(arg[3], before) or op is parser.BRANCH and all(needs(x, before) for x in arg[1]) or op is parser.MAX_REPEAT and arg[0] > 0 and needs(arg[2]):
                return True
        return False

    missed = [r[1] for r in license_scan.rules() if not needs(parser.parse(r[1]))]
    assert missed == []
    rows = {
        "Code is Apache 2.0.": "apache-2.0", "MPL": "mpl", "GFDL": "gfdl", "Licensed under the MPL-2.0": "mpl-2.0", "This work is in the public domain": "public-domain", "Python Software Foundation License": "psf", "berkeley software distribution": "bsd", "all rights\nreserved": "all-rights-reserved", "public\ndomain": "", "the public-domain": "",
        "dedicated\nto the public\ndomain": "public-domain", "do\nnot copy": "proprietary", "confidential  and proprietary": "proprietary", "CC\nBY": "cc-by", "creative\ncommons attribution": "cc-by",
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan.scan(df).collect()} == dict(enumerate(rows.values()))


def test_license_rules_against_python(spark):
    """Every rule on an example of its own, in random company: the winners at each place, less what lies inside stronger ones."""
    random.seed(3)
    table = license_scan.rules()
    assert len(table) == len({r[1] for r in table}) and all(re.fullmatch("[a-z0-9]+", r[0]) for r in table)

    def example(regex):
        text = regex
        while (shorter := re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", text)) != text:
            text = shorter
        return re.sub(r"\[(.)[^\]]*\]", r"\1", text.replace(".{1,80}", "the maker").replace(".{1,60}", "some one").replace(r"\w+", "heck").replace(r"\d\d", "09").replace(" ?", " ").replace("v?", "v").replace("s?", "s"))

    texts = [example(r[1]) for r in table]
    for (_, regex, _, _), t in zip(table, texts):
        assert re.fullmatch(regex, t), (regex, t)
    texts += [" ".join(random.choices([t for t in texts], k=5)) for _ in range(150)]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)).collect()}
    for i, t in enumerate(texts):
        words = t.split()
        raw = []
        for at in range(len(words)):
            window = " ".join(words[at : at + license_scan.SPAN]) + " "
            hits = [(rank, m[0].count(" "), label) for _, rx, label, rank in table if (m := re.match(f"(?:{rx}) ", window))]
            if hits:
                rank, n, label = max(hits)
                raw.append((at, at + n, label, rank))
        kept = [d for d in raw if not any(o[0] <= d[0] and o[1] >= d[1] and (o[3] > d[3] or o[3] == d[3] and o[1] - o[0] > d[1] - d[0]) for o in raw)]
        assert [tuple(d) for d in got[i].detections] == kept, t
        assert got[i].score == max([d[3] / 100 for d in kept] + [0.8 * (got[i].n_base > 0)])


def test_url_contract(spark):
    urls = {
        "http://A.example.net/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/", "allow"), "https://x.net/": ("x.net", "/", "net/", "block"), "http://net/a": ("net", "/a", "net/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, None), "http://b.example.com/de/x": ("b.example.com", "/de/x", "example.com/de/", "block"), "http://q.org/fr/": ("q.org", "/fr/", "org/fr/", "allow"),
        "http://q.org/frx": ("q.org", "/frx", None, None), "http://x.net": ("x.net", "", None, None), "no": ("", "", None, None), "http://h?a/b": ("h", "", None, None), "http://x.net/en/": ("x.net", "/en/", "net/", "block"),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in url_filter.judge_urls(df).collect():
        host, path, rule, verdict = list(urls.values())[r.page_id]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_url_models_against_python(spark):
    """Scores from a plain computation of the same smoothed models."""
    random.seed(4)
    urls = [f"http://{random.choice(['good', 'shop', 'win'])}{random.randint(0, 99)}.{random.choice(['net', 'org', 'example.net', 'com'])}/{random.choice(['en', 'fr', 'de'])}/{random.randint(0, 999)}" for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.judge_urls(df).collect()}
    al, n = url_filter.ALPHABET, url_filter.SIZE

    def codes(u):
        t = re.sub("[1-9]", "0", lower(u.split("://")[1]))
        return [al.index(c if c in al[3:] else "~") for c in t]

    counts = {k: [collections.Counter() for _ in range(6)] for k in ("allow", "block")}
    for i, u in enumerate(urls):
        if got[i].rule and hashlib.md5(u.encode()).hexdigest()[0] not in url_filter.CALIBRATE:
            s = [0, 0, *codes(u), 1]
            for a, b, c in zip(s, s[1:], s[2:]):
                for m, key in zip(counts[got[i].verdict], ((a, b, c), (a, b), (b, c), b, c, 0)):
                    m[key] += 1

    def p(k, a, b, c):
        m, w = counts[k], url_filter.BACKOFF
        p0 = (m[4][c] + 1) / (m[5][0] + n)
        p1 = (m[2][b, c] + w * p0) / (m[3][b] + w)
        return (m[0][a, b, c] + w * p1) / (m[1][a, b] + w)

    for i in range(0, 300, 7):
        s = [0, 0, *codes(urls[i]), 1]
        ratio = [math.log(p("allow", *t) / p("block", *t)) for t in zip(s, s[1:], s[2:])]
        assert got[i].score == pytest.approx(sum(ratio) / len(ratio), abs=1e-4)


def test_bpe_equals_the_library_and_round_trips(docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for r in bpe.encode_documents(docs, path, ids=True).collect():
        ids = library.encode(TEXTS[r.doc_id], add_special_tokens=False).ids
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), library.decode(ids, skip_special_tokens=False))
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    codec = bpe.tokenizer(path)
    for text in ("ab" * 5000, "x<|endoftext|>y <|endoftext|>", " " * 3000 + "a", "é" * 999, "".join(random.choices("abcdefgh", k=4000))):
        assert codec.encode(text) == library.encode(text, add_special_tokens=False).ids and codec.decode(codec.encode(text)) == text
    assert codec.decode([200, 201, 202, 50256]) == library.decode([200, 201, 202, 50256], skip_special_tokens=False)


def test_bpe_window_stays_bounded():
    import public_tokenizers

    merges = bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json")).merges
    e, out = bpe.Encoder(merges), []
    for _ in range(200):
        out += e.feed("".join(random.choices("abcdefghij", k=100)).encode())
        assert len(e.window) <= merges.lookahead + 8 * merges.longest < 2000
    assert len(out) > 1000


def test_bpe_lookahead_against_brute_force():
    pick, reaches = random.Random(11), []
    for letters in ("ab", "abc", "abcd") * 20:
        merges, texts = [], [[bytes([c]) for c in pick.choices(letters.encode(), k=60)] for _ in range(3)]
        while len(merges) < 25:  # pairs of a random corpus, in the order in which they are merged
            pairs = sorted({p for t in texts for p in zip(t, t[1:])} - set(merges))
            if not pairs:
                break
            merges.append(pick.choice(pairs))
            for t in texts:
                k = 0
                while k < len(t) - 1:
                    if (t[k], t[k + 1]) == merges[-1]:
                        t[k : k + 2] = [t[k] + t[k + 1]]
                    k += 1
        made = [a + b for a, b in merges]
        if any(a + b in {x for m in merges[:k] for x in m} for k, (a, b) in enumerate(merges)):
            with pytest.raises(ValueError, match="out of order"):
                bpe.sufficient_lookahead(merges)
            continue
        vocab = {t: i for i, t in enumerate(dict.fromkeys([*(bytes([c]) for c in letters.encode()), *made]))}
        m, reach = bpe.MergeList(vocab, merges), 0
        e = bpe.Encoder(m)
        for _ in range(12):
            text = "".join(pick.choices(letters, k=70)).encode()
            whole, ends = m.merged(text), []
            for t in whole:
                ends.append((ends or [0])[-1] + len(m.bytes_of[t]))
            for n in range(1, len(text)):
                at, ids = 0, m.merged(text[:n])
                for k, t in enumerate(ids):
                    at += len(m.bytes_of[t])
                    if at <= n - m.lookahead:
                        assert ids[: k + 1] == whole[: k + 1], (merges, text, n)
                    elif ids[: k + 1] != whole[: k + 1]:
                        reach = max(reach, n - at + 1)
            e.merges.longest = 1  # so that tokens are emitted as soon as they may be
            assert [i for c in text for i in e.feed(bytes([c]))] + e.finish() == whole
        assert reach <= m.lookahead
        reaches.append((reach, m.lookahead))
    assert len(reaches) > 10, reaches
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 1 and bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b")]) == 2
    with pytest.raises(ValueError, match="out of order"):
        bpe.sufficient_lookahead([(b"ab", b"c"), (b"a", b"b")])


def test_lm_base_and_held_out(spark, docs):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + ["\n"] for i, t in enumerate(TEXTS)}
    held = {i for i in words if zlib.crc32(str(i).encode()) % 7 == 2}
    c = collections.Counter(w for i, ws in words.items() if i not in held for w in ws)
    n, v = sum(c.values()), len(c)
    for r in lm_scoring.score_documents(docs, classes=16, held=20).collect():
        ws = words[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id in held, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) and r.score < 0


def test_lm_score_against_brute_force(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(9000 + i, "é ß a bb ccc neverseen%d" % i) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    rng = np.random.default_rng(4)
    params = {}

    def drawn(docs, v):
        lm = lm_scoring.LogBilinear(lm_scoring._unigram(v))
        lm.params = {k: rng.standard_normal(x.shape).astype(np.float32) for k, x in lm.params.items()}
        params.update(lm.params)
        return lm

    monkeypatch.setattr(lm_scoring, "train", drawn)
    got = {r.doc_id: r.score for r in lm_scoring.score_documents(df, classes=24, held=30).collect()}
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) for i, t in rows}
    c = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    own = sorted(c, key=lambda w: (-c[w], w.encode()))[:22]
    of = lambda w: own.index(w) + 4 if w in own else 1 + zlib.crc32(w.encode()[-2:]) % 3
    shared, once = collections.Counter(), collections.Counter()
    for w in set(c) - set(own):
        shared[of(w)] += c[w]
        once[of(w)] += c[w] == 1
    for i, ws in words.items():
        ids, total = [0, 0, *map(of, ws), 0], 0.0
        for at in range(2, len(ids)):
            s = sum(params["R"][ids[at - 1 - j]] @ params["C"][j] for j in range(2)) @ params["Q"].T + params["b"]
            total += (s[ids[at]] - s.max() - np.log(np.exp(s - s.max()).sum())) / math.log(10)
        for w in ws:
            if w not in own:
                k = of(w)
                unseen = (once[k] + 1) / (shared[k] + once[k] + 2) if shared[k] else 1.0
                total += math.log10((1 - unseen) * c[w] / shared[k] if c[w] else unseen)
        assert got[i] == pytest.approx(total, rel=1e-4, abs=1e-3)


def test_lm_is_normalised_and_learns_context():
    rng = np.random.default_rng(0)
    w = np.zeros(40001, int)
    for i in range(1, len(w)):  # a chain: the next class is mostly the one after
        w[i] = (w[i - 1] + 1) % 8 if rng.random() < 0.9 else rng.integers(8)
    uni = np.bincount(w, minlength=8) / len(w)
    lm = lm_scoring.LogBilinear(uni)
    h, t = np.stack([w[1:-1], w[:-2]], 1), w[2:]
    lm.train((h[a : a + 512], t[a : a + 512]) for _ in range(5) for a in range(0, len(t), 512))
    every = np.array([[a, b] for a in range(8) for b in range(8)])
    assert np.allclose(sum(10 ** lm.log10(every, np.full(64, k)) for k in range(8)), 1, atol=1e-5)
    assert lm.log10(h, t).mean() > np.log10(uni[t]).mean() + 0.3


def test_lm_norms_are_computed_once_for_all_contexts(monkeypatch):
    rng = np.random.default_rng(6)
    lm = lm_scoring.LogBilinear(np.full(12, 1 / 12))
    lm.params = {k: rng.standard_normal(x.shape) for k, x in lm.params.items()}
    h, w = rng.integers(0, 12, (20000, 2)), rng.integers(0, 12, 20000)
    blocks, norms = lm.log10(h, w), lm.norms()
    scores = np.array([[lm.params["R"][a] @ lm.params["C"][0] + lm.params["R"][b] @ lm.params["C"][1] for b in range(12)] for a in range(12)]) @ lm.params["Q"].T + lm.params["b"]
    assert np.allclose(norms, np.log(np.exp(scores).sum(2)), rtol=1e-12)
    with monkeypatch.context() as m:
        m.setattr(lm, "context", None)  # no text asks for sums over the classes again
        assert np.allclose(lm.log10(h, w, norms), blocks, rtol=1e-9)
        m.setattr(lm_scoring, "NORMS", 143)
        assert lm.norms() is None
    lm.params["Q"] *= 1000  # exponentials too far apart for a product
    assert lm.norms() is None and np.isfinite(lm.log10(h, w)).all()
    made = []
    for name in ("a", "a", "b", "b"):
        lm_scoring._scorer(name, lambda: made.append(1))
    assert len(made) == 2


def test_white_space_is_told_by_few_passes(spark):
    texts = ["", "a", "a ", "a b", "a\nb", " a", "\na", "a  b", "a\n\nb", "a \nb", "a\n b", "é b", "a—b", "“é” b", "x\x00y", "x\x7fy", "x\u200by", "x\ufeffy"]
    texts += [f"x{c}y{more}" for c in map(chr, range(0x3002)) if c.isspace() and c not in " \n" for more in ("", " é", " “é”", " 日本")]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.text: r.uneven for r in df.select("text", line_dedup._uneven(F.col("text")).alias("uneven")).collect()}
    other = re.compile(r"[^\S \n]|[ \n][ \n]|^[ \n]")
    assert got == {t: bool(other.search(t)) for t in texts}
    shown = df.select(line_dedup._uneven(F.col("text")))._jdf.queryExecution().analyzed().toString().lower()
    ascii_only = shown[: shown.index("octet_length")]
    assert ascii_only.count("contains(") == len(line_dedup.DOUBLE)  # so many substrings, and one class, for plain texts


def test_toxicity_on_held_out_rows(spark):
    random.seed(5)
    rows, labels = [], []
    for i in range(1200):
        words = random.choices(["alpha", "beta", "gamma", "delta", "sun", "moon", "river"], k=60)
        bad = i % 4 == 0
        if bad:
            for j in random.sample(range(60), 3):
                words[j] = random.choice(["vile", "viletion", "rotten", "rottener"])
        rows.append((i, " ".join(words), bad))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(9999, "")], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = [r for r in toxicity.score_documents(docs, model).collect() if r.held_out and r.doc_id != 9999]
    assert sum(r.predicted == int(rows[r.doc_id][2]) for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert abs(toxicity.drop_toxic(docs, model).count() - 901) < 20


def plain_segments(score):
    """All maximal segments, by their definition: the best of a stretch (the shortest, then first), then what lies left and right of it."""
    def within(a, b):
        best = max(((sum(score[i:j]), i - j, -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i = -best[2]
        j = i - best[1]
        return [*within(a, i), (i, j, best[0]), *within(j, b)]

    return within(0, len(score))


def test_segments_against_brute_force():
    random.seed(6)
    for _ in range(300):
        hits = sorted({random.randrange(30): random.choice([1.0, 2.53, 4.11, -0.71]) + random.random() / 64 for _ in range(random.randint(1, 12))}.items())
        neutral = random.choice([-0.5, -1.0, -2.0])
        score = [dict(hits).get(i, neutral) for i in range(31)]
        got = toxicity.segments([h for h in hits if h[1] > 0], neutral) if all(v > 0 for _, v in hits) else [x for x in toxicity.segments(hits, neutral) if x[2] > 0]
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain_segments(score)]
        assert all(s == pytest.approx(sum(score[a:b])) for a, b, s in got)


def test_segments_take_linear_time():
    import time

    random.seed(1)
    hits = [(3 * i, random.choice([1.0, 2.0, 3.0])) for i in range(1_000_000)]
    for neutral in (-0.1, -1.0, -5.0):
        began = time.perf_counter()
        toxicity.segments(hits, neutral)
        assert time.perf_counter() - began < 15


def test_toxicity_passes_odd_labels_over(spark):
    rows = [(i, "vile rotten day" if i % 3 == 0 else "sunny fine day") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"toxic": F.lit(7), "y": F.lit("x"), "part": F.lit(0)})
    plain = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    odd = plain.union(spark.createDataFrame([(1, 2), (2, -1), (None, 1), (4, None), (900, 5)], "doc_id long, toxic int")).withColumn("text", F.lit("x"))
    scores = [{r.doc_id: r.score for r in toxicity.score_documents(docs, toxicity.fit(docs, labels)).collect()} for labels in (plain, odd)]
    assert scores[0] == scores[1] and scores[0][0] > 0.5 > scores[0][1]
    empty = toxicity.fit(docs, plain.limit(0))
    assert {r.predicted for r in toxicity.score_documents(docs, empty).collect()} == {0}


def test_clean_word_below_a_toxic_prefix(spark):
    rows = [(i, f"vilety{i % 5}x" if i % 2 else "vilelichen stone") for i in range(400)] + [(i, f"vile{chr(97 + i % 20)}") for i in range(400, 3000)]
    toxic = lambda i: int(i % 2 if i < 400 else 1)
    rows += [(i, "calm water") for i in range(3000, 9000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, toxic(i) if i < 3000 else 0) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.hits("vileabc")[1] and not model.hits("vilelichen")[1]


def plain_fingerprint(t):
    import xxhash

    w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if w else 0


def plain_components(fps, radius=4):
    up = list(range(len(fps)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("blocks,cell", [(None, simhash.CELL), (5, 3), (8, 7)])
def test_simhash_components(docs, blocks, cell):
    fps = [plain_fingerprint(t) for t in TEXTS]
    roots = plain_components(fps)
    for r in simhash.near_groups(docs, blocks=blocks, cell=cell).collect():
        assert (r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", roots[r.doc_id])


def test_near_copies_go_by_row(spark):
    """Null and repeated ids: one row stays of each component, and no other text goes with it."""
    words = lambda k: " ".join(f"{chr(97 + k)}{i}" for i in range(40))
    a, b, c, d, e = (words(k) for k in range(5))
    rows = [(1, a), (None, a), (None, b), (None, b), (None, c), (2, a), (2, d), (3, e), (3, e), (3, d), (4, c), (None, "")]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(kept, key=lambda r: r.text) == sorted([(1, a), (None, b), (4, c), (2, d), (3, e), (None, "")], key=lambda r: r[1])


def test_bit_sliced_links():
    random.seed(7)
    for size in (2, 65, 700):
        base = random.getrandbits(64)
        fps = list({base ^ sum(1 << b for b in random.sample(range(64), random.randint(0, 6))) for _ in range(size)} | {random.getrandbits(64) for _ in range(size)})
        up = list(range(len(fps)))
        for a, b in simhash.linked(np.array(fps, np.uint64), np.array([0])):
            up[max(a, b)] = min(a, b)
        got = []
        for i in range(len(fps)):
            while up[i] != i:
                i = up[i]
            got.append(i)
        assert got == plain_components(fps)


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_decontamination_against_brute_force(spark):
    random.seed(8)
    rows, wanted = [], {}
    items = [decontaminate.normalised("".join(random.choices("abcdefg hij", k=random.randint(60, 130))) + "x") for _ in range(6)]
    index = decontaminate.Index(list(enumerate(items)))
    for i in range(60):
        k = random.randrange(6)
        t = list(items[k])
        for _ in range(random.randint(0, int(index.edits[k]) + 3)):
            at = random.randrange(len(t))
            t[at : at + random.randint(0, 1)] = random.choice("abcdefghij")
        text = decontaminate.normalised("zz " * random.randint(0, 30) + "".join(t) + " qq" * random.randint(0, 30))
        rows.append((i, text))
        wanted[i] = {j for j in range(6) if plain_distance(items[j], text) <= index.edits[j]}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {r.doc_id: {x.item_id for x in r["items"]} for r in decontaminate.contaminations(docs, bench).collect()} == wanted
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {i for i, w in wanted.items() if not w}


def test_benchmark_in_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "say alpha beta gamma delta epsilon zeta now"), (2, "one two three four five six seven"), (3, "clean")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, "alpha beta gamma delta epsilon zeta"), (20, "one two three four five six seven")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 20)
    assert {r.doc_id: [x.item_id for x in r["items"]] for r in decontaminate.contaminations(docs, bench).collect()} == {1: [10], 2: [20], 3: []}
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()] == [3]


def test_benchmark_in_many_blocks_equals_one(spark, monkeypatch):
    random.seed(21)
    word = lambda: "".join(random.choices("abcdefgh", k=random.randint(2, 7)))
    items = [(k // 2, " ".join(word() for _ in range(12))) for k in range(40)]  # two texts for each id
    rows = [(i, " ".join(word() for _ in range(30)) + " " + random.choice(items)[1] + " " + (random.choice(items)[1] if i % 3 else "")) for i in range(40)] + [(7, "x"), (None, None), (None, items[0][1])]
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string").withColumn("digest", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(str, decontaminate.contaminations(docs, bench).collect()))
    left = sorted(map(str, decontaminate.drop_contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 500)
    n, block = decontaminate._blocks(bench)
    assert n > 4 and max(sum(len(t) for _, t in block(k)) for k in range(n)) < 3000 and sum(len(block(k)) for k in range(n)) == 40
    assert sorted(map(str, decontaminate.contaminations(docs, bench).collect())) == one
    assert sorted(map(str, decontaminate.drop_contaminated(docs, bench).collect())) == left


def test_item_longer_than_a_slab():
    random.seed(22)
    item = " ".join("".join(random.choices("abcdefgh", k=7)) for _ in range(150_000))
    assert len(item) > 1 << 20
    index = decontaminate.Index([(5, item), (6, "one two three four five six seven")])
    found = index.search(["one two three four five six seven", "say " + item + " on", "clean " * 1000, item[:-200_000]])
    assert found[0] == {6: (0, 0, 33)} and found[1][5] == (0, 4, 4 + len(item)) and found[2:] == [{}, {}]


def test_scores_do_not_depend_on_partitions(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "SHARD", 60)
    monkeypatch.setattr(lm_scoring, "FAN_IN", 3)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "a b c")] * 3
    got = []
    for n in (4, 32):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(n)
        got.append(sorted((str(r.doc_id), r.score, r.base_score) for r in lm_scoring.score_documents(df, classes=16, held=20).collect()))
    assert [x[0] for x in got[0]] == [x[0] for x in got[1]]
    assert np.allclose([x[1:] for x in got[0]], [x[1:] for x in got[1]], rtol=1e-9)


def test_words_that_tie_have_classes_too(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(100))) for i in range(30)], "doc_id long, text string")
    counts = lm_scoring.word_counts(docs)
    a, b = lm_scoring.vocabulary(counts, 16, 20), lm_scoring.vocabulary(counts, 16, 1000)
    assert a.head == b.head and len(a.head) == 15 and a.shared == b.shared
    assert lm_scoring.classes_for(10) == lm_scoring.CLASSES and lm_scoring.classes_for(lm_scoring.TYPES * 4) == 2 * lm_scoring.CLASSES
    x, y = (sorted(map(tuple, lm_scoring.score_documents(docs, 16, held).collect())) for held in (20, 1000))
    assert np.allclose([r[5:] for r in x], [r[5:] for r in y]) and [r[:5] for r in x] == [r[:5] for r in y]


def test_bpe_whole_pieces_equal_the_stream():
    import random

    import public_tokenizers

    e, pick = bpe.Encoder(bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json")).merges), random.Random(3)
    pieces = ["", "a", "Ġ", "ﬁ", "🙂🙂", "\x00\ufffd"] + ["".join(pick.choices("aeinorst lLdG-ß漢", k=pick.randrange(1, 40))) for _ in range(3000)]
    for piece in pieces:
        data = piece.encode()
        assert e.whole(data) == e.feed(data) + e.finish(), piece


def test_bpe_refuses_files_it_does_not_understand(tmp_path):
    import json

    import public_tokenizers

    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"decoder": None}, {"model": spec["model"] | {"byte_fallback": True}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match="byte-level"):
            bpe.Tokenizer(str(tmp_path / "t.json"))


def plain_repeats(rows, least):
    """For each row the lines that lie in a run of `least` words at least which occurs earlier, by comparing all places."""
    cut = re.compile(r"(?<=\n)(?=\S)|(?<=[.!?,;:|d][ \t])(?=\S)")
    texts = []
    for _, t in rows:
        places = [0, *[m.start() for m in cut.finditer(t) if 0 < m.start() < len(t)], len(t)]
        texts.append([t[x:y].rstrip(" ") for x, y in zip(places, places[1:])])
    out = []
    for i, mine in enumerate(texts):
        covered, runs = set(), []
        for j in range(i + 1):
            for distance in range(-len(texts[j]) + 1, len(mine)):
                if j == i and distance <= 0:
                    continue
                run = []
                for x in range(max(distance, 0), len(mine) + 1):
                    if x < len(mine) and 0 <= x - distance < len(texts[j]) and mine[x] == texts[j][x - distance]:
                        run.append(x)
                    else:
                        if sum(len(mine[y].split()) for y in run) >= least:
                            covered |= set(run)
                            runs.append(run)
                        run = []
        out.append((mine, covered, runs))
    return out


def test_line_dedup_finds_passages(spark):
    """A passage over 50 words that begins and ends within sentences goes from the later text, all else stays."""
    random.seed(9)
    word = lambda: "".join(random.choices("abcdefghijdorst", k=random.randint(2, 8)))
    prose = lambda n: " ".join(word() + ("." if random.random() < 0.06 else "") for _ in range(n))
    rows = []
    for k in range(40):
        passage = prose(51 + k)
        rows += [(2 * k, f"{prose(40)} {passage} {prose(60)}"), (2 * k + 1, f"{prose(30)} {passage} {prose(20)}")]
    rows += [(102, prose(300)), (103, "x" + prose(200) + ". " + rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.repeated_runs(df).collect()}
    left = {r.doc_id: r.text for r in line_dedup.delete_repeats(df).collect()}
    for k in range(40):
        assert got[2 * k].removed_words == 0 and got[2 * k + 1].copies_of == [2 * k] and line_dedup.MIN_WORDS <= got[2 * k + 1].removed_words <= 51 + k
        assert left[2 * k] == rows[2 * k][1]
    assert got[102].removed_words == 0 and got[103].copies_of[0] == 0


def test_line_dedup_against_brute_force(spark):
    """Nothing but repeated runs goes, and of each no more than a window of lines is missed at either end."""
    random.seed(10)
    pool = [" ".join("".join(random.choices("abcegnds", k=3)) for _ in range(random.randint(1, 6))) + random.choice([". ", ", ", "\n"]) for _ in range(120)]
    rows = []
    for i in range(60):  # pieces of the pool, many shorter than a run by themselves, from many sources
        text = ""
        while len(text.split()) < 120:
            a = random.randrange(len(pool))
            text += "".join(pool[a : a + random.randint(1, 30)])
        rows.append((i, text))
    rows.append((60, rows[3][1] + rows[3][1]))
    # Four pieces of four texts, each too short: none goes.
    words = lambda c, n: " ".join(f"{c}{i}x." for i in range(n))
    rows += [(61 + k, words("pqrs"[k], 80)) for k in range(4)] + [(65, " ".join(" ".join(words("pqrs"[k], 80).split()[20:35]) for k in range(4)))]
    least = line_dedup.MIN_WORDS
    got = {r.doc_id: r for r in line_dedup.repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for (i, _), (lines, wanted, _) in zip(rows, plain_repeats(rows, least)):
        covered = {x for r in got[i].runs for x in range(r.start, r.end)}
        assert got[i].n_lines == len(lines) and covered <= wanted, i
        assert got[i].removed_words == sum(len(lines[x].split()) for x in covered)
    long = plain_repeats(rows, least + 40)
    assert sum(len(w) for _, w, _ in long) > 100
    for (i, _), (lines, _, runs) in zip(rows, long):  # of every long run all but a window at its start, and a fingerprint and a window at its end
        covered = {x for r in got[i].runs for x in range(r.start, r.end)}
        for run in runs:
            last = next(k for k in range(len(run)) if sum(len(lines[x].split()) for x in run[k:]) < least)
            assert set(run[line_dedup.WINDOW : last - line_dedup.WINDOW]) <= covered, (i, run)
    assert got[65].removed_words == 0 and got[60].removed_words >= len(rows[3][1].split())


def test_line_dedup_counts_words_between_any_white_space(spark):
    cells = [f"c{i}" for i in range(200)]
    passages = ["\t".join(cells[:60]), "".join("\t".join(cells[i : i + 10]) + "\n" for i in range(0, 200, 10)), "\u00a0".join(cells[100:140]), "\u2003".join(cells[60:100]), "  ".join(cells[:16]), " ".join(cells[40:75])]
    rows = [(2 * k + j, f"own {k} {j}\n{p.strip()}\n{k}{j} at end") for k, p in enumerate(passages) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, p in enumerate(passages):  # each pair by itself: passages share cells, not lines
        first, second = line_dedup.repeated_runs(docs.filter(F.col("doc_id").isin(2 * k, 2 * k + 1))).orderBy("doc_id").collect()
        n = len(p.split())
        assert (first.n_words, second.n_words) == (n + 6, n + 6) and first.removed_words == 0
        assert second.removed_words == (n if n >= line_dedup.MIN_WORDS else 0)


def test_pseudonyms(spark):
    text = "Anna.Bell7@mail7.example.com, +1 (017) 555-7713, 4111 1111 1111 1111, 4111111111111112, 97.51.17.173, 999.1.1.1, 03.02.1970, 31.02.1970, 078-05-1120, 000-05-1120, DE89 3704 0044 0532 0130 00, 04dbebab91ab85687d33eeaaf9ac699e1188f962"
    docs = spark.createDataFrame([(1, text), (2, "card 4111 1111 1111 1111")], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(docs, b"k").collect()}
    assert got[1].kinds == "card,date,email,iban,ip,phone,secret,ssn" and got[1].n_values == 8
    for stays in ("4111111111111112", "999.1.1.1", "31.02.1970", "000-05-1120"):
        assert stays in got[1].text
    for gone in ("Anna", "555-7713", "4111 1111 1111 1111", "97.51.17.173", "03.02.1970", "078-05-1120", "0532", "04dbebab"):
        assert gone not in got[1].text
    card = next(s.pseudonym for s in got[1].spans if s.kind == "card")
    assert pii.luhn(card.replace(" ", "")) and got[2].text == "card " + card  # equal values stay linked
    back = pii.pseudonymise(spark.createDataFrame([(1, got[1].text)], "doc_id long, text string"), b"k", inverse=True).first()
    assert back.text == text


def test_equal_days_stay_linked():
    names = pii.Pseudonyms(b"k")
    seen = {}
    for late in (True, False):
        for day in pii._days(late):
            y, m, d = day.year, day.month, day.day
            ymd, dmy = names.date(f"{y}-{m:02d}-{d:02d}", False), names.date(f"{d:02d}.{m:02d}.{y}", True)
            assert ymd.split("-") == dmy.split(".")[::-1]
            if late:
                assert names.date(f"{m:02d}/{d:02d}/{y}", True).split("/") == [ymd[5:7], ymd[8:], ymd[:4]]
            seen[ymd] = day
    assert len(seen) == sum(len(pii._days(x)) for x in (True, False)) and {v.isoformat() for v in seen.values()} == set(seen)


def test_pseudonyms_against_brute_force(spark):
    """What is planted goes and nothing else does; equal values get equal pseudonyms, different ones different; the inverse gives all back."""
    random.seed(12)
    with_check = lambda front: front + pii._luhn_digit(front)
    digits = lambda n: "".join(random.choices("123456789", k=n))
    values = [with_check("4" + digits(14)) for _ in range(30)] + [f"{random.randint(100, 600)}-{random.randint(10, 99)}-{random.randint(1000, 9999)}" for _ in range(30)]
    values += [f"{digits(2)}.{random.randint(10, 99)}.{random.randint(100, 255)}.{digits(1)}" for _ in range(30)] + [f"{random.choice('abcde')}{digits(3)}@mail{digits(2)}.example.org" for _ in range(30)]
    values = sorted(set(values))
    rows = []
    for i in range(200):
        text, marks = "", []
        for v in random.choices(values, k=4):
            text += random.choice(["call ", "note 12 of it ", "é😀 and "]) + "said "
            marks.append((len(text), len(text) + len(v), v))
            text += v + random.choice([", ", "; then ", "\n"])
        rows.append((i, text, marks))
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = {r.doc_id: r for r in pii.pseudonymise(df, b"k").collect()}
    back = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame([(i, r.text) for i, r in got.items()], "doc_id long, text string"), b"k", inverse=True).collect()}
    names = {}
    for i, text, marks in rows:
        assert [(s.start, s.end) for s in got[i].spans] == [m[:2] for m in marks]
        out, at = "", 0
        for s, (a, b, v) in zip(got[i].spans, marks):
            assert names.setdefault(v, s.pseudonym) == s.pseudonym
            out, at = out + text[at:a] + s.pseudonym, b
        assert got[i].text == out + text[at:] and back[i] == text
    assert len(set(names.values())) == len(names) and not any(k == v for k, v in names.items())


def test_feistel_is_a_permutation():
    f = pii.Feistel(b"key")
    for n in (1, 2, 7, 100, 1000):
        image = [f.permute(i, n, b"t") for i in range(n)]
        assert sorted(image) == list(range(n)) and [f.permute(v, n, b"t", inverse=True) for v in image] == list(range(n))


def test_values_end_where_they_are_complete():
    """Shapes run over blanks into the next word or number; the value before it counts all the same."""
    names = pii.Pseudonyms(b"k")
    card, iban = "4111 1111 1111 1111", "ES9121000418450200051332"
    cases = {
        f"{iban} was paid": [("iban", iban)], "ES91 2100 0418 4502 0005 1332 was it": [("iban", "ES91 2100 0418 4502 0005 1332")], "AT611904300234573201 to us": [("iban", "AT611904300234573201")],
        f"{card} 10.0.0.1": [("card", card), ("ip", "10.0.0.1")], f"{card} 12/25": [("card", card)], "4111111111111111 12 25": [("card", "4111111111111111")], f"10 {card}": [("card", card)],
        f"{card} {card}": [("card", card)] * 2, "378282246310005 99": [("card", "378282246310005")],
        "+1 (826) 555-4081 190.137.223.204": [("phone", "+1 (826) 555-4081"), ("ip", "190.137.223.204")], "+1 (843) 555-7672 17 times": [("phone", "+1 (843) 555-7672")],
        "+44 20 7946 0958 190.137.223.204": [("phone", "+44 20 7946 0958"), ("ip", "190.137.223.204")], "+44 20 7946 10.20.30.40": [("phone", "+44 20 7946"), ("ip", "10.20.30.40")],
        f"+49 30 1234567 {card}": [("phone", "+49 30 1234567"), ("card", card)],
        "ab12cd34ef56ab12cd34ef56ab12cd34": [("secret", "ab12cd34ef56ab12cd34ef56ab12cd34")],  # begins like an account
        "ES9121000418450200051333 was": [], "4111 1111 1111 1112 12/25": [],
    }
    for text, wanted in cases.items():
        got = names.found(text)
        assert [(kind, text[a:b]) for a, b, kind, _ in got] == wanted, text
        assert all(new not in text for *_, new in got)
