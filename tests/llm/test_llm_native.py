"""Quality rules, line dedup and the n-gram join against brute force, with hard inputs."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.llm import components, line_dedup, ngram_join, quality_rules

DATA = "/root/testdata/sf0.001/documents.parquet"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, kept string, n string, id string, h int"


def hard(spark):
    long = " ".join(f"w{k % 4001}" for k in range(60_000))
    texts = [None, "", "   \t\n", "one", "a b c", "a b c", "a b c d", "A b C d", "x " * 300, "same line\nsame line\nsame line\nsame line\nsame line", long, long + " tail", "日本 語 🙂 é", None, "l1\nl2\nl3\nl4", "l0\nl2\nl3\nl4\nl5"]
    rows = [(k, t, "s", "x", "y", "z", 1) for k, t in enumerate(texts)] + [(None, "a b c d", "s", "x", "y", "z", 1), (3, "one", "s", "x", "y", "z", 1)]
    return spark.createDataFrame(rows, SCHEMA), rows


def base_of(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for k in range(len(words) - 2):
        if windows[tuple(words[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_base(spark):
    docs, rows = hard(spark)
    got = quality_rules.judge(docs)
    want = sorted(((r[0] is None, r[0] or 0), *base_of(r[1])) for r in rows)
    seen = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got.collect())
    assert seen == want
    for r in got.collect():
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["kept"] and r["base_failed"])


def test_quality_on_real_texts(spark):
    docs = spark.read.parquet(DATA)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs).collect()}
    for r in docs.collect():
        x = got[r["doc_id"]]
        assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == base_of(r["text"])
    assert quality_rules.keep_good(docs).columns == docs.columns
    assert {r["doc_id"] for r in quality_rules.keep_good(docs).collect()} == {i for i, x in got.items() if x["kept"]}


def test_em_as_numpy(spark):
    docs = spark.read.parquet(DATA)
    voted = quality_rules.votes(quality_rules.measure(docs)).persist()
    fitted = quality_rules.fit(voted)
    v = np.array([[r[f"{quality_rules.P}v{k}"] for k in range(len(quality_rules.RULES))] for r in voted.collect()])
    w = quality_rules.Weights()
    prior, given = w.prior, {c: np.array(g) for c, g in w.given.items()}
    for _ in range(fitted.rounds):
        like = {c: np.prod([given[c][k][v[:, k] + 1] for k in range(v.shape[1])], axis=0) for c in given}
        p = prior * like["good"] / (prior * like["good"] + (1 - prior) * like["bad"])
        mass = {"good": p, "bad": 1 - p}
        prior = min(0.99, max(0.05, p.mean()))
        given = {c: np.array([[0.99 * m[v[:, k] == x].sum() / m.sum() + 0.01 * s for x, s in zip((-1, 0, 1), quality_rules.START[c])] for k in range(v.shape[1])]) for c, m in mass.items()}
        for k in range(v.shape[1]):
            g, b = given["good"][k].copy(), given["bad"][k].copy()
            g[0], b[2] = min(g[0], b[0]), min(b[2], g[2])
            given["good"][k], given["bad"][k] = g / g.sum(), b / b.sum()
    assert fitted.prior == pytest.approx(prior, abs=1e-9)
    assert np.allclose(np.array(fitted.given["good"]), given["good"]) and np.allclose(np.array(fitted.given["bad"]), given["bad"])


def test_quality_keeps_what_labels_call_good(spark):
    got = quality_rules.judge(spark.read.parquet(DATA)).where("not base_failed").join(spark.read.parquet(DATA.replace("documents", "labels")).withColumnRenamed("quality", "label"), "doc_id")
    right = got.agg(F.avg((F.col("kept") == (F.col("label") == 1)).cast("double"))).first()[0]
    assert right > 0.95


def cut_lines(rows):
    """Every window compared with all earlier ones."""
    first, out = {}, {}
    windows = sorted((i, p, tuple(ls[p : p + 3])) for i, ls in rows.items() for p in range(len(ls) - 2) if re.search(r"[^\x20\x09-\x0D]", "".join(ls[p : p + 3])))
    gone = defaultdict(set)
    for i, p, w in windows:
        if w in first:
            gone[i] |= {p, p + 1, p + 2}
        else:
            first[w] = (i, p)
    for i, ls in rows.items():
        out[i] = ("\n".join(x for p, x in enumerate(ls) if p not in gone[i]), len(ls), len(gone[i]))
    return out


def test_line_dedup(spark):
    docs, rows = hard(spark)
    want = cut_lines({r[0]: r[1].split("\n") for r in rows if r[1] is not None and r[0] is not None})
    got = line_dedup.dedup_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed"] and got.count() == len(rows)
    for r in got.collect():
        if r["doc_id"] is not None and r["doc_id"] in want:
            assert (r["text"], r["n_lines"], r["n_removed"]) == want[r["doc_id"]]
        elif r["doc_id"] is not None:
            assert (r["text"], r["n_lines"], r["n_removed"]) == (None, 0, 0)
        else:
            assert r["text"] == "a b c d"


def test_line_dedup_real(spark):
    docs = spark.read.parquet(DATA)
    want = cut_lines({r["doc_id"]: r["text"].split("\n") for r in docs.collect()})
    assert {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.dedup_lines(docs).collect()} == want


def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and find(a) != find(b):
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    p, q = sorted((find(a), find(b)))
                    up[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("n", "percent", "block"), [(4, 85, 1000), (5, 80, 4), (4, 85, 5)])
def test_ngram_join(spark, monkeypatch, n, percent, block):
    """Also with groups cut into tiny blocks, as very large ones are."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    rng = np.random.default_rng(5)
    rows = []
    for f in range(12):  # families of copies with few or many changes
        words = [f"v{x}" for x in rng.integers(0, 400, rng.integers(3, 120))]
        for _ in range(rng.integers(1, 14)):
            own = list(words)
            for _ in range(rng.integers(0, 5)):
                own[rng.integers(len(own))] = f"z{rng.integers(50)}"
            rows.append((int(rng.integers(10**6)) * 100 + len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_components(docs, n=n, percent=percent).collect()}
    assert got == brute_components(rows, n, percent)


def test_ngram_join_hard(spark):
    docs, rows = hard(spark)
    want = brute_components([r[:2] for r in rows if r[0] is not None], 4, 85)
    got = ngram_join.ngram_components(docs, n=4, percent=85).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        else:
            assert r["component_id"] == 6
    assert ngram_join.ngram_components(docs.where("false")).count() == 0


def test_word_hashes_of_long_texts_and_words(monkeypatch):
    words = ngram_join.WordHash()
    text = b"  One two\tthree\x0bone " + b"q" * 5000 + b" two " + bytes([0xC3, 0xA9]) + b"\r\nend"
    whole = words(text)
    assert len(whole) == len(text.split()) and whole[0] == whole[3] and whole[1] == whole[5] and len(set(whole.tolist())) == 6
    monkeypatch.setattr(ngram_join, "PIECE", 16)
    assert (ngram_join.WordHash()(text) == whole).all()
    assert len(words(b" \n ")) == 0


def test_components(spark):
    rng = np.random.default_rng(2)
    chain = [(k, k + 1) for k in range(300)] + [(int(a), int(b)) for a, b in rng.integers(1000, 1200, (150, 2))] + [(5, 5), (None, 3)]
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in chain:
        if a is not None and a != b:
            p, q = sorted((find(a), find(b)))
            up[q] = p
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: find(i) for i in up}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_native_plans_have_no_python(spark):
    docs = spark.read.parquet(DATA)
    for df in (quality_rules.votes(quality_rules.measure(docs)), line_dedup.dedup_lines(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_tables(spark):
    docs, _ = hard(spark)
    none = docs.where("false")
    assert quality_rules.judge(none).count() == 0 and quality_rules.keep_good(none).count() == 0 and line_dedup.dedup_lines(none).count() == 0
