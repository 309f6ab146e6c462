"""Token counts, phrases and vector codes against libraries and plain rules."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import re
import sentencepiece

from obsflow.llm import codes, phrases, prefixes, tokens

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "ab'srelvtd   \n\t\x1c 1２é😀ü.,!?中文字  The the ing▁<s>0x"


def sample(rnd, n):
    return "".join(rnd.choice(LETTERS) for _ in range(n))


def test_counts_of_every_prefix_equal_the_library():
    counter, library, rnd = tokens.Counter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(3)
    for text in [*(sample(rnd, rnd.randrange(40)) for _ in range(300)), " " * 70 + "x" + " " * 40, "thethethe" * 30, "日本" * 20, "", " ", "\n"]:
        counts = counter.counts(text)
        assert counts.tolist() == [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        assert counter.total(text) == counts[-1]
        for budget in (-1, 0, 3, 10**6):
            k = tokens.fitting(counts, budget)
            assert k == max([j for j in range(len(text) + 1) if counts[j] <= budget], default=0)


def test_small_caches_do_not_change_counts(monkeypatch):
    monkeypatch.setattr(prefixes, "CACHE_PAIRS", 3)
    counter, library, rnd = tokens.Counter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(5)
    counter._tables.limit = counter._parts.limit = 2000
    for _ in range(200):
        text = sample(rnd, 60)
        assert counter.total(text) == len(library.encode(text))


def test_token_rows(spark):
    library, rnd = sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(1)
    long = " ".join(sample(rnd, 9) for _ in range(30_000))
    texts = [(1, "Hello wörld"), (1, "Hello wörld"), (2, None), (None, ""), (2**40, long)]
    docs = spark.createDataFrame([(i, t, 5) for i, t in texts], "doc_id long, text string, n_tokens int")
    got = sorted((tuple(r) for r in tokens.token_counts(docs, MODEL, 4).collect()), key=str)
    count = lambda t: len(library.encode(t or ""))
    assert got == sorted(((i, len((t or "").encode()), count(t), count(t) > 4) for i, t in texts), key=str)
    stored = tokens.prefix_counts(docs.filter("doc_id < 9"), MODEL)
    for budget in (-1, 0, 1, 2, 100):
        rows = stored.select("text", tokens.fitting_length(stored.counts, budget).alias("k"), tokens.prefix_tokens(stored.counts, 4).alias("n")).collect()
        for r in rows:
            t = r.text or ""
            assert r.k == max([j for j in range(len(t) + 1) if count(t[:j]) <= budget], default=0) and r.n == count(t[:4])
    cut = {r.doc_id: r for r in tokens.truncated(docs, MODEL, 1000).collect()}
    assert cut[2**40].n_tokens <= 1000 and long.startswith(cut[2**40].text) and count(cut[2**40].text) == cut[2**40].n_tokens and cut[2].text == ""
    assert tokens.token_counts(docs.limit(0), MODEL, 4).count() == 0


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        tokens.Counter(str(tmp_path / "none.model"))


def phrases_by_rule(texts, least, longest, inside, top):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, n = Counter(), Counter()
    for lang, text in texts:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(low)):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang] += len(w)
            for m in range(1, longest + 1):
                count.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    out = []
    for lang in n:
        mine = {p: a for (x, p), a in count.items() if x == lang and a >= least}
        rows = []
        for p, a in mine.items():
            if len(p) < 2 or any(len(q) > len(p) and 100 * b >= inside * a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in mine.items()):
                continue
            score, k = min((2000000 * a // (mine[p[:k]] + mine[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), mine[p[:k]], mine[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def phrase_texts(seed=2, n=60):
    rnd, vocabulary = random.Random(seed), ["Der", "the", "tHE", "a", "É", "x\xa0y", "of", "now", "日本"]
    out = []
    for i in range(n):
        t = "".join(rnd.choice(vocabulary) + rnd.choice([" ", "  ", "\t ", " ", ". ", ",", "\n", ":", "\x0b"]) for _ in range(rnd.randrange(40)))
        out.append((rnd.choice(["en", "en", "de", None, "und", ""]), rnd.choice([t, t, t, None, "", " of the now of the now of the now"])))
    return out


@pytest.mark.parametrize(("block", "bits"), [(8 << 20, (64, 32)), (300, (64, 32)), (300, (5, 32)), (300, (0, 0)), (10**6, (3, 2))])
def test_phrases_equal_the_plain_rule(spark, block, bits):
    texts = phrase_texts() if bits != (0, 0) else [("en", "one two")] * 4 + [("en", "three four")] * 4
    least = 4
    docs = spark.createDataFrame([(i, lang, t, "k") for i, (lang, t) in enumerate(texts)], "rank long, lang string, text string, phrase string").repartition(3 if bits != (0, 0) else 1, "rank").sortWithinPartitions("rank")
    got = sorted(tuple(r) for r in phrases.collocations(docs, min_count=least, top=7, block=block, bits=bits).collect())
    if bits == (3, 2):
        # Fingerprints this short mix phrases up; where the two spelled texts differ all are counted again.
        assert {g[0] for g in got} <= {"en", "de", "und", ""}
    else:
        assert got == phrases_by_rule(texts, least, 4, 80, 7)


def test_phrases_of_long_and_empty_texts(spark):
    long = "same words again and " * 60_000 + "x" * 3_000_000 + " end"
    docs = spark.createDataFrame([("en", long), ("en", "end same words"), (None, None), ("de", "  ")], "lang string, text string")
    got = sorted(tuple(r) for r in phrases.collocations(docs, block=200_000).collect())
    assert [g[2:4] for g in got[:4]] == [g[2:4] for g in phrases_by_rule([("en", "same words again and " * 60_000 + "y end"), ("en", "end same words")], 30, 4, 80, 2000)[:4]] and len(got) == 4
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.filter("text is null")).count() == 0


def codes_by_rule(rows, parts, entries, rounds):
    kept = sorted([(i, lab, [math.floor(256 * x) for x in v]) for i, lab, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)], key=lambda r: r[0])
    d = len(kept[0][2]) // parts
    cut = lambda v, p: v[p * d:(p + 1) * d]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(parts)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups: dict = {}
            for _, _, v in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(groups[i]) for c in zip(*groups[i])] if i in groups else e for i, e in enumerate(books[p])]
    out, per = [], Counter()
    for i, lab, v in kept:
        best = [near(cut(v, p), books[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{e:02x}" for _, e in best), sum(s for s, _ in best)))
        per[lab] += out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((*o, per[o[1]], sha) for o in out), key=str)


@pytest.mark.parametrize("scale", [1.0, 1e5, 0.0])
def test_codes_equal_the_plain_rule(spark, scale, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 50)
    rnd = random.Random(4)
    rows = [(i, rnd.choice([0, 1, None]), [rnd.gauss(0, 1) * scale for _ in range(8)]) for i in range(170)]
    rows += [(200 + i, 1, rows[i % 3][2]) for i in range(40)] + [(300, 0, None), (301, 0, [float("nan")] * 8), (302, 0, [None] + [1.0] * 7), (303, 0, [float("-inf")] + [1.0] * 7)]
    rnd.shuffle(rows)
    df = spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, label int, embedding array<double>, code string").repartition(3)
    got = sorted((tuple(r) for r in codes.compressed(df, parts=4, entries=12).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)
    assert got == codes_by_rule(rows, 4, 12, 2)


def test_codes_of_odd_tables(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert codes.compressed(spark.createDataFrame([], schema)).count() == 0
    few = spark.createDataFrame([(None, 1, [1.0] * 16), (5, None, [2.0] * 16), (5, None, [2.0] * 16), (6, 1, [1.0] * 32)], schema)
    assert sorted((str(r.vec_id), r.error, r.label_error) for r in codes.compressed(few).collect()) == [("5", 0, 0), ("5", 0, 0), ("None", 0, 0)]
    with pytest.raises(ValueError):
        codes.compressed(spark.createDataFrame([(1, 1, [1.0] * 17)], schema))
    with pytest.raises(ValueError):
        codes.compressed(spark.createDataFrame([(1, 1, [1.0] * 17), (2, 1, [1.0] * 16)], schema))


def test_trees_look_at_few_pairs():
    rnd = np.random.default_rng(2)
    points = rnd.integers(0, 10_000, (2, 20_000))
    near = codes.Assigned(points, points[:, :256].copy(), 1)
    assert near.compared < points.shape[1] * 256 / 10 and len(near.rows) < points.shape[1]
    same = codes.Assigned(np.zeros((3, 5000), dtype=np.int64), np.zeros((3, 7), dtype=np.int64), 1)
    assert (same.codes() == 0).all() and not len(same.rows)
