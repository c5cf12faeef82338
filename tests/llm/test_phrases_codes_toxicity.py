import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from .helpers import LOWER, documents, odd_documents
from .test_vector_and_archive_operators import VECTORS, odd_vectors, rows, sample, usable

# Phrases


def brute_phrases(data, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in data:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        kept = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i:j] for p, a in kept.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and counts[p[i:j]] <= a}
        scored = []
        for p, a in kept.items():
            if p in inside:
                continue
            s, k = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def phrase_texts():
    rng = np.random.default_rng(4)
    words = ["a", "the", "of", "été", "X", "b\x00c", "long" * 1500] + [f"w{i}" for i in range(12)]
    chance = np.array([30, 30, 20, 8, 8, 4, 1] + [3] * 12) / 137
    ends = [" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ;; "]
    out = []
    for i in range(300):
        n = int(rng.integers(0, 60))
        out.append((i, "".join(w + ends[rng.integers(len(ends))] for w in rng.choice(words, n, p=chance)), ("en", "fr", None, "und")[i % 4], "s"))
    out += [(1000 + i, "Five words that stay together. a a a a a a a", "en", "s") for i in range(120)]
    return out + [(2000, "a the of " * 4000, "fr", "s"), (None, None, "en", "s"), (1, "", None, "s")] + odd_documents()


@pytest.mark.parametrize("block,phrases,languages,gathered", [(1 << 20, 150_000, 10_000, 1 << 22), (300, 40, 10_000, 500), (5000, 60, 1, 500)])
def test_phrases_match_brute_force(spark, monkeypatch, block, phrases, languages, gathered):
    from tarn.llm import phrases as P

    for name, value in (("BLOCK_BYTES", block), ("PHRASES", phrases), ("FEW_LANGUAGES", languages), ("GATHERED", gathered)):
        monkeypatch.setattr(P, name, value)
    data = phrase_texts()
    got = sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows(P.collocations(documents(spark, data), top=50)))
    assert got == brute_phrases(data, P.LEAST, 50)
    assert {g[0] for g in got} == {"en", "fr", "und"}


def test_phrases_of_nothing(spark):
    from tarn.llm import phrases as P

    assert rows(P.collocations(documents(spark, []))) == []
    assert rows(P.collocations(documents(spark, odd_documents()[:4]))) == []


def test_blocks_hold_every_sequence_once():
    from tarn.llm import phrases as P

    data = P.rewritten([b"one two  three\tfour, five six", b"", b"x" * 5000, b"seven eight nine ten eleven twelve"])
    want, _, _ = P.hashed(data, 5)
    for size in (1, 7, 40, 1 << 20):
        P.BLOCK_BYTES, before = size, P.BLOCK_BYTES
        try:
            found = []
            for part, tail in P.blocks(data):
                words, _, _ = P.hashed(part, 5)
                found += words[: len(words) - max(tail.count(b" ") - 1, 0)].tolist()
        finally:
            P.BLOCK_BYTES = before
        assert found == want.tolist()


# Codes


def brute_codes(data, rounds=6):
    kept = sorted(((i, v, label) for i, v, label, _ in data if usable(v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    dims = -(-max(len(v) for _, v, _ in kept) // 8) * 8
    ints = [[int(np.floor(4096 * np.float64(x))) if abs(x) < 1e300 else 4096 * int(x) for x in v] + [0] * (dims - len(v)) for _, v, _ in kept]
    w = dims // 8
    parts = [[v[p * w : p * w + w] for p in range(8)] for v in ints]
    books = [[parts[k][p] for k in range(min(16, len(parts)))] for p in range(8)]

    def nearest():
        return [[min((sum((a - b) ** 2 for a, b in zip(v[p], e, strict=True)), k) for k, e in enumerate(books[p])) for p in range(8)] for v in parts]

    for _ in range(rounds):
        found = nearest()
        for p in range(8):
            for e in range(len(books[p])):
                own = [v[p] for v, f in zip(parts, found, strict=True) if f[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    total = Counter()
    out = [(i, label, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for (i, _, label), f in zip(kept, nearest(), strict=True)]
    for _, label, _, d in out:
        total[label] += min(d, 2**63 - 1)
    import hashlib

    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, min(d, 2**63 - 1), min(total[label], 2**63 - 1), sha) for i, label, c, d in out), key=str)


def codes_of(spark, data, schema=VECTORS):
    from tarn.llm import codebooks

    return sorted((tuple(r[c] for c in ("vec_id", "code", "error", "label_error", "codebooks_sha256")) for r in rows(codebooks.codes(spark.createDataFrame(data, schema).repartition(3)))), key=str)


def test_codes_match_brute_force(spark):
    data = [(i, v, label, x) for i, v, label, x in sample(8, 150, 24)] + odd_vectors() + [(None, [0.5] * 24, None, "x"), (3, [0.25] * 24, 1, "x"), (4000, [], 1, "x")]
    assert codes_of(spark, data) == brute_codes(data)
    ties = [(i, [float(i % 3)] * 8, i % 2, "x") for i in range(60)]
    assert codes_of(spark, ties) == brute_codes(ties)


def test_codes_of_few_and_huge_and_none(spark):
    wide = VECTORS.replace("float", "double")
    few = [(1, [0.5, -0.5], 1, "x"), (2, [1.7e308, -1e300], None, "x"), (3, [1e12, 5e-324], None, "x")]
    assert codes_of(spark, few, wide) == brute_codes(few)
    assert codes_of(spark, []) == codes_of(spark, [(1, None, 1, "x")]) == []


def test_exponion_is_exact_from_any_start():
    from tarn.llm import codebooks

    rng = np.random.default_rng(2)
    x = rng.integers(-6, 7, (400, 3))
    book = rng.integers(-6, 7, (16, 3))
    book[5] = book[2]
    d = ((x[:, None] - book[None]) ** 2).sum(-1)
    for _ in range(5):
        code, near = codebooks.exponion(x, book, rng.integers(0, 16, 400))
        assert (code == d.argmin(1)).all() and (near == d.min(1)).all()


# Toxicity


def brute_kernel(a, b, order, gaps, decay, places):
    """By listing all sequences of both."""

    def weights(s):
        out = Counter()

        def extend(first, last, seq):
            if len(seq) == order:
                out[tuple(seq)] += decay ** (last - first + 1)
                return
            for nxt in range(last + 1, min(first + order + gaps, len(s))):
                extend(first, nxt, [*seq, s[nxt]])

        for i in range(min(len(s), places)):
            extend(i, i, [s[i]])
        return out

    x, y = weights(a), weights(b)
    return sum(v * y[u] for u, v in x.items())


def test_table_gives_the_kernel_expansion():
    from tarn.llm import toxicity as T

    marks = [b"idiot", b"clown", b"th he in"]
    found = T.Landmarks(marks)
    symbols = [T.symbols([m])[0] for m in marks]
    strip = lambda row: [int(x) for x in row if x]
    primal = np.array([0.7, -1.3, 0.4])[: found.root.shape[1]]
    table, alpha = found.table(primal), found.root @ primal
    for text in (b"an i.d.i.o.t", b"xclowwn", b"idot", b"nothing", b""):
        row, starts = T.symbols([text])
        want = sum(a * brute_kernel(strip(row), strip(m), T.ORDER, T.GAPS, T.DECAY, T.PLACES) for a, m in zip(alpha, symbols, strict=True))
        codes, weights = T.of_windows(row, np.array([0]))
        assert np.isclose((table[codes] * weights).sum(), want, rtol=1e-5, atol=1e-6)
        assert np.allclose(found.features(codes, weights) @ primal, want, rtol=1e-5, atol=1e-6)


def test_windows_do_not_depend_on_blocks_or_neighbours(monkeypatch):
    from tarn.llm import toxicity as T

    rng = np.random.default_rng(3)
    table = rng.normal(size=T.SYMBOLS**T.ORDER).astype(np.float32)
    table[T.has_padding(np.arange(T.SYMBOLS**T.ORDER))] = 0
    texts = [bytes(rng.choice(list(b"abc .,-\xc3\xa9"), n)) for n in (0, 1, 3, 40, 900, 7)] + [b"x\x00y" * 30]
    together = T.windows(*T.symbols(texts), table)[0]
    alone = [T.windows(*T.symbols([t]), table)[0][0] for t in texts]
    assert np.allclose(together, alone)
    monkeypatch.setattr(T, "BLOCK", 11)
    assert np.allclose(T.windows(*T.symbols(texts), table)[0], together)


INSULTS = ["blockhead", "nitwit", "dunce", "pillock"]


def insulting(seed, n):
    """Labelled texts; toxic ones hold insults, a few labels are wrong."""
    rng = np.random.default_rng(seed)
    parts = ["th", "he", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "it", "al", "ar", "st"]
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(rng.integers(20, 120))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(int(rng.integers(len(words))), INSULTS[rng.integers(4)])
        docs.append((i, " ".join(w + "." * (rng.random() < 0.1) for w in words), "en", "s"))
        labels.append((i, 1, int(toxic) if rng.random() > 0.02 else 1 - int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_documents(spark):
    import zlib

    from tarn.llm import toxicity as T

    docs, labels = insulting(5, 900)
    odd = [(5000, None, "en", "s"), (5001, "", "en", "s"), (5002, " \t", "en", "s"), (None, "you nitwit and dunce", "en", "s"), (0, docs[0][1], "en", "s"), (5003, "th he in er " * 200_000 + " you pillock " + "an re on " * 100_000, "en", "s")]
    marred = [(6000 + k, f"the on {w} er in at the re", "fr", "s") for k, w in enumerate(["blo.ckhead", "nitwxit", "pil-lock", "blockhhead"])]
    teach = spark.createDataFrame([*labels, (9999, 1, 1), (5002, 1, None), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    got = rows(T.score(documents(spark, docs + odd + marred), teach))
    assert len(got) == len(docs) + len(odd) + len(marred)
    held = {r["doc_id"] for r in got if r["held_out"]}
    assert held == {i for i in {r["doc_id"] for r in got} - {None} if zlib.crc32(str(i).encode()) % 5 == 0}
    by_id = {r["doc_id"]: r for r in got}
    right = [by_id[i]["predicted"] == int(i % 5 == 0) for i in range(900) if i in held]
    assert np.mean(right) >= 0.97
    assert by_id[None]["predicted"] == 1 and by_id[5003]["predicted"] == 1
    assert all(by_id[i]["predicted"] == 0 and by_id[i]["score"] < 0.1 for i in (5000, 5001, 5002))
    assert sum(by_id[6000 + k]["predicted"] for k in range(4)) >= 3
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)


def test_toxicity_without_labels_of_both_kinds(spark):
    from tarn.llm import toxicity as T

    docs = documents(spark)
    schema = "doc_id long, toxic int"
    assert {r["score"] for r in rows(T.score(docs, spark.createDataFrame([], schema)))} == {0.0}
    assert {r["score"] for r in rows(T.score(docs, spark.createDataFrame([(i, 1) for i in range(1, 15)], schema)))} == {1.0}
    assert rows(T.score(documents(spark, []), spark.createDataFrame([(1, 1)], schema))) == []


def test_toxicity_of_stems_in_a_less_common_language():
    """Insults of one language that are never the same word, and are outdone by those of another."""
    from tarn.llm import toxicity as T

    rng = np.random.default_rng(8)
    parts = ["ach", "sch", "ein", "ung", "ver", "ber", "keit", "lich", "ten", "gen"]
    docs, labels = insulting(6, 700)
    data = [(t, k, False) for (_, t, _, _), (_, _, k) in zip(docs, labels, strict=True)]
    for i in range(300):
        words = ["".join(rng.choice(parts, rng.integers(1, 4))) for _ in range(60)]
        if i % 8 == 0:
            for _ in range(4):
                words.insert(int(rng.integers(len(words))), "gralo" + "".join(rng.choice(parts, rng.integers(1, 3))))
        data.append((" ".join(w + "." * (rng.random() < 0.1) for w in words), int(i % 8 == 0), True))
    data = [data[i] for i in rng.permutation(len(data))]
    learn, held = data[:750], data[750:]
    toxic, clean = ([t for t, k, _ in learn if k == label] for label in (1, 0))
    found = T.telling_pieces(toxic, clean)
    assert any(p.startswith(" gralo") for p in found) and {f" {w} " for w in INSULTS} <= set(found)
    machine = T.train(toxic, clean, len(toxic) / len(learn))
    scores = machine.scores([t.encode() for t, _, other in held if other])
    truth = np.array([k for _, k, other in held if other])
    assert truth.sum() >= 5 and (scores[truth == 1] >= 0.5).mean() >= 0.9 and (scores[truth == 0] < 0.5).mean() >= 0.97
