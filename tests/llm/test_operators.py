"""Each operator against a brute-force version, a library or an exact round trip, with nulls, empty texts, repeated rows and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from loomspark.llm import decontaminate, exact_topk, lm_score, near_dedup, secret_scan, sentencepiece_codec, substring_dedup, token_output, toxicity
from loomspark.llm.fm_index import FMIndex
from loomspark.llm.pieces import BPE, UNIGRAM, Encoder, Pieces
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, ids string, score string"
public_tokenizers = pytest.importorskip("public_tokenizers")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")


def corpus(n=120, seed=1):
    """Texts with exact and near copies, shared passages, empty, null and very long ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 8))) for _ in range(400)]
    said = lambda k: [r.choice(words) for _ in range(k)]
    texts = [said(r.choice([3, 30, 120, 200])) for _ in range(n)]
    passage = said(80)
    for i in range(0, n, 7):
        texts[i] = texts[i][:20] + passage + texts[i][20:]
    for i in range(5, n, 9):
        texts[i] = list(texts[i - 5])
    for i in range(6, n, 11):
        t = list(texts[i - 4])
        for _ in range(max(1, len(t) // 60)):
            t[r.randrange(len(t))] = r.choice(words)
        texts[i] = t
    out = [(i, r.choice([" ", "\n", "  ", "\t"]).join(t), "en", "x", "y") for i, t in enumerate(texts)]
    out += [(n, "", "en", None, None), (n + 1, None, None, "x", None), (n + 2, "a " * 20_000, "en", "x", "y"), (None, "left without an id", "en", "x", "y"), (3, out[3][1], "en", "x", "y")]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def spread(rows, *columns):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in columns) for r in rows)


# near_dedup


def _multiset(text):
    for c in map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]):
        text = (text or "").replace(c, " ")
    w = re.split(r"[\x20\x09-\x0D]+", text.lower())
    w = [x for x in w if x]
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def _similar(a, b):
    both = sum(min(n, b[s]) for s, n in a.items())
    return both >= 0.8 * (sum(a.values()) + sum(b.values()) - both) if a and b else False


@pytest.mark.parametrize("block", [1024, 4])
def test_near_dedup_classes(docs, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = docs.collect()
    sets, boss = [_multiset(r["text"]) for r in rows], list(range(len(rows)))

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if _similar(sets[i], sets[j]):
                boss[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        k = find(i)
        if r["doc_id"] is not None:
            least[k] = min(least.get(k, 10**9), r["doc_id"])
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], least.get(find(i), -1) if sets[i] else r["doc_id"]) for i, r in enumerate(rows))
    assert spread(near_dedup.classes(docs).collect(), "doc_id", "class_id") == want


def test_near_dedup_of_nothing(empty):
    assert near_dedup.classes(empty).collect() == []


def test_signatures_agree_as_often_as_the_weighted_similarity_says():
    a, b = {1: 3, 2: 1, 3: 7, 4: 2}, {1: 1, 2: 1, 3: 9, 5: 4}
    want = sum(min(a.get(k, 0), b.get(k, 0)) for k in range(6)) / sum(max(a.get(k, 0), b.get(k, 0)) for k in range(6))
    same = 0
    for t in range(40):
        doc, h, w = [], [], []
        for d, x in enumerate((a, b)):
            for k, n in x.items():
                doc.append(d), h.append(k * 1000 + t), w.append(n)
        s = near_dedup.signatures(np.array(doc), np.array(h, np.uint64), np.array(w), 2)
        same += int((s[0] == s[1]).sum())
    assert abs(same / (40 * near_dedup.WIDTH) - want) < 0.03


def test_signatures_do_not_depend_on_their_neighbours():
    t = [x[1] or "" for x in corpus(40)]
    sig = lambda x: (lambda d, h, w, _: near_dedup.signatures(d, h, w, len(x)))(*near_dedup.shingles(pa.array(x)))
    assert (sig(t) == np.concatenate([sig([x]) for x in t])).all()


def test_components(spark):
    r = random.Random(2)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    boss = {x: x for l in links for x in l}

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        boss[max(a, b)] = min(a, b)
    got = near_dedup.components(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {x: find(x) for x in boss}


# token_output


def test_token_output_round_trip(spark, docs, tmp_path):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(BYTE_BPE)
    path = str(tmp_path / "ids")
    parts = token_output.write(docs, path, BYTE_BPE, length=64, batch=4)
    got = token_output.read(spark, path, parts).collect()
    at, want = 0, []
    for r in sorted(docs.collect(), key=lambda r: (-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "")):
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids + [0]
        want.append((r["doc_id"], at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((w[1], w[0], w[2], w[3]) for w in want)
    f = token_output.SequenceFile(f"{path}/part-{parts[0]['part']:06d}.arrow")
    ids, mask = f[1]
    assert len(ids) == len(mask) == 64 and ids.base is not None


def test_token_output_of_nothing(spark, empty, tmp_path):
    assert token_output.read(spark, str(tmp_path), token_output.write(empty, str(tmp_path), BYTE_BPE)).collect() == []


def test_memo_encoder_is_the_library(monkeypatch):
    monkeypatch.setattr(token_output, "MEMO", 50)
    r = random.Random(3)
    some = list("ab'sdé. ,!?\n\t 1²漢🙂-\xa0　 ᠎\x1c ’") + ["'s", "'ll", " ", " ", "<|endoftext|>", "ab", "sd"]
    texts = ["".join(r.choice(some) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    texts += [" ".join(r.choice(["ab", "sd.", "x", "é,", "a!", "Ab;", "\n", "b\nc", "²", "’s", "it's"]) for _ in range(r.randint(0, 9))) for _ in range(3000)]
    e = token_output.Encoder(BYTE_BPE)
    for i in range(0, len(texts), 500):
        ids, n = e(pa.array(texts[i : i + 500]))
        for t, part in zip(texts[i : i + 500], np.split(ids, np.cumsum(n)[:-1])):
            assert part.tolist() == e.tok.encode(t, add_special_tokens=False).ids


# substring_dedup


def test_fm_index_matching_statistics():
    r = random.Random(1)
    for _ in range(60):
        depth, sigma = r.choice([1, 2, 3, 5, 50]), r.choice([1, 2, 3, 8])
        texts = [np.array([r.randint(1, sigma) for _ in range(r.randint(0, 30))], np.uint64) for _ in range(r.randint(1, 5))]
        asked = [np.array([r.randint(1, sigma + 1) for _ in range(r.randint(0, 20))], np.uint64) for _ in range(3)] + texts[:1]
        f = FMIndex(texts, depth)
        length, low, high = f.matching_statistics(asked)
        places = collections.defaultdict(set)
        for i, t in enumerate(texts):
            for a in range(len(t)):
                for b in range(a + 1, min(len(t), a + depth) + 1):
                    places[tuple(t[a:b].tolist())].add(int(f.begin[i]) + a)
        k = 0
        for q in asked:
            for a in range(len(q)):
                n = 0
                while n < depth and a + n < len(q) and tuple(q[a : a + n + 1].tolist()) in places:
                    n += 1
                assert length[k] == n
                if n:
                    assert set(f.sa[low[k] : high[k]].tolist()) == places[tuple(q[a : a + n].tolist())]
                k += 1


@pytest.mark.parametrize("window,hot", [(50, 400_000), (50, 20_000), (12, 20_000), (12, 900), (12, 1), (3, 2)])
def test_substring_dedup(docs, window, hot):
    rows = sorted(((r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in docs.collect()), key=lambda x: (-1 if x[0] is None else x[0], x[1]))
    first = {}
    for d, w in rows:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    want = []
    for d, w in rows:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        want.append((-1 if d is None else d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    got = substring_dedup.dedup(docs, window, hot).collect()
    assert spread(got, "doc_id", "n_words", "n_removed", "kept") == sorted(want)
    for r in got:
        assert sum(s["hi"] - s["lo"] for s in r["removed"]) == r["n_removed"]


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup.dedup(empty).collect() == []


# exact_topk


def test_exact_topk(spark, monkeypatch):
    monkeypatch.setattr(exact_topk, "QUERIES", 8)
    monkeypatch.setattr(exact_topk, "CANDIDATES", 16)
    monkeypatch.setattr(exact_topk, "SIDE", 2)
    monkeypatch.setattr(exact_topk, "MERGE", 2)
    r = random.Random(4)
    rows = [(i, [r.choice([-1.0, -0.5, 0.0, 0.5, 1.0]) for _ in range(9)]) for i in range(150)]
    rows += [(200 + i, rows[7][1]) for i in range(40)] + [(300, None), (301, [None] * 9), (302, [float("nan")] * 9), (303, [float("inf")] * 9), (None, rows[0][1]), (320, [1e4] * 9), (340, [0.5] * 4), (360, [])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = exact_topk.search(v, F.col("vec_id") % 20 == 0, k=7).collect()
    fine = {i: [math.floor(64 * x) for x in e] for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)}
    want = []
    for q in fine:
        if q % 20 == 0:
            s = sorted(((-sum(a * b for a, b in zip(fine[q], e)), c) for c, e in fine.items() if c != q))[:7]
            want += [(q, k + 1, c, -n) for k, (n, c) in enumerate(s)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_exact_topk_of_few_and_none(spark):
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in exact_topk.search(v, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 8192)]
    assert exact_topk.search(v.limit(0), F.col("vec_id") % 20 == 0).collect() == []


# decontaminate


def test_leaks(spark, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    items = [(i, " ".join((texts[i] or "").split()[5:45])) for i in (1, 2, 7, 9, 14, 30)] + [(50, "a a a"), (51, ""), (52, None), (None, "x y z u v"), (53, "never said in any of these texts at all")]
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.leaks(docs, b).collect()
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    for r in got:
        w = (r["text"] or "").split()
        have = runs(w) if len(w) >= 5 else set()
        want = []
        for i, t in items:
            q = runs((t or "").split())
            if i is not None and len((t or "").split()) >= 5 and len(q & have) >= 0.8 * len(q):
                want.append(i)
            if i == 50 and " a a a " in ' ' + ' '.join(w) + ' ':
                want.append(i)
        assert sorted(x["item_id"] for x in r["leaked_items"]) == sorted(want), r["doc_id"]


def test_leaks_with_edits_question_and_answer_and_shards(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 30)
    r = random.Random(9)
    said = lambda n: [f"w{r.randrange(500)}" for _ in range(n)]
    items = [(i, " ".join(said(25)), " ".join(said(8))) for i in range(20)]
    texts = []
    for i, q, a in items:
        w = (q + " " + a).split()
        w[12] = "edited"
        texts.append((i, " ".join(said(200) + w + said(100))))
        texts.append((100 + i, " ".join(said(50) + q.split() + said(50))))
    d = spark.createDataFrame(texts, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, question string, answer string")
    got = {r["doc_id"]: [x["item_id"] for x in r["leaked_items"]] for r in decontaminate.leaks(d, b).collect()}
    assert got == {i: [i] for i in range(20)} | {100 + i: [] for i in range(20)}


def test_short_answers_are_verified_and_repeated_items_each_count(spark, monkeypatch):
    r = random.Random(17)
    said = lambda n: " ".join(f"w{r.randrange(900)}" for _ in range(n))
    q = said(40)
    items = [(1, q, "x y z"), (2, said(30), "seven"), (2, said(30), ""), (3, "so", "short"), (4, "", ""), (None, q, "x y z")]
    texts = [(0, f"{said(20)} {q} {said(20)}"), (1, f"{said(20)} {q}, X y-z! {said(20)}"), (2, f"{q} z y x"), (3, items[1][1] + " seven " + items[2][1]), (4, items[1][1]), (5, "it is so short"), (6, "so very short"), (7, None)]
    d = spark.createDataFrame([(i, t, "mine") for i, t in texts], "doc_id long, text string, leaked_items string")
    b = spark.createDataFrame(items, "item_id long, question string, answer string")
    for words in (2_000_000, 10):
        monkeypatch.setattr(decontaminate, "SHARD_WORDS", words)
        got = {x["doc_id"]: x for x in decontaminate.leaks(d, b, "found").collect()}
        assert {i: [y["item_id"] for y in x["found"]] for i, x in got.items()} == {0: [], 1: [1], 2: [], 3: [2, 2], 4: [], 5: [3], 6: [], 7: []}
        assert {x["leaked_items"] for x in got.values()} == {"mine"}


def test_leaks_of_nothing(spark, empty, docs):
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.leaks(empty, b).collect() == []
    assert all(r["leaked_items"] == [] for r in decontaminate.leaks(docs, b).collect())


# lm_score


@pytest.mark.parametrize("heavy", [1 << 21, 50, 0])
def test_lm_base_scores_are_exact(docs, heavy):
    held = toxicity.fold(F.col("doc_id"), 10) == 0
    model = lm_score.train(docs.filter(~held), heavy=heavy)
    got = lm_score.score(docs, model, held).collect()
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w] + [None]
    rows = docs.collect()
    c = collections.Counter(w for r in rows if not fold(r["doc_id"]) for w in words(r["text"]))
    n, low = sum(c.values()), math.log10(sum(c.values()) + 0.1 * (len(c) + 1))
    want = sorted((-1 if r["doc_id"] is None else r["doc_id"], fold(r["doc_id"]), len(words(r["text"])), sum(c[w] > 0 for w in words(r["text"])), n, round(sum(math.log10(c[w] + 0.1) - low for w in words(r["text"])), 5)) for r in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got) == want
    assert all(r["score"] <= 0 for r in got)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


@pytest.mark.parametrize("most", [lm_score.MAX_FILTER, 1])
def test_lm_scores_are_those_of_quantised_counts(docs, most):
    held = toxicity.fold(F.col("doc_id"), 10) == 0
    got = lm_score.score(docs, lm_score.train(docs.filter(~held), max_filter=most), held).collect()
    fold = lambda d: zlib.crc32(b"" if d is None else str(d).encode()) % 10 == 0
    words = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w] + [None]
    rows = [(r["doc_id"], words(r["text"])) for r in docs.collect()]
    one, two = collections.Counter(), collections.Counter()
    for d, w in rows:
        if not fold(d):
            one.update(w)
            two.update(zip(["begin", *w], w))
    stands = lambda n: float(lm_score._VALUE[lm_score.level(np.array([n]))[0]]) if n else 0.0
    mass = sum(stands(n) for n in one.values())
    unseen = (sum(n == 1 for n in one.values()) + 1) / (sum(one.values()) + 2)
    base = lambda w: (1 - unseen) * stands(one[w]) / mass if one[w] else unseen

    def chance(h, w):
        c = stands(one[h])
        return (min(stands(two[h, w]), c) + lm_score.PRIOR * base(w)) / (c + lm_score.PRIOR)

    want = {}
    for d, w in rows:
        score = math.log10(base(w[0])) + sum(math.log10(chance(h, x)) for h, x in zip(w, w[1:]))
        want.setdefault(d, []).append(score)
    close = [min(abs(r["score"] - x) for x in want[r["doc_id"]]) <= 0.01 * abs(r["score"]) + 0.01 for r in got]
    assert len(close) == len(rows) and sum(close) >= 0.97 * len(close)


def test_lm_of_nothing(empty, docs):
    held = F.lit(True)
    model = lm_score.train(empty)
    assert lm_score.score(empty, model, held).collect() == []
    assert {r["n_known"] for r in lm_score.score(docs, model, held).collect()} == {0}


def test_filter_levels_never_fall_below_the_counts(docs):
    model = lm_score.train(docs)
    f = lm_score.Filter.load(model.path, model.bits)
    h, n = model.heavy
    q = f.levels(h, 1)
    assert (q >= lm_score.level(n)).all() and (q == lm_score.level(n)).mean() > 0.97
    other = f.levels(np.arange(1, 20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), 1)
    assert (other >= 0).mean() < 0.02


def test_lm_filters_keep_their_bits_at_any_size(docs):
    model = lm_score.train(docs, max_filter=1)
    made = docs.sparkSession.read.parquet(model.path).select("levels", "size").collect()
    assert made and all(r["size"] >= lm_score.BITS * sum((q + 1) * n for q, n in enumerate(r["levels"])) for r in made)


@pytest.mark.parametrize("heavy", [1 << 21, 50, 0])
def test_lm_routed_bigrams_score_like_mapped_ones(docs, heavy):
    held = toxicity.fold(F.col("doc_id"), 10) == 0
    both = []
    for most in (lm_score.MAX_FILTER, 1):
        model = lm_score.train(docs.filter(~held), max_filter=most, heavy=heavy)
        assert (model.pairs is not None) == (most == 1)
        rows = lm_score.score(docs, model, held).collect()
        both.append(sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 5), round(r["score"], 5)) for r in rows))
    assert both[0] == both[1]


# sentencepiece and token counts


def test_pieces_are_the_library(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    odd = ["  a  b\n c\t<s>hi </s>", " ", "   ", "a ", "a   ", "\x00é漢字🙂 x▁y▁▁z", " " * 37 + "a", "\n\n", "ﬁ ½", "a" * 100, "Hello world  the   quick brown"]
    r = random.Random(8)
    odd += ["".join(r.choice("abcdethT漢é") for _ in range(n)) for n in (64, 65, 300, 20_000)]
    odd += ["".join(r.choice("abcdeé 漢\n.T▁th") for _ in range(r.randint(1, 40))) for _ in range(300)]
    e = Encoder(PIECES)
    for t, ids, (n, _) in zip(odd, e.encode(odd), e.count(odd)):
        assert ids.tolist() == sp.encode(t) and n == len(ids)
        assert e.decode(ids) == sp.decode(sp.encode(t))
    got = sentencepiece_codec.encode(docs, PIECES)
    assert got.columns == ["doc_id", "text", "lang", "score", "ids", "n_tokens", "round_trip"]
    for r in got.collect():
        assert r["ids"] == sp.encode(r["text"] or "") and r["n_tokens"] == len(r["ids"]) and r["round_trip"]
    back = sentencepiece_codec.decode(got.drop("text"), PIECES).collect()
    assert sorted(r["text"] for r in back) == sorted(r["text"] or "" for r in docs.collect())
    counts = sentencepiece_codec.token_counts(docs, PIECES).collect()
    assert spread(counts, "doc_id", "n_tokens") == spread(got.collect(), "doc_id", "n_tokens")


def test_pieces_of_nothing(empty):
    assert sentencepiece_codec.encode(empty, PIECES).collect() == []
    assert sentencepiece_codec.token_counts(empty, PIECES).collect() == []


def test_unigram_forward_scores_are_the_best_segmentation():
    r = random.Random(6)
    table = {c: -3.0 - r.random() for c in "abc"} | {"".join(r.choice("abc") for _ in range(r.randint(2, 4))): -4 * r.random() for _ in range(25)}
    p = Pieces(table, {k: i for i, k in enumerate(table)}, UNIGRAM)
    words = {"".join(r.choice("abcd") for _ in range(r.randint(0, 9))) for _ in range(150)}
    cost = lambda t: table.get(t, p.worst if len(t) == 1 else -math.inf)

    def best(w):
        return max((cost(w[:i]) + best(w[i:]) for i in range(1, len(w) + 1)), default=0.0) if w else 0.0

    got = p.segment(words, lambda t: [t], [])
    for w in words:
        assert "".join(got[w]) == w and abs(sum(map(cost, got[w])) - best(w)) < 1e-9


def test_bpe_recurrence_is_greedy_merging():
    r = random.Random(7)
    table, n = {c: -1000.0 - i for i, c in enumerate("abcd")}, 0
    while len(table) < 60:
        t = "".join(r.sample(sorted(table), 2))
        if len(t) <= 6 and t not in table:
            table[t], n = -float(n), n + 1
    p = Pieces(table, {k: i for i, k in enumerate(table)}, BPE)
    words = {"".join(r.choice("abcde") for _ in range(r.randint(0, 12))) for _ in range(2000)}
    got = p.segment(words, lambda t: [t], [])
    assert all(got[w] == p.merge(w) for w in words)
    # One edge ends at each prefix: Viterbi over the lattice has one path.
    for w in list(words)[:300]:
        paths = {0: [""]}
        for i in range(1, len(w) + 1):
            ends = [w[j:i] for j in range(i) if (w[j:i] in table and p.merge(w[j:i]) == [w[j:i]] or i - j == 1) and (not j or p.merge(paths[j][0] + w[j:i]) == [paths[j][0], w[j:i]])]
            assert len(ends) == 1
            paths[i] = ends


# secret_scan

ASSIGN = re.compile(r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def _base(x):
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(x) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", x) if len(m[0]) >= 20]
    return sorted(spans + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", x) if len(m[0]) >= 24])


def test_secrets(spark, docs):
    r = random.Random(10)
    parts = ["token", "API_key", "PassWord", "=", ":", " ", '"', "'", "AKIA", "abcdef0123456789" * 2, "QWERTY0123456789XYZ", "x", "é🙂", "\n", "a.b-c/d=", "secret", "f00"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(400)] + [None, "", ("token = abcdefgh1 " * 700)]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {x["doc_id"]: x for x in secret_scan.secrets_digest(spark, d).collect()}
    for i, t in enumerate(texts):
        spans = _base(t or "")
        said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        assert got[i]["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert (got[i]["n_assign"], got[i]["n_access"], got[i]["n_hex"]) == tuple(sum(k == j for _, k, _ in spans) for j in range(3))
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("random")] == said.split(",")[: len(spans)]
    assert len(secret_scan.secrets_digest(spark, docs).collect()) == docs.count()


def test_all_spans_are_those_of_a_plain_version(spark):
    llr, threshold = secret_scan.fit(spark.createDataFrame([(i, f"plain words about {w} and their names") for i, w in enumerate(secret_scan.PARTS)], "doc_id long, text string"))
    k, at = len(secret_scan.ALPHABET), secret_scan.ALPHABET.index

    def spans(x):
        out = _base(x)
        for m in re.finditer(secret_scan.TOKEN, x):
            t = m[0]
            if sum(llr[at(a) * k + at(b)] for a, b in zip(t, t[1:])) / (len(t) - 1) >= threshold:
                out.append((m.start(), 3, m.end()))
        return sorted(out)

    r = random.Random(15)
    said = lambda n: "".join(r.choice(secret_scan.ALPHABET[:64]) for _ in range(n))
    plain = lambda: "_".join(r.sample(secret_scan.PARTS, 4)) + f"_{r.randrange(2000)}"
    texts = [" ".join(r.choice([plain(), said(r.randint(18, 40)), "token=" + said(30), "AKIA" + "Z9" * 9, "é", "0f" * 13, "word", "🙂"]) for _ in range(r.randint(0, 200))) for _ in range(60)]
    d = spark.createDataFrame([(i, t, None, "mine") for i, t in enumerate(texts)], "doc_id long, text string, secret_spans string, _secret_merged string")
    found = {x["doc_id"]: x for x in secret_scan.scan(d, llr, threshold=threshold, to="spans").collect()}
    assert any(s[1] == 3 for t in texts for s in spans(t))
    for i, t in enumerate(texts):
        assert [tuple(s) for s in found[i]["spans"]] == spans(t)
        assert (found[i]["secret_spans"], found[i]["_secret_merged"]) == (None, "mine")
    masked = {x["doc_id"]: x["text"] for x in secret_scan.redact(secret_scan.scan(d, llr, threshold=threshold)).collect()}
    for i, t in enumerate(texts):
        out, at_ = [], 0
        runs = []
        for a, _, b in spans(t):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(runs[-1][1], b)
            else:
                runs.append([a, b])
        for a, b in runs:
            out.append(t[at_:a] + "[secret]")
            at_ = b
        assert masked[i] == "".join(out) + t[at_:]


def test_long_tokens_and_many_matches_take_seconds(spark):
    import time

    r = random.Random(16)
    texts = ["".join(r.choice(secret_scan.ALPHABET[:62]) for _ in range(1_000_000)), " ".join(f"{i:032x}" for i in range(40_000))]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    llr, threshold = secret_scan.fit(d.limit(0))
    began = time.time()
    got = {x["doc_id"]: x["text"] for x in secret_scan.redact(secret_scan.scan(d, llr, threshold=threshold)).collect()}
    assert got[1] == " ".join(["[secret]"] * 40_000) and got[0].startswith("[secret]") and len(got[0]) < 100
    assert time.time() - began < 60


def test_masking_cuts_the_spans_and_nothing_else(spark):
    llr = secret_scan.train(secret_scan.labelled_samples(spark))
    texts = ["no secret here", None, "é token = abcdef1234567890abcdef12 end", "AKIA" + "Q" * 20 + " and " + "0f" * 20]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secret_scan.redact(secret_scan.scan(d, llr)).collect()}
    assert out == {0: texts[0], 1: None, 2: "é [secret] end", 3: "[secret] and [secret]"}


def test_markov_models_tell_random_strings_from_identifiers(spark):
    import math
    import secrets

    llr = secret_scan.train(secret_scan.labelled_samples(spark))
    r = random.Random(12)
    k = len(secret_scan.ALPHABET)
    ratio = lambda s: sum(llr[secret_scan.ALPHABET.index(a) * k + secret_scan.ALPHABET.index(b)] for a, b in zip(s, s[1:])) / (len(s) - 1)
    bad = ["".join(r.choice(secret_scan.ALPHABET[:62]) for _ in range(32)) for _ in range(200)]
    good = ["_".join(r.sample(secret_scan.PARTS, 4)) + "_" + str(r.randrange(2000)) for _ in range(200)]
    assert sum(ratio(s) >= secret_scan.THRESHOLD for s in bad) > 190
    assert sum(ratio(s) >= secret_scan.THRESHOLD for s in good) < 10


def test_secret_plans_hold_no_python(spark, docs):
    plan = secret_scan.secrets_digest(spark, docs.select("doc_id", "text"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# toxicity


def labelled(spark, n=400):
    r = random.Random(13)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rude = ["grumbolt", "snarfle", "vexoid", "quibzor", "drakkent"]
    rows, labels = [], []
    for i in range(n):
        t = [r.choice(words) for _ in range(r.randint(20, 80))]
        if i % 5 == 0:
            for _ in range(3):
                t.insert(r.randrange(len(t)), r.choice(rude) + r.choice(["", ".", "!"]))
        rows.append((i, " ".join(t)))
        labels.append((i, int(i % 5 == 0)))
    rows += [(n, ""), (n + 1, None), (None, "snarfle vexoid grumbolt"), (0, rows[0][1])]
    labels += [(5, 0), (n + 7, None), (None, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_on_held_out_documents(spark):
    docs, labels = labelled(spark)
    model = toxicity.train(docs, labels, toxicity.fold(F.col("doc_id"), 3) != 1)
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum((got[i]["score"] >= 0.7) == (i % 5 == 0) for i in held) / len(held) > 0.97
    assert got[400]["score"] == got[401]["score"] < 0.5 and 0 <= got[400]["score"]
    assert got[None]["score"] >= 0.7 and got[None]["evidence"]
    kept = toxicity.accepted(docs, model).collect()
    assert {r["doc_id"] for r in kept} == {i for i, r in got.items() if r["score"] < 0.7}


def test_nearest_examples_are_exact(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    r = random.Random(14)
    idf = {f"t{i}": 1 + r.random() for i in range(12)}
    vectors = []
    for d in range(90):
        v = {t: r.random() for t in r.sample(sorted(idf), r.randint(1, 4))}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append((d, d % 2, {t: x / norm for t, x in v.items()}))
    m = toxicity.Model(idf, vectors, (1, 10))
    for _ in range(100):
        q = m.vector(" ".join(r.choice(sorted(idf)) for _ in range(r.randint(1, 6))))
        want = sorted(((round(sum(x * v.get(t, 0) for t, x in q.items()), 12), d) for d, _, v in vectors if set(q) & set(v)), key=lambda p: (-p[0], p[1]))[:5]
        got = [(s, m.ids[i]) for s, i in m.nearest(q, 5)]
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want]


def test_scores_are_calibrated_votes_of_the_nearest(spark):
    r = random.Random(18)
    rude = ["grumbolt", "snarfle", "vexoid", "quibzor", "drakkent", "worbly", "zanfit", "plomusk"]
    plain = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(2400):
        own = [r.choice(rude) for _ in range(r.randint(1, 5))] if i % 2 else []
        rows.append((i, " ".join([r.choice(plain) for _ in range(30)] + own), len(own)))
        labels.append((i, int(r.random() < (0.01, 0.4, 0.6, 0.75, 0.85, 0.95)[len(own)])))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string, n long"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, known, toxicity.fold(F.col("doc_id"), 3) != 1)
    assert model.curve
    got = {x["doc_id"]: x for x in toxicity.score(docs, model).collect()}
    held = [i for i, _, n in rows if n and zlib.crc32(str(i).encode()) % 3 == 1]
    said, true = np.array([got[i]["score"] for i in held]), np.array([labels[i][1] for i in held])
    assert abs(said.mean() - true.mean()) < 0.06
    low = said < np.median(said)
    assert all(abs(said[k].mean() - true[k].mean()) < 0.1 for k in (low, ~low))
    for i, _, _ in rows[:200]:
        near = [(x["similarity"], x["toxic"]) for x in got[i]["evidence"]]
        assert near == sorted(near, key=lambda p: -p[0]) and len(near) <= toxicity.NEIGHBOURS
        vote = (sum(s * y for s, y in near) + toxicity.SHRINK * model.base) / (sum(s for s, _ in near) + toxicity.SHRINK)
        want = 1 / (1 + math.exp(-(model.curve[0] * vote + model.curve[1]))) if near else model.base
        assert abs(got[i]["score"] - want) < 1e-9


def test_logistic_curves_are_the_likeliest():
    r = random.Random(19)
    x = np.array([r.random() for _ in range(4000)])
    y = np.array([float(r.random() < 1 / (1 + math.exp(-(6 * v - 3)))) for v in x])
    a, b = toxicity.logistic(x, y)
    assert abs(a - 6) < 0.8 and abs(b + 3) < 0.5
    assert toxicity.logistic(x, 1 - y)[0] == 0


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, none, F.lit(True))
    assert {r["score"] for r in toxicity.score(docs, model).collect()} == {0.5}
    assert toxicity.score(empty, model).collect() == []
