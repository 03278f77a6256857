"""The pipeline's stages against brute force on a small corpus."""

import random

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from loomspark.llm import near_dedup  # noqa: E402
from test_operators import PIECES, _multiset, _similar  # noqa: E402

RUDE = ["grumbolt", "snarfle", "vexoid"]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    r = random.Random(21)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    said = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(said(30))) for i in range(6)]
    docs, labels = [], []
    for i in range(320):
        t = said(r.randint(40, 90))
        if i % 5 == 0:
            t[3:3] = [RUDE[i % 3], RUDE[(i + 1) % 3]]
        elif i % 13 == 1:
            t[10:10] = items[i % 6][1].split()
        elif i % 11 == 2 and docs:
            t = docs[i - 1][1].split()
            t[len(t) // 2] = "changed"
        elif i % 17 == 3:
            t.insert(7, "token=0123456789abcdef0123456789abcdef")
        docs.append((i, " ".join(t), "en", "s", len(" ".join(t))))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(1000, None, "en", "s", None), (1001, "", "en", "s", 0), (1002, docs[7][1], None, None, len(docs[7][1]))]
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def test_stages(spark, sf_dir):
    import sentencepiece

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    items = [r["text"].split() for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    rows = {r["doc_id"]: r for r in docs.collect()}
    rows = {i: r for i, r in rows.items() if not set((r["text"] or "").split()) & set(RUDE)}
    wants = [set(rows)]
    sets = {i: _multiset(r["text"]) for i, r in rows.items()}
    boss = {i: i for i in rows}

    def find(i):
        while boss[i] != i:
            i = boss[i]
        return i

    for i in rows:
        for j in rows:
            if j < i and _similar(sets[i], sets[j]):
                a, b = find(i), find(j)
                boss[max(a, b)] = min(a, b)
    rows = {i: r for i, r in rows.items() if find(i) == i}
    wants.append(set(rows))
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    rows = {i: r for i, r in rows.items() if not any(len(runs(t) & runs((r["text"] or "").split())) >= 0.8 * len(runs(t)) for t in items)}
    wants += [set(rows)] * 3
    assert len({len(w) for w in wants}) == 3
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf_dir)
        path = f"{sf_dir}/out-{k}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        got = docs.collect()
        assert sorted(r["doc_id"] for r in got) == sorted(wants[k]), name
        if k < 4:
            assert docs.columns == columns
        if k == 3:
            for r in got:
                text = rows[r["doc_id"]]["text"]
                if text and "token=" in text:
                    assert r["text"] == text.replace("token=0123456789abcdef0123456789abcdef", "[secret]") and r["n_chars"] == len(r["text"])
                else:
                    assert r["text"] == text and r["n_chars"] == rows[r["doc_id"]]["n_chars"]
            texts = {r["doc_id"]: r["text"] or "" for r in got}
    for r in got:
        assert r["ids"] == sp.encode(texts[r["doc_id"]]) and r["round_trip"]
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()) == sorted(wants[-1])


def test_stages_on_odd_tables(spark, sf_dir):
    schema = "doc_id long, text string, secret_spans string, leaked_items string, node long, _mark string, component long, n_chars long"
    said = " ".join(f"w{i}" for i in range(30))
    rows = [(None, said, "s", "l", 1, "m", 2, 5), (None, said, "s", "l", 1, "m", 2, 5), (7, said, "t", None, 1, "m", 2, 5), (7, said, "s", "l", 1, "m", 2, 5), (7, said, "s", "l", 1, "m", 2, 5)]
    rows += [(None, None, None, None, None, None, None, None)] * 2 + [(None, "other words token=0123456789abcdef0123456789abcdef", "s", "l", 1, "m", 2, 50), (9, "", "s", "l", 1, "m", 2, 0), (9, " .", "s", "l", 1, "m", 2, 2), (None, f"{said} more", "s", "l", 1, "m", 2, 5)]
    docs = spark.createDataFrame(rows, schema)
    kept = near_dedup.firsts(docs).collect()
    assert sorted(str(r["doc_id"]) + str(r["text"]) for r in kept) == sorted(["7" + said, "NoneNone", "NoneNone", "None" + rows[7][1], "9", "9 ."])
    masked = corpus_pipeline.mask_secrets(spark, docs, sf_dir)
    assert masked.columns == docs.columns
    assert [(r["text"], r["secret_spans"], r["n_chars"]) for r in masked.collect() if r["text"] and "other" in r["text"]] == [("other words [secret]", "s", 20)]
    for table in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, table, sf_dir)
            assert out.columns == table.columns and (out.count() > 0) == (table is docs), name
        assert corpus_pipeline.encode(spark, table, sf_dir).count() == table.count()
