"""Micro-goldens and properties of the library's functions."""

import itertools
import random
import struct

import numpy as np
import pytest
from loomspark import queries
from loomspark.functions import masks, scalars, sequences, text, tokens
from loomspark.operators import batching, filters, joins, quantize, tools
from loomspark.runtime import row_index
from loomspark.sources import files
from loomspark.streaming import sessions
from pyspark.sql import functions as F


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def longs(*x):
    return F.array(*[F.lit(v).cast("long") for v in x]) if x else F.array().cast("array<bigint>")


def test_masks(spark):
    to = lambda m: [[int(v) for v in r] for r in m]
    assert to(one(spark, masks.causal(F.lit(3)))) == [[1, 0, 0], [1, 1, 0], [1, 1, 1]]
    assert to(one(spark, masks.chunked(F.lit(4), 2))) == [[1, 1, 0, 0], [1, 1, 0, 0], [1, 1, 1, 1], [1, 1, 1, 1]]
    assert to([one(spark, masks.padding(F.lit(n), F.lit(5))) for n in (5, 3, 2)]) == [[0, 0, 0, 0, 0], [0, 0, 0, 1, 1], [0, 0, 1, 1, 1]]
    assert one(spark, masks.causal(F.lit(0))) == []


def test_padding(spark):
    rows = [one(spark, batching.padded(longs(*[1] * n), 4, F.lit(0).cast("long"))) for n in (4, 2, 1)]
    assert rows == [[1, 1, 1, 1], [1, 1, 0, 0], [1, 0, 0, 0]]


def test_token_goldens(spark):
    layers = tokens.grouped_layers(longs(1, 2, 3, 4), 3)
    assert one(spark, layers) == [[1, 4], [2, 6561], [3, 6562]]
    assert one(spark, tokens.packed_duration(F.lit(7), F.lit(3))) == 8199
    assert tuple(spark.range(1).select(*tokens.unpacked_duration(F.lit(8199))).first()) == (7, 3)
    assert one(spark, tokens.layer_shift(F.lit(5), 2)) == 165255
    assert one(spark, tokens.regulated(F.array(F.lit("a"), F.lit("b")), F.array(F.lit(2), F.lit(1)))) == ["a", "a", "b"]


def test_grouping_is_undone(spark):
    r = random.Random(1)
    for layers, latency in itertools.product((1, 3, 7), (0, 2)):
        ids = [r.randrange(6000) for _ in range(r.randint(0, 20))]
        packed = tokens.grouped_layers(longs(*ids), layers, latency)
        assert one(spark, tokens.ungrouped(packed, latency)) == ids
    assert one(spark, tokens.ungrouped(F.array(longs(1, 2), longs(3, 4)))) is None


def test_reflection_and_trim(spark):
    x = F.array(*[F.lit(float(v)) for v in (1, 2, 3, 4)])
    assert one(spark, tokens.reflected(x, 2, 1)) == [3, 2, 1, 2, 3, 4, 3]
    assert one(spark, tokens.trimmed(tokens.reflected(x, 2, 1), 2, 1)) == [1, 2, 3, 4]


def test_dynamic_batches(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate((3, 4, 5, 2))], "shard string, id long, n long")
    got = batching.dynamic_batches(df, "shard", ["id"], "id", "n", 12)
    assert [r["batch"] for r in got.orderBy("id").collect()] == [0, 0, 1, 1]
    r = random.Random(3)
    rows = [(f"s{i % 5}", i, r.choice([1, 5, 40, 130])) for i in range(400)]
    got = batching.dynamic_batches(spark.createDataFrame(rows, "shard string, id long, n long"), "shard", ["id"], "id", "n", 100)
    sizes = got.groupBy("shard", "batch").agg(F.max("n").alias("m"), F.count("*").alias("c")).collect()
    assert sum(x["c"] for x in sizes) == 400 and all(x["m"] * x["c"] <= 100 or x["c"] == 1 for x in sizes)


@pytest.mark.parametrize("width", [1000, 30, 1])
def test_row_index(spark, width):
    keys = random.Random(4).sample(range(10**6), 480) + [2**40 + i for i in range(19)] + [2**62]
    got = row_index(spark.createDataFrame([(k,) for k in keys], "id long"), "id", "row", width).collect()
    assert {r["id"]: r["row"] for r in got} == {k: i for i, k in enumerate(sorted(keys))}


@pytest.mark.parametrize("n,world,workers", [(20, 3, 2), (2, 5, 3), (7, 2, 6), (0, 2, 2), (1, 1, 4)])
def test_shards_cover_all_rows_and_fill_all_workers(spark, n, world, workers):
    rows = batching.shards(spark.range(n), "id", world, workers).collect()
    assert {r["id"] for r in rows} == set(range(n))
    ids = list(range(n))
    full = (ids * (world // max(n, 1) + 1))[: max(n, world)] if n else []
    for rank in range(world):
        mine = full[rank::world]
        mine = (mine * (workers // max(len(mine), 1) + 1))[: max(len(mine), workers)] if mine else []
        for w in range(workers):
            got = sorted((r["turn"], r["id"]) for r in rows if (r["rank"], r["worker"]) == (rank, w))
            assert [i for _, i in got] == mine[w::workers]


def test_lcs():
    r = random.Random(5)
    for _ in range(200):
        x, y = ([r.randrange(4) for _ in range(r.randint(0, 9))] for _ in range(2))
        pairs = joins.lcs_pairs(x, y)
        assert all(x[i] == y[j] for i, j in pairs) and all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:]))
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = best[i][j] + 1 if x[i] == y[j] else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]


def test_arithmetic_coder_round_trip():
    r = random.Random(1234)
    for _ in range(12):
        n = r.randint(2, 4000)
        cdf = [0, *itertools.accumulate(r.randint(1, 50) for _ in range(n))]
        s = [r.randrange(n) for _ in range(r.randint(0, 500))]
        assert quantize.arithmetic_decode(quantize.arithmetic_encode(s, cdf), len(s), cdf) == s


def test_segments_tile_every_series(spark):
    g = np.random.default_rng(6)
    rows = [(s, t, g.normal(size=6).cumsum().tolist()) for s in range(4) for t in range(1 + 9 * s)]
    df = spark.createDataFrame(rows, "s long, t long, v array<double>")
    for variant in ("fixed", "default"):
        got = quantize.segments(df, "s", "t", "v", variant).collect()
        for s in range(4):
            cuts = sorted((r["start"], r["length"]) for r in got if r["s"] == s)
            assert cuts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(cuts, cuts[1:])) and sum(n for _, n in cuts) == 1 + 9 * s
            assert all(1 <= n <= 4 for _, n in cuts)


def test_kmeans_finds_clear_groups(spark):
    g = np.random.default_rng(7)
    rows = [(i, (np.array([10.0 * (i % 3), 0.0]) + g.normal(size=2) * 0.1).tolist()) for i in range(90)]
    codes = quantize.kmeans(spark.createDataFrame(rows, "id long, vec array<double>"), "id", 6, 5).collect()
    assert sum(r["n"] for r in codes) == 90 and len(codes) == 6


def test_text_functions(spark):
    assert [one(spark, filters.only_marks(F.lit(x))) for x in ("", "。!?", "a.")] == [True, True, False]
    assert one(spark, text.clean_json(F.lit(' ```json\n{"a":1}\n``` '))) == '{"a":1}'
    assert one(spark, text.without_blanks(F.lit("漢 字 ab cd 漢 "))) == "漢字ab cd漢"
    assert one(spark, text.split_paragraph(F.lit("一二三。四五！六"), zh=True, most=4, least=2, tail=2)) == ["一二三。", "四五！", "六。"]
    assert one(spark, text.split_paragraph(F.lit(""))) == []
    assert one(spark, text.pieces(F.lit('He said "no." Why?! Go'))) == ['He said "no."', " Why?", " Go."]
    assert [text.number_words(n) for n in (0, 21, 105, 1000, 1234)] == ["zero", "twenty-one", "one hundred and five", "one thousand", "one thousand, two hundred and thirty-four"]
    assert one(spark, text.language(F.lit("German"))) == "de"
    with pytest.raises(Exception, match="unknown language"):
        one(spark, text.language(F.lit("klingon")))


def test_coercion(spark):
    cases = [("12", "integer", "12"), ("-3.9", "int", "-3"), ("true", "integer", "1"), ("x", "integer", "x"), (" 1e3 ", "number", "1e3"), ("off", "boolean", "false"), ("maybe", "bool", "maybe"), ("7", "string", "7"), ("7", "list", "7")]
    for v, kind, want in cases:
        assert one(spark, tools.coerced(F.lit(v), F.lit(kind))) == want


def test_manifest_rules(tmp_path):
    good = {"name": "a", "dataset_path": str(tmp_path), "data_struct": "com"}
    assert files.Manifest.parse([good], check_exists=True).sources[0].system_prompt == ""
    for bad in ([good, good], [good | {"sampling_rate": 0}], [good | {"sampling_rate": 1.1}], [good | {"compress": {"rate": 0}}]):
        with pytest.raises(ValueError):
            files.Manifest.parse(bad)
    with pytest.raises(FileNotFoundError):
        files.Manifest.parse([good | {"dataset_path": "/no/such/place"}], check_exists=True)


def test_json_readers_raise_on_other_types(spark):
    df = spark.createDataFrame([("7",)], "j string")
    with pytest.raises(Exception, match="neither"):
        files.json_items(df, "j", "struct<a:int>").collect()


def test_interpolation_and_logits(spark):
    x = F.array(*[F.lit(float(v)) for v in (0, 1, 2, 3)])
    assert one(spark, sequences.interpolated(x, F.lit(4))) == [0, 1, 2, 3]
    assert abs(sum(one(spark, scalars.softmax(x))) - 1) < 1e-12
    assert one(spark, scalars.hand_over(F.lit(50), 100, 200)) == 0


@pytest.mark.parametrize("processor", [sessions.HopWindows(4, 3, 1.5, 8), sessions.PrefixWindows(5, 2, 3), sessions.Phases(3, 4, 9), sessions.TwoSided(2, 3)])
def test_streams_equal_their_batch_twins(spark, tmp_path, processor):
    r = random.Random(8)
    rows = [(k, i, r.randrange(6), r.random() < 0.5, i == 39) for k in range(4) for i in range(40)]
    df = spark.createDataFrame(rows, "key long, seq long, token long, is_text boolean, last boolean")
    want = sorted(map(repr, sessions.batch(df, processor).collect()))
    assert sorted(map(repr, sessions.streamed(df, processor, str(tmp_path)).collect())) == want


def test_cached_records_look_up_all_documents(spark, tmp_path):
    spark.createDataFrame([(1, 5), (2, 250), (3, 300)], "event_id long, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    spark.createDataFrame([(5, "de"), (250, "fr")], "doc_id long, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.QUERIES["j12_cached_records"](spark, str(tmp_path)).collect()
    assert sorted((r["event_id"], r["lang"]) for r in got) == [(1, "de"), (2, "fr"), (3, "none")]


def test_lcs_alignment_deals_all_events(spark, tmp_path):
    spark.createDataFrame([(i, 1, "view") for i in range(8)], "event_id long, user_id long, event_type string").write.parquet(str(tmp_path / "events.parquet"))
    got = queries.QUERIES["j08_lcs_alignment"](spark, str(tmp_path)).collect()
    assert sorted((r["key"], r["i"], r["j"]) for r in got) == [(1, 0, 3), (1, 2, 5), (1, 4, 7)]


def test_wav_files_and_resampling():
    from loomspark.functions import audio

    x = np.sin(np.arange(1600) / 16000 * 2 * np.pi * 440) * 0.9
    got, rate = audio.parse_wav(audio.make_wav(x, 16000))
    assert rate == 16000 and np.abs(got - x).max() < 1 / 32768
    raw = b"".join(struct.pack("<ff", v, 0) for v in x)
    stereo = b"RIFF" + struct.pack("<I", 0) + b"WAVELIST\x03\x00\x00\x00abc\x00fmt " + struct.pack("<IHHIIHH", 16, 3, 2, 8000, 64000, 8, 32) + b"data" + struct.pack("<I", len(raw)) + raw
    got, rate = audio.parse_wav(stereo)
    assert rate == 8000 and np.abs(got - x / 2).max() < 1e-6
    with pytest.raises(ValueError):
        audio.parse_wav(b"no")
    up = audio.resample(x, 16000, 24000)
    want = np.sin(np.arange(2400) / 24000 * 2 * np.pi * 440) * 0.9
    assert len(up) == 2400 and np.abs(up - want)[50:-50].max() < 0.01
    down = audio.resample(want, 24000, 16000)
    assert len(down) == 1600 and np.abs(down - x)[50:-50].max() < 0.01


def test_mel_frames_and_pitch(spark):
    from loomspark.functions import audio

    x = np.sin(np.arange(24000) / 24000 * 2 * np.pi * 220) * 0.5
    m = audio.log_mel(x)
    y = np.pad(x, 720, "reflect")
    for t in (0, 7, len(m) - 1):
        spec = np.abs(np.fft.rfft(y[t * 480 : t * 480 + 1920] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1920) / 1920))))
        assert np.allclose(m[t], np.log(np.maximum(audio.mel_weights(80, 1920, 24000, 8000.0) @ np.sqrt(spec**2 + 1e-9), 1e-5)))
    assert m.shape == (50, 80) and audio.log_mel(np.zeros(3)).shape[1] == 80
    p = audio.pitch(x, 24000, 480)
    assert np.abs(p[3:-3] - 220).max() < 2 and (audio.pitch(np.zeros(2400), 24000, 480) == 0).all()
    df = spark.createDataFrame([(1, audio.make_wav(x, 24000)), (2, None)], "id long, content binary")
    got = {r["id"]: r["x"] for r in df.select("id", audio.waveform(F.col("content"), 24000).alias("x")).collect()}
    assert got[2] is None and np.abs(np.array(got[1]) - x).max() < 1 / 32768
    with pytest.raises(Exception, match="below"):
        spark.createDataFrame([(audio.make_wav(x, 8000),)], "c binary").select(audio.waveform(F.col("c"), 24000)).collect()


def test_dumps_of_folders_first_key_wins_and_bad_files_go(spark, tmp_path):
    from loomspark.sources import files

    for name, said in {"b.json": '{"question_key": "k", "loss": 2}', "a/z.json": '{"question_key": "k", "loss": 1}', "c.json": '{"loss": 3}', "d.json": "{", "e.txt": '{"question_key": "t"}', "x/y/z.json": '{"question_key": "deep"}'}.items():
        (tmp_path / "top" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "top" / name).write_text(said)
    got = files.read_dumps(spark, str(tmp_path / "top"), "question_key string, loss long").collect()
    assert sorted((r["question_key"], r["loss"]) for r in got) == [("c", 3), ("k", 1)]


def test_paths_are_expanded(monkeypatch):
    from loomspark.sources import files

    monkeypatch.setenv("DATA", "/data")
    monkeypatch.setenv("HOME", "/home/me")
    assert (files.expand("$DATA/a"), files.expand("~/b"), files.expand("c")) == ("/data/a", "/home/me/b", "c")


def test_codebooks_beyond_the_broadcast_bound_give_the_same(spark):
    rng = np.random.default_rng(3)
    names = [int(c) for c in rng.permutation(60) * 7]
    codes = spark.createDataFrame([(c, [float(v) for v in rng.integers(-3, 4, 4)]) for c in names], "code long, vec array<double>")
    points = spark.createDataFrame([(i, [float(v) for v in rng.integers(-3, 4, 4)]) for i in range(300)], "id long, vec array<float>")
    whole = {r["id"]: r["code"] for r in joins.nearest_code(points, codes).collect()}
    cells = {r["id"]: r["code"] for r in joins.nearest_code(points, codes, most=10, cell=60).collect()}
    book, x = sorted(map(tuple, codes.collect())), {r["id"]: r["vec"] for r in points.collect()}
    want = {i: min(((sum((a - b) ** 2 for a, b in zip(v, m)), c) for c, m in book))[1] for i, v in x.items()}
    assert whole == want and cells == want
    step = lambda most: sorted((r["code"], r["n"], [round(v, 9) for v in r["vec"]]) for r in quantize.kmeans_step(points, codes, most=most).collect())
    assert step(10) == step(60)
    half = codes.select("code", F.transform("vec", lambda v: v / 2).alias("vec"))
    residual = lambda most: {r["id"]: (r["codes"], r["residual"]) for r in quantize.residual_codes(points, [codes, half], most=most).collect()}
    assert residual(10) == residual(60)
    assert joins.nearest_code(points.limit(0), codes, most=10).count() == 0


def _plain_pieces(text, zh, most=80, least=60, tail=20):
    """The pieces of a text by a walk over its characters."""
    import regex

    if "<|" in text and "|>" in text:
        return [text]
    x = text.strip(" ")
    if zh:
        x = x.replace("\n", "")
        ascii_ = lambda i: 0 <= i < len(x) and x[i] != " " and ord(x[i]) < 128
        x = "".join(c for i, c in enumerate(x) if c != " " or ascii_(i - 1) and ascii_(i + 1))
        x = x.replace("²", "平方").replace("³", "立方").replace("——", " ")
        x = "".join(c for c in x if c not in "（）【】`").replace(".", "。")
        if x and x[-1] in "，,、":
            x = x.rstrip("，,、") + "。"
    marks, end = ("。？！；：、.?!;", "。") if zh else (".?!;:", ".")
    x, pieces, open_, i = x + end if x and x[-1] not in marks else x, [], "", 0
    while i < len(x):
        open_, i, ends = open_ + (x[i] if open_ or x[i] not in marks else ""), i + 1, x[i] in marks
        if ends and open_:
            if i < len(x) and x[i] in '"”':
                open_, i = open_ + x[i], i + 1
            pieces, open_ = [*pieces, open_], ""
    size = len if zh else lambda t: len([w for w in t.split(" ") if w])
    out, open_ = [], ""
    for p in pieces:
        if size(open_ + p) > most and size(open_) > least:
            out, open_ = [*out, open_], p
        else:
            open_ += p
    if open_ and size(open_) < tail and out:
        out[-1] += open_
    elif open_:
        out.append(open_)
    return [p for p in out if not regex.fullmatch(r"[\p{P}\p{S}\s]*", p)]


def test_normalised_texts_are_those_of_a_plain_version(spark):
    rng = random.Random(4)
    words = ["a", "be", "漢字", "數，", "²", "（x）", "end.", "so?!", 'said."', ";", "——", "、", "\n", "x:y", "", "…"]
    texts = [" ".join(rng.choices(words, k=rng.choice((0, 1, 3, 40, 400)))) for _ in range(150)] + ["", " ", "...", "<|a|> b. c.", "no end", "漢 字，、", "，"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    rows = got.select("t", text.normalised(F.col("t")).alias("en"), text.normalised(F.col("t"), zh=True).alias("zh")).collect()
    for r in rows:
        assert (r["en"], r["zh"]) == (_plain_pieces(r["t"], False), _plain_pieces(r["t"], True)), r["t"]


def test_kmeans_step_with_tasks_without_points(spark):
    points = spark.createDataFrame(spark.sparkContext.parallelize([(i, [float(i), 1.0]) for i in range(4)], 8), "id long, vec array<float>")
    codes = spark.createDataFrame([(0, [0.0, 1.0]), (1, [3.0, 1.0])], "code long, vec array<double>")
    got = {r["code"]: (r["vec"], r["n"]) for r in quantize.kmeans_step(points, codes).collect()}
    assert got == {0: ([0.5, 1.0], 2), 1: ([2.5, 1.0], 2)}
    assert {r["code"]: r["n"] for r in quantize.kmeans(points, "id", 2, 3).collect()} == {0: 2, 1: 2}
    assert {r["n"] for r in quantize.kmeans_step(points.filter("id < 0"), codes).collect()} == {0}


def test_collated_records_keep_the_types_of_values(spark):
    row = spark.sql("SELECT 1L AS batch, 2L AS vec_id, array(1L) AS text_token, array(1L) AS speech_token, array(array(0.5F)) AS speech_feat, array(0.1F) AS speech, array(0.1F) AS pitch_feat, array(1L) AS reject_speech_token, 's' AS spk_embedding, 'u' AS utt_embedding")
    kinds = dict(batching.collated_records(row, "batch", "vec_id", gan=True, dpo=True).dtypes)
    assert (kinds["speech_feat"], kinds["speech"], kinds["pitch_feat"]) == ("array<array<float>>", "array<float>", "array<float>")
    wide = row.withColumn("speech_feat", F.col("speech_feat").cast("array<array<double>>"))
    assert dict(batching.collated_records(wide, "batch", "vec_id").dtypes)["speech_feat"] == "array<array<double>>"


def test_nearest_codes_are_equal_to_nine_places():
    x = np.zeros((1, 2))
    m = np.array([[2.0, 0.0], [0.5 + 1e-11, 0.0], [0.5, 0.0], [0.0, 0.5 + 1e-11], [0.5, 0.0]])
    at, d = joins.nearest_rows(x, m)
    assert at.tolist() == [1] and d.tolist() == [0.25]
    rng = np.random.default_rng(0)
    m = np.round(rng.normal(size=(5000, 3)), 1)
    m += 1e-10 * rng.normal(size=m.shape)
    x = np.concatenate([m[::40], np.round(rng.normal(size=(1100, 3)), 1)])
    want = [int(np.round(((m - p) ** 2).sum(1), 9).argmin()) for p in x]
    assert joins.nearest_rows(x, m)[0].tolist() == want


def test_rounding_keeps_the_sign_of_zero(spark):
    x = F.array(*map(F.lit, (-1e-9, 1e-9, -0.0, 0.0, -2.5, 0.1234565, float("-inf"))))
    got = one(spark, F.transform(x, lambda v: scalars.rounded(v, 6)))
    assert list(map(str, got)) == ["-0.0", "0.0", "-0.0", "0.0", "-2.5", "0.123457", "-inf"]


@pytest.mark.parametrize("name", ["w13_cross_fade", "x33_peaks", "x35_channels"])
def test_arrays_of_small_negative_values_equal_their_sql_as_text(spark, tmp_path, name):
    duckdb = pytest.importorskip("duckdb")
    x = [(i, [random.Random(64 * i + k).choice([-1e-9, 1e-9, -0.0, -0.3, 0.7]) for k in range(64)]) for i in range(20)]
    spark.createDataFrame(x, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    text = lambda rows: sorted(map(str, map(tuple, rows)))
    df = queries.QUERIES[name](spark, str(tmp_path))
    assert text(df.collect()) == text(con.execute(f"select {', '.join(df.columns)} from ({queries.ORACLES[name]})").fetchall())


def test_durations_of_codes_beyond_the_codebook(spark):
    for code, n in ((7, 3), (4095, 1), (4096, 2), (9000, 4)):
        packed = tokens.packed_duration(F.lit(code), F.lit(n))
        assert tuple(spark.range(1).select(*tokens.unpacked_duration(packed, book=F.lit(code // 4096))).first()) == (code, n)
    assert tuple(spark.range(1).select(*tokens.unpacked_duration(F.lit(-1), book=F.lit(2))).first()) == (None, 0)
