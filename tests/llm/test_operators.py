"""Each corpus operator on nulls, empty and long texts, repeated rows, shared ids, empty tables and clashing names, against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkprep.llm import common, jaccard_join, language_id, line_dedup, mixing, piece_dropout, quality_model, substring_dedup, topk, url_rules, weak_rules
from sparkprep.llm.common import connected_components
from tests.llm.conftest import words

WS = " \t\n\x0b\x0c\r"


def split(text):
    return (text or "").encode().split()


# 1
def brute_lines(raw, least):
    seen = defaultdict(set)
    key = lambda line: line.strip(WS).encode().lower().decode()
    for r in raw:
        for line in (r[1] or "").split("\n"):
            seen[key(line)].add(r[0])
    out = []
    for r in raw:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if not key(x) or len(seen[key(x)]) < least]
        out.append((r[0], "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def some(rows):
    return sorted(rows, key=repr)


@pytest.mark.parametrize("least", [2, 3, 10])
def test_line_dedup(docs, raw, least):
    out = line_dedup.line_dedup(docs, min_documents=least)
    assert out.columns.count("n_lines") == 1 and set(docs.columns) <= set(out.columns)
    assert some((r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in out.collect()) == some(brute_lines(raw, least))
    assert all(r["_row"] == "_row" and r["id"] == "id" for r in out.select("_row", "id").collect())


def test_empty_tables(empty):
    assert line_dedup.line_dedup(empty).count() == 0
    assert mixing.mix_sources(empty).count() == 0
    assert substring_dedup.substring_dedup(empty).count() == 0
    assert jaccard_join.near_duplicates(empty).count() == 0
    assert weak_rules.weak_quality(empty).count() == 0
    assert piece_dropout.encode_pieces(empty).count() == 0
    model = language_id.fit_language_model(empty)
    assert language_id.identify_language(empty, model).count() == 0
    urls = empty.select(F.col("doc_id").alias("page_id"), F.col("text").alias("url"))
    rules = url_rules.mine_rules(urls.select(url_rules.url_tokens(F.col("url")).alias("tokens"), F.lit(True).alias("bad")))
    assert url_rules.filter_urls(urls, rules, url_rules.GIVEN).count() == 0
    vectors = empty.select(F.col("doc_id").alias("vec_id"), F.array().cast("array<float>").alias("embedding"))
    assert topk.exact_top_k(vectors, F.lit(True)).count() == 0
    labels = empty.select("doc_id", F.lit(1).alias("quality"))
    assert quality_model.score_quality(empty, quality_model.fit_quality_model(empty, labels)).count() == 0


# 2
def test_pieces_equal_the_library_without_dropout_and_decode_exactly(raw):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=piece_dropout.MODEL)
    plain = piece_dropout.PieceCodec(*piece_dropout.read_pieces(), 0.0, 0)
    texts = [r[1] for r in raw if r[1] and "▁" not in r[1]] + ["a" * 300 + "b" * 90, "the" * 100, "  two  spaces ", "x\x00y", "日本語のテキスト" * 20]
    for t in texts:
        ids = np.frombuffer(plain.encode(t, 1), dtype=np.int32).tolist()
        assert ids == library.encode(t) and plain.decode(ids) == t


def test_dropout_varies_reruns_agree_and_all_texts_come_back(docs, raw):
    codec = piece_dropout.PieceCodec(*piece_dropout.read_pieces(), 0.3, 5)
    ways = {codec.encode("internationalisation", k) for k in range(40)}
    assert len(ways) > 4
    out = piece_dropout.encode_pieces(docs, dropout=0.2, check_out="back")
    rows = out.select("doc_id", "text", "ids", "back").collect()
    assert len(rows) == len(raw) and all(r["text"] == r["back"] for r in rows)
    assert all((r["ids"] is None) == (r["text"] is None) for r in rows)
    again = piece_dropout.encode_pieces(docs.repartition(5), dropout=0.2).select("doc_id", "ids").collect()
    assert some((r["doc_id"], tuple(r["ids"] or ())) for r in rows) == some((r["doc_id"], tuple(r["ids"] or ())) for r in again)
    back = piece_dropout.decode_pieces(out.select("doc_id", F.col("text").alias("t"), "ids")).collect()
    assert all(r["t"] == r["text"] for r in back)


def test_dropout_is_drawn_for_each_occurrence():
    codec = piece_dropout.PieceCodec(*piece_dropout.read_pieces(), 0.1, 17)
    n = 20_000
    text = " ".join(["a"] * n)  # ' a' has one candidate merge, which is two pieces when skipped
    ids = [np.frombuffer(codec.encode(text, k), dtype=np.int32) for k in range(3)]
    assert all(0.09 < len(x) / n - 1 < 0.11 for x in ids) and len({x.tobytes() for x in ids}) == 3
    assert all(codec.decode(x.tolist()) == text for x in ids)
    r = random.Random(7)
    for rate, seed in ((0.1, 1), (0.5, 2), (1.0, 3)):
        codec = piece_dropout.PieceCodec(*piece_dropout.read_pieces(), rate, seed)
        texts = [" ".join(r.choice(["internationalisation", "the", "x▁y", "b" * 60, "Ünïcode", "漢字", "  two", "1\n2"]) for _ in range(300)) for _ in range(4)]
        for k, (t, got) in enumerate(zip(texts, codec.encode_all(texts, [0, 1, 2, 3]), strict=True)):  # down the trees as by the agenda
            units = piece_dropout._UNIT.findall(" " + t)
            assert got == b"".join(codec.drawn(u, int(x)) for u, x in zip(units, codec.draws(k, len(units)), strict=True))
            assert codec.decode(got) == t
    ways = {codec.encode("internationalisation", k) for codec in [piece_dropout.PieceCodec(*piece_dropout.read_pieces(), 0.3, 5)] for k in range(40)}
    assert len(ways) > 4


def test_encode_pieces_gives_a_frequent_word_more_than_four_ways(spark):
    df = spark.createDataFrame([(1, " ".join(["internationalisation"] * 200))], "doc_id long, text string")
    got = piece_dropout.encode_pieces(df, dropout=0.3).first()["ids"]
    codec = piece_dropout.PieceCodec(*piece_dropout.read_pieces(), 0.0, 0)
    ways, way = set(), []
    for i in got:
        if way and codec.raw[i].startswith(b" "):
            ways.add(tuple(way))
            way = []
        way.append(i)
    assert len(ways) > 4


def by_hand(unit, key, limit, ranks, ids):
    """One unit's agenda as it is written down: the least rank first, from the left, each candidate skipped for good by its digest."""
    mask = (1 << 64) - 1
    parts, skipped = [(i, i + 1) for i in range(len(unit))], set()
    while True:
        can = []
        for (a, b), (_, e) in zip(parts, parts[1:], strict=False):
            x = (key + a * piece_dropout._START + b * piece_dropout._MIDDLE + e * piece_dropout._END) & mask
            if (((x ^ (x >> 29)) * piece_dropout._SCATTER & mask) >> 32) < limit:
                skipped.add((a, b, e))
            if unit[a:e] in ranks and (a, b, e) not in skipped:
                can.append((ranks[unit[a:e]], a, b, e))
        if not can:
            break
        _, a, b, e = min(can)
        parts = [(a, e) if p == (a, b) else p for p in parts if p != (b, e)]
    return [i for a, b in parts for i in ([ids[unit[a:b]]] if unit[a:b] in ids else [])]


@pytest.mark.parametrize("dropout", [0.1, 0.6])
def test_dropout_against_the_agenda_by_hand(dropout):
    ranks, ids, raw = piece_dropout.read_pieces()
    codec = piece_dropout.PieceCodec(ranks, ids, raw, dropout, 23)
    r = random.Random(5)
    text = " ".join(r.choice(["internationalisation", "the", "banana", "of", "misunderstandings", "w" * 40]) for _ in range(400))
    got = np.frombuffer(codec.encode(text, 77), dtype=np.int32).tolist()
    units = [u.replace(" ", piece_dropout.SPACE) for u in piece_dropout._UNIT.findall(" " + text)]
    want = [i for u, key in zip(units, codec.draws(77, len(units)).tolist(), strict=True) for i in by_hand(u, key, int(dropout * (1 << 32)), ranks, ids)]
    assert got == want


def test_two_models_in_one_worker_keep_apart(spark, monkeypatch):
    ranks, ids, raw = piece_dropout.read_pieces()
    few = {p: i for p, i in ids.items() if len(p) == 1}
    df = spark.createDataFrame([(1, "internationalisation of banana")], "doc_id long, text string").coalesce(1)
    whole = piece_dropout.encode_pieces(df, dropout=0.0).first()["ids"]
    monkeypatch.setattr(piece_dropout, "read_pieces", lambda _="": ({p: ranks[p] for p in few}, few, raw))
    single = piece_dropout.encode_pieces(df, dropout=0.0, check_out="back").first()
    monkeypatch.undo()
    assert len(single["ids"]) == len(" internationalisation of banana") > len(whole) and single["back"] == "internationalisation of banana"
    assert piece_dropout.encode_pieces(df, dropout=0.0).first()["ids"] == whole


# 3
def test_url_rules_against_all_combinations(spark):
    r = random.Random(3)
    pages = []
    for i in range(400):
        host = r.choice(["spam.shop.test", "news.test", "blog.news.test"])
        path = r.choice(["buy", "read", "de"])
        bad = host.startswith("spam") and path == "buy" and r.random() < 0.95 or r.random() < 0.05
        pages.append((i, f"https://{host}/{path}/{i}", bad))
    pages += [(900, None, False), (901, "no scheme", True), (902, "http://EXAMPLE.org/es/1?x=1#y", False), (903, "https://a.b.com/de/x", False), (904, "ftp://com", False)]
    df = spark.createDataFrame(pages, "page_id long, url string, bad boolean")
    tokens = df.select("page_id", url_rules.url_tokens(F.col("url")).alias("tokens"), "bad")
    rules = url_rules.mine_rules(tokens.select("tokens", "bad"), 0.02, 5, 0.7)
    have = {x["page_id"]: (frozenset(x["tokens"]), x["bad"]) for x in tokens.collect()}
    combos = Counter()
    for toks, _ in have.values():
        t = sorted(toks)
        for m in range(1, 1 << len(t)):
            combos[frozenset(x for k, x in enumerate(t) if m >> k & 1)] += 1
    good = Counter()
    for toks, bad in have.values():
        if bad:
            t = sorted(toks)
            for m in range(1, 1 << len(t)):
                good[frozenset(x for k, x in enumerate(t) if m >> k & 1)] += 1
    least = max(0.02, 5 / len(pages)) * len(pages)
    want = {c: good[c] / n for c, n in combos.items() if good[c] >= least and good[c] / n >= 0.7}
    want = {k: v for k, v in want.items() if not any(o < k and x >= v for o, x in want.items())}  # contained rules of no less confidence stand for them
    found = {frozenset(x["tokens"]): x["confidence"] for x in rules.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k]) for k in want) and found
    out = {x["page_id"]: x for x in url_rules.filter_urls(df, rules, url_rules.GIVEN).collect()}
    for i, (toks, _) in have.items():
        if out[i]["rule"] is None:
            assert (out[i]["verdict"] == "block") == any(c <= toks for c in want)
    assert (out[902]["host"], out[902]["path"], out[902]["rule"], out[902]["verdict"]) == ("example.org", "/es/1", "example.org/es/", "block")
    assert out[903]["rule"] == "com/de/" and out[904]["rule"] is None and out[900]["host"] == "" and out[901]["path"] == ""


# 4
def test_language_id_held_out_and_undetermined(spark, sf, docs):
    real = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.fit_language_model(real, usable=~language_id.held_out(2, 4))
    out = language_id.identify_language(real.where(language_id.held_out(2, 4)), model).collect()
    assert len(out) > 20 and sum(r["lang"] == r["lang_pred"] for r in out) / len(out) > 0.95
    odd = {r["text"]: (r["lang_pred"], r["score"]) for r in language_id.identify_language(docs, model).collect()}
    assert odd[None] == odd[""] == odd["12345 !!! ---"] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in odd.values())


def test_language_backoff_goes_to_shorter_grams():
    model = language_id.LanguageModel(["x", "y"], {"abc": (-1.0, -9.0)}, {"zz": (-9.0, -2.0), "z": (-5.0, -5.0)}, 4, 1.0)
    assert model.word("abc") == (-1.0, -9.0)
    langs, scores = model.predict(["abc abc", None, "12 ²", "zz zz abc", "zz"])
    assert langs == ["x", "und", "und", "y", "y"] and scores[1] == scores[2] == 0.0
    assert model.word("zz") == (-9.0, -2.0)  # by the pair, the marks being unknown
    assert model.word("zzz") == pytest.approx(((-9.0 * 2 - 5.0) / 3, (-2.0 * 2 - 5.0) / 3))


def test_language_against_word_by_word(spark, docs, raw, monkeypatch):
    """Every text by a plain reading of the model, long texts in pieces too; the sample holds each text once."""
    real = [(i, " ".join(random.Random(i).choice(pool.split()) for _ in range(40)), lang) for i in range(60) for lang, pool in (("en", "the cat and a dog went home"), ("de", "der hund und die katze gehen heim"))]
    df = spark.createDataFrame(real + [(999, real[0][1], "en")] * 50, "doc_id long, text string, lang string")
    model = language_id.fit_language_model(df)
    once = language_id.fit_language_model(df.dropDuplicates(["text"]))
    assert model.languages == ["de", "en"] and np.allclose(model.table, once.table) and model.grams.keys() == once.grams.keys() and all(model.word(w) == pytest.approx(once.word(w)) for w in ("xq", "hundkatze"))
    counts = {lang: Counter(w for text in {t for _, t, x in real if x == lang} for w in text.split()) for lang in ("de", "en")}
    known = {w: [np.log(c[w] / c.total() if w in c else 0.5 / c.total()) for c in counts.values()] for w in counts["de"] | counts["en"]}
    assert all(np.allclose(model.word(w), known[w]) for w in known)
    texts = [t for _, t, _ in real] + [r[1] for r in raw] + ["Der Cat " * 50 + "hundehome", "ÄÖ der", "ein Haus"]

    def by_hand(text):
        w = language_id._letters().findall((text or "").lower())
        if not w:
            return "und", 0.0
        means = np.array([model.word(x) for x in w]).mean(axis=0)
        p = np.exp(3.0 * means) / np.exp(3.0 * means).sum()
        return model.languages[int(p.argmax())], p.max()

    for piece in (1 << 20, 64):
        monkeypatch.setattr(model, "piece", piece)
        langs, scores = model.predict(texts)
        assert all(a == x and b == pytest.approx(y) for a, b, (x, y) in zip(langs, scores.tolist(), map(by_hand, texts), strict=True))


def test_many_languages_make_a_small_model(spark):
    """200 languages with words of their own: the model grows with the entries, not with items times languages."""
    r = random.Random(3)
    pools = {f"l{k:03}": ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)] for k in range(200)}
    rows = [(k * 10 + i, " ".join(r.choice(pool) for _ in range(30)), lang) for k, (lang, pool) in enumerate(pools.items()) for i in range(5)]
    model = language_id.fit_language_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    of = (model.of_words, model.of_grams)
    assert len(model.languages) == 200 and sum(x.nbytes for x in of) < 2_000_000 < sum(len(x.starts) * 200 * 8 for x in of) / 10
    langs, scores = model.predict([t for _, t, _ in rows])
    assert langs == [x for _, _, x in rows] and scores.min() > 0.5


def test_languages_beyond_the_bound_teach_nothing(spark):
    df = spark.createDataFrame([(i, "word", f"l{i % 5}") for i in range(11)], "doc_id long, text string, lang string")
    assert language_id.fit_language_model(df, max_languages=3).languages == ["l0", "l1", "l2"]


# 5
def test_quality_model_tells_planted_junk(spark, docs):
    r = random.Random(7)
    word = lambda: "".join(r.choice("aeioulmnrst") for _ in range(r.randint(2, 8)))
    texts = [(i, " ".join(word() + ("!!" if i % 3 == 0 and r.random() < 0.5 else "") for _ in range(60)), int(i % 3 != 0)) for i in range(300)]
    df = spark.createDataFrame(texts, "doc_id long, text string, quality int")
    model = quality_model.fit_quality_model(df.drop("quality"), df.drop("text").where("doc_id < 200"))
    out = {x["doc_id"]: x["score"] for x in quality_model.score_quality(df, model).collect()}
    assert all((out[i] >= 0.5) == bool(q) for i, _, q in texts[200:])
    odd = quality_model.score_quality(docs, model).collect()
    assert all(0 <= x["score"] <= 1 for x in odd) and odd[0]["score"] is not None


def test_features_and_scores_by_hand(raw):
    """Every word and n-gram of every text is a feature once an occurrence; a score is the softmax of the layer on the mean vector."""
    import pyarrow as pa

    texts = [r[1] for r in raw] + ["a bb ccc dddd", " xyz ", "ab\ncd"]
    state = np.random.RandomState(4)
    model = quality_model.SubwordModel(state.normal(size=(512, 5)), state.normal(size=(2, 6)), (3, 4))
    got = model.scores(pa.array(texts))
    known = {}
    for t, score in zip(texts, got.tolist(), strict=True):
        words_ = split(t)
        chars = "".join(" " if ch in WS else ch for ch in t or "")
        grams = [chars[i : i + n] for n in (3, 4) for i in range(len(chars) - n + 1) if " " not in chars[i + 1 : i + n - 1]]
        raw_, at = np.frombuffer((t or "").encode(), dtype=np.uint8), np.array([0, len((t or "").encode())])
        bucket, row = quality_model.features(raw_, at, 512, (3, 4))
        assert len(bucket) == len(words_) + len(grams) and not row.any()
        for name, b in zip([*words_, *[("g", g) for g in grams]], bucket.tolist(), strict=True):
            assert known.setdefault(name, b) == b  # one feature, one bucket
            assert (b < 256) == isinstance(name, bytes)
        mean = model.vectors[bucket].mean(axis=0) if len(bucket) else np.zeros(5)
        out = model.layer @ np.append(mean, 1.0)
        assert score == pytest.approx(np.exp(out[1]) / np.exp(out).sum())


def test_a_step_of_descent_follows_the_gradient():
    """One row, one pass: vectors and layer move by the rate against the numerical gradient of the log loss."""
    from types import SimpleNamespace

    import pyarrow as pa

    state = np.random.RandomState(2)
    vectors, layer = state.normal(size=(6, 3)).astype(np.float32), state.normal(size=(2, 4)).astype(np.float32)
    shard = pa.table({"label": pa.array([1], pa.int32()), "buckets": pa.array([[0, 4]], pa.list_(pa.int32())), "counts": pa.array([[3.0, 1.0]], pa.list_(pa.float32()))})
    out = quality_model._descend(SimpleNamespace(value=(vectors, layer)), 0.1, 0, 1)(shard)
    new_v = np.frombuffer(out.column("vectors")[0].as_py(), dtype=np.float32).reshape(6, 3)
    new_l = np.frombuffer(out.column("layer")[0].as_py(), dtype=np.float32).reshape(2, 4)

    def loss(v, w):
        z = w @ np.append(0.75 * v[0] + 0.25 * v[4], 1.0)
        return np.log(np.exp(z).sum()) - z[1]

    for now, new, at in ((vectors, new_v, 0), (layer, new_l, 1)):
        for i in np.ndindex(*now.shape):
            ends = []
            for d in (1e-4, -1e-4):
                args = [vectors.astype(float), layer.astype(float)]
                args[at] = args[at].copy()
                args[at][i] += d
                ends.append(loss(*args))
            assert new[i] - now[i] == pytest.approx(-0.1 * (ends[0] - ends[1]) / 2e-4, abs=2e-4)


# 6
def test_mixture_comes_near_its_targets(spark, docs, raw):
    rows = mixing.mix_sources(docs).collect()
    assert len(rows) == len(raw) and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert some((r["doc_id"], r["size"]) for r in rows) == some((r[0], len(split(r[1]))) for r in raw)
    total = sum(r["size"] for r in rows)
    targets = {r["source"]: (r["target"], r["source_size"]) for r in rows}
    assert sum(t for t, _ in targets.values()) == pytest.approx(total)
    names = sorted((s for s in targets if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    want, capped = {}, set()
    while True:  # share again until none is above its limit
        left = total - sum(3 * targets[s][1] for s in capped)
        free = [s for s in names if s not in capped]
        share = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if share * weight[s] > 3 * targets[s][1]}
        if not over:
            want = {s: 3 * targets[s][1] if s in capped else share * weight[s] for s in names}
            break
        capped |= over
    assert all(targets[s][0] == pytest.approx(want[s]) for s in names)
    again = mixing.mix_sources(docs.repartition(7)).collect()
    key = lambda x: (x["doc_id"], x["text_key"], x["taken"])
    assert some(map(key, rows)) == some(map(key, again))


def test_mixture_of_many_documents(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(5 + id % 40 as int))").alias("text"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"))
    by = defaultdict(lambda: [0, 0.0])
    for r in mixing.mix_sources(df).collect():
        by[r["source"]][0] += r["taken"]
        by[r["source"]][1] = r["target"]
    assert all(abs(a - b) <= 45 for a, b in by.values())


def test_mixture_hangs_on_no_partition_and_longer_texts_are_likelier(spark):
    texts = [(None if i % 2 else 5, f"w{i} x y z", "a") for i in range(40)] + [(7, "same words here", "a")] * 25 + [(i, "q " * 30, "b") for i in range(100, 140)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    picks = [some((r["doc_id"], r["text_key"], r["source"], r["taken"]) for r in mixing.mix_sources(df.repartition(n)).collect()) for n in (1, 3, 7)]
    assert picks[0] == picks[1] == picks[2] and len(picks[0]) == len(texts)
    assert len({t for i, _, s, t in picks[0] if s == "a" and i != 7}) > 1  # rows of one id draw apart
    many = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(1 + id % 97 as int))").alias("text"), F.concat(F.lit("s"), F.col("id") % 3).alias("source"))
    by, words_of, chosen = defaultdict(dict), Counter(), Counter()
    for r in mixing.mix_sources(many).collect():
        by[r["source"]][r["size"]] = r["inclusion"]
        words_of[r["source"]] += r["inclusion"] * r["size"]
        need = r["target"] - r["target"] // r["source_size"] * r["source_size"]
        by[r["source"], "need"] = {0: need}
        chosen[r["source"]] += r["copies"] * r["size"]
        assert r["taken"] <= 3 * r["size"]
        by[r["source"], "target"] = {0: r["target"]}
    for s in ("s0", "s1", "s2"):
        p = [x for _, x in sorted(by[s].items())]
        assert p == sorted(p) and words_of[s] == pytest.approx(by[s, "need"][0]) and abs(chosen[s] - by[s, "target"][0]) <= 97
    assert any(len(set(by[s].values())) > 10 for s in ("s0", "s1", "s2"))


# 7
@pytest.mark.parametrize("block", [16, 4096])
def test_top_k_is_exact(spark, block):
    state = np.random.RandomState(8)
    x = state.normal(size=(300, 12)).astype(np.float32)
    x[50] = x[51] = x[52]
    rows = [(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(1000, None), (1001, [1.0, None]), (1002, [float("nan")]), (1003, [float("inf")] * 12), (1004, [0.5, 0.25]), (20, [9.0] * 12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.exact_top_k(df, F.col("vec_id") % 50 == 0, block=block, query_block=3, slack=2).collect()
    sound = [(i, np.floor(1024 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v in rows if i not in (1000, 1001, 1002, 1003)]
    dot = lambda a, b: int((a[: min(len(a), len(b))] * b[: min(len(a), len(b))]).sum())
    want = []
    for q, v in sound:
        if q % 50 == 0:
            best = sorted((-dot(v, w), i) for i, w in sound if i != q)[:10]
            want += [(q, k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_the_index_rules_out_most_rows_of_a_given_table(spark):
    """How many rows of the given vectors are scored, with the query's own settings, and that none of the best is lost."""
    rows = topk.integer_vectors(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding", 1024).orderBy("id").toArrow()
    v = np.stack(rows.column("v").to_numpy())
    index, scored = topk.ImpactIndex(v, 64), []
    for q in range(0, len(v), 100):
        can = index.possible(v[q], 11, 8)
        score = v @ v[q]
        assert set(np.flatnonzero(score >= np.sort(score)[-11])) <= set(can)
        scored.append(len(can) / len(v))
    assert len(v) >= 1900 and np.mean(scored) < 0.2
    print(f"scored {np.mean(scored):.3f}")


# 8
def test_statistics_of_quality_rules(docs, raw):
    got = some(tuple(r) for r in weak_rules.statistics(docs).select("id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = []
    for r in raw:
        text, w = r[1] or "", split(r[1])
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        cover = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in text.split("\n") if x.strip(WS)]
        want.append((r[0], len(w), len(b"".join(w).decode()), sum(text.count(x) for x in "#*$%&|<>"), len(lines) - len(set(lines)), len(cover)))
    assert got == some(want)


def test_votes_find_the_accuracies_of_planted_rules(spark):
    r = random.Random(9)
    rows = []
    for _ in range(4000):
        good = r.random() < 0.8
        rows.append(tuple((0 if r.random() < 0.2 else (-1 if r.random() < (0.01 if good else 0.6) else 1)) for _ in range(5)))
    names = [f"r{i}" for i in range(5)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names))
    prior, table = weak_rules.fit_votes(df.groupBy(*names).count().withColumnRenamed("count", "n"), names, 25)
    assert abs(prior - 0.8) < 0.05
    assert all(abs(t[-1, -1] - 0.6) < 0.12 and t[1, -1] < 0.06 for t in table.values())


def test_posterior_against_expectation_maximisation_by_hand(spark, docs):
    rules = weak_rules.default_rules()
    rows = weak_rules.weak_quality(docs, rounds=6).select(*rules, "posterior").collect()
    votes = np.array([[r[n] for n in rules] for r in rows])
    prior, p = 0.8, {(k, v): np.full(votes.shape[1], weak_rules.START[k, v]) for k in (1, -1) for v in (1, -1)}

    def good():
        like = {k: np.where(votes == 1, p[k, 1], np.where(votes == -1, p[k, -1], 1.0)).prod(axis=1) for k in (1, -1)}
        return prior * like[1] / (prior * like[1] + (1 - prior) * like[-1])

    for _ in range(6):
        g = good()
        prior = min(0.999, max(0.001, g.mean()))
        for k, w in ((1, g), (-1, 1 - g)):
            n = {v: ((votes == v) * w[:, None]).sum(axis=0) + weak_rules.START[k, v] for v in (1, -1)}
            for v in (1, -1):
                p[k, v] = n[v] / (n[1] + n[-1])
    assert np.allclose(good(), [r["posterior"] for r in rows])


# 9
@pytest.mark.parametrize(("length", "k"), [(50, 24), (8, 3)])
def test_substring_dedup(docs, raw, length, k):
    first = {}
    for r in raw:
        w = split(r[1])
        for i in range(len(w) - length + 1):
            if r[0] is not None:
                key = tuple(w[i : i + length])
                first[key] = min(first.get(key, r[0]), r[0])
    want = []
    for r in raw:
        w = split(r[1])
        gone = {j for i in range(len(w) - length + 1) if r[0] is not None and first[tuple(w[i : i + length])] < r[0] for j in range(i, i + length)}
        want.append((r[0], len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
    got = substring_dedup.substring_dedup(docs, length=length, k=k).collect()
    assert some((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in got) == some(want)
    assert any(r["n_removed"] for r in got)


def test_paths_hold_the_words_of_their_sources(docs, raw):
    _, _, spans = substring_dedup.repeated_paths(docs, length=20, k=8)
    texts = defaultdict(list)
    for r in raw:
        texts[r[0]].append(split(r[1]))
    rows = spans.collect()
    assert rows
    for p in rows:
        assert min(x["at"] for x in p["segments"]) == p["start"] and max(x["at"] + x["n"] for x in p["segments"]) == p["end"]
        for x in p["segments"]:
            own = [w[x["at"] : x["at"] + x["n"]] for w in texts[p["doc"]]]
            sources = [w[x["source_start"] : x["source_start"] + x["n"]] for w in texts[x["source_doc"]]]
            assert x["source_doc"] < p["doc"] and any(o in sources for o in own)


def test_nonbranching_paths_of_different_sources_become_one(spark):
    """Document 3 repeats a stretch of 1 that goes on as a stretch of 2; a branch cuts a path, a circle has an end."""
    w = words(31, 90).split()
    texts = [(1, w[:60]), (2, w[30:]), (3, w), (4, w[:25] + words(32, 30).split()), (5, w[:25]), (6, (words(33, 6).split() * 9)[:50]), (7, (words(33, 6).split() * 9)[3:47])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts], "doc_id long, text string")
    keyed, runs, spans = substring_dedup.repeated_paths(df, length=10, k=4)
    edges = defaultdict(set)
    for i, t in texts:
        for p in range(len(t) - 9):
            edges[tuple(t[p : p + 10])].add(i)
    graph = {e for e, held in edges.items() if len(held) > 1}
    into, out = Counter(e[1:] for e in graph), Counter(e[:-1] for e in graph)
    lengths = []  # of the nonbranching paths, circles left out
    for e in graph:
        if not (into[e[:-1]] == 1 and out[e[:-1]] == 1):
            n = 1
            while into[e[1:]] == 1 and out[e[1:]] == 1:
                e = next(f for f in graph if f[:-1] == e[1:])
                n += 1
            lengths.append(n)
    got = defaultdict(int)
    for r in runs.collect():
        got[(r["path_doc"], r["path_run"])] += r["n_edges"]
    assert sum(got.values()) == len(graph)
    circle = len(graph) - sum(lengths)
    assert circle == 6 and sorted(got.values()) == sorted([*lengths, circle])
    assert any(len({r["source_doc"] for r in p}) == 2 for p in [[x for x in runs.collect() if (x["path_doc"], x["path_run"]) == k] for k in got])
    third = [r for r in spans.collect() if r["doc"] == 3]
    assert len(third) < sum(len(r["segments"]) for r in third)


def test_words_at_the_source_are_compared(spark):
    """A source whose words are others than the digests say loses nothing."""
    df = spark.createDataFrame([(1, words(41, 30)), (2, words(41, 30) + " end")], "doc_id long, text string")
    keyed, runs, spans = substring_dedup.repeated_paths(df, length=10, k=4)
    wrong = keyed.withColumn("text", F.when(F.col("doc") == 1, F.lit(words(42, 30))).otherwise(F.col("text")))
    for source, gone in ((keyed, 30), (wrong, 0)):
        checks = substring_dedup.source_words(source, runs, spans, 10).collect()
        clean = spark.createDataFrame(checks, "doc long, checks array<struct<tag:int,at:int,skip:int,n:int,words:string>>")
        rows = keyed.join(clean, "doc", "left").select("doc", "tag", "text", "copy", "checks", F.array("tag").alias("paths"))
        out = rows.mapInArrow(substring_dedup._clean(10), "doc long, n_words long, n_removed long, kept string, n_paths long").collect()
        assert {r["doc"]: r["n_removed"] for r in out} == {1: 0, 2: gone}


# 10
def shingles(text):
    w = split(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_links(texts):
    sets = [shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(texts)):
        groups[find(i)].append(texts[i][0])
    low = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    return [(texts[i][0], low[find(i)] if low[find(i)] is not None else texts[i][0], links[i]) for i in range(len(texts))]


@pytest.mark.parametrize("block", [512, 2])
def test_near_duplicates(docs, raw, block):
    got = jaccard_join.near_duplicates(docs, block=block).select("doc_id", "class_id", "n_links").collect()
    assert some(tuple(r) for r in got) == some(brute_links([(r[0], r[1]) for r in raw]))


def test_near_duplicates_of_a_large_group(spark):
    r = random.Random(11)
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(120):
        w = list(base)
        for _ in range(r.randint(0, 4)):
            w[r.randrange(150)] = f"x{r.randrange(10**6)}"
        texts.append((i, " ".join(w)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    want = some(brute_links(texts))
    for options in ({"block": 32}, {"bucket_block": 10}):
        got = jaccard_join.near_duplicates(df, **options).select("doc_id", "class_id", "n_links").collect()
        assert some(tuple(x) for x in got) == want


def test_classes_shorten_their_prefixes_until_their_own_recall(spark):
    rows = [("b1", 0, b"aaaaBBBB", b"x"), ("b1", 0, b"aaaaBBBB", b"y"), ("b1", 0, b"aaaaCCCC", b"z"), ("b1", 0, b"ddddCCCC", b"w"), ("b2", 0, b"aaaaBBBB", b"x"), ("b2", 0, b"aaaaBBBC", b"z"), ("b2", 1, b"aaaaBBBB", b"y")]
    df = spark.createDataFrame(rows, "bucket string, part int, branch binary, print binary")
    got = {bytes(r["print"]): r["depth"] for r in jaccard_join.own_depths(df, 4, 6, {6: 1, 5: 2}).collect()}
    assert got == {b"x": 6, b"y": 6, b"z": 5, b"w": 4}
    enough = jaccard_join.enough_trees(0.8, 16, 4, 6, 0.999)
    assert enough == {6: 5, 5: 6} and all(1 - (1 - 0.8**d) ** 32 >= 0.999 for d in enough)


def test_recall_on_the_given_table(spark):
    """All pairs of 0.8 and more of a whole table, by the shingles they share."""
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = [tuple(r) for r in real.collect()]
    sets, holders, both = {}, defaultdict(list), Counter()
    for i, t in texts:
        sets[i] = shingles(t)
        for x in sets[i]:
            both.update((j, i) for j in holders[x])
            holders[x].append(i)
    want = {p for p, n in both.items() if n / (len(sets[p[0]]) + len(sets[p[1]]) - n) >= 0.8}
    got = {r["doc_id"]: r for r in jaccard_join.near_duplicates(real).collect()}
    links = Counter(i for p in want for i in p)
    met = sum(got[a]["class_id"] == got[b]["class_id"] for a, b in want)
    assert len(want) > 50 and met / len(want) >= 0.9
    assert all(r["n_links"] <= links[i] for i, r in got.items()) and sum(r["n_links"] for r in got.values()) >= 0.9 * 2 * len(want)
    print(f"recall {met} of {len(want)}")


def test_forest_depth_is_the_longest_that_reaches_the_recall():
    d = jaccard_join.forest_depth(0.8, 16, 6, 0.999)
    assert 1 - (1 - 0.8**d) ** 16 >= 0.999 > 1 - (1 - 0.8 ** (d + 1)) ** 16


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_hot_keys_go_apart_and_nothing_changes(spark, monkeypatch, how):
    monkeypatch.setattr(common, "HOT_KEYS", 2)
    left = spark.createDataFrame([(k, i) for k, n in (("a", 50), ("b", 9), ("c", 3), ("d", 1), (None, 4)) for i in range(n)], "k string, i int")
    right = spark.createDataFrame([("a", 50, "x"), ("b", 9, "y"), ("c", 3, "z"), ("e", 0, "w")], "k string, n int, v string")
    got = common.join_hot_apart(left, right, "k", "n", how)
    want = left.join(right.drop("n"), "k", how)
    assert some(map(tuple, got.select(want.columns).collect())) == some(map(tuple, want.collect()))
    assert common.join_hot_apart(left.limit(0), right, "k", "n", how).count() == 0


def test_a_checkpoint_frees_its_shuffles_and_leaves_the_session_as_it_was(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    assert common.durable(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()).count() == 7
    assert spark.conf.get(key, None) == before
    spark.conf.set(key, "false")
    common.durable(spark.range(3))
    assert spark.conf.get(key) == "false"
    spark.conf.unset(key)


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 150)] + [(7, 7)]
    df = spark.createDataFrame(edges, "x long, y long").select(F.md5(F.col("x").cast("string")).alias("a"), F.md5(F.col("y").cast("string")).alias("b"))
    names = {r["h"]: r["i"] for r in spark.range(200).select(F.col("id").alias("i"), F.md5(F.col("id").cast("string")).alias("h")).collect()}
    got = {names[r["node"]]: r["component"] for r in connected_components(df).collect()}
    assert {got[i] for i in range(1, 41)} == {min(h for h, i in names.items() if 1 <= i <= 40)}
    assert {got[i] for i in range(100, 150)} == {min(h for h, i in names.items() if 100 <= i < 150)}


def test_near_copies_without_ids_or_of_one_id_cost_what_others_do(spark):
    import time

    base = words(77, 120).split()

    def table(of):
        texts = [" ".join([*base[: i % 100], f"w{i}", *base[i % 100 :]]) for i in range(1600)] + [" ".join(base)] * 400
        return spark.createDataFrame([(of(i), t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)

    took = {}
    for name, of in (("own", lambda i: i), ("none", lambda i: None), ("one", lambda i: 7)):
        began = time.time()
        found = jaccard_join.near_duplicates(table(of)).groupBy("class_id").agg(F.count("*").alias("n"), F.min("n_links").alias("low"), F.max("n_copies").alias("copies")).collect()
        took[name] = time.time() - began
        assert [(r["n"], r["low"], r["copies"]) for r in found] == [(2000, 1999, 400)]
    assert took["none"] < 3 * took["own"] + 5 and took["one"] < 3 * took["own"] + 5
