"""Merkle manifests, phrases and chat formats on nulls, ties, repeated rows, hot groups, empty tables and clashing names, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkprep.llm import chat_format, merkle, phrases
from tests.llm.conftest import CLASHING


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11
def told(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def up(nodes):
    """Levels of a tree, from nodes to the last one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def way(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])))
        at //= 16
    return out


def brute_manifest(rows):
    """(id, source, leaf) -> sorted list of (leaf, position, path, subroot, root)."""
    groups = defaultdict(list)
    for doc, source, leaf in rows:
        groups[source].append(((doc is not None, doc or 0), leaf, doc))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: up([leaf for _, leaf, _ in sorted(groups[s], key=lambda r: r[:2])]) for s in names}
    top = up([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, leaf, doc) in enumerate(sorted(groups[s], key=lambda r: r[:2])):
            out.append((doc, s, leaf, i, way(trees[s], i) + way(top, k), trees[s][-1][0], top[-1][0]))
    return out


def manifest_rows(df, doc="doc_id", source="source"):
    return [(r[doc], r[source], r["leaf"], r["position"], [tuple(x) for x in r["path"]], r["subroot"], r["root"]) for r in df.collect()]


def by_text(rows):
    return sorted(rows, key=repr)


def test_manifest_of_odd_rows(docs, raw):
    leaf = merkle.field_digest(*[F.col(x) for x in ("doc_id", "source", "lang", "n_chars", "text")])
    found = merkle.merkle_manifest(docs.withColumn("leaf", leaf), "source", "doc_id", "leaf")
    want = brute_manifest([(r[0], r[3], sha("".join(told(x) for x in (r[0], r[3], r[2], r[4], r[1])))) for r in raw])
    assert by_text(manifest_rows(found)) == by_text(want)
    assert set(docs.columns) <= set(found.columns) and all(r["id"] == "id" for r in found.select("id").collect())
    folded = found.select((merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("same"), (merkle.fold(F.sha2("leaf", 256), F.col("path")) == F.col("root")).alias("other"))
    assert {(r["same"], r["other"]) for r in folded.collect()} == {(True, False)}


def test_manifest_of_a_hot_source_and_of_many_sources(spark):
    rows = [(i, "hot" if i % 3 else f"s{i:05d}", sha(str(i))) for i in range(5000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string").repartition(7)
    assert by_text(manifest_rows(merkle.merkle_manifest(df, "source", "doc_id", "leaf"))) == by_text(brute_manifest(rows))


@pytest.mark.parametrize("n", [0, 1, 17])
def test_manifest_sizes_of_one_source(spark, n):
    rows = [(i, None, sha(str(i))) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, leaf string")
    found = manifest_rows(merkle.merkle_manifest(df, "source", "doc_id", "leaf"))
    assert by_text(found) == by_text(brute_manifest(rows))
    if n == 1:
        assert found[0][4] == [] and found[0][6] == found[0][2]


def test_manifest_query_verifies_what_was_not_changed(spark, sf):
    rows = {r["doc_id"]: r for r in merkle.op11_merkle_manifest(spark, sf).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    assert set(rows) == set(texts)
    for doc, r in rows.items():
        changed = zlib.crc32(str(doc).encode()) % 5 == 0 and bool(re.search("[A-Z]", texts[doc] or ""))
        assert r["verified"] is not changed and (r["folded_root"] == r["root"]) is r["verified"]


# 12
def brute_phrases(rows, least, most_words, percent, scale, first):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        low = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang or "und"] += len(words)
            for m in range(1, most_words + 1):
                for i in range(len(words) - m + 1):
                    f[lang or "und"][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: c for p, c in counts.items() if c >= least and len(p) > 1}
        rows = []
        for p, a in often.items():
            inside = lambda q, p=p: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            if any(len(q) > len(p) and 100 * c >= percent * a and inside(q) for q, c in often.items()):
                continue
            score, k = min((scale * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:first])]
    return sorted(out)


def phrase_rows(df):
    return sorted(tuple(r[x] for x in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def spoken(seed, n):
    r = random.Random(seed)
    vocabulary = ["the", "The", "of", "new york", "ünï", "漢字", "a-b", "x", "in the end", "x x x", " ", "night  sky", "<>"]
    ends = ["", "", "", ",", ".", "\n", " . ", "!?", "\r\n", ":", "\t"]
    return [("".join(r.choice(vocabulary) + r.choice(ends) + " " for _ in range(r.randint(0, 40))), r.choice(["en", "de", None, "und"])) for _ in range(n)]


@pytest.fixture(scope="module")
def talk(spark):
    rows = [*spoken(3, 150), (None, "en"), ("", "en"), ("...", "de"), ("the x " * 5000, "en"), ("lone", "fr"), ("lone", "fr")]
    return rows, spark.createDataFrame([(t, lang, *CLASHING) for t, lang in rows], ["text", "lang", *CLASHING][: 2 + len(CLASHING)]).repartition(5)


@pytest.mark.parametrize(("least", "most_words", "first"), [(5, 4, 2000), (2, 3, 7), (30, 4, 20), (1, 2, 2000), (300, 4, 2000)])
def test_phrases_equal_brute_force(talk, least, most_words, first):
    rows, df = talk
    assert phrase_rows(phrases.phrases(df, min_count=least, max_words=most_words, per_language=first)) == brute_phrases(rows, least, most_words, 80, 2_000_000, first)


def test_phrases_do_not_hang_on_the_filter_segments_or_what_tasks_hold(talk, monkeypatch):
    rows, df = talk
    want = brute_phrases(rows, 5, 4, 80, 2_000_000, 2000)
    monkeypatch.setattr(phrases, "SEGMENT_BYTES", 9000)  # stripes of several segments
    monkeypatch.setattr(phrases, "SHARDS", 3)
    monkeypatch.setattr(phrases, "HELD", 200)  # many small stripes to merge
    assert phrase_rows(phrases.phrases(df, min_count=5)) == want
    monkeypatch.setattr(phrases, "LEAST_BITS", 17)
    monkeypatch.setattr(phrases, "MOST_BITS", 17)
    monkeypatch.setattr(phrases, "_frequent_buckets", lambda _, bits, *__: b"\xff" * (1 << (bits - 3)))  # a filter that lets all pass
    assert phrase_rows(phrases.phrases(df, min_count=5)) == want


def test_phrases_of_nothing(spark):
    for rows in ([], [(None, None)], [(" . ", "en")], [("one", "en")]):
        assert phrases.phrases(spark.createDataFrame(rows, "text string, lang string"), min_count=1).count() == 0


def test_stripes_give_counts_totals_and_maxima(spark):
    df = spark.createDataFrame([("a b. a c, a b c", "en"), ("a a b c. b x", "en")], "text string, lang string")
    found, total = defaultdict(dict), Counter()
    for r in phrases.stripes(df, min_count=2).collect():
        found[r["prefix"]] |= dict(zip(r["nexts"], zip(r["counts"], r["right"], strict=True), strict=True))
        total[r["prefix"]] += r["total"]
    assert found == {None: {"a": (5, 0), "b": (4, 0), "c": (3, 0)}, "a": {"b": (3, 2), "b c": (2, 0)}, "b": {"c": (2, 0)}} and total[None] == 13
    with pytest.raises(ValueError, match="words"):
        phrases.stripes(df, max_words=5)


# 13
@given(st.text(alphabet="<|\\>im_endstart é🎉\n", max_size=30))
def test_escapes_come_back_and_hide_all_marks(text):
    assert chat_format.unescape(chat_format.escape(text)) == text
    assert "<|" not in chat_format.escape(text)


def talks():
    odd = ["", None, " ", "\n", "<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<", "|im_sep|>", "ends with <", "<|endoftext|>", "ünïcode 漢字 🎉👩‍👩‍👧 ▁", "  lead and trail  ", "!?<|", "<\\\\|", "a" * 5000, "\r\n\t x"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(odd)]
    rows += [(2, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(odd)]
    rows += [(None, 0, "assistant", "no id"), (None, None, None, "no turn or role"), (3, 0, "assistant", "same"), (3, 0, "assistant", "same"), (3, 0, "assistant", "other"), (4, 0, "user", "nothing to learn"), (5, 0, "<|im_start|>", "<")]
    rows += [(100 + i % 40, i // 40, "assistant" if i // 40 % 2 else "user", f"text {i} <|im_end|>" + "x" * (i % 7)) for i in range(400)]
    rows += [(77, i, "assistant" if i % 2 else "user", f"hot {i}") for i in range(300)]  # a third of all rows
    return rows


def brute_chats(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    out = {}
    for conv, turns in convs.items():
        turns = [(r, t) for _, r, t in sorted(turns)]
        loss = "".join(t for r, t in turns if r == "assistant")
        rendered = "".join(f"<|im_start|>{chat_format.escape(r)}<|im_sep|>{chat_format.escape(t)}<|im_end|>" for r, t in turns)
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(rendered))
    return out


@pytest.fixture(scope="module")
def chats(spark):
    extra = ("part", "ids", "formatted", "alone")
    df = spark.createDataFrame([(*r, *extra) for r in talks()], "conv_id long, turn long, role string, text string, part string, ids string, formatted string, alone string")
    return df.repartition(6)


@pytest.mark.parametrize("part_chars", [1 << 21, 400])
def test_formatted_conversations_read_back(chats, part_chars):
    parts = chat_format.format_chats(chats, part_chars=part_chars)
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) for r in chat_format.conversation_digests(parts).collect()}
    assert found == brute_chats(talks())


def test_parts_are_cut_where_the_encoder_cuts_and_masks_hold_whole_tokens(chats):
    whole, cut = defaultdict(list), defaultdict(list)
    for out, part_chars in ((whole, 1 << 21), (cut, 100)):
        for r in sorted(chat_format.format_chats(chats.where("conv_id is not null").coalesce(1), part_chars=part_chars).collect(), key=lambda r: (r["conv_id"], r["part"])):
            out[r["conv_id"]].append(r)
    assert sum(map(len, cut.values())) > sum(map(len, whole.values()))
    for conv, parts in whole.items():
        for field in ("ids", "loss_mask", "formatted"):
            join = lambda rows, field=field: "".join(r[field] for r in rows) if field == "formatted" else [x for r in rows for x in r[field]]
            assert join(parts) == join(cut[conv])


def test_a_token_over_a_turns_end_is_an_error():
    offsets = np.array([[0, 4], [4, 9]])
    assert chat_format.span_mask(offsets, [(4, 9)]).tolist() == [False, True]
    with pytest.raises(ValueError, match="turn"):
        chat_format.span_mask(offsets, [(5, 9)])


def test_no_conversations(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.conversation_digests(chat_format.format_chats(empty)).count() == 0
