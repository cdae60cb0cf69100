"""Language, tokens, mixing, packing, quality, preferences and archive records: plain versions and odd inputs."""

import collections
import itertools
import random
from pathlib import Path

import numpy as np
import plain
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from muster.llm import bpe_count, chat, flat, langid, mixing, packing, quality, warc
from muster.session import work_folder

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\t", "ab", "ÉÈ é", "日本 語", "a b　c", "😀 😀", "x" * 5000, "a  b", "<s> x </s>", "▁▁ a", "a\x00b", "\r\n\x0b"]


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = [t for t in ODD if t is not None] + ["".join(rng.choice("aBé \n\t\x0b\x0c\r 日") for _ in range(rng.randint(0, 40))) for _ in range(300)]
    found = flat.words(pa.array(texts))
    names = {}
    for k, text in enumerate(texts):
        own = found.names[found.offsets[k] : found.offsets[k + 1]].tolist()
        assert len(own) == len(plain.words(text))
        for word, name in zip(plain.words(text), own):
            assert names.setdefault(word, name) == name
    assert len(set(names.values())) == len(names)
    lower = flat.words(pa.array([t.translate(plain.LOWER) for t in texts]))
    assert (flat.words(pa.array(texts), lower=True).names == lower.names).all()


def test_slices_hold_every_row_once():
    texts = pa.array(["a" * n for n in (0, 3, 10, 1, 1, 0, 50, 2)] + [None])
    for most, rows in itertools.product((1, 4, 1000), (1, 3, 100)):
        parts = list(flat.slices(texts, most, rows))
        assert [x for _, p in parts for x in p.to_pylist()] == [x or "" for x in texts.to_pylist()]
        assert [r for r, _ in parts] == [0, *np.cumsum([len(p) for _, p in parts])[:-1].tolist()]


def test_token_counts_are_those_of_the_library():
    library, own = sentencepiece.SentencePieceProcessor(model_file=MODEL), bpe_count.Counter(MODEL)
    rng = random.Random(2)
    texts = [t for t in ODD if t is not None]
    texts += ["".join(rng.choice("abtheinor  \n▁é½<s>0x41.,!日本😀\x00") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [" ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 12))) for _ in range(400)), "ab" * 20_000, " " * 1000]
    assert [own.tokens(t) for t in texts] == [len(x) for x in library.encode(texts)]
    assert max(map(len, own)) <= bpe_count.LONGEST_KEPT


def test_kept_parts_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe_count, "KEPT_PARTS", 5)
    own, library = bpe_count.Counter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = " ".join(f"word{i}" for i in range(100))
    assert own.tokens(text) == len(library.encode(text)) and len(own) <= 5


def test_token_count_column(spark):
    rows = spark.createDataFrame([(t,) for t in ODD], "text string").select("text", bpe_count.token_count(F.col("text"), MODEL).alias("n")).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert all(r["n"] == len(library.encode(r["text"] or "")) for r in rows)


def test_language_is_learned_and_held_out(spark):
    rng = random.Random(3)
    syllables = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["schn", "gor", "ü", "bel"], "zz": ["que", "é", "lion", "ai"]}
    make = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(20))
    rows = [(i, make(lang), lang, "x", 0.5) for i, lang in enumerate(["xx", "yy", "zz"] * 40)] + [(900, None, "xx", "x", 1.0), (901, make("xx"), None, "x", 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score double")
    model = langid.fit(df.where("doc_id % 4 != 0"))
    got = {r["doc_id"]: r for r in langid.predict(df, model).collect()}
    assert len(got) == len(rows) and df.columns == ["doc_id", "text", "lang", "lang_pred", "score"]
    assert all(got[i]["lang_pred"] == lang and 0.9 < got[i]["score"] <= 1 for i, t, lang, *_ in rows if t and lang)
    assert (got[900]["lang_pred"], got[900]["score"]) == ("und", 0.0)
    few = spark.createDataFrame([("12 34 !!",), ("",), (None,), ("é",)], "text string")
    assert [r["lang_pred"] for r in langid.predict(few, model).collect()] == ["und", "und", "und", "zz"]
    empty = langid.fit(df.where("false"))
    assert {r["lang_pred"] for r in langid.predict(few, empty).collect()} == {"und"}


def test_language_scores_equal_plain_sums():
    texts = pa.array(["Ab1 cé", "é", "b" * 3000])
    rng = np.random.default_rng(1)
    model = langid.Model(["a", "b"], np.log([0.4, 0.6]), rng.normal(size=(2, langid.BUCKETS)))
    whole = [langid.scores(texts.slice(i, 1), model) for i in range(3)]
    best, score = langid.scores(texts, model)
    assert best.tolist() == [int(b[0]) for b, _ in whole] and np.allclose(score, [s[0] for _, s in whole])


def mixed_rows(spark, docs):
    df = spark.createDataFrame([(i, "w " * n if n is not None else None, s, 1, 2) for i, n, s in docs], "doc_id bigint, text string, source string, size int, target int")
    return {r["doc_id"]: r for r in mixing.mix(df.repartition(3)).collect()}, df


def test_mix_meets_its_targets(spark):
    rng = random.Random(4)
    docs = [(i, max(1, int(rng.lognormvariate(4, 1))), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(400)]
    docs += [(1000, 0, "a"), (1001, None, "b"), (1002, None, "empty")]
    got, df = mixed_rows(spark, docs)
    sizes, taken, targets = collections.Counter(), collections.Counter(), {}
    for i, n, s in docs:
        row = got[i]
        assert row["size"] == (n or 0) and 0 <= row["copies"] <= 2 and row["taken"] == row["copies"] * row["size"]
        sizes[s] += n or 0
        taken[s] += row["taken"]
        targets[s] = row["target"]
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, open_, left = {}, set(order), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 2 * sizes[s]}
        for s in over or open_:
            goal[s] = 2.0 * sizes[s] if over else weights[s] * level
        left -= sum(goal[s] for s in over)
        open_ = open_ - over if over else set()
    for s in order:
        assert abs(targets[s] - goal[s]) < 1e-6 * max(1, goal[s])
        assert abs(taken[s] - goal[s]) <= max(5, 0.01 * goal[s])
    again, _ = mixed_rows(spark, docs)
    assert {i: r["taken"] for i, r in got.items()} == {i: r["taken"] for i, r in again.items()}
    kept_ids = collections.Counter(r["doc_id"] for r in mixing.apply_mix(df).collect())
    assert all(kept_ids[i] == r["copies"] for i, r in got.items())


def test_mix_of_nothing_and_of_empty_texts(spark):
    assert mixed_rows(spark, [])[0] == {}
    got, _ = mixed_rows(spark, [(1, 0, "a"), (2, None, None)])
    assert {i: (r["size"], r["taken"]) for i, r in got.items()} == {1: (0, 0), 2: (0, 0)}


def test_rates_are_exponentially_tilted(spark):
    docs = [(i, n, "b") for i, n in enumerate([1, 2, 4, 8, 16] * 20)] + [(500 + i, 5, "a") for i in range(400)]
    got, _ = mixed_rows(spark, docs)
    rates = {r["size"]: r["rate"] for i, r in got.items() if i < 500}
    logs = [np.log(rates[n]) / n for n in (1, 2, 4, 8, 16) if rates[n] < 2]
    assert len(logs) >= 2 and np.ptp(logs) < 1e-6 * abs(logs[0]) + 1e-9


def test_bounds_are_optimal():
    rng = random.Random(5)
    for _ in range(200):
        m, k = rng.randint(1, 8), rng.randint(1, 4)
        lengths, counts = np.array(sorted(rng.sample(range(40), m))), np.array([rng.randint(1, 9) for _ in range(m)])
        padding = lambda bounds: sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))
        best = min(padding([*s, lengths[-1]]) for r in range(k) for s in itertools.combinations(lengths[:-1].tolist(), min(r, m - 1)))
        found = packing.best_bounds(lengths, counts, k)
        assert padding(found) == best and len(found) <= k


def test_packing_keeps_every_token_within_the_budget(spark):
    rng = random.Random(6)
    docs = [(i, None if i % 50 == 7 else "w " * rng.choice([0, 1, 3, 30, 31, 100, 500]), "x") for i in range(300)] + [(1, "w w w", "x"), (1, "w w w", "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, batch string")
    rows = packing.pack(df.repartition(3), max_length=128, buckets=4, budget=512).collect()
    tokens, batches = collections.Counter(), collections.defaultdict(list)
    for r in rows:
        tokens[r["doc_id"]] += r["n_tokens"]
        assert r["n_tokens"] <= min(r["bucket_len"], 128) and r["start"] == 128 * r["piece"]
        batches[r["bucket_len"], r["batch"]].append(r["slot"])
    expected = collections.Counter()
    for i, t, _ in docs:
        expected[i] += len(plain.words(t))
    assert all(tokens[i] == n for i, n in expected.items()) and len({b for b, _ in batches}) <= 4
    assert all(sorted(s) == list(range(len(s))) and len(s) * b <= 512 for (b, _), s in batches.items())
    for bound in {b for b, _ in batches}:
        full = [len(s) for (b, _), s in sorted(batches.items()) if b == bound]
        assert all(n == 512 // bound for n in full[:-1])
    assert packing.pack(df.where("false")).collect() == []


def test_noise_and_unlabelled_languages_are_not_known(spark):
    rng = random.Random(4)
    parts = {"en": "the ing and tion he re at".split(), "de": "sch ung der ein ü ge st".split()}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4)))
    rows = [(i, " ".join(word(lang) for _ in range(rng.choice([3, 12, 60, 300]))), lang if i % 4 else None) for i in range(300) for lang in [rng.choice(["en", "de"])]]
    rows += [(1000 + i, rows[1][1], rows[1][2]) for i in range(400)]  # copies do not narrow the bound
    noise = ["".join(rng.choice("qxzjkvwpybf ") for _ in range(n)) for n in (80, 300, 2000)]
    noise += [" ".join("".join(rng.choice("абвгдежзиклмнопрст") for _ in range(6)) for _ in range(n)) for n in (12, 100)]
    rows += [(5000 + i, t, None) for i, t in enumerate([*noise, None, "", "12 ##"])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    told = langid.known_texts(df, langid.fit(df)).collect()
    assert sorted(r["doc_id"] for r in told) == sorted(i for i, *_ in rows if i < 5000)
    assert langid.known_texts(df.where("false"), langid.fit(df.where("false"))).collect() == []


def test_known_texts_keep_no_copy_of_the_texts(spark):
    folder = Path(work_folder(spark).removeprefix("file:"))
    there = set(folder.rglob("*.parquet"))
    rng = random.Random(6)
    rows = [(i, " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)), "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert len(langid.known_texts(df, langid.fit(df)).collect()) == 200
    assert sum(p.stat().st_size for p in set(folder.rglob("*.parquet")) - there) < 100_000  # of 560,000 letters


def test_quality_counts_equal_plain_counts(spark):
    rng = random.Random(7)
    texts = [None, "", "a b c", "a b c a b c", "x " * 300, "l1 a\nl1 a\n\n \nl2\nl1 a", "é# $% <a>", "\x0b\x0c"]
    texts += ["".join(rng.choice(["a ", "b ", "c\n", "# "]) for _ in range(rng.randint(0, 120))) for _ in range(150)]
    df = spark.createDataFrame([(i, t, rng.choice(["l", None]), rng.choice(["s", None])) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.verdicts(df).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        words = plain.words(text)
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {j + k for j in range(len(words) - 2) if grams[tuple(words[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if plain.words(x)]
        row = got[i]
        assert row["n_words"] == len(words) and row["word_chars"] == sum(map(len, words)) and row["n_repeat_words"] == len(covered)
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "") and row["n_dup_lines"] == len(lines) - len(set(lines))
        assert row["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row["base_failed"] and row["kept"])
    assert quality.verdicts(df.where("false")).collect() == []


def test_fences_follow_language_and_source(spark):
    rows = []
    for i in range(1200):
        lang, size = ("aa", 4) if i % 2 else ("bb", 9)
        rows.append((i, " ".join(f"{k:0{size}d}" for k in range(i, i + 60)), lang, "s"))
    rows += [(5000, " ".join(f"{k:09d}" for k in range(60)), "aa", "s"), (5001, " ".join(f"{k:09d}" for k in range(60)), "bb", "s")]
    rows += [(5002, " ".join(f"{k:04d}#" for k in range(60)), "aa", "rare"), (5003, " ".join(f"{k:04d}" for k in range(60)), "aa", "rare")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r["kept"] for r in quality.verdicts(df).collect()}
    assert all(got[i] for i in range(1200))
    assert (got[5000], got[5001], got[5002], got[5003]) == (False, True, False, True)


def test_fences_of_every_measure_follow_the_spread_of_a_source(spark):
    """Two sources with equal medians: what is usual in the wide one is out of bounds in the narrow one."""
    rng = random.Random(3)

    def row(i, source, length=500, symbols=0, dup=0, repeated=0):
        return (i, False, 100, length, symbols, 100, dup, repeated, "l", source)

    rows = []
    for i in range(1000):
        wide = i % 2 == 0
        some = lambda most: rng.randint(0, most) if wide and rng.random() < 0.45 else 0
        rows.append(row(i, "wide" if wide else "narrow", 500 + (rng.randint(-60, 60) if wide else rng.randint(-5, 5)), some(20), some(20), some(30)))
    names = "doc_id bigint, base_failed boolean, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint, lang string, source string"
    fences = {r["source"]: r for r in quality.thresholds(quality.sketch(spark.createDataFrame(rows, names))).collect()}
    for m in quality.MEASURES:
        assert fences["wide"][f"{m}_high"] > 1.2 * fences["narrow"][f"{m}_high"]
    assert fences["wide"]["word_length_low"] < fences["narrow"]["word_length_low"] < 500 < fences["narrow"]["word_length_high"]
    assert fences["narrow"]["symbols_high"] == 0


def test_sketches_merge_by_sums(spark):
    rows = [(i, i % 3 == 0, 100 + i, 500 + 7 * i, i % 5, 10, i % 2, i % 7, "l", "s") for i in range(400)]
    names = "doc_id bigint, base_failed boolean, n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, n_repeat_words bigint, lang string, source string"
    df = spark.createDataFrame(rows, names)
    total = lambda d: {tuple(r)[:4]: r["n"] for r in d.groupBy("lang", "source", "measure", "cell").agg(F.sum("n").alias("n")).collect()}
    assert total(quality.sketch(df)) == total(quality.sketch(df.where("doc_id < 111")).union(quality.sketch(df.where("doc_id >= 111"))))


TURNS = "conv_id bigint, turn bigint, role string, text string, pair_id string"


def test_preferences_have_one_prompt_and_paired_masks(spark):
    turns = [
        (2, 0, "user", "Hi"), (2, 1, "assistant", "Hello <|end|>"), (3, 0, "user", "Hi"), (3, 1, "assistant", "Go"),
        (8, 0, "user", "alone"), (8, 1, "assistant", "yes"), (10, 0, None, None), (10, 1, "assistant", "é"), (11, None, "assistant", "é"),
        (None, 0, "user", "nobody"), (12, 0, "user", "q"), (12, 1, "assistant", "r"), (12, 1, "assistant", "r"), (13, 5, "assistant", "r"),
    ]
    df = spark.createDataFrame([(*t, "clash") for t in turns], TURNS)
    got = {r["pair_id"]: r for r in chat.format_preferences(chat.with_other_endings(df)).collect()}
    assert set(got) == {2, 3, 8, 10, 11, 12, 13}
    row = got[2]
    assert (row["n_prompt_turns"], row["prompt"]) == (1, "<|user|>\nHi<|end|>\n")
    assert row["chosen"] == "<|assistant|>\nHello <|end|><|end|>\n" and row["rejected"] == "<|assistant|>\nGo<|end|>\n" and row["usable"]
    learned = lambda text, mask: [text[s["start"] : s["start"] + s["length"]] for s in mask]
    assert learned(row["chosen"], row["chosen_mask"]) == ["Hello <|end|><|end|>\n"] and learned(row["rejected"], row["rejected_mask"]) == ["Go<|end|>\n"]
    assert (got[8]["n_prompt_turns"], got[8]["rejected"], got[8]["usable"]) == (1, "", False)
    assert (got[10]["n_prompt_turns"], got[10]["chosen"], got[10]["usable"]) == (2, "", False)
    assert got[10]["prompt"].startswith("<||>\n<|end|>\n") and got[12]["n_prompt_turns"] == 3
    assert chat.format_preferences(chat.with_other_endings(df.where("false"))).collect() == []


def test_long_and_unequal_conversations(spark):
    pairs = spark.createDataFrame(
        [(1, [("user", "x" * 200_000)] * 50, [("user", "x" * 200_000)] * 49 + [("assistant", "y")]), (2, None, []), (3, [("a", "b")], None)],
        f"pair_id bigint, chosen {chat.TURNS}, rejected {chat.TURNS}",
    )
    got = {r["pair_id"]: r for r in chat.format_preferences(pairs).collect()}
    assert got[1]["n_prompt_turns"] == 49 and got[1]["rejected"] == "<|assistant|>\ny<|end|>\n" and not got[1]["usable"]
    assert (got[2]["prompt"], got[2]["chosen"], got[3]["chosen"]) == ("", "", "<|a|>\nb<|end|>\n")


PAGE = """<html><head><title> A &amp; B </title><script>if (a<b) x("</p>")</script></head><body><!-- c --><p>One&nbsp;two
three</p><ul><li><a href="/x?a=1&amp;b=2">L1</a><li><a class=k href='y'>L2</a></ul>4 < 5<style>z</style></body></html>"""


def test_derived_records_are_linked_and_keep_digests(spark):
    df = spark.createDataFrame([(1, "http://a/1", PAGE, "x"), (2, None, None, "x"), (3, "http://a/3", "", "x"), (1, "http://a/1", PAGE, "x")], "page_id bigint, url string, html string, body string")
    sources = {r["page_id"]: r for r in warc.responses(df).collect()}
    rows = warc.derive(warc.responses(df), key="page_id").collect()
    assert len(rows) == 8
    by = {(r["page_id"], r["record_type"]): r for r in rows}
    import json

    told, text, source = json.loads(by[1, "metadata"]["body"]), by[1, "conversion"], sources[1]
    assert text["body"] == "A & B\nOne two\nthree\nL1\nL2\n4 < 5" and text["target_uri"] == "http://a/1"
    assert told["html"] == {"title": "A & B", "links": ["/x?a=1&b=2", "y"]}
    assert told["source"]["headers"] == source["headers"] and told["source"]["record_id"] == source["record_id"] == text["refers_to"]
    assert told["body"]["digest"] == warc.digest(PAGE.encode()) == source["headers"]["WARC-Payload-Digest"] == text["source_digest"]
    assert text["block_digest"] == warc.digest(text["body"].encode()) and text["content_length"] == len(text["body"].encode())
    assert by[2, "conversion"]["body"] == "" and by[2, "conversion"]["target_uri"] is None
    assert len({r["record_id"] for r in rows}) == 6
    assert warc.derive(warc.responses(df.where("false"))).collect() == []


def test_records_survive_a_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://a/{i}", PAGE * (i + 1)) for i in range(5)], "page_id bigint, url string, html string")
    derived = warc.serialized(warc.derive(warc.responses(df)))
    records = derived.collect()
    (tmp_path / "one.warc.gz").write_bytes(b"".join(bytes(r["record"]) for r in records))
    back = warc.read_records(spark, str(tmp_path)).collect()
    assert sorted((r["record_id"], bytes(r["block"]).decode()) for r in back) == sorted((r["record_id"], r["body"]) for r in records)
    assert {r["headers"]["WARC-Refers-To"] for r in back} == {r["refers_to"] for r in records}


@pytest.mark.parametrize(
    "block, expected",
    [
        (b"", ("", {}, b"")), (b"<p>x", ("", {}, b"<p>x")), (b"HTTP/1.1 200 OK\r\nA: 1\r\na: 2\r\nbad\r\n\r\nbody", ("HTTP/1.1 200 OK", {"a": "1, 2"}, b"body")),
    ],
)
def test_responses_are_parsed(block, expected):
    assert warc.parsed_response(block) == expected


def test_bodies_that_are_no_text():
    rows = warc.derived_records("<urn:x>", "u", None, {}, b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG<p>x</p>")
    assert rows[1][-1] == "" and '"length": 12' in rows[0][-1]
    latin = warc.derived_records(None, None, None, {}, "HTTP/1.1 200 OK\r\nContent-Type: text/plain; charset=latin-1\r\n\r\n é <b>".encode("latin-1"))
    assert latin[1][-1] == "é <b>"


def test_pages_with_odd_charsets_and_unclosed_tags():
    import time

    for charset in ("undefined", "idna", "no-such", "utf-16"):
        assert isinstance(warc.decoded(b"a\x80b", f"text/html; charset={charset}"), str)
    start = time.time()
    for piece in ("<a ", "<title>", "<script ", "<div ", "<!--", "<a href='x ", "</script "):
        page = piece * (1_000_000 // len(piece))
        warc.title_and_links(page)
        warc.plain_text(page)
    assert time.time() - start < 20
    assert warc.title_and_links("<title>A &amp; B</title><a href='u'>x</a>") == ("A & B", ["u"])


def test_broken_archive_files_give_what_they_hold():
    import gzip

    one = b"WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    odd = b"WARC/1.1\r\nContent-Length: many\r\n\r\n\r\n\r\n"
    assert [b for _, b in warc.parsed_records(one + odd + one)] == [b"hello", b"", b"hello"]
    assert [b for _, b in warc.parsed_records(one + one[:-7])] == [b"hello", b"he"]
    packed = gzip.compress(one) + gzip.compress(one)
    assert [b for _, b in warc.parsed_records(packed)] == [b"hello", b"hello"]
    assert [b for _, b in warc.parsed_records(packed[:-12])][:1] == [b"hello"]
