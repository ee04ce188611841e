"""Cases that the operators define: hot keys, long texts with many hits, null and repeated ids, clashing columns, empty tables, ties; and
plain versions of what SQL cannot express."""

import hashlib
import math
import random
import re
from functools import cache

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_operators import BELL, FOX, collected, documents, plain_groups, plain_removal

WORDS = "one two three four five six seven eight nine ten".split()


def texts_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


# 1


@pytest.mark.parametrize("hot", [0, 1])
def test_hot_anchors_are_parted_by_their_neighbours(spark, monkeypatch, hot):
    from factloom.llm import suffix_dedup

    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "BLOB", 2000)
    rng = random.Random(4)
    common = "a phrase that stands in very many of these texts "
    rows = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(5, 60))) + common + " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    df = documents(spark, [*rows, *rows[:9], "é" * 40, "é" * 60, "z" * 200, "z" * 150])
    found = collected(suffix_dedup.remove_repeats(df.repartition(5)))
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in found.items()} == plain_removal(texts_of(df))


def test_equal_texts_with_null_and_repeated_ids(spark):
    from factloom.llm.suffix_dedup import remove_repeats

    schema = "doc_id long, text string"
    rows = [(5, FOX), (5, FOX), (7, FOX), (None, FOX), (None, BELL), (None, BELL), (8, FOX[:40]), (9, FOX[:40])]
    found = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans) for r in remove_repeats(spark.createDataFrame(rows, schema)).collect())
    n, m = len(FOX), len(BELL)
    assert found == sorted([(False, 5, n, 0, 0), (False, 5, n, 0, 0), (False, 7, n, n, 1), (True, 0, n, n, 1), (True, 0, m, 0, 0), (True, 0, m, 0, 0), (False, 8, 40, 0, 0), (False, 9, 40, 0, 0)])


# 3, 4 and the stages


def odd_columns(spark):
    names = ["_text_hash", "_hash", "_copy", "_part", "_n", "row", "mark", "copy", "own_id", "own_hash", "size", "taken", "words", "cut", "key", "range", "weight", "u", "salt", "with.dot"]
    df = documents(spark)
    for k, n in enumerate(names):
        df = df.withColumn(n, df.doc_id + k)
    return df, names


def test_helper_columns_clash_with_none(spark):
    from factloom.llm.decontaminate import decontaminate
    from factloom.llm.jaccard import keep_one
    from factloom.llm.mixing import mix

    df, names = odd_columns(spark)
    bench = spark.createDataFrame([(1, FOX)], "item_id long, text string")
    for out in (decontaminate(df, bench), mix(df), keep_one(df)):
        assert out.columns == df.columns
        rows = out.collect()
        assert rows and all(r[n] == r.doc_id + k for r in rows for k, n in enumerate(names))


def test_mix_of_rows_without_ids(spark):
    from factloom.llm import mixing

    rows = [(None, f"{k} " + "w " * (k % 7), None) for k in range(300)] + [(None, None, None), (None, "", "s"), (1, "a b", "s"), (1, "c d", "s"), (1, "c d", "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    counts = mixing.mix_counts(df).collect()
    assert len(counts) == len(rows) and {r.source for r in counts} == {None, "s"}
    for s in (None, "s"):
        own = [r for r in counts if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(0 <= r.taken <= 2 * r.size for r in own)
    assert sorted(map(repr, mixing.mix(df).collect())) == sorted(map(repr, mixing.mix(df.repartition(3)).collect()))
    assert mixing.mix(df.limit(0)).count() == 0


@pytest.mark.parametrize("shuffled", [False, True])
def test_long_texts_with_many_hits(spark, monkeypatch, shuffled):
    from factloom.llm import decontaminate as d

    if shuffled:
        monkeypatch.setattr(d, "BROADCAST_ROWS", 0)
    item = " ".join(f"w{k}" for k in range(60))
    bench = spark.createDataFrame([(1, item), (2, "same " * 200)], "item_id long, text string")
    df = documents(spark, [f"{item} " * 700, "same " * 200_000, "other same same"])
    rows = collected(d.scan(df, bench))
    assert [(rows[k].n_words, rows[k].n_hit, rows[k].n_items) for k in range(3)] == [(42_000, 42_000, 1), (200_000, 200_000, 1), (3, 0, 0)]
    assert [r.doc_id for r in d.decontaminate(df, bench).collect()] == [2]


def test_places_of_an_item_that_another_covers_are_left_out(spark):
    from factloom.llm.decontaminate import item_fingerprints

    bench = spark.createDataFrame([(1, "same " * 200), (2, "same " * 10), (3, "a b " * 50 + "end")], "item_id long, text string")
    found = item_fingerprints(bench)[0].groupBy("item_id").count().collect()
    counts = {r["item_id"]: r["count"] for r in found}
    assert counts[1] == 1 and counts[3] < 12


def test_decontamination_of_null_and_repeated_ids(spark):
    from factloom.llm.decontaminate import decontaminate, scan

    bench = spark.createDataFrame([(1, FOX), (None, BELL)], "item_id long, text string")
    rows = [(None, FOX), (None, "clean"), (None, None), (3, FOX), (3, "clean"), (3, "clean"), (4, BELL)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_hit > 0, r.n_items) for r in scan(df, bench).collect())
    assert found == [(0, False, 0), (0, False, 0), (0, True, 1), (3, False, 0), (3, False, 0), (3, True, 1), (4, True, 0)]
    assert sorted((r.doc_id or 0, r.text or "") for r in decontaminate(df, bench).collect()) == [(0, ""), (0, "clean"), (3, "clean"), (3, "clean")]


# 6


def test_links_of_texts_that_share_an_id(spark):
    from factloom.llm.jaccard import near_duplicates

    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    df = spark.createDataFrame([(10, a + " end"), (11, b + " end"), (1000, a), (1000, b), (12, "alone in here with five words")], "doc_id long, text string")
    assert {(r.doc_id, r.component_id) for r in near_duplicates(df).collect()} == {(10, 10), (11, 10), (1000, 10), (12, 12)}


def test_many_copies_and_ties(spark):
    from factloom.llm.jaccard import near_duplicates

    df = documents(spark, [FOX] * 80 + [FOX.replace("lazy", "sleepy")] * 30 + [FOX * 2 + "tail end"] * 5 + [BELL])
    wanted = plain_groups(texts_of(df))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df).collect()} == wanted


# 7


def plain_features(text, source, lang, n_chars, vocabulary):
    """What quality._content, _figures and _metadata give for one text, byte by byte."""
    from factloom.llm import quality as q
    from factloom.llm.words import span_hashes

    raw = (text or "").encode()
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in raw)
    kept = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    known = {int(span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0]) for w in set(kept)}
    words = re.findall(rb"[^\x20\x09-\x0D]+", low)
    size, lines, per = max(1, len(raw)), raw.count(b"\n") + 1, max(1, len(words))
    share = [raw.count(bytes([m])) / size for m in q._EACH_MARK]
    figures = [
        math.log(size) / 10, math.log(lines) / 5, min(size / lines, 2000) / 1000, 5 * sum(48 <= b <= 57 for b in raw) / size, 3 * sum(65 <= b <= 90 for b in raw) / size,
        len(set(words)) / per - 1, 3 * sum(x == y for x, y in zip(words, words[1:], strict=False)) / per, min(size / per, 40) / 10, 5 * sum(share), *(20 * x for x in share),
    ]
    content = [float(int(v) in known) for v in vocabulary] + [x for f in figures for x in (f, min(f, 1) ** 2)]
    record = [float(n_chars is not None), math.log1p(n_chars or 0) / 10, (math.log1p(n_chars or 0) / 10) ** 2] + [0.0] * (q._SOURCES + 16)
    record[3 + q.hash_text(source) % q._SOURCES] = record[3 + q._SOURCES + q.hash_text(lang) % 16] = 0.3
    return content, record


def test_combined_views_equal_a_plain_version(spark):
    from factloom.llm.quality import HEADS, score, train

    table = lambda n: spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet")
    model = train(table("documents"), table("labels"))
    df = documents(spark).union(documents(spark).limit(2)).withColumn("n_chars", F.col("n_chars") * 900)
    rows = score(df, model).collect()
    assert len(rows) == 16
    inputs = {r.doc_id: r for r in df.collect()}
    for r in rows:
        x, out = inputs[r.doc_id], []
        for head in HEADS:
            views = plain_features(x.text, x.source, x.lang, x.n_chars, model["vocabulary"][head])
            z = -model[head]["prior"]
            for m, v in zip(model[head]["models"], views, strict=True):
                z += m.slope * max(-30, min(30, float(np.dot(m.w.astype(float), v) + m.b))) + m.shift
            out.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
        good = out[0] if x.text else 0.0
        assert abs(r.p_good - good) < 1e-3 and abs(r.p_toxic - out[1]) < 1e-3 and abs(r.score - good * (1 - out[1])) < 2e-3
        assert r.keep == (r.p_good >= 0.5 and r.p_toxic < 0.5)


def test_samples_stay_bounded_without_ids(spark, monkeypatch):
    from factloom.llm import quality

    seen = []
    monkeypatch.setattr(quality, "written", lambda df, name, run=quality.written: seen.append((name, run(df, name))) or seen[-1][1])
    monkeypatch.setattr(quality, "UNLABELLED", 50)
    rows = [(None, "same text", "en", None, 9)] * 2000 + [(None, f"text {k}", "en", "s", 9) for k in range(1000)] + [(1, f"v{k}", "en", "s", 2) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    quality.train(df, labels)
    sample = seen[0][1].collect()
    assert sum(r.doc_id == 1 for r in sample) == 1 and len(sample) < 100


# 8


def plain_piece(p):
    from factloom.llm import secrets as s

    low, n, out = p.lower(), len(p), [math.inf]
    if n == 1:
        out.append(s.character_cost(p))
    if s.SHORTEST_WORD <= n <= s.LONGEST_WORD:
        out.append(s.word_cost(p, s._COMMON_RANKS))
    if s.DATE.fullmatch(p):
        out.append(math.log10(120 if n == 4 else 365 * 120))
    if n >= 3:
        steps = {ord(b) - ord(a) for a, b in zip(low, low[1:], strict=False)}
        if steps in ({1}, {-1}):
            out.append(1.2 + math.log10(n))
        if all(a + b in s._BESIDE for a, b in zip(low, low[1:], strict=False)):
            out.append(1.6 + math.log10(n))
    for k in range(1, s.BLOCKS + 1):
        if n % k == 0 and n // k >= (3 if k == 1 else 2) and low == low[:k] * (n // k):
            out.append(sum(map(s.character_cost, p[:k])) + math.log10(n // k))
    return min(out)


def plain_cost(value):
    @cache
    def rest(i):
        return 0.0 if i == len(value) else min(plain_piece(value[i:j]) + rest(j) for j in range(i + 1, len(value) + 1))

    return rest(0)


def test_guess_cost_is_the_least_of_all_segmentations():
    from factloom.llm.secrets import guess_cost

    rng = random.Random(3)
    parts = ["1", "9", "0", "a", "A", "b", "c", "q", "w", "e", "1111", "1990", "20240101", "password", "P4ss", "abcd", "4321", "x!", "-", "%", "master", "xyxy"]
    for _ in range(3000):
        v = "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))
        least = plain_cost(v)
        assert abs(guess_cost(v) - least) < 1e-9, v
        assert (guess_cost(v, enough=10) >= 10) == (least >= 10), v
    assert guess_cost("1111990") < 3.6 and guess_cost("iloveyou2024") < 10 and guess_cost("correcthorsebatterystaple") < 10 <= guess_cost("Xk9$mQ2z")
    assert guess_cost("q" * 5000, enough=10) < 10


def plain_spans(text):
    """The base kinds by one look at each place, without the library's search."""
    key = re.compile(r"(?:password|passwd|secret|token|api_?key)", re.I | re.A)
    value, out, at = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"), [], 0
    while at < len(text):
        m, end = key.match(text, at), None
        if m:
            i = m.end()
            i += i < len(text) and text[i] in "\"'"
            while i < len(text) and text[i] == " ":
                i += 1
            if i < len(text) and text[i] in ":=":
                i += 1
                while i < len(text) and text[i] == " ":
                    i += 1
                i += i < len(text) and text[i] in "\"'"
                end = i
                while end < len(text) and text[end] in value:
                    end += 1
                if end == i:
                    end = None
                elif end - i >= 8:
                    out.append((at, 0, end))
        at = end if end else at + 1
    for kind, head, body, least in ((1, "AKIA", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), (2, "", "0123456789abcdef", 32)):
        at = 0
        while at < len(text):
            end = at + len(head)
            if text.startswith(head, at):
                while end < len(text) and text[end] in body:
                    end += 1
                if end - at >= max(least, 1):
                    out.append((at, kind, end))
            at = max(end, at + 1) if text.startswith(head, at) and end > at + len(head) else at + 1
    return sorted(out)


def test_base_spans_equal_a_plain_version(spark):
    from factloom.llm.secrets import base_spans, scan, train

    rng = random.Random(5)
    parts = ["password", "Token", "api_key", "apikey", "SECRET", "passwd", '"', "'", " ", "  ", ":", "=", "==", "abcd1234", "x", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "deadbeef", "\n", "é", "-./_+"]
    for _ in range(4000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert base_spans(t) == plain_spans(t), t
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = scan(table.union(table.limit(3)), train(table)).collect()
    assert len(rows) == table.count() + 3
    texts = dict(texts_of(table))
    for r in rows:
        spans = plain_spans(texts[r.doc_id] or "")
        joined = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for _, k, _ in spans) for x in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(filter(None, joined.split(","))) <= set(r.spans.split(","))
    assert scan(table.limit(0), train(table.limit(0))).count() == 0


# 9


def test_backoff_equals_a_plain_version(spark):
    from factloom.llm import language as m

    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = m.train(table)
    freq = {(k, lang, g): math.log(n / total) for lang, k, g, n, total in rows}
    langs = sorted({r[0] for r in rows})
    floor = {(k, lang): math.log(0.5 / next(r[4] for r in rows if r[0] == lang and r[1] == k)) for k in "wg" for lang in langs}
    known = {(k, g) for k, _, g in freq}

    def word(w):
        if ("w", w) in known:
            e = [freq.get(("w", x, w), floor["w", x]) for x in langs]
        else:
            padded, parts = f"<{w}>", []
            for i in range(len(padded)):
                g = next((padded[i : i + n] for n in range(min(m.LONGEST, len(padded) - i), 0, -1) if ("g", padded[i : i + n]) in known), None)
                if g:
                    parts.append([freq.get(("g", x, g), floor["g", x]) for x in langs])
            e = [sum(c) / len(parts) for c in zip(*parts, strict=True)] if parts else [0.0] * len(langs)
        return [x - sum(e) / len(e) for x in e]

    texts = [t for _, t in texts_of(table.limit(40))] + ["zzqx vuvuv", "Ünknöwn wörds", None, "123", "", "a"]
    df = documents(spark, texts + texts[:5])
    found = collected(m.predict(df, rows))
    for d, t in texts_of(df):
        words = re.findall(r"[^\W\d_]+", (t or "").lower())
        if not words:
            assert (found[d].lang_pred, found[d].score) == ("und", 0.0)
            continue
        total = [sum(c) / len(words) * min(len(words), m.EVIDENCE) for c in zip(*map(word, words), strict=True)]
        soft = [math.exp(x - max(total)) for x in total]
        assert found[d].lang_pred == langs[total.index(max(total))], t
        assert abs(found[d].score - max(soft) / sum(soft)) < 1e-6
    assert m.predict(df.limit(0), rows).count() == 0


def test_unseen_words_are_judged_many_at_once():
    """A word that the tables lack costs a few calls of Python, not some for each of its letters; grams without their beginnings count too."""
    import sys

    from factloom.llm import language as m

    grams = [(x, "g", g, n, 100) for x, g, n in [("a", "<", 9), ("b", "<", 8), ("a", "a", 7), ("b", "ab", 6), ("a", "abc", 5), ("b", "bcd>", 4), ("a", "\U00010428e", 3), ("b", "\u00e9", 2), ("a", "zyx", 1)]]
    rows = [("a", "w", "known", 5, 10), ("b", "w", "other", 5, 10), *grams]
    freq, floor, known = {r[:3]: math.log(r[3] / r[4]) for r in rows}, {"g": math.log(0.5 / 100)}, {r[2] for r in grams}

    def plain(w):
        padded, parts = f"<{w}>", []
        for i in range(len(padded)):
            g = next((padded[i : i + n] for n in range(min(m.LONGEST, len(padded) - i), 0, -1) if padded[i : i + n] in known), None)
            if g:
                parts.append([freq.get((x, "g", g), floor["g"]) for x in "ab"])
        e = [sum(c) / len(parts) for c in zip(*parts, strict=True)] if parts else [0.0, 0.0]
        return [x - sum(e) / 2 for x in e]

    model, words = m.Model(rows), ["abcd", "a", "zyxw", "\U00010428e\u00e9", "\u00e9", "qq", "bcd", "xbcdx"]
    assert np.allclose(model.known[model.look_up(words + words)], [plain(w) for w in words + words], atol=1e-12)
    half = (math.log(5 / 10) - math.log(0.5 / 10)) / 2
    assert np.allclose(model.known[model.look_up(["known", "other"])], [[half, -half], [-half, half]], atol=1e-12)
    many, calls = [f"w{''.join(chr(97 + int(c)) for c in str(k))}" for k in range(5000)], 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        model.look_up(many)
    finally:
        sys.setprofile(None)
    assert calls < 6 * len(many)


def test_rare_languages_are_learned_and_ties_go_to_the_first(spark, monkeypatch):
    from factloom.llm import language as m

    monkeypatch.setattr(m, "LANG_DOCS", 40)
    rows = [(k, f"plain text number {k}", "aa") for k in range(2000)] + [(3000 + k, f"etwas anderes hier {k}", "zz") for k in range(8)] + [(None, "plain text", "aa")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = m.train(df)
    assert {r[0] for r in learned} == {"aa", "zz"}
    assert sum(r[3] for r in learned if r[:3] == ("aa", "w", "plain")) < 100
    tie = m.train(spark.createDataFrame([(None, "same", "b"), (None, "same", "a")], df.schema))
    assert collected(m.predict(spark.createDataFrame([(1, "same")], "doc_id long, text string"), tie))[1].lang_pred == "a"


# The pipeline's last stage


def test_tokens_of_rows_without_ids(spark):
    import corpus_pipeline as c
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    df = spark.createDataFrame([(None, "b a"), (None, None), (2, "two"), (1, "one more"), (2, "two")], "doc_id long, text string")
    found = sorted(((r.doc_id or 0, r.start, r.n_tokens) for r in c.tokens(spark, df, "").collect()), key=lambda r: r[1])
    n = [len(model.encode(t, add_special_tokens=False).ids) + 1 for t in ("", "b a", "one more", "two", "two")]
    assert found == [(d, sum(n[:k]), n[k]) for k, d in enumerate((0, 0, 1, 2, 2))]
