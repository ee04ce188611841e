"""The Merkle manifest, spelling variants and license scans against plain versions, and the cases that they define."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from test_operators import BELL, FOX, documents

from factloom.llm import licenses, merkle, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "word " * 200_000 + "under the mit license " + "x" * 300_000


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def plain_tree(leaves, group):
    """root and, of each leaf, its levels as (before, after)."""
    paths, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for k, x in enumerate(at):
            run = nodes[x // group * group : x // group * group + group]
            paths[k].append(("".join(run[: x % group]), "".join(run[x % group + 1 :])))
        nodes, at = [h("".join(nodes[k : k + group])) for k in range(0, len(nodes), group)], [x // group for x in at]
    return nodes[0], paths


def plain_proofs(rows, group):
    leaf = lambda r: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"])))
    parts = defaultdict(list)
    for r in rows:
        parts[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r), r))
    langs = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: plain_tree([p[2] for p in sorted(parts[x], key=lambda p: p[:3])], group) for x in langs}
    root, above = plain_tree([trees[x][0] for x in langs], group)
    out = []
    for k, x in enumerate(langs):
        for (_, _, own, r), path in zip(sorted(parts[x], key=lambda p: p[:3]), trees[x][1], strict=True):
            path, tampered = path + above[k], own
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and r["n_chars"] is not None:
                tampered = leaf(r | {"n_chars": r["n_chars"] + 1})
            for a, b in path:
                tampered = h(a + tampered + b)
            out.append((r["doc_id"], own, trees[x][0], root, h("".join(a + b for a, b in path)), tampered, tampered == root))
    return sorted(out, key=repr)


def proved(df, group=2):
    return sorted((tuple(r) for r in merkle.check(df, group).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=repr)


@pytest.mark.parametrize("group", [2, 3])
def test_proofs_equal_a_plain_tree(spark, group):
    rng = random.Random(11)
    rows = [{"doc_id": None if k % 41 == 7 else k, "text": rng.choice([None, "", "é text", FOX]), "lang": rng.choice(["en"] * 6 + ["de", "é", "", None]), "source": rng.choice([None, "s"]), "n_chars": rng.choice([None, 5, -3])} for k in range(700)]
    rows += [dict(rows[3]), dict(rows[3]), dict(rows[48]), {"doc_id": 9000, "text": LONG, "lang": "one", "source": "s", "n_chars": 7}]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert proved(df, group) == plain_proofs(rows, group)


def test_manifests_of_one_row_of_none_and_with_clashing_columns(spark):
    row = {"doc_id": 3, "text": "a", "lang": None, "source": None, "n_chars": 1}
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    one = spark.createDataFrame([row], schema)
    assert proved(one) == plain_proofs([row], 2)
    assert merkle.check(one.limit(0)).count() == 0
    wide = documents(spark)
    names = ["part", "idx", "n", "pos", "digest", "level", "leaf", "path", "tie", "range", "value", "changed", "with.dot"]
    for k, x in enumerate(names):
        wide = wide.withColumn(x, wide.doc_id + k)
    assert proved(wide) == proved(documents(spark))


def test_a_manifest_keeps_its_nodes_and_bundles_meet(spark):
    rows = spark.range(5000).selectExpr("id", "'x' as part_of", "sha2(cast(id as string), 256) as digest_of")
    m = merkle.build(rows, "part_of", ["id"], "digest_of")
    root, _ = plain_tree([h(str(k)) for k in range(5000)], 2)
    assert m.root == root and len(m.nodes) == 3
    assert m.nodes[0].where("level = 0").count() == 5000 and m.nodes[1].where("level = 0").count() == 79
    assert merkle.proofs(m).select(merkle.folded(merkle._hex(merkle.F.col("digest"))).alias("r")).distinct().collect() == [(root,)]


# 12


def plain_variants(rows):
    counts = Counter()
    for d, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            x = zlib.crc32(f"{d}:{w}".encode()) if d is not None else 1
            counts[w[: x % len(w)] + w[x % len(w) + 1 :] if x % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    edits = lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) == 1 if len(a) == len(b) else any(b[:k] + b[k + 1 :] == a for k in range(len(b)))
    near = {w: [x for x in words if x != w and abs(len(x) - len(w)) < 2 and edits(*sorted((w, x), key=len))] for w in words}
    best = {w: min(near[w], key=lambda x: (-words[x], x), default=None) for w in words}
    form = {w: b if b and words[b] >= 2 * words[w] else None for w, b in best.items()}

    def root(w):
        return root(form[w]) if form[w] else w

    return sorted((w, form[w] or "", root(w), n, len(near[w]), words[form[w]] if form[w] else 0) for w, n in words.items())


def found_variants(df, block=spelling.BLOCK):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.variants(df, block).collect())


@pytest.mark.parametrize("block", [3, 2000])
def test_variants_equal_a_plain_search(spark, block):
    rng = random.Random(12)
    stems = ["colour", "ÀÉtude", "aaaaa", "aaaaaa", "abababab", "the", "seven", "x" * 5000, "x" * 4999 + "y"] + ["".join(rng.choice("abé") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    texts = [" ".join(rng.choice(stems[: rng.randint(3, len(stems))]).capitalize() + rng.choice(["", " ", "-", "s", "1"]) for _ in range(rng.randint(0, 300))) for _ in range(40)]
    texts += [None, "", LONG, "colour " * 90 + "color " * 40 + "colr " * 10 + "coolr " * 3]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + rows[:2], "doc_id long, text string").selectExpr("*", "1 as word", "2 as n", "3 as h", "4 as gram")
    wanted = plain_variants(rows + rows[:2])
    assert len(wanted) > 60 and any(x[1] for x in wanted)
    assert found_variants(df, block) == wanted


def test_forms_are_followed_to_the_last_and_ties_go_by_letters(spark):
    texts = ["colour " * 300 + "colouro " * 150 + "colourou " * 70 + "colouroub " * 30 + "colouroubs " * 9 + "bcdefg " * 3 + "bcdefh " * 6 + "bcdefa " * 6 + "bcdeé " * 3 + "bcdeè " * 6]
    df = spark.createDataFrame([(None, texts[0])], "doc_id long, text string")
    got = {r.word: r for r in spelling.variants(df).collect()}
    assert got["colouroubs"].root == "colour" and got["colouroubs"].form == "colouroub"
    assert (got["bcdefg"].form, got["bcdefa"].form, got["bcdeé"].form) == ("bcdefa", None, "bcdeè")
    assert spelling.variants(df.where("false")).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "rare words only")], "doc_id long, text string")).count() == 0


def test_near_pairs_of_a_group_need_the_shared_grams():
    own = ["abcdef", "abcdeg", "abxdef", "zzzzzz", "abcdxx"]
    pairs = {(own[a], own[b]) for a, b in spelling.near_in_group(6, own, len(own))}
    assert {tuple(sorted(p)) for p in pairs} == {("abcdef", "abcdeg"), ("abcdef", "abxdef")}
    both = own + ["abcde", "bcdef"]
    assert {(both[a], both[b]) for a, b in spelling.near_in_group(6, both, 5) if a >= 5} == {("abcde", "abcdef"), ("abcde", "abcdeg"), ("bcdef", "abcdef")}


# 13


def plain_licenses(rows, known, threshold=0.8):
    step, out = licenses.STRIDE, []
    for d, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
        places, labels, score = [], set(), 0.0
        for x in known:
            own = {k for k in range(len(w)) if tuple(w[k : k + len(x.words)]) == x.words} if x.phrase else set()
            places += [(k, x.label) for k in own]
            if own:
                labels.add(x.label)
                score = 1.0
            for b in range(0, len(w), step) if not x.phrase else ():
                share = len(set(x.words) & set(w[b : b + 2 * step])) / len(set(x.words))
                if share >= threshold - 1e-9:
                    labels.add(x.label)
                    score = max(score, share)
        at = [k for k, _ in places]
        out.append((d, len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), round(score, 9)))
    return sorted(out, key=repr)


def found_licenses(df, known=None):
    rows = licenses.scan(df, known).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    return sorted(((*r[:7], round(r.score, 9)) for r in rows), key=repr)


def test_license_scan_equals_a_plain_one(spark):
    rng = random.Random(13)
    notices = list(licenses.NOTICES.values())
    texts = [None, "", FOX, "MIT License mit license MIT-license CC-BY 4.0, cc by", "Kernel mit İ license", "license mit", LONG, "Apache License " * 500]
    for _ in range(120):
        words = rng.choice(notices).split()
        words = [w for w in words if rng.random() > rng.choice([0, 0.1, 0.25])]
        texts.append(" ".join([*rng.choices("the a of code this License mit by".split(), k=rng.randint(0, 90)), *words, *rng.choices("the a of code GNU general public license".split(), k=rng.randint(0, 90))]))
    rows = [(None if k % 17 == 5 else k, t) for k, t in enumerate(texts)]
    rows += [rows[3], rows[3], (3, "other text of the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as w", "2 as n", "3 as token", "4 as block", "5 as known", "6 as `with.dot`")
    wanted = plain_licenses(rows, licenses.templates())
    assert sum(x[6] != x[5] for x in wanted) > 10
    assert found_licenses(df) == wanted
    assert found_licenses(df.limit(0)) == []


def test_ties_of_frequency_and_own_templates(spark):
    known = [licenses.Template("x", ("one", "one", "two"), True), licenses.Template("y", ("one", "two", "three", "four", "five"), False)]
    rows = list(enumerate(["one one two", "one two one", "two one one two one one two", "one two three four", "one two three", BELL + "five four three two"]))
    assert found_licenses(spark.createDataFrame(rows, "doc_id long, text string"), known) == plain_licenses(rows, known)
    with pytest.raises(ValueError, match="1 to 32"):
        licenses.Template("z", ("a",) * 33, False)
