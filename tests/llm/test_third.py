"""Alignment, spelling variants and licences against brute force, with every odd case."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from nearloom.llm import alignment, licenses, spelling

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def docs(spark, texts, first=0):
    """Rows with columns whose names clash with those that the operators make."""
    rows = [(i, t, "x", "y", 7) for i, t in enumerate(texts, first)]
    return spark.createDataFrame(rows, "doc_id long, text string, groups string, word string, n_words int")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# Alignment.

MIXED = [
    None, "", " ", "  two  spaces ", "\n\t x", "a", "Hello, unbelievable world!", "Größe café naïve", "漢字かな交じり文 😀 é́", "plain <|endoftext|> text <s> </s> <unk> <0x41>",
    "kept▁not", "tokenization " * 40, "Hello, unbelievable world!", "x" * 3000, "aaaa    bbbb     cccc", "1234567890 12,345.67", "tab\there\r\nline", " nbsp　wide", "def f(x):\n    return x ** 2\n",
]


def slow_tokens(text):
    """``(id, start, end)`` by the public libraries, or nothing if a tokenizer does not keep the bytes."""
    if not text:
        return [], []
    a, b = Tokenizer.from_file(BYTES), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    printing = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(x): x for x in printing} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in printing)}
    found = a.encode(" " + text, add_special_tokens=False)
    own = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in found.ids]
    other = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i in b.encode(text) for p in [b.id_to_piece(i)]]
    want = (" " + text).encode()
    if any(b"".join(x for _, x in side) != want for side in (own, other)):
        return [], []
    out = []
    for side in (own, other):
        at, spans = 0, []
        for i, x in side:
            spans.append((i, at, at + len(x)))
            at += len(x)
        out.append(spans)
    return tuple(out)


def slow_alignment(texts):
    per, counts = [], Counter()
    for text in texts:
        a, b = slow_tokens(text)
        links = [(i, j) for i, s, e in a for j, t, f in b if s < f and t < e]
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, before = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, s, _ in a if before <= s < cut) + "|" + ",".join(str(i) for i, s, _ in b if before <= s < cut))
            before = cut
        counts.update(set(links))
        per.append((a, b, groups, links))
    best = defaultdict(int)
    for (i, _), n in counts.items():
        best[i] = max(best[i], n)
    out = []
    for a, b, groups, links in per:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        out.append((len(a), len(b), len(groups), len(links), sum(counts[x] == best[x[0]] for x in links), sum(counts[x] for x in links), digest))
    return out


@pytest.mark.parametrize("sent", [alignment.SENT_PAIRS, 7, 0])
def test_alignment_matches_brute_force(spark, sent):
    """However many pairs are sent to the tasks; the rest is joined."""
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    rows = sorted(alignment.cross_counts(docs(spark, MIXED), BYTES, PIECES, sent=sent).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r[n] for n in names) for r in rows] == slow_alignment(MIXED)
    assert sum(r["n_a"] == 0 for r in rows) >= 3  # null, empty, U+2581


def test_alignment_says_where_groups_end(spark):
    rows = {r["doc_id"]: r for r in alignment.align(docs(spark, MIXED), BYTES, PIECES).collect()}
    for i, text in enumerate(MIXED):
        a, b = slow_tokens(text)
        assert rows[i]["group_ends"] == sorted({e for _, _, e in a} & {e for _, _, e in b})
        assert rows[i]["word"] == "x" or rows[i]["word"] == "y"
        assert sum(rows[i]["times"]) == rows[i]["n_links"]


def test_alignment_of_no_rows_repeated_ids_and_long_texts(spark):
    assert alignment.cross_counts(empty(spark), BYTES, PIECES).count() == 0
    long = "The tokenizers disagree about unbelievable words. " * 8000
    twice = spark.createDataFrame([(1, long), (1, long), (None, "word"), (None, None)], "doc_id long, text string")
    rows = alignment.cross_counts(twice, BYTES, PIECES).collect()
    same = [r for r in rows if r["doc_id"] == 1]
    assert len(rows) == 4 and same[0] == same[1]
    assert same[0]["n_links"] == same[0]["n_a"] + same[0]["n_b"] - same[0]["n_groups"] > 80_000


def test_words_are_encoded_as_in_whole_texts():
    rng = random.Random(5)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    own = alignment.PieceIds(PIECES)
    words = [*"the Größe 漢字 😀 a. 'tis don't x=1\n\ny \ttab \u3000 \u2581 <s> </s> <0x0A> \r\n \x00 naïve e\u0301 １２ ﬁ".split(" "), "", "", "aaaa" * 30]
    for _ in range(1500):
        text = " ".join(rng.choices(words, k=rng.randint(1, 12)))
        assert own(text).tolist() == model.encode(text), text


def test_labels_and_groups():
    import numpy as np

    said = alignment.labels(np.array([1, 3, 6]), np.array([2, 3, 4, 6]))
    assert said == b"ab=b-="
    assert alignment.groups_of(said).tolist() == [[3, 2, 2], [6, 1, 2]]


# Spelling variants.


def slow_words(rows, errata=spelling.ERRATA, letters=6, least=5):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if errata and h % errata == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= letters and n >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(counts, times=5):
    beside = {w: sorted((x for x in counts if near(w, x)), key=lambda x: (-counts[x], x)) for w in counts}
    form = {w: ns[0] if ns and counts[ns[0]] >= times * counts[w] else None for w, ns in beside.items()}
    out = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, counts[w], len(beside[w]), counts[form[w]] if form[w] else None)
    return out


def test_words_match_brute_force(spark):
    rng = random.Random(3)
    pool = ["garden", "Gärten", "GARDEN", "übermäßig", "ÀÉÿþ÷×abc", "letter", "letters", "short", "naïveté", "éé", "abcdef"]
    texts = [None, "", "12345 !!", "x" * 5000, *(rng.choice(" ,.-1\n").join(rng.choices(pool, k=200)) for _ in range(60))]
    rows = [*enumerate(texts), (None, "garden " * 9), (5, texts[5])]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1))
    for errata in (spelling.ERRATA, 7, 0):
        assert {r["word"]: r["n"] for r in spelling.words(table, errata=errata).collect()} == slow_words(rows, errata)
    assert len(slow_words(rows, 7)) > len(slow_words(rows, 0))
    assert spelling.words(empty(spark)).count() == 0


@pytest.mark.parametrize("alphabet,size,seed", [("ab", 300, 1), ("aé", 200, 2), ("abcdefg", 400, 3), ("aÀÿz😀", 300, 4)])
def test_variants_match_brute_force(spark, alphabet, size, seed):
    rng = random.Random(seed)
    counts = {}
    while len(counts) < size:
        stem = "".join(rng.choices(alphabet, k=rng.randint(1, 7 if len(alphabet) < 4 else 5)))
        for _ in range(4):
            counts[stem] = rng.choice([1, 2, 5, 10, 25, 50, 125, 625, 3125])
            at = rng.randrange(len(stem) + 1)
            stem = rng.choice([stem[:at] + rng.choice(alphabet) + stem[at:], stem[:at] + stem[at + 1 :] or "a", stem[:at] + rng.choice(alphabet) + stem[at + 1 :]])
    rows = spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()
    assert {r["word"]: tuple(r)[1:] for r in rows} == slow_variants(counts) and len(rows) == len(counts)


def test_variants_of_chains_lone_words_and_none(spark):
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0
    chain = {"a" * (30 - i): 5**i for i in range(13)}
    rows = {r["word"]: r for r in spelling.variants(spark.createDataFrame([*chain.items(), ("lonely", 9)], "word string, n long")).collect()}
    assert rows["a" * 30]["root"] == "a" * 18 and rows["a" * 18]["form"] is None
    assert tuple(rows["lonely"]) == ("lonely", None, "lonely", 9, 0, None)


def test_few_edges_are_light(spark):
    """A word is merged once per light edge, and those are at most the logarithm of the words, besides its end."""
    rng = random.Random(9)
    counts = {"".join(rng.choices("abcd", k=40)): 1 for _ in range(500)} | {"a" * i: 1 for i in range(1, 400)}
    light = spelling.light_edges(spark.createDataFrame(list(counts.items()), "word string, n long"))
    assert light.groupBy("word").count().agg(F.max("count")).first()[0] <= len(counts).bit_length() + 1


# Licences.

APACHE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."
GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"
LICENCES = [
    None, "", "no licence here", "MIT License", "mit\nLICENSE mit license", "Released under the MIT License.", APACHE, "/* " + APACHE.replace(" ", "\n * ") + " */", GRANT, GRANT.replace("Software without", "Program without"),
    GRANT.replace("copy of", "copy of some more extra"), GRANT.replace("copy of", "copy of far too many more extra words"), GRANT + " " + GRANT + "\n" + APACHE, "Licensed under CC BY-NC 4.0.", "GNU General Public License, version 3", "This work is licensed under the GNU General Public License, version 3.",
    "ÄPACHE license", "apachelicense apache_license apache-license", "漢字 mit license 😀", "software without restriction deal in the software", "permission " * 500 + GRANT, "mit license " * 3000, "MIT License",
]


def slow_scan(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    stands = lambda phrase: [i for i in range(len(words)) if words[i : i + len(phrase)] == phrase]
    said = sorted((i, label) for phrase, label in licenses.BASE for i in stands(phrase.split()))
    labels, score = {label for _, label in said}, 0.5 if said else 0.0
    for label, whole, keys in licenses.TEMPLATES:
        whole = whole.split()
        at = [next(i for i in range(len(whole)) if whole[i : i + len(k.split())] == k.split()) for k in keys]
        places = [stands(k.split()) for k in keys]
        for start in places[0]:
            o = start - at[0]
            if all(any(abs(p - a - o) <= licenses.DRIFT for p in ps) for a, ps in zip(at, places, strict=True)):
                labels.add(label)
                hits = sum(w in words[max(0, o + j - 4) : max(0, o + j + 5)] for j, w in enumerate(whole))
                score = max(score, 0.5 + 0.5 * (hits / len(whole)))
    starts = [i for i, _ in said]
    return (len(words), len(said), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in said})), ",".join(sorted(labels)), score)


def test_licences_match_brute_force(spark):
    rng = random.Random(2)
    pool = " ".join(t.text for t in licenses.TEMPLATES).split()
    texts = [*LICENCES, *(" ".join(rng.choices(pool, k=300)) for _ in range(30)), *(" ".join([*rng.choices(pool, k=5), *rng.choice(licenses.TEMPLATES).text.split(), *rng.choices(pool, k=5)]) for _ in range(60))]
    rows = sorted(licenses.digest(licenses.scan(docs(spark, texts))).collect(), key=lambda r: r["doc_id"])
    assert [tuple(r)[1:] for r in rows] == [slow_scan(t) for t in texts]
    assert len({r["labels"] for r in rows}) > 15


def test_licences_whatever_the_corpus_holds(spark):
    """The index words depend on the corpus, the results do not."""
    crowd = ["permission hereby granted restriction version"] * 50
    alone = {r["doc_id"]: r for r in licenses.digest(licenses.scan(docs(spark, LICENCES))).collect()}
    among = {r["doc_id"]: r for r in licenses.digest(licenses.scan(docs(spark, LICENCES + crowd))).collect()}
    assert all(among[i] == r for i, r in alone.items())


def test_notices_have_places_and_other_columns_stay(spark):
    rows = {r["doc_id"]: r for r in licenses.scan(docs(spark, LICENCES)).collect()}
    assert [(n["label"], n["first_word"], n["last_word"]) for n in rows[8]["notices"]] == [("mit", 0, 28)]
    assert [n["label"] for n in rows[12]["notices"]].count("mit") == 2
    assert rows[9]["notices"] == [] and len(rows[10]["notices"]) == 1 and rows[11]["notices"] == []
    assert rows[0]["groups"] == "x" and rows[0]["n_words"] == 0 and rows[0]["mentions"] == []
    assert licenses.digest(licenses.scan(empty(spark))).count() == 0


def test_templates_must_hold_their_key_phrases(spark):
    with pytest.raises(ValueError):
        licenses.Index({}, [licenses.Template("x", "one two three", ("two four",))])
    own = [licenses.Template("house", "all rights are ours and ours alone", ("rights are ours", "ours alone"))]
    rows = licenses.digest(licenses.scan(docs(spark, ["All rights are ours, and ours alone!", "ours alone"]), own, [])).collect()
    assert sorted((r["labels"], r["score"]) for r in rows) == [("", 0.0), ("house", 1.0)]
