"""Spelling variants by merging the subtrees of an errata trie.

The words form a trie.  At each of its nodes the child that most words pass
is heavy and the others, and the end of a word, are light (heavy-path
decomposition; ties to the smaller character).  Light subtrees are merged into
the heavy one with one character skipped or replaced, so a word is merged once
per light edge on its path, and there are at most log2(words) of those, however
long the word.  At a node with prefix ``p`` and heavy character ``h`` a word
``p c s`` with a light ``c`` is merged as

* ``p h s``: where such terminals coincide, with each other or with a word,
  the words differ in one replaced character;
* ``p s``: if that is a word, ``c`` is one character too many;
* ``p h c s``: if that is a word, ``h`` is one too many there.

A character between equal ones could be skipped at either; only the last of a
run is, so each pair is found once.  The trie and its merged terminals are
tables: prefixes are counted by partial aggregates, and terminals coincide by
joins and groups on them.  Words that coincide at one place differ in one
character alone, so such a group is never larger than the alphabet.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearloom.llm.runtime import cut, ship, slices, stored

#: Code points that a word has at least, occurrences, and how much more frequent its form is.
LETTERS, OCCURRENCES, TIMES = 6, 5, 5
#: One in so many runs of a document loses a character; 0 for none.
ERRATA = 199
#: Words that a task counts before it hands them on.
COUNTED = 200_000
#: Prefixes up to this length are hot keys and few (at most the alphabet to this power): they are joined by broadcast.
SHORT = 2

#: Letters of Latin-1 as UTF-8 bytes, A-Z made small: a-z, or U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def runs(text: str | None) -> list[bytes]:
    """The maximal runs of letters of a text, A-Z in small letters, as UTF-8."""
    return _RUN.findall(text.encode().lower()) if text else []


def with_errata(run: bytes, start: int, one_in: int) -> str:
    """``run`` as text, without one character if ``one_in`` divides its crc32 begun at ``start``."""
    word = run.decode()
    crc = zlib.crc32(run, start)
    if one_in and crc % one_in == 0:
        at = crc % len(word)
        return word[:at] + word[at + 1 :]
    return word


def words(docs: DataFrame, letters: int = LETTERS, occurrences: int = OCCURRENCES, errata: int = ERRATA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(word, n)``: the words of at least so many ``letters`` and ``occurrences``, over all documents and whole texts.

    Words are runs of Latin letters; with ``errata`` a run loses a character
    where that number divides the crc32 of ``<id>:<run>``.  Null texts have no
    words, a null id counts as no characters; repeated rows count each.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for b in slices(batches):
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for found, n in Counter(runs(text)).items():
                    if len(found) >= letters and len(word := with_errata(found, start, errata)) >= letters:
                        counts[word] += n
                if len(counts) > COUNTED:
                    yield out()
                    counts.clear()
        yield out()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def light_edges(listed: DataFrame) -> DataFrame:
    """``(word, n, at, heavy)``: where the path of each ``word`` in the trie leaves a node by a light edge, and the node's heavy character.

    ``at`` is the length of the node's prefix; an ``at`` of the word's length
    is its end at a node that has children.
    """
    steps = listed.select("word", "n", F.length("word").alias("len"), F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    steps = steps.select("word", "n", "at", F.expr("substr(word, 1, at)").alias("prefix"), F.expr("substr(word, at + 1, 1)").alias("next"))
    # A word with a character left has an edge; an end has none, so a node's heavy child is the most passed one.
    sizes = steps.where("next <> ''").groupBy("prefix", "next").agg(F.count("*").alias("passed"))
    heavy = sizes.groupBy("prefix").agg(F.min(F.struct(-F.col("passed"), "next"))["next"].alias("heavy"))
    heavy = stored(heavy, "heavy")
    short = F.length("prefix") <= SHORT
    light = [steps.where(part).join(F.broadcast(heavy.where(part)) if few else heavy.where(part), "prefix").where("next <> heavy") for part, few in ((short, True), (~short, False))]
    return light[0].unionByName(light[1]).select("word", "n", "at", "heavy")


def near_words(listed: DataFrame) -> DataFrame:
    """``(word, n, n_near, near, near_n)`` of each distinct ``word`` with its ``n``: how many words are one edit away, and the most frequent.

    One edit is one code point inserted, deleted or replaced.  Of equally
    frequent words the smallest in code-point order is ``near``; words without
    any have 0 and nulls.  An empty table gives no rows.
    """
    light = stored(light_edges(listed), "light")
    before, after = "substr(word, 1, at)", "substr(word, at + 2)"
    known = listed.select(F.col("word").alias("other"), F.col("n").alias("other_n"))

    # Replaced: what coincides at one place, light words with each other and with the word of the heavy character.
    merged = light.select("word", "n", "at", F.expr(f"concat({before}, heavy, {after})").alias("terminal")).where("at < length(word)")
    spots = merged.groupBy("terminal", "at").agg(F.collect_list(F.struct("word", "n")).alias("members"))
    spots = spots.join(known, F.col("terminal") == F.col("other"), "left")
    own = F.when(F.col("other").isNotNull(), F.array(F.struct(F.col("other").alias("word"), F.col("other_n").alias("n")))).otherwise(F.array().cast("array<struct<word: string, n: bigint>>"))
    spots = spots.select(F.concat("members", own).alias("members")).where(F.size("members") > 1)
    # Of each spot the two best are enough: the best for all but itself, the second for the best.
    ranked = F.array_sort(F.transform("members", lambda m: F.struct((-m["n"]).alias("less"), m["word"].alias("word"))))
    spots = spots.select("members", ranked.alias("ranked")).select(F.explode("members").alias("m"), F.size("members").alias("size"), F.col("ranked")[0].alias("first"), F.col("ranked")[1].alias("second"))
    replaced = spots.select(F.col("m.word").alias("word"), (F.col("size") - 1).cast("long").alias("n_near"), F.when(F.col("first.word") == F.col("m.word"), F.col("second")).otherwise(F.col("first")).alias("best"))

    # One more or less: a light character skipped, if no equal one follows, or the heavy one put in.
    skipped = light.where(f"at < length(word) AND substr(word, at + 1, 1) <> substr({after}, 1, 1)").select("word", "n", F.expr(f"concat({before}, {after})").alias("other"))
    put_in = light.select("word", "n", F.expr(f"concat({before}, heavy, substr(word, at + 1))").alias("other"))
    pairs = skipped.unionByName(put_in).join(known, "other")
    link = lambda a, b, n: pairs.select(F.col(a).alias("word"), F.lit(1).cast("long").alias("n_near"), F.struct((-F.col(n)).alias("less"), F.col(b).alias("word")).alias("best"))
    links = replaced.unionByName(link("word", "other", "other_n")).unionByName(link("other", "word", "n"))

    near = links.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return listed.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.col("best.word").alias("near"), (-F.col("best.less")).alias("near_n"))


def variants(listed: DataFrame, times: int = TIMES) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each distinct ``word`` with its ``n``.

    The ``form`` is the most frequent word one edit away, if it is at least
    ``times`` as frequent; the ``root`` is the last of a chain of forms.
    Frequencies grow along a chain, so it ends, and doubling finds its end
    in as many rounds as the logarithm of its length.
    """
    near = near_words(listed)
    formed = F.col("near_n") >= times * F.col("n")
    found = stored(near.select("word", F.when(formed, F.col("near")).alias("form"), "n", "n_near", F.when(formed, F.col("near_n")).alias("form_n")), "forms")
    ends = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        # A chain's word points to where its root pointed; those whose root has no form stay.
        step = ends.alias("a").join(ends.select(F.col("word").alias("root"), F.col("root").alias("further")), "root", "left")
        step = cut(step.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        ends = step.select("word", "root")
        if step.where("moved").isEmpty():
            return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle(letters: int = LETTERS, occurrences: int = OCCURRENCES, errata: int = ERRATA, times: int = TIMES) -> str:
    """DuckDB SQL for :func:`variants` of the words of ``documents``: crc32 bit by bit, near words by all their deletions."""
    return rf"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT range, 0, range FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8
), crc AS MATERIALIZED (
  SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), found AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), runs AS (
  SELECT doc_id, run, count(*) AS n, hex(encode(concat(doc_id, ':', run))) AS code FROM found GROUP BY ALL
), hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(len(code) // 2), lambda i: ('0x' || substr(code, (2 * i + 1)::INT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS h FROM runs, crc
), words AS (
  SELECT CASE WHEN h % {errata} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= {letters} AND sum(n) >= {occurrences}
), cuts AS (
  SELECT word, n, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), pairs AS (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM cuts a JOIN cuts b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, c.word, c.n FROM words w JOIN cuts c ON c.rest = w.word
  UNION SELECT c.word, w.word, w.n FROM words w JOIN cuts c ON c.rest = w.word
), near AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS best, max(other_n) AS best_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, CASE WHEN best_n >= {times} * w.n THEN best END AS form, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN best_n >= {times} * w.n THEN best_n END AS form_n
  FROM words w LEFT JOIN near USING (word)
), chain(word, pos) AS (
  SELECT word, word FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.pos WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, c.pos AS root, f.n, f.n_near, f.form_n
FROM forms f JOIN chain c USING (word) JOIN forms e ON e.word = c.pos WHERE e.form IS NULL
"""
