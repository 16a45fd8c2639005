"""SpotSigs: a document's fingerprint is the set of chains of content words that follow its common words.

Theobald, Siddharth and Paepcke, "SpotSigs: Robust and Efficient Near
Duplicate Detection in Large Web Collections" (2008).  An anchor is a common
word; its signature is the anchor with the next ``CHAIN`` words that are not
common.  Boilerplate holds few common words, so prose decides the set.  A
stretch of content words that no chain covers is signed by its word chains,
so that texts with few common words, or none, compare too, and an anchor that
comes or goes changes only the signatures around it.  DataFrame functions
only: a text is cut in words once, chains are read from the array of its
content words by position, and signatures are 32-bit hashes in sorted arrays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearloom.llm.runtime import stored

# Anchors: fixed lists of common words of four languages.
ENGLISH = "a an and are as be for from in is of on that the this to was with"
FRENCH = "au dans de des du en est et la le les pour que qui sur un une"
GERMAN = "auf das dem der die ein eine für ist mit nicht sie und von zu"
SPANISH = "como con de del el en es la las los no para por que se un una"
ANCHORS = tuple(sorted({*ENGLISH.split(), *FRENCH.split(), *GERMAN.split(), *SPANISH.split()}))

CHAIN = 3
WORD = r"[\p{L}\p{N}]++"


def with_signatures(df: DataFrame, texts: dict[str, str], chain: int = CHAIN, anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """``df`` with, for each ``{new: text column}``, the sorted set of the text's signatures as 32-bit hashes.

    An anchor near the end has the fewer words that follow it.  Null and
    wordless texts have the empty set; no other text has.  The work grows
    with the number of words, whatever they are.
    """
    name = lambda what, k: f"_{what}_{k}"
    common = lambda w: w.isin(*anchors)
    df = df.withColumns({name("words", k): F.regexp_extract_all(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(WORD), F.lit(0)) for k, c in texts.items()})
    steps: dict[str, Column] = {}
    for k in texts:
        words = F.col(name("words", k))
        steps[name("spots", k)] = F.filter(F.transform(words, lambda w, i: F.when(common(w), i)), lambda i: i.isNotNull())
        steps[name("content", k)] = F.filter(words, lambda w: ~common(w))
    df = df.withColumns(steps)
    # So many content words stand before the k-th anchor: its place without the anchors before it.
    df = df.withColumns({name("after", k): F.transform(name("spots", k), lambda i, n: i - n) for k in texts})
    df = df.withColumns({name("bare", k): _uncovered(F.col(name("after", k)), F.size(name("content", k)), chain) for k in texts})
    out = {k: _signed(*[F.col(name(x, k)) for x in ("words", "content", "spots", "bare")], chain) for k in texts}
    return df.withColumns(out).drop(*[name(x, k) for x in ("words", "spots", "content", "after", "bare") for k in texts])


def _signed(words: Column, content: Column, spots: Column, bare: Column, chain: int) -> Column:
    """The sorted set of the hashes of all anchors' chains and of the chains from the places ``bare``."""
    links = lambda at: [F.get(content, at + j) for j in range(chain)]
    anchored = F.transform(spots, lambda i, n: F.hash(F.get(words, i), *links(i - n)))
    return F.sort_array(F.array_distinct(F.concat(anchored, F.transform(bare, lambda j: F.hash(*links(j))))))


def _uncovered(after: Column, size: Column, chain: int) -> Column:
    """Where word chains start in the stretches of ``size`` content words that no anchor's chain covers.

    ``after`` has the content words before each anchor.  A stretch shorter
    than a chain starts one all the same.
    """
    none = F.array().cast("array<int>")
    starts = lambda lo, hi: F.when(lo < hi, F.sequence(lo, F.greatest(lo, F.least(hi - 1, size - chain)))).otherwise(none)
    first = starts(F.lit(0), F.coalesce(F.get(after, F.lit(0)), size))
    rest = F.transform(after, lambda p, k: starts(p + chain, F.coalesce(F.get(after, k + 1), size)))
    return F.concat(first, F.flatten(rest))


def fingerprint(sigs: Column) -> Column:
    """A signature set as a string: its members in order, eight hexadecimal digits each; see :func:`signatures`."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0"))), "")


def signatures(said: Column) -> Column:
    """The set that a :func:`fingerprint` states."""
    digits = F.regexp_extract_all(said, F.lit("[0-9a-f]{8}"), F.lit(0))
    number = F.transform(digits, lambda x: F.conv(x, 16, 10).cast("long"))
    return F.transform(number, lambda x: F.when(x < 1 << 31, x).otherwise(x - (1 << 32)).cast("int"))


def jaccard(a: Column, b: Column, at_least: float = 0.0) -> Column:
    """Jaccard likeness of two signature sets, 1 for two empty ones.

    Pruned: sets whose sizes alone keep them under ``at_least``, and sets of
    which one is empty, are 0 without being intersected.
    """
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    common = F.size(F.array_intersect(a, b))
    return (
        F.when(large == 0, 1.0)
        .when((small == 0) | (small < large * F.lit(at_least)), 0.0)
        .otherwise(common / (F.size(a) + F.size(b) - common))
    )


def _length_class(size: Column, at_least: float) -> Column:
    """Partitions by set length: sets likelier than ``at_least`` are in the same or the next one."""
    return F.floor(F.log(size.cast("double")) / F.log(F.lit(1.0 / at_least))).cast("int")


def similar_pairs(rows: DataFrame, at_least: float = 0.8, id_col: str = "doc_id", sigs_col: str = "sigs") -> DataFrame:
    """``(a, b, likeness)``, a < b: classes of equal signature sets, named by their smallest id, at ``at_least`` or more.

    Sets are split by length, and within a length class joined over the
    prefix of their rarest signatures that any set as like must share, each
    candidate pair once.  A signature's rank is its number of sets.  Equal
    sets meet once, as one class (:func:`members` says who is in it); empty
    sets and null ids have no pairs.
    """
    if not 0 < at_least < 1:
        raise ValueError("at_least must lie between 0 and 1")
    sets = rows.where(F.col(id_col).isNotNull() & (F.size(sigs_col) > 0)).groupBy(F.col(sigs_col).alias("sigs")).agg(F.min(id_col).alias("id"))
    sets = stored(sets, "spotsigs")
    each = sets.select("id", F.size("sigs").alias("n"), F.explode("sigs").alias("s"))
    common = each.groupBy("s").agg(F.count("*").alias("f"))
    ranked = each.join(common, "s").withColumn("pos", F.row_number().over(Window.partitionBy("id").orderBy("f", "s")))
    prefix = ranked.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * at_least) + 1)
    prefix = prefix.select("id", "n", "s", _length_class(F.col("n"), at_least).alias("part"))
    left = prefix.select(F.col("id").alias("a"), F.col("n").alias("na"), "s", "part")
    right = prefix.select(F.col("id").alias("b"), F.col("n").alias("nb"), "s", F.explode(F.array(F.col("part"), F.col("part") - 1, F.col("part") + 1)).alias("part"))
    close = F.least("na", "nb") >= F.greatest("na", "nb") * at_least
    pairs = left.join(right, ["s", "part"]).where((F.col("a") < F.col("b")) & close).select("a", "b").distinct()
    of = lambda k: sets.select(F.col("id").alias(k), F.col("sigs").alias(f"sigs_{k}"))
    scored = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("likeness", jaccard(F.col("sigs_a"), F.col("sigs_b"), at_least))
    return scored.where(F.col("likeness") >= at_least).select("a", "b", "likeness")


def members(rows: DataFrame, id_col: str = "doc_id", sigs_col: str = "sigs") -> DataFrame:
    """``(id, class_id)``: the class of equal signature sets that each row is in; nobody's is null, and rows without an id are left out."""
    named = rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.sha2(fingerprint(F.col(sigs_col)), 256).alias("_of"))
    return named.join(named.groupBy("_of").agg(F.min("id").alias("class_id")), "_of").select("id", "class_id")


#: About so many neighbouring ids form a window partition; above MOST_PARTS of them, partitions grow and spill.
NEIGHBOUR_ROWS, MOST_PARTS, FANOUT = 500, 4096, 64


def _below(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are under ``value``: blocks of FANOUT first, then within one."""
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs]) if xs else F.array().cast("array<long>")
    blocks = F.size(F.filter(longs(cuts[FANOUT - 1 :: FANOUT]), lambda x: x < value))
    return blocks * FANOUT + F.size(F.filter(F.slice(longs(cuts), blocks * FANOUT + 1, FANOUT), lambda x: x < value))


def with_next(docs: DataFrame, id_col: str, text_col: str, carried: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, text, *carried, next_text, next_*)``: each row with what the row of the next smaller id has.

    The smallest id's next is the largest; null ids come after all others;
    rows of one id follow each other in order of their texts.  The texts are
    shuffled once: ids are dealt to ranges by their quantiles, and the first
    row of each range is also dealt to the range before it, whose last row
    needs it.
    """
    own = ["text", *carried]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *carried)
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    parts = max(1, min(MOST_PARTS, ids.count() // NEIGHBOUR_ROWS))
    at = [i / parts for i in range(1, parts)]
    cuts = sorted({int(c) for c in ids.agg(F.percentile_approx("doc_id", at, 100_000)).first()[0] or ()}) if at else []
    # Part 0 has the largest ids, the last part the nulls.
    part = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(len(cuts) - _below(F.col("doc_id"), cuts))
    tops = {r["part"]: r["top"] for r in ids.groupBy(part.alias("part")).agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    needs = {p: order[i - 1] for i, p in enumerate(order)}
    by_part = lambda of: F.array(*[F.lit(of.get(p)).cast("long") for p in range(len(cuts) + 2)])[F.col("part")]
    dealt = rows.withColumn("part", part.cast("int"))
    heads = dealt.where(by_part(tops).eqNullSafe(F.col("doc_id")))
    first = heads.groupBy("part").agg(F.min(F.struct(*own)).alias("it"))
    first = first.select(F.lit(None).cast("long").alias("doc_id"), *[F.col(f"it.{c}").alias(c) for c in own], by_part(needs).cast("int").alias("part"), F.lit(1).alias("head"))
    w = Window.partitionBy("part").orderBy("head", F.desc_nulls_last("doc_id"), "text")
    both = dealt.withColumn("head", F.lit(0)).unionByName(first).withColumns({f"next_{c}": F.lead(c).over(w) for c in own})
    return both.where(F.col("head") == 0).drop("head", "part")


def edited(text: Column, following: Column) -> Column:
    """``text`` with its last third of code points replaced by the first as many of ``following`` (or all it has)."""
    n = F.length(text)
    k = F.floor(n / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - k), F.substring(following, F.lit(1), k))


def compare_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and their likeness and that to the next document.

    See :func:`with_next` for the order, null ids and ties, :func:`edited`
    for the edit.  Null texts count as empty; a single document is its own
    next.  An empty table gives no rows; only the two named columns are read,
    so other columns may have any name.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(with_signatures(texts, {"own": "text"}, chain), "doc_id", "text", ("own",))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), "own", "next_own", edited(F.col("text"), F.col("next_text")).alias("edited"))
    rows = with_signatures(rows, {"new": "edited"}, chain)
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("own")).alias("fingerprint"), fingerprint(F.col("new")).alias("edited_fingerprint"),
        jaccard(F.col("own"), F.col("new")).alias("near_edited"), jaccard(F.col("own"), F.col("next_own")).alias("near_next"),
    )
