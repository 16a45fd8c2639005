"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

DataFrame functions only.  The two models are first-order chains over
character classes, trained on the driver from labelled samples; what reaches
the plan is one table of log-likelihood ratios per pair of characters, of
fixed size.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns of the base kinds, in their listed order, with the length that a match (of `assign`: its value) must have.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
BASE = (("assign", ASSIGN, 6), ("access", ACCESS, 20), ("hex", HEX, 24))
KINDS = ("assign", "access", "hex", "markov")

#: Characters that the Markov models tell apart.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: A candidate of the models: a run of such characters, at least so long.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+={0,2}"
#: A run that may be random as a whole: at least so long, with a letter and a digit.
WHOLE = r"^(?=[A-Za-z+/_-]*+[0-9])(?=[^A-Za-z]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+"
#: Nats per character pair by which the random model must be the likelier over a whole run.
THRESHOLD = 0.5
#: Nats in all, beside the logarithm of the run's length, by which it must be the likelier over a stretch of a run.
STRETCH = 12.0
#: Words of one case, small numbers and hexadecimal constants: random only beyond so many nats with capitals read as small letters.
_WORD = r"(?:(?:[A-Z]?[a-z]+|[A-Z]+)[0-9]{0,3}|[0-9]{1,6}|0x[0-9A-Fa-f]+)(?![A-Za-z0-9])"
WORDY = rf"^[+/_-]*+{_WORD}(?:[+/_-]++{_WORD})*+[+/_=-]*+$"
WORDY_LEAST = 24.0
WORDS_BEFORE, WORDS_AFTER = r"\A(?:[A-Z]?[a-z]{2,}+[/_-]++)++", r"(?:[/_-]++[A-Z]?[a-z]{2,}+)++\z"

# Ordinary words of identifiers, for the negative samples.
WORDS = (
    "account action active address agent array async attribute average backend balance base batch binary block body boolean border bottom "
    "branch buffer build button byte cache call cancel case category center chain change channel char check child class clear click client "
    "clock close cluster code collect color column command commit common compare compile config connect console constant content context "
    "control convert copy count create current cursor data database date debug decode default delete delta depth device dialog digest "
    "directory disable display document domain double download driver dump duration element email empty enable encode entry enum error "
    "event exact except execute exit expect export factory false fetch field file filter final find first flag float flush folder font "
    "format forward frame function future gateway generate global graph group handle handler hash header height hidden host html http "
    "icon image import index info init inner input insert instance integer interface internal item iterator join json kernel keyboard key "
    "label language last layer layout left length level library limit line link list listener load local lock logger logical main manager "
    "map margin match matrix maximum memory menu merge message meta method metric middle minimum mode model module monitor mouse move name "
    "native network next node normal notify null number object offset open operator option order origin output owner package padding page "
    "parameter parent parse partition password path pattern payload pending phase pixel plugin point policy pool port position prefix "
    "previous print private process profile project promise property protocol provider proxy public query queue random range rate read "
    "ready record recursive redirect reduce reference region register release remote remove render repeat replace report request reset "
    "resolve resource response result return right role root route row rule runtime sample scale schedule schema scope score screen script "
    "scroll search second section select send sequence serial server service session setting shader shape shared short signal simple size "
    "sleep slice socket sort source space split stack stage start state static status step storage stream string style submit subject "
    "success suffix sum support switch symbol sync system table target task template test text thread time title toggle token top total "
    "trace transform tree trigger true type unique unit update upload url user utility valid value variable vector version video view "
    "visible warning watch weight width window worker wrapper write zone"
).split()


def samples(seed: int = 7, each: int = 4_000) -> list[tuple[str, bool]]:
    """Labelled samples ``(string, is random)``, ``each`` of either label, made by rule from ``seed``.

    Random: keys over hexadecimal, base-32, alphanumeric and base-64
    characters.  Ordinary: two to five identifier words in snake, kebab,
    camel or path style, some with a year, a version or a counter.
    """
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64])
    out = [("".join(rng.choices(rng.choice(alphabets), k=rng.randint(20, 64))), True) for _ in range(each)]
    for _ in range(each):
        words = rng.choices(WORDS, k=rng.randint(2, 5))
        style = rng.randrange(4)
        text = "".join(w.capitalize() for w in words) if style == 0 else ("_", "-", "/")[style - 1].join(words)
        tail = rng.randrange(6)
        number = str(rng.choice((rng.randrange(10), rng.randrange(100), rng.randint(1990, 2039), rng.randrange(10**6))))
        out.append((f"{text}{number}" if tail == 0 else f"{text}_{number}" if tail == 1 else f"{number}-{text}" if tail == 2 else text, False))
    return out


def train(labelled: Iterable[tuple[str, bool]], smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios, random over ordinary, of each pair of characters of ALPHABET (row: the first)."""
    n = len(ALPHABET)
    at = {c: i for i, c in enumerate(ALPHABET)}
    counts = {True: [smoothing] * (n * n), False: [smoothing] * (n * n)}
    for text, label in labelled:
        for a, b in zip(text, text[1:], strict=False):
            if a in at and b in at:
                counts[label][at[a] * n + at[b]] += 1
    table = []
    for i in range(n):
        total = {k: sum(c[i * n : i * n + n]) for k, c in counts.items()}
        table += [math.log(counts[True][i * n + j] / total[True]) - math.log(counts[False][i * n + j] / total[False]) for j in range(n)]
    return [round(x, 6) for x in table]


def small_letters(table: Sequence[float]) -> list[float]:
    """``table`` with each pair of capitals at the lesser ratio of itself and its small letters: the samples' words have no runs of capitals."""
    n, out = len(ALPHABET), list(table)
    for i in range(26):
        for j in range(26):
            out[i * n + j] = min(table[i * n + j], table[(i + 26) * n + j + 26])
    return out


def _ratios(text: Column, table: Sequence[float]) -> Column:
    """Log-likelihood ratio of each character pair of ``text``, whose characters are all in ALPHABET."""
    chars = lambda c: F.regexp_extract_all(c, F.lit("."), F.lit(0))
    code = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    # One literal, read and folded when the plan is made: thousands of literals would take seconds to build.
    scores = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")
    firsts, seconds = chars(F.substring(text, F.lit(1), F.length(text) - 1)), chars(F.substring(text, F.lit(2), F.length(text)))
    return F.zip_with(firsts, seconds, lambda a, b: scores[code(a) * len(ALPHABET) + code(b)])


def log_ratio(text: Column, table: Sequence[float]) -> Column:
    """Mean log-likelihood ratio over the character pairs of ``text``, whose characters are all in ALPHABET."""
    total = F.aggregate(_ratios(text, table), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.length(text) > 1, total / (F.length(text) - 1)).otherwise(F.lit(0.0))


def _stretches(text: Column, table: Sequence[float]) -> Column:
    """``array<struct<start, end>>``: the likeliest random stretches of the run ``text``, widened to the next ``/``, ``_`` or ``-`` and without words at its ends.

    A stretch sums the ratios of its pairs; it starts where a sum is above
    zero, ends at its greatest sum, and is over once the sum is down to zero
    or STRETCH below that.  It is widened by WIDEN characters at most; those
    that overlap once widened are joined.
    """
    places = "array<struct<start:int,end:int>>"
    least = F.lit(STRETCH) + F.log(F.length(text).cast("double"))
    zero = F.struct(
        F.lit(0).alias("at"), F.lit(0.0).alias("sum"), F.lit(0).alias("start"), F.lit(0.0).alias("peak"), F.lit(0).alias("end"), F.array().cast(places).alias("out"), least.alias("least")
    )

    def add(acc: Column, x: Column) -> Column:
        fresh = acc["sum"] <= 0
        total, start = F.when(fresh, x).otherwise(acc["sum"] + x), F.when(fresh, acc["at"]).otherwise(acc["start"])
        before = F.when(fresh, 0.0).otherwise(acc["peak"])
        peak, end = F.greatest(before, total), F.when(total > before, acc["at"] + 2).otherwise(acc["end"])
        over = (total <= 0) | (total < peak - STRETCH)
        out = F.when(over & (peak >= acc["least"]), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end")))).otherwise(acc["out"])
        return F.struct(
            (acc["at"] + 1).alias("at"), F.when(over, 0.0).otherwise(total).alias("sum"), start.alias("start"), peak.alias("peak"), end.alias("end"), out.alias("out"), acc["least"].alias("least")
        )

    # A last pair that ends whatever stretch is open.
    found = F.aggregate(F.concat(_ratios(text, table), F.array(F.lit(-1e9))), zero, add, lambda acc: acc["out"])

    def widen(g: Column) -> Column:
        near = F.least(g["start"], F.lit(WIDEN))
        left = F.regexp_extract(F.substring(text, g["start"] - near + 1, near), r"[^/_-]*+\z", 0)
        right = F.regexp_extract(F.substring(text, g["end"] + 1, F.lit(WIDEN)), r"\A[^/_-]*+", 0)
        start, end = g["start"] - F.length(left), g["end"] + F.length(right)
        wide = F.substring(text, start + 1, end - start)
        return F.struct((start + F.length(F.regexp_extract(wide, WORDS_BEFORE, 0))).alias("start"), (end - F.length(F.regexp_extract(F.substring(wide, F.greatest(F.length(wide) - 2 * WIDEN, F.lit(0)) + 1, F.lit(2 * WIDEN)), WORDS_AFTER, 0))).alias("end"))

    def join(out: Column, g: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.array_append(F.slice(out, F.lit(1), F.size(out) - 1), F.struct(last["start"].alias("start"), g["end"].alias("end")))
        return F.when(F.size(out) == 0, F.array(g)).when(g["start"] < last["end"], joined).otherwise(F.array_append(out, g))

    return F.aggregate(F.transform(found, widen), F.array().cast(places), join)


#: Spans that are handled together: arrays grow by copies, so only arrays of a bounded size are let grow.
SPANS = 256
#: Characters by which a stretch is widened at most.
WIDEN = 512


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _blocks(spans: Column) -> Column:
    """An array in runs of SPANS, or of the root of its size if that is more."""

    def cut(spans: Column, size: Column) -> Column:
        numbers = F.when(F.size(spans) > 0, F.sequence(F.lit(0), F.floor((F.size(spans) - 1) / size).cast("int"))).otherwise(F.array().cast("array<int>"))
        return F.transform(numbers, lambda k: F.slice(spans, k * size + 1, size))

    return _bound(spans, lambda spans: cut(spans, F.greatest(F.lit(SPANS), F.ceil(F.sqrt(F.size(spans).cast("double"))).cast("int"))))


def _spans(text: Column, found: Column, kind: str, pattern: str) -> Column:
    """``array<struct<start, end, rank, kind, text>>`` of ``found``, the pattern's matches in ``text``; in code points.

    The text between matches comes from a split by the same pattern, so a
    match ends where all that went before it and itself end.
    """
    empty = F.array().cast("array<struct<start:int,end:int,rank:int,kind:string,text:string>>")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    matches = F.zip_with(found, F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda m, before: F.struct(m.alias("text"), F.length(before).alias("gap")))

    def span(start: Column, x: Column) -> Column:
        return F.struct(start.alias("start"), (start + F.length(x)).alias("end"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), x.alias("text"))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        return F.struct((start + F.length(x["text"])).alias("at"), F.array_append(acc["out"], span(start, x["text"])).alias("out"))

    def whole(parts: Column) -> Column:  # places within each block, and how long the blocks before it are
        ends = F.aggregate(parts, F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.element_at(acc, -1) + p["at"]))
        return _bound(ends, lambda ends: F.flatten(F.transform(parts, lambda p, k: F.transform(p["out"], lambda s: span(s["start"] + F.get(ends, k), s["text"])))))

    parts = F.transform(_blocks(matches), lambda m: F.aggregate(m, zero, add))
    return F.when(F.size(found) > 0, _bound(parts, whole)).otherwise(empty)


def find(docs: DataFrame, table: Sequence[float] | None = None, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base`` and ``extra``: arrays of ``(start, end, rank, kind, text)``, by start, then kind as listed.

    ``base`` has the fixed patterns' matches: leftmost and non-overlapping
    per kind, those too short dropped.  ``extra`` has runs, or else stretches
    of runs, that the Markov models take for random and that no base match
    overlaps: a whole run by its mean ratio (``threshold``), a stretch by its
    sum (STRETCH), so that a secret glued to words is found by itself; words
    alone (WORDY) by a higher sum.  Null and empty texts have none.  Clashing columns named ``base`` or ``extra`` are
    replaced; all others and all rows are kept.
    """
    table = train(samples()) if table is None else table
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # Greedy runs of one class: those long enough are the matches that are kept, so the scan can ask for the length itself.
    exact = {"assign": ASSIGN, "access": ACCESS.replace("+", "{16,}"), "hex": HEX.replace("+", "{24,}")}
    value = lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2))
    patterns = exact | {"markov": CANDIDATE}
    df = docs.withColumns({f"_found_{k}": F.regexp_extract_all(text, F.lit(p), F.lit(0)) for k, p in patterns.items()})
    df = df.withColumns({f"_{k}": _spans(text, F.col(f"_found_{k}"), k, p) for k, p in patterns.items()})
    base = F.sort_array(F.concat(F.filter("_assign", lambda s: value(s) >= 6), F.col("_access"), F.col("_hex")))
    df = df.withColumns({"base": base})
    folded = small_letters(table)
    wordy = lambda c: c.rlike(WORDY) & (log_ratio(c, folded) * (F.length(c) - 1) <= WORDY_LEAST)

    def stretch(run: Column, g: Column) -> Column:
        text = F.substring(run["text"], g["start"] + 1, g["end"] - g["start"])
        return F.struct((run["start"] + g["start"]).alias("start"), (run["start"] + g["end"]).alias("end"), run["rank"].alias("rank"), run["kind"].alias("kind"), text.alias("text"))

    def random_parts(run: Column, near: Column) -> Column:
        free = lambda s: ~F.exists(near, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        whole = run["text"].rlike(WHOLE) & (log_ratio(run["text"], table) > threshold) & free(run)
        return F.when(whole, F.array(run)).otherwise(F.filter(F.transform(_stretches(run["text"], table), lambda g: stretch(run, g)), free))

    def of_block(runs: Column) -> Column:
        # Only base matches about a block's runs can overlap one of them.
        first, last = F.get(runs, F.lit(0))["start"], F.element_at(runs, -1)["end"]
        return _bound(F.filter("base", lambda b: (b["end"] > first) & (b["start"] < last)), lambda near: F.flatten(F.transform(runs, lambda run: random_parts(run, near))))

    extra = F.filter(F.flatten(F.transform(_blocks(F.col("_markov")), of_block)), lambda s: ~wordy(s["text"]))
    return df.withColumns({"extra": extra}).drop(*[f"_{k}" for k in patterns], *[f"_found_{k}" for k in patterns])


def _joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    order = F.sort_array(F.transform(spans, lambda s: F.struct(s["start"], s["rank"], s["end"], s["kind"])))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table: Sequence[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``docs``: ``(doc_id, n_assign, n_access, n_hex, base_sha256, spans)``; see :func:`find`.

    A text without spans has the digest of the empty string and empty ``spans``.
    """
    rows = find(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")), table, threshold)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return rows.select(
        "doc_id", *[count(k) for k, _, _ in BASE], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "extra")).alias("spans")
    )


MASK = "[SECRET]"


def redact(docs: DataFrame, text_col: str = "text", length_col: str = "n_chars", table: Sequence[float] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span, base or added, replaced by MASK; overlapping spans by one.

    Texts without a span, null ones included, keep their value;
    ``length_col``, if there is one, is recounted where a text has changed.
    """
    columns = docs.columns
    rows = find(docs.withColumn("_text", F.col(text_col)), table, threshold, "_text") if not {"base", "extra"} & set(columns) else None
    if rows is None:  # the names are taken: find beside them
        taken = {c: f"_kept_{c}" for c in ("base", "extra") if c in columns}
        return redact(docs.withColumnsRenamed(taken), text_col, length_col, table, threshold).withColumnsRenamed({v: k for k, v in taken.items()}).select(*columns)
    spans = F.sort_array(F.transform(F.concat("base", "extra"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    # Before each span, how far the earlier ones of its block reach; then, before each block, how far all earlier blocks do.
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,past:int>>").alias("out"))
    reach = lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.array_append(acc["out"], F.struct(s["start"], s["end"], acc["at"].alias("past"))).alias("out"))

    def pieces(parts: Column, past: Column) -> Column:
        def of_block(p: Column, first: Column) -> Column:
            own = F.substring(F.col("_text"), first + 1, F.element_at(p["out"], -1)["start"] - first)

            def piece(s: Column, own: Column) -> Column:
                at = F.greatest(s["past"], first)
                return F.when(s["start"] >= at, F.concat(F.substring(own, at - first + 1, s["start"] - at), F.lit(MASK))).otherwise("")

            return _bound(own, lambda own: F.array_join(F.transform(p["out"], lambda s: piece(s, own)), ""))

        rest = F.substring(F.col("_text"), F.element_at(past, -1) + 1, F.length("_text"))
        return F.concat(F.array_join(F.zip_with(parts, F.slice(past, F.lit(1), F.size(parts)), of_block), ""), rest)

    rows = rows.withColumn("_parts", F.transform(_blocks(spans), lambda b: F.aggregate(b, zero, reach)))
    past = F.aggregate("_parts", F.array(F.lit(0)), lambda acc, p: F.array_append(acc, F.greatest(F.element_at(acc, -1), p["at"])))
    masked = _bound(past, lambda past: pieces(F.col("_parts"), past))
    hit = F.size("base") + F.size("extra") > 0
    rows = rows.withColumn(text_col, F.when(hit, masked).otherwise(F.col("_text")))
    if length_col in columns:
        rows = rows.withColumn(length_col, F.when(hit, F.length(text_col).cast(docs.schema[length_col].dataType)).otherwise(F.col(length_col)))
    return rows.select(*columns)
