"""Operator 9: secrets by fixed patterns and by a battery of randomness tests, in DataFrame functions only.

Three base kinds (assign, access, hex) are found by pattern. The method adds kind random: runs of LEAST_LENGTH or more
characters of [A-Za-z0-9+/_-], with up to two =, that aren't a base span's. Each run's encoding is inferred (hex, base26, base32,
base36, base52, base62 or base64), its characters are numbered in that alphabet, and four tests of uniform randomness are made:
chi-squared over the alphabet (too uneven or too even), runs above and below the middle, runs of letters and of other characters given how
many there are (which alternation fails), and serial correlation of neighbours. Fisher's method combines their p-values into p_random. A fourth p-value speaks for the other side: under the null hypothesis of language, whose letters
are so uneven that chi-squared grows with the length (noncentrality of SKEW a character), p_language says how well a run refutes
it; a short run can hardly do so and a long one can. Language also leaves a small alphabet soon (all letters stay within a-f
with chance HEX_LETTERS each).

Both p-values go through Benjamini-Hochberg at level FALSE_DISCOVERY among the runs of like length (each class is twice as long as the
one before), so that a wealth of long runs doesn't make short ones significant. A run is a secret if it is a discovery against
language and none against randomness. Ranks come from histograms of STEPS a factor of e, so nothing is sorted or gathered.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import drop_stored, let, stored, text_column

#: Fixed patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = "((?i)password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: Values that the base kinds report already are passed over: assignments whole, the others where they fill the run.
#: The least length at which half of all random base62 runs refute language by themselves (p_language below FALSE_DISCOVERY).
LEAST_LENGTH = 16
LONG = f"[A-Za-z0-9+/_-]{{{LEAST_LENGTH},}}"
RUN = f"{ASSIGN}|{LONG}={{0,2}}"
REPORTED = "^([0-9a-f]{16,}|AKIA[A-Z0-9]{14,})$"
KINDS = ("assign", "access", "hex", "random")
LEAST_VALUE = 12
FALSE_DISCOVERY = 0.01
STEPS = 20
#: Noncentrality of chi-squared for each character of language in an alphabet of k: k * 0.066 - 1, from English letter frequencies.
SKEW = 0.066
#: Share of a-f among the letters of English text.
HEX_LETTERS = 0.317
ALPHABETS = {
    "hex": "0123456789abcdef",
    "base26": "abcdefghijklmnopqrstuvwxyz",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base52": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"
#: Spans that are put together at a time: appending to an array copies it.
CHUNK = 256


def _folded(items: Column, first: Column, step, length, shift) -> Column:
    """What step(state, item) puts into the state's array out, over all items, in time linear in them.

    The state starts from first in every chunk; length(state) is carried from chunk to chunk by adding, and shift(x, carried) moves what a chunk put out.
    """

    def whole(xs: Column) -> Column:
        starts = F.sequence(F.lit(0), (F.size(xs) - 1).cast("int"), F.lit(CHUNK))
        return let(F.transform(starts, lambda a: F.aggregate(F.slice(xs, a + 1, CHUNK), first, step)), moved)

    def moved(chunks: Column) -> Column:
        before = F.aggregate(chunks, F.array(F.lit(0)), lambda s, c: F.concat(s, F.array(F.element_at(s, -1) + length(c))))
        return let(before, lambda at: F.flatten(F.transform(chunks, lambda c, i: F.transform(c["out"], lambda x: shift(x, F.get(at, i))))))

    return let(items, whole)


def _found(text: Column, pattern: str, kind: str, guard: str | None = None) -> Column:
    """Spans (start, kind, end, value) of the matches, leftmost and not overlapping, in code points.

    The pieces between the matches give the positions: splitting and matching walk through the text alike. Texts without a match of guard
    (the pattern itself, unless a simpler one will do) have none.
    """
    hit = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(pattern), F.lit({"assign": 2, "random": 1}.get(kind, 0)))
    gaps = F.split(text, pattern, -1)
    zipped = F.arrays_zip(F.transform(gaps, lambda g: F.length(g)).alias("g"), F.transform(hit, lambda h: F.length(h)).alias("n"), F.transform(group, lambda h: F.length(h)).alias("v"), hit.alias("s"))
    counts = {"assign": lambda v: v >= LEAST_VALUE, "random": lambda v: v == 0}.get(kind, lambda v: v > 0)
    spans = _folded(
        zipped,
        F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["g"] + F.coalesce(x["n"], F.lit(0))).alias("at"),
            F.when(counts(x["v"]), F.concat(s["out"], F.array(F.struct((s["at"] + x["g"]).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), (s["at"] + x["g"] + x["n"]).alias("end"), x["s"].alias("value"))))).otherwise(s["out"]).alias("out"),
        ),
        lambda chunk: chunk["at"],
        lambda x, at: F.struct((x["start"] + at).alias("start"), x["kind"].alias("kind"), (x["end"] + at).alias("end"), x["value"].alias("value")),
    )
    return F.when(text.rlike(guard or pattern), spans).otherwise(F.array().cast(SPANS))


def base_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of the three base kinds and of the runs to be tested."""
    df = docs.select(docs["doc_id"], text_column(docs).alias("text"))
    low = F.lower("text")
    named = F.contains(low, F.lit("passw")) | F.contains(low, F.lit("secret")) | F.contains(low, F.lit("token")) | (F.contains(low, F.lit("api")) & F.contains(low, F.lit("key")))
    none = F.array().cast(SPANS)
    text = F.col("text")
    runs = F.filter(_found(text, RUN, "random", LONG), lambda x: ~x["value"].rlike(REPORTED))
    return df.select(
        "doc_id",
        F.when(named, _found(text, ASSIGN, "assign")).otherwise(none).alias("assign"),
        F.when(F.contains("text", F.lit("AKIA")), _found(text, ACCESS, "access")).otherwise(none).alias("access"),
        _found(text, HEX, "hex").alias("hex"),
        runs.alias("runs"),
    )


def _upper_tail(z: Column) -> Column:
    """P(Z > z) of a standard normal variable, by the rational approximation of Abramowitz and Stegun 26.2.17 (error 7.5e-8)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    # Fixed values of that approximation.
    c = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    poly = sum((k * F.pow(t, F.lit(float(i + 1))) for i, k in enumerate(c[1:], 1)), c[0] * t)
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def tested(runs: DataFrame) -> DataFrame:
    """runs: row, start, end, value. Adds encoding, the four tests' p-values, p_random that combines them, and p_language, that of language."""
    v = F.rtrim(F.col("value"), F.lit("="))
    df = runs.withColumn("v", v).withColumn(
        "encoding",
        F.when(F.col("v").rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(F.col("v").rlike("^([a-z]+|[A-Z]+)$"), "base26").when(F.col("v").rlike("^[A-Z2-7]+$"), "base32").when(F.col("v").rlike("^([0-9a-z]+|[0-9A-Z]+)$"), "base36").when(F.col("v").rlike("^[A-Za-z]+$"), "base52").when(F.col("v").rlike("^[0-9A-Za-z]+$"), "base62").otherwise("base64"),
    )
    df = df.withColumn("v", F.when(F.col("encoding").isin("hex", "base26", "base36"), F.lower("v")).otherwise(F.translate("v", "-_", "+/")))
    table = F.create_map(*[F.lit(x) for item in ALPHABETS.items() for x in item])
    df = df.withColumn("alphabet", F.element_at(table, F.col("encoding"))).withColumn("k", F.length("alphabet").cast("double")).withColumn("c", F.transform(F.split("v", ""), lambda x: F.instr(F.col("alphabet"), x) - 1))
    n = F.size("c").cast("double")
    each = F.transform(F.sequence(F.lit(1), F.length("alphabet")), lambda i: F.length("v") - F.length(F.replace(F.col("v"), F.substr(F.col("alphabet"), i, F.lit(1)))))
    square = F.aggregate(each, F.lit(0.0), lambda s, x: s + x * x)
    mean = (F.col("k") - 1) / 2
    pairs = F.arrays_zip(F.slice("c", F.lit(1), F.size("c") - 1).alias("a"), F.slice("c", F.lit(2), F.size("c") - 1).alias("b"))
    runs_seen = F.aggregate(pairs, F.lit(1.0), lambda s, x: s + ((x["a"] > mean) != (x["b"] > mean)).cast("double"))
    product = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + (x["a"] - mean) * (x["b"] - mean))
    letter = F.transform(F.split("v", ""), lambda x: F.lower(x).between("a", "z"))
    classes = F.aggregate(F.arrays_zip(F.slice(letter, F.lit(1), F.size("c") - 1).alias("a"), F.slice(letter, F.lit(2), F.size("c") - 1).alias("b")), F.lit(1.0), lambda s, x: s + (x["a"] != x["b"]).cast("double"))
    letters = F.size(F.filter(letter, lambda x: x)).cast("double")
    df = df.withColumns({"n": n, "chi": F.col("k") * square / n - n, "flips": runs_seen, "product": product, "classes": classes, "twice": 2 * letters * (n - letters)})
    free, variance = F.col("k") - 1, (F.col("k") * F.col("k") - 1) / 12
    # Wilson and Hilferty's cube root makes chi-squared near normal.
    cube = (F.pow(F.greatest(F.col("chi"), F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    skew = F.greatest(SKEW * F.col("k") - 1, F.lit(0.5)) * F.col("n")
    # Wald and Wolfowitz's mean and variance of the number of runs, with a continuity correction; runs of one class tell nothing.
    spread = F.col("twice") * (F.col("twice") - F.col("n")) / (F.col("n") * F.col("n") * (F.col("n") - 1))
    off = F.greatest(F.abs(F.col("classes") - 1 - F.col("twice") / F.col("n")) - 0.5, F.lit(0.0))
    df = df.withColumns(
        {
            "p_uniform": 2 * _upper_tail(F.abs(cube)),
            "p_classes": F.when(spread > 0, 2 * _upper_tail(off / F.sqrt(spread))).otherwise(1.0),
            "p_runs": 2 * _upper_tail(F.abs((F.col("flips") - (F.col("n") + 1) / 2) / F.sqrt((F.col("n") - 1) / 4))),
            "p_serial": 2 * _upper_tail(F.abs(F.col("product") / (variance * F.sqrt(F.col("n") - 1)))),
            "p_language": _upper_tail(-(F.col("chi") - free - skew) / F.sqrt(2 * free + 4 * skew)) * F.when(F.col("encoding") == "hex", F.pow(F.lit(HEX_LETTERS), F.length(F.translate("v", "0123456789", "")))).otherwise(1.0),
        }
    )
    # Minus the sum of logarithms is Gamma-distributed with shape 4, whose upper tail has a closed form.
    surprise = sum((-F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-100))) for p in ("p_uniform", "p_runs", "p_classes", "p_serial")), F.lit(0.0))
    df = df.withColumn("surprise", surprise).withColumn("p_random", F.exp(-F.col("surprise")) * sum((F.pow("surprise", F.lit(float(i))) / math.factorial(i) for i in (1, 2, 3)), F.lit(1.0)))
    return df.select("row", "start", "end", "value", "encoding", "n", "p_uniform", "p_runs", "p_classes", "p_serial", "p_random", "p_language")


def _significant(tests: DataFrame, p: str) -> tuple[Column, Column]:
    """Of each row, its step of that p-value and the least step that is a discovery among the runs of its length class.

    A p-value counts as the upper edge of its histogram step, which only makes the control stricter.
    """
    step = F.floor(-F.log(F.greatest(p, F.lit(1e-300))) * STEPS)
    hist = tests.groupBy("length_class", step.alias("step")).agg(F.count("*").alias("n"))  # at most 700 * STEPS rows a class
    within = Window.partitionBy("length_class")
    ranked = hist.select("length_class", "step", F.sum("n").over(within.orderBy(F.desc("step"))).alias("rank"), F.sum("n").over(within).alias("total"))
    least = ranked.filter(F.exp(-F.col("step") / STEPS) * F.col("total") <= FALSE_DISCOVERY * F.col("rank")).groupBy("length_class").agg(F.min("step").alias("least")).collect()
    table = [F.lit(x) for r in least for x in (r.length_class, r.least)]  # a class is a power of two
    return step, F.element_at(F.create_map(*table), F.col("length_class")) if table else F.lit(None).cast("bigint")


def discoveries(tests: DataFrame) -> DataFrame:
    """The runs that refute language and don't refute randomness, each with false-discovery control among the runs of their length class."""
    df = tests.withColumn("length_class", F.floor(F.log2(F.col("n") + 0.5)).cast("int"))
    (refuted, least), (odd, least_odd) = _significant(df, "p_language"), _significant(df, "p_random")
    return df.filter(F.coalesce(refuted >= least, F.lit(False)) & ~F.coalesce(odd >= least_odd, F.lit(False))).select("row", "start", "end")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, row (a number of the input row) and base, spans: arrays of (start, kind, end, value) in order of start, then kind.

    spans holds the base spans and those that the method adds. docs: doc_id, text, others ignored. One row per
    input row, repeated rows included; null and empty texts have none.
    """
    marked = base_spans(docs).withColumn("row", F.monotonically_increasing_id())
    found = stored(marked, "spans")
    runs = found.filter(F.size("runs") > 0).select("row", F.explode("runs").alias("x")).select("row", "x.start", "x.end", "x.value")
    tests = stored(tested(runs), "tests")
    added = stored(discoveries(tests), "discoveries").groupBy("row").agg(F.collect_list(F.struct(F.col("start"), F.lit(KINDS.index("random")).alias("kind"), F.col("end"), F.lit("").alias("value"))).alias("random"))
    drop_stored(tests)
    met = found.join(added, "row", "left").select("doc_id", "row", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.coalesce("random", F.array().cast(SPANS)).alias("random"))
    return met.select("doc_id", "row", "base", F.array_sort(F.concat("base", "random")).alias("spans"))


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs (see secret_spans)."""

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == KINDS.index(kind))).cast("bigint").alias(f"n_{kind}")

    return secret_spans(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


MARK = "[SECRET]"


def redact(docs: DataFrame) -> DataFrame:
    """docs with every secret's span in text replaced by MARK; overlapping spans become one mark. Other columns and rows stay."""
    own = F.xxhash64("text")
    found = secret_spans(docs.select(F.struct("doc_id", own.alias("own")).alias("doc_id"), "text")).filter(F.size("spans") > 0)
    key_id, key_own, marks = (f"_redact_{uuid.uuid4().hex}" for _ in range(3))  # no column of docs has such a name
    ends = F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end")))
    found = stored(found.select(F.col("doc_id.doc_id").alias(key_id), F.col("doc_id.own").alias(key_own), ends.alias(marks)).dropDuplicates([key_id, key_own]), "secrets")
    met = docs.join(found, docs["doc_id"].eqNullSafe(found[key_id]) & (own == found[key_own]), "left")
    text = F.col("text")
    return met.withColumn("text", F.when(F.col(marks).isNull(), text).otherwise(let(merged(F.col(marks)), lambda x: let(F.encode(text, "UTF-32"), lambda raw: _rewritten(raw, x))))).select(*docs.columns)


def merged(spans: Column) -> Column:
    """Spans sorted by start, with those that overlap made one; spans that only touch stay apart."""

    def heads(x: Column) -> Column:
        # A span begins a new one if none before it reaches past its start: the ends before it are all below, in order of start.
        chunks = F.transform(F.sequence(F.lit(0), F.size(x) - 1, F.lit(CHUNK)), lambda a: F.slice(x, a + 1, CHUNK))
        return let(chunks, lambda cs: let(_reached(cs), lambda reach: F.flatten(F.transform(cs, lambda c, i: _joined_up(c, F.get(reach, i))))))

    return let(heads(spans), _widened)


def _reached(chunks: Column) -> Column:
    """The greatest end before each chunk."""
    return F.aggregate(chunks, F.array(F.lit(0)), lambda s, c: F.concat(s, F.array(F.greatest(F.element_at(s, -1), F.array_max(F.transform(c, lambda x: x["end"]))))))


def _joined_up(chunk: Column, before: Column) -> Column:
    """The spans of a chunk, each with whether it begins a new one and with the greatest end up to it."""
    state = F.struct(before.alias("at"), F.array().cast("array<struct<start:int,reach:int,new:boolean>>").alias("out"))
    return F.aggregate(
        chunk,
        state,
        lambda s, x: F.struct(
            F.greatest(s["at"], x["end"]).alias("at"),
            F.concat(s["out"], F.array(F.struct(x["start"].alias("start"), F.greatest(s["at"], x["end"]).alias("reach"), (x["start"] >= s["at"]).alias("new")))).alias("out"),
        ),
        lambda s: s["out"],
    )


def _widened(x: Column) -> Column:
    """Of each span that begins a new one: where the text before it begins, and its start. The text after the last is a piece without a start."""
    begun = F.filter(F.transform(x, lambda s, i: F.struct(F.when(i > 0, F.get(x, i - 1)["reach"]).otherwise(F.lit(0)).alias("at"), s["start"].alias("start"), s["new"].alias("new"))), lambda s: s["new"])
    last = F.struct(F.element_at(x, -1)["reach"].alias("at"), F.lit(None).cast("int").alias("start"), F.lit(False).alias("new"))
    return F.concat(begun, F.array(last))


def _rewritten(raw: Column, pieces: Column) -> Column:
    """The text whose UTF-32 bytes are raw (so that a piece is found without walking through the text) with MARK between the pieces."""
    whole = F.octet_length(raw)
    part = lambda x: F.substring(raw, 4 * x["at"] + 1, F.coalesce(4 * x["start"], whole) - 4 * x["at"])
    return F.array_join(F.transform(pieces, lambda x: F.decode(part(x), "UTF-32")), MARK)
