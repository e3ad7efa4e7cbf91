"""Text corpora: exact and line duplicates, statistics, overlaps with a benchmark, personal data and licenses. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import BLANKS, LOWER, UPPER, Bloom, window_hashes, words
from quern.registry import query
from quern.sources.tables import load, small
from quern.storage import stored

_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x09-\x0D\x20]+'), lambda x: x <> '')"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


# --- duplicates -------------------------------------------------------------------------------------------------------


@query("doc_exact_dedup", "SELECT sha256(coalesce(text, '')) AS digest, min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents GROUP BY coalesce(text, '')")
def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct text (null counts as empty) by its digest, with the least id that has it and the number of its copies. Only digests are shuffled, one of a text from each task."""
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return load(spark, sf_dir, "documents", "doc_id", "text").groupBy(digest.alias("digest")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_kept and text: every document without the lines that the corpus has earlier.

    Lines are what \\n parts. A line is kept at its first (doc_id, position) in the corpus and dropped elsewhere, the document itself included; lines of nothing but white space stay. Null and
    empty texts have no lines. Null ids come first. Rows equal in doc_id and text are one document: each of them is given, with the same result.

    A line's first place is a minimum, so a task sends one row for each distinct line however often it occurs, and a line of the whole corpus is no hot key. Lines are shuffled as digests; what comes back to a document
    is the list of its kept positions, from which its text is put together in order.
    """
    own = F.sha2(F.coalesce("text", F.lit("")), 256)
    base = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("own", F.unhex(own))
    base = base.withColumn("lines", F.when(F.coalesce("text", F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("text", "\n", -1)))
    blank = lambda x: F.btrim(x, F.lit(BLANKS)) == ""
    placed = base.select("doc_id", "own", F.posexplode("lines").alias("at", "line")).filter(~blank(F.col("line")))
    first = placed.groupBy(F.unhex(F.sha2("line", 256)).alias("line")).agg(F.min(F.struct("doc_id", "own", "at")).alias("x"))
    kept = first.groupBy(F.col("x.doc_id").alias("k"), F.col("x.own").alias("o")).agg(F.collect_list("x.at").alias("kept"))  # at most a document's own lines
    met = base.join(kept, F.col("doc_id").eqNullSafe(F.col("k")) & (F.col("own") == F.col("o")), "left")
    blanks = F.filter(F.transform("lines", lambda x, i: F.when(blank(x), i)), lambda i: i.isNotNull())
    places = F.array_sort(F.concat(F.coalesce("kept", F.array().cast("array<int>")), blanks))
    made = met.withColumn("places", places)
    return made.select("doc_id", F.size("lines").cast("bigint").alias("n_lines"), F.size("places").cast("bigint").alias("n_kept"), F.array_join(F.transform("places", lambda i: F.get("lines", i)), "\n").alias("text"))


@query("doc_line_dedup", r"""WITH docs AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
    placed AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs WHERE text <> '')),
    marked AS (SELECT doc_id, i, line, NOT regexp_matches(line, '[^\x09-\x0D\x20]') OR row_number() OVER (PARTITION BY line ORDER BY doc_id, i) = 1 AS keep FROM placed),
    made AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE keep) AS k, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE keep) AS t FROM marked GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(k, 0)::BIGINT AS n_kept, coalesce(t, '') AS text FROM docs d LEFT JOIN (SELECT doc_id AS id, n, k, t FROM made) ON doc_id = id""".replace("SELECT doc_id, coalesce(n", "SELECT d.doc_id, coalesce(n"))
def doc_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(load(spark, sf_dir, "documents"))


# --- statistics -------------------------------------------------------------------------------------------------------

MOST_SYMBOLS, FEWEST_WORDS = 100, 20


@query("doc_stats_filter", rf"""WITH counted AS (SELECT doc_id, lang, len(w)::BIGINT AS n_words, 1000 * (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g'))) // greatest(len(w), 1) AS symbols,
    1000 * (len(w) - len(list_distinct(w))) // greatest(len(w), 1) AS repeats FROM (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS} AS w FROM documents)),
    langs AS (SELECT lang AS l, count(*) AS n, sum(repeats) AS s FROM counted GROUP BY lang)
    SELECT doc_id, lang, n_words, symbols::BIGINT AS symbols, repeats::BIGINT AS repeats, n_words >= {FEWEST_WORDS} AND symbols <= {MOST_SYMBOLS} AND repeats * n <= 2 * s AS kept FROM counted JOIN langs ON lang IS NOT DISTINCT FROM l""")
def doc_stats_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, symbols and repeated words (per mille of the words) of every document, kept if it has words enough, few symbols, and at most twice the mean repeats of its language."""
    docs = load(spark, sf_dir, "documents", "doc_id", "lang", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("w", words(F.col("text")))
    per_mille = lambda n: F.floor(1000 * n / F.greatest(F.size("w"), F.lit(1))).cast("bigint")
    counted = docs.select(
        "doc_id", "lang", F.size("w").cast("bigint").alias("n_words"), per_mille(F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).alias("symbols"),
        per_mille(F.size("w") - F.size(F.array_distinct("w"))).alias("repeats"),
    )
    counted = stored(counted, "stats")
    langs = counted.groupBy(F.col("lang").alias("l")).agg(F.count("*").alias("n"), F.sum("repeats").alias("s"))  # a row a language
    kept = (F.col("n_words") >= FEWEST_WORDS) & (F.col("symbols") <= MOST_SYMBOLS) & (F.col("repeats") * F.col("n") <= 2 * F.col("s"))
    return counted.join(small(langs), F.col("lang").eqNullSafe(F.col("l"))).select("doc_id", "lang", "n_words", "symbols", "repeats", kept.alias("kept"))


# --- overlaps with a benchmark ------------------------------------------------------------------------------------------

GRAM = 8


def overlaps(docs: DataFrame, benchmark: DataFrame, n: int = GRAM) -> DataFrame:
    """doc_id, n_windows, n_hits, first_item of every row of docs (doc_id, text): how many of its windows of n words the benchmark (item_id, text) has, and the least item that has one of them.

    The hashes of the benchmark's windows become a Bloom filter that the scan of docs applies, so of a clean document next to nothing goes further. The windows that pass are joined with
    the benchmark's by hash and by their words, which takes false ones out. Null texts and those of fewer than n words have no windows; items of fewer words are in none. Repeated rows each have their result.
    """
    text = lambda df: df["text"].cast("string")
    gram = lambda i: F.array_join(F.slice("w", i + 1, n), " ")
    items = benchmark.select(benchmark["item_id"].alias("item_id"), words(text(benchmark)).alias("w"))
    windows = items.select("item_id", "w", F.posexplode(window_hashes(F.col("w"), n)).alias("i", "g")).select("g", gram(F.col("i")).alias("gram"), "item_id")
    grams = stored(windows.groupBy("g", "gram").agg(F.min("item_id").alias("item")), "grams")
    bloom = Bloom(grams, "g")
    base = docs.select(docs["doc_id"].alias("doc_id"), words(text(docs)).alias("w")).withColumn("g", window_hashes(F.col("w"), n))
    passed = F.filter(F.transform("g", lambda g, i: F.when(bloom.may_hold(g), F.struct(g.alias("g"), i.alias("i")))), lambda x: x.isNotNull())
    passed = F.transform(passed, lambda x: F.struct(x["g"].alias("g"), gram(x["i"]).alias("gram")))
    seen = stored(base.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.size("g").cast("bigint").alias("n_windows"), passed.alias("passed")), "passed")
    # A window occurs in a document any number of times; it is joined once, with that number.
    found = seen.select("row", F.explode("passed").alias("x")).groupBy("row", "x.g", "x.gram").agg(F.count("*").alias("times"))
    hits = found.join(small(grams), ["g", "gram"]).groupBy("row").agg(F.sum("times").alias("n_hits"), F.min("item").alias("first_item"))
    return seen.join(hits, "row", "left").select("doc_id", "n_windows", F.coalesce("n_hits", F.lit(0)).alias("n_hits"), "first_item")


@query("doc_contamination", f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
    grams AS (SELECT g, min(item_id) AS item FROM (SELECT item_id, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 6)) AS i FROM b WHERE len(w) >= 8)) GROUP BY g),
    hits AS (SELECT r, count(*) AS n, min(item) AS item FROM (SELECT r, array_to_string(list_slice(w, i, i + 7), ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)) JOIN grams USING (g) GROUP BY r)
    SELECT doc_id, greatest(len(w) - 7, 0)::BIGINT AS n_windows, coalesce(n, 0)::BIGINT AS n_hits, item AS first_item FROM d LEFT JOIN hits USING (r)""")
def doc_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


# --- personal data ------------------------------------------------------------------------------------------------------

#: What may be personal data, by its form; of several forms at one place the first counts.
CANDIDATE = "|".join((
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",  # mail
    r"[0-9]+(?:\.[0-9]+){3,}",  # network address
    r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",  # account
    r"[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,4})?",  # card in groups
    r"[0-9]+",  # card
))
PII = ("email", "ip", "iban", "card")


def _luhn(digits: Column) -> Column:
    """Whether a number's check digit is right: from the right, every second digit doubled and cast out by nine, all add up to a multiple of ten."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: let(c.cast("int") * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(values, F.lit(0), lambda s, d: s + d) % 10 == 0


def _iban(code: Column) -> Column:
    """Whether an account number is 1 modulo 97: its first four characters moved to the end, letters as 10 to 35."""
    moved = F.split(F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4)), "")
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(moved, F.lit(0), lambda s, c: let(value(c), lambda v: (s * F.when(v > 9, 100).otherwise(10) + v) % 97)) == 1


def pii_kind(found: Column) -> Column:
    """The kind of a candidate, null if it fails its kind's check."""
    bare = F.translate(found, " -", "")
    octets = F.split(found, "\\.")
    return (
        F.when(F.contains(found, F.lit("@")), "email")
        .when(F.contains(found, F.lit(".")), F.when((F.size(octets) == 4) & F.forall(octets, lambda x: (F.length(x) <= 3) & (F.lpad(x, 3, "0") <= "255")), "ip"))
        .when(found.rlike("^[A-Z]"), F.when(_iban(bare), "iban"))
        .when(F.length(bare).between(13, 19), F.when(_luhn(bare), "card"))
    )


#: Candidates that one fold goes over, so that the time is linear in a text's candidates.
_CHUNK = 64


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_iban, n_card, spans and text: every document with its personal data replaced by [KIND].

    Candidates are found by form, leftmost and not overlapping, and checked: card numbers by Luhn, account numbers modulo 97, addresses by their octets. spans: kind:start:end, comma-joined, in code points
    of the text as it was, end exclusive. Null text is empty. What lies between the candidates gives their places.
    """
    base = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"))
    hits = F.transform(F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)), lambda m: F.struct(m.alias("m"), pii_kind(m).alias("kind")))
    split = base.withColumn("hits", hits).withColumn("gaps", F.split("text", CANDIDATE, -1))
    # Lengths of a gap and the candidate behind it; sums of whole chunks first, then within a chunk, so no step copies what is done.
    steps = F.transform("hits", lambda h, i: F.length(h["m"]) + F.length(F.get("gaps", i)))
    starts = F.transform(F.sequence(F.lit(0), F.greatest((F.size("hits") - 1).cast("int"), F.lit(0)), F.lit(_CHUNK)), lambda a: F.slice("steps", a + 1, _CHUNK))
    summed = split.withColumn("steps", steps).withColumn("chunks", starts)
    totals = F.transform("chunks", lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + x))
    upto = lambda xs: F.aggregate(xs, F.array(F.lit(0)), lambda s, x: F.concat(s, F.array(F.element_at(s, -1) + x)))
    ends = let(upto(totals), lambda t: F.flatten(F.transform("chunks", lambda c, k: F.transform(F.slice(upto(c), 2, _CHUNK), lambda x: x + F.get(t, k)))))
    placed = summed.withColumn("ends", ends)
    spans = F.transform("hits", lambda h, i: F.when(h["kind"].isNotNull(), F.concat_ws(":", h["kind"], (F.get("ends", i) - F.length(h["m"])).cast("string"), F.get("ends", i).cast("string"))))
    pieces = F.transform("gaps", lambda g, i: F.concat(g, F.coalesce(let(F.get("hits", i), lambda h: F.when(h["kind"].isNull(), h["m"]).otherwise(F.concat(F.lit("["), F.upper(h["kind"]), F.lit("]")))), F.lit(""))))
    count = lambda kind: F.size(F.filter("hits", lambda h: h["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return placed.select("doc_id", *[count(k) for k in PII], F.array_join(F.filter(spans, lambda x: x.isNotNull()), ",").alias("spans"), F.array_join(pieces, "").alias("text"))


_BARE = "replace(replace(m, ' ', ''), '-', '')"
_VALUE = "(CASE WHEN c BETWEEN 48 AND 57 THEN c - 48 ELSE c - 55 END)"
_DIGIT = "(CASE WHEN i % 2 = 0 AND c > 4 THEN 2 * c - 9 WHEN i % 2 = 0 THEN 2 * c ELSE c END)"
_KIND = rf"""CASE WHEN contains(m, '@') THEN 'email'
    WHEN contains(m, '.') THEN CASE WHEN len(string_split(m, '.')) = 4 AND len(list_filter(string_split(m, '.'), lambda x: length(x) > 3 OR lpad(x, 3, '0') > '255')) = 0 THEN 'ip' END
    WHEN regexp_matches(m, '^[A-Z]') THEN CASE WHEN list_reduce(list_prepend(0, list_transform(string_split({_BARE}[5:] || {_BARE}[:4], ''), lambda x: ascii(x))), lambda s, c: (s * (CASE WHEN {_VALUE} > 9 THEN 100 ELSE 10 END) + {_VALUE}) % 97) = 1 THEN 'iban' END
    WHEN length({_BARE}) BETWEEN 13 AND 19 THEN CASE WHEN list_sum(list_transform(list_transform(string_split(reverse({_BARE}), ''), lambda x: x::INT), lambda c, i: {_DIGIT})) % 10 = 0 THEN 'card' END END"""


@query("doc_pii", rf"""WITH base AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
    found AS (SELECT r, doc_id, regexp_extract_all(text, '{CANDIDATE}') AS ms, string_split_regex(text, '{CANDIDATE}') AS gs FROM base),
    rows AS (SELECT r, i, gs[i] AS g, coalesce(ms[i], '') AS m FROM (SELECT r, ms, gs, unnest(range(1, len(gs) + 1)) AS i FROM found)),
    kinds AS (SELECT *, {_KIND} AS kind, sum(length(g) + length(m)) OVER (PARTITION BY r ORDER BY i) AS stop FROM rows)
    SELECT any_value(doc_id) AS doc_id, {", ".join(f"count(*) FILTER (WHERE kind = '{k}')::BIGINT AS n_{k}" for k in PII)},
    coalesce(string_agg(kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY i) FILTER (WHERE kind IS NOT NULL), '') AS spans,
    string_agg(g || CASE WHEN kind IS NULL THEN m ELSE '[' || upper(kind) || ']' END, '' ORDER BY i) AS text FROM kinds JOIN base USING (r) GROUP BY r""".replace("SELECT *, CASE", "SELECT r, i, g, m, CASE").replace("text FROM kinds JOIN base USING (r)", "text FROM kinds JOIN (SELECT r, doc_id FROM base) USING (r)"))
def doc_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked(load(spark, sf_dir, "documents"))


# --- licenses -----------------------------------------------------------------------------------------------------------

#: Statements that name a license; fixed values of public licenses.
LICENSES = {
    "Apache-2.0": "licensed under the apache license version 2 0",
    "BSD-3-Clause": "released under the bsd 3 clause license",
    "CC-BY-NC-4.0": "licensed under cc by nc 4 0",
    "CC0-1.0": "released under the cc0 1 0 public domain dedication",
    "GPL-3.0": "licensed under the gnu general public license version 3",
    "MIT": "released under the mit license",
    "MPL-2.0": "licensed under the mozilla public license version 2 0",
}
LICENSE_WORDS, LICENSE_SHARE = 3, 600
_NAMED = "(?i)licen[cs]|released under"


def _pieces(statement: str) -> list[str]:
    w = statement.split()
    return sorted({" ".join(w[i : i + LICENSE_WORDS]) for i in range(len(w) - LICENSE_WORDS + 1)})


def license_lines(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 1), license and share: the lines that say under what license a text is.

    Of a line's words (runs of ASCII letters and digits, in lower case) the shingles of LICENSE_WORDS are compared with those of each statement of LICENSES; the license with the largest share (per mille) of its shingles there wins,
    the first by name of equals, if it is at least LICENSE_SHARE. Null texts have no lines.
    """
    lines = docs.select("doc_id", F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("at", "line")).filter(F.col("line").rlike(_NAMED))
    w = F.filter(F.split(F.translate("line", UPPER, LOWER), "[^a-z0-9]+"), lambda x: x != "")
    shingles = F.when(F.size("w") >= LICENSE_WORDS, F.transform(F.sequence(F.lit(1), F.size("w") - LICENSE_WORDS + 1), lambda i: F.array_join(F.slice("w", i, LICENSE_WORDS), " "))).otherwise(F.array().cast("array<string>"))
    known = F.array(*[F.struct(F.lit(k).alias("name"), F.array(*map(F.lit, _pieces(s))).alias("s")) for k, s in sorted(LICENSES.items(), reverse=True)])
    scored = F.transform(known, lambda k, i: F.struct(F.floor(1000 * F.size(F.array_intersect(k["s"], "s")) / F.size(k["s"])).cast("bigint").alias("share"), i.alias("place"), k["name"].alias("name")))
    best = lines.withColumn("w", w).withColumn("s", shingles).select("doc_id", (F.col("at") + 1).cast("bigint").alias("line"), F.array_max(scored).alias("best"))
    return best.filter(F.col("best.share") >= LICENSE_SHARE).select("doc_id", "line", F.col("best.name").alias("license"), F.col("best.share").alias("share"))


_STATEMENTS = ", ".join(f"('{k}', {_pieces(s)!r})" for k, s in LICENSES.items())


@query("doc_license", rf"""WITH lines AS (SELECT doc_id, i, l[i] AS line FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))),
    worded AS (SELECT doc_id, i, list_filter(string_split_regex(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM lines WHERE regexp_matches(line, '{_NAMED}')),
    shingled AS (SELECT doc_id, i, list_transform(range(1, len(w) - {LICENSE_WORDS - 2}), lambda k: array_to_string(list_slice(w, k, k + {LICENSE_WORDS - 1}), ' ')) AS s FROM worded),
    scored AS (SELECT doc_id, i, name, (1000 * len(list_intersect(k.p, s)) // len(k.p))::BIGINT AS share FROM shingled, (VALUES {_STATEMENTS}) k(name, p)),
    best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, i ORDER BY share DESC, name) AS rank FROM scored)
    SELECT doc_id, i::BIGINT AS line, name AS license, share FROM best WHERE rank = 1 AND share >= {LICENSE_SHARE}""")
def doc_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_lines(load(spark, sf_dir, "documents"))
